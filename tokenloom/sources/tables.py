"""Inputs and outputs: parquet tables of a folder, clusterings, category files, settings, reports and checkpoints."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass, fields

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of a folder, or a directory of parquet files of that name."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def first_existing(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The table at the first of the paths that holds one."""
    for path in paths:
        try:
            return spark.read.parquet(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    raise FileNotFoundError(f"none of {paths} holds a table")


def column(df: DataFrame, *names: str):
    """The first of the columns that df has, else its first column."""
    return F.col(next((n for n in names if n in df.columns), df.columns[0]))


def clustering(rows: DataFrame, **wanted) -> DataFrame:
    """Labels of one configuration (columns and values) of a table of clusterings; where it is absent the error lists the configurations at hand."""
    chosen = rows
    for name, value in wanted.items():
        chosen = chosen.where(F.col(name).eqNullSafe(F.lit(value)))
    if chosen.isEmpty():
        at_hand = sorted(str(r.asDict()) for r in rows.select(*wanted).distinct().limit(100).collect())
        raise KeyError(f"no clustering {wanted}; at hand: {'; '.join(at_hand)}")
    if not chosen.where("label is null").isEmpty():
        raise ValueError(f"clustering {wanted} has rows without a label")
    return chosen


def categories(spark: SparkSession, path: str) -> DataFrame:
    """(cluster, category) from a JSON list of records or from one flat object of cluster to category."""
    raw = spark.read.text(path, wholetext=True)
    records = raw.select(F.inline(F.from_json("value", "array<struct<cluster:string,category:string>>")))
    flat = raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("cluster", "category"))
    return records.union(flat).where("cluster is not null").select(F.col("cluster").cast("int").alias("cluster"), "category")


@dataclass(frozen=True)
class Settings:
    """Parameters of a study; each can be set by a variable of the environment (LOOM_ and its name in capitals)."""

    clusters: int = 400
    iterations: int = 50
    share: float = 0.8
    prompt_tokens: int = 10
    folder: str = "."

    @classmethod
    def read(cls, environment: Mapping[str, str] | None = None, **given) -> Settings:
        """Given values before those of the environment before the defaults."""
        environment = os.environ if environment is None else environment
        found = {f.name: type(f.default)(environment[f"LOOM_{f.name.upper()}"]) for f in fields(cls) if f"LOOM_{f.name.upper()}" in environment}
        return cls(**(found | given))


def write_iteration(df: DataFrame, path: str, iteration: int) -> None:
    """One iteration's rows as a checkpoint of their own: Spark's commit makes them visible whole or not at all, and a rerun replaces them."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/iteration={iteration}")


def write_results(df: DataFrame, path: str, *mirrors: str, canonical: bool = True) -> None:
    """A table at path and, for canonical configurations, at its mirrors; a rerun replaces it."""
    for place in (path, *(mirrors if canonical else ())):
        df.write.mode("overwrite").option("compression", "zstd").parquet(place)


def write_report(df: DataFrame, path: str) -> None:
    """A report: rows as JSON objects, one a line, in files under path; a rerun replaces them."""
    df.write.mode("overwrite").json(path)


def once(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at path; made and written there if there is none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    make().write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def text_report(df: DataFrame, most: int = 20) -> str:
    """The first rows as aligned text."""
    rows = [[str(x) for x in r] for r in df.limit(most).collect()]
    widths = [max(len(x) for x in c) for c in zip(df.columns, *rows, strict=True)]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(r, widths, strict=True)).rstrip() for r in [df.columns, *rows])
