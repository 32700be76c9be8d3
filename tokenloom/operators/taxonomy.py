"""Token taxonomy: categories of tokens, dominant categories and top tokens of clusters, shares, comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.functions.tokens import CONTENT_BEARING, category, is_code, pieces


def counted(docs: DataFrame, cluster: str) -> DataFrame:
    """cluster, tok, n, first: how often a token occurs in a cluster of documents, and its first place (doc_id, pos)."""
    rows = docs.select(F.col(cluster).alias("cluster"), "doc_id", F.posexplode(pieces(F.col("text"))).alias("pos", "tok"))
    return rows.groupBy("cluster", "tok").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "pos")).alias("first"))


def category_sizes(tokens: DataFrame, *by: str) -> DataFrame:
    return tokens.groupBy(*by, category(F.col("tok")).alias("category")).agg(F.sum("n").alias("n"))


def dominant(tokens: DataFrame) -> DataFrame:
    """cluster, category, size: the commonest category of each cluster; of equal ones the first met."""
    kinds = tokens.groupBy("cluster", category(F.col("tok")).alias("category")).agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    best = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("n"), "first"))
    return kinds.withColumn("size", F.sum("n").over(Window.partitionBy("cluster"))).withColumn("r", best).where("r = 1").select("cluster", "category", "size")


def top_tokens(tokens: DataFrame, most: int = 20) -> DataFrame:
    """cluster, rank, tok, n of the commonest tokens; equal counts follow the first place."""
    place = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("n"), "first"))
    return tokens.withColumn("rank", place).where(F.col("rank") <= most).select("cluster", "rank", "tok", "n")


def shares(sized: DataFrame) -> DataFrame:
    """category, n, share of a table of category sizes (at most seven rows)."""
    return sized.withColumn("share", 100 * F.col("n") / F.sum("n").over(Window.partitionBy()))


def content_bearing(named: DataFrame) -> DataFrame:
    """clusters and the percentage whose dominant category bears content."""
    return named.agg(F.count("*").alias("clusters"), (100 * F.count_if(F.col("category").isin(CONTENT_BEARING)) / F.count("*")).alias("content_bearing_pct"))


def special_clusters(named: DataFrame, top: DataFrame) -> DataFrame:
    """Counts of clusters about numbers, about line ends, and with two code tokens among their first five."""
    marks = top.groupBy("cluster").agg(F.max(F.contains("tok", F.lit("\n")).cast("int")).alias("newline"), F.count_if((F.col("rank") <= 5) & is_code(F.col("tok"))).alias("code"))
    both = named.join(marks, "cluster")
    return both.agg(
        F.count_if(F.col("category") == "NUMERIC").alias("numerical"), F.count_if((F.col("category") == "FORMATTING") & (F.col("newline") == 1)).alias("newline"), F.count_if(F.col("code") >= 2).alias("code"),
    )


def aligned(left: DataFrame, right: DataFrame) -> DataFrame:
    """category, left_n, right_n of two tables of category sizes; absent ones are zero."""
    joined = left.withColumnRenamed("n", "left_n").join(right.withColumnRenamed("n", "right_n"), "category", "full_outer")
    return joined.select("category", F.coalesce("left_n", F.lit(0)).alias("left_n"), F.coalesce("right_n", F.lit(0)).alias("right_n"))


def looked_up(rows: DataFrame, names: DataFrame) -> DataFrame:
    """rows with the category of their cluster, UNKNOWN where none is recorded."""
    return rows.join(names, "cluster", "left").withColumn("category", F.coalesce("category", F.lit("UNKNOWN")))
