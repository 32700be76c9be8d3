"""Tables in the folder that all executors share: cut lineage between the rounds of a loop, and atomic checkpoints of a study."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a folder of our own, in local mode alone."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tokenloom-"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df written as a table of the shared folder and read back: what it took to make it is never done again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/t-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def dropped(df: DataFrame | None) -> None:
    """Deletes a table of written() that nothing reads any more."""
    path = getattr(df, "written_to", None)
    if path:
        files, place = _place(df.sparkSession, path)
        files.delete(place, True)


class Checkpoint:
    """Steps of a study in one folder, under a manifest with the study's configuration.

    A step is written beside the folder's steps and then renamed into place, so it is there whole or not at all, and an
    interrupted or repeated run never takes away one that stands. A folder with another configuration is refused.
    """

    def __init__(self, spark: SparkSession, path: str, configuration: dict):
        self.spark, self.path = spark, path.rstrip("/")
        want = json.dumps(configuration, sort_keys=True)
        files, manifest = _place(spark, f"{self.path}/manifest.json")
        if files.exists(manifest):
            have = "\n".join(r["value"] for r in spark.read.text(manifest.toString()).collect())
            if have != want:
                raise ValueError(f"{self.path} holds steps of another configuration: {have}")
            return
        beside = f"{self.path}/.manifest-{uuid.uuid4().hex}"
        spark.createDataFrame([(want,)], "value string").coalesce(1).write.text(beside)
        part = next(s.getPath() for s in files.listStatus(_place(spark, beside)[1]) if s.getPath().getName().startswith("part-"))
        if not files.rename(part, manifest) and not files.exists(manifest):
            raise OSError(f"cannot write {manifest.toString()}")
        files.delete(_place(spark, beside)[1], True)

    def done(self) -> set[int]:
        """Numbers of the steps that stand."""
        files, place = _place(self.spark, self.path)
        names = [s.getPath().getName() for s in files.listStatus(place)]
        return {int(n.removeprefix("step=")) for n in names if n.startswith("step=")}

    def write(self, step: int, rows: DataFrame) -> None:
        """Adds a step; one that stands already is left as it is."""
        beside = f"{self.path}/.step-{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(beside)
        files, source = _place(self.spark, beside)
        target = _place(self.spark, f"{self.path}/step={step}")[1]
        if files.exists(target) or not files.rename(source, target):
            files.delete(source, True)

    def read(self, schema: str) -> DataFrame:
        """Rows of all steps, with their number as step."""
        return self.spark.read.schema(f"{schema}, step int").parquet(self.path) if self.done() else self.spark.createDataFrame([], f"{schema}, step int")
