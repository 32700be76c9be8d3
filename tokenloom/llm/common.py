"""Shared pieces of the training-data operators: the shared folder, written tables, word splitting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a scale-factor folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where that is unset, one of our own, in local mode alone."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tokenloom-"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


#: Rows of an Arrow batch that are turned into Python objects at once, and rows of the batch itself.
SLICE_ROWS, BATCH_ROWS = 250, 1_000


def set_aside(df: DataFrame, names: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """df with the columns that have one of names (in any case) renamed to names that nobody has, and what leads back."""
    taken, wanted, back = {c.lower() for c in [*df.columns, *names]}, {n.lower() for n in names}, {}
    for c in df.columns:
        if c.lower() in wanted:
            number = 0
            while f"_own{number}_{c}".lower() in taken:
                number += 1
            back[f"_own{number}_{c}"] = c
            taken.add(f"_own{number}_{c}".lower())
    return df.withColumnsRenamed({c: new for new, c in back.items()}), back


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's rows per Arrow batch to BATCH_ROWS: batches are held by the JVM and by Python at once, beside the task's own memory. Spark reads the setting when a frame runs, so it has to stay for the frames that operators return."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def pieces(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches, cut to at most so many rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def with_computed(df: DataFrame, inputs: list[str], fields: str, start: Callable[[], Callable], without: tuple[str, ...] = ()) -> DataFrame:
    """df without the columns named in without, with fields computed from the columns inputs.

    fields is a schema's text; start() is called once a task and gives a function from the inputs' lists of values to the fields' lists. Other
    columns stay in Arrow, so that ids keep their value whatever nulls stand beside them. Columns of df that have a
    field's name are replaced.
    """
    bound_batches(df.sparkSession)
    made = T.StructType.fromDDL(fields)
    base = df.drop(*made.names)
    kept = [n for n in base.columns if n not in without]
    schema = T.StructType([*[base.schema[n] for n in kept], *made.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute, types = start(), [f.type for f in to_arrow_schema(made)]
        for batch in pieces(batches):
            columns = compute(*[batch.column(n).to_pylist() for n in inputs])
            arrays = [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], *arrays], names=[*kept, *made.names])

    return base.mapInArrow(run, schema)


def materialise(df: DataFrame, *partition_by: str) -> DataFrame:
    """Cuts the lineage: writes df as a table in the shared folder and reads it back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/t-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(df: DataFrame | None) -> None:
    """Deletes a table of materialise() that nothing reads any more."""
    path = getattr(df, "written_to", None)
    if path:
        spark = df.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def crc_remainder(key: str, modulus: int):
    """crc32 of a key's text, modulo a small number; a null key gives null."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % modulus


#: Lower-cases A-Z and leaves every other byte.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: The same, and turns ASCII that is neither letter nor digit into spaces; bytes of multi-byte characters stay.
ALNUM = bytes(b + 32 if 65 <= b <= 90 else b if chr(b).isalnum() and b < 128 or b >= 128 else 32 for b in range(256))


def utf8(text: object) -> bytes:
    """UTF-8 bytes of a text; none for null."""
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def spaced_words(text: object) -> list[bytes]:
    """Lower-cased words between the white-space bytes 20 and 09-0D."""
    return utf8(text).translate(LOWER).split()


def alnum_words(text: object) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and non-ASCII characters."""
    return utf8(text).translate(ALNUM).split()
