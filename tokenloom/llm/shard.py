"""Sharding (operator 1): a uniform shuffle with exact shard sizes over a hypergeometric communication matrix.

Native: rows are only touched by DataFrame functions.

 1. Rows get a number that a written table makes lasting and are dealt by a hash of it into blocks of about
    BLOCK_ROWS rows, so no key, source or group of copies can fill a block.
 2. Only the blocks' row counts reach the driver. The matrix "rows of block b that go to shard s" is drawn there
    from the multivariate hypergeometric law with the counts as row sums and the shard sizes as column sums: the
    law that a uniform shuffle of all rows would induce. It has blocks x shards cells, never rows.
    Each cell is drawn by inversion of its exact hypergeometric law, whatever the number of rows.
 3. A permutation inside each block (row_number over a hash) and the matrix's running sums give a row's number its shard.
 4. Numbers are exchanged by shard and a slice of a second hash, and a permutation inside each slice behind the slices
    before it gives the slot: no task holds a whole shard.
 5. The rows themselves, texts and all, move once: to their numbers' shard and slot. This join is a sort-merge join at
    every size, so small tables cost what large ones do for each row.

Law: rows. Shard sizes differ by one at most; slots are gapless from 0 in each shard.

Edge cases: nulls in any column, empty and long texts count as rows like any other; repeated rows are rows of their
own; an empty table gives no rows; columns named shard or slot are replaced, other extra columns are kept; names
that start with _shuffle are reserved.
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm.common import materialise

BLOCK_ROWS = 500_000
#: Cells of the matrix in one literal of the small table that carries it to the rows.
CELLS_PER_LITERAL = 20_000


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    """Sizes at most one apart that add up to rows; the larger ones come first."""
    sizes = np.full(shards, rows // shards, np.int64)
    sizes[: rows % shards] += 1
    return sizes


def hypergeometric(good: int, bad: int, draws: int, rng: np.random.Generator) -> int:
    """How many of the draws without replacement from good and bad are good, by inversion of the exact law.

    Ratios of neighbouring probabilities are added up from the mode outwards; beyond 14 standard deviations and
    40 the law's mass is far below what a double can tell from zero.
    """
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    total = good + bad
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    spread = math.sqrt(draws * (good / total) * (bad / total) * max(0, total - draws) / max(1, total - 1))
    reach = int(14 * spread) + 40
    first, last = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(first, last, dtype=np.float64)  # probability of k+1 against k
    step = np.log((good - k) * (draws - k)) - np.log((k + 1) * (bad - draws + k + 1))
    law = np.r_[0.0, np.cumsum(step)]
    law = np.exp(law - law.max())
    mass = np.cumsum(law)
    return first + int(np.searchsorted(mass, rng.random() * mass[-1], "right"))


def communication_matrix(counts: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Rows of each block (counts) that go to each shard: the multivariate hypergeometric law, one shard after another."""
    rng = np.random.default_rng(seed)
    left = shard_sizes(int(counts.sum()), shards).tolist()
    out = np.zeros((len(counts), shards), np.int64)
    for b, n in enumerate(counts.tolist()):
        rest = sum(left)
        for s in range(shards):
            rest -= left[s]
            out[b, s] = hypergeometric(left[s], rest, n, rng) if n else 0
            n -= out[b, s]
            left[s] -= int(out[b, s])
    return out


def _small_table(spark, rows: list[dict], schema: str) -> DataFrame:
    """A table out of literals: counts by block, never rows of the data."""
    step = max(1, CELLS_PER_LITERAL // max(1, len(next(iter(rows), {"": ()}).get("ends", ()))))
    parts = [json.dumps(rows[i : i + step]) for i in range(0, len(rows), step)] or ["[]"]
    out = None
    for p in parts:
        one = spark.range(1).select(F.inline(F.from_json(F.lit(p), f"array<struct<{schema}>>")))
        out = one if out is None else out.union(one)
    return out


def assign_shards(rows: DataFrame, shards: int = 16, seed: int = 1) -> DataFrame:
    """rows with shard (int, from 0) and slot (long, gapless from 0 in each shard)."""
    spark = rows.sparkSession
    numbered = materialise(rows.drop("shard", "slot").withColumn("_shuffle_n", F.monotonically_increasing_id()))
    n = numbered.count()
    blocks = max(shards, math.ceil(n / BLOCK_ROWS))
    blocked = numbered.select("_shuffle_n").withColumn("_shuffle_block", F.pmod(F.xxhash64("_shuffle_n", F.lit(seed)), F.lit(blocks)).cast("int"))
    found = {r["_shuffle_block"]: r["n"] for r in blocked.groupBy("_shuffle_block").agg(F.count("*").alias("n")).collect()}  # a number for each block
    counts = np.array([found.get(b, 0) for b in range(blocks)], np.int64)
    matrix = communication_matrix(counts, shards, seed)
    ends = _small_table(spark, [{"_shuffle_block": b, "ends": np.cumsum(m).tolist()} for b, m in enumerate(matrix)], "_shuffle_block int, ends array<long>")
    inside = Window.partitionBy("_shuffle_block").orderBy(F.xxhash64("_shuffle_n", F.lit(seed + 1)), "_shuffle_n")
    place = blocked.withColumn("_shuffle_place", F.row_number().over(inside) - 1)
    slices = max(1, math.ceil(n / shards / BLOCK_ROWS))
    dealt = place.join(ends, "_shuffle_block").withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("_shuffle_place"))).cast("int"))
    second = F.xxhash64("_shuffle_n", F.lit(seed + 2))
    dealt = materialise(dealt.withColumn("_shuffle_slice", F.pmod(second, F.lit(slices)).cast("int")).drop("ends", "_shuffle_block", "_shuffle_place"))
    before = Window.partitionBy("shard").orderBy("_shuffle_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("shard", "_shuffle_slice").agg(F.count("*").alias("n")).select("shard", "_shuffle_slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_shuffle_start"))
    again = Window.partitionBy("shard", "_shuffle_slice").orderBy(F.xxhash64("_shuffle_n", F.lit(seed + 3)), "_shuffle_n")
    slot = dealt.withColumn("_shuffle_place", F.row_number().over(again).cast("long") - 1)
    places = slot.join(starts, ["shard", "_shuffle_slice"]).select("_shuffle_n", "shard", (F.col("_shuffle_start") + F.col("_shuffle_place")).alias("slot"))
    # both sides are dealt by number whatever their size: a broadcast of the places would grow with the rows
    return numbered.hint("merge").join(places, "_shuffle_n").select(*rows.drop("shard", "slot").columns, "shard", "slot")


def write_shards(rows: DataFrame, path: str, shards: int = 16, seed: int = 1, rows_per_file: int = 1_000_000) -> None:
    """Writes the shuffled rows as parquet, a folder for each shard and files in the order of their slots."""
    dealt = assign_shards(rows, shards, seed).withColumn("_shuffle_file", F.floor(F.col("slot") / rows_per_file))
    dealt.repartition("shard", "_shuffle_file").sortWithinPartitions("shard", "slot").drop("_shuffle_file").write.partitionBy("shard").parquet(path)


def sharding_report(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document; whole rows are dealt, size and text_crc32 are of the dealt texts."""
    dealt = assign_shards(docs.withColumn("doc_id", F.col("doc_id").cast("long")), shards)
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return dealt.select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
