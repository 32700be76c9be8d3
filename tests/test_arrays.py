"""Array files: round trips, order of names, row ranges, fallback members, refusals."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tokenloom.operators import corpus
from tokenloom.sources import arrays


@pytest.fixture(autouse=True)
def formats(spark):
    arrays.register(spark)


def values(spark, form, path, **options):
    return [r["value"] for r in spark.read.format(form).options(**options).load(str(path)).orderBy("row").collect()]


def test_npy_round_trip_keeps_the_order_of_partitions(spark, tmp_path, monkeypatch):
    rows = spark.range(2500).select(F.array(F.col("id").cast("double"), F.lit(0.5)).alias("v")).repartitionByRange(4, "v").sortWithinPartitions("v")
    for _ in range(2):  # an overwrite replaces
        rows.write.format("npy_rows").mode("overwrite").save(f"{tmp_path}/m")
    assert values(spark, "npy_rows", f"{tmp_path}/m") == [[float(i), 0.5] for i in range(2500)]
    rows.write.format("npy_rows").mode("append").save(f"file://{tmp_path}/m")
    assert spark.read.format("npy_rows").load(f"file://{tmp_path}/m").count() == 5000
    assert not [p for p in (tmp_path / "m").iterdir() if p.name.startswith(".job")]


def test_npy_files_by_name_and_range(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(arrays, "RANGE_ROWS", 3)
    (tmp_path / "x").mkdir()
    np.save(tmp_path / "x" / "b.npy", np.arange(4, 11, dtype=np.int32))
    np.save(tmp_path / "x" / "a.npy", np.arange(4, dtype=np.int32))
    np.save(tmp_path / "x" / "c.npy", np.zeros(0, np.int32))
    (tmp_path / "x" / "_SUCCESS").touch()
    assert values(spark, "npy_rows", tmp_path / "x") == list(range(11))
    assert len(arrays.NpyReader(str(tmp_path / "x")).partitions()) == 5
    assert values(spark, "npy_rows", tmp_path / "x" / "b.npy") == list(range(4, 11))


def test_npz_falls_back_to_the_first_member(spark, tmp_path):
    (tmp_path / "z").mkdir()
    np.savez_compressed(tmp_path / "z" / "1.npz", other=np.array([9.0]), labels=np.array([True, False]))
    np.savez_compressed(tmp_path / "z" / "2.npz", labels=np.array([True]))
    assert values(spark, "npz_member", tmp_path / "z", members="label,labels") == [True, False, True]
    assert values(spark, "npz_member", tmp_path / "z" / "1.npz", members="absent") == [9.0]
    spark.range(5).write.format("npz_member").option("members", "ids").mode("append").save(f"{tmp_path}/w")
    assert sorted(values(spark, "npz_member", f"{tmp_path}/w", members="ids")) == list(range(5))


def test_arrow_files_and_streams(spark, tmp_path):
    rows = spark.createDataFrame([(i, None if i % 7 == 0 else f"t{i}", [i] * (i % 3)) for i in range(50)], "doc_id long, text string, ids array<int>").repartition(3)
    rows.write.format("arrow_ipc").mode("append").save(f"{tmp_path}/a")
    back = spark.read.format("arrow_ipc").load(f"{tmp_path}/a")
    assert back.columns == rows.columns and sorted(map(tuple, back.collect()), key=lambda r: r[0]) == sorted(map(tuple, rows.collect()), key=lambda r: r[0])
    (tmp_path / "s").mkdir()
    for name, at in (("data-00001.arrow", 3), ("data-00000.arrow", 0)):
        table = pa.table({"x": [at, at + 1, at + 2]})
        with pa.OSFile(str(tmp_path / "s" / name), "wb") as f, pa.ipc.new_stream(f, table.schema) as w:
            w.write_table(table, max_chunksize=2)
    told = spark.read.format("arrow_ipc").option("positions", "true").load(f"{tmp_path}/s").orderBy("file_name", "file_row")
    assert [(r["x"], r["file_row"]) for r in told.collect()] == [(0, 0), (1, 1), (2, 2), (3, 0), (4, 1), (5, 2)]


def test_refusals(spark, tmp_path):
    (tmp_path / "o").mkdir()
    np.save(tmp_path / "o" / "o.npy", np.asfortranarray(np.ones((2, 3))))
    for path in (tmp_path / "o", tmp_path / "none-there"):
        with pytest.raises(Exception, match="row order|no .npy|[Nn]o such|not found|Cannot"):
            spark.read.format("npy_rows").load(str(path)).collect()
    ragged = spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "v array<double>").coalesce(1)
    with pytest.raises(Exception, match="different lengths"):
        ragged.write.format("npy_rows").mode("append").save(f"{tmp_path}/r")


def test_softmax_losses(spark):
    rows = spark.createDataFrame([(1, "m", [0.0, 0.0], 1), (2, "m", [1000.0, 0.0], 0), (3, "m", [0.0, 1000.0], 0), (4, "m", None, 0), (5, "m", [1.0], 3), (6, "n", [1.0, 2.0, 3.0], 2)], "id long, model string, logits array<double>, target int")
    got = {r["id"]: r["loss"] for r in corpus.softmax_losses(rows).collect()}
    assert got[4] is None and got[5] is None and got[2] == 0.0 and got[3] == 1000.0
    assert abs(got[1] - np.log(2)) < 1e-12 and abs(got[6] - (np.log(np.exp([1, 2, 3]).sum()) - 3)) < 1e-12
    assert [r["id"] for r in corpus.of_model(corpus.softmax_losses(rows), "n").collect()] == [6]
    with pytest.raises(KeyError, match="'m', 'n'"):
        corpus.of_model(rows, "z")
