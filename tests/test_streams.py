"""Logs, snapshots, state and atomic tables against the plain merge of all versions."""

import os
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from loomline.operators.merge import merge_by_key
from loomline.storage import Pointer, Taken, Versioned
from loomline.streaming import upserts

SCHEMA = "id string, seq long, names array<string>, last string, kind string, top int, seen boolean"
RULES = {"names": "union", "last": "last", "kind": "strongest", "top": "max", "seen": "any"}


def versions(n, keys, r):
    pick = lambda *xs: r.choice(xs)
    return [(f"k{r.randrange(keys)}", i, pick(None, [], ["a"], ["b", "a"], [f"n{i % 5}"]), pick(None, f"v{i}"), pick(None, "stated", "contested", "inferred", "odd"), pick(None, i % 7), pick(None, True, False)) for i in range(n)]


def table(rows):
    return sorted(str(tuple(r[c] for c in ("id", *RULES))) for r in rows)


def part(path, run, batch, rows):
    folder = f"{path}/run={run}/batch={batch}"
    os.makedirs(folder)
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.string(), pa.int32(), pa.bool_()]
    pq.write_table(pa.table([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names), f"{folder}/part-0.parquet")
    open(f"{folder}/_SUCCESS", "w").close()


def test_compaction(spark, tmp_path):
    """After 1,000 batches a read touches one snapshot and the tail; late versions fold as if they had been there."""
    r = random.Random(5)
    every = versions(1030, 40, r)
    r.shuffle(every)
    path = f"{tmp_path}/log"
    args = (spark, path, SCHEMA, "id", "seq", RULES)
    for n, row in enumerate(every[:1000]):
        part(path, "ab"[n % 2], n // 2, [row])
    whole = lambda rows: table(merge_by_key(spark.createDataFrame(rows, SCHEMA), "id", "seq", RULES).collect())
    assert upserts.compact(*args) == 1
    assert table(upserts.merged_table(*args).collect()) == whole(every[:1000])
    for n, row in enumerate(every[1000:1020]):
        part(path, "a", 500 + n, [row])
    part(path, "c", 0, every[1020:])
    os.makedirs(f"{path}/run=a/batch=900")  # a batch under way
    found = upserts.merged_table(*args)
    files = found.inputFiles()
    assert sum("/run=" in f for f in files) == 21 and len({f.split("/")[-2] for f in files if "_snapshots" in f}) == 1
    assert table(found.collect()) == whole(every)
    assert upserts.compact(*args, vacuum=True) == 2 and upserts.compact(*args, vacuum=True) == 3
    assert table(upserts.merged_table(*args).collect()) == whole(every)
    assert not any("/run=" in f for f in upserts.merged_table(*args).inputFiles()) and len(os.listdir(f"{path}/_snapshots")) == 2
    assert upserts.compact(*args, vacuum=True) == 4 and not os.path.exists(f"{path}/run=a/batch=0")
    assert table(upserts.merged_table(*args).collect()) == whole(every)


def test_an_empty_log(spark, tmp_path):
    args = (spark, f"{tmp_path}/none", SCHEMA, "id", "seq", RULES)
    assert upserts.merged_table(*args).count() == 0
    assert upserts.compact(*args) == 1 and upserts.merged_table(*args).count() == 0


def test_state(spark, tmp_path):
    """Late and repeated versions, and a restart from the checkpoint, give the table of all versions."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    r = random.Random(7)
    every = versions(60, 6, r)
    r.shuffle(every)
    folder, out = f"{tmp_path}/in", f"{tmp_path}/out"
    schema = None
    for rows in (every[:30], every[20:45], every[45:] + every[:3]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        records = upserts.latest_stream(spark.readStream.schema(SCHEMA).parquet(folder), "id", "seq", RULES)
        schema = records.schema
        upserts.write_latest(records, out, f"{tmp_path}/ck").awaitTermination()
    got = upserts.latest_table(spark, out, schema, "id")
    assert table(got.collect()) == table(merge_by_key(spark.createDataFrame(every, SCHEMA), "id", "seq", RULES).collect())
    assert max(int(b.split("=")[1]) for b in os.listdir(next(f"{out}/{d}" for d in os.listdir(out)))) == 2


def test_expiry(spark, tmp_path):
    """State goes when its time is over, so a later version begins anew."""
    import time

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    folder, out = f"{tmp_path}/in", f"{tmp_path}/out"
    spark.createDataFrame([], SCHEMA).write.parquet(folder)
    records = upserts.latest_stream(spark.readStream.schema(SCHEMA).parquet(folder), "id", "seq", RULES, expire=1)
    query = upserts.write_latest(records, out, f"{tmp_path}/ck", "300 milliseconds")

    def seen():
        folders = list(upserts._batches(spark, out).values())
        return sorted((tuple(r) for r in spark.read.schema(records.schema).parquet(*folders).filter("id = 'k'").select("names", "last", "top").collect()), key=str) if folders else []

    try:
        for n, rows in enumerate(([("k", 1, ["a"], "x", None, 1, None)], [("k", 3, ["b"], None, None, 2, None)])):
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
            until = time.time() + 60
            while len(seen()) <= n and time.time() < until:
                time.sleep(0.5)
            time.sleep(4)
    finally:
        query.stop()
    assert seen() == [(["a"], "x", 1), (["b"], None, 2)]


def test_a_failing_write_leaves_the_table(spark, tmp_path):
    t = Versioned(spark, f"{tmp_path}/t")
    assert t.read() is None
    assert t.replace(spark.range(5).select("id", F.lit("a").alias("s"))) == 1
    bad = spark.range(5).select("id", F.when(F.col("id") < 9, F.raise_error(F.lit("no"))).cast("string").alias("s"))
    with pytest.raises(Exception, match="no"):
        t.replace(bad)
    assert sorted(r["id"] for r in t.read().collect()) == [0, 1, 2, 3, 4] and t.pointer.versions() == [1]
    old = t.read()
    # the new version may be made of the old one
    assert t.replace(t.read().filter("id > 2")) == 2
    assert sorted(r["id"] for r in t.read().collect()) == [3, 4] and old.count() == 5 and t.read(1).count() == 5


def test_partitions_are_replaced(spark, tmp_path):
    t = Versioned(spark, f"{tmp_path}/t")
    rows = [("b", 1, "x"), ("b", 2, "y"), (None, 1, "z"), ("c/d =", 1, "w")]
    schema = "book string, page int, v string"
    t.replace(spark.createDataFrame(rows, schema), by=("book", "page"))
    untouched = {f for f in t.read().inputFiles() if "__page=2" in f}
    t.replace_partitions(spark.createDataFrame([("b", 1, "x1"), ("b", 1, "x2"), (None, 1, "z1"), ("e", 5, "n")], schema))
    assert sorted(map(str, (tuple(r) for r in t.read().collect()))) == sorted(map(str, [("b", 1, "x1"), ("b", 1, "x2"), ("b", 2, "y"), (None, 1, "z1"), ("c/d =", 1, "w"), ("e", 5, "n")]))
    assert untouched and untouched <= set(t.read().inputFiles())
    with pytest.raises(ValueError):
        Versioned(spark, f"{tmp_path}/u").replace_partitions(spark.createDataFrame(rows, schema))
    for _ in range(2):
        t.replace(t.read(), by=("book", "page"))
    t.vacuum(1)
    assert t.read().count() == 6 and len(os.listdir(f"{tmp_path}/t/_data")) == 1
    t.replace(spark.createDataFrame([], schema), by=("book",))
    assert t.read().count() == 0


def test_two_writers(spark, tmp_path):
    p = Pointer(spark, f"{tmp_path}/p")
    assert p.read() == (0, {}) and p.swap(0, {"a": "é"}) == 1 and p.read() == (1, {"a": "é"})
    with pytest.raises(Taken):
        p.swap(0, {"a": 2})
    assert p.read() == (1, {"a": "é"}) and os.listdir(f"{tmp_path}/p") and not [f for f in os.listdir(f"{tmp_path}/p") if f.startswith("_")]
