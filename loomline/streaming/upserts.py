"""Streams into merged tables, and windowed counts of event streams."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from loomline.operators.merge import STRENGTH, strength
from loomline.storage import Pointer

#: Rules that keep one value and the order it came in.
_ORDERED = ("last", "first", "strongest")


def merge_stream(stream: DataFrame, path: str, checkpoint: str, every: str | None = None):
    """Appends each micro-batch's versions to a log below ``path``, of which ``merged_table`` is the table.

    A batch writes its own rows and nothing else, under the checkpoint's name and its
    number: one that runs again writes the same part, and a new checkpoint beside it
    writes parts of its own.  It takes what there is and ends, or runs on at an interval.
    """
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/run={run}/batch={number}")

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(add).trigger(**trigger).start()


def _states(rows: DataFrame, key: str, seq: str, rules: Mapping[str, str]) -> DataFrame:
    """Each version as a partial fold: what a rule needs to be folded with others in any order."""
    s = F.col(seq).cast("long")

    def one(c: str, rule: str):
        v = F.col(c)
        if rule == "union":
            return F.transform(v, lambda x, i: F.struct(F.struct(s.alias("s"), i.alias("p")).alias("at"), x.alias("v")))
        return F.struct(F.when(v.isNotNull(), s).alias("s"), v.alias("v")) if rule in _ORDERED else v

    return rows.select(key, *(one(c, rule).alias(c.replace(".", "__")) for c, rule in rules.items()))


def _folded(states: DataFrame, key: str, rules: Mapping[str, str]) -> DataFrame:
    """Partial folds of one key as one; the result is a partial fold again."""
    flat = {c.replace(".", "__"): rule for c, rule in rules.items()}

    def one(c: str, rule: str):
        s, v = F.col(f"{c}.s"), F.col(c)
        order = {"last": s, "first": -s, "strongest": F.when(s.isNotNull(), F.struct(strength(F.col(f"{c}.v")), -s))}.get(rule)
        return F.max_by(v, order) if rule in _ORDERED else {"max": F.max, "min": F.min, "any": F.bool_or}[rule](v)

    out = states.groupBy(key).agg(F.count("*").alias("__n"), *(one(c, rule).alias(c) for c, rule in flat.items() if rule != "union"))
    for c in (c for c, rule in flat.items() if rule == "union"):
        items = states.select(key, F.explode(c).alias("x")).groupBy(key, F.col("x.v").alias("v")).agg(F.min("x.at").alias("at"))
        lists = items.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias(c))
        out = out.join(lists, key, "left").withColumn(c, F.coalesce(c, F.array().cast(states.schema[c].dataType)))
    return out.select(key, *flat)


def _values(states: DataFrame, key: str, rules: Mapping[str, str]) -> DataFrame:
    """The records of whole folds; a dotted column is a field of a struct and is put back."""
    value = {c: F.transform(c.replace(".", "__"), lambda x: x["v"]) if rule == "union" else F.col(c.replace(".", "__") + (".v" if rule in _ORDERED else "")) for c, rule in rules.items()}
    heads = dict.fromkeys(c.split(".")[0] for c in rules)
    parts = {h: [c for c in rules if c.startswith(f"{h}.")] for h in heads}
    return states.select(key, *(F.struct(*(value[c].alias(c.split(".")[1]) for c in parts[h])).alias(h) if parts[h] else value[h].alias(h) for h in heads))


def _batches(spark: SparkSession, path: str) -> dict[tuple[str, int], str]:
    """The log's parts that are whole, by run and number."""
    found = {}
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for s in fs.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/run=*/batch=*/_SUCCESS")) or []:
        folder = s.getPath().getParent()
        run, batch = re.search(r"run=([^/]+)/batch=(\d+)$", folder.toString()).groups()
        found[run, int(batch)] = folder.toString()
    return found


def _log(spark: SparkSession, path: str, schema: str, key: str, seq: str, rules: Mapping[str, str]) -> tuple[DataFrame, int, dict, dict[str, int]]:
    """(partial folds of the snapshot and of the parts behind it, the pointer's version, its document, the last part of each run)."""
    version, now = Pointer(spark, f"{path}/_pointer").read()
    done = now.get("folded", {})
    parts = _batches(spark, path)
    tail = [folder for (run, n), folder in sorted(parts.items()) if n > done.get(run, -1)]
    fresh = spark.read.schema(schema).parquet(*tail) if tail else spark.createDataFrame([], schema)
    states = _states(fresh, key, seq, rules)
    if now:
        states = spark.read.schema(states.schema).parquet(f"{path}/{now['snapshot']}").unionByName(states)
    last: dict[str, int] = dict(done)
    for run, n in parts:
        last[run] = max(n, last.get(run, -1))
    return states, version, now, last


def merged_table(spark: SparkSession, path: str, schema: str, key: str, seq: str, rules: Mapping[str, str]) -> DataFrame:
    """All versions of a log, folded by ``rules`` in the order of ``seq``, whichever batch brought them.

    Reads the last snapshot, if ``compact`` made one, and the parts behind it.
    """
    states, *_ = _log(spark, path, schema, key, seq, rules)
    return _values(_folded(states, key, rules), key, rules)


def compact(spark: SparkSession, path: str, schema: str, key: str, seq: str, rules: Mapping[str, str], vacuum: bool = False) -> int:
    """Folds a log's parts into a snapshot and swaps the pointer; the new version.

    A snapshot keeps partial folds, with the order of each value, so versions that
    arrive later but are older by ``seq`` fold as if they had been there.  Readers see
    the old snapshot and its tail, or the new one.  ``vacuum`` deletes the parts and
    snapshots that neither this version nor the one before reads.
    """
    states, version, before, last = _log(spark, path, schema, key, seq, rules)
    name = f"_snapshots/{uuid.uuid4().hex}"
    _folded(states, key, rules).write.parquet(f"{path}/{name}")
    pointer = Pointer(spark, f"{path}/_pointer")
    new = pointer.swap(version, {"snapshot": name, "folded": last})
    if vacuum:
        conf, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm
        gone = [folder for (run, n), folder in _batches(spark, path).items() if n <= before.get("folded", {}).get(run, -1)]
        used = {d["snapshot"] for d in pointer.forget(2)}
        root = jvm.org.apache.hadoop.fs.Path(f"{path}/_snapshots")
        fs = root.getFileSystem(conf)
        gone += [s.getPath().toString() for s in fs.listStatus(root) if f"_snapshots/{s.getPath().getName()}" not in used]
        for folder in gone:
            fs.delete(jvm.org.apache.hadoop.fs.Path(folder), True)
    return new


class _Latest(StatefulProcessor):
    """One record's fold as value state; rules that keep order keep the order of what they hold."""

    def __init__(self, key: str, seq: str, rules: dict[str, str], state: T.StructType, expire_ms: int | None):
        self.key, self.seq, self.rules, self.state, self.expire_ms = key, seq, rules, state, expire_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.record = handle.getValueState("record", self.state)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now = list(self.record.get() or []) if self.record.exists() else []
        # stored rows go back as plain tuples
        versions, held = (now[0], {c: tuple(v) if rule in _ORDERED and v is not None else v for (c, rule), v in zip(self.rules.items(), now[1:])}) if now else (0, {})
        for row in rows:
            versions += 1
            seq = row[self.seq]
            for c, rule in self.rules.items():
                self._fold(held, c, rule, row[c], seq)
        self.record.update((versions, *(held.get(c) for c in self.rules)))
        if self.expire_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.expire_ms)
        yield Row(**{self.key: key[0], "versions": versions}, **{c: self._value(held.get(c), rule) for c, rule in self.rules.items()})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.record.clear()
        return iter(())

    def close(self) -> None:
        pass

    @staticmethod
    def _fold(held: dict, c: str, rule: str, value, seq) -> None:
        old = held.get(c)
        if rule == "union":
            first = {x[2]: (x[0], x[1], x[2]) for x in old or []}
            for p, v in enumerate(value or []):
                first[v] = min(first.get(v, (seq, p, v)), (seq, p, v), key=lambda x: x[:2])
            held[c] = sorted(first.values(), key=lambda x: x[:2])
        elif value is None:
            return
        elif rule in _ORDERED:
            rank = dict(STRENGTH)
            place = {"last": lambda s, v: s, "first": lambda s, v: -s, "strongest": lambda s, v: (rank.get(v, -1), -s)}[rule]
            if old is None or place(seq, value) > place(*old):
                held[c] = (seq, value)
        else:
            held[c] = value if old is None else {"max": max, "min": min, "any": lambda a, b: a or b}[rule](old, value)

    @staticmethod
    def _value(held, rule: str):
        if rule == "union":
            return [x[2] for x in held or []]
        return held[1] if held is not None and rule in _ORDERED else held


def latest_stream(stream: DataFrame, key: str, seq: str, rules: Mapping[str, str], expire: int | None = None) -> DataFrame:
    """A stream of versions to a stream of merged records (key, versions, and the columns of ``rules``), by state per key.

    A record is given out whenever versions of it arrive, as ``merge_by_key`` would
    merge all so far: late and repeated versions fold by their ``seq``.  ``expire`` is
    the number of seconds without a version after which a key's state goes; a later
    version then begins anew.  The session needs the RocksDB state store.
    """
    kinds = {f.name: f.dataType for f in stream.schema}
    long = T.LongType()

    def state(c: str, rule: str) -> T.DataType:
        if rule == "union":
            return T.ArrayType(T.StructType([T.StructField("s", long), T.StructField("p", long), T.StructField("v", kinds[c].elementType)]))
        return T.StructType([T.StructField("s", long), T.StructField("v", kinds[c])]) if rule in _ORDERED else kinds[c]

    held = T.StructType([T.StructField("versions", long), *(T.StructField(c, state(c, r)) for c, r in rules.items())])
    out = T.StructType([T.StructField(key, kinds[key]), T.StructField("versions", long), *(T.StructField(c, kinds[c]) for c in rules)])
    rows = stream.select(key, F.col(seq).cast("long").alias(seq), *rules)
    processor = _Latest(key, seq, dict(rules), held, None if expire is None else expire * 1000)
    return rows.groupBy(key).transformWithState(processor, out, "Update", "None" if expire is None else "ProcessingTime")


def write_latest(records: DataFrame, path: str, checkpoint: str, every: str | None = None):
    """``latest_stream``'s records to a log, of which ``latest_table`` is the table.

    A stream whose state expires has batches for its timers without end, so it needs an interval.
    """
    return merge_stream(records, path, checkpoint, every)


def latest_table(spark: SparkSession, path: str, schema: T.StructType, key: str) -> DataFrame:
    """Of each key the record of most versions."""
    folders = list(_batches(spark, path).values())
    rows = spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)
    rest = [f.name for f in schema if f.name not in (key, "versions")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "versions").alias("r")).select(key, "r.*")


def tumbling(events: DataFrame, time: str, every: str, late: str, *by: str) -> DataFrame:
    """Counts and sums per window; rows later than ``late`` are left out of a stream."""
    return events.withWatermark(time, late).groupBy(F.window(time, every), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, time: str, gap: str, late: str, *by: str) -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), *by).agg(F.count("*").alias("n"))
