"""Secrets, weighed by how widely their values are owned across the corpus.

Fixed forms (assignments, access keys, long hex) are always reported.  Further
tokens that merely look like keys are candidates: their values' hashes are counted
by distinct repositories and owners over the whole corpus.  A value that many
owners hold is a copied example and is left alone; one that few hold is a live-
looking credential of theirs, and its span is added.  The same counts are reported
for the fixed forms.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.llm.texts import binary, carried, handed_on
from loomline.storage import Scratch, bound_batches

KINDS = ("assign", "access", "hex", "key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LONG = re.compile(rb"[A-Za-z0-9+/_-]{20,}")
KEY = re.compile(r"[A-Za-z0-9+/_-]{20,}")
LONG_HEX = re.compile(r"[0-9a-f]{24,}")
NAMES = (b"passw", b"secret", b"token", b"api")
#: What every span needs, as a pattern of Spark's rlike.
NEEDED = r"[A-Za-z0-9+/_-]{20}|(?i:passw|secret|token|api)"
#: Owners and repositories up to which a value counts as theirs, and bits a character of a candidate has at least.
MAX_OWNERS, MAX_REPOS, BITS = 2, 4, 3.5
FOUND = "array<struct<start:int,kind:int,stop:int,value:bigint>>"


def _keylike(token: str) -> bool:
    """Upper and lower case, digits, no word-like repetition."""
    if not (re.search("[0-9]", token) and re.search("[a-z]", token) and re.search("[A-Z]", token)):
        return False
    share = np.unique(list(token), return_counts=True)[1] / len(token)
    return float(-(share * np.log2(share)).sum()) >= BITS


def scan(raw: bytes) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, hash of the value) in code points; candidates of kind 3 overlap no other span."""
    lower = raw.lower()
    named, long = any(n in lower for n in NAMES), LONG.search(raw)
    if not named and not long:
        return []
    text = raw.decode()
    spans = []
    if named:
        spans += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if long:
        spans += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end(), m[0]) for m in LONG_HEX.finditer(text)]
        taken = sorted((s, e) for s, _, e, _ in spans)
        at = reach = 0  # both lists are in order: reach is the furthest end of the spans that start ahead of a candidate's end
        for m in KEY.finditer(text):
            while at < len(taken) and taken[at][0] < m.end():
                reach = max(reach, taken[at][1])
                at += 1
            if reach <= m.start() and _keylike(m[0]):
                spans.append((m.start(), 3, m.end(), m[0]))
    return sorted((s, k, e, xxhash.xxh3_64_intdigest(v.encode()) - 2**63) for s, k, e, v in spans)


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32()), ("value", pa.int64())]))
    for batch in batches:
        found = [[dict(zip(("start", "kind", "stop", "value"), s)) for s in scan(t or b"")] for t in binary(batch, "__text")]
        rest = [n for n in batch.schema.names if n != "__text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), pa.array(found, kind)], [*rest, "found"])


def find_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_cols: tuple[str, ...] = ("source",), repo_cols: tuple[str, ...] = ("source", "lang"), keep: tuple[str, ...] = (), max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS
) -> DataFrame:
    """``docs`` to one row per row: id_col, row, spans.

    row is a struct of the columns of ``keep``, if any, so their names can't clash.
    spans: start, kind (index into KINDS), stop, n_owners, n_repos, shared; by
    start, then kind; offsets in code points, stop exclusive.  Spans of the first
    three kinds are all there; candidates only if at most max_owners owners hold the
    value, in at most max_repos repositories.  shared marks a value held more widely.

    A null text is empty, very long texts are searched whole.  A null owner or repository is one unknown owner.  Rows
    that repeat are searched each and count once as owners.  An empty table gives
    an empty result; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark)

    def joined(cols: tuple[str, ...]) -> Column:
        return F.to_json(F.array(*(F.col(c).cast("string") for c in cols)))

    source = docs.select(*carried(id_col, keep), joined(owner_cols).alias("__owner"), joined(repo_cols).alias("__repo"), F.col(text_col).alias("__text"))
    schema = T.StructType([f for f in source.schema if f.name != "__text"] + [T.StructField("found", T._parse_datatype_string(FOUND))])
    scanned = scratch.cut(source.mapInArrow(_scanned, schema).withColumn("__at", F.monotonically_increasing_id()), "scanned")
    spans = scanned.filter("size(found) > 0").select("__at", "__owner", "__repo", F.inline("found"))
    owners = spans.select("value", "__owner").distinct().groupBy("value").agg(F.count("*").alias("n_owners"))
    repos = spans.select("value", "__repo").distinct().groupBy("value").agg(F.count("*").alias("n_repos"))
    counted = spans.select("__at", "start", "kind", "stop", "value").join(owners.join(repos, "value"), "value").withColumn("shared", (F.col("n_owners") > max_owners) | (F.col("n_repos") > max_repos))
    told = counted.filter("kind < 3 or not shared").groupBy("__at").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "stop", "n_owners", "n_repos", "shared"))).alias("spans"))
    return scanned.drop("__owner", "__repo", "found").join(told, "__at", "left").select(
        *handed_on(id_col, keep),
        F.coalesce("spans", F.expr("cast(array() as array<struct<start:int,kind:int,stop:int,n_owners:bigint,n_repos:bigint,shared:boolean>>)")).alias("spans"),
    )


def _cover(texts: pd.Series, spans: pd.Series, mark: str) -> pd.Series:
    out = []
    for t, found in zip(texts, spans):
        parts, at = [], 0
        for s in found:
            if s["stop"] > at:
                parts += [t[at : s["start"]], mark] if s["start"] >= at else []
                at = s["stop"]
        out.append("".join([*parts, t[at:]]))
    return pd.Series(out)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", mark: str = "<SECRET>", **how) -> DataFrame:
    """``docs`` with every found span replaced by ``mark``; other columns and rows stay.

    length_col, if the table has it, follows the changed texts.  Texts that cannot
    hold a span are passed through without a shuffle.
    """
    needed = F.coalesce(F.col(text_col).rlike(NEEDED), F.lit(False))
    found = find_secrets(docs.filter(needed), id_col, text_col, keep=tuple(docs.columns), **how)

    @F.pandas_udf("string")
    def covered(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return _cover(texts, spans, mark)

    changed = F.size("spans") > 0
    was = lambda c: F.col("row")[c]
    new = found.select("row", changed.alias("changed"), F.when(changed, covered(was(text_col), F.col("spans"))).otherwise(was(text_col)).alias("text"))
    values = {c: was(c) for c in docs.columns} | {text_col: F.col("text")}
    if length_col in docs.columns:
        values[length_col] = F.when(F.col("changed"), F.length("text").cast(docs.schema[length_col].dataType)).otherwise(was(length_col))
    return docs.filter(~needed).unionByName(new.select(*(v.alias(c) for c, v in values.items())))


def digest(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    name = lambda s: F.element_at(F.array(*(F.lit(k) for k in KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op3_secrets(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s["kind"] < 3)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["shared"])).cast("long").alias("n_shared"),
    )
