"""Scoped corrections laid over records.

A correction has a target, a scope (a level and a selector, of which empty parts
match anything), a payload, a date and its place in the store.  What matches a
record is ordered from broad to narrow scope, then by date, then as stored.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.functions.scalars import slug
from loomline.operators.layout import aligned_cover

#: Levels from broad to narrow, and for each target its levels and how payloads combine.
LEVELS = ("process", "corpus", "book", "section", "page", "sequence", "technique")
TARGETS = (
    ("lexicon.entry", ("process", "corpus", "book"), "additive"),
    ("book.offset", ("book",), "override"),
    ("section", ("book",), "override"),
    ("region.ops", ("page", "sequence"), "compose"),
    ("caption", ("page", "sequence"), "override"),
    ("link.sequence", ("page",), "override"),
    ("name", ("technique",), "override"),
    ("parse.slots", ("technique",), "override"),
    ("keyframe.sequence", ("technique",), "override"),
    ("verdict", ("technique",), "override"),
    ("note", ("technique",), "override"),
    ("text.ocr", ("page",), "override"),
    ("text.translation", ("page",), "override"),
    ("glossary.term", ("process", "corpus", "book"), "additive"),
)


def level_rank(level: Column) -> Column:
    """0 is broadest; an unknown level is narrowest of all."""
    out = F.lit(99)
    for i, name in enumerate(LEVELS):
        out = F.when(level == name, i).otherwise(out)
    return out


def targets(spark) -> DataFrame:
    return spark.createDataFrame([(t, list(ls), m) for t, ls, m in TARGETS], "target string, levels array<string>, merge string")


def payload_key(target: Column, slot: Column | None = None, term: Column | None = None, op: Column | None = None, indices: Column | None = None) -> Column:
    """What tells corrections of one scope apart: the slot and term of an additive payload, the op and its indices of a compose one, else null.

    term is the payload's canonical form or, without one, its slot or its term.
    """
    none = F.lit(None).cast("string")
    text = lambda c: F.coalesce(c if c is not None else none, F.lit(""))
    kinds = {m: [t for t, _, merge in TARGETS if merge == m] for m in ("additive", "compose")}
    listed = text(F.concat_ws("-", F.transform(indices, lambda i: i.cast("string")))) if indices is not None else F.lit("")
    added = slug(F.concat_ws("-", text(slot), F.coalesce(F.nullif(text(term), F.lit("")), text(slot))))
    return F.nullif(F.when(target.isin(*kinds["additive"]), added).when(target.isin(*kinds["compose"]), slug(F.concat_ws("-", text(op), listed))), F.lit(""))


def correction_id(
    target: Column, author: Column, book: Column | None = None, pages: tuple[Column, Column] | None = None, page: Column | None = None, seq: Column | None = None,
    block: Column | None = None, technique: Column | None = None, key: Column | None = None,
) -> Column:
    """Stable id of a scope, target and author (and ``payload_key``); absent or null parts are left out."""
    parts = [target]
    if book is not None:
        parts.append(slug(book))
    if pages is not None:
        parts.append(F.concat(F.lit("p"), pages[0].cast("string"), F.lit("-"), pages[1].cast("string")))
    parts += [F.concat(F.lit(mark), c.cast("string")) for mark, c in (("p", page), ("s", seq), ("b", block)) if c is not None]
    if technique is not None:
        parts.append(slug(technique.cast("string")))
    if key is not None:
        parts.append(key)
    parts.append(slug(F.nullif(author, F.lit(""))))
    return F.concat(F.lit("ref:"), F.concat_ws(":", *parts))


def matching(units: DataFrame, corrections: DataFrame, equal: list[str], between: tuple[str, str, str] | None = None) -> DataFrame:
    """Active corrections of each unit with their ``rank``.

    ``equal``: columns that both sides have; a selector's null matches all, a unit's
    null only such a selector.  ``between``: (unit column, first, last of the
    selector), inclusive.  Corrections are split by which of their selectors are set,
    so each part is an equality join on just these and none compares all pairs; those
    that select by range alone meet the units in ``holding``.  A correction without any
    selector belongs to every unit.
    """
    active = corrections.filter(F.coalesce(F.col("status"), F.lit("")) != "retired").withColumn("rank", F.struct(level_rank(F.col("level")).alias("level"), F.col("date").alias("date"), F.col("seq").alias("seq")))
    keep = ["target", "payload", "rank", "author"]
    mask = F.concat(*(F.when(F.col(c).isNull(), "0").otherwise("1") for c in equal)) if equal else F.lit("")
    out = None
    for used in sorted(r[0] for r in active.select(mask).distinct().collect()):  # 2 ** len(equal) at most
        on = [c for c, bit in zip(equal, used) if bit == "1"]
        part = active.filter(mask == used).select(*keep, *on, *(between[1:] if between else ()))
        if between:
            at, first, last = between
            held = holding(units, part.filter(F.col(first).isNotNull()), on, at, first, last).drop(first, last)
            part = part.filter(F.col(first).isNull()).drop(first, last)
        joined = units.join(part, on) if on else units.join(part, F.lit(True))
        joined = joined.unionByName(held) if between else joined
        out = joined if out is None else out.unionByName(joined)
    return out if out is not None else units.join(active.select(*keep).limit(0), F.lit(True))


def holding(units: DataFrame, ranges: DataFrame, on: list[str], at: str, first: str, last: str, grown: bool = False) -> DataFrame:
    """``units`` with every one of the ``ranges`` (whole numbers, inclusive) of equal ``on`` that holds ``at``.

    A range is cut into aligned spans of two to the power of k, of which a position lies
    in one at most, and positions look up the span of each size: a join by equal keys.
    Where both sides grow (``grown``) neither is broadcast: files tell too small a size.
    """
    apart = lambda df: df.hint("merge") if grown else df
    none = F.col(first).isNotNull() & F.col(last).isNotNull() & (F.col(first) <= F.col(last))
    cut = ranges.filter(none).withColumns({"__f": F.col(first).cast("long"), "__l": F.col(last).cast("long")})
    cells = cut.withColumn("__c", F.explode(aligned_cover("__f", "__l + 1"))).withColumns({"__k": F.col("__c.k"), "__at": F.col("__c.at")}).drop("__c", "__f", "__l")
    top = cut.agg(F.expr("length(bin(max(__l - __f) + 1)) - 1").alias("__top")).filter("__top is not null")
    spots = units.select(*on, at).filter(F.col(at).isNotNull()).distinct().withColumn("__u", F.col(at).cast("long")).join(F.broadcast(top), F.lit(True))  # one row
    probes = spots.withColumn("__k", F.explode(F.sequence(F.lit(0), F.col("__top")))).withColumn("__at", F.expr("shiftright(__u, __k)")).drop("__u", "__top")
    return units.join(apart(probes.join(apart(cells), [*on, "__k", "__at"]).drop("__k", "__at")), [*on, at])


def override(matched: DataFrame, units: DataFrame, key: str, base: Column) -> DataFrame:
    """The narrowest and latest payload, else the base; a payload replaces it as a whole."""
    won = matched.groupBy(key).agg(F.max_by("payload", "rank").alias("payload"), F.count("*").alias("n_matching"))
    return units.join(won, key, "left").withColumn("value", F.coalesce("payload", base))


def composed(matched: DataFrame, key: str) -> DataFrame:
    """All payloads in order."""
    return matched.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "payload"))), lambda x: x["payload"]).alias("payloads"))


def additive(matched: DataFrame, units: DataFrame, key: str, base: Column, fold: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Array payloads added to an array base, each item once, in order; or put together by ``fold(value, payload)``."""
    if fold is not None:
        folded = F.when(F.col("payloads").isNotNull(), F.aggregate("payloads", F.col("__base"), fold)).otherwise(F.col("__base"))
        return units.withColumn("__base", base).join(composed(matched, key), key, "left").withColumn("value", folded).drop("__base")
    return units.join(composed(matched, key), key, "left").withColumn("value", F.array_distinct(F.concat(base, F.coalesce(F.flatten("payloads"), F.expr("cast(array() as array<string>)")))))


@F.pandas_udf(T.StringType())
def joined_payloads(base: pd.Series, payloads: pd.Series) -> pd.Series:
    """JSON objects put together in order: lists gain what they lack, objects are merged one level deep, anything else is replaced."""

    def one(start: str | None, more) -> str:
        out = json.loads(start) if start else {}
        for text in () if more is None else more:
            for k, v in (json.loads(text) if text else {}).items():
                old = out.get(k)
                if isinstance(v, list) and isinstance(old, list):
                    out[k] = old + [x for x in v if x not in old]
                else:
                    out[k] = old | v if isinstance(v, dict) and isinstance(old, dict) else v
        return json.dumps(out, ensure_ascii=False)

    return pd.Series([one(b, p) for b, p in zip(base, payloads)])


def joined_variants(base: Column, payloads: Column) -> Column:
    """``joined_payloads`` without Python: JSON objects put together in order as VARIANT, as JSON text with its keys in order.

    A null base or payload is an empty object; values are equal if their JSON is.
    """
    kind = "map<string,variant>"
    opened = lambda c: F.coalesce(F.parse_json(F.coalesce(F.nullif(c, F.lit("")), F.lit("{}"))).cast(kind), F.expr(f"cast(map() as {kind})"))
    starts = lambda v, what: F.schema_of_variant(v).startswith(what)

    def lists(a: Column, b: Column) -> Column:
        old, new = a.cast("array<variant>"), b.cast("array<variant>")
        return F.to_variant_object(F.concat(old, F.filter(new, lambda x: ~F.exists(old, lambda y: F.to_json(y) == F.to_json(x)))))

    def objects(a: Column, b: Column) -> Column:
        return F.to_variant_object(F.map_zip_with(a.cast(kind), b.cast(kind), lambda k, x, y: F.coalesce(y, x)))

    def both(_: Column, a: Column, b: Column) -> Column:
        return (
            F.when(b.isNull(), a).when(a.isNull(), b).when(starts(a, "ARRAY") & starts(b, "ARRAY"), lists(a, b)).when(starts(a, "OBJECT") & starts(b, "OBJECT"), objects(a, b)).otherwise(b)
        )

    given = F.coalesce(payloads, F.array().cast("array<string>"))
    return F.to_json(F.to_variant_object(F.aggregate(given, opened(base), lambda acc, p: F.map_zip_with(acc, opened(p), both))))


def range_lookup(units: DataFrame, ranges: DataFrame, on: list[str], at: str, first: str = "first", last: str = "last", order: str = "seq", grown: bool = False) -> DataFrame:
    """``units`` with the earliest of the ``ranges`` that hold ``at``; rows without one keep nulls.

    Units are reduced to distinct positions before the join and get the result back by equality.
    """
    fields = [c for c in ranges.columns if c not in (*on, first, last)]
    held = holding(units.select(*on, at).distinct(), ranges, on, at, first, last, grown)
    found = held.groupBy(*on, at).agg(F.min_by(F.struct(*fields), order).alias("found"))
    return units.join(found.hint("merge") if grown else found, [*on, at], "left").select(*units.columns, *(F.col(f"found.{c}").alias(c) for c in fields if c != order))


def confirmed(stored: DataFrame, ids: DataFrame) -> DataFrame:
    """Corrections of ``ids(id)`` confirmed; an unknown id changes nothing."""
    named = ids.select("id").distinct().withColumn("__named", F.lit(True))
    return stored.join(named, "id", "left").withColumn("status", F.when(F.col("__named"), "confirmed").otherwise(F.col("status"))).select(*stored.columns)


def removed(stored: DataFrame, ids: DataFrame) -> DataFrame:
    return stored.join(ids.select("id"), "id", "left_anti").select(*stored.columns)


def upsert_corrections(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """By id; a replaced correction moves to the end."""
    from loomline.operators.merge import keep_last

    top = stored.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("__top"))
    moved = incoming.join(F.broadcast(top), F.lit(True)).withColumn("seq", F.col("seq") + F.col("__top") + 1).drop("__top")
    return keep_last(stored.unionByName(moved), ["id"], F.col("seq"))


BOXES = "array<struct<x:int,y:int,w:int,h:int,kind:string>>"


def by_column(boxes: Column) -> Column:
    return F.transform(F.array_sort(F.transform(boxes, lambda b, i: F.struct(b["x"].alias("x"), b["y"].alias("y"), i.alias("i"), b.alias("b")))), lambda s: s["b"]).cast(BOXES)


def by_rows(boxes: Column) -> Column:
    """Reading order: from the top, a box joins the first row whose first box's top is within 0.6 of the middle height; rows from the left."""
    slack = F.get(F.array_sort(F.transform(boxes, lambda b: b["h"])), F.floor(F.size(boxes) / 2).cast("int")) * F.lit(0.6)
    down = F.array_sort(F.transform(boxes, lambda b, i: F.struct(b["y"].alias("y"), i.alias("i"), b.alias("b"))))

    def place(rows: Column, s: Column) -> Column:
        fits = F.transform(rows, lambda r: F.abs(r["top"] - s["y"]) <= slack)
        at = F.coalesce(F.array_position(fits, True), F.lit(0))
        one = F.array(F.struct(s["b"]["x"].alias("x"), F.size(rows).cast("int").alias("n"), s["i"].alias("i"), s["b"].alias("b")))
        return F.when(at == 0, F.concat(rows, F.array(F.struct(s["y"].alias("top"), one.alias("boxes"))))).otherwise(
            F.transform(rows, lambda r, i: F.when(i + 1 == at, F.struct(r["top"].alias("top"), F.concat(r["boxes"], F.transform(one, lambda x: x.withField("n", F.size(r["boxes"])))).alias("boxes"))).otherwise(r))
        )

    kind = "struct<x:int,y:int,w:int,h:int,kind:string>"
    start = F.array().cast(f"array<struct<top:int,boxes:array<struct<x:int,n:int,i:int,b:{kind}>>>>")
    return F.flatten(F.transform(F.aggregate(down, start, place), lambda r: F.transform(F.array_sort(r["boxes"]), lambda s: s["b"]))).cast(BOXES)


def region_ops(regions: Column, ops: Column) -> Column:
    """Applies ordered operations to an array of boxes (x, y, w, h, kind).

    ops: structs of op (manual, drop, merge, order), idx (positions), boxes (x, y, w, h)
    and by.  manual replaces all boxes by photos; drop removes positions; merge puts the
    union of two or more boxes last, as a row, and removes them, if all are there; order
    sorts by column, or else into reading order.
    """

    def union(boxes: Column) -> Column:
        x, y = F.array_min(F.transform(boxes, lambda b: b["x"])), F.array_min(F.transform(boxes, lambda b: b["y"]))
        right, low = F.array_max(F.transform(boxes, lambda b: b["x"] + b["w"])), F.array_max(F.transform(boxes, lambda b: b["y"] + b["h"]))
        return F.struct(x.alias("x"), y.alias("y"), (right - x).alias("w"), (low - y).alias("h"), F.lit("row").alias("kind"))

    def step(now: Column, op: Column) -> Column:
        named = F.filter(now, lambda b, i: F.array_contains(op["idx"], i))
        others = F.filter(now, lambda b, i: ~F.array_contains(op["idx"], i))
        photos = F.transform(op["boxes"], lambda b: F.struct(b["x"].alias("x"), b["y"].alias("y"), b["w"].alias("w"), b["h"].alias("h"), F.lit("photo").alias("kind")))
        whole = (F.size(op["idx"]) >= 2) & (F.array_max(op["idx"]) < F.size(now)) & (F.array_min(op["idx"]) >= 0)
        return (
            F.when(op["op"] == "manual", photos).when(op["op"] == "drop", others).when((op["op"] == "merge") & whole, F.concat(others, F.array(union(named))))
            .when((op["op"] == "order") & (op["by"] == "column"), by_column(now)).when(op["op"] == "order", by_rows(now)).otherwise(now).cast(BOXES)
        )

    return F.aggregate(ops, regions.cast(BOXES), step)


def forced_caption(captions: Column, forced: Column, suppress: Column) -> Column:
    """A forced caption instead of the found ones, or after them if they aren't to be suppressed."""
    return F.when(forced.isNull(), captions).when(F.coalesce(suppress, F.lit(True)), F.array(forced)).otherwise(F.concat(captions, F.array(forced)))
