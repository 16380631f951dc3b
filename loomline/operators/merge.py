"""Ordered, idempotent merges by key.

A record's versions are folded in the order of ``seq`` by per-field rules.  Every
rule is an aggregate whose partial results combine, so versions are reduced before
the one shuffle by key; order lives in the aggregates' own keys.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.storage import Scratch

#: Strength of a statement; an unknown one is weakest.
STRENGTH = (("inferred", 0), ("stated", 1), ("contested", 2))


def strength(c: Column) -> Column:
    out = F.lit(-1)
    for name, rank in STRENGTH:
        out = F.when(c == name, rank).otherwise(out)
    return out


def union_in_order(value: Column, seq: Column) -> Column:
    """Distinct items of all arrays, in the order of their first appearance."""
    lists = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(seq.alias("s"), value.alias("v")))))
    return F.array_distinct(F.flatten(F.transform(lists, lambda x: x["v"])))


def united(rows: DataFrame, key: str | list[str], seq: Column, column: str) -> DataFrame:
    """``union_in_order`` of one column by key, for keys of any number of rows.

    Items are reduced to distinct ones with their first place before any list is
    built, so a list holds distinct items only.
    """
    keys = [key] if isinstance(key, str) else key
    name = column.replace(".", "__")
    items = rows.select(*keys, seq.alias("__s"), F.posexplode(F.col(column)).alias("__p", "__i"))
    first = items.groupBy(*keys, "__i").agg(F.min(F.struct("__s", "__p")).alias("__at"))
    return first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__at", "__i"))), lambda x: x["__i"]).alias(name))


def last_known(value: Column, seq: Column) -> Column:
    """The last value that isn't null; false and empty values count."""
    return F.max_by(value, F.when(value.isNotNull(), seq))


def first_known(value: Column, seq: Column) -> Column:
    return F.min_by(value, F.when(value.isNotNull(), seq))


def strongest(value: Column, seq: Column) -> Column:
    """The strongest statement, the earliest of equally strong ones."""
    return F.max_by(value, F.when(value.isNotNull(), F.struct(strength(value), -seq)))


#: Names of rules to aggregates of (value, seq).
RULES = {
    "union": union_in_order, "last": last_known, "first": first_known, "strongest": strongest,
    "max": lambda v, s: F.max(v), "min": lambda v, s: F.min(v), "any": lambda v, s: F.bool_or(v),
}


def merge_by_key(rows: DataFrame, key: str, seq: str, rules: Mapping[str, str]) -> DataFrame:
    """One row per key: each column of ``rules`` by its rule.  A dotted column is a field of a struct and is put back."""
    s = F.col(seq)
    plain = {c: rule for c, rule in rules.items() if rule != "union"}
    merged = rows.groupBy(key).agg(F.count("*").alias("__n"), *(RULES[rule](F.col(c), s).alias(c.replace(".", "__")) for c, rule in plain.items()))
    for c in rules.keys() - plain.keys():
        name = c.replace(".", "__")
        merged = merged.join(united(rows, key, s, c), key, "left").withColumn(name, F.coalesce(name, F.array().cast(rows.select(c).schema[0].dataType)))
    out, done = [F.col(key)], set()
    for c in rules:
        head = c.split(".")[0]
        if head in done:
            continue
        done.add(head)
        parts = [x for x in rules if x.split(".")[0] == head and "." in x]
        out.append(F.struct(*(F.col(x.replace(".", "__")).alias(x.split(".")[1]) for x in parts)).alias(head) if parts else F.col(head))
    return merged.select(*out)


def upsert(stored: DataFrame, incoming: DataFrame, key: str, seq: str, rules: Mapping[str, str]) -> DataFrame:
    """Incoming versions over stored ones, which come first."""
    both = stored.withColumn(seq, F.lit(-1).cast("long")).unionByName(incoming.withColumn(seq, F.col(seq).cast("long")), allowMissingColumns=True)
    return merge_by_key(both, key, seq, rules)


def keep_last(rows: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """Whole rows; the last of each key wins.  Tasks keep one row a key before the shuffle."""
    won = rows.groupBy(*key).agg(F.max_by(F.struct(*(c for c in rows.columns if c not in key)), F.struct(*order)).alias("__r"))
    return won.select(*(F.col(c) if c in key else F.col("__r")[c].alias(c) for c in rows.columns))


def keep_last_in_place(rows: DataFrame, key: list[str], order: str, place: str = "place") -> DataFrame:
    """The last row of each key, with the order of its first one in ``place``."""
    first = rows.groupBy(*key).agg(F.min(order).alias(place))
    return keep_last(rows, key, F.col(order)).join(first, key)


def keep_first(rows: DataFrame, key: list[str], *order: Column) -> DataFrame:
    won = rows.groupBy(*key).agg(F.min_by(F.struct(*(c for c in rows.columns if c not in key)), F.struct(*order)).alias("__r"))
    return won.select(*(F.col(c) if c in key else F.col("__r")[c].alias(c) for c in rows.columns))


def replace_partition(stored: DataFrame, fresh: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Rows of the keys that ``fresh`` has are dropped, fresh ones appended, the whole in order."""
    return stored.join(fresh.select(*keys).distinct(), keys, "left_anti").unionByName(fresh).orderBy(*order)


def absorb(clusters: DataFrame, persons: DataFrame, name: str = "name", fill: tuple[str, ...] = ("name_native", "born", "died", "notes", "current_rank")) -> DataFrame:
    """Persons folded into their cluster's canonical one.

    clusters(id, canonical); persons(id, name, aliases, source, retrieved, deceased and
    any others).  Aliases gain the other names, sorted and without the own one; sources
    unite with the canonical's first; the columns of ``fill`` are filled from the others,
    by id, only if empty; further columns stay the canonical's.  A cluster whose
    canonical isn't there stays as it is.
    """
    there = persons.select(F.col("id").alias("canonical"))
    joined = persons.join(clusters.join(there, "canonical", "left_semi").select("id", "canonical"), "id", "left").withColumn("canonical", F.coalesce("canonical", "id"))
    own = F.col("id") == F.col("canonical")
    rank = F.struct((~own).cast("int").alias("a"), F.col("id").alias("b"))
    empty = lambda c: F.col(c).isNull() | (F.col(c) == "") if persons.schema[c].dataType.typeName() == "string" else F.col(c).isNull()
    names = joined.select("canonical", F.explode(F.array_union(F.coalesce("aliases", F.array().cast("array<string>")), F.array(name))).alias("x")).groupBy("canonical").agg(F.array_sort(F.collect_set("x")).alias("n"))
    rules = {"retrieved": F.max("retrieved"), "deceased": F.bool_or("deceased")} | {c: F.min_by(c, F.when(~empty(c), rank)) for c in fill}
    plain = [c for c in persons.columns if c not in ("id", "aliases", "source")]
    rest = joined.groupBy("canonical").agg(*(rules.get(c, F.min_by(c, F.when(own, rank))).alias(c) for c in plain))
    out = rest.join(names, "canonical").join(united(joined, "canonical", rank, "source"), "canonical", "left")
    values = {"id": F.col("canonical"), "aliases": F.array_remove("n", F.col(name))}
    return out.select(*(values.get(c, F.col(c)).alias(c) for c in persons.columns))


def repoint(rows: DataFrame, mapping: DataFrame, columns: list[str], arrays: list[str] = ()) -> DataFrame:
    """Ids in ``columns`` (and in ``arrays`` of ids, then distinct) replaced by mapping(id, canonical)."""
    names = rows.columns
    for c in columns:
        m = mapping.select(F.col("id").alias(c), F.col("canonical").alias("__to"))
        rows = rows.join(m, c, "left").withColumn(c, F.coalesce("__to", c)).drop("__to")
    for c in arrays:
        rows = Scratch(rows.sparkSession).cut(rows.withColumn("__row", F.monotonically_increasing_id()), "rows")  # row numbers must not change between two reads
        m = mapping.select(F.col("id").alias("__item"), F.col("canonical").alias("__to"))
        items = rows.select("__row", F.posexplode(c).alias("__at", "__item")).join(m, "__item", "left")
        lists = items.groupBy("__row").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("__at", F.coalesce("__to", "__item").alias("v")))), lambda x: x["v"])).alias("__list"))
        rows = rows.join(lists, "__row", "left").withColumn(c, F.coalesce("__list", c)).drop("__list", "__row")
    return rows.select(*names)


def rekey(rows: DataFrame, mapping: DataFrame, columns: list[str], new_id: Column, rules: Mapping[str, str], order: str, drop: Column | None = None) -> DataFrame:
    """Records whose references in ``columns`` move get a new id; those that then share one are merged.

    new_id is made of the moved columns; rows that moved and for which ``drop`` holds
    (an edge from someone to themselves) go.  Under one id the record that stood there
    comes first, then the moved ones in ``order`` (a number), by ``rules``.
    """
    was = rows.select("*", *(F.col(c).alias(f"__was_{c}") for c in columns))
    moved = repoint(was, mapping, columns)
    changed = F.lit(False)
    for c in columns:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"__was_{c}"))
    moved = moved.withColumn("__changed", changed)
    if drop is not None:
        moved = moved.filter(~(F.col("__changed") & F.coalesce(drop, F.lit(False))))
    moved = moved.withColumn("id", F.when(F.col("__changed"), new_id).otherwise(F.col("id"))).withColumn("__seq", F.col("__changed").cast("long") * (1 << 50) + F.col(order))
    return merge_by_key(moved, "id", "__seq", rules)
