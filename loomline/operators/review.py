"""Reviews as corrections: rebuilt per author, saved as rows, laid over records and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.operators.overlay import correction_id

#: The targets that a review of a technique consists of.
REVIEW_TARGETS = ("verdict", "name", "parse.slots", "keyframe.sequence", "note")


def reviews(corrections: DataFrame, author: str | None = None) -> DataFrame:
    """One row per technique: its verdict and what else was said; the first active correction of a target counts.

    A technique without a verdict has no review.  With ``author`` only theirs is seen.
    """
    rows = corrections.filter(F.col("technique").isNotNull() & F.col("target").isin(*REVIEW_TARGETS) & (F.coalesce(F.col("status"), F.lit("")) != "retired"))
    if author is not None:
        rows = rows.filter(F.col("author") == author)
    said = rows.groupBy("technique").agg(*(F.min_by("payload", F.when(F.col("target") == t, F.col("seq"))).alias(t.replace(".", "_")) for t in REVIEW_TARGETS))
    return said.filter(F.col("verdict").isNotNull())


def review_rows(saved: DataFrame, techniques: DataFrame, author: str, date: str) -> DataFrame:
    """Reviews (technique, verdict, name, slots, keyframes, note) as corrections, one per target that is set.

    An unknown technique stops the query; empty values are none.
    """
    known = techniques.select(F.col("id").alias("technique"), F.lit(True).alias("__known"))
    checked = saved.join(known, "technique", "left")
    valid = F.when(F.col("__known").isNull(), F.raise_error(F.concat(F.lit("unknown technique "), F.col("technique")))).otherwise(F.col("technique"))
    values = (("verdict", "verdict"), ("name", "name"), ("parse.slots", "slots"), ("keyframe.sequence", "keyframes"), ("note", "note"))
    parts = F.array(*(F.struct(F.lit(t).alias("target"), F.nullif(F.col(c), F.lit("")).alias("payload")) for t, c in values))
    rows = checked.select(valid.alias("technique"), F.inline(F.filter(parts, lambda p: p["payload"].isNotNull())))
    made = correction_id(F.col("target"), F.lit(author), technique=F.col("technique"))
    return rows.select(made.alias("id"), F.lit("technique").alias("level"), "technique", "target", "payload", F.lit(author).alias("author"), F.lit(date).alias("date"), F.lit("provisional").alias("status"))


def corrected_blocks(blocks: DataFrame, corrections: DataFrame) -> DataFrame:
    """Text blocks (id, book, page, block, text, translation) with their latest corrected text and translation."""
    active = corrections.filter(F.coalesce(F.col("status"), F.lit("")) != "retired")
    won = active.groupBy("book", "page", "block").agg(*(
        F.max_by("payload", F.when(F.col("target") == target, F.struct("date", "seq"))).alias(name) for target, name in (("text.ocr", "__text"), ("text.translation", "__translation"))
    ))
    return blocks.join(won, ["book", "page", "block"], "left").select(
        *(c for c in blocks.columns if c not in ("text", "translation")), F.coalesce("__text", "text").alias("text"), F.coalesce("__translation", "translation").alias("translation"),
        (F.col("__text").isNotNull() | F.col("__translation").isNotNull()).alias("corrected"),
    )


def listing(corrections: DataFrame, **wanted: object) -> DataFrame:
    """Corrections of the given target, book, page or technique; what isn't given doesn't filter."""
    for column, value in wanted.items():
        if value is not None:
            corrections = corrections.filter(F.col(column) == value)
    return corrections.orderBy("seq")


def steps(techniques: DataFrame, keyframes: DataFrame) -> DataFrame:
    """Techniques with their keyframes in order; none is an empty list."""
    order = F.array_sort(F.collect_list(F.struct("step_index", "keyframe")))
    held = keyframes.select(F.col("technique").alias("id"), "step_index", F.col("id").alias("keyframe")).groupBy("id").agg(F.transform(order, lambda x: x["keyframe"]).alias("keyframes"))
    return techniques.join(held, "id", "left").withColumn("keyframes", F.coalesce("keyframes", F.expr("cast(array() as array<string>)")))


def chosen_regions(captions: DataFrame, regions: Column, links: Column) -> DataFrame:
    """Captions (page, at, caption) of pages whose links (caption_index, regions) are given; positions out of range are left out."""
    rows = captions.withColumns({"__l": F.filter(links, lambda x: x["caption_index"] == F.col("at")), "__r": regions})
    picked = F.flatten(F.transform("__l", lambda x: x["regions"]))
    return rows.filter(F.size("__l") > 0).withColumn("boxes", F.transform(F.filter(picked, lambda i: (i >= 0) & (i < F.size("__r"))), lambda i: F.get("__r", i))).drop("__l", "__r")


def sections_listed(seed: DataFrame, corrections: DataFrame, book: str) -> DataFrame:
    """What is said of a book's sections, in order: the seed's ranges, then corrections that aren't retired.

    seed (book, first, last, context, kind, weapon, form, note, seq); corrections (book,
    target, status, seq and others) of the target ``section``, each as one struct.
    """
    told = seed.filter(F.col("book") == book).select(F.lit("seed").alias("origin"), "seq", F.struct("first", "last", "context", "kind", "weapon", "form", "note").alias("section"))
    said = corrections.filter((F.col("book") == book) & (F.col("target") == "section") & ~F.col("status").eqNullSafe("retired"))
    said = said.select(F.lit("refinement").alias("origin"), "seq", F.struct(*(c for c in said.columns if c != "seq")).alias("refinement"))
    return told.unionByName(said, allowMissingColumns=True).orderBy(F.desc("origin"), "seq")
