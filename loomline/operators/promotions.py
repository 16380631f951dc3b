"""Promotion lists of a year as persons, places and events of rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.scalars import entity_id, rank_id, year_date
from loomline.operators import lines


def listed(texts: DataFrame, key: str = "page") -> DataFrame:
    """``texts(key, text, ...)`` to the entries under headings: key, line_no, heading (shihan or a rank), name, place."""
    rows = lines.lines_of(texts, key, "text")
    found = lines.sectioned(rows, key, lines.heading_kind(F.col("line")), lines.entry_of(F.col("line")))
    return found.select(key, "line_no", "heading", F.col("entry.name").alias("name"), F.col("entry.place").alias("place"))


def promotions(texts: DataFrame, conferred_by: str, via_org: str, note: Column | None = None, key: str = "page") -> dict[str, DataFrame]:
    """Collections of ``texts(key, text, year, url, retrieved)``, one row per page and id.

    persons keep their first name and get ``note`` where they stand under the shihan
    heading; dojos keep their first name; of rank_events with one id the last counts;
    titles lists who stands under the shihan heading.
    """
    note = F.concat(F.lit("Shihan title conferred "), F.col("year").cast("string"), F.lit(".")) if note is None else note
    meta = texts.select(key, "year", F.array("url").alias("source"), "retrieved")
    rows = listed(texts, key).join(meta, key).withColumns({"person": entity_id("person", F.col("name")), "dojo": entity_id("dojo", F.col("place")), "__titled": F.col("heading") == "shihan"})
    rows = rows.withColumn("__note", F.when(F.col("__titled"), note))
    ranked = rows.filter(~F.col("__titled"))
    first = lambda c: F.min_by(c, "line_no").alias(c)
    shared = (F.first("source").alias("source"), F.first("retrieved").alias("retrieved"))
    persons = rows.groupBy(key, F.col("person").alias("id")).agg(F.min_by("name", "line_no").alias("name_romaji"), F.max_by("__note", F.when(F.col("__note").isNotNull(), F.col("line_no"))).alias("notes"), *shared).withColumn("status", F.lit("provisional"))
    dojos = ranked.groupBy(key, F.col("dojo").alias("id")).agg(F.min_by("place", "line_no").alias("name"), *shared).withColumns({"org": F.array(F.lit(via_org)), "status": F.lit("provisional")})
    date = year_date(F.col("year"))
    events = ranked.withColumns({"dan": F.col("heading").cast("int"), "date": date}).withColumn("id", rank_id(F.col("person"), F.col("date"), F.col("dan")))
    events = events.groupBy(key, "id").agg(first("person"), first("dan"), first("date"), F.max_by("dojo", "line_no").alias("dojo"), *shared)
    events = events.withColumns({"title": F.lit(None).cast("string"), "conferred_by": F.lit(conferred_by), "via_org": F.lit(via_org)})
    return {"persons": persons, "dojos": dojos, "rank_events": events, "titles": rows.filter("__titled").select(key, "line_no", "person")}
