"""Nested collections as flat tables, child tables and views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def child(rows: DataFrame, key: str, items: str, names: tuple[str, str], position: str | None = None) -> DataFrame:
    """One row per item of an array column, with its position if that has a name."""
    item = F.posexplode(items).alias(position, names[1]) if position else F.explode(items).alias(names[1])
    return rows.select(F.col(key).alias(names[0]), item)


def flattened(rows: DataFrame, structs: dict[str, tuple[str, tuple[str, ...]]], flags: tuple[str, ...] = ()) -> DataFrame:
    """Fields of struct columns {column: (prefix, fields)} as columns `prefix_field` in their place, booleans in ``flags`` as 0 and 1."""
    out = []
    for c in rows.columns:
        if c in structs:
            prefix, fields = structs[c]
            out += [F.col(c)[f].alias(f"{prefix}_{f}") for f in fields]
        else:
            out.append(F.col(c).cast("int").alias(c) if c in flags else F.col(c))
    return rows.select(*out)


def sources(collections: dict[str, DataFrame]) -> DataFrame:
    """(entity_type, entity_id, url) over all collections."""
    out = None
    for kind, rows in collections.items():
        part = rows.select(F.lit(kind).alias("entity_type"), F.col("id").alias("entity_id"), F.explode("source").alias("url"))
        out = part if out is None else out.unionByName(part)
    return out


def project(collections: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables of persons, organizations, dojos, rank_events, tenures and edges, and their child tables."""
    c = collections
    return {
        "persons": flattened(c["persons"].select("id", "name_romaji", "name_native", "born", "died", "deceased", "notes", "status", "retrieved", "current_rank"), {"current_rank": ("current_rank", ("dan", "title"))}, ("deceased",)),
        "organizations": c["organizations"].select("id", "name", "abbrev", "type", "lineage", "parent_org", "hq", "founded", "governance", "website", "status", "retrieved"),
        "dojos": flattened(c["dojos"].select("id", "name", "location", "chief_instructor", "founded", "anchor", "website", "status", "retrieved"), {"location": ("loc", ("city", "region", "country"))}, ("anchor",)),
        "rank_events": c["rank_events"].select("id", "person", "dan", "title", "date", "conferred_by", "via_org", "dojo", "retrieved"),
        "tenures": c["tenures"].select("id", "person", "dojo", "role", "start", "end", "confidence", "notes", "status", "retrieved"),
        "edges": c["edges"].select("id", "student", "teacher", "kind", "period", "confidence", "notes", "status", "retrieved"),
        "person_aliases": child(c["persons"], "id", "aliases", ("person_id", "alias")),
        "dojo_orgs": child(c["dojos"], "id", "org", ("dojo_id", "org_id")),
        "dojo_instructors": child(c["dojos"], "id", "instructors", ("dojo_id", "person_id")),
        "sources": sources(c),
    }


def lineage_view(edges: DataFrame, persons: DataFrame) -> DataFrame:
    s, t = persons.select(F.col("id").alias("student"), F.col("name_romaji").alias("student_name")), persons.select(F.col("id").alias("teacher"), F.col("name_romaji").alias("teacher_name"))
    return edges.join(s, "student").join(t, "teacher").select("id", F.col("student_name").alias("student"), F.col("teacher_name").alias("teacher"), "kind", "confidence", "period", "notes")


def promotions_view(events: DataFrame, persons: DataFrame, dojos: DataFrame) -> DataFrame:
    p, d = persons.select(F.col("id").alias("person"), F.col("name_romaji").alias("pn")), dojos.select(F.col("id").alias("dojo"), F.col("name").alias("dn"))
    return events.join(p, "person").join(d, "dojo", "left").select("id", F.col("pn").alias("person"), "dan", F.substring("date", 1, 4).alias("year"), F.col("dn").alias("dojo"))


def dojo_view(dojos: DataFrame, persons: DataFrame) -> DataFrame:
    p = persons.select(F.col("id").alias("chief_instructor"), F.col("name_romaji").alias("chief"))
    return dojos.join(p, "chief_instructor", "left").select("id", "name", "loc_city", "loc_region", "loc_country", F.col("chief").alias("chief_instructor"), "anchor", "website")


def tenure_view(tenures: DataFrame, persons: DataFrame, dojos: DataFrame) -> DataFrame:
    p, d = persons.select(F.col("id").alias("person"), F.col("name_romaji").alias("pn")), dojos.select(F.col("id").alias("dojo"), F.col("name").alias("dn"))
    return tenures.join(p, "person").join(d, "dojo").select("id", F.col("pn").alias("person"), F.col("dn").alias("dojo"), "role", "start", "end", "confidence")


def register_views(spark: SparkSession, tables: dict[str, DataFrame]) -> None:
    for name, table in tables.items():
        table.createOrReplaceTempView(name)
    lineage_view(tables["edges"], tables["persons"]).createOrReplaceTempView("v_lineage")
    promotions_view(tables["rank_events"], tables["persons"], tables["dojos"]).createOrReplaceTempView("v_promotions")
    dojo_view(tables["dojos"], tables["persons"]).createOrReplaceTempView("v_dojo")
    tenure_view(tables["tenures"], tables["persons"], tables["dojos"]).createOrReplaceTempView("v_tenure")


def filled(*choices: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in choices))
