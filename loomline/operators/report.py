"""Validation, coverage and review progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Rule = tuple[str, Column, str]


def errors(rules: list[Rule]) -> Column:
    """`path: message` of each rule (path, holds, message) that fails; a null result holds, as for an absent field."""
    return F.array_sort(F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(True)), f"{path}: {message}") for path, ok, message in rules))))


def required(c: str) -> Rule:
    return c, F.col(c).isNotNull(), "is required"


def one_of(c: str, *values: str) -> Rule:
    return c, F.col(c).isin(*values), "is not one of the values"


def matches(c: str, pattern: str) -> Rule:
    return c, F.col(c).rlike(pattern), "does not match"


def between(c: str, low: float, high: float) -> Rule:
    return c, F.col(c).between(low, high), "is out of range"


def at_least(c: str, n: int) -> Rule:
    """Of an array: so many items."""
    return c, F.size(c) >= n, f"has fewer than {n} items"


def date_format(c: str) -> Rule:
    return c, F.col(c).isNull() | (F.col(c).rlike(r"^\d{4}-\d{2}-\d{2}$") & F.to_date(F.try_to_timestamp(c, F.lit("yyyy-MM-dd"))).isNotNull()), "is no date"


def url_format(c: str) -> Rule:
    return c, F.col(c).isNull() | F.col(c).rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:\S+$"), "is no URL"


def validated(rows: DataFrame, key: str, rules: list[Rule], strict: bool = False) -> DataFrame:
    """Rows that fail, with their errors; strict raises at the first."""
    found = rows.select(key, errors(rules).alias("errors"))
    if strict:
        return found.select(key, F.when(F.size("errors") > 0, F.raise_error(F.array_join("errors", "; "))).otherwise(F.col("errors")).alias("errors"))
    return found.filter("size(errors) > 0")


def counts(collections: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, rows in collections.items():
        part = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("collection"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def year_span(dates: Column) -> list[Column]:
    year = F.substring(dates.cast("string"), 1, 4)
    return [F.min(year).alias("first_year"), F.max(year).alias("last_year"), F.count_distinct(year).alias("n_years")]


def have_missing(present: Column) -> list[Column]:
    held = F.coalesce(present, F.lit(False))
    return [F.count_if(held).alias("have"), F.count_if(~held).alias("missing")]


def contested(collections: list[tuple[str, DataFrame]]) -> DataFrame:
    """(collection, id) of rows whose confidence or status is contested, in the order given."""
    out = None
    for n, (name, rows) in enumerate(collections):
        parts = [F.coalesce(F.col(c) == "contested", F.lit(False)) for c in ("confidence", "status") if c in rows.columns]
        hit = parts[0]
        for p in parts[1:]:
            hit = hit | p
        part = rows.filter(hit).select(F.lit(n).alias("n"), F.lit(name).alias("collection"), "id")
        out = part if out is None else out.unionByName(part)
    return out


def progress(items: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """(total, reviewed, by verdict) of items with verdicts(key, verdict)."""
    joined = items.select(key).join(verdicts.select(key, "verdict"), key, "left")
    return joined.groupBy(F.coalesce("verdict", F.lit("unreviewed")).alias("verdict")).agg(F.count("*").alias("n"))


def next_unreviewed(items: DataFrame, verdicts: DataFrame, key: str, order: list[str], after: object) -> DataFrame:
    """The first item behind ``after`` without a verdict, else the first from the start; none if all have one."""
    open_items = items.join(verdicts.select(key), key, "left_anti")
    here = items.filter(F.col(key) == after).select(*(F.col(c).alias(f"__{c}") for c in order)).limit(1)
    marked = open_items.join(F.broadcast(here), F.lit(True), "left")
    behind = F.struct(*order) > F.struct(*(F.col(f"__{c}") for c in order))
    return marked.orderBy(F.coalesce(behind, F.lit(False)).desc(), *order).limit(1).select(*items.columns)


def reviewed(items: DataFrame, resolved: DataFrame, key: str, name: str) -> DataFrame:
    """Items with resolved (verdict, name, status) laid over; an empty correction leaves the original."""
    r = resolved.select(key, "verdict", F.col("name").alias("__n"))
    return items.join(r, key, "left").withColumn("original", F.col(name)).withColumn(name, F.coalesce(F.nullif(F.col("__n"), F.lit("")), F.col(name))).drop("__n").withColumn("verdict", F.coalesce("verdict", F.lit("unreviewed")))


def reviewed_records(techniques: DataFrame, said: DataFrame) -> DataFrame:
    """Techniques (id, name_romaji, name_native, slots, status) with what reviews say of them laid over.

    said(id, verdict, romaji, native, slots, sequence, note, author, date), one row per
    technique; slots are maps of lists.  Confirmed and corrected ones take a name that
    isn't empty, slots that aren't empty, the reviewed sequence and the status reviewed;
    rejected ones only their status; any other verdict changes nothing.
    """
    s = said.select("id", *(F.col(c).alias(f"__{c}") for c in said.columns if c != "id"))
    rows = techniques.join(s, "id", "left")
    good, bad = F.coalesce(F.col("__verdict").isin("confirmed", "corrected"), F.lit(False)), F.coalesce(F.col("__verdict") == "rejected", F.lit(False))
    over = lambda c, new: F.when(good, F.coalesce(F.nullif(F.col(new), F.lit("")), F.col(c))).otherwise(F.col(c))
    filled = F.map_filter("__slots", lambda k, v: F.coalesce(F.size(v), F.lit(0)) > 0)
    slots = F.when(good & F.col("__slots").isNotNull(), F.map_concat(F.map_filter("slots", lambda k, v: ~F.map_contains_key(filled, k)), filled)).otherwise(F.col("slots"))
    note = F.when(good, F.col("__note"))
    return rows.select(
        *(c for c in techniques.columns if c not in ("name_romaji", "name_native", "slots", "status")), over("name_romaji", "__romaji").alias("name_romaji"), over("name_native", "__native").alias("name_native"), slots.alias("slots"),
        F.when(good & (F.size("__sequence") > 0), F.col("__sequence")).alias("keyframes_reviewed"), F.when(good, "reviewed").when(bad, "rejected").otherwise(F.col("status")).alias("status"),
        F.when(good | bad, F.struct(F.col("__verdict").alias("verdict"), note.alias("note"), F.col("__author").alias("reviewed_by"), F.col("__date").alias("date"))).alias("review"),
    )


def updated_sites(dojos: DataFrame, found: DataFrame) -> DataFrame:
    """Known dojos with what their own sites say, found(id, instructors, chief, source): instructors and sources unite, a chief fills an empty one."""
    f = found.select("id", *(F.col(c).alias(f"__{c}") for c in ("instructors", "chief", "source")))
    none = F.array().cast("array<string>")
    both = lambda a, b: F.array_distinct(F.concat(F.coalesce(F.col(a), none), F.coalesce(b, none)))
    values = {
        "instructors": both("instructors", F.col("__instructors")), "source": both("source", F.when(F.col("__source").isNotNull(), F.array("__source"))),
        "chief_instructor": F.coalesce(F.nullif("chief_instructor", F.lit("")), F.nullif("__chief", F.lit("")), F.col("chief_instructor")),
    }
    return dojos.join(f, "id", "left").select(*(values.get(c, F.col(c)).alias(c) for c in dojos.columns))


def key_split(references: DataFrame, ref: str, known: DataFrame, key: str) -> DataFrame:
    """Distinct references with whether the known keys hold them."""
    held = known.select(F.col(key).alias(ref), F.lit(True).alias("present")).distinct()
    return references.select(ref).filter(F.col(ref).isNotNull()).distinct().join(held, ref, "left").withColumn("present", F.coalesce("present", F.lit(False)))


def filled_from(rows: DataFrame, source: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """Empty columns filled from matching rows of ``source``; rows without one stay."""
    s = source.select(*on, *(F.col(c).alias(f"__{c}") for c in columns))
    out = rows.join(s, on, "left")
    return out.withColumns({c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"__{c}")) for c in columns}).drop(*(f"__{c}" for c in columns))


def markdown(title: str, rows: DataFrame, limit: int = 25) -> str:
    """A report's table; at most ``limit`` rows reach the driver."""
    found = rows.limit(limit).collect()
    lines = [f"# {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in found]) + "\n"


def review_queue(problems: DataFrame, collections: list[tuple[str, DataFrame]], members: DataFrame) -> DataFrame:
    """(kind, id, detail) of what waits for a person: records that fail validation, contested ones, and clusters to merge.

    problems(id, errors); collections for ``contested``; members(cluster, tier, id,
    canonical).  A cluster's detail lists its members in order.
    """
    failed = problems.select(F.lit("validation").alias("kind"), F.col("id").cast("string").alias("id"), F.array_join("errors", "; ").alias("detail"))
    disputed = contested(collections).select(F.lit("contested").alias("kind"), F.col("id").cast("string").alias("id"), F.col("collection").alias("detail"))
    names = F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ", ")
    groups = members.groupBy("cluster", "tier").agg(names.alias("detail")).select(F.concat(F.lit("merge-"), F.col("tier")).alias("kind"), F.col("cluster").cast("string").alias("id"), "detail")
    return failed.unionByName(disputed).unionByName(groups)


def coverage_sections(collections: dict[str, DataFrame], pairs: DataFrame, members: DataFrame, problems: DataFrame, registry: DataFrame, most: int = 25) -> DataFrame:
    """The report's lines (part, a, b, line) in order of part, a, b.

    collections: persons, organizations, dojos, rank_events, tenures and edges; pairs of
    stays as ``copresence`` makes them; members of clusters; problems(id, errors);
    registry(at, name).  Of the clusters of each tier the first ``most`` are shown.
    """
    empty = F.lit("")
    counted = counts({n: c for n, c in collections.items()})
    order = {n: str(i) for i, n in enumerate(collections)}
    place = empty
    for n, i in order.items():
        place = F.when(F.col("collection") == n, i).otherwise(place)
    entities = counted.select(F.lit("1 Entity counts").alias("part"), place.alias("a"), empty.alias("b"), F.format_string("| %s | %d |", "collection", "n").alias("line"))
    years = collections["rank_events"].agg(*year_span(F.col("date")))
    backbone = years.select(F.lit("2 Promotions").alias("part"), empty.alias("a"), empty.alias("b"), F.concat(F.lit("Years captured: "), F.coalesce(F.format_string("%s-%s (%d)", "first_year", "last_year", "n_years"), F.lit("none"))).alias("line"))
    d = collections["dojos"]
    has = (F.coalesce(F.col("chief_instructor"), empty) != "") | (F.coalesce(F.size("instructors"), F.lit(0)) > 0)
    dojos = d.agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col("anchor"), F.lit(False))).alias("anchors"), *have_missing(has)).select(F.lit("3 Dojos").alias("part"), empty.alias("a"), empty.alias("b"), F.format_string("Total: %d (%d anchor), with instructors %d, without %d", "n", "anchors", "have", "missing").alias("line"))
    directional = F.col("direction").isNotNull()
    overlap = F.concat(F.col("lo").cast("string"), F.lit("-"), F.coalesce(F.col("hi").cast("string"), F.lit("ongoing")))
    summary = pairs.agg(F.count("*").alias("n"), F.count_if(directional).alias("d")).select(F.lit("4 Co-presence").alias("part"), empty.alias("a"), empty.alias("b"), F.format_string("Pairs: %d, directional %d, peers %d", "n", "d", F.col("n") - F.col("d")).alias("line"))
    each = pairs.select(F.lit("5 Pairs").alias("part"), F.col("dojo").cast("string").alias("a"), overlap.alias("b"), F.concat_ws(" | ", F.col("dojo").cast("string"), F.format_string("%s (%s)", F.col("a_person").cast("string"), "a_role"), F.format_string("%s (%s)", F.col("b_person").cast("string"), "b_role"), overlap, F.when(directional, "yes").otherwise("no")).alias("line"))
    sources = registry.select(F.lit("6 Sources").alias("part"), F.format_string("%09d", F.col("at").cast("long")).alias("a"), empty.alias("b"), F.concat(F.lit("- "), F.col("name")).alias("line"))
    groups = members.groupBy("cluster", "tier", "canonical").agg(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ", ").alias("m"))
    tiers = groups.groupBy("tier").agg(F.count("*").alias("n")).select(F.lit("7 Clusters").alias("part"), F.col("tier").alias("a"), empty.alias("b"), F.format_string("%s: %d", "tier", "n").alias("line"))
    # the clusters shown are bounded, and so is the window over each tier's candidates: a top-k per tier
    shown = groups.withColumn("k", F.row_number().over(W.partitionBy("tier").orderBy("cluster"))).filter(F.col("k") <= most)
    named = shown.select(F.lit("8 Clusters shown").alias("part"), F.col("tier").alias("a"), F.format_string("%09d", F.col("k").cast("long")).alias("b"), F.concat(F.col("tier"), F.lit(": "), F.col("m"), F.coalesce(F.concat(F.lit(" -> "), F.col("canonical").cast("string")), empty)).alias("line"))
    failed = problems.select(F.lit("9 Validation").alias("part"), F.col("id").cast("string").alias("a"), empty.alias("b"), F.concat(F.col("id").cast("string"), F.lit(": "), F.array_join("errors", "; ")).alias("line"))
    out = entities
    for part in (backbone, dojos, summary, each, sources, tiers, named, failed):
        out = out.unionByName(part)
    return out


def rollup(rows: DataFrame, by: str, page: str) -> DataFrame:
    """Counts and the span of pages per book; no page and page 0 don't count."""
    p = F.when(F.col(page) > 0, F.col(page))
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.count_distinct(p).alias("n_pages"), F.min(p).alias("first_page"), F.max(p).alias("last_page"))


def revisions(manifest: DataFrame, current: DataFrame, today: Column) -> DataFrame:
    """manifest(key, hash, rev, date) moved on by current(key, hash).

    A new key starts at 1, a changed hash adds one and takes today's date, an equal
    one stays; keys without a current text stay as they are.
    """
    m = manifest.select("key", F.col("hash").alias("__h"), "rev", "date")
    j = m.join(current.select("key", "hash"), "key", "full")
    changed = F.col("hash").isNotNull() & ~F.col("hash").eqNullSafe(F.col("__h"))
    return j.select(
        "key", F.coalesce("hash", "__h").alias("hash"), F.when(changed, F.coalesce(F.col("rev"), F.lit(0)) + 1).otherwise(F.col("rev")).cast("long").alias("rev"), F.when(changed, today).otherwise(F.col("date")).alias("date"),
    )


def listing(items: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    return items.withColumn("n", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
