"""Collections and pages as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.functions.scalars import cache_key
from loomline.operators.merge import keep_last, upsert

_PROVENANCE = "source array<string>, retrieved string"
SCHEMAS = {
    "person": f"id string, name_romaji string, name_native string, aliases array<string>, born string, died string, current_rank struct<dan:int,title:string>, deceased boolean, notes string, {_PROVENANCE}, status string",
    "organization": f"id string, name string, abbrev string, type string, lineage string, parent_org string, hq string, founded string, governance string, website string, {_PROVENANCE}, status string",
    "dojo": f"id string, name string, org array<string>, location struct<city:string,region:string,country:string>, chief_instructor string, instructors array<string>, founded string, anchor boolean, website string, {_PROVENANCE}, status string",
    "tenure": f"id string, person string, dojo string, role string, start string, `end` string, confidence string, notes string, {_PROVENANCE}, status string",
    "rank_event": f"id string, person string, dan int, title string, date string, conferred_by string, via_org string, dojo string, {_PROVENANCE}",
    "edge": f"id string, student string, teacher string, kind string, period string, confidence string, notes string, {_PROVENANCE}, status string",
    "ocr_word": "book string, page int, text string, conf double, `left` int, top int, width int, height int, line int, block int, par int",
    "section": "book string, first int, last int, context string, kind string, weapon string, form string, note string, seq int",
    "refinement": "id string, level string, book string, page int, first int, last int, sequence int, block int, technique string, target string, payload string, author string, basis string, confidence string, date string, note string, status string, seq bigint",
    "term": "id string, slug string, romaji string, kanji array<string>, kana array<string>, english string, category string, sources array<string>, status string, retrieved string",
    "kineme": "id string, label string, articulator string, action string, axes array<string>, magnitude_scale string, directions array<string>, signature string, crosswalk map<string,string>, aikido_terms array<string>, source string, status string",
}


#: Fixed values that a kineme has where its record says nothing.
KINEME_SOURCE, KINEME_STATUS = "AML seed (P1)", "provisional"


def schema(kind: str) -> T.StructType:
    return T._parse_datatype_string(SCHEMAS[kind])


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_collection(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A JSON array by id; a missing file is empty, of rows with one id the last wins."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema(kind))
    rows = spark.read.schema(schema(kind)).option("multiLine", True).json(path).filter("id is not null")
    return keep_last(rows.withColumn("__at", F.monotonically_increasing_id()), ["id"], F.col("__at")).drop("__at")


#: Seeds in the order in which they are laid over what is stored.
SEEDS = (("organizations", "organization"), ("persons", "person"), ("dojos", "dojo"), ("tenures", "tenure"))


def load_seeds(spark: SparkSession, folder: str, stored: dict[str, DataFrame], rules: dict[str, dict[str, str]]) -> dict[str, DataFrame]:
    """Stored collections with the seeds of a folder (`name.json`) laid over them by ``rules``, in the order of SEEDS; a missing file changes nothing."""
    out = dict(stored)
    for name, kind in SEEDS:
        rows = read_collection(spark, f"{folder}/{name}.json", kind).withColumn("seq", F.monotonically_increasing_id())
        base = out.get(name, spark.createDataFrame([], schema(kind)))
        out[name] = upsert(base.select("id", *rules[name]), rows.select("id", "seq", *rules[name]), "id", "seq", rules[name])
    return out


def since_today(rows: DataFrame, column: str = "retrieved") -> DataFrame:
    """Rows without a date get today's."""
    return rows.withColumn(column, F.coalesce(column, F.date_format(F.current_date(), "yyyy-MM-dd")))


def write_collection(rows: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Sorted by id; Spark's committer puts the files in place when all are written."""
    rows.orderBy("id").write.mode("overwrite").format(fmt).save(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).sortWithinPartitions("id").write.mode("overwrite").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, line) of text files, blank lines left out."""
    from loomline.operators.lines import lines_of

    files = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return lines_of(files, "path", "text")


def uncached(wanted: DataFrame, cache: DataFrame, refresh: bool = False) -> DataFrame:
    """URLs of ``wanted(url)`` that the cache(key, html) doesn't hold."""
    keyed = wanted.select("url").distinct().withColumn("key", cache_key(F.col("url")))
    return keyed if refresh else keyed.join(cache.select("key"), "key", "left_anti")


def discover_books(files: DataFrame, volumes: DataFrame) -> DataFrame:
    """Files (path) that end in .pdf with the first volume (token, seq, id) whose token their name holds."""
    name = F.lower(F.substring_index("path", "/", -1))
    pdfs = files.filter(name.endswith(".pdf")).withColumn("name", name)
    return pdfs.join(F.broadcast(volumes), F.col("name").contains(F.lower(F.col("token")))).groupBy("path").agg(F.min_by("id", "seq").alias("id"))


def page_images(spark: SparkSession, path: str) -> DataFrame:
    """PNG files below a folder, but for folders of the second level that start with an underscore."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.png").load(path)
    below = F.substring(F.col("path"), F.length(F.lit(path.rstrip("/"))) + F.instr("path", path.rstrip("/")) + 1, 1 << 20)
    return found.filter(~below.rlike("^[^/]+/_")).select("path", "length", "content")


def with_unsaved(saved: DataFrame, extra: DataFrame) -> DataFrame:
    """Stored rows, then unsaved ones behind them."""
    top = saved.agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("__top"))
    return saved.unionByName(extra.join(F.broadcast(top), F.lit(True)).withColumn("seq", F.col("seq") + F.col("__top") + 1).drop("__top"))


def kinemes(records: DataFrame) -> DataFrame:
    """Kinemes as read, with empty lists and crosswalk, source and status where a record has none."""
    none = {"directions": F.array().cast("array<string>"), "aikido_terms": F.array().cast("array<string>"), "crosswalk": F.create_map().cast("map<string,string>"), "source": F.lit(KINEME_SOURCE), "status": F.lit(KINEME_STATUS)}
    return records.withColumns({c: F.coalesce(c, v) for c, v in none.items()})
