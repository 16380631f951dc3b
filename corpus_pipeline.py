"""A cleaning run over ``documents``: judged, deduplicated, decontaminated, rid of secrets, packed.

Each stage takes what the one before it kept, as Parquet, and its decisions take
effect.  All but the last return the columns of ``documents`` and any others that the
table has, whatever their names.  Null and blank texts are no documents of quality and
go in the first stage; behind it they would stay.  Rows are judged one by one, so ids
may repeat or be null: near-duplicates leave one row of each group.  Very long texts
are read whole.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.llm.minhash import near_duplicates
from loomline.llm.packing import pack_documents
from loomline.llm.quality_rules import judge
from loomline.llm.secrets import redact
from loomline.llm.winnowing import decontaminate
from loomline.storage import Scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose rules' posterior is for good; those that fail the base limits go too."""
    return judge(docs, keep=tuple(docs.columns)).filter("kept").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: of the smallest id, one without an id only if none has any.

    Where every row has an integer id of its own, groups are made of the ids.  Else rows
    are numbered in the order of their ids, and groups are made of these numbers.
    """
    whole = isinstance(docs.schema["doc_id"].dataType, T.IntegralType)
    if whole and docs.groupBy("doc_id").count().filter("doc_id is null or count > 1").isEmpty():
        kept = near_duplicates(docs).filter("kept").select("doc_id")
        # a task holds its share of the ids, so the texts aren't sorted
        return docs.join(kept.hint("shuffle_hash"), "doc_id", "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))
    order = (F.col("doc_id").asc_nulls_last(), F.xxhash64("text"))
    numbered = docs.orderBy(*order).select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("number"))
    rows = Scratch(spark).cut(numbered, "rows")
    kept = near_duplicates(rows.select("number", "row.text"), "number").filter("kept").select("number")
    return rows.join(kept, "number", "left_semi").select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=tuple(docs.columns))
    return found.filter("size(items) = 0").select("row.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark; n_chars follows."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens, with their token ids."""
    return pack_documents(docs)


STAGES = [("quality_rules", quality), ("minhash_dedup", near_dedup), ("decontamination", decontamination), ("secrets", secrets), ("packing", packing)]

#: The stages learn from the corpus and tokenize; SQL doesn't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole of ``documents``."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.cut(docs, name)
    return docs
