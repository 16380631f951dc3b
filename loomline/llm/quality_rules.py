"""Quality by weak supervision.

Rules look at statistics of a document and vote for good, vote for bad or
abstain.  How far each can be believed isn't set by hand: the counts of all vote
patterns over the whole corpus (at most 3^rules rows, whatever its size) feed an
expectation-maximisation that estimates how often each rule votes which way on good
and on bad documents, and the share of good ones; an abstention says nothing.  A document's posterior
probability of being good then replaces an all-must-pass filter: it is kept from
0.5 on, unless it fails the base limits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.llm.texts import WordHashes, binary, carried, gram_hashes, handed_on
from loomline.storage import Scratch, bound_batches

SYMBOLS = b"#*$%&|<>"
STOP = frozenset(
    "the of and to in is that for it with as on by this are was be or an at from de la que el en los las del un una por con para se no es al"
    " le les des et est du dans qui une pour pas sur au der die das und den von zu mit ist ein nicht im eine auf dem sich auch".encode().split()
)

#: name, condition of a vote for good, condition of a vote for bad; neither: abstain.  Rules that know one kind of junk never vote for good.
RULES = (
    ("stop_words", "n_stop >= 0.08 * n_words", "n_stop < 0.02 * n_words and n_words >= 100"),
    ("sentences", "n_ends between 0.02 * n_words and 0.34 * n_words", "n_ends > 0.7 * n_words or n_ends < 0.004 * n_words and n_words >= 250"),
    ("word_length", "word_chars between 3.0 * n_words and 9.0 * n_words", "word_chars < 2.0 * n_words or word_chars > 14.0 * n_words"),
    ("symbols", "false", "n_symbols > 0.15 * n_words"),
    ("capitals", "false", "n_capitals > 0.3 * word_chars"),
    ("repeated_words", "false", "n_repeat_words > 0.3 * n_words"),
    ("duplicate_lines", "false", "n_dup_lines >= 3 and n_dup_lines > 0.3 * n_lines"),
    ("variety", "false", "n_distinct < 0.15 * n_words and n_distinct < 60"),
)
#: Belief before the data, worth PRIOR_SHARE of all documents: share of good ones, and how often good and bad ones get a vote for good and for bad.
PRIOR_GOOD, PRIOR_SHARE = 0.85, 0.02
PRIOR_UP, PRIOR_DOWN = (0.7, 0.5), (0.005, 0.3)
STATS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals", "n_ends", "n_stop", "n_distinct")


def statistics(text: bytes, memo: WordHashes) -> tuple[int, ...]:
    """STATS of one text; words are not lower-cased, and lines count if they have a word."""
    words = text.split()
    n = len(words)
    if not n:
        return 0, 0, len(text) - len(text.translate(None, SYMBOLS)), 0, 0, 0, 0, 0, 0, 0
    body = np.frombuffer(b"".join(words), np.uint8)
    lines = [x for x in text.split(b"\n") if x.strip()]
    h = memo.of(words)
    grams = gram_hashes(h, 3)
    repeated = 0
    if len(grams):
        _, back, counts = np.unique(grams, return_inverse=True, return_counts=True)
        covered = counts[back] > 1
        mask = np.zeros(n, bool)
        for i in range(3):
            mask[i : i + len(grams)] |= covered
        repeated = int(mask.sum())
    return (
        n, int(((body & 0xC0) != 0x80).sum()), len(text) - len(text.translate(None, SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeated,
        int(((body >= 65) & (body <= 90)).sum()), sum(w[-1] in b".!?" for w in words), sum(map(STOP.__contains__, text.lower().split())), len(np.unique(h)),
    )


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo = WordHashes()
    for batch in batches:
        found = [statistics(t or b"", memo) for t in binary(batch, "__text")]
        table = np.array(found, np.int64).reshape(-1, len(STATS))
        rest = [n for n in batch.schema.names if n != "__text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), *(pa.array(table[:, i]) for i in range(len(STATS)))], [*rest, *STATS])


Model = tuple[float, np.ndarray, np.ndarray]


def weights(share: float, up: np.ndarray, down: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-odds of being good: before any vote, added by a vote for good, by a vote for bad."""
    return float(np.log(share / (1 - share))), np.log(up[0] / up[1]), np.log(down[0] / down[1])


def posterior(votes: np.ndarray, model: Model) -> np.ndarray:
    start, up, down = weights(*model)
    return 1 / (1 + np.exp(-(start + (votes == 1) @ up + (votes == -1) @ down)))


def estimate(votes: np.ndarray, counts: np.ndarray, rounds: int = 200) -> Model:
    """(share of good, rates of votes for good, rates of votes for bad); rates are 2 x rules: of good, of bad documents.

    votes: patterns x rules of 1 good, -1 bad, 0 abstain; counts: rows of each pattern.
    """
    total = counts.sum()
    weight = PRIOR_SHARE * max(total, 1.0)
    good, bad = (votes == 1).astype(float), (votes == -1).astype(float)
    share, up, down = PRIOR_GOOD, *(np.repeat(np.array(p)[:, None], votes.shape[1], 1) for p in (PRIOR_UP, PRIOR_DOWN))
    for _ in range(rounds):
        p = posterior(votes, (share, up, down))
        was = np.concatenate([[share], up.ravel(), down.ravel()])
        share = (p @ counts + PRIOR_GOOD * weight) / (total + weight)
        for k, of in enumerate((p * counts, (1 - p) * counts)):
            up[k] = (of @ good + PRIOR_UP[k] * weight) / (of.sum() + weight)
            down[k] = (of @ bad + PRIOR_DOWN[k] * weight) / (of.sum() + weight)
        if np.abs(np.concatenate([[share], up.ravel(), down.ravel()]) - was).max() < 1e-9:
            break
    return float(share), up, down


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` to one row per row: id_col, row, STATS, base_failed, p_good, kept.

    row is a struct of the columns of ``keep``, if any, so their names can't clash.  A
    null or blank text has no words and fails the base limits, as does any text under
    50 words.  Very long texts are read whole, one at a time.  Ties at 0.5 are kept.
    Repeated rows are judged alike, each counts in the estimate.  An empty table gives
    an empty result.  Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    columns = [f"__v{i}" for i in range(len(RULES))]
    source = docs.select(*carried(id_col, keep), F.col(text_col).alias("__text"))
    schema = T.StructType([f for f in source.schema if f.name != "__text"] + [T.StructField(s, T.LongType()) for s in STATS])
    cast = (F.expr(f"case when n_words = 0 then 0 when {bad} then -1 when {good} then 1 else 0 end") for _, good, bad in RULES)
    # both passes read the written statistics, the first of them the votes alone
    voted = Scratch(spark).cut(source.mapInArrow(_stats, schema).select("*", *(v.alias(c) for v, c in zip(cast, columns))), "votes")
    patterns = voted.filter("n_words > 0").groupBy(*columns).count().orderBy(*columns).collect()
    table = np.array([list(r) for r in patterns], float).reshape(-1, len(RULES) + 1)
    start, up, down = weights(*estimate(table[:, :-1], table[:, -1]))
    odds = F.lit(start)
    for c, u, d in zip(columns, up.tolist(), down.tolist()):
        odds = odds + F.when(F.col(c) == 1, u).when(F.col(c) == -1, d).otherwise(0.0)
    failed = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    return voted.withColumn("p_good", 1 / (1 + F.exp(-odds))).select(
        *handed_on(id_col, keep), *STATS, failed.alias("base_failed"), "p_good", (~failed & (F.col("p_good") >= 0.5)).alias("kept"), *(F.col(c).alias(f"vote_{r[0]}") for c, r in zip(columns, RULES)),
    )


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    found = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")
