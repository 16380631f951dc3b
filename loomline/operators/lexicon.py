"""Classification of titles by a lexicon, and the predicates that tell titles from prose."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.functions import vocabulary as V
from loomline.functions.scalars import fold, slug, squeezed
from loomline.operators.merge import first_known, union_in_order
from loomline.storage import Scratch, bound_batches

SLOTS = ("technique", "attack", "direction", "form")
Entry = tuple[str, str, str]
#: Spellings of one automaton.
SPELLINGS = 50_000


def seed() -> tuple[list[Entry], list[Entry]]:
    """(spelling, slot, name) for kanji and for folded spellings."""
    kanji = [(k, slot, name) for slot, names in V.KANJI.items() for name, ks in names.items() for k in ks]
    latin = [(re.sub("[^a-z0-9]", "", s), slot, name) for slot, names in V.SPELLINGS.items() for name, more in names.items() for s in [name, *more]]
    return kanji, latin


def taught(entries: list[Entry], corrections: list[dict], kanji: bool) -> list[Entry]:
    """Entries with those of corrections {slot, canonical, variants, kanji}, slot by slot and name by name; a name's taught spellings are sorted."""
    names: dict[tuple[str, str], list[str]] = {}
    for s, slot, name in entries:
        names.setdefault((slot, name), []).append(s)
    for c in corrections:
        own = names.setdefault((c["slot"], c["canonical"]), [])
        if kanji:
            own += [s for s in c.get("kanji") or [] if s not in own]
        else:
            bare = [re.sub("[^a-z0-9]", "", v.lower()) for v in [c["canonical"], *(c.get("variants") or [])]]
            own[:] = [bare[0], *sorted({*own, *bare} - {bare[0]})]
    slots = list(dict.fromkeys(slot for slot, _ in names))
    return [(s, slot, name) for slot in slots for (of, name), spellings in names.items() if of == slot for s in spellings]


def taught_by(corrections: DataFrame) -> tuple[list[Entry], list[Entry]]:
    """The seed's entries (kanji, folded) with a table's corrections (slot, canonical, variants, kanji, seq), in the order of seq.

    The table is counted first: beyond SPELLINGS taught spellings ``classify_by`` is the way.
    """
    size = corrections.agg(F.sum(1 + F.coalesce(F.size("variants"), F.lit(0)) + F.coalesce(F.size("kanji"), F.lit(0)))).first()[0] or 0
    if size > SPELLINGS:
        raise ValueError(f"{size} taught spellings; one automaton holds {SPELLINGS}, classify_by takes more")
    rows = [r.asDict() for r in corrections.filter("slot is not null and slot <> '' and canonical is not null and canonical <> ''").orderBy("seq").collect()]
    kanji, latin = seed()
    return taught(kanji, rows, True), taught(latin, [r for r in rows if r["slot"] in SLOTS], False)


_BARE = bytes(c for c in range(128) if not (48 <= c < 58 or 97 <= c < 123))


def _tight(text: str) -> str:
    return "".join(text.split())


def _squeezed(text: str) -> str:
    """Folded, a-z0-9 only."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).lower()
    return text.lower().encode("ascii", "ignore").translate(None, _BARE).decode()


class Consumer:
    """Names that a text holds, in the order found.

    Entries go longest first.  One that occurs, and whose name isn't found yet, blots
    itself out, so a part of it isn't found again.  An automaton tells which spellings
    occur at all; blotting out brings up no other, so only these are gone through.
    """

    def __init__(self, entries: list[Entry]):
        self.entries = sorted((e for e in entries if e[0]), key=lambda e: -len(e[0]))
        self.automaton = ahocorasick.Automaton()
        by_spelling: dict[str, list[int]] = {}
        for i, (s, _, _) in enumerate(self.entries):
            by_spelling.setdefault(s, []).append(i)
        for s, at in by_spelling.items():
            self.automaton.add_word(s, at)
        #: entries that hold the mark itself could come up
        self.always = [i for i, (s, _, _) in enumerate(self.entries) if "·" in s]
        if self.entries:
            self.automaton.make_automaton()

    def into(self, hay: str, found: list[tuple[str, str]]) -> None:
        if not self.entries or not hay:
            return
        met = {i for _, at in self.automaton.iter(hay) for i in at}
        if not met:
            return
        for i in sorted(met.union(self.always)):
            s, slot, name = self.entries[i]
            if s in hay and (slot, name) not in found:
                found.append((slot, name))
                hay = hay.replace(s, "·")


_FOUND = T.StructType([T.StructField(s, T.ArrayType(T.StringType())) for s in SLOTS])


def _slotted(found: list[list[tuple[str, str]] | None]) -> pa.StructArray:
    """One struct of lists for each text; null for a null text."""
    columns = []
    for slot in SLOTS:
        ends, flat = [0], []
        for pairs in found:
            if pairs:
                flat += [name for s, name in pairs if s == slot]
            ends.append(len(flat))
        columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.string())))
    return pa.StructArray.from_arrays(columns, list(SLOTS), mask=pa.array([f is None for f in found], pa.bool_()))


#: Consumers of a worker process, by their entries.
_CONSUMERS: dict[tuple, tuple[Consumer, Consumer]] = {}


def classify(text: Column, kanji: list[Entry] | None = None, latin: list[Entry] | None = None) -> Column:
    """Names per slot that a text holds, as a struct of arrays in the order found; null for a null text.

    Kanji spellings are sought in the text without white space, then Latin ones in its
    folded letters and digits.  Longer spellings go first and are blotted out once
    their name is found, so that a part of them is not found again; a name found
    already blots out nothing.  One automaton a script finds the spellings that occur.
    """
    own = seed()
    key = (tuple(own[0] if kanji is None else kanji), tuple(own[1] if latin is None else latin))

    def run(texts: pa.Array) -> pa.Array:
        if key not in _CONSUMERS:
            _CONSUMERS[key] = (Consumer(list(key[0])), Consumer(list(key[1])))
        first, second = _CONSUMERS[key]
        out: list[list[tuple[str, str]] | None] = []
        for t in texts.to_pylist():
            found: list[tuple[str, str]] | None = None if t is None else []
            if t:
                first.into(_tight(t), found)
                second.into(_squeezed(t), found)
            out.append(found)
        return _slotted(out)

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, _FOUND)(text)


def classify_by(texts: DataFrame, key: str, text: str, entries: DataFrame) -> DataFrame:
    """``texts`` with ``found`` as ``classify`` gives it, by a table of entries (spelling, slot, name, latin, seq) of any size.

    seq is the order of entries of one length.  Up to SPELLINGS entries are one
    lexicon; more are dealt into automata, which find the entries that a text holds,
    and each text consumes those.  Keys are expected to be unique.
    """
    spark = texts.sparkSession
    bound_batches(spark)
    sound = entries.filter("spelling <> ''").select("spelling", "slot", "name", F.coalesce("latin", F.lit(False)).alias("latin"), "seq")
    if sound.count() <= SPELLINGS:
        rows = sound.orderBy("seq").collect()
        kanji, latin = ([(r["spelling"], r["slot"], r["name"]) for r in rows if r["latin"] == side] for side in (False, True))
        return texts.withColumn("found", classify(F.col(text), kanji, latin))
    spelled = sound.select("latin", "spelling").distinct().withColumn("kanji", F.concat(F.when(F.col("latin"), "l").otherwise("k"), "spelling")).select(F.col("kanji").alias("term"), F.col("spelling").alias("kanji"), "latin")
    hays = texts.select(F.col(key).alias("key"), F.regexp_replace(F.col(text), r"(?U)\s+", "").alias("k"), squeezed(F.col(text)).alias("l"))
    met = None
    for side, hay in ((False, "k"), (True, "l")):
        one = retrieve_terms(hays, "key", hay, spelled.filter(F.col("latin") == side).drop("latin")).select("key", F.col("kanji").alias("spelling"), F.lit(side).alias("latin"))
        met = one if met is None else met.unionByName(one)
    held = met.join(sound, ["spelling", "latin"]).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("seq", "latin", "spelling", "slot", "name"))).alias("__e"))

    def run(values: pa.Array, entries: pa.Array) -> pa.Array:
        out: list[list[tuple[str, str]] | None] = []
        for t, es in zip(values.to_pylist(), entries.to_pylist()):
            found: list[tuple[str, str]] | None = None if t is None else []
            for latin, hay in ((False, _tight), (True, _squeezed)):
                if t and es:
                    Consumer([(e["spelling"], e["slot"], e["name"]) for e in es if e["latin"] == latin]).into(hay(t), found)
            out.append(found)
        return _slotted(out)

    run.__annotations__ = {"values": pa.Array, "entries": pa.Array, "return": pa.Array}
    return texts.join(held, texts[key] == held["key"], "left").drop(held["key"]).withColumn("found", F.arrow_udf(run, _FOUND)(F.col(text), F.col("__e"))).drop("__e")


def is_prose(line: Column) -> Column:
    words = F.regexp_extract_all(line, F.lit("([A-Za-z][A-Za-z'’-]*)"))
    tight = F.regexp_replace(line, r"(?U)\s+", "")
    marks = "|".join(map(re.escape, V.PROSE_MARKS))
    return (
        F.lower(line).contains("refer") | (F.size(words) > 6) | F.arrays_overlap(F.transform(words, F.lower), F.array(*map(F.lit, V.PROSE))) | tight.rlike(marks)
        | (tight.rlike("[「」]") & (F.length(tight) > 6)) | (F.regexp_count(tight, F.lit("[぀-ヿ一-鿿]")) > 14)
    )


def is_caption(line: Column, found: Column | None = None) -> Column:
    """Whether a line names a technique or an attack and isn't prose; ``found`` is its classification, if there is one already."""
    found = classify(line) if found is None else found
    return ~is_prose(line) & ((F.size(found["technique"]) > 0) | (F.size(found["attack"]) > 0))


def is_section_header(line: Column) -> Column:
    tight = F.regexp_replace(line, r"(?U)\s+", "")
    return tight.contains("の部") & (F.length(tight) <= 10)


#: The pattern of a bracketed number.
NUMBER = r"[(\[（【]\s*(\d{1,2})\s*[)\]）】]"


def is_weapon_caption(line: Column) -> Column:
    tight = F.regexp_replace(line, r"(?U)\s+", "")
    few = (F.regexp_count(tight, F.lit("[ぁ-ゟ]")) < 4) & (F.regexp_count(tight, F.lit("[぀-ヿ一-鿿々]")) <= 8)
    word = tight.rlike("|".join(V.MOVEMENTS)) | squeezed(line).rlike("|".join(V.MOVEMENT_WORDS))
    return ~is_section_header(line) & ~is_prose(line) & few & (word | line.rlike(NUMBER))


def caption_slug(name: Column, qualifiers: Column, attack: Column, technique: Column, direction: Column, form: Column) -> Column:
    """From the name and qualifiers, else from the slots, else ``technique``."""
    base = slug(fold(F.concat_ws(" ", name, F.array_join(qualifiers, " "))))
    slots = slug(F.concat_ws("-", attack, technique, direction, F.array_join(form, "-")))
    return F.coalesce(F.nullif(base, F.lit("")), F.nullif(slots, F.lit("")), F.lit("technique"))


def parse_caption(line: Column, found: Column | None = None) -> Column:
    """Name without qualifiers, the qualifiers in parentheses, the first name per slot and all forms."""
    found = classify(line) if found is None else found
    name = F.regexp_replace(F.regexp_replace(line, r"\([^)]*\)", ""), "^[ .,-]+|[ .,-]+$", "")
    quals = F.filter(F.transform(F.regexp_extract_all(line, F.lit(r"\(([^)]*)\)")), lambda x: F.trim(x)), lambda q: q != "")
    first = lambda s: F.get(found[s], 0)
    fields = {"technique": first("technique"), "attack": first("attack"), "direction": first("direction"), "form": found["form"]}
    own = caption_slug(name, quals, fields["attack"], fields["technique"], fields["direction"], fields["form"])
    return F.struct(name.alias("name"), quals.alias("qualifiers"), *(c.alias(n) for n, c in fields.items()), own.alias("slug"))


def parse_weapon_caption(line: Column) -> Column:
    runs = F.regexp_extract_all(F.regexp_replace(line, r"(?U)\s+", ""), F.lit("([぀-ヿ㐀-鿿々]+)"))
    longest = F.element_at(F.filter(runs, lambda r: F.length(r) == F.array_max(F.transform(runs, F.length))), 1)
    number = F.regexp_extract(line, NUMBER, 1)
    raw = F.trim(F.regexp_replace(line, r"(?U)\s+", " "))
    return F.struct(
        F.when(line.rlike("[A-Za-z]"), F.regexp_replace(raw, "^[ .,-]+|[ .,-]+$", "")).otherwise("").alias("name"), F.when(number != "", number).alias("number"),
        F.when(F.size(runs) > 0, longest).alias("native"), raw.alias("raw"),
    )


def _finder(rows):
    """(key, term, kanji) of the spellings that each text holds, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for term, kanji in rows.value:
            automaton.add_word(kanji, (term, kanji))
        automaton.make_automaton()
        for batch in batches:
            at, found = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                hits = {hit for _, hit in automaton.iter(text)} if text else ()
                at += [i] * len(hits)
                found += hits
            terms = pa.array([t for t, _ in found], batch.schema.field("kind").type)
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(at, pa.int64())), terms, pa.array([k for _, k in found], pa.string())], ["key", "term", "kanji"])

    return run


def retrieve_terms(texts: DataFrame, key: str, text: str, terms: DataFrame) -> DataFrame:
    """Terms (term, kanji) whose spelling a text holds, once per spelling, longest first.

    The spellings are dealt into automata of at most SPELLINGS; every text streams
    through each where it lies, so a glossary of any size takes one scan for each.
    """
    spark = texts.sparkSession
    bound_batches(spark)
    known = Scratch(spark).cut(terms.filter("kanji <> ''").groupBy("kanji").agg(F.min("term").alias("term")), "spellings")
    parts = max(1, -(-known.count() // SPELLINGS))
    # a bound on each part, since hashes don't deal evenly
    parts = parts if parts == 1 else 2 * parts
    kinds = {"key": texts.schema[key].dataType, "term": known.schema["term"].dataType}
    schema = T.StructType([T.StructField("key", kinds["key"]), T.StructField("term", kinds["term"]), T.StructField("kanji", T.StringType())])
    source = texts.select(F.col(key).alias("key"), F.col(text).alias("text"), F.lit(None).cast(kinds["term"]).alias("kind"))
    out = None
    for i in range(parts):
        rows = [(r["term"], r["kanji"]) for r in known.filter(F.pmod(F.xxhash64("kanji"), F.lit(parts)) == i).collect()]
        if rows:
            found = source.mapInArrow(_finder(spark.sparkContext.broadcast(rows)), schema)
            out = found if out is None else out.unionByName(found)
    out = spark.createDataFrame([], schema) if out is None else out
    return out.withColumn("n", F.row_number().over(W.partitionBy("key").orderBy(-F.length("kanji"), "kanji"))).withColumnRenamed("key", key)


def prompt(text: Column, terms: Column) -> Column:
    """Glossary lines, then the text to translate."""
    return F.concat(F.when(F.size(terms) > 0, F.concat(F.lit("Use these terms:\n"), F.array_join(F.transform(terms, lambda t: F.concat(F.lit("- "), t)), "\n"), F.lit("\n\n"))).otherwise(""), F.lit("Translate:\n"), text)


def merge_terms(terms: DataFrame) -> DataFrame:
    """Terms (slug, seq, romaji, kanji, kana, english, category, source) to one per slug: first known values, united lists."""
    s = F.col("seq")
    empty = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c))
    return terms.filter("slug <> ''").groupBy("slug").agg(
        F.min_by("romaji", "seq").alias("romaji"), union_in_order(F.col("kanji"), s).alias("kanji"), union_in_order(F.col("kana"), s).alias("kana"),
        first_known(empty("english"), s).alias("english"), first_known(empty("category"), s).alias("category"), union_in_order(F.array("source"), s).alias("sources"),
    )


def curated_terms(spark: SparkSession) -> DataFrame:
    rows = [(n.replace("-", " "), V.KANJI.get(slot, {}).get(n, []), slot) for slot, names in V.SPELLINGS.items() for n in names]
    return spark.createDataFrame([(i, n, k, [], None, c, "curated") for i, (n, k, c) in enumerate(rows)], "seq long, romaji string, kanji array<string>, kana array<string>, english string, category string, source string").withColumn("slug", slug(F.col("romaji")))
