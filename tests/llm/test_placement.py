"""Shards, sequences and URL verdicts."""

import math
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.llm.packing import ANYWHERE, LENGTH, SENTENCE, best_cuts, op6_packing, pack_documents, vocabulary_path
from loomline.llm.sharding import jump_shard, op7_jump_hash, shard
from loomline.llm.url_filter import filter_urls, op9_url_filter


def test_shards(spark, sf_dir):
    rows = op7_jump_hash(spark, sf_dir).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    slots = defaultdict(list)
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 16, zlib.crc32(raw), "key")
        assert r["grown_shard"] in (r["shard"], 40)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len(rows) == len(texts)


def test_jump_is_monotone_and_even(spark):
    keys = spark.range(20000)
    counts = [1, 2, 3, 11, 12, 40, 41, 200]
    table = keys.select("id", *(jump_shard(keys["id"], n).alias(f"n{n}") for n in counts)).toPandas()
    for n in counts:
        assert table[f"n{n}"].between(0, n - 1).all()
    for a, b in zip(counts, counts[1:]):
        moved = table[f"n{a}"] != table[f"n{b}"]
        assert (table.loc[moved, f"n{b}"] >= a).all()
        assert abs(moved.mean() - (1 - a / b)) < 0.02
    sizes = table["n40"].value_counts()
    assert sizes.max() < 20000 / 40 + 6 * math.sqrt(500)


def test_shard_edges(spark):
    df = spark.createDataFrame([(1, None), (1, None), (None, "a"), (None, "b"), (2, "c")], "doc_id bigint, shard string")
    got = shard(df, 3).collect()
    assert len(got) == 5 and len({r["shard"] for r in got if r["doc_id"] is None}) == 1
    assert shard(df.limit(0), 3).count() == 0
    with pytest.raises(ValueError):
        shard(df, 0)


def test_sequences(spark, sf_dir):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary_path())
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    ids = {k: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4") for k, t in texts.items()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in op6_packing(spark, sf_dir).collect():
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(part.tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
    for k, v in ids.items():
        at = 0
        for start, length in sorted(pieces[k]):
            assert start == at and length > 0
            at += length
        assert at == len(v)
    padding = total = 0
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= LENGTH
        total += at
        padding += 0 if at & (at - 1) == 0 else LENGTH - at
    assert padding < 0.01 * total


def test_cuts_are_best():
    rng = np.random.default_rng(5)
    for _ in range(150):
        length = int(rng.choice([8, 16]))
        n = int(rng.integers(1, 80))
        points = np.unique(np.concatenate([[0, n], rng.integers(0, n + 1, n)]))
        while (gaps := np.flatnonzero(np.diff(points) > length)).size:
            points = np.insert(points, gaps[0] + 1, points[gaps[0]] + length)
        cost = rng.choice([0.0, SENTENCE, ANYWHERE], len(points))
        cuts = best_cuts(points, cost, length)
        price = dict(zip(points.tolist(), cost.tolist()))
        tail = n - length

        def value(a, b):
            free = b - a == length or (b - a) & (b - a - 1) == 0 and (b >= tail or price[b] == 0.0)
            return (0 if free else length - (b - a)) + price[b]

        best = {0: 0.0}
        for b in points[1:].tolist():
            best[b] = min(best[a] + value(a, b) for a in points.tolist() if 0 < b - a <= length)
        assert cuts[0] == 0 and cuts[-1] == n and all(0 < b - a <= length for a, b in zip(cuts, cuts[1:]))
        assert sum(value(a, b) for a, b in zip(cuts, cuts[1:])) == pytest.approx(best[n])


def test_packing_edges(spark):
    df = spark.createDataFrame([(1, None, 1), (1, "", 2), (None, "word " * 9000, 3), (2, "a.b! c? <|endoftext|> é\u0301", 4)], "doc_id bigint, text string, offset int").coalesce(1)
    rows = pack_documents(df).collect()
    assert sum(r["length"] for r in rows if r["doc_id"] is None) == 9001
    assert all(len(r["ids"]) == r["length"] for r in rows)
    assert pack_documents(df.limit(0)).count() == 0


def test_urls(spark, sf_dir):
    import duckdb

    from loomline.llm.queries import ORACLES

    db = duckdb.connect()
    db.sql(f"create view pages as select * from '{sf_dir}/pages.parquet'")
    want = sorted(map(str, db.sql(f"select page_id, host, path, rule, verdict from ({ORACLES['op9_url_filter']})").fetchall()))
    assert sorted(str(tuple(r)) for r in op9_url_filter(spark, sf_dir).collect()) == want


def test_the_join_removes_false_positives(spark):
    """The filter lets some unlisted URLs through, never stops a listed one; the join drops the former."""
    from loomline.llm.bloom import build
    from loomline.llm.url_filter import canonical, host_of, listed_urls, path_of, possible_urls

    listed = spark.range(9000).selectExpr("concat('https://www.host', id % 700, '.example.com/', id, '/index.html') as url")
    urls = spark.range(30_000).selectExpr("concat('http://host', id % 700, '.example.com/', id, '?page=', id) as url")
    url = F.col("url")
    table = spark.sparkContext.broadcast(build(listed.select(canonical(host_of(url), path_of(url)).alias("key")), "key"))
    sure = {r[0] for r in listed_urls(urls, listed).collect()}
    maybe = {r[0] for r in possible_urls(urls, table).collect()}
    assert sure == {f"http://host{i % 700}.example.com/{i}?page={i}" for i in range(9000)}
    assert sure < maybe and len(maybe - sure) < 0.1 * 21_000


def test_copied_pages(spark):
    from loomline.llm.url_filter import copied_pages

    a, b = "<p>x</p><article>one\ntwo</article>", "<article>one\ntwo</article> other frame"
    rows = [(3, "u3", a), (1, "u1", b), (2, "u2", a), (2, "u2", a), (4, None, a), (5, "u5", "<article></article>"), (6, "u6", None), (7, "u7", "<article>three</article>"), (None, "u8", a), (9, "u9", "<article></article>")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert sorted(r["url"] for r in copied_pages(pages).collect()) == ["u2", "u2", "u3"]
    assert copied_pages(pages.limit(0)).count() == 0


def test_jump_hash_against_the_plain_loop(spark):
    """Shards of 1 to 60 against a loop over the same random numbers."""
    keys = spark.range(150).crossJoin(spark.range(1, 61).toDF("step")).selectExpr("id", "step", "(shiftrightunsigned(xxhash64(id, cast(step as int)), 33) + 1) / 2147483648D as u")
    draws = {(r["id"], r["step"]): r["u"] for r in keys.collect()}
    for shards in (1, 2, 9, 10, 11, 40, 60):
        for r in spark.range(150).select("id", jump_shard(F.col("id"), shards).alias("shard")).collect():
            b, j, step = -1, 0, 1
            while j < shards:
                b, j, step = j, math.floor((j + 1) / draws[r["id"], step]), step + 1
            assert r["shard"] == b


def test_url_cases(spark):
    urls = [
        None, "", "no scheme", "HTTP://A.EXAMPLE.NET/en/x", "x://net", "x://net/", "x://a.net?q", "x://example.org/fr/1", "x://example.com/de/", "x://myexample.com/de/", "http://u@www.bad.com:80/index.html?x#y",
        "http://sub.bad.com/deep", "http://bad.com.evil/", "http://ok.com/a/b/", "http://ok.com/a/c", "http://ok.com/a/c", "a://b.net://c/",
    ]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id bigint, url string, host string")
    listed = spark.createDataFrame([("http://bad.com/",), ("https://www.ok.com/a/b",), (None,), ("",)], "url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in filter_urls(pages, listed).collect()}
    assert [got[i] for i in range(3)] == [("", "", None, "allow")] * 3
    assert got[3] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[4] == ("net", "", None, "allow") and got[5][2:] == ("net/", "block") and got[6] == ("a.net", "", None, "allow")
    assert got[7][2] == "org/fr/" and got[8][2:] == ("example.com/de/", "block") and got[9][2:] == (None, "allow")
    assert got[10] == ("u@www.bad.com:80", "/index.html", None, "block") and got[11][3] == "block" and got[12][3] == "allow"
    assert got[13][3] == "block" and got[14][3] == got[15][3] == "allow"
    assert got[16][0] == "b.net:"
    assert len(got) == len(urls)
    assert filter_urls(pages, listed.limit(0)).filter("verdict = 'block'").count() == 2
    assert filter_urls(pages.limit(0), listed).count() == 0
