"""Alignment against a plain version that tokenizes whole texts and counts every link."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from loomline.llm import alignment
from loomline.llm.alignment import Pair, Units, align, op13_alignment, vocabulary_paths


@pytest.fixture(scope="module")
def tools():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
    known = {chr(b): b for b in letters}
    for b in range(256):
        if b not in letters:
            known[chr(256 + len(known) - len(letters))] = b
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")), known


def tokens(text, tools):
    a, b, known = tools
    if not text:
        return [], []
    xs = [(i, bytes(known[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    ys = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    whole = (" " + text).encode()
    return (xs, ys) if b"".join(x for _, x in xs) == whole == b"".join(y for _, y in ys) else ([], [])


def spans(side):
    out, at = [], 0
    for i, x in side:
        out.append((i, at, at + len(x)))
        at += len(x)
    return out


def brute(texts, tools):
    rows, counts = [], Counter()
    for text in texts:
        a, b = map(spans, tokens(text, tools))
        linked, k = [], 0
        for i, s, e in a:
            while k and b[k - 1][2] > s:
                k -= 1
            while k < len(b) and b[k][1] < e:
                if b[k][2] > s:
                    linked.append((i, b[k][0]))
                k += 1
        counts.update(linked)
        shut = sorted({x[2] for x in a} & {x[2] for x in b})
        groups, i, j = [], 0, 0
        for end in shut:
            x, y = [], []
            while i < len(a) and a[i][2] <= end:
                x.append(str(a[i][0]))
                i += 1
            while j < len(b) and b[j][2] <= end:
                y.append(str(b[j][0]))
                j += 1
            groups.append(",".join(x) + "|" + ",".join(y))
        rows.append((len(a), len(b), len(groups), linked, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [(a, b, g, len(ls), sum(counts[p] == best[p[1]] for p in ls), sum(counts[p] for p in ls), h) for a, b, g, ls, h in rows]


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_table(spark, sf_dir, tools):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = dict(zip((d for d, _ in docs), brute([t for _, t in docs], tools)))
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in op13_alignment(spark, sf_dir).collect()}
    assert got == want and sum(w[3] for w in want.values()) > 10_000


TEXTS = [
    None, "", " ", "   ", "a", "hello world", "hello world", "  two  spaces  ", "tab\tand\nline \n  x", "<|endoftext|> <s> </s> <unk> <0x41>", "▁", "a▁b c", "été à l’heure — naïve", "日本語の文章 です", "🙂🙃 x",
    " a  b", "á ́", "\x1c x\x1f y\x85 z", "　 a 　", "'s 'll don't", "1234567890" * 5, "x" * 300, "ﬁ ①", "\0a \0", "a" + "​ " * 3, "\r\n \r\n", "Σίσυφος ΣΑΣ", "end ", "  ",
]


@pytest.mark.parametrize("limits", [{}, {"groups": 3, "postings": 4}])
def test_edges(spark, tools, limits):
    df = spark.createDataFrame([(None if i == 4 else i, t, "n", 1) for i, t in enumerate(TEXTS)], "doc_id int, text string, n_a string, number int")
    got = sorted(((r["doc_id"], r["row"]["n_a"]) + tuple(r[c] for c in COLUMNS) for r in align(df, keep=("n_a", "number"), **limits).collect()), key=str)
    want = [(None if i == 4 else i, "n", *w) for i, w in enumerate(brute(TEXTS, tools))]
    assert got == sorted(want, key=str)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id int, text string")
    assert align(df).count() == 0
    assert [r["n_links"] for r in align(spark.createDataFrame([(1, None)], "doc_id int, text string")).collect()] == [0]


def test_long_texts_and_a_small_memory(tools, monkeypatch):
    """Stretches and a memory that is emptied again and again change nothing."""
    monkeypatch.setattr(alignment, "STRETCH", 50)
    monkeypatch.setattr(alignment, "MEMO", 10)
    units = Units(Pair(*vocabulary_paths()))
    texts = [" ".join(f"word{i * i % 37} Größe {i}" for i in range(2000)), "y" * 5000 + " z", "one two " * 40]
    for text, want in zip(texts, [brute([t], tools)[0] for t in texts]):
        counts, digest, codes, times = alignment.aligned(text, units)
        assert (*counts, digest) == (*want[:4], want[6]) and times.sum() == want[3] and (codes[1:] > codes[:-1]).all()


def test_units_spell_whole_texts(tools):
    """Tokens of a text are those of its units in turn."""
    pair = Pair(*vocabulary_paths())
    assert pair.cuts
    for text in filter(None, TEXTS):
        a, b, sound = pair.tokens(pair.units(text))
        if all(sound):
            xs, ys = tokens(text, tools)
            assert [i for x in a for i in x] == [i for i, _ in xs] and [i for y in b for i in y] == [i for i, _ in ys]
