"""Ranked search, fill-in-the-middle and token counts against plain versions, SQL and the vocabulary's own library."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import fim, queries, ranked, token_count

DATA = "/root/testdata/sf0.001"
LONG = "é漢😀 x.\n" * 30_000
TEXTS = [None, "", "\n", "\n\n\n", "no end", "one\ntwo\nthree", "a<P>b\nc", "<S>", "ends <\nS> <P\n", LONG, "tie tie", "tie tie", "  \t ", "Ünï CODE code Code", "<|endoftext|>x<|endoftext|><|endoftext|> y"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i if i != 6 else None, t, "x", i) for i, t in enumerate(TEXTS)] + [(3, "another text of three", "x", 1), (10, "tie tie", "x", 10)]
    return spark.createDataFrame(rows, "doc_id long, text string, FORM string, places int")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def _sql(name):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c.execute(queries.oracle_sql()[name]).df()


@pytest.mark.parametrize("name", ["op11_ranked_search", "op12_fill_in_middle"])
def test_against_sql(spark, name):
    got, want = queries.queries()[name](spark, DATA).toPandas(), _sql(name)
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda f: sorted(tuple(str(v) for v in r) for r in f[sorted(f.columns)].astype(object).itertuples(index=False))
    clean = lambda f: f.astype({c: "Int64" for c in ("prefix_chars", "middle_chars") if c in f})
    assert rows(clean(got)) == rows(clean(want))


# ---------------------------------------------------------------- 11
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def _terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _plain_search(docs, items, k=10):
    docs = [(d, Counter(_terms(t))) for d, t in docs if _terms(t)]
    n_docs, total, df = len(docs), sum(sum(c.values()) for _, c in docs), Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c in docs:
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(_terms(text)) if t in c)
            found += [(-score, d is None, d)] * (score > 0)
        out += [(item, i, d, -s) for i, (s, _, d) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def test_terms():
    for text in ("", "Ab-c_9Z é\x80x\x7fß", "a\x1cb\x85c", "١٢ A", "x" * 50_000):
        assert [t.decode() for t in ranked.terms_of(text)] == _terms(text)


@pytest.mark.parametrize("shard", [1 << 20, 400, 60])
def test_search_is_exact_at_any_shard_size(spark, shard):
    r = random.Random(shard)
    words = [f"w{i}" for i in range(60)]
    docs = [(r.randrange(150), " ".join(r.choices(words, weights=[1 / (i + 1) for i in range(60)], k=r.randint(0, 30)))) for _ in range(200)]
    docs += [(500 + i, "copy of one text w59") for i in range(60)] + [(None, "w59 copy"), (None, None), (7, "")]
    items = [(i, " ".join(r.choices(words, k=4))) for i in range(25)] + [(90, "copy"), (91, None), (92, "unknownterm"), (None, "w59 W59"), (94, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("shard", F.lit("x"))
    asked = spark.createDataFrame([*items, items[0]], "item_id long, text string").withColumn("term", F.lit(0))
    got = sorted((tuple(x) for x in ranked.ranked_search(spark, df, asked, shard_postings=shard).collect()), key=str)
    assert got == _plain_search(docs, items)


def test_later_waves_and_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(ranked, "FIRST_WAVE", 1)
    monkeypatch.setattr(ranked, "WAVE_GROWTH", 2)
    monkeypatch.setattr(ranked, "ITEM_BLOCK", 3)
    docs = [(i, f"common {'rare ' * (i % 7)} n{i % 11}") for i in range(120)]
    items = [(i, f"common rare n{i}") for i in range(11)]
    got = ranked.ranked_search(spark, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), k=4, shard_postings=30)
    assert sorted((tuple(x) for x in got.collect()), key=str) == _plain_search(docs, items, 4)


def test_search_of_empty_tables(spark, empty):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none, items = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked.ranked_search(spark, empty, items).collect() == ranked.ranked_search(spark, docs, none).collect() == []
    assert ranked.ranked_search(spark, empty, items).columns == ["item_id", "rank", "doc_id", "score"]


def test_bisection_separates_topics():
    sample = [[f"{'ab'[i % 2]}{(i * 7 + k) % 40}".encode() for k in range(12)] for i in range(400)]
    router = ranked.fit_router(sample, 2)
    at = {t: i for i, t in enumerate(router.terms)}
    doc, term = (np.array(x) for x in zip(*[(i, at[t]) for i, ts in enumerate(sample) for t in ts]))
    leaf = router.route(doc, term, len(sample))
    assert max(np.mean(leaf == np.arange(400) % 2), np.mean(leaf != np.arange(400) % 2)) > 0.9


# ---------------------------------------------------------------- 12
def _plain_fim(doc_id, text):
    units = re.findall(r"[^\n]*\n|[^\n]+", text or "")
    h = [int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in fim.MARKS):
        return len(units), "plain", None, None, text or ""
    form = "spm" if h[3] % 100 < 50 else "psm"
    return len(units), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("piece", [fim.PIECE_BYTES, 5])
def test_fill_in_middle_with_whole_and_cut_texts(spark, odd, piece):
    rows = odd.where(F.length("text").isNull() | (F.length("text") < 1000)) if piece == 5 else odd
    out = fim.fill_in_middle(rows, piece_bytes=piece)
    assert out.columns == ["doc_id", "text", "places", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = [tuple(r) for r in out.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()]
    assert sorted(((d, t) for d, t, *_ in got), key=str) == sorted(((r["doc_id"], r["text"]) for r in rows.collect()), key=str)
    for d, t, _, n, form, p, m, output, back in got:
        assert (n, form, p, m, output) == _plain_fim(d, t) and back == (t or "")


def test_a_giant_text_in_pieces_equals_the_whole(spark):
    df = spark.createDataFrame([(i, LONG[i:]) for i in range(6)] + [(7, "x" * 300_000), (8, "\n" * 5000)], "doc_id long, text string")
    for r in fim.fill_in_middle(df, piece_bytes=10_007).collect():
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == _plain_fim(r["doc_id"], r["text"])


def test_chunks_compose_for_any_automaton(monkeypatch):
    r = random.Random(5)

    def walk(a, raw):
        state, ends = 0, []
        for i, b in enumerate(raw, 1):
            ends += [i] * a.done[a.kinds[b]][state]
            state = a.step[a.kinds[b]][state]
        return ends + [len(raw)] * a.last[state]

    for size in (1, 3, 256):
        monkeypatch.setattr(fim, "CHUNK_BYTES", size)
        for a in (fim.LINES, fim.SENTENCES):
            texts = ["".join(r.choice("ab. \n?é😀") for _ in range(r.choice([0, 1, 9, 700]))).encode() for _ in range(9)]
            lens = np.array([len(t) for t in texts], np.int64)
            scan = fim.Scan(a, np.frombuffer(b"".join(texts), np.uint8), np.cumsum(lens) - lens, lens)
            ends, counts = scan.functions()
            want = [walk(a, t) for t in texts]
            assert (counts[0] + np.array(a.last)[ends[0]]).tolist() == [len(w) for w in want]
            text, k = (np.array(x) for x in zip(*[(i, j) for i, w in enumerate(want) for j in range(1, len(w) + 1)]))
            assert scan.select(text, np.zeros(len(text), np.int64), k).tolist() == [want[i][j - 1] for i, j in zip(text, k)]


def test_fill_in_middle_shares(spark):
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("a\nb\nc\n").alias("text"))
    form = Counter(r["form"] for r in fim.fill_in_middle(df, percent=50, spm_percent=0, marks=("[p]", "[s]", "[m]")).collect())
    assert 150 < form["plain"] < 250 and form["spm"] == 0


# ---------------------------------------------------------------- 13
@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(token_count.default_path())


def test_counts_equal_the_library(spark, odd, library):
    documents = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    for df in (odd, documents):
        out = token_count.count_tokens(df, limit=5)
        assert out.columns == [*df.columns, "n_bytes", "n_tokens", "over_limit"]
        for r in out.collect():
            n = len(library.encode(r["text"] or "", add_special_tokens=False).ids)
            assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((r["text"] or "").encode()), n, n > 5)


def test_counts_of_random_texts_equal_the_library(library):
    counter, r = token_count.Counter(token_count.read_vocabulary(token_count.default_path())), random.Random(2)
    parts = ["<|endoftext|>", "<|endof", " ", "  ", "\n", "\t", "a", "the", "ing", "'s", "'LL", "12", "٣", "é", "漢", "😀", "\x1c", "\x85", " ", "_", "՘", "꟎"]
    for _ in range(1500):
        text = "".join(r.choice([*parts, chr(r.choice([r.randrange(0xD800), r.randrange(0xE000, 0x110000)]))]) for _ in range(r.randint(0, 40)))
        assert counter.text(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)
    for text in ("a" * 60_000, "ab" * 30_000, " " * 60_000, "ñandú" * 9000):
        assert counter.text(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_merging_in_order_of_rank():
    a, b, ab, aba = 0, 1, 2, 3
    merges = {a << 32 | b: (5, ab), ab << 32 | a: (1, aba)}
    assert token_count.count_merged([a, b, a, b, a], merges) == 3  # ab ab a -> ab aba
    assert token_count.count_merged([], merges) == 0 and token_count.count_merged([a], merges) == 1


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        token_count.read_vocabulary(token_count.default_path().replace(token_count.DEFAULT_NAME, "word_bpe_49k.json"))


@pytest.mark.parametrize("f", [fim.fill_in_middle, token_count.count_tokens])
def test_empty_tables(empty, f):
    assert f(empty).collect() == []
