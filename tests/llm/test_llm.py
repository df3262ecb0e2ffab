"""Each operator against a brute-force version, and its edge cases."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import chat, html_text, jaccard_join, langid, merkle, mixing, pieces, suffix_dedup, url_filter, vector_join
from paperloom.llm.common import Scratch
from paperloom.llm.components import components

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(1, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, empties, a long text, ties, repeated rows, ids that repeat or are null."""
    a, b = _words(1, 300), _words(2, 40)
    rows = [
        (1, a, "en", "s1", 1), (2, a, "en", "s1", 1), (2, a, "en", "s1", 1), (3, None, None, None, None), (4, "", "fr", None, 0), (5, "   \n\t ", "fr", "s2", 6), (6, "x", "fr", "s2", 1), (7, b, "fr", "s2", 1),
        (8, b + " " + a[:900], "en", "s1", 1), (9, "é漢😀 " * 30_000, "de", "s3", 1), (10, a.replace("a", "A", 3), "en", "s1", 1), (None, b, "en", "s2", 1), (11, "x", None, "s2", 1), (12, "ab " * 400, "de", "s3", 1),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ---------------------------------------------------------------- 2
def _repeats(texts):
    raw = [(t or "").encode() for t in texts]
    n = Counter(b[p : p + 200] for b in raw for p in range(len(b) - 199))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - 199):
            if n[b[p : p + 200]] > 1:
                gone[p : p + 200] = b"\1" * 200
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return out


def test_difference_cover():
    c = suffix_dedup.COVER
    assert {(a - b) % suffix_dedup.PERIOD for a in c for b in c} == set(range(suffix_dedup.PERIOD))


@pytest.mark.parametrize("name", ["sample", "edge"])
def test_suffix_dedup(spark, edge, name):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 120") if name == "sample" else edge
    docs = docs.withColumn("n_bytes", F.lit("clash"))
    rows = docs.select("doc_id", "text").collect()
    want = Counter(zip([r[0] for r in rows], _repeats([r[1] for r in rows])))
    out = suffix_dedup.suffix_dedup(spark, docs, with_text=True)
    got = Counter((r["doc_id"], (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])) for r in out.collect())
    assert got == want and "lang" in out.columns


def test_suffix_dedup_finds_planted_passages(spark):
    r = random.Random(3)
    passage = "".join(r.choice("abcdefghijklmnop ") for _ in range(230))
    texts = [_words(k, 200) for k in range(40)]
    texts = [t[:k] + passage[: 199 + k % 3] + t[k:] if k % 4 == 0 else t for k, t in enumerate(texts)]
    out = suffix_dedup.suffix_dedup(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in out.collect()}
    assert got == dict(enumerate(_repeats(texts)))


# ---------------------------------------------------------------- 6
def _jaccard(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            n = len(sets[i] & sets[j])
            if n and 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("cap", [2_000_000, 1500])
def test_jaccard_components(spark, edge, monkeypatch, cap):
    monkeypatch.setattr(jaccard_join, "REGION_SHINGLES", cap)
    r = random.Random(4)
    base, rows = _words(5, 120).split(), []
    for k in range(80):  # near copies at every distance around the limit
        w = list(base)
        for _ in range(k % 9):
            w[r.randrange(len(w))] = f"new{r.random()}"
        rows.append((100 + k, " ".join(w), "en", "s", 1))
    docs = edge.unionByName(spark.createDataFrame(rows, SCHEMA))
    want = _jaccard([(x["doc_id"], x["text"]) for x in docs.where("doc_id is not null").collect()])
    out = jaccard_join.jaccard_components(spark, docs).collect()
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in out if x["doc_id"] is not None}
    assert got == want and len(out) == docs.count()
    assert [x["component_id"] for x in out if x["doc_id"] is None] == [7]  # a copy of document 7


def test_metric_join_is_exact():
    r = random.Random(6)
    sets = []
    for _ in range(12):
        base = [r.getrandbits(60) for _ in range(60)]
        sets += [np.unique(np.array(base[: 60 - r.randint(0, 15)] + [r.getrandbits(60) for _ in range(r.randint(0, 12))], np.uint64)) for _ in range(15)]
    m = jaccard_join.MetricJoin(sets)
    m.solve(np.arange(len(sets)))
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            n = len(np.intersect1d(sets[i], sets[j]))
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    assert m.root.tolist() == root


def test_components(spark):
    edges = [(k + 1, k) for k in range(0, 60)] + [(200, 100), (300, 200), (300, 7000), (5, 5)]
    got = {x["node"]: x["root"] for x in components(Scratch(spark), spark.createDataFrame(edges, "hi long, lo long").repartition(5), "t").collect()}
    assert got == {k: 0 for k in range(1, 61)} | {200: 100, 300: 100, 7000: 100}


# ---------------------------------------------------------------- 1
def test_language_id(spark, edge, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.identify(docs, langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))).where(langid.held_out(F.col("doc_id")))
    assert out.where("lang = lang_pred").count() >= 0.98 * out.count()
    model = langid.fit(edge)
    clash = langid.identify(edge.withColumn("Score", F.lit("x")), model).collect()
    assert {x["lang_pred"] for x in clash if x["text"] is None or not re.search(r"[^\W\d_]", x["text"])} == {"und"}
    assert all(0 <= x["score"] <= 1 for x in clash) and len(clash) == edge.count()
    assert {x["lang_pred"] for x in langid.identify(edge, langid.fit(empty)).collect()} == {"und"}
    assert langid.identify(empty, model).count() == 0


def test_false_positives_are_corrected():
    full = langid.Model({"a": np.arange(1, 4000, dtype=np.uint64), "b": np.arange(5000, 5010, dtype=np.uint64)}, slots=4096)
    n, c = full.counts(["zzz " * 2000])
    assert c[0][0] < 0.2 * n[0]  # a crowded filter answers yes to most n-grams; the correction takes that back


# ---------------------------------------------------------------- 3
def test_url_filter(spark):
    weights = url_filter.train(spark)
    urls = [(1, "https://A.Example.ORG/es/1?x"), (2, "http://example.org/en/12"), (3, "http://x.com/fr/"), (4, "http://x.com/de/?/fr/"), (5, None), (6, "no scheme"), (7, "https://org"), (8, "https://notorg/es/"), (9, "http://lucky-casino.example.net/en/5"), (10, "x" * 200_000 + "://h/p")]
    out = {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(urls, "page_id long, url string").withColumn("Rule", F.lit(1)), weights).collect()}
    want = {1: ("a.example.org", "/es/1", "example.org/es/", "block"), 2: ("example.org", "/en/12", "example.org/en/1", "block"), 3: ("x.com", "/fr/", "com/fr/", "allow"), 4: ("x.com", "/de/", "com/de/", "block")}
    for k, w in want.items():
        assert (out[k]["host"], out[k]["path"], out[k]["rule"], out[k]["verdict"]) == w
    assert [(out[k]["host"], out[k]["path"], out[k]["rule"]) for k in (5, 6, 7, 8)] == [("", "", None), ("", "", None), ("org", "", None), ("notorg", "/es/", None)]
    assert out[9]["verdict"] == "block" and out[10]["host"] == "h" and out[5]["verdict"] in ("allow", "block")


def test_url_model_matches_a_plain_one(spark):
    weights = url_filter.train(spark)
    held = spark.createDataFrame([("http://m.mega-casino.example.org/fr/9", 1), ("https://www.cheap-viagra-pills.example.com/de/1", 1), ("https://gardens.example.org/en/7", 0), ("http://physics.example.net/es/44.html", 0)], "url string, y int")
    got = url_filter.judge(held, weights, rules=()).collect()
    assert [int(r["verdict"] == "block") for r in got] == [r["y"] for r in got]


# ---------------------------------------------------------------- 4
def test_sentencepiece(spark, edge, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").unionByName(edge.select("doc_id", "text"))
    rows = pieces.encode_documents(docs.withColumn("IDS", F.lit(1)), with_ids=True).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert list(r["ids"]) == sp.encode(r["text"] or "") and r["decoded"] == (r["text"] or "") and r["exact"]
    assert pieces.encode_documents(empty).count() == 0


def test_pieces_random():
    import sentencepiece

    sp, p = sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL), pieces.Pieces(pieces.read_model(pieces.DEFAULT_MODEL))
    r = random.Random(8)
    texts = ["".join(r.choice("aabeeinrst  ..\n-=1é漢\t▁\x00!") for _ in range(r.randint(0, 60))) for _ in range(400)] + ["a" * 3000, " " * 100, "=" * 500]
    assert [np.frombuffer(x, "<i4").tolist() for x in p.encode(texts)] == [sp.encode(t) for t in texts]


# ---------------------------------------------------------------- 5
def test_mixing(spark, edge, empty):
    out = mixing.mix(spark, edge).toPandas()
    assert len(out) == edge.count() and (out["taken"] <= 3 * out["size"]).all()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    m = mixing.mix(spark, docs).toPandas()
    again = mixing.mix(spark, docs.repartition(7)).toPandas()
    key = ["doc_id", "taken"]
    assert sorted(map(tuple, m[key].values.tolist())) == sorted(map(tuple, again[key].values.tolist()))
    g = m.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
    assert (abs(g["taken"] - g["target"]) <= 0.02 * g["target"] + 50).all()
    sizes = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in docs.collect()}
    assert dict(zip(m["doc_id"], m["size"])) == sizes and abs(g["target"].sum() - sum(sizes.values())) < 1e-6 * sum(sizes.values())
    assert mixing.mix(spark, empty).count() == 0
    assert mixing.resample(spark, edge).columns == edge.columns


def test_targets_are_capped():
    t = mixing.targets({"a": 10, "b": 1000, None: 500})
    assert t["a"] == 30 and abs(sum(t.values()) - 1510) < 1e-9 and t["b"] / t[None] == pytest.approx(2.0)


# ---------------------------------------------------------------- 7
def test_chat(spark):
    said = "<|im_end|><|im_start|>assistant ok <\\|x \\"
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", said), (1, 2, "assistant", said), (1, 2, "assistant", None), (2, 0, "assistant", "w " * 2000), (2, 1, None, ""), (None, 0, "user\nx", "hi"), (None, 0, "assistant", "hi"), (3, 5, "user", "q")]
    rows += [(4, k, "assistant" if k % 2 else "user", f"turn {k} " * 30) for k in range(40)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("loss", F.lit(1))
    windows = chat.format_chats(df, 200, 80)
    got = {r["conv_id"]: r for r in chat.read_back(windows).collect()}
    plain = sorted(((c, t, r, x) for c, t, r, x in rows), key=lambda v: (v[0] is not None, v[0] or 0, v[1], v[2] is not None, v[2] or "", v[3] is not None, v[3] or ""))
    for conv in (1, 2, None, 3, 4):
        turns = [(r or "", x or "") for c, _, r, x in plain if c == conv]
        loss = "".join(x for r, x in turns if r == "assistant")
        g = got[conv]
        assert (g["n_turns"], g["loss_chars"]) == (len(turns), len(loss))
        assert g["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert g["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    four = windows.where("conv_id = 4").toPandas()
    assert len(four) > 3 and (four["n_repeated"][1:] > 0).all()
    assert chat.read_back(chat.format_chats(df.where("false"))).count() == 0


# ---------------------------------------------------------------- 8
def test_vectors(spark):
    r = np.random.default_rng(9)
    base = r.standard_normal((60, 64))
    x = np.concatenate([base, base[:30] + 0.05 * r.standard_normal((30, 64)), base[:5] * 3.0, base[:4]]).astype(np.float32)
    rows = [(i, [float(v) for v in e]) for i, e in enumerate(x)]
    odd = [(500, None), (501, []), (502, [0.0] * 64), (503, [float("nan")] + [1.0] * 63), (504, [None] + [1.0] * 63), (505, [1.0, 2.0]), (506, [float("inf")] * 64), (None, rows[0][1])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    g = u @ u.T >= 0.9
    np.fill_diagonal(g, False)
    lab = np.arange(len(x))
    for _ in range(10):
        lab = np.array([min([lab[i], *lab[g[i]]]) for i in range(len(x))])
    for leaf in (24_000, 10):
        got = {v["vec_id"]: v for v in vector_join.near_vectors(spark, df, leaf=leaf).collect()}
        unnamed = u @ u[0] >= 0.9  # the row without an id is a copy of row 0 and takes part
        assert [got[i]["n_links"] for i in range(len(x))] == (g.sum(1) + unnamed).tolist()
        assert (got[None]["n_links"], got[None]["component_id"], got[None]["kept"]) == (unnamed.sum(), lab[0], False)
        assert [got[i]["component_id"] for i in range(len(x))] == lab.tolist()
        assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in range(500, 507))
    assert vector_join.near_vectors(spark, df.where("false")).count() == 0


# ---------------------------------------------------------------- 9
PAGE = (
    "<html><head><title>T</title><style>p{}</style></head><body><header><a href=/>Home</a></header><nav><ul><li><a href=x>A</a></li></ul></nav><div class='ad'>Buy now\nor never</div>"
    "<article><h1>Tea &amp; milk</h1><p>It is the best of all that we have had in the house, and it was for you.<p>Short<br>line.</p><p>x&nbsp;&#233; &lt;b&gt;</p><aside>More</aside><script>var a='</p>'</script></article>"
    "<div id=comments><p>I was the first to say that it is in the house of the year for you and me.</p></div><form>Mail <input></form><div class='cookie-notice'>We use cookies</div><footer>(c)</footer><!-- <p>x</p> -->"
)


def test_html(spark):
    want = "Tea & milk\nIt is the best of all that we have had in the house, and it was for you.\nShort line.\nx é <b>"
    assert html_text.main_text(PAGE) == want
    bare = PAGE.replace("<article>", "<div>").replace("</article>", "</div>")
    assert "Short line." in html_text.main_text(bare) and "Buy now" not in html_text.main_text(bare)
    assert [html_text.main_text(x) for x in (None, "", "<", "<p", "<!-- open", "plain")] == ["", "", "<", "", "", "plain"]
    df = spark.createDataFrame([(1, None), (2, PAGE), (2, PAGE), (3, "<p>" * 50_000)], "page_id long, html string").withColumn("TEXT", F.lit(0))
    got = html_text.extract(df).collect()
    assert sorted(r["n_chars"] for r in got) == [0, 0, len(want), len(want)] and html_text.extract(df.where("false")).count() == 0


SAID = "It is the best of all that we have had in the house, and it was for you."


@pytest.mark.parametrize("name", ["layout with-sidebar", "no-sidebar", "page has-comments", "post hentry tag-travel", "elementor-widget-text", "sidebar-left", "widget"])
def test_html_hints_are_whole_names(name):
    nav, foot = "<nav><a href=x>A</a></nav><div class='site-nav'>Home</div>", "<div class=sidebar>Buy the best of the year here now.</div><footer>(c)</footer>"
    for tag in ("div", "article", "main"):
        assert html_text.main_text(f"<body>{nav}<div class='{name}'><{tag}><p>{SAID}</p><p>{SAID}</p></{tag}></div>{foot}</body>") == f"{SAID}\n{SAID}"


def test_html_keeps_links_banners_and_other_scripts():
    article = lambda x: f"<nav><a href=x>A</a></nav><article><p>{SAID}</p>{x}<p>{SAID}</p></article><footer>(c)</footer>"
    for part, text in (("<p><a href=x>A whole linked line</a></p>", "A whole linked line"), ("<ul><li><a href=x>One</a></li><li><a href=y>Two</a></li></ul>", "One\nTwo"), (f"<div class='banner'><p>{SAID}!</p></div>", f"{SAID}!")):
        assert html_text.main_text(article(part)) == f"{SAID}\n{text}\n{SAID}"
    assert html_text.main_text(article("<nav><a href=x>B</a></nav><div class=ad><a href=x>Buy</a></div>")) == f"{SAID}\n{SAID}"
    for letters in ("漢字" * 140, "слово " * 46 + "слово", "λόγος " * 46 + "λόγος"):
        bare = f"<ul><li><a href=x>A</a></li></ul><div class=banner>{SAID}</div><div><p>{SAID}</p><p>{letters}</p><p>{SAID}</p></div><footer>{letters}</footer>"
        assert html_text.main_text(bare) == f"{SAID}\n{letters}\n{SAID}"
    assert html_text.main_text("<article><p><a href=x>Only a link</a></p></article>") == "Only a link"


def test_html_keeps_what_is_no_boilerplate():
    page = "<nav><a href=x>A</a></nav><div><p>One line.</p><p>And another.</p></div><div class=ad>Buy</div><footer>(c)</footer>"
    assert html_text.main_text(page) == "One line.\nAnd another."
    assert html_text.main_text(f"<div class=related><main><p>{SAID}</p><div class=ad>Buy</div></main></div><div id=comments><article><p>{SAID} {SAID}</p></article></div>") == SAID
    assert html_text.main_text(f"<div><p>{SAID}</p></div><div class=related><article><p>Teaser.</p></article></div><div id=comments><article><p>{SAID} {SAID}</p></article></div>") == SAID
    assert html_text.main_text("<div><p>" + "漢字" * 200 + "</p></div><footer>(c)</footer>") == "漢字" * 200


# ---------------------------------------------------------------- 10
def test_merkle(spark, edge, empty):
    for parts in (1, 5):
        out = merkle.compare_with_next(spark, edge.where("doc_id is not null").dropDuplicates(["doc_id"]), parts).collect()
        rows = sorted({(r["doc_id"], r["text"] or "") for r in edge.collect() if r["doc_id"] is not None}, reverse=True)
        texts = [t for _, t in rows]
        for k, (i, t) in enumerate(rows):
            r = next(x for x in out if x["doc_id"] == i)
            cut, other = len(t) // 3, texts[(k + 1) % len(texts)]
            edited = t[: len(t) - cut] + other[:cut]
            assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
            assert (r["fingerprint"] == r["edited_fingerprint"]) == (t == edited) and 0 <= r["near_edited"] <= 1
        by_text = {}
        for r in out:
            by_text.setdefault(dict(rows)[r["doc_id"]], set()).add(r["fingerprint"])
        assert all(len(v) == 1 for v in by_text.values()) and len({next(iter(v)) for v in by_text.values()}) == len(by_text)
    assert merkle.compare_with_next(spark, edge).count() == edge.count() and merkle.compare_with_next(spark, empty).count() == 0


def test_merkle_locates_edits(spark):
    text = "\n".join(_words(k, 12) for k in range(60))
    lines = text.split("\n")
    lines[30] = "changed"
    df = spark.createDataFrame([(text, "\n".join(lines))], "a string, b string")
    fp = lambda c: merkle.fingerprint(merkle.root(merkle.sections(F.col(c))), merkle.sections(F.col(c)), merkle.marks(F.col(c)))
    r = df.select(fp("a").alias("a"), fp("b").alias("b")).select(merkle.differing_sections(F.col("a"), F.col("b")).alias("d"), merkle.differing_sections(F.col("a"), F.col("a")).alias("s"), merkle.likeness_of(F.col("a"), F.col("b")).alias("n")).first()
    assert len(r["d"]) == 1 and r["s"] == [] and 0.9 < r["n"] < 1


def test_merkle_likeness_has_no_favourite_place(spark):
    """An edit counts by its length, not by its place; repeated leaves count each."""
    text = _words(70, 600)
    n = len(text)
    changed = {"front": "Z" + text, "middle": text[: n // 2] + "Z" + text[n // 2 :], "end": text + "Z", "opening": _words(71, 90)[:256] + text[256:], "opening only": text[:256] + _words(72, 600)[: n - 256]}
    leaf = "same line of words\n"
    pairs = [(k, text, v) for k, v in changed.items()] + [("twice", leaf * 10, leaf * 20), ("empty", "", "x"), ("no spaces", "漢字" * 900, "x" + "漢字" * 900)]
    df = spark.createDataFrame(pairs, "k string, a string, b string")
    got = {r["k"]: r["n"] for r in df.select("k", merkle.likeness(merkle.root(merkle.sections(F.col("a"))), merkle.marks(F.col("a")), merkle.root(merkle.sections(F.col("b"))), merkle.marks(F.col("b"))).alias("n")).collect()}
    assert min(got["front"], got["middle"], got["end"]) > 0.85
    assert got["opening"] > 0.7 and got["opening only"] < 0.25
    assert got["twice"] == pytest.approx(0.5) and got["empty"] == 0
    lengths = df.select("a", F.expr("a").alias("t")).select("a", F.aggregate(merkle.marks(F.col("t")), F.lit(0).cast("long"), lambda s, m: s + m.bitwiseAND(F.lit(255).cast("long"))).alias("n")).collect()
    assert all(r["n"] == len(r["a"].encode()) for r in lengths)


# ---------------------------------------------------------------- pipeline
def test_pipeline(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = P.identify_language(spark, docs, DATA)
    assert kept.columns == docs.columns and kept.count() >= 0.97 * docs.count()
    alone = P.drop_near_duplicates(spark, kept, DATA).cache()
    roots = {v[1] for v in _jaccard([(r["doc_id"], r["text"]) for r in kept.collect()]).values()}
    assert alone.columns == docs.columns and {r["doc_id"] for r in alone.collect()} == roots
    cut = P.drop_repeated_passages(spark, alone, DATA)
    left = _repeats([r["text"] for r in cut.collect()])
    assert cut.columns == docs.columns and sum(x[1] for x in left) < 200 and all(r["n_chars"] == len(r["text"]) for r in cut.where("n_chars > 0").collect())
    mixed = P.mix_sources(spark, cut, DATA)
    assert mixed.columns == docs.columns and mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    out = P.run(spark, DATA)
    assert out.where("not exact").count() == 0 and out.count() == mixed.count()
