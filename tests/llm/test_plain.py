"""Operators against plain versions written from their definition, and the columns of the registered queries."""

from __future__ import annotations

import hashlib
import math
import random
import re
import struct
import time
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from paperloom.llm import chat, html_text, jaccard_join, langid, merkle, mixing, queries, suffix_dedup, url_filter, vector_join

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(1, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ---------------------------------------------------------------- repeated ids, clashing names, empty tables
def test_rows_of_one_id_link_each_for_itself(spark):
    a, b = _words(1, 80), _words(2, 80)
    rows = [(5, a), (5, b), (2, a + " x"), (7, b + " y"), (None, b), (None, _words(3, 9)), (9, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("BLOCK", F.lit(1)).withColumn("part", F.lit("p"))
    got = sorted(((r["doc_id"], r["component_id"]) for r in jaccard_join.jaccard_components(spark, df).collect()), key=str)
    assert got == sorted([(5, 2), (5, 5), (2, 2), (7, 5), (None, 5), (None, None), (9, 9)], key=str)
    kept = jaccard_join.near_unique(spark, df)
    assert kept.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(2, a + " x"), (5, b), (None, rows[5][1]), (9, "")], key=str)


def test_thue_morse_words_are_told_apart(spark):
    morse = lambda n: "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    rows = []
    for k, n in enumerate((32, 64, 1024, 4096)):
        word = morse(n)
        other = word.translate(str.maketrans("ab", "ba"))
        rows += [(10 * k + 1, word), (10 * k + 2, other), (10 * k + 3, " ".join([word, *"cdefgh"])), (10 * k + 4, " ".join([other, *"ijklmn"]))]
    out = jaccard_join.jaccard_components(spark, spark.createDataFrame([*rows, (99, "x y")], "doc_id long, text string"))
    assert all(r["component_id"] == r["doc_id"] for r in out.collect())
    t = jaccard_join.Texts(pa.table({"text": [text for _, text in rows]}))
    assert len(set(jaccard_join.shingle_sets(t)[0].tolist())) == 20  # 16 with a long word, and two of each tail


def test_vectors_of_one_id_link_each_for_itself(spark):
    rows = [(5, [1.0, 0.0, 0.1]), (5, [0.0, 1.0, 0.0]), (2, [1.0, 0.0, 0.1]), (7, [0.0, 1.0, 0.05]), (None, [0.0, 2.0, 0.0]), (None, [0.0, 0.0, 1.0]), (None, None)]
    out = vector_join.near_vectors(spark, spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("NODE", F.lit(0)))
    got = sorted((tuple(r) for r in out.collect()), key=str)
    assert got == sorted([(5, 1, 2, False), (5, 2, 5, True), (2, 1, 2, True), (7, 2, 5, False), (None, 2, 5, False), (None, 0, None, True), (None, 0, None, True)], key=str)


def test_many_parts_and_leaves_are_exact(spark):
    r = np.random.default_rng(3)
    centre = r.standard_normal((4, 32))
    x = np.concatenate([centre[k % 4] + 0.12 * r.standard_normal(32) for k in range(240)]).reshape(-1, 32).astype(np.float32)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    g = u @ u.T >= 0.9
    np.fill_diagonal(g, False)
    df = spark.createDataFrame([(i, [float(v) for v in e]) for i, e in enumerate(x)], "vec_id long, embedding array<float>")
    for leaf in (7, 40):
        got = {v["vec_id"]: v["n_links"] for v in vector_join.near_vectors(spark, df, leaf=leaf).collect()}
        assert [got[i] for i in range(len(x))] == g.sum(1).tolist()


def test_hot_pivots_are_split(spark, monkeypatch):
    base = _words(4, 60).split()
    r = random.Random(1)
    rows = [(k, " ".join([*base, *(f"w{r.random()}" for _ in range(k % 30))])) for k in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {x["doc_id"]: x["component_id"] for x in jaccard_join.jaccard_components(spark, df).collect()}
    monkeypatch.setattr(jaccard_join, "PIECE", 3)
    assert {x["doc_id"]: x["component_id"] for x in jaccard_join.jaccard_components(spark, df).collect()} == want


def test_names_in_another_case_and_empty_tables(spark, empty):
    df = spark.createDataFrame([(1, "x" * 300, "e"), (2, None, "f")], "doc_id long, text string, N_BYTES string").withColumn("replies", F.lit(0))
    out = suffix_dedup.suffix_dedup(spark, df, with_text=True)
    assert out.columns == ["doc_id", "text", "replies", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"]) for r in out.collect()} == {1: (300, 300), 2: (0, 0)}
    assert suffix_dedup.suffix_dedup(spark, empty).count() == 0
    assert jaccard_join.jaccard_components(spark, empty).count() == 0 and jaccard_join.near_unique(spark, empty).count() == 0
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string"), [0.0] * 9).count() == 0
    clash = spark.createDataFrame([(1, "a b", "s", 0)], "doc_id long, text string, source string, Taken int")
    assert mixing.mix(spark, clash).count() == 1 and merkle.compare_with_next(spark, clash.withColumn("BUCKET", F.lit(9))).count() == 1


# ---------------------------------------------------------------- 1
def test_language_id_agrees_with_exact_sets(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    train = docs.where(~langid.held_out(F.col("doc_id")))
    model = langid.fit(train, sample=10**6)
    sets: dict = {}
    for r in train.where("lang is not null and text is not null").collect():
        sets.setdefault(r["lang"], set()).update(langid.grams([r["text"]])[0].tolist())
    assert model.languages == sorted(sets)
    rows = docs.collect()
    got, score, _ = model.predict([r["text"] for r in rows])
    assert all(0 <= x <= 1 for x in score)
    same = 0
    for r, lang in zip(rows, got):
        g = langid.grams([r["text"]])[0].tolist()
        count = {k: sum(x in s for x in g) for k, s in sets.items()}
        same += lang == ("und" if not g else max(sorted(count), key=count.get)) or (len(g) > 0 and count[lang] >= 0.99 * max(count.values()))
    assert same >= 0.99 * len(rows)
    small = langid.fit(train, sample=5)
    assert small.languages == model.languages
    with pytest.raises(ValueError):
        langid.fit(spark.range(300).selectExpr("id as doc_id", "'abc' as text", "cast(id as string) as lang"))


# ---------------------------------------------------------------- 3
def test_url_weights_are_those_of_a_plain_regression(spark):
    slots, rounds, rate = 64, 3, 0.5
    labelled = url_filter.LABELLED[::7]
    t = spark.createDataFrame([(i, u, y) for i, (u, y) in enumerate(labelled)], "k int, url string, y int")
    text = url_filter._model_text(F.col("url"), url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url")))
    rows = sorted(t.select(F.xxhash64(F.lit(3), "k").alias("o"), "y", url_filter.gram_slots(text, slots).alias("s")).collect(), key=lambda r: r["o"])
    w = np.zeros(slots + 1)
    for _ in range(rounds):
        for r in rows:
            x = np.append(np.bincount(r["s"], minlength=slots) / math.sqrt(len(r["s"])), 1.0)
            w -= rate * (1 / (1 + math.exp(-x @ w)) - r["y"]) * x
    assert np.allclose(url_filter.train(spark, labelled, slots, rounds, rate), w, atol=1e-9)


def test_url_model_knows_paths_and_hosts(spark):
    held = [("http://mega-casino-jackpot.example/", 1), ("https://plain.example/free-casino-bonus-spins", 1), ("https://rivers.example/articles/how-lakes-form", 0), ("http://geometry.example/docs/first-steps.html", 0)]
    got = url_filter.judge(spark.createDataFrame(held, "url string, y int"), url_filter.train(spark), rules=()).collect()
    assert [int(r["verdict"] == "block") for r in got] == [r["y"] for r in got]


HELD_KEPT = """
https://www.oakfield-school.org/news/spring-fair
http://volcanoes.geology.example.edu/field-guide/basalt
https://blog.quietcarpenter.com/2020/11/dovetail-joints
https://www.lakesidehotel.de/zimmer
http://docs.querytool.dev/en/latest/functions.html
https://m.eveningpost.co.uk/sport/cricket/scores
https://www.openscores.net/composers/bach
http://en.streetmaps.info/lisbon/tram-28
https://jobs.cityrailway.fr/offres/mecanicien
https://www.plantnursery.com/shrubs/lavender
http://www.stargazing.example.org/moon/phases
https://forum.vintagecameras.net/topic/117
https://healthcentre.example.com/en/appointments
https://www.roman-roads.com/britain/watling-street
http://courses.statistics.example.edu/notes/week-6.pdf
https://www.cheesemakers.ch/de/sorten
https://weathermuseum.example.net/exhibits
http://www.folkdance.biz/steps/polka
https://support.mailclient.io/questions/import-contacts
https://www.translatorsguild.org/members
""".split()
HELD_BLOCKED = """
http://www.vegas-casino-online.com/bonus
https://m.free-slots-jackpot.net/play
http://cheap-pills-shop.org/viagra
https://www.adult-cams-live.de/xxx
http://hot-porn-tube.com/videos/7
https://blog.payday-loan-cash.com/en/apply
http://replica-rolex-cheap.net/order-now
https://www.claim-your-free-prize.com/winner
http://crack-software-download.info/keygen
https://ads.click-tracker-ads.com/click?to=offer
http://www.poker-bets-bonus.co.uk/join
https://singles-adult-dating.fr/chat
http://buy-cheap-followers.biz/now
https://www.miracle-diet-pills.com/lose-weight
http://earn-cash-fast-home.net/get-rich
https://lottery-winner-claim.com/prize
http://spam-links-farm.com/submit
https://www.bitcoin-profit-bonus.com/double
http://xxx-girls-webcam.net/free
https://no-prescription-meds.com/cheap
""".split()


def test_url_model_on_held_out_urls(spark):
    """None of their hosts is in the labelled table; precision and recall of the model alone."""
    hosts = {u.split("/")[2] for u, _ in url_filter.LABELLED}
    held = [(u, y) for y, urls in ((0, HELD_KEPT), (1, HELD_BLOCKED)) for u in urls]
    assert not hosts & {u.split("/")[2] for u, _ in held}
    rows = url_filter.judge(spark.createDataFrame(held, "url string, y int"), url_filter.train(spark), rules=()).collect()
    said = [(r["verdict"] == "block", r["y"] == 1) for r in rows]
    right = sum(a and b for a, b in said)
    assert right / sum(a for a, _ in said) >= 0.9 and right / sum(b for _, b in said) >= 0.9


# ---------------------------------------------------------------- 5
def _plain_mix(rows, weights=mixing.WEIGHTS, most=mixing.MOST):
    """taken by row number, of rows (source, size, hash, id) already in the order of positions inside their source."""
    words: dict = {}
    for s, n, *_ in rows:
        words[s] = words.get(s, 0) + n
    goal, total = mixing.targets(words, weights, most), sum(words.values())
    order = sorted(k for k in words if k is not None) + [None] * (None in words)
    slots = max(1, min(mixing.SLOTS, max(mixing.LEAST_SLOTS, total // mixing.WORDS_EACH)))
    each = max(1, -(-total // slots))
    blocks = {k: max(-(-words[k] // each), min(words[k], mixing.LEAST_BLOCKS)) for k in order}
    uses = [goal[k] * blocks[k] / words[k] if words[k] else 0.0 for k in order]
    edges = np.cumsum(uses) / sum(uses)
    rank, used = {k: 0 for k in order}, {k: [0] * blocks[k] for k in order}
    for i in range(round(sum(uses))):
        k = order[min(int(np.searchsorted(edges, (i + 0.5) * mixing.GOLDEN % 1.0, side="right")), len(order) - 1)]
        if rank[k] < most * blocks[k]:
            used[k][rank[k] % blocks[k]] += 1
        rank[k] += 1
    at, out = {k: 0 for k in order}, []
    for s, n, *_ in rows:
        a, got = at[s], 0
        for b in range(blocks[s]) if n else ():
            lo, hi = b * words[s] // blocks[s], (b + 1) * words[s] // blocks[s]
            got += max(0, min(a + n, hi) - max(a, lo)) * used[s][b]
        at[s] += n
        out.append(got)
    return out


def test_mixing_equals_a_plain_schedule(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 60").unionByName(spark.createDataFrame([(900, None, None, None, 0), (901, "a b c", None, None, 5), (901, "a b c", None, None, 5)], SCHEMA))
    rows = docs.select("source", "text", "doc_id", F.xxhash64(F.lit(1), "doc_id", F.xxhash64(F.coalesce("text", F.lit("")))).alias("h")).collect()
    rows = sorted(((r["source"], len(re.findall(mixing.WORD, r["text"] or "")), r["h"] ^ 0, r["doc_id"]) for r in rows), key=lambda r: (r[0] is None, r[0] or "", r[2] >> 54, r[2], r[3], r[1]))
    want = sorted((r[3], taken) for r, taken in zip(rows, _plain_mix(rows)))
    # rows that are equal share their places, so only their sum is fixed
    got = sorted((r["doc_id"], r["taken"]) for r in mixing.mix(spark, docs).collect())
    assert [w for w in want if w[0] != 901] == [g for g in got if g[0] != 901]
    assert sum(w[1] for w in want if w[0] == 901) == sum(g[1] for g in got if g[0] == 901)


# ---------------------------------------------------------------- 7
def test_long_system_turns_are_not_repeated(spark):
    rows = [(1, 0, "system", "be kind " * 200)] + [(1, k + 1, "assistant" if k % 2 else "user", f"turn {k}") for k in range(40)]
    windows = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 200, 60).collect()
    assert sum("be kind" in w["text"] for w in windows) == 1 and 2 <= len(windows) < 12
    short = [(1, 0, "system", "be kind")] + rows[1:]
    windows = chat.format_chats(spark.createDataFrame(short, "conv_id long, turn long, role string, text string"), 60, 20).collect()
    assert all(w["text"].startswith("<|im_start|>system\nbe kind") for w in windows)
    assert all(sum(chat.count_tokens(x) for _, x in chat.parse(w["text"], 0)) <= 60 for w in windows)


# ---------------------------------------------------------------- 9
SAYS = ("It is the best of all that we have had in the house, and it was for you.", "There was a man who had not been to the town as he was in his house with them.", "Short line", "x &amp; y", "La casa de la mujer es más que una casa y no la de los otros que la ven.")
NOISE = (
    "<nav><ul><li><a href=a>Home</a><li><a href=b>News</a></ul></nav>", "<header><h2>The Site</h2></header>", "<div class='ad'>Buy this of all that is in the house now, it was made for you.</div>", "<aside>It is of the side</aside>",
    "<script>if (a < b) document.write('<p>It is the</p>')</script>", "<style>p > a {}</style>", "<form><label>Your name <input></label><button>Go</button></form>", "<section id=comments><p>I was there and it is not as you say, for it was in the house.</p></section>",
    "<div class='cookie-notice'><p>We use cookies as it is the way of the web.</p></div>", "<footer>(c) the site</footer>", "<!-- <p>It is a note that was not for you.</p> -->", "<div role=navigation>1 2 3</div>",
)


def test_html_of_built_pages():
    r = random.Random(12)
    for _ in range(150):
        lines = [r.choice(SAYS) for _ in range(r.randint(1, 9))]
        wrap = r.choice(["<p>{}</p>", "<p>{}", "<div>{}</div>", "<section id=tags><p>{}</p></section>", "<blockquote><p>{}</p></blockquote>", "<fieldset>{}</fieldset>"])
        body = "".join(wrap.format(x) + (r.choice([x for x in NOISE if "<header" not in x]) if r.random() < 0.3 else "") for x in lines)
        tag = r.choice(["article", "main"])
        page = "<html><body>" + "".join(r.sample(NOISE, r.randint(0, 6))) + f"<{tag}>{body}</{tag}>" + "".join(r.sample(NOISE, r.randint(0, 6)))
        assert html_text.main_text(page) == "\n".join(x.replace("&amp;", "&") for x in lines), page


@pytest.mark.parametrize("unit", ["<div>x", "<div class=ad>x", "</i><div>x", "<p class=sidebar>x<article>", "<a href=x><b>"])
def test_html_is_linear_in_nesting(unit):
    start = time.perf_counter()
    html_text.main_text(unit * 50_000)
    assert time.perf_counter() - start < 10


def test_html_keeps_words_of_formulas_and_pictures():
    page = f"<article><p>{SAYS[0]} <math><mi>x</mi></math> <svg><text>y</text></svg></p><div class='tags widget related'>{SAYS[1]}</div></article>"
    assert html_text.main_text(page) == f"{SAYS[0]} x y\n{SAYS[1]}"


# ---------------------------------------------------------------- 10
def _mark(h, n):
    return (h >> 24) << 8 | n


def _plain_leaves(text):
    pieces = re.findall(merkle.PIECE, text.encode().decode("latin-1"))
    assert "".join(pieces).encode("latin-1") == text.encode()
    first = sorted(_mark(xxhash.xxh64_intdigest(x.encode(), 42), len(x)) for x in pieces)
    out, run = [], {}
    for m in first:
        j = run.get(m, 0)
        run[m] = j + 1
        again = xxhash.xxh64_intdigest(struct.pack("<i", j), xxhash.xxh64_intdigest(struct.pack("<q", m), 42))
        out.append(_mark(again, m & 255) if j else m)
    return out


def _plain_tree(text):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    sections, held = [], []
    for leaf in map(sha, text.split("\n")):
        held.append(leaf)
        if leaf[-64] in "01":
            sections.append(sha(",".join(held)))
            held = []
    if held:
        sections.append(sha(",".join(held)))
    return sha(",".join(sections)), sections


def _plain_fingerprint(text):
    root, sections = _plain_tree(text)
    return f"{root}|{','.join(s[:16] for s in sections)}|{'.'.join(f'{m:x}' for m in _plain_leaves(text))}"


def _plain_likeness(a, b):
    if _plain_tree(a)[0] == _plain_tree(b)[0]:
        return 1.0
    x, y = set(_plain_leaves(a)), set(_plain_leaves(b))
    both = sum(m & 255 for m in x & y)
    total = sum(m & 255 for m in x) + sum(m & 255 for m in y) - both
    return both / total if total else 0.0


def test_merkle_equals_a_plain_tree(spark):
    texts = [_words(k, 30 + 7 * k) + "\n" + "same line\n" * (k % 4) for k in range(12)] + ["", "é漢😀 " * 50, "\n\n", "x", "one line that ends in no break " * 20]
    rows = [(k, t) for k, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in merkle.compare_with_next(spark, spark.createDataFrame(rows, "doc_id long, text string"), 3).collect()}
    for k, t in rows:
        after = texts[k - 1]  # descending ids; after the last comes the first
        n = len(t) // 3
        edited = t[: len(t) - n] + after[:n]
        g = got[k]
        assert (g["fingerprint"], g["edited_fingerprint"]) == (_plain_fingerprint(t), _plain_fingerprint(edited))
        assert (g["near_edited"], g["near_next"]) == (pytest.approx(_plain_likeness(t, edited)), pytest.approx(_plain_likeness(t, after)))


# ---------------------------------------------------------------- queries
COLUMNS = {
    "op1_language_id": "doc_id held_out lang_pred score", "op2_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256", "op3_url_filter": "page_id host path rule verdict",
    "op5_mixing": "doc_id size source_size target taken", "op6_jaccard_join": "doc_id n_shingles component_id", "op7_chat_format": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op8_vector_join": "vec_id n_links component_id kept", "op9_html_text": "page_id url text n_chars", "op10_merkle": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op11_ranked_search": "item_id rank doc_id score", "op12_fill_in_middle": "doc_id n form prefix_chars middle_chars output_sha256 restored_sha256", "op13_token_count": "doc_id n_bytes n_tokens over_limit",
}


def test_queries_have_the_columns_of_their_contract():
    assert set(COLUMNS) | {"op4_sentencepiece"} == set(queries.queries())


@pytest.mark.parametrize("name", ["op1_language_id", "op3_url_filter", "op7_chat_format", "op9_html_text"])
def test_query(spark, name):
    out = queries.queries()[name](spark, DATA)
    assert out.columns[: len(COLUMNS[name].split())] == COLUMNS[name].split()
    rows = out.collect()
    table = {"op7": "conversations", "op1": "documents"}.get(name[:3], "pages")
    source = spark.read.parquet(f"{DATA}/{table}.parquet")
    if name.startswith("op7"):
        said = "<|im_end|><|im_start|>assistant ok"
        extra = next(r for r in rows if r["conv_id"] == -1)
        assert (extra["n_turns"], extra["loss_chars"]) == (2, len(said)) and extra["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert extra["turns_sha256"] == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
        assert len(rows) == source.select("conv_id").distinct().count() + 1
        return
    assert len(rows) == source.count()
    if name.startswith("op1"):
        assert all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
