"""Flows that write, the day's snapshot, services and model answers, on small tables worked out by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from paperloom.functions import cards, providers
from paperloom.functions import text as tx
from paperloom.operators import daily as dy
from paperloom.operators import library as lib
from paperloom.operators import records as rec
from paperloom.sources import curated, services

PAPERS = "id long, openalex_id string, title string, abstract string, year int, venue string, doi string, arxiv_id string, direction string, direction_label string, sources array<string>"
LINKS = "paper_id long, direction string, direction_label string, is_relevant boolean"
EVENTS = "id long, paper_id long, event string, created_at timestamp"
ITEMS = "paper_id long, source string, external_key string, collection string"


@pytest.fixture(scope="module")
def papers(spark):
    rows = [
        (1, "W1", "Motion planning for driving", "x", 2020, "ICRA", "10.1/a", None, "planning", "运动规划与控制", ["OpenAlex"]), (2, None, "Learning by Cheating", "y", 2019, "CoRL", None, "1912.12294", None, None, []),
        (3, "W3", "Protein folding", "drug discovery", 2021, "Nature", None, None, "", None, ["OpenAlex"]), (4, "W4", None, None, None, None, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, PAPERS)


def _empty(spark, ddl):
    return spark.createDataFrame([], ddl)


def _now():
    return F.lit("2024-02-01")


# ---------------------------------------------------------------- upsert
def test_upsert_records(spark, papers):
    new = [
        (1, None, "Motion planning", "a longer abstract", 0, "arXiv", "https://doi.org/10.1/A", None, ["arXiv"], {"arXiv": "1"}), (2, "W9", "Brand new", "n", 2023, "Nature", None, None, ["OpenAlex"], {"OpenAlex": "W9"}),
        (3, None, "Brand new!", "nn", 2023, "", None, None, ["arXiv"], {"arXiv": "9"}), (4, "W4", None, None, None, None, None, None, None, None),
    ]
    came = spark.createDataFrame(new, "n long, openalex_id string, title string, abstract string, year int, venue string, doi string, arxiv_id string, sources array<string>, source_ids map<string,string>")
    old = papers.withColumn("note", F.lit("kept"))
    out = {(r["title"], r["status"]): r for r in rec.upsert_records(old, came, F.lit("2024-02-01").cast("date")).collect()}
    one = out["Motion planning for driving", "updated"]
    assert (one["id"], one["abstract"], one["year"], one["venue"], one["sources"], one["source_ids"], one["note"]) == (1, "a longer abstract", 2020, "ICRA", ["OpenAlex", "arXiv"], {"arXiv": "1"}, "kept")
    assert ("Learning by Cheating", "untouched") in out and out["Learning by Cheating", "untouched"]["is_classic"]
    fresh = [r for r in out.values() if r["status"] == "inserted"]
    assert len(out) == 6 and {r["title"] for r in fresh} == {"Brand new", "Brand new!"}
    same = rec.upsert_records(papers, papers.where("id = 1").withColumn("n", F.lit(1)).drop("id"), F.lit("2024-02-01").cast("date"))
    again = rec.upsert_records(same.drop("status", "needs_embedding"), papers.where("id = 1").withColumn("n", F.lit(1)).drop("id"), F.lit("2024-02-01").cast("date"))
    assert {r["id"]: r["status"] for r in again.collect()}[1] == "unchanged"
    assert rec.upsert_records(papers, came.where("false"), F.lit("2024-02-01").cast("date")).where("status <> 'untouched'").count() == 0
    assert rec.upsert_records(papers.where("false"), came, F.lit("2024-02-01").cast("date")).where("status = 'inserted'").count() == 4


def test_records_of_one_target_are_folded(spark, papers):
    came = spark.createDataFrame([(1, "10.1/a", None, ["A"], {"a": "1"}), (2, None, "W1", ["B"], {"a": "2", "b": "3"})], "n long, doi string, openalex_id string, sources array<string>, source_ids map<string,string>")
    out = rec.upsert_records(papers, came, F.lit("2024-02-01").cast("date")).where("id = 1").first()
    assert out["sources"] == ["OpenAlex", "A", "B"] and out["source_ids"] == {"a": "2", "b": "3"}


# ---------------------------------------------------------------- directions
def test_keys_and_directions(spark):
    custom = spark.createDataFrame([("abc", "Abc", "q1", "#0"), ("abc-2", "ABC ", "q2", "#0")], "key string, label string, query string, color string")
    table, key = lib.create_direction(custom, "abc!", "a query")
    assert key == "abc-3" and table.count() == 3
    for label, query in (("a", "query"), ("label", "q"), ("Abc", "query"), ("planning", "query"), ("车辆控制", "query")):
        with pytest.raises(ValueError):
            lib.create_direction(custom, label, query)
    new = spark.createDataFrame([(7, "Abc", "zzz"), (8, "other", "q2"), (9, "New One", "nn"), (10, "New One", "nn")], "paper_id long, label string, query string")
    made, links = lib.suggest_directions(custom, _empty(spark, LINKS), new)
    assert {r["key"] for r in made.collect()} == {"abc", "abc-2", "new-one"}
    assert {(r["paper_id"], r["direction"]) for r in links.collect()} == {(7, "abc"), (8, "abc-2"), (9, "new-one"), (10, "new-one")}
    every = lib.override_labels(curated.directions(spark), spark.createDataFrame([("planning", "Mine"), ("x", "X")], "key string, label string"))
    got = {r["direction"]: r["label"] for r in every.collect()}
    assert got["planning"] == "Mine" and got["x"] == "X" and got["control"] == "车辆控制" and len(got) == 11


def test_apply_classification(spark, papers):
    answers = spark.createDataFrame([(2, "planning", ["control", "planning"]), (1, "control", []), (3, None, ["safety"])], "paper_id long, primary_direction string, secondary_directions array<string>")
    p, links = lib.apply_classification(papers, _empty(spark, LINKS), answers, curated.directions(spark).select("direction", "label"))
    got = {r["id"]: (r["direction"], r["direction_label"]) for r in p.collect()}
    assert got[2] == ("planning", "运动规划与控制") and got[1][0] == "planning" and got[3][0] == "" and p.columns == papers.columns
    assert {(r["paper_id"], r["direction"]) for r in links.collect()} == {(2, "planning"), (2, "control"), (1, "control")}


# ---------------------------------------------------------------- saving, importing, seeds, deletes
def test_save_papers(spark, papers):
    body = "id string, doi string, title string, year int, venue string, authors string, abstract string, pdf_url string, source string"
    rows = [("W1", None, "A", None, None, None, None, None, None), (None, "10.1/a", "B", None, None, None, None, None, None), ("Z", None, "New", 2020, "V", "A", "a", None, "arXiv"), (None, None, "  ", None, None, None, None, None, None)]
    out = lib.save_papers(papers, _empty(spark, ITEMS), _empty(spark, EVENTS), spark.createDataFrame(rows, body), _now())
    done = {r["id"]: (r["paper_id"], r["already_existed"]) for r in out["outcome"].collect()}
    assert done["W1"] == (1, True) and done["10.1/a"] == (1, True) and not done["Z"][1] and len(done) == 3
    assert out["papers"].count() == 5 and out["library"].count() == 2 and out["events"].select("id").distinct().count() == 3
    again = lib.save_papers(out["papers"], out["library"], out["events"], spark.createDataFrame(rows[2:3], body), _now())
    assert again["papers"].count() == 5 and again["outcome"].first()["already_existed"]


def test_import_entries(spark, papers):
    ddl = "key string, title string, year int, doi string, arxiv_id string, abstract string, venue string, authors string, pdf_url string"
    rows = [("k1", "Motion planning for driving", 2020, None, None, "", "", "", None), ("k2", "Vehicle control by MPC", 2022, None, "2201.00001", "vehicle control", "", "A", None), ("k3", "Vehicle control by MPC", 2022, None, "2201.00001", "", "", "A", None), ("k4", None, None, None, None, None, None, None, None)]
    out = lib.import_entries(papers, _empty(spark, ITEMS), _empty(spark, LINKS), _empty(spark, EVENTS), spark.createDataFrame(rows, ddl), _now())
    c = out["counters"].first()
    assert (c["entries"], c["duplicates"], c["inserted"]) == (3, 1, 1) and c["linked"] == out["links"].count() > 0
    assert out["papers"].count() == 5 and out["events"].count() == 3 and out["papers"].where("arxiv_id = '2201.00001'").first()["pdf_url"] == "https://arxiv.org/pdf/2201.00001.pdf"


def test_seed_backfill_relabel_delete_clean(spark, papers):
    assert lib.seed(papers, curated.classics(spark)) is papers
    assert lib.seed(papers.where("false"), curated.classics(spark)).count() == 9
    b = {r["id"]: r for r in lib.backfill(papers).collect()}
    assert b[2]["openalex_id"] == "arxiv:1912.12294" and b[2]["sources"] == ["OpenAlex"] and b[1]["normalized_title"] == "motionplanningfordriving"
    links = spark.createDataFrame([(1, "planning", "planning", True), (1, "x", "X", True), (3, "planning", "P", True), (2, "safety", "s", False)], LINKS)
    assert {r["direction_label"] for r in lib.relabel(links, curated.directions(spark)).collect()} == {"运动规划与控制", "X", "P", "s"}
    assert lib.delete_rows(links, links.where("direction = 'x'"), ["paper_id", "direction"]).count() == 3
    p, out = lib.clean_relevance(papers.withColumn("is_relevant", F.lit(None).cast("boolean")), links, [("planning", "", ""), ("safety", "", "")])
    flags = {(r["paper_id"], r["direction"]): r["is_relevant"] for r in out.collect()}
    assert flags == {(1, "planning"): True, (1, "x"): True, (3, "planning"): False, (2, "safety"): True}
    assert {r["id"]: r["is_relevant"] for r in p.collect()} == {1: True, 2: True, 3: False, 4: None}


def test_workers(spark, papers):
    p = papers.withColumn("embedding_model", F.when(F.col("id") == 1, "m")).withColumn("embedding", F.when(F.col("id") < 3, F.array(F.lit(1.0))))
    assert {r["id"] for r in lib.pending(p, "embedding", "embedding_model", "m").collect()} == {2, 3, 4}
    out, n = lib.apply_delta(papers.select("id", "title", "year"), spark.createDataFrame([(1, 2020, 5), (2, 2000, None), (9, 1, 1)], "id long, year int, citations int"))
    assert n.first()["changed"] == 2 and {r["id"]: (r["year"], r["citations"]) for r in out.collect()}[2] == (2000, None)
    digest = tx.content_hash(F.col("title"), F.col("abstract"))
    cache = papers.where("id < 3").select("id", digest.alias("digest"), F.lit("译").alias("translation"), F.when(F.col("id") == 1, "m").otherwise("old").alias("model"))
    hit, todo = lib.cached_translations(papers, cache, digest, "m")
    assert [r["id"] for r in hit.collect()] == [1] and {r["id"] for r in todo.collect()} == {2, 3, 4}


# ---------------------------------------------------------------- daily
def test_directions_of_the_day():
    assert dy.choose_directions([], [("a", 2.0, True), ("b", 1.0, False)], [("b", 5.0), ("c", 5.0)]) == (["a"], {"a": 2.0})
    assert dy.choose_directions([], [("b", 1.0, False)], [("b", 5.0), ("c", 5.0)]) == (["c"], {"c": 1.5})
    assert dy.choose_directions(["x"], [], []) == (["x"], {"x": 1.0})
    assert dy.neighbours_of(["a", "b"], [("a", "b"), ("a", "c"), ("b", "c"), ("b", "d")], ["d"]) == ["c"]
    assert [dy.per_direction(x) for x in ("9", 0, None, 1)] == [2, 1, 2, 1]


def test_picks(spark):
    rows = [("a", 1, 0.9), ("a", 2, 0.8), ("b", 1, 0.9), ("b", 3, 0.1), ("c", 3, 0.9), ("c", 4, 0.2), ("d", 5, 0.5)]
    df = spark.createDataFrame([(d, i, s, False, 2020) for d, i, s in rows], "direction string, paper_id long, score double, is_saved boolean, year int")
    got = [(r["kind"], r["direction"], r["paper_id"], r["rank"]) for r in dy.pick(df, ["a", "b"], ["x", "c", "d"], 2).collect()]
    assert got == [("personal", "a", 1, 0), ("personal", "a", 2, 1), ("personal", "b", 3, 0), ("exploration", "c", 4, 0)]
    assert dy.pick(df.where("false"), ["a"], [], 2).count() == 0


def test_candidates_follow_rules(spark):
    rows = [(1, "Motion planning for driving", "a planner", 2023), (2, "Learning by Cheating", "", 2019), (3, "Soup", "cooking", 2023), (4, "Motion planning of lidar", "bad words", 2023), (5, "Motion planning of cars", "x", 2023)]
    papers = spark.createDataFrame([(*r, "ICRA", 5, None, None, None) for r in rows], "id long, title string, abstract string, year int, venue string, citations long, citation_percentile double, published_date string, is_relevant boolean")
    links = spark.createDataFrame([(i, "planning", True) for i in range(1, 6)], "paper_id long, direction string, is_relevant boolean")
    state = spark.createDataFrame([(5, False, False, True)], "paper_id long, is_read boolean, is_saved boolean, is_hidden boolean")
    history = spark.createDataFrame([(1, "z", "2024-01-30")], "paper_id long, direction string, shown_on string").withColumn("shown_on", F.to_date("shown_on"))
    rules = spark.createDataFrame([("planning", "bad", "exclude")], "direction string, term string, mode string")
    ask = lambda window="all", n=2: {r["paper_id"]: r["recently_shown"] for r in dy.candidates(papers, links, state, history, rules, "2024-02-01", {"planning": ("", "")}, {}, window, n).collect()}
    assert ask() == {1: True, 2: False} and ask(n=1) == {2: False}
    assert ask("classic") == {2: False} and ask("1y") == {1: True}


def test_snapshots(spark, tmp_path):
    s, calls = dy.Snapshots(spark, f"file://{tmp_path}/snap"), []

    def compute():
        calls.append(1)
        return spark.createDataFrame([("personal", "a", 1, 0), ("personal", "a", 2, 1), ("exploration", "b", 3, 0)], "kind string, direction string, paper_id long, rank int")

    assert s.of("2024-02-01", "all", compute).count() == 3 and s.of("2024-02-01", "all", compute).count() == 3 and len(calls) == 1
    s.forget("2024-02-01", 2)
    left = s.of("2024-02-01", "all", compute)
    assert {r["paper_id"] for r in left.collect()} == {1, 3}
    papers = spark.createDataFrame([(1, "A", None), (3, "C", True)], "id long, title string, is_relevant boolean")
    links = spark.createDataFrame([(1, "a", True), (3, "b", True)], "paper_id long, direction string, is_relevant boolean")
    state = spark.createDataFrame([(1, True, False)], "paper_id long, is_saved boolean, is_hidden boolean")
    assert [(r["kind"], r["title"], r["is_saved"]) for r in dy.show_snapshot(left, papers, links, state).collect()] == [("exploration", "C", False), ("personal", "A", True)]
    h = dy.add_history(spark.createDataFrame([(1, "a", "2024-02-01")], "paper_id long, direction string, d string").select("paper_id", "direction", F.to_date("d").alias("shown_on")), left, "2024-02-01")
    assert h.count() == 2
    s.forget("2024-02-01")
    s.of("2024-02-01", "all", compute)
    assert len(calls) == 2


# ---------------------------------------------------------------- services and models
def test_citations_and_links(spark):
    works = spark.createDataFrame([("https://x.org/W1", ["https://x.org/W2", "W3"]), ("W2", ["W1"]), ("W4", None)], "id string, referenced_works array<string>")
    assert {(r["relation"], r["other"]) for r in services.citation_neighbours(works, "W1").collect()} == {("reference", "W2"), ("reference", "W3"), ("cited_by", "W2")}
    assert services.id_batches(["a", "b", "c"], 2) == ["a|b", "c"] and services.clamp_search(" ab ", "99") == ("ab", 50)
    pages = spark.createDataFrame([(1, "http://h.org/x/", '<meta name="citation_pdf_url" content="/a.pdf?x=1&amp;y=2"><a href="b.pdf">b</a><a href="mailto:x.pdf">m</a>'), (2, None, None)], "page_id long, url string, html string")
    assert [r["url"] for r in services.resolve_links(pages).orderBy("page_id", "position").collect()] == ["http://h.org/a.pdf?x=1&y=2", "http://h.org/x/b.pdf"]
    site = {"p": b"<html>", "q": b"%PDF-1.4"}
    assert services.worklist(["p", "none"], lambda u: ["q"], site.get) == ("q", b"%PDF-1.4") and services.worklist(["none"], lambda u: [], site.get) is None


def test_parsers(spark, tmp_path):
    lines = spark.createDataFrame([(1, 0, '{"result": {"layoutParsingResults": [{"markdown": {"text": "A ![](i/x.png)", "images": {"i/x.png": "u"}}}, {"markdown": {"text": "B"}}]}}'), (1, 1, "broken")], "doc long, line int, json string")
    out = services.ocr_pages(lines).first()
    assert out["markdown"] == "A ![](assets/page-001-x.png)\n\n---\n\nB" and out["assets"] == ["assets/page-001-x.png"]
    assert services.promote_headings("Introduction\ntext\n2.1 The Model Used\nmore") == "## Introduction\ntext\n### 2.1 The Model Used\nmore"
    good = services.Parsed("x" * 600, "b", pages=1, images=0)
    assert services.parse(b"", [("a", lambda _: 1 / 0), ("n", lambda _: None), ("b", lambda _: good)], services.complete) is good
    with pytest.raises(ValueError, match="SOURCE_QUALITY"):
        services.parse(b"", [("c", lambda _: services.Parsed("x", "c"))], services.complete)
    assert services.reuse({"pdf_sha256": "a"}, "a") and not services.reuse({"pdf_sha256": None}, None)
    clock = iter(range(100))
    states = iter([("busy", None), ("done", 7)])
    assert services.poll(lambda: "j", lambda j: next(states), 1, 50, lambda: next(clock), lambda s: None) == 7
    with pytest.raises(TimeoutError):
        services.poll(lambda: "j", lambda j: ("busy", None), 1, 5, lambda: next(clock), lambda s: None)
    (tmp_path / "env").write_text("A=1\nA=2\n# B=3\nexport C='x y'\nD=file\n")
    assert services.read_settings(tmp_path / "env", {"D": "mine"}) == {"A": "1", "C": "x y", "D": "mine"}
    sent = []
    assert services.notify("y" * 5000, sent.append) and len(sent[0]) == 3900 and not services.notify("x") and not services.notify("x", lambda t: 1 / 0)
    assert services.publish(tmp_path / "d", "m", ["bad"], {}).name == "candidate.md" and services.publish(tmp_path / "d", "m", [], {}).name == "final.md" and services.invalidate(tmp_path / "d") == 3


def test_model_answers(spark, papers):
    s = spark.createDataFrame([('{"summary_zh": " 好 ", "innovations_zh": ["a", "", "b", "c", "d"]}',), ("broken",)], "a string").select(cards.normalize_summary(F.col("a")).alias("s")).select("s.*").collect()
    assert (s[0]["summary_zh"], s[0]["innovations_zh"], s[0]["method_zh"]) == ("好", ["a", "b", "c"], "摘要未说明") and s[1]["innovations_zh"] == ["摘要未说明"]
    known = [(k, label) for k, (label, _) in curated.DIRECTIONS.items()]
    cache = _empty(spark, "id long, digest string, result string")
    out, new = providers.classify(papers, cache, "id", tx.content_hash(F.col("title")), known)
    assert {r["id"]: r["result"]["primary_direction"] for r in out.collect()}[1] == "planning" and new.count() == 0
    tries = []

    def ask(text):
        tries.append(text)
        if len(tries) < 2:
            raise OSError
        return text.upper()

    asked = providers.ask_each(papers.where("id in (1, 4)").coalesce(1), F.col("title"), lambda t: t.upper())
    assert {r["id"]: r["answer"] for r in asked.collect()} == {1: "MOTION PLANNING FOR DRIVING", 4: None}
    body = spark.createDataFrame([("# T\n> 来源：x\n\nskip\n\n## 方法\n\n$$x$$\n---\n文",)], "m string").select(cards.reader_body(F.col("m")).alias("b")).first()["b"]
    assert body.startswith("## 方法") and "\n$$\nx\n$$\n" in body and "---" not in body
    links = papers.select("id", cards.directions_of(F.when(F.col("id") == 3, F.array(F.lit("z"))), F.col("direction")).alias("d")).collect()
    assert {r["id"]: r["d"] for r in links} == {1: ["planning"], 2: [], 3: ["z"], 4: []}
    t = spark.createDataFrame([("[[PL_MATH_000001]] [[PL_MATH_000009]]", ["[[PL_MATH_000001]]"])], "t string, k array<string>")
    assert t.select(cards.unknown_tokens(F.col("t"), F.col("k")).alias("u")).first()["u"] == ["[[PL_MATH_000009]]"]
    prompt = papers.where("id = 1").select(cards.classification_prompt(F.col("title"), F.col("abstract"), F.col("venue"), known).alias("p"), cards.summary_prompt(F.col("title"), F.col("abstract")).alias("s")).first()
    assert "车辆控制" in prompt["p"] and "Motion planning" in prompt["s"]
    external = spark.createDataFrame([("W7", "T", 2020, 3)], "id string, title string, publication_year int, cited_by_count long")
    col = lambda n: F.col(n) if n in external.columns else F.lit(None)
    none = lambda n: F.lit(None)
    got = external.select(*cards.compact_paper(none, col, "reference", F.lit(0.0), False)).first()
    assert (got["id"], got["year"], got["citations"], got["local"]) == ("W7", 2020, 3, False)
