"""The entry points over the model tables, and the job helpers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from paperloom.api import Library
from paperloom.functions.providers import apply_cached, embed
from paperloom.operators import jobs
from paperloom.operators.daily import Snapshots
from paperloom.plans.views import model

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library(spark):
    names = ("papers", "paper_directions", "paper_user_events", "feedback")
    t = {n: model(spark, DATA, n) for n in names}
    v = spark.read.parquet(f"{DATA}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    t["papers"] = t["papers"].join(v, "id", "left")
    t["history"] = spark.sql("SELECT 1L AS paper_id, 'd1' AS direction, DATE'2024-01-31' AS shown_on")
    t["rules"] = spark.sql("SELECT 'all' AS direction, 'zzzz' AS term, 'exclude' AS mode")
    t["custom_directions"] = spark.createDataFrame([(f"d{k}", f"direction {k}", "the tion") for k in range(10)], "key string, label string, query string")
    t["neighbours"] = spark.createDataFrame([("d1", "d2", 0), ("d1", "d5", 1)], "direction string, neighbour string, position int")
    return Library(spark, t)


def test_search_and_related(spark, library):
    q = library.t("papers").where("id = 3").select(F.col("embedding").alias("q"))
    hits = library.search_papers("the reason", vector=q, limit=10, as_of="2024-02-01").collect()
    assert len(hits) == 10 and all(0 < h["score"] and h["directions"] for h in hits)
    assert library.search_papers(direction="d3", limit=500, as_of="2024-02-01").count() <= 100
    assert library.related_papers(3).count() == 8 and library.paper_detail(3).first()["directions"]
    assert library.recommend(["d1", "d4"], 7, "2024-02-01").count() == 7 and library.recommend(["none"], 5, "2024-02-01").count() == 5


def test_daily(library):
    rows = library.daily_recommendations("2024-02-01", ["d1", "d2", "d3"], 2).collect()
    own = [r for r in rows if r["kind"] == "personal"]
    assert len(own) == 6 and len({r["paper_id"] for r in rows}) == len(rows) == 7 and {r["direction"] for r in own} == {"d1", "d2", "d3"}
    assert [r["direction"] for r in rows if r["kind"] == "exploration"] == ["d5"]  # a neighbour that wasn't asked for
    assert 1 <= library.daily_recommendations("2024-02-01", limit=1).where("kind = 'personal'").count() <= 8


def test_daily_snapshot(spark, library, tmp_path):
    mine, s = Library(spark, dict(library.tables)), Snapshots(spark, f"file://{tmp_path}/snap")
    mine.tables["history"] = library.t("history").where("shown_on < '2024-02-01'")
    first = mine.daily_recommendations("2024-02-01", ["d1"], 2, snapshots=s).collect()
    assert mine.daily_recommendations("2024-02-01", ["d2"], 1, snapshots=s).collect() == first  # keyed by day and window only
    assert mine.t("history").where("shown_on = '2024-02-01'").count() == len(first)


def test_library(spark, library):
    mine = Library(spark, dict(library.tables))
    bodies = spark.createDataFrame([("X1", None, "New paper", 2020, None, None, None, None, None)], "id string, doi string, title string, year int, venue string, authors string, abstract string, pdf_url string, source string")
    mine.tables["papers"] = mine.t("papers").withColumns({"openalex_id": F.col("id").cast("string"), "doi": F.lit(None).cast("string")})
    assert not mine.save(bodies, "2024-02-01").first()["already_existed"] and mine.save(bodies, "2024-02-02").first()["already_existed"]
    c = mine.import_library("@misc{z,\n title = {Motion planning for self-driving cars},\n year = 2021\n}\n", "2024-02-03").first()
    assert (c["entries"], c["inserted"], c["duplicates"]) == (1, 1, 0) and c["linked"] > 0
    assert mine.create_direction("Tea and milk", "tea milk") == "tea-and-milk"
    assert mine.search_papers(view="classic", as_of="2024-02-01").count() == 0
    with pytest.raises(ValueError):
        mine.search_papers(view="nothing")


def test_actions(spark, library):
    mine = Library(spark, dict(library.tables))
    mine.apply_user_action(7, "hide", "2024-03-01")
    assert 7 not in [r["id"] for r in mine.search_papers(limit=100, as_of="2024-02-01").collect()]
    mine.apply_user_action(7, "unhide", "2024-03-02")
    assert not mine.user_state().where("paper_id = 7").first()["is_hidden"]
    with pytest.raises(ValueError):
        mine.apply_user_action(7, "explode", "2024-03-01")
    title, year = library.t("papers").where("id = 4").select("title", "year").first()
    title = title.replace("\n", " ").replace("{", "").replace("}", "")
    found = mine.import_bibtex(f"@misc{{a,\n title = {{{title}}},\n year = {year}\n}}\n@misc{{b,\n title = {{Never seen before}},\n year = 1999\n}}\n").collect()
    assert {r["key"]: r["matched_id"] is not None for r in found} == {"a": True, "b": False}


def test_small_tables(spark, library, tmp_path):
    mine = Library(spark, {k: v for k, v in library.tables.items() if k != "rules"})
    assert mine.set_preference("d1", 9).first()["weight"] == 2.0 and mine.set_preference("d1", 1, False).count() == 1
    with pytest.raises(ValueError):
        mine.set_preference("nowhere")
    assert mine.add_rule("all", " Tea ", "exclude").count() == 1 and mine.add_rule("all", "tea", "exclude").count() == 1 and mine.remove_rule("all", "TEA", "exclude").count() == 0
    with pytest.raises(ValueError):
        mine.add_rule("all", "x", "maybe")
    mine.put_cluster("one", {"d1": 1, "d2": 7})
    r = mine.put_cluster("one", {"d3": 0.1}, "#fff").first()
    assert (r["color"], [(d["direction"], d["weight"]) for d in r["directions"]]) == ("#fff", [("d3", 0.5)]) and mine.remove_cluster("one").count() == 0
    n = mine.t("feedback").count()
    assert mine.put_feedback(1, "d1", "partial", "2024-02-01").count() == n + 1
    with pytest.raises(ValueError):
        mine.put_feedback(1, "d1", "maybe", "2024-02-01")
    assert len(mine.evidence(3).first()["cards"]) == 5
    text = "Abstract. " + "we ask what is known of it " * 8 + "method " + "x" * 10
    assert mine.put_evidence(3, text).first()["cards"][0]["content"].startswith("we ask") and mine.evidence(3).first()["cards"][0]["source"] == "PDF 全文文本"
    answer = '{"primary_direction": "planning", "secondary_directions": ["d1"], "confidence": 0.9}'
    calls = []
    out = mine.classify(3, lambda d: calls.append(1) or d.withColumn("result", F.lit(answer))).first()
    assert out["primary_direction"] == "planning" and mine.t("paper_directions").where("paper_id = 3 and direction = 'planning'").count() == 1
    assert mine.t("papers").where("id = 3").first()["direction"] == "planning" and mine.t("paper_classifications").count() == 1


def test_providers(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "a b")], "id long, text string")
    v = {r["id"]: r["embedding"] for r in embed(df, F.col("text")).collect()}
    assert v[1] == v[3] and v[2] is None and len(v[1]) == 64
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    cache = df.where("id = 1").select("id", digest.alias("digest"), F.lit("old").alias("result"))
    every, new = apply_cached(df, cache, "id", digest, lambda d: d.withColumn("result", F.lit("new")))
    assert {r["id"]: r["result"] for r in every.collect()} == {1: "old", 2: "new", 3: "new"} and new.count() == 2


def test_jobs(tmp_path):
    s, c = tmp_path / "s.json", tmp_path / "c.json"
    assert jobs.read_json(s, jobs.STATUS_DEFAULT)["status"] == "idle"
    jobs.start_status(s, 3, 1.0)
    for k in range(25):
        jobs.record_error(s, f"e{k}", 2.0)
    assert jobs.read_json(s, {})["errors"] == [f"e{k}" for k in range(5, 25)]
    assert jobs.run_stages([("a", lambda: None), ("b", lambda: 1 / 0), ("c", lambda: None)], lambda **p: jobs.update_status(s, 3.0, **p)) is False
    assert jobs.read_json(s, {})["phase"] == "b"
    jobs.write_checkpoint(c, "x", "d1", 1.0)
    assert len(jobs.write_checkpoint(c, "x", "d1", 2.0)) == 1 and len(jobs.write_checkpoint(c, "y", "d1", 2.0)) == 2
    assert jobs.is_fresh({"status": "completed", "completed_at": 100.0}, 12, 200.0) and not jobs.is_fresh({"status": "completed", "completed_at": 0.1}, 1, 3601.0)
    with jobs.exclusive(tmp_path / "lock"):
        with pytest.raises(RuntimeError), jobs.exclusive(tmp_path / "lock"):
            pass
    (tmp_path / "lock").write_text("999999999")
    with jobs.exclusive(tmp_path / "lock"):
        pass
    assert jobs.backoff(10) <= 60 and jobs.backoff(0, retry_after=7) == 7 and jobs.progress_percent("translating", 1, 1) == 92
    tries = []
    assert jobs.with_retries(lambda: tries.append(1) or (1 / 0 if len(tries) < 3 else 5), retryable=lambda e: True, sleep=lambda s: None) == 5
