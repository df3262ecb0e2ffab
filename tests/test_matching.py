"""One-pass matching against the patterns themselves, and rules in bulk."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from paperloom.functions import matching, relevance
from paperloom.functions.matching import Matcher, anchors


def _piece(r):
    words = "autonomous driving vehicle vehicles car urban system self-driving self driving automated driverless intelligent road control planning steering carla lidar bird birds-eye bird's eye bev v2x slam x_bev bevx drone uav cancer tumour tumor patients patient protein 自动驾驶 驾驶 肿瘤 农业 prediction forecasting motion reinforcement learning uncertainty lane end-to-end end to directly trajectory world model llm racing formula student high-speed"
    return r.choice(words.split() + [" ", "  ", "\n", "filler " * 5, "-", ".", "é", "_"])


def test_signals_equal_the_patterns():
    groups = relevance.GROUPS + tuple((k, (p,)) for k, p in relevance.CLASSIFIER)
    match, r = Matcher(relevance.BUILT_IN, groups), random.Random(3)
    fired = set()
    for _ in range(4000):
        text = " ".join(_piece(r) for _ in range(r.randint(0, 14))) if r.random() < 0.5 else "".join(_piece(r) for _ in range(r.randint(0, 9)))
        want = [t for t in sorted(relevance.BUILT_IN) if t in text] + [n for n, ps in groups if any(re.search(p, text, re.ASCII) for p in ps)]
        assert match(text) == want, text
        fired |= set(want)
    assert {n for n, _ in groups} <= fired
    assert match(None) == match("") == []


@pytest.mark.parametrize("pattern,needs", [("ab.{0,4}(cd|ef)", [{"ab"}, {"cd", "ef"}]), (r"\bbev\b|lidar", [{"bev", "lidar"}]), ("tumou?r", [{"tumo"}]), ("x*", []), ("self[- ]driving", [{"self"}, {"driving"}]), ("(a|bcd)e", [{"a", "bcd"}, {"e"}])])
def test_anchors(pattern, needs):
    assert sorted(map(sorted, anchors(pattern))) == sorted(map(sorted, needs))


def test_every_match_holds_the_anchors():
    r = random.Random(4)
    patterns = [*relevance.AUTONOMY, *relevance.ROBOTICS, *relevance.RACING, *relevance.OFF_DOMAIN, *(p for _, p in relevance.CLASSIFIER)]
    for _ in range(3000):
        text = " ".join(_piece(r) for _ in range(8))
        for p in patterns:
            if re.search(p, text, re.ASCII):
                assert all(any(w in text for w in c) for c in anchors(p)), (p, text)


def test_ten_thousand_rules(spark):
    df = spark.createDataFrame([(1, "t17 and t9999x"), (2, "T3 needed"), (3, None), (4, "needed")], "id int, text string")
    rules = [("all" if i % 2 else "d1", f"T{i}", "exclude") for i in range(10_000)] + [("d2", "needed", "require"), ("d2", "", "exclude")]
    began = time.time()
    out = df.select("id", matching.rejected(F.lower("text"), rules, ["d1", "d2"]).alias("r"))
    out._jdf.queryExecution().executedPlan()
    assert time.time() - began < 3
    assert {r["id"]: r["r"] for r in out.collect()} == {1: ["d1", "d2"], 2: ["d1", "d2"], 3: ["d2"], 4: []}


def test_rules_equal_contains(spark):
    r = random.Random(6)
    texts = [(i, "".join(r.choice("abcd") for _ in range(r.randint(0, 12)))) for i in range(80)]
    rules = [(r.choice(["all", "d1", "d2"]), "".join(r.choice("abcdA") for _ in range(r.randint(1, 4))), r.choice(["exclude", "exclude", "require"])) for _ in range(9)]
    out = spark.createDataFrame(texts, "id int, text string").select("id", "text", matching.rejected(F.col("text"), rules, ["d1", "d2"]).alias("r"))
    for row in out.collect():
        bad = lambda s: any((t.lower() in row["text"]) == (m == "exclude") for d, t, m in rules if d in ("all", s))  # noqa: B023, E731
        assert row["r"] == [s for s in ("d1", "d2") if bad(s)]


def test_one_pass_for_all_directions(spark):
    df = spark.createDataFrame([("Planning for cars", "self-driving", None)], "title string, abstract string, venue string")
    directions = [("planning", "", ""), ("mine", "robot arms", "grasp"), ("yours", "graph", "")]
    terms = relevance.vocabulary(directions)
    text = [F.col(c) for c in df.columns]
    plan = df.select(*[f(*text, *d, terms).alias(f"{f.__name__}{i}") for i, d in enumerate(directions) for f in (relevance.relevance_score, relevance.is_likely_relevant)])
    shown = plan._jdf.queryExecution().optimizedPlan().toString()
    assert shown.count("found(lower(concat_ws") == 1


def test_broken_rules_are_looked_up_once(spark):
    """A join on the answer asked first whether it is null, by one more call in workers of its own."""
    from paperloom.functions.matching import rejected

    df = spark.createDataFrame([(1, "a bad text"), (2, None), (3, "good")], "id int, text string")
    judged = df.select("id", rejected(F.col("text"), [("all", "bad", "exclude"), ("d1", "good", "require")], ["d1", "d2"]).alias("broken"))
    links = spark.createDataFrame([(i, d) for i in (1, 2, 3) for d in ("d1", "d2")], "id int, d string")
    out = judged.join(links, "id").where(~F.array_contains("broken", F.col("d")))
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert sorted((r["id"], r["d"]) for r in out.collect()) == [(2, "d2"), (3, "d1"), (3, "d2")]


def test_signals_come_from_small_batches(spark):
    from paperloom.functions.matching import signals

    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    df = spark.range(5000).select(F.when(F.col("id") % 3 > 0, F.concat(F.lit("lidar "), F.col("id"))).alias("t"))
    got = df.select(F.size(signals(F.col("t"), ("lidar", "camera"))).alias("n")).groupBy("n").count().collect()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "2000"
    assert {r["n"]: r["count"] for r in got} == {0: 1667, 1: 3333}
