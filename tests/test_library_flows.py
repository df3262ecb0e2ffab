"""Digests, the legacy list's fallback and summaries, in their corner cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import cards
from paperloom.operators import daily as dy
from paperloom.operators import relational as ra

PICKS = "kind string, direction_label string, rank int, id long, title string, year int, pdf_url string"


def test_digest_folds_what_is_explored(spark):
    rows = [
        ("exploration", "B", 1, 5, "e1", 2020, None), ("exploration", "A", 0, 6, "e0", None, ""), ("personal", "B", 0, 2, "b", 2021, "http://x"), ("personal", "A", 1, 3, None, 2022, None), ("personal", "A", 1, 1, "tie", 2022, None),
        ("personal", None, 0, 9, "bare", 1999, None),
    ]
    got = [(r.section, r.markdown) for r in dy.digest(spark.createDataFrame(rows, PICKS)).orderBy("position").collect()]
    assert got == [
        ("", "## \n\n1. bare (1999)"), ("A", "## A\n\n1. tie (2022)\n2.  (2022)"), ("B", "## B\n\n1. [b](http://x) (2021)"), ("Exploration", "## Exploration\n\n1. e0\n2. e1 (2020)"),
    ]
    assert dy.digest(spark.createDataFrame([], PICKS)).count() == 0


def test_a_direction_named_like_the_last_section_stays_apart(spark):
    rows = [("exploration", "x", 0, 1, "e", 1, None), ("personal", "Exploration", 0, 2, "p", 1, None)]
    got = dy.digest(spark.createDataFrame(rows, PICKS)).orderBy("position").collect()
    assert [(r.section, r.position) for r in got] == [("Exploration", 1), ("Exploration", 2)] and "e (1)" in got[1].markdown


def test_legacy_list_falls_back_to_the_most_cited(spark):
    p = spark.createDataFrame([(1, 10, 2026, "A"), (2, None, None, None), (3, 99, 2020, "C"), (4, 99, 2026, "B")], "id long, citations long, year int, rank string")
    links = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (1, "b")], "paper_id long, direction string")
    w = spark.createDataFrame([("a", 1.0), ("c", 5.0)], "direction string, weight double")
    assert [tuple(r) for r in ra.legacy_recommend(p, links, w.limit(0)).collect()] == [(3, 99.0), (4, 99.0), (1, 10.0), (2, 0.0)]
    assert [r.id for r in ra.legacy_recommend(p, links, w).collect()] == [1, 2]  # weights there: only linked papers, uncited ones at 0
    assert ra.legacy_recommend(p, links, w.where("direction = 'c'")).count() == 0  # preferences that nothing meets are no reason to fall back
    assert ra.legacy_recommend(p.limit(0), links, w.limit(0)).count() == 0


def test_summaries_are_trimmed_of_spaces_and_not_of_digits(spark):
    a = spark.createDataFrame([('{"innovations_zh": ["0 first 0", " second ", "", "2 third 2", "fourth"]}',)], "a string")
    s = a.select(cards.normalize_summary(F.col("a")).alias("s")).first().s
    assert s.innovations_zh == ["0 first 0", "second", "2 third 2"] and s.summary_zh == cards.NOT_STATED
