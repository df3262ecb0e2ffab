"""The trigram index against scans."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from paperloom.operators import search_index
from paperloom.operators.search_index import TrigramIndex


@pytest.fixture(scope="module")
def rows():
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdéß") for _ in range(r.randint(1, 5)))
    text = lambda n: " ".join(word() for _ in range(r.randint(0, n)))
    out = [(i * 3, text(4).title(), text(60), r.choice([None, text(2)]), round(r.random() * r.choice([0, 1]), 2)) for i in range(300)]
    return out + [(2000 + i, "copy", "a copied text 漢字😀漢", None, 0.25) for i in range(60)] + [(5000, None, None, None, 0.0), (5001, "", "ab", "", 0.3)]


@pytest.fixture(scope="module")
def index(spark, rows, tmp_path_factory):
    df = spark.createDataFrame(rows, "id long, title string, abstract string, venue string, prior double")
    root = f"file://{tmp_path_factory.mktemp('index')}"
    TrigramIndex.build(spark, root, df, ("title", "abstract", "venue"), F.col("prior"), block_rows=40, buckets=5)
    return TrigramIndex(spark, root, ("title", "abstract", "venue"), buckets=5)


def _whole(row):
    return " ".join(c for c in row[1:4] if c is not None).lower()


@pytest.mark.parametrize("query", ["abc dé", "abcd bcda aab ab", "copied 漢字😀", "zzzz", "ab", "", "abc abc bßa", "x copied"])
def test_ranked_equals_a_scan(spark, rows, index, query):
    saved = {3, 9, 2005, 5000}
    words = [w for w in query.lower().split() if len(w) > 1]
    want = []
    for row in rows:
        share = sum(w in _whole(row) for w in words) / len(words) if words else 0
        want.append((not (row[0] in saved), -round(0.8 * share + 0.2 * row[4], 6), row[0]))
    want = [(i, not s, -score) for s, score, i in sorted(want) if score < 0][:20]
    got = index.ranked(query, spark.createDataFrame([(i,) for i in [*saved, 3]], "id long"), limit=20)
    assert [tuple(r) for r in got.collect()] == [pytest.approx(w) for w in want]


@pytest.mark.parametrize("query", ["abc", "a_c", "ab%cd", "COPIED", "b", "é d", "no such", "漢字😀"])
def test_like_equals_a_scan(spark, rows, index, query):
    df = spark.createDataFrame(rows, "id long, title string, abstract string, venue string, prior double")
    scan = df.where(" OR ".join(f"coalesce({c} ILIKE '%{query}%', false)" for c in ("title", "abstract", "venue")))
    assert sorted(r["id"] for r in index.like(query).collect()) == sorted(r["id"] for r in scan.collect())


def test_only_blocks_with_candidates_are_read(index):
    read = index.like("copied")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [block" in read and "PushedFilters" in read


def test_a_block_of_several_chunks(spark, tmp_path):
    rows = [(i, f"{i:04d} " + ("marked" if i % 7 == 0 else "plain"), (i % 10) / 10) for i in range(1500)]
    index = TrigramIndex.build(spark, f"file://{tmp_path}", spark.createDataFrame(rows, "id long, title string, prior double"), ("title",), F.col("prior"))
    assert sorted(r["id"] for r in index.like("marked").collect()) == list(range(0, 1500, 7))
    want = sorted(((round(0.8 + 0.02 * (i % 10), 6), i) for i in range(0, 1500, 7)), key=lambda x: (-x[0], x[1]))[:30]
    assert [(pytest.approx(r["score"]), r["id"]) for r in index.ranked("marked", spark.createDataFrame([], "id long"), limit=30).collect()] == want


def test_an_empty_index(spark, tmp_path):
    df = spark.createDataFrame([], "id long, title string, prior double")
    index = TrigramIndex.build(spark, f"file://{tmp_path}", df, ("title",), F.col("prior"))
    assert index.like("abc").collect() == index.ranked("abc", df.select("id")).collect() == []


def test_grams():
    assert len(search_index.grams_of("abcabc")) == 3 and len(search_index.grams_of("ab")) == len(search_index.grams_of("")) == 0
    assert len(set(search_index.grams_of("a😀b漢c").tolist())) == 3
