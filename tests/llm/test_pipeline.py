"""The pipeline's stages on awkward tables."""

from __future__ import annotations

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, Score string, h1 int, Aside string, copies int"


def _words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(1, 7))) for _ in range(n))


def test_stages_on_awkward_rows(spark):
    a, b = _words(1, 200), _words(2, 60)
    rows = [(1, a, "en", "s"), (2, a, "en", "s"), (3, b, None, None), (3, b + " x", "en", "s"), (None, _words(3, 50), "en", None), (5, None, "en", "s"), (6, "", None, "s"), (7, "é漢😀 " * 20_000, "de", "t"), (8, _words(4, 80), "en", "s")]
    docs = spark.createDataFrame([(*r, len(r[1] or ""), "x", 1, "y", 2) for r in rows], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        got = out.collect()
        if name == "jaccard_join":
            assert sorted((r["doc_id"] or 0, r["text"] or "") for r in got) == sorted([(1, a), (3, min(r[1] for r in rows if r[0] == 3 and r[1] in {x["text"] for x in got})), (0, rows[4][1]), (5, ""), (6, ""), (7, rows[7][1]), (8, rows[8][1])])
        if name != "sentencepiece":
            assert out.columns == docs.columns and all((r["Score"], r["h1"], r["Aside"], r["copies"]) == ("x", 1, "y", 2) for r in got)
        else:
            assert len(got) == docs.count() and all(r["exact"] for r in got)


def test_stages_on_an_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        assert out.count() == 0 and (name == "sentencepiece" or out.columns == docs.columns)


def test_a_group_of_counts_takes_little_memory():
    import tracemalloc

    import numpy as np

    from paperloom.llm.common import _count_bucket, low40, message_frame

    r = np.random.default_rng(1)
    keys = [np.unique(r.integers(0, 1 << 22, 20_000, dtype=np.uint64)) for _ in range(50)]
    frame = message_frame([(3, b, low40(k).tobytes(), np.ones(len(k), np.uint8).tobytes()) for b, k in enumerate(keys)])
    tracemalloc.start()
    out = _count_bucket(frame)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    every = np.concatenate(keys)
    times = np.bincount(every.astype(np.int64))[every.astype(np.int64)]
    assert b"".join(out["codes"]) == np.where(times < 2, 0, 1 + np.floor(4 * np.log2(times))).astype(np.uint8).tobytes()
    assert peak < 50 * len(every)


def test_groups_give_memory_back(spark, monkeypatch):
    from pyspark.sql import GroupedData

    from paperloom.llm import jaccard_join, suffix_dedup

    names, plain = [], GroupedData.applyInPandas
    monkeypatch.setattr(GroupedData, "applyInPandas", lambda self, f, schema: names.append(f.__qualname__) or plain(self, f, schema))
    docs = spark.createDataFrame([(1, _words(1, 200)), (2, _words(2, 60))], "doc_id long, text string")
    suffix_dedup.suffix_dedup(spark, docs)
    jaccard_join.near_unique(spark, docs)
    assert sorted(n.split(".")[0] for n in names) == ["_join_runs"] + 6 * ["lean_group"]


def test_mixing_starts_no_python_workers(spark, monkeypatch):
    from paperloom.llm.mixing import mix

    docs = spark.range(20).selectExpr("id as doc_id", "concat('a b ', id) as text", "if(id % 3 = 0, null, concat('s', id % 3)) as source")

    def refuse(*_, **__):
        raise AssertionError("rows made by Python workers")

    monkeypatch.setattr("pyspark.SparkContext.parallelize", refuse)
    assert sorted((r["source"] or "", r["source_size"]) for r in mix(spark, docs).select("source", "source_size").distinct().collect()) == [("", 21), ("s1", 21), ("s2", 18)]
