"""Sources, record merging, documents, streaming and scalar functions on small hand-made inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import scoring as sc
from paperloom.functions import text as tx
from paperloom.operators import documents as doc
from paperloom.operators import relational as ra
from paperloom.sources import payloads
from paperloom.streaming import events as ev


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or ["id"]).select(column.alias("v")).first()["v"]


def cases():
    return [
        (tx.normalize_title(F.lit("Über: A-Test 自动!")), "beratest自动"), (tx.normalize_doi(F.lit("HTTPS://doi.org/10.1/AB ")), "10.1/ab"), (tx.normalize_doi(F.lit("")), None), (tx.slugify(F.lit("  Hello, World! ")), "hello-world"),
        (tx.decode_xml(F.lit("a &amp;lt; b\n c")), "a < b c"), (tx.lexical_score(F.lit("The cat"), F.lit("cat dog a")), 0.5), (tx.lexical_score(F.lit("x"), F.lit("")), 0.0), (tx.authors_display(F.lit("A, B, C, D, E")), "A, B, C, D +5"),
        (tx.arxiv_id(F.lit("2101.00001v2"), F.lit(None).cast("string")), "2101.00001v2"), (tx.decode_id(F.lit("a%252Fb")), "a/b"), (tx.decode_id(F.lit("100%")), "100%"), (tx.json_array(F.lit("oops")), []), (tx.unfence_json(F.lit("```json\n{\"a\":1}\n```")), '{"a":1}'),
        (tx.roman(F.lit("xiv")), 14), (tx.roman(F.lit("7")), 7), (tx.roman(F.lit("q")), None), (tx.safe_asset_name(F.lit("a/b c?.png")), "b_c_.png"),
        (tx.url_candidates(F.lit("http://x/land"), F.lit("10.1/a"), F.array(F.lit("http://y/z.pdf")), F.lit("2101.1")), ["http://y/z.pdf", "https://arxiv.org/pdf/2101.1.pdf", "http://x/land", "https://doi.org/10.1/a"]),
        (tx.pdf_links(F.lit('<meta name="citation_pdf_url" content="/p.pdf"><a href="/x">x</a><a href="/d/download?a=1&amp;b=2">')), ["/p.pdf", "/d/download?a=1&b=2"]),
        (F.round(sc.citation_quality(F.lit(None).cast("long"), F.lit(87.0)), 3), 0.87), (sc.citation_quality(F.lit(9999), F.lit(None).cast("double")), 1.0), (sc.citation_quality(F.lit(9), F.lit(0.0)), 0.0),
        (sc.is_frontier(F.lit(None).cast("int"), F.lit(None).cast("date"), F.lit("2024-02-01").cast("date")), False), (sc.direction_weight(F.lit(0.0), F.lit(30.0)), 2.0), (sc.direction_weight(F.lit(None).cast("double"), F.lit(None).cast("double")), 1.0),
        (sc.cosine(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0))), 0.0), (sc.cosine(F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(3.0), F.lit(4.0))), 1.0), (sc.event_weight(F.lit("hide")), -4.0), (sc.event_weight(F.lit("other")), 0.0),
    ]


def test_scalars(spark):
    for column, want in cases():
        assert one(spark, column) == want, column


def test_author_difference(spark):
    r = one(spark, tx.author_difference(F.array(F.lit("Ann Lee"), F.lit("B. Q")), F.array(F.lit("and Ann  Lee"), F.lit("C"))))
    assert (r["conflicting"], r["pdf_only"], r["db_only"]) == (True, ["b q"], ["c"])


def test_payloads_and_fold(spark):
    import json

    work = {"id": "W1", "title": "T", "authorships": [{"author": {"display_name": "A"}}, {"author": {"display_name": None}}], "publication_year": 2020, "abstract_inverted_index": {"b": [1], "a": [0, 2]}, "doi": "https://doi.org/10.1/X", "locations": [{"pdf_url": "http://p/1.pdf"}, {"pdf_url": "http://arxiv.org/pdf/2"}], "cited_by_count": 3}
    raw = spark.createDataFrame([(json.dumps(work),), (json.dumps({"id": "W2", "title": ""}),)], "j string").select(F.from_json("j", payloads.OPENALEX).alias("w")).select("w.*")
    o = payloads.openalex(raw)
    r = o.first()
    assert (o.count(), r["abstract"], r["authors"], r["doi"], r["pdf_url"]) == (1, "a b a", "A", "10.1/x", "http://arxiv.org/pdf/2")
    feed = '<feed><entry><id>http://arxiv.org/abs/2101.00001v1</id><title>A &amp; B</title><summary> long  text here </summary><published>2021-01-02T00:00:00Z</published><author><name>X</name></author></entry></feed>'
    a = payloads.arxiv(spark.createDataFrame([(feed,)], "xml string"))
    assert (a.first()["arxiv_id"], a.first()["title"], a.first()["year"]) == ("2101.00001v1", "A & B", 2021)
    s2 = spark.createDataFrame([(json.dumps({"paperId": "S", "title": "T2", "abstract": "longer text", "year": 2020, "externalIds": {"DOI": "10.1/x"}, "citationCount": 9}),)], "j string").select(F.from_json("j", payloads.SEMANTIC_SCHOLAR).alias("p")).select("p.*")
    every = o.withColumn("n", F.lit(0)).unionByName(a.withColumn("n", F.lit(1))).unionByName(payloads.semantic_scholar(s2).withColumn("n", F.lit(2)))
    m = {r["k"]: r for r in ra.fold_merge(every.withColumn("k", ra.dedupe_key(every)), "k", "n").collect()}
    assert set(m) == {"doi:10.1/x", "arxiv:2101.00001v1"}
    d = m["doi:10.1/x"]
    assert (d["title"], d["abstract"], d["citations"], d["sources"], d["published_date"]) == ("T2", "longer text", 9, ["OpenAlex", "Semantic Scholar"], "2020-01-01")
    msg = spark.createDataFrame([(json.dumps({"message": {"DOI": "10.1/X", "title": ["C"], "published": {"date-parts": [[2019, 5]]}, "container-title": ["V"]}}),)], "j string").select(F.from_json("j", payloads.CROSSREF).alias("p")).select("p.*")
    e = payloads.enrich_crossref(o, msg).first()
    assert (e["title"], e["published_date"], e["venue"], e["sources"]) == ("T", "2019-05", "V", ["OpenAlex", "Crossref"])


def test_keyed_writes(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "id long, v string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(ra.upsert(old, new, ["id"])) == [(1, "a"), (2, "B"), (3, "C")]
    assert rows(ra.insert_missing(old, new, ["id"])) == [(1, "a"), (2, "b"), (3, "C")]
    state, took = ra.compare_and_set(old, new, ["id"], F.col("v") != "b")
    assert rows(state) == [(1, "a"), (2, "b"), (3, "C")] and rows(took) == [(3,)]
    assert rows(ra.soft_filter(old, F.col("v") == "zz")) == rows(old) and rows(ra.soft_filter(old, F.col("v") == "a")) == [(1, "a")]


def test_documents():
    text = "# A\n\n" + "One two. " * 50 + "\n\n# B\n\n```\ncode\n\nmore\n```\n\n$$\nx\n\ny\n$$"
    parts = doc.chunks(text, 120)
    assert parts[0].startswith("# A") and any(p.startswith("# B") for p in parts) and any("code\n\nmore" in p for p in parts)
    assert all(len(p) <= 120 or "```" in p or "$$" in p for p in parts) and doc.chunks("", 10) == []
    assert doc.inspect("ab" * 60 + "\n<table><tr>\nnter x\n$a") == ["repeated_text:1", "orphan_fragment:3", "unbalanced_html:table", "unbalanced_html:tr", "unbalanced_math"]
    md = 'x <table><tr><td>$a$</td></tr></table> ![i](p.png) and $b^2$ costs \\$5 <img src="q">'
    hidden, kept = doc.protect(md)
    assert "$b" not in hidden and "png" not in hidden and doc.restore(hidden, kept) == md
    assert doc.fragment_issues("![a](b)\n# x", "# x") == ["images"] and doc.fragment_issues("# x", "# y") == []


def test_streaming(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(src)
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = ev.stream_daily_counts(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")))
    s.writeStream.format("memory").queryName("daily").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = {tuple(r) for r in spark.table("daily").collect()}
    want = {tuple(r) for r in batch.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n")).collect()}
    last = max(d for d, _, _ in want)
    assert got <= want and {w for w in want if (last - w[0]).days > 2} <= got


def test_lease_machine(spark):
    rows = [(1, 1, "claim", "a", 0), (2, 1, "claim", "b", 300), (3, 1, "claim", "b", 301), (4, 1, "finish", "a", 302), (5, 1, "finish", "b", 303), (6, 1, "claim", "c", 304), (7, 1, "expire", "", 604), (8, 1, "expire", "", 605), (1, 2, "heartbeat", "a", 5)]
    out = ev.run_lease_commands(spark.createDataFrame(rows, "seq int, paper_id long, command string, token string, at long")).orderBy("paper_id", "seq").collect()
    assert [r["outcome"] for r in out] == ["claimed", "refused", "claimed", "refused", "done", "claimed", "refused", "done", "refused"]


def test_multisets_terms_and_tokens(spark):
    one = spark.range(1)
    arr = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    left = lambda a, b: one.select(tx.multiset_except(arr(a), arr(b)).alias("x")).first()["x"]
    assert left(["a", "b", "a", None, "a"], ["a", "c"]) == ["b", "a", None, "a"]
    assert left(["a", None, None], [None, "a", "a"]) == [None] and left([], ["a"]) == []
    ok = lambda t, b, q: one.select(tx.passes_terms(F.lit(t), F.lit(b), F.lit(q)).alias("x")).first()["x"]
    assert ok(None, None, None) and ok("x", "y", "one") and not ok(None, "motion", "motion planning") and ok("motion", None, "motion planning")
    assert one.select(tx.tokens_once(F.lit("a$1b"), arr(["$1"])).alias("x")).first()["x"]


def test_islands_and_sequences(spark):
    df = spark.createDataFrame([("a", 1, 2), ("a", 3, 4), ("a", 9, 10), ("b", 2, 3), ("b", None, None), ("b", 3, 3)], "k string, s int, e int")
    got = {(r["k"], r["s"]): r["island"] for r in ra.adjacent_groups(df, ["k"], F.col("s"), F.col("e"), [F.col("s")], 1).collect()}
    assert got == {("a", 1): 0, ("a", 3): 0, ("a", 9): 1, ("b", None): 0, ("b", 2): 0, ("b", 3): 0}
    assert {r["k"]: r["contiguous"] for r in ra.contiguous(df.selectExpr("k", "s - 1 as n"), ["k"], "n").collect()} == {"a": False, "b": False}
    assert ra.contiguous(df.where("false"), ["k"], "s").count() == 0


def test_copy_classes_have_every_paper(spark):
    """Copies among high ids only, a large group and null texts."""
    df = spark.range(5000).select(F.col("id"), F.when(F.col("id") % 10 == 9, F.lit(None)).when(F.col("id") >= 1000, F.lit("same")).otherwise(F.col("id").cast("string")).alias("t"))
    got = {r["id"]: (r["first_id"], r["copies"]) for r in ra.copy_classes(df, "t").collect()}
    assert got == {i: (1000, 3600) if i >= 1000 and i % 10 != 9 else (i, 1) for i in range(5000)}


def test_matches_of_all_papers(spark):
    """Every row gets its matches, against pairs counted by brute force."""
    rows = [(i, [None, "", "hot", "hot", f"t{i // 2}"][i % 5], None if i % 3 == 0 else i % 2) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, k string, year int")
    want = {i: sum(i == j or (k is not None and k == k2 and y == y2) for j, k2, y2 in rows) for i, k, y in rows}
    assert {r["id"]: r["matches"] for r in ra.match_counts(df, "k", "year").collect()} == want


def test_priority_match_has_no_pairs(spark):
    """Rows of one frequent key are joined with one row, not with each other."""
    df = spark.range(3000).select("id", F.lit("hot").alias("k"))
    out = ra.match_by_priority(df.withColumnRenamed("id", "new_id"), df, [("k", F.col("k"))])
    assert out.count() == 3000 and {r["id"] for r in out.collect()} == {0}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 2


def test_queries_match_all_papers(spark):
    from paperloom.plans import catalog

    n = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert catalog.queries()["entity_match_or_all"](spark, "/root/testdata/sf0.001").count() == n
    assert {r["new_id"] % 4 for r in catalog.queries()["entity_match_priority_all"](spark, "/root/testdata/sf0.001").collect()} == {0, 1, 2, 3}


def test_whole_abstracts(spark):
    """Index, difference and embedding text of whole texts against brute force."""
    from collections import Counter

    from paperloom.plans import catalog

    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = lambda name, c: {r["id"]: r[c] for r in catalog.queries()[name](spark, sf).collect()}
    left = rows("formula_difference_whole", "remaining")
    assert max(map(len, texts.values())) > 15_000 and left.keys() == texts.keys()
    for i, t in texts.items():
        take, want = Counter(t[:80].split(" ")), []
        for w in t.split(" "):
            if take[w]:
                take[w] -= 1
            else:
                want.append(w)
        assert left[i] == " ".join(want)
    assert max(map(len, rows("inverted_index_whole", "text").values())) > 15_000 and max(map(len, rows("embedding_input_whole", "text").values())) == 6000
