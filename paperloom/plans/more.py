"""Further queries: normalisers, stored scores, keyed writes, sets and sequences."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from paperloom.functions import scoring as sc
from paperloom.functions import text as tx
from paperloom.operators import relational as ra
from paperloom.plans.registry import query
from paperloom.plans.views import AS_OF, model
from paperloom.sources import payloads

_WEIGHT = "CASE event WHEN 'save' THEN 3.0 WHEN 'library_import' THEN 2.0 WHEN 'read' THEN 1.0 WHEN 'hide' THEN -4.0 ELSE 0.0 END"
_IMPACT = "CASE WHEN citation_percentile IS NOT NULL THEN greatest(0.0, least(CASE WHEN citation_percentile > 1 THEN citation_percentile / 100 ELSE citation_percentile END, 1.0)) ELSE least(log10(coalesce(citations, 0) + 1) / 4, 1.0) END"
_FRONTIER = "CASE WHEN published_date IS NOT NULL THEN published_date >= DATE '2022-02-01' ELSE year >= 2022 END"


def _texts(spark, sf):
    """Papers without the model's join with labels, which would shuffle whole texts."""
    return spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("id"), F.substring("text", 1, 80).alias("title"), F.col("text").alias("abstract"), F.col("source").alias("venue"))


def _values(spark, rows: str, names: str):
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({names})")


# ---------------------------------------------------------------- normalisers
@query("""SELECT id, nullif(trim(lower(regexp_replace(CASE id % 4 WHEN 0 THEN concat('https://doi.org/10.1/A', id) WHEN 1 THEN concat('HTTP://DX.DOI.ORG/10.2/b', id) WHEN 2 THEN concat(' 10.3/C', id, ' ') ELSE '' END, '^https?://(dx\\.)?doi\\.org/', '', 'i'))), '') AS doi FROM papers""")
def doi_normalize(spark, sf):
    i = F.col("id").cast("string")
    raw = F.when(F.col("id") % 4 == 0, F.concat(F.lit("https://doi.org/10.1/A"), i)).when(F.col("id") % 4 == 1, F.concat(F.lit("HTTP://DX.DOI.ORG/10.2/b"), i)).when(F.col("id") % 4 == 2, F.concat(F.lit(" 10.3/C"), i, F.lit(" "))).otherwise("")
    return model(spark, sf, "papers").select("id", tx.normalize_doi(raw).alias("doi"))


@query("SELECT id, substring(regexp_replace(regexp_replace(lower(title), '[^a-z0-9\\x{4e00}-\\x{9fff}]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 48) AS slug FROM papers")
def title_slugs(spark, sf):
    return model(spark, sf, "papers").select("id", tx.slugify(F.col("title")).alias("slug"))


@query("""SELECT id, CASE WHEN len(p) > 4 THEN concat(array_to_string(p[1:4], ', '), ' +', CAST(len(p) AS VARCHAR)) ELSE a END AS shown FROM (SELECT id, a, string_split(a, ', ') AS p FROM (SELECT id, regexp_replace(substring(title, 1, 25), '[\\s,]+', ', ', 'g') AS a FROM papers) AS x) AS y""")
def author_display(spark, sf):
    return model(spark, sf, "papers").select("id", tx.authors_display(F.regexp_replace(F.substring("title", 1, 25), r"[\s,]+", ", ")).alias("shown"))


@query("SELECT id, substring(concat_ws(chr(10), nullif(title, ''), nullif(abstract, ''), nullif(venue, '')), 1, 6000) AS text FROM papers")
def embedding_input_whole(spark, sf):
    """Whole abstracts, up to the operator's own limit."""
    return _texts(spark, sf).select("id", tx.embedding_text(F.col("title"), F.col("abstract"), F.lit(None).cast("string"), F.col("venue")).alias("text"))


@query("SELECT id, id * 2 AS x, greatest((742 - id) * 2, 0) AS y, CAST(60 AS BIGINT) AS width, CAST(60 AS BIGINT) AS height FROM papers")
def bbox_crops(spark, sf):
    i = F.col("id").cast("double")
    p = model(spark, sf, "papers").select("id", sc.bbox_crop(F.array(i, i + 50, i + 30, i + 20), F.lit(792.0), 144).alias("b"))
    return p.select("id", "b.x", "b.y", "b.width", "b.height")


# ---------------------------------------------------------------- stored scores
@query(f"""SELECT id, round(0.42 * CASE WHEN f THEN 1.0 ELSE exp(-0.24 * greatest(0, 2024 - year)) END + 0.25 * (id % 4) / 3.0 + 0.18 * impact + CASE WHEN id % 50 = 0 THEN 0.15 ELSE 0 END, 6) AS score,
CASE WHEN id % 50 = 0 THEN '经典必读' WHEN f AND id % 4 = 3 THEN '顶会前沿' WHEN f THEN '近两年前沿' WHEN id % 4 = 3 THEN '高质量基础' ELSE '方向相关' END AS reason FROM (SELECT id, year, {_FRONTIER} AS f, {_IMPACT} AS impact FROM papers) AS x""")
def stored_scores(spark, sf):
    c, now = F.col, F.lit(AS_OF).cast("date")
    p = model(spark, sf, "papers").select("id", "year", sc.is_frontier(c("year"), c("published_date"), now).alias("f"), sc.citation_quality(c("citations"), c("citation_percentile")).alias("impact"))
    classic, tier = c("id") % 50 == 0, c("id") % 4
    score = sc.recommendation_score(c("f"), classic, c("year"), tier, c("impact"), now)
    return p.select("id", F.round(score, 6).alias("score"), sc.discovery_reason(classic, c("f"), tier).alias("reason"))


@query(f"""WITH s AS (SELECT d.direction AS direction, sum(e.w) AS pref FROM (SELECT paper_id, sum({_WEIGHT}) AS w FROM paper_user_events GROUP BY paper_id) AS e JOIN paper_directions AS d ON d.paper_id = e.paper_id GROUP BY d.direction)
SELECT s.direction AS direction, round(CAST(coalesce(nullif(c.w, 0.0), CASE WHEN pref > 0 THEN least(2.0, 1 + pref / 10) END, 1.0) AS DOUBLE), 6) AS weight FROM s LEFT JOIN (VALUES ('d0', 1.5), ('d1', 0.0), ('d5', 0.5)) AS c(direction, w) ON c.direction = s.direction""")
def direction_weights(spark, sf):
    e = model(spark, sf, "paper_user_events").groupBy("paper_id").agg(F.sum(sc.event_weight(F.col("event"))).alias("w"))
    pref = e.join(model(spark, sf, "paper_directions"), "paper_id").groupBy("direction").agg(F.sum("w").alias("pref"))
    chosen = _values(spark, "('d0', 1.5D), ('d1', 0.0D), ('d5', 0.5D)", "direction, configured")
    j = pref.join(F.broadcast(chosen), "direction", "left")
    return j.select("direction", F.round(sc.direction_weight(F.col("configured"), F.when(F.col("pref") > 0, F.col("pref"))), 6).alias("weight"))


# ---------------------------------------------------------------- keyed writes
@query("""SELECT id, CASE WHEN id % 2 = 0 AND citations < 300 THEN year + 100 ELSE year END AS year FROM papers WHERE id % 3 <> 0 UNION ALL SELECT id, year + 100 AS year FROM papers WHERE id % 3 = 0 AND id % 2 = 0""")
def conditional_upsert(spark, sf):
    """DML-5: rows that may not be replaced stay as they are."""
    p = model(spark, sf, "papers").select("id", "year", "citations")
    new = p.where("id % 2 = 0").withColumn("year", F.col("year") + 100)
    out, _ = ra.compare_and_set(p.where("id % 3 <> 0"), new, ["id"], F.coalesce(F.col("citations") < 300, F.lit(False)))
    return out.select("id", "year")


@query("SELECT paper_id, direction FROM paper_directions WHERE direction <> 'd2' UNION ALL SELECT id AS paper_id, 'd2' AS direction FROM papers WHERE id % 50 = 1")
def replace_children(spark, sf):
    """DML-9: the children of one parent are replaced as a whole."""
    new = model(spark, sf, "papers").where("id % 50 = 1").select(F.col("id").alias("paper_id"), F.lit("d2").alias("direction"))
    return ra.upsert(model(spark, sf, "paper_directions"), new, ["direction"])


@query("SELECT paper_id, direction FROM paper_directions UNION SELECT id AS paper_id, concat('d', CAST(id % 7 AS VARCHAR)) AS direction FROM papers")
def backfill_links(spark, sf):
    """DML-6: links of primary directions, where they are missing."""
    primary = model(spark, sf, "papers").select(F.col("id").alias("paper_id"), F.concat(F.lit("d"), (F.col("id") % 7).cast("string")).alias("direction"))
    return ra.insert_missing(model(spark, sf, "paper_directions"), primary, ["paper_id", "direction"])


@query("""WITH e AS (SELECT id FROM papers WHERE id % 3 <> 1), n AS (SELECT id FROM papers WHERE id % 2 = 0)
SELECT CAST((SELECT 2 * count(*) FROM n) AS BIGINT) AS fetched, CAST((SELECT count(*) FROM n) AS BIGINT) AS duplicates, CAST((SELECT count(*) FROM n WHERE id NOT IN (SELECT id FROM e)) AS BIGINT) AS inserted,
CAST((SELECT count(*) FROM n WHERE id IN (SELECT id FROM e)) AS BIGINT) AS updated, CAST((SELECT count(*) FROM e WHERE id NOT IN (SELECT id FROM n)) AS BIGINT) AS untouched""")
def sync_counts(spark, sf):
    """AGG-15: each record is fetched twice, then merged once."""
    p = model(spark, sf, "papers").select("id", "title", "abstract", "year", "venue", "citations", F.lit(None).cast("string").alias("doi"), F.lit(None).cast("string").alias("normalized_title"))
    new = p.where("id % 2 = 0").withColumn("citations", F.col("citations") + 1)
    return ra.sync_statistics(new.union(new), "id", ra.merge_papers(p.where("id % 3 <> 1"), new))


# ---------------------------------------------------------------- lookups and joins
@query("""WITH r AS (SELECT d.direction AS direction, p.id AS id, row_number() OVER (PARTITION BY d.direction ORDER BY p.citations DESC, p.id) - 1 AS rank FROM papers AS p JOIN paper_directions AS d ON d.paper_id = p.id),
u AS (SELECT paper_id, max(CASE WHEN event = 'save' THEN 1 ELSE 0 END) AS saved FROM paper_user_events GROUP BY paper_id)
SELECT r.direction AS direction, r.id AS id, CAST(r.rank AS INT) AS rank, p.title AS title, coalesce(u.saved, 0) AS saved FROM r JOIN papers AS p ON p.id = r.id LEFT JOIN u ON u.paper_id = r.id WHERE r.rank < 3 AND coalesce(p.is_relevant, true)""")
def snapshot_join(spark, sf):
    """JOIN-10: the day's snapshot with papers, directions and user state."""
    p = model(spark, sf, "papers").select("id", "title", "citations", "is_relevant")
    snapshot = ra.top_n(p.join(model(spark, sf, "paper_directions"), F.col("id") == F.col("paper_id")).select("direction", "id", "citations"), ["direction"], [F.desc("citations"), F.col("id")], 3)
    state = model(spark, sf, "paper_user_events").groupBy(F.col("paper_id").alias("id")).agg(F.max(F.when(F.col("event") == "save", 1).otherwise(0)).alias("saved"))
    j = snapshot.select("direction", "id", "rank").join(ra.visible(p).select("id", "title"), "id").join(state, "id", "left")
    return j.select("direction", "id", "rank", "title", F.coalesce("saved", F.lit(0)).alias("saved"))


@query("""SELECT p.id AS id, p.title AS title, (SELECT string_agg(direction, ',' ORDER BY direction) FROM paper_directions WHERE paper_id = 17) AS directions, coalesce((SELECT max(CASE WHEN event = 'read' THEN 1 ELSE 0 END) FROM paper_user_events WHERE paper_id = 17), 0) AS was_read FROM papers AS p WHERE p.id = 17""")
def paper_lookup(spark, sf):
    """FLT-14: one paper with its directions and its state, zero by default."""
    d = model(spark, sf, "paper_directions").where("paper_id = 17").agg(F.array_join(F.array_sort(F.collect_list("direction")), ",").alias("directions"))
    s = model(spark, sf, "paper_user_events").where("paper_id = 17").agg(F.coalesce(F.max(F.when(F.col("event") == "read", 1).otherwise(0)), F.lit(0)).alias("was_read"))
    return model(spark, sf, "papers").where("id = 17").select("id", "title").join(F.broadcast(d)).join(F.broadcast(s))


@query("""SELECT id FROM papers WHERE 5 * len(list_filter(['the', 'reason', 'der', 'los'], lambda t: contains(lower(coalesce(title, '')), t))) + len(list_filter(['the', 'reason', 'der', 'los'], lambda t: contains(lower(coalesce(abstract, '')), t))) >= 2""")
def term_threshold(spark, sf):
    """FLT-12; `of` is too short and `and` a stop word."""
    p = model(spark, sf, "papers").select("id", "title", "abstract")
    return p.where(tx.passes_terms(F.col("title"), F.col("abstract"), F.lit("The reason, der AND los of"), ("and",))).select("id")


# ---------------------------------------------------------------- sets and sequences
@query()
def formula_difference_whole(spark, sf):
    """SET-6 over the words of whole abstracts; without SQL, as list filters take the square of the words."""
    p = _texts(spark, sf).select("id", F.split("abstract", " ").alias("a"), F.split("title", " ").alias("b"))
    return p.select("id", F.array_join(tx.multiset_except(F.col("a"), F.col("b")), " ").alias("remaining"))


@query("SELECT o_custkey AS o_custkey, count(n) = count(DISTINCT n) AND min(n) = 1 AND max(n) = count(*) AS contiguous FROM (SELECT o_custkey, o_orderkey % 3 + 1 AS n FROM orders) AS x GROUP BY o_custkey")
def contiguous_numbers(spark, sf):
    """WIN-5."""
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_custkey", (F.col("o_orderkey") % 3 + 1).alias("n"))
    return ra.contiguous(o, ["o_custkey"], "n")


@query("""WITH g AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey - lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) > 100 THEN 1 ELSE 0 END AS f FROM orders),
i AS (SELECT o_custkey, o_orderkey, sum(f) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS island FROM g)
SELECT o_custkey AS o_custkey, CAST(island AS BIGINT) AS island, min(o_orderkey) AS first, CAST(count(*) AS BIGINT) AS n FROM i GROUP BY o_custkey, island""")
def adjacency_islands(spark, sf):
    """WIN-7: gap and island."""
    o, k = spark.read.parquet(f"{sf}/orders.parquet").select("o_custkey", "o_orderkey"), F.col("o_orderkey")
    return ra.adjacent_groups(o, ["o_custkey"], k, k, [k], 100).groupBy("o_custkey", "island").agg(F.min("o_orderkey").alias("first"), F.count("*").alias("n"))


@query("""WITH a AS (SELECT id, row_number() OVER (ORDER BY citations DESC, id) AS r FROM papers QUALIFY r <= 20), b AS (SELECT id, row_number() OVER (ORDER BY year DESC, id) AS r FROM papers QUALIFY r <= 20)
SELECT id, min(r) AS place FROM (SELECT id, r FROM a UNION ALL SELECT id, 1000 + r AS r FROM b) AS x GROUP BY id""")
def two_orderings(spark, sf):
    """SET-9: each list is cut first, so ranking sees twenty rows."""
    p = model(spark, sf, "papers").select("id", "citations", "year")
    rank = lambda by: p.orderBy(F.desc(by), "id").limit(20).withColumn("position", F.row_number().over(Window.orderBy(F.desc(by), "id")))
    out = ra.first_positions([rank("citations"), rank("year")], "id")
    return out.select("id", (F.col("at.list") * 1000 + F.col("at.place")).cast("long").alias("place"))


# ---------------------------------------------------------------- sources
_WORKS = [
    '{"id": "W1", "title": "Tea", "authorships": [{"author": {"display_name": "A"}}, {"author": {"display_name": null}}, {"author": {"display_name": "B"}}], "publication_year": 2020, "publication_date": "2020-03-04", "abstract_inverted_index": {"b": [1], "a": [0, 2]}, "doi": "https://doi.org/10.1/X", "locations": [{"pdf_url": "http://p/1.pdf"}, {"pdf_url": "http://arxiv.org/pdf/2"}], "cited_by_count": 3}',
    '{"id": "W2", "title": ""}',
    '{"id": "W3", "title": "Bare"}',
]
_FEED = "<feed><entry><id>http://arxiv.org/abs/2101.00001v1</id><title>A &amp; B</title><summary> long  text </summary><published>2021-01-02T00:00:00Z</published><author><name>X</name></author><author><name>Y</name></author></entry></feed>"
_S2 = ['{"paperId": "S", "title": "Tea time", "abstract": "longer text", "year": 2020, "externalIds": {"DOI": "10.1/x"}, "citationCount": 9}', '{"paperId": "S2", "title": "Other", "venue": "", "year": null}']


def _json(spark, rows, ddl):
    return spark.createDataFrame([(r,) for r in rows], "j string").select(F.from_json("j", ddl).alias("r")).select("r.*")


def _records(spark):
    n = lambda df, k: df.withColumn("n", F.lit(k))
    works, papers = _json(spark, _WORKS, payloads.OPENALEX), _json(spark, _S2, payloads.SEMANTIC_SCHOLAR)
    feed = spark.createDataFrame([(_FEED,)], "xml string")
    return n(payloads.openalex(works), 0).unionByName(n(payloads.arxiv(feed), 1)).unionByName(n(payloads.semantic_scholar(papers), 2))
