"""Queries of the relational engine and the SQL that they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions import scoring as sc
from paperloom.functions import text as tx
from paperloom.operators import documents as doc
from paperloom.operators import relational as ra
from paperloom.operators import structure as st
from paperloom.plans import flows, library_flows, more, payload_files, stored  # noqa: F401  register their queries
from paperloom.plans.registry import QUERIES, SQL, query
from paperloom.plans.views import AS_OF, model
from paperloom.streaming import events as ev

QUERY = "the reason der los dans"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def _t(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _titles(spark, sf):
    """Id, title and year of all papers, without the model's join with labels, which would shuffle whole texts."""
    return _t(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.substring("text", 1, 80).alias("title"), (2014 + F.col("doc_id") % 12).cast("int").alias("year"))


def _now():
    return F.lit(AS_OF).cast("timestamp")


def _today():
    return F.lit(AS_OF).cast("date")


def _six(c):
    return F.round(c, 6)


_WEIGHT = "CASE e.event WHEN 'save' THEN 3.0 WHEN 'library_import' THEN 2.0 WHEN 'read' THEN 1.0 WHEN 'hide' THEN -4.0 ELSE 0.0 END"
_AGE = f"greatest(0.0, CAST(epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(e.created_at) AS DOUBLE) / 86400000000)"
_IMPACT = "CASE WHEN citation_percentile IS NOT NULL THEN greatest(0.0, least(CASE WHEN citation_percentile > 1 THEN citation_percentile / 100 ELSE citation_percentile END, 1.0)) ELSE least(log10(coalesce(citations, 0) + 1) / 4, 1.0) END"
_LEX = "CAST(len(list_filter(['the','reason','der','los','dans'], lambda t: contains(lower({}), t))) AS DOUBLE) / 5"
_NORM = "substring(regexp_replace(lower(title), '[^a-z0-9\\x{4e00}-\\x{9fff}]+', '', 'g'), 1, 300)"


# ---------------------------------------------------------------- feedback and evaluation
@query(f"""SELECT d.direction AS direction, round(sum({_WEIGHT} * exp(-{_AGE} / 90)), 6) AS score, CAST(count(DISTINCT e.paper_id) AS BIGINT) AS papers
FROM paper_user_events AS e JOIN paper_directions AS d ON d.paper_id = e.paper_id GROUP BY d.direction HAVING sum({_WEIGHT} * exp(-{_AGE} / 90)) > 0""")
def decayed_preference(spark, sf):
    """AGG-7: events are reduced to (paper, sum) before the bridge multiplies them."""
    e = model(spark, sf, "paper_user_events").groupBy("paper_id").agg(F.sum(sc.decayed_event_weight(F.col("event"), F.col("created_at"), _now())).alias("w"))
    d = model(spark, sf, "paper_directions")
    out = e.join(d, "paper_id").groupBy("direction").agg(F.sum("w").alias("s"), F.count_distinct("paper_id").alias("papers")).where("s > 0")
    return out.select("direction", _six(F.col("s")).alias("score"), "papers").orderBy(F.desc("score"), F.desc("papers"), "direction")


@query(f"SELECT event, CAST(count(*) AS BIGINT) AS n FROM paper_user_events WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY GROUP BY event")
def event_counts_30d(spark, sf):
    return model(spark, sf, "paper_user_events").where(F.col("created_at") >= _now() - F.expr("INTERVAL 30 DAY")).groupBy("event").agg(F.count("*").alias("n"))


@query(f"SELECT CAST(count(DISTINCT paper_id) AS BIGINT) AS papers FROM paper_user_events WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY")
def shown_distinct_7d(spark, sf):
    return model(spark, sf, "paper_user_events").where(F.col("created_at") >= _now() - F.expr("INTERVAL 7 DAY")).agg(F.count_distinct("paper_id").alias("papers"))


@query("""SELECT direction, CAST(count(*) FILTER (label = 'relevant') AS BIGINT) AS relevant, CAST(count(*) FILTER (label = 'partial') AS BIGINT) AS partly,
CAST(count(*) FILTER (label = 'irrelevant') AS BIGINT) AS irrelevant, CAST(count(*) AS BIGINT) AS total FROM feedback GROUP BY direction""")
def evaluation_by_direction(spark, sf):
    n = lambda x: F.count_if(F.col("label") == x)
    return model(spark, sf, "feedback").groupBy("direction").agg(n("relevant").alias("relevant"), n("partial").alias("partly"), n("irrelevant").alias("irrelevant"), F.count("*").alias("total")).orderBy(F.desc("total"), "direction")


@query("""SELECT d.direction AS direction, CAST(count(DISTINCT p.id) AS BIGINT) AS n FROM paper_directions AS d JOIN papers AS p ON p.id = d.paper_id WHERE coalesce(p.is_relevant, true) GROUP BY d.direction""")
def direction_counts(spark, sf):
    p = ra.visible(model(spark, sf, "papers")).select("id")
    return model(spark, sf, "paper_directions").join(p, F.col("paper_id") == F.col("id")).groupBy("direction").agg(F.count_distinct("id").alias("n"))


@query("""SELECT k.direction AS direction, CAST(count(d.paper_id) AS BIGINT) AS n FROM (SELECT concat('d', CAST(range AS VARCHAR)) AS direction FROM range(12)) AS k
LEFT JOIN paper_directions AS d ON d.direction = k.direction GROUP BY k.direction""")
def direction_counts_left(spark, sf):
    k = spark.range(12).select(F.concat(F.lit("d"), F.col("id").cast("string")).alias("direction"))
    n = model(spark, sf, "paper_directions").groupBy("direction").agg(F.count("*").alias("n"))
    return k.join(n, "direction", "left").select("direction", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT CAST(count(*) AS BIGINT) AS total, CAST(coalesce(sum(CASE WHEN is_relevant = false THEN 1 ELSE 0 END), 0) AS BIGINT) AS hidden, CAST(count(*) - coalesce(sum(CASE WHEN is_relevant = false THEN 1 ELSE 0 END), 0) AS BIGINT) AS shown FROM papers")
def visibility_totals(spark, sf):
    return model(spark, sf, "papers").agg(F.count("*").alias("total"), F.count_if(~F.col("is_relevant")).alias("hidden")).withColumn("shown", F.col("total") - F.col("hidden"))


@query("SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (title IS NULL OR trim(title) = '') AS BIGINT) AS untitled, CAST(count(*) FILTER (citations > 1000) AS BIGINT) AS cited FROM papers")
def data_quality(spark, sf):
    return model(spark, sf, "papers").agg(F.count("*").alias("total"), F.count_if(F.col("title").isNull() | (F.trim("title") == "")).alias("untitled"), F.count_if(F.col("citations") > 1000).alias("cited"))


@query("SELECT CAST(count(*) AS BIGINT) AS suspicious FROM papers WHERE title IS NULL OR NOT (lower(title) LIKE '%the%' OR lower(title) LIKE '%der%' OR lower(title) LIKE '%que%' OR lower(title) LIKE '%ou%')")
def suspicious_titles(spark, sf):
    """FLT-10: one alternation instead of a chain of NOT LIKE."""
    return model(spark, sf, "papers").where(F.col("title").isNull() | ~F.lower("title").rlike("the|der|que|ou")).agg(F.count("*").alias("suspicious"))


@query("SELECT direction, CAST(count(*) FILTER (coalesce(p.is_relevant, true)) AS BIGINT) AS shown, CAST(count(*) FILTER (p.is_relevant = false) AS BIGINT) AS hidden FROM papers AS p JOIN (SELECT paper_id, min(direction) AS direction FROM paper_directions GROUP BY paper_id) AS d ON d.paper_id = p.id GROUP BY direction")
def cleaner_counts(spark, sf):
    first = model(spark, sf, "paper_directions").groupBy("paper_id").agg(F.min("direction").alias("direction"))
    p = model(spark, sf, "papers").select("id", "is_relevant").join(first, F.col("id") == F.col("paper_id"))
    return p.groupBy("direction").agg(F.count_if(F.coalesce("is_relevant", F.lit(True))).alias("shown"), F.count_if(~F.col("is_relevant")).alias("hidden"))


# ---------------------------------------------------------------- joins
@query("""SELECT p.id AS id, p.title AS title FROM papers AS p WHERE coalesce(p.is_relevant, true) AND p.id IN (SELECT paper_id FROM paper_directions WHERE direction = 'd3')
AND NOT EXISTS (SELECT 1 FROM paper_user_events AS e WHERE e.paper_id = p.id AND e.event = 'hide' AND e.created_at >= TIMESTAMP '2024-01-25')""")
def visible_in_direction(spark, sf):
    d = model(spark, sf, "paper_directions").where("direction = 'd3'").select(F.col("paper_id").alias("id"))
    hidden = model(spark, sf, "paper_user_events").where((F.col("event") == "hide") & (F.col("created_at") >= F.lit("2024-01-25").cast("timestamp"))).select(F.col("paper_id").alias("id"))
    return ra.visible(model(spark, sf, "papers").select("id", "title", "is_relevant")).join(d, "id", "left_semi").join(hidden, "id", "left_anti").select("id", "title")


@query("""SELECT p.id AS id, EXISTS (SELECT 1 FROM paper_user_events AS e WHERE e.paper_id = p.id AND e.event = 'read' AND e.created_at >= TIMESTAMP '2024-01-29' AND e.created_at < TIMESTAMP '2024-02-01') AS recently_shown FROM papers AS p""")
def recently_shown_flag(spark, sf):
    e = model(spark, sf, "paper_user_events").where("event = 'read' and created_at >= timestamp'2024-01-29' and created_at < timestamp'2024-02-01'").select(F.col("paper_id").alias("id"), F.lit(True).alias("hit")).distinct()
    return model(spark, sf, "papers").select("id").join(e, "id", "left").select("id", F.col("hit").isNotNull().alias("recently_shown"))


@query("SELECT p.id AS id, coalesce((SELECT max(CASE WHEN e.event = 'save' THEN 1 ELSE 0 END) FROM paper_user_events AS e WHERE e.paper_id = p.id), 0) AS saved FROM papers AS p")
def saved_default_scalar(spark, sf):
    e = model(spark, sf, "paper_user_events").groupBy(F.col("paper_id").alias("id")).agg(F.max(F.when(F.col("event") == "save", 1).otherwise(0)).alias("s"))
    return model(spark, sf, "papers").select("id").join(e, "id", "left").select("id", F.coalesce("s", F.lit(0)).alias("saved"))


@query("""SELECT id, sha256(abstract) AS copy_group, CASE WHEN abstract IS NULL THEN id ELSE min(id) OVER (PARTITION BY abstract) END AS first_id,
CAST(CASE WHEN abstract IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY abstract) END AS BIGINT) AS copies FROM papers""")
def copy_classes(spark, sf):
    """JOIN-16 over all papers; straight from the documents, as the model's join with labels would shuffle whole texts."""
    return ra.copy_classes(_t(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("abstract")), "abstract")


@query(f"""SELECT a.id AS new_id, min_by(b.id, (CASE WHEN a.id % 4 = 0 AND b.id = a.id THEN 0 ELSE 1 END) * 1000000000 + b.id) AS id FROM (SELECT id, {_NORM} AS k, year FROM papers WHERE id % 2 = 0) AS a
JOIN (SELECT id, {_NORM} AS k, year FROM papers) AS b ON (a.id % 4 = 0 AND b.id = a.id) OR (a.k <> '' AND a.k = b.k AND a.year = b.year) GROUP BY a.id""")
def entity_match_priority(spark, sf):
    """JOIN-6: first by DOI (here: every fourth paper has one), then by normalised title and year."""
    p = model(spark, sf, "papers").select("id", "title", "year")
    doi = F.when(F.col("doi_id").isNotNull(), F.concat(F.lit("10.1/"), F.col("doi_id").cast("string")))
    norm = tx.normalize_title(F.col("title"))
    title = F.when(norm != "", F.concat_ws(":", norm, "year"))
    keys = [("doi", doi), ("title", title)]
    new = p.where("id % 2 = 0").withColumn("doi_id", F.when(F.col("id") % 4 == 0, F.col("id"))).withColumnRenamed("id", "new_id")
    return ra.match_by_priority(new, p.withColumn("doi_id", F.col("id")), keys)


@query(f"""SELECT id AS new_id, CASE WHEN id % 4 = 0 THEN id ELSE first END AS id FROM (SELECT id, k, min(id) OVER (PARTITION BY k, year) AS first FROM (SELECT id, {_NORM} AS k, year FROM papers) AS x) AS y
WHERE id % 4 = 0 OR k <> ''""")
def entity_match_priority_all(spark, sf):
    """JOIN-6 over all papers as incoming records."""
    p = _titles(spark, sf).select("id", "title", "year")
    norm = tx.normalize_title(F.col("title"))
    doi = F.when(F.col("doi_id").isNotNull(), F.concat(F.lit("10.1/"), F.col("doi_id").cast("string")))
    keys = [("doi", doi), ("title", F.when(norm != "", F.concat_ws(":", norm, "year")))]
    new = p.withColumn("doi_id", F.when(F.col("id") % 4 == 0, F.col("id"))).withColumnRenamed("id", "new_id")
    return ra.match_by_priority(new, p.withColumn("doi_id", F.col("id")), keys)


@query(f"""SELECT id, CAST(CASE WHEN k IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY k, year) END AS BIGINT) AS matches FROM (SELECT id, {_NORM} AS k, nullif(year, 2015) AS year FROM papers) AS x""")
def entity_match_or_all(spark, sf):
    """JOIN-7 over all papers."""
    return ra.match_counts(_titles(spark, sf).select("id", tx.normalize_title(F.col("title")).alias("k"), F.nullif("year", F.lit(2015)).alias("year")), "k", "year")


# ---------------------------------------------------------------- top-k, paging, windows
@query("SELECT id, citations, year FROM papers WHERE title ILIKE '%the%' OR venue ILIKE '%the%' ORDER BY citations DESC NULLS LAST, year DESC NULLS LAST, id LIMIT 20 OFFSET 20")
def page_of_papers(spark, sf):
    p = ra.search_filter(model(spark, sf, "papers").select("id", "title", "venue", "citations", "year"), ["title", "venue"], "the")
    return ra.page(p, [F.desc_nulls_last("citations"), F.desc_nulls_last("year"), F.col("id")], 20, 2).select("id", "citations", "year")


@query("SELECT id, strftime(published_date, '%Y-%m-%d') AS published FROM papers ORDER BY published_date ASC NULLS FIRST, id LIMIT 200")
def refresh_queue(spark, sf):
    return model(spark, sf, "papers").select("id", "published_date").orderBy(F.asc_nulls_first("published_date"), "id").limit(200).select("id", F.date_format("published_date", "yyyy-MM-dd").alias("published"))


@query("""SELECT direction, id, CAST(rank AS INT) AS rank FROM (SELECT d.direction AS direction, p.id AS id, row_number() OVER (PARTITION BY d.direction ORDER BY p.citations DESC, p.id) - 1 AS rank
FROM papers AS p JOIN paper_directions AS d ON d.paper_id = p.id) AS x WHERE rank < 2""")
def daily_per_direction_topn(spark, sf):
    j = model(spark, sf, "papers").select("id", "citations").join(model(spark, sf, "paper_directions"), F.col("id") == F.col("paper_id"))
    return ra.top_n(j, ["direction"], [F.desc("citations"), F.col("id")], 2).select("direction", "id", "rank")


@query("""WITH r AS (SELECT d.direction AS direction, p.id AS id, row_number() OVER (PARTITION BY d.direction ORDER BY p.citations DESC, p.id) AS k FROM papers AS p JOIN paper_directions AS d ON d.paper_id = p.id),
a AS (SELECT id, row_number() OVER (ORDER BY k) - 1 AS rank FROM r WHERE direction = 'd3' AND k <= 2),
b AS (SELECT id, row_number() OVER (ORDER BY k) - 1 AS rank FROM r WHERE direction = 'd0' AND id NOT IN (SELECT id FROM a) QUALIFY row_number() OVER (ORDER BY k) <= 2)
SELECT 'd3' AS direction, id AS paper_id, CAST(rank AS INT) AS rank FROM a UNION ALL SELECT 'd0' AS direction, id AS paper_id, CAST(rank AS INT) AS rank FROM b""")
def daily_selection_greedy(spark, sf):
    j = model(spark, sf, "papers").select("id", "citations").join(model(spark, sf, "paper_directions"), F.col("id") == F.col("paper_id"))
    return ra.greedy_select(j, ["d3", "d0"], 2, [F.desc("citations"), F.col("paper_id")])


@query("""SELECT o_custkey AS o_custkey, o_orderkey AS o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2""")
def orders_top2(spark, sf):
    return ra.top_n(_t(spark, sf, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 2).select("o_custkey", "o_orderkey")


@query("""SELECT l_returnflag AS l_returnflag, l_linestatus AS l_linestatus, CAST(sum(l_quantity) AS DOUBLE) AS sum_qty, round(CAST(sum(l_extendedprice * (1 - l_discount)) AS DOUBLE), 2) AS revenue, CAST(count(*) AS BIGINT) AS n
FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def pricing_summary(spark, sf):
    return _t(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("double").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("double"), 2).alias("revenue"), F.count("*").alias("n"))


# ---------------------------------------------------------------- scores
@query(f"SELECT id, round({_IMPACT}, 6) AS impact, CASE WHEN published_date IS NOT NULL THEN published_date >= DATE '2022-02-01' ELSE year >= 2022 END AS frontier, round(CASE WHEN published_date IS NULL THEN exp(-greatest(0.0, (DATE '{AS_OF}' - make_date(year, 12, 31)) / 30.4) / 30) ELSE exp(-greatest(0.0, (DATE '{AS_OF}' - published_date) / 30.4) / 30) END, 6) AS recency FROM papers")
def metadata_scores(spark, sf):
    p = model(spark, sf, "papers")
    c = F.col
    return p.select("id", _six(sc.citation_quality(c("citations"), c("citation_percentile"))).alias("impact"), sc.is_frontier(c("year"), c("published_date"), _today()).alias("frontier"), _six(sc.recency_score(c("year"), c("published_date"), _today())).alias("recency"))




@query("""SELECT id, CASE WHEN id % 50 = 0 THEN '经典必读' WHEN id % 4 >= 3 AND id % 3 <> 0 THEN '顶会/顶刊' WHEN id % 4 >= 2 AND id % 3 <> 0 THEN '高质量发表' WHEN id % 3 = 0 AND (id % 7 = 0 OR id % 4 >= 1) THEN '高质量预印本' ELSE '方向相关' END AS label FROM papers""")
def quality_label(spark, sf):
    i = F.col("id")
    status = F.when(i % 3 == 0, "preprint").otherwise("published")
    return model(spark, sf, "papers").select("id", sc.quality_label(i % 50 == 0, i % 4, status, i % 7 == 0).alias("label"))


@query("""SELECT p.id AS id, round(sum(w.weight) * log10(p.citations + 1) * (CASE p.id % 4 WHEN 0 THEN 1.5 WHEN 1 THEN 1.2 WHEN 2 THEN 1.0 ELSE 0.7 END) * exp(-0.15 * (2026 - p.year)), 6) AS score
FROM papers AS p JOIN paper_directions AS d ON d.paper_id = p.id JOIN (VALUES ('d1', 1.0), ('d2', 0.5), ('d5', 2.0)) AS w(direction, weight) ON w.direction = d.direction GROUP BY p.id, p.citations, p.year ORDER BY score DESC, id LIMIT 10""")
def legacy_recommend(spark, sf):
    """AGG-8: weights are summed per paper before papers are joined."""
    w = spark.sql("SELECT * FROM VALUES ('d1', 1.0D), ('d2', 0.5D), ('d5', 2.0D) AS t(direction, weight)")
    per = model(spark, sf, "paper_directions").join(F.broadcast(w), "direction").groupBy("paper_id").agg(F.sum("weight").alias("w"))
    rank = F.element_at(F.array(*map(F.lit, "ABCD")), (F.col("id") % 4 + 1).cast("int"))
    p = model(spark, sf, "papers").select("id", "citations", "year").join(per, F.col("id") == F.col("paper_id"))
    return p.select("id", _six(sc.legacy_score(F.col("w"), F.col("citations"), rank, F.col("year"))).alias("score")).orderBy(F.desc("score"), "id").limit(10)


@query(f"""WITH m AS (SELECT paper_id, count(*) AS k FROM paper_directions WHERE direction IN ('d1', 'd4') GROUP BY paper_id)
SELECT p.id AS id, round(({_IMPACT}) * (0.65 + 0.35 * (m.k / 2.0)) + (CASE WHEN p.id % 9 = 0 THEN 0.08 ELSE 0 END) - (CASE WHEN p.id % 4 = 0 THEN 0.02 ELSE 0 END), 6) AS score, p.year AS year
FROM papers AS p JOIN m ON m.paper_id = p.id ORDER BY score DESC, year DESC, id LIMIT 30""")
def recommend_by_directions(spark, sf):
    m = model(spark, sf, "paper_directions").where(F.col("direction").isin("d1", "d4")).groupBy(F.col("paper_id").alias("id")).agg((F.count("*") / 2).alias("match"))
    p = model(spark, sf, "papers").select("id", "year", "citations", "citation_percentile").join(m, "id", "left")
    p = ra.soft_filter(p, F.col("match").isNotNull())
    base = sc.citation_quality(F.col("citations"), F.col("citation_percentile"))
    score = sc.match_score(base, F.coalesce("match", F.lit(0.0)), F.col("id") % 9 == 0, F.col("id") % 4 == 0)
    return p.select("id", _six(score).alias("score"), "year").orderBy(F.desc("score"), F.desc("year"), "id").limit(30)


@query(f"""WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id = 7)
SELECT p.id AS id, round(0.6 * greatest(coalesce(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), q.e), 0.0), 0.0) + 0.25 * ({_LEX.format('p.abstract')}) + 0.15 * ({_IMPACT}), 6) AS score
FROM papers AS p LEFT JOIN embeddings AS v ON v.vec_id = p.id CROSS JOIN q ORDER BY score DESC, id LIMIT 100""")
def hybrid_search(spark, sf):
    """The query vector is one row, so it is broadcast; top-k without a full sort."""
    v = _t(spark, sf, "embeddings").select("vec_id", "embedding")
    q = v.where("vec_id = 7").select(F.col("embedding").alias("q"))
    p = model(spark, sf, "papers").select("id", "citations", "citation_percentile", tx.lexical_score(F.col("abstract"), F.lit(QUERY)).alias("lex"))
    j = p.join(v, F.col("id") == F.col("vec_id"), "left").join(F.broadcast(q))
    semantic = F.coalesce(sc.cosine(F.col("embedding"), F.col("q")), F.lit(0.0))
    score = sc.hybrid_score(semantic, F.col("lex"), sc.citation_quality(F.col("citations"), F.col("citation_percentile")))
    return j.select("id", _six(score).alias("score")).orderBy(F.desc("score"), "id").limit(100)


@query(f"SELECT id, round(0.8 * ({_LEX.format('abstract')}) + 0.2 * ({_IMPACT}), 6) AS score FROM papers ORDER BY score DESC, id LIMIT 100")
def keyword_search(spark, sf):
    p = model(spark, sf, "papers")
    score = sc.hybrid_score(F.lit(0.0), tx.lexical_score(F.col("abstract"), F.lit(QUERY)), sc.citation_quality(F.col("citations"), F.col("citation_percentile")), has_vector=False)
    return p.select("id", _six(score).alias("score")).orderBy(F.desc("score"), "id").limit(100)


@query("""WITH t AS (SELECT CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id = 11)
SELECT v.vec_id AS id, round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), t.e), 6) AS score FROM embeddings AS v CROSS JOIN t WHERE v.vec_id <> 11 ORDER BY score DESC, id LIMIT 8""")
def related_topk(spark, sf):
    v = _t(spark, sf, "embeddings").select("vec_id", "embedding")
    t = v.where("vec_id = 11").select(F.col("embedding").alias("q"))
    return v.where("vec_id <> 11").join(F.broadcast(t)).select(F.col("vec_id").alias("id"), _six(sc.cosine(F.col("embedding"), F.col("q"))).alias("score")).orderBy(F.desc("score"), "id").limit(8)


@query(f"""SELECT id, round((0.3 * 0.5 + 0.26 * exp(-greatest(0.0, (DATE '{AS_OF}' - coalesce(published_date, make_date(year, 12, 31))) / 30.4) / 30) + 0.18 * ((id % 4) / 3.0) + 0.1 * ({_IMPACT}) + 0.16 * 0.4 + (CASE WHEN id % 6 = 0 THEN -0.1 ELSE 0.08 END) + (CASE WHEN id % 8 = 0 THEN -0.25 ELSE 0 END)) * (0.85 + 0.15 * 1.5), 6) AS score
FROM papers WHERE (published_date >= DATE '2023-02-01' OR (published_date IS NULL AND year >= 2023)) AND coalesce(is_relevant, true)""")
def daily_candidates_scored(spark, sf):
    p = ra.since(ra.visible(model(spark, sf, "papers")), F.lit("2023-02-01").cast("date"))
    i, c = F.col("id"), F.col
    score = sc.daily_score(F.lit(0.5), sc.recency_score(c("year"), c("published_date"), _today()), i % 4, sc.citation_quality(c("citations"), c("citation_percentile")), F.lit(0.4), i % 6 == 0, i % 8 == 0, F.lit(1.5))
    return p.select("id", _six(score).alias("score"))


@query("""SELECT d.direction AS direction, p.id AS id FROM papers AS p JOIN paper_directions AS d ON d.paper_id = p.id WHERE NOT contains(lower(p.title), 'tion') AND (d.direction <> 'd2' OR contains(lower(p.title), 'the')) AND (d.direction <> 'd3' OR NOT contains(lower(p.title), 'en'))""")
def exclusion_rules_filter(spark, sf):
    rules = spark.sql("SELECT * FROM VALUES ('all', 'tion', 'exclude'), ('d2', 'the', 'require'), ('d3', 'EN', 'exclude') AS t(direction, term, mode)")
    j = model(spark, sf, "papers").select("id", "title").join(model(spark, sf, "paper_directions"), F.col("id") == F.col("paper_id"))
    return ra.apply_rules(j, rules, F.col("title")).select("direction", "id")


@query("""WITH c AS (SELECT d.direction AS direction, p.id AS id, p.id % 3 <> 0 AS shown FROM papers AS p JOIN paper_directions AS d ON d.paper_id = p.id),
f AS (SELECT direction, count(*) FILTER (NOT shown) AS n FROM c GROUP BY direction) SELECT c.direction AS direction, c.id AS id FROM c JOIN f ON f.direction = c.direction WHERE f.n < 60 OR NOT c.shown""")
def freshness_fallback(spark, sf):
    c = model(spark, sf, "papers").select("id", (F.col("id") % 3 != 0).alias("shown")).join(model(spark, sf, "paper_directions"), F.col("id") == F.col("paper_id"))
    return ra.fresh_or_all(c, ["direction"], "shown", 60).select("direction", "id")


# ---------------------------------------------------------------- records
@query(f"SELECT CAST(count(*) AS BIGINT) AS records, CAST(count(DISTINCT concat({_NORM}, ':', CAST(year AS VARCHAR))) AS BIGINT) AS entities FROM papers")
def normalized_title_dedupe(spark, sf):
    p = model(spark, sf, "papers").select("title", "year")
    key = F.concat_ws(":", tx.normalize_title(F.col("title")), "year")
    return p.agg(F.count("*").alias("records"), F.count_distinct(key).alias("entities"))


@query("""SELECT venue AS k, arg_max(title, id) AS title, arg_max(abstract, struct_pack(a := length(abstract), b := -id)) AS abstract, max(citations) AS citations, arg_max(year, id) AS year, CAST(count(DISTINCT lang) AS BIGINT) AS n_sources FROM papers GROUP BY venue""")
def merge_fold(spark, sf):
    p = model(spark, sf, "papers").select(F.col("venue").alias("k"), "id", "title", "abstract", "citations", "year", F.array("lang").alias("sources"))
    return ra.fold_merge(p, "k", "id").select("k", "title", "abstract", "citations", "year", F.size("sources").cast("long").alias("n_sources"))


@query(f"""WITH e AS (SELECT id, title, abstract, CASE WHEN id % 3 = 0 THEN 0 ELSE year END AS year, CASE WHEN id % 4 = 0 THEN 'arXiv' ELSE venue END AS venue, citations FROM papers WHERE id % 3 <> 1),
n AS (SELECT id, concat(title, '!') AS title, substring(abstract, 1, 50) AS abstract, year + 1 AS year, 'new' AS venue, citations + 5 AS citations FROM papers WHERE id % 2 = 0)
SELECT coalesce(e.id, n.id) AS id, CASE WHEN length(coalesce(e.title, '')) >= length(coalesce(n.title, '')) AND coalesce(e.title, '') <> '' THEN e.title ELSE n.title END AS title,
coalesce(nullif(e.year, 0), nullif(n.year, 0), 0) AS year, CASE WHEN coalesce(e.venue, '') <> '' AND e.venue <> 'arXiv' THEN e.venue ELSE coalesce(n.venue, e.venue) END AS venue, greatest(e.citations, n.citations) AS citations,
CASE WHEN e.title IS NULL THEN 'inserted' WHEN n.title IS NULL THEN 'untouched' ELSE 'updated' END AS status FROM e FULL JOIN n ON n.id = e.id""")
def upsert_merge(spark, sf):
    p = model(spark, sf, "papers").select("id", "title", "abstract", "year", "venue", "citations", F.lit(None).cast("string").alias("doi"), F.lit(None).cast("string").alias("normalized_title"))
    old = p.where("id % 3 <> 1").withColumn("year", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("year"))).withColumn("venue", F.when(F.col("id") % 4 == 0, "arXiv").otherwise(F.col("venue")))
    new = p.where("id % 2 = 0").withColumn("title", F.concat("title", F.lit("!"))).withColumn("abstract", F.substring("abstract", 1, 50)).withColumn("year", F.col("year") + 1).withColumn("venue", F.lit("new")).withColumn("citations", F.col("citations") + 5)
    return ra.merge_papers(old, new).select("id", "title", F.coalesce("year", F.lit(0)).alias("year"), "venue", "citations", "status")


@query("SELECT id, sha256(concat(coalesce(title, ''), chr(10), coalesce(abstract, ''), chr(10), coalesce(venue, ''), chr(10), coalesce(CAST(year AS VARCHAR), ''))) AS hash FROM papers")
def content_hash(spark, sf):
    p = model(spark, sf, "papers")
    return p.select("id", tx.content_hash(F.col("title"), F.col("abstract"), F.col("venue"), F.col("year")).alias("hash"))


@query("SELECT CAST(count(*) AS BIGINT) AS missing FROM papers AS p WHERE p.id % 4 <> 0 OR p.id % 8 = 0")
def cache_miss(spark, sf):
    """FLT-9: rows whose hash is not in the cache (every fourth is, half of those with a stale hash)."""
    p = model(spark, sf, "papers").select("id", tx.content_hash(F.col("title"), F.col("year")).alias("hash"))
    cache = p.where("id % 4 = 0").select("id", F.when(F.col("id") % 8 == 0, F.lit("stale")).otherwise(F.col("hash")).alias("hash"))
    return p.join(cache, ["id", "hash"], "left_anti").agg(F.count("*").alias("missing"))


@query("SELECT id, array_to_string(string_split(regexp_replace(trim(abstract), '\\s+', ' ', 'g'), ' '), ' ') AS text FROM papers")
def inverted_index_whole(spark, sf):
    """SCL-3 over whole abstracts, straight from the documents: the model's join with labels would shuffle them."""
    p = _t(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.split(F.regexp_replace(F.trim("text"), r"\s+", " "), " ").alias("w"))
    return p.select("id", tx.abstract_from_inverted_index(tx.inverted_index(F.col("w")), None).alias("text"))


@query("SELECT paper_id AS paper_id, arg_max(event, struct_pack(a := created_at, b := id)) AS last_event, CAST(max(CASE WHEN event = 'save' THEN 1 ELSE 0 END) AS INT) AS ever_saved, CAST(count(*) AS BIGINT) AS n FROM paper_user_events GROUP BY paper_id")
def user_state_fold(spark, sf):
    return ev.fold_state(model(spark, sf, "paper_user_events"))


@query("SELECT id, direction FROM (SELECT paper_id AS id, direction FROM paper_directions WHERE direction = 'd1' UNION ALL SELECT 5 AS id, 'd1' AS direction WHERE 5 NOT IN (SELECT paper_id FROM paper_directions WHERE direction = 'd1')) AS x")
def insert_or_ignore(spark, sf):
    old = model(spark, sf, "paper_directions").where("direction = 'd1'").select(F.col("paper_id").alias("id"), "direction")
    new = spark.sql("SELECT * FROM VALUES (5L, 'd1'), (1L, 'd1') AS t(id, direction)")
    return ra.insert_missing(old, new, ["id", "direction"])


@query("""SELECT k.name AS name, list_aggregate(list(d.direction ORDER BY d.direction), 'string_agg', ',') AS directions FROM (VALUES (1, 'a'), (2, 'b'), (3, 'c')) AS k(id, name)
JOIN (SELECT DISTINCT direction FROM paper_directions) AS d ON CAST(substring(d.direction, 2) AS INT) % 3 + 1 = k.id GROUP BY k.name""")
def nest_clusters(spark, sf):
    k = spark.sql("SELECT * FROM VALUES (1, 'a'), (2, 'b'), (3, 'c') AS t(id, name)")
    d = model(spark, sf, "paper_directions").select("direction").distinct().withColumn("id", F.substring("direction", 2, 9).cast("int") % 3 + 1)
    return k.join(d, "id").groupBy("name").agg(F.array_join(F.array_sort(F.collect_list("direction")), ",").alias("directions"))


@query("""SELECT direction, string_agg(concat('- ', title), chr(10) ORDER BY rank) AS section FROM (SELECT d.direction AS direction, p.title AS title, row_number() OVER (PARTITION BY d.direction ORDER BY p.citations DESC, p.id) AS rank
FROM papers AS p JOIN paper_directions AS d ON d.paper_id = p.id) AS x WHERE rank <= 3 GROUP BY direction""")
def digest_sections(spark, sf):
    j = model(spark, sf, "papers").select("id", "title", "citations").join(model(spark, sf, "paper_directions"), F.col("id") == F.col("paper_id"))
    top = ra.top_n(j, ["direction"], [F.desc("citations"), F.col("id")], 3)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", "title"))), lambda x: F.concat(F.lit("- "), x["title"]))
    return top.groupBy("direction").agg(F.array_join(lines, "\n").alias("section"))


# ---------------------------------------------------------------- documents and pages
@query("SELECT page_id AS page_id, CAST(len(regexp_extract_all(html, '(?i)<p\\b')) AS INT) AS opens, CAST(len(regexp_extract_all(html, '(?i)</p>')) AS INT) AS closes, CAST(len(regexp_extract_all(html, '(?i)<li\\b')) AS INT) AS items FROM pages")
def html_balance(spark, sf):
    n = lambda p: F.coalesce(F.regexp_count("html", F.lit(p)), F.lit(0))
    return _t(spark, sf, "pages").select("page_id", n(r"(?i)<p\b").alias("opens"), n("(?i)</p>").alias("closes"), n(r"(?i)<li\b").alias("items"))


@query("SELECT doc_id AS doc_id, length(regexp_replace(text, '\\s+', '', 'g')) >= 500 * 2 AS complete FROM documents")
def completeness_gate(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", doc.is_complete(F.col("text"), F.lit(2), F.lit(0)).alias("complete"))


@query("SELECT page_id AS page_id, CAST(len(list_distinct(regexp_extract_all(html, '<a[^>]*href=\"([^\"]+)\"', 1))) AS INT) AS links FROM pages")
def page_links(spark, sf):
    links = F.array_distinct(F.regexp_extract_all("html", F.lit('<a[^>]*href="([^"]+)"'), F.lit(1)))
    return _t(spark, sf, "pages").select("page_id", F.size(links).alias("links"))


@query()
def chunk_packing(spark, sf):
    return doc.chunk_documents(_t(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("markdown")), 3000)


@query()
def source_quality(spark, sf):
    return doc.inspect_documents(_t(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("markdown")))


@query("SELECT doc_id AS id, true AS same FROM documents")
def placeholder_roundtrip(spark, sf):
    """DOC-21: protected and restored texts are the texts."""
    return doc.roundtrip_documents(_t(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("markdown")))


@query()
def binding_manifest(spark, sf):
    """DOC-15 over pages as markdown with a figure and a caption put before each."""
    p = _t(spark, sf, "pages").select(F.col("page_id").alias("id"), F.concat(F.lit("![a](x.png)\n\nFigure 1: A.\n\n"), "html").alias("markdown"))
    return st.bind_documents(p)


@query("SELECT page_id AS page_id, concat_ws(':', len(regexp_extract_all(html, '(?i)<tr\\b')), len(regexp_extract_all(html, '(?i)<td\\b')), len(regexp_extract_all(html, '(?i)<th\\b')), len(regexp_extract_all(html, '(?i)\\browspan\\s*=')), len(regexp_extract_all(html, '(?i)\\bcolspan\\s*='))) AS signature FROM pages")
def table_signature(spark, sf):
    return _t(spark, sf, "pages").select("page_id", st.table_signature(F.col("html")).alias("signature"))


@query("SELECT CAST(user_id AS BIGINT) AS user_id, strftime(ts, '%Y-%m-%d') AS day, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2")
def daily_event_counts(spark, sf):
    """STR-2 in batch: tumbling days."""
    e = _t(spark, sf, "events")
    return e.groupBy(F.col("user_id"), F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
