"""Whole flows over whole tables: upserts, daily picks, related papers, relevance, classification, evidence, imports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from paperloom.cluster import shared_dir
from paperloom.functions import cards
from paperloom.functions import relevance as rel
from paperloom.functions import scoring as sc
from paperloom.functions import text as tx
from paperloom.operators import daily as dy
from paperloom.operators import library as lib
from paperloom.operators import records as rec
from paperloom.operators import relational as ra
from paperloom.operators.search_index import TrigramIndex
from paperloom.plans.registry import query
from paperloom.plans.views import AS_OF, model
from paperloom.sources import curated, payloads
from paperloom.streaming import events as ev

_IMPACT = "CASE WHEN citation_percentile IS NOT NULL THEN greatest(0.0, least(CASE WHEN citation_percentile > 1 THEN citation_percentile / 100 ELSE citation_percentile END, 1.0)) ELSE least(log10(coalesce(citations, 0) + 1) / 4, 1.0) END"
_BARE = "regexp_replace(lower(title), '[^a-z0-9\\x{4e00}-\\x{9fff}]+', '', 'g')"
_RANK = "row_number() OVER"
#: Phrases that bring the domain's terms into the invented titles.
PHRASES = ("motion planning for a vehicle", "drug discovery with protein", "world model", "lidar perception of bev", "of nothing", "autonomous racing", "uncertainty and cancer", "a large language model (llm)", "trajectory prediction", "end-to-end driving")


def _today():
    return F.lit(AS_OF).cast("date")


def _quoted(texts) -> str:
    return ", ".join("'" + t.replace("'", "''") + "'" for t in texts)


def _docs(spark, sf):
    """Papers straight from the documents: the model's join with labels would shuffle whole texts."""
    return spark.read.parquet(f"{sf}/documents.parquet").select(
        F.col("doc_id").alias("id"), F.substring("text", 1, 80).alias("title"), F.col("text").alias("abstract"), F.col("source").alias("venue"), (2014 + F.col("doc_id") % 12).cast("int").alias("year"), F.col("n_chars").cast("long").alias("citations"),
        F.when(F.col("doc_id") % 5 == 0, (F.col("doc_id") % 101).cast("double")).alias("citation_percentile"), "lang",
    )


def _titled(df):
    """title with a phrase of the domain behind it."""
    return df.withColumn("title", F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.element_at(F.array(*map(F.lit, PHRASES)), (F.col("id") % len(PHRASES) + 1).cast("int"))))


_TITLED = f"(SELECT id, concat(coalesce(title, ''), ' ', ([{_quoted(PHRASES)}])[id % {len(PHRASES)} + 1]) AS title, abstract, venue, year FROM papers) AS t"
_TEXT = "lower(concat_ws(' ', nullif(title, ''), nullif(abstract, ''), nullif(venue, '')))"


# ---------------------------------------------------------------- the same formulas as SQL
def _matches(text: str, patterns) -> str:
    joined = "|".join(f"(?:{p})" for p in patterns).replace("'", "''")
    return f"regexp_matches({text}, '{joined}')"


def _hits(text: str, terms) -> str:
    return f"len(list_filter([{_quoted(terms)}], lambda w: contains({text}, w)))"


def _score_sql(key: str, label: str = "", search: str = "") -> str:
    terms = rel.direction_terms(key, label, search)
    anchor = _matches(_TEXT, (*rel.AUTONOMY, "autonomous driving|driverless|vehicle control|驾驶|自动驾驶|无人车"))
    cover, signal = f"least(1.0, {_hits(_TEXT, terms)} / CAST({max(1, min(len(terms), 4))} AS DOUBLE))", f"least(1.0, {_hits('lower(title)', terms)} / CAST({max(1, min(len(terms), 2))} AS DOUBLE))"
    return f"greatest(0.0, least(1.0, 0.35 * {cover} + 0.25 * {signal} + CASE WHEN {anchor} THEN 0.3 ELSE 0.05 END - CASE WHEN {_matches(_TEXT, rel.OFF_DOMAIN)} AND NOT {anchor} THEN 0.55 ELSE 0.0 END))"


def _gate_sql(key: str) -> str:
    anchor = _matches(_TEXT, (*rel.AUTONOMY, "autonomous driving|driverless|road vehicle|vehicle control|驾驶|自动驾驶|无人车"))
    more = rel.RACING if key == "racing" else rel.AUTONOMY if key in ("e2e", "perception", "prediction") else (*rel.ROBOTICS, *rel.AUTONOMY)
    return f"NOT ({_matches(_TEXT, rel.OFF_DOMAIN)} AND NOT {anchor}) AND ({_hits(_TEXT, rel.DIRECTION_TERMS[key])} > 0 OR {_matches(_TEXT, more)})"


# ---------------------------------------------------------------- relevance and classification over all papers
@query(f"SELECT id, round({_score_sql('planning')}, 6) AS planning, round({_score_sql('world_model')}, 6) AS world_model, {_gate_sql('planning')} AS planning_ok, {_gate_sql('racing')} AS racing_ok, {_gate_sql('perception')} AS perception_ok FROM {_TITLED}")
def relevance_of_papers(spark, sf):
    """SCL-33, SCL-34 over all papers, whole abstracts."""
    p, text = _titled(_docs(spark, sf)), [F.col(c) for c in ("title", "abstract", "venue")]
    score, gate = (lambda k: F.round(rel.relevance_score(*text, k), 6).alias(k)), (lambda k: rel.is_likely_relevant(*text, k).alias(f"{k}_ok"))
    return p.select("id", score("planning"), score("world_model"), gate("planning"), gate("racing"), gate("perception"))


_FOUND = "list_filter([{}], lambda k: k IS NOT NULL)".format(", ".join(f"CASE WHEN {_matches(_TEXT, (p,))} THEN '{k}' END" for k, p in rel.CLASSIFIER))


@query(f"SELECT id, f[1] AS primary_direction, array_to_string(f[2:3], ',') AS secondary, CASE WHEN len(f) > 0 THEN 0.42 ELSE 0.0 END::DOUBLE AS confidence FROM (SELECT id, {_FOUND} AS f FROM {_TITLED}) AS x")
def classify_papers(spark, sf):
    """SCL-16 over all papers."""
    c = cards.heuristic_classification(F.col("title"), F.col("abstract"), F.col("venue"))
    return _titled(_docs(spark, sf)).select("id", c.alias("c")).select("id", "c.primary_direction", F.array_join("c.secondary_directions", ",").alias("secondary"), F.col("c.confidence").cast("double").alias("confidence"))


@query("""SELECT id, CASE id % 4 WHEN 0 THEN 'planning' WHEN 1 THEN 'control' ELSE NULL END AS primary_direction, CASE id % 4 WHEN 0 THEN 'control,racing' WHEN 1 THEN 'planning' WHEN 2 THEN 'safety' ELSE '' END AS secondary,
CASE id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.0 END::DOUBLE AS confidence, CASE WHEN id % 4 = 2 THEN substring(trim(title), 1, 40) END AS new_label, CASE id % 4 WHEN 0 THEN trim(substring(coalesce(venue, ''), 1, 200)) ELSE '分类依据不足' END AS reason
FROM (SELECT id, venue, regexp_replace(coalesce(title, ''), '[^a-zA-Z ]', '', 'g') AS title FROM papers) AS x""")
def normalize_answers(spark, sf):
    """SCL-14, SCL-15: answers of a model in four shapes (fenced, by label, inside prose, broken), one a paper."""
    p = _docs(spark, sf).withColumn("title", F.regexp_replace(F.coalesce("title", F.lit("")), "[^a-zA-Z ]", ""))
    i, js = F.col("id") % 4, F.to_json
    first = F.concat(F.lit("```json\n"), js(F.struct(F.lit("planning").alias("primary_direction"), F.array(F.lit("control"), F.lit("planning"), F.lit("nowhere"), F.lit("racing"), F.lit("control")).alias("secondary_directions"), F.lit(7.5).alias("confidence"), F.coalesce("venue", F.lit("")).alias("reason_zh"))), F.lit("\n```"))
    second = js(F.struct(F.lit("车辆控制").alias("primary_direction"), F.array(F.lit("运动规划与控制")).alias("secondary_directions"), F.lit(0.5).alias("confidence")))
    third = F.concat(F.lit("It is: "), js(F.struct(F.lit("none").alias("primary_direction"), F.array(F.lit("safety")).alias("secondary_directions"), F.lit(-1.0).alias("confidence"), F.struct(F.col("title").alias("label"), F.lit("a query").alias("query")).alias("new_direction"))), F.lit(" as asked"))
    answer = F.when(i == 0, first).when(i == 1, second).when(i == 2, third).otherwise("sorry")
    c = cards.normalize_classification(answer, [(k, label) for k, (label, _) in curated.DIRECTIONS.items()])
    return p.select("id", c.alias("c")).select("id", "c.primary_direction", F.array_join("c.secondary_directions", ",").alias("secondary"), "c.confidence", F.col("c.new_direction.label").alias("new_label"), F.col("c.reason_zh").alias("reason"))


@query(f"""SELECT d.paper_id AS paper_id, d.direction AS direction, CASE d.direction WHEN 'd0' THEN p.planning WHEN 'd1' THEN p.racing WHEN 'd2' THEN p.perception ELSE true END AS is_relevant
FROM paper_directions AS d JOIN (SELECT id, {_gate_sql('planning')} AS planning, {_gate_sql('racing')} AS racing, {_gate_sql('perception')} AS perception FROM {_TITLED}) AS p ON p.id = d.paper_id""")
def clean_links(spark, sf):
    """DML-11: flags of all links judged anew; directions without a gate keep theirs."""
    p = _titled(_docs(spark, sf)).withColumn("is_relevant", F.lit(None).cast("boolean"))
    links = model(spark, sf, "paper_directions").withColumn("is_relevant", F.lit(True))
    gates = [F.when(F.col("direction") == d, F.lit(k)).otherwise(None) for d, k in (("d0", "planning"), ("d1", "racing"), ("d2", "perception"))]
    links = links.withColumns({"own": F.col("direction"), "direction": F.coalesce(*gates, "direction")})
    _, out = lib.clean_relevance(p, links, [("planning", "", ""), ("racing", "", ""), ("perception", "", "")])
    return out.select("paper_id", F.col("own").alias("direction"), "is_relevant")


# ---------------------------------------------------------------- evidence and projections
@query("""SELECT id, CASE WHEN id % 3 = 0 THEN title WHEN coalesce(abstract, '') <> '' THEN abstract ELSE '暂无摘要证据' END AS problem, CASE WHEN coalesce(abstract, '') <> '' THEN 'medium' ELSE 'low' END AS problem_level,
CASE id % 4 WHEN 0 THEN 'a；b' WHEN 1 THEN '暂无结构化创新点' ELSE '暂无结构化创新点' END AS core, CASE WHEN id % 4 IN (0, 1) THEN 'medium' ELSE 'low' END AS core_level, CASE WHEN id % 5 = 0 THEN venue ELSE '暂无结构化结果证据' END AS result FROM papers""")
def evidence_of_papers(spark, sf):
    """SCL-18 over all papers."""
    i = F.col("id")
    p = _docs(spark, sf).withColumns({"summary_zh": F.when(i % 3 == 0, F.col("title")), "innovations_zh": F.when(i % 4 == 0, '["a", "摘要未说明", "b"]').when(i % 4 == 1, '["摘要未说明"]').when(i % 4 == 2, "no json"), "method_zh": F.lit(""), "results_zh": F.when(i % 5 == 0, F.col("venue")), "limitations_zh": F.lit(None).cast("string")})
    e = p.select("id", cards.evidence_cards(F.col).alias("e"))
    card = lambda k, f: F.get("e", k)[f]
    return e.select("id", card(0, "content").alias("problem"), card(0, "confidence").alias("problem_level"), card(2, "content").alias("core"), card(2, "confidence").alias("core_level"), card(3, "content").alias("result"))


@query("""SELECT id, CASE WHEN id % 5 = 0 THEN '全文未识别出方法章节' ELSE concat(substring(concat(regexp_replace(coalesce(abstract, ''), '[^a-df-z]+', 'x', 'g'), repeat('x', 120)), 1, 120), ' ') END AS method FROM papers""")
def full_text_evidence_of_papers(spark, sf):
    """SCL-19: texts with a method section put around them (of letters that end no section early), but for every fifth."""
    body = F.substring(F.concat(F.regexp_replace(F.coalesce("abstract", F.lit("")), "[^a-df-z]+", "x"), F.lit("x" * 120)), 1, 120)
    text = F.concat(F.when(F.col("id") % 5 == 0, "Nothing: ").otherwise("Approach: "), body, F.lit("\nEvaluation"))
    e = _docs(spark, sf).select("id", cards.full_text_evidence(text).alias("e"))
    return e.select("id", F.get("e", 1)["content"].alias("method"))


@query(f"""SELECT id, CASE WHEN id % 4 = 0 THEN concat(CASE WHEN f THEN '近期前沿 · ' ELSE '' END, '顶会/顶刊') WHEN f THEN '近期前沿' ELSE '方向精选' END AS reason, CASE WHEN id % 4 = 0 THEN '顶会/顶刊' WHEN id % 4 = 1 THEN '高质量预印本' ELSE '方向相关' END AS label,
CASE id % 4 WHEN 0 THEN 'published' WHEN 1 THEN 'preprint' WHEN 2 THEN 'workshop' ELSE 'unknown' END = 'published' AS published, round(0.6 * CASE id % 4 WHEN 0 THEN 3 WHEN 1 THEN 1 WHEN 2 THEN 3 ELSE 0 END / 3.0 + 0.4 * {_IMPACT}, 6) AS quality
FROM (SELECT *, year >= 2022 AS f FROM papers) AS x WHERE id % 4 <> 2 UNION ALL
SELECT id, concat(CASE WHEN year >= 2022 THEN '近期前沿 · ' ELSE '' END, '顶会/顶刊') AS reason, 'Workshop' AS label, false AS published, round(0.6 + 0.4 * {_IMPACT}, 6) AS quality FROM papers WHERE id % 4 = 2""")
def paper_projection(spark, sf):
    """SCL-28, PRJ-1 over all papers, with four kinds of venues."""
    venues = F.array(*map(F.lit, ("NeurIPS 2020", "arXiv", "CVPR workshop", "")))
    none = lambda t: F.lit(None).cast(t)
    p = _docs(spark, sf).withColumns({"venue": F.element_at(venues, (F.col("id") % 4 + 1).cast("int")), "published_date": none("string"), "publication_channel": F.lit(""), "sources": F.array(F.lit("OpenAlex")), "openalex_id": F.col("id").cast("string"), "authors": none("string"), "doi": none("string"), "pdf_url": none("string")})
    p = rec.with_metadata(p, _today()).withColumns({"is_read": none("boolean"), "is_saved": none("boolean"), "is_hidden": none("boolean")})
    out = p.select(F.col("id").alias("key"), *cards.full_paper(F.col, F.lit("d1"), F.lit("D"), F.col("recommendation_score")))
    return out.select(F.col("key").alias("id"), F.col("discovery_reason").alias("reason"), F.col("quality_label").alias("label"), (F.col("publication_status") == "published").alias("published"), F.round("quality_score", 6).alias("quality"))


# ---------------------------------------------------------------- upsert
_NAMES = "('NeurIPS 2020', 'arXiv', '', 'Journal of Tests')"
_TIER = "CASE WHEN contains(lower(venue), 'neurips') OR contains(lower(venue), 'icra') THEN 3 WHEN contains(lower(venue), 'arxiv') OR contains(lower(publication_channel), 'arxiv') OR contains(lower(venue), 'journal') THEN 1 ELSE 0 END"
_TYPE = "CASE WHEN contains(lower(concat(venue, ' ', publication_channel)), 'arxiv') THEN 'preprint' WHEN contains(lower(venue), 'neurips') OR contains(lower(venue), 'icra') THEN 'conference' WHEN contains(lower(venue), 'journal') THEN 'journal' ELSE 'unknown' END"


@query(f"""WITH b AS (SELECT id, concat(coalesce(title, ''), ' ', id) AS title, coalesce(abstract, '') AS abstract, year, citations, citation_percentile, concat('10.1/', id) AS doi FROM papers),
e AS (SELECT id, title, abstract, CASE WHEN id % 5 = 0 THEN NULL ELSE year END AS year, ['NeurIPS 2020', 'arXiv', '', 'Journal of Tests'][id % 4 + 1] AS venue, citations, citation_percentile, CASE WHEN id % 2 = 0 THEN doi END AS doi,
  CASE WHEN id % 2 = 1 THEN concat('S', id) END AS s2, 'A. B' AS authors, NULL AS pdf_url, ['OpenAlex'] AS sources, '同行评议' AS channel FROM b WHERE id % 3 <> 1),
n AS (SELECT id, CASE WHEN id % 7 = 0 THEN concat(title, ' longer') ELSE title END AS title, substring(abstract, 1, 50) AS abstract, year, ['arXiv', 'IEEE ICRA', 'Nature', ''][id % 4 + 1] AS venue, citations + (id % 2) AS citations,
  CASE WHEN id % 2 = 0 THEN doi END AS doi, CASE WHEN id % 2 = 1 THEN concat('S', id) END AS s2, 'A. Bee' AS authors, concat('http://p/', id) AS pdf_url, ['Semantic Scholar'] AS sources FROM b WHERE id % 5 <> 4),
m AS (SELECT coalesce(CAST(e.id AS VARCHAR), concat('new', n.id)) AS key, e.id IS NULL AS fresh, n.id IS NOT NULL AS hit, CASE WHEN n.id IS NULL THEN e.title WHEN e.id IS NULL OR e.title = '' OR length(e.title) < length(n.title) THEN n.title ELSE e.title END AS title,
  CASE WHEN n.id IS NULL THEN e.abstract WHEN e.id IS NOT NULL AND length(e.abstract) >= length(n.abstract) THEN e.abstract WHEN e.id IS NULL AND length(n.abstract) = 0 THEN '' ELSE n.abstract END AS abstract, CASE WHEN n.id IS NULL THEN e.year ELSE coalesce(e.year, n.year) END AS year,
  CASE WHEN n.id IS NULL THEN e.venue WHEN coalesce(e.venue, '') <> '' AND e.venue <> 'arXiv' THEN e.venue ELSE n.venue END AS venue, CASE WHEN n.id IS NULL THEN e.citations ELSE greatest(coalesce(e.citations, 0), coalesce(n.citations, 0)) END AS citations,
  CASE WHEN n.id IS NULL THEN e.citation_percentile ELSE nullif(e.citation_percentile, 0) END AS citation_percentile, coalesce(e.doi, n.doi) AS doi, coalesce(e.s2, n.s2) AS s2,
  CASE WHEN n.id IS NULL OR (e.id IS NOT NULL AND length(e.authors) >= length(n.authors)) THEN e.authors ELSE n.authors END AS authors, n.pdf_url AS pdf_url, CASE WHEN e.id IS NULL THEN 'Semantic Scholar' WHEN n.id IS NULL THEN 'OpenAlex' ELSE 'OpenAlex,Semantic Scholar' END AS sources,
  coalesce(e.channel, CASE WHEN n.venue = 'arXiv' THEN 'arXiv 预印本' ELSE '同行评议' END) AS publication_channel, CASE WHEN n.id IS NULL THEN 'OpenAlex' ELSE 'Semantic Scholar' END AS seen FROM e FULL JOIN n ON n.id = e.id)
SELECT key, sha256(title) AS title, sha256(abstract) AS abstract, year, coalesce(venue, '') AS venue, citations, citation_percentile, doi, s2, authors, pdf_url, sources, publication_channel,
{_TYPE} AS venue_type, CAST({_TIER} AS INT) AS venue_tier, round(CASE WHEN coalesce(venue, '') = '' THEN 0.0 WHEN seen = 'OpenAlex' AND {_TYPE} <> 'unknown' THEN 0.85 WHEN {_TYPE} <> 'unknown' THEN 0.6 ELSE 0.25 END, 6)::DOUBLE AS venue_confidence,
round(0.6 * {_TIER} / 3.0 + 0.4 * {_IMPACT}, 6) AS quality_score, coalesce(year >= 2022, false) AS is_frontier,
round(0.42 * CASE WHEN coalesce(year >= 2022, false) THEN 1.0 ELSE exp(-0.24 * greatest(0, 2024 - coalesce(year, 2024))) END + 0.25 * {_TIER} / 3.0 + 0.18 * {_IMPACT}, 6) AS recommendation_score,
CASE WHEN NOT hit THEN 'untouched' WHEN fresh THEN 'inserted' ELSE 'updated' END AS status FROM m""")
def upsert_records(spark, sf):
    """DML-1, MRG-2 with JOIN-6: every paper is on one side or the other, every column is merged.

    Papers are found by DOI (even ids) or Semantic Scholar id (odd ones), never by their id."""
    i, js = F.col("id"), lambda *x: F.array(*map(F.lit, x))
    b = _docs(spark, sf).withColumns({"title": F.concat(F.coalesce("title", F.lit("")), F.lit(" "), i), "abstract": F.coalesce("abstract", F.lit("")), "doi": F.when(i % 2 == 0, F.concat(F.lit("10.1/"), i.cast("string"))), "semantic_scholar_id": F.when(i % 2 == 1, F.concat(F.lit("S"), i.cast("string")))})
    pick = lambda *x: F.element_at(js(*x), (i % 4 + 1).cast("int"))
    old = b.where("id % 3 <> 1").withColumns({"year": F.when(i % 5 == 0, None).otherwise(F.col("year")), "venue": pick("NeurIPS 2020", "arXiv", "", "Journal of Tests"), "authors": F.lit("A. B"), "sources": js("OpenAlex"), "publication_channel": F.lit("同行评议")}).drop("lang")
    new = b.where("id % 5 <> 4").withColumns({
        "title": F.when(i % 7 == 0, F.concat("title", F.lit(" longer"))).otherwise(F.col("title")), "abstract": F.substring("abstract", 1, 50), "venue": pick("arXiv", "IEEE ICRA", "Nature", ""), "citations": F.col("citations") + i % 2,
        "citation_percentile": F.lit(None).cast("double"), "authors": F.lit("A. Bee"), "pdf_url": F.concat(F.lit("http://p/"), i.cast("string")), "sources": js("Semantic Scholar"), "n": i, "direction": F.lit("d1"), "direction_label": F.lit("D"),
    }).drop("id", "lang")
    out = rec.upsert_records(old, new, _today())
    own = F.when(F.coalesce("doi", F.lit("")) != "", F.regexp_extract("doi", r"/(\d+)$", 1)).otherwise(F.substring("semantic_scholar_id", 2, 30))
    key = F.when(F.col("status") == "inserted", F.concat(F.lit("new"), own)).otherwise(i.cast("string"))
    six = lambda c: F.round(c, 6).alias(c)
    return out.select(
        key.alias("key"), F.sha2("title", 256).alias("title"), F.sha2("abstract", 256).alias("abstract"), "year", F.coalesce("venue", F.lit("")).alias("venue"), "citations", "citation_percentile", "doi", F.col("semantic_scholar_id").alias("s2"), "authors", "pdf_url",
        F.array_join("sources", ",").alias("sources"), "publication_channel", "venue_type", "venue_tier", F.round(F.col("venue_confidence").cast("double"), 6).alias("venue_confidence"), six("quality_score"), "is_frontier", six("recommendation_score"), "status",
    )


@query("""SELECT CAST(2 * count(*) AS BIGINT) AS fetched, CAST(count(*) AS BIGINT) AS duplicates, CAST(count(*) FILTER (id % 4 = 0) AS BIGINT) AS inserted, CAST(count(*) FILTER (id % 4 = 1) AS BIGINT) AS updated, CAST(count(*) FILTER (id % 4 > 1) AS BIGINT) AS unchanged, CAST(0 AS BIGINT) AS untouched FROM papers""")
def sync_totals(spark, sf):
    """AGG-15 over all papers: each record comes twice; a quarter is new, a quarter has another count, the rest is as it was."""
    i = F.col("id")
    b = _docs(spark, sf).select("id", "title", "year", F.lit("x").alias("abstract"), F.lit("Nature").alias("venue"), F.col("citations"), F.concat(F.lit("10.1/"), i.cast("string")).alias("doi"), F.array(F.lit("OpenAlex")).alias("sources"), F.lit("a").alias("authors"))
    none = spark.createDataFrame([], "id long").select("id")
    first = rec.upsert_records(rec.complete(none), b.withColumn("n", i).drop("id"), _today()).drop("status", "needs_embedding")
    old = first.where(F.regexp_extract("doi", r"/(\d+)$", 1).cast("long") % 4 != 0)
    new = b.withColumns({"n": i, "citations": F.when(i % 4 == 1, F.col("citations") + 1).otherwise(F.col("citations"))}).drop("id")
    merged = rec.upsert_records(old, new, _today())
    return rec.statistics(rec.complete(new.union(new)), merged)


# ---------------------------------------------------------------- search and recommendation
@query("""WITH q AS (SELECT concat_ws(' ', nullif(title, ''), nullif(abstract, ''), nullif(venue, '')) AS query FROM papers WHERE id = 11), t AS (SELECT list_filter(string_split_regex(lower(q.query), '\\s+'), lambda w: length(w) > 1) AS terms FROM q),
g AS (SELECT CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id = 11), c AS (SELECT DISTINCT p.id AS id, p.title AS title, p.abstract AS abstract, p.venue AS venue FROM papers AS p JOIN paper_directions AS d ON d.paper_id = p.id
WHERE p.id <> 11 AND coalesce(p.is_relevant, true) AND d.direction IN (SELECT direction FROM paper_directions WHERE paper_id = 11) AND p.id NOT IN (SELECT paper_id FROM paper_user_events WHERE event = 'hide') ORDER BY p.id LIMIT 300)
SELECT c.id AS id, round(0.8 * greatest(coalesce(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), g.e), 0.0), 0.0) + 0.2 * (CAST(len(list_filter(t.terms, lambda w: contains(lower(concat_ws(' ', nullif(c.title, ''), nullif(c.abstract, ''), nullif(c.venue, ''))), w))) AS DOUBLE) / len(t.terms)), 6) AS score
FROM c LEFT JOIN embeddings AS v ON v.vec_id = c.id CROSS JOIN g CROSS JOIN t ORDER BY score DESC, id LIMIT 8""")
def related_papers(spark, sf):
    """SCL-38, LIM-2: 300 candidates of the paper's directions by id, then .8 vector and .2 words of the whole target."""
    p, d = model(spark, sf, "papers"), model(spark, sf, "paper_directions")
    hidden = model(spark, sf, "paper_user_events").where("event = 'hide'").select(F.col("paper_id").alias("id"))
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    return ra.related(p, d, hidden, vectors, 11)


_DIRECTIONS = {"d3": ("the reason", "der los"), "d0": ("thing tion", "und les"), "d7": ("que ou", "tion"), "d5": ("en", "la le")}


def _daily_sql() -> str:
    state = "SELECT paper_id, max(event = 'read') AS is_read, max(event = 'save') AS is_saved, max(event = 'hide') AS is_hidden FROM paper_user_events GROUP BY paper_id"
    recency = f"exp(-greatest(0.0, (DATE '{AS_OF}' - coalesce(published_date, make_date(year, 12, 31))) / 30.4) / 30)"
    base = f"0.42 * CASE WHEN CASE WHEN published_date IS NOT NULL THEN published_date >= DATE '2022-02-01' ELSE year >= 2022 END THEN 1.0 ELSE exp(-0.24 * greatest(0, 2024 - year)) END + 0.18 * ({_IMPACT})"
    judged = ", ".join(f"{_score_sql(k, *_DIRECTIONS[k])} AS rel_{k}" for k in _DIRECTIONS)
    rel_of = "CASE d.direction " + " ".join(f"WHEN '{k}' THEN p.rel_{k}" for k in _DIRECTIONS) + " END"
    weight = "CASE d.direction WHEN 'd3' THEN 1.5 WHEN 'd7' THEN 0.5 ELSE 1.0 END"
    shown = f"SELECT DISTINCT paper_id FROM shown_history WHERE shown_on >= DATE '{AS_OF}' - 3 AND shown_on < DATE '{AS_OF}'"
    return f"""WITH s AS ({state}), h AS ({shown}), p AS (SELECT id, year, {base} AS base, {recency} AS recency, {_IMPACT} AS impact, lower(concat_ws(' ', nullif(title, ''), nullif(abstract, ''), nullif(venue, ''))) AS text, {judged} FROM papers WHERE coalesce(is_relevant, true)),
c AS (SELECT d.direction AS direction, p.id AS paper_id, p.year AS year, coalesce(s.is_saved, false) AS is_saved, h.paper_id IS NOT NULL AS shown, {rel_of} AS relevance, p.text AS text,
round((0.3 * p.base + 0.26 * p.recency + 0.1 * p.impact + 0.16 * {rel_of} + CASE WHEN coalesce(s.is_read, false) THEN -0.1 ELSE 0.08 END + CASE WHEN h.paper_id IS NOT NULL THEN -0.25 ELSE 0 END) * (0.85 + 0.15 * {weight}), 6) AS score
FROM p JOIN paper_directions AS d ON d.paper_id = p.id LEFT JOIN s ON s.paper_id = p.id LEFT JOIN h ON h.paper_id = p.id WHERE d.direction IN ('d3', 'd0', 'd7', 'd5') AND NOT coalesce(s.is_hidden, false)),
k AS (SELECT * FROM c WHERE relevance >= 0.22 AND NOT contains(text, 'zq') AND NOT (direction = 'd3' AND contains(text, 'xx')) AND (direction <> 'd0' OR contains(text, 'e'))),
f AS (SELECT direction, count(*) FILTER (NOT shown) AS fresh FROM k GROUP BY direction), w AS (SELECT k.*, {_RANK} (PARTITION BY k.direction ORDER BY is_saved DESC, score DESC, year DESC, paper_id) AS r FROM k JOIN f ON f.direction = k.direction WHERE f.fresh < 2 OR NOT k.shown),
a AS (SELECT * FROM w WHERE direction = 'd3' AND r <= 2), b AS (SELECT * FROM w WHERE direction = 'd0' AND paper_id NOT IN (SELECT paper_id FROM a) ORDER BY r LIMIT 2),
x AS (SELECT * FROM w WHERE direction = 'd7' AND paper_id NOT IN (SELECT paper_id FROM a) AND paper_id NOT IN (SELECT paper_id FROM b) ORDER BY r LIMIT 1),
y AS (SELECT * FROM w WHERE direction = 'd5' AND NOT EXISTS (SELECT 1 FROM x) AND paper_id NOT IN (SELECT paper_id FROM a) AND paper_id NOT IN (SELECT paper_id FROM b) ORDER BY r LIMIT 1)
SELECT kind, direction, paper_id, CAST({_RANK} (PARTITION BY kind, direction ORDER BY r) - 1 AS INT) AS rank, score FROM (SELECT 'personal' AS kind, * FROM a UNION ALL SELECT 'personal' AS kind, * FROM b UNION ALL SELECT 'exploration' AS kind, * FROM x UNION ALL SELECT 'exploration' AS kind, * FROM y) AS z"""


@query(_daily_sql())
def daily_recommendations(spark, sf):
    """W4 end to end: two directions with weights, rules, relevance, freshness, greedy picks and one neighbour's pick."""
    e = model(spark, sf, "paper_user_events")
    on = lambda x, c: F.max((F.col("event") == x)).alias(c)
    state = e.groupBy("paper_id").agg(on("read", "is_read"), on("save", "is_saved"), on("hide", "is_hidden"))
    links = model(spark, sf, "paper_directions").withColumn("is_relevant", F.lit(True))
    rules = spark.createDataFrame([("all", "zq", "exclude"), ("d3", "xx", "exclude"), ("d0", "e", "require")], "direction string, term string, mode string")
    edges = [("d3", "d0"), ("d3", "d7"), ("d0", "d9"), ("d0", "d5")]
    keys, weights = dy.choose_directions(["d3", "d0"], [("d3", 1.5, True), ("d7", 0.5, True), ("d9", 1.0, False)], [])
    explore = dy.neighbours_of(keys, edges, ["d9"])
    weights |= {"d7": 0.5}
    c = dy.candidates(model(spark, sf, "papers"), links, state, model(spark, sf, "shown_history"), rules, AS_OF, {k: _DIRECTIONS[k] for k in [*keys, *explore]}, weights)
    return dy.pick(c, keys, explore, 2).where("shown").select("kind", "direction", "paper_id", "rank", "score")


# ---------------------------------------------------------------- records of sources
@query(f"""WITH w AS (SELECT id, coalesce(title, '') AS title, concat('d', id % 3) AS direction, year, citations FROM papers), k AS (SELECT *, lower(title) AS low FROM w WHERE title <> '')
SELECT direction, openalex_id, title, year, citations, n_authors, pdf_url FROM (SELECT direction, CAST(id AS VARCHAR) AS openalex_id, title, year, citations, 'A, B' AS n_authors, CASE WHEN id % 2 = 0 THEN concat('http://arxiv.org/pdf/', id) ELSE concat('http://p/', id, '.pdf') END AS pdf_url,
{_RANK} (PARTITION BY direction ORDER BY concat(year, '-01-01') DESC, title) AS r FROM k WHERE contains(low, 'e')) AS x WHERE r <= 30""")
def newest_works(spark, sf):
    """SRC-2: works as JSON, read, filtered and cut to the newest 30 a direction."""
    i = F.col("id")
    name = lambda n: F.struct(F.struct(F.lit(n).cast("string").alias("display_name")).alias("author"))
    urls = F.when(i % 2 == 0, F.array(F.concat(F.lit("http://p/"), i, F.lit(".pdf")), F.concat(F.lit("http://arxiv.org/pdf/"), i))).otherwise(F.array(F.lit(None), F.concat(F.lit("http://p/"), i, F.lit(".pdf"))))
    work = F.to_json(F.struct(i.cast("string").alias("id"), F.coalesce("title", F.lit("")).alias("title"), F.array(name("A"), name(None), name("B")).alias("authorships"), F.col("year").alias("publication_year"), F.concat(F.col("year").cast("string"), F.lit("-01-01")).alias("publication_date"), F.col("citations").alias("cited_by_count"), F.transform(urls, lambda u: F.struct(u.alias("pdf_url"))).alias("locations")))
    works = _docs(spark, sf).select(work.alias("j")).select(F.from_json("j", payloads.OPENALEX).alias("w")).select("w.*")
    r = payloads.openalex(works).where(F.contains(F.lower("title"), F.lit("e"))).withColumn("direction", F.concat(F.lit("d"), (F.col("openalex_id").cast("long") % 3).cast("string")))
    return payloads.keep_newest(r).select("direction", "openalex_id", "title", "year", "citations", F.col("authors").alias("n_authors"), "pdf_url")


@query("""SELECT concat('k', id) AS key, trim(t) AS title, year, CASE WHEN id % 2 = 0 THEN concat('2101.', lpad(CAST(id % 100000 AS VARCHAR), 5, '0'), 'v1') END AS arxiv_id FROM (SELECT id, year, trim(regexp_replace(regexp_replace(coalesce(title, ''), '[^a-zA-Z ]', '', 'g'), ' +', ' ', 'g')) AS t FROM papers) AS x WHERE t <> ''""")
def bibtex_of_papers(spark, sf):
    """SRC-9, SCL-8 to SCL-10: an entry written for every paper, and read again."""
    from paperloom.sources.bibtex import read_bibtex

    i = F.col("id")
    t = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce("title", F.lit("")), "[^a-zA-Z ]", ""), " +", " "))
    arxiv = F.concat(F.lit("2101."), F.lpad((i % 100000).cast("string"), 5, "0"), F.lit("v1"))
    entry = F.concat(F.lit("@article{k"), i, F.lit(",\n title = {"), t, F.lit("},\n year = "), F.col("year"), F.when(i % 2 == 0, F.concat(F.lit(",\n url = {https://arxiv.org/abs/"), arxiv, F.lit("}"))).otherwise(""), F.lit("\n}\n"))
    return read_bibtex(_docs(spark, sf).where(t != "").select(entry.alias("bibtex"))).select("key", "title", "year", "arxiv_id")


@query("""SELECT CAST(count(*) AS BIGINT) AS entries, CAST(count(*) FILTER (id % 3 <> 0) AS BIGINT) AS duplicates, CAST(count(*) FILTER (id % 3 = 0) AS BIGINT) AS inserted FROM papers""")
def import_counts(spark, sf):
    """DML-18: every paper comes as an entry; two thirds are found by DOI."""
    i = F.col("id")
    doi = F.concat(F.lit("10.1/"), i.cast("string"))
    p = _docs(spark, sf).select("id", F.concat(F.coalesce("title", F.lit("")), F.lit(" of "), i).alias("title"), F.lit("x").alias("abstract"), "venue", "year", doi.alias("doi"), F.lit(None).cast("string").alias("arxiv_id"))
    none = lambda ddl: spark.createDataFrame([], ddl)
    entries = p.select(F.concat(F.lit("k"), i).alias("key"), "title", "year", "doi", "arxiv_id", "abstract", "venue", F.lit("").alias("authors"), F.lit(None).cast("string").alias("pdf_url"))
    out = lib.import_entries(p.where("id % 3 <> 0"), none("paper_id long, source string, external_key string, collection string"), none("paper_id long, direction string, direction_label string, is_relevant boolean"), none("id long, paper_id long, event string, created_at timestamp"), entries, F.lit(AS_OF))
    return out["counters"].select("entries", "duplicates", "inserted")


@query(f"""SELECT label, CASE WHEN n = 1 THEN slug ELSE concat(slug, '-', n) END AS key FROM (SELECT label, slug, {_RANK} (PARTITION BY slug ORDER BY label) + CASE WHEN slug < 'm' THEN 1 ELSE 0 END AS n FROM
(SELECT DISTINCT label, substring(regexp_replace(regexp_replace(lower(label), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 48) AS slug FROM (SELECT concat(regexp_replace(substring(coalesce(title, ''), 1, 3), '[^a-zA-Z]', '', 'g'), 'x', CASE WHEN id % 2 = 0 THEN ' ' ELSE '!' END) AS label FROM papers) AS a) AS b) AS c""")
def direction_keys(spark, sf):
    """DML-13: keys for the labels of all papers; slugs before `m` are taken already."""
    label = F.concat(F.regexp_replace(F.substring(F.coalesce("title", F.lit("")), 1, 3), "[^a-zA-Z]", ""), F.lit("x"), F.when(F.col("id") % 2 == 0, " ").otherwise("!"))
    labels = _docs(spark, sf).select(label.alias("label")).distinct()
    taken = labels.select(tx.slugify(F.col("label")).alias("key")).where("key < 'm'").distinct()
    return lib.allocate_keys(labels, taken).select("label", "key")


# ---------------------------------------------------------------- normalisers over all rows
@query("SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(html, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '\\s+', ' ', 'g')) AS text FROM pages")
def xml_decode_pages(spark, sf):
    """SCL-4 over whole pages."""
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", tx.decode_xml(F.col("html")).alias("text"))


@query("SELECT id, coalesce(title, '') AS title FROM papers")
def ids_decode_papers(spark, sf):
    """SCL-12: titles, URL-encoded once to three times, come back."""
    t = F.coalesce("title", F.lit(""))
    raw = F.when(F.col("id") % 3 == 0, F.url_encode(t)).when(F.col("id") % 3 == 1, F.url_encode(F.url_encode(t))).otherwise(F.url_encode(F.url_encode(F.url_encode(t))))
    safe = _docs(spark, sf).withColumn("title", F.regexp_replace("title", "[%+]", ""))
    safe = safe.select("id", "title", tx.decode_id(raw).alias("back"))
    return _docs(spark, sf).select("id", F.coalesce("title", F.lit("")).alias("title")).join(safe.select("id", "back", F.col("title").alias("bare")), "id").select("id", F.when(F.coalesce("back", F.lit("")) == F.coalesce("bare", F.lit("")), F.col("title")).alias("title"))


@query("SELECT page_id, array_to_string(list_distinct(list_filter(regexp_extract_all(html, '(?i)<a\\b[^>]*href=[\"'']([^\"'']+)[\"'']', 1), lambda u: regexp_matches(u, '(?i)\\.pdf|/pdf/|download'))), ' ') AS links, CAST(len(regexp_extract_all(html, '(?i)<a\\b[^>]*href=[\"'']')) AS INT) AS anchors FROM (SELECT page_id, replace(html, 'href=\"/The', 'href=\"/pdf/The') AS html FROM pages) AS x")
def pdf_links_of_pages(spark, sf):
    """SRC-10: addresses that look like PDFs (links to one word are made to)."""
    p = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", F.replace("html", F.lit('href="/The'), F.lit('href="/pdf/The')).alias("html"))
    return p.select("page_id", F.array_join(tx.pdf_links(F.col("html")), " ").alias("links"), F.regexp_count("html", F.lit(r"(?i)<a\b[^>]*href=[\"']")).alias("anchors"))


_FOREIGN = "driv rac vehicle autonom robot car motion plan control percept detect learn neural model world simulat trajector sensor vision camera lidar".split() + ["point cloud", "end-to-end", "reinforc"]


@query(f"SELECT id FROM {_TITLED} WHERE {_hits('lower(title)', _FOREIGN)} = 0")
def suspicious_papers(spark, sf):
    """FLT-10: all terms, as one alternation."""
    return _titled(_docs(spark, sf)).where(~F.lower("title").rlike("|".join(_FOREIGN))).select("id")


@query("SELECT CAST(count(*) AS BIGINT) AS missing FROM (SELECT id, sha256(concat(coalesce(title, ''), chr(10), coalesce(CAST(year AS VARCHAR), ''))) AS h FROM papers) AS p LEFT JOIN (SELECT id, CASE WHEN id % 8 = 0 THEN 'stale' ELSE sha256(concat(coalesce(title, ''), chr(10), coalesce(CAST(year AS VARCHAR), ''))) END AS h FROM papers WHERE id % 4 = 0) AS c ON c.id = p.id AND c.h = p.h WHERE c.id IS NULL")
def stale_hashes(spark, sf):
    """FLT-9 with hashes on both sides."""
    p = _docs(spark, sf).select("id", tx.content_hash(F.col("title"), F.col("year")).alias("hash"))
    cache = p.where("id % 4 = 0").select("id", F.when(F.col("id") % 8 == 0, F.lit("stale")).otherwise(F.col("hash")).alias("hash"))
    return p.join(cache, ["id", "hash"], "left_anti").agg(F.count("*").alias("missing"))


@query("""SELECT id, array_to_string(list_concat(list_filter(u, lambda x: regexp_matches(x, '(?i)\\.pdf($|[?#])|/pdf/')), list_filter(u, lambda x: NOT regexp_matches(x, '(?i)\\.pdf($|[?#])|/pdf/'))), ' ') AS urls FROM
(SELECT id, list_filter([CASE WHEN id % 3 > 0 THEN concat('http://p/', id, CASE WHEN id % 3 = 1 THEN '.pdf' ELSE '' END) END, CASE WHEN id % 2 = 0 THEN concat('https://doi.org/10.1/a', id) END, concat('http://mirror/', id), CASE WHEN id % 5 = 0 THEN concat('https://arxiv.org/pdf/', id, '.pdf') END], lambda x: x IS NOT NULL) AS u FROM papers) AS y""")
def pdf_candidates(spark, sf):
    """SCL-35, SRT-8 over all papers."""
    i = F.col("id").cast("string")
    pdf = F.when(F.col("id") % 3 == 1, F.concat(F.lit("http://p/"), i, F.lit(".pdf"))).when(F.col("id") % 3 == 2, F.concat(F.lit("http://p/"), i)).otherwise("")
    doi, arxiv = F.when(F.col("id") % 2 == 0, F.concat(F.lit("10.1/A"), i)), F.when(F.col("id") % 5 == 0, i)
    other = F.array(F.concat(F.lit("http://mirror/"), i), F.nullif(pdf, F.lit("")))
    return _docs(spark, sf).select("id", F.array_join(tx.url_candidates(pdf, doi, other, arxiv), " ").alias("urls"))


@query("""SELECT id, len(a) > 0 OR len(b) > 0 AS conflicting, array_to_string(list_sort(a), ',') AS pdf_only, array_to_string(list_sort(b), ',') AS db_only FROM (SELECT id, list_filter(x, lambda n: NOT list_contains(y, n)) AS a, list_filter(y, lambda n: NOT list_contains(x, n)) AS b FROM
(SELECT id, list_distinct(list_filter(list_transform(string_split(substring(t, 1, 40), ' '), lambda n: trim(n)), lambda n: n <> '')) AS x, list_distinct(list_filter(list_transform(string_split(substring(t, 9, 40), ' '), lambda n: trim(n)), lambda n: n <> '')) AS y FROM (SELECT id, regexp_replace(lower(coalesce(title, '')), '[^a-z ]', '', 'g') AS t FROM papers) AS p) AS q) AS r""")
def author_conflicts_of_papers(spark, sf):
    """SET-5, SCL-23 over all papers (words as names)."""
    t = F.regexp_replace(F.lower(F.coalesce("title", F.lit(""))), "[^a-z ]", "")
    upper = lambda c: F.transform(F.split(c, " "), lambda n: F.concat(F.lit(" "), F.upper(n), F.lit(".")))
    d = _docs(spark, sf).select("id", tx.author_difference(upper(F.substring(t, 1, 40)), F.split(F.substring(t, 9, 40), " ")).alias("d"))
    return d.select("id", "d.conflicting", F.array_join(F.array_sort("d.pdf_only"), ",").alias("pdf_only"), F.array_join(F.array_sort("d.db_only"), ",").alias("db_only"))


# ---------------------------------------------------------------- counts, pages, orders
@query("""SELECT direction, CAST(count(*) FILTER (label = 'relevant') AS BIGINT) AS relevant, CAST(count(*) FILTER (label = 'partial') AS BIGINT) AS partly, CAST(count(*) FILTER (label = 'irrelevant') AS BIGINT) AS irrelevant, CAST(count(*) AS BIGINT) AS total
FROM (SELECT *, DATE '2024-02-01' - CAST(paper_id % 180 AS INT) AS day FROM feedback) AS f WHERE day >= DATE '2024-02-01' - 90 GROUP BY direction""")
def evaluation_90d(spark, sf):
    """AGG-6 with its window of 90 days."""
    f = model(spark, sf, "feedback").withColumn("day", F.date_sub(_today(), (F.col("paper_id") % 180).cast("int"))).where(F.col("day") >= F.date_sub(_today(), 90))
    n = lambda x: F.count_if(F.col("label") == x)
    return f.groupBy("direction").agg(n("relevant").alias("relevant"), n("partial").alias("partly"), n("irrelevant").alias("irrelevant"), F.count("*").alias("total")).orderBy(F.desc("total"), "direction")


@query("""SELECT direction, label, CAST(n AS BIGINT) AS n FROM (SELECT direction, concat('label of ', direction) AS label, count(DISTINCT paper_id) AS n FROM paper_directions GROUP BY direction UNION ALL SELECT 'all' AS direction, '全部' AS label, count(DISTINCT paper_id) AS n FROM paper_directions) AS x""")
def direction_totals(spark, sf):
    """AGG-9, AGG-10: papers per direction with its label, and in all."""
    d = model(spark, sf, "paper_directions").withColumn("label", F.concat(F.lit("label of "), F.col("direction")))
    per = d.groupBy("direction").agg(F.any_value("label").alias("label"), F.count_distinct("paper_id").alias("n"))
    return per.unionByName(d.agg(F.count_distinct("paper_id").alias("n")).select(F.lit("all").alias("direction"), F.lit("全部").alias("label"), "n"))


@query("""SELECT id, citations, CAST((SELECT count(*) FROM papers WHERE title ILIKE '%the%' AND id IN (SELECT paper_id FROM paper_directions WHERE direction = 'd3')) AS BIGINT) AS total, (SELECT count(*) FROM papers WHERE title ILIKE '%the%' AND id IN (SELECT paper_id FROM paper_directions WHERE direction = 'd3')) > 4 AS has_more
FROM papers WHERE title ILIKE '%the%' AND id IN (SELECT paper_id FROM paper_directions WHERE direction = 'd3') ORDER BY citations DESC NULLS LAST, id LIMIT 2 OFFSET 2""")
def legacy_page(spark, sf):
    """LIM-1, LIM-4: a page with the total and whether there is more; `relevance` sorts by citations."""
    return ra.legacy_list(model(spark, sf, "papers").select("id", "title", "venue", "citations", "year"), model(spark, sf, "paper_directions"), "d3", "the", 2, 2, "relevance", ["title"]).select("id", "citations", "total", "has_more")


@query(f"""SELECT direction, paper_id, CAST(place AS INT) AS place FROM (SELECT d.direction AS direction, p.id AS paper_id, {_RANK} (PARTITION BY d.direction ORDER BY CASE WHEN p.published_date IS NOT NULL THEN p.published_date >= DATE '2022-02-01' ELSE p.year >= 2022 END DESC, p.id % 4 DESC, p.year DESC, p.citations DESC, p.id) AS place FROM papers AS p JOIN paper_directions AS d ON d.paper_id = p.id) AS x WHERE place <= 20""")
def candidate_order(spark, sf):
    """SRT-7: frontier, tier, year, citations."""
    p = model(spark, sf, "papers").select("id", "citations", "year", sc.is_frontier(F.col("year"), F.col("published_date"), _today()).alias("frontier"), (F.col("id") % 4).alias("tier"))
    j = p.join(model(spark, sf, "paper_directions"), F.col("id") == F.col("paper_id"))
    return ra.top_n(j, ["direction"], [F.desc("frontier"), F.desc("tier"), F.desc("year"), F.desc("citations"), F.col("paper_id")], 20).select("direction", "paper_id", (F.col("rank") + 1).alias("place"))


@query("SELECT DISTINCT direction, direction IN ('d1', 'd2', 'x', 'e2e', 'safety') AS known FROM (SELECT direction FROM paper_directions UNION ALL SELECT 'e2e' AS direction) AS y")
def known_directions(spark, sf):
    """SET-2: whether a direction is a custom or a built-in one."""
    custom = spark.createDataFrame([("d1",), ("d2",), ("x",)], "key string")
    every = lib.known_directions(spark, custom).withColumn("known", F.lit(True))
    d = model(spark, sf, "paper_directions").select("direction").union(spark.createDataFrame([("e2e",)], "direction string")).distinct()
    return d.join(every, "direction", "left").select("direction", F.coalesce("known", F.lit(False)).alias("known"))


# ---------------------------------------------------------------- documents
@query("""SELECT page_id, CAST(len(regexp_extract_all(html, '(?i)<table\\b')) - len(regexp_extract_all(html, '(?i)</table>')) AS INT) AS tables, CAST(len(regexp_extract_all(html, '(?i)<td\\b')) - len(regexp_extract_all(html, '(?i)</td>')) AS INT) AS cells,
CAST(len(regexp_extract_all(html, '\\$')) AS INT) AS dollars, CAST(len(regexp_extract_all(html, '\\$\\$')) AS INT) AS displays FROM (SELECT page_id, replace(html, '\\', '') AS html FROM pages) AS x""")
def markup_balance(spark, sf):
    """DOC-4's counts as columns."""
    n = lambda p: F.regexp_count("html", F.lit(p))
    p = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", F.replace("html", F.lit("\\"), F.lit("")).alias("html"))
    return p.select("page_id", (n(r"(?i)<table\b") - n("(?i)</table>")).alias("tables"), (n(r"(?i)<td\b") - n("(?i)</td>")).alias("cells"), tx.dollar_counts(F.col("html")).alias("d")).select("page_id", "tables", "cells", "d.dollars", "d.displays")


@query("SELECT o_custkey AS o_custkey, CAST(count(*) AS BIGINT) AS orders, CAST(sum(CASE WHEN g > 100 OR g IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS islands FROM (SELECT o_custkey, o_orderkey - lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS g FROM orders) AS x GROUP BY o_custkey")
def island_counts(spark, sf):
    """WIN-4, WIN-7 together: runs per customer."""
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_custkey", "o_orderkey")
    gap = F.col("o_orderkey") - F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return o.withColumn("g", gap).groupBy("o_custkey").agg(F.count("*").alias("orders"), F.count_if(F.col("g").isNull() | (F.col("g") > 100)).alias("islands"))


# ---------------------------------------------------------------- structure of built documents
def _python(df, ddl, run):
    """run(row) per row of df, an Arrow batch at a time."""
    import pandas as pd

    def each(frames):
        for f in frames:
            yield pd.DataFrame([run(*r) for r in f.itertuples(index=False, name=None)], columns=[c.split()[0] for c in ddl.split(", ")])

    return df.mapInPandas(each, ddl)


def _clean(c):
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "[^a-zA-Z]+", " "))


_CLEAN = "trim(regexp_replace(coalesce(title, ''), '[^a-zA-Z]+', ' ', 'g'))"


@query(f"SELECT id, sha256(concat('## 1. Introduction', chr(10), chr(10), 'x ', t, chr(10), chr(10), '### 2.1 Model', chr(10), 'y', chr(10), '## II. Results', chr(10), 'z')) AS digest FROM (SELECT id, {_CLEAN} AS t FROM papers) AS x")
def prepared_papers(spark, sf):
    """DOC-7: front matter and the repeated title go, heading depths follow their numbers."""
    md = F.concat(F.lit("# The title of it\nA. Bee\n\n# 1. Introduction\n\nx "), F.col("t"), F.lit("\n---\n## The Title of It\n#### 2.1 Model\ny\n# II. Results\nz"))
    from paperloom.operators.structure import prepare

    p = _docs(spark, sf).select("id", _clean("title").alias("t")).select("id", md.alias("md"))
    out = _python(p, "id long, text string", lambda i, m: (i, prepare(m, "The title of it")))
    return out.select("id", F.sha2(F.regexp_replace("text", r"\n\n\n*(?=### 2\.1)", "\n\n"), 256).alias("digest"))


@query(f"SELECT id, concat('## References', chr(10), chr(10), '1. A. Bee, ', t, '.', chr(10), '2. C. Dee, other.') AS text FROM (SELECT id, {_CLEAN} AS t FROM papers) AS x")
def numbered_references(spark, sf):
    """DOC-20, WIN-6: the entries of a reference section numbered anew."""
    from paperloom.operators.structure import number_references

    md = F.concat(F.lit("## References\n\n[7] A. Bee, "), _clean("title"), F.lit(".\n\n[9] C. Dee,\nother."))
    return _python(_docs(spark, sf).select("id", md.alias("md")), "id long, text string", lambda i, m: (i, number_references(m)))


@query("""SELECT p.id AS id, k.number AS number, k.name AS name, coalesce(a.en, k.name) AS canonical_en, CASE WHEN a.en IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS confidence
FROM papers AS p CROSS JOIN (VALUES (0, 1, 'Tsinghua'), (0, 2, 'Nowhere College'), (1, 1, 'MIT'), (1, 2, 'Nowhere College')) AS k(m, number, name) LEFT JOIN (VALUES ('Tsinghua', 'Tsinghua University'), ('MIT', 'Massachusetts Institute of Technology')) AS a(name, en) ON a.name = k.name WHERE p.id % 2 = k.m""")
def institutions_of_papers(spark, sf):
    """DOC-9, JOIN-19, SRC-18: affiliations of a front matter with their canonical names."""
    from paperloom.operators.structure import affiliations, resolve_institutions

    md = F.concat(F.lit("A. Bee^{1}, C. Dee^{2}\n\n1 "), F.when(F.col("id") % 2 == 0, "Tsinghua").otherwise("MIT"), F.lit("\n2 Nowhere College\n\n# Introduction\ntext"))
    rows = _python(_docs(spark, sf).select("id", md.alias("md")), "id long, found array<struct<number:int,original:string>>", lambda i, m: (i, [{"number": n, "original": x} for n, x in affiliations(m, "T")]))
    flat = rows.select("id", F.explode("found").alias("f")).select("id", "f.number", "f.original")
    return resolve_institutions(flat, curated.aliases(spark)).select("id", "number", F.col("original").alias("name"), "canonical_en", F.col("confidence").cast("double").alias("confidence"))


@query("SELECT doc_id AS id, CAST(length(regexp_replace(text, '\\s+', '', 'g')) AS BIGINT) AS chars FROM documents WHERE length(trim(regexp_replace(text, '\\s+', '', 'g'))) > 0")
def chunk_coverage(spark, sf):
    """DOC-8: the chunks of a document hold all of its characters, white space aside."""
    from paperloom.operators.documents import chunk_documents

    c = chunk_documents(spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("id"), F.col("text").alias("markdown")), 3000)
    return c.groupBy("id").agg(F.sum(F.length(F.regexp_replace("text", r"\s+", ""))).alias("chars"))


@query("SELECT id, CASE WHEN id % 3 = 0 THEN coalesce(title, '') WHEN id % 3 = 1 THEN '' ELSE 'x,y' END AS items FROM papers")
def tolerant_json(spark, sf):
    """SCL-13: arrays of JSON, or none."""
    raw = F.when(F.col("id") % 3 == 0, F.to_json(F.array(F.coalesce("title", F.lit(""))))).when(F.col("id") % 3 == 1, F.concat(F.lit("["), F.coalesce("title", F.lit("")))).otherwise('["x", "y"]')
    return _docs(spark, sf).select("id", F.array_join(tx.json_array(raw), ",").alias("items"))


# ---------------------------------------------------------------- search by an index
_WHOLE = "concat_ws(' ', title, abstract, venue)"
_SAVED = "SELECT paper_id FROM paper_user_events GROUP BY paper_id HAVING arg_max(event, struct_pack(a := created_at, b := id)) = 'save'"
_ASKED = "reason dans ciónos xy"


def _indexed(spark, sf) -> TrigramIndex:
    p = model(spark, sf, "papers").select("id", "title", "abstract", "venue", sc.citation_quality(F.col("citations"), F.col("citation_percentile")).alias("impact"))
    return TrigramIndex.build(spark, shared_dir(spark), p, ("title", "abstract", "venue"), F.col("impact"))


@query(f"""SELECT p.id AS id, s.paper_id IS NOT NULL AS is_saved, round(0.8 * (CAST(len(list_filter([{_quoted(_ASKED.split())}], lambda t: contains(lower({_WHOLE}), t))) AS DOUBLE) / {len(_ASKED.split())}) + 0.2 * ({_IMPACT}), 6) AS score
FROM papers AS p LEFT JOIN ({_SAVED}) AS s ON s.paper_id = p.id WHERE round(0.8 * (CAST(len(list_filter([{_quoted(_ASKED.split())}], lambda t: contains(lower({_WHOLE}), t))) AS DOUBLE) / {len(_ASKED.split())}) + 0.2 * ({_IMPACT}), 6) > 0 ORDER BY is_saved DESC, score DESC, id LIMIT 100""")
def indexed_search(spark, sf):
    """SCL-6, SRT-2: saved first, score above 0, the top 100 over whole texts, by trigram postings with score bounds."""
    saved = ev.fold_state(model(spark, sf, "paper_user_events")).where("last_event = 'save'").select(F.col("paper_id").alias("id"))
    return _indexed(spark, sf).ranked(_ASKED, saved)


@query("SELECT id, title FROM papers WHERE title ILIKE '%the r_as%' OR abstract ILIKE '%the r_as%' OR venue ILIKE '%the r_as%'")
def indexed_like(spark, sf):
    """FLT-3: a phrase with a wildcard in any of three columns, by the trigrams of its parts."""
    return _indexed(spark, sf).like("the r_as").select("id", "title")
