"""Queries of the flows that write, each over whole tables: saves, classifications, directions, deletes, caches, digests."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import cards
from paperloom.functions import text as tx
from paperloom.operators import daily as dy
from paperloom.operators import library as lib
from paperloom.operators import relational as ra
from paperloom.plans.flows import _docs, _quoted
from paperloom.plans.registry import query
from paperloom.plans.views import AS_OF, model
from paperloom.sources import curated



def _id():
    return F.col("id").cast("string")


def _links(spark, sf):
    """Links of the model whose labels are still their keys."""
    return model(spark, sf, "paper_directions").select("paper_id", "direction", F.col("direction").alias("direction_label"), F.lit(True).alias("is_relevant"))


@query("""SELECT CASE WHEN id % 2 = 0 THEN concat('W', id) WHEN id % 5 <> 0 THEN concat('10.1/', id) ELSE concat('saved:', regexp_replace(lower(trim(title)), '[^a-z0-9\\x{4e00}-\\x{9fff}]+', '-', 'g')) END AS id,
(id % 2 = 0 AND id % 3 = 0) OR (id % 5 <> 0 AND id % 3 = 1) AS already_existed FROM papers WHERE trim(coalesce(title, '')) <> ''""")
def saved_papers(spark, sf):
    """DML-17, JOIN-8: every paper is saved; two thirds of them are there already, by canonical id or by DOI."""
    d, i, none = _docs(spark, sf), F.col("id"), F.lit(None).cast("string")
    have = d.where(i % 3 != 2).select("id", F.when(i % 3 == 0, F.concat(F.lit("W"), _id())).alias("openalex_id"), F.when(i % 3 == 1, F.concat(F.lit("10.1/"), _id())).alias("doi"), "title")
    bodies = d.select(
        F.when(i % 2 == 0, F.concat(F.lit("W"), _id())).otherwise(none).alias("id"), F.when(i % 5 != 0, F.concat(F.lit("10.1/"), _id())).alias("doi"), "title", "year", "venue", F.lit("").alias("authors"), "abstract", none.alias("pdf_url"), none.alias("source"),
    )
    library = spark.createDataFrame([], "paper_id long, source string, external_key string, collection string")
    events = spark.createDataFrame([], "id long, paper_id long, event string, created_at timestamp")
    return lib.save_papers(have, library, events, bodies, F.lit(AS_OF))["outcome"].select("id", "already_existed")


_NEW = "SELECT DISTINCT a.id AS paper_id, unnest([concat('d', a.id % 10), concat('d', (a.id * 3) % 12)]) AS direction FROM papers AS a WHERE a.id % 7 <> 0"


@query(f"""WITH n AS ({_NEW}), fresh AS (SELECT n.* FROM n WHERE NOT EXISTS (SELECT 1 FROM paper_directions AS d WHERE d.paper_id = n.paper_id AND d.direction = n.direction)),
w AS (SELECT paper_id, direction, direction AS label FROM paper_directions UNION ALL SELECT paper_id, direction, CASE WHEN CAST(substring(direction, 2) AS INT) < 8 THEN concat('Label ', direction) ELSE direction END AS label FROM fresh)
SELECT p.id AS id, CASE WHEN p.id % 3 = 0 THEN 'd1' WHEN p.id % 7 <> 0 AND p.id % 10 < 8 THEN concat('d', p.id % 10) END AS direction, CASE WHEN p.id % 3 = 0 THEN 'own' WHEN p.id % 7 <> 0 AND p.id % 10 < 8 THEN concat('Label d', p.id % 10) END AS direction_label,
string_agg(concat(w.direction, '=', w.label), ',' ORDER BY w.direction) AS links FROM papers AS p JOIN w ON w.paper_id = p.id GROUP BY p.id""")
def classified_papers(spark, sf):
    """DML-14, DML-3: answers give links that are not there yet, and a primary direction to papers without one."""
    i = F.col("id")
    p = _docs(spark, sf).select("id", F.when(i % 3 == 0, "d1").otherwise("").alias("direction"), F.when(i % 3 == 0, "own").otherwise("").alias("direction_label"))
    key = lambda n: F.concat(F.lit("d"), n.cast("string"))
    answers = p.select(i.alias("paper_id"), F.when(i % 7 != 0, key(i % 10)).alias("primary_direction"), F.array(key(i * 3 % 12), key(i % 10)).alias("secondary_directions"))
    labels = spark.range(8).select(key(F.col("id")).alias("direction"), F.concat(F.lit("Label d"), _id()).alias("label"))
    papers, links = lib.apply_classification(p, _links(spark, sf), answers, labels)
    all_ = links.groupBy(F.col("paper_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "direction", "direction_label"))), ",").alias("links"))
    return papers.join(all_, "id").select("id", tx.truthy(F.col("direction")).alias("direction"), tx.truthy(F.col("direction_label")).alias("direction_label"), "links")


@query("""WITH s AS (SELECT id, concat('Topic ', CASE WHEN id % 2 = 1 THEN ' ' ELSE '' END, coalesce(venue, 'none')) AS label, concat('find ', id % 11) AS q FROM papers),
c(key, label, q) AS (VALUES ('old-a', 'Topic src0', 'find x'), ('old-b', 'Other', 'find 7'), ('topic-src3', 'Old topic', 'find y')),
f AS (SELECT label, min(q) AS q, regexp_replace(regexp_replace(lower(label), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM s WHERE label <> 'Topic src0' AND q <> 'find 7' GROUP BY label),
k AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY label) + CASE WHEN slug = 'topic-src3' THEN 1 ELSE 0 END AS n FROM f),
every AS (SELECT * FROM c UNION ALL SELECT CASE WHEN n = 1 THEN slug ELSE concat(slug, '-', n) END AS key, label, q FROM k),
hit AS (SELECT s.id AS id, CASE WHEN s.label = 'Topic src0' THEN 'old-a' WHEN s.q = 'find 7' THEN 'old-b' ELSE e.key END AS key FROM s JOIN every AS e ON e.label = s.label OR (s.q = 'find 7' AND e.key = 'old-b' AND s.label <> 'Topic src0' AND NOT EXISTS (SELECT 1 FROM every AS x WHERE x.label = s.label)))
SELECT e.key AS key, e.label AS label, e.q AS query, CAST(count(DISTINCT h.id) AS BIGINT) AS papers FROM every AS e LEFT JOIN hit AS h ON h.key = e.key GROUP BY e.key, e.label, e.q""")
def suggested_directions(spark, sf):
    """DML-15, DML-13: a suggestion for every paper; known labels and queries are linked, others make directions with keys of their own."""
    i = F.col("id")
    custom = spark.sql("SELECT * FROM VALUES ('old-a', 'Topic src0', 'find x', '#'), ('old-b', 'Other', 'find 7', '#'), ('topic-src3', 'Old topic', 'find y', '#') AS t(key, label, query, color)")
    s = _docs(spark, sf).select(i.alias("paper_id"), F.concat(F.lit("Topic "), F.when(i % 2 == 1, " ").otherwise(""), F.coalesce("venue", F.lit("none"))).alias("label"), F.concat(F.lit("find "), (i % 11).cast("string")).alias("query"))
    none = spark.createDataFrame([], "paper_id long, direction string, direction_label string, is_relevant boolean")
    made, links = lib.suggest_directions(custom, none, s)
    n = links.groupBy(F.col("direction").alias("key")).agg(F.count("*").alias("papers"))
    return made.join(n, "key", "left").select("key", "label", "query", F.coalesce("papers", F.lit(0)).alias("papers"))


@query("SELECT paper_id, direction, CAST(shown_on AS VARCHAR) AS shown_on FROM shown_history AS s WHERE NOT EXISTS (SELECT 1 FROM feedback AS f WHERE f.paper_id = s.paper_id AND f.direction = s.direction AND f.label = 'irrelevant')")
def snapshot_without_rejected(spark, sf):
    """DML-10: rows of snapshots go with the papers that were called irrelevant."""
    gone = model(spark, sf, "feedback").where("label = 'irrelevant'")
    return lib.delete_rows(model(spark, sf, "shown_history"), gone, ["paper_id", "direction"]).select("paper_id", "direction", F.col("shown_on").cast("string").alias("shown_on"))


@query("SELECT id, CASE WHEN id % 3 <> 0 AND id % 2 = 1 AND id % 5 <> 0 THEN concat('zh ', id) END AS translation FROM papers")
def cached_abstracts(spark, sf):
    """DML-20, FLT-9: translations kept for one model and content; other models' and those of changed abstracts don't count."""
    i, digest = F.col("id"), F.md5(F.coalesce("abstract", F.lit("")))
    p = _docs(spark, sf)
    cache = p.where(i % 3 != 0).select("id", F.when(i % 2 == 1, "m1").otherwise("m2").alias("model"), F.when(i % 5 == 0, "old").otherwise(digest).alias("digest"), F.concat(F.lit("zh "), _id()).alias("translation"))
    hit, missing = lib.cached_translations(p.select("id", "abstract"), cache, digest, "m1")
    return hit.select("id", "translation").unionByName(missing.select("id", F.lit(None).cast("string").alias("translation")))


@query("SELECT paper_id, arg_max(event, struct_pack(a := created_at, b := id)) AS event, max(created_at) AS created_at FROM paper_user_events GROUP BY paper_id")
def latest_event_of_papers(spark, sf):
    """WIN-4: the last event of each paper, ties by id."""
    e = model(spark, sf, "paper_user_events")
    return ra.latest(e, ["paper_id"], [F.desc("created_at"), F.desc("id")]).select("paper_id", "event", "created_at")


@query("SELECT paper_id, direction, CASE WHEN CAST(substring(direction, 2) AS INT) % 4 = 3 THEN direction WHEN CAST(substring(direction, 2) AS INT) % 2 = 0 THEN concat('Custom ', direction) ELSE concat('Built in ', direction) END AS direction_label FROM paper_directions")
def relabelled_links(spark, sf):
    """JOIN-17, DML-6: links whose label is their key get a label, custom ones before built-in ones."""
    n, keys = F.substring("direction", 2, 9).cast("int"), model(spark, sf, "paper_directions").select("direction").distinct()
    built_in = keys.where(n % 4 != 3).select("direction", F.concat(F.lit("Built in "), "direction").alias("label"))
    custom = keys.select(F.col("direction").alias("key"), F.when(n % 2 == 0, F.concat(F.lit("Custom "), "direction")).otherwise("").alias("label"))
    labels = lib.override_labels(built_in, custom).where("label is not null")
    return lib.relabel(_links(spark, sf), labels).select("paper_id", "direction", "direction_label")


@query(f"""WITH t AS (SELECT id, year, CASE WHEN id % 9 = 0 THEN concat('* ', upper(([{_quoted([c[0] for c in curated.CLASSICS])}])[id % {len(curated.CLASSICS)} + 1]), '!') ELSE coalesce(title, '') END AS title FROM papers),
c AS (SELECT unnest([{_quoted([curated.bare_title(c[0]) for c in curated.CLASSICS])}]) AS bare, unnest([{_quoted([c[4] for c in curated.CLASSICS])}]) AS arxiv_id, unnest([{_quoted([','.join(c[5]) for c in curated.CLASSICS])}]) AS directions)
SELECT t.id AS id, c.arxiv_id AS arxiv_id, c.directions AS directions FROM t JOIN c ON c.bare = regexp_replace(lower(t.title), '[^a-z0-9\\x{{4e00}}-\\x{{9fff}}]+', '', 'g')""")
def classics_of_corpus(spark, sf):
    """SRC-16, SCL-28: which papers are curated classics, whatever the case and signs of their titles, and their directions."""
    named = F.element_at(F.array(*[F.lit(c[0]) for c in curated.CLASSICS]), (F.col("id") % len(curated.CLASSICS) + 1).cast("int"))
    p = _docs(spark, sf).select("id", F.when(F.col("id") % 9 == 0, F.concat(F.lit("* "), F.upper(named), F.lit("!"))).otherwise(F.coalesce("title", F.lit(""))).alias("title"))
    c = curated.classics(spark).select(tx.normalize_title(F.col("title")).alias("bare"), "arxiv_id", F.array_join("directions", ",").alias("directions"))
    return p.where(curated.is_classic(F.col("title"))).withColumn("bare", tx.normalize_title(F.col("title"))).join(F.broadcast(c), "bare").select("id", "arxiv_id", "directions")


@query("""SELECT id, CASE WHEN id % 5 = 4 OR trim(t) = '' THEN '摘要未说明' ELSE trim(t) END AS summary, CASE WHEN id % 5 = 4 OR id % 4 = 0 THEN '摘要未说明' WHEN id % 4 = 1 THEN 'a' ELSE 'a|b|c' END AS innovations, CASE WHEN id % 5 = 4 OR id % 3 = 0 THEN '摘要未说明' ELSE 'how' END AS method
FROM (SELECT id, coalesce(abstract, '') AS t FROM papers) AS x""")
def summaries_of_papers(spark, sf):
    """SCL-17: a model's summaries, whole texts, some without parts and some broken."""
    i, none = F.col("id"), F.lit(None).cast("string")
    new = F.when(i % 4 == 0, F.array(F.lit(" "), F.lit(""))).when(i % 4 == 1, F.array(F.lit(" a "), none)).otherwise(F.array(*map(F.lit, ("a", "", "b", " c", "d"))))
    whole = F.to_json(F.struct(F.coalesce("abstract", F.lit("")).alias("summary_zh"), new.alias("innovations_zh"), F.when(i % 3 == 0, F.when(i % 2 == 0, "  ")).otherwise(" how").alias("method_zh")))
    answer = F.when(i % 5 == 4, "no answer").when(i % 2 == 0, F.concat(F.lit("```json\n"), whole, F.lit("\n```"))).otherwise(whole)
    s = _docs(spark, sf).select("id", cards.normalize_summary(answer).alias("s"))
    return s.select("id", F.col("s.summary_zh").alias("summary"), F.array_join("s.innovations_zh", "|").alias("innovations"), F.col("s.method_zh").alias("method"))


@query("SELECT id, CAST(coalesce(citations, 0) AS DOUBLE) AS score FROM papers ORDER BY score DESC, id LIMIT 10")
def legacy_most_cited(spark, sf):
    """SCL-40: no preferences, so the most cited papers; a top-10 report."""
    weights = model(spark, sf, "feedback").where("label = 'unheard of'").groupBy("direction").agg(F.count("*").cast("double").alias("weight"))
    p = _docs(spark, sf).withColumn("rank", F.lit("A"))
    return ra.legacy_recommend(p, model(spark, sf, "paper_directions"), weights)


@query("""WITH w AS (SELECT direction, count(*) / 100.0 AS weight FROM feedback WHERE label = 'relevant' GROUP BY direction)
SELECT p.id AS id, round(sum(w.weight) * log10(p.citations + 1) * (CASE p.id % 4 WHEN 0 THEN 1.5 WHEN 1 THEN 1.2 WHEN 2 THEN 1.0 ELSE 0.7 END) * exp(-0.15 * (2026 - p.year)), 6) AS score
FROM papers AS p JOIN paper_directions AS d ON d.paper_id = p.id JOIN w ON w.direction = d.direction GROUP BY p.id, p.citations, p.year ORDER BY score DESC, id LIMIT 10""")
def legacy_by_weights(spark, sf):
    """JOIN-9, AGG-8, SCL-40: the same flow with weights from the feedback table; a top-10 report."""
    weights = model(spark, sf, "feedback").where("label = 'relevant'").groupBy("direction").agg((F.count("*") / 100).alias("weight"))
    rank = F.element_at(F.array(*map(F.lit, "ABCD")), (F.col("id") % 4 + 1).cast("int"))
    return ra.legacy_recommend(_docs(spark, sf).withColumn("rank", rank), model(spark, sf, "paper_directions"), weights)


@query("""WITH r AS (SELECT d.direction AS direction, p.id AS id, coalesce(p.title, '') AS title, p.year AS year, row_number() OVER (PARTITION BY d.direction ORDER BY p.citations DESC, p.id) - 1 AS rank FROM papers AS p JOIN paper_directions AS d ON d.paper_id = p.id),
s AS (SELECT CASE WHEN direction >= 'd6' THEN 'Exploration' ELSE concat('Field ', direction) END AS section, direction >= 'd6' AS last, rank, id, concat(CASE WHEN id % 2 = 0 THEN concat('[', title, '](http://p/', id, ')') ELSE title END, ' (', year, ')') AS line FROM r WHERE rank < 3),
n AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY rank, id, line) AS k FROM s)
SELECT section, CAST(row_number() OVER (ORDER BY last, section) AS INT) AS position, concat('## ', section, chr(10), chr(10), string_agg(concat(k, '. ', line), chr(10) ORDER BY k)) AS markdown FROM n GROUP BY section, last""")
def digest_with_exploration(spark, sf):
    """SNK-2: the three most cited papers of each direction; what is explored stands in one section at the end."""
    p = _docs(spark, sf).select("id", "title", "year", "citations").join(model(spark, sf, "paper_directions"), F.col("id") == F.col("paper_id"))
    top = ra.top_n(p, ["direction"], [F.desc("citations"), F.col("id")], 3)
    top = top.withColumns({"kind": F.when(F.col("direction") >= "d6", "exploration").otherwise("personal"), "direction_label": F.concat(F.lit("Field "), "direction"), "pdf_url": F.when(F.col("id") % 2 == 0, F.concat(F.lit("http://p/"), _id()))})
    return dy.digest(top)
