"""Queries over streams and stored tables: each runs its flow over the whole table and returns what readers then see."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.cluster import shared_dir
from paperloom.operators.stored import StoredTable, ingest, progress
from paperloom.plans.registry import query
from paperloom.plans.views import AS_OF, model
from paperloom.streaming import stateful as st

LEASE_S, LATE_S = 43_200, 600
_COMMAND = "CASE event_type WHEN 'view' THEN 'claim' WHEN 'signup' THEN 'claim' WHEN 'click' THEN 'heartbeat' WHEN 'purchase' THEN 'finish' ELSE 'fail' END"


def _event_stream(spark, sf):
    """events as a stream: a glob, as a stream reads folders or globs and not one file."""
    return spark.readStream.schema(spark.read.parquet(f"{sf}/events.parquet").schema).parquet(f"{sf}/events*.parquet")


def _paper_events(events):
    """The model's events of papers, of the stream."""
    name = F.expr("CASE event_type WHEN 'purchase' THEN 'save' WHEN 'signup' THEN 'library_import' WHEN 'view' THEN 'read' WHEN 'error' THEN 'hide' ELSE 'note' END")
    return events.select(F.col("event_id").alias("id"), (F.col("event_id") % 200).alias("paper_id"), F.col("ts").cast("timestamp").alias("created_at"), name.alias("event"))


# ---------------------------------------------------------------- streams
@query(f"""WITH RECURSIVE c AS (SELECT user_id AS job, epoch_us(ts) AS "at", event_id AS id, {_COMMAND} AS command, event_id % 2 AS worker FROM events),
mark AS (SELECT (max("at") // 1000 - {LATE_S * 1000}) * 1000 AS wm FROM c),
o AS (SELECT c.*, row_number() OVER (PARTITION BY job ORDER BY "at", id) AS seq FROM c, mark WHERE "at" < wm),
s AS (SELECT DISTINCT job, CAST(0 AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS "at", CAST(NULL AS BIGINT) AS id, CAST(NULL AS VARCHAR) AS command, CAST(NULL AS BIGINT) AS worker, false AS ok, CAST(NULL AS BIGINT) AS held, CAST(NULL AS BIGINT) AS until, CAST(NULL AS BIGINT) AS gone, CAST(NULL AS BIGINT) AS lost FROM o
UNION ALL SELECT job, seq, "at", id, command, worker, ok, CASE WHEN ok AND command IN ('claim', 'heartbeat') THEN worker WHEN ok THEN NULL WHEN alive THEN held END, CASE WHEN ok AND command IN ('claim', 'heartbeat') THEN "at" + {LEASE_S}000000 WHEN ok THEN NULL WHEN alive THEN until END,
  CASE WHEN held IS NOT NULL AND NOT alive THEN until END, held
  FROM (SELECT o.*, s.held AS held, s.until AS until, s.held IS NOT NULL AND s.until >= o."at" AS alive, CASE WHEN o.command = 'claim' THEN NOT (s.held IS NOT NULL AND s.until >= o."at") ELSE s.held IS NOT NULL AND s.until >= o."at" AND s.held = o.worker END AS ok
    FROM s JOIN o ON o.job = s.job AND o.seq = s.seq + 1) AS x)
SELECT job, "at", id, command, worker, CASE WHEN NOT ok THEN 'refused' WHEN command = 'claim' THEN 'claimed' ELSE 'done' END AS outcome FROM s WHERE seq > 0
UNION ALL SELECT job, gone AS "at", -1 AS id, 'expire' AS command, lost AS worker, 'expired' AS outcome FROM s WHERE gone IS NOT NULL
UNION ALL SELECT job, until AS "at", -1 AS id, 'expire' AS command, held AS worker, 'expired' AS outcome FROM (SELECT *, row_number() OVER (PARTITION BY job ORDER BY seq DESC) AS r FROM s) AS l, mark WHERE r = 1 AND held IS NOT NULL AND until < wm""")
def lease_stream(spark, sf):
    """STR-8, DML-5: the events of each user as commands of two workers on one job, as a stream with event-time timers."""
    e = _event_stream(spark, sf)
    commands = e.select(F.col("user_id").cast("long").alias("job"), F.col("ts").alias("at"), F.col("event_id").alias("id"), F.expr(_COMMAND).alias("command"), (F.col("event_id") % 2).alias("worker"))
    return st.run_leases(commands, shared_dir(spark), lease_s=LEASE_S, late=f"{LATE_S} seconds")


@query("SELECT paper_id, arg_max(event, struct_pack(a := created_at, b := id)) AS last_event, max(CASE WHEN event = 'save' THEN 1 ELSE 0 END) AS ever_saved, CAST(count(*) AS BIGINT) AS n FROM paper_user_events GROUP BY paper_id")
def user_state_stream(spark, sf):
    """STR-1: the event log folded by a stream into a table of updates, of which readers see the last of each paper."""
    folder = shared_dir(spark)
    table = st.BatchTable(spark, f"{folder}/state", "paper_id long, last_event string, ever_saved int, n long")
    st.run_available(st.stream_flags(_paper_events(_event_stream(spark, sf))), f"{folder}/checkpoint", "update", table.write)
    return table.latest("paper_id")


_WEIGHT = "CASE event WHEN 'save' THEN 4 WHEN 'library_import' THEN 3 WHEN 'read' THEN 1 WHEN 'hide' THEN -3 ELSE 2 END"


@query(f"SELECT d.direction AS direction, round(sum({_WEIGHT} * exp(-(epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(e.created_at)) / 86400e6 / 90)), 4) AS score FROM paper_user_events AS e JOIN paper_directions AS d ON d.paper_id = e.paper_id GROUP BY d.direction")
def preference_stream(spark, sf):
    """STR-3: decayed preferences of a stream joined with the links, read at a later time."""
    folder = shared_dir(spark)
    weighted = _paper_events(_event_stream(spark, sf)).join(model(spark, sf, "paper_directions"), "paper_id").withColumn("weight", F.expr(_WEIGHT))
    table = st.BatchTable(spark, f"{folder}/sums", "direction string, scaled double")
    st.run_available(st.stream_decayed_sums(weighted), f"{folder}/checkpoint", "update", table.write)
    return st.preference_at(table.latest("direction"), AS_OF).select("direction", F.round("score", 4).alias("score"))


# ---------------------------------------------------------------- stored tables
_STATE = "paper_id long, event string, at long, n long"


def _events_by_paper(spark, sf):
    e = model(spark, sf, "paper_user_events")
    return e.select("paper_id", F.col("event"), F.unix_micros("created_at").alias("at"), F.col("id").alias("n"))


@query("""WITH e AS (SELECT paper_id, event, epoch_us(created_at) AS "at", id AS n FROM paper_user_events), f AS (SELECT paper_id, event, max("at") AS "at" FROM e WHERE "at" < epoch_us(TIMESTAMP '2024-01-16') GROUP BY paper_id, event), g AS (SELECT paper_id, event, max("at") AS "at", arg_max(n, "at") AS n FROM e GROUP BY paper_id, event)
SELECT g.paper_id AS paper_id, g.event AS event, g."at" AS "at", g.n AS n, CASE WHEN f."at" IS NULL THEN 'inserted' WHEN g."at" > f."at" THEN 'updated' ELSE 'refused' END AS outcome FROM g LEFT JOIN f ON f.paper_id = g.paper_id AND f.event = g.event""")
def stored_upserts(spark, sf):
    """DML-2, DML-5: the last event of each kind and paper, stored in mid-month and then set to that of the whole log
    where it is newer; outcome: what the second write did."""
    table = StoredTable(spark, f"{shared_dir(spark)}/state", _STATE, ["paper_id", "event"], buckets=16)
    newest = lambda df: df.groupBy("paper_id", "event").agg(F.max_by(F.struct("at", "n"), "at").alias("m")).select("paper_id", "event", "m.at", "m.n")
    e = _events_by_paper(spark, sf)
    table.upsert(newest(e.where(F.col("at") < F.unix_micros(F.lit("2024-01-16").cast("timestamp")))))
    before, last = table.read(), newest(e)
    table.upsert(last, may="new.at > old.at")
    told = last.alias("n").join(before.alias("o"), ["paper_id", "event"], "left").select("paper_id", "event", F.expr("CASE WHEN o.at IS NULL THEN 'inserted' WHEN n.at > o.at THEN 'updated' ELSE 'refused' END").alias("outcome"))
    return table.read().join(told, ["paper_id", "event"])


@query("""WITH o AS (SELECT DISTINCT user_id AS source, event_type AS item FROM events), gone AS (SELECT user_id AS source FROM events GROUP BY user_id HAVING count(*) FILTER (event_type = 'error') > count(*) FILTER (event_type = 'view')),
n AS (SELECT DISTINCT user_id AS source, concat(event_type, '+') AS item FROM events WHERE event_type <> 'error')
SELECT * FROM o WHERE source NOT IN (SELECT source FROM gone) AND item <> 'click' UNION ALL SELECT * FROM n WHERE source IN (SELECT source FROM gone) AND item <> 'click+'""")
def stored_children(spark, sf):
    """DML-9, DML-10: the children of some parents replaced as a whole, then rows deleted by key."""
    e = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").alias("source"), F.col("event_type").alias("item"))
    table = StoredTable(spark, f"{shared_dir(spark)}/children", "source long, item string", ["source", "item"], by=["source"], buckets=16)
    table.upsert(e)
    gone = e.groupBy("source").agg(F.count_if(F.col("item") == "error").alias("a"), F.count_if(F.col("item") == "view").alias("b")).where("a > b").select("source")
    table.replace_children(gone, e.where("item <> 'error'").withColumn("item", F.concat("item", F.lit("+"))))
    table.delete(table.read().where("item IN ('click', 'click+')"))
    return table.read()


@query("""SELECT user_id AS id, event_type AS kind, CAST(max(event_id) AS BIGINT) AS newest, CAST(max(max(event_id)) OVER (PARTITION BY event_type) AS BIGINT) AS progress FROM events GROUP BY user_id, event_type""")
def incremental_ingest(spark, sf):
    """STR-4, DML-1: a stream of events upserted batch by batch (foreachBatch), progress committed with the data, and a
    second run on the same checkpoint, which finds nothing new."""
    folder = shared_dir(spark)
    table = StoredTable(spark, f"{folder}/ingested", "id long, kind string, newest long", ["id", "kind"], buckets=16)
    rows = _event_stream(spark, sf).select(F.col("user_id").alias("id"), F.col("event_type").alias("kind"), F.col("event_id").alias("newest"))

    newest = lambda df: df.groupBy("id", "kind").agg(F.max("newest").alias("newest"))
    for _ in range(2):
        ingest(rows, table, f"{folder}/checkpoint", "events", ["kind"], "newest", fold=newest, may="new.newest > old.newest")
    far = spark.createDataFrame([(k[0], v) for k, v in progress(table, "events").items()], "kind string, progress long")
    return table.read().join(F.broadcast(far), "kind")


# ---------------------------------------------------------------- rounds, graphs, folds, table functions
def _checkpoint(spark):
    folder = shared_dir(spark)

    def keep(df, name):
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    return keep


@query("""WITH RECURSIVE p AS (SELECT user_id, epoch_us(ts) AS t, event_id AS id FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, epoch_us(ts) AS t, event_id AS id FROM events WHERE event_type = 'view'),
e AS (SELECT p.user_id AS user_id, p.id AS l, v.id AS r, p.t - v.t AS d, row_number() OVER (PARTITION BY p.user_id ORDER BY p.t - v.t, p.id, v.id) AS k FROM p JOIN v ON v.user_id = p.user_id AND v.t <= p.t AND p.t - v.t <= 86400000000),
s AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS used_l, CAST([] AS BIGINT[]) AS used_r, CAST(NULL AS BIGINT) AS l, CAST(NULL AS BIGINT) AS r, CAST(NULL AS BIGINT) AS d, false AS took FROM e
UNION ALL SELECT e.user_id, e.k, CASE WHEN NOT list_contains(s.used_l, e.l) AND NOT list_contains(s.used_r, e.r) THEN list_append(s.used_l, e.l) ELSE s.used_l END, CASE WHEN NOT list_contains(s.used_l, e.l) AND NOT list_contains(s.used_r, e.r) THEN list_append(s.used_r, e.r) ELSE s.used_r END,
  e.l, e.r, e.d, NOT list_contains(s.used_l, e.l) AND NOT list_contains(s.used_r, e.r) FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1)
SELECT user_id, l AS purchase, r AS seen, d AS distance FROM s WHERE took""")
def nearest_unused_views(spark, sf):
    """JOIN-18: each purchase with its nearest unused view of the same user in the day before, closest pairs first."""
    from paperloom.operators.matching_rounds import nearest_unused

    e = spark.read.parquet(f"{sf}/events.parquet").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("id"), "event_type")
    out = nearest_unused(e.where("event_type = 'purchase'"), e.where("event_type = 'view'"), "user_id", 86_400_000_000, backwards=True, keep=_checkpoint(spark))
    return out.select("user_id", F.col("left_id").alias("purchase"), F.col("right_id").alias("seen"), "distance")


@query("""WITH k AS (SELECT l_orderkey AS source, l_partkey AS target, min(l_linenumber) - 1 AS position FROM lineitem GROUP BY 1, 2),
b AS (SELECT source AS id, 'reference' AS relation, target AS other, row_number() OVER (PARTITION BY source ORDER BY position, target) AS rank FROM k
UNION ALL SELECT target AS id, 'cited_by' AS relation, source AS other, row_number() OVER (PARTITION BY target ORDER BY source) AS rank FROM k)
SELECT id, relation, other, CAST(rank AS INT) AS rank FROM b WHERE rank <= 8""")
def neighbours_of_nodes(spark, sf):
    """SRC-8: orders that refer to parts as a graph: of every node its first eight references and citing nodes."""
    from paperloom.operators.matching_rounds import fold_edges, neighbours

    e = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("target"), (F.col("l_linenumber") - 1).alias("position"))
    return neighbours(fold_edges(e))


@query("""WITH u AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS url, html FROM pages), known AS (SELECT url AS u, min(page_id) AS target FROM u GROUP BY url), host AS (SELECT regexp_extract(url, '^[a-zA-Z]+://[^/?#]*') AS h, min(page_id) AS target FROM u GROUP BY 1),
l AS (SELECT page_id AS source, regexp_extract(url, '^[a-zA-Z]+://[^/?#]*') AS h FROM u)
SELECT l.source AS id, 'reference' AS relation, host.target AS other, CAST(1 AS INT) AS rank FROM l JOIN host ON host.h = l.h WHERE host.target <> l.source
UNION ALL SELECT * FROM (SELECT host.target AS id, 'cited_by' AS relation, l.source AS other, CAST(row_number() OVER (PARTITION BY host.target ORDER BY l.source) AS INT) AS rank FROM l JOIN host ON host.h = l.h WHERE host.target <> l.source) AS x WHERE rank <= 8""")
def citation_neighbours_of_pages(spark, sf):
    """SRC-8 over all pages: each links, by an address without its host, to the first page of its scheme and host."""
    from paperloom.operators.matching_rounds import link_edges, neighbours

    p = spark.read.parquet(f"{sf}/pages.parquet")
    host = F.regexp_extract("url", r"^[a-zA-Z]+://[^/?#]*", 0)
    first = p.groupBy(host.alias("_h")).agg(F.min_by(F.regexp_replace("url", "#.*$", ""), "page_id").alias("_first"))
    path = F.regexp_replace("_first", r"^[a-zA-Z]+://[^/?#]*", "")
    linked = p.join(first, host == F.col("_h")).withColumn("html", F.concat("html", F.lit('<a class="x" href="'), F.when(F.startswith(path, F.lit("/")), path).otherwise(F.col("_first")), F.lit('">first</a>')))
    return neighbours(link_edges(linked.select("page_id", "url", "html")))


@query("""WITH x AS (SELECT venue AS k, id, concat('s', id % 7) AS name, concat('i', id) AS value FROM papers UNION ALL SELECT venue, id, lang, title FROM papers WHERE lang IS NOT NULL),
l AS (SELECT k, name, arg_max(value, id) AS value FROM x WHERE value IS NOT NULL GROUP BY k, name), n AS (SELECT DISTINCT venue AS k FROM papers)
SELECT n.k AS k, coalesce(CAST(count(l.name) AS BIGINT), 0) AS entries, coalesce(sha256(string_agg(concat(l.name, '=', l.value), ';' ORDER BY l.name)), sha256('')) AS digest FROM n LEFT JOIN l ON l.k IS NOT DISTINCT FROM n.k WHERE n.k IS NOT NULL GROUP BY n.k""")
def fold_of_maps(spark, sf):
    """AGG-13, MRG-1, SET-4: the maps of all papers of a venue folded, each entry with its last value."""
    from paperloom.operators import relational as ra

    p = model(spark, sf, "papers").where("venue IS NOT NULL")
    own = F.map_from_arrays(F.array(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))), F.array(F.concat(F.lit("i"), F.col("id").cast("string"))))
    named = F.when(F.col("lang").isNotNull() & F.col("title").isNotNull(), F.map_from_arrays(F.array("lang"), F.array("title")))
    f = ra.fold_merge(p.select(F.col("venue").alias("k"), "id", own.alias("source_ids"), named.alias("source_urls")), "k", "id")
    every = F.array_sort(F.concat(F.map_entries("source_ids"), F.map_entries("source_urls")))
    return f.select("k", F.size(every).cast("long").alias("entries"), F.sha2(F.array_join(F.transform(every, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";"), 256).alias("digest"))


@query("""SELECT id, 'article' AS entry_type, concat('k', id) AS entry_key, trim(regexp_replace(coalesce(title, ''), '[^a-zA-Z ]', '', 'g')) AS title, year FROM papers WHERE trim(regexp_replace(coalesce(title, ''), '[^a-zA-Z ]', '', 'g')) <> ''""")
def bibtex_table_function(spark, sf):
    """UDTF-1: a table function called from SQL with a table argument, partitioned by year."""
    from paperloom.cluster import ship_code
    from paperloom.operators.matching_rounds import bibtex_function

    ship_code(spark)
    spark.udtf.register("parse_bibtex", bibtex_function())
    title = F.trim(F.regexp_replace(F.coalesce("title", F.lit("")), "[^a-zA-Z ]", ""))
    p = model(spark, sf, "papers").select("id", "year", title.alias("t"))
    text = F.concat(F.lit("@article{k"), F.col("id").cast("string"), F.lit(",\n  title = {"), F.col("t"), F.lit("},\n  year = "), F.col("year").cast("string"), F.lit("\n}\n@misc{none,\n  note = {no title}\n}\n"))
    return spark.sql("SELECT id, entry_type, entry_key, title, year FROM parse_bibtex(TABLE({rows}) PARTITION BY part)", rows=p.select("id", F.col("year").alias("part"), text.alias("bibtex")))
