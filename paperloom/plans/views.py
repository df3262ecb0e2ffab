"""The engine's model tables over the driver's tables: one SQL text that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2024-02-01"

MODEL = {
    "papers": """SELECT d.doc_id AS id, substring(d.text, 1, 80) AS title, d.text AS abstract, d.source AS venue, CAST(2014 + d.doc_id % 12 AS INT) AS year,
  CASE WHEN d.doc_id % 3 = 0 THEN NULL ELSE make_date(CAST(2014 + d.doc_id % 11 AS INT), CAST(1 + d.doc_id % 12 AS INT), CAST(1 + d.doc_id % 28 AS INT)) END AS published_date,
  CAST(d.n_chars AS BIGINT) AS citations, CASE WHEN d.doc_id % 5 = 0 THEN CAST(d.doc_id % 101 AS DOUBLE) ELSE NULL END AS citation_percentile,
  CASE WHEN l.toxic IS NULL THEN NULL ELSE l.toxic = 0 END AS is_relevant, d.lang AS lang
  FROM {documents} AS d LEFT JOIN {labels} AS l ON l.doc_id = d.doc_id""",
    "paper_directions": """SELECT doc_id AS paper_id, concat('d', CAST(doc_id % 10 AS VARCHAR(20))) AS direction FROM {documents}
  UNION SELECT doc_id AS paper_id, concat('d', CAST((doc_id * 7 + 3) % 10 AS VARCHAR(20))) AS direction FROM {documents}""",
    "paper_user_events": """SELECT event_id AS id, event_id % 200 AS paper_id, CAST(ts AS TIMESTAMP) AS created_at,
  CASE event_type WHEN 'purchase' THEN 'save' WHEN 'signup' THEN 'library_import' WHEN 'view' THEN 'read' WHEN 'error' THEN 'hide' ELSE 'note' END AS event FROM {events}""",
    "feedback": """SELECT doc_id AS paper_id, concat('d', CAST(doc_id % 10 AS VARCHAR(20))) AS direction,
  CASE WHEN toxic = 1 THEN 'irrelevant' WHEN quality = 1 THEN 'relevant' ELSE 'partial' END AS label FROM {labels}""",
    "shown_history": """SELECT DISTINCT event_id % 500 AS paper_id, concat('d', CAST(event_id % 10 AS VARCHAR(20))) AS direction, CAST(ts AS DATE) AS shown_on FROM {events} WHERE event_type = 'click'""",
}
TABLES = ("documents", "labels", "events", "embeddings", "pages", "conversations", "orders", "lineitem", "customer")


def model(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = MODEL[name]
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **frames)


def duck(query: str) -> str:
    """A DuckDB query over the model tables."""
    used = [n for n in MODEL if n in query]
    head = ", ".join(f"{n} AS ({MODEL[n].format(**{t: t for t in TABLES})})" for n in used)
    if not head:
        return query
    q = query.strip()
    if q.upper().startswith("WITH "):
        return f"WITH {head}, {q[5:]}"
    return f"WITH {head} {q}"
