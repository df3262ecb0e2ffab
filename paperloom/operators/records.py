"""Upsert of whole paper records: entity match, field-by-field merge, derived metadata, and what changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import scoring as sc
from paperloom.functions.text import first_truthy, normalize_doi, normalize_title, truthy
from paperloom.operators import relational as ra
from paperloom.sources.curated import is_classic

#: Columns of a record, with their types.
RECORD = {
    "openalex_id": "string", "title": "string", "abstract": "string", "year": "int", "published_date": "string", "venue": "string", "citations": "long", "citation_percentile": "double", "authors": "string", "doi": "string", "pdf_url": "string",
    "direction": "string", "direction_label": "string", "publication_channel": "string", "arxiv_id": "string", "semantic_scholar_id": "string", "normalized_title": "string", "sources": "array<string>", "source_ids": "map<string,string>", "source_urls": "map<string,string>",
}
#: Columns derived from a record.
METADATA = ("venue_type", "venue_tier", "publication_status", "venue_verified", "venue_confidence", "quality_score", "is_frontier", "is_classic", "discovery_reason", "recommendation_score")
#: Columns of which a change makes a record `updated`.
WATCHED = (
    "title", "abstract", "year", "published_date", "venue", "citations", "citation_percentile", "authors", "doi", "pdf_url", "publication_channel", "venue_type", "venue_tier", "publication_status", "venue_verified",
    "venue_confidence", "quality_score", "is_frontier", "is_classic", "discovery_reason", "recommendation_score", "sources", "source_ids", "source_urls",
)


def parse_date(c: Column) -> Column:
    """Date of `YYYY-MM-DD`, an ISO time or `YYYY-MM`; null for anything else."""
    s = c.cast("string")
    return F.coalesce(F.try_to_timestamp(F.substring(s, 1, 10), F.lit("yyyy-MM-dd")), F.try_to_timestamp(F.substring(s, 1, 7), F.lit("yyyy-MM"))).cast("date")


def with_metadata(papers: DataFrame, as_of: Column, sources: Column | None = None) -> DataFrame:
    """Papers with all derived columns recomputed (a projection; nothing is stored); a classic is never frontier.

    What several columns need is computed first, once. sources: of which a venue's confidence is judged, if others than
    the paper's own."""
    c = lambda n: F.col(n) if n in papers.columns else F.lit(None).cast(RECORD[n])
    known = F.coalesce(sources if sources is not None else c("sources"), F.array().cast("array<string>"))
    first = papers.withColumns({
        "_kind": sc.venue_type(c("venue"), c("publication_channel")), "_tier": sc.venue_tier(c("venue"), c("publication_channel")), "_status": sc.publication_status(c("venue"), c("publication_channel")),
        "_classic": is_classic(c("title")), "_recent": sc.is_frontier(c("year"), parse_date(c("published_date")), as_of), "_impact": sc.citation_quality(c("citations"), c("citation_percentile")), "_known": known,
    })
    kind, tier, classic, recent, impact, seen = (F.col(x) for x in ("_kind", "_tier", "_classic", "_recent", "_impact", "_known"))
    frontier = recent & ~classic
    new = {
        "venue_type": kind, "venue_tier": tier, "publication_status": F.col("_status"), "venue_verified": F.coalesce(truthy(c("venue")).isNotNull() & (F.size(seen) > 0), F.lit(False)),
        "venue_confidence": sc.venue_confidence(c("venue"), seen, kind), "quality_score": 0.6 * (tier / 3) + 0.4 * impact, "is_frontier": frontier, "is_classic": classic,
        "discovery_reason": sc.discovery_reason(classic, recent, tier), "recommendation_score": sc.recommendation_score(frontier, classic, c("year"), tier, impact, as_of),
    }
    return first.withColumns(new).drop("_kind", "_tier", "_status", "_classic", "_recent", "_impact", "_known")


def complete(df: DataFrame) -> DataFrame:
    """All record columns in their types; missing ones are null. Other columns stay in front."""
    have = set(df.columns)
    rest = [F.col(c) for c in df.columns if c not in RECORD]
    return df.select(*rest, *[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in RECORD.items()])


def canonical_id(openalex: Column, doi: Column, arxiv: Column, title: Column, year: Column) -> Column:
    return F.coalesce(
        truthy(openalex), F.concat(F.lit("doi:"), truthy(doi)), F.concat(F.lit("arxiv:"), truthy(arxiv)),
        F.concat(F.lit("title:"), F.coalesce(normalize_title(title), F.lit("")), F.lit(":"), F.coalesce(F.nullif(year, F.lit(0)).cast("string"), F.lit("unknown"))),
    )


def entity_keys(title: Column) -> list[tuple[str, Column]]:
    """Keys by which a record is found, first ones first; title is the normalised title."""
    c = F.col
    named = [("doi", normalize_doi(c("doi")))] + [(n, truthy(c(n))) for n in ("openalex_id", "arxiv_id", "semantic_scholar_id")]
    return [*named, ("title", F.when(truthy(title).isNotNull() & c("year").isNotNull(), F.concat_ws(":", title, c("year"))))]


def _right_biased(a: Column, b: Column) -> Column:
    none = F.create_map().cast("map<string,string>")
    a, b = F.coalesce(a, none), F.coalesce(b, none)
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def _text(name: str, c: Column) -> Column:
    """What a change is compared by: null and empty are one."""
    kind = RECORD.get(name, "")
    if kind.startswith("map"):
        c = F.to_json(F.array_sort(F.map_entries(F.coalesce(c, F.create_map().cast(kind)))))
    elif kind.startswith("array"):
        c = F.to_json(F.coalesce(c, F.array().cast(kind)))
    return F.coalesce(c.cast("string"), F.lit(""))


def upsert_records(old: DataFrame, new: DataFrame, as_of: Column, embedding_model: str = "") -> DataFrame:
    """All records after new ones came in, with status and needs_embedding.

    old(id, record columns, derived columns if it has them), new(n, record columns): n is the order in which records
    came. Each new record is matched by DOI, then OpenAlex, arXiv and Semantic Scholar id, then normalised title with
    year; records that meet in one row (or in none, but under one canonical id) are folded in their order first. status
    is `inserted`, `updated`, `unchanged` (all watched columns are the same, null and empty being one) or `untouched`
    (no new record). Other columns of old stay. Inserted rows get an id from a hash of the canonical id, so that reruns
    agree. Null text, ids and years match nothing; empty tables give what the other side has.
    """
    extra = [c for c in old.columns if c not in RECORD and c not in METADATA and c != "id"]
    stored = [m for m in METADATA if m in old.columns]
    base = complete(old.select("id", *[c for c in old.columns if c in RECORD], *extra, *[F.col(m).alias(f"old_{m}") for m in stored]))
    came = complete(new.select("n", *[c for c in new.columns if c in RECORD])).withColumn("normalized_title", normalize_title(F.col("title")))
    slim = ["doi", "openalex_id", "arxiv_id", "semantic_scholar_id", "normalized_title", "year"]
    found = ra.match_by_priority(came.select(F.col("n").alias("new_id"), *slim), base.select("id", *slim), entity_keys(F.col("normalized_title")))
    came = came.join(found.withColumnRenamed("id", "target").withColumnRenamed("new_id", "n"), "n", "left")
    came = came.withColumn("canonical", canonical_id(F.col("openalex_id"), F.col("doi"), F.col("arxiv_id"), F.col("title"), F.col("year")))
    came = came.withColumn("meet", F.coalesce(F.concat(F.lit("id:"), F.col("target").cast("string")), F.col("canonical")))
    one = ra.fold_merge(came, "meet", "n").select(F.coalesce("target", F.xxhash64("canonical").bitwiseAND(F.lit((1 << 63) - 1))).alias("id"), "target", *RECORD)

    e, p = (lambda c: F.col(f"e.{c}")), (lambda c: F.col(f"p.{c}"))
    length = lambda c: F.length(F.coalesce(c, F.lit("")))
    longer = lambda c: F.when(length(e(c)) >= length(p(c)), F.coalesce(e(c), F.lit(""))).otherwise(p(c))
    number = lambda c: F.coalesce(F.nullif(e(c), F.lit(0).cast(RECORD[c])), F.nullif(p(c), F.lit(0).cast(RECORD[c])))
    both = lambda c: first_truthy(e(c), p(c))
    direction = both("direction")
    values = {
        "openalex_id": canonical_id(first_truthy(p("openalex_id"), e("openalex_id")), p("doi"), p("arxiv_id"), p("title"), p("year")),
        "title": F.when(truthy(e("title")).isNotNull() & (length(e("title")) >= length(p("title"))), e("title")).otherwise(p("title")),
        "abstract": longer("abstract"), "year": number("year"), "published_date": both("published_date"),
        "venue": F.when(truthy(e("venue")).isNotNull() & (e("venue") != "arXiv"), e("venue")).otherwise(p("venue")),
        "citations": F.greatest(F.coalesce(e("citations"), F.lit(0)), F.coalesce(p("citations"), F.lit(0))), "citation_percentile": number("citation_percentile"), "authors": longer("authors"),
        "doi": both("doi"), "pdf_url": both("pdf_url"), "direction": direction,
        "direction_label": F.when(truthy(e("direction_label")).isNotNull() & ~e("direction_label").eqNullSafe(e("direction")), e("direction_label")).otherwise(p("direction_label")),
        "publication_channel": F.coalesce(truthy(e("publication_channel")), F.when(p("venue") == "arXiv", "arXiv 预印本").otherwise("同行评议")),
        "arxiv_id": both("arxiv_id"), "semantic_scholar_id": both("semantic_scholar_id"), "normalized_title": p("normalized_title"),
        "sources": F.array_union(F.coalesce(e("sources"), F.array().cast("array<string>")), F.coalesce(p("sources"), F.array().cast("array<string>"))),
        "source_ids": _right_biased(e("source_ids"), p("source_ids")), "source_urls": _right_biased(e("source_urls"), p("source_urls")),
    }
    hit = p("id").isNotNull()
    j = base.alias("e").join(one.alias("p"), F.col("e.id") == F.col("p.id"), "full_outer")
    j = j.select(
        F.coalesce("e.id", "p.id").alias("id"), *[e(c).alias(c) for c in extra], *[e(f"old_{m}").alias(f"old_{m}") for m in stored], hit.alias("hit"), e("id").isNull().alias("fresh"), p("sources").alias("came_from"),
        *[F.when(hit, v).otherwise(e(c)).cast(RECORD[c]).alias(c) for c, v in values.items()], *[_text(c, e(c)).alias(f"was_{c}") for c in WATCHED if c in RECORD],
    )
    c = F.col
    j = with_metadata(j, as_of, F.when(c("hit"), c("came_from")).otherwise(c("sources")))
    if stored:
        j = j.withColumns({m: F.when(c("hit"), c(m)).otherwise(c(f"old_{m}")) for m in stored})
    same = F.lit(True)
    for w in WATCHED:
        if w in RECORD:
            same = same & (_text(w, c(w)) == c(f"was_{w}"))
        elif w in stored:
            same = same & (_text(w, c(w)) == _text(w, c(f"old_{w}")))
    status = F.when(~c("hit"), "untouched").when(c("fresh"), "inserted").when(same, "unchanged").otherwise("updated")
    needs = c("embedding").isNull() | ~c("embedding_model").eqNullSafe(F.lit(embedding_model)) if {"embedding", "embedding_model"} <= set(extra) else F.lit(True)
    return j.select("id", *extra, *RECORD, *METADATA, status.alias("status"), (c("hit") & needs).alias("needs_embedding"))


def link_directions(links: DataFrame, new: DataFrame) -> DataFrame:
    """Bridge rows (paper_id, direction, direction_label, is_relevant): a new link takes over its label and is relevant again."""
    fresh = new.select("paper_id", "direction", "direction_label", F.lit(True).alias("is_relevant")).dropDuplicates(["paper_id", "direction"])
    return ra.upsert(links, fresh, ["paper_id", "direction"])


def statistics(records: DataFrame, merged: DataFrame) -> DataFrame:
    """One row: records fetched, duplicates by key, and what became of the rest."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    came = records.agg(F.count("*").alias("fetched"), (F.count("*") - F.count_distinct(ra.dedupe_key(records))).alias("duplicates"))
    return came.join(F.broadcast(merged.agg(n("inserted"), n("updated"), n("unchanged"), n("untouched"))))
