"""Bibliographic payloads to canonical records (openalex_id, title, abstract, year, published_date, venue, citations,
citation_percentile, authors, doi, pdf_url, arxiv_id, semantic_scholar_id, sources)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import abstract_from_inverted_index, decode_xml, first_truthy, normalize_doi, truthy

OPENALEX = (
    "id string, title string, authorships array<struct<author:struct<display_name:string>>>, publication_year int, publication_date string, "
    "primary_location struct<source:struct<display_name:string>>, cited_by_count long, cited_by_percentile_year struct<min:double,max:double>, "
    "abstract_inverted_index map<string,array<int>>, doi string, locations array<struct<pdf_url:string>>"
)
SEMANTIC_SCHOLAR = (
    "paperId string, title string, abstract string, year int, venue string, citationCount long, publicationDate string, authors array<struct<name:string>>, "
    "externalIds struct<DOI:string,ArXiv:string>, openAccessPdf struct<url:string>"
)
CROSSREF = "message struct<DOI:string,title:array<string>,published:struct<`date-parts`:array<array<int>>>,`container-title`:array<string>>"
KEPT = 30


def _names(authors: Column, get) -> Column:
    return F.array_join(F.filter(F.transform(authors, get), lambda n: n.isNotNull()), ", ")


def pdf_choice(urls: Column) -> Column:
    """The first that contains arxiv, else the first."""
    have = F.filter(urls, lambda u: u.isNotNull())
    return F.coalesce(F.get(F.filter(have, lambda u: F.contains(u, F.lit("arxiv"))), 0), F.get(have, 0))


def openalex(works: DataFrame) -> DataFrame:
    c = F.col
    p = c("cited_by_percentile_year")
    return works.where(truthy(c("title")).isNotNull()).select(
        c("id").alias("openalex_id"), "title", abstract_from_inverted_index(c("abstract_inverted_index")).alias("abstract"), c("publication_year").alias("year"), c("publication_date").alias("published_date"),
        c("primary_location.source.display_name").alias("venue"), F.coalesce("cited_by_count", F.lit(0)).alias("citations"), F.coalesce(p["max"], p["min"]).alias("citation_percentile"),
        _names(c("authorships"), lambda a: a["author"]["display_name"]).alias("authors"), normalize_doi(c("doi")).alias("doi"), pdf_choice(F.transform("locations", lambda x: x["pdf_url"])).alias("pdf_url"),
        F.lit(None).cast("string").alias("arxiv_id"), F.lit(None).cast("string").alias("semantic_scholar_id"), F.array(F.lit("OpenAlex")).alias("sources"),
    )


def arxiv(feeds: DataFrame, column: str = "xml", keep: Sequence[str] = ()) -> DataFrame:
    """Entries of Atom feeds (any number of whole entries in one column), with the columns to keep."""
    e = feeds.select(*keep, F.explode(F.regexp_extract_all(column, F.lit(r"(?s)<entry>(.*?)</entry>"), F.lit(1))).alias("e"))
    tag = lambda n: decode_xml(F.regexp_extract("e", rf"(?s)<{n}[^>]*>(.*?)</{n}>", 1))
    pid = F.regexp_extract(tag("id"), r"/abs/(.+)$", 1)
    pdf = truthy(F.regexp_extract("e", r'<link[^>]*title="pdf"[^>]*href="([^"]+)"', 1))
    authors = F.array_join(F.transform(F.regexp_extract_all("e", F.lit(r"(?s)<name>(.*?)</name>"), F.lit(1)), decode_xml), ", ")
    none = F.lit(None).cast("string")
    return e.select(
        none.alias("openalex_id"), tag("title").alias("title"), tag("summary").alias("abstract"), F.substring(tag("published"), 1, 4).try_cast("int").alias("year"), truthy(tag("published")).alias("published_date"), F.lit("arXiv").alias("venue"),
        F.lit(0).cast("long").alias("citations"), F.lit(None).cast("double").alias("citation_percentile"), authors.alias("authors"), none.alias("doi"),
        F.coalesce(pdf, F.concat(F.lit("https://arxiv.org/pdf/"), pid)).alias("pdf_url"), truthy(pid).alias("arxiv_id"), none.alias("semantic_scholar_id"), F.array(F.lit("arXiv")).alias("sources"), *keep,
    ).where(truthy(F.col("title")).isNotNull())


def semantic_scholar(papers: DataFrame) -> DataFrame:
    c = F.col
    return papers.where(truthy(c("title")).isNotNull()).select(
        F.lit(None).cast("string").alias("openalex_id"), "title", "abstract", "year", F.coalesce(truthy(c("publicationDate")), F.concat(c("year").cast("string"), F.lit("-01-01"))).alias("published_date"), truthy(c("venue")).alias("venue"),
        F.coalesce("citationCount", F.lit(0)).alias("citations"), F.lit(None).cast("double").alias("citation_percentile"), _names(c("authors"), lambda a: a["name"]).alias("authors"), normalize_doi(c("externalIds.DOI")).alias("doi"),
        c("openAccessPdf.url").alias("pdf_url"), truthy(c("externalIds.ArXiv")).alias("arxiv_id"), c("paperId").alias("semantic_scholar_id"), F.array(F.lit("Semantic Scholar")).alias("sources"),
    )


def enrich_crossref(records: DataFrame, messages: DataFrame) -> DataFrame:
    """Fills missing title, year, date and venue by DOI and adds the source."""
    parts = F.get(F.col("message.published.date-parts"), 0)
    date = F.array_join(F.transform(parts, lambda x, i: F.when(i == 0, x.cast("string")).otherwise(F.lpad(x.cast("string"), 2, "0"))), "-")
    m = messages.select(normalize_doi(F.col("message.DOI")).alias("doi"), F.get("message.title", 0).alias("_t"), F.get(parts, 0).alias("_y"), date.alias("_d"), F.get(F.col("message.container-title"), 0).alias("_v")).dropDuplicates(["doi"])
    j = records.join(m, "doi", "left")
    fill = {"title": first_truthy(F.col("title"), F.col("_t")), "year": F.coalesce(F.nullif("year", F.lit(0)), "_y"), "published_date": first_truthy(F.col("published_date"), F.col("_d")), "venue": first_truthy(F.col("venue"), F.col("_v"))}
    fill["sources"] = F.when(F.col("_t").isNotNull(), F.array_union("sources", F.array(F.lit("Crossref")))).otherwise(F.col("sources"))
    return j.select(*[fill.get(c, F.col(c)).alias(c) for c in records.columns])


def enrich_unpaywall(records: DataFrame, found: DataFrame) -> DataFrame:
    """found(doi, url_for_pdf, url): a PDF only where there is a DOI and no PDF yet."""
    m = found.select(normalize_doi(F.col("doi")).alias("doi"), F.coalesce(truthy(F.col("url_for_pdf")), truthy(F.col("url"))).alias("_u")).dropDuplicates(["doi"])
    return records.join(m, "doi", "left").withColumn("pdf_url", first_truthy(F.col("pdf_url"), F.col("_u"))).select(*records.columns)


def keep_newest(records: DataFrame, by: str = "direction", n: int = KEPT) -> DataFrame:
    """At most n records per direction, newest first."""
    w = Window.partitionBy(by).orderBy(F.desc_nulls_last("published_date"), "title")
    return records.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")
