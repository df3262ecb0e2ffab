"""Queries that write payload files of whole tables and read them back, and enrich what they find."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.cluster import shared_dir
from paperloom.functions import relevance as rel
from paperloom.functions import text as tx
from paperloom.plans.flows import _TITLED, _docs, _gate_sql, _titled
from paperloom.plans.registry import query
from paperloom.sources import files, payloads, services

SPACE = r"[\s\x0b]+"


def _read_sql(c: str) -> str:
    """What a reader makes of a text that was escaped and written: entities that stood in it are decoded, but for &amp;."""
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''")):
        c = f"replace({c}, '{a}', '{b}')"
    return f"trim(regexp_replace({c}, '{SPACE}', ' ', 'g'))"


def _tag(name: str, value):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        value = F.replace(value, F.lit(a), F.lit(b))
    return F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>\n"))


def _write(df, text, path, by=None):
    """One line or more a row, in the order of ids; with `by` in a folder for each of its values."""
    names = [by] if by else []
    out = df.repartitionByRange(*names, "id").sortWithinPartitions(*names, "id").select(*names, text.alias("value")).write
    (out.partitionBy(by) if by else out).text(path)


def _feeds(spark, sf):
    """Every paper as an entry of one of four feeds, whole text as summary; read back."""
    i, blank = F.col("id").cast("string"), F.lit("")
    pdf = F.when(F.col("id") % 2 == 0, F.concat(F.lit('<link title="pdf" href="http://arxiv.org/pdf/'), i, F.lit('v2"/>\n'))).otherwise("")
    names = [F.concat(F.lit("<author>"), _tag("name", F.coalesce(n, blank)), F.lit("</author>")) for n in (F.col("venue"), F.lit("B & C"))]
    entry = F.concat(
        F.lit("<entry>\n"), _tag("id", F.concat(F.lit("http://arxiv.org/abs/"), i)), _tag("title", F.coalesce("title", blank)), _tag("summary", F.coalesce("abstract", blank)),
        _tag("published", F.concat(F.col("year").cast("string"), F.lit("-01-01T00:00:00Z"))), *names, pdf, F.lit("</entry>"),
    )
    path = f"{shared_dir(spark)}/feeds"
    _write(_titled(_docs(spark, sf)).withColumn("feed", F.concat(F.lit("f"), (F.col("id") % 4).cast("string"))), entry, path, "feed")
    return files.read_feeds(spark, path)


_PDF = "CASE WHEN id % 2 = 0 THEN concat('http://arxiv.org/pdf/', id, 'v2') ELSE concat('https://arxiv.org/pdf/', id) END"
_BACK = f"(SELECT id, concat('f', id % 4) AS feed, {_read_sql('title')} AS title, {_read_sql('''coalesce(abstract, '')''')} AS abstract, year, venue AS source FROM {_TITLED}) AS b"


@query(f"""SELECT feed, CAST(id AS VARCHAR) AS arxiv_id, title, CAST(length(abstract) AS INTEGER) AS abstract_chars, md5(abstract) AS abstract_md5, year, concat(year, '-01-01T00:00:00Z') AS published_date, concat({_read_sql("coalesce(source, '')")}, ', B & C') AS authors, {_PDF} AS pdf_url FROM {_BACK} WHERE title <> ''""")
def feed_records(spark, sf):
    """SRC-3: all papers written as feeds and read by splits."""
    return _feeds(spark, sf).select("feed", "arxiv_id", "title", F.char_length("abstract").alias("abstract_chars"), F.md5("abstract").alias("abstract_md5"), "year", "published_date", "authors", "pdf_url")


@query(f"""WITH b AS (SELECT id, feed, title, abstract, 'arXiv' AS venue FROM {_BACK} WHERE title <> ''), n AS (SELECT *, row_number() OVER (PARTITION BY feed ORDER BY id) AS n FROM b),
k AS (SELECT id, feed, title, row_number() OVER (PARTITION BY feed ORDER BY id) AS k FROM n WHERE n <= 60 AND ({_gate_sql('planning')}))
SELECT feed, CAST(id AS VARCHAR) AS arxiv_id, title FROM k WHERE k <= 30""")
def feed_first_relevant(spark, sf):
    """SRC-3: of the first 60 entries of each feed the first 30 that are relevant."""
    r = _feeds(spark, sf)
    ok = rel.is_likely_relevant(F.col("title"), F.col("abstract"), F.col("venue"), "planning")
    return files.first_relevant(r, "feed", ok).select("feed", "arxiv_id", "title")


@query(r"""SELECT concat('k', id) AS key, trim(t) AS title, year, concat('10.1/', id) AS doi, CAST(length(a) AS INTEGER) AS abstract_chars, md5(a) AS abstract_md5
FROM (SELECT id, year, trim(regexp_replace(regexp_replace(coalesce(title, ''), '[^a-zA-Z ]', '', 'g'), ' +', ' ', 'g')) AS t, trim(regexp_replace(regexp_replace(coalesce(abstract, ''), '[{}\\]', '', 'g'), '[\s\x0b]+$', '')) AS a FROM papers) AS x WHERE t <> ''""")
def bibtex_file_entries(spark, sf):
    """SRC-9, SCL-8, SCL-9: all papers written as BibTeX files, whole texts as abstracts, and read by splits."""
    i = F.col("id").cast("string")
    t = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce("title", F.lit("")), "[^a-zA-Z ]", ""), " +", " "))
    a = F.regexp_replace(F.regexp_replace(F.coalesce("abstract", F.lit("")), r"[{}\\]", ""), r"[\s\x0b]+\z", "")
    entry = F.concat(F.lit("@Article{k"), i, F.lit(",\n title = {"), t, F.lit("},\n DOI = \"10.1/"), i, F.lit("\",\n year = "), F.col("year").cast("string"), F.lit(",\n abstract = {"), a, F.lit("}\n}\n"))
    path = f"{shared_dir(spark)}/bib"
    _write(_docs(spark, sf).where(t != ""), entry, path)
    text = F.coalesce(F.col("fields")["abstract"], F.lit(""))
    return files.read_bibtex_files(spark, path).select("key", "title", "year", "doi", F.char_length(text).alias("abstract_chars"), F.md5(text).alias("abstract_md5"))


@query(r"""WITH t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(text, '')) AS page, coalesce(text, '') AS text FROM conversations)
SELECT conv_id, string_agg(concat(text, chr(10), '![](assets/page-', lpad(CAST(page AS VARCHAR), 3, '0'), '-fig_1.png)'), concat(chr(10), chr(10), '---', chr(10), chr(10)) ORDER BY page) AS markdown, string_agg(concat('assets/page-', lpad(CAST(page AS VARCHAR), 3, '0'), '-fig_1.png'), ',' ORDER BY page) AS assets FROM t GROUP BY conv_id""")
def ocr_documents(spark, sf):
    """SRC-11: each conversation as a document whose turns are the layout results of JSON lines, two images of one name renamed by page."""
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    image = F.lit("![](imgs/fig 1.png)")
    page = F.struct(F.struct(F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), image).alias("text"), F.create_map(F.lit("imgs/fig 1.png"), F.lit("http://x/1")).alias("images")).alias("markdown"))
    lines = c.select(F.col("conv_id").alias("doc"), F.struct("turn", F.coalesce("text", F.lit("")).alias("text")).alias("line"), F.to_json(F.struct(F.struct(F.array(page).alias("layoutParsingResults")).alias("result"))).alias("json"))
    return services.ocr_pages(lines).select(F.col("doc").alias("conv_id"), "markdown", F.array_join("assets", ",").alias("assets"))


@query("""SELECT id, CASE WHEN id % 3 = 0 THEN 'http://own/' || id WHEN id % 4 = 1 THEN NULL WHEN id % 5 = 0 THEN NULL WHEN id % 7 = 0 THEN 'http://landing/' || id ELSE 'http://open/' || id END AS pdf_url FROM papers""")
def open_access_links(spark, sf):
    """SRC-6: a PDF for papers with a DOI and without one; answers without any address leave them as they are."""
    i, s = F.col("id"), F.col("id").cast("string")
    none = F.lit(None).cast("string")
    p = _docs(spark, sf).select("id", F.when(i % 4 == 1, none).otherwise(F.concat(F.lit("https://doi.org/10.1/"), s)).alias("doi"), F.when(i % 3 == 0, F.concat(F.lit("http://own/"), s)).alias("pdf_url"))
    found = _docs(spark, sf).where(i % 5 != 0).select(F.concat(F.lit("10.1/"), s).alias("doi"), F.when(i % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("http://open/"), s)).alias("url_for_pdf"), F.concat(F.lit("http://landing/"), s).alias("url"))
    p = p.withColumn("doi", tx.normalize_doi(F.col("doi")))
    return payloads.enrich_unpaywall(p, found).select("id", "pdf_url")
