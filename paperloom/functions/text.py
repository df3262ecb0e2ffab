"""Scalar functions over text, urls and JSON, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = "一-鿿"


def truthy(c: Column) -> Column:
    """The value, or null where it is empty: '' counts as missing."""
    return F.nullif(c, F.lit(""))


def first_truthy(*cols: Column) -> Column:
    return F.coalesce(*map(truthy, cols))


def normalize_title(c: Column, limit: int | None = 300) -> Column:
    """Lower case with only a-z, 0-9 and CJK left, cut to limit."""
    out = F.regexp_replace(F.lower(c), f"[^a-z0-9{CJK}]+", "")
    return F.substring(out, 1, limit) if limit else out


def normalize_doi(c: Column) -> Column:
    return truthy(F.trim(F.lower(F.regexp_replace(c, "(?i)^https?://(dx\\.)?doi\\.org/", ""))))


def slugify(c: Column, fallback: Column | None = None) -> Column:
    out = F.substring(F.regexp_replace(F.regexp_replace(F.lower(c), f"[^a-z0-9{CJK}]+", "-"), "^-+|-+$", ""), 1, 48)
    return F.coalesce(truthy(out), fallback) if fallback is not None else out


def let(value: Column, body) -> Column:
    """body(value), with the value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def runs(s: Column, key, each) -> Column:
    """each(run) of the runs of equal keys (nulls are equal) of a sorted array."""
    starts = F.filter(F.transform(s, lambda e, i: F.when((i == 0) | ~key(F.get(s, i - 1)).eqNullSafe(key(e)), i)), lambda i: i.isNotNull())
    return let(starts, lambda q: F.transform(q, lambda p, k: each(F.slice(s, p + 1, F.coalesce(F.get(q, k + 1), F.size(s)) - p))))


def inverted_index(words: Column) -> Column:
    """map<word, array<position>> of an array of words, from its words sorted with their positions."""
    pairs = F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("p"))))
    entry = lambda run: F.struct(F.element_at(run, 1)["w"].alias("key"), F.transform(run, lambda e: e["p"]).alias("value"))
    return let(pairs, lambda s: F.map_from_entries(runs(s, lambda e: e["w"], lambda run: let(run, entry))))


def abstract_from_inverted_index(index: Column, limit: int | None = 1200) -> Column:
    """Words of map<word, array<position>> in the order of their positions."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    out = F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ")
    return F.substring(out, 1, limit) if limit else out


def decode_xml(c: Column) -> Column:
    """Five entities, one after the other, and white space collapsed."""
    for a, b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;|&apos;", "'")):
        c = F.regexp_replace(c, a, b)
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def query_terms(query: Column) -> Column:
    return F.filter(F.split(F.lower(query), r"\s+"), lambda t: F.length(t) > 1)


def lexical_score(text: Column, query: Column) -> Column:
    """Share of the query's terms that the text contains; 0 without terms."""
    terms, low = query_terms(query), F.lower(F.coalesce(text, F.lit("")))
    hits = F.size(F.filter(terms, lambda t: F.contains(low, t)))
    return F.when(F.size(terms) > 0, hits / F.size(terms)).otherwise(F.lit(0.0))


def authors_display(authors: Column) -> Column:
    """First four of a comma-separated list, then the total."""
    parts = F.split(authors, r",\s*")
    return F.when(F.size(parts) > 4, F.concat(F.array_join(F.slice(parts, 1, 4), ", "), F.lit(" +"), F.size(parts).cast("string"))).otherwise(authors)


def summary_display(summary: Column, limit: int = 280) -> Column:
    return F.when(F.char_length(summary) > limit, F.concat(F.substring(summary, 1, limit), F.lit("..."))).otherwise(summary)


def arxiv_id(eprint: Column, url: Column) -> Column:
    value = F.coalesce(eprint, F.lit(""))
    both = F.concat(value, F.lit(" "), F.coalesce(url, F.lit("")))
    long = F.regexp_extract(both, r"(?i)(?:arxiv(?:\.org)?/(?:abs|pdf)/|arxiv:)([0-9]{4}\.[0-9]{4,5}(?:v\d+)?)", 1)
    return F.coalesce(truthy(long), truthy(F.regexp_extract(value, r"([0-9]{4}\.[0-9]{4,5}(?:v\d+)?)", 1)))


def content_hash(*cols: Column) -> Column:
    """SHA-256 of the values joined by newlines; null is empty."""
    return F.sha2(F.concat_ws("\n", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]), 256)


#: What each cached result depends on.
HASHED = {
    "classification": ("title", "abstract", "venue", "year"), "summary": ("title", "abstract", "authors", "venue", "year", "doi"), "abstract_translation": ("title", "abstract", "doi"),
    "translation": ("title", "abstract", "authors", "year", "venue", "doi", "pdf_url", "model", "parser", "glossary"),
}


def result_hash(kind: str, get) -> Column:
    """Hash of what a cached result of a kind depends on; get(name) is a column. A translation's is of a JSON object."""
    cols = HASHED[kind]
    if kind == "translation":
        return F.sha2(F.to_json(F.struct(*[get(c).alias(c) for c in cols]), {"ignoreNullFields": "false"}), 256)
    return content_hash(*map(get, cols))


def chunk_hash(source_hash: Column, index: Column, text: Column) -> Column:
    return F.substring(content_hash(source_hash, index, text), 1, 20)


def decode_id(c: Column, passes: int = 4) -> Column:
    """URL-decoded until nothing changes, at most passes times; what cannot be decoded stays."""
    for _ in range(passes):
        c = F.coalesce(F.try_url_decode(c), c)
    return c


def json_array(c: Column, ddl: str = "array<string>") -> Column:
    """Tolerant: what is no such array is an empty one."""
    return F.coalesce(F.from_json(c, ddl), F.array().cast(ddl))


def unfence_json(c: Column) -> Column:
    """JSON out of a model's answer: without a code fence, else from the first to the last brace."""
    bare = F.trim(F.regexp_replace(c, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", ""))
    return F.when(bare.startswith("{"), bare).otherwise(truthy(F.regexp_extract(bare, r"(?s)\{.*\}", 0)))


def embedding_text(title: Column, abstract: Column, authors: Column, venue: Column, limit: int = 6000) -> Column:
    return F.substring(F.concat_ws("\n", *map(truthy, (title, abstract, authors, venue))), 1, limit)


def author_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")


def normalize_author(c: Column) -> Column:
    """Lower case, without a leading `and`, with letters a-z and single spaces only."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(c), r"^and\s+", ""), r"[^a-z\s]", ""), r"\s+", " "))


def author_difference(pdf: Column, db: Column) -> Column:
    """Names on one side only, after normalising."""
    key = lambda names: F.array_distinct(F.filter(F.transform(names, normalize_author), lambda n: n != ""))
    a, b = F.array_except(key(pdf), key(db)), F.array_except(key(db), key(pdf))
    return F.struct(((F.size(a) > 0) | (F.size(b) > 0)).alias("conflicting"), a.alias("pdf_only"), b.alias("db_only"))


def looks_like_pdf(url: Column) -> Column:
    return url.rlike(r"(?i)\.pdf(?:$|[?#])|/pdf/|arxiv\.org/pdf")


def url_candidates(pdf: Column, doi: Column, alternatives: Column, arxiv: Column) -> Column:
    """Distinct candidates, those that look like PDFs first."""
    own = F.array(truthy(pdf), F.when(truthy(doi).isNotNull(), F.concat(F.lit("https://doi.org/"), normalize_doi(doi))))
    every = F.concat(own, F.coalesce(alternatives, F.array().cast("array<string>")), F.array(F.when(truthy(arxiv).isNotNull(), F.concat(F.lit("https://arxiv.org/pdf/"), arxiv, F.lit(".pdf")))))
    every = F.array_distinct(F.filter(every, lambda u: u.isNotNull()))
    return F.concat(F.filter(every, looks_like_pdf), F.filter(every, lambda u: ~looks_like_pdf(u)))


def roman(c: Column) -> Column:
    """Value of a Roman numeral or of digits; null for anything else."""
    up = F.upper(F.trim(c))
    value = F.create_map(*[F.lit(x) for kv in (("I", 1), ("V", 5), ("X", 10), ("L", 50), ("C", 100), ("D", 500), ("M", 1000)) for x in kv])
    step = lambda acc, ch: F.struct((acc["t"] + value[ch] - F.when(acc["p"] < value[ch], 2 * acc["p"]).otherwise(0)).alias("t"), value[ch].alias("p"))
    total = F.aggregate(F.split(up, ""), F.struct(F.lit(0).alias("t"), F.lit(0).alias("p")), step, lambda acc: acc["t"])
    return F.when(up.rlike("^[IVXLCDM]+$"), total).when(up.rlike("^[0-9]+$"), up.try_cast("int"))


def pdf_links(html: Column) -> Column:
    """Addresses of a landing page that look like PDFs: citation_pdf_url first, then anchors; distinct, `&amp;` decoded."""
    meta = F.regexp_extract_all(html, F.lit(r"(?i)<meta[^>]*name=[\"']citation_pdf_url[\"'][^>]*content=[\"']([^\"']+)[\"']"), F.lit(1))
    anchors = F.filter(F.regexp_extract_all(html, F.lit(r"(?i)<a\b[^>]*href=[\"']([^\"']+)[\"']"), F.lit(1)), lambda u: u.rlike(r"(?i)\.pdf|/pdf/|download"))
    return F.array_distinct(F.transform(F.concat(meta, anchors), lambda u: F.regexp_replace(u, "&amp;", "&")))


def safe_asset_name(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"^.*[/\\]", ""), r"[^A-Za-z0-9._-]+", "_")


#: Content types by extension.
CONTENT_TYPES = (("png", "image/png"), ("jpg", "image/jpeg"), ("jpeg", "image/jpeg"), ("gif", "image/gif"), ("webp", "image/webp"), ("svg", "image/svg+xml"))


def content_type(name: Column) -> Column:
    out = F.lit("application/octet-stream")
    for ext, kind in CONTENT_TYPES:
        out = F.when(F.lower(name).endswith(f".{ext}"), F.lit(kind)).otherwise(out)
    return out


def served_assets(markdown: Column, base: Column) -> Column:
    """Asset references of a document as addresses under base."""
    return F.regexp_replace(markdown, r"(!\[[^\]]*\]\()assets/([^)\s]+)(\))", F.concat(F.lit("$1"), base, F.lit("$2$3")))


def multiset_except(a: Column, b: Column) -> Column:
    """What is left of a when each element of b takes away one equal element, first ones first; null if either is.

    Both are sorted together, so that work grows as sorting does: of a run of equal elements with n from b, which come
    first, n of a's go too."""
    one = lambda x, side, i: F.struct(x.alias("x"), F.lit(side).alias("side"), i.alias("i"))
    both = F.sort_array(F.concat(F.transform(b, lambda x: one(x, 0, F.lit(0))), F.transform(a, lambda x, i: one(x, 1, i))))
    taken = lambda run: F.size(F.filter(run, lambda e: e["side"] == 0))
    left = lambda run: let(taken(run), lambda n: F.filter(run, lambda e, j: (e["side"] == 1) & (j >= 2 * n)))
    kept = let(both, lambda s: F.flatten(runs(s, lambda e: e["x"], lambda run: let(run, left))))
    return F.transform(F.sort_array(F.transform(kept, lambda e: F.struct(e["i"].alias("i"), e["x"].alias("x")))), lambda e: e["x"])


def passes_terms(title: Column, body: Column, query: Column, stop_words: tuple[str, ...] = ()) -> Column:
    """Terms of three characters or more count 5 in the title and 1 in the body; under two terms everything passes."""
    terms = F.filter(F.split(F.lower(F.coalesce(query, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: (F.length(t) >= 3) & ~F.array_contains(F.array(*map(F.lit, stop_words)).cast("array<string>"), t))
    hits = lambda c: F.size(F.filter(terms, lambda t: F.contains(F.lower(F.coalesce(c, F.lit(""))), t)))
    return (F.size(terms) < 2) | (5 * hits(title) + hits(body) >= F.greatest(F.lit(2), F.ceil(F.size(terms) / 2)))


def tokens_once(text: Column, tokens: Column) -> Column:
    """Whether each token is in the text exactly once."""
    return F.forall(tokens, lambda t: F.length(text) - F.length(F.replace(text, t, F.lit(""))) == F.length(t))


def dollar_counts(text: Column) -> Column:
    """How many unescaped dollars and pairs of dollars a text has."""
    n = lambda p: F.coalesce(F.regexp_count(text, F.lit(p)), F.lit(0))
    return F.struct(n(r"(?<!\\)\$").alias("dollars"), n(r"(?<!\\)\$\$").alias("displays"))
