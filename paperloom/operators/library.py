"""Flows that write: directions, classifications, saved and imported papers, seeds, back-fills, deletes, workers' deltas.

Each takes tables and returns their new versions; nothing is changed in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions import relevance as rel
from paperloom.functions.text import normalize_doi, normalize_title, slugify, truthy
from paperloom.operators import relational as ra
from paperloom.operators.records import canonical_id
from paperloom.sources.curated import DIRECTIONS, is_classic

POSITIVE = (1 << 63) - 1
#: The collection that saved papers are filed under, unless another is given.
COLLECTION = "收藏"


# ---------------------------------------------------------------- keys and directions
def free_numbers(taken: DataFrame, by: str = "_slug", number: str = "n") -> DataFrame:
    """(by, first, shift): from the first-th free number (from 0) on, the free numbers are first + shift and so on.

    The k-th free number is k + 1 + (taken numbers below it). Of the taken ones, sorted, the i-th leaves used[i] - 1 - i
    free numbers below itself, so ranks of new rows fall between these counts: a range of ranks for each run of taken
    numbers, and no list of numbers for each row."""
    used = ra.number_rows(taken.select(by, number).where(F.col(number) >= 1).distinct(), by, [F.col(number)], "_i")
    runs = used.groupBy(by, (F.col(number) - 1 - F.col("_i")).alias("first")).agg((F.max("_i") + 2).alias("shift"))
    return runs


def allocate_keys(new: DataFrame, taken: DataFrame, label: str = "label", key: str = "key") -> DataFrame:
    """new with a key of its own per row: the label's slug, then slug-2, slug-3 and so on, leaving out taken keys.

    Rows of one slug are numbered in the order of their labels (then of `n`, if there is such a column); a slug may have
    any number of rows. Labels without a letter or digit get a slug from their hash.
    """
    slug = slugify(F.col(label), F.concat(F.lit("custom-"), F.hex(F.xxhash64(label))))
    order = [F.col(label), *([F.col("n")] if "n" in new.columns else [])]
    ranked = ra.number_rows(new.withColumn("_slug", slug), "_slug", order, "_r")
    suffix = F.regexp_extract(key, r"^(.*?)(?:-(\d{1,6}))?$", 2)
    names = taken.select(F.explode(F.array(F.struct(F.col(key).alias("s"), F.lit(1).alias("n")), F.struct(F.regexp_replace(key, r"-\d{1,6}$", "").alias("s"), suffix.try_cast("int").alias("n")))).alias("t"))
    runs = free_numbers(names.select(F.col("t.s").alias("_slug"), "t.n").where("n is not null"))
    # a rank belongs to the last run that begins at or below it: runs and ranks meet in one order, and each rank sees the run before it
    marks = runs.select("_slug", F.col("first").alias("_r"), "shift", F.lit(0).alias("_kind")).unionByName(ranked.select("_slug", "_r").withColumns({"shift": F.lit(None).cast("long"), "_kind": F.lit(1)}))
    shifts = ra.last_before(marks, "_slug", [F.col("_r"), F.col("_kind")], ["shift"]).where("_kind = 1").select(F.col("_slug").alias("_s"), F.col("_r").alias("_q"), "shift")
    j = ranked.join(shifts, (F.col("_slug") == F.col("_s")) & (F.col("_r") == F.col("_q")))
    n = F.col("_r") + F.coalesce("shift", F.lit(1))
    return j.withColumn(key, F.when(n == 1, F.col("_slug")).otherwise(F.concat_ws("-", "_slug", n.cast("string")))).drop("_slug", "_r", "_s", "_q", "shift")


def create_direction(custom: DataFrame, label: str, query: str, color: str = "#0ea5e9") -> tuple[DataFrame, str]:
    """custom(key, label, query, color) with a new direction, and its key.

    Labels need two characters, queries three; a label or key that exists raises an error."""
    label, query = (label or "").strip(), (query or "").strip()
    if len(label) < 2 or len(query) < 3:
        raise ValueError("a direction needs a label of two characters and a query of three")
    if label in DIRECTIONS or label in {x for x, _ in DIRECTIONS.values()} or custom.where(F.col("label") == label).limit(1).count():
        raise ValueError(f"direction {label!r} exists")
    new = custom.sparkSession.createDataFrame([(label, query, color)], "label string, query string, color string")
    new = allocate_keys(new, custom).select("key", "label", "query", "color")
    return custom.unionByName(new, allowMissingColumns=True), new.first()["key"]


def suggest_directions(custom: DataFrame, links: DataFrame, suggestions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """custom and links after suggestions(paper_id, label, query): one that has the label or the query of a custom
    direction links to it, others become one direction per label."""
    by = lambda c: custom.select(F.col(c).alias("_v"), F.col("key").alias(f"_{c}"), F.col("label").alias(f"_{c}_label")).groupBy("_v").agg(F.min(F.struct(f"_{c}", f"_{c}_label")).alias(f"_by_{c}"))
    j = suggestions.join(by("label"), suggestions["label"] == F.col("_v"), "left").drop("_v").join(by("query"), suggestions["query"] == F.col("_v"), "left").drop("_v")
    known = F.coalesce("_by_label._label", "_by_query._query")
    j = j.select("paper_id", "label", "query", known.alias("key"), F.coalesce("_by_label._label_label", "_by_query._query_label").alias("known_label"))
    fresh = j.where("key is null").groupBy("label").agg(F.min("query").alias("query")).withColumn("color", F.lit("#0ea5e9"))
    fresh = allocate_keys(fresh, custom).select("key", "label", "query", "color")
    made = j.where("key is null").select("paper_id", "label").join(fresh.select("label", "key"), "label").select("paper_id", F.col("key").alias("direction"), F.col("label").alias("direction_label"))
    old = j.where("key is not null").select("paper_id", F.col("key").alias("direction"), F.col("known_label").alias("direction_label"))
    return custom.unionByName(fresh, allowMissingColumns=True), _link(links, made.unionByName(old))


def _link(links: DataFrame, new: DataFrame) -> DataFrame:
    return ra.insert_missing(links, new.select("paper_id", "direction", "direction_label", F.lit(True).alias("is_relevant")), ["paper_id", "direction"])


def apply_classification(papers: DataFrame, links: DataFrame, answers: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """answers(paper_id, primary_direction, secondary_directions): links for all directions named, and the primary one
    for papers that have none. labels(direction, label); a paper without a primary answer is left alone."""
    a = answers.where(truthy(F.col("primary_direction")).isNotNull())
    keys = a.select("paper_id", F.explode(F.array_distinct(F.concat(F.array("primary_direction"), F.coalesce("secondary_directions", F.array().cast("array<string>"))))).alias("direction")).where("direction is not null")
    named = keys.join(labels, "direction", "left").select("paper_id", "direction", F.coalesce("label", "direction").alias("direction_label"))
    first = a.join(labels, a["primary_direction"] == labels["direction"]).select(F.col("paper_id").alias("id"), F.col("primary_direction").alias("_d"), F.col("label").alias("_l")).dropDuplicates(["id"])
    p = papers.join(first, "id", "left")
    empty = truthy(F.col("direction")).isNull() & F.col("_d").isNotNull()
    p = p.withColumns({"direction_label": F.when(empty, F.col("_l")).otherwise(F.col("direction_label")), "direction": F.when(empty, F.col("_d")).otherwise(F.col("direction"))})
    return p.select(*papers.columns), _link(links, named)


# ---------------------------------------------------------------- saving and importing
def save_papers(papers: DataFrame, library: DataFrame, events: DataFrame, bodies: DataFrame, now: Column, collection: str = COLLECTION) -> dict[str, DataFrame]:
    """papers, library, events and outcome after bodies(id, doi, title, year, venue, authors, abstract, pdf_url, source)
    were saved: found by canonical id or DOI, else inserted; one library row a paper, one save event a body.

    Bodies without a title raise nothing and are left out. Ids come from hashes, so that reruns agree."""
    b = bodies.where(truthy(F.trim("title")).isNotNull())
    own = F.coalesce(truthy(F.col("id")), truthy(F.col("doi")), F.concat(F.lit("saved:"), F.regexp_replace(F.lower(F.trim("title")), "[^a-z0-9一-鿿]+", "-")))
    b = b.withColumns({"canonical": own, "source": F.coalesce(truthy(F.col("source")), F.lit("OpenAlex"))})
    b = b.withColumn("n", F.xxhash64("canonical", F.coalesce("doi", F.lit(""))))
    keys = [("id", F.col("canonical")), ("doi", truthy(F.col("doi")))]
    found = ra.match_by_priority(b.select(F.col("n").alias("new_id"), "canonical", "doi"), papers.select("id", F.col("openalex_id").alias("canonical"), "doi"), keys)
    b = b.join(found.select(F.col("new_id").alias("n"), F.col("id").alias("known")), "n", "left")
    b = b.withColumn("paper_id", F.coalesce("known", F.xxhash64("canonical").bitwiseAND(F.lit(POSITIVE))))
    fresh = b.where("known is null").dropDuplicates(["paper_id"])
    new = fresh.select(
        F.col("paper_id").alias("id"), F.col("canonical").alias("openalex_id"), F.trim("title").alias("title"), F.coalesce("abstract", F.lit("")).alias("abstract"), F.nullif("year", F.lit(0)).alias("year"), F.coalesce("venue", F.lit("")).alias("venue"),
        F.coalesce("authors", F.lit("")).alias("authors"), truthy(F.col("doi")).alias("doi"), truthy(F.col("pdf_url")).alias("pdf_url"), normalize_title(F.col("title"), None).alias("normalized_title"), F.array("source").alias("sources"),
    )
    items = b.select("paper_id", "source", F.col("canonical").alias("external_key"), F.lit(collection).alias("collection")).dropDuplicates(["paper_id"])
    return {
        "papers": papers.unionByName(new, allowMissingColumns=True), "library": ra.upsert(library, items, ["paper_id"]), "events": append_events(events, b.select("paper_id", F.lit("save").alias("event")), now),
        "outcome": b.select("paper_id", F.col("canonical").alias("id"), F.col("known").isNotNull().alias("already_existed")),
    }


def append_events(events: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Events with ids hashed from paper, event, time and, where one call repeats an event of a paper, its number there:
    no table is read to number them, and a rerun gives the same ids."""
    nth = F.row_number().over(Window.partitionBy("paper_id", "event").orderBy(F.lit(0)))
    stamped = new.select("paper_id", "event", now.cast("timestamp").alias("created_at"), nth.alias("_n"))
    stamped = stamped.select(F.xxhash64("paper_id", "event", "created_at", "_n").bitwiseAND(F.lit(POSITIVE)).alias("id"), "paper_id", "event", "created_at")
    return events.select("id", "paper_id", "event", "created_at").unionByName(stamped)


def import_entries(papers: DataFrame, library: DataFrame, links: DataFrame, events: DataFrame, entries: DataFrame, now: Column, collection: str = "Zotero 导入") -> dict[str, DataFrame]:
    """papers, library, links, events and a row of counters after entries(key, title, year, doi, arxiv_id, abstract,
    venue, authors, pdf_url) came in.

    An entry is found by DOI, arXiv id or normalised title with year (null-safe); entries that are new but equal to each
    other become one paper. Every built-in direction that a paper is likely relevant to is linked."""
    e = entries.where(truthy(F.trim("title")).isNotNull()).withColumn("n", F.xxhash64("key", "title"))
    title = F.concat_ws(":", truthy(normalize_title(F.col("title"), None)), F.coalesce(F.col("year").cast("string"), F.lit("-")))
    keys = [("doi", normalize_doi(F.col("doi"))), ("arxiv", truthy(F.col("arxiv_id"))), ("title", F.when(truthy(normalize_title(F.col("title"), None)).isNotNull(), title))]
    found = ra.match_by_priority(e.select(F.col("n").alias("new_id"), "doi", "arxiv_id", "title", "year"), papers.select("id", "doi", "arxiv_id", "title", "year"), keys)
    own = F.coalesce(F.concat(F.lit("arxiv:"), truthy(F.col("arxiv_id"))), F.concat(F.lit("doi:"), truthy(F.col("doi"))), F.concat(F.lit("bibtex:"), F.col("key")))
    e = e.join(found.select(F.col("new_id").alias("n"), F.col("id").alias("known")), "n", "left").withColumn("canonical", own)
    e = e.withColumn("paper_id", F.coalesce("known", F.xxhash64("canonical").bitwiseAND(F.lit(POSITIVE))))
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    new = e.where("known is null").dropDuplicates(["paper_id"]).select(
        F.col("paper_id").alias("id"), F.col("canonical").alias("openalex_id"), "title", text("abstract"), "year", text("venue"), text("authors"), truthy(F.col("doi")).alias("doi"), truthy(F.col("arxiv_id")).alias("arxiv_id"),
        F.coalesce(truthy(F.col("pdf_url")), F.concat(F.lit("https://arxiv.org/pdf/"), truthy(F.col("arxiv_id")), F.lit(".pdf"))).alias("pdf_url"), normalize_title(F.col("title"), None).alias("normalized_title"), F.array(F.lit("BibTeX")).alias("sources"),
    )
    after = papers.unionByName(new, allowMissingColumns=True)
    touched = after.select("id", "title", "abstract", "venue").join(e.select(F.col("paper_id").alias("id")).distinct(), "id", "left_semi")
    fits = [F.when(rel.is_likely_relevant(F.col("title"), F.col("abstract"), F.col("venue"), k, label, label), F.struct(F.lit(k).alias("direction"), F.lit(label).alias("direction_label"))) for k, (label, _) in DIRECTIONS.items()]
    linked = touched.select(F.col("id").alias("paper_id"), F.explode(F.filter(F.array(*fits), lambda x: x.isNotNull())).alias("d")).select("paper_id", "d.direction", "d.direction_label")
    items = e.select("paper_id", F.lit("Zotero/BibTeX").alias("source"), F.col("key").alias("external_key"), F.lit(collection).alias("collection")).dropDuplicates(["paper_id"])
    counts = e.agg(F.count("*").alias("entries"), F.count_if(F.col("known").isNotNull()).alias("duplicates"), F.count_distinct(F.when(F.col("known").isNull(), F.col("paper_id"))).alias("inserted"))
    return {
        "papers": after, "library": ra.upsert(library, items, ["paper_id"]), "links": _link(links, linked), "events": append_events(events, e.select("paper_id", F.lit("library_import").alias("event")), now),
        "counters": counts.join(F.broadcast(linked.agg(F.count("*").alias("linked")))),
    }


# ---------------------------------------------------------------- seeds, back-fills, deletes, relevance
def seed(table: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows if the table is empty, else the table: a seed that runs twice changes nothing."""
    return table if table.limit(1).count() else table.unionByName(rows, allowMissingColumns=True)


def backfill(papers: DataFrame) -> DataFrame:
    """Missing normalised titles, canonical ids and sources of older rows; what is there stays."""
    have = set(papers.columns)
    rules = {"normalized_title": normalize_title(F.col("title"))}
    if "sources" in have:
        rules["sources"] = F.when(F.size("sources") > 0, F.col("sources")).otherwise(F.array(F.lit("OpenAlex")))
    if {"openalex_id", "doi", "arxiv_id"} <= have:
        rules["openalex_id"] = canonical_id(F.col("openalex_id"), F.col("doi"), F.col("arxiv_id"), F.col("title"), F.col("year"))
    if "normalized_title" in have:
        rules["normalized_title"] = F.coalesce(truthy(F.col("normalized_title")), rules["normalized_title"])
    return papers.withColumns(rules)


def relabel(links: DataFrame, labels: DataFrame) -> DataFrame:
    """Links whose label is still their key get the direction's label; a custom label wins over a built-in one."""
    j = links.join(labels.select("direction", F.col("label").alias("_l")).dropDuplicates(["direction"]), "direction", "left")
    return j.withColumn("direction_label", F.when((F.col("direction_label") == F.col("direction")) & F.col("_l").isNotNull(), F.col("_l")).otherwise(F.col("direction_label"))).select(*links.columns)


def override_labels(built_in: DataFrame, custom: DataFrame) -> DataFrame:
    """(direction, label): custom labels over built-in ones of the same key, all keys of both."""
    b, c = built_in.select("direction", F.col("label").alias("_b")), custom.select(F.col("key").alias("direction"), F.col("label").alias("_c"))
    return b.join(c, "direction", "full_outer").select("direction", F.coalesce(truthy(F.col("_c")), "_b").alias("label"))


def delete_rows(table: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    return table.join(gone.select(*key).distinct(), key, "left_anti")


def clean_relevance(papers: DataFrame, links: DataFrame, directions: list[tuple[str, str, str]]) -> tuple[DataFrame, DataFrame]:
    """papers and links with is_relevant judged anew: a link by its direction's gate (key, label, query), a paper by any
    of its links; classics are always relevant. Rows stay, only flags change; links of unknown directions keep theirs."""
    text = [F.col(c) for c in ("title", "abstract", "venue")]
    terms = rel.vocabulary(directions)
    judged = F.create_map(*[x for k, label, query in directions for x in (F.lit(k), rel.is_likely_relevant(*text, k, label, query, terms))])
    p = papers.select(F.col("id").alias("paper_id"), is_classic(F.col("title")).alias("_classic"), judged.alias("_ok"))
    j = links.join(p, "paper_id", "left").withColumn("is_relevant", F.coalesce(F.col("_classic"), F.lit(False)) | F.coalesce(F.col("_ok")[F.col("direction")], F.col("is_relevant"), F.lit(True)))
    any_ = j.groupBy(F.col("paper_id").alias("id")).agg(F.max(F.col("is_relevant").cast("int")).alias("_any"))
    out = papers.join(any_, "id", "left").withColumn("is_relevant", is_classic(F.col("title")) | F.coalesce(F.col("_any") == 1, F.col("is_relevant")))
    return out.select(*papers.columns), j.select(*links.columns)


# ---------------------------------------------------------------- workers
def pending(papers: DataFrame, result: str, model_column: str, model: str, digest_column: str | None = None, digest: Column | None = None) -> DataFrame:
    """Rows that a worker has to look at: no result yet, another model, or (if given) another content hash."""
    todo = F.col(result).isNull() | ~F.col(model_column).eqNullSafe(F.lit(model))
    if digest is not None:
        todo = todo | ~F.col(digest_column).eqNullSafe(digest)
    return papers.where(todo)


def apply_delta(papers: DataFrame, delta: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """papers with the columns of delta(key, ...) put in where a row of it exists, and a row with the number of rows that
    changed. One row a key in delta; null values of delta change nothing."""
    cols = [c for c in delta.columns if c != key]
    j = papers.join(delta.select(key, *[F.col(c).alias(f"_new_{c}") for c in cols]), key, "left")
    value = {c: F.coalesce(F.col(f"_new_{c}"), F.col(c)) if c in papers.columns else F.col(f"_new_{c}") for c in cols}
    changed = F.lit(False)
    for c in cols:
        changed = changed | (F.col(f"_new_{c}").isNotNull() & ~F.col(f"_new_{c}").eqNullSafe(F.col(c) if c in papers.columns else F.lit(None)))
    out = j.select(*[(value[c].alias(c) if c in value else F.col(c)) for c in papers.columns], *[value[c].alias(c) for c in cols if c not in papers.columns])
    return out, j.agg(F.count_if(changed).alias("changed"))


def cached_translations(papers: DataFrame, cache: DataFrame, digest: Column, model: str) -> tuple[DataFrame, DataFrame]:
    """Cached abstract translations (id, digest, translation) of that model and content, and the papers without one."""
    p = papers.withColumn("digest", digest)
    hit = p.select("id", "digest").join(cache.where(F.col("model") == model).select("id", "digest", "translation"), ["id", "digest"])
    return hit, p.join(hit.select("id"), "id", "left_anti")


def known_directions(spark: SparkSession, custom: DataFrame) -> DataFrame:
    """Keys of built-in and custom directions, for membership tests."""
    return spark.createDataFrame([(k,) for k in DIRECTIONS], "direction string").union(custom.select("key")).distinct()
