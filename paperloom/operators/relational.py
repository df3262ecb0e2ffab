"""Relational operators of the engine: keyed merges, entity matching, top-N, fold-merge and greedy selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import scoring as sc
from paperloom.functions.text import first_truthy, normalize_doi, normalize_title, truthy


# ---------------------------------------------------------------- filters and order
def visible(df: DataFrame, column: str = "is_relevant") -> DataFrame:
    """Null or true."""
    return df.where(F.coalesce(F.col(column), F.lit(True)))


def search_filter(df: DataFrame, columns: Sequence[str], query: str) -> DataFrame:
    """Any column contains the query, case-insensitively; % and _ are wildcards, as in LIKE."""
    cond = F.lit(False)
    for c in columns:
        cond = cond | F.coalesce(F.col(c).ilike(f"%{query}%"), F.lit(False))
    return df.where(cond)


def since(df: DataFrame, start: Column, date: str = "published_date", year: str = "year") -> DataFrame:
    """On or after start; without a date, in or after its year."""
    return df.where((F.col(date) >= start) | (F.col(date).isNull() & (F.col(year) >= F.year(start))))


def page(df: DataFrame, order: Sequence[Column], size: int, number: int = 1) -> DataFrame:
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def top_n(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """First n rows per key with their rank from 0 (WindowGroupLimit cuts before the shuffle)."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).where(F.col(rank) < n)


def soft_filter(df: DataFrame, matches: Column) -> DataFrame:
    """Only matching rows, but all of them if nothing matches."""
    found = df.where(matches).limit(1).select(F.lit(True).alias("_found"))
    return df.join(F.broadcast(found), how="left").where(F.col("_found").isNull() | matches).drop("_found")


def fresh_or_all(df: DataFrame, by: Sequence[str], shown: str, n: int) -> DataFrame:
    """Per key only rows not shown lately if there are n of them, else all."""
    fresh = df.groupBy(*by).agg(F.sum(F.when(F.col(shown), 0).otherwise(1)).alias("_fresh"))
    return df.join(fresh, list(by)).where((F.col("_fresh") < n) | ~F.col(shown)).drop("_fresh")


def apply_rules(df: DataFrame, rules: DataFrame, text: Column, direction: str = "direction") -> DataFrame:
    """Drops rows that contain an exclude term or lack a require term of `all` or their direction. The rules of `all` are one row."""
    per = rules.groupBy("direction").agg(F.collect_set(F.when(F.col("mode") == "exclude", F.lower("term"))).alias("no"), F.collect_set(F.when(F.col("mode") == "require", F.lower("term"))).alias("yes"))
    every, own = per.where("direction = 'all'").select(F.col("no").alias("no_a"), F.col("yes").alias("yes_a")), per.select(F.col("direction").alias("_d"), F.col("no").alias("no_d"), F.col("yes").alias("yes_d"))
    none = F.array().cast("array<string>")
    j = df.withColumn("_t", F.lower(text)).join(own, F.col(direction) == F.col("_d"), "left").join(F.broadcast(every), how="left")
    no, yes = (F.concat(F.coalesce(f"{x}_a", none), F.coalesce(f"{x}_d", none)) for x in ("no", "yes"))
    ok = ~F.exists(no, lambda t: F.contains(F.col("_t"), t)) & F.forall(yes, lambda t: F.contains(F.col("_t"), t))
    return j.where(ok).select(*df.columns)


def few(df: DataFrame, most: int = 10_000) -> list:
    """All rows of a table that must be small; an error if it isn't."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows of {df.columns}")
    return rows


# ---------------------------------------------------------------- keyed writes
def upsert(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """New rows replace old ones of their key."""
    return old.join(new.select(*key), list(key), "left_anti").unionByName(new, allowMissingColumns=True)


def insert_missing(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """New rows only for keys that are not there."""
    return old.unionByName(new.dropDuplicates(list(key)).join(old.select(*key), list(key), "left_anti"), allowMissingColumns=True)


def compare_and_set(old: DataFrame, new: DataFrame, key: Sequence[str], may: Column) -> tuple[DataFrame, DataFrame]:
    """Upserts where may holds for the old row (or there is none); also returns the keys that were set."""
    blocked = old.where(~may).select(*key)
    took = new.join(blocked, list(key), "left_anti")
    return upsert(old, took, key), took.select(*key)


def latest(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_n(df, key, order, 1, "_r").drop("_r")


# ---------------------------------------------------------------- entities
def dedupe_key(df: DataFrame) -> Column:
    """First of DOI, arXiv id, S2 id, OpenAlex id, normalised title with year."""
    return F.coalesce(
        F.concat(F.lit("doi:"), normalize_doi(F.col("doi"))), F.concat(F.lit("arxiv:"), truthy(F.col("arxiv_id"))), F.concat(F.lit("s2:"), truthy(F.col("semantic_scholar_id"))),
        F.concat(F.lit("openalex:"), truthy(F.col("openalex_id"))), F.concat(F.lit("title:"), normalize_title(F.col("title")), F.lit(":"), F.coalesce(F.col("year").cast("string"), F.lit("unknown"))),
    )


def match_by_priority(new: DataFrame, old: DataFrame, keys: Sequence[tuple[str, Column]], new_id: str = "new_id", old_id: str = "id") -> DataFrame:
    """(new_id, id) of the old row that the first matching key finds; smallest id if a key finds several.

    Keys are unpivoted on both sides and equi-joined once, so an OR of conditions never becomes a nested loop; old rows
    are reduced to one per key before, so that a frequent key isn't expanded into pairs.
    """
    kinds = lambda df, i: df.select(i, F.explode(F.array(*[F.struct(F.lit(k).alias("p"), c.cast("string").alias("v")) for k, (_, c) in enumerate(keys)])).alias("k")).select(i, "k.p", "k.v").where("v is not null and v <> ''")
    a, b = kinds(new.withColumnRenamed(new_id, "_new"), "_new"), kinds(old.withColumnRenamed(old_id, "_old"), "_old")
    b = b.groupBy("p", "v").agg(F.min("_old").alias("_old")).where("_old is not null")
    best = a.join(b, ["p", "v"]).groupBy("_new").agg(F.min(F.struct("p", "_old")).alias("m"))
    return best.select(F.col("_new").alias(new_id), F.col("m._old").alias(old_id))


def match_counts(df: DataFrame, key: str, year: str, id_: str = "id") -> DataFrame:
    """(id, matches) per row: rows of equal key (a null one matches nothing) and year (null-safe), or the row itself.

    Ids must be unique. Rows of one key and year are counted once, not paired."""
    groups = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k"), F.col(year).alias("_y")).agg(F.count("*").alias("_n"))
    j = df.join(groups, (F.col(key) == F.col("_k")) & F.col(year).eqNullSafe(F.col("_y")), "left")
    return j.select(id_, F.coalesce("_n", F.lit(1)).alias("matches"))


def copy_classes(df: DataFrame, text: str, id_: str = "id") -> DataFrame:
    """(id, copy_group, first_id, copies) per row: digest of the text, smallest id and number of rows of equal texts.

    A null text is a copy of nothing. Groups are counted and joined, never expanded into pairs."""
    p = df.select(id_, F.sha2(text, 256).alias("copy_group"))
    groups = p.where("copy_group is not null").groupBy("copy_group").agg(F.min(id_).alias("first_id"), F.count("*").alias("copies"))
    return p.join(groups.hint("merge"), "copy_group", "left").select(id_, "copy_group", F.coalesce("first_id", id_).alias("first_id"), F.coalesce("copies", F.lit(1)).alias("copies"))


def fold_merge(records: DataFrame, key: str, order: str) -> DataFrame:
    """Records of one key folded in encounter order: the last one's fields, the longest abstract (first of equals), the
    highest citations, sources in order of first sight, right-biased maps."""
    plain = [c for c in records.columns if c not in (key, order, "abstract", "citations", "sources", "source_ids", "source_urls")]
    aggs = [F.max_by(c, order).alias(c) for c in plain]
    if "abstract" in records.columns:
        aggs.append(F.max_by("abstract", F.struct(F.coalesce(F.length("abstract"), F.lit(0)), -F.col(order))).alias("abstract"))
    if "citations" in records.columns:
        aggs.append(F.max("citations").alias("citations"))
    if "sources" in records.columns:  # each source with its first place, found before the rows of a key meet
        first = records.select(key, F.col(order).alias("_o"), F.posexplode("sources").alias("_p", "_s")).groupBy(key, "_s").agg(F.min(F.struct("_o", "_p")).alias("_at"))
        seen = first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_s"))), lambda x: x["_s"]).alias("sources"))
    out = records.groupBy(key).agg(*aggs) if aggs else records.select(key).distinct()
    if "sources" in records.columns:
        out = out.join(seen, key, "left").withColumn("sources", F.coalesce("sources", F.array().cast(records.schema["sources"].dataType)))
    for c in ("source_ids", "source_urls"):
        if c in records.columns:
            out = out.join(fold_maps(records, key, order, c), key, "left").withColumn(c, F.coalesce(c, F.create_map().cast(records.schema[c].dataType)))
    return out


def fold_maps(records: DataFrame, key: str, order: str, column: str) -> DataFrame:
    """(key, column): one map of each key's maps, each entry with its last value; entries in the order of first sight.

    Entries are rows that are reduced by (key, entry), on the map side first, before those of a key meet: what meets are
    the distinct entries of a key, however many records it has."""
    entries = records.where(F.col(column).isNotNull()).select(key, F.col(order).alias("_o"), F.posexplode(F.map_entries(column)).alias("_p", "_e"))
    last = entries.groupBy(key, F.col("_e.key").alias("_name")).agg(F.max_by(F.col("_e.value"), F.struct("_o", "_p")).alias("_v"), F.min(F.struct("_o", "_p")).alias("_at"))
    whole = last.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_at", "_name", "_v"))).alias("_all"))
    return whole.select(key, F.map_from_arrays(F.transform("_all", lambda x: x["_name"]), F.transform("_all", lambda x: x["_v"])).alias(column))


def merge_papers(old: DataFrame, new: DataFrame, on: str = "id") -> DataFrame:
    """Field-by-field merge of matched records (left: all old rows and new rows without a match)."""
    e, p = old.alias("e"), new.alias("p")
    a, b = (lambda c: F.col(f"e.{c}")), (lambda c: F.col(f"p.{c}"))
    number = lambda c: F.coalesce(F.nullif(a(c), F.lit(0)), F.nullif(b(c), F.lit(0)))
    longer = lambda c: F.when((F.length(F.coalesce(a(c), F.lit(""))) >= F.length(F.coalesce(b(c), F.lit("")))) & (F.coalesce(a(c), F.lit("")) != ""), a(c)).otherwise(b(c))
    j = e.join(p, on, "full_outer")
    rules = {
        "title": longer("title"), "abstract": longer("abstract"), "year": number("year"), "doi": first_truthy(a("doi"), b("doi")),
        "venue": F.when((F.coalesce(a("venue"), F.lit("")) != "") & (a("venue") != "arXiv"), a("venue")).otherwise(F.coalesce(b("venue"), a("venue"))),
        "citations": F.greatest(a("citations"), b("citations")), "normalized_title": F.coalesce(normalize_title(b("title")), normalize_title(a("title"))),
    }
    if "sources" in old.columns:
        none = F.array().cast("array<string>")
        rules["sources"] = F.array_union(F.coalesce(a("sources"), none), F.coalesce(b("sources"), none))
    same = lambda c: F.coalesce(a(c).cast("string"), F.lit("")) == F.coalesce(r.cast("string"), F.lit(""))
    changed = F.lit(False)
    for c, r in rules.items():
        if c in old.columns and c != "sources":
            changed = changed | ~same(c)
    status = F.when(a("title").isNull(), "inserted").when(b("title").isNull(), "untouched").when(changed, "updated").otherwise("unchanged")
    return j.select(on, *[r.alias(c) for c, r in rules.items()], status.alias("status"))


# ---------------------------------------------------------------- greedy selection across groups
def greedy_select(candidates: DataFrame, directions: Sequence[str], n: int, order: Sequence[Column], item: str = "paper_id", group: str = "direction") -> DataFrame:
    """Per direction, in the given order, the best n items that no earlier direction took.

    Of a direction only its first n * directions rows can matter; that bounded set goes to the driver, is walked there,
    and the choice is returned as (direction, item, rank).
    """
    spark = candidates.sparkSession
    few = top_n(candidates.where(F.col(group).isin(list(directions))), [group], order, n * max(1, len(directions)), "_r")
    rows = sorted(((r[group], r["_r"], r[item]) for r in few.select(group, "_r", item).collect()), key=lambda r: (directions.index(r[0]), r[1]))
    taken, out, count = set(), [], {}
    for d, _, i in rows:
        if i not in taken and count.get(d, 0) < n:
            out.append((d, i, count.get(d, 0)))
            taken.add(i)
            count[d] = count.get(d, 0) + 1
    return spark.createDataFrame(out, f"{group} string, {item} long, rank int")


def expand_neighbours(chosen: DataFrame, edges: DataFrame, disabled: DataFrame | None = None) -> DataFrame:
    """Directions one hop from the chosen ones, without those and disabled ones, in order of first sight.

    chosen(direction, position), edges(direction, neighbour, position)."""
    e = edges.select("direction", "neighbour", F.col("position").alias("edge_position"))
    out = chosen.join(e, "direction").groupBy("neighbour").agg(F.min(F.struct("position", "edge_position")).alias("at"))
    out = out.join(chosen.select(F.col("direction").alias("neighbour")), "neighbour", "left_anti")
    if disabled is not None:
        out = out.join(disabled.select(F.col("direction").alias("neighbour")), "neighbour", "left_anti")
    return out.select(F.col("neighbour").alias("direction"), F.struct("at.position", "at.edge_position").alias("at"))


def contiguous(df: DataFrame, by: Sequence[str], number: str) -> DataFrame:
    """Per group whether its numbers are exactly 1 to n, without gaps or repeats."""
    n = F.col(number)
    return df.groupBy(*by).agg(((F.count(n) == F.count_distinct(n)) & (F.min(n) == 1) & (F.max(n) == F.count("*"))).alias("contiguous"))


def adjacent_groups(df: DataFrame, by: Sequence[str], start: Column, end: Column, order: Sequence[Column], gap: float) -> DataFrame:
    """Numbers the runs of neighbours that lie at most gap apart (column island, from 0)."""
    w = Window.partitionBy(*by).orderBy(*order)
    opens = F.coalesce((start - F.lag(end).over(w) > gap).cast("int"), F.lit(0))
    return df.withColumn("_opens", opens).withColumn("island", F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_opens")


def first_positions(orderings: Sequence[DataFrame], key: str, position: str = "position") -> DataFrame:
    """The keys of several ranked lists (key, position), each at its place in the first list that has it."""
    every = None
    for k, one in enumerate(orderings):
        part = one.select(key, F.struct(F.lit(k).alias("list"), F.col(position).alias("place")).alias("at"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy(key).agg(F.min("at").alias("at"))


def sync_statistics(records: DataFrame, key: str, merged: DataFrame) -> DataFrame:
    """One row: records fetched, duplicates by key, and what the merge did with the rest."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    came = records.agg(F.count("*").alias("fetched"), (F.count("*") - F.count_distinct(key)).alias("duplicates"))
    return came.join(F.broadcast(merged.agg(n("inserted"), n("updated"), n("untouched"))))


# ---------------------------------------------------------------- lists and related papers
def related(papers: DataFrame, links: DataFrame, hidden: DataFrame, vectors: DataFrame, paper_id: int, candidates: int = 300, limit: int = 8) -> DataFrame:
    """(id, score): visible papers that share a direction with the paper, the first `candidates` by id, scored by .8
    vector and .2 words of the target's whole text. vectors(id, embedding), hidden(id)."""
    from paperloom.functions import scoring as sc
    from paperloom.functions import text as tx

    whole = F.concat_ws(" ", truthy(F.col("title")), truthy(F.col("abstract")), truthy(F.col("venue")))
    mine = links.where(F.col("paper_id") == paper_id).select("direction").distinct()
    near = links.join(mine, "direction", "left_semi").select(F.col("paper_id").alias("id")).distinct()
    few = visible(papers).select("id").where(F.col("id") != paper_id).join(near, "id", "left_semi").join(hidden, "id", "left_anti").orderBy("id").limit(candidates)
    target = papers.where(F.col("id") == paper_id).select("id", whole.alias("query")).join(vectors.where(F.col("id") == paper_id), "id", "left").select("query", F.col("embedding").alias("q")).limit(1)
    j = papers.select("id", whole.alias("whole")).join(F.broadcast(few), "id").join(vectors, "id", "left").join(F.broadcast(target))
    semantic = F.greatest(F.coalesce(sc.cosine(F.col("embedding"), F.col("q")), F.lit(0.0)), F.lit(0.0))
    return j.select("id", F.round(0.8 * semantic + 0.2 * tx.lexical_score(F.col("whole"), F.col("query")), 6).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def legacy_recommend(papers: DataFrame, links: DataFrame, weights: DataFrame, n: int = 10, this_year: int = 2026) -> DataFrame:
    """(id, score) of the n best papers(id, citations, year, rank) by the summed weights(direction, weight) of their
    links; the most cited ones, scored by their citations, where no direction has a weight.

    Weights are one row a direction. They are summed per paper before papers are joined."""
    per = links.join(weights, "direction").groupBy(F.col("paper_id").alias("id")).agg(F.sum("weight").alias("_w"))
    any_ = weights.agg((F.count("*") > 0).alias("_any"))
    j = papers.select("id", "citations", "year", "rank").join(per, "id", "left").join(F.broadcast(any_))
    cited = F.coalesce("citations", F.lit(0)).cast("double")
    score = F.when(F.col("_any"), sc.legacy_score(F.col("_w"), F.col("citations"), F.col("rank"), F.col("year"), this_year)).otherwise(cited)
    return j.where(~F.col("_any") | F.col("_w").isNotNull()).select("id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "id").limit(n)


def legacy_list(papers: DataFrame, links: DataFrame, direction: str | None, query: str | None, size: int, number: int, sort: str = "citations", columns: Sequence[str] = ("title", "abstract", "authors")) -> DataFrame:
    """A page of papers with total and has_more; sort is citations, year or relevance (which is citations)."""
    p = search_filter(papers, columns, query) if query else papers
    if direction and direction != "all":
        p = p.join(links.where(F.col("direction") == direction).select(F.col("paper_id").alias("id")), "id", "left_semi")
    by = [F.desc_nulls_last("year"), F.desc_nulls_last("citations")] if sort == "year" else [F.desc_nulls_last("citations")]
    total = p.agg(F.count("*").alias("total"))
    return page(p, [*by, F.col("id")], size, number).join(F.broadcast(total)).withColumn("has_more", F.col("total") > size * number)


# ---------------------------------------------------------------- order within a key, of any size
def borders(df: DataFrame, by: str, order: list[Column], pieces: int = 64, each: int = 16) -> Column:
    """Where to cut the order (by, order) into pieces of about equal size: an array of structs, from `each` random rows
    a piece. Where they lie decides about balance only."""
    keys = [F.col(by).alias("_k"), *[o.alias(f"_o{i}") for i, o in enumerate(order)]]
    some = df.select(*keys).orderBy(F.rand(1)).limit(pieces * each).orderBy(*[F.col(c) for c in ["_k", *[f"_o{i}" for i in range(len(order))]]])
    types, rows = some.schema.fields, some.collect()[each::each]
    return F.array(*[F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for f, v in zip(types, r)]) for r in rows])


def piece_of(by: str, order: list[Column], cuts: Column, pieces: int = 64) -> Column:
    """The piece of a row: how many of the cuts are at or before it, by halving. It hangs on the row's values alone, so
    two readings of a table agree, which the partitions of two range exchanges do not: each samples anew."""
    row = F.struct(F.col(by).alias("_k"), *[o.alias(f"_o{i}") for i, o in enumerate(order)])
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(pieces.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get(cuts, at + step - 1) <= row, step).otherwise(0))


def number_rows(df: DataFrame, by: str, order: list[Column], name: str, pieces: int = 64) -> DataFrame:
    """df with the number from 0 of each row among those of its `by`, in a total order of rows.

    A key with many rows is not sorted in one task: rows are ranged by (key, order) over pieces, numbered within their
    piece, and the rows of the key in earlier pieces (one count for each key and piece) are added."""
    cols = [f"_o{i}" for i in range(len(order))]
    placed = df.withColumns(dict(zip(cols, order))).withColumn("_part", piece_of(by, order, borders(df, by, order, pieces), pieces))
    own = placed.withColumn("_in", F.row_number().over(Window.partitionBy("_part", by).orderBy(*cols)) - 1)
    counts = placed.groupBy(by, "_part").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy(by).orderBy("_part")) - F.col("_n")).select(F.col(by).alias("_k"), F.col("_part").alias("_q"), "_before")
    j = own.join(before, F.col(by).eqNullSafe(F.col("_k")) & (F.col("_part") == F.col("_q")))
    return j.withColumn(name, F.col("_before") + F.col("_in")).drop("_part", "_in", "_before", "_k", "_q", *cols)


def last_before(df: DataFrame, by: str, order: list[Column], values: Sequence[str], pieces: int = 64, cuts: Column | None = None) -> DataFrame:
    """df with each of the values replaced by the last one that is not null at or before the row, among rows of its `by`.

    Rows are ranged over pieces like in number_rows; what is carried into a piece is one row for each key. cuts: borders
    of the same order that are known already."""
    cols = [f"_o{i}" for i in range(len(order))]
    cuts = borders(df, by, order, pieces) if cuts is None else cuts
    placed = df.withColumns(dict(zip(cols, order))).withColumn("_part", piece_of(by, order, cuts, pieces))
    here = Window.partitionBy("_part", by).orderBy(*cols).rowsBetween(Window.unboundedPreceding, 0)
    own = placed.withColumns({f"_v_{v}": F.last(v, ignorenulls=True).over(here) for v in values})
    ends = placed.groupBy(by, "_part").agg(*[F.max_by(v, F.when(F.col(v).isNotNull(), F.struct(*cols))).alias(f"_e_{v}") for v in values])
    earlier = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(F.col(by).alias("_k"), F.col("_part").alias("_q"), *[F.last(f"_e_{v}", ignorenulls=True).over(earlier).alias(f"_c_{v}") for v in values])
    j = own.join(ends, F.col(by).eqNullSafe(F.col("_k")) & (F.col("_part") == F.col("_q")))
    return j.withColumns({v: F.coalesce(f"_v_{v}", f"_c_{v}") for v in values}).drop("_part", "_k", "_q", *cols, *[f"_{x}_{v}" for v in values for x in "vc"])
