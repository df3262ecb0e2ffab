"""One-to-one matching and neighbours of a graph as rounds of joins and windows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.operators import relational as ra

LINKED = 8


# ---------------------------------------------------------------- nearest unused
def _orders() -> tuple[list[Column], list[Column]]:
    """Ahead and back."""
    return [F.col("at"), F.col("kind"), -F.col("id")], [-F.col("at"), -F.col("kind"), -F.col("id")]


def _sides(rows: DataFrame, by: str, ahead: Column, back: Column) -> DataFrame:
    """rows(by, at, id, kind) with the nearest row of the other kind before and after; of equally near ones the smallest
    id. At equal places rows of kind 0 come first. ahead, back: borders of the two orders."""
    of = lambda name, kind: F.when(F.col("kind") == kind, F.struct("at", "id")).alias(name)
    one = ra.last_before(rows.select("*", of("b0", 0), of("b1", 1)), by, _orders()[0], ["b0", "b1"], cuts=ahead)
    both = ra.last_before(one.select("*", of("a0", 0), of("a1", 1)), by, _orders()[1], ["a0", "a1"], cuts=back)
    own = F.col("kind") == 0
    return both.select(by, "at", "id", "kind", F.when(own, F.col("b1")).otherwise(F.col("b0")).alias("before"), F.when(own, F.col("a1")).otherwise(F.col("a0")).alias("after"))


def nearest_unused(left: DataFrame, right: DataFrame, by: str, most: int, backwards: bool = False, keep=None) -> DataFrame:
    """(by, left_id, right_id, distance): rows of left(by, at, id) matched with rows of right, each used once, nearest
    pairs first (equal distances: the smaller left id, then right id), no pair further apart than most. Rows without a
    key or a place match nothing.

    This is the matching that taking the closest free pair again and again gives. A round finds each row's nearest row
    of the other side by two passes in order (ranged, so a key may have any number of rows) and takes the pairs that are
    nearest to each other both ways; they leave, and so do rows with nothing near enough, as what is near only leaves.
    Rounds go on until none is found. The closest pair of all is taken in each round, in practice most pairs are.
    backwards: only rows of right at or before the left one. keep(df, round): writes a round's rows and reads them again,
    which cuts the lineage."""
    keep = keep or (lambda df, k: df.checkpoint())
    side = lambda df, kind: df.where(F.col(by).isNotNull() & F.col("at").isNotNull()).select(by, F.col("at").cast("long").alias("at"), F.col("id").cast("long").alias("id"), F.lit(kind).alias("kind"))
    rows = keep(side(left, 1).unionByName(side(right, 0)), "start")
    ahead, back = (ra.borders(rows, by, order) for order in _orders())
    pair = lambda side: F.when(F.col(side).isNotNull(), F.struct(F.abs(F.col("at") - F.col(f"{side}.at")).alias("d"), F.when(F.col("kind") == 1, F.col("id")).otherwise(F.col(f"{side}.id")).alias("l"), F.when(F.col("kind") == 1, F.col(f"{side}.id")).otherwise(F.col("id")).alias("r")))
    if backwards:  # a left row looks back, a right row ahead
        best = F.when(F.col("kind") == 1, pair("before")).otherwise(pair("after"))
    else:
        best = F.least(pair("before"), pair("after"))
    wishes = Window.partitionBy(by, "wish")  # a wish names both rows, so it is that of one row or two
    both = (F.count("*").over(wishes) == 2) & (F.count_if(F.col("kind") == 1).over(wishes) == 1)
    out, k = None, 0
    while True:
        wish = _sides(rows, by, ahead, back).withColumn("wish", best).where(F.col("wish.d") <= most)
        judged = keep(wish.select(by, "at", "id", "kind", "wish", both.alias("taken")), f"round{k}")
        taken = judged.where("taken AND kind = 1").select(by, F.col("wish.l").alias("left_id"), F.col("wish.r").alias("right_id"), F.col("wish.d").alias("distance"))
        if taken.isEmpty():
            return out if out is not None else taken
        out = taken if out is None else out.unionByName(taken)
        rows, k = judged.where("NOT taken").select(by, "at", "id", "kind"), k + 1


# ---------------------------------------------------------------- the graph of links
def link_edges(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(source, target, position): the pages that a page's links lead to (resolved against its own address), each once, at
    the place of its first link. A page that links to itself has no edge of it."""
    known = pages.select(F.col(key).alias("target"), F.regexp_replace(url, "#.*$", "").alias("_u")).groupBy("_u").agg(F.min("target").alias("target"))
    found = pages.select(F.col(key).alias("source"), F.col(url).alias("_base"), F.posexplode(F.regexp_extract_all(html, F.lit(r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']([^"'#]+)"""), F.lit(1))).alias("position", "_href"))
    resolved = found.withColumn("_u", resolve(F.col("_base"), F.col("_href")))
    return resolved.join(known, "_u").where("source <> target").groupBy("source", "target").agg(F.min("position").alias("position"))


def resolve(base: Column, href: Column) -> Column:
    """A link's address: whole ones, those of the scheme, the host, the query or the folder of the base."""
    scheme, host, path = (F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#]*)([^?#]*)", i) for i in (1, 2, 3))
    root = F.concat(scheme, F.lit("://"), host)
    folder = F.concat(root, F.when(path == "", F.lit("/")).otherwise(F.regexp_extract(path, r"^(.*/)", 1)))
    link = F.trim(F.regexp_replace(href, "&amp;", "&"))
    return (
        F.when(link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), link).when(F.startswith(link, F.lit("//")), F.concat(scheme, F.lit(":"), link)).when(F.startswith(link, F.lit("/")), F.concat(root, link))
        .when(F.startswith(link, F.lit("?")), F.concat(root, path, link)).otherwise(F.concat(folder, link))
    )


def neighbours(edges: DataFrame, n: int = LINKED) -> DataFrame:
    """(id, relation, other, rank) of edges(source, target, position): of every node its first n references by position
    and its first n citing nodes by id. A hub's rows are cut to n within each task, and only those meet; rows hold no
    more than the two ids and the position while they are sorted."""
    cut = lambda df, by, *order: df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= n)
    shown = lambda df, by, relation, other: df.select(F.col(by).alias("id"), F.lit(relation).alias("relation"), F.col(other).alias("other"), F.col("rank").cast("int").alias("rank"))
    out = shown(cut(edges.select("source", "target", "position"), "source", "position", "target"), "source", "reference", "target")
    return out.unionByName(shown(cut(edges.select("source", "target"), "target", "source"), "target", "cited_by", "source"))


def fold_edges(links: DataFrame, pieces: int = 32) -> DataFrame:
    """(source, target, position) with the first position of each pair, dealt by source, so that the references of a node
    are ranked where they are. A part of the input as it is read goes to that many tasks, however little room rows take
    when written: memory of a task hangs on the part, not on the input."""
    dealt = links.select("source", "target", "position").repartition(pieces * links.rdd.getNumPartitions(), "source")
    return dealt.groupBy("source", "target").agg(F.min("position").alias("position"))


# ---------------------------------------------------------------- a table function
def bibtex_function():
    """parse_bibtex(TABLE(...)) as a Python table function: of each row's `bibtex` text its entries with a title."""
    from pyspark.sql.functions import udtf
    from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult
    from pyspark.sql.types import IntegerType, StringType, StructType

    entry = re.compile(r"@([A-Za-z]+)\s*\{\s*([^,\s]+)\s*,(.*?)\n\s*\}", re.S)
    pair = re.compile(r"([A-Za-z][A-Za-z0-9_-]*)\s*=\s*(?:\{((?:[^{}]|\{[^{}]*\})*)\}|\"((?:[^\"\\]|\\.)*)\"|([^,\n]+))")

    class ParseBibtex:
        @staticmethod
        def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
            """The given columns but for the text, then those of an entry."""
            if not rows.isTable or "bibtex" not in rows.dataType.names:
                raise ValueError("parse_bibtex takes a table with a column bibtex")
            schema = StructType([f for f in rows.dataType.fields if f.name != "bibtex"])
            return AnalyzeResult(schema.add("entry_type", StringType()).add("entry_key", StringType()).add("title", StringType()).add("year", IntegerType()))

        def eval(self, row):
            given = [row[c] for c in row.asDict() if c != "bibtex"]
            for kind, key, body in entry.findall(row["bibtex"] or ""):
                fields = {name.lower(): (a or b or c).strip() for name, a, b, c in pair.findall(body)}
                if fields.get("title"):
                    year = re.match(r"\d{4}", fields.get("year") or fields.get("date") or "")
                    yield (*given, kind.lower(), key, fields["title"], int(year[0]) if year else None)

    return udtf(ParseBibtex)
