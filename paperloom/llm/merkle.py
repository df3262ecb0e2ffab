"""Document fingerprints: a Merkle tree over paragraphs and sections.

The node of a paragraph (line) is its digest; a section ends after each paragraph whose digest falls in an eighth of
all digests, so that sections find each other again after an edit; its node is the digest of its paragraphs' digests,
and the root is the digest of the sections'. Roots therefore test equality, and the sections that differ locate an edit.

The leaves are the pieces of the paragraphs. Everywhere in the text alike, a piece ends at a line break or where two
neighbouring bytes of the UTF-8 text fall in two fixed classes (at 8 bytes at least, 128 at most), so that an edit
changes the pieces around it and no others, wherever it lies. A leaf's mark holds 40 bits of its hash and its length in
bytes; the second and later leaves of one content have marks of their own. Likeness is the length of the leaves that
two texts share over the length of all their leaves; it is 1 too for texts of the same leaves in another order. The
fingerprint string is `root|section,section,...|mark.mark...` in lowercase hex; digests are whole in the tree, so that
equal roots mean equal texts to 256 bits, and the sections' are written to 64 bits.

Null texts are empty; empty texts have a fingerprint like any other (one empty paragraph), and two of them are alike.
The next document is taken in descending order of doc_id (null last; rows with one doc_id by the hash of their
texts); after the last comes the first, and a lone document is its own next. Tables may be empty; extra columns are
not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.llm.common import at_most, partitions_for, table_bytes

NODE, LENGTH = 16, 8
#: Where a piece may end: after a byte of 5 modulo 8 and one of 0 modulo 8, wherever in the text that is.
_FIRST, _SECOND = ("".join(rf"\x{b:02x}" for b in range(256) if b % 8 == r) for r in (5, 0))
#: A piece that ends so, at the end of its line, or at the largest length; together they are the whole text.
PIECE = rf"[^\n]{{8,128}}?(?<=[{_FIRST}][{_SECOND}])|[^\n]{{0,127}}\n|[^\n]{{1,128}}"
#: Between the digest of a paragraph that ends a section and the next one.
SECTION_END = r"(?<=[01][0-9a-f]{63}),"


def _let(value: Column, body) -> Column:
    """body(value), with the value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _mark(hashed: Column, length: Column) -> Column:
    return F.shiftleft(F.shiftrightunsigned(hashed, 64 - 40), LENGTH).bitwiseOR(length)


def _length(mark: Column) -> Column:
    return mark.bitwiseAND(F.lit((1 << LENGTH) - 1).cast("long"))


def _numbered(s: Column) -> Column:
    """Sorted marks with each later one of a run of equals replaced by one of its number in the run."""
    starts = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (F.get(s, i - 1) != x), i)), lambda i: i.isNotNull())
    again = lambda x, j: F.when(j == 0, x).otherwise(_mark(F.xxhash64(x, j), _length(x)))
    run = lambda q, p, k: F.transform(F.sequence(F.lit(0), F.coalesce(F.get(q, k + 1), F.size(s)) - p - 1), lambda j: again(F.get(s, p), j))
    return _let(starts, lambda q: F.flatten(F.transform(q, lambda p, k: run(q, p, k))))


def marks(text: Column) -> Column:
    """The marks of all leaves of a text."""
    pieces = F.regexp_extract_all(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), F.lit(PIECE), F.lit(0))
    each = F.sort_array(F.transform(pieces, lambda x: _mark(F.xxhash64(x), F.length(x).cast("long"))))
    return _let(each, lambda s: F.when(F.size(F.array_distinct(s)) == F.size(s), s).otherwise(_numbered(s)))


def sections(text: Column) -> Column:
    """Digests of the sections."""
    leaves = F.transform(F.split(text, "\n", -1), lambda p: F.sha2(p, 256))
    return F.transform(F.split(F.concat_ws(",", leaves), SECTION_END, -1), lambda s: F.sha2(s, 256))


def root(sections_: Column) -> Column:
    return F.sha2(F.concat_ws(",", sections_), 256)


def fingerprint(root_: Column, sections_: Column, marks_: Column) -> Column:
    short = F.transform(sections_, lambda s: F.substring(s, 1, NODE))
    return F.concat_ws("|", root_, F.concat_ws(",", short), F.concat_ws(".", F.transform(marks_, lambda m: F.lower(F.hex(m)))))


def likeness(root_a: Column, marks_a: Column, root_b: Column, marks_b: Column) -> Column:
    """1 for equal roots, else the length of the shared leaves over that of all leaves of both."""
    total = lambda ms: F.aggregate(ms, F.lit(0).cast("long"), lambda n, m: n + _length(m))
    share = _let(total(F.array_intersect(marks_a, marks_b)), lambda both: both / (total(marks_a) + total(marks_b) - both))
    return F.when(root_a == root_b, F.lit(1.0)).otherwise(share)


def likeness_of(a: Column, b: Column) -> Column:
    """Likeness of two fingerprint strings."""
    part = lambda x, k: F.element_at(F.split(x, r"\|", -1), k)
    ms = lambda x: F.transform(F.filter(F.split(part(x, 3), r"\.", -1), lambda v: v != ""), lambda v: F.conv(v, 16, 10).cast("long"))
    return likeness(part(a, 1), ms(a), part(b, 1), ms(b))


def differing_sections(a: Column, b: Column) -> Column:
    """Numbers (from 0) of the sections of a that b doesn't have: where a was edited. Empty if the roots are equal."""
    own = F.split(F.element_at(F.split(a, r"\|", -1), 2), ",", -1)
    other = F.split(F.element_at(F.split(b, r"\|", -1), 2), ",", -1)
    same = F.element_at(F.split(a, r"\|", -1), 1) == F.element_at(F.split(b, r"\|", -1), 1)
    return F.when(same, F.array().cast("array<int>")).otherwise(F.filter(F.transform(own, lambda s, i: F.when(~F.array_contains(other, s), i)), lambda i: i.isNotNull()))


def _described(df: DataFrame) -> DataFrame:
    df = df.withColumn("own", marks(F.col("text"))).withColumn("sections", sections(F.col("text")))
    return df.withColumn("root", root(F.col("sections")))


def compare_with_next(spark: SparkSession, docs: DataFrame, parts: int | None = None) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) per row of docs.

    The neighbour comes from a window inside each of many ranges of doc_id, and for the last row of a range from the
    first row of the next range that has rows: no window spans the table, and only range bounds come to the driver.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = parts or min(1 << 16, partitions_for(spark, table_bytes(docs)))
    probs = [k / parts for k in range(1, parts)]
    bounds = sorted(set(docs.agg(F.percentile_approx("doc_id", probs, 20_000).alias("q")).first()["q"] or [])) if probs else []
    docs = docs.withColumn("bucket", at_most(bounds, F.col("doc_id"), "bigint"))
    tie = F.xxhash64("text")
    place = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))), F.col("doc_id").isNotNull(), tie)
    heads = docs.groupBy("bucket").agg(F.max_by("text", place).alias("text"))
    full = sorted((r["bucket"] for r in docs.select("bucket").distinct().collect()), reverse=True)
    if not full:
        full = [0]
    before = dict(zip(full[1:] + full[:1], full))  # the range whose last row is followed by this one's first
    follows = [before.get(b, -1) for b in range(max(full) + 1)]
    heads = _described(heads.withColumn("bucket", F.get(F.array(*map(F.lit, follows)), F.col("bucket"))))
    pack = lambda p: F.struct("text", "own", "root").alias(p)
    heads = heads.select("bucket", pack("head"))
    w = Window.partitionBy("bucket").orderBy(F.desc_nulls_last("doc_id"), F.desc("h"))
    rows = _described(docs).withColumn("h", tie)
    for c in ("text", "own", "root"):  # one by one: a struct of them would be shuffled beside them
        rows = rows.withColumn(f"next_{c}", F.lead(c).over(w))
    rows = rows.join(heads.hint("shuffle_hash"), "bucket", "left")
    rows = rows.withColumn("next", F.when(F.col("next_text").isNull(), F.col("head")).otherwise(F.struct(F.col("next_text").alias("text"), F.col("next_own").alias("own"), F.col("next_root").alias("root"))))
    n = F.char_length("text")
    rows = rows.withColumn("n_chars", n).withColumn("k", F.floor(n / 3).cast("int"))
    cut = F.least(F.col("k"), F.char_length(F.col("next.text")))
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars") - F.col("k")), F.substring(F.col("next.text"), F.lit(1), cut))
    rows = rows.withColumn("edited", F.when(F.col("k") > 0, edited).otherwise(F.col("text")))
    rows = rows.withColumn("e_own", marks(F.col("edited"))).withColumn("e_sections", sections(F.col("edited")))
    rows = rows.withColumn("e_root", root(F.col("e_sections")))
    return rows.select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("root"), F.col("sections"), F.col("own")).alias("fingerprint"), fingerprint(F.col("e_root"), F.col("e_sections"), F.col("e_own")).alias("edited_fingerprint"),
        likeness(F.col("root"), F.col("own"), F.col("e_root"), F.col("e_own")).alias("near_edited"),
        likeness(F.col("root"), F.col("own"), F.col("next.root"), F.col("next.own")).alias("near_next"),
    )
