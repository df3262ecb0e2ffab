"""BibTeX reader as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import arxiv_id, let, truthy

#: Fixed value: what counts as an entry.
#: Possessive, as FIELD: whole lines are passed at once, up to the first that begins with a closing brace.
ENTRY = r"(?i)@[a-z]+\s*\{\s*[^,]+,(?:[^\n]++|\n(?!\s*\}))*+\n\s*\}"
#: Possessive, so that long values take no stack; giving back a part of a run could never make a value end.
FIELD = r"(?i)[a-z][a-z0-9_-]*\s*=\s*(?:\{(?:[^{}]++|\{[^{}]*+\})*+\}|\"(?:[^\"\\]++|\\.)*+\"|[^,\n]+)"


def clean(value: Column) -> Column:
    """Without one pair of outer delimiters, unescaped."""
    bare = F.regexp_replace(F.trim(value), r"^[{\"']|[}\"']$", "")
    return F.trim(let(bare, lambda b: F.when(F.contains(b, F.lit("\\")), F.regexp_replace(b, r"\\([{}\",])", "$1")).otherwise(b)))


def read_bibtex(files: DataFrame, column: str = "bibtex", keep: Sequence[str] = ()) -> DataFrame:
    """Entries with a title: type, key, fields (lower-case names, the last of a name wins), title, year, doi, arxiv_id, and the columns to keep.

    Fields leave an explode, below which no filter is pushed: a filter on the title would find them anew for each of its uses."""
    entry = files.select(*keep, F.explode(F.regexp_extract_all(column, F.lit(ENTRY), F.lit(0))).alias("e"))
    body = F.regexp_extract("e", r"(?i)^@[a-z]+\s*\{\s*[^,]+,([\s\S]*)\n\s*\}$", 1)
    pairs = F.transform(F.regexp_extract_all(body, F.lit(FIELD), F.lit(0)), lambda x: F.struct(F.lower(F.trim(F.regexp_extract(x, r"^([^=]*)=", 1))).alias("k"), clean(F.regexp_extract(x, r"(?s)^[^=]*=\s*(.*)$", 1)).alias("v")))
    t = entry.select(F.lower(F.regexp_extract("e", "^@([A-Za-z]+)", 1)).alias("type"), F.trim(F.regexp_extract("e", r"^@[A-Za-z]+\s*\{\s*([^,]+),", 1)).alias("key"), pairs.alias("p"), *keep)
    last = lambda p, n: F.element_at(F.filter(p, lambda x: x["k"] == n), -1)["v"]
    by_name = lambda p: let(F.array_distinct(F.transform(p, lambda x: x["k"])), lambda names: F.map_from_arrays(names, F.transform(names, lambda n: last(p, n))))
    t = t.select(*keep, "type", "key", F.explode(F.array(let(F.col("p"), by_name))).alias("fields"))
    f = lambda n: F.try_element_at("fields", F.lit(n))
    year = F.coalesce(truthy(f("year")), F.substring(f("date"), 1, 4)).try_cast("int")
    eprint = F.coalesce(truthy(f("eprint")), truthy(f("arxivid")), truthy(f("arxiv")))
    return t.select("type", "key", "fields", f("title").alias("title"), year.alias("year"), f("doi").alias("doi"), arxiv_id(eprint, f("url")).alias("arxiv_id"), *keep).where(truthy(F.col("title")).isNotNull())
