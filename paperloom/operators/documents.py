"""Whole-document operators: quality gates, chunking, placeholders. One Arrow batch at a time; texts stay whole."""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.cluster import ship_code, small_batches

IMAGE = r"!\[[^\]]*\]\([^)]*\)|<img\b"
BIND = "PL_BIND_"
RUN = {k: re.compile(rf"(.{{{k}}})\1+", re.S) for k in (2, 3, 4)}


def is_complete(markdown: Column, pages: Column, embedded_images: Column, per_page: int = 500) -> Column:
    """Fails closed: unknown or zero pages are incomplete, as are few characters a page or lost images."""
    chars = F.length(F.regexp_replace(markdown, r"\s+", ""))
    refs = F.coalesce(F.regexp_count(markdown, F.lit("(?i)" + IMAGE)), F.lit(0))
    enough = (embedded_images <= 0) | (refs >= F.greatest(F.lit(1), F.ceil(embedded_images / 2)))
    return F.coalesce((pages > 0) & (chars >= pages * per_page) & enough, F.lit(False))


def repeated_run(text: str) -> tuple[int, str]:
    """Length and unit of the longest run of a unit of 2 to 4 characters, white space aside, if it is 20 units or more."""
    bare = re.sub(r"\s+", "", text)
    best, unit = 0, ""
    for k, pattern in RUN.items():
        for m in pattern.finditer(bare):
            if len(m[0]) > best and len(m[0]) >= 2 * k:
                best, unit = len(m[0]), m[1]
    return best, unit


def inspect(markdown: str) -> list[str]:
    """Codes of the quality issues of a parsed source, with line numbers where they have one."""
    out = []
    for n, line in enumerate(markdown.replace("\r", "").split("\n"), 1):
        text = line.strip()
        if not text:
            continue
        run, _ = repeated_run(text)
        if run >= 40 and run / max(1, len(re.sub(r"\s+", "", text))) >= 0.12:
            out.append(f"repeated_text:{n}")
        if len(text) > 6000 and not re.search(r"<table\b.*</table>", text, re.I | re.S):
            out.append(f"oversized_line:{n}")
        if re.match(r"(?:gardless|nter|dardless|ontent|igure|able)\b", text, re.I):
            out.append(f"orphan_fragment:{n}")
    for tag in ("table", "tr", "td", "th"):
        if len(re.findall(rf"<{tag}\b", markdown, re.I)) != len(re.findall(rf"</{tag}>", markdown, re.I)):
            out.append(f"unbalanced_html:{tag}")
    if len(re.findall(r"(?<!\\)\$", markdown)) % 2 or len(re.findall(r"(?<!\\)\$\$", markdown)) % 2:
        out.append("unbalanced_math")
    return out


def blocks(markdown: str) -> list[str]:
    """Paragraphs; code, math and binding fences stay in one piece."""
    out, now, code, math, bound = [], [], False, False, False
    for raw in [*markdown.replace("\r", "").split("\n"), None]:
        line = (raw or "").strip()
        bound |= BIND in line and f"{BIND}END_" not in line
        if raw is None or not (code or math or bound or line):
            if piece := "\n".join(now).strip():
                out.append(piece)
            now = []
            continue
        now.append(raw)
        code ^= line.startswith("```")
        math ^= not code and line == "$$"
        bound &= f"{BIND}END_" not in line
    return out


def is_atomic(block: str) -> bool:
    return BIND in block or block.startswith(("```", "$$", "|")) or bool(re.match(r"<table\b|!\[[^\]]*\]\(", block, re.I))


def pack(units: list[str], limit: int, glue: str, alone=lambda u: False) -> list[str]:
    """Units joined greedily up to limit; a unit for which alone holds begins a new piece."""
    out, now = [], ""
    for u in units:
        if now and (alone(u) or len(now) + len(glue) + len(u) > limit):
            out.append(now)
            now = ""
        now = f"{now}{glue}{u}" if now else u
    return [*out, now] if now else out


def split_block(block: str, limit: int) -> list[str]:
    if len(block) <= limit or is_atomic(block):
        return [block]
    units = [u.strip() for u in re.split(r"(?<=[.!?。！？])\s+|\n+", block) if u.strip()]
    hard = [u[k : k + limit] for u in units for k in range(0, len(u), limit)]
    return pack(hard, limit, " ") if len(units) > 1 else hard


def chunks(markdown: str, limit: int = 9000) -> list[str]:
    """Chunks of whole blocks of at most limit characters (atomic blocks may be longer); a heading begins a chunk."""
    return pack([p for b in blocks(markdown) for p in split_block(b, limit)], limit, "\n\n", lambda b: bool(re.match(r"#{1,6}\s", b)))


#: What a translator must not touch, in the order of protection.
PROTECTED = (
    ("BIND", re.compile(rf"<!--{BIND}(?:END_)?(?:figure|table|table_image)-\d{{3}}-->", re.I)), ("TABLE", re.compile(r"<table\b.*?</table>", re.I | re.S)),
    ("ASSET", re.compile(r"<div\b[^>]*>\s*<img\b[^>]*>\s*</div>|<img\b[^>]*>|!\[[^\]]*\]\([^)]+\)", re.I)),
    ("MATH", re.compile(r"(?<!\\)\$\$.*?(?<!\\)\$\$|\\\[.*?\\\]|(?<!\\)\$[^$\n]+(?<!\\)\$|\\\([^\n]+?\\\)", re.S)),
)


def protect(markdown: str) -> tuple[str, list[tuple[str, str]]]:
    """The text with tokens, and (token, value) in order."""
    kept: list[tuple[str, str]] = []

    def hide(kind):
        def put(m):
            kept.append((f"[[PL_{kind}_{len(kept):06d}]]", m[0]))
            return kept[-1][0]

        return put

    for kind, pattern in PROTECTED:
        markdown = pattern.sub(hide(kind), markdown)
    return markdown, kept


def restore(text: str, kept: list[tuple[str, str]]) -> str:
    for token, value in reversed(kept):  # later tokens may hold earlier ones
        text = text.replace(token, value)
    return text


def fragment_issues(source: str, translated: str) -> list[str]:
    """What a translated fragment lost: images, table cells, headings, protected tokens."""
    count = lambda p, s: sorted(re.findall(p, s, re.I))
    checks = (("images", IMAGE + r"[^>]*"), ("tables", r"</?(?:table|tr|td|th)\b"), ("headings", r"(?m)^#{1,6}(?=\s)"), ("tokens", r"\[\[PL_[A-Z]+_\d{6}\]\]"))
    return [name for name, p in checks if count(p, source) != count(p, translated)]


# ---------------------------------------------------------------- DataFrames of id, markdown
#: Fixed value: characters of results after which a worker hands them on.
HANDED = 1 << 21


def _each_text(docs: DataFrame, rows, schema: pa.Schema, ddl: str) -> DataFrame:
    """rows(id, text) of every row of docs(id, markdown), one text at a time: a worker holds the batch as Arrow has it,
    one text, and a few results."""

    def run(batches):
        made = lambda out: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        for batch in batches:
            out, held = [], 0
            for i, m in zip(batch.column("id"), batch.column("markdown")):
                text = m.as_py() or ""
                out += rows(i.as_py(), text)
                held += len(text)
                if held >= HANDED and out:
                    yield made(out)
                    out, held = [], 0
            if out:
                yield made(out)

    ship_code(docs.sparkSession)
    small_batches(docs.sparkSession)
    return docs.select("id", "markdown").mapInArrow(run, ddl)


def chunk_documents(docs: DataFrame, limit: int = 9000) -> DataFrame:
    rows = lambda i, m: [(i, k, len(c), c) for k, c in enumerate(chunks(m, limit))]
    schema = pa.schema([("id", pa.int64()), ("chunk", pa.int32()), ("chars", pa.int32()), ("text", pa.string())])
    return _each_text(docs, rows, schema, "id long, chunk int, chars int, text string")


#: A run is reported from RUN characters and SHARE of its line, a line from LONG characters; what a page
#: break leaves of a word.
RUN_CHARS, RUN_SHARE, LONG = 40, 0.12, 6000
ORPHAN = r"(?i)^(?:gardless|nter|dardless|ontent|igure|able)\b"


def inspect_documents(docs: DataFrame) -> DataFrame:
    """(id, issues) as inspect finds them; balance and lines are columns, only lines that may hold a run go to Python."""
    m = F.coalesce("markdown", F.lit(""))
    n = lambda p: F.regexp_count("m", F.lit(p))
    lines = F.transform(F.split(F.regexp_replace("m", "\r", ""), "\n", -1), lambda x, i: F.struct((i + 1).alias("n"), F.regexp_replace(x, r"^\s+|\s+$", "").alias("t")))
    lines = F.filter(lines, lambda x: x["t"] != "")

    @F.pandas_udf("array<boolean>")
    def runs(texts: pd.Series) -> pd.Series:
        bad = lambda t: (r := repeated_run(t)[0]) >= RUN_CHARS and r / max(1, len(re.sub(r"\s+", "", t))) >= RUN_SHARE
        return pd.Series([[bad(t) for t in ts] for ts in texts], index=texts.index, dtype=object)

    found = docs.select("id", m.alias("m")).select("id", "m", lines.alias("lines"))
    may = lambda x: F.regexp_replace(x["t"], r"\s+", "").rlike(r"(?s)(.{2,4})\1{9,}")
    found = found.withColumn("few", F.filter("lines", may))
    code = lambda name, x: F.concat(F.lit(f"{name}:"), x["n"].cast("string"))
    at = lambda name, k: F.transform(F.filter("few", lambda x, i: F.get("bad", i)), lambda x: F.struct(x["n"].alias("n"), F.lit(k).alias("k"), code(name, x).alias("c")))
    pick = lambda name, k, cond: F.transform(F.filter("lines", cond), lambda x: F.struct(x["n"].alias("n"), F.lit(k).alias("k"), code(name, x).alias("c")))
    found = found.withColumn("bad", F.when(F.size("few") > 0, runs(F.transform("few", lambda x: x["t"]))).otherwise(F.array().cast("array<boolean>")))
    each = F.concat(at("repeated_text", 0), pick("oversized_line", 1, lambda x: (F.char_length(x["t"]) > LONG) & ~x["t"].rlike(r"(?is)<table\b.*</table>")), pick("orphan_fragment", 2, lambda x: x["t"].rlike(ORPHAN)))
    tags = [F.when(n(rf"(?i)<{t}\b") != n(f"(?i)</{t}>"), f"unbalanced_html:{t}") for t in ("table", "tr", "td", "th")]
    math_ = F.when((n(r"(?<!\\)\$") % 2 != 0) | (n(r"(?<!\\)\$\$") % 2 != 0), "unbalanced_math")
    return found.select("id", F.filter(F.concat(F.transform(F.array_sort(each), lambda x: x["c"]), F.array(*tags, math_)), lambda x: x.isNotNull()).alias("issues"))


def roundtrip_documents(docs: DataFrame) -> DataFrame:
    rows = lambda i, m: [(i, restore(*protect(m)) == m)]
    return _each_text(docs, rows, pa.schema([("id", pa.int64()), ("same", pa.bool_())]), "id long, same boolean")
