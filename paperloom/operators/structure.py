"""Structure of parsed papers: headings, front matter, captions and the binding of figures and tables to them."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REACH = 1800
#: Headings that open a main section.
SECTIONS = (
    "abstract|introduction|related works?|background|preliminaries|method|methodology|approach|experiments?|experimental setup|experimental results|evaluation|results?|discussion|limitations?|"
    "conclusions?(?: and future works?)?|future works?|references|bibliography|acknowledg(?:e)?ments|implementation details|dataset introduction|additional experimental results|"
    "additional qualitative results|supplementary material|appendix"
)
HEADING = re.compile(r"^(#{1,6})\s+(.+)$")
CAPTION = re.compile(r"(?:^|\n|>[ \t]*)(\*\*)?(Figure|Fig\.?|Table|图|表)\s*(\d+|[IVXLCDM]+|\$[IVXLCDM]+\$)\s*[.:：-]", re.I)
OBJECT = re.compile(r"<table\b.*?</table>|!\[[^\]]*\]\(([^)\n]+)\)|<img\b[^>]*\bsrc=[\"']([^\"']+)[\"'][^>]*>", re.I | re.S)
CROP = re.compile(r"assets/page-(\d+)-\d+-img_in_image_box_(\d+)_(\d+)_", re.I)
SUPERSCRIPTS = "⁰¹²³⁴⁵⁶⁷⁸⁹"


# ---------------------------------------------------------------- headings
def plain_heading(text: str) -> str:
    """Without emphasis and numbering, lower case."""
    return re.sub(r"^\s*(?:appendix\s+)?(?:[ivxlcdm]+|[a-z]|\d+(?:\.\d+)*)[.)：:]?\s+", "", re.sub("[*_`]", "", text), flags=re.I).strip().lower()


def is_section(text: str) -> bool:
    return re.fullmatch(SECTIONS, plain_heading(text)) is not None


def numbered_depth(text: str) -> int | None:
    """Depth that a heading's own number tells: Roman 2 (one letter: 3), letter 3, 1.2.3 one more than its parts."""
    text = re.sub("[*_`]", "", text).strip()
    if m := re.match(r"([IVXLCDM]+)[.)：:]\s+(.+)$", text, re.I):
        return 2 if len(m[1]) > 1 or is_section(m[2]) else 3
    if re.match(r"[A-Z][.)：:]\s+", text):
        return 3
    if m := re.match(r"(\d+(?:\.\d+)*)(?:[.)：:]|\s)", text):
        return min(5, m[1].count(".") + 2)
    return None


def prepare(markdown: str, title: str) -> str:
    """From the first section heading on, without the repeated title, with heading depths made even."""
    lines = markdown.replace("\r", "").strip().split("\n")
    heads = [HEADING.match(x.strip()) for x in lines]
    first = next((k for k, m in enumerate(heads) if m and (len(m[1]) >= 2 or is_section(m[2]))), 0)
    out = []
    for line, m in zip(lines[first:], heads[first:]):
        if not m:
            out.append("" if line.strip() == "---" else line)
        elif plain_heading(m[2]) != plain_heading(title):
            text = m[2].strip()
            depth = numbered_depth(text) or (2 if len(m[1]) == 1 or is_section(text) else 4 if len(m[1]) >= 3 else 3)
            out.append(f"{'#' * depth} {text}")
    return re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip()


def number_references(markdown: str) -> str:
    """Entries of the reference section numbered from 1, one a line."""
    lines = markdown.replace("\r", "").split("\n")
    at = next((k for k, x in enumerate(lines) if (m := HEADING.match(x)) and re.fullmatch("references?|bibliography|参考文献", plain_heading(m[2]))), None)
    if at is None:
        return markdown
    end = next((k for k in range(at + 1, len(lines)) if HEADING.match(lines[k])), len(lines))
    body = "\n".join(lines[at + 1 : end]).strip()
    marks = [m.start(1) for m in re.finditer(r"(?:^|\s)(\d{1,3})\.\s+(?=[A-Z一-鿿])", body)]
    entries = [body[a:b] for a, b in zip(marks, [*marks[1:], len(body)])] if len(marks) >= 2 else re.split(r"\n\s*\n", body)
    entries = [re.sub(r"^\s*(?:\d+[.)]|\[\d+\])\s*", "", " ".join(e.split())) for e in entries if e.strip()]
    if not entries:
        return markdown
    return re.sub(r"\n{3,}", "\n\n", "\n".join([*lines[: at + 1], "", *(f"{k}. {e}" for k, e in enumerate(entries, 1)), *lines[end:]]))


# ---------------------------------------------------------------- front matter
def front_matter(markdown: str) -> list[str]:
    lines = markdown.replace("\r", "").strip().split("\n")
    first = next((k for k, x in enumerate(lines) if HEADING.match(x.strip())), 0)
    return lines[:first] if first else lines


def affiliations(markdown: str, title: str) -> list[tuple[int, str]]:
    """Numbered affiliations, on lines of their own or after superscripts within a line."""
    out: dict[tuple[int, str], None] = {}
    for line in front_matter(markdown):
        line = re.sub(r"[${}]", "", line).replace("\\^", "^").strip()
        line = re.sub(f"[{SUPERSCRIPTS}]", lambda m: f"^{SUPERSCRIPTS.index(m[0])}", line)
        if (m := re.match(r"\^?(\d+)\s+(.+)$", line)) and plain_heading(m[2]) != plain_heading(title):
            out[int(m[1]), " ".join(m[2].split())] = None
        for m in re.finditer(r"\^(\d+)\s*,?\s*([A-Za-z][^,$]{1,80})", line):
            if "^" not in m[2]:
                out[int(m[1]), " ".join(m[2].split())] = None
    return list(out)


def author_markers(markdown: str) -> list[tuple[str, list[int]]]:
    """Authors of the first line with two markers or more, with the numbers they carry."""
    line = next((x for x in front_matter(markdown) if len(re.findall(r"\^\{[^}]+\}", x)) >= 2 and not re.match(r"\s*\$?\s*\^\{?\d", x)), "")
    out: dict[str, list[int]] = {}
    for m in re.finditer(r"([^,]+?)\s*(?:\^\{([^}]+)\}|<sup>([^<]+)</sup>)", " ".join(line.split()), re.I):
        name, numbers = m[1].rstrip(" $").strip(), list(dict.fromkeys(map(int, re.findall(r"\d+", m[2] or m[3]))))
        if name and numbers:
            out.setdefault(name, numbers)
    return list(out.items())


def resolve_institutions(df: DataFrame, aliases: DataFrame, name: str = "original") -> DataFrame:
    """Adds canonical_en, name_zh and confidence (1 known, 0 unknown) by the normalised name."""
    key = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    a = aliases.select(key(F.col("original")).alias("_k"), "canonical_en", "name_zh").dropDuplicates(["_k"])
    j = df.withColumn("_k", key(F.col(name))).join(a, "_k", "left")
    return j.withColumn("confidence", F.when(F.col("canonical_en").isNotNull(), 1.0).otherwise(0.0)).withColumn("canonical_en", F.coalesce("canonical_en", name)).withColumn("name_zh", F.coalesce("name_zh", F.lit(""))).drop("_k")


# ---------------------------------------------------------------- captions and objects
@dataclass
class Caption:
    id: str
    kind: str
    number: int
    start: int
    end: int
    text: str


@dataclass
class Bound:
    id: str
    kind: str
    start: int
    end: int
    caption_id: str | None = None
    caption_number: int | None = None
    distance: int | None = None
    ambiguous: bool = True


def number_value(text: str) -> int:
    text = text.strip("$").upper()
    if text.isdigit():
        return int(text)
    values = [dict(I=1, V=5, X=10, L=50, C=100, D=500, M=1000)[c] for c in text]
    return sum(v if v >= max(values[k:]) else -v for k, v in enumerate(values))


def captions(markdown: str) -> list[Caption]:
    out = []
    for m in CAPTION.finditer(markdown):
        start = m.start(1) if m[1] else m.start(2)
        end = markdown.find("\n", start)
        end = len(markdown) if end < 0 else end
        out.append(Caption(f"caption-{len(out) + 1:03d}", "figure" if m[2].lower()[:3] in ("fig", "图") else "table", number_value(m[3]), start, end, markdown[start:end].strip()))
    return out


def objects(markdown: str) -> list[Bound]:
    """Tables and images in order; crops side by side on a page are one figure."""
    out: list[tuple[str, int, int, object]] = []
    for m in OBJECT.finditer(markdown):
        kind = "table" if m[0][:6].lower() == "<table" else "figure"
        box = CROP.search(m[1] or m[2] or "") if kind == "figure" else None
        last = out[-1] if out else None
        if last and box and last[3] and not markdown[last[2] : m.start()].strip():
            (p, x, y), (q, u, v) = map(int, last[3].groups()), map(int, box.groups())
            if p == q and abs(y - v) <= 120 and abs(x - u) >= 200:
                out[-1] = (kind, last[1], m.end(), last[3])
                continue
        out.append((kind, m.start(), m.end(), box))
    seen = {"figure": 0, "table": 0}
    found = []
    for kind, a, b, _ in out:
        seen[kind] += 1
        found.append(Bound(f"{kind}-{seen[kind]:03d}", kind, a, b))
    return found


def bind(markdown: str) -> tuple[list[Bound], list[str]]:
    """Each object with its caption, and the ids that need a review.

    An object takes the nearest free caption within REACH in its direction (below a figure, above a table), else in
    any; only the first kind with the same kind of caption is certain. It fails closed: unused captions, objects
    without any, and numbers of a kind that are not exactly 1 to n put what they touch up for review.
    """
    found, every, review = objects(markdown), captions(markdown), []
    free, starts = dict.fromkeys(range(len(every))), [c.start for c in every]
    widest = max((c.end - c.start for c in every), default=0)
    for o in found:
        def place(k, o=o):
            c = every[k]
            gap = c.start - o.end if c.start >= o.end else o.start - c.end
            right = c.start >= o.end if o.kind == "figure" else c.end <= o.start
            return not right, max(0, gap), gap

        # captions lie in order, so those in reach are neighbours
        reach = range(bisect_left(starts, o.start - REACH - widest), bisect_right(starts, o.end + REACH))
        near = sorted((k for k in reach if k in free and place(k)[2] <= REACH), key=lambda k: place(k)[:2])
        if near:
            c = every[near[0]]
            del free[near[0]]
            o.caption_id, o.caption_number, o.distance = c.id, c.number, place(near[0])[2]
            o.ambiguous = place(near[0])[0] or c.kind != o.kind
        if o.ambiguous:
            review.append(o.id)
    review += [every[k].id for k in free]
    for kind in ("figure", "table"):
        sure = [o for o in found if o.kind == kind and not o.ambiguous]
        if sorted(o.caption_number for o in sure) != list(range(1, len(sure) + 1)):
            for o in sure:
                o.ambiguous = True
                review.append(o.id)
    return found, list(dict.fromkeys(review))


def table_signature(table: Column) -> Column:
    """`rows:cells:headers:rowspans:colspans` of an HTML table."""
    n = lambda p: F.coalesce(F.regexp_count(table, F.lit("(?i)" + p)), F.lit(0)).cast("string")
    return F.concat_ws(":", n(r"<tr\b"), n(r"<td\b"), n(r"<th\b"), n(r"\browspan\s*="), n(r"\bcolspan\s*="))


def bind_documents(docs: DataFrame) -> DataFrame:
    """A row per object of docs(id, markdown)."""
    names = ["object_id", "kind", "start", "end", "caption_id", "caption_number", "distance", "ambiguous"]

    def run(frames):
        for f in frames:
            rows = [(i, *asdict(o).values()) for i, m in zip(f["id"], f["markdown"]) for o in bind(m or "")[0]]
            yield pd.DataFrame(rows, columns=["doc", *names]).astype({"caption_number": "Int64", "distance": "Int64"})

    return docs.mapInPandas(run, "doc long, object_id string, kind string, start int, end int, caption_id string, caption_number int, distance int, ambiguous boolean")
