"""Services outside of the engine as interfaces: live search, citation graphs, parsers, OCR, PDF text. What is sent and
what comes back is defined here; how it travels is a function that the caller gives. Nothing here opens a connection."""

from __future__ import annotations

import json
import os
import re
import time
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from pathlib import Path
from urllib.parse import urljoin

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.text import pdf_links
from paperloom.operators.structure import SECTIONS
from paperloom.sources import payloads

#: Authors and references that are shown, ids in one request, results of a live search.
AUTHORS, LINKED, MOST_RESULTS = 8, 8, 50


# ---------------------------------------------------------------- search and citations
def clamp_search(query: str, limit) -> tuple[str, int]:
    """A query of two characters or more, and a limit of 1 to 50 (20 where it is no number)."""
    query = (query or "").strip()
    if len(query) < 2:
        raise ValueError("a search needs two characters")
    try:
        return query, max(1, min(MOST_RESULTS, int(limit)))
    except (TypeError, ValueError):
        return query, 20


def live_search(works: DataFrame, limit: int) -> DataFrame:
    """Records of a search answer (works in the OpenAlex schema, in the order of `n`), with the first eight authors."""
    few = works.orderBy("n").limit(limit).withColumn("authorships", F.slice("authorships", 1, AUTHORS))
    return payloads.openalex(few)


def citation_edges(works: DataFrame) -> DataFrame:
    """(paper, other, position) of the first eight references of works(id, referenced_works); ids without their address."""
    bare = F.transform(F.slice(F.coalesce("referenced_works", F.array().cast("array<string>")), 1, LINKED), lambda x: F.element_at(F.split(x, "/"), -1))
    e = works.select(F.element_at(F.split("id", "/"), -1).alias("paper"), F.posexplode(bare).alias("position", "other"))
    return e.where("other <> ''").select("paper", "other", "position")


def citation_neighbours(works: DataFrame, paper: str) -> DataFrame:
    """(relation, other) of a work: its first references, and the first eight works that refer to it."""
    e = citation_edges(works)
    out = e.where(F.col("paper") == paper).select(F.lit("reference").alias("relation"), "other", "position")
    back = e.where(F.col("other") == paper).select(F.col("paper").alias("other")).distinct().orderBy("other").limit(LINKED)
    return out.select("relation", "other").unionByName(back.select(F.lit("cited_by").alias("relation"), "other"))


def id_batches(ids: Sequence[str], size: int = 20) -> list[str]:
    """Ids joined by | for one request each."""
    return ["|".join(ids[k : k + size]) for k in range(0, len(ids), size)]


def resolve_links(pages: DataFrame) -> DataFrame:
    """(page_id, position, url) of the PDF links of landing pages(page_id, url, html), resolved against the page's address;
    addresses that can't be resolved go, repeated ones stay once."""

    @F.udf("array<string>")
    def absolute(base, found):
        out: dict[str, None] = {}
        for x in found or ():
            try:
                out.setdefault(urljoin(base or "", x.strip()))
            except ValueError:
                continue
        return [u for u in out if re.match("https?://", u)]

    return pages.select("page_id", F.posexplode(absolute("url", pdf_links(F.col("html")))).alias("position", "url"))


def worklist(candidates: Sequence[str], expand: Callable[[str], Sequence[str]], fetch: Callable[[str], bytes | None], most: int = 40) -> tuple[str, bytes] | None:
    """First address whose content is a PDF; landing pages put their links behind the others. Each address once."""
    todo, seen = list(dict.fromkeys(candidates)), set()
    while todo and len(seen) < most:
        url = todo.pop(0)
        if url in seen:
            continue
        seen.add(url)
        body = fetch(url)
        if body and body[:5] == b"%PDF-":
            return url, body
        if body is not None:
            todo += [u for u in expand(url) if u not in seen]
    return None


# ---------------------------------------------------------------- parsers
@dataclass
class Parsed:
    markdown: str
    parser: str
    pages: int | None = None
    images: int | None = None
    assets: dict[str, bytes] = field(default_factory=dict)


def ocr_pages(lines: DataFrame) -> DataFrame:
    """(doc, markdown, assets) of OCR answers: JSON lines(doc, line, json) with the Markdown and images of each layout
    result, joined by rules in page order; images are renamed by page, and references with them."""
    ddl = "struct<result:struct<layoutParsingResults:array<struct<markdown:struct<text:string,images:map<string,string>>>>>>"
    r = lines.select("doc", "line", F.posexplode(F.from_json("json", ddl)["result"]["layoutParsingResults"]).alias("k", "r"))
    r = r.withColumn("page", F.row_number().over(Window.partitionBy("doc").orderBy("line", "k")))
    names = F.transform(F.map_keys(F.coalesce("r.markdown.images", F.create_map().cast("map<string,string>"))), lambda n: F.struct(n.alias("old"), F.concat(F.lit("assets/page-"), F.lpad(F.col("page").cast("string"), 3, "0"), F.lit("-"), F.regexp_replace(F.element_at(F.split(n, "/"), -1), "[^A-Za-z0-9._-]+", "_")).alias("new")))
    text = F.aggregate(names, F.coalesce("r.markdown.text", F.lit("")), lambda t, n: F.replace(t, n["old"], n["new"]))
    one = r.select("doc", "page", text.alias("text"), names.alias("names"))
    pages = F.array_sort(F.collect_list(F.struct("page", "text", "names")))
    return one.groupBy("doc").agg(pages.alias("p")).select("doc", F.array_join(F.transform("p", lambda x: x["text"]), "\n\n---\n\n").alias("markdown"), F.flatten(F.transform("p", lambda x: F.transform(x["names"], lambda n: n["new"]))).alias("assets"))


def promote_headings(text: str) -> str:
    """Plain PDF text as Markdown: lines that are section names or numbered titles become headings, page breaks rules."""
    out = []
    for line in text.replace("\r", "").replace("\f", "\n---\n").split("\n"):
        bare = line.strip()
        if re.fullmatch(rf"(?:\d+(?:\.\d+)*\.?\s+|[IVX]+\.\s+)?(?:{SECTIONS})", bare, re.I):
            out.append(f"## {bare}")
        elif (m := re.fullmatch(r"(\d+(?:\.\d+)*)\.?\s+([A-Z][^.!?]{2,80})", bare)) and len(bare.split()) <= 12:
            out.append(f"{'#' * min(5, m[1].count('.') + 2)} {bare}")
        else:
            out.append(line.rstrip())
    return "\n".join(out).strip()


def complete(parsed: Parsed, per_page: int = 500) -> bool:
    """The completeness gate for one parse; unknown pages or images are incomplete."""
    if not parsed.pages or parsed.images is None:
        return False
    refs = len(re.findall(r"!\[[^\]]*\]\([^)]*\)|<img\b", parsed.markdown, re.I))
    return len(re.sub(r"\s+", "", parsed.markdown)) >= parsed.pages * per_page and (parsed.images <= 0 or refs >= max(1, -(-parsed.images // 2)))


def parse(pdf: bytes, parsers: Iterable[tuple[str, Callable[[bytes], Parsed | None]]], ok: Callable[[Parsed], bool]) -> Parsed:
    """The first parse that passes the gates, in the order of preference; an error names what each one lacked."""
    why = []
    for name, parser in parsers:
        try:
            found = parser(pdf)
        except Exception as e:
            why.append(f"{name}: {e}")
            continue
        if found is not None and ok(found):
            return found
        why.append(f"{name}: {'no answer' if found is None else 'rejected'}")
    raise ValueError("SOURCE_QUALITY: " + "; ".join(why))


def reuse(cached: Mapping[str, object] | None, pdf_sha256: str | None) -> bool:
    """Whether a stored parse may be used again: only for the very same PDF, never without a hash."""
    return bool(cached and pdf_sha256 and cached.get("pdf_sha256") == pdf_sha256)


def poll(submit: Callable[[], str], ask: Callable[[str], tuple[str, object]], every: float = 5.0, limit: float = 900.0, now: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
    """The result of a submitted job: asked for until it is done; a failure or the deadline raises."""
    job, end = submit(), now() + limit
    while now() < end:
        state, result = ask(job)
        if state == "done":
            return result
        if state == "failed":
            raise RuntimeError(f"job {job} failed: {result}")
        sleep(every)
    raise TimeoutError(f"job {job} took more than {limit} s")


# ---------------------------------------------------------------- settings
def read_settings(path: str | Path, environment: Mapping[str, str] | None = None) -> dict[str, str]:
    """NAME=value lines of a file, quotes taken off; what the environment defines wins, of repeated names the first."""
    out = dict(os.environ if environment is None else environment)
    try:
        lines = Path(path).read_text().splitlines()
    except OSError:
        return out
    for line in lines:
        m = re.fullmatch(r"\s*(?:export\s+)?([A-Za-z_]\w*)\s*=\s*(.*?)\s*", line)
        if m and not line.lstrip().startswith("#"):
            out.setdefault(m[1], m[2][1:-1] if len(m[2]) > 1 and m[2][0] == m[2][-1] and m[2][0] in "\"'" else m[2])
    return out


def notify(text: str, send: Callable[[str], object] | None = None, limit: int = 3900) -> bool:
    """Sends a digest, cut to limit, if a hook is given; a failing hook raises nothing."""
    if send is None:
        return False
    try:
        send(text[:limit])
    except Exception:
        return False
    return True


def publish(folder: str | Path, markdown: str, issues: Sequence[str], meta: Mapping[str, object]) -> Path:
    """Writes a translation: as final without issues, else as a candidate beside its issues."""
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    name = "candidate" if issues else "final"
    for n, text in ((f"{name}.md", markdown), ("manifest.json", json.dumps({**meta, "status": "needs_review" if issues else "completed", "issues": list(issues)}, ensure_ascii=False, indent=1))):
        part = folder / f"{n}.{os.getpid()}.tmp"
        part.write_text(text)
        os.replace(part, folder / n)
    return folder / f"{name}.md"


def invalidate(folder: str | Path) -> int:
    """Removes generated files of a document; the number of files that went."""
    files = [p for p in Path(folder).glob("*") if p.is_file() and p.name in {"candidate.md", "final.md", "manifest.json"} or p.suffix == ".chunk"]
    for p in files:
        p.unlink()
    return len(files)
