"""Figures that a parser read as tables, found again; layout records and the manifests of parser runs.

The text part is here: which tables of which page belong to which figure caption. Where a picture comes from (an image
of the PDF, a crop of a page) is a function that the caller gives; without one the table stays and fails the binding.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from paperloom.operators import structure as st
from paperloom.sources.services import Parsed, complete

PAGE_BREAK = re.compile(r"\n{2,}---\n{2,}")
TABLE = re.compile(r"<table\b.*?</table>", re.I | re.S)
#: What the cells of a plot's coordinates say, and the rows from which coordinates alone show a plot.
AXES = (r"\bx\s*\[?\s*m\s*\]?", r"\by\s*\[?\s*m\s*\]?")
LEGEND = r"black\s+line|red\s+line|reference|pred(?:icted)?\s+traj|gt\s+traj"
PLOT_ROWS = 8


@dataclass
class Picture:
    page: int
    bbox: tuple[float, float, float, float]
    page_height: float | None = None
    asset: str | None = None


@dataclass
class Recovered:
    id: str
    page: int
    asset: str
    tables: int


def is_plot(table: str) -> bool:
    """Whether a table holds the coordinates of a chart: both axes, and a legend or many rows."""
    text = re.sub(r"<[^>]+>|&nbsp;", " ", table).lower()
    return all(re.search(a, text) for a in AXES) and (re.search(LEGEND, text) is not None or len(re.findall(r"<tr\b", table, re.I)) >= PLOT_ROWS)


def figure_groups(page: str) -> list[tuple[st.Caption, list[tuple[int, int]]]]:
    """Figure captions of a page with the tables that belong to them, in page order.

    A table belongs to the nearest caption that doesn't overlap it; one of a plot's coordinates to the nearest caption
    of a figure."""
    captions, groups = st.captions(page), {}
    for m in TABLE.finditer(page):
        gap = lambda c, m=m: c.start - m.end() if c.start >= m.end() else m.start() - c.end
        able = sorted((gap(c), c.start, c.id) for c in captions if gap(c) >= 0 and (c.kind == "figure" or not is_plot(m[0])))
        if able:
            groups.setdefault(able[0][2], []).append((m.start(), m.end()))
    return [(c, groups[c.id]) for c in captions if c.id in groups and c.kind == "figure"]


def layout_pictures(text: str | None) -> list[Picture]:
    """Pictures of a layout record (JSON) with a page and a box of four numbers; none if it is broken."""
    try:
        found = json.loads(text or "").get("pictures") or []
    except (ValueError, AttributeError):
        return []
    return [Picture(p["page"], tuple(p["bbox"]), p.get("page_height"), p.get("asset")) for p in found if isinstance(p, dict) and isinstance(p.get("page"), int) and isinstance(p.get("bbox"), list) and len(p["bbox"]) == 4]


def only_picture(pictures: list[Picture], page: int, groups: int) -> Picture | None:
    """The picture of a page if it has one, for one group of tables: nothing else is certain."""
    on_page = [p for p in pictures if p.page == page]
    return on_page[0] if len(on_page) == 1 and groups == 1 else None


def recover(markdown: str, picture: Callable[[int, int, Picture | None], str | None], pictures: list[Picture] = ()) -> tuple[str, list[Recovered]]:
    """The text with the tables of figures as images, and what was recovered.

    picture(page, number, layout picture or None) makes an image and returns its name, or None: then the tables stay."""
    pages, out = PAGE_BREAK.split(markdown), []
    for k, page in enumerate(pages, 1):
        groups, edits = figure_groups(page), []
        for n, (_, spans) in enumerate(groups, 1):
            name = picture(k, n, only_picture(list(pictures), k, len(groups)))
            if name is None:
                continue
            edits += [(*spans[0], f"![Image]({name})"), *((a, b, "") for a, b in spans[1:])]
            out.append(Recovered(f"figure-recovered-{k}-{n}", k, name, len(spans)))
        for a, b, text in sorted(edits, reverse=True):
            page = f"{page[:a]}{text}{page[b:]}"
        pages[k - 1] = page
    return "\n\n---\n\n".join(pages), out


def run_parser(pdf: bytes, folder: str | Path, run: Callable[[bytes, Path], str], parser: str, stats: Callable[[bytes], tuple[int | None, int | None]]) -> tuple[Parsed, dict]:
    """A local parser's answer: its last line is a manifest that names the Markdown in folder. The manifest comes back
    with the statistics of the PDF, its hash, and whether the text is complete."""
    folder = Path(folder)
    lines = run(pdf, folder).strip().splitlines()
    try:
        manifest = json.loads(lines[-1]) if lines else {}
    except ValueError:
        manifest = {}
    if manifest.get("parser") != parser or not manifest.get("markdown"):
        raise ValueError(f"{parser} gave no manifest")
    file = (folder / manifest["markdown"]).resolve()
    if folder.resolve() not in file.parents:
        raise ValueError("the manifest names a file outside of its folder")
    pages, images = stats(pdf)
    parsed = Parsed(file.read_text(), parser, pages, images)
    return parsed, manifest | {"pages": pages, "embedded_images": images, "text_chars": len(re.sub(r"\s+", "", parsed.markdown)), "complete": complete(parsed), "pdf_sha256": hashlib.sha256(pdf).hexdigest()}


def pdf_text(candidates, fetch: Callable[[str], bytes | None], extract: Callable[[bytes], str]) -> tuple[str, str] | None:
    """(address, text) of the first candidate that is a PDF with text in it."""
    for url in candidates:
        body = fetch(url)
        if body and body[:5] == b"%PDF-" and (text := extract(body).strip()):
            return url, text
    return None
