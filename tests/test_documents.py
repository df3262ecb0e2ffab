"""Repair and validation of documents, written from what they must do."""

from __future__ import annotations

import pytest

from paperloom.functions import providers
from paperloom.operators import documents as doc
from paperloom.operators import structure as st
from paperloom.sources import figures as fg


# ---------------------------------------------------------------- dollars
# ---------------------------------------------------------------- HTML and LaTeX
# ---------------------------------------------------------------- formulas
# ---------------------------------------------------------------- bindings
PAPER = "## Results\n\n![a](assets/a.png)\n\nFigure 1: First.\n\nText between.\n\nTable 1: Second.\n\n<table><tr><td>x</td></tr></table>\n"


# ---------------------------------------------------------------- layout and validation
SOURCE = "## Method\n\nWe set $x + 1$ here.\n\n$$\ny = 2\n$$\n\n![a](assets/a.png)\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n"
GOOD = "# 标题\n\n## 方法\n\n我们设 $x + 1$。\n\n$$\ny = 2\n$$\n\n![图](assets/a.png)\n\n| 甲 | 乙 |\n| --- | --- |\n| 1 | 2 |\n"


# ---------------------------------------------------------------- providers
def test_chunks_are_halved_until_tokens_survive():
    chunk = "\n\n".join(f"Block {k} has $x_{k}$ and words. " + "word " * 100 for k in range(8))
    calls = []

    def provider(text):
        calls.append(len(text))
        return text.upper().replace("[[PL_MATH_", "[[PL_MATH_") if len(text) < 2500 else text.replace("[[PL_MATH_000000]]", "")

    out = providers.translate_chunk(chunk, provider)
    assert len(calls) > 2 and all(f"$x_{k}$" in out for k in range(8))
    with pytest.raises(ValueError):
        providers.translate_chunk("one $x$ block", lambda t: "lost")


def test_titles_and_reviews():
    assert providers.translate_title("A", lambda t: "# 《题目》\nmore") == "题目" and providers.translate_title("A", lambda t: "Title") is None
    found, captions = st.objects("![a](a.png)"), st.captions("Figure 1: x")
    got = providers.review_bindings(found, captions, lambda batch: [{"id": b["id"], "kind": "table", "confidence": 3, "caption_id": "nowhere"} for b in batch] + [{"id": "x", "kind": "table"}], clamp=True)
    assert [(d.id, d.kind, d.confidence, d.caption_id) for d in got] == [("figure-001", "table", 0.99, None)]
    assert providers.first_reviewer([lambda *_: 1 / 0, lambda *_: None, lambda *_: [1]]) == [1]


# ---------------------------------------------------------------- model output
# ---------------------------------------------------------------- figures
def test_figures_are_recovered(tmp_path):
    plot = "<table><tr><td>x [m]</td><td>y [m]</td><td>red line</td></tr></table>"
    real = "<table><tr><td>1</td></tr></table>"
    text = f"{plot}\n\nFigure 1: A path.\n\nTable 1: Numbers.\n\n{real}\n\n---\n\nFigure 2: B.\n\n{real}{real}\n\n---\n\nno figure {real}"
    asked = []

    def picture(page, n, layout):
        asked.append((page, n, layout and layout.asset))
        return f"assets/page-{page}-recovered-{n}.png" if page < 3 else None

    record = '{"pictures": [{"page": 1, "bbox": [0, 1, 2, 3], "asset": "p.png"}, {"page": 2, "bbox": [1]}]}'
    out, found = fg.recover(text, picture, fg.layout_pictures(record))
    assert asked == [(1, 1, "p.png"), (2, 1, None)] and [(r.page, r.tables) for r in found] == [(1, 1), (2, 2)]
    assert out.count(real) == 2 and "assets/page-1-recovered-1.png" in out and fg.layout_pictures("broken") == []
    assert fg.recover(text, lambda *_: None) == (text, [])
    assert fg.is_plot(plot) and not fg.is_plot(real)


def test_parser_runs(tmp_path):
    (tmp_path / "a.md").write_text("x" * 700)
    parsed, manifest = fg.run_parser(b"%PDF-", tmp_path, lambda pdf, folder: 'log\n{"parser": "p", "markdown": "a.md"}', "p", lambda pdf: (1, 0))
    assert manifest["complete"] and manifest["pages"] == 1 and len(manifest["pdf_sha256"]) == 64 and parsed.parser == "p"
    for answer in ("", "no json", '{"parser": "q", "markdown": "a.md"}', '{"parser": "p", "markdown": "../x"}'):
        with pytest.raises(ValueError):
            fg.run_parser(b"", tmp_path, lambda pdf, folder, answer=answer: answer, "p", lambda pdf: (1, 0))
    assert fg.pdf_text(["a", "b"], {"a": b"<html>", "b": b"%PDF-1"}.get, lambda b: " text ") == ("b", "text") and fg.pdf_text([], None, None) is None


def test_chunks_come_from_small_batches(spark):
    """10,000 whole texts a batch, as objects and with all of their chunks, took the memory of a worker."""
    from paperloom.operators import documents as doc

    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    texts = [None, "", "# A\n\nb c. d e.\n\n" * 5, "é" * 25, "| t |\n" * 9] + [f"{i} word. " * i for i in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, markdown string")
    got = sorted(map(tuple, doc.chunk_documents(df, 20).collect()))
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "2000"
    assert got == [(i, k, len(c), c) for i, t in enumerate(texts) for k, c in enumerate(doc.chunks(t or "", 20))]
    assert doc.roundtrip_documents(df).where("same").count() == len(texts)
