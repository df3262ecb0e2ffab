"""Answers of models and what is shown of a paper: classification, summary, evidence, projections, prompts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions import relevance as rel
from paperloom.functions import scoring as sc
from paperloom.functions.text import first_truthy, json_array, normalize_doi, truthy, unfence_json

CLASSIFICATION = (
    "primary_direction string, secondary_directions array<string>, confidence double, reason_zh string, evidence_terms array<string>, new_direction struct<label:string,query:string,reason_zh:string>"
)
#: Lengths to which a model's strings are cut, and how many secondary directions and terms are kept.
LABEL, QUERY, REASON, SECONDARY, TERMS = 40, 160, 200, 3, 5
NOT_STATED = "摘要未说明"


# ---------------------------------------------------------------- classification
def _to_key(item: Column, directions: Sequence[tuple[str, str]]) -> Column:
    """Key of a direction that is named by key or label."""
    out = F.lit(None).cast("string")
    for key, label in reversed(list(directions)):
        out = F.when((item == key) | (item == label), F.lit(key)).otherwise(out)
    return out


def normalize_classification(answer: Column, directions: Sequence[tuple[str, str]]) -> Column:
    """A model's answer (JSON text) as a struct: known directions only, the primary one not among the secondary ones,
    strings cut, confidence between 0 and 1. Broken JSON gives the struct of an empty answer."""
    a = F.coalesce(F.from_json(unfence_json(answer), CLASSIFICATION), F.from_json(F.lit("{}"), CLASSIFICATION))
    primary = _to_key(a["primary_direction"], directions)
    known = F.filter(F.transform(F.coalesce(a["secondary_directions"], F.array().cast("array<string>")), lambda x: _to_key(x, directions)), lambda k: k.isNotNull() & ~k.eqNullSafe(primary))
    n = a["new_direction"]
    new = F.when(n["label"].isNotNull() & n["query"].isNotNull(), F.struct(F.substring(F.trim(n["label"]), 1, LABEL).alias("label"), F.substring(F.trim(n["query"]), 1, QUERY).alias("query"), F.coalesce(F.substring(F.trim(n["reason_zh"]), 1, QUERY), F.lit("现有方向覆盖不足")).alias("reason_zh")))
    return F.struct(
        primary.alias("primary_direction"), F.slice(F.array_distinct(known), 1, SECONDARY).alias("secondary_directions"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(a["confidence"], F.lit(0.0)))).alias("confidence"),
        F.coalesce(F.substring(F.trim(a["reason_zh"]), 1, REASON), F.lit("分类依据不足")).alias("reason_zh"), F.slice(F.filter(F.coalesce(a["evidence_terms"], F.array().cast("array<string>")), lambda t: t.isNotNull()), 1, TERMS).alias("evidence_terms"), new.alias("new_direction"),
    )


def heuristic_classification(title: Column, abstract: Column, venue: Column) -> Column:
    """The local rules' answer: the first direction found, the next two, and .42 or 0 as confidence."""
    found = rel.heuristic_directions(title, abstract, venue)
    primary = F.get(found, 0)
    return F.struct(primary.alias("primary_direction"), F.slice(found, 2, 2).alias("secondary_directions"), F.when(primary.isNotNull(), 0.42).otherwise(0.0).alias("confidence"), F.slice(found, 1, TERMS).alias("evidence_terms"))


def normalize_summary(answer: Column) -> Column:
    """A model's summary (JSON text) with what it doesn't state named so, and three innovations at most."""
    a = F.coalesce(F.from_json(unfence_json(answer), "summary_zh string, innovations_zh array<string>, method_zh string, results_zh string, limitations_zh string"), F.from_json(F.lit("{}"), "summary_zh string, innovations_zh array<string>, method_zh string, results_zh string, limitations_zh string"))
    said = lambda c: F.coalesce(truthy(F.trim(a[c])), F.lit(NOT_STATED)).alias(c)
    new = F.slice(F.filter(F.transform(F.coalesce(a["innovations_zh"], F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: truthy(x).isNotNull()), 1, 3)  # F.trim itself would take the index as its second argument
    return F.struct(said("summary_zh"), F.when(F.size(new) > 0, new).otherwise(F.array(F.lit(NOT_STATED))).alias("innovations_zh"), said("method_zh"), said("results_zh"), said("limitations_zh"))


def publication_channel(venue: Column) -> Column:
    """Preprints by their server, everything else as reviewed."""
    return F.when(F.lower(F.coalesce(venue, F.lit(""))).rlike("arxiv|preprint|ssrn"), "arXiv 预印本").when(truthy(venue).isNull(), F.lit(None).cast("string")).otherwise("同行评议")


# ---------------------------------------------------------------- evidence
def _card(kind: str, label: str, content: Column, source: Column, confidence: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), F.lit(label).alias("label"), content.alias("content"), source.alias("source"), confidence.alias("confidence"))


#: Label, text without evidence, and its source for each kind of card after the first.
CARDS = (("method", "方法", "method_zh", "摘要未提供足够的方法细节", "论文摘要缺少结构化方法"), ("result", "实验结果", "results_zh", "暂无结构化结果证据", "尚未解析全文"), ("limitation", "局限性", "limitations_zh", "暂无结构化局限性证据", "尚未解析全文"))


def evidence_cards(c) -> Column:
    """Five cards from the cached fields of a paper; c(name) is a column (abstract, summary_zh, innovations_zh as JSON,
    method_zh, results_zh, limitations_zh)."""
    cached, have = F.lit("缓存的中文解读"), lambda n: truthy(c(n)).isNotNull()
    level = lambda ok: F.when(ok, "medium").otherwise("low")
    new = json_array(c("innovations_zh"))
    told = truthy(F.array_join(F.filter(new, lambda x: x != NOT_STATED), "；"))
    problem = _card("problem", "研究问题", F.coalesce(first_truthy(c("summary_zh"), c("abstract")), F.lit("暂无摘要证据")), F.when(have("summary_zh"), cached).otherwise("论文摘要"), level(have("abstract")))
    rest = {k: _card(k, label, F.coalesce(truthy(c(col)), F.lit(none)), F.when(have(col), cached).otherwise(without), level(have(col))) for k, label, col, none, without in CARDS}
    core = _card("innovation", "核心创新", F.coalesce(told, F.lit("暂无结构化创新点")), F.when(F.size(new) > 0, cached).otherwise("论文摘要"), level(F.size(new) > 0))
    return F.array(problem, rest["method"], core, rest["result"], rest["limitation"])


#: Where a section begins and ends, how much of it is shown, and the text without it.
SECTIONS = (
    ("problem", "研究问题", r"(?:introduction|abstract)[.:]?\s*(.{120,1000}?)(?:method|approach|2\s)", "全文未识别出明确研究问题", "medium"),
    ("method", "方法", r"(?:methodology|method|approach)[.:]?\s*(.{120,1200}?)(?:experiment|result|evaluation|3\s)", "全文未识别出方法章节", "medium"),
    ("innovation", "核心创新", r"(?:our contributions|we propose|contribution)[.:]?\s*(.{120,1200}?)(?:experiment|result|related work)", "全文未识别出贡献段落", "medium"),
    ("result", "实验结果", r"(?:experiments?|results?|evaluation)[.:]?\s*(.{120,1200}?)(?:conclusion|discussion|limitation)", "全文未识别出实验结果章节", "medium"),
    ("limitation", "局限性", r"(?:limitations?|failure cases?|discussion)[.:]?\s*(.{120,900}?)(?:conclusion|references)", "全文未识别出局限性章节", "low"),
)


def full_text_evidence(text: Column) -> Column:
    """Five cards from the first passage of a whole text that looks like each section."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.array(*[_card(k, label, F.coalesce(truthy(F.regexp_extract(flat, f"(?i){p}", 1)), F.lit(none)), F.lit("PDF 全文文本"), F.lit(level)) for k, label, p, none, level in SECTIONS])


# ---------------------------------------------------------------- projections
def reason(frontier: Column, tier: Column, classic: Column, prefix: str = "") -> Column:
    """Why a paper is shown, from its flags."""
    parts = F.concat_ws(" · ", F.when(frontier, "近期前沿"), F.when(tier >= 3, "顶会/顶刊"), F.when(classic, "经典必读"))
    return F.concat_ws(" · ", truthy(F.lit(prefix)), F.coalesce(truthy(parts), F.lit("方向精选")))


def full_paper(c, direction: Column, label: Column, score: Column, prefix: str = "") -> list[Column]:
    """Columns of a paper as the daily page shows it; missing values have the defaults of the page. c(name) is a column."""
    text, no = lambda n: F.coalesce(c(n), F.lit("")).alias(n), F.lit(False)
    number = lambda n: F.coalesce(c(n), F.lit(0)).alias(n)
    flag = lambda n: F.coalesce(c(n), no).alias(n)
    return [
        c("openalex_id").alias("id"), c("title").alias("title"), text("authors"), c("year").alias("year"), text("venue"), number("citations"), F.nullif(c("citation_percentile"), F.lit(0.0)).alias("citation_percentile"), text("abstract"),
        direction.alias("direction"), label.alias("direction_label"), F.array(F.struct(direction.alias("key"), label.alias("label"))).alias("directions"), c("doi").alias("doi"), c("pdf_url").alias("pdf_url"),
        F.coalesce(c("sources"), F.array().cast("array<string>")).alias("sources"), F.coalesce(c("publication_status"), F.lit("unknown")).alias("publication_status"), flag("venue_verified"), number("venue_confidence"), number("quality_score"),
        F.coalesce(c("venue_type"), F.lit("unknown")).alias("venue_type"), number("venue_tier"),
        sc.quality_label(F.coalesce(c("is_classic"), no), F.coalesce(c("venue_tier"), F.lit(0)), c("publication_status"), F.coalesce(c("venue_verified"), no)).alias("quality_label"),
        flag("is_frontier"), flag("is_classic"), reason(F.coalesce(c("is_frontier"), no), F.coalesce(c("venue_tier"), F.lit(0)), F.coalesce(c("is_classic"), no), prefix).alias("discovery_reason"), score.alias("recommendation_score"),
        F.struct(flag("is_read"), flag("is_saved"), flag("is_hidden")).alias("user_state"),
    ]


def compact_paper(local, external, relation: str, score: Column, is_local: bool) -> list[Column]:
    """One short shape for own and external papers: the first value that is there. local(name) and external(name) are columns."""
    pick = lambda a, b, d=None: F.coalesce(truthy(local(a)), truthy(external(b)), *([F.lit(d)] if d is not None else []))
    return [
        pick("openalex_id", "id").alias("id"), pick("title", "title").alias("title"), pick("authors", "authors", "").alias("authors"), F.coalesce(F.nullif(local("year"), F.lit(0)), external("publication_year")).alias("year"), pick("venue", "venue", "").alias("venue"),
        F.coalesce(local("citations"), external("cited_by_count"), F.lit(0)).alias("citations"), pick("abstract", "abstract", "").alias("abstract"), normalize_doi(pick("doi", "doi")).alias("doi"), pick("pdf_url", "oa_url").alias("pdf_url"),
        F.lit(relation).alias("relation"), score.alias("score"), F.lit(is_local).alias("local"),
    ]


def directions_of(links: Column, primary: Column) -> Column:
    """The linked directions; the primary one where there is no link."""
    return F.when(F.size(F.coalesce(links, F.array().cast("array<string>"))) > 0, links).otherwise(F.filter(F.array(truthy(primary)), lambda x: x.isNotNull()))


def reader_body(markdown: Column) -> Column:
    """What the reader shows: from the first section heading on, without title, source line and rules, and one-line
    display formulas on lines of their own."""
    m = F.regexp_replace(F.coalesce(markdown, F.lit("")), r"(?m)^#\s+.*$|^>\s*(?:来源|Source)[:：].*$|^\s*---\s*$", "")
    m = F.when(m.rlike(r"(?m)^#{2,6}\s"), F.regexp_replace(m, r"(?s)\A.*?(?=(?:\A|\n)#{2,6}\s)", "")).otherwise(m)
    return F.trim(F.regexp_replace(m, r"(?m)^\s*\$\$([^\n$]+)\$\$\s*$", "\n\\$\\$\n$1\n\\$\\$\n"), F.lit("\n"))


# ---------------------------------------------------------------- prompts
def classification_prompt(title: Column, abstract: Column, venue: Column, directions: Sequence[tuple[str, str]]) -> Column:
    listed = "\n".join(f"- {k}: {label}" for k, label in directions)
    head = f"Assign the paper to these research directions (answer with their keys):\n{listed}\nAnswer with one JSON object: primary_direction, secondary_directions, confidence, reason_zh, evidence_terms, new_direction.\n"
    empty = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(F.lit(head), F.lit("Title: "), empty(title), F.lit("\nVenue: "), empty(venue), F.lit("\nAbstract: "), empty(abstract))


def summary_prompt(title: Column, abstract: Column) -> Column:
    head = "Summarise the paper in Chinese from its abstract alone; say 摘要未说明 for what it doesn't state. Answer with one JSON object: summary_zh, innovations_zh (at most three), method_zh, results_zh, limitations_zh.\n"
    return F.concat(F.lit(head), F.lit("Title: "), F.coalesce(title, F.lit("")), F.lit("\nAbstract: "), F.coalesce(abstract, F.lit("")))


def unknown_tokens(text: Column, known: Column) -> Column:
    """Protected tokens in a text that were never given out."""
    return F.array_except(F.regexp_extract_all(text, F.lit(r"\[\[PL_[A-Z]+_\d{6}\]\]"), F.lit(0)), known)
