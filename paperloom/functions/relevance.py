"""Topical relevance of a paper to a research direction."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.matching import signals

#: Terms of the built-in directions.
DIRECTION_TERMS = {
    "e2e": ("autonomous driving", "self-driving", "autonomous vehicle", "driverless", "end-to-end driving", "uniad", "sparsedrive", "carla", "nuscenes", "waymo"),
    "planning": ("autonomous driving", "self-driving", "motion planning", "trajectory planning", "path planning", "model predictive control", "vehicle trajectory", "robot motion planning"),
    "world_model": ("driving world model", "autonomous driving", "world model", "video prediction", "embodied ai", "robotics simulation", "carla"),
    "llm_driving": ("autonomous driving", "self-driving", "vehicle", "driving", "vision-language", "large language model", "llm", "embodied ai", "robotics"),
    "control": ("vehicle control", "autonomous driving", "path tracking", "trajectory tracking", "model predictive control", "lane keeping", "steering control", "robot control"),
    "perception": ("autonomous driving", "self-driving", "3d object detection", "bird's-eye view", "bev", "lidar", "camera perception", "autonomous vehicle", "nuscenes"),
    "prediction": ("autonomous driving", "self-driving", "trajectory prediction", "motion forecasting", "vehicle trajectory", "pedestrian trajectory", "autonomous vehicle"),
    "rl_driving": ("autonomous driving", "self-driving", "reinforcement learning driving", "autonomous vehicle", "robotics", "vehicle control"),
    "racing": ("autonomous racing", "racing car", "driverless", "formula student", "vehicle dynamics", "high-speed autonomous", "racing line"),
    "safety": ("autonomous driving", "self-driving safety", "vehicle safety", "safe autonomous driving", "autonomous vehicle", "v2x", "uncertainty", "verification"),
}
#: Hints of the domain in a custom direction, and in a paper of one.
DOMAIN_HINTS = ("自动驾驶", "无人驾驶", "车辆", "汽车", "驾驶", "robot", "robotics", "autonomous", "driving", "vehicle", "self-driving")
CUSTOM_EXTRA = ("hallucination", "幻觉", "uncertainty", "不确定性", "safety", "安全", "control", "控制", "perception", "感知")
#: Patterns of the domain, of robotics, of racing and of other fields (\b is a border of ASCII words).
AUTONOMY = (
    r"autonomous.{0,40}(driving|vehicle|car|urban|system)",
    r"(driving|vehicle|car|urban|system).{0,40}autonomous",
    r"self[- ]driving",
    r"automated.{0,30}(driving|vehicle)",
    r"driverless",
    r"intelligent.{0,20}vehicles?",
    r"road.{0,20}vehicles?",
    r"vehicles?.{0,40}(control|planning|trajectory|motion|dynamics|perception|detection|forecast|prediction|tracking|steering)",
    r"(control|planning|trajectory|motion|dynamics|perception|detection|forecast|prediction|tracking|steering).{0,40}vehicles?",
    r"carla|nuscenes|waymo|lidar|bird.?s[- ]eye|\bbev\b|\bv2x\b|\bslam\b",
)
ROBOTICS = (r"robotics?", r"embodied ai", r"quadrotor", r"drone", r"\buav\b")
RACING = (r"autonomous racing", r"racing car", r"driverless", r"formula student", r"vehicle dynamics", r"high[- ]speed autonomous", r"racing line")
OFF_DOMAIN = (
    r"\b(cancer|tumou?r|patient|clinical trial|pharmacy|drug discovery|protein|genome|medical imaging|disease diagnosis)\b",
    r"\b(quantum computing|quantum chemistry|climate change|crop yield|agriculture|financial market|stock prediction)\b",
    r"肺癌|肿瘤|患者|临床试验|药物发现|蛋白质|基因组|医学影像|疾病诊断|量子计算|气候变化|农业|股票预测",
)
#: Rules of the local classifier, in order.
CLASSIFIER = (
    ("e2e", r"end[- ]to[- ]end|unified driving|planning-oriented autonomous driving|directly.*(control|trajectory)"),
    ("planning", r"motion planning|trajectory planning|path planning|model predictive control"),
    ("world_model", r"world model|video prediction|predictive model|latent dynamics"),
    ("llm_driving", r"large language model|\bllm\b|vision-language|multimodal language"),
    ("control", r"vehicle control|path tracking|trajectory tracking|steering control"),
    ("perception", r"bird.?s[- ]eye|\bbev\b|3d object detection|lidar perception"),
    ("prediction", r"trajectory prediction|motion forecasting|behavior prediction"),
    ("rl_driving", r"reinforcement learning|deep rl|policy optimization"),
    ("racing", r"autonomous racing|racing car|formula student"),
    ("safety", r"safety verification|safe autonomous|uncertainty|hallucination|幻觉|安全"),
)


#: Words that are an anchor in the domain beside its patterns, for the score and for the gate.
SCORE_ANCHOR = "autonomous driving|driverless|vehicle control|驾驶|自动驾驶|无人车"
GATE_ANCHOR = "autonomous driving|driverless|road vehicle|vehicle control|驾驶|自动驾驶|无人车"

#: Every pattern of relevance by the name of its group (names begin with a colon, which no term does).
GROUPS = ((":autonomy", AUTONOMY), (":score", (SCORE_ANCHOR,)), (":gate", (GATE_ANCHOR,)), (":robotics", ROBOTICS), (":racing", RACING), (":off", OFF_DOMAIN))
BUILT_IN = tuple(sorted({t for ts in DIRECTION_TERMS.values() for t in ts} | {*DOMAIN_HINTS, *CUSTOM_EXTRA}))


def paper_text(*parts: Column) -> Column:
    return F.lower(F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts]))


def direction_terms(key: str, label: str = "", query: str = "") -> list[str]:
    import re

    return list(DIRECTION_TERMS.get(key) or [t for t in re.split("[^a-z0-9一-鿿]+", f"{label} {query}".lower()) if len(t) >= 2])


def vocabulary(directions: Iterable[tuple[str, str, str]]) -> tuple[str, ...]:
    """The built-in terms and those of directions (key, label, query): given to all judgements of a projection, they
    share one pass over the text."""
    return tuple(sorted({*BUILT_IN, *(t for d in directions for t in direction_terms(*d))}))


def _any_of(found: Column, names: Iterable[str]) -> Column:
    return F.arrays_overlap(found, F.array(*map(F.lit, sorted(set(names)))))


def relevance_score(title: Column, abstract: Column, venue: Column, key: str, label: str = "", query: str = "", terms: tuple[str, ...] = ()) -> Column:
    """Coverage of the direction's terms, their place in the title and an anchor in the domain, from 0 to 1.

    terms: the vocabulary of all directions that are judged together."""
    own = direction_terms(key, label, query)
    every = terms or vocabulary([(key, label, query)])
    found, head = signals(paper_text(title, abstract, venue), every, GROUPS), signals(F.lower(F.coalesce(title, F.lit(""))), every)
    hits = lambda where: sum((F.array_contains(where, t).cast("int") for t in own), F.lit(0))
    anchor = _any_of(found, (":autonomy", ":score"))
    cover = F.least(F.lit(1.0), hits(found) / max(1, min(len(own), 4))) if own else F.lit(0.5)
    signal = F.least(F.lit(1.0), hits(head) / max(1, min(len(own), 2))) if own else F.lit(0.5)
    score = 0.35 * cover + 0.25 * signal + F.when(anchor, 0.3).otherwise(0.05) - F.when(F.array_contains(found, ":off") & ~anchor, 0.55).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def is_likely_relevant(title: Column, abstract: Column, venue: Column, key: str, label: str = "", query: str = "", terms: tuple[str, ...] = ()) -> Column:
    found = signals(paper_text(title, abstract, venue), terms or vocabulary([(key, label, query)]), GROUPS)
    off = F.array_contains(found, ":off") & ~_any_of(found, (":autonomy", ":gate"))
    if key in DIRECTION_TERMS:
        more = (":racing",) if key == "racing" else (":autonomy",) if key in ("e2e", "perception", "prediction") else (":robotics", ":autonomy")
        return ~off & _any_of(found, (*DIRECTION_TERMS[key], *more))
    if not any(h in f"{label} {query}".lower() for h in DOMAIN_HINTS):
        return ~off
    return ~off & _any_of(found, (*DOMAIN_HINTS, *CUSTOM_EXTRA, ":autonomy"))


def heuristic_directions(title: Column, abstract: Column, venue: Column) -> Column:
    """Keys of the rules that fit, in order: the first is primary, the next two secondary."""
    text = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(abstract, F.lit("")), F.coalesce(venue, F.lit(""))))
    return signals(text, (), tuple((k, (p,)) for k, p in CLASSIFIER))
