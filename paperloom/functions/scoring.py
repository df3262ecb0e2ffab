"""Scores over dates, citations and venues. Every "now" is a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weight of each user event.
EVENT_WEIGHTS = (("save", 3.0), ("library_import", 2.0), ("read", 1.0), ("unsave", -3.0), ("unread", -1.0), ("hide", -4.0), ("unhide", 4.0))
#: Venue labels by tier, best first.
VENUE_TIERS = (
    (3, ("neurips", "nips", "icml", "iclr", "cvpr", "iccv", "eccv", "corl", "rss", "icra", "iros", "cdc", "acc", "aamas", "aaai", "ijcai", "uai", "kdd", "t-ro", "transactions on robotics", "t-its", "transactions on intelligent vehicles")),
    (2, ("iv", "intelligent vehicles", "itsc", "its world congress", "ral", "ra-l", "robotics and automation letters", "t-ase", "t-cyb", "t-rob", "pattern recognition", "ijcv", "jmlr", "tmlr")),
    (1, ("arxiv", "technical report", "workshop", "symposium", "conference", "journal")),
)
#: Labels of conferences, as substrings and as whole tokens.
CONFERENCES = ("conference", "cvpr", "iccv", "eccv", "neurips", "nips", "icml", "iclr", "corl", "icra", "iros", "aaai", "ijcai", "itsc")
CONFERENCE_TOKENS = ("rss", "cdc", "acc", "iv", "uai", "kdd")


def _label_pattern(label: str) -> str:
    quoted = label.replace("-", "\\-")
    return quoted if len(label) > 3 else f"(^|[^a-z0-9]){quoted}([^a-z0-9]|$)"


def venue_value(venue: Column, channel: Column) -> Column:
    return F.trim(F.lower(F.concat(F.coalesce(venue, F.lit("")), F.lit(" "), F.coalesce(channel, F.lit("")))))


def venue_type(venue: Column, channel: Column) -> Column:
    v = venue_value(venue, channel)
    named = v.rlike("|".join([*CONFERENCES, *map(_label_pattern, CONFERENCE_TOKENS)]))
    return F.when(v.rlike("arxiv|preprint"), "preprint").when(named, "conference").when(v.rlike("journal|transactions|letters|tmlr|jmlr"), "journal").otherwise("unknown")


def venue_tier(venue: Column, channel: Column) -> Column:
    v, out = venue_value(venue, channel), F.lit(0)
    for tier, labels in reversed(VENUE_TIERS):
        out = F.when(v.rlike("|".join(map(_label_pattern, labels))), F.lit(tier)).otherwise(out)
    return out


def publication_status(venue: Column, channel: Column) -> Column:
    v, kind = venue_value(venue, channel), venue_type(venue, channel)
    known = (venue_tier(venue, channel) > 0) | kind.isin("conference", "journal")
    return F.when(F.contains(v, F.lit("workshop")), "workshop").when(kind == "preprint", "preprint").when(known, "published").otherwise("unknown")


def citation_quality(citations: Column, percentile: Column) -> Column:
    share = F.when(percentile > 1, percentile / 100).otherwise(percentile)
    return F.when(percentile.isNotNull(), F.greatest(F.lit(0.0), F.least(share, F.lit(1.0)))).otherwise(F.least(F.log10(F.coalesce(citations, F.lit(0)) + 1) / 4, F.lit(1.0)))


def is_frontier(year: Column, published: Column, as_of: Column) -> Column:
    """published: date. Within 24 months, or (without a date) in one of the last three calendar years."""
    return F.coalesce(F.when(published.isNotNull(), published >= F.add_months(as_of, -24)).otherwise(year >= F.year(as_of) - 2), F.lit(False))


def recommendation_score(frontier: Column, classic: Column, year: Column, tier: Column, impact: Column, as_of: Column) -> Column:
    age = F.greatest(F.lit(0), F.year(as_of) - F.coalesce(F.nullif(year, F.lit(0)), F.year(as_of)))
    recency = F.when(frontier, F.lit(1.0)).otherwise(F.exp(-0.24 * age))
    return 0.42 * recency + 0.25 * F.least(F.greatest(tier, F.lit(0)) / 3, F.lit(1.0)) + 0.18 * impact + 0.15 * classic.cast("double")


def recency_score(year: Column, published: Column, as_of: Column) -> Column:
    """exp(-months / 30) with months of 30.4 days; a year stands for its last day; 0 without either."""
    date = F.coalesce(published, F.make_date(F.nullif(year, F.lit(0)), F.lit(12), F.lit(31)))
    months = F.greatest(F.lit(0.0), F.datediff(as_of, date) / 30.4)
    return F.when(date.isNull(), 0.0).otherwise(F.exp(-months / 30))


def event_weight(event: Column) -> Column:
    out = F.lit(0.0)
    for name, w in EVENT_WEIGHTS:
        out = F.when(event == name, F.lit(w)).otherwise(out)
    return out


def decayed_event_weight(event: Column, created_at: Column, as_of: Column) -> Column:
    days = (F.unix_micros(as_of) - F.unix_micros(F.coalesce(created_at, as_of))) / 86_400_000_000
    return event_weight(event) * F.exp(-F.greatest(F.lit(0.0), days) / 90)


def direction_weight(configured: Column, preference: Column) -> Column:
    """Configured unless 0 or missing, else min(2, 1 + preference / 10), else 1."""
    return F.coalesce(F.nullif(configured, F.lit(0.0)), F.when(preference.isNotNull(), F.least(F.lit(2.0), 1 + preference / 10)), F.lit(1.0))


def daily_score(base, recency, tier, impact, relevance, read, shown, weight) -> Column:
    mix = 0.3 * base + 0.26 * recency + 0.18 * (tier / 3) + 0.1 * impact + 0.16 * relevance
    return (mix + F.when(read, -0.1).otherwise(0.08) + F.when(shown, -0.25).otherwise(0.0)) * (0.85 + 0.15 * weight)


def discovery_reason(classic: Column, frontier: Column, tier: Column) -> Column:
    return F.when(classic, "经典必读").when(frontier & (tier >= 3), "顶会前沿").when(frontier, "近两年前沿").when(tier >= 3, "高质量基础").otherwise("方向相关")


def quality_label(classic: Column, tier: Column, status: Column, verified: Column) -> Column:
    return (
        F.when(classic, "经典必读").when((tier >= 3) & (status == "published"), "顶会/顶刊").when((tier >= 2) & (status == "published"), "高质量发表")
        .when((status == "preprint") & (verified | (tier >= 1)), "高质量预印本").when(status == "workshop", "Workshop").otherwise("方向相关")
    )


def venue_confidence(venue: Column, sources: Column, kind: Column) -> Column:
    has = lambda s: F.array_contains(sources, s)
    known = kind != "unknown"
    return F.when(F.coalesce(venue, F.lit("")) == "", 0.0).when(has("Curated classics"), 1.0).when(has("Crossref") & known, 0.95).when(has("OpenAlex") & known, 0.85).when(known, 0.6).otherwise(0.25)


def legacy_score(weight: Column, citations: Column, rank: Column, year: Column, this_year: int = 2026) -> Column:
    """this_year: the year that ages are counted from (a fixed value of the stored scores unless given)."""
    factor = F.when(rank == "A", 1.5).when(rank == "B", 1.2).when(rank == "C", 1.0).otherwise(0.7)
    recency = F.when(year.isNull(), 0.5).otherwise(F.exp(-0.15 * (this_year - year)))
    return weight * F.log10(F.coalesce(citations, F.lit(0)) + 1) * factor * recency


def cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors, different lengths or a zero norm."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def hybrid_score(semantic: Column, lexical: Column, prior: Column, has_vector: bool = True) -> Column:
    return 0.6 * F.greatest(semantic, F.lit(0.0)) + 0.25 * lexical + 0.15 * prior if has_vector else 0.8 * lexical + 0.2 * prior


def match_score(base: Column, match: Column, saved: Column, read: Column) -> Column:
    return base * (0.65 + 0.35 * match) + F.when(saved, 0.08).otherwise(0.0) - F.when(read, 0.02).otherwise(0.0)


def bbox_crop(bbox: Column, page_height: Column, dpi: int = 180) -> Column:
    """PDF box (points, y up: left, top, right, bottom) to pixels from the top left."""
    k = dpi / 72
    x, y = F.floor(F.least(bbox[0], bbox[2]) * k), F.floor((page_height - F.greatest(bbox[1], bbox[3])) * k)
    return F.struct(F.greatest(x, F.lit(0)).alias("x"), F.greatest(y, F.lit(0)).alias("y"), F.greatest(F.ceil(F.abs(bbox[2] - bbox[0]) * k), F.lit(1)).alias("width"), F.greatest(F.ceil(F.abs(bbox[1] - bbox[3]) * k), F.lit(1)).alias("height"))
