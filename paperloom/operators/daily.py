"""Daily recommendations: scored candidates per direction, greedy picks, neighbouring directions, and the day's snapshot."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions import relevance as rel
from paperloom.functions import scoring as sc
from paperloom.functions.matching import rejected
from paperloom.operators import relational as ra
from paperloom.operators.records import parse_date, with_metadata
from paperloom.operators.stored import Files

#: Least relevance of a pick that is no classic, days for which a shown paper counts as shown.
LEAST_RELEVANCE, SHOWN_DAYS = 0.22, 3
WINDOWS = ("all", "7d", "30d", "1y", "classic")
MOST_DIRECTIONS, MOST_RULES = 8, 10_000


def per_direction(limit) -> int:
    """One or two; two where it is no number."""
    try:
        return max(1, min(2, int(limit)))
    except (TypeError, ValueError):
        return 2


def in_window(papers: DataFrame, window: str, today: Column) -> DataFrame:
    """Papers of the last 7 or 30 days or year (without a date: of its calendar year), or classics; all otherwise."""
    if window == "classic":
        return papers.where("is_classic")
    start = {"7d": F.date_sub(today, 7), "30d": F.date_sub(today, 30), "1y": F.add_months(today, -12)}.get(window)
    return papers if start is None else ra.since(papers.withColumn("_date", parse_date(F.col("published_date"))), start, "_date").drop("_date")


def candidates(
    papers: DataFrame, links: DataFrame, state: DataFrame, history: DataFrame, rules: DataFrame, as_of: str, directions: Mapping[str, tuple[str, str]], weights: Mapping[str, float], window: str = "all", n: int = 2
) -> DataFrame:
    """(direction, paper_id, score, relevance, is_saved, year, recently_shown) of all papers that may be picked.

    directions: key to (label, query). Relevance and rules are looked up in the texts before anything is joined, so that
    only narrow rows are shuffled. A paper shown in the last days counts only if a direction has fewer than n others.
    """
    today = F.lit(as_of).cast("date")
    listed = [tuple(r) for r in ra.few(rules.select("direction", "term", "mode").distinct(), MOST_RULES)]
    p = in_window(with_metadata(ra.visible(papers), today), window, today)
    text, terms = [F.col(c) for c in ("title", "abstract", "venue")], rel.vocabulary((k, *v) for k, v in directions.items())
    judged = [x for k, (label, query) in directions.items() for x in (F.lit(k), rel.relevance_score(*text, k, label, query, terms))]
    broken = rejected(rel.paper_text(*text), listed, list(directions)) if listed else F.array().cast("array<string>")
    p = p.select(
        F.col("id").alias("paper_id"), "year", "is_classic", "recommendation_score", "venue_tier", sc.recency_score(F.col("year"), parse_date(F.col("published_date")), today).alias("recency"),
        sc.citation_quality(F.col("citations"), F.col("citation_percentile")).alias("impact"), F.create_map(*judged).alias("judged"), broken.alias("broken"),
    )
    c = p.join(ra.visible(links).where(F.col("direction").isin(list(directions))).select("paper_id", "direction").distinct(), "paper_id")
    c = c.withColumn("relevance", F.col("judged")[F.col("direction")]).where(~F.array_contains("broken", F.col("direction")) & ((F.col("relevance") >= LEAST_RELEVANCE) | F.col("is_classic")))
    c = c.join(state.select("paper_id", "is_read", "is_saved", "is_hidden"), "paper_id", "left").where(~F.coalesce("is_hidden", F.lit(False)))
    shown = history.where((F.col("shown_on") >= F.date_sub(today, SHOWN_DAYS)) & (F.col("shown_on") < today)).select("paper_id", F.lit(True).alias("_shown")).distinct()
    c = c.join(shown, "paper_id", "left").withColumn("recently_shown", F.col("_shown").isNotNull())
    weight = F.coalesce(F.create_map(*[F.lit(x) for k in directions for x in (k, float(weights.get(k) or 1.0))])[F.col("direction")], F.lit(1.0))
    tier = F.least(F.greatest(F.col("venue_tier"), F.lit(0)), F.lit(3))
    score = sc.daily_score(F.col("recommendation_score"), F.col("recency"), tier, F.col("impact"), F.col("relevance"), F.coalesce("is_read", F.lit(False)), F.col("recently_shown"), weight)
    c = c.select("direction", "paper_id", F.round(score, 6).alias("score"), F.round("relevance", 6).alias("relevance"), F.coalesce("is_saved", F.lit(False)).alias("is_saved"), F.coalesce("year", F.lit(0)).alias("year"), "recently_shown")
    return ra.fresh_or_all(c, ["direction"], "recently_shown", n)


def pick(scored: DataFrame, personal: Sequence[str], explore: Sequence[str], n: int) -> DataFrame:
    """(kind, direction, paper_id, rank, score, shown): n papers per personal direction, none twice, then one or two
    (a fifth of the personal ones) from the first neighbouring directions that have any.

    All picks are kept; shown marks those within the limit of the neighbours. The rows that can matter, a fixed number
    per direction, are walked on the driver.
    """
    spark, every = scored.sparkSession, [*personal, *explore]
    order = [F.desc("is_saved"), F.desc("score"), F.desc("year"), F.col("paper_id")]
    few = ra.top_n(scored, ["direction"], order, n * len(personal) + 2 * len(explore), "_r")
    by: dict[str, list] = {}
    for r in sorted(few.select("direction", "_r", "paper_id", "score").collect(), key=lambda r: r["_r"]):
        by.setdefault(r["direction"], []).append((r["paper_id"], r["score"]))
    taken: set = set()

    def choose(direction: str, limit: int) -> list:
        got = [x for x in by.get(direction, []) if x[0] not in taken][:limit]
        taken.update(i for i, _ in got)
        return got

    out = [("personal", d, i, k, s, True) for d in personal for k, (i, s) in enumerate(choose(d, n))]
    limit, found = min(2, max(1, int(len(out) * 0.2 + 0.5))), 0
    for d in explore:
        if found >= limit:
            break
        for k, (i, s) in enumerate(choose(d, limit)):
            out.append(("exploration", d, i, k, s, found < limit))
            found += 1
    assert len(every) >= len(by)
    return spark.createDataFrame(out, "kind string, direction string, paper_id long, rank int, score double, shown boolean")


def neighbours_of(chosen: Sequence[str], edges: Sequence[tuple[str, str]], disabled: Sequence[str] = ()) -> list[str]:
    """Neighbours of the chosen directions in order of first sight, without chosen and disabled ones."""
    near = [b for d in chosen for a, b in edges if a == d]
    return [d for d in dict.fromkeys(near) if d not in chosen and d not in disabled]


def choose_directions(requested: Sequence[str], configured: Sequence[tuple[str, float, bool]], behaviour: Sequence[tuple[str, float]]) -> tuple[list[str], dict[str, float]]:
    """The directions of the day and their weights: requested ones, else active configured ones, else those that
    behaviour prefers (eight at most). configured: (direction, weight, active), heaviest first; behaviour: best first."""
    off = {d for d, _, active in configured if not active}
    active, liked = [d for d, _, on in configured if on], dict(behaviour)
    keys = list(requested) or active[:MOST_DIRECTIONS] or [d for d, _ in behaviour if d not in off][:MOST_DIRECTIONS]
    given = {d: w for d, w, _ in configured}
    return keys, {d: given.get(d) or (min(2.0, 1 + liked[d] / 10) if d in liked else 1.0) for d in keys}


# ---------------------------------------------------------------- the day's snapshot
class Snapshots:
    """Picks of a day and window, written once: the first call of a day computes them, later ones read them.

    Picks are written to a folder of their own; then a file that names it is created, which one writer can do. Of callers
    that compute at the same time all but one drop what they wrote and read the winner's."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files = spark, Files(spark, root)

    def _folder(self, day: str, window: str) -> str | None:
        name = self.files.read(f"day={day}/window={window}/current")
        return f"day={day}/window={window}/{name}" if name else None

    def _read(self, folder: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.files.root}/{folder}")

    def of(self, day: str, window: str, compute) -> DataFrame:
        if (known := self._folder(day, window)) is None:
            name = f"picks-{uuid.uuid4().hex}"
            mine = f"day={day}/window={window}/{name}"
            compute().write.parquet(f"{self.files.root}/{mine}")
            if not self.files.create(f"day={day}/window={window}/current", name):
                self.files.delete(mine)
            known = self._folder(day, window)
        return self._read(known)

    def forget(self, day: str, paper_id: int | None = None) -> None:
        """The day's snapshots go, or only those rows of theirs that show the paper."""
        for window in WINDOWS:
            folder = self._folder(day, window)
            if folder is None:
                continue
            if paper_id is None:
                self.files.delete(f"day={day}/window={window}")
                continue
            name = f"picks-{uuid.uuid4().hex}"
            self._read(folder).where(F.col("paper_id") != paper_id).write.parquet(f"{self.files.root}/day={day}/window={window}/{name}")
            self.files.replace(f"day={day}/window={window}/current", name)
            self.files.delete(folder)


def show_snapshot(snapshot: DataFrame, papers: DataFrame, links: DataFrame, state: DataFrame) -> DataFrame:
    """A snapshot's rows whose papers and links are still visible, with titles and state, in the order of sections."""
    p = ra.visible(papers).select(F.col("id").alias("paper_id"), "title")
    j = snapshot.join(p, "paper_id").join(ra.visible(links).select("paper_id", "direction").distinct(), ["paper_id", "direction"], "left_semi")
    j = j.join(state.select("paper_id", "is_saved", "is_hidden"), "paper_id", "left").where(~F.coalesce("is_hidden", F.lit(False)))
    return j.withColumn("is_saved", F.coalesce("is_saved", F.lit(False))).orderBy("kind", "direction", F.desc("is_saved"), "rank")


def add_history(history: DataFrame, picks: DataFrame, day: str) -> DataFrame:
    new = picks.select("paper_id", "direction", F.lit(day).cast("date").alias("shown_on"))
    return ra.insert_missing(history, new, ["paper_id", "direction", "shown_on"])


def digest(picks: DataFrame, explored: str = "Exploration") -> DataFrame:
    """(section, position, markdown) of picks(kind, direction_label, rank, id, title, year, pdf_url): one section a
    direction, in the order of labels, and one after them for everything explored, whatever its direction.

    Lines stand in the order of rank, then id, and are numbered. A pick without a title or label has none in its line or
    heading; one without a PDF is not linked. No picks make no sections."""
    free = F.col("kind") == "exploration"
    title = F.coalesce("title", F.lit(""))
    named = F.when(F.coalesce("pdf_url", F.lit("")) != "", F.concat(F.lit("["), title, F.lit("]("), F.col("pdf_url"), F.lit(")"))).otherwise(title)
    line = F.concat(named, F.coalesce(F.concat(F.lit(" ("), F.col("year").cast("string"), F.lit(")")), F.lit("")))
    p = picks.select(F.when(free, F.lit(explored)).otherwise(F.coalesce("direction_label", F.lit(""))).alias("section"), free.alias("_last"), "rank", "id", line.alias("line"))
    lines = p.groupBy("section", "_last").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "line"))).alias("l"))
    body = F.array_join(F.transform("l", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["line"])), "\n")
    out = lines.select("section", "_last", F.concat(F.lit("## "), "section", F.lit("\n\n"), body).alias("markdown"))
    return out.select("section", F.row_number().over(Window.orderBy("_last", "section")).alias("position"), "markdown")
