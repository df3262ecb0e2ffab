"""The engine's entry points over its tables: search, related papers, recommendations, daily picks, feedback, evaluation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import cards, providers
from paperloom.functions import scoring as sc
from paperloom.functions import text as tx
from paperloom.operators import daily as dy
from paperloom.operators import library as lib
from paperloom.operators import relational as ra
from paperloom.operators.records import with_metadata
from paperloom.sources.curated import DIRECTIONS, neighbours

VIEWS = ("all", "frontier", "classic")
#: The event names, with the flag that each sets.
FLAGS = {"read": ("is_read", True), "unread": ("is_read", False), "save": ("is_saved", True), "unsave": ("is_saved", False), "hide": ("is_hidden", True), "unhide": ("is_hidden", False)}


def clamp(value, low, high):
    return max(low, min(high, value))


@dataclass
class Library:
    """Tables by name: papers, paper_directions, paper_user_events, feedback, rules, direction_preferences, history."""

    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def t(self, name: str) -> DataFrame:
        return self.tables[name]

    # ------------------------------------------------------------ reading
    def user_state(self) -> DataFrame:
        """Flags per paper: the last event that sets a flag wins."""
        e, aggs = self.t("paper_user_events"), []
        for flag in ("is_read", "is_saved", "is_hidden"):
            names = [n for n, (f, _) in FLAGS.items() if f == flag]
            on = [n for n in names if FLAGS[n][1]]
            last = F.max_by(F.col("event").isin(on), F.when(F.col("event").isin(names), F.struct("created_at", "id")))
            aggs.append(F.coalesce(last, F.lit(False)).alias(flag))
        return e.where(F.col("event").isin(list(FLAGS))).groupBy("paper_id").agg(*aggs)

    def _with_state(self, papers: DataFrame, key: str = "id") -> DataFrame:
        s = self.user_state().withColumnRenamed("paper_id", "_p")
        j = papers.join(s, papers[key] == s["_p"], "left").drop("_p")
        return j.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("is_read", "is_saved", "is_hidden")})

    def paper_detail(self, paper_id: int) -> DataFrame:
        links = self.t("paper_directions").where(F.col("paper_id") == paper_id).groupBy("paper_id").agg(F.array_sort(F.collect_set("direction")).alias("directions"))
        p = self._with_state(self.t("papers").where(F.col("id") == paper_id))
        return p.join(links.withColumnRenamed("paper_id", "id"), "id", "left")

    def search_papers(self, query: str = "", direction: str | None = None, view: str = "all", vector: DataFrame | None = None, limit: int = 100, as_of=None) -> DataFrame:
        """Visible papers; scored by vector, words and prior if there is a query, else by saved, score, year, citations.
        vector: one row q. Links are joined after the limit."""
        p = self._with_state(ra.visible(self.t("papers"))).where(~F.col("is_hidden"))
        if direction and direction != "all":
            p = p.join(self.t("paper_directions").where(F.col("direction") == direction).select(F.col("paper_id").alias("id")), "id", "left_semi")
        if view not in VIEWS:
            raise ValueError(f"view is one of {VIEWS}")
        now = F.coalesce(F.lit(as_of).cast("date"), F.current_date())
        p = with_metadata(p, now).withColumnRenamed("recommendation_score", "prior")
        if view != "all":
            p = p.where(f"is_{view}")
        if query:
            lex = tx.lexical_score(F.concat_ws(" ", "title", "abstract", "venue"), F.lit(query))
            if vector is not None and "embedding" in p.columns:
                p = p.join(F.broadcast(vector.limit(1)))
                score = sc.hybrid_score(F.coalesce(sc.cosine(F.col("embedding"), F.col("q")), F.lit(0.0)), lex, F.col("prior"))
            else:
                score = sc.hybrid_score(F.lit(0.0), lex, F.col("prior"), has_vector=False)
            p = p.withColumn("score", F.round(score, 6)).where("score > 0").orderBy(F.desc("is_saved"), F.desc("score"), "id")
        else:
            p = p.withColumn("score", F.round("prior", 6)).orderBy(F.desc("is_saved"), F.desc("score"), F.desc("is_frontier"), F.desc(F.coalesce("year", F.lit(0))), F.desc(F.coalesce("citations", F.lit(0))), "id")
        top = p.limit(clamp(limit, 1, 100))
        links = self.t("paper_directions").groupBy(F.col("paper_id").alias("id")).agg(F.array_sort(F.collect_set("direction")).alias("directions"))
        return top.join(links, "id", "left").select("id", "title", "year", "citations", "is_saved", "is_read", "score", F.coalesce("directions", F.array().cast("array<string>")).alias("directions"))

    def related_papers(self, paper_id: int, limit: int = 8) -> DataFrame:
        """By .8 vector and .2 words; candidates are the first 300 by id that share a direction with the paper."""
        hidden = self.user_state().where("is_hidden").select(F.col("paper_id").alias("id"))
        p = self.t("papers")
        found = ra.related(p, self.t("paper_directions"), hidden, p.select("id", "embedding"), paper_id, limit=limit)
        return found.join(p.select("id", "title"), "id").select("id", "title", "score").orderBy(F.desc("score"), "id")

    def recommend(self, directions: Sequence[str] = (), limit: int = 20, as_of=None) -> DataFrame:
        links = self.t("paper_directions")
        n = max(1, len(directions))
        hit = links.where(F.col("direction").isin(list(directions))).groupBy(F.col("paper_id").alias("id")).agg((F.count_distinct("direction") / n).alias("match")) if directions else None
        p = self._with_state(ra.visible(self.t("papers"))).where(~F.col("is_hidden"))
        p = p.join(hit, "id", "left") if hit is not None else p.withColumn("match", F.lit(1.0))
        p = with_metadata(ra.soft_filter(p, F.col("match").isNotNull()), F.coalesce(F.lit(as_of).cast("date"), F.current_date()))
        score = sc.match_score(F.col("recommendation_score"), F.coalesce("match", F.lit(0.0)), F.col("is_saved"), F.col("is_read"))
        return p.select("id", "title", "year", F.round(score, 6).alias("score")).orderBy(F.desc("score"), F.desc("year"), "id").limit(clamp(limit, 1, 100))

    def behaviour(self, as_of) -> DataFrame:
        now = F.lit(as_of).cast("timestamp")
        w = self.t("paper_user_events").groupBy("paper_id").agg(F.sum(sc.decayed_event_weight(F.col("event"), F.col("created_at"), now)).alias("w"))
        return w.join(self.t("paper_directions"), "paper_id").groupBy("direction").agg(F.sum("w").alias("score"), F.count_distinct("paper_id").alias("papers")).where("score > 0")

    def _known(self) -> dict[str, tuple[str, str]]:
        """Label and query of every built-in and custom direction; custom ones win."""
        out = {k: (label, label) for k, (label, _) in DIRECTIONS.items()}
        if "custom_directions" in self.tables:
            out |= {r["key"]: (r["label"], r["query"]) for r in ra.few(self.t("custom_directions").select("key", "label", "query"))}
        return out

    def daily_recommendations(self, as_of: str, directions: Sequence[str] = (), limit: int = 2, window: str = "all", snapshots: dy.Snapshots | None = None) -> DataFrame:
        """(kind, direction, paper_id, rank, score): at most limit (1 or 2) papers per direction, none twice, and one or
        two of neighbouring directions.

        Directions: those asked for, else the active configured ones, else those that behaviour prefers. With snapshots
        the picks of a day and window are made once; later calls read them, whatever they ask for. Bounded: a few rows
        per direction are walked on the driver."""
        window = window if window in dy.WINDOWS else "all"
        n = dy.per_direction(limit)

        def compute() -> DataFrame:
            liked = [(r["direction"], r["score"]) for r in self.behaviour(as_of).orderBy(F.desc("score"), F.desc("papers"), "direction").limit(64).collect()]
            given = []
            if "direction_preferences" in self.tables:
                given = [(r["direction"], r["weight"], r["is_active"]) for r in sorted(ra.few(self.t("direction_preferences")), key=lambda r: (-r["weight"], r["direction"]))]
            keys, weights = dy.choose_directions(directions, given, liked)
            edges = self.tables["neighbours"] if "neighbours" in self.tables else neighbours(self.spark)
            near = [(r["direction"], r["neighbour"]) for r in edges.where(F.col("direction").isin(keys)).orderBy("direction", "position").collect()]
            explore = dy.neighbours_of(keys, near, [d for d, _, active in given if not active])
            weights |= {d: w for d, w, _ in given if d in explore}
            known = self._known()
            asked = {k: known.get(k, (k, k)) for k in [*keys, *explore]}
            empty = lambda ddl: self.spark.createDataFrame([], ddl)
            rules = self.tables.get("rules") or empty("direction string, term string, mode string")
            history = self.tables.get("history") or empty("paper_id long, direction string, shown_on date")
            links = self.t("paper_directions")
            links = links if "is_relevant" in links.columns else links.withColumn("is_relevant", F.lit(True))
            scored = dy.candidates(self.t("papers"), links, self.user_state(), history, rules, as_of, asked, weights, window, n)
            return dy.pick(scored, keys, explore, n)

        picks = snapshots.of(as_of, window, compute) if snapshots else compute()
        if "history" in self.tables:
            self.tables["history"] = dy.add_history(self.t("history"), picks, as_of)
        return picks.where("shown").select("kind", "direction", "paper_id", "rank", "score")

    def direction_counts(self) -> DataFrame:
        p = ra.visible(self.t("papers")).select(F.col("id").alias("paper_id"))
        return self.t("paper_directions").join(p, "paper_id", "left_semi").groupBy("direction").agg(F.count_distinct("paper_id").alias("n"))

    def evaluation_report(self) -> DataFrame:
        n = lambda x: F.count_if(F.col("label") == x).alias(x)
        return self.t("feedback").groupBy("direction").agg(n("relevant"), n("partial"), n("irrelevant"), F.count("*").alias("total")).orderBy(F.desc("total"), "direction")

    # ------------------------------------------------------------ writing
    def apply_user_action(self, paper_id: int, event: str, created_at) -> None:
        """Appends the event; the state follows from the log."""
        if event not in FLAGS and event not in ("note", "library_import"):
            raise ValueError(f"unknown event {event!r}")
        e = self.t("paper_user_events")
        new = self.spark.sql("SELECT CAST(:p AS BIGINT) AS paper_id, :e AS event", {"p": paper_id, "e": event})
        self.tables["paper_user_events"] = lib.append_events(e, new, F.lit(str(created_at)))

    def import_bibtex(self, text: str) -> DataFrame:
        """New papers of a BibTeX text: those without a match by arXiv id, DOI or normalised title and year."""
        from paperloom.sources.bibtex import read_bibtex

        entries = read_bibtex(self.spark.sql("SELECT :x AS bibtex", {"x": text})).withColumn("new_id", F.xxhash64("key"))
        norm = F.concat_ws(":", F.nullif(tx.normalize_title(F.col("title"), None), F.lit("")), F.coalesce(F.col("year").cast("string"), F.lit("-")))
        p = self.t("papers")
        keys = [("doi", tx.normalize_doi(F.col("doi"))), ("title", F.when(tx.normalize_title(F.col("title"), None) != "", norm))]
        old = p if "doi" in p.columns else p.withColumn("doi", F.lit(None).cast("string"))
        found = ra.match_by_priority(entries, old.select("id", "title", "year", "doi"), keys)
        return entries.join(found, "new_id", "left").select("key", "title", "year", "doi", "arxiv_id", F.col("id").alias("matched_id"))

    def save(self, bodies: DataFrame, now) -> DataFrame:
        """Saves papers and reports where they went; the papers, library and event tables are their new versions."""
        out = lib.save_papers(self.t("papers"), self._items(), self.t("paper_user_events"), bodies, F.lit(str(now)))
        self.tables |= {"papers": out["papers"], "library_items": out["library"], "paper_user_events": out["events"]}
        return out["outcome"]

    def import_library(self, text: str, now, collection: str = "Zotero 导入") -> DataFrame:
        """Takes a BibTeX text into the library; a row of counters."""
        from paperloom.sources.bibtex import read_bibtex

        e = read_bibtex(self.spark.sql("SELECT :x AS bibtex", {"x": text}))
        e = e.select("key", "title", "year", "doi", "arxiv_id", *[(F.col(c) if c in e.columns else F.lit(None).cast("string")).alias(c) for c in ("abstract", "venue", "authors", "pdf_url")])
        p = self.t("papers")
        p = p.withColumns({c: F.lit(None).cast("string") for c in ("doi", "arxiv_id") if c not in p.columns})
        links = self.t("paper_directions").select("paper_id", "direction")
        old = links.withColumns({"direction_label": F.col("direction"), "is_relevant": F.lit(True)})
        out = lib.import_entries(p, self._items(), old, self.t("paper_user_events"), e, F.lit(str(now)), collection)
        self.tables |= {"papers": out["papers"], "library_items": out["library"], "paper_directions": out["links"], "paper_user_events": out["events"]}
        return out["counters"]

    def _items(self) -> DataFrame:
        return self.tables.get("library_items") or self.spark.createDataFrame([], "paper_id long, source string, external_key string, collection string")

    def create_direction(self, label: str, query: str, color: str = "#0ea5e9") -> str:
        custom = self.tables.get("custom_directions") or self.spark.createDataFrame([], "key string, label string, query string, color string")
        self.tables["custom_directions"], key = lib.create_direction(custom, label, query, color)
        return key

    # ------------------------------------------------------------ small tables
    def _put(self, name: str, key: Sequence[str], ddl: str, rows: Sequence[tuple], how=ra.upsert) -> DataFrame:
        old = self.tables.get(name) or self.spark.createDataFrame([], ddl)
        self.tables[name] = how(old, self.spark.createDataFrame(list(rows), ddl), list(key))
        return self.tables[name]

    def set_preference(self, direction: str, weight: float = 1.0, is_active: bool = True, snapshots: dy.Snapshots | None = None, today: str | None = None) -> DataFrame:
        """A known direction with a weight of .5 to 2; the day's snapshots go, as they were made without it."""
        custom = self.tables.get("custom_directions") or self.spark.createDataFrame([], "key string")
        if direction not in DIRECTIONS and not custom.where(F.col("key") == direction).limit(1).count():
            raise ValueError(f"unknown direction {direction!r}")
        if snapshots and today:
            snapshots.forget(today)
        return self._put("direction_preferences", ["direction"], "direction string, weight double, is_active boolean", [(direction, clamp(float(weight), 0.5, 2.0), bool(is_active))])

    def add_rule(self, direction: str, term: str, mode: str) -> DataFrame:
        """A rule once per direction, lower-case term and mode."""
        if mode not in ("exclude", "require") or not (term or "").strip():
            raise ValueError("a rule needs a term and the mode exclude or require")
        return self._put("rules", ["direction", "term", "mode"], "direction string, term string, mode string", [(direction, term.strip().lower(), mode)], ra.insert_missing)

    def remove_rule(self, direction: str, term: str, mode: str) -> DataFrame:
        gone = self.spark.createDataFrame([(direction, term.strip().lower(), mode)], "direction string, term string, mode string")
        self.tables["rules"] = lib.delete_rows(self.t("rules"), gone, ["direction", "term", "mode"])
        return self.tables["rules"]

    def put_cluster(self, name: str, members: dict[str, float], color: str = "#0ea5e9") -> DataFrame:
        """A cluster by its name, with its directions and weights replaced as a whole."""
        if not (name or "").strip():
            raise ValueError("a cluster needs a name")
        self._put("interest_clusters", ["name"], "name string, color string", [(name.strip(), color)])
        ddl = "name string, direction string, weight double"
        old = self.tables.get("cluster_directions") or self.spark.createDataFrame([], ddl)
        new = self.spark.createDataFrame([(name.strip(), d, clamp(float(w), 0.5, 2.0)) for d, w in members.items()], ddl)
        self.tables["cluster_directions"] = old.where(F.col("name") != name.strip()).unionByName(new)
        return self.clusters()

    def remove_cluster(self, name: str) -> DataFrame:
        for t in ("interest_clusters", "cluster_directions"):
            self.tables[t] = self.t(t).where(F.col("name") != name)
        return self.clusters()

    def clusters(self) -> DataFrame:
        """Clusters with their directions, in one row each."""
        members = self.t("cluster_directions").groupBy("name").agg(F.array_sort(F.collect_list(F.struct("direction", "weight"))).alias("directions"))
        return self.t("interest_clusters").join(members, "name", "left").orderBy("name")

    def put_feedback(self, paper_id: int, direction: str, label: str, created_at) -> DataFrame:
        """Appends a judgement of a paper's relevance."""
        if label not in ("relevant", "partial", "irrelevant"):
            raise ValueError(f"unknown label {label!r}")
        old = self.t("feedback")
        new = self.spark.createDataFrame([(paper_id, direction, label, str(created_at))], "paper_id long, direction string, label string, created_at string")
        self.tables["feedback"] = old.unionByName(new.select(*[c for c in new.columns if c in old.columns]), allowMissingColumns=True)
        return self.tables["feedback"]

    def evidence(self, paper_id: int) -> DataFrame:
        """Cards of a paper: stored ones, else built from its cached fields."""
        if "paper_evidence" in self.tables:
            stored = self.t("paper_evidence").where(F.col("paper_id") == paper_id)
            if stored.limit(1).count():
                return stored
        p = self.t("papers").where(F.col("id") == paper_id)
        return p.select(F.col("id").alias("paper_id"), cards.evidence_cards(lambda n: F.col(n) if n in p.columns else F.lit(None).cast("string")).alias("cards"))

    def put_evidence(self, paper_id: int, text: str) -> DataFrame:
        """Stores the cards of a paper's whole text."""
        new = self.spark.sql("SELECT CAST(:p AS BIGINT) AS paper_id, :t AS text", {"p": paper_id, "t": text}).select("paper_id", cards.full_text_evidence(F.col("text")).alias("cards"))
        self.tables["paper_evidence"] = ra.upsert(self.t("paper_evidence"), new, ["paper_id"]) if "paper_evidence" in self.tables else new
        return self.evidence(paper_id)

    def classify(self, paper_id: int, call=None) -> DataFrame:
        """A paper's classification, cached by content, applied to its links and primary direction."""
        known = [(k, label) for k, (label, _) in self._known().items()]
        cache = self.tables.get("paper_classifications") or self.spark.createDataFrame([], "id long, digest string, result string")
        p = self.t("papers").where(F.col("id") == paper_id)
        get = lambda n: F.col(n) if n in p.columns else F.lit(None).cast("string")
        out, new = providers.classify(p, cache, "id", tx.result_hash("classification", get), known, call)
        self.tables["paper_classifications"] = ra.upsert(cache, new, ["id"])
        answers = out.select(F.col("id").alias("paper_id"), "result.primary_direction", "result.secondary_directions")
        papers = self.t("papers").withColumns({c: F.lit(None).cast("string") for c in ("direction", "direction_label") if c not in self.t("papers").columns})
        links = self.t("paper_directions").withColumns({c: v for c, v in (("direction_label", F.col("direction")), ("is_relevant", F.lit(True))) if c not in self.t("paper_directions").columns})
        self.tables["papers"], self.tables["paper_directions"] = lib.apply_classification(papers, links, answers, self.spark.createDataFrame(known, "direction string, label string"))
        return out.select("id", "result.*")
