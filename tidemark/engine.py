"""One memory over one log table: what callers store, forget, recall and ask about it."""

from __future__ import annotations

from collections import Counter

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .config import Config
from .errors import EngineError
from .functions.score import DAY
from .functions.text import content_hash, estimate_tokens
from .operators import cognition as C
from .operators import graph as G
from .operators import ranking as R
from .operators import store as ST
from .plans.html import render
from .plans.tables import checkpointed, ranked, stamp
from .schema import ENTRY_COLUMNS, LOG, conflict_peers
from .sources import log as L
from .sources.documents import plan_import, session_text, split_document
from .streaming.capture import capture_to

#: Most changes of a kind, and edges of a side, that a diff shows; most chains that explain a hit.
SHOWN, SHOWN_EDGES, SHOWN_CHAINS = 20, 10, 3
CANDIDATE = "id string, ord long, kind string, content string, tags array<string>, source string, workspace string"


class Memory:
    """A log table under `path` in storage that all executors share, written by one writer at a time.

    Whatever is returned is a DataFrame; `now` is always given. counts holds what was asked and done since it was made.
    """

    def __init__(self, spark: SparkSession, path: str, config: Config | None = None, nfkc: bool = True):
        self.spark, self.path, self.config, self.nfkc = spark, path.rstrip("/"), (config or Config()).clamped(), nfkc
        self.counts: Counter[str] = Counter()
        self.closed = False
        self._indexes = R.IndexCache()

    def close(self) -> None:
        self.closed = True

    def log(self) -> DataFrame:
        if self.closed:
            raise EngineError("STORE_CLOSED", f"{self.path} is closed")
        try:
            return self.spark.read.schema(LOG).parquet(self.path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], LOG)
            raise EngineError("STORE_READ_FAILED", f"{self.path} can't be read") from e

    def entries(self, as_of: int | None = None, workspace: str | None = None) -> DataFrame:
        """Entries that stand, or stood at a time, in their order."""
        rows = L.live(self.log()) if as_of is None else L.as_of(self.log(), as_of)
        return ST.workspace_filter(L.snapshot(rows), workspace)

    def export(self) -> DataFrame:
        return ST.export_all(self.log())

    def _write(self, lines: DataFrame) -> None:
        try:
            lines.write.mode("append").parquet(self.path)
        except Exception as e:
            raise EngineError("STORE_WRITE_FAILED", f"{self.path} can't be written") from e

    def put(self, entries: DataFrame) -> None:
        """Entries after all lines there are; later lines win."""
        self._write(checkpointed(ST.upsert(self.log(), entries, ["created_at", "id"])))

    def compact(self) -> DataFrame:
        """Rewrites the log with one line for each standing entry, if that keeps what stands; the check's row."""
        short = checkpointed(ST.compact(self.log()))
        found = checkpointed(ST.verify_compact(self.log(), short))
        if any(found.first()):
            raise EngineError("INTERNAL", f"compaction would change entries: {found.first().asDict()}")
        short.write.mode("overwrite").parquet(self.path)
        return found

    # -- writing

    def ingest(self, candidates: DataFrame, now: int, most: int = 10_000) -> DataFrame:
        """Writes candidates (id, ord, kind, content, tags; others optional) in their order and returns their statuses.
        More than `most` go in as successive batches, each of which sees what those before it wrote."""
        known = {"source": F.lit("auto"), "workspace": F.lit(None).cast("string")}
        rows = candidates.withColumns({k: v for k, v in known.items() if k not in candidates.columns})
        fresh = ST.make_entries(rows, now, self.config.max_entry_chars, keep=["id", "ord"])
        placed = ranked(fresh, [], [F.col("ord"), F.col("id")], "__place")
        told = None
        for k in range(-(-placed.count() // most)):
            found = self._ingest(placed.where(F.col("__place").between(k * most + 1, (k + 1) * most)).drop("__place"), now, most)
            told = found if told is None else told.unionByName(found)
        return told if told is not None else self.spark.createDataFrame([], C.STATUS)

    def _ingest(self, batch: DataFrame, now: int, most: int) -> DataFrame:
        c = self.config
        new = C.normalized(checkpointed(batch), self.nfkc)
        library = C.normalized(checkpointed(L.live(self.log()).select(*ENTRY_COLUMNS)), self.nfkc)
        found = checkpointed(C.ingest(new, library, now, c.dedup_window_ms, c.conflict_window_ms, c.supersede_mode == "auto", c.conflict_mode == "auto", most))
        self.put(C.ingest_writes(new, library, found, now))
        for r in found.groupBy("status").count().collect():
            self.counts[f"ingest_{r['status']}"] += r["count"]
        return found

    def store(self, content: str, now: int, kind: str = "generic", tags: tuple = (), workspace: str | None = None, source: str = "explicit") -> DataFrame:
        """id, kind, content of the entry that now holds the content: the one written, or the one that was there."""
        if not content.strip():
            self.counts["errors"] += 1
            raise EngineError("EMPTY_CONTENT", "content must not be empty")
        row = self.spark.createDataFrame([("new", 0, kind, content, list(tags), source, workspace)], CANDIDATE)
        made = C.normalized(ST.make_entries(row, now, self.config.max_entry_chars, suffix=F.substring(F.sha2(F.lit(f"{now}|{content}"), 256), 1, 8)), self.nfkc)
        made = checkpointed(C.candidate_flags(made).withColumn("ord", F.lit(0).cast("long")))
        if made.first()["sensitive"]:
            self.counts["rejected_sensitive"] += 1
            raise EngineError("SENSITIVE_CONTENT", "content contains sensitive information and will not be stored")
        c, library = self.config, C.normalized(checkpointed(L.live(self.log()).select(*ENTRY_COLUMNS)), self.nfkc)
        there = C.find_duplicate(made, library, now, c.dedup_window_ms).select(F.col("target").alias("id")).join(library, "id").select("id", "kind", "content")
        if not there.isEmpty():
            self.counts["rejected_duplicate"] += 1
            return there
        columns = "id string, target string, similarity double"
        nothing = self.spark.createDataFrame([], columns)
        old = checkpointed(C.supersede_targets(made, library, now, max(c.dedup_window_ms, DAY)) if c.supersede_mode == "auto" else nothing)
        foes = C.contradictions(made, library, now, c.conflict_window_ms) if c.conflict_mode == "auto" else nothing
        foes = checkpointed(foes.join(old, "id", "left_anti"))
        done = made.select("id", "ord").join(old.select("id", F.lit("superseded").alias("status"), "target").unionByName(foes.select("id", F.lit("conflict").alias("status"), "target")), "id", "left").fillna("written", ["status"])
        self.put(C.ingest_writes(made, library, done.select("id", "ord", "status", "target"), now))
        self.counts["stored"] += 1
        return made.select("id", "kind", "content")

    def forget(self, entry_id: str, now: int, strict: bool = False) -> bool:
        """Whether an entry of this id stood and is gone now."""
        ids = self.spark.createDataFrame([(entry_id.strip(),)], "id string")
        lines = checkpointed(ST.remove(self.log(), ids, now))
        gone = not lines.isEmpty()
        if gone:
            self._write(lines)
            self.counts["forgotten"] += 1
        elif strict:
            self.counts["errors"] += 1
            raise EngineError("NOT_FOUND", f"memory not found: {entry_id}")
        return gone

    def prune(self, now: int) -> DataFrame:
        """Removes what is expired and, where evicting is on, the least valued beyond the most; id and reason."""
        c = self.config
        gone = checkpointed(ST.prune(L.live(self.log()), now, c.ttl_days, c.max_entries if c.auto_evict else 0))
        self._write(checkpointed(ST.remove(self.log(), gone.select("id"), now)))
        self.counts["pruned"] += gone.count()
        return gone

    def maintain(self, now: int) -> None:
        """One round of distilling and consolidating, as far as they are on."""
        for name, rows in C.maintain(L.live(self.log()).select(*ENTRY_COLUMNS), now).items():
            if (self.config.consolidation_mode if name == "reinforced" else self.config.distill_mode) == "auto":
                self.put(checkpointed(rows.select(*ENTRY_COLUMNS)))

    def import_sources(self, now: int, documents: tuple = (), sessions: tuple = ()) -> list[dict]:
        """Reads Markdown documents and session logs (one JSON record a line), each by itself: one that fails is counted
        and told, and the others go in. A report for each source: path, added, the plan's counts, error."""
        told = []
        for path, is_session in [*((p, False) for p in documents or self.config.import_sources), *((p, True) for p in sessions)]:
            try:
                if is_session:
                    lines = self.spark.read.text(path).select(F.lit(path).alias("label"), F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"))
                    plan = plan_import(split_document(self.spark.createDataFrame([], "label string, text string")), session_text(lines), self._hashes(), now, self.config.max_entry_chars, self.nfkc)
                else:
                    text = self.spark.read.text(path, wholetext=True).select(F.lit(path).alias("label"), F.col("value").alias("text"))
                    plan = plan_import(split_document(text), None, self._hashes(), now, self.config.max_entry_chars, self.nfkc)
                lines = checkpointed(ST.insert_new(self.log(), checkpointed(plan[0])))
                self._write(lines)
                told.append({"path": path, "added": lines.count(), **plan[1].first().asDict(), "error": None})
            except Exception as e:  # whatever is wrong with one source
                self.counts["errors"] += 1
                told.append({"path": path, "added": 0, "error": str(e)[:300]})
        return told

    def _hashes(self) -> DataFrame:
        return L.live(self.log()).select(content_hash(F.col("content")).alias("content_hash"))

    def capture(self, events: DataFrame, checkpoint: str, now: int):
        """Starts a stream of events (EVENT) into the log: what is worth remembering goes through ingest(), one ordered
        batch after the other. A batch that comes again after a failure finds its own entries there, as duplicates."""

        def write(found: DataFrame, number: int) -> None:
            if not found.isEmpty():
                rows = found.select(F.format_string("ev-%020d", "event_seq").alias("id"), F.col("event_seq").alias("ord"), "kind", "content", "tags", "workspace")
                self.ingest(checkpointed(rows), now)

        return capture_to(events, write, checkpoint, self.config.capture_mode)

    # -- reading

    def get(self, entry_id: str) -> DataFrame:
        return L.live(self.log().where(F.col("id") == entry_id)).select(*ENTRY_COLUMNS)

    def size(self) -> int:
        return L.live(self.log()).count()

    def page(self, generated_at: str, workspace: str | None = None, most: int | None = None) -> str:
        """The page of all entries (or the `most` newest) that searches itself; it is made on the driver."""
        entries = self.entries(workspace=workspace)
        return render(entries, ST.summarize(entries).first().asDict(), self.timeline(), generated_at, most)

    def recall(self, query: str, now: int, options: R.RecallOptions | None = None, as_of: int | None = None, reinforce: bool = True, explain: bool = False, expand: bool = False) -> DataFrame:
        """rank, id, kind, content, tags, score, superseded, conflicts, cost; with explain why and the chains that
        support a hit, with expand the sources of distilled hits. Of two hits that contradict the newer comes first.

        as_of asks what was known then and changes nothing; otherwise each hit counts as accessed now, unless reinforce
        is off.
        """
        if not query.strip():
            raise EngineError("EMPTY_CONTENT", "query must not be empty")
        c, moment = self.config, as_of or now
        o = options or R.RecallOptions(max_tokens=c.default_recall_tokens, limit=c.default_recall_limit, fusion=c.fusion_mode, semantic_boost=c.semantic_boost)
        entries = checkpointed(self.entries(as_of).select(*ENTRY_COLUMNS, "ord"))
        index = R.build_index(entries, self.nfkc) if as_of else self._indexes.get(("live",), stamp(self.log()), lambda: R.build_index(entries, self.nfkc))
        graph = infer = found = edges = None
        if c.graph_enabled or c.infer_enabled:
            edges = checkpointed(G.build_edges(G.triples(entries, self.nfkc)))
            named = G.query_entities(self.spark.createDataFrame([("q", query)], "qid string, text string"), self.nfkc)
            seeds = checkpointed(named.select("entity").unionByName(G.align(edges, R.query_tokens(query)).select("entity")).distinct())
            if c.graph_enabled:
                graph = G.entity_line(G.neighbors(edges, seeds, moment), edges, entries, moment)
            if c.infer_enabled:
                found = checkpointed(G.infer_chains(edges, seeds, moment, c.infer_max_hops))
                infer = G.entity_line(found.select(F.col("terminal").alias("entity"), "score"), edges, entries, moment)
        hits = checkpointed(R.recall(entries, query, moment, o, graph, infer, c.vector_enabled, index, self.nfkc))
        told = hits.join(entries.drop("ord"), "id").withColumn("qid", F.lit("q"))
        placed = R.in_conflict_order(told).select("id", F.col("rank").alias("__rank"))
        out = told.drop("rank").join(placed, "id").withColumnRenamed("__rank", "rank")
        extra = ["why"] if explain else []
        if explain and found is not None:
            shown = found.join(G.mentions(edges), found["terminal"] == F.col("entity")).withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "terminal"))).where(F.col("n") <= SHOWN_CHAINS)
            chains = shown.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "terminal", F.col("score").alias("s"), "path"))), lambda x: F.struct(x["terminal"].alias("terminal"), x["s"].alias("score"), x["path"].alias("path"))).alias("chains"))
            out, extra = out.join(chains, "id", "left").withColumn("chains", F.when(F.col("why.infer") > 0, F.col("chains"))), [*extra, "chains"]
        if expand:
            sources = C.expand_distilled(entries).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "source_id"))), lambda x: x["source_id"]).alias("expanded"))
            out, extra = out.join(sources, "id", "left"), [*extra, "expanded"]
        cost = estimate_tokens(F.concat_ws(" ", "kind", "content")).alias("cost")
        out = checkpointed(out.select("rank", "id", "kind", "content", "tags", "score", "superseded", conflict_peers(F.col("tags")).alias("conflicts"), cost, *extra).orderBy("rank"))
        self.counts["recall_calls"] += 1
        self.counts["recall_hits"] += out.count()
        if reinforce and as_of is None:
            self.put(ST.heat_rows(entries.join(out.select("id"), "id", "left_semi"), now))
        return out.orderBy("rank")

    def status(self, now: int, as_of: int | None = None, workspace: str | None = None) -> DataFrame:
        """One row: counts by kind and source, hot and cold, distilled layers, conflicting pairs, the consolidation due,
        and of the present the lines of the log."""
        entries = checkpointed(self.entries(as_of, workspace))
        moment = as_of or now
        parts = [ST.summarize(entries), ST.hot_cold(entries, moment), ST.layer_counts(entries), C.conflict_pairs(entries).agg(F.count(F.lit(1)).alias("conflict_pairs")), C.summarize_consolidation(entries, moment).select("due", "mean_strength", "median_retrievability")]
        if as_of is None:
            parts.append(L.log_stats(self.log()).drop("entries"))
        out = parts[0]
        for p in parts[1:]:
            out = out.crossJoin(F.broadcast(p))  # each is one row
        return out

    def conflicts(self, limit: int = 3) -> DataFrame:
        return C.summarize_conflict_pairs(self.entries(), limit)

    def themes(self, workspace: str | None = None) -> DataFrame:
        """Themes, the largest first."""
        return C.theme_clusters(self.entries(workspace=workspace), nfkc=self.nfkc)[1].orderBy(F.desc("member_count"), "label")

    def timeline(self) -> DataFrame:
        return L.timeline(self.log()).orderBy("day")

    def diff(self, since: int, until: int, workspace: str | None = None) -> DataFrame:
        """What changed from one moment to another: change_type, id, kind, title, change, n (changes of that type); by
        type and id, SHOWN of each type."""
        if since > until:
            raise EngineError("INTERNAL", f"since ({since}) must not be after until ({until})")
        rows = L.diff(self.entries(since, workspace), self.entries(until, workspace))
        w = Window.partitionBy("change_type")
        shown = rows.withColumns({"n": F.count(F.lit(1)).over(w), "k": F.row_number().over(w.orderBy("id"))}).where(F.col("k") <= SHOWN)
        return shown.drop("k").orderBy("change_type", "id")

    def graph_diff(self, since: int, until: int) -> DataFrame:
        """side, src, relation, dst of edges that came or went, SHOWN_EDGES of each side."""
        edges = lambda t: G.build_edges(G.triples(self.entries(t), self.nfkc))
        rows = G.graph_diff(edges(since), edges(until), since, until)
        place = F.row_number().over(Window.partitionBy("side").orderBy("src", "relation", "dst"))
        return rows.withColumn("k", place).where(F.col("k") <= SHOWN_EDGES).drop("k").orderBy("side", "src", "relation", "dst")
