"""The engine's API over a warehouse: write, retrieve, feedback, consolidate, reindex, list, traverse, explain, inspect, dump."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scores
from ..hooks import HASH, Models
from ..operators import association, browse, channels, learning, spreading, summaries
from ..params import DEFAULT, POSITIVE_SIGNALS, Params
from ..sources.warehouse import NotFound, Warehouse, by_ids, stored
from . import retrieve as plan

RAW = "id long, text string, content_type string, created_at_ms long, conversation_id long, session_id long, project_id long, task_id long"

#: epoch is the number of consolidations before the record: a cycle learns from records of its own epoch only.
ACTIVATION = "retrieval_id long, memory_id long, ts_ms long, signal string, epoch long"
CONTEXT = "retrieval_id long, feature string"
PATHS = "retrieval_id long, src long, dst long"
RETRIEVE = "retrieve"


class Engine:
    def __init__(self, spark: SparkSession, root: str, params: Params = DEFAULT, models: Models = HASH):
        self.spark, self.store, self.params, self.models = spark, Warehouse(spark, root), params, models

    def write(self, memories: DataFrame, now_ms: int) -> None:
        """memories as RAW. Each new memory is linked to older ones, those of the batch included; a known id is an error."""
        self.store.append("memory", memories.select(*(c.split()[0] for c in RAW.split(", "))), "id")
        self.recover(now_ms)

    def recover(self, now_ms: int) -> None:
        """Derives what memories of the log don't have yet: after a write, or one that was cut short between the log and the unit."""
        log = self.store.log("memory", RAW)
        if self.store.version("unit"):
            log = log.join(self.store.read("unit").select("id"), "id", "left_anti")
        new = stored(log)
        if not new.isEmpty():
            self._derive(new, now_ms)

    def _derive(self, memories: DataFrame, now_ms: int, whole: bool = False) -> None:
        """whole: these are all memories, and what was derived before goes. Units are written last, so a memory without one is derived again;
        the rows that it left elsewhere go first."""
        new = association.understand(memories, self.models).withColumn("lifecycle", F.lit("Active")).withColumn("generated_by", F.lit("Write")).withColumn("stage", F.lit("Enriched")).withColumn("updated_at_ms", F.lit(now_ms).cast("long"))
        new = stored(self._marked(new))
        fresh = whole or not self.store.version("unit")
        post = association.postings(new)
        for name, rows, key in (("vector", new.select("id", "embedding", "code"), "id"), ("term", channels.full_text(new), "id"), ("posting", post, "id")):
            self._put(name, rows, key, memories, fresh)
        posting = self.store.read("posting")
        units = new.drop("embedding") if fresh else self.store.read("unit").unionByName(new.drop("embedding"))
        pairs = association.candidate_pairs(posting, new=None if fresh else posting.join(memories.select("id"), "id", "left_semi"), units=units, best=self.params.max_candidates)
        edges = association.build_edges(association.pair_features(pairs, units, self.params), F.lit(units.count()), now_ms, self.params).withColumn("ord", F.lit(0))
        if self.store.version("compressed"):
            edges = self._redirected(edges)
        if whole and self.store.version("edge"):  # what edges have learnt stays
            old = self.store.read("edge")
            self.store.replace("edge", old.unionByName(edges.join(old.select("src", "dst", "link_type"), ["src", "dst", "link_type"], "left_anti")))
        else:
            self._put("edge", edges, "src", memories, fresh)
        if fresh:
            self.store.replace("unit", new.drop("embedding"))
        else:
            self.store.add("unit", new.drop("embedding"))

    def _put(self, name: str, rows: DataFrame, key: str, memories: DataFrame, fresh: bool) -> None:
        """Adds rows of memories; rows that a write cut short has left of them are replaced."""
        if fresh:
            return self.store.replace(name, rows)
        ids = memories.select(F.col("id").alias(key))
        old = self.store.read(name)
        if old.join(ids, key, "left_semi").isEmpty():
            return self.store.add(name, rows)
        return self.store.replace(name, old.join(ids, key, "left_anti").unionByName(rows))

    def _marked(self, units: DataFrame) -> DataFrame:
        """Units that a summary covers are Compressed, and summaries are made by Consolidation."""
        if not self.store.version("compressed"):
            return units
        covers = self.store.read("compressed")
        rows = units.join(covers.select("id", F.lit(True).alias("covered")), "id", "left").join(covers.select(F.col("into").alias("id"), F.lit(True).alias("made")).distinct(), "id", "left")
        rows = rows.withColumn("lifecycle", F.when(F.col("covered"), "Compressed").otherwise(F.col("lifecycle"))).withColumn("generated_by", F.when(F.col("made"), "Consolidation").otherwise(F.col("generated_by")))
        return rows.withColumn("importance", F.when(F.col("made"), 0.5).otherwise(F.col("importance"))).select(*units.columns)

    def _redirected(self, edges: DataFrame) -> DataFrame:
        """Edges to covered units point to the summary, the strongest of equal ones stays; summaries have no edges of their own."""
        covers = self.store.read("compressed")
        rows = learning.redirect(edges, covers).join(covers.select(F.col("into").alias("src")).distinct(), "src", "left_anti")
        w = Window.partitionBy("src", "dst", "link_type").orderBy(F.desc("strength"), F.desc("last_activated_at"), F.desc("activation_count"), F.desc("confidence"))
        return rows.withColumn("n", F.row_number().over(w)).where("n = 1").select(*edges.columns)

    def reindex(self, now_ms: int) -> None:
        """Rebuilds what is derived from the log; learnt tables stay, and edges that only learning made."""
        self._derive(self.store.log("memory"), now_ms, whole=True)

    @property
    def degraded(self) -> bool:
        """There are memories, but none has a vector."""
        return bool(self.store.version("unit")) and (not self.store.version("vector") or self.store.read("vector").where("embedding is not null").isEmpty())

    def put_vectors(self, vectors: DataFrame) -> None:
        """Replaces the vectors (id, embedding) of these ids; one of another length than the stored ones is an error."""
        old = self.store.read("vector")
        size = old.where("embedding is not null").select(F.size("embedding").alias("n")).first()
        if size and not vectors.where(F.size("embedding") != size.n).isEmpty():
            raise ValueError(f"vectors have {size.n} numbers")
        self.store.upsert("vector", vectors.select("id", F.col("embedding").cast("array<double>").alias("embedding"), scores.sign_code(F.col("embedding")).alias("code")), "id")

    def remove_vectors(self, ids: DataFrame) -> None:
        """Memories with these ids (id) have no vector any more."""
        self.store.replace("vector", self.store.read("vector").join(ids.select("id"), "id", "left_anti"))

    def query_context(self, retrieval_ids: DataFrame) -> DataFrame:
        """(retrieval_id, feature) of these retrievals; unknown ones give none."""
        return by_ids(self.store.log("query_context", CONTEXT), retrieval_ids, "retrieval_id")

    def retrieval_paths(self, retrieval_ids: DataFrame) -> DataFrame:
        """(retrieval_id, src, dst) of these retrievals; unknown ones give none."""
        return by_ids(self.store.log("retrieval_path", PATHS), retrieval_ids, "retrieval_id")

    def tables(self) -> plan.Tables:
        link = self.store.read("context_link") if self.store.version("context_link") else None
        return plan.Tables(*map(self.store.read, ("unit", "posting", "edge", "term", "vector")), link)

    def retrieve(self, queries: DataFrame, now_ms: int, top_k: int = 10, mode: str = "Balanced", recent: DataFrame | None = None) -> DataFrame:
        """queries (query_id, text). Results are written once; the activation log, the queries' features and the first step of the
        path to each result that isn't a seed are kept by the query id, for feedback."""
        p = plan.with_mode(mode, self.params)
        out = stored(plan.retrieve(queries, self.tables(), now_ms, top_k, p, models=self.models, recent=recent))
        rid = F.col("query_id").cast("long").alias("retrieval_id")
        self._log(out.select(rid, F.col("id").alias("memory_id"), F.lit(now_ms).cast("long").alias("ts_ms"), F.lit(RETRIEVE).alias("signal")))
        self.store.append("query_context", plan.features(queries).select(rid, "feature"))
        self.store.append("retrieval_path", out.where("hop > 0").select(rid, F.col("path")[1]["src"].alias("src"), F.col("path")[1]["dst"].alias("dst")))
        return out.drop("path")

    def _log(self, rows: DataFrame) -> None:
        self.store.append("activation", rows.select("retrieval_id", "memory_id", "ts_ms", "signal", F.lit(self._epoch()).cast("long").alias("epoch")))

    def _epoch(self) -> int:
        return self.store.version("epoch")

    def feedback(self, signals: DataFrame, now_ms: int | None = None) -> None:
        """signals (retrieval_id, memory_id, ts_ms, signal). Usage scores follow all of them; positive ones also link the memory to its
        query's features and strengthen the first edge of the path that led to it."""
        signals = stored(signals.select("retrieval_id", "memory_id", "ts_ms", "signal"))
        self._log(signals)
        before = self.store.read("usage") if self.store.version("usage") else None
        self.store.replace("usage", learning.usage(signals.withColumn("event_id", F.col("retrieval_id")), before))
        good = signals.where(F.col("signal").isin(*POSITIVE_SIGNALS))
        if good.isEmpty():
            return
        asked = self.store.log("query_context", CONTEXT).distinct()
        links = good.join(asked, "retrieval_id").select("feature", "memory_id", "ts_ms", "signal")
        old = self.store.read("context_link") if self.store.version("context_link") else None
        self.store.replace("context_link", learning.context_links(links, old, self.params))
        paths = self.store.log("retrieval_path", PATHS).distinct().join(good.select("retrieval_id", F.col("memory_id").alias("dst"), "ts_ms"), ["retrieval_id", "dst"])
        if not paths.isEmpty():
            now = now_ms if now_ms is not None else paths.agg(F.max("ts_ms")).first()[0]
            self.store.replace("edge", learning.reinforce_paths(self.store.read("edge"), paths.select("src", "dst"), now, self.params))

    def coactivation(self) -> DataFrame:
        """For each memory the latest companions in results, with counts."""
        return learning.coactivation_counts(self.store.log("activation", ACTIVATION).where(F.col("signal") == RETRIEVE), self.params)

    def consolidate(self, now_ms: int, scope: str = "Full") -> dict[str, int]:
        """One cycle over the edges, then summaries of clusters (scope EdgesOnly: without; Reindex: reindex instead). A cycle learns from what
        the activation log got since the last one, or with replay_log from all of it. Edges that go are kept in the log edge_archive.
        The counts say what changed."""
        if scope == "Reindex":
            self.reindex(now_ms)
            return {"reindexed": self.store.read("unit").count()}
        old = self.store.read("edge")
        log, epoch = self.store.log("activation", ACTIVATION), self._epoch()
        log = log if self.params.replay_log else log.where(F.col("epoch") == epoch)
        new = stored(learning.cycle(old.drop("ord"), log, now_ms, self.params).withColumn("ord", F.lit(0)))
        key = ["src", "dst", "link_type"]
        gone = old.join(new, key, "left_anti")
        self.store.append("edge_archive", gone.withColumn("epoch", F.lit(epoch).cast("long")))
        now = new.join(old.select(*key, F.col("strength").alias("was"), F.col("activation_count").alias("had")), key, "left")
        counted = now.agg(F.count_if(F.col("was").isNull()).alias("edges_new"), F.count_if(F.col("strength") < F.col("was")).alias("edges_weakened"), F.count_if(F.col("activation_count") > F.col("had")).alias("edges_reinforced"), F.count("*").alias("edges_kept")).first().asDict()
        report = {"edges_before": old.count(), "edges_archived": gone.count(), **counted}
        self.store.replace("edge", new)
        self.store.replace("epoch", self.spark.createDataFrame([(now_ms,)], "now_ms long"))
        report["summaries_new"] = 0 if scope == "EdgesOnly" else self.compress(now_ms)
        return report | {"edges_after": self.store.read("edge").count()}

    def summarise(self) -> DataFrame:
        """(leader, id) of clusters that deserve a summary."""
        return summaries.clusters(browse.eligible(self.store.read("unit")), self.params)

    def compress(self, now_ms: int) -> int:
        """Writes a summary of each such cluster as a memory, marks what it covers, and points edges to it. Returns their number.

        Ids of summaries follow all others, in the order of the leaders."""
        self.store.replace("cluster", self.summarise())
        units = self.store.read("unit")
        found = self.store.read("cluster").join(units.select("id", "text"), "id")
        made = self.models.summarise(found).where(F.round("confidence", 9) >= self.params.summary_confidence)
        low, high = units.agg(F.min("id"), F.max("id")).first()
        if made.isEmpty():
            return 0
        self.store.replace("summary", made.select((F.col("leader") + (high - low + 1)).alias("id"), "leader", F.col("summary").alias("text")))
        made = self.store.read("summary")
        covers = found.join(made.select("leader", F.col("id").alias("into")), "leader").select("id", "into")
        self.store.upsert("compressed", covers, "id")
        memories = made.select("id", "text", F.lit("Reflection").alias("content_type"), F.lit(now_ms).cast("long").alias("created_at_ms"), *(F.lit(None).cast("long").alias(c) for c in association.CONTEXT))
        self.write(memories, now_ms)
        self.store.replace("unit", self._marked(self.store.read("unit")))
        self.store.replace("edge", self._redirected(self.store.read("edge")))
        return made.count()

    def list(self, limit: int = 20, cursor=None, content_type: str | None = None) -> DataFrame:
        return browse.page(self.store.read("unit"), limit, cursor, content_type)

    def list_info(self, limit: int = 20, cursor=None, content_type: str | None = None) -> tuple[DataFrame, int | None, int]:
        """A page, the cursor of the next one or None, and the number of all."""
        return browse.page_info(self.store.read("unit"), limit, cursor, content_type)

    def get(self, ids: DataFrame) -> DataFrame:
        """Units with these ids (id); unknown ids give none."""
        return by_ids(self.store.read("unit"), ids)

    def _known(self, ids: DataFrame) -> None:
        lost = ids.join(self.store.read("unit").select("id"), "id", "left_anti").first()
        if lost:
            raise NotFound(lost.id)

    def traverse(self, start: DataFrame, direction: str = "out", depth: int = 1, types: list[str] | None = None) -> DataFrame:
        """(id, depth); a start that is no memory is an error."""
        self._known(start.select("id"))
        return spreading.traverse(start, self.store.read("edge"), direction, depth, types)

    def traverse_nodes(self, start: DataFrame, direction: str = "out", depth: int = 1, types: list[str] | None = None) -> DataFrame:
        """The memories of a traversal with type and preview; targets that are no memory are left out."""
        return browse.nodes(self.traverse(start, direction, depth, types), self.store.read("unit"))

    def traverse_edges(self, start: DataFrame, direction: str = "out", depth: int = 1, types: list[str] | None = None) -> DataFrame:
        return spreading.traversed_edges(self.traverse(start, direction, depth, types), self.store.read("edge"), direction, depth, types)

    def explain(self, id_: int | None = None) -> DataFrame:
        """Of one memory (an unknown one is an error), or of all."""
        units, edges = self.store.read("unit"), self.store.read("edge")
        if id_ is not None:
            self._known(self.spark.createDataFrame([(id_,)], "id long"))
            units, edges = units.where(F.col("id") == id_), edges.where(F.col("src") == id_)
        return browse.explain(units, edges, self.store.log("activation", ACTIVATION))

    def inspect(self, kind: str = "stats", n: int = 20, dim: str = "entity") -> DataFrame:
        units, edges = self.store.read("unit"), self.store.read("edge")
        kinds = {
            "stats": lambda: browse.stats(units, edges),
            "units": lambda: browse.unit_stats(units, edges),
            "postings": lambda: browse.posting_stats(self.store.read("posting")),
            "channel": lambda: self.store.read("posting").where(F.col("dim") == dim).groupBy("key").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key").limit(n),
            "edges": lambda: browse.edge_view(edges),
            "strongest": lambda: browse.strongest_edges(edges, n),
            "contradictions": lambda: edges.where("link_type = 'Contradiction'"),
            "in_edges": lambda: browse.in_edges(edges, units),
        }
        return kinds[kind]()

    def dump(self, path: str | None = None) -> DataFrame:
        lines = browse.json_lines(self.store.read("unit"))
        if path:
            lines.write.mode("overwrite").text(path)
        return lines

    def clear(self) -> None:
        self.store.clear()
