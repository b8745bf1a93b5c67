"""Learning from use: co-activation, Hebbian change, rejection, forgetting, compaction, context links.

Edges are (src, dst, link_type, strength, confidence, observing, last_activated_at, activation_count)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores
from ..params import DAY_MS, DEFAULT, POSITIVE_SIGNALS, SIGNAL_WEIGHT, USAGE_DELTA, Params
from ..sources.warehouse import stored
from . import blocks


#: Rejected ids that are sent to every task; more are shuffled.
FEW = 200_000


def _signal(table: dict[str, float]):
    out = F.when(F.lit(False), 0.0)
    for name, value in table.items():
        out = out.when(F.col("signal") == name, value)
    return out.otherwise(0.0)


class _Met:
    """Weights of the pairs of two blocks of memories, or of one, as events come in the order of time. Only those of the last window are held."""

    #: Pairs of events that are worked out at once.
    STEP = 1 << 21

    def __init__(self, one: bool, window: int):
        self.one, self.window, self.known = one, window, ({}, {})
        self.sum, self.met = np.zeros((256, 256)), np.zeros((256, 256), bool)
        self.held = tuple(np.empty(0, t) for t in (np.int64, np.int64, float, np.int64))  # time, number in its block, weight, side

    def _numbers(self, ids: np.ndarray, side: int) -> np.ndarray:
        known = self.known[side]
        names, at = np.unique(ids, return_inverse=True)
        return np.array([known.setdefault(x, len(known)) for x in names.tolist()], np.int64)[at]

    def add(self, ids: np.ndarray, ts: np.ndarray, weight: np.ndarray, side: np.ndarray) -> None:
        number = np.empty(len(ids), np.int64)
        for s in (0, 1):
            number[side == s] = self._numbers(ids[side == s], s)
        size = max(map(len, self.known))
        if size > len(self.sum):
            wide = ((0, max(size, 2 * len(self.sum)) - len(self.sum)),) * 2
            self.sum, self.met = np.pad(self.sum, wide), np.pad(self.met, wide)
        first = len(self.held[0])
        ts, number, weight, side = (np.concatenate(x) for x in zip(self.held, (ts, number, weight, side), strict=True))
        new = np.arange(first, len(ts))
        since = np.searchsorted(ts, ts[new] - self.window, "right")
        if self.one:
            self._pairs(new, since, new, np.arange(len(ts)), number, weight)
        else:
            for s in (0, 1):  # events of a side meet the earlier ones of the other
                others, own = np.nonzero(side != s)[0], side[new] == s
                e = new[own]
                self._pairs(e, np.searchsorted(others, since[own]), np.searchsorted(others, e), others, number, weight, flip=s == 1)
        kept = ts > ts[-1] - self.window
        self.held = tuple(x[kept] for x in (ts, number, weight, side))

    def _pairs(self, events, begin, end, others, number, weight, flip: bool = False) -> None:
        counts = end - begin
        total = np.cumsum(counts)
        cuts = np.unique(np.append(np.searchsorted(total, np.arange(0, total[-1] if len(total) else 0, self.STEP), "right"), [0, len(events)]))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            c = counts[a:b]
            x = np.repeat(events[a:b], c)
            y = others[np.repeat(begin[a:b] - (np.cumsum(c) - c), c) + np.arange(len(x))]
            i, j, w = number[x], number[y], np.minimum(weight[x], weight[y])
            if self.one:
                i, j = np.minimum(i, j), np.maximum(i, j)
                i, j, w = i[i < j], j[i < j], w[i < j]
            elif flip:
                i, j = j, i
            at = i * len(self.sum) + j
            self.met.ravel()[at] = True
            if 8 * len(at) < self.sum.size:
                np.add.at(self.sum.ravel(), at, w)
            else:
                self.sum += np.bincount(at, w, self.sum.size).reshape(self.sum.shape)

    def batches(self):
        left, right = (np.array(list(k), np.int64) for k in (self.known[0], self.known[0 if self.one else 1]))
        i, j = np.nonzero(self.met)
        for at in range(0, len(i), 1 << 18):
            x, y = i[at : at + (1 << 18)], j[at : at + (1 << 18)]
            a, b = left[x], right[y]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(self.sum[x, y])], ["a", "b", "weight"])

    def changes(self, least: float, most: int, rejected: np.ndarray, low: np.ndarray, high: np.ndarray, linked: np.ndarray):
        """(a, b, weight, known) of pairs that reach least: those of the edges (low, high), known, and the others by which edges can come.
        Of these, those not linked already, the most smallest b of each a that are rejected and as many that are not."""
        left, right = (np.array(list(k), np.int64) for k in (self.known[0], self.known[0 if self.one else 1]))
        total, over = self.sum[: len(left), : len(right)], (self.met & (self.sum >= least))[: len(left), : len(right)]
        if self.one:
            total, over = total + total.T, over | over.T
        for rows, cols, weight, strong in ((left, right, total, over), (right, left, total.T, over.T))[: 1 if self.one else 2]:
            x, y = np.argsort(rows), np.argsort(cols)
            rows, cols, weight = rows[x], cols[y], weight[np.ix_(x, y)]
            strong = strong[np.ix_(x, y)] & (cols[None, :] > rows[:, None])
            if not strong.any():
                continue
            i, j = np.searchsorted(rows, low).clip(max=len(rows) - 1), np.searchsorted(cols, high).clip(max=len(cols) - 1)
            here = (rows[i] == low) & (cols[j] == high) & strong[i, j]
            found = [(i[here], j[here], True)]
            strong[i[here & linked], j[here & linked]] = False
            for gone in (np.isin(cols, rejected), ~np.isin(cols, rejected)):
                of = strong & gone[None, :]
                found.append((*np.nonzero(of & (np.cumsum(of, axis=1, dtype=np.int32) <= most)), False))
            for i, j, known in found:
                for at in range(0, len(i), 1 << 18):
                    u, v = i[at : at + (1 << 18)], j[at : at + (1 << 18)]
                    yield pa.RecordBatch.from_arrays([pa.array(rows[u]), pa.array(cols[v]), pa.array(weight[u, v]), pa.array(np.full(len(u), known))], ["a", "b", "weight", "known"])


def coactivation_pairs(log: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """log (memory_id, ts_ms, weight): (a, b, weight) of memories active less than pair_window_ms apart, a < b.

    Memories are dealt as pairs of blocks; a task reads the events of two in the order of time and holds their weights as a table, so no
    pair of events is a row, and no pair of memories is shuffled."""
    kind, window = log.schema["memory_id"].dataType, p.pair_window_ms
    rows = log.where("memory_id is not null and ts_ms is not null").select(F.col("memory_id").cast("long").alias("id"), F.col("ts_ms").cast("long").alias("ts"), F.col("weight").cast("double").alias("weight"))
    dealt, groups = blocks.split(rows, "id")

    def run(batches):
        at = state = None
        for batch in batches:
            lo, hi, own, ids, ts, weight = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("lo", "hi", "own", "id", "ts", "weight"))
            cuts = np.append(np.nonzero(np.append(True, (np.diff(lo) != 0) | (np.diff(hi) != 0)))[0], len(lo))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if at != (lo[a], hi[a]):
                    if state is not None:
                        yield from state.batches()
                    at, state = (lo[a], hi[a]), _Met(lo[a] == hi[a], window)
                state.add(ids[a:b], ts[a:b], weight[a:b], (own[a:b] != lo[a]).astype(np.int64))
        if state is not None:
            yield from state.batches()

    ordered = dealt.repartition(groups, "lo", "hi").sortWithinPartitions("lo", "hi", "ts", "id", "weight").select("lo", "hi", "own", "id", "ts", "weight")
    return ordered.mapInArrow(run, "a long, b long, weight double").select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b"), "weight")


def _changes(edges: DataFrame, log: DataFrame, p: Params) -> tuple[DataFrame, DataFrame]:
    """The ids of the memories that were active, and (a, b, weight, known) of the pairs of the log that change an edge or can become one that compact keeps: see _Met.changes. Edges
    between memories of the log come to where their pairs meet, so other pairs of memories never leave their task."""
    window, least, most = p.pair_window_ms, p.pair_min, p.max_degree
    events = weighted(log).where("memory_id is not null and ts_ms is not null")
    events = stored(events.select(F.col("memory_id").cast("long").alias("id"), F.col("ts_ms").cast("long").alias("ts"), F.col("weight").cast("double").alias("weight")))
    none = F.lit(None).cast("long")
    gone = log.where("signal = 'UserRejected'").select(F.col("memory_id").cast("long").alias("id")).distinct()
    rows = events.select("*", F.lit(0).alias("what"), none.alias("far")).unionByName(gone.select("id", none.alias("ts"), F.lit(None).cast("double").alias("weight"), F.lit(1).alias("what"), none.alias("far")))
    dealt, groups = blocks.split(rows.where("id is not null"), "id")
    active = _few(stored(events.select("id").distinct()))
    met = edges.where("src <> dst").select(F.least("src", "dst").cast("long").alias("id"), F.greatest("src", "dst").cast("long").alias("far"), ((F.col("link_type") == _kind(p)) & (F.col("src") < F.col("dst"))).alias("linked"))
    met = met.join(active, "id", "left_semi").join(active.withColumnRenamed("id", "far"), "far", "left_semi").groupBy("id", "far").agg(F.max("linked").alias("linked"))
    both = met.withColumn("x", blocks.own("id", groups)).withColumn("own", blocks.own("far", groups))
    both = both.select("id", none.alias("ts"), F.lit(None).cast("double").alias("weight"), F.when(F.col("linked"), 3).otherwise(2).alias("what"), "far", F.col("x").alias("own"), F.least("x", "own").alias("lo"), F.greatest("x", "own").alias("hi"))

    def run(batches):
        at = state = None
        rejected, low, high, linked = [], [], [], []

        def ended():
            whole = lambda parts, kind: np.concatenate([np.empty(0, kind), *parts])
            yield from state.changes(least, most, whole(rejected, np.int64), whole(low, np.int64), whole(high, np.int64), whole(linked, bool))

        for batch in batches:
            lo, hi, own, ids, what = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("lo", "hi", "own", "id", "what"))
            ts, weight, far = (batch.column(c).fill_null(0).to_numpy(zero_copy_only=False) for c in ("ts", "weight", "far"))
            cuts = np.append(np.nonzero(np.append(True, (np.diff(lo) != 0) | (np.diff(hi) != 0) | (np.diff(np.minimum(what, 2)) != 0)))[0], len(lo))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if at != (lo[a], hi[a]):
                    if state is not None:
                        yield from ended()
                    at, state = (lo[a], hi[a]), _Met(lo[a] == hi[a], window)
                    for part in (rejected, low, high, linked):
                        part.clear()
                if what[a] == 0:
                    state.add(ids[a:b], ts[a:b], weight[a:b], (own[a:b] != lo[a]).astype(np.int64))
                elif what[a] == 1:
                    rejected.append(ids[a:b])
                else:
                    low.append(ids[a:b])
                    high.append(far[a:b])
                    linked.append(what[a:b] == 3)
        if state is not None:
            yield from ended()

    ordered = dealt.unionByName(both).repartition(groups, "lo", "hi").sortWithinPartitions("lo", "hi", "what", "ts", "id", "weight").select("lo", "hi", "own", "id", "ts", "weight", "what", "far")
    return active, stored(ordered.mapInArrow(run, "a long, b long, weight double, known boolean"))


def _few(rows: DataFrame) -> DataFrame:
    """Rows that go to every task if there are few, else both sides of a join are shuffled."""
    return F.broadcast(rows) if rows.limit(FEW + 1).count() <= FEW else rows


def weighted(log: DataFrame) -> DataFrame:
    """The activation log's (memory_id, ts_ms, signal) with the weights of signals that activate."""
    return log.where(F.col("signal").isin(*SIGNAL_WEIGHT)).withColumn("weight", _signal(SIGNAL_WEIGHT))


def hebbian(edges: DataFrame, pairs: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Edges between the members of a pair that reached pair_min grow by hebbian_rate * min(weight, cap)."""
    low, high = (lambda x, y: F.least(x, y).alias("low")), (lambda x, y: F.greatest(x, y).alias("high"))
    strong = pairs.where(F.col("weight") >= p.pair_min).select(low("a", "b"), high("a", "b"), (p.hebbian_rate * F.least("weight", F.lit(p.hebbian_cap))).alias("d"))
    rows = edges.select("*", low("src", "dst"), high("src", "dst")).join(strong, ["low", "high"], "left")
    return rows.withColumn("strength", F.when(F.col("d").isNotNull(), F.least(F.lit(1.0), F.col("strength") + F.col("d"))).otherwise(F.col("strength"))).withColumn("activation_count", F.col("activation_count") + F.col("d").isNotNull().cast("long")).drop("d").select(*edges.columns)


def new_edges(edges: DataFrame, pairs: DataFrame, now_ms: int, p: Params = DEFAULT) -> DataFrame:
    """CoActivation edges a to b for strong pairs that have none."""
    kind = _kind(p)
    rows = pairs.where(F.col("weight") >= p.pair_min).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return _new(rows.join(edges.where(F.col("link_type") == kind).select("src", "dst"), ["src", "dst"], "left_anti"), now_ms, p)


def _kind(p: Params) -> str:
    return "Causal" if p.causal_coactivation else "CoActivation"


def _new(rows: DataFrame, now_ms: int, p: Params) -> DataFrame:
    return rows.select("src", "dst", F.lit(_kind(p)).alias("link_type"), F.lit(0.3).alias("strength"), F.lit(0.4).alias("confidence"), F.lit(True).alias("observing"), F.lit(now_ms).cast("long").alias("last_activated_at"), F.lit(0).cast("long").alias("activation_count"))


def reject(edges: DataFrame, rejected: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Edges with a rejected end lose hebbian_rate, down to the floor, and one count. rejected: (id)."""
    ids = _few(rejected.select("id").distinct())
    rows = edges.join(ids.select(F.col("id").alias("src"), F.lit(True).alias("r1")), "src", "left").join(ids.select(F.col("id").alias("dst"), F.lit(True).alias("r2")), "dst", "left")
    hit = F.col("r1").isNotNull() | F.col("r2").isNotNull()
    return rows.withColumn("strength", F.when(hit, F.greatest(F.lit(p.floor), F.col("strength") - p.hebbian_rate)).otherwise(F.col("strength"))).withColumn("activation_count", F.when(hit, F.greatest(F.lit(0), F.col("activation_count") - 1)).otherwise(F.col("activation_count")).cast("long")).select(*edges.columns)


def decay(edges: DataFrame, now_ms: int, p: Params = DEFAULT) -> DataFrame:
    """Unprotected edges follow the forgetting curve to the floor; those on observation that fall below it go."""
    kept = scores.protected(F.col("link_type"), F.col("observing"))
    faded = scores.forget(F.col("strength"), F.lit(now_ms) - F.col("last_activated_at"), F.col("activation_count"), p)
    rows = edges.withColumn("faded", F.when(kept, F.col("strength")).otherwise(faded)).where(kept | ~F.col("observing") | (F.round("faded", 9) >= p.floor))
    return rows.withColumn("strength", F.when(kept, F.col("strength")).otherwise(F.greatest(F.lit(p.floor), F.col("faded")))).drop("faded").select(*edges.columns)


def linear_decay(edges: DataFrame, now_ms: int, p: Params = DEFAULT) -> DataFrame:
    """The older rule: an edge idle for more than a day keeps idle_factor of its strength, down to the floor."""
    idle = F.lit(now_ms) - F.col("last_activated_at") > DAY_MS
    return edges.withColumn("strength", F.when(idle, F.greatest(F.col("strength") * p.idle_factor, F.lit(p.floor))).otherwise(F.col("strength")))


def compact_units(units: DataFrame, edges: DataFrame, now_ms: int, p: Params = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Edges of the floor's strength and more; active units (id, lifecycle, updated_at_ms) without any that are stale become Deprecated."""
    kept = edges.where(F.col("strength") >= p.floor)
    rows = units.join(kept.select(F.col("src").alias("id"), F.lit(True).alias("linked")).distinct(), "id", "left")
    gone = F.col("linked").isNull() & (F.lit(now_ms) - F.col("updated_at_ms") > p.stale_ms) & (F.col("lifecycle") == "Active")
    return rows.withColumn("lifecycle", F.when(gone, "Deprecated").otherwise(F.col("lifecycle"))).select(*units.columns), kept


def compact(edges: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Drops unprotected edges below the floor, then all but the max_degree strongest of each node."""
    rows = edges.where(scores.protected(F.col("link_type"), F.col("observing")) | (F.col("strength") >= p.floor))
    w = Window.partitionBy("src").orderBy(F.desc(F.round("strength", 9)), F.asc("dst"), F.asc("link_type"))
    return rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= p.max_degree).drop("n")


def cycle(edges: DataFrame, log: DataFrame, now_ms: int, p: Params = DEFAULT) -> DataFrame:
    """Hebbian change, new edges, rejection, forgetting, compaction. What the log's pairs change is stored, as it is read twice. Of new edges
    of a memory, all as strong but for rejection, only as many are made as compaction can keep."""
    kinds = [edges.schema[c].dataType for c in ("src", "dst")]
    active, changes = _changes(edges, log, p)
    known = _few(changes.where("known").select("a", "b", "weight"))
    new = changes.where("not known").select(F.col("a").cast(kinds[0]).alias("src"), F.col("b").cast(kinds[1]).alias("dst"))
    flag = lambda c: active.select(F.col("id").alias(c), F.lit(True).alias("of_" + c))
    met, marked = F.col("of_src").isNotNull() & F.col("of_dst").isNotNull(), edges.join(flag("src"), "src", "left").join(flag("dst"), "dst", "left")
    grown = hebbian(marked.where(met).select(*edges.columns), known, p).unionByName(marked.where(~met).select(*edges.columns))
    grown = grown.unionByName(_new(new, now_ms, p))
    rejected = log.where("signal = 'UserRejected'").select(F.col("memory_id").alias("id"))
    return compact(decay(reject(grown, rejected, p), now_ms, p), p)


def usage(log: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(memory_id, usage_score): signal deltas in the order of time, kept within 0 to 1 after each; before has earlier scores.

    Any run of clamped steps is x -> max(low, min(high, x + sum)), so each memory's days are folded to such steps on their
    own, and only these are put in order: a row never holds a memory's whole history."""
    rows = log.where(F.col("signal").isin(*USAGE_DELTA)).withColumn("delta", _signal(USAGE_DELTA))
    unit = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    step = lambda s, x: F.struct((s["sum"] + x["delta"]).alias("sum"), unit(s["low"] + x["delta"]).alias("low"), unit(s["high"] + x["delta"]).alias("high"))
    free = F.struct(F.lit(0.0).alias("sum"), F.lit(-1e9).alias("low"), F.lit(1e9).alias("high"))
    ordered = F.array_sort(F.collect_list(F.struct("ts_ms", "event_id", "delta")))
    days = rows.groupBy("memory_id", F.floor(F.col("ts_ms") / DAY_MS).alias("day")).agg(F.aggregate(ordered, free, step).alias("f"))
    whole = days.groupBy("memory_id").agg(F.array_sort(F.collect_list(F.struct("day", "f"))).alias("fs"))
    whole = whole.join(before.withColumnRenamed("usage_score", "old"), "memory_id", "full") if before is not None else whole.withColumn("old", F.lit(None).cast("double"))
    then = lambda x, d: F.greatest(d["f"]["low"], F.least(d["f"]["high"], x + d["f"]["sum"]))
    return whole.select("memory_id", F.when(F.col("fs").isNull(), F.col("old")).otherwise(F.aggregate("fs", F.coalesce("old", F.lit(0.5)), then)).alias("usage_score"))


def context_links(log: DataFrame, before: DataFrame | None = None, p: Params = DEFAULT) -> DataFrame:
    """log (feature, memory_id, ts_ms, signal): positive signals strengthen, so the sum, capped, is exact; before has earlier links."""
    rows = log.where(F.col("signal").isin(*POSITIVE_SIGNALS))
    new = rows.groupBy("feature", "memory_id").agg((p.path_delta * F.count("*")).alias("strength"), F.count("*").alias("review_count"), F.max("ts_ms").alias("last_reviewed_at"))
    both = new if before is None else new.unionByName(before)
    return both.groupBy("feature", "memory_id").agg(F.least(F.lit(1.0), F.sum("strength")).alias("strength"), F.sum("review_count").alias("review_count"), F.max("last_reviewed_at").alias("last_reviewed_at"))


def coactivation_counts(results: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """results (retrieval_id, memory_id, ts_ms): for each memory the recent_bound latest companions with counts."""
    r = results.select("retrieval_id", "memory_id", "ts_ms").distinct()
    pairs = r.join(r.select("retrieval_id", F.col("memory_id").alias("other")).distinct(), "retrieval_id").where("memory_id <> other")
    n = pairs.groupBy("memory_id", "other").agg(F.count("*").alias("n"), F.max("ts_ms").alias("last_at"))
    w = Window.partitionBy("memory_id").orderBy(F.desc("last_at"), F.asc("other"))
    return n.withColumn("place", F.row_number().over(w)).where(F.col("place") <= p.recent_bound)


def reinforce_paths(edges: DataFrame, paths: DataFrame, now_ms: int, p: Params = DEFAULT) -> DataFrame:
    """paths (src, dst), one row for each confirmed use: strength grows by path_delta each, capped; no edge is made."""
    n = paths.groupBy("src", "dst").agg(F.count("*").alias("uses"))
    rows = edges.join(n, ["src", "dst"], "left")
    used = F.col("uses").isNotNull()
    return rows.withColumn("strength", F.when(used, F.least(F.lit(1.0), F.col("strength") + p.path_delta * F.col("uses"))).otherwise(F.col("strength"))).withColumn("activation_count", F.col("activation_count") + F.coalesce("uses", F.lit(0))).withColumn("last_activated_at", F.when(used, F.lit(now_ms).cast("long")).otherwise(F.col("last_activated_at"))).select(*edges.columns)


def redirect(edges: DataFrame, compressed: DataFrame) -> DataFrame:
    """Edges to a compressed memory point to its summary. compressed: (id, into)."""
    rows = edges.join(compressed.select(F.col("id").alias("dst"), "into"), "dst", "left")
    return rows.withColumn("dst", F.coalesce("into", "dst")).where("src <> dst").select(*edges.columns)
