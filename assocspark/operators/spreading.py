"""Spreading activation over the edge table, all queries at once."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import merge_energies, passed_energy
from ..params import DEFAULT, Params
from . import fusion

_PRODUCT = F.round  # orders must not depend on the last bits of a product


def strongest(edges: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Each node's fan_out strongest edges with their order."""
    w = Window.partitionBy("src").orderBy(F.desc(_PRODUCT(F.col("strength") * F.col("confidence"), 9)), F.asc("dst"), F.asc("link_type"))
    return edges.withColumn("edge_rank", F.row_number().over(w)).where(F.col("edge_rank") <= p.fan_out).select("src", "dst", "link_type", "strength", "confidence", "edge_rank")


def spread(seeds: DataFrame, edges: DataFrame, p: Params = DEFAULT, hops: int | None = None) -> DataFrame:
    """seeds: (query_id, id, energy, fused). Returns (query_id, id, energy, hop, n_paths, trace).

    A hop is one join of the frontier to the capped edges, without the ids already reached; energies that
    meet fold in the order of the frontier and of the edges. The loop's length is max_hops. Lineage is cut
    by checkpoint() if a checkpoint folder is set."""
    hops = p.max_hops if hops is None else hops
    top = strongest(edges, p)  # every hop reads it
    top = top.checkpoint() if edges.sparkSession.sparkContext.getCheckpointDir() else top
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(_PRODUCT("fused", 9)), F.asc("id")))
    frontier = seeds.select("query_id", "id", "energy", order.alias("ord"), F.array(F.struct(F.lit(None).cast(edges.schema["src"].dataType).alias("src"), F.col("id").cast(edges.schema["src"].dataType).alias("dst"), F.lit(None).cast("string").alias("link_type"), F.lit(0).alias("hop"), F.col("energy").alias("energy"))).alias("trace"))
    reached = frontier.select("query_id", "id", "energy", F.lit(0).alias("hop"), F.lit(1).cast("long").alias("n_paths"), "trace")
    saved = bool(edges.sparkSession.sparkContext.getCheckpointDir())
    for hop in range(1, hops + 1):
        moves = frontier.withColumnRenamed("id", "src").join(top, "src").withColumn("e", passed_energy(F.col("energy"), F.col("strength"), F.col("confidence"), hop, F.col("link_type"), p))
        moves = moves.where(F.col("e") >= p.min_energy).withColumnRenamed("dst", "id").join(reached.select("query_id", "id"), ["query_id", "id"], "left_anti")
        step = F.struct("src", F.col("id").alias("dst"), "link_type", F.lit(hop).alias("hop"), F.col("e").alias("energy"))
        moves = moves.withColumn("path", F.concat("trace", F.array(step)))
        folded = moves.groupBy("query_id", "id").agg(F.array_sort(F.collect_list(F.struct("ord", "edge_rank", "e"))).alias("es"), F.min_by("path", F.struct("ord", "edge_rank")).alias("trace"))
        met = folded.select("query_id", "id", merge_energies(F.transform("es", lambda x: x["e"]), p).alias("energy"), F.lit(hop).alias("hop"), F.size("es").cast("long").alias("n_paths"), "trace")
        if saved:
            met = met.checkpoint()
        reached = reached.unionByName(met)
        order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(_PRODUCT("energy", 9)), F.asc("id")))
        frontier = met.select("query_id", "id", "energy", order.alias("ord"), "trace")
    return reached


def one_hop(seeds: DataFrame, edges: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Without merging: the first arrival, in the order of seeds and edges, wins."""
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(_PRODUCT("fused", 9)), F.asc("id")))
    own = seeds.select("query_id", "id", "energy", order.alias("ord"))
    moves = own.withColumnRenamed("id", "src").join(strongest(edges, p), "src").withColumn("e", passed_energy(F.col("energy"), F.col("strength"), F.col("confidence"), 1, F.col("link_type"), p)).where(F.col("e") >= p.min_energy)
    moves = moves.withColumnRenamed("dst", "id").join(own.select("query_id", "id"), ["query_id", "id"], "left_anti")
    first = moves.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "id").orderBy("ord", "edge_rank"))).where("n = 1")
    return own.select("query_id", "id", "energy", F.lit(0).alias("hop")).unionByName(first.select("query_id", "id", F.col("e").alias("energy"), F.lit(1).alias("hop")))


def trace_text(trace):
    """seed=1 -Type->2 (e=0.123) ..."""
    steps = F.transform(F.slice(trace, F.lit(2), F.size(trace)), lambda s: F.concat(F.lit("-"), s["link_type"], F.lit("->"), s["dst"].cast("string"), F.format_string(" (e=%.3f)", s["energy"])))
    return F.concat(F.lit("seed="), F.element_at(trace, 1)["dst"].cast("string"), F.when(F.size(trace) > 1, F.concat(F.lit(" "), F.array_join(steps, " "))).otherwise(""))


def traverse(start: DataFrame, edges: DataFrame, direction: str = "out", depth: int = 1, types: list[str] | None = None) -> DataFrame:
    """Breadth-first search from start (id): (id, depth) of first visits. depth is kept within 1 to 5. A round's lineage is cut if a
    checkpoint folder is set."""
    saved = bool(edges.sparkSession.sparkContext.getCheckpointDir())
    e = edges.where(F.col("link_type").isin(types)) if types else edges
    out, into = e.select("src", "dst"), e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    hops = {"out": out, "in": into, "both": out.union(into)}[direction]
    seen = start.select("id", F.lit(0).alias("depth"))
    frontier = seen
    for d in range(1, min(5, max(1, depth)) + 1):
        frontier = frontier.withColumnRenamed("id", "src").join(hops, "src").select(F.col("dst").alias("id")).distinct().join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(d))
        frontier = frontier.checkpoint() if saved else frontier
        seen = seen.unionByName(frontier)
    return seen


def traversed_edges(seen: DataFrame, edges: DataFrame, direction: str = "out", depth: int = 1, types: list[str] | None = None) -> DataFrame:
    """The edges that a traversal with these nodes (id, depth) went along: those of each node that it expanded, which are all but the
    last round's. One that is met from both ends is there twice, with the end it was met from in `at`."""
    e = edges.where(F.col("link_type").isin(types)) if types else edges
    from_ = seen.where(F.col("depth") < min(5, max(1, depth))).select(F.col("id").alias("at"))
    parts = [e.join(from_, F.col(end) == F.col("at")) for name, end in (("out", "src"), ("in", "dst")) if direction in (name, "both")]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def spread_seeds(seeds: DataFrame, edges: DataFrame, importance: DataFrame, p: Params = DEFAULT, hops: int | None = None) -> DataFrame:
    """Seeds of several channels (query_id, id, channel, score, rank) to activated memories: by reciprocal ranks if any seed has a
    rank, else by the largest score."""
    ranked = not seeds.where("rank is not null").isEmpty()
    fused = fusion.fuse(seeds, p if ranked else replace(p, rrf_k=0.0))
    return spread(fusion.energised(fused, importance, p), edges, p, hops)
