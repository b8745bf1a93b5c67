"""Score arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import DEFAULT, PROTECTED, TYPE_MODIFIER, Params


def clamp01(x: Column) -> Column:
    return F.when(F.isnan(x), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v)


def sign_code(v: Column) -> Column:
    """64 sign bits of a vector as a long."""
    bits = F.transform(F.slice(v, 1, 64), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda s, b: s.bitwiseOR(b))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def type_modifier(link_type: Column) -> Column:
    out = F.when(F.lit(False), 0.0)
    for name, value in TYPE_MODIFIER.items():
        out = out.when(link_type == name, value)
    return out.otherwise(1.0)


def forget(strength: Column, age_ms: Column, count: Column, p: Params = DEFAULT) -> Column:
    """The forgetting curve: the half-life doubles with each review, max_doublings times at most."""
    return strength * F.pow(F.lit(0.5), F.greatest(age_ms, F.lit(0)) / (p.half_life_ms * F.pow(F.lit(2.0), F.least(count, F.lit(p.max_doublings)))))


def protected(link_type: Column, observing: Column) -> Column:
    return ~observing & link_type.isin(*PROTECTED)


def seed_energy(norm: Column, importance: Column, p: Params = DEFAULT) -> Column:
    return F.least(norm * p.a_query * (1 + importance * p.c_importance), F.lit(p.energy_cap))


def initial_energy(channel: Column, query: Column, context: Column, importance: Column, freshness: Column, reliability: Column, p: Params = DEFAULT) -> Column:
    """The full seed energy, of which seed_energy is the part that the engine uses."""
    coefficient = F.when(channel == "SemanticDense", 1.2).when(channel == "SemanticBinary", 0.6).otherwise(1.0)
    raw = coefficient * query * p.a_query * (1 + importance * p.c_importance) + context * p.b_context + freshness * p.d_freshness + reliability * p.e_reliability
    return F.greatest(F.lit(0.0), F.least(raw, F.lit(p.energy_cap)))


def passed_energy(energy: Column, strength: Column, confidence: Column, hop: int, link_type: Column, p: Params = DEFAULT) -> Column:
    return clamp01(energy * strength * confidence * p.hop_decay**hop * type_modifier(link_type))


def merge_energies(ordered: Column, p: Params = DEFAULT) -> Column:
    """Folds energies in their order: the larger plus a share of the smaller."""
    return F.aggregate(ordered, F.lit(0.0), lambda s, e: F.greatest(s, e) + p.merge_secondary * F.least(s, e))


def cold_start(total: Column, p: Params = DEFAULT) -> Column:
    return F.when(total < p.cold_start, p.cold_penalty).when(total >= 2 * p.cold_start, 1.0).otherwise(p.cold_penalty + (1 - p.cold_penalty) * (total - p.cold_start) / p.cold_start)


def overlap_ratio(n: Column, dims: Column) -> Column:
    return F.least(F.lit(1.0), n / F.greatest(dims, F.lit(1)))
