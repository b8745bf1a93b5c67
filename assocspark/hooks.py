"""What can be exchanged: models that read texts, and the index that finds vectors. Each hook makes column expressions or DataFrames,
so a hook of SQL functions stays in the plan, and one that calls out is an Arrow UDF of its own."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import signatures, text
from .operators import channels, rerank, summaries


class Extractor(Protocol):
    """Columns of what a text says."""

    def entities(self, t: Column) -> Column: ...

    def topics(self, t: Column) -> Column: ...

    def causal(self, t: Column) -> Column: ...

    def importance(self, t: Column, content_type: Column) -> Column: ...


#: Nearest vectors of each query: (queries (query_id, q), vectors (id, embedding), k) to (query_id, id, channel, score, ord).
Index = Callable[[DataFrame, DataFrame, int], DataFrame]


@dataclass(frozen=True)
class Models:
    """extractor: the module or object that reads texts. embed: text to array<double>. token_hash: token to long, for SimHash.
    rerank: (query, content) to a score that is added to the energy, or None. summarise: members (leader, id, text) to
    (leader, summary, confidence). dense, binary: the indexes."""

    extractor: Extractor = text
    embed: Callable[[Column], Column] = signatures.hash_embedding
    token_hash: Callable[[Column], Column] = F.xxhash64
    rerank: Callable[[Column, Column], Column] | None = None
    summarise: Callable[[DataFrame], DataFrame] = summaries.summary
    dense: Index = channels.dense_channel
    binary: Index = channels.binary_channel


HASH = Models()
DIGEST = replace(HASH, embed=signatures.digest_embedding, token_hash=signatures.digest_hash)
BACKENDS = {"hash": HASH, "digest": DIGEST, "lexical": replace(HASH, rerank=rerank.lexical_overlap)}


def models(name: str = "hash") -> Models:
    """A backend by name. Neural and remote ones need files or a network, so none is registered; pass Models of your own."""
    if name not in BACKENDS:
        raise ValueError(f"no backend {name}; there are {', '.join(BACKENDS)}")
    return BACKENDS[name]
