"""Toxicity of texts that may be written in leetspeak, spaced out or with repeated letters.

A trigram model of characters is counted over all texts. A token with anything but letters in it, or with a
letter twice in a row, and a run of single letters, becomes a lattice of readings: a sign is a letter, or at the token's edge or between letters
nothing or a blank; a repeated letter stands once or twice. Viterbi decoding under the model picks one, and the plain reading
stays where it is likeliest. Words that the scorer knows are a word model: a lattice that spells one is read so unless another
reading is likelier by WORD_BONUS. The restored text is scored by logistic regression over counts of words and word beginnings, learnt from the restored
texts of labelled rows (at most train_rows of them); its weights are evidence for and against, and its outputs are calibrated as probabilities on them.

Limits: words split into parts of several letters by blanks ("id iot") stay split, and a token with less than a third of letters is read as a number.

Defined cases: null and empty texts get the score of a text without any known word. Labels that
are null, or whose document is missing, teach nothing. Without any usable toxic and clean label every score is
0.0. Repeated rows are scored alike. Of repeated labels the smallest counts; of rows that share a labelled id at most train_rows teach. Letters outside a-z are
letters to the lattice, and one symbol to the model. A very long text is one Arrow value and one string in its task. Columns other than id and
text play no part, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches
from .kernels import buffers, joined, utf8

#: Labelled rows that teach the scorer, chosen by a hash of the id.
TRAIN_ROWS = 20_000
#: Features kept, those that tell classes apart best among those that MIN_TOXIC toxic texts have.
FEATURES, MIN_TOXIC = 2_000, 3
PREFIXES = (4, 5, 6, 8)
#: Training: weight of the squared weights, steps, and their size.
RIDGE, STEPS, RATE = 1.0, 300, 0.05
#: What a sign may stand for, and log probabilities of a sign at a token's edge that stands for nothing.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "*": "aeiou"}
EDGE_SIGN = {"!": 0.0, "|": 0.0, "+": 0.0, "*": -1.0, "@": -3.0, "$": -3.0}
EDGE_DIGIT, WORD_BONUS = -2.0, 6.0
#: Tokens whose features a task remembers.
REMEMBERED = 300_000

_SYMBOLS = 28  # 0: outside of a word, 1-26: a-z, 27: any other letter
_CODE = np.zeros(256, np.int32)
_CODE[97:123] = _CODE[65:91] = np.arange(1, 27)
_CODE[128:] = 27

_WORD = re.compile(r"[^\W\d_]+")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W_]|[@$!|+])(?:[ .\-_*]{1,2}(?:[^\W_]|[@$!|+])){2,}(?![^\W_])")
_ODD = re.compile(r"[\W\d_]|(.)\1")
_RUN = re.compile(r"(.)\1*", re.S)
_EDGE = ".,;:?\"'()[]{}<>&%#=~^/\\-_"


def count_trigrams(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of character trigrams over all texts; their number is fixed by the alphabet."""

    def run(batches):
        total = np.zeros(_SYMBOLS**3, np.int64)
        for batch in buffers(batches):
            text = joined(*utf8(batch.column(1)))[0]
            x = _CODE[text[text & 0xC0 != 0x80]]  # a letter counts once, however many bytes it has
            if len(x) > 2:
                x = (x[:-2] * _SYMBOLS + x[1:-1]) * _SYMBOLS + x[2:]
                total += np.bincount(x, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["gram", "n"])

    rows = docs.select(F.lit(0).alias("z"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(_SYMBOLS**3, np.int64)
    for r in rows:
        out[r.gram] = r.n
    return out


def language_model(counts: np.ndarray) -> np.ndarray:
    """Log probability of a symbol after two others, smoothed."""
    n = counts.reshape(_SYMBOLS * _SYMBOLS, _SYMBOLS).astype(float)
    back = n.reshape(_SYMBOLS, _SYMBOLS, _SYMBOLS).sum(axis=0) + 0.5
    back /= back.sum(axis=1, keepdims=True)
    return np.log((n + 8 * np.tile(back, (_SYMBOLS, 1))) / (n.sum(axis=1, keepdims=True) + 8))


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each place of a lower-case token what may be read there, with its log probability besides the language model's."""
    runs: list[tuple[str, int]] = []
    for c in token:
        if runs and runs[-1][0] == c:
            runs[-1] = c, runs[-1][1] + 1
        else:
            runs.append((c, 1))
    letters = [i for i, (c, _) in enumerate(runs) if c.isalpha()] or [len(runs)]
    out: list[list[tuple[str, float]]] = []
    for i, (c, n) in enumerate(runs):
        if c.isalpha():
            out.append([(c, 0.0)] if n == 1 else [(c, 0.0), (c + c, 0.0)])
        elif c in LEET:
            reads = [(x, 0.0) for x in LEET[c]]
            if not letters[0] < i < letters[-1]:
                reads.append(("", EDGE_SIGN.get(c, EDGE_DIGIT)))
            out.extend([reads] * min(n, 2))
        else:
            out.append([("", 0.0), (" ", 0.0)])
    return out


def _symbol(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 0 if c == " " else 27


def score_reading(text: str, model: list[float], extra: float = 0.0) -> float:
    """Log probability of a reading between blanks under the flattened model."""
    x = y = 0
    for c in text + " ":
        z = _symbol(c)
        extra += model[(x * _SYMBOLS + y) * _SYMBOLS + z]
        x, y = y, z
    return extra


def spelled(places: list[list[tuple[str, float]]], words: dict) -> list[tuple[float, str]]:
    """Words of a trie that a lattice spells, with the log probability of the signs on the way."""
    nodes = {id(words): (words, 0.0)}
    for options in places:
        step: dict[int, tuple[dict, float]] = {}
        for node, at in nodes.values():
            for o, cost in options:
                to = node
                for c in o:
                    to = to.get(c)
                    if to is None:
                        break
                if to is not None and (id(to) not in step or step[id(to)][1] < at + cost):
                    step[id(to)] = to, at + cost
        nodes = step
        if not nodes:
            return []
    return [(at, node[""]) for node, at in nodes.values() if "" in node]


def once_or_twice(token: str, model: list[float]) -> str:
    """decode() of letters alone: whether a run stands once or twice changes nothing but its own second letter and the letter behind it."""
    out, b = [], 0
    for m in _RUN.finditer(token):
        c, z = m[1], _symbol(m[1])
        if m.end() - m.start() > 1:
            d = _symbol(token[m.end()]) if m.end() < len(token) else 0
            row, own = (b * _SYMBOLS + z) * _SYMBOLS, (z * _SYMBOLS + z) * _SYMBOLS
            if model[row + z] + model[own + d] >= model[row + d]:
                out.append(c)
        out.append(c)
        b = z
    return "".join(out)


def decode(token: str, model: list[float], words: dict | None = None) -> str:
    """The likeliest reading of a lower-case token. words: a trie of known words, {letter: trie, "": word}."""
    places = lattice(token)
    known = spelled(places, words) if words else []
    if not known and token.isalpha():
        return once_or_twice(token, model)
    best = {(0, 0): (0.0, "")}
    for options in [*places, [(" ", 0.0)]]:
        after: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (score, text) in best.items():
            for o, cost in options:
                x, y, s = a, b, score + cost
                for c in o:
                    z = _symbol(c)
                    s += model[(x * _SYMBOLS + y) * _SYMBOLS + z]
                    x, y = y, z
                have = after.get((x, y))
                if have is None or (s, text + o) > have:
                    after[x, y] = s, text + o
        best = after
    score, text = max(best.values())
    if known:
        sure, word = max((score_reading(w, model, at), w) for at, w in known)
        if sure + WORD_BONUS >= score:
            return word
    return text.strip()


def trie(words) -> dict:
    root: dict = {}
    for w in words:
        node = root
        for c in w:
            node = node.setdefault(c, {})
        node[""] = w
    return root


class Reader:
    """Restores texts and takes features out of them. keep: {feature: anything} to look features up in, or None for all."""

    def __init__(self, model: np.ndarray, keep: dict | None = None, words: dict | None = None):
        self.model, self.keep, self.words = model.ravel().tolist(), keep, words
        self.known: dict[str, tuple] = {}

    def restore(self, token: str) -> str:
        """A lower-case token without what surrounds it, decoded if it is odd."""
        core = token.strip(_EDGE)
        if _ODD.search(core) is None or 3 * sum(map(str.isalpha, core)) < len(core):
            return core
        return decode(core, self.model, self.words)

    def of_token(self, token: str) -> tuple:
        found = self.known.get(token)
        if found is None:
            found, keep = [], self.keep
            for w in _WORD.findall(self.restore(token)):
                n = len(w)
                for f in ("=" + w, *[w[:k] for k in PREFIXES if k <= n]):
                    if keep is None:
                        found.append(f)
                    elif f in keep:
                        found.append(keep[f])
            found = tuple(found)
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[token] = found
        return found

    def tokens(self, text: str | None) -> list[str]:
        return _SPACED.sub(lambda m: decode(m[0], self.model, self.words), (text or "").lower()).split()

    def features(self, text: str | None) -> Counter:
        out: Counter = Counter()
        for token, n in Counter(self.tokens(text)).items():
            for f in self.of_token(token):
                out[f] += n
        return out


def fit(rows: list[tuple[int, list[int], list[float]]], width: int) -> tuple[np.ndarray, float]:
    """Weights and bias of a ridge logistic regression on sparse rows (label, columns, values)."""
    y = np.array([r[0] for r in rows], float)
    at = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    col = np.array([c for r in rows for c in r[1]], np.int64)
    val = np.array([v for r in rows for v in r[2]], float)
    w = np.zeros(width + 1)
    w[-1] = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(at, val * w[col], len(y)) + w[-1], -50, 50)))
        g = np.append(np.bincount(col, val * (p - y)[at], width) + RIDGE * w[:-1], (p - y).sum())
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        w -= RATE * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
    return w[:-1], float(w[-1])


def learn(docs: DataFrame, labels: DataFrame, model: np.ndarray, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS, held_out: int = 5) -> dict:
    """{feature: weight} and the bias, or no bias without labels of both kinds. Rows with crc32(id as text) mod held_out = 0 teach nothing."""
    labels = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).where("id is not null and toxic in (0, 1)")
    labels = labels.where(F.crc32(F.col("id").cast("string")) % held_out != 0).groupBy("id").agg(F.min("toxic").alias("toxic"))
    sample = F.broadcast(labels.orderBy(F.xxhash64("id"), "id").limit(train_rows))  # at most train_rows pairs of numbers
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(sample, "id").select("toxic", "text")
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        reader, count, seen = Reader(known.value), (Counter(), Counter()), [0, 0]
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                count[toxic].update(reader.features(text.as_py()).keys())
                seen[toxic] += 1
        keys = list(count[0].keys() | count[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(["", *keys]), pa.array([seen[0], *(count[0][k] for k in keys)], pa.int64()), pa.array([seen[1], *(count[1][k] for k in keys)], pa.int64())], ["feature", "clean", "toxic"])

    totals = texts.mapInArrow(run, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    seen = texts.groupBy("toxic").count().collect()  # two rows
    clean, toxic = (max([r["count"] for r in seen if r.toxic == k], default=0) for k in (0, 1))
    if not toxic or not clean:
        return {"weights": {}, "bias": None}
    apart = (F.col("toxic") / toxic - F.col("clean") / clean) / F.sqrt(F.col("toxic") + F.col("clean") + 1)
    rows = totals.where((F.col("feature") != "") & (F.col("toxic") >= MIN_TOXIC)).orderBy(apart.desc(), "feature").limit(FEATURES).collect()
    place = {r.feature: i for i, r in enumerate(rows)}

    def which(batches):
        reader = Reader(known.value, place)
        for batch in batches:
            found = [sorted(reader.features(t.as_py()).items()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), pa.array([[i for i, _ in f] for f in found], pa.list_(pa.int32())), pa.array([[math.log1p(n) for _, n in f] for f in found], pa.list_(pa.float64()))], ["toxic", "at", "value"])

    # one row for each taught text, of FEATURES numbers at most; in a fixed order, so that sums are the same each time
    taught = texts.mapInArrow(which, "toxic int, at array<int>, value array<double>").orderBy("toxic", "at", "value").limit(train_rows).collect()
    weights, bias = fit([tuple(r) for r in taught], len(place))
    return {"weights": dict(zip(place, weights.tolist(), strict=True)), "bias": bias}


def scorer(spark, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS):
    """A column function text -> score, with what it needs learnt from all of docs and the labels."""
    bounded_batches(spark)
    model = language_model(count_trigrams(docs, text_col))
    known = spark.sparkContext.broadcast((model, learn(docs, labels, model, id_col, text_col, train_rows)))

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model, learnt = known.value
        weights, bias = learnt["weights"], learnt["bias"]
        reader = Reader(model, {f: f for f in weights}, trie(f[1:] for f, w in weights.items() if f[0] == "=" and w > 0))

        def of(text: str) -> float:
            if bias is None:
                return 0.0
            total = bias + math.fsum(weights[f] * math.log1p(n) for f, n in reader.features(text).items())
            return 1 / (1 + math.exp(-min(max(total, -500.0), 500.0)))

        for part in parts:
            yield pd.Series([of(t if isinstance(t, str) else "") for t in part], dtype="float64")

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Returns doc_id, held_out, score, predicted for each row of docs."""
    score = scorer(docs.sparkSession, docs, labels, id_col, text_col, train_rows)
    out = docs.select(F.col(id_col).alias("doc_id"), (F.crc32(F.col(id_col).cast("string")) % 5 == 0).alias("held_out"), score(F.col(text_col).cast("string")).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
