"""Transcripts to canonical chat turns: roles by a hidden Markov model over lines, decoded by Viterbi.

A line's state is its turn's role and its place in the turn: first, inner, last, or the only line. A state emits a
speaker marker (or none) at the line's start, whether the line ends with a question mark, and its length. Which role
follows which, and what each state emits, is counted over labelled turns. Where turns begin is not given: a line begins
one only if the best path says so, and how a transcript is cut into fragments tells the model nothing.

A transcript may be very long, so decoding is done in blocks: each block of BLOCK fragments is a
max-plus matrix from the state before it to the state at its end; matrices of FAN neighbours are
multiplied, level by level, until one is left for each transcript. The best end state then goes
down the same tree, and each block is decoded between the two states found for it. That is the
same path as Viterbi decoding of the whole transcript, and no task holds more than a block. Matrices are made
from codes of one byte a line, so texts are read only to code and to render them.

Defined cases: a null text is one empty line. A null turn counts as 0; rows with a null transcript
id are left out. Fragments with equal id and turn are in the order of a hash of their texts, repeated rows one after another.
Without labelled turns, roles follow markers. Roles outside ROLES teach nothing. A very long fragment takes one byte a line
and its own text in a task. Columns other than those named play no part, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, discard, written

ROLES = ("system", "user", "assistant", "tool")
#: Fragments to a block, nodes to a parent, rows and bytes of text to a group of blocks that a task reads at once.
BLOCK, FAN, GROUP_ROWS, GROUP_BYTES = 256, 64, 2_000, 8 << 20
#: Names that markers use.
NAMES = {"system": "system|instructions?|context", "user": "user|human|you|question|q|customer|client", "assistant": "assistant|ai|bot|model|answer|a|agent|gpt", "tool": "tool|function|observation"}
_NAMED = "|".join(f"(?P<{r}>{n})" for r, n in NAMES.items())
_MARKER = re.compile(rf"\s*(?:#{{1,4}}\s*(?:{_NAMED})\s*:?\s*$|(?:<\|?|\[|\*\*)(?:{_NAMED.replace('(?P<', '(?P<b')})(?:\|?>|\]|:?\*\*):?\s*|(?:{_NAMED.replace('(?P<', '(?P<c')})\s*[:>]\s+)", re.I)
#: A state is 4 * role + place.
FIRST, INNER, LAST, ONLY = range(4)
STATES = 4 * len(ROLES)
START = STATES  # the state before a transcript
LENGTHS = 6
CODES = (1 + len(ROLES)) * 2 * LENGTHS
#: Fixed values, added to the counts: a marker seldom lies, and only a turn's first line has one.
OWN_MARKER, NO_MARKER = 20.0, 5.0


def marker(line: str) -> tuple[int, int]:
    """(role that the line's marker names or -1, length of the marker)."""
    m = _MARKER.match(line)
    if not m or not m.end():
        return -1, 0
    return ROLES.index(m.lastgroup if m.lastgroup in ROLES else m.lastgroup[1:]), m.end()


def code(line: str) -> int:
    """What a state emits: marker, question mark and length, as one number under CODES."""
    bare = line.rstrip()
    return ((marker(line)[0] + 1) * 2 + bare.endswith("?")) * LENGTHS + min(LENGTHS - 1, len(bare) // 16)


def codes(text: str | None) -> np.ndarray:
    return np.array([code(x) for x in (text or "").split("\n")], np.uint8)


def _rows(turns: DataFrame, conv_col: str, turn_col: str, text_col: str, *more: Column) -> DataFrame:
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.coalesce(F.col(turn_col).cast("long"), F.lit(0)).alias("turn"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *more)
    return rows.where("conv_id is not null")


def learn(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From labelled turns, each with its raw text: log probabilities of a role after a role (the start's row last), that a turn
    ends with its first line and with each later one (role x 2), and of a code in a state."""
    bounded_batches(turns.sparkSession)
    rows = _rows(turns, conv_col, turn_col, text_col, F.lower(F.col(role_col)).alias("role")).where(F.col("role").isin(*ROLES))
    n = len(ROLES)
    change, seen, emit = np.ones((n + 1, n)), np.ones((n, 4)), np.full((STATES, CODES), 0.05)
    for r in range(n):
        for place in range(4):
            begins = place in (FIRST, ONLY)
            emit[4 * r + place, : 2 * LENGTHS] += (NO_MARKER if begins else OWN_MARKER) / (2 * LENGTHS)
            if begins:
                emit[4 * r + place, (r + 1) * 2 * LENGTHS : (r + 2) * 2 * LENGTHS] += OWN_MARKER / (2 * LENGTHS)
    after = rows.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("role").alias("p")).distinct()
    for x in rows.select("conv_id", "turn", "role").join(after, ["conv_id", "turn"], "left").groupBy("p", "role").count().collect():  # 20 at most
        change[ROLES.index(x.p) if x.p else n, ROLES.index(x.role)] += x["count"]

    empty = pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 3, ["state", "code", "n"])

    def count(batches):
        total: Counter = Counter()
        for batch in batches:
            for role, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                line = codes(text.as_py()).tolist()
                state = 4 * ROLES.index(role)
                places = [ONLY] if len(line) == 1 else [FIRST, *[INNER] * (len(line) - 2), LAST]
                total.update(zip((state + p for p in places), line, strict=True))
        yield _table([(*k, v) for k, v in total.items()], ("state", pa.int64()), ("code", pa.int64()), ("n", pa.int64())).combine_chunks().to_batches()[0] if total else empty

    for x in rows.select("role", "text").mapInArrow(count, "state long, code long, n long").groupBy("state", "code").agg(F.sum("n").alias("n")).collect():  # STATES * CODES at most
        emit[x.state, x.code] += x.n
        seen[x.state // 4, x.state % 4] += x.n
    ends = np.stack([seen[:, ONLY] / (seen[:, ONLY] + seen[:, FIRST]), seen[:, LAST] / (seen[:, LAST] + seen[:, INNER])], axis=1)
    return np.log(change / change.sum(axis=1, keepdims=True)), ends, np.log(emit / emit.sum(axis=1, keepdims=True))


class Model:
    def __init__(self, change: np.ndarray, ends: np.ndarray, emit: np.ndarray):
        """step[code] has the score of every move from a state (START last) into a state that emits the code."""
        move = np.full((STATES + 1, STATES), -1e9)
        for r in range(len(ROLES)):
            one, last = np.log(ends[r]), np.log1p(-ends[r])
            s = 4 * r
            for place in (FIRST, INNER):  # the turn goes on
                move[s + place, s + LAST], move[s + place, s + INNER] = one[1], last[1]
            for before in range(len(ROLES)):
                for place in (LAST, ONLY):
                    move[4 * before + place, s + ONLY] = change[before, r] + one[0]
                    move[4 * before + place, s + FIRST] = change[before, r] + last[0]
            move[START, s + ONLY], move[START, s + FIRST] = change[-1, r] + one[0], change[-1, r] + last[0]
        self.step = move[None] + emit.T[:, None, :]
        self.end = np.where(np.isin(np.arange(STATES) % 4, (LAST, ONLY)), 0.0, -50.0)  # a transcript seldom stops within a turn


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product; b's last row, that of the start, has no part."""
    return (a[..., :, :, None] + b[..., None, :STATES, :]).max(axis=-2)


def products(runs: list[np.ndarray], model: Model) -> list[np.ndarray]:
    """The matrix of each run of codes, all runs a step at a time."""
    order = sorted(range(len(runs)), key=lambda i: -len(runs[i]))
    out = np.stack([model.step[runs[i][0]] for i in order])
    size = np.array([len(runs[i]) for i in order])
    for j in range(1, int(size[0])):
        k = int(np.searchsorted(-size, -j, "left"))  # those longer than j
        out[:k] = times(out[:k], model.step[[runs[i][j] for i in order[:k]]])
    back = [np.zeros(0)] * len(runs)
    for at, i in enumerate(order):
        back[i] = out[at]
    return back


def between(steps, entry: int, end: int) -> list[int]:
    """The states after each step of the best path from entry to end. Of equal paths, that with lower states."""
    best, back = None, []
    for m in steps:
        if best is None:
            best = m[entry]
            continue
        both = best[:, None] + m[:STATES]
        back.append(both.argmax(axis=0).astype(np.uint8))
        best = both.max(axis=0)
    path = [end]
    for pointers in reversed(back):
        path.append(int(pointers[path[-1]]))
    return path[::-1]


def render(fragment: str, states: list[int]) -> tuple[str, int, str, bool]:
    """Canonical text of a fragment, turns begun in it, the role of its first line, and whether that goes on from before."""
    out, turns = [], 0
    for line, state in zip(fragment.split("\n"), states, strict=True):
        said, size = marker(line)
        role, place = divmod(state, 4)
        if place in (FIRST, ONLY):
            out.append(f"<|{ROLES[role]}|>")
            turns += 1
            if said == role:
                line = line[size:]
                if not line:
                    continue
        out.append(line)
    return "\n".join(out), turns, ROLES[states[0] // 4], states[0] % 4 in (INNER, LAST)


def _groups(table: pa.Table, *keys: str):
    """Rows as dicts, by the keys in order."""
    rows = defaultdict(list)
    for row in table.to_pylist():
        rows[tuple(row[k] for k in keys)].append(row)
    return sorted(rows.items())


def _bucket(n: int, *cols: str) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int").alias("bucket")


def _matrix(values: list[float]) -> np.ndarray:
    return np.array(values).reshape(STATES + 1, STATES)


def format_chats(fragments: DataFrame, model: tuple[np.ndarray, ...], conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> DataFrame:
    """One row for each fragment: conv_id, turn, role (of its first line), n_turns (begun in it), continues, rendered.

    The fragments of a transcript, in the order of turn, are its lines; rendered texts in that order are the canonical turns."""
    spark = fragments.sparkSession
    bounded_batches(spark)
    hmm = Model(*model)
    rows = _rows(fragments, conv_col, turn_col, text_col).withColumn("block", F.floor(F.col("turn") / BLOCK)).withColumn("tie", F.xxhash64("text"))
    count, size, low, high = rows.agg(F.count("*"), F.sum(F.octet_length("text")), F.min("block"), F.max("block")).first()
    buckets = max(1, (count or 0) // GROUP_ROWS)
    read_buckets = max(buckets, (size or 0) // GROUP_BYTES)

    def coded(batches):
        for batch in batches:
            values = pa.array([codes(t.as_py()).tobytes() for t in batch.column(4)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], values], ["conv_id", "turn", "block", "tie", "codes"])

    def leaf(table: pa.Table) -> pa.Table:
        names, runs = [], []
        for name, group in _groups(table, "conv_id", "block"):
            group.sort(key=lambda r: (r["turn"], r["tie"]))
            names.append(name)
            runs.append(np.frombuffer(b"".join(r["codes"] for r in group), np.uint8))
        made = products(runs, hmm) if runs else []
        return _table([(*n, m.ravel().tolist()) for n, m in zip(names, made, strict=True)], ("conv_id", pa.int64()), ("block", pa.int64()), ("m", pa.list_(pa.float64())))

    def up(table: pa.Table) -> pa.Table:
        out = []
        for (conv, parent), group in _groups(table, "conv_id", "parent"):
            m = None
            for r in sorted(group, key=lambda r: r["block"]):
                m = _matrix(r["m"]) if m is None else times(m, _matrix(r["m"]))
            out.append((conv, parent, m.ravel().tolist()))
        return _table(out, ("conv_id", pa.int64()), ("block", pa.int64()), ("m", pa.list_(pa.float64())))

    def down(table: pa.Table) -> pa.Table:
        out = []
        for (conv, _), group in _groups(table, "conv_id", "parent"):
            group.sort(key=lambda r: r["block"])
            entry, end = group[0]["entry"], group[0]["end"]
            path = between((_matrix(r["m"]) for r in group), entry, end)
            for r, a, b in zip(group, [entry, *path], path, strict=False):
                out.append((conv, r["block"], a, b))
        return _table(out, ("conv_id", pa.int64()), ("block", pa.int64()), ("entry", pa.int32()), ("end", pa.int32()))

    def read(table: pa.Table) -> pa.Table:
        out = []
        for (conv, _), group in _groups(table, "conv_id", "block"):
            group.sort(key=lambda r: (r["turn"], r["tie"]))
            lines = [codes(r["text"]) for r in group]
            states = between((hmm.step[c] for run in lines for c in run.tolist()), group[0]["entry"], group[0]["end"])
            at = 0
            for r, run in zip(group, lines, strict=True):
                text, turns, role, on = render(r["text"], states[at : at + len(run)])
                at += len(run)
                out.append((conv, r["turn"], role, turns, on, text))
        return _table(out, ("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("n_turns", pa.int64()), ("continues", pa.bool_()), ("rendered", pa.string()))

    node = "conv_id long, block long, m array<double>"
    lines = rows.select("conv_id", "turn", "block", "tie", "text").mapInArrow(coded, "conv_id long, turn long, block long, tie long, codes binary")
    levels = [written(lines.groupBy(_bucket(buckets, "conv_id", "block")).applyInArrow(leaf, node), "level")]
    while low is not None and high != low:
        low, high = low // FAN, high // FAN
        parents = levels[-1].withColumn("parent", F.floor(F.col("block") / FAN))
        levels.append(written(parents.groupBy(_bucket(buckets, "conv_id", "parent")).applyInArrow(up, node), "level"))
    last = F.slice("m", START * STATES + 1, STATES)  # scores from the start
    last = F.zip_with(last, F.array(*map(F.lit, hmm.end.tolist())), lambda x, y: x + y)
    ends = levels[-1].select("conv_id", "block", F.lit(START).alias("entry"), (F.array_position(last, F.array_max(last)) - 1).cast("int").alias("end"))
    for level in reversed(levels[:-1]):
        children = level.withColumn("parent", F.floor(F.col("block") / FAN)).join(ends.withColumnRenamed("block", "parent"), ["conv_id", "parent"])
        ends = written(children.groupBy(_bucket(buckets, "conv_id", "parent")).applyInArrow(down, "conv_id long, block long, entry int, end int"), "ends")
    if len(levels) > 1:
        discard(*levels)
    return rows.join(ends, ["conv_id", "block"]).groupBy(_bucket(read_buckets, "conv_id", "block")).applyInArrow(read, "conv_id long, turn long, role string, n_turns long, continues boolean, rendered string")


def _table(rows: list[tuple], *fields) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.table({n: pa.array(c, t) for c, (n, t) in zip(cols, fields, strict=True)})


#: How the written transcripts mark speakers; "" leaves the marker out. Characters to a line.
STYLES = {"system": ["System: ", "### System\n", "[SYSTEM] ", ""], "user": ["User: ", "Human: ", "### User\n", "[USER] ", "Q: ", "**User:** ", "<|user|> ", ""], "assistant": ["Assistant: ", "AI: ", "### Assistant\n", "[BOT] ", "A: ", "**Assistant:** ", "<|assistant|> ", ""]}
WIDTH = 72


def raw_turns(turns: DataFrame) -> DataFrame:
    """conversations as raw text (conv_id, turn, role, text): each turn with a speaker marker of some style, or none, in lines of at most WIDTH characters."""
    role = F.lower(F.coalesce("role", F.lit("")))
    mark = F.lit("")
    for r, styles in STYLES.items():
        pick = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(len(styles))).cast("int") + 1
        mark = F.when(role == r, F.element_at(F.array(*map(F.lit, styles)), pick)).otherwise(mark)
    wrapped = F.regexp_replace(F.coalesce("text", F.lit("")), rf"(.{{1,{WIDTH}}}) (?=.)", "$1\n")
    return turns.select("conv_id", "turn", "role", F.concat(mark, wrapped).alias("text"))


def line_bits(raw: DataFrame) -> int:
    """Bits that the number of a line within its turn needs, so that places of a transcript's lines follow each other closely."""
    longest = raw.agg(F.max(F.size(F.split("text", "\n", -1)))).first()[0]
    return max(1, (longest or 1) - 1).bit_length()


def transcripts(raw: DataFrame, bits: int) -> DataFrame:
    """The lines (conv_id, turn, text) of raw turns, without roles; a line's place is the turn's, times 2 ** bits, and its own in it."""
    lines = raw.select("conv_id", F.coalesce(F.col("turn"), F.lit(0)).alias("t"), F.posexplode(F.split("text", "\n", -1)).alias("i", "text"))
    return lines.select("conv_id", (F.col("t") * (1 << bits) + F.col("i")).alias("turn"), "text")


def held_out(conv: Column) -> Column:
    """One transcript in five teaches nothing."""
    return F.crc32(conv.cast("string")) % 5 == 0
