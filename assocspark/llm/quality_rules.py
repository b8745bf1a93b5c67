"""Learned decision lists of quality rules, in DataFrame expressions only.

Statistics of whole texts are computed with array functions inside one projection. Sequential
covering learns from the statistics of labelled rows: a rule starts empty and grows by the threshold
condition with the best information gain, is pruned on rows kept apart, and the rows it covers
leave before the next rule grows. The list comes out as one ordered Spark conditional expression.

Defined cases: null and empty texts have no words and fail the base rules. Null labels teach
nothing; of repeated labels the smallest counts. Without two classes of labels, or when no rule is
better than chance, every text that passes the base rules is kept. Repeated rows are judged alike, and rows with a null id are
judged and returned. A very long text is held in its row as its words, and with 16 bytes for each 5-word window if one repeats. Columns
other than id and text play no part, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from bisect import bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that teach the list, chosen by a hash of the id; thresholds tried per feature.
TRAIN_ROWS, BINS = 20_000, 32
MAX_RULES, MAX_CONDITIONS = 12, 4
SYMBOLS = "#*$%&|<>"
_SPACE = "[\\x20\\x09-\\x0D]+"


def let(value: Column, body) -> Column:
    """body(value) with value computed once: the variable of a higher-order function."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeats(words: Column) -> Column:
    """Words covered by 5-word windows that the text has twice or more."""

    def covered(grams: Column) -> Column:
        tagged = F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i")))

        def positions(s: Column) -> Column:
            twin = F.filter(s, lambda x, i: (x["h"] == F.get(s, i + 1)["h"]) | (x["h"] == F.get(s, i - 1)["h"]))
            return F.array_sort(F.transform(twin, lambda x: x["i"]))

        start = F.struct(F.lit(-5).alias("last"), F.lit(0).alias("n"))
        count = lambda p: F.aggregate(p, start, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(5), i - a["last"])).alias("n")))["n"]
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), 0).otherwise(let(let(F.array_sort(tagged), positions), count))

    grams = F.transform(F.sequence(F.lit(0), F.size(words) - 5), lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(5))))
    return F.when(F.size(words) < 6, 0).otherwise(let(grams, covered))


def _duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def base_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id with counts over the whole text (long), and the few more that the learner's ratios need."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    words = F.filter(F.split("text", _SPACE, -1), lambda w: w != "")
    stats = let(words, lambda w: F.struct(F.size(w).alias("n_words"), F.size(F.array_distinct(w)).alias("n_distinct"), _repeats(w).alias("n_repeat_words")))
    rows = rows.select(
        "doc_id",
        stats.alias("s"),
        F.length(F.regexp_replace("text", _SPACE, "")).alias("word_chars"),
        F.length("text").alias("n_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).alias("n_symbols"),
        _duplicate_lines(F.col("text")).alias("n_dup_lines"),
        F.length(F.regexp_replace("text", "[^\\p{Lu}]+", "")).alias("n_upper"),
        (F.length("text") - F.length(F.translate("text", "!?", ""))).alias("n_shouts"),
        (F.length("text") - F.length(F.translate("text", "0123456789", ""))).alias("n_digits"),
    )
    counts = ["word_chars", "n_symbols", "n_dup_lines", "n_upper", "n_shouts", "n_digits"]
    return rows.select("doc_id", *(F.col("s")[c].cast("long").alias(c) for c in ("n_words", "n_distinct", "n_repeat_words")), *(F.col(c).cast("long").alias(c) for c in counts))


def _ratio(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def features() -> dict[str, Column]:
    """What conditions are about: ratios of the counts."""
    return {
        "symbols_per_char": _ratio("n_symbols", "word_chars"),
        "chars_per_word": _ratio("word_chars", "n_words"),
        "upper_per_char": _ratio("n_upper", "word_chars"),
        "shouts_per_word": _ratio("n_shouts", "n_words"),
        "digits_per_char": _ratio("n_digits", "word_chars"),
        "distinct_per_word": _ratio("n_distinct", "n_words"),
        "repeats_per_word": _ratio("n_repeat_words", "n_words"),
        "dup_lines": F.col("n_dup_lines").cast("double"),
    }


Condition = tuple[int, bool, float]  # feature, above, threshold


def _holds(row, c: Condition) -> bool:
    return row[c[0]] > c[2] if c[1] else row[c[0]] <= c[2]


def _covers(row, rule: list[Condition]) -> bool:
    return all(_holds(row, c) for c in rule)


def _gain(p0: int, n0: int, p: int, n: int) -> float:
    return p * (math.log2((p + 1e-9) / (p + n + 1e-9)) - math.log2((p0 + 1e-9) / (p0 + n0 + 1e-9))) if p else 0.0


def _grow(bad: list, good: list, width: int) -> list[Condition]:
    rule: list[Condition] = []
    while bad and good and len(rule) < MAX_CONDITIONS:
        best = (0.0, None)
        for f in range(width):
            ours, theirs = sorted(r[f] for r in bad), sorted(r[f] for r in good)
            for t in sorted({ours[(len(ours) - 1) * i // BINS] for i in range(BINS + 1)}):
                p, n = bisect_right(ours, t), bisect_right(theirs, t)
                best = max(best, (_gain(len(bad), len(good), p, n), (f, False, t)), (_gain(len(bad), len(good), len(bad) - p, len(good) - n), (f, True, t)), key=lambda x: x[0])
        if best[1] is None or best[0] <= 1e-9:
            break
        rule.append(best[1])
        bad, good = ([r for r in rows if _holds(r, best[1])] for rows in (bad, good))
    return rule


def _prune(rule: list[Condition], bad: list, good: list) -> list[Condition]:
    """The beginning of the rule with the best (p - n) / (p + n) on rows that didn't grow it."""

    def worth(part):
        p, n = sum(_covers(r, part) for r in bad), sum(_covers(r, part) for r in good)
        return ((p - n) / (p + n) if p + n else -1.0), p

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=worth, default=[])


def learn_list(rows: list[tuple], width: int) -> list[list[Condition]]:
    """Ordered rules that name bad rows. rows: width features, then 1 for good or 0 for bad; every third row prunes."""
    rules: list[list[Condition]] = []
    bad, good = [r for r in rows if not r[width]], [r for r in rows if r[width]]
    while bad and good and len(rules) < MAX_RULES:
        grow = [[r for i, r in enumerate(x) if i % 3] for x in (bad, good)]
        keep = [x[::3] for x in (bad, good)]
        rule = _prune(_grow(*grow, width), *keep)
        p, n = (sum(_covers(r, rule) for r in x) for x in (bad, good))
        if not rule or p < 2 or p < 9 * n:
            break
        rules.append(rule)
        bad, good = ([r for r in x if not _covers(r, rule)] for x in (bad, good))
    return rules


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> list[list[Condition]]:
    labels = labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("quality")).where("id is not null and quality in (0, 1)").groupBy("id").agg(F.min("quality").alias("quality"))
    sample = F.broadcast(labels.orderBy(F.xxhash64("id"), "id").limit(train_rows))  # at most train_rows pairs of numbers
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(sample, "id", "left_semi")
    stats = base_statistics(texts, "id", "text").withColumnRenamed("doc_id", "id").join(sample, "id")
    rows = stats.select(*(c.alias(k) for k, c in features().items()), "quality", "id").orderBy(F.xxhash64("id"), "id").limit(train_rows).collect()
    return learn_list([tuple(r)[:-1] for r in rows], len(features()))


def rejects(rules: list[list[Condition]]) -> Column:
    """The list as one ordered conditional expression: the number of the first rule that holds, else null."""
    columns = list(features().values())
    out = F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate(rules))):
        test = F.lit(True)
        for f, above, t in rule:
            test = test & (columns[f] > t if above else columns[f] <= t)
        out = F.when(test, F.lit(i)).otherwise(out)
    return out


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, the counts, base_failed, rule (the learned rule that rejects, or null) and kept, for each row."""
    rules = learn(docs, labels, id_col, text_col, train_rows)
    stats = base_statistics(docs, id_col, text_col)
    stats = stats.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).withColumn("rule", rejects(rules))
    return stats.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
