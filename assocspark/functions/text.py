"""Features of texts as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lang

#: White space and ASCII punctuation, written out so that other SQL engines agree.
BETWEEN = r"[\s!-/:-@\[-`{-~]+"
_EDGE = r"^[^\p{L}\p{N}_-]+|[^\p{L}\p{N}_-]+$"


def let(value: Column, body) -> Column:
    """body(value) with value computed once: what a lambda reads from outside is computed anew for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), BETWEEN, -1), lambda x: x != "")


def segments(text: Column) -> Column:
    """Tokens, those of ideographs alone cut into overlapping pairs: there is no dictionary to cut them into words."""

    def cut(x: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.length(x) - 1), lambda i: F.substring(x, i, F.lit(2)))
        return F.when(x.rlike(r"^[\x{2E80}-\x{9FFF}\x{F900}-\x{FAFF}]{3,}$"), pairs).otherwise(F.array(x))

    return F.flatten(F.transform(tokens(text), cut))


def token_set(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def entities(text: Column) -> Column:
    """Capitalised tokens, trimmed and lower-cased, each once."""
    trimmed = F.transform(F.split(text, r"\s+", -1), lambda x: F.regexp_replace(x, _EDGE, ""))
    return F.array_distinct(F.transform(F.filter(trimmed, lambda x: (F.octet_length(x) >= 2) & x.rlike("^[A-Z]")), lambda x: F.lower(x)))


def topics(text: Column, n: int = 5) -> Column:
    return F.slice(F.filter(segments(text), lambda x: F.octet_length(x) >= 2), 1, n)


def importance(text: Column, content_type: Column) -> Column:
    size = F.length(text)
    base = F.when(size > 200, 0.7).when(size > 50, 0.5).otherwise(0.3)
    return F.least(F.lit(1.0), base + F.when(content_type.isin("Decision", "Preference"), 0.2).otherwise(0.0))


def contains_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(w) for w in words))


def changes(q: Column) -> Column:
    """Both halves of some locale's change pair are in the lower-case text."""
    return reduce(lambda a, b: a | b, (q.contains(x) & q.contains(y) for x, y in lang.CHANGE_PAIRS), F.lit(False))


def question_type(text: Column) -> Column:
    q = F.lower(text)
    out = F.when(changes(q), "Correction")
    for name, words in lang.QUESTIONS:
        out = out.when(contains_any(q, words), name)
    return out.otherwise("None")


def first_marker(text: Column, words: list[str]) -> Column:
    return F.coalesce(*(F.when(text.contains(w), F.lit(w)) for w in words))


def first_label(text: Column, pairs: list[tuple[str, str]]) -> Column:
    return F.coalesce(*(F.when(text.contains(w), F.lit(label)) for w, label in pairs))


def causal(text: Column) -> Column:
    """struct(cause, effect) of the first marker pair with the effect's marker behind the cause's; 80 characters each."""
    low = F.lower(text)

    def part(a: str, b: str) -> Column:
        rest = F.locate(a, low) + len(a)
        tail = F.substring(text, rest, F.length(text))
        at = F.locate(b, F.lower(tail))
        cut = F.struct(F.trim(F.substring(F.substring(tail, F.lit(1), at - 1), 1, 80)).alias("cause"), F.trim(F.substring(F.substring(tail, at + len(b), F.length(text)), F.lit(1), F.lit(80))).alias("effect"))
        return F.when((F.locate(a, low) > 0) & (at > 0), cut)

    return F.coalesce(*(part(a, b) for a, b in lang.CAUSAL))


def preview(text: Column, n: int = 100) -> Column:
    return F.substring(text, 1, n)


def explanatory(text: Column) -> Column:
    """Summed weights of explanatory words, 0.20 at most."""
    return F.least(F.lit(0.20), reduce(lambda a, b: a + b, (F.when(text.contains(w), v).otherwise(0.0) for w, v in lang.EXPLANATORY)))


def sentences(text: Column) -> Column:
    """Sentences with their end marks, without outer blanks, of two bytes or more; the whole text if there is none."""
    parts = F.transform(F.regexp_extract_all(text, F.lit("[^。！？.!?\\n]*[。！？.!?\\n]|[^。！？.!?\\n]+"), F.lit(0)), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    parts = F.filter(parts, lambda x: F.octet_length(x) > 1)
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(text))


def what_subject(text: Column) -> Column:
    """The last word before a delimiter of a what-question; null if there is none."""
    low = F.lower(text)
    heads = (F.when(low.contains(d), F.element_at(F.split(F.trim(F.substring(text, F.lit(1), F.locate(d, low) - 1)), r"\s+"), -1)) for d in lang.WHAT)
    subject = F.coalesce(*heads)
    for particle in lang.POSSESSIVE:
        subject = F.when(F.octet_length(subject) >= 2, F.element_at(F.split(subject, particle), -1))
    return F.when(F.octet_length(subject) >= 2, subject)


def keywords(query: Column, n: int = 5) -> Column:
    """Words that tell a query from others, n at most: first those with an upper-case letter or of three ASCII letters and
    more, then runs of ideographs; stop words of all locales are left out."""
    stop = F.array(*map(F.lit, sorted(set(lang.STOP))))
    telling = lambda w: (F.octet_length(w) >= 2) & w.rlike(r"\p{Lu}") | w.rlike("^[A-Za-z]{3,}$")
    words = F.filter(F.split(query, r"[^\p{L}\p{N}]+", -1), lambda w: telling(w) & ~F.array_contains(stop, F.lower(w)))
    han = F.filter(F.split(query, r"[\s!-/:-@\[-`{-~？]+", -1), lambda w: w.rlike(r"^[^\x{0}-\x{2E80}]{2,}$") & ~F.array_contains(stop, w))
    return F.slice(F.array_distinct(F.concat(words, han)), 1, n)
