"""Word lists of the locales. A locale is one module with the names that en has; LOCALES is the order in which they are tried."""

from . import en, zh

LOCALES = [zh, en]


def _joined(name: str) -> list:
    return [x for locale in LOCALES for x in getattr(locale, name)]


def _some(name: str) -> list:
    return [x for locale in LOCALES if (x := getattr(locale, name)) is not None]


QUESTIONS = [(kind, [w for locale in LOCALES for w in locale.QUESTIONS[kind]]) for kind in ("Correction", "Preference", "Why", "How", "What")]
CHANGE_PAIRS = _some("CHANGE_PAIR")
EXPLANATORY, GOAL, EVENT, DECISION = map(_joined, ("EXPLANATORY", "GOAL", "EVENT", "DECISION"))
PREFERENCE, EMOTION, CAUSAL, WHAT = map(_joined, ("PREFERENCE", "EMOTION", "CAUSAL", "WHAT"))
DEFINITION, STOP = map(_joined, ("DEFINITION", "STOP"))
POSSESSIVE = _some("POSSESSIVE")
