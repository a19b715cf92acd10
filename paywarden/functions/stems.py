"""English word stems by the suffix rules of Porter (1980), as Column expressions and as SQL over a column of words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a stem has to look like: C and V are runs of consonants and vowels, where y is a vowel behind a consonant.
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
ANY = "^.*"
ONE = f"^(?:{_C})?{_V}{_C}.*"  # at least one vowel run followed by consonants
TWO = f"^(?:{_C})?{_V}{_C}{_V}{_C}.*"
VOWEL = f"^(?:{_C})?[aeiouy].*"
SHORT = f"^(?:{_C})?{_V}[^aeiouy]*[^aeiou][aeiouy][^aeiouwxy]$|^{_C}[aeiouy][^aeiouwxy]$"
JUST_ONE = f"^(?:{_C})?{_V}{_C}(?:{_V})?"
SHORT = f"^{_C}[aeiouy][^aeiouwxy]"

# Suffix, what stands for it, what the rest must look like. Of each step the first suffix that fits decides.
PLURAL = [("sses", "ss", ANY), ("ies", "i", ANY), ("ss", "ss", ANY), ("s", "", ANY)]
PAST = [("eed", "ee", ONE), ("ed", "", VOWEL), ("ing", "", VOWEL)]
AFTER_PAST = [("at", "ate", ANY), ("bl", "ble", ANY), ("iz", "ize", ANY)]
LAST_Y = [("y", "i", VOWEL)]
LONG = [(a, b, ONE) for a, b in (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))]
MIDDLE = [(a, b, ONE) for a, b in (
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))]
ENDING = [(a, "", TWO) for a in (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")]

#: Steps in order; each is (what a word must end in for the step to matter, cases of (pattern that decides, pattern that changes, replaced, by)).
Case = tuple[str, str, str, str]


def _cases(rules: list[tuple[str, str, str]]) -> list[Case]:
    return [(f"{suffix}$", f"{rest}{suffix}$", f"{suffix}$", by) for suffix, by, rest in rules]


def _tail() -> list[Case]:
    """Behind a removed ed or ing: a lost e comes back, a doubled consonant goes."""
    return _cases(AFTER_PAST) + [("(?:bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx)$", ANY, ".$", ""), (f"{SHORT}$", ANY, "$", "e")]


STEPS: list[tuple[str, list[Case]]] = [
    ("s$", _cases(PLURAL)),
    ("(?:ed|ing)$", _cases(PAST)),
    ("y$", _cases(LAST_Y)),
    ("(?:al|[ae]nci|izer|[la]li|eli|tli|sli|ation|ator|alism|ness|iti|bli)$", _cases(LONG)),
    ("(?:ate|ative|ize|iti|ical|ful|ness)$", _cases(MIDDLE)),
    ("(?:al|[ae]nce|er|ic|[ai]ble|ant|ent|ou|ism|ate|iti|ous|ive|ize|ion)$", _cases(ENDING[:11]) + [("[st]ion$", f"^(?:{_C})?{_V}{_C}{_V}(?:{_C}.*)?[st]ion$", "ion$", "")] + _cases(ENDING[11:])),
    ("e$", [(f"{SHORT}e$", "^$", "$", ""), ("e$", f"{ONE}e$", "e$", "")]),
    ("ll$", [("ll$", f"{TWO}$", "l$", "")]),
]
PAST_STEP = 1
#: Words of two letters and words with other letters stay.
STEMMED = "^[a-z]{3,}$"


def _step(word: Column, gate: str, cases: list[Case]) -> Column:
    chain = None
    for decides, changes, old, new in cases:
        changed = F.regexp_replace(word, old, new)
        result = changed if changes == ANY else F.when(word.rlike(changes), changed).otherwise(word)
        chain = F.when(word.rlike(decides), result) if chain is None else chain.when(word.rlike(decides), result)
    return F.when(word.rlike(gate), chain.otherwise(word)).otherwise(word)


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def stem(word: Column) -> Column:
    """The stem of a lower-case word."""
    def past(w: Column) -> Column:
        cut = _step(w, *STEPS[PAST_STEP])
        return F.when(w.rlike("(?:ed|ing)$") & ~w.rlike("eed$") & (F.length(cut) < F.length(w)), _step(cut, "[a-z]$", _tail())).otherwise(cut)

    def rest(w: Column, k: int) -> Column:
        if k == len(STEPS):
            return w
        return _bound(past(w) if k == PAST_STEP else _step(w, *STEPS[k]), lambda x: rest(x, k + 1))
    marked = F.regexp_replace(word, "^y", "Y")  # a y in front is a consonant
    return F.when(word.rlike(STEMMED), F.regexp_replace(rest(marked, 0), "^Y", "y")).otherwise(word)


def _sql_step(word: str, gate: str, cases: list[Case]) -> str:
    whens = []
    for decides, changes, old, new in cases:
        changed = f"regexp_replace({word}, '{old}', '{new}')"
        whens.append(f"WHEN regexp_matches({word}, '{decides}') THEN " + (
            changed if changes == ANY else f"CASE WHEN regexp_matches({word}, '{changes}') THEN {changed} ELSE {word} END"))
    return f"CASE WHEN NOT regexp_matches({word}, '{gate}') THEN {word} {' '.join(whens)} ELSE {word} END"


def stem_sql(words: str) -> str:
    """CTE text: ``stems(term, stem)`` for the distinct terms of the query or table ``words``, which has a column ``term``."""
    steps = [f"stem0 AS (SELECT term, regexp_replace(term, '^y', 'Y') AS w, regexp_matches(term, '{STEMMED}') AS usual FROM (SELECT DISTINCT term FROM {words}))"]
    name = "stem0"
    for k, (gate, cases) in enumerate(STEPS):
        value = _sql_step("w", gate, cases)
        if k == PAST_STEP:
            steps.append(f"cut AS (SELECT term, usual, w, {value} AS x FROM {name})")
            name = "cut"
            value = f"CASE WHEN regexp_matches(w, '(?:ed|ing)$') AND NOT regexp_matches(w, 'eed$') AND len(x) < len(w) THEN {_sql_step('x', '[a-z]$', _tail())} ELSE x END"
        steps.append(f"stem{k + 1} AS (SELECT term, usual, {value} AS w FROM {name})")
        name = f"stem{k + 1}"
    return ", ".join(steps) + f", stems AS (SELECT term, CASE WHEN usual THEN regexp_replace(w, '^Y', 'y') ELSE term END AS stem FROM {name})"
