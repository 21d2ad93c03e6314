"""The Porter stemmer as column rules (published algorithm with its common
extensions: irregular words, short words kept, short -ies/-ied and vowel-consonant stems)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Shapes of a stem: C and V are runs of consonants and vowels, y counts as either.
C = "[^aeiou][^aeiouy]*"
V = "[aeiouy][aeiou]*"
M_GT_0 = f"^(?:{C})?{V}{C}"
M_EQ_1 = f"^(?:{C})?{V}{C}(?:{V})?$"
M_GT_1 = f"^(?:{C})?{V}{C}{V}{C}"
HAS_VOWEL = f"^(?:{C})?[aeiouy]"
ENDS_CVC = f"(?:^{C}[aeiouy][^aeiouwxy]$|^[aeiouy][^aeiouy]$)"
ENDS_CONSONANT = "(?:[^aeiouy]|[aeiou]y|^y)$"
DOUBLE = "(?:bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx)$"

# Words stemmed by list.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
    "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed",
    "exceed": "exceed", "succeed": "succeed",
}

# Fixed values: (suffix, replacement) in order of trial; the first suffix found decides.
STEP_2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"),
          ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"),
          ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"),
          ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful")]
STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate",
          "iti", "ous", "ive", "ize"]


def _cut(w: Column, n: int) -> Column:
    return F.substring(w, F.lit(1), F.length(w) - n)


def _let(value: Column, fn) -> Column:
    """Bind a value to a lambda variable, so that a step's input is computed once."""
    return F.transform(F.array(value), fn)[0]


def _rules(w: Column, rules: list[tuple[str, str, str]]) -> Column:
    expr = F
    for suffix, replacement, shape in rules:
        base = _cut(w, len(suffix))
        fits = base.rlike(shape) if shape else F.lit(True)
        expr = expr.when(F.endswith(w, F.lit(suffix)), F.when(fits, F.concat(base, F.lit(replacement))).otherwise(w))
    return expr.otherwise(w)


def _step_1a(w: Column) -> Column:
    short = F.endswith(w, F.lit("ies")) & (F.length(w) == 4)
    return F.when(short, _cut(w, 1)).otherwise(_rules(w, [("sses", "ss", ""), ("ies", "i", ""), ("ss", "ss", ""), ("s", "", "")]))


def _tidy(w: Column) -> Column:
    return (F.when(w.rlike("(?:at|bl|iz)$"), F.concat(w, F.lit("e")))
            .when(w.rlike(DOUBLE), _cut(w, 1))
            .when(w.rlike(M_EQ_1) & w.rlike(ENDS_CVC), F.concat(w, F.lit("e"))).otherwise(w))


def _step_1b(w: Column) -> Column:
    def drop(n: int) -> Column:
        base = _cut(w, n)
        return F.when(base.rlike(HAS_VOWEL), _let(base, _tidy)).otherwise(w)

    ied = F.concat(_cut(w, 3), F.when(F.length(w) == 4, "ie").otherwise("i"))
    eed = F.when(_cut(w, 3).rlike(M_GT_0), _cut(w, 1)).otherwise(w)
    return (F.when(F.endswith(w, F.lit("ied")), ied).when(F.endswith(w, F.lit("eed")), eed)
            .when(F.endswith(w, F.lit("ed")), drop(2)).when(F.endswith(w, F.lit("ing")), drop(3)).otherwise(w))


def _step_1c(w: Column) -> Column:
    base = _cut(w, 1)
    y = F.endswith(w, F.lit("y")) & (F.length(w) > 2) & base.rlike(ENDS_CONSONANT)
    return F.when(y, F.concat(base, F.lit("i"))).otherwise(w)


def _step_2(w: Column) -> Column:
    plain = [(s, r, M_GT_0) for s, r in STEP_2]
    logi = F.endswith(w, F.lit("logi"))
    alli = F.endswith(w, F.lit("alli")) & _cut(w, 4).rlike(M_GT_0)
    return (F.when(alli, _let(_cut(w, 2), lambda x: _rules(x, plain)))
            .when(logi, F.when(_cut(w, 3).rlike(M_GT_0), _cut(w, 1)).otherwise(w))
            .otherwise(_rules(w, plain)))


def _step_3(w: Column) -> Column:
    return _rules(w, [(s, r, M_GT_0) for s, r in STEP_3])


def _step_4(w: Column) -> Column:
    expr = F
    for s in STEP_4:
        base = _cut(w, len(s))
        fits = base.rlike(M_GT_1) & (base.rlike("[st]$") if s == "ion" else F.lit(True))
        expr = expr.when(F.endswith(w, F.lit(s)), F.when(fits, base).otherwise(w))
    return expr.otherwise(w)


def _step_5(w: Column) -> Column:
    base = _cut(w, 1)
    drop = base.rlike(M_GT_1) | (base.rlike(M_EQ_1) & ~base.rlike(ENDS_CVC))
    return F.when(F.endswith(w, F.lit("e")) & drop, base).otherwise(w)


def _step_5b(w: Column) -> Column:
    return F.when(F.endswith(w, F.lit("ll")) & _cut(w, 1).rlike(M_GT_1), _cut(w, 1)).otherwise(w)


def porter(word: Column) -> Column:
    """Stem of a word. Apply it to a distinct vocabulary, not to running text."""
    known = F.create_map(*[F.lit(x) for kv in IRREGULAR.items() for x in kv])
    stemmed = F.lower(word)
    for step in (_step_1a, _step_1b, _step_1c, _step_2, _step_3, _step_4, _step_5, _step_5b):
        stemmed = _let(stemmed, step)
    return F.coalesce(F.try_element_at(known, F.lower(word)),
                      F.when(F.length(word) <= 2, F.lower(word)).otherwise(stemmed))
