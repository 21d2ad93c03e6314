"""Text expressions: cleaning and splitting, all JVM-side."""

from __future__ import annotations

from string import punctuation as PUNCTUATION

from pyspark.sql import Column, functions as F

# Patterns, in character classes with the meaning Unicode-aware regular expressions give them.
NOT_WORD = r"[^\p{L}\p{N}_]+"
SPACE = r"\t-\r\x1c-\x20\x{85}\p{Z}"
TAG = r"(?d)<.*?>"
URL = rf"https?://[^{SPACE}]+|www\.[^{SPACE}]+"
# Emoji ranges. The last one also covers CJK, Hangul and kana.
EMOJI = (r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}"
         r"\x{2702}-\x{27B0}\x{24C2}-\x{1F251}]+")
ALPHABETIC = r"^\p{L}+$"
SENTENCE_GAP = rf"(?<=[.!?])[{SPACE}]+"


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def to_lower(c: str | Column) -> Column:
    return F.lower(_c(c))


def strip_html(c: str | Column) -> Column:
    """Remove tags; entities and script bodies stay."""
    return F.regexp_replace(_c(c), TAG, "")


def strip_urls(c: str | Column) -> Column:
    return F.regexp_replace(_c(c), URL, "")


def strip_punct(c: str | Column) -> Column:
    return F.translate(_c(c), PUNCTUATION, "")


def strip_emoji(c: str | Column) -> Column:
    return F.regexp_replace(_c(c), EMOJI, "")


def word_pieces(c: str | Column) -> Column:
    """Pieces between runs of non-word characters; edge pieces may be empty."""
    return F.split(_c(c), NOT_WORD, -1)


def words(c: str | Column, min_chars: int = 1) -> Column:
    """Lower-case words, in order."""
    return F.filter(word_pieces(F.lower(_c(c))), lambda t: F.length(t) >= min_chars)


def alphabetic(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: t.rlike(ALPHABETIC))


def drop_words(tokens: Column, stop_words: list[str]) -> Column:
    """Keep order and repeats of all other words."""
    if not stop_words:
        return tokens
    stops = F.array(*[F.lit(w) for w in stop_words])
    return F.filter(tokens, lambda t: ~F.array_contains(stops, t))


def content_words(c: str | Column, stop_words: list[str], custom: list[str] = ()) -> Column:
    """Alphabetic words that are not stop words, joined by a space."""
    return F.array_join(drop_words(alphabetic(F.filter(word_pieces(_c(c)), lambda t: t != "")),
                                   sorted({*stop_words, *custom})), " ")


def space_punct(c: str | Column) -> Column:
    """Set ``. , ! ?`` apart and turn every other non-letter run into a space."""
    return F.regexp_replace(F.regexp_replace(_c(c), r"([.,!?])", r" $1 "), r"[^a-zA-Z.,!?]+", " ")


def normalize_string(c: str | Column) -> Column:
    spaced = F.regexp_replace(F.regexp_replace(_c(c), r"([.!?])", r" $1"), r"[^a-zA-Z.!?]+", " ")
    return squeeze_spaces(spaced)


def squeeze_spaces(c: str | Column, trim: bool = True) -> Column:
    out = F.regexp_replace(_c(c), f"[{SPACE}]+", " ")
    return F.trim(out) if trim else out


def word_split(c: str | Column, alpha_only: bool = False) -> Column:
    """Split on non-word runs and join by a space; optionally alphabetic words only, in lower case."""
    if alpha_only:
        return F.array_join(alphabetic(words(c)), " ")
    return F.array_join(word_pieces(c), " ")


def drop_chars(c: str | Column, chars: str = "!@#$%^&*()'") -> Column:
    return F.translate(_c(c), chars, "")


def split_sentences(c: str | Column) -> Column:
    """Sentences end at ``. ! ?`` followed by space."""
    return F.filter(F.split(_c(c), SENTENCE_GAP, -1), lambda s: s != "")


def characters(c: str | Column) -> Column:
    return F.filter(F.split(_c(c), ""), lambda x: x != "")


def pad_truncate(arr: str | Column, n: int, side: str = "post", value=0) -> Column:
    """Exactly ``n`` items: longer arrays are cut, shorter ones padded at the chosen side."""
    kept = F.slice(_c(arr), 1, n)
    pad = F.array_repeat(F.lit(value), F.greatest(F.lit(n) - F.size(kept), F.lit(0)))
    return F.concat(kept, pad) if side == "post" else F.concat(pad, kept)


def ngram_pairs(tokens: str | Column, n: int) -> Column:
    """Array of (context: the previous n tokens, target: the next token)."""
    a = _c(tokens)
    at = F.when(F.size(a) > n, F.sequence(F.lit(n), F.size(a) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(F.slice(a, i - n + 1, F.lit(n)).alias("context"),
                                              F.get(a, i).alias("target")))


def token_windows(tokens: str | Column, length: int) -> Column:
    """Array of (start, x: length - 1 tokens, y: the last one), one window per start."""
    a = _c(tokens)
    at = F.when(F.size(a) >= length, F.sequence(F.lit(0), F.size(a) - length)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(i.alias("start"), F.slice(a, i + 1, F.lit(length - 1)).alias("x"),
                                              F.get(a, i + (length - 1)).alias("y")))


def shifted_windows(tokens: str | Column, block: int) -> Column:
    """Array of (start, x, y) with y the window shifted by one token."""
    a = _c(tokens)
    at = F.when(F.size(a) > block, F.sequence(F.lit(0), F.size(a) - block - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(i.alias("start"), F.slice(a, i + 1, F.lit(block)).alias("x"),
                                              F.slice(a, i + 2, F.lit(block)).alias("y")))


def prefix_sequences(ids: str | Column, pad: int = 64, ngrams: int = 3) -> Column:
    """Growing prefixes: for i = 1 .. n-1 the first i + ngrams ids, cut to ``pad`` and left-padded;
    the last id is the target."""
    a = _c(ids)
    at = F.when(F.size(a) > 1, F.sequence(F.lit(1), F.size(a) - 1)).otherwise(F.array().cast("array<int>"))

    def one(i: Column) -> Column:
        kept = F.slice(a, F.lit(1), F.least(i + ngrams, F.lit(pad)))
        full = F.concat(F.array_repeat(F.lit(0).cast("bigint"), F.lit(pad) - F.size(kept)), kept)
        return F.struct(i.alias("i"), F.slice(full, 1, pad - 1).alias("x"), F.element_at(full, -1).alias("y"))

    return F.transform(at, one)


def fill_template(template: str, **extra: Column) -> Column:
    """Text with its ``{name}`` places filled from columns, or from the given expressions."""
    parts, rest = [], template
    while "{" in rest:
        text, rest = rest.split("{", 1)
        field, rest = rest.split("}", 1)
        parts += [F.lit(text), extra.get(field, F.col(field)).cast("string")]
    return F.concat(*parts, F.lit(rest))
