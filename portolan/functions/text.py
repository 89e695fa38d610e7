"""Folding of case and accents, trigrams and token arrays."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with a stroke, which have no decomposition, and what they fold to. Fixed values.
STROKES = {"đ": "d", "ł": "l", "ø": "o"}
THRESHOLD = 0.3


@cache
def fold_table() -> tuple[str, str]:
    """Source and target characters of the fold; source characters beyond the targets are deleted."""
    found: dict[str, str] = dict(STROKES)
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        char = chr(code).lower()
        base = char
        while len(base) == 1 and base in found or unicodedata.normalize("NFD", base)[0] != base:
            base = found.get(base) or unicodedata.normalize("NFD", base)[0]
        if len(char) == 1 and base != char:
            found[char] = base
    marks = "".join(map(chr, range(0x300, 0x370)))
    return "".join(found) + marks, "".join(found.values())


def fold(text: Column) -> Column:
    """Lower case without accents. Texts of ASCII only have none, and are left to the cheaper lower case."""
    low = F.lower(text)
    return F.when(F.octet_length(text) == F.char_length(text), low).otherwise(F.translate(low, *fold_table()))


def fold_literal(text: str) -> str:
    source, target = fold_table()
    return text.lower().translate({ord(c): target[i] if i < len(target) else None for i, c in enumerate(source)})


def operand(text: Column, unaccent: bool) -> Column:
    return fold(text) if unaccent else F.lower(text)


def literal(value: str, unaccent: bool) -> str:
    return fold_literal(value) if unaccent else value.lower()


def escape_like(value: str) -> str:
    """value with the characters that mean something in LIKE escaped."""
    return "".join("\\" + c if c in "\\%_" else c for c in value)


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the words, each padded with two blanks before and one after."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def trigrams_of(value: str) -> list[str]:
    words = "".join(c if c.isalnum() else " " for c in value.lower()).split()
    return list(dict.fromkeys(p[i : i + 3] for w in words for p in [f"  {w} "] for i in range(len(p) - 2)))


def similarity(text: Column, value: str, unaccent: bool = False) -> Column:
    """Shared trigrams over all trigrams; 0 where neither has any, null for null."""
    own = trigrams_of(literal(value, unaccent))
    theirs = trigrams(operand(text, unaccent))
    known = F.array(*map(F.lit, own)) if own else F.array().cast("array<string>")
    shared = F.size(F.array_intersect(theirs, known))
    every = F.size(theirs) + len(own) - shared
    score = F.when(every > 0, shared / every).otherwise(F.lit(0.0))
    return F.when(text.isNotNull(), score)


def tokens(text: Column, language: str | None = None) -> Column:
    """The searchable tokens in order: folded words; with `trigram`, the text's three-character substrings with accents kept;
    with `english` or `porter`, stems."""
    if language == "trigram":
        low = F.lower(F.coalesce(text, F.lit("")))
        return F.when(F.length(low) >= 3, F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substring(low, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))
    words = F.filter(F.split(fold(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    if language in ("english", "porter"):
        from .stemmer import stems

        return stems(words)
    return words


def tokens_of(value: str, language: str | None = None) -> list[str]:
    if language == "trigram":
        low = value.lower()
        return [low[i : i + 3] for i in range(len(low) - 2)]
    words = "".join(c if c.isalnum() else " " for c in fold_literal(value)).split()
    if language in ("english", "porter"):
        from .stemmer import stem

        return [stem(w) for w in words]
    return words


def gram_table(df, key: str, column: str):
    """(gram, key) of every trigram, to be written sorted by gram."""
    return df.select(F.explode(trigrams(F.col(column))).alias("gram"), F.col(key).alias("key"))


def keys_that_may_be_similar(grams, value: str, threshold: float = THRESHOLD):
    """Keys that share trigrams enough for the similarity to reach the threshold at all."""
    own = trigrams_of(value)
    shared = grams.where(F.col("gram").isin(own)).groupBy("key").agg(F.count("*").alias("n"))
    return shared.where(F.col("n") >= threshold * len(own)).select("key")
