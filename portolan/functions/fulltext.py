"""Full-text search over token arrays: query texts become a tree, the tree a predicate, and BM25 gives relevance."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import contracts
from .text import tokens, tokens_of

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


@dataclass(frozen=True)
class Term:
    """Consecutive tokens within one column; with prefix, the last one may go on."""

    words: tuple[str, ...]
    prefix: bool = False


@dataclass(frozen=True)
class Query:
    """All groups have to match, a group by one of its terms at least, and no excluded term may."""

    groups: tuple[tuple[Term, ...], ...]
    excluded: tuple[Term, ...] = ()


MODES = ("words", "phrase", "websearch", "boolean", "raw")
_ITEM = re.compile(r'(?P<sign>[+-]?)"(?P<phrase>[^"]*)"(?P<star>\*?)|(?P<word>\S+)')


def _term(text: str, language: str | None, prefix: bool = False) -> Term | None:
    words = tokens_of(text, language)
    return Term(tuple(words), prefix) if words else None


def parse(text: str, mode: str = "words", language: str | None = None) -> Query | None:
    """The query of a search text; None if it has no term that has to match, so that nothing can."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    if mode == "phrase":
        terms = [_term(text, language)]
        return Query(tuple((t,) for t in terms if t)) if any(terms) else None
    if mode == "words":
        found = [t for t in (_term(w, language) for w in text.split()) if t]
        return Query(tuple((t,) for t in found)) if found else None
    if mode == "raw":
        return _parse_raw(text, language)
    must: list[list[Term]] = []
    may: list[Term] = []
    no: list[Term] = []
    joins = False  # an OR ties the term after it to the one before it
    for item in _ITEM.finditer(text):
        word, sign, body, star = item["word"], item["sign"] or "", item["phrase"], bool(item["star"])
        if word is not None:
            if word.upper() == "OR":
                joins = True
                continue
            sign = word[0] if word[0] in "+-" else ""
            star, body = word.endswith("*"), word.lstrip("+-").rstrip("*")
        term = _term(body, language, star)
        if term is None:
            continue
        if sign == "-":
            no.append(term)
        elif mode == "boolean":
            if sign == "+":
                must.append([term])
            else:
                may.append(term)
        elif joins and must:
            must[-1].append(term)
        else:
            must.append([term])
        joins = False
    if mode == "boolean" and not must and may:
        must = [may]
    return Query(tuple(map(tuple, must)), tuple(no)) if must else None


def _parse_raw(text: str, language: str | None) -> Query | None:
    """Terms and phrases joined by AND (or nothing), OR and NOT, NOT last."""
    groups: list[list[Term]] = []
    no: list[Term] = []
    link = "AND"
    for item in re.finditer(r'"([^"]*)"\s*(\*?)|([^\s"]+)', text):
        word = item[3]
        if word in ("AND", "OR", "NOT"):
            link = word
            continue
        term = _term(item[1] if word is None else word.rstrip("*"), language, bool(item[2]) or bool(word) and word.endswith("*"))
        if term:
            if link == "NOT":
                no.append(term)
            elif link == "OR" and groups:
                groups[-1].append(term)
            else:
                groups.append([term])
        link = "AND"
    return Query(tuple(map(tuple, groups)), tuple(no)) if groups else None


def _holds(term: Term, words: Column) -> Column:
    if len(term.words) == 1:
        word = term.words[0]
        return F.exists(words, lambda x: x.startswith(word)) if term.prefix else F.array_contains(words, word)
    n = len(term.words)
    if not term.prefix:
        wanted = F.array(*map(F.lit, term.words))
        return F.exists(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i: F.slice(words, i, n) == wanted)
    wanted = F.array(*map(F.lit, term.words[:-1]))
    return F.exists(
        F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))),
        lambda i: (F.slice(words, i, n - 1) == wanted) & F.coalesce(F.get(words, i + (n - 2)).startswith(term.words[-1]), F.lit(False)),
    )


def predicate(query: Query | None, columns: list[Column]) -> Column:
    """Whether the token arrays match; a term may be in any of them, a phrase within one."""
    if query is None:
        return F.lit(False)
    anywhere = lambda t: reduce(lambda a, b: a | b, [_holds(t, c) for c in columns])
    groups = [reduce(lambda a, b: a | b, map(anywhere, g)) for g in query.groups]
    return reduce(lambda a, b: a & b, [*groups, *(~anywhere(t) for t in query.excluded)])


def _prepared(df: DataFrame, columns: list[str], language: str | None) -> tuple[DataFrame, list[str]]:
    """df with a token array a column. The arrays come out of a generator of one row, which predicates aren't pushed through:
    they would cut the text into tokens once for each of their terms."""
    names = [f"__tokens_{i}" for i in range(len(columns))]
    made = F.struct(*[tokens(F.col(c), language).alias(n) for n, c in zip(names, columns)])
    return df.select("*", F.inline(F.array(made))), names


def _columns(columns: str | list[str]) -> list[str]:
    return [columns] if isinstance(columns, str) else list(columns)


def where_full_text(df: DataFrame, columns: str | list[str], text: str, mode: str = "words", language: str | None = None) -> DataFrame:
    """Rows in which the columns match the search text."""
    if box := contracts.own(contracts.SearchBox):
        return box.where_full_text(df, _columns(columns), text, mode, language)
    query = parse(text, mode, language)
    if query is None:
        return df.where(F.lit(False))
    made, names = _prepared(df, _columns(columns), language)
    return made.where(predicate(query, [F.col(n) for n in names])).select(*df.columns)


def with_relevance(df: DataFrame, columns: str | list[str], text: str, name: str = "relevance", mode: str = "words", language: str | None = None) -> DataFrame:
    """df with the BM25 score of the query's terms, over statistics of the whole of df; 0 where the query doesn't match.

    The statistics are one aggregate: a row of the number of rows, the mean length and each term's rows.
    """
    if box := contracts.own(contracts.SearchBox):
        return box.with_relevance(df, _columns(columns), text, name, mode, language)
    query = parse(text, mode, language)
    if query is None:
        return df.withColumn(name, F.lit(0.0))
    made, names = _prepared(df, _columns(columns), language)
    cols = [F.col(n) for n in names]
    terms = list(dict.fromkeys(t for g in query.groups for t in g))
    length = reduce(lambda a, b: a + b, [F.size(c) for c in cols])

    def count(term: Term) -> Column:
        n = len(term.words)
        if n == 1:
            same = (lambda x: x.startswith(term.words[0])) if term.prefix else (lambda x: x == term.words[0])
            return reduce(lambda a, b: a + b, [F.size(F.filter(c, same)) for c in cols])
        wanted = F.array(*map(F.lit, term.words))
        each = [F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.size(c) - n + 1, F.lit(1))), lambda i, c=c: F.slice(c, i, n) == wanted)) for c in cols]
        return reduce(lambda a, b: a + b, each)

    made = made.withColumns({"__length": length, **{f"__tf_{i}": count(t) for i, t in enumerate(terms)}, "__match": predicate(query, cols)})
    made = made.select(*df.columns, "__length", "__match", *[f"__tf_{i}" for i in range(len(terms))])
    stats = made.agg(
        F.count("*").alias("n"), F.avg("__length").alias("mean"), *[F.count(F.when(F.col(f"__tf_{i}") > 0, 1)).alias(f"df_{i}") for i in range(len(terms))]
    ).first()
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = max(math.log((stats["n"] - stats[f"df_{i}"] + 0.5) / (stats[f"df_{i}"] + 0.5)), LEAST_IDF)
        tf = F.col(f"__tf_{i}").cast("double")
        score = score + F.lit(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("__length") / F.lit(stats["mean"] or 1.0)))
    return made.withColumn(name, F.when(F.col("__match"), score).otherwise(F.lit(0.0))).select(*df.columns, name)


def order_by_relevance(df: DataFrame, columns, text: str, mode: str = "words", language: str | None = None, direction: str = "desc") -> DataFrame:
    from ..operators.ordering import direction_of

    down = direction_of(direction) == "desc"
    scored = with_relevance(df, columns, text, "__relevance", mode, language)
    return scored.orderBy(F.desc("__relevance") if down else F.asc("__relevance")).drop("__relevance")


def search(df: DataFrame, columns, text: str, mode: str = "words", language: str | None = None) -> DataFrame:
    """Matching rows, the most relevant first; relevance is judged over all of df."""
    if parse(text, mode, language) is None:
        return df.where(F.lit(False))
    scored = with_relevance(df, columns, text, "__relevance", mode, language)
    return scored.where("__relevance > 0").orderBy(F.desc("__relevance")).drop("__relevance")


def where_every_word(df: DataFrame, columns: str | list[str], text: str) -> DataFrame:
    """The plain fallback: each word of the text is in one of the columns, case aside."""
    cols = [F.lower(F.col(c)) for c in _columns(columns)]
    words = [w.lower() for w in text.split() if any(c.isalnum() for c in w)]
    if not words:
        return df.where(F.lit(False))
    return df.where(reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, [F.coalesce(c.contains(w), F.lit(False)) for c in cols]) for w in words]))


def token_table(df: DataFrame, key: str, columns: str | list[str], language: str | None = None) -> DataFrame:
    """The inverted index as a table: (token, key, column, place) of every token, to be written sorted by token."""
    each = [df.select(F.col(key).alias("key"), F.lit(c).alias("column"), F.posexplode(tokens(F.col(c), language)).alias("place", "token")) for c in _columns(columns)]
    return reduce(DataFrame.unionByName, each).select("token", "key", "column", "place")


def keys_with_every(index: DataFrame, words: list[str]) -> DataFrame:
    """Keys whose rows hold all the tokens: a filter on the index, and one count a key."""
    found = index.where(F.col("token").isin(words)).groupBy("key").agg(F.countDistinct("token").alias("n"))
    return found.where(F.col("n") == len(set(words))).select("key")
