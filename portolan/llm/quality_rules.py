"""Quality rules with adaptive thresholds.

Every document gets whole-text measures; mergeable quantile sketches of the measures per language and source give
thresholds, and the documents are joined with them: the thresholds are broadcast up to BROADCAST_GROUPS groups, and beyond
that both sides shuffle, large groups cut by a salt. DataFrame functions only.

A sketch is a log-linear histogram: a value keeps its PRECISION_BITS leading bits, so a bucket's relative error is at
most 2**(1-PRECISION_BITS), buckets of two sketches add up, and the result doesn't depend on the order of merging.

Defined results: a null text is empty (no words, base_failed); null languages and sources are groups of their own;
repeated rows count and return as often as they occur; an empty table gives an empty result; other columns are carried
unchanged, whatever their names.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, WHITE_CLASS, Scratch

WINDOW = 8
PRECISION_BITS = 7
#: Groups with fewer rows use the language's sketch, and languages with fewer the whole corpus's.
MIN_ROWS = 200
#: Groups whose thresholds are broadcast, and rows of a group that get one salt beyond them.
BROADCAST_GROUPS, SALT_ROWS = 1 << 16, 1 << 20
#: Tukey-like fences: quartile plus SPREAD interquartile ranges plus the measure's slack.
SPREAD = 3
#: Measure: (slack, lower fence too). In thousandths of words or of word characters; word_length in hundredths.
MEASURES = {
    "symbols": (100, False),
    "dup_lines": (60, False),
    "repeats": (250, False),
    "word_length": (150, True),
}


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs as the struct column `row`, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.

    Each step is a projection of its own, since its columns are read more than once by the next.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    step = docs.select(F.struct("*").alias("row"), t.alias("t"))
    trimmed = F.btrim(F.col("t"), F.lit(WHITE))
    step = step.select(
        "row",
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WHITE_CLASS + "+")).alias("w"),
        F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "").alias("lines"),
    )
    step = step.select(
        "row", "n_symbols",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    kept = ["row", "n_symbols", "n_words", "word_chars", "n_dup_lines"]
    for width in (1, 2, 4):  # a window's hash from those of its halves; WINDOW is 8
        ahead = F.slice("h", width + 1, F.greatest(F.size("h"), F.lit(1)))
        step = step.select(*kept, F.zip_with("h", ahead, lambda a, b: F.xxhash64(a, b)).alias("h"))
    step = step.select(*kept, F.slice("h", 1, F.greatest(F.col("n_words") - (WINDOW - 1), F.lit(0)).cast("int")).alias("h"))
    with_place = F.zip_with("h", F.sequence(F.lit(0), F.size("h") - 1), lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    step = step.select(*kept, F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(with_place)).alias("s"))
    twice = F.zip_with(
        "s", F.slice("s", 2, F.greatest(F.size("s"), F.lit(1))),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])),
    )
    step = step.select(*kept, F.sort_array(F.array_distinct(F.flatten(F.filter(twice, lambda x: x.isNotNull())))).alias("p"))
    covered = F.zip_with(
        "p", F.slice("p", 2, F.greatest(F.size("p"), F.lit(1))),
        lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))),
    )
    step = step.select(*kept, F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return step.withColumn("base_failed", failed)


def _measures() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbols": F.expr("1000 * n_symbols div greatest(word_chars, 1)"),
        "dup_lines": F.expr("1000 * n_dup_lines div greatest(n_words, 1)"),
        "repeats": F.expr("1000 * n_repeat_words div greatest(n_words, 1)"),
        "word_length": F.expr("100 * word_chars div greatest(n_words, 1)"),
    }


def bucket(value: Column) -> Column:
    """The value with all but its PRECISION_BITS leading bits cleared."""
    cut = F.greatest(F.length(F.bin(value)) - PRECISION_BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, cut), cut)


def sketch(measured: DataFrame, lang: Column, source: Column) -> DataFrame:
    """Sketch rows (lang, source, measure, bucket, n) of the documents that pass the base rules."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), bucket(v).alias("bucket")) for k, v in _measures().items()]))
    return (
        measured.where(~F.col("base_failed"))
        .select(lang.alias("lang"), source.alias("source"), each.alias("m"))
        .groupBy("lang", "source", "m.measure", "m.bucket").agg(F.count("*").alias("n"))
    )


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    return sketches.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def quartiles(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, measure, n, q25, q75): the least bucket with that share of the rows at or below it."""
    from pyspark.sql import Window

    by = Window.partitionBy(*keys, "measure")
    run = sketches.select(
        *keys, "measure", "bucket",
        F.sum("n").over(by.orderBy("bucket")).alias("upto"), F.sum("n").over(by).alias("total"),
    )
    q = lambda p: F.min(F.when(100 * F.col("upto") >= p * F.col("total"), F.col("bucket")))
    return run.groupBy(*keys, "measure").agg(F.max("total").alias("n"), q(25).alias("q25"), q(75).alias("q75"))


def _limits(row, measure: str) -> Column:
    found = row[f"c_{measure}"] if row else None
    lo, hi = (found["lo"], found["hi"]) if found else (None, None)
    return F.struct(F.lit(lo).cast("long").alias("lo"), F.lit(hi).cast("long").alias("hi"))


def thresholds(sketches: DataFrame) -> DataFrame:
    """One row for each (lang, source) in the sketches: its rows, <measure>_lo and <measure>_hi, lo null where there's no lower fence."""
    keys = [(["lang", "source"], "a"), (["lang"], "b"), ([], "c")]
    wide = []
    for cols, tag in keys:
        q = quartiles(merge(sketches, cols), cols)
        spread = SPREAD * (F.col("q75") - F.col("q25"))
        slack = F.create_map(*[F.lit(x) for k, v in MEASURES.items() for x in (k, v[0])])[F.col("measure")]
        q = q.withColumn("lo", F.col("q25") - spread - slack).withColumn("hi", F.col("q75") + spread + slack)
        one = [F.max(F.when(F.col("measure") == m, F.struct("lo", "hi"))).alias(f"{tag}_{m}") for m in MEASURES]
        wide.append(q.groupBy(*cols).agg(F.max("n").alias(f"{tag}_n"), *one))
    a, b, c = wide
    whole = c.first() or {}  # one row of a dozen numbers
    lang = F.col("a.lang").eqNullSafe(F.col("b.lang"))
    joined = a.alias("a").join(b.alias("b"), lang, "left").select("a.*", *[f"b.{x}" for x in b.columns if x != "lang"])
    out = []
    for m, (_, low) in MEASURES.items():
        best = F.when(F.col("a_n") >= MIN_ROWS, F.col(f"a_{m}")).when(F.col("b_n") >= MIN_ROWS, F.col(f"b_{m}")).otherwise(_limits(whole, m))
        out += [best["hi"].alias(f"{m}_hi")] + ([best["lo"].alias(f"{m}_lo")] if low else [])
    return joined.select("lang", "source", F.col("a_n").alias("rows"), *out)


def judge(measured: DataFrame, limits: DataFrame, lang: Column, source: Column) -> DataFrame:
    """measured with `kept`: within its group's thresholds, and base_failed is false."""
    mine = measured.withColumns({"q_lang": lang, "q_source": source})
    theirs = limits.withColumnsRenamed({"lang": "t_lang", "source": "t_source"})
    on = F.col("q_lang").eqNullSafe(F.col("t_lang")) & F.col("q_source").eqNullSafe(F.col("t_source"))
    if limits.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS:
        joined = mine.join(F.broadcast(theirs), on, "left")
    else:  # rows without a group of their own in the sketches take salt 0
        salts = F.ceil(F.col("rows") / SALT_ROWS)
        many = theirs.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)))
        wide = theirs.where(salts > 1).select(F.col("t_lang").alias("w_lang"), F.col("t_source").alias("w_source"), salts.alias("salts"))  # few: each has SALT_ROWS rows
        of = F.col("q_lang").eqNullSafe(F.col("w_lang")) & F.col("q_source").eqNullSafe(F.col("w_source"))
        mine = mine.join(F.broadcast(wide), of, "left").drop("w_lang", "w_source")
        mine = mine.withColumn("q_salt", F.pmod(F.xxhash64("n_words", "word_chars", "n_symbols", "n_repeat_words"), F.coalesce("salts", F.lit(1).cast("long"))))
        joined = mine.join(many.hint("merge"), on & (F.col("q_salt") == F.col("salt")), "left")
    ok = []
    for m, v in _measures().items():
        ok.append(v <= F.coalesce(F.col(f"{m}_hi"), v))
        if MEASURES[m][1]:
            ok.append(v >= F.coalesce(F.col(f"{m}_lo"), v))
    kept = ~F.col("base_failed") & reduce(and_, ok)
    return joined.withColumn("kept", kept).select(*measured.columns, "kept")


def quality_rules(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", keep: list[str] | None = None) -> DataFrame:
    """(row struct, measures, base_failed, kept) for every document; keep: the columns that row holds (all by default).

    The measures are written to the shared folder once, since both the sketches and the join read them.
    """
    measured = measure(docs, text)
    fields = keep if keep is not None else docs.columns
    need = list(dict.fromkeys([*fields, lang, source]))
    measured = measured.withColumn("row", F.struct(*[F.col("row")[c].alias(c) for c in need]))
    scratch = Scratch(docs.sparkSession)
    measured = scratch.keep(measured, "measured")
    by = (F.col("row")[lang], F.col("row")[source])
    return judge(measured, scratch.keep(thresholds(sketch(measured, *by)), "thresholds"), *by)


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    judged = quality_rules(docs, keep=["doc_id"])
    return judged.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


OP10_SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
),
win AS (SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, sum(least(8, coalesce(nxt - i, 8))) AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM rep) GROUP BY rid),
lines AS (SELECT rid, [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls FROM w),
m AS (
  SELECT w.rid, doc_id, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM w JOIN lines USING (rid) LEFT JOIN cov USING (rid)
),
f AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM m),
v AS (
  SELECT rid, lang, source, unnest(['symbols', 'dup_lines', 'repeats', 'word_length']) AS measure,
         unnest([1000 * n_symbols // greatest(word_chars, 1), 1000 * n_dup_lines // greatest(n_words, 1),
                 1000 * n_repeat_words // greatest(n_words, 1), 100 * word_chars // greatest(n_words, 1)]) AS x, base_failed
  FROM f
),
b AS (SELECT *, (x >> greatest(length(ltrim(bin(x), '0')) - 7, 0)::BIGINT) << greatest(length(ltrim(bin(x), '0')) - 7, 0)::BIGINT AS bk FROM v WHERE NOT base_failed),
fence AS (SELECT * FROM (VALUES ('symbols', 100), ('dup_lines', 60), ('repeats', 250), ('word_length', 150)) AS s(measure, slack)),
qa AS (SELECT lang, source, measure, count(*) AS n, list_sort(list(bk)) AS l FROM b GROUP BY 1, 2, 3),
qb AS (SELECT lang, measure, count(*) AS n, list_sort(list(bk)) AS l FROM b GROUP BY 1, 2),
qc AS (SELECT measure, count(*) AS n, list_sort(list(bk)) AS l FROM b GROUP BY 1),
pick AS (
  SELECT qa.lang, qa.source, qa.measure,
         CASE WHEN qa.n >= 200 THEN qa.l WHEN qb.n >= 200 THEN qb.l ELSE qc.l END AS l
  FROM qa JOIN qb ON qa.lang IS NOT DISTINCT FROM qb.lang AND qa.measure = qb.measure JOIN qc ON qa.measure = qc.measure
),
q AS (
  SELECT lang, source, measure, slack, l[((25 * len(l) + 99) // 100)] AS q25, l[((75 * len(l) + 99) // 100)] AS q75
  FROM pick JOIN fence USING (measure)
),
bad AS (
  SELECT v.rid, count(*) FILTER (WHERE v.x > q.q75 + 3 * (q.q75 - q.q25) + q.slack
                               OR v.measure = 'word_length' AND v.x < q.q25 - 3 * (q.q75 - q.q25) - q.slack) AS n
  FROM v LEFT JOIN q ON v.measure = q.measure AND v.lang IS NOT DISTINCT FROM q.lang AND v.source IS NOT DISTINCT FROM q.source
  GROUP BY v.rid
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND bad.n = 0) AS kept
FROM f JOIN bad USING (rid)
"""
