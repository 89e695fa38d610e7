"""The registered queries of the operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import fulltext
from .functions.json import cast_text, char_length, decrement_json, increment_json, json_bool, json_number, json_text
from .functions.text import fold, gram_table, keys_that_may_be_similar, similarity
from .operators import aggregates as A
from .operators import filters as W
from .operators import history as H
from .operators import mirror as M
from .operators import ordering as O
from .operators import quality as Q
from .operators import relations as R
from .plans.tables import ColumnSpec, TableSpec
from .session import load
from .sources import scans

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def money(name: str, c) -> F.Column:
    return F.round(c, 2).alias(name)


# conditional aggregates and ROLLUP

_BIG = "o_totalprice > 100000"
_AGGREGATES = "COUNT(CASE WHEN o_totalprice > 100000 THEN 1 END) AS big_orders, round(SUM(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 2) AS finished_total, COUNT(*) AS all_orders"


def _conditional() -> list:
    finished = A.sum_where("x", "o_totalprice", F.col("o_orderstatus") == "F")
    return [A.count_where("big_orders", F.expr(_BIG)), F.round(finished, 2).alias("finished_total"), F.count("*").alias("all_orders")]


@query(f"SELECT {_AGGREGATES} FROM orders")
def cond_agg_global(spark, d):
    return load(spark, d, "orders").agg(*_conditional())


@query(f"SELECT o_orderpriority, {_AGGREGATES}, min(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS least_open, max(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS most_open, round(avg(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END), 2) AS mean_open FROM orders GROUP BY o_orderpriority")
def cond_agg_grouped(spark, d):
    open_ = F.col("o_orderstatus") == "O"
    more = [A.aggregate_where("min", "o_totalprice", open_, "least_open"), A.aggregate_where("max", "o_totalprice", open_, "most_open"), F.round(A.aggregate_where("avg", "o_totalprice", open_, "x"), 2).alias("mean_open")]
    return load(spark, d, "orders").groupBy("o_orderpriority").agg(*_conditional(), *more)


@query(f"SELECT o_orderpriority, o_orderstatus, {_AGGREGATES} FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)")
def rollup_two_level(spark, d):
    return A.rollup(load(spark, d, "orders"), ["o_orderpriority", "o_orderstatus"], *_conditional())


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS quantity FROM lineitem WHERE l_discount > 0.05 GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_filtered(spark, d):
    return A.rollup(load(spark, d, "lineitem").where("l_discount > 0.05"), ["l_returnflag", "l_linestatus"], money("quantity", F.sum("l_quantity")))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus) HAVING count(*) > 1000 ORDER BY n DESC, l_returnflag NULLS LAST, l_linestatus NULLS LAST LIMIT 3")
def rollup_having_limit(spark, d):
    out = A.rollup(load(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], F.count("*").alias("n"))
    return out.where("n > 1000").orderBy(F.desc("n"), O.nulls_last("l_returnflag"), O.nulls_last("l_linestatus")).limit(3)


@query("SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem WHERE l_quantity < 0 GROUP BY ROLLUP (l_returnflag)")
def rollup_empty_input(spark, d):
    return A.rollup(load(spark, d, "lineitem").where("l_quantity < 0"), ["l_returnflag"], F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus UNION ALL SELECT l_returnflag, NULL, count(*) FROM lineitem GROUP BY l_returnflag UNION ALL SELECT NULL, NULL, count(*) FROM lineitem")
def rollup_union_emulated(spark, d):
    return A.union_rollup(load(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], F.count("*").alias("n"))


@query("SELECT time_bucket(INTERVAL '1 day', ts) AS _wstart, time_bucket(INTERVAL '1 day', ts) + INTERVAL '1 day' AS _wend, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def time_window_daily(spark, d):
    return A.time_window(load(spark, d, "events"), "ts", "1 day", F.count("*").alias("n"), money("total", F.sum("value")))


@query("SELECT event_id, user_id, event_type FROM events WHERE substr(md5(event_id::VARCHAR), 1, 2) < '1a'")
def sample_rows(spark, d):
    """A tenth of the rows; the sampling is the feature. By a hash of the key, so that it is the same in any engine."""
    return A.sample_by_hash(load(spark, d, "events"), "event_id", 26 / 256).select("event_id", "user_id", "event_type")


# JSON

_K = "try_cast(props->>'$.k' AS DOUBLE)"


@query(f"SELECT event_id, {_K} AS k FROM events WHERE {_K} >= 50")
def where_json_number(spark, d):
    return W.where_json_number(load(spark, d, "events"), "props->k", ">=", 50).select("event_id", json_number("props->k").alias("k"))


@query(f"SELECT event_id FROM events WHERE {_K} > 90 OR {_K} = 5 OR event_type <> 'view' AND {_K} <> 7")
def or_where_json_number(spark, d):
    is_ = W.json_number_is
    return load(spark, d, "events").where(W.either(is_("props->k", ">", 90), is_("props->k", "=", 5), (F.col("event_type") != "view") & is_("props->k", "!=", 7))).select("event_id")


@query(f"SELECT event_id, {_K} AS k FROM events ORDER BY {_K} DESC NULLS LAST, event_id LIMIT 25")
def order_json_number_topk(spark, d):
    return O.order_by_json_number(load(spark, d, "events"), "props->k", "desc", True, F.col("event_id")).limit(25).select("event_id", json_number("props->k").alias("k"))


@query("SELECT event_id, nullif(event_type, 'view') AS kind FROM events ORDER BY nullif(event_type, 'view') ASC NULLS LAST, event_id LIMIT 40")
def order_nulls_last_topk(spark, d):
    kind = F.nullif(F.col("event_type"), F.lit("view"))
    return O.order_by_nulls_last(load(spark, d, "events"), kind, "asc", F.col("event_id")).limit(40).select("event_id", kind.alias("kind"))


@query(f"SELECT event_type, coalesce(sum({_K}), 0) AS total FROM events GROUP BY event_type")
def json_sum(spark, d):
    return load(spark, d, "events").groupBy("event_type").agg(A.sum_json("props->k").alias("total"))


@query(f"SELECT round(avg({_K}), 6) AS mean, min({_K}) AS least, max({_K}) AS most FROM events")
def json_avg_min_max(spark, d):
    return load(spark, d, "events").agg(F.round(A.avg_json("props->k"), 6).alias("mean"), A.min_json("props->k").alias("least"), A.max_json("props->k").alias("most"))


@query(f"SELECT coalesce(sum({_K}), 0) AS total, max({_K}) AS most FROM events WHERE event_id < 0")
def json_sum_empty(spark, d):
    return load(spark, d, "events").where("event_id < 0").agg(A.sum_json("props->k").alias("total"), A.max_json("props->k").alias("most"))


@query("SELECT event_id, props->>'$.k' AS text, event_id % 2 = 0 AS flag, CAST(user_id AS VARCHAR) AS user_text, length(event_type) AS size, props->>'$.none' AS missing FROM events")
def json_text_bool_cast(spark, d):
    df = load(spark, d, "events").withColumn("doc", F.to_json(F.struct((F.col("event_id") % 2 == 0).alias("flag"))))
    return df.select("event_id", json_text("props->k").alias("text"), json_bool("doc->flag").alias("flag"), cast_text("user_id").alias("user_text"), char_length("event_type").cast("long").alias("size"), json_text("props->none").alias("missing"))


@query(f"SELECT event_id, {_K} + 5 AS up, {_K} - 2.5 AS down FROM events")
def json_increment(spark, d):
    df = load(spark, d, "events").select("event_id", increment_json("props->k", 5).alias("up"), decrement_json("props->k", 2.5).alias("down"))
    return df.select("event_id", json_number("up->k").alias("up"), json_number("down->k").alias("down"))


@query(f"SELECT event_id, 3::DOUBLE AS fresh, {_K} AS k, 1::DOUBLE AS from_list FROM events")
def json_increment_from_empty(spark, d):
    df = load(spark, d, "events").withColumn("list", F.lit("[]"))
    df = df.select("event_id", increment_json("props->n", 3).alias("doc"), increment_json("list->n").alias("list"))
    return df.select("event_id", json_number("doc->n").alias("fresh"), json_number("doc->k").alias("k"), json_number("list->n").alias("from_list"))


# text


@query("SELECT c_custkey FROM customer WHERE starts_with(lower(c_mktsegment), 'auto')")
def starts_with_ci(spark, d):
    return load(spark, d, "customer").where(W.starts_with("c_mktsegment", "AUTO")).select("c_custkey")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ar')")
def contains_ci(spark, d):
    return load(spark, d, "part").where(W.contains("p_name", "AR")).select("p_partkey", "p_name")


@query("SELECT p_partkey FROM part WHERE p_name ILIKE '%a_e%' OR p_brand ILIKE '%brand#1%' ESCAPE '\\'")
def like_escaped(spark, d):
    return load(spark, d, "part").where(W.either(W.like("p_name", "%A_E%"), W.like_literal("p_brand", "%", "brand#1", "%"))).select("p_partkey")


@query("SELECT doc_id FROM documents WHERE contains(strip_accents(lower(text)), 'ere')")
def contains_unaccent(spark, d):
    return load(spark, d, "documents").where(W.contains("text", "ÉRE", unaccent=True)).select("doc_id")


_GRAMS = "list_distinct(flatten([[substr('  ' || w || ' ', i, 3) FOR i IN range(1, length(w) + 2)] FOR w IN regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+') IF w <> '']))"
_SIMILAR = f"WITH g AS (SELECT p_partkey, p_name, {_GRAMS.format('p_name')} AS a, {_GRAMS.format(chr(39) + 'blue stel' + chr(39))} AS b FROM part), s AS (SELECT p_partkey, p_name, len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b)))::DOUBLE AS similarity FROM g)"


@query(_SIMILAR + " SELECT p_partkey, round(similarity, 6) AS similarity FROM s WHERE similarity >= 0.3")
def similar_where(spark, d):
    df = load(spark, d, "part").where(W.similar("p_name", "blue stel"))
    return df.select("p_partkey", F.round(similarity(F.col("p_name"), "blue stel"), 6).alias("similarity"))


@query(_SIMILAR + " SELECT p_partkey, round(similarity, 6) AS similarity FROM s ORDER BY s.similarity DESC, p_partkey LIMIT 10")
def similar_topk(spark, d):
    df = O.order_by_similarity(load(spark, d, "part"), "p_name", "blue stel", "desc", False, F.col("p_partkey")).limit(10)
    return W.with_similarity(df, "p_name", "blue stel").select("p_partkey", F.round("similarity", 6).alias("similarity"))


@query("SELECT DISTINCT p_name FROM part WHERE starts_with(lower(p_name), 'bl')")
def suggest_short(spark, d):
    return O.suggest(load(spark, d, "part").select("p_name").distinct(), "p_name", " BL ")


@query(_SIMILAR.replace("p_partkey, p_name, list", "p_partkey, p_name, list") + " SELECT DISTINCT p_name FROM s WHERE contains(lower(p_name), 'blue stel') OR similarity >= 0.3")
def suggest_long(spark, d):
    return O.suggest(load(spark, d, "part").select("p_name").distinct(), "p_name", "blue stel")


_TOKENS = "WITH t AS (SELECT doc_id, text, [x FOR x IN regexp_split_to_array(strip_accents(lower(text)), '[^\\p{L}\\p{N}]+') IF x <> ''] AS ts FROM documents)"
_HAS = "list_contains(ts, '{0}')"
_PHRASE = "contains(' ' || array_to_string(ts, ' ') || ' ', ' {0} ')"


def _search(spark, d, text: str, mode: str = "words") -> DataFrame:
    return fulltext.where_full_text(load(spark, d, "documents"), "text", text, mode).select("doc_id")


@query(f"{_TOKENS} SELECT doc_id FROM t WHERE {_HAS.format('the')} AND {_HAS.format('licensed')}")
def fulltext_and(spark, d):
    return _search(spark, d, "The  LICENSED -")


@query(f"{_TOKENS} SELECT doc_id FROM t WHERE {_PHRASE.format('under the mit license')}")
def fulltext_phrase(spark, d):
    return _search(spark, d, "under the MIT license", "phrase")


@query(f"{_TOKENS} SELECT doc_id FROM t WHERE {_HAS.format('the')} AND ({_HAS.format('licensed')} OR {_PHRASE.format('released under')}) AND NOT {_HAS.format('mit')}")
def fulltext_websearch(spark, d):
    return _search(spark, d, 'the licensed OR "released under" -mit', "websearch")


@query(f"{_TOKENS} SELECT doc_id FROM t WHERE {_HAS.format('license')} AND NOT {_HAS.format('gnu')}")
def fulltext_boolean(spark, d):
    return _search(spark, d, "+license -gnu the", "boolean")


@query(f"{_TOKENS} SELECT doc_id FROM t WHERE len([x FOR x IN ts IF starts_with(x, 'licen')]) > 0")
def fulltext_prefix(spark, d):
    return _search(spark, d, "licen*", "websearch")


@query("SELECT doc_id FROM documents WHERE (text ILIKE '%license%' OR lang ILIKE '%license%') AND (text ILIKE '%en%' OR lang ILIKE '%en%')")
def fulltext_like_fallback(spark, d):
    return fulltext.where_every_word(load(spark, d, "documents"), ["text", "lang"], "License EN").select("doc_id")


@query(f"""{_TOKENS}, c AS (SELECT doc_id, len(ts) AS l, len([x FOR x IN ts IF x = 'license']) AS a, len([x FOR x IN ts IF x = 'the']) AS b FROM t),
s AS (SELECT count(*) AS n, avg(l) AS m, count(*) FILTER (WHERE a > 0) AS na, count(*) FILTER (WHERE b > 0) AS nb FROM c)
SELECT doc_id, round(greatest(ln((n - na + 0.5) / (na + 0.5)), 1e-6) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * l / m)) + greatest(ln((n - nb + 0.5) / (nb + 0.5)), 1e-6) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * l / m)), 6) AS relevance
FROM c, s WHERE a > 0 AND b > 0 ORDER BY greatest(ln((n - na + 0.5) / (na + 0.5)), 1e-6) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * l / m)) + greatest(ln((n - nb + 0.5) / (nb + 0.5)), 1e-6) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * l / m)) DESC, doc_id LIMIT 20""")
def fulltext_bm25_topk(spark, d):
    scored = fulltext.with_relevance(load(spark, d, "documents").select("doc_id", "text"), "text", "license the")
    return scored.where("relevance > 0").orderBy(F.desc("relevance"), "doc_id").limit(20).select("doc_id", F.round("relevance", 6).alias("relevance"))


@query("SELECT doc_id, strip_accents(lower(text)) AS folded FROM documents")
def fold_text(spark, d):
    return load(spark, d, "documents").select("doc_id", fold(F.col("text")).alias("folded"))


@query(f"{_TOKENS} SELECT token, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(ts) AS token FROM t) GROUP BY token")
def fulltext_index(spark, d):
    index = fulltext.token_table(load(spark, d, "documents"), "doc_id", "text")
    return index.groupBy("token").agg(F.count("*").alias("n"), F.countDistinct("key").alias("docs"))


@query(f"{_TOKENS} SELECT doc_id FROM t WHERE {_HAS.format('the')} AND {_HAS.format('license')}")
def fulltext_index_lookup(spark, d):
    docs = load(spark, d, "documents")
    keys = fulltext.keys_with_every(fulltext.token_table(docs, "doc_id", "text"), ["the", "license"])
    return docs.join(keys, F.col("doc_id") == F.col("key"), "left_semi").select("doc_id")


@query(_SIMILAR + " SELECT p_partkey FROM s WHERE similarity >= 0.3")
def trigram_index_lookup(spark, d):
    parts = load(spark, d, "part")
    keys = keys_that_may_be_similar(gram_table(parts, "p_partkey", "p_name"), "blue stel")
    return parts.join(keys, F.col("p_partkey") == F.col("key"), "left_semi").where(W.similar("p_name", "blue stel")).select("p_partkey")


# relations


@query("SELECT c_mktsegment, count(*) AS lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
def join_items_sold(spark, d):
    lines, orders, customers = (load(spark, d, t) for t in ("lineitem", "orders", "customer"))
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("c_mktsegment").agg(F.count("*").alias("lines"), money("revenue", F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def where_has(spark, d):
    return R.where_has(load(spark, d, "customer"), load(spark, d, "orders"), "c_custkey", "o_custkey", F.col("o_totalprice") > 200000).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) <= 8")
def where_has_count(spark, d):
    return R.has(load(spark, d, "customer"), load(spark, d, "orders"), "c_custkey", "o_custkey", "<=", 8).select("c_custkey")


@query("SELECT s_suppkey, coalesce(n, 0) AS lines, most FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n, max(l_quantity) AS most FROM lineitem WHERE l_quantity > 49 GROUP BY l_suppkey) ON l_suppkey = s_suppkey")
def with_count(spark, d):
    lines = load(spark, d, "lineitem").where("l_quantity > 49")
    out = R.with_count(load(spark, d, "supplier"), lines, "s_suppkey", "l_suppkey", "lines")
    return R.with_aggregate(out, lines, "s_suppkey", "l_suppkey", F.max("l_quantity"), "most").select("s_suppkey", "lines", "most")


@query("SELECT r_name, n_name, n_names, region_key FROM (SELECT n_nationkey, n_name, r_name, r_regionkey AS region_key, count(*) OVER (PARTITION BY n_regionkey) AS n_names FROM nation JOIN region ON n_regionkey = r_regionkey)")
def with_eager_nested(spark, d):
    nations, regions = load(spark, d, "nation"), load(spark, d, "region")
    owned = R.with_one(nations, R.with_many(regions, nations, "r_regionkey", "n_regionkey", "nations"), "n_regionkey", "r_regionkey", "region")
    return owned.select("region.r_name", "n_name", F.size("region.nations").cast("long").alias("n_names"), F.col("region.r_regionkey").alias("region_key"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN n_name ELSE r_name END AS name FROM events LEFT JOIN nation ON event_id % 2 = 0 AND n_nationkey = user_id % 30 LEFT JOIN region ON event_id % 2 = 1 AND r_regionkey = user_id % 30")
def morph_to(spark, d):
    rows = load(spark, d, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, "nation").otherwise("region").alias("kind"), (F.col("user_id") % 30).alias("of"))
    nations = load(spark, d, "nation").withColumnRenamed("n_name", "name")
    regions = load(spark, d, "region").withColumnRenamed("r_name", "name")
    return R.with_morph(rows, {"nation": (nations, "n_nationkey"), "region": (regions, "r_regionkey")}, "kind", "of", "name", "name").select("event_id", "name")


@query("SELECT o_orderkey FROM orders WHERE NOT o_totalprice > 50000")
def keys_gone(spark, d):
    orders = load(spark, d, "orders")
    return R.keys_gone(orders, orders.where("o_totalprice > 50000"), "o_orderkey")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS key, 'a' AS side FROM orders WHERE o_orderkey % 100 = 1 UNION ALL SELECT CAST(-o_orderkey AS VARCHAR), 'b' FROM orders WHERE o_orderkey % 100 = 1 AND o_orderkey > 0")
def key_diff_both_ways(spark, d):
    orders = load(spark, d, "orders")
    changed = orders.withColumn("o_orderkey", F.when(F.col("o_orderkey") % 100 == 1, -F.col("o_orderkey")).otherwise(F.col("o_orderkey")))
    return R.key_difference(orders, changed, "o_orderkey")


@query("WITH b AS (SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders) SELECT CAST(floor((o_orderkey - lo) / greatest(1, (hi - lo) // 20 + 1)) AS BIGINT) AS bucket, count(*) AS n FROM orders, b GROUP BY 1")
def key_buckets(spark, d):
    orders = load(spark, d, "orders")
    low, high = orders.agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    return Q.key_buckets(orders, "o_orderkey", low, high)


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def distinct_on_latest(spark, d):
    return O.distinct_on(load(spark, d, "events"), ["user_id"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", "event_type")


# audits, comparison, copying

_LINES = TableSpec("lineitem", (ColumnSpec("l_linenumber", "tinyint"), ColumnSpec("l_returnflag", "varchar(4)")))
_ORDERS = TableSpec("orders", (ColumnSpec("o_orderkey", "smallint"), ColumnSpec("o_orderpriority", "varchar(5)"), ColumnSpec("o_orderstatus", "char(1)"), ColumnSpec("o_custkey", "bigint unsigned")))


@query("SELECT count(*) AS rows, min(o_orderkey) AS min_o_orderkey, max(o_orderkey) AS max_o_orderkey, max(length(o_orderpriority)) AS length_o_orderpriority, max(length(o_orderstatus)) AS length_o_orderstatus, min(o_custkey) AS min_o_custkey, max(o_custkey) AS max_o_custkey FROM orders")
def audit_profile(spark, d):
    out = Q.audit_profile(load(spark, d, "orders"), _ORDERS)[0]
    return out.select(*[F.col(c).cast("long").alias(c) for c in out.columns])


@query("""SELECT 'lineitem' AS "table", c AS "column", 'missing column' AS problem FROM (VALUES ('l_orderkey'), ('l_partkey'), ('l_suppkey'), ('l_quantity'), ('l_extendedprice'), ('l_discount'), ('l_tax'), ('l_linestatus'), ('l_shipdate')) AS m(c)
UNION ALL SELECT 'nation', '*', 'missing in target'
UNION ALL SELECT 'region', '*', 'missing in source'
UNION ALL SELECT 'orders', c, 'missing column' FROM (VALUES ('o_totalprice'), ('o_orderdate')) AS m(c)
UNION ALL SELECT 'orders', 'o_orderkey', 'integer out of range' FROM orders HAVING max(o_orderkey) > 32767 OR min(o_orderkey) < -32768
UNION ALL SELECT 'orders', 'o_orderpriority', 'string too long' FROM orders HAVING max(length(o_orderpriority)) > 5""")
def audit_problems(spark, d):
    source = {t: load(spark, d, t) for t in ("lineitem", "orders", "nation")}
    target = {"lineitem": _LINES, "orders": _ORDERS, "region": TableSpec("region")}
    return Q.audit(spark, source, target).select("table", "column", "problem")


@query("""WITH m AS (SELECT * REPLACE (CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus) FROM orders WHERE o_orderkey % 1000 <> 7)
SELECT 'o_custkey' AS "column", 'min' AS measure, (SELECT min(o_custkey)::VARCHAR FROM orders) AS owner, (SELECT min(o_custkey)::VARCHAR FROM m) AS mirror
UNION ALL SELECT '*', 'rows', (SELECT count(*)::VARCHAR FROM orders), (SELECT count(*)::VARCHAR FROM m)
UNION ALL SELECT 'o_custkey', 'sum', (SELECT sum(o_custkey)::VARCHAR FROM orders), (SELECT sum(o_custkey)::VARCHAR FROM m)
UNION ALL SELECT 'o_custkey', 'max', (SELECT max(o_custkey)::VARCHAR FROM orders), (SELECT max(o_custkey)::VARCHAR FROM m)
UNION ALL SELECT 'o_custkey', 'nulls', '0', '0'
UNION ALL SELECT 'o_orderstatus', 'nulls', (SELECT count(*) FILTER (WHERE o_orderstatus IS NULL)::VARCHAR FROM orders), (SELECT count(*) FILTER (WHERE o_orderstatus IS NULL)::VARCHAR FROM m)
UNION ALL SELECT 'o_orderstatus', 'length', (SELECT sum(length(o_orderstatus))::VARCHAR FROM orders), (SELECT sum(length(o_orderstatus))::VARCHAR FROM m)""")
def compare_profile(spark, d):
    orders = load(spark, d, "orders")
    mirror = orders.where("o_orderkey % 1000 <> 7").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderstatus")))
    return Q.compare_profile(orders, mirror, ["o_custkey", "o_orderstatus"]).drop("differs")


@query("SELECT o_custkey, o_custkey % 7 AS rest FROM orders WHERE o_custkey % 2 = 1 GROUP BY o_custkey UNION ALL SELECT NULL, o_orderkey FROM orders WHERE o_orderkey % 40 = 0")
def copy_insert_ignore(spark, d):
    """One row of each key that the target lacks; null keys never clash."""
    orders = load(spark, d, "orders")
    rows = orders.select(F.col("o_custkey"), (F.col("o_custkey") % 7).alias("rest"))
    rows = rows.unionAll(orders.where("o_orderkey % 40 = 0").select(F.lit(None).cast(orders.schema["o_custkey"].dataType), F.col("o_orderkey")))
    return scans.insert_or_ignore(rows.where("o_custkey % 2 = 0"), rows, [["o_custkey"]])


@query("SELECT o_orderkey FROM orders WHERE o_orderkey > (SELECT max(o_orderkey) FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey < 5000)")
def copy_resume(spark, d):
    orders = load(spark, d, "orders")
    return scans.after_high_water(orders, orders.where("o_orderkey % 3 = 0 and o_orderkey < 5000"), "o_orderkey").select("o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 50")
def copy_sample(spark, d):
    return scans.most_recent(load(spark, d, "orders"), "o_orderkey", 50).select("o_orderkey", "o_totalprice")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00'")
def changed_since(spark, d):
    return scans.changed_since(load(spark, d, "events"), "2024-01-10 00:00:00", "ts").select("event_id")


# mirrors and history


def _stored(spark, d) -> tuple[DataFrame, DataFrame]:
    now = load(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", (F.col("o_orderkey") % 5).alias("v"))
    base = now.where("o_orderkey % 7 <> 0")
    new = now.where("o_orderkey % 3 = 0").select("o_orderkey", F.concat(F.lit("n"), "o_orderstatus").alias("o_orderstatus"), F.when(F.col("o_orderkey") % 11 != 0, F.lit(2)).cast("long").alias("v"))
    return base, new


_MERGED = """WITH b AS (SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderkey % 5 AS v FROM orders WHERE o_orderkey % 7 <> 0),
n AS (SELECT o_orderkey, 'n' || o_orderstatus AS s, CASE WHEN o_orderkey % 11 <> 0 THEN 2 END AS v FROM orders WHERE o_orderkey % 3 = 0)
SELECT coalesce(b.o_orderkey, n.o_orderkey) AS o_orderkey,
CASE WHEN n.o_orderkey IS NOT NULL AND (b.o_orderkey IS NULL OR n.v IS NULL OR b.v <= n.v) THEN n.s ELSE b.o_orderstatus END AS o_orderstatus, b.o_totalprice,
CASE WHEN n.o_orderkey IS NOT NULL AND (b.o_orderkey IS NULL OR n.v IS NULL OR b.v <= n.v) THEN n.v ELSE b.v END AS v FROM b FULL JOIN n ON b.o_orderkey = n.o_orderkey"""


@query(_MERGED)
def guarded_upsert_partial(spark, d):
    return M.merge(*_stored(spark, d), "o_orderkey", "v")


@query(_MERGED)
def guarded_upsert(spark, d):
    """The same rows again in two batches, the second one stale: nothing changes."""
    base, new = _stored(spark, d)
    once = M.merge(base, new, "o_orderkey", "v")
    return M.merge(once, new.where("v is not null").withColumn("v", F.col("v") - 100), "o_orderkey", "v")


def _summaries(spark, d):
    customers, nations = load(spark, d, "customer"), load(spark, d, "nation")

    def shaped(rows: DataFrame) -> DataFrame:
        out = rows.join(customers, F.col("o_custkey") == F.col("c_custkey"), "left").join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        return out.select("o_orderkey", "o_totalprice", F.col("n_name").alias("nation"))

    return M.MirrorSpec("orders", "order_summaries", "id", "o_orderkey", None, F.col("o_orderstatus") != "P", shaped)


@query("SELECT o_orderkey AS id, o_totalprice, n_name AS nation FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def mirror_reshaped(spark, d):
    return _summaries(spark, d).shaped(load(spark, d, "orders"))


def _log(spark, d) -> DataFrame:
    rows = load(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value")
    log = H.as_events(rows, "user_id", "ts", "event_id")
    return log.withColumn("row", F.when(F.col("row.event_type") != "error", F.col("row")))  # errors delete


_VERSIONS = """WITH one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) AS r FROM events) WHERE r = 1),
h AS (SELECT user_id AS key, event_id, event_type, ts AS _valid_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS _valid_to FROM one),
v AS (SELECT key, event_id, _valid_from, _valid_to FROM h WHERE event_type <> 'error')"""


def _plain(history: DataFrame) -> DataFrame:
    return history.select("key", "row.event_id", "_valid_from", "_valid_to")


@query(_VERSIONS + " SELECT * FROM v")
def history_intervals(spark, d):
    return _plain(H.intervals(_log(spark, d)))


@query(_VERSIONS + " SELECT * FROM v WHERE _valid_from <= TIMESTAMP '2024-01-15 12:00:00' AND (_valid_to IS NULL OR _valid_to > TIMESTAMP '2024-01-15 12:00:00')")
def history_as_of(spark, d):
    return _plain(H.as_of_valid_time(H.intervals(_log(spark, d)), "2024-01-15 12:00:00"))


@query(_VERSIONS + " SELECT * FROM v")
def history_late_version(spark, d):
    """Events that come late fill in only their own periods: the intervals are those of all events in order."""
    log = _log(spark, d)
    late = F.col("seq") % 5 == 0
    return _plain(H.intervals(H.append_events(log.where(~late), log.where(late))))


@query(_VERSIONS + " SELECT * FROM v WHERE _valid_from < TIMESTAMP '2024-01-20' AND (_valid_to IS NULL OR _valid_to > TIMESTAMP '2024-01-10')")
def history_overlap(spark, d):
    return _plain(H.valid_between(H.intervals(_log(spark, d)), "2024-01-10", "2024-01-20"))


def _scratch(spark) -> str:
    """A folder for versioned tables: the shared one where the session names it, a temporary one in local mode."""
    import tempfile
    import uuid

    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="portolan-")
    return f"{found.rstrip('/')}/store-{uuid.uuid4().hex}"


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 2 = 0")
def as_of_snapshot(spark, d):
    from .sources.store import HistoricalReads, SnapshotStore

    store, orders = SnapshotStore(spark, _scratch(spark)), load(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    first = store.commit("orders", orders.where("o_orderkey % 2 = 0"), "create")
    store.commit("orders", orders, "all")
    return HistoricalReads(store, "orders").as_of_time(first.committed_at).get()


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def read_current(spark, d):
    from .sources.store import HistoricalReads, SnapshotStore

    store, orders = SnapshotStore(spark, _scratch(spark)), load(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    store.commit("orders", orders.where("o_orderkey % 2 = 0"), "create")
    store.commit("orders", orders, "all")
    return HistoricalReads(store, "orders").as_of_time("2030-01-01").read_current().get()
