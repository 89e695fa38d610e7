"""Registered queries of copying, mirrors, streams, search, plans and the scanner, by the operators themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from .catalogue import _HAS, _SIMILAR, _TOKENS, _VERSIONS, _plain, _scratch, query
from .functions import fulltext
from .functions.json import on, with_incremented
from .functions.text import tokens
from .operators import filters as W
from .operators import history as H
from .operators import mirror as M
from .operators import ordering as O
from .operators import quality as Q
from .operators import scanner
from .plans import dialects
from .plans import tables as P
from .plans.tables import ColumnSpec, IndexSpec, TableSpec
from .session import load
from .sources import scans
from .sources.store import HistoricalReads, SnapshotStore, instant


def _store(spark) -> SnapshotStore:
    return SnapshotStore(spark, _scratch(spark))


def _in_order(df: DataFrame, *columns: str) -> DataFrame:
    """df, a few ordered rows, with their places from 1."""
    return df.select(*columns, F.row_number().over(Window.orderBy(F.monotonically_increasing_id())).cast("long").alias("place"))


# copying, audits, comparison

_ORDERS = TableSpec("orders", (ColumnSpec("o_orderkey", "bigint"), ColumnSpec("o_custkey", "bigint"), ColumnSpec("o_totalprice", "double"), ColumnSpec("o_comment", "text")), ("o_orderkey",), references=(("o_custkey", "customer"),))
_CUSTOMERS = TableSpec("customer", (ColumnSpec("c_custkey", "bigint"), ColumnSpec("c_name", "varchar(25)")), ("c_custkey",))
_TARGET = "o_orderkey long, o_custkey long, o_totalprice double, o_comment string"


def _copying(spark, d) -> tuple[SnapshotStore, SnapshotStore]:
    source, target = _store(spark), _store(spark)
    source.commit("orders", load(spark, d, "orders"), "create")
    source.commit("customer", load(spark, d, "customer"), "create")
    target.commit("orders", spark.createDataFrame([], _TARGET), "create")
    target.commit("customer", spark.createDataFrame([], "c_custkey long, c_name string"), "create")
    return source, target


@query("SELECT o_orderkey, o_custkey, o_totalprice, NULL::VARCHAR AS o_comment FROM orders")
def copy_tables(spark, d):
    """Shared columns are copied, columns that only the target has stay null."""
    source, target = _copying(spark, d)
    scans.copy(source, target, [_ORDERS, _CUSTOMERS])
    return target.read("orders")


@query("""SELECT 1 AS step, 'customer' AS "table", (SELECT count(*) FROM customer) AS "rows", 'would copy' AS status
UNION ALL SELECT 1, 'orders', (SELECT count(*) FROM orders), 'would copy' UNION ALL SELECT 2, 'customer', 10, 'copied' UNION ALL SELECT 2, 'orders', 10, 'copied'
UNION ALL SELECT 3, 'customer', (SELECT count(*) FROM customer) - 10, 'copied, 10 skipped' UNION ALL SELECT 3, 'orders', (SELECT count(*) FROM orders) - 10, 'copied, 10 skipped'
UNION ALL SELECT 4, 'customer', 0, 'copied' UNION ALL SELECT 4, 'orders', 0, 'copied' UNION ALL SELECT 5, 'customer', (SELECT max(c_custkey) + 1 FROM customer), 'next key' UNION ALL SELECT 5, 'orders', (SELECT max(o_orderkey) + 1 FROM orders), 'next key'""")
def copy_reports(spark, d):
    """A dry run, a sample, the rest, a resumed run with nothing left, and the keys that are free afterwards."""
    source, target = _copying(spark, d)
    specs = [_ORDERS, _CUSTOMERS]
    rows = []
    for step, given in enumerate(({"dry_run": True}, {"sample": 10}, {}, {"resume": True}), 1):
        rows += [(step, r.table, r.rows, r.status) for r in scans.copy(source, target, specs, **given)]
    rows += [(5, t, n, "next key") for t, n in scans.next_keys(target, specs).items()]
    return spark.createDataFrame(rows, "step int, table string, rows long, status string")


@query("""SELECT 'customer' AS "table", 1 AS place UNION ALL SELECT 'orders', 2 UNION ALL SELECT 'lineitem', 3""")
def foreign_keys_first(spark, d):
    lines = TableSpec("lineitem", references=(("l_orderkey", "orders"),))
    return spark.createDataFrame([(t.name, i) for i, t in enumerate(P.foreign_key_order([lines, _ORDERS, _CUSTOMERS]), 1)], "table string, place int")


@query("""SELECT 'orders' AS "table", 'o_totalprice' AS "column", 'double' AS type UNION ALL SELECT 'orders', 'o_orderkey', 'bigint'""")
def catalog_columns(spark, d):
    orders = load(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "o_totalprice")
    orders.createOrReplaceTempView("portolan_catalog_orders")
    found = scans.catalog(spark).where("table = 'portolan_catalog_orders'")
    return found.withColumn("table", F.regexp_replace("table", "portolan_catalog_", ""))


@query("""SELECT 'orders' AS "table", 'key' AS kind, 'o_orderkey' AS columns, NULL AS refers_to UNION ALL SELECT 'orders', 'foreign key', 'o_custkey', 'customer' UNION ALL SELECT 'orders', 'desc index', 'o_totalprice', NULL UNION ALL SELECT 'customer', 'key', 'c_custkey', NULL""")
def catalog_of_keys(spark, d):
    found = scans.catalog_keys(spark, [_ORDERS.with_index(IndexSpec("dear", ("o_totalprice",), "desc")), _CUSTOMERS])
    return found.select("table", "kind", F.concat_ws(",", "columns").alias("columns"), "refers_to")


@query("""SELECT 'lines' AS "table", 'l_orderkey' AS "column", 'integer out of range' AS problem, min(l_orderkey) || '..' || max(l_orderkey) AS detail FROM lineitem HAVING max(l_orderkey) > 255
UNION ALL SELECT 'lines', 'l_returnflag', 'string too long', '1' FROM (SELECT 1 WHERE false)""")
def audit_values_only(spark, d):
    spec = TableSpec("lines", (ColumnSpec("l_orderkey", "tinyint unsigned"), ColumnSpec("l_returnflag", "char(1)"), ColumnSpec("l_none", "int")))
    return Q.audit_values(load(spark, d, "lineitem"), spec)


@query("""WITH m AS (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 50 <> 1)
SELECT 'o_totalprice' AS label, 'column' AS owner, NULL AS mirror, 'missing in the mirror' AS note
UNION ALL SELECT 'extra', NULL, 'column', 'extra'
UNION ALL SELECT '*.rows', (SELECT count(*) FROM orders)::VARCHAR, (SELECT count(*) FROM m)::VARCHAR, 'differs'
UNION ALL SELECT 'o_orderkey.nulls', '0', '0', '' UNION ALL SELECT 'o_orderstatus.nulls', '0', '0', ''
UNION ALL SELECT 'o_orderstatus.length', (SELECT sum(length(o_orderstatus)) FROM orders)::VARCHAR, (SELECT sum(length(o_orderstatus)) FROM m)::VARCHAR, 'differs'
UNION ALL SELECT 'o_orderkey.sum', (SELECT sum(o_orderkey) FROM orders)::VARCHAR, (SELECT sum(o_orderkey) FROM m)::VARCHAR, 'differs'
UNION ALL SELECT 'keys only here', (SELECT count(*) FROM orders WHERE o_orderkey % 50 = 1)::VARCHAR, NULL, (SELECT string_agg(k, ', ' ORDER BY k) FROM (SELECT o_orderkey::VARCHAR AS k FROM orders WHERE o_orderkey % 50 = 1 ORDER BY k LIMIT 10))""")
def comparison_report(spark, d):
    orders = load(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    mirror = orders.where("o_orderkey % 50 <> 1").select("o_orderkey", "o_orderstatus", F.lit(1).alias("extra"))
    return Q.report(orders, mirror, "o_orderkey")[0].where("label not in ('o_orderkey.min', 'o_orderkey.max')")


@query("SELECT 3600 + date_diff('second', (SELECT max(ts) FROM events WHERE event_id % 2 = 0), (SELECT max(ts) FROM events)) AS seconds")
def mirror_lag(spark, d):
    events = load(spark, d, "events").select("event_id", F.col("ts").alias("updated_at"))
    behind = events.where("event_id % 2 = 0").withColumn("updated_at", F.col("updated_at") - F.expr("interval 1 hour"))
    return spark.createDataFrame([(Q.lag_seconds(events, behind),)], "seconds long")


@query("""SELECT 'n_name' AS "column", 'num_nulls' AS statistic, '0' AS value UNION ALL SELECT 'n_nationkey', 'num_nulls', '0' UNION ALL SELECT 'n_nationkey', 'min', min(n_nationkey)::VARCHAR FROM nation UNION ALL SELECT 'n_nationkey', 'max', max(n_nationkey)::VARCHAR FROM nation""")
def catalog_statistics(spark, d):
    """What the catalog knows of a table that was analysed."""
    spark.sql("DROP TABLE IF EXISTS portolan_nations")
    load(spark, d, "nation").select("n_nationkey", "n_name").write.option("path", _scratch(spark) + "/nations").saveAsTable("portolan_nations")
    spark.sql("ANALYZE TABLE portolan_nations COMPUTE STATISTICS FOR ALL COLUMNS")
    rows = [r for r in Q.table_statistics(spark, "portolan_nations") if r[1] != "distinct_count" and r[2] != "NULL"]
    spark.sql("DROP TABLE portolan_nations")
    return spark.createDataFrame(rows, "column string, statistic string, value string")


# filters, JSON, search


@query("SELECT p_partkey FROM part WHERE NOT p_name ILIKE '%e%' OR p_name ILIKE 'blue%'")
def where_not_like(spark, d):
    return load(spark, d, "part").where(W.either(W.not_like("p_name", "%E%"), W.like("p_name", "BLUE%"))).select("p_partkey")


@query("SELECT event_id FROM events WHERE month(ts) = 1 AND day(ts) = 9 AND strftime(ts, '%H:%M:%S') >= '12:30:00' AND year(ts) = 2024 OR CAST(ts AS DATE) = DATE '2024-01-05'")
def where_date_parts(spark, d):
    is_ = W.month_is("ts", 1) & W.day_is("ts", 9) & W.time_is("ts", ">=", "12:30") & W.year_is("ts", 2024)
    return load(spark, d, "events").where(W.either(is_, W.date_is("ts", "2024-01-05"))).select("event_id")


@query("SELECT event_id, event_id % 4 = 1 AS has, event_id % 4 AS size FROM events WHERE props->>'$.k' IS NOT NULL")
def where_json_contains(spark, d):
    """An array of the numbers below event_id % 4, and the 9 where that is 1."""
    listed = F.when(F.col("event_id") % 4 == 1, F.array(F.lit(9))).otherwise(F.filter(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda x: x < F.col("event_id") % 4))
    rows = load(spark, d, "events").withColumn("doc", F.to_json(F.struct(listed.alias("of"))))
    rows = rows.where(W.json_contains_key("props->k"))
    return rows.select("event_id", W.json_contains("doc->of", 9).alias("has"), W.json_length("doc->of").cast("long").alias("size"))


def _marked(spark, d) -> DataFrame:
    return load(spark, d, "events").select("event_id", F.when(F.col("event_type") == "error", F.col("ts")).alias("deleted_at"))


@query("SELECT event_id, 'hidden' AS seen FROM events WHERE event_type = 'error' UNION ALL SELECT event_id, 'shown' FROM events WHERE event_type <> 'error' UNION ALL SELECT event_id, 'any' FROM events WHERE event_id % 10 = 0")
def soft_deleted(spark, d):
    rows = _marked(spark, d)
    frames = ((W.only_deleted(rows), "hidden"), (W.not_deleted(rows), "shown"), (W.with_deleted(rows).where("event_id % 10 = 0"), "any"))
    each = [df.select("event_id", F.lit(seen).alias("seen")) for df, seen in frames]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query("SELECT a.event_id, try_cast(a.props->>'$.k' AS DOUBLE) AS mine, try_cast(b.props->>'$.k' AS DOUBLE) AS next, length(a.event_type) AS size FROM events a JOIN events b ON b.event_id = a.event_id + 1")
def json_on_sources(spark, d):
    events = load(spark, d, "events")
    both = events.alias("a").join(events.alias("b"), F.col("b.event_id") == F.col("a.event_id") + 1)
    a, b = on("a"), on("b")
    return both.select("a.event_id", a.json_number("props->k").alias("mine"), b.json_number("props->k").alias("next"), a.char_length("event_type").cast("long").alias("size"))


@query("SELECT event_id, coalesce(try_cast(props->>'$.k' AS DOUBLE), 0) + CASE WHEN event_type = 'view' THEN 7 ELSE 0 END AS k, CASE WHEN event_type = 'view' THEN 'seen' ELSE event_type END AS event_type, event_type = 'view' AS touched FROM events")
def json_increment_where(spark, d):
    """A path is raised, another column set and the row touched, where a condition holds; the rows are those of a commit."""
    store, events = _store(spark), load(spark, d, "events").select("event_id", "event_type", "props", F.lit(0).cast("timestamp").alias("updated_at"))
    store.commit("events", events, "create")
    store.update("events", lambda df: with_incremented(df, "props->k", 7, {"event_type": "seen"}, F.col("event_type") == "view"), "increment")
    rows = store.read("events")
    return rows.select("event_id", F.coalesce(on(rows).json_number("props->k"), F.lit(0.0)).alias("k"), "event_type", (F.col("updated_at") > F.lit("2000-01-01").cast("timestamp")).alias("touched"))


_IDF = "greatest(ln((n - n{0} + 0.5) / (n{0} + 0.5)), 1e-6) * {0} * 2.2 / ({0} + 1.2 * (0.25 + 0.75 * l / m))"
_RANKED = f"""{_TOKENS}, c AS (SELECT doc_id, len(ts) AS l, len([x FOR x IN ts IF x = 'mit']) AS a, len([x FOR x IN ts IF x = 'license']) AS b FROM t),
s AS (SELECT count(*) AS n, avg(l) AS m, count(*) FILTER (WHERE a > 0) AS na, count(*) FILTER (WHERE b > 0) AS nb FROM c),
r AS (SELECT doc_id, round({_IDF.format('a')} + {_IDF.format('b')}, 9) AS relevance FROM c, s WHERE a > 0 AND b > 0)"""


@query(_RANKED + " SELECT doc_id, relevance, rank() OVER (ORDER BY relevance DESC) AS place FROM r")
def search_full_text(spark, d):
    """Matching rows in the order of relevance: equal scores share a place."""
    docs = load(spark, d, "documents").select("doc_id", "text")
    found = fulltext.search(docs, "text", "mit LICENSE")
    order = found.select("doc_id", F.monotonically_increasing_id().alias("at"))
    scored = fulltext.with_relevance(docs, "text", "mit LICENSE").select("doc_id", F.round("relevance", 9).alias("relevance"))
    joined = order.join(scored, "doc_id").withColumn("place", F.row_number().over(Window.orderBy("at")).cast("long"))
    return joined.select("doc_id", "relevance", F.min("place").over(Window.partitionBy("relevance")).alias("place"))


@query(_RANKED + " SELECT relevance, row_number() OVER (ORDER BY relevance DESC) AS place FROM (SELECT coalesce(r.relevance, 0) AS relevance FROM documents LEFT JOIN r ON r.doc_id = documents.doc_id ORDER BY 1 DESC LIMIT 12)")
def order_by_full_text_relevance(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "text")
    top = fulltext.order_by_relevance(docs, "text", "mit license").limit(12)
    scored = fulltext.with_relevance(docs, "text", "mit license").select(F.col("doc_id").alias("id"), F.round("relevance", 9).alias("relevance"))
    placed = _in_order(top, "doc_id")
    return placed.join(scored, F.col("id") == F.col("doc_id")).select("relevance", "place")


@query("WITH t AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(lower(lang), '[^a-z]+') IF x <> ''] AS a, [x FOR x IN regexp_split_to_array(strip_accents(lower(text)), '[^\\p{L}\\p{N}]+') IF x <> ''] AS b FROM documents) SELECT doc_id, 'lang' AS searched FROM t WHERE list_contains(a, 'en') UNION ALL SELECT doc_id, 'both' FROM t WHERE (list_contains(a, 'en') OR list_contains(b, 'en')) AND (list_contains(a, 'the') OR list_contains(b, 'the'))")
def fulltext_of_columns(spark, d):
    docs = load(spark, d, "documents")
    one = fulltext.where_full_text(docs, "lang", "EN").select("doc_id", F.lit("lang").alias("searched"))
    return one.unionByName(fulltext.where_full_text(docs, ["lang", "text"], "en the").select("doc_id", F.lit("both").alias("searched")))


_INDEXED = f"{_TOKENS} SELECT doc_id FROM t WHERE {_HAS.format('the')} AND {_HAS.format('license')}"


@query(_INDEXED)
def fulltext_stored_index(spark, d):
    """The index of fewest columns that covers the searched one is used; another is dropped, and it is rebuilt once."""
    from .sources.search_index import FullTextIndexes

    store = _store(spark)
    store.commit("documents", load(spark, d, "documents").select("doc_id", "lang", F.substring("text", 1, 20).alias("text")), "create")
    indexes = FullTextIndexes(store)
    indexes.create("documents", "doc_id", ["lang", "text"])
    indexes.create("documents", "doc_id", ["lang"])
    store.commit("documents", load(spark, d, "documents").select("doc_id", "lang", "text"), "whole")
    indexes.rebuild(indexes.index_for("documents", ["text"]).name)
    indexes.drop("documents", ["lang"])
    return indexes.keys("documents", ["text"], "The LICENSE").withColumnRenamed("key", "doc_id")


@query(_SIMILAR.replace("blue stel", "blue") + ", u AS (SELECT DISTINCT p_name, similarity FROM s WHERE contains(lower(p_name), 'blue') OR similarity >= 0.3) SELECT p_name, row_number() OVER (ORDER BY CASE WHEN starts_with(lower(p_name), 'blue') THEN 0 ELSE 1 END, similarity DESC, length(p_name), p_name) AS place FROM u")
def suggest_in_order(spark, d):
    return _in_order(O.suggest(load(spark, d, "part").select("p_name").distinct(), "p_name", "Blue"), "p_name")


@query("SELECT p_partkey, len(list_distinct([substr(lower(p_name), i, 3) FOR i IN range(1, length(p_name) - 1)])) AS grams FROM part")
def trigram_tokens(spark, d):
    return load(spark, d, "part").select("p_partkey", F.size(F.array_distinct(tokens(F.col("p_name"), "trigram"))).cast("long").alias("grams"))


@query("SELECT p_partkey, 'lodz dolny odense' AS folded FROM part")
def fold_strokes(spark, d):
    from .functions.text import fold

    text = F.concat(F.lit("ŁÓDŹ Đolny Ødense"), F.substring(F.col("p_name"), 1, 0))
    return load(spark, d, "part").select("p_partkey", fold(text).alias("folded"))


@query("SELECT * FROM (VALUES ('2026-01-01T07:00:00+07:00', '2026-01-01T00:00:00.000000'), ('2026-01-01', '2026-01-01T00:00:00.000000'), ('2026-03-04 05:06:07.5', '2026-03-04T05:06:07.500000')) AS v(given, utc)")
def instants(spark, d):
    return spark.createDataFrame([(x, instant(x)) for x in ("2026-01-01T07:00:00+07:00", "2026-01-01", "2026-03-04 05:06:07.5")], "given string, utc string")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '{\"a\":6}' WHEN event_id % 3 = 1 THEN '{\"a\":6.5}' ELSE '{\"a\":1.5}' END AS doc FROM events")
def json_number_formats(spark, d):
    """Whole numbers stay whole, others keep their fraction."""
    of = F.when(F.col("event_id") % 3 == 0, '{"a":5}').when(F.col("event_id") % 3 == 1, '{"a":5.5}').otherwise('{"a":"0.5"}')
    rows = load(spark, d, "events").select("event_id", of.alias("doc"))
    return with_incremented(rows, "doc->a", 1)


# mirrors, history, streams


def _summary_mirror(spark, d, **more) -> tuple[M.Mirror, DataFrame]:
    orders, customers = load(spark, d, "orders"), load(spark, d, "customer").select("c_custkey", "c_mktsegment")

    def shaped(rows: DataFrame) -> DataFrame:
        return rows.join(customers, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "o_totalprice", F.col("c_mktsegment").alias("segment"))

    spec = M.MirrorSpec("orders", "order_summaries", "id", "o_orderkey", None, F.col("o_orderstatus") != "P", shaped, **more)
    mirror = M.Mirror(spec, _store(spark), lambda: orders)
    mirror.create()
    return mirror, orders


_KEPT = "SELECT o_orderkey AS id, o_totalprice, c_mktsegment AS segment FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P'"


@query(_KEPT)
def mirror_backfill(spark, d):
    """Some rows are there and stale, some aren't wanted any more: a backfill writes and removes them."""
    mirror, orders = _summary_mirror(spark, d)
    stale = orders.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"), F.lit(0.0).alias("o_totalprice"), F.lit("old").alias("segment"))
    mirror.upsert_rows(stale)
    mirror.backfill()
    return mirror.read()


@query("SELECT count(*) FILTER (WHERE o_orderstatus <> 'P') AS written, count(*) FILTER (WHERE o_orderstatus = 'P' AND o_orderkey % 2 = 0) AS removed FROM orders")
def mirror_backfill_counts(spark, d):
    mirror, orders = _summary_mirror(spark, d)
    mirror.upsert_rows(orders.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id")))
    told: list = []
    mirror.backfill(progress=lambda *x: told.append(x))
    return spark.createDataFrame(told, "written long, removed long")


@query(_KEPT.replace("WHERE", "WHERE o_orderkey % 3 <> 0 AND"))
def mirror_pruned(spark, d):
    """Rows whose owner went."""
    mirror, orders = _summary_mirror(spark, d)
    mirror.backfill()
    M.Mirror(mirror.spec, mirror.store, lambda: orders.where("o_orderkey % 3 <> 0")).prune()
    return mirror.read()


@query(_KEPT + " AND o_orderkey % 100 < 30 AND o_orderkey % 7 <> 0")
def mirror_synced_by_key(spark, d):
    """Keys are brought up to their owner's rows, and some removed; keys that nobody has do nothing."""
    mirror, orders = _summary_mirror(spark, d)
    mirror.sync(orders.where("o_orderkey % 100 < 30").select("o_orderkey").unionAll(spark.range(-5, 0).selectExpr("id as o_orderkey")))
    mirror.sync(orders.where("o_orderkey % 7 = 0").select("o_orderkey"), "remove")
    return mirror.read()


@query("SELECT 0 AS left_, (SELECT count(*) FROM orders WHERE o_orderstatus <> 'P') AS before")
def mirror_flushed(spark, d):
    mirror, _ = _summary_mirror(spark, d)
    mirror.backfill()
    before = HistoricalReads(mirror.store, mirror.spec.mirror).read_stale()
    mirror.flush()
    return spark.createDataFrame([(mirror.read().count(), before.get().count())], "left_ int, before long")


@query("SELECT * FROM (VALUES ('write', 'refused'), ('insert', 'refused'), ('update', 'refused'), ('delete', 'refused'), ('upsert', 'refused')) AS v(call, outcome)")
def mirror_is_read_only(spark, d):
    mirror, orders = _summary_mirror(spark, d)
    rows = []
    for call in ("write", "insert", "update", "delete", "upsert"):
        try:
            getattr(mirror, call)(orders)
            rows.append((call, "done"))
        except M.MirrorIsReadOnly:
            rows.append((call, "refused"))
    return spark.createDataFrame(rows, "call string, outcome string")


@query("SELECT o_orderkey AS id, 'paused' AS phase FROM orders WHERE o_orderkey % 10 = 1 UNION ALL SELECT o_orderkey, 'off' FROM orders WHERE o_orderkey % 10 = 1 UNION ALL SELECT o_orderkey, 'on' FROM orders WHERE o_orderkey % 10 IN (1, 4)")
def mirror_switches(spark, d):
    """Nothing is mirrored while mirroring is paused or switched off."""
    orders = load(spark, d, "orders").select("o_orderkey")
    registry = M.Registry(defaults={"version": None})
    spec = registry.register(M.MirrorSpec("orders", "order_keys", "id", "o_orderkey"))
    mirror = M.Mirror(spec, _store(spark), lambda: orders, registry)
    mirror.create()
    mirror.sync(orders.where("o_orderkey % 10 = 1"))
    with registry.without_mirroring("orders"):
        mirror.sync(orders.where("o_orderkey % 10 = 2"))
    paused = mirror.read().withColumn("phase", F.lit("paused"))
    registry.switch("order_keys", False)
    mirror.sync(orders.where("o_orderkey % 10 = 3"))
    off = mirror.read().withColumn("phase", F.lit("off"))
    registry.switch("order_keys", True)
    mirror.sync(orders.where("o_orderkey % 10 = 4"))
    return paused.unionByName(off).unionByName(mirror.read().withColumn("phase", F.lit("on")))


@query("SELECT * FROM (VALUES ('order_keys', 'orders', 'duplicate'), ('order_log', 'orders', 'no history store'), ('orders', 'orders', 'own table'), ('order_some', 'orders', 'unknown versions'), ('order_keys', 'orders', 'owner')) AS v(mirror, owner, outcome)")
def mirror_registry(spark, d):
    registry, rows = M.Registry(), []
    registry.register(M.MirrorSpec("orders", "order_keys"))
    tries = (("duplicate", "order_keys", {}), ("no history store", "order_log", {"versions": "all"}), ("own table", "orders", {}), ("unknown versions", "order_some", {"versions": "some"}))
    for outcome, mirror, given in tries:
        try:
            registry.register(M.MirrorSpec("orders", mirror, **given))
        except ValueError:
            rows.append((mirror, "orders", outcome))
    rows.append(("order_keys", registry.owner_of("order_keys"), "owner"))
    return spark.createDataFrame(rows, "mirror string, owner string, outcome string")


@query("SELECT o_orderkey AS id, o_totalprice * CASE WHEN o_orderkey % 5 = 2 THEN 2 ELSE 1 END AS o_totalprice FROM orders WHERE o_orderkey % 5 NOT IN (0, 3) AND o_orderstatus <> 'P'")
def mirror_captured_changes(spark, d):
    """The owner's writes log what they change, and the mirror catches up: some rows go, some change, some are marked deleted."""
    store, orders = _store(spark), load(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", F.lit(None).cast("timestamp").alias("deleted_at"))
    owner = M.Owner(store, "orders", "o_orderkey", "deleted_at")
    owner.write(orders)
    spec = M.MirrorSpec("orders", "order_prices", "id", "o_orderkey", None, F.col("o_orderstatus") != "P", lambda df: df.select("o_orderkey", "o_totalprice"), owner_query=W.not_deleted)
    mirror = M.Mirror(spec, store, lambda: store.read("orders"))
    mirror.create()
    owner.mirror(mirror)
    rest = F.col("o_orderkey") % 5
    owner.write(orders.where(rest != 0).withColumn("o_totalprice", F.col("o_totalprice") * F.when(rest == 2, 2).otherwise(1)))
    owner.write(store.read("orders").withColumn("deleted_at", F.when(rest == 3, F.lit("2026-01-01").cast("timestamp"))))
    owner.mirror(mirror)
    return mirror.read()


@query("SELECT count(*) FILTER (WHERE o_orderkey % 5 = 0) + count(*) AS changes, count(*) AS keys, 0 AS uncaptured FROM orders")
def mirror_queue_statistics(spark, d):
    store, orders = _store(spark), load(spark, d, "orders").select("o_orderkey", "o_totalprice")
    owner = M.Owner(store, "orders", "o_orderkey")
    mirror = M.Mirror(M.MirrorSpec("orders", "copies", "o_orderkey", None, None), store, lambda: store.read("orders"))
    owner.write(orders)
    mirror.create()
    owner.write(orders.where("o_orderkey % 5 <> 0"))
    found = owner.statistics(mirror)
    return spark.createDataFrame([(found["changes"], found["keys"], found["uncaptured"])], "changes long, keys long, uncaptured int")


def _event_log(spark, d) -> DataFrame:
    rows = load(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value")
    log = H.as_events(rows, "user_id", "ts", "event_id")
    return log.withColumn("row", F.when(F.col("row.event_type") != "error", F.col("row")))


@query(_VERSIONS + " SELECT * FROM v")
def history_stream(spark, d):
    """Every version of a stream of events, in three runs whose batches come in another order than the events."""
    from .streaming.apply import apply_versions

    store, log, folder = _store(spark), _event_log(spark, d), _scratch(spark)
    for part in (2, 0, 1):
        log.where(F.col("seq") % 3 == part).write.mode("append").parquet(f"{folder}/events")
        apply_versions(spark.readStream.schema(log.schema).parquet(f"{folder}/events"), store, "log", f"{folder}/checkpoint").awaitTermination()
    return _plain(H.intervals(store.read("log")))


@query(_VERSIONS + " SELECT * FROM v WHERE key % 4 <> 1")
def history_erased(spark, d):
    """Keys that are erased lose what the log had of them."""
    log = _event_log(spark, d)
    gone = log.where("key % 4 = 1").withColumn("erase", F.lit(True)).withColumn("row", F.lit(None).cast(log.schema["row"].dataType))
    return _plain(H.intervals(H.append_events(log, gone)))


@query("SELECT e.event_id FROM events e JOIN (SELECT user_id, max(ts) AS newest FROM events WHERE event_id % 2 = 0 GROUP BY user_id) USING (user_id) WHERE e.event_id % 2 = 1 AND e.ts >= newest UNION ALL SELECT event_id FROM events WHERE event_id % 2 = 1 AND user_id NOT IN (SELECT user_id FROM events WHERE event_id % 2 = 0)")
def history_latest_state_only(spark, d):
    """Events that are no older than what the log has of their key."""
    log = _event_log(spark, d)
    return H.not_older(log.where("seq % 2 = 0"), log.where("seq % 2 = 1")).select(F.col("seq").alias("event_id"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 2 = 0")
def read_stale_snapshot(spark, d):
    store, orders = _store(spark), load(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    store.commit("orders", orders.where("o_orderkey % 2 = 0"), "create")
    pinned = HistoricalReads(store, "orders").read_stale()
    store.append("orders", orders.where("o_orderkey % 2 = 1"), "more")
    return pinned.get()


@query("SELECT event_id AS id, event_type FROM events WHERE event_type <> 'error' AND event_id % 7 <> 3 OR event_id % 7 = 3 AND event_id % 2 = 0 AND event_type <> 'error'")
def stream_apply_events(spark, d):
    """All events are mirrored by a stream, errors not; a seventh is removed, and half of these come back later."""
    from .streaming.apply import apply_changes

    root, events = _scratch(spark), load(spark, d, "events").select("event_id", "event_type")
    mirror = M.Mirror(M.MirrorSpec("events", "seen", "id", "event_id", None, F.col("event_type") != "error"), SnapshotStore(spark, root), lambda: events)
    mirror.create()
    for batch in ((("sync", "true", 1),), (("remove", "event_id % 7 = 3", 2), ("sync", "event_id % 7 = 3 and event_id % 2 = 0", 3))):
        for action, given, seq in batch:
            M.change_rows(events.where(given), "event_id", action, seq).write.mode("append").parquet(f"{root}/changes")
        stream = spark.readStream.schema("key long, action string, seq long").parquet(f"{root}/changes")
        apply_changes(stream, mirror, f"{root}/checkpoint").awaitTermination()
    return mirror.read()


# plans


def _listed(spark, rows, names: str) -> DataFrame:
    return spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names.split()))


@query("SELECT * FROM (VALUES ('bigint unsigned', 'decimal(20,0)'), ('tinyint(1)', 'boolean'), ('varchar(9)', 'string'), ('jsonb', 'string'), ('decimal(12,2)', 'decimal(12,2)'), ('timestamptz', 'timestamp'), ('datetime', 'timestamp_ntz'), ('year', 'smallint'), ('bytea', 'binary'), ('geometry', 'none')) AS v(type, spark)")
def column_types(spark, d):
    given = ("bigint unsigned", "tinyint(1)", "varchar(9)", "jsonb", "decimal(12,2)", "timestamptz", "datetime", "year", "bytea", "geometry")
    kinds = [(t, P.map_type(ColumnSpec("c", t))) for t in given]
    return _listed(spark, [(t, k.simpleString() if k else "none") for t, k in kinds], "type spark")


@query("SELECT o_orderkey AS id, o_totalprice, o_orderdate, NULL::VARCHAR AS note FROM orders WHERE o_orderkey % 2 = 0")
def schema_plan_applied(spark, d):
    """A plan makes a table, the next one adds its new columns without writing its rows again."""
    store, orders = _store(spark), load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice", "o_orderdate")
    P.plan_schema("prices", orders.schema, "id").apply(store)
    M.Mirror(M.MirrorSpec("orders", "prices", version=None), store, lambda: orders.where("id % 2 = 0")).backfill()
    wider = orders.withColumn("note", F.lit(None).cast("string"))
    plan = P.plan_schema("prices", wider.schema, "id", store.read("prices").schema)
    plan.apply(store)
    return store.read("prices")


@query("SELECT * FROM (VALUES ('apply', 'CREATE TABLE `t` (`id` BIGINT, `v` STRING) USING parquet'), ('undo', 'DROP TABLE `t`'), ('apply', 'ALTER TABLE `t` ADD COLUMNS (`w` DOUBLE)'), ('undo', 'ALTER TABLE `t` DROP COLUMN `w`'), ('note', 'x is extra'), ('note', 'v is int, not string')) AS v(kind, text)")
def schema_plan_statements(spark, d):
    wanted = spark.createDataFrame([], "id long, v string").schema
    first = P.plan_schema("t", wanted, "id")
    second = P.plan_schema("t", spark.createDataFrame([], "id long, v string, w double").schema, "id", spark.createDataFrame([], "id long, v int, x int").schema)
    rows = [(kind, x) for plan in (first, second) for kind, xs in zip(("apply", "undo"), plan.migration()) for x in xs] + [("note", x) for x in second.notes]
    return _listed(spark, rows, "kind text")


@query("SELECT * FROM (VALUES ('full_text', 'title', 'ok'), ('trigram', 'title', 'missing'), ('like', 'body', 'missing'), ('prefix', 'title,body', 'outdated'), ('vector', 'none', 'skipped')) AS v(search, columns, status)")
def search_index_plan(spark, d):
    spec = TableSpec("t", (ColumnSpec("title", "text"), ColumnSpec("body", "text"))).with_index(IndexSpec("f", ("title",), "full_text")).with_index(IndexSpec("p", ("title",), "prefix"))
    found = P.plan_search(spec, {"full_text": ("title",), "trigram": ("title",), "like": ("body",), "prefix": ("title", "body"), "vector": ("none",)})
    return _listed(spark, [(s, ",".join(c), status) for s, c, status in found], "search columns status")


@query("SELECT event_id, k FROM (SELECT event_id, props->>'$.k' AS k FROM events)")
def json_key_index_column(spark, d):
    spec = TableSpec("events").with_index(IndexSpec("k", ("props->k",), "json_key")).with_index(IndexSpec("e", ("event_id",), "desc"))
    return P.laid_out(load(spark, d, "events"), spec).select("event_id", F.col("props__k").alias("k"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O'")
def partial_index_rows(spark, d):
    index = IndexSpec("open", ("o_orderkey",), "partial", ("o_totalprice",), "o_orderstatus = 'O'")
    return P.partial_rows(load(spark, d, "orders"), index)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'none' ELSE o_orderstatus END AS o_orderstatus, '{\"a\": 1}' AS meta FROM orders")
def column_defaults(spark, d):
    spec = TableSpec("orders", (ColumnSpec("o_orderstatus", "text", default="none"), ColumnSpec("meta", "json", default={"a": 1})))
    rows = load(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).alias("o_orderstatus"))
    return P.with_defaults(rows, spec)


@query("SELECT o_orderkey, CAST(o_orderkey % 2 AS INTEGER) = 1 AS odd, CAST(o_orderkey AS DOUBLE) AS amount FROM orders")
def inherited_casts(spark, d):
    spec = TableSpec("orders", (ColumnSpec("odd", "tinyint(1)"), ColumnSpec("amount", "double")))
    rows = load(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 2).alias("odd"), F.col("o_orderkey").cast("string").alias("amount"))
    return P.with_casts(rows, spec)


@query("SELECT * FROM (VALUES ('jdbc:mariadb://h/d', 'mariadb', 'mysql', 'b'), ('jdbc:postgresql://h/d', 'postgresql', 'pgsql', 'c'), ('jdbc:mysql://h/d', 'mysql', 'mysql', 'a'), ('/data/store', 'spark', 'spark', 'd')) AS v(address, driver, family, choice)")
def driver_choices(spark, d):
    choices = {"mysql, matrixone": "a", "mariadb": "b", "pgsql": "c", "default": "d"}
    rows = []
    for address in ("jdbc:mariadb://h/d", "jdbc:postgresql://h/d", "jdbc:mysql://h/d", "/data/store"):
        driver = dialects.driver_of(address)
        rows.append((address, driver, dialects.family_of(driver), dialects.pick(choices, driver)))
    return _listed(spark, rows, "address driver family choice")


@query("SELECT * FROM (VALUES ('up', 'refused'), ('ASC', 'asc'), ('desc', 'desc')) AS v(given, taken)")
def order_directions(spark, d):
    rows = []
    for given in ("up", "ASC", "desc"):
        try:
            rows.append((given, O.direction_of(given)))
        except ValueError:
            rows.append((given, "refused"))
    return _listed(spark, rows, "given taken")


# the scanner

#: A text for each rule, and what of it is found.
_CODE = [
    ("distinct-on", "select distinct on (a) b", "distinct on ("), ("group-concat", "group_concat(a)", "group_concat("), ("ifnull", "select ifnull(a, 0)", "ifnull("),
    ("ilike", "a ilike ?", "ilike"), ("json-extract-set", "json_extract(a, b)", "json_extract("), ("mysql-backtick", "select `a`", "`a`"),
    ("mysql-date-function", "curdate()", "curdate("), ("mysql-if", "select if(a, 1, 2)", "if("), ("mysql-insert-ignore", "insert ignore into a", "insert ignore"),
    ("mysql-json-function", "json_length(a)", "json_length("), ("mysql-limit-offset", "select a limit 5, 10", "limit 5, 10"), ("nulls-first-last", "a nulls last", "nulls last"),
    ("on-duplicate-key", "on duplicate key update a = 1", "on duplicate key update"), ("pg-cast", "a::int", "::int"), ("pg-date-function", "age(a)", "age("),
    ("pg-json-containment", "select a @> b", "@>"), ("pg-json-operator", "a->>'b'", "->>'b'"), ("pg-jsonb-function", "jsonb_set(a, b)", "jsonb_set("),
    ("pg-string-agg", "string_agg(a, b)", "string_agg("), ("pg-trigram", "similarity(a, b)", "similarity("), ("pg-typed-literal", "select date '2026-01-01'", "date '2026-01-01'"),
    ("returning", "delete from a returning id", "returning id"),
]
_VALUES = ", ".join(f"({i}, '{r}', '{m.replace(chr(39), chr(39) * 2)}', '{t.replace(chr(39), chr(39) * 2)}')" for i, (r, t, m) in enumerate(_CODE))


@query(f"SELECT doc_id, 3 + length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) AS line, rule, match, snippet FROM documents JOIN (VALUES {_VALUES}) AS v(i, rule, match, snippet) ON doc_id % {len(_CODE)} = i")
def scan_findings(spark, d):
    """Each document as a comment of a source file that has one of the constructs: all rules, whole texts."""
    texts = F.element_at(F.array(*[F.lit(t) for _, t, _ in _CODE]), (F.col("doc_id") % len(_CODE) + 1).cast("int"))
    comment = F.regexp_replace(F.coalesce("text", F.lit("")), r"\*/", "* ")
    code = F.concat(F.lit("<?php\n/* "), comment, F.lit(" */\n$db->raw(\""), texts, F.lit("\");\n"))
    files = load(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), code.alias("value"))
    found = scanner.scan_texts(files)
    return found.select(F.col("file").cast("long").alias("doc_id"), F.col("line").cast("long").alias("line"), "rule", "match", "snippet")


@query(f"SELECT rule FROM (VALUES {_VALUES}) AS v(i, rule, match, snippet) WHERE rule IN ('distinct-on', 'ilike', 'mysql-date-function', 'mysql-if', 'mysql-insert-ignore', 'mysql-json-function', 'on-duplicate-key', 'pg-cast', 'pg-date-function', 'pg-json-containment', 'pg-json-operator', 'pg-jsonb-function', 'pg-string-agg', 'pg-trigram', 'pg-typed-literal')")
def scan_for_target(spark, d):
    """Only rules that the target family lacks."""
    files = spark.createDataFrame([("a.php", "<?php\n" + "".join(f'$db->raw("{t}");\n' for _, t, _ in _CODE))], "path string, value string")
    return scanner.scan_texts(files, targets=("sqlite",)).select("rule")
