"""Relations, audits, comparison, copying, schemas, scanner, command line."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from portolan.cli import main
from portolan.operators import quality as Q
from portolan.operators import relations as R
from portolan.operators import scanner
from portolan.plans import tables as P
from portolan.sources import scans
from portolan.sources.store import SnapshotStore


def test_relations(spark):
    parents = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, name string")
    children = spark.createDataFrame([(10, 1, 5), (11, 1, 7), (12, 2, 1)], "id long, parent long, n int")
    assert [r.id for r in R.where_has(parents, children, "id", "parent", F.col("n") > 4).collect()] == [1]
    assert sorted(r.id for r in R.has(parents, children, "id", "parent", "=", 0).collect()) == [3]
    assert sorted((r.id, r["count"]) for r in R.with_count(parents, children, "id", "parent").collect()) == [(1, 2), (2, 1), (3, 0)]
    many = {r.id: [c.id for c in r.children] for r in R.with_many(parents, children, "id", "parent", "children").collect()}
    assert many == {1: [10, 11], 2: [12], 3: []}
    assert R.with_one(children, parents, "parent", "id", "owner").where("owner.name = 'a'").count() == 2
    diff = {tuple(r) for r in R.key_difference(parents, parents.where("id > 1").union(spark.createDataFrame([(9, "z")], parents.schema)), "id").collect()}
    assert diff == {("1", "a"), ("9", "b")}


SOURCE = "id long, title string, view_count long, score long, is_public boolean, legacy string, published_at string"
TARGET = P.TableSpec("tool_videos", (
    P.ColumnSpec("id", "bigint"), P.ColumnSpec("title", "varchar(20)"), P.ColumnSpec("view_count", "int"), P.ColumnSpec("score", "tinyint", unsigned=True),
    P.ColumnSpec("is_public", "boolean"), P.ColumnSpec("published_at", "timestamp"),
), ("id",))


def test_audit(spark):
    rows = [(1, "x" * 37, 15950438052, 500, True, "l", "2026-01-01 07:00:00+07"), (2, None, None, None, None, None, None)]
    source = {"tool_videos": spark.createDataFrame(rows, SOURCE), "tool_only_source": spark.range(1)}
    got = sorted((r.table, r.column, r.problem) for r in Q.audit(spark, source, {"tool_videos": TARGET}).collect())
    assert got == [
        ("tool_only_source", "*", "missing in target"), ("tool_videos", "legacy", "missing column"), ("tool_videos", "score", "integer out of range"),
        ("tool_videos", "title", "string too long"), ("tool_videos", "view_count", "integer out of range"),
    ]


def test_compare_and_keys(spark):
    a = spark.createDataFrame([(i, f"n{i}", float(i)) for i in range(100)], "id long, name string, x double")
    b = a.where("id <> 50").union(spark.createDataFrame([(150, "n50", 50.0)], a.schema))
    assert Q.compare_profile(a, a).where("differs").count() == 0
    assert {(r.column, r.measure) for r in Q.compare_profile(a, b).where("differs").collect()} >= {("id", "max"), ("id", "sum")}
    assert sorted((r.side, r.n, r["keys"]) for r in Q.key_report(a, b, "id").collect()) == [("a", 1, ["50"]), ("b", 1, ["150"])]
    swapped = a.where("id <> 3").union(spark.createDataFrame([(3, "n3", 3.0)], a.schema).withColumn("id", F.lit(2).cast("long")))
    assert Q.report(a, swapped, "id")[1] and not Q.report(a, a, "id")[1]
    tens = spark.createDataFrame([("10.50",)], "v string").select(F.col("v").cast("decimal(10,2)").alias("v"))
    ones = tens.select(F.col("v").cast("double").alias("v"))
    assert Q.compare_profile(tens, ones).where("differs").count() == 0


def test_copy(spark, tmp_path):
    source, target = SnapshotStore(spark, str(tmp_path / "a")), SnapshotStore(spark, str(tmp_path / "b"))
    codes = P.TableSpec("tool_codes", (), ("id",), (("code",),))
    videos = P.TableSpec("tool_videos", TARGET.columns, ("id",))
    source.commit("tool_codes", spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id long, code string"), "create")
    target.commit("tool_codes", spark.createDataFrame([], "id long, code string"), "create")
    source.commit("tool_videos", spark.createDataFrame([(1, "x", 1, 1, True, "l", "2026-01-01 07:00:00+07")], SOURCE), "create")
    target.commit("tool_videos", spark.createDataFrame([], "id long, title string, published_at timestamp_ntz"), "create")
    got = {r.table: (r.rows, r.status) for r in scans.copy(source, target, [codes, videos, P.TableSpec("gone")])}
    assert got["tool_codes"] == (2, "incomplete: the target has 2 of 3 row(s), 1 skipped")
    assert got["tool_videos"] == (1, "copied") and got["gone"] == (0, "missing on one side")
    assert str(target.read("tool_videos").first()["published_at"]) == "2026-01-01 00:00:00"
    assert scans.copy(source, target, [videos], dry_run=True)[0].status == "would copy"
    source.commit("tool_videos", source.read("tool_videos").union(source.read("tool_videos").withColumn("id", F.lit(2).cast("long"))), "more")
    assert scans.copy(source, target, [videos], resume=True)[0].rows == 1
    assert main(["stats", str(tmp_path / "a"), str(tmp_path / "b"), "tool_codes"]) == 1


def test_foreign_key_order():
    a, b = P.TableSpec("books", references=(("author_id", "authors"),)), P.TableSpec("authors")
    assert [t.name for t in P.foreign_key_order([a, b])] == ["authors", "books"]
    x, y = P.TableSpec("x", references=(("y", "y"),)), P.TableSpec("y", references=(("x", "x"),))
    assert [t.name for t in P.foreign_key_order([x, y])] == ["x", "y"]


@pytest.mark.parametrize("type_, cast, want", [
    ("tinyint(1)", None, T.BooleanType()), ("int unsigned", None, T.LongType()), ("bigint unsigned", None, T.DecimalType(20, 0)), ("jsonb", None, T.StringType()),
    ("year", None, T.ShortType()), ("decimal(10,2)", None, T.DecimalType(10, 2)), ("numeric", "decimal:4", T.DecimalType(38, 4)), ("decimal(60,40)", None, T.DecimalType(38, 38)),
    ("double precision", None, T.DoubleType()), ("varchar(20)", None, T.StringType()), ("timestamptz", None, T.TimestampType()), ("datetime", None, T.TimestampNTZType()),
    ("bytea", None, T.BinaryType()), ("int", "boolean", T.BooleanType()), ("text", "encrypted:array", T.StringType()), ("geometry", None, None), ("vector", "float", T.DoubleType()),
])
def test_types(type_, cast, want):
    assert P.map_type(P.ColumnSpec("c", type_, cast)) == want


def test_schema_plan():
    wanted = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])
    new = P.plan_schema("m", wanted, "id")
    assert new.sql() == ["CREATE TABLE `m` (`id` BIGINT, `name` STRING) USING parquet"] and new.migration()[1] == ["DROP TABLE `m`"]
    more = P.plan_schema("m", wanted, "id", T.StructType([T.StructField("id", T.LongType()), T.StructField("old", T.StringType())]))
    assert more.sql() == ["ALTER TABLE `m` ADD COLUMNS (`name` STRING)"] and more.notes == ("old is extra",)
    assert P.plan_schema("m", wanted, "id", wanted).sql() == []
    with pytest.raises(ValueError):
        P.plan_schema("m", wanted, "key")


def test_search_plan():
    spec = P.TableSpec("posts", tuple(P.ColumnSpec(c, "text") for c in ("title", "body", "word"))).with_index(P.IndexSpec("ft", ("title",), "full_text"))
    got = P.plan_search(spec, {"full_text": ("title", "body"), "trigram": ("word",), "vector": ("embedding",)})
    assert [s for *_, s in got] == ["outdated", "missing", "skipped"]
    assert P.plan_search(spec, {"full_text": ("title",)})[0][2] == "ok"
    with pytest.raises(ValueError):
        spec.with_index(P.IndexSpec("ft", ("body",)))
    assert spec.without_index("ft").indexes == ()


def test_layouts(spark):
    df = spark.createDataFrame([(1, '{"a":"x"}'), (2, '{"a":"y"}'), (3, None)], "id long, meta string").coalesce(1)
    spec = P.TableSpec("t", indexes=(P.IndexSpec("k", ("meta->a",), "json_key"), P.IndexSpec("d", ("id",), "desc")))
    assert [(r.id, r.meta__a) for r in P.laid_out(df, spec).collect()] == [(3, None), (2, "y"), (1, "x")]
    assert [tuple(r) for r in P.partial_rows(df, P.IndexSpec("p", ("id",), "partial", where="meta is null")).collect()] == [(3,)]
    with pytest.raises(ValueError):
        spec.with_index(P.IndexSpec("x", ("id",), "desc", directions=("down",)))


def test_values_and_defaults(spark):
    import datetime
    import enum

    class Color(enum.Enum):
        RED = "red"

    zone = datetime.timezone(datetime.timedelta(hours=7))
    assert P.plain_value(Color.RED) == "red" and P.plain_value(["é", 1]) == '["é", 1]'
    assert P.plain_value(datetime.datetime(2026, 1, 1, 7, tzinfo=zone)) == datetime.datetime(2026, 1, 1, 7)
    spec = P.TableSpec("t", (P.ColumnSpec("meta", "json", default={"a": 1}), P.ColumnSpec("n", "int", default=5), P.ColumnSpec("id", "bigint")))
    got = P.with_defaults(spark.createDataFrame([(1, None), (2, "{}")], "id long, meta string"), spec).orderBy("id").collect()
    assert [(r.meta, r.n) for r in got] == [('{"a": 1}', 5), ("{}", 5)]
    assert P.infer_type(True) == T.BooleanType() and P.infer_type(1.5) == T.DoubleType() and P.infer_type({}) == T.StringType()


def found(source, targets=()):
    return [f"{line}:{rule}" for line, rule, *_ in scanner.findings(source, targets)]


#: For each construct a text that has it, and how often; texts are this test's own.
CONSTRUCTS = {
    "distinct-on": ("select distinct on (city) city, born from people", 1),
    "group-concat": ("group_concat(tag)", 1),
    "ifnull": ("where ifnull(points, 0) > 3", 1),
    "ilike": ("city ilike ?", 1),
    "json-extract-set": ("json_extract(doc, '$.a') = json_set(doc, '$.b', 1)", 2),
    "mysql-backtick": ("select `city` from `people`", 2),
    "mysql-date-function": ("date_format(born, '%m') and curdate ()", 2),
    "mysql-if": ("select if(a > b, 1, 2)", 1),
    "mysql-insert-ignore": ("insert  ignore into people", 1),
    "mysql-json-function": ("json_length(doc) + json_merge_patch(a, b)", 2),
    "mysql-limit-offset": ("select a from b limit 5 , 10", 1),
    "nulls-first-last": ("born desc nulls last, city Nulls First", 2),
    "on-duplicate-key": ("on duplicate key update a = 1", 1),
    "pg-cast": ("born::date, x :: double precision, y::int8[]", 3),
    "pg-date-function": ("date_trunc('day', born), age(born)", 2),
    "pg-json-containment": ("where doc @> ? and tags ?| ? or a <@ b", 3),
    "pg-json-operator": ("doc->'a'->>'b'", 2),
    "pg-jsonb-function": ("jsonb_set(a, b) || json_build_object()", 2),
    "pg-string-agg": ("string_agg(tag, ',')", 1),
    "pg-trigram": ("similarity(a, ?) > word_similarity(a, ?) using gin_trgm_ops", 3),
    "pg-typed-literal": ("select date '2026-03-01', interval  '1 day'", 2),
    "returning": ("delete from people returning id, city", 1),
}


def code(text, quote='"'):
    return "<?php\n$db->raw(" + quote + text.replace("\\", "\\\\").replace(quote, "\\" + quote) + quote + ");"


@pytest.mark.parametrize("rule", sorted(CONSTRUCTS))
def test_scanner_finds_each_construct(rule):
    text, n = CONSTRUCTS[rule]
    quote = "'" if "'" not in text else '"'
    assert found(code(text, quote)).count(f"2:{rule}") == n
    breaks = next(r.breaks_on for r in scanner.RULES if r.id == rule)
    for family in scanner.FAMILIES:
        assert (f"2:{rule}" in found(code(text, quote), (family,))) == (family in breaks)


def test_scanner_leaves_portable_code_alone():
    for text in (
        "doc->>'$.path' = ?", "cast(a as bigint) || b", "std::vector and Foo::class", "a - > 'b'", "coalesce(a, b) order by nullable desc", "json_array(a)", "notify (a) and iffy (b)",
        "the returning customers were 3", "limit 10 offset 5", "update dates set x = 'a'", "distinct one (a)", "my_similarity (a)",
    ):
        assert found(code(text)) == [], text
    assert found("<?php $text = 'see `city` (if any), returning late';") == []  # no SQL, and no call that takes any
    assert found("<?php $text = 'is null or nulls last';") == ["1:nulls-first-last"]  # in any text
    with pytest.raises(ValueError):
        found("<?php", ("oracle",))


def read(source):
    return [(line, text, called) for line, text, called in scanner.Reader(source).read()]


def test_php_literals():
    assert read("don't <b>\"x\"</b> <?php echo 'a'; ?> it's <?= 'b' ?>") == [(1, "a", False), (1, "b", False)]
    assert read("<?php // it's\n# don't\n/* 'no'\n */ #[Route('/x')]\n$a = 'y';") == [(4, "/x", False), (5, "y", False)]
    assert read("<?php // closed ?> 'html' <?php 'in';") == [(1, "in", False)]
    assert read(r'''<?php 'it\'s' . "say \"hi\"";''') == [(1, r"it\'s", False), (1, r'say "hi"'.replace('"', '\\"'), False)]
    assert read("<?php $q->whereRaw(/* c */ 'a' . 'b', 'c');") == [(1, "a", True), (1, "b", False), (1, "c", False)]
    assert read("<?php DB::SELECT('a'); $this->draw('b'); where('c'); raw ( $x 'd');") == [(1, "a", True), (1, "b", True), (1, "c", False), (1, "d", True)]
    assert read('<?php raw("a $b c {$d[\'k\']} e");') == [(1, "a ", True), (1, " c ", True), (1, "k", False), (1, " e", False)]
    assert read('<?php raw("a $b->c d");') == [(1, "a ", True), (1, " d", False)]
    assert read('<?php f("$x"); g("");') == [(1, "", False)]
    assert read("<?php raw(<<<SQL\n  one\n  $two three\n  SQL, 'x');") == [(2, "  one\n  ", True), (3, " three", True), (4, "x", False)]
    assert read("<?php f(<<<'SQL'\n  one $two\nSQL);") == [(2, "  one $two", False)]
    assert read("<?php 'never closed") == [(1, "never closed", False)] and read("no code 'x'") == []


def test_scanner_lines_and_snippets():
    source = "<?php\nDB::select(<<<TEXT\n    select city\n    from people\n    order by born nulls first\nTEXT);\n$a = \"x\n y ilike z\";"
    assert found(source) == ["5:nulls-first-last", "8:ilike"]
    assert [r[2] for r in scanner.findings(source)] == ["nulls first", "ilike"]
    assert scanner.snippet("a" * 50 + "\n  b" + "c" * 200, 52) == "…" + "a" * 38 + " b" + "c" * 58 + "…"


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "vendor").mkdir()
    for p in (tmp_path / "a.php", tmp_path / "vendor" / "b.php"):
        p.write_text("<?php\nDB::raw('x desc nulls last');\n")
    assert main(["scan", str(tmp_path), "--json"]) == 1
    got = json.loads(capsys.readouterr().out)
    assert [(r["line"], r["rule"]) for r in got] == [(2, "nulls-first-last")]


def test_statistics(spark):
    spark.createDataFrame([(1, None), (2, "x")], "id long, name string").write.mode("overwrite").saveAsTable("portolan_stats")
    spark.sql("ANALYZE TABLE portolan_stats COMPUTE STATISTICS FOR ALL COLUMNS")
    assert ("name", "num_nulls", "1") in Q.table_statistics(spark, "portolan_stats")
    assert scans.catalog(spark).where("table = 'portolan_stats'").count() == 2
    spark.sql("DROP TABLE portolan_stats")


def test_entry_works_without_the_optional_parts():
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['portolan.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'rollup_two_level' in e.queries() and not [k for k in e.queries() if k.startswith('op')]; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parent.parent, check=True)
