"""Contracts, mirror hooks and registry, search indexes, commands."""

import json
import sys

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from portolan import contracts
from portolan.cli import main
from portolan.functions import fulltext
from portolan.functions.json import on, with_incremented
from portolan.operators import filters as W
from portolan.operators import mirror as M
from portolan.plans import dialects
from portolan.plans.tables import plan_schema
from portolan.sources.search_index import FullTextIndexes
from portolan.sources.store import HistoricalReads, SnapshotStore


@pytest.fixture
def store(spark, tmp_path):
    return SnapshotStore(spark, str(tmp_path / "store"))


def test_contracts_replace_the_operators(spark, store):
    class Box:
        def where_full_text(self, df, columns, text, mode, language):
            return df.where(F.lit(text == "ask me"))

        def with_relevance(self, df, columns, text, name, mode, language):
            return df.withColumn(name, F.lit(7.0))

    class Near:
        def similarity(self, column, value, unaccent):
            return F.lit(1.0)

    df = spark.createDataFrame([(1, "x")], "id long, text string")
    try:
        contracts.use(contracts.SearchBox, Box())
        contracts.use(contracts.SimilaritySearch, Near())
        assert fulltext.where_full_text(df, "text", "ask me").count() == 1 and fulltext.where_full_text(df, "text", "x").count() == 0
        assert fulltext.with_relevance(df, "text", "x").first()["relevance"] == 7 and df.where(W.similar("text", "other")).count() == 1
        with pytest.raises(TypeError):
            contracts.use(contracts.SearchBox, Near())
    finally:
        contracts.use(contracts.SearchBox, None)
        contracts.use(contracts.SimilaritySearch, None)
    assert fulltext.where_full_text(df, "text", "x").count() == 1 and df.where(W.similar("text", "other")).count() == 0
    assert isinstance(HistoricalReads(store, "t"), contracts.HistoricalReads)


def test_mirror_hooks(spark, store):
    owner = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "c", 3)], "id long, v string, n int")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("n", T.StringType()), T.StructField("note", T.StringType())])
    spec = M.MirrorSpec("o", "m", "id", None, None, owner_query=lambda df: df.where("n > 1"), columns=schema, alias="things")
    mirror = M.Mirror(spec, store, lambda: owner)
    mirror.create()
    mirror.backfill()
    assert sorted(map(tuple, mirror.read().collect())) == [(2, "2", None), (3, "3", None)] and spec.name == "things"
    mirror.sync(spark.createDataFrame([(1,), (2,)], "id long"))
    assert mirror.read().count() == 2


def test_registry(spark, store, tmp_path, monkeypatch):
    registry = M.Registry(defaults={"version": "changed", "valid_time": "since"}, history_store=store)
    spec = registry.register(M.MirrorSpec("o", "m", versions="all"))
    assert (spec.version, spec.valid_time) == ("changed", "since") and registry.register(M.MirrorSpec("o", "n", version="v")).version == "v"
    with pytest.raises(ValueError):
        M.Registry().register(M.MirrorSpec("o", "m", versions="all"))
    with pytest.raises(ValueError):
        M.Registry(defaults={"colour": 1}).register(M.MirrorSpec("o", "m"))
    folder = tmp_path / "app_models"
    folder.mkdir()
    (folder / "__init__.py").write_text("")
    (folder / "b.py").write_text("from portolan.operators.mirror import MirrorSpec\nSPEC = MirrorSpec('orders', 'order_copies')\nSAME = SPEC\nOTHER = 3\n")
    (folder / "a.py").write_text("from portolan.operators.mirror import MirrorSpec\nusers = MirrorSpec('users', 'user_copies')\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    found = M.Registry().discover("app_models")
    assert [s.mirror for s in found] == ["user_copies", "order_copies"]
    for name in [n for n in sys.modules if n.startswith("app_models")]:
        del sys.modules[name]


def test_search_indexes(spark, store):
    store.commit("t", spark.createDataFrame([(1, "red apple", "x"), (2, "green pear", "red")], "id long, title string, body string"), "create")
    indexes = FullTextIndexes(store)
    both, one = indexes.create("t", "id", ["title", "body"]), indexes.create("t", "id", ["title"])
    assert indexes.index_for("t", ["title"]) == one and indexes.index_for("t", ["body"]) == both and indexes.definition(one.name) == one
    keys = lambda columns, text: sorted(r.key for r in indexes.keys("t", columns, text).collect())
    assert keys(["title"], "Red") == [1] and keys(["title", "body"], "red") == [1, 2] and keys(["body"], "red") == [2]
    store.commit("t", spark.createDataFrame([(3, "blue", "plum")], "id long, title string, body string"), "more")
    assert keys(["title"], "blue") == []
    indexes.rebuild(one.name)
    assert keys(["title"], "blue") == [3]
    assert indexes.drop("t", ["title"]) == [one.name] and [i.name for i in indexes.of("t")] == [both.name]
    with pytest.raises(LookupError):
        indexes.index_for("t", ["title"], "english")
    with pytest.raises(ValueError):
        indexes.create("t", "id", ["none"])
    indexes.drop_table("t")
    assert store.tables() == []


def test_schema_plans_apply(spark, store):
    first = spark.createDataFrame([], "id long, v string")
    plan_schema("t", first.schema, "id").apply(store)
    store.commit("t", spark.createDataFrame([(1, "a")], "id long, v string"), "rows")
    wider = spark.createDataFrame([], "id long, v string, w double").schema
    plan_schema("t", wider, "id", store.read("t").schema).apply(store)
    plan_schema("t", wider, "id", store.read("t").schema).apply(store)  # nothing to do
    assert list(map(tuple, store.read("t").collect())) == [(1, "a", None)] and len(store.snapshots("t")) == 3 and store.at("t").key == "id"
    spark.sql("DROP TABLE IF EXISTS portolan_plan")
    plan_schema("portolan_plan", first.schema, "id").apply(spark)
    plan_schema("portolan_plan", wider, "id", spark.table("portolan_plan").schema).apply(spark)
    assert spark.table("portolan_plan").columns == ["id", "v", "w"]
    spark.sql("DROP TABLE portolan_plan")


def test_incremented_columns(spark):
    df = spark.createDataFrame([(1, '{"a":1}', "x"), (2, None, "y")], "id long, doc string, tag string").withColumn("updated_at", F.lit(None).cast("timestamp"))
    got = {r.id: r for r in with_incremented(df, "doc->a", 2, {"tag": "new"}, F.col("id") == 1).collect()}
    assert (got[1].doc, got[1].tag, got[1].updated_at is None) == ('{"a":3}', "new", False)
    assert (got[2].doc, got[2].tag, got[2].updated_at) == (None, "y", None)
    q = df.alias("q")
    assert [tuple(r) for r in q.select(on("q").json_number("doc->a"), on(df).char_length("tag")).orderBy(F.col("id")).collect()][0] == (1.0, 1)


def test_drivers():
    assert dialects.pick({"mysql,sqlite": 1, "default": 2}, "mariadb") == 1 and dialects.pick({"pgsql": 1, "cockroach": 3}, "cockroach") == 3
    with pytest.raises(LookupError):
        dialects.pick({"mysql": 1}, "pgsql")
    with pytest.raises(ValueError):
        dialects.family_of("oracle")


def test_mirror_and_index_commands(spark, store, tmp_path, capsys):
    store.commit("o", spark.createDataFrame([(1, "red", 1), (2, "blue", 0)], "id long, name string, shown int"), "create")
    spec = tmp_path / "spec.json"
    spec.write_text(json.dumps({"owner": "o", "mirror": "m", "key": "id", "version": None, "keep": "shown = 1"}))

    def run(*given):
        code = main([*given, "--json"])
        return code, json.loads(capsys.readouterr().out)

    code, rows = run("mirror", "sync", store.root, str(spec))
    assert code == 0 and {"written": 1, "removed": 0} in rows and any("CREATE TABLE" in r.get("schema", "") for r in rows)
    assert [r.id for r in store.read("m").collect()] == [1]
    store.commit("o", spark.createDataFrame([(1, "red", 1), (3, "grey", 1)], "id long, name string, shown int"), "more")
    assert run("mirror", "stats", store.root, str(spec))[0] == 1
    assert run("mirror", "data", store.root, str(spec))[1] == [{"written": 2, "removed": 0}]
    assert run("mirror", "flush", store.root, str(spec))[0] == 0 and store.read("m").count() == 0
    asked = ("search-indexes", store.root, "o", "--columns", "name")
    assert run(*asked)[0] == 1
    code, rows = run(*asked, "--apply")
    assert code == 0 and rows[0]["status"] == "made"
    assert run(*asked, "--rebuild")[1][0]["status"] == "rebuilt" and run("search-indexes", store.root, "o")[1][0]["status"] == "other"
