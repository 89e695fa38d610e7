"""Literals of the search, JSON and analytics fixtures."""

import pytest
from pyspark.sql import functions as F

from portolan.functions import fulltext
from portolan.functions.fulltext import Query, Term, parse, search, where_full_text, with_relevance
from portolan.functions.json import decrement_json, increment_json, json_bool, json_number, json_text, split_path
from portolan.functions.stemmer import stem
from portolan.functions.text import escape_like, fold, similarity, tokens_of, trigrams_of
from portolan.operators import aggregates as A
from portolan.operators import filters as W
from portolan.operators import ordering as O


@pytest.fixture(scope="module")
def items(spark):
    rows = [
        (1, '{"amount":199000,"ratio":0.85,"sync":true,"profile_index":10,"device":"ios"}', 5),
        (2, '{"amount":"5000","ratio":0.2,"sync":false,"profile_index":2,"device":"android"}', None),
        (3, "{}", 7), (4, None, None),
    ]
    return spark.createDataFrame(rows, "id long, meta string, score int").cache()


@pytest.fixture(scope="module")
def sales(spark):
    rows = [(1, "north", "a", "paid", 10), (2, "north", "b", "refunded", 20), (3, "north", "b", "paid", 5), (4, "south", "a", "paid", 40)]
    return spark.createDataFrame(rows, "id long, region string, product string, status string, amount int").cache()


@pytest.fixture(scope="module")
def words(spark):
    return spark.createDataFrame([(i, w) for i, w in enumerate(["apple", "Application", "apply", "pineapple", "50% off", "50 of"])], "id long, word string").cache()


@pytest.fixture(scope="module")
def articles(spark):
    rows = [("A", "Hà Nội mùa thu", "Phố cổ và hồ Gươm"), ("B", "Sài Gòn", "Chợ Bến Thành, phố đi bộ")]
    return spark.createDataFrame(rows, "slug string, title string, body string").cache()


def ids(df, column="id"):
    return [r[0] for r in df.select(column).collect()]


@pytest.mark.parametrize("op, number, path, want", [(">=", 0.8, "ratio", [1]), ("<", 0.5, "ratio", [2]), (">", 1000, "amount", [1, 2]), ("=", 5000, "amount", [2])])
def test_where_json_number(items, op, number, path, want):
    assert sorted(ids(W.where_json_number(items, f"meta->{path}", op, number))) == want


def test_json_or_and_bad_operator(items):
    assert sorted(ids(items.where(W.either(W.json_number_is("meta->ratio", ">", 0.8), W.json_number_is("meta->amount", "=", 5000))))) == [1, 2]
    with pytest.raises(ValueError):
        W.json_number_is("meta->ratio", "like", 1)
    with pytest.raises(ValueError):
        split_path("meta")


def test_json_order(items):
    assert ids(O.order_by_json_number(items.where("id < 3"), "meta->profile_index")) == [2, 1]
    assert ids(O.order_by_json_number(items, "meta->profile_index", "desc", True, F.col("id"))) == [1, 2, 3, 4]
    assert ids(O.order_by_json_number(items, "meta->profile_index", "asc", True, F.col("id"))) == [2, 1, 3, 4]
    assert ids(O.order_by_json_number(items, "meta->profile_index", "asc", False, F.col("id"))) == [3, 4, 2, 1]
    assert ids(O.order_by_nulls_last(items, "score", "desc", F.col("id"))) == [3, 1, 2, 4]
    assert ids(O.order_by_nulls_last(items, "score", "asc", F.col("id"))) == [1, 3, 2, 4]
    with pytest.raises(ValueError):
        O.nulls_last("score", "down")


def test_json_aggregates(items):
    p = "meta->amount"
    assert items.agg(A.sum_json(p), A.avg_json(p), A.min_json(p), A.max_json(p)).first()[:] == (204000, 102000, 5000, 199000)
    assert items.where("id < 0").agg(A.sum_json(p), A.max_json(p)).first()[:] == (0, None)


def test_json_values(items):
    got = items.select(json_text("meta->device"), json_bool("meta->sync"), json_number("meta->device")).collect()
    assert [tuple(r) for r in got] == [("ios", True, None), ("android", False, None), (None, None, None), (None, None, None)]


def test_json_odd_keys(spark):
    df = spark.createDataFrame([('{"it\'s":{"a.b":"x"}}',)], "meta string")
    assert df.select(json_text("meta->it's->a.b")).first()[0] == "x"


def test_json_increment(spark, items):
    up = items.select("id", increment_json("meta->amount", 5).alias("m"))
    assert [r[0] for r in up.orderBy("id").select(json_number("m->amount")).collect()] == [199005, 5005, 5, 5]
    assert up.where("id = 1").select(json_text("m->device")).first()[0] == "ios"
    assert items.where("id = 1").select(increment_json("meta->ratio", 0.5).alias("m")).select(json_number("m->ratio")).first()[0] == pytest.approx(1.35)
    assert items.where("id = 2").select(decrement_json("meta->amount", 1000).alias("m")).select(json_number("m->amount")).first()[0] == 4000
    df = spark.createDataFrame([("[]",), (None,), ("oops",)], "meta string")
    assert [r[0] for r in df.select(increment_json("meta->views")).collect()] == ['{"views":1}'] * 3
    nested = spark.createDataFrame([('{"a":{"n":4,"o":1},"b":2}',), ("{}",)], "meta string").select(increment_json("meta->a->n", 3).alias("m"))
    assert [tuple(r) for r in nested.select(json_number("m->a->n"), json_text("m->b"), json_text("m->a->o")).collect()] == [(7, "2", "1"), (3, None, None)]


def test_conditional_aggregates(sales):
    paid = F.col("status") == "paid"
    got = sales.agg(A.count_where("a", paid), A.sum_where("b", "amount", paid & (F.col("amount") > 5)), A.aggregate_where("MAX", "amount", F.col("region") == "north", "c")).first()
    assert got[:] == (3, 50, 20)
    by = dict(tuple(r) for r in sales.groupBy("region").agg(A.sum_where("x", "amount", F.col("status") == "refunded")).collect())
    assert by == {"north": 20, "south": None}
    with pytest.raises(ValueError):
        A.aggregate_where("median", "amount", paid, "x")
    with pytest.raises(ValueError):
        A.condition(sales, lambda df: None)


def test_rollup(sales):
    total = F.sum("amount").alias("total")
    want = {("north", "a", 10), ("north", "b", 25), ("north", None, 35), ("south", "a", 40), ("south", None, 40), (None, None, 75)}
    assert {tuple(r) for r in A.rollup(sales, ["region", "product"], total).collect()} == want
    assert {tuple(r) for r in A.union_rollup(sales, ["region", "product"], total).select("region", "product", "total").collect()} == want
    assert {tuple(r) for r in A.rollup(sales.where("status = 'paid'"), ["region"], total).collect()} == {("north", 15), ("south", 40), (None, 55)}
    assert [tuple(r) for r in A.rollup(sales.where("id < 0"), ["region"], total, F.count("*").alias("n")).collect()] == [(None, None, 0)]
    with pytest.raises(ValueError):
        A.rollup(sales, [], total)


def test_prefix_and_substring(words):
    assert set(ids(words.where(W.starts_with("word", "APP")), "word")) == {"apple", "Application", "apply"}
    assert ids(words.where(W.contains("word", "0% o")), "word") == ["50% off"]
    assert set(ids(words.where(W.contains("word", "pple")), "word")) == {"apple", "pineapple"}
    assert ids(words.where(W.like_literal("word", "%", "0% o", "%")), "word") == ["50% off"]
    assert escape_like("5%_\\") == "5\\%\\_\\\\"


def test_suggest(words):
    assert ids(O.suggest(words, "word", "ap"), "word") == ["apple", "apply", "Application"]
    long = ids(O.suggest(words, "word", "app"), "word")
    assert long[:3] == ["apple", "apply", "Application"] and "pineapple" in long
    assert ids(O.suggest(words, "word", "  "), "word") == []


def test_similarity(words):
    assert ids(O.order_by_similarity(words.where(W.similar("word", "aple")), "word", "aple"), "word")[0] == "apple"
    got = dict(tuple(r) for r in W.with_similarity(words, "word", "aple").select("word", "similarity").collect())
    assert got["apple"] == pytest.approx(4 / 7)
    assert trigrams_of("a") == ["  a", " a "]
    assert words.where(W.similar("word", "aple", 0.9)).count() == 0


def test_similarity_of_nothing(spark):
    df = spark.createDataFrame([("",), (None,), ("x",)], "w string")
    assert [r[0] for r in df.select(similarity(F.col("w"), "-")).collect()] == [0.0, None, 0.0]


def test_whole_texts_are_folded(spark, tmp_path):
    from portolan import catalogue

    text = "x" * 300 + " Phở ĐÀ"
    spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {tuple(r) for r in catalogue.QUERIES["fold_text"](spark, str(tmp_path)).collect()} == {(1, "x" * 300 + " pho da"), (2, None)}


def test_fold(spark):
    rows = [("Phố cổ và hồ Gươm",), ("ĐƯỜNG biển",), ("Đà Nẵng Łø",), ("straße",)]
    assert [r[0] for r in spark.createDataFrame(rows, "t string").select(fold(F.col("t"))).collect()] == ["pho co va ho guom", "duong bien", "da nang lo", "straße"]


@pytest.mark.parametrize("mode, text, want", [
    ("words", "pho co", "A"), ("words", "HA NOI", "A"), ("words", "phố", "AB"), ("words", "huế", ""), ("words", " - ", ""),
    ("phrase", "ho guom", "A"), ("phrase", "guom ho", ""),
    ("websearch", "pho -thanh", "A"), ("websearch", '"ben thanh" OR guom', "AB"), ("websearch", "gu*", "A"), ("websearch", "-a", ""),
    ("boolean", "+pho -co", "B"), ("boolean", "guom thanh", "AB"), ("raw", "pho NOT co", "B"),
])
def test_full_text(articles, mode, text, want):
    assert "".join(sorted(ids(where_full_text(articles, ["title", "body"], text, mode), "slug"))) == want


def test_full_text_columns_and_strokes(spark, articles):
    assert ids(where_full_text(articles, "title", "pho"), "slug") == []
    assert len(ids(where_full_text(articles, "body", "pho"), "slug")) == 2
    more = articles.union(spark.createDataFrame([("C", "Đà Nẵng", None)], articles.schema))
    assert ids(where_full_text(more, ["title", "body"], "da nang"), "slug") == ["C"]


def test_parse():
    t = lambda *w, p=False: Term(w, p)
    assert parse(" pho  co ") == Query(((t("pho"),), (t("co"),)))
    assert parse(" - + ") is None
    assert parse("a b OR c -d", "websearch") == Query(((t("a"),), (t("b"), t("c"))), (t("d"),))
    assert parse('gu* "ho ta"*', "websearch") == Query(((t("gu", p=True),), (t("ho", "ta", p=True),)))
    assert parse("+a -b c", "boolean") == Query(((t("a"),),), (t("b"),))
    assert parse("a c -b", "boolean") == Query(((t("a"), t("c")),), (t("b"),))
    with pytest.raises(ValueError):
        parse("a", "fuzzy")


def test_relevance(spark):
    df = spark.createDataFrame([(1, "apple pie with apple"), (2, "green apple"), (3, "pear"), (4, "plum"), (5, "fig")], "id long, phrase string")
    got = dict(tuple(r) for r in with_relevance(df, "phrase", "apple").select("id", "relevance").collect())
    assert got[1] >= got[2] > got[3] == 0
    assert ids(search(df, "phrase", "apple"))[0] in (1, 2) and sorted(ids(search(df, "phrase", "apple"))) == [1, 2]
    assert ids(search(df, "phrase", "-")) == []
    assert ids(fulltext.order_by_relevance(df, "phrase", "pear"))[0] == 3


def test_languages(spark):
    df = spark.createDataFrame([(1, "running horses", "abcdef")], "id long, text string, code string")
    assert ids(where_full_text(df, "text", "run horse", language="english")) == [1]
    assert ids(where_full_text(df, "code", "bcd", language="trigram")) == [1]
    assert tokens_of("Phố Cổ") == ["pho", "co"]


@pytest.mark.parametrize("word, want", [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("conditional", "condit"), ("vietnamization", "vietnam"), ("triplicate", "triplic"), ("hopefulness", "hope"), ("adjustment", "adjust"), ("adoption", "adopt"), ("probate", "probat"), ("controlling", "control"), ("sky", "sky")])
def test_stemmer(word, want):
    assert stem(word) == want


def test_every_word(spark):
    df = spark.createDataFrame([(1, "one two"), (2, "one"), (3, None)], "id long, title string")
    assert ids(fulltext.where_every_word(df, "title", "ONE tw")) == [1]
    assert ids(fulltext.where_every_word(df, "title", " - ")) == []


def test_time_window(spark):
    df = spark.createDataFrame([("2026-01-01 01:00:00", 1), ("2026-01-01 23:00:00", 2), ("2026-01-02 00:00:00", 4)], "t string, n int").withColumn("t", F.to_timestamp("t"))
    assert sorted(r["n"] for r in A.time_window(df, "t", "1 day", F.sum("n").alias("n")).collect()) == [3, 4]


def test_portable_predicates(spark):
    df = spark.createDataFrame([(1, '{"a":["x","y"],"n":null}', "2026-03-01 10:00:00")], "id long, j string, t string").withColumn("t", F.to_timestamp("t"))
    got = df.select(W.json_contains("j->a", "y"), W.json_contains("j->a", "z"), W.json_contains_key("j->b"), W.json_length("j->a"), W.date_is("t", "2026-03-01"), W.year_is("t", 2025)).first()
    assert got[:] == (True, False, False, 2, True, False)
