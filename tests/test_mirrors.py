"""Versioned tables, mirrors, history, streams."""

import itertools
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from portolan.operators import history as H
from portolan.operators import mirror as M
from portolan.session import Policy, UnsupportedFeature
from portolan.sources.store import Conflict, HistoricalReads, SnapshotStore, instant
from portolan.streaming.apply import apply_changes, apply_versions, progress

ORDER = "id long, status string, total double, updated_at timestamp"


def at(text):
    return datetime.fromisoformat(text)


@pytest.fixture
def store(spark, tmp_path):
    return SnapshotStore(spark, str(tmp_path / "store"))


def test_snapshots(spark, store):
    with pytest.raises(LookupError):
        store.read("t")
    one = store.commit("t", spark.createDataFrame([(1, 10)], "id long, total int"), "create")
    stale = HistoricalReads(store, "t").read_stale()
    store.commit("t", spark.createDataFrame([(1, 20), (2, 5)], "id long, total int"), "more", parent=one.id)
    assert store.read("t").count() == 2 and store.read("t", as_of=one.committed_at).first()["total"] == 10
    assert stale.get().count() == 1 and stale.read_current().get().count() == 2
    with pytest.raises(Conflict):
        store.commit("t", store.read("t"), "late", parent=one.id)
    with pytest.raises(LookupError):
        store.read("t", as_of="2000-01-01")
    assert store.commit("t", store.read("t"), "b", batch=("x", 4)).id == store.commit("t", store.read("t"), "b", batch=("x", 3)).id
    store.flush("t", history=True)
    assert store.read("t").count() == 0 and len(store.snapshots("t")) == 1
    again = SnapshotStore(spark, store.root)
    assert again.append("t", spark.createDataFrame([(3, 1)], "id long, total int"), "more").parent == store.at("t").id - 1
    assert again.read("t").count() == 1 and store.read("t").count() == 1


def test_commit_times_differ_with_a_still_clock(spark, store, monkeypatch):
    import portolan.sources.store as module

    class Still(datetime):
        @classmethod
        def now(cls, tz=None):
            return datetime(2026, 1, 1, 0, 0, 0, 999_998, tz)

    monkeypatch.setattr(module, "datetime", Still)
    made = [store.commit("t", spark.range(n), "n") for n in range(4)]
    assert len({s.committed_at for s in made}) == 4 and made[-1].committed_at == "2026-01-01T00:00:01.000001"
    assert [store.read("t", as_of=s.committed_at).count() for s in made] == [0, 1, 2, 3]


def test_changes_by_key_write_their_buckets_only(spark, store):
    store.commit("t", spark.range(200).select("id", F.lit("old").alias("v")), "create", key="id", buckets=16)
    before = store.at("t")
    keys = spark.createDataFrame([(5,), (6,)], "id long")
    s = store.change("t", keys, lambda now: now.withColumn("v", F.when(F.col("id").isin(5, 6), "new").otherwise(F.col("v"))), "change")
    assert len(before.parts) == 16 and len({*s.parts} - {*before.parts}) <= 2
    assert store.read("t").where("v = 'new'").count() == 2 and store.read("t").count() == 200 and store.read("t", id=before.id).where("v = 'new'").count() == 0
    assert store.change("t", keys.limit(0), lambda now: now, "nothing").id == s.id
    with pytest.raises(ValueError):
        store.append("t", store.read("t"), "more")
    store.commit("u", spark.range(3), "create")
    with pytest.raises(ValueError):
        store.change("u", keys, lambda now: now, "change")


def test_a_conflicting_change_is_made_again(spark, store, monkeypatch):
    store.commit("t", spark.range(4).select("id", F.lit(0).alias("v")), "create", key="id", buckets=2)
    keys = spark.range(4)
    other, plain = SnapshotStore(spark, store.root), store._written

    def slow(*given):
        monkeypatch.setattr(store, "_written", plain)
        other.change("t", keys, lambda now: now.withColumn("v", F.col("v") + 10), "other")
        return plain(*given)

    monkeypatch.setattr(store, "_written", slow)
    store.change("t", keys, lambda now: now.withColumn("v", F.col("v") + 1), "mine")
    assert {r.v for r in store.read("t").collect()} == {11}


def test_owner_changes_reach_the_mirror(spark, store):
    rows = lambda *r: spark.createDataFrame(r, "id long, v string, deleted_at timestamp")
    owner = M.Owner(store, "o", "id", "deleted_at")
    mirror = M.Mirror(M.MirrorSpec("o", "m", "id", None, None, transform=lambda df: df.select("id", "v")), store, lambda: store.read("o").where("deleted_at is null"))
    owner.write(rows((1, "a", None), (2, "b", None)))
    mirror.create()
    assert owner.mirror(mirror) == 1 and owner.pending(mirror).count() == 0
    owner.write(rows((1, "a2", None), (3, "c", None)))
    owner.write(rows((1, "a2", None), (3, "c", at("2026-01-01")), (4, "d", None)))
    assert sorted(map(tuple, owner.pending(mirror).collect())) == [(1, "sync", 2), (2, "remove", 2), (3, "remove", 3), (3, "sync", 2), (4, "sync", 3)]
    store.commit("o", rows((4, "d", None)), "behind the log's back")
    assert owner.capture() == 1 and owner.capture() == 0
    assert owner.mirror(mirror) == 4 and sorted(map(tuple, mirror.read().collect())) == [(4, "d")]
    done = store.at("m").id
    assert owner.mirror(mirror) == 4 and store.at("m").id == done


def test_the_last_action_of_a_key_counts(spark):
    from portolan.streaming.apply import last_actions

    rows = [(1, "remove", 1), (1, "sync", 2), (2, "sync", 1), (2, "remove", 2), (3, "erase", 1), (3, "sync", 5), (4, "sync", None), (5, "remove", 3), (5, "sync", 3)]
    changes = spark.createDataFrame(rows, "key long, action string, seq long")
    assert dict(map(tuple, last_actions(changes).collect())) == {1: "sync", 2: "remove", 3: "erase", 4: "sync", 5: "sync"}
    assert dict(map(tuple, last_actions(changes.drop("seq")).collect()))[2] == "sync"


def test_instants():
    assert instant("2026-01-01T07:00:00+07:00") == "2026-01-01T00:00:00.000000"
    assert instant("-5m") < instant(datetime.now().astimezone())
    with pytest.raises(ValueError):
        instant("yesterday-ish")


def test_guarded_merge(spark):
    now = spark.createDataFrame([(1, "packed", 3.0, at("2026-01-01"))], ORDER)
    old = spark.createDataFrame([(1, "old", at("2000-01-01"))], "id long, status string, updated_at timestamp")
    new = spark.createDataFrame([(1, "newer", at("2037-01-01")), (2, None, None)], "id long, status string, updated_at timestamp")
    assert M.merge(now, old, "id", "updated_at").first()["status"] == "packed"
    once = M.merge(now, new, "id", "updated_at")
    twice = M.merge(once, new, "id", "updated_at")
    for df in (once, twice):
        assert sorted((r.id, r.status, r.total) for r in df.collect()) == [(1, "newer", 3.0), (2, None, None)]
    keys = spark.createDataFrame([(1,), (9,)], "id long")
    assert sorted((r.id, r.status) for r in M.merge(now, keys, "id", "updated_at").collect()) == [(1, "packed"), (9, None)]
    with pytest.raises(Exception, match="null"):
        M.merge(now, spark.createDataFrame([(None, "x")], "id long, status string"), "id").collect()
    with pytest.raises(ValueError):
        M.merge(now, spark.createDataFrame([("x",)], "status string"), "id")


def test_merge_is_the_same_in_any_order(spark):
    now = spark.createDataFrame([(1, "a", 0.0, at("2026-01-01"))], ORDER)
    steps = [("b", "2026-01-02"), ("c", "2026-01-03"), ("d", "2026-01-04")]
    ends = set()
    for order in itertools.permutations(steps):
        df = now
        for status, day in order:
            df = M.merge(df, spark.createDataFrame([(1, status, 0.0, at(day))], ORDER), "id", "updated_at")
        ends.add(df.first()["status"])
    assert ends == {"d"}


def test_mirror(spark, store):
    owner = {"df": spark.createDataFrame([(1, "new", 1.0, at("2026-01-01")), (2, "void", 2.0, at("2026-01-01"))], ORDER)}
    registry = M.Registry()
    spec = registry.register(M.MirrorSpec("orders", "m_orders", "order_id", "id", "updated_at", F.col("status") != "void"))
    mirror = M.Mirror(spec, store, lambda: owner["df"], registry)
    mirror.create()
    told = []
    assert mirror.backfill(progress=lambda *x: told.append(x)) == (1, 0) and told == [(1, 0)]
    owner["df"] = spark.createDataFrame([(1, "void", 1.0, at("2026-01-02")), (2, "new", 2.0, at("2026-01-02")), (3, "new", 3.0, None)], ORDER)
    with registry.without_mirroring("orders"):
        mirror.sync(spark.createDataFrame([(1,)], "id long"))
    assert [r.order_id for r in mirror.read().collect()] == [1]
    mirror.sync(spark.createDataFrame([(1,), (2,), (7,)], "id long"))
    assert [r.order_id for r in mirror.read().collect()] == [2]
    mirror.backfill(since="2026-01-02")
    mirror.upsert_rows(mirror.read().limit(0))
    assert sorted(r.order_id for r in mirror.read().collect()) == [2]
    mirror.backfill()
    assert sorted(r.order_id for r in mirror.read().collect()) == [2, 3]
    owner["df"] = owner["df"].where("id = 3")
    mirror.prune()
    mirror.sync(spark.createDataFrame([(3,)], "id long"), "remove")
    assert mirror.read().count() == 0
    with pytest.raises(M.MirrorIsReadOnly):
        mirror.insert({})
    assert registry.owner_of("m_orders") == "orders"
    with pytest.raises(ValueError):
        registry.register(spec)
    with pytest.raises(ValueError):
        M.MirrorSpec("a", "a")
    with pytest.raises(ValueError):
        M.MirrorSpec("a", "b", versions="some")
    registry.switch("m_orders", False)
    assert not registry.active(spec)


LOG = "key long, at timestamp, seq long, erase boolean, row struct<total: double, paid: boolean>"


def events(spark, *rows):
    return spark.createDataFrame([(1, at(t), i, False, r) for i, (t, r) in enumerate(rows)], LOG)


def test_history(spark):
    base = events(spark, ("2026-01-01 10:00", (10.5, False)), ("2026-01-02 10:00", (10.5, True)), ("2026-01-03 10:00", (12.0, True)))
    h = H.intervals(base)
    assert H.as_of_valid_time(h, "2026-01-02 12:00:00").first()["row"]["paid"] is True
    late = spark.createDataFrame([(1, at("2026-01-02 18:00"), 9, False, (11.0, True))], LOG)
    log = H.append_events(base, late)
    h = H.intervals(log)
    assert [r["row"]["total"] for r in H.for_all_valid_time(h).collect()] == [10.5, 10.5, 11.0, 12.0]
    assert H.current(h).first()["row"]["total"] == 12.0
    log = H.append_events(log, spark.createDataFrame([(1, at("2026-01-05"), 10, False, None)], LOG))
    h = H.intervals(log)
    assert H.current(h).count() == 0 and H.as_of_valid_time(h, "2026-01-04 10:00:00").first()["row"]["total"] == 12.0
    assert H.valid_between(h, "2026-01-02", "2026-01-03").count() == 3
    log = H.append_events(log, spark.createDataFrame([(1, at("2026-01-06"), 11, True, None)], LOG))
    assert H.intervals(log).count() == 0


def test_latest_state_skips_older_events(spark):
    log = events(spark, ("2026-01-02", (1.0, True)))
    new = spark.createDataFrame([(1, at("2026-01-01"), 5, False, None), (2, at("2026-01-01"), 6, False, None), (1, at("2026-01-02"), 7, False, None)], LOG)
    assert sorted(r.seq for r in H.not_older(log, new).collect()) == [6, 7]


def test_history_is_the_same_in_any_order(spark):
    rows = [(1, at("2026-01-01"), 1, False, (1.0, True)), (1, at("2026-01-02"), 2, False, None), (1, at("2026-01-02"), 3, False, (2.0, True)), (1, at("2026-01-03"), 4, False, (3.0, False))]
    found = set()
    for order in itertools.permutations(rows):
        log = spark.createDataFrame([], LOG)
        for row in order[:2], order[2:]:
            log = H.append_events(log, spark.createDataFrame(row, LOG))
        found.add(str(H.for_all_valid_time(H.intervals(log)).collect()))
        if len(found) > 1:
            break
    assert len(found) == 1


def test_streams(spark, store, tmp_path):
    owner = spark.range(20).select("id", (F.col("id") * 2).alias("v"))
    mirror = M.Mirror(M.MirrorSpec("o", "m", "id", None, None), store, lambda: owner)
    mirror.create()
    for keys, action in (("id < 10", "sync"), ("id < 10", "sync"), ("id between 5 and 6", "remove")):
        M.change_rows(owner.where(keys), "id", action).write.mode("append").parquet(str(tmp_path / "changes"))
        q = apply_changes(spark.readStream.schema("key long, action string, seq long").parquet(str(tmp_path / "changes")), mirror, str(tmp_path / "ck"))
        q.awaitTermination()
    assert sorted(r.id for r in mirror.read().collect()) == [0, 1, 2, 3, 4, 7, 8, 9]
    assert "rows" in progress(q)
    events(spark, ("2026-01-01", (1.0, True))).write.parquet(str(tmp_path / "events"))
    for _ in range(2):  # the second run has nothing to do
        apply_versions(spark.readStream.schema(LOG).parquet(str(tmp_path / "events")), store, "log", str(tmp_path / "ck2")).awaitTermination()
    assert store.read("log").count() == 1
    events(spark, ("2026-01-02", (2.0, True))).write.mode("append").parquet(str(tmp_path / "events"))
    first = store.at("log").parts
    apply_versions(spark.readStream.schema(LOG).parquet(str(tmp_path / "events")), store, "log", str(tmp_path / "ck2")).awaitTermination()
    assert store.read("log").count() == 2 and store.at("log").parts[: len(first)] == first  # added, not rewritten
    spark.createDataFrame([(1, at("2026-01-03"), 9, True, None)], LOG).write.mode("append").parquet(str(tmp_path / "events"))
    apply_versions(spark.readStream.schema(LOG).parquet(str(tmp_path / "events")), store, "log", str(tmp_path / "ck2")).awaitTermination()
    assert store.read("log").count() == 0 and not {*first} & {*store.at("log").parts}
    with pytest.raises(ValueError):
        M.change_rows(owner, "id", "explode")


def test_policy():
    with pytest.raises(UnsupportedFeature):
        Policy(strict=True).unsupported("no")
    p = Policy()
    with pytest.warns(UserWarning) as told:
        p.unsupported("once")
        p.unsupported("once")
    assert len(told) == 1


def test_a_table_without_snapshots_has_no_past(spark, monkeypatch):
    from portolan import session
    from portolan.sources.store import as_of_time

    monkeypatch.setattr(session, "policy", Policy())
    with pytest.warns(UserWarning):
        assert as_of_time(spark.range(3), "-5m").count() == 3
    monkeypatch.setattr(session, "policy", Policy(strict=True))
    with pytest.raises(UnsupportedFeature):
        as_of_time(spark.range(3), "-5m")
