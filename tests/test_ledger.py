import datetime as dt
import threading

from pyspark.sql import functions as F

from procgraph.incremental import ledger
from procgraph.incremental.ledger import WorkLedger

T = dt.datetime
LISTING = "file_path string, file_size long, modified_time double, listed_at timestamp, item string"
RECORDS = "file_path string, file_size long, modified_time double, processed_time timestamp, success boolean, state string"


def at(n):
    return T(2026, 1, 1, 0, 0, n)


def plan(spark, listing, records):
    a = spark.createDataFrame([(*r, "x") for r in listing], LISTING)
    b = spark.createDataFrame([(*r, "x") for r in records], RECORDS)
    return ledger.plan_work(a, b)


def test_changed_files(spark):
    listing = [
        ("/in/a.txt", 1, 10.0, at(1)), ("C:\\in\\a.txt", 2, 10.0, at(2)), ("b.txt", 1, 10.0, at(1)), ("c.txt", 1, 12.0, at(1)),
        ("d.txt", 1, 11.999, at(1)), ("e.txt", 1, None, at(1)), ("f.txt", 1, 1.0, at(1)), (None, 1, 1.0, at(1)), ("g.txt", None, 5.0, at(1)),
        ("/in//h.txt", 1, 8.0, at(1)), ("/in//h.txt", 1, 8.0, at(1)),
    ]
    records = [
        ("x/a.txt", 2, 10.0, at(5), True), ("x/a.txt", 9, 10.0, at(9), False), ("b.txt", 1, 10.0, at(1), True), ("b.txt", 2, 10.0, at(2), True),
        ("c.txt", 1, 10.0, at(1), True), ("d.txt", 1, 10.0, at(1), True), ("e.txt", 1, 3.0, at(1), True), ("f.txt", 1, 1.0, at(1), None),
        ("g.txt", None, 5.0, at(1), True), (None, 1, 1.0, at(1), True), ("z.txt", 1, 1.0, at(1), True), ("h.txt", 1, 9.0, at(1), True),
    ]
    out = {r.item: r.state for r in plan(spark, listing, records).collect()}
    assert out == {"a.txt": "done", "b.txt": "pending", "c.txt": "pending", "d.txt": "done", "e.txt": "pending", "f.txt": "pending", "g.txt": "done", "h.txt": "done"}
    assert plan(spark, [], records).count() == 0
    assert {r.state for r in plan(spark, listing, []).collect()} == {"pending"}


def test_failures_neither_skip_nor_repeat(spark, tmp_path):
    store = WorkLedger(spark, str(tmp_path / "ledger"))
    work = plan(spark, [("a", 1, 1.0, at(1)), ("b", 1, 1.0, at(1)), ("c", 1, 1.0, at(1))], [])
    now = lambda n: F.lit(at(n))
    store.update(lambda s: ledger.enqueue(s, work))
    store.update(lambda s: ledger.lease(s, "one", now(0), 10))
    first = {r.item: r for r in store.read().collect()}
    assert {r.state for r in first.values()} == {"leased"} and {r.token for r in first.values()} == {1}

    def finish(items, token):
        done = spark.createDataFrame([(i, token) for i in items], "item string, token long")
        return store.update(lambda s: ledger.complete(s, done))

    finish(["a", "a"], 1)
    store.update(lambda s: ledger.expire(s, now(10)))  # the first driver died
    store.update(lambda s: ledger.lease(s, "two", now(11), 10))
    finish(["b"], 1)  # stale token of the first driver
    state = {r.item: (r.state, r.token) for r in store.read().collect()}
    assert state == {"a": ("done", 1), "b": ("leased", 2), "c": ("leased", 2)}
    finish(["b", "c", "nope"], 2)
    store.update(lambda s: ledger.enqueue(s, work))  # the same plan again adds nothing
    assert {r.state for r in store.read().collect()} == {"done"}
    # The same version is written to the same place, another version elsewhere.
    changed = plan(spark, [("a", 2, 1.0, at(2)), ("b", 1, 1.0, at(1)), ("c", 1, 1.0, at(1))], [])
    store.update(lambda s: ledger.enqueue(s, changed))
    after = {r.item: r for r in store.read().collect()}
    assert after["a"].state == "pending" and after["a"].token == 2 and after["b"].state == "done"
    assert after["a"].output != first["a"].output and after["b"].output == first["b"].output
    assert store.head() == 9 and len(after) == 3


def test_version_that_changes_under_a_lease_is_done_again(spark):
    old = plan(spark, [("a", 1, 1.0, at(1))], [])
    leased = ledger.lease(old, "one", F.lit(at(0)), 10)
    new = ledger.enqueue(leased, plan(spark, [("a", 2, 1.0, at(2))], []))
    done = ledger.complete(new, spark.createDataFrame([("a", 1)], "item string, token long"))
    assert [(r.state, r.token) for r in done.collect()] == [("pending", 2)]


def test_lost_race_starts_again(spark, tmp_path):
    path = str(tmp_path / "ledger")
    one, two = WorkLedger(spark, path), WorkLedger(spark, path)
    work = plan(spark, [("a", 1, 1.0, at(1))], [])
    ran = []

    def slow(state):
        if not ran:
            two.update(lambda s: ledger.enqueue(s, work))  # another driver commits first
        ran.append(state.count())
        return ledger.enqueue(state, plan(spark, [("b", 1, 1.0, at(1))], []))

    one.update(slow)
    assert len(ran) == 2 and {r.item for r in one.read().collect()} == {"a", "b"}


def test_abandoned_marker_is_removed(spark, tmp_path):
    store = WorkLedger(spark, str(tmp_path / "ledger"), abandoned_s=0.0)
    work = plan(spark, [("a", 1, 1.0, at(1))], [])
    store.update(lambda s: ledger.enqueue(s, work))
    (tmp_path / "ledger" / "_commits" / "000000000002").touch()
    assert store.head() == 1
    store.update(lambda s: s)
    assert store.head() == 2


def test_stalled_writer_is_told_that_it_lost(spark, tmp_path):
    """A writes its manifest, stalls, B commits the same number; A must not win."""
    path = str(tmp_path / "ledger")
    work = plan(spark, [("a", 1, 1.0, at(1)), ("b", 1, 1.0, at(1))], [])
    WorkLedger(spark, path).update(lambda s: ledger.enqueue(s, work))
    other = WorkLedger(spark, path, abandoned_s=0.0)
    stalls = []

    def stalling(spark, written, target):
        if not stalls:
            stalls.append(target)
            other.update(lambda s: ledger.lease(s, "B", F.lit(at(0)), 10))
        return ledger.publish(spark, written, target)

    mine = WorkLedger(spark, path, publisher=stalling)
    mine.update(lambda s: ledger.lease(s, "A", F.lit(at(0)), 10))
    assert {(r.item, r.owner, r.token) for r in other.read().collect()} == {("a", "B", 1), ("b", "B", 1)}
    assert other.head() == 3 and len(list((tmp_path / "ledger" / "_commits").glob("written-*"))) == 0


def test_two_drivers_race(spark, tmp_path):
    path = str(tmp_path / "ledger")
    work = plan(spark, [(f"f{k}", 1, 1.0, at(1)) for k in range(40)], [])
    WorkLedger(spark, path).update(lambda s: ledger.enqueue(s, work))
    got = {}

    def run(name):
        state = WorkLedger(spark, path).update(lambda s: ledger.lease(s, name, F.lit(at(0)), 10))
        got[name] = {r.item for r in state.where(F.col("owner") == name).collect()}

    threads = [threading.Thread(target=run, args=(n,)) for n in ("one", "two", "three")]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(map(len, got.values())) == [0, 0, 40] and WorkLedger(spark, path).head() == 4


def test_crash_between_write_and_commit(spark, tmp_path):
    def dies(spark, written, target):
        raise KeyboardInterrupt

    path = str(tmp_path / "ledger")
    work = plan(spark, [("a", 1, 1.0, at(1))], [])
    try:
        WorkLedger(spark, path, publisher=dies).update(lambda s: ledger.enqueue(s, work))
    except KeyboardInterrupt:
        pass
    store = WorkLedger(spark, path)
    assert store.head() == 0 and store.read().count() == 0
    store.update(lambda s: ledger.enqueue(s, work))
    assert [r.state for r in store.read().collect()] == ["pending"]


def test_only_touched_buckets_are_written_and_old_data_goes(spark, tmp_path):
    store = WorkLedger(spark, str(tmp_path / "ledger"), buckets=8, keep=2)
    work = plan(spark, [(f"f{k}", 1, 1.0, at(1)) for k in range(60)], [])
    store.update(lambda s: ledger.lease(ledger.enqueue(s, work), "one", F.lit(at(0)), 10))
    before = store._manifest(1)["data"]
    done = spark.createDataFrame([("f7", 1)], "item string, token long")
    store.update(lambda s: ledger.complete(s, done), items=done)
    after = store._manifest(2)["data"]
    assert sum(before[b] != after[b] for b in before) == 1 and store.read().count() == 60
    assert [r.item for r in store.read().where("state = 'done'").collect()] == ["f7"]
    for _ in range(3):
        store.update(lambda s: s)
    assert len(list((tmp_path / "ledger").glob("data-*"))) == 2 and store.read().count() == 60


def test_claims_of_a_failed_build_come_again_once(spark, tmp_path):
    listing = spark.createDataFrame([("x/a", 1, 1.0, at(1), "x"), ("x/b", 1, 1.0, at(1), "x"), ("x/c", 1, 9.0, at(1), "x")], LISTING)
    records = spark.createDataFrame([("y/b", 1, 2.0, at(1), True, "x"), ("y/c", 1, 1.0, at(1), True, "x"), ("y/old", 1, 1.0, at(1), True, "x")], RECORDS)
    store = WorkLedger(spark, str(tmp_path / "ledger"))
    store.update(lambda s: ledger.enqueue(s, ledger.history(records)))
    names = lambda df: sorted((r.item, r.token) for r in df.collect())
    first = ledger.claim(store, listing, "one", F.lit(at(0)), 10)
    assert names(first) == [("a", 1), ("c", 2)]
    assert names(ledger.claim(store, listing, "two", F.lit(at(5)), 10)) == []  # still leased
    again = ledger.claim(store, listing, "two", F.lit(at(20)), 10)
    assert names(again) == [("a", 2), ("c", 3)]
    store.update(lambda s: ledger.complete(s, first))  # too late
    store.update(lambda s: ledger.complete(s, again))
    assert names(ledger.claim(store, listing, "three", F.lit(at(50)), 10)) == []
