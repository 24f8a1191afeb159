"""The work-item ledger and orphan references."""

from datetime import datetime, timedelta

import pytest

from specloom.operators import orphans, worklist

T0 = datetime(2024, 1, 1)
at = lambda h: T0 + timedelta(hours=h)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols or df.columns) for r in df.collect())


def _fold(spark, nodes, ledger, manifests, removals=()):
    n = spark.createDataFrame(nodes, "id string, source_hash string, indexed_at timestamp_ntz, rec_id string, event string")
    led = spark.createDataFrame(ledger, "ledger_id bigint, run_id bigint, rec_table string, rec_id string, seen_hash string, processed_at timestamp_ntz")
    m = spark.createDataFrame(manifests, "run_id bigint, status string, reported_at timestamp_ntz")
    r = spark.createDataFrame(list(removals), "node_id string, removed_at timestamp_ntz")
    e = worklist.current_versions(n, "t", "id", "source_hash", "indexed_at").unionByName(worklist.done_versions(led, m)).unionByName(worklist.removed_records(r, "t", "node_id", "removed_at"))
    return {r["rec_id"]: r["state"] for r in worklist.fold(e).filter("rec_table = 't'").collect()}


def test_fold_of_states(spark):
    x = ("x", "y")  # extra columns with names that clash
    nodes = [
        ("same", "AB12", at(1), *x), ("same", "AB12", at(1), *x), ("new", "aa", at(1), *x), ("changed", "old", at(0), *x), ("changed", "new", at(2), *x), ("late", "v2", at(5), *x), ("late", "v1", at(1), *x),
        ("null", None, at(1), *x), ("blank", "  ", at(1), *x), ("failed", "ff", at(1), *x), ("revised", "rr", at(1), *x), ("gone", "gg", at(1), *x), ("back", "bb", at(9), *x), (None, "zz", at(1), *x), ("tie", "t2", at(1), *x),
    ]
    ledger = [
        (1, 1, "t", "same", " sha256:ab12 ", at(3)), (2, 1, "t", "changed", "old", at(3)), (3, 1, "t", "late", "V2", at(3)), (4, 1, "t", "null", None, at(3)), (5, 1, "t", "blank", "", at(3)), (6, 2, "t", "failed", "ff", at(3)),
        (7, 3, "t", "revised", "rr", at(3)), (8, 1, "t", "nobody", "q", at(3)), (9, 1, "t", "tie", "t1", at(3)), (10, 1, "t", "tie", "t2", at(3)), (11, 1, "u", "new", "aa", at(3)),
    ]
    manifests = [(1, "running", at(2)), (1, "success", at(4)), (2, "success", at(4)), (2, "failed", at(5)), (3, "failed", at(4)), (3, "success", at(5))]
    got = _fold(spark, nodes, ledger, manifests, [("gone", at(2)), ("back", at(2)), ("ghost", at(2))])
    assert got.pop("nobody") == "unknown" and got.pop("ghost") == "unknown"
    assert got == {"same": "done", "new": "pending", "changed": "pending", "late": "done", "null": "pending", "blank": "pending", "failed": "pending", "revised": "done", "gone": "removed", "back": "pending", "tie": "done"}


def test_fold_of_nothing(spark):
    assert _fold(spark, [], [], []) == {}


def test_digest_forms(spark):
    from pyspark.sql import functions as F

    forms = ["abc1", " ABC1\t", "sha256:abc1", "SHA256: ABC1 ", "md5=abc1", " abc1", None, "", "  "]
    got = [r[0] for r in spark.createDataFrame([(f,) for f in forms], "h string").select(worklist.digest(F.col("h"))).collect()]
    assert got == ["abc1"] * 6 + [None] * 3


def test_ledger_survives_failures(spark, tmp_path):
    led = worklist.WorkLedger(spark, str(tmp_path / "ledger"))
    items = spark.createDataFrame([("t", "a", "1"), ("t", "b", "1"), ("t", "c", None), ("t", "a", "1")], "rec_table string, rec_id string, digest string")
    led.enqueue(items, "b1", at(0))
    led.enqueue(items, "b2", at(0))  # known already
    states = lambda now: rows(led.state(now), "rec_id", "state")
    assert states(at(0)) == [("a", "pending"), ("b", "pending"), ("c", "pending")]
    first = led.lease("w1", at(2), at(1), limit=2)
    assert states(at(1)) == [("a", "leased"), ("b", "leased"), ("c", "pending")]
    assert states(at(3)) == [("a", "pending"), ("b", "pending"), ("c", "pending")]  # the lease ran out
    second = led.lease("w2", at(9), at(3))
    assert second > first
    assert led.complete(first, at(4)) == 0  # a stale writer
    assert {s for _, s in states(at(4))} == {"leased"}
    assert led.complete(second, at(5)) == 3
    assert led.complete(second, at(5)) == 3  # a retry changes nothing
    assert {s for _, s in states(at(20))} == {"done"}
    led.enqueue(spark.createDataFrame([("t", "a", "2")], items.schema), "b3", at(6))
    third = led.lease("w3", at(9), at(7))
    assert rows(led.leased(third), "rec_id", "digest") == [("a", "2")]
    led.fail(third, at(8))
    assert rows(led.state(at(8)).filter("state = 'pending'"), "rec_id", "digest") == [("a", "2")]


def _handle(led, hour):
    return led.complete(led.lease("w", at(hour + 1), at(hour)), at(hour))


def test_ledger_reopens_what_differs_from_the_last(spark, tmp_path):
    led = worklist.WorkLedger(spark, str(tmp_path / "ledger"))
    put = lambda batch, hour, *items: led.enqueue(spark.createDataFrame([("t", *i) for i in items], "rec_table string, rec_id string, digest string"), batch, at(hour))
    states = lambda: rows(led.state(at(99)), "rec_id", "digest", "state")
    put("b1", 0, ("a", "A"), ("n", None), ("r", "A"))
    assert _handle(led, 1) == 3
    put("b1", 2, ("a", "A"), ("n", None), ("r", "A"))  # the batch repeated: nothing to do
    assert {s for *_, s in states()} == {"done"}
    put("b2", 3, ("a", "B"), ("n", None), ("r", "B"))
    assert states() == [("a", "B", "pending"), ("n", None, "pending"), ("r", "B", "pending")]
    put("b3", 3, ("r", "A"))  # back before B was taken: A is what was handled last
    assert states()[2] == ("r", "A", "done")
    assert _handle(led, 4) == 2
    put("b1", 5, ("a", "A"), ("n", None), ("r", "A"))
    assert {s for *_, s in states()} == {"done"}
    put("b4", 6, ("a", "A"), ("n", None), ("r", "A"))  # A -> B -> A
    assert states() == [("a", "A", "pending"), ("n", None, "pending"), ("r", "A", "done")]
    stale = led.lease("w", at(7), at(6))
    newer = led.lease("w", at(9), at(8))
    assert led.complete(stale, at(8)) == 0 and led.complete(newer, at(8)) == 2
    assert {s for *_, s in states()} == {"done"}


def test_given_tables_pass_through_the_ledger(spark, tmp_path):
    led = worklist.WorkLedger(spark, str(tmp_path / "ledger"))
    ledger = spark.createDataFrame([(1, 1, "t", "a", "A", at(1)), (2, 2, "t", "a", "A", at(2)), (3, 2, "t", "b", "B", at(2)), (4, 3, "t", "c", "C", at(2)), (5, 2, "t", "only", "x", at(2))], "ledger_id bigint, run_id bigint, rec_table string, rec_id string, seen_hash string, processed_at timestamp_ntz")
    manifests = spark.createDataFrame([(1, "success", at(3)), (2, "failed", at(3)), (3, "running", at(3))], "run_id bigint, status string, reported_at timestamp_ntz")
    nodes = spark.createDataFrame([(i, i.upper(), at(0)) for i in "abcd"], "id string, h string, at timestamp_ntz")
    handled = worklist.done_versions(ledger, manifests)
    assert rows(handled, "rec_id", "event") == [("a", "done"), ("a", "lease"), ("b", "lease"), ("c", "lease"), ("only", "lease")]
    events = worklist.current_versions(nodes, "t", "id", "h", "at").unionByName(handled)
    states = lambda e, now=None: rows(worklist.fold(e, now), "rec_id", "state")
    want = [("a", "done"), ("b", "pending"), ("c", "pending"), ("d", "pending")]
    assert states(events) == states(events, at(9)) == want
    led._write(events, "new", "given")  # the same events from the ledger's own files
    assert rows(led.state(at(9)), "rec_id", "state") == want
    assert led.lease("w", at(12), at(10)) == 2
    over = worklist.WorkLedger(spark, str(tmp_path / "over"), events)  # a ledger that goes on from them
    mine = over.lease("w", at(12), at(10))
    assert rows(over.leased(mine), "rec_id") == [("b",), ("c",), ("d",)] and over.complete(mine, at(11)) == 3
    assert {s for _, s in rows(over.state(at(99)), "rec_id", "state")} == {"done"}
    assert rows(led.state(at(11)), "rec_id", "state") == [("a", "done"), *((i, "leased") for i in "bcd")]


def _items(spark, *items):
    return spark.createDataFrame([("t", *i) for i in items], "rec_table string, rec_id string, digest string")


def test_two_runs_never_hold_one_token(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    led = worklist.WorkLedger(spark, str(tmp_path / "ledger"))
    led.enqueue(_items(spark, ("a", "1"), ("b", "1")), "b1", at(0))
    with ThreadPoolExecutor(6) as pool:
        assert len(set(pool.map(lambda _: led._draw(), range(60)))) == 60
        tokens = list(pool.map(lambda n: led.lease(f"w{n}", at(5), at(1)), range(3)))
    assert len(set(tokens)) == 3
    accepted = [led.complete(t, at(2)) for t in sorted(tokens)]
    assert sum(accepted) == 2  # every record is accepted from one run only, the newest that leased it
    assert {s for *_, s in rows(led.state(at(3)), "rec_id", "state")} == {"done"}


def test_crash_between_write_and_complete(spark, tmp_path):
    led = worklist.WorkLedger(spark, str(tmp_path / "ledger"))
    led.enqueue(_items(spark, ("a", "1"), ("b", None)), "b1", at(0))
    assert led.published("x") is None
    first = led.lease("w1", at(2), at(1))
    led.publish(first, led.leased(first).selectExpr("*", "'broken' as made"), "x")  # and the run dies here
    assert rows(led.published("x")) == []
    second = led.lease("w2", at(9), at(3))
    for _ in range(2):  # a retry replaces its own files
        led.publish(second, led.leased(second).selectExpr("*", "'whole' as made"), "x")
    assert led.complete(second, at(4)) == 2
    with pytest.raises(worklist.StaleToken):
        led.publish(first, led.leased(first).selectExpr("*", "'stale' as made"), "x")
    assert led.complete(first, at(5)) == 0
    assert rows(led.published("x"), "rec_id", "made") == [("a", "whole"), ("b", "whole")]


def test_compaction_changes_nothing(spark, tmp_path):
    led = worklist.WorkLedger(spark, str(tmp_path / "ledger"))
    look = lambda: rows(led.state(at(50)), "rec_id", "digest", "state", "token")
    led.compact()
    assert look() == []
    led.enqueue(_items(spark, ("a", "A"), ("n", None), ("r", "A")), "b1", at(0))
    _handle(led, 1)
    led.enqueue(_items(spark, ("a", "B"), ("n", None)), "b2", at(2))
    led.fail(led.lease("w", at(9), at(3), limit=1), at(4))
    before = look()
    led.compact()
    assert look() == before and [f.split("/")[0] for f in led._folders()] == ["snapshot"]
    led.enqueue(_items(spark, ("a", "A"), ("n", None), ("r", "A")), "b1", at(5))  # an old batch again
    assert look() == before
    assert _handle(led, 6) == 2
    led._create("snapshot", 99, "half")  # a snapshot that broke off
    after = look()
    led.compact()
    assert look() == after and {s for *_, s, _ in after} == {"done"}


def _broken(spark, edges, nodes, removals=()):
    e = spark.createDataFrame(edges, "edge_id bigint, from_node string, to_node string, edge_type string, extracted_at timestamp_ntz, key string, period int")
    n = spark.createDataFrame(nodes, "id string, indexed_at timestamp_ntz")
    r = spark.createDataFrame(list(removals), "node_id string, removed_at timestamp_ntz")
    return e, [n], r


def test_orphans(spark):
    x = ("k", 1)
    edges = [
        (1, "a", "b", "T", at(10), *x), (1, "a", "b", "T", at(10), *x), (2, "a", "nowhere", None, at(10), *x), (3, "a", None, "T", at(10), *x), (4, " ", " ", "T", at(10), *x), (5, "late", "a", "T", at(10), *x),
        (6, "late", "gone", "T", at(2000), *x), (7, "a", "late", "T", None, *x), (8, "nowhere", "a", "T", None, *x), (9, "a", "exact", "T", at(50), *x), (10, "back", "a", "T", at(10), *x), (11, "a", "untimed", "T", at(10), *x),
    ]
    nodes = [("a", at(0)), ("b", at(0)), ("b", at(0)), ("late", at(900)), ("late", at(950)), ("gone", at(0)), ("exact", at(50)), ("back", at(0)), ("back", at(99)), ("untimed", None)]
    got = rows(orphans.broken_ends(*_broken(spark, edges, nodes, [("gone", at(5)), ("gone", at(5)), ("back", at(50)), ("never", at(1))])), "edge_id", "end_side", "reason")
    assert got == [(2, "to_node", "missing"), (5, "from_node", "late"), (6, "to_node", "gone"), (8, "from_node", "missing")]
    rep = orphans.orphan_report(*_broken(spark, edges, nodes, [("gone", at(5))]))
    assert sum(r["broken"] for r in rep.collect()) == 4 and {r["month"] for r in rep.collect()} == {"2024-01", "2024-03", None}


def test_orphans_of_nothing(spark):
    assert rows(orphans.broken_ends(*_broken(spark, [], []))) == []
    assert rows(orphans.broken_ends(*_broken(spark, [(1, "a", "b", "T", at(0), "k", 1)], [])), "edge_id", "end_side") == [(1, "from_node"), (1, "to_node")]


def test_hot_key_in_several_ranges(spark):
    n = 70_000  # more keys than one bitmap holds; one missing key takes a third of the ends
    e = spark.range(n).selectExpr("id as edge_id", "concat('n', id) as from_node", "if(id % 3 = 0, 'hub', concat('n', id + 1)) as to_node", "'T' as edge_type", "timestamp_ntz'2024-02-01' as extracted_at")
    nodes = spark.range(n).selectExpr("concat('n', id) as id", "timestamp_ntz'2024-01-01' as indexed_at")
    none = spark.createDataFrame([], "node_id string, removed_at timestamp_ntz")
    got = orphans.broken_ends(e, [nodes], none)
    assert got.count() == (n + 2) // 3 + (1 if (n - 1) % 3 else 0)


def test_bitmaps_hold_what_they_should(spark):
    n = 5_000
    e = spark.range(n).selectExpr("id as edge_id", "concat('n', id % 700) as from_node", "concat('m', id % 900) as to_node", "'T' as edge_type", "timestamp_ntz'2024-02-01' + make_dt_interval(int(id % 90)) as extracted_at")
    nodes = spark.range(600).selectExpr("concat('n', id) as id", "timestamp_ntz'2024-01-01' + make_dt_interval(int(id % 80)) as indexed_at")
    d = orphans.key_dictionary(orphans.edge_ends(e), [nodes], spark.createDataFrame([], "node_id string, removed_at timestamp_ntz"))
    code = {r["code"]: r for r in d.collect()}
    got = set()
    for r in orphans.bitmaps(d).collect():
        assert [w["word"] for w in r["words"]] == sorted({w["word"] for w in r["words"]}) and all(w["refs"] for w in r["words"])
        for w in r["words"]:
            for bit in range(64):
                if w["refs"] >> bit & 1:
                    k = code[(r["range"] << 15) + (w["word"] << 6) + bit]
                    first = k["first"] and k["first"].year * 12 + k["first"].month
                    assert bool(w["parents"] >> bit & 1) == bool(k["known"] and first < r["period"])
                    got.add((k["key"], r["period"]))
    assert got == {(k["key"], p) for k in code.values() for p in k["periods"]}


@pytest.mark.parametrize("name", ["p1_found", "p1_states", "p4_found", "p4_report"])
def test_queries_run(spark, sf, name):
    from specloom.plans import upkeep

    assert upkeep.QUERIES[name](spark, sf).count() > 0
