import random

import pytest

from corpusmill.operators import references
from corpusmill.operators.references import advance, orphan_report, orphaned_keys, orphans, orphans_of, state_of

REF, CHANGE = "ref_table string, ref_key string, key string, t bigint", "key string, t bigint"
HOUR = 3_600_000_000


def brute(refs, created, deleted):
    out = set()
    for table, ref, key, t in refs:
        if key is None:
            continue
        came = [c for k, c in created if k == key and c is not None and t is not None and c <= t]
        alive = came and not any(k == key and g is not None and max(came) < g <= t for k, g in deleted)
        if not alive:
            out.add((table, ref, key, t))
    return out


def run(spark, refs, created, deleted):
    f = lambda rows, s: spark.createDataFrame(rows, s)
    return orphans(f(refs, REF), f(created, CHANGE), f(deleted, CHANGE))


@pytest.mark.parametrize("hot", [references.HOT, 3])
def test_random_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(references, "HOT", hot)
    rng = random.Random(5)
    time = lambda: rng.choice([None, *range(0, 9), *(HOUR * h + rng.randrange(3) for h in range(6))])
    for _ in range(3):
        keys = [None, *"abcdef"]
        refs = [(rng.choice("xy"), str(k % 50), rng.choice(keys), time()) for k in range(120)]
        created = [(rng.choice(keys), time()) for _ in range(40)]
        deleted = [(rng.choice(keys), time()) for _ in range(25)]
        got = {tuple(r) for r in run(spark, refs, created, deleted).collect()}
        assert got == brute(refs, created, deleted)


def test_ties(spark):
    # a record counts from its own time, a deletion at that same time is not after it
    refs = [("g", "1", "a", 5), ("g", "2", "a", 4), ("g", "3", "b", 9)]
    got = {tuple(r) for r in run(spark, refs, [("a", 5), ("b", 7)], [("a", 5), ("b", 9)]).collect()}
    assert got == {("g", "2", "a", 4), ("g", "3", "b", 9)}


def test_empty_tables_and_hot_key(spark):
    assert run(spark, [], [], []).count() == 0
    refs = [("g", str(k), "hot", k * HOUR // 7) for k in range(3000)]
    got = run(spark, refs, [("hot", 0)], [("hot", 2000 * HOUR // 7)])
    assert got.count() == 1000
    report = {r["ref_table"]: r["orphans"] for r in orphan_report(got).groupBy("ref_table").sum("orphans").withColumnRenamed("sum(orphans)", "orphans").collect()}
    assert report == {"g": 1000}


def test_hot_moment(spark, monkeypatch):
    # all references of one key in one microsecond, between changes of the same second
    monkeypatch.setattr(references, "HOT", 20)
    refs = [("g", str(k), "hot", 1000 + k % 2) for k in range(200)] + [("g", "late", "hot", 5 * HOUR), ("g", "other", "b", 1000)]
    got = {r["ref_key"] for r in run(spark, refs, [("hot", 10), ("hot", 500), ("b", 1000)], [("hot", 1001)]).collect()}
    assert got == {str(k) for k in range(1, 200, 2)} | {"late"}


def test_state_advanced_by_deltas_equals_full_run(spark):
    rng = random.Random(8)
    keys = [None, *"abcdefgh"]
    refs = [("x", str(k), rng.choice(keys), rng.choice([None, *range(60)])) for k in range(150)]
    created, deleted = ([(rng.choice(keys), rng.choice([None, *range(60)])) for _ in range(n)] for n in (60, 40))
    f = lambda rows, s: spark.createDataFrame(rows, s)
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    full = state_of(f(refs, REF), f(created, CHANGE), f(deleted, CHANGE))
    # in three steps, the later ones with earlier times and repeated rows
    state = state_of(f(refs[::3], REF), f(created[::3], CHANGE), f(deleted[::3], CHANGE))
    for k in (1, 2):
        state = advance(state, f(refs[k::3] + refs[:5], REF), f(created[k::3] + created[:5], CHANGE), f(deleted[k::3], CHANGE))
    assert all(rows(a) == rows(b) for a, b in zip(state, full))
    assert {tuple(r) for r in orphans_of(state.references, state.changes).collect()} == brute(refs, created, deleted)
    alive = {}
    for key, t, sign in sorted(map(tuple, full.changes.collect())):
        alive[key] = sign > 0
    want = {k for _, _, k, _ in refs if k is not None and not alive.get(k)}
    assert {r["key"] for r in orphaned_keys(state.counts).collect()} == want
