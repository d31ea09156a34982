import re

import pytest

from gristmill.llm.mixing import curriculum_mix, source_targets


def water_fill(sizes, weights, most=3):
    """Targets by repeated resharing: (sizes by source in order)."""
    total, capped = sum(sizes), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        left = total - sum(most * sizes[i] for i in capped)
        w = sum(weights[i] for i in free)
        target = {i: left * weights[i] / w for i in free} | {i: most * sizes[i] for i in capped}
        over = {i for i in free if target[i] > most * sizes[i]}
        if not over:
            return [target[i] for i in range(len(sizes))]
        capped |= over


@pytest.mark.parametrize("sizes", [[100, 100, 100], [1, 1000, 5], [0, 10, 20, 3000, 7, 7, 1], [5], [0, 0]])
def test_targets_match_repeated_resharing(spark, sizes):
    df = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, source_size long")
    got = {r.source: r.target for r in source_targets(df).collect()}
    want = water_fill(sizes, [(1, 2, 3)[i % 3] for i in range(len(sizes))]) if sum(sizes) else [0] * len(sizes)
    assert [got[f"s{i}"] for i in range(len(sizes))] == pytest.approx(want)


def rows():
    out = [(i, " ".join(["w"] * (i % 7 + 1)), ("a", "b", "ä", None)[i % 4 if i % 3 else 0], i) for i in range(300)]
    return out + [(300, None, "b", 0), (301, "", "z", 0), (None, "x y\tz\x0bq\n", "b", 0), (7, "w w", "b", 0), (7, "w w", "b", 0), (302, "u " * 5000, "b", 0)]


def test_takes_targets_and_orders_by_schedule(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, source string, size int").repartition(5)
    first = curriculum_mix(df).collect()
    assert sorted(map(str, first)) == sorted(map(str, curriculum_mix(df.repartition(3)).collect()))
    assert sorted(r["size"] for r in first) == sorted(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _, _ in rows())
    taken = {}
    for r in first:
        assert 0 <= r.taken <= 3 * r["size"] and (r.position is None) == (r.taken == 0)
        taken[r.target] = taken.get(r.target, 0) + r.taken
    for target, words in taken.items():
        assert words == int(target)
    where = [r.position for r in first if r.position is not None]
    assert where == sorted(where) and all(0 <= p <= 1 for p in where)


def test_rising_weights_come_later(spark):
    df = spark.createDataFrame([(i, "w w w", "ab"[i % 2], i) for i in range(400)], "doc_id long, text string, source string, extra int")
    out = curriculum_mix(df, schedules=((0.0, 2.0), (2.0, 0.0)), carry=("source", "extra", "text")).collect()
    mean = lambda s: sum(r.position for r in out if r.source == s) / 200
    assert mean("a") == pytest.approx(2 / 3, abs=0.02) and mean("b") == pytest.approx(1 / 3, abs=0.02)
    assert {r.extra for r in out} == set(range(400))


def test_empty_table(spark):
    assert curriculum_mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    with pytest.raises(ValueError):
        curriculum_mix(spark.createDataFrame([], "doc_id long, text string, source string"), schedules=((0.0, 0.0),))


def test_every_copy_has_its_place(spark):
    sizes = {"a": 400, "b": 100, "c": 60}  # mean weights 1, 2, 3: b and c are repeated
    docs = [(100 * k + i, " ".join(["w"] * (i % 4 + 1)), s) for k, s in enumerate(sizes) for i in range(sizes[s])]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(4)
    whole = curriculum_mix(df, carry=("source",)).collect()
    each = curriculum_mix(df, carry=("source",), every_copy=True).collect()
    assert max(r.copies for r in whole) == 3
    for r in whole:
        assert len(r.positions) == r.copies and list(r.positions) == sorted(r.positions) and r.position == (r.positions[0] if r.copies else None)
    assert sorted((r.doc_id, r.source, p) for r in whole for p in r.positions) == sorted((r.doc_id, r.source, r.position) for r in each)
    assert [r.position for r in each] == sorted(r.position for r in each)
    weights = {"a": (0.5, 1.5), "b": (2.0, 2.0), "c": (4.5, 1.5)}
    for s, (w0, w1) in weights.items():
        own = [r for r in each if r.source == s]
        assert sum(r.copy_taken for r in own) == int(own[0].target)
        # Demand up to each quarter of training is met, so copies fill all of the schedule.
        for t in (0.25, 0.5, 0.75, 1.0):
            due = own[0].target * (w0 * t + (w1 - w0) * t * t / 2) / ((w0 + w1) / 2)
            assert abs(sum(r.copy_taken for r in own if r.position <= t) - due) <= 5
