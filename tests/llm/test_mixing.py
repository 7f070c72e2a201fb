from collections import Counter

import pytest

from loomdex.llm import mixing
from tests.llm.cases import awkward


def plain_targets(sizes: dict):
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, list(order), sum(sizes.values())
    while free:
        share = left / sum(weight[s] for s in free)
        over = [s for s in free if share * weight[s] > 3 * sizes[s]]
        if not over:
            target |= {s: share * weight[s] for s in free}
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            free.remove(s)
    return target


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100, None: 10}, {"z": 5, "y": 1000, "x": 1, "w": 0}, {"only": 7}, {f"s{i}": i * i + 1 for i in range(9)}, {"a": 0, "b": 0}])
def test_targets_against_resharing(spark, sizes):
    rows = mixing.source_targets(spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, size long")).collect()
    want = plain_targets(sizes)
    assert {r.source: pytest.approx(r.target) for r in rows} == want


def test_mix(spark):
    docs = [(i, "w " * (i % 37 + 1), f"s{i % 4}" if i % 9 else None) for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = mixing.mix(df).collect()
    assert len(rows) == 3000
    taken, target = Counter(), {}
    for r in rows:
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size and r.taken % r.size == 0
    for s, t in target.items():
        assert abs(taken[s] - t) <= 37
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mixing.mix(df.repartition(7)).collect()), key=repr)


def test_blocks_do_not_change_totals(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 50)
    docs = [(i, "a b c", "hot" if i % 3 else "cold") for i in range(900)]
    rows = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    for s in ("hot", "cold"):
        assert abs(sum(r.taken for r in rows if r.source == s) - next(r.target for r in rows if r.source == s)) <= 3


def test_emit(spark):
    df = spark.createDataFrame([(i, "w " * 10, "a" if i % 5 else "b", i) for i in range(500)], "doc_id long, text string, source string, copies int")
    copies = {r.doc_id: r.copies for r in mixing.mix(df).collect()}
    got = Counter(r.doc_id for r in mixing.emit(df).collect())
    assert {k: v for k, v in copies.items() if v} == dict(got) and mixing.emit(df).columns == df.columns


def test_emit_takes_what_mix_says_without_unique_ids(spark):
    rows = [(7 if i % 2 else None if i % 3 else i, f"w{i} " * (i % 11 + 1), "abc"[i % 3 * (i % 5 > 0)]) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want, got = Counter(), Counter()
    for r in mixing.mix(df).collect():
        want[r.source] += r.taken
    for r in mixing.emit(df).collect():
        got[r.source] += len(r.text.split())
    assert got == want


def test_awkward(spark):
    df = awkward(spark)
    rows = mixing.mix(df).collect()
    assert len(rows) == df.count() and all(r.taken <= 3 * r.size for r in rows)
    assert {r.size for r in rows if r.doc_id in (3, 4, 5, 10)} == {0}
    assert mixing.emit(df).columns == df.columns and mixing.emit(df).count() > 0
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.emit(df.limit(0)).count() == 0
