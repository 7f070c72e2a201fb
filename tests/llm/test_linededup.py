import random

import pytest

from loomdex.llm import linededup
from tests.llm.cases import awkward


def plain(docs, min_lines, min_chars):
    """docs: (doc_id, text) in their order."""
    lines = [(i, t.split("\n")) for i, t in docs]
    gone = {i: set() for i, _ in docs}
    seen_line, seen_run = set(), set()
    for i, ls in lines:
        for p, line in enumerate(ls):
            if line in seen_line and len(line) >= min_chars:
                gone[i].add(p)
            seen_line.add(line)
            run = tuple(ls[p : p + min_lines])
            if len(run) == min_lines:
                if run in seen_run:
                    gone[i].update(range(p, p + min_lines))
                seen_run.add(run)
    return {i: (len(ls), len(gone[i]), "\n".join(x for p, x in enumerate(ls) if p not in gone[i])) for i, ls in lines}


@pytest.mark.parametrize("min_lines,min_chars", [(1, 4), (2, 6), (3, 5), (4, 8), (5, 1000), (7, 9)])
def test_against_plain(spark, min_lines, min_chars):
    r = random.Random(min_lines)
    pool = [x * r.randint(0, 5) for x in ["ab", "c ", "longer line", "z", "é"]] + [""]
    docs = [(i, "\n".join(r.choice(pool) if r.random() < 0.8 else f"own {i} {k}" for k in range(r.randint(0, 30)))) for i in range(60)]
    docs[40] = (40, docs[3][1])
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    rows = linededup.dedup_lines(df, min_lines, min_chars).collect()
    assert {x.doc_id: (x["__n_lines"], x["__n_removed"], x.text) for x in rows} == plain(docs, min_lines, min_chars)


def test_many_lines_in_one_document(spark):
    docs = [(1, "\n".join(f"line {i % 40_000} of a very long document with repeated lines" for i in range(70_000)))]
    x = linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).first()
    assert (x["__n_lines"], x["__n_removed"]) == (70_000, 30_000) and x.text == "\n".join(docs[0][1].split("\n")[:40_000])


def test_awkward(spark):
    df = awkward(spark)
    rows = linededup.dedup_lines(df).collect()
    assert len(rows) == df.count() and linededup.dedup_lines(df).columns == [*df.columns, "__n_lines", "__n_removed"]
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by[None][0].text.startswith("the same") and by[1][0].text == "" and [x.text for x in by[2]] == ["", ""]  # null comes first
    assert by[3][0].text is None and by[3][0]["__n_lines"] == 0 and by[4][0].text == "" and by[4][0]["__n_lines"] == 1
    assert linededup.dedup_lines(df.limit(0)).count() == 0


def plain_runs(docs, least=3):
    """The maximal repeated runs, each suffix held against all others."""
    lines = {(i, t): t.split("\n") for i, t in docs if t is not None}
    at = [(d, p) for d, ls in lines.items() for p in range(len(ls))]

    def same(x, y):
        a, b = lines[x[0]][x[1] :], lines[y[0]][y[1] :]
        return next((n for n, (u, v) in enumerate(zip(a, b)) if u != v), min(len(a), len(b)))

    longest = {x: max((same(x, y) for y in at if y != x), default=0) for x in at}
    return sorted((d[0], p, n) for (d, p), n in longest.items() if n >= least and longest.get((d, p - 1), 0) != n + 1)


@pytest.mark.parametrize("seed", range(3))
def test_maximal_runs_against_all_pairs(spark, seed):
    r = random.Random(seed)
    line = lambda: r.choice("abcdefgh") if r.random() < 0.6 else f"only {r.random()}"
    long = [f"shared {i}" for i in range(40)]
    docs = [(i, "\n".join(line() for _ in range(r.randint(1, 12)))) for i in range(25)]
    docs += [(100 + i, "\n".join([line(), *long[r.randrange(10) : r.randint(15, 40)], line()])) for i in range(8)]
    docs += [(200, "x\nx\nx\nx\nx\nx\nx"), (201, "\n".join(long)), (202, "\n".join(long)), (203, None), (204, "")]
    got = linededup.maximal_runs(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    want = plain_runs(docs)
    assert sorted((x.doc_id, x.start, x.length) for x in got) == want and max(n for _, _, n in want) > 20


def test_maximal_runs_of_awkward_rows(spark):
    df = awkward(spark)
    got = {(x.doc_id, x.start, x.length) for x in linededup.maximal_runs(df).collect()}
    assert got == {(1, 0, 3), (2, 0, 3), (None, 0, 3)} and linededup.maximal_runs(df.limit(0)).count() == 0
