from __future__ import annotations

import itertools

import pytest
from batchloom.operators import truncate
from pyspark.sql import functions as F

EOS = 2


@pytest.fixture(scope="module")
def sides(spark):
    """All pairs of lengths up to 9, ids counting from 10 and 100."""
    rows = [(p, r, list(range(10, 10 + p)), list(range(100, 100 + r))) for p, r in itertools.product(range(10), repeat=2)]
    return spark.createDataFrame(rows, "p int, r int, a array<int>, b array<int>").cache()


def last(x):
    return x[:-1] + [EOS] if x else [EOS]


def instruction_first(a, b, m):
    if len(a) + len(b) <= m:
        return a, b
    r = min(len(b), m - min(len(a), m // 2))
    return last(a[: m - r]), last(b[:r])


def response_first(a, b, m):
    if len(a) + len(b) <= m:
        return a, b
    p = min(len(a), m - min(len(b), m // 2))
    x, y = a[:p], b[: m - p]
    return last(x) if x else x, last(y) if y else y


@pytest.mark.parametrize("most", [1, 2, 5, 8])
@pytest.mark.parametrize(("ours", "lengths", "plain"), [(truncate.instruction_first, truncate.instruction_first_lengths, instruction_first), (truncate.response_first, truncate.response_first_lengths, response_first)])
def test_two_sides(sides, most, ours, lengths, plain):
    x, y = ours(F.col("a"), F.col("b"), most, EOS)
    p, r = lengths(F.col("p"), F.col("r"), most)
    for row in sides.select("a", "b", x.alias("x"), y.alias("y"), p.alias("n"), r.alias("m")).collect():
        assert (row.x, row.y) == plain(row.a, row.b, most)
        assert (row.n, row.m) == (len(row.x), len(row.y))
        if len(row.a) + len(row.b) > most > 1 and row.a and row.b:
            assert len(row.x) + len(row.y) == most


@pytest.mark.parametrize(("p", "r", "m", "first", "second"), [(2000, 100, 512, (412, 100), (412, 100)), (100, 2000, 512, (100, 412), (100, 412)), (600, 600, 1024, (512, 512), (512, 512)), (9, 9, 5, (2, 3), (3, 2))])
def test_worked_lengths(spark, p, r, m, first, second):
    df = spark.range(1)
    for f, expected in ((truncate.instruction_first_lengths, first), (truncate.response_first_lengths, second)):
        assert tuple(df.select(*f(F.lit(p), F.lit(r), m)).first()) == expected


@pytest.mark.parametrize("keep", ["tail", "head"])
@pytest.mark.parametrize("most", [2, 5, 8])
def test_budget_aware_keeps_the_budget(sides, most, keep):
    x, y, cut = truncate.budget_aware(F.col("a"), F.col("b"), most, EOS, keep=keep)
    for row in sides.select("a", "b", x.alias("x"), y.alias("y"), cut.alias("cut")).collect():
        assert len(row.x) + len(row.y) <= most
        assert row.cut == (len(row.a) + len(row.b) > most)
        if not row.cut:
            assert (row.x, row.y) == (row.a, row.b)
        elif len(row.b) < most:
            assert row.y == row.b
            n = most - len(row.b) - 1
            assert row.x == ((row.a[len(row.a) - n :] if keep == "tail" else row.a[:n]) + [EOS])


def test_budget_aware_worked_case(spark):
    df = spark.createDataFrame([(list(range(10, 18)), list(range(5)))], "a array<int>, b array<int>")
    x, y, _ = truncate.budget_aware(F.col("a"), F.col("b"), 8, EOS)
    row = df.select(x.alias("x"), y.alias("y")).first()
    assert row.x == [16, 17, EOS] and len(row.y) == 5
    with pytest.raises(ValueError):
        truncate.budget_aware(F.col("a"), F.col("b"), 8, EOS, keep="middle")


@pytest.mark.parametrize(("p", "expected"), [(6, (4, 10, 4)), (16, (4, 0, 0))])
def test_preference(spark, p, expected):
    df = spark.createDataFrame([([1] * p, [1] * 12, [1] * 4)], "p array<int>, c array<int>, j array<int>")
    got = truncate.preference(F.col("p"), F.col("c"), F.col("j"), 16, EOS)
    assert tuple(df.select(*[F.size(x) for x in got]).first()) == expected
    fixed = truncate.preference(F.col("p"), F.col("c"), F.col("j"), 16, EOS, fix_budget=True)
    assert tuple(df.select(*[F.size(x) for x in fixed]).first()) == (4, 12, 4)


def test_independent_and_first_ids(sides):
    x, over = truncate.independent(F.col("a"), 4, EOS)
    for row in sides.select("a", x.alias("x"), over.alias("o"), truncate.first_ids(F.col("a"), 4).alias("f")).collect():
        assert row.o == (len(row.a) > 4) and row.f == row.a[:4]
        assert row.x == (row.a[:3] + [EOS] if row.o else row.a)


def test_trim_may_drop_the_response(spark):
    assert tuple(spark.range(1).select(*truncate.trim_lengths(F.lit(8), F.lit(5), F.lit(13), 8)).first()) == (8, 8, 0)


def test_rollout_prompt(spark):
    df = spark.createDataFrame([([5, 6],), ([],), ([1, 2, 3, 4, 5],)], "p array<int>")
    got = [tuple(r) for r in df.select(*truncate.rollout_prompt(F.col("p"), 4, 2, 0)).collect()]
    assert got[0] == ([0, 0, 5, 6, 0, 0], [0, 0, 1, 1, 0, 0])
    assert got[1] == ([0] * 6, [0] * 6) and got[2] == ([1, 2, 3, 4, 0, 0], [1, 1, 1, 1, 0, 0])
