import random

import pytest
from pyspark.sql import functions as F

from conftest import order, values
from stonewatch.functions import grouped as g


def test_running_sum_and_previous_max_across_chunks(make):
    rng = random.Random(1)
    rows = [(k, i, rng.randint(0, 50)) for k in "ab" for i in range(200 if k == "a" else 7)]
    df = make("k string, i bigint, v bigint", rows).withColumn("c", g.seq_chunk("i", 16))
    got = g.running_sum(df, ["k"], ["c"], ["i"], "v", "total")
    got = g.previous_max(got, ["k"], ["c"], ["i"], "v", "before")
    want = []
    for k in "ab":
        total, high = 0, None
        for _, i, v in (r for r in rows if r[0] == k):
            total += v
            want.append((k, i, total, high))
            high = v if high is None else max(high, v)
    assert values(got, "k", "i", "total", "before") == sorted(want, key=order)


def top_mean(numbers):
    known = sorted((n for n in numbers if n is not None), reverse=True)
    ranked = known + [None] * (len(numbers) - len(known))
    top = [n for n in ranked[: len(numbers) // 100] if n is not None]
    return sum(top) / len(top) if top else None


def test_top_percent_mean_equals_sorting(make):
    rng = random.Random(2)
    groups = {
        "ninety_nine": [rng.random() for _ in range(99)],
        "hundred": [rng.random() for _ in range(100)],
        "ties": [1.0] * 1000,
        "close": [5 + rng.random() / 1000 for _ in range(2500)],
        "spread": [10 ** rng.uniform(-6, 6) for _ in range(3000)],
        "zeros": [0.0] * 500,
        "missing": [rng.random() for _ in range(3)] + [None] * 997,
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs]
    got = dict(values(g.top_percent_mean(make("k string, m double", rows), ["k"], "m", "top"), "k", "top"))
    for name, numbers in groups.items():
        want = top_mean(numbers)
        if len(numbers) < 100:
            assert name not in got
        else:
            assert got[name] == pytest.approx(want, rel=1e-12), name


def test_close_readings_leave_few_rows_to_rank(make, spark, monkeypatch):
    """One sensor at rest: all magnitudes differ and lie within two per thousand."""
    rows = spark.range(200_000).select(
        F.lit("s").alias("k"), (F.lit(1.0) + F.pmod(F.hash("id"), F.lit(1_000_003)) / 5e8 + F.col("id") / 1e12).alias("m")
    )
    met = []
    plain = g.broadcast_if_small
    monkeypatch.setattr(g, "broadcast_if_small", lambda df, *a: met.append(plain(df, *a)) or met[-1])
    got = g.top_percent_mean(rows, ["k"], "m", "top").first().top
    numbers = sorted((r.m for r in rows.collect()), reverse=True)[:2000]
    assert got == pytest.approx(sum(numbers) / 2000, rel=1e-12)
    assert len(met) > 1 and met[-1].first()._n <= g.EDGE_ROWS < met[0].first()._n


def test_top_percent_mean_of_a_value_of_the_rank(make):
    rows = [("a", i / 100) for i in range(200)]
    df = g.top_percent_mean(
        make("k string, m double", rows), ["k"], "m", "top", value=lambda m: F.abs(m - 2)
    )
    assert df.first().top == pytest.approx((0.01 + 0.02) / 2)


def serve_one_by_one(requests, room):
    left, out = dict(room), []
    for k, seq, q in sorted(requests, key=lambda r: r[1]):
        fits = q <= left.get(k, 0)
        if fits:
            left[k] = left.get(k, 0) - q
        out.append((k, seq, fits))
    return out


@pytest.mark.parametrize("seed", [3, 4])
def test_greedy_accept_equals_one_by_one(make, seed):
    rng = random.Random(seed)
    requests = [(rng.choice("aab c"), i, rng.randint(0, 30)) for i in range(150)]
    room = {"a": 200, "b": 90, "c": 0}
    got = g.greedy_accept(
        make("k string, seq bigint, q bigint", requests),
        make("k string, room bigint", room.items()),
        ["k"],
        "seq",
        "q",
    )
    assert values(got, "k", "seq", "accepted") == sorted(serve_one_by_one(requests, room), key=order)


def test_many_refusals_take_few_rounds(make, monkeypatch):
    """Each unit taken is followed by a demand of one unit too many: 10,000 refusals in turn."""
    left, requests = 20_000, []
    for _ in range(10_000):
        requests += [("a", len(requests), 1), ("a", len(requests) + 1, left)]
        left -= 1
    requests += [("a", len(requests), left), ("a", len(requests) + 1, 1), ("a", len(requests) + 2, 0)]
    cuts = []
    whole = g.cut_lineage
    monkeypatch.setattr(g, "cut_lineage", lambda df: cuts.append(df) or whole(df))
    got = g.greedy_accept(
        make("k string, seq bigint, q bigint", requests), make("k string, room bigint", [("a", 20_000)]), ["k"], "seq", "q"
    )
    assert values(got, "k", "seq", "accepted") == sorted(serve_one_by_one(requests, {"a": 20_000}), key=order)
    assert len(cuts) < 40


def test_fractional_demands_are_served_in_order(make):
    rng = random.Random(9)
    requests = [(rng.choice("ab"), i, rng.choice([0, 0.1, 0.3, 2.5, 0.7, 4, 0.2])) for i in range(120)]
    tenths = [(k, i, round(q * 10)) for k, i, q in requests]
    got = g.greedy_accept(
        make("k string, seq bigint, q decimal(5,1)", requests),
        make("k string, room decimal(5,1)", [("a", 33.3), ("b", 8)]),
        ["k"],
        "seq",
        "q",
    )
    assert values(got, "k", "seq", "accepted") == sorted(serve_one_by_one(tenths, {"a": 333, "b": 80}), key=order)


def test_range_maximum(make, monkeypatch):
    monkeypatch.setattr(g, "BLOCK_RANKS", 4)
    rng = random.Random(2)
    numbers = {k: [rng.randint(0, 99) for _ in range(n)] for k, n in (("a", 90), ("b", 3))}
    rows = [(k, i, v) for k, vs in numbers.items() for i, v in enumerate(vs)]
    asked = [("b", 0, 2), ("b", 1, 1), ("a", 0, 89)]
    asked += [("a", *sorted((rng.randrange(90), rng.randrange(90)))) for _ in range(60)]
    table = g.RangeMaximum(make("k string, r bigint, v bigint", rows), ["k"], "r", "v")
    got = table.over(make("k string, lo bigint, hi bigint", asked), "lo", "hi", "peak")
    assert values(got, "k", "lo", "hi", "peak") == sorted((k, a, b, max(numbers[k][a : b + 1])) for k, a, b in asked)


def test_slices_spread_one_key_with_any_order(spark):
    """Lots of a million units each, and fractional ones: slices follow rows, not units."""
    for scale in (1_000_000, 0.001):
        rows = spark.range(2000).selectExpr("1 AS k", f"id * {scale} AS at", "1 AS v")
        cut = g.sliced(rows, ["k"], ["at"])
        sizes = [r["count"] for r in cut.groupBy("_slice").count().collect()]
        assert len(sizes) >= 4 and max(sizes) < 1000
        places = g.carried_sum(cut, ["k"], "v", "place").orderBy("at").select("place").collect()
        assert [r.place for r in places] == list(range(1, 2001))


def test_match_ranges_covers_the_shorter_side(make):
    left = make("k string, upto bigint, l bigint", [("a", 5, 1), ("a", 5 + 3, 2), ("a", 20, 3), ("b", 4, 9)])
    right = make("k string, upto bigint, r bigint", [("a", 2, 7), ("a", 8, 8), ("a", 30, 9), ("c", 1, 1)])
    got = g.match_ranges(left, right, ["k"], "l", "r")
    assert values(got, "l", "r", "amount") == [(1, 7, 2), (1, 8, 3), (2, 8, 3), (3, 9, 12)]


def test_settle_follows_chains_of_verdicts(make):
    """A row is refused when the one before it is accepted: verdicts alternate."""
    from pyspark.sql import Window

    rows = make("k string, seq bigint", [("a", i) for i in range(6)] + [("b", 0)])

    def judge(df):
        w = Window.partitionBy("k").orderBy("seq")
        ahead = F.lag(F.col("previous").isNull()).over(w)
        return df.withColumn("reason", F.when(ahead, F.lit("blocked")))

    want = sorted([("a", i, None if i % 2 == 0 else "blocked") for i in range(6)] + [("b", 0, None)], key=order)
    assert values(g.settle(rows, judge), "k", "seq", "reason") == want
    assert values(g.settle(rows, judge, groups=["k"]), "k", "seq", "reason") == want
    wrong = rows.withColumn("previous", F.lit("blocked"))
    assert values(g.settle(wrong, judge), "k", "seq", "reason") == want


def test_slices_and_their_tasks_grow_with_the_rows(spark, monkeypatch):
    """More slices than the planner's four partitions, when those would hold too many rows."""
    monkeypatch.setattr(g, "SLICE_ROWS", 100, raising=False)
    rows = spark.range(2000).selectExpr("id % 3 AS k", "id AS upto", "named_struct('t', string(id), 'n', id) AS l")
    cut = g.sliced(rows, ["k"], ["upto"])
    assert max(r["count"] for r in cut.groupBy("_slice").count().collect()) < 300
    summed = g.carried_sum(cut, ["k"], "upto", "sum")
    assert max(r["count"] for r in summed.groupBy(F.spark_partition_id()).count().collect()) < 500
    met = g.match_ranges(rows, rows.withColumnRenamed("l", "r"), ["k"], "l", "r")
    sizes = [r["count"] for r in met.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 500 and met.filter("l <> r OR l.t <> l.n").isEmpty()
    assert met.agg(F.sum("amount")).first()[0] == 1997 + 1998 + 1999
