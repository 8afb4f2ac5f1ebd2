import random
from fractions import Fraction

from sievewright.llm.sampling import canonical_labels, divisor_seats, proportional_sample


def brute(seats, targets, floors, available):
    rows = []
    for i, (t, f, a) in enumerate(zip(targets, floors, available, strict=True)):
        for r in range(1, a + 1):
            if r <= f:
                rows.append((0, r, i))
            elif t > 0:
                rows.append((1, (r - Fraction(1, 2)) / t, i))
    got = [0] * len(targets)
    for _, _, i in sorted(rows)[:seats]:
        got[i] += 1
    return got


def test_seats_equal_the_sorted_priorities():
    rng = random.Random(3)
    for _ in range(300):
        k = rng.randint(1, 6)
        targets = [Fraction(rng.randint(0, 9), 20) for _ in range(k)]
        floors, available = [rng.randint(0, 4) for _ in range(k)], [rng.randint(0, 40) for _ in range(k)]
        seats = rng.randint(0, 90)
        assert divisor_seats(seats, targets, floors, available) == brute(seats, targets, floors, available)


TARGETS = [("P", "a", 0.5, 2), ("P", "b", 0.25, 1), ("Q", "a", 0.25, 5)]


def test_sample_and_report(spark):
    aliases = spark.createDataFrame([("t", "p", "P"), ("t", "plant", "P"), ("t", "q", "Q"), ("u", "a", "a"), ("u", "b", "b")], "field_name string, alias string, canonical string")
    rows = [(f"k{i}", " Plant " if i % 2 else "P", "A") for i in range(200)] + [(f"m{i}", "p", "b") for i in range(100)] + [("z1", "q", "a"), ("z1", "Q", "a"), ("x", "nan", "a"), (None, "p", "a"), ("y", None, None)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows * 2], "key string, t string, u string, cell int, priority int")
    targets = spark.createDataFrame(TARGETS, "t string, u string, target_share double, min_rows int")
    named = canonical_labels(df, aliases, ["t", "u"])
    sample, report = proportional_sample(named, "key", ["t", "u"], targets)
    got = {(r["t"], r["u"]): r for r in report.collect()}
    n = 303 // 4
    assert sum(r["sampled"] for r in got.values()) == n == sample.count() == sample.select("key").distinct().count()
    assert got["Q", "a"]["available"] == got["Q", "a"]["sampled"] == 1 and got["Q", "a"]["short"]
    assert not got["P", "a"]["short"] and not got["P", "b"]["short"]
    again = {r["key"] for r in proportional_sample(named, "key", ["t", "u"], targets)[0].collect()}
    assert again == {r["key"] for r in sample.collect()}


def test_tie_is_no_case(spark):
    df = spark.createDataFrame([(f"k{i}", "P") for i in range(22)] + [(f"o{i}", None) for i in range(378)], "key string, t string")
    targets = spark.createDataFrame([("P", 0.22, 0)], "t string, target_share double, min_rows int")
    r = proportional_sample(df, "key", ["t"], targets)[1].first()
    assert r["target_rows"] == 22 and not r["short"]


def test_empty_and_nulls(spark):
    df = spark.createDataFrame([], "key string, t string")
    targets = spark.createDataFrame([("P", 0.5, 1), (None, None, None)], "t string, target_share double, min_rows int")
    sample, report = proportional_sample(df, "key", ["t"], targets)
    assert sample.count() == 0 and report.where("short").count() == 1
