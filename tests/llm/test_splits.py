import random

from pyspark.sql import functions as F

from sievewright.llm.splits import entity_components, split_related, tied_pairs

SCHEMA = "sample_id string, parent string, cat string, taxon string, split string, label string"


def rows(n, parents, cats, seed=1):
    rng = random.Random(seed)
    return [(f"s{i}", rng.choice([None, " ", "NaN", f"P{rng.randint(0, parents)} ", f"p{rng.randint(0, parents)}"]), rng.choice([None, "", f"C{rng.randint(0, cats)}"]), rng.choice("xyz"), "old", "l") for i in range(n)]


def test_related_rows_share_a_split(spark):
    df = spark.createDataFrame(rows(3000, 1500, 900), SCHEMA).cache()
    out = split_related(df, "parent", "cat", "sample_id", F.col("taxon")).cache()
    assert out.count() == 3000 and set(out.columns) == set(SCHEMA.replace(",", "").split()[::2]) | {"group_key"}
    for c in ("parent", "cat"):
        key = F.lower(F.trim(c))
        assert out.where(f"{c} is not null").where(~key.isin("", "nan")).groupBy(key).agg(F.count_distinct("split").alias("k")).where("k > 1").count() == 0


def test_proportions_and_labels(spark):
    df = spark.createDataFrame([(f"s{i}", f"p{i // 2}", None, "xyz"[i // 2 % 3], "", "") for i in range(6000)], SCHEMA)
    out = split_related(df, "parent", "cat", "sample_id", F.col("taxon")).groupBy("split", "taxon").count().collect()
    share = {"train": 0.9, "validation": 0.05, "test": 0.05}
    for r in out:
        assert abs(r["count"] - 2000 * share[r["split"]]) <= 4
    assert len(out) == 9


def test_hot_group_goes_to_the_large_split(spark):
    df = spark.createDataFrame([(f"s{i}", f"p{i}", "hot" if i % 3 == 0 else f"c{i}", "x", "", "") for i in range(900)], SCHEMA)
    out = split_related(df, "parent", "cat", "sample_id", F.col("taxon"))
    assert out.where("cat = 'hot' and split = 'train'").count() == 300
    assert out.where("split <> 'train'").count() > 60


def test_pairs(spark):
    data = [("1", "p1", "A"), ("2", "P1 ", "b"), ("3", "p2", "b "), ("4", "p2", "c"), ("5", "p3", "d"), ("6", None, "d"), ("7", "nan", "e"), ("8", "NaN", "f"), ("1", "p1", "A")]
    df = spark.createDataFrame(data, "sample_id string, parent string, cat string")
    assert sorted(tuple(r) for r in tied_pairs(entity_components(df, "parent", "cat")).collect()) == [("a", "b"), ("a", "c"), ("b", "c")]


def test_empty_and_all_missing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert split_related(none, "parent", "cat", "sample_id", F.col("taxon")).count() == 0
    blank = spark.createDataFrame([(None, None, None, None, None, None)] * 3 + [("a", None, " ", None, None, None)], SCHEMA)
    assert split_related(blank, "parent", "cat", "sample_id", F.col("taxon")).count() == 4


def test_groups_of_mixed_labels_and_many_labels(spark):
    rng = random.Random(11)
    sizes = [rng.choice([1, 1, 2, 3, 8, 40]) for _ in range(700)]
    data = [(f"s{g}.{i}", f"p{g}", None, rng.choice("aaaabbc") + ("" if g % 9 else str(g)), "", "") for g, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(data, SCHEMA)
    got = {(r["split"], r["l"]): r["count"] for r in split_related(df, "parent", "cat", "sample_id", F.col("taxon")).groupBy("split", F.substring("taxon", 1, 1).alias("l")).count().collect()}
    total = {x: sum(n for (_, y), n in got.items() if y == x) for x in "abc"}
    for x in "abc":
        for split, share in (("train", 0.9), ("validation", 0.05), ("test", 0.05)):
            assert abs(got.get((split, x), 0) / total[x] - share) < 0.03
