import numpy as np
from pyspark.sql import functions as F

from sievewright.llm.mixing import mix_sources, splitting_tree, token_count, write_shards


def frame(spark, n=4000):
    rows = [(i, ["big", " BIG ", "mid", "small", None][min(i % 10, 4) if i % 10 > 5 else i % 2], 5 + i % 7, "x") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, source string, n long, shard string")


def test_tree_is_exact_and_even():
    out = splitting_tree([700, 33, 0, 5], 7, 1)
    assert out.sum(axis=0).tolist() == [700, 33, 0, 5]
    sizes = out.sum(axis=1)
    assert sizes.max() - sizes.min() <= 3
    assert np.array_equal(out, splitting_tree([700, 33, 0, 5], 7, 1))
    # the shards' shares are those of the whole, on average
    share = np.mean([splitting_tree([600, 400], 8, s)[0, 0] for s in range(200)]) / 125
    assert abs(share - 0.6) < 0.02


def test_shares_repeats_and_report(spark, tmp_path):
    df = frame(spark).cache()
    total = df.agg(F.sum("n")).first()[0]
    own = dict(df.where("source is not null").groupBy(F.lower(F.trim("source"))).agg(F.sum("n")).collect())
    targets = spark.createDataFrame([("BIG", 0.5, 2), ("mid", 0.02, 3), ("small", 0.4, 2), ("absent", 0.08, 9)], "source string, target_share double, max_repeats int")
    mix, report = mix_sources(df, "doc_id", "source", F.col("n"), targets, shards=4)
    got = {r["source"]: r for r in report.collect()}
    for s, share, most in (("big", 0.5, 2), ("mid", 0.02, 3), ("small", 0.4, 2)):
        want = min(share * total, own.get(s, 0) * most)
        assert want - 5 < got[s]["drawn_tokens"] <= want
        assert got[s]["short"] == (own.get(s, 0) * most < share * total)
    assert got["absent"]["short"] and got["absent"]["documents"] == 0
    used = mix.groupBy("doc_id").agg(F.count("*").alias("k"), F.count_distinct("repeat_no").alias("d")).where("k <> d").count()
    assert used == 0 and mix.where("repeat_no > 3").count() == 0
    assert mix.select("shard").distinct().count() == 4
    texts = df.withColumn("text", F.concat(F.lit("text of "), "doc_id"))
    write_shards(mix, texts.unionAll(texts.limit(5)), "doc_id", f"{tmp_path}/mix")
    written = spark.read.parquet(f"{tmp_path}/mix")
    assert written.count() == mix.count() and written.where("text <> concat('text of ', doc_id)").count() == 0
    assert written.select("shard").distinct().count() == 4


def test_tokens(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "é 漢字 <|endoftext|>"), (5, "word " * 20_000)], "i int, t string")
    n = {r["i"]: r["n"] for r in df.select("i", token_count("t").alias("n")).collect()}
    assert n[1] == 2 and n[2] == n[3] == 0 and n[4] > 4 and n[5] >= 20_000


def test_empty(spark):
    targets = spark.createDataFrame([("a", 0.5, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    mix, report = mix_sources(frame(spark).limit(0), "doc_id", "source", F.col("n"), targets)
    assert mix.count() == 0 and report.count() == 1 and not report.first()["short"]
