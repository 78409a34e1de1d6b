import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from webframe.operators.crawl import link_status
from webframe.operators.rewrite import link_targets
from webframe.operators.skew import hot_keys, salted_join


@pytest.fixture
def plain_shuffles(spark):
    names = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def links(spark, n=20_000):
    """Nine of ten links lead to one target, some more to a second one; two targets are not there, some are null."""
    rng = random.Random(3)
    rows = []
    for i in range(n):
        dst = "hot" if rng.random() < 0.9 else "warm" if rng.random() < 0.3 else rng.choice([f"u{rng.randrange(400)}", "gone", None])
        rows.append((f"p{i // 40}", i, dst))
    return rows, spark.createDataFrame(rows, "src string, pos int, dst string")


def test_hot_keys(spark):
    _, df = links(spark)
    found = {r._hot: r._pieces for r in hot_keys(df, "dst", 16).collect()}
    assert found["hot"] > 100 > found["warm"] >= 1 and not any(k.startswith("u") for k in found)
    assert hot_keys(df.where("dst like 'u%'"), "dst", 16) is None
    assert hot_keys(df.limit(0), "dst", 16) is None


@pytest.mark.parametrize("how", ["inner", "left"])
def test_as_the_plain_join(spark, how):
    _, df = links(spark)
    right = [(f"u{i}", i) for i in range(0, 400, 2)] + [("hot", 1), ("hot", 2), ("warm", 3), (None, 4)]
    right = spark.createDataFrame(right, "dst string, status int")
    got, want = salted_join(df, right, "dst", how), df.join(right, "dst", how)
    assert got.columns == want.columns
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))


def test_other_kinds_are_refused(spark):
    _, df = links(spark, 10)
    with pytest.raises(ValueError):
        salted_join(df, df, "dst", "full")


def _tasks(df):
    sizes = sorted(r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect())
    return sizes[-1], sizes[len(sizes) // 2], len(sizes)


def test_no_task_holds_a_popular_target(spark, plain_shuffles):
    _, df = links(spark)
    results = spark.createDataFrame([("hot", 200), ("warm", 404)] + [(f"u{i}", 200) for i in range(400)], "url string, status int")
    largest, median, tasks = _tasks(link_status(df, results))
    assert tasks == 16 and largest <= 3 * median
    plain = df.join(results.withColumnRenamed("url", "dst"), "dst", "left")
    assert _tasks(plain)[0] > 10 * _tasks(plain)[1]


def test_paths_of_a_popular_target(spark, plain_shuffles):
    rows, df = links(spark)
    pairs = df.where("dst is not null").select("src", F.col("pos").cast("string").alias("link"), "dst")
    urls = sorted({r[0] for r in rows}) + ["hot", "warm"]
    saved = spark.createDataFrame([(u, f"/s/{u}") for u in urls], "url string, save_path string")
    got = {(r.src, r.link): r.target for r in link_targets(pairs, saved).collect()}
    assert got == {(a, str(b)): c for a, b, c in rows if c in ("hot", "warm")}
