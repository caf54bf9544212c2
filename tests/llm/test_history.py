import random

import pytest
from pyspark.sql import functions as F

from tallyweir.llm.history import KeyHistory


def test_batches(spark, tmp_path):
    rng = random.Random(6)
    keys = [f"K{i}" for i in range(300)] + ["hot"] * 60 + ["", None]
    history, known = KeyHistory(spark, str(tmp_path), 3), set()
    log = [(rng.choice(keys),) for _ in range(100)]
    history.learn(spark.createDataFrame(log, "key string"), "key", 0)
    known |= {k for (k,) in log if k}
    for batch in range(1, 5):
        rows = [(batch * 1000 + i, rng.choice(keys)) for i in range(120)]
        expected, now = {}, set(known)
        for i, k in rows:
            expected[i] = (k in now) if k else None
            now |= {k} if k else set()
        df = spark.createDataFrame(rows, "id bigint, key string").repartition(3)
        for _ in range(2):  # a batch that runs again gives the same answer
            assert {r["id"]: r["seen"] for r in history.probe(df, "key", "id", batch).collect()} == expected
        known = now
        if batch == 3:
            history.compact()
            assert history.files.live() == (3, [])
            with pytest.raises(ValueError):
                history.probe(df, "key", "id", 2)
    n, size = history.size()
    assert n == len(known) and size < 6000
    assert history.fresh(df, "key", "id", 9).count() == 0
    new = history.fresh(spark.createDataFrame([(7, "new"), (5, "new"), (1, "K1")], "id bigint, key string"), "key", "id", 9).collect()
    assert [r["first_order"] for r in new] == [5] and 0 < new[0]["rate"] < 1e-8


def test_reads_only_the_slots_it_probes(spark, tmp_path):
    history = KeyHistory(spark, str(tmp_path), 200)
    history.learn(spark.range(5000).select(F.col("id").cast("string").alias("key")), "key", 0)
    for carried in (0, 1 << 20):
        history.carried = carried
        fresh = history.fresh(spark.createDataFrame([(1, "7"), (2, "nine"), (3, "8")], "id bigint, key string"), "key", "id", 1)
        assert [r["first_order"] for r in fresh.collect()] == [2]
        plan = fresh._jdf.queryExecution().optimizedPlan().toString()
        slots = history.spark.read.parquet(f"{history._fresh_path(1)}-asked").select("slot").distinct().count()
        assert slots <= 3 and ("strategy=broadcast" in plan) == (carried > 0)
        scan = next(line for line in fresh._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in line and "coded" in line)
        assert "slot#" in scan.split("PartitionFilters: [")[1].split("]")[0]


def test_empty(spark, tmp_path):
    history = KeyHistory(spark, str(tmp_path), 1)
    history.compact()
    assert history.size() == (0, 0)
    none = spark.createDataFrame([], "id bigint, key string")
    assert history.probe(none, "key", "id", 0).count() == 0
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, "")], "id bigint, key string")
    assert [r["seen"] for r in history.probe(rows, "key", "id", 1).orderBy("id").collect()] == [False, True, None, None]
    assert history.probe(rows.withColumn("x", F.lit(1)), "key", "id", 2).where("seen").count() == 2
