import random

import pytest
from pyspark.sql import functions as F

from tallyweir.llm import mixing, tokens

from ..conftest import rows

RECORDS = "id bigint, source string, size bigint"
TARGETS = "source string, target_share double, max_repeats int"


def _brute(records, plans, total):
    """Repeats of each record by sorting hashes."""
    out = []
    for p in plans:
        own = sorted((r["hash"], r["id"], r["size"]) for r in records if r["source"] == p.source)
        available = sum(s for _, _, s in own)
        budget = p.share * total
        if not available or p.max_repeats < 1 or p.share <= 0:
            continue
        full = min(p.max_repeats, int(budget // available))
        rest, used, i = budget - full * available, 0, 0
        once = set()
        while full < p.max_repeats and i < len(own):
            same = [r for r in own[i:] if r[0] == own[i][0]]
            used += sum(s for _, _, s in same)
            if used > rest:
                break
            once |= {id for _, id, _ in same}
            i += len(same)
        out += [(id, p.source, s, full + (id in once)) for _, id, s in own if full + (id in once)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("bits", [2, 10])
@pytest.mark.parametrize("total", [None, 500, 10**7, 0])
def test_against_sorting(spark, monkeypatch, bits, total):
    monkeypatch.setattr(mixing, "BITS", bits)
    rng = random.Random(5)
    data = [(i, rng.choice(["big"] * 8 + ["mid"] * 3 + ["tiny", None, "other"]), rng.choice([0, 1, 5, 40, 300])) for i in range(1500)]
    data += [(7777, "mid", 40)] * 6  # repeated rows
    targets = [("big", 0.3, 1), ("mid", 0.4, 3), ("tiny", 0.2, 4), ("absent", 0.05, 2), ("never", 0.05, 0), (None, 0.1, 1)]
    df = mixing.hashed(spark.createDataFrame(data, RECORDS)).persist()
    plans = mixing.read_targets(spark.createDataFrame(targets, TARGETS))
    own = df.where(F.col("source").isin([p.source for p in plans]))
    mixing.plan_mixture(own, plans, total)
    records = own.collect()
    size = sum(r["size"] for r in records) if total is None else total
    got = rows(mixing.mix(own, plans))
    assert got == _brute(records, plans, size)
    report = {r["source"]: r for r in mixing.report(plans, spark).collect()}
    used = {s: sum(r[2] * r[3] for r in got if r[1] == s) for s in report}
    assert {s: r["used_tokens"] for s, r in report.items()} == used
    for p in plans:
        assert used[p.source] <= p.budget + 1e-6
        assert report[p.source]["shortfall_tokens"] == pytest.approx(max(0, p.budget - p.available * max(0, p.max_repeats)))
    if size:
        whole = sum(used.values())
        assert sum(r["actual_share"] for r in report.values()) == pytest.approx(1 if whole else 0)


def test_repeats_are_nested(spark):
    """A larger total uses every record at least as often."""
    df = mixing.hashed(spark.range(400).selectExpr("id", "'s' source", "id % 17 size")).persist()
    before = {}
    for total in (100, 900, 3000, 8000, 20_000):
        plans = [mixing.Plan("s", 1.0, 5)]
        mixing.plan_mixture(df, plans, total)
        now = {r["id"]: r["repeats"] for r in mixing.mix(df, plans).collect()}
        assert all(now.get(i, 0) >= n for i, n in before.items())
        before = now
    assert set(before.values()) == {5}


def test_targets(spark):
    for bad in ([("a", 0.5, 1), ("a", 0.5, 1)], [(f"s{i}", 0.1, 1) for i in range(mixing.MAX_SOURCES + 1)]):
        with pytest.raises(ValueError):
            mixing.read_targets(spark.createDataFrame(bad, TARGETS))
    assert mixing.read_targets(spark.createDataFrame([("a", None, 1), (None, 1.0, 1)], TARGETS)) == []


def test_texts_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "one two three", "a", "x"), (2, None, "a", "x"), (3, "", "a", "x"), (4, "four", None, "x"), (None, "five six", "a", "x"), (None, "five six", "a", "x")], "doc_id bigint, text string, source string, size string")
    plans = mixing.read_targets(spark.createDataFrame([("a", 1.0, 1)], TARGETS))
    sized = mixing.sized_records(docs, tokens.with_counts, "doc_id", "text", "source", plans)
    mixing.plan_mixture(sized, plans)
    assert rows(mixing.mix(sized, plans)) == sorted([(1, "a", 3, 1), (2, "a", 0, 1), (3, "a", 0, 1), (None, "a", 2, 1), (None, "a", 2, 1)], key=repr)
    for table, targets in ((docs.limit(0), [("a", 1.0, 1)]), (docs, [])):
        plans = mixing.read_targets(spark.createDataFrame(targets, TARGETS))
        sized = mixing.sized_records(table, tokens.with_counts, "doc_id", "text", "source", plans)
        mixing.plan_mixture(sized, plans)
        assert mixing.mix(sized, plans).count() == 0 and mixing.report(plans, spark).count() == len(targets)


def test_audit_sees_what_is_wrong(spark):
    rng = random.Random(3)
    data = [(i, rng.choice(["big", "big", "mid"]), rng.choice([0, 1, 5, 40])) for i in range(400)]
    targets = spark.createDataFrame([("big", 0.4, 1), ("mid", 0.6, 3), ("absent", 0.0, 2)], TARGETS)
    df = mixing.hashed(spark.createDataFrame(data, RECORDS)).persist()
    plans = mixing.plan_mixture(df, mixing.read_targets(targets))
    mixed = mixing.mix(df, plans).persist()
    good = {r["source"]: tuple(r)[2:] for r in mixing.audit(df, mixed, targets).collect()}
    assert good == {"big": (True,) * 3, "mid": (True,) * 3}
    more = mixed.withColumn("repeats", F.col("repeats") + F.when(F.col("source") == "big", 1).otherwise(0))
    assert not any(next(tuple(r)[2:4] for r in mixing.audit(df, more, targets).collect() if r["source"] == "big"))
    few = mixed.where((F.col("source") != "mid") | (F.col("id") % 3 == 0))
    assert not next(r for r in mixing.audit(df, few, targets).collect() if r["source"] == "mid")["within_budget"]
    odd = mixed.withColumn("repeats", F.when(F.col("id") % 2 == 0, 1).otherwise(0)).where("repeats > 0")
    assert not next(r for r in mixing.audit(df, odd, targets).collect() if r["source"] == "big")["nested"]
