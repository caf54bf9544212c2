"""Mixing sources to target weights, by hash-threshold histograms.

Every record has a size and a hash. For each source its budget is its share of the total. If the source has more than
its budget, the records whose hash is below a threshold are used; if it has less, all are used ``full`` times and those
below a threshold once more, so that the sets of records of all repeats are nested. The threshold is the greatest for
which the records below it do not exceed what is left of the budget.

Thresholds are found without sorting. Sizes are summed by source and by the leading ``BITS`` bits of the hash; the
bucket in which a source's budget is crossed is the only one that is looked at again, by the next bits, until it holds
one hash or no more than one record. Each round is one aggregation that combines before its shuffle and hands the
driver at most (number of sources) * 2**BITS sums; sources are those of the target table, at most ``MAX_SOURCES``. The
records are then filtered by their hash in place.

Records whose source is not in the target table, and those with a null source or share, take no part. Null texts have
size 0. Records that are equal in all of id, source and size share their hash and are used alike, so a threshold may
stay below the budget by the size of such a group. A target share of 0 or max_repeats below 1 uses nothing. A source
without records, or an empty table, is reported with its whole budget as shortfall. A source named twice in the target
table is an error.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweir.functions.columns import ref
from tallyweir.session import cut

BITS = 10
HASH_BITS = 63
MAX_SOURCES = 1000


@dataclass
class Plan:
    source: str
    share: float
    max_repeats: int
    available: int = 0
    records: int = 0
    budget: float = 0.0
    full: int = 0
    rest: float = 0.0  # of the budget, for one more use of some records
    threshold: int = 0  # hashes below it are used once more
    extra: int = 0  # the size of those


def hashed(sized: DataFrame, seed: int = 7) -> DataFrame:
    """Adds ``hash`` in [0, 2**63) to id, source and size."""
    mixed = F.xxhash64(F.lit(seed), F.col("id"), F.col("source"), F.col("size"))
    return sized.withColumn("hash", mixed.bitwiseAND(F.lit((1 << HASH_BITS) - 1)))


def read_targets(targets: DataFrame) -> list[Plan]:
    """The target table on the driver; more than MAX_SOURCES rows are an error."""
    rows = targets.where("source is not null and target_share is not null").select("source", "target_share", "max_repeats").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES or len({r["source"] for r in rows}) < len(rows):
        raise ValueError(f"targets name more than {MAX_SOURCES} sources, or one twice")
    return [Plan(r["source"], float(r["target_share"]), int(r["max_repeats"] or 0)) for r in rows]


def _bounded(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """At most MAX_SOURCES rows, for a broadcast join."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def _histogram(records: DataFrame, shift: int) -> dict[str, dict[int, tuple[int, int]]]:
    """By source and bucket: the sum of sizes and the number of records."""
    bucket = F.shiftright("hash", shift).bitwiseAND(F.lit((1 << BITS) - 1))
    sums = records.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("records"))
    out: dict[str, dict[int, tuple[int, int]]] = {}
    for r in sums.collect():
        out.setdefault(r["source"], {})[r["bucket"]] = (r["size"], r["records"])
    return out


def _cross(plan: Plan, buckets: dict[int, tuple[int, int]], base: int, shift: int) -> bool:
    """Moves the threshold over the buckets that fit; whether the next one is worth splitting."""
    for bucket in sorted(buckets):
        size, records = buckets[bucket]
        plan.threshold = base + (bucket << shift)
        if plan.extra + size > plan.rest:
            return records > 1 and shift > 0
        plan.extra += size
    plan.threshold = base + (1 << (shift + BITS))
    return False


def plan_mixture(records: DataFrame, plans: list[Plan], total: float | None = None) -> list[Plan]:
    """Fills in the plans from the records (source, size, hash). ``total`` is the size of the mixture; by default that
    of all records of the sources in question."""
    shift = HASH_BITS - BITS
    first = _histogram(records, shift)
    for p in plans:
        p.available = sum(s for s, _ in first.get(p.source, {}).values())
        p.records = sum(n for _, n in first.get(p.source, {}).values())
    total = sum(p.available for p in plans) if total is None else total
    pending: dict[str, Plan] = {}
    for p in plans:
        p.budget = p.share * total
        if p.available <= 0 or p.max_repeats < 1 or p.share <= 0:
            continue
        p.full = min(p.max_repeats, int(p.budget // p.available))
        if p.full == p.max_repeats:
            continue
        p.rest = p.budget - p.full * p.available
        if _cross(p, first[p.source], 0, shift):
            pending[p.source] = p
    while pending:
        known = shift
        shift = max(0, shift - BITS)
        prefix = [(p.source, p.threshold >> known) for p in pending.values()]
        edges = _bounded(records.sparkSession, prefix, "source string, prefix bigint")
        inside = records.join(edges, ["source"]).where(F.shiftright("hash", known) == F.col("prefix"))
        mask = (1 << (known - shift)) - 1
        finer = inside.withColumn("bucket", F.shiftright("hash", shift).bitwiseAND(F.lit(mask)))
        buckets: dict[str, dict[int, tuple[int, int]]] = {}
        for r in finer.groupBy("source", "bucket").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("records")).collect():
            buckets.setdefault(r["source"], {})[r["bucket"]] = (r["size"], r["records"])
        pending = {s: p for s, p in pending.items() if _cross(p, buckets[s], p.threshold, shift)}
    return plans


def mix(records: DataFrame, plans: list[Plan]) -> DataFrame:
    """id, source, size and repeats (at least 1) of the records used."""
    # a threshold of 2**63 means all hashes; it is kept as the last one that is used
    rows = [(p.source, p.full, p.threshold - 1) for p in plans if p.full or p.threshold]
    use = _bounded(records.sparkSession, rows, "source string, full int, upto bigint")
    repeats = F.col("full") + F.when(F.col("hash") <= F.col("upto"), 1).otherwise(0)
    return records.join(use, ["source"]).withColumn("repeats", repeats.cast("int")).where("repeats > 0").select("id", "source", "size", "repeats")


def sized_records(df: DataFrame, size, id: str, text: str, source: str, plans: list[Plan], seed: int = 7) -> DataFrame:
    """(id, source, size, hash) of the records of the plans' sources, written once; ``size(df, keep, text, out)`` adds
    the size of the text."""
    own = df.select(ref(id).alias("id"), ref(source).alias("source"), ref(text).alias("text"))
    own = own.where(F.col("source").isin([p.source for p in plans]) if plans else F.lit(False))
    return cut(hashed(size(own, ["id", "source"], "text", "size"), seed))


def report(plans: list[Plan], spark: SparkSession) -> DataFrame:
    """One row per source of the target table: what it has, should give and gives, in size and as a share.

    ``shortfall`` is what the source cannot give of its budget because of its repeat cap; what a threshold leaves out
    because the next record would exceed the budget is no shortfall.
    """
    used = {p.source: p.full * p.available + p.extra for p in plans}
    whole = sum(used.values())
    rows = [
        (p.source, p.share, p.max_repeats, p.records, p.available, p.budget, used[p.source], p.full + (1 if p.extra else 0), used[p.source] / whole if whole else 0.0,
         max(0.0, p.budget - p.available * max(0, p.max_repeats)))
        for p in plans
    ]
    return spark.createDataFrame(
        rows,
        "source string, target_share double, max_repeats int, records bigint, available_tokens bigint, budget_tokens double, "
        "used_tokens bigint, most_repeats int, actual_share double, shortfall_tokens double",
    )


def audit(records: DataFrame, mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """source, records and what must hold of a mixture as large as all records of the targets' sources, worked out from
    the three tables without the plans: ``within_budget`` (no source is over its budget, and one below it is short of less
    than its largest group of equal hashes or has used every record as often as it may), ``capped`` (no record is used
    more than max_repeats times) and ``nested`` (the records of a source are used equally often, or once more below some
    hash). ``targets``: source, target_share, max_repeats."""
    own = records.join(F.broadcast(targets.where("source is not null").limit(MAX_SOURCES + 1)), ["source"])
    uses = own.join(mixed.select("id", "source", "repeats").distinct(), ["id", "source"], "left").withColumn("repeats", F.coalesce("repeats", F.lit(0)))
    alike = uses.groupBy("source", "hash", "repeats", "target_share", "max_repeats").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("records"))
    sums = alike.groupBy("source", "target_share", "max_repeats").agg(
        F.sum("records").alias("records"),
        F.sum("size").alias("available"),
        F.sum(F.col("size") * F.col("repeats")).alias("used"),
        F.max("size").alias("largest"),
        F.max("repeats").alias("most"),
        F.min("repeats").alias("least"),
        F.collect_set("repeats").alias("kinds"),
        F.max(F.struct("repeats", "hash")).alias("last"),  # the greatest hash of those used most
        F.min(F.struct("repeats", "hash")).alias("first"),  # the least of those used least
    )
    total = records.agg(F.sum("size")).scalar()
    budget = F.col("target_share") * total
    full = (F.col("least") == F.greatest(F.col("max_repeats"), F.lit(0))) | (F.col("available") == 0)
    short = budget - F.col("used")
    return sums.select(
        "source",
        "records",
        ((short >= 0) & (full | (short <= F.col("largest")))).alias("within_budget"),
        (F.col("most") <= F.greatest(F.col("max_repeats"), F.lit(0))).alias("capped"),
        ((F.size("kinds") == 1) | ((F.size("kinds") == 2) & (F.col("most") == F.col("least") + 1) & (F.col("last.hash") < F.col("first.hash")))).alias("nested"),
    )
