"""Corpus preparation: pairs from any accepted shape, reasons, first-wins deduplication, counts, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

from twinloom.functions import text as T
from twinloom.operators import filters

ALIASES = {"zh": ("zh_CN", "zh", "zh-CN"), "en": ("en_GB", "en", "en-US")}


def side(pairs: DataFrame, column: str, language: str) -> Column:
    """The first non-empty of a struct's fields that may hold a language; null if it has none of them."""
    struct = pairs.schema[column].dataType
    if not isinstance(struct, t.StructType):
        raise ValueError(f"{column} must be a struct")
    present = [F.nullif(F.col(column)[name], F.lit("")) for name in ALIASES[language] if name in struct.fieldNames()]
    return F.coalesce(*present) if present else F.lit(None).cast("string")


def require(frame: DataFrame, *columns: str) -> DataFrame:
    missing = [c for c in columns if c not in frame.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return frame


def clean_pairs(pairs: DataFrame, column: str = "translation", full: bool = False) -> DataFrame:
    """Adds `zh` and `en`: squeezed, or fully normalised (entities, NFKC) if `full`."""
    require(pairs, column)
    clean = T.normalise if full else T.squeeze
    return pairs.withColumns({"zh": clean(side(pairs, column, "zh")), "en": clean(side(pairs, column, "en"))})


def first_of(pairs: DataFrame, key: Column, order: str) -> DataFrame:
    """Adds `is_first`: whether the row is the first of its key. Null keys are first of nothing.

    The least order per key comes from a partial aggregation and is joined back, so a key with many rows never
    gathers in a window; in the join, which has one row of each key on its other side, adaptive execution splits the
    partition of such a key.
    """
    # rows without a key get one of their own: no hot null key, and no null test to be pushed below the rules, where
    # it would evaluate them again
    keyed = pairs.withColumn("_key", key).withColumn("_own", F.coalesce("_key", F.concat(F.lit("#"), F.col(order).cast("string")), F.lit("#")))
    least = keyed.groupBy("_own").agg(F.min(order).alias("_least"))
    return keyed.join(least, "_own", "left").withColumn("is_first", F.col("_key").isNotNull() & F.coalesce(F.col(order) == F.col("_least"), F.lit(False))).drop("_key", "_own", "_least")


def judged(pairs: DataFrame, order: str, reason: Column, key: Column) -> DataFrame:
    """Adds `reason`: the rule against a pair, else `duplicate` for all but the first of equal accepted pairs, else null."""
    with_reason = pairs.withColumn("_reason", reason)
    accepted = F.when(F.col("_reason").isNull(), key)
    return first_of(with_reason, accepted, order).withColumn("reason", F.when(F.col("_reason").isNotNull(), F.col("_reason")).when(~F.col("is_first"), "duplicate")).drop("_reason", "is_first")


def histogram(rows: DataFrame, *by: str, reason: str = "reason") -> DataFrame:
    return rows.groupBy(*by, F.coalesce(reason, F.lit("accepted")).alias(reason)).agg(F.count("*").alias("n"))


def totals(rows: DataFrame, *by: str) -> DataFrame:
    """scanned = accepted + rejected."""
    return rows.groupBy(*by).agg(F.count("*").alias("scanned"), F.count_if(F.col("reason").isNull()).alias("accepted"), F.count_if(F.col("reason").isNotNull()).alias("rejected"))


#: Buckets of a histogram that finds the n-th least value, and from how many rows on a bucket is cut again.
BUCKETS, SETTLED = 4096, 100_000


def nth_least(rows: DataFrame, value: str, n: int):
    """The n-th least of a long column, or None if there are fewer values. Nulls don't count.

    Histograms with partial counts narrow the range until few rows are left in it; only those are ordered, so nothing
    that grows with n gathers in a task.
    """
    if n < 1:
        return None
    low, high, have = rows.agg(F.min(value), F.max(value), F.count(value)).first()
    if have < n:
        return None
    while have > SETTLED and low < high:
        width = -(-(high - low + 1) // BUCKETS)
        bucket = F.floor((F.col(value) - F.lit(low)) / width).cast("long")
        counts = sorted((r["b"], r["k"]) for r in rows.where(F.col(value).between(low, high)).groupBy(bucket.alias("b")).agg(F.count("*").alias("k")).collect())  # at most BUCKETS rows
        for b, k in counts:
            if n <= k:
                low, high, have = low + b * width, min(high, low + (b + 1) * width - 1), k
                break
            n -= k
    if low == high:
        return low
    # at most SETTLED rows are in the range
    return rows.where(F.col(value).between(low, high)).select(value).orderBy(value).limit(n).agg(F.max(value)).first()[0]


def until_accepted(rows: DataFrame, order: str, target: int) -> DataFrame:
    """What a scan that stops at the target-th accepted row has seen; all rows if it never stops. `order` is a long column."""
    if target < 1:
        return rows.limit(0)
    stop = nth_least(rows.where("reason IS NULL"), order, target)
    return rows if stop is None else rows.where(F.col(order) <= stop)


def take_until(rows: DataFrame, order: str, target: int) -> DataFrame:
    """As `until_accepted`, but a scan that can't reach the target is an error."""
    if nth_least(rows.where("reason IS NULL"), order, target) is None:
        raise ValueError(f"fewer than {target} accepted rows")
    return until_accepted(rows, order, target)


def not_in(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among the known ones (a corpus that is added to another)."""
    return rows.join(known.select(key).distinct(), key, "left_anti")


def concatenate(*corpora: DataFrame) -> DataFrame:
    """Corpora one after the other, with `corpus_no` to keep their order."""
    out = None
    for i, c in enumerate(corpora):
        part = c.withColumn("corpus_no", F.lit(i))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def shuffled_rank(key: Column, seed: int) -> Column:
    """A fixed random order: by the digest of key and seed. Reproducible on any cluster and in any engine."""
    return F.md5(F.concat(key, F.lit(f"#{seed}")))


def rank_number(rank: Column) -> Column:
    """The first 60 bits of a digest as a number, in the digest's order."""
    return F.conv(F.substring(rank, 1, 15), 16, 10).cast("long")


def split(pairs: DataFrame, key: Column, validation: int, total: int, seed: int) -> DataFrame:
    """Adds `part`: validation for the first rows in random order, train up to the total; the others are left out.

    Two thresholds on the rank, so no task sees more than its own rows. Keys are distinct; rows of equal keys stay together.
    """
    ranked = pairs.withColumn("_rank", rank_number(shuffled_rank(key, seed)))
    last, held = (nth_least(ranked, "_rank", n) for n in (total, validation))
    kept = ranked if last is None else ranked.where(F.col("_rank") <= last)
    is_held = F.lit(validation > 0) if held is None else F.col("_rank") <= held
    return kept.withColumn("part", F.when(is_held, "validation").otherwise("train")).drop("_rank")


def fraction_split(pairs: DataFrame, key: Column, fraction: float, seed: int) -> DataFrame:
    """Adds `part` by a digest of the key: stable under repartitioning and under added rows."""
    bucket = F.conv(F.substring(shuffled_rank(key, seed), 1, 8), 16, 10).cast("long") / float(1 << 32)
    return pairs.withColumn("part", F.when(bucket < fraction, "train").otherwise("test"))


def metadata(rows: DataFrame, **details: str | int | float) -> DataFrame:
    """One JSON document with counts and the sorted histogram of reasons, and what else is to be stated (sources, seed, time)."""
    counts = histogram(rows)
    stated = [F.lit(v).alias(k) for k, v in details.items()]
    return counts.agg(F.to_json(F.struct(F.sum("n").alias("scanned"), F.sum(F.when(F.col("reason") == "accepted", F.col("n")).otherwise(0)).alias("accepted"), F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("reason") != "accepted", F.struct("reason", "n"))))).alias("rejections"), *stated)).alias("metadata"))


def source_statistics(rows: DataFrame, by: str) -> DataFrame:
    """Per source: rows, accepted ones, and the sorted histogram of reasons as JSON. Two aggregations with partial counts."""
    counts = histogram(rows, by)
    refused = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("reason") != "accepted", F.struct("reason", "n")))))
    return counts.groupBy(by).agg(F.sum("n").alias("n_rows"), F.sum(F.when(F.col("reason") == "accepted", F.col("n")).otherwise(0)).alias("accepted"), F.to_json(refused).alias("rejected"))
