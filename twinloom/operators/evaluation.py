"""Scores of predictions against references, their summaries, the bootstrap and the promotion gate."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinloom.functions import arrays as A
from twinloom.functions import text as T
from twinloom.operators import quality

def _terms(c: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast("array<string>"))


def _hits(terms: Column, text: Column, fold: bool) -> Column:
    return F.filter(terms, lambda x: F.contains(F.lower(text), F.lower(x)) if fold else F.contains(text, x))


def scored(rows: DataFrame) -> DataFrame:
    """Adds per-case scores to rows of cases with `prediction`. A null prediction counts as an empty one, null lists as empty."""
    p = T.text(F.col("prediction"))
    required, terminology, forbidden, preserve = (_terms(c) for c in ("required_terms", "terminology", "forbidden_terms", "preserve"))
    numbers = T.numbers(F.col("source"))
    with_hits = rows.withColumns(
        {
            "chrf": A.character_fscore(p, F.col("reference")),
            "n_required": F.size(required),
            "hit_required": F.size(_hits(required, p, True)),
            "n_terms": F.size(terminology),
            "hit_terms": F.size(_hits(terminology, p, True)),
            "n_preserve": F.size(preserve),
            "hit_preserve": F.size(_hits(preserve, p, False)),
            "n_numbers": F.size(numbers),
            "hit_numbers": F.size(_hits(numbers, p, False)),
            "missing_required_terms": F.array_sort(F.array_except(required, _hits(required, p, True))),
            "missing_terminology": F.array_sort(F.array_except(terminology, _hits(terminology, p, True))),
            "forbidden_hits": _hits(forbidden, p, True),
            "missing_preserve": F.array_sort(F.array_except(preserve, _hits(preserve, p, False))),
            "missing_numbers": F.array_sort(F.array_except(numbers, _hits(numbers, p, False))),
        }
    )
    judged = quality.assessed(with_hits)
    return judged.withColumn("critical", (F.size("forbidden_hits") > 0) | F.col("has_critical")).withColumnRenamed("codes", "quality_issues")


def summary(rows: DataFrame, *by: str) -> DataFrame:
    """Mean scores, the mean over general cases (null if none), micro-averaged ratios (1 if nothing was due), critical errors."""
    ratios = (("required_accuracy", "required"), ("term_accuracy", "terms"), ("preserve_accuracy", "preserve"), ("number_accuracy", "numbers"))
    return rows.groupBy(*by).agg(
        F.count("*").alias("case_count"),
        F.avg("chrf").alias("chrf"),
        F.avg(F.when(F.col("category") == "general", F.col("chrf"))).alias("simple_chrf"),
        *(A.micro_ratio(F.sum(f"hit_{x}"), F.sum(f"n_{x}")).alias(name) for name, x in ratios),
        F.sum(F.col("critical").cast("int")).alias("critical_errors"),
    )


def paired(candidate: DataFrame, baseline: DataFrame, key: str = "id", score: str = "chrf") -> DataFrame:
    """id, d: score differences of the cases in both reports (joined by id, not by place)."""
    b = baseline.groupBy(key).agg(F.max(score).alias("_b"))
    c = candidate.groupBy(key).agg(F.max(score).alias("_c"))
    return c.join(b, key).select(F.col(key), (F.col("_c") - F.col("_b")).alias("d"))


def unpaired(candidate: DataFrame, baseline: DataFrame, key: str = "id") -> DataFrame:
    """id, only_in: cases that one of the reports lacks."""
    sides = candidate.select(key, F.lit(1).alias("c"), F.lit(0).alias("b")).unionAll(baseline.select(key, F.lit(0), F.lit(1)))
    both = sides.groupBy(key).agg(F.max("c").alias("c"), F.max("b").alias("b"))
    return both.where("c + b = 1").select(key, F.when(F.col("c") == 1, "candidate").otherwise("baseline").alias("only_in"))


#: Paired cases that the exact bootstrap takes to the driver.
MOST_EXACT = 20_000


def bootstrap(differences: DataFrame, samples: int = 2000, seed: int = 2026, key: str = "id") -> DataFrame:
    """mean, ci95_low, ci95_high, exactly as Python's generator draws the cases.

    Drawing with replacement by that generator is sequential, so the draws are made on the driver, for at most
    `MOST_EXACT` cases; more are an error, and `bootstrap_poisson` is the form for any size.
    """
    n = differences.count()
    if not n:
        raise ValueError("bootstrap needs paired cases")
    if n > MOST_EXACT:
        raise ValueError(f"{n} cases are too many for exact draws; use bootstrap_poisson")
    d = [r["d"] for r in differences.orderBy(key).collect()]
    rng = random.Random(seed)
    means = sorted(sum(d[rng.randrange(n)] for _ in range(n)) / n for _ in range(samples))
    row = (sum(d) / n, means[math.floor(samples * 0.025)], means[min(samples - 1, math.floor(samples * 0.975))])
    return differences.sparkSession.createDataFrame([row], "mean double, ci95_low double, ci95_high double")


def bootstrap_poisson(differences: DataFrame, samples: int = 2000, seed: int = 2026, key: str = "id") -> DataFrame:
    """Bootstrap at any size: each case enters each sample a Poisson(1) number of times, derived from a digest of case and sample.

    One partial aggregation per sample; nothing is drawn on the driver.
    """
    digest = F.md5(F.concat_ws("#", F.col(key).cast("string"), F.col("s").cast("string"), F.lit(str(seed))))
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + 0.5) / float(1 << 32)
    cut, p, weight = 0.0, math.exp(-1), F.lit(0)
    for k in range(1, 9):
        cut += p
        weight = weight + (F.col("u") > cut).cast("int")
        p /= k
    draws = differences.select(key, "d", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("s")).withColumn("u", u).withColumn("w", weight)
    means = draws.groupBy("s").agg((F.sum(F.col("w") * F.col("d")) / F.greatest(F.sum("w"), F.lit(1))).alias("m"))
    ranked = F.array_sort(F.collect_list("m"))
    low, high = math.floor(samples * 0.025) + 1, min(samples - 1, math.floor(samples * 0.975)) + 1
    return means.agg(F.element_at(ranked, low).alias("ci95_low"), F.element_at(ranked, high).alias("ci95_high")).crossJoin(differences.agg(F.avg("d").alias("mean"))).select("mean", "ci95_low", "ci95_high")


def gate(candidate: DataFrame, baseline: DataFrame, difference: DataFrame, absolute: bool = True, comet: DataFrame | None = None) -> DataFrame:
    """Checks of a candidate's summary against a baseline's (one row each), with their conjunction.

    `comet` is the bootstrapped difference of learned scores, where both reports have them; it adds two checks.
    """
    c = candidate.select(F.struct("*").alias("c"))
    b = baseline.select(F.struct("*").alias("b"))
    rows = c.crossJoin(b).crossJoin(difference)
    if comet is not None:
        rows = rows.crossJoin(comet.select(F.struct("mean", "ci95_low", "ci95_high").alias("comet")))
    get = F.col
    checks = {
        "critical_errors_not_worse": get("c.critical_errors") <= get("b.critical_errors"),
        "chrf_improved": get("c.chrf") > get("b.chrf"),
        "chrf_statistically_significant": get("ci95_low") > 0,
        "simple_not_regressed": get("c.simple_chrf").isNull() | get("b.simple_chrf").isNull() | (get("c.simple_chrf") >= get("b.simple_chrf") - 0.5),
        "terms_not_regressed": get("c.term_accuracy") >= get("b.term_accuracy"),
        "content_anchors_not_regressed": get("c.required_accuracy") >= get("b.required_accuracy"),
        "numbers_complete": get("c.number_accuracy") >= 1,
        "preserved_tokens_complete": get("c.preserve_accuracy") >= 1,
    }
    if absolute:
        checks |= {"critical_errors_zero": get("c.critical_errors") == 0, "terms_at_least_98_percent": get("c.term_accuracy") >= 0.98}
    if comet is not None:
        checks |= {"comet_improved": get("comet.mean") > 0, "comet_statistically_significant": get("comet.ci95_low") > 0}
    named = F.map_from_arrays(F.array(*map(F.lit, checks)), F.array(*(F.coalesce(x, F.lit(False)) for x in checks.values())))
    return rows.select(named.alias("checks"), "mean", "ci95_low", "ci95_high").withColumn("accepted", F.forall(F.map_values("checks"), lambda x: x))


def loss_gate(losses: DataFrame, most: float, base: str = "base_loss", candidate: str = "candidate_loss") -> DataFrame:
    """Adds change and loss_gate_passed: whether the validation loss grew by no more than allowed. A null loss doesn't pass."""
    return losses.withColumn("change", F.col(candidate) - F.col(base)).withColumn("loss_gate_passed", F.coalesce(F.col("change") <= most, F.lit(False)))


def early_stopping(history: DataFrame, patience: int, least_gain: float, order: str = "step", loss: str = "loss") -> DataFrame:
    """Adds best (so far), bad (steps without a gain so far) and stop to a history of losses."""
    before = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    best = F.min(loss).over(before)
    gain = history.withColumn("gained", best.isNull() | (F.col(loss) < best - least_gain))
    upto = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    last = gain.withColumns({"n": F.row_number().over(Window.orderBy(order))}).withColumn("last_gain", F.max(F.when(F.col("gained"), F.col("n"))).over(upto))
    return last.withColumn("bad", F.col("n") - F.col("last_gain")).withColumn("stop", F.col("bad") >= patience).drop("n", "last_gain")


def load_cases(spark: SparkSession, path: str, direction: str | None = None, split: str | None = None) -> DataFrame:
    """Evaluation cases from JSON lines; filters first, then the checks of what remains."""
    schema = "id string, split string, direction string, category string, source string, reference string, required_terms array<string>, terminology array<string>, forbidden_terms array<string>, preserve array<string>"
    rows = spark.read.schema(schema).json(path).fillna({"split": "test", "category": "general"}).where("id IS NOT NULL OR source IS NOT NULL")
    if direction:
        rows = rows.where(F.col("direction") == direction)
    if split:
        rows = rows.where(F.col("split") == split)
    return require_cases(rows)


def require_cases(cases: DataFrame) -> DataFrame:
    """The cases, if there are any, each with id, direction, source and reference, and no id twice; else an error."""
    empty = F.coalesce(F.col("source") == "", F.lit(True)) | F.coalesce(F.col("reference") == "", F.lit(True))
    found = cases.agg(F.count("*").alias("n"), F.count_if(F.col("id").isNull() | F.col("direction").isNull()).alias("unnamed"), F.count_if(empty).alias("empty")).first()
    if not found["n"]:
        raise ValueError("no case matches")
    if found["unnamed"] or found["empty"]:
        raise ValueError(f"{found['unnamed']} cases lack id or direction, {found['empty']} source or reference")
    if not cases.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        raise ValueError("ids of cases occur more than once")
    return cases


def case_problems(cases: DataFrame) -> DataFrame:
    """id, problem: empty source or reference, and ids that occur more than once."""
    empty = cases.where((F.trim(T.text(F.col("source"))) == "") | (F.trim(T.text(F.col("reference"))) == "")).select("id", F.lit("empty_text").alias("problem"))
    twice = cases.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("duplicate_id").alias("problem"))
    return empty.unionByName(twice)
