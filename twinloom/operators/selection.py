"""Weighted selection from pools with domain caps: quotas first, then round after round over the pools.

Whether a row is taken depends on what earlier pools took, so the pools are a driver loop (a handful), and each step
is distributed: pairs already taken are removed by an anti join, capped domains are cut at the rank of their last row
with room, the quota at the rank of its last row (`nth_least`; no ordered limit gathers the rows). Rows travel as
(pair key, domain, rank) only.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinloom.operators.corpus import nth_least, rank_number, shuffled_rank


def cap_of(total: int, fraction: float) -> int:
    return max(1, round(total * fraction))


def domain_allowed(count: Column, total: int, fraction: float) -> Column:
    """Whether a domain that was taken `count` times may be taken once more (banker's rounding)."""
    return count < F.greatest(F.lit(1), F.bround(F.lit(total * fraction)).cast("int"))


def least(rows: DataFrame, n: int) -> DataFrame:
    """The n rows of least rank: all up to the n-th, found by histograms of the ranks."""
    if n < 1:
        return rows.limit(0)
    last = nth_least(rows, "number", n)
    return rows if last is None else rows.where(F.col("number") <= last)


def take(pool: DataFrame, quota: int, room: dict[str, int]) -> DataFrame:
    """The first `quota` rows of a pool in rank order whose domain has room."""
    open_to = F.lit(True)
    for d, n in room.items():
        last = nth_least(pool.where(F.col("domain") == d), "number", n) if n > 0 else -1
        if last is not None:
            open_to = open_to & ((F.col("domain") != d) | (F.col("number") <= last))
    return least(pool.where(open_to), quota)


def _rounds(need: int, room: dict[str, int]):
    """Round after round, each pool in turn gives its next row that is new and whose domain has room."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, taken, picked = dict(room), set(), []
        queues = [iter(g.sort_values("rank").itertuples()) for _, g in pdf.groupby("pool_no", sort=True)]
        while queues and len(picked) < need:
            alive = []
            for q in queues:
                for row in q:
                    if row.key in taken or left.get(row.domain, 1) <= 0:
                        continue
                    taken.add(row.key)
                    if row.domain in left:
                        left[row.domain] -= 1
                    picked.append(row.Index)
                    alive.append(q)
                    break
                if len(picked) >= need:
                    break
            queues = alive
        return pdf.loc[picked].drop(columns=["pool_no", "_all"])

    return run


def select(pools: list[tuple[str, float, DataFrame]], total: int, caps: dict[str, float], seed: int, keep) -> DataFrame:
    """pools: name, weight, rows with `key` and `domain`. Returns key, domain, pool, phase (quota or fill).

    `keep` makes a step's result durable (a checkpoint) before the next step reads it.
    """
    weights = sum(w for _, w, _ in pools) or float(len(pools))
    ranked = [(name, w, rows.select("key", "domain").dropDuplicates(["key"]).withColumn("rank", shuffled_rank(F.col("key"), seed)).withColumn("number", rank_number(F.col("rank"))).withColumn("pool", F.lit(name))) for name, w, rows in pools]
    room = {d: cap_of(total, f) for d, f in caps.items()}
    chosen, last = None, {}

    def reduce_room(taken: DataFrame) -> int:
        n = 0
        for r in taken.groupBy("domain").agg(F.count("*").alias("n")).collect():  # a row per domain
            n += r["n"]
            if r["domain"] in room:
                room[r["domain"]] -= r["n"]
        return n

    size = 0
    for name, weight, rows in ranked:
        quota = max(1, round(total * weight / weights))
        fresh = keep(rows if chosen is None else rows.join(chosen.select("key"), "key", "left_anti"))
        got = keep(take(fresh, quota, dict(room)).withColumn("phase", F.lit("quota")))
        n = reduce_room(got)
        size += n
        # the scan of a pool goes on where its quota stopped; an unfilled quota has seen the whole pool
        last[name] = got.agg(F.max("rank")).first()[0] if n == quota else "g"
        chosen = got if chosen is None else chosen.unionByName(got)
    if size < total:
        rest = None
        for i, (name, _, rows) in enumerate(ranked):
            part = rows.where(F.col("rank") > F.lit(last[name] or "")).withColumn("pool_no", F.lit(i))
            rest = part if rest is None else rest.unionByName(part)
        need = total - size
        rest = keep(rest.join(chosen.select("key"), "key", "left_anti"))
        # a pool's turns never reach beyond need rows taken and need skipped as taken by others, besides rows of domains
        # without room; a capped domain has room for what is left of its cap, and as many are skipped as taken by others
        front = None
        for i in range(len(ranked)):
            part = take(rest.where(F.col("pool_no") == i), 2 * need + sum(n + need for n in room.values()), {d: n + need for d, n in room.items()})
            front = part if front is None else front.unionByName(part)
        # turns depend on each other; the rows that can matter are bounded by the size of the selection, a parameter
        fill = keep(front.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(_rounds(need, dict(room)), front.drop("pool_no").schema).select("key", "domain", "rank", "number", "pool", F.lit("fill").alias("phase")))
        chosen = chosen.unionByName(fill)
    return chosen.select("key", "domain", "pool", "phase")
