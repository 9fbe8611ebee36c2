"""A mixture of sources with given shares of all tokens (problem 6).

Texts are counted in tokens of a public tokenizer; equal texts are one text (of its smallest document's source). The
mixture has `total` tokens if that is given: a source gives its share of it or, if that is less, all it may (max_repeats
times its tokens), and the report shows the shares that come of it. Without a total the mixture is as large as the
repeat limits allow with every source at its share: the least max_repeats * n / w over sources with share w and n
tokens. Each text of a source is used
floor(r) times and once more with probability r - floor(r), where r is what the source needs over what it has. Which
texts are used once more is drawn by the cube method: a random walk in the null space of the balancing constraints
(number of texts and number of tokens) that ends with nearly all probabilities at 0 or 1 while both totals hold; the
few texts left over in each block walk on together, level by level, until a source has one block, and its last two
texts land by the smaller error. Texts whose r is whole never enter a walk.

Sources without documents can't have a share: theirs is reported as 0 and the weights of the others are scaled up.
Documents without source, of sources without a weight, or with null or blank text are not used.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinloom.llm import _codes as K

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: How the tokenizer cuts a text before merging: the public pattern of its family (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK = 4096
LEVELS = 20  # a level leaves at most two of BLOCK texts open, so this many do for BLOCK / 2 to that power
SEED = 20


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, source, h1, h2 (of the text), n_tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoding(tokenizer).encode_ordinary
        for pdf in batches:
            pdf["n_tokens"] = [len(encode(t)) for t in pdf.pop("text")]
            yield pdf

    return docs.select("doc_id", "source", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("b"), "text").alias("h2"), "text").mapInPandas(run, "doc_id long, source string, h1 long, h2 long, n_tokens long")


def unique_texts(counted: DataFrame) -> DataFrame:
    """doc_id, source, n_tokens: one row per text, that of its smallest document. Grouped with partial aggregation."""
    first = counted.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "source", "n_tokens")).alias("m")).select("m.*")
    return first.where("n_tokens > 0")


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Moves the probabilities through the null space of (count, size) until at most two lie between 0 and 1."""
    p = p.astype(float).copy()
    open_at = [int(i) for i in np.flatnonzero((p > 1e-9) & (p < 1 - 1e-9))]
    rng.shuffle(open_at)
    draws = iter(rng.random(len(open_at) + 8))
    trio: list[int] = []
    while True:
        while len(trio) < 3 and open_at:
            trio.append(open_at.pop())
        if len(trio) < 3:
            return p
        a, b, c = trio
        # (1, 1, 1) x (s_a, s_b, s_c): keeps both the number of texts and of tokens
        u = (float(size[c] - size[b]), float(size[a] - size[c]), float(size[b] - size[a]))
        if u == (0.0, 0.0, 0.0):
            u = (1.0, -1.0, 0.0)
        up = min((1 - p[i]) / x if x > 0 else p[i] / -x for i, x in zip(trio, u, strict=True) if x)
        down = min(p[i] / x if x > 0 else (1 - p[i]) / -x for i, x in zip(trio, u, strict=True) if x)
        step = up if next(draws, 0.5) * (up + down) < down else -down
        rest = []
        for i, x in zip(trio, u, strict=True):
            v = p[i] + step * x
            p[i] = 0.0 if v < 1e-9 else 1.0 if v > 1 - 1e-9 else v
            if 0 < p[i] < 1:
                rest.append(i)
        trio = rest if len(rest) < 3 else rest[:2]
        open_at += rest[2:] if len(rest) == 3 else []


def landing(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Settles the last (at most two) texts so that the tokens come closest to what was due."""
    left = np.flatnonzero((p > 0) & (p < 1))
    due = float((p[left] * size[left]).sum())
    options = [np.array([(k >> b) & 1 for b in range(len(left))], float) for k in range(1 << len(left))]
    best = min(options, key=lambda o: abs(float((o * size[left]).sum()) - due)) if len(left) else np.zeros(0)
    p = p.copy()
    p[left] = best
    return p


def _walk(rows: DataFrame) -> DataFrame:
    """One level: a walk in each (source, block); sources with a single block also land."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id", kind="stable")
        rng = np.random.default_rng([SEED, int(pdf["level"].iloc[0]), int(pdf["block"].iloc[0])])
        p, size = pdf["p"].to_numpy(), pdf["n_tokens"].to_numpy()
        p = flight(p, size, rng)
        return pdf.assign(p=landing(p, size) if int(pdf["n_blocks"].iloc[0]) == 1 else p)

    return rows.groupBy("source", "block").applyInPandas(run, rows.schema)


def plan(counted: list, sources: list, total: float | None = None) -> dict[str, dict]:
    """Per source of the mixture: share, tokens it has and needs, and how often each text is used (r)."""
    has = {r["source"]: (r["n"], r["tokens"]) for r in counted}
    usable = [s for s in sources if s["source"] in has and (s["weight"] or 0) > 0 and (s["max_repeats"] or 0) > 0]
    whole = sum(s["weight"] for s in usable)
    if not usable:
        return {}
    if total is None:
        total = min(s["max_repeats"] * has[s["source"]][1] * whole / s["weight"] for s in usable)
    return {s["source"]: {"share": s["weight"] / whole, "n": has[s["source"]][0], "r": min(float(s["max_repeats"]), total * s["weight"] / whole / has[s["source"]][1])} for s in usable}


def mixture(docs: DataFrame, sources: DataFrame, tokenizer: str = TOKENIZER, total: float | None = None) -> DataFrame:
    """doc_id, source, n_tokens, repeats of each chosen text."""
    spark = docs.sparkSession
    named = sources.groupBy("source").agg(F.max("weight").alias("weight"), F.min("max_repeats").alias("max_repeats")).where("source IS NOT NULL")
    used = docs.where(F.col("text").rlike("\\S")).join(named.select("source"), "source", "left_semi")
    texts = K.keep(unique_texts(count_tokens(used, tokenizer)))
    # a row per source of the mixture's table, which is a parameter of the job
    shares = plan(texts.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("tokens")).collect(), named.collect(), total)
    if not shares:
        return spark.createDataFrame([], "doc_id long, source string, n_tokens long, repeats int")
    times = F.coalesce(*(F.when(F.col("source") == s, F.lit(float(x["r"]))) for s, x in shares.items()))
    texts = texts.withColumn("r", F.round(times, 9)).where("r IS NOT NULL").withColumn("base", F.floor("r").cast("int")).withColumn("p", F.col("r") - F.floor("r")).drop("r")

    def settled(rows: DataFrame) -> DataFrame:
        return rows.where("p = 0 OR p = 1").select("doc_id", "source", "n_tokens", (F.col("base") + F.col("p").cast("int")).alias("repeats"))

    done, rows = settled(texts), texts.where("p > 0 AND p < 1")
    size = {s: x["n"] for s, x in shares.items()}
    for level in range(LEVELS):
        blocks = {s: max(1, -(-n // BLOCK)) for s, n in size.items()}
        n_blocks = F.coalesce(*(F.when(F.col("source") == s, F.lit(b)) for s, b in blocks.items()))
        rows = rows.withColumn("level", F.lit(level)).withColumn("n_blocks", n_blocks).withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(level)), F.col("n_blocks").cast("long")).cast("int"))
        rows = K.keep(_walk(rows))
        done = done.unionAll(settled(rows))
        if all(b == 1 for b in blocks.values()):
            return done.where("repeats > 0")
        rows = rows.where("p > 0 AND p < 1").select("doc_id", "source", "n_tokens", "base", "p")
        size = {s: 0 for s in size} | {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.count("*").alias("n")).collect()}
    raise RuntimeError(f"texts are still open after {LEVELS} levels")


def shares(chosen: DataFrame, sources: DataFrame) -> DataFrame:
    """Per source of the table: its weight, the share it was to have and the one it has, texts and tokens."""
    named = sources.groupBy("source").agg(F.max("weight").alias("weight")).where("source IS NOT NULL")
    got = chosen.groupBy("source").agg(F.count("*").alias("n_texts"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most_repeats"))
    rows = named.join(got, "source", "left").fillna(0, ["n_texts", "tokens", "most_repeats"])
    total = rows.agg(F.sum("tokens").alias("all_tokens"), F.sum(F.when(F.col("tokens") > 0, F.col("weight"))).alias("all_weight"))
    return rows.crossJoin(F.broadcast(total)).select("source", "weight", F.round(F.when(F.col("tokens") > 0, F.col("weight") / F.col("all_weight")).otherwise(0.0), 4).alias("target_share"), F.round(F.col("tokens") / F.col("all_tokens"), 4).alias("actual_share"), "n_texts", "tokens", "most_repeats")


def chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/dataset_sources.parquet"))


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares(chosen(spark, sf_dir), spark.read.parquet(f"{sf_dir}/dataset_sources.parquet"))
