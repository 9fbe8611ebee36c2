"""Reading level of each document (problem 7).

For each level of the rating scale an interpolated character n-gram model (orders 1, 2, 3 and 5; hashed) is trained on
the rated documents; the weights of its orders are estimated on held-out sentences (expectation maximisation). The
surprisals of a sentence under the models say at which level it is least surprising (its difficulty, a mean over the
levels). A document's distribution of difficulties, weighted by letters and over its whole text, is summed up by its
median, for a document is as demanding as most of its text; an isotonic regression (pool adjacent violators) on the
rated documents maps the median to the raters' scale, and that mapped level alone decides. Rated documents mix levels,
so their sentences are first judged by models of the other folds and then train the model of the level they were judged
to have.

Every rated document bears on the models, the weights and the map, whole: n-grams are counted where the documents are
and the counts summed bucket by bucket, so what reaches the driver is of fixed size. Every document is scored whole. Null
and blank texts have no level, those without letters neither. Without ratings all levels are null. Ties between raters
count by their mean; null ratings don't.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinloom.llm import _codes as K
from twinloom.llm import language as L

LEVELS = (1, 2, 3, 4, 5)
ORDERS, BITS = (1, 2, 3, 5), 18
MASK = (1 << BITS) - 1
#: Weights of the orders where nothing is held out; the last is that of the uniform distribution over UNIFORM characters.
WEIGHTS, UNIFORM = (0.02, 0.08, 0.3, 0.59, 0.01), 1e-3
#: Parts of the rated documents, by a hash of their id: each is judged by models of the others.
FOLDS = 4
TOP = max(ORDERS)
#: Characters after which a task passes its counts on, and buckets in one row of them.
FLUSH, CELL = 1 << 28, 1 << 10
HARD = 3.5
READ = ("en", "zh")  # languages with a reading level


@dataclass(frozen=True)
class ReadingModel:
    """tables: per order, bucket of an n-gram -> weight times p(last character | the others) for each level."""

    tables: dict[int, np.ndarray]
    floor: float  # the uniform distribution's part of a probability
    knots: np.ndarray  # of the isotonic map: median difficulty -> raters' scale
    values: np.ndarray
    language: L.LanguageModel


def _prepare(texts: list[str]):
    """Codes with digits folded, sentence starts, owners, letters."""
    codes, starts = K.encode([t.lower() for t in texts], pad=5)
    at = K.sentence_starts(codes, starts)
    kind = K.kind_of(codes)
    letters = K.unit_counts((kind >= K.LETTER) & (kind <= K.HANGUL), at)
    owner = np.searchsorted(starts, at, "right") - 1
    codes = np.where(kind == K.DIGIT, np.uint32(0x30), np.where((kind < K.LETTER) & (codes != K.SEP), np.uint32(32), codes))
    return codes, at, owner, letters


def surprisals(codes: np.ndarray, at: np.ndarray, tables: dict[int, np.ndarray], floor: float) -> np.ndarray:
    """Nats of each sentence under each level's model."""
    width = tables[1].shape[1]
    out = np.zeros((len(at), width))
    top = max(ORDERS) - 1
    for low in range(0, len(codes), K.STEP):
        high = min(len(codes), low + K.STEP)
        begin = max(0, low - top)
        acc = np.full((high - low, width), floor, np.float32)
        for n, idx in K.ngram_buckets(codes[begin:high], ORDERS, BITS):
            # the n-gram that starts at begin + i predicts the character at begin + i + n - 1
            skip = max(0, low - begin - (n - 1))
            idx = idx[skip:]
            first = begin + skip + n - 1 - low
            acc[first : first + len(idx)] += tables[n][idx]
        K.add_by_unit(out, -np.log(acc), at, low, high)
    return out


class _Tally:
    """Counts of the n-grams of some sentences by bucket, per fold and level; each stands at its last character.

    parts: of each bucket of order 2, 3 and 5 the buckets of the shorter n-grams that its n-gram is made of (where several
    share a bucket, the greatest of all, so that no order of rows matters).
    """

    def __init__(self) -> None:
        self.counts = {n: np.zeros(FOLDS * len(LEVELS) << BITS, np.uint32) for n in range(1, TOP + 1)}
        self.parts = {n: np.full(1 << BITS, -1, np.int64) for n in ORDERS[1:]}
        self.size = 0

    def add(self, codes: np.ndarray, at: np.ndarray, group: np.ndarray) -> None:
        """group: fold and level of each sentence. Sentences stand alone, with separators around them."""
        size = np.diff(np.append(at, len(codes)))
        glued = np.full(len(codes) + TOP * (len(at) + 1), K.SEP, np.uint32)
        glued[np.arange(len(codes)) + np.repeat(TOP * np.arange(1, len(at) + 1), size)] = codes
        own = np.repeat(group.astype(np.int64) << BITS, size + TOP)  # from the first sentence on, with the separators after it
        for low in range(TOP, len(glued), K.STEP):
            high = min(len(glued), low + K.STEP)
            # of each order the n-grams that end at low - 1, low, ...
            ends = {n: idx[TOP - n :].astype(np.int64) for n, idx in K.ngram_buckets(glued[low - TOP : high], range(1, TOP + 1), BITS)}
            for n, idx in ends.items():
                np.add.at(self.counts[n], own[low - TOP : high - TOP] + idx[1:], np.uint32(1))
            np.maximum.at(self.parts[2], ends[2][1:], ends[1][:-1] << BITS | ends[1][1:])
            np.maximum.at(self.parts[3], ends[3][1:], ends[2][:-1])
            np.maximum.at(self.parts[5], ends[5][1:], ends[4][:-1] << 2 * BITS | ends[3][1:] << BITS | ends[2][1:])
        self.size += len(codes)

    def rows(self) -> Iterator[pd.DataFrame]:
        """slot, cell, data: of each order, fold and level the counts; under minus the order the parts; CELL buckets a row."""
        for n, counts in self.counts.items():
            yield _cells(np.flatnonzero(counts), counts, n * FOLDS * len(LEVELS))
        for n, parts in self.parts.items():
            yield _cells(np.flatnonzero(parts >= 0), parts, -n)


def _cells(at: np.ndarray, values: np.ndarray, slot: int) -> pd.DataFrame:
    cell = at // CELL
    cuts = np.append(0, np.flatnonzero(np.diff(cell)) + 1) if len(at) else at
    ends = np.append(cuts[1:], len(at))
    place, value = (at % CELL).astype("<u2"), values[at].astype("<i8")
    data = [place[i:j].tobytes() + value[i:j].tobytes() for i, j in zip(cuts, ends, strict=True)] if len(at) else []
    return pd.DataFrame({"slot": (slot + (cell[cuts] * CELL >> BITS)).astype(np.int32), "cell": (cell[cuts] % ((1 << BITS) // CELL)).astype(np.int32), "data": data})


@dataclass(frozen=True)
class _Counts:
    """What the tallies of all tasks sum up to, compressed by slot."""

    slots: dict[int, bytes]

    @staticmethod
    def of(rows: DataFrame) -> _Counts:
        def unite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            dense: dict[int, np.ndarray] = {}
            for pdf in batches:
                for slot, cell, data in zip(pdf["slot"].tolist(), pdf["cell"].tolist(), pdf["data"], strict=True):
                    if slot not in dense:
                        dense[slot] = np.full(1 << BITS, 0 if slot > 0 else -1, np.int64)
                    n = len(data) // 10
                    at = cell * CELL + np.frombuffer(data, "<u2", n).astype(np.int64)
                    value = np.frombuffer(data, "<i8", n, 2 * n)
                    dense[slot][at] = dense[slot][at] + value if slot > 0 else np.maximum(dense[slot][at], value)
            for slot, values in dense.items():
                yield pd.DataFrame({"slot": [slot], "data": [zlib.compress(values.tobytes(), 1)]})

        # at most 5 * FOLDS * levels + 3 slots of 2**BITS buckets, whatever the data
        return _Counts({r["slot"]: r["data"] for r in rows.repartition("slot").mapInPandas(unite, "slot int, data binary").collect()})

    def count(self, n: int) -> np.ndarray:
        """Counts of an order: fold, level, bucket."""
        out = np.zeros((FOLDS * len(LEVELS), 1 << BITS), np.int64)
        for k in range(len(out)):
            if data := self.slots.get(n * len(out) + k):
                out[k] = np.frombuffer(zlib.decompress(data), np.int64)
        return out.reshape(FOLDS, len(LEVELS), 1 << BITS)

    def parts(self, n: int) -> np.ndarray:
        return np.maximum(np.frombuffer(zlib.decompress(self.slots[-n]), np.int64), 0)

    def choices(self, without: Iterable[int | None]) -> list[np.ndarray]:
        """For each fold to leave out (None: none) the folds that models are trained on; all where the others are empty."""
        size = self.count(1).sum((1, 2))
        folds = np.arange(FOLDS)
        return [others if size[others := folds != f].any() else folds >= 0 for f in without]

    def shares(self, chosen: list[np.ndarray]) -> list[dict[int, np.ndarray]]:
        """Of each choice of folds, per order: bucket of an n-gram -> p(last character | the others) for each level."""
        out: list[dict[int, np.ndarray]] = [{} for _ in chosen]
        for n in ORDERS:
            count = self.count(n)
            context = self.count(n - 1) if n > 1 else None
            before = self.parts(n) >> {2: BITS, 3: 0, 5: 2 * BITS}[n] if n > 1 else None
            for tables, own in zip(out, chosen, strict=True):
                mine = count[own].sum(0)
                whole = mine.sum(1, keepdims=True) if context is None else context[own].sum(0)[:, before]
                tables[n] = np.ascontiguousarray(np.minimum(mine / np.maximum(whole, 1), 1).T, np.float32)
        return out


def interpolation(counts: _Counts, shares: list[dict[int, np.ndarray]], rounds: int = 20) -> np.ndarray:
    """Weights of the orders and of the uniform distribution, by expectation maximisation on every character of every fold,
    held out from the models of the others (their shares)."""
    size = counts.count(1).sum((1, 2))
    if np.count_nonzero(size) < 2:
        return np.array(WEIGHTS)
    separator = next(K.ngram_buckets(np.array([K.SEP], np.uint32), (1,), BITS))[1][0]
    seconds, fives = counts.parts(2), counts.parts(5)
    held = []
    for count, own in zip(counts.count(TOP), shares, strict=True):
        level, five = np.nonzero(count)
        three, two = fives[five] >> BITS & MASK, fives[five] & MASK
        one = seconds[two] & MASK
        p = np.stack([*(own[n][idx, level] for n, idx in zip(ORDERS, (one, two, three, five), strict=True)), np.full(len(one), UNIFORM, np.float32)])
        held.append((p, np.where(one != separator, count[level, five], 0)))  # the separators are no text
    number = sum(int(n.sum()) for _, n in held)
    weights = np.full(len(WEIGHTS), 1 / len(WEIGHTS))
    for _ in range(rounds if number else 0):
        parts = (weights[:, None] * p for p, _ in held)
        weights = sum((part / part.sum(0)) @ n for part, (_, n) in zip(parts, held, strict=True)) / number
    return weights if number else np.array(WEIGHTS)


def _posterior(nats: np.ndarray, present: np.ndarray, prior: np.ndarray | None = None) -> np.ndarray:
    score = np.where(present, -nats, -np.inf) + (0 if prior is None else prior)
    e = np.exp(score - score.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _pool(blocks: Iterable[Iterable[float]]) -> list[list[float]]:
    """Pools adjacent violators among blocks (first x, last x, sum of y, number) in order of x."""
    out: list[list[float]] = []
    for block in blocks:
        out.append(list(block))
        while len(out) > 1 and out[-2][2] / out[-2][3] >= out[-1][2] / out[-1][3]:
            low, high = out[-2], out.pop()
            out[-1] = [low[0], high[1], low[2] + high[2], low[3] + high[3]]
    return out


def _curve(blocks: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([v for b in blocks for v in b[:2]]), np.repeat([b[2] / b[3] for b in blocks], 2)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; the knots and values of the non-decreasing least-squares fit (equal x are pooled)."""
    order = np.lexsort((-y, x))
    return _curve(_pool((xi, xi, yi, 1.0) for xi, yi in zip(x[order], y[order], strict=True)))


def isotonic_of(points: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """`isotonic` of kept columns x and y: what violates within a range of x is pooled where it is, as it would be among all."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks: list[list[float]] = []
        for pdf in batches:
            blocks = _pool(chain(blocks, ((x, x, y, 1.0) for x, y in zip(pdf["x"], pdf["y"], strict=True))))
        yield pd.DataFrame(blocks, columns=["low", "high", "total", "n"], dtype=float)

    rows = points.select("x", "y").repartitionByRange("x").sortWithinPartitions("x", F.desc("y")).mapInPandas(run, "low double, high double, total double, n double").collect()
    return _curve(_pool(sorted(map(tuple, rows))))


def document_quantile(owner: np.ndarray, value: np.ndarray, letters: np.ndarray, n: int, q: float = 0.5) -> np.ndarray:
    """Per document the value at the q-th part of its letters, its sentences in order of value; 0 without letters."""
    order = np.lexsort((value, owner))
    total = np.bincount(owner, letters, n)
    before = np.append(0.0, np.cumsum(total)[:-1])
    reached = np.cumsum(letters[order])
    at = np.searchsorted(reached, before + q * total - 1e-6)
    return np.where(total > 0, value[order][np.minimum(at, max(0, len(order) - 1))], 0.0) if len(order) else np.zeros(n)


@dataclass(frozen=True)
class _Judge:
    """Of each fold the models of the others: tables, which levels they have, and the uniform distribution's part."""

    tables: list[dict[int, np.ndarray]]
    present: list[np.ndarray]
    floor: float

    def __getstate__(self) -> tuple:
        return [{n: zlib.compress(t.tobytes(), 1) for n, t in own.items()} for own in self.tables], self.present, self.floor

    def __setstate__(self, state: tuple) -> None:
        tables = [{n: np.frombuffer(zlib.decompress(t), np.float32).reshape(-1, len(LEVELS)) for n, t in own.items()} for own in state[0]]
        self.__dict__.update(tables=tables, present=state[1], floor=state[2])

    @staticmethod
    def of(counts: _Counts, whole: bool = False) -> _Judge:
        """Models that leave out a fold each, and if wanted one of all folds after them; weights estimated on what is left out."""
        chosen = counts.choices((*range(FOLDS), None) if whole else range(FOLDS))
        tables = counts.shares(chosen)
        weights = interpolation(counts, tables[:FOLDS])
        for own in tables:
            for n, weight in zip(ORDERS, weights, strict=False):
                own[n] *= np.float32(weight)
        size = counts.count(1).sum(2)
        return _Judge(tables, [size[own].any(0) for own in chosen], float(weights[-1] * UNIFORM))


def _judged(texts: list[str], ratings: np.ndarray, fold: int, judge: _Judge | None):
    """Sentences of texts of one fold: codes, starts, owners, letters, level (index) and difficulty."""
    codes, at, owner, letters = _prepare(texts)
    rated = np.clip(np.rint(ratings), LEVELS[0], LEVELS[-1]).astype(int) - LEVELS[0]
    level = rated[owner]
    if judge is None:
        return codes, at, owner, letters, level, None
    nats = surprisals(codes, at, judge.tables[fold], judge.floor)
    present = judge.present[fold]
    # how a document's rating speaks for the level of one of its sentences
    prior = -1.5 * np.abs(ratings[owner][:, None] - np.array(LEVELS)[None, :])
    level = np.where(letters >= 4, _posterior(nats, present, prior).argmax(1), level)
    return codes, at, owner, letters, level, _posterior(nats, present) @ np.array(LEVELS)


def _by_fold(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, list[str], np.ndarray]]:
    for pdf in batches:
        for low, high in K.chunks(pdf["text"].tolist()):
            for fold, own in pdf.iloc[low:high].groupby("fold"):
                yield int(fold), own["text"].tolist(), own["rating"].to_numpy(float)


def _counted(rated: DataFrame, judge: _Judge | None = None) -> _Counts:
    """Counts of all sentences of the rated documents under the levels they are judged to have, at first the documents'."""
    shared = rated.sparkSession.sparkContext.broadcast(judge)  # of fixed size: 2**BITS buckets

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tally = None
        for fold, texts, ratings in _by_fold(batches):
            tally = tally or _Tally()
            codes, at, _, _, level, _ = _judged(texts, ratings, fold, shared.value)
            tally.add(codes, at, fold * len(LEVELS) + level)
            if tally.size >= FLUSH:
                yield from tally.rows()
                tally = None
        if tally:
            yield from tally.rows()

    counts = _Counts.of(rated.select("text", "rating", "fold").mapInPandas(run, "slot int, cell int, data binary"))
    shared.destroy()
    return counts


def _medians(rated: DataFrame, judge: _Judge) -> DataFrame:
    """x: median difficulty of each rated document that has letters, by models that haven't seen it; y: its rating."""
    shared = rated.sparkSession.sparkContext.broadcast(judge)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for fold, texts, ratings in _by_fold(batches):
            _, _, owner, letters, _, difficulty = _judged(texts, ratings, fold, shared.value)
            own = np.bincount(owner, letters, len(texts)) > 0
            yield pd.DataFrame({"x": document_quantile(owner, difficulty, letters, len(texts))[own], "y": ratings[own]})

    points = K.keep(rated.select("text", "rating", "fold").mapInPandas(run, "x double, y double"))
    shared.destroy()
    return points


def fit(rated: DataFrame, language: L.LanguageModel, rounds: int = 2) -> ReadingModel | None:
    """rated: kept columns text, rating and fold. None without any text that has letters."""
    counts = _counted(rated)
    if not counts.slots:
        return None
    for _ in range(rounds):
        counts = _counted(rated, _Judge.of(counts))
    judge = _Judge.of(counts, whole=True)
    present, own = judge.present.pop(), judge.tables.pop()
    knots, values = isotonic_of(_medians(rated, judge))
    if not len(knots):
        return None
    tables = {n: np.where(present[None, :], t, 0).astype(np.float32) for n, t in own.items()}
    return ReadingModel(tables, judge.floor, knots, values, language)


def _rated(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """text, rating and fold of every rated document that has text."""
    # kept, so that its size is known: documents are shuffled only where there are too many ratings to broadcast
    mean = K.keep(labels.where("reading_level IS NOT NULL").groupBy("doc_id").agg(F.avg("reading_level").alias("rating")))
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold")
    return K.keep(documents.select("doc_id", "text").where(F.col("text").rlike("\\S")).join(mean, "doc_id").select("text", "rating", fold))


def score(texts: list[str], model: ReadingModel) -> pd.DataFrame:
    """Per text: level on the raters' scale, median and 90th percentile of its sentences' difficulty, surprisal (bits per character), language."""
    codes, at, owner, letters = _prepare(texts)
    nats = surprisals(codes, at, model.tables, model.floor)
    size = np.diff(np.append(at, len(codes)))
    present = (model.tables[1] > 0).any(0)
    difficulty = _posterior(nats, present) @ np.array(LEVELS)
    n = len(texts)
    weight = np.bincount(owner, letters, n)
    bits = np.where(present, nats, np.inf).min(1) / np.log(2) / np.maximum(size, 1)
    runs = L._runs(texts, model.language)
    runs["name"] = np.array(model.language.languages, object)[runs["lang"]]
    kinds = runs.groupby("owner")["name"].agg(lambda x: "+".join(sorted(set(x))))
    median = document_quantile(owner, difficulty, letters, n)
    return pd.DataFrame(
        {
            "lang": kinds.reindex(range(n)).to_numpy(object),
            "level": np.interp(median, model.knots, model.values),
            "median_difficulty": median,
            "p90_difficulty": document_quantile(owner, difficulty, letters, n, 0.9),
            "mean_bits": np.bincount(owner, letters * bits, n) / np.maximum(weight, 1),
            "p90_bits": document_quantile(owner, bits, letters, n, 0.9),
            "letters": weight,
        }
    )


def levels(documents: DataFrame, labels: DataFrame, language: L.LanguageModel) -> DataFrame:
    """doc_id, lang, level and the distribution's figures of every document that has letters."""
    spark = documents.sparkSession
    model = fit(_rated(documents, labels), language)
    schema = "doc_id long, lang string, level double, median_difficulty double, p90_difficulty double, mean_bits double, p90_bits double"
    docs = documents.select("doc_id", "text").where(F.col("text").rlike("\\S"))
    if model is None:
        return docs.select("doc_id", *(F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in schema.split(", ")[1:])))
    shared = spark.sparkContext.broadcast(model)  # of fixed size: 2**BITS buckets

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in batches:
            values = pdf["text"].tolist()
            for low, high in K.chunks(values):
                t = score(values[low:high], m)
                t.insert(0, "doc_id", pdf["doc_id"].to_numpy()[low:high])
                yield t[t.pop("letters") > 0]

    return docs.mapInPandas(run, schema)


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/reading_labels.parquet")
    language = L.train(documents.select(F.lit("documents").alias("table_name"), F.col("doc_id").alias("row_id"), L.normal_label(F.col("lang")).alias("label"), "text").where(F.col("text").rlike("\\S")))
    return levels(documents, labels, language)


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents wholly in English or Chinese whose level, mapped from their median difficulty, is 4 or 5."""
    return _levels(spark, sf_dir).where(F.col("lang").isin(*READ) & (F.col("level") >= HARD)).select("doc_id")


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by source and level."""
    own = _levels(spark, sf_dir).where(F.col("lang").isin(*READ))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return docs.join(own, "doc_id").groupBy("source", F.round("level").cast("int").alias("reading_level")).agg(F.count("*").alias("n_documents"), F.round(F.avg("mean_bits"), 2).alias("mean_bits"))


def all_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels(spark, sf_dir)
