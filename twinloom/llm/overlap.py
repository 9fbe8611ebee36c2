"""Evaluation cases that recur in training records, exactly or nearly (problem 2).

Winnowing fingerprints. A text is brought to its consistent form, folded and reduced to letters and digits (bytes). A
case of at least `PAIRED` bytes is cut into blocks of about `BLOCK` bytes (a shorter one into `LEAST_BLOCKS`), and the
fingerprints that winnowing selects inside a block are the least rolling hashes of its windows; their length follows
the block's, so that every block holds at least one, and any record that holds a block unaltered selects the same ones.
Training fingerprints are counted (only those the cases have, before any shuffle), and the rarest of each block is its
probe. Two probes of one case that stand within `SPAN` blocks of each other make a seed: a record is joined to a case if
it holds two blocks of it unaltered, in any order, whatever else changed. Cases of 8 to `PAIRED` bytes seed with each
8-byte hash (a copy that covers enough of so short a case holds one), still shorter ones with their rarest 3-byte (or
single-byte) hash, for only a record that holds them whole can match.

Blocks that are much more frequent than their case's others (`FREQUENT` times the median: stock phrases) make no seeds
as long as more than half of the span's blocks are left; a copy has two of those unless over half of its blocks are
altered. The texts of each joined pair are then compared: common stretches are chained, extended in both directions as
long as they agree, and the share of the case that is covered decides, wherever its pieces stand.

Bitmaps keep fingerprints and seeds without a partner on the map side; they have `BITS_PER_KEY` bits a key, at most
2**`MOST_BITS` in all, and only save work. Candidate pairs are ids until the texts are joined to them, and only texts
of candidates are shuffled. Seeds and cases that very many records share are split by a salt.

Null and blank texts match nothing; repeated case ids count once, with one of their texts; empty tables give no rows.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinloom.llm import _codes as K
from twinloom.llm import lookalikes

BLOCK, LEAST_BLOCKS, SPAN, FREQUENT = 26, 4, 20, 16
#: Lengths of fingerprints and their windows; a block has the longest for which both fit into it.
LADDER = ((6, 2), (8, 3), (11, 4), (15, 5), (20, 6))
PAIRED = LEAST_BLOCKS * (LADDER[0][0] + LADDER[0][1] - 1)
#: Fingerprint lengths of cases that are too short for pairs, and from how many bytes on.
ALONE = ((1, 1), (3, 3), (8, 8))
#: Two probes make a seed if a text holds them within so many bytes: a span of blocks, a quarter more for insertions.
REACH = SPAN * BLOCK * 2 * 5 // 8
BITS_PER_KEY, LEAST_BITS, MOST_BITS = 32, 20, 30
CHUNK = 1 << 16
#: Shared stretches count from so many characters on (Latin and the like; wide scripts), at least so much must be covered.
RUN_LETTERS, RUN_WIDE, COVERED = 8, 3, 0.84
#: What a copy may hold between its stretches that isn't the case's, as a share of the case; pieces farther apart aren't one copy.
FOREIGN = 0.35


_suspect = lookalikes.re.compile(lookalikes.SUSPECT)


def plain(text: str) -> str:
    """Consistent form in lower case; full-width and other forms of letters and digits are gone."""
    if not text.isascii():
        text = lookalikes.consistent(text) if _suspect.search(text) else unicodedata.normalize("NFC", text)
    return text.lower()


def contents(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters and digits of all texts as bytes, and where each text starts among them."""
    codes, starts, _ = K.compact(*K.encode([plain(t) for t in texts]))
    width = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
    ends = np.append(0, np.cumsum(width))
    data = np.frombuffer(codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
    return data, ends[starts]


def hashes(data: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rolling hashes of n bytes, the text each starts in, and the last place at which one of that text starts."""
    if len(data) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = K.rolling(data, n)
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[: len(h)]
    return h, owner, starts[owner + 1] - n


def winnow(data: np.ndarray, starts: np.ndarray, n: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per place: the hash of n bytes there, where the least hash of the w from here on stands, and whether all lie in one text."""
    h, owner, last = hashes(data, starts, n)
    place = np.arange(len(h))
    best, at, step = h, place, 1
    while step < w:  # by doubling, the last step by what is left; ties go to the first
        by = min(step, w - step)
        less = best[by:] < best[: len(best) - by]
        best = np.concatenate([np.where(less, best[by:], best[: len(best) - by]), best[len(best) - by :]])
        at = np.concatenate([np.where(less, at[by:], at[: len(at) - by]), at[len(at) - by :]])
        step += by
    return h, at, place + w - 1 <= last


def _slide(values: np.ndarray, w: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) of each w values in a row, by doubling."""
    step = 1
    while step < w:
        by = min(step, w - step)
        values = best(values[by:], values[:-by])
        step += by
    return values


def fingerprints(data: np.ndarray, starts: np.ndarray, n: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Selected fingerprints of texts in order: text, place, hash; of equal ones in a row only the first.

    A hash is selected if it is the least of a window that it is in: if the greatest of its windows' minima is itself.
    """
    none = np.zeros(0, np.int64)
    if len(data) < n + w - 1:
        return none, none, np.zeros(0, np.uint64)
    h = K.rolling(data, n)
    least = _slide(h, w, np.minimum)
    ends = starts[1:]
    beyond = ends[:, None] - np.arange(1, n + w - 1)  # windows that reach into the next text
    beyond = beyond[beyond >= starts[:-1, None]]
    least[beyond[beyond < len(least)]] = 0
    pad = np.zeros(w - 1, np.uint64)
    place = np.flatnonzero(_slide(np.concatenate([pad, least, pad]), w, np.maximum) == h)
    owner = np.searchsorted(starts, place, "right") - 1
    h = h[place]
    new = np.append(True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1]))[: len(h)]
    return owner[new], place[new], h[new]


def blocks_of(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text of so many bytes: number of blocks, their size, and the place in LADDER (-1 if it is too short for pairs)."""
    count = np.maximum(LEAST_BLOCKS, lengths // BLOCK)
    size = lengths // count
    return count, size, np.searchsorted([n + w - 1 for n, w in LADDER], size, "right") - 1


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two fingerprints in any order."""
    low, high = np.minimum(a, b), np.maximum(a, b)
    with np.errstate(over="ignore"):
        key = (low ^ (low >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + high * np.uint64(0x9E3779B97F4A7C15)
    return key ^ (key >> np.uint64(32))


def _signed(h: np.ndarray) -> np.ndarray:
    return h.astype(np.uint64).view(np.int64)


class Bitmap:
    """A set of hashes in 2**bits bits: no false negatives."""

    def __init__(self, words: np.ndarray):
        self.words, self.bits = words, int(np.log2(len(words))) + 3

    @staticmethod
    def slots(h: np.ndarray, bits: int) -> np.ndarray:
        return (h.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)

    def has(self, h: np.ndarray) -> np.ndarray:
        s = self.slots(h, self.bits)
        return (self.words[s >> 3] >> (s & 7).astype(np.uint8)) & 1 > 0


def bitmap_of(keys: DataFrame) -> Bitmap:
    """The bitmap of a kept long column `key`, built where the keys are; parts of fixed size are united by place."""
    count = keys.count()
    bits = min(MOST_BITS, max(LEAST_BITS, (count * BITS_PER_KEY).bit_length()))

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = np.zeros((1 << bits) // 8, np.uint8)
        for pdf in batches:
            s = Bitmap.slots(pdf["key"].to_numpy(np.int64), bits)
            np.bitwise_or.at(words, s >> 3, np.left_shift(1, s & 7).astype(np.uint8))
        for at in range(0, len(words), CHUNK):
            piece = words[at : at + CHUNK]
            if piece.any():
                yield pd.DataFrame({"at": [at], "piece": [piece.tobytes()]})

    def unite(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(CHUNK, np.uint8)
        for piece in pdf["piece"]:
            total |= np.frombuffer(piece, np.uint8)
        return pd.DataFrame({"at": [pdf["at"].iloc[0]], "piece": [total.tobytes()]})

    words = np.zeros((1 << bits) // 8, np.uint8)
    # at most 2**MOST_BITS / 8 bytes in all
    for r in keys.select("key").mapInPandas(part, "at long, piece binary").groupBy("at").applyInPandas(unite, "at long, piece binary").collect():
        words[r["at"] : r["at"] + CHUNK] = np.frombuffer(r["piece"], np.uint8)
    return Bitmap(words)


def _case_blocks(values: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """length of fingerprints, case, block, fp: what winnowing selects inside the blocks of each case."""
    data, starts = contents(values)
    lengths = np.diff(starts)
    count, size, rung = blocks_of(lengths)
    for k, (n, w) in enumerate(LADDER):
        if not (rung == k).any():
            continue
        h, at, inside = winnow(data, starts, n, w)
        place = np.flatnonzero(inside)
        owner = np.searchsorted(starts, place, "right") - 1
        place, owner = place[rung[owner] == k], owner[rung[owner] == k]
        at_case = place - starts[owner]
        block = at_case // size[owner]
        fits = (block < count[owner]) & (at_case + n + w - 1 <= (block + 1) * size[owner])
        yield n, owner[fits], block[fits], h[at[place[fits]]]
    alone = np.where(rung < 0, np.searchsorted([low for low, _ in ALONE], lengths, "right") - 1, -1)
    for k, (_, n) in enumerate(ALONE):
        if (alone == k).any():
            h, owner, last = hashes(data, starts, n)
            place = np.flatnonzero(np.arange(len(h)) <= last)
            place = place[alone[owner[place]] == k]
            # negative blocks seed alone; all of the longer ones do, of the shorter ones the rarest
            block = -1 - (place - starts[owner[place]] if n == ALONE[-1][1] else 0 * place)
            yield n, owner[place], block, h[place]


def case_fingerprints(cases: DataFrame) -> DataFrame:
    """case_no, n, block, fp of each case."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            values, ids = pdf["text"].tolist(), pdf["case_no"].to_numpy()
            for low, high in K.chunks(values):
                for n, case, block, fp in _case_blocks(values[low:high]):
                    yield pd.DataFrame({"case_no": ids[low:high][case], "n_bytes": n, "block": block, "fp": _signed(fp)}).drop_duplicates()

    return cases.mapInPandas(run, "case_no long, n_bytes int, block int, fp long")


def _selected(values: list[str], lengths: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """length, text, place, fp of a training text for each length of fingerprints that the cases need."""
    data, starts = contents(values)
    windows = dict(LADDER)
    paired, alone = [n for n in lengths if n > 0], [-n for n in lengths if n < 0]
    for n in paired:
        yield n, *fingerprints(data, starts, n, windows[n])
    for n in alone:
        h, owner, last = hashes(data, starts, n)
        place = np.flatnonzero(np.arange(len(h)) <= last)
        yield -n, owner[place], place, h[place]


def count_fingerprints(texts: DataFrame, wanted: Bitmap, lengths: list[int]) -> DataFrame:
    """fp, n: how often each wanted fingerprint was selected; counted per task before the shuffle."""
    shared = texts.sparkSession.sparkContext.broadcast(wanted)  # of bounded size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for pdf in batches:
            values = pdf["text"].tolist()
            for low, high in K.chunks(values):
                for _, _, _, h in _selected(values[low:high], lengths):
                    h = h[shared.value.has(h)]
                    held.append(_signed(h))
                    size += len(h)
                if size > 1_500_000:
                    fp, n = np.unique(np.concatenate(held), return_counts=True)
                    yield pd.DataFrame({"fp": fp, "n": n})
                    held, size = [], 0
        if held:
            fp, n = np.unique(np.concatenate(held), return_counts=True)
            yield pd.DataFrame({"fp": fp, "n": n})

    return texts.select("text").mapInPandas(run, "fp long, n long").groupBy("fp").agg(F.sum("n").alias("n"))


def _span_seeds(case: np.ndarray, n: np.ndarray, fp: np.ndarray) -> Iterator[pd.DataFrame]:
    """Seeds and probes of spans with equally many blocks: a row each of counts and fingerprints."""
    order = np.argsort(n, axis=1, kind="stable")
    n, fp = np.take_along_axis(n, order, 1), np.take_along_axis(fp, order, 1)
    blocks = n.shape[1]
    kept = (np.arange(blocks) < blocks // 2 + 2) | (n <= FREQUENT * n[:, [blocks // 2]])
    a, b = np.triu_indices(blocks, 1)
    row, pair = np.nonzero(kept[:, a] & kept[:, b])
    key = pair_key(fp[row, a[pair]], fp[row, b[pair]])
    yield pd.DataFrame({"case_no": case[row], "key": _signed(key), "probe": False}).drop_duplicates()
    row, block = np.nonzero(kept)
    yield pd.DataFrame({"case_no": case[row], "key": _signed(fp[row, block]), "probe": True})


def case_seeds(known: DataFrame) -> DataFrame:
    """case_no, key, probe: the seeds of each case, and the fingerprints they are made of (`probe`).

    known: case_no, block, fp, n, the rarest fingerprint of each block.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            size = pdf["n"].map(len).to_numpy()
            for blocks in np.unique(size[size > 1]):
                part = pdf[size == blocks]
                yield from _span_seeds(part["case_no"].to_numpy(), np.stack(part["n"].to_list()), np.stack(part["fp"].to_list()).view(np.uint64))

    entries = F.collect_list(F.struct("n", "fp"))  # at most SPAN
    spans = known.where("block >= 0").groupBy("case_no", F.floor(F.col("block") / SPAN).alias("span")).agg(entries.alias("e")).select("case_no", F.col("e.n").alias("n"), F.col("e.fp").alias("fp"))
    alone = known.where("block < 0").select("case_no", F.col("fp").alias("key"), F.explode(F.array(F.lit(False), F.lit(True))).alias("probe"))
    return spans.mapInPandas(run, "case_no long, key long, probe boolean").unionAll(alone)


def matches(texts: DataFrame, probes: Bitmap, seeds: Bitmap, lengths: list[int]) -> DataFrame:
    """key, text_id of the seeds that a training text holds."""
    shared = texts.sparkSession.sparkContext.broadcast((probes, seeds))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, wanted = shared.value
        for pdf in batches:
            values, ids = pdf["text"].tolist(), pdf["text_id"].to_numpy()
            for low, high in K.chunks(values):
                found = []
                for n, text, place, h in _selected(values[low:high], lengths):
                    ok = own.has(h)
                    text, place, h = text[ok], place[ok], h[ok]
                    if n < 0:
                        found.append((h, text))
                        continue
                    step = 1
                    while step < len(h):  # pairs of the probes that are `step` apart, as long as any are near enough
                        near = np.flatnonzero((text[step:] == text[:-step]) & (place[step:] - place[:-step] <= REACH))
                        if not len(near):
                            break
                        key = pair_key(h[near], h[near + step])
                        ok = wanted.has(key)
                        found.append((key[ok], text[near[ok]]))
                        step += 1
                if found:
                    key, text = (np.concatenate(x) for x in zip(*found, strict=True))
                    yield pd.DataFrame({"key": _signed(key), "text_id": ids[low:high][text]}).drop_duplicates()

    return texts.mapInPandas(run, "key long, text_id long")


@lru_cache(maxsize=4096)
def _seeds(case: str) -> tuple[int, dict[str, tuple[int, ...]]]:
    run = RUN_WIDE if sum(c >= "⺀" for c in case) > len(case) / 3 else RUN_LETTERS
    at: dict[str, list[int]] = {}
    for i in range(len(case) - run + 1):
        at.setdefault(case[i : i + run], []).append(i)
    return run, {k: tuple(v) for k, v in at.items()}


def coverage(case: str, text: str) -> float:
    """The share of the case that common stretches cover: seeds, extended while they agree, longest at each place.

    A seed that continues the last chain (a little further in both texts) is preferred to one elsewhere, and the few
    characters between two stretches of a chain count where they agree in order. Stretches count together only if
    little else stands between the first and the last of them in the text (`FOREIGN`), so clauses that a longer text
    holds here and there are no copy; the best such part of the text decides.
    """
    run, seeds = _seeds(case)
    if case in text:
        return 1.0
    free = bytearray(b"\x01") * len(case)
    i, end_case, end_text = 0, 0, 0
    pieces: list[tuple[int, int, int]] = []  # of the text: from, to, covered of the case
    n, m = len(case), len(text)
    while i <= m - run:
        spots = seeds.get(text[i : i + run])
        best, best_at = 0, -1
        if spots:
            for s in spots:
                if not free[s]:
                    continue
                k = run
                while s + k < n and i + k < m and case[s + k] == text[i + k] and free[s + k]:
                    k += 1
                gain = k + (2 * run if 0 <= s - end_case <= 2 * run else 0)
                if gain > best:
                    best, best_at, length = gain, s, k
        if best_at < 0:
            i += 1
            continue
        s = best_at
        gap_case, gap_text = s - end_case, i - end_text
        if 0 < gap_case <= 2 * run and 0 <= gap_text <= 2 * run and all(free[end_case:s]):
            between = _agreeing(case[end_case:s], text[end_text:i])
        else:
            between = 0
        # extend to the left too
        while s and i > end_text and free[s - 1] and case[s - 1] == text[i - 1] and s > end_case:
            s, i, length = s - 1, i - 1, length + 1
            gap_case = 0
        pieces.append((i, i + length, between + sum(free[s : s + length])))
        free[s : s + length] = bytes(length)
        end_case, end_text = s + length, i + length
        i = end_text
    best, first, covered = 0, 0, 0
    for _, end, gain in pieces:
        covered += gain
        while end - pieces[first][0] - covered > FOREIGN * n:  # never so for the last piece alone
            covered -= pieces[first][2]
            first += 1
        best = max(best, covered)
    return min(1.0, best / n)


def _agreeing(a: str, b: str) -> int:
    """Longest common subsequence of two short stretches."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def _content_strings(values: list[str]) -> list[str]:
    data, starts = contents(values)
    raw = data.tobytes()
    return [raw[starts[i] : starts[i + 1]].decode("utf-8", "surrogatepass") for i in range(len(values))]


def scored(candidates: DataFrame) -> DataFrame:
    """Adds `covered` to rows with `case_text` and `text`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cases, texts = _content_strings(pdf.pop("case_text").tolist()), _content_strings(pdf.pop("text").tolist())
            yield pdf.assign(covered=[coverage(c, t) if c else 0.0 for c, t in zip(cases, texts, strict=True)])

    return candidates.select("eval_id", "text_id", "case_text", "text").mapInPandas(run, "eval_id string, text_id long, covered double")


def cases_of(evaluation: DataFrame) -> DataFrame:
    return evaluation.select(F.col("id").alias("eval_id"), F.col("source").alias("text")).where(F.col("text").rlike("\\S"))


def texts_of(pairs: DataFrame) -> DataFrame:
    """text_id (twice the pair's id, plus one for English), text: both sides, for a case matches in its own language only."""
    sides = F.array(*(F.struct((F.col("pair_id") * 2 + k).alias("text_id"), F.col(f"translation.{f}").alias("text")) for k, f in enumerate(("zh_CN", "en_GB"))))
    return pairs.select(F.explode(sides).alias("s")).select("s.*").where(F.col("text").rlike("\\S"))


def overlaps(cases: DataFrame, texts: DataFrame) -> DataFrame:
    """eval_id, text_id, covered of each case and text that share a seed."""
    # two ids of equal hash are only compared in vain: the case's own text decides
    cases = cases.dropDuplicates(["eval_id"]).withColumn("case_no", F.xxhash64("eval_id"))
    prints = K.keep(case_fingerprints(cases.select("case_no", "text")))
    # at most a row per length; negative lengths seed alone
    lengths = [r[0] for r in prints.select(F.when(F.col("block") < 0, -F.col("n_bytes")).otherwise(F.col("n_bytes"))).distinct().collect()]
    counted = count_fingerprints(texts, bitmap_of(prints.select(F.col("fp").alias("key"))), lengths)
    # the rarest of each block; a fingerprint that no text has can't find one
    rarest = prints.join(counted, "fp").groupBy("case_no", "block").agg(F.min(F.struct("n", "fp")).alias("m")).select("case_no", "block", "m.*")
    seeds = K.keep(case_seeds(rarest))
    probes, seeds = seeds.where("probe"), seeds.where("NOT probe")
    held = K.keep(matches(texts, bitmap_of(probes), bitmap_of(seeds), lengths))
    found = K.keep(K.split_join(held, seeds.select("key", "case_no"), ["key"]).select("case_no", "text_id").distinct())
    # only texts of candidates are shuffled
    near = texts.sparkSession.sparkContext.broadcast(bitmap_of(found.select(F.xxhash64("text_id").alias("key"))))
    candidate = F.pandas_udf(lambda x: pd.Series(near.value.has(x.to_numpy(np.int64))), "boolean")
    rows = found.join(texts.where(candidate(F.xxhash64("text_id"))), "text_id")
    return scored(K.split_join(rows, cases.withColumnRenamed("text", "case_text"), ["case_no"], found.groupBy("case_no").agg(F.count("*").alias("n"))))


def _found(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    evaluation, pairs = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("translation_eval", "parallel_pairs"))
    hits = overlaps(cases_of(evaluation), texts_of(pairs)).where(F.col("covered") >= COVERED)
    return evaluation, pairs, hits.select("eval_id", F.shiftright("text_id", 1).alias("pair_id"), "covered")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir)[2].groupBy("eval_id", "pair_id").agg(F.max("covered").alias("c")).select("eval_id", "pair_id")


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases and records that overlap, per split and corpus, with the mean share of the case that is covered."""
    evaluation, pairs, hits = _found(spark, sf_dir)
    rows = hits.join(pairs.select("pair_id", "corpus"), "pair_id").join(evaluation.select(F.col("id").alias("eval_id"), "split"), "eval_id")
    return rows.groupBy("split", "corpus").agg(F.countDistinct("eval_id").alias("n_cases"), F.countDistinct("pair_id").alias("n_records"), F.round(F.avg("covered"), 3).alias("mean_covered"))
