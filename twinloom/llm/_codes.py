"""Vectorised code-point arithmetic shared by the text operators of this subpackage.

A batch of texts becomes one array of code points; every text is followed by `PAD` separators so
that an n-gram (n <= PAD + 1) never reaches into the next text.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import functions as F

from twinloom.session import keep  # noqa: F401  (used by the operators as K.keep)

PAD = 3
SEP = 2
MULT = np.uint32(2654435761)  # Knuth's multiplicative constant
STEP = 1 << 17

# classes of code points
OTHER, SPACE, LETTER, HAN, KANA, HANGUL, DIGIT, PUNCT, MARK = range(9)


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of each code point of the first plane; astral ones count as the last entry's class."""
    table = np.zeros(0x10001, np.uint8)
    kinds = {"L": LETTER, "N": DIGIT, "P": PUNCT, "S": OTHER, "Z": SPACE, "M": MARK}
    table[:0x10000] = [kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x10000)]
    table[[9, 10, 11, 12, 13]] = SPACE
    for low, high, kind in ((0x3400, 0x4DBF, HAN), (0x4E00, 0x9FFF, HAN), (0xF900, 0xFAFF, HAN), (0x2E80, 0x2FDF, HAN), (0x3041, 0x30FF, KANA), (0x31F0, 0x31FF, KANA), (0xAC00, 0xD7A3, HANGUL), (0x1100, 0x11FF, HANGUL)):
        table[low : high + 1] = kind
    table[[0x30FB, 0x30FC]] = PUNCT, KANA
    table[0x3005] = table[0x3007] = HAN
    table[0x10000] = OTHER
    return table


def kind_of(codes: np.ndarray) -> np.ndarray:
    return classes()[np.minimum(codes, 0x10000)]


def encode(texts: list[str], pad: int = PAD) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each followed by `pad` separators, and where each text starts (and the end)."""
    glue = chr(SEP) * pad
    joined = glue.join(texts) + glue
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter((len(t) + pad for t in texts), np.int64, len(texts)), out=starts[1:])
    return codes, starts


def ngram_buckets(codes: np.ndarray, orders: Iterable[int], bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each order, the bucket of the n-gram that starts at each position (the last n - 1 lack one)."""
    shift = np.uint32(32 - bits)
    base = np.uint32(0x01000193)
    h = (codes + np.uint32(1)) * base
    order = 1
    for n in sorted(orders):
        while order < n:
            h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * base + codes[order:]
            order += 1
        yield n, (h * MULT) >> shift


def table_sums(codes: np.ndarray, unit_starts: np.ndarray, tables: dict[int, np.ndarray] | np.ndarray, orders: tuple[int, ...], bits: int) -> np.ndarray:
    """Sum over each unit's n-grams of the table rows they select. Units are the spans between starts; memory is bounded by STEP."""
    width = (tables if isinstance(tables, np.ndarray) else next(iter(tables.values()))).shape[1]
    out = np.zeros((len(unit_starts), width), np.float64)
    total, top = len(codes), max(orders)
    for low in range(0, total, STEP):
        high = min(total, low + STEP)
        acc = np.zeros((high - low, width), np.float32)
        for n, idx in ngram_buckets(codes[low : min(total, high + top - 1)], orders, bits):
            idx = idx[: high - low]
            acc[: len(idx)] += (tables if isinstance(tables, np.ndarray) else tables[n])[idx]
        add_by_unit(out, acc, unit_starts, low, high)
    return out


def add_by_unit(out: np.ndarray, values: np.ndarray, unit_starts: np.ndarray, low: int, high: int) -> None:
    """out[u] += sum of the rows of values (positions low..high) that lie in unit u."""
    first = max(0, int(np.searchsorted(unit_starts, low, "right")) - 1)
    last = int(np.searchsorted(unit_starts, high, "left"))
    cuts = np.maximum(unit_starts[first:last] - low, 0)
    if len(cuts):
        out[first:last] += np.add.reduceat(values, cuts, axis=0)


def unit_counts(flags: np.ndarray, unit_starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(flags.astype(np.int64), unit_starts) if len(unit_starts) else np.zeros(0, np.int64)


def sentence_starts(codes: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Where sentences start: at a text's start and after a sentence end or line break.

    A full stop, question or exclamation mark of ASCII ends a sentence only before white space or the end
    (so decimals and host names stay whole); marks inside curly or corner quotation marks end none.
    """
    if not len(codes):
        return np.zeros(0, np.int64)
    following = np.append(codes[1:], np.uint32(SEP))
    blank = (following == 32) | (following == 10) | (following == 9) | (following == 13) | (following == SEP) | (following >= 0x4E00)
    ends = np.isin(codes, np.array([0x2E, 0x21, 0x3F], np.uint32)) & blank
    ends |= np.isin(codes, np.array([0x3002, 0xFF01, 0xFF1F, 0xFF0E], np.uint32))
    opened = np.isin(codes, np.array([0x201C, 0x300C, 0x300E, 0x00AB], np.uint32)).astype(np.int32) - np.isin(codes, np.array([0x201D, 0x300D, 0x300F, 0x00BB], np.uint32))
    if opened.any():
        depth = np.cumsum(opened)
        line = np.flatnonzero((codes == 10) | (codes == SEP))
        # a quotation left open ends with its line
        base = np.zeros(len(codes), np.int64)
        base[line] = line
        base = depth[np.maximum.accumulate(base)]
        ends &= (depth - base) <= 0
    # closing marks and quotes belong to the sentence they close
    closers = np.isin(following, np.array([0x22, 0x27, 0x29, 0x201D, 0x2019, 0x300D, 0x300F, 0xFF09, 0x00BB], np.uint32))
    at = np.flatnonzero(ends | (codes == 10)) + 1
    at = at + closers[at - 1]
    at = at[at < text_starts[-1]]
    return np.unique(np.concatenate([text_starts[:-1], at]))


def chunks(values: list[str], limit: int = 400_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `limit` characters together, so memory doesn't follow the Arrow batch."""
    begin, size = 0, 0
    for i, v in enumerate(values):
        size += len(v)
        if size >= limit:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(values):
        yield begin, len(values)


def split_join(many, few, keys: list[str], counts=None, least: int = 100_000, most: int = 10_000):
    """Inner join on keys that any share of the rows of `many` may have: rows of hot keys are spread over salts.

    A key is hot with more than `least` rows and more than 1 / `most` of all, so there are fewer than `most` hot keys
    and the table of them is small whatever the data. `counts` has each key's number of rows, `n` (by default counted).
    """
    counts = many.groupBy(*keys).agg(F.count("*").alias("n")) if counts is None else counts.select(*keys, "n")
    total, top = counts.agg(F.sum("n"), F.max("n")).first()
    bound = max(least, (total or 0) // most)
    if (top or 0) <= bound:
        return many.join(few, keys)
    hot = counts.where(F.col("n") > bound).select(*keys, F.ceil(F.col("n") / bound).cast("int").alias("_salts")).collect()  # fewer than `most` rows
    salts = F.broadcast(many.sparkSession.createDataFrame(hot, ", ".join(f"{k} {t}" for k, t in counts.select(*keys).dtypes) + ", _salts int"))
    spread = many.join(salts, keys, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*many.columns), F.col("_salts").cast("long")).cast("int"), F.lit(0)))
    each = few.join(salts, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts") - 1, F.lit(0))))).drop("_salts")
    return spread.drop("_salts").join(each, [*keys, "_salt"]).drop("_salt")


@lru_cache(maxsize=1)
def folding() -> np.ndarray:
    """Lower case of each code point of the first plane (where it is one character)."""
    table = np.arange(0x10001, dtype=np.uint32)
    table[:0xD800] = [ord(low) if len(low := chr(c).lower()) == 1 else c for c in range(0xD800)]
    return table


def compact(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters and digits only, in lower case: their codes, where each text starts among them, and their places before."""
    kind = kind_of(codes)
    keep_at = np.flatnonzero((kind >= LETTER) & (kind <= DIGIT) | (codes > 0xFFFF))
    kept = codes[keep_at]
    kept = np.where(kept > 0xFFFF, kept, folding()[np.minimum(kept, 0x10000)])
    return kept, np.searchsorted(keep_at, starts), keep_at


def rolling(values: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of each window of n values, by doubling: log2(n) passes over the array."""
    base, out, done, at = values.astype(np.uint64) + np.uint64(1), None, 0, 1
    power = base * np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        while at <= n:
            if n & at:
                tail = power[done:] if done else power
                if out is None:
                    out = tail
                else:
                    m = min(len(out), len(tail))
                    out = (out[:m] ^ (out[:m] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + tail[:m]
                done += at
            m = max(0, len(power) - at)
            power = (power[:m] ^ (power[:m] >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) + power[at:]
            at *= 2
        out = out[: max(0, len(values) - n + 1)]
        return out ^ (out >> np.uint64(32))
