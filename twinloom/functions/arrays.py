"""Token sequences and n-gram scores as array columns."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from twinloom.functions import text as T


PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"  # of ASCII


def let(value: Column, body) -> Column:
    """body(value) with the value evaluated once; a lambda that names an outer expression would evaluate it per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def grams(chars: Column, n: int) -> Column:
    """All n-grams of a string, in order; none if it is shorter."""
    starts = lambda c: F.when(F.length(c) >= n, F.sequence(F.lit(1), F.length(c) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return let(chars, lambda c: F.transform(starts(c), lambda i: F.substr(c, i, F.lit(n))))


def array_grams(items: Column, n: int) -> Column:
    starts = lambda x: F.when(F.size(x) >= n, F.sequence(F.lit(1), F.size(x) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return let(items, lambda x: F.transform(starts(x), lambda i: F.array_join(F.slice(x, i, n), "\u0001")))


def overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection. Both sides are numbered among their equals, so it is a set intersection.

    Sorting puts equals together: an element's number is its place less that of its first equal, so nothing is
    exploded or shuffled.
    """

    def numbered(x: Column) -> Column:
        return let(F.array_sort(x), lambda s: F.transform(s, lambda g, i: F.concat(g, F.lit("\u0002"), (i - F.array_position(s, g) + 1).cast("string"))))

    return F.size(F.array_intersect(numbered(a), numbered(b)))


def _f1(common: Column, n_a: Column, n_b: Column) -> Column:
    """F1 from the size of the intersection; 0 if a side is empty."""
    c = common.cast("double")
    p, q = c / F.greatest(n_a, F.lit(1)), c / F.greatest(n_b, F.lit(1))
    return 2 * p * q / F.greatest(p + q, F.lit(1e-12))


def _fscores(order: int):
    def run(hypotheses: pd.Series, references: pd.Series) -> pd.Series:
        out = np.zeros(len(hypotheses))
        for row, (h, r) in enumerate(zip(hypotheses, references, strict=True)):
            for n in range(1, order + 1):
                a, b = max(len(h) - n + 1, 0), max(len(r) - n + 1, 0)
                common = (Counter(h[i : i + n] for i in range(a)) & Counter(r[i : i + n] for i in range(b))).total() if a and b else 0
                out[row] += 2 * common / (a + b) if common else 0.0
        return pd.Series(out * (100.0 / order))

    return run


def character_fscore(hypothesis: Column, reference: Column, order: int = 6) -> Column:
    """Mean F1 of character n-grams of orders 1 to 6, times 100; an order that a text is too short for scores 0.

    In Arrow batches: as nested array expressions, which aren't compiled, it took fifty times as long.
    """
    return F.pandas_udf(_fscores(order), "double")(F.lower(T.squeeze(hypothesis)), F.lower(T.squeeze(reference)))


def _pieces(words: list[str]) -> list[str]:
    """Words with a punctuation mark at their end or start as pieces of its own."""
    out: list[str] = []
    for w in words:
        if len(w) > 1 and w[-1] in PUNCTUATION:
            out += [w[:-1], w[-1]]
        elif len(w) > 1 and w[0] in PUNCTUATION:
            out += [w[0], w[1:]]
        else:
            out.append(w)
    return out


def _chrf(order: int, word_order: int, beta: float):
    def run(hypotheses: pd.Series, references: pd.Series) -> pd.Series:
        out = np.zeros(len(hypotheses))
        for row, (h, r) in enumerate(zip(hypotheses, references, strict=True)):
            sides = [("".join(x.split()), _pieces(x.split())) for x in (h, r)]
            precision = recall = 0.0
            effective = 0
            for k, n in [(0, n) for n in range(1, order + 1)] + [(1, n) for n in range(1, word_order + 1)]:
                a, b = (Counter(tuple(s[k][i : i + n]) for i in range(len(s[k]) - n + 1)) for s in sides)
                n_a, n_b = a.total(), b.total()
                if n_a and n_b:
                    common = (a & b).total()
                    precision, recall, effective = precision + common / n_a, recall + common / n_b, effective + 1
            if effective and precision + recall:
                p, q, weight = precision / effective, recall / effective, beta * beta
                out[row] = 100 * (1 + weight) * p * q / (weight * p + q)
        return pd.Series(out)

    return run


def chrf_plus(hypothesis: Column, reference: Column, order: int = 6, word_order: int = 2, beta: float = 2.0) -> Column:
    """chrF++: mean precision and recall of character n-grams (without white space) and word n-grams, as F-beta times 100.

    Orders that either side is too short for don't count. Nulls are empty texts; an empty side scores 0.
    """
    return F.pandas_udf(_chrf(order, word_order, beta), "double")(T.text(hypothesis), T.text(reference))


def ngram_f1(hypothesis: Column, reference: Column, n: int) -> Column:
    def of(sides: Column) -> Column:
        a, b = sides[0], sides[1]
        score = _f1(overlap(array_grams(a, n), array_grams(b, n)), F.size(a) - (n - 1), F.size(b) - (n - 1))
        return F.when((F.size(a) < n) | (F.size(b) < n), 0.0).otherwise(score)

    return let(F.array(hypothesis, reference), of)


def translation_reward(hypothesis: Column, reference: Column) -> Column:
    """Unigram and bigram F1 with a brevity penalty; 0 if either side is empty."""
    brevity = F.exp(F.least(F.lit(0.0), 1.0 - F.size(reference) / F.greatest(F.size(hypothesis), F.lit(1))))
    score = brevity * (0.4 * ngram_f1(hypothesis, reference, 1) + 0.6 * ngram_f1(hypothesis, reference, 2))
    return F.when((F.size(hypothesis) == 0) | (F.size(reference) == 0), 0.0).otherwise(score)


def trim_tokens(tokens: Column, eos: int, pad: int) -> Column:
    """Up to the end token, without padding."""
    at = F.array_position(tokens, F.lit(eos)).cast("int")
    return F.array_remove(F.when(at > 0, F.slice(tokens, F.lit(1), at - 1)).otherwise(tokens), F.lit(pad))


def frame(tokens: Column, length: int, sos: int, eos: int, pad: int) -> Column:
    """struct(encoder, decoder, label): cut to length, framed by start and end, padded."""

    def padded(x: Column) -> Column:
        return F.concat(x, F.array_repeat(F.lit(pad), F.lit(length) - F.size(x)))

    inner, outer = F.slice(tokens, 1, length - 2), F.slice(tokens, 1, length - 1)
    start, end = F.array(F.lit(sos)), F.array(F.lit(eos))
    return F.struct(padded(F.concat(start, inner, end)).alias("encoder"), padded(F.concat(start, outer)).alias("decoder"), padded(F.concat(outer, end)).alias("label"))


def pad_mask(tokens: Column, pad: int) -> Column:
    return F.transform(tokens, lambda t: t == pad)


def causal_mask(length: Column) -> Column:
    """Row i hides what comes after i."""
    steps = F.sequence(F.lit(1), length)
    return F.when(length >= 1, F.transform(steps, lambda i: F.transform(steps, lambda j: j > i))).otherwise(F.array().cast("array<array<boolean>>"))


def banned_next(tokens: Column, n: int) -> Column:
    """Tokens that would complete an n-gram for the second time."""
    if n <= 0:
        return F.slice(tokens, 1, 0)
    if n == 1:
        return F.array_distinct(tokens)

    def of(t: Column) -> Column:
        places = F.when(F.size(t) >= n, F.sequence(F.lit(1), F.size(t) - (n - 1))).otherwise(F.array().cast("array<int>"))
        hits = F.filter(places, lambda i: F.slice(t, i, F.lit(n - 1)) == F.slice(t, F.size(t) - (n - 2), F.lit(n - 1)))
        return F.when(F.size(t) < n - 1, F.slice(t, 1, 0)).otherwise(F.array_distinct(F.transform(hits, lambda i: F.element_at(t, (i + (n - 1)).cast("int")))))

    return let(tokens, of)


def learning_rate(step: Column, width: int, warmup: int, factor: float) -> Column:
    """Warm-up, then decay with the inverse square root of the step."""
    if width <= 0 or warmup <= 0 or factor <= 0:
        raise ValueError("width, warmup and factor must be positive")
    s = F.greatest(step, F.lit(1)).cast("double")
    return F.lit(factor * width**-0.5) * F.least(F.pow(s, F.lit(-0.5)), s * warmup**-1.5)


def micro_ratio(matched: Column, total: Column) -> Column:
    return F.when(total == 0, 1.0).otherwise(matched / total)
