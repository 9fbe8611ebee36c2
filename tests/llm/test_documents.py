"""Leaked passages, mixtures and reading levels."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinloom.llm import leakage, mixture, reading
from twinloom.llm import language as L


def _words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8))) for _ in range(n))


def test_leaks_in_pieces_and_edited(spark, monkeypatch):
    rng = random.Random(1)
    items = [(i, _words(rng, 60)) for i in range(12)]
    docs, want = [], set()
    for d, (i, t) in enumerate(items):
        w = t.split()
        half = _words(rng, 30) + " " + " ".join(w[:18]) + " " + _words(rng, 10) + " " + " ".join(w[30:50]).upper()
        edited = " ".join(x if k % 9 else "changed" for k, x in enumerate(w))
        docs += [(3 * d, half), (3 * d + 1, edited), (3 * d + 2, _words(rng, 20) + " ".join(w[:15]))]  # the last: a quarter
        want |= {(3 * d, i), (3 * d + 1, i)}
    docs += [(900, None), (901, ""), (902, _words(rng, 20000) + " " + items[0][1])]
    want.add((902, 0))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    it = spark.createDataFrame([*items, (99, None), (98, " ")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leakage.aligned(d, it).where(F.col("share") >= leakage.COVERED).collect()}
    assert got == want
    monkeypatch.setattr(leakage, "ITEM_BLOCK", 900)  # several blocks of items
    assert {(r["doc_id"], r["item_id"]) for r in leakage.aligned(d, it).where(F.col("share") >= leakage.COVERED).collect()} == want
    assert leakage.aligned(d, it.limit(0)).count() == 0 and leakage.aligned(d.limit(0), it).count() == 0


def test_short_items_are_found_as_a_whole(spark):
    items = [(1, "老桥塌了呢"), (2, "Who closed the gate?"), (3, "ok"), (4, "?!"), (5, "九个字的句子在这里面")]
    docs = [(1, "他说老桥，塌了呢。"), (2, "Then: “WHO ｃlosed the gate” she asked."), (3, "老桥没有塌"), (4, "who closed the door"), (5, "前面九个字的句子在这里后面"), (6, None), (7, "?!")]
    d, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leakage.aligned(d, it).where(F.col("share") >= leakage.COVERED).collect()}
    assert got == {(1, 1), (2, 2), (5, 5)}


def test_long_alignments_need_one_row():
    import tracemalloc

    rng = np.random.default_rng(5)
    a = rng.integers(0, 5000, 3000)
    b = np.concatenate([rng.integers(5000, 9000, 20000), a, rng.integers(5000, 9000, 20000)])
    tracemalloc.start()
    assert leakage.local_alignment(a, b) == (6000, 0, 3000, 20000, 23000)
    assert tracemalloc.get_traced_memory()[1] < 20_000_000
    tracemalloc.stop()


def test_distant_pieces_stay_apart():
    words = [f"w{i}" for i in range(40)]
    other = [f"x{i}" for i in range(300)]
    # two pieces of eight words, all in between is missing: what lies between them isn't covered
    share = leakage.covered_share(words, words[:8] + other + words[32:])
    assert share == pytest.approx(sum(map(len, words[:8] + words[32:])) / sum(map(len, words)))


def test_local_alignment_is_smith_waterman():
    rng = np.random.default_rng(2)
    for _ in range(40):
        a, b = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(1, 15))
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        score, i, ei, j, ej = leakage.local_alignment(a, b)
        assert score == h.max() and 0 <= i <= ei <= len(a) and 0 <= j <= ej <= len(b)


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(1)
    size = rng.integers(1, 900, 500)
    p = mixture.flight(np.full(500, 0.37), size, rng)
    open_at = (p > 0) & (p < 1)
    assert open_at.sum() <= 2
    assert p.sum() == pytest.approx(185) and (p * size).sum() == pytest.approx(0.37 * size.sum())
    landed = mixture.landing(p, size)
    assert set(landed) <= {0.0, 1.0} and abs((landed * size).sum() - 0.37 * size.sum()) <= size.max()


def test_flight_draws_each_text_at_its_rate():
    size = np.array([5, 5, 9, 14, 3, 3, 8, 20])
    mean = np.mean([mixture.landing(mixture.flight(np.full(8, 0.5), size, np.random.default_rng(s)), size) for s in range(600)], axis=0)
    assert np.all(np.abs(mean - 0.5) < 0.12)


def test_mixture_meets_its_shares(spark, monkeypatch):
    monkeypatch.setattr(mixture, "BLOCK", 16)  # several levels
    rng = random.Random(4)
    docs = [(i, _words(rng, rng.randint(5, 60)), "a" if i % 3 else "b") for i in range(300)]
    docs += [(400, docs[0][1], "a"), (401, None, "a"), (402, " ", "b"), (403, "text", None), (404, "text of no listed source", "z")]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    s = spark.createDataFrame([("a", 0.5, 1, "x"), ("b", 0.3, 2, None), ("gone", 0.2, 3, "x")], "source string, weight double, max_repeats int, domain string")
    m = mixture.mixture(d, s)
    rows = m.collect()
    assert len({r["doc_id"] for r in rows}) == len(rows) and not {400, 401, 402, 403, 404} & {r["doc_id"] for r in rows}
    assert all(1 <= r["repeats"] <= {"a": 1, "b": 2}[r["source"]] for r in rows)
    report = {r["source"]: r for r in mixture.shares(m, s).collect()}
    assert report["a"]["actual_share"] == pytest.approx(0.625, abs=0.01) and report["gone"]["actual_share"] == 0
    assert mixture.mixture(d.limit(0), s).count() == 0 and mixture.mixture(d, s.limit(0)).count() == 0


def test_mixture_of_a_given_size(spark):
    docs = [(i, f"text number {i} of its source", "a" if i % 2 else "b") for i in range(200)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    s = spark.createDataFrame([("a", 1.0, 4, None), ("b", 1.0, 1, None)], "source string, weight double, max_repeats int, domain string")
    whole = mixture.count_tokens(d).groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()
    n = {r["source"]: r["n"] for r in whole}
    got = {r["source"]: r for r in mixture.shares(mixture.mixture(d, s, total=sum(n.values()) / 2), s).collect()}
    assert all(got[k]["actual_share"] == pytest.approx(0.5, abs=0.01) for k in "ab") and got["a"]["tokens"] == pytest.approx(sum(n.values()) / 4, rel=0.02)
    # b can't give more than it has once: the report says what came of it
    got = {r["source"]: r for r in mixture.shares(mixture.mixture(d, s, total=4 * sum(n.values())), s).collect()}
    assert got["b"]["tokens"] == n["b"] and got["a"]["most_repeats"] == 4 and got["a"]["actual_share"] == pytest.approx(0.8, abs=0.02)


def test_the_tokenizers_pattern():
    tokenizers = pytest.importorskip("public_tokenizers")
    assert tokenizers.PATTERN == mixture.PATTERN


def test_isotonic_is_the_least_squares_monotone_fit():
    x, y = np.array([1.0, 2, 3, 4, 5]), np.array([1.0, 3, 2, 2, 5])
    knots, values = reading.isotonic(x, y)
    assert np.interp(x, knots, values).tolist() == pytest.approx([1, 7 / 3, 7 / 3, 7 / 3, 5])


EASY = ["The cat sees a big dog.", "My dad has a red hat.", "The girl likes the small fish.", "A big bag is on the mat."]
HARD = ["Epistemological heterogeneity attenuates the presuppositions of hermeneutic stratification.", "The axiomatic recalcitrance of normative grammars presages an aporetic reification.", "Notwithstanding its conventions, the stratified structure interrogates translatability."]


def test_levels_rank_held_out_documents(spark):
    rng = random.Random(3)
    text = lambda pool: " ".join(rng.choice(pool) for _ in range(8))
    docs = [(i, text(EASY if i % 2 else HARD)) for i in range(40)]
    labels = [(i, "r", 1 if i % 2 else 5) for i in range(20)] + [(21, "r", None), (999, "r", 3)]
    d = spark.createDataFrame([*docs, (50, None), (51, ""), (52, "...")], "doc_id long, text string")
    lb = spark.createDataFrame(labels, "doc_id long, rater string, reading_level int")
    model = L.fit([EASY[0] + " " + EASY[1], "猫看见一只大狗在桌子上面睡觉"] * 10, ["en", "zh"] * 10)
    got = {r["doc_id"]: r for r in reading.levels(d, lb, model).collect()}
    assert all((got[i]["level"] < reading.HARD) == bool(i % 2) for i in range(20, 40)) and not {50, 51, 52} & set(got)
    assert got[20]["level"] > got[21]["level"]
    assert all(r["level"] is None for r in reading.levels(d, lb.limit(0), model).collect())
    assert reading.levels(d.limit(0), lb, model).count() == 0


def test_every_rated_document_bears_on_the_level_models(spark):
    """More documents of a level than were sampled once (400), and rated ones of over 20,000 characters."""
    docs = [(i, f"{EASY[i % 4]} {EASY[i % 3]}", 1) for i in range(900)] + [(1000 + i, " ".join(HARD * (90 + i)), 5) for i in range(8)]
    assert all(len(t) > 20_000 for i, t, _ in docs if i >= 1000)
    d = spark.createDataFrame([x[:2] for x in docs] + [(2000, EASY[0]), (2001, HARD[0])], "doc_id long, text string")
    lb = spark.createDataFrame([(i, "r", k) for i, _, k in docs], "doc_id long, rater string, reading_level int")
    rated = reading._rated(d, lb)
    assert sorted(map(tuple, rated.select("text", "rating").collect())) == sorted((t, float(k)) for _, t, k in docs)
    # what is counted is what all texts hold, character by character, however they are spread over tasks
    want = np.zeros((len(reading.LEVELS), 1 << reading.BITS), np.int64)
    for _, text, k in docs:
        codes, at, _, _ = reading._prepare([text])
        for unit in np.split(codes, at[1:]):
            around = np.concatenate([np.full(4, 2), unit, np.full(5, 2)]).astype(np.uint32)
            _, idx = list(reading.K.ngram_buckets(around, (5,), reading.BITS))[0]
            np.add.at(want[k - 1], idx, 1)
    one, many = (reading._counted(rated.repartition(n)) for n in (1, 7))
    assert (one.count(5).sum(0) == want).all() and one.slots == many.slots
    model = L.fit([EASY[0] + " " + EASY[1], "猫看见一只大狗在桌子上面睡觉"] * 10, ["en", "zh"] * 10)
    got = {r["doc_id"]: r["level"] for r in reading.levels(d, lb, model).where("doc_id >= 2000").collect()}
    assert got[2000] < reading.HARD <= got[2001]


def test_isotonic_map_of_all_points_is_that_of_its_ranges(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.uniform(1, 5, 3000), 2)
    y = np.clip(np.rint(x + rng.normal(0, 1, 3000)), 1, 5)
    knots, values = reading.isotonic(x, y)
    points = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double").repartition(5)
    got = reading.isotonic_of(points)
    at = np.unique(x)
    assert np.interp(at, *got) == pytest.approx(np.interp(at, knots, values)) and (np.diff(got[1]) >= 0).all()
    assert len(set(knots[::2])) == len(knots) // 2


def test_weights_of_orders_come_from_all_folds(spark):
    """What any fold holds out moves the weights, by the count of its characters."""
    rng = random.Random(11)
    text = {i: " ".join(rng.choice(EASY) for _ in range(4)) for i in range(80)}
    frame = lambda noisy: spark.createDataFrame([(_words(random.Random(i), 30) if i % reading.FOLDS == noisy else t, 1.0, i % reading.FOLDS) for i, t in text.items()], "text string, rating double, fold int")
    floors = [reading._Judge.of(reading._counted(frame(k))).floor for k in (-1, *range(reading.FOLDS))]
    assert all(f > 5 * floors[0] for f in floors[1:])
