"""Duplicates hidden by formatting, and overlaps of evaluation cases with training records."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from twinloom.llm import duplicates as D
from twinloom.llm import overlap as O

SIDES = "id long, translation struct<zh_CN: string, en_GB: string>"


def copies(spark, rows):
    return {(r["keep_id"], r["copy_id"]) for r in D.copies(spark.createDataFrame(rows, SIDES)).collect()}


def test_formatting_is_set_aside_but_content_is_not(spark):
    rows = [
        (5, ("你好，世界。", "Hello, World: 3.5 kg")),
        (2, ("你好世界", "HELLO world 3.5KG")),
        (9, ("hello world 3.5 kg", "你好 世界！")),  # the texts stand in the other fields
        (11, ("你好世界", "Hello world 35 kg")),  # a point between digits is content
        (12, ("你好世界", "Ｈello world 3.5 kg")),  # look-alikes aren't set aside
        (13, ("你好世界", None)),
        (14, (" ", "Hello")),
        (15, None),
        (16, ("K", "Kelvin")),
        (17, ("K", "Kelvin")),
        (18, ("k", "kelvin!")),
        (19, ("重复", "重复")),
        (20, ("重复", "重复了")),
    ]
    assert copies(spark, rows) == {(2, 5), (2, 9), (16, 18)}


def test_empty_and_hot(spark, monkeypatch):
    assert copies(spark, []) == set()
    monkeypatch.setattr(D.K.split_join, "__defaults__", (None, 5, 10))
    rows = [(i, ("热 " * (i % 3 + 1), "hot")) if i % 2 else (i, ("热热", f"cold {i}")) for i in range(1, 41)]
    want = {}
    for i, (a, b) in rows:
        want.setdefault((a.replace(" ", ""), b.replace(" ", "")), []).append(i)
    assert copies(spark, rows) == {(min(v), x) for v in want.values() for x in v if x != min(v)}


def test_colliding_fingerprints_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(D, "fingerprint", lambda fields: (F.lit(1).cast("long"), F.lit(2).cast("long")))
    rows = [(1, ("甲", "a")), (2, ("乙", "b")), (3, ("甲", "A")), (4, ("乙", "B")), (5, ("丙", "c")), (6, ("甲", None))]
    assert copies(spark, rows) == {(1, 3), (2, 4)}
    assert {tuple(r) for r in D.distinct(spark.createDataFrame(rows, SIDES)).collect()} == {(1, 2), (2, 2), (5, 1)}


def test_payloads(spark):
    rows = [('{"translation":{"zh":"甲","en":"a"}}',), ('{"en-US":"a","zh-CN":"\\u7532"}',), ("{",), (None,)]
    got = spark.createDataFrame(rows, "p string").select(D.parse_payload(F.col("p")).alias("t")).collect()
    assert [(r["t"]["zh_CN"], r["t"]["en_GB"]) if r["t"] and r["t"]["zh_CN"] else None for r in got] == [("甲", "a"), ("甲", "a"), None, None]


def _sentence(rng):
    words = lambda n: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(n))
    return words(6) + ", " + words(7) + ", " + words(6) + "."


def test_overlap_finds_what_comparing_all_finds(spark):
    rng = random.Random(5)
    cases = [(f"c{i}", _sentence(rng)) for i in range(30)]
    texts, want, n = [], set(), 0
    for i, (cid, t) in enumerate(cases):
        parts = [p.strip(" .") for p in t.split(",")]
        for variant in ((t.upper() + "!!"), ("intro words here " + t + " and more at the end"), ", ".join((parts[2], parts[0], parts[1])), t.replace(t.split()[4], "other"), ("x" + t.replace("a", "а"))):
            texts.append((n, variant))
            want.add((cid, n))
            n += 1
        texts.append((n, parts[0] + ", " + _sentence(rng)))  # one clause in common
        n += 1
    texts += [(n, None), (n + 1, " "), (n + 2, "short")]
    c = spark.createDataFrame([*cases, ("e", " "), ("s", "short"), ("c0", cases[0][1])], "eval_id string, text string").where("trim(text) <> ''")
    t = spark.createDataFrame(texts, "text_id long, text string").where("text IS NOT NULL AND trim(text) <> ''")
    got = {(r["eval_id"], r["text_id"]) for r in O.overlaps(c, t).where(F.col("covered") >= O.COVERED).collect()}
    brute = {(cid, i) for cid, a in [*cases, ("s", "short")] for i, b in texts if b and b.strip() and O.coverage(*O._content_strings([a, b])) >= O.COVERED}
    assert got == brute == want | {("s", n + 2)}


def test_overlap_finds_an_edited_copy_beside_an_exact_one(spark):
    rng = random.Random(11)
    case = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(400))
    # the edits break a part of each block, and what they break is rarer than what they leave
    edited = "".join("7" if i % 50 == 25 else x for i, x in enumerate(case))
    texts = [(0, case), (1, edited)]
    c, t = spark.createDataFrame([("c", case)], "eval_id string, text string"), spark.createDataFrame(texts, "text_id long, text string")
    assert {r["text_id"] for r in O.overlaps(c, t).collect()} == {0, 1}


def test_overlap_finds_short_cases_with_several_edits(spark):
    # no 36 bytes in a row are unaltered
    rows = [("在喷泉旁边年轻记者托加卡修好了著名的路灯和盐以及一本历史书", "在喷泉旁边年轻记者托加号修好了著名的路灯和早以及一本历史书"), ("小猫在旧港口看海", "昨天小猫在旧港口看海吃了一条很大的鱼然后回家睡觉")]
    c = spark.createDataFrame([(str(i), a) for i, (a, _) in enumerate(rows)], "eval_id string, text string")
    t = spark.createDataFrame([(i, b) for i, (_, b) in enumerate(rows)], "text_id long, text string")
    got = O.overlaps(c, t).where(F.col("covered") >= O.COVERED).collect()
    assert {(r["eval_id"], r["text_id"]) for r in got} == {("0", 0), ("1", 1)}


def test_overlap_of_empty_tables(spark):
    c = spark.createDataFrame([("a", "some text")], "eval_id string, text string")
    t = spark.createDataFrame([(1, "some text")], "text_id long, text string")
    assert O.overlaps(c.limit(0), t).count() == 0 and O.overlaps(c, t.limit(0)).count() == 0
    assert O.overlaps(c, t).count() == 1


def test_winnowing_keeps_a_fingerprint_of_every_unaltered_block():
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    for n, w in O.LADDER:
        for _ in range(20):
            common = word(n + w - 1)
            data, starts = O.contents([word(20) + common + word(9), word(3) + common + word(40)])
            owner, _, h = O.fingerprints(data, starts, n, w)
            assert set(h[owner == 0].tolist()) & set(h[owner == 1].tolist())
            hashed, at, inside = O.winnow(data, starts, n, w)
            assert all(hashed[at[i]] == hashed[i : i + w].min() for i in range(len(hashed) - w) if inside[i])


def _short_cases(rng):
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    wide = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(n))
    return [letters(n) for n in (3, 5, 10, 16, 20, 27, 28, 40, 50, 66, 90, 104, 130)] + [wide(n) for n in (1, 2, 3, 5, 9, 10, 20, 30, 35)]


def test_overlap_finds_short_cases_changed_at_any_place_or_contained(spark):
    rng = random.Random(8)
    cases = [(str(i), c) for i, c in enumerate(_short_cases(rng))]
    texts = []
    for _, c in cases:
        other = "z" if c.isascii() else "龘"
        texts += [c[:k] + other + c[k + 1 :] for k in range(len(c))]
        texts += ["Before it, " + c + " and then after.", "前面" + c + "后面的字", c.upper(), c[len(c) // 2 :] + " " + c[: len(c) // 2]]
        texts += [c[: k - 1] + c[k:] for k in range(1, len(c), 7)]
    c = spark.createDataFrame(cases, "eval_id string, text string")
    t = spark.createDataFrame(list(enumerate(texts)), "text_id long, text string").repartition(4)
    got = {(r["eval_id"], r["text_id"]) for r in O.overlaps(c, t).where(F.col("covered") >= O.COVERED).collect()}
    content = O._content_strings(texts)
    brute = {(i, k) for (i, _), a in zip(cases, O._content_strings([x for _, x in cases]), strict=True) for k, b in enumerate(content) if b and O.coverage(a, b) >= O.COVERED}
    assert got == brute and len(brute) > 400


def test_overlap_splits_hot_seeds_and_cases(spark, monkeypatch):
    rng = random.Random(9)
    case = _sentence(rng)
    monkeypatch.setattr(O.K.split_join, "__defaults__", (None, 5, 10))
    c = spark.createDataFrame([("a", case), ("b", case), ("c", _sentence(rng))], "eval_id string, text string")
    t = spark.createDataFrame([(i, case if i % 3 else _sentence(rng)) for i in range(60)], "text_id long, text string")
    got = {(r["eval_id"], r["text_id"]) for r in O.overlaps(c, t).where(F.col("covered") >= O.COVERED).collect()}
    assert got == {(x, i) for x in "ab" for i in range(60) if i % 3}


@pytest.mark.parametrize("case, text, covered", [("abcdefghijklmnop", "xxabcdefghijklmnopyy", 1.0), ("abcdefghijklmnop", "zzzz", 0.0)])
def test_coverage(case, text, covered):
    assert O.coverage(case, text) == covered
    assert unicodedata.normalize("NFC", case) == case
