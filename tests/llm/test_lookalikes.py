import re
import unicodedata

import pytest

from twinloom.llm import lookalikes as L

CASES = ["Ｈello", "１２ km", "ﬁnd", "café", "a​b", "no break", "tеxt", "sсhool", "⽇本", "年", "⻔", "soft­hyphen", "a‍b", "Сlear", "i j", "wωrd", "wᴏrd", "wꓳrd", "wⲟrd", "か\u3099", "\u1100\u1161\u11a8"]
PLAIN = ["hello", "café", "выход", "a β-phase sample", "Δt is small", "你好，世界！（Ａ）"[:6], "“quotes”…", "👩‍🔧 fixes", "❤️ ok", "東京、ソウル", "naïve Übung", "№ 5", "", "«да»"]


@pytest.mark.parametrize("text", CASES)
def test_cases(text):
    assert L.is_case(text) and re.search(L.SUSPECT, text)
    assert L.consistent(L.consistent(text)) == L.consistent(text)


@pytest.mark.parametrize("text", PLAIN)
def test_plain_texts(text):
    assert not L.is_case(text)


def test_every_changed_character_is_suspect():
    suspect = re.compile(L.SUSPECT)
    for i in range(0x110000):
        c = chr(i)
        if 0xD800 <= i <= 0xDFFF:
            continue
        if L.consistent(c) != c:
            assert suspect.match(c), hex(i)
        parts = unicodedata.decomposition(c).split()
        if len(parts) == 2 and not parts[0].startswith("<") and unicodedata.normalize("NFC", unicodedata.normalize("NFD", c)) == c:
            mark = chr(int(parts[1], 16))
            assert suspect.match(mark), hex(i)
    assert all(suspect.match(c) for c in [*L.LOOKALIKES, *L.RADICALS, *map(chr, range(0x1100, 0x1200))])
    assert all(L.consistent(c) == c for c in "µ⑴⒛")


def test_equal_looks_become_equal_texts(spark):
    texts = [(1, "café"), (2, "café"), (3, "cаfé"), (4, "ｃafé"), (5, "cafe"), (6, None), (7, "")]
    frame = L.normalised(spark.createDataFrame(texts, "pair_id long, text string"))
    forms = {r["pair_id"]: r["form"] for r in frame.collect()}
    assert forms[1] == forms[2] == forms[3] == forms[4] != forms[5] and forms[6] is None and forms[7] == ""


def test_tables(spark):
    rows = [(1, ("ａ", None)), (2, None), (3, ("甲", "x" * 100_000 + "​"))]
    frame = L.sides(spark.createDataFrame(rows, "pair_id long, translation struct<zh_CN: string, en_GB: string>"))
    assert sorted((r["pair_id"], r["field"]) for r in L.cases(frame).collect()) == [(1, "zh_CN"), (3, "en_GB")]
    assert L.cases(frame.limit(0)).count() == 0


def test_groups_and_their_members(spark, tmp_path):
    texts = [(1, "cafe\u0301"), (2, "café"), (3, "other"), (4, "ｃafé"), (5, "other"), (6, None)]
    rows = [(i, (None, t)) for i, t in texts]
    spark.createDataFrame(rows, "pair_id long, translation struct<zh_CN: string, en_GB: string>").write.parquet(f"{tmp_path}/parallel_pairs.parquet")
    assert [(r["first_pair_id"], r["n_texts"], r["n_spellings"]) for r in L.groups(spark, str(tmp_path)).collect()] == [(1, 3, 3)]
    assert sorted(map(tuple, L.members(spark, str(tmp_path)).collect())) == [(1, "en_GB", 1, True), (2, "en_GB", 1, False), (4, "en_GB", 1, False)]
