"""Scalar functions against what Python's own regular expressions say, and fixed cases."""

import re

import pytest
from pyspark.sql import functions as F

from twinloom.functions import arrays as A
from twinloom.functions import text as T
from twinloom.operators import documents, filters, quality, rules


def one(spark, column, **values):
    names = list(values)
    schema = ", ".join(f"{n} {'array<int>' if isinstance(values[n], list) and values[n] and isinstance(values[n][0], int) else 'array<string>' if isinstance(values[n], list) else 'string'}" for n in names)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("r")).first()["r"]


TEXTS = ["Version 2.5 on 2024-01-02, see https://a.example/x?y=1 or {{NAME}} and ${v}", "costs $1 and \\q 12,480 kg", "", "   ", "ARI。GPU and Plan A.", "价格 12 kg 3%", "２０ ok"]


def test_immutable_tokens_come_back(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS] + [(None,)], "t string").withColumn("p", T.protect(F.col("t")))
    for r in df.withColumn("back", T.restore(F.col("p.text"), F.col("p.kept"))).collect():
        assert r["back"] == (r["t"] or "")
        assert "http" not in r["p"]["text"]


def test_facts(spark):
    assert one(spark, T.numbers(F.col("t")), t="3 and 3 and 12,480 or 2.5") == ["3", "12,480", "2.5"]
    assert one(spark, T.acronyms(F.col("t")), t="GPU, API。 Plan A. USB-C GPU") == ["GPU", "API", "A", "USB-C"]
    assert "ARI" in one(spark, T.acronyms(F.col("t")), t="与ARI。")
    assert one(spark, T.entities(F.col("t")), t="We met John Smith and Mary Ann Lee today") == ["John Smith", "Mary Ann Lee"]


def test_normalise_is_html_and_compatibility(spark):
    assert one(spark, T.normalise(F.col("t")), t="Ａ &amp;  B​ ﬁ　x ") == "A & B fi x"
    assert one(spark, T.normalise(F.col("t")), t=None) == ""


def test_direction(spark):
    for text, want in (("", "zh-en"), ("中文abcd", "zh-en"), ("中a bcd", "en-zh"), ("plain", "en-zh")):
        assert one(spark, T.direction_of(F.col("t")), t=text) == want
    assert one(spark, T.normal_direction(F.col("t")), t=" ZH_to_EN ") == "zh-en"
    assert one(spark, T.normal_direction(F.col("t")), t="英译中") == "en-zh"
    with pytest.raises(Exception, match="unknown direction"):
        one(spark, T.normal_direction(F.col("t")), t="fr-de")


def test_sentences_and_clauses(spark):
    assert one(spark, T.sentences(F.col("t")), t="a?!b。”c") == ["a?", "!", "b。”", "c"]
    assert one(spark, T.sentences(F.col("t"), "en-zh"), t="One. Two") == ["One.", "Two"]
    assert one(spark, T.clauses(F.col("t")), t="a，b,c:") == re.split(r"(?<=[，,、：:])", "a，b,c:")


def test_tidy_chinese(spark):
    assert one(spark, T.tidy_chinese(F.col("t")), t="中 文 ， a, 1,2;重复重复重复") == "中文，a， 1,2；重复"


def test_words_not_parts(spark):
    assert one(spark, T.context_matches(F.col("t"), "organ"), t="organic") is False
    assert one(spark, T.context_matches(F.col("t"), "organ"), t="the ORGAN.") is True
    assert one(spark, F.col("t").rlike(T.term_pattern("API")), t="该API处理") is False


def test_tagged_translation(spark):
    assert one(spark, T.tagged_translation(F.col("t")), t="x <Translation> 好\n了 </translation> y") == "好\n了"
    assert one(spark, T.tagged_translation(F.col("t")), t="```text\nok\n```") == "ok"


def test_context_rules_fold_in_order(spark):
    table = [{"source": "bank", "rewrite": "river bank", "target": "河岸", "aliases": ["银行"], "when_any": ["water"], "forbidden_output_any": ["银行"]}, {"source": "river", "rewrite": "stream", "target": "河"}]
    r = one(spark, rules.apply_context_rules(F.col("t"), table), t="The Bank near water")
    assert (r["text"], r["required"], r["forbidden"], r["aliases"]) == ("The stream bank near water", ["河岸", "河"], ["银行"], ["银行\t河岸"])
    assert one(spark, rules.apply_context_rules(F.col("t"), table), t="the bank")["text"] == "the bank"


def test_glossary_longest_first(spark):
    entries = [{"source": "石", "target": "stone", "aliases": []}, {"source": "石桥", "target": "stone bridge", "aliases": ["rock bridge"]}]
    g = one(spark, rules.protect_glossary(F.col("t"), entries, "zh-en"), t="老石桥")
    assert g["text"] == "老stone bridge" and g["aliases"] == ["rock bridge\tstone bridge"]
    assert one(spark, rules.restore_glossary(F.col("t"), F.col("a")), t="A Rock Bridge, rock bridges", a=["rock bridge\tstone bridge"]) == "A stone bridge, rock bridges"


def _fscore(h, r):
    from collections import Counter

    h, r = (re.sub(r"\s+", " ", x.lower()).strip() for x in (h, r))
    total = 0.0
    for n in range(1, 7):
        a, b = (Counter(x[i : i + n] for i in range(len(x) - n + 1)) for x in (h, r))
        c = sum((a & b).values())
        p, q = c / max(sum(a.values()), 1), c / max(sum(b.values()), 1)
        total += 2 * p * q / max(p + q, 1e-12)
    return total * 100 / 6


@pytest.mark.parametrize("h, r", [("the cat sat", "the cat sat"), ("aaaa aa", "aaa"), ("", "x"), ("ab", "ab"), ("中文测试句子", "中文的测试"), ("x" * 300, "x" * 200 + "y")])
def test_character_fscore_is_the_multiset_score(spark, h, r):
    assert one(spark, A.character_fscore(F.col("h"), F.col("r")), h=h, r=r) == pytest.approx(_fscore(h, r))


def test_token_arrays(spark):
    assert one(spark, A.banned_next(F.col("t"), 2), t=[1, 2, 3, 1]) == [2]
    assert one(spark, A.banned_next(F.col("t"), 1), t=[1, 1, 3]) == [1, 3]
    assert one(spark, A.trim_tokens(F.col("t"), 2, 0), t=[0, 5, 6, 2, 7]) == [5, 6]
    f = one(spark, A.frame(F.col("t"), 5, 101, 102, 100), t=[1, 2, 3, 4, 5])
    assert (f["encoder"], f["decoder"], f["label"]) == ([101, 1, 2, 3, 102], [101, 1, 2, 3, 4], [1, 2, 3, 4, 102])
    assert one(spark, A.causal_mask(F.lit(2)), t="") == [[False, True], [False, False]]


@pytest.mark.parametrize(
    "zh, en, want",
    [("", "a", "empty"), (None, "a", "empty"), ("中�", "ab", "invalid_character"), ("中", "ab", "length"), ("ab", "ab", "language"), ("中文", "中文 a", None), ("中a", "中A", "identical"), ("中文" * 50, "ab", "length_ratio"), ("中文" + "a" * 13, "some text here", "english_leakage"), ("中文", "中文中文中文中a", "chinese_leakage"), ("中文" * 250, "a" * 500, None), ("中文" * 250 + "字", "a" * 500, "length")],
)
def test_pair_reasons(spark, zh, en, want):
    assert one(spark, filters.pair_reason(F.col("z"), F.col("e")), z=zh, e=en) == want


def test_domain_cap_boundary(spark):
    from twinloom.operators import selection

    rows = spark.createDataFrame([(2,), (3,)], "n int").select("n", selection.domain_allowed(F.col("n"), 100, 0.03).alias("ok")).collect()
    assert [r["ok"] for r in sorted(rows)] == [True, False]


def test_quality_codes(spark):
    def codes(s, p, d):
        return [i["code"] for i in one(spark, quality.issues(F.col("s"), F.col("p"), F.col("d")), s=s, p=p, d=d)]

    assert "missing_number" in codes("It weighs 12,480 kg", "它很重", "en-zh")
    assert codes("好", "", "zh-en") == ["empty"]
    assert "repetition" in codes("好", "very very very good", "zh-en") and "repetition" not in codes("好", "very good very good", "zh-en")
    assert codes("短句。", "A short one.", "zh-en") == ["length_ratio"]


def test_candidate_verdicts(spark):
    def verdict(s, d, c):
        return one(spark, quality.candidate_verdict(*map(F.col, "sdcx")), s=s, d=d, c=c, x="en-zh")["reason"]

    assert verdict("See 12", "看12", "看") == "missing_number"
    assert verdict("See", "看", " ") == "empty"
    assert verdict("See", "看见", "看见了") == "ok"
    assert verdict("See", "看见" * 30, "看见看不见的") == "shortened"


def test_split_keeps_the_text(spark):
    text = "第一句，很长的一个分句，还有一个。" * 6 + "x" * 50
    parts = one(spark, documents.split_for_model(F.col("t"), 20, "zh-en"), t=text)
    assert "".join(parts) == text and max(map(len, parts)) <= 20
    assert one(spark, documents.split_for_model(F.col("t"), 20, "zh-en"), t="  ") == []


def _chrf(h, r, order=6, words=2, beta=2.0):
    """chrF++ by its definition."""
    import string
    from collections import Counter

    def split(t):
        out = []
        for w in t.split():
            if len(w) > 1 and w[-1] in string.punctuation:
                out += [w[:-1], w[-1]]
            elif len(w) > 1 and w[0] in string.punctuation:
                out += [w[0], w[1:]]
            else:
                out.append(w)
        return out

    p, q = [], []
    for make, most in ((lambda t: list("".join(t.split())), order), (split, words)):
        a, b = make(h), make(r)
        for n in range(1, most + 1):
            x, y = (Counter(tuple(s[i : i + n]) for i in range(len(s) - n + 1)) for s in (a, b))
            if x and y:
                c = sum((x & y).values())
                p.append(c / sum(x.values()))
                q.append(c / sum(y.values()))
    if not p or not sum(p) + sum(q):
        return 0.0
    p, q = sum(p) / len(p), sum(q) / len(q)
    return 100 * 5 * p * q / (4 * p + q)


@pytest.mark.parametrize("h, r", [("The cat sat.", "The cat sat."), ("a cat, sat", "the cat sat on (it)"), ("", "x"), (None, "x"), ("中文测试", "中文的测试"), ("x", "y")])
def test_chrf_plus(spark, h, r):
    assert one(spark, A.chrf_plus(F.col("h"), F.col("r")), h=h, r=r) == pytest.approx(_chrf(h or "", r))


def test_peel_and_should_translate(spark):
    r = one(spark, T.peel(F.col("t")), t=" \n a b\t")
    assert (r["leading"], r["core"], r["trailing"]) == (" \n ", "a b", "\t")
    r = one(spark, T.peel(F.col("t")), t="  ")
    assert (r["leading"], r["core"], r["trailing"]) == ("  ", "", "")
    assert one(spark, T.should_translate(F.col("t"), "zh-en"), t="a 中") and not one(spark, T.should_translate(F.col("t"), "zh-en"), t="abc")


def test_tagged_translation_keeps_other_fences(spark):
    assert one(spark, T.tagged_translation(F.col("t")), t="```MARKDOWN\n# x\n```") == "# x"
    assert one(spark, T.tagged_translation(F.col("t")), t="```sql\nselect 1\n```") == "sql\nselect 1"


def test_blank_context_values_match_nothing(spark):
    assert one(spark, T.context_matches(F.col("t"), " "), t="a b") is False
    assert one(spark, T.context_matches(F.col("t"), "石桥"), t="老石桥") is True
