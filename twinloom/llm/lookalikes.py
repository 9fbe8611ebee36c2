"""Texts that look alike brought to one form (problem 4).

Confusables skeleton: decompose, replace every character by the prototype of the character it imitates, decompose
again; originals are grouped by equal skeleton. Prototypes come from rules over the Unicode character database
(wide, narrow, font, ligature and compatibility forms of letters and digits; invisible characters; no-break spaces)
and from a short table of look-alike letters and radicals. A letter of another script is replaced only in a word
that also holds Latin letters, so words written wholly in their own script keep it. Punctuation of any width stays.

Null texts give null; a text is read whole. Only texts that hold a character of a suspect block go through Python.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinloom.llm import _codes as K

# Letters of other scripts and the Latin letters they look like.
LOOKALIKES = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "ү": "y", "ո": "n", "օ": "o", "ս": "u", "հ": "h", "ց": "g", "զ": "q",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Ѵ": "V", "Ԝ": "W", "Х": "X", "У": "Y", "Ү": "Y", "Ԛ": "Q", "Ӏ": "I", "Ԍ": "G", "Ս": "U", "Օ": "O",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "γ": "y", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C",
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꭱ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮤ": "W", "Ꮓ": "Z",
    "ω": "w", "τ": "t", "η": "n", "ь": "b",
    "ꓮ": "A", "ꓐ": "B", "ꓚ": "C", "ꓓ": "D", "ꓰ": "E", "ꓝ": "F", "ꓖ": "G", "ꓧ": "H", "ꓲ": "I", "ꓙ": "J", "ꓗ": "K", "ꓡ": "L", "ꓟ": "M", "ꓠ": "N", "ꓳ": "O", "ꓑ": "P", "ꓣ": "R", "ꓢ": "S", "ꓔ": "T", "ꓴ": "U", "ꓦ": "V", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓜ": "Z",
    "Ⲁ": "A", "Ⲃ": "B", "Ⲉ": "E", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "Ⲣ": "P", "Ⲥ": "C", "Ⲧ": "T", "Ⲩ": "Y", "Ⲭ": "X", "Ⲍ": "Z", "ⲟ": "o", "ⲣ": "p", "ⲥ": "c", "ⲩ": "y", "ⲭ": "x", "ⲓ": "i", "ⲕ": "k", "ⲱ": "w",
    "𐐄": "O", "𐐬": "o", "𐐕": "C", "𐐽": "c", "𐐠": "S", "𐑈": "s",
    "ᴄ": "c", "ᴏ": "o", "ꜱ": "s", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ᴛ": "t", "ɪ": "i",
    "ɑ": "a", "ɡ": "g",
}
# Radical forms without a compatibility decomposition and the characters they stand for.
RADICALS = {
    "⺁": "厂", "⺅": "亻", "⺆": "冂", "⺇": "几", "⺉": "刂", "⺊": "卜", "⺌": "小", "⺎": "兀", "⺒": "巳", "⺓": "幺", "⺔": "彑", "⺖": "忄", "⺘": "扌", "⺙": "攵", "⺛": "旡", "⺝": "月", "⺞": "歺", "⺠": "民", "⺡": "氵", "⺢": "氺", "⺣": "灬", "⺥": "爫", "⺦": "丬", "⺧": "牛", "⺨": "犭", "⺩": "王", "⺪": "疋", "⺫": "罒", "⺬": "示", "⺭": "礻", "⺮": "竹", "⺯": "糹", "⺰": "纟", "⺲": "罒", "⺶": "羊", "⺷": "羊", "⺹": "耂", "⺺": "肀", "⺼": "肉", "⺾": "艹", "⺿": "艹", "⻀": "艹", "⻁": "虎", "⻂": "衤", "⻃": "覀", "⻄": "西", "⻅": "见", "⻆": "角", "⻇": "角", "⻈": "讠", "⻉": "贝", "⻋": "车", "⻌": "辶", "⻍": "辶", "⻎": "辶", "⻏": "阝", "⻐": "钅", "⻑": "長", "⻒": "镸", "⻓": "长", "⻔": "门", "⻖": "阝", "⻗": "雨", "⻘": "青", "⻙": "韦", "⻚": "页", "⻛": "风", "⻜": "飞", "⻝": "食", "⻟": "飠", "⻠": "饣", "⻡": "首", "⻢": "马", "⻣": "骨", "⻤": "鬼", "⻥": "鱼", "⻦": "鸟", "⻧": "卤", "⻨": "麦", "⻩": "黄", "⻪": "黾", "⻫": "斉", "⻬": "齐", "⻭": "歯", "⻮": "齿", "⻯": "竜", "⻰": "龙", "⻱": "龜", "⻲": "亀",
}
NO_BREAK = "   "
FORMS = {"<wide>", "<narrow>", "<font>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>", "<noBreak>"}
#: Ranges that hold every character the rules or tables above change, and every mark that composes with a letter before
#: it; wider than need be, so that they are few. Plain texts hold none of them.
SUSPECT = (
    "[ ­ĲĳĿŀŉſǄ-ǌǱ-ǳɑɡɪ̀-֏؜ٓ-ٕٵ-ٸ"
    "ऀ-῿   ​-‏‪- ⁠-⁯⃐-↏〈〉⫝̸Ⲁ-⳿⺀-⿟〸-〺゙゚"
    "ㄱ-ㆎ㈀-㏿ꓐ-꓿ꚜ-ꟿꭜ-ꭟ豈-﫿ﬀ-﷿︀-️︠-︯ﹰ-﻿"
    "０-９Ａ-Ｚａ-ｚｦ-ￜ\U00010400-\U0001044f\U00011000-\U00011fff\U0001d100-\U0001d7ff\U0001ee00-\U0001eeff"
    "\U0001fbf0-\U0001fbf9\U0002f800-\U0002fa1f\U000e0000-\U000e01ef]"
)
#: Symbols of their own, though they have a compatibility form.
OWN = "[µẛ⑴-⒛🄀-🄊]"
_WORD = re.compile(r"[^\W\d_⺀-鿿가-퟿豈-﫿\U00020000-\U0003ffff][̀-ͯ]*(?:[^\W\d_⺀-鿿가-퟿豈-﫿\U00020000-\U0003ffff]|[̀-ͯ])*")
_FOREIGN = re.compile("[" + "".join(LOOKALIKES) + "]")
_LATIN = re.compile("[A-Za-zÀ-ɏ]")
_ACCENT = re.compile("[A-Za-zÀ-ɏḀ-ỿ][̀-ͯ]")
_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ\U000e0000-\U000e01ef]")
_OWN = re.compile(OWN)
_JOINABLE = re.compile("[؀-ۿऀ-෿ក-៿᠀-᢯]")


@lru_cache(maxsize=70_000)
def prototype(char: str) -> str:
    """What a character imitates whatever stands beside it; itself if nothing."""
    if char in RADICALS:
        return RADICALS[char]
    if char in NO_BREAK:
        return " "
    decomposed = unicodedata.decomposition(char)
    if not decomposed or _OWN.match(char):
        return char
    tag = decomposed.split()[0]
    compat = tag in FORMS
    singleton = not tag.startswith("<") and " " not in decomposed  # e.g. compatibility ideographs, the Kelvin sign
    if (compat or singleton) and (unicodedata.category(char)[0] in "LNM" or "⺀" <= char <= "⿟"):
        return unicodedata.normalize("NFKD" if compat else "NFD", char)
    return char


def _is_emoji(char: str) -> bool:
    return bool(char) and (unicodedata.category(char) in ("So", "Sk", "Cs") or char in "️‍⃣#*" or char.isdigit())


def visible(text: str) -> str:
    """Without invisible characters; joiners and variation selectors of emoji and of scripts that need them stay."""

    def drop(m: re.Match) -> str:
        before, after, c = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1], m[0]
        if c in "‍‌" and before and after and (c == "‍" and _is_emoji(before) and unicodedata.category(after) == "So" or _JOINABLE.match(before) and _JOINABLE.match(after)):
            return c
        if c in "︎️" and _is_emoji(before):
            return c
        if 0xE0020 <= ord(c) <= 0xE007F and _is_emoji(before[:1]) or c in "‎‏" and re.search("[֐-ࣿ]", text):
            return c
        return ""

    return _INVISIBLE.sub(drop, text)


def _word(m: re.Match) -> str:
    w = m[0]
    if _FOREIGN.search(w) and _LATIN.search(w):
        return "".join(LOOKALIKES.get(c, c) for c in w)
    return w


def skeleton(text: str) -> str:
    """Decompose, replace by prototypes, decompose again."""
    text = unicodedata.normalize("NFD", visible(text))
    text = "".join(map(prototype, text))
    return unicodedata.normalize("NFD", _WORD.sub(_word, text))


def consistent(text: str | None) -> str | None:
    """The one form in which texts that look the same are equal: the skeleton, composed again."""
    return None if text is None else unicodedata.normalize("NFC", skeleton(text))


def is_case(text: str) -> bool:
    """Does the text hold characters that only look like the expected ones?"""
    return bool(_ACCENT.search(text)) or consistent(text) != text


def sides(pairs: DataFrame) -> DataFrame:
    """pair_id, field, text of each side that isn't null."""
    return pairs.select("pair_id", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"translation.{f}").alias("text")) for f in ("zh_CN", "en_GB")))).alias("s")).select("pair_id", "s.*").where("text IS NOT NULL")


def _forms(texts: pd.Series) -> pd.Series:
    return texts.map(consistent, na_action="ignore")


def normalised(texts: DataFrame) -> DataFrame:
    """Adds `form`, the consistent form of `text`, in one scan: plain texts go to Python as nulls and keep their own."""
    suspect = F.when(F.col("text").rlike(SUSPECT), F.col("text"))
    return texts.withColumn("form", F.coalesce(F.pandas_udf(_forms, "string")(suspect), F.col("text")))


def cases(texts: DataFrame) -> DataFrame:
    """The rows of `texts` that hold look-alike characters: those whose consistent form is another text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[[is_case(t) for t in pdf["text"]]]

    return texts.where(F.col("text").rlike(SUSPECT)).mapInPandas(run, texts.schema)


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(sides(spark.read.parquet(f"{sf_dir}/parallel_pairs.parquet"))).select("pair_id", "field")


def _spelt(texts: DataFrame) -> DataFrame:
    """pair_id, field, skeleton (hash of the consistent form), spelling (hash of the text)."""
    return normalised(texts).select("pair_id", "field", F.sha2("form", 256).alias("skeleton"), F.xxhash64("text").alias("spelling"))


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of texts of equal skeleton that have several spellings: the first pair, how many texts and spellings.

    Two aggregations with partial counts before each shuffle; only hashes travel, so no group gathers in a task.
    """
    forms = _spelt(sides(spark.read.parquet(f"{sf_dir}/parallel_pairs.parquet")))
    spelt = forms.groupBy("field", "skeleton", "spelling").agg(F.count("*").alias("n"), F.min("pair_id").alias("first"))
    return spelt.groupBy("field", "skeleton").agg(F.min("first").alias("first_pair_id"), F.sum("n").alias("n_texts"), F.count("*").alias("n_spellings")).where("n_spellings > 1").withColumnRenamed("skeleton", "skeleton_hash")


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The members of those groups: pair_id, field, class_id (the group's first pair), and whether the text is spelt as that one.

    The groups' rows are joined back by skeleton; a skeleton that very many texts share is spread over salts.
    """
    forms = K.keep(_spelt(sides(spark.read.parquet(f"{sf_dir}/parallel_pairs.parquet"))))
    spelt = forms.groupBy("field", "skeleton", "spelling").agg(F.count("*").alias("n"), F.min("pair_id").alias("first"))
    several = K.keep(spelt.groupBy("field", "skeleton").agg(F.min(F.struct("first", "spelling")).alias("m"), F.sum("n").alias("n"), F.count("*").alias("k")).where("k > 1"))
    rows = K.split_join(forms, several.select("field", "skeleton", F.col("m.first").alias("class_id"), F.col("m.spelling").alias("own")), ["field", "skeleton"], several)
    return rows.select("pair_id", "field", "class_id", (F.col("spelling") == F.col("own")).alias("same_spelling"))
