"""Text functions as Spark columns; nulls count as empty texts, as the callers' rules expect.

Character classes are written out, so that white space and digits are Unicode's and don't depend on the JDK.
"""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes of the rules.
WS = r"\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
HAN = r"\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}"  # corpus preparation, repetition
HAN_WIDE = HAN + r"\x{f900}-\x{faff}"  # quality, fine-tuning, translation
NUMBER = r"\p{Nd}+(?:[.,]\p{Nd}+)?"
ACRONYM = r"(?<![A-Za-z0-9])[A-Z][A-Z0-9.-]{1,}(?![A-Za-z0-9])"
ENTITY = rf"(?U)(?<!\w)(?:[A-Z][a-z]{{2,}})(?:[{WS}]+(?:[A-Z][a-z]{{2,}})){{1,3}}(?!\w)"
IMMUTABLE = (
    rf"(?i)https?://[^{WS})\]]+|(?U:[\w.+-]+@[\w.-]+)\.[A-Za-z]{{2,}}|"
    r"\{\{[^{}]+\}\}|\$\{[^{}]+\}|"
    r"(?<![A-Za-z0-9])\p{Nd}{1,4}(?:[-/:]\p{Nd}{1,4}){1,2}(?![A-Za-z0-9])|"
    rf"(?<![A-Za-z0-9])\p{{Nd}}+(?:[.,]\p{{Nd}}+)?[{WS}]?(?:%|°C|km|cm|mm|kg|GB|MB|TB|bit|USD|EUR|CNY)(?![A-Za-z0-9])"
)
MD_PREFIX = rf"^([{WS}]*(?:#{{1,6}}[{WS}]+|[-*+][{WS}]+|\p{{Nd}}+[.)][{WS}]+|>[{WS}]+))(.*)$"
MD_PROTECTED = rf"`[^`]*`|https?://[^{WS}]+|!?\[[^\]]*\]\([^)]*\)"
DIRECTIONS = {"zh-en": "zh-en", "zh_to_en": "zh-en", "中译英": "zh-en", "en-zh": "en-zh", "en_to_zh": "en-zh", "英译中": "en-zh"}


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def squeeze(c: Column) -> Column:
    """White space collapsed to single spaces and stripped; null is empty."""
    return F.trim(F.regexp_replace(text(c), f"[{WS}]+", " "))


def strip(c: Column) -> Column:
    return F.regexp_replace(text(c), f"^[{WS}]+|[{WS}]+$", "")


def _entities_and_forms(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", html.unescape(x)))


def normalise(c: Column) -> Column:
    """HTML entities resolved, NFKC, zero-width space and BOM dropped, then `squeeze`.

    Entities and NFKC have no built-in, so they take one Arrow round trip.
    """
    plain = F.pandas_udf(_entities_and_forms, "string")(text(c))
    return squeeze(F.regexp_replace(plain, r"[\x{200b}\x{feff}]", ""))


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def han_count(c: Column, wide: bool = True) -> Column:
    return count(c, f"[{HAN_WIDE if wide else HAN}]")


def latin_count(c: Column) -> Column:
    return count(c, "[A-Za-z]")


def pair_key(zh: Column, en: Column) -> Column:
    """Key of a pair irrespective of letter case."""
    return F.sha2(F.concat(F.lower(zh), F.lit("\0"), F.lower(en)), 256)


def pair_hash(source: Column, target: Column) -> Column:
    return F.sha2(F.concat(F.lower(strip(source)), F.lit("\0"), F.lower(strip(target))), 256)


def exact_key(source: Column, target: Column) -> Column:
    return F.sha1(F.concat(source, F.lit("\0"), target))


def _all(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text(c), F.lit(pattern), F.lit(0))


def numbers(c: Column) -> Column:
    return F.array_distinct(_all(c, NUMBER))


def acronyms(c: Column) -> Column:
    return F.array_distinct(F.transform(_all(c, ACRONYM), lambda x: F.regexp_replace(x, r"\.+$", "")))


def entities(c: Column) -> Column:
    return F.array_distinct(_all(c, ENTITY))


def direction_of(c: Column) -> Column:
    """zh-en where the text is Chinese enough, or has no letters at all; else en-zh."""
    han, latin = han_count(text(c)), latin_count(text(c))
    return F.when((han == 0) & (latin == 0) | (han * 2 >= latin), "zh-en").otherwise("en-zh")


def normal_direction(c: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in DIRECTIONS.items() for x in kv))
    key = F.lower(strip(c))
    return F.coalesce(F.try_element_at(known, key), F.raise_error(F.concat(F.lit("unknown direction: "), F.coalesce(key, F.lit("null")))).cast("string"))


def protect(c: Column) -> Column:
    """struct(text, kept): immutable tokens (links, addresses, variables, dates, amounts) replaced in order of occurrence."""
    found = _all(c, IMMUTABLE)
    gaps = F.split(text(c), IMMUTABLE, -1)
    marks = F.transform(found, lambda x, i: F.format_string("ZXQPH%03dQXZ", i))
    return F.struct(F.array_join(F.zip_with(gaps, marks, lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "").alias("text"), found.alias("kept"))


def restore(c: Column, kept: Column) -> Column:
    """Puts the kept tokens back; white space inside a token's mark and letter case don't matter."""
    entries = F.transform(kept, lambda x, i: F.struct(F.format_string(rf"(?i)ZXQPH[{WS}]*%03d[{WS}]*QXZ", i).alias("mark"), x.alias("value")))
    quoted = lambda v: F.regexp_replace(v, r"([\\$])", r"\\$1")
    return F.aggregate(entries, text(c), lambda acc, e: F.regexp_replace(acc, e["mark"], quoted(e["value"])))


def visible_length(c: Column) -> Column:
    return F.length(F.regexp_replace(text(c), f"[{WS}]+", ""))


def quote(term: str) -> str:
    return "\\Q" + term.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def term_pattern(term: str) -> str:
    """The term as a word of its own, in any letter case; Chinese neighbours count as letters."""
    return rf"(?iU)(?<!\w){quote(term)}(?!\w)"


def context_pattern(value: str) -> str:
    """A context value in any letter case; one with ASCII letters or digits stands between others. Blank values match nothing."""
    value = value.strip()
    if not value:
        return r"(?!)"
    if any("0" <= x <= "9" or "A" <= x <= "Z" or "a" <= x <= "z" for x in value):
        return rf"(?i)(?<![A-Za-z0-9_]){quote(value)}(?![A-Za-z0-9_])"
    return rf"(?iu){quote(value)}"


def context_matches(c: Column, value: str) -> Column:
    return c.rlike(context_pattern(value))


def tidy_chinese(c: Column) -> Column:
    """Spacing and punctuation of Chinese output; phrases said three times or more are said once."""
    out = strip(c)
    for pattern, by in (
        (rf"(?<=[{HAN_WIDE}])[{WS}]+(?=[{HAN_WIDE}])", ""),
        (rf"[{WS}]+([，。！？；：、])", "$1"),
        (rf"([，。！？；：、])[{WS}]+", "$1"),
        (r"(?<!\p{Nd}),(?!\p{Nd})", "，"),
        (";", "；"),
        ("一块(?=[^，。！？；]{0,16}(?:帷幕|面纱))", "一层"),
        (rf"([{HAN}]{{2,6}})(?:的?[{WS}]*\1){{2,}}", "$1"),
    ):
        out = F.regexp_replace(out, pattern, by)
    return out


def sentences(c: Column, direction: str = "zh-en") -> Column:
    """Sentences with their closing marks; blanks are dropped."""
    ends = "。！？!?；;\n" + ("." if direction == "en-zh" else "")
    closers = "”’」』】）》)\\]\""
    return F.filter(F.transform(_all(c, f"[^{ends}]*[{ends}][{closers}]*|[^{ends}]+$"), strip), lambda s: s != "")


def clauses(c: Column) -> Column:
    return F.split(text(c), "(?<=[，,、：:])", -1)


def peel(c: Column) -> Column:
    """struct(leading, core, trailing) white space around a text."""
    lead = F.regexp_extract(text(c), f"^[{WS}]*", 0)
    trail = F.when(lead == c, "").otherwise(F.regexp_extract(text(c), f"[{WS}]*$", 0))
    core = F.substring(text(c), F.length(lead) + 1, F.length(text(c)) - F.length(lead) - F.length(trail))
    return F.struct(lead.alias("leading"), core.alias("core"), trail.alias("trailing"))


def should_translate(c: Column, direction: str) -> Column:
    return text(c).rlike(f"[{HAN_WIDE}]" if direction == "zh-en" else "[A-Za-z]")


def tagged_translation(c: Column) -> Column:
    """What stands in the first translation tag; else the text without a code fence around it."""
    tagged = F.regexp_extract(text(c), "(?is)<translation>(.*?)</translation>", 1)
    fence = F.regexp_replace(strip(c), rf"(?i)^```(?:text|markdown)?[{WS}]*|[{WS}]*```$", "")
    return strip(F.when(text(c).rlike("(?is)<translation>.*?</translation>"), tagged).otherwise(fence))


def markdown(c: Column) -> Column:
    """struct(prefix, pieces, kept) of a line: pieces between code, links and addresses, which are kept."""
    prefix = F.regexp_extract(text(c), MD_PREFIX, 1)
    body = F.substring(text(c), F.length(prefix) + 1, F.length(text(c)))
    return F.struct(prefix.alias("prefix"), F.split(body, MD_PROTECTED, -1).alias("pieces"), _all(body, MD_PROTECTED).alias("kept"))
