"""Pair filters. Each returns the first reason against a pair, or null; rows are never dropped here."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinloom.functions import arrays as A
from twinloom.functions import text as T

# Word lists of the domain and alignment rules.
MILITARY = r"mortar shell|rocket|artillery|rifle|grenade|military|soldier|attack|missile|ammunition"
TECHNICAL = r"API|GPU|CPU|model|algorithm|database|software|hardware|network|training|inference"
LITERARY = r"castle|moor|shroud|lineage|shadow|soul|whispered|ancient|poem|novel"
SHROUD = ("裹尸", "帷幕", "笼罩", "遮蔽", "面纱")
MORTAR_MILITARY = ("迫击炮",)
MORTAR_BUILDING = ("灰浆", "灰泥", "水泥", "砂浆", "研钵")


def first_reason(*rules: tuple[str | Column, Column]) -> Column:
    """The value of the first rule whose condition holds; later conditions aren't evaluated."""
    chain = None
    for reason, condition in rules:
        value = F.lit(reason) if isinstance(reason, str) else reason
        chain = F.when(condition, value) if chain is None else chain.when(condition, value)
    return chain


def _named(body, **columns: Column) -> Column:
    """body(struct of the columns), each evaluated once however often the rules name it."""
    return A.let(F.struct(*(c.alias(k) for k, c in columns.items())), body)


def pair_reason(zh: Column, en: Column) -> Column:
    """See `_pair_reason`; the sides are evaluated once."""
    return _named(lambda s: _pair_reason(s["zh"], s["en"]), zh=zh, en=en)


def _pair_reason(zh: Column, en: Column) -> Column:
    """Corpus rules: empty, invalid_character, length, language, identical, length_ratio, english_leakage, chinese_leakage."""
    n_zh, n_en = F.length(zh), F.length(en)
    ratio = n_en / F.greatest(n_zh, F.lit(1))
    return first_reason(
        ("empty", (zh == "") | (en == "") | zh.isNull() | en.isNull()),
        ("invalid_character", F.concat(zh, en).rlike(r"[\x{fffd}\x{00}]")),
        ("length", ~(n_zh.between(2, 500) & n_en.between(2, 500))),
        ("language", ~zh.rlike(f"[{T.HAN}]") | ~en.rlike("[A-Za-z]")),
        ("identical", F.lower(zh) == F.lower(en)),
        ("length_ratio", ~ratio.between(0.3, 8.0)),
        ("english_leakage", T.latin_count(zh) > F.greatest(F.lit(12), F.floor(n_zh * 0.35))),
        ("chinese_leakage", T.han_count(en, wide=False) > F.greatest(F.lit(6), F.floor(n_en * 0.20))),
    )


def fast_length_reason(zh: Column, en: Column, most_zh: int = 240, most_en: int = 360) -> Column:
    return F.when((F.length(zh) > most_zh) | (F.length(en) > most_en), "fast_length")


def quality_reason(source: Column, target: Column, source_language: str = "zh") -> Column:
    """Fine-tuning rules for either direction."""
    return _named(lambda s: _quality_reason(s["source"], s["target"], source_language), source=source, target=target)


def _quality_reason(source: Column, target: Column, source_language: str) -> Column:
    n_s, n_t = F.length(source), F.length(target)
    han_s, han_t = T.han_count(source), T.han_count(target)
    if source_language == "zh":
        language = [("source_language", han_s < 2), ("target_language", ~target.rlike("[A-Za-z]")), ("target_cjk", han_t > F.greatest(F.lit(2), F.floor(n_t / 10)))]
        ratio = n_t / F.greatest(han_s, F.lit(1))
    else:
        language = [("source_language", T.latin_count(source) < 2), ("target_language", han_t < 2), ("source_cjk", han_s > F.greatest(F.lit(2), F.floor(n_s / 10)))]
        ratio = n_s / F.greatest(han_t, F.lit(1))
    return first_reason(
        ("empty", (source == "") | (target == "") | source.isNull() | target.isNull()),
        ("length", (n_s < 2) | (n_t < 2) | (n_s > 600) | (n_t > 900)),
        *language,
        ("identical", F.lower(source) == F.lower(target)),
        ("length_ratio", (ratio < 0.45) | (ratio > 18.0)),
        ("path_or_url", source.rlike("^(?:/|https?://)")),
    )


def _word(words: str) -> str:
    return rf"(?iU)\b(?:{words})\b"


def domain_of(source: Column, target: Column) -> Column:
    def of(joined: Column) -> Column:
        return F.when(joined.rlike(_word(MILITARY)), "military").when(joined.rlike(_word(TECHNICAL)), "technical").when(joined.rlike(_word(LITERARY)), "literary").otherwise("general")

    return A.let(F.concat(source, F.lit(" "), target), of)


def final_domain(source: Column, target: Column, configured: Column) -> Column:
    """The detected domain; the corpus's own where none is detected."""
    return A.let(domain_of(source, target), lambda d: F.when(d == "general", configured).otherwise(d))


def _contains_any(c: Column, terms: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(c, F.lit(t)) for t in terms))


def alignment_reason(source: Column, target: Column, source_language: str = "zh", blacklisted: Column | None = None, source_patterns: tuple[str, ...] = ()) -> Column:
    """Blacklist, then numbers, acronyms and two mistranslated words. `blacklisted` says whether the pair's hash is listed."""
    known = {"source": source, "target": target} | ({} if blacklisted is None else {"blacklisted": blacklisted})

    def facts(s: Column) -> Column:
        given = s["blacklisted"] if blacklisted is not None else None
        return _named(lambda f: _alignment_reason(s["source"], s["target"], f["numbers"], f["acronyms"], source_language, given, source_patterns), numbers=T.numbers(s["source"]), acronyms=T.acronyms(s["source"]))

    return _named(facts, **known)


def _alignment_reason(source: Column, target: Column, numbers: Column, acronyms: Column, source_language: str, blacklisted: Column | None, source_patterns: tuple[str, ...]) -> Column:
    retained = F.size(F.filter(numbers, lambda n: F.contains(target, n))) / F.greatest(F.size(numbers), F.lit(1))
    english, chinese = (source, target) if source_language == "en" else (target, source)
    folded = F.lower(english)
    military = english.rlike(_word(MILITARY))
    blocked = [("blacklisted_pair", blacklisted)] if blacklisted is not None else []
    blocked += [("blacklisted_source", source.rlike(f"(?iu){p}")) for p in source_patterns]
    return first_reason(
        *blocked,
        ("number_mismatch", (F.size(numbers) > 0) & (retained < 0.6)),
        ("acronym_mismatch", (F.size(acronyms) > 0) & ~F.exists(acronyms, lambda a: F.contains(target, a))),
        ("shroud_alignment", F.contains(folded, F.lit("shroud")) & ~_contains_any(chinese, SHROUD)),
        ("mortar_alignment", F.contains(folded, F.lit("mortar")) & ~F.when(military, _contains_any(chinese, MORTAR_MILITARY)).otherwise(_contains_any(chinese, MORTAR_BUILDING))),
    )


def mark_blacklisted(pairs: DataFrame, hashes: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """Adds `blacklisted`: whether the pair's hash is among `hashes` (column pair_hash). The join strategy is Spark's choice by size."""
    listed = hashes.select(F.col("pair_hash").alias("_hash")).distinct().withColumn("_listed", F.lit(True))
    return pairs.withColumn("_hash", T.pair_hash(F.col(source), F.col(target))).join(listed, "_hash", "left").withColumn("blacklisted", F.coalesce("_listed", F.lit(False))).drop("_hash", "_listed")
