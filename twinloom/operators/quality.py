"""Reference-free assessment of translations and of reviewer candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinloom.functions import text as T
from twinloom.operators.filters import first_reason

# Patterns, weights and codes of the rules.
CLAUSE = r"(?iU)[,，;；:：]|\b(?:which|that|whose|while|although|because|whereas|from which)\b"
SEMANTIC_RISK = "理性|本能|混沌|谱系|血脉|荒原|帷幕|石板|隐喻|偏差|量化|显存|修辞|演化"
PROMPT_LEAK = r"(?i)<translation>|</translation>|原文[:：]|初译[:：]|system prompt|assistant:"
REPEATED_WORD = rf"(?iU)\b([A-Za-z]{{2,}})\b(?:[{T.WS},;:-]+\1\b){{2,}}"
REPEATED_PHRASE = rf"([{T.HAN}]{{2,8}})(?:的?[{T.WS}]*\1){{2,}}"
THRESHOLD = 35


def leakage(translation: Column, direction: Column) -> Column:
    """Whether a translation has too little of its target language."""
    han, latin = T.han_count(translation), T.latin_count(translation)
    to_zh = (F.length(translation) >= 30) & (han < F.greatest(F.lit(3), F.floor(latin / 8)))
    to_en = (F.length(translation) >= 20) & (latin < F.greatest(F.lit(3), F.floor(han / 3)))
    return F.when(direction == "en-zh", to_zh).otherwise(to_en)


def repetition(c: Column) -> Column:
    return c.rlike(REPEATED_WORD) | c.rlike(REPEATED_PHRASE)


def _missing(values: Column, where: Column) -> Column:
    return F.filter(values, lambda v: ~F.contains(where, v))


def _any_term(terms: Column, where: Column, present: bool = True) -> Column:
    low = F.lower(where)
    test = (lambda x: (x != "") & F.contains(low, F.lower(x))) if present else (lambda x: (x != "") & ~F.contains(low, F.lower(x)))
    return F.coalesce(F.exists(terms, test), F.lit(False))


def issues(source: Column, translation: Column, direction: Column, ambiguous: Column | None = None, forbidden: Column | None = None) -> Column:
    """array<struct<code, weight, critical>> in the order of the rules. Nulls count as empty texts."""
    source, translation = T.text(source), T.text(translation)
    none = F.array().cast("array<string>")
    zh = direction == "zh-en"
    ratio = T.visible_length(translation) / F.greatest(T.visible_length(source), F.lit(1))
    odd_ratio = F.when(direction == "en-zh", ~ratio.between(0.25, 2.2)).otherwise(~ratio.between(0.35, 3.2))
    rules = (
        ("empty", 100, True, ~translation.rlike(f"[^{T.WS}]")),
        ("long_paragraph", 35, False, F.length(source) >= F.when(zh, 100).otherwise(180)),
        ("complex_syntax", 35, False, F.regexp_count(source, F.lit(CLAUSE)) >= F.when(zh, 2).otherwise(4)),
        ("ambiguous_term", 35, False, _any_term(none if ambiguous is None else ambiguous, source)),
        ("entity_consistency", 35, False, F.size(T.entities(source)) >= 2),
        ("semantic_domain", 35, False, zh & source.rlike(SEMANTIC_RISK)),
        ("technical_density", 35, False, F.size(T.acronyms(source)) >= 2),
        ("missing_number", 55, True, F.size(_missing(T.numbers(source), translation)) > 0),
        ("missing_acronym", 35, True, F.size(_missing(T.acronyms(source), translation)) > 0),
        ("language_leakage", 45, True, leakage(translation, direction)),
        ("repetition", 45, True, repetition(translation)),
        ("prompt_leakage", 70, True, translation.rlike(PROMPT_LEAK)),
        ("forbidden_literalism", 60, True, _any_term(none if forbidden is None else forbidden, translation)),
        ("length_ratio", 30, False, (translation != "") & odd_ratio),
    )
    one = [F.when(c, F.struct(F.lit(code).alias("code"), F.lit(w).alias("weight"), F.lit(x).alias("critical"))) for code, w, x, c in rules]
    return F.filter(F.array(*one), lambda i: i.isNotNull())


def assessed(rows: DataFrame, threshold: int = THRESHOLD, **terms: Column) -> DataFrame:
    """Adds issues, codes, score, has_critical, should_review to rows with source, prediction, direction."""
    found = rows.withColumn("issues", issues(F.col("source"), F.col("prediction"), F.col("direction"), **terms))
    score = F.least(F.lit(100), F.aggregate("issues", F.lit(0), lambda a, i: a + i["weight"]))
    with_score = found.withColumns({"codes": F.transform("issues", lambda i: i["code"]), "score": score, "has_critical": F.exists("issues", lambda i: i["critical"])})
    return with_score.withColumn("should_review", (F.col("score") >= max(1, threshold)) | F.col("has_critical"))


def review_stats(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("examined"), F.count_if("should_review").alias("triggered"), F.count_if("has_critical").alias("critical"), F.sum("score").alias("total_score"))


def issue_counts(rows: DataFrame, *by: str) -> DataFrame:
    return rows.select(*by, F.explode("codes").alias("code")).groupBy(*by, "code").agg(F.count("*").alias("n"))


def candidate_verdict(source: Column, draft: Column, candidate: Column, direction: Column, required: Column | None = None, forbidden: Column | None = None) -> Column:
    """struct(valid, reason): whether a reviewer's text may replace the draft, else the first rule against it."""
    source, draft, candidate = T.text(source), T.text(draft), T.text(candidate)
    none = F.array().cast("array<string>")
    n = F.length(draft)
    reason = first_reason(
        ("empty", ~candidate.rlike(f"[^{T.WS}]")),
        ("prompt_leakage", candidate.rlike(PROMPT_LEAK)),
        ("missing_number", F.size(_missing(T.numbers(source), candidate)) > 0),
        ("missing_acronym", F.size(_missing(T.acronyms(source), candidate)) > 0),
        ("required_term", _any_term(none if required is None else required, candidate, present=False)),
        ("forbidden_term", _any_term(none if forbidden is None else forbidden, candidate)),
        ("language_leakage", leakage(candidate, direction)),
        ("repetition", repetition(candidate)),
        ("shortened", F.length(candidate) < F.greatest(F.lit(2), F.floor(n * 0.35))),
        ("inflated", F.length(candidate) > F.greatest(F.lit(80), F.floor(n * 2.5))),
    )
    return F.struct(reason.isNull().alias("valid"), F.coalesce(reason, F.lit("ok")).alias("reason"))
