"""Glossaries and context rules over texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinloom.functions import text as T


def glossary_hits(texts: DataFrame, glossary: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, source, target of each glossary entry that a text contains, in any letter case.

    A glossary is a rule table; it is not broadcast by hand: Spark does so under its own size limit, and otherwise
    falls back to a partitioned nested loop.
    """
    terms = glossary.select(F.lower("source").alias("_term"), "source", "target", "direction").where("_term <> ''").dropDuplicates(["_term", "target", "direction"])
    return texts.join(terms, F.contains(F.lower(F.col(text)), F.col("_term")) & (texts["direction"] == terms["direction"])).select(texts[key], "source", "target")


def _strings(values) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def apply_context_rules(c: Column, rules: list[dict]) -> Column:
    """struct(text, aliases, required, forbidden): ordered rules, one fold over a literal table of them.

    A rule fires if its source stands as a word in the text as rewritten so far and its context in the original. The
    fold names each step's text once, so the expression grows with the number of rules only.
    """
    if not rules:
        return F.struct(T.text(c).alias("text"), *(_strings([]).alias(x) for x in ("aliases", "required", "forbidden")))
    table = F.array(
        *(
            F.struct(
                F.lit(T.term_pattern(r["source"])).alias("word"),
                F.lit(r["rewrite"].replace("\\", "\\\\").replace("$", "\\$")).alias("rewrite"),
                F.lit(r["target"]).alias("target"),
                _strings([f"{a}\t{r['target']}" for a in r.get("aliases", [])]).alias("aliases"),
                _strings([T.context_pattern(v) for v in r.get("when_any", [])]).alias("when"),
                _strings([T.context_pattern(v) for v in r.get("unless_any", [])]).alias("unless"),
                _strings(r.get("forbidden_output_any", [])).alias("forbidden"),
            )
            for r in rules
        )
    )
    original = T.text(c)

    def step(acc: Column, r: Column) -> Column:
        context = (F.size(r["when"]) == 0) | F.exists(r["when"], lambda v: F.rlike(original, v))
        fires = F.rlike(acc["text"], r["word"]) & context & ~F.exists(r["unless"], lambda v: F.rlike(original, v))
        fired = F.struct(
            F.regexp_replace(acc["text"], r["word"], r["rewrite"]).alias("text"),
            F.concat(acc["aliases"], r["aliases"]).alias("aliases"),
            F.array_append(acc["required"], r["target"]).alias("required"),
            F.concat(acc["forbidden"], r["forbidden"]).alias("forbidden"),
        )
        return F.when(fires, fired).otherwise(acc)

    start = F.struct(original.alias("text"), *(_strings([]).alias(x) for x in ("aliases", "required", "forbidden")))
    return F.aggregate(table, start, step, lambda acc: F.struct(acc["text"].alias("text"), *(F.array_distinct(acc[x]).alias(x) for x in ("aliases", "required", "forbidden"))))


def document_rules(text: Column, rules: list[dict]) -> Column:
    """array<struct<source, target>> of the rules whose source and context a whole document holds."""
    found = []
    for r in rules:
        fires = text.rlike(T.term_pattern(r["source"]))
        if r.get("when_any"):
            fires = fires & reduce(lambda a, b: a | b, (T.context_matches(text, v) for v in r["when_any"]))
        if r.get("unless_any"):
            fires = fires & ~reduce(lambda a, b: a | b, (T.context_matches(text, v) for v in r["unless_any"]))
        found.append(F.when(fires, F.struct(F.lit(r["source"]).alias("source"), F.lit(r["target"]).alias("target"))))
    return F.filter(F.array(*found), lambda x: x.isNotNull()) if found else F.array().cast("array<struct<source: string, target: string>>")


def protect_glossary(c: Column, glossary: list[dict], direction: str) -> Column:
    """struct(text, aliases): longest terms first; Chinese sources get the English term, English ones stay as they are."""
    entries = sorted(glossary, key=lambda e: len(e["source"]), reverse=True)
    none = F.array().cast("array<string>")
    lists = [F.array(*(F.lit(f"{a}\t{e['target']}") for a in e.get("aliases") or [])) if e.get("aliases") else none for e in entries]
    table = F.array(*(F.struct(F.lit(e["source"]).alias("source"), F.lit(e["target"]).alias("target"), F.lit(T.term_pattern(e["source"])).alias("word"), x.alias("aliases")) for e, x in zip(entries, lists, strict=True)))

    def step(acc: Column, e: Column) -> Column:
        # one fold over a literal table, so the expression doesn't grow with the glossary
        present = F.contains(acc["text"], e["source"]) if direction == "zh-en" else F.rlike(acc["text"], e["word"])
        changed = F.replace(acc["text"], e["source"], e["target"]) if direction == "zh-en" else acc["text"]
        return F.struct(F.when(present, changed).otherwise(acc["text"]).alias("text"), F.when(present, F.concat(acc["aliases"], e["aliases"])).otherwise(acc["aliases"]).alias("aliases"))

    return F.aggregate(table, F.struct(T.text(c).alias("text"), none.alias("aliases")), step)


def restore_glossary(c: Column, aliases: Column) -> Column:
    """Replaces the aliases that a text's rules named ("alias<tab>target") by their targets, the longest first.

    An alias named more than once has the target it was last given.
    """
    first = lambda x: F.substring_index(x, "\t", 1)
    last = F.filter(aliases, lambda x, i: ~F.exists(F.slice(aliases, i + 2, F.size(aliases)), lambda y: first(y) == first(x)))
    ordered = F.array_sort(F.transform(last, lambda x, i: F.struct((-F.length(first(x))).alias("n"), i.alias("i"), first(x).alias("alias"), F.substring_index(x, "\t", -1).alias("target"))))

    def step(text: Column, e: Column) -> Column:
        word = F.concat(F.lit(r"(?iU)(?<!\w)\Q"), e["alias"], F.lit(r"\E(?!\w)"))
        by = F.regexp_replace(e["target"], r"([\\$])", r"\\$1")
        return F.when(e["alias"].rlike(f"[{T.HAN_WIDE}]"), F.replace(text, e["alias"], e["target"])).otherwise(F.regexp_replace(text, word, by))

    return F.aggregate(ordered, T.text(c), step)
