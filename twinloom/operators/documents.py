"""Documents as ordered lines or paragraphs: context, Markdown, packing, reassembly, cache."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinloom.functions import models
from twinloom.functions import text as T
from twinloom.operators import rules
from twinloom.session import keep

LINE_ENDS = r"\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"


def lines(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, line_no, body, ending of each line; the ending is the line feed or carriage return alone."""
    pieces = F.regexp_extract_all(T.text(F.col(text)), F.lit(f"(?:(?!{LINE_ENDS})(?s:.))*(?:{LINE_ENDS})|(?:(?!{LINE_ENDS})(?s:.))+$"), F.lit(0))
    rows = docs.select(key, F.posexplode(pieces).alias("line_no", "line"))
    body = F.regexp_replace("line", r"[\r\n]+$", "")
    return rows.select(key, "line_no", body.alias("body"), F.substring("line", F.length(body) + 1, F.length("line")).alias("ending"))


def paragraphs(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, para_no, body: paragraphs between blank lines."""
    return docs.select(key, F.posexplode(F.split(T.text(F.col(text)), "\n\n")).alias("para_no", "body"))


def with_context(rows: DataFrame, key: str, order: str = "para_no", width: int = 600) -> DataFrame:
    """Adds the end of the paragraph before and the start of the one after."""
    w = Window.partitionBy(key).orderBy(order)
    before, after = T.strip(F.lag("body").over(w)), T.strip(F.lead("body").over(w))
    return rows.withColumns({"previous": F.right(before, F.lit(width)), "next": F.left(after, F.lit(width))})


def fenced(rows: DataFrame, key: str, order: str = "line_no") -> DataFrame:
    """Adds `is_fence` and `in_fence` to lines of Markdown."""
    marked = rows.withColumn("is_fence", F.ltrim("body").startswith("```"))
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return marked.withColumn("in_fence", F.coalesce(F.sum(F.col("is_fence").cast("int")).over(w) % 2 == 1, F.lit(False)))


def line_parts(docs: DataFrame, key: str, direction: str, text: str = "text") -> DataFrame:
    """key, line_no, part_no, part, to_translate: the lines of Markdown documents in parts that give them back in order.

    Lines of fenced code and lines that need no translation are one part; others are prefix, pieces with what is kept
    between them, and line end.
    """
    rows = fenced(lines(docs, key, text), key)
    part = lambda t, flag: F.struct(t.alias("part"), flag.alias("to_translate"))
    no = F.lit(False)
    wanted = ~F.col("is_fence") & ~F.col("in_fence") & T.should_translate(F.col("body"), direction)
    m = rows.withColumn("m", T.markdown(F.col("body")))
    inner = F.flatten(F.transform("m.pieces", lambda p, i: F.array(part(p, T.should_translate(p, direction)), part(F.coalesce(F.get("m.kept", i), F.lit("")), no))))
    parts = F.when(wanted, F.concat(F.array(part(F.col("m.prefix"), no)), inner, F.array(part(F.col("ending"), no)))).otherwise(F.array(part(F.concat("body", "ending"), no)))
    return m.select(key, "line_no", F.posexplode(parts).alias("part_no", "p")).select(key, "line_no", "part_no", "p.*")


def translate_markdown(docs: DataFrame, key: str, direction: str, make, cache: DataFrame | None = None, text: str = "text") -> DataFrame:
    """key, text of Markdown documents with their translatable pieces put through a predictor (see `models.predict`).

    The predictor sees each distinct piece that the cache lacks once, without the white space around it, which stays.
    Pieces come back to their places by their digest, and each document is put together in one shuffle.
    """
    parts = keep(line_parts(docs, key, direction, text))
    peeled = parts.where("to_translate").withColumn("peel", T.peel(F.col("part")))
    pieces = peeled.select(F.col("peel.core").alias("source")).distinct()
    known = look_up(pieces, cache, "source") if cache is not None else pieces.withColumn("cached", F.lit(None).cast("string"))
    known = keep(known)
    fresh = models.predict(missing_once(known, "source"), make, "source", "output")
    answers = known.where("cached IS NOT NULL").select("source", F.col("cached").alias("output")).unionAll(fresh)
    done = peeled.join(answers, F.col("peel.core") == F.col("source")).select(key, "line_no", "part_no", F.concat("peel.leading", "output", "peel.trailing").alias("part"))
    every = parts.where("NOT to_translate").select(key, "line_no", "part_no", "part").unionAll(done)
    return reassemble(every.withColumn("place", F.struct("line_no", "part_no")), key, "place", "part")


def within_budget(rows: DataFrame, key: str, budget: int, order: str = "para_no") -> DataFrame:
    """The first paragraphs of each document until their length reaches the budget; blank ones don't count."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    filled = rows.where(F.col("body").rlike(f"[^{T.WS}]"))
    return filled.withColumn("_before", F.coalesce(F.sum(F.length("body")).over(w), F.lit(0))).where(F.col("_before") < budget).drop("_before")


def sample_of(rows: DataFrame, key: str, budget: int, order: str = "para_no") -> DataFrame:
    """key, text: the first paragraphs of each document, one to a line, cut at the budget."""
    return reassemble(within_budget(rows, key, budget, order), key, order, "body", "\n").withColumn("text", F.left("text", F.lit(budget)))


def reassemble(rows: DataFrame, key: str, order: str, text: str, separator: str = "") -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct(order, F.coalesce(text, F.lit("")).alias("t"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p["t"]), separator).alias("text"))


def pack(parts: Column, limit: int, separator: str = "", size=F.length) -> Column:
    """Joins parts greedily while the size of what is joined stays within the limit. `size` counts tokens; characters by default."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc, part):
        joined = F.when(acc["open"] == "", part).otherwise(F.concat(acc["open"], F.lit(separator), part))
        full = (acc["open"] != "") & (size(joined) > limit)
        return F.struct(F.when(full, F.array_append(acc["done"], acc["open"])).otherwise(acc["done"]).alias("done"), F.when(full, part).otherwise(joined).alias("open"))

    return F.aggregate(parts, start, step, lambda acc: F.filter(F.when(acc["open"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])), lambda x: x != ""))


def hard_split(c: Column, limit: int) -> Column:
    """Windows of fixed size in characters."""
    starts = F.when(F.length(c) > 0, F.sequence(F.lit(1), F.length(c), F.lit(limit))).otherwise(F.array().cast("array<int>"))
    return F.filter(F.transform(starts, lambda i: T.strip(F.substr(c, i, F.lit(limit)))), lambda x: x != "")


def split_for_model(c: Column, limit: int, direction: str, size=F.length) -> Column:
    """A text whole if it fits, else its sentences, long ones by clauses and hard windows, packed again."""
    whole = T.strip(c)

    def cut(sentence):
        parts = F.transform(pack(F.filter(T.clauses(sentence), lambda x: x != ""), limit, "", size), lambda p: F.when(size(p) <= limit, F.array(T.strip(p))).otherwise(hard_split(p, limit)))
        return F.when(size(sentence) <= limit, F.array(sentence)).otherwise(F.flatten(parts))

    pieces = F.filter(F.flatten(F.transform(T.sentences(whole, direction), cut)), lambda x: x != "")
    packed = pack(pieces, limit, " " if direction == "en-zh" else "", size)
    return F.when(whole == "", F.array().cast("array<string>")).when(size(whole) <= limit, F.array(whole)).otherwise(packed)


def _json(values: Column) -> Column:
    """A list of strings as JSON with a space after each comma."""
    return F.concat(F.lit("["), F.array_join(F.transform(values, lambda x: F.regexp_extract(F.to_json(F.array(x)), r"(?s)^\[(.*)\]$", 1)), ", "), F.lit("]"))


def context_of(docs: DataFrame, key: str, text: str = "text", direction: Column | None = None, glossary: list[dict] | None = None, context_rules: list[dict] | None = None) -> DataFrame:
    """Per document its acronyms and names (of English sources only) in order of occurrence, the glossary terms that it
    holds, and a fingerprint of them. Context rules whose source and context the document holds count as terms, after
    (and instead of equal) glossary entries."""
    direction = T.direction_of(F.col(text)) if direction is None else direction
    none = F.array().cast("array<struct<source: string, target: string>>")
    given = F.array(*(F.struct(F.lit(e["source"]).alias("source"), F.lit((e.get("target") or "").strip()).alias("target")) for e in glossary)) if glossary else none
    ruled = rules.document_rules(T.text(F.col(text)), context_rules or [])
    low = F.lower(T.text(F.col(text)))
    by_rule = lambda e: F.exists(F.col("_ruled"), lambda r: r["source"] == e["source"])
    rows = docs.withColumn("_ruled", ruled).select(
        key,
        F.when(direction == "en-zh", T.entities(F.col(text))).otherwise(F.array().cast("array<string>")).alias("entities"),
        T.acronyms(F.col(text)).alias("acronyms"),
        F.concat(F.filter(given, lambda e: (e["target"] != "") & F.contains(low, F.lower(e["source"])) & ~by_rule(e)), F.col("_ruled")).alias("glossary"),
    )
    pairs = F.concat(F.lit("["), F.array_join(F.transform("glossary", lambda e: _json(F.array(e["source"], e["target"]))), ", "), F.lit("]"))
    payload = F.concat(F.lit('{"acronyms": '), _json(F.col("acronyms")), F.lit(', "entities": '), _json(F.col("entities")), F.lit(', "glossary": '), pairs, F.lit(', "version": 2}'))
    return rows.withColumn("fingerprint", F.sha2(payload, 256))


def paragraph_key(fingerprint: Column, reviewed: bool = False) -> Column:
    """Cache key of a paragraph without the white space around it, with its context."""
    return F.sha2(F.to_json(F.struct(fingerprint.alias("document"), F.lit("reviewed-paragraph").alias("kind"), F.col("next"), F.col("previous"), F.lit(reviewed).alias("reviewer_enabled"), T.peel(F.col("body"))["core"].alias("source"))), 256)


def signature(settings: dict) -> str:
    """Signature of a pipeline's settings (model, revision, search, glossary, rules, reviewer): cache lines of other settings don't count."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True).encode("utf-8")).hexdigest()


def latest(cache: DataFrame, signature: str | None = None) -> DataFrame:
    """key, translation: the last written line of each key. Lines without a key don't count; a null text is empty."""
    rows = cache.where("key IS NOT NULL")
    if signature is not None:
        rows = rows.where(F.col("signature") == signature)
    return rows.groupBy("key").agg(F.max_by(F.coalesce("translation", F.lit("")), "line_no").alias("translation"))


def look_up(texts: DataFrame, cache: DataFrame, text: str = "text") -> DataFrame:
    """Adds `cached`: the translation on file for a text, null if there is none. Texts are looked up once per distinct text."""
    keyed = texts.withColumn("_key", F.sha2(F.col(text), 256))
    known = keyed.select("_key").distinct().join(cache.select(F.col("key").alias("_key"), F.col("translation").alias("cached")), "_key")
    return keyed.join(known, "_key", "left").drop("_key")


def missing_once(texts: DataFrame, text: str = "text") -> DataFrame:
    """The distinct texts that the cache lacks: what a model has to be run on."""
    return texts.where("cached IS NULL").select(text).distinct()


def numbered(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Adds `number`: the place of each row within its key, from 0, without gathering a key in one task.

    Rows are cut into ranges of (key, order), which are kept; numbers run within a range and go on from those before it.
    `order` must be unique within a key; rows of equal order are numbered arbitrarily.
    """
    ranges = keep(rows.repartitionByRange(F.col(key), F.col(order)).withColumn("_range", F.spark_partition_id()))
    sizes = ranges.groupBy(key, "_range").agg(F.count("*").alias("_n"))  # a row per range and key
    before = sizes.select(F.col(key).alias("_key"), F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    joined = ranges.join(before, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_r")))
    within = F.row_number().over(Window.partitionBy(key, "_range").orderBy(order)) - 1
    return joined.withColumn("number", within + F.col("_before")).drop("_key", "_r", "_range", "_before")


def micro_batches(rows: DataFrame, size: int, key: str, order: str, length: Column) -> DataFrame:
    """Adds the batch number within each key and the batch's longest length (dynamic padding)."""
    batched = numbered(rows.withColumn("length", length), key, order).withColumn("batch", F.floor(F.col("number") / size)).drop("number")
    return batched.withColumn("batch_length", F.max("length").over(Window.partitionBy(key, "batch")))
