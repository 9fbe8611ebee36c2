"""Sources and sinks: Parquet and JSON-lines corpora, cache logs, text and DOCX documents, metadata and reports."""

from __future__ import annotations

import io
import json
import os
import re
import zipfile
from collections.abc import Iterator
from pathlib import PurePosixPath
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinloom.functions import models
from twinloom.functions import text as T
from twinloom.operators.corpus import require

TEXT_SUFFIXES, DOCX = (".txt", ".md", ".markdown"), ".docx"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
CACHE_SCHEMA = "signature string, key string, translation string"


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet corpus; only the pair column is read unless others are asked for."""
    return require(spark.read.parquet(path), "translation").select("translation")


def pairs_from_json(payload, rows: DataFrame) -> DataFrame:
    """Adds `translation` struct<zh_CN, en_GB> parsed from JSON objects in any accepted shape; null where broken."""
    names = {"zh_CN": ("zh_CN", "zh", "zh-CN"), "en_GB": ("en_GB", "en", "en-US")}
    keys = [x for g in names.values() for x in g]
    schema = f"translation struct<{', '.join(f'`{k}`: string' for k in keys)}>, {', '.join(f'`{k}` string' for k in keys)}, _broken string"
    row = F.from_json(payload, schema, {"columnNameOfCorruptRecord": "_broken"})
    sides = [F.coalesce(*(F.nullif(v, F.lit("")) for k in group for v in (row["translation"][k], row[k]))).alias(name) for name, group in names.items()]
    return rows.withColumn("translation", F.when(payload.isNotNull() & row["_broken"].isNull(), F.struct(*sides)))


def cache_log(spark: SparkSession, path: str) -> DataFrame:
    """A cache log in JSON lines with `line_no`; undecodable lines are skipped, missing fields are empty.

    Lines are numbered in file order: file by file, and within a file by the place of the line.
    """
    raw = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("line_no"))
    row = F.from_json("value", CACHE_SCHEMA + ", _broken string", {"columnNameOfCorruptRecord": "_broken"})
    parsed = raw.select("line_no", row.alias("r")).where("r IS NOT NULL AND r._broken IS NULL")
    return parsed.select("line_no", *(F.coalesce(f"r.{c}", F.lit("")).alias(c) for c in ("signature", "key", "translation")))


def _json_of(spark: SparkSession, path: str):
    """A JSON file of parameters (rules, lists), which the driver reads whole."""
    return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))


def blacklist(spark: SparkSession, path: str) -> tuple[DataFrame, tuple[str, ...]]:
    """Pair hashes (column pair_hash, of listed hashes and listed pairs) and patterns against sources. Incomplete pairs don't count."""
    raw = _json_of(spark, path)
    listed = spark.createDataFrame([(str(h),) for h in raw.get("pair_hashes", [])], "pair_hash string")
    pairs = [(str(p.get("source", "")).strip(), str(p.get("target", "")).strip()) for p in raw.get("exact_pairs", [])]
    exact = spark.createDataFrame([p for p in pairs if all(p)], "source string, target string").select(T.pair_hash(F.col("source"), F.col("target")).alias("pair_hash"))
    return listed.unionAll(exact).distinct(), tuple(str(p) for p in raw.get("source_patterns", []) if str(p))


def glossary(spark: SparkSession, path: str) -> list[dict]:
    """source, target, aliases of each entry in order; entries are a target or an object with target and aliases."""
    raw = _json_of(spark, path)
    if not isinstance(raw, dict):
        raise ValueError(f"a glossary must be a JSON object: {path}")
    entries = []
    for source, rule in raw.items():
        if not isinstance(rule, str | dict):
            raise ValueError(f"glossary entry {source!r} must be a text or an object")
        target, aliases = (rule, []) if isinstance(rule, str) else (str(rule.get("target", "")), [str(a) for a in rule.get("aliases", []) if str(a)])
        if source and target:
            entries.append({"source": source, "target": target, "aliases": aliases})
    return entries


def context_rules(spark: SparkSession, path: str) -> list[dict]:
    """Ordered context rules; the rewriting is the source itself where none is given."""
    raw = _json_of(spark, path)
    if not isinstance(raw, list) or not all(isinstance(r, dict) for r in raw):
        raise ValueError(f"context rules must be a JSON array of objects: {path}")
    known = []
    for no, rule in enumerate(raw, 1):
        named = {k: str(rule.get(k, d)).strip() for k, d in (("source", ""), ("target", ""), ("rewrite", rule.get("source", "")))}
        if not all(named.values()):
            raise ValueError(f"context rule {no} lacks source, rewrite or target")
        known.append(named | {k: [str(v) for v in rule.get(k, []) if str(v)] for k in ("aliases", "when_any", "unless_any", "forbidden_output_any")})
    return known


def mixture_sources(spark: SparkSession, path: str) -> tuple[list[dict], dict[str, float]]:
    """path, weight, domain of each source of a selection, and the greatest fraction of each capped domain."""
    raw = _json_of(spark, path)
    sources = [{"path": str(s["path"]), "weight": float(s.get("weight", 1.0)), "domain": str(s.get("domain", "general"))} for s in raw.get("sources", [])]
    caps = {str(k): float(v) for k, v in raw.get("max_domain_fractions", {}).items()}
    if any(s["weight"] < 0 for s in sources) or not all(0 <= v <= 1 for v in caps.values()):
        raise ValueError("weights must not be negative, fractions must lie between 0 and 1")
    return sources, caps


def kind_of(path: str) -> str:
    suffix = PurePosixPath(path).suffix.lower()
    if suffix not in (*TEXT_SUFFIXES, DOCX):
        raise ValueError(f"unsupported document: {path}")
    return "docx" if suffix == DOCX else "text"


def texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text of whole text or Markdown files without a byte order mark."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", r"^\x{feff}", "").alias("text"))


def _parts(z: zipfile.ZipFile) -> list[str]:
    names = z.namelist()
    rest = sorted(n for n in names if re.fullmatch(r"word/(?:header|footer)\d*\.xml", n))
    return [n for n in ("word/document.xml", *rest) if n in names]


def docx_paragraphs(content: bytes) -> list[str]:
    """Texts of the body's paragraphs, then tables, then headers and footers."""
    out: list[str] = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for part in _parts(z):
            root = ElementTree.fromstring(z.read(part))
            in_table = {id(p) for t in root.iter(f"{_W}tbl") for p in t.iter(f"{_W}p")}
            every = list(root.iter(f"{_W}p"))
            for p in [x for x in every if id(x) not in in_table] + [x for x in every if id(x) in in_table]:
                out.append("".join(t.text or "" for t in p.iter(f"{_W}t")))
    return out


def docx(spark: SparkSession, path: str) -> DataFrame:
    """path, para_no, body of DOCX files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                body = docx_paragraphs(bytes(content))
                yield pd.DataFrame({"path": p, "para_no": range(len(body)), "body": body})

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path).select("path", "content").mapInPandas(run, "path string, para_no int, body string")


def rewrite_docx(content: bytes, translated: dict[str, str]) -> bytes:
    """Puts a paragraph's translation into its first text run and empties the others; fields stay as they are."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as w:
        chosen = set(_parts(z))
        for name in z.namelist():
            data = z.read(name)
            if name in chosen:
                root = ElementTree.fromstring(data)
                for p in root.iter(f"{_W}p"):
                    runs = list(p.iter(f"{_W}t"))
                    whole = "".join(t.text or "" for t in runs)
                    if runs and whole in translated and next(p.iter(f"{_W}instrText"), None) is None:
                        for i, t in enumerate(runs):
                            t.text = translated[whole] if i == 0 else ""
                data = ElementTree.tostring(root, encoding="utf-8", xml_declaration=True)
            w.writestr(name, data)
    return out.getvalue()


def translate_docx(spark: SparkSession, path: str, make, direction: str) -> DataFrame:
    """path, content of DOCX files with their paragraphs put through a predictor; each distinct paragraph once per task group."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path).select("path", "content")
    wanted = docx(spark, path).where(T.should_translate(F.col("body"), direction)).select("path", "body").distinct()
    answers = models.predict(wanted.select("body").distinct(), make, "body", "output")
    tables = wanted.join(answers, "body").groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("body", "output"))).alias("translated"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            table = [dict(t) if t is not None else {} for t in pdf["translated"]]
            yield pd.DataFrame({"path": pdf["path"], "content": [rewrite_docx(bytes(c), t) for c, t in zip(pdf["content"], table, strict=True)]})

    return files.join(tables, "path", "left").mapInPandas(run, "path string, content binary")


def output_name(path: str, direction: str) -> str:
    p = PurePosixPath(path)
    return str(p.with_name(f"{p.stem}.{'en' if direction == 'zh-en' else 'zh'}{p.suffix}"))


def refuse_overwriting(source: str, output: str) -> str:
    """The output's name, if nothing is there and it isn't the source."""
    if os.path.abspath(source) == os.path.abspath(output):
        raise ValueError("the output must not replace its source")
    if os.path.exists(output):
        raise FileExistsError(output)
    return output


def cache_name(path: str) -> str:
    return f"{path}.translation-cache.jsonl"


def write_corpus(rows: DataFrame, path: str) -> None:
    """Parquet in the pair shape; fails if the path exists."""
    rows.select(F.struct(F.col("zh").alias("zh_CN"), F.col("en").alias("en_GB")).alias("translation")).write.mode("error").parquet(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("error").json(path)


def append_cache(rows: DataFrame, path: str) -> None:
    rows.select("signature", "key", "translation").write.mode("append").option("ignoreNullFields", "false").json(path)


def write_text(path: str, text: str) -> None:
    """Replaces a file of the driver in one step."""
    temporary = f"{path}.tmp"
    with open(temporary, "w", encoding="utf-8", newline="") as f:
        f.write(text)
    os.replace(temporary, path)
