"""Hooks for models: batch predictors and reviewers run once per task over Arrow batches."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

from twinloom.functions import text as T


def predict(rows: DataFrame, make: Callable[[], Callable[[list[str]], list[str]]], text: str, output: str, batch: int = 64) -> DataFrame:
    """Adds `output`: what the predictor that `make` loads (once per task) says of each text, in micro-batches."""
    schema = t.StructType([*rows.schema.fields, t.StructField(output, t.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for pdf in batches:
            values = pdf[text].fillna("").tolist()
            yield pdf.assign(**{output: [y for i in range(0, len(values), batch) for y in model(values[i : i + batch])]})

    return rows.mapInPandas(run, schema)


def review(rows: DataFrame, make: Callable[[], Callable[[str, str], str]], source: str, draft: str, seconds: float = 180.0) -> DataFrame:
    """Adds `reviewed` and `review_status`: reviewed, or why the draft stands (unavailable, timeout, empty).

    Answers are taken out of their tags. A reviewer that fails once is not asked again in its task.
    """
    schema = t.StructType([*rows.schema.fields, t.StructField("_answer", t.StringType()), t.StructField("review_status", t.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            model = make()
        except Exception:
            model = None
        for pdf in batches:
            texts, states = [], []
            for s, d in zip(pdf[source], pdf[draft], strict=True):
                answer, state, began = None, "unavailable", time.monotonic()
                if model is not None:
                    try:
                        answer, state = model(s, d), "reviewed"
                        if time.monotonic() - began > seconds:
                            answer, state = None, "timeout"
                    except Exception:
                        model = None
                texts.append(answer)
                states.append(state)
            yield pdf.assign(_answer=texts, review_status=states)

    answered = rows.mapInPandas(run, schema).withColumn("_answer", T.tagged_translation(F.col("_answer")))
    blank = (F.col("_answer") == "") & (F.col("review_status") == "reviewed")
    status = F.when(blank, "empty").otherwise(F.col("review_status"))
    return answered.withColumns({"reviewed": F.when(status == "reviewed", F.col("_answer")).otherwise(F.col(draft)), "review_status": status}).drop("_answer")


def review_counts(rows: DataFrame, *by: str) -> DataFrame:
    """How often a reviewer was asked, answered and fell back, and why."""
    return rows.groupBy(*by, "review_status").agg(F.count("*").alias("n"))


def prompt(context: DataFrame, names: int = 30, terms: int = 40) -> DataFrame:
    """Adds `prompt`: a document's names, acronyms and terms, at most so many of each, or a mark for none."""
    parts = [(F.lit("专名："), "entities", names), (F.lit("缩写："), "acronyms", names), (F.lit("术语："), "glossary", terms)]
    blocks = [F.when(F.size(c) > 0, F.concat(label, F.array_join(F.slice(c, 1, n), "；"))) for label, c, n in parts if c in context.columns]
    return context.withColumn("prompt", F.coalesce(F.nullif(F.concat_ws("\n", *blocks), F.lit("")), F.lit("无")))
