"""Language of each text and of each segment of a mixed text, with a confidence (problem 1).

Sparse multinomial logistic regression on TF-IDF character n-grams (orders 1 to 4, hashed), trained with
follow-the-regularised-leader under an elastic-net penalty, then temperature calibration on texts that were held out.
The model is fitted on a bounded sample of labelled texts (`SAMPLE_PER_LANGUAGE` texts of each language and table, each
of at most `LONGEST_EXAMPLE` characters, and of each text `SENTENCES` sentences drawn from all of it); every text is
classified whole. TF-IDF vectors are scaled to a sum of one, so a unit's score is a plain sum over its n-grams divided
by their summed idf: two table look-ups per n-gram, no sparse vectors, no Python per character.

The language of a sentence comes from its own score, what its length makes that worth and the language most of its text
is in; which that is depends on the text's label too, if it has one. The temperature turns the sum into a confidence; it is fitted with
all of these in place but the label, on all sentences of the held-out texts. As labels are partly wrong and texts partly
mixed, the rates of both are estimated along with it.

Null and blank texts give no rows. Texts without letters give no rows either: they are in no language. Only languages
that some text is labelled with can be told.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinloom.llm import _codes as K

LANGUAGES = ("zh", "en", "ja", "ko", "fr", "de", "es", "ru")
ORDERS, BITS, SCALE = (1, 2, 3, 4), 18, 32.0
#: Labelled texts taken per language and table to fit the classifier, and sentences of each, drawn from the whole text.
SAMPLE_PER_LANGUAGE, SENTENCES = 400, 8
#: One text in so many of the sample is held out for the calibration.
HELD_OUT = 6
#: Longer texts are classified like any other, but not drawn as examples, so the sample is bounded in size too.
LONGEST_EXAMPLE = 20_000
#: A segment is a sentence or more: at least so many letters (a Han, Kana or Hangul character counts as WIDE letters).
LEAST_LETTERS, WIDE = 25, 2.5
#: Letters of a usual sentence; what the score of the language most of a text is in is raised by, and what that of the
#: language it is labelled with when it is asked which that is.
USUAL_LETTERS, DOMINANT, LABELLED = 40, 4.5, 3.0


@dataclass(frozen=True)
class LanguageModel:
    """`table` holds, per bucket, idf times the weight of each language, and the idf itself in the last column."""

    table: np.ndarray
    languages: tuple[str, ...]
    temperature: float


def normal_label(label):
    """`zh_CN`, `ZH` and `zh-Hans` are `zh`; null, empty and `und` are null (no label)."""
    base = F.regexp_replace(F.lower(F.trim(label)), "[-_].*$", "")
    return F.when((base == "") | (base == "und"), None).otherwise(base)


def _plain(text: str) -> str:
    return text if text.isascii() else unicodedata.normalize("NFKC", text).lower() if not text.islower() else unicodedata.normalize("NFKC", text)


def _units(texts: list[str]):
    texts = [_plain(t).lower() for t in texts]
    codes, starts = K.encode(texts)
    at = K.sentence_starts(codes, starts)
    kind = K.kind_of(codes)
    wide = K.unit_counts((kind == K.HAN) | (kind == K.KANA) | (kind == K.HANGUL), at)
    letters = K.unit_counts(kind == K.LETTER, at) + WIDE * wide
    owner = np.searchsorted(starts, at, "right") - 1
    # digits, punctuation and layout say nothing about a language
    codes = np.where((kind < K.LETTER) | (kind >= K.DIGIT), np.where(codes == K.SEP, codes, np.uint32(32)), codes)
    return codes, at, owner, letters, starts


def _features(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    idx = np.concatenate([b for _, b in K.ngram_buckets(codes, ORDERS, BITS)])
    return np.unique(idx, return_counts=True)


def _softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


class _Ftrl:
    """FTRL-proximal for multinomial logistic regression with an elastic-net penalty (l1, l2), a mini-batch a step."""

    def __init__(self, n_out: int, idf: np.ndarray, alpha: float = 0.4, beta: float = 0.5, l1: float = 0.03, l2: float = 0.03):
        self.z, self.n = np.zeros((1 << BITS, n_out), np.float32), np.zeros((1 << BITS, n_out), np.float32)
        self.idf, self.alpha, self.beta, self.l1, self.l2 = idf, alpha, beta, l1, l2

    def weights(self, idx) -> np.ndarray:
        return self._solve(self.z[idx], np.sqrt(self.n[idx]))

    def _solve(self, z: np.ndarray, root: np.ndarray) -> np.ndarray:
        # what is left of z beyond the l1 penalty
        return (np.clip(z, -self.l1, self.l1) - z) / (root / self.alpha + np.float32(self.beta / self.alpha + self.l2))

    def _batch(self, rows: list):
        """Bucket and value of each entry, and where each row starts."""
        idx = np.concatenate([r[0] for r in rows])
        x = np.concatenate([r[1] for r in rows]) * self.idf[idx]
        size = np.array([len(r[0]) for r in rows])
        at = np.append(0, np.cumsum(size)[:-1])
        return idx, (SCALE * x / np.repeat(np.add.reduceat(x, at), size)).astype(np.float32), at, size

    def scores(self, rows: list) -> np.ndarray:
        out = [np.add.reduceat(x[:, None] * self.weights(idx), at) for k in range(0, len(rows), 256) for idx, x, at, _ in (self._batch(rows[k : k + 256]),)]
        return np.concatenate(out) if out else np.zeros((0, self.z.shape[1]))

    def learn(self, rows: list, epochs: int, batch: int = 16) -> _Ftrl:
        labels = np.array([r[2] for r in rows])
        for _ in range(epochs):
            for k in range(0, len(rows), batch):
                idx, x, at, size = self._batch(rows[k : k + batch])
                own, where = np.unique(idx, return_inverse=True)
                z, n = self.z[own], self.n[own]
                root = np.sqrt(n)
                w = self._solve(z, root)
                p = _softmax(np.add.reduceat(x[:, None] * w[where], at))
                p[np.arange(len(size)), labels[k : k + batch]] -= 1
                each = x[:, None] * np.repeat(p, size, axis=0)
                order = np.argsort(where, kind="stable")
                g = np.add.reduceat(each[order], np.append(0, np.flatnonzero(np.diff(where[order])) + 1))
                grown = n + g * g
                self.z[own] = z + g - (np.sqrt(grown) - root) / self.alpha * w
                self.n[own] = grown
        return self


def _examples(texts: list[str], labels: list[int], languages: tuple[str, ...], rng: np.random.Generator):
    """Bucket, count and label of some sentences of each text, and the text each is from."""
    rows, source = [], []
    for i, (text, label) in enumerate(zip(texts, labels, strict=True)):
        codes, at, _, letters, _ = _units([text])
        bounds = np.append(at, len(codes))
        good = np.flatnonzero((letters >= LEAST_LETTERS) & _fits(codes, at, languages[label]))
        for k in rng.permutation(good)[:SENTENCES]:
            rows.append((*_features(np.append(codes[bounds[k] : bounds[k + 1]], np.full(K.PAD, K.SEP, np.uint32))), label))
            source.append(i)
    return rows, np.array(source, np.int64)


def _fits(codes: np.ndarray, at: np.ndarray, language: str) -> np.ndarray:
    """Whether each sentence is in its language's script; if not, it is mislabelled or foreign."""
    kind = K.kind_of(codes)
    han, kana, hangul, letter = (K.unit_counts(kind == k, at) for k in (K.HAN, K.KANA, K.HANGUL, K.LETTER))
    if language == "zh":
        return (han > letter / 3) & (kana == 0) & (hangul == 0)
    if language == "ja":
        return kana > 0
    return hangul > letter / 3 if language == "ko" else letter > han + kana + hangul


def fit(texts: list[str], labels: list[str], epochs: int = 4, folds: int = 2) -> LanguageModel:
    """Fits on sentences of the given texts. Labels are partly wrong and texts partly mixed, so each fold's sentences
    are first judged by a model of the other folds; a sentence it contradicts is no example. Texts held out from all of
    this serve the calibration, whatever their labels say."""
    languages = tuple(x for x in LANGUAGES if x in set(labels))
    if not languages:
        return LanguageModel(np.zeros((1 << BITS, 2), np.float32), ("und",), 1.0)
    rng = np.random.default_rng(7)
    numbers = [languages.index(x) for x in labels]
    held = np.array([i % HELD_OUT == HELD_OUT - 1 for i in range(len(texts))])
    if len({numbers[i] for i in np.flatnonzero(~held)}) < len(languages):
        held[:] = False
    learnt = np.flatnonzero(~held)
    rows, source = _examples([texts[i] for i in learnt], [numbers[i] for i in learnt], languages, rng)
    fold = source % folds
    df = np.zeros(1 << BITS, np.int64)
    for idx, _, _ in rows:
        df[idx] += 1
    idf = (np.log((1 + len(rows)) / (1 + df)) + 1).astype(np.float32)
    order = rng.permutation(len(rows))
    wanted = np.array([r[2] for r in rows], np.int64)
    kept = np.ones(len(rows), bool)
    for _ in range(2):  # the second time, the judges learn from what the first ones let pass
        passed = np.zeros(len(rows), bool)
        for f in range(folds):
            judge = _Ftrl(len(languages), idf).learn([rows[i] for i in order if fold[i] != f and kept[i]], 1)
            mine = np.flatnonzero(fold == f)
            passed[mine] = judge.scores([rows[i] for i in mine]).argmax(1) == wanted[mine]
        kept = passed
    good = order[kept[order]] if len(set(wanted[kept].tolist())) == len(set(wanted.tolist())) else order
    model = _Ftrl(len(languages), idf).learn([rows[i] for i in good], epochs)
    table = np.column_stack([model.weights(slice(None)) * idf[:, None], idf]).astype(np.float32)
    own = np.flatnonzero(held) if held.any() else np.arange(len(texts))
    return LanguageModel(table, languages, _temperature([texts[i] for i in own], [labels[i] for i in own], table, languages))


def _judged(texts: list[str], labels: list[str], model: LanguageModel):
    """Scores, letters, owners and labels of texts, and which sentences are long enough to be judged and in their label's script."""
    codes, at, owner, letters, raw = _scores(texts, model.table)
    label = np.array([model.languages.index(x) for x in labels])[owner]
    fits = np.zeros(len(at), bool)
    for k, name in enumerate(model.languages):
        fits |= (label == k) & _fits(codes, at, name)
    return raw, letters, owner, label, (letters >= LEAST_LETTERS) & fits


def _temperature(texts: list[str], labels: list[str], table: np.ndarray, languages: tuple[str, ...]) -> float:
    """The temperature under which the labels of all held-out texts are likeliest, whatever they say.

    Two rates of error are estimated beside it: of labels that are wrong for a whole text, and of sentences in another
    language than the rest of their text. Without them the temperature would answer for both.
    """
    raw, letters, owner, label, good = _judged(texts, labels, LanguageModel(table, languages, 1.0))
    if not good.any():
        return 1.0
    raw = _weighed(raw, letters, owner, len(texts))
    own, at = np.unique(owner[good], return_index=True)
    given = label[good][at]
    best = (np.inf, 1.0)
    for t in np.geomspace(0.1, 8, 30):
        prob = _softmax(raw[good] / t)
        for other in (0.001, 0.003, 0.01, 0.03, 0.1):
            # of each text, how likely its sentences are in each language
            whole = np.add.reduceat(np.log((1 - other) * prob + other / len(languages)), at)
            top = whole.max(1)
            part = np.exp(whole - top[:, None])
            right = part[np.arange(len(own)), given]
            wrong = (part.sum(1) - right) / max(1, len(languages) - 1)
            for rate in (0.003, 0.01, 0.03, 0.06, 0.1, 0.2):
                best = min(best, (-(np.log((1 - rate) * right + rate * wrong + 1e-300) + top).sum(), float(t)))
    return best[1]


def calibration(texts: list[str], labels: list[str], model: LanguageModel, bins: int = 10) -> float:
    """Expected calibration error over the sentences of labelled texts: mean difference of confidence and share right."""
    raw, letters, owner, label, good = _judged(texts, labels, model)
    prob = _softmax(_weighed(raw, letters, owner, len(texts))[good] / model.temperature)
    confidence, right = prob.max(1), prob.argmax(1) == label[good]
    bin_of = np.minimum((confidence * bins).astype(int), bins - 1)
    return float(np.abs(np.bincount(bin_of, confidence, bins) - np.bincount(bin_of, right, bins)).sum() / max(1, len(right)))


def _scores(texts: list[str], table: np.ndarray):
    codes, at, owner, letters, _ = _units(texts)
    sums = K.table_sums(codes, at, table, ORDERS, BITS)
    return codes, at, owner, letters, SCALE * sums[:, :-1] / np.maximum(sums[:, -1:], 1e-9)


def _weighed(raw: np.ndarray, letters: np.ndarray, owner: np.ndarray, n: int, label: np.ndarray | None = None) -> np.ndarray:
    """Scores with all that bears on them; `label` holds each text's labelled language, -1 if it has none."""
    # a score is a mean over n-grams: the fewer letters, the less it tells
    scores = raw * np.clip(np.sqrt(letters / USUAL_LETTERS), 0.3, 1.0)[:, None]
    given = scores.copy()
    if label is not None:
        at = np.flatnonzero(label[owner] >= 0)
        given[at, label[owner[at]]] += LABELLED
    whole = np.zeros((n, raw.shape[1]))
    np.add.at(whole, owner, _softmax(given) * letters[:, None])
    scores[np.arange(len(owner)), whole.argmax(1)[owner]] += DOMINANT
    return scores


def classify(texts: list[str], model: LanguageModel, labels: list[str | None] | None = None):
    """Per sentence: its start, owner text, letters and the probability of each language."""
    _, at, owner, letters, raw = _scores(texts, model.table)
    label = None if labels is None else np.array([model.languages.index(x) if x in model.languages else -1 for x in labels], np.int64)
    return at, owner, letters, _softmax(_weighed(raw, letters, owner, len(texts), label) / model.temperature)


def _texts_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All labelled texts in one shape: table_name, row_id, field, label, text."""
    pairs = spark.read.parquet(f"{sf_dir}/parallel_pairs.parquet")
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sides = pairs.select(F.lit("parallel_pairs").alias("table_name"), F.col("pair_id").alias("row_id"), F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.lit(v).alias("label"), F.col(f"translation.{f}").alias("text")) for f, v in (("zh_CN", "zh"), ("en_GB", "en"))))).alias("s")).select("table_name", "row_id", "s.*")
    docs = documents.select(F.lit("documents").alias("table_name"), F.col("doc_id").alias("row_id"), F.lit("text").alias("field"), normal_label(F.col("lang")).alias("label"), "text")
    return sides.unionByName(docs).where(F.col("text").rlike("\\S"))


def train(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """Fits on at most about `per_language` texts of each known label of each table. labelled: table_name, row_id, label, text.

    The sample is taken by a hash of the id under a rate computed from the label's count, so no label is gathered or
    sorted. It is drawn table by table: else the texts of the larger table would stand for all texts in its languages,
    and other kinds of text in them would be known mostly by those that are mislabelled.
    """
    known = labelled.where(F.col("label").isin(*LANGUAGES))
    counts = known.groupBy("table_name", "label").agg(F.count("*").alias("n")).collect()  # a row per table and known language
    if not counts:
        return fit([], [])
    rate = F.coalesce(*(F.when((F.col("table_name") == r["table_name"]) & (F.col("label") == r["label"]), F.lit(min(1.0, per_language / r["n"]))) for r in counts))
    drawn = F.pmod(F.xxhash64("row_id", "label"), F.lit(1_000_000)) < rate * 1_000_000
    rows = known.where(drawn & (F.length("text") <= LONGEST_EXAMPLE)).select("table_name", "row_id", "label", "text").collect()
    rows.sort(key=lambda r: (r["table_name"], r["row_id"], r["label"]))
    return fit([r["text"] for r in rows], [r["label"] for r in rows])


def segments(texts: DataFrame, model: LanguageModel, keys: list[str]) -> DataFrame:
    """One row per text and maximal run of sentences in one language. A key `label` is what the text is labelled with.

    Columns: the keys, `segment` (0, 1, ...), `lang`, `confidence`, `letters`, `share` (of the text's letters).
    Runs of sentences too short to judge join the run before them (the first ones the run after).
    """
    shared = texts.sparkSession.sparkContext.broadcast(model)  # of fixed size: 2**BITS buckets
    schema = ", ".join(f"{texts.schema[k].simpleString()}" for k in keys) + ", segment int, lang string, confidence double, letters double, share double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in batches:
            values = pdf["text"].tolist()
            for low, high in K.chunks(values):
                table = _runs(values[low:high], m, pdf["label"].iloc[low:high].tolist() if "label" in pdf else None)
                if len(table):
                    table["lang"] = np.array(m.languages, object)[table["lang"]]
                    head = pdf[keys].iloc[low:high].iloc[table.pop("owner")].reset_index(drop=True)
                    yield pd.concat([head, table.reset_index(drop=True)], axis=1)

    return texts.select(*keys, "text").mapInPandas(run, schema)


def _runs(texts: list[str], model: LanguageModel, labels: list[str | None] | None = None) -> pd.DataFrame:
    at, owner, letters, prob = classify(texts, model, labels)
    best = prob.argmax(1)
    sure = letters >= LEAST_LETTERS
    # a text without any sure sentence is judged by the product over its sentences, weighted by letters
    log = np.log(np.maximum(prob, 1e-9)) * letters[:, None]
    n = len(texts)
    whole = np.zeros((n, prob.shape[1]))
    np.add.at(whole, owner, log)
    total = np.bincount(owner, letters, n)
    any_sure = np.bincount(owner, sure, n) > 0
    lang = np.where(sure, best, -1)
    # carry languages forward, then backward, within the text
    pos = np.arange(len(lang))
    first = np.searchsorted(owner, np.arange(n))
    ahead = np.maximum.accumulate(np.where(lang >= 0, pos, -1))
    forward = np.where(ahead >= first[owner], lang[ahead], -1)
    behind = np.minimum.accumulate(np.where(lang >= 0, pos, len(lang))[::-1])[::-1]
    last = np.append(first[1:], len(lang))
    backward = np.where(behind < last[owner], lang[np.minimum(behind, len(lang) - 1)], -1)
    lang = np.where(forward >= 0, forward, np.where(backward >= 0, backward, whole.argmax(1)[owner]))
    changes = np.append(True, (lang[1:] != lang[:-1]) | (owner[1:] != owner[:-1]))
    run = np.cumsum(changes) - 1
    weight = np.bincount(run, letters)
    conf = np.bincount(run, letters * prob[pos, lang]) / np.maximum(weight, 1e-9)
    heads = np.flatnonzero(changes)
    own = owner[heads]
    table = pd.DataFrame({"owner": own, "segment": np.arange(len(heads)) - np.searchsorted(own, own), "lang": lang[heads], "confidence": conf, "letters": weight, "share": weight / np.maximum(total[own], 1e-9)})
    return table[(total[own] > 0) & ((weight > 0) | ~any_sure[own])].astype({"segment": "int32"})


def languages_of(texts: DataFrame, model: LanguageModel, keys: list[str]) -> DataFrame:
    """One row per text and language it is in: keys, `lang`, `confidence`, `share`. No shuffle: runs of a text are adjacent."""
    shared = texts.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"{texts.schema[k].simpleString()}" for k in keys) + ", lang string, confidence double, share double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in batches:
            values = pdf["text"].tolist()
            for low, high in K.chunks(values):
                t = _runs(values[low:high], m, pdf["label"].iloc[low:high].tolist() if "label" in pdf else None)
                if not len(t):
                    continue
                t["mass"] = t["confidence"] * t["letters"]
                g = t.groupby(["owner", "lang"], sort=False)[["mass", "letters", "share"]].sum().reset_index()
                head = pdf[keys].iloc[low:high].iloc[g["owner"]].reset_index(drop=True)
                yield head.assign(lang=np.array(m.languages, object)[g["lang"]], confidence=(g["mass"] / g["letters"].clip(lower=1e-9)).to_numpy(), share=g["share"].to_numpy())

    return texts.select(*keys, "text").mapInPandas(run, schema)


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose label is missing or wrong, or that hold several languages; one row for each language."""
    texts = _texts_in(spark, sf_dir)
    model = train(texts)
    # a text's label rides along as a key, so nothing is joined; the languages of one text leave the same Python batch
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        names = np.array(m.languages, object)
        for pdf in batches:
            values = pdf["text"].tolist()
            for low, high in K.chunks(values):
                part = pdf.iloc[low:high]
                t = _runs(values[low:high], m, part["label"].tolist())
                pairs = t[["owner", "lang"]].drop_duplicates()
                label = part["label"].to_numpy()[pairs["owner"]]
                lang = names[pairs["lang"]]
                several = pairs.groupby("owner")["lang"].transform("size").to_numpy() > 1
                keep = several | (label != lang)
                rows = part[["table_name", "row_id", "field"]].iloc[pairs["owner"].to_numpy()[keep]]
                yield rows.assign(lang=lang[keep])

    return texts.mapInPandas(run, "table_name string, row_id long, field string, lang string")


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts and mean confidence per table, field, label and language."""
    texts = _texts_in(spark, sf_dir)
    langs = languages_of(texts, train(texts), ["table_name", "row_id", "field", "label"])
    return langs.groupBy("table_name", "field", "label", "lang").agg(F.count("*").alias("n_texts"), F.round(F.avg("confidence"), 3).alias("mean_confidence"))


def all_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment of every text with language and confidence."""
    texts = _texts_in(spark, sf_dir)
    return segments(texts, train(texts), ["table_name", "row_id", "field", "label"]).drop("label")
