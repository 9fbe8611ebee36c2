"""Documents that repeat passages of held-out items (problem 5).

Rare n-gram seeds join documents to items, then Smith-Waterman alignment scores the copies. An item's text in its
consistent form, reduced to letters and digits, is cut into blocks; of the n-grams that start in a block, those in few
documents are its seeds: in at most `RARE` times as many as the rarest that occurs at all, plus `RARE_MORE` (so a copy's
own n-grams, which are in more documents than those its edits broke, stay seeds). Document frequencies are counted over
all documents. A document that has a seed of at least `SEED_SHARE` of an item's blocks is aligned with it token by token
(words; single characters of scripts without spaces): local alignments are taken one after the other until none is long
enough, and the item's tokens inside them are what the document repeats. An alignment keeps one row of scores and the
place where each began, so memory follows the longer text alone. Items shorter than an n-gram have one gram, all they
hold, and a document repeats them if it holds their words in a row.

The items are a stated query set. They go to the executors in blocks of at most `ITEM_BLOCK` characters, so what is
broadcast has a fixed bound; more items mean more blocks, each against all documents. No document is shuffled.
Null and blank texts on either side match nothing, as do items without letters and digits; repeated item ids give
repeated rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinloom.llm import _codes as K
from twinloom.llm.overlap import plain

N_WIDE, N_LETTERS = 7, 20  # n-gram lengths for texts mostly in wide characters, and for others
ITEM_BLOCK = 8_000_000
SEED_SHARE, COVERED = 0.25, 0.5
RARE, RARE_MORE = 4, 8
MATCH, MISS = 2, -1
APART = 64  # tokens
LEAST_TOKENS = 6  # of a local alignment, in words; wide characters count half
BITMAP = 22
_TOKEN = re.compile(r"[⺀-鿿豈-﫿가-힣]|[^\W_⺀-鿿豈-﫿가-힣]+")


class _Grams:
    """Sorted gram hashes with a bitmap before them; lengths are kept apart by the hash itself."""

    def __init__(self, hashes: np.ndarray, lengths: tuple[int, ...]):
        self.sorted, self.lengths = np.unique(hashes), lengths
        self.bitmap = np.zeros(1 << BITMAP, bool)
        self.bitmap[(self.sorted >> np.uint64(64 - BITMAP)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions whose hash is known, and its number."""
        at = np.flatnonzero(self.bitmap[(hashes >> np.uint64(64 - BITMAP)).astype(np.int64)])
        no = np.searchsorted(self.sorted, hashes[at])
        ok = no < len(self.sorted)
        at, no = at[ok], no[ok]
        ok = self.sorted[no] == hashes[at]
        return at[ok], no[ok]


def _length_of(codes: np.ndarray) -> int:
    """Of the n-grams of an item; one shorter than that is its own n-gram."""
    return min(len(codes), N_WIDE if (codes >= 0x2E80).mean() > 0.4 else N_LETTERS)


def _hits(texts: list[str], grams: _Grams) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, gram number) of the known grams of any length in each text (in its plain form)."""
    codes, starts, _ = K.compact(*K.encode(texts))
    found = []
    for n in grams.lengths:
        if len(codes) < n:
            continue
        at, no = grams.find(K.rolling(codes, n))
        owner = np.searchsorted(starts, at, "right") - 1
        inside = at + n <= starts[owner + 1]
        found.append(owner[inside].astype(np.int64) * len(grams.sorted) + no[inside])
    keys = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return keys // max(1, len(grams.sorted)), keys % max(1, len(grams.sorted))


def tokens(text: str) -> list[str]:
    """Of a plain text."""
    return _TOKEN.findall(text)


def holds(item: list[str], doc: list[str]) -> bool:
    """Whether the tokens of the item stand in the document in a row."""
    return "\0".join(["", *item, ""]) in "\0".join(["", *doc, ""])


def local_alignment(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int, int, int]:
    """Smith-Waterman with linear gaps: score and the aligned spans (a from, to, b from, to).

    Rows are vectors over b. A cell holds its score above the place where its alignment began (i * (m + 1) + j), so a
    greater cell is a better one, and one row is all that is kept.
    """
    n, m = len(a), len(b)
    one = np.int64(1) << np.int64(40)
    steps = np.arange(m + 1, dtype=np.int64)
    row, best, best_at = steps.copy(), np.int64(0), (0, 0)
    for i in range(1, n + 1):
        here = row + MISS * one
        np.maximum(here[1:], row[:-1] + np.where(b == a[i - 1], MATCH, MISS) * one, out=here[1:])
        here = np.maximum.accumulate(here - MISS * steps * one) + MISS * steps * one
        row = np.where(here >= one, here, i * (m + 1) + steps)
        j = int(row.argmax())
        if row[j] >> 40 > best >> 40:
            best, best_at = row[j], (i, j)
    begin = divmod(int(best & (one - 1)), m + 1) if best else best_at
    return int(best >> 40), begin[0], best_at[0], begin[1], best_at[1]


def covered_share(item: list[str], doc: list[str]) -> float:
    """The share of the item's characters that lie inside its local alignments with the document."""
    ids: dict[str, int] = {}
    a = np.array([ids.setdefault(t, len(ids)) for t in item], np.int32)
    b = np.array([ids.get(t, -1) for t in doc], np.int32)
    weight = np.array([len(t) for t in item], np.float64)
    wide = (weight == 1).mean() > 0.5
    # an alignment long enough holds a run of equal tokens: columns far from any such run are left out
    run = min(4 if wide else 3, len(a), len(b))
    if not run:
        return 0.0
    base = len(ids) + 2
    grams_a, grams_b = (sum(x[k : len(x) - run + 1 + k].astype(np.int64) * base**k for k in range(run)) for x in (a, b))
    hit = np.flatnonzero(np.isin(grams_b, grams_a))
    if not len(hit):
        return 0.0
    reach = 16 if wide else 8
    edges = np.zeros(len(b) + 1, np.int32)
    np.add.at(edges, np.maximum(hit - reach, 0), 1)
    np.add.at(edges, np.minimum(hit + run + reach, len(b)), -1)
    near = np.flatnonzero(np.cumsum(edges[:-1]) > 0)
    # what was left out between two stretches keeps them apart: a gap of its length, or one no alignment is worth
    gap = np.minimum(np.diff(near, prepend=near[0]) - 1, APART).clip(min=0)
    spread = np.full(len(near) + int(gap.sum()), -1, b.dtype)
    spread[np.arange(len(near)) + np.cumsum(gap)] = b[near]
    b = spread
    least = MATCH * (LEAST_TOKENS * (2 if wide else 1))
    least = min(least, MATCH * max(1, len(a) - 1))
    free = np.ones(len(a), bool)
    a = a.copy()
    for _ in range(len(a)):
        score, i, end_i, j, end_j = local_alignment(a, b)
        if score < least:
            break
        free[i:end_i] = False
        a[i:end_i] = -2
        b[j:end_j] = -3
        if free.sum() * MATCH < least:
            break
    return float(weight[~free].sum() / weight.sum())


def _block(spark: SparkSession, rows: list, docs: DataFrame) -> DataFrame | None:
    """doc_id, item_id, share of one block of items."""
    items = [(r["item_id"], p) for r in rows if r["text"] and len(K.compact(*K.encode([p := plain(r["text"])]))[0])]
    if not items:
        return None
    codes, starts, _ = K.compact(*K.encode([t for _, t in items]))
    places = []  # item, block, hash
    for i in range(len(items)):
        own = codes[starts[i] : starts[i + 1]]
        n = _length_of(own)
        h = K.rolling(own, n)
        places.append(pd.DataFrame({"item": i, "block": np.arange(len(h)) // n, "hash": h, "n": n}))
    places = pd.concat(places, ignore_index=True)
    lengths = tuple(sorted(set(places["n"].tolist())))  # at most N_LETTERS
    grams = _Grams(places["hash"].to_numpy(), lengths)
    shared = spark.sparkContext.broadcast(grams)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = shared.value
        total = np.zeros(len(g.sorted), np.int64)
        for pdf in batches:
            values = [plain(t) for t in pdf["text"]]
            for low, high in K.chunks(values):
                total += np.bincount(_hits(values[low:high], g)[1], minlength=len(total))
        some = np.flatnonzero(total)
        yield pd.DataFrame({"gram": some, "n": total[some]})

    # one row per gram of the items in this block, whatever the number of documents
    df = docs.select("text").mapInPandas(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    frequency = np.zeros(len(grams.sorted), np.int64)
    frequency[df["gram"].to_numpy(np.int64)] = df["n"].to_numpy(np.int64)
    whole = places.groupby("item").size().reindex(range(len(items))).to_numpy() == 1  # one gram: an item that is found as a whole
    places["df"] = frequency[np.searchsorted(grams.sorted, places["hash"].to_numpy())]
    blocks = places.groupby("item")["block"].nunique().reindex(range(len(items)), fill_value=1).to_numpy()
    places = places[places["df"] > 0]  # what no document has can't find one
    seeds = places[places["df"] <= places.groupby(["item", "block"])["df"].transform("min") * RARE + RARE_MORE]
    chosen = _Grams(seeds["hash"].to_numpy(), lengths)
    number = np.searchsorted(chosen.sorted, seeds["hash"].to_numpy())
    order = np.argsort(number, kind="stable")
    offsets = np.searchsorted(number[order], np.arange(len(chosen.sorted) + 1))
    width = int(blocks.max()) + 1
    spots = (seeds["item"].to_numpy() * width + seeds["block"].to_numpy())[order]
    packed = spark.sparkContext.broadcast((chosen, offsets, spots, width, blocks, [(k, tokens(t), bool(w)) for (k, t), w in zip(items, whole, strict=True)]))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, offs, spots, width, n_blocks, known = packed.value
        for pdf in batches:
            values, ids = [plain(t) for t in pdf["text"]], pdf["doc_id"].to_numpy()
            for low, high in K.chunks(values):
                text, gram = _hits(values[low:high], g)
                if not len(text):
                    continue
                size = offs[gram + 1] - offs[gram]
                pair_text = np.repeat(text, size)
                at = np.repeat(offs[gram] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
                block = np.unique(pair_text * (len(known) * width) + spots[at])
                pair, n = np.unique(block // width, return_counts=True)
                item = pair % len(known)
                pair = pair[n >= np.maximum(1, np.ceil(SEED_SHARE * n_blocks[item]))]
                out, cut = [], {}
                for p in pair:
                    t, i = divmod(int(p), len(known))
                    if t not in cut:
                        cut = {t: tokens(values[low + t])}
                    share = float(holds(known[i][1], cut[t])) if known[i][2] else covered_share(known[i][1], cut[t])
                    out.append((int(ids[low + t]), known[i][0], share))
                if out:
                    yield pd.DataFrame(out, columns=["doc_id", "item_id", "share"])

    return docs.select("doc_id", "text").mapInPandas(search, "doc_id long, item_id long, share double")


def aligned(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, share: how much of the item each candidate document repeats."""
    spark = docs.sparkSession
    docs, items = docs.where(F.col("text").rlike("\\S")), items.where(F.col("text").rlike("\\S"))
    size = items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    n = -(-int(size) // ITEM_BLOCK) or 1
    parts = [p for b in range(n) if (p := _block(spark, items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == b).orderBy("item_id").collect(), docs)) is not None]
    if not parts:
        return spark.createDataFrame([], "doc_id long, item_id long, share double")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/heldout_items.parquet"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aligned(spark, sf_dir).where(F.col("share") >= COVERED).select("doc_id", "item_id")


def leaked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per item, how many documents repeat at least half of it."""
    hits = found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n_documents"))
    return spark.read.parquet(f"{sf_dir}/heldout_items.parquet").select("item_id", "suite", "lang").join(hits, "item_id", "left").fillna(0, ["n_documents"])
