"""Records that repeat each other in other formatting (problem 3).

Each field is reduced to its content; its role and content are hashed together, and the hashes are added up (a
commutative multiset hash, twice, modulo 2**61 each, so the order of the fields doesn't matter). Which text stands in
which field and how the fields are named is set aside here, so both sides have the same role; `fingerprint` takes other
roles. Groups come from the fingerprint with partial aggregation before the shuffle; each member's fields are then
compared with those of its group's smallest record, without sorting. A group may hold any share of all rows: joins on
the fingerprint and on the kept record's id spread large groups over salts.

Null or blank sides and broken payloads are left out; a table without rows gives no rows. Records whose fingerprints
collide although their fields differ are grouped again by the fields themselves, so a collision costs time only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinloom.llm import _codes as K

#: Compatibility letters that lower case would fold although they aren't set aside, kept apart by
#: private characters; and letters that case folding turns into others than lower case does.
KEPT_FORMS = {"\u212a": "\ue000", "\u212b": "\ue001", "\u2126": "\ue002"}
FOLDED = {"ß": "ss", "ς": "σ"}
#: A point goes unless it stands between digits; the look-behind is tried at points only.
POINT = r"[.．](?:(?!\p{Nd})|(?<!\p{Nd}.))"
#: White space but for no-break spaces, and punctuation.
NOISE = r"[\p{IsPunctuation}\s\u0085  -  -    　&&[^.．]]+"
MASK = (1 << 61) - 1
ROLE = "text"  # of both sides: naming and order are set aside


def content(text: Column) -> Column:
    """A text without white space, letter case and punctuation; null and blank are null."""
    folded = text
    for letter, by in KEPT_FORMS.items():
        folded = F.replace(folded, F.lit(letter), F.lit(by))
    folded = F.lower(folded)
    for letter, by in FOLDED.items():
        folded = F.replace(folded, F.lit(letter), F.lit(by))
    return F.nullif(F.regexp_replace(F.regexp_replace(folded, POINT, ""), NOISE, ""), F.lit(""))


def fingerprint(fields: list[tuple[str, Column]]) -> tuple[Column, Column]:
    """Sums modulo 2**61 of two hashes of each (role, value); the same for any order of the fields."""
    sums = []
    for seed in ("a", "b"):
        total = F.lit(0).cast("long")
        for role, f in fields:
            total = (total + F.xxhash64(F.lit(f"{seed}:{role}"), f).bitwiseAND(F.lit(MASK))).bitwiseAND(F.lit(MASK))
        sums.append(total)
    return sums[0], sums[1]


def parse_payload(payload: Column) -> Column:
    """struct<zh_CN, en_GB> of a delivered JSON object in any of its shapes; null if it is broken."""
    names = {"zh_CN": ("zh_CN", "zh", "zh-CN"), "en_GB": ("en_GB", "en", "en-US")}
    keys = [x for group in names.values() for x in group]
    inner, outer = ", ".join(f"`{x}`: string" for x in keys), ", ".join(f"`{x}` string" for x in keys)
    row = F.from_json(payload, f"translation struct<{inner}>, {outer}, _broken string", {"columnNameOfCorruptRecord": "_broken"})

    def side(key):
        return F.coalesce(*(F.nullif(v, F.lit("")) for x in names[key] for v in (row["translation"][x], row[x])))

    return F.when(row["_broken"].isNull(), F.struct(*(side(k).alias(k) for k in names)))


def sides_of(pairs: DataFrame, raw: DataFrame) -> DataFrame:
    """id, translation of all records of both tables."""
    return pairs.select(F.col("pair_id").alias("id"), F.struct(F.col("translation.zh_CN").alias("zh_CN"), F.col("translation.en_GB").alias("en_GB")).alias("translation")).unionAll(raw.select(F.col("record_id").alias("id"), parse_payload(F.col("payload")).alias("translation")))


def contents(sides: DataFrame) -> DataFrame:
    """Adds a, b, the contents of the two sides. No filter on them here: pushed down, it would reduce each text twice."""
    return sides.withColumns({"a": content(F.col("translation.zh_CN")), "b": content(F.col("translation.en_GB"))}).drop("translation")


def fingerprints(sides: DataFrame) -> DataFrame:
    """id, h1, h2 of the records that have both sides; three numbers a record are kept, so texts are reduced once."""
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    h1, h2 = (F.when(both, h) for h in fingerprint([(ROLE, F.col("a")), (ROLE, F.col("b"))]))
    return K.keep(contents(sides).select("id", h1.alias("h1"), h2.alias("h2"))).where("h1 IS NOT NULL")


def groups_of(prints: DataFrame) -> DataFrame:
    """h1, h2, keep_id, n of each fingerprint with more than one record; counted before the shuffle."""
    return prints.groupBy("h1", "h2").agg(F.min("id").alias("keep_id"), F.count("*").alias("n")).where("n > 1")


def _same() -> Column:
    a, b, c, d = (F.col(x) for x in ("m.a", "m.b", "k.a", "k.b"))
    return ((a == c) & (b == d)) | ((a == d) & (b == c))


def copies(sides: DataFrame, prints: DataFrame | None = None) -> DataFrame:
    """keep_id, copy_id: each member of a group of equal records but its smallest id. sides: id (unique), translation."""
    prints = fingerprints(sides) if prints is None else prints
    groups = K.keep(groups_of(prints))
    members = K.keep(K.split_join(prints, groups.drop("n"), ["h1", "h2"], groups).select("id", "keep_id"))
    # only members are reduced once more; ids are unique, so this join has no hot key
    rows = K.keep(contents(sides.join(members, "id")))
    first = rows.where("id = keep_id").select("keep_id", F.col("a").alias("a0"), F.col("b").alias("b0"))
    same = ((F.col("a") == F.col("a0")) & (F.col("b") == F.col("b0"))) | ((F.col("a") == F.col("b0")) & (F.col("b") == F.col("a0")))
    judged = K.keep(K.split_join(rows.where("id <> keep_id"), first, ["keep_id"], groups.select("keep_id", "n")).select("keep_id", F.col("id").alias("copy_id"), same.alias("same")))
    sure = judged.where("same").select("keep_id", "copy_id")
    strays = judged.where("NOT same").select(F.col("copy_id").alias("id"))
    if strays.isEmpty():
        return sure
    # colliding fingerprints: the strays are grouped by the fields themselves
    rest = contents(sides.join(strays, "id", "left_semi")).select("id", F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q"))
    own = rest.groupBy("p", "q").agg(F.min("id").alias("keep_id"))
    return sure.unionAll(rest.join(own, ["p", "q"]).where("id <> keep_id").select("keep_id", F.col("id").alias("copy_id")))


def distinct(sides: DataFrame) -> DataFrame:
    """keep_id, n_copies: one row per distinct record, its smallest id and how many records equal it, itself included.

    Counted from the verified copies, so colliding records stay apart.
    """
    prints = fingerprints(sides)
    pairs = copies(sides, prints)
    # an id's row says whether it is a copy, and how many copies it has: one shuffle on ids, which are unique
    had = pairs.groupBy("keep_id").agg(F.count("*").alias("n")).select(F.col("keep_id").alias("id"), "n")
    marks = prints.select("id", F.lit(1).alias("n")).unionAll(had).unionAll(pairs.select(F.col("copy_id").alias("id"), F.lit(None)))
    return marks.groupBy("id").agg(F.sum("n").alias("n"), F.count_if(F.col("n").isNull()).alias("copy")).where("copy = 0").select(F.col("id").alias("keep_id"), F.col("n").alias("n_copies"))


def _sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sides_of(spark.read.parquet(f"{sf_dir}/parallel_pairs.parquet"), spark.read.parquet(f"{sf_dir}/raw_records.parquet"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(_sides(spark, sf_dir))


def distinct_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per distinct record: its smallest id and the number of records that are equal to it, itself included."""
    return distinct(_sides(spark, sf_dir))
