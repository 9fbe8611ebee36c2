"""Operators against sequential versions on small tables, and the defined results of empty and dirty ones."""

import hashlib
import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from twinloom.functions import models
from twinloom.functions import text as T
from twinloom.operators import corpus, documents, evaluation, filters, selection
from twinloom.session import keep
from twinloom.sources import readers
from twinloom.streaming import clean

PAIR = "pair_id long, translation struct<zh_CN: string, en_GB: string>, reason string, note string"


def test_first_wins_and_counts_add_up(spark):
    rows = [(1, ("中文字", "Some text"), "x", None), (2, ("中文字", "SOME  text"), None, "x"), (3, None, None, None), (4, (None, "a"), None, None), (5, ("中文字", "Some text"), None, None)]
    p = corpus.clean_pairs(spark.createDataFrame(rows, PAIR).drop("reason"))
    j = corpus.judged(p, "pair_id", filters.pair_reason(F.col("zh"), F.col("en")), T.pair_key(F.col("zh"), F.col("en")))
    assert {r["pair_id"]: r["reason"] for r in j.collect()} == {1: None, 2: "duplicate", 3: "empty", 4: "empty", 5: "duplicate"}
    t = corpus.totals(j).first()
    assert t["scanned"] == t["accepted"] + t["rejected"] == 5
    assert corpus.totals(corpus.until_accepted(j, "pair_id", 1)).first()["scanned"] == 1
    empty = spark.createDataFrame([], PAIR).drop("reason")
    assert corpus.judged(corpus.clean_pairs(empty), "pair_id", F.lit(None).cast("string"), F.lit("k")).count() == 0
    with pytest.raises(ValueError):
        corpus.clean_pairs(spark.range(1))


def test_aliases_fall_through(spark):
    rows = spark.createDataFrame([(('', "甲", None, "a"),)], "translation struct<zh_CN: string, zh: string, en_GB: string, en: string>")
    r = corpus.clean_pairs(rows).first()
    assert (r["zh"], r["en"]) == ("甲", "a")


def _sequential(pools, total, caps, seed):
    import hashlib

    rank = lambda k: hashlib.md5(f"{k}#{seed}".encode()).hexdigest()
    pools = [(n, w, sorted(dict.fromkeys(rows), key=lambda r: rank(r[0]))) for n, w, rows in pools]
    weights, taken, count, at, out = sum(w for _, w, _ in pools), set(), {}, [0] * len(pools), []

    def add(key, domain, pool, phase):
        if key in taken or domain in caps and count.get(domain, 0) >= max(1, round(total * caps[domain])):
            return False
        taken.add(key)
        count[domain] = count.get(domain, 0) + 1
        out.append((key, domain, pool, phase))
        return True

    for i, (name, w, rows) in enumerate(pools):
        quota = max(1, round(total * w / weights))
        while at[i] < len(rows) and quota:
            quota -= add(*rows[at[i]], name, "quota")
            at[i] += 1
    moved = True
    while len(out) < total and moved:
        moved = False
        for i, (name, _, rows) in enumerate(pools):
            while at[i] < len(rows):
                at[i] += 1
                if add(*rows[at[i] - 1], name, "fill"):
                    moved = True
                    break
            if len(out) >= total:
                break
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_selection_is_the_sequential_one(spark, seed):
    rng = random.Random(seed)
    pools = [(f"p{i}", w, [(f"k{k}", "capped" if k % 3 == 0 else "free") for k in (rng.randrange(60) for _ in range(n))]) for i, (w, n) in enumerate(((0.6, 12), (0.3, 40), (0.1, 40)))]
    frames = [(n, w, spark.createDataFrame(rows, "key string, domain string")) for n, w, rows in pools]
    got = selection.select(frames, 36, {"capped": 0.2}, seed, keep)
    assert sorted(map(tuple, got.collect())) == _sequential(pools, 36, {"capped": 0.2}, seed)


def test_prepared_pairs_are_fully_normalised(spark, tmp_path):
    from twinloom.plans import queries

    rows = [(1, ("你好，世界Ａ", "Tom &amp; Ann"), "c"), (2, ("你好,世界A", "Tom\u200b & Ann"), "c")]
    spark.createDataFrame(rows, "pair_id long, translation struct<zh_CN: string, en_GB: string>, corpus string").write.parquet(f"{tmp_path}/parallel_pairs.parquet")
    assert [tuple(r) for r in queries.accepted_pairs(spark, str(tmp_path)).collect()] == [(1, "你好,世界A", "Tom & Ann")]
    assert {(r["reason"], r["n"]) for r in queries.pair_reasons(spark, str(tmp_path)).collect()} == {("accepted", 1), ("duplicate", 1)}
    assert {(r["reason"], r["n"]) for r in queries.fast_length(spark, str(tmp_path)).collect()} == {("accepted", 1), ("duplicate", 1)}


def test_selection_goes_on_behind_two_full_domains(spark):
    digest = lambda k: hashlib.md5(f"{k}#1".encode()).hexdigest()
    keys = sorted((f"k{i}" for i in range(140)), key=digest)
    # the first pool fills both caps; behind its quota the second ranks rows of the two full domains first
    one = [(f"a{i}", d) for i, d in enumerate(("x", "y"))]
    two = [(k, "free" if i < 2 else "x" if i < 22 else "y" if i < 42 else "free") for i, k in enumerate(keys)]
    frames = [(n, w, spark.createDataFrame(rows, "key string, domain string")) for n, w, rows in (("p0", 0.9, one), ("p1", 0.1, two))]
    caps = {"x": 0.05, "y": 0.05}
    got = selection.select(frames, 20, caps, 1, keep)
    assert sorted(map(tuple, got.collect())) == _sequential([("p0", 0.9, one), ("p1", 0.1, two)], 20, caps, 1)


def test_bootstrap_is_pythons(spark):
    d = [0.5, -1.0, 2.0, 1.5]
    frame = spark.createDataFrame([(f"c{i}", x) for i, x in enumerate(d)], "id string, d double")
    rng = random.Random(2026)
    means = sorted(sum(d[rng.randrange(4)] for _ in range(4)) / 4 for _ in range(200))
    r = evaluation.bootstrap(frame, samples=200).first()
    assert (r["mean"], r["ci95_low"], r["ci95_high"]) == pytest.approx((0.75, means[5], means[195]))
    p = evaluation.bootstrap_poisson(frame, samples=400).first()
    assert p["mean"] == pytest.approx(0.75) and p["ci95_low"] < 0.75 < p["ci95_high"]
    with pytest.raises(ValueError):
        evaluation.bootstrap(frame.limit(0))


def test_scores_and_gate(spark):
    schema = "id string, direction string, category string, source string, reference string, prediction string, required_terms array<string>, terminology array<string>, forbidden_terms array<string>, preserve array<string>"
    base = [("a", "zh-en", "general", "有12个", "There are 12 of them here", None, ["There"], None, None, [])]
    good = [("a", "zh-en", "general", "有12个", "There are 12 of them here", "There are 12 of them here", ["There"], None, None, [])]
    b, c = (evaluation.scored(spark.createDataFrame(x, schema)) for x in (base, good))
    assert b.first()["missing_numbers"] == ["12"] and b.first()["critical"] and not c.first()["critical"]
    sb, sc = evaluation.summary(b), evaluation.summary(c)
    assert sb.first()["term_accuracy"] == 1.0 and sb.first()["number_accuracy"] == 0.0
    diff = evaluation.bootstrap(evaluation.paired(c, b), samples=50)
    assert evaluation.gate(sc, sb, diff).first()["accepted"] is True
    assert evaluation.gate(sb, sc, evaluation.bootstrap(evaluation.paired(b, c), samples=50)).first()["accepted"] is False


def test_cache_last_line_wins(spark):
    rows = [(1, "s", "k", "old"), (3, "s", "k", None), (2, "s", "k", "mid"), (4, "t", "k", "other"), (5, "s", None, "x")]
    frame = spark.createDataFrame(rows, "line_no long, signature string, key string, translation string")
    assert [tuple(r) for r in documents.latest(frame, "s").collect()] == [("k", "")]
    texts = spark.createDataFrame([("a",), ("a",), ("b",)], "text string")
    known = spark.createDataFrame([("ca978112ca1bbdcafac231b39a23dc4da786eff8147c4e72b9807785afee48bb", "A")], "key string, translation string")
    looked = documents.look_up(texts, known)
    assert sorted((r["text"], r["cached"]) for r in looked.fillna("-").collect()) == [("a", "A"), ("a", "A"), ("b", "-")]
    assert documents.missing_once(looked).count() == 1


def test_lines_fences_and_reassembly(spark):
    text = "# T\r\n```\ncode\n```\n- see `x` and [a](b) end\n"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    lines = documents.fenced(documents.lines(docs, "doc_id"), "doc_id")
    assert [r["in_fence"] for r in lines.orderBy("line_no").collect()][:4] == [False, False, True, True]
    back = documents.reassemble(lines.withColumn("line", F.concat("body", "ending")), "doc_id", "line_no", "line").first()
    assert back["text"] == text
    m = lines.where("body LIKE '- see%'").select(T.markdown(F.col("body")).alias("m")).first()["m"]
    assert m["prefix"] == "- " and m["kept"] == ["`x`", "[a](b)"]


def _docx(paragraphs):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{p[:2]}</w:t></w:r><w:r><w:t>{p[2:]}</w:t></w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_docx_is_read_and_rewritten(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(_docx(["First one", "Second"]))
    assert [r["body"] for r in readers.docx(spark, str(tmp_path)).orderBy("para_no").collect()] == ["First one", "Second"]
    assert readers.docx_paragraphs(readers.rewrite_docx(_docx(["First one", "Second"]), {"Second": "第二"})) == ["First one", "第二"]
    with pytest.raises(ValueError):
        readers.kind_of("a.pdf")
    assert readers.output_name("d/a.md", "zh-en") == "d/a.en.md"


def test_cache_log_and_corpus_files(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"signature": "s", "key": "k", "translation": "a"}\nbroken\n{"key": "k2"}\n', encoding="utf-8")
    rows = readers.cache_log(spark, str(tmp_path / "c.jsonl")).orderBy("line_no").collect()
    assert [(r["signature"], r["key"], r["translation"]) for r in rows] == [("s", "k", "a"), ("", "k2", "")]
    readers.write_corpus(spark.createDataFrame([("中", "a")], "zh string, en string"), str(tmp_path / "p"))
    assert readers.corpus(spark, str(tmp_path / "p")).first()["translation"]["en_GB"] == "a"
    readers.write_text(str(tmp_path / "t.txt"), "x\r\n")
    assert (tmp_path / "t.txt").read_bytes() == b"x\r\n"


def test_payload_shapes(spark):
    rows = [('{"zh": "甲", "en-US": "a"}',), ('{"translation": {"zh_CN": "", "zh-CN": "乙", "en": "b"}}',), ("{broken",), (None,), ("[]",)]
    got = readers.pairs_from_json(F.col("payload"), spark.createDataFrame(rows, "payload string")).collect()
    assert [(r["translation"]["zh_CN"], r["translation"]["en_GB"]) if r["translation"] else None for r in got][:4] == [("甲", "a"), ("乙", "b"), None, None]


def test_model_hooks(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", "y")], "s string, d string").coalesce(1)
    assert [r["o"] for r in models.predict(rows, lambda: lambda xs: [x.upper() for x in xs], "s", "o").collect()] == ["A", "B"]

    def broken():
        def ask(s, d):
            raise RuntimeError

        return ask

    assert {(r["reviewed"], r["review_status"]) for r in models.review(rows, broken, "s", "d").collect()} == {("x", "unavailable"), ("y", "unavailable")}


def test_stream_accepts_each_pair_once(spark, tmp_path):
    rows = [(("中文字", "Some text"), 0), (("中文字", "SOME text"), 1), (("中文", ""), 2)]
    frame = spark.createDataFrame(rows, "translation struct<zh_CN: string, en_GB: string>, t long").withColumn("created_at", F.timestamp_seconds("t"))
    frame.write.parquet(str(tmp_path / "in"))
    stream = clean.accepted_stream(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in")), "created_at")
    q = stream.writeStream.format("memory").queryName("accepted").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("accepted").count() == 1


def test_bootstrap_query_draws_the_default_number(monkeypatch):
    from twinloom.plans import queries

    given = []
    monkeypatch.setattr(queries, "_difference", lambda *_: None)
    result = type("Result", (), {"columns": [], "select": lambda self, *_: self})()
    monkeypatch.setattr(queries.evaluation, "bootstrap_poisson", lambda *a, **k: given.append((a, k)) or result)
    queries.bootstrap(None, "")
    assert given == [((None,), {})]


def _context_rules(text, table):
    """Rule after rule on the text as rewritten so far."""
    import re

    out, required, forbidden, aliases = text, [], [], {}
    holds = lambda v: re.search(rf"(?<![A-Za-z0-9_]){re.escape(v)}(?![A-Za-z0-9_])", text, re.I) is not None
    for r in table:
        word = re.compile(rf"(?<!\w){re.escape(r['source'])}(?!\w)", re.I)
        if not word.search(out) or r.get("when_any") and not any(map(holds, r["when_any"])) or any(map(holds, r.get("unless_any", []))):
            continue
        out = word.sub(lambda m: r["rewrite"], out)  # noqa: B023
        required.append(r["target"])
        forbidden += r.get("forbidden_output_any", [])
        aliases |= {a: r["target"] for a in r.get("aliases", [])}
    return out, list(dict.fromkeys(required)), list(dict.fromkeys(forbidden)), aliases


def test_many_context_rules_are_planned_and_fold_in_order(spark):
    import time

    from twinloom.operators import rules

    rng = random.Random(4)
    names = [f"term{i}" for i in range(30)]
    table = [{"source": n, "rewrite": f"{rng.choice(names)} $1 of {n}", "target": f"t{i}", "aliases": [f"a{i % 7}"], "when_any": [rng.choice(names)] if i % 3 == 0 else [], "unless_any": [rng.choice(names)] if i % 4 == 0 else [], "forbidden_output_any": [f"f{i % 5}"]} for i, n in enumerate(names)]
    texts = [" ".join(rng.choice(names) for _ in range(6)) for _ in range(20)] + ["", None, "no term of these, term3x"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", rules.apply_context_rules(F.col("t"), table).alias("r"))
    began = time.monotonic()
    frame._jdf.queryExecution().executedPlan()
    assert time.monotonic() - began < 5
    for row in frame.collect():
        text, required, forbidden, aliases = _context_rules(row["t"] or "", table)
        assert (row["r"]["text"], row["r"]["required"], row["r"]["forbidden"]) == (text, required, forbidden)
        assert dict(a.split("\t") for a in row["r"]["aliases"]) == aliases
    assert rules.apply_context_rules(F.col("t"), []) is not None


def test_the_last_target_of_an_alias_wins(spark):
    from twinloom.operators import rules

    frame = spark.createDataFrame([("old bridge", ["old bridge\tfirst", "old\tx", "old bridge\tlast"])], "t string, a array<string>")
    assert frame.select(rules.restore_glossary(F.col("t"), F.col("a")).alias("r")).first()["r"] == "last"


@pytest.mark.parametrize("settled", [100_000, 3])
def test_nth_least_and_what_rests_on_it(spark, monkeypatch, settled):
    monkeypatch.setattr(corpus, "SETTLED", settled)
    rng = random.Random(6)
    values = [rng.choice([0, 5, 5, 10**15, rng.randrange(10**17)]) for _ in range(200)]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(999, None)], "i long, v long")
    for n in (1, 2, 50, 199, 200):
        assert corpus.nth_least(frame, "v", n) == sorted(values)[n - 1]
    assert corpus.nth_least(frame, "v", 201) is None and corpus.nth_least(frame, "v", 0) is None and corpus.nth_least(frame.limit(0), "v", 1) is None
    rows = frame.withColumn("reason", F.when(F.col("i") % 3 == 0, "x"))
    seen = corpus.until_accepted(rows, "i", 20)
    assert sorted(r["i"] for r in seen.collect()) == list(range(30))
    assert corpus.until_accepted(rows, "i", 10**6).count() == 201
    with pytest.raises(ValueError):
        corpus.take_until(rows, "i", 10**6)
    parts = corpus.split(frame.withColumn("k", F.col("i").cast("string")), F.col("k"), 30, 120, 17).groupBy("part").count().collect()
    assert {r["part"]: r["count"] for r in parts} == {"validation": 30, "train": 90}
    plan = corpus.split(frame.withColumn("k", F.col("i").cast("string")), F.col("k"), 30, 120, 17)._jdf.queryExecution().toString()
    assert "TakeOrdered" not in plan and "GlobalLimit" not in plan


def test_eval_cases_are_validated(spark, tmp_path):
    import json

    case = {"id": "a", "direction": "zh-en", "source": "一", "reference": "one"}

    def load(*cases, **how):
        (tmp_path / "c.jsonl").write_text("\n".join(json.dumps(c) for c in cases), encoding="utf-8")
        return evaluation.load_cases(spark, str(tmp_path / "c.jsonl"), **how)

    assert load(case, case | {"id": "b", "split": "dev"}, split="dev").first()["id"] == "b"
    for bad in ([case, case], [case | {"source": ""}], [case | {"reference": None}], [{k: v for k, v in case.items() if k != "direction"}]):
        with pytest.raises(ValueError):
            load(*bad)
    with pytest.raises(ValueError):
        load(case, direction="en-zh")


def test_metadata_and_statistics_of_sources(spark):
    import json

    rows = spark.createDataFrame([("a", None), ("a", "length"), ("a", "length"), ("b", "empty"), (None, None)], "corpus string, reason string")
    m = json.loads(corpus.metadata(rows, seed=17, source="x").first()["metadata"])
    assert m == {"scanned": 5, "accepted": 2, "rejections": {"empty": 1, "length": 2}, "seed": 17, "source": "x"}
    got = {r["corpus"]: (r["n_rows"], r["accepted"], r["rejected"]) for r in corpus.source_statistics(rows, "corpus").collect()}
    assert got == {"a": (3, 1, '{"length":2}'), "b": (1, 0, '{"empty":1}'), None: (1, 1, "{}")}


def test_gates(spark):
    losses = spark.createDataFrame([(1.0, 1.05), (1.0, 1.2), (None, 1.0)], "base_loss double, candidate_loss double")
    assert [r["loss_gate_passed"] for r in evaluation.loss_gate(losses, 0.1).collect()] == [True, False, False]
    one = spark.createDataFrame([(0, 50.0, None, 1.0, 1.0, 1.0, 1.0)], "critical_errors long, chrf double, simple_chrf double, term_accuracy double, required_accuracy double, number_accuracy double, preserve_accuracy double")
    more = one.withColumn("chrf", F.lit(50.0000001))
    sure = spark.createDataFrame([(0.5, 0.1, 0.9)], "mean double, ci95_low double, ci95_high double")
    unsure = sure.withColumn("ci95_low", F.lit(-0.1))
    assert evaluation.gate(more, one, sure).first()["accepted"] is True  # no rounding before the comparison
    assert evaluation.gate(more, one, sure, comet=sure).first()["accepted"] is True
    r = evaluation.gate(more, one, sure, comet=unsure).first()
    assert r["accepted"] is False and r["checks"]["comet_improved"] and not r["checks"]["comet_statistically_significant"]
    a, b = (spark.createDataFrame([(x,) for x in ids], "id string") for ids in ("xy", "yz"))
    assert sorted(map(tuple, evaluation.unpaired(a, b).collect())) == [("x", "candidate"), ("z", "baseline")]


def test_rule_files(spark, tmp_path):
    import json

    def file(content):
        (tmp_path / "r.json").write_text(json.dumps(content, ensure_ascii=False, indent=1), encoding="utf-8")
        return str(tmp_path / "r.json")

    hashes, patterns = readers.blacklist(spark, file({"version": 1, "pair_hashes": ["h"], "exact_pairs": [{"source": " A ", "target": "b"}, {"source": "x"}], "source_patterns": ["p.*", ""]}))
    assert {r[0] for r in hashes.collect()} == {"h", hashlib.sha256(b"a\0b").hexdigest()} and patterns == ("p.*",)
    assert readers.glossary(spark, file({"a": "b", "c": {"target": "d", "aliases": ["e", ""]}, "f": ""})) == [{"source": "a", "target": "b", "aliases": []}, {"source": "c", "target": "d", "aliases": ["e"]}]
    rules = readers.context_rules(spark, file([{"source": " s ", "target": "t", "when_any": ["w"]}]))
    assert rules[0]["rewrite"] == "s" and rules[0]["when_any"] == ["w"] and rules[0]["aliases"] == []
    for bad, load in (([], readers.glossary), ({"a": 3}, readers.glossary), ({}, readers.context_rules), ([{"source": "s"}], readers.context_rules)):
        with pytest.raises(ValueError):
            load(spark, file(bad))
    sources, caps = readers.mixture_sources(spark, file({"sources": [{"path": "p", "weight": 2}], "max_domain_fractions": {"x": 0.5}}))
    assert sources == [{"path": "p", "weight": 2.0, "domain": "general"}] and caps == {"x": 0.5}
    with pytest.raises(FileExistsError):
        readers.refuse_overwriting("a.md", str(tmp_path / "r.json"))
    with pytest.raises(ValueError):
        readers.refuse_overwriting("a.md", "./a.md")


def test_markdown_is_translated_in_its_places(spark):
    seen = []
    text = "# 标题 `code` [链接](http://x)\r\n- 第一 项\r\n```\n代码\n```\nplain line\n- 第一 项\n\n> 引用"
    docs = spark.createDataFrame([(1, text), (2, "no chinese\n"), (3, "标题")], "doc_id long, text string")
    cache = spark.createDataFrame([(hashlib.sha256("引用".encode()).hexdigest(), "cached")], "key string, translation string")
    make = lambda: lambda xs: [f"T({x})" for x in xs]
    got = {r["doc_id"]: r["text"] for r in documents.translate_markdown(docs, "doc_id", "zh-en", make, cache).collect()}
    assert got[1] == "# T(标题) `code` [链接](http://x)\r\n- T(第一 项)\r\n```\n代码\n```\nplain line\n- T(第一 项)\n\n> cached"
    assert got[2] == "no chinese\n" and got[3] == "T(标题)" and not seen


def test_docx_is_translated(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(_docx(["第一段", "Second", "第一段"]))
    (tmp_path / "b.docx").write_bytes(_docx(["only english"]))
    done = readers.translate_docx(spark, str(tmp_path), lambda: lambda xs: [f"T{len(x)}" for x in xs], "zh-en").collect()
    assert sorted(readers.docx_paragraphs(bytes(r["content"])) for r in done) == [["T3", "Second", "T3"], ["only english"]]


def test_reviewer_answers(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "s string, d string").coalesce(1)
    answers = {"a": "<translation> good </translation>", "b": "```text\n```", "c": "```python\nok"}
    got = {r["s"]: (r["reviewed"], r["review_status"]) for r in models.review(rows, lambda: lambda s, d: answers[s], "s", "d").collect()}
    assert got == {"a": ("good", "reviewed"), "b": ("y", "empty"), "c": ("python\nok", "reviewed")}
    slow = models.review(rows, lambda: lambda s, d: s, "s", "d", seconds=-1).collect()
    assert {(r["reviewed"], r["review_status"]) for r in slow} == {("x", "timeout"), ("y", "timeout"), ("z", "timeout")}


def test_document_context(spark):
    docs = spark.createDataFrame([(1, "John Smith met GPU and API near the Old Bridge"), (2, "约翰 John Smith 用GPU看石桥")], "doc_id long, text string")
    glossary = [{"source": "old bridge", "target": "老桥"}, {"source": "石桥", "target": "stone bridge"}, {"source": "absent", "target": "x"}]
    ruled = [{"source": "bridge", "target": "桥", "when_any": ["GPU"]}, {"source": "met", "target": "遇", "unless_any": ["API"]}]
    r = {x["doc_id"]: x for x in documents.context_of(docs, "doc_id", glossary=glossary, context_rules=ruled).collect()}
    assert r[1]["entities"] == ["John Smith", "Old Bridge"] and [tuple(g) for g in r[1]["glossary"]] == [("old bridge", "老桥"), ("bridge", "桥")]
    assert r[2]["entities"] == [] and [tuple(g) for g in r[2]["glossary"]] == [("石桥", "stone bridge")]
    import json

    payload = {"entities": [], "acronyms": ["GPU"], "glossary": [["石桥", "stone bridge"]], "version": 2}
    assert r[2]["fingerprint"] == hashlib.sha256(json.dumps(payload, ensure_ascii=False, sort_keys=True).encode()).hexdigest()


def test_numbers_run_on_across_ranges(spark):
    rows = spark.createDataFrame([("k" if i % 5 else "m", i) for i in range(300)], "g string, i long").repartition(7)
    got = documents.numbered(rows, "g", "i").collect()
    for g in "km":
        assert [r["number"] for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["i"])] == list(range(240 if g == "k" else 60))


def test_tables_without_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert documents.translate_markdown(docs, "doc_id", "zh-en", lambda: list).count() == 0
    assert documents.context_of(docs, "doc_id").count() == 0
    assert documents.micro_batches(docs, 4, "text", "doc_id", F.length("text")).count() == 0
    assert corpus.split(docs, F.col("text"), 2, 5, 1).count() == 0
