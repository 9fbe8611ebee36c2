"""Named queries over the test tables; each takes (spark, directory)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinloom.functions import arrays as A
from twinloom.functions import text as T
from twinloom.operators import corpus, documents, evaluation, filters, quality, rules, selection
from twinloom.session import keep
from twinloom.sources import readers
from twinloom.streaming import clean

BLACKLISTED_SOURCES = ("borrowed the muddy school kitchen",)
DOMAIN_CAPS = {"technical": 0.25, "literary": 0.05}
#: Rules that stand before those of the glossary.
RULES = [
    {"source": "gateway", "rewrite": "network gateway", "target": "网关", "aliases": ["闸道"], "when_any": ["API"], "unless_any": ["castle"], "forbidden_output_any": ["大门"]},
    {"source": "bracket", "rewrite": "support bracket", "target": "支架", "aliases": ["括号"], "when_any": ["hinge"], "unless_any": []},
]


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.clean_pairs(_t(spark, sf_dir, "parallel_pairs")).drop("translation")


def _prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs as corpus preparation has them: fully normalised (fine-tuning only squeezes white space)."""
    return corpus.clean_pairs(_t(spark, sf_dir, "parallel_pairs"), full=True).drop("translation")


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _prepared(spark, sf_dir)
    return corpus.judged(p, "pair_id", filters.pair_reason(F.col("zh"), F.col("en")), T.pair_key(F.col("zh"), F.col("en")))


def corpus_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.histogram(_judged(spark, sf_dir), "corpus")


def pair_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.histogram(_judged(spark, sf_dir), "corpus")


def pair_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.totals(_judged(spark, sf_dir), "domain")


def accepted_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).where("reason IS NULL").select("pair_id", "zh", "en")


def corpus_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.metadata(_judged(spark, sf_dir))


def source_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.source_statistics(_judged(spark, sf_dir), "corpus")


def fast_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _prepared(spark, sf_dir)
    reason = F.coalesce(filters.pair_reason(F.col("zh"), F.col("en")), filters.fast_length_reason(F.col("zh"), F.col("en")))
    return corpus.histogram(corpus.judged(p, "pair_id", reason, T.pair_key(F.col("zh"), F.col("en"))))


def scan_until(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a scan in id order that stops at the 2000th accepted pair reports."""
    return corpus.totals(corpus.until_accepted(_judged(spark, sf_dir), "pair_id", 2000))


def finetune_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pairs(spark, sf_dir)
    zh, en = F.col("zh"), F.col("en")
    both = p.select(F.explode(F.array(F.struct(F.lit("zh-en").alias("direction"), filters.quality_reason(zh, en, "zh").alias("reason")), F.struct(F.lit("en-zh").alias("direction"), filters.quality_reason(en, zh, "en").alias("reason")))).alias("r"))
    return corpus.histogram(both.select("r.*"), "direction")


def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = keep(_pairs(spark, sf_dir).where(filters.quality_reason(F.col("en"), F.col("zh"), "en").isNull()).select("corpus", "domain", "zh", "en"))
    listed = _pairs(spark, sf_dir).where("corpus LIKE '%talks%'").where(F.contains("en", F.lit("street lamp"))).select(T.pair_hash(F.col("en"), F.col("zh")).alias("pair_hash"))
    marked = filters.mark_blacklisted(p, listed, "en", "zh")
    return marked.withColumn("reason", filters.alignment_reason(F.col("en"), F.col("zh"), "en", F.col("blacklisted"), BLACKLISTED_SOURCES))


def alignment_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.histogram(_aligned(spark, sf_dir))


def domain_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pairs(spark, sf_dir)
    return p.groupBy("corpus", filters.final_domain(F.col("en"), F.col("zh"), F.col("domain")).alias("final_domain")).agg(F.count("*").alias("n"))


def domain_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = domain_counts(spark, sf_dir).groupBy("final_domain").agg(F.sum("n").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    cap = F.greatest(F.lit(1), F.bround(F.col("total") * 0.03).cast("long"))
    return counts.crossJoin(F.broadcast(total)).select("final_domain", "n", cap.alias("cap"), (F.col("n") < cap).alias("one_more"))


def mixture_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the pairs, half of them from talks, under domain caps."""
    p = _aligned(spark, sf_dir).where("reason IS NULL")
    rows = keep(p.select(T.exact_key(F.col("en"), F.col("zh")).alias("key"), F.coalesce(filters.final_domain(F.col("en"), F.col("zh"), F.col("domain")), F.lit("general")).alias("domain"), "corpus"))
    total = max(1, rows.count() // 3)
    weights = {"./data/talks_zh_en.parquet": 0.5, "./data/general_web_en_zh.parquet": 0.3, "./data/desk_manuals_en_zh.parquet": 0.15, "./data/story_pairs_en_zh.parquet": 0.05}
    pools = [(name, w, rows.where(F.col("corpus") == name)) for name, w in weights.items()]
    return selection.select(pools, total, DOMAIN_CAPS, 17, keep).groupBy("pool", "domain", "phase").agg(F.count("*").alias("n"))


def train_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = accepted_pairs(spark, sf_dir)
    parts = corpus.split(p.withColumn("key", T.exact_key(F.col("zh"), F.col("en"))).select("pair_id", "key"), F.col("key"), 256, 2000, 17)
    return parts.select("pair_id", "part")


def fraction_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = accepted_pairs(spark, sf_dir)
    return corpus.fraction_split(p, F.col("pair_id").cast("string"), 0.9, 17).groupBy("part").agg(F.count("*").alias("n"), F.sum("pair_id").alias("id_sum"))


def raw_new_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivered pairs that the corpus doesn't have, per feed."""
    raw = corpus.clean_pairs(readers.pairs_from_json(F.col("payload"), _t(spark, sf_dir, "raw_records")), full=True).where("zh <> '' AND en <> ''").withColumn("k", T.pair_key(F.col("zh"), F.col("en")))
    known = _prepared(spark, sf_dir).select(T.pair_key(F.col("zh"), F.col("en")).alias("k"))
    return corpus.not_in(raw, known, "k").groupBy("feed").agg(F.count("*").alias("n"), F.countDistinct("k").alias("n_distinct"))


def raw_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = readers.pairs_from_json(F.col("payload"), _t(spark, sf_dir, "raw_records"))
    shape = F.when(F.col("translation").isNull() | (F.col("translation.zh_CN").isNull() & F.col("translation.en_GB").isNull()), "none").when(F.col("translation.zh_CN").isNull() | F.col("translation.en_GB").isNull(), "half").otherwise("both")
    return raw.groupBy(shape.alias("shape")).agg(F.count("*").alias("n"), F.sum(F.length("translation.zh_CN")).alias("zh_chars"), F.sum(F.length("translation.en_GB")).alias("en_chars"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pairs(spark, sf_dir)
    return p.select("pair_id", F.array_join(F.array_sort(T.numbers(F.col("en"))), "|").alias("numbers"), F.array_join(F.array_sort(T.acronyms(F.col("en"))), "|").alias("acronyms"), F.size(T.entities(F.col("en"))).alias("n_entities"))


def directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents")
    return d.groupBy("source", T.direction_of(F.col("text")).alias("direction")).agg(F.count("*").alias("n"))


def immutable_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with immutable tokens, and whether they come back unchanged."""
    p = _pairs(spark, sf_dir).withColumn("p", T.protect(F.col("en")))
    return p.groupBy(F.size("p.kept").alias("n_tokens")).agg(F.count("*").alias("n"), F.bool_and(T.restore(F.col("p.text"), F.col("p.kept")) == F.col("en")).alias("restored"))


def glossary_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "translation_eval").select("id", "direction", F.col("source").alias("text"))
    return rules.glossary_hits(e, _t(spark, sf_dir, "glossary_entries"), "id").groupBy("source", "target").agg(F.countDistinct("id").alias("n"))


def _glossary(spark: SparkSession, sf_dir: str, direction: str) -> list[dict]:
    """A rule table, one entry a source: of several the one with the greatest target."""
    rows = _t(spark, sf_dir, "glossary_entries").where(F.col("direction") == direction).groupBy("source").agg(F.max(F.struct("target", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))).alias("m"))
    return [{"source": r["source"], "target": r["m"]["target"], "aliases": r["m"]["aliases"]} for r in rows.orderBy("source").collect()]


def rule_table(spark: SparkSession, sf_dir: str) -> list[dict]:
    """The fixed rules, then one for each English glossary entry: its target is put after the term unless the text has a bracket."""
    return RULES + [e | {"rewrite": f"{e['source']} [{e['target']}]", "unless_any": ["["], "forbidden_output_any": e["aliases"]} for e in _glossary(spark, sf_dir, "en-zh")]


def glossary_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _glossary(spark, sf_dir, "zh-en")
    e = _t(spark, sf_dir, "translation_eval").where("direction = 'zh-en'")
    done = e.withColumn("g", rules.protect_glossary(F.col("source"), entries, "zh-en"))
    return done.select("id", F.col("g.text").alias("protected"), rules.restore_glossary(F.col("reference"), F.col("g.aliases")).alias("restored"))


def context_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "translation_eval").where("direction = 'en-zh'").withColumn("r", rules.apply_context_rules(F.col("source"), rule_table(spark, sf_dir)))
    return e.select("id", F.col("r.text").alias("rewritten"), F.array_join("r.required", "|").alias("required"), F.array_join("r.forbidden", "|").alias("forbidden"))


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report rows, each run and id once, with the case's term lists."""
    r = _t(spark, sf_dir, "eval_report_rows").groupBy("run_id", "id").agg(F.max(F.struct(F.coalesce("prediction", F.lit("")).alias("prediction"), "direction", "category", "source", "reference", "split")).alias("r")).select("run_id", "id", "r.*")
    terms = _t(spark, sf_dir, "translation_eval").select("id", "required_terms", "terminology", "forbidden_terms", "preserve")
    return r.join(terms, "id")


def quality_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.issue_counts(quality.assessed(_report(spark, sf_dir)), "run_id", "direction")


def quality_by_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per issue, for the issues that need no repeated-phrase search."""
    return quality_issues(spark, sf_dir).where("code <> 'repetition'")


def review_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.review_stats(quality.assessed(_report(spark, sf_dir)), "run_id", "direction")


def candidate_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _report(spark, sf_dir)
    a = r.where("run_id = 'run-base'").select("id", "source", "direction", F.col("prediction").alias("draft"), "required_terms", "forbidden_terms")
    b = r.where("run_id = 'run-cand'").select("id", F.col("prediction").alias("candidate"))
    verdict = quality.candidate_verdict(*map(F.col, ("source", "draft", "candidate", "direction", "required_terms", "forbidden_terms")))
    return a.join(b, "id").groupBy(verdict["reason"].alias("reason")).agg(F.count("*").alias("n"))


def case_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = evaluation.scored(_report(spark, sf_dir))
    return s.select("run_id", "id", F.round("chrf", 4).alias("chrf"), "n_required", "hit_required", "n_terms", "hit_terms", "n_preserve", "hit_preserve", "n_numbers", "hit_numbers", F.array_join("missing_required_terms", "|").alias("missing_required_terms"), F.array_join("missing_numbers", "|").alias("missing_numbers"), F.size("forbidden_hits").alias("n_forbidden"))


def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = evaluation.summary(evaluation.scored(_report(spark, sf_dir)), "run_id", "direction")
    return s.select(*(F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in s.dtypes))


def chrf_plus(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _report(spark, sf_dir)
    return r.select("run_id", "id", F.round(A.chrf_plus(F.col("prediction"), F.col("reference")), 4).alias("chrf"))


def unpaired_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _t(spark, sf_dir, "eval_report_rows")
    return evaluation.unpaired(s.where("run_id = 'run-cand'"), s.where("run_id = 'run-base'"))


def loss_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A loss a day, each against the day's before."""
    daily = _t(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("step")).agg(F.min("o_totalprice").alias("candidate_loss"))
    before = daily.select(F.date_add("step", 1).alias("step"), F.col("candidate_loss").alias("base_loss"))
    return evaluation.loss_gate(daily.join(before, "step"), 50.0).select("step", F.round("change", 4).alias("change"), "loss_gate_passed")


def _difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _t(spark, sf_dir, "eval_report_rows").where("chrf IS NOT NULL")
    return evaluation.paired(s.where("run_id = 'run-cand'"), s.where("run_id = 'run-base'"))


def paired_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _difference(spark, sf_dir).select("id", F.round("d", 6).alias("d"))


def bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = evaluation.bootstrap_poisson(_difference(spark, sf_dir))
    return b.select(*(F.round(c, 6).alias(c) for c in b.columns))


def promotion_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = evaluation.scored(_report(spark, sf_dir))
    g = evaluation.gate(evaluation.summary(s.where("run_id = 'run-cand'")), evaluation.summary(s.where("run_id = 'run-base'")), evaluation.bootstrap_poisson(_difference(spark, sf_dir)))
    return g.select(F.explode(F.map_concat("checks", F.create_map(F.lit("accepted"), F.col("accepted")))).alias("check_name", "passed"))


def cache_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.latest(_t(spark, sf_dir, "translation_cache"), "2e02d63f136902dbacd9b1f921b44e14fd35b7f86ffc3872caa37f9b4fbf5352")


def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "translation_eval")
    looked = documents.look_up(e.select("id", "direction", F.col("source").alias("text")), documents.latest(_t(spark, sf_dir, "translation_cache")))
    return looked.groupBy("direction").agg(F.count("*").alias("n"), F.count("cached").alias("hits"))


def paragraph_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = documents.with_context(documents.paragraphs(_t(spark, sf_dir, "documents").where("text IS NOT NULL"), "doc_id"), "doc_id")
    return p.groupBy("doc_id").agg(F.count("*").alias("n_paragraphs"), F.sum(F.length("previous")).alias("previous_chars"), F.sum(F.length("next")).alias("next_chars"))


def paragraph_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").where("text IS NOT NULL")
    p = documents.with_context(documents.paragraphs(docs, "doc_id"), "doc_id").join(documents.context_of(docs, "doc_id", glossary=_glossary(spark, sf_dir, "en-zh")).select("doc_id", "fingerprint"), "doc_id")
    return p.select("doc_id", "para_no", documents.paragraph_key(F.col("fingerprint")).alias("cache_key"))


def document_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = documents.sample_of(documents.paragraphs(_t(spark, sf_dir, "documents").where("text IS NOT NULL"), "doc_id"), "doc_id", 500)
    return p.select("doc_id", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


def markdown_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = documents.fenced(documents.lines(_t(spark, sf_dir, "documents"), "doc_id"), "doc_id")
    m = lines.withColumn("m", T.markdown(F.col("body")))
    return m.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if("in_fence").alias("n_fenced"), F.count_if(F.col("m.prefix") != "").alias("n_prefixed"), F.sum(F.size("m.kept")).alias("n_kept"))


def roundtrip_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents put together again from their lines, with the number of these."""
    lines = documents.lines(_t(spark, sf_dir, "documents").where("text IS NOT NULL"), "doc_id").withColumn("line", F.concat("body", "ending"))
    counted = lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"))
    return documents.reassemble(lines, "doc_id", "line_no", "line").join(counted, "doc_id").select("doc_id", "n_lines", F.md5("text").alias("digest"))


def _marked():
    return lambda texts: [f"<{x}>" for x in texts]


def markdown_translated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a predictor that puts each translatable piece of English in angles."""
    done = documents.translate_markdown(_t(spark, sf_dir, "documents").where("text IS NOT NULL"), "doc_id", "en-zh", _marked)
    return done.select("doc_id", F.regexp_count("text", F.lit("<")).alias("n_pieces"), F.md5(F.translate("text", "<>", "")).alias("kept"))


def tidy_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pairs(spark, sf_dir)
    return p.select("pair_id", F.md5(T.tidy_chinese(F.col("zh"))).alias("digest"))


def peeled_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "parallel_pairs").select("pair_id", T.peel(F.col("translation.en_GB")).alias("p"), T.should_translate(F.col("translation.en_GB"), "zh-en").alias("zh"), T.should_translate(F.col("translation.en_GB"), "en-zh").alias("en"))
    return p.select("pair_id", F.length("p.leading").alias("n_leading"), F.length("p.trailing").alias("n_trailing"), F.md5("p.core").alias("core"), "zh", "en")


def clause_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", F.size(T.clauses(F.col("text"))).alias("n_clauses"))


def corpora_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Talks, then all other corpora, one after the other."""
    p = _t(spark, sf_dir, "parallel_pairs")
    both = corpus.concatenate(p.where("corpus LIKE '%talks%'").select("pair_id", "talk_key"), p.where("corpus NOT LIKE '%talks%'").select("pair_id", "domain"))
    return both.groupBy("corpus_no").agg(F.count("*").alias("n"), F.count("talk_key").alias("n_talk_keys"), F.count("domain").alias("n_domains"), F.sum("pair_id").alias("id_sum"))


def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents").withColumn("s", T.sentences(F.col("text"), "en-zh"))
    return d.select("doc_id", F.size("s").alias("n_sentences"), F.md5(F.array_join("s", "\n")).alias("digest"))


def model_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents").withColumn("s", documents.split_for_model(F.col("text"), 200, "zh-en"))
    return d.select("doc_id", F.size("s").alias("n_pieces"), F.array_max(F.transform("s", F.length)).alias("longest"))


def document_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = documents.context_of(_t(spark, sf_dir, "documents"), "doc_id")
    return c.select("doc_id", F.array_join(F.array_sort("acronyms"), "|").alias("acronyms"), F.size("entities").alias("n_entities"))


def micro_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = documents.micro_batches(_t(spark, sf_dir, "translation_eval"), 8, "direction", "id", F.length("source"))
    return b.select("id", "batch", "length", "batch_length")


def _tokens(c: str):
    return F.transform(F.filter(F.split(T.squeeze(F.col(c)), " "), lambda w: w != ""), lambda w: F.length(w))


def token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of word lengths, framed for a model of 12 tokens."""
    f = _t(spark, sf_dir, "translation_eval").select("id", A.frame(_tokens("source"), 12, 101, 102, 100).alias("f"))
    return f.select("id", *(F.array_join(F.transform(f"f.{c}", lambda x: x.cast("string")), ",").alias(c) for c in ("encoder", "decoder", "label")), F.size(F.filter(A.pad_mask(F.col("f.encoder"), 100), lambda m: m)).alias("n_pads"), F.size(A.trim_tokens(F.col("f.label"), 102, 100)).alias("n_label"))


def banned_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "translation_eval").select("id", F.array_join(F.array_sort(A.banned_next(_tokens("source"), 2)), ",").alias("banned"))


def rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _report(spark, sf_dir)
    words = lambda c: F.filter(F.split(F.lower(T.squeeze(F.col(c))), " "), lambda w: w != "")
    return r.select("run_id", "id", F.round(A.ngram_f1(words("prediction"), words("reference"), 1), 6).alias("f1"), F.round(A.translation_reward(words("prediction"), words("reference")), 6).alias("reward"))


def learning_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "orders").select("o_orderkey", F.round(A.learning_rate(F.col("o_orderkey"), 512, 4000, 1.0) * 1e6, 6).alias("rate"))


def early_stopping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history is one number a day: the least order value; a run stops after five days without a gain."""
    h = _t(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("step")).agg(F.min("o_totalprice").alias("loss"))
    return evaluation.early_stopping(h, 5, 100.0).select("step", "loss", "gained", "bad", "stop")


def case_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.case_problems(_t(spark, sf_dir, "eval_report_rows").select("id", "source", "reference"))


def case_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "translation_eval")
    return e.groupBy("split").agg(F.array_join(F.array_sort(F.collect_set("direction")), "|").alias("directions"), F.countDistinct("id").alias("n_ids"), F.count("*").alias("n"))


def pool_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 50 accepted pairs of each corpus in random order."""
    j = _judged(spark, sf_dir).where("reason IS NULL")
    ranked = j.select("corpus", "pair_id", corpus.shuffled_rank(T.exact_key(F.col("zh"), F.col("en")), 17).alias("r"))
    return ranked.withColumn("k", F.row_number().over(Window.partitionBy("corpus").orderBy("r", "pair_id"))).where("k <= 50").select("corpus", "pair_id", "k")


def reasons_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.windowed_reasons(_t(spark, sf_dir, "parallel_pairs"), "created_at")


QUERIES = {
    f.__name__: f
    for f in (corpus_rejections, pair_reasons, pair_totals, accepted_pairs, corpus_metadata, source_statistics, fast_length, scan_until, finetune_reasons, alignment_reasons, domain_counts, domain_caps, mixture_selection, train_split, fraction_split, raw_new_pairs, raw_parse, facts, directions, immutable_tokens, glossary_hits, glossary_applied, context_rules, quality_issues, quality_by_code, review_stats, candidate_verdicts, case_scores, eval_summary, paired_difference, bootstrap, promotion_gate, cache_latest, cache_hits, paragraph_context, paragraph_keys, document_samples, markdown_lines, roundtrip_lines, sentence_counts, model_splits, document_context, micro_batches, chrf_plus, unpaired_cases, loss_gate, markdown_translated, tidy_targets, peeled_sides, clause_counts, corpora_joined, token_frames, banned_tokens, rewards, learning_rates, early_stopping, case_problems, case_sets, pool_ranks, reasons_by_day)
}
