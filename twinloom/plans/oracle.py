"""SQL that says the same as the named queries, for another engine (RE2 expressions: no look-around)."""

from __future__ import annotations

import math
import unicodedata

# The rules' constants, stated anew so that a wrong one in the library shows.
WS = r"\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
HAN = r"\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}"
HAN_WIDE = r"\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}"
NUMBER = r"\p{Nd}+(?:[.,]\p{Nd}+)?"
MILITARY = "mortar shell|rocket|artillery|rifle|grenade|military|soldier|attack|missile|ammunition"
TECHNICAL = "API|GPU|CPU|model|algorithm|database|software|hardware|network|training|inference"
LITERARY = "castle|moor|shroud|lineage|shadow|soul|whispered|ancient|poem|novel"
SHROUD = ("裹尸", "帷幕", "笼罩", "遮蔽", "面纱")
MORTAR_MILITARY = ("迫击炮",)
MORTAR_BUILDING = ("灰浆", "灰泥", "水泥", "砂浆", "研钵")
SEMANTIC_RISK = "理性|本能|混沌|谱系|血脉|荒原|帷幕|石板|隐喻|偏差|量化|显存|修辞|演化"
PROMPT_LEAK = "(?i)<translation>|</translation>|原文[:：]|初译[:：]|system prompt|assistant:"
ENTITIES = {"&quot;": '"', "&#39;": "''", "&lt;": "<", "&gt;": ">", "&amp;": "&"}
# Compatibility forms of one character (wide forms, radicals, ideographs, spaces), from the Unicode data.
FORMS = {c: n for low, high in ((0xA0, 0xA0), (0x2000, 0x200A), (0x202F, 0x202F), (0x2F00, 0x2FD5), (0x3000, 0x3000), (0xF900, 0xFA6D), (0xFF01, 0xFF5E)) for c in map(chr, range(low, high + 1)) if len(n := unicodedata.normalize("NFKC", c)) == 1 and n != c}
LONGER = {c: unicodedata.normalize("NFKC", c) for c in "…ﬀﬁﬂﬃﬄ"}

#: Letters and digits beyond ASCII; as underscores they block the ASCII word boundaries where Unicode's would.
UNI = r"[\p{Han}\p{Cyrillic}\p{Greek}\p{Armenian}\p{Hiragana}\p{Katakana}\p{Hangul}\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}\x{300}-\x{36f}\x{ff10}-\x{ff19}\x{ff21}-\x{ff3a}\x{ff41}-\x{ff5a}\x{fb00}-\x{fb06}\x{200c}\x{200d}]"


def sq(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '[{WS}]+', ' ', 'g'), ' ')"


def norm(x: str) -> str:
    """Entities, compatibility forms and invisible characters resolved, then squeezed."""
    x = f"coalesce({x}, '')"
    for a, b in (ENTITIES | LONGER).items():
        x = f"replace({x}, '{a}', '{b}')"
    out, into = ("".join(v).replace("'", "''") for v in (FORMS.keys(), FORMS.values()))
    x = f"nfc_normalize(translate({x}, '{out}', '{into}'))"
    return sq(f"replace(replace({x}, chr(8203), ''), chr(65279), '')")


def ordered(x: str) -> str:
    """Distinct elements in order of occurrence."""
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


def strip(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '^[{WS}]+|[{WS}]+$', '', 'g')"


def ascii_words(x: str) -> str:
    return f"regexp_replace({x}, '{UNI}', '_', 'g')"


def n_of(x: str, cls: str) -> str:
    return f"length(regexp_replace({x}, '[^{cls}]', '', 'g'))"


def numbers(x: str) -> str:
    return f"list_distinct(regexp_extract_all(coalesce({x}, ''), '{NUMBER}'))"


def acronyms(x: str) -> str:
    doubled = f"regexp_replace(coalesce({x}, ''), '([^A-Za-z0-9.-])', '\\1\\1', 'g')"
    found = f"regexp_extract_all({doubled}, '(?:^|[^A-Za-z0-9])([A-Z][A-Z0-9.-]+)(?:[^A-Za-z0-9]|$)', 1)"
    return ordered(f"list_transform({found}, lambda x: regexp_replace(x, '\\.+$', ''))")


def n_entities(x: str) -> str:
    return f"len(list_distinct(regexp_extract_all({ascii_words(f'coalesce({x}, {chr(39)}{chr(39)})')}, '\\b[A-Z][a-z]{{2,}}(?:[{WS}]+[A-Z][a-z]{{2,}}){{1,3}}\\b')))"


def any_in(x: str, terms: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{t}')" for t in terms) + ")"


PAIRS = f"pairs AS (SELECT pair_id, corpus, domain, created_at, {sq('translation.zh_CN')} AS zh, {sq('translation.en_GB')} AS en FROM parallel_pairs)"
CLEAN = f"pairs AS (SELECT pair_id, corpus, domain, created_at, {norm('translation.zh_CN')} AS zh, {norm('translation.en_GB')} AS en FROM parallel_pairs)"
REASON = f"""CASE WHEN zh = '' OR en = '' THEN 'empty'
  WHEN regexp_matches(zh || en, '[\\x{{fffd}}\\x{{00}}]') THEN 'invalid_character'
  WHEN NOT (length(zh) BETWEEN 2 AND 500 AND length(en) BETWEEN 2 AND 500) THEN 'length'
  WHEN NOT regexp_matches(zh, '[{HAN}]') OR NOT regexp_matches(en, '[A-Za-z]') THEN 'language'
  WHEN lower(zh) = lower(en) THEN 'identical'
  WHEN NOT (length(en) * 1.0 / greatest(length(zh), 1) BETWEEN 0.3 AND 8.0) THEN 'length_ratio'
  WHEN {n_of('zh', 'A-Za-z')} > greatest(12, floor(length(zh) * 0.35)) THEN 'english_leakage'
  WHEN {n_of('en', HAN)} > greatest(6, floor(length(en) * 0.2)) THEN 'chinese_leakage' END"""


def judged(reason: str = REASON) -> str:
    return f"""{CLEAN}, r AS MATERIALIZED (SELECT *, {reason} AS reason0 FROM pairs),
j AS (SELECT *, CASE WHEN reason0 IS NOT NULL THEN reason0
  WHEN row_number() OVER (PARTITION BY reason0 IS NULL, lower(zh), lower(en) ORDER BY pair_id) > 1 THEN 'duplicate' END AS reason FROM r)"""


JUDGED = judged()


def finetune(s: str, t: str, zh_source: bool) -> str:
    hs, ht = n_of(s, HAN_WIDE), n_of(t, HAN_WIDE)
    if zh_source:
        rules = f"WHEN {hs} < 2 THEN 'source_language' WHEN NOT regexp_matches({t}, '[A-Za-z]') THEN 'target_language' WHEN {ht} > greatest(2, length({t}) // 10) THEN 'target_cjk'"
        ratio = f"length({t}) * 1.0 / greatest({hs}, 1)"
    else:
        rules = f"WHEN {n_of(s, 'A-Za-z')} < 2 THEN 'source_language' WHEN {ht} < 2 THEN 'target_language' WHEN {hs} > greatest(2, length({s}) // 10) THEN 'source_cjk'"
        ratio = f"length({s}) * 1.0 / greatest({ht}, 1)"
    return f"""CASE WHEN {s} = '' OR {t} = '' THEN 'empty'
  WHEN length({s}) < 2 OR length({t}) < 2 OR length({s}) > 600 OR length({t}) > 900 THEN 'length' {rules}
  WHEN lower({s}) = lower({t}) THEN 'identical' WHEN {ratio} < 0.45 OR {ratio} > 18.0 THEN 'length_ratio'
  WHEN regexp_matches({s}, '^(?:/|https?://)') THEN 'path_or_url' END"""


def domain_sql() -> str:
    joined = ascii_words("en || ' ' || zh")
    word = lambda w: f"regexp_matches({joined}, '(?i)\\b(?:{w})\\b')"
    return f"CASE WHEN {word(MILITARY)} THEN 'military' WHEN {word(TECHNICAL)} THEN 'technical' WHEN {word(LITERARY)} THEN 'literary' ELSE 'general' END"


ALIGNMENT = f"""{PAIRS}, good AS (SELECT *, {numbers('en')} AS nums, {acronyms('en')} AS acr FROM pairs WHERE ({finetune('en', 'zh', False)}) IS NULL),
listed AS (SELECT DISTINCT lower(en) AS e, lower(zh) AS z FROM pairs WHERE corpus LIKE '%talks%' AND contains(en, 'street lamp')),
al AS (SELECT g.*, CASE WHEN l.e IS NOT NULL THEN 'blacklisted_pair'
  WHEN contains(lower(en), 'borrowed the muddy school kitchen') THEN 'blacklisted_source'
  WHEN len(nums) > 0 AND len(list_filter(nums, lambda x: contains(zh, x))) * 1.0 / len(nums) < 0.6 THEN 'number_mismatch'
  WHEN len(acr) > 0 AND len(list_filter(acr, lambda x: contains(zh, x))) = 0 THEN 'acronym_mismatch'
  WHEN contains(lower(en), 'shroud') AND NOT {any_in('zh', SHROUD)} THEN 'shroud_alignment'
  WHEN contains(lower(en), 'mortar') AND NOT (CASE WHEN regexp_matches({ascii_words('en')}, '(?i)\\b(?:{MILITARY})\\b') THEN {any_in('zh', MORTAR_MILITARY)} ELSE {any_in('zh', MORTAR_BUILDING)} END) THEN 'mortar_alignment' END AS reason
  FROM good g LEFT JOIN listed l ON lower(g.en) = l.e AND lower(g.zh) = l.z)"""

REPORT = """rep AS (SELECT m.run_id, m.id, m.r.prediction AS prediction, m.r.direction AS direction, m.r.category AS category, m.r.source AS source, m.r.reference AS reference,
  coalesce(e.required_terms, []) AS required_terms, coalesce(e.terminology, []) AS terminology, coalesce(e.forbidden_terms, []) AS forbidden_terms, coalesce(e.preserve, []) AS preserve
  FROM (SELECT run_id, id, max({'prediction': coalesce(prediction, ''), 'direction': direction, 'category': category, 'source': source, 'reference': reference, 'split': split}) AS r FROM eval_report_rows GROUP BY run_id, id) m
  JOIN translation_eval e ON e.id = m.id)"""

_CLAUSE = r"(?i)[,，;；:：]|\b(?:which|that|whose|while|although|because|whereas|from which)\b"
_HAN_P, _LAT_P = n_of("prediction", HAN_WIDE), n_of("prediction", "A-Za-z")
_RATIO = f"length(regexp_replace(prediction, '[{WS}]+', '', 'g')) * 1.0 / greatest(length(regexp_replace(source, '[{WS}]+', '', 'g')), 1)"
CODES = {
    "empty": f"NOT regexp_matches(prediction, '[^{WS}]')",
    "long_paragraph": "length(source) >= CASE WHEN direction = 'zh-en' THEN 100 ELSE 180 END",
    "complex_syntax": f"len(regexp_extract_all({ascii_words('source')}, '{_CLAUSE}')) >= CASE WHEN direction = 'zh-en' THEN 2 ELSE 4 END",
    "entity_consistency": f"{n_entities('source')} >= 2",
    "semantic_domain": f"direction = 'zh-en' AND regexp_matches(source, '{SEMANTIC_RISK}')",
    "technical_density": f"len({acronyms('source')}) >= 2",
    "missing_number": f"len(list_filter({numbers('source')}, lambda x: NOT contains(prediction, x))) > 0",
    "missing_acronym": f"len(list_filter({acronyms('source')}, lambda x: NOT contains(prediction, x))) > 0",
    "language_leakage": f"CASE WHEN direction = 'en-zh' THEN length(prediction) >= 30 AND {_HAN_P} < greatest(3, {_LAT_P} // 8) ELSE length(prediction) >= 20 AND {_LAT_P} < greatest(3, {_HAN_P} // 3) END",
    "prompt_leakage": f"regexp_matches(prediction, '{PROMPT_LEAK}')",
    "length_ratio": f"prediction <> '' AND NOT ({_RATIO} BETWEEN CASE WHEN direction = 'en-zh' THEN 0.25 ELSE 0.35 END AND CASE WHEN direction = 'en-zh' THEN 2.2 ELSE 3.2 END)",
}
_WORDY = r"0-9a-z_\p{L}\p{N}"
_AFTER = "0-9A-Za-z_\\p{L}\\p{N}\\p{M}"


def words_of(x: str) -> str:
    return f"string_split(regexp_replace(lower({x}), '[{WS},;:-]+', ' ', 'g'), ' ')"


def repeated(x: str) -> str:
    """A word said three times in a row (the words are in a column `wd`), or a Chinese phrase."""
    word = f"len(list_filter(range(2, len(wd)), lambda i: CASE WHEN ends_with(wd[i - 1], wd[i]) AND starts_with(wd[i + 1], wd[i]) THEN regexp_full_match(wd[i], '[a-z]{{2,}}') AND regexp_matches(wd[i - 1], '(^|[^{_WORDY}])' || wd[i] || '$') AND regexp_matches(wd[i + 1], '^' || wd[i] || '($|[^{_WORDY}])') ELSE false END)) > 0"
    at, n = "(k // 7 + 1)", "(k % 7 + 2)"
    again = f"substr({x}, {at} + {n}, 1)"
    phrase = f"len(list_filter(range(0, 7 * length({x})), lambda k: CASE WHEN {again} = substr({x}, {at}, 1) OR regexp_matches({again}, '[的{WS}]') THEN regexp_full_match(substr({x}, {at}, {n}), '[{HAN}]{{2,8}}') AND regexp_matches(substr({x}, {at} + {n}), '^(?:的?[{WS}]*' || substr({x}, {at}, {n}) || '){{2}}') ELSE false END)) > 0"
    return f"(({word}) OR ({phrase}))"


CONTEXT = rf"""WITH RECURSIVE g AS (SELECT source, max({{'target': target, 'aliases': coalesce(aliases, [])}}) AS m FROM glossary_entries WHERE direction = 'en-zh' GROUP BY source),
rules AS (SELECT row_number() OVER (ORDER BY no, source) AS k, * FROM (
  SELECT 1 AS no, 'gateway' AS source, 'network gateway' AS rewrite, '网关' AS target, ['大门'] AS forbidden, '(?i)\bAPI\b' AS given, '(?i)\bcastle\b' AS barred
  UNION ALL SELECT 2, 'bracket', 'support bracket', '支架', [], '(?i)\bhinge\b', '^$a'
  UNION ALL SELECT 3, source, source || ' [' || m.target || ']', m.target, m.aliases, '', '\[' FROM g)),
w AS (SELECT id, source, source AS t, []::VARCHAR[] AS required, []::VARCHAR[] AS forbidden, 0::BIGINT AS k FROM translation_eval WHERE direction = 'en-zh'
  UNION ALL SELECT id, w.source, CASE WHEN fires THEN regexp_replace(t, pattern, '\1' || rewrite || '\2', 'g') ELSE t END, CASE WHEN fires THEN list_append(required, target) ELSE required END, CASE WHEN fires THEN list_concat(forbidden, more) ELSE forbidden END, k
  FROM (SELECT w.id, w.source, w.t, w.required, w.forbidden, r.k, r.rewrite, r.target, r.forbidden AS more, '(?i)(^|[^{_AFTER}])' || regexp_escape(r.source) || '($|[^{_AFTER}])' AS pattern,
    CASE WHEN contains(lower(t), lower(r.source)) THEN regexp_matches(t, '(?i)(^|[^{_AFTER}])' || regexp_escape(r.source) || '($|[^{_AFTER}])') AND regexp_matches(w.source, r.given) AND NOT regexp_matches(w.source, r.barred) ELSE false END AS fires FROM w JOIN rules r ON r.k = w.k + 1) w)
SELECT id, t AS rewritten, array_to_string({ordered('required')}, '|') AS required, array_to_string({ordered('forbidden')}, '|') AS forbidden FROM w WHERE k = (SELECT max(k) FROM rules)"""
CODES["repetition"] = repeated("prediction")
WEIGHTS = {"empty": 100, "long_paragraph": 35, "complex_syntax": 35, "entity_consistency": 35, "semantic_domain": 35, "technical_density": 35, "missing_number": 55, "missing_acronym": 35, "language_leakage": 45, "repetition": 45, "prompt_leakage": 70, "length_ratio": 30}
CRITICAL = ("empty", "missing_number", "missing_acronym", "language_leakage", "repetition", "prompt_leakage")
FLAGS = f"flags AS MATERIALIZED (SELECT *, {', '.join(f'coalesce({v}, false) AS is_{k}' for k, v in CODES.items())} FROM (SELECT *, {words_of('prediction')} AS wd FROM rep))"
JUDGEMENT = f"jd AS (SELECT *, least(100, {' + '.join(f'{w} * is_{k}::INTEGER' for k, w in WEIGHTS.items())}) AS score, ({' OR '.join(f'is_{k}' for k in CRITICAL)}) AS has_critical FROM flags)"
_FOLD = lambda c: f"len(list_filter({c}, lambda x: contains(lower(prediction), lower(x))))"
_LEAK = f"CASE WHEN direction = 'en-zh' THEN length(candidate) >= 30 AND {n_of('candidate', HAN_WIDE)} < greatest(3, {n_of('candidate', 'A-Za-z')} // 8) ELSE length(candidate) >= 20 AND {n_of('candidate', 'A-Za-z')} < greatest(3, {n_of('candidate', HAN_WIDE)} // 3) END"
VERDICTS = f"""WITH {REPORT}, v AS (SELECT a.source, a.direction, a.required_terms, a.forbidden_terms, a.prediction AS draft, b.prediction AS candidate, {words_of('b.prediction')} AS wd FROM rep a JOIN rep b ON a.id = b.id AND a.run_id = 'run-base' AND b.run_id = 'run-cand'),
r AS (SELECT CASE WHEN NOT regexp_matches(candidate, '[^{WS}]') THEN 'empty' WHEN regexp_matches(candidate, '{PROMPT_LEAK}') THEN 'prompt_leakage'
  WHEN len(list_filter({numbers('source')}, lambda x: NOT contains(candidate, x))) > 0 THEN 'missing_number' WHEN len(list_filter({acronyms('source')}, lambda x: NOT contains(candidate, x))) > 0 THEN 'missing_acronym'
  WHEN len(list_filter(required_terms, lambda x: x <> '' AND NOT contains(lower(candidate), lower(x)))) > 0 THEN 'required_term' WHEN len(list_filter(forbidden_terms, lambda x: x <> '' AND contains(lower(candidate), lower(x)))) > 0 THEN 'forbidden_term'
  WHEN {_LEAK} THEN 'language_leakage' WHEN {repeated('candidate')} THEN 'repetition'
  WHEN length(candidate) < greatest(2, floor(length(draft) * 0.35)) THEN 'shortened' WHEN length(candidate) > greatest(80, floor(length(draft) * 2.5)) THEN 'inflated' ELSE 'ok' END AS reason FROM v)
SELECT reason, count(*) AS n FROM r GROUP BY reason"""
_RATIOS = (("required_accuracy", "required"), ("term_accuracy", "terms"), ("preserve_accuracy", "preserve"), ("number_accuracy", "numbers"))
SCORES = f"""{REPORT}, h AS (SELECT *, lower({sq('prediction')}) AS h, lower({sq('reference')}) AS r, {numbers('source')} AS nums FROM rep),
gh AS (SELECT run_id, id, n, substr(h, i, n) AS g, count(*) AS c FROM (SELECT run_id, id, h, n, unnest(range(1, length(h) - n + 2)) AS i FROM h, (SELECT unnest(range(1, 7)) AS n)) GROUP BY ALL),
gr AS (SELECT run_id, id, n, substr(r, i, n) AS g, count(*) AS c FROM (SELECT run_id, id, r, n, unnest(range(1, length(r) - n + 2)) AS i FROM h, (SELECT unnest(range(1, 7)) AS n)) GROUP BY ALL),
co AS (SELECT run_id, id, n, sum(least(gh.c, gr.c)) AS c FROM gh JOIN gr USING (run_id, id, n, g) GROUP BY run_id, id, n),
pr AS (SELECT h.run_id, h.id, k.n, coalesce(co.c, 0) * 1.0 / greatest(length(h) - k.n + 1, 1) AS p, coalesce(co.c, 0) * 1.0 / greatest(length(r) - k.n + 1, 1) AS q FROM h CROSS JOIN (SELECT unnest(range(1, 7)) AS n) k LEFT JOIN co ON co.run_id = h.run_id AND co.id = h.id AND co.n = k.n),
ch AS (SELECT run_id, id, sum(2 * p * q / greatest(p + q, 1e-12)) * 100 / 6 AS chrf FROM pr GROUP BY run_id, id)"""
SUMMARY = f"""{SCORES}, {FLAGS}, {JUDGEMENT}, sc AS (SELECT h.run_id, h.direction, h.category, ch.chrf, len(h.required_terms) AS n_required, {_FOLD('h.required_terms').replace('prediction', 'h.prediction')} AS hit_required, len(h.terminology) AS n_terms, {_FOLD('h.terminology').replace('prediction', 'h.prediction')} AS hit_terms,
  len(h.preserve) AS n_preserve, len(list_filter(h.preserve, lambda x: contains(h.prediction, x))) AS hit_preserve, len(nums) AS n_numbers, len(list_filter(nums, lambda x: contains(h.prediction, x))) AS hit_numbers,
  ({_FOLD('h.forbidden_terms').replace('prediction', 'h.prediction')} > 0 OR jd.has_critical) AS critical FROM h JOIN ch USING (run_id, id) JOIN jd USING (run_id, id))"""
_MEANS = f"count(*) AS case_count, avg(chrf) AS chrf, avg(chrf) FILTER (category = 'general') AS simple_chrf, {', '.join(f'CASE WHEN sum(n_{x}) = 0 THEN 1.0 ELSE sum(hit_{x}) * 1.0 / sum(n_{x}) END AS {name}' for name, x in _RATIOS)}, sum(critical::INTEGER)::BIGINT AS critical_errors"
_DIFFERENCE = "df AS (SELECT id, max(chrf) FILTER (run_id = 'run-cand') - max(chrf) FILTER (run_id = 'run-base') AS d FROM eval_report_rows WHERE chrf IS NOT NULL GROUP BY id HAVING count(*) FILTER (run_id = 'run-cand') > 0 AND count(*) FILTER (run_id = 'run-base') > 0)"
_CUTS = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(8)]
BOOT = f"""{_DIFFERENCE}, u AS (SELECT d, s, (('0x' || substr(md5(id || '#' || s || '#2026'), 1, 8))::BIGINT + 0.5) / 4294967296.0 AS u FROM df, (SELECT unnest(range(0, 2000)) AS s)),
mw AS (SELECT s, sum(w * d) / greatest(sum(w), 1) AS m FROM (SELECT s, d, {' + '.join(f'(u > {c!r})::INTEGER' for c in _CUTS)} AS w FROM u) GROUP BY s),
bt AS (SELECT (SELECT avg(d) FROM df) AS mean, list_sort(list(m))[51] AS ci95_low, list_sort(list(m))[1951] AS ci95_high FROM mw)"""
CHECKS = {
    "critical_errors_not_worse": "c.critical_errors <= b.critical_errors", "chrf_improved": "c.chrf > b.chrf", "chrf_statistically_significant": "ci95_low > 0",
    "simple_not_regressed": "c.simple_chrf IS NULL OR b.simple_chrf IS NULL OR c.simple_chrf >= b.simple_chrf - 0.5", "terms_not_regressed": "c.term_accuracy >= b.term_accuracy",
    "content_anchors_not_regressed": "c.required_accuracy >= b.required_accuracy", "numbers_complete": "c.number_accuracy >= 1", "preserved_tokens_complete": "c.preserve_accuracy >= 1",
    "critical_errors_zero": "c.critical_errors = 0", "terms_at_least_98_percent": "c.term_accuracy >= 0.98",
}
GATE = f"WITH {SUMMARY}, {BOOT}, sm AS (SELECT run_id, {_MEANS} FROM sc GROUP BY run_id), ck AS (" + " UNION ALL ".join(f"SELECT '{k}' AS check_name, coalesce({v}, false) AS passed FROM sm c, sm b, bt WHERE c.run_id = 'run-cand' AND b.run_id = 'run-base'" for k, v in CHECKS.items()) + ") SELECT check_name, passed FROM ck UNION ALL SELECT 'accepted', bool_and(passed) FROM ck"
_WORDS = lambda x: f"list_filter(string_split(lower({sq(x)}), ' '), lambda w: w <> '')"
_WORD_GRAMS = lambda t, c: f"{t} AS (SELECT run_id, id, n, array_to_string({c}[i:i + n - 1], chr(1)) AS g, count(*) AS c FROM (SELECT run_id, id, {c}, n, unnest(range(1, len({c}) - n + 2)) AS i FROM w, (SELECT unnest([1, 2]) AS n)) GROUP BY ALL)"
REWARDS = f"""WITH {REPORT}, w AS (SELECT run_id, id, {_WORDS('prediction')} AS h, {_WORDS('reference')} AS r FROM rep),
{_WORD_GRAMS('gh', 'h')}, {_WORD_GRAMS('gr', 'r')},
co AS (SELECT run_id, id, n, sum(least(gh.c, gr.c)) AS c FROM gh JOIN gr USING (run_id, id, n, g) GROUP BY run_id, id, n),
pq AS (SELECT w.run_id, w.id, k.n, h, r, coalesce(c, 0) * 1.0 / greatest(len(h) - k.n + 1, 1) AS p, coalesce(c, 0) * 1.0 / greatest(len(r) - k.n + 1, 1) AS q FROM w CROSS JOIN (SELECT unnest([1, 2]) AS n) k LEFT JOIN co ON co.run_id = w.run_id AND co.id = w.id AND co.n = k.n),
f AS (SELECT run_id, id, any_value(len(h)) AS lh, any_value(len(r)) AS lr, sum(CASE WHEN n = 1 THEN 2 * p * q / greatest(p + q, 1e-12) ELSE 0 END) AS f1, sum(CASE WHEN n = 2 THEN 2 * p * q / greatest(p + q, 1e-12) ELSE 0 END) AS f2 FROM pq GROUP BY run_id, id)
SELECT run_id, id, round(f1, 6) AS f1, round(CASE WHEN lh = 0 OR lr = 0 THEN 0 ELSE exp(least(0.0, 1 - lr * 1.0 / lh)) * (0.4 * f1 + 0.6 * f2) END, 6) AS reward FROM f"""
PARAGRAPHS = "para AS (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS body, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) - 1 AS para_no FROM documents WHERE text IS NOT NULL)"
_TOKENS = f"list_transform(list_filter(string_split({sq('source')}, ' '), lambda w: w <> ''), lambda w: length(w))"
_PAD = lambda x: f"list_resize({x}, 12, 100)"
_JOIN = lambda x: f"array_to_string({x}, ',')"
RAW_KEYS = {"zh": ("zh_CN", "zh", "zh-CN"), "en": ("en_GB", "en", "en-US")}


def raw_side(lang: str) -> str:
    paths = [f"""nullif(payload::JSON->>'$.{prefix}"{k}"', '')""" for k in RAW_KEYS[lang] for prefix in ("translation.", "")]
    return f"CASE WHEN json_valid(payload) THEN coalesce({', '.join(paths)}) END"


RAW = f"raw AS (SELECT *, {raw_side('zh')} AS z0, {raw_side('en')} AS e0 FROM raw_records)"

_REASONS = f"WITH {JUDGED} SELECT corpus, coalesce(reason, 'accepted') AS reason, count(*) AS n FROM j GROUP BY ALL"
_CONTEXT = f"""cx AS (SELECT doc_id, CASE WHEN ({n_of('text', HAN_WIDE)} = 0 AND {n_of('text', 'A-Za-z')} = 0) OR {n_of('text', HAN_WIDE)} * 2 >= {n_of('text', 'A-Za-z')} THEN 'zh-en' ELSE 'en-zh' END AS direction, {acronyms('text')} AS acr FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))"""
_LINE = r"\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
_LINES = f"""sp AS (SELECT doc_id, string_split_regex(text, '{_LINE}') AS l FROM documents WHERE text IS NOT NULL),
ln AS (SELECT doc_id, unnest(l) AS body, generate_subscripts(l, 1) AS k, len(l) AS n FROM sp), li AS (SELECT doc_id, body, k, starts_with(ltrim(body, ' '), '```') AS is_fence FROM ln WHERE k < n OR body <> '')"""
_PREFIX = rf"^([{WS}]*(?:#{{1,6}}[{WS}]+|[-*+][{WS}]+|\p{{Nd}}+[.)][{WS}]+|>[{WS}]+))(.*)$"
_KEPT = rf"`[^`]*`|https?://[^{WS}]+|!?\[[^\]]*\]\([^)]*\)"


_LIST = lambda x: f"array_to_string(list_transform({x}, lambda v: to_json(v)::VARCHAR), ', ')"
_ENTITIES = f"regexp_extract_all({ascii_words('text')}, '\\b[A-Z][a-z]{{2,}}(?:[{WS}]+[A-Z][a-z]{{2,}}){{1,3}}\\b')"
PARAGRAPH_KEYS = f"""WITH {PARAGRAPHS}, {_CONTEXT}, g AS (SELECT source, max(target) AS target FROM glossary_entries WHERE direction = 'en-zh' GROUP BY source),
gl AS (SELECT doc_id, string_agg('[' || to_json(g.source)::VARCHAR || ', ' || to_json(trim(g.target))::VARCHAR || ']', ', ' ORDER BY g.source) AS terms FROM documents d JOIN g ON contains(lower(d.text), lower(g.source)) AND g.target <> '' GROUP BY doc_id),
fp AS (SELECT d.doc_id, sha256('{{"acronyms": [' || {_LIST(ordered('acr'))} || '], "entities": [' || CASE WHEN direction = 'en-zh' THEN {_LIST(ordered(_ENTITIES))} ELSE '' END || '], "glossary": [' || coalesce(terms, '') || '], "version": 2}}') AS fingerprint FROM documents d JOIN cx USING (doc_id) LEFT JOIN gl USING (doc_id) WHERE text IS NOT NULL),
w AS (SELECT doc_id, para_no, body, lag(body) OVER (PARTITION BY doc_id ORDER BY para_no) AS p, lead(body) OVER (PARTITION BY doc_id ORDER BY para_no) AS n FROM para)
SELECT doc_id, para_no, sha256('{{"document":"' || fingerprint || '","kind":"reviewed-paragraph","next":' || to_json(left({strip('n')}, 600))::VARCHAR || ',"previous":' || to_json(right({strip('p')}, 600))::VARCHAR || ',"reviewer_enabled":false,"source":' || to_json({strip('body')})::VARCHAR || '}}') AS cache_key FROM w JOIN fp USING (doc_id)"""

SQL = {
    "pair_reasons": _REASONS,
    "corpus_rejections": _REASONS,
    "corpus_metadata": f"""WITH {JUDGED}, h AS (SELECT coalesce(reason, 'accepted') AS reason, count(*) AS n FROM j GROUP BY ALL)
SELECT '{{"scanned":' || sum(n) || ',"accepted":' || coalesce(sum(n) FILTER (reason = 'accepted'), 0) || ',"rejections":{{' || coalesce(string_agg('"' || reason || '":' || n, ',' ORDER BY reason) FILTER (reason <> 'accepted'), '') || '}}}}' AS metadata FROM h""",
    "source_statistics": f"""WITH {JUDGED}, h AS (SELECT corpus, coalesce(reason, 'accepted') AS reason, count(*) AS n FROM j GROUP BY ALL)
SELECT corpus, sum(n)::BIGINT AS n_rows, coalesce(sum(n) FILTER (reason = 'accepted'), 0)::BIGINT AS accepted, '{{' || coalesce(string_agg('"' || reason || '":' || n, ',' ORDER BY reason) FILTER (reason <> 'accepted'), '') || '}}' AS rejected FROM h GROUP BY corpus""",
    "quality_issues": f"WITH {REPORT}, {FLAGS}, c AS (" + " UNION ALL ".join(f"SELECT run_id, direction, '{k}' AS code FROM flags WHERE is_{k}" for k in CODES) + ") SELECT run_id, direction, code, count(*) AS n FROM c GROUP BY ALL",
    "review_stats": f"WITH {REPORT}, {FLAGS}, {JUDGEMENT} SELECT run_id, direction, count(*) AS examined, count(*) FILTER (score >= 35 OR has_critical) AS triggered, count(*) FILTER (has_critical) AS critical, sum(score)::BIGINT AS total_score FROM jd GROUP BY run_id, direction",
    "candidate_verdicts": VERDICTS,
    "paragraph_keys": PARAGRAPH_KEYS,
    "context_rules": CONTEXT,
    "eval_summary": f"WITH {SUMMARY}, sm AS (SELECT run_id, direction, {_MEANS} FROM sc GROUP BY run_id, direction) SELECT run_id, direction, case_count, round(chrf, 4) AS chrf, round(simple_chrf, 4) AS simple_chrf, {', '.join(f'round({name}, 4) AS {name}' for name, _ in _RATIOS)}, critical_errors FROM sm",
    "bootstrap": f"WITH {BOOT} SELECT round(mean, 6) AS mean, round(ci95_low, 6) AS ci95_low, round(ci95_high, 6) AS ci95_high FROM bt",
    "promotion_gate": GATE,
    "unpaired_cases": "WITH s AS (SELECT id, bool_or(run_id = 'run-cand') AS c, bool_or(run_id = 'run-base') AS b FROM eval_report_rows WHERE run_id IN ('run-cand', 'run-base') GROUP BY id) SELECT id, CASE WHEN c THEN 'candidate' ELSE 'baseline' END AS only_in FROM s WHERE c <> b",
    "loss_gate": "WITH d AS (SELECT o_orderdate::DATE AS step, min(o_totalprice) AS l FROM orders GROUP BY ALL) SELECT a.step, round(a.l - b.l, 4) AS change, a.l - b.l <= 50.0 AS loss_gate_passed FROM d a JOIN d b ON a.step = b.step + 1",
    "peeled_sides": f"WITH p AS (SELECT pair_id, coalesce(translation.en_GB, '') AS t, translation.en_GB AS raw FROM parallel_pairs), q AS (SELECT pair_id, t, raw, regexp_extract(t, '^[{WS}]*') AS a, regexp_extract(t, '[{WS}]*$') AS z FROM p) SELECT pair_id, length(a) AS n_leading, CASE WHEN a = t THEN 0 ELSE length(z) END AS n_trailing, md5({strip('t')}) AS core, regexp_matches(t, '[{HAN_WIDE}]') AS zh, regexp_matches(t, '[A-Za-z]') AS en FROM q",
    "clause_counts": "SELECT doc_id, 1 + len(regexp_extract_all(coalesce(text, ''), '[，,、：:]'))::INTEGER AS n_clauses FROM documents",
    "corpora_joined": "SELECT CASE WHEN corpus LIKE '%talks%' THEN 0 ELSE 1 END AS corpus_no, count(*) AS n, count(CASE WHEN corpus LIKE '%talks%' THEN talk_key END) AS n_talk_keys, count(CASE WHEN corpus NOT LIKE '%talks%' THEN domain END) AS n_domains, sum(pair_id)::BIGINT AS id_sum FROM parallel_pairs WHERE corpus IS NOT NULL GROUP BY ALL",
    "markdown_lines": f"WITH {_LINES}, f AS (SELECT *, coalesce(sum(is_fence::INTEGER) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS in_fence, regexp_extract(body, '{_PREFIX}', 1) AS prefix FROM li) SELECT doc_id, count(*) AS n_lines, count(*) FILTER (in_fence) AS n_fenced, count(*) FILTER (prefix <> '') AS n_prefixed, sum(len(regexp_extract_all(substr(body, length(prefix) + 1), '{_KEPT}')))::BIGINT AS n_kept FROM f GROUP BY doc_id",

    "pair_totals": f"WITH {JUDGED} SELECT domain, count(*) AS scanned, count(*) FILTER (reason IS NULL) AS accepted, count(*) FILTER (reason IS NOT NULL) AS rejected FROM j GROUP BY domain",
    "accepted_pairs": f"WITH {JUDGED} SELECT pair_id, zh, en FROM j WHERE reason IS NULL",
    "fast_length": f"WITH {judged(f'coalesce(({REASON}), CASE WHEN length(zh) > 240 OR length(en) > 360 THEN {chr(39)}fast_length{chr(39)} END)')} SELECT coalesce(reason, 'accepted') AS reason, count(*) AS n FROM j GROUP BY ALL",
    "scan_until": f"WITH {JUDGED}, s AS (SELECT max(pair_id) AS stop, count(*) AS k FROM (SELECT pair_id FROM j WHERE reason IS NULL ORDER BY pair_id LIMIT 2000)) SELECT count(*) AS scanned, count(*) FILTER (reason IS NULL) AS accepted, count(*) FILTER (reason IS NOT NULL) AS rejected FROM j, s WHERE k < 2000 OR pair_id <= stop",
    "finetune_reasons": f"WITH {PAIRS}, x AS (SELECT 'zh-en' AS direction, {finetune('zh', 'en', True)} AS reason FROM pairs UNION ALL SELECT 'en-zh', {finetune('en', 'zh', False)} FROM pairs) SELECT direction, coalesce(reason, 'accepted') AS reason, count(*) AS n FROM x GROUP BY ALL",
    "alignment_reasons": f"WITH {ALIGNMENT} SELECT coalesce(reason, 'accepted') AS reason, count(*) AS n FROM al GROUP BY ALL",
    "domain_counts": f"WITH {PAIRS}, d AS (SELECT *, {domain_sql()} AS detected FROM pairs) SELECT corpus, CASE WHEN detected = 'general' THEN domain ELSE detected END AS final_domain, count(*) AS n FROM d GROUP BY ALL",
    "domain_caps": f"WITH {PAIRS}, d AS (SELECT *, {domain_sql()} AS detected FROM pairs), c AS (SELECT CASE WHEN detected = 'general' THEN domain ELSE detected END AS final_domain, count(*) AS n FROM d GROUP BY ALL), t AS (SELECT greatest(1, round_even(sum(n) * 0.03, 0))::BIGINT AS cap FROM c) SELECT final_domain, n, cap, n < cap AS one_more FROM c, t",
    "train_split": f"WITH {JUDGED}, k AS (SELECT pair_id, row_number() OVER (ORDER BY md5(sha1(zh || chr(0) || en) || '#17')) AS n FROM j WHERE reason IS NULL) SELECT pair_id, CASE WHEN n <= 256 THEN 'validation' ELSE 'train' END AS part FROM k WHERE n <= 2000",
    "fraction_split": f"WITH {JUDGED}, k AS (SELECT pair_id, ('0x' || substr(md5(pair_id::VARCHAR || '#17'), 1, 8))::BIGINT / 4294967296.0 AS b FROM j WHERE reason IS NULL) SELECT CASE WHEN b < 0.9 THEN 'train' ELSE 'test' END AS part, count(*) AS n, sum(pair_id)::BIGINT AS id_sum FROM k GROUP BY ALL",
    "raw_new_pairs": f"WITH {CLEAN}, {RAW}, q AS (SELECT feed, {norm('z0')} AS z, {norm('e0')} AS e FROM raw) SELECT feed, count(*) AS n, count(DISTINCT lower(z) || chr(0) || lower(e)) AS n_distinct FROM q WHERE z <> '' AND e <> '' AND NOT EXISTS (SELECT 1 FROM pairs WHERE lower(zh) = lower(z) AND lower(en) = lower(e)) GROUP BY feed",
    "raw_parse": f"WITH {RAW} SELECT CASE WHEN z0 IS NULL AND e0 IS NULL THEN 'none' WHEN z0 IS NULL OR e0 IS NULL THEN 'half' ELSE 'both' END AS shape, count(*) AS n, sum(length(z0))::BIGINT AS zh_chars, sum(length(e0))::BIGINT AS en_chars FROM raw GROUP BY ALL",
    "facts": f"WITH {PAIRS} SELECT pair_id, array_to_string(list_sort({numbers('en')}), '|') AS numbers, array_to_string(list_sort({acronyms('en')}), '|') AS acronyms, {n_entities('en')}::INTEGER AS n_entities FROM pairs",
    "directions": f"WITH d AS (SELECT source, {n_of('coalesce(text, chr(32))', HAN_WIDE)} AS h, {n_of('coalesce(text, chr(32))', 'A-Za-z')} AS l FROM documents) SELECT source, CASE WHEN (h = 0 AND l = 0) OR h * 2 >= l THEN 'zh-en' ELSE 'en-zh' END AS direction, count(*) AS n FROM d GROUP BY ALL",
    "glossary_hits": "SELECT g.source, g.target, count(DISTINCT e.id) AS n FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(source), target, direction) AS k FROM glossary_entries) WHERE k = 1) g JOIN translation_eval e ON e.direction = g.direction AND contains(lower(e.source), lower(g.source)) GROUP BY ALL",
    "quality_by_code": "WITH " + REPORT + ", c AS (" + " UNION ALL ".join(f"SELECT run_id, direction, '{k}' AS code FROM rep WHERE {v}" for k, v in CODES.items()) + ") SELECT run_id, direction, code, count(*) AS n FROM c GROUP BY ALL",
    "case_scores": f"WITH {SCORES} SELECT run_id, id, round(chrf, 4) AS chrf, len(required_terms) AS n_required, {_FOLD('required_terms')} AS hit_required, len(terminology) AS n_terms, {_FOLD('terminology')} AS hit_terms, len(preserve) AS n_preserve, len(list_filter(preserve, lambda x: contains(prediction, x))) AS hit_preserve, len(nums) AS n_numbers, len(list_filter(nums, lambda x: contains(prediction, x))) AS hit_numbers, array_to_string(list_sort(list_distinct(list_filter(required_terms, lambda x: NOT contains(lower(prediction), lower(x))))), '|') AS missing_required_terms, array_to_string(list_sort(list_filter(nums, lambda x: NOT contains(prediction, x))), '|') AS missing_numbers, {_FOLD('forbidden_terms')} AS n_forbidden FROM h JOIN ch USING (run_id, id)",
    "paired_difference": "SELECT id, round(max(chrf) FILTER (run_id = 'run-cand') - max(chrf) FILTER (run_id = 'run-base'), 6) AS d FROM eval_report_rows WHERE chrf IS NOT NULL GROUP BY id HAVING count(*) FILTER (run_id = 'run-cand') > 0 AND count(*) FILTER (run_id = 'run-base') > 0",
    "cache_latest": "SELECT key, coalesce(arg_max(coalesce(translation, ''), line_no), '') AS translation FROM translation_cache WHERE key IS NOT NULL AND signature = '2e02d63f136902dbacd9b1f921b44e14fd35b7f86ffc3872caa37f9b4fbf5352' GROUP BY key",
    "cache_hits": "SELECT e.direction, count(*) AS n, count(c.key) AS hits FROM translation_eval e LEFT JOIN (SELECT DISTINCT key FROM translation_cache WHERE key IS NOT NULL) c ON c.key = sha256(e.source) GROUP BY e.direction",
    "paragraph_context": f"WITH {PARAGRAPHS}, w AS (SELECT doc_id, {strip('lag(body) OVER (PARTITION BY doc_id ORDER BY para_no)')} AS p, {strip('lead(body) OVER (PARTITION BY doc_id ORDER BY para_no)')} AS q FROM para) SELECT doc_id, count(*) AS n_paragraphs, sum(least(length(p), 600))::BIGINT AS previous_chars, sum(least(length(q), 600))::BIGINT AS next_chars FROM w GROUP BY doc_id",
    "document_samples": f"WITH {PARAGRAPHS}, w AS (SELECT *, coalesce(sum(length(body)) OVER (PARTITION BY doc_id ORDER BY para_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM para WHERE regexp_matches(body, '[^{WS}]')), t AS (SELECT doc_id, left(string_agg(body, chr(10) ORDER BY para_no), 500) AS text FROM w WHERE b < 500 GROUP BY doc_id) SELECT doc_id, length(text) AS n_chars, md5(text) AS digest FROM t",
    "roundtrip_lines": f"WITH {_LINES}, c AS (SELECT doc_id, count(*) AS n FROM li GROUP BY doc_id) SELECT d.doc_id, c.n AS n_lines, md5(d.text) AS digest FROM documents d JOIN c USING (doc_id) WHERE d.text <> ''",
    "sentence_counts": f"WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[^。！？!?；;\\n.]*[。！？!?；;\\n.][”’」』】）》)\\]\"]*|[^。！？!?；;\\n.]+$'), lambda x: {strip('x')}), lambda x: x <> '') AS s FROM documents) SELECT doc_id, len(s) AS n_sentences, md5(array_to_string(s, chr(10))) AS digest FROM s",
    "document_context": f"WITH {_CONTEXT} SELECT d.doc_id, array_to_string(list_sort(acr), '|') AS acronyms, CASE WHEN direction = 'en-zh' THEN {n_entities('d.text')} ELSE 0 END AS n_entities FROM documents d JOIN cx USING (doc_id)",
    "micro_batches": "WITH b AS (SELECT id, direction, length(source) AS length, (row_number() OVER (PARTITION BY direction ORDER BY id) - 1) // 8 AS batch FROM translation_eval) SELECT id, batch, length, max(length) OVER (PARTITION BY direction, batch) AS batch_length FROM b",
    "token_frames": f"WITH t AS (SELECT id, {_TOKENS} AS t FROM translation_eval) SELECT id, {_JOIN(_PAD('list_concat([101], t[1:10], [102])'))} AS encoder, {_JOIN(_PAD('list_concat([101], t[1:11])'))} AS decoder, {_JOIN(_PAD('list_concat(t[1:11], [102])'))} AS label, greatest(12 - len(t[1:10]) - 2, 0) + len(list_filter(t[1:10], lambda x: x = 100)) AS n_pads, CASE WHEN list_position(t[1:11], 102) > 0 THEN len(list_filter(t[1:list_position(t[1:11], 102) - 1], lambda x: x <> 100)) ELSE len(list_filter(t[1:11], lambda x: x <> 100)) END AS n_label FROM t",
    "banned_tokens": f"WITH t AS (SELECT id, {_TOKENS} AS t FROM translation_eval) SELECT id, array_to_string(list_sort(list_distinct(list_transform(list_filter(range(1, len(t)), lambda i: t[i] = t[-1]), lambda i: t[i + 1]))), ',') AS banned FROM t",
    "rewards": REWARDS,
    "learning_rates": "SELECT o_orderkey, round(pow(512, -0.5) * least(pow(greatest(o_orderkey, 1), -0.5), greatest(o_orderkey, 1) * pow(4000, -1.5)) * 1e6, 6) AS rate FROM orders",
    "early_stopping": "WITH h AS (SELECT o_orderdate::DATE AS step, min(o_totalprice) AS loss FROM orders GROUP BY ALL), b AS (SELECT *, min(loss) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best, row_number() OVER (ORDER BY step) AS n FROM h), g AS (SELECT *, best IS NULL OR loss < best - 100.0 AS gained FROM b), k AS (SELECT *, n - max(CASE WHEN gained THEN n END) OVER (ORDER BY step) AS bad FROM g) SELECT step, loss, gained, bad, bad >= 5 AS stop FROM k",
    "case_problems": f"SELECT id, 'empty_text' AS problem FROM eval_report_rows WHERE trim(coalesce(source, '')) = '' OR trim(coalesce(reference, '')) = '' UNION ALL SELECT id, 'duplicate_id' FROM eval_report_rows GROUP BY id HAVING count(*) > 1",
    "case_sets": "SELECT split, array_to_string(list_sort(list_distinct(list(direction))), '|') AS directions, count(DISTINCT id) AS n_ids, count(*) AS n FROM translation_eval GROUP BY split",
    "pool_ranks": f"WITH {JUDGED}, k AS (SELECT corpus, pair_id, row_number() OVER (PARTITION BY corpus ORDER BY md5(sha1(zh || chr(0) || en) || '#17'), pair_id) AS k FROM j WHERE reason IS NULL) SELECT * FROM k WHERE k <= 50",
    "reasons_by_day": f"WITH {CLEAN} SELECT date_trunc('day', created_at) AS day, coalesce({REASON}, 'accepted') AS reason, count(*) AS n FROM pairs WHERE created_at IS NOT NULL GROUP BY ALL",
}
