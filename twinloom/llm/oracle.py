"""SQL of the training-data queries that SQL can say on whole tables."""

from __future__ import annotations

from twinloom.llm.duplicates import FOLDED, KEPT_FORMS

_SPACE = r"\x{09}-\x{0d}\x{20}\x{85}\x{1680}\x{2000}-\x{2006}\x{2008}-\x{200a}\x{2028}\x{2029}\x{205f}\x{3000}"


def content(x: str) -> str:
    """As duplicates.content. A point between digits is kept under another character (twice, as matches can't overlap)."""
    for letter, by in KEPT_FORMS.items():
        x = f"replace({x}, '{letter}', '{by}')"
    x = f"lower({x})"
    for letter, by in FOLDED.items():
        x = f"replace({x}, '{letter}', '{by}')"
    for point, by in (("[.]", ""), ("．", "")):
        for _ in range(2):
            x = f"regexp_replace({x}, '(\\p{{Nd}}){point}(\\p{{Nd}})', '\\1{by}\\2', 'g')"
    return f"nullif(regexp_replace({x}, '[\\p{{P}}{_SPACE}]+', '', 'g'), '')"


def _side(names: tuple[str, ...]) -> str:
    paths = [f"""nullif(payload::JSON->>'$.{prefix}"{k}"', '')""" for k in names for prefix in ("translation.", "")]
    return f"CASE WHEN json_valid(payload) THEN coalesce({', '.join(paths)}) END"


_RECORDS = f"""WITH s AS (SELECT pair_id AS id, translation.zh_CN AS z, translation.en_GB AS e FROM parallel_pairs
  UNION ALL SELECT record_id, {_side(('zh_CN', 'zh', 'zh-CN'))}, {_side(('en_GB', 'en', 'en-US'))} FROM raw_records),
c AS (SELECT id, {content('z')} AS a, {content('e')} AS b FROM s),
g AS (SELECT id, min(id) OVER w AS keep_id, count(*) OVER w AS n FROM c WHERE a IS NOT NULL AND b IS NOT NULL WINDOW w AS (PARTITION BY least(a, b), greatest(a, b)))"""

SQL = {
    "p3_found": _RECORDS + " SELECT keep_id, id AS copy_id FROM g WHERE id <> keep_id",
    "p3_distinct_records": _RECORDS + " SELECT keep_id, n AS n_copies FROM g WHERE id = keep_id",
}
