"""SQL that DuckDB can hold against the queries of this subpackage."""

from __future__ import annotations

import math

_GROUPS = r"""
folded AS (
  SELECT DISTINCT term_id, CASE WHEN regexp_matches(term, '[\p{Han}\p{Katakana}\p{Hiragana}]') THEN term
    ELSE regexp_replace(lower(strip_accents(translate(term,
    'ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ', 'abcdefghijklmnopqrstuvwxyz'))), '[^\p{L}\p{N}\p{M}]', '', 'g') END AS term
  FROM terms WHERE term_id IS NOT NULL AND term IS NOT NULL),
groups AS (
  SELECT term_id, term, min(term_id) OVER (PARTITION BY term) AS gid FROM folded WHERE term <> ''),
once AS (
  SELECT DISTINCT doc_id, gid, term, term_id, coalesce(tf, len(positions)) AS tf, positions
  FROM postings JOIN groups USING (term_id) WHERE doc_id IS NOT NULL)"""

_SCORES = (
    _GROUPS
    + """,
spelled AS (SELECT doc_id, gid, term_id, sum(tf) AS tf FROM once WHERE tf > 0 GROUP BY ALL),
per AS (SELECT doc_id, gid, sum(tf) AS tf, arg_max(term_id, tf * 1000000000.0 - term_id) AS term_id FROM spelled GROUP BY ALL),
stats AS (SELECT gid, count(*) AS df, sum(tf) AS cf FROM per GROUP BY ALL),
size AS (SELECT doc_id, sum(tf) AS len FROM per GROUP BY ALL),
total AS (SELECT count(DISTINCT doc_id)::DOUBLE AS n FROM postings),
scored AS (
  SELECT doc_id, term_id, tf::BIGINT AS tf, df::BIGINT AS doc_freq, cf::BIGINT AS coll_freq, gid,
    tf * (-log2(df / n) + log2(1 - exp(-cf / n))) / len * tf / cf AS score
  FROM per JOIN stats USING (gid) JOIN size USING (doc_id) CROSS JOIN total)"""
)

_TERMS = (
    _GROUPS
    + """,
counted AS (SELECT term, sum(tf)::BIGINT AS occurrences, count(DISTINCT doc_id)::BIGINT AS doc_count FROM once GROUP BY term),
marked AS (
  SELECT *, CASE WHEN doc_count <= 2 THEN 'rare'
    WHEN doc_count > 0.25 * (SELECT count(DISTINCT doc_id) FROM once) THEN 'common' END AS mark FROM counted)"""
)


_LINES = r"""
split AS (
  SELECT doc_id, content_text, string_split(content_text, chr(10)) AS parts,
    regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\.', '') AS site
  FROM documents WHERE content_text IS NOT NULL AND doc_id IS NOT NULL),
line AS (
  SELECT doc_id, site, i - 1 AS line_no, parts[i] AS raw, regexp_replace(lower(parts[i]), '[^\p{L}]', '', 'g') AS key
  FROM split, LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i)),
often AS (
  SELECT site, key FROM line WHERE key <> '' GROUP BY ALL HAVING count(DISTINCT doc_id) >= 5)"""

#: Tails of the chi-squared distribution of one degree of freedom by tenths; beyond the last one all pairs are significant.
_TAILS = ", ".join(repr(math.erfc(math.sqrt(b / 20))) for b in range(800))


def _part(k: str, n: str, p: str) -> str:
    return f"(CASE WHEN {k} > 0 THEN {k} * ln({p}) ELSE 0 END + CASE WHEN {n} > {k} THEN ({n} - {k}) * ln(1 - {p}) ELSE 0 END)"


_GAIN = f"2 * ({_part('k1', 'n1', 'k1 / n1')} + {_part('k2', 'n2', 'k2 / n2')} - {_part('k1', 'n1', '(k1 + k2) / (n1 + n2)')} - {_part('k2', 'n2', '(k1 + k2) / (n1 + n2)')})"
_RATIOS = (
    _LINES
    + f""",
pair AS (SELECT site, key, count(DISTINCT doc_id) AS docs FROM line WHERE key <> '' GROUP BY ALL),
sites AS (SELECT site, count(*) AS n FROM split GROUP BY ALL),
counted AS (SELECT site, key, docs, count(*) OVER (PARTITION BY key) - 1 AS outside, docs::DOUBLE AS k1, n::DOUBLE AS n1,
  (count(*) OVER (PARTITION BY key) - 1)::DOUBLE AS k2, ((SELECT sum(n) FROM sites) - n)::DOUBLE AS n2 FROM pair JOIN sites USING (site)),
rated AS (SELECT *, CASE WHEN n2 > 0 AND k1 * n2 > k2 * n1 THEN greatest({_GAIN}, 0) ELSE 0 END AS ratio FROM counted),
bins AS (SELECT least(floor(ratio * 10), 799)::INT AS bin, count(*) AS n FROM rated GROUP BY ALL),
above AS (SELECT bin, sum(n) OVER (ORDER BY bin DESC) AS above FROM bins),
bound AS (SELECT min(bin) * 0.1 AS least FROM above WHERE (SELECT count(*) FROM pair) * [{_TAILS}][bin + 1] <= 0.01 * above)"""
)


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"""WITH {_SCORES}
SELECT doc_id, arg_max(term_id, score) AS term_id FROM scored SEMI JOIN term_checks USING (doc_id) GROUP BY doc_id""",
        "p1_scores": f"""WITH {_SCORES}
SELECT doc_id, term_id, tf, doc_freq, coll_freq, round(score, 6) + 0.0 AS score FROM scored""",
        "p3_found": f"WITH {_TERMS} SELECT term, mark FROM marked WHERE mark IS NOT NULL",
        "p3_terms": f"WITH {_TERMS} SELECT term, occurrences, doc_count, mark FROM marked",
        "p7_found": f"WITH {_LINES} SELECT doc_id, line_no::INT AS line_no FROM line SEMI JOIN often USING (site, key)",
        "p7_lines": f"""WITH {_RATIOS}
SELECT site, docs, outside, round(ratio, 4) + 0.0 AS ratio, ratio >= (SELECT least FROM bound) AS significant FROM rated WHERE docs >= 5""",
        "p7_cleaned": f"""WITH {_LINES}, kept AS (
  SELECT doc_id, string_agg(raw, chr(10) ORDER BY line_no) AS content_text FROM line ANTI JOIN often USING (site, key) GROUP BY doc_id)
SELECT doc_id, CASE WHEN d.content_text IS NOT NULL THEN coalesce(k.content_text, '') END AS content_text
FROM documents d LEFT JOIN kept k USING (doc_id)""",
    }
