"""SQL counterparts of the named query plans, for DuckDB over the same tables.

The stemmer here is written on its own, as stages of suffix tests, so that it checks
the one the engine uses.
"""

from __future__ import annotations

from lodequery.functions.clean import DROPPED, JS_SPACE, WIDE_SPACES
from lodequery.functions.text import STOPWORDS
from lodequery.functions.web import TRACKING, TRACKING_PREFIXES

_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
_HOST = r"regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\.', '')"
_HOST = f"nullif({_HOST}, '')"

_TOKENS = r"""
doc AS (SELECT doc_id, coalesce(title, '') AS title, coalesce(content_text, '') AS body,
  coalesce(title, '') || chr(10) || chr(10) || coalesce(content_text, '') AS text FROM documents),
listed AS (SELECT doc_id, list_filter(regexp_extract_all(text, '[\p{L}\p{N}]+(?:[''’ʼ][\p{L}\p{N}]+)*'), lambda x: length(x) <= 64) AS words FROM doc),
tok AS (SELECT doc_id, (i - 1)::INT AS position, words[i] AS raw FROM listed, LATERAL (SELECT unnest(range(1, len(words) + 1)) AS i))"""

_COMPATIBLE = {
    "ﬁ": "fi", "ﬂ": "fl", "½": "12", "¼": "14", "¾": "34", "²": "2", "³": "3", "¹": "1", "𝒳": "x", "ª": "a", "º": "o", "µ": "μ",
}
_PLAINER = "raw"
for _a, _b in _COMPATIBLE.items():
    _PLAINER = f"replace({_PLAINER}, '{_a}', '{_b}')"
_FOLD = rf"""CASE WHEN regexp_matches(raw, '[\p{{Han}}\p{{Hiragana}}\p{{Katakana}}\p{{Hangul}}\p{{Arabic}}\p{{Devanagari}}]') THEN lower(raw)
  ELSE regexp_replace(lower(strip_accents({_PLAINER})), '[''’]', '', 'g') END"""

_SURFACES = _TOKENS + f""",
folded AS (SELECT raw, {_FOLD} AS surface FROM (SELECT DISTINCT raw FROM tok)),
kept AS (SELECT raw, surface FROM folded WHERE surface <> '' AND surface NOT IN ({_STOP}))"""  # fmt: skip


def _m(stem: str, least: int) -> str:
    return f"regexp_matches({stem}, '^[^aeiouy]*{'[aeiouy]+[^aeiouy]+' * (least - 1)}[aeiouy]+[^aeiouy]')"


def _cut(n: int, w: str = "w") -> str:
    return f"left({w}, length({w}) - {n})" if n else w


def _short(stem: str) -> str:
    return f"regexp_matches({stem}, '[^aeiouy][aeiouy][^aeiouywxY]$')"


def _suffixes(rules: list[tuple[str, str]], least: int) -> str:
    """CASE over suffixes, longest first; the first that fits decides even if the stem is too short."""
    arms = []
    for end, put in sorted(rules, key=lambda r: -len(r[0])):
        stem = _cut(len(end))
        test = _m(stem, least) + (f" AND right({stem}, 1) IN ('s', 't')" if end == "ion" else "")
        arms.append(f"WHEN w LIKE '%{end}' THEN CASE WHEN {test} THEN {stem} || '{put}' ELSE w END")
    return f"CASE {' '.join(arms)} ELSE w END"


_TWO = (
    "ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al "
    "iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble logi:log"
)
_THREE = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
_FOUR = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


def _stages(source: str) -> str:
    """CTEs from ``source (surface)`` to ``stem (surface, term)``."""
    two = [tuple(x.split(":")) for x in _TWO.split()]
    three = [tuple(x.split(":")) for x in _THREE.split()]
    four = [(x, "") for x in _FOUR.split()]
    marked = r"regexp_replace(regexp_replace(regexp_replace(surface, '^y', 'Y'), '([aeiou])y', '\1Y', 'g'), 'yy', 'yY', 'g')"
    return rf"""
s0 AS (SELECT DISTINCT surface, {marked} AS w FROM {source}),
s1 AS (SELECT surface, CASE WHEN w LIKE '%sses' OR w LIKE '%ies' THEN {_cut(2)} WHEN w LIKE '%ss' THEN w WHEN w LIKE '%s' THEN {_cut(1)} ELSE w END AS w FROM s0),
s2 AS (SELECT surface, w, CASE WHEN w LIKE '%eed' THEN '' WHEN w LIKE '%ed' AND regexp_matches({_cut(2)}, '[aeiouy]') THEN 'ed'
  WHEN w LIKE '%ing' AND regexp_matches({_cut(3)}, '[aeiouy]') THEN 'ing' ELSE '' END AS cut FROM s1),
s3 AS (SELECT surface, cut, CASE WHEN w LIKE '%eed' AND {_m(_cut(3), 1)} THEN {_cut(1)} ELSE left(w, length(w) - length(cut)) END AS w FROM s2),
s4 AS (SELECT surface, CASE WHEN cut = '' THEN w WHEN regexp_matches(w, '(at|bl|iz)$') THEN w || 'e'
  WHEN length(w) > 1 AND right(w, 1) = substr(w, length(w) - 1, 1) AND regexp_matches(w, '[^aeiouylsz]$') THEN {_cut(1)}
  WHEN {_m("w", 1)} AND NOT {_m("w", 2)} AND {_short("w")} THEN w || 'e' ELSE w END AS w FROM s3),
s5 AS (SELECT surface, CASE WHEN regexp_matches(w, '[yY]$') AND regexp_matches({_cut(1)}, '[aeiouy]') THEN {_cut(1)} || 'i' ELSE w END AS w FROM s4),
s6 AS (SELECT surface, {_suffixes(two, 1)} AS w FROM s5),
s7 AS (SELECT surface, {_suffixes(three, 1)} AS w FROM s6),
s8 AS (SELECT surface, {_suffixes(four, 2)} AS w FROM s7),
s9 AS (SELECT surface, CASE WHEN w LIKE '%e' AND ({_m(_cut(1), 2)} OR ({_m(_cut(1), 1)} AND NOT {_short(_cut(1))})) THEN {_cut(1)} ELSE w END AS w FROM s8),
stem AS (SELECT surface, CASE WHEN length(surface) < 3 THEN surface
  WHEN w LIKE '%ll' AND {_m("w", 2)} THEN lower({_cut(1)}) ELSE lower(w) END AS term FROM s9)"""


_STEMMED = _SURFACES + "," + _stages("kept") + """,
tokens AS (SELECT doc_id, position, surface, term FROM tok JOIN kept USING (raw) JOIN stem USING (surface))"""  # fmt: skip

_INDEX = _STEMMED + """,
post AS (SELECT term, doc_id, count(*)::INT AS tf FROM tokens GROUP BY ALL),
dfs AS (SELECT term, count(*) AS doc_freq FROM post GROUP BY term),
lens AS (SELECT doc_id, coalesce(n, 0)::INT AS token_count FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n FROM tokens GROUP BY doc_id) USING (doc_id)),
stat AS (SELECT count(*) AS total_docs, coalesce(sum(token_count), 0)::BIGINT AS total_tokens,
  CASE WHEN count(*) = 0 THEN 0.0 ELSE sum(token_count) / count(*) END AS avg_doc_len FROM lens)"""  # fmt: skip

_FORMS = """,
tally AS (SELECT term, surface, count(*) AS n FROM tokens GROUP BY ALL),
forms AS (SELECT term, surface AS surface_form FROM tally QUALIFY row_number() OVER (PARTITION BY term ORDER BY n DESC, length(surface), surface) = 1)"""

_QUERY_WORDS = {
    1: "slow crawler requests inverted index", 2: "robots cache", 3: "resume naive cafe", 5: "sitemap sitemaps sitemap", 6: "zzzunknownzzz index",
}


def _asked(only: list[int] | None = None) -> str:
    """CTE ``asked (query_id, qpos, term)``: the queries' words, stemmed by the stages above, repeats dropped."""
    rows = [(q, k, w) for q, words in _QUERY_WORDS.items() if not only or q in only for k, w in enumerate(words.split())]
    values = ", ".join(f"({q}, {k}, '{w}')" for q, k, w in rows)
    stages = _stages("qw")
    for name in ("s0", "s1", "s2", "s3", "s4", "s5", "s6", "s7", "s8", "s9", "stem"):
        stages = stages.replace(f"\n{name} AS", f"\nq{name} AS").replace(f"FROM {name})", f"FROM q{name})")
    return f"""
qw AS (SELECT * FROM (VALUES {values}) AS v(query_id, k, surface)),{stages},
qfirst AS (SELECT query_id, term, min(k) AS k FROM qw JOIN qstem USING (surface) GROUP BY ALL),
asked AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY k) - 1)::INT AS qpos, term FROM qfirst)"""


def _scored(k1: float = 1.2, b: float = 0.75, only: list[int] | None = None) -> str:
    return f"""WITH {_INDEX},{_asked(only)},
hits AS (SELECT query_id, qpos, term, doc_id, tf, token_count AS doc_len, doc_freq FROM asked JOIN dfs USING (term) JOIN post USING (term) JOIN lens USING (doc_id)),
parts AS (SELECT *, ln(1 + (total_docs - doc_freq + 0.5) / (doc_freq + 0.5)) * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} *
  CASE WHEN doc_len <= 0 OR avg_doc_len <= 0 THEN 1.0 ELSE doc_len / avg_doc_len END)) AS part FROM hits CROSS JOIN stat),
scored AS (SELECT query_id, doc_id, list_sum(list(part ORDER BY qpos)) AS score, string_agg(term, ' ' ORDER BY qpos) AS matched_terms FROM parts GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, doc_id)::INT AS rank,
  count(*) OVER (PARTITION BY query_id) AS total FROM scored)"""


_SHOW = "query_id, doc_id, round(score, 6) AS score, matched_terms"

_TRIMMED = f"regexp_replace(regexp_replace(coalesce(content_text, ''), '^[{JS_SPACE}]+', ''), '[{JS_SPACE}]+$', '')"
_EVEN = "regexp_replace(regexp_replace(regexp_replace({0}, '[" + WIDE_SPACES + "]', ' ', 'g'), '[" + DROPPED + "]', '', 'g'), '\\r\\n?', chr(10), 'g')"


def _trim(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^[{JS_SPACE}]+', ''), '[{JS_SPACE}]+$', '')"


_ARRIVING = f"""
page AS (SELECT doc_id, coalesce(canonical_url, url) AS url, coalesce(title, '') AS raw_title, title, {_TRIMMED} AS txt, http_status >= 400 AS noindex, batch_id, fetched_at, token_count,
  sha256(coalesce(title, '') || chr(10) || {_TRIMMED}) AS hash FROM documents)"""


def _classified(pages: str, known: str = "") -> str:
    """CTE ``done (doc_id, ..., outcome)``: a replay that takes the pages one after the other, with what every url holds as its state."""
    start = f"(SELECT coalesce(map_from_entries(list((url, hash))), MAP {{}}::MAP(VARCHAR, VARCHAR)) FROM {known})" if known else "MAP {}::MAP(VARCHAR, VARCHAR)"
    return f"""
line AS (SELECT *, row_number() OVER (ORDER BY batch_id, fetched_at, doc_id) AS k FROM {pages}),
replay AS (
  SELECT 0::BIGINT AS k, {start} AS held, '' AS outcome
  UNION ALL
  SELECT k, CASE WHEN outcome = 'noindex' THEN map_from_entries(list_filter(map_entries(held), lambda e: e.key <> url))
    WHEN outcome IN ('inserted', 'updated') THEN map_concat(held, MAP {{url: hash}}) ELSE held END, outcome
  FROM (SELECT l.k, l.url, l.hash, r.held, CASE WHEN coalesce(noindex, false) THEN 'noindex' WHEN length(txt) = 0 THEN 'empty'
    WHEN map_contains(r.held, l.url) THEN 'updated' WHEN list_contains(map_values(r.held), l.hash) THEN 'duplicate' ELSE 'inserted' END AS outcome
    FROM replay r JOIN line l ON l.k = r.k + 1)),
done AS (SELECT doc_id, url, title, txt, hash, batch_id, fetched_at, outcome FROM line JOIN (SELECT k, outcome FROM replay) USING (k))"""


_ERRORS = """
once AS (SELECT DISTINCT * FROM crawl_errors WHERE url IS NOT NULL),
last AS (SELECT url, reason, http_status, left(detail, 500) AS detail FROM once QUALIFY row_number() OVER (PARTITION BY url ORDER BY
  coalesce(last_seen_at, first_seen_at) DESC, reason DESC NULLS LAST, http_status DESC NULLS LAST, detail DESC NULLS LAST, depth DESC NULLS LAST, attempts DESC NULLS LAST) = 1),
sums AS (SELECT url, min(depth) AS depth, sum(attempts)::BIGINT AS attempts, min(first_seen_at) AS first_seen_at, max(last_seen_at) AS last_seen_at FROM once GROUP BY url),
merged AS (SELECT * FROM last JOIN sums USING (url))"""

_RETRY = "coalesce(http_status = 429 OR (http_status >= 500 AND http_status <> 501), false)"
_QUEUE = "queue AS (SELECT url, min(depth) AS depth FROM crawl_errors WHERE url IS NOT NULL GROUP BY url)"
_RULES = "(true, '/', '^/'), (false, '/old/', '^/old/'), (true, '/old/*page', '^/old/.*page'), (false, '/*?page=', '^/.*[?]page='), (false, '/x/', '^/x/'), (true, '/docs/*', '^/docs/.*'), (false, '/*/archive/', '^/.*/archive/')"


def _normal(url: str, source: str, name: str = "normal") -> str:
    """CTE ``name (url, normal)``: one spelling of the addresses of ``source``, for http addresses without dot segments, escapes and credentials."""
    tracking = ", ".join(f"'{t}'" for t in TRACKING)
    prefixes = " OR ".join(f"starts_with(lower(p), '{p}')" for p in TRACKING_PREFIXES)
    return f"""
{name}_a AS (SELECT DISTINCT {url} AS url, regexp_replace({url}, '#.*$', '') AS x FROM {source} WHERE {url} IS NOT NULL),
{name}_b AS (SELECT url, lower(regexp_extract(x, '^([A-Za-z]+)://', 1)) AS scheme, lower(regexp_extract(x, '^[A-Za-z]+://([^/?]+)', 1)) AS host,
  regexp_extract(x, '^[A-Za-z]+://[^/?]+([^?]*)', 1) AS path, regexp_extract(x, '[?](.*)$', 1) AS query FROM {name}_a),
{name}_c AS (SELECT *, array_to_string(list_sort(list_transform(list_filter(string_split(query, '&'), lambda p: p <> '' AND NOT (split_part(lower(p), '=', 1) IN ({tracking}) OR {prefixes})),
  lambda p: CASE WHEN contains(p, '=') THEN p ELSE p || '=' END)), '&') AS kept FROM {name}_b),
{name} AS (SELECT url, scheme || '://' || CASE scheme WHEN 'http' THEN regexp_replace(host, ':80$', '') ELSE regexp_replace(host, ':443$', '') END ||
  CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END AS normal FROM {name}_c)"""


_OFFSETS = r"""
cuts AS (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}]+(?:[''’ʼ][\p{L}\p{N}]+)*') AS w,
  regexp_split_to_array(text, '[\p{L}\p{N}]+(?:[''’ʼ][\p{L}\p{N}]+)*') AS g FROM doc),
ends AS (SELECT doc_id, i, w[i] AS raw, sum(length(w[i]) + length(g[i])) OVER (PARTITION BY doc_id ORDER BY i) AS e
  FROM cuts, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i)),
placed AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS position, (e - length(raw))::INT AS start, e::INT AS stop
  FROM ends WHERE length(raw) <= 64)"""


def _ask_first() -> str:
    """The stems of the first query, as a query."""
    return f"WITH {_asked([1])} SELECT term FROM asked"


def oracle_sql() -> dict[str, str]:
    tracking = ", ".join(f"'{t}'" for t in TRACKING)
    prefixes = " OR ".join(f"starts_with(name, '{p}')" for p in TRACKING_PREFIXES)
    space = r"[\t-\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
    return {
        "scan_documents": "SELECT doc_id, url, http_status, batch_id FROM documents",
        "tokenize": f"WITH {_TOKENS} SELECT doc_id, position, raw FROM tok",
        "token_offsets": f"""WITH {_TOKENS},
parts AS (SELECT doc_id, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+(?:[''’ʼ][\\p{{L}}\\p{{N}}]+)*') AS w,
  regexp_split_to_array(text, '[\\p{{L}}\\p{{N}}]+(?:[''’ʼ][\\p{{L}}\\p{{N}}]+)*') AS g FROM doc),
each AS (SELECT doc_id, i, w[i] AS raw, sum(length(w[i]) + length(g[i])) OVER (PARTITION BY doc_id ORDER BY i) AS e
  FROM parts, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS position, raw, (e - length(raw))::INT AS start, e::INT AS "end"
FROM each WHERE length(raw) <= 64""",
        "normalize_tokens": f"WITH {_TOKENS} SELECT DISTINCT raw, {_FOLD} AS surface FROM tok",
        "stopword_filter": f"""WITH {_TOKENS}, f AS (SELECT raw, {_FOLD} AS surface FROM (SELECT DISTINCT raw FROM tok))
SELECT surface IN ({_STOP}) AS stopword, count(*) AS n FROM f WHERE surface <> '' GROUP BY ALL""",
        "stem_vocab": f"WITH {_SURFACES},{_stages('kept')} SELECT surface, term FROM stem",
        "process_text": f"WITH {_STEMMED} SELECT doc_id, position, surface, term FROM tokens",
        "process_query": f"WITH {_asked()} SELECT query_id, qpos, term FROM asked",
        "postings": f"""WITH {_STEMMED} SELECT term, doc_id, count(*)::INT AS tf, string_agg(position::VARCHAR, ',' ORDER BY position) AS positions
FROM tokens GROUP BY term, doc_id""",
        "doc_freq": f"WITH {_STEMMED} SELECT term, count(DISTINCT doc_id) AS doc_freq FROM tokens GROUP BY term",
        "doc_lengths": f"WITH {_INDEX} SELECT doc_id, token_count FROM lens",
        "corpus_stats": f"WITH {_INDEX} SELECT total_docs, total_tokens, round(avg_doc_len, 6) AS avg_doc_len FROM stat",
        "surface_forms": f"WITH {_STEMMED}{_FORMS} SELECT term, surface_form FROM forms",
        "build_index": f"""WITH {_STEMMED}{_FORMS}
SELECT term, count(DISTINCT doc_id) AS doc_freq, count(*) AS occurrences, sum(position)::BIGINT AS position_sum, any_value(surface_form) AS surface_form
FROM tokens JOIN forms USING (term) GROUP BY term""",
        "corpus_sources": "SELECT coalesce(split_part(url, '/', 3), '') AS host, count(*) AS documents FROM documents GROUP BY ALL ORDER BY documents DESC, host LIMIT 5",
        "stored_stats": "SELECT total_docs, total_tokens, round(avg_doc_len, 6) AS avg_doc_len FROM corpus_stats",
        "idf": """WITH n AS (SELECT count(*)::DOUBLE AS n FROM documents), t AS (SELECT term_id, least(coalesce(doc_freq, 0), n) AS df, n FROM terms, n)
SELECT term_id, round(CASE WHEN n <= 0 OR df <= 0 THEN 0.0 ELSE ln(1 + (n - df + 0.5) / (df + 0.5)) END, 6) AS idf FROM t""",
        "bm25_single": """WITH p AS (SELECT DISTINCT term_id, doc_id, tf FROM postings),
j AS (SELECT p.*, coalesce(token_count, 0) AS len, least(coalesce(doc_freq, 0), s.total_docs)::DOUBLE AS df, s.total_docs::DOUBLE AS n, s.avg_doc_len AS avgdl
  FROM p JOIN documents USING (doc_id) JOIN terms USING (term_id) CROSS JOIN corpus_stats s)
SELECT term_id, doc_id, tf, round(CASE WHEN n <= 0 OR df <= 0 THEN 0.0 ELSE ln(1 + (n - df + 0.5) / (df + 0.5)) END *
  CASE WHEN tf <= 0 THEN 0.0 ELSE tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * CASE WHEN len <= 0 OR avgdl <= 0 THEN 1.0 ELSE len / avgdl END)) END, 6) AS score FROM j""",
        "term_postings": f"{_scored()} SELECT query_id, qpos, term, doc_id, tf, doc_len, doc_freq FROM hits",
        "bm25_or": f"{_scored()} SELECT {_SHOW} FROM scored",
        "bm25_topk": f"{_scored(only=[1])} SELECT {_SHOW}, rank, total FROM ranked WHERE rank <= 10",
        "bm25_batch": f"{_scored()} SELECT {_SHOW}, rank, total FROM ranked WHERE rank <= 10",
        "bm25_params": f"{_scored(2.0, 0.0)} SELECT {_SHOW}, rank, total FROM ranked WHERE rank <= 5",
        "bm25_page": f"{_scored(only=[1])} SELECT {_SHOW}, rank FROM ranked WHERE rank BETWEEN 21 AND 30",
        "bm25_and": f"{_scored(only=[2])} SELECT {_SHOW} FROM scored WHERE length(matched_terms) - length(replace(matched_terms, ' ', '')) = 1",
        "phrase": f"""WITH {_STEMMED} SELECT a.doc_id, count(*) AS places FROM tokens a JOIN tokens b
ON a.doc_id = b.doc_id AND b.position = a.position + 1 AND a.term = 'invert' AND b.term = 'index' GROUP BY a.doc_id""",
        "explain": f"""WITH {_INDEX},{_asked()} SELECT query_id, qpos, term, doc_freq, round(CASE WHEN doc_freq IS NULL THEN 0.0
  ELSE ln(1 + (total_docs - doc_freq + 0.5) / (doc_freq + 0.5)) END, 6) AS idf FROM asked LEFT JOIN dfs USING (term) CROSS JOIN stat""",
        "snippet_window": f"""WITH {_STEMMED},{_OFFSETS},
m AS (SELECT p.doc_id, p.start, p.stop, t.term FROM placed p JOIN tokens t USING (doc_id, position) JOIN doc d ON d.doc_id = p.doc_id
  WHERE p.start >= length(d.title) + 2 AND t.term IN (SELECT term FROM ({_ask_first()}))),
w AS (SELECT a.doc_id, a.start, max(b.stop) AS last, count(DISTINCT b.term) AS terms, count(*) AS n
  FROM (SELECT DISTINCT doc_id, start FROM m) a JOIN m b ON a.doc_id = b.doc_id AND b.start >= a.start AND b.stop - a.start <= 300 GROUP BY ALL)
SELECT doc_id, start AS first, last FROM w QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY terms DESC, n DESC, start) = 1""",
        "snippet_lead": f"""WITH {_TOKENS},
a AS (SELECT doc_id, text, length(title) + 2 AS b, length(text) AS n FROM doc),
s AS (SELECT *, b + length(regexp_extract(substr(text, b + 1), '^[ \\n]*')) AS start FROM a),
e AS (SELECT *, start + 300 < n AS cut, start + 300 AS edge, reverse(substr(text, start + 277, 24)) AS near FROM s),
f AS (SELECT *, CASE WHEN NOT cut THEN n WHEN substr(text, edge + 1, 1) IN (' ', chr(10)) THEN edge
  WHEN regexp_matches(near, '[ \\n]') THEN edge - length(regexp_extract(near, '^[^ \\n]*')) - 1 ELSE edge END AS stop FROM e)
SELECT doc_id, CASE WHEN b >= n THEN '' ELSE replace(regexp_replace(substr(text, start + 1, stop - start), '[ \\n]+$', ''), chr(10), ' ')
  || CASE WHEN cut THEN ' …' ELSE '' END END AS snippet FROM f""",
        "merge_intervals": """WITH s AS (SELECT DISTINCT doc_id, p AS a, p + 1 + p % 3 AS e FROM postings, LATERAL (SELECT unnest(positions) AS p)),
f AS (SELECT *, CASE WHEN a <= max(e) OVER (PARTITION BY doc_id ORDER BY a, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM s),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY a, e ROWS UNBOUNDED PRECEDING) AS grp FROM f)
SELECT doc_id, min(a)::INT AS start, max(e)::INT AS "end" FROM g GROUP BY doc_id, grp""",
        "suggest_split": f"""WITH s AS (SELECT doc_id, title, regexp_extract(title, '(?s)^(.*{space})', 1) AS head FROM documents)
SELECT doc_id, head, substr(title, length(head) + 1) AS fragment FROM s""",
        "suggest": f"""WITH {_STEMMED}{_FORMS}, t AS (SELECT f.surface_form, count(DISTINCT doc_id) AS df FROM tokens JOIN forms f USING (term) GROUP BY ALL),
i AS (SELECT * FROM (VALUES (1, 'the ', 'inv'), (2, '', 'craw'), (3, '', 'res'), (4, 'page ', 't')) AS v(input_id, head, prefix))
SELECT input_id, row_number() OVER w::INT AS rank, head || surface_form AS term, df AS weight FROM i JOIN t ON starts_with(surface_form, prefix)
WINDOW w AS (PARTITION BY input_id ORDER BY df DESC, length(surface_form), surface_form)
QUALIFY row_number() OVER w <= 8""",
        "suggest_stored": """SELECT 'see ' || surface_form AS term, coalesce(doc_freq, 0) AS weight FROM terms WHERE starts_with(surface_form, 'ind')
ORDER BY weight DESC, length(surface_form), surface_form LIMIT 8""",
        "tracking_params": f"""WITH p AS (SELECT unnest(string_split(regexp_extract(url, '^[^?#]*[?]([^#]*)', 1), '&')) AS p FROM documents),
n AS (SELECT lower(split_part(p, '=', 1)) AS name FROM p WHERE p <> '')
SELECT name, count(*) AS n, name IN ({tracking}) OR {prefixes} AS tracking FROM n GROUP BY name""",
        "canonical_host": f"SELECT {_HOST} AS host, count(*) AS documents FROM documents GROUP BY ALL",
        "clean_text": f"""WITH c AS (SELECT doc_id, {_trim("regexp_replace(" + _EVEN.format("title") + f", '[{JS_SPACE}]+', ' ', 'g')")} AS t,
  {_trim("regexp_replace(regexp_replace(" + _EVEN.format("content_text") + ", '[\t\x0b\x0c\r   ]+', ' ', 'g'), ' *\\n[ \\n]*', chr(10), 'g')")} AS b FROM documents)
SELECT doc_id, CASE WHEN length(t) > 300 THEN regexp_replace(left(t, 300), '[{JS_SPACE}]+$', '') ELSE t END AS title, b AS body FROM c""",
        "link_graph_bfs": f"""WITH RECURSIVE d AS (SELECT doc_id, url, {_HOST} AS host, row_number() OVER (PARTITION BY {_HOST} ORDER BY doc_id) AS k FROM documents)
SELECT url, (k - 1)::INT AS depth FROM d WHERE k <= 4""",
        "content_hash": "SELECT doc_id, sha256(coalesce(title, '') || chr(10) || coalesce(content_text, '')) AS content_hash FROM documents",
        "dedup_pages": f"WITH RECURSIVE {_ARRIVING},{_classified('page')} SELECT doc_id, outcome FROM done",
        "outcomes": f"WITH RECURSIVE {_ARRIVING},{_classified('page')} SELECT outcome, count(*) AS pages FROM done GROUP BY outcome",
        "upsert_documents": f"""WITH RECURSIVE {_ARRIVING}, known AS (SELECT url, title, (SELECT content_text FROM documents d WHERE d.doc_id = page.doc_id) AS txt, hash, token_count
  FROM page WHERE batch_id < 20 QUALIFY row_number() OVER (PARTITION BY url ORDER BY batch_id DESC, fetched_at DESC, doc_id DESC) = 1), fresh AS (SELECT * FROM page WHERE batch_id >= 20),{_classified('fresh', 'known')},
latest AS (SELECT * FROM done WHERE outcome IN ('inserted', 'updated', 'noindex')
  QUALIFY row_number() OVER (PARTITION BY url ORDER BY batch_id DESC, fetched_at DESC, doc_id DESC) = 1)
SELECT url, CASE WHEN l.url IS NOT NULL THEN l.title ELSE k.title END AS title, md5(CASE WHEN l.url IS NOT NULL THEN l.txt ELSE k.txt END) AS content,
  CASE WHEN l.url IS NOT NULL THEN l.hash ELSE k.hash END AS content_hash,
  CASE WHEN l.url IS NOT NULL AND k.hash IS DISTINCT FROM l.hash THEN 0 ELSE coalesce(k.token_count, 0) END AS token_count
FROM known k FULL JOIN latest l USING (url) WHERE l.outcome IS NULL OR l.outcome <> 'noindex'""",
        "crawl_errors": f"""WITH {_ERRORS} SELECT url, reason, http_status, detail, depth, attempts, epoch_us(first_seen_at) AS first_seen_at,
  epoch_us(last_seen_at) AS last_seen_at FROM merged""",
        "cleared_errors": f"WITH {_ERRORS} SELECT url, reason, attempts FROM merged ANTI JOIN documents USING (url)",
        "crawl_summary": f"""WITH {_ERRORS} SELECT reason, count(DISTINCT url) AS urls, sum(attempts)::BIGINT AS attempts,
  sum((attempts > 2)::INT)::BIGINT AS gave_up FROM merged GROUP BY reason""",
        "frontier_order": f"WITH {_QUEUE} SELECT url, depth FROM queue ORDER BY depth, url",
        "url_normalize": f"WITH {_normal('url', 'documents')} SELECT url, normal FROM normal",
        "link_graph": f"""WITH {_normal('url', 'documents')}, site AS (SELECT DISTINCT doc_id, normal, regexp_extract(normal, '^[a-z]+://[^/?]+') AS root FROM documents JOIN normal USING (url))
SELECT normal AS source, root || '/menu' AS target FROM site UNION ALL SELECT normal, root || '/next?id=' || doc_id FROM site""",
        "frontier_admission": f"""WITH {_normal('url', 'documents', 'seen')}, log AS (SELECT url, min(depth) AS depth, min(reason) AS why FROM crawl_errors WHERE url IS NOT NULL GROUP BY url),
{_normal('url', 'log', 'asked')}, allowed AS (SELECT DISTINCT {_HOST} AS host FROM documents WHERE {_HOST} < 'n'),
c AS (SELECT row_number() OVER (ORDER BY l.url) - 1 AS candidate_id, a.normal AS url, depth, why = 'timeout' AS requeue FROM log l JOIN asked a USING (url)),
f AS (SELECT *, CASE WHEN depth > 3 THEN 'too-deep' WHEN lower(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1)) = '/robots.txt' THEN 'excluded'
  WHEN {_HOST} NOT IN (SELECT host FROM allowed) THEN 'out-of-scope' END AS why_not, NOT coalesce(requeue, false) AND url IN (SELECT normal FROM seen) AS again FROM c),
g AS (SELECT *, coalesce(sum((why_not IS NULL AND NOT again)::INT) OVER (ORDER BY candidate_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken FROM f)
SELECT candidate_id, url, depth, CASE WHEN why_not IS NOT NULL THEN why_not WHEN taken >= 100 THEN 'queue-full' WHEN again THEN 'duplicate' END AS reason FROM g""",
        "ready_times": f"""WITH {_QUEUE}, h AS (SELECT url, depth, {_HOST} AS host FROM queue),
r AS (SELECT *, (row_number() OVER (PARTITION BY host ORDER BY depth, url) - 1)::INT AS round FROM h) SELECT url, depth, host, round, round::BIGINT * 1000 AS ready_ms FROM r""",
        "robots_entries": f"""WITH l AS (SELECT regexp_extract(url, '^(https?://[^/?#]+)', 1) AS origin, reason, {_RETRY} OR coalesce(reason IN ('timeout', 'network'), false) AS again,
  epoch_us(last_seen_at) // 1000 AS t FROM crawl_errors WHERE url IS NOT NULL AND coalesce(reason <> 'aborted', true)),
f AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY origin ORDER BY t DESC NULLS LAST, reason DESC NULLS LAST, again DESC) = 1),
o AS (SELECT *, CASE WHEN reason = 'too-large' OR again THEN 'disallow-all' ELSE 'allow-all' END AS outcome FROM f)
SELECT origin, outcome, t + CASE outcome WHEN 'disallow-all' THEN 300000 ELSE 86400000 END AS expires_ms FROM o""",
        "retry_delays": """WITH a AS (SELECT http_status, attempts, CASE WHEN http_status IN (429, 503) THEN depth * 20000.0 END AS after FROM crawl_errors WHERE attempts > 0)
SELECT http_status, attempts, CASE WHEN after > 30000 THEN NULL WHEN after IS NOT NULL THEN after::DOUBLE ELSE least(500 * 2.0 ** (attempts - 1), 8000) * 0.75 END AS delay_ms, count(*) AS n FROM a GROUP BY ALL""",
        "decode_bodies": """SELECT doc_id, md5(coalesce(content_text, '')) AS text, CASE doc_id % 3 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'utf-16-le' ELSE 'utf-16-be' END AS charset,
  CASE doc_id % 3 WHEN 0 THEN 'default' ELSE 'header' END AS charset_source FROM documents""",
        "host_rounds": f"""WITH {_QUEUE}, h AS (SELECT url, depth, {_HOST} AS host FROM queue)
SELECT url, depth, host, (row_number() OVER (PARTITION BY host ORDER BY depth, url) - 1)::INT AS round FROM h""",
        "robots_outcome": f"""WITH l AS (SELECT DISTINCT * FROM crawl_errors), r AS (SELECT reason, {_RETRY} OR coalesce(reason IN ('timeout', 'network'), false) AS again FROM l)
SELECT CASE WHEN reason = 'aborted' THEN NULL WHEN reason = 'too-large' THEN 'disallow-all' WHEN again THEN 'disallow-all' ELSE 'allow-all' END AS outcome,
  count(*) AS n FROM r GROUP BY ALL""",
        "retryable_status": f"SELECT http_status, {_RETRY} AS retryable, count(*) AS n FROM crawl_errors GROUP BY ALL",
        "robots_verdicts": f"""WITH r AS (SELECT * FROM (VALUES {_RULES}) AS v(allow, pattern, regex)),
p AS (SELECT DISTINCT {_HOST} AS origin, regexp_extract(url, '^[a-z]+://[^/]+([^#]*)', 1) AS path FROM documents)
SELECT origin, path, coalesce(arg_max(allow, length(pattern) * 2 + allow::INT) FILTER (WHERE regexp_matches(path, regex)), true) AS allowed
FROM p CROSS JOIN r WHERE path <> '' GROUP BY ALL""",
        "corpus_rollup": "SELECT lang, http_status, grouping_id(lang, http_status)::BIGINT AS level, count(*) AS documents FROM documents GROUP BY ROLLUP (lang, http_status)",
    }
