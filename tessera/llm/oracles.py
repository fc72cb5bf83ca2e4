"""DuckDB SQL for the corpus queries that SQL can express; tables are registered as views."""

from __future__ import annotations

#: Lower-casing of A-Z alone.
_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_NORMAL = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPACED = r"[^\x20\x09-\x0D]+"

_OP1 = r"""
WITH said AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
    UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), escaped AS (
    SELECT *, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS safe,
           regexp_replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<(\\*)\|', '<\\\1|', 'g') AS safe_role
    FROM said
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, safe)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, safe) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(safe_role) + length(safe) + 24)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""

_OP2 = f"""
WITH items AS (
    SELECT item_id::VARCHAR AS item, regexp_extract_all({_LOWER.format("text")}, '{_NORMAL}') AS w FROM benchmark
), windows AS (
    SELECT DISTINCT item, least(len(w), 13) AS n, list_slice(w, k, k + least(len(w), 13) - 1) AS gram
    FROM items, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(k) WHERE len(w) > 0
), docs AS (
    SELECT doc_id, regexp_extract_all({_LOWER.format("text")}, '{_NORMAL}') AS w FROM documents
), sizes AS (SELECT DISTINCT n FROM windows
), places AS (
    SELECT doc_id, n, k, list_slice(w, k, k + n - 1) AS gram FROM docs, sizes, unnest(range(1, len(w) - n + 2)) AS t(k)
), hits AS (
    SELECT doc_id, item, k, p.n FROM places p JOIN windows w ON p.gram = w.gram AND p.n = w.n
), words AS (
    SELECT doc_id, count(DISTINCT pos) AS n_hit FROM hits, unnest(range(k, k + n)) AS t(pos) GROUP BY doc_id
), found AS (
    SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hits GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""

_OP3 = f"""
WITH docs AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents
), windows AS (
    SELECT doc_id, k, md5(array_to_string(list_slice(w, k, k + 49), ' ')) AS name FROM docs, unnest(range(1, len(w) - 48)) AS t(k)
), firsts AS (
    SELECT name, min(doc_id) AS low FROM windows GROUP BY name HAVING min(doc_id) < max(doc_id)
), gone AS (
    SELECT DISTINCT doc_id, pos FROM windows JOIN firsts USING (name), unnest(range(k, k + 50)) AS t(pos) WHERE doc_id > low
), kept AS (
    SELECT d.doc_id, count(g.pos) AS n_removed, string_agg(word, ' ' ORDER BY d.pos) FILTER (g.pos IS NULL) AS words
    FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM docs) d
    LEFT JOIN gone g ON g.doc_id = d.doc_id AND g.pos = d.pos GROUP BY d.doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(words, '')) AS kept_sha256
FROM docs d LEFT JOIN kept USING (doc_id)
"""

_ALPHABET = "^$*abcdefghijklmnopqrstuvwxyz0123456789./-_=&?%:#~+,"
_N = len(_ALPHABET)


def _model(side: str) -> str:
    """P(third | first, second) of one side for every code, Witten-Bell interpolated down to order 0."""
    return f"""seen_{side} AS (SELECT gram, count(*)::DOUBLE AS n FROM grams WHERE ruled = '{side}' GROUP BY gram),
z_{side} AS (SELECT z, coalesce(sum(n), 0) AS n_z FROM range({_N}) t(z) LEFT JOIN seen_{side} ON gram % {_N} = z GROUP BY z),
all_{side} AS (SELECT sum(n_z) AS n_all, count(*) FILTER (n_z > 0) AS t_all FROM z_{side}),
yz_{side} AS (SELECT gram % {_N * _N} AS yz, sum(n) AS n_yz FROM seen_{side} GROUP BY 1),
y_{side} AS (SELECT yz // {_N} AS y, sum(n_yz) AS n_y, count(*) AS t_y FROM yz_{side} GROUP BY 1),
xy_{side} AS (SELECT gram // {_N} AS xy, sum(n) AS n_xy, count(*) AS t_xy FROM seen_{side} GROUP BY 1),
p_{side} AS (
    SELECT id AS gram, (coalesce(n, 0) + (coalesce(t_xy, 0) + 1) * (coalesce(n_yz, 0) + (coalesce(t_y, 0) + 1) * (n_z + t_all / {_N}.0::DOUBLE + 1.0::DOUBLE / {_N}) / (n_all + t_all + 1))
        / (coalesce(n_y, 0) + coalesce(t_y, 0) + 1)) / (coalesce(n_xy, 0) + coalesce(t_xy, 0) + 1) AS p
    FROM range({_N ** 3}) t(id) JOIN z_{side} ON z = id % {_N} CROSS JOIN all_{side} LEFT JOIN yz_{side} ON yz = id % {_N * _N} LEFT JOIN y_{side} ON y = id // {_N} % {_N}
    LEFT JOIN xy_{side} ON xy = id // {_N} LEFT JOIN seen_{side} s ON s.gram = id)"""


_URL = "'(?s)^.*?://([^/?#]*)([^?#]*)'"
_UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_FITS = "((host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}'))"
_OP4 = f"""
WITH parts AS (
    SELECT page_id, coalesce(url, '') AS text, translate(coalesce(regexp_extract(url, {_URL}, 1), ''), {_UPPER}) AS host, coalesce(regexp_extract(url, {_URL}, 2), '') AS path FROM pages
), judged AS (
    SELECT *, CASE WHEN {_FITS.format("example.net", "/en/")} THEN 'example.net/en/' WHEN {_FITS.format("example.com", "/de/")} THEN 'example.com/de/'
        WHEN {_FITS.format("org", "/fr/")} THEN 'org/fr/' WHEN {_FITS.format("net", "/")} THEN 'net/' END AS rule FROM parts
), ruled AS (
    SELECT *, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS ruled, md5(text) < '4' AS calibrates,
        '^^' || regexp_replace(translate(text, {_UPPER}), '[^a-z0-9./\\-_=&?%:#~+,]', '*', 'g') || '$' AS chars FROM judged
), codes AS (
    SELECT page_id, CASE WHEN NOT calibrates THEN ruled END AS ruled, list_transform(range(1, length(chars) - 1), lambda i: ((instr('{_ALPHABET}', substr(chars, i, 1)) - 1) * {_N}
        + instr('{_ALPHABET}', substr(chars, i + 1, 1)) - 1) * {_N} + instr('{_ALPHABET}', substr(chars, i + 2, 1)) - 1) AS codes FROM ruled
), grams AS (SELECT page_id, ruled, unnest(codes) AS gram FROM codes), {_model("allow")}, {_model("block")},
model AS (SELECT a.gram, round(ln(a.p) - ln(b.p), 9) AS ratio FROM p_allow a JOIN p_block b USING (gram)),
scores AS (SELECT page_id, round(sum(ratio) / count(*), 6) AS score FROM grams JOIN model USING (gram) GROUP BY page_id),
bins AS (
    SELECT greatest(least(floor(score / 0.01::DOUBLE), 2000), -2000)::BIGINT AS step, count(*) FILTER (ruled = 'allow') AS a, count(*) FILTER (ruled = 'block') AS b
    FROM scores JOIN ruled USING (page_id) WHERE ruled IS NOT NULL AND calibrates GROUP BY 1
), sides AS (
    SELECT step, lag(step) OVER w AS before, coalesce(sum(a) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS a,
        coalesce(sum(b) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS b, sum(a) OVER ()::DOUBLE AS all_a, sum(b) OVER ()::DOUBLE AS all_b FROM bins WINDOW w AS (ORDER BY step)
), cut AS (
    SELECT coalesce(first(CASE WHEN all_a = 0 OR all_b = 0 THEN 0.0 WHEN before IS NULL THEN 0.01::DOUBLE * step ELSE 0.01::DOUBLE * ((before + 1 + step) / 2.0::DOUBLE) END
        ORDER BY (all_a - a) / all_a + b / all_b DESC, step), 0.0) AS cut FROM sides
)
SELECT page_id, host, path, rule, CASE WHEN ruled IS NOT NULL THEN ruled WHEN score >= cut THEN 'allow' ELSE 'block' END AS verdict
FROM ruled LEFT JOIN scores USING (page_id), cut
"""

_OP7 = """
WITH RECURSIVE fine AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
    WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS x, b.vec_id AS y FROM fine a JOIN fine b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), reach AS (
    SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
), lowest AS (SELECT x AS vec_id, min(y) AS component_id FROM reach GROUP BY x
), counts AS (SELECT x AS vec_id, count(*) AS n_links FROM links GROUP BY x)
SELECT e.vec_id, coalesce(n_links, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN lowest USING (vec_id) LEFT JOIN counts USING (vec_id)
"""

_OP9 = f"""
WITH RECURSIVE docs AS (
    SELECT doc_id, regexp_extract_all({_LOWER.format("text")}, '{_SPACED}') AS w FROM documents
), sets AS (
    SELECT DISTINCT doc_id, list_slice(w, k, k + 3) AS s FROM docs, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS t(k) WHERE len(w) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), pairs AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
    SELECT x, y FROM pairs JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * shared >= 80 * (a.n + b.n - shared)
), reach AS (
    SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
), lowest AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN lowest USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""

ORACLES: dict[str, str] = {
    "op1_chat_format": _OP1,
    "op2_decontaminate": _OP2,
    "op3_substring_dedup": _OP3,
    "op4_url_filter": _OP4,
    "op7_embedding_dedup": _OP7,
    "op9_near_duplicates": _OP9,
}
