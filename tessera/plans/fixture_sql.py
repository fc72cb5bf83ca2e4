"""SQL fragments that the oracles share: the party fixture and the scalar functions, for DuckDB."""

from __future__ import annotations

from collections.abc import Sequence

PARTIES = """
people AS (
    SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[^A-Za-z]+', ' ', 'g')) AS c, coalesce(lang, '') AS a3, coalesce(source, '') AS a4 FROM documents
), worded AS (
    SELECT doc_id, lower(split_part(c, ' ', 1)) AS a1, lower(split_part(c, ' ', 2)) AS a2, a3, a4 FROM people
), alice AS (
    SELECT doc_id::VARCHAR AS rec_id, doc_id::VARCHAR AS ent_id, a1, a2, a3, a4, a1 || a2 AS key FROM worded WHERE doc_id % 3 IN (0, 1)
), bob AS (
    SELECT rec_id, ent_id, a1, a2, a3, a4, a1 || a2 AS key FROM (
        SELECT doc_id::VARCHAR AS rec_id, doc_id::VARCHAR AS ent_id,
               CASE WHEN doc_id % 5 = 0 AND length(a1) > 2 THEN substr(a1, 1, 1) || substr(a1, 3) ELSE a1 END AS a1, a2, a3, a4
        FROM worded WHERE doc_id % 3 IN (1, 2))
)"""

MANY = """
people AS (
    SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[^A-Za-z]+', ' ', 'g')) AS c FROM documents
), records AS (
    SELECT party, doc_id::VARCHAR AS rec_id, lower(split_part(c, ' ', 1)) AS a1, lower(split_part(c, ' ', 2)) AS a2
    FROM people, unnest(range(0, 5)) AS t(party) WHERE (doc_id + party) % 5 <> 0
)"""


def share_of(share: float) -> str:
    """A share of Alice's records, cut to a whole number."""
    return f"(SELECT floor({share}::DOUBLE * count(*)) FROM alice)"


def n_refs(k: int) -> str:
    """Reference values: one for ``k`` records of the larger party."""
    return f"(SELECT ceil(greatest((SELECT count(*) FROM alice), (SELECT count(*) FROM bob)) / {k}.0)::BIGINT)"


def refs(n: str, name: str = "refs", table: str = "worded", salt: str = "") -> str:
    return f"""{name} AS (
    SELECT row_number() OVER (ORDER BY md5('{salt}' || key), key) - 1 AS pos, key AS ref FROM (
        SELECT DISTINCT a1 || a2 AS key FROM {table}) ORDER BY md5('{salt}' || key), key LIMIT {n}
)"""


def indexed(refs_name: str, name: str = "indexed") -> str:
    return f"{name} AS (SELECT row_number() OVER (ORDER BY ref) AS idx, ref FROM {refs_name} UNION ALL SELECT 0, chr(1))"


def grams(s: str) -> str:
    return f"list_transform(range(1, length({s}) + 2), lambda i: substr(chr(1) || {s} || chr(2), i, 2))"


def dice(a: str, b: str) -> str:
    return f"(CASE WHEN {a} = {b} THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect({grams(a)}, {grams(b)})) / (length({a}) + length({b}) + 2) END)"


def edit(a: str, b: str) -> str:
    return f"(CASE WHEN {a} = '' OR {b} = '' THEN 0.0::DOUBLE WHEN {a} = {b} THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b})) END)"


def modulo(digest: str, digits: int, length: int | str) -> str:
    out = "0::BIGINT"
    rest = f"(4294967296 % {length})" if isinstance(length, str) else 4294967296 % length
    for i in range(digits // 8):
        out = f"(({out} * {rest} + ('0x' || substr({digest}, {8 * i + 1}, 8))::BIGINT) % {length})"
    return out


def bits(gram: str, hashes: int, length: int | str) -> str:
    """Bits of one gram, repeats kept."""
    return f"list_transform(range(0, {hashes}), lambda i: ({modulo(f'sha1({gram})', 40, length)} + i * {modulo(f'md5({gram})', 32, length)}) % {length})"


def filter_bits(s: str, hashes: int, length: int | str) -> str:
    """Set bits of a string, ascending."""
    return f"list_sort(list_distinct(flatten(list_transform(list_distinct({grams(s)}), lambda g: {bits('g', hashes, length)}))))"


def literal(values: Sequence[int]) -> str:
    return "[" + ",".join(map(str, values)) + "]"



#: The two signatures of the flagship: first three letters of the first word with two of the second, and the other way round.
SIGNATURES = ("0,0:0,1:0,2:1,0:1,1", "1,0:1,1:1,2:0,0:0,1")
_CHAR = "(CASE WHEN length(a{0}) < {1} + 1 THEN '?' ELSE substr(a{0}, {1} + 1, 1) END)"


def signature(spec: str) -> str:
    """A signature of positions and whole values as a SQL expression."""
    parts = [p.split(",") for p in spec.split(":")]
    return " || ".join(f"a{int(a) + 1}" if w == "*" else _CHAR.format(int(a) + 1, w) for a, w in parts)


def signed(specs: Sequence[str], low: int, high: int | str) -> str:
    """sa, sb (all signatures) and ka, kb (those of allowed frequency)."""
    rows = lambda t: " UNION ALL ".join(f"SELECT {signature(s)} AS block, rec_id FROM {t}" for s in specs)
    kept = lambda t: f"SELECT * FROM {t} WHERE block IN (SELECT block FROM {t} GROUP BY block HAVING count(*) > {low} AND count(*) <= {high})"
    return f"sa AS ({rows('alice')}), sb AS ({rows('bob')}), ka AS ({kept('sa')}), kb AS ({kept('sb')})"


def assessment(pairs: str) -> str:
    """cand ... pq of a table of distinct pairs (a, b)."""
    return f"""SELECT cand, true_cand, true_total, na, nb, 1.0::DOUBLE - cand::DOUBLE / (na * nb) AS rr,
       CASE WHEN true_total > 0 THEN true_cand::DOUBLE / true_total ELSE -1.0 END AS pc, CASE WHEN cand > 0 THEN true_cand::DOUBLE / cand ELSE -1.0 END AS pq
FROM (SELECT count(*) AS cand, count(*) FILTER (a = b) AS true_cand FROM {pairs}),
     (SELECT count(*) AS true_total FROM alice JOIN bob USING (ent_id)), (SELECT count(*) AS na FROM alice), (SELECT count(*) AS nb FROM bob)"""
