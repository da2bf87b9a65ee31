"""SQL twins of the queries that SQL can express."""

from __future__ import annotations

from triagekit.llm.licences import (
    FIXED_STATEMENT, KNOWN, NAMES_OF, OPENINGS, PHRASES, SPELLINGS, STATEMENT,
)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def replaced(x: str, pairs: tuple[tuple[str, str], ...]) -> str:
    for pattern, to in pairs:
        x = f"replace({x}, {quoted(pattern)}, {quoted(to)})"
    return x


def canonical_line(x: str) -> str:
    words = f"trim(regexp_replace({replaced(f'lower({x})', SPELLINGS)}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    return replaced(words, PHRASES)


def statement() -> tuple[str, str]:
    """The pattern of copyright statements and what replaces it; these expressions cannot look ahead, so the
    words that end a statement are matched and put back."""
    ahead = f"(?=$| (?:{'|'.join(OPENINGS)}))"
    groups = STATEMENT.count(ahead) + 1
    return STATEMENT.replace(ahead, ahead.replace("(?=", "(")), "".join(f"\\{i + 1}" for i in range(groups))


def licence_digest(lines: str) -> str:
    """Digest of a whole text, from its canonical lines."""
    pattern, back = statement()
    kept = f"array_to_string(list_filter({lines}, lambda x: x <> ''), chr(10))"
    kept = f"regexp_replace({kept}, {quoted(FIXED_STATEMENT)}, '', 'g')"
    kept = f"regexp_replace({kept}, {quoted(pattern)}, {quoted(back)}, 'g')"
    words = f"trim(regexp_replace({kept}, '[ \\n]+', ' ', 'g'))"
    names = f"regexp_replace({words}, {quoted(NAMES_OF)}, 'neither the name of the copyright holder nor the names of its contributors', 'g')"
    return f"md5({replaced(names, PHRASES)})"


LINES = f"list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {canonical_line('x')})"

LICENCES = f"""WITH known AS (SELECT digest, min(licence) AS licence FROM (SELECT licence, {licence_digest('lines')} AS digest FROM (
SELECT licence, {LINES} AS lines FROM (VALUES {', '.join(f'({quoted(n)}, {quoted(t)})' for n, t in KNOWN)}) k(licence, text)))
WHERE digest <> md5('') GROUP BY digest),
d AS (SELECT doc_id, md5(coalesce(text, '')) AS raw, {LINES} AS lines FROM documents),
notices AS (SELECT raw, string_agg(licence, ',' ORDER BY licence) AS notices FROM (SELECT DISTINCT raw, licence FROM (
SELECT raw, unnest(lines) AS line FROM d) l JOIN known ON known.digest = md5(line) WHERE line <> '') GROUP BY raw),
w AS (SELECT doc_id, raw, {licence_digest('lines')} AS digest FROM d)
SELECT doc_id, digest, licence, notices FROM w LEFT JOIN known USING (digest) LEFT JOIN notices USING (raw)"""

#: Each turn quotes the two before it, so quotes need not be parsed: they are the passages of those turns.
QUOTES = r"""WITH RECURSIVE m AS (SELECT conv_id, turn, text, list_filter(list_transform(
regexp_split_to_array(coalesce(text, ''), '\n(\s*\n)+'), lambda x: trim(regexp_replace(lower(x), '\s+', ' ', 'g'))), lambda x: x <> '') AS ps FROM conversations),
one AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY text NULLS LAST) = 1),
near AS (SELECT conv_id, p, min(turn) AS first_turn FROM (SELECT conv_id, turn, unnest(ps) AS p FROM m) GROUP BY conv_id, p),
q AS (SELECT a.conv_id, a.turn, a.text, coalesce(len(b.ps), 0) + coalesce(len(c.ps), 0) AS n_quoted, n.first_turn AS parent_turn
FROM m a LEFT JOIN one b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1 LEFT JOIN one c ON c.conv_id = a.conv_id AND c.turn = a.turn - 2
LEFT JOIN near n ON n.conv_id = a.conv_id AND n.p = b.ps[1]),
names AS (SELECT DISTINCT conv_id, turn, parent_turn FROM q),
t AS (SELECT conv_id, turn, turn AS thread_turn, 0::BIGINT AS depth FROM names WHERE parent_turn IS NULL
UNION ALL SELECT q.conv_id, q.turn, t.thread_turn, t.depth + 1 FROM names q JOIN t ON t.conv_id = q.conv_id AND t.turn = q.parent_turn)
SELECT conv_id, turn, CASE WHEN parent_turn IS NOT NULL THEN conv_id END AS parent_conv, parent_turn, conv_id AS thread_conv, thread_turn,
depth, (sum(n_quoted) OVER (PARTITION BY conv_id, turn))::BIGINT AS n_quoted,
(sum(n_quoted) OVER (PARTITION BY conv_id, turn))::BIGINT AS n_linked, md5(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')) AS own_md5
FROM q JOIN t USING (conv_id, turn)"""



def vector_codes() -> str:
    """Product quantisation by comparing every part with every entry: 16 parts, 64 entries, two rounds."""
    nearest = """(SELECT v.vec_id, v.part, v.x, min({{'d': list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'e': b.entry}}) AS near
FROM v JOIN {books} b USING (part) GROUP BY v.vec_id, v.part, v.x)"""
    moved = """(SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM {books} b LEFT JOIN (SELECT part, entry, list(floor(s / n)::BIGINT ORDER BY i) AS x FROM (
SELECT part, near.e AS entry, i, sum(x[i]) AS s, count(*) AS n FROM {near} a, range(1, len(x) + 1) r(i) GROUP BY part, near.e, i) GROUP BY part, entry) m USING (part, entry))"""
    return f"""WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS x FROM embeddings
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT vec_id, p::INT AS part, x[p * (len(x) // 16) + 1 : (p + 1) * (len(x) // 16)] AS x FROM kept, range(16) r(p)),
b0 AS MATERIALIZED (SELECT part, e.entry, v.x FROM v JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT 64) e USING (vec_id)),
a0 AS MATERIALIZED {nearest.format(books='b0')}, b1 AS MATERIALIZED {moved.format(books='b0', near='a0')},
a1 AS MATERIALIZED {nearest.format(books='b1')}, b2 AS MATERIALIZED {moved.format(books='b1', near='a1')}, a2 AS MATERIALIZED {nearest.format(books='b2')},
coded AS (SELECT vec_id, string_agg(format('{{:02x}}', near.e), '' ORDER BY part) AS code, sum(near.d)::BIGINT AS error FROM a2 GROUP BY vec_id),
books AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id), books"""


ORACLES: dict[str, str] = {
    "op3_quotation_linking": QUOTES, "op7_licences": LICENCES, "op13_vector_codes": vector_codes(),
}
