"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

from faultline.llm.manifest import ARITY

def _crc(column: str) -> str:
    """Unsigned crc32 of an integer's decimal text, bit by bit; each byte comes in with its first bit."""
    text = f"CAST({column} AS VARCHAR)"
    bits = f"flatten([[CAST(ascii(substr({text}, CAST(i AS INT), 1)) AS BIGINT), 0, 0, 0, 0, 0, 0, 0] for i in range(1, length({text}) + 1)])"
    return f"xor(list_reduce([4294967295] || {bits}, lambda c, b: xor(xor(c, b) >> 1, CASE WHEN xor(c, b) & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295)"


def _code(*columns: str) -> str:
    return " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in columns)


_TREE = f"""{{name}} AS (
    SELECT * FROM {{base}}
    UNION ALL
    SELECT part, level + 1, position // {ARITY}, sha256(string_agg(node, '' ORDER BY position)) FROM
      (SELECT *, count(*) OVER (PARTITION BY part) AS n FROM {{name}}) WHERE n > 1 GROUP BY part, level, position // {ARITY}
)"""

OP12_SQL = f"""
WITH RECURSIVE leaves AS (
    SELECT doc_id, source, coalesce('=' || source, '-') AS part, sha256({_code("doc_id", "source", "lang", "n_chars", "text")}) AS leaf,
      CASE WHEN doc_id IS NOT NULL AND {_crc("doc_id")} % 2 = 0 THEN sha256({_code("doc_id", "source", "lang", "n_chars", "replace(text, chr(10), '')")})
           ELSE sha256({_code("doc_id", "source", "lang", "n_chars", "text")}) END AS present
    FROM documents
), numbered AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY doc_id NULLS FIRST, leaf) - 1 AS position FROM leaves),
low_base AS (SELECT part, 0 AS level, position, leaf AS node FROM numbered),
{_TREE.format(name="low", base="low_base")},
subroots AS (SELECT part, arg_max(node, level) AS node, max(level) AS top FROM low GROUP BY part),
high_base AS (SELECT '' AS part, 0 AS level, row_number() OVER (ORDER BY part) - 1 AS position, node FROM subroots),
{_TREE.format(name="high", base="high_base")},
root AS (SELECT arg_max(node, level) AS node FROM high),
places AS (
    SELECT n.doc_id, n.part, n.position AS own, n.leaf, n.present, s.node AS subroot, s.top, row_number() OVER () AS row_id, r.rank AS above
    FROM numbered n JOIN subroots s USING (part) JOIN (SELECT part, row_number() OVER (ORDER BY part) - 1 AS rank FROM subroots) r USING (part)
), nodes AS (
    SELECT part, level, position, node FROM low UNION ALL SELECT 'root', level, position, node FROM high
), runs AS (
    SELECT part, level, position // {ARITY} AS run, list(node ORDER BY position) AS members FROM nodes GROUP BY part, level, position // {ARITY}
), steps AS (
    SELECT row_id, level AS step, CAST(own // CAST(pow({ARITY}, level) AS BIGINT) AS BIGINT) AS place, part AS tree, level
    FROM places, LATERAL (SELECT unnest(range(0, top)) AS level)
    UNION ALL
    SELECT row_id, top + level, CAST(above // CAST(pow({ARITY}, level) AS BIGINT) AS BIGINT), 'root', level
    FROM places, LATERAL (SELECT unnest(range(0, (SELECT max(level) FROM high))) AS level)
), sides AS (
    SELECT s.row_id, s.step, array_to_string(list_slice(r.members, 1, s.place % {ARITY}), '') AS before, array_to_string(list_slice(r.members, s.place % {ARITY} + 2, {ARITY}), '') AS after
    FROM steps s JOIN runs r ON r.part = s.tree AND r.level = s.level AND r.run = s.place // {ARITY}
), folding AS (
    SELECT row_id, CAST(0 AS BIGINT) AS step, present AS node FROM places
    UNION ALL
    SELECT f.row_id, f.step + 1, sha256(s.before || f.node || s.after) FROM folding f JOIN sides s ON s.row_id = f.row_id AND s.step = f.step
), folded AS (SELECT row_id, arg_max(node, step) AS node FROM folding GROUP BY row_id),
joined AS (SELECT row_id, sha256(string_agg(before || after, '' ORDER BY step)) AS proof FROM sides GROUP BY row_id)
SELECT p.doc_id, p.leaf, p.subroot, r.node AS root, coalesce(j.proof, sha256('')) AS proof_sha256, f.node AS folded_root, f.node = r.node AS verified
FROM places p CROSS JOIN root r JOIN folded f USING (row_id) LEFT JOIN joined j USING (row_id)
"""

OP13_SQL = r"""
WITH docs AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS row_id, coalesce(text, '') AS text FROM documents),
grps AS (SELECT DISTINCT lang, source FROM docs),
occurrences AS (
    SELECT lang, source, row_id, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM docs
), kept AS (SELECT lang, term, count(*) AS n FROM occurrences GROUP BY lang, term HAVING count(DISTINCT row_id) >= 30),
counts AS (SELECT o.lang, o.source, o.term, count(*) AS n FROM occurrences o JOIN kept USING (lang, term) GROUP BY ALL),
terms_of AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
totals AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM grps g LEFT JOIN counts c USING (lang, source) GROUP BY ALL),
filled AS (
    SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (CAST(coalesce(c.n, 0) AS HUGEINT) + 5)) // (t.total + 5 * v.v) AS p
    FROM totals t JOIN terms_of v USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term
), pairs AS (
    SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM filled a JOIN filled b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), all_pairs AS (
    SELECT a.lang, a.source, b.source AS item, CAST(coalesce(p.value, 0) AS BIGINT) AS value
    FROM grps a JOIN grps b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
), over AS (
    SELECT f.lang, f.source, f.term AS item, CAST(f.p - (1 + (1000000000 * (CAST(k.n AS HUGEINT) + 5)) // (v.total + 5 * v.v)) AS BIGINT) AS value
    FROM filled f JOIN kept k USING (lang, term) JOIN terms_of v USING (lang) WHERE f.n > 0
)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INT) AS rank FROM all_pairs
UNION ALL
SELECT * FROM (
    SELECT lang, source, 'term' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INT) AS rank FROM over WHERE value > 0
) WHERE rank <= 50
"""
