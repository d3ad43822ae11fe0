"""SQL of the corpus model for the oracle: tables as common table expressions, functions as text."""

from __future__ import annotations

from tessera.schema import IDENT, STOPWORDS

STOPS = "(" + ", ".join(f"'{w}'" for w in STOPWORDS) + ")"
PATH = "source || '/' || lang || '/' || CASE WHEN doc_id % 10 = 0 THEN 'tests/' ELSE '' END || 'doc_' || doc_id::VARCHAR || '.txt'"


def estimate(e: str) -> str:
    return f"greatest(1, length({e}) // 4)::INTEGER"


def idents(e: str) -> str:
    return f"regexp_extract_all({e}, '{IDENT}')"


def split(e: str) -> str:
    marked = f"regexp_replace({e}, '([A-Z])([A-Z][a-z0-9])', '\\1_\\2', 'g')"
    return f"list_transform(regexp_extract_all({marked}, '[A-Z]?[a-z0-9]+|[A-Z]+|[0-9]+'), lambda s: lower(s))"


def tokens(e: str) -> str:
    kept = f"list_filter({split('i')}, lambda p: length(p) > 1 AND p NOT IN {STOPS})"
    own = f"list_concat([lower(i)], CASE WHEN len({split('i')}) > 1 THEN {kept} ELSE []::VARCHAR[] END)"
    return f"flatten(list_transform(list_filter({idents(e)}, lambda i: lower(i) NOT IN {STOPS}), lambda i: {own}))"


def symbol_doc(name="name", kind="kind", sig="signature", path="path") -> str:
    where = f"translate({path}, '/.', '  ')"
    return f"list_concat(list_concat(list_concat([lower({name}), {kind}], {split(name)}), {tokens(sig)}), {tokens(where)})"


def test_path(p: str) -> str:
    parts = f"string_split(lower({p}), '/')"
    return f"(len(list_intersect({parts}[:-2], ['tests', 'test', '__tests__', 'spec'])) > 0 OR {parts}[-1] LIKE 'test\\_%' ESCAPE '\\' OR {parts}[-1] LIKE '%\\_test.py' ESCAPE '\\')"


def well_named(n: str) -> str:
    return f"(length({n}) >= 8 AND (instr({n}, '_') > 0 OR ({n} <> lower({n}) AND {n} <> upper({n}))))"


def multiplier(n: str) -> str:
    return f"(CASE WHEN {well_named(n)} THEN 2.0 ELSE 1.0 END * CASE WHEN {n} LIKE '\\_%' ESCAPE '\\' THEN 0.1 ELSE 1.0 END)::DOUBLE"


FILES = f"files AS (SELECT {PATH} AS path, substr(sha256(text), 1, 16) AS sha, (1.7e9 + doc_id * 60)::DOUBLE AS mtime, n_chars AS size, lang FROM documents)"
LINES = f"""lines AS (
    SELECT path, lang, len(l)::INTEGER AS n_lines, unnest(l) AS content, generate_subscripts(l, 1)::INTEGER AS line
    FROM (SELECT {PATH} AS path, lang, string_split(text, chr(10)) AS l FROM documents))"""
SYMBOLS = f"""{LINES}, symbols AS (
    SELECT path, name, lang AS kind, line, coalesce(lead(line) OVER (PARTITION BY path ORDER BY line) - 1, n_lines)::INTEGER AS end_line,
           CASE WHEN length(trim(content)) > 120 THEN substr(trim(content), 1, 119) || '…' ELSE trim(content) END AS signature
    FROM (SELECT *, regexp_extract(content, '{IDENT}') AS name FROM lines) WHERE name <> '')"""
IDENTS = f"""idents AS (
    SELECT path, name, count(*) AS count
    FROM (SELECT {PATH} AS path, unnest({idents("text")}) AS name FROM documents)
    WHERE lower(name) NOT IN {STOPS} GROUP BY path, name)"""
LINE_DEFS = "defs AS (SELECT DISTINCT 's' || l_suppkey::VARCHAR AS path, l_partkey::VARCHAR AS name FROM lineitem)"
LINE_REFS = "refs AS (SELECT 'c' || o_custkey::VARCHAR AS path, l_partkey::VARCHAR AS name, count(*) AS count FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"
USED = """used AS (SELECT * FROM refs WHERE name IN (SELECT name FROM defs)),
n AS (SELECT greatest(1, count(DISTINCT path)) AS n FROM used),
rf AS (SELECT name, count(*) AS rf FROM used GROUP BY name),
kept AS (SELECT * FROM rf WHERE NOT ((SELECT n FROM n) >= 20 AND rf / (SELECT n FROM n)::DOUBLE > 0.25))"""
EDGES = f"""{USED},
definers AS (SELECT name, count(DISTINCT path) AS definers FROM defs GROUP BY name),
edges AS (
    SELECT u.path AS src, d.path AS dst, u.name AS ident,
           {multiplier("u.name")} * ln(1 + (SELECT n FROM n)::DOUBLE / (1 + rf)) * sqrt(u.count) / definers AS weight
    FROM used u JOIN kept USING (name) JOIN definers USING (name) JOIN defs d USING (name) WHERE u.path <> d.path)"""
SNAPS = f"""old AS (
    SELECT {PATH} AS path, substr(sha256(text), 1, 16) AS sha, doc_id::DOUBLE AS mtime, n_chars AS size FROM documents WHERE doc_id % 19 <> 0),
new AS (
    SELECT {PATH} AS path, substr(sha256(CASE WHEN doc_id % 13 = 0 THEN text || '!' ELSE text END), 1, 16) AS sha,
           CASE WHEN doc_id % 11 = 0 OR doc_id % 13 = 0 THEN doc_id + 0.5 ELSE doc_id END::DOUBLE AS mtime,
           n_chars + CASE WHEN doc_id % 13 = 0 THEN 1 ELSE 0 END AS size
    FROM documents WHERE doc_id % 17 <> 0)"""
CHANGES = """changes AS (
    SELECT coalesce(o.path, n.path) AS path,
           CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed'
                WHEN {fast} THEN 'unchanged' WHEN o.sha <> n.sha THEN 'updated'
                WHEN o.mtime = n.mtime AND o.size = n.size THEN 'unchanged' ELSE 'touched' END AS status
    FROM old o FULL OUTER JOIN new n ON o.path = n.path)"""
FAST = CHANGES.format(fast="o.mtime = n.mtime AND o.size = n.size")
VERIFIED = CHANGES.format(fast="false")


def pagerank(steps: int, focus: str = "") -> str:
    """Chained expressions for a fixed number of steps over ``edges`` and ``defs``/``refs``; focus: an SQL condition on node."""
    start = f"CASE WHEN {focus} THEN 1.0 / (SELECT count(*) FROM nodes WHERE {focus}) ELSE 0.0 END" if focus else "1.0 / (SELECT count(*) FROM nodes)"
    out = [
        "nodes AS (SELECT path AS node FROM used UNION SELECT path FROM defs)",
        "pairs AS MATERIALIZED (SELECT src, dst, sum(weight) AS w FROM edges GROUP BY src, dst)",
        "outs AS (SELECT src, sum(w) AS o FROM pairs GROUP BY src)",
        "shares AS MATERIALIZED (SELECT src, dst, w / o AS share FROM pairs JOIN outs USING (src))",
        f"r0 AS MATERIALIZED (SELECT node, ({start})::DOUBLE AS p, node NOT IN (SELECT src FROM outs) AS ends, ({start})::DOUBLE AS rank FROM nodes)",
    ]
    for i in range(steps):
        out.append(
            f"r{i + 1} AS MATERIALIZED (SELECT node, p, ends, 0.15 * p + 0.85 * (coalesce(got, 0.0) + (SELECT coalesce(sum(rank), 0.0) FROM r{i} WHERE ends) * p) AS rank "
            f"FROM r{i} LEFT JOIN (SELECT dst, sum(rank * share) AS got FROM shares JOIN r{i} ON src = node GROUP BY dst) ON dst = node)"
        )
    return ",\n".join(out)


def bm25(query_tokens: list[str], limit: int) -> str:
    """A table ``hits`` (path, line, name, score) over ``symbols``."""
    from collections import Counter

    times = Counter(query_tokens)
    weights = ", ".join(f"('{t}', {n})" for t, n in times.items())
    boost = ", ".join(f"'{t}'" for t in ["".join(query_tokens), *times])
    return f"""docs AS (SELECT path, line, name, {symbol_doc()} AS words FROM symbols),
size AS (SELECT count(*)::DOUBLE AS n, avg(len(words)) AS average FROM docs),
q AS (SELECT * FROM (VALUES {weights}) AS t(term, times)),
posted AS (
    SELECT path, line, name, dl, term, count(*) AS tf
    FROM (SELECT path, line, name, len(words) AS dl, unnest(words) AS term FROM docs) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM posted GROUP BY term),
scored AS (
    SELECT path, line, name,
           sum(times * ln(1 + ((SELECT n FROM size) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT average FROM size))))
           * CASE WHEN lower(name) IN ({boost}) THEN 2.0 ELSE 1.0 END AS s
    FROM posted JOIN df USING (term) JOIN q USING (term) GROUP BY path, line, name),
hits AS (SELECT path, line, name, round(s, 6) AS score FROM scored ORDER BY score DESC, path, line LIMIT {limit})"""
