"""All queries of the library by name, each with the SQL that gives the same rows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import changes, extract, graph, health, impact, matrix, navigate, rankmap, search, telemetry
from tessera.plans import dialect as D
from tessera.schema import FALLBACK
from tessera.sources import adapters as A
from tessera.sources import repo
from tessera.storage import scratch, table, written
from tessera.streaming import telemetry as stream

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

SEARCH, STEPS, IDENT_CAP, BUDGET = "the ingou reand", 10, 50, 2_048
GLOBS = (r"src1/.*", r".*0\.txt", r"src2/de/.*")
WIRING = (r'href="/([a-z0-9]+)', r"<h1>(\w+)")


def query(oracle: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return keep


# --- sources and filters ---


@query(f"WITH {D.FILES} SELECT path, sha, size, lang, mtime FROM files WHERE size > 0 AND size <= 1000000")
def scan_files(spark: SparkSession, sf: str) -> DataFrame:
    return A.doc_files(spark, sf).where("size > 0 and size <= 1000000 and sha is not null").where(~X.in_skipped_dir(F.col("path"))).select("path", "sha", "size", "lang", "mtime")


@query(f"WITH {D.FILES} SELECT path FROM files WHERE NOT ({' OR '.join(f"regexp_full_match(path, '{g}')" for g in GLOBS)})")
def ignore_filter(spark, sf):
    return A.doc_files(spark, sf).where(~repo.ignored(F.col("path"), ["src1/", "*0.txt", "src2/de/"])).select("path")


@query(f"SELECT {D.PATH} AS path, list_max(list_transform(string_split(text, chr(10)), lambda x: strlen(x))) > 1000 AS generated FROM documents")
def generated_filter(spark, sf):
    content = F.col("text").cast("binary")
    return table(spark, sf, "documents").select(A.doc_path().alias("path"), extract.looks_generated(content).alias("generated"))


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def lang_histogram(spark, sf):
    return A.doc_files(spark, sf).groupBy("lang").agg(F.count("*").alias("n"))


@query(f"""WITH {D.FILES}, {D.SYMBOLS}, {D.IDENTS}
SELECT 'files' AS what, count(*) AS n FROM files UNION ALL SELECT 'symbols', count(*) FROM symbols UNION ALL SELECT 'idents', count(*) FROM idents
UNION ALL SELECT 'lang:' || lang, count(*) FROM files GROUP BY lang""")
def index_stats(spark, sf):
    return navigate.stats(A.doc_files(spark, sf), A.doc_symbols(spark, sf), A.doc_idents(spark, sf))


# --- extraction ---


@query(f"WITH {D.IDENTS} SELECT * FROM idents")
def lexical_idents(spark, sf):
    return A.doc_idents(spark, sf)


@query(f"WITH {D.IDENTS} SELECT path, name, count FROM idents QUALIFY row_number() OVER (PARTITION BY path ORDER BY count DESC, name) <= {IDENT_CAP}")
def ident_cap_topn(spark, sf):
    return extract.most_common(A.doc_idents(spark, sf), IDENT_CAP, "name")


@query(f"WITH {D.SYMBOLS} SELECT path, name, kind, line, end_line, signature FROM symbols")
def line_symbols(spark, sf):
    return A.doc_symbols(spark, sf)


_CODE = "CASE line % 6 WHEN 0 THEN '  async def ' WHEN 1 THEN 'export function ' WHEN 2 THEN 'abstract class ' WHEN 3 THEN 'pub fn ' WHEN 4 THEN 'func ' ELSE 'x = ' END || name || '()'"


@query(f"""WITH {D.SYMBOLS}, code AS (SELECT path, line, {_CODE} AS content, name AS own FROM symbols)
SELECT path, own AS name, line, line AS end_line, CASE line % 6 WHEN 2 THEN 'class' ELSE 'function' END AS kind, trim(content) AS signature, (line % 6)::INTEGER AS seq
FROM code WHERE line % 6 <> 5""")
def regex_symbols(spark, sf):
    code = A.doc_lines(spark, sf).withColumn("name", F.regexp_extract("content", "[A-Za-z_][A-Za-z0-9_]{2,63}", 0))
    own = code.withColumn("code", F.when(F.col("name") != "", F.expr(_CODE)).otherwise(""))
    texts = own.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "code"))), lambda x: x["code"]), "\n").alias("text"))
    return extract.regex_symbols(texts, FALLBACK).select("path", "name", "line", "end_line", "kind", "signature", "seq")


@query()
def ast_symbols(spark, sf):
    source = "import os\n\n\nclass Engine(Base):\n    @cached\n    def start_engine(self):\n        return prepare_fuel()\n\n\ndef prepare_fuel():\n    return 42\n"
    files = spark.createDataFrame([("pkg/core.py", "python", source)], "path string, lang string, text string")
    return extract.parsed(files).select("path", F.explode("symbols").alias("s")).select("path", "s.*")


@query(f"""WITH p AS (SELECT url AS path, unnest(list_concat(regexp_extract_all(html, '{WIRING[0]}', 1), regexp_extract_all(html, '<h1>([0-9A-Za-z_]+)', 1))) AS name FROM pages)
SELECT path, name, count(*) AS count FROM p WHERE name <> '' GROUP BY path, name""")
def wiring_links(spark, sf):
    files = table(spark, sf, "pages").select(F.col("url").alias("path"), F.col("html").alias("text"))
    return extract.wiring_idents(files, WIRING)


@query(f"SELECT p_partkey, {D.split('p_name')} AS parts_of_name FROM part".replace("SELECT p_partkey, ", "SELECT p_partkey, array_to_string(").replace(" AS parts_of_name", ", ' ') AS subtokens"))
def subtokens(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.array_join(X.split_ident(F.col("p_name")), " ").alias("subtokens"))


@query(f"SELECT doc_id, array_to_string({D.tokens('text')}, ' ') AS tokens FROM documents")
def tokenized(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(X.tokenize(F.col("text")), " ").alias("tokens"))


@query(f"SELECT doc_id, {D.estimate('text')} AS tokens FROM documents")
def token_estimate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


_OUTLINE = "format('{:5d}-{:<5d} [{}] {}', line, end_line, kind, signature)"


@query(f"""WITH {D.SYMBOLS}, o AS (SELECT path, sum(greatest(1, length({_OUTLINE} || chr(10)) // 4))::BIGINT AS t FROM symbols GROUP BY path)
SELECT f.path, greatest(1, length(text) // 4)::BIGINT AS whole_tokens, coalesce(t, 0)::BIGINT AS outline_tokens FROM (SELECT {D.PATH} AS path, text FROM documents) f LEFT JOIN o USING (path)""")
def token_costs(spark, sf):
    files = table(spark, sf, "documents").select(A.doc_path().alias("path"), "text")
    return navigate.token_costs(files, A.doc_symbols(spark, sf))


@query(f"WITH {D.FILES} SELECT path, {D.test_path('path')} AS is_test FROM files")
def test_path_flag(spark, sf):
    return A.doc_files(spark, sf).select("path", X.is_test_path(F.col("path")).alias("is_test"))


@query(f"WITH {D.IDENTS}, w AS (SELECT DISTINCT name FROM idents) SELECT name, {D.well_named('name')} AS well_named, {D.multiplier('name')} AS multiplier FROM w")
def ident_multiplier(spark, sf):
    return A.doc_idents(spark, sf).select("name").distinct().select("name", X.is_well_named(F.col("name")).alias("well_named"), X.ident_multiplier(F.col("name")).alias("multiplier"))


_PARTS = ", ".join(f"coalesce(sum(('0x' || substr(d, {1 + 15 * i}, 15))::BIGINT::HUGEINT), 0)::VARCHAR" for i in range(4))


@query(f"WITH {D.FILES}, k AS (SELECT sha256(path || chr(0) || sha) AS d FROM files) SELECT substr(sha256(concat_ws(':', count(*)::VARCHAR, {_PARTS})), 1, 16) AS stamp FROM k")
def state_stamp(spark, sf):
    return changes.state_stamp(A.doc_files(spark, sf))


# --- keeping an index up to date ---


@query(f"WITH {D.SNAPS}, {D.FAST} SELECT path, status FROM changes")
def incremental_diff(spark, sf):
    return changes.diff(*A.snapshots(spark, sf))


@query(f"WITH {D.SNAPS}, {D.VERIFIED} SELECT count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'updated') AS updated, count(*) FILTER (status = 'removed') AS removed, count(*) FILTER (status IN ('unchanged', 'touched')) AS unchanged FROM changes")
def diff_counters(spark, sf):
    return changes.counters(changes.diff(*A.snapshots(spark, sf), verify=True))


@query(f"""WITH {D.SNAPS}, {D.VERIFIED}
SELECT path, sha, size FROM old WHERE path NOT IN (SELECT path FROM changes WHERE status IN ('removed', 'updated', 'added'))
UNION ALL SELECT path, sha, size FROM new WHERE path IN (SELECT path FROM changes WHERE status IN ('updated', 'added'))""")
def upsert_merge(spark, sf):
    old, new = A.snapshots(spark, sf)
    what = changes.diff(old, new, verify=True)
    fresh = new.join(what.where("status in ('added', 'updated')"), "path", "left_semi")
    return changes.upsert(old.select("path", "sha", "size"), fresh.select("path", "sha", "size"), what.where("status = 'removed'"))


# --- lookups ---



@query(f"WITH {D.SYMBOLS} SELECT path, name, kind, line, end_line, signature FROM symbols WHERE path = (SELECT min(path) FROM symbols WHERE kind = 'en')")
def outline(spark, sf):
    s = A.doc_symbols(spark, sf)
    first = s.where("kind = 'en'").agg(F.min("path").alias("path"))
    return s.join(first, "path", "left_semi").orderBy("line")


@query(f"WITH {D.SYMBOLS} SELECT path, name, kind, line, end_line, signature FROM symbols WHERE name = 'The'")
def defs_lookup(spark, sf):
    return navigate.defs(A.doc_symbols(spark, sf), "The")


@query(f"WITH {D.IDENTS} SELECT path, count AS score FROM idents WHERE name = 'ingou'")
def refs_lookup(spark, sf):
    return navigate.refs(A.doc_idents(spark, sf), "ingou")


@query(f"WITH {D.IDENTS} SELECT path, min(count)::BIGINT AS score FROM idents WHERE name IN ('the', 'that') GROUP BY path HAVING count(DISTINCT name) = 2")
def refs_qualified(spark, sf):
    return navigate.refs(A.doc_idents(spark, sf), "the.that")


@query(f"WITH {D.SYMBOLS}, {D.IDENTS} SELECT path, count AS score FROM idents WHERE name = 'The' AND path NOT IN (SELECT path FROM symbols WHERE name = 'The')")
def refs_elsewhere(spark, sf):
    return navigate.refs_elsewhere(A.doc_idents(spark, sf), A.doc_symbols(spark, sf), "The")


@query(f"WITH {D.SYMBOLS}, {D.IDENTS} SELECT path, name, count FROM idents WHERE name IN (SELECT name FROM symbols)")
def referenced_defined(spark, sf):
    return navigate.referenced_defined(A.doc_idents(spark, sf), A.doc_symbols(spark, sf)).select("path", "name", "count")


@query(f"""WITH {D.SYMBOLS}, t AS (SELECT path, line AS a, end_line AS b FROM symbols WHERE name = 'The')
SELECT lines.path, line, 'body' AS part, format('{{:5d}}: {{}}', line, content) AS shown FROM lines JOIN t ON lines.path = t.path AND line BETWEEN a AND b
UNION ALL SELECT path, line, 'skeleton', {_OUTLINE} || ' ...' FROM symbols WHERE name <> 'The' AND path IN (SELECT path FROM t)""")
def slice_view(spark, sf):
    s = A.doc_symbols(spark, sf).withColumn("seq", F.col("line"))
    return navigate.slice_view(A.doc_lines(spark, sf), s, "The")


# --- graph ---


def _line_matrix(spark, sf):
    names = matrix.by_name(A.line_deliveries(spark, sf), A.line_orders(spark, sf))
    return names, matrix.matrix(names)


@query(f"WITH {D.LINE_DEFS}, {D.LINE_REFS}, {D.EDGES} SELECT src, dst, round(sum(weight), 6) AS w, count(*) AS idents FROM edges GROUP BY src, dst")
def graph_edges(spark, sf):
    names, m = _line_matrix(spark, sf)
    if m:
        return matrix.file_edges(m).withColumn("w", F.round("w", 6))
    pairs = graph.edges(matrix.definitions_of(names), matrix.references_of(names))
    return pairs.groupBy("src", "dst").agg(F.round(F.sum("weight"), 6).alias("w"), F.count("*").alias("idents"))


@query(f"WITH {D.SYMBOLS}, {D.IDENTS}, defs AS (SELECT DISTINCT name, path FROM symbols), refs AS (SELECT * FROM idents), {D.USED} SELECT name, rf FROM kept")
def ambient_cutoff(spark, sf):
    own = navigate.referenced_defined(A.doc_idents(spark, sf), A.doc_symbols(spark, sf))
    return graph.usable_names(own)[0]


def _line_ranks(spark, sf, focus=()):
    """Ranks of the files, and a function that gives those of the definitions."""
    names, m = _line_matrix(spark, sf)
    if m:
        rank, out = matrix.ranks(m, focus, max_iter=STEPS, tol=0.0)
        return matrix.file_ranks(m, rank), lambda: matrix.definition_ranks(m, rank, out)
    d, r = written(matrix.definitions_of(names), "line-defs"), written(matrix.references_of(names), "line-refs")
    e = written(graph.shares(d, graph.weighted_uses(d, r)), "line-shares")
    ranks = written(graph.pagerank(graph.graph_nodes(d, r), d, e, focus, max_iter=STEPS, tol=0.0), "line-ranks")
    return ranks, lambda: graph.definition_ranks(ranks, d, e)


@query(f"WITH {D.LINE_DEFS}, {D.LINE_REFS}, {D.EDGES}, {D.pagerank(STEPS)} SELECT node, round(rank, 8) AS rank FROM r{STEPS}")
def pagerank_fixed(spark, sf):
    return _line_ranks(spark, sf)[0].select("node", F.round("rank", 8).alias("rank"))


_FOCUS = ("c1", "c10", "c100")


@query(f"WITH {D.LINE_DEFS}, {D.LINE_REFS}, {D.EDGES}, {D.pagerank(STEPS, f'node IN {_FOCUS}')} SELECT node, round(rank, 8) AS rank FROM r{STEPS}")
def pagerank_personalized(spark, sf):
    return _line_ranks(spark, sf, _FOCUS)[0].select("node", F.round("rank", 8).alias("rank"))


def _ranked(spark, sf):
    return _line_ranks(spark, sf)[1]().withColumn("score", F.round("score", 8))


_RANKED = f"""{D.LINE_DEFS}, {D.LINE_REFS}, {D.EDGES}, {D.pagerank(STEPS)},
eo AS (SELECT src, sum(weight) AS o FROM edges GROUP BY src),
ranked AS (SELECT dst AS path, ident AS name, round(sum(rank * weight / o), 8) AS score FROM edges JOIN eo USING (src) JOIN r{STEPS} ON src = node GROUP BY dst, ident)"""


@query(f"WITH {_RANKED} SELECT path, name, score FROM ranked")
def def_rank(spark, sf):
    return _ranked(spark, sf)


@query(f"""WITH {_RANKED},
s AS (SELECT path, name, name::INTEGER AS line, 'part ' || p_name AS signature FROM defs JOIN part ON p_partkey = name::BIGINT),
j AS (SELECT r.path, r.name, score, line, format('{{:5d}}: {{}}', line, signature) AS shown FROM ranked r JOIN s ON r.path = s.path AND r.name = s.name),
c AS (SELECT *, greatest(1, length(shown || chr(10)) // 4) + CASE WHEN row_number() OVER (PARTITION BY path ORDER BY score DESC, name) = 1 THEN greatest(1, length(chr(10) || path || ':' || chr(10)) // 4) ELSE 0 END AS cost FROM j),
u AS (SELECT *, sum(cost) OVER (ORDER BY score DESC, path, name ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM c)
SELECT path, name, line, shown, score, round(sum(score) OVER (PARTITION BY path), 6) AS file_score, used FROM u WHERE used <= {BUDGET}""")
def repo_map(spark, sf):
    d = A.line_definitions(spark, sf)
    p = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("name"), F.col("p_partkey").cast("int").alias("line"), F.concat(F.lit("part "), "p_name").alias("signature"))
    return rankmap.select(_ranked(spark, sf), d.join(p, "name"), BUDGET).withColumn("file_score", F.round("file_score", 6))


# --- search ---


def _posted(spark, sf):
    s = A.doc_symbols(spark, sf)
    docs = written(search.documents(s), "search-documents")
    return s, search.bm25(search.posted(docs, set(search.query_tokens(SEARCH))), *search.size_of(docs), SEARCH)


_BM25 = f"{D.SYMBOLS}, {D.bm25(search.query_tokens(SEARCH), 50)}"


@query(f"WITH {_BM25} SELECT path, line, name, score FROM hits")
def bm25_search(spark, sf):
    return _posted(spark, sf)[1]


_QUERY = "(SELECT embedding FROM embeddings WHERE vec_id = 7)"
_NEAREST = f"near AS (SELECT {D.PATH} AS path, 1 AS line, round(list_inner_product(e.embedding::DOUBLE[], {_QUERY}::DOUBLE[]), 6) AS score FROM documents JOIN embeddings e ON doc_id = vec_id ORDER BY score DESC, path LIMIT 50)"


def _near(spark, sf):
    asked = table(spark, sf, "embeddings").where("vec_id = 7").select("embedding").first()[0]
    return search.nearest(A.symbol_vectors(spark, sf), asked)


@query(f"WITH {_NEAREST} SELECT path, line, score FROM near")
def vector_search(spark, sf):
    return _near(spark, sf)


_FUSED = """fused AS (
    SELECT path, line, round(sum(part), 6) AS score FROM (
        SELECT path, line, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, path, line)) AS part FROM hits
        UNION ALL SELECT path, line, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, path, line)) FROM near)
    GROUP BY path, line ORDER BY score DESC, path, line LIMIT 50)"""


@query(f"WITH {_BM25}, {_NEAREST}, {_FUSED} SELECT path, line, score FROM fused")
def rrf_hybrid(spark, sf):
    return search.fuse([_posted(spark, sf)[1], _near(spark, sf)])


@query(f"""WITH {_BM25}, d AS (
    SELECT h.path, h.line, s.name, s.kind, s.signature, round(h.score * CASE WHEN {D.test_path('h.path')} THEN 0.6 ELSE 1.0 END, 6) AS score
    FROM hits h JOIN symbols s ON h.path = s.path AND h.line = s.line)
SELECT path, line, score, name, kind, signature FROM d QUALIFY row_number() OVER (PARTITION BY name, kind, signature ORDER BY score DESC, path, line) = 1 ORDER BY score DESC, path, line LIMIT 10""")
def search_polish(spark, sf):
    s, hits = _posted(spark, sf)
    return search.polish(hits, s)


@query(f"WITH {D.SYMBOLS} SELECT path, line, name FROM symbols WHERE (path, line) NOT IN (SELECT ({D.PATH}, 1) FROM documents JOIN embeddings ON doc_id = vec_id)")
def vectors_missing(spark, sf):
    return search.missing_vectors(A.doc_symbols(spark, sf), A.symbol_vectors(spark, sf)).select("path", "line", "name")


# --- impact ---

_CHANGED = f"changed AS (SELECT {D.PATH} AS path FROM documents WHERE doc_id % 97 = 0)"
_USES = f"""{D.SYMBOLS}, {D.IDENTS}, {_CHANGED},
uses AS (SELECT * FROM idents WHERE name IN (SELECT name FROM symbols WHERE path IN (SELECT path FROM changed)) AND path NOT IN (SELECT path FROM changed))"""
_DEPENDENTS = """ranked AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY count DESC, name) AS rank FROM uses{where})
SELECT path, sum(count)::BIGINT AS total, string_agg(CASE WHEN rank <= 4 THEN name || ' (' || count || 'x)' END, ', ' ORDER BY rank) AS used FROM ranked GROUP BY path"""


def _corpus(spark, sf):
    changed = table(spark, sf, "documents").where("doc_id % 97 = 0").select(A.doc_path().alias("path"))
    return changed, A.doc_symbols(spark, sf), A.doc_idents(spark, sf)


@query(f"WITH {_USES}, {_DEPENDENTS.format(where='')}")
def impact_dependents(spark, sf):
    return impact.dependents(*_corpus(spark, sf))


@query(f"WITH {_USES}, {_DEPENDENTS.format(where=f' WHERE {D.test_path("path")}')}")
def impact_tests_only(spark, sf):
    return impact.dependents(*_corpus(spark, sf), tests_only=True)


_LISTED = f"""{_USES}, t AS (SELECT name, sum(count)::BIGINT AS uses FROM uses GROUP BY name),
listed AS (
    SELECT path, line, name, signature, coalesce(uses, 0)::BIGINT AS uses, (row_number() OVER (PARTITION BY path ORDER BY coalesce(uses, 0) DESC, line, name))::INTEGER AS rank
    FROM symbols LEFT JOIN t USING (name) WHERE path IN (SELECT path FROM changed) QUALIFY rank <= 8)"""


@query(f"WITH {_LISTED} SELECT path, line, name, signature, uses, rank FROM listed")
def impact_symbols(spark, sf):
    return impact.changed_symbols(*_corpus(spark, sf))


@query(f"""WITH {_LISTED},
l AS (SELECT path, rank, format('{{:5d}}: {{}}', line, signature) || CASE WHEN uses > 0 THEN '   <- used by others ' || uses || 'x' ELSE '' END AS shown FROM listed),
u AS (SELECT *, sum(greatest(1, length(shown || chr(10)) // 4)) OVER (ORDER BY path, rank ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM l)
SELECT path, rank, shown, used FROM u WHERE used <= 1500""")
def impact_budget(spark, sf):
    return impact.within_budget(impact.changed_symbols(*_corpus(spark, sf)))


@query("SELECT DISTINCT 'user_' || user_id::VARCHAR AS path FROM events WHERE epoch(ts) >= epoch(TIMESTAMP '2024-01-30') - 24 * 3600")
def changed_since(spark, sf):
    seen = table(spark, sf, "events").select(F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("path"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    now = 1706572800.0  # 2024-01-30
    return impact.changed_since(seen.select("path", (F.col("us") / 1e6).alias("mtime")), now, 24.0).distinct()


# --- telemetry and health ---


def _log(spark, sf):
    e = table(spark, sf, "events")
    args = F.to_json(F.struct(F.col("user_id").cast("string").alias("query")))
    ts = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return e.select(ts.alias("ts"), F.col("event_type").alias("cmd"), args.alias("args"), F.coalesce(F.col("value"), F.lit(0.0)).cast("long").alias("size"), (F.col("event_type") == "error").alias("empty"))


_REPORT = "SELECT event_type AS cmd, count(*) AS calls, count(*) FILTER (event_type = 'error') AS empties FROM events GROUP BY event_type"


@query(_REPORT)
def telemetry_report(spark, sf):
    return telemetry.by_command(_log(spark, sf))


@query("SELECT user_id::VARCHAR AS query, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, query LIMIT 10")
def telemetry_top_queries(spark, sf):
    return telemetry.top_queries(_log(spark, sf))


@query(_REPORT)
def telemetry_stream(spark, sf):
    folder = scratch(spark, "telemetry-log")
    _log(spark, sf).write.json(folder)
    return stream.report(spark, folder)


@query(f"""WITH {D.SNAPS}, {D.VERIFIED}, {D.SYMBOLS}, c AS (
    SELECT 'stale' AS name, count(*) FILTER (status IN ('added', 'updated')) AS n, 'warn' AS level FROM changes
    UNION ALL SELECT 'removed', count(*) FILTER (status = 'removed'), 'warn' FROM changes
    UNION ALL SELECT 'index', (SELECT count(*) FROM old), 'none' UNION ALL SELECT 'symbols', (SELECT count(*) FROM symbols), 'none' UNION ALL SELECT 'vectors', (SELECT count(*) FROM embeddings), 'none'),
r AS (SELECT name, CASE WHEN level = 'warn' AND n > 0 THEN 'warn' ELSE 'ok' END AS status, n FROM c)
SELECT * FROM r UNION ALL SELECT 'overall', max_by(status, (status <> 'ok')::INT), count(*) FILTER (status <> 'ok') FROM r""")
def health_checks(spark, sf):
    old, new = A.snapshots(spark, sf)
    return health.checks(old, new, A.doc_symbols(spark, sf), table(spark, sf, "embeddings"))


def described() -> str:
    """Names of all queries and whether they have SQL, as JSON."""
    return json.dumps({k: k in ORACLES for k in QUERIES}, indent=1)
