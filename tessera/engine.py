"""An index of a source tree as versioned tables, and the questions that it answers.

An index is a folder with one subfolder of Parquet tables for each version and a file ``current`` that names
the version in force. An update writes a new version beside the old one and then moves the pointer, so a
reader never sees half an update and a failed one leaves the old version.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import sys
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schema as S
from tessera.functions import text as X
from tessera.operators import changes, extract, graph, health, impact, navigate, rankmap, search, telemetry
from tessera.sources import repo
from tessera.storage import written

VERSION = "2"
TABLES = {"files": S.FILES, "symbols": S.SYMBOLS, "idents": S.IDENTS, "postings": "path string, line int, name string, dl int, term string, tf long", "vectors": S.VECTORS}


def hashed_vector(words: list[str], size: int = 64) -> list[float]:
    """A unit vector of a bag of words: the encoder that needs no model."""
    out = [0.0] * size
    for w in words:
        h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
        out[h % size] += 1.0 if h >> 32 & 1 else -1.0
    norm = sum(x * x for x in out) ** 0.5
    return [x / norm for x in out] if norm else out


def encode_frames(frames):
    for f in frames:
        f["vector"] = [hashed_vector(list(w)) for w in f["words"]]
        yield f[["path", "line", "name", "vector"]]


class Engine:
    def __init__(self, spark: SparkSession, root: str, store: str | None = None):
        self.spark, self.root = spark, str(Path(root).resolve())
        self.store = Path(store or Path(self.root, ".tessera"))
        self.log_path = str(self.store / "querylog.jsonl")

    @property
    def log(self) -> telemetry.QueryLog:
        return telemetry.QueryLog(self.log_path)

    # --- tables ---

    def _meta(self) -> dict:
        try:
            return json.loads((self.store / "current").read_text())
        except (OSError, ValueError):
            return {}

    def table(self, name: str) -> DataFrame:
        meta = self._meta()
        if not meta:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(str(self.store / meta["version"] / name))

    def _publish(self, tables: dict[str, DataFrame], meta: dict) -> None:
        version, old = f"v{time.time_ns()}", self._meta().get("version")
        for name, df in tables.items():
            df.write.parquet(str(self.store / version / name))
        fresh = self.store / "current.new"
        fresh.write_text(json.dumps(meta | {"version": version}))
        os.replace(fresh, self.store / "current")
        for gone in self.store.glob("v[0-9]*"):  # the version before stays for those who still read it
            if gone.name not in (version, old):
                shutil.rmtree(gone, ignore_errors=True)

    # --- index ---

    def index(self, verify: bool = False, embed: bool = True) -> dict:
        """Brings the index up to date; the counts of what was done. Contents are read only for files whose time or size changed, unless ``verify``."""
        began = time.time()
        patterns, errors = repo.wiring(self.root, self.spark)
        wired, meta = hashlib.sha256(json.dumps(patterns).encode()).hexdigest(), self._meta()
        usable = meta.get("index") == VERSION and meta.get("wiring") == wired
        known = self.table("files") if usable else self.spark.createDataFrame([], S.FILES)
        seen = repo.scan(self.spark, self.root)
        same = F.broadcast(known.select("path", F.col("mtime").alias("m"), F.col("size").alias("s"))) if known.count() < 100_000 else known.select("path", F.col("mtime").alias("m"), F.col("size").alias("s"))
        listed = seen.select("path", "lang", "size", "mtime").join(same, "path", "left").withColumn("fast", F.lit(not verify) & (F.col("m") == F.col("mtime")) & (F.col("s") == F.col("size"))).cache()
        todo = [r.path for r in listed.where("not coalesce(fast, false)").select("path").limit(100_001).collect()]
        contents = seen.where(F.col("path").isin(*todo)) if len(todo) <= 1_000 else seen
        wanted = contents.join(listed.where("not coalesce(fast, false)").select("path"), "path", "left_semi")
        hashed = wanted.select("path", X.sha16(F.col("content")).alias("sha")).unionByName(listed.where("fast").join(known.select("path", "sha"), "path").select("path", "sha"))
        now = listed.join(hashed, "path").select("path", "sha", "mtime", "size", "lang").cache()
        what = changes.diff(known, now, verify).cache()
        count = {r.status: r["count"] for r in what.groupBy("status").count().collect()}
        fresh = wanted.join(what.where("status in ('added', 'updated')").select("path"), "path", "left_semi")
        gone = what.where("status in ('removed', 'updated')").select("path")
        dirty = not usable or any(count.get(s) for s in ("added", "updated", "removed", "touched"))
        result = {"scanned": sum(v for k, v in count.items() if k != "removed"), **{k: count.get(k, 0) for k in ("added", "updated", "removed")}, "unchanged": count.get("unchanged", 0) + count.get("touched", 0), "errors": errors}
        if dirty:
            symbols, idents = extract.extract(fresh.select("path", "lang", "content"), patterns)
            old = (lambda n: self.table(n)) if usable else (lambda n: self.spark.createDataFrame([], TABLES[n]))
            symbols = symbols.select(*(F.col(c).cast(t) for c, t in old("symbols").dtypes)).cache()
            posted = search.postings(symbols).select(*(F.col(c).cast(t) for c, t in old("postings").dtypes))
            every = changes.upsert(old("symbols"), symbols, gone)
            tables = {"files": now, "symbols": every, "idents": changes.upsert(old("idents"), idents, gone), "postings": changes.upsert(old("postings"), posted, gone), "vectors": self._embedded(every, old("vectors").join(gone, "path", "left_anti"), embed)}
            self._publish(tables, {"index": VERSION, "wiring": wired})
            symbols.unpersist()
        elif embed and not search.missing_vectors(self.table("symbols"), self.table("vectors")).isEmpty():
            same = {n: self.table(n) for n in TABLES if n != "vectors"}
            self._publish(same | {"vectors": self._embedded(self.table("symbols"), self.table("vectors"), True)}, {"index": VERSION, "wiring": wired})
        for df in (listed, now, what):
            df.unpersist()
        return result | {"seconds": round(time.time() - began, 3)}

    def _embedded(self, symbols: DataFrame, vectors: DataFrame, embed: bool) -> DataFrame:
        """``vectors``, and those of the symbols that lack one."""
        return vectors.unionByName(self._encode(search.missing_vectors(symbols, vectors))) if embed else vectors

    def _encode(self, symbols: DataFrame) -> DataFrame:
        words = symbols.select("path", "line", "name", X.symbol_doc(F.col("name"), F.col("kind"), F.col("signature"), F.col("path")).alias("words"))
        return words.mapInPandas(encode_frames, S.VECTORS)

    # --- questions ---

    def map(self, budget: int = S.MAP_BUDGET, focus=(), mentions=()) -> str:
        definitions = self.table("symbols").select("name", "path").distinct()
        references = self.table("idents")
        nodes = graph.graph_nodes(definitions, references)
        if nodes.isEmpty():
            return "(empty index)"
        inside = [r.node for r in nodes.where(F.col("node").isin(*focus)).collect()] if focus else []
        ranked = self._ranked(definitions, references, nodes, tuple(inside), tuple(mentions))
        return rankmap.render(rankmap.select(ranked, self.table("symbols"), budget, inside).collect())

    def _ranked(self, definitions, references, nodes, focus, mentions) -> DataFrame:
        """Ranks of definitions; those without focus or mentions are kept beside the version that they belong to."""
        meta, kept = self._meta(), None
        if not focus and not mentions:
            kept = str(self.store / meta["version"] / "ranks")
            if os.path.exists(f"{kept}/_SUCCESS"):
                return self.spark.read.schema("path string, name string, score double").parquet(kept)
        flow = written(graph.shares(definitions, graph.weighted_uses(definitions, references, mentions)), "shares")
        ranks = graph.definition_ranks(graph.pagerank(nodes, definitions, flow, focus), definitions, flow)
        if kept:
            ranks.write.mode("overwrite").parquet(kept)
            return self.spark.read.schema("path string, name string, score double").parquet(kept)
        return ranks

    def search(self, query: str, limit: int = 10, mode: str = "auto") -> list[dict]:
        symbols, vectors = self.table("symbols"), self.table("vectors")
        mode = search.mode_for(mode, not vectors.isEmpty())
        lists = []
        if mode in ("bm25", "hybrid"):
            postings = self.table("postings")
            lists.append(search.bm25(postings, *search.size_of(postings.select("path", "line", "name", "dl").distinct()), query))
        if mode in ("vector", "hybrid"):
            lists.append(search.nearest(vectors, hashed_vector(search.query_tokens(query))))
        hits = search.fuse(lists) if len(lists) > 1 else lists[0]
        return [r.asDict() for r in search.polish(hits, symbols, limit).collect()]

    def outline(self, path: str) -> list[dict]:
        return [r.asDict() for r in navigate.outline(self.table("symbols"), path).collect()]

    def defs(self, name: str) -> list[dict]:
        return [r.asDict() for r in navigate.defs(self.table("symbols"), name).collect()]

    def refs(self, name: str, limit: int | None = 20) -> dict:
        parts = navigate.qualified(name)
        own = self.defs(parts[-1]) if parts else []
        found = navigate.refs_elsewhere(self.table("idents"), self.table("symbols"), name).orderBy(F.desc("score"), "path")
        return {"defined": own, "referenced": [r.asDict() for r in (found.limit(limit) if limit else found).collect()], "confidence": "heuristic: by name, without types"}

    def slice(self, path: str, name: str) -> str:
        symbols = self.table("symbols").where(F.col("path") == path)
        if symbols.isEmpty():
            return f"(no symbols indexed for {path})"
        if symbols.where(F.col("name") == name).isEmpty():
            return f"(no symbol `{name}` in {path})"
        try:
            lines = Path(self.root, path).read_text(encoding="utf-8", errors="replace").splitlines()
        except OSError as e:
            return f"(cannot read {path}: {e})"
        rows = self.spark.createDataFrame([(path, i + 1, x) for i, x in enumerate(lines)], "path string, line int, content string")
        shown = symbols.where(F.col("name") == name).agg(F.sum(F.col("end_line") - F.col("line") + 1)).first()[0]
        out = navigate.slice_view(rows, symbols, name).orderBy("line", "part").collect()
        return "\n".join([f"{path}  (slice: {name} - {shown} of {len(lines)} lines shown)", *(r.shown for r in out)])

    def changed(self, files=(), hours: float = S.SINCE_HOURS) -> list[str]:
        """Paths as given, or what git says has changed, or files of the last hours."""
        known = self.table("files")
        if files:
            return list(files)
        if (names := repo.git_changes(self.root)) is not None:
            return [r.path for r in known.where(F.col("path").isin(*names)).select("path").orderBy("path").collect()] if names else []
        return [r.path for r in impact.changed_since(known, time.time(), hours).collect()]

    def impact(self, files=(), hours: float = S.SINCE_HOURS, budget: int = S.IMPACT_BUDGET, tests_only: bool = False) -> str:
        paths = self.changed(files, hours)
        if not paths:
            return "(no changed files detected)"
        changed = self.spark.createDataFrame([(p,) for p in paths], "path string").distinct()
        symbols, idents = self.table("symbols"), self.table("idents")
        only = " (tests only)" if tests_only else ""
        lines = ["note: by name, without types; uses by reflection or generated code are missed", f"Changed files ({len(paths)}){only}:"]
        listed = impact.changed_symbols(changed, symbols, idents).orderBy("path", "rank").collect()
        for p in paths:
            lines.append(f"\n{p}:")
            own = [r for r in listed if r.path == p]
            lines += [f"{r.line:5}: {r.signature}" + (f"   <- used by others {r.uses}x" if r.uses else "") for r in own] or ["      (no indexed symbols)"]
        found = impact.dependents(changed, symbols, idents, tests_only).orderBy(F.desc("total"), "path")
        total, top = found.count(), found.limit(max(1, budget)).collect()  # a line costs one token at least
        lines += [f"\nImpacted files ({total}){only}:", *(f"  {r.path} — uses {r.used}" for r in top)] if total else [f"\nImpacted files{only}: none (nothing references the changed symbols)"]
        out, used = [], 0
        for line in lines:
            used += max(1, (len(line) + 1) // 4)
            if used > budget:
                out.append("… (truncated by budget)")
                break
            out.append(line)
        return "\n".join(out) + "\n"

    def stats(self) -> dict:
        return {r.what: r.n for r in navigate.stats(self.table("files"), self.table("symbols"), self.table("idents")).collect()}

    def report(self) -> str:
        if not os.path.exists(self.log_path):
            return f"(no query log; set {telemetry.ENABLED}=1)"
        log = telemetry.read(self.spark, self.log_path)
        called, asked = telemetry.by_command(log).orderBy(F.desc("calls"), "cmd").collect(), telemetry.top_queries(log).collect()
        parts = ["Calls by command (without an answer):", *(f"- {r.cmd}: {r.calls} ({r.empties})" for r in called)]
        if asked:
            parts += ["Searched most:", *(f"- {r.query}: {r.n}" for r in asked)]
        return "\n".join(parts)

    def doctor(self) -> list[dict]:
        seen = repo.scan(self.spark, self.root).select("path", X.sha16(F.col("content")).alias("sha"), "mtime", "size")
        found = [r.asDict() for r in health.checks(self.table("files"), seen, self.table("symbols"), self.table("vectors")).collect()]
        patterns, errors = repo.wiring(self.root, self.spark)
        lacking = search.missing_vectors(self.table("symbols"), self.table("vectors")).count()
        ways = {lang: "ast" if lang == "python" else "tokens" if lang in extract.OWN_WAY else "regex-fallback" for lang in sorted(set(S.LANG_BY_EXT.values()))}
        by_git = repo.git_changes(self.root) is not None
        row = lambda name, status, n, *details: {"name": name, "status": status, "n": n, "details": list(details)}
        return [
            *(f | {"details": []} for f in found),
            row("python", "ok" if sys.version_info >= (3, 10) else "fail", sys.version_info[1], sys.version.split()[0]),
            # tokens and patterns stand in for a parser; this is how the library works without grammars, and no fault of an index
            row("languages", "ok", len(ways), *(f"{lang}: {way}" for lang, way in ways.items())),
            row("embeddings", "warn" if lacking else "ok", lacking, *(["symbols without a vector; index again"] if lacking else [])),
            row("ignore rules", "ok", len(rules := repo.ignore_patterns(self.root)), *rules),
            row("wiring", "warn" if errors else "ok", len(patterns), *errors),
            row("change detection", "ok", int(by_git), "git status" if by_git else f"mtime window {S.SINCE_HOURS:g}h"),
            row("rank cache", "ok", int(bool(self._meta()) and os.path.exists(self.store / self._meta()["version"] / "ranks" / "_SUCCESS"))),
        ]
