"""Operators on small inputs."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import braces, changes, ends, extract, navigate, rankmap, search
from tessera.sources import repo


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


def test_functions(spark):
    for name, parts in (("fooBarBaz", ["foo", "bar", "baz"]), ("HTTPServer", ["http", "server"]), ("snake_case_name", ["snake", "case", "name"]), ("v2Parser", ["v2", "parser"])):
        assert one(spark, X.split_ident(F.col("n")), n=name) == parts
    words = one(spark, X.tokenize(F.col("t")), t="def compute_total(items): return sum")
    assert {"compute_total", "compute", "total"} <= set(words) and not {"def", "return"} & set(words)
    assert [one(spark, X.is_well_named(F.col("n")), n=n) for n in ("compute_totals", "computeTotals", "main", "CONSTANT")] == [True, True, False, False]
    assert [one(spark, X.is_test_path(F.col("p")), p=p) for p in ("tests/a.py", "a/test_x.py", "x_test.py", "src/a.py", "tests")] == [True, True, True, False, False]
    assert [one(spark, X.token_estimate(F.col("t")), t=t) for t in ("", "abcd" * 3)] == [1, 3]
    assert one(spark, X.language(F.col("p")), p="a/B.TSX") == "tsx" and one(spark, X.language(F.col("p")), p="a/b") is None
    assert search.query_tokens("fooBar the def") == ["foobar", "foo", "bar", "the"] and search.query_tokens("a b") == ["a", "b"]


def test_extract(spark):
    files = spark.createDataFrame([("a", "\nclass Foo:\n    pass\n\ndef bar():\n    pass\n")], "path string, text string")
    got = [(r.name, r.kind, r.line, r.signature) for r in extract.regex_symbols(files).orderBy("line").collect()]
    assert got == [("Foo", "class", 2, "class Foo:"), ("bar", "function", 5, "def bar():")]
    files = spark.createDataFrame([("a", "alpha beta alpha if class gamma_delta")], "path string, text string")
    assert {r.name: r["count"] for r in extract.lexical_idents(files).collect()} == {"alpha": 2, "beta": 1, "gamma_delta": 1}
    symbols, refs = extract.parse_python("@deco\nclass A(Parent):\n    def m(self, request):\n        return helper_func(self.start_engine())\n")
    assert [s[:3] for s in symbols] == [("A", "class", 2), ("m", "function", 3)]
    assert refs == {"deco": 1, "Parent": 1, "helper_func": 1, "start_engine": 1}
    assert extract.parse_python("def (") is None
    generated = spark.createDataFrame([(bytearray(b"x" * 1001),), (bytearray(b"x\n" * 1001),)], "content binary")
    assert [r[0] for r in generated.select(extract.looks_generated(F.col("content"))).collect()] == [True, False]


def test_ignored(spark):
    paths = ["Plugins/a.cs", "src/x.gen.cs", "vendor/deep/a.js", "src/a.cs", "Plugins2/a.cs"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    hit = repo.ignored(F.col("path"), ["Plugins/", "*.gen.cs", "vendor/*.js"])
    assert [r[0] for r in df.select(hit).collect()] == [True, True, True, False, False]


def test_wiring():
    assert repo.wiring_from_text('{"patterns": [{"regex": "a(b)"}, {"regex": "("}, {"regex": "ab"}, 1]}')[0] == ["a(b)"]
    assert [len(repo.wiring_from_text(t)[1]) for t in ("{", "[]", "{}", '{"patterns": [1, {"regex": "("}]}')] == [1, 1, 1, 2]


def test_upsert_and_stamp(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "path string, v int")
    got = changes.upsert(rows(("a", 1), ("b", 1), ("c", 1)), rows(("b", 2), ("d", 2)), rows(("c", 0)).select("path"))
    assert {tuple(r) for r in got.collect()} == {("a", 1), ("b", 2), ("d", 2)}
    files = lambda *x: spark.createDataFrame(list(x), "path string, sha string")
    stamps = [changes.state_stamp(f).first()[0] for f in (files(("a", "1"), ("b", "2")), files(("b", "2"), ("a", "1")), files(("a", "2"), ("b", "1")))]
    assert stamps[0] == stamps[1] != stamps[2]


def test_slice_hides_what_is_within_a_shown_target(spark):
    rows = [("f", "A", "class", 1, 9, "class A", 0), ("f", "m", "function", 2, 3, "def m", 1), ("f", "z", "function", 10, 11, "def z", 2)]
    symbols = spark.createDataFrame(rows, "path string, name string, kind string, line int, end_line int, signature string, seq int")
    assert [(r.name, r.target) for r in navigate.covering(symbols, "A").orderBy("line").collect()] == [("A", True), ("z", False)]
    assert [(r.name, r.target) for r in navigate.covering(symbols, "m").orderBy("line").collect()] == [("A", False), ("m", True), ("z", False)]


@pytest.mark.parametrize("budget", [0, 5, 12, 40, 1000])
def test_map_keeps_the_budget(spark, budget):
    ranked = spark.createDataFrame([(f"p{i % 3}", f"n{i}", 1.0 / (i + 1)) for i in range(20)], "path string, name string, score double")
    symbols = spark.createDataFrame([(f"p{i % 3}", f"n{i}", i % 7, f"def n{i}()") for i in range(20) for _ in range(2)], "path string, name string, line int, signature string")
    got = rankmap.select(ranked, symbols, budget).orderBy("used").collect()
    used, seen, files, expected = 0, set(), set(), []
    for i in range(20):
        p, line = f"p{i % 3}", i % 7
        if (p, line) in seen:
            continue
        cost = max(1, len(f"{line:5}: def n{i}()\n") // 4) + (0 if p in files else max(1, len(f"\n{p}:\n") // 4))
        if used + cost > budget:
            break
        used += cost
        seen.add((p, line))
        files.add(p)
        expected.append((f"n{i}", used))
    assert [(r.name, r.used) for r in got] == expected


def test_fusion_and_polish(spark):
    hits = lambda *x: spark.createDataFrame(list(x), "path string, line int, score double")
    got = search.fuse([hits(("a", 1, 3.0), ("b", 1, 2.0)), hits(("c", 1, 3.0), ("b", 1, 1.0))]).collect()
    assert [r.path for r in got] == ["b", "a", "c"]
    symbols = spark.createDataFrame([("tests/a", 1, "n", "f", "s"), ("src/a", 1, "n", "f", "s")], "path string, line int, name string, kind string, signature string")
    assert [(r.path, r.score) for r in search.polish(hits(("tests/a", 1, 2.0), ("src/a", 1, 1.5)), symbols).collect()] == [("src/a", 1.5)]
    with pytest.raises(ValueError):
        search.polish(hits(), symbols, 0)


CSHARP = """public class GameManager : MonoBehaviour {
    [SerializeField] private HealthBar healthBar;
    public int Score { get; set; }
    public GameManager(Config config) { }
    void Start() {
        var spawner = new EnemySpawner();
        spawner.SpawnWave(3);
        Utils.Log("EnemySpawner inside a string");
    }
}
public interface IDamageable { }
public enum GamePhase { Menu, Play }
"""
TYPESCRIPT = """import { fetchUser } from './api';
export interface UserProfile { id: number; }
type ProfileMap = Record<string, UserProfile>;
export class ProfileStore {
    private cache: ProfileMap = {};
    async loadProfile(id: number): Promise<UserProfile> {
        return fetchUser(id);
    }
}
const renderCard = (p: UserProfile) => p.id;
"""
GO = """package engine
type Engine struct{ fuel int }
type Starter interface{ Start() }
func NewEngine() *Engine { return &Engine{} }
func (e *Engine) Start() {
    prepareFuel(e)
}
func prepareFuel(e *Engine) {}
"""
JAVA = """public class Store extends Origin {
  public Store() { }
  @Override
  public List<Item> loadAll(Query query) throws IOException {
    return Helper.fetchItems(query, new Page<>());
  }
  abstract void stop();
}
"""
RUST = """#[derive(Debug)]
pub struct Point<'a> { x: &'a str }
impl<'a> Point<'a> {
  pub fn make(x: &'a str) -> Point<'a> { println!("}} {}", x); helper_call(x) }
}
trait Shape { fn area(&self) -> f64; }
"""
C = """#define M(x) {
typedef struct {
  int a;
} point_t;
struct node { struct node *next; };
int declared(int);
static int add_nodes(point_t *left, int b) {
  return compute_sum(left->a, b);
}
"""
CPP = """namespace n {
class Widget : public Origin { void draw() { render_it(); } };
void Widget::resize(int w) const {
  helper_fn(w);
}
}
"""
PHP = """<html>it's {</html><?php
class Circle implements Shape {
  public function area() { return 3; } # it's
}
function make_circle() { return new Circle(); }
?><p>{</p>"""
SCRIPT = """class A extends Origin {
  run(x) { return /[{'"]/.test(x); }
}
export default function start() { start_all(`a${1}`); }
const later = async function () {
  run_it();
};
"""


@pytest.mark.parametrize(("lang", "text", "symbols", "counted", "absent"), [
    ("csharp", CSHARP, {("GameManager", "class", 1, 10), ("Score", "method", 3, 3), ("GameManager", "method", 4, 4), ("Start", "method", 5, 9), ("IDamageable", "class", 11, 11), ("GamePhase", "type", 12, 12)},
     {"MonoBehaviour": 1, "SerializeField": 1, "EnemySpawner": 1, "SpawnWave": 1, "HealthBar": 1, "Config": 1}, ("healthBar", "spawner")),
    ("typescript", TYPESCRIPT, {("UserProfile", "type", 2, 2), ("ProfileMap", "type", 3, 3), ("ProfileStore", "class", 4, 9), ("loadProfile", "method", 6, 8), ("renderCard", "function", 10, 10)}, {"fetchUser": 2, "UserProfile": 4}, ("cache",)),
    ("go", GO, {("Engine", "type", 2, 2), ("Starter", "type", 3, 3), ("NewEngine", "function", 4, 4), ("Start", "method", 5, 7), ("prepareFuel", "function", 8, 8)}, {"prepareFuel": 1, "Engine": 5}, ("fuel", "Start")),
    ("java", JAVA, {("Store", "class", 1, 8), ("loadAll", "method", 3, 6), ("stop", "method", 7, 7)}, {"Origin": 1, "Item": 1, "Query": 1, "fetchItems": 1, "Page": 1}, ("Store", "query")),
    ("rust", RUST, {("Point", "type", 2, 2), ("make", "function", 4, 4), ("Shape", "type", 6, 6)}, {"println": 1, "helper_call": 1, "Point": 3}, ("derive", "area")),
    ("c", C, {("point_t", "type", 2, 4), ("node", "type", 5, 5), ("add_nodes", "function", 7, 9)}, {"point_t": 2, "compute_sum": 1}, ("left", "declared")),
    ("cpp", CPP, {("Widget", "class", 2, 2), ("resize", "method", 3, 5)}, {"render_it": 1, "helper_fn": 1}, ("resize", "draw")),
    ("php", PHP, {("Circle", "class", 2, 4), ("area", "method", 3, 3), ("make_circle", "function", 5, 5)}, None, ()),
    ("javascript", SCRIPT, {("A", "class", 1, 3), ("run", "method", 2, 2), ("start", "function", 4, 4), ("later", "function", 5, 7)}, {"Origin": 1, "start_all": 1, "run_it": 1, "test": 1}, ("later",)),
])
def test_languages_of_braces(lang, text, symbols, counted, absent):
    found, refs = braces.parse(lang, text)
    assert {s[:4] for s in found} == symbols
    if counted is None:
        assert refs is None
    else:
        assert {n: refs[n] for n in counted} == counted and not set(absent) & set(refs)


RUBY = """module Store
  class Item < Origin::Root
    attr_reader :name # don't
    def initialize(name)
      @name = "it's #{name}"
      return unless name
      x = if name then 1 else 2 end
    end
    def self.build(list)
      list.each do |row|
        while row do row.step_on end
        make_item(row) if row.valid?
      end
      text = run_sql(<<~SQL)
        select end
      SQL
    end
    def short(a) = compute_it(a)
    def name=(v)
      @name = v
    end
  end
end
"""


def test_ruby():
    found, refs = ends.parse(RUBY)
    assert [s[:4] for s in found] == [("Store", "class", 1, 23), ("Item", "class", 2, 22), ("initialize", "method", 4, 8), ("build", "method", 9, 17), ("short", "method", 18, 18), ("name", "method", 19, 21)]
    assert found[3][4] == "def self.build(list)"
    assert {n: refs[n] for n in ("Origin", "Root", "step_on", "make_item", "compute_it", "run_sql")} == dict.fromkeys(("Origin", "Root", "step_on", "make_item", "compute_it", "run_sql"), 1)
    assert "initialize" not in refs and "short" not in refs
    assert ends.parse("def x") is None and ends.parse("end") is None and ends.parse("") == ([], {})


def test_ruby_on_any_text():
    rng, pieces = random.Random(2), [*"(){}[];:,.=*&'\"`/#\n@", "<<~", " SQL", " x ", " Name ", " def ", " self.", "\n=begin", "\n=end", *sorted(ends.WORDS)]
    for n in range(4000):
        text = " ".join(rng.choice(pieces) for _ in range(n % 30))
        for k in range(3):
            got = ends.parse(text + " end" * k)
            assert got is None or all(1 <= a <= b <= text.count("\n") + 1 for _, _, a, b, _ in got[0])


def test_languages_of_braces_on_any_text():
    rng, pieces = random.Random(1), list("(){}[]<>;:,.=*&'\"`/#!?\n@") + ["=>", "::", " x ", " Name ", " é ", "*/", "/*", "//", "<?php "] + sorted(braces.WORDS)
    for lang in braces.INTRODUCES:
        assert braces.parse(lang, "{") is None or lang == "php"
        assert braces.parse(lang, "")[0] == []
        for n in range(1500):
            text = " ".join(rng.choice(pieces) for _ in range(n % 40))
            for t in (text, text + "}" * text.count("{")):
                got = braces.parse(lang, t)
                assert got is None or all(1 <= a <= b <= t.count("\n") + 1 for _, _, a, b, _ in got[0])


def test_extract_takes_each_language_its_way(spark):
    rows = [("a.cs", "csharp", CSHARP), ("b.php", "php", PHP), ("c.go", "go", "func open_it() {\n"), ("d.lua", "lua", "local x = compute_stuff(1)"), ("e.py", "python", "def f_one(): pass")]
    files = spark.createDataFrame([(p, lang, t.encode()) for p, lang, t in rows] + [("f.go", "go", None)], "path string, lang string, content binary")
    symbols, idents = extract.extract(files)
    got = {(r.path, r.name, r.kind) for r in symbols.collect()}
    assert {("a.cs", "Score", "method"), ("b.php", "area", "method"), ("c.go", "open_it", "function"), ("e.py", "f_one", "function")} <= got
    refs = {(r.path, r.name): r["count"] for r in idents.collect()}
    assert refs["a.cs", "HealthBar"] == 1 and ("a.cs", "healthBar") not in refs
    assert refs["b.php", "Circle"] == 2 and refs["c.go", "open_it"] == 1 and refs["d.lua", "compute_stuff"] == 1


def test_lexical_fallback(spark):
    files = spark.createDataFrame([("x.lua", "local x = compute_stuff(1)")], "path string, text string")
    assert "compute_stuff" in {r.name for r in extract.lexical_idents(files).collect()}


def test_telemetry_log(spark, tmp_path, monkeypatch):
    from tessera.operators import telemetry

    path = str(tmp_path / "log" / "q.jsonl")
    log = telemetry.QueryLog(path)
    assert not log.record("search", {"query": "x"}, "(no results)") and not (tmp_path / "log").exists()
    monkeypatch.setenv(telemetry.ENABLED, "1")
    assert log.record("search", {"query": "x"}, "(no results)") and log.record("defs", {"name": "y"}, "defined in: z")
    assert not telemetry.QueryLog("/proc/none/q.jsonl").record("defs", {}, "")
    with open(path, "a") as f:
        f.write("broken\n")
    log = telemetry.read(spark, path)
    assert {(r.cmd, r.calls, r.empties) for r in telemetry.by_command(log).collect()} == {("search", 1, 1), ("defs", 1, 0)}
    assert [(r["query"], r.n) for r in telemetry.top_queries(log).collect()] == [("x", 1)]


def test_words_of_plain_and_other_identifiers(spark):
    """The short way for words of one part gives what the long way gives."""
    import re

    from pyspark.sql import functions as F

    from tessera.functions import text as X
    from tessera.schema import IDENT, STOPWORDS, SUBTOKEN

    texts = ["The quick brownFox", "HTTPServer getHTTPResponse2 ABC Abc aBC _lead trail_ a_b snake_case_name x2y Z9 word99Word", "ABCdef Abc1 A1 ALLCAPS all1caps9 __init__ import returnValue", ""]

    def plainly(t):
        out = []
        for i in re.findall(IDENT, t):
            if i.lower() not in STOPWORDS:
                parts = [p.lower() for p in re.findall(SUBTOKEN, i)]
                out += [i.lower()] + ([p for p in parts if len(p) > 1 and p not in STOPWORDS] if len(parts) > 1 else [])
        return out

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", X.tokenize(F.col("t")).alias("w")).collect()
    assert {r.i: r.w for r in rows} == {i: plainly(t) for i, t in enumerate(texts)}


def test_patterns_that_only_python_compiles_are_refused(spark, tmp_path):
    import json

    from tessera.sources import repo

    (tmp_path / ".tessera").mkdir()
    (tmp_path / ".tessera" / "wiring.json").write_text(json.dumps({"patterns": [{"regex": r"Bind<(?P<n>\w+)>"}, {"regex": r"Bind<(\w+)>"}]}))
    good, errors = repo.wiring(str(tmp_path), spark)
    assert good == [r"Bind<(\w+)>"] and len(errors) == 1
