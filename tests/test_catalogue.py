"""Every query with SQL against that SQL, on the smallest tables."""

import duckdb
import pytest

from tessera import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(rows):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_rows(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.select(*sorted(df.columns)).collect()]
    out = duck.execute(catalogue.ORACLES[name])
    names = [d[0] for d in out.description]
    order = [names.index(n) for n in sorted(names)]
    assert sorted(names) == sorted(df.columns)
    assert plain(got) == plain(tuple(r[i] for i in order) for r in out.fetchall())


def test_generated_filter_has_every_document(spark, tmp_path):
    """As brute force says of the first 64 KiB, whatever the length of the text."""
    short, late = "ab\n" * 30_000, "é\n" * 21_845
    texts = [None, "", "x" * 1_000, "x" * 1_001, "é" * 501, short, "x" * 1_001 + "\n" + short, short + "x" * 2_000, late + "x" * 2_000, short[:64_535] + "\n" + "x" * 5_000, short[:64_534] + "\n" + "x" * 5_000, "x" * 200_000]
    docs = [(i, t, "en", "s") for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {int(r.path.rsplit("_", 1)[1].removesuffix(".txt")): r.generated for r in catalogue.generated_filter(spark, str(tmp_path)).collect()}
    brute = lambda t: None if t is None else any(len(x) > 1_000 for x in t.encode()[:65_536].split(b"\n"))
    assert got == {i: brute(t) for i, t in enumerate(texts)}
    assert [got[i] for i in (7, 8, 9, 10, 11)] == [False, False, False, True, True]


def test_generated_filter_reads_whole_texts(spark, tmp_path):
    """Lines beyond 64 KiB count, and the SQL has the same rows, those of long and of missing texts too."""
    short, late = "ab\n" * 30_000, "é\n" * 21_845
    texts = [None, "", "x" * 1_001, short, short + "x" * 1_000, short + "x" * 1_001, late + "é" * 501 + "\n" + short, "x" * 200_000]
    docs = [(i, t, "en", "s") for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = [tuple(r) for r in catalogue.generated_filter(spark, str(tmp_path)).collect()]
    assert {int(p.rsplit("_", 1)[1].removesuffix(".txt")): g for p, g in rows} == {0: None, 1: False, 2: True, 3: False, 4: False, 5: True, 6: True, 7: True}
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        assert plain(c.execute(catalogue.ORACLES["generated_filter"]).fetchall()) == plain(rows)


def test_counts_within_documents(spark, tmp_path):
    """Documents of one path and of none are added up, others are counted without a shuffle."""
    docs = [(i, t, "en", "s") for i, t in enumerate([None, "", "The the\nthe ing\nthe ab\nZed the", "import the\nfoo_bar foo_bar foo_bar"])]
    again = [(2, "the Zed\nother", "en", "s"), (7, "the null", None, "s"), (8, "the null", None, "s"), (9, "null", None, "s")]
    for name, rows in (("once", docs), ("again", docs + again)):
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = catalogue.lexical_idents(spark, f"{tmp_path}/{name}")
        assert ("Exchange hashpartitioning" in got._jdf.queryExecution().executedPlan().toString()) == (name == "again")
        with duckdb.connect() as c:
            c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/{name}/documents.parquet/*.parquet'")
            for query in ("lexical_idents", "referenced_defined", "ambient_cutoff"):
                df = catalogue.QUERIES[query](spark, f"{tmp_path}/{name}")
                assert plain(map(tuple, df.collect())) == plain(c.execute(f"SELECT {', '.join(df.columns)} FROM ({catalogue.ORACLES[query]})").fetchall())
