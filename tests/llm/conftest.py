import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, `key` string, bucket int, score double, h string"

BASE = "the quick brown fox jumps over the lazy dog and runs away from the angry bear into the deep dark forest where nobody ever goes at night "
ROWS = [
    (1, BASE * 3, "src_a"), (2, BASE * 3, "src_a"), (2, BASE * 3, "src_a"), (3, None, "src_a"), (4, "", None), (5, " \t\n ", "src_b"),
    (6, "one two", "src_b"), (7, "One TWO", "src_b"), (None, "a row without id but with some words", "src_b"), (8, BASE * 3 + "tail", "src_c"),
    (9, "İstanbul ſtraße Σίσυφος été 12³ ½ naïve x   don't WE'LL \x1c\x85 日本語 😀", "src_c"), (10, "<|endoftext|> middle <|startoftext|>x", "src_c"),
    (11, "mail a.b@c.de, ip 10.0.0.1 card 4111 1111 1111 1111 call +49 (30) 1234-5678 IBAN DE89370400440532013000 x@y", "ß"),
    (12, "word " * 60_000, "src_a"), (13, "z" * 5_000, "src_d"), (14, "unique passage " + "".join(chr(97 + i * 7 % 26) for i in range(500)), None),
    (15, "another text " + "".join(chr(97 + i * 7 % 26) for i in range(500)), "src_e"), (16, "0", "zero"), (-3, "negative id", "src_e"),
]


@pytest.fixture(scope="session")
def messy(spark, tmp_path_factory):
    """(documents, folder, rows): nulls, empty and long texts, repeated rows, odd characters and columns whose names operators might use."""
    rows = [(d, t, "en", s, None if t is None else len(t), 1, "k", 2, 0.5, "h") for d, t, s in ROWS]
    folder = str(tmp_path_factory.mktemp("messy"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (6, 0, 1), (8, 1, 0), (9, 0, 0), (9, 1, 1), (13, 0, 1), (None, 1, 1), (14, 1, None), (15, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet"), folder, ROWS


@pytest.fixture(scope="session")
def nothing(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("nothing"))
    spark.createDataFrame([], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return folder
