import pyarrow.parquet as pq
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, kept boolean, node string, _key long, _blob string, text_key int"
LONG = " ".join(f"word{i % 977} tail{i % 13}" for i in range(40_000))
PASSAGE = "the quick brown fox jumps over the lazy dog while nobody is looking at the old stone bridge"


def row(doc_id, text, lang="en"):
    return (doc_id, text, lang, None, None, 7, None, "x", 3, "b", 5)


ODD = [
    row(5, None), row(6, ""), row(7, " \t\n "), row(8, "!!! 123 ??"), row(None, "a row without a number"), row(None, None, None), row(9, "short"),
    row(10, "same same text of a few words only"), row(10, "same same text of a few words only"), row(11, "same  same\ttext of a few words only"),
    row(12, LONG), row(13, LONG + " and an end"), row(14, "prefix one " + PASSAGE), row(15, "other start " + PASSAGE + " other end"),
    row(16, "token = abcdef123 AKIA" + "Q" * 17 + " " + "0f" * 13 + " secret: x"), row(17, "ßÜ ñandú 你好 🙂 Ünïcödé ½ <|endoftext|> x"),
    row(18, "l1\nl2\nl3\nl4\nl1\nl2\nl3"), row(19, "x\nl2\nl3\nl4\ny"), row(20, "-" * 600), row(21, "-" * 400),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="session")
def odd_rows():
    return [(r[0], r[1]) for r in ODD]


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="session")
def document_rows(small):
    t = pq.read_table(f"{small}/documents.parquet")
    return list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist()))
