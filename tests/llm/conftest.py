import pytest
from pyspark.sql import types as T

from hrefloom.llm.common import Stages

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that the operators use themselves
    T.StructField("score", T.StringType()), T.StructField("kept", T.StringType()), T.StructField("copies", T.StringType()),
    T.StructField("node", T.StringType()), T.StructField("row_key", T.StringType()), T.StructField("spans", T.StringType()),
])


def prose(seed: int, n: int) -> str:
    """Words without repeats nearby, the same for the same seed."""
    syllables = ["ba", "ke", "li", "mo", "nu", "ra", "se", "ti", "vo", "zu"]
    words = []
    for k in range(n):
        x = (seed * 7919 + k * 104729 + k * k * 31) % 100_000
        words.append("".join(syllables[int(d)] for d in str(x)))
    return " ".join(words)


def rows() -> list[tuple]:
    base = prose(1, 120)
    near = " ".join(base.split()[:118] + ["other", "end"])
    texts = [
        (1, base, "src0"), (2, base, "src0"), (3, near, "src1"), (4, prose(2, 90), "src1"), (5, "", "src2"), (6, None, "src2"),
        (7, " \t\n ", None), (8, "one", "src2"), (9, "mail a.b@mail.example.com or +1 (203) 555-8282 now", "src0"),
        (10, "the " * 200, "src3"), (11, "Released under the MIT License.\n" + prose(3, 60), None),
        (None, prose(4, 70), "src1"), (None, None, None), (4, prose(2, 90), "src1"), (4, prose(2, 90), "src1"),
        (12, "| " * 80 + prose(5, 30), "src0"), (13, "x" * 5000, "src0"), (14, "é漢字 　 ½ 😀\r\n" * 30, "src4"), (15, prose(6, 6000), "src0"),
    ]
    return [(i, t, "en", s, None if t is None else len(t), "s", "k", "c", "n", "r", "p") for i, t, s in texts]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture()
def stages(spark):
    return Stages(spark, "test")
