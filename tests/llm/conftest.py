import random
import string

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType()),
                     # names that the operators use inside
                     T.StructField("row", T.StringType()), T.StructField("size", T.StringType()), T.StructField("kept", T.StringType()), T.StructField("n_words", T.StringType()),
                     T.StructField("_words", T.StringType()), T.StructField("node", T.StringType()), T.StructField("block", T.StringType()), T.StructField("bin", T.StringType())])


def odd_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows, copies that differ in case, near copies, shared passages."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices(string.ascii_lowercase + "éß", k=rng.randint(1, 9))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    passage = prose(60)
    texts = [None, "", "   \n\t ", "one", "One", "a b c d", "a b c d e", prose(30), prose(30), "x" * 150, "ab" * 3000, "tail\x1cof\x85odd spaces here " + prose(10)]
    base = prose(300)
    words = base.split()
    for k in (3, 100, 200):
        texts.append(" ".join([*words[:k], "changed", *words[k + 1:]]))
    texts += [base, base.upper(), base, passage + " " + prose(50), prose(40) + "\n" + passage, prose(20) + "\n" + passage + "\n" + passage, prose(9000), "line one two\n" * 30, "### Assistant: </turn> \\-"]
    rows = [(i, t, ["en", "de", None][i % 3], ["s1", "s2", None, "S"][i % 4], len(t or ""), "r", None, "k", "w", "_", "n", "b", "bin") for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], rows[15], (None, base, None, None, None) + (None,) * 8, (None, "alone here", "en", "s1", 3) + (None,) * 8, (-4, prose(12), "en", "s9", 1) + (None,) * 8]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
