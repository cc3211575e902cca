import random

import pytest
from pyspark.sql import types as T

WORDS = [a + b for a in "ba de fi go lu ma ne po ri sa".split() for b in "ka lo mi nu ro te va xi zo pe".split()]
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # Names that the operators use themselves.
    *[T.StructField(n, T.StringType()) for n in ("row", "size", "kept", "fp", "copies", "group", "n_words", "host")],
])


def sentence(draw, n):
    return " ".join(draw.choice(WORDS) for _ in range(n))


def make_rows():
    """Copies, near copies, repeated lines and passages, nulls, empty and long texts, equal rows."""
    draw = random.Random(7)
    texts = [sentence(draw, draw.randint(5, 120)) + "\n" + sentence(draw, 30) for _ in range(60)]
    passage = sentence(draw, 120)
    for i in range(0, 20, 2):
        texts[i] += "\n" + passage + " " + sentence(draw, 5)
    line = sentence(draw, 25)
    for i in range(1, 30, 3):
        words = line.split()
        words[draw.randrange(25)] = draw.choice(WORDS)
        texts[i] += "\n" + " ".join(words) + "\n" + line
    texts += [texts[3]] * 25 + [texts[4] + " " + w for w in WORDS[:25]]
    texts += [None, "", "   \n\t ", "a", "ab cd " * 900, "x" * 3000, sentence(draw, 9000), "été ÀB c d\n" * 12]
    texts += ["mail me at a.b@mail.example.com%z@y.org or +1 (555) 010-9999, ip 10.0.0.255 10.0.0.256 card 4111 1111-1111 1111!"]
    rows = [(i, t, None if i % 11 == 0 else f"s{i % 5 if i % 3 else 0}", len(t or "")) + tuple("clash!ab") for i, t in enumerate(texts)]
    return rows + [rows[5]] * 2 + [(None, texts[6], None, 1, *"clash!ab")]


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    """The fixture as a stored table, as the operators that read it twice want it."""
    path = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def no_docs(docs, spark):
    return spark.createDataFrame([], SCHEMA)
