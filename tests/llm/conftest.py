import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = [a + b for a in ("ba", "ke", "li", "mo", "nu", "pra", "sto", "tu") for b in ("", "n", "r", "ston", "lix", "ma")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, text, edits):
    ws = text.split(" ")
    for _ in range(edits):
        ws[rng.randrange(len(ws))] = "edit" + str(rng.randrange(10**6))
    return " ".join(ws)


def corpus():
    """Rows with every odd case: nulls in each column, empty, blank and long texts, copies, near copies, repeated rows."""
    rng = random.Random(7)
    base = [prose(rng, 120) for _ in range(12)]
    passage = prose(rng, 60)
    texts = base + [base[0], base[0], edited(rng, base[1], 2), edited(rng, base[2], 1), base[3] + " tail here", None, "", "  \n\t ", "one", "one two three", "a b c d e f g h i j"]
    texts += [prose(rng, 40) + "\n" + passage + "\n" + prose(rng, 30) for _ in range(4)] + [prose(rng, 6000), "x" * 5000, "spam spam " * 100, "é ñ 漢字  two  spaces\u00a0nbsp\u2003em \U0001F600 <s>"]
    rows = [(i, t, ("en", "fr", None)[i % 3], f"s{i % 2}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, "a text without any id at all, said here once more", "en", "s0", 40)]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    from pyspark.sql import functions as F

    # columns whose names operators use themselves
    df = spark.createDataFrame(corpus(), SCHEMA).repartition(3)
    return df.withColumn("n_words", F.lit(1)).withColumn("score", F.lit("x")).withColumn("bucket", F.lit(2)).withColumn("node", F.lit(3)).withColumn("kept", F.lit(False))


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
