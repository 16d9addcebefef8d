"""Small tables with the odd rows that every operator must take."""

import random

from pyspark.sql import DataFrame, SparkSession

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names the operators use themselves.
CLASHES = ("n_words", "kept", "score", "node", "words", "buckets", "hit_words", "secrets", "mix", "size", "copies", "target",
           "copy", "measures", "bad_host", "key", "label", "text_a", "found", "taken", "id")


def prose(seed: int, words: int) -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randint(2, 8))) for _ in range(words))


def odd_rows() -> list[tuple]:
    long_text = prose(1, 30_000)
    rows = [
        (1, prose(2, 60), "en", "a"), (2, prose(2, 60), "en", "a"), (3, None, "en", "a"), (4, "", "en", None),
        (5, " \n\t ", None, "b"), (6, "one", "en", "b"), (7, long_text, "en", "b"), (8, prose(3, 40), "de", "c"),
        (8, prose(3, 40), "de", "c"), (9, "Größe \U0001f600 " * 30, "de", "c"), (None, prose(4, 50), "en", "c"),
        (10, "x " * 400, "en", "c"), (11, "line one is here\n" * 40, "fr", "a"),
    ]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]


def odd_docs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(odd_rows(), DOCS)


def no_docs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], DOCS)


def with_clashes(docs: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F
    return docs.withColumns({name: F.lit(name) for name in CLASHES})
