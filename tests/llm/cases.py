"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing extra columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, digest string, size int, row int"
WORDS = "the river runs past the old mill and under seven stone bridges before it meets the wide green sea again".split()


def sentence(seed: int, n: int) -> str:
    return " ".join(WORDS[(seed * 7 + i * (seed % 5 + 1)) % len(WORDS)] + ("" if (i + seed) % 3 else str(i % 7)) for i in range(n))


def odd_documents(spark: SparkSession) -> DataFrame:
    """Ids may be null or repeated; the columns after n_chars clash with names the operators use inside."""
    long_text = sentence(3, 20_000)
    texts = [
        (1, sentence(1, 40)), (2, sentence(1, 40).upper()), (3, " " + sentence(1, 40).replace(" ", "\n ") + "\t"),
        (4, sentence(1, 39) + " end"), (5, None), (6, ""), (7, " \t\r\n\x0b\x0c "), (8, "two words"), (9, "Two  Words"),
        (10, long_text), (11, long_text + " x"), (None, sentence(2, 30)), (12, sentence(2, 30)), (12, sentence(2, 30)),
        (12, sentence(2, 30)), (None, None), (13, "ÀÉ Straße naïve 東京 ☃"), (14, "a\u00a0b\u2003c a\u00a0b\u2003c"),
        (15, "same same same same same same same"), (16, "same same same same same same"), (None, sentence(2, 30)),
        (17, "1 2 3 4 5 6"), (18, "x" * 50_000), (19, sentence(9, 60)), (20, sentence(9, 61)),
    ]
    rows = [
        (i, t, ["en", "de", None][n % 3], ["b", "a", None, "c"][n % 4], len(t) if t else None, "clash", "clash", 7, n)
        for n, (i, t) in enumerate(texts)
    ]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def no_documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], DOCS)


def plain(df: DataFrame) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
