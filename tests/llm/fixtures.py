"""Small tables with the cases every operator defines: nulls, empties, ties, repeats, long texts, clashing columns."""

import random

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or ["a", "b", None])[i % len(sources or [0, 0, 0])], None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words(rng, n, vocabulary=400):
    """Words of letters alone: digits are masked by some operators."""
    return " ".join("w" + str(rng.randrange(vocabulary)).translate(str.maketrans("0123456789", "abcdefghij")) for _ in range(n))


def odd_texts(seed=3):
    rng = random.Random(seed)
    base = [words(rng, 60) for _ in range(6)]
    near = [" ".join(x if i % 37 else "changed" for i, x in enumerate(t.split())) for t in base[:3]]
    return [None, "", "  \n\t ", "one", "one two three", *base, *near, base[0], base[0],
            words(rng, 9000), "é ü ß ñ 漢字  x \U0001f642", "line\n\nline\nline", "a b c d e " * 30, "x" * 5000]


def with_clashes(docs):
    """Columns named as the operators name their own."""
    names = ["size", "copies", "component_id", "score", "key", "n", "start", "_text", "_doc", "cls", "label", "id", "row", "host", "bin"]
    return docs.select("*", *(F.lit(f"own {c}").alias(c) for c in names))


def empty(docs):
    return docs.where("1 = 0")
