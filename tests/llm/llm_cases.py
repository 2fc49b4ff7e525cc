"""Tables with the odd rows every operator has to stand, and plain Python ways to the results."""

import re

from pyspark.sql import functions as F

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return SPACE_WORD.findall((text or "").translate(LOWER))


BASE = " ".join(f"wort{i % 37} and the line{i} of text{i * 7 % 101}" for i in range(60))
LONG = " ".join(f"tok{i * i % 977}" for i in range(30_000))

ODD = [
    (1, BASE), (1, BASE),                       # a repeated row
    (2, BASE + " tail"), (3, None), (4, ""), (5, " \t\n\x0b\f\r "), (None, None), (None, BASE),
    (6, "short one"), (6, "other text under the same id"), (7, "short one"),
    (8, "Ünï cödé ▁ 漢字 \U0001f600 \u0085x" * 5), (9, LONG), (10, "\n\n\n"),
    (11, "a" * 700), (12, "x\ny\nx\n" * 40), (13, BASE.upper()),
]


def odd_documents(spark):
    """``documents`` with odd rows, and columns named like those the operators make."""
    df = spark.createDataFrame(
        [(i, t, None if i is None else f"src{i % 3}", None if t is None else len(t))
         for i, t in ODD],
        "doc_id bigint, text string, source string, n_chars bigint")
    return df.select("doc_id", "text", F.lit("en").alias("lang"), "source", "n_chars",
                     *[F.lit(7).alias(c) for c in (
                         "score", "kept", "row", "node", "key", "digest", "_line", "_drop",
                         "t1", "label", "held_out", "ids", "chunk")])


def no_documents(spark):
    return odd_documents(spark).where("false")
