"""Rows that the operators must stand: nulls, empty and very long texts, repeated rows, clashing extra columns."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label string, score double, key string, root long"


def sentence(rng, n):
    syllables = "an the or in be lo mi ra tu sen da kor vel os ti un".split()
    return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(n))


def rows(seed=1, n=40):
    rng = random.Random(seed)
    texts = [sentence(rng, rng.randint(1, 120)) for _ in range(n)]
    texts += [None, "", "   ", "\n", texts[0], texts[0], texts[1] + " extra", "one", "ÉA é ß İ 🙂 日本", sentence(rng, 6000), "the " * 3000, "x" * 50_000]
    out = [(i, t) for i, t in enumerate(texts)]
    return [*out, out[3], out[3], (None, "orphan words here"), (None, None)]


def frame(spark, pairs):
    full = [(i, t, "en", "s", None if t is None else len(t), "L", 0.5, "k", 7) for i, t in pairs]
    return spark.createDataFrame(full, SCHEMA)


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, pairs, toxic=lambda i, t: 0, quality=lambda i, t: 1):
    return spark.createDataFrame([(i, quality(i, t), toxic(i, t)) for i, t in pairs if i is not None], "doc_id long, quality int, toxic int")


def held_out(i):
    import zlib

    return i is None or zlib.crc32(str(i).encode()) % 5 == 0


__all__ = ["F", "empty", "frame", "held_out", "labels", "plain", "rows", "sentence"]
