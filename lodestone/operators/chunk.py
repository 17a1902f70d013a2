"""Hierarchical chunks: overlapping parent windows of tokens, overlapping child windows inside each kept parent."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import tokens
from ..functions.text import is_clean, marks, summed, surely_clean
from ..ship import ship
from .lineage import dealt, let

PARENT, PARENT_OVERLAP, CHILD, CHILD_OVERLAP = 768, 96, 256, 48


def _step(size: int, overlap: int) -> int:
    return size - overlap if size > overlap else size


def subwords(spark, tokenizer_file: str) -> tuple[Callable[[Column], Column], Callable[[Column], Column]]:
    """Cutting into a tokenizer file's subwords, and joining them to text again, both in Arrow batches (for `chunks`)."""
    ship(spark)

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(tokenizer_file)
        return pd.Series([e.tokens for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)])

    @F.pandas_udf("string")
    def joined(parts: pd.Series) -> pd.Series:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(tokenizer_file)
        return pd.Series([t.decode([t.token_to_id(x) for x in p]) for p in parts])

    return cut, joined


def parents(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = PARENT, overlap: int = PARENT_OVERLAP, cut: Callable[[Column], Column] = tokens) -> DataFrame:
    """key, p_start, p_tokens: windows at each step; short ones at the end too. Documents without tokens have none."""
    t = docs.select(F.col(key), cut(F.col(text)).alias("t")).filter(F.size("t") > 0)
    return t.select(key, F.explode(_windows(F.col("t"), size, _step(size, overlap), 1, None)).alias("x")).select(key, F.col("x.at").alias("p_start"), F.col("x.w").alias("p_tokens"))


def _windows(parts: Column, size: int, step: int, unit: int, blocks: Column | None) -> Column:
    """Array of (at, w, b): the windows of a row's tokens, each with its blocks of `unit` tokens."""
    cut = lambda p: F.struct(p.alias("at"), F.slice(parts, p + 1, size).alias("w"), (F.lit(None) if blocks is None else F.slice(blocks, F.floor(p / unit).cast("int") + 1, size // unit)).alias("b"))
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1, F.lit(step)), cut)


def chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", parent: tuple[int, int] = (PARENT, PARENT_OVERLAP), child: tuple[int, int] = (CHILD, CHILD_OVERLAP), min_words: int = 20, cut: Callable[[Column], Column] = tokens, joined: Callable[[Column], Column] | None = None) -> DataFrame:
    """key, chunk_index, chunk_type, parent_index, start, token_count, content of all clean chunks, in order: parent, its children.

    Children stop after the first clean one that reaches its parent's end; unclean ones don't stop them. Texts are dealt by
    key once, to a fixed number of tasks, before windows multiply them; both window functions then find their rows in place. Tokens are white-space
    ones unless `cut` and `joined` (see `subwords`) say otherwise.

    What makes white-space windows unclean is counted once, in blocks of as many tokens as divide every window and step; a
    window's counts are sums of its blocks'. Only a window that these leave open is read as text. Other tokens may be joined
    without spaces, so their windows are always read.
    """
    units, joined = (cut is tokens and joined is None), joined or (lambda c: F.array_join(c, " "))
    unit = math.gcd(parent[0], _step(*parent), child[0], _step(*child))
    read = lambda w: let(joined(w), lambda c: is_clean(c, min_words))

    def clean(w: Column, b: Column) -> Column:
        if not units:
            return read(w)
        sure = let(summed(b), lambda s: surely_clean(s, F.size(w), min_words))
        return let(sure, lambda s: F.when(s.isNull(), read(w)).otherwise(s))

    staged = dealt(docs.select(key, text), key).select(F.col(key), cut(F.col(text)).alias("t")).filter(F.size("t") > 0)
    if units:
        staged = staged.withColumn("m", marks(F.col("t"), unit))
    rows = staged.select(key, F.explode(_windows(F.col("t"), parent[0], _step(*parent), unit, F.col("m") if units else None)).alias("x"))
    rows = rows.select(key, F.col("x.at").alias("p_start"), F.col("x.w").alias("w"), F.col("x.b").alias("b")).filter(clean(F.col("w"), F.col("b")))
    # A parent stands before its children as the window at -1, so that neither is worked out twice.
    itself = F.array(F.struct(F.lit(-1).alias("at"), F.col("w"), F.col("b")))
    kids = _windows(F.col("w"), child[0], _step(*child), unit, F.col("b") if units else None)
    rows = rows.select(key, "p_start", F.size("w").alias("n"), F.explode(F.concat(itself, kids)).alias("x"))
    rows = rows.select(key, "p_start", "n", F.col("x.at").alias("c"), F.col("x.w").alias("w"), F.col("x.b").alias("b")).filter((F.col("c") < 0) | clean(F.col("w"), F.col("b")))
    rows = rows.select(key, "p_start", "n", "c", F.size("w").alias("token_count"), joined(F.col("w")).alias("content"))
    # Both window functions go by one sort.
    earlier = Window.partitionBy(key, "p_start").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    is_child = F.col("c") >= 0
    rows = rows.withColumn("done", F.max(is_child & (F.col("c") + child[0] >= F.col("n"))).over(earlier)).filter(~F.coalesce("done", F.lit(False)))
    order = Window.partitionBy(key).orderBy("p_start", "c")
    rows = rows.withColumn("chunk_index", F.row_number().over(order) - 1)
    head = F.max(F.when(~is_child, F.col("chunk_index"))).over(order)
    return rows.select(key, "chunk_index", F.when(is_child, "child").otherwise("parent").alias("chunk_type"), F.when(is_child, head).alias("parent_index"), (F.col("p_start") + F.greatest("c", F.lit(0))).alias("start"), "token_count", "content")
