"""Chunks of documents: folds over arrays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import citation_density

#: Density threshold, and sentences below it that close the section.
THRESHOLD, GAP = 25.0, 3


def merged_paragraphs(sizes: Column, least: int) -> Column:
    """Chunk number (from 0) of each paragraph: a paragraph opens a new chunk when the current one has
    `least` tokens or more; empty paragraphs are dropped beforehand."""
    start = F.struct(F.lit(0).alias("chunk"), F.lit(0).cast("long").alias("size"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, n: Column) -> Column:
        new = acc["size"] >= least
        chunk = acc["chunk"] + F.when(new, 1).otherwise(0)
        return F.struct(chunk.alias("chunk"), (F.when(new, F.lit(0)).otherwise(acc["size"]) + n.cast("long")).cast("long").alias("size"), F.concat(acc["out"], F.array(chunk)).alias("out"))

    return F.aggregate(sizes, start, step)["out"]


def paragraph_chunks(paragraphs: DataFrame, least: int, sizes: str = "sizes", *keys: str) -> DataFrame:
    """keys, chunk, paragraphs, tokens per chunk of rows with an array of paragraph sizes."""
    kept = F.filter(F.col(sizes), lambda n: n > 0)
    rows = paragraphs.select(*keys, kept.alias("kept"), merged_paragraphs(kept, least).alias("chunks"))
    pairs = rows.select(*keys, F.explode(F.arrays_zip("chunks", "kept")).alias("p"))
    return pairs.groupBy(*keys, F.col("p.chunks").cast("long").alias("chunk")).agg(F.count(F.lit(1)).alias("paragraphs"), F.sum("p.kept").cast("long").alias("tokens"))


def citation_section(sentences: Column, threshold: float = THRESHOLD, gap: int = GAP) -> Column:
    """(first, last) sentence (from 0) of the first dense section, nulls if there is none.  It opens at the
    first sentence at or above the threshold and closes after `gap` sentences below it in a row."""
    none = F.lit(None).cast("int")
    start = F.struct(F.lit(0).alias("i"), none.alias("first"), none.alias("last"), F.lit(0).alias("below"), F.lit(False).alias("closed"))

    def step(acc: Column, s: Column) -> Column:
        dense = (citation_density(s) >= threshold) & ~acc["closed"]
        opened = acc["first"].isNotNull()
        below = F.when(dense, 0).when(opened & ~acc["closed"], acc["below"] + 1).otherwise(acc["below"])
        return F.struct(
            (acc["i"] + 1).alias("i"), F.when(~opened & dense, acc["i"]).otherwise(acc["first"]).alias("first"),
            F.when(dense, acc["i"]).otherwise(acc["last"]).alias("last"), below.alias("below"), (acc["closed"] | (opened & (below >= gap))).alias("closed"),
        )

    done = F.aggregate(sentences, start, step)
    return F.struct(done["first"].cast("long").alias("first"), done["last"].cast("long").alias("last"))


def merged_sentences(sizes: Column, closes: Column, least: int) -> Column:
    """Chunk number of each sentence: a boundary stands behind a sentence that closes (ends with its mark)
    once the chunk has `least` tokens."""
    start = F.struct(F.lit(0).alias("chunk"), F.lit(0).cast("long").alias("size"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        size = acc["size"] + x["n"].cast("long")
        done = (size >= least) & x["c"]
        return F.struct((acc["chunk"] + F.when(done, 1).otherwise(0)).alias("chunk"), F.when(done, F.lit(0)).otherwise(size).cast("long").alias("size"), F.concat(acc["out"], F.array(acc["chunk"])).alias("out"))

    return F.aggregate(F.zip_with(sizes, closes, lambda n, c: F.struct(n.alias("n"), c.alias("c"))), start, step)["out"]


def missing_from(docs: DataFrame, cached: DataFrame, *keys: str) -> DataFrame:
    """What a cache of chunks lacks: compute only this."""
    return docs.join(cached.select(*keys).distinct(), list(keys), "left_anti")
