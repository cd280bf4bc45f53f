"""A store of token ids: one row for each entry, with its place in the stream that all of them make."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..plans.storage import cut

VERSION, WIDTH = 1, 4
#: Pre-tokenizing pattern that goes with the public byte-level vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def _ranks(vocabulary: str) -> dict[bytes, int]:
    with open(vocabulary, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f.read().splitlines() if x.strip())}


def encode_entries(entries: DataFrame, vocabulary: str) -> DataFrame:
    """``name, version, width, offset, n, ids`` of ``entries`` (name, text), in order of name.

    ``offset`` is the sum of all lengths before, found in two steps: within ranges of names, then over
    the ranges, so no task sees all entries.
    """
    shared = entries.sparkSession.sparkContext.broadcast(_ranks(vocabulary))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        bpe = tiktoken.Encoding("store", pat_str=PATTERN, mergeable_ranks=shared.value, special_tokens={})
        for f in frames:
            yield pd.DataFrame({"name": f["name"], "ids": [bpe.encode_ordinary(t or "") for t in f["text"]]})

    own = entries.select("name", F.col("text").cast("string").alias("text")).mapInPandas(run, "name string, ids array<int>").withColumn("n", F.size("ids").cast("long"))
    own = cut(own.orderBy("name").withColumn("m", F.monotonically_increasing_id()).withColumn("p", F.shiftright("m", 33)))
    prev = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = own.groupBy("p").agg(F.sum("n").alias("s")).withColumn("before", F.coalesce(F.sum("s").over(prev(Window.orderBy("p"))), F.lit(0)))
    inside = F.coalesce(F.sum("n").over(prev(Window.partitionBy("p").orderBy("m"))), F.lit(0))
    out = own.withColumn("inside", inside).join(F.broadcast(parts.select("p", "before")), "p")
    return out.select("name", F.lit(VERSION).alias("version"), F.lit(WIDTH).alias("width"), (F.col("before") + F.col("inside")).alias("offset"), "n", "ids")


def checked(store: DataFrame) -> DataFrame:
    """The store as it is, if its version, width and lengths fit and its entries leave no gap; else a ValueError."""
    w = Window.orderBy("offset", "n")
    ends = store.groupBy("offset").agg(F.max("n").alias("n")).withColumn("next", F.lead("offset").over(w))
    bad = store.agg(F.count(F.when((F.col("version") != VERSION) | (F.col("width") != WIDTH), 1)).alias("v"), F.count(F.when(F.col("n") != F.size("ids"), 1)).alias("n")).crossJoin(ends.agg(F.count(F.when(F.col("next") != F.col("offset") + F.col("n"), 1)).alias("g"), F.min("offset").alias("low"))).first()
    if bad["v"] or bad["n"] or bad["g"] or (bad["low"] or 0):
        raise ValueError(f"token store: {bad['v']} entries of another version or width, {bad['n']} of a wrong length, {bad['g']} gaps")
    return store


def decode_entries(store: DataFrame, vocabulary: str, names: list[str] | None = None) -> DataFrame:
    """``name, text`` of the entries, all or some."""
    shared = store.sparkSession.sparkContext.broadcast({i: t for t, i in _ranks(vocabulary).items()})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"name": f["name"], "text": [b"".join(map(shared.value.__getitem__, x)).decode("utf-8", "replace") for x in f["ids"]]})

    some = store if names is None else store.where(F.col("name").isin(*names))
    return some.select("name", "ids").mapInPandas(run, "name string, text string")


def not_round(entries: DataFrame, store: DataFrame, vocabulary: str) -> DataFrame:
    """``name``: entries that don't decode to their text, or are on one side only."""
    a, b = entries.select("name", F.coalesce("text", F.lit("")).alias("x")), decode_entries(store, vocabulary).select("name", F.col("text").alias("y"))
    return a.join(b, "name", "full").where(~F.col("x").eqNullSafe(F.col("y"))).select("name")
