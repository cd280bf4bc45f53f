"""What a code base provides and consumes, as it publishes it and as its peers read it."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, functions as F

from ..codemap import CodeMap

VERSION = 1
_POINT = "array<struct<key:string,transport:string,function:string,file:string,line:int,service:string>>"
_SCHEMA = f"schema int, name string, provides {_POINT}, consumes {_POINT}"
#: A published surface is small: longer texts are refused.
MOST_BYTES = 8 << 20


def surface(m: CodeMap, name: str, member: DataFrame | None = None) -> DataFrame:
    """One row, ``name, json``: annotated ends of a map, by key, file and line."""
    a = m.annotations.join(m.files.select("file_id", F.col("path").alias("file")), "file_id")
    own = member.groupBy("file_id").agg(F.min("service").alias("service")) if member is not None else m.spark.createDataFrame([], "file_id long, service string")
    p = a.join(own, "file_id", "left").select("boundary", F.struct("key", "file", "line", "transport", "function", "service").alias("e"))
    ends = lambda b: F.transform(F.sort_array(F.collect_list(F.when(F.col("boundary") == b, F.col("e")))), lambda e: F.struct(*[e[c].alias(c) for c in ("key", "transport", "function", "file", "line", "service")]))
    g = p.agg(ends("serves").alias("provides"), ends("calls").alias("consumes"))
    return g.select(F.lit(name).alias("name"), F.to_json(F.struct(F.lit(VERSION).alias("schema"), F.lit(name).alias("name"), "provides", "consumes")).alias("json"))


def read_surfaces(texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ends that peers provide and consume (peer, key, transport, function, file, line), and ``peer, error`` of those that can't be read.

    ``texts`` has ``peer, json``. Null or malformed texts, other schemas and texts over MOST_BYTES are
    errors of their peer and never fail the whole.
    """
    p = texts.select("peer", "json", F.from_json("json", _SCHEMA, {"mode": "PERMISSIVE"}).alias("s"))
    error = F.when(F.col("json").isNull(), "no surface").when(F.octet_length("json") > MOST_BYTES, "too long").when(F.col("s.schema").isNull(), "not a surface").when(F.col("s.schema") != VERSION, F.concat(F.lit("schema "), F.col("s.schema").cast("string"), F.lit(" is not read")))
    p = p.withColumn("error", error)
    ends = lambda side: p.where("error is null").select("peer", F.inline(F.col(f"s.{side}"))).select("peer", "key", "transport", "function", "file", "line")
    return ends("provides"), ends("consumes"), p.where("error is not null").select("peer", "error")


def bearer(value: str | None) -> str | None:
    """A token given as ``env:NAME``; anything else is refused, so that none is written in a configuration."""
    if value is None:
        return None
    if not value.startswith("env:"):
        raise ValueError("a token is given as env:NAME")
    return os.environ.get(value.removeprefix("env:"))
