"""Quality rules whose cutoffs come from mergeable quantile sketches of each language and source.

A sketch is a log-linear histogram: an integer is rounded down to its six leading bits, and the
counts of equal values are added. Sketches merge by adding counts, in any order and with the same
result, and a quantile read from one is at most 1/32 below the exact one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut, fresh

#: As character classes of both engines' regular expressions.
SYMBOL_CLASS, CAPITAL_CLASS, SPACE_CLASS = r"[#$%&*|<>=_~^+@/\\{}\[\]!]", r"\p{Lu}", r"[ \t\n\r]"
#: Added to the length where characters are counted, so that one capital in a short text means little.
SMOOTH = 50
#: Sketches of fewer documents are merged: source into language, language into everything.
MIN_GROUP = 50
#: Fences lie this many spreads beyond the quartiles.
FENCE = 4
#: Thresholds are sent to all executors up to this many rows, else joined by shuffle.
BROADCAST_ROWS = 20_000


@dataclass(frozen=True)
class Rule:
    """A document fails below Q1 - FENCE * spread (``low``) or above Q3 + FENCE * spread.

    ``spread`` is Q3 - Q1, at least ``least``. With ``octaves`` the distance is taken in powers of two.
    """

    metric: str
    low: bool
    least: int
    octaves: bool = False


RULES = (Rule("symbols", False, 15), Rule("capitals", False, 30), Rule("variety", True, 60), Rule("words", True, 2, True), Rule("word_length", False, 20))


def with_metrics(df: DataFrame, text: Column, names: dict[str, str]) -> DataFrame:
    """``df`` with the integer measures of ``text`` under ``names``, most in thousandths; a null or blank text has words 0.

    ``variety`` is log(distinct words) / log(words), which hardly depends on the length of a text. Words
    and measures are each made by a generator of one row, through which the optimizer moves no filter,
    so that either is computed once.
    """
    (w,) = fresh(df, "_words")
    words = F.array_remove(F.split(F.lower(text), "[ \t\n\r]+"), "")
    chars = F.length(text) + SMOOTH
    n = F.coalesce(F.size(w), F.lit(0))
    none = F.greatest(n, F.lit(1))
    ink = F.length(text) - F.regexp_count(text, F.lit(SPACE_CLASS))
    per = lambda a, b: (a.cast("long") * 1000 - (a.cast("long") * 1000) % b.cast("long")) / b.cast("long")
    own = {
        "words": n.cast("long"),
        "symbols": per(F.regexp_count(text, F.lit(SYMBOL_CLASS)), chars).cast("long"),
        "capitals": per(F.regexp_count(text, F.lit(CAPITAL_CLASS)), chars).cast("long"),
        "variety": F.when(n < 2, F.lit(1000)).otherwise(F.floor(F.log(F.size(F.array_distinct(w)).cast("double")) / F.log(n.cast("double")) * 1000.0 + 0.5)).cast("long"),
        "word_length": ((ink.cast("long") * 10 - (ink.cast("long") * 10) % none.cast("long")) / none.cast("long")).cast("long"),
    }
    split = df.select("*", F.explode(F.array(F.coalesce(words, F.array().cast("array<string>")))).alias(w))
    return split.select("*", F.inline(F.array(F.struct(*[own[k].alias(c) for k, c in names.items()])))).drop(w)


def sketch_value(v: Column) -> Column:
    """``v`` rounded down to its six leading bits."""
    return v - v % F.pow(F.lit(2.0), F.greatest(F.length(F.bin(v)) - 6, F.lit(0))).cast("long")


def sketches(rows: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """``keys, metric, value, n``: the sketch of each metric of each group."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), sketch_value(F.col(m)).alias("value")) for m in names])
    long = rows.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.*")
    return long.groupBy(*keys, "metric", "value").agg(F.count(F.lit(1)).alias("n"))


def merge(sketch: DataFrame, keys: list[str]) -> DataFrame:
    return sketch.groupBy(*keys, "metric", "value").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, metric, total, q1, q3``."""
    w = Window.partitionBy(*keys, "metric")
    c = sketch.withColumn("upto", F.sum("n").over(w.orderBy("value"))).withColumn("total", F.sum("n").over(w))
    at = lambda p: F.min(F.when(F.col("upto") * 100 >= F.col("total") * p, F.col("value")))
    return c.groupBy(*keys, "metric").agg(F.max("total").alias("total"), at(25).alias("q1"), at(75).alias("q3"))


def thresholds(rows: DataFrame, min_group: int = MIN_GROUP, fence: int = FENCE) -> DataFrame:
    """``lang, source`` and a cutoff ``t_<metric>`` for each rule, from ``rows`` with the metrics.

    Documents without words take no part.
    """
    names = [r.metric for r in RULES]
    own = cut(sketches(rows.where("words > 0"), ["lang", "source"], names))
    by_lang = merge(own, ["lang"])
    q = quantiles(own, ["lang", "source"])
    ql = quantiles(by_lang, ["lang"]).select(F.col("lang").alias("l"), F.col("metric").alias("m"), F.col("total").alias("lt"), F.col("q1").alias("l1"), F.col("q3").alias("l3"))
    qa = quantiles(merge(by_lang, []), []).select(F.col("metric").alias("am"), F.col("q1").alias("a1"), F.col("q3").alias("a3"))
    j = q.join(ql, F.col("lang").eqNullSafe(F.col("l")) & (F.col("metric") == F.col("m"))).join(F.broadcast(qa), F.col("metric") == F.col("am"))
    pick = lambda a, b, c: F.when(F.col("total") >= min_group, F.col(a)).when(F.col("lt") >= min_group, F.col(b)).otherwise(F.col(c))
    j = j.select("lang", "source", "metric", pick("q1", "l1", "a1").alias("q1"), pick("q3", "l3", "a3").alias("q3"))
    cols = []
    for r in RULES:
        if r.octaves:  # bit lengths stand for the binary logarithm
            bits = lambda c: F.length(F.bin(F.col(c)))
            spread = F.greatest(bits("q3") - bits("q1"), F.lit(r.least))
            t = F.pow(F.lit(2.0), F.greatest(bits("q1") - 1 - fence * spread, F.lit(0))).cast("long")
        else:
            spread = F.greatest(F.col("q3") - F.col("q1"), F.lit(r.least))
            t = F.col("q1") - fence * spread if r.low else F.col("q3") + fence * spread
        cols.append(F.max(F.when(F.col("metric") == r.metric, t)).alias(f"t_{r.metric}"))
    return j.groupBy("lang", "source").agg(*cols)


def quality_filter(docs: DataFrame, min_group: int = MIN_GROUP, fence: int = FENCE, keep_metrics: bool = False) -> DataFrame:
    """The rows of ``docs`` that pass every rule, all columns unchanged.

    Cutoffs follow each (lang, source); null languages and sources are groups of their own. A quartile
    of a few documents says little, so a group of under ``min_group`` is judged by the cutoffs of its
    language, one of a language of under ``min_group`` by those of everything. Null, empty and blank
    texts are rejected; very long ones are measured whole. Values that tie with a cutoff pass.
    Repeated rows each count and are each kept or rejected. An empty table gives an empty one.
    ``keep_metrics`` adds the measures as ``words, symbols, ...``, with underscores where ``docs`` has
    such a column.
    """
    given = docs.select("lang", "source", F.col("text").cast("string").alias("text"))
    rows = with_metrics(given, F.col("text"), {r.metric: r.metric for r in RULES}).drop("text")
    t = cut(thresholds(rows, min_group, fence))
    names = fresh(docs, "_l", "_s", *[f"_t_{r.metric}" for r in RULES], *[f"_m_{r.metric}" for r in RULES])
    kl, ks, tc, mc = names[0], names[1], names[2 : 2 + len(RULES)], names[2 + len(RULES) :]
    small = t.select(F.col("lang").alias(kl), F.col("source").alias(ks), *[F.col(f"t_{r.metric}").alias(c) for r, c in zip(RULES, tc, strict=True)])
    if t.count() <= BROADCAST_ROWS:
        small = F.broadcast(small)
    measured = with_metrics(docs, F.col("text").cast("string"), {r.metric: c for r, c in zip(RULES, mc, strict=True)}).where(F.col(mc[[r.metric for r in RULES].index("words")]) > 0)
    joined = measured.join(small, F.col("lang").eqNullSafe(F.col(kl)) & F.col("source").eqNullSafe(F.col(ks)))
    for r, tcol, mcol in zip(RULES, tc, mc, strict=True):
        joined = joined.where(F.col(mcol) >= F.col(tcol) if r.low else F.col(mcol) <= F.col(tcol))
    extra = [F.col(c).alias(name) for c, name in zip(mc, fresh(docs, *[r.metric for r in RULES]), strict=True)] if keep_metrics else []
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], *extra)


def _sql() -> str:
    """The same in DuckDB."""
    m = f"""
m0 as (select doc_id, lang, source, text, list_filter(string_split_regex(lower(text), '[ \\t\\n\\r]+'), lambda w: w <> '') as ws from documents),
m as (select doc_id, lang, source, len(ws)::bigint as words,
  ((length(text) - length(regexp_replace(text, '{SYMBOL_CLASS}', '', 'g'))) * 1000) // (length(text) + {SMOOTH}) as symbols,
  ((length(text) - length(regexp_replace(text, '{CAPITAL_CLASS}', '', 'g'))) * 1000) // (length(text) + {SMOOTH}) as capitals,
  case when len(ws) < 2 then 1000 else floor(ln(len(list_distinct(ws))::double) / ln(len(ws)::double) * 1000.0 + 0.5) end::bigint as variety,
  (length(regexp_replace(text, '{SPACE_CLASS}', '', 'g')) * 10) // greatest(len(ws), 1) as word_length
  from m0 where len(ws) > 0)"""
    parts = " union all ".join(f"select lang, source, '{r.metric}' as metric, {r.metric} as v from m" for r in RULES)
    t = []
    for r in RULES:
        if r.octaves:
            e = f"(2 ** greatest(length(bin(q1)) - 1 - {FENCE} * greatest(length(bin(q3)) - length(bin(q1)), {r.least}), 0))::bigint"
        else:
            e = f"{'q1 -' if r.low else 'q3 +'} {FENCE} * greatest(q3 - q1, {r.least})"
        t.append(f"max(case when metric = '{r.metric}' then {e} end) as t_{r.metric}")
    quant = lambda keys, src: f"""select {keys}metric, max(total) as total, min(case when upto * 100 >= total * 25 then value end) as q1, min(case when upto * 100 >= total * 75 then value end) as q3
  from (select *, sum(n) over (partition by {keys}metric order by value) as upto, sum(n) over (partition by {keys}metric) as total from {src}) group by {keys}metric"""  # noqa: E731
    ok = " and ".join(f"m.{r.metric} {'>=' if r.low else '<='} t_{r.metric}" for r in RULES)
    return f"""with {m},
long as ({parts}),
sk as (select lang, source, metric, v - v % (2 ** greatest(length(bin(v)) - 6, 0))::bigint as value, count(*) as n from long group by all),
skl as (select lang, metric, value, sum(n) as n from sk group by all),
ska as (select metric, value, sum(n) as n from skl group by all),
q as ({quant("lang, source, ", "sk")}),
ql as ({quant("lang, ", "skl")}),
qa as ({quant("", "ska")}),
p as (select q.lang, q.source, q.metric,
  case when q.total >= {MIN_GROUP} then q.q1 when ql.total >= {MIN_GROUP} then ql.q1 else qa.q1 end as q1,
  case when q.total >= {MIN_GROUP} then q.q3 when ql.total >= {MIN_GROUP} then ql.q3 else qa.q3 end as q3
  from q join ql on q.lang is not distinct from ql.lang and q.metric = ql.metric join qa on q.metric = qa.metric),
t as (select lang, source, {", ".join(t)} from p group by lang, source)
select m.doc_id, m.lang, m.source, {", ".join(f"m.{r.metric}::bigint as {r.metric}" for r in RULES)}
from m join t on m.lang is not distinct from t.lang and m.source is not distinct from t.source where {ok}"""


SQL = _sql()
