"""Mixing sources to target weights by systematic sampling.

Each document is worth an expected number of copies; within its source these are summed up in id
order, one offset per source is added, and the document is emitted once for every whole number that
the sum crosses at it. Any run of documents thus gets its expected number of copies to within one.
Sums are kept in millionths as integers, so that they do not depend on the order of addition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut, fresh

UNIT = 1_000_000
#: Copies of a row made in one step.
STEP = 1000
#: Binary digits of an id that one level of the prefix sum covers: blocks of so many ids, blocks of so many blocks and so on.
DIGITS = 12
#: Blocks of so few rows are summed up in one window for each source.
FEW = 100_000
BROADCAST_ROWS = 20_000


def source_offset(source: Column, seed: int = 0) -> Column:
    """A number in [0, UNIT) for each source, from an MD5 of seed and name."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("")))), 1, 12), 16, 10).cast("long") % UNIT


def rates(docs: DataFrame, weights: dict[str, float] | None = None, other: float = 1.0, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``source, chars, rate``: millionths of copies expected of each document of a source.

    The corpus keeps its size in characters. A source has the weight that ``weights`` names, else
    ``other``, and gets that share of the weights of all sources there are, however often its documents
    must be repeated for it. A source without a character can reach no share; its documents are
    emitted once each if it has a weight.
    """
    size = docs.groupBy(F.col(source_col).cast("string").alias("source")).agg(F.coalesce(F.sum(F.length(text_col).cast("long")), F.lit(0).cast("long")).alias("chars"))
    named = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))])[F.coalesce("source", F.lit(""))] if weights else F.lit(None).cast("double")
    size = size.withColumn("weight", F.coalesce(named, F.lit(float(other))))
    every = Window.partitionBy()
    share = F.col("weight") / F.sum(F.when(F.col("chars") > 0, F.col("weight"))).over(every)
    want = F.sum("chars").over(every).cast("double") * share / F.greatest(F.col("chars"), F.lit(1)).cast("double") * float(UNIT)
    return size.select("source", "chars", F.when(F.col("weight") <= 0, F.lit(0)).when(F.col("chars") > 0, F.floor(want)).otherwise(F.lit(UNIT)).cast("long").alias("rate"))


def _rows_before(blocks: DataFrame, s: str, b: str, n: str, shift: int = DIGITS) -> DataFrame:
    """``s, b, n``: how many rows of its source come before each block.

    Many blocks are summed up within blocks of 2**DIGITS blocks, those in the same way, so that no
    window is wider than that, however the ids lie.
    """
    blocks = cut(blocks)
    if shift >= 60 or blocks.count() <= FEW:
        w = Window.partitionBy(s).orderBy(b)
        return blocks.select(s, b, F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(n))
    up = F.shiftright(F.col(b), DIGITS)
    above = _rows_before(blocks.groupBy(s, up.alias(b)).agg(F.sum(n).alias(n)), s, b, n, shift + DIGITS)
    u, before = fresh(blocks, "_up", "_above")
    w = Window.partitionBy(s, u).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    own = blocks.withColumn(u, up).join(above.withColumnsRenamed({b: u, n: before}), [s, u])
    return own.select(s, b, (F.col(before) + F.coalesce(F.sum(n).over(w), F.lit(0))).alias(n))


def whole(x: Column) -> Column:
    """Whole units in ``x`` millionths, without floating point."""
    return F.floor((x - x % UNIT).cast("decimal(38,0)") / UNIT).cast("long")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, seed: int = 0, copy_col: str | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", other: float = 1.0) -> DataFrame:
    """``docs`` with each row emitted as often as the sampling says, all columns unchanged.

    Rows are ordered by id, rows of one id by a hash of the text, which also stands in for an id that
    is null; equal rows are interchangeable. Null sources are a source of their own, whose weight is
    that of "". Null and empty texts count no characters but are sampled at their source's rate; very
    long ones count whole. An empty table gives an empty one. ``copy_col`` adds the number of the copy,
    from 1, with underscores where ``docs`` has such a column.

    The sum has levels: blocks of ids are added up (a narrow table), then the rows of a block; a hot
    source is spread over its blocks, and ids may lie as far apart as they like.
    """
    s, b, h, before, r, at, upto, n, key_id = fresh(docs, "_source", "_block", "_hash", "_before", "_rate", "_off", "_upto", "_n", "_id")
    rank = F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text_col))
    block = F.shiftright(rank, DIGITS)
    rate = cut(rates(docs, weights, other, source_col, text_col))
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    named = F.col(source_col).isNotNull()
    blocks = docs.groupBy(F.struct(named.alias("named"), source.alias("name")).alias(s), block.alias(b)).agg(F.count(F.lit(1)).alias(n))
    key = F.struct(F.col("source").isNotNull().alias("named"), F.coalesce("source", F.lit("")).alias("name")).alias(s)
    small = rate.select(key, F.col("rate").alias(r), source_offset(F.col("source"), seed).alias(at))
    if rate.count() <= BROADCAST_ROWS:
        small = F.broadcast(small)
    sums = _rows_before(blocks, s, b, n).join(small, s).select(s, b, r, (F.col(at) + F.col(n) * F.col(r)).alias(before))
    keyed = docs.withColumns({s: F.struct(named.alias("named"), source.alias("name")), b: block, key_id: rank, h: F.xxhash64(text_col)})
    w = Window.partitionBy(s, b).orderBy(key_id, h)
    ranked = keyed.join(sums, [s, b]).withColumn(n, F.row_number().over(w).cast("long"))
    upto_c = F.col(before) + F.col(n) * F.col(r)
    copies = whole(upto_c) - whole(upto_c - F.col(r))
    out = ranked.withColumn(upto, copies).where(F.col(upto) > 0)
    # in two steps, as one row may have millions of copies
    out = out.withColumn(before, F.explode(F.sequence(F.lit(0).cast("long"), F.col(upto) - 1, F.lit(STEP).cast("long"))))
    out = out.withColumn(upto, F.explode(F.sequence(F.col(before) + 1, F.least(F.col(before) + STEP, F.col(upto)))))
    extra = [F.col(upto).alias(*fresh(docs, copy_col))] if copy_col else []
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], *extra)


#: Weights of the registered query and of the pipeline: the large crawl and two smaller sources count more than the rest, of weight 1 each.
WEIGHTS = {"src0": 4.0, "src1": 2.0, "src2": 2.0}

SQL = f"""with size as (select source, coalesce(sum(length(text)), 0)::bigint as chars, case source {" ".join(f"when '{k}' then {v}::double" for k, v in WEIGHTS.items())} else 1::double end as weight from documents group by source),
rate as (select source, case when chars > 0 then floor((sum(chars) over ())::double * (weight / (sum(case when chars > 0 then weight end) over ())) / chars::double * {UNIT}.0) else {UNIT} end::bigint as rate,
  (('0x' || substr(md5('0:' || coalesce(source, '')), 1, 12))::bigint % {UNIT}) as off from size),
run as (select d.*, rate, off + sum(rate) over (partition by d.source order by doc_id rows unbounded preceding) as upto from documents d join rate r on d.source is not distinct from r.source),
n as (select *, (upto::bigint // {UNIT} - (upto - rate)::bigint // {UNIT}) as k from run)
select doc_id, text, lang, source, n_chars, unnest(range(1, k + 1))::bigint as copy from n where k > 0"""
