"""Mixing sources to target weights by entropy balancing.

Each source has a token target. Among all document rates from 0 to ``most`` whose words add up to the targets,
the mix takes those of least relative entropy to one copy each: the exponentially tilted rates
``min(most, exp(lambda_source * size / mean size))``. Their convex dual has one multiplier a source; Newton steps,
kept inside a bracket that holds the root, solve all sources at once, every step one distributed aggregation of
first and second moments. As a rate depends on source and size alone, documents are first counted by source and
size, so an iteration reads a small table, whatever the copies.

Rates become whole copies: within a source, by descending size, the running sum of fractional copies is rounded,
so a source's error is at most half its largest document. Inside a cell of equal source and size the extra
copies are dealt over hash buckets, again by a rounded running sum, and inside a bucket by hash order; a hot cell
is thus split over ``BUCKETS`` tasks. Sums of moments are exact decimals and every order is total, so reruns agree.

Native: DataFrame functions only, no Python on rows.

Defined results: a null text has size 0; documents of size 0 take 0 words (one copy of nothing); a null source
is a source, ranked last; repeated rows count as documents of their own; a source without words has target 0; an
empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm._spark import materialize

BUCKETS = 256
_WS = r"\x20\x09-\x0D"


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text: each word becomes one letter, then white space goes."""
    return F.length(F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), rf"[^{_WS}]++", "x"), " \t\n\x0b\x0c\r", "")).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """Adds ``target`` to (source, source_size): shares of all words by repeating weights in source order, each at
    most ``most`` times the source's size, the excess reshared by weight.

    The level ``t`` in ``min(most * size, t * weight)`` is read off running sums in order of ``most * size / weight``.
    The windows are global, over one row a source.
    """
    rank = F.row_number().over(W.orderBy("source")) - 1
    ranked = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (rank % len(weights) + 1).cast("int")))
    cap = (F.col("source_size") * F.lit(float(most))).alias("cap")
    ranked = ranked.withColumn("cap", cap).withColumn("turn", F.col("cap") / F.col("weight"))
    order = W.orderBy("turn", "source")
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    level = (F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    found = ranked.withColumn("level", level)
    free = F.min(F.when(F.col("level") <= F.col("turn"), F.col("turn"))).over(W.partitionBy())
    found = found.withColumn("level", F.max(F.when(F.col("turn") == free, F.col("level"))).over(W.partitionBy()))
    return found.select("source", "source_size", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.col("cap")).alias("target"))


def _source_key(source: Column) -> Column:
    """A source as a string that is never null; the order is that of code points, null last."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("~"))


def _rate(most: float) -> Column:
    return F.least(F.lit(float(most)), F.exp(F.least(F.col("multiplier") * F.col("size") / F.col("mean"), F.lit(700.0))))


def multipliers(cells: DataFrame, goals: DataFrame, most: float, steps: int = 200, tolerance: float = 1e-9) -> DataFrame:
    """(source, source_size, target, mean, multiplier) by safeguarded Newton steps on the dual.

    A bracket is at least halved by a step that Newton's is not inside of, so ``steps`` is never reached in practice; if
    it is, that is an error, not a result.

    ``cells``: (source, size, n). The root lies between 0 and ln(target / size of the source) / (least size / mean).
    """
    words = cells.filter("size > 0")
    shape = words.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"), F.min("size").alias("least"))
    state = goals.join(shape, "source")
    edge = F.log(F.greatest(F.col("target"), F.lit(1e-300)) / F.col("source_size")) * F.col("mean") / F.col("least") * 1.000001
    state = state.withColumn("low", F.least(edge, F.lit(0.0))).withColumn("high", F.greatest(edge, F.lit(0.0)))
    state = state.withColumn("multiplier", F.when(F.col("target") >= F.col("source_size") * (most * (1 - 1e-12)), F.col("high")).otherwise(0.0))
    state = materialize(state.drop("least"))
    for _ in range(steps):
        at = words.join(state.select("source", "mean", "multiplier"), "source")
        rate = _rate(most)
        taken = F.col("n") * F.col("size") * rate
        slope = F.when(rate < most, taken * F.col("size") / F.col("mean")).otherwise(0.0)
        exact = lambda c: F.sum(c.cast("decimal(38,9)")).cast("double")
        sums = at.groupBy("source").agg(exact(taken).alias("g"), exact(slope).alias("dg"))
        step = F.col("multiplier") - F.try_divide(F.col("g") - F.col("target"), F.col("dg"))
        low = F.when(F.col("g") < F.col("target"), F.col("multiplier")).otherwise(F.col("low"))
        high = F.when(F.col("g") > F.col("target"), F.col("multiplier")).otherwise(F.col("high"))
        done = F.abs(F.col("g") - F.col("target")) <= tolerance * F.col("target")
        nxt = state.join(sums, "source").select(
            "source", "source_size", "target", "mean", low.alias("low"), high.alias("high"),
            F.when(done, F.col("multiplier")).when((F.col("dg") > 0) & (step > low) & (step < high), step).otherwise((low + high) / 2).alias("multiplier"),
            (done | (high - low <= F.lit(1e-14) * F.greatest(F.lit(1.0), F.abs(high), F.abs(low)))).alias("done"),
        )
        state = materialize(nxt)
        if state.filter(~F.col("done")).isEmpty():
            return state.select("source", "source_size", "target", "mean", "multiplier")
    raise ArithmeticError(f"the multipliers have not converged after {steps} steps")


def _orderable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_orderable(f.dataType) for f in kind.fields)
    return _orderable(kind.elementType) if isinstance(kind, T.ArrayType) else not isinstance(kind, T.MapType | T.VariantType)


def mix(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), key: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[float, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """Every row's ``carry`` columns as a struct ``_carry``, with size, source_size, target, rate, copies and taken."""
    rows = materialize(
        docs.select(F.struct(*(F.col(c) for c in carry)).alias("_carry"), _source_key(F.col(source)).alias("source"), word_count(F.col(text)).alias("size"), F.xxhash64(F.col(key)).alias("_hash"))
    )
    bucketed = materialize(rows.groupBy("source", "size", F.pmod("_hash", F.lit(BUCKETS)).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n")))
    cells = materialize(bucketed.groupBy("source", "size").agg(F.sum("n").alias("n")))
    goals = targets(cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, most)
    solved = multipliers(cells, materialize(goals), most)
    # copies of a cell: whole ones for each document, and extras by a rounded running sum over descending sizes
    c = cells.join(solved, "source", "left")
    c = c.withColumn("rate", F.when(F.col("size") == 0, F.lit(1.0)).otherwise(F.round(_rate(most), 12)))
    c = c.withColumn("whole", F.floor("rate")).withColumn("part", F.col("n") * (F.col("rate") - F.col("whole")))
    through = F.floor(F.sum("part").over(W.partitionBy("source").orderBy(F.desc("size")).rowsBetween(W.unboundedPreceding, 0)) + 0.5)
    c = c.withColumn("through", through)
    extras = F.col("through") - F.coalesce(F.lag("through").over(W.partitionBy("source").orderBy(F.desc("size"))), F.lit(0))
    c = c.withColumn("extras", F.least(F.greatest(extras, F.lit(0)), F.col("n"))).select("source", "size", F.col("n").alias("cell_n"), "source_size", "target", "rate", "whole", "extras")
    b = bucketed.join(materialize(c), ["source", "size"])
    upto = W.partitionBy("source", "size").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    seen = F.sum("n").over(upto)
    share = lambda n: F.floor((2 * n * F.col("extras") + F.col("cell_n")) / (2 * F.col("cell_n")))
    b = b.withColumn("seen", seen).withColumn("more", share(F.col("seen")) - share(F.col("seen") - F.col("n")))
    plan = materialize(b.select("source", "size", "bucket", "source_size", "target", "rate", "whole", "more"))
    d = rows.withColumn("bucket", F.pmod("_hash", F.lit(BUCKETS)).cast("int"))
    tie = F.col("_carry") if _orderable(rows.schema["_carry"].dataType) else F.to_json("_carry")
    d = d.withColumn("turn", F.row_number().over(W.partitionBy("source", "size", "bucket").orderBy("_hash", tie)))
    d = d.join(plan, ["source", "size", "bucket"])
    copies = (F.col("whole") + F.when(F.col("turn") <= F.col("more"), 1).otherwise(0)).cast("long")
    return d.select("_carry", "size", F.coalesce("source_size", F.lit(0)).cast("long").alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target"), "rate", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
