"""Mixing sources to target weights by weighted fair queueing.

Each source shuffles its documents (by a hash of ``doc_id``) and lines them up ``repeats``
times; a document's virtual finish time is the source's tokens up to and with it, divided by
the source's target. All copies, sorted by that time, are taken until the budget is spent.

Running sums are never taken over a whole source or the whole mix in one task: a source is cut
into slices by the leading digits of the hash, slices are summed first, and only within a slice
rows are sorted. The cut is found in the same way: sums of finish-time ranges, then of the
ranges within the one where the budget ends, and only the last small range is sorted.

Defined results: a NULL or empty text has size zero, a very long one counts whole; NULL is a
source like any other (the last). Repeated rows are documents of their own; rows alike in all
columns are interchangeable, and documents of one hash are ordered by size. An empty table gives
no rows. The user's columns travel in one struct, so any names are fine; one named like a result
gives way to it, in any case of letters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridcast.functions.scale_out import settle
from gridcast.llm.common import WORD, box, unbox

WEIGHTS, SHARE, REPEATS = (5, 2, 1), 1.5, 2
RESULTS = ("size", "source_size", "target", "taken")
DIGITS = 3                            # hash digits of a slice: 4,096 slices of a source
RANGES = (1 << 10, 1 << 16)           # finish-time ranges in 1, then in one of these


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``size``, the number of words."""
    return docs.withColumn("size", F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
            repeats: int = REPEATS) -> DataFrame:
    """``(source, source_size, target)``. Targets share ``share`` times all sizes by weight, none
    above ``repeats`` times its source; what is above is shared again among the others."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())           # one row per source
    w = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    sources = settle(sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", w)
                     .withColumn("most", F.col("source_size") * repeats))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, full = -1.0, 0
    while True:
        is_full = F.col("most") <= F.lit(level) * F.col("weight")
        n, held, open_weight = sources.agg(F.count_if(is_full), F.sum(F.when(is_full, F.col("most")).otherwise(0)),
                                           F.sum(F.when(is_full, 0).otherwise(F.col("weight")))).first()
        if not open_weight or (level >= 0 and n == full):
            break
        full, level = n, (share * total - (held or 0)) / open_weight
    share_of = F.when(is_full, F.col("most").cast("double")).otherwise(F.lit(level) * F.col("weight"))
    return sources.select("source", "source_size", share_of.alias("target"))


def _upto(key: list[str], order: list[str], value: str) -> Column:
    w = Window.partitionBy(*key).orderBy(*order)
    return F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))


def finish_times(rows: DataFrame, sizes: DataFrame, plan: DataFrame, digits: int = DIGITS) -> DataFrame:
    """``rows`` with their source's ``source_size`` and ``target``, the place ``_gc_spot`` in shuffled
    order and ``_gc_upto``, the source's tokens up to and with the document. ``sizes``: the same rows,
    narrow."""
    spot = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("_gc_of")     # never NULL: one plain join key
    sums = sizes.select(key, F.substring(spot, 1, digits).alias("_gc_slice"), "size") \
        .groupBy("_gc_of", "_gc_slice").agg(F.sum("size").alias("_here"))
    sums = sums.withColumn("_gc_before", _upto(["_gc_of"], ["_gc_slice"], "_here") - F.col("_here"))
    base = sums.join(plan.select(key, "source_size", "target"), "_gc_of").drop("_here")
    dealt = rows.withColumn("_gc_of", key).withColumn("_gc_spot", spot).withColumn("_gc_slice", F.substring("_gc_spot", 1, digits))
    dealt = dealt.withColumn("_gc_upto", _upto(["_gc_of", "_gc_slice"], ["_gc_spot", "size"], "size"))
    return dealt.join(base, ["_gc_of", "_gc_slice"]).withColumn("_gc_upto", F.col("_gc_upto") + F.col("_gc_before")).drop("_gc_of", "_gc_slice", "_gc_before")


def _copies(timed: DataFrame, repeats: int) -> DataFrame:
    """One row per copy, with the total order in which the mix takes them."""
    rows = timed.withColumn("copy", F.explode(F.array(*map(F.lit, range(repeats)))))
    return rows.select("size", _order("copy").alias("_gc_at"))


def _order(copy: str) -> Column:
    time = F.when(F.col("target") > 0, (F.expr(f"{copy} * source_size") + F.col("_gc_upto")) / F.col("target")).otherwise(0.0)
    return F.struct(time.alias("time"), "_gc_spot", F.coalesce("source", F.lit("")).alias("source"), "size",
                    F.expr(copy).cast("int").alias("copy"))


def _first_beyond(sums: DataFrame, budget: float) -> tuple[int, int] | None:
    """The first range that ends beyond the budget, and what comes before it."""
    w = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)   # a few thousand rows
    return sums.withColumn("end", F.sum("size").over(w)).filter(F.col("end") > budget) \
        .orderBy("range").select("range", F.col("end") - F.col("size")).first()


def _cut(copies: DataFrame, budget: float) -> Column | None:
    """Whether a copy at ``_gc_at`` is within the budget; None: all are."""
    left, inside, scale, narrowed = budget, copies, 1, None
    for ranges in RANGES:
        scale *= ranges
        place = F.floor(F.least(F.col("_gc_at.time"), F.lit(4.0)) * scale)
        found = _first_beyond(inside.groupBy(place.alias("range")).agg(F.sum("size").alias("size")), left)
        if found is None:
            return narrowed
        left, narrowed = left - found[1], place < found[0]
        inside = inside.filter(place == found[0])
    w = Window.orderBy("_gc_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)      # the last small range
    last = inside.withColumn("end", F.sum("size").over(w)).filter(F.col("end") <= left).agg(F.max("_gc_at")).first()[0]
    if last is None:
        return narrowed
    at = F.struct(*(F.lit(last[f.name]).cast(f.dataType).alias(f.name) for f in inside.schema["_gc_at"].dataType))
    return narrowed | (F.col("_gc_at") <= at)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS,
        text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``taken``, the words that the mix
    takes of each (a document is taken 0 to ``repeats`` times)."""
    names = [n for n in (docs.columns if keep is None else keep) if n.lower() not in RESULTS]
    boxed = [n for n in names if n not in ("doc_id", "source")]
    rows = measure(docs.select("doc_id", "source", text, box(docs, boxed)), text).drop(text)
    sizes = settle(rows.select("doc_id", "source", "size"))
    rows = rows if boxed else sizes
    plan = settle(targets(sizes, weights, share, repeats))
    timed = settle(finish_times(rows, sizes, plan))
    budget = plan.agg(F.sum("target")).first()[0] or 0.0
    within = _cut(_copies(timed, repeats), budget)
    timed = timed.withColumn("taken", F.lit(0).cast("long"))
    for copy in range(repeats):
        timed = timed.withColumn("_gc_at", _order(str(copy)))
        once = F.col("size") if within is None else F.when(within, F.col("size")).otherwise(0)
        timed = timed.withColumn("taken", F.col("taken") + once)
    own = dict(zip(boxed, unbox(boxed)))
    return timed.select(*[own.get(n, F.col(n) if n in ("doc_id", "source") else None) for n in names], *RESULTS)
