"""Masks as sorted runs of places, ``[start, end)``, and their algebra by sweeping run ends.

A mask is a key (``by``); its places are pixels in row-major order, vertices or any other numbers.
After ``encode`` nothing has a row a pixel. A key's runs are ordered in one task, so a key should be
one image's mask, not a whole data set; an empty ``by`` is refused.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _keyed(by: Sequence[str]) -> list[str]:
    if not by:
        raise ValueError("masks need a key: without one all runs would meet in a task")
    return list(by)


def encode(pixels: DataFrame, by: Sequence[str], place: str) -> DataFrame:
    """The runs of each mask's places; repeated places count once, null ones not at all."""
    by = _keyed(by)
    w = W.partitionBy(*by).orderBy("_at")
    places = pixels.select(*by, F.col(place).cast("long").alias("_at")).filter("_at IS NOT NULL")
    begins, last = (F.coalesce(F.abs(f("_at").over(w) - F.col("_at")) > 1, F.lit(True)) for f in (F.lag, F.lead))
    # of equal places the first may begin a run and the last may end it
    return _closed(places.select(*by, "_at", (F.col("_at") + 1).alias("_next"), begins.alias("_begins"), last.alias("_last")), by)


def decode(runs: DataFrame, place: str = "place") -> DataFrame:
    """A row a place again."""
    rest = [c for c in runs.columns if c not in ("start", "end")]
    return runs.filter("start < end").select(*rest, F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias(place))


def _ends(runs: DataFrame, by: list[str], side: str, other: str) -> DataFrame:
    sound = runs.filter("start < end")
    step = F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("d"))))
    return sound.select(*by, step.alias("_e")).select(*by, F.col("_e.at").alias("_at"), F.col("_e.d").alias(side), F.lit(0).alias(other))


def _closed(bounds: DataFrame, by: list[str]) -> DataFrame:
    """Runs of the stretches that begin one, that end one or that do both.

    As in all that follows, rows of a key are sorted once and seen one by one: no table of places, which
    are nearly as many as the rows, is held for an aggregation.
    """
    until = F.when(F.col("_last"), F.col("_next")).otherwise(F.lead("_next").over(W.partitionBy(*by).orderBy("_at")))
    return bounds.filter("_begins OR _last").select(*by, F.col("_at").alias("start"), until.alias("end"), "_begins").filter("_begins").drop("_begins")


def _swept(ends: DataFrame, by: list[str]) -> DataFrame:
    """Stretches between ends with how many runs of either side lie over them: _at, _next, _a, _b."""
    w = W.partitionBy(*by).orderBy("_at")
    upto = w.rangeBetween(W.unboundedPreceding, W.currentRow)  # with all ends at the place
    return ends.select(*by, "_at", F.lead("_at").over(w).alias("_next"), F.sum("_da").over(upto).alias("_a"), F.sum("_db").over(upto).alias("_b")).filter("_at < _next")


def _bounds(inside: Column, w) -> tuple[Column, Column]:
    """Whether a stretch begins a run of those that lie inside, and whether it ends one."""
    begins, last = (inside & ~F.coalesce(f(inside).over(w), F.lit(False)) for f in (F.lag, F.lead))
    return begins.alias("_begins"), last.alias("_last")


def _joined(stretches: DataFrame, by: list[str], inside: Column) -> DataFrame:
    """Runs of the stretches that lie inside; neighbours become one."""
    return _closed(stretches.select(*by, "_at", "_next", *_bounds(inside, W.partitionBy(*by).orderBy("_at"))), by)


#: What a place must lie in, by operation.
_INSIDE = {"union": "_a > 0 OR _b > 0", "intersection": "_a > 0 AND _b > 0", "difference": "_a > 0 AND _b = 0", "symmetric": "(_a > 0) != (_b > 0)"}


def combine(a: DataFrame, b: DataFrame, by: Sequence[str], how: str) -> DataFrame:
    """Union, intersection, difference or symmetric difference of the masks of equal keys; runs of a side may overlap."""
    by = _keyed(by)
    ends = _ends(a, by, "_da", "_db").unionByName(_ends(b, by, "_db", "_da"))
    return _joined(_swept(ends, by), by, F.expr(_INSIDE[how]))


def algebra(a: DataFrame, b: DataFrame, by: Sequence[str], hows: Sequence[str] = tuple(_INSIDE), out: str = "how") -> DataFrame:
    """What ``combine`` gives for each of ``hows``, which is in column ``out``, from one sweep."""
    by = _keyed(by)
    w = W.partitionBy(*by).orderBy("_at")
    found = _swept(_ends(a, by, "_da", "_db").unionByName(_ends(b, by, "_db", "_da")), by)
    marks = [F.struct(F.lit(how).alias(out), *_bounds(F.expr(_INSIDE[how]), w)) for how in hows]
    each = found.select(*by, "_at", "_next", F.array(*marks).alias("_m")).select(*by, "_at", "_next", F.inline(F.filter("_m", lambda m: m["_begins"] | m["_last"])))
    return _closed(each, [*by, out]).select(*by, "start", "end", out)


def coverage(runs: DataFrame, by: Sequence[str]) -> DataFrame:
    """The union of all masks that share ``by``, such as those of one image."""
    by = _keyed(by)
    return _joined(_swept(_ends(runs, by, "_da", "_db"), by), by, F.col("_a") > 0)


def overlaps(runs: DataFrame, by: Sequence[str]) -> DataFrame:
    """``by``, depth and area: how many places so many of the masks that share ``by`` have in common."""
    by = _keyed(by)
    return _swept(_ends(runs, by, "_da", "_db"), by).filter("_a > 0").groupBy(*by, F.col("_a").cast("int").alias("depth")).agg(F.sum(F.col("_next") - F.col("_at")).alias("area"))


def shared_areas(runs: DataFrame, by: Sequence[str]) -> DataFrame:
    """``by``, covered, shared, deepest and runs of the masks that share ``by``: places in any and in several, in how many at most, and runs of the union.

    From one sweep: what ``coverage`` and ``overlaps`` give isn't made and joined. A key without places has no row.
    """
    by = _keyed(by)
    found = _swept(_ends(runs, by, "_da", "_db"), by)
    begins, _ = _bounds(F.col("_a") > 0, W.partitionBy(*by).orderBy("_at"))
    width = F.col("_next") - F.col("_at")
    sums = found.select(*by, "_a", width.alias("_width"), begins).filter("_a > 0").groupBy(*by)
    return sums.agg(F.sum("_width").alias("covered"), F.sum(F.when(F.col("_a") > 1, F.col("_width")).otherwise(0)).alias("shared"), F.max("_a").cast("int").alias("deepest"), F.count(F.when(F.col("_begins"), 1)).alias("runs"))


def areas(runs: DataFrame, by: Sequence[str]) -> DataFrame:
    return runs.groupBy(*by).agg(F.sum(F.col("end") - F.col("start")).alias("area"))


def scores(a: DataFrame, b: DataFrame, by: Sequence[str]) -> DataFrame:
    """``by``, a, b, intersection, union (areas) and iou of the masks of equal keys."""
    by = _keyed(by)
    found = _swept(_ends(a, by, "_da", "_db").unionByName(_ends(b, by, "_db", "_da")), by)
    area = lambda inside: F.sum(F.when(F.expr(inside), F.col("_next") - F.col("_at")).otherwise(F.lit(0)))
    sums = found.groupBy(*by).agg(area("_a > 0").alias("a"), area("_b > 0").alias("b"), area(_INSIDE["intersection"]).alias("intersection"), area(_INSIDE["union"]).alias("union"))
    return sums.withColumn("iou", F.try_divide(F.col("intersection").cast("double"), F.col("union")))


def new_keys(before: DataFrame, after: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys that are there after, such as handles that a call has made, but weren't before; nulls are a key."""
    return after.select(*on).subtract(before.select(*on))


def common_keys(before: DataFrame, after: DataFrame, on: Sequence[str]) -> DataFrame:
    return before.select(*on).intersect(after.select(*on))
