"""Stratified holdout and stratified folds, exact in size and the same on every run.

Rows of a class are put in the order of a keyed digest of their id. The development part and each
fold are then stretches of that order, with sizes that follow from the class counts alone. So a
row's place follows from comparing its digest with a few cut digests of its class: a map-side step
against a table of classes, with no shuffle and no sort of the texts. Finding the cut digests reads
ids and labels only, as running counts of digest ranges, of ranges within those that hold a cut, and of
the digests within those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triagekit.constants import HOLDOUT_SHARE, MAX_CLASSES, N_FOLDS, SEED
from triagekit.errors import LimitExceeded
from triagekit.sources.store import materialize

#: Hex digits of a digest range: 4,096 ranges, each cut into 4,096 again.
RANGE_DIGITS = 3


def order_digest(id_col: Column, seed: int = SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))))


def class_quotas(
    counts: DataFrame, label: str = "category", holdout: tuple[int, int] = HOLDOUT_SHARE, k: int = N_FOLDS
) -> DataFrame:
    """Per class: rows, development rows, and the last rank of every fold.

    The holdout has ``ceil(share * n)`` rows. Development rows go to classes by largest remainder
    in integer arithmetic, ties in label order. Fold sizes of a class differ by at most one; the
    extra rows start where the class before stopped, so whole folds are balanced too.
    The input has one row per class, which is why unpartitioned windows are fine here.
    """
    num, den = holdout
    everything = Window.partitionBy()
    by_label = Window.orderBy(label)
    n_dev = F.col("total") - F.expr(f"(total * {num} + {den} - 1) DIV {den}")
    q = (
        counts.withColumn("total", F.sum("count").over(everything))
        .withColumn("dev_total", n_dev)
        .withColumn("floor_quota", F.expr("count * dev_total DIV total"))
        .withColumn("remainder", F.expr("count * dev_total % total"))
        .withColumn("spare", F.col("dev_total") - F.sum("floor_quota").over(everything))
        .withColumn("place", F.row_number().over(Window.orderBy(F.desc("remainder"), label)))
        .withColumn("dev", F.col("floor_quota") + (F.col("place") <= F.col("spare")).cast("long"))
        .withColumn("offset", F.sum("dev").over(by_label) - F.col("dev"))
    )
    # Fold f gets the numbers r in [offset, offset + dev) with r % k = f.
    upto = lambda x, f: F.expr(f"({x} + {k} - 1 - {f}) DIV {k}")
    sizes = [upto("offset + dev", f) - upto("offset", f) for f in range(k)]
    ends, end = [], F.lit(0).cast("long")
    for size in sizes:
        end = end + size
        ends.append(end)
    return q.select(label, "count", "dev", F.array(*ends).alias("fold_ends"))


def _narrow(counted: DataFrame, wanted: DataFrame, within: list[str], place: str) -> DataFrame:
    """For each wanted ``rank`` of a group, the first ``place`` whose running count reaches it, and the rank there."""
    upto = F.sum("n").over(Window.partitionBy(*within).orderBy(place))
    there = counted.select(*within, place, "n", upto.alias("upto")).join(F.broadcast(wanted), within)
    before = F.col("upto") - F.col("n")
    return there.where((F.col("upto") >= F.col("rank")) & (before < F.col("rank"))).select(
        *within, place, "fold", (F.col("rank") - before).alias("rank")
    )


def split_cuts(
    df: DataFrame,
    id_col: str = "doc_id",
    label: str = "category",
    holdout: tuple[int, int] = HOLDOUT_SHARE,
    k: int = N_FOLDS,
    seed: int = SEED,
) -> DataFrame:
    """``(label, cuts)``: the digest of the last row of every fold (null for an empty fold).

    Reads ``df`` twice: one aggregation counts classes and digest ranges together, a second one the digests
    of those ranges that hold a cut, at most (classes x folds) of 4,096 per class. Rows with the same digest
    count as one entry before they move.
    """
    ids = df.select(F.col(label).alias("l"), order_digest(F.col(id_col), seed).alias("h")).where("l IS NOT NULL")
    ids = ids.withColumn("first", F.substring("h", 1, RANGE_DIGITS))
    ranges = materialize(ids.groupBy("l", "first").agg(F.count("*").alias("n")), "digest-ranges")
    quotas = materialize(class_quotas(ranges.groupBy(F.col("l").alias(label)).agg(F.sum("n").alias("count")), label, holdout, k), "quotas")
    if quotas.count() > MAX_CLASSES:
        raise LimitExceeded(f"more than {MAX_CLASSES} classes in column {label}")
    wanted = quotas.select(F.col(label).alias("l"), F.posexplode("fold_ends").alias("fold", "rank")).where("rank > 0")
    # From here on all tables are small: classes x folds ranks, and the digests of the ranges that hold them.
    wanted = _narrow(ranges, wanted, ["l"], "first")
    held = F.broadcast(wanted.select("l", "first").distinct())
    inside = materialize(ids.join(held, ["l", "first"]).groupBy("l", "first", "h").agg(F.count("*").alias("n")), "cut-ranges")
    inside = inside.withColumn("second", F.substring("h", RANGE_DIGITS + 1, RANGE_DIGITS))
    wanted = _narrow(inside.groupBy("l", "first", "second").agg(F.sum("n").alias("n")), wanted, ["l", "first"], "second")
    held = F.broadcast(wanted.select("l", "first", "second").distinct())
    wanted = _narrow(inside.join(held, ["l", "first", "second"]), wanted, ["l", "first", "second"], "h")
    hits = wanted.groupBy(F.col("l").alias(label)).agg(F.map_from_entries(F.collect_list(F.struct("fold", "h"))).alias("by_fold"))
    cuts = hits.select(label, F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: F.col("by_fold")[f]).alias("cuts"))
    return materialize(cuts, "split-cuts")


def assign_split(df: DataFrame, cuts: DataFrame, id_col: str = "doc_id", label: str = "category", seed: int = SEED) -> DataFrame:
    """Add ``split`` (dev/holdout) and ``fold`` (null in the holdout); a row without label has neither."""
    # ``cuts`` has one row per class and ``split_cuts`` has checked the number of classes.
    h = order_digest(F.col(id_col), seed)
    fold = F.array_position(F.transform("cuts", lambda c: F.coalesce(F.col("_h") <= c, F.lit(False))), True)
    return (
        df.withColumn("_h", h)
        .join(F.broadcast(cuts), label, "left")
        .withColumn("fold", F.when(fold > 0, (fold - 1).cast("int")))
        .withColumn("split", F.when(F.col(label).isNotNull(), F.when(F.col("fold").isNull(), "holdout").otherwise("dev")))
        .select(*df.columns, "split", "fold")
    )


def stratified_split(df: DataFrame, id_col: str = "doc_id", label: str = "category", **options) -> DataFrame:
    """Holdout and folds in one step; see the module text."""
    seed = options.get("seed", SEED)
    return assign_split(df, split_cuts(df, id_col, label, **options), id_col, label, seed)
