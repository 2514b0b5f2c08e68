"""Analytics over per-case result tables: pairing, summaries, ranks and paired tests.

Order statistics never sort all rows in one task.  Equal values are merged first and
the running totals are taken in two levels (``running``): inside value buckets, and
over the bucket totals.
"""

from __future__ import annotations

from math import erfc, sqrt

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.functions.voxel import effect_size
from voxloom.operators.measure import exact_median
from voxloom.session import attach, bounded


def running(df: DataFrame, group: list[str], value: str, weights: list[str], width: float = 1 / 256) -> DataFrame:
    """Add ``before_<w>``: total weight of smaller values in the group (values distinct per group)."""
    bucketed = df.withColumn("_b", F.floor(F.col(value) / F.lit(width)))
    totals = bucketed.groupBy(*group, "_b").agg(*[F.sum(w).alias(w) for w in weights])
    outer = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*group, "_b", *[F.coalesce(F.sum(w).over(outer), F.lit(0)).alias(f"_base_{w}")
                                         for w in weights])
    inner = Window.partitionBy(*group, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return (bucketed.join(base, [*group, "_b"])
            .select(*df.columns, *[(F.col(f"_base_{w}") + F.coalesce(F.sum(w).over(inner), F.lit(0)))
                                   .alias(f"before_{w}") for w in weights]))


def _one_value(metrics: DataFrame, value: str) -> DataFrame:
    return metrics.groupBy("case_id", "series").agg(F.max(value).alias(value)).where(F.col(value).isNotNull())


def paired(metrics: DataFrame, value: str = "dice") -> DataFrame:
    """Ordered pairs of series on the cases they share: (pair, case_id, a, b).

    An equi-join on the case, whatever the number of series.
    """
    one = _one_value(metrics, value)
    p = one.select("case_id", F.col("series").alias("p"), F.col(value).alias("a"))
    q = one.select("case_id", F.col("series").alias("q"), F.col(value).alias("b"))
    return p.join(q, "case_id").where("p < q").select(F.concat_ws(" vs ", "p", "q").alias("pair"), "case_id", "a", "b")


def shared_cases(metrics: DataFrame, value: str = "dice") -> DataFrame:
    """Rows (case_id, series, value) of the cases that every series has."""
    one = _one_value(metrics, value)
    total = one.select(F.lit(0).alias("_all"), "series").groupBy("_all").agg(F.countDistinct("series").alias("_total"))
    whole = one.groupBy("case_id").agg(F.count(F.lit(1)).alias("_n")).withColumn("_all", F.lit(0)) \
        .join(F.broadcast(total), "_all").where("_n = _total").select("case_id")      # one row is broadcast
    return one.join(whole, "case_id", "left_semi").select("case_id", "series", value)


def case_summary(metrics: DataFrame, limit: float = 0.8) -> DataFrame:
    """Cases, mean and exact median score, and how many are below the limit, per series (without a name: no median)."""
    d = F.col("dice")
    sums = metrics.groupBy("series").agg(
        F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean_dice"),
        F.sum((d < limit).cast("long")).alias("n_below"), F.sum((d >= limit).cast("long")).alias("n_ok"))
    middle = exact_median(metrics.select("series", "dice"), "dice", ("series",))
    return sums.join(middle, "series", "left").select(
        "series", "n", "mean_dice", F.col("median").alias("median_dice"), "n_below", "n_ok")


def timing_ci(metrics: DataFrame) -> DataFrame:
    """Mean, population deviation, 95 % interval of the mean, extremes."""
    t = F.col("total_s")
    base = metrics.groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.avg(t).alias("mean_s"),
                                         F.stddev_pop(t).alias("std_s"), F.min(t).alias("min_s"),
                                         F.max(t).alias("max_s"))
    half = 1.96 * F.col("std_s") / F.sqrt("n")
    return base.select("*", (F.col("mean_s") - half).alias("lo_s"), (F.col("mean_s") + half).alias("hi_s"))


def stage_breakdown(stages: DataFrame, names: list[str], total: str = "total_s", by: str = "series") -> DataFrame:
    """Mean seconds per stage, the unexplained rest floored at zero, and its share of the total."""
    means = stages.groupBy(by).agg(*[F.avg(c).alias(c) for c in names], F.avg(total).alias("_t"))
    rest = F.greatest(F.col("_t") - sum((F.col(c) for c in names), F.lit(0.0)), F.lit(0.0))
    listed = F.array(*[F.struct(F.lit(c).alias("stage"), F.col(c).alias("mean_s")) for c in names],
                     F.struct(F.lit("other").alias("stage"), rest.alias("mean_s")))
    return means.select(by, F.col("_t").alias("mean_total_s"), F.explode(listed).alias("s")).select(
        by, "s.stage", "s.mean_s", (F.col("s.mean_s") / F.col("mean_total_s")).alias("share"))


def slope_origin(df: DataFrame, x: Column, y: Column, by: str = "series") -> DataFrame:
    """Least-squares slope through the origin."""
    return df.groupBy(by).agg((F.sum(x * y) / F.sum(x * x)).alias("slope"))


def voxel_cost(metrics: DataFrame, dims: DataFrame, seconds: str = "total_s", by: str = "series") -> DataFrame:
    """Time a voxel: slope through the origin of seconds over grid size, in s per 1e8 voxels and in ns a voxel.

    Grid sizes are looked up per case (``dims``: case_id, nx, ny, nz); cases without a size take no part.
    """
    size = dims.select("case_id", (F.col("nx").cast("long") * F.col("ny") * F.col("nz") / 1e8).alias("_size"))
    return slope_origin(attach(metrics, size, ["case_id"]), F.col("_size"), F.col(seconds), by).select(
        by, "slope", (F.col("slope") * 10.0).alias("ns_per_voxel"))


def throughput(metrics: DataFrame, seconds: str = "total_s", by: str = "series") -> DataFrame:
    """Cases a second over the seconds they took together; null where these are none or zero."""
    wall = F.sum(seconds)
    return metrics.groupBy(by).agg(F.count(F.lit(1)).alias("n"), wall.alias("wall_s")).withColumn(
        "per_s", F.when(F.col("wall_s") > 0, F.col("n") / F.col("wall_s")))


def max_error(got: DataFrame, want: DataFrame, on: list[str], value: str = "v", tolerance: float = 1e-4) -> DataFrame:
    """Largest difference of two fields, relative to the largest wanted value, and the verdict.

    A place that only one of them has, and a value that is null or not a number, fails the check.
    """
    both = got.select(*on, F.col(value).alias("_g")).join(want.select(*on, F.col(value).alias("_w")), on, "full")
    gap = F.abs(F.col("_g") - F.col("_w"))
    sums = both.agg(F.count(F.lit(1)).alias("n"), F.max(gap).alias("max_error"), F.max(F.abs("_w")).alias("max_abs"),
                    F.sum((gap.isNull() | F.isnan(gap)).cast("long")).alias("_bad"))
    relative = F.col("max_error") / F.when(F.col("max_abs") > 0, F.col("max_abs")).otherwise(1.0)
    return sums.select("n", "max_error", "max_abs", relative.alias("relative"),
                       ((F.coalesce("_bad", F.lit(0)) == 0) & (F.coalesce(relative, F.lit(0.0)) < tolerance)).alias("ok"))


def cliffs_delta(pairs: DataFrame) -> DataFrame:
    """All-pairs dominance from running counts: (#a>b - #a<b) / (n*m), without pairing rows."""
    both = pairs.select("pair", F.explode(F.array(
        F.struct(F.col("a").alias("v"), F.lit(1).alias("na"), F.lit(0).alias("nb")),
        F.struct(F.col("b").alias("v"), F.lit(0).alias("na"), F.lit(1).alias("nb")))).alias("s"))
    counted = both.groupBy("pair", F.col("s.v").alias("v")).agg(F.sum("s.na").alias("na"), F.sum("s.nb").alias("nb"))
    below = running(counted, ["pair"], "v", ["na", "nb"])
    # a > b: each a meets the b's below it; a < b: each b meets the a's below it.
    sums = below.groupBy("pair").agg(
        F.sum(F.col("na") * F.col("before_nb")).alias("gt"), F.sum(F.col("nb") * F.col("before_na")).alias("lt"),
        F.sum("na").alias("n"), F.sum("nb").alias("m"))
    delta = (F.col("gt") - F.col("lt")) / (F.col("n") * F.col("m")).cast("double")
    return sums.select("pair", "n", "m", "gt", "lt", delta.alias("delta"), effect_size(delta).alias("magnitude"))


def ranked_differences(pairs: DataFrame, digits: int = 4) -> DataFrame:
    """Per |difference| value: counts by sign and the shared average rank.

    Differences are rounded first, so equal scores tie although floats differ.
    """
    d = F.round(F.col("a") - F.col("b"), digits)
    sizes = (pairs.select("pair", d.alias("d")).where("d <> 0")
             .groupBy("pair", F.abs("d").alias("v"))
             .agg(F.count(F.lit(1)).alias("t"), F.sum((F.col("d") > 0).cast("long")).alias("pos")))
    return running(sizes, ["pair"], "v", ["t"]).select(
        "pair", "v", "t", "pos", (F.col("before_t") + (F.col("t") + 1) / 2.0).alias("rank"))


def signed_rank(pairs: DataFrame) -> DataFrame:
    """Rank sums, rank-biserial correlation and the tie-corrected normal score.

    Zeros are dropped, no continuity correction.
    """
    return _signed_rank(pairs).drop("ties")


def _signed_rank(pairs: DataFrame) -> DataFrame:
    r = ranked_differences(pairs)
    t = F.col("t").cast("double")
    sums = r.groupBy("pair").agg(
        F.sum("t").alias("n"), F.sum(F.col("pos") * F.col("rank")).alias("w_pos"),
        F.sum((F.col("t") - F.col("pos")) * F.col("rank")).alias("w_neg"), F.sum(t * t * t - t).alias("ties"))
    n = F.col("n").cast("double")
    w = F.least("w_pos", "w_neg")
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - F.col("ties") / 48.0)
    return sums.select("pair", "n", "w_pos", "w_neg", "ties", w.alias("w"),
                       ((F.col("w_pos") - F.col("w_neg")) / (F.col("w_pos") + F.col("w_neg"))).alias("rank_biserial"),
                       ((w - n * (n + 1) / 4.0) / sd).alias("z"))


@F.pandas_udf(T.DoubleType())
def _tail(z: pd.Series) -> pd.Series:
    return z.map(lambda v: None if v is None or v != v else erfc(abs(v) / sqrt(2.0)))


def two_sided_p(z: Column) -> Column:
    """2 * (1 - Phi(|z|)) by the C library's erfc, over Arrow batches: one value a pair of series."""
    return _tail(z.cast("double"))


def wilcoxon(pairs: DataFrame) -> DataFrame:
    return signed_rank(pairs).withColumn("p", two_sided_p(F.col("z")))


#: Pairs of values up to which the exact distribution of the rank sum is taken.
EXACT_PAIRS = 50


def exact_tail(n: Column, w: Column) -> Column:
    """Two-sided p of the smaller rank sum w of n untied differences, from the distribution of all 2**n signs.

    The chances of the sums 0, 1, ... are one array; rank r moves half of each chance up by r.
    """
    start = F.transform(F.sequence(F.lit(0), (n * (n + 1) / 2).cast("int")), lambda i: (i == 0).cast("double"))
    def with_rank(chance: Column, r: Column) -> Column:
        return F.transform(chance, lambda x, i: (x + F.when(i >= r, F.element_at(chance, (i - r + 1).cast("int"))).otherwise(0.0)) / 2)
    chances = F.aggregate(F.sequence(F.lit(1), n.cast("int")), start, with_rank)
    upto = F.slice(chances, 1, w.cast("int") + 1)
    return F.least(F.lit(1.0), 2 * F.aggregate(upto, F.lit(0.0), lambda s, x: s + x))


def wilcoxon_auto(pairs: DataFrame, most: int = EXACT_PAIRS) -> DataFrame:
    """``wilcoxon`` with ``exact``: up to ``most`` pairs without ties or zeros take p from the exact distribution."""
    test, untied = _signed_rank(pairs), F.col("ties") == 0
    asked = pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("_asked"))
    exact = untied & (F.col("_asked") == F.col("n")) & (F.col("n") <= most)
    return test.join(asked, "pair").withColumn("exact", exact).withColumn(
        "p", F.when(F.col("exact"), exact_tail(F.col("n"), F.col("w"))).otherwise(two_sided_p(F.col("z")))).drop("_asked", "ties")


def failed_sets(metrics: DataFrame, limit: float = 0.8) -> DataFrame:
    """Failed cases of each series pair compared as sets: sizes, common cases, equal, disjoint.

    Every pair of series is a row of the answer, so the names (a row a series) are counted
    and meet by broadcast; more of them than may be broadcast are an error.  Cases only
    meet where both failed.
    """
    one = _one_value(metrics, "dice").withColumn("failed", (F.col("dice") < limit).cast("long"))
    sizes, fits = bounded(one.groupBy("series").agg(F.sum("failed").alias("k")))
    if not fits:
        raise ValueError("too many series to compare every two of them")
    p, q = sizes.select(F.col("series").alias("p"), F.col("k").alias("n_a")), sizes.select(F.col("series").alias("q"), F.col("k").alias("n_b"))
    bad = one.where("failed = 1").select("case_id", "series")
    both = (bad.withColumnRenamed("series", "p").join(bad.withColumnRenamed("series", "q"), "case_id").where("p < q")
            .groupBy("p", "q").agg(F.count(F.lit(1)).alias("n_shared")))
    named = p.join(F.broadcast(q), F.col("p") < F.col("q")).join(both, ["p", "q"], "left").select(
        F.concat_ws(" vs ", "p", "q").alias("pair"), "n_a", "n_b", F.coalesce("n_shared", F.lit(0).cast("long")).alias("n_shared"))
    return named.select("*", ((F.col("n_a") == F.col("n_b")) & (F.col("n_shared") == F.col("n_a"))).alias("equal"),
                        (F.col("n_shared") == 0).alias("disjoint"))


def relative_to_first(df: DataFrame, by: str, order: str, seconds: str) -> DataFrame:
    """Speed-up and percent change against the first row of each group.

    The first row is an aggregate, not a window, so groups of any size stay split.
    """
    first = df.groupBy(by).agg(F.min_by(seconds, order).alias("first_s"))
    return df.join(first, by).select(
        by, order, seconds, (F.col("first_s") / F.col(seconds)).alias("speedup"),
        (100.0 * (F.col(seconds) - F.col("first_s")) / F.col("first_s")).alias("change_pct"))


def bandwidth(misses: Column, seconds: Column, repeats: int = 5, line_bytes: int = 64) -> Column:
    """GB/s implied by cache-line misses counted over ``repeats`` runs."""
    return misses * float(line_bytes) / (repeats * seconds) / 1e9


def best_so_far(history: DataFrame, order: str, score: str, by: str, width: int = 4096) -> DataFrame:
    """Running best, whether a row improves it, for ordered histories of any length.

    Two levels again: best inside blocks of the order key, and best over earlier blocks.
    """
    blocks = history.withColumn("_b", F.floor(F.col(order) / F.lit(width)))
    prior = Window.partitionBy(by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = blocks.groupBy(by, "_b").agg(F.max(score).alias("_m")).select(by, "_b", F.max("_m").over(prior).alias("_base"))
    inner = Window.partitionBy(by, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = blocks.join(base, [by, "_b"]).withColumn("_before", F.greatest("_base", F.max(score).over(inner)))
    return out.select(*history.columns, F.greatest("_before", F.col(score)).alias("best"),
                      (F.col("_before").isNull() | (F.col(score) > F.col("_before"))).alias("improved"))


def early_stop(history: DataFrame, order: str, score: str, by: str, patience: int, margin: float = 1e-4,
               start: float = 0.0, width: int = 4096) -> DataFrame:
    """Where training stops: (by, epochs, best, best_at, stop_at); ``stop_at`` is null where it runs to its end.

    A row is taken as the best if its score is over the last one taken (at first ``start``) by more than
    ``margin``; after ``patience`` rows without one the history ends, and later rows take no part.  A null
    score never counts as better.  Only rows above all earlier scores can be taken - a lower one is below a
    best that was taken, or within the margin of a best that was not - so just those records are folded in
    order; rows are numbered and records found block by block.  Rows of one order value count by score.
    """
    blocks = history.select(by, F.col(order).alias("_at"), F.col(score).alias("_v"), F.floor(F.col(order) / F.lit(width)).alias("_b"))
    prior = Window.partitionBy(by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = blocks.groupBy(by, "_b").agg(F.count(F.lit(1)).alias("_n")).select(
        by, "_b", F.coalesce(F.sum("_n").over(prior), F.lit(0)).alias("_base"))
    rows = blocks.join(base, [by, "_b"]).withColumn(
        "_pos", F.col("_base") + F.row_number().over(Window.partitionBy(by, "_b").orderBy("_at", "_v"))).select(by, "_at", "_v", "_pos")
    records = best_so_far(rows.where(F.col("_v").isNotNull()), "_pos", "_v", by, width).where("improved")
    state = F.struct(F.lit(float(start)).alias("best"), F.lit(0).cast("long").alias("pos"))

    def take(s: Column, r: Column) -> Column:
        better = (r["pos"] <= s["pos"] + patience) & (r["v"] > s["best"] + F.lit(margin))
        return F.when(better, F.struct(r["v"].alias("best"), r["pos"].alias("pos"))).otherwise(s)

    folded = records.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(F.col("_pos").alias("pos"), F.col("_v").cast("double").alias("v")))).alias("_r")) \
        .select(by, F.aggregate("_r", state, take).alias("_s"))
    total = rows.groupBy(by).agg(F.count(F.lit(1)).alias("epochs")).join(folded, by, "left").select(
        by, "epochs", F.coalesce("_s", state).alias("_s"))
    ends = rows.join(total, by).where((F.col("_pos") == F.col("_s.pos")) | (F.col("_pos") == F.col("_s.pos") + patience))
    at = ends.groupBy(by).agg(F.max(F.when(F.col("_pos") == F.col("_s.pos"), F.col("_at"))).alias("best_at"),
                              F.max(F.when(F.col("_pos") > F.col("_s.pos"), F.col("_at"))).alias("stop_at"))
    return total.join(at, by, "left").select(by, "epochs", F.col("_s.best").alias("best"), "best_at", "stop_at")


def pair_semi(images: DataFrame, labels: DataFrame, on: str) -> DataFrame:
    """Images that have a label."""
    return images.join(labels, on, "left_semi")


def slice_index(slices: DataFrame, labelled: DataFrame) -> DataFrame:
    """Per slice: its row in case order, position, whether it has label voxels, case length.

    Row numbers come from per-case bases, a two-level running sum over one row per case.
    """
    sizes = slices.groupBy("case_id").agg(F.max("nz").alias("n_in_case")).withColumn("_all", F.lit(0))
    bases = running(sizes, ["_all"], "case_id", ["n_in_case"], width=1024).select(
        "case_id", "n_in_case", F.col("before_n_in_case").alias("_base"))
    flagged = labelled.select("case_id", "z").distinct().withColumn("_has", F.lit(1))
    return (slices.select("case_id", "z").join(bases, "case_id").join(flagged, ["case_id", "z"], "left")
            .select((F.col("_base") + F.col("z")).cast("long").alias("row"), "case_id", "z",
                    F.coalesce("_has", F.lit(0)).alias("has_airway"), "n_in_case"))


def background_sample(index: DataFrame, share: float = 0.3, seed: int = 0) -> DataFrame:
    """All labelled slices, and per case ``int(share * labelled)`` background slices by seeded hash.

    Sampling is the feature here.  The order is a multiplicative hash, distinct within a
    case, cut into ranges: the cut-off is found from range counts, and only the rows of
    one range are ever ranked together.
    """
    order = (F.col("z").cast("long") * 2654435761 + F.col("case_id").cast("long") * 40503 + seed * 7919) % 4294967296
    rows = index.withColumn("_h", order).withColumn("_b", F.expr("cast(_h div 16777216 as int)"))
    quota = rows.groupBy("case_id").agg(F.floor(F.sum("has_airway") * F.lit(share)).alias("_quota"))
    back = rows.where("has_airway = 0")
    sizes = back.groupBy("case_id", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("case_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("case_id", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")) \
        .join(quota, "case_id").where("_base < _quota")
    inner = Window.partitionBy("case_id", "_b").orderBy("_h", "z")
    picked = (back.join(bases, ["case_id", "_b"])
              .withColumn("_r", F.col("_base") + F.row_number().over(inner))
              .where("_r <= _quota"))
    return rows.where("has_airway = 1").select(*index.columns).unionByName(picked.select(*index.columns))


def split_cases(case_ids: list[str], share: float, seed: int = 42, rounding=round) -> tuple[list[str], list[str]]:
    """Seeded hold-out split of a sorted id list: (training, validation)."""
    import random
    order = sorted(case_ids)
    random.Random(seed).shuffle(order)
    n = max(1, rounding(len(order) * share))
    return order[n:], order[:n]


def batch_mean_dice(scored: DataFrame, batch: str = "batch") -> DataFrame:
    """Mean over batches of each batch's overlap score (not the score of the whole)."""
    per = scored.groupBy(batch).agg(F.sum("inter").alias("i"), F.sum("pred").alias("p"), F.sum("gt").alias("g"))
    one = F.when(F.col("p") + F.col("g") > 0, 2.0 * F.col("i") / (F.col("p") + F.col("g"))).otherwise(F.lit(1.0))
    return per.agg(F.avg(one).alias("val_dice"))
