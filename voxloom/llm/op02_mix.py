"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Every source gets a target number of words.  A document is expected to come as often as
its weight (``weight``, 1 without) times the scale at which its source's words meet the
target, ``most`` times at most.  The integer part of that are whole copies, certain; the
rest p is the probability of one more.  These are a sample of fixed size, measured in
words, drawn without replacement by Pareto order sampling: with u uniform, documents are
ranked by (u / (1 - u)) / (p / (1 - p)), and the smallest ranks are taken until the words
are met.  Where all weights of a source are equal, so are its probabilities.

Nothing is sorted as a whole.  Ranks fall into buckets whose word sums are added up in
two levels; only the bucket per source in which the target is met and the next few are
put in order.  There a document is taken if that brings the words nearer to the target,
else passed over; from the first one passed over on, LOOK documents are looked at.  What remains of the sample is one bucket and a short list of draws per
source, so each document is decided on its own.

Cases: null texts have size 0; a null source is a source, the last; documents without
words take nothing; null or negative weights are 0 and take nothing; rows equal in id and
text share one draw; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bring, n_words, stash, uniform

#: Documents of a bucket, about.
BUCKET_ROWS = 2_000
#: Buckets that are added up first; documents that are looked at from the first one on that is passed over; buckets
#: within which they are sought.
COARSE, LOOK, HORIZON = 1024, 32, 1024


def draw(seed: int) -> Column:
    """Uniform number of a document; depends on its id and text only."""
    return uniform(F.lit(seed), F.col("doc_id"), F.col("text"))


def _source() -> list[Column]:
    """The source as two columns without nulls, so that it can be joined on."""
    return [F.coalesce("source", F.lit("")).alias("_s"), F.col("source").isNull().alias("_none")]


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Targets of all sources from (_s, _none, source_size): one row a source, so one small sort.

    Sources in code-point order take the weights in turn.  A source stops at ``most``
    times its size and its excess goes to the others by weight: sorted by the ratio of
    that limit to the weight, a source stops when the ratio is at most the level that
    the words left over would reach among it and the sources after it.
    """
    order = Window.orderBy("_none", "_s")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    ratio = Window.orderBy("_ratio", "_none", "_s")
    before, onward = ratio.rowsBetween(Window.unboundedPreceding, -1), ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    limit = F.col("source_size").cast("double") * most
    ranked = (sizes.withColumn("weight", w).withColumn("_limit", limit)
              .withColumn("_ratio", F.col("_limit") / F.col("weight"))
              .withColumn("_all", F.sum("source_size").over(everything) * F.lit(float(share))))
    level = (F.col("_all") - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    stopped = ranked.withColumn("_level", level).withColumn("_stops", F.col("_ratio") <= F.col("_level"))
    final = F.min(F.when(~F.col("_stops"), F.struct("_ratio", "_level"))).over(everything)["_level"]
    return (stopped.withColumn("_final", final)
            .select("_s", "_none", "source_size", "weight",
                    F.when(F.col("_stops"), F.col("_limit")).otherwise(F.col("weight") * F.col("_final")).alias("target")))


def _expected(most: Column) -> list[tuple[str, Column]]:
    """Copies, inclusion probability and rank (its odds ratio r as r / (1 + r)) of rows with _w, _u and _scale."""
    times = F.least(most, F.col("_scale") * F.col("_w"))
    rank = F.col("_u") / (1 - F.col("_u")) / (F.col("_p") / (1 - F.col("_p")))
    return [("_times", times), ("copies", F.floor("_times").cast("int")), ("_p", F.col("_times") - F.col("copies")),
            ("_rank", F.when(F.col("_p") > 0, rank / (1 + rank)))]


def _with(df: DataFrame, columns: list[tuple[str, Column]]) -> DataFrame:
    for name, column in columns:
        df = df.withColumn(name, column)
    return df


def _weight(weight: str | None) -> Column:
    return F.lit(1.0) if weight is None else F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0))


def plan_mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0,
             seed: int = 20, bucket_rows: int = BUCKET_ROWS, weight: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Narrow rows (doc_id, _s, _none, size, _u, _w) and a row per source with target, scale and the edge of its sample."""
    rows = stash(docs.select("doc_id", *_source(), n_words(F.col("text")).alias("size"), draw(seed).alias("_u"),
                             _weight(weight).alias("_w")), "sizes")
    key = ["_s", "_none"]
    per_source = rows.groupBy(*key).agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("_w")).alias("_weighed"))
    plan = targets(per_source.drop("_weighed"), weights, share, most).join(per_source.select(*key, "_weighed"), key)
    plan = stash(plan.withColumn("_scale", F.when(F.col("_weighed") > 0, F.col("target") / F.col("_weighed")).otherwise(F.lit(0.0))),
                 "targets")
    n_sources, n_rows = plan.count(), rows.count()
    buckets = max(1, -(-n_rows // bucket_rows))
    placed = _with(bring(rows.where("size > 0"), plan.select(*key, "_scale"), key, rows=n_sources), _expected(F.lit(float(most)))).withColumn(
        "_b", F.floor(F.col("_rank") * buckets))
    # Whole copies and open words of every bucket in one pass; documents without an open chance have no bucket.
    sums = stash(placed.groupBy(*key, "_b").agg(F.sum(F.col("copies") * F.col("size")).alias("_certain"),
                                                F.sum("size").alias("_words"), F.count(F.lit(1)).alias("_n")), "buckets")
    certain = sums.groupBy(*key).agg(F.sum("_certain").alias("_certain"))
    rest = stash(plan.join(certain, key).select(*key, (F.col("target") - F.col("_certain")).alias("_rest")), "rest")
    coarse = F.floor(F.col("_b") / COARSE)

    def edge_of(parts: DataFrame, name: str) -> DataFrame:
        """The last part of each source that begins before the rest is met."""
        before = Window.partitionBy(*key).orderBy(name).rowsBetween(Window.unboundedPreceding, -1)
        begun = parts.withColumn("_before", F.coalesce("_base", F.lit(0)) + F.coalesce(F.sum("_words").over(before), F.lit(0)))
        return stash(bring(begun, rest, key, rows=n_sources).where("_before < _rest").groupBy(*key).agg(
            F.max_by(F.struct(name, "_before"), name).alias("_e")).select(*key, f"_e.{name}", F.col("_e._before").alias("_base")), "edge")
    open_sums = sums.where("_b is not null").withColumn("_c", coarse)
    first = edge_of(open_sums.groupBy(*key, "_c").agg(F.sum("_words").alias("_words")).withColumn("_base", F.lit(None)), "_c")
    edge = edge_of(bring(open_sums, first, [*key, "_c"], rows=n_sources), "_b").withColumnRenamed("_b", "_edge")
    ahead = bring(open_sums, edge, key, rows=n_sources).where((F.col("_b") >= F.col("_edge")) & (F.col("_b") < F.col("_edge") + HORIZON))
    earlier = Window.partitionBy(*key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.sum(F.when(F.col("_b") > F.col("_edge"), F.col("_n"))).over(earlier), F.lit(0))
    edge = stash(ahead.withColumn("_seen", seen).where(F.col("_seen") < LOOK).groupBy(*key).agg(
        F.first("_edge").alias("_edge"), F.first("_base").alias("_base"), F.max("_b").alias("_last")), "edge")
    zone = bring(placed.where("_b is not null"), edge, key, rows=n_sources).where(F.col("_b").between(F.col("_edge"), F.col("_last")))
    one = zone.groupBy(*key, "_rank", "_u").agg(F.sum("size").alias("_words"))
    listed = one.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_rank", "_u", "_words"))).alias("_list"))
    start = F.struct(F.col("_base").cast("double").alias("sum"), F.array().cast("array<double>").alias("took"), F.lit(LOOK).alias("left"))

    def step(state: Column, x: Column) -> Column:
        nearer = (state["sum"] + x["_words"] / 2.0 <= F.col("_rest")) & (state["left"] > 0)
        left = F.when(nearer & (state["left"] == LOOK), state["left"]).otherwise(state["left"] - 1).alias("left")
        return F.when(nearer, F.struct((state["sum"] + x["_words"]).alias("sum"), F.concat(state["took"], F.array(x["_u"])).alias("took"),
                                       left)).otherwise(F.struct(state["sum"].alias("sum"), state["took"].alias("took"), left))
    fold = F.aggregate("_list", start, step)
    takes = listed.join(edge, key).join(rest, key).select(*key, "_edge", "_last", fold["took"].alias("_takes"))
    plan = stash(plan.join(takes, key, "left").select(
        *key, "source_size", "target", "_scale", "_edge", "_last", "_takes", F.lit(buckets).alias("_buckets"), F.lit(float(most)).alias("_most")),
        "plan")
    return rows, plan


def _decided(df: DataFrame, plan: DataFrame) -> DataFrame:
    """Add copies, the one more that the sample gives included, to rows with _s, _none, _u and _w."""
    joined = bring(df, plan, ["_s", "_none"])
    b = F.floor(F.col("_rank") * F.col("_buckets"))
    more = F.when(b < F.col("_edge"), 1).when(b <= F.col("_last"), F.array_contains("_takes", F.col("_u")).cast("int")).otherwise(0)
    placed = _with(joined, _expected(F.col("_most")))
    return placed.withColumn("copies", F.col("copies") + F.coalesce(more, F.lit(0)))


def mix_report(docs: DataFrame, **how) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, copies, taken."""
    rows, plan = plan_mix(docs, **how)
    size = F.col("size")
    return _decided(rows, plan).select(
        "doc_id", F.when(~F.col("_none"), F.col("_s")).alias("source"), "size", "source_size", "target",
        F.when(size > 0, F.col("copies")).otherwise(F.lit(0)).alias("copies"),
        F.when(size > 0, size * F.col("copies")).otherwise(F.lit(0)).cast("long").alias("taken"))


def mix(docs: DataFrame, seed: int = 20, weight: str | None = None, **how) -> DataFrame:
    """The mixed corpus: the rows of ``docs``, each as often as it is taken."""
    _, plan = plan_mix(docs, seed=seed, weight=weight, **how)
    # The row travels as one struct, so its column names cannot clash with those of the plan.
    keyed = docs.select(F.struct("*").alias("_doc"), *_source(), draw(seed).alias("_u"), _weight(weight).alias("_w"),
                        (~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")).alias("_bare"))
    # Documents without words weigh nothing; they stay once.
    times = F.when(F.col("_bare"), F.lit(1)).otherwise(F.col("copies"))
    return (_decided(keyed, plan).withColumn("_times", times).where("_times > 0")
            .select("_doc", F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_i")).select("_doc.*"))
