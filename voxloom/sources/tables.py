"""Table loading and the frames derived from the driver tables.

Three layouts are used throughout the package:

* slice rows  ``case_id, z, nx, ny, nz, data ARRAY`` - storage and stencils,
* voxel rows  ``case_id, x, y, z, nx, ny, nz, <value>`` - pointwise algebra,
* run rows    ``case_id, z, y, x0, x1, nx, ny, nz`` - masks (see ``operators.runs``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DIMS = ["nx", "ny", "nz"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def number_within(df: DataFrame, group: str, order: str, out: str, total: str,
                  chunk: int = 4096) -> DataFrame:
    """Zero-based position of each row in its group, without one task per group.

    Ids are cut into fixed-width chunks.  Chunk sizes are counted (partial
    aggregation), running sums over the few chunk rows give each chunk its base,
    and only rows of one chunk are ever ordered together, so a group that holds a
    third of all rows is still spread over many tasks.
    """
    chunked = df.withColumn("_chunk", F.expr(f"{order} div {chunk}"))
    sizes = chunked.groupBy(group, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(
        group, "_chunk",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"),
        F.sum("_n").over(Window.partitionBy(group)).alias(total))
    inside = Window.partitionBy(group, "_chunk").orderBy(order)
    return (chunked.join(bases, [group, "_chunk"])
            .withColumn(out, (F.col("_base") + F.row_number().over(inside) - 1).cast("int"))
            .withColumn(total, F.col(total).cast("int"))
            .drop("_chunk", "_base"))


def slices_from_embeddings(embeddings: DataFrame, side: int = 8) -> DataFrame:
    """Read each ``side*side`` vector as one slice of the volume named by its label."""
    rows = number_within(
        embeddings.select(F.col("label").alias("case_id"), "vec_id", "embedding"),
        "case_id", "vec_id", "z", "nz")
    hu = F.transform("embedding", lambda v: (F.floor(v.cast("double") * 400.0) - 500).cast("int"))
    return rows.select("case_id", "z", F.lit(side).alias("nx"), F.lit(side).alias("ny"), "nz",
                       hu.alias("data"))


def to_voxels(slices: DataFrame, value: str = "hu", data: str = "data",
              keep: tuple[str, ...] = ()) -> DataFrame:
    """Explode slice rows; array access and decoding stay inside generated code."""
    return (slices.select("case_id", "z", *DIMS, *keep, F.posexplode(data).alias("_p", value))
            .select("case_id",
                    (F.col("_p") % F.col("nx")).cast("int").alias("x"),
                    F.expr("cast(_p div nx as int)").alias("y"),
                    "z", *DIMS, *keep, value))


def to_slices(vox: DataFrame, value: str = "value", keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """Voxel rows of dense slices back to slice rows; a group is one slice."""
    cell = F.struct((F.col("y") * F.col("nx") + F.col("x")).alias("p"), F.col(value).alias("v"))
    return (vox.groupBy(*keys, "z", *DIMS).agg(F.sort_array(F.collect_list(cell)).alias("_c"))
            .select(*keys, "z", *DIMS, F.transform("_c", lambda c: c["v"]).alias("data")))


def register_views(**frames: DataFrame) -> None:
    """Make frames available to SQL by name."""
    for name, frame in frames.items():
        frame.createOrReplaceTempView(name)


def volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slices_from_embeddings(table(spark, sf_dir, "embeddings"))


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_voxels(volume(spark, sf_dir))


def prob_of(hu: Column) -> Column:
    """Stand-in probability, exact in float: (hu + 720) / 512."""
    return ((hu + 720) / F.lit(512.0)).cast("float")


def with_prob(vox: DataFrame) -> DataFrame:
    return vox.withColumn("prob", prob_of(F.col("hu")))


def truth_of(hu: Column, x: Column, y: Column) -> Column:
    return (hu <= -540) & x.between(1, 6) & y.between(1, 6)


def case_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-case, per-series score and time: the shape of a result table.

    Line items are reduced per order before the join, so the wide fact table is
    partially aggregated ahead of its only shuffle.
    """
    per_order = (table(spark, sf_dir, "lineitem")
                 .groupBy("l_orderkey", F.col("l_returnflag").alias("series"))
                 .agg(F.count(F.lit(1)).alias("n"),
                      F.sum(F.round(F.col("l_discount") * 100).cast("long")).alias("d"),
                      F.sum(F.round("l_quantity").cast("long")).alias("q")))
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"),
        (F.col("o_custkey") % 120).cast("int").alias("case_id"))
    return (per_order.join(orders, "l_orderkey")
            .groupBy("case_id", "series")
            .agg(F.sum("n").alias("n"), F.sum("d").alias("d"), F.sum("q").alias("q"))
            .select("case_id", "series", "n",
                    F.round(1 - F.col("d") / (100.0 * F.col("n")), 4).alias("dice"),
                    (F.col("q") / F.col("n").cast("double")).alias("total_s")))
