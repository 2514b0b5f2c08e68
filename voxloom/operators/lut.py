"""Two-dimensional intensity x gradient tables: counts, probabilities, application."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.functions.voxel import hist_bin
from voxloom.session import BROADCAST_ROWS


@dataclass(frozen=True)
class LutSpec:
    """Bin layout. The table never exceeds ``ibins * gbins`` rows, so it may be broadcast."""
    ibins: int = 256
    gbins: int = 128
    imin: float = -1100.0
    imax: float = -600.0
    gmax: float = 300.0


def lut_counts(vox: DataFrame, label: Column, spec: LutSpec = LutSpec(), value: str = "value",
               grad: str = "grad") -> DataFrame:
    """Joint histogram; map-side partial sums shrink any input to at most the table size."""
    return vox.groupBy(hist_bin(F.col(grad), 0.0, spec.gmax, spec.gbins).alias("gbin"),
                       hist_bin(F.col(value), spec.imin, spec.imax, spec.ibins).alias("ibin")).agg(
        F.sum(label.cast("long")).alias("airway"), F.count(F.lit(1)).alias("total"))


def lut_merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Counts are additive: merging two runs equals counting both inputs at once."""
    return a.unionByName(b).groupBy("gbin", "ibin").agg(
        F.sum("airway").alias("airway"), F.sum("total").alias("total"))


def lut_probability(counts: DataFrame, min_total: int = 20) -> DataFrame:
    return counts.select("gbin", "ibin", "airway", "total", F.when(
        F.col("total") >= min_total, F.col("airway") / F.col("total").cast("double"))
        .otherwise(F.lit(0.0)).alias("prob"))


def lut_apply(vox: DataFrame, lut: DataFrame, spec: LutSpec = LutSpec(), value: str = "value",
              grad: str = "grad") -> DataFrame:
    """Bilinear look-up; adds ``p``.

    Bins are filled by truncation but read between bin starts, so a reading is half a
    bin off the bin centre; that is the defined behaviour.
    """
    def axis(v: Column, lo: float, hi: float, n: int, name: str) -> list[Column]:
        pos = F.least(F.greatest((v - F.lit(lo)) / F.lit(hi - lo) * F.lit(float(n)), F.lit(0.0)), F.lit(float(n)))
        b0 = F.least(F.floor(pos).cast("int"), F.lit(n - 1))
        return [b0.alias(f"_{name}0"), F.least(b0 + 1, F.lit(n - 1)).alias(f"_{name}1"),
                (pos - F.floor(pos)).alias(f"_{name}f")]

    base = vox.columns
    out = vox.select("*", *axis(F.col(value), spec.imin, spec.imax, spec.ibins, "i"),
                     *axis(F.col(grad), 0.0, spec.gmax, spec.gbins, "g"))
    corners = [(g, i) for g in "01" for i in "01"]
    if spec.ibins * spec.gbins <= BROADCAST_ROWS:
        out = out.join(F.broadcast(packed(lut, spec)))       # one row
        p = {g + i: F.get("_table", F.col(f"_g{g}") * spec.ibins + F.col(f"_i{i}")) for g, i in corners}
    else:
        for g, i in corners:
            corner = lut.select(F.col("gbin").alias(f"_g{g}"), F.col("ibin").alias(f"_i{i}"), F.col("prob").alias(f"_p{g}{i}"))
            out = out.join(corner, [f"_g{g}", f"_i{i}"], "left")
        p = {g + i: F.coalesce(F.col(f"_p{g}{i}"), F.lit(0.0)) for g, i in corners}
    i, g = F.col("_if"), F.col("_gf")
    return out.select(*base, ((p["00"] * (1 - i) + p["01"] * i) * (1 - g)
                              + (p["10"] * (1 - i) + p["11"] * i) * g).alias("p"))


def packed(lut: DataFrame, spec: LutSpec) -> DataFrame:
    """The whole table as one row ``_table``: probabilities by ``gbin * ibins + ibin``, 0 where a bin is missing."""
    bins = lut.sparkSession.range(spec.ibins * spec.gbins).withColumnRenamed("id", "bin")
    filled = bins.join(lut.select((F.col("gbin").cast("long") * spec.ibins + F.col("ibin")).alias("bin"), "prob"), "bin", "left")
    entry = F.struct("bin", F.coalesce("prob", F.lit(0.0)).alias("prob"))
    return filled.agg(F.sort_array(F.collect_list(entry)).alias("_t")).select(
        F.transform("_t", lambda e: e["prob"]).alias("_table"))


def update_store(spark, path: str, fresh: DataFrame, run: str | None = None) -> None:
    """Accumulate counts over runs, each in a folder of its own.

    A failed job leaves earlier counts intact; a run that is repeated under its name
    replaces itself, so it counts once.  Readers sum the runs.
    """
    fresh.write.mode("overwrite").parquet(f"{path.rstrip('/')}/run={run or uuid.uuid4().hex}")


def read_store(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("gbin", "ibin").agg(
        F.sum("airway").alias("airway"), F.sum("total").alias("total"))
