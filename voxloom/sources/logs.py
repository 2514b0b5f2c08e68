"""Run logs and small text tables to typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The labels printed in a run log and the column each one fills.
TIMINGS = {
    "load": "load_s",
    "mpi part": "mpi_part_s",
    "gpu filter": "gpu_filter_s",
    "gather": "gather_s",
    "onnx infer": "infer_s",
    "region grow": "region_grow_s",
    "write": "write_s",
    "eval (dice)": "eval_s",
    "other/sync": "other_s",
    "TOTAL": "total_s",
}

CASE_DIMS = T.StructType([T.StructField(c, T.IntegerType()) for c in ("Case_ID", "nx", "ny", "nz")])
NEURAL_RESULTS = T.StructType(
    [T.StructField("Case_ID", T.IntegerType())]
    + [T.StructField(c, T.DoubleType()) for c in (
        "Dice_Score", "Load_Time", "MPI_Part_Time", "GPU_Filter_Time", "Gather_Time", "ONNX_Infer_Time",
        "Region_Grow_Time", "Write_Time", "Eval_Time", "Total_Time")])
CLASSICAL_RESULTS = T.StructType(
    [T.StructField("case", T.IntegerType()), T.StructField("nz", T.IntegerType()), T.StructField("method", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in (
        "load_s", "mpi_part_s", "gpu_filter_s", "gather_s", "region_grow_s", "write_s", "eval_s", "other_s",
        "total_s", "dice")]
    + [T.StructField("pred_voxels", T.LongType()), T.StructField("gt_voxels", T.LongType())])


def read_results(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Case table as CSV; the id column is called ``case_id`` whatever the file says."""
    df = spark.read.schema(schema).csv(path, header=True)
    return df.withColumnRenamed(schema.names[0], "case_id")


def write_results(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """One row per log file: ``path`` and whole ``text``."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def case_of(path: Column) -> Column:
    """Case number in a file name: the digits behind its last underscore.  A name without one is an error, not a null id."""
    tail = F.substring_index(F.element_at(F.split(path, "/"), -1), "_", -1)
    number = F.split(tail, r"\D")[0].try_cast("int")
    return F.when(number.isNotNull(), number).otherwise(F.raise_error(F.concat(F.lit("no case number in "), path)).cast("int"))


def settings(text: Column) -> Column:
    """Every ``name=value`` of a text, in order."""
    each = F.filter(F.split(text, r"\s+"), lambda w: F.contains(w, F.lit("=")))
    return F.transform(each, lambda w: F.struct(F.substring_index(w, "=", 1).alias("name"),
                                                F.substring_index(w, "=", -1).alias("value")))


def measures(text: Column) -> Column:
    """Every line ``label : number …`` of a text, in order."""
    lines = F.filter(F.split(text, "\n"), lambda line: F.contains(line, F.lit(":")))
    return F.transform(lines, lambda line: F.struct(
        F.trim(F.substring_index(line, ":", 1)).alias("name"),
        F.split(F.trim(F.substring_index(line, ":", -1)), r"\s+")[0].alias("value")))


def last(entries: Column, name: str) -> Column:
    """The value last given to a name, as text; null if there is none."""
    return F.try_element_at(F.filter(entries, lambda e: e["name"] == name), F.lit(-1))["value"]


def parse_logs(logs: DataFrame, keys: list[str], drop_failed: bool = True) -> DataFrame:
    """Scores, sizes and stage seconds from log text.

    A text is read as two lists, of settings and of measures; the columns are looked up
    in them and the last value of a name counts.  A value that is no number is null.  A
    log with a score or a total is kept, one with neither is dropped.
    """
    read = logs.select(*keys, settings(F.col("text")).alias("_set"), measures(F.col("text")).alias("_measured"))
    size = F.get(F.split(last(F.col("_set"), "dims"), "x"), 2)
    out = read.select(
        *keys, last(F.col("_set"), "Dice").try_cast("double").alias("dice"), size.try_cast("int").alias("nz"),
        last(F.col("_set"), "pred").try_cast("long").alias("pred_voxels"),
        last(F.col("_set"), "gt").try_cast("long").alias("gt_voxels"),
        *[last(F.col("_measured"), label).try_cast("double").alias(c) for label, c in TIMINGS.items()])
    return out.where(F.col("total_s").isNotNull() | F.col("dice").isNotNull()) if drop_failed else out


def ablation_means(parsed: DataFrame, config: str) -> DataFrame:
    """Per configuration: mean inference, mean total, mean score (missing values ignored)."""
    return parsed.groupBy(config).agg(F.avg("infer_s").alias("mean_infer_s"), F.avg("total_s").alias("mean_total_s"),
                                      F.avg("dice").alias("mean_dice"))


def monitor_stats(lines: DataFrame, sm: int = 2, mem: int = 3) -> DataFrame:
    """Mean and peak utilisation from a whitespace-separated monitor log (``value`` lines)."""
    parts = F.split(F.trim("value"), r"\s+")
    busy = F.get(parts, sm)
    rows = lines.where(~F.col("value").startswith("#") & busy.rlike(r"^[0-9]+$")).select(
        busy.cast("double").alias("sm"), F.coalesce(F.get(parts, mem).try_cast("double"), F.lit(0.0)).alias("mem"))
    return rows.agg(F.avg("sm").alias("sm_mean"), F.max("sm").alias("sm_max"), F.avg("mem").alias("mem_mean"))


def write_history(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType([T.StructField("epoch", T.IntegerType()), T.StructField("loss", T.DoubleType()),
                           T.StructField("val_dice", T.DoubleType())])
    return spark.read.schema(schema).json(path, multiLine=True)
