"""Session settings and the two helpers that every iterative operator needs.

``cut`` ends a lineage with a *reliable* checkpoint, so a lost executor never
forces a recomputation of the whole history.  ``attach`` joins a small
per-key table back to a large frame: it measures the small side first, and only
broadcasts it under a row bound; above the bound it leaves the join to adaptive
execution, which splits hot keys.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 500_000


def build_session(app: str = "voxloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names; make one only for a local session."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="voxloom-ckpt-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and drop its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    done = df.checkpoint(eager=True)
    done._materialised = True
    return done


def bounded(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """Materialise a summary once (unless it already is); say whether it may be broadcast."""
    small = df if getattr(df, "_materialised", False) else cut(df)
    if not hasattr(small, "_rows"):
        small._rows = small.count()
    return small, small._rows <= max_rows


def attach(df: DataFrame, per_key: DataFrame, on: list[str], how: str = "inner",
           max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join a per-key summary to a large frame without moving the large side.

    The summary is computed once and counted.  Within ``max_rows`` it is
    broadcast; beyond that the plain equi-join is left to adaptive execution.
    """
    small, fits = bounded(per_key, max_rows)
    return df.join(F.broadcast(small) if fits else small, on, how)
