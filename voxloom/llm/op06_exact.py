"""Exact deduplication as a stateful stream, in DataFrame operations only.

Fingerprints of the documents (SHA-256, identifier, content locator) are written to the
shared folder and read from there as a stream.  A streaming aggregation keeps, per
digest and without expiry, the number of copies and the identifier and locator of the
one that stays, in RocksDB state on the executors' disks whose changes go to the shared
checkpoint folder, so a lost executor restores it.  The final state is read back as a
table and joined to the fingerprints.

A digest seen more than once is a hit: the bytes of every copy are compared with those
of the copy that stays, found by its locator.  Should two texts ever share a digest, the
groups of that digest are formed anew on the texts themselves.

Cases: null counts as empty; the largest doc_id of a group stays, a null id is smallest,
rows equal in id as well are told apart by their locator, so one row of a group stays;
no rows give no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bring, shared_path, stash, whole

#: State on disk, without room set aside in advance: with many partitions each store is small.
STORE = {"spark.sql.streaming.stateStore.providerClass":
         "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
         "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}
#: Bytes of fingerprints that one micro-batch takes in.
BATCH_BYTES = 64 << 30
AT = ["_file", "_row"]


_PLAIN = re.compile(r"[\s:+-]*(Project|Filter|SubqueryAlias|Relation)\b")


def located(docs: DataFrame) -> DataFrame:
    """Add file and row number of each row; only a frame read from files as it is has them, others are stored first."""
    for name in (*AT, "_metadata"):
        if name in docs.columns:
            docs = docs.withColumnRenamed(name, f"{name}_given")
    plan = docs._jdf.queryExecution().analyzed().toString().strip().splitlines()
    if not all(_PLAIN.match(line) for line in plan) or "Relation" not in plan[-1] or "parquet" not in plan[-1]:
        docs = stash(docs, "docs")
    return docs.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))


def _final_state(spark: SparkSession, marks: DataFrame, path: str, per_batch: dict[str, str]) -> DataFrame:
    """Run the stream over the stored fingerprints to their end; the state left behind, as a table."""
    checkpoint = shared_path(spark, "dedup-stream")
    before = {key: spark.conf.get(key, None) for key in STORE}
    for key, value in STORE.items():
        spark.conf.set(key, value)
    try:
        stream = spark.readStream.schema(marks.schema).options(**per_batch).parquet(path)
        kept = stream.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"),
                                            F.max(F.struct("doc_id", *AT)).alias("stays"))
        query = (kept.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint)
                 .trigger(availableNow=True).start())
        query.awaitTermination()
        left = spark.read.format("statestore").option("path", checkpoint).load()
        count, stays = left.schema["value"].dataType.names[:2]
        return stash(left.select(F.col("key.digest").alias("digest"), F.col("value")[count].alias("group_size"),
                                 F.col("value")[stays].alias("_stays")), "state")
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def _decide(docs: DataFrame, per_batch: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Located documents, and per row: doc_id, digest, _file, _row, group_size, _stays."""
    spark = docs.sparkSession
    rows = located(docs)
    digest = F.unhex(F.sha2(whole("text"), 256)).alias("digest")
    path = shared_path(spark, "marks")
    rows.select("doc_id", digest, *AT).write.parquet(path)
    schema = rows.select("doc_id", digest, *AT).schema
    marks = spark.read.schema(schema).parquet(path)
    if marks.isEmpty():
        empty = marks.select("*", F.lit(0).cast("long").alias("group_size"), F.struct("doc_id", *AT).alias("_stays"))
        return rows, empty
    state = _final_state(spark, marks, path, per_batch)
    decided = marks.join(state, "digest")
    hits = state.where("group_size > 1")
    texts = stash(bring(rows.select("doc_id", digest, whole("text").alias("_text"), *AT), hits, ["digest"]), "hits")
    mine = F.struct("doc_id", *AT).eqNullSafe(F.col("_stays"))
    stays = texts.where(mine).select("digest", F.col("_text").alias("_stay_text"))
    clash = texts.where(~mine).join(stays, "digest").where(F.col("_text") != F.col("_stay_text")).select("digest")
    clash = stash(clash.distinct(), "clashes")
    if clash.isEmpty():
        return rows, decided
    odd = rows.select("doc_id", digest, whole("text").alias("_text"), *AT).join(clash, "digest")
    anew = odd.groupBy("digest", "_text").agg(F.count(F.lit(1)).alias("group_size"),
                                              F.max(F.struct("doc_id", *AT)).alias("_stays"))
    apart = odd.join(anew, ["digest", "_text"]).select(*decided.columns)
    return rows, decided.join(clash, "digest", "left_anti").select(*apart.columns).unionByName(apart)


def dedup_report(docs: DataFrame, batch_bytes: int = BATCH_BYTES, batch_files: int | None = None) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256."""
    _, decided = _decide(docs, _per_batch(batch_bytes, batch_files))
    return decided.select("doc_id", F.col("_stays.doc_id").alias("keep_id"), "group_size",
                          F.struct("doc_id", *AT).eqNullSafe(F.col("_stays")).alias("kept"),
                          F.lower(F.hex("digest")).alias("text_sha256"))


def dedup(docs: DataFrame, batch_bytes: int = BATCH_BYTES, batch_files: int | None = None) -> DataFrame:
    """The rows of ``docs`` that stay."""
    rows, decided = _decide(docs, _per_batch(batch_bytes, batch_files))
    stay = decided.where(F.struct("doc_id", *AT).eqNullSafe(F.col("_stays"))).select(*AT)
    kept = rows.join(stay, AT, "left_semi")
    names = [c for c in kept.columns if c not in AT]
    return kept.select(*[F.col(c).alias(g) for c, g in zip(names, docs.columns, strict=True)])


def _per_batch(batch_bytes: int, batch_files: int | None) -> dict[str, str]:
    return {"maxFilesPerTrigger": str(batch_files)} if batch_files else {"maxBytesPerTrigger": str(batch_bytes)}
