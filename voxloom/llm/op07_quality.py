"""Quality by importance resampling: hashed n-gram models of good and of raw text, Gumbel top-k or a threshold.

Texts are cut into tokens: words (letters, digits, everything beyond ASCII) and runs of
other signs; a token equal to the one before it becomes a repeat mark.  Unigrams and
bigrams are hashed into buckets.  The target model counts the buckets in documents
labelled good, the raw model in all documents, each distinct text once (by SHA-256; good if a
copy is); a document's log weight is the sum of log(target / raw) over its n-grams, the same
for every copy.  Adding Gumbel noise and keeping the k largest draws k
documents without replacement in proportion to their weights.

Without a size to draw, each document is decided by itself: it stays if its mean log weight
per n-gram reaches a threshold, however many others do.  The threshold is fitted on the
labelled documents: it has the least sum of the share of good ones lost and the share of bad
ones kept, in the middle of the widest gap that has it.  While it is fitted, a good document's
own n-grams are taken out of the target model.

The raw model counts the whole corpus.  The target model is fitted on at most
``most_labels`` documents labelled good, chosen by hash of the id, the threshold on as many
of either kind.  The k-th largest key is
found by counting keys in ever narrower ranges; nothing is sorted as a whole.

Cases: null and empty texts have weight 0, so noise alone decides, and a mean of 0 for the
threshold; rows equal in id and text share their key, and all rows at the cut stay; labels
without a document, repeated or null change nothing; an id labelled both ways is good;
without good labels nothing is known and everything stays, as it does against the threshold
without bad ones; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, buffers, mixed, slices, stash, stretch_hashes, uniform, whole

BUCKETS = 1 << 14
#: Good documents that the target model is fitted on, at most.
MOST_LABELS = 20_000
#: Keys that the last step of the cut-off search may fetch.
FEW = 10_000

_WORDLIKE = np.zeros(256, bool)
_WORDLIKE[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def features(raw: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams, and the text each belongs to."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = np.where(_BLANK[raw], 0, np.where(_WORDLIKE[raw], 1, 2)).astype(np.int8)
    change = np.concatenate(([True], kind[1:] != kind[:-1]))
    change[offsets[:-1][offsets[:-1] < len(raw)]] = True
    starts = np.flatnonzero(change)
    stops = np.append(starts[1:], len(raw))
    real = kind[starts] > 0
    starts, stops = starts[real], stops[real]
    text = np.searchsorted(offsets, starts, side="right") - 1
    token = stretch_hashes(raw, starts, stops)
    together = text[1:] == text[:-1]
    token[1:][(token[1:] == token[:-1]) & together] = np.uint64(1)
    pair = mixed(token[:-1] * np.uint64(3) + token[1:])[together]
    grams = np.concatenate((mixed(token), pair))
    return (grams % np.uint64(buckets)).astype(np.int64), np.concatenate((text, text[1:][together]))


def _counter(buckets: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw_counts, good_counts = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            raw, offsets = buffers(batch.column("text"))
            good = batch.column("good").to_numpy(zero_copy_only=False)
            for a, b in slices(offsets):
                grams, text = features(raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], buckets)
                raw_counts += np.bincount(grams, minlength=buckets)
                good_counts += np.bincount(grams[good[a:b][text]], minlength=buckets)
        used = np.flatnonzero(raw_counts)
        yield pa.RecordBatch.from_pydict({"bucket": used, "raw": raw_counts[used], "good": good_counts[used]})
    return count


def _scorer(ratio: np.ndarray):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = buffers(batch.column("text"))
            weight, many = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for a, b in slices(offsets):
                grams, text = features(raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], len(ratio))
                weight[a:b] = np.bincount(text, ratio[grams], minlength=b - a)
                many[a:b] = np.bincount(text, minlength=b - a)
            keep = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(weight), pa.array(many)],
                                             [*keep, "log_weight", "n_grams"])
    return score


def _unseen(raw_counts: np.ndarray, target_counts: np.ndarray):
    """Mean log weights of labelled texts; a good one is held against the target model without itself."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = len(raw_counts)
        base, total = np.log(raw_counts / raw_counts.sum()), target_counts.sum()
        for batch in batches:
            raw, offsets = buffers(batch.column("text"))
            good = batch.column("good").to_numpy(zero_copy_only=False)
            mean = np.zeros(batch.num_rows)
            for a, b in slices(offsets):
                grams, text = features(raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], buckets)
                pairs, times = np.unique(text * buckets + grams, return_counts=True)
                text, gram = pairs // buckets, pairs % buckets
                many = np.bincount(text, times, minlength=b - a)
                own = good[a:b][text]
                weight = np.log((target_counts[gram] - own * times) / (total - own * many[text])) - base[gram]
                mean[a:b] = np.bincount(text, times * weight, minlength=b - a) / np.maximum(many, 1)
            keep = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(mean)], [*keep, "mean"])
    return score


def known(labels: DataFrame, most_labels: int = MOST_LABELS) -> DataFrame:
    """doc_id and good: labelled documents, at most ``most_labels`` of either kind."""
    each = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"))
    kinds = [each.where(F.col("good") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labels) for kind in (True, False)]
    return kinds[0].unionByName(kinds[1])


def distinct_texts(rows: DataFrame, labels: DataFrame, most_labels: int = MOST_LABELS) -> tuple[DataFrame, DataFrame]:
    """Of located rows: (text, good) of each distinct text, and (text, good) of each distinct labelled one.

    Copies meet as digests only.  While the repeated texts are few they are broadcast and the
    texts stay where they are; beyond, each text meets the place of the copy that counts.
    """
    from .op06_exact import AT
    # A place's number tells copies apart; should two copies share one, both count.
    mark = rows.select("doc_id", "text", F.unhex(F.sha2(whole("text"), 256)).alias("digest"), F.xxhash64(*AT).alias("place"))
    marked = mark.join(F.broadcast(known(labels, most_labels)), "doc_id", "left")
    once = stash(marked.groupBy("digest").agg(
        F.min("place").alias("place"), F.coalesce(F.max("good"), F.lit(False)).alias("good"),
        F.count("good").alias("known"), F.count(F.lit(1)).alias("copies")), "texts")
    several = once.where("copies > 1").select("digest", F.col("place").alias("_first"), F.col("good").alias("_good"),
                                              F.col("known").alias("_known"))
    if several.count() <= BROADCAST_ROWS:
        first = marked.join(F.broadcast(several), "digest", "left").where("_first is null or _first = place").select(
            "text", F.coalesce("_good", "good", F.lit(False)).alias("good"),
            (F.coalesce("_known", F.lit(0)) + F.col("good").isNotNull().cast("int") > 0).alias("known"))
    else:
        first = mark.join(once, ["digest", "place"]).select("text", "good", (F.col("known") > 0).alias("known"))
    return first.select("text", "good"), first.where("known").select("text", "good")


def fit(texts: DataFrame, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray] | None:
    """Counts of each bucket in the raw and in the target model, from 1 on; None without a good text."""
    counted = (texts.select("text", "good").mapInArrow(_counter(buckets), "bucket long, raw long, good long")
               .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).toPandas())
    raw, target = np.ones(buckets), np.ones(buckets)
    raw[counted["bucket"]] += counted["raw"]
    target[counted["bucket"]] += counted["good"]
    return (raw, target) if counted["good"].sum() else None


def threshold(labelled: DataFrame, raw: np.ndarray, target: np.ndarray) -> float:
    """Least mean log weight of a document that stays; minus infinity where the labels tell nothing."""
    means = labelled.select("good", "text").mapInArrow(_unseen(raw, target), "good boolean, mean double")
    steps = means.groupBy(F.round("mean", 3).alias("mean")).agg(
        F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")).toPandas().sort_values("mean")
    return best_cut(steps["mean"].to_numpy(), steps["good"].to_numpy(), steps["bad"].to_numpy())


def best_cut(mean: np.ndarray, good: np.ndarray, bad: np.ndarray) -> float:
    """Of ascending means and how many good and bad ones have each: the cut that loses and passes the least."""
    if not good.sum() or not bad.sum():
        return float("-inf")
    wrong = np.cumsum(good)[:-1] / good.sum() + 1 - np.cumsum(bad)[:-1] / bad.sum()
    if not len(wrong) or wrong.min() >= 1:
        return float("-inf")
    least = np.flatnonzero(np.isclose(wrong, wrong.min(), rtol=0, atol=1e-12))
    at = least[np.argmax(mean[least + 1] - mean[least])]
    return float(mean[at] + mean[at + 1]) / 2


def kth_largest(keys: DataFrame, k: int, few: int = FEW) -> float:
    """The k-th largest ``key``, by counts in ranges that narrow until few keys are left."""
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    bins = 4096
    while True:
        inside = keys.where((F.col("key") >= low) & (F.col("key") <= high)).select("key")
        if low == high:
            return low
        step = (high - low) / bins
        b = F.least(F.floor((F.col("key") - low) / step), F.lit(bins - 1)).alias("b")
        found = inside.groupBy(b).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        for row in sorted(found.collect(), key=lambda r: -r["b"]):
            if k <= row["n"]:
                low, high, n = row["lo"], row["hi"], row["n"]
                break
            k -= row["n"]
        if n <= few:
            last = keys.where((F.col("key") >= low) & (F.col("key") <= high)).select("key").toPandas()["key"]
            return float(np.sort(last.to_numpy())[::-1][k - 1])


def weigh(docs: DataFrame, raw: np.ndarray, target: np.ndarray, seed: int = 7, also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns ``also``, log_weight, n_grams and key (log weight plus Gumbel noise), stored."""
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    noise = -F.log(-F.log(uniform(F.lit(seed), F.col("doc_id"), F.col("text"))))
    rows = docs.select("doc_id", *also, noise.alias("_noise"), "text")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    scored = rows.mapInArrow(_scorer(ratio), f"{kinds}, log_weight double, n_grams long")
    return stash(scored.select("doc_id", *also, "log_weight", "n_grams", (F.col("log_weight") + F.col("_noise")).alias("key")), "weights")


def share_of_good(labels: DataFrame) -> float:
    row = labels.where("quality is not null").agg(F.avg((F.col("quality") == 1).cast("double"))).first()
    return row[0] or 0.0


def _decided(rows: DataFrame, labels: DataFrame, keep_share: float | None, seed: int = 7, buckets: int = BUCKETS,
             most_labels: int = MOST_LABELS, also: tuple[str, ...] = ()) -> DataFrame | None:
    """The weights of located rows and whether each stays; None without a good document."""
    texts, labelled = distinct_texts(rows, labels, most_labels)
    model = fit(texts, buckets)
    if model is None:
        return None
    keys = weigh(rows, *model, seed, also)
    if keep_share is None:
        mean = F.col("log_weight") / F.greatest("n_grams", F.lit(1))
        return keys.withColumn("stays", mean >= F.lit(threshold(labelled, *model)))
    k = round(keys.count() * keep_share)
    return keys.withColumn("stays", F.col("key") >= F.lit(kth_largest(keys, k) if k else float("inf")))


def resample(docs: DataFrame, labels: DataFrame, keep_share: float | None = None, **how) -> DataFrame:
    """doc_id, log_weight, key of the rows that stay: a sample of ``keep_share`` of all rows, else those that reach the threshold."""
    from .op06_exact import located
    decided = _decided(located(docs.select("doc_id", "text")), labels, keep_share, **how)
    if decided is None:
        return docs.select("doc_id", F.lit(0.0).alias("log_weight"), F.lit(0.0).alias("key"))
    return decided.where("stays").select("doc_id", "log_weight", "key")


def quota_sample(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The sample whose size is the labels' share of good documents of all rows."""
    return resample(docs, labels, share_of_good(labels), **how)


def accept(docs: DataFrame, labels: DataFrame, keep_share: float | None = None, **how) -> DataFrame:
    """The rows of ``docs`` that stay; each row meets its own weight again by its place."""
    from .op06_exact import AT, located
    rows = located(docs)
    decided = _decided(rows, labels, keep_share, also=tuple(AT), **how)
    if decided is None:
        return docs
    kept = rows.join(decided.where(~F.col("stays")).select(*AT), AT, "left_anti")
    names = [c for c in kept.columns if c not in AT]
    return kept.select(*[F.col(c).alias(g) for c, g in zip(names, docs.columns, strict=True)])
