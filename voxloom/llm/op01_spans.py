"""Substring deduplication over sliding runs of sentences, in DataFrame operations.

Texts are cut into sentences behind ``. ! ?`` and at line ends; the pieces put together
are the text again.  From every sentence starts one run: the fewest sentences, two at
least, that reach ``least_chars`` signs; a single sentence of ``long_chars`` is a run by
itself.  With ``both_ends``, as the query has it, a long sentence also starts a run with its
neighbours, and at every sentence ends one too: the fewest, two at least, that reach
``least_chars``.  Then every sentence of a repeated stretch of two or more sentences and
``least_chars`` signs lies in a run that does not leave the stretch.  Equal runs anywhere share a hash of 128 bits.  Of each repeated run the first
place in the order of (doc_id, sentence) stays; sentences under any other are removed.

Runs meet in an aggregation on 64 bits that counts before it shuffles, so a run that
every third document holds is a few rows.  Only runs seen twice go further.

Cases: null texts have no sentences and stay null; sentences are compared without the
white space around them; a run repeated inside one document is removed from its second
place on; rows that repeat an id count as one document, so the same run at the same place
in them is one place; a null id is the smallest; a text that loses all its sentences is
empty; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

#: Behind the white space that follows a full stop, and at the start of lines.
BORDER = r"(?<=[.!?]\s{1,8})(?!\s)|(?<=\n)(?!\s)"
BLANK = " \t\n\r\f\v"
LEAST_CHARS, LONG_CHARS = 120, 240
#: Sentences that are looked at first for the end of a run.
NEAR = 6


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, BORDER), lambda s: s != "")


def runs(docs: DataFrame, least_chars: int = LEAST_CHARS, long_chars: int = LONG_CHARS, both_ends: bool = False) -> DataFrame:
    """Runs of all documents: doc_id, first and last sentence, two hashes."""
    cut = docs.where("text is not null").select("doc_id", F.transform(sentences(F.col("text")), lambda s: F.btrim(s, F.lit(BLANK))).alias("_s"))
    # Per sentence its length and hashes; then, per start, the running length decides where runs end.
    marks = cut.select("doc_id", F.transform("_s", lambda s: F.struct(
        F.length(s).alias("n"), F.xxhash64(s).alias("a"), F.xxhash64(F.lit("b"), s).alias("b"))).alias("_m"))
    if both_ends:    # a run from i ends where it is the first of its start, or the last start of its end
        done = f"{{r}}.last > i AND {{r}}.n - m.n >= {least_chars}"
        ends = f"(r.last = i OR r.n < {least_chars} OR r.n + x.n - m.n < {least_chars})"
    else:
        done, ends = "size({r}.runs) > 0", "true"
    none = ("named_struct('last', i - 1, 'n', 0, 'a', cast(0 as bigint), 'b', cast(0 as bigint), "
            "'runs', cast(array() as array<struct<first:int,last:int,a:bigint,b:bigint>>))")
    step = (f"(r, x) -> CASE WHEN {done.format(r='r')} THEN r ELSE named_struct('last', r.last + 1, 'n', r.n + x.n, "
            "'a', xxhash64(r.a, x.a), 'b', xxhash64(r.b, x.b), 'runs', "
            f"CASE WHEN (r.last < i AND x.n >= {long_chars}) OR (r.last >= i AND r.n + x.n >= {least_chars} AND {ends}) THEN "
            "concat(r.runs, array(named_struct('first', i, 'last', r.last + 1, 'a', xxhash64(r.a, x.a), 'b', xxhash64(r.b, x.b)))) "
            "ELSE r.runs END) END")
    # Most runs end within a few sentences; only the others look further.
    near = f"aggregate(slice(_m, i + 1, {NEAR}), {none}, {step})"
    far = f"aggregate(slice(_m, i + 1 + {NEAR}, {_reach(least_chars)}), q, {step})"
    found = (f"transform(_m, (m, i) -> transform(array({near}), q -> CASE WHEN ({done.format(r='q')}) OR i + {NEAR} >= size(_m) "
             f"THEN q ELSE {far} END)[0].runs)")
    return marks.select("doc_id", F.explode(F.flatten(F.expr(found))).alias("r")).select("doc_id", "r.*")


def _reach(least_chars: int) -> int:
    """Sentences that a run may need: each but blank ones has a sign, and blank lines are no sentences."""
    return least_chars + 2


def repeats(docs: DataFrame, **how) -> DataFrame:
    """Runs that are not the first of their kind: doc_id, first, last, first_doc_id."""
    found = stash(runs(docs, **how), "runs")
    often = found.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a")
    hits = stash(found.join(often, "a"), "repeats")
    holder = hits.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc_id"),
                                        F.count("doc_id").alias("_known"))
    holder = holder.where("n > 1").select("a", "b", F.when(F.col("n") == F.col("_known"), F.col("first_doc_id")).alias("first_doc_id"))
    placed = hits.join(holder, ["a", "b"])
    own = F.col("doc_id").eqNullSafe(F.col("first_doc_id"))
    place = placed.where(own).groupBy("a", "b").agg(F.min("first").alias("_place"))
    return (placed.join(place, ["a", "b"]).where(~own | (F.col("first") != F.col("_place")))
            .select("doc_id", "first", "last", "first_doc_id"))


def removed_ranges(docs: DataFrame, **how) -> DataFrame:
    """Runs of removed sentences that touch, as one: doc_id, sentence_from, sentence_to, first_doc_id."""
    spans = repeats(docs, **how).groupBy("doc_id", "first").agg(F.max("last").alias("last"), F.min("first_doc_id").alias("first_doc_id"))
    in_doc = Window.partitionBy("doc_id").orderBy("first")
    upto = F.max("last").over(in_doc.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("_new", F.coalesce((F.col("first") > upto + 1).cast("int"), F.lit(1)))
    numbered = marked.withColumn("_i", F.sum("_new").over(in_doc.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("doc_id", "_i").agg(
        F.min("first").alias("sentence_from"), F.max("last").alias("sentence_to"),
        F.min("first_doc_id").alias("first_doc_id")).drop("_i")


def remove_repeats(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` with the sentences of repeated runs taken out of ``text``."""
    ranges = removed_ranges(docs, **how).groupBy(F.col("doc_id").alias("_id")).agg(
        F.collect_list(F.struct("sentence_from", "sentence_to")).alias("_cut"))
    kept = F.filter(sentences(F.col("_doc.text")), lambda s, i: ~F.exists(
        F.col("_cut"), lambda r: (r["sentence_from"] <= i) & (i <= r["sentence_to"])))
    text = F.when(F.col("_cut").isNull(), F.col("_doc.text")).otherwise(F.array_join(kept, ""))
    # The row travels as one struct, so its column names cannot clash.
    joined = docs.select(F.struct("*").alias("_doc")).join(ranges, F.col("_doc.doc_id").eqNullSafe(F.col("_id")), "left")
    return joined.select(*[text.alias("text") if c == "text" else F.col("_doc")[c].alias(c) for c in docs.columns])
