"""Operator 9 (native): mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a seeded shuffled order, repeated as often as `repeats`
allows. A document's virtual finish time is its source's cumulative size divided by the source's target;
all queues together are sorted by it and cut where the sizes add up to the budget. Each source then has
about its target, whatever prefix of the mix is read.

The order within a source and the global order are both range sorts dealt out in even buckets: prefix
sums come from bucket totals (a small table) and a window inside each bucket, so neither a hot source nor
the whole corpus meets in one task. Only the cut itself, one row, goes through the driver.

Defined results: a null text has size 0; null is a source of its own, after all others. Sources without
words have target 0 and nothing taken. The order is by md5 of seed, doc_id and text; rows that repeat
entirely stand at the same place and are taken together. An empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from .common import materialise

#: Documents of the largest source in a bucket of the shuffled order, and entries in one of the global order, on average.
BUCKET_ROWS = 4096
#: Slots of the global order whose totals are summed in one window.
GROUP_SLOTS = 4096


def word_count(text: Column) -> Column:
    """Runs of bytes other than the blank and U+0009 to U+000D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """Sorts by code point, null last, and joins null with null."""
    return F.struct(source.isNull().alias("missing"), F.coalesce(source, F.lit("")).alias("name"))


def source_targets(totals: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, repeats: int = 2) -> DataFrame:
    """Adds `target` to a table (src, source_size): the budget dealt out by weight, no target above
    `repeats` times its source, the excess dealt out again by weight until none is above.

    Sources fill up in the order of capacity by weight, so one running sum finds those that are full. The
    windows run over one row for each source.
    """
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.pmod(F.row_number().over(Window.orderBy("src")) - 1, F.lit(len(weights))) + 1).cast("int"))
    by_level = Window.orderBy("level", "src")
    full, open_, whole = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    line = (
        totals.withColumn("weight", weight).withColumn("cap", F.col("source_size") * repeats).withColumn("level", F.col("cap") / F.col("weight"))
        .withColumn("at", (F.sum("source_size").over(whole) * share - F.coalesce(F.sum("cap").over(full), F.lit(0))) / F.sum("weight").over(open_))
        .withColumn("line", F.min(F.when(F.col("level") >= F.col("at"), F.struct("level", "src", "at"))).over(whole)["at"])
    )
    return line.withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce(F.col("line") * F.col("weight"), F.col("cap")))).drop("weight", "cap", "level", "at", "line")


def first_over(sums: DataFrame, key: str, before: int, budget: float) -> Row | None:
    """(key, before) of the first row of (key, words) by key at which the words add up to more than the budget."""
    running = sums.withColumn("upto", F.sum("words").over(Window.orderBy(key)) + before)
    return running.where(F.col("upto") > budget).orderBy(key).select(key, (F.col("upto") - F.col("words")).alias("before")).first()


def weighted_mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, repeats: int = 2, seed: int = 13) -> DataFrame:
    """(doc_id, source, text_md5, size, source_size, target, finish, copies) for each document.

    finish is the virtual finish time of the first copy; each further copy's is later by source_size / target.
    copies is how often the mix takes the document.
    """
    text_md5 = F.coalesce(F.md5(F.col("text").cast("binary")), F.lit(""))
    rows = materialise(
        docs.select("doc_id", "source", source_key(F.col("source")).alias("src"), text_md5.alias("text_md5"), word_count(F.col("text")).alias("size"))
        .withColumn("key", F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.col("text_md5")).cast("binary")))
    )
    totals = rows.groupBy("src").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    targets = materialise(source_targets(totals, weights, share, repeats))
    facts = targets.agg(F.sum("source_size").alias("words"), F.max("n").alias("largest"), F.sum("n").alias("docs")).first()
    budget, buckets, slots = (facts["words"] or 0) * share, -(-(facts["largest"] or 1) // BUCKET_ROWS), -(-(facts["docs"] or 1) * repeats // BUCKET_ROWS)

    bucket = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / float(1 << 32) * buckets)
    dealt = rows.withColumn("bucket", bucket)
    before = dealt.groupBy("src", "bucket").agg(F.sum("size").alias("words")).withColumn(
        "before", F.coalesce(F.sum("words").over(Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).join(targets.drop("n"), "src").drop("words")
    inside = dealt.withColumn("inside", F.sum("size").over(Window.partitionBy("src", "bucket").orderBy("key")))
    queued = materialise(
        inside.join(before, ["src", "bucket"])
        .withColumn("finish", F.when(F.col("target") > 0, (F.col("before") + F.col("inside")) / F.col("target")))
        .select("doc_id", "source", "src", "key", "text_md5", "size", "source_size", "target", "finish", (F.col("before") + F.col("inside")).alias("done"))
    )

    def place(copy: int) -> Column:
        return F.struct(((F.col("done") + F.col("source_size") * copy) / F.col("target")).alias("finish"), F.col("src"), F.col("key"))

    entries = queued.where(F.col("target") > 0).select(F.explode(F.array(*(place(c) for c in range(repeats)))).alias("place"), "size").withColumn("slot", F.floor(F.col("place.finish") * slots))
    # the slot in which the budget ends: first among groups of slots, then inside one group
    sums = materialise(entries.groupBy("slot").agg(F.sum("size").alias("words")))
    groups = sums.groupBy(F.floor(F.col("slot") / GROUP_SLOTS).alias("at")).agg(F.sum("words").alias("words"))
    part, cut = first_over(groups, "at", 0, budget), None
    if part is not None:
        cut = first_over(sums.where(F.floor(F.col("slot") / GROUP_SLOTS) == part["at"]), "slot", part["before"], budget)
    copies = F.lit(0)
    if cut is not None:
        within = entries.where(F.col("slot") == cut["slot"]).withColumn("upto", F.sum("size").over(Window.orderBy("place")) + cut["before"])
        last = within.where(F.col("upto") <= budget).agg(F.max("place").alias("p")).select("p.finish", "p.src.missing", "p.src.name", "p.key").first()
        end = F.struct(F.lit(last["finish"]).cast("double"), F.struct(F.lit(last["missing"]).cast("boolean"), F.lit(last["name"]).cast("string")), F.lit(last["key"]).cast("string"))
    for c in range(repeats):
        taken = F.col("target") > 0
        if cut is not None:
            slot = F.floor(place(c)["finish"] * slots)
            taken = taken & ((slot < cut["slot"]) | ((slot == cut["slot"]) & (place(c) <= end) if last["finish"] is not None else F.lit(False)))
        copies = copies + F.when(taken, 1).otherwise(0)
    return queued.select("doc_id", "source", "text_md5", "size", "source_size", "target", "finish", copies.alias("copies"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, repeats: int = 2, seed: int = 13) -> DataFrame:
    """The rows of docs, with all their columns, each as often as the mix takes it."""
    digest = F.coalesce(F.md5(F.col("text").cast("binary")), F.lit(""))
    taken = weighted_mix(docs, weights, share, repeats, seed).where(F.col("copies") > 0).select("doc_id", source_key(F.col("source")).alias("src"), "text_md5", "copies").distinct()
    keyed = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_row"), F.col("doc_id").alias("_id"), source_key(F.col("source")).alias("_src"), digest.alias("_md5"))
    same = F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_src") == F.col("src")) & (F.col("_md5") == F.col("text_md5"))
    return keyed.join(taken, same).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_row.*")
