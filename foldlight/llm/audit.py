"""Operator 13: how quality filters interact: which order removes what, and what each removes alone.

Five filters fail a text: A, under 200 words; B, under half of its words different; C, over 2 % capitals among its
characters; D, a character of #$%&*|; E, the text of a document with a smaller doc_id. E is an existential
self-join: a left-semi join on the text's hash, the exact text and a smaller doc_id, whose right side has the
smallest doc_id of each text that occurs again, so a group of copies meets one row and not itself. The ids that it
finds are united with those that fail the others, and combinations of failure bits are counted. All orders of the
filters follow from the counts of combinations (at most 32 for a part), not from passes over the texts.

A text is hashed to 64 bits for the join, and rows are told apart by doc_id, part and hash. Texts are shuffled
twice: to find the smallest doc_id, and for the join.

Defined results: a null text is an empty one: it fails A, and E if a smaller doc_id has no text either. Rows with a
null doc_id are never E, and make no other row E. Rows that repeat doc_id and text are none of each other's E and
count one by one. A null source is the part '' (as an empty one). Several labels of a doc_id count as good if one
is, as toxic if one is. An empty table has no parts, so no rows. Other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hub_join, materialise

LETTERS = "ABCDE"
#: Runs of bytes other than the blank and U+0009 to U+000D.
WORDS = r"[^\x20\x09-\x0D]+"


def text_failures(text: Column) -> Column:
    """Bits of the filters A to D that a text (not null) fails; A is the lowest."""
    words, hundred = F.regexp_extract_all(text, F.lit(WORDS), F.lit(0)), F.lit(100).cast("long")
    few = F.size(words) < 200
    alike = hundred * F.size(F.array_distinct(words)) < F.size(words).cast("long") * 50
    loud = hundred * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > F.length(text).cast("long") * 2
    bits = [F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate((few, alike, loud, text.rlike("[#$%&*|]")))]
    return bits[0] + bits[1] + bits[2] + bits[3]


def repeated(rows: DataFrame) -> DataFrame:
    """(doc_id, part, hash) of the rows whose text a smaller doc_id has too."""
    known = rows.where(F.col("doc_id").isNotNull())
    first = known.groupBy("hash", "text").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where(F.col("first") < F.col("last")).select("hash", "text", "first")
    hub = F.xxhash64("hash")  # so that both sides are dealt out for the join alone, and a hot text can be split
    left, right = known.select("doc_id", "part", "hash", "text").withColumn("_hub", hub), first.withColumn("_hub", hub)
    same = (left["hash"] == right["hash"]) & (left["_hub"] == right["_hub"]) & (left["text"] == right["text"]) & (right["first"] < left["doc_id"])
    return left.join(right, same, "left_semi").select("doc_id", "part", "hash")


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, bits, n, good, toxic): documents of each part and combination of failed filters."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col("source"), F.lit("")).alias("part"), text.alias("text")).withColumn("hash", F.xxhash64("text"))
    failed = rows.select("doc_id", "part", "hash", text_failures(F.col("text")).alias("bits"), F.lit(1).alias("n"))
    copies = repeated(rows).withColumns({"bits": F.lit(1 << LETTERS.index("E")), "n": F.lit(0)})
    each = failed.unionByName(copies).groupBy("doc_id", "part", "hash").agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marked = hub_join(each, marks, "doc_id", "left")
    count = lambda c: F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(0)).alias(c)
    return marked.groupBy("part", "bits").agg(F.sum("n").alias("n"), count("good"), count("toxic"))


def order_rules() -> list[tuple[int, str, int, int, int, int, int, int]]:
    """What one document of each combination adds to each step of each order: (bits, filter_order, step, kept,
    removed, redundant, unique_fails, shapley)."""
    orders, out = ["".join(p) for p in permutations(LETTERS)], []
    for bits in range(1 << len(LETTERS)):
        fails = {x for i, x in enumerate(LETTERS) if bits >> i & 1}
        for order in orders:
            at = min((order.index(x) for x in fails), default=len(order))
            for step, x in enumerate(order):
                # each of a document's failures comes first in as many of all orders
                shapley = len(orders) // len(fails) if x in fails else 0
                out.append((bits, order, step + 1, int(at > step), int(at == step), int(x in fails and at < step), int(fails == {x}), shapley))
    return out


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)."""
    counts = materialise(failure_counts(docs, labels))
    rules = docs.sparkSession.createDataFrame(order_rules(), "bits int, filter_order string, step int, kept int, removed int, redundant int, unique int, share int")
    total = lambda by, of="n": F.sum(F.col(by) * F.col(of))
    return counts.join(F.broadcast(rules), "bits").groupBy("part", "filter_order", "step").agg(  # rules: 32 combinations x 600 steps
        total("kept").alias("kept"), total("removed").alias("removed"), total("redundant").alias("redundant"), total("unique").alias("unique_fails"),
        total("removed", "good").alias("good_lost"), total("removed", "toxic").alias("toxic_lost"), total("share").alias("shapley"))
