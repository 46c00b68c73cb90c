"""Operator 4 (native): multi-party perspective rotation of chats.

For every participant of a conversation the dialogue is rendered with that speaker as the assistant and
all others as named users; the mask holds the spans (characters, start inclusive, end exclusive) of what
the assistant says, with its end mark, which is what a model trains on.

A dialogue is rendered in pieces, so that no conversation, however long, has to fit in a row or a task. A
piece holds `piece` turn numbers. Where more than `piece` rows share a turn number (or have none), that turn
is split further: by ranges of the hash of role and text (bucket), and copies of one row by the `piece`
(chunk). The rows of a (conversation, speaker) in the order of piece, split_turn, bucket and chunk
concatenate to the whole dialogue, and spans count from the row's start. So a row has piece * piece turns
or about as many at most, whatever the turn numbers are.

Defined results: `system` turns are rendered as such and are no participant; a null role is a user named
`unknown` and no participant. Null texts are empty. Turns are ordered by number (null first, in pieces of
their own), then by md5 of role and text; repeated rows are repeated turns. `<|` in a text is written `< |`,
so that texts can't forge marks; characters of a name other than letters, digits, `_`, `.` and `-` become
`_`. Conversations with a null conv_id are one conversation. An empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

PIECE = 64
END, ASSISTANT, SYSTEM = "<|end|>\n", "<|assistant|>\n", "<|system|>\n"
PLACE = ("conv_id", "piece", "split_turn", "bucket", "chunk")


def other_head(role: Column) -> Column:
    """How a turn begins where its role isn't the assistant."""
    name = F.regexp_replace(F.coalesce(role, F.lit("unknown")), "[^A-Za-z0-9_.-]", "_")
    return F.when(role == "system", SYSTEM).otherwise(F.concat(F.lit("<|user name="), name, F.lit("|>\n")))


def placed(turns: DataFrame, piece: int) -> DataFrame:
    """Every turn with its place: (conv_id, piece, split_turn, bucket, chunk, turn, role, said, hash)."""
    said = F.replace(F.coalesce(F.col("text"), F.lit("")), F.lit("<|"), F.lit("< |"))
    clean = turns.select("conv_id", "turn", "role", said.alias("said"), F.coalesce(F.floor(F.col("turn") / piece), F.lit(-1)).alias("piece"))
    clean = clean.withColumn("hash", F.md5(F.concat(F.coalesce("role", F.lit("")), F.lit("|"), F.col("role").isNull().cast("int").cast("string"), F.lit("|"), F.col("said")).cast("binary")))
    full = materialise(clean.groupBy("conv_id", "turn").agg(F.count("*").alias("rows")).where(F.col("rows") > piece).select(F.col("conv_id").alias("of"), F.col("turn").alias("at"), "rows"))
    same = F.col("conv_id").eqNullSafe(F.col("of")) & F.col("turn").eqNullSafe(F.col("at"))
    number = dict(turns.dtypes)["turn"]
    single = clean.join(full, same, "left_anti").select("conv_id", "piece", F.lit(None).cast(number).alias("split_turn"), F.lit(-1).cast("long").alias("bucket"), F.lit(-1).cast("long").alias("chunk"), "turn", "role", "said", "hash", F.lit(1).alias("copies"))
    # copies of a row are counted before they meet, and dealt out again by the piece
    crowd = clean.join(full, same).groupBy("conv_id", "piece", "turn", "role", "said", "hash", "rows").agg(F.count("*").alias("n"))
    bucket = F.floor(F.conv(F.substring("hash", 1, 8), 16, 10).cast("double") / float(1 << 32) * F.ceil(F.col("rows") / piece))
    chunks = crowd.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / piece) - 1)))
    copies = F.least(F.lit(piece), F.col("n") - F.col("chunk") * piece).cast("int")
    return single.unionByName(chunks.select("conv_id", "piece", F.col("turn").alias("split_turn"), bucket.alias("bucket"), "chunk", "turn", "role", "said", "hash", copies.alias("copies"))).withColumn("_", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).drop("_", "copies")


def rotate(turns: DataFrame, piece: int = PIECE) -> DataFrame:
    """(conv_id, speaker, piece, split_turn, bucket, chunk, n_turns, rendered, mask) from (conv_id, turn, role, text)."""
    named = placed(turns, piece).withColumn("head", other_head(F.col("role"))).withColumn("body", F.concat(F.col("said"), F.lit(END)))
    # where each turn ends if nobody is the assistant; a speaker's own turns shift this by one length each
    upto = F.sum(F.length("head") + F.length("body")).over(Window.partitionBy(*PLACE).orderBy(F.col("turn").asc_nulls_first(), "hash").rowsBetween(Window.unboundedPreceding, 0))
    pieces = named.withColumn("upto", upto).groupBy(*PLACE).agg(F.sort_array(F.collect_list(F.struct("upto", "role", "head", "body"))).alias("turns"))
    speakers = turns.where(F.col("role").isNotNull() & (F.col("role") != "system")).select(F.col("conv_id").alias("of"), F.col("role").alias("speaker")).distinct()
    own = lambda t: F.coalesce(t["role"] == F.col("speaker"), F.lit(False))
    shift = F.length(other_head(F.col("speaker"))) - len(ASSISTANT)
    mine = F.filter("turns", own)
    spans = F.transform(mine, lambda t, k: F.struct((t["upto"] - (k + 1) * F.col("shift") - F.length(t["body"])).alias("start"), (t["upto"] - (k + 1) * F.col("shift")).alias("end")))
    rendered = F.array_join(F.transform("turns", lambda t: F.concat(F.when(own(t), ASSISTANT).otherwise(t["head"]), t["body"])), "")
    return (
        pieces.join(speakers, pieces["conv_id"].eqNullSafe(speakers["of"])).withColumn("shift", shift)
        .select("conv_id", "speaker", "piece", "split_turn", "bucket", "chunk", F.size("turns").alias("n_turns"), rendered.alias("rendered"), spans.alias("mask"))
    )
