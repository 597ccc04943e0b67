"""Preference formatting: a common prompt, rendered once, and masked completions in pairs.

Both sides of a pair are lists of turns.  A message is a (turn, role, text) of a
side; the common prefix ends at the first turn whose messages are not the same
on both sides.  What lies before it is the prompt.  The rest is each side's
completion, in which only the assistant's words and their closing mark bear loss.

The messages of a part are numbered, and a chunk holds CHUNK of them, so that a
conversation of any length, or a turn of any number of messages, is rendered in
groups of bounded size; most parts have one chunk.  A null turn stands last, null
roles and texts count as empty, repeated messages count once, several messages of
one turn are ordered by role and text, a null pair id is a pair.  Identical sides
are all prompt; an empty side gives no rows of its own.  ``complete`` says whether
the pair has a chosen and a rejected completion: only such pairs can be learned from.
"""

from pyspark.sql import Column, DataFrame, functions as F

from ledgerline.llm.ranks import numbered

#: Messages of a chunk, as a power of two; turns of a block within which messages are numbered.
CHUNK_BITS = 8
OPEN, HEAD, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
TRAINED = "assistant"
LAST = (1 << 63) - 1


def _messages(turns: DataFrame, side: str) -> DataFrame:
    return turns.select(
        "pair_id", F.coalesce(F.col("turn").cast("long"), F.lit(LAST)).alias("turn"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"), F.lit(side == "chosen").alias("in_chosen"), F.lit(side == "rejected").alias("in_rejected"))


def _spans(pieces: Column) -> Column:
    """Start and end, in characters, of the pieces that bear loss."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(state, p):
        end = state.at + F.length(p.text)
        more = F.array(F.struct(state.at.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(p.train, F.concat(state.spans, more)).otherwise(state.spans).alias("spans"))

    return F.aggregate(pieces, start, step, lambda s: s.spans)


def format_pairs(chosen: DataFrame, rejected: DataFrame, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """(pair_id, part, chunk, n_turns, complete, text, loss_spans): part is prompt, chosen or rejected.

    Inputs: (pair_id, turn, role, text).  The first aggregation combines before
    its shuffle and its keys are single messages, so no pair is gathered whole;
    messages are numbered by a window over a block of turns, which streams.
    """
    messages = (_messages(chosen, "chosen").unionByName(_messages(rejected, "rejected")).groupBy("pair_id", "turn", "role", "text")
                .agg(F.max("in_chosen").alias("in_chosen"), F.max("in_rejected").alias("in_rejected")))
    apart = ~(F.col("in_chosen") & F.col("in_rejected"))
    parting = messages.groupBy(F.col("pair_id").alias("_pair")).agg(
        F.min(F.when(apart, F.col("turn"))).alias("_parting"),
        F.max(F.when(F.col("in_chosen"), F.col("turn"))).alias("_chosen"), F.max(F.when(F.col("in_rejected"), F.col("turn"))).alias("_rejected"))
    # a side's completion is what it says from the parting on
    complete = F.coalesce((F.col("_chosen") >= F.col("_parting")) & (F.col("_rejected") >= F.col("_parting")), F.lit(False))
    common = F.col("_parting").isNull() | (F.col("turn") < F.col("_parting"))
    parts = F.when(common, F.array(F.lit("prompt"))).otherwise(F.filter(F.array(
        F.when(F.col("in_chosen"), F.lit("chosen")), F.when(F.col("in_rejected"), F.lit("rejected"))), lambda p: p.isNotNull()))
    placed = messages.join(parting, F.col("pair_id").eqNullSafe(F.col("_pair"))).select(
        "pair_id", F.explode(parts).alias("part"), complete.alias("complete"), "turn", "role", "text")
    placed = numbered(placed, ["pair_id", "part"], F.shiftright("turn", CHUNK_BITS), ["turn", "role", "text"], "_n")
    placed = placed.select("pair_id", "part", "complete", F.shiftright("_n", chunk_bits).alias("chunk"), F.struct("turn", "role", "text").alias("m"))
    # at most 2^chunk_bits messages
    grouped = placed.groupBy("pair_id", "part", "complete", "chunk").agg(F.array_sort(F.collect_list("m")).alias("m"))
    pieces = F.flatten(F.transform("m", lambda m: F.array(
        F.struct(F.concat(F.lit(OPEN), m.role, F.lit(HEAD)).alias("text"), F.lit(False).alias("train")),
        F.struct(F.concat(m.text, F.lit(CLOSE)).alias("text"), ((F.col("part") != "prompt") & (m.role == TRAINED)).alias("train")))))
    return grouped.select("pair_id", "part", "chunk", F.size("m").alias("n_turns"), "complete", pieces.alias("p")).select(
        "pair_id", "part", "chunk", "n_turns", "complete", F.array_join("p.text", "").alias("text"), _spans(F.col("p")).alias("loss_spans"))


def swapped_replies(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chosen, rejected) turns of pairs made from plain conversations.

    Chosen is the conversation itself.  Rejected has the last assistant turn's
    text replaced by that of the neighbour whose id differs in the last bit; with
    no such neighbour the reply is left out.
    """
    turns = conversations.select(F.col("conv_id").alias("pair_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    last = (turns.where(F.col("role") == TRAINED).groupBy(F.col("pair_id").alias("_pair"))
            .agg(F.max(F.struct(F.coalesce("turn", F.lit(LAST)).alias("t"), F.coalesce("text", F.lit("")).alias("x"))).alias("reply")))
    swap = last.select("_pair", F.col("reply.t").alias("_turn")).join(
        last.select(F.col("_pair").bitwiseXOR(F.lit(1)).alias("_pair"), F.col("reply.x").alias("_other")), "_pair", "left")
    replaced = (F.col("role") == TRAINED) & (F.coalesce("turn", F.lit(LAST)) == F.col("_turn"))
    rejected = (turns.join(swap, F.col("pair_id") == F.col("_pair"), "left")
                .where(~F.coalesce(replaced & F.col("_other").isNull(), F.lit(False)))
                .select("pair_id", "turn", "role", F.when(replaced, F.col("_other")).otherwise(F.col("text")).alias("text")))
    return turns, rejected
