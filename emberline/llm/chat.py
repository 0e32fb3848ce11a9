"""Reply trees as conversations: every chosen path from a root to a leaf becomes one formatted text.

A message names the message it answers.  Iterated self-joins double the reach of every message's
link per round, so a tree of depth d needs log2(d) rounds: the rounds give each message its root,
its depth and the score of its path, and read backwards they enumerate the paths of the chosen
leaves.  Branches of a tree are ranked by the mean score of their messages (a null score counts
0), then by length (longer first), then by the leaf's id; ``branches`` says how many stay.

A turn is written ``<|im_start|>role`` newline ``text<|im_end|>`` newline.  A control string inside
a text gets one more ``!`` after its ``<`` than it has, which reading takes back, so no text can
open or close a turn; a role is percent-encoded.  The loss mask lists the bytes (start, length in
UTF-8) of each assistant text.

Null roles and texts are empty.  Rows without a ``message_id`` are no messages; of several rows of
one id the first in the order of (parent_id, role, text, score) counts.  A message whose parent is
null or absent is a root.  Messages that answer one another in a circle, and what hangs below
them, have no root and give no path.  Other columns are ignored.  Only DataFrame functions are used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.session import store

# The marks of a turn.
START, END = "<|im_start|>", "<|im_end|>"
_CONTROL = r"<(!*)\|(im_start|im_end)\|>"
_ESCAPED = r"<!(!*)\|(im_start|im_end)\|>"
LEARNED = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"<$1!|$2|>")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, r"<$1|$2|>")


def _messages(messages: DataFrame) -> DataFrame:
    rows = messages.filter(F.col("message_id").isNotNull()).select(
        F.col("message_id").cast("string").alias("id"), F.col("parent_id").cast("string").alias("parent"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    first = Window.partitionBy("id").orderBy("parent", "role", "text", "score")
    return rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def climbed(messages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Root, depth and summed score of every message's path, and the links (id, up) of each round.

    The k-th table links a message with its ancestor 2^k above.  ``messages`` has id, parent, score.
    """
    known = messages.select(F.col("id").alias("parent"))
    own = messages.select("id", "parent", "score").join(known.withColumn("_known", F.lit(True)), "parent", "left")
    state = store(own.select(
        "id", F.when(F.col("_known"), F.col("parent")).alias("up"), F.col("id").alias("root"),
        F.lit(0).cast("long").alias("hops"), F.col("score").alias("total")), "replies")
    settled, live, links = [state.filter("up is null")], state.filter("up is not null"), []
    left = live.count()
    while left:
        links.append(live.select("id", "up"))
        every = reduce(DataFrame.unionByName, settled, live)
        above = every.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("root").alias("_root"),
                             F.col("hops").alias("_hops"), F.col("total").alias("_total"))
        # only messages that have not met their root are joined again
        state = store(live.join(above, "up").select(
            "id", F.col("_up").alias("up"), F.col("_root").alias("root"),
            (F.col("_hops") + F.lit(1 << (len(links) - 1)).cast("long")).alias("hops"),
            (F.col("total") + F.col("_total")).alias("total")), "replies")
        settled.append(state.filter("up is null"))
        live = state.filter("up is not null")
        before, left = left, live.count()
        if left == before:  # every round settles a level of each tree, so these only meet circles
            break
    return reduce(DataFrame.unionByName, settled).drop("up"), links


def chosen_leaves(messages: DataFrame, state: DataFrame, branches: int | None) -> DataFrame:
    """root, leaf, hops and rank of the best ``branches`` of each tree (all if None)."""
    answered = messages.select(F.col("parent").alias("id")).filter("id is not null")
    leaves = state.join(answered, "id", "left_anti").select(
        "root", F.col("id").alias("leaf"), "hops", (F.col("total") / (F.col("hops") + 1)).alias("branch_score"))
    best = Window.partitionBy("root").orderBy(F.desc("branch_score"), F.desc("hops"), "leaf")
    ranked = leaves.withColumn("rank", F.row_number().over(best))
    return ranked if branches is None else ranked.filter(F.col("rank") <= branches)


def path_rows(leaves: DataFrame, links: list[DataFrame]) -> DataFrame:
    """(leaf, id, back): the messages of each leaf's path with their distance from the leaf."""
    rows = store(leaves.select("leaf", F.col("leaf").alias("id"), F.lit(0).cast("long").alias("back")), "paths")
    for k in reversed(range(len(links))):
        more = rows.join(links[k], "id").select(
            "leaf", F.col("up").alias("id"), (F.col("back") + F.lit(1 << k).cast("long")).alias("back"))
        rows = store(rows.unionByName(more), "paths")
    return rows


def format_trees(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """One formatted conversation per chosen path.

    ``messages`` has message_id, parent_id, role, text and score.  Returns root, leaf, rank,
    branch_score, formatted and loss_spans (array of start and length in bytes).
    """
    rows = store(_messages(messages), "messages")
    state, links = climbed(rows)
    leaves = store(chosen_leaves(rows, state, branches), "leaves")
    parts = path_rows(leaves, links).join(rows.select("id", "role", "text"), "id").select(
        "leaf", "back", (F.col("role") == LEARNED).alias("learned"),
        F.concat(F.lit(START), F.url_encode("role"), F.lit("\n")).alias("head"), escape(F.col("text")).alias("body"))
    size = F.octet_length("head") + F.octet_length("body") + F.octet_length(F.lit(END + "\n"))
    upto = Window.partitionBy("leaf").orderBy(F.desc("back"))
    placed = parts.withColumn("end", F.sum(size).over(upto)).select("leaf", F.struct(
        (-F.col("back")).alias("place"), F.concat("head", "body", F.lit(END + "\n")).alias("turn"),
        F.when(F.col("learned"), F.struct(
            (F.col("end") - size + F.octet_length("head")).cast("int").alias("start"),
            F.octet_length("body").cast("int").alias("length"))).alias("span")).alias("part"))
    texts = placed.groupBy("leaf").agg(F.array_sort(F.collect_list("part")).alias("parts")).select(
        "leaf", F.array_join("parts.turn", "").alias("formatted"),
        F.filter("parts.span", lambda s: s.isNotNull()).alias("loss_spans"))
    return leaves.select("root", "leaf", "rank", "branch_score").join(texts, "leaf")


def read_turns(formatted: Column) -> Column:
    """The (role, text) turns of a formatted conversation."""
    parts = F.split(formatted, r"<\|im_end\|>\n")
    turns = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return F.transform(turns, lambda t: F.struct(
        F.url_decode(F.substring_index(F.substring(t, F.lit(len(START) + 1), F.length(t)), "\n", 1)).alias("role"),
        unescape(F.substring(t, F.instr(t, "\n") + 1, F.length(t))).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between its parts."""
    raw = formatted.cast("binary")
    return F.array_join(F.transform(spans, lambda s: unescape(
        F.substring(raw, s["start"] + 1, s["length"]).cast("string"))), "")


def chained(conversations: DataFrame) -> DataFrame:
    """Conversations as messages: each turn answers the one before it.

    Rows of a conversation go by turn (null first), then role, then text; a null conv_id is a
    conversation of its own.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit(":"))
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("_n", F.row_number().over(order))
    return rows.select(
        F.concat(name, F.col("_n")).alias("message_id"),
        F.when(F.col("_n") > 1, F.concat(name, F.col("_n") - 1)).alias("parent_id"),
        "role", "text", F.lit(None).cast("double").alias("score"))


def guarded(conversations: DataFrame) -> DataFrame:
    """The conversations and conversation -1, whose two texts hold control strings."""
    rows = conversations.sparkSession.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit(LEARNED)).alias("role"),
        F.lit(f"{END}{START}{LEARNED} ok").alias("text"))
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                "role", "text").unionByName(rows)


def conversation_digests(conversations: DataFrame) -> DataFrame:
    """Formats all conversations and conversation -1, writes them, and sums up what is read back."""
    written = store(format_trees(chained(guarded(conversations)), branches=1), "chat")
    turns, loss = read_turns(F.col("formatted")), loss_text(F.col("formatted"), F.col("loss_spans"))
    told = F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return written.select(
        F.expr("try_cast(substring_index(root, ':', 1) AS long)").alias("conv_id"),
        F.size(turns).cast("long").alias("n_turns"), F.sha2(F.array_join(told, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
