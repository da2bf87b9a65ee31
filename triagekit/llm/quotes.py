"""Quotation linking: from messages that quote each other to reply-ordered conversations without quotes.

A line's quote level is the number of ``>`` before its text (blanks between them do not count). A passage
is a run of non-blank lines of one level; blank lines and changes of level end it. Passages are
normalised (markers off, lower case, blanks joined) and hashed. A quoted passage belongs to the message
that first wrote it as its own: in the same conversation if that was before the quote, else in the first
of all conversations if that one comes before. A message replies to the origin of its first passage of level one; deeper
levels are quotes within quotes and link to their own origins. Conversations are followed up to their
first message by pointer doubling.

Built-in functions only. A message is cut in time linear in its length, a pasted log of a hundred thousand
lines included. A passage that very many messages wrote is reduced to one origin per conversation, and to one
in all, before any join, so links never multiply; passages that very many quote, messages that very many
answer, and names that very many rows share are joined in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagekit.errors import LimitExceeded
from triagekit.llm.skew import join_by_weight
from triagekit.operators.ranking import let
from triagekit.sources.store import materialize

#: What stands before the text of a line: blanks and, in a quoted one, its markers.
LEAD = r"^[\s>]*"
QUOTED = r"^\s*>"
BLANKS = " \t\n\x0b\f\r"
#: A reply chain of ``2 ** MAX_ROUNDS`` messages is followed to its end; longer ones raise an error.
MAX_ROUNDS = 40

MESSAGE = ["conv_id", "turn"]


def _lines(text: Column) -> Column:
    """``(level, body)`` of each line; the body is normalised, and empty for a blank line."""

    def line(raw: Column) -> Column:
        level = F.length(F.regexp_replace(F.regexp_extract(raw, LEAD, 0), r"[^>]", ""))
        body = F.trim(F.regexp_replace(F.lower(F.regexp_replace(raw, LEAD, "")), r"\s+", " "))
        return F.struct(level.alias("level"), body.alias("body"))

    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), line)


def _first_lines(lines: Column) -> Column:
    """The numbers, from 1, of the lines with which a passage begins."""
    before = F.concat(F.array(F.struct(F.lit(-1).alias("level"), F.lit("").alias("body"))), lines)
    begins = F.zip_with(
        lines, before, lambda x, b: (x["body"] != "") & ((b["body"] == "") | (b["level"] != x["level"]))
    )
    return F.filter(F.transform(begins, lambda yes, i: F.when(yes, i + 1)), lambda i: i.isNotNull())


def _passages(text: Column) -> Column:
    """``(level, body)`` of each passage in order: the lines from its first to the first of the next one."""

    def cut(lines: Column, first: Column) -> Column:
        def passage(at: Column, following: Column) -> Column:
            part = F.slice(lines, at, F.coalesce(following, F.size(lines) + 1) - at)
            bodies = F.filter(F.transform(part, lambda x: x["body"]), lambda x: x != "")
            return F.struct(F.get(lines, at - 1)["level"].alias("level"), F.array_join(bodies, " ").alias("body"))

        return F.zip_with(first, F.slice(first, 2, F.size(first)), passage)

    return let(_lines(text), lambda lines: let(_first_lines(lines), lambda first: cut(lines, first)))


def unquoted(text: Column) -> Column:
    """The lines of a text that it does not quote, in its own spelling, without blank ones at both ends."""
    own = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: ~x.rlike(QUOTED))
    return F.btrim(F.array_join(own, "\n"), F.lit(BLANKS))


def parsed(messages: DataFrame) -> DataFrame:
    """``(conv_id, turn, own_text, found)``; ``found`` has level and digest of every passage in order."""
    digests = F.transform(_passages(F.col("text")), lambda p: F.struct(p["level"].alias("level"), F.md5(p["body"]).alias("digest")))
    return messages.select(*MESSAGE, unquoted(F.col("text")).alias("own_text"), digests.alias("found"))


def passages(messages: DataFrame) -> DataFrame:
    """``(conv_id, turn, place, level, digest)`` for every passage of ``parsed`` messages; one of level 0 is the
    message's own."""
    return messages.select(*MESSAGE, F.posexplode("found").alias("place", "p")).select(*MESSAGE, "place", "p.level", "p.digest")


def quote_links(found: DataFrame) -> DataFrame:
    """Each quoted passage with the message that it comes from, or null: ``from_conv, from_turn``."""
    quoted = found.where(F.col("level") > 0)
    own = found.where((F.col("level") == 0) & F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    pair = ["conv_id", "digest"]
    near = materialize(own.groupBy(*pair).agg(F.min("turn").alias("near_turn")), "passage-origins")
    first = near.groupBy("digest").agg(F.min(F.struct("conv_id", F.col("near_turn").alias("turn"))).alias("first"))
    # One row per conversation and passage that it quotes, so no key of this join has more than one.
    wanted = materialize(quoted.groupBy(*pair).agg(F.count("*").alias("n_here")).join(near, pair, "left"), "quoted-passages")
    size = wanted.agg(F.count("*"), F.coalesce(F.sum("n_here"), F.lit(0))).first()
    digests = wanted.groupBy("digest").agg(F.count("*").alias("n")).join(first, "digest", "left")
    origins = materialize(join_by_weight(wanted, digests, ["digest"], size[0]), "passage-links")
    here = F.col("near_turn") < F.col("turn")
    elsewhere = F.col("first.conv_id") < F.col("conv_id")
    return join_by_weight(quoted, origins, pair, size[1], "n_here").select(
        *MESSAGE, "place", "level", "digest",
        F.when(here, F.col("conv_id")).when(elsewhere, F.col("first.conv_id")).alias("from_conv"),
        F.when(here, F.col("near_turn")).when(elsewhere, F.col("first.turn")).alias("from_turn"),
    )


def threads(parents: DataFrame) -> DataFrame:
    """``(conv_id, turn, thread_conv, thread_turn, depth)`` of each message with its parent or null."""
    root = F.col("from_conv").isNull()
    pointers = materialize(
        parents.select(
            *MESSAGE,
            F.when(root, F.col("conv_id")).otherwise(F.col("from_conv")).alias("thread_conv"),
            F.when(root, F.col("turn")).otherwise(F.col("from_turn")).alias("thread_turn"),
            F.when(root, 0).otherwise(1).cast("long").alias("depth"),
            root.alias("done"),
        ),
        "reply-pointers",
    )
    target = ["thread_conv", "thread_turn"]
    for _ in range(MAX_ROUNDS):
        moving = pointers.where(~F.col("done"))
        total = moving.count()
        if not total:
            return pointers.drop("done")
        above = pointers.select(
            F.col("conv_id").alias("thread_conv"), F.col("turn").alias("thread_turn"), F.col("thread_conv").alias("up_conv"),
            F.col("thread_turn").alias("up_turn"), F.col("depth").alias("up_depth"), F.col("done").alias("up_done"),
        )
        targets = moving.groupBy(*target).agg(F.count("*").alias("n")).join(above, target, "left")
        moved = join_by_weight(moving, targets, target, total).select(
            *MESSAGE, F.coalesce("up_conv", "thread_conv").alias("thread_conv"), F.coalesce("up_turn", "thread_turn").alias("thread_turn"),
            (F.col("depth") + F.coalesce("up_depth", F.lit(0))).alias("depth"), F.coalesce("up_done", F.lit(True)).alias("done"),
        )
        pointers = materialize(pointers.where("done").unionByName(moved), "reply-pointers")
    raise LimitExceeded(f"a reply chain is longer than 2^{MAX_ROUNDS} messages")


def reply_conversations(
    messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text"
) -> DataFrame:
    """One row per message: its parent, the first message of its conversation, how many replies lie
    between, its text without quotes, and how many passages it quotes and how many were found.

    Ordered by ``thread_conv, thread_turn, depth, conv_id, turn``, every message follows the one that it
    replies to. A message is named by ``(conv_id, turn)``; rows that share a name are taken for one
    message when links are followed, and each is returned. Messages without conversation or turn link to
    nothing in their conversation and no quote links to them. A null text is empty. Texts may be of any length. An empty table gives
    no rows. Other columns are ignored.
    """
    source = messages.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(text_col).cast("string").alias("text")
    )
    rows = materialize(parsed(source), "parsed-messages")
    links = materialize(quote_links(passages(rows)), "quote-links")
    at = F.struct("place", "from_conv", "from_turn")
    summary = links.groupBy(*MESSAGE).agg(
        F.min(F.when((F.col("level") == 1) & F.col("from_conv").isNotNull(), at)).alias("parent"),
        F.count(F.lit(1)).alias("n_quoted"),
        F.count("from_conv").alias("n_linked"),
    )
    names = rows.groupBy(*MESSAGE).agg(F.count("*").alias("n"))
    same = [F.col(f"n.{c}").eqNullSafe(F.col(f"s.{c}")) for c in MESSAGE]
    parents = materialize(
        names.alias("n").join(summary.alias("s"), same, "left").select(
            *[f"n.{c}" for c in MESSAGE], F.col("s.parent.from_conv").alias("from_conv"), F.col("s.parent.from_turn").alias("from_turn"),
            F.coalesce("s.n_quoted", F.lit(0)).alias("n_quoted"), F.coalesce("s.n_linked", F.lit(0)).alias("n_linked"), "n.n",
        ),
        "reply-parents",
    )
    thread = threads(parents)
    named = parents.alias("n").join(thread.alias("s"), same).select(
        *[f"n.{c}" for c in MESSAGE], F.col("n.from_conv").alias("parent_conv"), F.col("n.from_turn").alias("parent_turn"),
        "s.thread_conv", "s.thread_turn", "s.depth", "n.n_quoted", "n.n_linked", "n.n",
    )
    return join_by_weight(rows.drop("found"), named, MESSAGE, rows.count()).select(
        *MESSAGE, "parent_conv", "parent_turn", "thread_conv", "thread_turn", "depth", "n_quoted", "n_linked", "own_text"
    )
