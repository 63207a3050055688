"""Chat formatting of reply trees: each chosen path from root to leaf becomes one conversation.

Messages point to the one they answer. Self-joins that double their reach add up
each message's score and depth from its root; leaves are ranked in their tree by
the mean score of their branch, and the chosen ones walk back to the root over
the same doubled pointers, so a thread of d messages takes log2(d) joins. Each
join is on a single message, so a tree of any size spreads over all tasks.

A conversation is formatted by one task from its turns in order, in parts of
about a million characters, and read back the same way; none is held whole.
The template is ``### role: text</turn>`` and a line break for each turn. Inside
roles and texts a backslash is doubled, and one is put between two ``#`` and into
``</turn>``; a colon in a role gets one before it. So no control string occurs
inside a text, and dropping each backslash's first half gives the text back.
Positions under the loss mask are code points of the formatted conversation: each
assistant's text, without its marks.

Links, scores and paths are worked out on narrow rows; texts join the finished
paths once, by position and digest.

Null roles and texts are empty. Of rows with the same tree and id the first by
parent and digest counts. A message whose parent is null, absent or itself is a
root; messages that only answer each other in a circle are in no path. Null trees
are one tree; a null id takes no replies. In ``threads`` rows with one turn stand
by role and digest of their text, null turns first; repeated rows are turns of
their own. Other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import Scratch, placed

OPEN, CLOSE = "### ", "</turn>\n"
#: Characters after which a part of a conversation ends with its turn.
PART = 1_000_000
TURN = re.compile(r"### ((?:[^\\:]|\\.)*): (.*?)</turn>\n", re.DOTALL)
FORMATTED = "tree string, leaf long, part long, last boolean, formatted string, loss_starts array<long>, loss_ends array<long>"
READ = "tree string, leaf long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str) -> str:
    text = text.replace("\\", "\\\\").replace("</turn>", "<\\/turn>")
    return re.sub("#(?=#)", "#\\\\", text) if "##" in text else text


def escape_role(role: str) -> str:
    return escape(role).replace(":", "\\:")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if "\\" in text else text


def one_turn(role: str, text: str) -> tuple[str, int, int]:
    """Formatted turn, and where its text starts and ends in it."""
    head, body = f"{OPEN}{escape_role(role)}: ", escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


def parsed(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a formatted conversation or part; anything else between turns is an error."""
    out, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def _rows(df: DataFrame, tree: str, at: str, *more: str) -> DataFrame:
    """Rows as (tree, at, key, role, text and more); ``key`` is the digest of role and text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    return df.select(F.col(tree).alias("tree"), F.col(at).cast("long").alias("at"), F.md5(F.concat(role, F.lit("\n"), text)).alias("key"),
                     role.alias("role"), text.alias("text"), *more)


def threads(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Links of linear conversations (rows of ``_rows``, ``at`` the turn): every turn answers the one before. All score 0."""
    distinct = rows.groupBy("tree", "at", "role", "key").agg(F.lit(0.0).alias("score"))
    at = placed(distinct, "tree", ["at", "role", "key"], scratch)
    return at.select("tree", F.col("place").alias("id"), F.when(F.col("place") > 0, F.col("place") - 1).alias("parent"), "score", "at", "key")


def replies(rows: DataFrame) -> DataFrame:
    """Links of messages that name their parent (rows of ``_rows``, ``at`` the id)."""
    first = W.partitionBy("tree", "at").orderBy("parent", "key")
    narrow = rows.select("tree", F.col("at").alias("id"), F.col("parent").cast("long").alias("parent"), F.col("score").cast("double").alias("score"), "at", "key")
    return narrow.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth")


def _step(rows: DataFrame, known: DataFrame, how: str) -> DataFrame:
    """Joins each row's ``up`` to the message of that id in ``known`` (columns with an underscore before them)."""
    known = known.select(*[F.col(c).alias(f"_{c}") for c in known.columns])
    return rows.join(known, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("up") == F.col("_id")), how)


def branches(links: DataFrame, best: int | None, scratch: Scratch) -> DataFrame:
    """(tree, leaf, id, place): the messages of each chosen branch, numbered from its root. ``best`` branches a tree, None for all.

    Step k holds the messages that are deeper than 2^k or got to their root in
    it, with the sum of scores and the number of messages on the way; only those
    that still climb are joined again.
    """
    own = links.select("tree", "id", F.col("parent").alias("up"), "score")
    start = [F.coalesce("score", F.lit(0.0)).alias("total"), F.lit(1).cast("long").alias("depth")]
    found = _step(own.where(~F.col("up").eqNullSafe(F.col("id"))), own.select("tree", "id"), "left").select(
        "tree", "id", F.when(F.col("_id").isNotNull(), F.col("up")).alias("up"), *start)
    selves = own.where(F.col("up").eqNullSafe(F.col("id"))).select("tree", "id", F.lit(None).cast("long").alias("up"), *start)
    steps = [scratch.keep(found.unionByName(selves), "chat-links")]
    at_root = steps[0].where("up is null")
    reach, number = 1, steps[0].count()
    # Whoever still climbs after as many steps as there are messages goes round in a circle.
    while reach <= number and not steps[-1].where("up is not null").isEmpty():
        climbing = steps[-1].where("up is not null")
        far = _step(climbing, at_root.unionByName(climbing), "inner")
        steps.append(scratch.keep(far.select(
            "tree", "id", F.col("_up").alias("up"), (F.col("total") + F.col("_total")).alias("total"), (F.col("depth") + F.col("_depth")).alias("depth")), "chat-links"))
        at_root = at_root.unionByName(steps[-1].where("up is null"))
        reach *= 2
    answered = steps[0].select(F.col("tree").alias("_t"), F.col("up").alias("_u")).where("_u is not null").distinct()
    leaves = at_root.join(answered, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("id") == F.col("_u")), "left_anti")
    if best is not None:
        rank = W.partitionBy("tree").orderBy((F.col("total") / F.col("depth")).desc(), F.col("depth").desc(), "id")
        leaves = leaves.withColumn("_rank", F.row_number().over(rank)).where(F.col("_rank") <= best)
    paths = scratch.keep(leaves.select("tree", F.col("id").alias("leaf"), "id", (F.col("depth") - 1).alias("place")), "chat-paths")
    for i, links in enumerate(steps[:-1]):
        more = _step(paths.withColumnRenamed("id", "up"), links.where("up is not null"), "inner")
        more = scratch.keep(more.select("tree", "leaf", F.col("_up").alias("id"), (F.col("place") - 2**i).alias("place")), "chat-paths")
        paths = paths.unionByName(more)
    return paths


def _turns(rows: DataFrame, links: DataFrame, best: int | None, scratch: Scratch) -> DataFrame:
    """Turns of the chosen branches, each with its text, conversation by conversation in order."""
    links = scratch.keep(links, "chat-messages")
    paths = branches(links, best, scratch)
    where = links.select(F.col("tree").alias("_t"), F.col("id").alias("_i"), "at", "key")
    paths = paths.join(where, F.col("tree").eqNullSafe(F.col("_t")) & F.col("id").eqNullSafe(F.col("_i")))
    paths = paths.select(F.col("tree").alias("_tree"), "leaf", "place", F.col("at").alias("_at"), F.col("key").alias("_key"))
    same = F.col("tree").eqNullSafe(F.col("_tree")) & F.col("at").eqNullSafe(F.col("_at")) & (F.col("key") == F.col("_key"))
    turns = rows.select("tree", "at", "key", "role", "text").join(paths, same)
    turns = turns.select(F.col("tree").cast("string").alias("tree"), "leaf", "place", "role", "text")
    return turns.repartition("tree", "leaf").sortWithinPartitions("tree", "leaf", "place")


def format_threads(conversations: DataFrame, scratch: Scratch, part: int = PART) -> DataFrame:
    """Linear conversations (conv_id, turn, role, text), formatted; ``tree`` is conv_id as text."""
    rows = _rows(conversations, "conv_id", "turn")
    return _turns(rows, threads(rows, scratch), 1, scratch).mapInPandas(partial(_format, repeats=True, size=part), FORMATTED)


def format_replies(messages: DataFrame, scratch: Scratch, best: int | None = 1, part: int = PART) -> DataFrame:
    """The ``best`` branches of each tree of messages (tree, id, parent, role, text, score), formatted."""
    rows = _rows(messages, "tree", "id", "parent", "score")
    return _turns(rows, replies(rows), best, scratch).mapInPandas(partial(_format, repeats=False, size=part), FORMATTED)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["tree", "leaf", "part", "last", "formatted", "loss_starts", "loss_ends"])


def _format(batches: Iterator[pd.DataFrame], repeats: bool, size: int) -> Iterator[pd.DataFrame]:
    """Sorted turns to parts; a part is given out when the next row shows whether it is the last of its conversation.

    Rows of one place are one turn given twice, unless ``repeats`` makes turns of them all.
    """
    key, place, pieces, starts, ends, held, offset, part = None, None, [], [], [], 0, 0, 0
    for batch in batches:
        out = []
        leaves = batch["leaf"].astype(object).where(batch["leaf"].notna(), None)
        for tree, leaf, at, role, text in zip(batch["tree"], leaves, batch["place"], batch["role"], batch["text"]):
            same = pieces and key == (tree, leaf)
            if same and at == place and not repeats:
                continue
            if pieces and (not same or held >= size):
                out.append((*key, part, not same, "".join(pieces), starts, ends))
                offset, part, pieces, starts, ends, held = offset + held, part + 1, [], [], [], 0
            if not same:
                key, offset, part = (tree, leaf), 0, 0
            place = at
            piece, start, end = one_turn(role, text)
            if role == "assistant":
                starts.append(offset + held + start)
                ends.append(offset + held + end)
            pieces.append(piece)
            held += len(piece)
        if out:
            yield _frame(out)
    if pieces:
        yield _frame([(*key, part, True, "".join(pieces), starts, ends)])


def read_back(formatted: DataFrame, in_order: bool = False) -> DataFrame:
    """One row per conversation, from its parts: number of turns, digest of roles and texts, code points and digest under the loss mask, length.

    ``in_order``: the parts of a conversation follow one another in their
    partition, as they do where they were formatted; not so in files.
    """
    if in_order:
        return formatted.mapInPandas(_read, READ)
    # Conversations of one part are read where they are; only those of several are brought together.
    alone = F.col("last") & (F.col("part") == 0)
    parts = formatted.where(~alone).repartition("tree", "leaf").sortWithinPartitions("tree", "leaf", "part")
    return formatted.where(alone).mapInPandas(_read, READ).unionByName(parts.mapInPandas(_read, READ))


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["tree", "leaf", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    n, turns, chars, loss, length = 0, hashlib.sha256(), 0, hashlib.sha256(), 0
    for batch in batches:
        out = []
        leaves = batch["leaf"].astype(object).where(batch["leaf"].notna(), None)
        for tree, leaf, last, text, starts, ends in zip(batch["tree"], leaves, batch["last"], batch["formatted"], batch["loss_starts"], batch["loss_ends"]):
            for role, said in parsed(text):
                n += 1
                turns.update(f"{role}\n{said}\n".encode())
            for start, end in zip(starts, ends):
                said = unescape(text[start - length:end - length])
                chars += len(said)
                loss.update(said.encode())
            length += len(text)
            if last:
                out.append((tree, leaf, n, turns.hexdigest(), chars, loss.hexdigest(), length))
                n, turns, chars, loss, length = 0, hashlib.sha256(), 0, hashlib.sha256(), 0
        yield pd.DataFrame(out, columns=names)
