"""Quotation linking: reply-ordered conversations without quotes.

Messages quote others by `>` marks, nested to any level. A message's quoted passages and
their lines are normalised and hashed, and so is everything that messages say
themselves. A hash join inside the conversation finds where a passage was said first;
the message that most of the outermost quotes come from is the parent. Without a quote
that can be placed, a message replies to the turn before it.

Messages with one parent branch off; the first reply goes on with its parent's branch
and every other one begins a branch of its own. The head of a branch is found by
doubling along first replies, on (conversation, turn) keys, so that no conversation is
gathered in one task however long it is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordina.session import written

_MARKS = re.compile(r"[ \t]*((?:>[ \t]?)+)")
_SAID = re.compile(r"^\s*(?:on\b.{0,200}\bwrote|.{1,80}\b(?:wrote|said|schrieb|écrit|escribió))\s*:\s*$", re.IGNORECASE)
_OTHER = re.compile(r"[\W_]+")
LEAST_CHARS = 8


def levels(text: str) -> list[tuple[int, str]]:
    """(level, line without marks) of every line; level 0 is the message's own."""
    found = []
    for line in text.split("\n"):
        m = _MARKS.match(line)
        found.append((m.group(1).count(">"), line[m.end() :]) if m else (0, line))
    return found


def normal(text: str) -> str:
    return _OTHER.sub(" ", text.lower()).strip()


def _hash(plain: str) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(plain.encode("utf-8", "surrogatepass"))).view(np.int64))


def parse(text: str | None) -> tuple[str | None, list[tuple[int, int, int]], list[int], int]:
    """(own text, quotes, own hashes, deepest level).

    Quotes are (level, hash, characters) of whole passages and of their single lines;
    own hashes are those of the message, its paragraphs and its lines. A line that only
    introduces a quote ("... wrote:") belongs to it.
    """
    lines = levels(text or "")
    keep = []
    for i, (level, line) in enumerate(lines):
        after = next((v for v, x in lines[i + 1 : i + 3] if x.strip()), 0)
        if level == 0 and not (after > 0 and _SAID.match(line)):
            keep.append(line)
    own = re.sub(r"\n{3,}", "\n\n", "\n".join(keep)).strip("\n") if len(keep) < len(lines) else text
    passages: list[tuple[int, list[str]]] = []
    before = 0
    for level, line in lines:
        if level and passages and before == level:
            passages[-1][1].append(line)
        elif level:
            passages.append((level, [line]))
        before = level
    quotes = set()
    for level, part in passages:
        for plain in {normal(" ".join(part)), *map(normal, part)}:
            if len(plain) >= LEAST_CHARS:
                quotes.add((level, _hash(plain), len(plain)))
    mine = own or ""
    said = {normal(mine), *map(normal, re.split(r"\n\s*\n", mine)), *map(normal, mine.split("\n"))}
    deepest = max((level for level, _ in lines), default=0)
    return own, sorted(quotes), sorted(_hash(s) for s in said if len(s) >= LEAST_CHARS), deepest


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    quote = pa.list_(pa.struct([("level", pa.int32()), ("hash", pa.int64()), ("chars", pa.int64())]))
    for batch in batches:
        found = [parse(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(c) for c in ("conv_id", "turn", "role")),
                pa.array([f[0] for f in found], pa.string()),
                pa.array([[{"level": a, "hash": b, "chars": c} for a, b, c in f[1]] for f in found], quote),
                pa.array([f[2] for f in found], pa.list_(pa.int64())),
                pa.array([f[3] for f in found], pa.int32()),
            ],
            ["conv_id", "turn", "role", "text", "quotes", "said", "quote_depth"],
        )


def _parents(parsed: DataFrame) -> DataFrame:
    """(conv_id, turn, parent, n_linked) of every distinct turn; parent is null for a beginning."""
    placed = parsed.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    said = placed.select("conv_id", F.explode("said").alias("hash"), "turn")
    first = said.groupBy("conv_id", "hash").agg(F.min("turn").alias("origin"))
    quotes = placed.select("conv_id", "turn", F.inline("quotes")).distinct()
    links = quotes.join(first, ["conv_id", "hash"]).where("origin < turn")
    # The outermost quotes that can be placed come from the parent.
    by_origin = links.groupBy("conv_id", "turn", "origin").agg(
        F.min("level").alias("level"), F.sum("chars").alias("chars"), F.count(F.lit(1)).alias("n")
    )
    best = F.max_by("origin", F.struct(-F.col("level"), "chars", "origin")).alias("quoted")
    chosen = by_origin.groupBy("conv_id", "turn").agg(best, F.sum("n").alias("n_linked"))
    turns = placed.select("conv_id", "turn").distinct()
    earlier = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("turn").alias("previous"))
    rows = turns.join(chosen, ["conv_id", "turn"], "left").join(earlier, ["conv_id", "turn"], "left")
    return rows.select(
        "conv_id", "turn", F.coalesce("quoted", "previous").alias("parent"), F.coalesce("n_linked", F.lit(0)).alias("n_linked")
    )


def _heads(tree: DataFrame) -> DataFrame:
    """(conv_id, turn, branch, depth): first turn of the branch and number of messages before it there."""
    first = tree.where("parent IS NOT NULL").groupBy("conv_id", "parent").agg(F.min("turn").alias("turn"))
    first = first.select("conv_id", "turn", F.lit(True).alias("goes_on"))
    goes_on = F.coalesce("goes_on", F.lit(False))
    rows = tree.join(first, ["conv_id", "turn"], "left").select(
        "conv_id",
        "turn",
        F.when(goes_on, F.col("parent")).otherwise(F.col("turn")).alias("branch"),
        goes_on.cast("long").alias("depth"),
        (~goes_on).alias("done"),
    )
    rows = written(rows, "branches")
    while True:
        # Only rows that have not reached their head take another step.
        active = rows.where("NOT done")
        if active.isEmpty():
            return rows.drop("done")
        ahead = rows.select(
            "conv_id",
            F.col("turn").alias("branch"),
            F.col("branch").alias("head"),
            F.col("depth").alias("more"),
            F.col("done").alias("ends"),
        )
        moved = active.join(ahead, ["conv_id", "branch"]).select(
            "conv_id", "turn", F.col("head").alias("branch"), (F.col("depth") + F.col("more")).alias("depth"), F.col("ends").alias("done")
        )
        rows = written(rows.where("done").unionByName(moved), "branches")


def link(messages: DataFrame) -> DataFrame:
    """One row per message of `messages` (conv_id, turn, role, text), without quotes.

    conv_id, turn, role, text (its own words), parent_turn (the message that it answers,
    null at a beginning), branch (turn at which its line of replies begins), depth (place
    in that line), quote_depth, n_linked (quoted passages and lines whose origin was
    found). Ordered by (conv_id, branch, depth), messages read in reply order.

    A null or empty text stays null or empty and quotes nothing. Rows that repeat a
    turn share its place; a null conv_id or turn has no parent and is its own branch.
    Passages under 8 normalised characters link nothing; a quote of a later or of no
    message links nothing. Other columns are ignored; an empty table gives no rows.
    """
    kinds = {f.name: f.dataType.simpleString() for f in messages.schema}
    schema = (
        f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, text string,"
        " quotes array<struct<level:int,hash:bigint,chars:bigint>>, said array<bigint>, quote_depth int"
    )
    parsed = messages.select("conv_id", "turn", F.col("role").cast("string").alias("role"), "text")
    parsed = written(parsed.mapInArrow(_parsed, schema), "parsed")
    tree = written(_parents(parsed), "tree")
    place = tree.join(_heads(tree), ["conv_id", "turn"])
    rows = parsed.select("conv_id", "turn", "role", "text", "quote_depth").join(place, ["conv_id", "turn"], "left")
    return rows.select(
        "conv_id",
        "turn",
        "role",
        "text",
        F.col("parent").alias("parent_turn"),
        F.coalesce("branch", "turn").alias("branch"),
        F.coalesce("depth", F.lit(0)).alias("depth"),
        "quote_depth",
        F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
    )
