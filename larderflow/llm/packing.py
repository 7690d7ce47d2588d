"""Variable-capacity best-fit packing of documents into training sequences.

Documents become pieces no longer than the longest permitted length. Pieces are
dealt at random into blocks of bounded size; in a block, longest first, each
goes to the open bin it leaves the least room in. Where none has room, every
permitted length is tried against the histogram of the sizes still to come: the
new bin is filled with the largest of them that fit, one after another, and the
length is opened whose filled bin, shrunk to its contents, costs least per token.
At the end each bin shrinks to the least permitted length that holds what it got.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larderflow.llm.ordering import BLOCKS, key_block, running_total
from larderflow.llm.scratch import Scratch
from larderflow.llm.text import n_words

#: Permitted sequence lengths.
LENGTHS = (256, 512, 1024, 1536, 2048, 3072, 4096)
#: What a sequence of c tokens costs, in tokens: c, a fixed OVERHEAD, and attention, c * c / ATTENTION.
OVERHEAD, ATTENTION = 16, 1 << 16
#: Pieces packed together.
BLOCK_ROWS = 50_000


def sequence_cost(length: int, overhead: float = OVERHEAD, attention: float = ATTENTION) -> float:
    return length + overhead + length * length / attention


def _opened(size: int, lengths: tuple[int, ...], costs: list[float], left: np.ndarray, sizes_left: int) -> int:
    """The length to open for a piece: of least expected cost per token, of equal costs the shortest.

    ``left`` counts the pieces to come by size, and bit s of ``sizes_left`` is set
    if there is one of size s. A bin's expected contents are the piece and then,
    as long as one fits, the largest piece to come.
    """
    best, choice = (float("inf"), 0), 0
    for c in lengths:
        room = c - size
        if room < 0:
            continue
        most = room
        while most and (fits := sizes_left & ((2 << most) - 1)):
            largest = fits.bit_length() - 1
            room -= min(int(left[largest]), room // largest) * largest
            most = min(largest - 1, room)
        used = c - room
        cost = (next(y for x, y in zip(lengths, costs, strict=True) if x >= used) / used, c)
        if cost < best:
            best, choice = cost, c
    return choice


def pack(
    sizes: np.ndarray, lengths: tuple[int, ...] = LENGTHS, overhead: float = OVERHEAD, attention: float = ATTENTION
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each piece, its place in the bin, permitted length of each bin, length it was opened with) for pieces of 1 to max(lengths) tokens.

    Room is a bit set: bit r is set if an open bin has r tokens left, so the
    best fit for a piece is the lowest set bit from its size up.
    """
    lengths = tuple(sorted(lengths))
    costs = [sequence_cost(c, overhead, attention) for c in lengths]
    order = np.argsort(-sizes, kind="stable")
    left = np.bincount(sizes, minlength=lengths[-1] + 1) if len(sizes) else np.zeros(lengths[-1] + 1, dtype=np.int64)
    sizes_left = sum(1 << int(s) for s in np.flatnonzero(left))
    bins, offsets = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
    used: list[int] = []
    opened: list[int] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0
    for k in order.tolist():
        size = int(sizes[k])
        left[size] -= 1
        if not left[size]:
            sizes_left ^= 1 << size
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            b = len(used)
            room = _opened(size, lengths, costs, left, sizes_left)
            used.append(0)
            opened.append(room)
        bins[k], offsets[k] = b, used[b]
        used[b] += size
        if spare := room - size:
            if not by_room.setdefault(spare, []):
                rooms |= 1 << spare
            by_room[spare].append(b)
    ends = np.array(used, dtype=np.int64)
    shrunk = np.array(lengths)[np.searchsorted(lengths, ends)] if len(ends) else ends
    return bins, offsets, shrunk, np.array(opened, dtype=np.int64)


def _packed(lengths: tuple[int, ...], overhead: float, attention: float):
    def block(frame: pd.DataFrame) -> pd.DataFrame:
        # the order of arrival is not kept by a shuffle; this one is
        frame = frame.sort_values(["size", "key", "doc_id", "piece"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        bins, offsets, capacity, opened = pack(frame["size"].to_numpy(), lengths, overhead, attention)
        used = np.bincount(bins, weights=frame["size"], minlength=len(capacity)).astype(np.int64)
        return frame.assign(bin=bins, offset=offsets, capacity=capacity[bins], used=used[bins], opened=opened[bins])[
            ["doc_id", "piece", "from_token", "size", "block", "bin", "offset", "capacity", "used", "opened"]
        ]

    return block


def pack_documents(
    docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, overhead: float = OVERHEAD, seed: int = 13, tokens: Column | None = None, block_rows: int = BLOCK_ROWS,
    attention: float = ATTENTION,
) -> DataFrame:
    """Rows ``doc_id, piece, from_token, size, bin_id, offset, capacity, used, opened``: one per piece of each row of ``docs``.

    A document has ``tokens`` tokens (default: its words and one separator, so
    null and empty texts have one). It is cut into pieces of max(lengths) tokens
    and a rest; ``piece`` counts from 0, ``from_token`` is where a piece starts.
    Pieces of a bin lie one after another from ``offset`` 0 without gaps and sum
    to ``used``; ``capacity`` is the least permitted length from there, ``opened``
    the one the bin was opened with. A bin is named block:number. Pieces are dealt
    to blocks of about ``block_rows`` by rank of a hash of doc_id, text, size and
    piece, so repeated rows and ties never swell a block, nor do rows that share
    an id or have none; the blocks depend on the rows alone. An empty table gives
    no rows.
    """
    lengths = tuple(sorted(lengths))
    most = lengths[-1]
    scratch = Scratch(docs.sparkSession, "packing")
    tokens = n_words(F.col("text")) + 1 if tokens is None else tokens
    doc_hash = F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.lit(-1)), F.coalesce("text", F.lit("")))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), doc_hash.alias("doc_hash"), F.greatest(F.lit(1), tokens).cast("long").alias("total"))
    pieces = slim.select("doc_id", "doc_hash", "total", F.explode(F.expr(f"sequence(0L, (total - 1) div {most})")).alias("piece"))
    pieces = pieces.withColumn("from_token", F.col("piece") * most)
    pieces = pieces.withColumn("size", F.least(F.lit(most), F.col("total") - F.col("from_token"))).drop("total")
    key = F.xxhash64("doc_hash", "size", "piece")
    pieces = scratch.table(pieces.withColumn("key", key).drop("doc_hash").withColumn("range", key_block(F.col("key"), BLOCKS)), "pieces")
    ranked = running_total(pieces.withColumn("all", F.lit(0)), ["all"], "range", ["key", "doc_id", "piece"], F.lit(1).cast("long"), "rank")
    dealt = ranked.withColumn("block", F.expr(f"rank div {block_rows}")).select("doc_id", "piece", "from_token", "size", "key", "block")
    schema = "doc_id long, piece long, from_token long, size long, block long, bin long, offset long, capacity long, used long, opened long"
    out = scratch.table(dealt.groupBy("block").applyInPandas(_packed(lengths, overhead, attention), schema), "out")
    scratch.drop("pieces")
    return out.select(
        "doc_id", "piece", "from_token", "size", F.concat_ws(":", "block", "bin").alias("bin_id"), "offset", "capacity", "used", "opened"
    )
