"""Near-duplicates by SimHash with an exact tiled comparison of fingerprints.

Distinct fingerprints are put in cells by the bit counts of their halves, cells
are cut into tiles of bounded size, and two tiles are compared only if their
cells' bit counts differ by no more than the radius. A task compares a pair of
tiles with numpy exclusive-or and bit counts, in blocks, again skipping groups
whose bit counts in four quarters differ beyond the radius; both skips are
exact, as each differing bit changes one count by one. A pair of tiles returns a
spanning forest of its links, so a group of thousands of near copies yields as
many edges as it has members, and no component loses a link.

``near_duplicates`` links by the fingerprints alone. ``similar`` finds documents
of a given Jaccard similarity: wider fingerprints and a radius that such pairs
stay within give candidates, whose sets of shingles are then compared. At that
radius few tiles can be skipped, so it compares fingerprints where sets share a
band of least hashes, which grows with the texts and with the groups that are
alike, not with all pairs of texts.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larderflow.llm.components import components
from larderflow.llm.likeness import BANDS, BITMAP, LEAST, WIDTH, WORDS, B, K, P, bands, bitmap, set_name, shingles, texts, verified
from larderflow.llm.scratch import Scratch, arrow_batches

RADIUS = 3
#: Fingerprints of a tile, about.
TILE = 16_384
#: Comparisons that numpy makes at a time.
BLOCK = 1 << 18


def simhash(raw: bytes, width: int = 3) -> int:
    """The 64-bit fingerprint of a UTF-8 text; 0 if it has no words."""
    words = raw.lower().split()  # on bytes: A to Z, and exactly space and tab to carriage return
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = np.array([xxhash.xxh64_intdigest(joined, 42)], dtype=np.uint64)
    else:
        lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(lens + 1) - 1
        first, last = (ends - lens)[: 1 - width].tolist(), ends[width - 1 :].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(first, last, strict=True)), dtype=np.uint64, count=len(first))
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column("text").cast(pa.large_binary())
        prints = np.fromiter((simhash(t.as_py() or b"") for t in texts), dtype=np.uint64, count=len(texts))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), pa.array(prints.view(np.int64))], ["doc_id", "key", "print"])


def _quarters(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prints sorted by the bit counts of their quarters; where each group of equal counts starts; the counts."""
    counts = np.bitwise_count(prints.view(np.uint16)).reshape(-1, 4).astype(np.int32)
    code = counts @ np.array([17**3, 17**2, 17, 1], dtype=np.int32)
    order = np.argsort(code, kind="stable")
    _, start = np.unique(code[order], return_index=True)
    return order, start, counts[order][start]


def tile_forest(a: np.ndarray, b: np.ndarray | None, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges (as two arrays of fingerprints) that connect exactly what links between or within the tiles connect."""
    order_a, start_a, counts_a = _quarters(a)
    a = a[order_a]
    if b is None:
        b, start_b, counts_b, shift = a, start_a, counts_a, 0
    else:
        order_b, start_b, counts_b = _quarters(b)
        b, shift = b[order_b], len(a)
    stop_a, stop_b = np.append(start_a[1:], len(a)), np.append(start_b[1:], len(b))
    nodes = a if not shift else np.concatenate([a, b])
    parent = np.arange(len(nodes))

    def link(u: np.ndarray, v: np.ndarray) -> None:
        nonlocal parent
        while len(u):
            ru, rv = parent[u], parent[v]
            apart = ru != rv
            if not apart.any():
                return
            u, v, ru, rv = u[apart], v[apart], ru[apart], rv[apart]
            np.minimum.at(parent, np.maximum(ru, rv), np.minimum(ru, rv))
            while (up := parent[parent]).tobytes() != parent.tobytes():
                parent = up

    for g in range(len(start_a)):
        near = np.flatnonzero(np.abs(counts_b - counts_a[g]).sum(axis=1) <= radius)
        if not shift:
            near = near[near >= g]
        if not len(near):
            continue
        pick = np.concatenate([np.arange(start_b[n], stop_b[n]) for n in near])
        others = b[pick]
        rows = max(1, BLOCK // len(others))
        for at in range(start_a[g], stop_a[g], rows):
            mine = a[at : min(at + rows, stop_a[g])]
            i, j = np.nonzero(np.bitwise_count(mine[:, None] ^ others[None, :]) <= radius)
            u, v = at + i, shift + pick[j]
            other = u != v
            link(u[other], v[other])
    tail = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[tail], nodes[parent[tail]]


def _compare(radius: int):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right, same = batch.column("left"), batch.column("right"), batch.column("same").to_pylist()
            for n in range(batch.num_rows):
                get = lambda c: c[n].values.to_numpy(zero_copy_only=False).view(np.uint64)  # noqa: B023, E731
                u, v = tile_forest(get(left), None if same[n] else get(right), radius)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    return over


def links(prints: DataFrame, radius: int, scratch: Scratch, tile: int = TILE) -> DataFrame:
    """A spanning forest ``u, v`` of the links between distinct fingerprints (column ``print``)."""
    spark = prints.sparkSession
    cell = (F.bit_count(F.shiftrightunsigned("print", 32)) * 33 + F.bit_count(F.col("print").bitwiseAND(0xFFFFFFFF))).cast("int")
    celled = prints.select("print", cell.alias("cell"))
    # at most 33 x 33 rows, whatever the input is
    sizes = celled.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    sizes = scratch.table(sizes, "cells")
    chunk = F.pmod(F.xxhash64("print"), F.col("tiles")).cast("int")
    tiles = celled.join(F.broadcast(sizes), "cell").withColumn("chunk", chunk)
    tiles = scratch.table(tiles.groupBy("cell", "chunk").agg(F.collect_list("print").alias("prints")), "tiles")
    # of cells, not of rows: 25 neighbours each at most, found by their numbers
    near = [(p, q) for p in range(-radius, radius + 1) for q in range(-radius, radius + 1) if abs(p) + abs(q) <= radius]
    step = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p, q in near]))
    a = sizes.select(F.col("cell").alias("cell_a"), F.col("tiles").alias("tiles_a"), step.alias("s"))
    hi, lo = F.expr("cell_a div 33 + s.p"), F.expr("cell_a % 33 + s.q")
    a = a.filter(hi.between(0, 32) & lo.between(0, 32)).withColumn("cell_b", (hi * 33 + lo).cast("int")).filter("cell_a <= cell_b")
    pairs = a.join(sizes.select(F.col("cell").alias("cell_b"), F.col("tiles").alias("tiles_b")), "cell_b")
    pairs = pairs.withColumn("chunk_a", F.explode(F.expr("sequence(0, tiles_a - 1)")))
    pairs = pairs.withColumn("chunk_b", F.explode(F.expr("sequence(0, tiles_b - 1)")))
    pairs = pairs.filter("cell_a < cell_b or chunk_a <= chunk_b").select("cell_a", "chunk_a", "cell_b", "chunk_b")
    side = lambda s, name: tiles.select(F.col("cell").alias(f"cell_{s}"), F.col("chunk").alias(f"chunk_{s}"), F.col("prints").alias(name))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = pairs.join(side("a", "left"), ["cell_a", "chunk_a"]).join(side("b", "right"), ["cell_b", "chunk_b"])
    same = (F.col("cell_a") == F.col("cell_b")) & (F.col("chunk_a") == F.col("chunk_b"))
    # the join deals by tile; a tile's pairs go to different tasks
    both = both.select("left", "right", same.alias("same"), F.xxhash64("cell_a", "chunk_a", "cell_b", "chunk_b").alias("deal")).repartition(4 * n, "deal")
    with arrow_batches(spark, 4):
        found = scratch.table(both.select("left", "right", "same").mapInArrow(_compare(radius), "u long, v long"), "links")
    scratch.drop("tiles", "cells")
    return found


def near_duplicates(docs: DataFrame, radius: int = RADIUS, keys: str | None = None, tile: int = TILE) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, key, print, component_id``.

    ``print`` is the fingerprint as a signed long; fingerprints link at
    ``radius`` or fewer differing bits, and ``component_id`` is the least doc_id
    that links reach (null only if no document reached has an id). Null text and
    text without words have fingerprint 0 and link like any other. Equal
    fingerprints are compared once, so copies add no pairs. An empty table gives
    no rows. ``keys`` names a long column of ``docs`` to return as ``key``.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "simhash")
    key = F.col(keys).cast("long") if keys else F.lit(None).cast("long")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), F.col("text").cast("string").alias("text"))
    with arrow_batches(spark):
        prints = scratch.table(slim.mapInArrow(_prints, "doc_id long, key long, print long"), "prints")
    nodes = scratch.table(prints.groupBy("print").agg(F.min("doc_id").alias("low")), "nodes")
    labels = components(links(nodes, radius, scratch, tile), scratch)
    marked = nodes.join(labels.withColumnRenamed("u", "print"), "print", "left")
    marked = scratch.table(marked.withColumn("label", F.coalesce("label", "print")), "marked")
    least = marked.groupBy("label").agg(F.min("low").alias("component_id"))
    found = scratch.table(marked.join(least, "label").select("print", "component_id"), "found")
    scratch.drop("nodes", "marked", "links")
    # plain scans on both sides: adaptive execution can split a hot fingerprint
    return prints.join(found, "print").select("doc_id", "key", "print", "component_id")


# --- near-duplicates of a given Jaccard similarity ---------------------------

#: Differing bits of the wide fingerprints up to which a pair's shingles are compared.
WIDE_RADIUS = 40
#: Wide fingerprints of a tile, which holds the sets of a band or part of them, about.
WIDE_TILE = 32_768


def wide_print(hashes: np.ndarray, words: int = WORDS) -> np.ndarray:
    """A fingerprint of ``words`` x 64 bits: a bit is 1 if set in over half the hashes, which are mixed anew for each word but the first."""
    out = np.zeros(words, dtype=np.uint64)
    for w in range(words if len(hashes) else 0):
        if w:  # the finaliser of MurmurHash3, a fixed bijection
            hashes = hashes ^ (hashes >> np.uint64(33))
            hashes = hashes * np.uint64(0xFF51AFD7ED558CCD)
            hashes = (hashes ^ (hashes >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
            hashes = hashes ^ (hashes >> np.uint64(33))
        ones = np.zeros(64, dtype=np.int64)
        for at in range(0, len(hashes), 1 << 16):
            part = hashes[at : at + (1 << 16)]
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[w] = np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0]
    return out


#: Columns of bitmaps folded to half their bits, which goes on to bound the members that differ from below.
SHORT = [f"s{w}" for w in range(BITMAP // 2)]


def _wide(width: int):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t, width) for t in texts(b)]
            longs = lambda rows, k: [pa.array(c) for c in np.array(rows, dtype=np.uint64).reshape(-1, k).T.view(np.int64)]
            columns = [b.column("doc_id"), b.column("key"), pa.array([set_name(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64())]
            columns += longs([wide_print(s) for s in sets], WORDS) + longs([bitmap(s) for s in sets], BITMAP)
            columns += longs([bands(s) for s in sets], BANDS)
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "set", "n", *P, *B, *K])

    return over


def alike(a: dict, b: dict | None, radius: int, least: tuple[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of sets (as two arrays of names) between or within tiles whose labels differ and whose fingerprints are within the radius.

    A tile is a dict of arrays: ``set``, ``label``, ``n``, the words of the
    fingerprints and of short bitmaps. Pairs whose sizes or bitmaps rule out a
    similarity of ``least`` are left out.
    """
    p, q = least
    same, b = b is None, a if b is None else b
    rows = max(1, BLOCK // max(1, len(b["set"])))
    for first in range(0, len(a["set"]), rows):
        from_ = first if same else 0
        apart = functools.reduce(np.add, [np.bitwise_count(a[w][first : first + rows, None] ^ b[w][None, from_:]) for w in P])
        i, j = np.nonzero(apart <= radius)
        i, j = i + first, j + from_
        keep = a["label"][i] != b["label"][j]
        keep &= (i < j) if same else True
        i, j = i[keep], j[keep]
        n, m = a["n"][i], b["n"][j]
        differ = functools.reduce(np.add, [np.bitwise_count(a[w][i] ^ b[w][j]).astype(np.int64) for w in SHORT])
        # members that are shared: (n + m - members that differ) / 2
        keep = (q * np.minimum(n, m) >= p * np.maximum(n, m)) & ((p + q) * (n + m - differ) >= 2 * p * (n + m))
        i, j = i[keep], j[keep]
        if len(i):
            yield np.minimum(a["set"][i], b["set"][j]), np.maximum(a["set"][i], b["set"][j])


#: What a tile holds of each set.
FIELDS = ["set", "label", "n", *P, *SHORT]


def _alike(radius: int, least: tuple[int, int]):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, of = {}, None
        for batch in batches:
            for n, row in enumerate(batch.select(["pair", "right"]).to_pylist()):
                values = batch.column("rows")[n].values
                tile = {name: values.field(name).to_numpy(zero_copy_only=False) for name in FIELDS}
                tile |= {w: tile[w].view(np.uint64) for w in (*P, *SHORT)}
                # a pair's rows come one after the other, the left tile first; a tile's pair with itself has one row
                if not row["right"]:
                    left, of = tile, row["pair"]
                    if of[1] != of[2]:
                        continue
                assert row["pair"] == of
                for u, v in alike(left, tile if row["right"] else None, radius, least):
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return over


def sharing(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """``band, set, low`` for the sets of each band that several have; ``low`` is the least of them.

    A band's least and greatest set are partial aggregates and are joined to its
    sets as a plain table, so adaptive execution can split a band that many share.
    """
    spread = nodes.filter("n > 0").select("set", F.explode(F.array(*K)).alias("band"))
    several = spread.groupBy("band").agg(F.min("set").alias("low"), F.max("set").alias("high")).filter("low < high").select("band", "low")
    several = scratch.table(several, "several")
    shared = scratch.table(spread.join(several, "band").select("band", "set", "low"), "shared")
    scratch.drop("several")
    return shared


def candidates(shared: DataFrame, marked: DataFrame, radius: int, least: tuple[int, int], scratch: Scratch, tile: int = WIDE_TILE) -> DataFrame:
    """Pairs ``u, v`` of sets (``marked``: set, label, n, fingerprint and bitmap words) of unlike labels in one band, as ``alike`` gives them.

    Only bands with sets of several labels are compared. One of more than
    ``tile`` sets is cut by hash, and each tile is sent once for each tile it is
    compared with.
    """
    spark = marked.sparkSession
    labelled = shared.select("band", "set").join(marked.select("set", "label"), "set")
    # band, chunks, of the bands that are not of one label
    mixed = labelled.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n")).filter("low < high")
    mixed = scratch.table(mixed.select("band", F.ceil(F.col("n") / tile).cast("int").alias("chunks")), "mixed")
    placed = scratch.table(shared.select("band", "set").join(mixed, "band").withColumn("chunk", F.expr("pmod(xxhash64(set), chunks)").cast("int")), "placed")
    tiles = placed.join(marked.select(*FIELDS), "set").groupBy("band", "chunk").agg(F.max("chunks").alias("chunks"), F.collect_list(F.struct(*FIELDS)).alias("rows"))
    tiles = scratch.table(tiles, "tiles")

    def partners(right: bool) -> DataFrame:
        others = F.expr("sequence(0, chunk)" if right else "sequence(chunk, chunks - 1)")
        out = tiles.withColumn("other", F.explode(others)).filter("other < chunk" if right else "true")
        pair = ["other", "chunk"] if right else ["chunk", "other"]
        return out.select(F.array("band", *[F.col(c).cast("long") for c in pair]).alias("pair"), F.lit(right).alias("right"), "rows")

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = partners(False).unionByName(partners(True)).repartition(n, "pair").sortWithinPartitions("pair", "right")
    with arrow_batches(spark):
        found = scratch.table(dealt.mapInArrow(_alike(radius, least), "u long, v long"), "within")
    scratch.drop("mixed", "placed", "tiles")
    return found


def similar(docs: DataFrame, keys: str, width: int = WIDTH, least: tuple[int, int] = LEAST, radius: int = WIDE_RADIUS, tile: int = WIDE_TILE) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, key, label, component_id``.

    Documents link if the sets of their ``width``-word shingles share a band of
    least hashes, their wide fingerprints are within ``radius`` and the sets have a
    Jaccard similarity of ``least`` or more, which is checked exactly, sets being
    equal if their 64-bit names are. The default radius lies five standard
    deviations above the expected distance at 0.8. A first round checks each set
    against the least one of each of its bands, a second all pairs of a band that
    are not in one component by then, so a large group of near copies costs few
    checks and no candidate is left out. ``label`` names a
    component, and ``component_id`` is its least doc_id (null if no document there
    has an id). Null text and text without words are alike, and unlike any other.
    ``keys`` names a long column that tells unlike rows of ``docs`` apart. An
    empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "similar")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(keys).cast("long").alias("key"), F.col("text").cast("string").alias("text"))
    longs = [*P, *B, *K]
    with arrow_batches(spark):
        schema = "doc_id long, key long, set long, n long, " + ", ".join(f"{c} long" for c in longs)
        prints = scratch.table(slim.mapInArrow(_wide(width), schema), "prints")
    nodes = prints.groupBy("set").agg(F.min("doc_id").alias("low"), F.min("key").alias("key"), *[F.min(c).alias(c) for c in ("n", *longs)])
    folded = {w: F.col(b).bitwiseXOR(F.col(c)) for b, c, w in zip(B[: len(SHORT)], B[len(SHORT) :], SHORT, strict=True)}
    nodes = scratch.table(nodes.withColumns(folded), "nodes")
    members = scratch.table(prints.select("doc_id", "key", "set"), "members")
    scratch.drop("prints")
    shared = sharing(nodes, scratch)
    first = shared.filter("set != low").select(F.col("low").alias("u"), F.col("set").alias("v"))
    first = verified(first, nodes, slim, width, least, radius, scratch, "first")
    labels = scratch.table(components(first, scratch).withColumnRenamed("u", "set"), "labels")
    marked = nodes.join(labels, "set", "left").withColumn("label", F.coalesce("label", "set"))
    marked = marked.select("set", "label", "low", "n", *P, *SHORT)
    marked = scratch.table(marked, "marked")
    second = candidates(shared, marked, radius, least, scratch, tile)
    second = verified(second, nodes, slim, width, least, radius, scratch, "second")
    # links between components of the first round; there are few
    name = lambda s: marked.select(F.col("set").alias(s), F.col("label").alias(f"label_{s}"))
    more = second.join(name("u"), "u").join(name("v"), "v").select(F.col("label_u").alias("u"), F.col("label_v").alias("v"))
    more = components(more, scratch).toDF("label", "joined")
    named = marked.join(more, "label", "left").select("set", "low", F.coalesce("joined", "label").alias("label"))
    named = scratch.table(named, "named")
    lowest = named.groupBy("label").agg(F.min("low").alias("component_id"))
    found = scratch.table(named.join(lowest, "label").select("set", "label", "component_id"), "found")
    scratch.drop("nodes", "marked", "named", "labels", "shared", "within", "first", "second")
    # plain scans on both sides: adaptive execution can split a set of many copies
    return members.join(found, "set").select("doc_id", "key", "label", "component_id")


def hex_print(print_: str = "print"):
    return F.lpad(F.lower(F.hex(print_)), 16, "0")
