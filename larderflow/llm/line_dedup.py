"""Removal of repeated line runs by distributed prefix doubling.

Every document is a sequence of line IDs. Round k ranks the suffixes by their
first 2^k lines: a suffix' rank is that of the pair (rank of its first half,
rank of the half that follows). Pairs are counted with partial sums, and ranks
are given in sorted order by a range sort of the distinct pairs, so they are the
suffix array's inverse as far as 2^k lines tell suffixes apart. Suffixes whose
prefix occurs once share no longer prefix with any other and leave; most lines
are unique, so the first round already leaves a small rest.

Suffixes that agree in their first m lines form the longest-common-prefix
interval of depth m, named by two ranks of the largest 2^k <= m that overlap to
cover m lines. A run of lines is a copy if it holds at least ``min_words`` words
and its interval has an earlier member. Each line of a copy that is not the
first lies in a shortest such run that starts at it, or in a shortest one that
ends where the maximal run ends, and any shortest run inside a copy is a copy
itself. So the intervals at the shortest sufficient depths from each line on and
back from each line reveal all maximal runs, and the lines they cover are the
ones to delete.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larderflow.llm.scratch import Scratch
from larderflow.llm.text import n_words

DOC = ["k1", "k2"]
LEAST = -(2**63)


def _shortest_runs(min_words: int):
    """From rows (k1, k2, i, w) sorted by document and line: shortest sufficient runs as (k1, k2, start, m)."""

    def runs(f: pd.DataFrame) -> pd.DataFrame:
        k1, k2, i, w = (f[c].to_numpy() for c in ("k1", "k2", "i", "w"))
        new = np.ones(len(f), dtype=bool)
        new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]) | (i[1:] != i[:-1] + 1)
        island, at = np.cumsum(new), np.arange(len(f))
        ends = np.cumsum(w)
        starts = ends - w
        to = np.searchsorted(ends, starts + min_words)  # first line at which the run from each line suffices
        ok = to < len(f)
        ok[ok] = island[to[ok]] == island[ok]
        back = np.searchsorted(starts, ends - min_words, side="right") - 1  # last line from which a run to each line suffices
        ok_back = back >= 0
        ok_back[ok_back] = island[back[ok_back]] == island[ok_back]
        s = np.concatenate([at[ok], back[ok_back]])
        m = np.concatenate([to[ok] - at[ok], at[ok_back] - back[ok_back]]) + 1
        return pd.DataFrame({"k1": k1[s], "k2": k2[s], "start": i[s], "m": m.astype("int32")}).drop_duplicates()

    def over(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # the rows of a document that may go on in the next batch
        for f in frames:
            if not len(f):
                continue
            last = (f["k1"] == f["k1"].iloc[-1]) & (f["k2"] == f["k2"].iloc[-1])
            cut = int(np.argmax(last.to_numpy()))
            if cut or (held and (held[-1]["k1"].iloc[-1], held[-1]["k2"].iloc[-1]) != (f["k1"].iloc[0], f["k2"].iloc[0])):
                yield runs(pd.concat([*held, f.iloc[:cut]], ignore_index=True))
                held = []
            held.append(f.iloc[cut:])
        if held:
            yield runs(pd.concat(held, ignore_index=True))

    return over


def _ranked(pairs: DataFrame, keys: list[str], scratch: Scratch, name: str, rows: int | None = None) -> DataFrame:
    """Keys that occur at least twice, with ``r``: ranks in key order (not dense)."""
    twice = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*keys)
    n = int(twice.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = twice.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    return scratch.table(ordered.withColumn("r", F.monotonically_increasing_id()), name, rows)


def repeated_lines(docs: DataFrame, min_words: int, scratch: Scratch) -> DataFrame:
    """Lines to delete: ``k1, k2, cut`` (an array of line numbers from 0) for each document that loses any."""
    lines = docs.select(*DOC, F.posexplode(F.split("text", "\n")).alias("i", "line"))
    lines = scratch.table(
        lines.select(*DOC, "i", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("id"), "line").alias("h2"), n_words(F.col("line")).cast("int").alias("w")),
        "lines",
    )
    ids = _ranked(lines, ["h1", "h2"], scratch, "ids")
    # plain scans on both sides: adaptive execution can split a hot line
    active = lines.join(ids, ["h1", "h2"]).groupBy(*DOC, "i").agg(F.first("w").alias("w"), F.first("r").alias("r"))
    active = scratch.table(active, "active0")
    rows = active.count()
    scratch.drop("lines", "ids")
    sorted_lines = active.select(*DOC, "i", "w").repartition(*DOC).sortWithinPartitions(*DOC, "i")
    runs = sorted_lines.mapInPandas(_shortest_runs(min_words), "k1 long, k2 long, start int, m int")
    # the largest k with 2^k <= m
    runs = runs.withColumn("level", (F.length(F.bin(F.col("m"))) - 1).cast("int"))
    runs = runs.withColumn("off", (F.col("start") + F.col("m") - F.expr("shiftleft(1, level)")).cast("int"))
    runs = scratch.table(runs, "runs", 2 * rows)
    levels = sorted(r[0] for r in runs.select("level").distinct().collect())
    cuts, ranks = [], active.select(*DOC, "i", "r")
    for k in range(levels[-1] + 1 if levels else 0):
        if k in levels:
            cuts.append(_later_copies(runs.filter(F.col("level") == k), ranks, scratch, k, 2 * rows))
        if k < levels[-1]:
            follow = F.max("r").over(W.partitionBy(*DOC).orderBy("i").rangeBetween(2**k, 2**k))
            pairs = scratch.table(ranks.withColumn("r2", follow).filter(F.col("r2").isNotNull()), f"pairs{k}", rows)
            rows = pairs.count()
            classes = _ranked(pairs.withColumnRenamed("r", "r1"), ["r1", "r2"], scratch, f"classes{k}", rows)
            pairs = pairs.withColumnRenamed("r", "r1")
            ranks = scratch.table(pairs.join(classes, ["r1", "r2"]).select(*DOC, "i", "r"), f"ranks{k + 1}", rows)
            scratch.drop(f"pairs{k}", f"classes{k}", f"ranks{k}")
    scratch.drop("active0", "runs")
    if not cuts:
        return None
    found = cuts[0]
    for more in cuts[1:]:
        found = found.unionByName(more)
    covered = found.select(*DOC, F.explode(F.expr("sequence(start, start + m - 1)")).alias("i")).distinct()
    out = scratch.table(covered.groupBy(*DOC).agg(F.collect_list("i").alias("cut")), "cut")
    scratch.drop(*[f"cuts{k}" for k in levels])
    return out


def _later_copies(runs: DataFrame, ranks: DataFrame, scratch: Scratch, k: int, rows: int) -> DataFrame:
    """Those of the runs (k1, k2, start, m), ``rows`` at most, whose interval has an earlier member."""
    at = lambda pos, r: ranks.select(*DOC, F.col("i").alias(pos), F.col("r").alias(r))
    named = runs.join(at("start", "a"), [*DOC, "start"]).join(at("off", "b"), [*DOC, "off"])
    named = scratch.table(named.select(*DOC, "start", "m", "a", "b"), f"named{k}", rows)
    place = F.struct(*DOC, "start")
    firsts = named.groupBy("m", "a", "b").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    firsts = scratch.table(firsts, f"firsts{k}", rows)
    later = named.join(firsts, ["m", "a", "b"]).filter(place > F.col("first")).select(*DOC, "start", "m")
    later = scratch.table(later, f"cuts{k}", rows)
    scratch.drop(f"named{k}", f"firsts{k}")
    return later


def dedup_lines(docs: DataFrame, min_words: int = 50, removed: str | None = None) -> DataFrame:
    """``docs`` with later copies of repeated line runs deleted from ``text``; all other columns unchanged.

    Lines are what line feeds separate, and are equal if their bytes are. A run
    of consecutive lines with at least ``min_words`` words that occurs again is
    kept where it occurs first, in order of doc_id (null first), text hash and
    line, and deleted elsewhere; runs do not cross documents, and copies may
    overlap. Rows that agree in doc_id and text count as one document and all
    get its result. Null text stays null, a document that loses all lines gets
    the empty text, and an empty table gives no rows. ``removed`` names a column
    for how many lines were deleted. Line IDs are 128 bits of XXH64.
    """
    scratch = Scratch(docs.sparkSession, "line-dedup")
    text = F.col("text").cast("string")
    k1, k2 = F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)), F.xxhash64(F.coalesce(text, F.lit("")))
    cut = repeated_lines(docs.filter(text.isNotNull()).select(k1.alias("k1"), k2.alias("k2"), text.alias("text")), min_words, scratch)
    names = docs.columns
    if cut is None:
        return docs.withColumn(removed, F.lit(0)) if removed else docs
    # own names for the join, so no column of the input can clash
    # the cuts grow with the corpus: the same join at every size, never a broadcast
    cut = cut.select(F.col("k1").alias("__ld_k1"), F.col("k2").alias("__ld_k2"), F.col("cut").alias("__ld_cut")).hint("merge")
    out = docs.withColumns({"__ld_k1": k1, "__ld_k2": k2}).join(cut, ["__ld_k1", "__ld_k2"], "left")
    lines = F.split("text", "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__ld_cut"))
    left = F.array_join(F.transform(kept, lambda i: F.element_at(lines, i + 1)), "\n")
    text = F.when(F.col("__ld_cut").isNull() | F.col("text").isNull(), F.col("text")).otherwise(left)
    count = {removed: F.when(F.col("text").isNull(), 0).otherwise(F.coalesce(F.size("__ld_cut"), F.lit(0)))} if removed else {}
    return out.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in names], *[v.alias(k) for k, v in count.items()])
