"""Canonical exact document fingerprints (native).

A text's canonical form is its Unicode compatibility composition, case-folded,
composed again, with every run of white space made one space and none at the
ends. Its fingerprint is 128 bits of XXH64 under two seeds. Inside a bucket of
equal hashes the canonical bytes themselves are compared; texts of a bucket
that holds different ones get their SHA-256 instead, so equal fingerprints mean
equal canonical texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larderflow.llm.scratch import Scratch
from larderflow.llm.text import static

LEAST = -(2**63)
#: Bytes of hashes that may be broadcast; beyond it the joins shuffle.
BROADCAST_BYTES = 64 << 20
#: Key ranges per shuffle partition, so that hashing them to tasks loads tasks alike; rows of one where tables are large; most of them.
BLOCKS_PER_PARTITION, BLOCK_ROWS, MOST_BLOCKS = 8, 100_000, 16_384


def canonical(text: Column) -> Column:
    """NFKC, full case folding, NFKC again, white space folded; null counts as empty."""
    compose = lambda c: static("com.ibm.icu.text.Normalizer.compose", c, F.lit(True))
    folded = static("com.ibm.icu.lang.UCharacter.foldCase", compose(F.coalesce(text, F.lit(""))), F.lit(True))
    return F.regexp_replace(F.regexp_replace(compose(folded), r"(?U)\s+", " "), "^ | $", "")


def wide_hash(canon: Column, bits: int = 128) -> Column:
    """Two XXH64 of the canonical text as 32 hex digits; ``bits`` cuts it (for tests of the byte comparison)."""
    half = lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")
    return F.substring(F.concat(half(F.xxhash64(canon)), half(F.xxhash64(F.lit("wide"), canon))), 1, bits // 4)


def _small(hashes: DataFrame) -> DataFrame:
    """Broadcast if all its rows are known to fit; otherwise left to a shuffle."""
    return F.broadcast(hashes) if hashes.count() * 80 <= BROADCAST_BYTES else hashes.hint("merge")


def collisions(docs: DataFrame, scratch: Scratch, bits: int) -> DataFrame:
    """Hashes that different canonical texts share, found by comparing the texts of each bucket.

    Grouping by hash and text combines copies before the shuffle: a text that is
    a third of all rows costs one row per task.
    """
    canon = docs.select(canonical(F.col("text")).alias("canon")).withColumn("hash", wide_hash(F.col("canon"), bits))
    buckets = scratch.table(canon.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("hash"), "buckets")
    members = canon.join(_small(buckets), "hash", "left_semi")
    texts = members.groupBy("hash", "canon").agg(F.count(F.lit(1)).alias("n"))
    return scratch.table(texts.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("hash"), "collided")


def _constants(values: list, kind: str) -> Column:
    """An array of numbers that is one literal of the plan, however many they are."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _with_next(docs: DataFrame, blocks: int) -> DataFrame:
    """Adds ``next``: the text of the next row in descending doc_id, after the last that of the first.

    Rows are cut into key ranges at quantiles; each block's first row is also
    sent to the block before it, so a window inside a block sees every successor
    and each text is shuffled once. The driver holds one id per block.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST))
    at = _constants([i / blocks for i in range(1, blocks)] or [0.5], "double")
    cuts = docs.select(F.percentile_approx(key, at, F.lit(max(10_000, 8 * blocks)))).first()[0] if blocks > 1 else []
    cuts = sorted(set(cuts or []), reverse=True)
    steps = [2**i for i in reversed(range(max(1, len(cuts)).bit_length()))]
    bounds = _constants(cuts or [LEAST], "long")
    # binary search for the number of cuts above the key
    block = F.aggregate(
        F.array(*map(F.lit, steps)),
        F.lit(0),
        lambda at, s: F.when((at + s <= len(cuts)) & (F.try_element_at(bounds, at + s) > F.col("key")), at + s).otherwise(at),
    )
    keyed = docs.select("doc_id", key.alias("key"), "text").withColumn("block", block)
    heads = {r["block"]: r["top"] for r in keyed.groupBy("block").agg(F.max("key").alias("top")).collect()}
    if not heads:
        return docs.select("doc_id", "text", F.lit(None).cast("string").alias("next"))
    order = sorted(heads)
    before = {b: order[i - 1] for i, b in enumerate(order)}
    width = max(order) + 1
    top = F.element_at(_constants([heads.get(b, LEAST) for b in range(width)], "long"), F.col("block") + 1)
    guest_of = F.element_at(_constants([before.get(b, 0) for b in range(width)], "int"), F.col("block") + 1)
    homes = F.array(F.struct(F.col("block").alias("home"), F.lit(False).alias("guest")))
    both = F.concat(homes, F.array(F.struct(guest_of.alias("home"), F.lit(True).alias("guest"))))
    sent = keyed.withColumn("to", F.explode(F.when(F.col("key") == top, both).otherwise(homes))).select("doc_id", "key", "text", "to.*")
    # a text's hash orders rows of equal ids; guests come last in their block
    inside = W.partitionBy("home").orderBy("guest", F.desc("key"), F.desc(F.xxhash64("text")))
    return sent.withColumn("next", F.lead("text").over(inside)).filter(~F.col("guest")).select("doc_id", "text", "next")


def fingerprint(docs: DataFrame, bits: int = 128) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    The edited text is the text with its last ``n_chars div 2`` code points
    replaced by the first as many (or all) of the next document in descending
    doc_id; after the last comes the first. Likeness of exact fingerprints is 1
    if they are equal, else 0. Null text counts as empty, a null doc_id as the
    smallest, rows of equal doc_id follow one another in order of a text hash,
    a table of one row is its own successor and an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "fingerprints")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    collided = collisions(docs, scratch, bits)
    blocks = min(MOST_BLOCKS, max(BLOCKS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")), docs.count() // BLOCK_ROWS))
    rows = _with_next(docs, blocks)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.expr("left(text, length(text) - length(text) div 2)"), F.expr("left(next, int(length(text) div 2))"))
    rows = rows.select("doc_id", "text", "next", edited.alias("edited"), n.cast("long").alias("n_chars"), half.alias("half"))
    rows = rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        canonical(F.col("text")).alias("a"),
        canonical(F.col("edited")).alias("b"),
        canonical(F.col("next")).alias("c"),
    )
    for name in "abc":
        rows = rows.withColumn(f"hash_{name}", wide_hash(F.col(name), bits))
    if collided.isEmpty():
        prints = {name: F.col(f"hash_{name}") for name in "abc"}
    else:
        prints = {}
        for name in "abc":
            hit = collided.select(F.col("hash").alias(f"hash_{name}"), F.lit(True).alias(f"hit_{name}"))
            rows = rows.join(_small(hit), f"hash_{name}", "left")
            prints[name] = F.when(F.col(f"hit_{name}"), F.sha2(name, 256)).otherwise(F.col(f"hash_{name}"))
    rows = rows.select("doc_id", "n_chars", "edited_sha256", *[p.alias(f"print_{k}") for k, p in prints.items()])
    like = lambda k: (F.col("print_a") == F.col(f"print_{k}")).cast("double")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", F.col("print_a").alias("fingerprint"), F.col("print_b").alias("edited_fingerprint"),
        like("b").alias("near_edited"), like("c").alias("near_next"),
    )
