"""A corpus from raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), where ``docs`` is what the stage before
it kept, and returns a DataFrame. All but the last return the columns of
``documents``. A stage's result is written as Parquet and read again as the next
one's input, so an executor lost later never costs an earlier stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larderflow.llm import language_id, line_dedup, mixing, packing, simhash
from larderflow.llm.queries import documents
from larderflow.llm.scratch import Scratch, released

#: Least probability of its language that a document must have to stay; few-word texts are ambiguous, not unclean.
LANGUAGE_SCORE = 0.3
LEAST = -(2**63)


def _own(docs: DataFrame) -> str:
    """A prefix that no column of ``docs`` starts with, for a stage's own columns."""
    prefix = "__"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    return prefix


def _identity(docs: DataFrame, own: str) -> dict[str, Column]:
    """Two columns, ``id`` and ``hash`` after the prefix, that tell rows apart unless they are alike in every column."""
    whole = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns], F.lit("row"))
    return {f"{own}id": F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)), f"{own}hash": whole}


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters (null and empty texts too) and those whose language the model can't tell.

    Rows are judged one by one, so repeated rows fare alike; without any lang to
    learn from, no language can be told and every row goes. An empty table stays
    empty.
    """
    model = language_id.train(language_id.training_fold(docs))
    return language_id.identify(docs, model, keep=LANGUAGE_SCORE)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of line runs of 50 words or more; drops documents that lose all their text.

    Null and empty texts lose nothing and stay. Of equal runs the first in order
    of doc_id, text hash and line stays; rows alike in doc_id and text are one
    document. An empty table stays empty.
    """
    removed = f"{_own(docs)}removed"
    out = line_dedup.dedup_lines(docs, removed=removed)
    return out.filter((F.col(removed) == 0) | (F.length(F.trim("text")) > 0)).drop(removed)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: the least doc_id (null last), of its rows the least row hash.

    Near-duplicates are texts whose five-word shingles have a Jaccard similarity of 0.8 or more: SimHash finds the pairs,
    and their shingles are compared. All texts without words, null and empty ones among them, are one group. Of rows alike
    in every column one stays, and an empty table stays empty.
    """
    own = _own(docs)
    keyed = docs.withColumns(_identity(docs, own))
    found = simhash.similar(keyed, keys=f"{own}hash")
    # a group is named by its label, as doc_ids may repeat
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")
    kept = found.groupBy("label").agg(first)
    kept = kept.select(F.coalesce("first.doc_id", F.lit(LEAST)).alias(f"{own}id"), F.col("first.key").alias(f"{own}hash"))
    kept = Scratch(spark, "pipeline").table(kept, "kept")
    alike = W.partitionBy(f"{own}id", f"{own}hash").orderBy(F.lit(1))
    out = keyed.join(kept.hint("merge"), [f"{own}id", f"{own}hash"], "left_semi").withColumn(f"{own}n", F.row_number().over(alike))
    return out.filter(F.col(f"{own}n") == 1).select(*[F.col(f"`{c}`") for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source's documents up to its target, a document as often as the mix passes over it.

    A document that the mix takes only in part is kept whole. Null sources are
    one source; a text without words takes no part in a mix of words and goes.
    Rows alike in every column count one by one. An empty table stays empty.
    """
    own = _own(docs)
    keyed = docs.withColumns(_identity(docs, own))
    taken = mixing.mix(keyed, carry=(f"{own}hash",)).filter("taken > 0")
    times = taken.select(F.coalesce("doc_id", F.lit(LEAST)).alias(f"{own}id"), f"{own}hash", F.ceil(F.col("taken") / F.col("size")).alias("times"))
    times = Scratch(spark, "pipeline").table(times.groupBy(f"{own}id", f"{own}hash").agg(F.sum("times").cast("int").alias(f"{own}n")), "times")
    alike = W.partitionBy(f"{own}id", f"{own}hash").orderBy(F.lit(1))
    out = keyed.join(times.hint("merge"), [f"{own}id", f"{own}hash"]).withColumn(f"{own}row", F.row_number().over(alike)).filter(F.col(f"{own}row") == 1)
    out = out.withColumn(f"{own}copy", F.explode(F.sequence(F.lit(1), F.col(f"{own}n"))))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of the permitted lengths. A null or empty text is one token; an empty table gives no rows."""
    return packing.pack_documents(docs)


STAGES = [("language ID", languages), ("line dedup", lines), ("SimHash near-dedup", near_duplicates), ("mixing", mixture), ("packing", packed)]

#: Hash keys, trained weights and fingerprints have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``. A stage's intermediate tables are deleted once its result is written."""
    docs, scratch = documents(spark, sf_dir), Scratch(spark, "pipeline-run")
    for at, (_, stage) in enumerate(STAGES):
        with released(spark):
            docs = scratch.table(stage(spark, docs, sf_dir), f"stage{at}")
        if at:
            scratch.drop(f"stage{at - 1}")
    return docs
