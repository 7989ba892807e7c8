"""Mixing sources to target weights. Native DataFrame operations only.

The sizes are aggregated per source; targets follow the weights, with what exceeds a source's cap
shared again by weight; a source's repetition rate is target / size. Each document is emitted
floor(rate) times, and once more if its seeded hash is below the fraction, so reruns agree and no
state is shared between documents. One scan of the texts, one small aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

WORD = r"[^\x20\x09-\x0D]+"
#: Sources up to this count are broadcast to the documents (under 10 MB); more are joined by shuffle.
BROADCAST_SOURCES = 50_000


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """From rows (source, size): source, source_size, target. Sources by code point, null last, take the weights in turn.

    With r = cap * size / weight, the capped sources are those of least r; the common level is the
    largest of (total - caps before) / (weights from here on) over sources in the order of r.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    by = by.select("source", "source_size", weight.alias("w"), (F.lit(float(cap)) * F.col("source_size")).alias("most"))
    order = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    by = by.select("*", F.sum("source_size").over(whole).cast("double").alias("total"), F.coalesce(F.sum("most").over(before), F.lit(0.0)).alias("gone"), F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("left_w"))
    by = by.withColumn("level", F.max((F.col("total") - F.col("gone")) / F.col("left_w")).over(whole))
    return by.select("source", "source_size", F.least("most", F.col("w") * F.col("level")).alias("target"))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, seed: str = "mix-1", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, copies, taken (and the columns in keep, each named keep_<column>).

    A null or empty text has size 0 and takes nothing, but stays in the plan; null is a source of its
    own; repeated rows (same id) are decided alike; a null id hashes as an empty string. An empty
    table gives no rows.
    """
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), *[F.col(c).alias(f"keep_{c}") for c in keep])
    if not keep:
        sized = stage(sized, "sizes")
    targets = stage(source_targets(sized.select("source", "size"), weights, cap), "targets").withColumnRenamed("source", "its")
    side = F.broadcast(targets) if targets.count() <= BROADCAST_SOURCES else targets
    plan = sized.join(side, F.col("source").eqNullSafe(F.col("its")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 12), 16, 10).cast("double") / float(2**48)
    plan = plan.withColumn("copies", (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("long"))
    return plan.select("doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), *[f"keep_{c}" for c in keep])


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: every document as often as its plan says, with the columns of docs."""
    plan = mix_plan(docs, keep=tuple(docs.columns), **how).where("copies > 0")
    return plan.withColumn("copy", F.explode(F.expr("sequence(1L, copies)"))).select(*[F.col(f"keep_{c}").alias(c) for c in docs.columns])
