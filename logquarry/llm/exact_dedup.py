"""Exact dedup by deterministic block naming. Native DataFrame operations only.

Each text is cut into blocks of fixed size. Sorting the blocks that occur more than once gives each
an integer name; a block that occurs once makes its whole document unique, which settles it. The
names of a document's adjacent blocks are then named pairwise, level by level, until one name is
left. Blocks and pairs are compared as values, never by a hash, so an identity has no collisions.

Cost: the texts are shuffled twice (to find repeated blocks, and to join their names); everything
after that is integers. Counts are combined before each shuffle, and both sides of a join on a
block or an identity are stage tables, so that adaptive execution can split a hot one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

MISSING = -(2**63)


def _blocks(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    base = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    base = base.select("rid", "doc_id", F.sha2("t", 256).alias("sha"), F.col("t").cast("binary").alias("b"))
    base = base.withColumn("n", F.greatest(F.lit(1), F.expr(f"cast((octet_length(b) + {size - 1}) div {size} as int)")))
    return base.select("rid", "doc_id", "n", "sha", F.posexplode(F.expr(f"transform(sequence(0, n - 1), i -> substring(b, i * {size} + 1, {size}))")).alias("idx", "block"))


def _named(repeated: DataFrame, keys: list[str]) -> DataFrame:
    """Integer names for keys that occur more than once."""
    counted = repeated.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    return stage(counted.sortWithinPartitions(*keys).select(*keys, F.monotonically_increasing_id().alias("name")), "names")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4096) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays; a null text counts as empty; a null id is
    smaller than any other; of repeated rows with one id and one text just one stays. An empty table
    gives no rows. Columns other than the two named are not read, so their names cannot clash.
    """
    blocks = _blocks(docs, id_col, text_col, block_bytes)
    names = _named(blocks.select("block"), ["block"])
    table = stage(
        blocks.join(names, "block", "left").select("rid", "doc_id", "n", "idx", "name", F.when(F.col("idx") == 0, F.col("sha")).alias("sha")),
        "blocks",
    )
    per_doc = stage(
        table.groupBy("rid").agg(F.max("doc_id").alias("doc_id"), F.max("sha").alias("sha"), F.max("n").alias("n"), F.count("name").alias("k"), F.max(F.when(F.col("idx") == 0, F.col("name"))).alias("first")),
        "documents",
    )
    rest = per_doc.where("n > 1 and k = n").select("rid")
    longest = rest.join(per_doc, "rid").agg(F.max("n")).first()[0] or 1
    current = table.join(rest, "rid", "left_semi").select("rid", "idx", "name")
    for _ in range((longest - 1).bit_length()):
        pairs = stage(
            current.groupBy("rid", F.expr("idx div 2").cast("int").alias("idx")).agg(
                F.coalesce(F.max(F.when(F.col("idx") % 2 == 0, F.col("name"))), F.lit(MISSING)).alias("a"),
                F.coalesce(F.max(F.when(F.col("idx") % 2 == 1, F.col("name"))), F.lit(MISSING)).alias("b"),
            ),
            "pairs",
        )
        names = _named(pairs, ["a", "b"])
        # a pair that occurs once makes its document unique; such names are negative and hold the row
        current = stage(pairs.join(names, ["a", "b"], "left").select("rid", "idx", F.coalesce("name", -1 - F.col("rid")).alias("name")), "level")
    final = current.where("idx = 0 and name >= 0").select("rid", F.col("name").alias("final"))
    members = stage(
        per_doc.join(final, "rid", "left").select("rid", "doc_id", "sha", "n", F.when(F.col("n") == 1, F.col("first")).otherwise(F.col("final")).alias("identity")),
        "members",
    )
    groups = stage(members.where("identity is not null").groupBy("n", "identity").agg(F.max(F.struct("doc_id", -F.col("rid"))).alias("keep"), F.count(F.lit(1)).alias("size")), "groups")
    alone = members.where("identity is null").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    grouped = members.where("identity is not null").join(groups, ["n", "identity"]).select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("size").alias("group_size"), (F.col("keep.col2") == -F.col("rid")).alias("kept"), F.col("sha").alias("text_sha256")
    )
    return alone.unionByName(grouped)
