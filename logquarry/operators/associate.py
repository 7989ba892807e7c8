"""Order-dependent associations, as windows over the rows that matter, partitioned by process id.

Every function narrows its inputs to the relevant kinds first, so what is shuffled is small
against the log, and a process id is the unit of work.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logquarry.functions.sql import is_transaction_command

from .facts import identified

BEFORE = (Window.unboundedPreceding, -1)


def _by(key: str = "pid", order: str | Column = "seq"):
    return Window.partitionBy(key).orderBy(order)


def _around(df: DataFrame, column: str, key: str) -> DataFrame:
    """df with b and a: the last value of column before a row of its key that is not null, and the next one after.

    Looks ahead in the same order: a frame that ends with the partition is computed anew for every row, in the square of its rows.
    """
    before = F.last(column, ignorenulls=True).over(_by(key).rowsBetween(*BEFORE))
    return df.withColumns({"b": before, "a": F.expr(f"lead({column}) ignore nulls over (partition by {key} order by seq)")})


def _since_first(statements: DataFrame, rows: DataFrame) -> DataFrame:
    """Statements from the first of rows on. Any row bounds the first one, so that the search for it skips the files and row groups behind."""
    some = rows.select("seq").first()
    if some is None:
        return statements.where(F.lit(False))
    return statements.where(F.col("seq") >= rows.where(F.col("seq") <= some.seq).agg(F.min("seq")).first()[0])


#: Bits of the hashes of keys that are sent to every task: 16 MB.
BITS = 1 << 27


def near(rows: DataFrame, of: DataFrame, key: str = "pid") -> DataFrame:
    """Rows whose key may be one of those in ``of``, and all whose key is: told by bits of hashes, so that the others are not shuffled. What an association then finds is the same."""
    bit = F.pmod(F.xxhash64(key), F.lit(BITS))
    words = of.select(bit.alias("bit_")).groupBy(F.shiftright("bit_", 6).alias("word_")).agg(F.expr("bit_or(shiftleft(1L, cast(bit_ & 63 as int)))").alias("bits_"))
    marked = rows.withColumn("bit_", bit).withColumn("word_", F.shiftright("bit_", 6))
    return marked.join(F.broadcast(words), "word_").where(F.expr("getbit(bits_, cast(bit_ & 63 as int)) = 1")).select(*rows.columns)


def _keyed(df: DataFrame) -> DataFrame:
    """df with own: the process id, or for a row without one a key that no other row has, so that such rows spread."""
    return df.withColumn("own", F.when(F.col("pid") == "", F.concat(F.lit("@"), F.col("seq").cast("string"))).otherwise(F.col("pid")))


def plan_of_execution(executions: DataFrame, plans: DataFrame) -> DataFrame:
    """executions with plan: the last plan of the process since its previous execution; each plan is used once."""
    both = executions.withColumn("plan", F.lit(None).cast("string")).withColumn("kind", F.lit(1)).unionByName(
        plans.where("pid <> ''").select("seq", "pid", "plan", F.lit(0).alias("kind")), allowMissingColumns=True
    )
    both = _keyed(both)
    both = both.withColumn("no", F.coalesce(F.sum("kind").over(_by("own").rowsBetween(*BEFORE)), F.lit(0)))
    mine = Window.partitionBy("own", "no").orderBy("seq").rowsBetween(*BEFORE)
    return both.withColumn("plan", F.last("plan", ignorenulls=True).over(mine)).where("kind = 1").drop("kind", "no", "own")


def temp_file_query(temps: DataFrame, statements: DataFrame, gate: bool = True) -> DataFrame:
    """temps with query: of the same message, else the process's last one before, else its next one after.

    gate: statements before the first temporary file of the log are not seen, as in a single forward pass.
    """
    st = statements.where("pid <> ''").where(~is_transaction_command(F.col("query"))).select("seq", "pid", "query", F.lit(0).alias("kind"))
    if gate:
        st = _since_first(st, temps)
    both = _keyed(temps.withColumn("kind", F.lit(1)).withColumn("query", F.lit(None).cast("string")).unionByName(st, allowMissingColumns=True))
    both = _around(both, "query", "own")
    return both.where("kind = 1").withColumn("query", F.coalesce(F.nullif("own_query", F.lit("")), "b", "a")).drop("kind", "a", "b", "own_query", "own")


def locks(messages: DataFrame, statements: DataFrame) -> DataFrame:
    """One row per lock key: its first message, last wait, whether acquired, and the query of its process.

    The query: the last one before the key is first seen, else the first one after.
    """
    st = _since_first(statements.where("pid <> ''"), messages).select("seq", "pid", "query")
    # a key begins with its process; texts that are only grouped by leave the aggregation to hashes, where min_by would sort
    keys = messages.groupBy("pid", "lock_key").agg(
        F.min("seq").alias("seq"), F.min_by("ts", "seq").alias("ts"), F.min_by("lock_type", "seq").alias("lock_type"),
        F.min_by("resource_type", "seq").alias("resource_type"), F.max_by("wait_ms", "seq").alias("last_wait_ms"), F.max((F.col("event_type") == "acquired").cast("int")).alias("acquired"),
        F.max("relation").alias("relation"),
    )
    both = keys.withColumn("query", F.lit(None).cast("string")).withColumn("kind", F.lit(1)).unionByName(st.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    return _around(both, "query", "pid").where("kind = 1").withColumn("query", F.coalesce("b", "a")).drop("kind", "a", "b")


def waits(messages: DataFrame, details: DataFrame, deadlocks: DataFrame, statements: DataFrame) -> DataFrame:
    """Waiting events with what later lines of the process add: blocking_pid, relation, deadlock; and the blocking query.

    A detail goes to the latest waiting event of its process; a deadlock relabels it. The blocking
    query is the blocking process's last one at that time, else its last one in the log.
    """
    what = ["seq", "ts", "pid", "lock_type", "resource_type", "wait_ms", "blocking_pid", "relation"]
    w = messages.where("event_type = 'waiting'").select(*what, F.lit(0).alias("kind"))
    extra = details.select("seq", "pid", "blocking_pid", "relation", F.lit(1).alias("kind")).unionByName(deadlocks.where("pid <> ''").select("seq", "pid", F.lit(2).alias("kind")), allowMissingColumns=True)
    both = w.unionByName(extra, allowMissingColumns=True)
    both = both.withColumn("of", F.last(F.when(F.col("kind") == 0, F.col("seq")), ignorenulls=True).over(_by().rowsBetween(Window.unboundedPreceding, 0)))
    # a wait and what is told of it have one process, whose rows are in one place already
    told = F.col("kind") > 0
    both = both.where("of is not null").groupBy("pid", "of").agg(
        F.max(F.when(~told, F.struct(*[c for c in what if c != "pid"]))).alias("w"), F.max_by("blocking_pid", F.when(told & (F.col("blocking_pid") != ""), F.col("seq"))).alias("b"),
        F.min_by("relation", F.when(told & (F.col("relation") != ""), F.col("seq"))).alias("r"), F.min(F.when(told & (F.col("blocking_pid") != ""), F.col("seq"))).alias("known_at"), F.max((F.col("kind") == 2).cast("int")).alias("dead"),
    )
    filled = lambda own, other: F.coalesce(F.nullif(f"w.{own}", F.lit("")), other, F.lit("")).alias(own)
    out = both.select(
        "w.seq", "w.ts", "pid", "w.lock_type", "w.resource_type", "w.wait_ms", F.when(F.col("dead") == 1, "deadlock").otherwise("waiting").alias("event_type"),
        filled("blocking_pid", "b"), filled("relation", "r"), F.coalesce("known_at", "w.seq").alias("at"),
    )
    # as-of on another key: the blocking process's statements up to the moment it is named; waits without one spread
    holder = F.when(F.col("blocking_pid") == "", F.concat(F.lit("@"), F.col("seq").cast("string"))).otherwise(F.col("blocking_pid")).alias("holder")
    st = statements.where("pid <> ''").select(F.col("pid").alias("holder"), F.col("seq").alias("at"), "query")
    asof = out.select("*", holder).unionByName(st, allowMissingColumns=True)
    found = F.last("query", ignorenulls=True).over(Window.partitionBy("holder").orderBy("at", F.col("seq").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    final = F.last("query", ignorenulls=True).over(Window.partitionBy("holder").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return asof.withColumn("found", found).withColumn("final", final).where("seq is not null").withColumn("blocking_query", F.coalesce("found", "final")).drop("at", "holder", "query", "found", "final")


def checkpoint_kinds(checkpoints: DataFrame) -> DataFrame:
    """Completed checkpoints with kind: the last start since the checkpoint before, else unknown.

    Checkpoints are few (a row every few minutes of log), so one ordered pass over them is small.
    """
    every = Window.orderBy("seq")
    c = checkpoints.withColumn("no", F.coalesce(F.sum(F.col("done").cast("long")).over(every.rowsBetween(*BEFORE)), F.lit(0)))
    kind = F.last("start_type", ignorenulls=True).over(Window.partitionBy("no").orderBy("seq").rowsBetween(*BEFORE))
    return c.withColumn("kind", F.coalesce(kind, F.lit("unknown"))).where("done").drop("no", "start_type", "done")


def running_sum(df: DataFrame, value: str, order: list[str], chunk: Column) -> DataFrame:
    """df with ``running``: the sum of value up to each row in a global order, in two phases.

    chunk must grow with the order. Sums run within a chunk; the totals of earlier chunks, a row for each, are added.
    """
    d = df.withColumn("chunk_", chunk)
    local = d.withColumn("local_", F.sum(value).over(Window.partitionBy("chunk_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    totals = d.groupBy("chunk_").agg(F.sum(value).alias("t_"))
    base = totals.select("chunk_", F.coalesce(F.sum("t_").over(Window.orderBy("chunk_").rowsBetween(*BEFORE)), F.lit(0)).alias("base_"))
    return local.join(base, "chunk_").withColumn("running", F.col("local_") + F.col("base_")).drop("chunk_", "local_", "base_")


def active_connections(connections: DataFrame) -> DataFrame:
    """Connection events with delta and running: a process counts once until it disconnects; without an id, each moment counts."""
    c = connections.select("seq", "ts", "kind", F.when(F.col("pid") == "", F.concat(F.lit("@"), F.col("ts").cast("string"))).otherwise(F.col("pid")).alias("key"), (F.col("pid") == "").alias("nameless"))
    last = F.lag("kind").over(_by("key"))
    delta = F.when((F.col("kind") == "received") & (F.coalesce(last, F.lit("disconnected")) == "disconnected"), 1).when((F.col("kind") == "disconnected") & (last == "received") & ~F.col("nameless"), -1).otherwise(0)
    return running_sum(c.withColumn("delta", delta), "delta", ["seq"], F.col("seq").bitwiseAND(-65536))


def concurrency(sessions: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """ts_us, delta, running (and the columns in keep) of a sweep over sessions: starts before ends at one moment."""
    points = [sessions.select(F.unix_micros(c).alias("ts_us"), F.lit(d).alias("delta"), "seq", *keep) for c, d in (("start_ts", 1), ("end_ts", -1))]
    return running_sum(reduce(DataFrame.unionByName, points), "delta", ["ts_us", F.desc("delta"), "seq"], F.expr("ts_us div 3600000000"))


def with_query_id(df: DataFrame, query: str = "query") -> DataFrame:
    """Adds the identification columns of a query column; null where it is null."""
    return identified(df, query)
