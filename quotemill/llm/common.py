"""Shared pieces: tables in the shared folder, tree-wise reduction of Arrow rows, components."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from quotemill.session import new_work_dir


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to a fresh folder below the shared one and read it back.

    This cuts the lineage: a lost executor costs the tasks it ran, not the whole plan, and the
    planner knows the true size of the table in later joins.
    """
    path = new_work_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value, body):
    """`body(value)` with `value` evaluated once per row, also when the body's lambdas use it."""
    return F.transform(F.array(value), body)[0]


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph given by `edges` (a long, b long).

    Returns (node, root) for every node that has an edge; the root is the smallest node of the
    component. Large-star and small-star steps alternate until the edges no longer change; both
    use the smallest neighbour per node only, so no neighbour list is gathered. These are stored
    before they meet the edges again, so a hot node, as the root of a giant component is one, is a
    skewed join that adaptive execution splits. Every round is checkpointed.
    """
    _checkpoint_folder(edges)
    links = (
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
        .checkpoint()
    )
    seen = _state(links)
    while seen[0]:
        links = _small_star(_large_star(links)).checkpoint()
        now = _state(links)
        if now == seen:
            break
        seen = now
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _checkpoint_folder(df: DataFrame) -> None:
    from quotemill.session import shared_dir

    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    least = saved(least.select("a", F.least("a", "m").alias("m")), "large-star")
    return (
        both.join(least, "a")
        .where("b > a AND b <> m")
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
        .distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    least = saved(links.groupBy("a").agg(F.min("b").alias("m")), "small-star")
    moved = (
        links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    )
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def ranked(df: DataFrame, group: str, order: list[str], label: str) -> DataFrame:
    """`df` with `pos`: the row's place (from 0) within its `group` by `order`, nulls first.

    Rows equal in `order` get places of their own. The rows are range-partitioned by group, order
    and a running number, so a group or a value with most rows fills many partitions. A task
    numbers its own rows; a group that goes on from earlier partitions adds their rows. Only the
    first group of a partition can do so, hence there are at most as many of these sums as
    partitions. `df` is read twice and should be a stored table.
    """
    keys = [group, *order, "_tie"]
    sorted_rows = (
        df.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .drop("_tie")
    )

    def number(stream):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in stream:
            if not batch.num_rows:
                continue
            runs = pc.run_end_encode(batch.column(group))
            ends = runs.run_ends.to_numpy().astype(np.int64)
            starts = np.concatenate([[0], ends[:-1]])
            places = np.arange(batch.num_rows) - np.repeat(starts, ends - starts)
            first, final = runs.values[0].as_py(), runs.values[len(ends) - 1].as_py()
            if seen and first == last:
                places[: ends[0]] += seen
            last, seen = final, int(places[-1]) + 1
            columns = [*batch.columns, pa.array([part] * batch.num_rows, pa.int32()), pa.array(places, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "_part", "_place"])

    schema = sorted_rows.limit(0).withColumn("_part", F.lit(0)).withColumn("_place", F.lit(0).cast("long")).schema
    placed = saved(sorted_rows.mapInArrow(number, schema), label)
    rows = placed.groupBy("_part", group).agg((F.max("_place") + 1).alias("n"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = rows.withColumn("earlier", F.sum("n").over(before)).where("earlier > 0")
    earlier = saved(earlier.select(F.col("_part").alias("_p"), F.col(group).alias("_g"), "earlier"), label)
    same = (placed["_part"] == earlier["_p"]) & placed[group].eqNullSafe(earlier["_g"])
    pos = (F.col("_place") + F.coalesce("earlier", F.lit(0))).alias("pos")
    return placed.join(earlier, same, "left").select(*df.columns, pos)
