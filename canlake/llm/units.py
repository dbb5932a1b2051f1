"""Work on pairs of rows of a group, in units of bounded size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .common import worker_store

#: Rows of a group meet its number of blocks by group and one of so many salts.
SALTS = 64
#: The same for values that members share.
NEAR_SALTS = 8


def _dealt(rows: DataFrame, group: str, member: str, block: int, weight: Column | None, heavy: int) -> DataFrame:
    """rows with the number of blocks of their group and the block b that they are in."""
    blocks = F.ceil(F.count("*") / block)
    if weight is not None:
        blocks = F.greatest(blocks, F.ceil(F.sum(weight) / heavy))
    large = rows.groupBy(group).agg(blocks.cast("int").alias("blocks")).where("blocks > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64(member, F.lit(9)), F.lit(SALTS)).cast("int")).join(large, [group, "salt"], "left").drop("salt")
    return dealt.withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("b", F.pmod(F.xxhash64(member, F.lit(5)), F.col("blocks")).cast("int"))


def in_blocks(rows: DataFrame, group: str, member: str, block: int, weight: Column | None = None, heavy: int = 1) -> DataFrame:
    """rows(group, member, ...) -> rows with u, side, same: the pairs of blocks of each group that a row takes part in.

    A group of at most `block` rows, and `heavy` of weight where one is given, is one block. A larger one is dealt into
    blocks by a hash of the member; a unit of work is a pair of its blocks (`same`: a block with itself), so that no unit
    holds more than about twice `block` rows or `heavy` of weight, whatever the group's size. Only groups of several
    blocks are looked up, by group and salt, so that no group's rows meet in one task.
    """
    dealt = _dealt(rows, group, member, block, weight, heavy)
    units = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("b", o).alias("x"), F.greatest("b", o).alias("y")))
    out = dealt.withColumn("e", F.explode(units)).withColumn("u", F.struct(group, "e.x", "e.y")).withColumn("side", F.when(F.col("b") == F.col("e.x"), 0).otherwise(1))
    return out.withColumn("same", F.col("e.x") == F.col("e.y")).drop("e", "b", "blocks")


def in_linked_blocks(rows: DataFrame, group: str, member: str, near: DataFrame, by: str, block: int, weight: Column | None = None, heavy: int = 1) -> DataFrame:
    """rows(group, member, ...), near(by, member) -> member, u, side, same: the pairs of blocks that a row takes part in.

    Blocks and units are those of in_blocks, but a row goes to another block only where that one holds a member of its
    group that shares a value of `by` with it. So a loose group, however large, costs what its candidates cost, and a
    dense one no more than all pairs of its blocks. `near` may name rows that are in no group.
    """
    dealt = _dealt(rows, group, member, block, weight, heavy).select(group, member, "blocks", "b")
    own = dealt.select(group, member, F.col("b").alias("x"), F.col("b").alias("y"), F.lit(0).alias("side"))
    salt = F.pmod(F.xxhash64(member, F.lit(11)), F.lit(NEAR_SALTS)).cast("int")
    at = near.join(dealt.where("blocks > 1").drop("blocks"), member).withColumn("salt", salt)
    there = at.groupBy(by, group).agg(F.collect_set("b").alias("others")).where(F.size("others") > 1)  # at most one number for each block
    there = there.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(NEAR_SALTS - 1))))
    met = at.join(there, [by, group, "salt"]).select(group, member, "b", F.explode("others").alias("o")).where("b <> o").distinct()
    met = met.select(group, member, F.least("b", "o").alias("x"), F.greatest("b", "o").alias("y"), F.when(F.col("b") < F.col("o"), 0).otherwise(1).alias("side"))
    return own.unionByName(met).select(member, F.struct(group, "x", "y").alias("u"), "side", (F.col("x") == F.col("y")).alias("same"))


def by_unit(units: DataFrame, columns: list[str], schema: pa.Schema, solve) -> DataFrame:
    """Rows of each unit go to one task, blocks by the first column; solve(rows of the first block, rows of the second or
    None), both Arrow tables of the columns, gives columns. With sorted blocks, stars of different units name the same
    members, and repeated links fold."""
    ready = units.select("u", F.xxhash64("u").alias("uh"), "side", "same", *columns).repartition("u").sortWithinPartitions("u", "side", columns[0])

    def work(batches):
        worker_store("units")
        held: list[pa.RecordBatch] = []

        def done():
            t = pa.Table.from_batches(held)
            held.clear()
            n = int((t.column("side").to_numpy() == 0).sum())
            a, b = t.select(columns).slice(0, n), None if t.column("same")[0].as_py() else t.select(columns).slice(n)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(solve(a, b), schema, strict=True)], schema=schema)

        current = None
        for batch in batches:
            if not batch.num_rows:
                continue
            uh = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(uh[1:] != uh[:-1]) + 1).tolist(), len(uh)]
            for start, end in zip(edges[:-1], edges[1:], strict=True):
                if held and uh[start] != current:
                    yield done()
                current = uh[start]
                held.append(batch.slice(start, end - start))
        if held:
            yield done()

    return ready.select("uh", "side", "same", *columns).mapInArrow(work, from_arrow_schema(schema))
