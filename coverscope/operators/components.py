"""Connected components, by alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverscope.runtime import salted_join, settle

SALTS = 8
#: Links that one task may finish.
LOCAL_LINKS = 1 << 19


def connected_components(edges: DataFrame, local: int = 0) -> DataFrame:
    """(node, label): every node that has a link, with the smallest node that can be reached from it.

    edges: u, v of one ordered type, in either direction, repeats and loops allowed; rows with a null are dropped. Each round
    replaces the links by stars around smaller nodes (large star, then small star) and is written to the checkpoint folder; rounds
    end when the links are unchanged, after O(log^2 n) at most. Minima are gathered with partial aggregation, and the joins
    that give them back to the links are salted, so a node with very many links is spread over tasks. If there are `local` distinct links or fewer, which are counted first, one task does
    it all instead, without rounds.
    """
    e = settle(_down(edges.select("u", "v")))
    seen = _state(e)
    if seen[0] <= local:
        return _in_one_task(e)
    while seen[0]:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = _down(salted_join(both, least, ["u"], F.col("v"), SALTS).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = salted_join(large, least, ["u"], F.col("v"), SALTS).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = settle(_down(small.unionAll(least.select("u", F.col("m").alias("v")))))
        now = _state(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _in_one_task(e: DataFrame) -> DataFrame:
    """(node, label) by joining sets of nodes."""
    kind = e.schema["u"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict = {}

        def top(x):  # noqa: ANN001, ANN202
            while above[x] != x:
                above[x] = x = above[above[x]]
            return x

        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                above.setdefault(u, u)
                above.setdefault(v, v)
                a, b = top(u), top(v)
                above[max(a, b)] = min(a, b)
        if above:
            yield pa.RecordBatch.from_arrays([pa.array(list(above)), pa.array([top(x) for x in above])], names=["node", "label"])

    return e.repartition(1).mapInArrow(run, f"node {kind}, label {kind}")


def _down(edges: DataFrame) -> DataFrame:
    """Each link once, from the larger node to the smaller."""
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _state(e: DataFrame) -> tuple[int, int]:
    row = e.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]
