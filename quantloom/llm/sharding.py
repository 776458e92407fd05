"""Uniform sharding with exact shard sizes through a hypergeometric communication matrix.

Rows fall into blocks by a hash. The block sizes (a bounded number of counts) go to the driver, which draws how
many rows of each block go to each shard: multivariate hypergeometric, so row sums are the block sizes and
column sums the shard sizes. Each block is permuted locally and dealt out by its row of the matrix; after the
exchange each shard is permuted again. Together that is a uniform random permutation cut into shards
(Sanders 1998); equal seeds give equal results, also after lost executors, since every key is a hash.

Blocks and cells (parts of a shard, by the second key) bound what one task sorts; there are as many as the rows need.
The driver gets one count for each block. Law: `rows`, counts at most
one apart. Defined cases: a null text has size 1 and crc32 0; repeated rows are separate rows; an empty table
gives no rows; fully equal rows can change places among themselves; columns named shard or slot are replaced.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import forget, materialize, text_or_empty

#: Least number of blocks before the exchange and of cells of each shard after it, and the rows that one of them is for.
BLOCKS, CELLS, ROWS = 256, 64, 1_000_000
_NUMPY_MOST = 1_000_000_000


def _log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of `drawn` of good + bad are good. Beyond NumPy's range by inversion from the mode outwards."""
    if good + bad < _NUMPY_MOST:
        return int(rng.hypergeometric(good, bad, drawn)) if drawn and good + bad else 0
    low, high = max(0, drawn - bad), min(drawn, good)
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (good + bad + 2)))
    p = math.exp(_log_choose(good, mode) + _log_choose(bad, drawn - mode) - _log_choose(good + bad, drawn))
    u, up, down, pu, pd = rng.random() - p, mode, mode, p, p
    while u > 0 and (up < high or down > low):
        if up < high:
            pu *= (good - up) * (drawn - up) / ((up + 1) * (bad - drawn + up + 1))
            up += 1
            if (u := u - pu) <= 0:
                return up
        if down > low:
            pd *= down * (bad - drawn + down) / ((good - down + 1) * (drawn - down + 1))
            down -= 1
            if (u := u - pd) <= 0:
                return down
    return mode


def communication_matrix(sizes: list[int], shards: int, seed: int) -> list[list[int]]:
    """How many rows of each block go to each shard; shard sizes are at most one apart."""
    rng, total = np.random.default_rng(seed), sum(sizes)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    out = []
    for n in sizes:
        row, left, rest = [], n, sum(room)
        for s in range(shards):
            rest -= room[s]
            k = hypergeometric(rng, room[s], rest, left)
            row.append(k)
            left -= k
        room = [a - b for a, b in zip(room, row, strict=True)]
        out.append(row)
    return out


def shard_rows(rows: DataFrame, keys: list[str], shards: int = 8, seed: int = 42, blocks: int | None = None, cells: int | None = None) -> DataFrame:
    """`rows` (narrow ones; read four times) with shard and slot. keys: the columns that tell rows apart."""
    spark = rows.sparkSession
    rows = rows.drop(*[c for c in rows.columns if c.lower() in ("shard", "slot") and c not in keys])
    p = "_"  # own columns begin as none of the others
    while any(c.startswith(p) for c in rows.columns):
        p += "_"
    block, first, second, cell, rank, edge, offset = (f"{p}{c}" for c in ("block", "first", "second", "cell", "rank", "edges", "offset"))
    total = rows.count()
    blocks = blocks or max(BLOCKS, -(-total // ROWS))
    cells = cells or max(CELLS, -(-total // (shards * ROWS)))
    keyed = materialize(
        rows.withColumns(
            {
                block: F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(blocks)).cast("int"),
                first: F.xxhash64(F.lit(seed + 1), *keys),
                second: F.xxhash64(F.lit(seed + 2), *keys),
            }
        ),
        "shard-keys",
    )
    sizes = [0] * blocks
    for r in keyed.groupBy(block).count().collect():  # one count for each block
        sizes[r[0]] = r[1]
    matrix = communication_matrix(sizes, shards, seed)
    edges = spark.createDataFrame([(b, [int(x) for x in np.cumsum(row)]) for b, row in enumerate(matrix)], f"{block} int, {edge} array<bigint>")
    local = Window.partitionBy(block).orderBy(first, *keys)
    dealt = materialize(
        keyed.withColumn(rank, F.row_number().over(local) - 1)
        .join(F.broadcast(edges), block)
        .withColumn("shard", F.size(F.filter(edge, lambda e: e <= F.col(rank))))
        .withColumn(cell, F.pmod(F.shiftright(second, 32), F.lit(cells)).cast("int"))
        .drop(edge, rank, block, first),
        "shard-dealt",
    )
    forget(keyed)
    places = dealt.groupBy("shard", cell).agg(F.count("*").alias(rank))
    before = Window.partitionBy("shard").orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    offsets = places.select("shard", cell, F.coalesce(F.sum(rank).over(before), F.lit(0)).alias(offset))  # shards x cells rows
    again = Window.partitionBy("shard", cell).orderBy(second, *keys)
    return (
        dealt.withColumn(rank, F.row_number().over(again) - 1)
        .join(F.broadcast(offsets), ["shard", cell])
        .withColumn("slot", F.col(offset) + F.col(rank))
        .drop(cell, second, rank, offset)
    )


def shard_documents(docs: DataFrame, shards: int = 8, seed: int = 42, blocks: int | None = None, cells: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document."""
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(text_or_empty()) + 1).cast("bigint").alias("size"),
        F.crc32(F.encode(text_or_empty(), "UTF-8")).alias("text_crc32"),
    )
    out = shard_rows(rows, ["doc_id", "text_crc32", "size"], shards, seed, blocks, cells)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
