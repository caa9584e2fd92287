"""Resharding by minimum-cost flow.

Rows of the old shards are counted in blocks: the rows of one old shard whose sizes have the same
binary order of magnitude and whose row numbers hash alike. The number of blocks is bounded by parameters,
so their sizes can be planned on the driver. A minimum-cost flow from old shard sizes to new
capacities (staying costs nothing, moving costs one per byte or what ``cost`` says) tells how many
bytes go where; blocks, the largest first, are then dealt out along that flow, so that small blocks
even out what large ones leave over. Only shards that lose or gain blocks are written anew, a shard that
has lost all its rows loses its folder, and the rows are read back from what was written.

Law: ``bytes``. The new shards have nearly equal sizes; the unit that moves is a block of rows, and
rows with equal texts are not bound to each other.

Defined results: a null text has no bytes; a null old shard counts as shard 0 of the old ones; ids
may be null or repeated and take no part in the plan, as rows go by their number (the frame has to give
the same rows in the same order on each scan, as a stored table does); an empty table gives no rows;
input columns are kept, but the operator's own columns replace input columns named ``size``,
``old_shard``, ``shard`` or ``slot``.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ledgerfield.llm.tables import table
from ledgerfield.sources.scratch import scratch_path
from ledgerfield.sources.sinks import remove_path

OVERHEAD = 8
KEYS = ["old", "magnitude", "bucket", "part"]
BUCKETS = 32  # hash buckets of an old shard and order of magnitude
PART_ROWS = 20_000  # rows numbered by one window, about


def minimum_cost_flow(supply: list[int], capacity: list[int],
                      cost: list[list[int]]) -> list[list[int]]:
    """flow[i][j] that sends all supply within the capacities at least cost.

    Successive shortest paths with potentials (costs are not negative) over source, old shards, new
    shards and sink.
    """
    a, b = len(supply), len(capacity)
    source, sink = a + b, a + b + 1
    to, room, price, graph = [], [], [], [[] for _ in range(a + b + 2)]

    def edge(u: int, v: int, cap: int, c: int) -> int:
        for x, y, r, p in ((u, v, cap, c), (v, u, 0, -c)):
            graph[x].append(len(to))
            to.append(y)
            room.append(r)
            price.append(p)
        return len(to) - 2

    for i, s in enumerate(supply):
        edge(source, i, s, 0)
    arcs = [[edge(i, a + j, supply[i], cost[i][j]) for j in range(b)] for i in range(a)]
    for j, c in enumerate(capacity):
        edge(a + j, sink, c, 0)
    potential = [0] * (a + b + 2)
    while True:
        distance = [float("inf")] * (a + b + 2)
        distance[source], via, heap = 0, {}, [(0, source)]
        while heap:
            far, u = heapq.heappop(heap)
            if far > distance[u]:
                continue
            for e in graph[u]:
                d = far + price[e] + potential[u] - potential[to[e]]
                if room[e] and d < distance[to[e]]:
                    distance[to[e]], via[to[e]] = d, e
                    heapq.heappush(heap, (d, to[e]))
        if sink not in via:
            return [[room[e ^ 1] for e in row] for row in arcs]
        potential = [p + d if d < float("inf") else p for p, d in zip(potential, distance)]
        path, v = [], sink
        while v != source:
            path.append(via[v])
            v = to[via[v] ^ 1]
        amount = min(room[e] for e in path)
        for e in path:
            room[e] -= amount
            room[e ^ 1] += amount


def deal(blocks: list[tuple], flow: list[list[int]], capacity: list[int]) -> dict[tuple, int]:
    """New shard of each block (key, old shard, bytes), the largest first.

    A block goes along its old shard's flow with most bytes still to send, staying put if that flow
    still has room for it; when none has room for half of it, to the emptiest shard.
    """
    left = [list(row) for row in flow]
    free = list(capacity)
    out = {}
    for key, old, size in sorted(blocks, key=lambda x: (-x[2], str(x[0]))):
        want = left[old]
        j = old if old < len(want) and want[old] >= size else max(
            range(len(want)), key=lambda k: (min(want[k], free[k]), -k))
        if 2 * min(want[j], free[j]) < size:
            j = max(range(len(free)), key=lambda k: (free[k], k == old, -k))
        want[j] = max(0, want[j] - size)
        free[j] -= size
        out[key] = j
    return out


def plan(df: DataFrame, n_new: int, n_old: int, cost: list[list[int]] | None = None,
         capacity: list[int] | None = None) -> list[tuple]:
    """(old, magnitude, bucket, part, shard, first slot) of all parts of blocks.

    ``df`` has the columns of ``with_blocks``. What comes to the driver is one row per part: bounded
    by old shards, 40 magnitudes, ``BUCKETS`` and the parts of ``PART_ROWS`` rows each.
    """
    counted = df.groupBy(*KEYS).agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).collect()
    size, parts = defaultdict(int), defaultdict(list)
    for r in counted:
        key = (r["old"], r["magnitude"], r["bucket"])
        size[key] += r["bytes"]
        parts[key].append((r["part"], r["n"]))
    supply = [0] * n_old
    for (old, _, _), s in size.items():
        supply[old] += s
    total = sum(supply)
    if capacity is None:
        capacity = [total // n_new + (j < total % n_new) for j in range(n_new)]
    if cost is None:
        cost = [[int(i != j) for j in range(n_new)] for i in range(n_old)]
    flow = minimum_cost_flow(supply, capacity, cost)
    shard_of = deal([(k, k[0], s) for k, s in size.items()], flow, capacity)
    slots, out = [0] * n_new, []
    for key in sorted(size):
        j = shard_of[key]
        for part, n in sorted(parts[key]):
            out.append((*key, part, j, slots[j]))
            slots[j] += n
    return out


def with_blocks(df: DataFrame, old: Column, size: Column, n_old: int, parts: int) -> DataFrame:
    """The columns of ``df`` as c0, c1, ..., the row's number, size and old shard, and its block's keys."""
    order = F.xxhash64("row")
    return df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)],
                     F.pmod(F.coalesce(old.cast("int"), F.lit(0)), F.lit(n_old)).cast("int").alias("old"),
                     size.cast("long").alias("size"),
                     F.monotonically_increasing_id().alias("row")).withColumns({
        "magnitude": F.floor(F.log2(F.greatest("size", F.lit(1)).cast("double"))).cast("int"),
        "bucket": F.pmod(order, F.lit(BUCKETS)).cast("int"),
        "part": F.pmod(F.floor(order / F.lit(BUCKETS)).cast("long"), F.lit(parts)).cast("int")})


def reshard(spark: SparkSession, df: DataFrame, old: Column, size: Column, n_new: int,
            n_old: int, cost: list[list[int]] | None = None) -> DataFrame:
    """The rows with ``size``, ``old_shard``, ``shard`` and ``slot`` (gapless in each shard)."""
    parts = max(1, df.count() // (n_old * BUCKETS * PART_ROWS))
    blocks = with_blocks(df, old, size, n_old, parts)
    chosen = spark.createDataFrame(plan(blocks, n_new, n_old, cost), StructType([
        *[StructField(k, IntegerType()) for k in (*KEYS, "shard")], StructField("first", LongType())]))
    order = Window.partitionBy(*KEYS).orderBy("row")
    out = blocks.join(chosen, KEYS).withColumn("slot", F.col("first") + F.row_number().over(order) - 1)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns)
                        if c not in ("size", "old_shard", "shard", "slot")],
                      "size", F.col("old").alias("old_shard"), "shard", "slot")


def write_affected(df: DataFrame, path: str) -> DataFrame:
    """Write the shards that changed below ``path`` as folders ``shard=<number>``.

    ``df`` comes from ``reshard``. A shard whose rows all stay and that gains none keeps its files; the
    folder of one that has lost all its rows is removed. Returns (shard, rows, moved_in, moved_out) of all
    shards, old and new: a row for each.
    """
    spark = df.sparkSession
    moved = F.col("shard") != F.col("old_shard")
    gain = df.groupBy("shard").agg(F.count("*").alias("rows"), F.count_if(moved).alias("moved_in"))
    loss = df.groupBy(F.col("old_shard").alias("shard")).agg(F.count_if(moved).alias("moved_out"))
    rows = gain.join(loss, "shard", "full").na.fill(0).collect()
    report = spark.createDataFrame(rows, "shard int, rows long, moved_in long, moved_out long")
    affected = [r["shard"] for r in rows if r["moved_in"] + r["moved_out"] and r["rows"]]
    if affected:
        df.where(F.col("shard").isin(affected)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    for r in rows:
        if not r["rows"]:
            remove_path(spark, f"{path}/shard={r['shard']}")
    return report


def rewritten(df: DataFrame, path: str) -> DataFrame:
    """The rows of ``reshard`` after the affected shards were written below ``path``, read from there;
    rows of shards that keep their files come from where they lie."""
    rows = write_affected(df, path).where("rows > 0").collect()
    kept = [r["shard"] for r in rows if not r["moved_in"] + r["moved_out"]]
    parts = [df.where(F.col("shard").isin(kept))] if kept or not rows else []
    if len(kept) < len(rows):
        parts.append(df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns))
    return reduce(DataFrame.unionByName, parts)


def text_size(text: str = "text") -> Column:
    """UTF-8 bytes of the text and 8 for the id."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD


def op1_resharding(spark, root: str) -> DataFrame:
    """Documents from 16 old shards, each of which holds whole sources, into 24 of equal bytes.

    The affected shards are written with all columns of their documents; the rows come from them.
    """
    docs = table(spark, root, "documents")
    moved = reshard(spark, docs, F.pmod(F.crc32("source"), F.lit(16)), text_size(), n_new=24, n_old=16)
    stored = rewritten(moved, scratch_path(spark, "llm", f"shards-{uuid4().hex}"))
    return stored.select("doc_id", "size", F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
                         F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "old_shard")
