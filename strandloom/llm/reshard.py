"""Resharding by minimum-cost flow: the fewest bytes move from the old layout to shards of given capacities.

Old shards are cut into blocks by hash, as many as their bytes ask for. The driver sees one row per block, solves the
transport problem old shard -> new shard at cost 0 for bytes that stay and 1 for bytes that move, and lays the flows of
each old shard end to end over its blocks. A document goes where the middle of its bytes falls. Slots are block offsets
plus the rank inside the block's piece, so no shard is ever sorted as a whole, and the rewrite moves each text through
one shuffle, by block, from which the files of the new shards are written.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import fresh_path, materialise

#: Bytes of a block in the mean: one task's share. The driver gets a row a block, and an old shard has ``LEAST`` blocks at least.
BLOCK_BYTES, LEAST = 64 << 20, 8
#: Rows of a table that is broadcast, at most.
BROADCAST_ROWS = 200_000


def min_cost_flow(supply: list[int], demand: list[int], cost) -> dict[tuple[int, int], int]:
    """Flows (i, j) -> units of the cheapest transport, by successive shortest paths with potentials. Sums must be equal."""
    if sum(supply) != sum(demand):
        raise ValueError("supply and demand differ")
    n, m = len(supply), len(demand)
    s, t = n + m, n + m + 1
    graph: list[list[list]] = [[] for _ in range(n + m + 2)]  # edges: [to, capacity left, cost, index of the reverse]

    def edge(a: int, b: int, cap: int, c: int) -> None:
        graph[a].append([b, cap, c, len(graph[b])])
        graph[b].append([a, 0, -c, len(graph[a]) - 1])

    for i, x in enumerate(supply):
        edge(s, i, x, 0)
        for j in range(m):
            edge(i, n + j, x, cost(i, j))
    for j, x in enumerate(demand):
        edge(n + j, t, x, 0)
    potential = [0] * (n + m + 2)
    while True:
        dist, via = {s: 0}, {}
        queue, done = [(0, s)], set()
        while queue:
            d, a = heapq.heappop(queue)
            if a in done:
                continue
            done.add(a)
            for k, (b, cap, c, _) in enumerate(graph[a]):
                if cap and d + c + potential[a] - potential[b] < dist.get(b, 1 << 62):
                    dist[b] = d + c + potential[a] - potential[b]
                    via[b] = (a, k)
                    heapq.heappush(queue, (dist[b], b))
        if t not in dist:
            break
        for v in range(len(potential)):
            potential[v] += dist.get(v, dist[t])
        b, push = t, 1 << 62
        while b != s:
            a, k = via[b]
            push, b = min(push, graph[a][k][1]), a
        b = t
        while b != s:
            a, k = via[b]
            graph[a][k][1] -= push
            graph[b][graph[a][k][3]][1] += push
            b = a
    return {(i, e[0] - n): graph[e[0]][e[3]][1] for i in range(n) for e in graph[i] if n <= e[0] < n + m and graph[e[0]][e[3]][1]}


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


ORDER = ["__id", "__size", "__crc"]


@dataclass
class Layout:
    """How blocks of old shards go to new ones. All three tables have a row a block, or a cut of one."""

    blocks: DataFrame  # __old, __blocks
    cuts: DataFrame  # __old, __block, __bounds, __targets
    first: DataFrame  # __shard, __old, __block, __first
    changed: list[int]  # shards that something enters or leaves
    shards: list[int]  # shards that have rows
    small: bool  # whether cuts and first have at most BROADCAST_ROWS rows


def keyed(docs: DataFrame, old: Column, blocks: DataFrame | None = None) -> DataFrame:
    """``docs`` with __old, __id, __size (UTF-8 bytes of the text, plus 16), __crc and, by ``blocks``, _block."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.withColumns({"__old": F.coalesce(old.cast("int"), F.lit(0)), "__id": F.col("doc_id").cast("long"), "__size": (F.octet_length(text) + 16).cast("long"), "__crc": F.crc32(text)})
    if blocks is None:
        return rows
    return rows.join(F.broadcast(blocks), "__old").withColumn("__block", F.pmod(F.xxhash64("__id", "__crc"), F.col("__blocks")).cast("int")).drop("__blocks")  # a row an old shard


def ends(rows: DataFrame) -> DataFrame:
    """Rows of a block in order, with the running sum of their bytes."""
    w = Window.partitionBy("__old", "__block").orderBy(*ORDER)
    return rows.withColumn("__end", F.sum("__size").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def beside(df: DataFrame, small: bool) -> DataFrame:
    """A table with a row a block: sent to every task while its counted rows are few, else sort-merged."""
    return F.broadcast(df) if small else df.hint("merge")


def placed(rows: DataFrame, cuts: DataFrame, small: bool) -> DataFrame:
    """Rows with their new shard, and their rank in the block's piece; the order of ``ends`` and its partitions are reused."""
    middle = F.col("__end") - F.floor(F.col("__size") / 2)
    goes = F.element_at("__targets", F.size(F.filter("__bounds", lambda b: b < middle)) + 1)
    moved = rows.join(beside(cuts, small), ["__old", "__block"]).withColumn("__shard", goes)  # one row a block
    rank = F.row_number().over(Window.partitionBy("__old", "__block", "__shard").orderBy(*ORDER)) - 1
    return moved.withColumn("__rank", rank).drop("__bounds", "__targets", "__end")


def layout(docs: DataFrame, old: Column, shards: int, capacities: list[int] | None = None, block_bytes: int = BLOCK_BYTES) -> Layout:
    """Solve the flow for ``docs``; see ``reshard``. Only ids, sizes and checksums are shuffled."""
    spark = docs.sparkSession
    narrow = keyed(docs.select("doc_id", "text", old.cast("int").alias("__was")), F.col("__was")).select("__old", *ORDER)
    weights = narrow.groupBy("__old").agg(F.sum("__size").alias("bytes")).collect()  # a row an old shard
    blocks = spark.createDataFrame([(r["__old"], max(LEAST, -(-r["bytes"] // block_bytes))) for r in weights], "__old int, __blocks bigint")
    rows = narrow.join(F.broadcast(blocks), "__old").withColumn("__block", F.pmod(F.xxhash64("__id", "__crc"), F.col("__blocks")).cast("int")).drop("__blocks")
    run = materialise(ends(rows), "blocks")
    sums = run.groupBy("__old", "__block").agg(F.sum("__size").alias("bytes")).orderBy("__old", "__block").collect()  # one row a block
    by_old: dict[int, list] = {}
    for r in sums:
        by_old.setdefault(r["__old"], []).append(r)
    olds = sorted(by_old)
    supply = [sum(r["bytes"] for r in by_old[o]) for o in olds]
    flow = min_cost_flow(supply, capacities or equal_capacities(sum(supply), shards), lambda i, j: int(olds[i] != j))
    cuts = []
    for i, o in enumerate(olds):
        targets = sorted((j for a, j in flow if a == i), key=lambda j: (j != o, j))
        bounds = list(accumulate(flow[i, j] for j in targets))[:-1]
        at = 0
        for r in by_old[o]:
            lo, hi = bisect_right(bounds, at), bisect_right(bounds, at + r["bytes"])
            cuts.append((o, r["__block"], [b - at for b in bounds[lo:hi]], targets[lo : hi + 1]))
            at += r["bytes"]
    plan = spark.createDataFrame(cuts, "__old int, __block int, __bounds array<bigint>, __targets array<int>")
    pieces = placed(run, plan, len(cuts) <= BROADCAST_ROWS).groupBy("__shard", "__old", "__block").agg(F.count(F.lit(1)).alias("n")).orderBy("__shard", "__old", "__block").collect()  # blocks + cuts
    offsets, at, changed = [], {}, set()
    for p in pieces:
        offsets.append((p["__shard"], p["__old"], p["__block"], at.get(p["__shard"], 0)))
        at[p["__shard"]] = at.get(p["__shard"], 0) + p["n"]
        if p["__shard"] != p["__old"]:
            changed |= {p["__shard"], p["__old"]}
    first = spark.createDataFrame(offsets, "__shard int, __old int, __block int, __first bigint")
    return Layout(blocks, plan, first, sorted(changed), sorted(at), max(len(cuts), len(offsets)) <= BROADCAST_ROWS)


def assigned(docs: DataFrame, old: Column, plan: Layout) -> DataFrame:
    """``docs``, all columns, with old_shard, shard and slot by ``plan``: each row carries its own, so ids need not be distinct."""
    rows = keyed(docs.drop("old_shard", "shard", "slot"), old, plan.blocks)
    found = placed(ends(rows), plan.cuts, plan.small).join(beside(plan.first, plan.small), ["__shard", "__old", "__block"])  # a row a piece
    named = found.withColumns({"old_shard": F.col("__old"), "shard": F.col("__shard"), "slot": F.col("__first") + F.col("__rank")})
    return named.drop("__old", "__block", "__shard", "__rank", "__first", *ORDER)


def reshard(docs: DataFrame, old: Column, shards: int, capacities: list[int] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, size, text_crc32, old_shard, shard, slot of every row of ``docs``; nothing is rewritten.

    ``old`` gives the present shard (null counts as 0); old shard i and new shard i are the same place. ``capacities``
    (bytes, summing to all bytes) defaults to equal ones. A shard's bytes differ from its capacity by less than one
    document at each cut. Null and empty texts are 16 bytes. Rows that repeat an id each get a slot, null ids too; rows
    alike in id, size and checksum may swap slots. No rows give no rows. Other columns are ignored.
    """
    plan = layout(docs, old, shards, capacities, block_bytes)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", old.cast("int").alias("__was"))
    rows = keyed(narrow, F.col("__was"), plan.blocks).select("doc_id", "__old", "__block", *ORDER)
    found = placed(ends(rows), plan.cuts, plan.small).join(beside(plan.first, plan.small), ["__shard", "__old", "__block"])
    return found.select("doc_id", F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"), F.col("__old").alias("old_shard"), F.col("__shard").alias("shard"), (F.col("__first") + F.col("__rank")).alias("slot"))


def rewrite(docs: DataFrame, old: Column, plan: Layout, path: str, manifest: dict[int, str] | None = None) -> dict[int, str]:
    """Write the shards that ``plan`` changes under ``path`` and return the new manifest, shard -> folder.

    ``manifest`` has the folders of the old shards. A shard in it that nothing enters or leaves keeps its folder and is
    not written; without a manifest all are. The files have all columns of ``docs``, old_shard and slot (columns of
    these names, or named shard, are replaced; names with two underscores in front are kept for the work), and each is in order of slot. Old folders are never touched, so a job
    that is cut off can be run again; the manifest changes hands only when all files are there.
    """
    kept = {k: v for k, v in (manifest or {}).items() if k not in plan.changed}
    written = [k for k in plan.shards if k not in kept]
    if written:
        rows = assigned(docs, old, plan)
        if kept:
            rows = rows.where(F.col("shard").isin(written))
        rows.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return kept | {k: f"{path}/shard={k}" for k in written}


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Old layout: 32 shards by hash of the source, so the hot source's shard is far over the others. Law: bytes. The rows are read from the rewritten files."""
    old = F.pmod(F.xxhash64(F.coalesce(F.col("source").cast("string"), F.lit(""))), F.lit(32))
    plan = layout(docs, old, 40)
    path = fresh_path(spark, "shards")
    rewrite(docs, old, plan, path)
    own = [f for f in docs.schema if f.name not in ("old_shard", "slot", "shard")]
    schema = T.StructType([*own, T.StructField("old_shard", T.IntegerType()), T.StructField("slot", T.LongType()), T.StructField("shard", T.IntegerType())])
    files = spark.read.schema(schema).parquet(path) if plan.shards else spark.createDataFrame([], schema)
    text = F.coalesce("text", F.lit(""))
    return files.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")
