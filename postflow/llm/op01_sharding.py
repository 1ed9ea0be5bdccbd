"""Sharding: consistent-hash ring with virtual nodes and bounded loads.

A key's ring position is the hash of its doc_id; it belongs to the next virtual
node clockwise. A shard holds at most its capacity, floor(n / shards) or one
more for the first n mod shards; keys that find their shard full go on
clockwise to the next virtual node whose shard has room. So counts differ by
one at most (law `rows`), and only overflow leaves its place on the ring.

The ring has SLOTS positions; rows are counted by (slot, salt), at most
SLOTS * SALTS numbers whatever the size of the table. The placement of those
counts on the shards is computed from the numbers alone; each row then finds
its place by its rank within its cell. The salt comes from the row's content, so
a doc_id that repeats with different texts is dealt over several tasks.

Defined results. Null text: size 16, checksum of no bytes (0). Null doc_id: a
key like another. Repeated rows: each gets a slot of its own; equal rows are
interchangeable. Equal texts are not kept together (a group of a third of all
rows would fit no shard). Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postflow.llm.common import materialize

SLOT_BITS = 14
SLOTS = 1 << SLOT_BITS
SALTS = 8


def ring(shards: int, nodes: int) -> list[tuple[int, int]]:
    """(slot, shard) of every virtual node, clockwise; a taken slot passes the
    node on to the next free one."""
    taken: dict[int, int] = {}
    for replica in range(nodes):
        for shard in range(shards):
            if len(taken) == SLOTS:
                break
            digest = hashlib.md5(f"{shard}/{replica}".encode()).digest()
            slot = int.from_bytes(digest[:8], "big") % SLOTS
            while slot in taken:
                slot = (slot + 1) % SLOTS
            taken[slot] = shard
    return sorted(taken.items())


def place(counts: dict[tuple[int, int], int], shards: int, nodes: int) -> list[tuple]:
    """Pieces (slot, salt, from rank, to rank, shard, first place in the shard)
    for the counted cells: each cell's keys go to their virtual node while its
    shard has room, the rest clockwise."""
    n = sum(counts.values())
    room = [n // shards + (s < n % shards) for s in range(shards)]
    filled = [0] * shards
    nodes_at = ring(shards, nodes)
    pieces: list[tuple] = []

    def put(cell: tuple[int, int], lo: int, hi: int, node: int) -> int:
        shard = nodes_at[node][1]
        take = min(hi - lo, room[shard] - filled[shard])
        if take > 0:
            pieces.append((*cell, lo, lo + take, shard, filled[shard]))
            filled[shard] += take
        return lo + take

    waiting, node = [], 0
    for cell in sorted(counts):
        while node < len(nodes_at) and nodes_at[node][0] < cell[0]:
            node += 1
        home = node % len(nodes_at)
        lo = put(cell, 0, counts[cell], home)
        if lo < counts[cell]:
            waiting.append((cell, lo, home))
    for cell, lo, home in waiting:
        while lo < counts[cell]:
            home = (home + 1) % len(nodes_at)
            lo = put(cell, lo, counts[cell], home)
    return pieces


def shard_rows(documents: DataFrame, shards: int = 40, nodes: int = 64) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document."""
    spark = documents.sparkSession
    text = F.coalesce("text", F.lit(""))
    at = F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - SLOT_BITS).cast("int")
    rows = materialize(
        documents.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"),
                         F.crc32(text.cast("binary")).alias("text_crc32"))
        .withColumns({"at": at, "salt": F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(SALTS)).cast("int")}),
        "ring")
    counts = {(r["at"], r["salt"]): r["n"] for r in rows.groupBy("at", "salt").agg(F.count("*").alias("n")).collect()}
    pieces = spark.createDataFrame(place(counts, shards, nodes),
                                   "at int, salt int, lo long, hi long, shard int, base long")
    in_cell = Window.partitionBy("at", "salt").orderBy(F.xxhash64("doc_id"), "doc_id", "text_crc32", "size")
    ranked = rows.withColumn("nth", F.row_number().over(in_cell).cast("long") - 1)
    # one piece for each cell, and one more each time a shard is full
    placed = ranked.join(F.broadcast(pieces), ["at", "salt"]).filter("nth >= lo and nth < hi")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
                         (F.col("base") + F.col("nth") - F.col("lo")).alias("slot"),
                         F.lit(None).cast("int").alias("grown_shard"))
