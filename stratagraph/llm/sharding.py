"""Sharding over fixed virtual slots.

Records are hashed into ``SLOTS`` slots once and for all; only the slot-to-shard
map changes. Bytes and rows are summed per slot (a table of fixed size), the map
is made by giving the heaviest slots first to the lightest shard, and a later
version edits it: slots move from heavy to light shards until sizes are near
equal, and all others stay. Each version is one written table, so readers name
the version they use.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch

SLOTS = 8192
MAP_SCHEMA = "virtual_slot int, shard int, slot_bytes long, slot_rows long"


def sized(docs: DataFrame) -> DataFrame:
    """docs -> (doc_id, size, text_crc32, virtual_slot); size is the UTF-8 bytes of the text and 1. Rows without an id have no key to hash, so their place in the table is hashed with the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    slot = F.pmod(F.xxhash64(F.coalesce(doc_id, F.monotonically_increasing_id()), text), F.lit(SLOTS)).cast("int")
    return docs.select(doc_id.alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), slot.alias("virtual_slot"))


def slot_sizes(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """(bytes, rows) of each slot; ``SLOTS`` entries at most."""
    return {r[0]: (r[1], r[2]) for r in rows.groupBy("virtual_slot").agg(F.sum("size"), F.count("*")).collect()}


def first_map(sizes: dict[int, tuple[int, int]], shards: int) -> dict[int, int]:
    """Heaviest slots first, each to the shard that is lightest so far."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for slot in sorted(range(SLOTS), key=lambda s: (-sizes.get(s, (0, 0))[0], s)):
        load, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (load + sizes.get(slot, (0, 0))[0], shard))
    return out


def edited_map(old: dict[int, int], sizes: dict[int, tuple[int, int]], shards: int, slack: float = 0.01) -> dict[int, int]:
    """The map with as few slots moved as brings all shards within ``slack`` of the mean, or as near as slots allow."""
    out = {slot: shard for slot, shard in old.items() if shard < shards}
    load = [0] * shards
    own: list[list[int]] = [[] for _ in range(shards)]
    for slot, shard in out.items():
        load[shard] += sizes.get(slot, (0, 0))[0]
        own[shard].append(slot)
    for slot in sorted(set(old) - set(out), key=lambda s: -sizes.get(s, (0, 0))[0]):  # of shards that are gone
        shard = load.index(min(load))
        out[slot] = shard
        own[shard].append(slot)
        load[shard] += sizes.get(slot, (0, 0))[0]
    mean = sum(load) / shards
    for _ in range(4 * SLOTS):
        high, low = load.index(max(load)), load.index(min(load))
        gap = load[high] - load[low]
        if load[high] <= mean * (1 + slack) and load[low] >= mean * (1 - slack):
            break
        movable = [s for s in own[high] if 0 < sizes.get(s, (0, 0))[0] < gap]
        if not movable:
            break
        slot = min(movable, key=lambda s: abs(sizes[s][0] - gap / 2))
        own[high].remove(slot)
        own[low].append(slot)
        out[slot] = low
        load[high] -= sizes[slot][0]
        load[low] += sizes[slot][0]
    return out


def write_map(spark: SparkSession, folder: str, version: int, owners: dict[int, int], sizes: dict[int, tuple[int, int]]) -> DataFrame:
    """Store one version; fails if it exists."""
    rows = [(slot, shard, *sizes.get(slot, (0, 0))) for slot, shard in sorted(owners.items())]
    spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.parquet(f"{folder}/version={version}")
    return read_map(spark, folder, version)


def read_map(spark: SparkSession, folder: str, version: int) -> DataFrame:
    return spark.read.schema(MAP_SCHEMA).parquet(f"{folder}/version={version}")


def shard(docs: DataFrame, shards: int = 16, folder: str | None = None, version: int = 1, previous: int | None = None) -> DataFrame:
    """docs (doc_id long, text string, ...) -> (doc_id, size, text_crc32, shard, slot, virtual_slot), a row for each row of docs.

    Shard sizes in bytes are near equal. Writes the map as ``version`` below
    ``folder`` (None: the shared folder); with ``previous``, that version is edited
    instead of making one anew. slot: the row's place in its shard, gapless from
    0, by virtual slot and doc_id. A null text counts as empty. Equal rows with an id lie in
    one virtual slot; rows that share a doc_id are spread by their text, rows without one by their place in the table.
    An empty table gives an empty one; other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "slot-map")
    folder = folder or scratch.path("map")
    # texts are read once, and slots stay as they were counted
    rows = scratch.save(sized(docs), "sized")
    sizes = slot_sizes(rows)
    if previous is None:
        owners = first_map(sizes, shards)
    else:
        owners = edited_map({r.virtual_slot: r.shard for r in read_map(spark, folder, previous).collect()}, sizes, shards)
    write_map(spark, folder, version, owners, sizes)
    before, first = [0] * shards, []
    for slot in range(SLOTS):
        first.append((slot, owners[slot], before[owners[slot]]))
        before[owners[slot]] += sizes.get(slot, (0, 0))[1]
    places = spark.createDataFrame(first, "virtual_slot int, shard int, first long")
    order = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    # the map has SLOTS rows whatever the input
    out = rows.withColumn("nth", F.row_number().over(order)).join(F.broadcast(places), "virtual_slot")
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("nth") - 1).alias("slot"), "virtual_slot")
