"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Documents with equal texts form a group that stays together. Groups too large for a parcel (a bounded
number, since each holds a set share of some total) are placed one by one, in falling size, on the
shard whose residual capacity has the highest dot product with the group's demand. All other groups
are dealt by a hash of their text into a fixed number of parcels, which are placed the same way after
them; smaller and smaller parcels level the shards out. The driver sees at most
``3 * shards * PER_SHARD`` groups and ``PARCELS`` sums, whatever the corpus size.

Defined cases: a null text counts as no bytes and no tokens, is a group of its own kind apart from the
empty text, and has the checksum of the empty string; ties are broken by hash and by shard number, so
the result does not depend on partitioning; repeated rows count each; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.llm.session import cut

PARCELS, PER_SHARD = 1 << 14, 256
#: Share of a parcel's hash range by level: later parcels are finer.
LEVELS = 4


def place(demand: np.ndarray, capacity: np.ndarray, shards: int) -> np.ndarray:
    """Shard for each row of ``demand`` (rows x dimensions), in the order given.

    A row goes where demand . residual is highest among the shards with room in every dimension;
    where no shard has room, to the one whose worst overrun is least. Equal values: lowest shard.
    """
    scale = np.where(capacity > 0, capacity, 1.0)
    need, left = demand / scale, np.ones((shards, demand.shape[1]))
    out = np.zeros(len(demand), np.int64)
    for i, d in enumerate(need):
        after = left - d
        room = (after >= 0).all(1)
        score = np.where(room, left @ d, -np.inf) if room.any() else after.min(1)
        out[i] = int(np.argmax(score))
        left[out[i]] = after[out[i]]
    return out


def shard(docs: DataFrame, shards: int = 16, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, tokens, text_crc32, shard and slot (gapless from 0 in each shard) of every row of ``docs``."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = cut(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            (F.octet_length(body) + 1).cast("long").alias("size"),
            F.size(F.filter(F.split(body, r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long").alias("tokens"),
            F.crc32(body.cast("binary")).alias("text_crc32"),
            F.when(F.col(text).isNull(), F.lit("")).otherwise(F.unhex(F.sha2(body, 256)).cast("binary")).cast("binary").alias("_group"),
        )
    )
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("b"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).first()
    sums = np.array([total["b"], total["t"], total["n"]], float)
    capacity, most = sums / shards, [max(1.0, x / (shards * PER_SHARD)) for x in sums]
    groups = rows.groupBy("_group").agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("n"))
    large = groups.where((F.col("b") > most[0]) | (F.col("t") > most[1]) | (F.col("n") > most[2])).collect()
    spread = F.pmod(F.xxhash64("_group"), F.lit(1 << 30))
    # Half of the parcels share half of the hash range, the next quarter a quarter of what remains, and so on.
    parcel, low, first = None, 0, 0
    for k in range(LEVELS):
        n = PARCELS >> min(k + 1, LEVELS - 1)
        width = ((1 << 30) - low) * 3 // 4 if k < LEVELS - 1 else (1 << 30) - low
        value = F.floor((spread - low).cast("double") * n / width).cast("int") + first
        parcel = F.when(spread < low + width, value) if parcel is None else parcel.when(spread < low + width, value)
        low, first = low + width, first + n
    names = {bytes(r["_group"]): r for r in large}
    spark = docs.sparkSession
    alone = spark.createDataFrame([(k,) for k in names], "_group binary")
    dealt = rows.join(F.broadcast(alone.withColumn("_large", F.lit(True))), "_group", "left").withColumn("_parcel", F.when(F.col("_large").isNull(), parcel))
    parcels = dealt.where("_parcel is not null").groupBy("_parcel").agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("n")).collect()
    vector = lambda r: (float(r["b"]), float(r["t"]), float(r["n"]))
    weight = lambda v: max(x / c if c else 0.0 for x, c in zip(v, capacity, strict=True))
    order = sorted(((weight(vector(r)), 1, k, vector(r)) for k, r in names.items()), key=lambda x: (-x[0], x[2]))
    order += sorted(((weight(vector(r)), 0, r["_parcel"], vector(r)) for r in parcels), key=lambda x: (-x[0], x[2]))
    order.sort(key=lambda x: -x[0])
    at = place(np.array([x[3] for x in order], float).reshape(-1, 3), capacity, shards)
    by_group = spark.createDataFrame([(x[2], int(s)) for x, s in zip(order, at, strict=True) if x[1]], "_group binary, _s1 int")
    by_parcel = spark.createDataFrame([(x[2], int(s)) for x, s in zip(order, at, strict=True) if not x[1]], "_parcel int, _s2 int")
    placed = dealt.join(F.broadcast(by_parcel), "_parcel", "left").join(F.broadcast(by_group), "_group", "left").withColumn("shard", F.coalesce("_s1", "_s2"))
    return with_slots(placed.select("doc_id", "size", "tokens", "text_crc32", "shard"), total["n"], shards)


def with_slots(placed: DataFrame, rows: int, shards: int, per_cell: int = 20_000) -> DataFrame:
    """Adds ``slot``: rows are numbered inside hash cells of bounded size, on top of the sizes of the cells before."""
    cells = max(1, -(-rows // (shards * per_cell)), min(64, -(-rows // (shards * 64))))
    tagged = placed.withColumn("_cell", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(cells)).cast("int"))
    counts = tagged.groupBy("shard", "_cell").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy("shard", "_cell").orderBy("doc_id", "text_crc32", "size")
    return tagged.withColumn("_row", F.row_number().over(inside) - 1).join(starts, ["shard", "_cell"]).withColumn("slot", (F.col("_start") + F.col("_row")).cast("long")).drop("_cell", "_start", "_row")
