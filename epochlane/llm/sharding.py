"""Sharding by Karmarkar-Karp differencing: near-equal bytes, equal texts together."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochlane.operators.numbering import gapless_index
from epochlane.operators.skew import join_spread
from epochlane.session import materialise

SHARDS = 16
#: Groups differenced in one task, and partial partitions differenced in one task of the next levels.
GROUPS_PER_BUCKET = 2000
FAN_IN = 500


def difference(parts: list[list[int]], k: int) -> list[list[int]]:
    """For each partial partition (k sums), the final part that each of its sums goes to.

    While more than one is left, the two of the largest spread (largest less smallest sum)
    are combined, the largest sum of one with the smallest of the other. Ties go by position."""
    n = len(parts)
    nodes: list[tuple] = []
    heap = []
    for i, sums in enumerate(parts):
        order = sorted(range(k), key=lambda j: (-sums[j], j))
        ranked = [sums[j] for j in order]
        nodes.append((None, None, order, ranked))
        heap.append((ranked[-1] - ranked[0], i))
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        sums = [x + y for x, y in zip(nodes[a][3], reversed(nodes[b][3]), strict=True)]
        order = sorted(range(k), key=lambda j: (-sums[j], j))
        ranked = [sums[j] for j in order]
        nodes.append((a, b, order, ranked))
        heapq.heappush(heap, (ranked[-1] - ranked[0], len(nodes) - 1))
    label: list[list[int] | None] = [None] * len(nodes)
    if nodes:
        label[-1] = list(range(k))
    for i in range(len(nodes) - 1, n - 1, -1):
        a, b, order, _ = nodes[i]
        la, lb = [0] * k, [0] * k
        for place, j in enumerate(order):
            la[j] = lb[k - 1 - j] = label[i][place]
        label[a], label[b], label[i] = la, lb, None
    out = []
    for i in range(n):
        own = [0] * k
        for place, j in enumerate(nodes[i][2]):
            own[j] = label[i][place]
        out.append(own)
    return out


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of docs (doc_id, text).

    size: UTF-8 bytes of the text plus 1; null counts as empty. Rows of equal text go to one
    shard; the bytes of shards are as near equal as differencing gets them. slot numbers a
    shard's rows gapless from 0. Repeated rows each have a slot. Extra columns are ignored;
    an empty table gives an empty table.

    Groups are dealt by hash into buckets; each bucket is differenced to one partial partition
    of k sums, these again in bundles of FAN_IN, until one is left. Only sums move up and only
    labels move down, so no task sees more than a bucket or a bundle."""
    text = F.coalesce("text", F.lit(""))
    rows = materialise(docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"), F.substring(F.unhex(F.sha2(text, 256)), 1, 16).alias("group")))
    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    groups = materialise(groups)
    n_groups, n_rows = groups.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    n = max(1, -(-n_groups // GROUPS_PER_BUCKET))

    def first(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("group", kind="stable")
        made = difference([[b, *[0] * (shards - 1)] for b in part["bytes"].tolist()], shards)
        return pd.DataFrame({"bucket": part["bucket"], "group": part["group"], "bytes": part["bytes"], "part": [x[0] for x in made]})

    at = groups.withColumn("bucket", F.pmod(F.xxhash64("group"), F.lit(n))).select("bucket", "group", "bytes")
    placed = materialise(at.groupBy("bucket").applyInPandas(first, "bucket long, group binary, bytes long, part int"))
    sums = placed.groupBy("bucket", "part").agg(F.sum("bytes").alias("bytes"))
    of_group = placed.select("group", F.col("bucket").alias("b"), F.col("part").alias("p"))

    def bundle(part: pd.DataFrame) -> pd.DataFrame:
        wide = part.pivot_table(index="bucket", columns="part", values="bytes", aggfunc="sum", fill_value=0).reindex(columns=range(shards), fill_value=0).sort_index()
        made = difference([[int(x) for x in r] for r in wide.to_numpy()], shards)
        return pd.DataFrame({"b": np.repeat(wide.index.to_numpy(), shards), "p": list(range(shards)) * len(wide), "next": part["next"].iloc[0], "part": [x for r in made for x in r], "bytes": wide.to_numpy().reshape(-1)})

    while n > 1:
        up = materialise(sums.withColumn("next", F.floor(F.col("bucket") / FAN_IN)).groupBy("next").applyInPandas(bundle, "b long, p int, next long, part int, bytes long"))
        of_group = of_group.join(up.select("b", "p", "next", "part"), ["b", "p"]).select("group", F.col("next").alias("b"), F.col("part").alias("p"))
        sums = up.groupBy(F.col("next").alias("bucket"), "part").agg(F.sum("bytes").alias("bytes"))
        n = -(-n // FAN_IN)
    of_group = materialise(of_group.select("group", F.col("p").alias("shard")))
    out = gapless_index(join_spread(rows, of_group, ["group"], "doc_id"), "shard", ["doc_id"], "slot", n_rows)
    return out.select("doc_id", "size", "text_crc32", "shard", "slot")
