"""Filling fixed-capacity containers: first-fit decreasing with a tournament tree.

Documents fall into randomised groups of bounded size by a hash of their id, and each
group is packed on its own, so no group grows with the data. Within a group the items go
by size descending; the tree holds the free room of the open containers and finds the
first one that fits in logarithmic time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents of a group, on average; larger groups leave less room unused.
GROUP_DOCUMENTS = 8192
#: Kinds of container in one call.
MAX_KINDS = 1_000


def first_fit_decreasing(sizes: Sequence[int], capacity: int) -> list[int]:
    """Container number of each item. Sizes are at most ``capacity``; ties keep their order."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    leaves = 1
    while leaves < max(1, len(sizes)):
        leaves *= 2
    # every container that may be opened counts as free, so the first fit is always found
    room = [capacity] * (2 * leaves)
    placed = [0] * len(sizes)
    for i in order:
        size, at = sizes[i], 1
        while at < leaves:
            at *= 2
            if room[at] < size:
                at += 1
        placed[i] = at - leaves
        room[at] -= size
        at //= 2
        while at:
            best = room[2 * at] if room[2 * at] >= room[2 * at + 1] else room[2 * at + 1]
            if room[at] == best:
                break
            room[at] = best
            at //= 2
    return placed


def pack(items: DataFrame, containers: DataFrame, group_documents: int = GROUP_DOCUMENTS, seed: int = 42, n_items: int | None = None) -> DataFrame:
    """(container_kind, group_id, container_no, doc_id, piece, pieces, tokens): where every piece goes.

    items: (doc_id, tokens); containers: (container_kind, capacity_tokens), a few rows. A
    document of more than the capacity is cut into full pieces and a rest; any other stays
    whole. Null and zero sizes take no room and get one piece of 0 tokens. Kinds whose
    capacity is null or below 1 are left out. (group_id, container_no) names a container of
    a kind. Repeated doc_ids are packed as separate items. Every group packs all kinds, so
    more than MAX_KINDS of them raise ValueError.
    """
    kinds = containers.where(F.col("container_kind").isNotNull() & (F.col("capacity_tokens") >= 1)).groupBy("container_kind").agg(F.max("capacity_tokens").alias("capacity")).limit(MAX_KINDS + 1).collect()
    if len(kinds) > MAX_KINDS:
        raise ValueError(f"more than {MAX_KINDS} kinds of container")
    if n_items is None:
        n_items = items.count()
    groups = max(1, round(n_items / group_documents))
    kind_of = {r["container_kind"]: r["capacity"] for r in kinds}
    names = ["container_kind", "group_id", "container_no", "doc_id", "piece", "pieces", "tokens"]

    def run(key, table):
        import numpy as np
        import pyarrow as pa

        table = table.sort_by("doc_id").combine_chunks()
        docs, tokens = table.column("doc_id"), table.column("tokens").to_numpy().astype("int64")
        out = []
        for kind, capacity in sorted(kind_of.items()):
            pieces = np.maximum(1, -(-tokens // capacity))
            row = np.repeat(np.arange(len(tokens)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            size = np.minimum(capacity, tokens[row] - piece * capacity)
            full, part = np.flatnonzero(size == capacity), np.flatnonzero(size < capacity)
            # a full piece fills a container by itself; it comes first in the order anyway
            number = np.empty(len(row), dtype="int64")
            number[full] = np.arange(len(full))
            number[part] = np.array(first_fit_decreasing(size[part].tolist(), capacity), dtype="int64") + len(full)
            n = len(row)
            out.append(pa.table([pa.array([kind] * n, pa.string()), pa.array([key[0].as_py()] * n, pa.int64()), pa.array(number), docs.take(pa.array(row)), pa.array(piece), pa.array(pieces[row]), pa.array(size)], names=names))
        return pa.concat_tables(out) if out else pa.table([pa.array([], pa.string())] + [pa.array([], pa.int64())] * 6, names=names)

    sized = items.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"))
    # documents without an id spread by their place, so that they cannot crowd into one group
    group = F.pmod(F.xxhash64(F.coalesce("doc_id", F.monotonically_increasing_id()), F.lit(seed)), F.lit(groups)).cast("long")
    schema = "container_kind string, group_id long, container_no long, doc_id long, piece long, pieces long, tokens long"
    return sized.withColumn("group_id", group).groupBy("group_id").applyInArrow(run, schema)


def usage(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """Per kind: documents, split documents, containers, tokens, and the share of room used."""
    each = packed.groupBy("container_kind", "group_id", "container_no").agg(F.sum("tokens").alias("used"), F.sum(F.when(F.col("piece") == 0, 1).otherwise(0)).alias("docs"), F.sum(F.when((F.col("piece") == 0) & (F.col("pieces") > 1), 1).otherwise(0)).alias("split"))
    kinds = containers.groupBy("container_kind").agg(F.max("capacity_tokens").alias("capacity_tokens"))
    per = each.groupBy("container_kind").agg(F.sum("docs").alias("documents"), F.sum("split").alias("split_documents"), F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"))
    return per.join(kinds, "container_kind").withColumn("used_share", F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")))
