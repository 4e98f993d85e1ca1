"""Choosing a varied subset: cluster-feature tree, Ward linkage, record nearest each group centre.

Each partition summarises its unit vectors as leaf entries (count, labelled count, linear
sum); the square sum of unit vectors is the count. A vector joins the nearest entry whose
centre is within the threshold, else begins one; when a summary holds too many entries
the sparse ones are merged at a growing threshold. Summaries of partitions are merged the
same way, a few at a time, until one is left. Its size is bounded, so the driver
agglomerates it by Ward linkage. Dense leaf entries also settle which vectors have many
neighbours; they and the records nearest the centres of the cut's groups are centres of
cells in which the neighbours of all others are counted.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from gaugeworks.operators import vector_blocks as vx
from gaugeworks.session import cut_lineage

#: Leaf entries of one summary: at most 4096 * 64 doubles, 2 MB.
MAX_ENTRIES = 4096
#: Summaries merged by one task.
FAN_IN = 8
START_THRESHOLD = 0.3
#: Rows of a coarse group that meet its centres in one task.
SLICE_ROWS = 65_536


class Summary:
    """Leaf entries: ``n``, ``labelled``, linear sum ``ls`` and ``reach``; rows of ``ls`` / n are the centres.

    An entry takes vectors within its reach. When there are too many entries, the half
    with the most vectors stays as it is and the others, mostly single vectors, are merged
    at a growing threshold; so crowded places stay resolved.
    """

    def __init__(self, dim: int, limit: int, threshold: float = START_THRESHOLD):
        import numpy as np

        self.limit, self.threshold = limit, threshold
        self.n, self.labelled, self.ls, self.reach = np.empty(0), np.empty(0), np.empty((0, dim)), np.empty(0)

    def add(self, n, labelled, ls, reach) -> None:
        """Inserts entries (single vectors have n = 1), then makes room if need be."""
        import numpy as np

        if len(self.n):
            centres, own = (ls / n[:, None]).astype("float32"), (self.ls / self.n[:, None]).astype("float32")
            gap = (centres**2).sum(axis=1)[:, None] - 2 * centres @ own.T + (own**2).sum(axis=1)[None, :]
            near = gap.argmin(axis=1)
            joins = (gap[np.arange(len(n)), near] <= self.reach[near] ** 2) & (reach <= self.reach[near])
            self._pour(near[joins], n[joins], labelled[joins], ls[joins])
            n, labelled, ls, reach = n[~joins], labelled[~joins], ls[~joins], reach[~joins]
        self._begin(n, labelled, ls, reach)
        while len(self.n) > self.limit:
            self.threshold *= 1.15
            order = np.argsort(-self.n, kind="stable")
            keep, rest = order[: self.limit // 2], order[self.limit // 2 :]
            loose = [a[rest] for a in (self.n, self.labelled, self.ls)]
            self.n, self.labelled, self.ls, self.reach = (a[keep] for a in (self.n, self.labelled, self.ls, self.reach))
            self._begin(*loose, np.full(len(rest), self.threshold))

    def _pour(self, into, n, labelled, ls) -> None:
        import numpy as np

        np.add.at(self.n, into, n)
        np.add.at(self.labelled, into, labelled)
        np.add.at(self.ls, into, ls)

    def _begin(self, n, labelled, ls, reach) -> None:
        """New entries: the first vector left leads, those within its reach of it join; until none is left."""
        import numpy as np

        fresh = []
        centres = (ls / n[:, None]).astype("float32")
        square = (centres**2).sum(axis=1)
        while len(n):
            # several leaders at once: the first of the rest and any that are not near an earlier one
            head = centres[:256]
            inner = square[:256, None] - 2 * head @ head.T + square[None, :256] <= (reach[:256] ** 2)[None, :]
            lead: list[int] = []
            for i in range(len(head)):
                if not inner[i, lead].any():
                    lead.append(i)
            gap = square[:, None] - 2 * centres @ head[lead].T + square[lead][None, :]
            near = gap.argmin(axis=1)
            joins = gap[np.arange(len(n)), near] <= reach[lead][near] ** 2
            joins[lead], near[lead] = True, np.arange(len(lead))
            sums = [np.zeros((len(lead),) + a.shape[1:]) for a in (n, labelled, ls)]
            for total, a in zip(sums, (n, labelled, ls)):
                np.add.at(total, near[joins], a[joins])
            fresh.append([*sums, reach[lead]])
            n, labelled, ls, reach, centres, square = (a[~joins] for a in (n, labelled, ls, reach, centres, square))
        if fresh:
            self.n, self.labelled, self.ls, self.reach = (np.concatenate([old, *[f[i] for f in fresh]]) for i, old in enumerate((self.n, self.labelled, self.ls, self.reach)))

    def dense(self, least: int = 8, length: float = 0.96):
        """Unit centres of entries of at least ``least`` vectors whose mean has at least this length."""
        import numpy as np

        size = np.sqrt((self.ls**2).sum(axis=1))
        at = (self.n >= least) & (size >= length * self.n)
        return self.ls[at] / size[at][:, None]

    def frame(self, part: int) -> pd.DataFrame:
        return pd.DataFrame({"part": part, "threshold": self.threshold, "n": self.n, "labelled": self.labelled, "reach": self.reach, "ls": list(self.ls)})


_ENTRY = "grp int, part int, threshold double, n double, labelled double, reach double, ls array<double>"


def leaf_entries(rows: DataFrame, dim: int, limits: int | dict[int, int]) -> DataFrame:
    """Merged leaf entries of every ``grp`` of rows (grp, v, labelled): at most its limit of them, as columns of _ENTRY.

    Each partition summarises its rows group by group, sorted if there are several groups,
    so a worker holds one summary however large a group is; then summaries of a group are
    merged a few at a time.
    """
    one = isinstance(limits, int)
    parts = rows.rdd.getNumPartitions()
    limit_of = (lambda g: limits) if one else (lambda g: limits[g])

    def leaf(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def out(grp, summary):
            return pa.RecordBatch.from_pandas(summary.frame(part).assign(grp=grp).astype({"part": "int32", "grp": "int32"})[_COLUMNS], preserve_index=False)

        held, summary = None, None
        for batch in batches:
            at, flat = vx.unpack_lists(batch.column(1), dim)
            marks = batch.column(2).fill_null(False).to_numpy(zero_copy_only=False)[at].astype("float64")
            grp, unit = batch.column(0).to_numpy()[at], vx.normalised(flat)
            cuts = [0, *(np.flatnonzero(grp[1:] != grp[:-1]) + 1), len(grp)] if len(grp) else [0]
            for lo, hi in zip(cuts, cuts[1:]):
                if summary is None or grp[lo] != held:
                    if summary is not None:
                        yield out(held, summary)
                    held = int(grp[lo])
                    summary = Summary(dim, limit_of(held))
                for s in range(lo, hi, 4096):
                    e = min(hi, s + 4096)
                    summary.add(np.ones(e - s), marks[s:e], unit[s:e], np.full(e - s, START_THRESHOLD))
        if summary is not None:
            yield out(held, summary)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        grp = int(pdf["grp"].iloc[0])
        pdf = pdf.sort_values(["reach", "n", "part"], ascending=[True, False, True], kind="stable")
        whole = Summary(dim, limit_of(grp), pdf["threshold"].median())
        whole.add(*(pdf[c].to_numpy() for c in ("n", "labelled")), np.stack(pdf["ls"].to_numpy()), pdf["reach"].to_numpy())
        return whole.frame(int(pdf["part"].iloc[0]) // FAN_IN).assign(grp=grp)[_COLUMNS]

    usable = rows.select("grp", "v", "labelled").where(F.size("v") == dim)
    entries = (usable if one else usable.sortWithinPartitions("grp")).mapInArrow(leaf, _ENTRY)
    while parts > 1:
        entries = entries.groupBy("grp", F.floor(F.col("part") / FAN_IN).alias("_to")).applyInPandas(merge, _ENTRY)
        parts = -(-parts // FAN_IN)
    return entries


_COLUMNS = ["grp", "part", "threshold", "n", "labelled", "reach", "ls"]


def _summary(rows: pd.DataFrame, dim: int, limit: int) -> Summary:
    """A summary of the given leaf entries, largest first."""
    import numpy as np

    out = Summary(dim, limit, rows["threshold"].max() if len(rows) else START_THRESHOLD)
    if len(rows):
        order = np.lexsort((rows["ls"].map(lambda v: v[0]), -rows["n"]))
        out.n, out.labelled, out.reach, out.ls = *(rows[c].to_numpy()[order] for c in ("n", "labelled", "reach")), np.stack(rows["ls"].to_numpy())[order]
    return out


def summarise(df: DataFrame, vector: str, labelled: str, dim: int = 64, limit: int = MAX_ENTRIES) -> Summary:
    """One summary of all usable vectors of ``df``; ``labelled`` is a boolean column, null counts as false."""
    rows = df.select(F.lit(0).alias("grp"), F.col(vector).cast("array<float>").alias("v"), F.col(labelled).alias("labelled"))
    return _summary(leaf_entries(rows, dim, limit).toPandas(), dim, limit)  # at most ``limit`` entries


def ward(n, centres):
    """Merges (height, i, j) of Ward linkage by nearest-neighbour chain; numbers are of the first leaf of either side."""
    import numpy as np

    n, centres = n.astype("float64").copy(), centres.astype("float64").copy()
    alive = np.ones(len(n), dtype=bool)
    chain: list[int] = []
    merges = []
    while alive.sum() > 1:
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        i = chain[-1]
        gap = ((centres - centres[i]) ** 2).sum(axis=1) * (n * n[i] / (n + n[i]))
        gap[~alive] = np.inf
        gap[i] = np.inf
        j = int(gap.argmin())
        if len(chain) > 1 and gap[chain[-2]] <= gap[j]:
            j = chain[-2]
            chain = chain[:-2]
            a, b = min(i, j), max(i, j)
            merges.append((float(gap[j]), a, b))
            centres[a] = (centres[a] * n[a] + centres[b] * n[b]) / (n[a] + n[b])
            n[a] += n[b]
            alive[b] = False
        else:
            chain.append(j)
    return sorted(merges, key=lambda m: m[0])


def group_centres(summary: Summary, k: int, passed_over: bool = True):
    """(centres, sizes) of up to k groups: the coarsest Ward cut with k groups that hold no labelled vector.

    Where no cut has as many, the groups of the finest cut with the lowest labelled share
    follow. Without ``passed_over`` labelled vectors count as the others.
    """
    import numpy as np

    m = len(summary.n)
    root = list(range(m))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    marks = summary.labelled if passed_over else np.zeros(m)
    labelled, n, ls = marks.copy(), summary.n.copy(), summary.ls.copy()
    free = int((labelled == 0).sum())
    done: list[tuple[int, int]] = []
    best = 0
    for _, a, b in ward(summary.n, summary.ls / summary.n[:, None]) if m > 1 else []:
        a, b = find(a), find(b)
        free += int(labelled[a] + labelled[b] == 0) - int(labelled[a] == 0) - int(labelled[b] == 0)
        labelled[a] += labelled[b]
        root[b] = a
        done.append((a, b))
        if free >= k:
            best = len(done)
    labelled, groups = marks.copy(), np.ones(m, dtype=bool)
    for a, b in done[:best]:
        labelled[a] += labelled[b]
        n[a] += n[b]
        ls[a] += ls[b]
        groups[b] = False
    at = np.flatnonzero(groups & (labelled < n))
    at = at[np.lexsort((at, -n[at], labelled[at] / n[at]))][:k]
    return ls[at] / n[at][:, None], n[at]


def _to_centres(rows: DataFrame, dim: int, centres, keep: Sequence[str] = ()) -> DataFrame:
    """(id, grp, distance, keep...) of the usable vectors in (id, v, ...): the nearest centre, the lower number on ties."""
    held = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            at, flat = vx.unpack_lists(batch.column(1), dim)
            if len(at):
                grp, distance = _nearest(vx.normalised(flat), held.value)
                kept = [batch.column(2 + i).take(pa.array(at)) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(grp), pa.array(distance), *kept], names=["id", "grp", "distance", *keep])

    inputs = rows.select("id", "v", *keep)
    schema = StructType.fromDDL("id long, grp int, distance double")
    for k in keep:
        schema = schema.add(inputs.schema[k])
    return inputs.mapInArrow(run, schema)


def _nearest(unit, centres):
    """(number of the nearest centre, distance) of each row, a strip of rows at a time."""
    import numpy as np

    square = (centres**2).sum(axis=1)
    near, far = np.empty(len(unit), dtype="int32"), np.empty(len(unit))
    for s in range(0, len(unit), vx.STRIP):
        gap = 1 + square[None, :] - 2 * unit[s : s + vx.STRIP] @ centres.T
        at = gap.argmin(axis=1)
        near[s : s + vx.STRIP], far[s : s + vx.STRIP] = at, np.sqrt(np.maximum(gap[np.arange(len(at)), at], 0))
    return near, far


def _split_again(rows: DataFrame, dim: int, summary: Summary, k: int) -> DataFrame:
    """(id, grp, sub, group_size, distance, labelled): rows (id, v, labelled) in about ``k`` groups by a tree for every coarse group.

    The shares of k follow the leaf entries of the coarse groups, thus their variety and
    not their size. A coarse group's rows are never in one task: they are summarised where
    they lie, and meet their centres in slices.
    """
    import numpy as np

    coarse, _ = group_centres(summary, max(2, min(MAX_ENTRIES // 8, k // 256)), passed_over=False)
    entries, _ = _nearest(vx.normalised(summary.ls), coarse)
    variety = np.bincount(entries, minlength=len(coarse))
    wanted = {g: int(max(1, -(-k * int(v) // int(variety.sum())))) for g, v in enumerate(variety)}
    limits = {g: int(min(MAX_ENTRIES, max(256, 4 * w))) for g, w in wanted.items()}
    routed = cut_lineage(_to_centres(rows, dim, coarse, ["v", "labelled"]).drop("distance"))
    counts = {r["grp"]: r["n"] for r in routed.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).collect()}

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        g = int(pdf["grp"].iloc[0])
        centres, sizes = group_centres(_summary(pdf, dim, limits[g]), wanted[g])
        return pd.DataFrame({"grp": g, "sub": np.arange(len(centres), dtype="int32"), "group_size": sizes, "centre": list(centres)})

    centres = cut_lineage(leaf_entries(routed, dim, limits).groupBy("grp").applyInPandas(cut, "grp int, sub int, group_size double, centre array<double>"))
    slices = spark_map({g: -(-n // SLICE_ROWS) for g, n in counts.items()})
    left = routed.withColumn("_slice", F.pmod(F.xxhash64("id"), slices[F.col("grp")]).cast("int"))
    right = centres.withColumn("_slice", F.explode(F.sequence(F.lit(0), (slices[F.col("grp")] - 1).cast("int"))))

    def meet(a, b):
        import pyarrow as pa

        centre = b.column("centre").combine_chunks().flatten().to_numpy().reshape(-1, dim) if b.num_rows else np.empty((0, dim))
        at, flat = vx.unpack_lists(a.column("v"), dim) if a.num_rows and len(centre) else (np.empty(0, "int64"), np.empty((0, dim)))
        near, far = _nearest(vx.normalised(flat), centre) if len(at) else (np.empty(0, "int32"), np.empty(0))
        rows, to = pa.array(at), pa.array(near)
        return pa.table([a.column("id").take(rows), a.column("grp").take(rows), b.column("sub").take(to), b.column("group_size").take(to), pa.array(far), a.column("labelled").take(rows)], names=["id", "grp", "sub", "group_size", "distance", "labelled"])

    return left.groupBy("grp", "_slice").cogroup(right.groupBy("grp", "_slice")).applyInArrow(meet, "id long, grp int, sub int, group_size double, distance double, labelled boolean")


def spark_map(values: dict):
    """A literal map column."""
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def choose(df: DataFrame, ident: str, vector: str, labelled: str, k: int, dim: int = 64) -> DataFrame:
    """(id, group_no, group_size, distance): k unlabelled records that cover the vectors' variety.

    Unusable vectors and null ids are left out; repeated rows weigh as often as they come
    and are never chosen twice. Groups that hold labelled vectors are passed over while
    enough others exist. Equal distances are ordered by id. Fewer than k rows come out only
    when there are fewer unlabelled usable records: where centres share their nearest
    record, or there are fewer leaf entries than k, the records next to the centres follow.
    For k above MAX_ENTRIES / 8 every coarse group is split again by its own tree. k < 1 or
    an empty table gives no rows.
    """
    spark = df.sparkSession
    schema = "id long, group_no int, group_size double, distance double"
    summary = summarise(df, vector, labelled, dim, int(min(MAX_ENTRIES, max(1024, 8 * k))))
    if k < 1 or not len(summary.n):
        return spark.createDataFrame([], schema)
    rows = df.where(F.col(ident).isNotNull() & (F.size(vector) == dim)).select(F.col(ident).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v"), F.coalesce(F.col(labelled), F.lit(False)).alias("labelled"))
    if 8 * k <= MAX_ENTRIES:
        centres, sizes = group_centres(summary, k)
        near = _to_centres(rows.where(~F.col("labelled")), dim, centres).withColumn("sub", F.lit(0)).withColumn("group_size", F.lit([float(x) for x in sizes])[F.col("grp")])
    else:
        near = _split_again(rows, dim, summary, k).where(~F.col("labelled"))
    group = F.struct("distance", "grp", "sub", "group_size")
    near = cut_lineage(near.groupBy("id").agg(F.min(group).alias("_g")).select("id", "_g.*"))
    held = near.groupBy("grp", "sub").agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("groups")).collect()  # one row for each size of group
    most = least_rank([(r["n"], r["groups"]) for r in held], k)
    rank = F.row_number().over(Window.partitionBy("grp", "sub").orderBy("distance", "id"))
    ranked = near.withColumn("rank", rank).where(F.col("rank") <= most)
    taken = ranked.orderBy("rank", F.desc("group_size"), "distance", "id").limit(k)
    return taken.select("id", (F.col("grp") * MAX_ENTRIES + F.col("sub")).cast("int").alias("group_no"), "group_size", "distance")


def least_rank(held: list[tuple[int, int]], k: int) -> int:
    """The least number of records to take from each group, or all it has, for k in all; held: (records, groups with as many)."""
    lo, hi = 1, max([n for n, _ in held], default=1)
    while lo < hi:
        mid = (lo + hi) // 2
        if sum(min(n, mid) * g for n, g in held) >= k:
            hi = mid
        else:
            lo = mid + 1
    return lo


def representatives(df: DataFrame, ident: str, vector: str, dim: int, summary: Summary, k: int):
    """Unit vectors of the records nearest the centres of ``k`` groups of the Ward cut, fewer where centres share a record."""
    import numpy as np

    centres, _ = group_centres(summary, k, passed_over=False)
    rows = df.where(F.col(ident).isNotNull() & (F.size(vector) == dim)).select(F.col(ident).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v"))
    best = _to_centres(rows, dim, centres, ["v"]).groupBy("grp").agg(F.min_by("v", F.struct("distance", "id")).alias("v")).select("v").collect()  # at most MAX_ENTRIES rows
    return vx.normalised(np.array([r["v"] for r in best], dtype="float64")) if best else np.empty((0, dim))


def crowded(df: DataFrame, ident: str, vector: str, labelled: str, min_neighbours: int, min_similarity: float, dim: int = 64) -> DataFrame:
    """(id): unlabelled ids that have at least ``min_neighbours`` other distinct ids at cosine ``min_similarity`` or more.

    Vectors within half the angle of ``min_similarity`` of a dense leaf entry's centre are
    neighbours of each other; where that many share a centre they are settled without
    looking at pairs, however many they are. The others are counted exactly: each looks into
    all cells, around the dense centres and the records nearest the centres of the Ward
    cut's groups, that the angle of ``min_similarity`` does not exclude. Equal vectors form one class that weighs as many
    as it has distinct ids, so copies are never paired. Products of codes decide a pair
    where their error bound allows; the others are computed exactly. An empty table gives
    no rows.
    """
    import numpy as np

    rows = df.withColumn("_labelled", F.coalesce(F.col(labelled), F.lit(False)))
    summary = summarise(rows, vector, "_labelled", dim)
    centres, groups = summary.dense(), int(summary.n.sum()) // vx.CELL_CLASSES
    pivots = np.concatenate([centres, representatives(df, ident, vector, dim, summary, max(1, groups)) if len(summary.n) else centres[:0]])
    half = float(np.cos(np.arccos(min_similarity) / 2)) + 1e-6
    coded = vx.code(rows, ident, vector, dim, pivots, 1, keep=["_labelled"], core=(len(centres), half), wide=False)
    members = coded.groupBy("c", "id").agg(F.first("payload").alias("payload"), F.first("cells").alias("cells"), F.first("core").alias("core"), F.min("_labelled").alias("_labelled"))
    members = cut_lineage(members)
    # at most one row for each dense entry
    full = members.where(F.col("core") >= 0).groupBy("core").agg(F.count_distinct("id").alias("n")).where(F.col("n") > min_neighbours).select("core")
    settled = members.join(F.broadcast(full), "core", "left_semi")
    classes = members.groupBy("c").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.first("payload").alias("payload"), F.first("cells").alias("cells"), F.first("core").alias("core"))
    open_classes = classes.join(F.broadcast(full), "core", "left_anti")

    def count(x: vx.Block, y: vx.Block) -> dict:
        import pyarrow as pa

        i, j, sims, bound = vx.tile_pairs(x, y, min_similarity, None)
        sure = sims - bound >= min_similarity
        sums = np.bincount(i[sure], weights=y.weight[j[sure]], minlength=len(x.ids)).astype("int64")
        some = np.flatnonzero(sums)
        i, j = i[~sure], j[~sure]
        other = pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(y.ids[j], pa.int64())])
        return {"a": np.concatenate((x.ids[some], x.ids[i])), "b": other, "n": np.concatenate((sums[some], y.weight[j]))}

    reach = F.lit(float(np.arccos(min_similarity)))
    base, looking = vx.within_bounds(classes.select("rep", "payload", "cells", "weight"), open_classes.select("rep", "payload", reach.alias("reach")), pivots, dim)
    tiled = vx.tiles(base, looking, ["weight"])
    counted = cut_lineage(vx.in_tiles(tiled, count, "a long, b long, n long", dim, ["weight"]))
    vectors = df.select(F.col(ident).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v"))
    doubtful = vx.exact_cosines(counted.where(F.col("b").isNotNull()), vectors, dim).where(F.col("cosine") >= min_similarity).select("a", "n")
    own = open_classes.where(F.col("weight") > 1).select(F.col("rep").alias("a"), (F.col("weight") - 1).alias("n"))
    total = counted.where(F.col("b").isNull()).select("a", "n").unionByName(doubtful).unionByName(own).groupBy("a").agg(F.sum("n").alias("n"))
    found = open_classes.select("c", F.col("rep").alias("a")).join(total.where(F.col("n") >= min_neighbours), "a").select("c")
    free = ~F.col("_labelled")
    return settled.where(free).select("id").unionByName(members.where(free).join(found, "c", "left_semi").select("id")).distinct()
