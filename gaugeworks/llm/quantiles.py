"""Percentiles with bounded error that combine: compressed dyadic-tree counts.

Values are mapped to an ordered universe of 2 ** DEPTH cells, a piecewise linear
logarithm with 2 ** MANTISSA_BITS cells per power of two and a mirrored negative half. A
digest holds counts of nodes of the dyadic tree over these cells (root 1, children 2v and
2v + 1, cell c at 2 ** DEPTH + c). Compression moves a pair of siblings into their parent
while the three together hold at most n // k. So no inner node below the root holds more,
and the rank of any value is known within DEPTH * n / k rows: with k = DEPTH / eps within
eps * n. Merging adds the counts of equal nodes and compresses again; the bound stays.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Cells for each power of two: a value is known within a factor of 1 + 2 ** -MANTISSA_BITS.
MANTISSA_BITS = 9
#: Powers of two told apart; smaller magnitudes count as zero. Larger ones share the last cell, whose upper bound is infinite.
LOW_POWER, HIGH_POWER = -64, 63
#: 2 ** 16 cells for each sign, with one more level for the sign.
DEPTH = 17
HALF = 1 << (DEPTH - 1)
DEFAULT_EPS = 0.005


def cell(value: Column) -> Column:
    """The cell of a finite double; null for null, NaN and infinite values."""
    v = F.abs(value)
    e = F.floor(F.log2(v)).cast("double")
    part = F.least(F.greatest(v / F.pow(F.lit(2.0), e) - 1, F.lit(0.0)), F.lit(1 - 2.0**-MANTISSA_BITS))
    steps = F.floor((e - LOW_POWER + part) * (1 << MANTISSA_BITS)).cast("int") + 1
    steps = F.when(v < 2.0**LOW_POWER, 0).otherwise(F.least(steps, F.lit(HALF - 1)))
    finite = value.isNotNull() & ~F.isnan(value) & (v != float("inf"))
    return F.when(finite, F.when(value < 0, HALF - steps).otherwise(HALF + steps)).cast("int")


def cell_bounds(cells):
    """Smallest and largest value of each cell, one cell wider than exact arithmetic needs, as NumPy arrays."""
    import numpy as np

    def edge(steps):
        whole, part = np.divmod(np.maximum(steps, 1) - 1, 1 << MANTISSA_BITS)
        return np.where(steps <= 0, 0.0, np.ldexp(1 + part / (1 << MANTISSA_BITS), whole + LOW_POWER))

    steps = np.asarray(cells, dtype="int64") - HALF
    size = np.abs(steps)
    near, far = edge(size - 1), np.where(size >= HALF - 1, np.inf, edge(size + 2))
    return np.where(steps > 0, near, -far), np.where(steps >= 0, far, -near)


def _compress(group, node, count, limit):
    """Compresses digests of many groups at once, level by level. Arrays by row; ``limit`` is n // k by group."""
    import numpy as np

    done: list[tuple] = []
    order = np.lexsort((node, group))
    group, node, count = group[order], node[order], count[order]
    for level in range(DEPTH, 0, -1):
        here = node >= (1 << level)
        g, v, c = group[here], node[here], count[here]
        up_g, up_v, up_c = group[~here], node[~here], count[~here]
        if len(g):
            # nodes come sorted by (group, node), so siblings are neighbours
            parent = v >> 1
            first = np.concatenate(([True], (g[1:] != g[:-1]) | (parent[1:] != parent[:-1])))
            at = np.flatnonzero(first)
            pg, pv, pc = g[at], parent[at], np.add.reduceat(c, at)
            have = np.zeros(len(at), dtype="int64")
            key, own = _key(pg, pv), _key(up_g, up_v)
            if len(own):
                sorter = np.argsort(own, kind="stable")
                place = np.minimum(np.searchsorted(own[sorter], key), len(own) - 1)
                hit = own[sorter][place] == key
                have[hit] = up_c[sorter][place[hit]]
            move = (pc + have <= limit[pg]) | (pc == 0)
            stays = ~np.repeat(move, np.diff(np.append(at, len(g))))
            done.append((g[stays], v[stays], c[stays]))
            group, node, count = np.concatenate((up_g, pg[move])), np.concatenate((up_v, pv[move])), np.concatenate((up_c, pc[move]))
            group, node, count = _sum_equal(group, node, count)
        else:
            group, node, count = up_g, up_v, up_c
    done.append((group, node, count))
    g, v, c = (np.concatenate(x) for x in zip(*done))
    order = np.lexsort((v, g))
    return g[order], v[order], c[order]


def _key(group, node):
    return group.astype("int64") << (DEPTH + 2) | node


def _sum_equal(group, node, count):
    import numpy as np

    order = np.argsort(_key(group, node), kind="stable")
    group, node, count = group[order], node[order], count[order]
    if not len(group):
        return group, node, count
    at = np.flatnonzero(np.concatenate(([True], (group[1:] != group[:-1]) | (node[1:] != node[:-1]))))
    return group[at], node[at], np.add.reduceat(count, at)


def _digest_groups(nodes: DataFrame, by: Sequence[str], k: int) -> DataFrame:
    """nodes: (by..., node, n), each once -> (by..., n_values, nodes, counts), compressed.

    Rows of a group arrive together and sorted, so a worker holds one batch and at most
    one group more; a group has at most as many rows as the tree has nodes.
    """
    by = list(by)
    kinds = {f.name: f.dataType for f in nodes.schema}
    schema = T.StructType([T.StructField(b, kinds[b]) for b in by] + [T.StructField("n_values", T.LongType()), T.StructField("nodes", T.ArrayType(T.LongType())), T.StructField("counts", T.ArrayType(T.LongType()))])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            starts = _starts(t, by)
            if held and _same(held[-1], t, by):
                cut = starts[1] if len(starts) > 1 else t.num_rows
                held.append(t.slice(0, cut))
                if cut == t.num_rows:
                    continue
                yield from _pack(pa.concat_tables(held), by, k, schema)
                t, starts = t.slice(cut), starts[1:] - cut
                held = []
            elif held:
                yield from _pack(pa.concat_tables(held), by, k, schema)
                held = []
            last = int(starts[-1])
            if last:
                yield from _pack(t.slice(0, last), by, k, schema)
            held = [t.slice(last)]
        if held:
            yield from _pack(pa.concat_tables(held), by, k, schema)

    return nodes.select(*by, F.col("node").cast("long").alias("node"), F.col("n").cast("long").alias("n")).repartition(*by).sortWithinPartitions(*by, "node").mapInArrow(run, schema)


def _codes(table, by):
    """For each row whether it begins a group."""
    import numpy as np
    import pyarrow.compute as pc

    begins = np.zeros(table.num_rows, dtype=bool)
    begins[0] = True
    for b in by:
        c = table.column(b).combine_chunks()
        if table.num_rows > 1:
            a, z = c.slice(0, len(c) - 1), c.slice(1)
            equal = pc.fill_null(pc.equal(a, z), False).to_numpy(zero_copy_only=False)
            both = pc.and_(pc.is_null(a), pc.is_null(z)).to_numpy(zero_copy_only=False)
            begins[1:] |= ~(equal | both)
    return begins


def _starts(table, by):
    import numpy as np

    return np.flatnonzero(_codes(table, by))


def _same(before, after, by) -> bool:
    return all(before.column(b)[-1].as_py() == after.column(b)[0].as_py() for b in by)


def _pack(table, by, k, schema):
    """Digests of the whole groups in the table."""
    import numpy as np
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    table = table.combine_chunks()
    starts = _starts(table, by)
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, table.num_rows)))
    node, count = (table.column(c).to_numpy().astype("int64") for c in ("node", "n"))
    n = np.bincount(group, weights=count, minlength=len(starts)).astype("int64")
    group, node, count = _compress(group, node, count, n // k)
    offsets = np.searchsorted(group, np.arange(len(starts) + 1)).astype("int32")
    columns = [table.column(b).take(pa.array(starts)) for b in by]
    columns += [pa.array(n), pa.ListArray.from_arrays(pa.array(offsets), pa.array(node)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(count))]
    arrow = to_arrow_schema(schema)
    yield from pa.table([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow).to_batches()


def digest(df: DataFrame, by: Sequence[str], value: Column, eps: float = DEFAULT_EPS) -> DataFrame:
    """One digest per group: (by..., n_values, nodes, counts).

    Null, NaN and infinite values are left out; a group without any value has no digest.
    Null group keys form a group. Counting by cell combines on the map side and spreads a
    hot group over its cells.
    """
    cells = df.select(*by, cell(value).alias("_cell")).where(F.col("_cell").isNotNull())
    leaves = cells.groupBy(*by, "_cell").agg(F.count(F.lit(1)).alias("n")).select(*by, (F.col("_cell").cast("long") + (1 << DEPTH)).alias("node"), "n")
    return _digest_groups(leaves, by, _k(eps))


def merge(digests: DataFrame, by: Sequence[str], eps: float = DEFAULT_EPS) -> DataFrame:
    """Adds digests up to coarser groups ``by``; all must have been made with this ``eps``."""
    nodes = digests.select(*by, F.explode(F.arrays_zip("nodes", "counts")).alias("_x")).groupBy(*by, F.col("_x.nodes").alias("node")).agg(F.sum("_x.counts").alias("n"))
    return _digest_groups(nodes, by, _k(eps))


def _k(eps: float) -> int:
    return max(1, -int(-DEPTH // eps))


def percentiles(digests: DataFrame, by: Sequence[str], fractions: Sequence[float], eps: float = DEFAULT_EPS) -> DataFrame:
    """(by..., fraction, n_values, estimate, lower, upper, rank_error), one row per group and fraction.

    The value at linear-interpolation rank fraction * (n - 1) lies within [lower, upper].
    estimate lies within rank_error = eps * n_values rows of it, up to the cell width.
    """
    by = list(by)
    kinds = {f.name: f.dataType for f in digests.schema}
    doubles = ("estimate", "lower", "upper", "rank_error")
    schema = T.StructType([T.StructField(b, kinds[b]) for b in by] + [T.StructField("fraction", T.DoubleType()), T.StructField("n_values", T.LongType())] + [T.StructField(d, T.DoubleType()) for d in doubles])
    fractions = [float(q) for q in fractions]

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(len(by) + 1)
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
            n = batch.column(len(by)).to_numpy()
            found = _read(n, lengths, lists.flatten().to_numpy(), batch.column(len(by) + 2).flatten().to_numpy(), fractions)
            rows = pa.array(np.repeat(np.arange(batch.num_rows), len(fractions)))
            keys = [batch.column(i).take(rows) for i in range(len(by))]
            each = np.repeat(n, len(fractions))
            yield pa.RecordBatch.from_arrays([*keys, pa.array(np.tile(fractions, batch.num_rows)), pa.array(each), *(pa.array(x.ravel()) for x in found), pa.array(each * eps)], names=schema.names)

    return digests.select(*by, "n_values", "nodes", "counts").mapInArrow(run, schema)


def _read(n, lengths, nodes, counts, fractions):
    """(estimate, lower, upper), each by digest and fraction, of digests whose nodes and counts follow each other."""
    import numpy as np

    nodes, counts = nodes.astype("int64"), counts.astype("int64")
    group = np.repeat(np.arange(len(n)), lengths)
    level = np.floor(np.log2(nodes)).astype("int64")
    width = np.left_shift(1, DEPTH - level)
    first = (nodes << (DEPTH - level)) - (1 << DEPTH)
    last = first + width - 1
    by_last, by_first = np.lexsort((-level, last, group)), np.lexsort((first, group))
    # ranks within a digest are places in the running sum over all digests
    sure, may = np.cumsum(counts[by_last]), np.cumsum(counts[by_first])
    before = np.cumsum(n) - n
    ends = np.cumsum(lengths)

    def at_rank(order, running, rank):
        place = np.searchsorted(running, before[:, None] + rank)
        return order[np.minimum(place, ends[:, None] - 1)]

    at = np.asarray(fractions)[None, :] * (n[:, None] - 1)
    # all of the first values up to this rank lie in nodes that begin at or before this cell
    lower = cell_bounds(first[at_rank(by_first, may, np.floor(at).astype("int64") + 1)])[0]
    upper = cell_bounds(last[at_rank(by_last, sure, np.ceil(at).astype("int64") + 1)])[1]
    a, b = cell_bounds(last[at_rank(by_last, sure, np.maximum(1, np.rint(at + 1)).astype("int64"))])
    with np.errstate(invalid="ignore"):
        middle = np.where(np.isfinite(a + b), (a + b) / 2, np.where(np.isfinite(a), a, b))
    return np.clip(middle, lower, upper), lower, upper
