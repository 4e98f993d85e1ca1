"""Vectors in blocks: coding, cells, and products of tiles with error bounds.

A usable vector has the expected number of finite values that are not all zero. It is
scaled to length one and coded as 8-bit integers, or as 16-bit ones whose upper bytes are the int8 code.
The coding errors' lengths are known, so a product of codes bounds the cosine. Equal
vectors form a class with one code. Classes fall into cells around pivot vectors; a tile
holds the classes of a cell and those classes of other cells that look into it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from gaugeworks.session import cut_lineage

#: Classes of a cell on average, while the number of pivots is below its bound.
CELL_CLASSES = 256
#: Pivots are sent to all tasks: at most this many, so 4 MB at 64 values.
MAX_PIVOTS = 16_384
#: Beyond that every pivot's cell is divided by the direction in which a vector lies from the pivot: at most this many.
MAX_DIRECTIONS = 256
#: Classes on either side of one tile; larger cells are cut into several tiles.
TILE_CLASSES = 24_576
#: Rows of a tile multiplied at once.
STRIP = 256
#: Values whose products bound the whole product first, and the share of pairs up to which only those left are multiplied.
HEAD_VALUES, FEW_PAIRS = 24, 0.01
#: A class with at least this cosine with its pivot is in the inner shell of its cell.
INNER = 0.7
#: Classes of a region of inner shells; outer shells, which bounds seldom exclude, fill a tile.
REGION_CLASSES = 1_024
#: Radians that angles are off at most by float32 arithmetic, besides the coding error.
ANGLE_SLACK = 4e-3

KEY_BYTES, HEAD_BYTES = 16, 8
#: Needed ids that are sent to all tasks when vectors are looked up; more are joined by a shuffle.
BROADCAST_IDS = 200_000


def unpack_lists(column, dim: int):
    """(row numbers, float64 matrix) of the usable vectors in an Arrow list column."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    fits = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False)
    rows = np.flatnonzero(fits.to_numpy(zero_copy_only=False))
    flat = column.filter(fits).flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(-1, dim)
    # far from 1 the squares could leave the range of doubles
    peak = np.abs(flat).max(axis=1, initial=0.0)
    good = np.isfinite(flat).all(axis=1) & (peak > 0)
    return rows[good], flat[good] / peak[good][:, None]


def normalised(matrix):
    import numpy as np

    return matrix / np.sqrt(np.einsum("ij,ij->i", matrix, matrix))[:, None]


def class_keys(unit):
    """16 bytes for each row, equal for equal rows: two multilinear hashes of the float32 bits."""
    import numpy as np

    bits = np.ascontiguousarray(unit.astype("float32") + np.float32(0)).view("uint32").astype("uint64")
    odd = np.random.default_rng(20_241_101).integers(0, 2**63, size=(2, bits.shape[1]), dtype="uint64") * np.uint64(2) + np.uint64(1)
    both = np.stack([(bits * o).sum(axis=1, dtype="uint64") for o in odd], axis=1)
    both ^= both >> np.uint64(31)
    return (both * np.uint64(0x9E3779B97F4A7C15)).view("uint8").reshape(len(unit), KEY_BYTES)


def encode(unit, wide: bool = True):
    """Payload bytes of each row: scale and error length (float32), codes of 16 bits, or 8 if not ``wide``."""
    import numpy as np

    largest = 32767 if wide else 127
    scale = (np.abs(unit).max(axis=1) / largest).astype("float32")
    codes = np.rint(unit / scale[:, None]).clip(-largest, largest).astype("int16" if wide else "int8")
    error = np.sqrt(((unit - codes * scale[:, None].astype("float64")) ** 2).sum(axis=1)) * 1.0001 + 1e-7
    head = np.stack([scale, error.astype("float32")], axis=1)
    return np.concatenate([head.view("uint8").reshape(len(unit), HEAD_BYTES), codes.view("uint8").reshape(len(unit), -1)], axis=1)


def _scaled(codes, scale):
    """int8 codes times their scale: products in float32 are off by less than 1e-5, which the bounds allow for."""
    return (codes * scale[:, None]).astype("float32")


class Block:
    """Decoded payloads: ``ids``, ``codes``, ``scale``, ``error``, and the scaled int8 plane ``rough`` with its error."""

    def __init__(self, ids, payload, dim: int):
        import numpy as np

        wide = bool(payload) and len(payload[0]) > HEAD_BYTES + dim
        raw = np.frombuffer(b"".join(payload), dtype="uint8").reshape(len(payload), HEAD_BYTES + dim * (1 + wide))
        self.ids = ids
        head = np.ascontiguousarray(raw[:, :HEAD_BYTES]).view("float32").astype("float64")
        self.scale, self.error = head[:, 0], head[:, 1]
        self.codes = np.ascontiguousarray(raw[:, HEAD_BYTES:]).view("int16" if wide else "int8")
        if not wide:
            self.high_error, self.rough = self.error, _scaled(self.codes, self.scale)
            return
        high = np.rint(self.codes / 256.0).clip(-127, 127)
        self.rough = _scaled(high, self.scale * 256)
        rest = (self.codes - high * 256.0) * self.scale[:, None]
        self.high_error = np.sqrt((rest * rest).sum(axis=1)) + self.error


def _head(matrix):
    """The first HEAD_VALUES columns and the length of the others."""
    import numpy as np

    rest = matrix[:, HEAD_VALUES:]
    return np.concatenate([matrix[:, :HEAD_VALUES], np.sqrt(np.einsum("ij,ij->i", rest, rest))[:, None]], axis=1)


def _best_of(i, j, value, k: int, room: float):
    """The pairs whose value is at most ``room`` below the k-th largest of their i."""
    import numpy as np

    order = np.lexsort((-value, i))
    i, j, value = i[order], j[order], value[order]
    begin, end = np.searchsorted(i, i), np.searchsorted(i, i, side="right")
    keep = (end - begin <= k) | (value >= value[np.minimum(begin + k - 1, end - 1)] - room)
    return i[keep], j[keep]


def tile_pairs(x: Block, y: Block, floor, k: int | None, others: bool = True):
    """Pairs (row in x, row in y, cosine, error bound) that may be among the k best of their x and reach ``floor``.

    ``floor`` is None, a number, or a number for each row of x. int8 products with their bound first, then the surviving pairs from the 16-bit codes.
    Pairs of equal ids are left out, unless not ``others``: then the sides have ids of their own.
    """
    import numpy as np

    found = []
    floors = None if floor is None else np.broadcast_to(np.asarray(floor, dtype="float64"), len(x.scale))
    widest = y.high_error.max(initial=0.0)
    dim = x.rough.shape[1]
    heads = (_head(x.rough), _head(y.rough)) if floors is not None and dim >= 2 * HEAD_VALUES and len(floors) and floors.min() >= 0.5 else None
    for start in range(0, len(x.scale), STRIP):
        rows = slice(start, start + STRIP)
        slack = x.high_error[rows].max() * (1 + widest) + widest + 2e-5
        least = None if floor is None else (floors[rows] - slack).astype("float32")[:, None]
        if heads is not None:
            # by Cauchy-Schwarz the rest of a product is at most the product of the rests' lengths
            i, j = np.nonzero(heads[0][rows] @ heads[1].T >= least - np.float32(1e-5))
            if len(i) <= FEW_PAIRS * len(least) * len(y.scale):
                value = np.concatenate([np.einsum("ij,ij->i", x.rough[start + i[s : s + 65_536]], y.rough[j[s : s + 65_536]]) for s in range(0, len(i), 65_536)]) if len(i) else np.empty(0, "float32")
                keep = value >= least[i, 0]
                i, j = i[keep], j[keep]
                if k is not None and len(i):
                    i, j = _best_of(i, j, value[keep], k + 1, 2 * slack)
                i = i + start
                if others:
                    apart = x.ids[i] != y.ids[j]
                    i, j = i[apart], j[apart]
                found.append((i, j))
                continue
        rough = x.rough[rows] @ y.rough.T
        above = None if floor is None else rough >= least
        if k is None:
            i, j = np.nonzero(above) if above is not None else (a.ravel() for a in np.indices(rough.shape))
        elif len(y.scale) <= k + 1:
            i, j = np.nonzero(above if above is not None else np.ones(rough.shape, dtype=bool))
        elif above is not None and np.count_nonzero(above) <= 32 * (k + 1) * len(rough):
            i, j = np.nonzero(above)
            i, j = _best_of(i, j, rough[i, j], k + 1, 2 * slack)
        else:
            # the k + 1 best, as one of them may be the class itself
            kth = np.partition(rough, len(y.scale) - k - 1, axis=1)[:, len(y.scale) - k - 1, None] - 2 * slack
            i, j = np.nonzero(rough >= (kth if least is None else np.maximum(kth, least)))
        i = i + start
        if others:
            apart = x.ids[i] != y.ids[j]
            i, j = i[apart], j[apart]
        found.append((i, j))
    i, j = (np.concatenate(a) for a in zip(*found)) if found else (np.empty(0, "int64"),) * 2
    sims = np.empty(len(i))
    for s in range(0, len(i), 65_536):
        a, b = i[s : s + 65_536], j[s : s + 65_536]
        sims[s : s + 65_536] = np.einsum("ij,ij->i", x.codes[a].astype("float64"), y.codes[b].astype("float64")) * x.scale[a] * y.scale[b]
    bound = x.error[i] * (1 + y.error[j]) + y.error[j] + 1e-7
    if floor is not None:
        keep = sims + bound >= floors[i]
        i, j, sims, bound = i[keep], j[keep], sims[keep], bound[keep]
    if k is not None and len(i):
        order = np.lexsort((-(sims - bound), i))
        i, j, sims, bound = i[order], j[order], sims[order], bound[order]
        begin = np.searchsorted(i, i)
        kth = np.minimum(begin + k - 1, np.searchsorted(i, i, side="right") - 1)
        full = (np.searchsorted(i, i, side="right") - begin) >= k
        keep = ~full | (sims + bound >= (sims - bound)[kth])
        i, j, sims, bound = i[keep], j[keep], sims[keep], bound[keep]
    return i, j, sims, bound


def pivots_by_hash(df: DataFrame, ident: str, vector: str, dim: int, n_rows: int, per_cell: int = CELL_CLASSES):
    """Unit vectors of the rows with the lowest hashes of id and vector, one for ``per_cell`` rows, at most MAX_PIVOTS."""
    import numpy as np

    wanted = int(min(MAX_PIVOTS, max(1, n_rows // per_cell)))
    share = min(1.0, 2.0 * wanted / max(1, n_rows) + 64 / max(1, n_rows))
    h = F.xxhash64(ident, vector)
    near = df.where(h < F.lit(int(-(2**63) + share * (2**64 - 1)))) if share < 1 else df
    rows = near.where(F.size(vector) == dim).select(vector, h.alias("_h")).distinct().orderBy("_h").limit(wanted + wanted // 4 + 8).collect()
    matrix = np.array([[np.nan if v is None else v for v in r[0]] for r in rows], dtype="float64").reshape(-1, dim)
    matrix = matrix[np.isfinite(matrix).all(axis=1) & (matrix != 0).any(axis=1)][:wanted]
    return normalised(matrix / np.abs(matrix).max(axis=1)[:, None]) if len(matrix) else matrix


def directions(pivots, n_rows: int, per_cell: int | None = None):
    """(unit vectors, step) that divide the cells of all pivots alike, so that a cell has about ``per_cell`` rows; None if cells are small enough.

    They are the directions in which some pivots lie from their nearest other pivot, and
    step is how far they lie on average. pivot + step * direction is the centre of a part.
    """
    import numpy as np

    wanted = min(MAX_DIRECTIONS, len(pivots) - 1, n_rows // ((per_cell or CELL_CLASSES) * max(1, len(pivots))))
    if wanted < 2:
        return None
    some = pivots[:wanted]
    cosine = some @ pivots.T
    cosine[np.arange(wanted), np.arange(wanted)] = -2
    near = cosine.argmax(axis=1)
    rest = some - cosine[np.arange(wanted), near][:, None] * pivots[near]
    size = np.sqrt((rest**2).sum(axis=1))
    apart = size > 1e-6
    if apart.sum() < 2:
        return None
    return rest[apart] / size[apart][:, None], float(np.median(size[apart] / np.maximum(cosine[np.arange(wanted), near][apart], 0.1)))


def code(df: DataFrame, ident: str, vector: str, dim: int, pivots, probes: int, keep: Sequence[str] = (), core: tuple[int, float] | None = None, parts=None, wide: bool = True) -> DataFrame:
    """(c, id, payload, cells, core, keep...) of the usable rows; c is equal for equal vectors, cells are the ``probes`` nearest pivots, nearest first.

    With ``parts`` from ``directions`` cells are parts of those pivots' cells, those with
    the nearest centres. ``core`` = (m, s) marks rows whose cosine with the nearest of the
    first m pivots is at least s by that pivot's number; other rows have -1. ``wide`` codes have 16 bits.
    """
    import numpy as np

    held = df.sparkSession.sparkContext.broadcast(pivots.astype("float32"))
    if parts is not None:
        turned, step = parts[0].astype("float32"), np.float32(parts[1])
        lengths = np.sqrt(1 + step**2 + 2 * step * (pivots.astype("float32") @ turned.T))
        fine = df.sparkSession.sparkContext.broadcast((turned, step, lengths))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        pivot = held.value
        m = min(probes, max(1, len(pivot)))
        for batch in batches:
            rows, flat = unpack_lists(batch.column(1), dim)
            if not len(rows):
                continue
            unit = normalised(flat)
            payload = encode(unit, wide)
            best, inside = np.zeros((len(rows), m), dtype="int32"), np.full(len(rows), -1, dtype="int32")
            # a strip at a time, as all rows by all pivots would not fit
            for s in range(0, len(rows) if len(pivot) else 0, STRIP):
                near = unit[s : s + STRIP].astype("float32") @ pivot.T
                some = np.argpartition(-near, m - 1, axis=1)[:, :m] if m < len(pivot) else np.tile(np.arange(len(pivot)), (len(near), 1))
                some = np.take_along_axis(some, np.argsort(-np.take_along_axis(near, some, axis=1), axis=1, kind="stable"), axis=1)
                if parts is not None:
                    turned, step, lengths = fine.value
                    own = unit[s : s + STRIP].astype("float32") @ turned.T
                    cosine = ((np.take_along_axis(near, some, axis=1)[:, :, None] + step * own[:, None, :]) / lengths[some]).reshape(len(near), -1)
                    first = np.argpartition(-cosine, m - 1, axis=1)[:, :m]
                    first = np.take_along_axis(first, np.argsort(-np.take_along_axis(cosine, first, axis=1), axis=1, kind="stable"), axis=1)
                    some = np.take_along_axis(some, first // own.shape[1], axis=1) * own.shape[1] + first % own.shape[1]
                best[s : s + STRIP] = some
                if core and core[0]:
                    first = near[:, : core[0]].argmax(axis=1)
                    inside[s : s + STRIP] = np.where(near[np.arange(len(near)), first] >= core[1], first, -1)
            cells = pa.ListArray.from_arrays(pa.array(np.arange(0, best.size + 1, best.shape[1], dtype="int32")), pa.array(best.ravel()))
            ids = batch.column(0).take(pa.array(rows)).cast(pa.int64())
            keys = [p.tobytes() for p in class_keys(unit)]
            others = [batch.column(2 + i).take(pa.array(rows)) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), ids, pa.array([p.tobytes() for p in payload], pa.binary()), cells, pa.array(inside), *others], names=["c", "id", "payload", "cells", "core", *keep])

    inputs = df.select(F.col(ident).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v"), *keep)
    schema = StructType.fromDDL("c binary, id long, payload binary, cells array<int>, core int")
    for k in keep:
        schema = schema.add(inputs.schema[k])
    return inputs.where(F.col("id").isNotNull() & (F.size("v") == dim)).mapInArrow(run, schema)


def lowest_members(coded: DataFrame, k: int) -> DataFrame:
    """(c, rep, members, payload, cells): classes with their ``k`` lowest distinct ids, ``rep`` the lowest of all.

    The rank limit is applied before the shuffle too, so a class with a third of all rows
    sends a few rows from each task.
    """
    ranked = coded.withColumn("_r", F.dense_rank().over(Window.partitionBy("c").orderBy("id"))).where(F.col("_r") <= k)
    return ranked.groupBy("c").agg(F.min("id").alias("rep"), F.array_sort(F.collect_set("id")).alias("members"), F.first("payload").alias("payload"), F.first("cells").alias("cells"))


def tiles(base: DataFrame, probing: DataFrame | None, carry: Sequence[str] = ()) -> DataFrame:
    """(tile, cut_y, cut_x, looks, lies, rep, payload, carry...): which classes meet in which tile.

    base: (rep, payload, cells), lies in its nearest cell. ``probing``: classes that look
    into all their cells, or None when the base does. Cells with more than TILE_CLASSES on
    a side are cut, each cut of one side meeting every cut of the other.
    """
    same = probing is None
    probing = base if same else probing
    cells = F.slice("cells", F.lit(2), F.greatest(F.size("cells") - 1, F.lit(0))) if same else F.col("cells")
    rest = ["rep", "payload", *carry]
    look = probing.select(*[c if c in probing.columns else F.lit(None).cast(base.schema[c].dataType).alias(c) for c in rest], F.explode(cells).alias("tile"), F.lit(True).alias("looks"), F.lit(False).alias("lies"))
    both = base.select(*rest, F.get("cells", F.lit(0)).alias("tile"), F.lit(same).alias("looks"), F.lit(True).alias("lies")).unionByName(look)
    counts = both.groupBy("tile").agg(F.count_if("lies").alias("ny"), F.count_if("looks").alias("nx"))
    # at most one row for each pivot
    large = counts.where((F.col("ny") > TILE_CLASSES) | (F.col("nx") > TILE_CLASSES)).select("tile", F.ceil(F.col("ny") / TILE_CLASSES).cast("int").alias("_y"), F.ceil(F.col("nx") / TILE_CLASSES).cast("int").alias("_x"))
    cut = both.join(F.broadcast(large), "tile", "left")
    # a class has a place on each side that it is on, and meets every cut of the other side
    h = F.xxhash64("rep")
    own_y, own_x = F.pmod(h, F.greatest("_y", F.lit(1))).cast("int"), F.pmod(h, F.greatest("_x", F.lit(1))).cast("int")
    every_y, every_x = F.sequence(F.lit(0), F.greatest("_y", F.lit(1)) - 1), F.sequence(F.lit(0), F.greatest("_x", F.lit(1)) - 1)
    place = lambda y, x, looks, lies: F.struct(y.alias("cut_y"), x.alias("cut_x"), looks.alias("looks"), lies.alias("lies"))
    no, yes = F.lit(False), F.lit(True)
    lying = F.when(F.col("lies"), F.transform(every_x, lambda x: place(own_y, x, no, yes))).otherwise(F.array().cast("array<struct<cut_y:int,cut_x:int,looks:boolean,lies:boolean>>"))
    looking = F.when(F.col("looks"), F.transform(every_y, lambda y: place(y, own_x, yes, no))).otherwise(F.array().cast("array<struct<cut_y:int,cut_x:int,looks:boolean,lies:boolean>>"))
    single = F.array(place(F.lit(0), F.lit(0), F.col("looks"), F.col("lies")))
    places = F.when(F.col("_y").isNull(), single).otherwise(F.concat(lying, looking))
    return cut.select("tile", *rest, F.explode(places).alias("_p")).select("tile", "_p.*", *rest)


def within_bounds(base: DataFrame, looking: DataFrame, pivots, dim: int) -> tuple[DataFrame, DataFrame]:
    """``base`` and ``looking`` with regions as ``cells``: in ``tiles`` a looking class meets all of base within its ``reach``.

    base: (rep, payload, cells, ...) coded with ``pivots``; looking: (rep, payload, reach, ...),
    reach an angle. The inner and the outer shell of a cell have a least and a greatest
    angle to their pivot. By the triangle inequality a shell is left out if the class is
    further from the pivot than the greatest angle and the reach, or if the class and its
    reach end nearer to its own pivot than the shell's classes are to any.
    """
    if not len(pivots):
        return base.withColumn("cells", F.array(F.lit(0))), looking.withColumn("cells", F.array(F.lit(0)))
    context = base.sparkSession.sparkContext
    held = context.broadcast(pivots.astype("float32"))

    def units(batch):
        """Decoded vectors, and how far their angles may be off."""
        block = Block(None, batch.column(batch.schema.get_field_index("payload")).to_pylist(), dim)
        return block.codes * block.scale[:, None], 1.01 * block.error

    def place(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            cell = batch.column(batch.schema.get_field_index("cells")).to_numpy(zero_copy_only=False)
            cell = np.array([c[0] for c in cell], dtype="int32")
            unit, off = units(batch)
            cosine = (np.einsum("ij,ij->i", unit, held.value[cell]) / np.sqrt(np.einsum("ij,ij->i", unit, unit))).clip(-1, 1)
            angle = np.arccos(cosine)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell * 2 + (cosine < INNER).astype("int32")), pa.array(angle - off), pa.array(angle + off)], names=[*batch.schema.names, "_shell", "_from", "_to"])

    placed = cut_lineage(base.mapInArrow(place, StructType([*base.schema, *StructType.fromDDL("_shell int, _from double, _to double")])))
    # at most two rows for each pivot
    shells = placed.groupBy("_shell").agg(F.count(F.lit(1)).alias("n"), F.min("_from").alias("least"), F.max("_to").alias("most")).collect()
    shells.sort(key=lambda r: (r["_shell"] % 2, r["_shell"]))
    region, number, filled, outer = {}, -1, 0, None
    for r in shells:
        if number < 0 or outer != r["_shell"] % 2 or filled + r["n"] > (TILE_CLASSES if outer else REGION_CLASSES):
            number, filled, outer = number + 1, 0, r["_shell"] % 2
        filled += r["n"]
        region[r["_shell"]] = number
    bounds = context.broadcast([(r["_shell"] // 2, r["least"], r["most"], region[r["_shell"]]) for r in shells])

    def look(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        if not bounds.value:
            return
        cell, least, most, at = (np.array(c) for c in zip(*bounds.value))
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        for batch in batches:
            if not batch.num_rows:
                continue
            unit, off = units(batch)
            unit = (unit / np.sqrt(np.einsum("ij,ij->i", unit, unit))[:, None]).astype("float32")
            reach = batch.column(batch.schema.get_field_index("reach")).to_numpy() + off + ANGLE_SLACK
            cells = []
            for s in range(0, len(unit), STRIP):
                far = np.arccos((unit[s : s + STRIP] @ held.value.T).clip(-1, 1))
                room = reach[s : s + STRIP, None]
                meets = (far[:, cell] - most <= room) & (least - far.min(axis=1)[:, None] <= room)
                cells += [np.flatnonzero(m).astype("int32") for m in np.logical_or.reduceat(meets, starts, axis=1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int32()))], names=[*batch.schema.names, "cells"])

    looking = looking.drop("cells")
    seen = looking.mapInArrow(look, StructType([*looking.schema, *StructType.fromDDL("cells array<int>")]))
    to_region = F.broadcast(base.sparkSession.createDataFrame([(s, n) for s, n in region.items()], "_shell int, _region int"))
    based = placed.join(to_region, "_shell").withColumn("cells", F.array("_region")).select(*base.columns)
    return based, seen


def in_tiles(tiled: DataFrame, work, schema: str, dim: int, carry: Sequence[str] = ()) -> DataFrame:
    """Runs ``work(x_block, y_block) -> dict of columns`` in every tile; blocks have the carried columns as attributes."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(table):
        import numpy as np
        import pyarrow as pa

        blocks = []
        for side in ("looks", "lies"):
            part = table.filter(table.column(side))
            if not part.num_rows:
                return arrow.empty_table()
            block = Block(part.column("rep").to_numpy(), part.column("payload").to_pylist(), dim)
            for c in carry:
                setattr(block, c, part.column(c).to_numpy())
            blocks.append(block)
        return pa.table([pa.array(np.asarray(v), t) if not isinstance(v, pa.Array) else v for v, t in zip(work(*blocks).values(), arrow.types)], schema=arrow)

    return tiled.groupBy("tile", "cut_y", "cut_x").applyInArrow(run, schema)


def usable(vector: str, dim: int):
    """Whether the vector has ``dim`` finite values that are not all zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return F.coalesce(F.when(F.size(v) == dim, finite & F.exists(v, lambda e: e != 0)), F.lit(False))


def exact_cosines(pairs: DataFrame, vectors: DataFrame, dim: int, right: DataFrame | None = None) -> DataFrame:
    """Adds ``cosine``, in doubles from the stored floats, to pairs (a, b, ...) of ids.

    vectors: (id, v) of both sides, or of a alone if b has its own in ``right``; an id's
    first usable vector counts. ``pairs`` should be written rows, as they are read thrice.
    """
    others = [c for c in pairs.columns if c not in ("a", "b")]

    def one(ids: DataFrame, rows: DataFrame) -> DataFrame:
        needed = ids.distinct()
        if needed.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
            needed = F.broadcast(needed)
        return rows.join(needed, "id", "left_semi").where(usable("v", dim)).groupBy("id").agg(F.first("v").alias("v"))

    if right is None:
        va = vb = one(pairs.select(F.explode(F.array("a", "b")).alias("id")), vectors)
    else:
        va, vb = one(pairs.select(F.col("a").alias("id")), vectors), one(pairs.select(F.col("b").alias("id")), right)
    left = pairs.join(va.select(F.col("id").alias("a"), F.col("v").alias("va")), "a")
    both = left.join(vb.select(F.col("id").alias("b"), F.col("v").alias("vb")), "b").select("a", "b", *others, "va", "vb")
    schema = both.drop("va", "vb").schema.add("cosine", "double")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            va, vb = (normalised(unpack_lists(batch.column(batch.schema.get_field_index(c)), dim)[1]) for c in ("va", "vb"))
            keep = [c for c in batch.schema.names if c not in ("va", "vb")]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in keep] + [pa.array(np.einsum("ij,ij->i", va, vb))], names=[*keep, "cosine"])

    return both.mapInArrow(run, schema)
