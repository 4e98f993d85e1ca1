"""The elements of the arrays of one JSON document, found by many tasks.

The document is read as pieces that end with a closing brace. As strings may hold braces, a
task has to know whether its first piece begins inside a string, and how deep it is nested:
quotes are counted first, then braces; what each task leaves open is joined on the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ESCAPE, _STRING = re.compile(r"\\.", re.S), re.compile(r'"[^"]*"')
_TOKEN, _REST = re.compile(r'"((?:[^"\\]|\\.)*)("|$)|[\[\]{}]', re.S), re.compile(r'(?:[^"\\]|\\.)*("|$)', re.S)
_SPACE = " \t\r\n,"


def splittable(spark: SparkSession, path: str) -> bool:
    """Whether the path is a file that begins and ends as a JSON object in UTF-8."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(place) or not files.getFileStatus(place).isFile():
        return False
    size = files.getFileStatus(place).getLen()
    stream = files.open(place)
    try:
        head = bytes(stream.readNBytes(64))
        stream.seek(max(0, size - 64))
        tail = bytes(stream.readNBytes(64))
    finally:
        stream.close()
    return head.lstrip().startswith(b"{") and tail.rstrip().endswith(b"}") and b"\0" not in head and size > 2


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str]]:
    """The pieces of a task, each with the place in the file at which the task's part begins."""
    block = None
    for batch in batches:
        if block is None and batch.num_rows:
            block = batch.column(1)[0].as_py()
        for value in batch.column(0).to_pylist():
            yield block, value


def _levels(inside: dict[int, bool]):
    """For each task: whether quotes are odd, and by how much it nests deeper, if it begins inside a string or not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, odd, deeper, within = None, False, 0, False
        for block_, piece in _pieces(batches):
            if block is None:
                block, within = block_, inside.get(block_, False)
                begun = within
            within, flat = _flat(piece, within)
            deeper += flat.count("{") + flat.count("[") - flat.count("]") - (not within)
        if block is not None:
            odd = within != begun
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "odd": [odd], "deeper": pa.array([deeper], pa.int64())})

    return run


def _flat(piece: str, within: bool) -> tuple[bool, str]:
    """Whether the piece ends inside a string, and what it has outside of strings."""
    s = _ESCAPE.sub("", piece) if "\\" in piece else piece
    if within:
        s = '"' + s
    within = s.count('"') % 2 == 1
    return within, _STRING.sub("", s + '"' if within else s)


def _split(begin: dict[int, tuple[bool, int, str | None]], wanted: tuple[str, ...], offsets: dict[int, list[int]] | None):
    """Without ``offsets`` one row for each task (key, counts of elements, open ends), else the elements themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, counts, head, buffer, key, known = None, dict.fromkeys(["", *wanted], 0), [], None, "", False
        out: list[tuple[str, int, str]] = []

        def found(text: str) -> None:
            part = key if known else first
            if part is not None and part not in counts:
                return
            k = part or ""
            if offsets is not None and k:
                out.append((k, offsets[block][wanted.index(k)] + counts[k], text))
            counts[k] += 1

        closed = True
        for block_, piece in _pieces(batches):
            if block is None:
                block = block_
                within, depth, first = begin[block]
                known, closed = depth < 2, depth <= 2
            ended, flat = _flat(piece, within)
            if depth == 2 and not within and not ended and flat.count("{") == 1 and flat.count("[") == flat.count("]") and flat.lstrip(_SPACE).startswith("{"):
                found(piece.lstrip(_SPACE) + "}")
            else:
                text, at, since = piece if ended else piece + "}", 0, 0
                if ended:
                    text = piece + "}"  # the brace is part of the string
                if within:
                    m = _REST.match(text)
                    at = m.end()
                for m in _TOKEN.finditer(text, at):
                    c = m.group()
                    if c[0] == '"':
                        if depth == 1:
                            last = m.group(1)
                    elif c in "{[":
                        if depth == 1:
                            key, known = (last if c == "[" else "\0object"), True
                        if depth == 2 and c == "{":
                            buffer, since = [], m.start()
                        depth += 1
                    else:
                        depth -= 1
                        if depth == 2 and c == "}":
                            if not closed:
                                head.append(text[: m.end()])
                                closed = True
                            elif buffer is not None:
                                found("".join(buffer) + text[since : m.end()])
                            buffer, since = None, m.end()
                        elif depth == 2 and not closed:
                            closed, head = True, []
                if not closed:
                    head.append(text)
                elif buffer is not None:
                    buffer.append(text[since:])
            within = ended
            if len(out) >= 5000:
                yield _rows(out)
                out = []
        if offsets is not None:
            yield _rows(out)
        elif block is not None:
            row = {"block": block, "key": key if known else None, "counts": [counts[k] for k in ["", *wanted]], "head": "".join(head), "closed": closed, "tail": None if buffer is None else "".join(buffer)}
            yield pa.RecordBatch.from_pylist([row], pa.schema([("block", pa.int64()), ("key", pa.string()), ("counts", pa.list_(pa.int64())), ("head", pa.string()), ("closed", pa.bool_()), ("tail", pa.string())]))

    return run


def _rows(out: list[tuple[str, int, str]]) -> pa.RecordBatch:
    part, order, text = zip(*out) if out else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array(order, pa.int64()), pa.array(text, pa.string())], names=["part", "ord", "text"])


def elements(spark: SparkSession, path: str, wanted: tuple[str, ...]) -> DataFrame:
    """(part, ord, text): the objects in the arrays of these names at the top of the document, with their place in the array.

    Raises ValueError when braces don't match.
    """
    pieces = spark.read.option("lineSep", "}").text(path).select("value", F.col("_metadata.file_block_start").alias("block"))
    inside: dict[int, bool] = {}
    while True:
        levels = sorted(pieces.mapInArrow(_levels(inside), "block long, odd boolean, deeper long").collect())
        begun, within = {}, False
        for block, odd, _ in levels:
            begun[block] = within
            within ^= odd
        if all(begun[b] == inside.get(b, False) for b in begun):
            break
        inside = begun
    begin, depth = {}, 0
    for block, _, deeper in levels:
        begin[block] = (begun[block], depth, None)
        depth += deeper
    # after the last brace only blanks may follow, which count as a piece if there are any
    if within or depth not in (0, -1):
        raise ValueError(f"{path} is no whole JSON document")
    parts = sorted(pieces.mapInArrow(_split(begin, wanted, None), "block long, key string, counts array<long>, head string, closed boolean, tail string").collect())
    done, offsets, whole, key, open_text = dict.fromkeys(wanted, 0), {}, [], None, None
    for p in parts:
        begin[p["block"]] = (*begin[p["block"]][:2], key)
        if open_text is not None:
            open_text += p["head"]
            if p["closed"]:
                if key in done:
                    whole.append((key, done[key], open_text))
                    done[key] += 1
                open_text = None
        offsets[p["block"]] = [done[k] for k in wanted]
        if key in done:
            done[key] += p["counts"][0]
        for k, n in zip(wanted, p["counts"][1:]):
            done[k] += n
        if p["key"] is not None:
            key = p["key"]
        if p["tail"] is not None:
            open_text = p["tail"]
    found = pieces.mapInArrow(_split(begin, wanted, offsets), "part string, ord long, text string")
    return found.unionByName(spark.createDataFrame(whole, "part string, ord long, text string")) if whole else found
