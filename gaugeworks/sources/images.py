"""Image bytes to RGB pixels. PNG and bitmaps are decoded here; other formats need Pillow."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame

#: First bytes of the formats.
PNG, BMP = b"\x89PNG\r\n\x1a\n", b"BM"
#: Samples of a pixel by PNG colour type.
PNG_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def decode_rgb(content: bytes):
    """An array of rows, columns and the three values of a pixel. Raises ValueError for bytes that are no readable image."""
    try:
        if content[:8] == PNG:
            return _png(content)
        if content[:2] == BMP:
            return _bitmap(content)
    except (struct.error, zlib.error, IndexError, KeyError, TypeError) as e:
        raise ValueError(f"broken image: {e}") from e
    return _by_pillow(content)


def _by_pillow(content: bytes):
    import io

    import numpy as np

    try:
        from PIL import Image
    except ImportError as e:
        raise ValueError("only PNG and bitmaps are read without Pillow") from e
    try:
        with Image.open(io.BytesIO(content)) as image:
            return np.asarray(image.convert("RGB"))
    except OSError as e:
        raise ValueError(f"broken image: {e}") from e


def _png(content: bytes):
    """Non-interlaced images of 8 bits a sample; others go to Pillow. Transparency is dropped."""
    import numpy as np

    at, parts, palette = 8, [], None
    while at < len(content):
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        body = content[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", body)
            if depth != 8 or interlaced:
                return _by_pillow(content)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, dtype="uint8").reshape(-1, 3)
        elif kind == b"IDAT":
            parts.append(body)
        at += size + 12
    channels = PNG_CHANNELS[colour]
    rows = np.frombuffer(zlib.decompress(b"".join(parts)), dtype="uint8").reshape(height, 1 + width * channels)
    pixels = np.zeros((height, width * channels), dtype="uint8")
    above = np.zeros(width * channels, dtype="uint8")
    for y in range(height):
        above = pixels[y] = _unfiltered(int(rows[y, 0]), rows[y, 1:], above, channels)
    pixels = pixels.reshape(height, width, channels)
    if colour == 3:
        return palette[pixels[:, :, 0]]
    return np.repeat(pixels[:, :, :1], 3, axis=2) if channels < 3 else pixels[:, :, :3].copy()


def _unfiltered(kind: int, line, above, step: int):
    """One line without its prediction: 0 none, 1 left, 2 above, 3 their mean, 4 the one of left, above and corner nearest to left + above - corner."""
    import numpy as np

    if kind == 0:
        return line
    if kind == 2:
        return line + above
    if kind == 1:
        return np.cumsum(line.reshape(-1, step), axis=0, dtype="uint8").reshape(-1)
    out = [0] * len(line)
    for i, v in enumerate(line.tolist()):
        left, up, corner = (out[i - step], int(above[i]), int(above[i - step])) if i >= step else (0, int(above[i]), 0)
        if kind == 3:
            guess = (left + up) // 2
        else:
            guess = min((left, up, corner), key=lambda c: abs(left + up - corner - c))
        out[i] = (v + guess) & 255
    return np.array(out, dtype="uint8")


def _bitmap(content: bytes):
    """Uncompressed bitmaps of 24 or 32 bits; others go to Pillow."""
    import numpy as np

    start = struct.unpack("<I", content[10:14])[0]
    width, height, _, bits, packed = struct.unpack("<iiHHI", content[18:34])
    if bits not in (24, 32) or packed:
        return _by_pillow(content)
    line = (width * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(content, dtype="uint8", count=line * abs(height), offset=start).reshape(abs(height), line)
    pixels = rows[:, : width * bits // 8].reshape(abs(height), width, bits // 8)[:, :, 2::-1]
    return pixels[::-1].copy() if height > 0 else pixels.copy()


def decoded(files: DataFrame) -> DataFrame:
    """(image_id, file_name, width, height, rgb, error) from (image_id, file_name, content): pixels row by row, three bytes each.

    An image that cannot be read has nulls and the reason.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for i, name, content in zip(*(batch.column(c).to_pylist() for c in range(3))):
                try:
                    pixels, error = decode_rgb(content or b""), None
                except ValueError as e:
                    pixels, error = None, str(e)
                known = pixels is not None
                row = [[i], [name], [pixels.shape[1] if known else None], [pixels.shape[0] if known else None], [pixels.tobytes() if known else None], [error]]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.string()))], names=["image_id", "file_name", "width", "height", "rgb", "error"])

    return files.select("image_id", "file_name", "content").mapInArrow(run, "image_id long, file_name string, width int, height int, rgb binary, error string")
