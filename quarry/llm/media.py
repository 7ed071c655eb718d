"""Media columns: Netpbm and BMP pictures decoded to numpy arrays, resized by area with integral
images, and kept as NPY tiles with difference hashes.

Texts can be stored as media too: their UTF-8 bytes, padded with zero bytes to whole rows of 64,
are the 8-bit samples of a grey Netpbm picture (P5), from which they are read back without loss.
"""

from __future__ import annotations

import io
import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import slices

WIDTH = 64
TILE = 16
HASH_ROWS, HASH_COLUMNS = 8, 9
#: Rows of a picture that are summed at once.
ROWS_AT_ONCE = 1 << 14


def payload_of(text: bytes | None) -> bytes:
    """The text's bytes, with zero bytes up to a positive multiple of 64."""
    data = text or b""
    return data + bytes(-len(data) % WIDTH or WIDTH * (not data))


def to_pgm(samples: bytes, width: int = WIDTH) -> bytes:
    """Whole rows of 8-bit samples as a grey Netpbm file."""
    return b"P5\n%d %d\n255\n" % (width, len(samples) // width) + samples


def to_bmp(image: np.ndarray) -> bytes:
    """A grey (H, W) or colour (H, W, 3) array as an uncompressed BMP file."""
    height, width = image.shape[:2]
    grey = image.ndim == 2
    palette = b"".join(bytes((i, i, i, 0)) for i in range(256)) if grey else b""
    row = width * (1 if grey else 3)
    pixels = image if grey else image[:, :, ::-1]
    body = np.zeros((height, row + -row % 4), np.uint8)
    body[:, :row] = pixels.reshape(height, row)[::-1]
    start = 54 + len(palette)
    head = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", start + body.size, 0, 0, start, 40, width, height, 1, 8 if grey else 24, 0, body.size, 2835, 2835, 256 if grey else 0, 0)
    return head + palette + body.tobytes()


def decode(data: bytes) -> np.ndarray:
    """A Netpbm (P1 to P6, 8 or 16 bits) or BMP (8, 24 or 32 bits, uncompressed) file as a uint8 array.
    ValueError (struct.error for a cut header) where it is none, holds less than its header says, or
    samples beyond its greatest value or palette."""
    if data[:2] == b"BM":
        return _decode_bmp(data)
    if re.match(rb"P[1-6]\s", data):
        return _decode_netpbm(data)
    raise ValueError("neither Netpbm nor BMP")


def _decode_netpbm(data: bytes) -> np.ndarray:
    kind, at, numbers = data[1] - 48, 2, []
    field = re.compile(rb"(?:\s|#[^\n]*\n)*(\d+)")
    while len(numbers) < (2 if kind in (1, 4) else 3):
        found = field.match(data, at)
        if not found:
            raise ValueError("truncated Netpbm header")
        if len(found[1].lstrip(b"0")) > 18:
            raise ValueError("no size of a picture")
        numbers.append(int(found[1]))
        at = found.end()
    width, height, top = numbers[0], numbers[1], numbers[2] if len(numbers) > 2 else 1
    if not 0 < top < 1 << 16:
        raise ValueError("greatest value beyond 16 bits")
    shape = (height, width, 3) if kind in (3, 6) else (height, width)
    count = height * width * (3 if kind in (3, 6) else 1)
    if count > 8 * len(data) or max(width, height) > 1 << 40:
        raise ValueError("header larger than the data")
    if kind == 1:
        digits = np.frombuffer(re.sub(rb"\s|#[^\n]*\n?", b"", data[at:]), np.uint8)[:count]
        if ((digits != 48) & (digits != 49)).any():
            raise ValueError("bits other than 0 and 1")
        return ((digits == 48) * 255).astype(np.uint8).reshape(shape)
    if kind in (2, 3):
        words = re.sub(rb"#[^\n]*\n?", b" ", data[at:]).split()[:count]
        if any(len(w) > 9 or not w.isdigit() for w in words):
            raise ValueError("samples that are no numbers")
        samples = np.array(words, np.int64)
    elif kind == 4:
        bits = np.unpackbits(np.frombuffer(data, np.uint8, height * -(-width // 8), at + 1).reshape(height, -1), axis=1)
        return ((1 - bits[:, :width]) * 255).astype(np.uint8)
    else:
        samples = np.frombuffer(data, ">u2" if top > 255 else np.uint8, count, at + 1)
    if count and top not in (255, 65535) and samples.max() > top or kind in (2, 3) and count and samples.max() > top:
        raise ValueError("samples beyond the greatest value")
    if top != 255:
        samples = (samples.astype(np.int64) * 255 + top // 2) // top
    return samples.astype(np.uint8).reshape(shape)


def _decode_bmp(data: bytes) -> np.ndarray:
    start, size, width, height = struct.unpack_from("<IIii", data, 10)
    bits, packed = struct.unpack_from("<HI", data, 28)
    if packed or bits not in (8, 24, 32):
        raise ValueError("only uncompressed BMP of 8, 24 or 32 bits")
    rows, each = abs(height), bits // 8
    if width < 0:
        raise ValueError("negative width")
    stride = (width * each + 3) // 4 * 4
    body = np.frombuffer(data, np.uint8, rows * stride, start).reshape(rows, stride)[:, : width * each]
    body = body[::-1] if height > 0 else body
    if bits == 8:
        colours = struct.unpack_from("<I", data, 46)[0] or 256
        palette = np.frombuffer(data, np.uint8, 4 * colours, 14 + size).reshape(-1, 4)[:, 2::-1]
        if body.size and body.max() >= colours:
            raise ValueError("indices beyond the palette")
        image = palette[body]
        return image[:, :, 0] if (palette == palette[:, :1]).all() else image
    return body.reshape(rows, width, each)[:, :, 2::-1]


def _integral_at(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Rows of the integral image (sums of all rows before) at ascending places from 0 on, from blocks of
    rows, so that only one block is held as floating numbers."""
    out = np.zeros((len(places), *data.shape[1:]))
    total, done = 0.0, 1
    for at in range(0, len(data), ROWS_AT_ONCE):
        sums = np.cumsum(data[at : at + ROWS_AT_ONCE], axis=0, dtype=np.float64)
        if at:
            sums += total
        total = sums[-1]
        upto = int(np.searchsorted(places, at + len(sums), side="right"))
        out[done:upto] = sums[places[done:upto] - at - 1]
        done = upto
    return out


@lru_cache(maxsize=4096)
def _borders(length: int, sizes: tuple[int, ...]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Where the integral is needed to cut ``length`` rows into each number of equal areas: all places,
    and for each number the index below and above every border and its fraction between them."""
    found = []
    for size in sizes:
        at = np.arange(size + 1) * (length / size)
        whole = np.minimum(at.astype(np.int64), length)
        found.append((whole, np.minimum(whole + 1, length), at - whole))
    places = np.unique(np.concatenate([[0], *(x for low, high, _ in found for x in (low, high))]))
    return places, [(np.searchsorted(places, low), np.searchsorted(places, high), part) for low, high, part in found]


def _means(data: np.ndarray, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """Area means of the rows for each number of target rows, from one integral."""
    places, cuts = _borders(len(data), sizes)
    sums = _integral_at(data, places)
    out = []
    for size, (low, high, part) in zip(sizes, cuts, strict=True):
        edges = sums[low] + (sums[high] - sums[low]) * part.reshape(-1, *(1 for _ in data.shape[1:]))
        out.append((edges[1:] - edges[:-1]) / (len(data) / size))
    return out


def area_resizes(image: np.ndarray, targets: list[tuple[int, int]]) -> list[np.ndarray]:
    """Mean of the area that each target pixel covers, from the integral image (interpolated at
    fractional borders, so the area weights are exact), for several (height, width).  Works for
    enlarging too.  The whole picture is summed once for all of them."""
    out = []
    for (_, width), rows in zip(targets, _means(image, tuple(h for h, _ in targets)), strict=True):
        columns = _means(np.swapaxes(rows, 0, 1), (width,))[0]
        out.append(np.clip(np.rint(np.swapaxes(columns, 0, 1)), 0, 255).astype(np.uint8))
    return out


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    return area_resizes(image, [(height, width)])[0]


def grey(image: np.ndarray) -> np.ndarray:
    if image.ndim == 2:
        return image
    out = np.empty(image.shape[:2], np.uint8)
    for at in range(0, len(image), ROWS_AT_ONCE):
        out[at : at + ROWS_AT_ONCE] = np.rint(image[at : at + ROWS_AT_ONCE] @ np.array([0.299, 0.587, 0.114]))
    return out


def features(image: np.ndarray, tile: int) -> tuple[bytes, str]:
    """The NPY tile of ``tile`` x ``tile`` grey samples, and the difference hash."""
    made, small = area_resizes(grey(image), [(tile, tile), (HASH_ROWS, HASH_COLUMNS)])
    return npy(made), _hash_of(small)


def difference_hash(image: np.ndarray) -> str:
    """64 bits: is each cell of an 8 x 9 reduction darker than its right neighbour."""
    return _hash_of(area_resize(grey(image), HASH_ROWS, HASH_COLUMNS))


def _hash_of(small: np.ndarray) -> str:
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    return out.getvalue()


def tiles(media: DataFrame, tile: int = TILE) -> DataFrame:
    """Add to (doc_id, n_bytes, media binary) the columns samples (the decoded bytes), tile (an NPY file of
    ``tile`` x ``tile`` grey samples) and dhash.  Null or unreadable media give nulls; a picture
    without pixels gives empty samples and null features; other columns are ignored."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 2):
                samples, made, hashes = [], [], []
                for data in part.column(2).to_pylist():
                    try:
                        image = decode(data)
                    except (ValueError, TypeError, struct.error):  # no picture, null, or a cut header
                        image = None
                    samples.append(None if image is None else image.tobytes())
                    usable = image is not None and image.size > 0
                    found = features(image, tile) if usable else (None, None)
                    made.append(found[0]), hashes.append(found[1])
                columns = [*part.columns, pa.array(samples, pa.binary()), pa.array(made, pa.binary()), pa.array(hashes, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "media", "samples", "tile", "dhash"])

    kind = media.schema["doc_id"].dataType.simpleString()
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id {kind}, n_bytes bigint, media binary, samples binary, tile binary, dhash string")


def store_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text as a grey Netpbm file; a null text counts as empty.
    Built-in functions only: the header is written in front of the padded bytes."""
    data = F.coalesce(F.col("text").cast("binary"), F.lit(b"").cast("binary"))
    n = F.octet_length(data)
    rows = F.greatest(F.ceil(n / WIDTH), F.lit(1)).cast("bigint")
    padding = F.repeat(F.lit("\0"), (rows * WIDTH - n).cast("int")).cast("binary")
    head = F.format_string(f"P5\n{WIDTH} %d\n255\n", rows).cast("binary")
    return docs.select("doc_id", n.cast("bigint").alias("n_bytes"), F.concat(head, data, padding).alias("media"))
