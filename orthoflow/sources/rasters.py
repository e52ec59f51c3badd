"""Rasters in Parquet and in TIFF files, plain or compressed."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fields of a TIFF directory that are needed here.
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, ROWS_PER_STRIP, STRIP_BYTES = 256, 257, 258, 259, 273, 278, 279
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, FORMAT = 322, 323, 324, 325, 339
PIXEL_SCALE, TIE_POINT = 33550, 33922
SAMPLES, PLANES, PREDICTOR = 277, 284, 317
KINDS = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 11: "f", 12: "d"}


def read_pixels(spark: SparkSession, path: str, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Pixels (r, c, v and more) from Parquet; a window of first and last row and column reaches the scan."""
    df = spark.read.parquet(path)
    if window:
        r0, r1, c0, c1 = window
        df = df.where(F.col("r").between(r0, r1) & F.col("c").between(c0, c1))
    return df


def write_pixels(df: DataFrame, path: str, value: str = "v", keys: tuple[str, ...] = (), mode: str = "errorifexists") -> None:
    """Writes pixels, masked ones as 0, in files sorted by place so that windows are pruned."""
    out = df.withColumn(value, F.coalesce(F.col(value), F.lit(0)))
    out.repartitionByRange(*keys, "r", "c").sortWithinPartitions(*keys, "r", "c").write.mode(mode).parquet(path)


def directory(data: bytes) -> tuple[str, dict[int, tuple]]:
    """Byte order and fields of the first directory of a TIFF file."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    at = struct.unpack(order + "I", data[4:8])[0]
    fields = {}
    for i in range(struct.unpack(order + "H", data[at : at + 2])[0]):
        tag, kind, n = struct.unpack(order + "HHI", data[at + 2 + 12 * i : at + 10 + 12 * i])
        if kind not in KINDS:
            continue
        form = order + KINDS[kind] * n if kind != 2 else f"{n}s"
        size = struct.calcsize(form)
        begin = at + 10 + 12 * i if size <= 4 else struct.unpack(order + "I", data[at + 10 + 12 * i : at + 14 + 12 * i])[0]
        fields[tag] = struct.unpack(form, data[begin : begin + size])
    return order, fields


def unpacked_lzw(data: bytes) -> bytes:
    """What a TIFF's LZW stream holds: codes of 9 to 12 bits, the highest bit first, 256 to start anew and 257 to end."""
    out, table, width, held, n = bytearray(), [], 9, 0, 0
    before = b""
    for byte in data:
        held, n = held << 8 | byte, n + 8
        if n < width:
            continue
        n -= width
        code, held = held >> n, held & ((1 << n) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, before = [bytes([k]) for k in range(256)] + [b"", b""], 9, b""
            continue
        now = table[code] if code < len(table) else before + before[:1]
        out += now
        if before:
            table.append(before + now[:1])
        before = now
        width = 9 + (len(table) >= 511) + (len(table) >= 1023) + (len(table) >= 2047)
    return bytes(out)


def unpacked_bits(data: bytes) -> bytes:
    """What a run-length stream (PackBits) holds."""
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at] - 256 if data[at] > 127 else data[at]
        if n >= 0:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        elif n > -128:
            out += data[at + 1 : at + 2] * (1 - n)
            at += 2
        else:
            at += 1
    return bytes(out)


#: Ways to unpack a strip or tile, by TIFF's number of the compression.
UNPACK = {1: bytes, 5: unpacked_lzw, 8: zlib.decompress, 32773: unpacked_bits, 32946: zlib.decompress}


def decode(data: bytes, window: tuple[int, int, int, int] | None = None) -> np.ndarray:
    """The first band of a TIFF file, in strips or tiles; or the first and last row and column of window.

    Only the strips or tiles that the window touches are unpacked. Bands must be
    one by one (planes of their own, or a single band).
    """
    order, f = directory(data)
    packing, predictor = f.get(COMPRESSION, (1,))[0], f.get(PREDICTOR, (1,))[0]
    if packing not in UNPACK or predictor not in (1, 2):
        raise ValueError(f"compression {packing} with predictor {predictor} is not supported")
    if f.get(SAMPLES, (1,))[0] > 1 and f.get(PLANES, (1,))[0] == 1:
        raise ValueError("interleaved bands are not supported")
    rows, cols = f[HEIGHT][0], f[WIDTH][0]
    r0, r1, c0, c1 = window or (0, rows - 1, 0, cols - 1)
    r0, r1, c0, c1 = max(r0, 0), min(r1, rows - 1), max(c0, 0), min(c1, cols - 1)
    kind = {1: "u", 2: "i", 3: "f"}[f.get(FORMAT, (1,))[0]]
    dtype = np.dtype(f"{order}{kind}{f[BITS][0] // 8}")
    out = np.zeros((max(0, r1 - r0 + 1), max(0, c1 - c0 + 1)), dtype)
    tiled = TILES in f
    h, w = (f[TILE_HEIGHT][0], f[TILE_WIDTH][0]) if tiled else (min(rows, f.get(ROWS_PER_STRIP, (rows,))[0]), cols)
    across = -(-cols // w)
    begins, sizes = (f[TILES], f.get(TILE_BYTES)) if tiled else (f[STRIPS], f.get(STRIP_BYTES))
    for i in range(min(len(begins), across * -(-rows // h))):
        r, c = i // across * h, i % across * w
        if r > r1 or r + h <= r0 or c > c1 or c + w <= c0:
            continue
        n = h if tiled else min(h, rows - r)
        size = sizes[i] if sizes else n * w * dtype.itemsize
        part = np.frombuffer(UNPACK[packing](data[begins[i] : begins[i] + size]), dtype, n * w).reshape(n, w)
        if predictor == 2:
            part = np.cumsum(part, axis=1, dtype=dtype.newbyteorder("="))
        top, left = max(r, r0), max(c, c0)
        part = part[top - r : r1 + 1 - r, left - c : c1 + 1 - c]
        out[top - r0 : top - r0 + part.shape[0], left - c0 : left - c0 + part.shape[1]] = part
    return out


def encode(band: np.ndarray, geotransform: tuple[float, ...] | None = None, compress: bool = False) -> bytes:
    """A band as a TIFF file of one strip, plain or deflated, with the scale and tie point of a geotransform."""
    band = np.ascontiguousarray(band).astype(band.dtype.newbyteorder("<"))
    kind = {"u": 1, "i": 2, "f": 3}[band.dtype.kind]
    rows, cols = band.shape
    body = zlib.compress(band.tobytes()) if compress else band.tobytes()
    fields: list[tuple[int, str, tuple]] = [
        (WIDTH, "I", (cols,)), (HEIGHT, "I", (rows,)), (BITS, "H", (band.dtype.itemsize * 8,)), (COMPRESSION, "H", (8 if compress else 1,)), (262, "H", (1,)),
        (STRIPS, "I", (0,)), (277, "H", (1,)), (ROWS_PER_STRIP, "I", (rows,)), (STRIP_BYTES, "I", (len(body),)), (FORMAT, "H", (kind,)),
    ]
    if geotransform:
        ulx, xres, _, uly, _, yres = geotransform
        fields += [(PIXEL_SCALE, "d", (xres, -yres, 0.0)), (TIE_POINT, "d", (0.0, 0.0, 0.0, ulx, uly, 0.0))]
    codes = {"H": 3, "I": 4, "d": 12}
    end = 8 + 2 + 12 * len(fields) + 4
    extra, entries = b"", b""
    extra_size = sum(8 * len(v) for _, k, v in fields if k == "d")
    for tag, form, values in sorted(fields):
        if tag == STRIPS:
            values = (end + extra_size,)
        raw = struct.pack("<" + form * len(values), *values)
        if len(raw) > 4:
            place = struct.pack("<I", end + len(extra))
            extra += raw
        else:
            place = raw.ljust(4, b"\0")
        entries += struct.pack("<HHI", tag, codes[form], len(values)) + place
    return b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(fields)) + entries + b"\0\0\0\0" + extra + body


def tiff_files(spark: SparkSession, path: str) -> DataFrame:
    """path and content of TIFF files, through Spark's own file access."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def tiff_info(files: DataFrame) -> DataFrame:
    """path, rows, cols, tiled and the geotransform (null without one) of files (path, content)."""
    import pandas as pd

    def info(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, content in zip(batch["path"], batch["content"]):
                _, f = directory(content)
                scale, tie = f.get(PIXEL_SCALE), f.get(TIE_POINT)
                gt = [tie[3], scale[0], 0.0, tie[4], 0.0, -scale[1]] if scale and tie else None
                out.append((name, f[HEIGHT][0], f[WIDTH][0], TILES in f, gt))
            yield pd.DataFrame(out, columns=["path", "rows", "cols", "tiled", "geotransform"])

    return files.select("path", "content").mapInPandas(info, "path string, rows int, cols int, tiled boolean, geotransform array<double>")


def georeference(rasters: DataFrame, reference: DataFrame) -> DataFrame:
    """Metadata rows of rasters with the geotransform and projection of their reference (key ref)."""
    own = rasters.drop("geotransform", "srs_wkt")
    return own.join(reference.select(F.col("raster").alias("ref"), "geotransform", "srs_wkt"), "ref", "left")


def read_tiff(files: DataFrame, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Pixels path, r, c, v (double) of files (path, content), or those of a window of first and last row and column."""
    import pandas as pd

    def pixels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                band = decode(content, window)
                r0, c0 = (max(window[0], 0), max(window[2], 0)) if window else (0, 0)
                for r in range(0, band.shape[0], 256):
                    part = band[r : r + 256]
                    yield pd.DataFrame({
                        "path": name, "r": np.repeat(np.arange(r0 + r, r0 + r + len(part), dtype=np.int32), part.shape[1]),
                        "c": np.tile(np.arange(c0, c0 + part.shape[1], dtype=np.int32), len(part)), "v": part.ravel().astype(float),
                    })

    return files.select("path", "content").mapInPandas(pixels, "path string, r int, c int, v double")


def blocks(pixels: DataFrame, size: int, halo: int = 0) -> DataFrame:
    """pixels (r, c and more) in blocks of size by size cells with a halo: block_r, block_c, own, and the cell's br, bc in the block.

    A cell has a row for each block that it lies in or within the halo of; own is
    true in its own block. br and bc are counted from the halo's corner. Blocks
    beyond the last cells hold halo cells only.
    """
    reach = lambda x: F.sequence(
        F.greatest(F.floor((F.col(x) - halo) / size), F.lit(0)).cast("int"), F.floor((F.col(x) + halo) / size).cast("int")
    )
    out = pixels.withColumn("block_r", F.explode(reach("r"))).withColumn("block_c", F.explode(reach("c")))
    own = (F.floor(F.col("r") / size) == F.col("block_r")) & (F.floor(F.col("c") / size) == F.col("block_c"))
    return out.withColumns({"own": own, "br": F.col("r") - F.col("block_r") * size + halo, "bc": F.col("c") - F.col("block_c") * size + halo})


def from_blocks(done: DataFrame, size: int, halo: int = 0) -> DataFrame:
    """Results by block (block_r, block_c, br, bc and more) on the whole grid, without the halo's cells: r, c and more."""
    inside = lambda x: F.col(x).between(halo, halo + size - 1)
    place = {"r": F.col("block_r") * size + F.col("br") - halo, "c": F.col("block_c") * size + F.col("bc") - halo}
    return done.where(inside("br") & inside("bc")).withColumns({k: v.cast("int") for k, v in place.items()}).drop("block_r", "block_c", "br", "bc")


def layer_values(raw: DataFrame, resolution: float, step: float) -> DataFrame:
    """Displacements in map units: the raw value times resolution and step."""
    return raw.withColumn("v", F.col("v") * F.lit(resolution * step))


def as_tiff(df: DataFrame, rows: int, cols: int, key: str, dtype: str = "float32", geotransform: tuple[float, ...] | None = None, compress: bool = False) -> DataFrame:
    """A file for each key of pixels (key, r, c, v): key, content. Masked cells are 0; a raster fits one task."""
    import pandas as pd

    kind = "long" if dict(df.dtypes)[key] in ("bigint", "int") else "string"

    def build(group: pd.DataFrame) -> pd.DataFrame:
        band = np.zeros((rows, cols), dtype)
        band[group["r"], group["c"]] = group["v"].fillna(0)
        return pd.DataFrame({key: [group[key].iloc[0]], "content": [encode(band, geotransform, compress)]})

    return df.select(F.col(key).cast(kind).alias(key), "r", "c", "v").groupBy(key).applyInPandas(build, f"{key} {kind}, content binary")
