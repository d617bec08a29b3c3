"""File formats without a geodata library. Rasters: ASCII grid, GeoTIFF (strips, uncompressed or deflate), and a folder of Parquet cells.
Features: GeoJSON (a collection, or a feature per line), GeoPackage, shapefile, and a folder of Parquet.

Headers are read on the driver through Spark's file readers, so any store that Spark knows will do; values are decoded by executors.
"""

from __future__ import annotations

import json
import os
import re
import sqlite3
import struct
import tempfile
import zlib
from dataclasses import dataclass
from pathlib import PurePosixPath

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import crs as crs_
from ..functions import geometry as geo
from ..plans.block import setting


def safe_path(url: str, root: str = "/", strict: bool = False) -> str:
    """An absolute path of a file:// URL or path, relative ones under root; with strict, outside of root is an IOError."""
    scheme, sep, rest = url.partition("://")
    if sep and scheme != "file":
        raise NotImplementedError(f"{scheme} files can't be reached here")
    path = os.path.abspath(os.path.join(root, rest if sep else url))
    if strict and os.path.commonpath([os.path.abspath(root), path]) != os.path.abspath(root):
        raise IOError(f"{path} is outside of {root}")
    return path


def allowed(url: str) -> str:
    """The URL itself; with cellframe.strict-file-paths, one outside of cellframe.root is an IOError."""
    spark = _session()
    if setting(spark, "strict-file-paths").lower() == "true":
        safe_path(url, setting(spark, "root"), strict=True)
    return url


def _session() -> SparkSession:
    found = SparkSession.getActiveSession()
    if found is None:
        raise RuntimeError("file sources need a running session")
    return found


def _bytes(url: str) -> bytes:
    return _session().read.format("binaryFile").load(url).select("content").first()["content"]


# --- rasters ---


@dataclass
class RasterHeader:
    x0: float
    y0: float
    dx: float
    dy: float
    width: int
    height: int
    bands: int
    dtype: str
    crs: str
    none: float | None


def raster_header(url: str) -> RasterHeader:
    return decode_raster(_bytes(allowed(url)), url)[0]


def decode_raster(data: bytes, url: str) -> tuple[RasterHeader, np.ndarray]:
    """Header and values (bands, height, width)."""
    kind = PurePosixPath(url).suffix.lower()
    if kind in (".asc", ".txt"):
        return _ascii(data)
    if kind in (".tif", ".tiff"):
        return _tiff(data)
    raise NotImplementedError(f"raster files of kind {kind!r} aren't known")


def _ascii(data: bytes) -> tuple[RasterHeader, np.ndarray]:
    lines = data.decode().splitlines()
    head, k = {}, 0
    while k < len(lines) and re.match(r"\s*[A-Za-z_]+\s", lines[k]):
        name, value = lines[k].split()[:2]
        head[name.lower()] = value
        k += 1
    cols, rows, size = int(head["ncols"]), int(head["nrows"]), float(head["cellsize"])
    x = float(head["xllcorner"]) if "xllcorner" in head else float(head["xllcenter"]) - size / 2
    y = float(head["yllcorner"]) if "yllcorner" in head else float(head["yllcenter"]) - size / 2
    values = np.array(" ".join(lines[k:]).split(), dtype=np.float64).reshape(1, rows, cols)
    crs = crs_.normalise(head.get("crs", "EPSG:3857"))
    return RasterHeader(x, y + rows * size, size, size, cols, rows, 1, "float64", crs, float(head.get("nodata_value", -9999))), values


# Fixed values of the TIFF format: field types and tags.
TIFF_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 11: "f", 12: "d", 16: "Q"}
WIDTH, HEIGHT, BITS, COMPRESSION, OFFSETS, SAMPLES, ROWS, COUNTS, PLANAR, PREDICTOR, FORMAT = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317, 339
SCALE, TIEPOINT, GEOKEYS, NODATA = 33550, 33922, 34735, 42113


def _tiff(data: bytes) -> tuple[RasterHeader, np.ndarray]:
    order = "<" if data[:2] == b"II" else ">"
    if struct.unpack(order + "H", data[2:4])[0] != 42:
        raise NotImplementedError("not a classic TIFF")
    at = struct.unpack(order + "I", data[4:8])[0]
    tags = {}
    for k in range(struct.unpack(order + "H", data[at : at + 2])[0]):
        tag, kind, n, _ = struct.unpack(order + "HHI4s", data[at + 2 + 12 * k : at + 14 + 12 * k])
        code = TIFF_TYPES.get(kind)
        if code is None:
            continue
        size = n if code == "s" else struct.calcsize(order + code) * n
        place = at + 10 + 12 * k
        if size > 4:
            place = struct.unpack(order + "I", data[place : place + 4])[0]
        tags[tag] = data[place : place + n] if code == "s" else struct.unpack(order + code * n, data[place : place + size])
    w, h, bands = tags[WIDTH][0], tags[HEIGHT][0], tags.get(SAMPLES, (1,))[0]
    if OFFSETS not in tags or tags.get(PREDICTOR, (1,))[0] != 1 or tags.get(COMPRESSION, (1,))[0] not in (1, 8, 32946):
        raise NotImplementedError("only striped TIFF, uncompressed or deflate, is read")
    kind = np.dtype(order + {1: "u", 2: "i", 3: "f"}[tags.get(FORMAT, (1,))[0]] + str(tags[BITS][0] // 8))
    raw = b"".join(zlib.decompress(data[o : o + n]) if tags.get(COMPRESSION, (1,))[0] != 1 else data[o : o + n] for o, n in zip(tags[OFFSETS], tags[COUNTS]))
    values = np.frombuffer(raw, kind)
    values = values.reshape(bands, h, w) if tags.get(PLANAR, (1,))[0] == 2 else values.reshape(h, w, bands).transpose(2, 0, 1)
    dx, dy = tags[SCALE][:2] if SCALE in tags else (1.0, 1.0)
    i, j, _, x, y, _ = tags[TIEPOINT][:6] if TIEPOINT in tags else (0, 0, 0, 0, 0, 0)
    keys = tags.get(GEOKEYS, ())
    codes = {keys[k]: keys[k + 3] for k in range(4, len(keys), 4)}
    code = codes.get(3072) or codes.get(2048) or 3857
    none = float(tags[NODATA].rstrip(b"\0 ")) if NODATA in tags else None
    native = values.dtype.newbyteorder("=")
    return RasterHeader(x - i * dx, y + j * dy, dx, dy, w, h, bands, str(native), crs_.normalise(f"EPSG:{code}"), none), values.astype(native)


def encode_tiff(values: np.ndarray, grid, none: float | None) -> bytes:
    """A deflate GeoTIFF of (height, width) values, one strip."""
    h, w = values.shape
    body = zlib.compress(np.ascontiguousarray(values.astype(values.dtype.newbyteorder("<"))).tobytes())
    code = int(crs_.normalise(grid.crs).split(":")[1])
    model = 2 if crs_.is_geographic(grid.crs) else 1
    keys = (1, 1, 0, 2, 1024, 0, 1, model, 2048 if model == 2 else 3072, 0, 1, code)
    entries: list[tuple[int, int, int, bytes]] = []

    def add(tag, code, *v):
        entries.append((tag, {"H": 3, "I": 4, "d": 12}[code], len(v), struct.pack("<" + code * len(v), *v)))

    add(WIDTH, "I", w), add(HEIGHT, "I", h), add(BITS, "H", values.dtype.itemsize * 8), add(COMPRESSION, "H", 8), add(262, "H", 1), add(OFFSETS, "I", 8), add(SAMPLES, "H", 1), add(ROWS, "I", h), add(COUNTS, "I", len(body)), add(PLANAR, "H", 1)
    add(FORMAT, "H", {"u": 1, "i": 2, "f": 3}[values.dtype.kind]), add(SCALE, "d", grid.dx, grid.dy, 0.0), add(TIEPOINT, "d", 0.0, 0.0, 0.0, grid.x0, grid.y0, 0.0), add(GEOKEYS, "H", *keys)
    if none is not None:
        text = repr(none).encode() + b"\0"
        entries.append((NODATA, 2, len(text), text))
    body += b"\0" * (len(body) % 2)
    at = 8 + len(body)
    more, directory = b"", struct.pack("<H", len(entries))
    after = at + 2 + 12 * len(entries) + 4
    for tag, kind, n, raw in sorted(entries):
        if len(raw) <= 4:
            directory += struct.pack("<HHI", tag, kind, n) + raw.ljust(4, b"\0")
        else:
            directory += struct.pack("<HHII", tag, kind, n, after + len(more))
            more += raw + b"\0" * (len(raw) % 2)
    return b"II*\0" + struct.pack("<I", at) + body + directory + struct.pack("<I", 0) + more


def raster_cells(spark: SparkSession, url: str, times, kind: str) -> DataFrame:
    stamps = np.array(times, dtype="datetime64[us]")

    def run(batches):
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                head, values = decode_raster(content, path)
                for t, band in zip(stamps, values):
                    for i in range(0, head.height, 256):
                        part = band[i : i + 256].astype(np.float64)
                        rows, cols = np.indices(part.shape)
                        v = part.ravel()
                        missing = ~np.isfinite(v) | (np.isclose(v, head.none) if head.none is not None else False)
                        yield pd.DataFrame({"t": t, "i": (rows.ravel() + i).astype(np.int32), "j": cols.ravel().astype(np.int32), "v": np.where(missing, np.nan, v)})

    df = spark.read.format("binaryFile").load(url).select("path", "content").mapInPandas(run, "t timestamp_ntz, i int, j int, v double")
    return df.withColumn("v", F.when(~F.isnan("v"), F.col("v")).cast(kind))


def read_manifest(url: str) -> dict:
    return json.loads(_session().read.text(f"{url}/manifest", wholetext=True).first()[0])


# --- features ---

RESERVED = {"fid", "geom", "_ord"}


def feature_schema(url: str, layer: str | None) -> tuple[list[tuple[str, str]], str]:
    """Property names and Spark types, and the projection."""
    spark = _session()
    kind = _kind(allowed(url))
    if kind == "parquet":
        df = spark.read.parquet(f"{url}/features")
        return [(c, t) for c, t in df.dtypes if c not in RESERVED], read_manifest(url)["crs"]
    if kind == "geojson":
        return _infer_json(spark.read.text(url, wholetext=not url.endswith(("l", "s")))), "EPSG:4326"
    rows, crs = decode_features(_binary(spark, url), url, layer)
    return _infer([r[2] for r in rows]), crs


def _kind(url: str) -> str:
    suffix = PurePosixPath(url.rstrip("/")).suffix.lower()
    known = {".geojson": "geojson", ".json": "geojson", ".geojsonl": "geojson", ".geojsons": "geojson", ".gpkg": "gpkg", ".shp": "shp", "": "parquet"}
    if suffix not in known:
        raise NotImplementedError(f"feature files of kind {suffix!r} aren't known")
    return known[suffix]


def _kind_of(v) -> str | None:
    return "boolean" if isinstance(v, bool) else "bigint" if isinstance(v, int) else "double" if isinstance(v, float) else None if v is None else "string"


def _type_of(kinds: set) -> str:
    """The type that holds values of all these kinds."""
    kinds = kinds - {None}
    return kinds.pop() if len(kinds) == 1 else "double" if kinds == {"bigint", "double"} else "string"


def _infer(rows: list[dict]) -> list[tuple[str, str]]:
    out: dict[str, set] = {}
    for r in rows:
        for k, v in r.items():
            out.setdefault(k, set()).add(_kind_of(v))
    return [(k, _type_of(v)) for k, v in out.items()]


def _infer_json(text: DataFrame) -> list[tuple[str, str]]:
    """The same over all rows of text, in the order of first appearance; what is collected grows with the number of properties only."""

    def run(batches):
        found: dict[tuple, tuple] = {}
        for b in batches:
            for value, n in zip(b["value"], b["n"]):
                for k, f in enumerate(_json_features(value)):
                    for i, (name, v) in enumerate((f.get("properties") or {}).items()):
                        found.setdefault((name, _kind_of(v)), (n, k, i))
        yield pd.DataFrame([(*what, *at) for what, at in found.items()], columns=["name", "kind", "n", "k", "i"])

    each = text.select("value", F.monotonically_increasing_id().alias("n")).mapInPandas(run, "name string, kind string, n long, k long, i long")
    rows = each.groupBy("name").agg(F.min(F.struct("n", "k", "i")).alias("at"), F.collect_set("kind").alias("kinds")).orderBy("at").collect()
    return [(r["name"], _type_of(set(r["kinds"]))) for r in rows]


def _json_features(text: str) -> list[dict]:
    if not text or not text.strip():
        return []
    found = json.loads(text)
    return found["features"] if found.get("type") == "FeatureCollection" else [found]


def _rings(geometry: dict | None):
    if not geometry:
        return None
    kind, c = geometry["type"].lower(), geometry["coordinates"]
    if kind == "point":
        return {"kind": "point", "rings": [[_xy(c)]]}
    if kind == "linestring":
        return {"kind": kind, "rings": [[*map(_xy, c)]]}
    if kind == "polygon":
        return {"kind": kind, "rings": [[*map(_xy, r)] for r in c]}
    if kind == "multipolygon":
        return {"kind": kind, "rings": [[*map(_xy, r)] for p in c for r in p]}
    raise NotImplementedError(f"geometries of kind {kind} aren't known")


def _xy(p):
    return {"x": float(p[0]), "y": float(p[1])}


def _cast(v, kind: str):
    if v is None:
        return None
    if kind == "string":
        return json.dumps(v) if isinstance(v, (list, dict)) else str(v)
    return {"boolean": bool, "bigint": int, "double": float}[kind](v)


def read_features(spark: SparkSession, url: str, layer: str | None, columns) -> DataFrame:
    kind = _kind(url)
    if kind == "parquet":
        df = spark.read.parquet(f"{url}/features")
        return df if "_ord" in df.columns else df.withColumn("_ord", F.col("fid"))
    schema = f"fid long, _ord long, geom {geo.TYPE}" + "".join(f", `{c}` {t}" for c, t in columns)

    def frame(rows):
        """rows: (id, geometry, properties)"""
        return pd.DataFrame({"fid": [r[0] for r in rows], "_ord": [r[0] for r in rows], "geom": [r[1] for r in rows]} | {c: pd.Series([_cast(r[2].get(c), t) for r in rows], dtype=object) for c, t in columns})

    if kind == "geojson":
        lines = url.endswith(("l", "s"))
        text = spark.read.text(url, wholetext=not lines)
        if lines:
            text = text.select("value", F.monotonically_increasing_id().alias("n"))
        else:
            text = text.select("value", F.lit(0).cast("long").alias("n"))

        def parse(batches):
            for b in batches:
                for value, n in zip(b["value"], b["n"]):
                    rows = [(f["id"] if isinstance(f.get("id"), int) else n + k, _rings(f.get("geometry")), f.get("properties") or {}) for k, f in enumerate(_json_features(value))]
                    for i in range(0, len(rows), 5000):
                        yield frame(rows[i : i + 5000])

        return text.mapInPandas(parse, schema)

    def decode(batches):
        for b in batches:
            for content in b["content"]:
                rows, _ = decode_features(content, url, layer)
                for i in range(0, len(rows), 5000):
                    yield frame(rows[i : i + 5000])

    return _binary_frame(spark, url).mapInPandas(decode, schema)


def _binary_frame(spark, url) -> DataFrame:
    if _kind(url) == "shp":
        # the three files of a shapefile travel together
        base = url[:-4]
        parts = spark.read.format("binaryFile").load([f"{base}.shp", f"{base}.dbf"])
        packed = parts.groupBy(F.lit(1)).agg(F.max(F.when(F.col("path").endswith(".shp"), F.col("content"))).alias("a"), F.max(F.when(F.col("path").endswith(".dbf"), F.col("content"))).alias("b"))
        return packed.select(F.concat(F.lpad(F.length("a").cast("string"), 12, "0").cast("binary"), "a", "b").alias("content"))
    return spark.read.format("binaryFile").load(url).select("content")


def _binary(spark, url) -> bytes:
    return bytes(_binary_frame(spark, url).first()["content"])


def decode_features(data: bytes, url: str, layer: str | None):
    """[(id, geometry, properties)] and the projection."""
    return _shapefile(bytes(data)) if _kind(url) == "shp" else _geopackage(bytes(data), layer)


def _geopackage(data: bytes, layer: str | None):
    with tempfile.NamedTemporaryFile(suffix=".gpkg") as f:
        f.write(data)
        f.flush()
        con = sqlite3.connect(f.name)
        try:
            found = con.execute("SELECT table_name, column_name, srs_id FROM gpkg_geometry_columns").fetchall()
            table, column, srs = next((x for x in found if layer in (None, x[0])), (None, None, None))
            if table is None:
                raise ValueError(f"layer {layer!r} isn't there")
            cursor = con.execute(f'SELECT * FROM "{table}"')
            names = [c[0] for c in cursor.description]
            key = next((r[1] for r in con.execute(f'PRAGMA table_info("{table}")') if r[5]), names[0])
            rows = []
            for n, r in enumerate(cursor):
                p = dict(zip(names, r))
                rows.append((p.pop(key, n), _gpkg_geometry(p.pop(column)), p))
            return rows, crs_.normalise(f"EPSG:{srs}")
        finally:
            con.close()


def _gpkg_geometry(blob):
    if blob is None:
        return None
    envelope = (0, 32, 48, 48, 64)[blob[3] >> 1 & 7]
    return from_wkb(blob[8 + envelope :])


# Fixed numbers of WKB geometry kinds.
WKB = {1: "point", 2: "linestring", 3: "polygon", 6: "multipolygon"}


def from_wkb(data: bytes):
    def read(at):
        order = "<" if data[at] == 1 else ">"
        kind = struct.unpack_from(order + "I", data, at + 1)[0] % 1000
        at += 5

        def points(at, n):
            flat = struct.unpack_from(order + "d" * (2 * n), data, at)
            return [{"x": x, "y": y} for x, y in zip(flat[::2], flat[1::2])], at + 16 * n

        def count(at):
            return struct.unpack_from(order + "I", data, at)[0], at + 4

        if kind == 1:
            ring, at = points(at, 1)
            return kind, [ring], at
        n, at = count(at)
        rings = []
        if kind == 2:
            ring, at = points(at, n)
            return kind, [ring], at
        for _ in range(n):
            if kind == 3:
                m, at = count(at)
                ring, at = points(at, m)
                rings.append(ring)
            else:
                _, more, at = read(at)
                rings += more
        return kind, rings, at

    kind, rings, _ = read(0)
    return {"kind": WKB[kind], "rings": rings}


def to_wkb(kind: str, rings) -> bytes:
    pts = lambda r: b"".join(struct.pack("<dd", x, y) for x, y in r)
    if kind == "point":
        return struct.pack("<BI", 1, 1) + pts(rings[0])
    if kind == "linestring":
        return struct.pack("<BII", 1, 2, len(rings[0])) + pts(rings[0])
    body = lambda rs: struct.pack("<BII", 1, 3, len(rs)) + b"".join(struct.pack("<I", len(r)) + pts(r) for r in rs)
    return body(rings) if kind == "polygon" else struct.pack("<BII", 1, 6, len(rings)) + b"".join(body([r]) for r in rings)


def _shapefile(data: bytes):
    n = int(data[:12])
    shp, dbf = data[12 : 12 + n], data[12 + n :]
    shapes, at = [], 100
    while at < len(shp):
        size = struct.unpack(">I", shp[at + 4 : at + 8])[0] * 2
        body = shp[at + 8 : at + 8 + size]
        kind = struct.unpack("<I", body[:4])[0]
        if kind == 0:
            shapes.append(None)
        elif kind % 10 == 1:
            x, y = struct.unpack("<dd", body[4:20])
            shapes.append({"kind": "point", "rings": [[{"x": x, "y": y}]]})
        else:
            parts, points = struct.unpack("<II", body[36:44])
            starts = [*struct.unpack(f"<{parts}I", body[44 : 44 + 4 * parts]), points]
            flat = struct.unpack(f"<{2 * points}d", body[44 + 4 * parts : 44 + 4 * parts + 16 * points])
            xy = [{"x": x, "y": y} for x, y in zip(flat[::2], flat[1::2])]
            rings = [xy[a:b] for a, b in zip(starts, starts[1:])]
            shapes.append({"kind": "linestring" if kind % 10 == 3 else "polygon" if parts == 1 else "multipolygon", "rings": rings})
        at += 8 + size
    count, head, width = struct.unpack("<IHH", dbf[4:12])
    fields = [(dbf[k : k + 11].split(b"\0")[0].decode(), chr(dbf[k + 11]), dbf[k + 16], dbf[k + 17]) for k in range(32, head - 1, 32)]
    rows = []
    for k in range(count):
        at, row = head + k * width + 1, {}
        for name, kind, size, decimals in fields:
            text = dbf[at : at + size].decode("utf-8", "replace").strip()
            at += size
            row[name] = None if not text or text.startswith("*") else (float(text) if decimals or "." in text or "e" in text.lower() else int(text)) if kind in "NF" else text.upper() in ("T", "Y") if kind == "L" else text
        rows.append((k, shapes[k], row))
    return rows, "EPSG:3857"
