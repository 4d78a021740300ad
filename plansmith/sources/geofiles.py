"""GeoJSON and shapefiles as a Spark data source, `spark.read.format("geofiles")`: a row a feature, split by byte ranges.

Reading.  A path is a file or a folder of files.  A GeoJSON range owns the features that begin in it: a worker looks for the next
`"type": "Feature"`, which no string can hold unescaped, goes back to the brace that opens its object, and reads on
from there; so collections on one line, on many, and files of bare features split alike.  A shapefile is split by record
numbers, whose places its index has.  Of a zip archive each task reads one.

Writing.  A task writes parts of bounded size, each a valid file, under a temporary name; the driver's commit moves them in
place and removes what was there, an abort removes them.  Values of a shapefile keep to its table: names have ten
letters (clashes are numbered), texts 254 bytes (longer ones are an error).

Geometry is WKB of polygons; a feature without geometry has none, other kinds are an error.  Properties come as text, nested
ones as JSON.
"""

from __future__ import annotations

import io
import json
import re
import struct
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions.geometry import areas, each_polygon, flat, homes, multipolygon, packed, wkb

NAME = "geofiles"
ENDINGS = (".geojson", ".json", ".shp", ".zip")
SCHEMA = "file string, position bigint, properties map<string,string>, geom binary"
#: Bytes of a range, of one read, and of a written part; features of a batch.
RANGE, STEP, PART, BATCH = 64 << 20, 1 << 20, 64 << 20, 1000  # a batch has STEP bytes of shapes and one more at most

MARK = re.compile(rb'"type"\s*:\s*"Feature"')
FORWARD = re.compile(rb'"(?:[^"\\]|\\.)*"|[{}"]', re.S)
#: The same for reversed bytes: a quote that a backslash comes before is a letter of its string.
BACKWARD = re.compile(rb'"(?:[^"]|"(?=\\))*"(?!\\)|[{}"]', re.S)
#: What may stand between features.
BETWEEN = re.compile(rb"[\s,\x1e]*")

ARROW = pa.schema([("file", pa.string()), ("position", pa.int64()), ("properties", pa.map_(pa.string(), pa.string())), ("geom", pa.binary())])


class Window:
    """A part of a file that grows to both sides as it is read."""

    def __init__(self, file, size: int, at: int, step: int):
        self.file, self.size, self.low, self.step = file, size, at, step
        self.data = file.read_at(min(step, size - at), at)

    def later(self) -> bool:
        n = min(max(self.step, len(self.data)), self.size - self.low - len(self.data))
        if n > 0:
            self.data += self.file.read_at(n, self.low + len(self.data))
        return n > 0

    def earlier(self) -> bool:
        n = min(max(self.step, len(self.data)), self.low)
        if n > 0:
            self.data = self.file.read_at(n, self.low - n) + self.data
            self.low -= n
        return n > 0

    def forget(self, before: int) -> None:
        self.data, self.low = self.data[before - self.low :], before

    def mark(self, at: int) -> int | None:
        """Where the next feature says that it is one."""
        while True:
            if found := MARK.search(self.data, at - self.low):
                return self.low + found.start()
            if not self.later():
                return None

    def opening(self, at: int) -> int | None:
        """The brace that opens the object around a place that is in no string."""
        while True:
            depth = 0
            for t in BACKWARD.finditer(self.data[: at - self.low][::-1]):
                if t[0] == b'"':
                    break  # a string begins before the window
                if t[0] == b"}":
                    depth += 1
                elif t[0] == b"{":
                    if not depth:
                        return at - t.end()
                    depth -= 1
            if not self.earlier():
                return None

    def closing(self, at: int) -> int:
        """The end of the object that begins at a place."""
        while True:
            depth = 0
            for t in FORWARD.finditer(self.data, at - self.low):
                if t[0] == b'"':
                    break  # a string goes on after the window
                depth += (t[0] == b"{") - (t[0] == b"}")
                if not depth:
                    return self.low + t.end()
            if not self.later():
                raise ValueError(f"the object at byte {at} does not end")

    def skip(self, at: int) -> int:
        while (end := BETWEEN.match(self.data, at - self.low).end()) == len(self.data):
            if not self.later():
                break
        return self.low + end


def objects(w: Window, low: int, high: int) -> Iterator[tuple[int, bytes]]:
    """The features that begin from low to high."""
    at = low
    while True:
        place = w.skip(at) if at > low else at
        if not (at > low and w.data[place - w.low : place - w.low + 1] == b"{"):  # not right behind another feature
            mark = w.mark(at)
            place = None if mark is None else w.opening(mark)
            if place is None:
                return
        if place >= high:
            return
        end = w.closing(place)
        if place >= low:
            yield place, w.data[place - w.low : end - w.low]
        at = end
        w.forget(end)


def text_of(value: object) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def geometry(shape: dict | None, made: bool = True) -> bytes | None:
    """WKB of a feature's geometry; where it is not to be made, only its kind is looked at."""
    if shape is None or not made and shape.get("type") in ("Polygon", "MultiPolygon"):
        return None
    rings = lambda p: [np.array(r, float)[:, :2] for r in p]
    if shape.get("type") == "Polygon":
        return wkb(rings(shape["coordinates"]))
    if shape.get("type") == "MultiPolygon":
        return multipolygon([rings(p) for p in shape["coordinates"]])
    raise ValueError(f"{shape.get('type')} is neither a polygon nor several")


def features(file, size: int, low: int, high: int, step: int = STEP, shapes: bool = True) -> Iterator[tuple[int, dict, bytes | None]]:
    for at, data in objects(Window(file, size, low, step), low, high):
        one = json.loads(data)
        if one.get("type") == "Feature":
            yield at, {k: text_of(v) for k, v in (one.get("properties") or {}).items()}, geometry(one.get("geometry"), shapes)


# Shapefiles

@dataclass
class Table:
    """The layout of a .dbf: fields (name, kind, first byte, size), header and record sizes, encoding."""

    fields: list[tuple[str, str, int, int]]
    start: int
    width: int
    encoding: str

    @classmethod
    def of(cls, head: bytes, encoding: str = "utf-8") -> Table:
        start, width = struct.unpack_from("<HH", head, 8)
        fields, at = [], 1
        for k in range(32, start - 1, 32):
            if head[k] == 0x0D:
                break
            fields.append((head[k : k + 11].split(b"\0")[0].decode(encoding, "replace"), chr(head[k + 11]), at, head[k + 16]))
            at += head[k + 16]
        return cls(fields, start, width, encoding)

    def row(self, data: bytes) -> dict[str, str | None]:
        out = {}
        for name, kind, at, size in self.fields:
            try:
                value = data[at : at + size].decode(self.encoding)
            except UnicodeDecodeError:
                value = data[at : at + size].decode("latin-1")
            value = value.rstrip(" \0") if kind == "C" else value.strip(" \0*")
            out[name] = value if value or kind == "C" else None
        return out


def polygonal(kind: int) -> None:
    if kind not in (0, 5, 15, 25):
        raise ValueError(f"shape kind {kind} is no polygon")


def shape(data: bytes) -> bytes | None:
    """WKB of a shapefile's record: outer rings go clockwise, holes the other way."""
    kind, = struct.unpack_from("<i", data)
    if kind == 0:
        return None
    polygonal(kind)
    n, points = struct.unpack_from("<ii", data, 36)
    ends = [*struct.unpack_from(f"<{n}i", data, 44), points]
    xy = np.frombuffer(data, "<f8", 2 * points, 44 + 4 * n).reshape(-1, 2)
    first = np.array([*ends])
    size = areas(xy, first)
    is_outer = size <= 0
    if not is_outer.any():
        is_outer[:1] = True
    outer, holes = np.flatnonzero(is_outer), np.flatnonzero(~is_outer)
    return packed(xy, first, outer, holes, np.maximum(homes(xy, first, size, holes, outer), 0))


def shaped(g: bytes | None) -> bytes:
    """The content of a shapefile's record."""
    if g is None:
        return struct.pack("<i", 0)
    xy, first, outer = flat(bytes(g))
    n = np.diff(first)
    turned = np.repeat((areas(xy, first) > 0) == outer, n)
    at = np.arange(len(xy))
    xy = xy[np.where(turned, np.repeat(first[:-1] + first[1:] - 1, n) - at, at)]
    box = (*xy.min(axis=0), *xy.max(axis=0)) if len(xy) else (0.0,) * 4
    return struct.pack("<i4dii", 5, *box, len(n), len(xy)) + first[:-1].astype("<i4").tobytes() + np.ascontiguousarray(xy, "<f8").tobytes()


def records(shp, shx, dbf, size: int, low: int, high: int, encoding: str, shapes: bool = True) -> Iterator[tuple[int, dict, bytes | None]]:
    """The records from number low to high; the three files are read at the places that matter."""
    where = np.frombuffer(shx.read_at(8 * (high - low), 100 + 8 * low), ">i4").reshape(-1, 2).astype(np.int64) * 2
    polygonal(*struct.unpack("<i", shp.read_at(4, 32)))
    head = dbf.read_at(32, 0)
    table = Table.of(dbf.read_at(struct.unpack_from("<H", head, 8)[0], 0), encoding)
    for k in range(0, len(where), BATCH):
        part = where[k : k + BATCH]
        rows = dbf.read_at(table.width * len(part), table.start + table.width * (low + k))
        begin = int(part[:, 0].min())
        data = shp.read_at(int((part[:, 0] + part[:, 1]).max()) + 8 - begin, begin) if shapes else b""
        for i, (at, n) in enumerate(part.tolist()):
            row = rows[i * table.width : (i + 1) * table.width]
            if row[:1] != b"*":  # deleted
                yield low + k + i, table.row(row), shape(data[at - begin + 8 : at - begin + 8 + n]) if shapes else None


class Parts:
    """Writes features to files of bounded size."""

    def __init__(self, kind: str, schema: StructType):
        self.kind, self.columns = kind, [f for f in schema.fields if f.name != "geom"]
        if "geom" not in schema.names:
            raise ValueError("features need a column geom")
        self.names, self.layout = [], []
        for f in self.columns:
            name, k = f.name.encode()[:10].decode("utf-8", "ignore"), 1
            while name.lower() in [x.lower() for x in self.names]:
                name, k = f"{f.name.encode()[:8].decode('utf-8', 'ignore')}_{k}"[:10], k + 1
            self.names.append(name)
            of = f.dataType.typeName()
            self.layout.append(("N", 20) if of in ("byte", "short", "integer", "long") else ("F", 24) if of in ("float", "double") else ("L", 1) if of == "boolean" else ("C", 254))

    def put(self, rows: list[dict]) -> Iterable[tuple[str, Iterable[bytes]]]:
        """The files (ending, content in pieces) of some rows."""
        if self.kind == ".geojson":
            return [(".geojson", self.geojson(rows))]
        files = [*self.shapefile(rows), (".cpg", b"UTF-8")]
        if self.kind == ".shp":
            return [(ending, [data]) for ending, data in files]
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for ending, data in files:
                z.writestr("plan" + ending, data)
        return [(".zip", [out.getvalue()])]

    def geojson(self, rows: list[dict]) -> Iterator[bytes]:
        """A collection, polygon by polygon, so that no feature's text is held as a whole."""
        yield b'{"type":"FeatureCollection","features":['
        for k, r in enumerate(rows):
            own = json.dumps({f.name: r[f.name] for f in self.columns}, ensure_ascii=False, default=str)
            yield f'{"," * bool(k)}\n{{"type":"Feature","properties":{own},"geometry":'.encode()
            if r["geom"] is None:
                yield b"null}"
                continue
            yield b'{"type": "MultiPolygon", "coordinates": ['
            for j, p in enumerate(each_polygon(bytes(r["geom"]))):
                yield (", " * bool(j) + json.dumps([x.tolist() for x in p])).encode()
            yield b"]}}"
        yield b"\n]}\n"

    def shapefile(self, rows: list[dict]) -> list[tuple[str, bytes]]:
        own = [shaped(r["geom"]) for r in rows]
        at = np.cumsum([100, *(len(x) + 8 for x in own)])
        boxes = np.array([struct.unpack_from("<4d", x, 4) for x in own if len(x) > 4]).reshape(-1, 4)
        box = (*boxes[:, :2].min(axis=0), *boxes[:, 2:].max(axis=0)) if len(boxes) else (0.0,) * 4
        head = lambda size: struct.pack(">i5ii", 9994, 0, 0, 0, 0, 0, size // 2) + struct.pack("<ii8d", 1000, 5, *box, 0, 0, 0, 0)
        shp = head(int(at[-1])) + b"".join(struct.pack(">ii", k + 1, len(x) // 2) + x for k, x in enumerate(own))
        shx = head(100 + 8 * len(own)) + b"".join(struct.pack(">ii", int(a) // 2, len(x) // 2) for a, x in zip(at, own, strict=False))
        width = 1 + sum(n for _, n in self.layout)
        dbf = struct.pack("<B3BIHH20x", 3, 100, 1, 1, len(rows), 33 + 32 * len(self.names), width)
        for name, (kind, n) in zip(self.names, self.layout, strict=True):
            dbf += struct.pack("<11sc4xBB14x", name.encode(), kind.encode(), n, 0)
        return [(".shp", shp), (".shx", shx), (".dbf", dbf + b"\r" + b"".join(self.cells(r) for r in rows) + b"\x1a")]

    def cells(self, row: dict) -> bytes:
        out = [b" "]
        for f, (kind, n) in zip(self.columns, self.layout, strict=True):
            v = row[f.name]
            data = b"" if v is None else (b"T" if v else b"F") if kind == "L" else (repr(v) if kind == "F" else str(v)).encode()
            if len(data) > n:
                raise ValueError(f"{f.name}: {len(data)} bytes do not fit a shapefile's {n}")
            out.append(data.rjust(n) if kind in "NF" else data.ljust(n))
        return b"".join(out)


# The data source

@dataclass
class Range(InputPartition):
    path: str
    low: int
    high: int


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


def store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith(("/", "file:")) else (fs.LocalFileSystem(), path)


def found(path: str) -> list[fs.FileInfo]:
    """The files of a path, hidden ones aside."""
    system, root = store(path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    every = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
    hidden = lambda x: any(p.startswith(("_", ".")) for p in x.path[len(root) :].split("/") if p)
    return sorted((x for x in every if x.type == fs.FileType.File and x.path.lower().endswith(ENDINGS) and not hidden(x)), key=lambda x: x.path)


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.range = options["path"], int(options.get("rangebytes", RANGE))
        self.shapes = options.get("shapes", "true") == "true"

    def partitions(self) -> list[Range]:
        system, out = store(self.path)[0], []
        for x in found(self.path):
            if x.path.endswith(".zip"):
                out.append(Range(x.path, 0, -1))
                continue
            n, step = x.size, self.range
            if x.path.endswith(".shp"):
                n = (system.get_file_info(x.path[:-4] + ".shx").size - 100) // 8
                step = max(1, n * self.range // max(x.size, 1))
            out += [Range(x.path, k, min(n, k + step)) for k in range(0, n, step)]
        return out

    def read(self, part: Range | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # of nothing
            return
        system = store(self.path)[0]
        rows: list[tuple] = []
        size = 0
        for row in self.rows(system, part):
            rows.append((part.path, *row))
            size += len(row[2] or b"")
            if len(rows) == BATCH or size >= STEP:
                yield batch(rows)
                rows, size = [], 0
        if rows:
            yield batch(rows)

    def rows(self, system: fs.FileSystem, part: Range) -> Iterator[tuple[int, dict, bytes | None]]:
        base = part.path[:-4]
        if part.path.endswith(".zip"):
            with system.open_input_file(part.path) as f, zipfile.ZipFile(f) as z:
                for name in sorted(n for n in z.namelist() if n.lower().endswith((".shp", ".geojson", ".json"))):
                    if name.lower().endswith(".shp"):
                        shp, shx, dbf = (pa.BufferReader(z.read(name[:-4] + e)) for e in (".shp", ".shx", ".dbf"))
                        coding = z.read(name[:-4] + ".cpg").decode().strip() if name[:-4] + ".cpg" in z.namelist() else "utf-8"
                        yield from records(shp, shx, dbf, shp.size(), 0, (shx.size() - 100) // 8, coding, self.shapes)
                    else:
                        data = pa.BufferReader(z.read(name))
                        yield from features(data, data.size(), 0, data.size(), shapes=self.shapes)
        elif part.path.endswith(".shp"):
            cpg = system.get_file_info(base + ".cpg")
            coding = system.open_input_file(cpg.path).read().decode().strip() if cpg.type == fs.FileType.File else "utf-8"
            with system.open_input_file(part.path) as shp, system.open_input_file(base + ".shx") as shx, system.open_input_file(base + ".dbf") as dbf:
                yield from records(shp, shx, dbf, 0, part.low, part.high, coding, self.shapes)
        else:
            with system.open_input_file(part.path) as f:
                yield from features(f, f.size(), part.low, part.high, shapes=self.shapes)


def batch(rows: list[tuple]) -> pa.RecordBatch:
    file, at, own, geom = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(file, pa.string()), pa.array(at, pa.int64()), pa.array([list(x.items()) for x in own], ARROW.field("properties").type), pa.array(geom, pa.binary())], schema=ARROW)


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool):
        self.path, self.schema, self.overwrite = options["path"].rstrip("/"), schema, overwrite
        self.kind = next((e for e in (".geojson", ".shp", ".zip") if self.path.endswith(e)), None)
        if self.kind is None:
            raise ValueError(f"{self.path}: the ending has to be .geojson, .shp or .zip")
        self.job = uuid.uuid4().hex
        Parts(self.kind, schema)  # the columns will do

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, root = store(self.path)
        own, rows, size, files = Parts(self.kind, self.schema), [], 0, []

        def flush() -> None:
            name = uuid.uuid4().hex
            system.create_dir(f"{root}/_temporary-{self.job}", recursive=True)
            for ending, data in own.put(rows):
                with system.open_output_stream(f"{root}/_temporary-{self.job}/{name}{ending}", buffer_size=STEP) as out:
                    for piece in data:
                        out.write(piece)
                files.append(name + ending)

        for b in batches:
            for r in b.to_pylist():
                rows.append(r)
                size += len(r["geom"] or b"") + 256 * len(r)
                if size >= PART:
                    flush()
                    rows, size = [], 0
        if rows:
            flush()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = store(self.path)
        system.create_dir(root, recursive=True)
        old = [x.path for x in system.get_file_info(fs.FileSelector(root)) if x.type == fs.FileType.File] if self.overwrite else []
        for name in [f for m in messages if m for f in m.files]:
            system.move(f"{root}/_temporary-{self.job}/{name}", f"{root}/part-{name}")
        for path in old:
            system.delete_file(path)
        self.clear(system, root)
        with system.open_output_stream(f"{root}/_SUCCESS"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        self.clear(*store(self.path))

    def clear(self, system: fs.FileSystem, root: str) -> None:
        temporary = f"{root}/_temporary-{self.job}"
        if system.get_file_info(temporary).type == fs.FileType.Directory:
            system.delete_dir(temporary)


class GeoFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options, schema, overwrite)


def read(spark: SparkSession, path: str, range_bytes: int = RANGE, shapes: bool = True) -> DataFrame:
    """(file, position, properties, geom) of every feature; without shapes geom is null and not made."""
    spark.dataSource.register(GeoFiles)
    return spark.read.format(NAME).option("rangeBytes", range_bytes).option("shapes", str(shapes).lower()).load(path)


def columns(spark: SparkSession, path: str, *first: str) -> DataFrame:
    """Features of a path with their properties as text columns, and geom; the names are gathered."""
    keys = sorted(r[0] for r in read(spark, path, shapes=False).select(F.explode(F.map_keys("properties"))).distinct().collect())
    return read(spark, path).select(*first, *(F.col("properties")[k].alias(k) for k in keys), "geom")


def write(df: DataFrame, path: str) -> None:
    df.sparkSession.dataSource.register(GeoFiles)
    df.write.format(NAME).mode("overwrite").save(path)
