"""Binary glTF meshes as rows: a data source with one partition a file, and a parser of columns of bytes.

``spark.dataSource.register(GlbDataSource)``, then ``spark.read.format("glb").load(path)``.
A file that can't be used is a report, never an error: rows of kind ``skipped`` say what was left out.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Fixed values of the format: the words that open a file and its chunks, component types by number, and how many components a type has
_MAGIC, _JSON, _BIN = b"glTF", b"JSON", b"BIN\0"
_COMPONENTS = {5120: "<i1", 5121: "<u1", 5122: "<i2", 5123: "<u2", 5125: "<u4", 5126: "<f4"}
_WIDTHS = {"SCALAR": 1, "VEC2": 2, "VEC3": 3, "VEC4": 4, "MAT2": 4, "MAT3": 9, "MAT4": 16}
_TRIANGLES = 4
#: Extensions that change no geometry, by the beginning of their names
_HARMLESS = ("KHR_materials", "KHR_texture", "KHR_lights", "EXT_texture")

ROWS = "kind string, at int, x double, y double, z double, a int, b int, c int, note string, nx double, ny double, nz double, u double, v double"


@dataclass(frozen=True)
class Ceilings:
    """What a file may ask for before it is cut off: values in one accessor, placed meshes, vertices in all, depth of the node tree."""

    elements: int = 64 << 20
    instances: int = 1 << 16
    vertices: int = 3_500_000
    depth: int = 256


@dataclass
class Mesh:
    positions: np.ndarray = field(default_factory=lambda: np.zeros((0, 3)))
    triangles: np.ndarray = field(default_factory=lambda: np.zeros((0, 3), np.int64))
    skipped: list[str] = field(default_factory=list)
    #: One a vertex, or None where a primitive of the file has none
    normals: np.ndarray | None = None
    textures: np.ndarray | None = None


def container_of(content: Column) -> Column:
    """``glb``, ``gltf-json`` or ``unknown``, by the first bytes; null for null."""
    head = F.decode(F.substring(content, 1, 64), "ISO-8859-1")
    first = F.substring(F.ltrim(F.translate(head, "\t\n\r", "   ")), 1, 1)
    return F.when((F.octet_length(content) >= 12) & (F.substring(head, 1, 4) == "glTF"), "glb").when(first == "{", "gltf-json").when(content.isNotNull(), "unknown")


def _index(x: Any) -> int | None:
    return x if isinstance(x, int) and not isinstance(x, bool) and x >= 0 else None


def _list(x: Any) -> list:
    return x if isinstance(x, list) else []


def _record(x: Any) -> dict:
    return x if isinstance(x, dict) else {}


def _pick(items: list, at: Any) -> dict:
    i = _index(at)
    return _record(items[i]) if i is not None and i < len(items) else {}


def _numbers(x: Any, n: int) -> np.ndarray | None:
    good = isinstance(x, list) and len(x) == n and all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in x)
    found = np.array(x, dtype=np.float64) if good else None
    return found if found is not None and np.isfinite(found).all() else None


def _placement(node: dict) -> np.ndarray:
    """The node's own 4 x 4 transform: its matrix, written by columns, or translation, rotation (a quaternion, normalised) and scale; what is malformed is the identity."""
    whole = _numbers(node.get("matrix"), 16)
    if whole is not None:
        return whole.reshape(4, 4).T
    out = np.eye(4)
    q = _numbers(node.get("rotation"), 4)
    if q is not None and (size := np.linalg.norm(q)) > 0:
        x, y, z, w = q / size
        cross = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
        out[:3, :3] += 2 * (w * cross + cross @ cross)
    s, t = _numbers(node.get("scale"), 3), _numbers(node.get("translation"), 3)
    if s is not None:
        out[:3, :3] *= s
    if t is not None:
        out[:3, 3] = t
    return out


def _turned(normals: np.ndarray, world: np.ndarray) -> np.ndarray:
    """Unit normals of a placed mesh: carried by the inverse transpose, so they stay at right angles to it; zeros stay zero."""
    turn = world[:3, :3]
    if np.linalg.det(turn):
        turn = np.linalg.inv(turn).T
    found = normals @ turn.T
    size = np.linalg.norm(found, axis=1, keepdims=True)
    return np.divide(found, size, out=np.zeros_like(found), where=size > 0)


class _Reader:
    def __init__(self, doc: dict, data: bytes, limits: Ceilings) -> None:
        self.doc, self.data, self.limits, self.out = doc, data, limits, Mesh()
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.normals: list[np.ndarray | None] = []
        self.textures: list[np.ndarray | None] = []
        self.vertices = self.instances = 0
        self.full = False

    def skip(self, why: str) -> None:
        if why not in self.out.skipped:
            self.out.skipped.append(why)

    def accessor(self, at: Any, kind: str) -> np.ndarray | None:
        """The values of an accessor; extents are checked before anything is allocated."""
        acc = _pick(_list(self.doc.get("accessors")), at)
        count, width, dtype = _index(acc.get("count")), _WIDTHS[kind], _COMPONENTS.get(_index(acc.get("componentType")) or 0)
        if not acc or count is None or dtype is None or acc.get("type") != kind:
            return self.skip(f"an accessor is missing, malformed or not {kind}")
        if "sparse" in acc:
            return self.skip("an accessor is sparse")
        if count * width > self.limits.elements:
            return self.skip("an accessor declares too many elements")
        if "bufferView" not in acc:
            return np.zeros((count, width))
        view = _pick(_list(self.doc.get("bufferViews")), acc["bufferView"])
        size, start, shift = _index(view.get("byteLength")), _index(view.get("byteOffset", 0)), _index(acc.get("byteOffset", 0))
        item = np.dtype(dtype).itemsize
        stride = _index(view.get("byteStride", width * item))
        if None in (size, start, shift, stride) or stride < width * item:
            return self.skip("a buffer view is malformed")
        if start + size > len(self.data) or (count and shift + (count - 1) * stride + width * item > size):
            return self.skip("an accessor runs past its buffer")
        if not count:
            return np.zeros((0, width))
        raw = np.ndarray((count, width), dtype, self.data, start + shift, (stride, item))
        found = raw.astype(np.float64)
        if not np.isfinite(found).all():
            return self.skip("an accessor holds a value that isn't finite")
        if acc.get("normalized") is True and dtype[1] in "iu" and item < 4:
            found = np.maximum(found / np.iinfo(dtype).max, -1.0)
        return found

    def attribute(self, prim: dict, name: str, kind: str, count: int) -> np.ndarray | None:
        """An attribute of each vertex; one of another length is left out and named."""
        given = _record(prim.get("attributes"))
        found = self.accessor(given[name], kind) if name in given else None
        if found is not None and len(found) != count:
            return self.skip(f"{name} has another number of values than vertices")
        return found

    def primitive(self, prim: dict, world: np.ndarray) -> None:
        if prim.get("mode", _TRIANGLES) != _TRIANGLES:
            return self.skip("a primitive isn't triangles")
        if "KHR_draco_mesh_compression" in _record(prim.get("extensions")):
            return self.skip("a primitive is compressed")
        positions = self.accessor(_record(prim.get("attributes")).get("POSITION"), "VEC3")
        if positions is None:
            return self.skip("a primitive has no positions")
        n = len(positions)
        if "indices" in prim:
            found = self.accessor(prim["indices"], "SCALAR")
            if found is None:
                return
            corners = found.ravel()
            if len(corners) and (corners.max() >= n or corners.min() < 0 or (corners % 1).any()):
                return self.skip("an index is beyond the vertices")
        else:
            corners = np.arange(n)
        if not len(corners) or len(corners) % 3:
            return self.skip("a primitive doesn't hold whole triangles")
        if self.vertices + n > self.limits.vertices:
            self.full = True
            return self.skip("the scene holds too many vertices")
        normals, textures = self.attribute(prim, "NORMAL", "VEC3", n), self.attribute(prim, "TEXCOORD_0", "VEC2", n)
        self.normals.append(None if normals is None else _turned(normals, world))
        if textures is not None and (outside := (textures < 0) | (textures > 1)).any():
            self.skip("texture coordinates outside 0 to 1 are wrapped")
            textures = np.where(outside, textures - np.floor(textures), textures)
        self.textures.append(textures)
        triangles = corners.reshape(-1, 3).astype(np.int64) + self.vertices
        # A mirror turns every face inside out, unless its corners are read the other way round
        mirrored = np.linalg.det(world[:3, :3]) < 0
        self.parts.append((positions @ world[:3, :3].T + world[:3, 3], triangles[:, [0, 2, 1]] if mirrored else triangles))
        self.vertices += n

    def visit(self) -> None:
        nodes, meshes = _list(self.doc.get("nodes")), _list(self.doc.get("meshes"))
        scenes = _list(self.doc.get("scenes"))
        if scenes:
            roots = _list(_pick(scenes, self.doc.get("scene", 0)).get("nodes"))
        else:
            below = {c for n in nodes for c in _list(_record(n).get("children")) if isinstance(c, int)}
            roots = [i for i in range(len(nodes)) if i not in below]
        todo: list[tuple[Any, np.ndarray, tuple[int, ...]]] = [(r, np.eye(4), ()) for r in reversed(roots)]
        while todo and not self.full:
            at, parent, above = todo.pop()
            node, i = _pick(nodes, at), _index(at)
            if not node:
                continue
            if i in above:
                self.skip("a node is its own ancestor")
                continue
            if len(above) >= self.limits.depth:
                self.skip("the node tree is too deep")
                continue
            world = parent @ _placement(node)
            if mesh := _pick(meshes, node.get("mesh")):
                self.instances += 1
                if self.instances > self.limits.instances:
                    self.full = True
                    self.skip("the scene places too many meshes")
                    break
                for prim in _list(mesh.get("primitives")):
                    self.primitive(_record(prim), world)
            todo += [(c, world, (*above, i)) for c in reversed(_list(node.get("children")))]


def read_glb(content: bytes | None, limits: Ceilings = Ceilings()) -> Mesh:
    """The triangles of all nodes of the scene, placed by their transforms; ``skipped`` says what was left out and why."""
    data = bytes(content or b"")
    none = lambda why: Mesh(skipped=[why])
    if len(data) < 12 or data[:4] != _MAGIC:
        return none("not a binary glTF file")
    if struct.unpack_from("<I", data, 4)[0] != 2:
        return none("another version than 2")
    chunks: dict[bytes, bytes] = {}
    at = 12
    while at + 8 <= len(data):
        size, kind = struct.unpack_from("<I4s", data, at)
        if at + 8 + size > len(data):
            return none("a chunk runs past the end")
        chunks.setdefault(kind, data[at + 8 : at + 8 + size])
        at += 8 + size + -size % 4
    try:
        doc = json.loads(chunks[_JSON].decode())
    except KeyError:
        return none("no JSON chunk")
    except (ValueError, RecursionError):
        return none("malformed JSON")
    if not isinstance(doc, dict):
        return none("the JSON isn't an object")
    for name in _list(doc.get("extensionsRequired")):
        if not str(name).startswith(_HARMLESS):
            return none(f"requires the extension {name}")
    if any("uri" in _record(b) for b in _list(doc.get("buffers"))):
        return none("a buffer is outside the file")
    reader = _Reader(doc, chunks.get(_BIN, b""), limits)
    reader.visit()
    out = reader.out
    if reader.parts:
        out.positions, out.triangles = (np.concatenate(x) for x in zip(*reader.parts, strict=True))
        # All or none of a file: a mesh with half of its normals would be lit in two ways
        whole = lambda parts: None if any(x is None for x in parts) else np.concatenate(parts)
        out.normals, out.textures = whole(reader.normals), whole(reader.textures)
    else:
        reader.skip("no triangles")
    return out


def _batch(mesh: Mesh, names: list[tuple[str, pa.DataType, Any]]) -> pa.RecordBatch:
    n, m, k = len(mesh.positions), len(mesh.triangles), len(mesh.skipped)
    total = n + m + k
    corner = lambda i: pa.concat_arrays([pa.nulls(n, pa.int32()), pa.array(mesh.triangles[:, i].astype(np.int32)), pa.nulls(k, pa.int32())])
    of_vertices = lambda x, i: pa.nulls(total, pa.float64()) if x is None else pa.concat_arrays([pa.array(np.ascontiguousarray(x[:, i])), pa.nulls(m + k, pa.float64())])
    place = lambda i: of_vertices(mesh.positions, i)
    kinds = pa.array(["vertex"] * n + ["triangle"] * m + ["skipped"] * k, pa.string())
    at = pa.array(np.concatenate((np.arange(n), np.arange(m), np.arange(k))).astype(np.int32))
    columns = [pa.array([value] * total, kind) for _, kind, value in names]
    notes = pa.concat_arrays([pa.nulls(n + m, pa.string()), pa.array(mesh.skipped, pa.string())])
    return pa.RecordBatch.from_arrays([*columns, kinds, at, *map(place, range(3)), *map(corner, range(3)), notes, *(of_vertices(mesh.normals, i) for i in range(3)), *(of_vertices(mesh.textures, i) for i in range(2))], names=[*(x[0] for x in names), *ROWS.replace(",", "").split()[::2]])


def _parse(batches: Iterator[pa.RecordBatch], limits: Ceilings) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, content in zip(batch.column(0), batch.column(1), strict=True):
            yield _batch(read_glb(content.as_py(), limits), [("_id", batch.schema.field(0).type, key.as_py())])


def parse_meshes(files: DataFrame, id_col: str, content_col: str, limits: Ceilings = Ceilings()) -> DataFrame:
    """``id_col``, kind (vertex, triangle or skipped), at, x, y, z, a, b, c, note, nx, ny, nz, u, v, one row for each of a file's parts.

    nx, ny, nz (unit normals, or zeros for those without a direction) and u, v
    (texture coordinates, wrapped into 0 to 1) are of vertices, and null in the
    whole file where one of its primitives has none. Triangles of mirrored
    nodes are turned round, so that they still face outwards.

    A null or empty content is a file that is skipped; ids pass as they are, repeated or null. An empty table gives no rows.
    """
    kind = files.schema[id_col].dataType.simpleString()
    rows = files.select(F.col(id_col).alias("_id"), F.col(content_col).alias("_content"))
    return rows.mapInArrow(partial(_parse, limits=limits), f"_id {kind}, {ROWS}").withColumnRenamed("_id", id_col)


@dataclass
class _File(InputPartition):
    path: str


class _GlbReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, place = fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith(("/", "file:")) else f"/{self.path}")
        info = store.get_file_info(place)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(place, recursive=True))
        scheme = self.path.split("://")[0] + "://" if "://" in self.path else ""
        return [_File(f"{scheme}{f.path}") for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and f.path.lower().endswith(".glb")]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, place = fs.FileSystem.from_uri(partition.path)
        with store.open_input_file(place) as file:
            yield _batch(read_glb(file.read()), [("path", pa.string(), partition.path)])


class GlbDataSource(DataSource):
    """Format ``glb``: the files ending in .glb at or below a path of any store that Arrow reads."""

    @classmethod
    def name(cls) -> str:
        return "glb"

    def schema(self) -> str:
        return f"path string, {ROWS}"

    def reader(self, schema: Any) -> DataSourceReader:
        return _GlbReader(self.options)
