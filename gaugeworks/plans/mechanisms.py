"""Queries over mesh files, document digests, robust fits, keyed samples, lobes and round logs."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import documents, graph, robust
from ..sources import meshes, rounds
from ..streaming import positions
from .ledgers import uniform_sql
from .registry import query, rounded, t

# Mesh files: 64 customers are the vertices of one; its node is moved and doubled, every seventh file is cut short


def glb_bytes(positions: np.ndarray, triangles: np.ndarray, node: dict, normals: np.ndarray | None = None, textures: np.ndarray | None = None) -> bytes:
    """A binary glTF file of one mesh under one node."""
    arrays = [("POSITION", positions.astype("<f4"), 5126, "VEC3"), ("indices", triangles.astype("<u4").ravel(), 5125, "SCALAR")]
    arrays += [(name, x.astype("<f4"), 5126, kind) for name, x, kind in (("NORMAL", normals, "VEC3"), ("TEXCOORD_0", textures, "VEC2")) if x is not None]
    data, views, accessors = b"", [], []
    for _, x, component, kind in arrays:
        views.append({"buffer": 0, "byteOffset": len(data), "byteLength": x.nbytes})
        accessors.append({"bufferView": len(accessors), "componentType": component, "count": len(x), "type": kind})
        data += x.tobytes()
    attributes = {name: i for i, (name, *_) in enumerate(arrays) if name != "indices"}
    doc = {"asset": {"version": "2.0"}, "scenes": [{"nodes": [0]}], "nodes": [{"mesh": 0} | node], "meshes": [{"primitives": [{"attributes": attributes, "indices": 1}]}], "accessors": accessors, "bufferViews": views, "buffers": [{"byteLength": len(data)}]}
    text = json.dumps(doc).encode()
    text += b" " * (-len(text) % 4)
    body = struct.pack("<I4s", len(text), b"JSON") + text + struct.pack("<I4s", len(data), b"BIN\0") + data
    return struct.pack("<4sII", b"glTF", 2, 12 + len(body)) + body


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, found = batch.column(0).to_pylist(), []
        for mesh, points in zip(ids, batch.column(1).to_pylist(), strict=True):
            positions = np.array([[p["x"], p["y"], p["z"]] for p in points])
            n = len(positions) // 3
            data = glb_bytes(positions, np.arange(3 * n).reshape(-1, 3)[:, ::-1], {"translation": [1, 2, 3], "scale": [2, 2, 2]})
            found.append(data[:-8] if mesh % 7 == 3 else data)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.binary())], names=["mesh", "content"])


@query("""
WITH v AS (SELECT c_custkey // 64 AS mesh, CAST(c_custkey % 64 AS INTEGER) AS "at", CAST(c_acctbal AS FLOAT) AS x, CAST(c_nationkey AS FLOAT) AS y, CAST(c_custkey % 10 / 4 AS FLOAT) AS z FROM customer),
n AS (SELECT mesh, count(*) AS n FROM v GROUP BY 1 HAVING count(*) >= 3), k AS (SELECT * FROM n WHERE mesh % 7 <> 3)
SELECT mesh, 'vertex' AS kind, "at", round(2 * x::DOUBLE + 1, 4) AS x, round(2 * y::DOUBLE + 2, 4) AS y, round(2 * z::DOUBLE + 3, 4) AS z, NULL::INT AS a, NULL::INT AS b, NULL::INT AS c, NULL AS note FROM v JOIN k USING (mesh)
UNION ALL SELECT mesh, 'triangle', CAST(i AS INT), NULL, NULL, NULL, CAST(3 * i + 2 AS INT), CAST(3 * i + 1 AS INT), CAST(3 * i AS INT), NULL FROM k, range(21) r(i) WHERE i < n // 3
UNION ALL SELECT mesh, 'skipped', 0, NULL, NULL, NULL, NULL, NULL, NULL, 'a chunk runs past the end' FROM n WHERE mesh % 7 = 3""")
def mesh_files(spark, sf_dir):
    point = F.struct((F.col("c_custkey") % 64).alias("i"), F.col("c_acctbal").alias("x"), F.col("c_nationkey").cast("double").alias("y"), (F.col("c_custkey") % 10 / 4).alias("z"))
    groups = t(spark, sf_dir, "customer").groupBy(F.floor(F.col("c_custkey") / 64).alias("mesh")).agg(F.array_sort(F.collect_list(point)).alias("points")).where(F.size("points") >= 3)
    files = groups.mapInArrow(_files, "mesh long, content binary").where(meshes.container_of(F.col("content")) == "glb")
    return rounded(meshes.parse_meshes(files, "mesh", "content").drop("nx", "ny", "nz", "u", "v"), 4, "x", "y", "z")


def _lit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, found = batch.column(0).to_pylist(), []
        for mesh, points in zip(ids, batch.column(1).to_pylist(), strict=True):
            p = np.array([[p["x"], p["y"], p["z"]] for p in points])
            n = len(p) // 3
            textures = np.stack([p[:, 2] / 2, p[:, 1] / 8 - 1], axis=1)
            found.append(glb_bytes(p, np.arange(3 * n).reshape(-1, 3), {"scale": [-2, 4, 1]}, p[:, [1, 2, 1]] if mesh % 4 else None, textures[:-1] if mesh % 5 == 1 else textures))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.binary())], names=["mesh", "content"])


@query("""
WITH v AS (SELECT c_custkey // 64 AS mesh, CAST(c_custkey % 64 AS INTEGER) AS "at", c_nationkey::DOUBLE AS y, (c_custkey % 10 / 4)::DOUBLE AS z FROM customer),
n AS (SELECT mesh, count(*) AS n, bool_or(y < 8 OR y > 16 OR z > 2) AS wrapped FROM v GROUP BY 1 HAVING count(*) >= 3),
w AS (SELECT mesh, "at", n, -y / 2 AS nx, z / 4 AS ny, y AS nz, z / 2 AS u, y / 8 - 1 AS v FROM v JOIN n USING (mesh)), s AS (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS size FROM w)
SELECT mesh, 'vertex' AS kind, "at", NULL::INT AS a, NULL::INT AS b, NULL::INT AS c, NULL AS note, CASE WHEN mesh % 4 > 0 THEN CASE WHEN size > 0 THEN round(nx / size, 4) + 0.0 ELSE 0.0 END END AS nx, CASE WHEN mesh % 4 > 0 THEN CASE WHEN size > 0 THEN round(ny / size, 4) + 0.0 ELSE 0.0 END END AS ny,
  CASE WHEN mesh % 4 > 0 THEN CASE WHEN size > 0 THEN round(nz / size, 4) + 0.0 ELSE 0.0 END END AS nz, CASE WHEN mesh % 5 <> 1 THEN round(CASE WHEN u BETWEEN 0 AND 1 THEN u ELSE u - floor(u) END, 4) END AS u, CASE WHEN mesh % 5 <> 1 THEN round(CASE WHEN v BETWEEN 0 AND 1 THEN v ELSE v - floor(v) END, 4) END AS v FROM s
UNION ALL SELECT mesh, 'triangle', CAST(i AS INT), CAST(3 * i AS INT), CAST(3 * i + 2 AS INT), CAST(3 * i + 1 AS INT), NULL, NULL, NULL, NULL, NULL, NULL FROM n, range(21) r(i) WHERE i < n // 3
UNION ALL SELECT mesh, 'skipped', 0, NULL, NULL, NULL, CASE WHEN mesh % 5 = 1 THEN 'TEXCOORD_0 has another number of values than vertices' ELSE 'texture coordinates outside 0 to 1 are wrapped' END, NULL, NULL, NULL, NULL, NULL FROM n WHERE wrapped OR mesh % 5 = 1""")
def mesh_shading(spark, sf_dir):
    """Normals and texture coordinates of mirrored, stretched meshes; a quarter has no normals, a fifth too few coordinates."""
    point = F.struct((F.col("c_custkey") % 64).alias("i"), F.col("c_acctbal").alias("x"), F.col("c_nationkey").cast("double").alias("y"), (F.col("c_custkey") % 10 / 4).alias("z"))
    groups = t(spark, sf_dir, "customer").groupBy(F.floor(F.col("c_custkey") / 64).alias("mesh")).agg(F.array_sort(F.collect_list(point)).alias("points")).where(F.size("points") >= 3)
    found = meshes.parse_meshes(groups.mapInArrow(_lit, "mesh long, content binary"), "mesh", "content").drop("x", "y", "z")
    return rounded(found, 4, "nx", "ny", "nz", "u", "v")


# Documents: the properties of an event, wrapped with its type and value


def _documents(spark: SparkSession, sf_dir: str, shift: int) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    moved = F.when(F.col("event_id") % 3 == 0, k + shift).otherwise(k)
    extra = F.when((F.col("event_id") % 5 == 0) & F.lit(shift > 0), F.lit(',"new":[true]')).otherwise("")
    text = F.concat(F.lit('{ "type": "'), "event_type", F.lit('", "props": {"k": '), moved.cast("string"), F.lit('}, "runs": [{"id": "a", "v": 1.0}, {"v": null}]'), extra, F.lit("}"))
    return t(spark, sf_dir, "events").select("event_id", text.alias("doc"))


_DOCS = """
WITH e AS (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
f AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN k + 1 ELSE k END AS j FROM e),
"""
_RUNS = '[{"id":"a","v":1},{"v":null}]'


@query(_DOCS + f"""
d AS (SELECT event_id, '{{"type":"' || event_type || '","props":{{"k":' || k || '}},"runs":{_RUNS}}}' AS t0, event_type, k FROM e),
p AS (SELECT event_id, unnest([{{'place': 0, 'path': '$', 'depth': 0, 'leaf': false, 'text': t0}}, {{'place': 1, 'path': '$.type', 'depth': 1, 'leaf': true, 'text': '"' || event_type || '"'}}, {{'place': 2, 'path': '$.props', 'depth': 1, 'leaf': false, 'text': '{{"k":' || k || '}}'}},
  {{'place': 3, 'path': '$.props.k', 'depth': 2, 'leaf': true, 'text': k::VARCHAR}}, {{'place': 4, 'path': '$.runs', 'depth': 1, 'leaf': false, 'text': '{_RUNS}'}}, {{'place': 5, 'path': '$.runs[a]', 'depth': 2, 'leaf': false, 'text': '{{"id":"a","v":1}}'}},
  {{'place': 6, 'path': '$.runs[a].id', 'depth': 3, 'leaf': true, 'text': '"a"'}}, {{'place': 7, 'path': '$.runs[a].v', 'depth': 3, 'leaf': true, 'text': '1'}}, {{'place': 8, 'path': '$.runs[#1]', 'depth': 2, 'leaf': false, 'text': '{{"v":null}}'}}, {{'place': 9, 'path': '$.runs[#1].v', 'depth': 3, 'leaf': true, 'text': 'null'}}]) AS r FROM d)
SELECT event_id, r.place, r.path, r.depth, r.leaf, r.text, left(sha256(r.text), 16) AS digest FROM p""")
def document_digests(spark, sf_dir):
    return documents.digests(_documents(spark, sf_dir, 0), ["event_id"], "doc")


@query(_DOCS + """
c AS (SELECT event_id, k, j, event_id % 3 = 0 AS moved, event_id % 5 = 0 AS grown FROM f),
m AS (SELECT event_id, '$.props.k' AS path, 2 AS depth, k::VARCHAR AS want_text, j::VARCHAR AS got_text FROM c WHERE moved UNION ALL SELECT event_id, '$.props', 1, '{"k":' || k || '}', '{"k":' || j || '}' FROM c WHERE moved
  UNION ALL SELECT event_id, '$.new', 1, NULL, '[true]' FROM c WHERE grown UNION ALL SELECT event_id, '$.new[#0]', 2, NULL, 'true' FROM c WHERE grown UNION ALL SELECT event_id, '$', 0, NULL, NULL FROM c WHERE moved OR grown)
SELECT event_id, CAST(row_number() OVER (PARTITION BY event_id ORDER BY depth DESC, path) AS INT) AS rank, path, depth, CASE WHEN depth > 0 THEN want_text END AS want_text, CASE WHEN depth > 0 THEN got_text END AS got_text FROM m""")
def moved_parts(spark, sf_dir):
    found = documents.moved_documents(_documents(spark, sf_dir, 0), _documents(spark, sf_dir, 1), ["event_id"], "doc")
    deep = lambda c: F.when(F.col("depth") > 0, F.col(c)).alias(c)
    return found.select("event_id", "rank", "path", "depth", deep("want_text"), deep("got_text"))


# A line through prices with gross errors, by Huber's loss in six rounds


def _fit_sql(rounds_: int) -> str:
    rows = "WITH d AS (SELECT l_quantity AS x, 3 + 2 * l_quantity + (l_partkey % 11 - 5) / 10.0::DOUBLE + CASE WHEN l_suppkey % 7 = 0 THEN l_extendedprice ELSE 0 END AS y, 0.5::DOUBLE AS s FROM lineitem WHERE l_linenumber <> 4)"
    text, beta = rows, "SELECT 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1"
    for i in range(rounds_):
        weight = "1.0::DOUBLE" if i == 0 else "CASE WHEN abs((y - b0 - b1 * x) / s) > 1.345 THEN 1.345::DOUBLE / abs((y - b0 - b1 * x) / s) ELSE 1 END"
        text += f", w{i} AS (SELECT x, y, {weight} / (s * s) AS w FROM d, ({beta})), f{i} AS (SELECT sum(w) AS a, sum(w * x) AS b, sum(w * x * x) AS c, sum(w * y) AS g, sum(w * x * y) AS h FROM w{i})"
        beta = f"SELECT (c * g - b * h) / (a * c - b * b) AS b0, (a * h - b * g) / (a * c - b * b) AS b1 FROM f{i}"
    return text + f" SELECT 0 AS term, round(b0, 4) AS value FROM ({beta}) UNION ALL SELECT 1, round(b1, 4) FROM ({beta})"


@query(_fit_sql(6))
def robust_line(spark, sf_dir):
    line = t(spark, sf_dir, "lineitem")
    wrong = F.when(F.col("l_suppkey") % 7 == 0, F.col("l_extendedprice")).otherwise(0.0)
    y = F.when(F.col("l_linenumber") == 4, float("nan")).otherwise(3 + 2 * F.col("l_quantity") + (F.col("l_partkey") % 11 - 5) / 10 + wrong)
    found = robust.robust_fit(line.select("l_quantity", y.alias("y")), ["l_quantity"], "y", 0.5, rounds=6, tolerance=0.0)
    return rounded(found.select("term", "value"), 4, "value")


# Samples: five orders of each customer, seeded by the customer's segment letter and key


@query(f"""
WITH o AS (SELECT o_custkey, o_orderkey, {uniform_sql('17', 'o_custkey', 'o_orderkey')} AS u FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY u, o_orderkey) - 1 AS draw FROM o)
SELECT o_custkey, o_orderkey, CAST(draw AS INT) AS draw FROM r WHERE draw < 5""")
def distinct_draws(spark, sf_dir):
    orders = t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return robust.draw_distinct(orders, ["o_custkey"], ["o_custkey", "o_orderkey"], 5, 17)


_LOBES = """
WITH RECURSIVE d AS (SELECT c_nationkey AS g, c_custkey AS o, c_acctbal AS v FROM customer WHERE c_custkey % 6 > 0),
c AS (SELECT g, list(v ORDER BY o) AS vs FROM d GROUP BY 1), m AS (SELECT g, vs, len(vs) AS n, list_position(vs, list_min(vs)) - 1 AS s FROM c),
f AS (SELECT g, vs, n, s, 0 AS k, 1 AS dir, vs[s + 1] AS e, 0 AS i, []::INT[] AS found FROM m WHERE n >= 4
  UNION ALL SELECT g, vs, n, s, k + 1, CASE WHEN turn THEN -dir ELSE dir END, CASE WHEN further OR turn THEN x ELSE e END, CASE WHEN further OR turn THEN k + 1 ELSE i END, CASE WHEN turn AND dir = -1 THEN list_append(found, CAST(i AS INT)) ELSE found END
  FROM (SELECT *, CASE WHEN dir = 1 THEN x > e ELSE x < e END AS further, NOT CASE WHEN dir = 1 THEN x > e ELSE x < e END AND abs(x - e) > 2000 AS turn FROM (SELECT *, vs[(k + 1 + s) % n + 1] AS x FROM f WHERE k < n))),
l AS (SELECT g, s, n, CASE WHEN dir = -1 THEN list_append(found, CAST(i AS INT)) ELSE found END AS found FROM f WHERE k = n)
SELECT g AS c_nationkey, CAST(m.n AS INT) AS n, len(coalesce(list_distinct(list_transform(l.found, lambda i: (i + l.s) % l.n)), [])) AS lobes, list_sum(list_distinct(list_transform(l.found, lambda i: (i + l.s) % l.n)))::BIGINT AS places FROM m LEFT JOIN l USING (g)
"""


@query(_LOBES)
def curve_lobes(spark, sf_dir):
    found = robust.lobes(t(spark, sf_dir, "customer").where("c_custkey % 6 > 0"), ["c_nationkey"], "c_custkey", "c_acctbal", 2000)
    total = F.aggregate("minima", F.lit(0).cast("long"), lambda s, i: s + i)
    return found.select("c_nationkey", "n", F.size("minima").cast("long").alias("lobes"), F.when(F.size("minima") > 0, total).alias("places"))


# Rounds: a log file for each supplier, with a record an order line of theirs; some are torn, foreign or malformed


@query("""
WITH r AS (SELECT l_suppkey AS s, l_orderkey % 40 AS round, l_orderkey AS version, l_linenumber, l_discount > 0.07 AS improving, l_tax > 0.01 AS qualified, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS line, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem),
g AS (SELECT * FROM r WHERE NOT (line = n AND s % 3 = 0) AND line % 50 <> 7 AND line % 50 <> 9),
b AS (SELECT *, row_number() OVER (PARTITION BY s, round ORDER BY version DESC, line DESC) AS newest FROM g), k AS (SELECT * FROM b WHERE newest = 1),
e AS (SELECT *, sum(improving::INT) OVER (PARTITION BY s ORDER BY round) AS era FROM k)
SELECT s AS file, round, version, improving, CAST(sum((qualified AND NOT improving)::INT) OVER (PARTITION BY s, era ORDER BY round) AS BIGINT) AS streak FROM e""")
def round_history(spark, sf_dir):
    c = F.col
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey")
    lines = t(spark, sf_dir, "lineitem").withColumns({"line": F.row_number().over(w), "n": F.count("*").over(Window.partitionBy("l_suppkey"))})
    # A round is one of its file here: file and round in one number.
    number = c("l_suppkey") * 40 + c("l_orderkey") % 40
    print_ = F.when(c("line") % 50 == 7, "other").otherwise("same")
    record = F.to_json(F.struct(number.alias("round"), c("l_orderkey").alias("version"), print_.alias("fingerprint"), (c("l_discount") > 0.07).alias("improving"), (c("l_tax") > 0.01).alias("qualified")))
    text = F.when((c("line") == c("n")) & (c("l_suppkey") % 3 == 0), F.substring(record, 1, 25)).when(c("line") % 50 == 9, "not a record").otherwise(record)
    files = lines.groupBy("l_suppkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", text.alias("text")))), lambda s: s["text"]), "\n").alias("text"))
    records, _ = rounds.parse_rounds(files.withColumn("file", F.format_string("%08d", "l_suppkey")), "file", "text", "same")
    named = records.select(F.floor(c("round") / 40).alias("file"), (c("round") % 40).alias("round"), "version", "improving", "qualified")
    return robust.streaks(named, ["file"], "round", c("improving"), c("qualified")).drop("qualified")


@query("""
WITH r AS (SELECT l_suppkey AS s, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS line, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem)
SELECT file, problem, count(*) AS lines FROM (SELECT s AS file, CASE WHEN line = n AND s % 3 = 0 THEN 'torn' WHEN line % 50 = 9 THEN CASE WHEN line = n THEN 'torn' ELSE 'malformed' END WHEN line % 50 = 7 THEN 'foreign' END AS problem FROM r) WHERE problem IS NOT NULL GROUP BY 1, 2""")
def refused_lines(spark, sf_dir):
    c = F.col
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey")
    lines = t(spark, sf_dir, "lineitem").withColumns({"line": F.row_number().over(w), "n": F.count("*").over(Window.partitionBy("l_suppkey"))})
    record = F.to_json(F.struct(c("l_orderkey").alias("round"), c("line").alias("version"), F.when(c("line") % 50 == 7, "other").otherwise("same").alias("fingerprint")))
    text = F.when((c("line") == c("n")) & (c("l_suppkey") % 3 == 0), F.substring(record, 1, 25)).when(c("line") % 50 == 9, "not a record").otherwise(record)
    files = lines.groupBy("l_suppkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", text.alias("text")))), lambda s: s["text"]), "\n").alias("text"))
    _, refused = rounds.parse_rounds(files, "l_suppkey", "text", "same")
    return refused.groupBy("file", "problem").agg(F.count("*").alias("lines"))


# A sheet of 40 columns, whose nodes are the customers, and how far each is from its rim


@query("""
WITH n AS (SELECT c_custkey AS i, c_custkey % 40 AS x, c_custkey // 40 AS y FROM customer), k AS (SELECT max(i) AS last FROM n),
t AS (SELECT i AS a, i + 1 AS b, i + 40 AS c FROM n, k WHERE x < 39 AND i + 41 <= last UNION ALL SELECT i + 1, i + 41, i + 40 FROM n, k WHERE x < 39 AND i + 41 <= last),
e AS (SELECT least(p, q) AS p, greatest(p, q) AS q FROM (SELECT a AS p, b AS q FROM t UNION ALL SELECT b, c FROM t UNION ALL SELECT c, a FROM t)),
r AS (SELECT p, q FROM e GROUP BY ALL HAVING count(*) = 1), b AS (SELECT DISTINCT v % 40 AS x, v // 40 AS y FROM (SELECT p AS v FROM r UNION ALL SELECT q FROM r)),
u AS (SELECT DISTINCT v AS i, v % 40 AS x, v // 40 AS y FROM (SELECT p AS v FROM e UNION ALL SELECT q FROM e))
SELECT u.i AS node, round(min(CASE WHEN (u.x - b.x) * (u.y - b.y) < 0 THEN sqrt(2.0) * least(abs(u.x - b.x), abs(u.y - b.y)) + abs(abs(u.x - b.x) - abs(u.y - b.y)) ELSE abs(u.x - b.x) + abs(u.y - b.y) END), 6) AS distance FROM u, b GROUP BY 1""")
def rim_distances(spark, sf_dir):
    i = F.col("c_custkey")
    customer = t(spark, sf_dir, "customer")
    vertices = customer.select(F.lit(0).alias("mesh"), i.alias("i"), (i % 40).alias("x"), F.floor(i / 40).alias("y"), F.lit(0.0).alias("z"))
    last = customer.agg(F.max("c_custkey").alias("last"))
    cells = vertices.crossJoin(F.broadcast(last)).where((F.col("x") < 39) & (F.col("i") + 41 <= F.col("last")))  # one row
    corner = lambda *steps: F.struct(*((F.col("i") + s).alias(n) for s, n in zip(steps, "abc", strict=True)))
    triangles = cells.select("mesh", F.explode(F.array(corner(0, 1, 40), corner(1, 41, 40))).alias("t")).select("mesh", "t.*")
    return rounded(graph.boundary_distances(vertices, triangles, "mesh", "i", 1e-6).select("node", "distance"), 6, "distance")


@query("""
WITH e AS (SELECT l_orderkey // 20 AS session, row_number() OVER (PARTITION BY l_orderkey // 20 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS seq, 'plan' || (l_orderkey // 9 % 3) AS plan, CASE WHEN l_orderkey % 9 <> 0 OR l_linenumber <> 1 THEN l_linenumber END AS camera, l_partkey % 4 AS k FROM lineitem),
p AS (SELECT *, max(CASE WHEN camera IS NULL THEN seq END) OVER (PARTITION BY session ORDER BY seq) AS epoch FROM e), l AS (SELECT session, max(epoch) AS latest FROM p GROUP BY 1),
a AS (SELECT p.*, p.camera IS NOT NULL AND coalesce(p.plan = s.plan, false) AS ok FROM p LEFT JOIN e s ON s.session = p.session AND s.seq = p.epoch), g AS (SELECT session, epoch, seq, camera, k FROM a WHERE ok),
n AS (SELECT x.session, x.epoch, x.seq, x.camera, x.k, min(y.seq) AS gone FROM g x LEFT JOIN g y ON y.session = x.session AND y.epoch = x.epoch AND y.seq > x.seq AND (y.camera = x.camera OR y.k = x.k) GROUP BY ALL),
c AS (SELECT session, gone AS seq, camera AS other, k AS was FROM n WHERE gone IS NOT NULL)
SELECT a.session, a.seq, a.camera, CASE WHEN a.camera IS NULL THEN 'plan' WHEN NOT ok THEN 'other-plan' WHEN other IS NULL THEN 'added' WHEN other = a.camera THEN 'replaced' ELSE 'moved' END AS change, c.other, CASE WHEN other IS NULL THEN 0 ELSE CASE abs(was - a.k) WHEN 0 THEN 6 WHEN 1 THEN 3 ELSE 0 END END AS shared,
  coalesce(ok AND n.gone IS NULL AND a.epoch = l.latest, false) AS held FROM a JOIN l ON l.session = a.session LEFT JOIN n ON n.session = a.session AND n.seq = a.seq LEFT JOIN c ON ok AND c.session = a.session AND c.seq = a.seq""")
def held_positions(spark, sf_dir):
    """Sessions of twenty orders each: lines hold positions, the first line of every ninth order loads a plan."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    seq = F.row_number().over(Window.partitionBy("session").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")).cast("long")
    photographs = F.array(*(F.concat(F.lit("p"), (F.col("l_partkey") % 4 * 3 + i).cast("string")) for i in range(6)))
    # The session is a column before its window, whose partitioning the next window then reuses; texts are made after the shuffle.
    lines = t(spark, sf_dir, "lineitem").withColumn("session", F.floor(k / 20)).withColumn("seq", seq)
    events = lines.select("session", "seq", F.concat(F.lit("plan"), (F.floor(k / 9) % 3).cast("string")).alias("plan"), F.when((k % 9 != 0) | (n != 1), n).cast("int").alias("camera"), photographs.alias("photographs"))
    return positions.position_changes(events)
