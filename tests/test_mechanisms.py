"""Mesh files, document digests, robust fits, keyed samples, lobes and round logs, case by case."""

import json
import math
import random
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gaugeworks.functions.draws import hash_word
from gaugeworks.operators import documents, graph, robust
from gaugeworks.plans.mechanisms import glb_bytes
from gaugeworks.sources import meshes, rounds
from gaugeworks.streaming import positions

POINTS = np.array([[0.0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1]])
FACES = np.array([[0, 1, 2], [0, 2, 3]])


def changed(change, node=None):
    """The file with its JSON changed."""
    data = glb_bytes(POINTS, FACES, node or {})
    size = struct.unpack_from("<I", data, 12)[0]
    doc = json.loads(data[20 : 20 + size])
    change(doc)
    text = json.dumps(doc).encode()
    text += b" " * (-len(text) % 4)
    body = struct.pack("<I4s", len(text), b"JSON") + text + data[20 + size :]
    return struct.pack("<4sII", b"glTF", 2, 12 + len(body)) + body


def test_a_mesh_is_placed_by_its_nodes():
    turn = {"translation": [10, 0, 0], "rotation": [0, 0, 0.5**0.5, 0.5**0.5], "scale": [2, 3, 4]}
    mesh = meshes.read_glb(glb_bytes(POINTS, FACES, turn))
    assert np.allclose(mesh.positions, [[10, 0, 0], [10, 2, 0], [7, 0, 0], [10, 0, 4]]) and mesh.triangles.tolist() == FACES.tolist() and not mesh.skipped
    matrix = [2, 0, 0, 0, 0, 2, 0, 0, 0, 0, 2, 0, 5, 6, 7, 1]
    assert np.allclose(meshes.read_glb(glb_bytes(POINTS, FACES, {"matrix": matrix})).positions, POINTS * 2 + [5, 6, 7])

    def nest(doc):
        doc["nodes"] = [{"children": [1, 2], "translation": [0, 0, 1]}, {"mesh": 0}, {"mesh": 0, "scale": [2, 2, 2]}]

    both = meshes.read_glb(changed(nest))
    assert len(both.positions) == 8 and both.triangles[2:].min() == 4 and np.allclose(both.positions[4:], POINTS * 2 + [0, 0, 1])


def node(key, value):
    return lambda d: d["nodes"][0].__setitem__(key, value)


def put(*path_and_value):
    *path, last, value = path_and_value

    def change(d):
        for k in path:
            d = d[k]
        d[last] = value

    return change


SURVIVE = [node("children", 5), node("children", "abc"), node("translation", 4), node("rotation", [0, 0]), node("rotation", [0, 0, 0, 0]), node("matrix", "abcdefghijklmnop"), node("children", [0]), node("children", [99, -1, None, True]), put("buffers", {}), put("buffers", [None]), lambda d: d.pop("scenes")]
EMPTY = [
    put("meshes", 0, "primitives", 7), lambda d: d["meshes"][0]["primitives"][0].pop("attributes"), put("meshes", 0, "primitives", 0, "attributes", "x"), put("scenes", 0, "nodes", 3), put("accessors", "no"), put("bufferViews", 0, "byteLength", "lots"),
    put("meshes", [None]), put("meshes", 0, "primitives", [None]), put("accessors", 0, "count", -1), put("accessors", 0, "count", 1.5), put("accessors", 0, "count", 10**9), put("accessors", 0, "type", "VEC4"), put("accessors", 0, "componentType", 1), put("accessors", 0, "sparse", {}),
    put("accessors", 1, "count", 5), put("accessors", 1, "count", 999), put("accessors", 0, "count", 3), put("bufferViews", 0, "byteOffset", 10**6), put("bufferViews", 0, "byteStride", 4), put("meshes", 0, "primitives", 0, "mode", 1), put("buffers", [{"uri": "x.bin"}]), put("extensionsRequired", ["KHR_draco_mesh_compression"]),
    put("meshes", 0, "primitives", 0, "extensions", {"KHR_draco_mesh_compression": {}}), put("nodes", "x"),
]


@pytest.mark.parametrize("change", SURVIVE)
def test_malformed_parts_leave_the_rest(change):
    assert len(meshes.read_glb(changed(change)).triangles) == 2


@pytest.mark.parametrize("change", EMPTY)
def test_what_is_malformed_is_a_report(change):
    mesh = meshes.read_glb(changed(change))
    assert len(mesh.triangles) == len(mesh.positions) == 0 and mesh.skipped


def test_files_that_are_no_meshes():
    good = glb_bytes(POINTS, FACES, {})
    for data in (None, b"", b"glTF", b"{}" * 20, good[:30], good[:4] + struct.pack("<I", 1) + good[8:], good[:12] + good[12:16] + b"XXXX" + good[20:], good[:20] + b"!" + good[21:]):
        assert meshes.read_glb(data).skipped and not len(meshes.read_glb(data).triangles)
    nan = bytearray(good)
    nan[-4 * 6 - 12 : -4 * 6 - 8] = struct.pack("<f", float("nan"))
    assert "an accessor holds a value that isn't finite" in meshes.read_glb(bytes(nan)).skipped


def test_ceilings():
    deep = changed(put("nodes", [{"children": [i + 1]} for i in range(9)] + [{"mesh": 0}]))
    many = changed(put("nodes", [{"children": [1] * 50}, {"mesh": 0}]))
    assert len(meshes.read_glb(deep).triangles) == 2
    assert meshes.read_glb(deep, meshes.Ceilings(depth=5)).skipped == ["the node tree is too deep", "no triangles"]
    assert len(meshes.read_glb(many).positions) == 200
    assert len(meshes.read_glb(many, meshes.Ceilings(instances=10)).positions) == 40
    cut = meshes.read_glb(many, meshes.Ceilings(vertices=41))
    assert len(cut.positions) == 40 and cut.skipped == ["the scene holds too many vertices"]
    assert meshes.read_glb(many, meshes.Ceilings(elements=11)).skipped[0] == "an accessor declares too many elements"


def test_glb_data_source_and_containers(spark, tmp_path):
    spark.dataSource.register(meshes.GlbDataSource)
    (tmp_path / "deeper").mkdir()
    (tmp_path / "one.glb").write_bytes(glb_bytes(POINTS, FACES, {}))
    (tmp_path / "deeper" / "two.GLB").write_bytes(b"{}")
    (tmp_path / "no.txt").write_text("x")
    got = spark.read.format("glb").load(str(tmp_path))
    assert got.rdd.getNumPartitions() == 2
    kinds = {tuple(r) for r in got.groupBy(F.regexp_extract("path", "[^/]*$", 0), "kind").count().collect()}
    assert kinds == {("one.glb", "vertex", 4), ("one.glb", "triangle", 2), ("two.GLB", "skipped", 1)}
    assert spark.read.format("glb").load(str(tmp_path / "one.glb")).where("kind = 'triangle'").select("a", "b", "c").collect() == [(0, 1, 2), (0, 2, 3)]
    files = spark.createDataFrame([(1, glb_bytes(POINTS, FACES, {})), (2, b" \n\t{\"a\":1}"), (3, b"PK"), (4, b"glTF"), (5, b""), (6, None)], "id int, content binary")
    assert [r[0] for r in files.orderBy("id").select(meshes.container_of(F.col("content"))).collect()] == ["glb", "gltf-json", "unknown", "unknown", "unknown", None]
    assert meshes.parse_meshes(files, "id", "content").groupBy("id").count().count() == 6
    assert meshes.parse_meshes(files.limit(0), "id", "content").count() == 0


# Documents


def test_digests_of_any_depth(spark):
    doc = '{"b": 1.0, "a": [{"id": "x", "v": [1, {"w": "é\\n"}]}, {"id": "y"}, {"id": "y"}, 3e400], "c": {}}'
    docs = spark.createDataFrame([(1, doc), (2, None), (3, "{oops"), (None, "7"), (1, "[]")], "k int, j string")
    got = documents.digests(docs, ["k"], "j").collect()
    rows = [r for r in got if r["k"] == 1 and r["place"] >= 0]
    paths = {r["path"]: (r["text"], r["leaf"]) for r in rows}
    assert {*paths} == {"$", "$.b", "$.a", "$.a[x]", "$.a[x].id", "$.a[x].v", "$.a[x].v[#0]", "$.a[x].v[#1]", "$.a[x].v[#1].w", "$.a[#1]", "$.a[#1].id", "$.a[#2]", "$.a[#2].id", "$.a[#3]", "$.c"}
    assert paths["$.b"] == ("1", True) and paths["$.a[x].v"] == ('[1,{"w":"é\\n"}]', False) and paths["$.a[#3]"] == ("null", True) and paths["$.c"] == ("{}", True)
    assert [(r["path"], r["digest"]) for r in got if r["k"] == 3] == [("$", None)] and not [r for r in got if r["k"] == 2]
    assert [r["text"] for r in got if r["k"] is None] == ["7"]
    assert documents.digests(docs.limit(0), ["k"], "j").count() == 0


def test_moved_paths_deepest_first(spark):
    make = lambda *docs: documents.digests(spark.createDataFrame([*docs], "k int, j string"), ["k"], "j")
    want = make((1, '{"a": {"b": 1, "c": 2}, "d": 3}'), (2, "[1]"), (3, "bad"), (None, "1"), (5, '{"runs": [{"id": "p", "n": 1}]}'))
    got = make((1, '{"a": {"b": 1, "c": 5}, "e": 4}'), (2, "[1]"), (3, "{}"), (None, "2"), (5, '{"runs": [{"id": "new"}, {"id": "p", "n": 1}]}'))
    moved = documents.moved_paths(want, got, ["k"]).collect()
    by = lambda k: [r["path"] for r in sorted((r for r in moved if r["k"] == k), key=lambda r: r["rank"])]
    assert by(1) == ["$.a.c", "$.a", "$.d", "$.e", "$"] and by(2) == [] and by(3) == ["$"] and by(None) == ["$"]
    assert by(5) == ["$.runs[new].id", "$.runs[new]", "$.runs", "$"]  # p keeps its name
    first = {r["k"]: (r["path"], r["want_text"], r["got_text"]) for r in documents.first_difference(want, got, ["k"]).collect()}
    assert first[1] == ("$.a.c", "2", "5") and 2 not in first


def test_documents_compared_whole_move_as_their_parts_do(spark):
    make = lambda *docs: spark.createDataFrame([*docs], "k int, j string")
    want = make((1, '{"a": {"b": 1, "c": 2}, "d": 3}'), (2, "[1]"), (3, "bad"), (4, "bad"), (5, None), (None, "1"), (6, '{"a.b": 1, "a": {"b": 2}}'), (8, "[[[1.0]]]"), (9, "worse"))
    got = make((1, '{"a": {"b": 1, "c": 5}, "e": 4}'), (2, "[1.0]"), (3, "{}"), (4, "worse"), (5, "{}"), (None, "2"), (6, '{"a.b": 1, "a": {"b": 3}}'), (7, '"\u00e9"'), (8, "[[[2]]]"))
    rows = lambda df: sorted(map(tuple, df.drop("rank").collect()), key=str)
    whole = documents.moved_documents(want, got, ["k"], "j")
    assert rows(whole) == rows(documents.moved_paths(documents.digests(want, ["k"], "j"), documents.digests(got, ["k"], "j"), ["k"])) != []
    assert [r["path"] for r in whole.where("k = 1").orderBy("rank").collect()] == ["$.a.c", "$.a", "$.d", "$.e", "$"] and whole.where("k IN (2, 4)").count() == 0
    assert documents.moved_documents(want.limit(0), got.limit(0), ["k"], "j").count() == 0


# Robust fits


def test_robust_fit_comes_back_from_gross_errors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 2))
    y = 1.5 - 2 * x[:, 0] + 0.5 * x[:, 1] + rng.normal(scale=0.1, size=600)
    y[:120] += rng.uniform(5, 50, 120)
    rows = [(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)] + [(float("nan"), 1.0, 1.0), (1.0, None, 1.0), (1.0, 1.0, float("inf"))]
    df = spark.createDataFrame(rows, "x0 double, r double, y double").repartition(5)
    found = robust.robust_fit(df, ["x0", "r"], "y", 0.1).collect()
    beta = np.array([r["value"] for r in sorted(found, key=lambda r: r["term"])])
    assert np.abs(beta - [1.5, -2, 0.5]).max() < 0.05 and found[0]["gradient"] <= 1e-9 and found[0]["rounds"] < 50
    a = np.column_stack([np.ones(600), x])
    r = (y - a @ beta) / 0.1
    assert np.abs(a.T @ (np.clip(r, -robust.HUBER, robust.HUBER) / 0.1)).max() / 600 < 1e-6  # the loss is at its least there
    weighted = robust.robust_fit(df, ["x0", "r"], "y", F.when(F.col("x0") > 0, 0.1).otherwise(-1.0), rounds=3).collect()
    assert len(weighted) == 3
    assert [r["value"] for r in robust.robust_fit(df.limit(0), ["x0"], "y").collect()] == [0.0, 0.0]


def test_draw_distinct(spark):
    rows = [(g, i) for g, n in (("a", 3000), ("b", 40), ("c", 2), (None, 30)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, i long")
    draw = lambda d, seed=3: {tuple(r) for r in robust.draw_distinct(d, ["g"], ["i"], 4, seed).select("g", "draw", "i").collect()}
    got = draw(df)
    assert draw(df.repartition(7)) == got == draw(df.union(df).repartition(3)) and draw(df, 4) != got
    assert {g: sum(x[0] == g for x in got) for g in ("a", "b", "c", None)} == {"a": 4, "b": 4, "c": 2, None: 4}
    firsts = [min(draw(df.where("g = 'b'"), s), key=lambda x: x[1])[2] for s in range(40)]
    assert len({*firsts}) > 15


def test_text_seeds(spark):
    def fold(seed, text):
        def mixed(h):
            h ^= h >> 16
            h = h * 0x85EBCA6B & 0xFFFFFFFF
            h ^= h >> 13
            h = h * 0xC2B2AE35 & 0xFFFFFFFF
            return h ^ h >> 16

        for c in text:
            seed = mixed((seed ^ ord(c)) + 0x9E3779B9 & 0xFFFFFFFF)
        return seed

    labels = ["", "a", "b", "round:1", "round:2", "é"]
    got = spark.createDataFrame([(x,) for x in [*labels, None]], "s string").select(robust.text_seed(7, F.col("s"))).collect()
    assert [r[0] for r in got] == [fold(7, x) for x in labels] + [None]
    assert hash_word is not None


def plain_lobes(v, tol):
    """Minima of a closed curve: walk from the least value, and note each turn that the curve has left by more than tol."""
    if len(v) < 4:
        return []
    s = v.index(min(v))
    turned, rising, best, at, found = v[s:] + v[: s + 1], True, v[s], 0, []
    for k, x in enumerate(turned):
        if (x > best) if rising else (x < best):
            best, at = x, k
        elif abs(x - best) > tol:
            if not rising:
                found.append(at)
            rising, best, at = not rising, x, k
    return sorted({(i + s) % len(v) for i in (found if rising else [*found, at])})


def test_lobes(spark):
    rng = np.random.default_rng(5)
    curves = {"sine": [round(float(np.cos(2 * np.pi * 6 * i / 72 + 0.4)), 6) for i in range(72)], "flat": [1.0] * 9, "short": [1.0, 0.0, 1.0], "equal": [0.0, 5.0, 0.0, 5.0], "step": [0.0, 0.0, 1.0, 1.0]}
    curves |= {f"walk{i}": [float(x) for x in np.cumsum(rng.integers(-3, 4, 40))] for i in range(12)}
    df = spark.createDataFrame([(k, i, x) for k, v in curves.items() for i, x in enumerate(v)] + [("flat", 99, float("nan")), ("none", 0, None)], "g string, i int, v double").repartition(4)
    got = {r["g"]: r["minima"] for r in robust.lobes(df, ["g"], "i", "v", 0.05).collect()}
    assert len(got["sine"]) == 6 and got["flat"] == got["short"] == got["none"] == [] and got["equal"] == [0, 2]
    assert got == {k: plain_lobes(v, 0.05) for k, v in curves.items()} | {"none": []}
    wide = {r["g"]: r["minima"] for r in robust.lobes(df, ["g"], "i", "v", 2.5).collect()}
    assert wide == {k: plain_lobes(v, 2.5) for k, v in curves.items()} | {"none": []}


# Round logs


def record(n, version=1, mark="p", **more):
    return json.dumps({"round": n, "version": version, "fingerprint": mark} | more)


def test_parse_rounds(spark):
    texts = {"a": [record(0, improving=True), "", record(1, value=1.5), "{bad}", record(2, mark="other"), record(1, 2, value=2.5)], "b": [record(1, 2, value=9.0), record(4, qualified=True), record(5)[:14]], "c": [record(-1), '{"round": 3}', "[1]"]}
    files = spark.createDataFrame([(k, "\n".join(v) + ("\n" if k != "b" else "")) for k, v in texts.items()] + [("d", None)], "f string, t string")
    records, refused = rounds.parse_rounds(files, "f", "t", "p")
    assert {(r["round"], r["version"], r["value"]) for r in records.collect()} == {(0, 1, None), (1, 2, 9.0), (4, 1, None)}
    assert {tuple(r) for r in refused.collect()} == {("a", 3, "malformed"), ("a", 4, "foreign"), ("b", 2, "torn"), ("c", 0, "malformed"), ("c", 1, "malformed"), ("c", 2, "malformed")}
    assert rounds.next_round(records) == 5 and rounds.next_round(records.limit(0)) == 0


def test_two_writers_and_a_retry_leave_one_record_a_round(spark, tmp_path):
    path = str(tmp_path / "log")
    frame = lambda *r: spark.createDataFrame([*r], "round long, version long, fingerprint string, value double")
    rounds.append_rounds(frame((0, 1, "p", 1.0), (1, 1, "p", 2.0)), path, "one", 0)
    rounds.append_rounds(frame((1, 2, "p", 3.0)), path, "two", 0)
    rounds.append_rounds(frame((0, 1, "p", 1.0), (1, 1, "p", 2.0)), path, "one", 0)  # the batch again
    (tmp_path / "log" / "writer=three").mkdir()
    (tmp_path / "log" / "writer=three" / "part-0.json").write_text(record(7) + "\n" + record(8)[:20])
    records, refused = rounds.load_rounds(spark, path, "p")
    assert {(r["round"], r["version"], r["value"]) for r in records.collect()} == {(0, 1, 1.0), (1, 2, 3.0), (7, 1, None)}
    assert [r["problem"] for r in refused.collect()] == ["torn"]


def test_a_stream_of_rounds_is_written_once(spark, tmp_path):
    source, path = tmp_path / "in", str(tmp_path / "log")
    source.mkdir()
    for i in range(3):
        (source / f"{i}.json").write_text(record(i, value=float(i)))
        stream = spark.readStream.schema("round long, version long, fingerprint string, value double").json(str(source))
        rounds.start_round_log(stream, path, "w", str(tmp_path / "check")).awaitTermination()
    rounds.start_round_log(stream, path, "w", str(tmp_path / "check")).awaitTermination()
    records, _ = rounds.load_rounds(spark, path, "p")
    assert sorted((r["round"], r["value"]) for r in records.collect()) == [(0, 0.0), (1, 1.0), (2, 2.0)]


def test_streaks_carry_over_rounds_that_say_nothing(spark):
    rows = [(i, *x) for i, x in enumerate([(False, True), (True, True), (False, True), (False, False), (None, True), (True, False), (False, None), (False, True)])]
    df = spark.createDataFrame([("s", *r) for r in rows] + [(None, 0, False, True)], "s string, i int, better boolean, ok boolean")
    got = robust.streaks(df, ["s"], "i", F.col("better"), F.col("ok")).orderBy("i")
    assert [r["streak"] for r in got.where("s = 's'").collect()] == [1, 0, 1, 1, 2, 0, 0, 1]
    assert got.where("s IS NULL").first()["streak"] == 1


def test_arrow_rows_of_empty_meshes():
    assert meshes._batch(meshes.Mesh(), [("_id", pa.int32(), 1)]).num_rows == 0


# Positions

SCHEMA = "session string, seq long, plan string, camera int, photographs array<string>"
EVENTS = [
    ("s", 1, "A", None, None), ("s", 2, "A", 1, ["a", "b", "c"]), ("s", 3, "A", 2, ["d", "e", "f"]), ("s", 4, "A", 1, ["g", "h"]),  # camera 1 again
    ("s", 5, "A", 3, ["d", "e", "x", "y"]),  # two of three of camera 2's
    ("s", 6, "B", 4, ["q"]), ("s", 7, "A", 4, ["g", "z"]),  # half of camera 1's two is not more than half
    ("t", 1, "A", 1, ["a"]), ("t", 2, "A", None, []), ("t", 3, "A", 1, ["a", "a"]), ("t", 4, "A", 2, ["a"]), ("t", 5, "C", None, None), ("t", 6, "C", 7, []), ("t", 7, "C", 8, None), (None, 1, None, 2, ["x"]),
]
CHANGES = {
    "s": [(1, "plan", None), (2, "added", None), (3, "added", None), (4, "replaced", 1), (5, "moved", 2), (6, "other-plan", None), (7, "added", None)],
    "t": [(1, "other-plan", None), (2, "plan", None), (3, "added", None), (4, "moved", 1), (5, "plan", None), (6, "added", None), (7, "added", None)],
    None: [(1, "added", None)],
}


def test_position_changes(spark):
    events = spark.createDataFrame([*EVENTS, *EVENTS[3:6], ("s", None, "A", 9, ["n"])], SCHEMA).repartition(4)
    got = positions.position_changes(events).collect()
    assert {k: [(r["seq"], r["change"], r["other"]) for r in sorted((r for r in got if r["session"] == k), key=lambda r: r["seq"])] for k in CHANGES} == CHANGES
    assert {(r["session"], r["camera"], r["seq"]) for r in got if r["held"]} == {("s", 1, 4), ("s", 3, 5), ("s", 4, 7), ("t", 7, 6), ("t", 8, 7), (None, 2, 1)}
    assert positions.position_changes(events.limit(0)).count() == 0


def test_a_task_waits_only_for_what_is_held_and_takes_sessions_one_by_one():
    import pyarrow as pa

    taken = 0

    def batches():  # two sessions: one camera read 30,000 times, then one that moves two positions at once, its own among them
        nonlocal taken
        rows = [("s", i + 1, i, "A", i % 2 if i else None, ["a", "b", f"c{i % 2}"]) for i in range(30_000)]
        rows += [("t", i + 1, i, "A", c, x) for i, (c, x) in enumerate([(None, []), (2, ["a"]), (7, ["b"]), (7, ["a", "b"])])]
        names = ["_session", "_place", "seq", "plan", "camera", "photographs"]
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.list_(pa.string())]
        for at in range(0, len(rows), 1000):
            taken += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[at : at + 1000], strict=True), kinds, strict=True)], names=names)

    fields = [("_session", pa.string()), ("seq", pa.int64()), ("camera", pa.int32()), ("change", pa.string()), ("other", pa.int32()), ("shared", pa.int32()), ("held", pa.bool_())]
    made = positions._changes(batches(), pa.schema(fields))
    first = next(made)
    assert taken < 15 and first.num_rows >= positions.BATCH  # given back long before the session ends
    rows = [r for b in (first, *made) for r in b.to_pylist()]
    assert len(rows) == 30_000 + 5 and [(r["seq"], r["other"]) for r in rows if r["held"]] == [(29_999, 0), (3, 2), (3, 7)]


def test_a_shuffled_repeated_and_restarted_stream_gives_the_batch_result(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    rng = random.Random(3)
    shuffled = [*EVENTS, *EVENTS[::2]]
    rng.shuffle(shuffled)
    for i in range(3):  # three runs of the query, each from its checkpoint
        with open(source / f"{i}.json", "w") as file:
            for e in shuffled[i::3]:
                file.write(json.dumps(dict(zip(("session", "seq", "plan", "camera", "photographs"), e, strict=True)) | {"ts": f"2024-01-01T00:00:{e[1]:02d}Z"}) + "\n")
        stream = positions.stream_positions(spark.readStream.schema(SCHEMA + ", ts timestamp").json(str(source)))
        write = stream.writeStream.outputMode("update").foreachBatch(lambda batch, n: batch.write.mode("append").parquet(out))
        write.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    got = {r["session"]: (r["events"], json.loads(r["held"])) for r in positions.latest_positions(spark.read.parquet(out)).collect()}
    assert {k: [(h["camera"], h["seq"]) for h in v] for k, (_, v) in got.items()} == {"s": [(1, 4), (3, 5), (4, 7)], "t": [(7, 6), (8, 7)], None: [(2, 1)]}
    assert {k: n for k, (n, _) in got.items()} == {"s": 7, "t": 7, None: 1}


def test_silent_sessions_are_forgotten(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for i, (name, when) in enumerate([("old", "00:00"), ("new", "05:00"), ("new", "05:01"), ("old", "05:02")]):
        (source / f"{i}.json").write_text(json.dumps({"session": name, "seq": i, "plan": None, "camera": i, "photographs": [str(i)], "ts": f"2024-01-01T{when}:00Z"}))
        stream = positions.stream_positions(spark.readStream.schema(SCHEMA + ", ts timestamp").json(str(source)), age_s=600)
        write = stream.writeStream.outputMode("update").foreachBatch(lambda batch, n: batch.write.mode("append").parquet(out))
        write.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r["session"], r["events"]) for r in spark.read.parquet(out).collect())
    assert got == [("new", 1), ("new", 2), ("old", 1), ("old", 1)]  # the old session starts anew


# Graphs


def test_shortest_paths_follow_what_fell(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(60), rng.randrange(60), float(rng.randint(1, 9))) for _ in range(150)] + [(0, 1, None), (None, 2, 1.0), (3, 3, 0.0)]
    best = {0: 0.0, 5: 0.0}
    for _ in range(60):
        for a, b, n in edges:
            if a in best and n is not None and best[a] + n < best.get(b, 1e9):
                best[b] = best[a] + n
    got = graph.shortest_paths(spark.createDataFrame(edges, "src int, dst int, length double"), spark.createDataFrame([(0,), (5,), (5,), (None,)], "id int"))
    assert {r["id"]: r["distance"] for r in got.collect()} == best


def test_distances_from_the_rim(spark):
    corners = [(0, x + 4 * y, float(x), float(y), 0.0) for x in range(4) for y in range(4)] + [(1, i, *p) for i, p in enumerate([(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)])]
    cells = [(0, a, b, c) for x in range(3) for y in range(3) for a, b, c in [(x + 4 * y, x + 1 + 4 * y, x + 4 * y + 4), (x + 1 + 4 * y, x + 5 + 4 * y, x + 4 * y + 4)]]
    closed = [(1, 0, 1, 2), (1, 0, 1, 3), (1, 0, 2, 3), (1, 1, 2, 3)]
    vertices, triangles = spark.createDataFrame(corners, "m int, i int, x double, y double, z double"), spark.createDataFrame(cells + closed, "m int, a int, b int, c int")
    got = {(r["mesh"], r["node"]): r["distance"] for r in graph.boundary_distances(vertices, triangles, "m", "i", 1e-6).collect()}
    assert got == {(0, x + 4 * y): float(x in (1, 2) and y in (1, 2)) for x in range(4) for y in range(4)}


@pytest.mark.parametrize("bits, piece", [(2, 3), (3, 1000), (15, 2)])
def test_paths_through_blocks_and_pieces(spark, bits, piece):
    rng = random.Random(bits)
    edges = [(rng.randrange(60), rng.randrange(60), rng.choice([0.0, 0.1, 0.7, 1.3, 4.0])) for _ in range(200)] + [(70, 71, 1.0), (71, 72, float("inf")), (3, 73, float("nan")), (73, 74, 1.0)]
    best = {0: 0.0, 41: 0.0, 71: 0.0, 90: 0.0}
    for _ in range(80):
        for a, b, n in edges:
            if a in best and (b not in best or best[a] + n < best[b]):
                best[b] = best[a] + n
    got = graph.shortest_paths(spark.createDataFrame(edges, "src int, dst int, length double"), spark.createDataFrame([(i,) for i in (0, 41, 71, 90)], "id int"), bits, piece)
    assert {r["id"]: str(r["distance"]) for r in got.collect()} == {i: str(d) for i, d in best.items()}


def test_a_long_sheet_takes_few_rounds(spark, monkeypatch):
    """As wide as 41 nodes, so 20 edges from its rim to its middle: a round an edge would be more than 20."""
    written, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: written.append(df.columns) or cut(df))
    i = F.col("id")
    vertices = spark.range(41 * 60).select(F.lit(0).alias("m"), i.alias("i"), (i % 41).alias("x"), F.floor(i / 41).alias("y"), F.lit(0.0).alias("z"))
    corner = lambda *steps: F.struct(*((F.col("i") + s).alias(n) for s, n in zip(steps, "abc", strict=True)))
    triangles = vertices.where("x < 40 AND y < 59").select("m", F.explode(F.array(corner(0, 1, 41), corner(1, 42, 41))).alias("t")).select("m", "t.*")
    got = {r["node"]: r["distance"] for r in graph.boundary_distances(vertices, triangles, "m", "i", 1e-6).collect()}
    assert got == {x + 41 * y: float(min(x, 40 - x, y, 59 - y)) for x in range(41) for y in range(60)}
    assert sum("fell" in columns for columns in written) <= 4


def test_normals_and_textures_of_placed_meshes():
    up, uv = np.tile([0.0, 0.0, 2.0], (4, 1)), np.array([[0.0, 1.0], [2.5, -0.25], [1.0, 0.5], [0.25, 3.0]])
    plain = meshes.read_glb(glb_bytes(POINTS, FACES, {}, up, uv))
    assert np.allclose(plain.normals, up / 2) and np.allclose(plain.textures, [[0, 1], [0.5, 0.75], [1, 0.5], [0.25, 0]])
    assert plain.skipped == ["texture coordinates outside 0 to 1 are wrapped"]
    # Stretched along x, a slanted face leans the other way than its normal would if it were merely carried along
    slant = meshes.read_glb(glb_bytes(POINTS, FACES, {"scale": [4, 1, 1]}, np.tile([1.0, 0.0, 1.0], (4, 1)), uv[:1].repeat(4, 0)))
    assert np.allclose(slant.normals, np.array([1, 0, 4]) / math.sqrt(17)) and slant.skipped == []
    mirrored = meshes.read_glb(glb_bytes(POINTS, FACES, {"scale": [-1, 1, 1]}, up * 0))
    assert np.array_equal(mirrored.triangles, FACES[:, [0, 2, 1]]) and not mirrored.normals.any() and mirrored.textures is None
    flat = meshes.read_glb(glb_bytes(POINTS, FACES, {"scale": [1, 1, 0]}, up, uv[:3]))
    assert flat.textures is None and flat.skipped == ["TEXCOORD_0 has another number of values than vertices"] and np.isfinite(flat.normals).all()
    assert np.array_equal(meshes.read_glb(glb_bytes(POINTS, FACES, {"scale": [-1, -1, 1]})).triangles, FACES)
