"""MinHash near-dedup by fast similarity sketching.

Sketch: element x of a set falls, in round i, into bin h_i(x) with value
i + h'_i(x); each of ``BINS`` bins keeps its least value, and from round
``BINS`` on round i drops one element into bin i - BINS, so that after at most
2 * BINS rounds every bin is full. Bins agree between two sets with the Jaccard
similarity as probability, with concentration as for independent hashes, yet a
text of hundreds of shingles is done after one or two rounds.

Banding: ``BANDS`` bands of ``ROWS`` bins. At similarity 0.85 a pair shares no
band with probability (1 - 0.85**5)**25 = 4e-7, at 0.8 with 5e-5.

Verification: documents with equal shingle sets are one node. The nodes of a
bucket are gathered under the bucket's smallest node (its hub), the groups of
one hub are cut into blocks of ``BLOCK`` nodes, and each pair of blocks counts
the intersections of its full shingle sets as one matrix product. A task emits
only a spanning forest of the confirmed links, so no group ever yields all its
pairs, and no task holds more than two blocks. All pairs that share a bucket
are compared; nothing is capped.

Components: hash-to-minimum label propagation over those links, cutting the
lineage through tables in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens as T
from .common import read, slices, small_batches, spent, stored

SHINGLE = 5
ROWS, BANDS = 5, 25
BINS = ROWS * BANDS
BLOCK = 512
PERCENT = 85


def shingle_sets(texts: pa.Array, width: int = SHINGLE) -> Iterator[list[np.ndarray]]:
    """For each chunk of texts, the sorted distinct shingle hashes of every text."""
    for chunk in T.chunks(texts):
        chunk.data = T.LOWER[chunk.data]
        w = T.words(chunk)
        hashes = T.range_hashes(chunk.data, w.starts, w.ends)
        at = T.window_starts(w.bounds, width)
        shingles = T.window_hashes(hashes, at, width)
        cut = np.searchsorted(at, w.bounds)
        counts = w.counts
        sets = [np.unique(shingles[cut[i] : cut[i + 1]]) for i in range(chunk.n)]
        for i in np.flatnonzero((counts > 0) & (counts < width)):
            sets[i] = T.window_hashes(hashes, w.bounds[i : i + 1], counts[i : i + 1])
        yield sets


def sketches(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """One row of ``bins`` values for each set; an empty set has a row of ones in every bit."""
    n = len(sets)
    out = np.full((n, bins), np.iinfo(np.uint64).max, dtype=np.uint64)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    owner = np.repeat(np.arange(n), sizes)
    items = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    flat = out.reshape(-1)
    full = np.iinfo(np.uint64).max
    for i in range(2 * bins):
        if not len(items):
            break
        h = T.mix(items ^ np.uint64(0x51ED270B0A1F39C1 * (i + 1) & 0xFFFFFFFFFFFFFFFF))
        # The high 32 bits choose the bin, a second mix gives the value; the round comes first.
        slot = (h >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32) if i < bins else np.full(len(h), i - bins, dtype=np.uint64)
        value = (np.uint64(i) << np.uint64(54)) | (T.mix(h) >> np.uint64(10))
        np.minimum.at(flat, owner * bins + slot.astype(np.int64), value)
        if i < 8 or i % 8 == 0 or i >= bins - 1:
            open_ = (out == full).any(axis=1)
            left = open_[owner]
            if not left.all():
                items, owner = items[left], owner[left]
    return out


def band_keys(sketch: np.ndarray, rows: int = ROWS, bands: int = BANDS) -> np.ndarray:
    parts = sketch.reshape(len(sketch), bands, rows)
    key = np.broadcast_to(T.mix(np.arange(1, bands + 1, dtype=np.uint64)), parts.shape[:2]).copy()
    for r in range(rows):
        key = T.mix(key ^ parts[:, :, r])
    return key


def _set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits over a whole set."""
    mixed = T.mix(s)
    return int(np.add.reduce(mixed).view(np.int64)), int(np.bitwise_xor.reduce(T.mix(mixed)).view(np.int64))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        sizes, keys_a, keys_b, bands = [], [], [], []
        for sets in shingle_sets(batch.column("_text")):
            keys = band_keys(sketches(sets)).view(np.int64)
            for s, k in zip(sets, keys, strict=True):
                a, b = _set_key(s) if len(s) else (0, 0)
                sizes.append(len(s))
                keys_a.append(a)
                keys_b.append(b)
                bands.append(k if len(s) else k[:0])
        flat = np.concatenate(bands) if bands else np.zeros(0, np.int64)
        offsets = np.concatenate(([0], np.cumsum([len(k) for k in bands]))).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column("_id"), pa.array(sizes, pa.int64()), pa.array(keys_a, pa.int64()), pa.array(keys_b, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
            names=["_id", "n_shingles", "set_a", "set_b", "bands"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        packed = [s.astype("<u8").tobytes() for sets in shingle_sets(batch.column("_text")) for s in sets]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(packed, pa.binary())], names=["node", "shingles"])


class _Forest:
    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (p := self.up.get(root, root)) != root:
            root = p
        while (p := self.up.get(x, x)) != root:
            self.up[x], x = root, p
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def links_between(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """A spanning forest of the confirmed links between sets ``left`` and ``right`` (indexes; the same array means within it).

    Shingles of one set only can't be shared, so the others, numbered, make
    the columns of a 0/1 matrix; products over slices of columns count all
    intersections of full sets.
    """
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    items = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(items, kind="stable")
    items, owner = items[order], owner[order]
    new = np.ones(len(items), dtype=bool)
    new[1:] = items[1:] != items[:-1]
    counts = np.diff(np.append(np.flatnonzero(new), len(items)))
    shared = np.repeat(counts > 1, counts)
    column = (np.cumsum(new & shared) - 1)[shared]
    owner = owner[shared]
    width = int(column[-1]) + 1 if len(column) else 0
    common = np.zeros((len(left), len(right)), dtype=np.float32)
    step = max(64, (1 << 22) // max(1, len(left) + len(right)))
    for lo in range(0, width, step):
        a, b = np.searchsorted(column, (lo, lo + step))
        block = np.zeros((len(sets), min(step, width - lo)), dtype=np.float32)
        block[owner[a:b], column[a:b] - lo] = 1
        common += block[left] @ block[right].T
    both = common.astype(np.int64)
    union = sizes[left][:, None] + sizes[right][None, :] - both
    at_a, at_b = np.nonzero(100 * both >= percent * union)
    forest = _Forest()
    return [(x, y) for x, y in zip(left[at_a].tolist(), right[at_b].tolist(), strict=True) if x != y and forest.join(x, y)]


def _confirm(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    nodes, sides, sets = [], [], []
    for batch in batches:
        nodes += batch.column("node").to_pylist()
        sides += batch.column("side").to_pylist()
        sets += [np.frombuffer(x.as_py(), "<u8") for x in batch.column("shingles")]
    ids, side = np.array(nodes, dtype=np.int64), np.array(sides)
    order = np.argsort(ids, kind="stable")
    ids, side, sets = ids[order], side[order], [sets[i] for i in order]
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    found = links_between(sets, left, right if len(right) else left, percent) if len(sets) > 1 else []
    yield pa.RecordBatch.from_arrays([pa.array([int(ids[min(p)]) for p in found], pa.int64()), pa.array([int(ids[max(p)]) for p in found], pa.int64())], names=["a", "b"])


def verified_links(nodes: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b), a < b: links that connect whatever the candidates of all buckets connect.

    nodes: (node, bands). texts: (_id, _text).
    """

    def confirm(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _confirm(batches, percent)

    member = nodes.select("node", F.explode("bands").alias("band"))
    hubs = member.groupBy("band").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    groups = stored(member.join(hubs, "band").select("hub", "node").distinct(), "groups")
    needed = groups.select("node").distinct()
    # The same plan at every size: a filter of few nodes would else be broadcast on small inputs only.
    sets = needed.join(texts.hint("merge"), F.col("node") == F.col("_id")).select("node", "_text").mapInArrow(_sets, "node long, shingles binary")
    sets = stored(sets, "shingles")
    blocks = groups.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cut = groups.join(blocks, "hub").withColumn("own", block).withColumn("other", other)
    placed = cut.select("hub", "node", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"))
    links = stored(placed.join(sets, "node").groupBy("hub", "i", "j").applyInArrow(confirm, "a long, b long").distinct(), "links")
    spent(groups, sets)
    return links


def components(links: DataFrame) -> DataFrame:
    """(node, label): for each end of a link, the smallest node that it reaches.

    Each round every node hands the smallest node it knows to all that it
    knows (hash-to-min with shortcuts), which halves distances; the loop ends
    when a round changes nothing. Only counts come to the driver.
    """
    edges = links.select("a", "b")
    labels = stored(edges.select(F.col("a").alias("node"), F.col("b").alias("near")).union(edges.select("b", "a")).groupBy("node").agg(F.least("node", F.min("near")).alias("label")), "labels")
    both = stored(edges.select(F.col("a").alias("x"), F.col("b").alias("y")).union(edges.select("b", "a")), "edges")
    while True:
        spread = both.join(labels, both["x"] == labels["node"]).select(F.col("y").alias("node"), "label")
        # Also to the label of the node: its own root then learns of a smaller one.
        old = labels.select("node", F.col("label").alias("was"))
        best = spread.union(labels.select("node", "label")).groupBy("node").agg(F.min("label").alias("best")).join(old, "node")
        roots = best.select(F.col("was").alias("node"), F.col("best").alias("best")).groupBy("node").agg(F.min("best").alias("root_best"))
        merged = best.join(roots, "node", "left").select("node", F.least("best", "root_best").alias("mid"), "was")
        jump = merged.select(F.col("node").alias("mid"), F.col("mid").alias("far"))
        after = stored(merged.join(jump, "mid", "left").select("node", F.least("mid", "far").alias("label"), "was"), "labels")
        changed = after.where("label <> was").limit(1).count()
        spent(labels)
        labels = after
        if not changed:
            spent(both)
            return labels.drop("was")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """Group documents whose sets of five-word shingles have a Jaccard similarity of at least ``percent`` hundredths.

    Words are maximal runs without ASCII white space of the text with A-Z
    lower-cased; a text of fewer words is one shingle. Returns one row per
    input row: ``id_col``, n_shingles, component_id (the smallest id that
    chains of links reach), kept (the id is its component_id).

    A null, empty or blank text has the empty set and is linked with nothing:
    its component_id is its own id. A row with a null id has a null
    component_id and is kept, and takes part in no group. Rows that repeat an
    id are one document (with several texts: linked through all of them).
    Other columns are left out. An empty table gives no rows.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    base = stored(texts.mapInArrow(_sketch, "_id long, n_shingles long, set_a long, set_b long, bands array<long>"), "sketches")
    key = ["set_a", "set_b", "n_shingles"]
    real = base.where("n_shingles > 0 AND _id IS NOT NULL")
    # Equal sets become one node; first() has equal bands to choose from.
    nodes = real.groupBy(*key).agg(F.min("_id").alias("node"), F.first("bands").alias("bands"))
    nodes = stored(nodes, "nodes")
    links = verified_links(nodes.select("node", "bands"), texts.where("_id IS NOT NULL"), percent)
    labels = components(links)
    spent(links)
    classes = nodes.select(*key, "node").join(labels, "node", "left").select(*key, F.coalesce("label", "node").alias("_class"))
    out = base.select("_id", *key).join(classes, key, "left")
    component = F.coalesce("_class", "_id")
    return out.select(F.col("_id").cast(id_type).alias(id_col), "n_shingles", F.when(F.col("_id").isNotNull(), component).cast(id_type).alias("component_id"), F.coalesce(F.col("_id") == component, F.lit(True)).alias("kept"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return near_dedup(read(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
                                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ') || chr(10) || len(ws)] ELSE [] END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(root, node) AS (SELECT doc_id, doc_id FROM documents UNION SELECT root, y FROM reach JOIN both_ways ON x = node),
least_id AS (SELECT node AS doc_id, min(root) AS component_id FROM reach GROUP BY node)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents LEFT JOIN n USING (doc_id) JOIN least_id USING (doc_id)
"""
