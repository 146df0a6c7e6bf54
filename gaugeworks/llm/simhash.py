"""SimHash near-dedup by pigeonhole blocks.

Fingerprint: every word shingle of a text, repeats included, votes with the 64
bits of its XXH64; a bit is 1 if more than half the votes say so.

Blocks: two fingerprints that differ in at most ``DISTANCE`` bits agree on at
least ``parts - DISTANCE`` of ``parts`` blocks of bits. Every choice of so many
blocks makes one key, and fingerprints are joined on these keys. More
fingerprints get more, longer keys (``pigeonholes``), so that the keys of
unrelated ones stay apart; whatever the number, no pair is lost.

Verification: sorted by key, the fingerprints of one key are compared by the
bits in which they differ; a search along those links emits a spanning forest
of them, never all pairs. A key with more than ``MOST`` different fingerprints
isn't compared by pairs. Its members are handed on, and linked exactly in
linear work: two fingerprints differ in at most 2 * r bits if and only if some
64-bit word differs from both in at most r, so all fingerprints around one
such word are linked, and one aggregation by that word finds them
(``dense_links``).

Copies: documents with one fingerprint are one node, whatever their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens as T
from .common import read, slices, small_batches, spent, stored
from .near_dedup import components

BITS = 64
SHINGLE = 4
SEED = 42
DISTANCE = 4
#: Members that a key has on average, if fingerprints are spread evenly
MEMBERS = 64
#: Most fingerprints of one key that one task compares by pairs: 256 KB and some seconds at worst
MOST = 1 << 15
#: Pairs that are compared at once
PAIRS = 1 << 21
#: Shingles whose bits are counted at once
VOTES = 1 << 17
#: A fingerprint of more than one in so many rows is joined by a broadcast of less than so many rows.
HEAVY = 1024


def fingerprints(texts: pa.Array, width: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """One unsigned 64-bit fingerprint for each text; 0 for a text without words."""
    out = [np.zeros(0, np.uint64)]
    for chunk in T.chunks(texts):
        data = T.LOWER[chunk.data]
        w = T.words(chunk)
        # The words of the chunk, one space after each
        sizes = w.ends - w.starts + 1
        begins = np.cumsum(sizes) - sizes
        spaced = np.full(int(sizes.sum()), 0x20, dtype=np.uint8)
        inside = np.ones(len(spaced), dtype=bool)
        inside[begins + sizes - 1] = False
        spaced[inside] = data[T.IS_WORD[data]]
        joined = spaced.tobytes()
        counts = w.counts
        short = np.flatnonzero((counts > 0) & (counts < width))
        first = np.concatenate((T.window_starts(w.bounds, width), w.bounds[short]))
        last = np.concatenate((first[: len(first) - len(short)] + width - 1, w.bounds[short + 1] - 1))
        order = np.argsort(first, kind="stable")
        first, last = first[order], last[order]
        owner = np.searchsorted(w.bounds, first, side="right") - 1
        votes = np.zeros((chunk.n, BITS), dtype=np.int64)
        for lo in range(0, len(first), VOTES):
            a, b, own = first[lo : lo + VOTES], last[lo : lo + VOTES], owner[lo : lo + VOTES]
            ends = begins[b] + sizes[b] - 1
            hashes = np.fromiter((xxhash.xxh64_intdigest(joined[s:e], seed) for s, e in zip(begins[a].tolist(), ends.tolist(), strict=True)), np.uint64, len(a))
            bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            heads = np.flatnonzero(np.diff(own, prepend=-1))
            votes[own[heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int32)
        total = np.bincount(owner, minlength=chunk.n)
        out.append(np.packbits(2 * votes > total[:, None], axis=1).view(">u8").ravel().astype(np.uint64))
    return np.concatenate(out)


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints(batch.column(1)).view(np.int64))], names=["_id", "fp"])


def pigeonholes(n: int, distance: int = DISTANCE) -> list[int]:
    """Masks of bits: fingerprints that differ in at most ``distance`` bits agree on all bits of at least one mask.

    The masks are as long as ``n`` evenly spread fingerprints need for keys of ``MEMBERS`` on average, with at most some hundreds of masks.
    """
    parts = distance + 1
    while (MEMBERS << (BITS * (parts - distance) // parts)) < n and comb(parts + 1, distance) <= 500:
        parts += 1
    edges = [BITS * i // parts for i in range(parts + 1)]
    blocks = [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(blocks, parts - distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def spanning_links(x: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs of ``x`` (distinct, unsigned) that differ in at most ``distance`` bits."""
    a, b = [x[:0]], [x[:0]]
    if len(x) < 2:
        return a[0], b[0]
    if len(x) * len(x) <= PAIRS and np.count_nonzero(np.bitwise_count(x[:, None] ^ x[None, :]) <= distance) == len(x):
        return a[0], b[0]  # each agrees with itself only
    left = x
    while len(left):
        frontier, left = left[:1], left[1:]
        while len(frontier) and len(left):
            reached = []
            step = max(1, PAIRS // len(left))
            for lo in range(0, len(frontier), step):
                part = frontier[lo : lo + step]
                near = np.bitwise_count(part[:, None] ^ left[None, :]) <= distance
                hit = near.any(axis=0)
                a.append(part[near.argmax(axis=0)[hit]])
                b.append(left[hit])
                reached.append(left[hit])
                left = left[~hit]
            frontier = np.concatenate(reached)
    return np.concatenate(a), np.concatenate(b)


def _bucket_links(batches: Iterator[pa.RecordBatch], most: int, distance: int) -> Iterator[pa.RecordBatch]:
    """Rows (a, b) for links, and (a, null) for each member of a key that is too large. Input sorted by (mask, key)."""

    def out(pairs: list[tuple[np.ndarray, np.ndarray]], large: list[np.ndarray]) -> pa.RecordBatch:
        a = np.concatenate([np.zeros(0, np.uint64), *(p[0] for p in pairs), *large]).view(np.int64)
        b = np.concatenate([np.zeros(0, np.uint64), *(p[1] for p in pairs)]).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.concat_arrays([pa.array(b), pa.nulls(len(a) - len(b), pa.int64())])], names=["a", "b"])

    now, held, n = None, [], 0
    for batch in batches:
        mask, key, fp = (batch.column(i).to_numpy() for i in range(3))
        fp = fp.view(np.uint64)
        edges = np.flatnonzero((np.diff(mask) != 0) | (np.diff(key) != 0)) + 1
        pairs, large = [], []
        for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(fp)], strict=True):
            if lo == hi:
                continue
            this = (mask[lo], key[lo])
            if this != now:
                if 1 < n <= most:
                    pairs.append(spanning_links(np.concatenate(held), distance))
                now, held, n = this, [], 0
            n += hi - lo
            held.append(fp[lo:hi])
            if n > most:
                large += held
                held = []
        yield out(pairs, large)
    if 1 < n <= most:
        yield out([spanning_links(np.concatenate(held), distance)], [])


def _around(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    masks = np.array([sum(1 << i for i in chosen) for r in range(radius + 1) for chosen in combinations(range(BITS), r)], dtype=np.uint64)
    step = max(1, (1 << 18) // len(masks))
    for batch in batches:
        fp, label = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
        for lo in range(0, len(fp), step):
            words = (fp[lo : lo + step, None] ^ masks[None, :]).ravel().view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(np.repeat(label[lo : lo + step], len(masks)))], names=["word", "label"])


def dense_links(members: DataFrame, distance: int = DISTANCE) -> list[DataFrame]:
    """Tables (a, b) that connect all of ``members`` (column a) that links of at most ``distance`` bits connect.

    All fingerprints around one word within half the distance are linked, so
    the least and the largest label around each word are joined until there is
    no word with two labels. A first round within one bit leaves few labels to
    the wider ones. Only counts come to the driver.
    """
    if distance % 2:
        raise ValueError("an even distance is needed: two fingerprints meet half way")
    labels, found = stored(members.select("a", F.col("a").alias("label")), "dense-labels"), []
    radius = min(1, distance // 2)
    while True:
        words = labels.select("a", "label").mapInArrow(partial(_around, radius=radius), "word long, label long")
        ends = words.groupBy("word").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("a", "b").distinct()
        links = stored(ends, "dense-links")
        if links.limit(1).count():
            found.append(links)
            roots = components(links)
            after = labels.join(roots.withColumnRenamed("label", "root"), F.col("label") == F.col("node"), "left").select("a", F.coalesce("root", "label").alias("label"))
            after = stored(after, "dense-labels")
            spent(labels)
            labels = after
        elif radius == distance // 2:
            spent(labels, links)
            return found
        else:
            spent(links)
        radius = distance // 2


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """Group documents whose fingerprints differ in at most ``distance`` (an even number of) bits, directly or by a chain of documents.

    Words are maximal runs without ASCII white space of the text with A-Z
    lower-cased; a fingerprint is over its shingles of four words, a text of
    fewer words being one shingle. Returns one row per input row: ``id_col``,
    fingerprint (16 hexadecimal digits), component_id (the smallest id that
    the chains reach), kept (the id is its component_id).

    A null, empty or blank text has fingerprint 0 and is linked like any
    other. A row with a null id has a fingerprint and a null component_id, is
    kept, and takes part in no group. Rows are linked by their fingerprints:
    rows that repeat an id with another text belong to the group of that
    text. Ids may be of any type that has an order. Other columns are left
    out. An empty table gives no rows.
    """
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = docs.schema[id_col].dataType.simpleString()
    base = stored(texts.mapInArrow(_fingerprint, f"_id {kind}, fp long"), "fingerprints")
    nodes = stored(base.where("_id IS NOT NULL").groupBy("fp").agg(F.min("_id").alias("least"), F.count("*").alias("n")), "simhash-nodes")
    size = nodes.agg(F.count("*").alias("nodes"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    keys = F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")) for m in pigeonholes(size["nodes"], distance)))).alias("mask", "key")
    dealt = nodes.select(keys, "fp").repartition("mask", "key").sortWithinPartitions("mask", "key")
    found = stored(dealt.mapInArrow(partial(_bucket_links, most=MOST, distance=distance), "a long, b long"), "simhash-links")
    links = found.where("b IS NOT NULL")
    large = stored(found.where("b IS NULL").select("a").distinct(), "simhash-large")
    more = dense_links(large, distance) if large.limit(1).count() else []
    for extra in more:
        links = links.unionByName(extra)
    labels = components(links.distinct())
    spent(found, large, *more)
    placed = nodes.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "n", "least", F.coalesce("label", "fp").alias("label"))
    least = placed.groupBy("label").agg(F.min("least").alias("component"))
    classes = stored(placed.join(least, "label").select("fp", "n", "component"), "simhash-classes")
    spent(nodes)
    # Fewer than HEAVY fingerprints can have more than one in HEAVY rows each; their copies aren't shuffled.
    heavy = F.broadcast(classes.where(F.col("n") * HEAVY > size["rows"]).select("fp", "component"))
    light = base.join(heavy.select("fp"), "fp", "left_anti").join(classes.select("fp", "component"), "fp", "left")
    out = base.join(heavy, "fp").select("_id", "fp", "component").unionByName(light.select("_id", "fp", "component"))
    component = F.when(F.col("_id").isNotNull(), F.col("component"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return out.select(F.col("_id").alias(id_col), digits.alias("fingerprint"), component.alias("component_id"), F.coalesce(F.col("_id") == component, F.lit(True)).alias("kept"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return simhash(read(spark, sf_dir, "documents"))
