"""Substring dedup: remove passages that an earlier document already has.

Every window of ``width`` words is hashed (Rabin-Karp, 64 bits). Each task
sends, for each bucket of hashes, packed arrays of hashes and document ids;
one group per bucket counts the documents of every hash and returns, per
document, the hashes that also start in a document with a smaller id. The
documents then merge those windows into maximal removal intervals.

Skew: copies of a window within a task are reduced to the smallest document
before the shuffle, so a passage in a third of all documents costs one entry a
task, not one a document. The number of buckets follows the size of the input,
so that a bucket holds about ``BUCKET_WINDOWS`` windows at any scale.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens as T
from .common import read, slices, small_batches, stored

WIDTH = 13
BUCKET_WINDOWS = 1 << 20
LEAST_BUCKETS = 256
#: Bytes of text that a task reduces together before the shuffle
TASK_BYTES = 8 << 20

_PACKED = "bucket long, least long, ids binary, hashes binary"


def _group_starts(*keys: np.ndarray) -> np.ndarray:
    new = np.ones(len(keys[0]), dtype=bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _planes(x: np.ndarray) -> bytes:
    """64-bit numbers, first their lowest bytes, last their highest: high bytes that are all alike shrink in the shuffle's compression."""
    return np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8).T.tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _pack(bucket: int, ids: np.ndarray, hashes: np.ndarray) -> tuple[int, int, bytes, bytes]:
    """Sorted hashes as steps from each to the next, and ids as distances from the least."""
    least = int(ids.min())
    return bucket, least, _planes((ids - least).view(np.uint64)), _planes(np.diff(hashes, prepend=np.uint64(0)))


def _reduce(ids: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by hash, then id; and whether each entry is the smallest id of its hash."""
    order = np.lexsort((ids, hashes))
    h, d = hashes[order], ids[order]
    first = np.zeros(len(h), dtype=bool)
    first[_group_starts(h)] = True
    least = d[np.flatnonzero(first)][np.cumsum(first) - 1] if len(h) else d
    return order, d > least


def _by_document(ids: np.ndarray, hashes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(ids, kind="stable")
    ids, hashes = ids[order], hashes[order]
    at = np.append(_group_starts(ids), len(ids)) if len(ids) else np.zeros(1, int)
    for lo, hi in zip(at[:-1], at[1:], strict=True):
        yield int(ids[lo]), hashes[lo:hi]


def _windows(batches: Iterator[pa.RecordBatch], width: int, bits: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def emit() -> pa.RecordBatch:
        ids = np.concatenate([x[0] for x in held])
        hashes = np.concatenate([x[1] for x in held])
        order, later = _reduce(ids, hashes)
        ids, hashes = ids[order], hashes[order]
        rows = []
        # Sorted by hash, a bucket (the top bits) is a run.
        keep_ids, keep = ids[~later], hashes[~later]
        bucket = (keep >> np.uint64(64 - bits)).astype(np.int64)
        new = np.ones(len(keep), dtype=bool)
        new[1:] = keep[1:] != keep[:-1]
        keep_ids, keep, bucket = keep_ids[new], keep[new], bucket[new]
        at = np.append(_group_starts(bucket), len(bucket)) if len(bucket) else np.zeros(1, int)
        for lo, hi in zip(at[:-1], at[1:], strict=True):
            rows.append(_pack(int(bucket[lo]), keep_ids[lo:hi], keep[lo:hi]))
        # What a smaller document of this task already has needs no counting; it rides along under keys of its own.
        for doc, found in _by_document(ids[later], hashes[later]):
            rows.append((-1 - (doc & 0x7FFFFFFF), doc, b"", _planes(np.diff(np.unique(found), prepend=np.uint64(0)))))
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["bucket", "least", "ids", "hashes"])

    for batch in slices(batches):
        known = np.asarray(batch.column(0).is_valid())
        doc_ids = np.asarray(batch.column(0).fill_null(0))
        for chunk in T.chunks(batch.column(1)):
            w = T.words(chunk)
            at = T.window_starts(w.bounds, width)
            owner = chunk.first + np.searchsorted(w.bounds, at, side="right") - 1
            hashes = T.window_hashes(T.range_hashes(chunk.data, w.starts, w.ends), at, width)
            use = known[owner]
            held.append((doc_ids[owner][use], hashes[use]))
            size += len(chunk.data)
            if size >= TASK_BYTES:
                yield emit()
                held, size = [], 0
    if held:
        yield emit()


def _count(key: tuple, blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, hashes, done = [], [], []
    for block in blocks:
        for least, places, steps in zip(block.column("least"), block.column("ids"), block.column("hashes"), strict=True):
            h = np.cumsum(_from_planes(steps.as_py()), dtype=np.uint64)
            if key[0].as_py() < 0:
                done.append((least.as_py(), h))
            else:
                ids.append(_from_planes(places.as_py()).view("<i8") + least.as_py())
                hashes.append(h)
    if ids:
        all_ids, all_hashes = np.concatenate(ids), np.concatenate(hashes)
        order, later = _reduce(all_ids, all_hashes)
        done += _by_document(all_ids[order][later], all_hashes[order][later])
    yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in done], pa.int64()), pa.array([h.astype("<u8").tobytes() for _, h in done], pa.binary())], names=["doc", "hashes"])


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc, hashes): packed hashes of the windows of a document that also start in a document with a smaller id.

    A document can have several rows; rows with a null id have no place in
    the order, so they neither lose nor cause removals.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    bits = max(LEAST_BUCKETS.bit_length() - 1, (int(total) // (6 * BUCKET_WINDOWS)).bit_length())
    packed = texts.mapInArrow(lambda b: _windows(b, width, bits), _PACKED)
    return packed.groupBy("bucket").applyInArrow(_count, "doc long, hashes binary")


def _removals(batches: Iterator[pa.RecordBatch], width: int, extra: list[str], clean: bool) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        n_words, n_removed, kept, spans = [], [], [], []
        flagged = batch.column("_flagged")
        for chunk in T.chunks(batch.column("_text")):
            w = T.words(chunk)
            total = int(w.bounds[-1])
            removed = np.zeros(total, dtype=bool)
            which = [i for i in range(chunk.n) if flagged[chunk.first + i].is_valid]
            if which:
                at = T.window_starts(w.bounds, width)
                hashes = T.window_hashes(T.range_hashes(chunk.data, w.starts, w.ends), at, width)
                cut = np.searchsorted(at, w.bounds)
                hits = []
                for i in which:
                    lo, hi = cut[i], cut[i + 1]
                    found = np.unique(np.concatenate([np.frombuffer(x, "<u8") for x in flagged[chunk.first + i].as_py()]))
                    hits.append(at[lo:hi][np.isin(hashes[lo:hi], found)])
                removed = T.covered(total, np.concatenate(hits), width)
            counts = T.per_text_sum(removed, w.bounds)
            n_words += w.counts.tolist()
            n_removed += counts.tolist()
            raw = chunk.data.tobytes()
            for i in range(chunk.n):
                lo, hi = w.bounds[i], w.bounds[i + 1]
                keep = np.flatnonzero(~removed[lo:hi]) + lo
                text = b" ".join([raw[s:e] for s, e in zip(w.starts[keep].tolist(), w.ends[keep].tolist(), strict=True)])
                kept.append(text)
                edges = np.flatnonzero(np.diff(np.concatenate(([0], removed[lo:hi].view(np.int8), [0]))))
                spans.append([{"start": int(a), "stop": int(b)} for a, b in edges.reshape(-1, 2)] if counts[i] else [])
        arrays = [batch.column(c) for c in extra]
        arrays += [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())]
        names = [*extra, "_n_words", "_n_removed", "_kept_sha256"]
        if clean:
            arrays += [pa.array([x.decode() for x in kept], pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))]
            names += ["_clean", "_spans"]
        yield pa.RecordBatch.from_arrays(arrays, names=names)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, clean: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Find and remove the words covered by windows that a document with a smaller id also has.

    Words are maximal runs without ASCII white space; windows are judged on
    the input. Returns one row per input row with ``id_col``, n_words,
    n_removed, kept_sha256 (of the kept words joined by one space) and, if
    ``clean``, clean_text and removed_spans (maximal intervals of word
    positions, stop exclusive); and the columns ``keep``.

    A null or empty text has no words (n_words 0, the hash of nothing). Rows
    with a null id lose nothing and cause no removal. Rows that repeat an id
    count as one document's: they never remove each other's words. Other
    columns are left out, so names can't clash. An empty table gives no rows.
    """
    found = stored(repeated_windows(docs, id_col, text_col, width), "windows").groupBy("doc").agg(F.collect_list("hashes").alias("_flagged"))
    extra = ["_id", *(f"_keep{i}" for i in range(len(keep)))]
    texts = docs.select(*(F.col(c).alias(e) for c, e in zip((id_col, *keep), extra, strict=True)), F.col(text_col).alias("_text"))
    joined = texts.join(found, texts["_id"] == found["doc"], "left").select(*extra, "_text", "_flagged")
    schema = ", ".join(f"{e} {docs.schema[c].dataType.simpleString()}" for c, e in zip((id_col, *keep), extra, strict=True))
    schema += ", _n_words long, _n_removed long, _kept_sha256 string" + (", _clean string, _spans array<struct<start:long,stop:long>>" if clean else "")
    out = joined.mapInArrow(lambda b: _removals(b, width, extra, clean), schema)
    names = dict(zip(extra, (id_col, *keep), strict=True)) | {"_n_words": "n_words", "_n_removed": "n_removed", "_kept_sha256": "kept_sha256", "_clean": "clean_text", "_spans": "removed_spans"}
    return out.select(*(F.col(c).alias(names[c]) for c in out.columns))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return substring_dedup(read(spark, sf_dir, "documents"), clean=False)


OP6_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents
), starts AS (
  SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS win
  FROM w, UNNEST(range(1, len(words) - 11)) AS r(i) WHERE len(words) >= 13
), firsts AS (SELECT win, min(doc_id) AS first_id FROM starts GROUP BY win),
gone AS (
  SELECT doc_id, list_distinct(flatten(list(range(i, i + 13)))) AS positions
  FROM starts JOIN firsts USING (win) WHERE first_id < doc_id GROUP BY doc_id
), kept AS (
  SELECT w.doc_id, len(words) AS n_words, coalesce(len(positions), 0) AS n_removed,
         CASE WHEN positions IS NULL THEN words ELSE
           list_transform(list_filter(list_zip(words, range(1, len(words) + 1)), lambda x: NOT list_contains(positions, x[2])), lambda x: x[1]) END AS k
  FROM w LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""
