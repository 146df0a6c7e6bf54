"""Quality classifier: boosted trees over document statistics.

The statistics come from the bytes and words of whole Arrow batches in numpy;
the trees, flattened into arrays, are walked for a batch at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import tokens as T
from .boosting import Trees, fit_trees
from .classifiers import MOST_LABELLED, features_of, labelled_sample, scored
from .common import read, remainder, small_batches

_B = np.arange(256)
_CLASSES = {
    "upper": (_B >= 65) & (_B <= 90),
    "lower": (_B >= 97) & (_B <= 122),
    "digit": (_B >= 48) & (_B <= 57),
    "beyond_ascii": _B >= 128,
    "stop": np.isin(_B, list(b".?;:")),
    "comma": _B == ord(","),
    "shout": _B == ord("!"),
    "bar": _B == ord("|"),
    "symbol": np.isin(_B, list(b"#*$%&<>@^~_=+\\/")),
    "line": _B == 10,
}


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of statistics for each text; an empty text has zeros."""
    parts = [_chunk(c) for c in T.chunks(texts)]
    return np.concatenate(parts) if parts else np.zeros((0, 26))


def _chunk(chunk: T.Chunk) -> np.ndarray:
    data, n = chunk.data, chunk.n
    w = T.words(chunk)
    words, text_of = w.counts, w.text_of()
    size = np.maximum(np.diff(chunk.offsets), 1)
    count = np.maximum(words, 1)

    def per_word(flags: np.ndarray) -> np.ndarray:
        return T.per_text_sum(flags, w.bounds) / count

    total = []
    for table in _CLASSES.values():
        sums = np.concatenate(([0], np.cumsum(table[data])))
        total.append(sums[chunk.offsets[1:]] - sums[chunk.offsets[:-1]])
    cols = [np.log1p(words), np.log1p(size)] + [t / size for t in total]
    length = w.ends - w.starts
    last, first = data[np.maximum(w.ends - 1, 0)] if len(length) else data[:0], data[w.starts]
    hashes = T.range_hashes(data, w.starts, w.ends)
    cols += [per_word(length), np.sqrt(np.maximum(per_word(length.astype(float) ** 2) - per_word(length) ** 2, 0))]
    cols += [per_word(_CLASSES["stop"][last]), per_word(_CLASSES["shout"][last]), per_word(_CLASSES["symbol"][last]), per_word(_CLASSES["upper"][first]), per_word(length <= 2)]
    # Runs of one word, and how much of the text repeats: words, pairs and fives of words.
    run = np.zeros(len(hashes), dtype=bool)
    run[1:] = (hashes[1:] == hashes[:-1]) & (text_of[1:] == text_of[:-1])
    cols.append(per_word(run))
    for k in (1, 2, 5):
        at = T.window_starts(w.bounds, k)
        keys = np.sort(T.mix(T.window_hashes(hashes, at, k) ^ T.mix(text_of[at].astype(np.uint64))) & np.uint64(0xFFFFFFFFFFFF0000) | text_of[at].astype(np.uint64) & np.uint64(0xFFFF))
        new = np.ones(len(keys), dtype=bool)
        new[1:] = keys[1:] != keys[:-1]
        distinct = np.bincount((keys[new] & np.uint64(0xFFFF)).astype(np.int64), minlength=n)[:n]
        cols.append(1 - distinct / np.maximum(np.bincount(text_of[at], minlength=n), 1))
        if k == 1:
            times = np.diff(np.append(np.flatnonzero(new), len(keys)))
            top = np.zeros(n)
            np.maximum.at(top, (keys[new] & np.uint64(0xFFFF)).astype(np.int64), times)
            cols.append(top / count)
    lines = total[list(_CLASSES).index("line")]
    cols.append(words / (lines + 1))
    cols.append(np.where(words > 0, size / (lines + 1), 0))
    out = np.stack(cols, axis=1).astype(np.float64)
    out[words == 0] = 0
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", most: int = MOST_LABELLED) -> Trees:
    x, y, _ = features_of(labelled_sample(docs, labels, label, id_col, text_col, remainder(id_col, 5) != 0, most), statistics)
    return fit_trees(x, y) if len(y) else fit_trees(np.zeros((0, 26)), np.zeros(0))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, held_out, score (likelihood of label 1) and predicted (score >= 0.3).

    Fitted on at most about ``MOST_LABELLED`` labelled documents whose crc32
    of the id modulo 5 is not 0. Null and empty texts are scored as texts
    without words. Without labels every score is 0.5. Rows pass one by one;
    a null id is not held out. Other columns are left out.
    """
    trees = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col))
    return scored(docs, lambda texts: trees.value.predict(statistics(texts)), id_col, text_col, 0, 0.3)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
