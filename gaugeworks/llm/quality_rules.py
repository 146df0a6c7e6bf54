"""Quality rules: repetition coverage.

Rolling hashes of several n-gram lengths, in numpy over whole Arrow batches,
measure which characters of a text lie inside n-grams that occur before in the
same text, and which lie in repeated lines. There is no shuffle: each text is
judged on its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens as T
from .common import read, slices, small_batches

REPEAT_WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30

_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))


@dataclass(frozen=True)
class Rules:
    """Largest shares that a kept text may have.

    duplicated: for each n-gram length, the share of word characters inside
    n-grams that occurred before in the text. top: for each shorter length,
    the share inside all occurrences of the most frequent n-gram (if it
    occurs at least ``top_least`` times). lines, line_chars: lines equal to an
    earlier line, by number and by characters. symbols: symbols per word.
    The shares are those published for repetition removal in web corpora.
    """

    duplicated: tuple[tuple[int, float], ...] = ((5, 0.15), (6, 0.14), (7, 0.13), (8, 0.12), (9, 0.11), (10, 0.10))
    top: tuple[tuple[int, float], ...] = ((2, 0.20), (3, 0.18), (4, 0.16))
    top_least: int = 3
    lines: float = 0.30
    line_chars: float = 0.20
    symbols: float = 0.30


def _earlier(keys: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For entries in text order: seen before in its text; seen at least twice in it; how often in it."""
    mixed = T.mix(keys ^ T.mix(text.astype(np.uint64)))
    s = np.sort(mixed)
    twice = s[1:][s[1:] == s[:-1]]
    few = np.flatnonzero(_member(mixed, twice))
    order = few[np.argsort(mixed[few], kind="stable")]
    s = mixed[order]
    new = np.ones(len(s), dtype=bool)
    new[1:] = s[1:] != s[:-1]
    counts = np.diff(np.append(np.flatnonzero(new), len(s)))
    before = np.zeros(len(keys), dtype=bool)
    before[order] = ~new
    often = np.ones(len(keys), dtype=np.int64)
    often[order] = np.repeat(counts, counts)
    return before, often > 1, often


def _member(values: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Which values are among ``found`` (sorted): a table of their low bits first, then a search for those that pass."""
    if not len(found):
        return np.zeros(len(values), dtype=bool)
    bits = np.uint64(max(10, int(4 * len(found)).bit_length()))
    table = np.zeros(1 << int(bits), dtype=bool)
    low = (np.uint64(1) << bits) - np.uint64(1)
    table[found & low] = True
    out = table[values & low]
    at = np.flatnonzero(out)
    place = np.minimum(np.searchsorted(found, values[at]), len(found) - 1)
    out[at] = found[place] == values[at]
    return out


def _most_frequent(win: np.ndarray, often: np.ndarray, text: np.ndarray, n: int, least: int) -> np.ndarray:
    """The occurrences of the most frequent n-gram of each text; of equally frequent ones the first counts."""
    highest = np.zeros(n, dtype=np.int64)
    np.maximum.at(highest, text, often)
    top = np.flatnonzero((often == highest[text]) & (often >= least))
    lead = np.full(n, len(win), dtype=np.int64)
    np.minimum.at(lead, text[top], top)
    return top[win[top] == win[lead[text[top]]]]


def _measure(chunk: T.Chunk, rules: Rules) -> dict[str, np.ndarray]:
    data, n = chunk.data, chunk.n
    w = T.words(chunk)
    total = int(w.bounds[-1])
    text_of = w.text_of()
    points = np.concatenate(([0], np.cumsum(T.IS_POINT[data])))
    chars = points[w.ends] - points[w.starts]
    symbol = np.concatenate(([0], np.cumsum(_SYMBOL[data])))
    hashes = T.range_hashes(data, w.starts, w.ends)
    out = {"n_words": w.counts, "word_chars": T.per_text_sum(chars, w.bounds), "n_symbols": symbol[chunk.offsets[1:]] - symbol[chunk.offsets[:-1]]}
    word_chars = np.maximum(out["word_chars"], 1)

    # Lines: cut at \n and at the ends of texts; those with a word count. The end of a text and a \n that the next
    # begins with are at one place, yet are two ends: one line starts there, and one after the \n.
    breaks = np.flatnonzero(data == 10)
    ends = np.sort(np.concatenate((breaks, chunk.offsets[1:])))
    starts = np.sort(np.concatenate((breaks + 1, chunk.offsets[:-1])))
    first, last = np.searchsorted(w.starts, starts), np.searchsorted(w.starts, ends)
    real = last > first
    starts, ends, first, last = starts[real], ends[real], first[real], last[real]
    line_text = text_of[first] if total else np.zeros(0, int)
    again, _, _ = _earlier(T.range_hashes(data, starts, ends), line_text)
    char_sum = np.concatenate(([0], np.cumsum(chars)))
    line_chars = char_sum[last] - char_sum[first]
    out["n_lines"] = np.bincount(line_text, minlength=n)
    out["n_dup_lines"] = np.bincount(line_text[again], minlength=n)
    out["dup_line_chars"] = np.bincount(line_text[again], weights=line_chars[again], minlength=n)

    # Lengths in rising order: an n-gram can only repeat where the shorter one from the same word does.
    repeat_at = np.zeros(0, dtype=np.int64)
    verdict = np.ones(n, dtype=bool)
    worst, top_share = np.zeros(n), np.zeros(n)
    top, duplicated = dict(rules.top), dict(rules.duplicated)
    room = np.repeat(w.bounds[1:], w.counts) - np.arange(total)
    at = np.arange(total)
    for size in sorted({*top, *duplicated, REPEAT_WINDOW}):
        at = at[room[at] >= size]
        win = T.window_hashes(hashes, at, size)
        before, repeated, often = _earlier(win, text_of[at])
        at, win, before, often = at[repeated], win[repeated], before[repeated], often[repeated]
        if size == REPEAT_WINDOW:
            repeat_at = at
        if size in duplicated:
            share = T.per_text_sum(T.covered(total, at[before], size) * chars, w.bounds) / word_chars
            worst = np.maximum(worst, share)
            verdict &= share <= duplicated[size]
        if size in top:
            share = T.per_text_sum(T.covered(total, at[_most_frequent(win, often, text_of[at], n, rules.top_least)], size) * chars, w.bounds) / word_chars
            top_share = np.maximum(top_share, share)
            verdict &= share <= top[size]
    # Words in windows that occur at least twice, the first included.
    out["n_repeat_words"] = T.per_text_sum(T.covered(total, repeat_at, REPEAT_WINDOW), w.bounds)
    lines = np.maximum(out["n_lines"], 1)
    verdict &= (out["n_dup_lines"] / lines <= rules.lines) & (out["dup_line_chars"] / word_chars <= rules.line_chars)
    verdict &= out["n_symbols"] <= rules.symbols * np.maximum(out["n_words"], 1)
    failed = (out["n_words"] < LEAST_WORDS) | (100 * out["n_repeat_words"] > MOST_REPEATED_PERCENT * out["n_words"])
    return out | {"dup_char_share": worst, "top_char_share": top_share, "base_failed": failed, "kept": ~failed & verdict}


_LONGS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _apply(batches: Iterator[pa.RecordBatch], rules: Rules) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        parts = [_measure(c, rules) for c in T.chunks(batch.column(1))]
        col = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]} if parts else {}
        arrays = [batch.column(0)] + [pa.array(col.get(k, np.zeros(0)).astype(np.int64)) for k in _LONGS]
        arrays += [pa.array(col.get(k, np.zeros(0, bool)).astype(bool)) for k in ("base_failed", "kept")]
        arrays += [pa.array(col.get(k, np.zeros(0)).astype(float)) for k in ("dup_char_share", "top_char_share")]
        yield pa.RecordBatch.from_arrays(arrays, names=["_id", *_LONGS, "base_failed", "kept", "dup_char_share", "top_char_share"])


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules | None = None) -> DataFrame:
    """Counts of repetition, and the verdict of ``rules``, for each text.

    Returns one row per input row (repeated rows give repeated results):
    ``id_col``, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, dup_char_share and top_char_share. A null or empty text
    has no words: every count is 0, base_failed true and kept false. A null id
    is passed through. Other columns are left out, so names can't clash.
    """
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    schema = f"_id {docs.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in _LONGS) + ", base_failed boolean, kept boolean, dup_char_share double, top_char_share double"
    chosen = rules or Rules()
    return texts.mapInArrow(lambda b: _apply(b, chosen), schema).withColumnRenamed("_id", id_col)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return quality_rules(read(spark, sf_dir, "documents"))
