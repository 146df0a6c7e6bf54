"""Toxicity: boosted trees over dense features, with isotonic calibration.

The lexicon is learned: words, and the stems of longer words, that are much
likelier in toxic training documents, by document counts taken in Spark.
Features of a text: densities of lexicon words and stems, how many of them
stand near a second-person word, capitals, punctuation, and obfuscation (signs
or digits within words, and lexicon words found after undoing them).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import Isotonic, Trees, fit_isotonic, fit_trees, out_of_fold
from .classifiers import MOST_LABELLED, features_of, labelled_sample, scored
from .common import read, remainder, slices, small_batches

STEMS = (4, 5, 6)
NEAR = 5
FOLDS = 2
MEMO = 200_000
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deiner deinen ihr euch euer sie tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())

_PLAIN = str.maketrans("013457@$!|€", "oieastasile")
_EDGE = re.compile(r"^\W+|\W+$")
_SIGNS = re.compile(r"[\W_]+")
Lexicon = dict[str, float]


def plain(token: str) -> str:
    return _EDGE.sub("", token.lower())


def unmasked(word: str) -> str:
    """A word with signs taken out and look-alike digits and signs read as letters."""
    return _SIGNS.sub("", word.translate(_PLAIN))


def _stems(word: str) -> list[str]:
    return [word[:k] + "*" for k in STEMS if len(word) >= k]


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(found: Counter) -> pa.RecordBatch:
        rows = list(found.items())
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in rows], pa.int32()), pa.array([k[1] for k, _ in rows], pa.int32()), pa.array([k[2] for k, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], names=["fold", "y", "gram", "n"])

    found: Counter = Counter()
    for batch in slices(batches):
        for fold, y, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            words = {w for w in map(plain, set(text.split())) if w}
            words |= {s for w in words for s in _stems(w)}
            found.update((fold, y, w) for w in words)
        if len(found) > 400_000:
            yield out(found)
            found = Counter()
    yield out(found)


def learn_lexicons(sample: DataFrame) -> list[Lexicon]:
    """FOLDS + 1 lexicons from (id, text, y): without each fold, and from all.

    Exact copies count once. An entry stands in at least 3 toxic documents
    (and 1 in 500 of them) and is 8 times likelier there.
    """
    once = sample.groupBy(F.xxhash64("text").alias("key"), "y").agg(F.first("text").alias("text"))
    once = once.select(F.pmod(F.col("key"), F.lit(FOLDS)).cast("int").alias("fold"), "y", "text")
    sizes = {(r["fold"], r["y"]): r["n"] for r in once.groupBy("fold", "y").agg(F.count("*").alias("n")).collect()}
    counts = once.mapInArrow(_document_counts, "fold int, y int, gram string, n long")
    wide = counts.groupBy("gram").agg(*(F.sum(F.when((F.col("fold") == f) & (F.col("y") == y), F.col("n")).otherwise(0)).alias(f"n{f}{y}") for f in range(FOLDS) for y in (0, 1)))
    toxic = sum(F.col(f"n{f}1") for f in range(FOLDS))
    clean = sum(F.col(f"n{f}0") for f in range(FOLDS))
    rows = wide.where((toxic >= 3) & (toxic * 2 > clean)).orderBy("gram").collect()  # of a bounded sample
    out = []
    for left_out in [*range(FOLDS), None]:
        use = [f for f in range(FOLDS) if f != left_out]
        n = [sum(sizes.get((f, y), 0) for f in use) for y in (0, 1)]
        found = {}
        for r in rows:
            a, b = sum(r[f"n{f}1"] for f in use), sum(r[f"n{f}0"] for f in use)
            odds = (a + 0.1) / (n[1] + 1) / ((b + 0.1) / (n[0] + 1))
            if a >= max(3 * len(use) / FOLDS, n[1] / 500) and odds >= 8:
                found[r["gram"]] = float(np.log(odds))
        out.append(found)
    return out


class Features:
    """Feature rows of texts under a lexicon; remembers tokens, up to ``MEMO`` of them."""

    #: word, stem, their log odds, unmasked hit, second person, capitals, shouting, questions, masked, characters
    WIDTH = 11

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon = lexicon
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.rows = np.zeros((4096, self.WIDTH), dtype=np.float32)

    def _add(self, token: str) -> int:
        at = len(self.known)
        if at == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        get, word, row = self.lexicon.get, plain(token), self.rows[at]
        bare = unmasked(word)
        masked = bare != word and any(c.isalpha() for c in word)
        row[2] = get(word, 0.0)
        row[0] = row[2] > 0
        stems = max((get(s, 0.0) for s in _stems(word)), default=0.0)
        row[1], row[3] = stems > 0, stems
        if masked:
            row[4] = get(bare, 0.0) > 0 or any(s in self.lexicon for s in _stems(bare))
        row[5] = word in SECOND_PERSON
        row[6] = len(word) > 2 and token.isupper()
        row[7], row[8] = token.count("!"), token.count("?")
        row[9] = masked and not word.isalpha() and "-" not in word and "'" not in word
        row[10] = len(token)
        self.known[token] = at
        return at

    def row(self, text: str | None) -> np.ndarray:
        tokens = text.split() if text else []
        if not tokens:
            return np.zeros(20)
        get, add = self.known.get, self._add
        at = np.array([i if (i := get(t)) is not None else add(t) for t in tokens])
        m = self.rows[at]
        n = len(tokens)
        total = m.sum(axis=0, dtype=np.float64)
        hit = (m[:, 0] + m[:, 1] + m[:, 4]) > 0
        hits = int(hit.sum())
        near = 0.0
        kinds = 0
        strong = 0.0
        if hits:
            where, person = np.flatnonzero(hit), np.flatnonzero(m[:, 5])
            kinds = len(np.unique(at[where]))
            strong = float((m[where, 2] + m[where, 3]).sum())
            if len(person):
                place = np.searchsorted(person, where)
                gap = np.minimum(np.abs(person[np.minimum(place, len(person) - 1)] - where), np.abs(person[np.maximum(place - 1, 0)] - where))
                near = float((gap <= NEAR).sum())
        if len(self.known) > MEMO:
            self.forget()
        return np.array([
            np.log1p(n), total[0], total[1], total[4], hits, kinds, hits / n, total[0] / n, total[1] / n, total[4] / n, strong, strong / n,
            m[:, 2].max(), m[:, 3].max(), near, near / n, total[6] / n, (total[7] + total[8]) / n, total[9] / n, total[10] / n,
        ])

    def __call__(self, texts: pa.Array) -> np.ndarray:
        return np.stack([self.row(t.as_py()) for t in texts]) if len(texts) else np.zeros((0, 20))


class _PerFold:
    """Training features: each text under the lexicon that was learned without its fold."""

    def __init__(self, features: list[Features]) -> None:
        self.features = features

    def __call__(self, texts: pa.Array) -> np.ndarray:
        rows = []
        for t in texts:
            marked = t.as_py()
            fold = int(marked[0])
            rows.append(np.append(self.features[fold].row(marked[1:]), fold))
        return np.stack(rows) if rows else np.zeros((0, 21))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", most: int = MOST_LABELLED) -> tuple[Lexicon, Trees, Isotonic]:
    """Lexicon, trees and calibration from a bounded labelled sample.

    Trees see features under lexicons learned without the document's fold;
    the calibration sees scores by trees fitted without it.
    """
    sample = labelled_sample(docs, labels, label, id_col, text_col, remainder(id_col, 5) != 0, most)
    *folds, lexicon = learn_lexicons(sample)
    # The fold travels in front of the text, as one digit.
    marked = sample.withColumn("text", F.concat(F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("string"), F.col("text")))
    x, y, _ = features_of(marked, _PerFold([Features(f) for f in folds]))
    if not len(y):
        return {}, fit_trees(np.zeros((0, 20)), np.zeros(0)), Isotonic(np.zeros(0), np.zeros(0))
    own, fold = x[:, :20], x[:, 20].astype(int)
    raw = out_of_fold(own, y, fold)
    return lexicon, fit_trees(own, y), fit_isotonic(raw, y)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, held_out, score (calibrated likelihood of label 1) and predicted (score >= 0.5).

    Fitted on at most about ``MOST_LABELLED`` labelled documents whose crc32
    of the id modulo 5 is not 0. Null, empty and blank texts are scored as
    texts without words. Without labels every score is 0.5. Rows pass one by
    one; a null id is not held out. Other columns are left out.
    """
    lexicon, trees, level = fit(docs, labels, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast((lexicon, trees, level))
    state: dict[str, Features] = {}

    def score(texts: pa.Array) -> np.ndarray:
        lexicon, trees, level = shared.value
        if "features" not in state:
            state["features"] = Features(lexicon)
        return np.clip(level(trees.predict(state["features"](texts))), 0, 1)

    return scored(docs, score, id_col, text_col, 0, 0.5)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
