"""Language ID by word-first backoff.

A known word scores by its log frequency in each language; an unseen word falls
back to its character n-grams, the longest length of which any is known, down
to single letters. Counts are learned in Spark from a bounded sample of labelled
documents; every text is then scored whole, on its own, without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, remainder, slices, small_batches

#: Labelled documents per language to learn from; a language's sample is a hash range of its ids.
PER_LANGUAGE = 400
#: More different values than this in the language column are not languages: fitting then fails.
MOST_LANGUAGES = 1000
LONGEST = 4
UNKNOWN = "und"
#: Words that a worker remembers the scores of
MEMO = 300_000

_WORD = re.compile(r"[^\W\d_]+")


def _grams(word: str, size: int) -> list[str]:
    padded = f"^{word}$" if size > 1 else word
    return [padded[i : i + size] for i in range(len(padded) - size + 1)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(found: Counter) -> pa.RecordBatch:
        rows = [(lang, kind, gram, n) for (lang, kind, gram), n in found.items()]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.int64())], names=["lang", "kind", "gram", "n"])

    def grams(words: Counter) -> Counter:
        found: Counter = Counter()
        for (lang, word), n in words.items():
            found[lang, 0, word] += n
            for size in range(1, LONGEST + 1):
                for gram in _grams(word, size):
                    found[lang, size, gram] += n
        return found

    words: Counter = Counter()
    for batch in slices(batches):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words.update((lang, w) for w in _WORD.findall((text or "").lower()))
        if len(words) > 50_000:
            yield out(grams(words))
            words = Counter()
    yield out(grams(words))


@dataclass
class Model:
    """Rows of per-language log frequencies, by word and by n-gram of each length."""

    languages: list[str]
    words: dict[str, np.ndarray]
    grams: list[dict[str, int]]  # by length, from 0 (unused): a row of gram_rows
    gram_rows: np.ndarray

    def word(self, word: str) -> np.ndarray:
        """What a word adds to each language: log frequencies less their logarithmic sum."""
        if (row := self.words.get(word)) is not None:
            return row
        for size in range(LONGEST, 0, -1):
            get = self.grams[size].get
            if at := [i for g in _grams(word, size) if (i := get(g)) is not None]:
                return np.add.reduce(self.gram_rows[at]) / np.float32(len(at))
        return np.zeros(len(self.languages), dtype=np.float32)


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", use: Column | None = None) -> Model:
    """Learn from a sample of the documents (``use``) with a language.

    The sample holds about ``PER_LANGUAGE`` documents of each language, the
    same ones at every run; the model keeps all their words and n-grams.
    Without labelled documents the model is empty; with more than
    ``MOST_LANGUAGES`` languages a ValueError says so.
    """
    spark = docs.sparkSession
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.lit(True) if use is None else use)).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"{lang_col} has more than {MOST_LANGUAGES} different values")
    place = F.pmod(F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit(""))), F.lit(1 << 20))
    chosen = F.lit(False)
    for lang, n in sizes.items():
        chosen = F.when(F.col("lang") == lang, place < int(min(1.0, PER_LANGUAGE / n) * (1 << 20))).otherwise(chosen)
    counts = labelled.where(chosen).select("lang", "text").mapInArrow(_count, "lang string, kind int, gram string, n long").groupBy("lang", "kind", "gram").agg(F.sum("n").alias("n")).cache()
    total = {(r["lang"], r["kind"]): r["n"] for r in counts.groupBy("lang", "kind").agg(F.sum("n").alias("n")).collect()}
    languages = sorted({lang for lang, _ in total})
    by_gram = counts.groupBy("kind", "gram").agg(F.sum("n").alias("total"), *(F.sum(F.when(F.col("lang") == lang, F.col("n")).otherwise(0)).alias(f"n{i}") for i, lang in enumerate(languages)))
    model = Model(languages, {}, [{} for _ in range(LONGEST + 1)], np.zeros((0, len(languages)), dtype=np.float32))
    sums = np.array([[total.get((lang, kind), 0) for lang in languages] for kind in range(LONGEST + 1)], dtype=np.float64)
    for is_word in (True, False):
        rows = by_gram.where((F.col("kind") == 0) == F.lit(is_word)).toArrow()  # of a bounded sample
        kind = rows["kind"].to_numpy()
        seen = np.stack([rows[f"n{i}"].to_numpy() for i in range(len(languages))], axis=1) if languages else np.zeros((len(rows), 0))
        logs = np.log((seen + 0.1) / (sums[kind] + 1))
        logs = (logs - np.logaddexp.reduce(logs, axis=1, keepdims=True)).astype(np.float32) if languages else logs
        names = rows["gram"].to_pylist()
        if is_word:
            model.words = dict(zip(names, logs, strict=True))
        else:
            model.gram_rows = logs
            for i, (gram, k) in enumerate(zip(names, kind.tolist(), strict=True)):
                model.grams[k][gram] = i
    counts.unpersist()
    return model


class Scorer:
    """Scores texts; remembers the rows of words it has met, up to ``MEMO`` of them."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.rows = np.zeros((1024, len(self.model.languages)), dtype=np.float32)

    def _add(self, word: str) -> int:
        at = len(self.known)
        if at == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[at] = self.model.word(word)
        self.known[word] = at
        return at

    def __call__(self, text: str | None) -> tuple[str, float]:
        words = _WORD.findall(text.lower()) if text else []
        if not self.model.languages or not any(any(map(str.isalpha, w)) for w in words):
            return UNKNOWN, 0.0
        get, add = self.known.get, self._add
        at = [i if (i := get(w)) is not None else add(w) for w in words]
        total = self.rows[at].sum(axis=0, dtype=np.float64) / np.sqrt(len(words))
        if len(self.known) > MEMO:
            self.forget()
        odds = np.exp(total - total.max())
        best = int(odds.argmax())
        return self.model.languages[best], float(odds[best] / odds.sum())


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of each row, with lang_pred and score.

    score is the softmax over the languages of the summed log frequencies,
    tempered by the square root of the number of words. A text that is null
    or has no letter is ``und`` with score 0. Ties go to the language that
    sorts first. Rows pass one by one: repeated rows give repeated results,
    an empty table none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in slices(batches):
            found = [scorer(x.as_py()) for x in batch.column("_text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(f"_{i}") for i in range(len(keep))), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[*(f"_{i}" for i in range(len(keep))), "_pred", "_score"])

    inputs = docs.select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(keep)), F.col(text_col).alias("_text"))
    schema = ", ".join(f"_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)) + ", _pred string, _score double"
    out = inputs.mapInArrow(score, schema)
    return out.select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(keep)), F.col("_pred").alias("lang_pred"), F.col("_score").alias("score"))


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``id_col``, held_out, lang_pred and score for every document.

    Learned from the documents whose crc32 of the id modulo 4 is not 2; the
    others are held out. A null id is neither held out nor learned from.
    """
    held_out = F.coalesce(remainder(id_col, 4) == 2, F.lit(False))
    model = fit(docs, text_col, lang_col, id_col, use=remainder(id_col, 4) != 2)
    found = identify(docs, model, text_col, (id_col,))
    return found.select(id_col, held_out.alias("held_out"), "lang_pred", "score")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return language_id(read(spark, sf_dir, "documents"))
