"""Ranked lexical search: WAND over document shards.

Index: one pass over the whole texts keeps, for each document, the terms of the
query set that it holds and how often (``index_texts``); term weights and
length norms come from aggregates over it. A query set of any size is taken in
blocks of at most ``BLOCK`` term entries, each with a pass of its own, so what
a task is sent is bounded.

WAND: a task cuts its documents into shards of posting lists, each list with
the largest impact in it. For a query, the lists are put in order of that
maximum. The pivot is the first list at which the maxima summed so far reach the
threshold, the score of the query's last place: a document in none of the lists
from the pivot on can't be placed, so only the documents of those lists are
looked at, and the lists before the pivot are only searched for them. A
document is scored if the maxima of all lists that hold it reach the threshold,
and skipped otherwise. The documents are taken range by range, and every range
raises the threshold for the next and for the shards after it.

Merge: tasks emit at most ``top`` places a query; two windows, first over
slices of the tasks, then over the slices, give the final places.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from functools import partial, reduce
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens as T
from .common import read, slices, small_batches, stored

TOP = 50
#: Term entries of the queries that are answered in one pass
BLOCK = 200_000
#: Postings of one shard
SHARD = 4_000_000
#: Documents of the first and of the longest range
FIRST_RANGE, LONGEST_RANGE = 256, 8192
#: Slices of the tasks in the first merge
SLICES = 64
#: ``[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+``: digits, letters, and all that isn't ASCII
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
IS_TERM = (T._BYTES >= 0x80) | np.isin(T._BYTES, np.frombuffer((string.digits + string.ascii_letters).encode(), np.uint8))


class Terms:
    """Numbers of known terms, looked up by hash and confirmed by their bytes."""

    def __init__(self, terms: list[str]) -> None:
        parts = [t.encode() for t in terms]
        sizes = np.array([len(p) for p in parts], dtype=np.int64)
        self.data = np.frombuffer(b"".join(parts), dtype=np.uint8)
        ends = np.cumsum(sizes)
        hashes = T.range_hashes(self.data, ends - sizes, ends)
        order = np.argsort(hashes)
        self.hashes, self.number, self.starts, self.sizes = hashes[order], order, (ends - sizes)[order], sizes[order]
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two terms of one block have the same 64-bit hash")

    def find(self, data: np.ndarray, w: T.Words) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of the words that are known terms, and the terms' numbers."""
        hashes = T.range_hashes(data, w.starts, w.ends)
        place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        word = np.flatnonzero((self.hashes[place] == hashes) & (self.sizes[place] == w.ends - w.starts))
        place, sizes = place[word], self.sizes[place[word]]
        step = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        same = data[np.repeat(w.starts[word], sizes) + step] == self.data[np.repeat(self.starts[place], sizes) + step]
        sure = np.logical_and.reduceat(same, np.cumsum(sizes) - sizes) if len(sizes) else same
        return word[sure], self.number[place[sure]]


def _index(batches: Iterator[pa.RecordBatch], terms: list[str]) -> Iterator[pa.RecordBatch]:
    known = Terms(terms)
    for batch in slices(batches):
        sizes, counts, numbers, times = [], [], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        for chunk in T.chunks(batch.column(1)):
            data = T.LOWER[chunk.data]
            w = T.words(chunk, IS_TERM)
            word, number = known.find(data, w)
            owner = np.searchsorted(w.bounds, word, side="right") - 1
            keys, n = np.unique(owner * len(terms) + number, return_counts=True)
            counts.append(np.bincount(keys // len(terms), minlength=chunk.n))
            sizes.append(w.counts)
            numbers.append((keys % len(terms)).astype(np.int32))
            times.append(n.astype(np.int32))
        size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        offsets = np.concatenate([[0], *counts]).cumsum().astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(x))) for x in (numbers, times)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), *lists], names=["doc_id", "n", "terms", "times"]).filter(pa.array(size > 0))


def index_texts(docs: DataFrame, terms: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, terms, times) of the documents with a term: n all terms with repeats, and the numbers and occurrences of those in ``terms``."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(partial(_index, terms=terms), "doc_id long, n long, terms array<int>, times array<int>")


class Heaps:
    """The best ``top`` documents of each query: highest score, then least id, ids that are null last."""

    def __init__(self, queries: int, top: int) -> None:
        none = np.zeros(0, np.int64)
        self.top, self.best = top, [(none, none, none)] * queries

    def threshold(self, query: int) -> int:
        """A document needs this score to be placed."""
        scores = self.best[query][0]
        return int(scores[-1]) if len(scores) == self.top else 1

    def push(self, query: int, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        found = [np.concatenate(x) for x in zip(self.best[query], (scores, ids, null), strict=True)]
        order = np.lexsort((found[1], found[2], -found[0]))[: self.top]
        self.best[query] = tuple(x[order] for x in found)


class Shard:
    """Posting lists of some documents with their impacts; a list's maximum bounds what it adds to any score."""

    def __init__(self, ids: np.ndarray, null: np.ndarray, norms: np.ndarray, sizes: np.ndarray, terms: np.ndarray, times: np.ndarray, weights: np.ndarray) -> None:
        self.ids, self.null, self.n = ids, null, len(ids)
        docs = np.repeat(np.arange(self.n, dtype=np.int64), sizes)
        impacts = weights[terms] * (1_000_000_000 * times // (1000 * times + 20 * norms[docs]))
        order = np.argsort(terms, kind="stable")
        self.docs, self.impacts, ordered = docs[order], impacts[order], terms[order]
        self.keys = ordered * self.n + self.docs
        self.lists = np.arange(len(weights)) * self.n
        self.most = np.zeros(len(weights), dtype=np.int64)
        np.maximum.at(self.most, ordered, self.impacts)

    def search(self, queries: list[np.ndarray], heaps: Heaps) -> tuple[int, int]:
        """Push what can be placed; returns how many (query, document) pairs were scored, and how many were skipped after a look."""
        scored = skipped = 0
        lo, length = 0, FIRST_RANGE
        plans = []
        for terms in queries:
            terms = terms[self.most[terms] > 0]
            terms = terms[np.argsort(self.most[terms], kind="stable")]
            plans.append((terms, np.cumsum(self.most[terms])))
        while lo < self.n:
            hi = min(self.n, lo + length)
            begin, end = np.searchsorted(self.keys, self.lists + lo), np.searchsorted(self.keys, self.lists + hi)
            for query, (terms, sums) in enumerate(plans):
                a, b = self._search(query, terms, sums, lo, hi, begin, end, heaps)
                scored, skipped = scored + a, skipped + b
            lo, length = hi, min(LONGEST_RANGE, 2 * length)
        return scored, skipped

    def _search(self, query: int, terms: np.ndarray, sums: np.ndarray, lo: int, hi: int, begin: np.ndarray, end: np.ndarray, heaps: Heaps) -> tuple[int, int]:
        least = heaps.threshold(query)
        pivot = int(np.searchsorted(sums, least))
        ahead = terms[pivot:]
        sizes = end[ahead] - begin[ahead]
        total = int(sizes.sum())
        if not total:
            return 0, 0
        at = np.arange(total) + np.repeat(begin[ahead] - (np.cumsum(sizes) - sizes), sizes)
        docs, impacts = self.docs[at] - lo, self.impacts[at]
        # The maxima of the lists that hold a document, and of those that may; sums are whole and far below 2**53.
        bound = np.bincount(docs, weights=np.repeat(self.most[ahead], sizes), minlength=hi - lo).astype(np.int64)
        rest = int(sums[pivot - 1]) if pivot else 0
        looked = np.flatnonzero(bound)
        found = looked[bound[looked] + rest >= least]
        score = np.zeros(hi - lo, dtype=np.int64)
        taken = np.zeros(hi - lo, dtype=bool)
        taken[found] = True
        mine = taken[docs]
        np.add.at(score, docs[mine], impacts[mine])
        for term in terms[:pivot][::-1]:
            if not len(found):
                break
            a, b, most = begin[term], end[term], self.most[term]
            rest -= int(most)
            if a < b:
                place = a + np.minimum(np.searchsorted(self.docs[a:b], found + lo), b - a - 1)
                held = self.docs[place] == found + lo
                bound[found[held]] += most
                score[found[held]] += self.impacts[place[held]]
            found = found[bound[found] + rest >= least]
        final = found[score[found] >= least]
        if len(final):
            heaps.push(query, score[final], self.ids[final + lo], self.null[final + lo])
        return len(found), len(looked) - len(found)


def _rank(batches: Iterator[pa.RecordBatch], queries: list[np.ndarray], weights: np.ndarray, n_docs: int, n_terms: int, top: int) -> Iterator[pa.RecordBatch]:
    heaps = Heaps(len(queries), top)
    held: list[tuple[np.ndarray, ...]] = []

    def search() -> None:
        if held:
            ids, null, n, sizes, terms, times = (np.concatenate(x) for x in zip(*held, strict=True))
            norms = 100 - 50 + 50 * n * n_docs // n_terms
            Shard(ids, null, norms, sizes, terms, times, weights).search(queries, heaps)
            held.clear()

    for batch in batches:
        ids, terms, times = batch.column("doc_id"), batch.column("terms"), batch.column("times")
        held.append((ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64), batch.column("n").to_numpy(), np.diff(terms.offsets.to_numpy()), terms.flatten().to_numpy().astype(np.int64), times.flatten().to_numpy().astype(np.int64)))
        if sum(len(x[4]) for x in held) >= SHARD:
            search()
    search()
    sizes = [len(scores) for scores, _, _ in heaps.best]
    scores, ids, null = (np.concatenate([np.zeros(0, np.int64), *(x[i] for x in heaps.best)]) for i in range(3))
    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(sizes)), sizes).astype(np.int64)), pa.array(ids, mask=null > 0), pa.array(scores)], names=["query", "doc_id", "score"])


def search_block(items: DataFrame, docs: DataFrame, id_col: str, text_col: str, top: int) -> DataFrame:
    """(_row, doc_id, score, rank) for the rows (_row, terms) of one block; the block's terms come to the driver."""
    rows = items.select("_row", "terms").orderBy("_row").collect()
    if not rows:
        return docs.sparkSession.createDataFrame([], "_row long, doc_id long, score long, rank int")
    terms = sorted({t for r in rows for t in r["terms"]})
    number = {t: i for i, t in enumerate(terms)}
    queries = [np.array([number[t] for t in r["terms"]], dtype=np.int64) for r in rows]
    index = stored(index_texts(docs, terms, id_col, text_col), "search-index")
    size = index.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    df = index.select(F.explode("terms").alias("term")).groupBy("term").count()
    weight = F.floor(1000 * F.log(F.lit(float(2 * size["n"] + 2)) / (2 * F.col("count") + 1).cast("double"))).cast("long")
    weights = np.zeros(len(terms), dtype=np.int64)
    for r in df.select("term", weight.alias("w")).collect():  # at most the block's terms
        weights[r["term"]] = r["w"]
    found = index.mapInArrow(partial(_rank, queries=queries, weights=weights, n_docs=size["n"], n_terms=size["terms"], top=top), "query long, doc_id long, score long")
    by_place = [F.desc("score"), F.asc_nulls_last("doc_id")]
    place = F.row_number().over(Window.partitionBy("query", "slice").orderBy(*by_place))
    some = found.withColumn("slice", F.spark_partition_id() % SLICES).withColumn("rank", place).where(F.col("rank") <= top).drop("rank", "slice")
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*by_place))).where(F.col("rank") <= top)
    names = docs.sparkSession.createDataFrame([(i, r["_row"]) for i, r in enumerate(rows)], "query long, _row long")
    return ranked.join(F.broadcast(names), "query").select("_row", "doc_id", "score", "rank")


def lexical_search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text", top: int = TOP) -> DataFrame:
    """The ``top`` documents with the highest scores above 0 for each row of ``items``: ``item_col``, rank, ``id_col``, score.

    Terms are runs of ASCII letters and digits and of characters beyond ASCII,
    A-Z lower-cased. A document of n terms scores, for each term of the query,
    once each, w * (1e9 * tf div (1000 * tf + 20 * m)), where w is
    floor(1000 * ln((2N + 2) / (2df + 1))) and m is 100 - 50 + (50 * n * N div L).

    Equal scores are placed by id, smallest first. A null or empty text has no
    term: as a document it counts nowhere, as a query it has no rows. Rows that
    repeat a document's id are ranked each on their own, and so are rows of
    items that repeat an id; a document without an id is ranked, after those
    with ids at an equal score, and shows a null. Ids of documents are whole
    numbers, those of items of any type. Other columns are left out. An empty
    table on either side gives no rows. Building it runs the passes over ``docs``; reading the result ranks.
    """
    lowered = F.translate(F.col(query_col), string.ascii_uppercase, string.ascii_lowercase)
    wanted = items.select(F.col(item_col).alias("_item"), F.array_distinct(F.regexp_extract_all(lowered, F.lit(f"({TERM})"), F.lit(0))).alias("terms"))
    wanted = stored(wanted.where(F.size("terms") > 0).withColumn("_row", F.monotonically_increasing_id()), "search-items")
    total = wanted.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, ceil(total / BLOCK))
    while True:
        # Blocks of equal expected size; more of them, until each is within the bound or is one query.
        block = F.pmod(F.xxhash64("_row"), F.lit(blocks)).cast("int")
        sizes = wanted.groupBy(block.alias("block")).agg(F.sum(F.size("terms")).alias("n"), F.count("*").alias("rows"))
        if not sizes.where((F.col("n") > 2 * BLOCK) & (F.col("rows") > 1)).limit(1).count():
            break
        blocks *= 2
    parts = [search_block(wanted.where(block == b), docs, id_col, text_col, top) for b in range(blocks)]
    found = reduce(DataFrame.unionByName, parts)
    kind = docs.schema[id_col].dataType.simpleString()
    named = found.join(wanted.select("_row", "_item"), "_row")
    return named.select(F.col("_item").alias(item_col), "rank", F.col("doc_id").cast(kind).alias(id_col), "score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return lexical_search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents
), q AS (
  SELECT item_id, unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term FROM benchmark
), sizes AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n FROM d WHERE len(ws) > 0),
totals AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM sizes),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ws) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(nn) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, totals WHERE term IN (SELECT term FROM q) GROUP BY term),
s AS (
  SELECT q.item_id, tf.doc_id, CAST(sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 20 * (100 - 50 + (50 * n * nn) // ll)))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN sizes USING (doc_id), totals GROUP BY ALL
), r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""
