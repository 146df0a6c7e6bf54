"""Benchmark decontamination, in DataFrame functions alone.

The distinct word windows of the benchmark are hashed and broadcast in pieces
of at most ``PIECE`` windows, whose number is counted first; each pass scans
the windows of the documents against one piece, and every hash hit is verified
by comparing the words. A benchmark of any size thus keeps a bounded broadcast
and costs one pass over the documents for each piece. A broadcast row names its
window by a number; which items hold it is joined afterwards, to the distinct
windows that a document has, so a passage in every item costs no broadcast.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, stored

WIDTH = 13
#: Most windows in one broadcast: about 150 bytes each
PIECE = 200_000
#: The key by which each document passes the join once; no window has it, as hits are verified.
_SELF = 0

#: What stands between words: ASCII other than digits and small letters
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    lowered = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(F.array_remove(F.split(lowered, BETWEEN), ""), F.array().cast("array<string>"))


def _window_hash(codes: Column, length: int) -> Column:
    """The hash of the ``length`` word codes from each position on."""
    at_each = F.transform(F.sequence(F.lit(0), F.size(codes) - length), lambda i: F.xxhash64(*(F.get(codes, i + j) for j in range(length))))
    return F.when(F.size(codes) >= length, at_each).otherwise(F.array().cast("array<bigint>"))


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(length, win, item): the windows of each item, once for each item that holds them.

    ``width`` consecutive words; an item of fewer words, but not none, is one window.
    """
    w = benchmark.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    w = w.select("item", "w", F.least(F.size("w"), F.lit(width)).alias("length"))
    cut = w.select("item", "length", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("length") + 1), lambda i: F.slice("w", i, F.col("length")))).alias("win"))
    return cut.select("length", "win", "item").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """How far each document consists of windows of the benchmark.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z
    lower-cased. Returns ``id_col``, n_words, n_hit (words inside any window),
    n_items, items (sorted ids as strings), items_sha256, hit_positions
    (sorted, from 0) and contaminated (n_hit > 0 and 20 * n_hit >= n_words).

    One row for each distinct (id, text): repeated rows are one. A null or
    empty text has no words and is clean. Null ids are ids of their own kind:
    documents pass with a null id, items with a null id hit but are not
    counted or listed. Other columns are left out. An empty benchmark hits
    nothing; an empty table gives no rows.
    """
    held = stored(benchmark_windows(benchmark, width=width), "benchmark-windows")
    # The number of a window is fixed once it is stored.
    windows = stored(held.groupBy("length", "win").agg(F.count("*").alias("n")).select("length", "win", F.monotonically_increasing_id().alias("window")), "distinct-windows")
    items_of = held.join(windows, ["length", "win"]).where("item IS NOT NULL").select("window", "item")
    lengths = sorted(r[0] for r in windows.select("length").distinct().collect())  # width of them at most
    pieces = max(1, -(-windows.count() // PIECE))
    words = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_text"), words_of(F.col(text_col)).alias("_w"))
    coded = words.select("_id", "_text", "_w", F.transform("_w", lambda x: F.xxhash64(x)).alias("_codes"))
    hashed = coded.select("_id", "_text", "_w", F.concat(*(_window_hash(F.col("_codes"), n) for n in lengths), F.array(F.lit(_SELF).cast("bigint"))).alias("_hashes"))
    # An index into the joined lists of windows becomes a position: what shorter lengths have comes first.
    spread = hashed.select("_id", "_text", "_w", F.posexplode_outer("_hashes").alias("_k", "_hash"))
    size = F.size("_w")
    before, skipped = F.lit(0), F.lit(0)
    for n in lengths:
        before = F.when(F.col("_length") == n, skipped).otherwise(before)
        skipped = skipped + F.greatest(size - n + 1, F.lit(0))
    position = F.col("_k") - before
    same = F.concat_ws(" ", *(F.when(F.col("_length") > j, F.get("_w", position + j)) for j in range(width)))

    code = reduce(lambda e, n: F.when(F.size("_codes") == n, F.xxhash64(*(F.get("_codes", F.lit(j)) for j in range(n)))).otherwise(e), lengths, F.lit(None).cast("bigint"))
    keyed = windows.select("length", "win", "window", F.transform("win", lambda x: F.xxhash64(x)).alias("_codes")).select(code.alias("_key"), F.col("length").alias("_length"), F.array_join("win", " ").alias("_win"), "window")
    each = docs.sparkSession.range(1).select(F.lit(_SELF).cast("long").alias("_key"), F.lit(0).alias("_length"), F.lit("").alias("_win"), F.lit(None).cast("long").alias("window"))
    found = []
    for k in range(pieces):
        piece = keyed.where(F.pmod("_key", F.lit(pieces)) == k)
        piece = piece.union(each) if k == 0 else piece
        hit = spread.join(F.broadcast(piece), (F.col("_hash") == F.col("_key")) & (same == F.col("_win")))
        found.append(hit.select("_id", "_text", size.alias("n_words"), position.alias("_at"), "_length", "window"))
    hits = stored(reduce(DataFrame.union, found), "hits")
    doc = ["_id", "_text", "n_words"]
    items = hits.where("window IS NOT NULL").select(*doc, "window").distinct().join(items_of, "window").select(*doc, "item").distinct()
    both = hits.select(*doc, "_at", "_length", F.lit(None).cast("string").alias("item")).union(items.select(*doc, F.lit(None).cast("int"), F.lit(0), "item"))
    spans = F.collect_list(F.when(F.col("_length") > 0, F.sequence("_at", F.col("_at") + F.col("_length") - 1)))
    # A document's windows, and the items that they are of, bound what a group gathers.
    per_doc = both.groupBy(*doc).agg(F.array_sort(F.array_distinct(F.flatten(spans))).alias("hit_positions"), F.array_sort(F.collect_set("item")).alias("items"))
    n_hit = F.size("hit_positions").cast("long")
    return per_doc.select(
        F.col("_id").alias(id_col),
        F.col("n_words").cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        "items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "hit_positions",
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def remove_spans(docs: DataFrame, hits: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents with the words of benchmark windows cut out; a text without hits stays as it is.

    What is left of a text with hits is its lower-cased words, joined by one space.
    """
    found = hits.where("n_hit > 0").select(F.col(id_col).alias("_key"), "hit_positions")
    joined = docs.join(found, docs[id_col] == found["_key"], "left")
    kept = F.filter(words_of(F.col(text_col)), lambda _, i: ~F.array_contains("hit_positions", i))
    return joined.withColumn(text_col, F.when(F.col("_key").isNull(), F.col(text_col)).otherwise(F.array_join(kept, " "))).drop("_key", "hit_positions")


def remove_documents(docs: DataFrame, hits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents without those that are contaminated."""
    bad = hits.where("contaminated").select(F.col(id_col).alias("_key"))
    return docs.join(bad, docs[id_col] == bad["_key"], "left_anti")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(ws), 13) AS n, array_to_string(ws[i:i + least(len(ws), 13) - 1], ' ') AS win
  FROM b, UNNEST(range(1, len(ws) - least(len(ws), 13) + 2)) AS r(i) WHERE len(ws) > 0
), dw AS (
  SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS win
  FROM d, (SELECT DISTINCT n FROM bw) AS lengths, UNNEST(range(1, len(ws) - n + 2)) AS r(i) WHERE len(ws) >= n
), hit AS (SELECT doc_id, item_id, i, n FROM dw JOIN bw USING (n, win)),
per_doc AS (
  SELECT doc_id, len(list_distinct(flatten(list(range(i, i + n))))) AS n_hit,
         list_sort(list_distinct(list(CAST(item_id AS VARCHAR)))) AS items FROM hit GROUP BY doc_id
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN per_doc USING (doc_id)
"""
