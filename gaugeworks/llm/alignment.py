"""Alignment of two tokenizers over a corpus, by a cogroup of postings.

Tokens: both tokenizers cut texts at blanks after a character that isn't one,
which no token of either crosses (checked when they are loaded). A text is thus
a row of short segments, and the tokens, groups and links of a segment are
worked out once and kept while there is room.

Postings: every document's linked id pairs with their multiplicities are dealt
out by their side id (B's), in ``BUCKETS`` buckets of B ids and as many slices
of documents as the pairs need, so that a frequent id is spread over all
slices. The counts of all pairs, summed by Spark, go to every slice of their
bucket. Counts and postings meet as streams that Spark sorts and may spill: a
task reads the counts of one bucket, finds the maximum of each B id, and then
takes its postings block by block. It emits each document's contributions,
which are summed by document.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import accumulate

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, slices, small_batches, spent, stored

#: Where the vocabularies are
TOKENIZERS = "file:///opt/tokenizers"
BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Buckets of B ids
BUCKETS = 16
#: Pairs of one bucket and slice, on average
PAIRS = 4_000_000
#: What is kept of segments: their number, and the characters of all
MOST_SEGMENTS, MOST_CHARS = 1 << 19, 1 << 25
#: Characters of text that are aligned at once (or one longer text)
CHARS = 1 << 20
#: How byte-level vocabularies cut texts before merging; a fixed value.
PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A segment: a blank or line end after a character that isn't white space, and what follows up to the next such place
_SEGMENT = re.compile(r"[ \n]?[^ \n]*(?:(?<=\s)[ \n][^ \n]*)*")


def _byte_of() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others, in order, as characters from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def byte_level_encoding(file: bytes) -> tiktoken.Encoding:
    """The encoder of a byte-level vocabulary file, without its special tokens.

    Its ids must ascend in the order of its merges, so that merging the pair
    with the least id is merging by rank.
    """
    model, byte_of = json.loads(file)["model"], _byte_of()
    special = {x["content"] for x in json.loads(file)["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    merges = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
    if merges != sorted(merges):
        raise ValueError("ids don't ascend with the merges")
    return tiktoken.Encoding("byte-level", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})


def piece_bytes(pieces: sentencepiece.SentencePieceProcessor) -> list[bytes]:
    """The bytes of each id: U+2581 is a space, and a byte piece is its byte."""
    names = [pieces.id_to_piece(i) for i in range(pieces.vocab_size())]
    return [bytes([int(name[3:5], 16)]) if pieces.is_byte(i) else name.replace("▁", " ").encode() for i, name in enumerate(names)]


class Grown:
    """A numpy array that grows by doubling."""

    def __init__(self, dtype: type) -> None:
        self.room, self.n = np.zeros(1024, dtype=dtype), 0

    def extend(self, values: list) -> None:
        while self.n + len(values) > len(self.room):
            self.room = np.concatenate((self.room, np.zeros_like(self.room)))
        self.room[self.n : self.n + len(values)] = values
        self.n += len(values)

    @property
    def values(self) -> np.ndarray:
        return self.room[: self.n]


class Aligner:
    """Aligns texts, and remembers the segments that it has seen."""

    def __init__(self, byte_level: bytes, pieces: bytes) -> None:
        self.a = byte_level_encoding(byte_level)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        self.b_bytes = piece_bytes(self.b)
        self.lead = self.b.encode("a")  # put before a segment, so that none begins a text
        names = [self.b.id_to_piece(i) for i in range(len(self.b_bytes)) if not self.b.is_byte(i)]
        self.cuts = not any("\n" in x or " " in x or re.search("[^▁]▁", x) for x in names)
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: list[str] = []
        self.chars = 0
        self.n_a, self.n_b, self.n_links, self.bad = Grown(np.int64), Grown(np.int64), Grown(np.int64), Grown(np.bool_)
        self.link_a, self.link_b = Grown(np.int64), Grown(np.int64)

    def segments(self, text: str) -> list[str]:
        found = _SEGMENT.findall(" " + text) if self.cuts else [" " + text]
        return found if found[-1] else found[:-1]

    def learn(self, new: list[str]) -> None:
        bs = self.b.encode(["a" + s for s in new], num_threads=1)
        for segment, with_lead in zip(new, bs, strict=True):
            a, b, data = self.a.encode_ordinary(segment), with_lead[len(self.lead) :], segment.encode()
            a_bytes = self.a.decode_tokens_bytes(a)
            b_bytes = [self.b_bytes[i] for i in b]
            good = with_lead[: len(self.lead)] == self.lead and b"".join(a_bytes) == data == b"".join(b_bytes)
            self.number[segment] = len(self.groups)
            self.chars += len(segment)
            groups, linked_a, linked_b = align(a, list(accumulate(map(len, a_bytes))), b, list(accumulate(map(len, b_bytes)))) if good else ("", [], [])
            self.groups.append(groups)
            for grown, value in ((self.n_a, len(a)), (self.n_b, len(b)), (self.n_links, len(linked_a)), (self.bad, not good)):
                grown.extend([value])
            self.link_a.extend(linked_a)
            self.link_b.extend(linked_b)

    def numbers(self, segments: list[str]) -> np.ndarray:
        if len(self.groups) > MOST_SEGMENTS or self.chars > MOST_CHARS:
            self.forget()
        new = list(dict.fromkeys(s for s in segments if s not in self.number))
        if new:
            self.learn(new)
        return np.fromiter(map(self.number.__getitem__, segments), np.int64, len(segments))


def align(a: list[int], a_ends: list[int], b: list[int], b_ends: list[int]) -> tuple[str, list[int], list[int]]:
    """The groups that common ends cut, as text, and the linked ids of either side: the tokens that end together."""
    groups, linked_a, linked_b = [], [], []
    i = j = 0
    for end in sorted({*a_ends} & {*b_ends}):
        to_a, to_b = a_ends.index(end, i) + 1, b_ends.index(end, j) + 1
        groups.append(",".join(map(str, a[i:to_a])) + "|" + ",".join(map(str, b[j:to_b])))
        linked_a.append(a[to_a - 1])
        linked_b.append(b[to_b - 1])
        i, j = to_a, to_b
    return ";".join(groups), linked_a, linked_b


@lru_cache(maxsize=2)
def aligner(byte_level: bytes, pieces: bytes) -> Aligner:
    """One for a Python worker, whatever the number of its tasks."""
    return Aligner(byte_level, pieces)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """Ids and texts, about ``CHARS`` characters at a time."""
    for batch in slices(batches):
        sizes = np.array([len(x) if x is not None else 0 for x in (y.as_py() for y in batch.column(1))])
        lo = 0
        while lo < batch.num_rows:
            hi = lo + max(1, int(np.searchsorted(np.cumsum(sizes[lo:]), CHARS)))
            yield batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo).to_pylist()
            lo = hi


def _encode(batches: Iterator[pa.RecordBatch], files: list[bytes]) -> Iterator[pa.RecordBatch]:
    known = aligner(*files)
    for ids, texts in _pieces(batches):
        cut = [known.segments(text) if text else [] for text in texts]
        counts = np.array([len(x) for x in cut], dtype=np.int64)
        numbers = known.numbers([s for segments in cut for s in segments])
        del cut
        owner = np.repeat(np.arange(len(texts)), counts)
        spoilt = np.bincount(owner, weights=known.bad.values[numbers], minlength=len(texts)) > 0
        keep = ~spoilt[owner]
        numbers, owner = numbers[keep], owner[keep]
        counts[spoilt] = 0
        n_a, n_b, n_links = (np.bincount(owner, weights=x.values[numbers], minlength=len(texts)).astype(np.int64) for x in (known.n_a, known.n_b, known.n_links))
        each = known.n_links.values[numbers]
        begins = np.cumsum(known.n_links.values) - known.n_links.values
        at = np.arange(int(each.sum())) + np.repeat(begins[numbers] - (np.cumsum(each) - each), each)
        # One pair of a document: its number, B's id, A's id
        keys = (np.repeat(owner, each) << 48) | (known.link_b.values[at] << 24) | known.link_a.values[at]
        keys, times = np.unique(keys, return_counts=True)
        bounds = np.searchsorted(keys, np.arange(len(texts) + 1) << 48)
        b, a, times = ((keys >> 24) & 0xFFFFFF).astype("<u4"), (keys & 0xFFFFFF).astype("<u4"), times.astype("<u4")
        packed, digests = [], []
        ends = np.cumsum(counts)
        for i, (lo, hi) in enumerate(zip(bounds, bounds[1:], strict=False)):
            packed.append(planes(b[lo:hi], a[lo:hi], times[lo:hi]) if hi > lo else None)
            groups = ";".join(map(known.groups.__getitem__, numbers[ends[i] - counts[i] : ends[i]].tolist()))
            digests.append(hashlib.sha256(groups.encode()).hexdigest() if groups else "")
        columns = [pa.array(x) for x in (n_a, n_b, n_links, n_links)]
        yield pa.RecordBatch.from_arrays([ids, *columns, pa.array(digests, pa.string()), pa.array(np.diff(bounds)), pa.array(packed, pa.binary())], names=["_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_pairs", "pairs"])


def planes(*columns: np.ndarray) -> bytes:
    """Columns of unsigned 32-bit values, all low bytes first, then the next bytes, which are mostly equal and compress well."""
    return b"".join(np.ascontiguousarray(c.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for c in columns)


def unplaned(data: bytes, columns: int) -> list[np.ndarray]:
    parts = np.frombuffer(data, np.uint8).reshape(columns, 4, -1)
    return [np.ascontiguousarray(p.T).view("<u4").ravel().astype(np.int64) for p in parts]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(b, a, n): multiplicities summed within the task, some millions of pairs at a time."""
    keys, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0

    def summed() -> tuple[np.ndarray, np.ndarray]:
        k, t = (np.concatenate(x) for x in zip((keys, times), *held, strict=True))
        order = np.argsort(k, kind="stable")
        k, t = k[order], t[order]
        heads = np.flatnonzero(np.diff(k, prepend=-1))
        return k[heads], np.add.reduceat(t, heads) if len(heads) else t

    def out(k: np.ndarray, t: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array((k >> 32).astype(np.int32)), pa.array((k & 0xFFFFFFFF).astype(np.int32)), pa.array(t)], names=["b", "a", "n"])

    for batch in batches:
        for x in batch.column(0):
            b, a, t = unplaned(x.as_py(), 3)
            held.append(((b << 32) | a, t))
            n += len(t)
            if n > 2_000_000:
                keys, times = summed()
                held, n = [], 0
                if len(keys) > 2_000_000:
                    yield out(keys, times)
                    keys, times = keys[:0], times[:0]
    yield out(*summed())


def _deal(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Postings of some documents by bucket: (slice, bucket, rows, pairs), pairs sorted by (b, a) and holding a place in rows."""
    for batch in slices(batches):
        rows = batch.column(0).to_numpy()
        found = [unplaned(x.as_py(), 3) for x in batch.column(1)]
        place = np.repeat(np.arange(len(rows)), [len(x[0]) for x in found])
        b, a, times = (np.concatenate([np.zeros(0, np.int64), *(x[i] for x in found)]) for i in range(3))
        order = np.argsort(((b % BUCKETS) << 56) | (b << 28) | a, kind="stable")
        b, a, times, place = b[order], a[order], times[order], place[order]
        bounds = np.searchsorted(b % BUCKETS, np.arange(BUCKETS + 1))
        used = [i for i in range(BUCKETS) if bounds[i] < bounds[i + 1]]
        part = (int(rows[0]) * 0x9E3779B1 >> 16) % parts if len(rows) else 0
        packed = [planes(*(x[bounds[i] : bounds[i + 1]] for x in (b, a, times, place))) for i in used]
        n = len(used)
        yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array(used, pa.int32()), pa.array([rows.tolist()] * n, pa.list_(pa.int64())), pa.array(packed, pa.binary())], names=["part", "bucket", "rows", "pairs"])


def _contribute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_row, n_best, count_sum) from streams sorted by (part, bucket, kind, b): the counts of a bucket come before its postings."""
    now, keys, counts, best = None, [], [], []
    ready: tuple[np.ndarray, ...] | None = None
    for batch in batches:
        rows_out, best_out, sum_out = [], [], []
        for i in range(batch.num_rows):
            this = (batch.column("part")[i].as_py(), batch.column("bucket")[i].as_py())
            if this != now:
                now, keys, counts, best, ready = this, [], [], [], None
            if batch.column("kind")[i].as_py() == 0:
                n = batch.column("n")[i].values.to_numpy()
                keys.append((batch.column("b")[i].as_py() << 32) | batch.column("a")[i].values.to_numpy().astype(np.int64))
                counts.append(n)
                best.append(n == n.max())
                continue
            ready = ready or (np.concatenate(keys), np.concatenate(counts), np.concatenate(best))
            b, a, times, place = unplaned(batch.column("pairs")[i].as_py(), 4)
            rows = batch.column("rows")[i].values.to_numpy()
            at = np.searchsorted(ready[0], (b << 32) | a)
            n_best, count_sum = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
            np.add.at(n_best, place, times * ready[2][at])
            np.add.at(count_sum, place, times * ready[1][at])
            some = count_sum > 0
            rows_out.append(rows[some])
            best_out.append(n_best[some])
            sum_out.append(count_sum[some])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in (rows_out, best_out, sum_out)], names=["_row", "n_best", "count_sum"])


def align_tokenizers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizers: str = TOKENIZERS) -> DataFrame:
    """How the tokens of two vocabularies meet in each text, and in how many of its links the corpus agrees.

    A encodes a space and the text, B the text, to which it adds that space; no special tokens. Offsets where tokens of
    both end cut them into groups; the two tokens that end a group are linked.
    Returns one row per input row: ``id_col``, n_a, n_b, n_groups, n_links,
    n_best (links whose pair is the most frequent of its B id in the corpus,
    ties included), count_sum (over links, how often the pair is linked in the
    corpus), groups_sha256 (over ``a1,a2|b1;a3|b2``).

    A text that is null or empty, or that either vocabulary doesn't give back
    byte by byte, has no tokens: zeros and an empty groups_sha256. Rows that
    repeat an id or a text are texts of their own, each of which counts; a null
    id is passed through. Other columns are left out. An empty table gives no
    rows. ``tokenizers`` is a folder that Spark can read.
    """
    spark = docs.sparkSession
    files = [spark.read.format("binaryFile").load(f"{tokenizers}/{name}").first()["content"] for name in (BYTE_LEVEL, PIECES)]
    shared = spark.sparkContext.broadcast([bytes(f) for f in files])  # two vocabulary files, a few MB
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _encode(batches, shared.value)

    encoded = texts.mapInArrow(encode, f"_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_pairs long, pairs binary")
    base = stored(encoded.withColumn("_row", F.monotonically_increasing_id()), "alignment")
    pairs = base.where("pairs IS NOT NULL")
    parts = max(1, round((pairs.agg(F.sum("n_pairs")).first()[0] or 0) / (BUCKETS * PAIRS)))
    sums = pairs.select("pairs").mapInArrow(_count, "b int, a int, n long").groupBy("b", "a").agg(F.sum("n").alias("n"))
    # All pairs of one B id are no more than A has ids.
    by_side = sums.groupBy("b").agg(F.sort_array(F.collect_list(F.struct("a", "n"))).alias("x"))
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    counts = by_side.select(everywhere, F.pmod("b", F.lit(BUCKETS)).cast("int").alias("bucket"), F.lit(0).alias("kind"), "b", F.col("x.a").alias("a"), F.col("x.n").alias("n"))
    postings = pairs.select("_row", "pairs").mapInArrow(partial(_deal, parts=parts), "part int, bucket int, rows array<long>, pairs binary").withColumns({"kind": F.lit(1), "b": F.lit(0)})
    streams = counts.unionByName(postings, allowMissingColumns=True).repartition("part", "bucket").sortWithinPartitions("part", "bucket", "kind", "b")
    sums = streams.mapInArrow(_contribute, "_row long, n_best long, count_sum long").groupBy("_row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    sums = stored(sums, "contributions")
    out = base.select("_row", "_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(sums, "_row", "left")
    return out.select(F.col("_id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return align_tokenizers(read(spark, sf_dir, "documents"))
