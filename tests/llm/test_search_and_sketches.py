"""Lexical search, alignment of tokenizers and SimHash against their plain definitions."""

import importlib.util
import os
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from gaugeworks.llm import alignment, lexical_search, simhash

spec = importlib.util.spec_from_file_location("brute", Path(__file__).with_name("brute.py"))
brute = importlib.util.module_from_spec(spec)
sys.modules["brute"] = brute
spec.loader.exec_module(brute)

DOCS = "doc_id long, text string, fp string, n long, terms string, label int, pairs string, _row string, word string"
TOKENIZERS = "/opt/tokenizers"


def table(spark, rows, parts=3):
    """Documents with extra columns whose names clash with those that the operators use."""
    return spark.createDataFrame([(i, t, "x", 1, "y", 2, "z", "r", "w") for i, t in rows], DOCS).repartition(parts)


@pytest.fixture(scope="module")
def rows():
    odd = [(None, "the null id one two three"), (1, "the repeated id, with other words"), (2000, "A-Z, a z 9z ÄÖ äö x\\x1fy"), (2001, "Ä" * 3000), (2002, "a  b\\n\\n c \\r\\n d \\u00a0 e ")]
    return brute.corpus(n=60) + [(i, t.encode().decode("unicode_escape") if "\\x" in t or "\\u" in t or "\\n" in t else t) for i, t in odd]


# Lexical search


def items_of(rows):
    texts = [rows[0][1], rows[5][1], rows[8][1], "one", "ONE one 9z", "nowhere-at all", None, "", "...", rows[5][1]]
    return [*enumerate(texts), (3, "word same"), (None, "a b c d")]


@pytest.mark.parametrize(("block", "shard", "first"), [(200_000, 4_000_000, 256), (40, 50, 4)])
def test_lexical_search(spark, rows, monkeypatch, block, shard, first):
    monkeypatch.setattr(lexical_search, "BLOCK", block)
    monkeypatch.setattr(lexical_search, "SHARD", shard)
    monkeypatch.setattr(lexical_search, "FIRST_RANGE", first)
    items = items_of(rows)
    bench = spark.createDataFrame([(i, t, 7) for i, t in items], "item_id int, text string, rank int")
    for top in (50, 3):
        got = lexical_search.lexical_search(table(spark, rows), bench, top=top)
        assert sorted((tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()), key=str) == brute.search(rows, items, top)


def test_lexical_search_ties_go_to_the_smaller_id(spark):
    rows = [(i, "alpha beta") for i in range(200, 0, -1)] + [(500, "gamma"), (None, "alpha beta"), (7, "alpha beta")]
    items = [(1, "alpha")]
    got = lexical_search.lexical_search(table(spark, rows, 5), spark.createDataFrame(items, "item_id long, text string"))
    found = sorted((r["rank"], r["doc_id"]) for r in got.collect())
    assert [d for _, d in found] == sorted([*range(1, 50), 7])
    assert [r for r, _ in found] == list(range(1, 51))


def test_lexical_search_of_empty_tables(spark, rows):
    none, some = table(spark, []), table(spark, rows)
    items = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert lexical_search.lexical_search(none, items).count() == 0
    assert lexical_search.lexical_search(some, items.limit(0)).count() == 0
    assert lexical_search.lexical_search(table(spark, [(1, None), (2, "...")]), items).count() == 0


def test_wand_skips_documents_below_the_threshold():
    rng = np.random.default_rng(4)
    docs, terms = 4000, 12
    sizes = rng.integers(0, 6, docs)
    held = [np.sort(rng.choice(terms, s, replace=False, p=np.arange(terms, 0, -1) / 78)) for s in sizes]
    weights = np.array([50 * 2**i for i in range(terms)])  # rare terms weigh most
    norms, times = np.full(docs, 100), np.ones(int(sizes.sum()), np.int64)
    shard = lexical_search.Shard(np.arange(docs), np.zeros(docs, np.int64), norms, sizes, np.concatenate(held).astype(np.int64), times, weights)
    heaps = lexical_search.Heaps(1, 5)
    scored, skipped = shard.search([np.arange(terms)], heaps)
    exact = np.array([int((weights[h] * (10**9 // 3000)).sum()) for h in held])
    best = sorted(range(docs), key=lambda d: (-exact[d], d))[:5]
    assert heaps.best[0][1].tolist() == best and heaps.best[0][0].tolist() == exact[best].tolist()
    assert scored + skipped < (exact > 0).sum() and scored < docs / 4


def test_terms_are_confirmed_by_their_bytes():
    known = lexical_search.Terms(["abc", "é", "9"])
    chunk = next(lexical_search.T.chunks(pa.array(["abc é abd 9 99"])))
    word, number = known.find(chunk.data, lexical_search.T.words(chunk, lexical_search.IS_TERM))
    assert list(zip(word.tolist(), number.tolist(), strict=True)) == [(0, 0), (1, 1), (3, 2)]
    known.hashes = known.hashes.copy()
    known.data = np.frombuffer("xbcé9".encode(), np.uint8)
    assert known.find(chunk.data, lexical_search.T.words(chunk, lexical_search.IS_TERM))[0].tolist() == [1, 3]


# SimHash


def hexes(rows):
    return sorted(((d, f"{f:016x}", c) for d, f, c in rows), key=str)


def test_simhash(spark, rows):
    docs = rows + [(5000 + i, t + " tail") for i, (_, t) in enumerate(rows[:20]) if t] + [(6000, "a b c d e f"), (6001, "A b\tc d  e f")]
    got = simhash.simhash(table(spark, docs)).select("doc_id", "fingerprint", "component_id", "kept").collect()
    assert sorted((tuple(r)[:3] for r in got), key=str) == hexes(brute.within([(d, brute.fingerprint(t)) for d, t in docs]))
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in got)
    assert {r["fingerprint"] for r in got if r["doc_id"] in {d for d, t in docs if not brute.words(t)}} == {"0" * 16}


def test_simhash_of_an_empty_table_and_of_text_ids(spark):
    assert simhash.simhash(table(spark, [])).count() == 0
    named = spark.createDataFrame([("b", "x y z"), ("a", "X y z"), (None, None)], "doc_id string, text string")
    assert {(r["doc_id"], r["component_id"]) for r in simhash.simhash(named).collect()} == {("b", "a"), ("a", "a"), (None, None)}


def neighbours(seed, groups, size):
    """Fingerprints around some centres, in chains of differences of up to 5 bits."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(groups):
        x = int(rng.integers(1 << 63))
        for _ in range(size):
            out.append(x)
            for b in rng.choice(64, rng.integers(1, 6), replace=False):
                x ^= 1 << int(b)
    return np.unique(np.array(out, dtype=np.uint64))


@pytest.mark.parametrize(("most", "size"), [(1 << 15, 20), (3, 20), (8, 6)])
def test_links_of_keys_by_pairs_and_around_words(spark, monkeypatch, most, size):
    monkeypatch.setattr(simhash, "MOST", most)
    x = neighbours(9, 12, size)
    table_ = pa.table({"doc_id": pa.array(np.arange(len(x))), "text": pa.array([str(i) for i in range(len(x))])})
    fixed = dict(zip(table_["text"].to_pylist(), x.tolist(), strict=True))

    def given(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array([fixed[t] for t in batch.column(1).to_pylist()], np.uint64).view(np.int64))], names=["_id", "fp"])

    monkeypatch.setattr(simhash, "_fingerprint", given)
    got = simhash.simhash(spark.createDataFrame(table_.to_pandas()).repartition(4))
    assert sorted((tuple(r)[:3] for r in got.select("doc_id", "fingerprint", "component_id").collect()), key=str) == hexes(brute.within(list(enumerate(x.tolist()))))


@pytest.mark.parametrize("n", [1, 10**6, 10**9, 10**12])
def test_pigeonholes_share_a_key(n):
    rng = np.random.default_rng(2)
    masks = simhash.pigeonholes(n)
    assert len(masks) <= 500 and all(m.bit_count() > 8 for m in masks)
    for _ in range(300):
        flips = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(m & flips == 0 for m in masks)


def test_spanning_links_are_a_forest():
    x = neighbours(1, 3, 400)
    a, b = simhash.spanning_links(x)
    assert (np.bitwise_count(a ^ b) <= 4).all() and len(set(b.tolist())) == len(b)
    labels = brute.within(list(enumerate(x.tolist())))
    assert len(b) == len(x) - len({c for _, _, c in labels})


# Alignment


@pytest.fixture(scope="module")
def encoders():
    if not os.path.isdir(TOKENIZERS):
        pytest.skip("no vocabularies here")
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(f"{TOKENIZERS}/{alignment.BYTE_LEVEL}")
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=f"{TOKENIZERS}/{alignment.PIECES}")
    byte_of, pieces = alignment._byte_of(), alignment.piece_bytes(b)
    return (
        lambda text: [(i, bytes(byte_of[c] for c in a.id_to_token(i))) for i in a.encode(text, add_special_tokens=False).ids],
        lambda text: [(i, pieces[i]) for i in b.encode(text)],
    )


ODD = ["a", " a", "a ", "  a  b   c    ", "a\n\nb\n c \n", "\n", " ", "\t x\t\ty \r\n z", "a b  c  d  e", "▁a", "x ▁ y", "<0x41> <s>x</s> <|endoftext|> it's we'll IT'S", "ﬁ ｆｕｌｌ é é", "日本語 テキスト", "🙂🙂 x🙂", "a\x1cb \x1c c\x1f\x1f d", "1234 5678.90 $%^ &*()", "word" * 400, "　a　b", "x\x85y \x85 z", "a \n b\n  c", "tail\n"]


def test_alignment(spark, rows, encoders):
    docs = rows + [(7000 + i, t) for i, t in enumerate(ODD)]
    got = alignment.align_tokenizers(table(spark, docs))
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=str) == sorted(brute.alignment(docs, *encoders), key=str)


def test_alignment_in_many_slices_with_little_memory(spark, rows, encoders, monkeypatch):
    monkeypatch.setattr(alignment, "PAIRS", 20)
    monkeypatch.setattr(alignment, "CHARS", 500)
    monkeypatch.setattr(alignment, "MOST_SEGMENTS", 50)
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    got = alignment.align_tokenizers(table(spark, rows, 7))
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=str) == sorted(brute.alignment(rows, *encoders), key=str)


def test_alignment_of_an_empty_table(spark, encoders):
    assert alignment.align_tokenizers(table(spark, [])).count() == 0
    assert [tuple(r) for r in alignment.align_tokenizers(table(spark, [(1, None)])).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_segments_give_the_tokens_of_whole_texts(encoders):
    known = alignment.Aligner(*(Path(f"{TOKENIZERS}/{name}").read_bytes() for name in (alignment.BYTE_LEVEL, alignment.PIECES)))
    assert known.cuts
    for text in ODD:
        segments = known.segments(text)
        assert "".join(segments) == " " + text
        assert [i for s in segments for i in known.a.encode_ordinary(s)] == [i for i, _ in encoders[0](" " + text)]
        assert [i for s in segments for i in known.b.encode("a" + s)[len(known.lead) :]] == [i for i, _ in encoders[1](text)]


def test_planes_come_back():
    x, y = np.array([1, 2, 1 << 31]), np.array([0, 4, 1 << 20])
    assert [c.tolist() for c in alignment.unplaned(alignment.planes(x, y), 2)] == [x.tolist(), y.tolist()]


# Articles


def test_articles_stay_whole(spark):
    from gaugeworks.llm import html_extraction

    def page(i):
        words = lambda name, n: " ".join(f"{name}{i}x{j}" for j in range(n))
        parts = ["<h1>Title</h1>", "<p class='byline'>By Jane Smith</p>", f"<div class='lead'>{words('lead', 6)}</div>", f"<div class='body'>{words('body', 120)}</div>", f"<ul><li>{words('item', 3)}</li></ul>", f"<table><tr><td>{words('cell', 2)}</td></tr></table>"]
        parts += [f"<p class='{name}'>{words(name, 3)}</p>" for name in ("search", "rail", "overlay", "skip")] + [f"<div class='rail'>{words('side', 2)}</div>", f"<menu><li>{words('menu', 2)}</li></menu>"]
        extra = "<div class='ad'>Buy now</div><section class='comments'><p>First!</p></section><aside>More</aside><form><p>Sign up</p></form>"
        return f"<html><body class='search'><nav>Home</nav><div class='promo'>Sale</div><article>{''.join(parts)}{extra}</article><footer>Foot</footer></body></html>", parts

    pages = {i: page(i) for i in range(10)}
    plain = lambda parts: " ".join(__import__("re").sub("<[^>]*>", " ", "".join(parts)).split())
    df = spark.createDataFrame([(i, f"https://one.example/{i}", html, "x", 1) for i, (html, _) in pages.items()], "page_id long, url string, html string, text string, _low int")
    got = {r["page_id"]: r["text"] for r in html_extraction.extract_text(df).collect()}
    assert got == {i: plain(parts) for i, (_, parts) in pages.items()}
