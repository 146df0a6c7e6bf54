"""Plain definitions that the operators are compared with on small tables."""

import hashlib
import math
import random
import re
from collections import Counter

import xxhash

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return SPACE.findall(text or "")


def corpus(seed=5, n=90):
    """Documents with copies, near copies, shared passages, repeated lines, odd white space, and empty and null texts."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéßñ") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts = []
    for i in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 5, 12, 13, 14, 40, 120]))]
        if i % 5 == 0:
            w[len(w) // 2 : len(w) // 2] = passage[rng.randint(0, 20) : rng.randint(40, 60)]
        if i % 7 == 1 and texts:
            w = words(rng.choice(texts)) or w
            if i % 2:
                w = [x if rng.random() > 0.01 else "new" for x in w]
        texts.append(rng.choice([" ", "\n", "\t ", "\x0b"]).join(w))
    texts += [None, "", "   \n", "one", "One", texts[3], "a b c \x1c d", " ".join(["same"] * 40), "\n".join(["A line with Words."] * 6), "word " * 3000]
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


def contamination(docs, items, width=13):
    windows = {}
    for item, text in items:
        w = PLAIN.findall(lowered(text))
        n = min(len(w), width)
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    lengths = {len(k) for k in windows}
    out = set()
    for doc, text in docs:
        w, hit, found = PLAIN.findall(lowered(text)), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (s := windows.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    found |= s
        out.add((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def removals(docs, width=13):
    first = {}
    for doc, text in docs:
        w = words(text)
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            first[k] = min(first.get(k, doc), doc)
    out = set()
    for doc, text in docs:
        w = words(text)
        gone = {j for i in range(len(w) - width + 1) if first[tuple(w[i : i + width])] < doc for j in range(i, i + width)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.add((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def near(docs, percent=85):
    sets = {}
    for doc, text in docs:
        w = words(lowered(text))
        sets[doc] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    label = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                inter = len(sets[a] & sets[b])
                if inter and 100 * inter >= percent * (len(sets[a]) + len(sets[b]) - inter) and label[b] > label[a]:
                    label[b], changed = label[a], True
    return {(d, len(sets[d]), label[d], label[d] == d) for d in sets}


def repetition(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    w = words(text)
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            again += line in seen
            seen.add(line)
    places = {}
    for i in range(len(w) - 7):
        places.setdefault(tuple(w[i : i + 8]), []).append(i)
    repeat = {j for p in places.values() if len(p) > 1 for i in p for j in range(i, i + 8)}
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), again, len(repeat), n < 20 or 100 * len(repeat) > 30 * n


def duplicated_share(text, n):
    """The share of word characters in n-grams that occurred before."""
    w = words(text)
    seen, inside = set(), set()
    for i in range(len(w) - n + 1):
        g = tuple(w[i : i + n])
        if g in seen:
            inside |= set(range(i, i + n))
        seen.add(g)
    return sum(len(w[i]) for i in inside) / max(1, sum(map(len, w)))


def top_share(text, n, least=3):
    w = words(text)
    places = {}
    for i in range(len(w) - n + 1):
        places.setdefault(tuple(w[i : i + n]), []).append(i)
    best = max(places.values(), key=len, default=[])  # the first of equals
    inside = {j for i in best for j in range(i, i + n)} if len(best) >= least else set()
    return sum(len(w[i]) for i in inside) / max(1, sum(map(len, w)))


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def search(docs, items, top=50):
    """(item, rank, doc, score); ids may be null or repeated."""
    counts = [(d, Counter(TERM.findall(lowered(t)))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        terms = set(TERM.findall(lowered(text)))
        scores = []
        for d, c in counts:
            m = 100 - 50 + 50 * sum(c.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if score > 0:
                scores.append((-score, d is None, d))
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:top])]
    return sorted(out, key=str)


def fingerprint(text):
    w = words(lowered(text))
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def within(fingerprints, distance=4):
    """The smallest id that each (id, fingerprint) reaches."""
    up = {f: f for _, f in fingerprints}

    def root(f):
        while up[f] != f:
            f = up[f]
        return f

    every = sorted(up)
    for i, x in enumerate(every):
        for y in every[:i]:
            if (x ^ y).bit_count() <= distance:
                up[root(x)] = root(y)
    least = {}
    for d, f in fingerprints:
        if d is not None:
            least[root(f)] = min(least.get(root(f), d), d)
    return [(d, f, None if d is None else least[root(f)]) for d, f in fingerprints]


def alignment(docs, encode_a, encode_b):
    """Per row: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256. Encoders give (id, bytes) for each token."""
    rows, count = [], Counter()
    for d, text in docs:
        whole = (" " + (text or "")).encode()
        a, b = (encode_a(" " + text), encode_b(text)) if text else ([], [])
        if not text or b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            a, b = [], []
        ends = []
        for side in (a, b):
            at, out = 0, []
            for _, x in side:
                at += len(x)
                out.append(at)
            ends.append(out)
        links = [(a[i][0], b[j][0]) for i, e in enumerate(ends[0]) for j in ([ends[1].index(e)] if e in ends[1] else [])]
        groups, i, j = [], 0, 0
        for e in sorted({*ends[0]} & {*ends[1]}):
            p, q = ends[0].index(e) + 1, ends[1].index(e) + 1
            groups.append(",".join(str(x) for x, _ in a[i:p]) + "|" + ",".join(str(x) for x, _ in b[j:q]))
            i, j = p, q
        count.update(links)
        rows.append((d, len(a), len(b), groups, links))
    best = {}
    for (_, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    return [(d, n_a, n_b, len(g), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for d, n_a, n_b, g, links in rows]
