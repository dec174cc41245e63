"""The operators' results in plain Python, for tables that fit in memory."""

import hashlib
import html
import re
import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def base_spans(text):
    text = text or ""
    assign = r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found = [(m.start(), 0, m.end(), "assign") for m in re.finditer(assign, text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return [(kind, start, end) for start, _, end, kind in sorted(found)]


def secret_digests(docs):
    rows = []
    for doc_id, text in docs:
        spans = base_spans(text)
        count = [sum(s[0] == kind for s in spans) for kind in ("assign", "access", "hex")]
        rows.append((doc_id, *count, sha(",".join(f"{k}:{a}:{b}" for k, a, b in spans))))
    return rows


def token_files(docs, tokenizer):
    rows, start = [], 0
    for doc_id, text in sorted(docs):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        rows.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return rows


def coded(docs, tokenizer):
    rows = []
    for doc_id, text in docs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        rows.append((doc_id, len(ids), sha(" ".join(map(str, ids))), sha(decoded)))
    return rows


def shingle_set(text, n=5):
    words = WORD.findall((text or "").translate(A_TO_Z))
    if len(words) < n:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def linked(docs):
    sets = {doc_id: shingle_set(text) for doc_id, text in docs}
    holders = defaultdict(list)
    for doc_id, tokens in sets.items():
        for token in tokens:
            holders[token].append(doc_id)
    parent = {doc_id: doc_id for doc_id in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in {pair for ids in holders.values() for pair in combinations(sorted(ids), 2)}:
        shared = len(sets[a] & sets[b])
        if 100 * shared >= 75 * (len(sets[a]) + len(sets[b]) - shared):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return [(doc_id, len(tokens), root(doc_id)) for doc_id, tokens in sets.items()]


def without_repeats(docs):
    first, rows = {}, []
    for doc_id, text in sorted(docs):
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for i in range(len(words) - 12):
            if first.setdefault(tuple(words[i : i + 13]), doc_id) < doc_id:
                gone[i : i + 13] = [True] * 13
        rows.append((doc_id, len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g)))
    return rows


def edits(docs):
    ordered, rows = sorted(((i, t or "") for i, t in docs), reverse=True), []
    for k, (doc_id, text) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][1]
        half = len(text) // 2
        rows.append((doc_id, len(text), sha(text[: len(text) - half] + following[:half])))
    return rows


def article(page):
    inside = re.search(r"<article>(.*?)(</article>|<footer|$)", page, re.S)
    return " ".join(html.unescape(re.sub("<[^>]*>", " ", inside[1])).split()) if inside else ""


# 11: ranked lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def search(docs, items, k=20):
    """(item_id, rank, doc_id, score) by scoring every document for every item."""
    import math
    from collections import Counter

    listed = [(i, TERM.findall((t or "").translate(A_TO_Z))) for i, t in docs]
    listed = [(i, t) for i, t in listed if t]
    big_n, big_l = len(listed), sum(len(t) for _, t in listed)
    df = Counter()
    counted = []
    for i, t in listed:
        c = Counter(t)
        counted.append((i, len(t), c))
        df.update(c.keys())
    out = []
    for item, text in items:
        asked = TERM.findall((text or "").translate(A_TO_Z))
        scored = []
        for row, (i, n, c) in enumerate(counted):
            m = 75 + (25 * n * big_n) // big_l
            s = 0
            for term in asked:
                tf = c.get(term, 0)
                if tf:
                    w = math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[term] + 1)))
                    s += w * ((10**9 * tf) // (1000 * tf + 12 * m))
            if s > 0:
                scored.append((-s, i if i is not None else float("inf"), row, i, s))
        scored.sort()
        out += [(item, rank, i, s) for rank, (_, _, _, i, s) in enumerate(scored[:k], start=1)]
    return out


# 12: SimHash


def simhash(text):
    import xxhash

    w = WORD.findall((text or "").translate(A_TO_Z))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum((h >> b) & 1 for h in hashes) > len(hashes))


def simhash_components(docs):
    """(doc_id, fingerprint hex, component_id) by comparing all pairs of rows."""
    prints = [simhash(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in combinations(range(len(docs)), 2):
        if bin(prints[a] ^ prints[b]).count("1") <= 2:
            parent[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            r = find(i)
            least[r] = min(least.get(r, d), d)
    return [(d, format(p, "016x"), least.get(find(i))) for i, ((d, _), p) in enumerate(zip(docs, prints))]


# 13: filter audit


def audit(docs, labels):
    """Rows of the audit by applying the filters in every order, document by document."""
    from itertools import permutations

    marks = {}
    for d, q, t in labels:
        if d is not None:
            g, x = marks.get(d, (0, 0))
            marks[d] = (max(g, q or 0), max(x, t or 0))
    texts = [(d, t or "") for d, t, _ in docs]

    def fails(i):
        d, t = texts[i]
        w = WORD.findall(t)
        return {
            "A": len(w) < 100,
            "B": 100 * len(set(w)) < 80 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": re.search(r"[#$%&*|]", t) is not None,
            "E": d is not None and any(e is not None and e < d and u == t for e, u in texts),
        }

    failing = [fails(i) for i in range(len(docs))]
    parts = defaultdict(list)
    for i, (_, _, lang) in enumerate(docs):
        parts[lang or ""].append(i)
    out = []
    for part, members in parts.items():
        rows, shapley = [], defaultdict(int)
        for order in permutations("ABCDE"):
            left = set(members)
            for step, letter in enumerate(order, start=1):
                gone = {i for i in left if failing[i][letter]}
                left -= gone
                earlier = set(order[: step - 1])
                rows.append(
                    [
                        part,
                        "".join(order),
                        step,
                        letter,
                        len(left),
                        len(gone),
                        sum(1 for i in members if failing[i][letter] and any(failing[i][e] for e in earlier)),
                        sum(1 for i in members if [k for k, v in failing[i].items() if v] == [letter]),
                        sum(1 for i in gone if marks.get(docs[i][0], (0, 0))[0] == 1),
                        sum(1 for i in gone if marks.get(docs[i][0], (0, 0))[1] == 1),
                    ]
                )
                shapley[letter] += len(gone)
        out += [tuple(r + [shapley[r[3]]]) for r in rows]
    return out
