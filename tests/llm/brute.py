"""Plain versions of the operators' results, for small inputs."""
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq

SF = "/root/testdata/sf0.001"
SPACES = " \t\n\r\x0b\x0c"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def documents(sf=SF):
    t = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"])
    return list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist()))


def words(text):
    return (text or "").encode().lower().split()


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_dups(docs, width, percent=80):
    """{id: (set size, component)} by comparing all pairs."""
    sets = {}
    for i, text in docs:
        w = words(text)
        grams = frozenset(tuple(w[k:k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
        sets[i] = grams
    ids = sorted(sets)
    links = []
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                links.append((a, b))
    comp = roots(ids, links)
    return {i: (len(sets[i]), comp[i]) for i in ids}


def drop_lines(docs, min_chars=20, min_docs=3):
    key = lambda x: x.strip(SPACES).translate(LOWER)
    held, top = Counter(), {}
    for i, text in docs:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= min_chars:
                held[k] += 1
                top[k] = max(top.get(k, i), i)
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        stay = [x for x in lines if not (len(key(x)) >= min_chars and held[key(x)] >= min_docs and top[key(x)] != i)]
        out.append((i, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return out


def base_lm(docs):
    tokens = [(i, words(t) + [None]) for i, t in docs]
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in tokens]
    c = Counter(x for (_, w), h in zip(tokens, held) if not h for x in w)
    total, norm = sum(c.values()), sum(c.values()) + 0.5 * (len(c) + 1)
    return [(i, h, len(w), sum(c[x] > 0 for x in w), total, sum(math.log10((c[x] + 0.5) / norm) for x in w))
            for (i, w), h in zip(tokens, held)]


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def personal(text):
    out = []
    for n, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0
            if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False,
                    "card": 14 <= len(digits) <= 19 and luhn, "phone": 10 <= len(digits) <= 15}[kind]:
                out.append((m.start(), n, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def vector_links(rows, limit=0.98):
    """{id: (links, component)} of (id, vector, label) rows."""
    good = {}
    for i, v, label in rows:
        if v and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good[i] = (np.array(v, np.float64), label)
    links = defaultdict(int)
    pairs = []
    ids = sorted(good)
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            (u, p), (v, q) = good[a], good[b]
            if p == q and len(u) == len(v) and u @ v / math.sqrt(u @ u) / math.sqrt(v @ v) >= limit:
                pairs.append((a, b))
                links[a] += 1
                links[b] += 1
    comp = roots([i for i, _, _ in rows], pairs)
    return {i: (links[i], comp[i]) for i, _, _ in rows}


def vector_codes(rows, parts=16, entries=64, rounds=2):
    """{id: (code, error, label_error)} and the codebooks, of (id, vector, label) rows, in Python integers."""
    kept = sorted((i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v))
    width = len(kept[0][1]) // parts
    cut = [[v[p * width:(p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[cut[e][p] for e in range(min(entries, len(kept)))] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, y)), e) for e, y in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for x in cut:
                own[nearest(x[p], books[p])[1]].append(x[p])
            for e, xs in own.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs)]
    found = [[nearest(x[p], books[p]) for p in range(parts)] for x in cut]
    by_label = defaultdict(int)
    for (_, _, label), f in zip(kept, found):
        by_label[label] += sum(d for d, _ in f)
    return ({i: ("".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f), by_label[label]) for (i, _, label), f in zip(kept, found)},
            hashlib.sha256(",".join(str(c) for book in books for y in book for c in y).encode()).hexdigest())


def aligned(docs, a, b):
    """[(id, n_a, n_b, n_groups, n_links, n_best, count_sum, digest)] from whole texts, pair by pair; ``a`` encodes to (id, bytes) lists, so does ``b``."""
    out, count = [], Counter()
    for i, text in docs:
        whole = (" " + text).encode() if text else b""
        ta, tb = (a(text), b(text)) if text else ([], [])
        if b"".join(x for _, x in ta) != whole or b"".join(x for _, x in tb) != whole:
            ta, tb = [], []
        ends = []
        for tokens in (ta, tb):
            at, one = 0, {}
            for k, x in tokens:
                at += len(x)
                one[at] = k
            ends.append(one)
        both = sorted(set(ends[0]) & set(ends[1]))
        links = [(ends[0][e], ends[1][e]) for e in both]
        count.update(links)
        parts = [[[] for _ in both] for _ in ends]
        for side, one in zip(parts, ends):
            g = 0
            for at in sorted(one):
                side[g].append(str(one[at]))
                g += at == both[g]
        groups = [",".join(x) + "|" + ",".join(y) for x, y in zip(*parts)]
        out.append((i, len(ta), len(tb), len(both), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if ta else ""))
    top = Counter()
    for (_, y), n in count.items():
        top[y] = max(top[y], n)
    return [(i, na, nb, n, len(ls), sum(count[x] == top[x[1]] for x in ls), sum(count[x] for x in ls), d) for i, na, nb, n, ls, d in out]


def edit_distance(item, text):
    """Smallest word edit distance of ``item`` to any stretch of ``text``."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(text, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return min(row)
