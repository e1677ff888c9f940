"""Plain restatements of what the operators return, for small tables; and the tests' session."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict


def crc_held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def bench_words(text: str | None) -> list[str]:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def contamination(docs: list[tuple], items: list[tuple]) -> dict:
    out = {}
    for doc, (w, hit, found) in benchmark_hits(docs, items).items():
        out[doc] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def benchmark_hits(docs: list[tuple], items: list[tuple]) -> dict:
    """Of each document its words, the places of those that lie in a window, and the items found."""
    windows: dict[tuple, set] = defaultdict(set)
    for item, text in items:
        w = bench_words(text)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(str(item))
    sizes = {len(w) for w in windows}
    out = {}
    for doc, text in docs:
        w = bench_words(text)
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                own = windows.get(tuple(w[k : k + n]))
                if own:
                    found |= own
                    hit.update(range(k, k + n))
        out[doc] = (w, hit, found)
    return out


def url_verdict(url: str | None, rules) -> tuple:
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits, key=lambda r: len(r[0]), default=(None, "allow"))
    return host, path, rule, verdict


def space_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def repeats(docs: list[tuple], width: int = 50) -> dict:
    first: dict[tuple, int] = {}
    words = {d: space_words(t) for d, t in docs}
    for d in sorted(words):
        for k in range(len(words[d]) - width + 1):
            first.setdefault(tuple(words[d][k : k + width]), d)
    out = {}
    for d, w in words.items():
        gone = set()
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < d:
                gone.update(range(k, k + width))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def shingles(text: str | None) -> frozenset:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = space_words(low)
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def components(nodes, links) -> dict:
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def near_duplicates(docs: list[tuple], percent: int = 85) -> dict:
    sets = {d: shingles(t) for d, t in docs}
    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    shared: dict[tuple, int] = defaultdict(int)
    for own in holders.values():
        for i, a in enumerate(own):
            for b in own[:i]:
                shared[a, b] += 1
    links = [(a, b) for (a, b), n in shared.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]
    comp = components(sets, links)
    return {d: (len(s), comp[d], comp[d] == d) for d, s in sets.items()}


def repeated_tail(doc_id, text: str | None) -> list[str]:
    w, h = space_words(text), zlib.crc32(str(doc_id).encode())
    if h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def periodic_runs(w: list, least: int = 12) -> list[tuple]:
    """(start, length, period) by comparing the words at every distance."""
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, 2 * q) and not any(w[i : i + length - p] == w[i + p : i + length] for p in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out)


def collapsed(w: list[str], runs: list[tuple]) -> str:
    gone = {k for start, length, period in runs for k in range(start + period, start + length)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def letter_words(docs: list[tuple]) -> dict:
    """Counts of the letter runs of the documents after the deletions that query 12 makes."""
    out: dict[str, int] = defaultdict(int)
    for doc, text in docs:
        for x in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            x = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)
            h = zlib.crc32(f"{doc}:{x}".encode())
            if doc is not None and h % 199 == 0:
                x = x[: h % len(x)] + x[h % len(x) + 1 :]
            out[x] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def spelling(words: dict, ratio: int = 5) -> dict:
    """word: (form, root, n, n_near, form_n), with near words sought among those that share a word less one letter."""
    holders = defaultdict(set)
    for w in words:
        for k in range(len(w)):
            holders["less", w[:k] + w[k + 1 :]].add(w)
            holders["gap", k, w[:k], w[k + 1 :]].add(w)
    near = defaultdict(set)
    for key, own in holders.items():
        if key[0] == "gap":
            for w in own:
                near[w] |= own - {w}
        elif key[1] in words:
            for w in own:
                near[w].add(key[1])
                near[key[1]].add(w)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words.get(form[w]))
    return out


def top_k(vectors: list[tuple], asked, k: int = 5, scale: int = 256) -> list[tuple]:
    """(query_id, rank, vec_id, score) of vectors (id, components)."""
    import math

    ok = [(i, v, [math.floor(float(c) * scale) for c in x]) for i, (v, x) in enumerate(vectors) if x is not None and all(c is not None and math.isfinite(c) for c in x)]
    out = []
    for i, v, x in ok:
        if v is not None and asked(v):
            others = [(-sum(a * b for a, b in zip(x, y, strict=True)), u is None, u or 0) for j, u, y in ok if j != i and len(x) == len(y)]
            out += [(v, r + 1, None if none else u, -s) for r, (s, none, u) in enumerate(sorted(others)[:k])]
    return out
