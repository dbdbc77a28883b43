"""Plain versions of the operators' contracts, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lines(docs):
    key = lambda x: lower(x.strip(" \t\n\r\x0b\x0c"))
    own = defaultdict(set)
    for i, t in docs:
        for x in (t or "").split("\n"):
            own[key(x)].add(i)
    out = {}
    for i, t in docs:
        every = (t or "").split("\n")
        kept = [x for x in every if len(key(x)) < 10 or min(own[key(x)]) == i]
        out[i] = ("\n".join(kept), len(every), len(every) - len(kept))
    return out


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def classes(docs, k=4, percent=85):
    sets = {i: shingles(t, k) for i, t in docs}
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in sets}


def passages(docs, span=35):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in docs}
    seen = Counter(tuple(w[i : i + span]) for w in words.values() for i in range(len(w) - span + 1))
    out = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - span + 1):
            if seen[tuple(w[i : i + span])] > 1:
                gone.update(range(i, i + span))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), sha(kept))
    return out


def tokens(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))


def contamination(docs, items, span=13):
    wanted = defaultdict(set)
    for i, t in items:
        w = tokens(t)
        k = min(span, len(w))
        for j in range(len(w) - k + 1 if k else 0):
            wanted[tuple(w[j : j + k])].add(str(i))
    lengths = {len(x) for x in wanted}
    out = {}
    for d, t in docs:
        w = tokens(t)
        hit, names = set(), set()
        for k in lengths:
            for j in range(len(w) - k + 1):
                found = wanted.get(tuple(w[j : j + k]))
                if found:
                    hit.update(range(j, j + k))
                    names |= found
        out[d] = (len(w), len(hit), len(names), sha(",".join(sorted(names))), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out
