"""Plain versions of the operators' contracts."""

import hashlib
import re

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DUP_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def contamination(docs, items, window=10):
    wins = {}
    for item, text in items:
        w = BENCH_WORD.findall((text or "").translate(LOW))
        for s in range(max(1, len(w) - window + 1)) if w else ():
            wins.setdefault(tuple(w[s : s + window]), set()).add(str(item) if item is not None else "")
    out = {}
    for doc, text in docs:
        w = BENCH_WORD.findall((text or "").translate(LOW))
        hit, found = set(), set()
        for n in {len(k) for k in wins}:
            for s in range(len(w) - n + 1):
                own = wins.get(tuple(w[s : s + n]))
                if own:
                    hit.update(range(s, s + n))
                    found |= own
        out[doc] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def shingles(text):
    w = DUP_WORD.findall((text or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near(docs):
    """doc_id -> (set size, least id reached), by comparing all pairs that share a shingle."""
    sets = {d: shingles(t) for d, t in docs}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = {}
    for d, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(d)
    done = set()
    for own in holders.values():
        for i, a in enumerate(own):
            for b in own[:i]:
                if (a, b) not in done:
                    done.add((a, b))
                    inter = len(sets[a] & sets[b])
                    if 100 * inter >= 75 * (len(sets[a]) + len(sets[b]) - inter):
                        x, y = root(a), root(b)
                        parent[max(x, y)] = min(x, y)
    return {d: (len(s), root(d)) for d, s in sets.items()}
