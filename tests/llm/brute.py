"""Plain Python versions that the operators are held against."""

import hashlib
import re


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def near_components(rows, size, percent=80):
    """``(doc_id, n_shingles, component_id, kept)`` of each row with an id; rows of one id with words hang together."""
    nodes = []
    for doc, text in rows:
        words = re.findall("[^\x20\x09-\x0d]+", low(text))
        grams = {tuple(words[k : k + size]) for k in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} if words else set()
        if doc is not None:
            nodes.append((doc, grams))
    parent = {d: d for d, _ in nodes}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for n, (a, x) in enumerate(nodes):
        for b, y in nodes[n + 1 :]:
            both = len(x & y)
            if both and 100 * both >= percent * len(x | y):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    told = [(d, len(grams), root(d) if grams else d) for d, grams in nodes]
    return [(d, n, c, d == c) for d, n, c in told]


def removed_bytes(rows, length):
    """By ``doc_id``: bytes, removed, spans, hash of the rest."""
    seen, out = set(), {}
    for doc, text in rows:
        data = (text or "").encode()
        gone = [False] * len(data)
        upto = 0
        for k in range(len(data) - length + 1):
            window = data[k : k + length]
            if window in seen:
                for j in range(max(k, upto), k + length):
                    gone[j] = True
                upto = k + length
            seen.add(window)
        rest = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[doc] = (len(data), sum(gone), spans, hashlib.sha256(rest).hexdigest())
    return out
