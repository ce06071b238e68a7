"""Plain versions of the operators, for small tables held in memory."""

import hashlib
import re

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def repeated_bytes(rows, size=100):
    """rows: (doc_id, text); doc_id -> (n_bytes, n_removed, n_spans, kept_sha256)."""
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - size + 1):
            w = raw[i : i + size]
            if w in seen:
                gone[i : i + size] = b"\1" * size
            seen.add(w)
        n_spans = len(re.findall(rb"\x01+", bytes(gone)))
        out[doc] = (len(raw), sum(gone), n_spans, sha(bytes(b for b, g in zip(raw, gone) if not g)))
    return out


def repeated_words(rows, size=35):
    """doc_id -> (n_words, n_removed, kept_sha256)."""
    times: dict = {}
    words = {doc: WORD.findall((text or "").encode()) for doc, text in rows}
    for own in words.values():
        for i in range(len(own) - size + 1):
            times[tuple(own[i : i + size])] = times.get(tuple(own[i : i + size]), 0) + 1
    out = {}
    for doc, own in words.items():
        gone = [False] * len(own)
        for i in range(len(own) - size + 1):
            if times[tuple(own[i : i + size])] > 1:
                gone[i : i + size] = [True] * size
        out[doc] = (len(own), sum(gone), sha(b" ".join(w for w, g in zip(own, gone) if not g)))
    return out


def near_classes(rows, similar=0.8, size=5):
    """doc_id -> least doc_id of its class."""
    sets = {}
    for doc, text in rows:
        w = WORD.findall((text or "").encode())
        sets[doc] = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(d for d in sets if sets[d])
    holders: dict = {}
    for d in ids:
        for s in sets[d]:
            holders.setdefault(s, []).append(d)
    for d in ids:
        for e in {x for s in sets[d] for x in holders[s] if x < d}:
            both = len(sets[d] & sets[e])
            if both / (len(sets[d]) + len(sets[e]) - both) >= similar:
                a, b = sorted((find(d), find(e)))
                root[b] = a
    return {d: find(d) for d in sets}
