"""Plain-Python versions of the contracts, for small inputs."""

import hashlib
import re
import zlib

import numpy as np
import xxhash

SF = "/root/testdata/sf0.001"


def lower(b: bytes) -> bytes:
    return bytes(x + 32 if 65 <= x <= 90 else x for x in b)


def words1(text):
    low = lower((text or "").encode()).decode()
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def contaminated(documents, items, width=10):
    windows = {}
    for item_id, text in items:
        w = words1(text)
        for i in range(max(len(w) - width + 1, min(len(w), 1))):
            windows.setdefault(tuple(w[i : i + width]), set()).add(str(item_id))
    sizes = {len(w) for w in windows}
    out = []
    for doc_id, text in documents:
        w, hit, found = words1(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (who := windows.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= who
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", lower((text or "").encode()))
    s = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near(documents, bits=4):
    ids = [d for d, _ in documents]
    fp = np.array([fingerprint(t) for _, t in documents], np.uint64)
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(fp[i] ^ fp[i + 1 :]) <= bits) + i + 1:
            parent[find(int(j))] = find(i)
    least = {}
    for k, d in enumerate(ids):
        if d is not None:
            r = find(k)
            least[r] = min(d, least.get(r, d))
    return [(d, f"{int(f):016x}", least.get(find(k))) for k, (d, f) in enumerate(zip(ids, fp, strict=True))]


def substrings(documents, length):
    raw = [(t or "").encode() for _, t in documents]
    count = {}
    for b in raw:
        for i in range(len(b) - length + 1):
            count[b[i : i + length]] = count.get(b[i : i + length], 0) + 1
    out = []
    for (doc_id, _), b in zip(documents, raw, strict=True):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((doc_id, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def crc_fold(doc_id, folds):
    return zlib.crc32(str(doc_id).encode()) % folds
