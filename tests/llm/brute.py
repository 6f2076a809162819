"""Plain versions of the operators for comparison."""

import hashlib
import re

import numpy as np
import xxhash

SPACE = re.compile(rb"[\x20\x09-\x0D]+")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def fingerprint(text):
    lowered = (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))
    words = [w for w in SPACE.split(lowered) if w]
    if not words:
        return 0
    spans = [words[i : i + 3] for i in range(len(words) - 2)] or [words]
    hashes = [xxhash.xxh64_intdigest(b" ".join(s), seed=42) for s in spans]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, ids, radius=2):
    """The smallest id reachable over links of at most `radius` differing bits, per row."""
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    least = {}
    for i, own in enumerate(ids):
        if own is not None:
            least[find(i)] = min(own, least.get(find(i), own))
    return [least.get(find(i)) for i in range(len(prints))]


def top_k(rows, k=10):
    """(query_id, rank, vec_id, score) for (vec_id, vector) rows."""
    ok = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, a in ok:
        if q % 100 == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q and len(a) == len(b))
            out |= {(q, r, i, -s) for r, (s, i) in enumerate(found[:k], 1)}
    return out


def cut_lines(rows, least_chars=20, least_docs=3):
    """{doc_id: (n_lines, n_dropped, kept)} for (doc_id, text) rows with distinct ids."""

    def key(line):
        out = line.strip(" \t\n\x0b\x0c\r")
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in out)

    holders = {}
    for i, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= least_chars:
                holders.setdefault(k, set()).add(i)
    out = {}
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < least_docs or i == max(holders[key(x)])]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def contained(docs, items, containment=0.8, size=5):
    """{(doc_id, item_id, n_shared, n_shingles)} for distinct ids."""

    def shingles(text):
        words = re.findall(r"[^\W_]+", (text or "").lower())
        return {" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()

    out = set()
    for i, text in docs:
        held = shingles(text)
        for j, item in items:
            wanted = shingles(item)
            if i is not None and wanted and len(held & wanted) >= containment * len(wanted) - 1e-9:
                out.add((i, j, len(held & wanted), len(wanted)))
    return out
