"""Plain single-process versions of the operators' contracts, for comparison."""

import hashlib
import re
import zlib

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def closure(nodes, links):
    """Smallest node reachable from each."""
    label = {n: n for n in nodes}

    def root(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def simhash(docs, n=3, bits=3):
    """docs: list of (doc_id, text) -> {doc_id: (hex, component)}; ids whole and unique."""
    import xxhash

    fps = {}
    for key, text in docs:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = words(text)
        if not w:
            fps[key] = 0
            continue
        grams = [" ".join(w[i:i + n]) for i in range(max(1, len(w) - n + 1))]
        count = [0] * 64
        for g in grams:
            h = xxhash.xxh64_intdigest(g.encode(), seed=42)
            for i in range(64):
                count[i] += h >> i & 1
        fps[key] = sum(1 << i for i in range(64) if 2 * count[i] > len(grams))
    keys = sorted(fps)
    values = np.array([fps[k] for k in keys], "u8")
    links = []
    for i, k in enumerate(keys):
        near = np.flatnonzero(np.bitwise_count(values[i + 1:] ^ values[i]) <= bits) + i + 1
        links += [(k, keys[j]) for j in near.tolist()]
    classes = closure(keys, links)
    return {k: (f"{fps[k]:016x}", classes[k]) for k in keys}


def token_ids(texts, tokenizer, end=1):
    return [[*e.ids, end] for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def suffix_dedup(docs, w=100):
    """docs in id order -> {doc_id: (n_bytes, n_removed, n_spans, sha)}."""
    seen, out = set(), {}
    for key, text in sorted(docs):
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - w + 1):
            x = raw[i:i + w]
            if x in seen:
                gone[i:i + w] = True
            seen.add(x)
        edge = np.diff(np.concatenate(([0], gone.astype(int))))
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out[key] = (len(raw), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def substring_dedup(docs, n=13):
    seen, out = set(), {}
    for key, text in sorted(docs):
        w = words(text)
        grams = [tuple(w[i:i + n]) for i in range(len(w) - n + 1)]
        gone = set()
        for i, g in enumerate(grams):
            if g in seen:
                gone.update(range(i, i + n))
        seen.update(grams)
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[key] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def embeddings(rows, threshold=0.9):
    """rows: (vec_id, vector or None), ids unique -> {vec_id: (n_links, component)}."""
    good = [(k, np.array(v, "f8")) for k, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, count = [], {k: 0 for k, _ in rows}
    if good:
        x = np.array([v / np.linalg.norm(v) for _, v in good])
        for i in range(len(good)):
            for j in np.flatnonzero(x[i + 1:] @ x[i] >= threshold) + i + 1:
                links.append((good[i][0], good[j][0]))
                count[good[i][0]] += 1
                count[good[j][0]] += 1
    classes = closure([k for k, _ in rows], links)
    return {k: (count[k], classes[k]) for k, _ in rows}


def targets(sizes, weights=(1, 2, 3), cap=3):
    """sizes: {source: words} -> {source: target}."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        open_ = [s for s in order if s not in capped]
        rest, share = total - sum(cap * sizes[s] for s in capped), sum(weight[s] for s in open_)
        out = {s: cap * sizes[s] if s in capped else rest * weight[s] / share for s in order}
        over = {s for s in open_ if out[s] > cap * sizes[s]}
        if not over:
            return out
        capped |= over
