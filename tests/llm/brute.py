"""Plain versions of the numbered operators, in Python, for small inputs."""

import hashlib
import re


def suffix_dedup(docs, window=50):
    """docs: (doc_id, text). Rows as op1 returns them."""
    least = {}
    for doc, text in docs:
        b = (text or "").encode()
        for p in range(len(b) - window + 1 if doc is not None else 0):
            w = b[p : p + window]
            least[w] = min(doc, least.get(w, doc))
    out = []
    for doc, text in docs:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - window + 1 if doc is not None else 0):
            if least[b[p : p + window]] < doc:
                gone[p : p + window] = b"\x01" * window
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((doc, len(b), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def substring_dedup(docs, window=20):
    """docs: (doc_id, text). Rows as op2 returns them."""
    words = [(doc, re.findall(r"[^\x20\x09-\x0D]+", text or "")) for doc, text in docs]
    least = {}
    for doc, w in words:
        for p in range(len(w) - window + 1 if doc is not None else 0):
            k = tuple(w[p : p + window])
            least[k] = min((doc, p), least.get(k, (doc, p)))
    out = []
    for doc, w in words:
        gone = [False] * len(w)
        for p in range(len(w) - window + 1 if doc is not None else 0):
            if least[tuple(w[p : p + window])] < (doc, p):
                gone[p : p + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((doc, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def ppm(training, text, order=3):
    """Code length of a text's bytes in each language by PPM, method C, with plain dicts. training: language to texts."""
    from math import log2

    pad = b"\n" * order
    out = {}
    data = pad + (text or "").encode()
    for lang, texts in training.items():
        seen = [{} for _ in range(order + 1)]
        for t in texts:
            b = pad + t.encode()
            for i in range(order, len(b)):
                for k in range(order + 1):
                    successors = seen[k].setdefault(b[i - k : i], {})
                    successors[b[i]] = successors.get(b[i], 0) + 1
        bits = 0.0
        cost = {}
        for i in range(order, len(data)):
            key = data[i - order : i + 1]
            if key not in cost:
                p = 1 / 256
                for k in range(order + 1):
                    successors = seen[k].get(data[i - k : i])
                    if successors:
                        n, d = sum(successors.values()), len(successors)
                        c = successors.get(data[i], 0)
                        p = (c if c else d * p) / (n + d)
                cost[key] = -log2(p)
            bits += cost[key]
        out[lang] = bits
    return out


MASK64 = (1 << 64) - 1


def mix64(x):
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = ((x ^ (x >> shift)) * factor) & MASK64
    return x ^ (x >> 31)


#: The hash of a byte, of a word and of a run of words, one number at a time.
BYTES64 = [mix64((k * 0x9E3779B97F4A7C15) & MASK64) for k in range(1, 257)]


def word_hash(word):
    return mix64(sum(BYTES64[b] * pow(0x2545F4914F6CDD1D, i, 1 << 64) for i, b in enumerate(word)) & MASK64)


def run_hash(values):
    h = 0
    for v in values:
        h = (h * 0x9FB21C651E98DF25 + v) & MASK64
    return mix64(h)


def quality_bins(text, bins):
    """The bins of a text's n-grams in all five views."""
    words = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    hashes, shapes = [word_hash(w) for w in words], []
    for i, w in enumerate(words):
        upper, digit = sum(65 <= b <= 90 for b in w), sum(48 <= b <= 57 for b in w)
        lower = sum(97 <= b <= 122 or b >= 128 for b in w)
        code = min(upper, 2) * 3 + min(lower, 2)
        code = (code * 2 + (digit > 0)) * 4 + min(len(w) - upper - lower - digit, 3)
        code = code * 5 + sum(len(w) >= n for n in (3, 6, 10, 16))
        again = (i > 0 and words[i - 1] == w) | (any(i >= k and words[i - k] == w for k in (2, 3, 4)) << 1)
        shapes.append(mix64(code * 4 + again + 1))
    out = []
    for view, (x, k) in enumerate(((hashes, 1), (hashes, 2), (shapes, 1), (shapes, 2), (shapes, 3))):
        out += [view * bins + run_hash(x[i : i + k]) % bins for i in range(len(x) - k + 1)]
    return out


def quality_weights(docs, good, bins, views=5):
    """docs: (doc_id, text); good: ids. Log importance weight of each document by plain counting."""
    from collections import Counter
    from math import log

    each = [(d, quality_bins(t, bins)) for d, t in docs]
    raw, target = Counter(), Counter()
    for d, b in each:
        raw.update(b)
        if d in good:
            target.update(b)
    size = lambda c: [sum(n + 1 for k, n in c.items() if k // bins == v) + bins - sum(k // bins == v for k in c) for v in range(views)]
    all_raw, all_target = size(raw), size(target)
    return {d: sum(log((target[k] + 1) / all_target[k // bins]) - log((raw[k] + 1) / all_raw[k // bins]) for k in b) for d, b in each}


def ring_shards(places, points, shards):
    """The shard of each key, walking clockwise one key at a time from its own place to the first shard with room. places: id to place."""
    waiting = {k: [] for k in range(len(points))}
    for d, p in sorted(places.items(), key=lambda x: (x[1], x[0])):
        waiting[next((k for k, (q, _) in enumerate(points) if q >= p), 0)].append(d)
    room = [len(places) // shards + (s < len(places) % shards) for s in range(shards)]
    out = {}
    while any(waiting.values()):
        moved = {k: [] for k in waiting}
        for k, (_, s) in enumerate(points):
            for d in waiting[k]:
                if room[s]:
                    room[s] -= 1
                    out[d] = s
                else:
                    moved[(k + 1) % len(points)].append(d)
        waiting = moved
    return out
