"""Plain single-machine versions of the operators' contracts, for small inputs."""

import hashlib
import math
import re
import struct
from fractions import Fraction
from itertools import combinations

import numpy as np
import xxhash

from docloom.llm import mixing, pii

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def simhash(rows):
    """doc_id -> (fingerprint hex, component id) by comparing all pairs."""
    fps = []
    for doc_id, text in rows:
        words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)))
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return [(rows[i][0], f"{fps[i]:016x}", least.get(find(i))) for i in range(len(rows))]


def substrings(rows, window=50):
    """(doc_id, n_words, n_removed, kept sha256) of every row."""
    split = [WORD.findall(t or "") for _, t in rows]
    first = {}
    for (doc_id, _), words in zip(rows, split):
        if doc_id is not None:
            for i in range(len(words) - window + 1):
                key = tuple(words[i : i + window])
                first[key] = min(doc_id, first.get(key, doc_id))
    out = []
    for (doc_id, _), words in zip(rows, split):
        gone = set()
        for i in range(len(words) - window + 1):
            if doc_id is not None and first.get(tuple(words[i : i + window]), doc_id) < doc_id:
                gone.update(range(i, i + window))
        kept = [w for i, w in enumerate(words) if i not in gone]
        out.append((doc_id, len(words), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def base_spans(text):
    """The contract's four patterns, as written."""
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c in "0123456789"]
        odd = sum(digits[-1::-2]) + sum(sum(divmod(2 * d, 10)) for d in digits[-2::-2])
        if 13 <= len(digits) <= 19 and odd % 10 == 0:
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return out


def posteriors(rows, labels):
    """Of every (doc_id, text), by the classifier that the labelled (doc_id, quality, toxic) teach; clashing labels: the worst counts."""
    domains, domain = list(mixing.TARGETS), {}
    for i, quality, toxic in labels:
        q, x = domain.get(i, (1, 0))
        domain[i] = (min(q, quality), max(x, toxic))
    domain = {i: "toxic" if x else "clean" if q else "low" for i, (q, x) in domain.items()}
    buckets = lambda text: [xxhash.xxh64_intdigest(w.encode(), 42) & (mixing.BUCKETS - 1) for w in WORD.findall((text or "").lower())]
    counts = {d: {} for d in domains}
    for i, text in rows:
        for b in buckets(text) if i in domain else ():
            counts[domain[i]][b] = counts[domain[i]].get(b, 0) + 1
    sums = {d: sum(c.values()) for d, c in counts.items()}
    total = max(1, sum(sums.values()))
    prior = {d: (sum(x == d for x in domain.values()) + 1) / (len(domain) + len(domains)) for d in domains}
    out = []
    for _, text in rows:
        logits = []
        for d in domains:
            share, logit = max(sums[d], 1) / total, 0.0
            for b in buckets(text):
                if n := sum(c.get(b, 0) for c in counts.values()):
                    logit += math.log((counts[d].get(b, 0) + mixing.PSEUDO * share) / ((n + mixing.PSEUDO) * share))
            logits.append(math.log(prior[d]) + logit * mixing.EVIDENCE)
        e = np.exp(np.array(logits) - max(logits))
        out.append(e / e.sum())
    return np.array(out)


def rates(tokens, p, targets):
    """The rates nearest to one, none negative, that meet the targets: many small steps."""
    tokens, goal = np.array(tokens, float), np.array(list(targets.values())) / sum(targets.values()) * sum(tokens)
    steps, inverse = np.zeros(len(goal)), np.linalg.inv((p * tokens[:, None]).T @ p)
    for _ in range(20_000):
        steps += inverse @ ((tokens * np.maximum(0, 1 - p @ steps)) @ p - goal)
    return np.maximum(0, 1 - p @ steps)


def copies(doc_id, rate):
    drawn = xxhash.xxh64_intdigest(b"copies", xxhash.xxh64_intdigest(struct.pack("<q", doc_id), 42))
    return int(rate + (drawn - (1 << 64) if drawn >> 63 else drawn) % (1 << 30) / (1 << 30))


def shingles(text):
    words = WORD.findall((text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near_copies(rows):
    """Of (doc_id, text), the rows that stay: the first of each group that similarities of 0.8 and more connect."""
    rows, sets = sorted(set(rows)), []
    for _, text in rows:
        sets.append(shingles(text))
    group = list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            a, b = group[i], group[j]
            group = [min(a, b) if g in (a, b) else g for g in group]
    return [rows[g] for g in sorted(set(group))]


def pipeline(rows, labels, encode):
    """(doc_id, n_tokens, ids sha256, decoded sha256) of (doc_id, text) rows after all stages; for texts whose only personal data are of the fixed forms."""
    rows = [(i, t) for i, t in rows if any(c.isalpha() for c in t or "")]
    rows = near_copies(rows)
    rows = [(i, pii.masked_text(t, [(a, b, k) for k, a, b in base_spans(t)])) for i, t in rows]
    rate = rates([len(WORD.findall(t)) for _, t in rows], posteriors(rows, labels), mixing.TARGETS)
    out = []
    for (i, t), r in zip(rows, rate):
        ids, decoded = encode(t)
        out += [(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())] * copies(i, r)
    return out


def runs(words):
    """(start, length, period) of all runs, by trying every period on every stretch."""
    found, n = {}, len(words)
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(24, 3 * q):
                found.setdefault((i, j + q - i), q)  # periods rise, so the smallest is there first
            i = max(j, i + 1)
    # a stretch counts with its smallest period only, also where a multiple of it is found from another start
    out = []
    for (start, length), q in found.items():
        span = words[start : start + length]
        if not any(all(span[k] == span[k + p] for k in range(length - p)) for p in range(1, q)):
            out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic(doc_id, text, plant=True):
    """The row of op12's contract."""
    import zlib

    words = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    if plant and h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = runs(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(found), *best, None if best[0] is None else 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def minhash(rows, words=4, percent=80):
    """(doc_id, size of set, component, kept) of (doc_id, text) rows with ids, by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            a, b = find(i), find(j)
            group[max(a, b)] = min(a, b)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return [(d, len(s), least[find(i)], least[find(i)] == d) for i, ((d, _), s) in enumerate(zip(rows, sets))]
