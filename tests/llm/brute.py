"""Slow, plain versions of the operators, written from their contracts alone."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def repeats(rows, length=200):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = collections.Counter(b[s:s + length] for _, b in texts for s in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if seen[b[s:s + length]] > 1:
                gone[s:s + length] = True
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(b) else 0
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=repr)


def shingles(text, k):
    w = words(text)
    return frozenset(tuple(w[j:j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def components(rows, k, num, den):
    """rows with distinct ids: {id: (size of set, smallest id reachable)}"""
    sets = {i: shingles(t, k) for i, t in rows}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    holders = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    for i, s in sets.items():
        for j, c in collections.Counter(j for x in s for j in holders[x] if j < i).items():
            if den * c >= num * (len(s) + len(sets[j]) - c):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def targets(sizes, weights, factor=1.5, cap=2.0):
    """sizes and weights by source: repeated sharing until no target is above its cap."""
    total, fixed = factor * sum(sizes.values()), {}
    while True:
        rest = [s for s in sizes if s not in fixed and weights[s]]
        left = total - sum(fixed.values())
        out = {s: left * weights[s] / sum(weights[r] for r in rest) for s in rest}
        above = [s for s in rest if out[s] > cap * sizes[s]]
        if not above:
            return {s: fixed.get(s, out.get(s, 0.0)) for s in sizes}
        fixed |= {s: cap * sizes[s] for s in above}


def base_scores(rows):
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
    tokens = {i: [*words(t), "\0end"] for i, t in rows}
    count = collections.Counter(w for i, x in tokens.items() if not held[i] for w in x)
    n, v = sum(count.values()), len(count)
    return {i: (held[i], len(x), sum(count[w] > 0 for w in x), n, sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x)) for i, x in tokens.items()}


def template_words(text):
    """(words, template words) of a trimmed text."""
    import regex

    from tarnsift.llm import decontaminate as d

    out = regex.sub(rf"(?<![\p{{L}}\p{{N}}'’-])(?!(?:{d.STARTERS})(?![\p{{L}}'’-]))\p{{Lu}}[\p{{L}}'’-]*", "⟨name⟩", text)
    out = regex.sub(r"[0-9]+([.,:/][0-9]+)*", "⟨num⟩", out)
    out = regex.sub(rf"⟨num⟩(\s?)(?i:{d.UNITS})(?![\p{{L}}\p{{N}}])", r"⟨num⟩\1⟨unit⟩", out)
    split = lambda s: re.split(r"[\x20\x09-\x0D]+", s)
    return split(text), split(regex.sub(d.PUNCTUATION + "+", "", out).lower())


def leaks(docs, items, window=8, least=13, literals=4):
    """{(doc_id, item_id): most words covered}, by trying every item at every place of every text."""
    import regex

    bare = lambda w: regex.sub(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "", w)
    literal = lambda t: sum("⟨" not in w and w != "" for w in t)
    out = {}
    for item_id, raw in items:
        raw = (raw or "").strip(" \t\n\x0b\f\r")
        if not raw:
            continue
        iw, it = template_words(raw)
        size = window if len(it) >= window else len(it)
        if size < literals:
            continue
        kept = [a for a in range(len(it) - size + 1) if literal(it[a:a + size]) >= literals]
        whole = size < window or len({a + j for a in kept for j in range(size)}) < min(least, len(it))
        for doc_id, text in docs:
            text = (text or "").strip(" \t\n\x0b\f\r")
            if not text:
                continue
            dw, dt = template_words(text)
            for diagonal in range(-len(it) + size, len(dt) - size + 1):
                at = lambda j: dt[diagonal + j] if 0 <= diagonal + j < len(dt) else None
                if whole:
                    same = [at(j) == it[j] for j in range(len(it))]
                    first = same[0] or diagonal >= 0 and bare(dw[diagonal]).lower() == bare(iw[0]).lower()
                    covered = set(range(len(it))) if first and all(same[1:]) else set()
                else:
                    hits = [a for a in kept if all(at(a + j) == it[a + j] for j in range(size))]
                    covered = {a + j for a in hits for j in range(size)}
                if not covered or len(covered) < min(least, len(it)):
                    continue
                pairs = {(it[j], bare(iw[j]), bare(dw[diagonal + j])) for j in covered if "⟨" in it[j]}
                if len({p[:2] for p in pairs}) < len(pairs):
                    continue
                other = [p for p in pairs if "num" not in p[0]]
                if len({(k, d) for k, _, d in other}) < len(other):
                    continue
                if (size < window or whole and literal(it) < literals) and any(a != b for _, a, b in pairs):
                    continue
                out[doc_id, item_id] = max(out.get((doc_id, item_id), 0), len(covered))
    return out
