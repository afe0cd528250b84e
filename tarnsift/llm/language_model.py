"""Language-model scores from an Elias-Fano n-gram trie.

The trie has two levels, words and the words that follow them, in shards by the first word.  Each
level is a monotone sequence in Elias-Fano form: high bits in unary with a directory, low bits packed,
in a memory-mapped file.  The keys of the second level are the successors relative to their context,
so a bigram is found by a search for the successor within its context's range.  Probabilities are
smoothed by absolute discounting, mixed with those of single words, and kept as 16-bit codes.

Corpus and queries travel together: a block of documents sends each shard its distinct bigrams with
the documents they stand in, the shard counts the training ones, builds its trie, looks all of them
up and returns a sum for each document.  No vocabulary goes to the driver or to all executors.  What a
shard can't know is the probability of a word by itself: all training words are counted in shards by
word, and each of those sends every shard of contexts the exact counts of the words that follow there.
One unknown word has the count 1.
The most frequent contexts are split over shards by successor.  Their exact counts are known, and their
distinct successors are counted in shards by successor, so a split context has the probabilities that it
would have whole: which contexts are split, and over how many shards, changes no score.

Defined cases: null and empty texts are one end token; a null id is the text "" to the fold, and
trains; rows that repeat an id are documents of their own; with no training rows all counts are 0; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bins_for, materialize, table
from .packing import SENT, pack, sent, unpack
from .textkernel import _LOWER, mix, pieces, word_hashes, word_spans

_U = np.uint64
KEY_BITS, NEXT_BITS = 56, 40
#: A context with more than 1 / (SPLIT * bins) of all tokens is split into so many parts.
SPLIT, PARTS = 4, 16
DISCOUNT, SINGLE = 0.8, 0.6
#: Codes of probabilities: steps of log10.
STEP = 1 / 2000
#: Parts of a unit of log10 in which scores are summed, as whole numbers: no grouping changes a sum.
FINE = 1 << 20
#: Pairs of frequent contexts and successors that a task gathers before it hands them on.
MOST_PAIRS = 1 << 21
MOST_DOCS = 60_000
#: Pairs of words and shards are marked in a table of up to so many cells, else sorted.
MOST_CELLS = 1 << 26
_MASK_KEY, _MASK_NEXT = _U((1 << KEY_BITS) - 1), _U((1 << NEXT_BITS) - 1)
BEGIN, END = _U(1), _U(2)  # keys that stand for the two ends of a text


# --- compact sequences -----------------------------------------------------------------------


class EliasFano:
    """Strictly increasing numbers below 2 ** bits: find() gives positions, -1 where absent."""

    def __init__(self, parts: dict[str, np.ndarray], n: int, low_bytes: int):
        self.parts, self.n, self.low_bytes = parts, n, low_bytes

    @staticmethod
    def encode(values: np.ndarray, bits: int) -> "EliasFano":
        n = len(values)
        low_bytes = min(8, max(0, -(-(bits - max(n, 1).bit_length() + 1) // 8)))
        shift = _U(8 * low_bytes)
        high = (values >> shift).astype(np.int64) if low_bytes < 8 else np.zeros(n, np.int64)
        raw = np.zeros(int(high[-1]) + n + 1 if n else 1, bool)
        raw[high + np.arange(n)] = True  # the i-th one stands at high + i
        low = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(n, 8)[:, :low_bytes]
        words = np.packbits(raw, bitorder="little")
        words = np.r_[words, np.zeros(-len(words) % 8, np.uint8)]
        zeros = 64 - np.bitwise_count(words.view("<u8")).astype(np.int64)
        return EliasFano({"high": words, "zeros": np.r_[0, np.cumsum(zeros)], "low": np.ascontiguousarray(low)}, n, low_bytes)

    def _after_zeros(self, k: np.ndarray) -> np.ndarray:
        """Ones before the k-th zero (k from 1; 0 gives 0): where the bucket k begins."""
        out = np.zeros(len(k), np.int64)
        own = np.flatnonzero(k > 0)
        zeros, high = self.parts["zeros"], self.parts["high"]
        words = np.asarray(high).view("<u8")
        for at in range(0, len(own), 100_000):
            i = own[at:at + 100_000]
            k_i = np.minimum(k[i], zeros[-1])
            block = np.searchsorted(zeros, k_i, "left") - 1
            # halve the word until the zero is found
            word, left, place = ~words[block], k_i - zeros[block], np.zeros(len(i), np.int64)
            for width in (32, 16, 8, 4, 2, 1):
                below = np.bitwise_count(word & _U((1 << width) - 1)).astype(np.int64)
                up = left > below
                left, place = np.where(up, left - below, left), np.where(up, place + width, place)
                word = np.where(up, word >> _U(width), word)
            out[i] = block * 64 + place - (k_i - 1)
        return np.minimum(out, self.n)

    def low(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros((len(at), 8), np.uint8)
        out[:, :self.low_bytes] = self.parts["low"][at]
        return out.view("<u8").ravel()

    def find(self, values: np.ndarray) -> np.ndarray:
        if not self.n:
            return np.full(len(values), -1, np.int64)
        shift = 8 * self.low_bytes
        high = (values >> _U(shift)).astype(np.int64) if shift < 64 else np.zeros(len(values), np.int64)
        want = values & _U((1 << shift) - 1 if shift < 64 else (1 << 64) - 1)
        most = int(self.parts["zeros"][-1])
        a, b = self._after_zeros(np.minimum(high, most)), self._after_zeros(np.minimum(high + 1, most))
        end = b.copy()
        while True:  # bisection in all buckets at once
            live = np.flatnonzero(a < b)
            if not len(live):
                break
            m = (a[live] + b[live]) // 2
            less = self.low(m) < want[live]
            a[live], b[live] = np.where(less, m + 1, a[live]), np.where(less, b[live], m)
        hit = np.flatnonzero(a < end)
        out = np.full(len(values), -1, np.int64)
        hit = hit[self.low(a[hit]) == want[hit]]
        out[hit] = a[hit]
        return out


def code(p: np.ndarray) -> np.ndarray:
    return np.clip(np.round(-np.log10(np.maximum(p, 1e-32)) / STEP), 0, 65535).astype(np.uint16)


def decode(c: np.ndarray) -> np.ndarray:
    return 10.0 ** (-STEP * c.astype(np.float64))


def backoff(kinds: np.ndarray, total: np.ndarray) -> np.ndarray:
    """What of a word's probability by itself stays after contexts of so many distinct successors and tokens."""
    return SINGLE + (1 - SINGLE) * DISCOUNT * kinds / np.maximum(total, 1)


class Trie:
    """Both levels in one memory-mapped file, which goes with the object."""

    def __init__(self, keys, nexts, counts, parts_counts):
        """Sorted distinct (keys, nexts) with training counts > 0; parts_counts: (sorted keys of contexts
        that other shards hold parts of, their whole counts, their numbers of distinct successors)."""
        new = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        words, rank = keys[first], np.cumsum(new) - 1
        total = np.add.reduceat(counts, first) if len(first) else np.zeros(0, np.int64)
        kinds = np.diff(np.r_[first, len(keys)])
        at = np.searchsorted(parts_counts[0], words)
        at[at == len(parts_counts[0])] = 0
        split = (parts_counts[0][at] == words) if len(parts_counts[0]) else np.zeros(len(words), bool)
        if split.any():
            total, kinds = np.where(split, parts_counts[1][at], total), np.where(split, parts_counts[2][at], kinds)
        p = (1 - SINGLE) * (counts - DISCOUNT) / total[rank] if len(keys) else np.zeros(0)
        self.first = EliasFano.encode(words, KEY_BITS)
        # successors of context i lie from i << NEXT_BITS on
        self.bits = NEXT_BITS + max(1, len(words)).bit_length()
        self.second = EliasFano.encode((rank.astype(_U) << _U(NEXT_BITS)) | nexts, self.bits)
        arrays = {f"{k}{i}": v for i, level in enumerate((self.first, self.second)) for k, v in level.parts.items()}
        arrays |= {"total": total.astype(np.uint32) if total.max(initial=0) < 1 << 32 else total, "backoff": code(backoff(kinds, total)), "p": code(p)}
        handle, self.path = tempfile.mkstemp(prefix="trie")
        with os.fdopen(handle, "wb") as f:
            place = {}
            for k, v in arrays.items():
                f.write(b"\0" * (-f.tell() % 8))
                place[k] = (f.tell(), v.dtype, v.shape)
                f.write(v.tobytes())
            f.write(b"\0" * 8)
        mapped = np.memmap(self.path, np.uint8, "r")
        got = {k: mapped[o:o + int(np.prod(s)) * d.itemsize].view(d).reshape(s) for k, (o, d, s) in place.items()}
        for i, level in enumerate((self.first, self.second)):
            level.parts = {k: got[f"{k}{i}"] for k in level.parts}
        self.total, self.backoff, self.p = got["total"], got["backoff"], got["p"]

    def close(self) -> None:
        os.unlink(self.path)

    def lookup(self, words, each, nexts, other) -> tuple[np.ndarray, np.ndarray]:
        """Counts of contexts, and log10 probabilities of nexts after them; words: the contexts, each
        of so many nexts in a row; other: probabilities of the next words by themselves."""
        context = np.repeat(self.first.find(words), each)
        known = context >= 0
        at = np.full(len(context), -1, np.int64)
        at[known] = self.second.find((context[known].astype(_U) << _U(NEXT_BITS)) | nexts[known])
        p = np.array(other, np.float64)
        p[known] *= decode(self.backoff[context[known]])
        hit = at >= 0
        p[hit] += decode(self.p[at[hit]])
        return np.where(known, self.total[np.maximum(context, 0)] if self.first.n else 0, 0).astype(np.int64), np.log10(np.maximum(p, 1e-300))


# --- texts -----------------------------------------------------------------------------------


def key(h: np.ndarray) -> np.ndarray:
    """Word hash as a context; never BEGIN or END."""
    return np.maximum(mix(h ^ _U(0x5851F42D4C957F2D)) & _MASK_KEY, _U(3))


def next_key(k: np.ndarray) -> np.ndarray:
    return np.where(k < _U(3), k, np.maximum(mix(k) & _MASK_NEXT, _U(3)))


class Block:
    """The tokens of some rows: words and an end each, as indices into distinct words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        starts, ends, row = word_spans(data, offsets)
        unique, token = np.unique(word_hashes(data, starts, ends), return_inverse=True)
        self.n, self.words = len(offsets) - 1, key(unique)
        self.token, self.row = token, row


def _blocks(column: pa.Array) -> Iterator[tuple[int, Block]]:
    for first, data, offsets in pieces(column):
        for at in range(0, len(offsets) - 1, MOST_DOCS):
            o = offsets[at:at + MOST_DOCS + 1]
            yield first + at, Block(data[o[0]:o[-1]], o - o[0])


def _train_counts(b: Block, train: np.ndarray) -> np.ndarray:
    return np.bincount(b.token[train[b.row]], minlength=len(b.words))


# --- counts of words -------------------------------------------------------------------------


_ROWS, _BIGRAMS, _SUMS, _SIZES, _TOTALS, _NEEDS, _COUNTS, _PAIRS, _KINDS = range(9)


class Outline:
    """Numbers of training words, texts and distinct words; the words that are frequent contexts, with counts."""

    def __init__(self, words: int, docs: int, kinds: int, keys: np.ndarray, counts: np.ndarray):
        order = np.argsort(keys)
        self.tokens, self.docs, self.kinds = words + docs, docs, kinds  # ends are tokens too
        self.keys, self.counts = keys[order], counts[order]

    def probability(self, n: np.ndarray) -> np.ndarray:
        """Of words of these counts by themselves; 0 is the unknown word."""
        return np.maximum(n, 1) / (self.tokens + 1)

    def end(self) -> float:
        return max(self.docs, 0.5) / (self.tokens + 1)


def _dealt(words: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of words in the order of their shards, and where each shard begins."""
    bin_of = (mix(words) % _U(bins)).astype(np.int64)
    by = np.argsort(bin_of, kind="stable")
    return by, np.searchsorted(bin_of[by], np.arange(bins + 1))


def _held(batches) -> dict[int, list]:
    held: dict[int, list] = {}
    for batch in batches:
        for i, kind, body in zip(*(batch.column(c).to_pylist() for c in (0, 2, 3))):
            held.setdefault(i, []).append((kind, body))
    return held


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def word_totals(docs: DataFrame, bins: int) -> DataFrame:
    """docs: (id, text, train).  For each shard of words their exact training counts, and its sizes."""

    def count(batches):
        number = TaskContext.get().partitionId()
        for batch in batches:
            train = batch.column(2).to_numpy(zero_copy_only=False)
            out = [(number % bins, -1, _SIZES, pack(np.array([train.sum()], np.int64)))]
            for first, b in _blocks(batch.column(1)):
                n = _train_counts(b, train[first:first + b.n])
                words, n = b.words[n > 0], n[n > 0].astype(np.int64)
                by, edge = _dealt(words, bins)
                for i in range(bins):
                    own = by[edge[i]:edge[i + 1]]
                    if len(own):
                        out.append((i, -1, _TOTALS, pack(words[own], n[own])))
            yield sent(out)

    def add(batches):
        for i, rows in _held(batches).items():
            docs = sum(int(unpack(body, "i8")[0][0]) for kind, body in rows if kind == _SIZES)
            got = [unpack(body, "u8", "i8") for kind, body in rows if kind == _TOTALS]
            keys, n = _summed(*(np.concatenate(x) for x in zip(*got))) if got else (np.zeros(0, _U), np.zeros(0, np.int64))
            yield sent([(i, -1, _SIZES, pack(np.array([n.sum(), docs, len(keys)], np.int64))), (i, -1, _TOTALS, pack(keys, n))])

    return materialize(docs.mapInArrow(count, SENT).repartition(bins, "bin").mapInArrow(add, SENT), "model-words")


def outline(totals: DataFrame, bins: int) -> Outline:
    """What comes to the driver: three numbers a shard, and fewer than SPLIT * bins words."""
    sizes = [unpack(bytes(r.payload), "i8")[0] for r in totals.filter(F.col("kind") == _SIZES).select("payload").collect()]
    words, docs, kinds = (int(x) for x in np.sum([np.zeros(3, np.int64), *sizes], axis=0))

    def frequent(batches):
        for batch in batches:
            for body in batch.column(0).to_pylist():
                keys, n = unpack(body, "u8", "i8")
                own = n > (words + docs) / (SPLIT * bins)
                yield pa.RecordBatch.from_arrays([pa.array(keys[own].astype(np.int64)), pa.array(n[own])], names=["word", "n"])

    found = totals.filter(F.col("kind") == _TOTALS).select("payload").mapInArrow(frequent, "word long, n long").collect()
    return Outline(words, docs, kinds, np.array([r.word for r in found], np.int64).astype(_U), np.array([r.n for r in found], np.int64))


def _needs(o: Outline, bins: int):
    """Blocks tell the shards of words which shards of contexts each of their words follows in, and the
    shards of successors which frequent contexts they follow in training texts."""
    frequent = _frequent_contexts(o)[0]

    def share(held):
        pairs = np.unique(np.concatenate(held))
        by, edge = _dealt(pairs & _MASK_NEXT, bins)
        return sent([(i, -1, _PAIRS, pack(pairs[by[edge[i]:edge[i + 1]]])) for i in range(bins) if edge[i] < edge[i + 1]])

    def run(batches):
        held, n_held = [], 0
        for batch in batches:
            train = batch.column(2).to_numpy(zero_copy_only=False)
            for first, b in _blocks(batch.column(1)):
                words, size, tokens, context = _sequence(b)
                place = np.minimum(np.searchsorted(frequent, words), len(frequent) - 1)
                own = (frequent[place] == words)[context] & np.repeat(train[first:first + b.n], size)
                held.append(np.unique((place[context[own]].astype(_U) << _U(NEXT_BITS)) | next_key(words)[tokens[own]]))
                n_held += len(held[-1])
                if n_held > MOST_PAIRS:
                    yield share(held)
                    held, n_held = [], 0
                if not len(b.words):
                    continue
                inner = tokens < len(b.words)
                tokens, context = tokens[inner], context[inner]
                cells = tokens * bins + _bins_of(words[context], next_key(b.words)[tokens], frequent, bins)
                if len(b.words) * bins <= MOST_CELLS:
                    marked = np.zeros(len(b.words) * bins, bool)
                    marked[cells] = True
                    cells = np.flatnonzero(marked)
                else:
                    cells = np.unique(cells)
                word, to = cells // bins, cells % bins
                each = np.bincount(word, minlength=len(b.words))
                start = np.cumsum(each) - each
                by, edge = _dealt(b.words, bins)
                out = []
                for i in range(bins):
                    own = by[edge[i]:edge[i + 1]]
                    if len(own):
                        n = each[own]
                        out.append((i, -1, _NEEDS, pack(
                            b.words[own], n.astype(np.uint32), to[np.repeat(start[own] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))].astype(np.uint32))))
                yield sent(out)
        if held:
            yield share(held)

    return run


def _deliver(o: Outline, bins: int):
    """Shards of words send each shard of contexts the counts of the words that follow in it, once each, and
    their share of the numbers of distinct successors of the frequent contexts."""
    n_frequent = len(_frequent_contexts(o)[0])

    def run(batches):
        for i, rows in _held(batches).items():
            pairs = [unpack(body, "u8")[0] for kind, body in rows if kind == _PAIRS]
            if pairs:
                follow = np.unique(np.concatenate(pairs)) >> _U(NEXT_BITS)
                body = pack(np.bincount(follow.astype(np.int64), minlength=n_frequent))
                yield sent([(to, -1, _KINDS, body) for to in range(bins)])
            keys, counts = next((unpack(body, "u8", "i8") for kind, body in rows if kind == _TOTALS), (np.zeros(0, _U), np.zeros(0, np.int64)))
            needs = [unpack(body, "u8", "u4", "u4") for kind, body in rows if kind == _NEEDS]
            if not needs or not len(keys):
                continue
            pairs = []
            for words, each, to in needs:
                at = np.minimum(np.searchsorted(keys, words), len(keys) - 1)
                own = np.repeat(keys[at] == words, each)  # others are unknown
                pairs.append(to[own].astype(np.int64) * len(keys) + np.repeat(at, each)[own])
            pairs = np.unique(np.concatenate(pairs))
            edge = np.searchsorted(pairs, np.arange(bins + 1) * len(keys))
            out = []
            for to in range(bins):
                at = pairs[edge[to]:edge[to + 1]] - to * len(keys)
                if len(at):
                    out.append((to, -1, _COUNTS, pack(next_key(keys[at]), counts[at])))
            yield sent(out)

    return run


# --- shards ----------------------------------------------------------------------------------


def _frequent_contexts(o: Outline) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and exact counts of the contexts that are split; at most SPLIT * bins and BEGIN."""
    return np.r_[[BEGIN], o.keys].astype(_U), np.r_[o.docs, o.counts].astype(np.int64)


def _sequence(b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, END and BEGIN; lengths of the rows; tokens with an end after each row, and contexts with a
    begin before it, as indices into the words."""
    size = np.bincount(b.row, minlength=b.n) + 1
    stop = np.cumsum(size)
    tokens = np.full(int(size.sum()), len(b.words), np.int64)
    inner = np.ones(len(tokens), bool)
    inner[stop - 1] = False
    tokens[inner] = b.token
    context = np.r_[0, tokens[:-1]]
    context[stop - size] = len(b.words) + 1
    return np.r_[b.words, END, BEGIN], size, tokens, context


def _bins_of(k: np.ndarray, nxt: np.ndarray, frequent: np.ndarray, bins: int) -> np.ndarray:
    """Shards of bigrams: by context, and by successor too for contexts that are split."""
    place = np.minimum(np.searchsorted(frequent, k), len(frequent) - 1)
    split = frequent[place] == k
    return (mix(k + np.where(split, mix(nxt) % _U(PARTS), _U(0)) * _U(0x9E3779B97F4A7C15)) % _U(bins)).astype(np.int64)


def _send(o: Outline, bins: int):
    frequent = _frequent_contexts(o)[0]

    def run(batches):
        number = TaskContext.get().partitionId() << 24
        for batch in batches:
            train_all = batch.column(2).to_numpy(zero_copy_only=False)
            ids = batch.column(0)
            for first, b in _blocks(batch.column(1)):
                train = train_all[first:first + b.n]
                words, size, tokens, context = _sequence(b)
                doc = np.repeat(np.arange(b.n), size)
                # distinct bigrams with their rows
                order = np.lexsort((doc, tokens, context))
                c, t, d = context[order], tokens[order], doc[order].astype(np.uint16)
                new = np.r_[True, (c[1:] != c[:-1]) | (t[1:] != t[:-1])]
                at = np.flatnonzero(new)
                times = np.diff(np.r_[at, len(c)]).astype(np.uint32)
                k, nxt = words[c[at]], next_key(words[t[at]])
                bin_of = _bins_of(k, nxt, frequent, bins)
                by = np.lexsort((nxt, k, bin_of))
                edge = np.searchsorted(bin_of[by], np.arange(bins + 1))
                start = at
                out = []
                for i in range(bins):
                    own = by[edge[i]:edge[i + 1]]
                    if not len(own):
                        continue
                    kk = k[own]
                    head = np.flatnonzero(np.r_[True, kk[1:] != kk[:-1]])
                    n = times[own].astype(np.int64)
                    docs = d[np.repeat(start[own] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
                    out.append((i, number, _BIGRAMS, pack(
                        kk[head], np.diff(np.r_[head, len(kk)]).astype(np.uint32), nxt[own], times[own], docs, train.astype(np.uint8))))
                own_ids = ids.slice(first, b.n)
                out.append((number % bins, number, _ROWS, pack(
                    own_ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), np.asarray(own_ids.is_null()).astype(np.uint8),
                    (~train).astype(np.uint8), size.astype(np.int64))))
                yield sent(out)
                number += 1

    return run


def _answer(o: Outline):
    frequent = _frequent_contexts(o)

    def one_bin(i: int, held: list, got: list, kinds: list) -> Iterator[pa.RecordBatch]:
        parts_counts = *frequent, np.sum([np.zeros(len(frequent[0]), np.int64), *(unpack(body, "i8")[0] for body in kinds)], axis=0)
        stay = decode(code(backoff(parts_counts[2], parts_counts[1])))
        got = [unpack(body, "u8", "i8") for body in got]
        known, counts = _summed(*(np.concatenate(x) for x in zip(*got))) if got else (np.zeros(0, _U), np.zeros(0, np.int64))
        # END is less than every word's key
        known, alone = np.r_[END, known], np.r_[o.end(), o.probability(counts)]
        blocks = []
        for block, body in held:
            words, each, nexts, times, docs, train = unpack(body, "u8", "u4", "u8", "u4", "u2", "u1")
            at = np.minimum(np.searchsorted(known, nexts), len(known) - 1)
            p = np.where(known[at] == nexts, alone[at], o.probability(np.int64(0)))
            pair = np.repeat(np.arange(len(nexts)), times)
            n = np.bincount(pair, weights=train[docs], minlength=len(nexts)).astype(np.int64)
            blocks.append((block, np.repeat(words, each), nexts, p, pair, docs, len(train), n, words, each))
        keys, nexts, counts = (np.concatenate([b[j] for b in blocks]) for j in (1, 2, 7))
        own = counts > 0
        keys, nexts, counts = keys[own], nexts[own], counts[own]
        order = np.lexsort((nexts, keys))
        keys, nexts, counts = keys[order], nexts[order], counts[order]
        first = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (nexts[1:] != nexts[:-1])]) if len(keys) else np.zeros(0, np.int64)
        trie = Trie(keys[first], nexts[first], np.add.reduceat(counts, first) if len(first) else counts, parts_counts)
        try:
            for block, k, nxt, p, pair, docs, n_docs, _, words, each in blocks:
                c, logs = trie.lookup(words, each, nxt, p)
                # the counts of split contexts are whole wherever their training bigrams are or not
                at = np.minimum(np.searchsorted(parts_counts[0], k), len(parts_counts[0]) - 1)
                split = parts_counts[0][at] == k
                unseen = split & (c == 0) & (parts_counts[1][at] > 0)
                c = np.where(split, parts_counts[1][at], c)
                logs = np.where(unseen, np.log10(np.maximum(stay[at] * p, 1e-300)), logs)
                word = k != BEGIN
                base = np.where(word, np.log10(c + 0.5), 0.0)[pair]
                yield sent([(i, block, _SUMS, pack(
                    np.bincount(docs, weights=base, minlength=n_docs), np.bincount(docs, weights=np.rint(logs * FINE)[pair], minlength=n_docs).astype(np.int64),
                    np.bincount(docs, weights=(word & (c > 0))[pair], minlength=n_docs).astype(np.uint32)))])
        finally:
            trie.close()

    def run(batches):
        held: dict[int, list] = {}
        counts: dict[int, list] = {}
        kinds: dict[int, list] = {}
        for batch in batches:
            for i, block, kind, body in zip(*(batch.column(c).to_pylist() for c in range(4))):
                if kind == _ROWS:
                    yield sent([(i, block, kind, body)])
                elif kind == _COUNTS:
                    counts.setdefault(i, []).append(body)
                elif kind == _KINDS:
                    kinds.setdefault(i, []).append(body)
                else:
                    held.setdefault(i, []).append((block, body))
        for i in sorted(held):
            yield from one_bin(i, held.pop(i), counts.pop(i, []), kinds.pop(i, []))

    return run


def _finish(tokens: int, kinds: int, docs: int):
    log_all = np.log10(tokens + 0.5 * (kinds + 1))

    def run(batches):
        sums: dict[int, list] = {}
        rows: dict[int, list] = {}
        for batch in batches:
            for block, kind, body in zip(*(batch.column(c).to_pylist() for c in range(1, 4))):
                if kind == _ROWS:
                    rows[block] = unpack(body, "i8", "u1", "u1", "i8")
                else:
                    got = unpack(body, "f8", "i8", "u4")
                    now = sums.setdefault(block, [np.zeros(len(got[0])), np.zeros(len(got[0]), np.int64), np.zeros(len(got[0]), np.int64)])
                    for a, b in zip(now, got):
                        a += b
        for block, (ids, null, held, n) in rows.items():
            base, score, known = sums[block]
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, mask=null.astype(bool)), pa.array(held.astype(bool)), pa.array(n), pa.array(known + (docs > 0)),
                pa.array(np.full(len(ids), tokens, np.int64)), pa.array(base + np.log10(docs + 0.5) - n * log_all), pa.array(score / FINE),
            ], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score_texts(docs: DataFrame, bins: int | None = None) -> DataFrame:
    """docs: (id long, text, train boolean).  doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score of every row."""
    bins = bins or bins_for(docs)
    totals = word_totals(docs, bins)
    o = outline(totals, bins)
    counts = docs.mapInArrow(_needs(o, bins), SENT).union(totals).repartition(bins, "bin").mapInArrow(_deliver(o, bins), SENT)
    sent = docs.mapInArrow(_send(o, bins), SENT).union(counts).repartition(bins, "bin")
    answered = materialize(sent.mapInArrow(_answer(o), SENT), "model-answers")
    return answered.repartition(bins, "block").mapInArrow(
        _finish(o.tokens, o.kinds + (o.docs > 0), o.docs),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op10_language_model(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 1
    return score_texts(docs.select(F.col("doc_id").cast("long").alias("id"), "text", (~held).alias("train")))


