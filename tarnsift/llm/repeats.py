"""Removal of long repeated byte strings by run-length indexes.

A byte goes if a string of LENGTH bytes that covers it also starts somewhere else.  Every such string
has an anchor, the least hash of its K-byte strings, so equal strings have equal anchors at equal
places and meet in the shard of the anchor's hash.  There the texts around the anchors that occur more
than once are concatenated; their Burrows-Wheeler transform is kept as runs, with the suffix positions
sampled at the runs' ends and the common prefixes of neighbours measured there alone; from the samples
the matching statistics of all positions are streamed, and matches of LENGTH or more are marked.
Equal texts are one entry with a count.  An anchor that occurs more than FREQUENT times would make one
shard's index grow with the corpus; its strings are split by their distance to the anchor into groups of
GROUP starts, whose texts share LENGTH - GROUP + 1 bytes, and are indexed in the shard of the hash of
these.  Strings of an anchor with over VERY_FREQUENT occurrences are compared by 128-bit hashes of their
LENGTH bytes, dealt over all shards: by chance two of n different strings get one hash with a probability
of n * n / 2 ** 129.

Work goes in blocks of documents: anchors out, which of them repeat back, texts out, marks back.

Defined cases: null text is empty; texts shorter than LENGTH lose nothing; strings never cross texts;
rows that repeat an id are texts of their own, and repeat each other; a null id is kept; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bins_for, table
from .packing import SENT, pack, sent, unpack
from .textkernel import _BYTES, _power, mix, pieces

_U = np.uint64
LENGTH, K = 200, 32
#: Occurrences of an anchor beyond which its strings are split, and beyond which they are compared by hash.
FREQUENT, VERY_FREQUENT = 512, 32_768
#: Starts of a group of the strings of a frequent anchor.
GROUP = 24
#: Bytes of an index, about.
INDEX_BYTES = 1_000_000
_SPAN = LENGTH - K + 1
_STOP = 0xFF  # in no UTF-8 text
#: Bits of an anchor's order that hold its place; a column of texts is shorter than 2 ** 31 bytes.
_PLACE = _U((1 << 32) - 1)

_TEXTS, _ANCHORS, _CODES, _STRINGS, _HASHES, _MARKS, _HASH_MARKS, _DONE = range(8)


# --- anchors ---------------------------------------------------------------------------------


_OTHER_BYTES = np.random.default_rng(20250607).integers(1, 1 << 63, 256, dtype=np.uint64)


def _sums(data: np.ndarray, letters: np.ndarray = _BYTES) -> np.ndarray:
    out = np.zeros(len(data) + 1, _U)
    np.cumsum(letters[data] * _power(len(data) + 1)[0][:-1], dtype=_U, out=out[1:])
    return out


def _hash(sums: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[at]) * _power(len(sums))[1][at] + (end - at).astype(_U))


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sums, hash of each anchor, its place, first and last start of the strings that it anchors)."""
    sums = _sums(data)
    n = len(data) - K + 1
    none = np.zeros(0, np.int64)
    if n < _SPAN:
        return sums, none.astype(_U), none, none, none
    hashes = _hash(sums, np.arange(n), np.arange(n) + K)
    # the leftmost of equals is the least; as many bits whatever the length, so equal strings have equal anchors
    ordered = (hashes & ~_PLACE) | np.arange(n, dtype=_U)
    rows = -(-n // _SPAN)
    padded = np.full(rows * _SPAN, _U(0xFFFFFFFFFFFFFFFF))
    padded[:n] = ordered
    padded = padded.reshape(rows, _SPAN)
    ahead = np.minimum.accumulate(padded, 1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    starts = np.arange(len(data) - LENGTH + 1)
    place = (np.minimum(behind[starts], ahead[starts + _SPAN - 1]) & _PLACE).astype(np.int64)
    row = np.searchsorted(offsets, starts, "right") - 1
    inside = starts + LENGTH <= offsets[row + 1]
    starts, place = starts[inside], place[inside]
    new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)]) if len(starts) else none
    last = starts[np.r_[new[1:] - 1, len(starts) - 1]] if len(starts) else none
    return sums, hashes[place[new]], place[new], starts[new], last


# --- run-length index ------------------------------------------------------------------------


class RunIndex:
    """Runs of the Burrows-Wheeler transform of a text, with samples at both ends of each run.

    heads and lengths are the transform.  For a position at the start of a run its neighbour before
    in suffix order, and the length that they share, are measured; between samples the neighbour moves
    along and the length falls by one a position.  Likewise the neighbour after, at ends of runs.
    """

    #: Longer than any text of an index, so two suffixes that share so much don't exist.
    MOST = 1024
    assert 2 * LENGTH < MOST

    def __init__(self, text: np.ndarray):
        n = len(text)
        padded = np.r_[text, np.zeros(8 + self.MOST, np.uint8)]
        self.words = np.zeros(n + self.MOST, _U)
        for j in range(8):
            self.words = (self.words << _U(8)) | padded[j:j + n + self.MOST].astype(_U)
        order = np.argsort(self.words[:n])
        rank = self._ranks(order, self.words[:n])
        width = 8
        while rank[order[-1]] < n - 1 and width < self.MOST:
            after = np.zeros(n, np.int64)
            after[:max(n - width, 0)] = rank[width:] + 1
            both = rank * (n + 1) + after
            order = np.argsort(both)
            rank = self._ranks(order, both)
            width *= 2
        before = np.where(order > 0, text[order - 1].astype(np.int16), 256)
        edge = np.flatnonzero(before[1:] != before[:-1]) + 1
        self.heads, self.lengths = before[np.r_[0, edge]], np.diff(np.r_[0, edge, n])
        self.sides = [self._samples(order[edge], order[edge - 1], order[0], n), self._samples(order[edge - 1], order[edge], order[-1], n)]

    @staticmethod
    def _ranks(order, values):
        out = np.empty(len(order), np.int64)
        s = values[order]
        out[order] = np.cumsum(np.r_[0, s[1:] != s[:-1]])
        return out

    def _samples(self, at, neighbour, end, n):
        shared = np.zeros(len(at), np.int64)
        live = np.arange(len(at))
        for step in range(0, self.MOST - 8, 8):
            a, b = at[live] + step, neighbour[live] + step
            ok = (a < n) & (b < n)
            live, a, b = live[ok], a[ok], b[ok]
            differ = self.words[a] ^ self.words[b]
            equal = differ == 0
            rest = live[~equal]
            shared[rest] = step + (63 - np.floor(np.log2(np.maximum(differ[~equal] >> _U(8), _U(1)).astype(np.float64))).astype(np.int64) - 8) // 8
            same = np.flatnonzero(~equal)[(differ[~equal] >> _U(8)) == 0]
            shared[live[same]] = step + 7
            live = live[equal]
            shared[live] = step + 8
            if not len(live):
                break
        at, neighbour, shared = np.r_[at, end], np.r_[neighbour, -1], np.r_[shared, 0]
        by = np.argsort(at)
        return at[by], neighbour[by], shared[by]

    def step(self, side: int, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The neighbour of each position and the length that they share; -1 where there is none."""
        at, neighbour, shared = self.sides[side]
        i = np.searchsorted(at, p, "right") - 1
        moved = p - at[np.maximum(i, 0)]
        none = (i < 0) | (neighbour[np.maximum(i, 0)] < 0)
        return np.where(none, -1, neighbour[i] + moved), np.where(none, 0, np.maximum(shared[i] - moved, 0))

    def matched(self, p: np.ndarray, origin: np.ndarray, length: int) -> np.ndarray:
        """Whether length bytes from each position occur at a position of another origin."""
        out = np.zeros(len(p), bool)
        for side in (0, 1):
            live, now, most = np.arange(len(p)), p.copy(), np.full(len(p), 1 << 30)
            while len(live):
                now, shared = self.step(side, now)
                most = np.minimum(most, shared)
                ok = (now >= 0) & (most >= length)
                live, now, most = live[ok], now[ok], most[ok]
                other = origin[now] != origin[p[live]]
                out[live[other]] = True
                live, now, most = live[~other], now[~other], most[~other]
        return out


def mark(groups: np.ndarray, texts: list[bytes], counts: np.ndarray, origins: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each text, which of its starts begin a string of length bytes that occurs elsewhere.

    groups: sorted; texts of a group are distinct and may share strings, others may not.  counts: of
    occurrences; a text that occurs more than once repeats whole.  origins: place of each text's first
    byte, by which overlapping texts of one document are known; a shard numbers its blocks from 0."""
    out = [np.full(len(x) - length + 1, c > 1) for x, c in zip(texts, counts)]
    first = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]) if len(groups) else []
    held, size = [], 0
    for a, b in zip(first, [*first[1:], len(groups)]):
        if b - a > 1 and (counts[a:b] == 1).any():
            held += range(a, b)
            size += sum(len(texts[i]) for i in range(a, b))
        if held and (size >= INDEX_BYTES or b == len(groups)):
            _mark_one(held, texts, counts, origins, length, out)
            held, size = [], 0
    if held:
        _mark_one(held, texts, counts, origins, length, out)
    return out


def _mark_one(own, texts, counts, origins, length, out) -> None:
    text = np.frombuffer(bytes([_STOP]).join(texts[i] for i in own) + bytes([_STOP]), np.uint8)
    size = np.array([len(texts[i]) + 1 for i in own])
    at = np.cumsum(size) - size
    # texts that occur more than once lie elsewhere whatever the place
    base = np.array([origins[i] if counts[i] == 1 else -(1 << 40) * (j + 1) for j, i in enumerate(own)])
    origin = np.repeat(base, size) + np.arange(len(text)) - np.repeat(at, size)
    index = RunIndex(text)
    ask = [j for j, i in enumerate(own) if counts[i] == 1]
    n = np.array([len(out[own[j]]) for j in ask])
    p = np.repeat(at[ask] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    found = index.matched(p, origin, length)
    for j, a, b in zip(ask, np.cumsum(n) - n, np.cumsum(n)):
        out[own[j]] = found[a:b]


# --- blocks and shards -----------------------------------------------------------------------


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All numbers of ranges."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))


def _dealt(keys: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of keys by bin, and where the bins begin in it."""
    bin_of = (mix(keys) % _U(bins)).astype(np.int64)
    order = np.argsort(bin_of, kind="stable")
    return order, np.searchsorted(bin_of[order], np.arange(bins + 1))


def _first_pass(bins: int):
    def run(batches):
        number = TaskContext.get().partitionId() << 24
        for batch in batches:
            ids = batch.column(0)
            for first, data, offsets in pieces(batch.column(1)):
                own = ids.slice(first, len(offsets) - 1)
                rows = [(number % bins, number, _TEXTS, pack(
                    own.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), np.asarray(own.is_null()).astype(np.uint8), offsets.astype(np.int64), data))]
                hashes, counts = np.unique(anchors(data, offsets)[1], return_counts=True)
                order, edge = _dealt(hashes, bins)
                for i in range(bins):
                    o = order[edge[i]:edge[i + 1]]
                    if len(o):
                        rows.append((i, number, _ANCHORS, pack(hashes[o], counts[o].astype(np.uint32))))
                yield sent(rows)
                number += 1

    return run


def _by_bin(batches, kinds: tuple[int, ...]):
    """Yields rows of other kinds at once, then (bin, {kind: [(block, body)]})."""
    held: dict[int, dict[int, list]] = {}
    for batch in batches:
        for i, block, kind, body in zip(*(batch.column(c).to_pylist() for c in range(4))):
            if kind in kinds:
                held.setdefault(i, {}).setdefault(kind, []).append((block, body))
            else:
                yield None, [(i, block, kind, body)]
    for i in sorted(held):
        yield i, held.pop(i)


def _which_repeat(frequent: int, very: int):
    """0 for an anchor that occurs once, 1 if more often, 2 if its strings are to be split, 3 if hashed."""

    def run(batches):
        for i, got in _by_bin(batches, (_ANCHORS,)):
            if i is None:
                yield sent(got)
                continue
            parts = [(block, *unpack(body, "u8", "u4")) for block, body in got[_ANCHORS]]
            every, inverse = np.unique(np.concatenate([p[1] for p in parts]), return_inverse=True)
            total = np.bincount(inverse, weights=np.concatenate([p[2] for p in parts]), minlength=len(every))
            codes = ((total > 1).astype(np.uint8) + (total > frequent) + (total > very))[inverse].astype(np.uint8)
            at = 0
            for block, hashes, _ in parts:
                yield sent([(i, block, _CODES, pack(codes[at:at + len(hashes)]))])
                at += len(hashes)

    return run


def _by_block(batches):
    """Rows are sorted by block: (block, [(bin, kind, body)])."""
    now, held = None, []
    for batch in batches:
        for i, block, kind, body in zip(*(batch.column(c).to_pylist() for c in range(4))):
            if block != now and held:
                yield now, held
                held = []
            now = block
            held.append((i, kind, body))
    if held:
        yield now, held


def _results(ids, null, data, offsets, removed) -> bytes:
    """Digests of rows of which removed marks the bytes that go."""
    gone = np.r_[0, np.cumsum(removed)]
    begin = removed.copy()
    begin[1:] &= ~removed[:-1]
    begin[offsets[:-1][offsets[:-1] < len(data)]] = removed[offsets[:-1][offsets[:-1] < len(data)]]
    spans = np.r_[0, np.cumsum(begin)]
    a, b = offsets[:-1], offsets[1:]
    digests = b"".join(hashlib.sha256((data[x:y][~removed[x:y]] if gone[y] > gone[x] else data[x:y]).tobytes()).digest() for x, y in zip(a, b))
    return pack(ids, null, b - a, gone[b] - gone[a], spans[b] - spans[a], np.frombuffer(digests, np.uint8))


def _split(hashes, place, low, high, sums) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, key, first and last start) of the groups of the strings of anchors."""
    near, far = (place - high) // GROUP, (place - low) // GROUP
    each = far - near + 1
    of, group = np.repeat(np.arange(len(place)), each), _ranges(near, each)
    latest = place[of] - GROUP * group  # of the group; its strings share the bytes from here on
    shared = _hash(sums, latest, latest + (LENGTH - GROUP + 1))
    key = mix(hashes[of] ^ mix(shared + group.astype(_U)))
    return of, key, np.maximum(low[of], latest - GROUP + 1), np.minimum(high[of], latest)


def _pairs(first: np.ndarray, second: np.ndarray, **options):
    """np.unique of pairs."""
    return np.unique(np.ascontiguousarray(np.stack([first, second], 1)).view("u8,u8").ravel(), **options)


def _second_pass(bins: int):
    def run(batches):
        for block, rows in _by_block(batches):
            ids, null, offsets, data = unpack(next(body for _, kind, body in rows if kind == _TEXTS), "i8", "u1", "i8", "u1")
            sums, hashes, place_of, low, high = anchors(data, offsets)
            distinct, inverse = np.unique(hashes, return_inverse=True)
            order, edge = _dealt(distinct, bins)
            codes = np.zeros(len(distinct), np.uint8)
            for i, kind, body in rows:
                if kind == _CODES:
                    codes[order[edge[i]:edge[i + 1]]] = unpack(body, "u1")[0]
            code = codes[inverse] if len(distinct) else np.zeros(0, np.uint8)
            # documents of which nothing can repeat are done
            row = np.searchsorted(offsets, low, "right") - 1
            open_ = np.zeros(len(offsets) - 1, bool)
            open_[row[code > 0]] = True
            sizes = np.diff(offsets)
            for own, kind in ((~open_, _DONE), (open_, None)):
                if not own.any():
                    continue
                part = data[_ranges(offsets[:-1][own], sizes[own])]
                cut = np.r_[0, np.cumsum(sizes[own])]
                if kind == _DONE:
                    yield sent([(block % bins, block, _DONE, _results(ids[own], null[own], part, cut, np.zeros(len(part), bool)))])
                    continue
                # starts in what stays
                shift = np.zeros(len(own), np.int64)
                shift[own] = cut[:-1] - offsets[:-1][own]
                out = []
                one, two = np.flatnonzero(code == 1), np.flatnonzero(code == 2)
                of, key, first_start, last_start = _split(hashes[two], place_of[two], low[two], high[two], sums)
                own_row = np.r_[row[one], row[two][of]]
                key, begin, end = np.r_[hashes[one], key], np.r_[low[one], first_start], np.r_[high[one], last_start] + LENGTH
                texts = _pairs(key, _hash(sums, begin, end), return_index=True, return_inverse=True)
                first, same = texts[1], texts[2]
                by, e = _dealt(key[first], bins)
                times = np.bincount(same, minlength=len(first))
                for i in range(bins):
                    o = by[e[i]:e[i + 1]]
                    if len(o):
                        at, size = begin[first[o]], (end - begin)[first[o]]
                        out.append((i, block, _STRINGS, pack(key[first[o]], size.astype(np.uint32), times[o].astype(np.uint32), at.astype(np.int64), data[_ranges(at, size)])))
                # of each distinct text, in the order of the bins, where it stands
                place = np.empty(len(first), np.int64)
                place[by] = np.arange(len(first))
                turn = np.argsort(place[same], kind="stable")
                strings = (times[by], (end - begin)[first[by]] - LENGTH + 1, (begin + shift[own_row])[turn])
                three = np.flatnonzero(code == 3)
                starts = _ranges(low[three], high[three] - low[three] + 1)
                other = _sums(data, _OTHER_BYTES) if len(starts) else sums
                window, same = _pairs(_hash(sums, starts, starts + LENGTH), _hash(other, starts, starts + LENGTH), return_inverse=True)
                by, e = _dealt(window["f0"], bins)
                times = np.bincount(same, minlength=len(window))
                for i in range(bins):
                    o = by[e[i]:e[i + 1]]
                    if len(o):
                        out.append((i, block, _HASHES, pack(np.ascontiguousarray(window["f0"][o]), np.ascontiguousarray(window["f1"][o]), times[o].astype(np.uint32))))
                place = np.empty(len(window), np.int64)
                place[by] = np.arange(len(window))
                turn = np.argsort(place[same], kind="stable") if len(starts) else np.zeros(0, int)
                moved = starts + np.repeat(shift[row[three]], high[three] - low[three] + 1)
                out.append((block % bins, block, _TEXTS, pack(
                    ids[own], null[own], cut, part, np.diff(edge_sizes(out, _STRINGS, bins)), np.diff(edge_sizes(out, _HASHES, bins)),
                    strings[0], strings[1], strings[2], times[by], moved[turn])))
                yield sent(out)

    return run


def edge_sizes(rows: list[tuple], kind: int, bins: int) -> np.ndarray:
    """Where each bin's entries begin among all of a kind."""
    n = np.zeros(bins + 1, np.int64)
    for i, _, k, body in rows:
        if k == kind:
            n[i + 1] = np.frombuffer(body, np.int64, 1)[0]
    return np.cumsum(n)


def _marks(batches):
    for i, got in _by_bin(batches, (_STRINGS, _HASHES)):
        if i is None:
            yield sent(got)
            continue
        if _HASHES in got:
            parts = [(block, *unpack(body, "u8", "u8", "u4")) for block, body in got[_HASHES]]
            every, inverse = _pairs(*(np.concatenate([p[j] for p in parts]) for j in (1, 2)), return_inverse=True)
            more = (np.bincount(inverse, weights=np.concatenate([p[3] for p in parts]), minlength=len(every)) > 1)[inverse]
            at = 0
            for block, hashes, _, _ in parts:
                yield sent([(i, block, _HASH_MARKS, pack(more[at:at + len(hashes)].astype(np.uint8)))])
                at += len(hashes)
        if _STRINGS in got:
            entries: dict[tuple, list] = {}
            uses = []
            number = {b: n for n, b in enumerate(sorted({block for block, _ in got[_STRINGS]}))}
            for block, body in got[_STRINGS]:
                hashes, size, times, at, text = unpack(body, "u8", "u4", "u4", "i8", "u1")
                text, cut = text.tobytes(), np.r_[0, np.cumsum(size.astype(np.int64))]
                for j in range(len(hashes)):
                    e = entries.setdefault((int(hashes[j]), text[cut[j]:cut[j + 1]]), [0, (number[block] << 32) + int(at[j])])
                    e[0] += int(times[j])
                    uses.append((block, e))
            keys = sorted(entries)
            flags = mark(np.array([k[0] for k in keys], _U), [k[1] for k in keys], np.array([entries[k][0] for k in keys]), np.array([entries[k][1] for k in keys], np.int64))
            for k, f in zip(keys, flags):
                entries[k].append(f)
            at = 0
            while at < len(uses):
                end = at
                while end < len(uses) and uses[end][0] == uses[at][0]:
                    end += 1
                yield sent([(i, uses[at][0], _MARKS, pack(np.concatenate([e[2] for _, e in uses[at:end]]).astype(np.uint8)))])
                at = end


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _last_pass(bins: int):
    def rows(body):
        ids, null, n, removed, spans, digests = unpack(body, "i8", "u1", "i8", "i8", "i8", "u1")
        text = digests.tobytes().hex()
        return pa.RecordBatch.from_arrays([
            pa.array(ids, mask=null.astype(bool)), pa.array(n), pa.array(removed), pa.array(spans),
            pa.array([text[64 * j:64 * j + 64] for j in range(len(ids))]),
        ], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    def run(batches):
        for block, got in _by_block(batches):
            for _, kind, body in got:
                if kind == _DONE:
                    yield rows(body)
            body = next((body for _, kind, body in got if kind == _TEXTS), None)
            if body is None:
                continue
            ids, null, cut, data, in_bins, hash_bins, times, windows, places, hash_times, hash_places = unpack(
                body, "i8", "u1", "i8", "u1", "i8", "i8", "i8", "i8", "i8", "i8", "i8")
            covered = np.zeros(len(data) + 1, np.int64)
            marks = {(i, kind): unpack(body, "u1")[0] for i, kind, body in got if kind in (_MARKS, _HASH_MARKS)}
            if len(times):
                flags = np.concatenate([marks[i, _MARKS] for i in range(bins) if in_bins[i]])
                begin = np.cumsum(windows) - windows  # a text's marks
                which = np.repeat(np.arange(len(times)), times)
                # every occurrence of a text takes the text's marks
                at = _ranges(begin[which], windows[which])
                starts = (_ranges(places, windows[which]))[flags[at] > 0]
                np.add.at(covered, starts, 1)
                np.add.at(covered, starts + LENGTH, -1)
            if len(hash_times):
                flags = np.concatenate([marks[i, _HASH_MARKS] for i in range(bins) if hash_bins[i]])
                starts = hash_places[np.repeat(flags > 0, hash_times)]
                np.add.at(covered, starts, 1)
                np.add.at(covered, starts + LENGTH, -1)
            yield rows(_results(ids, null, data, cut, np.cumsum(covered[:-1]) > 0))

    return run


def remove_repeats(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bins: int | None = None, frequent: int = FREQUENT, very: int = VERY_FREQUENT,
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal runs that go) and kept_sha256 of every row."""
    bins = bins or bins_for(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_first_pass(bins), SENT)
    for by, step in (("bin", _which_repeat(frequent, very)), ("block", _second_pass(bins)), ("bin", _marks)):
        rows = rows.repartition(bins, by)
        rows = (rows.sortWithinPartitions("block") if by == "block" else rows).mapInArrow(step, SENT)
    return rows.repartition(bins, "block").sortWithinPartitions("block").mapInArrow(_last_pass(bins), _RESULT)


def op1_repeats(spark, sf_dir) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
