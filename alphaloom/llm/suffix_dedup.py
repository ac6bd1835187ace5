"""Exact removal of repeated byte strings by a distributed, hash-compared suffix sort.

A byte goes if it is covered by a string of `length` bytes that also starts in a document with a
smaller id. Every such window is filed under the least hash of its 16-byte substrings, so equal
windows always meet, and windows in a row that share that key form one segment.

1. Keys are exchanged alone (6 bytes each, packed) to find those that occur in more than one
   document; what repeats within a batch of documents is settled in the batch, so a key that a
   third of all documents hold is one entry a batch.
2. Only the segments of repeated keys travel, each distinct one once a batch: its other holders in
   the batch already know a smaller document. Segments of keys that `HOT_LEAST` documents hold are cut into
   single windows, which spread by content. The threshold is fixed; which keys reach it is told by a bit table
   whose size is bounded (`HOT_BITS`): a key that shares its bit with a hot one is cut too, which costs but
   changes nothing in the result.
3. In a bucket, equal segments are merged; where a key has several different segments, their suffixes
   are sorted by a mergesort. Its comparisons find the common extension of two suffixes by binary
   search over prefix polynomial hashes, logarithmic in the length; neighbours that seem equal
   are then compared byte by byte, and a bucket with a hash collision is sorted without hashes.
4. The spans of repeated windows go back to their documents.

Defined results: null text counts as empty; a row with a null id is left as it is and removes
nothing elsewhere; rows that repeat an id, with one text or with several, don't remove each other, and each is
cut by what documents with smaller ids hold; ids may be negative; texts under `length` bytes are left as
they are; an empty table gives an empty one; other columns are ignored, or carried along on demand.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alphaloom.llm.shared import bit_slots, bit_table, materialise, pieces, release, released, squeezed, table, text_or_empty, unsqueezed

LENGTH, GRAM = 50, 16
BUCKET_BYTES = 8 << 20
#: A key is hot if so many documents hold it; bits of the table that tells the hot keys, per input byte between two bounds (2 and 32 MB).
HOT_LEAST, HOT_BITS = 2_000, (1 << 24, 1 << 28)

#: Suffixes sorted at once.
SORT_WINDOWS = 100_000

_M = 0x9E3779B97F4A7C15
_LOW48 = np.uint64((1 << 48) - 1)
_BYTE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


#: Bytes hashed at once: the work arrays of a chunk fit a core's cache.
CHUNK = 1 << 18


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each position (as many as fit), by doubling."""
    h, n = _BYTE[raw], 1
    while n < GRAM:
        t = h[:-n] * np.uint64(pow(_M, n, 1 << 64))
        t += h[n:]
        h = t
        n *= 2
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def _window_keys(raw: np.ndarray, length: int) -> np.ndarray:
    """Least gram hash of each window."""
    h, n, width = gram_hashes(raw), 1, length - GRAM + 1
    while n * 2 <= width:
        h = np.minimum(h[:-n], h[n:])
        n *= 2
    return np.minimum(h[: -(width - n)], h[width - n :]) if width > n else h


def runs(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, text number, first, last): maximal runs of windows of one text with one key; first and last are positions in the joined texts."""
    out, part, size, begun, base = [], [], 0, 0, 0
    for k, t in enumerate([*texts, None]):
        if t is None or size and size + len(t) > CHUNK:
            if size >= length:
                key, doc, first, last = _runs(part, length)
                out.append((key, doc + begun, first + base, last + base))
            begun, base, part, size = k, base + size, [], 0
        if t is not None:
            part.append(t)
            size += len(t)
    if not out:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    return tuple(np.concatenate(c) for c in zip(*out))


def _runs(texts: list[bytes], length: int):
    raw = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    counts = np.maximum(sizes - length + 1, 0)
    doc = np.repeat(np.arange(len(texts)), counts)
    at = np.arange(len(doc)) + np.repeat(ends - sizes - (np.cumsum(counts) - counts), counts)
    key = _window_keys(raw, length)[at]
    if not len(key):
        return key, doc, at, at
    cut = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])
    last = at[np.r_[cut[1:] - 1, len(at) - 1]]
    return key[cut], doc[cut], at[cut], last


def _six(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _from_six(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _deltas(x: np.ndarray) -> bytes:
    return squeezed(np.diff(x, prepend=0).astype("<i8").tobytes())


def _undeltas(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(unsqueezed(data), "<i8"))


def _small(x, kind: str = "<i4") -> bytes:
    return squeezed(np.asarray(x, kind).tobytes())


def _unsmall(data: bytes, kind: str = "<i4") -> np.ndarray:
    return np.frombuffer(unsqueezed(data), kind)


#: Where several texts share an id, the upper 32 bits of a start tell which of them it lies in.
PART = 32


def _kind(several: bool) -> str:
    return "<i8" if several else "<i4"


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (_mixed(keys ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(buckets)).astype(np.int64)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for big in batches:
        for batch in pieces(big):
            data = [squeezed(t.encode("utf-8", "surrogatepass")) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(data, pa.binary())], ["id", *batch.schema.names[2:], "packed"])


KEY_ROWS = "bucket int, keys binary, ids binary, counts binary"


def _keys(length: int, buckets: int):
    """Packed (key, id, documents) entries by bucket; documents 0: an id to be told that its key repeats, documents > 1: no answer wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in pieces(big, 2 << 20):
                ids = batch.column(0).to_numpy()
                key, doc, _, _ = runs([t.encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()], length)
                key &= _LOW48
                order = np.lexsort((ids[doc], key))
                key, idk = key[order], ids[doc][order]
                new_key = np.r_[True, key[1:] != key[:-1]][: len(key)]
                new = new_key | np.r_[True, idk[1:] != idk[:-1]][: len(key)]
                key, idk, new_key = key[new], idk[new], new_key[new]
                first = np.flatnonzero(new_key)
                docs = np.diff(np.r_[first, len(key)])
                many = np.repeat(docs > 1, docs)
                # Every distinct key once, and the repeated ones again for each holder, in any bucket.
                k = np.r_[key[first], key[many]]
                i = np.r_[idk[first], idk[many]]
                c = np.r_[docs, np.zeros(int(many.sum()), np.int64)]
                b = np.r_[_bucket(key[first], buckets), idk[many] % buckets]
                order = np.lexsort((i, b))
                k, i, c, b = k[order], i[order], c[order], b[order]
                cuts = np.flatnonzero(np.r_[True, b[1:] != b[:-1]][: len(b)])
                rows = [(int(b[s]), _six(k[s:e]), _deltas(i[s:e]), squeezed(c[s:e].astype("<i4").tobytes())) for s, e in zip(cuts, [*cuts[1:], len(b)])]
                cols = list(zip(*rows)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]], ["bucket", "keys", "ids", "counts"])

    return run


def _repeated(_, tbl):
    """(id, key, documents): holders of repeated keys with documents 0, and without an id the keys that many documents hold."""
    k = np.concatenate([_from_six(b) for b in tbl.column("keys").to_pylist()] or [np.zeros(0, np.uint64)])
    i = np.concatenate([_undeltas(b) for b in tbl.column("ids").to_pylist()] or [np.zeros(0, np.int64)])
    c = np.concatenate([np.frombuffer(unsqueezed(b), "<i4") for b in tbl.column("counts").to_pylist()] or [np.zeros(0, np.int32)]).astype(np.int64)
    told = c == 0
    out_i, out_k = [i[told]], [k[told]]
    k, i, c = k[~told], i[~told], c[~told]
    order = np.argsort(k, kind="stable")
    k, i, c = k[order], i[order], c[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]][: len(k)])
    total = np.add.reduceat(c, first) if len(first) else c
    size = np.diff(np.r_[first, len(k)])
    yes = np.repeat(total > 1, size) & (c == 1)
    hot = total >= HOT_LEAST
    out_i += [i[yes], np.zeros(int(hot.sum()), np.int64)]
    out_k += [k[yes], k[first][hot]]
    n = np.r_[np.zeros(sum(map(len, out_i[:2])), np.int64), total[hot]]
    return pa.table({"id": pa.array(np.concatenate(out_i), pa.int64(), mask=n > 0), "key": pa.array(np.concatenate(out_k).astype(np.int64)), "docs": pa.array(n, pa.int64())})


SEGMENT_ROWS = "bucket int, texts binary, sizes binary, ids binary, starts binary, keys binary"


def _segments(length: int, buckets: int, hot_bits: np.ndarray, several: bool):
    """Distinct segments of repeated keys by bucket. A row without texts holds spans already known to be repeated."""
    kind = _kind(several)

    def is_hot(low: np.ndarray) -> np.ndarray:
        slot = bit_slots(low, len(hot_bits) * 8)
        return hot_bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1 == 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in pieces(big, 1 << 20, "packed"):
                all_ids, all_parts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                texts = [unsqueezed(p) for p in batch.column(2).to_pylist()]
                told = batch.column(3)
                key, doc, first, last = runs(texts, length)
                low = key & _LOW48
                # Which (document, key) pairs were told to repeat: documents are few, so 48 + 16 bits hold both.
                lens = np.diff(told.offsets.to_numpy())
                flags = (np.repeat(np.arange(len(texts), dtype=np.uint64), lens) << np.uint64(48)) ^ told.flatten().to_numpy().view(np.uint64)
                mine = (doc.astype(np.uint64) << np.uint64(48)) ^ low
                yes = np.isin(mine, flags)
                key, low, doc, first, last = key[yes], low[yes], doc[yes], first[yes], last[yes]
                joined = b"".join(texts)
                base = np.r_[0, np.cumsum([len(t) for t in texts])]
                windows = is_hot(low)
                known: dict[bytes, tuple[int, int, int]] = {}
                spans: list[tuple[int, int, int]] = []

                def meet(seg: bytes, i: int, start: int, k: int) -> None:
                    at = known.setdefault(seg, told_by := (i, start, k))
                    if at is told_by:
                        return
                    if i > at[0]:
                        spans.append((i, start, len(seg)))
                    elif i < at[0]:
                        spans.append((at[0], at[1], len(seg)))
                        known[seg] = told_by
                        for other in more.pop(seg, []):
                            spans.append((at[0], other, len(seg)))
                    else:
                        more.setdefault(seg, []).append(start)

                more: dict[bytes, list[int]] = {}
                begun = first - base[doc]
                if several:
                    begun = begun + (all_parts[doc].astype(np.int64) << PART)
                for k, i, a, z, start, cut in zip(key.tolist(), all_ids[doc].tolist(), first.tolist(), (last + length).tolist(), begun.tolist(), windows.tolist()):
                    if cut:
                        for w in range(z - a - length + 1):
                            meet(joined[a + w : a + w + length], i, start + w, k)
                    elif known.setdefault(seg := joined[a:z], here := (i, start, k)) is not here:
                        meet(seg, i, start, k)
                segs, at = list(known), list(known.values())
                for seg, starts in more.items():
                    segs += [seg] * len(starts)
                    at += [(known[seg][0], p, known[seg][2]) for p in starts]
                out = []
                if spans:
                    i, p, n = (np.array(c, np.int64) for c in zip(*spans))
                    order = np.lexsort((p, i))
                    out.append((int(i[0] % buckets), None, _small(n[order]), _deltas(i[order]), _small(p[order], kind), b""))
                if segs:
                    held, begun, keys = (np.array(c, t) for c, t in zip(zip(*at), (np.int64, np.int64, np.uint64)))
                    sizes = np.array([len(x) for x in segs])
                    single = is_hot(keys & _LOW48)
                    if single.any():  # windows of hot keys go by their content
                        for j in np.flatnonzero(single):
                            keys[j] = int.from_bytes(hashlib.blake2b(segs[j], digest_size=8).digest(), "little")
                    b = _bucket(keys, buckets)
                    order = np.lexsort((begun, held, b))
                    cuts = np.flatnonzero(np.r_[True, b[order][1:] != b[order][:-1]])
                    for s, e in zip(cuts, [*cuts[1:], len(order)]):
                        part = order[s:e]
                        # Of a key 32 bits are enough: keys that agree in them are sorted together, no more.
                        out.append((
                            int(b[order[s]]), squeezed(b"".join([segs[j] for j in part.tolist()]), tight=True), _small(sizes[part]), _deltas(held[part]),
                            _small(begun[part], kind), keys[part].astype("<u4").tobytes()))
                cols = list(zip(*out)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]], ["bucket", "texts", "sizes", "ids", "starts", "keys"])

    return run


class Suffixes:
    """Suffixes of a text, compared over at most `length` bytes through prefix polynomial hashes."""

    def __init__(self, text: bytes, length: int):
        self.raw = np.frombuffer(text + b"\0" * length, np.uint8)
        self.length = length
        # Prefix sums of byte * base^i; two substrings are equal if their sums agree after scaling to a common power.
        n = len(self.raw)
        self.power = np.cumprod(np.r_[np.uint64(1), np.full(n, np.uint64(_M))])
        self.sums = np.r_[np.uint64(0), np.cumsum((self.raw.astype(np.uint64) + np.uint64(1)) * self.power[:-1])]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffix pairs, by binary search."""
        got = np.zeros(len(a), np.int64)
        pa_, pb, sa, sb = self.power[a], self.power[b], self.sums[a], self.sums[b]
        step = 1 << (self.length.bit_length() - 1)
        while step:
            to = np.minimum(got + step, self.length)
            x, y = self.sums[a + to], self.sums[b + to]
            x -= sa
            y -= sb
            x *= pb
            y *= pa_
            np.copyto(got, to, where=x == y)
            step >>= 1
        return got

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether suffix pairs agree over `length` bytes, by one comparison of hashes."""
        n = self.length
        return (self.sums[a + n] - self.sums[a]) * self.power[b] == (self.sums[b + n] - self.sums[b]) * self.power[a]

    def before(self, a: np.ndarray, b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Whether suffix a sorts before b (or is equal, where or_equal)."""
        out = or_equal.copy()
        other = np.flatnonzero(~self.same(a, b))
        a, b = a[other], b[other]
        n = self.common(a, b)
        # Hashes that differ over `length` bytes differ at a byte before its end, or the search was misled and the last byte decides.
        at = np.minimum(n, self.length - 1)
        out[other] = self.raw[a + at] < self.raw[b + at]
        return out

    def sort(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Order of suffixes `at` within ascending groups: a bottom-up mergesort of all groups at once.

        In each round every element finds its rank in the neighbouring run by binary search.
        """
        order = np.arange(len(at))
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]][: len(group)])
        size = np.diff(np.r_[first, len(group)])
        start, size = np.repeat(first, size), np.repeat(size, size)
        width = 1
        while (size > width).any():
            live = np.flatnonzero(size > width)
            place = live - start[live]
            run = place // width
            right = run % 2 == 1
            pair = start[live] + (run - right) * width
            stop = start[live] + size[live]
            lo = np.where(right, pair, np.minimum(pair + width, stop))
            hi = np.where(right, pair + width, np.minimum(pair + 2 * width, stop))
            base, me = lo.copy(), at[order[live]]
            while (open_ := np.flatnonzero(lo < hi)).size:
                mid = (lo[open_] + hi[open_]) // 2
                # A right element goes after equal ones of the left run, a left element before equal ones of the right.
                less = self.before(at[order[mid]], me[open_], right[open_])
                lo[open_[less]] = mid[less] + 1
                hi[open_[~less]] = mid[~less]
            to = pair + place % width + (lo - base)
            new = order.copy()
            new[to] = order[live]
            order = new
            width *= 2
        return order

    def hashes(self, at: np.ndarray) -> np.ndarray:
        """A hash of `length` bytes from each position."""
        inverse = np.full(len(self.raw), np.uint64(pow(_M, -1, 1 << 64)))
        inverse[0] = 1
        np.cumprod(inverse, out=inverse)
        return (self.sums[at + self.length] - self.sums[at]) * inverse[at]

    def verify(self, a: np.ndarray, b: np.ndarray) -> None:
        """ValueError if some pair of suffixes that hashes call equal isn't, over `length` bytes."""
        span = np.arange(self.length)
        for k in range(0, len(a), 1 << 16):
            x, y = a[k : k + (1 << 16)], b[k : k + (1 << 16)]
            other = x != y
            if (self.raw[x[other][:, None] + span] != self.raw[y[other][:, None] + span]).any():
                raise ValueError("hash collision")

    def equal_neighbours(self, at: np.ndarray) -> np.ndarray:
        """For suffixes in order: whether each equals the one before it; ValueError if hashes say so and bytes don't."""
        out = np.zeros(len(at), bool)
        if len(at) > 1:
            out[1:] = self.same(at[:-1], at[1:])
        pairs = np.flatnonzero(out)
        self.verify(at[pairs - 1], at[pairs])
        return out


def repeated_windows(segments: list[bytes], owner: np.ndarray, group: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each segment the offsets of its windows that a segment of the same group with a smaller owner holds."""
    which, offsets = _window_hits(segments, owner, group, length)
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(segments)
    cuts = np.flatnonzero(np.r_[True, which[1:] != which[:-1]][: len(which)])
    for a, b in zip(cuts, [*cuts[1:], len(which)]):
        out[which[a]] = offsets[a:b]
    return out


def _window_hits(segments: list[bytes], owner: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment number, offset) of those windows: those of a segment lie together, offsets ascending."""
    order = np.argsort(group, kind="stable")
    sizes = np.array([len(segments[j]) for j in order])
    text = b"".join(segments[j] for j in order)
    base = np.cumsum(sizes) - sizes
    counts = sizes - length + 1
    seg = np.repeat(np.arange(len(order), dtype=np.int32), counts)
    at = np.arange(len(seg)) - np.repeat(np.cumsum(counts) - counts, counts) + base[seg]
    own = owner[order]
    try:
        hit = _sorted_hits(text, at, seg, own, group[order], base, sizes, length)
    except ValueError:  # a hash collision: without hashes
        least: dict[bytes, int] = {}
        for a, j in zip(at.tolist(), seg.tolist()):
            w = text[a : a + length]
            least[w] = min(least.get(w, own[j]), own[j])
        hit = np.array([k for k, (a, j) in enumerate(zip(at.tolist(), seg.tolist())) if least[text[a : a + length]] < own[j]], np.int64)
    hit = np.sort(hit)  # windows are numbered by segment and place
    return order[seg[hit]], at[hit] - base[seg[hit]]


def _sorted_hits(text: bytes, at: np.ndarray, seg: np.ndarray, own: np.ndarray, group: np.ndarray, base: np.ndarray, sizes: np.ndarray, length: int) -> np.ndarray:
    """Numbers of the windows that a segment with a smaller owner holds too; ValueError at a hash collision.

    A window whose hash no other window has is repeated nowhere and isn't sorted; that is told by counts in slots, and sharing a slot costs work, not correctness.
    A group of one key can hold any number of windows (long texts that repeat one word or line). Beyond SORT_WINDOWS, windows of one owner with
    equal hashes are told by one of them, after their bytes have been compared, and what is left is sorted in classes of the
    window's hash; equal windows are always in one class, so this bounds the work arrays and changes no result.
    """
    s = Suffixes(text, length)
    raw = np.frombuffer(text, np.uint8)
    # Equal windows hold their key's first occurrence at one place, so only suffixes with that distance to it are sorted together.
    h = np.concatenate([gram_hashes(raw), np.full(GRAM - 1, np.uint64((1 << 64) - 1))])
    for k in range(1, GRAM):  # grams that reach into the next segment are none
        h[base + sizes - k] = np.uint64((1 << 64) - 1)
    is_key = np.flatnonzero(h == np.repeat(np.minimum.reduceat(h, base), sizes))
    del h

    def hits(some: np.ndarray) -> np.ndarray:
        here, mine = at[some], own[seg[some]]
        distance = is_key[np.minimum(np.searchsorted(is_key, here), len(is_key) - 1)] - here
        _, grp = np.unique(group[seg[some]].astype(np.int64) * 4096 + np.clip(distance, 0, 4095), return_inverse=True)
        by = np.argsort(grp, kind="stable")
        some, here, mine, grp = some[by], here[by], mine[by], grp[by]
        rank = s.sort(here, grp)
        equal = s.equal_neighbours(here[rank])
        equal[1:] &= grp[rank][1:] == grp[rank][:-1]
        first = np.flatnonzero(~equal)
        least = np.repeat(np.minimum.reduceat(mine[rank], first), np.diff(np.r_[first, len(rank)]))
        return some[rank[least < mine[rank]]]

    told = s.hashes(at)
    slot = (_mixed(told) >> np.uint64(64 - max(16, (4 * len(at)).bit_length()))).astype(np.int64)
    every = np.flatnonzero(np.bincount(slot)[slot] > 1)
    if len(every) <= SORT_WINDOWS:
        return hits(every) if len(every) else every
    told = told[every]
    by = np.lexsort((own[seg[every]], told))
    told, by = told[by], every[by]
    new = np.r_[True, (told[1:] != told[:-1]) | (own[seg[by[1:]]] != own[seg[by[:-1]]])]
    of = np.cumsum(new) - 1
    single = by[new]
    s.verify(at[by], at[single[of]])
    parts = -(-len(single) // SORT_WINDOWS)
    of_class = (_mixed(told[new]) % np.uint64(parts)).astype(np.int64)
    flagged = np.zeros(len(at), bool)
    for k in range(parts):
        flagged[hits(single[of_class == k])] = True
    return by[flagged[single][of]]


def _spans(length: int, several: bool):
    kind = _kind(several)

    def run(_, tbl):
        out_i, out_s, out_n = [], [], []
        known: dict[bytes, int] = {}
        numbers: list[int] = []
        docs, begun, of_key = [], [], []
        for texts, sizes, ids, starts, keys in zip(*(tbl.column(c).to_pylist() for c in ("texts", "sizes", "ids", "starts", "keys"))):
            n, i, p = _unsmall(sizes), _undeltas(ids), _unsmall(starts, kind)
            if texts is None:
                for x, c in zip((out_i, out_s, out_n), (i, p, n)):
                    x.append(c.astype(np.int64))
                continue
            text, end = unsqueezed(texts), np.cumsum(n, dtype=np.int64)
            numbers += [known.setdefault(text[a:z], len(known)) for a, z in zip((end - n).tolist(), end.tolist())]
            for x, c in zip((docs, begun, of_key), (i, p.astype(np.int64), np.frombuffer(keys, "<u4"))):
                x.append(c)
        # One entry for each holder of a segment, by segment; a segment belongs to its least holder.
        flat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        segments, which = list(known), np.array(numbers, np.int64)
        known.clear()
        by = np.argsort(which, kind="stable")
        which, doc, start = which[by], flat(docs)[by], flat(begun)[by]
        first = np.flatnonzero(np.r_[True, which[1:] != which[:-1]][: len(which)])
        size = np.array([len(x) for x in segments], np.int64)
        owner = np.minimum.reduceat(doc, first) if len(first) else doc
        copies = doc > owner[which]
        for x, c in zip((out_i, out_s, out_n), (doc[copies], start[copies], size[which[copies]])):
            x.append(c)
        which, doc, start = which[~copies], doc[~copies], start[~copies]
        entry = np.searchsorted(which, np.arange(len(segments) + 1))
        group = flat(of_key)[by][first]
        _, number, count = np.unique(group, return_inverse=True, return_counts=True) if len(group) else (None, np.zeros(0, np.int64), np.zeros(0, np.int64))
        several = np.flatnonzero(count[number] > 1) if len(group) else np.zeros(0, np.int64)
        several = several[np.argsort(number[several], kind="stable")]
        # Whole groups of about SORT_WINDOWS suffixes at a time bound the work arrays.
        done = np.cumsum(size[several] - length + 1) // SORT_WINDOWS
        cuts = np.flatnonzero(np.r_[True, (done[1:] != done[:-1])][: len(several)])
        cuts = sorted({int(np.searchsorted(number[several], number[several[c]])) for c in cuts})
        for a, z in zip(cuts, [*cuts[1:], len(several)]):
            part = several[a:z]
            seg, offset = _window_hits([segments[j] for j in part], owner[part], number[part], length)
            new = np.r_[True, (seg[1:] != seg[:-1]) | (offset[1:] != offset[:-1] + 1)][: len(seg)]
            last = np.r_[np.flatnonzero(new)[1:], len(seg)][: int(new.sum())] - 1
            j, at, end = part[seg[new]], offset[new], offset[last] + length
            # Each span for each place where the segment's owner holds it.
            times = entry[j + 1] - entry[j]
            e = np.repeat(entry[j] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
            for x, c in zip((out_i, out_s, out_n), (doc[e], start[e] + np.repeat(at, times), np.repeat(end - at, times))):
                x.append(c)
        starts = flat(out_s)
        del segments
        release()
        return pa.table({"id": pa.array(flat(out_i), pa.int64()), "part": pa.array(starts >> PART, pa.int32()), "start": pa.array(starts & ((1 << PART) - 1), pa.int32()), "size": pa.array(flat(out_n), pa.int32())})

    return run


#: Bytes of text cut at once.
CUT_BYTES = 1 << 20


def without_spans(texts: list[bytes], doc: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(bytes removed, maximal runs removed, bytes left) of each text; spans are (text number, start, size), in any order, and may overlap."""
    sizes = np.array([len(t) for t in texts], np.int64)
    end = np.cumsum(sizes)
    base = end - sizes
    data = np.frombuffer(b"".join(texts), np.uint8)
    edge = np.zeros(len(data) + 1, np.int32)
    np.add.at(edge, base[doc] + start, 1)
    np.add.at(edge, base[doc] + start + size, -1)
    gone = np.cumsum(edge[:-1], dtype=np.int32) > 0
    before = np.zeros(len(data), bool)
    before[1:] = gone[:-1]
    before[base[sizes > 0]] = False
    count = lambda flags: np.concatenate([[0], np.cumsum(flags)])
    removed, begun = count(gone), count(gone & ~before)
    left, kept = data[~gone].tobytes(), np.arange(len(data) + 1) - removed
    cuts = zip(kept[base].tolist(), kept[end].tolist())
    return removed[end] - removed[base], begun[end] - begun[base], [left[a:z] for a, z in cuts]


def _apply(keep_text: bool):
    def rows(ids: pa.Array, carried: list[pa.Array], texts: list[bytes], doc: np.ndarray, start: np.ndarray, size: np.ndarray, names: list[str]) -> pa.RecordBatch:
        removed, begun, left = without_spans(texts, doc, start, size)
        kept = [x.decode("utf-8", "ignore") for x in left] if keep_text else [hashlib.sha256(x).hexdigest() for x in left]
        cols = [ids, pa.array([len(t) for t in texts], pa.int64()), pa.array(removed, pa.int64()), pa.array(begun, pa.int64()), pa.array(kept, pa.string())]
        return pa.RecordBatch.from_arrays([*cols, *carried], ["id", "n_bytes", "n_removed", "n_spans", "kept", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in pieces(big, 1 << 20, "packed"):
                ids, spans, carried, names = batch.column(0), batch.column(2), batch.columns[3:], batch.schema.names[3:]
                flat = spans.flatten()
                start, size = (flat.field(k).to_numpy().astype(np.int64) for k in ("start", "size"))
                lens = spans.value_lengths().fill_null(0).to_numpy().astype(np.int64)
                at = np.concatenate([[0], np.cumsum(lens)])
                texts, begun, total = [], 0, 0
                for k, packed in enumerate(batch.column(1).to_pylist(), 1):
                    texts.append(unsqueezed(packed))
                    total += len(texts[-1])
                    if total >= CUT_BYTES or k == batch.num_rows:
                        part = slice(at[begun], at[k])
                        own = [c.slice(begun, k - begun) for c in carried]
                        yield rows(ids.slice(begun, k - begun), own, texts, np.repeat(np.arange(k - begun), lens[begun:k]), start[part], size[part], names)
                        texts, begun, total = [], k, 0

    return run


def remove_repeats(df: DataFrame, length: int = LENGTH, keep_text: bool = True, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept) for every row; kept is the text left (bytes of a cut character are dropped), or the SHA-256 of the bytes left. Columns to carry come after these, under their names."""
    other = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(carry)]
    docs = df.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"), *other)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields[2:]}
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(max(16, total // BUCKET_BYTES))
    # Texts of one id are told apart by a hash; usually no id repeats, which the ids alone tell.
    several = bool(docs.groupBy("id").count().where("id is not null and count > 1").limit(1).count())
    part = F.pmod(F.xxhash64("text"), F.lit((1 << 31) - 1)).cast("int") if several else F.lit(0)
    docs = docs.select("id", "text", part.alias("part"), *kinds)
    with_id = docs.where("id is not null")
    repeated = materialise(with_id.select("id", "text").mapInArrow(released(_keys(length, buckets)), KEY_ROWS).groupBy("bucket").applyInArrow(_repeated, "id long, key long, docs long"), "keys")
    hot = bit_table(repeated.where("docs > 0").select("key"), min(HOT_BITS[1], max(HOT_BITS[0], 1 << (total // 64).bit_length())))
    told = repeated.where("docs = 0").groupBy("id").agg(F.collect_list("key").alias("keys"))
    more = "".join(f", {n} {k}" for n, k in kinds.items())
    packed = docs.mapInArrow(released(_pack), f"id long, part int{more}, packed binary").where("id is not null")  # both joins read one exchange of it
    found = packed.join(told.hint("merge"), "id").select("id", "part", "packed", "keys").mapInArrow(released(_segments(length, buckets, hot, several)), SEGMENT_ROWS)
    spans = found.groupBy("bucket").applyInArrow(_spans(length, several), "id long, part int, start int, size int")
    each = spans.groupBy("id", "part").agg(F.collect_list(F.struct("start", "size")).alias("spans")).withColumnRenamed("part", "of")
    both = packed.join(each.withColumnRenamed("id", "its").hint("merge"), (F.col("id") == F.col("its")) & (F.col("part") == F.col("of")), "left").select("id", "packed", "spans", *kinds)
    out = both.mapInArrow(released(_apply(keep_text)), f"id long, n_bytes long, n_removed long, n_spans long, kept string{more}")
    # Rows without an id need no Python: they stay as they are.
    kept = F.col("text") if keep_text else F.sha2(F.col("text").cast("binary"), 256)
    none = F.lit(0).cast("long")
    out = out.unionByName(docs.where("id is null").select("id", F.octet_length("text").cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), kept.alias("kept"), *kinds))
    return out.select("id", "n_bytes", "n_removed", "n_spans", "kept", *[F.col(k).alias(c) for k, c in zip(kinds, carry)])


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), keep_text=False).withColumnsRenamed({"id": "doc_id", "kept": "kept_sha256"})
