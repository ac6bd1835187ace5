"""Exact Jaccard self-join of documents on word shingles, and its connected components.

Two documents link when their sets of distinct shingles have |A & B| * 100 >= 90 * |A | B|.

1. A first pass counts, in a hashed table of bounded size, in how many documents each shingle
   occurs. The counts only order the shingles (rare ones first); any order is correct.
2. A second pass keeps of each document its set size, a 128-bit fingerprint of the set, its
   prefix (the rarest n - ceil(0.9 n) + 1 shingles: documents that link share one of theirs)
   and a few minimum hashes. Documents with equal sets form a class with one representative.
3. Representatives that share a minimum hash are compared with the smallest of them: one
   comparison each, which already joins most near copies, however large their group is.
4. Representatives that share a prefix shingle, fit by size and position and aren't in one
   component yet are compared if their prefixes share as many shingles as the overlap needs
   (the whole prefixes are compared; only the first shared shingle must leave room for the
   whole overlap). Shingles that only one component holds are left out before they are
   joined, and pairs within a component add nothing; no link between components is lost.
5. Comparing is a T-occurrence search: the shingles of a query document are inverted lists
   over its candidates; the short ones are merged by a heap, the long ones probed by binary
   search (DivideSkip), and candidates that reach the required overlap are retained.

Hot keys: shingles meet in an equi-join that Spark splits where a shingle is hot; a
query with many candidates is cut into blocks; class members meet representatives through an
equi-join of the same kind. Nothing but the count table and the bit table of wanted ids reaches the driver.

Shingles are told apart by 64-bit hashes and equal sets by 128 bits: "exact" holds but for a
collision of these, which no text of a corpus meets by chance (2^-64 a pair of shingles).

Defined results (near_components; one_of_each says how it treats unclear ids): null text counts as empty; rows that share an id should share their text, else links
of either may be found under it; a null id takes part in its class but names nothing; a text without words has the empty set and
links with nothing (its component is itself); under `width` words the whole sequence is the one
shingle; rows that repeat (and equal texts) are one class; an empty table gives an empty one; other
columns are ignored.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alphaloom.llm.shared import bit_slots, bit_table, components, materialise, pieces, released, squeezed, table, text_or_empty, unsqueezed

WIDTH, PERCENT = 3, 90
#: Counters by the bytes of all texts, between two bounds; parts in which they are added up.
COUNTERS, CHUNKS = (1 << 20, 1 << 24), 64
#: Bits of the table that tells which documents a comparison may need, by their number, between two bounds (2 and 64 MB).
FILTER_BITS = (1 << 24, 1 << 29)
MINIMA = 4
#: Bytes of text hashed at once (a text is never cut).
BATCH_BYTES = 1 << 19
#: Most candidates in one block of a query.
BLOCK = 64

_M = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mixed(h: np.ndarray, salt: int = 0) -> np.ndarray:
    h = (h + np.uint64(salt * 0x632BE59BD9B4E019 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """1, base, base^2, ... base^n."""
    out = np.full(n + 1, base)
    out[0] = 1
    return np.cumprod(out, out=out)


def _sums_at(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of values from each start to its end; overwrites values."""
    np.cumsum(values, out=values)
    return values[ends - 1] - np.where(starts > 0, values[starts - 1], np.uint64(0))


def shingle_sets(texts: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text, hashed from the bytes of a whole batch at once."""
    joined = b"\n".join(texts) + b"\n"
    raw = _LOWER[np.frombuffer(joined, np.uint8)]
    word = ~_SEPARATOR[raw]
    starts = np.flatnonzero(word & ~np.r_[False, word[:-1]])
    ends = np.flatnonzero(word[:-1] & ~word[1:]) + 1
    cuts = np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in texts])).tolist()
    if not len(starts):
        return [np.zeros(0, np.uint64)] * len(texts)
    # At most two arrays of 8 bytes a byte of text at a time: sums of byte * base^i, then the inverse powers at the words' starts.
    total = _powers(_M, len(raw))
    total[:-1] *= raw
    total[:-1] += _powers(_M, len(raw))[:-1]
    total = _sums_at(total[:-1], starts, ends)
    words = _mixed(total * _powers(_INVERSE, len(raw))[starts] + (ends - starts).astype(np.uint64))
    grams = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        grams = _mixed(grams + words[k : k + len(grams)], k + 1)
    out = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b - a >= width:
            out.append(np.unique(grams[a : b - width + 1]))
        elif b > a:
            h = np.zeros(1, np.uint64)
            for k in range(a, b):
                h = _mixed(h + words[k], 101 + k - a)
            out.append(_mixed(h, 7 + b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _bytes(col: pa.Array) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for t in col.to_pylist()]


def _count(width: int, counters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        counts = np.zeros(counters, np.uint32)
        for big in batches:
            for batch in pieces(big, BATCH_BYTES):
                sets = shingle_sets(_bytes(batch.column(0)), width)
                np.add.at(counts, (np.concatenate(sets) & np.uint64(counters - 1)).astype(np.int64), 1)
        ctx = TaskContext.get()
        part = ctx.partitionId() if ctx else 0
        rows = [squeezed(c.tobytes()) for c in np.split(counts, CHUNKS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([part % 64] * CHUNKS, pa.int32()), pa.array(rows, pa.binary())], ["chunk", "salt", "counts"])

    return run


def _sum_counts(key, tbl):
    total = 0
    for b in tbl.column("counts").to_pylist():
        total = total + np.frombuffer(unsqueezed(b), np.uint32).astype(np.uint64)
    total = np.minimum(total, (1 << 32) - 1).astype(np.uint32)
    return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "salt": pa.array([0], pa.int32()), "counts": pa.array([squeezed(total.tobytes())], pa.binary())})


def frequency_classes(df: DataFrame, width: int = WIDTH, text_col: str = "text") -> np.ndarray:
    """For each counter the order of magnitude of its count; a table between two fixed sizes (1 and 16 MB)."""
    size = df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    counters = min(COUNTERS[1], max(COUNTERS[0], 1 << (size // 1024).bit_length()))
    kind = "chunk int, salt int, counts binary"
    parts = df.select(text_or_empty(text_col).alias("text")).mapInArrow(released(_count(width, counters)), kind)
    rows = parts.groupBy("chunk", "salt").applyInArrow(_sum_counts, kind).groupBy("chunk").applyInArrow(_sum_counts, kind).collect()
    out = np.zeros(counters, np.uint8)
    for r in rows:
        c = np.frombuffer(unsqueezed(bytes(r["counts"])), np.uint32)
        out[r["chunk"] * len(c) : (r["chunk"] + 1) * len(c)] = np.round(4 * np.log2(c.astype(np.float64) + 1))
    return out


def _least_overlap(n, percent: int):
    """ceil(percent * n / 100): what a set must share with one no larger than itself."""
    return (percent * n + 99) // 100


def _required(a, b, percent: int):
    """Least |A & B| for sets of a and b shingles to link: 100 i >= p (a + b - i)."""
    return (percent * (a + b) + 99 + percent) // (100 + percent)


def _sketch(width: int, percent: int, classes: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in pieces(big, BATCH_BYTES):
                n, fp1, fp2, prefix, least = [], [], [], [], []
                for s in shingle_sets(_bytes(batch.column(1)), width):
                    n.append(len(s))
                    fp1.append(_mixed(s, 11).sum(dtype=np.uint64).astype(np.int64))
                    fp2.append(_mixed(s, 12).sum(dtype=np.uint64).astype(np.int64))
                    if not len(s):
                        prefix.append([])
                        least.append([])
                        continue
                    keep = len(s) - _least_overlap(len(s), percent) + 1
                    rank = classes[(s & np.uint64(len(classes) - 1)).astype(np.int64)]
                    prefix.append(s[np.lexsort((s, rank))[:keep]].view(np.int64))
                    least.append([_mixed(s, 21 + k).min().astype(np.int64) for k in range(MINIMA)])
                longs = lambda x: pa.array(x, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n, pa.int64()), pa.array(fp1, pa.int64()), pa.array(fp2, pa.int64()), longs(prefix), longs(least)],
                    ["id", "n", "fp1", "fp2", "prefix", "least"])

    return run


def t_occurrence(query: np.ndarray, candidates: list[np.ndarray], least: list[int], mu: float = 0.01) -> list[bool]:
    """Which candidates share at least `least` elements with the query.

    The query's elements are inverted lists of candidate numbers. With T the smallest requirement,
    the L = T / (mu log2 M + 1) longest lists are set aside (M: the longest); a candidate of the result
    occurs at least T - L times in the others, which a heap merges; for those few, the long lists are probed.
    """
    if not candidates:
        return []
    hits = np.concatenate([np.full(len(c), k) for k, c in enumerate(candidates)])
    values = np.concatenate(candidates)
    place = np.searchsorted(query, values)
    place[place == len(query)] = 0
    ok = query[place] == values if len(query) else np.zeros(len(values), bool)
    place, hits = place[ok], hits[ok]
    order = np.lexsort((hits, place))
    place, hits = place[order], hits[order]
    cuts = np.flatnonzero(np.r_[True, np.diff(place) > 0]) if len(place) else []
    lists = [x.tolist() for x in np.split(hits, cuts[1:])] if len(place) else []
    lists.sort(key=len, reverse=True)
    need = max(1, min(least))
    n_long = min(len(lists), int(need / (mu * log2(len(lists[0]) + 1) + 1)), need - 1) if lists else 0
    long, short = lists[:n_long], lists[n_long:]
    found = dict.fromkeys(range(len(candidates)), 0) if not short else {}
    last, count = None, 0
    for k in heapq.merge(*short):
        if k != last:
            if last is not None and count >= need - n_long:
                found[last] = count
            last, count = k, 0
        count += 1
    if last is not None and count >= need - n_long:
        found[last] = count
    out = [False] * len(candidates)
    for k, count in found.items():
        for i, x in enumerate(long):
            if count + len(long) - i < least[k]:
                break
            j = bisect_left(x, k)
            count += j < len(x) and x[j] == k
        out[k] = count >= least[k]
    return out


def _compare(width: int, percent: int):
    def run(key, tbl):
        ids, packed = tbl.column("id").to_pylist(), tbl.column("packed").to_pylist()
        a = key[0].as_py()
        sets, begun, texts = {}, 0, []
        for k, p in enumerate(packed, 1):  # a few texts at a time, as they may be long
            texts.append(unsqueezed(p))
            if sum(map(len, texts)) >= BATCH_BYTES or k == len(packed):
                sets.update(zip(ids[begun:k], shingle_sets(texts, width)))
                begun, texts = k, []
        query = sets.pop(a, np.zeros(0, np.uint64))
        others = sorted(sets)
        linked = t_occurrence(query, [sets[b] for b in others], [int(_required(len(query), len(sets[b]), percent)) for b in others])
        found = [b for b, yes in zip(others, linked) if yes]
        return pa.table({"a": pa.array([a] * len(found), pa.int64()), "b": pa.array(found, pa.int64())})

    return run


def _pack(bits: np.ndarray):
    """Compressed texts of the rows whose id is set in the table; a join takes out the few others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in pieces(big):
                slot = bit_slots(batch.column(0).to_numpy(), len(bits) * 8)
                batch = batch.filter(pa.array(bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1 == 1))
                packed = [squeezed(t) for t in _bytes(batch.column(1))]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["id", "packed"])

    return run


def linked_pairs(pairs: DataFrame, texts: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Those of the (a, b) pairs whose documents link. texts: (id, text) with one row for each id in pairs."""
    pairs = materialise(pairs, "pairs")  # read several times below
    many = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("k"))
    size = min(FILTER_BITS[1], max(FILTER_BITS[0], 1 << (16 * pairs.count()).bit_length()))
    blocks = pairs.join(many, "a").select("a", F.pmod(F.xxhash64("b"), F.ceil(F.col("k") / BLOCK)).alias("block"), F.col("b").alias("id"))
    wanted = blocks.union(blocks.select("a", "block", F.col("a").alias("id")).distinct())
    bits = bit_table(pairs.select(F.explode(F.array("a", "b")).alias("id")), size)
    packed = texts.where("id is not null").mapInArrow(released(_pack(bits)), "id long, packed binary")
    return wanted.join(packed, "id").groupBy("a", "block").applyInArrow(_compare(width, percent), "a long, b long")


def near_components(df: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id): component_id is the smallest id that links reach."""
    docs = df.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    classes = frequency_classes(df, width, text_col)
    kind = "id long, n long, fp1 long, fp2 long, prefix array<long>, least array<long>"
    sketch = materialise(docs.mapInArrow(released(_sketch(width, percent, classes)), kind), "sketch")
    reps = materialise(sketch.where("n > 0").groupBy("fp1", "fp2", "n").agg(F.min("id").alias("rep")).where("rep is not null"), "classes")
    own = materialise(sketch.join(reps.select(F.col("rep").alias("id")), "id", "left_semi").where("n > 0").dropDuplicates(["id"]), "representatives")

    def size_fits(a: str, b: str):
        return (100 * F.least(a, b) >= percent * F.greatest(a, b))

    # Near copies through minimum hashes: each with the smallest of its group.
    mins = own.select(F.col("id"), F.col("n"), F.posexplode("least").alias("k", "h"))
    heads = mins.groupBy("k", "h").agg(F.min(F.struct("id", "n")).alias("head"), F.count(F.lit(1)).alias("many")).where("many > 1")
    star = mins.join(heads, ["k", "h"]).where(F.col("head.id") < F.col("id")).where(size_fits("head.n", "n")).select(F.col("head.id").alias("a"), F.col("id").alias("b")).distinct()
    first = materialise(linked_pairs(star, docs, width, percent), "links")
    joined = components(first)
    # What shares a prefix shingle across components, with room left for the required overlap.
    tagged = own.join(joined.withColumnRenamed("node", "id"), "id", "left").select("id", "n", F.coalesce("component", "id").alias("c"), F.posexplode("prefix").alias("p", "t"))
    # A shingle that one component alone holds can link nothing new; the count combines before its shuffle, which is the one that the join needs anyway.
    spread = tagged.groupBy("t").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("t")
    tagged = materialise(tagged.join(spread, "t", "left_semi"), "prefixes")
    x = tagged.select("t", *[F.col(k).alias(f"{k}1") for k in ("id", "n", "c", "p")])
    y = tagged.select("t", *[F.col(k).alias(f"{k}2") for k in ("id", "n", "c", "p")])
    need = F.floor((percent * (F.col("n1") + F.col("n2")) + 99 + percent) / (100 + percent))
    # Before the first shared shingle nothing is shared, so what follows it must suffice; later ones needn't leave that room, so this finds pairs but doesn't count.
    fits = (F.col("id1") < F.col("id2")) & (F.col("c1") != F.col("c2")) & size_fits("n1", "n2") & (F.least(F.col("n1") - F.col("p1"), F.col("n2") - F.col("p2")) >= need)
    met = x.join(y, "t").where(fits).select("id1", "id2").distinct()
    # Beyond the prefix that ends first, its set has only n - length(prefix) elements: the rest of the overlap lies in both prefixes, of which all shared shingles count.
    beyond = F.greatest(*[(percent * F.col(n) + 99 - (percent * F.col(n) + 99) % 100) / 100 - 1 for n in ("n1", "n2")])
    for k in "12":
        met = met.join(own.select(F.col("id").alias(f"id{k}"), F.col("n").alias(f"n{k}"), F.col("prefix").alias(f"prefix{k}")), f"id{k}")
    cross = met.where(F.size(F.array_intersect("prefix1", "prefix2")) >= need - beyond).select(F.col("id1").alias("a"), F.col("id2").alias("b"))
    second = materialise(linked_pairs(cross, docs, width, percent), "links")
    final = components(first.union(second)).select(F.col("node").alias("rep"), "component")
    named = sketch.select("id", "n", "fp1", "fp2").join(reps, ["fp1", "fp2", "n"], "left").join(final, "rep", "left")
    return named.select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "id").alias("component_id"))


#: Ids (16 MB) up to which the rows to drop are broadcast, after they have been counted.
BROADCAST_IDS = 2_000_000


def one_of_each(df: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that stand for their component: that with the smallest id of each, all columns.

    Where ids repeat or are null, rows are numbered in the order of id (null last) and text for this,
    so of rows with one id and different texts each is judged by its own text, and of equal rows one stays.
    """
    own = [f"c{k}" for k in range(len(df.columns))]
    key, text = F.col(own[df.columns.index(id_col)]), F.col(own[df.columns.index(text_col)])
    d = df.toDF(*own)
    unclear = d.groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 or k is null").limit(1).count()
    if unclear:
        order = [key.asc_nulls_last(), F.xxhash64(text), text]
        d = materialise(d.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("row", F.monotonically_increasing_id()), "numbered")
    else:
        d = d.withColumn("row", key.cast("long"))
    text_name = own[df.columns.index(text_col)]
    gone = materialise(near_components(d, width, percent, "row", text_name).where("id <> component_id").select(F.col("id").alias("gone")), "gone")
    side = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return d.join(side, F.col("row") == F.col("gone"), "left_anti").select(*[F.col(k).alias(c) for c, k in zip(df.columns, own)])


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
