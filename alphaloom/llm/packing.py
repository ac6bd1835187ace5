"""Packing token sequences into windows by minimum bin slack.

1. Tokenise every text once; a document's ids are cut into full windows and one
   remainder. Only (id, start, length, checksum) of each piece is kept from here on.
2. Count pieces by length: at most `window` counts, whatever the size of the corpus.
3. On these counts, plan windows: the longest remaining length opens a window, and a
   bitset subset-sum over the multiset of remaining lengths (counts by binary
   splitting) finds the fill closest to the capacity; walking back through the
   stored bitsets gives the counts. A fill is repeated as often as the counts allow,
   which exhausts a length, so there are at most `window` fills.
4. Number the pieces of each length (in hash buckets, so that a length that holds a
   third of all pieces is no single task's work) and look up window and offset by
   arithmetic in the plan.

Defined results: null text counts as empty (the end id alone); rows that repeat are
packed each; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alphaloom.llm.shared import materialise, pieces, released, table, text_or_empty

#: Fixed value: the pre-tokenisation pattern of the byte-level BPE family.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces of one length that a numbering bucket should hold.
BUCKET_ROWS = 50_000


class ByteLevel:
    """Ids of a byte-level BPE tokeniser file.

    tokenizers defines the ids; the same vocabulary as merge ranks gives equal ids
    several times faster, so it encodes all texts but those that hold an added token's
    string or that it can't cope with.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path = path
        self.added = [x["content"] for x in spec.get("added_tokens", [])]
        # Byte-level files write each byte as a printable character: the printable ones as themselves, the others from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in shown]
        to_byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(other)}
        ranks = {bytes(map(to_byte.__getitem__, t)): i for t, i in spec["model"]["vocab"].items() if t not in self.added}
        self.fast = tiktoken.Encoding("byte-level", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def own(self):
        """The tokeniser itself, read only where a text needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def ids(self, text: str) -> np.ndarray:
        if not any(a in text for a in self.added):
            try:
                return np.array(self.fast.encode_ordinary(text), "<u4")
            except Exception:  # noqa: BLE001  a pattern engine's limit, on degenerate texts
                pass
        return np.array(self.own.encode(text, add_special_tokens=False).ids, "<u4")


@lru_cache(maxsize=2)
def tokeniser(path: str) -> ByteLevel:
    return ByteLevel(path)


PIECES = "id long, start long, length long, ids_crc32 long, doc_tokens long"


def _cut(path: str, window: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokeniser(path)
        for big in batches:
            for batch in pieces(big):
                out: list[tuple] = []
                for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    ids = np.append(t.ids(text), np.uint32(end_id)).astype("<u4")
                    for at in range(0, len(ids), window):
                        part = ids[at : at + window]
                        out.append((i, at, len(part), zlib.crc32(part.tobytes()), len(ids)))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def token_pieces(df: DataFrame, path: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut every document's ids (with the end id) into full windows and a remainder."""
    return df.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(released(_cut(path, window, end_id)), PIECES)


def closest_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths (within their counts) whose sum comes closest to room without exceeding it."""
    reach, steps = 1, []
    full = (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if counts[x] and x <= room), reverse=True):
        left, k = min(counts[length], room // length), 1
        while left:  # binary splitting: 1, 2, 4, ... and the rest
            take = min(k, left)
            steps.append((reach, length, take))
            reach |= reach << (length * take) & full
            left -= take
            k *= 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for before, length, take in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + take
            at -= length * take
    return used


def plan_windows(counts: dict[int, int], window: int) -> list[tuple[dict[int, int], int]]:
    """(fill, times) pairs that use up all counts: minimum bin slack on the multiset of lengths."""
    counts, out = {k: v for k, v in counts.items() if v}, []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        fill = closest_fill(counts, window - longest)
        counts[longest] += 1
        fill[longest] = fill.get(longest, 0) + 1
        times = min(counts[k] // n for k, n in fill.items())
        for k, n in fill.items():
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]
        out.append((fill, times))
    return out


def pack(cut: DataFrame, window: int = 2048) -> DataFrame:
    """Give each piece of a (id, start, length, ...) table its sequence_id and offset.

    The driver holds the counts by length (at most `window`) and the plan: at most
    `window` fills of at most sqrt(2 * window) different lengths each. The plan is
    broadcast; this bound holds for any input.
    """
    spark = cut.sparkSession
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if bad := [k for k in counts if k is None or not 0 < k <= window]:
        raise ValueError(f"lengths outside 1..{window}: {bad[:5]}")
    total = sum(counts.values())
    rows, taken, first = [], dict.fromkeys(counts, 0), 0
    for fill, times in plan_windows(counts, window):
        at = 0
        for length in sorted(fill, reverse=True):
            n = fill[length]
            rows.append((length, taken[length], taken[length] + n * times, first, n, at))
            taken[length] += n * times
            at += n * length
        first += times
    plan = spark.createDataFrame(rows or [(0, 0, 0, 0, 1, 0)], "p_length long, p_from long, p_to long, p_first long, p_each long, p_at long")
    # Number the pieces of a length 0, 1, 2, ...: by buckets of a hash, whose sizes are summed up first.
    buckets = max(8, total // BUCKET_ROWS)
    keyed = cut.withColumn("_bucket", F.pmod(F.xxhash64("id", "start", "ids_crc32"), F.lit(buckets)))
    sizes = keyed.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("length", "_bucket", (F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("_n")).alias("_before"))
    order = Window.partitionBy("length", "_bucket").orderBy("id", "start")
    ranked = keyed.withColumn("_k", F.row_number().over(order) - 1).join(before, ["length", "_bucket"]).withColumn("_rank", F.col("_k") + F.col("_before"))
    placed = ranked.join(F.broadcast(plan), (F.col("length") == F.col("p_length")) & (F.col("_rank") >= F.col("p_from")) & (F.col("_rank") < F.col("p_to")))
    within = F.col("_rank") - F.col("p_from")
    return placed.select(
        *[F.col(c) for c in cut.columns],
        (F.col("p_first") + F.floor(within / F.col("p_each"))).cast("long").alias("sequence_id"),
        (F.col("p_at") + within % F.col("p_each") * F.col("length")).cast("long").alias("offset"))


def default_tokeniser() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pack_documents(df: DataFrame, path: str | None = None, window: int = 2048, end_id: int = 1) -> DataFrame:
    cut = materialise(token_pieces(df, path or default_tokeniser(), window, end_id), "pieces")
    return pack(cut, window).withColumnRenamed("id", "doc_id")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
