"""SentencePiece encoding and decoding for merge-type (BPE) models.

Encoding is exact but never runs the merge queue over the text. A text is cut at
spaces, where no piece can span; each distinct word is encoded once per worker by
backtracking:

* an Aho-Corasick automaton over the vocabulary gives the longest piece that starts
  at each position of all new words in one pass;
* the longest piece is taken if it may stand next to the piece before it. Two pieces
  may stand side by side if re-merging them (undoing their last merges, newest
  first) never meets a merge that the queue would have done earlier across the border;
* else the next shorter prefix piece is tried, and when none is left the last piece
  is given back and the position entered in a bit field of failed positions, so that
  no position is tried twice and the work is linear in the word.

Characters outside the vocabulary become UTF-8 byte pieces (or the unknown id).
Runs of spaces, whose pieces share one lowest score, are joined left to right at the
end, which is what the queue does with ties.

Defined results: null text counts as empty (begin and end ids only); repeated rows
give repeated results; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alphaloom.llm.shared import pieces as parts
from alphaloom.llm.shared import table, text_or_empty

SPACE = "▁"
#: Most words a worker remembers; beyond that it forgets all and goes on.
CACHE_WORDS = 400_000


class PieceModel:
    """Tables of a BPE model: merge order, splits and prefixes of its pieces."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        text = [sp.id_to_piece(i) for i in range(n)]
        score = [sp.get_score(i) for i in range(n)]
        self.size, self.bos, self.eos, self.unk = n, sp.bos_id(), sp.eos_id(), sp.unk_id()
        self.byte_id = {int(text[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.surface = [self._surface(sp, i, text[i]) for i in range(n)]
        #: Pieces whose leading space mark is dropped at the start of a text.
        self.leading = {i for i in range(n) if text[i].startswith(SPACE)}
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.spaces = {len(text[i]): i for i in plain if set(text[i]) == {SPACE}}
        words = [i for i in plain if len(text[i]) > 1 and set(text[i]) != {SPACE}]
        if len({score[i] for i in words}) != len(words) or any(a != SPACE and b == SPACE for i in words for a, b in zip(text[i], text[i][1:])):
            raise ValueError("merges of equal score, or pieces that span a space: not supported")
        words.sort(key=lambda i: -score[i])
        self.id_of = {text[i]: i for i in plain if len(text[i]) == 1} | {text[i]: i for i in words}
        #: Order of the merge that makes a piece; single characters come before all merges.
        self.order = dict.fromkeys(range(n), -1) | {i: k for k, i in enumerate(words)}
        self.split: dict[int, tuple[int, int]] = {}
        self.merge: dict[tuple[int, int], int] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        for i in words:
            if (ids := self._queue(text[i])) and len(ids) == 1:
                self.merge[self.split[i]] = i
        reachable = [i for i in words if i in self.split]
        self.automaton = ahocorasick.Automaton()
        for t, i in self.id_of.items():
            if len(t) == 1 or i in self.split:
                self.automaton.add_word(t, (len(t), i))
        self.automaton.make_automaton()
        self.length = {i: len(text[i]) for i in self.id_of.values()}
        self.shorter: dict[int, int | None] = {}
        known = {text[i] for i in reachable} | {t for t in self.id_of if len(t) == 1}
        for t in known:
            self.shorter[self.id_of[t]] = next((self.id_of[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in known), None)
        self.words: dict[str, bytes | None] = {}

    @staticmethod
    def _surface(sp, i: int, text: str) -> str:
        if sp.is_byte(i):
            b = int(text[3:5], 16)
            return chr(b) if b < 128 else chr(0xDC00 + b)
        if sp.is_control(i):
            return ""
        if sp.is_unknown(i):
            return " ⁇ "
        return text.replace(SPACE, " ")

    def _queue(self, text: str) -> list[int] | None:
        """Plain merging of one short string, noting the last merge of a piece; None if a character is unknown."""
        ids = [self.id_of.get(c) for c in text]
        if None in ids:
            return None
        strings = list(text)
        while len(ids) > 1:
            best = None
            for k in range(len(ids) - 1):
                i = self.id_of.get(strings[k] + strings[k + 1])
                if i is not None and (best is None or self.order[i] < best[0]):
                    best = (self.order[i], k, i)
            if best is None:
                break
            _, k, i = best
            if len(ids) == 2:
                self.split[i] = (ids[0], ids[1])
            ids[k : k + 2] = [i]
            strings[k : k + 2] = [strings[k] + strings[k + 1]]
        return ids

    def may_follow(self, left: int, right: int) -> bool:
        """Whether merging left + right as one text leaves these two pieces."""
        key = (left, right)
        if (known := self.fits.get(key)) is not None:
            return known
        order, split, merge = self.order, self.split, self.merge
        # Undo the newest merge of either side; a border merge older than what was undone would have come first.
        undone, verdict = len(order), True
        while True:
            joined = merge.get((left, right))
            if joined is not None and order[joined] < undone:
                verdict = False
                break
            a, b = order[left], order[right]
            if a < 0 and b < 0:
                break
            # Among equal merges the one further left comes first: left's own before the border's, that before right's own.
            if a > b:
                undone, left = a, split[left][1]
            else:
                undone, right = b + 1, split[right][0]
        self.fits[key] = verdict
        return verdict

    def _segment(self, longest: list[int | None], start: int, end: int) -> list[int]:
        """Backtracking over one run of known characters; longest[p] is the longest piece from p."""
        out: list[int] = []
        failed = bytearray((end - start >> 3) + 1)  # bit field: positions from which no valid rest exists
        at, piece = start, longest[start]
        while at < end:
            while True:
                stop = at + self.length[piece]
                k = stop - start
                if not failed[k >> 3] >> (k & 7) & 1 and (not out or self.may_follow(out[-1], piece)):
                    out.append(piece)
                    at = stop
                    piece = longest[at] if at < end else None
                    break
                piece = self.shorter[piece]
                while piece is None:
                    failed[at - start >> 3] |= 1 << (at - start & 7)
                    piece = out.pop()
                    at -= self.length[piece]
                    piece = self.shorter[piece]
        return out

    def _unknown(self, c: str) -> list[int]:
        if not self.byte_id:
            return [self.unk]
        return [self.byte_id[b] for b in c.encode("utf-8", "surrogatepass")]

    def encode_many(self, words: list[str]) -> list[list[int]]:
        """Ids of each word (spaces already written as the space mark), by one automaton pass over all of them."""
        joined = "\n".join(words)  # a line end is in no piece
        longest: list[int | None] = [None] * (len(joined) + 1)
        for last, (n, i) in self.automaton.iter(joined):
            longest[last - n + 1] = i  # ends ascend: a later hit from one start is longer
        out, at = [], 0
        for word in words:
            ids: list[int] = []
            end = at + len(word)
            while at < end:
                if longest[at] is None:
                    ids += self._unknown(joined[at])
                    at += 1
                    continue
                stop = at + 1
                while stop < end and longest[stop] is not None:
                    stop += 1
                ids += self._segment(longest, at, stop)
                at = stop
            out.append(self._join_spaces(ids))
            at += 1
        return out

    def _join_spaces(self, ids: list[int]) -> list[int]:
        one = self.spaces.get(1)
        if one is None or ids.count(one) < 2:
            return ids
        most, out, run = max(self.spaces), [], 0
        for i in [*ids, None]:
            if i == one:
                run += 1
                continue
            while run:
                k = next(k for k in range(min(run, most), 0, -1) if k in self.spaces)
                out.append(self.spaces[k])
                run -= k
            if i is not None:
                out.append(i)
        return out

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids without begin and end."""
        if not text:
            return b""
        words = text.split(" ")
        cache = self.words
        if new := [w for w in dict.fromkeys(words) if w not in cache]:
            if len(cache) > CACHE_WORDS:
                cache.clear()
                new = list(dict.fromkeys(words))
            plain = [w for w in new if w and SPACE not in w]
            for w, ids in zip(plain, self.encode_many([SPACE + w for w in plain])):
                cache[w] = np.array(ids, "<u4").tobytes()
            for w in new:  # an empty word is a run of spaces: not to be cut there
                cache.setdefault(w, None)
        got = [cache[w] for w in words]
        if None in got:
            whole = SPACE + text.replace(" ", SPACE)
            return np.array(self.encode_many([whole])[0], "<u4").tobytes()
        return b"".join(got)

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: byte pieces as UTF-8 (a bad byte as U+FFFD), begin, end and the leading space dropped."""
        surface, ids = self.surface, list(ids)
        first = next((i for i in ids if surface[i]), None)
        text = "".join(map(surface.__getitem__, ids))[first in self.leading :]
        if text.isascii():
            return text
        try:
            return text.encode("utf-8", "surrogateescape").decode("utf-8")
        except UnicodeDecodeError:
            return text.encode("utf-8", "surrogateescape").decode("utf-8", "alphaloom-each-byte")


def _each_byte(e: UnicodeError):
    return "�", e.start + 1


import codecs  # noqa: E402

codecs.register_error("alphaloom-each-byte", _each_byte)


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    return PieceModel(path)


def _run(path: str, begin: bool, end: bool, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        head = np.array([m.bos] if begin else [], "<u4").tobytes()
        tail = np.array([m.eos] if end else [], "<u4").tobytes()
        for big in batches:
            for batch in parts(big):
                ids, counts, digest, back, raw = batch.column(0), [], [], [], []
                for text in batch.column(1).to_pylist():
                    data = head + m.encode(text) + tail
                    decoded = m.decode(np.frombuffer(data, "<u4").tolist())
                    counts.append(len(data) // 4)
                    if keep:
                        raw.append(data)
                        back.append(decoded)
                    else:
                        digest.append(hashlib.sha256(data).hexdigest())
                        back.append(hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest())
                cols = [ids, pa.array(counts, pa.int64()), pa.array(raw, pa.binary()) if keep else pa.array(digest), pa.array(back, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, ["id", "n_tokens", "ids", "decoded"] if keep else ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def piece_ids(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", begin: bool = True, end: bool = True) -> DataFrame:
    """(id, n_tokens, ids, decoded): ids as little-endian unsigned 32-bit integers in a binary column, and the text decoded from them."""
    return df.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(
        _run(path, begin, end, True), "id long, n_tokens long, ids binary, decoded string")


def piece_digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", begin: bool = True, end: bool = True) -> DataFrame:
    """As piece_ids(), with SHA-256 digests in place of ids and text."""
    return df.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(
        _run(path, begin, end, False), "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(table(spark, sf_dir, "documents"), default_model()).withColumnRenamed("id", "doc_id")
