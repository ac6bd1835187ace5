"""Quality scores: random-indexing word vectors pooled per document, then a two-layer network.

1. Tokens are runs of letters, digits or other signs, hashed from the UTF-8 bytes by
   prefix sums (numpy over whole batches, no loop over words). A token's index vector is
   the sum of two sparse ternary vectors: of its hash bucket and of its shape.
2. Over the whole corpus every bucket's context vector adds up the index vectors of the
   tokens up to two places before and after. Each task adds up its own fixed-size table; tables
   are summed in two rounds, so no task gathers them all.
3. A document is the mean and the spread of its tokens' unit context vectors.
4. On a bounded sample of labelled rows (`train_rows`, those with the smallest hash of
   the id) a network of one hidden layer is trained with numpy; a fifth of the sample only
   stops the training and fits the temperature that calibrates its probabilities.
5. All documents are scored with the table and the weights, both of fixed size.

Rows whose crc32(id as text) mod 3 is 1 are held out: no label of theirs is read. Labels,
language, source and id are no inputs of a score.

Defined results: null and empty texts have no tokens and get the network's score of a zero
vector; without labels of both classes every score is the share of label 1 (0.5 without
labels); labels other than 0 and 1 are ignored, of several labels of one id the lowest
counts; rows that repeat give repeated results; an empty table gives an empty one; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alphaloom.llm.shared import pieces, table, text_or_empty

BUCKETS, DIMS, NONZERO, REACH, CHUNKS = 4096, 32, 4, 2, 8
TRAIN_ROWS, HIDDEN, EPOCHS = 20_000, 32, 60
_M = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Class of each byte: 0 space, 1 lower case or beyond ASCII, 2 upper case, 3 digit, 4 other.
_CLASS = np.full(256, 4, np.uint8)
_CLASS[[32, *range(9, 14)]] = 0
_CLASS[97:123] = 1
_CLASS[128:] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
#: Bytes that may share a token: letters, digits, others.
_KIND = np.array([0, 1, 1, 2, 3], np.uint8)[_CLASS]
SHAPES = 64


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _ternary(n: int, seed: int) -> np.ndarray:
    """n sparse index vectors: NONZERO entries of +1 or -1 each."""
    rng = np.random.default_rng(seed)
    out = np.zeros((n, DIMS), np.float32)
    at = np.argsort(rng.random((n, DIMS)), axis=1)[:, :NONZERO]
    out[np.arange(n)[:, None], at] = rng.choice([-1.0, 1.0], (n, NONZERO))
    return out


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, shape, text number) of every token of a batch of texts."""
    joined = b"\n".join(texts) + b"\n"
    raw = np.frombuffer(joined, np.uint8)
    kind = _KIND[raw]
    starts = np.flatnonzero((kind != 0) & (kind != np.r_[np.uint8(0), kind[:-1]]))
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.flatnonzero((kind[:-1] != 0) & (kind[:-1] != kind[1:])) + 1
    power = np.cumprod(np.r_[np.uint64(1), np.full(len(raw), _M)])
    inverse = np.cumprod(np.r_[np.uint64(1), np.full(len(raw), _INVERSE)])
    total = np.r_[np.uint64(0), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:-1])]
    h = _mixed((total[ends] - total[starts]) * inverse[starts])
    upper = np.r_[0, np.cumsum(_CLASS[raw] == 2)]
    n, ups = ends - starts, upper[ends] - upper[starts]
    case = np.where(ups == 0, 0, np.where(ups == n, 2, 1)) * (kind[starts] == 1)
    shape = ((kind[starts].astype(np.int64) - 1) * 3 + case) * 6 + np.minimum(n, 12) // 4
    lengths = np.array([len(t) + 1 for t in texts])
    doc = np.searchsorted(np.cumsum(lengths), starts, side="right")
    return (h % np.uint64(BUCKETS)).astype(np.int64), np.minimum(shape, SHAPES - 1), doc


def _index(bucket: np.ndarray, shape: np.ndarray) -> np.ndarray:
    return _BUCKET_INDEX[bucket] + _SHAPE_INDEX[shape]


_BUCKET_INDEX, _SHAPE_INDEX = _ternary(BUCKETS, 1), _ternary(SHAPES, 2)


def add_contexts(into: np.ndarray, texts: list[bytes]) -> None:
    """Add to each bucket's row the index vectors of its tokens' neighbours (of the same text)."""
    bucket, shape, doc = tokens(texts)
    if len(bucket) < 2:
        return
    vectors = _index(bucket, shape)
    around = np.zeros_like(vectors)
    for k in range(1, REACH + 1):
        if k >= len(doc):
            break
        same = (doc[k:] == doc[:-k])[:, None]
        around[:-k] += vectors[k:] * same
        around[k:] += vectors[:-k] * same
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.r_[True, np.diff(bucket[order]) > 0])
    into[bucket[order][cuts]] += np.add.reduceat(around[order], cuts, axis=0, dtype=np.float64).astype(np.int64)


def pooled(words: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """Mean and standard deviation of the word vectors of each text, zeros for a text without tokens."""
    bucket, shape, doc = tokens(texts)
    out = np.zeros((len(texts), 2 * DIMS), np.float32)
    if not len(bucket):
        return out
    v = words[bucket] + _SHAPE_INDEX[shape] * 0.5
    cuts = np.flatnonzero(np.r_[True, np.diff(doc) > 0])
    n = np.diff(np.r_[cuts, len(doc)])[:, None]
    mean = np.add.reduceat(v, cuts, axis=0, dtype=np.float64) / n
    square = np.add.reduceat(v * v, cuts, axis=0, dtype=np.float64) / n
    out[doc[cuts], :DIMS] = mean
    out[doc[cuts], DIMS:] = np.sqrt(np.maximum(square - mean * mean, 0))
    return out


def _bytes(col: pa.Array) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for t in col.to_pylist()]


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    sums = np.zeros((BUCKETS, DIMS), np.int64)
    for big in batches:
        for batch in pieces(big, 1 << 20):
            add_contexts(sums, _bytes(batch.column(0)))
    ctx = TaskContext.get()
    part = ctx.partitionId() if ctx else 0
    parts = [p.tobytes() for p in np.split(sums, CHUNKS)]
    yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([part % 64] * CHUNKS, pa.int32()), pa.array(parts, pa.binary())], ["chunk", "salt", "sums"])


def _summed(key, tbl):
    total = sum(np.frombuffer(b, np.int64) for b in tbl.column("sums").to_pylist())
    return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "salt": pa.array([0], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})


def word_vectors(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """The (BUCKETS, DIMS) table of unit context vectors of a corpus; of fixed size, so the driver holds it."""
    kind = "chunk int, salt int, sums binary"
    parts = df.select(text_or_empty(text_col).alias("text")).mapInArrow(_gather, kind)
    rows = parts.groupBy("chunk", "salt").applyInArrow(_summed, kind).groupBy("chunk").applyInArrow(_summed, kind).collect()
    sums = np.zeros((CHUNKS, BUCKETS // CHUNKS * DIMS), np.int64)
    for r in rows:
        sums[r["chunk"]] += np.frombuffer(r["sums"], np.int64)
    c = sums.reshape(BUCKETS, DIMS).astype(np.float64)
    return (c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def _pool(words: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in pieces(big, 1 << 20):
                x = pooled(words, _bytes(batch.column(batch.schema.get_field_index("text"))))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "label", "features"])

    return run


class Network:
    """features -> tanh layer -> logistic output with a temperature."""

    def __init__(self, mean, spread, w1, b1, w2, b2, temperature: float):
        self.mean, self.spread, self.w1, self.b1, self.w2, self.b2, self.temperature = mean, spread, w1, b1, w2, b2, temperature

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.spread @ self.w1 + self.b1) @ self.w2 + self.b2

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


class Constant:
    def __init__(self, share: float):
        self.share = share

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.share)


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z))


def train(x: np.ndarray, y: np.ndarray, seed: int = 7, hidden: int = HIDDEN, epochs: int = EPOCHS):
    """Adam on the logistic loss with early stopping, then a temperature that minimises the loss of the rows kept back."""
    if len(set(y.tolist())) < 2 or len(y) < 20:
        return Constant(float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(seed)
    x = x.astype(np.float64)
    order = rng.permutation(len(y))
    held, fit = order[: len(y) // 5], order[len(y) // 5 :]
    mean, spread = x[fit].mean(0), x[fit].std(0) + 1e-3
    params = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    z = (x - mean) / spread
    best, kept, waited = np.inf, params, 0
    for _ in range(epochs):
        rng.shuffle(fit)
        for at in range(0, len(fit), 128):
            rows = fit[at : at + 128]
            h = np.tanh(z[rows] @ params[0] + params[1])
            d = (1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -30, 30))) - y[rows]) / len(rows)
            back = np.outer(d, params[2]) * (1 - h * h)
            grads = [z[rows].T @ back + 1e-4 * params[0], back.sum(0), h.T @ d + 1e-4 * params[2], np.array([d.sum()])]
            t += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                params[k] = params[k] - 0.004 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        loss = _loss(np.tanh(z[held] @ params[0] + params[1]) @ params[2] + params[3], y[held])
        if loss < best - 1e-5:
            best, kept, waited = loss, [p.copy() for p in params], 0
        elif (waited := waited + 1) >= 8:
            break
    net = Network(mean, spread, *kept, 1.0)
    out = net.logits(x[held])
    net.temperature = float(min(np.geomspace(0.25, 8, 121), key=lambda s: _loss(out / s, y[held])))
    return net


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_rows: int = TRAIN_ROWS):
    """(word table, network) from the texts of docs and the labels that aren't held out."""
    words = word_vectors(docs, text_col)
    lab = labels.select(F.col(id_col).cast("long").alias("l_id"), F.col(label_col).cast("int").alias("label")).where("l_id is not null and label in (0, 1)")
    lab = lab.where(F.crc32(F.col("l_id").cast("string")) % 3 != 1).groupBy("l_id").agg(F.min("label").alias("label"))
    sample = lab.orderBy(F.xxhash64("l_id"), "l_id").limit(train_rows)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")).join(F.broadcast(sample), F.col("id") == F.col("l_id"))
    got = sorted((r["id"], r["label"], bytes(r["features"])) for r in rows.select("id", "label", "text").mapInArrow(_pool(words), "id long, label int, features binary").collect())
    x = np.array([np.frombuffer(f, np.float32) for _, _, f in got]).reshape(len(got), 2 * DIMS)
    return words, train(x, np.array([y for _, y, _ in got], np.float64))


def _score(words: np.ndarray, net):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in pieces(big, 1 << 20):
                p = np.asarray(net(pooled(words, _bytes(batch.column(1)))), np.float64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64())], ["id", "score"])

    return run


def score_quality(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row."""
    return docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(_score(*model), "id long, score double")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    s = score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(F.crc32(F.col("id").cast("string")) % 3 == 1, F.lit(False))
    return s.select(F.col("id").alias("doc_id"), held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
