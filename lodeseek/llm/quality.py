"""Quality rules: base rules on words, then a calibrated logistic regression on hashed n-grams.

Features are relative frequencies of hashed word 1- and 2-grams and of hashed 3- and 4-grams of characters
(code points), over the whole text. The regression is fitted on labelled rows, its scores are calibrated on a fold that
the fit has not seen, and a document is kept if its calibrated probability reaches a fixed threshold.

At most TRAIN_ROWS labelled rows are used for fitting and calibrating, chosen by a hash of their id, and of
those, in that order, as many as have TRAIN_BYTES of features in all; the whole text of each is read. Everything else covers all rows. Scoring runs in Arrow batches and looks up a
weight for each n-gram, so that its memory does not depend on the number of features.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.llm.common import arrow_map
from lodeseek.llm.wordhash import SPACES, word_hashes
from lodeseek.session import Scratch

#: The bound of the training sample.
TRAIN_ROWS = 1500
#: The bound of the features of the sample that come to the driver.
TRAIN_BYTES = 96 << 20
#: log2 of the number of buckets of each of the four kinds of n-gram.
BITS = 15
KINDS = 4
SCALE = 30.0
THRESHOLD = 0.5
EPOCHS = 60
#: Fixed values of the base rules.
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20
WINDOW = 5
SYMBOLS = "#*$%&|<>"

_M = np.uint32(0x9E3779B1)
_A = np.uint32(0x01000193)
_SHIFT = np.uint32(32 - BITS)


class Words:
    """Words of a text as numbers: a 64-bit hash for each word, and ids of the distinct ones."""

    def __init__(self, data: bytes):
        self.hashes = word_hashes(data)
        self._ids = None

    def __len__(self) -> int:
        return len(self.hashes)

    @property
    def ids(self) -> np.ndarray:
        if self._ids is None:
            distinct, self._ids = np.unique(self.hashes, return_inverse=True)
            self.distinct = len(distinct)
        return self._ids

    def repeated(self, window: int = WINDOW) -> int:
        """Words that lie in a window of so many words that the text holds twice or more."""
        n = len(self) - window + 1
        names = self.ids
        if n < 2 or self.distinct == len(self):
            return 0
        count = self.distinct
        key = names[:n].astype(np.uint64)
        for k in range(1, window):
            if count * self.distinct >= 1 << 63:
                _, inverse = np.unique(key, return_inverse=True)
                key, count = inverse.astype(np.uint64), int(inverse.max()) + 1
            key = key * np.uint64(self.distinct) + names[k : k + n].astype(np.uint64)
            count *= self.distinct
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        if not same.any():
            return 0
        twice = np.zeros(n, bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        change = np.zeros(n + window, np.int64)
        change[:n] += twice
        change[window:] -= twice
        return int((np.cumsum(change[: n + window - 1]) > 0).sum())


def buckets(text: str, words: Words) -> list[np.ndarray]:
    """The bucket of each word 1-gram, word 2-gram, character 3-gram and character 4-gram, each kind in a range of its own."""
    h = (words.hashes >> np.uint64(32)).astype(np.uint32)
    if text.isascii():
        a = np.frombuffer(text.encode(), np.uint8).astype(np.uint32)
    else:
        a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    three = (a[:-2] * _A ^ a[1:-1]) * _A ^ a[2:] if len(a) > 2 else np.zeros(0, np.uint32)
    four = three[:-1] * _A ^ a[3:] if len(a) > 3 else np.zeros(0, np.uint32)
    kinds = [h * _M, (h[:-1] * np.uint32(0x85EBCA6B) ^ h[1:]) * _M, three * _M, four * _M]
    return [(x >> _SHIFT) + np.uint32(k << BITS) for k, x in enumerate(kinds)]


def _features(text: str) -> tuple[np.ndarray, np.ndarray]:
    cols, values = [], []
    for b in buckets(text, Words(text.encode())):
        u, n = np.unique(b, return_counts=True)
        cols.append(u)
        values.append(n * (SCALE / max(1, len(b))))
    return np.concatenate(cols).astype(np.int32), np.concatenate(values).astype(np.float32)


def _fit(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, y: np.ndarray, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression by full-batch Adam, classes weighted alike."""
    w, bias = np.zeros(KINDS << BITS), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    share = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    for t in range(1, EPOCHS + 1):
        z = np.bincount(rows, weights=values * w[cols], minlength=len(y)) + bias
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * share
        g, gb = np.bincount(cols, weights=values * error[rows], minlength=len(w)) + l2 * w, error.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = 0.05 / (1 - 0.9**t)
        w = w - rate * m / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        bias -= rate * mb / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    return w, bias


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that make sigmoid(slope * z + offset) a probability; targets are smoothed."""
    n1, n0 = y.sum(), (1 - y).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = max(1e-9, float(np.abs(z).mean()))
    x, a, b = z / scale, 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        e, s = p - target, np.maximum(p * (1 - p), 1e-9)
        g = np.array([(e * x).sum() + 1e-3 * a, e.sum()])
        h = np.array([[(s * x * x).sum() + 1e-3, (s * x).sum()], [(s * x).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a / scale), float(b)


class Model:
    def __init__(self, weights: np.ndarray, bias: float, slope: float, offset: float):
        self.weights, self.bias, self.slope, self.offset = weights.astype(np.float32), bias, slope, offset

    def score(self, text: str, words: Words) -> float:
        parts = (float(self.weights.take(b).sum(dtype=np.float64)) * (SCALE / max(1, len(b))) for b in buckets(text, words))
        return sum(parts) + self.bias

    def probability(self, text: str, words: Words) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.score(text, words) + self.offset, -30, 30))))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES) -> Model:
    """Fits and calibrates the model on at most `most` labelled rows with `most_bytes` of features.

    Rows without id or label are left out; of several labels of one id the largest counts, and of several
    texts of one id the one whose features are first by bytes. A null text counts as empty. With no row of
    one of the classes (an empty table has none) the model keeps everything. The features of the sample, not
    its texts, come to the driver.
    """
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    chosen = chosen.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    # A bounded sample by hash: the limit is a top-k by task, then of the tasks.
    chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(most)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_features(x.as_py() or "") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([c.tobytes() for c, _ in found], pa.binary()), pa.array([v.tobytes() for _, v in found], pa.binary())],
                names=["id", "y", "cols", "vals"],
            )

    scratch = Scratch(docs.sparkSession)
    found = scratch.write(arrow_map(rows.select("id", "text", "y"), run, f"id {kind}, y int, cols binary, vals binary"), "op10-features")
    # Sizes first: one row for each id of the sample, in the order of the hash.
    sizes = found.groupBy("id").agg(F.max(F.octet_length("cols") + F.octet_length("vals")).alias("size"))
    held, picked = 0, []
    for r in sizes.orderBy(F.xxhash64("id"), "id").collect():
        if held + r["size"] <= most_bytes:
            held += r["size"]
            picked.append(r["id"])
    one = found.where(F.col("id").isin(picked)).groupBy("id").agg(F.min(F.struct("cols", "vals", "y")).alias("x")) if picked else found.limit(0).select("id", F.struct("cols", "vals", "y").alias("x"))
    table = one.select("id", "x.*").orderBy("id").toArrow()
    scratch.clear()
    y = np.array(table.column("y").to_pylist(), float)
    if len(set(y)) < 2:
        return Model(np.zeros(KINDS << BITS), 30.0, 1.0, 0.0)
    cols = [np.frombuffer(x.as_py(), np.int32) for x in table.column("cols")]
    vals = [np.frombuffer(x.as_py(), np.float32) for x in table.column("vals")]
    del table
    # Every fourth row of each class calibrates, the others fit; classes too small for that do both.
    turn = np.zeros(len(y), int)
    for c in (0.0, 1.0):
        turn[y == c] = np.arange((y == c).sum()) % 4
    held = turn == 3
    if min((y[held] == 0).sum(), (y[held] == 1).sum()) < 1:
        held[:] = True
        fit = np.ones(len(y), bool)
    else:
        fit = ~held
    flat = lambda pick: (
        np.repeat(np.arange(pick.sum()), [len(cols[k]) for k in np.flatnonzero(pick)]),
        np.concatenate([cols[k] for k in np.flatnonzero(pick)]),
        np.concatenate([vals[k] for k in np.flatnonzero(pick)]),
    )
    w, bias = _fit(*flat(fit), y[fit])
    r, c, x = flat(held)
    z = np.bincount(r, weights=x * w[c], minlength=int(held.sum())) + bias
    return Model(w, bias, *_platt(z, y[held]))


def quality_rules(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Base figures and verdict of each row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, probability, kept.

    One row per input row; ids may be null or repeat. A null or empty text has no words, and so fails
    the base rules. Other columns are not read.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            out: list[tuple] = []
            for value in batch.column(1):
                out.append(_judge(value.as_py() or "", own, threshold))
            columns = list(zip(*out, strict=True)) or [[]] * 8
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["id", *FIGURES])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    longs = ", ".join(f"{c} long" for c in FIGURES[:5])
    return arrow_map(rows, run, f"id {kind}, {longs}, base_failed boolean, probability double, kept boolean").withColumnRenamed("id", id_col)


def quality_filter(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns, repeated rows as often as they stand.

    Nulls are judged as in quality_rules; an empty table gives no rows; other columns pass as they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            yield batch.filter(pa.array([_judge(x.as_py() or "", own, threshold)[-1] for x in batch.column(at)], pa.bool_()))

    return arrow_map(docs, run, docs.schema)


FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "probability", "kept"]


def _judge(text: str, model: Model, threshold: float) -> tuple:
    words = Words(text.encode())
    n = len(words)
    seen, again = set(), 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            again += line in seen
            seen.add(line)
    repeated = words.repeated()
    failed = n < LEAST_WORDS or 100 * repeated > MOST_REPEATED_PERCENT * n
    chars = len(text) - sum(map(text.count, SPACES))
    p = model.probability(text, words)
    return n, chars, sum(map(text.count, SYMBOLS)), again, repeated, failed, p, not failed and p >= threshold
