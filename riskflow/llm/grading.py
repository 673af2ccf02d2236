"""Quality grades by ordinal regression: one weight vector over hashed text features and ordered thresholds.

The cumulative-link model: P(grade <= k) = sigmoid(threshold_k - f(text)). The likelihood's gradient is summed in Spark over the
training partitions; L-BFGS steps on the driver over a vector whose length is fixed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.llm.common import column, rows_out, slices, table
from riskflow.llm.labelled import SAMPLE, held_out, training_sample
from riskflow.session import freeze

#: Hashed features; the vector that is fitted and sent to the workers has this length.
BUCKETS = 1 << 14
PENALTY = 1e-4
STEPS = 40
#: Distinct words a worker remembers, and their greatest length; longer ones are hashed again.
REMEMBERED = 400_000
MEMORABLE = 32
SHAPES = ((re.compile(r"[A-ZÀ-ÖØ-Þ]+"), "A"), (re.compile(r"[^\W\d_A-ZÀ-ÖØ-Þ]+"), "a"), (re.compile(r"\d+"), "0"))


def grade(quality: Column, toxic: Column) -> Column:
    """The graded rating of a label row: 0 poor, 1 good but toxic, 2 good; null if either label is."""
    return F.when(quality.isNull() | toxic.isNull(), F.lit(None)).when(quality == 0, 0).when(toxic != 0, 1).otherwise(2)


class Hasher:
    """Sparse features of a text: words, their shapes, and what repeats, each hashed to a bucket; the vector has length 1."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[int, int]] = {}

    def of(self, word: str) -> tuple[int, int]:
        if word not in self.known:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            shape = word
            for pattern, sign in SHAPES:
                shape = pattern.sub(sign, shape)
            bucket = lambda kind, s: xxhash.xxh32_intdigest(kind + s.encode("utf-8", "surrogatepass")) % BUCKETS
            found = bucket(b"w", word.lower()), bucket(b"s", shape)
            if len(word) > MEMORABLE:
                return found
            self.known[word] = found
        return self.known[word]

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        words = (text or "").split()
        n = len(words)
        pairs = np.array([self.of(w) for w in words], dtype=np.int64).reshape(n, 2)
        word, word_times = np.unique(pairs[:, 0], return_counts=True)
        shape, shape_times = np.unique(pairs[:, 1], return_counts=True)
        again = int((pairs[1:, 0] == pairs[:-1, 0]).sum()) / max(1, n - 1)
        length = min(7, n.bit_length() // 2)
        extra = np.array([xxhash.xxh32_intdigest(b"x%d" % i) % BUCKETS for i in (100, 101, length)])
        at = np.concatenate([word, shape, extra])
        value = np.concatenate([np.log1p(word_times) / np.sqrt(max(1, len(word))), shape_times / max(1, n), [again, 1 - len(word) / max(1, n), 0.3]])
        return at, value / max(1e-12, np.sqrt((value**2).sum()))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def thresholds(free: np.ndarray) -> np.ndarray:
    """Ordered thresholds from free parameters: the first, then the logarithms of the steps."""
    return np.cumsum(np.concatenate([free[:1], np.exp(np.clip(free[1:], -20, 20))]))


def loss_and_gradient(f: np.ndarray, y: np.ndarray, free: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Summed negative log-likelihood of grades ``y`` at scores ``f``; its derivatives by f and by the free parameters."""
    cuts = np.concatenate([[-np.inf], thresholds(free), [np.inf]])
    hi, lo = _sigmoid(cuts[y + 1] - f), _sigmoid(cuts[y] - f)
    p = np.maximum(hi - lo, 1e-12)
    by_cut = np.zeros(len(cuts))
    np.add.at(by_cut, y + 1, -hi * (1 - hi) / p)
    np.add.at(by_cut, y, lo * (1 - lo) / p)
    tails = np.cumsum(by_cut[1:-1][::-1])[::-1]
    by_free = np.concatenate([tails[:1], tails[1:] * np.exp(np.clip(free[1:], -20, 20))])
    return float(-np.log(p).sum()), 1 - hi - lo, by_free


EXAMPLES_DDL = "y int, at array<int>, value array<float>"


def examples(sample: DataFrame) -> DataFrame:
    schema = pa.schema([("y", pa.int32()), ("at", pa.list_(pa.int32())), ("value", pa.list_(pa.float32()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Hasher()
        for batch in slices(batches):
            found = [hashed(t) for t in column(batch, "text")]
            yield rows_out(schema, [[int(y) for y in column(batch, "label")], [a for a, _ in found], [v.astype(np.float32) for _, v in found]])

    return sample.select("text", "label").mapInArrow(work, EXAMPLES_DDL)


def fit(rows: DataFrame, n: int, grades: int = 3, steps: int = STEPS, penalty: float = PENALTY) -> np.ndarray:
    """Weights, then the free threshold parameters, of the likeliest cumulative-link model. ``rows`` must be written."""
    size = BUCKETS + grades - 1

    def objective(w: np.ndarray) -> tuple[float, np.ndarray]:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, gradient = 0.0, np.zeros(size)
            for batch in batches:
                y, at, value = (batch.column(i) for i in range(3))
                lengths = np.diff(at.offsets.to_numpy())
                cells, values = at.flatten().to_numpy(), value.flatten().to_numpy().astype(float)
                row = np.repeat(np.arange(len(lengths)), lengths)
                f = np.bincount(row, values * w[cells], minlength=len(lengths))
                loss, by_f, by_free = loss_and_gradient(f, y.to_numpy().astype(np.int64), w[BUCKETS:])
                total += loss
                gradient[:BUCKETS] += np.bincount(cells, values * by_f[row], minlength=BUCKETS)
                gradient[BUCKETS:] += by_free
            yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([gradient.astype("<f8").tobytes()])], names=["loss", "gradient"])

        # one vector of fixed length from each of a few partitions of a bounded sample
        parts = rows.mapInArrow(work, "loss double, gradient binary").toArrow()
        g = sum((np.frombuffer(b) for b in parts["gradient"].to_pylist()), np.zeros(size)) / n
        g[:BUCKETS] += penalty * w[:BUCKETS]
        return sum(parts["loss"].to_pylist()) / n + penalty / 2 * float(w[:BUCKETS] @ w[:BUCKETS]), g

    w = np.zeros(size)
    loss, g = objective(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d = -g.copy()
        alphas = []
        for s, y in reversed(past):
            a = (s @ d) / (s @ y)
            alphas.append(a)
            d -= a * y
        if past:
            s, y = past[-1]
            d *= (s @ y) / (y @ y)
        for (s, y), a in zip(past, reversed(alphas)):
            d += s * (a - (y @ d) / (s @ y))
        step = 1.0 if past else min(1.0, 1.0 / max(1e-12, np.abs(g).sum())) * 10
        slope = float(g @ d)
        while True:
            new_loss, new_g = objective(w + step * d)
            if new_loss <= loss + 1e-4 * step * slope or step < 1e-6:
                break
            step /= 3
        s, y = step * d, new_g - g
        done = loss - new_loss < 1e-5 * max(1.0, abs(loss))
        if s @ y > 1e-12:
            past = [*past, (s, y)][-10:]
        if new_loss <= loss:
            w, loss, g = w + s, new_loss, new_g
        if done:
            break
    return w


def graded(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE, keep_above: float = 0.5) -> DataFrame:
    """The expected grade of every row of ``docs`` (``doc_id``, ``text``), learnt from ``labels`` (``doc_id``, ``quality``, ``toxic``).

    Returns ``doc_id, held_out, expected_grade, p_at_least_1, p_at_least_2, predicted, kept``: tail probabilities, the likeliest grade, and whether
    grade 1 or more has a probability above ``keep_above``. The text alone decides. Fitted on at most ``sample_rows`` labelled rows
    outside the held-out fold; without any, each grade is as likely. Null and empty texts are graded like any. Repeated rows
    each get a row; other columns are ignored. An empty table gives an empty result.
    """
    sample = training_sample(docs, labels, grade(labels["quality"], labels["toxic"]), sample_rows)
    rows = freeze(examples(sample))
    n = rows.count()
    w = fit(rows, n) if n else np.concatenate([np.zeros(BUCKETS), [-np.log(2), np.log(2 * np.log(2))]])
    shared = docs.sparkSession.sparkContext.broadcast(w)
    names = ["doc_id", "held_out", "expected_grade", "p_at_least_1", "p_at_least_2", "predicted", "kept"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, cuts = Hasher(), thresholds(shared.value[BUCKETS:])
        for batch in slices(batches):
            f = np.zeros(batch.num_rows)
            for i, text in enumerate(column(batch, "text")):
                at, value = hashed(text)
                f[i] = shared.value[at] @ value
            tails = _sigmoid(f[:, None] - cuts[None, :])
            shares = np.diff(np.concatenate([np.ones((len(f), 1)), tails, np.zeros((len(f), 1))], axis=1)) * -1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array(x) for x in (tails.sum(axis=1), tails[:, 0], tails[:, 1], shares.argmax(axis=1).astype(np.int32), tails[:, 0] > keep_above)]], names=names)

    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), held_out(docs["doc_id"].cast("long")).alias("held_out"), "text")
    return own.mapInArrow(work, "doc_id long, held_out boolean, expected_grade double, p_at_least_1 double, p_at_least_2 double, predicted int, kept boolean")


def op9_quality_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graded(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
