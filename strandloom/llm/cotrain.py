"""Quality classification by co-training.

Two classifiers look at a document from different sides: one at its text, one at what
is known about it (language, source, length, and where it stands among its source's
documents). In each round each labels the pool rows that it is surest of, for the other
to learn from. Their scores are calibrated on labelled rows that neither has learnt
from, and their combination scores every document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bounds of what is fitted on: labelled rows, unlabelled pool rows; rounds, and pseudo-labels of a view in a round.
LABELLED_ROWS, POOL_ROWS, ROUNDS, EXCHANGED = 6000, 6000, 4, 400
META_SLOTS = 64

# Classes of bytes, by which pairs of neighbouring bytes are counted.
_CLASSES = [b"etaoinshr", b"dlcumwfgypbvkjxqz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".", b",;:", b"!?", b"#$%&*", b"|", b"=+-_/", b"()[]{}<>", b"'\"", b"@"]


def _class_table() -> np.ndarray:
    table = np.full(256, len(_CLASSES), np.uint8)  # all other bytes: letters beyond ASCII, controls
    for i, members in enumerate(_CLASSES):
        table[list(members)] = i
    return table


CLASS = _class_table()
_WIDTH = len(_CLASSES) + 1
TEXT_SIZE = _WIDTH * _WIDTH + _WIDTH + 6


def text_features(text: str | None) -> np.ndarray:
    """Shares of byte classes and of neighbouring pairs, and what words and lines look like; zeros without text."""
    out = np.zeros(TEXT_SIZE, np.float32)
    data = np.frombuffer((text or "").encode(), np.uint8)
    if not len(data):
        return out
    kind = CLASS[data]
    pairs = np.bincount(kind[:-1].astype(np.int16) * _WIDTH + kind[1:], minlength=_WIDTH * _WIDTH) if len(kind) > 1 else np.zeros(_WIDTH * _WIDTH)
    single = np.bincount(kind, minlength=_WIDTH)
    out[: _WIDTH * _WIDTH] = np.sqrt(pairs / len(data))
    out[_WIDTH * _WIDTH : -6] = np.sqrt(single / len(data))
    words, lines = text.split(), text.split("\n")
    if words:
        out[-6:] = [min(4.0, np.log1p(len(data) / len(words))) / 4, np.log1p(len(words)) / 10, len(set(words)) / len(words), len(set(lines)) / len(lines), np.log1p(len(words) / len(lines)) / 8, 1.0]
    return out


def meta_features(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    """Language and source in hashed slots, and the length in steps; the text is no part of it."""
    out = np.zeros(META_SLOTS + 18, np.float32)
    out[zlib.crc32(f"l:{lang}".encode()) % META_SLOTS] = 1.0
    out[zlib.crc32(f"s:{source}".encode()) % META_SLOTS] = 1.0
    size = np.log2(max(0, n_chars or 0) + 1)
    out[META_SLOTS + min(15, int(size))] = 1.0
    out[META_SLOTS + 16], out[META_SLOTS + 17] = size / 20, (size / 20) ** 2
    return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 60, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a logistic regression, the last for the constant, by damped Newton steps on a ridge penalty."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    w, total = np.zeros(x.shape[1]), weight.sum()
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-9
    for _ in range(steps):
        p = sigmoid(x @ w)
        gradient = x.T @ (weight * (p - y)) / total + penalty * w
        curvature = (x.T * (weight * np.maximum(p * (1 - p), 1e-6))) @ x / total + np.diag(penalty)
        move = np.linalg.solve(curvature, gradient)
        w -= move * min(1.0, 4.0 / max(1e-12, np.abs(move).max()))
        if np.abs(move).max() < 1e-6:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def margins(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def cotrain(text: np.ndarray, meta: np.ndarray, y: np.ndarray, calibrate: np.ndarray, pool_text: np.ndarray, pool_meta: np.ndarray, rounds: int = ROUNDS, exchanged: int = EXCHANGED) -> dict:
    """Weights of both views and of their calibrated combination.

    ``calibrate`` marks the labelled rows that are left for the calibration. In each round a view passes on its
    surest pool rows, of both classes in the share of the labels; what a view has passed on isn't passed on again.
    """
    own = ~calibrate
    views = [text, meta]
    pools = [pool_text, pool_meta]
    given: list[dict[int, float]] = [{}, {}]  # pool rows that each view learns from, labelled by the other
    share = min(0.95, max(0.05, float(y[own].mean()))) if own.any() else 0.5

    def model(v: int) -> np.ndarray:
        rows = sorted(given[v])
        x = np.vstack([views[v][own], pools[v][rows]]) if rows else views[v][own]
        labels = np.concatenate([y[own], [given[v][r] for r in rows]])
        return fit(x, labels, np.concatenate([np.ones(own.sum()), np.full(len(rows), 0.5)]))

    for _ in range(rounds if len(pool_text) else 0):
        fresh: list[dict[int, float]] = [{}, {}]
        for v in (0, 1):
            p = sigmoid(margins(model(v), pools[v]))
            todo = np.array([i for i in range(len(p)) if i not in given[1 - v]], int)
            order = todo[np.argsort(p[todo], kind="stable")]
            low, high = int(exchanged * (1 - share)), int(exchanged * share)
            for i in order[:low]:
                if p[i] < 0.1:
                    fresh[1 - v][int(i)] = 0.0
            for i in order[::-1][:high]:
                if p[i] > 0.9:
                    fresh[1 - v][int(i)] = 1.0
        for v in (0, 1):
            given[v].update(fresh[v])
    weights = [model(0), model(1)]
    m = np.stack([margins(weights[v], views[v][calibrate]) for v in (0, 1)], 1)
    combined = fit(m / 4, y[calibrate], np.ones(calibrate.sum()), ridge=1e-3) if calibrate.any() and 0 < y[calibrate].mean() < 1 else np.array([2.0, 2.0, 0.0])
    return {"text": weights[0], "meta": weights[1], "combined": combined}


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", keep=None) -> dict | None:
    """A model from a bounded sample: LABELLED_ROWS labelled and POOL_ROWS other rows, by a hash of their id.

    Rows are thinned by the hash during the scan; features, not texts, are collected. ``keep`` leaves rows of a test
    out. None if one class has no label.
    """
    unit = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    marks = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("double").alias("y"))
    if keep is not None:
        marks = marks.filter(keep)
    n_labelled, n_docs = marks.count(), docs.count()
    known = marks.filter(unit * n_labelled < 1.2 * LABELLED_ROWS)  # about LABELLED_ROWS ids
    base = docs.select("doc_id", "text", "lang", "source", "n_chars").filter(F.col("doc_id").isNotNull())
    labelled = _features(base.join(known, "doc_id")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED_ROWS).toPandas()
    seen = labels.select("doc_id").filter(unit * n_docs < 4 * POOL_ROWS).distinct()
    pool = base.filter(unit * n_docs < 4 * POOL_ROWS).join(seen, "doc_id", "left_anti").withColumn("y", F.lit(0.0))
    other = _features(pool).orderBy(F.xxhash64("doc_id"), "doc_id").limit(POOL_ROWS).toPandas()
    if not len(labelled) or not 0 < labelled["y"].mean() < 1:
        return None

    def arrays(frame, column: str, size: int) -> np.ndarray:
        return np.vstack([np.frombuffer(x, np.float32) for x in frame[column]]) if len(frame) else np.zeros((0, size), np.float32)

    calibrate = np.array([zlib.crc32(f"c:{i}".encode()) % 4 == 0 for i in labelled["doc_id"]])
    return cotrain(*(arrays(labelled, c, 1) for c in ("text_x", "meta_x")), labelled["y"].to_numpy(), calibrate, arrays(other, "text_x", TEXT_SIZE), arrays(other, "meta_x", META_SLOTS + 18))


def _features(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = batch.to_pydict()
            text = [text_features(t).tobytes() for t in d["text"]]
            meta = [meta_features(*m).tobytes() for m in zip(d["lang"], d["source"], d["n_chars"], strict=True)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["y"], pa.array(text, pa.binary()), pa.array(meta, pa.binary())], names=["doc_id", "y", "text_x", "meta_x"])

    return rows.select("doc_id", "y", "text", "lang", "source", "n_chars").mapInArrow(run, "doc_id long, y double, text_x binary, meta_x binary")


def score_quality(docs: DataFrame, model: dict | None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, text_score, meta_score, score, kept.

    All whole texts are scored. Null texts count as empty, null metadata as a value of its own; without a model all
    scores are null and all rows kept; kept means a score of 0.5 or more. Repeated rows give equal rows, an empty
    table an empty one, other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # three short vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = ["doc_id", "text_score", "meta_score", "score", "kept"]
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                if m is None:
                    nothing = pa.nulls(part.num_rows, pa.float64())
                    yield pa.RecordBatch.from_arrays([part.column(0), nothing, nothing, nothing, pa.array([True] * part.num_rows)], names=names)
                    continue
                d = part.to_pydict()
                t = margins(m["text"], np.vstack([text_features(x) for x in d["text"]]))
                e = margins(m["meta"], np.vstack([meta_features(*x) for x in zip(d["lang"], d["source"], d["n_chars"], strict=True)]))
                both = np.round(sigmoid(margins(m["combined"], np.stack([t, e], 1) / 4)), 6)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.round(sigmoid(t), 6)), pa.array(np.round(sigmoid(e), 6)), pa.array(both), pa.array(both >= 0.5)], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))
    return rows.mapInArrow(run, "doc_id long, text_score double, meta_score double, score double, kept boolean")
