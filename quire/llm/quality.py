"""Quality classifier by attention-based multiple-instance learning (op 5).

A document is a bag of passages (windows of ``PASSAGE`` bytes over the whole text).
Each passage is encoded from its character-class profile by a learned layer; gated
attention (tanh times sigmoid) weighs the passages, and the weighted mean passage is
scored. Only document labels are used to learn encoder, attention and score together.

Training uses a bounded sample: about ``TRAIN_DOCS`` labelled documents drawn by hash,
half of each class, weighted back to the classes' shares so that scores are
probabilities; every passage of each is learnt from, at most ``TRAIN_PASSAGES`` together. Scoring
reads every passage of every text in Arrow batches. Ids, sources and languages are
never features.

Null and empty texts are one empty passage and get a score like any other. Labels of
an id are averaged (0.5 counts as 1); labels that are null or have no document are
ignored. With labels of one class only, the score is that class; without any label it
is 1 (nothing is rejected). Repeated rows and null ids are scored row by row; extra
columns are ignored by ``quality_scores`` and kept by ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, written

PASSAGE = 384
THRESHOLD = 0.7
TRAIN_DOCS = 6_000
#: Passages of all documents learnt from, together; each is learnt from whole.
TRAIN_PASSAGES = 100_000
HIDDEN, ATTENTION = 32, 16
EPOCHS, BATCH, RATE = 12, 64, 0.005
#: Small samples are gone through more often, until so many batches.
MIN_STEPS = 800
SEED = 11
#: Bytes encoded at once.
SLICE = PASSAGE * 2048

# character classes: one per ASCII character with letters in lower case; upper-case letters, digits, control characters and UTF-8 bytes in groups
_FINE = np.zeros(256, np.int64)
_COARSE = np.zeros(256, np.int64)
_PAD = 0
for _b in range(256):
    _c = chr(_b)
    if _b == 0:
        _FINE[_b], _COARSE[_b] = 0, 0
    elif "a" <= _c <= "z":
        _FINE[_b], _COARSE[_b] = 1 + _b - 97, 1
    elif "A" <= _c <= "Z":
        _FINE[_b], _COARSE[_b] = 27, 2
    elif "0" <= _c <= "9":
        _FINE[_b], _COARSE[_b] = 28, 3
    elif _c == " ":
        _FINE[_b], _COARSE[_b] = 29, 4
    elif _b < 32 or _b == 127:
        _FINE[_b], _COARSE[_b] = 30, 5
    elif _b >= 192:
        _FINE[_b], _COARSE[_b] = 31, 6
    elif _b >= 128:
        _FINE[_b], _COARSE[_b] = 32, 6
    else:
        _FINE[_b], _COARSE[_b] = 33 + (_b - 33 if _b < 48 else _b - 43 if _b < 65 else _b - 69 if _b < 97 else _b - 95), 7
_N_FINE, _N_COARSE = int(_FINE.max()) + 1, 8
FEATURES = _N_FINE + _N_COARSE * _N_COARSE + 1


def passages(text: bytes | None) -> np.ndarray:
    """One row of features per passage: shares of character classes and of pairs of coarse classes, and how full the passage is."""
    data = text or b"\0"
    out = []
    for lo in range(0, len(data), SLICE):
        piece = np.frombuffer(data, np.uint8, min(SLICE, len(data) - lo), lo)
        n = -(-len(piece) // PASSAGE)
        grid = np.zeros(n * PASSAGE, np.uint8)
        grid[:len(piece)] = piece
        row = np.repeat(np.arange(n), PASSAGE)
        fine = np.bincount(row * _N_FINE + _FINE[grid], minlength=n * _N_FINE).reshape(n, _N_FINE).astype(np.float32)
        coarse = _COARSE[grid].reshape(n, PASSAGE)
        pairs = (np.arange(n)[:, None] * _N_COARSE * _N_COARSE + coarse[:, :-1] * _N_COARSE + coarse[:, 1:]).ravel()
        pair = np.bincount(pairs, minlength=n * _N_COARSE * _N_COARSE).reshape(n, -1).astype(np.float32)
        length = np.maximum(PASSAGE - fine[:, :1], 1)
        fine[:, 0] = 0
        pair[:, 0] = 0
        out.append(np.sqrt(np.hstack([fine / length, pair / length, length / PASSAGE])))
    return np.vstack(out)


class Model:
    """Gated-attention MIL network; plain arrays, a few kilobytes, sent to the tasks in the function's closure."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, rng: np.random.Generator):
        self.mean, self.scale = mean, scale
        init = lambda a, b: (rng.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        self.p = {"W": init(FEATURES, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "V": init(HIDDEN, ATTENTION), "U": init(HIDDEN, ATTENTION),
                  "w": init(ATTENTION, 1)[:, 0], "c": init(HIDDEN, 1)[:, 0], "d": np.zeros(1, np.float32)}

    def forward(self, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Logits of bags; bag i holds the rows of ``x`` from starts[i] on."""
        p = self.p
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * g) @ p["w"]
        sizes = np.diff(np.append(starts, len(x)))
        a = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
        a /= np.repeat(np.add.reduceat(a, starts), sizes)
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return z @ p["c"] + p["d"][0], (x, h, t, g, a, z, sizes)

    def gradients(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        logit, (x, h, t, g, a, z, sizes) = self.forward(x, starts)
        dl = weight * (1 / (1 + np.exp(-logit)) - y) / len(y)
        dz = np.repeat(dl[:, None] * p["c"], sizes, axis=0)
        da = (dz * h).sum(axis=1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, starts), sizes))
        dt, dg = de[:, None] * p["w"] * g * (1 - t * t), de[:, None] * p["w"] * t * g * (1 - g)
        dh = a[:, None] * dz + dt @ p["V"].T + dg @ p["U"].T
        dp = dh * (1 - h * h)
        return {"W": x.T @ dp, "b": dp.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de, "c": z.T @ dl, "d": dl.sum(keepdims=True)}

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        starts = np.cumsum([0, *[len(b) for b in bags[:-1]]])
        return 1 / (1 + np.exp(-self.forward(np.vstack(bags), starts)[0].astype(np.float64)))


def fit(bags: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, seed: int = SEED) -> Model:
    """Adam over mini-batches of documents."""
    rng = np.random.default_rng(seed)
    every = np.vstack(bags)
    model = Model(every.mean(axis=0), every.std(axis=0) + 0.02, rng)
    good = float((weights * labels).sum() / weights.sum())
    model.p["d"][0] = np.log(good / (1 - good))
    epochs = max(EPOCHS, -(-MIN_STEPS // -(-len(bags) // BATCH)))
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    v = {k: np.zeros_like(x) for k, x in model.p.items()}
    step = 0
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        order = rng.permutation(len(bags))
        for lo in range(0, len(order), BATCH):
            ids = order[lo:lo + BATCH]
            chosen = [bags[i] for i in ids]
            starts = np.cumsum([0, *[len(b) for b in chosen[:-1]]])
            step += 1
            for k, grad in model.gradients(np.vstack(chosen), starts, labels[ids], weights[ids]).items():
                grad = grad + 1e-4 * model.p[k]
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad * grad
                model.p[k] = (model.p[k] - rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return model


def held_out(id_col: str = "doc_id") -> Column:
    return crc_mod(id_col, 4) == 2


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, train_passages: int = TRAIN_PASSAGES, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality") -> Model | float:
    """Fits the model on a bounded sample of the labelled rows that are not held out; a constant if the labels do not allow more.

    About ``train_docs`` documents are drawn by a hash of their id. In that order they are taken with all
    their passages while these are at most ``train_passages`` together; a document that no longer fits is left out.
    """
    own = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("_y")).filter("_id IS NOT NULL AND _y IS NOT NULL")
    own = own.groupBy("_id").agg((F.avg("_y") >= 0.5).cast("int").alias("_y")).filter(~held_out("_id"))
    own = written(own, "quality-labels")
    classes = {r["_y"]: r["count"] for r in own.groupBy("_y").count().collect()}  # two rows
    if len(classes) < 2:
        return float(next(iter(classes), 1))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "_id"), 33) / F.lit(float(1 << 31))
    share = F.when(F.col("_y") == 1, train_docs / 2 / classes[1]).otherwise(train_docs / 2 / classes[0])
    sample = own.withColumns({"_draw": draw / share}).filter("_draw < 1")  # about train_docs rows
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("binary").alias("_text"))
    size = F.greatest(F.lit(1), F.ceil(F.coalesce(F.octet_length("_text"), F.lit(0)) / PASSAGE))
    sizes = texts.select("_id", size.alias("n")).join(F.broadcast(sample), "_id").groupBy("_id", "_draw").agg(F.sum("n").alias("n"))
    chosen, passages_left = [], train_passages
    for r in sorted(sizes.collect(), key=lambda r: (r["_draw"], r["_id"])):  # about train_docs rows of three numbers
        if r["n"] <= passages_left:
            chosen.append(r["_id"])
            passages_left -= r["n"]
    ids = docs.sparkSession.createDataFrame([(i,) for i in chosen], T.StructType([T.StructField("_id", own.schema["_id"].dataType)]))
    sample = F.broadcast(sample.join(F.broadcast(ids), "_id", "left_semi"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bags = [passages(t.as_py()).astype("<f4").tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(bags, pa.binary())], names=["id", "y", "bag"])

    src = texts.join(sample, "_id").select("_id", "_text", "_y")
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("y", T.IntegerType()), T.StructField("bag", T.BinaryType())])
    rows = src.mapInArrow(encode, schema).collect()  # the bounded sample
    if len({r["y"] for r in rows}) < 2:
        return float(next(iter({r["y"] for r in rows}), 1))
    rows.sort(key=lambda r: (r["id"], bytes(r["bag"])))
    bags = [np.frombuffer(r["bag"], "<f4").reshape(-1, FEATURES) for r in rows]
    y = np.array([r["y"] for r in rows], np.float32)
    drawn = {k: max(1, int((y == k).sum())) for k in (0, 1)}
    total = classes[0] + classes[1]
    weights = np.array([classes[int(k)] / total * len(y) / drawn[int(k)] for k in y], np.float32)
    return fit(bags, y, weights, seed)


def quality_scores(docs: DataFrame, model: Model | float, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, score (0 to 1), predicted (1 from ``threshold`` on)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = []
            for t in b.column(1):
                scores.append(float(model.score([passages(t.as_py())])[0]) if isinstance(model, Model) else model)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], names=["id", "score"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("score", T.DoubleType())])
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, schema)
    return out.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model | float, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose score is under ``threshold``; columns unchanged, no shuffle."""
    if not isinstance(model, Model):
        return docs if model >= threshold else docs.limit(0)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).cast(pa.binary())
            good = [model.score([passages(t.as_py())])[0] >= threshold for t in texts]
            yield b.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
