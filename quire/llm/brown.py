"""Language-model scoring with Brown class bigrams (op 6).

``P(w | previous) = P(class(w) | class(previous)) * P(w | class(w))``. Words are
lower-cased between white space; every text ends with one end token, which also
precedes the first word. All counts are taken over all training texts.

Every word of the training texts has a class. The ``WORDS`` most frequent ones are
clustered by exchange: bigrams of these seeds, of one unit for all other words and of
the end token are counted, and a seed is moved to the class that raises the likelihood
most until a sweep moves none. Each other word then goes, by its own counts of left and
right neighbours' classes, to the class where the exchange gains most; the gain is taken to first
order, as such a word is a small part of any class. That is one grouped aggregate over
(word, neighbour's class) and one over words, so the table of classes grows with the
corpus and no word needs more than two counts per class. Words are placed once, against the seeds' classes.

A word not seen in training belongs to the class with the most words seen once, as one
more word of count zero; ``P(w | class)`` is ``(c + 0.1) / (N + 0.1 V)`` inside a class.

Each text becomes its sequence of classes (a byte a token). The at most ``LOOKUP`` most
frequent words are in a bounded table in memory, the other words' classes and counts
are joined by word. Class bigrams are counted from the sequences, and the sequences are scored.

A null text is empty and has the end token alone. Rows with a null id are held out.
Repeated rows are separate documents. Without training texts all counts are zero and
scores stay defined. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, written

WORDS, CLASSES = 768, 64
LOOKUP = 200_000
#: Longer words are never in the lookup table, which bounds its bytes.
LOOKUP_BYTES = 64
DELTA = 0.1
SWEEPS = 8
#: Distinct words a counting task holds before it hands them on.
HELD = 500_000
#: Neighbours a task holds before it counts them and hands them on.
HELD_TOKENS = 500_000
#: Mark of a token whose class is not known yet.
RARE = 255


def held_out(id_col: str = "doc_id") -> Column:
    return crc_mod(id_col, 10) == 0


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) of all texts, without the end token; partial counts are made in the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def emit() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "c"])
            seen.clear()
            return out

        for b in batches:
            for t in b.column(0):
                seen.update((t.as_py() or b"").lower().split())
                if len(seen) > HELD:
                    yield emit()
        if seen:
            yield emit()

    return texts.mapInArrow(run, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def most_frequent(classed: DataFrame) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Words, counts and classes of at most ``LOOKUP`` words of at most ``LOOKUP_BYTES``: all those above a count.

    The count is read from a histogram over sixteenths of powers of two (a thousand
    rows at most), so no task sends more than its share of the table.
    """
    step = F.floor(F.log2("c") * 16)
    short = classed.filter(F.length("word") <= LOOKUP_BYTES)
    least, held = None, 0
    for r in sorted(short.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        held += r["count"]
        if held > LOOKUP:
            break
        least = r["step"]
    if least is None:
        return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = short.filter(step >= least).select("word", "c", "cls").toArrow()
    return found.column("word").to_pylist(), found.column("c").to_numpy(), found.column("cls").to_numpy()


def clustered(counts: DataFrame) -> list[tuple[bytes, int]]:
    """The ``WORDS`` seeds, by count, then word; apart from the lookup table, so its size changes no score."""
    short = counts.filter(F.length("word") <= LOOKUP_BYTES)
    return [(bytes(r["word"]), r["c"]) for r in short.orderBy(F.desc("c"), "word").limit(WORDS).collect()]


def unit_bigrams(texts: DataFrame, words: list[bytes]) -> np.ndarray:
    """Counts of unit pairs over all texts; units are ``words``, all other words as one, and last the end token."""
    other, end = len(words), len(words) + 1
    n = end + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = {w: i for i, w in enumerate(words)}.get
        total = np.zeros(n * n, np.int64)
        codes: list[np.ndarray] = []
        held = 0

        def add() -> None:
            nonlocal held
            if codes:
                total[:] += np.bincount(np.concatenate(codes), minlength=n * n)
            codes.clear()
            held = 0

        for b in batches:
            for t in b.column(0):
                both = np.array([end, *[unit(w, other) for w in (t.as_py() or b"").lower().split()], end], np.int64)
                codes.append(both[:-1] * n + both[1:])
                held += len(both)
                if held > 2_000_000:
                    add()
        add()
        some = np.flatnonzero(total)
        for lo in range(0, len(some), 100_000):
            at = some[lo:lo + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["code", "n"])

    return _cells(texts.mapInArrow(run, "code bigint, n bigint"), n)


def _cells(rows: DataFrame, n: int) -> np.ndarray:
    """An n x n matrix from its cells (code, n), summed; n is at most ``WORDS`` + 2."""
    out = np.zeros(n * n)
    found = rows.groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    out[found.column("code").to_numpy()] = found.column("n").to_numpy()
    return out.reshape(n, n)


def contexts(texts: DataFrame, words: list[bytes], of: np.ndarray) -> DataFrame:
    """(word, code, n) of every word but ``words``: how often its left neighbour has class ``code``, or its right one class ``code - width``.

    ``of`` has the classes of ``words``, of all other words, and of the end token, which is the last class.
    """
    width = int(of[-1]) + 1
    other, end = int(of[-2]), int(of[-1])
    known = dict(zip(words, of[:-2].tolist(), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = known.get
        found: list[bytes] = []
        sides: list[np.ndarray] = []

        def emit() -> pa.RecordBatch:
            coded = pa.array(found, pa.binary()).dictionary_encode()
            at = coded.indices.to_numpy().astype(np.int64) * (2 * width)
            side = np.concatenate(sides, axis=1)
            code, n = np.unique(np.concatenate([at + side[0], at + side[1] + width]), return_counts=True)
            found.clear()
            sides.clear()
            return pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(code // (2 * width))), pa.array((code % (2 * width)).astype(np.int32)),
                                               pa.array(n.astype(np.int64))], names=["word", "code", "n"])

        for b in batches:
            for t in b.column(0):
                toks = (t.as_py() or b"").lower().split()
                cls = np.array([end, *[get(w, other) for w in toks], end], np.int64)
                at = np.flatnonzero(cls == other)
                found.extend([toks[i] for i in (at - 1).tolist()])
                sides.append(np.stack([cls[at - 1], cls[at + 1]]))
                if len(found) > HELD_TOKENS:
                    yield emit()
        if found:
            yield emit()

    return texts.mapInArrow(run, "word binary, code int, n bigint").groupBy("word", "code").agg(F.sum("n").alias("n"))


def placed(found: DataFrame, weights: np.ndarray) -> DataFrame:
    """(word, c, cls) of the words in ``contexts``: the class of the greatest gain, the smallest among equal ones."""
    width = len(weights) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = b.column(1)
            sizes = np.diff(cells.offsets.to_numpy())
            flat = cells.flatten()
            x = np.zeros((b.num_rows, 2 * width))
            x[np.repeat(np.arange(b.num_rows), sizes), flat.field("code").to_numpy()] = flat.field("n").to_numpy()
            cls = np.round(x @ weights, 6).argmax(axis=1)
            c = x[:, :width].sum(axis=1).astype(np.int64)  # each occurrence has one left neighbour
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(c), pa.array(cls.astype(np.int32))], names=["word", "c", "cls"])

    cells = found.groupBy("word").agg(F.collect_list(F.struct("code", "n")).alias("cells"))  # at most two cells per class
    return cells.mapInArrow(run, "word binary, c bigint, cls int")


def gains(bigrams: np.ndarray, of: np.ndarray, classes: int) -> np.ndarray:
    """Per neighbour's class (left ones, then right ones) and class: what one occurrence beside it adds to the likelihood there."""
    k = int(of[-1]) + 1
    member = np.zeros((len(of), k))
    member[np.arange(len(of)), of] = 1
    pairs = member.T @ bigrams @ member + DELTA
    left = np.log(pairs) - np.log(pairs.sum(axis=0))
    right = (np.log(pairs) - np.log(pairs.sum(axis=1, keepdims=True))).T
    return np.concatenate([left, right])[:, :classes]


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(bigrams: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS, kept: int = 1) -> np.ndarray:
    """Class of each unit. The last ``kept`` units keep the classes from ``classes`` on; the others move between 0 and classes - 1.

    Starts with units dealt in turn by frequency. The likelihood of a class bigram model
    is, up to a constant, the sum of n log n over class pairs less that over the left and
    the right class counts.
    """
    n = len(bigrams)
    k = classes + kept
    order = np.argsort(-bigrams.sum(axis=0)[:-kept], kind="stable")
    of = np.empty(n, np.int64)
    of[order] = np.arange(n - kept) % classes
    of[n - kept:] = classes + np.arange(kept)
    member = np.zeros((n, k))
    member[np.arange(n), of] = 1
    to_class, from_class = bigrams @ member, member.T @ bigrams  # unit -> class of the next; class of the previous -> unit
    pairs = member.T @ to_class
    at = np.arange(classes)
    for _ in range(sweeps):
        moved = 0
        for u in order:
            own = bigrams[u, u]
            c = of[u]
            right, left = to_class[u].copy(), from_class[:, u].copy()
            if right.sum() + left.sum() == 0:
                continue
            right[c] -= own
            left[c] -= own
            # take u out of its class
            pairs[c] -= right
            pairs[:, c] -= left
            pairs[c, c] -= own
            rows, cols = pairs.sum(axis=1), pairs.sum(axis=0)
            gain = (_xlogx(pairs[:classes] + right) - _xlogx(pairs[:classes])).sum(axis=1)
            gain += (_xlogx(pairs[:, :classes].T + left) - _xlogx(pairs[:, :classes].T)).sum(axis=1)
            both = pairs[at, at]
            gain += _xlogx(both + right[:classes] + left[:classes] + own) - _xlogx(both + right[:classes]) - _xlogx(both + left[:classes]) + _xlogx(both)
            out, into = right.sum() + own, left.sum() + own
            gain -= _xlogx(rows[:classes] + out) - _xlogx(rows[:classes]) + _xlogx(cols[:classes] + into) - _xlogx(cols[:classes])
            best = int(np.argmax(gain))
            if gain[best] <= gain[c] + 1e-9:
                best = c
            pairs[best] += right
            pairs[:, best] += left
            pairs[best, best] += own
            if best != c:
                moved += 1
                of[u] = best
                to_class[:, c] -= bigrams[:, u]
                to_class[:, best] += bigrams[:, u]
                from_class[c] -= bigrams[u]
                from_class[best] += bigrams[u]
        if not moved:
            break
    return of


@lru_cache(maxsize=1)
def _table(load: _Loader) -> tuple[dict, np.ndarray, np.ndarray, np.ndarray]:
    return pickle.loads(load.value)


class _Loader:
    """A broadcast that is equal by a number of its own, so that a worker unpacks it once."""

    def __init__(self, broadcast: Broadcast):
        self.broadcast, self.number = broadcast, uuid.uuid4().int

    @property
    def value(self) -> bytes:
        return self.broadcast.value

    def __hash__(self) -> int:
        return hash(self.number)

    def __eq__(self, other) -> bool:
        return self.number == other.number


def classes_of(texts: DataFrame, counts: DataFrame, classes: int = CLASSES) -> DataFrame:
    """(word, c, cls) of every word of ``texts``, a written table that grows with them."""
    spark = texts.sparkSession
    seeds = clustered(counts)
    words = [w for w, _ in seeds]
    bigrams = unit_bigrams(texts, words)
    of = exchange(bigrams, classes, kept=2)
    first = spark.createDataFrame([(w, c, int(k)) for (w, c), k in zip(seeds, of, strict=False)], "word binary, c bigint, cls int")
    return written(first.unionByName(placed(contexts(texts, words, of), gains(bigrams, of, classes))), "word-classes")


def sequences(docs: DataFrame, words: DataFrame, base_of: float, within: np.ndarray, unseen: int, end: int) -> DataFrame:
    """Per row of (id, learnt, text): n tokens, known, base, emit (sums of log10, without the end token) and seq, a byte per token's class.

    ``within`` is the denominator of each class; ``unseen`` the class of words that ``words`` does not have.
    """
    top, c, cls = most_frequent(words)
    data = ({w: i for i, w in enumerate(top)}, cls.astype(np.uint8), np.log10((c + DELTA) / base_of), np.log10((c + DELTA) / within[cls]))
    loader = _Loader(docs.sparkSession.sparkContext.broadcast(pickle.dumps(data, 5)))
    rare_type = pa.struct([("at", pa.int32()), ("word", pa.binary())])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, cls_of, base_log, emit_log = _table(loader)
        get = index.get
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            offsets, at, rare = [0], [], []
            for t in b.column(2):
                toks = (t.as_py() or b"").lower().split()
                ids = np.array([get(w, -1) for w in toks], np.int64)
                hit = ids[ids >= 0]
                seq = np.full(len(ids), RARE, np.uint8)
                seq[ids >= 0] = cls_of[hit]
                miss = np.flatnonzero(ids < 0)
                at.append(miss)
                rare.extend([toks[i] for i in miss.tolist()])
                offsets.append(len(rare))
                for col, value in zip(cols, (len(ids) + 1, len(hit), float(base_log[hit].sum()), float(emit_log[hit].sum()), seq.tobytes()), strict=True):
                    col.append(value)
            miss = np.concatenate(at) if at else np.zeros(0, np.int64)
            structs = pa.StructArray.from_arrays([pa.array(miss.astype(np.int32)), pa.array(rare, pa.binary())], fields=list(rare_type))
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(x, k) for x, k in zip(cols, kinds, strict=True)],
                                              pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs)],
                                             names=["id", "learnt", "n", "known", "base", "emit", "seq", "rare"])

    rare_cells = T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("word", T.BinaryType())]))
    schema = T.StructType([docs.schema["id"], T.StructField("learnt", T.BooleanType()), T.StructField("n", T.LongType()), T.StructField("known", T.LongType()),
                           T.StructField("base", T.DoubleType()), T.StructField("emit", T.DoubleType()), T.StructField("seq", T.BinaryType()), T.StructField("rare", rare_cells)])
    found = written(docs.mapInArrow(look_up, schema).withColumn("row", F.monotonically_increasing_id()), "sequences")  # written, so a row keeps its number

    # words outside the lookup table: class and count by join, the class of unseen words and 0 if not learnt
    rare = found.select("row", F.inline("rare")).join(words, "word", "left")
    count, k = F.coalesce("c", F.lit(0)) + DELTA, F.coalesce("cls", F.lit(unseen))
    of_class = F.element_at(F.array(*[F.lit(float(x)) for x in within]), k + 1)
    rare = rare.groupBy("row").agg(F.sum(F.log10(count / F.lit(float(base_of)))).alias("rare_base"), F.sum(F.log10(count / of_class)).alias("rare_emit"),
                                   F.count("c").alias("rare_known"), F.collect_list(F.struct("at", k.alias("cls"))).alias("cells"))  # at most the text's own tokens

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for seq, cells in zip(b.column(6), b.column(7), strict=True):
                one = np.frombuffer(seq.as_py() + bytes([end]), np.uint8).copy()
                if cells.is_valid:
                    one[cells.values.field("at").to_numpy()] = cells.values.field("cls").to_numpy()
                out.append(one.tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(out, pa.binary())], names=b.schema.names[:7])

    def plus(a: str, b: str, none) -> Column:
        return (F.col(a) + F.coalesce(b, F.lit(none))).alias(a)

    joined = found.join(rare, "row", "left").select("id", "learnt", "n", plus("known", "rare_known", 0), plus("base", "rare_base", 0.0),
                                                    plus("emit", "rare_emit", 0.0), "seq", "cells")
    return written(joined.mapInArrow(fill, T.StructType(schema.fields[:7])), "classed")


def class_bigrams(seqs: DataFrame, classes: int) -> np.ndarray:
    """Counts of class pairs over (seq), each of which starts behind an end token."""
    k = classes + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k, np.int64)
        for b in batches:
            for s in b.column(0):
                seq = np.frombuffer(s.as_py(), np.uint8).astype(np.int64)
                total += np.bincount(np.concatenate([[classes], seq[:-1]]) * k + seq, minlength=k * k)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k)), pa.array(total)], names=["code", "n"])

    return _cells(seqs.mapInArrow(run, "code bigint, n bigint"), k)


def scores(docs: DataFrame, train: Column | None = None, id_col: str = "doc_id", text_col: str = "text", classes: int = CLASSES) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probability of the text), perplexity.

    ``train`` marks the rows to learn from (default: those not held out). At most 250 classes.
    """
    if not 0 < classes <= 250:
        raise ValueError("1 to 250 classes")
    learnt = F.coalesce(~held_out(id_col) if train is None else train, F.lit(False))
    rows = docs.select(F.col(id_col).alias("id"), learnt.alias("learnt"), F.col(text_col).cast("binary").alias("text"))
    texts = rows.filter("learnt").select("text")
    counts = written(word_counts(texts), "word-counts")
    n_texts = texts.count()
    sums = counts.agg(F.sum("c"), F.count("*")).first()
    n_all, v_all = (sums[0] or 0) + n_texts, sums[1] + (n_texts > 0)
    base_of = n_all + DELTA * (v_all + 1)
    words = classes_of(texts, counts, classes)

    # denominators of P(w | class); the end token is alone in the last class
    within, once = np.zeros(classes + 1), np.zeros(classes)
    for r in words.groupBy("cls").agg(F.sum("c").alias("c"), F.count("*").alias("v"), F.count_if(F.col("c") == 1).alias("once")).collect():  # a row per class
        within[r["cls"]], once[r["cls"]] = r["c"] + DELTA * r["v"], r["once"]
    unseen = int(once.argmax())
    within[unseen] += DELTA
    classed = sequences(rows, words, base_of, within, unseen, classes)
    pairs = class_bigrams(classed.filter("learnt").select("seq"), classes)
    trans = np.log10((pairs + DELTA) / (pairs.sum(axis=1, keepdims=True) + DELTA * (classes + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for s, emit in zip(b.column(4), b.column(5).to_pylist(), strict=True):
                seq = np.frombuffer(s.as_py(), np.uint8)
                out.append(emit + float(trans[np.concatenate([[classes], seq[:-1]]), seq].sum()))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(out, pa.float64())], names=["id", "n", "known", "base", "score"])

    schema = T.StructType([classed.schema["id"], T.StructField("n", T.LongType()), T.StructField("known", T.LongType()), T.StructField("base", T.DoubleType()),
                           T.StructField("score", T.DoubleType())])
    base_end = float(np.log10((n_texts + DELTA) / base_of))
    out = classed.select("id", "n", "known", "base", "seq", "emit").mapInArrow(run, schema)
    score = F.col("score")
    return out.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), F.col("n").alias("n_tokens"), (F.col("known") + int(n_texts > 0)).alias("n_known"),
                      F.lit(n_all).cast("bigint").alias("train_tokens"), (F.col("base") + base_end).alias("base_score"), score.alias("score"),
                      F.pow(F.lit(10.0), -score / F.col("n")).alias("perplexity"))
