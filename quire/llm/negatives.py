"""Hard-negative mining by slot-decomposed selection (op 11).

Scores are inner products of whole numbers, floor(scale * x) of every component. An
anchor's positives are its ``k`` best other rows of its label. Each positive of score u
asks for the ``k`` best rows of other labels with lower(u) <= score <= u, where lower(u)
is the least whole number of at least 80 % of u. These windows overlap; the upper limits
of an anchor's positives cut its scores into disjoint slots instead. A row falls into one
slot only, every block of rows keeps the best ``k`` of each slot, and so does the merge of
all blocks. The window of the j-th limit is answered by slots j, j + 1, ... in descending
order: its best k rows are the first k of that suffix, less those under lower(u).

Both passes compare all anchors with all rows in blocks of bounded bytes: an anchor block
and a row block meet in one cogroup, which scores them tile by tile and lets at most
k rows per anchor (and slot) out. Blocks are packed once, as arrays of 16-bit numbers
where they fit, and written.

Rows with a null id, label or vector, or with a component that is null or not finite,
take no part. Vectors of different lengths do not meet. Rows equal in id, label and vector
are one row; different rows of one id all take part, and an anchor's other rows are those
of other ids. A score beyond the range of a long is the end of that range. Extra columns
are ignored, names may hold dots. An empty table, or one without positives, gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

K = 5
SCALE = 256
#: Bytes of the numbers (8 each) of a block of anchors, and of a block of rows.
ANCHOR_BYTES = 64 << 20
ROW_BYTES = 16 << 20
#: Scores held at once.
TILE = 1 << 21
_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def _packed(rows: DataFrame, block: Column) -> DataFrame:
    """(block, dim, base, ids, labels, numbers): the rows of a block as arrays; ``base`` counts rows before.

    Each vector length is a row of its own, and so are vectors whose numbers do not fit 16 bits.
    """

    def run(table: pa.Table) -> pa.Table:
        out, base = [], 0
        vec = table.column("vec").combine_chunks()
        lengths = pc.list_value_length(vec).to_numpy(zero_copy_only=False)
        ids, labels = table.column("id").to_numpy(), table.column("label").to_numpy()
        for dim in np.unique(lengths).astype(int).tolist():
            at = np.flatnonzero(lengths == dim)
            flat = pc.list_flatten(vec.take(pa.array(at))).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), dim)
            at, flat = at[np.isfinite(flat).all(axis=1)], flat[np.isfinite(flat).all(axis=1)]
            with np.errstate(over="ignore"):
                q = np.nan_to_num(np.floor(SCALE * flat))
            if len(np.unique(ids[at])) < len(at):
                first = {(i, lab, x.tobytes()): n for n, (i, lab, x) in reversed(list(enumerate(zip(ids[at].tolist(), labels[at].tolist(), q, strict=True))))}
                one = np.sort(np.fromiter(first.values(), np.int64, len(first)))
                at, q = at[one], q[one]
            small = np.abs(q).max(axis=1, initial=0) < 1 << 15
            for mine, kind in ((small, "<i2"), (~small, "<f8")):
                if mine.any():
                    out.append((_block(table), dim, base, ids[at[mine]].astype("<i8").tobytes(), labels[at[mine]].astype("<i8").tobytes(), q[mine].astype(kind).tobytes()))
                    base += int(mine.sum())
        names = ["block", "dim", "base", "ids", "labels", "numbers"]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table({n: pa.array([r[i] for r in out], t) for i, (n, t) in enumerate(zip(names, types, strict=True))})

    return (rows.withColumn("block", block).groupBy("block")
            .applyInArrow(run, "block bigint, dim int, base bigint, ids binary, labels binary, numbers binary"))


def _block(table: pa.Table) -> int:
    return table.column("block")[0].as_py()


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, labels = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8")
    wide = len(row["numbers"]) == 8 * row["dim"] * len(ids)
    return ids, labels, np.frombuffer(row["numbers"], "<f8" if wide else "<i2").reshape(len(ids), row["dim"])


def _scores(a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Inner products as 64-bit integers: in doubles where every sum is exact in them, else in whole numbers of any size."""
    if a.shape[1] == 0:
        return np.zeros((len(a), len(r)), np.int64)
    if a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(r).max(initial=0)) < 2.0**53:
        return (a.astype(np.float64) @ r.astype(np.float64).T).astype(np.int64)
    whole = [[int(x) for x in v] for v in r.tolist()]
    return np.array([[min(_MOST, max(_LEAST, sum(int(x) * y for x, y in zip(v, w, strict=True)))) for w in whole] for v in a.tolist()], np.int64).reshape(len(a), len(r))


def lower(u):
    """The least whole number n with 80 * u <= 100 * n."""
    return u - u // 5


def _first(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best of every group: higher scores, then smaller ids."""
    order = np.lexsort((ids, ~score, group))  # ~score descends without overflow
    group = group[order]
    return order[np.arange(len(group)) - np.searchsorted(group, group) < k]


def _best(scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, row) of the ``k`` best allowed rows of every anchor."""
    if scores.shape[1] > k:
        bar = np.partition(np.where(allowed, scores, _LEAST), -k, axis=1)[:, -k]
        allowed = allowed & (scores >= bar[:, None])
    ai, ri = np.nonzero(allowed)
    keep = _first(ai, scores[ai, ri], ids[ri], k)
    return ai[keep], ri[keep]


def _meet(anchors: DataFrame, rows: DataFrame, n_anchor_blocks: int, n_row_blocks: int, kernel, schema: str) -> DataFrame:
    """``kernel`` over every pair of an anchor block and a row block."""
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    a = anchors.withColumnRenamed("block", "ab").withColumn("rb", numbers(n_row_blocks))
    r = rows.withColumnRenamed("block", "rb").withColumn("ab", numbers(n_anchor_blocks))
    names = [c.split()[0] for c in schema.split(", ")]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = [[] for _ in names]
        for x in left.to_pylist():
            for y in right.to_pylist():
                if x["dim"] == y["dim"]:
                    for found in kernel(x, y):
                        for p, c in zip(parts, found, strict=True):
                            p.append(c)
        return pa.table({n: pa.array(np.concatenate(p) if p else np.array([], np.int64), pa.int64()) for n, p in zip(names, parts, strict=True)})

    return a.groupBy("ab", "rb").cogroup(r.groupBy("ab", "rb")).applyInArrow(run, schema)


def _top(df: DataFrame, groups: list[str], id_col: str, k: int) -> DataFrame:
    """The first ``k`` rows of each group; each task keeps k of a group before the shuffle."""
    w = Window.partitionBy(*groups).orderBy(F.col("score").desc(), id_col)
    return df.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                   anchor_bytes: int = ANCHOR_BYTES, row_bytes: int = ROW_BYTES) -> DataFrame:
    """One row per anchor, positive and rank: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor`` is a condition on ``rows``; labels and ids are whole numbers.
    """
    src = rows.filter(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{label_col}`").isNotNull() & F.col(f"`{vec_col}`").isNotNull()).select(
        F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{label_col}`").cast("bigint").alias("label"), F.col(f"`{vec_col}`").alias("vec"),
        F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    size = src.agg(F.count("*").alias("n"), F.count_if("asks").alias("a"), F.max(F.size("vec")).alias("dim")).first()
    n_row_blocks = max(1, -(-size["n"] * 8 * max(1, size["dim"] or 1) // row_bytes))
    n_anchor_blocks = max(1, -(-size["a"] * 8 * max(1, size["dim"] or 1) // anchor_bytes))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
    packed_rows = written(_packed(src.drop("asks"), dealt(n_row_blocks)), "row-blocks")
    packed_anchors = written(_packed(src.filter("asks").drop("asks"), dealt(n_anchor_blocks)), "anchor-blocks")

    def positives_of(x: dict, y: dict):
        a_ids, a_labels, a = _unpacked(x)
        r_ids, r_labels, r = _unpacked(y)
        for label in np.unique(a_labels):
            mine, theirs = np.flatnonzero(a_labels == label), np.flatnonzero(r_labels == label)
            step = max(1, TILE // max(1, len(theirs)))
            for lo in range(0, len(mine) if len(theirs) else 0, step):
                part = mine[lo:lo + step]
                s = _scores(a[part], r[theirs])
                ai, ri = _best(s, r_ids[theirs], a_ids[part][:, None] != r_ids[theirs][None, :], k)
                place = part[ai]
                yield np.full(len(ai), x["ab"]), x["base"] + place, a_ids[place], r_ids[theirs[ri]], s[ai, ri]

    schema = "ab bigint, anchor bigint, anchor_id bigint, positive_id bigint, score bigint"
    positives = _top(_meet(packed_anchors, packed_rows, n_anchor_blocks, n_row_blocks, positives_of, schema), ["ab", "anchor"], "positive_id", k)
    limits = Window.partitionBy("ab", "anchor").orderBy(F.col("score").desc())
    positives = written(positives.withColumn("slot", F.dense_rank().over(limits) - 1), "positives")
    by_block = positives.groupBy(F.col("ab").alias("block")).agg(F.collect_list(F.struct("anchor", "slot", "score")).alias("limits"))  # k per anchor of a block
    asking = packed_anchors.join(by_block, "block")

    def negatives_of(x: dict, y: dict):
        a_ids, a_labels, a = _unpacked(x)
        r_ids, r_labels, r = _unpacked(y)
        limit = np.full((len(a_ids), k), _LEAST, np.int64)  # upper limits of an anchor's slots, descending
        slots = np.zeros(len(a_ids), np.int64)
        for p in x["limits"]:
            i = p["anchor"] - x["base"]
            if 0 <= i < len(a_ids):
                limit[i, p["slot"]] = p["score"]
                slots[i] = max(slots[i], p["slot"] + 1)
        asks = np.flatnonzero(slots)
        step_r = min(len(r_ids), 4096)
        step = max(1, TILE // step_r)
        for lo in range(0, len(asks), step):
            part = asks[lo:lo + step]
            up, least = limit[part], lower(limit[part, slots[part] - 1])
            kept: list[tuple] = []
            for at in range(0, len(r_ids), step_r):
                s = _scores(a[part], r[at:at + step_r])
                ai, ri = np.nonzero((s <= up[:, :1]) & (s >= least[:, None]) & (a_labels[part][:, None] != r_labels[None, at:at + step_r]))
                score = s[ai, ri]
                slot = (up[ai] >= score[:, None]).sum(axis=1) - 1
                slot = np.minimum(slot, slots[part][ai] - 1)
                inside = score >= lower(up[ai, slot])
                kept.append((ai[inside], slot[inside], score[inside], r_ids[at + ri[inside]]))
                if sum(len(t[0]) for t in kept) > TILE:
                    kept = [_combined(kept, k)]
            ai, slot, score, ids = _combined(kept, k)
            yield np.full(len(ai), x["ab"]), x["base"] + part[ai], slot, score, ids

    schema = "ab bigint, anchor bigint, slot bigint, score bigint, negative_id bigint"
    best = _top(_meet(asking, packed_rows, n_anchor_blocks, n_row_blocks, negatives_of, schema), ["ab", "anchor", "slot"], "negative_id", k)
    # all slots of an anchor, at most k * k rows, in descending order of scores
    ordered = best.groupBy("ab", "anchor").agg(F.sort_array(F.collect_list(F.struct("slot", "place", "negative_id", "score"))).alias("slots"))
    # the first k of the suffix of slots, less those under the window's lower limit
    inside = F.expr(f"filter(slice(filter(slots, s -> s.slot >= slot), 1, {k}), s -> s.score >= positive_score - (positive_score - pmod(positive_score, 5)) div 5)")
    answers = positives.withColumnRenamed("score", "positive_score").join(ordered, ["ab", "anchor"]).select("anchor_id", "positive_id", "positive_score", F.posexplode(inside).alias("at", "hit"))
    return answers.select("anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.negative_id").alias("negative_id"), "positive_score", F.col("hit.score").alias("negative_score"))


def _combined(found: list[tuple], k: int) -> tuple[np.ndarray, ...]:
    """The ``k`` best rows of every anchor's slot."""
    ai, slot, score, ids = (np.concatenate(c) for c in zip(*found, strict=True))
    keep = _first(ai * np.int64(k + 1) + slot, score, ids, k)
    return ai[keep], slot[keep], score[keep], ids[keep]
