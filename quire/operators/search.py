"""Similarity search: top-k nearest stored vectors per question (JN1, WN1, ST1).

Strategy (``nearest``): the question matrix is small and size-checked, so it is
broadcast once; every store partition is scanned exactly once by a
``mapInArrow`` kernel that multiplies the question block by each Arrow batch
(one numpy matmul per tile), applies the per-question filters as a boolean
mask and keeps, per question, the batch's k nearest rows by (distance, id) —
so the global tie-break by id stays exact and no batch ever emits more than k
rows per question, however many rows tie. At most (batches x questions x k)
rows leave the kernel, and Spark's partial ``WindowGroupLimit`` cuts that to
(partitions x questions x k) before the shuffle; the final top-k is a
``row_number`` window per question, which Catalyst turns into a partial
``WindowGroupLimit`` before the shuffle and a final one after it.

No pair table is ever materialised and there is no join between questions and
the store. A question set larger than ``max_block_bytes`` is not broadcast: blocks
of questions and blocks of the store meet in cogroups (``grouped_top_k``), with one
scan of the store.

Global filters (metadata predicates, time ranges) are ordinary ``filter``
calls on the store *before* the kernel, so Catalyst pushes them into the
Parquet scan and prunes partitions. Per-question filters (sender / addressee /
time window differing by question) are evaluated inside the kernel.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import cosine_distance

# Budget for one broadcast question block and for one in-kernel score tile.
DEFAULT_BLOCK_BYTES = 128 << 20
TILE_ELEMENTS = 1_000_000


@dataclass(frozen=True)
class QuestionFilter:
    """Per-question filter evaluated inside the search kernel.

    ``equals`` maps a store column to the question column holding the wanted
    value; null question values are skipped and the present ones are combined
    with ``combine`` ("or" as the question processor does, or "and"). All
    question values null means no equality filter. ``time_col`` is tested
    against ``[start_col, end_col)``; a null end is open; both null = no filter.
    """

    equals: tuple[tuple[str, str], ...] = ()
    combine: str = "or"
    time_col: str | None = None
    start_col: str | None = None
    end_col: str | None = None
    start_inclusive: bool = True
    end_inclusive: bool = False
    part_col: str | None = "week_start"  # partition column derived from time_col, pruned by the block envelope

    def store_columns(self) -> list[str]:
        cols = [s for s, _ in self.equals]
        if self.time_col:
            cols.append(self.time_col)
        return cols

    def question_columns(self) -> list[str]:
        cols = [q for _, q in self.equals]
        cols += [c for c in (self.start_col, self.end_col) if c]
        return cols


def top_k_per_group(df: DataFrame, k: int, group: str = "query_id", order=("distance", "id"), rank_col: str = "rank") -> DataFrame:
    """WN1: keep the first k rows of each group by ``order`` (ties broken by the later keys)."""
    w = Window.partitionBy(group).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)


def nearest_one(store: DataFrame, vector, k: int = 5, vec_col: str = "embedding", id_col: str = "id",
                norm_col: str | None = None) -> DataFrame:
    """ST1: nearest-first top-k for a single question vector, all in SQL expressions.

    ``vector`` is a Column (e.g. ``F.lit`` of a list) or a python list; the plan
    becomes ``TakeOrderedAndProject`` (a per-partition top-k, then a merge).
    """
    q = F.array(*[F.lit(float(x)) for x in vector]) if isinstance(vector, (list, tuple, np.ndarray)) else vector
    dist = cosine_distance(F.col(vec_col), q, a_norm=F.col(norm_col) if norm_col else None)
    return (store.withColumn("distance", dist)
            .filter(F.col("distance").isNotNull())
            .orderBy(F.col("distance").asc(), F.col(id_col).asc())
            .limit(k)
            .drop(vec_col))


def _to_micros(arr: pa.Array) -> np.ndarray:
    """Timestamp/date Arrow array -> int64 microseconds with nulls as int64 min."""
    if pa.types.is_date32(arr.type):
        arr = pc.cast(pc.cast(arr, pa.timestamp("us")), pa.int64())
    elif pa.types.is_timestamp(arr.type):
        arr = pc.cast(pc.cast(arr, pa.timestamp("us")), pa.int64())
    else:
        arr = pc.cast(arr, pa.int64())
    return arr.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)


def select_top_k(dist: np.ndarray, ids, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(question index, row index) of each question's k nearest rows by (distance, id); inf = excluded.

    Vectorised: partition to the k-th distance, then one lexsort over the few
    candidates and a per-question position cut, so ties never yield more than k.
    """
    n = dist.shape[1]
    if n > k:
        kth = np.partition(dist, k - 1, axis=1)[:, k - 1:k]
        sel = (dist <= kth) & np.isfinite(dist)
    else:
        sel = np.isfinite(dist)
    qi, di = np.nonzero(sel)
    if len(qi) == 0:
        return qi, di
    if np.bincount(qi).max() > k:  # ties at the k-th distance: order by id and cut
        if hasattr(ids, "to_pandas"):  # Arrow column: converted only when ties need it
            ids = ids.to_pandas().to_numpy()
        id_rank = np.unique(np.asarray(ids, dtype=object)[di], return_inverse=True)[1]
        order = np.lexsort((id_rank, dist[qi, di], qi))
        qi, di = qi[order], di[order]
        starts = np.r_[0, np.nonzero(np.diff(qi))[0] + 1]
        pos = np.arange(len(qi)) - np.repeat(starts, np.diff(np.r_[starts, len(qi)]))
        qi, di = qi[pos < k], di[pos < k]
    return qi, di


def _eq_matrix(store_col: pa.Array, q_vals: list) -> np.ndarray:
    """(nq, n) boolean: store value equals the question's value (False for null question values).

    Vectorised: ``index_in`` maps every store value to its position among the
    questions' distinct values, then one integer broadcast compare.
    """
    uniq = list(dict.fromkeys(v for v in q_vals if v is not None))
    nq, n = len(q_vals), len(store_col)
    if not uniq:
        return np.zeros((nq, n), dtype=bool)
    pos = pc.fill_null(pc.index_in(store_col, value_set=pa.array(uniq, type=store_col.type)), -1)
    pos = pos.to_numpy(zero_copy_only=False).astype(np.int64)
    at = {v: i for i, v in enumerate(uniq)}
    qpos = np.array([at[v] if v is not None else -2 for v in q_vals], dtype=np.int64)
    return pos[None, :] == qpos[:, None]


def _check_lengths(dim: int, others: bool) -> None:
    if others:
        raise ValueError(f"the questions' vectors have {dim} numbers, some stored ones do not: embed both the same way")


def _make_kernel(bc, k: int, dim: int, vec_col: str, payload: list[str], qfilter: QuestionFilter | None,
                 out_schema: pa.Schema, id_col: str = "id", same_length: bool = False):
    def run(batches):
        qids, Q, qn, qcols = bc.value
        cells = qcols.get("__cells__")  # (store cell column, allowed[nq, n_cells]) for IVF probing
        nq = Q.shape[0]
        tile = max(1, TILE_ELEMENTS // max(nq, 1))
        for batch in batches:
            if batch.num_rows == 0:
                continue
            vec = batch.column(vec_col)
            lengths = pc.fill_null(pc.list_value_length(vec), -1)
            if same_length:
                _check_lengths(dim, pc.any(pc.and_(pc.greater(lengths, 0), pc.not_equal(lengths, dim))).as_py())
            batch = batch.filter(pc.equal(lengths, dim))
            for lo in range(0, batch.num_rows, tile):
                b = batch.slice(lo, tile)
                n = b.num_rows
                flat = pc.list_flatten(b.column(vec_col))
                D = np.asarray(flat.to_numpy(zero_copy_only=False), dtype=np.float64).reshape(n, dim)
                norms = np.sqrt(np.einsum("ij,ij->i", D, D))
                ok = norms > 0  # zero or NaN-bearing vectors never rank
                # 1 - dot / (|q| |d|): with integer-valued vectors (term counts) the dot
                # product is exact, so equal vectors tie exactly and break by id.
                with np.errstate(divide="ignore", invalid="ignore"):
                    dist = 1.0 - (Q @ D.T) / (qn[:, None] * norms[None, :])
                dist[:, ~ok] = np.inf
                dist[~np.isfinite(dist)] = np.inf
                if cells is not None:
                    cell_col, allowed = cells
                    cv = pc.fill_null(b.column(cell_col), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                    inside = (cv >= 0) & (cv < allowed.shape[1])
                    m = np.zeros((nq, n), dtype=bool)
                    m[:, inside] = allowed[:, cv[inside]]
                    dist[~m] = np.inf
                if qfilter is not None:
                    keep = np.ones((nq, n), dtype=bool)
                    if qfilter.equals:
                        parts = []
                        present = np.zeros(nq, dtype=bool)
                        for s_col, q_col in qfilter.equals:
                            qv = qcols[q_col]
                            parts.append(_eq_matrix(b.column(s_col), qv))
                            present |= np.array([v is not None for v in qv])
                        if qfilter.combine == "and":
                            # null question fields are skipped: treat them as True
                            comb = np.ones((nq, n), dtype=bool)
                            for (s_col, q_col), m in zip(qfilter.equals, parts):
                                isnull = np.array([v is None for v in qcols[q_col]])
                                comb &= m | isnull[:, None]
                        else:
                            comb = reduce(np.logical_or, parts)
                        keep &= comb | ~present[:, None]
                    if qfilter.time_col:
                        ts = _to_micros(b.column(qfilter.time_col))
                        tnull = ts == np.iinfo(np.int64).min
                        if qfilter.start_col:
                            st = qcols[qfilter.start_col]
                            has = st != np.iinfo(np.int64).min
                            cmp = (ts[None, :] >= st[:, None]) if qfilter.start_inclusive else (ts[None, :] > st[:, None])
                            keep &= ~has[:, None] | (cmp & ~tnull[None, :])
                        if qfilter.end_col:
                            en = qcols[qfilter.end_col]
                            has = en != np.iinfo(np.int64).min
                            cmp = (ts[None, :] <= en[:, None]) if qfilter.end_inclusive else (ts[None, :] < en[:, None])
                            keep &= ~has[:, None] | (cmp & ~tnull[None, :])
                    dist[~keep] = np.inf
                # k per question by (distance, id): even a store full of identical
                # vectors emits exactly k rows per question per batch
                qi, di = select_top_k(dist, b.column(id_col), k)
                if len(qi) == 0:
                    continue
                taken = b.select(payload).take(pa.array(di, type=pa.int64()))
                cols = ([pa.array(qids[qi], type=out_schema.field(0).type), pa.array(dist[qi, di], type=pa.float64())]
                        + list(taken.columns))
                yield pa.RecordBatch.from_arrays(cols, schema=out_schema)
    return run


def _envelope(qf: QuestionFilter, cols: dict, store_cols: set[str]) -> Column | None:
    """A filter every row any question of the block could accept satisfies (pushed into the scan).

    Time: [earliest start, latest end] when every question has both bounds, plus
    the matching ``week_start`` range so whole weeks are pruned. Equality: with
    "or", ``s1 IN (...) OR s2 IN (...)`` when every question names at least one
    value; with "and", one ``IN`` per field that every question names.
    """
    from ..functions.times import ntz_lit, week_start
    import datetime as _dt

    conds = []
    lo_null = np.iinfo(np.int64).min
    if qf.time_col and qf.start_col and qf.end_col:
        st, en = cols[qf.start_col], cols[qf.end_col]
        if len(st) and (st != lo_null).all() and (en != lo_null).all():
            to_dt = lambda us: _dt.datetime(1970, 1, 1) + _dt.timedelta(microseconds=int(us))
            lo, hi = ntz_lit(to_dt(st.min())), ntz_lit(to_dt(en.max()))
            conds.append((F.col(qf.time_col) >= lo) & (F.col(qf.time_col) <= hi))
            if qf.part_col and qf.part_col in store_cols:
                conds.append((F.col(qf.part_col) >= week_start(lo)) & (F.col(qf.part_col) <= week_start(hi)))
    if qf.equals:
        vals = {s_col: cols[q_col] for s_col, q_col in qf.equals}
        n = len(next(iter(vals.values())))
        if qf.combine == "and":
            for s_col, v in vals.items():
                if n and all(x is not None for x in v):
                    conds.append(F.col(s_col).isin(sorted(set(v))))
        elif n and all(any(vals[s][i] is not None for s in vals) for i in range(n)):
            ors = [F.col(s_col).isin(sorted({x for x in v if x is not None})) for s_col, v in vals.items()
                   if any(x is not None for x in v)]
            conds.append(reduce(lambda a, b: a | b, ors))
    return reduce(lambda a, b: a & b, conds) if conds else None


def _by_length(rows: list, qvec_col: str, dim: int | None) -> list[tuple[int, list]]:
    """Question rows by the length of their vector (or those of length ``dim`` alone), null and empty ones left out."""
    out: dict[int, list] = {}
    for r in rows:
        v = r[qvec_col]
        if v and dim in (None, len(v)):
            out.setdefault(len(v), []).append(r)
    return sorted(out.items())


def _pandas_mask(qf: QuestionFilter, q, s) -> np.ndarray:
    """(nq, n) boolean: which store rows of frame ``s`` each question of ``q`` accepts."""
    keep = np.ones((len(q), len(s)), dtype=bool)
    if qf.equals:
        sides = [(q[qc].to_numpy(dtype=object), s[sc].to_numpy(dtype=object)) for sc, qc in qf.equals]
        given = [np.array([x is not None and x == x for x in a]) for a, _ in sides]
        parts = [(a[:, None] == b[None, :]) for a, b in sides]
        if qf.combine == "and":
            for g, m in zip(given, parts, strict=True):
                keep &= m | ~g[:, None]
        else:
            keep &= reduce(np.logical_or, [m & g[:, None] for g, m in zip(given, parts, strict=True)]) | ~reduce(np.logical_or, given)[:, None]
    if qf.time_col:
        ts = s[qf.time_col].to_numpy(dtype="datetime64[us]")
        for c, at_least, inclusive in ((qf.start_col, True, qf.start_inclusive), (qf.end_col, False, qf.end_inclusive)):
            if c:
                bound = q[c].to_numpy(dtype="datetime64[us]")[:, None]
                row = ts[None, :]
                m = (row >= bound if inclusive else row > bound) if at_least else (row <= bound if inclusive else row < bound)
                keep &= np.isnat(bound) | m
    return keep


def grouped_top_k(questions: DataFrame, store: DataFrame, keys: list[str], k: int, *, qid_col: str, qvec_col: str, id_col: str, vec_col: str,
                  payload: list[str], question_filter: QuestionFilter | None = None, same_length: bool = False) -> DataFrame:
    """Top-k per question over the store rows that share its ``keys``, without a broadcast.

    Both sides meet in cogroups; the caller keeps the groups bounded. Inside a group,
    scores are made tile by tile (``TILE_ELEMENTS``), each tile keeps k rows per question.
    """
    import pandas as pd

    schema = T.StructType([questions.schema[qid_col], T.StructField("distance", T.DoubleType())] + [store.schema[c] for c in payload])
    names = [f.name for f in schema.fields]

    def empty() -> pd.DataFrame:
        return pd.DataFrame({n: pd.Series(dtype=object) for n in names})

    def group(qdf: pd.DataFrame, sdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        q_len = np.array([0 if v is None else len(v) for v in qdf[qvec_col]], dtype=int)
        s_len = np.array([0 if v is None else len(v) for v in sdf[vec_col]], dtype=int)
        for n in ({*q_len} - {0}) if same_length else ():
            _check_lengths(int(n), any(m not in (0, n) for m in {*s_len}))
        for n in sorted({*q_len} & {*s_len} - {0}):
            q, s = qdf[q_len == n], sdf[s_len == n]
            D = np.stack(s[vec_col].to_numpy()).astype(np.float64)
            dn = np.linalg.norm(D, axis=1)
            ids = s[id_col].to_numpy()
            rows = max(1, min(len(s), 1 << 16))
            step = max(1, TILE_ELEMENTS // rows)
            for lo in range(0, len(q), step):
                part = q.iloc[lo:lo + step]
                Q = np.stack(part[qvec_col].to_numpy()).astype(np.float64)
                qn = np.linalg.norm(Q, axis=1)
                found = []
                for at in range(0, len(s), rows):
                    with np.errstate(invalid="ignore", divide="ignore"):
                        dist = 1.0 - (Q @ D[at:at + rows].T) / (qn[:, None] * dn[None, at:at + rows])
                    dist[~np.isfinite(dist)] = np.inf
                    if question_filter is not None:
                        dist[~_pandas_mask(question_filter, part, s.iloc[at:at + rows])] = np.inf
                    qi, di = select_top_k(dist, ids[at:at + rows], k)
                    found.append((qi, di + at, dist[qi, di]))
                qi, di, dist = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.lexsort((np.unique(ids[di], return_inverse=True)[1] if len(di) else di, dist, qi))
                qi, di, dist = qi[order], di[order], dist[order]
                first = np.searchsorted(qi, qi, side="left")
                best = np.arange(len(qi)) - first < k
                qi, di, dist = qi[best], di[best], dist[best]
                one = {qid_col: part[qid_col].to_numpy()[qi], "distance": dist}
                out.append(pd.DataFrame({**one, **{c: s[c].to_numpy()[di] for c in payload}}, columns=names))
        return pd.concat(out) if out else empty()

    cand = questions.groupBy(*keys).cogroup(store.groupBy(*keys)).applyInPandas(group, schema)
    return top_k_per_group(cand, k, group=qid_col, order=("distance", id_col))


def _envelope_rows(questions: DataFrame, qf: QuestionFilter, most: int = 1_000) -> dict:
    """What ``_envelope`` needs of a question table of any size: the extreme times, and the wanted values if there are few combinations."""
    cols: dict = {}
    lo_null = np.iinfo(np.int64).min
    if qf.time_col and qf.start_col and qf.end_col:
        r = questions.agg(F.min(qf.start_col).alias("a"), F.max(qf.end_col).alias("b"),
                          F.count(F.when(F.col(qf.start_col).isNull() | F.col(qf.end_col).isNull(), 1)).alias("open")).first()
        bounded = r["open"] == 0 and r["a"] is not None
        cols[qf.start_col] = np.array([_py_micros(r["a"]) if bounded else lo_null])
        cols[qf.end_col] = np.array([_py_micros(r["b"]) if bounded else lo_null])
    if qf.equals:
        wanted = [q for _, q in qf.equals]
        rows = questions.select(*wanted).distinct().limit(most + 1).collect()
        for q in wanted:
            cols[q] = [r[q] for r in rows] if len(rows) <= most else [None]
    return cols


def _pack_block(rows, dim: int, qvec_col: str, qid_col: str, qcols: list[str], time_cols: set[str]):
    qids = np.array([r[qid_col] for r in rows])
    Q = np.zeros((len(rows), dim), dtype=np.float64)
    for i, r in enumerate(rows):
        v = r[qvec_col]
        if v is not None and len(v) == dim:
            Q[i] = np.asarray(v, dtype=np.float64)
    qn = np.sqrt(np.einsum("ij,ij->i", Q, Q))
    qn = np.where(qn > 0, qn, np.nan)  # zero question -> NaN distances -> no rows
    cols = {}
    for c in qcols:
        vals = [r[c] for r in rows]
        if c in time_cols:
            sentinel = np.iinfo(np.int64).min
            cols[c] = np.array([sentinel if v is None else _py_micros(v) for v in vals], dtype=np.int64)
        else:
            cols[c] = vals
    return qids, Q, qn, cols


def _py_micros(v) -> int:
    import datetime as _dt
    if isinstance(v, _dt.datetime):
        if v.tzinfo is not None:
            v = v.astimezone(_dt.timezone.utc).replace(tzinfo=None)
        delta = v - _dt.datetime(1970, 1, 1)
    else:
        delta = _dt.datetime(v.year, v.month, v.day) - _dt.datetime(1970, 1, 1)
    return (delta.days * 86_400 + delta.seconds) * 1_000_000 + delta.microseconds


def _nearest_in_blocks(store: DataFrame, questions: DataFrame, k: int, qid_col: str, qvec_col: str, id_col: str, vec_col: str, payload: list[str],
                       qf: QuestionFilter | None, max_block_bytes: int, store_block_bytes: int, same_length: bool = False) -> DataFrame:
    """Exact top-k for a question table of any size: question blocks times store blocks, each pair one cogroup; one scan of the store."""
    if qf is not None:
        env = _envelope(qf, _envelope_rows(questions, qf), set(store.columns))
        if env is not None:
            store = store.filter(env)
    scan = store.select(*dict.fromkeys([*payload, id_col, vec_col, *(qf.store_columns() if qf else [])]))
    size = questions.agg(F.count("*").alias("n"), F.max(F.size(qvec_col)).alias("dim")).first()
    row_bytes = max(size["dim"] or 1, 1) * 8 + 64
    q_blocks = max(1, min(size["n"], -(-size["n"] * row_bytes // max_block_bytes)))
    s_blocks = max(1, -(-scan.select(id_col).count() * row_bytes // store_block_bytes))
    q = questions.select(qid_col, qvec_col, *(qf.question_columns() if qf else []))
    q = q.withColumn("_qb", F.pmod(F.xxhash64(qid_col), F.lit(q_blocks))).withColumn("_sb", F.explode(F.sequence(F.lit(0), F.lit(s_blocks - 1)).cast("array<bigint>")))
    s = scan.withColumn("_sb", F.pmod(F.xxhash64(id_col), F.lit(s_blocks))).withColumn("_qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)).cast("array<bigint>")))
    return grouped_top_k(q, s, ["_qb", "_sb"], k, qid_col=qid_col, qvec_col=qvec_col, id_col=id_col, vec_col=vec_col, payload=payload, question_filter=qf,
                         same_length=same_length)


def nearest(store: DataFrame, questions: DataFrame, k: int = 5, *, id_col: str = "id", vec_col: str = "embedding",
            qid_col: str = "query_id", qvec_col: str = "embedding", payload: list[str] | None = None,
            question_filter: QuestionFilter | None = None, dim: int | None = None,
            max_block_bytes: int = DEFAULT_BLOCK_BYTES, probe=None, same_length: bool = False,
            store_block_bytes: int = DEFAULT_BLOCK_BYTES, prune: bool = False) -> DataFrame:
    """JN1 + WN1: exact cosine top-k of ``store`` rows for every question.

    Returns ``qid_col, distance, rank`` plus ``payload`` store columns (default:
    ``id_col``). Ties are broken by ``id_col``. A question only meets rows whose vector
    has its length; with ``same_length`` a stored vector of another length is an error.
    Zero vectors never appear.

    Questions of up to ``max_block_bytes`` are broadcast; more of them meet the store in
    cogroups of question and store blocks, with the same rows and one scan of the store
    (which should then be a stored table). With ``prune`` those questions are grouped by
    direction, and a store row goes only to the groups it can be a hit of (``pruned``): two
    scans, and the fewer copies of a row the more the vectors are clustered.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    payload = list(payload) if payload is not None else [id_col]
    if id_col not in payload:
        payload = [id_col] + payload
    spark = store.sparkSession
    qf = question_filter
    qextra = qf.question_columns() if qf else []
    time_cols = {c for c in (qf.start_col, qf.end_col) if c} if qf else set()

    qsel = questions.select(qid_col, qvec_col, *qextra)
    # one job for the common case: every question fits one broadcast block
    guess_dim = dim or 1536
    block_rows = max(1, max_block_bytes // (guess_dim * 8 + 64 * (1 + len(qextra))))
    head = qsel.take(block_rows + 1)
    if len(head) > block_rows:
        if probe is not None:
            raise ValueError("a probe search of this many questions is IvfIndex.search_grouped")
        if dim is not None:
            questions = questions.filter(F.size(qvec_col) == dim)
        if prune:
            from .pruned import nearest_pruned  # which builds on this module
            return nearest_pruned(store, questions, k, qid_col=qid_col, qvec_col=qvec_col, id_col=id_col, vec_col=vec_col, payload=payload, question_filter=qf,
                                  max_block_bytes=max_block_bytes, store_block_bytes=store_block_bytes, same_length=same_length)
        return _nearest_in_blocks(store, questions, k, qid_col, qvec_col, id_col, vec_col, payload, qf, max_block_bytes, store_block_bytes, same_length)

    store_cols = list(dict.fromkeys(payload + [vec_col] + (qf.store_columns() if qf else [])
                                    + ([probe.cell_col] if probe is not None else [])))
    qid_type = questions.schema[qid_col].dataType
    out_struct = T.StructType([T.StructField(qid_col, qid_type), T.StructField("distance", T.DoubleType())]
                              + [store.schema[c] for c in payload])
    from pyspark.sql.pandas.types import to_arrow_schema
    out_arrow = to_arrow_schema(out_struct)

    parts = []
    for length, rows in _by_length(head, qvec_col, dim):
        packed = _pack_block(rows, length, qvec_col, qid_col, qextra, time_cols)
        scan = store.select(*store_cols)
        if qf is not None:
            env = _envelope(qf, packed[3], set(store.columns))
            if env is not None:
                scan = store.filter(env).select(*store_cols)
        if probe is not None:
            allowed = probe.allowed(packed[1], packed[0])
            packed[3]["__cells__"] = (probe.cell_col, allowed)
            probed = np.nonzero(allowed.any(axis=0))[0].tolist()
            # partition pruning: only the probed cells' files are read
            scan = scan.filter(F.col(probe.cell_col).isin(probed))
        bc = spark.sparkContext.broadcast(packed)
        kernel = _make_kernel(bc, k, length, vec_col, payload, qf, out_arrow, id_col, same_length)
        parts.append(scan.mapInArrow(kernel, out_struct))
    if not parts:
        return spark.createDataFrame([], out_struct.add("rank", T.IntegerType()))
    cand = reduce(DataFrame.unionByName, parts)
    return top_k_per_group(cand, k, group=qid_col, order=("distance", id_col))
