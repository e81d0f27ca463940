"""Cell index over the vectors of a store, searched exactly (SK7).

Build: MLlib ``KMeans`` (cosine distance), every row assigned its nearest cell, the table
written ``partitionBy("_gen", "cell")``. Vectors of another length than the store's most
frequent one and zero vectors are a last cell of their own, so every row is indexed. Only
the centroids (``n_cells x dim`` numbers, size-checked) go to the driver, with each
cell's rows and radius, the largest angle of a row to its centroid.

Search: a row of a cell is at least ``angle(question, centroid) - radius`` away from the
question. A question first probes the cells nearest to it; the distance of its k-th hit is
then a bound, and a second pass probes the other cells that could hold a row within it.
All others cannot, so the hits are those of exact search, ties included. A scan reads only
probed cells. With ``nprobe`` the search is approximate and stops after that many cells.

Changes: ``upsert`` assigns only its own rows to the existing cells and adds them as a
generation of the index, with a tombstone for their ids, which hides rows of older
generations; ``delete`` adds tombstones alone. A generation counts once its statistics are
written, the last step, so a batch that failed half-way is not seen. ``merge`` writes all
living rows as one generation again. ``build`` trains new cells.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import reliable_checkpoint, shuffles_removed, staged
from .search import DEFAULT_BLOCK_BYTES, QuestionFilter, grouped_top_k, nearest, top_k_per_group

MAX_CENTROID_BYTES = 256 << 20
#: The most cells, and the rows that cells are trained on: with both bounded, a build takes time in proportion to the rows.
MAX_CELLS = 1_024
TRAIN_ROWS = 1 << 16
#: Tasks, and so files, a cell is written by.
CELL_FILES = 8
#: Cells a question probes first.
FIRST_CELLS = 2
#: Added to an angle before it rules a cell out: arc cosines of doubles are exact to about 2e-8.
MARGIN = 1e-6
GEN = "_gen"


class Cells:
    """Centroids with the rows and radius of each cell; the last cell holds the vectors that have no centroid."""

    def __init__(self, centroids: np.ndarray, rows: np.ndarray, radius: np.ndarray):
        self.centroids = centroids / np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-300)
        self.rows, self.radius = rows, radius

    @property
    def rest(self) -> int:
        return len(self.centroids)

    def similarity(self, Q: np.ndarray) -> np.ndarray:
        """(questions, cells): cosine to every centroid; 0 for a vector without direction."""
        with np.errstate(invalid="ignore", divide="ignore"):
            unit = Q / np.linalg.norm(Q, axis=1, keepdims=True)
        return np.clip(np.nan_to_num(unit, nan=0.0) @ self.centroids.T, -1.0, 1.0)

    def _others(self, Q: np.ndarray) -> np.ndarray | None:
        """Questions of another length than the centroids can only meet the last cell."""
        if Q.shape[1] == self.centroids.shape[1]:
            return None
        out = np.zeros((len(Q), self.rest + 1), dtype=bool)
        out[:, self.rest] = True
        return out

    @staticmethod
    def _directed(Q: np.ndarray) -> np.ndarray:
        """Questions that have a direction; the others find no row and read no cell."""
        norm = np.linalg.norm(Q, axis=1)
        return np.isfinite(norm) & (norm > 0)

    def nearest(self, Q: np.ndarray, n: int) -> np.ndarray:
        """(questions, cells + 1) boolean: the ``n`` most similar cells of each question, or the last one for another length."""
        out = self._others(Q)
        if out is None:
            out, n = np.zeros((len(Q), self.rest + 1), dtype=bool), min(n, self.rest)
            np.put_along_axis(out, np.argpartition(-self.similarity(Q), n - 1, axis=1)[:, :n], True, axis=1)
            out[~self._directed(Q)] = False
        return out

    def enough(self, Q: np.ndarray, k: int) -> np.ndarray:
        """The first cells of each question: ``FIRST_CELLS``, and more while those hold fewer than ``k`` rows."""
        out = self._others(Q)
        if out is None:
            out = np.zeros((len(Q), self.rest + 1), dtype=bool)
            order = np.argsort(-self.similarity(Q), axis=1, kind="stable")
            before = np.cumsum(self.rows[order], axis=1) - self.rows[order]
            np.put_along_axis(out, order, (before < k) | (np.arange(self.rest) < FIRST_CELLS), axis=1)
            out[~self._directed(Q)] = False
        return out

    def within(self, Q: np.ndarray, distance: np.ndarray) -> np.ndarray:
        """Cells that can hold a row within the cosine distance given for each question (infinite: any row)."""
        out = self._others(Q)
        if out is None:
            out = np.zeros((len(Q), self.rest + 1), dtype=bool)
            angle = np.where(np.isfinite(distance), np.arccos(np.clip(1.0 - distance, -1.0, 1.0)), math.pi)
            out[:, :self.rest] = (np.arccos(self.similarity(Q)) - self.radius[None, :] <= angle[:, None] + MARGIN) & (self.rows > 0)[None, :]
            out[~self._directed(Q)] = False
        return out


class Probe:
    """The cells a block of questions reads, for ``search.nearest``; ``cells`` lists those read so far."""

    def __init__(self, choose, cell_col: str = "cell"):
        self.choose, self.cell_col, self.cells = choose, cell_col, set()

    def allowed(self, Q: np.ndarray, qids: np.ndarray) -> np.ndarray:
        out = self.choose(Q, qids)
        self.cells |= set(np.nonzero(out.any(axis=0))[0].tolist())
        return out


def cells_for(rows: int, dim: int) -> int:
    """Number of cells for a store of this size: about the square root of its rows, within ``MAX_CELLS`` and the centroid table's bytes."""
    return max(1, min(math.isqrt(max(rows, 1)), MAX_CELLS, MAX_CENTROID_BYTES // (8 * max(dim, 1))))


class IvfIndex:
    def __init__(self, spark: SparkSession, path: str, cell_col: str = "cell"):
        self.spark, self.path, self.cell_col = spark, path.rstrip("/"), cell_col

    @property
    def centroid_path(self) -> str:
        return self.path + "_centroids"

    @property
    def stats_path(self) -> str:
        return self.path + "_stats"

    @property
    def tombstone_path(self) -> str:
        return self.path + "_tombstones"

    @staticmethod
    def _content(vec_col: str, id_col: str) -> list[Column]:
        return [F.count("*").alias("rows"), F.sum(F.xxhash64(id_col, vec_col).cast("decimal(38,0)")).alias("hash")]

    @staticmethod
    def signature(store: DataFrame, vec_col: str = "embedding", id_col: str = "id") -> tuple[int, str]:
        """Rows of a store and a sum over their ids and vectors: equal for equal content, in any order."""
        r = store.agg(*IvfIndex._content(vec_col, id_col)).first()
        return r["rows"], str(r["hash"] or 0)

    # ------------------------------------------------------------ build and changes

    def build(self, store: DataFrame, n_cells: int | None = None, vec_col: str = "embedding", seed: int = 7,
              max_iter: int = 20, train_fraction: float = 1.0, id_col: str = "id") -> "IvfIndex":
        """Train the cells and write every row with its cell.

        ``n_cells`` defaults to about the square root of the rows. ``skipped`` counts the rows
        of the last cell (zero vectors, other lengths). The centroids are trained on about
        ``TRAIN_ROWS`` rows (all rows of a smaller store), or on the share ``train_fraction`` if
        that is less; every row is indexed, and exact search does not depend on the centroids.
        """
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector
        nonzero = F.exists(vec_col, lambda x: x != 0) & ~F.exists(vec_col, lambda x: x.isNull() | F.isnan(x.cast("double")))
        by_length = store.groupBy(F.when(nonzero, F.size(vec_col)).otherwise(0).alias("n")).agg(*self._content(vec_col, id_col)).collect()  # a row per length
        lengths = {r["n"]: r["rows"] for r in by_length}
        dim = max((n for n in lengths if n), key=lambda n: (lengths[n], n), default=0)
        if dim == 0:
            raise ValueError("the store holds no vector to index")
        n_cells = n_cells or cells_for(lengths[dim], dim)
        if n_cells * dim * 8 > MAX_CENTROID_BYTES:
            raise ValueError("too many cells for the centroid table")
        rows, content = sum(lengths.values()), str(sum(int(r["hash"]) for r in by_length))
        train_fraction = min(train_fraction, TRAIN_ROWS / lengths[dim])
        feats = store.filter((F.size(vec_col) == dim) & nonzero).withColumn("_f", array_to_vector(F.col(vec_col)))
        km = KMeans(k=n_cells, seed=seed, maxIter=max_iter, featuresCol="_f", predictionCol=self.cell_col, distanceMeasure="cosine")
        centers = km.fit(feats if train_fraction >= 1.0 else feats.sample(fraction=train_fraction, seed=seed)).clusterCenters()
        self.drop()
        cents = [(i, [float(x) for x in c], rows, content) for i, c in enumerate(centers)]
        (self.spark.createDataFrame(cents, "cell int, centroid array<double>, store_rows bigint, store_content string")
         .write.mode("overwrite").parquet(self.centroid_path))
        self._add(store, 0, vec_col, id_col)
        return self

    def _assigned(self, rows: DataFrame, vec_col: str) -> DataFrame:
        """``rows`` with their cell and ``_cos``, the cosine to its centroid."""
        bc = self.spark.sparkContext.broadcast(self._centroids())
        dim, rest = bc.value.shape[1], len(bc.value)

        @F.pandas_udf("cell int, cos double")
        def assign(vectors: pd.Series) -> pd.DataFrame:
            cell, cos = np.full(len(vectors), rest, np.int32), np.ones(len(vectors))
            whole = np.array([v is not None and len(v) == dim for v in vectors], bool)
            if whole.any():
                V = np.stack([np.asarray(v, dtype=np.float64) for v in vectors[whole]])
                with np.errstate(invalid="ignore", divide="ignore"):
                    V = V / np.linalg.norm(V, axis=1, keepdims=True)
                at = np.flatnonzero(whole)[np.isfinite(V).all(axis=1)]
                if len(at):
                    sim = V[np.isfinite(V).all(axis=1)] @ bc.value.T
                    cell[at] = sim.argmax(axis=1)
                    cos[at] = sim.max(axis=1)
            return pd.DataFrame({"cell": cell, "cos": cos})

        found = rows.select("*", assign(F.col(vec_col)).alias("_a"))
        return found.select(*[F.col(f"`{c}`") for c in rows.columns], F.col("_a.cell").alias(self.cell_col), F.col("_a.cos").alias("_cos"))

    def _add(self, rows: DataFrame, gen: int, vec_col: str, id_col: str) -> None:
        """Write ``rows`` as a generation, then its statistics."""
        # a cell is written by a few tasks, whatever the number of input splits
        laid = self._assigned(rows, vec_col).withColumn(GEN, F.lit(gen)).repartition(self.cell_col, F.pmod(F.xxhash64(id_col), F.lit(CELL_FILES)))
        with shuffles_removed(rows.sparkSession):
            laid.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(GEN, self.cell_col).parquet(self.path)
        stats = (self.spark.read.schema(laid.schema).parquet(self.path).filter(F.col(GEN) == gen).groupBy(F.col(self.cell_col).alias("cell"))
                 .agg(F.count("*").alias("n_rows"), F.min("_cos").alias("least_cos")))
        # a generation without rows counts as well
        stats = self.spark.range(1).select(F.lit(-1).alias("cell"), F.lit(0).cast("bigint").alias("n_rows"), F.lit(1.0).alias("least_cos")).unionByName(stats)
        stats.withColumn(GEN, F.lit(gen)).coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(GEN).parquet(self.stats_path)

    def _bury(self, ids: DataFrame, gen: int, id_col: str) -> None:
        """Tombstones: rows of these ids in generations before ``gen`` are gone."""
        with shuffles_removed(ids.sparkSession):
            (ids.select(id_col).distinct().withColumn(GEN, F.lit(gen)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .option("compression", "zstd").partitionBy(GEN).parquet(self.tombstone_path))

    def _generations(self) -> list[int]:
        return sorted(r[0] for r in self._stats().select(GEN).distinct().collect())  # a row per batch since the last merge

    def upsert(self, rows: DataFrame, vec_col: str = "embedding", id_col: str = "id", batch: int | None = None) -> int:
        """Insert rows, replacing those of the same ids; returns the generation.

        Only ``rows`` are assigned to cells. ``batch``, a number greater than those before,
        makes a repeated call write the same generation again.
        """
        gen = batch if batch is not None else self._generations()[-1] + 1
        with staged(rows.select(*[c for c in self._rows().columns if c in rows.columns])) as rows:  # read twice: the rows and their ids
            self._bury(rows, gen, id_col)
            self._add(rows, gen, vec_col, id_col)
        return gen

    def delete(self, ids: DataFrame, vec_col: str = "embedding", id_col: str = "id", batch: int | None = None) -> int:
        """Remove the rows of these ids; returns the generation."""
        gen = batch if batch is not None else self._generations()[-1] + 1
        self._bury(ids, gen, id_col)
        self._add(self._rows().limit(0).drop(GEN, self.cell_col, "_cos"), gen, vec_col, id_col)
        return gen

    def merge(self, vec_col: str = "embedding", id_col: str = "id") -> "IvfIndex":
        """Write the living rows as one generation and drop the older ones and the tombstones; the cells stay."""
        gens = self._generations()
        live = self.read(id_col).drop(self.cell_col, "_cos", GEN)
        self._add(reliable_checkpoint(live), gens[-1] + 1, vec_col, id_col)
        for path in (self.stats_path, self.path):  # statistics first: they say what counts
            for g in gens:
                self._delete(f"{path}/{GEN}={g}")
        self._delete(self.tombstone_path)
        return self

    def stale(self, store: DataFrame, vec_col: str = "embedding", id_col: str = "id") -> bool:
        """Whether the index holds other rows than the store (changes that went past ``upsert`` and ``delete``)."""
        return self.signature(self.read(id_col), vec_col, id_col) != self.signature(store, vec_col, id_col)

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def _there(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return bool(p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p))

    def exists(self) -> bool:
        return self._there(self.centroid_path + "/_SUCCESS") and self._there(self.stats_path)

    def ensure(self, store: DataFrame, n_cells: int | None = None, **kw) -> "IvfIndex":
        """The index of ``store`` as it is now: built if there is none or it holds other rows."""
        same = {c: kw[c] for c in ("vec_col", "id_col") if c in kw}
        return self if self.exists() and not self.stale(store, **same) else self.build(store, n_cells, **kw)

    def drop(self) -> None:
        for path in (self.stats_path, self.path, self.centroid_path, self.tombstone_path):
            self._delete(path)

    # ------------------------------------------------------------ reading

    def _stats(self) -> DataFrame:
        return self.spark.read.parquet(self.stats_path)

    def _rows(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def read(self, id_col: str = "id", where: Column | None = None, cells: list[int] | None = None) -> DataFrame:
        """The living rows, with ``cell``; ``cells`` and ``where`` reach the scan."""
        gens = self._generations()
        rows = self._rows().filter(F.col(GEN).isin(gens))
        if cells is not None:
            rows = rows.filter(F.col(self.cell_col).isin(cells))
        if where is not None:
            rows = rows.filter(where)
        if self._there(self.tombstone_path):
            gone = self.spark.read.parquet(self.tombstone_path).filter(F.col(GEN).isin(gens)).groupBy(id_col).agg(F.max(GEN).alias("_gone"))
            rows = rows.join(gone, id_col, "left").filter(F.col("_gone").isNull() | (F.col(GEN) >= F.col("_gone"))).drop("_gone")
        return rows

    def _centroids(self) -> np.ndarray:
        rows = self.spark.read.parquet(self.centroid_path).orderBy("cell").collect()
        C = np.array([r["centroid"] for r in rows], dtype=np.float64)
        return C / np.maximum(np.linalg.norm(C, axis=1, keepdims=True), 1e-300)

    def cells(self) -> Cells:
        C = self._centroids()
        rows, cos = np.zeros(len(C), np.int64), np.ones(len(C))
        for r in self._stats().groupBy("cell").agg(F.sum("n_rows").alias("n"), F.min("least_cos").alias("c")).collect():  # a row per cell
            if 0 <= r["cell"] < len(C):
                rows[r["cell"]], cos[r["cell"]] = r["n"], r["c"]
        return Cells(C, rows, np.arccos(np.clip(cos, -1.0, 1.0)))

    def probe(self, nprobe: int) -> Probe:
        """For ``search.nearest``: each question reads its ``nprobe`` nearest cells."""
        cells = self.cells()
        return Probe(lambda Q, qids: cells.nearest(Q, nprobe), self.cell_col)

    @property
    def skipped(self) -> int:
        """Rows of the last cell, which only questions of their own length can find."""
        rest = len(self._centroids())
        return self._stats().filter(F.col("cell") == rest).agg(F.sum("n_rows")).first()[0] or 0

    # ------------------------------------------------------------ search

    def _in_groups(self, questions: DataFrame, cells_of, k: int, *, qid_col: str, qvec_col: str, id_col: str, vec_col: str, payload: list[str],
                   qf: QuestionFilter | None, where: Column | None, rows_per_group: int, questions_per_group: int, extra: tuple[str, ...] = ()) -> DataFrame:
        """Top k over the cells ``cells_of`` names for each question, in cogroups of (cell, sub, question block)."""
        cell_col = self.cell_col
        sizes = self._stats().filter("cell >= 0").groupBy(F.col("cell").alias(cell_col)).agg(F.sum("n_rows").alias("n"))
        subs = sizes.select(cell_col, F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(rows_per_group))).cast("int").alias("_subs"))
        q = questions.select(qid_col, qvec_col, *extra, *(qf.question_columns() if qf else [])).filter(F.size(qvec_col) > 0)
        q = q.withColumn(cell_col, F.explode(cells_of)).drop(*extra).join(F.broadcast(subs), cell_col)  # n_cells rows
        # a cell gets as many question blocks as its own questions need, and no rows without questions
        asked = q.groupBy(cell_col).agg(F.ceil(F.count("*") / F.lit(questions_per_group)).alias("_blocks"))
        asked = reliable_checkpoint(asked.join(subs, cell_col))
        q = q.join(F.broadcast(asked.drop("_subs")), cell_col)
        q = q.withColumn("_sub", F.explode(F.sequence(F.lit(0), F.col("_subs") - 1))).withColumn("_qb", F.pmod(F.xxhash64(qid_col), F.col("_blocks"))).drop("_subs", "_blocks")
        probed = [r[0] for r in asked.select(cell_col).collect()]  # n_cells rows at most
        st = self.read(id_col, where, probed).select(cell_col, *dict.fromkeys(payload + [vec_col] + (qf.store_columns() if qf else []))).join(F.broadcast(asked), cell_col)
        st = st.withColumn("_sub", F.pmod(F.xxhash64(id_col), F.col("_subs").cast("bigint")).cast("int"))
        st = st.withColumn("_qb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1))).drop("_subs", "_blocks")
        return grouped_top_k(q, st, [cell_col, "_sub", "_qb"], k, qid_col=qid_col, qvec_col=qvec_col, id_col=id_col, vec_col=vec_col, payload=payload, question_filter=qf)

    def search_grouped(self, questions: DataFrame, k: int = 5, nprobe: int | None = None, *, qid_col: str = "query_id",
                       qvec_col: str = "embedding", id_col: str = "id", vec_col: str = "embedding",
                       payload: list[str] | None = None, question_filter: QuestionFilter | None = None,
                       where: Column | None = None, rows_per_group: int = 20_000, questions_per_group: int = 50_000) -> DataFrame:
        """Search without any broadcast that grows with the questions: exact, or over the ``nprobe`` nearest cells.

        Questions are exploded to their cells (only the centroids are broadcast, size-checked)
        and meet the index rows in cogroups keyed by ``(cell, sub)``. A cell is split into
        ``ceil(rows / rows_per_group)`` subs by a hash of the row id, and a question probing it is
        repeated once per sub, so a cell holding a third of the table is spread over many tasks;
        the rows of a cell repeat for every ``questions_per_group`` questions that probe it. The
        second pass of the exact search sends a question only to cells its k-th distance allows.
        """
        payload = list(payload) if payload is not None else [id_col]
        if id_col not in payload:
            payload = [id_col] + payload
        bc = self.spark.sparkContext.broadcast(self.cells())

        def by_length(vectors: pd.Series, choose) -> pd.Series:
            lengths = np.array([len(v) for v in vectors], dtype=int)
            out = np.empty(len(vectors), dtype=object)
            for n in np.unique(lengths):
                at = np.flatnonzero(lengths == n)
                allowed = choose(bc.value, np.stack([np.asarray(v, dtype=np.float64) for v in vectors.iloc[at]]), at)
                for i, row in zip(at, allowed, strict=True):
                    out[i] = np.flatnonzero(row).astype(np.int32)
            return pd.Series(out, dtype=object)

        @F.pandas_udf("array<int>")
        def first_cells(vectors: pd.Series) -> pd.Series:
            return by_length(vectors, lambda c, V, at: c.enough(V, k) if nprobe is None else c.nearest(V, nprobe))

        @F.pandas_udf("array<int>")
        def other_cells(vectors: pd.Series, far: pd.Series) -> pd.Series:
            limit = far.to_numpy(dtype=np.float64)
            return by_length(vectors, lambda c, V, at: c.within(V, np.nan_to_num(limit[at], nan=np.inf)) & ~c.enough(V, k))

        common = dict(qid_col=qid_col, qvec_col=qvec_col, id_col=id_col, vec_col=vec_col, payload=payload, qf=question_filter, where=where,
                      rows_per_group=rows_per_group, questions_per_group=questions_per_group)
        hits = self._in_groups(questions, first_cells(F.col(qvec_col)), k, **common)
        if nprobe is not None:
            return hits
        hits = reliable_checkpoint(hits)  # read twice: the k-th distances and the answer
        kth = hits.filter(F.col("rank") == k).select(qid_col, F.col("distance").alias("_far"))
        more = self._in_groups(questions.join(kth, qid_col, "left"), other_cells(F.col(qvec_col), F.col("_far")), k, extra=("_far",), **common)
        return top_k_per_group(hits.drop("rank").unionByName(more.drop("rank")), k, group=qid_col, order=("distance", id_col))

    def _search_block(self, questions: DataFrame, k: int, nprobe: int | None, where: Column | None, **kw) -> DataFrame:
        """``search`` of one broadcast block of questions."""
        qid, id_col = kw.get("qid_col", "query_id"), kw.get("id_col", "id")
        cells, table = self.cells(), self.read(id_col, where)
        probe = Probe(lambda Q, qids: cells.enough(Q, k) if nprobe is None else cells.nearest(Q, nprobe), self.cell_col)
        hits = nearest(table, questions, k=k, probe=probe, **kw)
        self.probed = probe.cells
        if nprobe is not None:
            return hits
        hits = reliable_checkpoint(hits)  # read twice: the k-th distances and the answer
        far = {r[qid]: r["distance"] for r in hits.filter(F.col("rank") == k).select(qid, "distance").collect()}  # the questions of one block

        def others(Q: np.ndarray, qids: np.ndarray) -> np.ndarray:
            return cells.within(Q, np.array([far.get(x, np.inf) for x in qids.tolist()])) & ~cells.enough(Q, k)

        probe = Probe(others, self.cell_col)
        more = nearest(table, questions, k=k, probe=probe, **kw)
        self.probed |= probe.cells
        return top_k_per_group(hits.drop("rank").unionByName(more.drop("rank")), k, group=qid, order=("distance", id_col))

    def search(self, questions: DataFrame, k: int = 5, nprobe: int | None = None, fallback: bool = True,
               strategy: str = "auto", where: Column | None = None, **kw) -> DataFrame:
        """The k nearest rows of every question, with ``exact``: whether they are those of exact search.

        ``strategy`` is "broadcast" (a question block over pruned scans), "grouped"
        (``search_grouped``) or "auto" (grouped once the questions exceed one broadcast block); both take
        the same filters: ``where`` on the store's columns, ``question_filter`` per question. With
        ``nprobe`` only that many cells are read; ``fallback`` then answers questions with fewer than k rows exactly.
        """
        if strategy == "auto":
            dim = self._centroids().shape[1]
            strategy = "grouped" if questions.count() * (dim * 8 + 64) > DEFAULT_BLOCK_BYTES else "broadcast"
        run = (lambda q, n: self.search_grouped(q, k=k, nprobe=n, where=where, **kw)) if strategy == "grouped" else (lambda q, n: self._search_block(q, k, n, where, **kw))
        if nprobe is None or not fallback:
            return run(questions, nprobe).withColumn("exact", F.lit(nprobe is None))
        qid = kw.get("qid_col", "query_id")
        hits = reliable_checkpoint(run(questions, nprobe))  # shared checkpoint folder; reused twice below
        full = hits.filter(F.col("rank") == k).select(qid)
        short = questions.join(full, qid, "left_anti")
        if short.isEmpty():
            return hits.withColumn("exact", F.lit(False))
        return hits.join(full, qid, "left_semi").withColumn("exact", F.lit(False)).unionByName(run(short, None).withColumn("exact", F.lit(True)))

