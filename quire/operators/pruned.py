"""Exact top-k for a large question table, with store rows sent only where they can be hits (JN1).

Questions are clustered into groups of like direction (MLlib ``KMeans`` on a bounded sample
of them; every question is then assigned), about as many groups as question blocks. A
store row at angle ``a`` from a group's centroid is at least ``a - radius`` away from each
of its questions, ``radius`` being the largest angle of a question to the centroid.

First every row meets the group nearest to it, which gives each question k hits of which
the farthest is a bound (none, if it has fewer). A second pass sends a row to the other
groups whose widest bound it can still beat. All other pairs cannot hold a hit, so the
answer is that of the exhaustive join, ties included, whatever the groups are: they only
steer how many rows are shuffled, at most (question blocks + groups) copies of a row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import reliable_checkpoint
from .ivf import MAX_CENTROID_BYTES, Cells
from .search import QuestionFilter, _check_lengths, _envelope, _envelope_rows, grouped_top_k, top_k_per_group

#: Questions the groups are trained on, about.
SAMPLE = 100_000


def _groups_of(vectors: pd.Series, choose) -> pd.Series:
    """Numbers of the groups that ``choose`` names for each vector, taken by length; none for null and empty vectors."""
    lengths = np.array([0 if v is None else len(v) for v in vectors], dtype=int)
    out = [np.empty(0, np.int32)] * len(vectors)
    for n in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == n)
        allowed = choose(np.stack([np.asarray(v, dtype=np.float64) for v in vectors.iloc[at]]))
        for i, row in zip(at, allowed, strict=True):
            out[i] = np.flatnonzero(row).astype(np.int32)
    return pd.Series(out, dtype=object)


class QuestionGroups:
    """The questions of one search by group; the last group holds those of another length than most."""

    def __init__(self, questions: DataFrame, qid_col: str, qvec_col: str, max_block_bytes: int, groups: int | None = None, seed: int = 7):
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector
        self.spark, self.qid_col, self.qvec_col = questions.sparkSession, qid_col, qvec_col
        asked = questions.filter(F.size(qvec_col) > 0)
        directed = F.exists(qvec_col, lambda x: x != 0) & ~F.exists(qvec_col, lambda x: x.isNull() | F.isnan(x.cast("double")))
        sizes = {r["n"]: (r["rows"], r["directed"]) for r in asked.groupBy(F.size(qvec_col).alias("n")).agg(
            F.count("*").alias("rows"), F.count(F.when(directed, 1)).alias("directed")).collect()}  # a row per length
        self.lengths = sorted(sizes)
        dim = max(sizes, key=lambda n: (sizes[n], n), default=1)
        self.row_bytes = max(self.lengths, default=1) * 8 + 64
        total = sum(n for n, _ in sizes.values())
        n_groups = max(1, min(groups or -(-total * self.row_bytes // max_block_bytes), MAX_CENTROID_BYTES // (8 * dim)))
        n_directed = sizes[dim][1] if sizes else 0
        if n_groups > 1 and n_directed > 1:
            feats = asked.filter((F.size(qvec_col) == dim) & directed).select(array_to_vector(F.col(qvec_col)).alias("f"))
            if n_directed > SAMPLE:
                feats = feats.sample(fraction=SAMPLE / n_directed, seed=seed)
            C = np.array(KMeans(k=n_groups, seed=seed, featuresCol="f", distanceMeasure="cosine").fit(feats).clusterCenters())
        else:
            C = np.ones((1, dim))
        trained = self.spark.sparkContext.broadcast(Cells(C, np.ones(len(C), np.int64), np.zeros(len(C))))

        @F.pandas_udf("array<int>")
        def own(vectors: pd.Series) -> pd.Series:
            return _groups_of(vectors, lambda V: trained.value.nearest(V, 1))

        @F.pandas_udf("double")
        def cosine(vectors: pd.Series, group: pd.Series) -> pd.Series:
            c, out = trained.value, np.ones(len(vectors))
            at = np.flatnonzero(group.to_numpy() < c.rest)
            if len(at):
                out[at] = c.similarity(np.stack([np.asarray(v, dtype=np.float64) for v in vectors.iloc[at]]))[np.arange(len(at)), group.iloc[at]]
            return pd.Series(out)

        grouped = asked.withColumn("_g", F.explode(own(F.col(qvec_col))))
        self.questions = reliable_checkpoint(grouped.withColumn("_cos", cosine(F.col(qvec_col), F.col("_g"))))  # read by both passes and for the bounds
        rows, cos = np.zeros(len(C), np.int64), np.ones(len(C))
        blocks = []
        for r in self.questions.groupBy("_g").agg(F.count("*").alias("n"), F.min("_cos").alias("c")).collect():  # a row per group
            blocks.append((r["_g"], -(-r["n"] * self.row_bytes // max_block_bytes)))
            if r["_g"] < len(C):
                rows[r["_g"]], cos[r["_g"]] = r["n"], r["c"]
        self.blocks = F.broadcast(self.spark.createDataFrame(blocks, "_g int, _blocks bigint"))
        self.cells = Cells(C, rows, np.arccos(np.clip(cos, -1.0, 1.0)))

    def reach(self, hits: DataFrame, k: int) -> Cells:
        """The groups with the angle up to which a row can be a hit of one of their questions, given hits found so far."""
        kth = hits.filter(F.col("rank") == k).select(self.qid_col, F.col("distance").alias("_far"))
        far = {r["_g"]: r["far"] for r in self.questions.select("_g", self.qid_col).join(kth, self.qid_col, "left")
               .groupBy("_g").agg(F.max(F.coalesce("_far", F.lit(2.0))).alias("far")).collect()}  # a row per group
        distance = np.array([far.get(g, 0.0) for g in range(self.cells.rest)])
        return Cells(self.cells.centroids, self.cells.rows, self.cells.radius + np.arccos(np.clip(1.0 - distance, -1.0, 1.0)))

    def send(self, store: DataFrame, vec_col: str, reach: Cells | None = None) -> DataFrame:
        """Store rows, one copy for each group (``_g``) and question block (``_qb``) they go to.

        Without ``reach`` the group nearest to a row, with it all others the row can reach.
        """
        both = self.spark.sparkContext.broadcast((self.cells, reach))

        @F.pandas_udf("array<int>")
        def groups(vectors: pd.Series) -> pd.Series:
            near, reach = both.value
            if reach is None:
                return _groups_of(vectors, lambda V: near.nearest(V, 1))
            return _groups_of(vectors, lambda V: reach.within(V, np.zeros(len(V))) & ~near.nearest(V, 1))

        sent = store.withColumn("_g", F.explode(groups(F.col(vec_col)))).join(self.blocks, "_g")
        return sent.withColumn("_qb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1))).drop("_blocks")


def nearest_pruned(store: DataFrame, questions: DataFrame, k: int, *, qid_col: str = "query_id", qvec_col: str = "embedding", id_col: str = "id",
                   vec_col: str = "embedding", payload: list[str] | None = None, question_filter: QuestionFilter | None = None, max_block_bytes: int,
                   store_block_bytes: int, same_length: bool = False, groups: int | None = None) -> DataFrame:
    """The rows of ``search.nearest`` for a question table of any size; a group of any size is question blocks times store blocks.

    ``store`` is scanned twice (once more where lengths are compared) and should be a stored table.
    """
    payload = list(dict.fromkeys([*(payload or []), id_col]))
    qf = question_filter
    if qf is not None:
        env = _envelope(qf, _envelope_rows(questions, qf), set(store.columns))
        if env is not None:
            store = store.filter(env)
    scan = store.select(*dict.fromkeys([*payload, vec_col, *(qf.store_columns() if qf else [])]))
    asked = QuestionGroups(questions.select(qid_col, qvec_col, *(qf.question_columns() if qf else [])), qid_col, qvec_col, max_block_bytes, groups)
    if not asked.lengths:
        return questions.sparkSession.createDataFrame([], T.StructType(
            [questions.schema[qid_col], T.StructField("distance", T.DoubleType()), *[store.schema[c] for c in payload], T.StructField("rank", T.IntegerType())]))
    stored = scan.agg(F.count("*").alias("n"), F.array_distinct(F.array(F.min(F.when(F.size(vec_col) > 0, F.size(vec_col))), F.max(F.size(vec_col)))).alias("dims")).first()
    if same_length:
        for n in asked.lengths:
            _check_lengths(n, any(m is not None and m > 0 and m != n for m in stored["dims"]))
    s_blocks = max(1, -(-stored["n"] * asked.row_bytes // store_block_bytes))
    q = asked.questions.drop("_cos").join(asked.blocks, "_g").withColumn("_qb", F.pmod(F.xxhash64(qid_col), F.col("_blocks"))).drop("_blocks")
    q = q.withColumn("_sb", F.explode(F.sequence(F.lit(0), F.lit(s_blocks - 1)).cast("array<bigint>")))

    def meet(reach: Cells | None) -> DataFrame:
        s = asked.send(scan, vec_col, reach).withColumn("_sb", F.pmod(F.xxhash64(id_col), F.lit(s_blocks)))
        return grouped_top_k(q, s, ["_g", "_qb", "_sb"], k, qid_col=qid_col, qvec_col=qvec_col, id_col=id_col, vec_col=vec_col, payload=payload, question_filter=qf)

    hits = reliable_checkpoint(meet(None))  # read twice: the bounds and the answer
    more = meet(asked.reach(hits, k))
    return top_k_per_group(hits.drop("rank").unionByName(more.drop("rank")), k, group=qid_col, order=("distance", id_col))
