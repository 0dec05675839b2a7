"""Embeddings and exact cosine search in blocks of queries."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DIMENSIONS = 256


def hashed_words(texts: pd.Series, dimensions: int = DIMENSIONS) -> pd.Series:
    """The default embedder: signed hashed bag of words, of unit length (zero for texts without a word)."""
    out = []
    for t in texts:
        v = np.zeros(dimensions, np.float32)
        for w in re.findall(r"\w+", (t or "").lower()):
            h = zlib.crc32(w.encode())
            v[h % dimensions] += 1.0 if h & 0x80000000 else -1.0
        n = float(np.linalg.norm(v))
        out.append((v / n if n else v).tolist())
    return pd.Series(out, index=texts.index)


def embed(df: DataFrame, text: str, out: str = "embedding", embedder: Callable[[pd.Series], pd.Series] = hashed_words) -> DataFrame:
    """df with a vector for each text by an embedder of Arrow batches."""
    f = F.pandas_udf(lambda s: embedder(s), "array<float>")  # noqa: PLW0108
    return df.withColumn(out, f(F.col(text)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, in doubles; null where a length is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _matrix(vectors: pd.Series) -> np.ndarray:
    m = np.stack([np.asarray(v, np.float64) for v in vectors])
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def knn(queries: DataFrame, corpus: DataFrame, k: int = 3, query_id: str = "query_id", item_id: str = "item_id", vector: str = "embedding", block: int = 1024, most_sent: int = 1 << 16, keep_self: bool = True) -> DataFrame:
    """The exact k nearest items of each query by cosine: query_id, item_id, score, rank from 1; ties by item_id.

    Queries go to the executors most_sent at a time, each such part in a pass of its own over the corpus; each batch of the corpus is multiplied with a
    block and keeps its k best for each query, so the rows that move are k for each query and batch, not pairs. Vectors of
    length zero have score 0; null vectors take no part. The ids are bigints.
    """
    asked = queries.select(query_id, vector).filter(F.col(vector).isNotNull())
    rows = asked.limit(most_sent + 1).toPandas()
    if len(rows) > most_sent:
        parts = -(-asked.count() // (most_sent // 2 or 1))  # half full, as the hash does not cut evenly
        part = F.pmod(F.xxhash64(query_id), F.lit(parts))
        found = [knn(asked.filter(part == i), corpus, k, query_id, item_id, vector, block, max(most_sent, 2), keep_self) for i in range(parts)]
        return reduce(DataFrame.unionByName, found)
    schema = f"{query_id} long, {item_id} long, score double"
    items = corpus.select(F.col(item_id).cast("bigint").alias(item_id), vector).filter(F.col(vector).isNotNull())
    if rows.empty:
        return items.select(F.lit(0).cast("bigint").alias(query_id), item_id, F.lit(0.0).alias("score"), F.lit(0).alias("rank")).filter("false")
    ids, matrix = rows[query_id].to_numpy(np.int64), _matrix(rows[vector])
    sent = items.sparkSession.sparkContext.broadcast((ids, matrix))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qid, qm = sent.value
        for b in batches:
            if b.empty:
                continue
            own, m = b[item_id].to_numpy(np.int64), _matrix(b[vector])
            order = np.argsort(own, kind="stable")  # so that ties go to the smaller id
            own, m = own[order], m[order]
            for at in range(0, len(qid), block):
                scores = qm[at : at + block] @ m.T
                if not keep_self:
                    scores[qid[at : at + block, None] == own[None, :]] = -np.inf
                best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                value = np.take_along_axis(scores, best, 1)
                out = pd.DataFrame({query_id: np.repeat(qid[at : at + block], best.shape[1]), item_id: own[best].ravel(), "score": value.ravel()})
                yield out[np.isfinite(out["score"])]

    rank = F.row_number().over(W.partitionBy(query_id).orderBy(F.desc("score"), item_id))
    return items.mapInPandas(run, schema).withColumn("rank", rank).filter(F.col("rank") <= k)


class CellIndex:
    """An index of cells for approximate search: centres are fitted on a bounded sample, every row is indexed.

    Each row goes to its nearest centre's cell; a query looks into its nearest cells only. sample rows at most are
    fitted on (a documented parameter); recall against the exact search is measured by recall().
    """

    def __init__(self, corpus: DataFrame, item_id: str = "item_id", vector: str = "embedding", cells: int = 16, sample: int = 20_000, rounds: int = 10, seed: int = 5):
        self.item_id, self.vector = item_id, vector
        total = corpus.count()
        part = corpus.select(vector).filter(F.col(vector).isNotNull())
        fitted = (part if total <= sample else part.sample(min(1.0, 1.2 * sample / total), seed)).limit(sample).toPandas()
        m = _matrix(fitted[vector]) if len(fitted) else np.zeros((1, 1))
        rng = np.random.default_rng(seed)
        c = m[rng.choice(len(m), min(cells, len(m)), replace=False)]
        for _ in range(rounds):
            own = np.argmax(m @ c.T, axis=1)
            c = np.stack([m[own == i].mean(0) if (own == i).any() else c[i] for i in range(len(c))])
            c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        self.centres = corpus.sparkSession.sparkContext.broadcast(c)
        self.rows = self._celled(corpus, 1).withColumnRenamed("cell", "_cell")

    def _celled(self, df: DataFrame, probes: int) -> DataFrame:
        item, vector, centres = self.item_id, self.vector, self.centres

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    near = np.argsort(-(_matrix(b[vector]) @ centres.value.T), axis=1, kind="stable")[:, :probes]
                    out = b.loc[b.index.repeat(near.shape[1])]
                    yield out.assign(cell=near.ravel().astype(np.int32))

        return df.select(F.col(item).cast("bigint").alias(item), vector).filter(F.col(vector).isNotNull()).mapInPandas(run, f"{item} long, {vector} array<float>, cell int")

    def search(self, queries: DataFrame, k: int = 3, probes: int = 8, query_id: str = "query_id", salts: int = 8) -> DataFrame:
        """As knn, over the cells that a query probes; cells are salted, so that a full one is spread."""
        item, vector = self.item_id, self.vector
        asked = self._celled(queries.select(F.col(query_id).alias(item), vector), probes).select(F.col(item).alias(query_id), F.col(vector).alias("_q"), "cell")
        spread = asked.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        rows = self.rows.withColumn("_salt", F.pmod(F.xxhash64(item), F.lit(salts)).cast("int"))
        pairs = rows.join(spread, (rows["_cell"] == spread["cell"]) & (rows["_salt"] == spread["_salt"])).select(query_id, item, cosine(F.col(vector), F.col("_q")).alias("score"))
        rank = F.row_number().over(W.partitionBy(query_id).orderBy(F.desc("score"), item))
        return pairs.withColumn("rank", rank).filter(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame, query_id: str = "query_id", item_id: str = "item_id") -> DataFrame:
    """One row: the share of the exact search's rows that were found."""
    hit = exact.select(query_id, item_id).join(found.select(query_id, item_id).withColumn("_hit", F.lit(1)), [query_id, item_id], "left")
    return hit.agg(F.count("*").alias("n"), F.count("_hit").alias("n_found")).select("n", "n_found", F.try_divide(F.col("n_found"), F.col("n")).alias("recall"))
