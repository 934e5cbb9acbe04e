"""Dense search by inverted lists: vectors of unit length in lists by their nearest centroid.

Centroids are fitted to a bounded sample; every vector is in a list. A list knows how far its vectors lie from the
centroid at most, in angle, which bounds the cosine of any of them with a query. The exact search probes a few lists of
each query, and then those whose bound reaches the k-th best cosine so far; the approximate one stops after the first
step. Queries meet vectors by list, so nothing is crossed, and a list of many vectors is several parts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import values as V
from quarry.operators import retrieval as R
from quarry.sources.tables import shared_folder, written

#: Vectors that centroids are fitted to (those with the least hashes of their ids), rounds of the fit, lists at most.
SAMPLE, ROUNDS, LISTS = 20_000, 12, 4096
#: Vectors of a part of a list, and queries that meet it together.
PART, QUERIES = 4096, 8192
#: Lists of a query that are probed first, and the share of all lists that the approximate search probes: what finds nine
#: in ten of the best 40 even among vectors without any clusters.
PROBES, SHARE = 2, 0.75
#: Cosines are compared after rounding to six places.
SLACK = 1e-5


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def centroids(vectors: DataFrame, lists: int) -> np.ndarray:
    """Spherical k-means on the sample; the same for the same vectors, however they are dealt to files."""
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()
    own = _unit(np.array([r["v"] for r in rows], np.float64))
    lists = max(1, min(lists, len(own)))
    middle = own[np.linspace(0, len(own) - 1, lists).astype(int)]
    for _ in range(ROUNDS):
        near = np.argmax(own @ middle.T, axis=1)
        sums = np.zeros_like(middle)
        np.add.at(sums, near, own)
        met = np.bincount(near, minlength=lists) > 0
        middle = np.where(met[:, None], _unit(sums), middle)
    return middle


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


class VectorLists:
    """Lists of vectors (id, v, and other columns that searches filter by), bucketed by list and part."""

    def __init__(self, vectors: DataFrame, lists: int | None = None, buckets: int = 16, path: str | None = None):
        """lists: about the square root of the vectors' count where none is given. vectors: v is of unit length, an array
        of as many numbers in each row; rows without one are left out."""
        self.spark, self.buckets = vectors.sparkSession, buckets
        self.path = (path or shared_folder(self.spark, "lists")).rstrip("/")
        vectors = vectors.where("v IS NOT NULL")
        n = vectors.count()
        self.centroids = middle = centroids(vectors, lists or min(LISTS, int(n**0.5) + 1)) if n else np.zeros((0, 0))
        kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}

        def assign(batches):
            for batch in batches:
                cos = _matrix(batch.column("v")) @ middle.T if len(batch) else np.zeros((0, 1))
                near = np.argmax(cos, axis=1)
                yield batch.append_column("list", pa.array(near, pa.int32())).append_column("near", pa.array(cos[np.arange(len(near)), near], pa.float64()))

        columns = ", ".join(f"`{c}` {kind}" for c, kind in kinds.items())
        placed = written(vectors.mapInArrow(assign, f"{columns}, list int, near double"), "placed") if n else vectors.selectExpr("*", "0 AS list", "0D AS near")
        # a row per list
        self.sizes = {r["list"]: (r["n"], r["near"]) for r in placed.groupBy("list").agg(F.count("*").alias("n"), F.min("near").alias("near")).collect()}
        parts = self.spark.createDataFrame([(k, -(-size // PART)) for k, (size, _) in self.sizes.items()], "list int, parts int")
        placed = placed.join(F.broadcast(parts), "list").withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int")).drop("parts", "near")
        self.table = "quarry_lists_" + hashlib.sha256(self.path.encode()).hexdigest()[:32]
        placed.repartition(buckets, "list", "part").write.format("parquet").mode("overwrite").bucketBy(buckets, "list", "part").sortBy("list", "part").option("path", self.path).saveAsTable(self.table)

    def routes(self, queries: DataFrame) -> DataFrame:
        """(qid, q, list, parts, nth, bound): lists of each query by their centroids' cosines, nth from 0, and the most
        that a vector of the list can have."""
        known = sorted(self.sizes)
        middle = self.centroids[known]
        reach = np.arccos(np.clip([self.sizes[k][1] for k in known], -1, 1))
        parts = np.array([-(-self.sizes[k][0] // PART) for k in known])
        numbers = np.array(known)

        def route(batches):
            for batch in batches:
                q = _matrix(batch.column("q"))
                size = np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)
                cos = q @ middle.T
                order = np.argsort(-cos, axis=1, kind="stable")
                bound = size * np.cos(np.maximum(np.arccos(np.clip(cos / size, -1, 1)) - reach, 0))
                rows = np.repeat(np.arange(len(q)), len(known))
                flat = order.ravel()
                yield pa.RecordBatch.from_arrays([batch.column("qid").take(pa.array(rows)), pa.array(numbers[flat], pa.int32()), pa.array(parts[flat], pa.int32()), pa.array(np.tile(np.arange(len(known)), len(q)), pa.int32()), pa.array(bound[rows, flat], pa.float64())], names=["qid", "list", "parts", "nth", "bound"])

        kind = queries.schema["qid"].dataType.simpleString()
        return queries.select("qid", "q").mapInArrow(route, f"qid {kind}, list int, parts int, nth int, bound double")

    def _met(self, queries: DataFrame, routes: DataFrame, k: int, where: Column | None, slices: int) -> DataFrame:
        """(qid, id, score): of each part of a list, the k best for each query that comes to it."""
        vectors = self.spark.table(self.table)
        vectors = (vectors.where(where) if where is not None else vectors).select("list", "part", "id", "v")
        asked = routes.select("qid", "list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).join(queries, "qid")
        keys = ["list", "part"]
        if slices > 1:
            asked = asked.withColumn("slice", F.pmod(F.xxhash64("qid"), F.lit(slices)).cast("int"))
            vectors = vectors.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
            keys.append("slice")
        id_kind, qid_kind = (frame.schema[c].dataType.simpleString() for frame, c in ((vectors, "id"), (queries, "qid")))

        def score(left: pa.Table, right: pa.Table) -> pa.Table:
            ids, out = right.column("id").to_numpy(), ([], [], [])
            if left.num_rows and right.num_rows:
                points = _matrix(right.column("v"))
                for at in range(0, left.num_rows, 256):
                    some = left.slice(at, 256)
                    cos = np.round(_matrix(some.column("q")) @ points.T, 6)
                    for row, qid in zip(cos, some.column("qid").to_pylist(), strict=True):
                        best = np.flatnonzero(row >= np.partition(row, -k)[-k]) if len(row) > k else np.arange(len(row))
                        best = best[np.lexsort((ids[best], -row[best]))][:k]
                        out[0].extend([qid] * len(best))
                        out[1].append(ids[best])
                        out[2].append(row[best])
            empty = [np.zeros(0)]
            return pa.table({"qid": pa.array(out[0], left.schema.field("qid").type), "id": pa.array(np.concatenate(out[1] or [ids[:0]]), right.schema.field("id").type), "score": pa.array(np.concatenate(out[2] or empty), pa.float64())})

        return asked.select(*keys, "qid", "q").groupBy(*keys).cogroup(vectors.groupBy(*keys)).applyInArrow(score, f"qid {qid_kind}, id {id_kind}, score double")

    def search(self, queries: DataFrame, k: int = V.POOL, where: Column | None = None, exact: bool = True, share: float = SHARE) -> DataFrame:
        """(qid, id, score, rank): the k vectors with the greatest cosine, of those that `where` (a test of the table's
        columns) lets through. exact: all of them; otherwise the best of the nearest lists, so large a share of all.
        queries: qid, q."""
        if not self.sizes:
            return queries.selectExpr("qid", "CAST(NULL AS BIGINT) AS id", "0D AS score", "1 AS rank").where("false")
        queries = queries.where("q IS NOT NULL")
        slices = -(-queries.count() // QUERIES) or 1
        routes = self.routes(queries)
        if not exact:
            return R.top(self._met(queries, routes.where(F.col("nth") < max(1, round(share * len(self.sizes)))), k, where, slices), k)
        routes = written(routes, "routes")
        first = written(R.top(self._met(queries, routes.where(F.col("nth") < PROBES), k, where, slices), k), "first")
        theta = first.groupBy("qid").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(-2.0).alias("theta"))
        more = routes.where(F.col("nth") >= PROBES).join(theta, "qid", "left").where(F.col("bound") >= F.coalesce("theta", F.lit(-2.0)) - SLACK)
        both = first.select("qid", "id", "score").unionByName(self._met(queries, more, k, where, slices))
        return R.top(both, k)
