"""A saved vector index: cells, product-quantised residuals, and exact scores of a short list.

*Fit.* Cells (about the square root of the number of vectors) are spherical k-means centres of a bounded sample; what is left of a
vector after its centre is cut into ``parts`` stretches, and each stretch is coded by the nearest of up to 256 code words, fitted on the
same sample. The sample places centres and code words only: every vector is indexed.

*Layout.* (cell, chunk_id, code of ``parts`` bytes, embedding), laid out by groups of cells, so a search reads the
cells it probes. *Search.* A question takes its nearest cells; a task puts vectors together again from centres and code words, a piece of
bounded size at a time, multiplies them with all questions of a block and carries a short list for each question along. Only short lists,
whose length does not grow with the index, meet the vectors themselves and are scored exactly."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lanternq.functions.vectors import dot
from lanternq.operators import search

#: Vectors that a fit takes at most, for each cell and for each code word, and stretches of a vector.
SAMPLE, SAMPLE_A_CELL, SAMPLE_A_WORD, PARTS = 20_000, 24, 32, 16
#: Cells at most, groups of cells that vectors are laid out by, and questions that one pass takes.
CELLS, GROUPS, QUESTIONS = 20_000, 64, 1000
#: Exact scores for each row of a result.
SHORT_LIST = 8


def _nearest(points: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.argmin((words * words).sum(1)[None, :] - 2 * points @ words.T, axis=1)


def code_words(points: np.ndarray, many: int = 256, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """k-means of ``points``: as many words as there are distinct points, at most ``many``."""
    distinct = np.unique(points, axis=0)
    words = distinct[np.random.default_rng(seed).permutation(len(distinct))[:many]]
    for _ in range(rounds if len(distinct) > many else 0):
        own = _nearest(points, words)
        sums, n = np.zeros_like(words), np.bincount(own, minlength=len(words))
        np.add.at(sums, own, points)
        words = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], words)
    return words


@dataclass(frozen=True)
class Quantizer:
    """Centres of cells, and for each stretch (a range of components) its code words."""

    centres: np.ndarray
    cuts: list[int]
    books: list[np.ndarray]

    @classmethod
    def fitted(cls, vectors: DataFrame, cells: int, parts: int = PARTS, sample: int = SAMPLE, seed: int = 7) -> Quantizer:
        centres = search.fitted_cells(vectors, cells, sample, seed=seed)
        points = search.sampled(vectors, sample, seed)
        points = points[: 256 * SAMPLE_A_WORD]  # in the order of their hashes
        left = points - centres[np.argmax(points @ centres.T, axis=1)] if len(centres) else points
        cuts = np.linspace(0, left.shape[1], min(parts, left.shape[1]) + 1).astype(int).tolist()
        return cls(centres, cuts, [code_words(left[:, a:b]) for a, b in zip(cuts, cuts[1:])])

    def coded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell and the code of each vector, in pieces of bounded size."""
        size = max(64, search.CELLS // max(256, len(self.centres)))
        got = [self._coded(x[at : at + size]) for at in range(0, len(x), size)]
        return np.concatenate([c for c, _ in got]), np.concatenate([c for _, c in got])

    def decoded(self, cell: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Vectors as their cells and codes tell them."""
        return self.centres[cell] + np.concatenate([w[code[:, k]] for k, w in enumerate(self.books)], axis=1)

    def _coded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = np.argmax(x @ self.centres.T, axis=1)
        left = x - self.centres[cell]
        return cell, np.stack([_nearest(left[:, a:b], w).astype(np.uint8) for a, b, w in zip(self.cuts, self.cuts[1:], self.books)], axis=1)


@dataclass(frozen=True)
class VectorIndex:
    """The index below ``path``, with its quantizer and how many vectors it has."""

    rows: DataFrame
    quantizer: Quantizer
    n: int
    groups: int

    @classmethod
    def saved(cls, vectors: DataFrame, path: str, cells: int | None = None, parts: int = PARTS, groups: int = GROUPS) -> VectorIndex:
        """The index of vectors (chunk_id, embedding); those without an embedding are left out."""
        own = vectors.select("chunk_id", "embedding").where("embedding IS NOT NULL")
        n = own.count()
        cells = cells or max(1, min(CELLS, round(math.sqrt(n))))
        q = Quantizer.fitted(own, cells, parts, max(SAMPLE, SAMPLE_A_CELL * cells))
        groups = min(groups, max(1, len(q.centres)))
        kinds = dict(own.dtypes)
        sent = own.sparkSession.sparkContext.broadcast(q)

        def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    cell, code = sent.value.coded(search.matrix(batch.column("embedding")))
                    columns = [pa.array(cell.astype(np.int32)), batch.column("chunk_id"), pa.array([c.tobytes() for c in code], pa.binary()), batch.column("embedding")]
                    yield pa.RecordBatch.from_arrays(columns, ["cell", "chunk_id", "code", "embedding"])

        schema = f"cell int, chunk_id {kinds['chunk_id']}, code binary, embedding {kinds['embedding']}"
        rows = own.mapInArrow(coded, schema).withColumn("part", F.floor(F.col("cell") * groups / F.lit(max(1, len(q.centres)))).cast("int"))
        rows.repartition("part").sortWithinPartitions("part", "cell").write.partitionBy("part").parquet(f"{path}/vectors")
        spark = own.sparkSession
        books = [(k, w.ravel().tolist(), w.shape[1]) for k, w in enumerate(q.books)]
        model = [("centres", 0, q.centres.ravel().tolist(), q.centres.shape[1] if q.centres.ndim > 1 else 0)] + [("book", k, w, d) for k, w, d in books]
        model += [("counts", 0, [float(n), float(groups)], 0)]
        spark.createDataFrame(model, "kind string, k int, data array<double>, width int").coalesce(1).write.parquet(f"{path}/model")  # centres and words, whose sizes are bounded
        return cls.opened(spark, path, schema)

    @classmethod
    def opened(cls, spark: SparkSession, path: str, schema: str) -> VectorIndex:
        model = spark.read.parquet(f"{path}/model").collect()
        shaped = lambda r: np.array(r["data"]).reshape(-1, r["width"]) if r["width"] else np.zeros((0, 0))
        books = [shaped(r) for r in sorted((r for r in model if r["kind"] == "book"), key=lambda r: r["k"])]
        centres = next(shaped(r) for r in model if r["kind"] == "centres")
        n, groups = next(map(int, r["data"]) for r in model if r["kind"] == "counts")
        cuts = np.cumsum([0, *[b.shape[1] for b in books]]).tolist()
        return cls(spark.read.schema(schema + ", part int").parquet(f"{path}/vectors"), Quantizer(centres, cuts, books), n, groups)

    def short_lists(self, questions: DataFrame, size: int, probes: int) -> DataFrame | None:
        """(query_id, chunk_id, near): for each question the ``size`` best by products with decoded vectors in its ``probes`` nearest cells."""
        kind, q, out = dict(questions.dtypes)["query_id"], self.quantizer, None
        own = questions.select("query_id", "embedding").where("embedding IS NOT NULL")
        blocks = max(1, -(-own.count() // QUESTIONS))
        if not len(q.centres):
            return None
        for n in range(blocks):
            part = own.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n).toArrow()  # about QUESTIONS rows
            if not len(part):
                continue
            asked = search.matrix(part.column("embedding").combine_chunks())
            probed = np.zeros((len(asked), len(q.centres)), bool)
            np.put_along_axis(probed, np.argsort(-(asked @ q.centres.T), axis=1, kind="stable")[:, :probes], True, axis=1)
            sent = own.sparkSession.sparkContext.broadcast((part.column("query_id").combine_chunks(), asked, probed, q))

            def best(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                ids, asked, probed, q = sent.value
                held, rows = search.Best(len(ids), size), max(64, search.CELLS // len(ids))
                for batch in batches:
                    for at in range(0, batch.num_rows, rows):
                        piece = batch.slice(at, rows)
                        cell = piece.column("cell").to_numpy()
                        code = np.frombuffer(b"".join(piece.column("code").to_pylist()), np.uint8).reshape(len(cell), -1)
                        held.add(piece.column("chunk_id"), asked @ q.decoded(cell, code).T, probed[:, cell])
                yield from held.batches(ids)

            places = np.unique(np.flatnonzero(probed.any(0)) * self.groups // len(q.centres)).tolist()
            rows = self.rows.where(F.col("part").isin(places)).select("cell", "chunk_id", "code")
            got = rows.mapInArrow(best, f"query_id {kind}, chunk_id {dict(self.rows.dtypes)['chunk_id']}, score double").withColumnRenamed("score", "near")
            out = got if out is None else out.unionByName(got)
        if out is None:
            return None
        rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("near"), "chunk_id"))
        return out.withColumn("n_", rank).where(F.col("n_") <= size).drop("n_")

    def scored(self, questions: DataFrame, k: int, probes: int | None = None, short: int | None = None) -> DataFrame:
        """(query_id, chunk_id, score) with exact scores of each question's short list."""
        probes = probes or max(8, len(self.quantizer.centres) // 8)
        size = short or SHORT_LIST * k
        found = self.short_lists(questions, size, probes)
        if found is None:
            kinds = dict(questions.dtypes)["query_id"], dict(self.rows.dtypes)["chunk_id"]
            return questions.sparkSession.createDataFrame([], f"query_id {kinds[0]}, chunk_id {kinds[1]}, score double")
        pairs = found.select("query_id", "chunk_id").join(questions.select("query_id", F.col("embedding").alias("asked_")), "query_id")
        # Each pair carries a question's vector, so fewer of them are sent to all tasks than of narrow rows.
        met = self.rows.select("chunk_id", "embedding").join(search.sized(pairs, questions.count() * size, most=20_000), "chunk_id")
        return met.select("query_id", "chunk_id", dot(F.col("asked_"), F.col("embedding")).alias("score"))

    def top(self, questions: DataFrame, k: int, probes: int | None = None, short: int | None = None) -> DataFrame:
        """Approximate top-k (query_id, chunk_id, score, rank) for questions (query_id, embedding)."""
        return search.top(self.scored(questions, k, probes, short), k)
