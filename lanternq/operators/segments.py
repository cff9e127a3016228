"""A saved index that changes: segments that are never rewritten, deletions beside them, and versions that name both.

Below its folder lie, for each append, ``data/<id>`` with ``postings`` (term, chunk_id, document_id, tf, length, block) and
``bounds`` (term, block, df, most_tf, least_length), both laid out by a bucket of the term, and ``chunks`` with the terms of each chunk;
for each deletion ``gone/<id>`` with the documents and the document frequencies that go with them; and ``versions/<n>.json``, which
names what belongs to version n. A version is written under another name and renamed, so a change that is killed leaves the
version before it, readers keep the one they opened, and of two writers one fails.

Searches read the buckets of their terms only, and of these the blocks (runs of chunks) whose best possible score reaches the k-th
best score that was found in the most promising blocks. Results equal those of an index built anew from what is left."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lanternq.config import Settings
from lanternq.functions.vectors import portable_bucket
from lanternq.operators import index, search
from lanternq.sources.tables import materialized

#: Buckets that terms are laid out by, chunks in a block, and rows up to which tables of a batch of questions are sent to all tasks.
BUCKETS = 64
BLOCK_CHUNKS = 16


class Versions:
    """Small JSON files by number in a folder of any file system that Spark can write to."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        self.of = jvm.org.apache.hadoop.fs.Path
        self.root = self.of(f"{path}/versions")
        self.files = self.root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.read_all = jvm.org.apache.commons.io.IOUtils.toString
        self.utf8 = jvm.java.nio.charset.StandardCharsets.UTF_8

    def latest(self) -> int | None:
        if not self.files.exists(self.root):
            return None
        names = [s.getPath().getName() for s in self.files.listStatus(self.root)]
        return max((int(n[:-5]) for n in names if n.endswith(".json")), default=None)

    def read(self, number: int) -> dict:
        stream = self.files.open(self.of(self.root, f"{number}.json"))
        try:
            return json.loads(self.read_all(stream, self.utf8))
        finally:
            stream.close()

    def write(self, number: int, content: dict) -> None:
        """The version as a whole or not at all; fails if there is one of that number."""
        target, own = self.of(self.root, f"{number}.json"), self.of(self.root, f"{number}.{uuid.uuid4().hex}.tmp")
        stream = self.files.create(own, False)
        try:
            stream.write(bytearray(json.dumps(content).encode()))
        finally:
            stream.close()
        if self.files.exists(target) or not self.files.rename(own, target):
            self.files.delete(own, False)
            raise FileExistsError(f"version {number} was written by another")


@dataclass(frozen=True)
class SegmentIndex:
    """One version of the index at ``path``. Changes return the next version; this one stays as it is."""

    spark: SparkSession
    path: str
    number: int
    content: dict = field(repr=False)

    @classmethod
    def created(cls, spark: SparkSession, path: str, buckets: int = BUCKETS, block_chunks: int = BLOCK_CHUNKS) -> SegmentIndex:
        content = {"buckets": buckets, "block_chunks": block_chunks, "kinds": {}, "segments": [], "gone": []}
        Versions(spark, path).write(0, content)
        return cls(spark, path, 0, content)

    @classmethod
    def opened(cls, spark: SparkSession, path: str, number: int | None = None) -> SegmentIndex:
        versions = Versions(spark, path)
        number = versions.latest() if number is None else number
        if number is None:
            raise FileNotFoundError(f"no index at {path}")
        return cls(spark, path, number, versions.read(number))

    def _next(self, **changes) -> SegmentIndex:
        content = self.content | changes
        Versions(self.spark, self.path).write(self.number + 1, content)
        return SegmentIndex(self.spark, self.path, self.number + 1, content)

    def _read(self, place: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{place}")

    def _segments(self, table: str, columns: str) -> DataFrame:
        """A table of all segments, with the version that each came with."""
        kinds = self.content["kinds"] or {"chunk_id": "long", "document_id": "long"}
        schema = columns.format(**kinds)
        parts = [self._read(f"data/{s['id']}/{table}", schema).withColumn("born", F.lit(s["born"])) for s in self.content["segments"]]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], f"{schema}, born int")

    def postings(self) -> DataFrame:
        return self._segments("postings", "term string, chunk_id {chunk_id}, document_id {document_id}, tf long, length long, block long, bucket int")

    def bounds(self) -> DataFrame:
        return self._segments("bounds", "term string, block long, df long, most_tf long, least_length long, bucket int")

    def chunks(self) -> DataFrame:
        """The chunks that are left, with their terms."""
        return self._live(self._segments("chunks", "chunk_id {chunk_id}, document_id {document_id}, length long, posts array<struct<term: string, tf: long>>"))

    def _gone(self, table: str, columns: str) -> DataFrame | None:
        if not self.content["gone"]:
            return None
        schema = columns.format(**self.content["kinds"])
        parts = [self._read(f"gone/{g['id']}/{table}", schema).withColumn("died", F.lit(g["died"])) for g in self.content["gone"]]
        return reduce(DataFrame.unionByName, parts)

    def _live(self, rows: DataFrame) -> DataFrame:
        """``rows`` without those of documents that were deleted after they came."""
        gone = self._gone("documents", "document_id {document_id}")
        if gone is None:
            return rows
        last = gone.groupBy(F.col("document_id").alias("gone_")).agg(F.max("died").alias("died_"))
        last = search.sized(last, sum(g["documents"] for g in self.content["gone"]))
        return rows.join(last, (F.col("document_id") == F.col("gone_")) & (F.col("born") < F.col("died_")), "left_anti")

    @property
    def n(self) -> int:
        return sum(s["n"] for s in self.content["segments"]) - sum(g["n"] for g in self.content["gone"])

    @property
    def avg_length(self) -> float:
        total = sum(s["length"] for s in self.content["segments"]) - sum(g["length"] for g in self.content["gone"])
        return total / self.n if self.n else 1.0

    def _written(self, posted: DataFrame) -> dict:
        """A new segment of chunks (chunk_id, document_id, length, posts)."""
        own = uuid.uuid4().hex
        place = f"{self.path}/data/{own}"
        # Neighbours in this order have their commonest word and about their length in common, so bounds of a block are close.
        commonest = F.array_max(F.transform("posts", lambda x: F.struct(x["tf"].alias("tf"), x["term"].alias("term"))))["term"]
        ordered = posted.select("chunk_id", "document_id", "length", "posts").withColumn("common_", commonest).repartitionByRange("common_", "length", "chunk_id").sortWithinPartitions("common_", "length", "chunk_id")
        number = F.monotonically_increasing_id()  # the partition above 33 bits of the place in it
        block = F.shiftright(number, 33) * F.lit(1 << 33) + F.floor(number.bitwiseAND((1 << 33) - 1) / self.content["block_chunks"])
        ordered = ordered.drop("common_").withColumn("block", block)
        ordered.write.parquet(f"{place}/chunks")
        rows = self.spark.read.schema(ordered.schema).parquet(f"{place}/chunks")
        counted = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("length")).first()
        posts = rows.select("chunk_id", "document_id", "length", "block", F.inline("posts"))
        posts = posts.withColumn("bucket", portable_bucket(F.col("term"), self.content["buckets"]).cast("int"))
        # A bucket in one file, its terms in order: a reader skips row groups by term and block too.
        posts.repartition("bucket").sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(f"{place}/postings")
        saved = self.spark.read.schema(posts.schema).parquet(f"{place}/postings")
        bounds = saved.groupBy("bucket", "term", "block").agg(F.count("*").alias("df"), F.max("tf").alias("most_tf"), F.min("length").alias("least_length"))
        bounds.repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{place}/bounds")
        return {"id": own, "born": self.number + 1, "n": counted["n"], "length": counted["length"]}

    def appended(self, chunks: DataFrame) -> SegmentIndex:
        """With new chunks (chunk_id, document_id, search_text) as one more segment; nothing that is there is read or written."""
        kinds = {c: chunks.schema[c].dataType.simpleString() for c in ("chunk_id", "document_id")}
        if self.content["kinds"] not in ({}, kinds):
            raise ValueError(f"this index has {self.content['kinds']}, not {kinds}")
        posted = index.with_posts(chunks.select("chunk_id", "document_id", "search_text")).select("chunk_id", "document_id", "length", "posts")
        own = self._written(materialized(posted, "posted"))  # analysed once: ranges are found from a sample of what is written
        return self._next(kinds=kinds, segments=[*self.content["segments"], own])

    def deleted(self, documents: DataFrame) -> SegmentIndex:
        """Without the chunks of ``documents`` (document_id). What they add to counts is written beside the segments."""
        if not self.content["segments"]:
            return self
        own = uuid.uuid4().hex
        wanted = documents.select(F.col("document_id").cast(self.content["kinds"]["document_id"])).where("document_id IS NOT NULL").distinct()
        wanted.write.parquet(f"{self.path}/gone/{own}/documents")
        wanted = self._read(f"gone/{own}/documents", f"document_id {self.content['kinds']['document_id']}")
        found = materialized(self.chunks().join(search.sized(wanted, count := wanted.count()), "document_id", "left_semi"), "gone-chunks")
        terms = found.select(F.explode("posts.term").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        terms.withColumn("bucket", portable_bucket(F.col("term"), self.content["buckets"]).cast("int")).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/gone/{own}/terms")
        sums = found.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("length")).first()
        gone = {"id": own, "died": self.number + 1, "documents": count, "n": sums["n"], "length": sums["length"]}
        return self._next(gone=[*self.content["gone"], gone])

    def compacted(self) -> SegmentIndex:
        """What is left as one segment, without deletions."""
        if not self.content["segments"]:
            return self
        return self._next(segments=[self._written(self.chunks())], gone=[])

    def weights(self, terms: DataFrame, buckets: list[int]) -> DataFrame:
        """(query_id, term, idf) of questions' distinct terms that the index has."""
        df = self.bounds().where(F.col("bucket").isin(buckets)).groupBy("term").agg(F.sum("df").alias("df"))
        gone = self._gone("terms", "term string, df long, bucket int")
        if gone is not None:
            less = gone.where(F.col("bucket").isin(buckets)).select("term", (-F.col("df")).alias("df"))
            df = df.unionByName(less).groupBy("term").agg(F.sum("df").alias("df"))
        idf = F.log(1 + (F.lit(float(self.n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        return terms.join(df.where("df > 0"), "term").select("query_id", "term", idf.alias("idf"))

    def lexical_search(self, question_terms: DataFrame, k: int, settings: Settings | None = None, scopes: DataFrame | None = None, pruned: bool = False) -> DataFrame:
        """BM25 top-k (query_id, chunk_id, score, rank) for terms (query_id, term). ``scopes`` as ``search.in_scope`` takes them.
        ``pruned`` leaves out blocks that cannot reach a question's k-th score; it takes two passes, which pay where
        questions are about few chunks. Without it, questions whose terms lie in most buckets meet the chunks with their terms, in blocks and
        with no pair shuffled, as they would read nearly all postings anyway."""
        if not pruned:
            _, buckets, weights, _ = self._asked(question_terms)
            if 2 * len(buckets) > self.content["buckets"]:
                part = self._part(settings or Settings())
                rows = self.chunks().select("chunk_id", "document_id", F.col("posts.term").alias("keys"), F.transform("posts", lambda p: part(p["tf"], F.col("length"))).alias("weights"))
                return search.sparse_top(search.listed(weights, "query_id", "term", F.col("idf")), rows, k, scopes=scopes)
        rows = self.pairs(question_terms, k, settings, scopes, pruned)
        return search.top(rows.groupBy("query_id", "chunk_id").agg(F.sum("s").alias("score")), k, positive_only=True)

    def _asked(self, question_terms: DataFrame) -> tuple[DataFrame, list[int], DataFrame, int]:
        """Questions' distinct terms, their buckets, and their weights with how many these are."""
        terms = question_terms.select("query_id", "term").where("term IS NOT NULL").distinct()
        terms = materialized(terms.withColumn("bucket", portable_bucket(F.col("term"), self.content["buckets"]).cast("int")), "question-terms")
        buckets = [r[0] for r in terms.select("bucket").distinct().collect()]  # no more rows than there are buckets
        weights = materialized(self.weights(terms, buckets), "question-weights")
        return terms, buckets, weights, weights.count()

    def _part(self, s: Settings):
        """What a term adds to a score, but for its weight."""
        return lambda tf, length: tf * (s.bm25_k1 + 1) / (tf + s.bm25_k1 * (1 - s.bm25_b + s.bm25_b * length / F.lit(float(self.avg_length))))

    def pairs(self, question_terms: DataFrame, k: int, settings: Settings | None = None, scopes: DataFrame | None = None, pruned: bool = False) -> DataFrame:
        """What ``lexical_search`` adds up: (query_id, chunk_id, s), a row for each term that a question and a chunk share."""
        part = self._part(settings or Settings())
        _, buckets, weights, asked = self._asked(question_terms)
        posts = self.postings().where(F.col("bucket").isin(buckets))

        def scored(rows: DataFrame) -> DataFrame:
            found = self._live(rows).select("query_id", "chunk_id", "document_id", (F.col("idf") * part(F.col("tf"), F.col("length"))).alias("s"))
            return search.in_scope(found, scopes).select("query_id", "chunk_id", "s")

        if not pruned:
            return scored(posts.join(search.sized(weights, asked), "term"))
        bounds = self.bounds().where(F.col("bucket").isin(buckets)).join(search.sized(weights, asked), "term")
        best = bounds.groupBy("query_id", "born", "block").agg(F.sum(F.col("idf") * part(F.col("most_tf"), F.col("least_length"))).alias("most"))
        order = W.partitionBy("query_id").orderBy(F.desc("most"), "born", "block")
        best = materialized(best.withColumn("n_", F.row_number().over(order)), "block-bounds")
        tried = k  # the k best chunks lie in k blocks at most

        def of(blocks: DataFrame, rows: int) -> DataFrame:
            """The pairs of questions and chunks in ``blocks`` (query_id, born, block)."""
            wanted = blocks.select("query_id", "born", "block").join(weights, "query_id")
            return scored(posts.join(search.sized(wanted, rows), ["term", "born", "block"]))

        first = materialized(of(best.where(F.col("n_") <= tried), tried * asked), "first-pairs")
        found = search.top(first.groupBy("query_id", "chunk_id").agg(F.sum("s").alias("score")), k, positive_only=True)
        least = found.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
        rest = best.where(F.col("n_") > tried).join(F.broadcast(least), "query_id", "left")  # a row a question at most
        rest = materialized(rest.where(F.coalesce(F.col("most") >= F.col("least") - 1e-5, F.lit(True))).drop("least"), "rest-blocks")
        return first.unionByName(of(rest, rest.join(weights.groupBy("query_id").count(), "query_id").agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]))
