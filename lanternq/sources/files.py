"""Files to blocks and chunks: each file goes to the reader of its format, and what fails becomes a status."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternq.config import Settings
from lanternq.functions.text import clean, search_text
from lanternq.operators import index
from lanternq.operators.chunk import chunked
from lanternq.sources import parse
from lanternq.sources.tables import materialized

LINE = "page int, n int, text string, size double, top double, bottom double"
BLOCK = ["doc_id", "pos", "text", "heading_level", "page"]
PdfLines = Callable[[bytes], tuple[str, list[dict]]]


def read_folder(spark: SparkSession, *paths: str, most_mb: int = Settings.max_upload_mb) -> DataFrame:
    """All files at or below ``paths``: path, content (null if over ``most_mb``), and error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    large = F.col("length") > most_mb * 1024 * 1024
    return files.select("path", F.when(~large, F.col("content")).alias("content"), F.when(large, F.lit("file too large")).alias("error"))


def _pdf_lines(files: DataFrame, extract: PdfLines) -> DataFrame:
    """(doc_id, title, lines, error) by a plug-in that gives the title and lines of one file."""
    line = pa.struct([("page", pa.int32()), ("n", pa.int32()), ("text", pa.string()), ("size", pa.float64()), ("top", pa.float64()), ("bottom", pa.float64())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for content in batch.column("content").to_pylist():
                try:
                    out.append((*extract(content), None))
                except Exception as e:  # recorded with the document
                    out.append(("", [], str(e)[:500]))
            titles, lines, errors = ([x[i] for x in out] for i in range(3))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(titles, pa.string()), pa.array(lines, pa.list_(line)), pa.array(errors, pa.string())], ["doc_id", "title", "lines", "error"])

    return files.select("doc_id", "content").mapInArrow(apply, f"doc_id string, title string, lines array<struct<{LINE}>>, error string")


def parsed(files: DataFrame, pdf: PdfLines | None = None, registry: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents and blocks of ``files`` (path, content, and error if known).

    Files with content that the registry has already, or that an earlier path has too, are left out. Documents are
    (document_id, hash, path, format, title, pages, status, error, created_at); the status is ``ready`` or
    ``failed``. Unsupported and too large files, files without text and files whose reader fails are ``failed`` with
    an error. Bytes that are no UTF-8 become replacement characters; a null content is an empty file."""
    given = F.col("error") if "error" in files.columns else F.lit(None).cast("string")
    rows = files.select("path", F.coalesce("content", F.lit(b"")).alias("content"), given.alias("error"))
    # A file that was not read has no content to hash: its path stands in.
    rows = rows.withColumn("hash", F.sha2(F.when(F.col("error").isNull(), F.col("content")).otherwise(F.col("path").cast("binary")), 256)).withColumn("order", F.col("path"))
    known = registry if registry is not None else files.sparkSession.createDataFrame([], "hash string, status string")
    rows = index.to_register(rows, known).drop("order").withColumn("doc_id", F.substring("hash", 1, 24)).withColumn("format", parse.file_format(F.col("path")))
    unsupported = F.concat(F.lit("Unsupported file type: "), F.coalesce(F.nullif(F.concat(F.lit("."), parse.suffix(F.col("path"))), F.lit(".")), F.lit("no extension")))
    no_pdf = F.when((F.col("format") == "pdf") & F.lit(pdf is None), F.lit("no extractor for PDF files"))
    rows = materialized(rows.withColumn("error", F.coalesce("error", F.when(F.col("format").isNull(), unsupported), no_pdf)), "files")
    good = lambda kind: rows.where((F.col("format") == kind) & F.col("error").isNull()).withColumn("text", F.make_valid_utf8(F.col("content").cast("string")))

    none = F.lit(None).cast("int")
    plain = good("text").select("doc_id", F.posexplode(parse.text_blocks(F.regexp_replace("text", "\r\n?", "\n"))).alias("pos", "text"))
    blocks = [plain.withColumn("heading_level", none).withColumn("page", none)]
    blocks.append(parse.markdown_blocks(good("markdown")).withColumn("page", none))
    read = [(good("html"), "text", parse.html_document), (good("docx"), "content", parse.docx_document)]
    found = None
    for source, column, reader in read:
        part = parse.parsed_with(source, "doc_id", column, reader)
        found = part if found is None else found.unionByName(part)
    found = materialized(found, "parsed")
    blocks.append(found.select("doc_id", F.posexplode("blocks").alias("pos", "b")).select("doc_id", "pos", "b.text", "b.heading_level", "b.page"))
    named = found.select("doc_id", "title", F.col("error").alias("failure"), none.alias("pages"))
    if pdf is not None:
        got = materialized(_pdf_lines(good("pdf"), pdf), "pdf-lines")
        laid = parse.pdf_blocks(got.select("doc_id", F.explode("lines").alias("l")).select("doc_id", "l.*"))
        blocks.append(laid)
        heads = laid.where("heading_level = 1").groupBy("doc_id").agg(F.min_by("text", "pos").alias("head"))
        pages = F.array_max(F.transform("lines", lambda x: x["page"])).alias("pages")
        titled = got.join(heads, "doc_id", "left").select("doc_id", F.coalesce(F.nullif("title", F.lit("")), "head").alias("title"), F.col("error").alias("failure"), pages)
        named = named.unionByName(titled)
    every = None
    for part in blocks:
        part = part.select(*[F.col(c).cast("int") if c == "pos" else F.col(c) for c in BLOCK]).where(clean(F.col("text")) != "")
        every = part if every is None else every.unionByName(part)
    every = materialized(every, "blocks")
    filled = every.select("doc_id").distinct().withColumn("filled", F.lit(True))
    out = rows.drop("content", "text").join(named, "doc_id", "left").join(filled, "doc_id", "left")
    error = F.coalesce("error", "failure", F.when(F.col("filled").isNull(), F.lit("no extractable text")))
    title = parse.title(F.lit(""), F.col("title"), F.regexp_replace("path", "^file:", ""))
    status = F.when(F.col("error").isNull(), "ready").otherwise("failed")
    out = out.withColumn("error", error).select(F.col("doc_id").alias("document_id"), "hash", "path", "format", title.alias("title"), "pages", status.alias("status"), "error", F.current_timestamp().alias("created_at"))
    return out, every


def ingested(files: DataFrame, settings: Settings | None = None, pdf: PdfLines | None = None, registry: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents, as ``parsed`` gives them and with chunk_count, and their chunks (chunk_id, document_id, idx, section,
    text, search_text, tokens, page_start, page_end), ready for the index."""
    s = settings or Settings()
    documents, blocks = parsed(files, pdf, registry)
    documents = materialized(documents, "documents")
    cut = chunked(blocks, s.chunk_tokens, s.chunk_overlap_tokens).withColumnRenamed("doc_id", "document_id")
    cut = cut.join(documents.select("document_id", "title"), "document_id")
    cut = cut.withColumn("search_text", search_text(F.col("title"), F.col("section"), F.lit(""), F.col("text")))
    cut = cut.withColumn("idx", F.col("idx").cast("long")).withColumn("chunk_id", F.concat("document_id", F.lit(":"), "idx"))
    chunks = materialized(cut.drop("title"), "chunks")
    counts = chunks.groupBy("document_id").agg(F.count("*").alias("chunk_count"))
    return documents.join(counts, "document_id", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0))), chunks
