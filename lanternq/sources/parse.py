"""Documents to blocks. Text and Markdown are native; HTML and DOCX need a parser and go through Arrow.

A block is a struct (text, page, heading_level); heading_level is null for body text.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lanternq.functions.text import clean, dehyphenated, trimmed

BLOCKS = "array<struct<text: string, page: int, heading_level: int>>"
FORMATS = {"pdf": "pdf", "docx": "docx", "md": "markdown", "markdown": "markdown", "txt": "text", "html": "html", "htm": "html"}
STRUCTURED = r"^\s*([-*+]\s|\p{Nd}+[.)]\s|\||```|    )"


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def file_format(path: Column) -> Column:
    """The reader for a file name, null for unsupported ones."""
    table = F.create_map(*[F.lit(x) for pair in FORMATS.items() for x in pair])
    return table[suffix(path)]


def stem_title(path: Column) -> Column:
    name = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    return F.regexp_replace(name, "[_-]", " ")


def title(given: Column, parsed: Column, path: Column) -> Column:
    empty = F.lit("")
    return F.coalesce(F.nullif(given, empty), F.nullif(parsed, empty), stem_title(path))


def text_blocks(text: Column) -> Column:
    """Paragraphs of a plain text; blank ones are dropped."""
    return F.filter(F.transform(F.split(text, r"\n\s*\n", -1), clean), lambda p: p != "")


def markdown_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, text, heading_level) of a Markdown table, one row a block. Fences, headings and blank lines
    cut a document's lines into groups; a group of body lines is one block."""
    lines = docs.select(key, F.posexplode(F.split(F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), r"\n\z", ""), "\n", -1)).alias("n", "raw"))
    lines = lines.withColumn("line", F.regexp_replace("raw", r"\s+$", ""))
    order = W.partitionBy(key).orderBy("n")
    fence = F.col("line").rlike(r"^\s*```")
    lines = lines.withColumn("fence", fence).withColumn("fences", F.sum(F.col("fence").cast("int")).over(order))
    code = ~F.col("fence") & (F.col("fences") % 2 == 1)
    lines = lines.withColumn("kind", F.when(F.col("fence") | code, "body").when(F.col("line").rlike(r"^#{1,6}\s+"), "heading").when(F.col("line") == "", "blank").otherwise("body"))
    starts = (F.col("kind") != "body") | (F.lag("kind").over(order) != "body") | F.lag("kind").over(order).isNull()
    lines = lines.withColumn("block", F.sum(starts.cast("int")).over(order)).where("kind <> 'blank'")
    body = F.sort_array(F.collect_list(F.struct("n", "line")))
    grouped = lines.groupBy(key, "block").agg(F.first("kind").alias("kind"), F.bool_or(F.col("line").rlike(STRUCTURED)).alias("structured"), body.alias("l"))
    first = F.col("l")[0]["line"]
    joined = F.when(F.col("structured"), F.array_join(F.transform("l", lambda x: x["line"]), "\n")).otherwise(F.array_join(F.transform("l", lambda x: trimmed(x["line"])), " "))
    heading = F.btrim(F.regexp_replace(first, r"^#{1,6}\s+", ""), F.lit(" #"))
    level = F.length(F.regexp_extract(first, "^(#{1,6})", 1))
    is_heading = F.col("kind") == "heading"
    return grouped.select(key, F.col("block").alias("pos"), F.when(is_heading, heading).otherwise(joined).alias("text"), F.when(is_heading, level).alias("heading_level"))


SKIPPED = {"script", "style", "nav", "footer", "header", "noscript"}
WANTED = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "pre", "td"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}


class _Blocks(HTMLParser):
    """Collects the text of wanted elements in document order; nested ones get their text twice, and an
    element that is never closed ends with the one around it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int | None]] = []
        self.found: list[tuple[str, list[str]]] = []
        self.title: list[str] | None = None
        self.titled = False

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        at = None
        if tag in WANTED and not any(t in SKIPPED for t, _ in self.open):
            at = len(self.found)
            self.found.append((tag, []))
        if tag == "title" and self.title is None:
            self.title, self.titled = [], True
        self.open.append((tag, at))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                break
        if tag == "title":
            self.titled = False

    def handle_data(self, data):
        if self.titled and self.title is not None:
            self.title.append(data)
        if not any(t in SKIPPED for t, _ in self.open):
            for _, at in self.open:
                if at is not None:
                    self.found[at][1].append(data)


def _clean(text: str) -> str:
    return re.sub("[ \t ]+", " ", text).strip()


def html_document(source: str) -> tuple[str, list[dict]]:
    """Title and blocks of one page."""
    parser = _Blocks()
    parser.feed(source)
    parser.close()
    blocks = [{"text": text, "page": None, "heading_level": int(tag[1]) if tag[0] == "h" else None} for tag, parts in parser.found if (text := _clean(" ".join(parts)))]
    return _clean("".join(parser.title or [])), blocks


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_document(content: bytes) -> tuple[str, list[dict]]:
    """Title and blocks of a DOCX file: paragraphs in order, then tables with cells joined by `` | ``."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        core = ElementTree.fromstring(z.read("docProps/core.xml")) if "docProps/core.xml" in z.namelist() else None
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
    blocks = []
    for p in body.findall(f"{_W}p"):
        style = p.find(f"{_W}pPr/{_W}pStyle")
        name = (style.get(f"{_W}val") or "").lower().replace(" ", "") if style is not None else ""
        m = re.fullmatch(r"heading(\d)", name)
        if line := text(p).strip():
            blocks.append({"text": line, "page": None, "heading_level": 1 if name == "title" else int(m[1]) if m else None})
    for table in body.findall(f"{_W}tbl"):
        rows = [" | ".join(text(c).strip() for c in row.findall(f"{_W}tc")) for row in table.findall(f"{_W}tr")]
        blocks.append({"text": "\n".join(rows), "page": None, "heading_level": None})
    found = core.find("{http://purl.org/dc/elements/1.1/}title") if core is not None else None
    named = (found.text or "").strip() if found is not None else ""
    return named or next((b["text"] for b in blocks if b["heading_level"] == 1), ""), blocks


#: Bytes of content that are objects of Python at once, unless a single content is longer.
PIECE_BYTES = 2_000_000


def cut_by_bytes(batch: pa.RecordBatch, column: str, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """``batch`` in pieces whose ``column`` has at most ``most`` bytes, or a single row."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    ends, most, at = np.cumsum(sizes, dtype=np.int64), most or PIECE_BYTES, 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def parsed_with(docs: DataFrame, key: str, content: str, parser) -> DataFrame:
    """(key, title, blocks, error) with ``parser`` applied to each content; a failure fills error (500
    characters at most) and never stops the job. A task holds the objects of a piece of a batch only."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("text", pa.string()), ("page", pa.int32()), ("heading_level", pa.int32())]))
        for batch in (piece for whole in batches for piece in cut_by_bytes(whole, "content")):
            titles, blocks, errors = [], [], []
            for value in batch.column("content").to_pylist():
                try:
                    name, found = parser(value if value is not None else "")
                    error = None if found else "no extractable text"
                except Exception as e:  # recorded with the document
                    name, found, error = "", [], str(e)[:500]
                titles.append(name)
                blocks.append(found)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(titles, pa.string()), pa.array(blocks, kind), pa.array(errors, pa.string())], ["key", "title", "blocks", "error"])

    rows = docs.select(F.col(key).alias("key"), F.col(content).alias("content"))
    return rows.mapInArrow(apply, f"key {dict(rows.dtypes)['key']}, title string, blocks {BLOCKS}, error string").withColumnRenamed("key", key)


def line_size(glyphs: Column) -> Column:
    """The median of an array of glyph sizes, 0 if there are none."""
    own = F.array_sort(glyphs)
    n = F.size(own)
    middle = (F.get(own, F.floor((n - 1) / 2).cast("int")) + F.get(own, F.floor(n / 2).cast("int"))) / 2
    return F.when(n > 0, middle).otherwise(F.lit(0.0))


def pdf_blocks(lines: DataFrame) -> DataFrame:
    """Blocks from the lines of PDF files: (doc_id, page, n, text, size, top, bottom), one row a line; in place of
    size an array ``glyphs`` of glyph sizes will do. The body size is the median; sizes over 1.15 times it, to one
    decimal, are headings, the largest level 1; a paragraph ends at a heading, a page, or a gap of over 0.9 times the
    line's size. Blank lines count for sizes only."""
    if "size" not in lines.columns:
        lines = lines.withColumn("size", line_size(F.col("glyphs")))
    lines = lines.withColumn("round", F.bround("size", 1)).withColumn("text", clean(F.col("text")))
    body = lines.groupBy("doc_id").agg(F.median("size").alias("body"))
    large = lines.join(body, "doc_id").where("size > 1.15 * body").select("doc_id", "round").distinct()
    levels = large.withColumn("level", F.least(F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("round"))), F.lit(6)))
    sized = lines.where("text <> ''").join(levels, ["doc_id", "round"], "left")
    plain = (F.length("text") > 120) | F.col("text").rlike("[.,;]$")
    sized = sized.withColumn("heading_level", F.when(~plain, F.col("level")))
    order = W.partitionBy("doc_id").orderBy("page", "n")
    gap = F.col("top") - F.lag("bottom").over(order) > 0.9 * F.col("size")
    starts = F.col("heading_level").isNotNull() | F.lag("heading_level").over(order).isNotNull() | (F.lag("page").over(order) != F.col("page")) | gap | F.lag("page").over(order).isNull()
    sized = sized.withColumn("pos", F.sum(F.coalesce(starts, F.lit(False)).cast("int")).over(order))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "n", "text"))), lambda x: x["text"]), " ")
    out = sized.groupBy("doc_id", "pos").agg(F.min("page").alias("page"), F.first("heading_level", ignorenulls=True).alias("heading_level"), text.alias("text"))
    return out.withColumn("text", dehyphenated(F.col("text")))


def read_corpus(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Corpus, queries and judgements of a folder with corpus.jsonl, queries.jsonl and qrels/test.tsv. Of
    repeated judgements of one pair the last line counts."""
    corpus = spark.read.schema("_id string, title string, text string").json(f"{folder}/corpus.jsonl").where("_id IS NOT NULL")
    asked = spark.read.schema("_id string, text string").json(f"{folder}/queries.jsonl").where("_id IS NOT NULL")
    qrels = spark.read.option("sep", "\t").option("header", True).schema("`query-id` string, `corpus-id` string, score int").csv(f"{folder}/qrels/test.tsv")
    last = qrels.withColumn("n", F.monotonically_increasing_id()).groupBy("query-id", "corpus-id").agg(F.max_by("score", "n").alias("score"))
    return corpus, asked, last
