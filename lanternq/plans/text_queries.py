"""Queries of text functions, parsers and chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanternq.functions import text as T
from lanternq.functions.vectors import portable_bucket
from lanternq.operators import chunk as C
from lanternq.operators.search import shared_keys
from lanternq.plans.registry import query, table
from lanternq.sources import parse as P

TOKENS = r"len(regexp_extract_all({0}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]'))"
SPLIT = r"string_split(regexp_replace({0}, '([.!?])\s+([A-Z0-9\"''(\[])', '\1' || chr(1) || '\2', 'g'), chr(1))"
STOP = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"
TERMS = f"list_filter(regexp_extract_all(lower({{0}}), '[a-z0-9]+'), lambda w: NOT list_contains({STOP}, w))"
#: A Markdown source from a document: title, heading, list and code around its text.
MARKDOWN = ["# ", "source", "\n\n## ", "lang", "\n\n", "text", "\n\n### Notes #\n- one\n- two\n```\n# no heading\n\n```\n\nend"]
MARKDOWN_SQL = "'# ' || source || chr(10) || chr(10) || '## ' || lang || chr(10) || chr(10) || text || chr(10) || chr(10) || '### Notes #' || chr(10) || '- one' || chr(10) || '- two' || chr(10) || '```' || chr(10) || '# no heading' || chr(10) || chr(10) || '```' || chr(10) || chr(10) || 'end'"


def markdown_source():
    return F.concat(*[F.col(x) if x in ("source", "lang", "text") else F.lit(x) for x in MARKDOWN])


@query(r"SELECT doc_id, regexp_replace(regexp_replace(text || chr(9) || '  x', '[ \t\x{00A0}]+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS cleaned FROM documents")
def clean_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.clean(F.concat("text", F.lit("\t  x"))).alias("cleaned"))


@query(r"SELECT doc_id, regexp_replace(replace(text, 'th', 'th- '), '([\p{L}\p{N}_])- ([\p{L}\p{N}_])', '\1\2', 'g') AS joined FROM documents")
def dehyphenate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.dehyphenated(F.replace("text", F.lit("th"), F.lit("th- "))).alias("joined"))


@query(f"SELECT doc_id, {TOKENS.format('text')}::INTEGER AS tokens FROM documents")
def token_count(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.token_count(F.col("text")).alias("tokens"))


@query(f"SELECT doc_id, pos - 1 AS pos, s[pos] AS sentence FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS pos FROM (SELECT doc_id, {SPLIT.format('text')} AS s FROM documents))")
def sentence_split(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence")).withColumn("pos", F.col("pos").cast("long"))


@query(f"SELECT doc_id, array_to_string({TERMS.format('text')}, ' ') AS terms FROM documents")
def analyze_terms(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(T.simple_terms(F.col("text")), " ").alias("terms"))


@query()
def stem_vocab(spark, sf):
    words = table(spark, sf, "documents").select(F.explode(T.simple_terms(F.col("text"))).alias("word")).distinct()
    return T.stemmed(words.withColumn("stem", F.col("word")), "stem")


@query(f"SELECT conv_id, turn, len({TERMS.format('text')})::INTEGER AS kept, (len(regexp_extract_all(lower(text), '[a-z0-9]+')) - len({TERMS.format('text')}))::INTEGER AS dropped FROM conversations")
def stopword_filter(spark, sf):
    kept = F.size(T.simple_terms(F.col("text")))
    return table(spark, sf, "conversations").select("conv_id", "turn", kept.alias("kept"), (F.size(T.raw_terms(F.col("text"))) - kept).alias("dropped"))


@query(f"SELECT item_id, array_to_string(list_transform(list_sort(list_transform(list_distinct(t), lambda w: struct_pack(p := list_position(t, w), w := w))), lambda x: x.w), ' | ') AS q FROM (SELECT item_id, {TERMS.format('text')} AS t FROM benchmark)")
def or_query_build(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", T.or_query(F.col("text")).alias("q"))


@query(r"SELECT doc_id, concat_ws(chr(10), nullif(CASE WHEN lang <> 'en' THEN source || ' > ' || lang ELSE source END, ''), nullif(CASE WHEN doc_id % 3 = 0 THEN 'about it' ELSE '' END, ''), nullif(text, '')) AS search_text FROM documents")
def search_text(spark, sf):
    section = F.when(F.col("lang") != "en", F.col("lang"))
    context = F.when(F.col("doc_id") % 3 == 0, F.lit(" about it ")).otherwise(F.lit(" "))
    return table(spark, sf, "documents").select("doc_id", T.search_text(F.col("source"), section, context, F.col("text")).alias("search_text"))


@query("SELECT doc_id, sha256(text) AS hash, substr(sha256(text), 1, 24) AS document_id FROM documents")
def content_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.content_hash(F.col("text")).alias("hash"), T.document_id(F.col("text")).alias("document_id"))


@query("SELECT doc_id, concat_ws(' · ', CASE WHEN a > 0 THEN CASE WHEN b > 0 AND b <> a THEN 'pp. ' || a || '-' || b ELSE 'p. ' || a END END, nullif(s, '')) AS location FROM (SELECT doc_id, doc_id % 4 AS a, doc_id % 5 AS b, CASE WHEN lang = 'fr' THEN NULL ELSE lang END AS s FROM documents)")
def passage_location(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.location(F.col("doc_id") % 4, F.col("doc_id") % 5, F.when(F.col("lang") != "fr", F.col("lang"))).alias("location"))


@query("SELECT doc_id, CASE WHEN n IS NULL THEN l || chr(10) || chr(10) || r ELSE l || substr(r, n + 1) END AS joined FROM (SELECT *, list_filter(range(least(length(l), length(r), 2000), 20, -1), lambda k: ends_with(l, left(r, k)))[1] AS n FROM (SELECT doc_id, left(text, h) AS l, substr(text, greatest(h - o, 0) + 1) AS r FROM (SELECT doc_id, text, length(text) // 2 AS h, doc_id * 37 % 2200 AS o FROM documents)))")
def join_overlap(spark, sf):
    """Each whole text cut in its middle, the second half beginning up to 2,200 characters before the cut."""
    half, back = F.floor(F.length("text") / 2).cast("int"), (F.col("doc_id") * 37 % 2200).cast("int")
    d = table(spark, sf, "documents").select("doc_id", F.left("text", half).alias("l"), F.substring(F.col("text"), F.greatest(half - back, F.lit(0)) + 1, F.length("text")).alias("r"))
    return d.select("doc_id", T.overlap_joined(F.col("l"), F.col("r")).alias("joined"))


@query("SELECT conv_id, array_to_string(list_transform(list_sort(list_transform(list_distinct(t), lambda w: struct_pack(p := list_position(t, w), w := w))), lambda x: x.w), ' / ') AS asked FROM (SELECT conv_id, list_filter(list_transform(list(text || '  ' ORDER BY turn), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') || ['x'] AS t FROM conversations GROUP BY conv_id)")
def query_dedupe(spark, sf):
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("l"))
    asked = F.concat(F.transform("l", lambda x: F.concat(x["text"], F.lit("  "))), F.array(F.lit(" "), F.lit(" x "), F.lit("x")))
    return rows.select("conv_id", F.array_join(T.deduplicated_queries(asked), " / ").alias("asked"))


@query("SELECT word, ('0x' || substr(md5(word), 1, 8))::BIGINT % 30000 AS bucket FROM (SELECT DISTINCT unnest(" + TERMS.format("text") + ") AS word FROM documents)")
def hash_bucket(spark, sf):
    words = table(spark, sf, "documents").select(F.explode(T.simple_terms(F.col("text"))).alias("word")).distinct()
    return words.select("word", portable_bucket(F.col("word"), 30000).alias("bucket"))


@query(f"SELECT doc_id, item_id, round(CASE WHEN len(u) = 0 THEN 0 ELSE len(i) / len(u) END, 6) AS jaccard, round(CASE WHEN len(q) = 0 THEN 0 ELSE len(i) / len(q) END, 6) AS overlap FROM (SELECT doc_id, item_id, q, list_distinct(list_intersect(q, t)) AS i, list_distinct(q || t) AS u FROM (SELECT doc_id, list_distinct({TERMS.format('text')}) AS t FROM documents) d, (SELECT item_id, list_distinct({TERMS.format('text')}) AS q FROM benchmark) b)")
def jaccard_terms(spark, sf):
    """All questions against all documents."""
    terms = lambda name, id_, out: table(spark, sf, name).select(F.col(id_).alias(out), F.array_distinct(T.simple_terms(F.col("text"))).alias("keys"))
    pairs = shared_keys(terms("benchmark", "item_id", "query_id"), terms("documents", "doc_id", "chunk_id"))
    shared, both = F.when(F.col("asked").isNotNull() & F.col("own").isNotNull(), F.col("shared")), F.col("asked") + F.col("own") - F.col("shared")
    share = lambda of: F.round(F.when(of == 0, F.lit(0.0)).otherwise(shared / of), 6)
    return pairs.select(F.col("chunk_id").alias("doc_id"), F.col("query_id").alias("item_id"), share(both).alias("jaccard"), share(F.col("asked")).alias("overlap"))


@query(r"SELECT doc_id, pos - 1 AS pos, p[pos] AS text FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS pos FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(replace(text, '. ', '.' || chr(10) || ' ' || chr(10)), '\n\s*\n'), lambda x: regexp_replace(regexp_replace(x, '[ \t\x{00A0}]+', ' ', 'g'), '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS p FROM documents))")
def parse_text(spark, sf):
    text = F.replace("text", F.lit(". "), F.lit(".\n \n"))
    return table(spark, sf, "documents").select("doc_id", F.posexplode(P.text_blocks(text)).alias("pos", "text")).withColumn("pos", F.col("pos").cast("long"))


_MARKDOWN_CTE = rf"""
l AS (SELECT doc_id, n, regexp_replace(l[n], '\s+$', '') AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS n FROM (SELECT doc_id, string_split({MARKDOWN_SQL}, chr(10)) AS l FROM documents))),
f AS (SELECT *, regexp_matches(line, '^\s*```') AS fence, sum(regexp_matches(line, '^\s*```')::INTEGER) OVER (PARTITION BY doc_id ORDER BY n) AS fences FROM l),
k AS (SELECT *, CASE WHEN fence OR fences % 2 = 1 THEN 'body' WHEN regexp_matches(line, '^#{{1,6}}\s+') THEN 'heading' WHEN line = '' THEN 'blank' ELSE 'body' END AS kind FROM f),
s AS (SELECT *, (kind <> 'body' OR coalesce(lag(kind) OVER (PARTITION BY doc_id ORDER BY n), '') <> 'body')::INTEGER AS starts FROM k),
g AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY n) AS pos FROM s),
b AS (SELECT doc_id, pos::BIGINT AS pos, first(kind) AS kind, bool_or(regexp_matches(line, '^\s*([-*+]\s|[0-9]+[.)]\s|\||```|    )')) AS structured, string_agg(line, chr(10) ORDER BY n) AS a, string_agg(regexp_replace(line, '^\s+|\s+$', '', 'g'), ' ' ORDER BY n) AS c FROM g WHERE kind <> 'blank' GROUP BY doc_id, pos),
blocks AS (SELECT doc_id, pos, CASE WHEN kind = 'heading' THEN trim(regexp_replace(a, '^#{{1,6}}\s+', ''), ' #') WHEN structured THEN a ELSE c END AS text, CASE WHEN kind = 'heading' THEN length(regexp_extract(a, '^(#{{1,6}})', 1)) END::INTEGER AS heading_level FROM b)"""


@query(f"WITH {_MARKDOWN_CTE} SELECT * FROM blocks")
def parse_markdown(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", markdown_source().alias("text"))
    return P.markdown_blocks(docs).select("doc_id", F.col("pos").cast("long").alias("pos"), "text", "heading_level")


_SECTION_SQL = "nullif(concat_ws(' > ', " + ", ".join(
    f"CASE WHEN coalesce(h{n}.pos, -1) > greatest(-1, {', '.join([f'coalesce(h{k}.pos, -1)' for k in range(1, n)] or ['-1'])}) THEN h{n}.text END" for n in range(1, 4)
) + "), '')"


@query(f"""WITH {_MARKDOWN_CTE}, o AS (SELECT doc_id, pos, text, heading_level,
  {", ".join(f"last(CASE WHEN heading_level = {n} THEN struct_pack(pos := pos, text := text) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS h{n}" for n in (1, 2, 3))} FROM blocks)
SELECT doc_id, pos, {_SECTION_SQL} AS section FROM o""")
def section_path(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", markdown_source().alias("text"))
    return C.section_paths(P.markdown_blocks(docs)).select("doc_id", F.col("pos").cast("long").alias("pos"), "section")


BUDGET, OVERLAP = 64, 16
_STEP = max(1, int(BUDGET * 0.7))
#: Pieces (k, s, t) of each line of a document, in SQL.
_PIECES_SQL = rf"""
ln AS (SELECT doc_id, n, l[n] AS text FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))),
st AS (SELECT doc_id, n, i, s[i] AS s, {TOKENS.format('text')} <= {BUDGET} AS whole FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, n, text, CASE WHEN {TOKENS.format('text')} <= {BUDGET} THEN [text] ELSE {SPLIT.format('text')} END AS s FROM ln))),
wd AS (SELECT doc_id, n, i, CASE WHEN whole OR {TOKENS.format('s')} <= {BUDGET} THEN [s] ELSE (SELECT list(array_to_string(w[j:j + {_STEP - 1}], ' ') ORDER BY j) FROM (SELECT w, unnest(range(1, len(w) + 1, {_STEP})) AS j FROM (SELECT list_filter(regexp_split_to_array(s, '\s+'), lambda x: x <> '') AS w))) END AS p FROM st),
ps AS (SELECT doc_id, n, i, j, p[j] AS s, {TOKENS.format('p[j]')}::INTEGER AS t FROM (SELECT doc_id, n, i, p, unnest(range(1, len(p) + 1)) AS j FROM wd)),
pieces AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n, i, j) AS k, s, t FROM ps)"""


@query(f"WITH {_PIECES_SQL} SELECT doc_id, k, s, t FROM pieces")
def piece_split(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.flatten(F.transform(F.split("text", "\n", -1), lambda x: C.pieces(x, BUDGET))).alias("p"))
    return rows.select("doc_id", F.posexplode("p").alias("k", "p")).select("doc_id", (F.col("k") + 1).cast("long").alias("k"), "p.s", "p.t")


def _suffix_sql(items: str, most: str) -> str:
    n = f"coalesce(list_min(list_filter(range(1, len({items}) + 1), lambda a: list_sum(list_transform(({items})[a:], lambda x: x.t)) <= {most})), len({items}) + 1)"
    return f"({items})[{n}:]"


_TAIL = f"list_transform({SPLIT.format('cur[-1].s')}, lambda x: struct_pack(s := x, t := {TOKENS.format('x')}::INTEGER))"


def _pack_sql(overlap: int) -> str:
    rest = _suffix_sql(_suffix_sql(_TAIL, str(overlap)), f"{BUDGET} - t") if overlap else "[]"
    return f"""WITH RECURSIVE {_PIECES_SQL},
pp AS MATERIALIZED (SELECT doc_id, k, s, t, max(k) OVER (PARTITION BY doc_id) AS m FROM pieces),
w AS (SELECT doc_id, k, m, [struct_pack(s := s, t := t)] AS cur, 1 AS chunk, NULL::STRUCT(s VARCHAR, t INTEGER)[] AS out FROM pp WHERE k = 1
  UNION ALL SELECT doc_id, k, m, CASE WHEN fl THEN {rest} ELSE cur END || [struct_pack(s := s, t := t)], chunk + fl::INTEGER, CASE WHEN fl THEN cur END
  FROM (SELECT pp.doc_id, pp.k, pp.m, pp.s, pp.t, w.cur, w.chunk, list_sum(list_transform(w.cur, lambda x: x.t)) + pp.t > {BUDGET} AS fl FROM w JOIN pp ON pp.doc_id = w.doc_id AND pp.k = w.k + 1)),
c AS (SELECT doc_id, chunk - 1 AS n, out AS x FROM w WHERE out IS NOT NULL UNION ALL SELECT doc_id, chunk, cur FROM w WHERE k = m)
SELECT doc_id, n - 1 AS idx, regexp_replace(array_to_string(list_transform(x, lambda y: y.s), ' '), '^\\s+|\\s+$', '', 'g') AS text, list_sum(list_transform(x, lambda y: y.t))::INTEGER AS tokens FROM c"""


def _line_pieces(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.flatten(F.transform(F.split("text", "\n", -1), lambda x: C.pieces(x, BUDGET))).alias("p"))


def _packed(spark, sf, overlap):
    rows = _line_pieces(spark, sf).withColumn("c", C.packed(F.col("p"), BUDGET, overlap))
    return C.exploded(rows.select("doc_id", "c"), "c", "idx", "chunk").select("doc_id", "idx", "chunk.text", "chunk.tokens")


@query(_pack_sql(0))
def chunk_pack(spark, sf):
    return _packed(spark, sf, 0)


@query(_pack_sql(OVERLAP))
def chunk_overlap(spark, sf):
    return _packed(spark, sf, OVERLAP)


@query(f"SELECT doc_id, count(*) AS chunks, sum(tokens)::BIGINT AS tokens, max(tokens) AS most, sum((tokens > {BUDGET})::INTEGER)::BIGINT AS over FROM ({_pack_sql(OVERLAP)}) GROUP BY doc_id")
def chunk_stats(spark, sf):
    over = F.sum((F.col("tokens") > BUDGET).cast("long")).alias("over")
    return _packed(spark, sf, OVERLAP).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("most"), over)


@query()
def parse_html(spark, sf):
    rows = P.parsed_with(table(spark, sf, "pages"), "page_id", "html", P.html_document)
    return rows.select("page_id", "title", F.posexplode("blocks").alias("pos", "b")).select("page_id", "title", "pos", "b.text", "b.heading_level")


@query("SELECT page_id, CASE suffix WHEN 'html' THEN 'html' WHEN 'md' THEN 'markdown' WHEN 'txt' THEN 'text' ELSE NULL END AS format, name || ' x' AS title FROM (SELECT page_id, ['html', 'md', 'txt', 'png'][page_id % 4 + 1] AS suffix, 'page ' || page_id AS name FROM pages)")
def parse_dispatch(spark, sf):
    names = F.array(*[F.lit(x) for x in ("HTML", "md", "Txt", "png")])
    path = F.concat(F.lit("/in/page_"), F.col("page_id"), F.lit("-x."), F.get(names, (F.col("page_id") % 4).cast("int")))
    return table(spark, sf, "pages").select("page_id", P.file_format(path).alias("format"), P.title(F.lit(""), F.lit(""), path).alias("title"))


@query()
def contextualize(spark, sf):
    from lanternq.operators.context import contextualized, first_sentence

    chunks = _packed(spark, sf, OVERLAP).join(table(spark, sf, "documents").select("doc_id", F.col("text").alias("document")), "doc_id")
    return contextualized(chunks, first_sentence)


