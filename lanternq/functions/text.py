"""Text functions as native columns. Patterns name their character classes, since the JVM's ``\\w`` is ASCII."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternq.functions.stem import stem

TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
SENTENCE_END = r"(?<=[.!?])\s+(?=[A-Z0-9\"'(\[])"
#: The English stop words of the analyzer.
STOPWORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing "
    "down during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself just me "
    "more most my myself no nor not now of off on once only or other our ours ourselves out over own same she should so some such than that the "
    "their theirs them themselves then there these they this those through to too under until up very was we were what when where which while who "
    "whom why will with would you your yours yourself yourselves"
).split()


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def clean(text: Column) -> Column:
    """Runs of space, tab and no-break space become one space; white space around the text goes."""
    return trimmed(F.regexp_replace(text, r"[ \t\x{00A0}]+", " "))


def dehyphenated(text: Column) -> Column:
    """Joins words that a line break has hyphenated."""
    return F.regexp_replace(text, r"([\p{L}\p{N}_])- ([\p{L}\p{N}_])", "$1$2")


def token_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)))


def sentences(text: Column) -> Column:
    return F.split(text, SENTENCE_END, -1)


def raw_terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def simple_terms(text: Column) -> Column:
    """Lower-case ASCII words without stop words, duplicates and order kept."""
    return F.filter(raw_terms(text), lambda w: ~w.isin(STOPWORDS))  # the optimizer makes it one hash set


def stemmed(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with the word in ``column`` replaced by its stem. Only the distinct words go through
    Python; the stems come back by a join."""
    words = rows.select(F.col(column).alias("word_")).distinct()

    def stems(batches):
        import pyarrow as pa

        for batch in batches:
            got = [stem(w) for w in batch.column("word_").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("word_"), pa.array(got, pa.string())], ["word_", "stem_"])

    table = words.where("word_ IS NOT NULL").mapInArrow(stems, "word_ string, stem_ string")
    joined = rows.join(table, F.col(column) == F.col("word_"), "left")
    return joined.withColumn(column, F.col("stem_")).drop("word_", "stem_")


def or_query(text: Column) -> Column:
    """The distinct words of a question joined by `` | ``, for engines that take such queries."""
    return F.array_join(F.array_distinct(simple_terms(text)), " | ")


def search_text(title: Column, section: Column, context: Column, text: Column) -> Column:
    head = F.when(F.coalesce(section, F.lit("")) != "", F.concat_ws(" > ", title, section)).otherwise(title)
    return F.concat_ws("\n", *[F.nullif(c, F.lit("")) for c in (head, trimmed(context), text)])


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def document_id(content: Column) -> Column:
    return F.substring(content_hash(content), 1, 24)


def location(page_start: Column, page_end: Column, section: Column) -> Column:
    several = (page_end > 0) & (page_end != page_start)
    pages = F.when(page_start > 0, F.when(several, F.concat(F.lit("pp. "), page_start, F.lit("-"), page_end)).otherwise(F.concat(F.lit("p. "), page_start)))
    return F.concat_ws(" · ", pages, F.nullif(section, F.lit("")))


def overlap_joined(left: Column, right: Column, least: int = 21, most: int = 2000) -> Column:
    """``left`` and ``right`` with their longest common border of ``least`` characters or more written once; else
    with a blank line between."""
    # The first ``least`` characters of ``right`` stand at few places of ``left``; only from these on the ends are compared.
    seed = F.concat(F.lit(r"(?=\Q"), F.replace(F.left(right, F.lit(least)), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E)"))

    def longest(tail: Column) -> Column:
        sizes = F.transform(F.split(tail, seed, -1), lambda x: F.length(x))
        sums = F.aggregate(F.reverse(sizes), F.array().cast("array<int>"), lambda done, n: F.array_append(done, F.coalesce(F.get(done, F.size(done) - 1), F.lit(0)) + n))
        return F.transform(F.array(F.reverse(sums)), lambda ends: F.get(F.filter(ends, lambda n: (n >= least) & (n <= F.length(right)) & F.endswith(tail, F.left(right, n))), F.lit(0)))[0]

    long_enough = (F.length(left) >= least) & (F.length(right) >= least)
    n = F.when(long_enough, F.transform(F.array(F.right(left, F.lit(most))), longest)[0])
    return F.when(n.isNotNull(), F.concat(left, F.substring(right, n + 1, F.length(right)))).otherwise(F.concat(left, F.lit("\n\n"), right))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def overlap_share(query: Column, text: Column) -> Column:
    """Share of the distinct query terms that the text has."""
    own = F.array_distinct(query)
    return F.when(F.size(own) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(own, text)) / F.size(own))


def deduplicated_queries(queries: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(queries, trimmed), lambda q: q != ""))
