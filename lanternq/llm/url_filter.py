"""URL filters: explicit rules first, then association rules mined with FP-growth.

A url's tokens are the words of its host, path and query, each marked with the part it is from;
numbers are no tokens. FP-growth over the labelled urls (token ``bad`` marks those with a bad label)
gives token combinations whose urls are bad; combinations below ``min_support`` (a share of the
labelled urls), below ``min_count`` or below ``min_confidence`` are pruned. The kept combinations go
into an inverted index under their rarest token. Each distinct token set of the pages is looked up
in the index by its tokens and a candidate counts if all its tokens are there.

Explicit rules are (verdict, host and path). A rule fits its host and all subdomains if the url's path
starts with the rule's path; of several the longest wins, and any of them outweighs the mined ones.

Defined results: a null url or one without ``://`` has an empty host and path, fits no explicit rule
and has no tokens, so it is allowed; repeated rows are judged one by one; without labels nothing is
mined; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternq.llm.common import sent, written

#: The explicit rules.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BAD = "bad"
MIN_SUPPORT = 0.005
MIN_COUNT = 5
MIN_CONFIDENCE = 0.6


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host(url: Column) -> Column:
    found = F.translate(F.regexp_extract(after_scheme(F.coalesce(url, F.lit(""))), r"(?s)\A([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(found, F.lit(""))


def path(url: Column) -> Column:
    return F.regexp_extract(after_scheme(F.coalesce(url, F.lit(""))), r"(?s)\A[^/?#]*([^?#]*)", 1)


def tokens(url: Column) -> Column:
    """Sorted distinct tokens: ``h:`` host, ``p:`` path and ``q:`` query or fragment words."""
    rest = F.regexp_extract(after_scheme(F.coalesce(url, F.lit(""))), r"(?s)\A[^?#]*(.*)\z", 1)

    def part(mark: str, text: Column) -> Column:
        found = F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(r"([a-z][a-z0-9]*)"), F.lit(1))
        return F.transform(found, lambda w: F.concat(F.lit(mark), w))

    return F.sort_array(F.array_distinct(F.concat(part("h:", host(url)), part("p:", path(url)), part("q:", rest))))


def explicit(host_: Column, path_: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct (verdict, rule); null if none does."""
    found = F
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host_ == name) | F.endswith(host_, F.lit("." + name))) & F.startswith(path_, F.lit(slash + rest))
        found = found.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule")))
    return found.otherwise(F.lit(None))


def mined_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_count: int = MIN_COUNT) -> DataFrame:
    """(rule array<string>, anchor) of the token combinations that foretell a bad label. ``labelled`` has
    columns tokens and bad."""
    items = labelled.select(F.when(F.col("bad"), F.array_append("tokens", F.lit(BAD))).otherwise(F.col("tokens")).alias("items"), "bad")
    n, bad = items.agg(F.count("*"), F.count_if("bad")).first()
    spark = labelled.sparkSession
    least = max(min_count, math.ceil(min_support * n))
    if not n or bad < least:
        return spark.createDataFrame([], "rule array<string>, anchor string")
    model = FPGrowth(itemsCol="items", minSupport=least / n, minConfidence=min_confidence).fit(items)
    rules = model.associationRules.where(F.col("consequent") == F.array(F.lit(BAD))).select(F.col("antecedent").alias("rule"))
    often = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    ranked = rules.withColumn("token", F.explode("rule")).join(often, "token")
    return ranked.groupBy("rule").agg(F.min_by("token", F.struct("freq", "token")).alias("anchor"))


def judged(pages: DataFrame, labelled: DataFrame, rules=RULES, **options) -> DataFrame:
    """page_id, host, path, rule and verdict of every page. ``labelled``: columns url and bad (boolean)."""
    known = labelled.select(tokens(F.col("url")).alias("tokens"), "bad")
    index = written(mined_rules(known, **options), "url-rules")
    rows = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), F.array_join(tokens(F.col("url")), " ").alias("set_"))
    sets = rows.select("set_").distinct().withColumn("t_", F.split("set_", " "))
    met = sets.withColumn("anchor", F.explode("t_")).join(index, "anchor").where(F.size(F.array_except("rule", "t_")) == 0)
    bad = written(met.select("set_", F.lit(True).alias("mined_")).distinct(), "url-sets")
    # Pages of one frequent token set stay where they are as long as the marked sets are few; else the join is dealt by
    # set, and adaptive execution splits what is skewed.
    out = rows.join(sent(bad, bad.count()), "set_", "left").withColumn("own_", explicit(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("own_.verdict"), F.when(F.col("mined_"), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", F.col("own_.rule").alias("rule"), verdict.alias("verdict"))


SQL = f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, position('://' IN coalesce(url, '')) AS pos FROM pages),
u AS (SELECT page_id, url, CASE WHEN pos > 0 THEN substr(url, pos + 3) ELSE '' END AS r FROM p),
h AS (SELECT page_id, url, translate(regexp_extract(r, '^([^/?#]*)', 1, 's'), '{UPPER}', '{LOWER}') AS host,
  regexp_extract(r, '^[^/?#]*([^?#]*)', 1, 's') AS path, regexp_extract(r, '^[^?#]*(.*)$', 1, 's') AS rest FROM u),
t AS (SELECT *, list_sort(list_distinct(list_transform(regexp_extract_all(host, '[a-z][a-z0-9]*'), lambda x: 'h:' || x)
  || list_transform(regexp_extract_all(translate(path, '{UPPER}', '{LOWER}'), '[a-z][a-z0-9]*'), lambda x: 'p:' || x)
  || list_transform(regexp_extract_all(translate(rest, '{UPPER}', '{LOWER}'), '[a-z][a-z0-9]*'), lambda x: 'q:' || x))) AS tokens FROM h),
k AS (SELECT t.*, l.quality = 0 OR l.toxic = 1 AS bad, row_number() OVER () AS i
  FROM t JOIN labels l ON l.doc_id = try_cast(regexp_extract(path, '/([0-9]+)(?:[/.]|$)', 1) AS BIGINT)),
s AS (SELECT i, bad, list_filter(tokens, lambda x, j: (m >> (j - 1)) & 1 = 1) AS rule FROM k, unnest(range(1, 1 << len(tokens))) AS r(m)),
f AS (SELECT rule FROM s GROUP BY rule HAVING count_if(bad) >= greatest({MIN_COUNT}, (SELECT ceil({MIN_SUPPORT} * count(*)) FROM k))
  AND count_if(bad) / count(*) >= {MIN_CONFIDENCE}),
m AS (SELECT DISTINCT page_id FROM t, f WHERE list_has_all(t.tokens, f.rule)),
e AS (SELECT t.page_id, v.verdict, v.rule, row_number() OVER (PARTITION BY t.page_id ORDER BY length(v.rule) DESC, v.rule) AS n
  FROM t, (VALUES {", ".join(f"('{v}', '{r}')" for v, r in RULES)}) AS v(verdict, rule)
  WHERE (host = split_part(v.rule, '/', 1) OR ends_with(host, '.' || split_part(v.rule, '/', 1)))
    AND starts_with(path, substr(v.rule, position('/' IN v.rule))))
SELECT t.page_id, host, path, e.rule, coalesce(e.verdict, CASE WHEN m.page_id IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM t LEFT JOIN e ON e.page_id = t.page_id AND e.n = 1 LEFT JOIN m ON m.page_id = t.page_id
"""
