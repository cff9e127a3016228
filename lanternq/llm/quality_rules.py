"""Quality rules as a short-circuit cascade of native column expressions.

Each rule is a boolean expression over statistics of a document; the contract's base rules are rules like
the others. The cascade measures on a small sample what each rule costs, statistics included, and which
documents it rejects, and then orders the rules greedily by rejection per cost: the next rule is the one
that rejects most of what the rules before it have left, for its cost. ``keep_good`` computes a
statistic only for documents that no earlier rule has rejected; ``quality_report`` returns all
statistics and asks only the rules in order. The order affects cost only: a document is kept if and only
if no rule rejects it, so the verdict does not depend on the sample.

Costs are of whole passes over the persisted sample, each row repeated until a pass outweighs the time
of a job, less a pass without a rule, and rounded to powers of four: reruns agree on the order unless a cost
lies at the border of two such steps.

Defined results: a null or blank text has no words and fails the base rule; very long texts are judged
whole; repeated rows are judged one by one; an empty table gives an empty result; extra columns, whatever
their names, are ignored by ``quality_report`` and passed through by ``keep_good``.
"""

from __future__ import annotations

import math
import re
import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternq.llm.common import SPACE, let, text_or_empty, words

SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """``rejects`` reads the columns text and n_words and those of STATISTICS; it is true for documents to reject.
    Where the cheaper ``only_if`` is false it is false too, and is not asked."""

    name: str
    rejects: str
    only_if: str = "true"


MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: The rules that every document has to pass, and the production rules. Shares are of words, of lines that
#: have a word, or of characters.
BASE = (
    Rule("few_words", f"n_words < {MIN_WORDS}"),
    Rule("repeated_words", f"100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words", f"100 * most_repeat_words > {MAX_REPEAT_PERCENT} * n_words"),
)
RULES = (
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 12 * n_words"),
    Rule("repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule("shouting", r"5 * (length(text) - length(regexp_replace(text, r'\p{Lu}', ''))) > 2 * word_chars"),
    Rule("few_letters", r"10 * length(regexp_replace(text, r'[^\p{L}]', '')) < 6 * word_chars"),
    Rule("exclamation", "regexp_count(text, '!') * 10 > n_words"),
)
#: Rows on which costs and rejections are estimated; the bound of the sample, whatever the input.
SAMPLE_ROWS = 1000
#: Seconds that a timed pass should take beyond one without a rule, and how often passes repeat the sample.
PASS_SECONDS = 0.1
REPEATS = (1, 8)


def _lines() -> Column:
    return F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)) != "")


def _windows() -> Column:
    """64-bit hashes of the 3-word windows, in order."""
    first = F.slice("w_", F.lit(1), F.greatest(F.size("w_") - 2, F.lit(0)))
    return F.transform(first, lambda x, i: F.xxhash64(x, F.get("w_", i + 1), F.get("w_", i + 2)))


def _repeat_words() -> Column:
    """Words in 3-word windows that the text has twice or more. Without two windows of one hash there are none.
    Else the windows are sorted by numbers: the upper bits of the hash and, in as few lower bits as the text
    needs, the place. Equal windows are neighbours then; only windows with a neighbour that may be equal are
    compared as strings."""
    left, right = (lambda x, b: F.call_function("shiftleft", x, b)), (lambda x, b: F.call_function("shiftright", x, b))

    def placed(h: Column) -> Column:
        def alike(k: Column, b: Column) -> Column:
            same = lambda x, i: right(x.bitwiseXOR(F.get(k, i)), b) == 0
            near = F.filter(k, lambda x, i: same(x, i - 1) | same(x, i + 1))
            at = F.transform(near, lambda x: x.bitwiseAND(left(F.lit(1).cast("long"), b) - 1).cast("int"))
            text = F.transform(at, lambda p: F.struct(F.concat_ws(" ", F.get("w_", p), F.get("w_", p + 1), F.get("w_", p + 2)).alias("g"), p.alias("p")))

            def spread(g: Column) -> Column:
                again = F.filter(g, lambda x, i: (F.get(g, i - 1)["g"] == x["g"]) | (F.get(g, i + 1)["g"] == x["g"]))
                return F.size(F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["p"], x["p"] + 1, x["p"] + 2)))))

            return let(F.sort_array(text), spread)

        bits = F.length(F.bin(F.size(h).cast("long")))
        counted = let(bits, lambda b: let(F.sort_array(F.transform(h, lambda x, i: left(right(x, b), b).bitwiseOR(i.cast("long")))), lambda k: alike(k, b)))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(counted)

    return let(_windows(), placed)


def _most_repeat_words() -> Column:
    """At most so many words are in repeated windows: a window that is not the only one of its hash makes one hash
    less, two windows less at most are single, and a window covers three words."""
    return let(_windows(), lambda h: 6 * (F.size(h) - F.size(F.array_distinct(h))))


#: What rules may read besides text and n_words: columns over text and its words w_.
STATISTICS = {
    "word_chars": lambda: F.length(F.array_join("w_", "")),
    "n_symbols": lambda: F.regexp_count("text", F.lit(SYMBOLS)),
    "n_lines": lambda: F.size(_lines()),
    "n_dup_lines": lambda: let(_lines(), lambda x: F.size(x) - F.size(F.array_distinct(x))),
    "most_repeat_words": _most_repeat_words,
    "n_repeat_words": _repeat_words,
}
REPORTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _with_words(docs: DataFrame, text: str = "text") -> DataFrame:
    step = docs.withColumn("text", text_or_empty(text)).withColumn("w_", words(F.col("text")))
    return step.withColumn("n_words", F.size("w_").cast("long"))


def _kept_apart(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``columns`` of ``rows`` behind a generator: it keeps the optimizer from copying their expressions into what
    filters on them, where the sorted windows would be computed again."""
    return rows.select(F.explode(F.array(F.struct(*columns))).alias("s_")).select("s_.*")


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with text (null: empty), n_words and all of STATISTICS. Row by row, without a shuffle; memory
    follows the longest text."""
    own = [name for name in STATISTICS if name != "most_repeat_words"]
    step = _with_words(docs, text).withColumns({name: STATISTICS[name]().cast("long") for name in own})
    kept = [c for c in docs.columns if c not in ("text", "w_", "n_words", *own)]
    return _kept_apart(step, [*kept, "text", "n_words", *own])


def _asked(rows: DataFrame, rule: Rule, open_: Column, known: set[str], out: str) -> DataFrame:
    """``rows`` with boolean ``out``: whether ``rule`` rejects, asked where ``open_``. Statistics that are not
    ``known`` yet are computed where they are needed."""
    asked = open_
    for expression in (rule.only_if, rule.rejects):
        fresh = [name for name in STATISTICS if re.search(rf"\b{name}\b", expression) and name not in known]
        if fresh:
            rows = rows.withColumns({name: F.when(asked, STATISTICS[name]().cast("long")) for name in fresh})
        if asked is open_ and rule.only_if == "true":  # other rules may read what was computed for all open documents
            known.update(fresh)
        asked = asked & F.coalesce(F.expr(expression), F.lit(False))
    return rows.withColumn(out, asked)


def base_failed() -> Column:
    return F.expr(" OR ".join(f"({rule.rejects})" for rule in BASE))


def _first_rows(docs: DataFrame, text: str, rows: int, files: int = 4) -> DataFrame:
    """Texts of ``rows`` documents. Where ``docs`` is read from many files, the same number is taken from each of a few
    files, evenly spaced in the listing; what the sample costs then does not grow with the input."""
    own = docs.select(F.col(text).alias("text"))
    found = sorted(docs.inputFiles())
    if len(found) > files:
        picked = [found[k * (len(found) - 1) // (files - 1)] for k in range(files)]
        try:
            plain = lambda path: F.regexp_replace(path, r"^(\w+):/+", "$1:/")  # noqa: E731  listings and columns differ in slashes
            parts = [docs.where(plain(F.col("_metadata.file_path")) == plain(F.lit(p))).select(F.col(text).alias("text")).limit(rows // files) for p in picked]
            out = parts[0]
            for part in parts[1:]:
                out = out.unionByName(part)
            return out
        except AnalysisException:  # not read from files directly
            pass
    return own.limit(rows)


@dataclass(frozen=True)
class Estimate:
    """Seconds of a rule for each document of the sample, and the share of documents it rejects."""

    rule: Rule
    seconds: float
    rejected: float


def estimate(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS, text: str = "text") -> tuple[list[Estimate], dict[tuple[bool, ...], int]]:
    """Cost and rejected share of each rule, and how many documents of the sample each combination of rules rejects."""
    sample = _with_words(_first_rows(docs, text, sample_rows)).persist()
    try:
        rows = sample.count()

        def timed(rule: Rule | None, repeats: int) -> float:
            many = sample.withColumn("again_", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
            many = many.withColumn("hit_", F.col("n_words") < F.col("again_")) if rule is None else _asked(many, rule, F.lit(True), set(), "hit_")
            start = time.perf_counter()
            many.agg(F.count_if("hit_")).first()
            return time.perf_counter() - start

        idle = {repeats: min(timed(None, repeats) for _ in range(2)) for repeats in REPEATS}
        found = []
        everything = sample.withColumns({name: make().cast("long") for name, make in STATISTICS.items() if name != "most_repeat_words"})
        flags = everything.select(F.array(*[F.coalesce(F.expr(r.rejects), F.lit(False)) for r in rules]).alias("r"))
        outcomes = {tuple(r["r"]): r["count"] for r in flags.groupBy("r").count().collect()}  # no more than the sample has rows
        for k, rule in enumerate(rules):
            for repeats in REPEATS:
                spent = timed(rule, repeats) - idle[repeats]
                if spent >= PASS_SECONDS:
                    break
            found.append(Estimate(rule, max(spent, 1e-4) / repeats / max(rows, 1), sum(n for hit, n in outcomes.items() if hit[k]) / max(rows, 1)))
        return found, outcomes
    finally:
        sample.unpersist()


def ordered(estimates: Sequence[Estimate], outcomes: dict[tuple[bool, ...], int]) -> list[Rule]:
    """Rules by what each rejects of the documents that those before it have left, per cost; cheap ones first
    where none is rejected, and the given order among equals."""
    cost = [4.0 ** round(math.log(max(e.seconds, 1e-12), 4)) for e in estimates]
    left, open_, out = dict(outcomes), list(range(len(estimates))), []
    while open_:
        gain = lambda k: sum(n for hit, n in left.items() if hit[k]) / cost[k]
        best = min(open_, key=lambda k: (-gain(k), cost[k], k))
        out.append(estimates[best].rule)
        open_.remove(best)
        left = {hit: n for hit, n in left.items() if not hit[best]}
    return out


def cascade(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS, text: str = "text") -> list[Rule]:
    return ordered(*estimate(docs, rules, sample_rows, text))


def first_rejection(rules: Sequence[Rule]) -> Column:
    """Name of the first of ``rules`` that rejects, null if none does. Later rules are not evaluated."""
    branches = F
    for rule in rules:
        branches = branches.when(F.coalesce(F.expr(rule.rejects), F.lit(False)), F.lit(rule.name))
    return branches.otherwise(F.lit(None).cast("string")) if rules else F.lit(None).cast("string")


def judged(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS, text: str = "text") -> DataFrame:
    """``docs`` with the statistics, base_failed, rejected_by and kept."""
    return with_verdict(docs, cascade(docs, rules, sample_rows, text), text)


def with_verdict(docs: DataFrame, rules: Sequence[Rule], text: str = "text") -> DataFrame:
    """``docs`` with the statistics, base_failed, rejected_by and kept, asking the rules in the given order."""
    stats = with_statistics(docs, text).withColumn("base_failed", base_failed())
    stats = stats.withColumn("rejected_by", F.when(F.col("base_failed"), F.lit("base")).otherwise(first_rejection(rules)))
    return stats.withColumn("kept", F.col("rejected_by").isNull())


def quality_report(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: doc_id, the statistics, base_failed and kept."""
    out = with_verdict(docs.select("doc_id", "text"), cascade(docs, rules, sample_rows))
    return out.select("doc_id", *REPORTED, "base_failed", "kept")


def with_rejection(docs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``docs`` (row_, text) as row_ and rejected_by, the first of ``rules`` that rejects. A statistic is computed
    when a rule first needs it, and only for documents that no earlier rule has rejected."""
    step, known = _with_words(docs).withColumn("by0_", F.lit(None).cast("string")), set()
    for k, rule in enumerate(rules):
        step = _asked(step, rule, F.col(f"by{k}_").isNull(), known, "hit_")
        step = step.withColumn(f"by{k + 1}_", F.when(F.col("hit_"), F.lit(rule.name)).otherwise(F.col(f"by{k}_")))
    return _kept_apart(step.withColumn("rejected_by", F.col(f"by{len(rules)}_")), ["row_", "rejected_by"])


def keep_good(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with the columns of ``docs`` as they were."""
    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row_"), docs["text"].alias("text"))
    return with_rejection(row, cascade(docs, (*BASE, *rules), sample_rows)).where("rejected_by IS NULL").select("row_.*")


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, i AS p, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT doc_id, count(DISTINCT p + k) AS n FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g), range(3) AS t(k)
  WHERE c > 1 GROUP BY doc_id),
s AS (SELECT w.doc_id, text, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(l) AS n_lines,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN r ON r.doc_id = w.doc_id),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 12 * n_words
    OR 2 * n_dup_lines > n_lines
    OR 5 * len(regexp_extract_all(text, '\p{Lu}')) > 2 * word_chars
    OR 10 * len(regexp_extract_all(text, '\p{L}')) < 6 * word_chars
    OR 10 * len(regexp_extract_all(text, '!')) > n_words) AS kept
FROM j
"""
