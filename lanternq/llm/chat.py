"""Chat formatting with a grammar round trip.

A turn is rendered as ``<s>role[INST]text[/INST]</s>`` and a conversation as its turns, one after
the other. The parser splits at the four control strings and accepts nothing but the sequence
``<s> [INST] [/INST] </s>`` with empty text between turns; in roles and texts it drops one backslash
from what looks like a control string with backslashes after its first character.

Each turn is first rendered as it is and parsed back. Where role and text do not come back
identical, because they hold a control string or what the parser would unescape, the turn is
rendered with one backslash added after the first character of each such place. Parsing removes
exactly that backslash, and no control string is left inside, so this second form always comes back
identical. Texts without such places are never changed.

Defined results: null roles and texts count as empty; rows of a conversation are ordered by turn
(nulls first), then role, then text, and repeated rows stay; rows without conv_id form one
conversation; an empty table gives an empty result. A conversation is one training example and so
one row here; its size follows the longest conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lanternq.llm.common import text_or_empty

CONTROLS = r"</?s>|\[/?INST\]"
LEARNED = "assistant"


def escaped(text: Column) -> Column:
    once = F.regexp_replace(text, r"<(\\*/?s>)", r"<\\$1")
    return F.regexp_replace(once, r"\[(\\*/?INST\])", r"[\\$1")


def unescaped(text: Column) -> Column:
    once = F.regexp_replace(text, r"<\\(\\*/?s>)", "<$1")
    return F.regexp_replace(once, r"\[\\(\\*/?INST\])", "[$1")


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<s>"), role, F.lit("[INST]"), text, F.lit("[/INST]</s>"))


def parsed(formatted: Column) -> Column:
    """Array of (role, text) that the grammar reads from a rendered conversation; null if it does not fit."""
    marks = F.array_join(F.regexp_extract_all(formatted, F.lit(f"({CONTROLS})"), F.lit(1)), "")
    parts = F.split(formatted, CONTROLS, -1)

    def turns(part: Column) -> Column:
        n = ((F.size(part) - 1) / 4).cast("int")
        fits = (marks == F.repeat(F.lit("<s>[INST][/INST]</s>"), n)) & (F.size(part) == 4 * n + 1)
        between = F.exists(F.transform(part, lambda x, i: (i % 4 != 1) & (i % 4 != 2) & (x != "")), lambda x: x)
        read = F.transform(
            F.filter(F.transform(part, lambda x, i: F.struct((i % 4).alias("k"), x.alias("role"), F.get(part, i + 1).alias("text"))), lambda x: x["k"] == 1),
            lambda x: F.struct(unescaped(x["role"]).alias("role"), unescaped(x["text"]).alias("text")),
        )
        return F.when(fits & ~between, read)

    return F.transform(F.array(parts), turns)[0]


def formatted(conversations: DataFrame, learned: str = LEARNED) -> DataFrame:
    """One row per conversation: conv_id, formatted, turns (array of role and text, as parsed back),
    spans (array of start and length in code points of each learned text inside ``formatted``) and
    identical (whether the parse equals the source)."""
    role, text = text_or_empty("role"), text_or_empty("text")
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    plain = rendered(F.col("role"), F.col("text"))
    back = parsed(plain)
    same = F.coalesce((F.size(back) == 1) & (back[0]["role"] == F.col("role")) & (back[0]["text"] == F.col("text")), F.lit(False))
    rows = rows.withColumn("same_", ~(F.col("role").rlike(r"[<\[]") | F.col("text").rlike(r"[<\[]")) | same)
    rows = rows.withColumns({c + "_": F.when(F.col("same_"), F.col(c)).otherwise(escaped(F.col(c))) for c in ("role", "text")})
    rows = rows.withColumn("out_", rendered(F.col("role_"), F.col("text_")))
    w = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumns(
        {
            "n_": F.row_number().over(w),
            "at_": F.coalesce(F.sum(F.length("out_")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        }
    )
    turn = F.struct(
        F.col("n_").alias("n"),
        F.col("out_").alias("out"),
        F.struct("role", "text").alias("source"),
        (F.col("at_") + F.length("role_") + len("<s>[INST]")).cast("int").alias("start"),
        F.length("text_").alias("length"),
    )
    out = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t_"))
    out = out.withColumn("formatted", F.array_join(F.transform("t_", lambda t: t["out"]), ""))
    out = out.withColumn("turns", parsed(F.col("formatted")))
    spans = F.transform(F.filter("t_", lambda t: t["source"]["role"] == learned), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length")))
    return out.select("conv_id", "formatted", "turns", spans.alias("spans"), (F.col("turns") == F.transform("t_", lambda t: t["source"])).alias("identical"))


def masked_text(text: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substring(text, s["start"] + 1, s["length"]))), "")


def digests(chats: DataFrame) -> DataFrame:
    """The output of :func:`formatted`, read back and reduced to counts and digests."""
    chats = chats.withColumn("loss_", masked_text(F.col("formatted"), F.col("spans")))
    body = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(body, 256).alias("turns_sha256"),
        F.length("loss_").cast("long").alias("loss_chars"),
        F.sha2("loss_", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, k, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(k, r)),
e AS (SELECT *, length(role) + length(text) + 20
  + len(regexp_extract_all(role || chr(0) || text, '<\\*/?s>')) + len(regexp_extract_all(role || chr(0) || text, '\[\\*/?INST\]')) AS n FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), ''))::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
