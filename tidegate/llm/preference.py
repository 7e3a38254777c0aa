"""Preference formatting: the shared opening of two conversations once, and both ways it goes on.

A pair's longest common prefix of turns (same role and text, place by place) is rendered as the prompt.
What is left of either side is its completion, with the spans of characters that count for the loss:
the texts of assistant turns and their end marks. Everything is column expressions.

Cases: null roles and texts count as empty strings; turns are ordered by number, role and text, so
repeated rows and ties have one order; turns without a number or conversation are left out; if one
side opens the other, its completion is empty, and if both are equal, both are; a side without
turns is empty and shares nothing; other columns are not read; an empty table gives no rows. A
conversation is one value of the result, so it has to fit into a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOOT = "<|end|>\n"
LEARNT = "assistant"


def _rendered(turns: Column) -> Column:
    head = lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"))
    return F.array_join(F.transform(turns, lambda t: F.concat(head(t), t["text"], F.lit(FOOT))), "")


def _spans(turns: Column) -> Column:
    """array<struct<start, end>> of the learnt characters in the rendered turns."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)").alias("spans"))

    def step(done: Column, turn: Column) -> Column:
        body = done["at"] + F.length(turn["role"]) + 5
        end = body + F.length(turn["text"]) + len(FOOT)
        span = F.array(F.struct(body.cast("long").alias("start"), end.cast("long").alias("end")))
        return F.struct(
            end.cast("long").alias("at"),
            F.when(turn["role"] == LEARNT, F.concat(done["spans"], span)).otherwise(done["spans"]).alias("spans"),
        )

    return F.aggregate(turns, zero, step, lambda done: done["spans"])


def _shared(a: Column, b: Column) -> Column:
    """How many turns both sides open with."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    first = F.array_position(same, F.lit(False))
    return F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")


def pairs(
    turns: DataFrame,
    pair: Column,
    rejected: Column,
    conversation: str = "conv_id",
    number: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """(pair_id, n_common, prompt, chosen, rejected, chosen_spans, rejected_spans) of every pair.

    ``pair`` names the pair that a turn's conversation is in, ``rejected`` says on which side.
    """
    turn = F.struct(
        F.col(number).alias("number"),
        F.coalesce(role, F.lit("")).alias("role"),
        F.coalesce(text, F.lit("")).alias("text"),
    )
    side = lambda which: F.sort_array(F.collect_list(F.when(which, turn)))
    both = (
        turns.where(F.col(conversation).isNotNull() & F.col(number).isNotNull())
        .groupBy(pair.alias("pair_id"))
        .agg(side(~rejected).alias("_a"), side(rejected).alias("_b"))
        .withColumn("n_common", _shared(F.col("_a"), F.col("_b")))
    )
    rest = lambda side: F.slice(F.col(side), F.col("n_common") + 1, F.greatest(F.size(side) - F.col("n_common"), F.lit(0)))
    return both.select(
        "pair_id",
        "n_common",
        _rendered(F.slice("_a", F.lit(1), F.col("n_common"))).alias("prompt"),
        _rendered(rest("_a")).alias("chosen"),
        _rendered(rest("_b")).alias("rejected"),
        _spans(rest("_a")).alias("chosen_spans"),
        _spans(rest("_b")).alias("rejected_spans"),
    )


def neighbours(turns: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """Every even conversation as chosen against the odd one that follows it."""
    odd = F.col(conversation).bitwiseAND(1)
    return pairs(turns, F.col(conversation) - odd, odd == 1, conversation)


def digests(formatted: DataFrame) -> DataFrame:
    """Texts as SHA-256, spans as text."""
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    told = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",").alias(c)
    return formatted.select(
        "pair_id", "n_common", sha("prompt"), sha("chosen"), sha("rejected"), told("chosen_spans"), told("rejected_spans")
    )


ORACLE = """
WITH t AS (
    SELECT conv_id - (conv_id & 1) AS pair_id, conv_id & 1 AS side, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(role, ''), coalesce(text, '')) AS i
    FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL
), other AS (
    SELECT t.pair_id, min(t.i) - 1 AS n
    FROM t LEFT JOIN t AS o ON o.pair_id = t.pair_id AND o.side <> t.side AND o.i = t.i AND o.role = t.role AND o.text = t.text
    WHERE o.i IS NULL GROUP BY 1
), n AS (
    SELECT t.pair_id, CAST(least(coalesce(min(other.n), max(t.i)), max(t.i)) AS INTEGER) AS n_common
    FROM t LEFT JOIN other USING (pair_id) GROUP BY 1
), r AS (
    SELECT t.*, n_common, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS shown FROM t JOIN n USING (pair_id)
), s AS (
    SELECT *, sum(length(shown)) OVER (PARTITION BY pair_id, side, i > n_common ORDER BY i) AS stop FROM r
)
SELECT pair_id, n_common,
       sha256(coalesce(string_agg(shown, '' ORDER BY i) FILTER (side = 0 AND i <= n_common), '')) AS prompt_sha256,
       sha256(coalesce(string_agg(shown, '' ORDER BY i) FILTER (side = 0 AND i > n_common), '')) AS chosen_sha256,
       sha256(coalesce(string_agg(shown, '' ORDER BY i) FILTER (side = 1 AND i > n_common), '')) AS rejected_sha256,
       coalesce(string_agg((stop - length(text) - 8)::BIGINT || '-' || stop::BIGINT, ',' ORDER BY i)
           FILTER (side = 0 AND i > n_common AND role = 'assistant'), '') AS chosen_spans,
       coalesce(string_agg((stop - length(text) - 8)::BIGINT || '-' || stop::BIGINT, ',' ORDER BY i)
           FILTER (side = 1 AND i > n_common AND role = 'assistant'), '') AS rejected_spans
FROM s GROUP BY 1, 2"""
