"""Keyword matching with dictionaries: probed in place, or joined where they are too large to travel.

A bank of up to ``PROBE_ROWS`` keywords goes with the plan (:mod:`tidegate.operators.probe`). Beyond, the
text is cut into alternating runs of word and non-word characters. A keyword's core, from its first to
its last word character, is then a run sequence with exactly its own text, so an equi-join of the
text's run n-grams with the bank finds its occurrences, and what stands before and after the core is
compared with the neighbouring runs. The leftmost-longest one is a ``min_by``. Bank size only affects
the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.errors import ResourceError
from tidegate.functions.plan import computed
from tidegate.operators.probe import Entry, probed
from tidegate.operators.rules import LOWERED, with_matchable
from tidegate.session import BROADCAST_ROWS, broadcast_if_small

_RUNS = "([0-9a-z_]+|[^0-9a-z_]+)"
# Keywords and bytes of a bank that may travel with the plan.
PROBE_ROWS, PROBE_BYTES = 20_000, 2 * 1024 * 1024
# Up to this many (length, first word) pairs are tested in place.
INLINE_HEADS = 2_000


def entries_if_few(banks: DataFrame, max_rows: int = PROBE_ROWS) -> list[Entry] | None:
    """The bank's rows on the driver, if measuring shows that they may travel with the plan."""
    rows = banks.select("bank", "keyword", "folded")
    if not broadcast_if_small(rows, max_rows, PROBE_BYTES)[1]:
        return None
    return [Entry(*row) for row in rows.distinct().collect()]


def first_keywords(prompts: DataFrame, banks: DataFrame, max_probe_rows: int = PROBE_ROWS) -> DataFrame:
    """``prompts`` with one column per bank, its first keyword; rows without any hit are left out."""
    entries = entries_if_few(banks, max_probe_rows)
    if entries is None:
        return prompts.join(first_keywords_by_join(prompts, banks), "prompt_id")
    names = sorted({e.bank for e in entries})
    found = probed(with_matchable(prompts), entries, names)
    hit = F.coalesce(*[F.col(name) for name in names]).isNotNull() if names else F.lit(False)
    return found.where(hit).select(*prompts.columns, *names)


def first_keywords_by_join(
    prompts: DataFrame,
    banks: DataFrame,
    max_broadcast_rows: int = BROADCAST_ROWS,
    salts: int = 16,
    key: str = "prompt_id",
) -> DataFrame:
    """The key plus one column per bank with its first keyword; prompts without any hit are
    absent. Rows that share a key must share their text.

    ``banks`` has ``bank``, ``keyword``, ``folded`` and ``words``; all banks share one pass over the
    text. Up to ``max_broadcast_rows`` entries it is broadcast and nothing but the hits is
    shuffled. Beyond, both sides shuffle on the n-gram, with the bank repeated ``salts`` times so
    that one n-gram found in a third of all prompts is spread out, also where these share their key.
    """
    banks = banks.withColumns(
        {
            "core": F.regexp_extract("folded", "(?s)[0-9a-z_](?:.*[0-9a-z_])?", 0),
            "pre": F.regexp_extract("folded", "^[^0-9a-z_]*", 0),
            "post": F.regexp_extract("folded", r"[^0-9a-z_]*\z", 0),
        }
    )
    names, heads, near = _shape(banks)
    grams = _grams(prompts, heads, near, key)
    entries = banks.select(F.col("core").alias("gram"), "bank", "keyword", "pre", "post")
    entries, small = broadcast_if_small(entries, max_broadcast_rows)
    if small:
        hits = _rows(grams, key).join(entries, "gram")
    else:
        salted = _rows(_earliest(grams), key).withColumn("salt", F.pmod(F.xxhash64(key, F.spark_partition_id()), F.lit(salts)).cast("int"))
        copies = F.explode(F.array(*[F.lit(i) for i in range(salts)])).alias("salt")
        hits = salted.join(entries.select("*", copies), ["gram", "salt"])
    # The character beyond an affix must be no word character: its run goes on, or the text ends.
    pre, post = F.char_length("pre"), F.char_length("post")
    hits = hits.where(
        F.col("before").endswith(F.col("pre"))
        & F.col("after").startswith(F.col("post"))
        & ((pre == 0) | F.col("opens") | (F.char_length("before") > pre))
        & ((post == 0) | F.col("closes") | (F.char_length("after") > post))
    )
    earliest = F.struct("start", -pre, -(F.char_length("gram") + post))
    return hits.groupBy(key).agg(
        *[
            F.min_by("keyword", F.when(F.col("bank") == name, earliest)).alias(name)
            for name in names
        ]
    )


def _shape(banks: DataFrame) -> tuple[list[str], dict[int, list[str] | None], int]:
    """Bank names; keyword length in words -> first words of the keywords of that length; and the
    most characters that stand before or after a core.

    With few first words in all, n-grams need only start at those (a hash-set test per word);
    with many, only the lengths are kept (as ``None``) and every word may start one.
    """
    head = F.regexp_extract("core", "^[0-9a-z_]+", 0)
    near = F.greatest(F.char_length("pre"), F.char_length("post"))
    kinds = banks.groupBy("bank", "words", head.alias("head")).agg(F.max(near).alias("near"))
    rows = kinds.limit(INLINE_HEADS + 1).collect()
    inline = len(rows) <= INLINE_HEADS
    if not inline:
        rows = banks.groupBy("bank", "words", F.when(head == "", head).alias("head")).agg(F.max(near).alias("near")).collect()
    if any(row["head"] == "" for row in rows):
        raise ResourceError("keywords without a word character, in a bank that cannot travel with the plan")
    heads: dict[int, list[str] | None] = {}
    for words in sorted({row["words"] for row in rows}):
        first = {row["head"] for row in rows if row["words"] == words}
        heads[words] = sorted(first) if inline else None
    return sorted({row["bank"] for row in rows}), heads, max((row["near"] for row in rows), default=0)


def _grams(prompts: DataFrame, heads: dict[int, list[str] | None], near: int, key: str) -> DataFrame:
    """The key and the array ``g`` of run n-grams with their first run and what stands around them."""
    cut = F.regexp_extract_all(LOWERED, F.lit(_RUNS), F.lit(1))
    runs = computed(with_matchable(prompts), runs=cut).select(key, "runs")
    first_word = F.when(F.get("runs", F.lit(0)).rlike("^[0-9a-z_]"), 1).otherwise(2)
    starts = F.when(first_word <= F.size("runs"), F.sequence(first_word, F.size("runs"), F.lit(2)))
    starts = F.coalesce(starts, F.array().cast("array<int>"))
    if all(first is not None for first in heads.values()):  # one look at each word; lengths then share what is left
        known = sorted({word for first in heads.values() for word in first})
        starts = F.filter(starts, lambda start: F.get("runs", start - 1).isin(*known)) if known else starts
    runs = computed(runs, starts=starts)

    def of_length(words: int, first: list[str] | None) -> Column:
        span = 2 * words - 1

        def opens(start: Column) -> Column:
            fits = start + span - 1 <= F.size("runs")
            return fits if first is None else fits & F.get("runs", start - 1).isin(*first)

        def gram(start: Column) -> Column:
            text = F.array_join(F.slice("runs", start, F.lit(span)), "")
            before = F.coalesce(F.get("runs", start - 2), F.lit(""))
            after = F.coalesce(F.get("runs", start + span - 1), F.lit(""))
            return F.struct(
                text.alias("gram"),
                (F.right(before, F.lit(near + 1)) if near else F.lit("")).alias("before"),
                (F.left(after, F.lit(near + 1)) if near else F.lit("")).alias("after"),
                (start == 2).alias("opens"),
                (start + span == F.size("runs")).alias("closes"),
                start.alias("start"),
            )

        return F.transform(F.filter("starts", opens), gram)

    every = F.concat(*[of_length(words, first) for words, first in sorted(heads.items())])
    return computed(runs, g=every).select(key, "g")


def _earliest(grams: DataFrame) -> DataFrame:
    """Each n-gram once per prompt and surroundings, before it is shuffled."""

    def fresh(x: Column, i: Column) -> Column:
        last = F.get("g", i - 1)
        same = [x[name] == last[name] for name in ("gram", "before", "after", "opens", "closes")]
        return (i == 0) | ~(same[0] & same[1] & same[2] & same[3] & same[4])

    ordered = grams.withColumn("g", F.array_sort("g"))
    return ordered.withColumn("g", F.filter("g", fresh))


def _rows(grams: DataFrame, key: str) -> DataFrame:
    return grams.select(key, F.explode("g").alias("g")).select(key, "g.*")
