"""Patterns that come as a table, of any number, found by the literals that they need.

Every match of most patterns holds one of a few literals. With all but its letters left out, a match of neighbouring
words holds one longer literal, which few texts do. Consecutive short runs of each such literal go into an index, a
text's letters are cut into runs of that length at every so many places, so that one of the consecutive runs is met, and
an equi-join gives the patterns a text may match, which are then tried on it if it holds their other literals as well. Where
the letters of a match are not known, a run of a literal with its other characters is the index's, and texts are cut at every place. A pattern without such a literal is tried on every text. Patterns
that the JVM cannot run safely are tried by Python's matcher, in a process that is ended when one text takes
too long; such a text carries an error.

Cases: texts and keys that are null have no hits; a pattern that Python does not compile, or that has no
id, stops the build; patterns that repeat an id count as alternatives, the first place of which is
the id's; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.errors import ResourceError
from tidegate.functions.patterns import needed, needed_letters, to_jvm
from tidegate.functions.plan import computed
from tidegate.operators.inference import ChunkScorer
from tidegate.operators.rules import FOLDED, LOWERED, with_matchable
from tidegate.session import broadcast_if_small, shared_dir, ship

LETTERS = "_letters"
LONG_RUN, SHORT_RUN = 6, 3
# (length of a run, places between those of a text): literals of length + places - 1 letters have all the runs that takes.
CUTS = ((12, 5), (8, 5), (6, 3), (4, 2), (3, 1))
ROWS_AT_ONCE = 64  # texts that cross to Python's matcher together
_RUN = "struct<letters:boolean,step:int,run:string>"
_COMPILED = f"n long, id string, ord long, pattern string, regex string, folded boolean, runs array<{_RUN}>, error string, clauses array<array<string>>, letters array<string>"


class Searcher:
    """Python's matcher as a classifier of (pattern, text)."""

    def __init__(self) -> None:
        self._compiled = lru_cache(1024)(lambda pattern: re.compile(pattern, re.IGNORECASE | re.UNICODE))

    def __call__(self, item: tuple[str, str]) -> list[dict]:
        pattern, text = item
        return [{"label": "hit" if self._compiled(pattern).search(text) else "none", "score": 1.0}]

    def batch(self, items: list[tuple[str, str]]) -> list[list[dict]]:
        return [self(item) for item in items]


def _run(literal: str) -> str:
    return literal[:LONG_RUN] if len(literal) >= LONG_RUN else literal[:SHORT_RUN]


def _letter_runs(literal: str) -> list[dict]:
    """Consecutive runs around the literal's middle, where a phrase's words meet."""
    size, step = next(cut for cut in CUTS if sum(cut) - 1 <= len(literal))
    first = (len(literal) - size - step + 1) // 2
    return [{"letters": True, "step": step, "run": literal[at : at + size]} for at in range(first, first + step)]


def _compile(name: str | None, pattern: str | None) -> tuple:
    """(regex or None for Python's matcher, folded, runs of which every match holds one, error, clauses of
    each of which every match holds one literal, literals of which the letters of every match hold one)."""
    if name is None or pattern is None:
        return None, None, None, "no id or no pattern", None, None
    try:
        clauses, letters = needed(name, pattern), needed_letters(name, pattern)
    except ResourceError as exc:
        return None, None, None, str(exc), None, None
    indexed = next((clause for clause in clauses if min(map(len, clause)) >= SHORT_RUN), ())
    if letters and min(map(len, letters)) >= max(SHORT_RUN, min(map(len, indexed), default=0)):
        runs = [run for literal in letters for run in _letter_runs(literal)]
    else:
        runs = [{"letters": False, "step": 1, "run": run} for run in sorted({_run(literal) for literal in indexed}) or [""]]
    try:
        jvm = to_jvm(name, pattern)
    except ResourceError:
        return None, None, runs, None, clauses, letters
    return jvm.regex, jvm.folded, runs, None, clauses, letters


def compiled(patterns: DataFrame) -> DataFrame:
    """(n, id, ord, pattern), numbered anyhow, with the form each pattern is tried in; written, for it is read more than once."""
    spark = patterns.sparkSession
    ship(spark)

    names = ["n", "id", "ord", "pattern", "regex", "folded", "runs", "error", "clauses", "letters"]

    def compile_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_compile(*pair) for pair in zip(*(batch.column(i).to_pylist() for i in (1, 3)), strict=True)]
            run = pa.struct([("letters", pa.bool_()), ("step", pa.int32()), ("run", pa.string())])
            kinds = (pa.string(), pa.bool_(), pa.list_(run), pa.string(), pa.list_(pa.list_(pa.string())), pa.list_(pa.string()))
            more = [pa.array([row[i] for row in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names)

    path = shared_dir(spark, "patterns")
    number = F.monotonically_increasing_id().alias("n")
    slim = patterns.select(F.col("id").cast("string"), F.col("ord").cast("long"), F.col("pattern").cast("string"))
    spread = slim.repartition(2 * spark.sparkContext.defaultParallelism, "pattern")  # compiling takes milliseconds a pattern
    spread.select(number, "*").mapInArrow(compile_all, _COMPILED).write.parquet(path)
    table = spark.read.schema(_COMPILED).parquet(path)
    for bad in table.where(F.col("error").isNotNull()).limit(1).collect():
        raise ResourceError(f"pattern {bad['id']}: {bad['error']}")
    return table


def _letters() -> Column:
    return F.regexp_replace(FOLDED, "[^a-z]+", "")


def _candidates(texts: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """(key, found): numbers of the patterns whose runs a text holds."""
    texts = computed(with_matchable(texts), **{LETTERS: _letters()})
    index = table.select("n", F.explode("runs").alias("run")).select("n", "run.*").distinct()
    kinds = index.select("letters", "step", F.length("run").alias("size")).distinct().collect()  # a few: those of CUTS, and three
    cuts = [
        F.array_distinct(F.regexp_extract_all(LETTERS if letters else FOLDED, F.lit(f"(?s)(?=(.{{{size}}})).{{{step}}}"), F.lit(1)))
        if size
        else F.array(F.lit(""))
        for letters, step, size in sorted(kinds)
    ]
    runs = F.concat(*cuts) if cuts else F.array().cast("array<string>")
    index = index.select("n", "run").distinct()
    met = texts.select(key, F.explode(runs).alias("run")).join(broadcast_if_small(index)[0], "run")
    return met.groupBy(key).agg(F.collect_set("n").alias("found"))


def pattern_hits(prompts: DataFrame, patterns: DataFrame, key: str = "prompt_id", timeout_s: float = 1.0) -> DataFrame:
    """(key, id, ord, error): one row for each pattern that a text matches, and one with ``error`` for each
    pattern that could not be tried on it in time."""
    table = compiled(patterns)
    texts = prompts.where(F.col(key).isNotNull() & F.col("text").isNotNull()).select(key, "text")
    side = broadcast_if_small(table.select("n", "id", "ord", "pattern", "regex", "folded", "clauses", "letters"))[0]
    # The text alone meets its candidates; it is lowered again behind the shuffle, which would carry it twice.
    met = with_matchable(texts.join(_candidates(texts, table, key), key)).drop("text").withColumn(LETTERS, _letters())
    # Literals are looked for before a pattern is compiled and tried, which costs many times as much.
    held = F.forall("clauses", lambda clause: F.exists(clause, lambda literal: F.contains(FOLDED, literal)))
    near = (F.size("letters") == 0) | F.exists("letters", lambda literal: F.contains(F.col(LETTERS), literal))
    tried = met.withColumn("n", F.explode("found")).drop("found").join(side, "n")
    matched = F.when(F.col("folded"), F.rlike(F.col(FOLDED), F.col("regex"))).otherwise(F.rlike(F.col(LOWERED), F.col("regex")))
    # In one case, since the optimizer may put a filter that stands alone before those that are to spare it.
    native = tried.where(F.when(F.col("regex").isNotNull() & near & held, matched)).select(key, "id", "ord", F.lit(None).cast("string").alias("error"))
    hits = native
    if table.where(F.col("regex").isNull()).limit(1).count():
        hits = native.unionByName(_searched(tried.where(F.col("regex").isNull() & near & held), key, timeout_s))
    return hits.groupBy(key, "id").agg(F.min("ord").alias("ord"), F.min("error").alias("error"))


def _searched(tried: DataFrame, key: str, timeout_s: float) -> DataFrame:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = ChunkScorer(Searcher, timeout_s, ROWS_AT_ONCE)
        try:
            for whole in batches:
                for at in range(0, len(whole), ROWS_AT_ONCE):
                    batch = whole.slice(at, ROWS_AT_ONCE)
                    answers = scorer.score(list(zip(*(batch.column(i).to_pylist() for i in (3, 4)), strict=True)))
                    errors = pa.array([a[2] for a in answers], pa.string())
                    kept = pa.array([a[0] == "hit" or a[2] is not None for a in answers], pa.bool_())
                    yield pa.RecordBatch.from_arrays([*batch.columns[:3], errors], [key, "id", "ord", "error"]).filter(kept)
        finally:
            scorer.end()

    kind = tried.schema[key].dataType.simpleString()
    asked = tried.select(key, "id", "ord", "pattern", LOWERED)
    return asked.mapInArrow(search, f"`{key}` {kind}, id string, ord long, error string")


def first_hits(hits: DataFrame, key: str = "prompt_id") -> DataFrame:
    """(key, id): the first pattern in the table's order that matches; failed trials do not count."""
    good = hits.where(F.col("error").isNull())
    return good.groupBy(key).agg(F.min_by("id", F.struct("ord", "id")).alias("id"))
