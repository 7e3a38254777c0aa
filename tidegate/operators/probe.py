"""Keyword matching by probing a dictionary in place, for banks too large to be one expression.

Each text is looked through once with array expressions over hash sets that travel with the plan: no
join, no explode, no aggregate, so it runs as it is in streams and behind costly stages. A test on the
words of a text settles most rows; only where some keyword's words stand in a row are they joined with
what lies between them in the text, which gives the exact spelling.

A keyword is indexed by its *core*, from its first to its last word character. What stands before and
after the core is compared with the neighbouring runs. Keywords without any word character, which
words cannot index, are found by one prefix-sharing expression.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.functions.keywords import as_written, keyword_regex
from tidegate.functions.plan import computed
from tidegate.operators.rules import LOWERED

_CORE = re.compile("[0-9a-z_](?:.*[0-9a-z_])?", re.DOTALL)
_WORDS = re.compile("[0-9a-z_]+")
_FOUND = "_found"


@dataclass(frozen=True)
class Entry:
    """A lower-case keyword cut at its core; ``core`` is empty if it has no word character."""

    bank: str
    keyword: str
    folded: str

    @property
    def core(self) -> str:
        found = _CORE.search(self.folded)
        return found.group() if found else ""

    @property
    def affixes(self) -> tuple[str, str]:
        found = _CORE.search(self.folded)
        return (self.folded[: found.start()], self.folded[found.end() :]) if found else ("", "")


def _in(column: str, values: Iterable[str]) -> str:
    quoted = ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in sorted(set(values)))
    return f"{column} IN ({quoted})" if quoted else "false"


def _by_length(entries: list[Entry]) -> dict[int, list[list[str]]]:
    """Number of words -> the words of each core with that many."""
    out: dict[int, list[list[str]]] = {}
    for core in {e.core for e in entries} - {""}:
        words = _WORDS.findall(core)
        out.setdefault(len(words), []).append(words)
    return dict(sorted(out.items()))


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _worded(text: str, banks: list[list[Entry]]) -> str:
    """For each bank (``b0``, ``b1`` ...) place in characters, size and spelling of its first keyword with a core.

    ``w`` is the words, ``h`` the places among them where the words of a core stand one after the other,
    whatever lies between them; ``b.s`` is what lies between, of which ``b.lead`` (0 or 1) before the first;
    ``n`` is every core found, with what stands before and after it.
    """
    cores = _by_length([e for bank in banks for e in bank])
    spellings = {e.core for bank in banks for e in bank} - {""}
    heads = {words[0] for group in cores.values() for words in group}
    tests, parts = [], []
    for n, group in cores.items():
        first = [words[0] for words in group]
        spelled = "get(w, i)"
        if n == 1:
            tests.append(_in("x", first))
        else:
            in_a_row = _in(f"array_join(slice(w, i + 1, {n}), ' ')", [" ".join(words) for words in group])
            tests.append(f"({_in('x', first)} AND {in_a_row})")
            spelled = f"aggregate(sequence(1, {n - 1}), get(w, i), (a, k) -> concat(a, get(b.s, b.lead + i + k - 1), get(w, i + k)))"
        starts = f"filter(h, i -> i + {n} <= size(w) AND {_in('get(w, i)', first)})"
        grams = f"transform({starts}, i -> struct(i AS i, {spelled} AS gram))"
        parts.append(
            f"""transform(filter({grams}, g -> {_in('g.gram', spellings)}), g -> struct(g.i AS i, g.gram AS gram,
                coalesce(get(b.s, g.i - 1 + b.lead), '') AS before, g.i = 0 AS opens,
                coalesce(get(b.s, g.i + {n - 1} + b.lead), '') AS after, g.i + {n} = size(w) AS closes))"""
        )
    between = f"""struct(regexp_extract_all({text}, '[^0-9a-z_]+', 0) AS s,
        CASE WHEN {text} RLIKE '^[0-9a-z_]' THEN 0 ELSE 1 END AS lead)"""
    firsts = ", ".join(f"{_first(bank)} AS b{k}" for k, bank in enumerate(banks))
    found = _let("b", between, _let("n", f"concat({', '.join(parts)})", f"struct({firsts})"))
    starts = f"array_compact(transform(w, (x, i) -> CASE WHEN {_in('x', heads)} AND ({' OR '.join(tests)}) THEN i END))"
    return _let("w", f"regexp_extract_all({text}, '[0-9a-z_]+', 0)", _let("h", starts, f"CASE WHEN size(h) > 0 THEN {found} END"))


def _first(bank: list[Entry]) -> str:
    """The first of the bank's keywords among the cores ``n``: by word, then by how far it reaches before that."""
    plain = [e.folded for e in bank if e.core and e.affixes == ("", "")]
    odd: dict[str, list[dict[str, str]]] = {}
    for e in bank:
        if e.core and e.affixes != ("", ""):
            pre, post = e.affixes
            odd.setdefault(e.core, []).append({"pre": pre, "post": post, "keyword": e.folded})

    def hit(before: str, keyword: str) -> str:
        return f"struct(g.i AS i, -{before} AS before, -char_length({keyword}) AS size, {keyword} AS keyword)"

    found = []
    if plain:
        found.append(f"transform(filter(n, g -> {_in('g.gram', plain)}), g -> {hit('0', 'g.gram')})")
    if odd:
        kind = "map<string,array<struct<pre:string,post:string,keyword:string>>>"
        table = f"from_json({_quoted(json.dumps(odd))}, '{kind}')"
        # The character beyond an affix must be no word character: its run goes on, or the text ends.
        fits = """endswith(g.before, o.pre) AND startswith(g.after, o.post)
            AND (o.pre = '' OR g.opens OR char_length(g.before) > char_length(o.pre))
            AND (o.post = '' OR g.closes OR char_length(g.after) > char_length(o.post))"""
        found.append(
            f"""flatten(transform(filter(n, g -> {_in('g.gram', odd)}), g -> transform(
                filter(element_at({table}, g.gram), o -> {fits}), o -> {hit('char_length(o.pre)', 'o.keyword')})))"""
        )
    if not found:
        return "CAST(NULL AS struct<pos: int, size: int, keyword: string>)"
    pos = """aggregate(slice(w, 1, m.i), m.before, (a, x) -> a + char_length(x))
        + aggregate(slice(b.s, 1, m.i + b.lead), 0, (a, x) -> a + char_length(x))"""
    whole = f"CASE WHEN m IS NOT NULL THEN struct({pos} AS pos, m.size AS size, m.keyword AS keyword) END"
    return _let("m", f"array_min(concat({', '.join(found)}))", whole)


def _wordless(regex: str) -> Column:
    search = rf"(?s)^(.*?)(?<!\w)({regex})(?!\w)"
    before, keyword = (F.regexp_extract(LOWERED, search, group) for group in (1, 2))
    hit = F.struct(F.char_length(before).alias("pos"), (-F.char_length(keyword)).alias("size"), keyword.alias("keyword"))
    return F.when(F.col(LOWERED).rlike(rf"(?<!\w)(?:{regex})(?!\w)"), hit)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def probed(df: DataFrame, entries: Iterable[Entry], names: Iterable[str]) -> DataFrame:
    """Add one column per bank in ``names``: its leftmost-longest whole-word keyword, as the bank spells it.

    ``df`` has the lowered text (:func:`tidegate.operators.rules.with_matchable`); null texts have no keyword.
    """
    names, entries = list(names), list(entries)
    banks = [[e for e in entries if e.bank == name and e.folded] for name in names]
    if worded := any(e.core for bank in banks for e in bank):
        df = computed(df, **{_FOUND: F.expr(_worded(LOWERED, banks))})
    columns = {}
    for k, (name, bank) in enumerate(zip(names, banks, strict=True)):
        wordless = keyword_regex([e.folded for e in bank if not e.core])
        hits = [F.col(_FOUND)[f"b{k}"]] if worded else []
        hits += [_wordless(wordless)] if wordless else []
        columns[name] = F.array_min(F.array_compact(F.array(*hits)))["keyword"] if hits else F.lit(None).cast("string")
    found = computed(df, **columns) if columns else df
    spelling = {name: {e.folded: e.keyword for e in bank} for name, bank in zip(names, banks, strict=True)}
    return found.withColumns({name: as_written(F.col(name), spelling[name]) for name in names}).drop(_FOUND)
