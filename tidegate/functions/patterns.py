r"""Python regular expressions restated for the JVM, plus literal guards.

``rlike`` runs java.util.regex, which reads ``\s``, ``\b``, ``.``, ``$`` and case folding
differently from Python. Python's own parser gives the tree; each node is written back in a form
that means the same on the JVM and needs no dialect flags.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce
from operator import or_
from re import _compiler, _parser
from re import _constants as sre

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegate.errors import ResourceError
from tidegate.functions.text import WHITESPACE



def _ranges(chars: str) -> str:
    """Sorted characters as class members, neighbours joined into ranges."""
    runs: list[list[int]] = []
    for code in map(ord, chars):
        if runs and code == runs[-1][1] + 1:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    return "".join(f"\\x{{{a:x}}}" + (f"-\\x{{{b:x}}}" if b > a else "") for a, b in runs)


_SPACE = _ranges(WHITESPACE)
_WORD = r"\p{L}\p{N}_"
# The same set for look-behinds. The raw supplementary letter (a member anyway) makes the JVM step
# back over surrogate pairs as whole characters.
_BEHIND = f"[{_WORD}\U00010000]"
_EDGE = f"(?:(?<={_BEHIND})(?![{_WORD}])|(?<!{_BEHIND})(?=[{_WORD}]))"
_INSIDE = f"(?:(?<={_BEHIND})(?=[{_WORD}])|(?<!{_BEHIND})(?![{_WORD}]))"
_ANY = r"(?s:.)"

_POSITIONS = {
    sre.AT_BEGINNING: (r"\A", r"(?<![^\n])"),
    sre.AT_BEGINNING_STRING: (r"\A", r"\A"),
    sre.AT_END: (r"(?=\n?\z)", r"(?![^\n])"),
    sre.AT_END_STRING: (r"\z", r"\z"),
    sre.AT_BOUNDARY: (_EDGE, _EDGE),
    sre.AT_NON_BOUNDARY: (_INSIDE, _INSIDE),
}
_MEMBERS = {
    sre.CATEGORY_DIGIT: r"\p{Nd}",
    sre.CATEGORY_NOT_DIGIT: r"\P{Nd}",
    sre.CATEGORY_SPACE: _SPACE,
    sre.CATEGORY_WORD: _WORD,
}
_COMPLEMENTS = {sre.CATEGORY_NOT_SPACE: f"[^{_SPACE}]", sre.CATEGORY_NOT_WORD: f"[^{_WORD}]"}
_BOUNDARY = (sre.AT, sre.AT_BOUNDARY)
_SINGLE = (sre.LITERAL, sre.NOT_LITERAL, sre.ANY, sre.IN)
_REPEATS = {sre.MAX_REPEAT: "", sre.MIN_REPEAT: "?", sre.POSSESSIVE_REPEAT: "+"}
_DEEP = 100  # rounds of a group with several ways that any stack has room for


@dataclass(frozen=True)
class JvmPattern:
    """``regex`` for ``rlike``; ``folded`` says which text column it reads; ``guards`` are
    clauses of literals, each clause holding at least one that every match must contain."""

    regex: str
    folded: bool
    guards: tuple[tuple[str, ...], ...]

    def matches(self, lowered: str, folded: str) -> Column:
        """Cheap substring tests first; the regex runs only on rows that pass all of them.

        Both arguments are column names.
        """
        test = F.col(folded if self.folded else lowered).rlike(self.regex)
        for clause in reversed(self.guards):
            test = _contains_any(folded, clause) & test
        return test


def _contains_any(column: str, literals: tuple[str, ...]) -> Column:
    """Plain words go through one SQL fragment (one round trip to the JVM), the rest one by one."""
    plain = [x for x in literals if x.replace(" ", "").isalnum()]
    tests = [F.col(column).contains(x) for x in literals if x not in plain]
    if plain:
        tests.append(F.expr(" OR ".join(f"contains({column}, '{x}')" for x in plain)))
    return reduce(or_, tests)


@lru_cache(64)
def _parsed(pattern: str) -> _parser.SubPattern:
    """The tree of a pattern that Python compiles."""
    re.compile(pattern, re.IGNORECASE | re.UNICODE)
    return _parser.parse(pattern, re.IGNORECASE | re.UNICODE)


def to_jvm(name: str, pattern: str) -> JvmPattern:
    """Compile as Python would (case-insensitive, Unicode), then restate for the JVM."""
    try:
        tree = _parsed(pattern)
    except (re.error, ValueError, OverflowError, RecursionError) as exc:
        raise ResourceError(f"pattern {name}", exc) from exc
    flags = tree.state.flags
    writer = _Writer(name)
    body = writer.sequence(tree, flags)
    if writer.foldable:
        return JvmPattern(writer.sequence(tree, flags, fold=True), True, _guards(tree))
    return JvmPattern(f"(?iu){body}", False, ())


def needed(name: str, pattern: str) -> tuple[tuple[str, ...], ...]:
    """Clauses, the most telling first: ASCII literals of which every match, in folded text, contains at least one."""
    try:
        tree = _parsed(pattern)
    except (re.error, ValueError, OverflowError, RecursionError) as exc:
        raise ResourceError(f"pattern {name}", exc) from exc
    return tuple(tuple(sorted(clause)) for clause in _ranked(_clauses(tree)) if all(x.isascii() for x in clause))


def needed_letters(name: str, pattern: str) -> tuple[str, ...]:
    """Runs of letters of which the letters a-z of every match, in folded text, without what stands between
    them, contain at least one; none where no such runs are known."""
    try:
        tree = _parsed(pattern)
    except (re.error, ValueError, OverflowError, RecursionError) as exc:
        raise ResourceError(f"pattern {name}", exc) from exc
    return next((tuple(sorted(clause)) for clause in _ranked(_lettered(tree))), ())


def _literal(code: int) -> str:
    ch = chr(code)
    if code < 128 and (ch.isalnum() or ch == " "):
        return ch
    return f"\\{ch}" if 0x21 <= code < 0x7F else f"\\x{{{code:x}}}"


def _range_folds(low: int, high: int) -> bool:
    if high > 127:
        return False
    span = {chr(c) for c in range(low, high + 1)}
    letters = {ch for ch in span if ch.isalpha()}
    return not letters or (letters == span and len({ch.islower() for ch in letters}) == 1)


def _steady(items) -> bool:
    """Whether ``items`` match in one way at most, of one length."""
    for op, arg in items:
        if op is sre.SUBPATTERN:
            ok = _steady(arg[3])
        elif op in _REPEATS:
            ok = arg[0] == arg[1] and _steady(arg[2])
        else:
            ok = op in _SINGLE or op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT)
        if not ok:
            return False
    return True


def _spellings(items, most: int = 200) -> set[str] | None:
    """All texts that ``items`` stand for, if they are plain ASCII and not many."""
    out = {""}
    for op, arg in items:
        if op is sre.LITERAL:
            ways = {chr(arg).lower()}
        elif op is sre.IN and all(kind is sre.LITERAL for kind, _ in arg):
            ways = {chr(code).lower() for _, code in arg}
        elif op is sre.SUBPATTERN:
            ways = _spellings(arg[3], most)
        elif op is sre.BRANCH:
            each = [_spellings(choice, most) for choice in arg[1]]
            ways = None if None in each else set().union(*each)
        else:
            ways = None
        if ways is None or not all(way.isascii() for way in ways) or len(out) * len(ways) > most:
            return None
        out = {head + tail for head in out for tail in ways}
    return out


def _one_way(items, after) -> bool:
    """Whether a repeat of ``items`` before ``after`` never has to give back a round: no spelling
    opens another one, and what comes after starts with none of their first letters."""
    rounds, then = _spellings(items), _spellings([after]) if after[0] is not None else None
    if not rounds or not then or "" in rounds or "" in then:
        return False
    if any(a != b and b.startswith(a) for a in rounds for b in rounds):
        return False
    return {way[0] for way in rounds}.isdisjoint(way[0] for way in then)


def _is_word(item) -> bool:
    return item[0] is sre.LITERAL and (chr(item[1]).isalnum() or item[1] == ord("_"))


class _Writer:
    def __init__(self, name: str) -> None:
        self.name = name
        self.foldable = True

    def sequence(self, items, flags: int, fold: bool = False) -> str:
        """Nodes one after another; a word boundary beside a literal is written the cheap way.

        Before a word character only the character in front matters, and testing the literal
        first lets the search skip most positions; after one, only the character that follows.
        """
        out = []
        for index, (op, arg) in enumerate(items):
            before = items[index - 1] if index else (None, None)
            after = items[index + 1] if index + 1 < len(items) else (None, None)
            if (op, arg) == _BOUNDARY and _is_word(after):
                continue
            if (op, arg) == _BOUNDARY and _is_word(before):
                out.append(f"(?![{_WORD}])")
            elif before == _BOUNDARY and _is_word((op, arg)):
                char = self.char(arg, fold)
                out.append(f"{char}(?<!{_BEHIND}{char})")
            else:
                out.append(self.node(op, arg, flags, fold, after))
        return "".join(out)

    def kind(self, op, low, high, items, after) -> str:
        """How a repeat is marked. The JVM's matcher goes one level deeper with every round of a group
        that can match in several ways, until its stack ends; possessive repeats do not."""
        if op is sre.POSSESSIVE_REPEAT or _steady(items) or high is not sre.MAXREPEAT and high <= _DEEP:
            return _REPEATS[op]
        if _one_way(items, after):
            return "+"
        raise ResourceError(
            f"pattern {self.name} (a group that can match in several ways repeats without a bound: "
            f"bound it by {_DEEP} or less, or make the repeat possessive)"
        )

    def char(self, code: int, fold: bool) -> str:
        if code > 127:
            self.foldable = False
        return _literal(ord(chr(code).lower()) if fold else code)

    def node(self, op, arg, flags: int, fold: bool, after=(None, None)) -> str:
        def inner(items):
            return self.sequence(items, flags, fold)

        if op is sre.LITERAL:
            return self.char(arg, fold)
        if op is sre.NOT_LITERAL:
            return f"[^{self.char(arg, fold)}]"
        if op is sre.ANY:
            return _ANY if flags & re.DOTALL else r"[^\n]"
        if op is sre.IN:
            return self.char_class(arg, fold)
        if op is sre.BRANCH:
            return "(?:" + "|".join(inner(choice) for choice in arg[1]) + ")"
        if op is sre.SUBPATTERN:
            group, added, removed, items = arg
            if (added | removed) & (re.IGNORECASE | re.ASCII):
                raise ResourceError(f"pattern {self.name} (local case or ASCII flags)")
            body = self.sequence(items, (flags | added) & ~removed, fold)
            return f"({body})" if group else f"(?:{body})"
        if op in _REPEATS:
            low, high, items = arg
            bound = f"{{{low},}}" if high is sre.MAXREPEAT else f"{{{low},{high}}}"
            body = inner(items)
            # A lone character or class needs no group, and repeats faster without one.
            single = len(items) == 1 and items[0][0] in _SINGLE and not body.startswith("(")
            return (body if single else f"(?:{body})") + bound + self.kind(op, low, high, items, after)
        if op is sre.ATOMIC_GROUP:
            return f"(?>{inner(arg)})"
        if op is sre.AT:
            return _POSITIONS[arg][bool(flags & re.MULTILINE)]
        if op in (sre.ASSERT, sre.ASSERT_NOT):
            side = "" if arg[0] > 0 else "<"
            return f"(?{side}{'=' if op is sre.ASSERT else '!'}{inner(arg[1])})"
        if op is sre.GROUPREF:
            return f"(?:\\{arg})"
        raise ResourceError(f"pattern {self.name} (construct {op} has no JVM form)")

    def char_class(self, items, fold: bool) -> str:
        members, complements, negate = [], [], False
        for op, arg in items:
            if op is sre.NEGATE:
                negate = True
            elif op is sre.LITERAL:
                members.append(self.char(arg, fold))
            elif op is sre.RANGE:
                if not _range_folds(*arg):
                    self.foldable = False
                members.append("-".join(self.char(end, fold) for end in arg))
            elif arg in _COMPLEMENTS:
                complements.append(_COMPLEMENTS[arg])
            else:
                members.append(_MEMBERS[arg])
        if not complements:
            return f"[{'^' if negate else ''}{''.join(members)}]"
        # A union of classes is a class: repeated, it takes no stack, as an alternation would.
        union = "[" + "".join(complements + members) + "]"
        return f"(?:(?!{union}){_ANY})" if negate else union


# --- literal guards ---------------------------------------------------------------------------


def _clauses(items) -> list[frozenset[str]]:
    """Sets of literals of which every match of ``items`` contains at least one."""
    found: list[frozenset[str]] = []
    run = ""
    for op, arg in [*items, (None, None)]:
        if op is sre.LITERAL:
            run += chr(arg).lower()
            continue
        if run:
            found.append(frozenset([run]))
            run = ""
        if op is sre.SUBPATTERN:
            found += _clauses(arg[3])
        elif op is sre.ATOMIC_GROUP:
            found += _clauses(arg)
        elif op in _REPEATS and arg[0] >= 1:
            found += _clauses(arg[2])
        elif op is sre.BRANCH:
            best = [_ranked(_clauses(choice))[:1] for choice in arg[1]]
            if all(best):
                found.append(frozenset().union(*(clause for (clause,) in best)))
    return found


def _ranked(clauses: list[frozenset[str]]) -> list[frozenset[str]]:
    """Best first: no very short literal (those are everywhere), few tests, long literals."""
    return sorted(clauses, key=lambda c: (min(map(len, c)) < 4, len(c), -min(map(len, c)), sorted(c)))


def _guards(tree, keep: int = 2, min_length: int = 3) -> tuple[tuple[str, ...], ...]:
    chosen = []
    for clause in _ranked(_clauses(tree))[:keep]:
        if min(map(len, clause)) < min_length:
            continue
        # A literal that contains another one of its clause adds nothing.
        core = [x for x in clause if not any(y != x and y in x for y in clause)]
        chosen.append(tuple(sorted(core)))
    return tuple(chosen)


# --- letters of a match -------------------------------------------------------------------------

_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_FOLDED_LETTERS = _LETTERS + "ſı"  # what a lowered text may hold in a letter's place


def _letterless(op, arg) -> bool:
    """Whether a single character that matches leaves no letter in folded text."""
    return _no_letter(op, tuple(arg) if isinstance(arg, list) else arg)


@lru_cache(1024)
def _no_letter(op, arg) -> bool:
    node = _parser.SubPattern(_parser.State(), [(op, list(arg) if isinstance(arg, tuple) else arg)])
    test = _compiler.compile(node, re.IGNORECASE | re.UNICODE)
    return not any(test.fullmatch(ch) for ch in _FOLDED_LETTERS)


def _steps(items) -> Iterator[str | frozenset[str] | None]:
    """What ``items`` add to the letters of a match, in order: a letter; runs of which one is among letters that
    are not known otherwise; or None for letters that are not known. What adds no letter is passed over."""
    for op, arg in items:
        if op is sre.LITERAL and chr(arg).lower() in _LETTERS:
            yield chr(arg).lower()
        elif op in _SINGLE:
            if not _letterless(op, arg):
                yield None
        elif op is sre.SUBPATTERN and not (arg[1] | arg[2]) & (re.IGNORECASE | re.ASCII):
            yield from _steps(arg[3])
        elif op is sre.ATOMIC_GROUP:
            yield from _steps(arg)
        elif op in _REPEATS:
            inner = list(_steps(arg[2]))
            if inner:
                yield from (None, *(inner if arg[0] >= 1 else ()), None)
        elif op is sre.BRANCH:
            if any(list(_steps(choice)) for choice in arg[1]):
                best = [_ranked(_lettered(choice))[:1] for choice in arg[1]]
                yield from (None, *([frozenset().union(*(clause for (clause,) in best))] if all(best) else ()), None)
        elif op not in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
            yield None


def _lettered(items) -> list[frozenset[str]]:
    """Sets of runs of which the letters of every match of ``items`` contain at least one."""
    found: list[frozenset[str]] = []
    run = ""
    for step in [*_steps(items), None]:
        if isinstance(step, str):
            run += step
            continue
        if run:
            found.append(frozenset([run]))
            run = ""
        if step is not None:
            found.append(step)
    return found
