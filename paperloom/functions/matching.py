"""Many terms and patterns in one pass over a text.

All terms, and the words that a pattern cannot match without (its anchors, read off the pattern), are in one Aho-Corasick
automaton. A text is walked once, whatever the number of terms; a pattern itself runs only on texts in which all of its
anchors occurred. The answer of a text is the array of the terms and groups of patterns that it has, so a projection can
ask for any of them without looking at the text again.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import lru_cache
from re import _constants as C
from re import _parser as parser

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from paperloom.cluster import ship_code, small_batches

Groups = tuple[tuple[str, tuple[str, ...]], ...]


# ---------------------------------------------------------------- anchors
def anchors(pattern: str) -> list[frozenset[str]]:
    """Sets of literals; every match of the pattern holds one of each set."""
    return [c for c in _clauses(parser.parse(pattern)) if c]


def _best(clauses: list[frozenset[str]]) -> frozenset[str]:
    """The set that says most: long literals, then few."""
    return max(clauses, key=lambda c: (min(map(len, c)), -len(c)), default=frozenset())


def _clauses(parsed) -> list[frozenset[str]]:
    out, run = [], ""
    for op, arg in parsed:
        if op is C.LITERAL:
            run += chr(arg)
            continue
        if run:
            out.append(frozenset([run]))
            run = ""
        if op is C.SUBPATTERN:
            out += _clauses(arg[-1])
        elif op is C.MAX_REPEAT and arg[0] > 0:
            out += _clauses(arg[2])
        elif op is C.BRANCH:
            each = [_best(_clauses(branch)) for branch in arg[1]]
            if all(each):
                out.append(frozenset().union(*each))
    if run:
        out.append(frozenset([run]))
    return [c for c in out if min(map(len, c)) > 1] or out


# ---------------------------------------------------------------- the automaton
class Matcher:
    """Terms and groups of patterns; of a group, one pattern has to match. Dots stop at line feeds, \\b is of ASCII words."""

    def __init__(self, terms: Sequence[str], groups: Groups = ()):
        import ahocorasick

        self.terms = list(dict.fromkeys(t for t in terms if t))
        self.patterns = [(name, re.compile(p, re.ASCII), anchors(p)) for name, ps in groups for p in ps]
        words = dict.fromkeys(self.terms) | {w: None for _, _, needs in self.patterns for c in needs for w in c}
        self.automaton = ahocorasick.Automaton()
        for w in words:
            self.automaton.add_word(w, w)
        if words:
            self.automaton.make_automaton()
        self.walk = self.automaton.iter if words else lambda text: ()
        self.known = frozenset(self.terms)

    def __call__(self, text: str | None) -> list[str]:
        if not text:
            return []
        seen = {w for _, w in self.walk(text)}
        out = sorted(seen & self.known)
        fired: dict[str, None] = {}
        for name, pattern, needs in self.patterns:
            if name not in fired and not any(seen.isdisjoint(c) for c in needs) and pattern.search(text):
                fired[name] = None
        return out + list(fired)


@lru_cache(maxsize=16)
def _matcher(terms: tuple[str, ...], groups: Groups) -> Matcher:
    return Matcher(terms, groups)


@lru_cache(maxsize=64)
def _signals_udf(terms: tuple[str, ...], groups: Groups):
    @F.arrow_udf("array<string>")
    def found(texts: pa.Array) -> pa.Array:
        match = _matcher(terms, groups)
        return pa.array((match(t.as_py()) for t in texts), pa.list_(pa.string()), size=len(texts))

    return found


def _ready() -> None:
    if spark := SparkSession.getActiveSession():
        ship_code(spark)
        small_batches(spark)


def signals(text: Column, terms: Sequence[str], groups: Groups = ()) -> Column:
    """The terms that the text contains, in order, then the names of the groups that match; none for null."""
    _ready()
    return _signals_udf(tuple(dict.fromkeys(terms)), groups)(text)


# ---------------------------------------------------------------- rules
@lru_cache(maxsize=16)
def _rule_book(rules: tuple[tuple[str, str, str], ...], scopes: tuple[str, ...]):
    match = _matcher(tuple(dict.fromkeys(term for _, term, _ in rules)), ())
    of = lambda scope, mode: frozenset(t for d, t, m in rules if d in ("all", scope) and m == mode and t)
    return match, [(s, of(s, "exclude"), of(s, "require")) for s in scopes]


@lru_cache(maxsize=16)
def _rejected_udf(rules: tuple[tuple[str, str, str], ...], scopes: tuple[str, ...]):
    @F.arrow_udf("array<string>")
    def rejected(texts: pa.Array) -> pa.Array:
        match, book = _rule_book(rules, scopes)
        out = []
        for t in texts:  # one text of the batch at a time
            seen = set(match(t.as_py()))
            out.append([s for s, no, yes in book if not no.isdisjoint(seen) or not yes <= seen])
        return pa.array(out, pa.list_(pa.string()))

    return rejected


def rejected(text: Column, rules: Sequence[tuple[str, str, str]], scopes: Sequence[str]) -> Column:
    """The scopes whose rules (scope or all, term, exclude or require) a text breaks: it holds an excluded term or lacks
    required one. Terms are compared in lower case, as the text should be; empty ones are no rules.

    Never null, and said so: to learn that it is not, a filter would call the function once more in workers of its own."""
    _ready()
    found = _rejected_udf(tuple(sorted({(d, t.lower(), m) for d, t, m in rules})), tuple(scopes))(text)
    return F.coalesce(found, F.array().cast("array<string>"))
