"""Many terms at a time: which of a lexicon's terms a text holds, by one automaton and one pass over each text.

Terms are short lists of literals that go to the tasks with the function; a worker builds the automaton once.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import cached_property
from itertools import chain

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.text import by_row, by_text, either_contains

_NUMBERS = pa.list_(pa.int32())


class Terms:
    """Numbered terms; repeated ones keep numbers of their own."""

    def __init__(self, terms: Iterable[str]):
        self.terms = tuple(terms)

    def __getstate__(self):
        return self.terms

    def __setstate__(self, terms):
        self.terms = terms

    @cached_property
    def numbers(self) -> dict[str, tuple[int, ...]]:
        out: dict[str, tuple[int, ...]] = {}
        for i, term in enumerate(self.terms):
            out[term] = (*out.get(term, ()), i)
        return out

    @cached_property
    def automaton(self) -> ahocorasick.Automaton | None:
        made = ahocorasick.Automaton()
        for term, own in self.numbers.items():
            if term:
                made.add_word(term, own)
        made.make_automaton()
        return made if len(made) else None

    @cached_property
    def around(self) -> dict[str, set[int]]:
        """For each stretch of a term, the terms that hold it."""
        out: dict[str, set[int]] = {}
        for i, term in enumerate(self.terms):
            for a in range(len(term)):
                for b in range(a + 1, len(term) + 1):
                    out.setdefault(term[a:b], set()).add(i)
        return out

    def inside(self, text: str) -> set[int]:
        """The terms that stand in the text; an empty term stands in each."""
        found = set(self.numbers.get("", ()))
        for _, own in self.automaton.iter(text) if self.automaton else ():
            found.update(own)
        return found

    def related(self, word: str) -> set[int]:
        """The terms that stand in the word or in which it stands."""
        return self.inside(word) | (self.around.get(word, set()) if word else set(range(len(self.terms))))


def term_numbers(text: Column, terms: Sequence[str]) -> Column:
    """array<int>: the numbers of the terms that a text holds, ascending; null for null."""
    own = Terms(terms)

    return by_row("array<int>", _NUMBERS, lambda t: None if t is None else sorted(own.inside(t)))(text)


def term_counts(text: Column, groups: Sequence[Sequence[str]]) -> Column:
    """array<int>: how many terms of each group a text holds; zeros for null."""
    own, owner = Terms(t for g in groups for t in g), [k for k, g in enumerate(groups) for _ in g]

    def one(t):
        out = [0] * len(groups)
        for i in own.inside(t) if t else own.numbers.get("", ()) if t == "" else ():
            out[owner[i]] += 1
        return out

    return by_text("array<int>", one)(text)


def related_count(words: Column, terms: Sequence[str]) -> Column:
    """The pairs of a word and a term of which one holds the other; null for null. Words are few and short, so the engine compares
    them with each term, without Python workers of their own."""
    return F.aggregate(words, F.lit(0), lambda n, w: sum((F.when(either_contains(w, F.lit(t)), 1).otherwise(0) for t in terms), n))


def related_counts(words: Column, groups: Sequence[Sequence[str]]) -> Column:
    """array<int>: related_count() of each group; null for null."""
    return F.when(words.isNotNull(), F.array(*[related_count(words, terms) for terms in groups]))


def all_matches(text: str, pattern: str) -> list[str]:
    """What the pattern matches, in order. RE2 takes linear time and no stack, where the engine's patterns take a stack frame for
    each repetition of a group, so that a long match ends the executor. Matches are put between marks that the text does not hold."""
    mark = next(c for c in map(chr, chain(range(0xE000, 0xF900), range(0xF0000, 0x110000))) if c not in text)
    return pc.replace_substring_regex(pa.scalar(text, pa.large_string()), pattern, rf"{mark}\0{mark}").as_py().split(mark)[1::2]


def first_matches(text: Column, patterns: Sequence[tuple[str, int]], most: int) -> Column:
    """array<array<string>>: for each pattern and length the first distinct matches of so many characters at least; null for null."""

    def one(t):
        if t is None:
            return None
        return [list(dict.fromkeys(m for m in all_matches(t, pattern) if len(m) >= least))[:most] for pattern, least in patterns]

    return by_text("array<array<string>>", one)(text)
