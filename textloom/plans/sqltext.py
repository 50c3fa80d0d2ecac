"""Pieces of DuckDB SQL that the registered queries' equivalents are put together from."""

from __future__ import annotations

from collections.abc import Sequence

from textloom.functions.lexicons import LATIN, Lexicon

BLANK = r"[\t-\r\x1c-\x20\x85\p{Z}]"


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def array(terms: Sequence[str]) -> str:
    return "[" + ", ".join(map(text, terms)) + "]::VARCHAR[]"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{BLANK}+|{BLANK}+$', '', 'g')"


def ws_tokens(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '{BLANK}+'), lambda w: w <> '')"


def found(x: str, terms: Sequence[str]) -> str:
    return f"list_filter({array(terms)}, lambda t: contains({x}, t))"


def any_in(x: str, terms: Sequence[str]) -> str:
    return f"(len({found(x, terms)}) > 0)"


def either(k: str, terms: Sequence[str]) -> str:
    return f"list_filter({array(terms)}, lambda t: contains({k}, t) OR contains(t, {k}))"


def keep(*pairs: tuple[str, str]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {v} END" for c, v in pairs) + "], lambda v: v IS NOT NULL)"


def joined(x: str, sep: str = "|") -> str:
    return f"coalesce(array_to_string({x}, {text(sep)}), '')"


def keywords(lexicon: Lexicon = LATIN, k: int = 20) -> str:
    """CTEs tok, flt, cnt, top and kw: (doc_id, title, text, source, kw) for every document."""
    stop = ", ".join(map(text, lexicon.stopwords))
    return rf"""
tok AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS w FROM documents)),
flt AS (SELECT * FROM tok WHERE length(word) > 1 AND word NOT IN ({stop}) AND NOT regexp_full_match(word, '\p{{Nd}}+')),
cnt AS (SELECT doc_id, word, count(*) AS n, min(pos) AS pos FROM flt GROUP BY ALL),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, pos) AS rank FROM cnt) WHERE rank <= {k}),
kws AS (SELECT doc_id, list(word ORDER BY rank) AS kw FROM top GROUP BY doc_id),
kw AS (SELECT d.doc_id, left(split_part(text, chr(10), 1), 60) AS title, text, source, coalesce(kw, []::VARCHAR[]) AS kw FROM documents d LEFT JOIN kws ON d.doc_id = kws.doc_id)"""


def best(scores: Sequence[tuple[str, str]], otherwise: str = "general") -> tuple[str, str]:
    """(name, score) expressions of the largest score, the first declared among equals."""
    top = "greatest(" + ", ".join(s for _, s in scores) + ")"
    name = "CASE WHEN " + top + f" <= 0 THEN {text(otherwise)} " + " ".join(f"WHEN {s} = {top} THEN {text(n)}" for n, s in scores) + " END"
    return name, top


def domain_kg(lexicon: Lexicon = LATIN) -> tuple[str, str]:
    pairs = [(n, f"coalesce(list_sum(list_transform(kw, lambda k: len({either('k', ts)}))), 0)") for n, ts in lexicon.domains]
    name, top = best(pairs)
    return name, f"CASE WHEN {top} > 0 THEN {top}::DOUBLE / len(kw) ELSE 0::DOUBLE END"


def in_group(groups: Sequence[tuple[str, Sequence[str]]], name: str, cap: int = 5) -> str:
    """Keywords of the first matching group; `core` are those of none."""
    names = [n for n, _ in groups]
    earlier = [t for n, ts in groups if name == "core" or names.index(n) < names.index(name) for t in ts]
    own = "TRUE" if name == "core" else any_in("k", dict(groups)[name])
    return f"list_slice(list_filter(kw, lambda k: {own} AND NOT {any_in('k', earlier) if earlier else 'FALSE'}), 1, {cap})"


def sentences(delimiters: str, x: str = "text") -> str:
    cls = "[" + "".join(r"\n" if c == "\n" else c for c in delimiters) + "]"
    return f"list_transform(regexp_split_to_array({x}, '{cls}'), lambda s: {strip('s')})"


def hits(s: str, kw: str = "kw") -> str:
    return f"len(list_filter({kw}, lambda k: contains({s}, k)))"
