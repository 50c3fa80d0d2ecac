"""Domain, entities, key phrases, themes and summaries of documents, as column expressions over text and keywords."""

from __future__ import annotations

import heapq

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.lexicons import Lexicon
from textloom.functions.matching import first_matches, related_count, term_counts
from textloom.functions.text import by_text, contained, either_contains, literals, once, sentences
from textloom.operators.keywords import having


def _best(scores: list[tuple[str, Column]]) -> Column:
    """struct(score, name) of the largest score; the first declared among equals."""
    made = [F.struct(s.cast("double").alias("score"), F.lit(-i).alias("place"), F.lit(name).alias("name")) for i, (name, s) in enumerate(scores)]
    return F.array_max(F.array(*made))


def keyword_domain(keywords: Column, lexicon: Lexicon) -> Column:
    """struct(domain, score): pairs of keyword and term of which one contains the other, over the keywords."""
    best = _best([(name, related_count(keywords, terms)) for name, terms in lexicon.domains])
    of = lambda b: F.struct(F.when(b["score"] > 0, b["name"]).otherwise("general").alias("domain"), F.when(b["score"] > 0, b["score"] / F.size(keywords)).otherwise(0.0).alias("score"))
    return once(best, of)


def weighted_domain(text: Column, keywords: Column, lexicon: Lexicon) -> Column:
    """struct(domain, score): a term weighs once in text or keywords and again in the first 100 characters."""
    everything, start = F.lower(F.concat(text, F.lit(" "), F.array_join(keywords, " "))), F.lower(F.substring(text, 1, 100))
    groups = [[t.lower() for t in terms] for _, _, terms in lexicon.weighted_domains]
    anywhere, early = term_counts(everything, groups), term_counts(start, groups)  # what stands early stands in the text
    best = _best([(name, F.lit(w) * (F.get(anywhere, F.lit(i)) + F.get(early, F.lit(i)))) for i, (name, w, _) in enumerate(lexicon.weighted_domains)])
    of = lambda b: F.struct(F.when(b["score"] > 0, b["name"]).otherwise("general").alias("domain"), F.when(b["score"] > 0, b["score"]).otherwise(0.0).alias("score"))
    return once(best, of)


def keyword_entities(keywords: Column, lexicon: Lexicon, cap: int = 5) -> dict[str, Column]:
    """person (always empty) and the lexicon's types; a keyword goes to the first type with a term in it."""
    out: dict[str, Column] = {"person": F.array().cast("array<string>")}
    earlier: tuple[str, ...] = ()
    for name, terms in lexicon.entities:
        out[name] = F.slice(having(keywords, terms, earlier), 1, cap)
        earlier += terms
    return out


def pattern_entities(text: Column, keywords: Column, lexicon: Lexicon, cap: int = 10) -> dict[str, Column]:
    """Keywords near a type's terms, and persons and organisations found by pattern; first-seen order."""
    def near(terms) -> Column:
        return F.filter(keywords, lambda k: F.exists(literals(terms), lambda t: either_contains(k, t)))

    out = {name: near(terms) for name, terms in lexicon.entity_patterns}
    # What stands among the first cap with the keywords before it stands among the first cap without them.
    matches = first_matches(text, [(lexicon.person_pattern, 2), (lexicon.organization_pattern, 3)], cap)
    for i, name in enumerate(("person", "organization")):
        out[name] = F.concat(out[name], F.get(matches, F.lit(i)))
    return {name: F.slice(F.array_distinct(x), 1, cap) for name, x in out.items()}


def _hits(sentence: Column, keywords: Column) -> Column:
    return F.size(F.filter(keywords, lambda k: F.contains(sentence, k)))


def key_phrases(text: Column, keywords: Column, lexicon: Lexicon, least: int = 2, cap: int = 10) -> Column:
    """Sentences of 10 to 100 characters with enough keywords, in order."""
    return F.slice(F.filter(sentences(text, lexicon.delimiters), lambda s: F.length(s).between(10, 100) & (_hits(s, keywords) >= least)), 1, cap)


def short_phrases(text: Column, keywords: Column, lexicon: Lexicon, cap: int = 15) -> Column:
    """Distinct sentences of 10 to 100 characters with a keyword, shortest first, then in order. One pass a text."""
    split = regex.compile("[" + lexicon.delimiters_rich + "]").split

    def one(t, keys):
        if t is None:
            return None
        found = dict.fromkeys(s for s in map(str.strip, split(t)) if 10 <= len(s) <= 100 and any(k in s for k in keys or ()))
        return heapq.nsmallest(cap, found, key=len)

    return by_text("array<string>", one)(text, keywords)


def themes(title: Column, keywords: Column, domain: Column, lexicon: Lexicon, cap: int = 5) -> Column:
    """A theme from the title unless it is the default, one from the domain, and three from keywords."""
    of_title = F.when((title != "") & (title != lexicon.default_title), F.concat(title, F.lit(lexicon.texts["title_theme"])))
    of_domain = F.coalesce(*[F.when(domain == name, F.lit(text + lexicon.texts["domain_theme"])) for name, text in lexicon.domain_themes])
    of_words = F.transform(F.slice(keywords, 1, 3), lambda k: F.concat(k, F.lit(lexicon.texts["keyword_theme"])))
    return F.slice(F.concat(F.filter(F.array(of_title, of_domain), lambda x: x.isNotNull()), of_words), 1, cap)


def rich_themes(text: Column, groups: dict[str, Column], lexicon: Lexicon, cap: int = 8) -> Column:
    """A theme for each group of two keywords or more; with under three of them, also one for each relation found."""
    listed = lambda words, name, end, least, most: once(words, lambda w: F.when(F.size(w) >= least, F.concat(F.lit(name + end), F.array_join(F.slice(w, 1, most), ", "))))
    some = lambda made: F.filter(F.array(*made), lambda x: x.isNotNull())
    of_groups = some([listed(words, name, lexicon.colon, 2, 5) for name, words in groups.items()])
    of_relations = some([listed(contained(text, terms), name.replace("_", ""), lexicon.texts["relation_theme"], 1, 3) for name, terms in lexicon.relations])
    return once(of_groups, lambda first: F.slice(F.when(F.size(first) < 3, F.concat(first, of_relations)).otherwise(first), 1, cap))


def filled_in(template: str, *values: Column) -> Column:
    """The template with each {} replaced by a value."""
    parts = template.split("{}")
    out = [F.lit(parts[0])]
    for value, part in zip(values, parts[1:], strict=True):
        out += [value, F.lit(part)]
    return F.concat(*out)


def template_summary(title: Column, text: Column, keywords: Column, lexicon: Lexicon) -> Column:
    words = F.array_join(F.slice(keywords, 1, 5), ", ")
    return (
        F.when(F.length(text) < 50, filled_in(lexicon.texts["brief"], title))
        .when(F.size(keywords) > 0, filled_in(lexicon.texts["around"], title, words))
        .otherwise(filled_in(lexicon.texts["about"], title))
    )


def best_sentences(text: Column, keywords: Column, words: Column, lexicon: Lexicon, most: int = 3, least: int = 10, longest: int = 200) -> Column:
    """The best sentences of at least so many characters, best first, joined and cut; null if none has any points.

    A keyword in it gives a sentence one point, 20 to 100 characters one, and each of the words half a point; earlier
    sentences come first among equals. Null texts and keywords have none. One pass a text.
    """
    split, period = regex.compile("[" + lexicon.delimiters_rich + "]").split, lexicon.period

    def one(t, keys, more):
        if t is None or keys is None:
            return None
        found, more = [], [w for w in (more if more is not None else ()) if w is not None]
        for i, s in enumerate(split(t)):
            if len(bare := s.strip()) >= least:
                points = sum(k in s for k in keys) + (20 <= len(s) <= 100) + 0.5 * sum(w in s for w in more)
                found.append((-points, i, bare))
        joined = period.join(bare for minus, _, bare in heapq.nsmallest(most, found) if minus < 0)
        return (joined[:longest] + "..." if len(joined) > longest else joined) or None

    return by_text("string", one)(text, keywords, words)


def extractive_summary(title: Column, text: Column, keywords: Column, theme_list: Column, lexicon: Lexicon) -> Column:
    """The three best sentences: keywords in them, a fit length, and half a point for each theme word."""
    top = F.slice(keywords, 1, 10)
    words = F.flatten(F.transform(F.filter(theme_list, lambda t: F.contains(t, F.lit(lexicon.colon))), lambda t: F.split(F.get(F.split(t, lexicon.colon), F.lit(1)), lexicon.comma)))
    around = filled_in(lexicon.texts["around"], title, F.array_join(F.slice(keywords, 1, 5), ", "))
    return F.coalesce(best_sentences(text, top, words, lexicon), around)
