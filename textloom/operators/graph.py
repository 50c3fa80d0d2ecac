"""Per-document knowledge structure: tiers, hierarchy, edges, learning path, and the assembled graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions.lexicons import Lexicon
from textloom.functions.text import contains_any, kept


def empty() -> Column:
    return F.array().cast("array<string>")


def tiers(keywords: Column) -> dict[str, Column]:
    """Keywords 1-5, 6-10 and 11-15."""
    return {"primary": F.slice(keywords, 1, 5), "secondary": F.slice(keywords, 6, 5), "tertiary": F.slice(keywords, 11, 5)}


def hierarchy(keywords: Column) -> Column:
    """The first keyword with the three after it."""
    return F.when(F.size(keywords) > 0, F.create_map(F.get(keywords, F.lit(0)), F.slice(keywords, 2, 3))).otherwise(F.create_map().cast("map<string,array<string>>"))


def concept_tree(keywords: Column) -> Column:
    """Array of struct(root, branches): each of three roots with its two keywords from the fourth on."""
    roots = F.slice(keywords, 1, 3)
    return F.transform(roots, lambda k, i: F.struct(k.alias("root"), F.slice(keywords, 4 + 2 * i, F.lit(2)).alias("branches")))


def dependencies(keywords: Column) -> Column:
    """Array of struct(node, needs) over the first three keywords; empty with fewer."""
    at = lambda i: F.get(keywords, F.lit(i))
    made = F.array(F.struct(at(1).alias("node"), F.array(at(0)).alias("needs")), F.struct(at(2).alias("node"), F.array(at(0), at(1)).alias("needs")))
    return F.when(F.size(keywords) >= 3, made).otherwise(F.filter(made, lambda x: F.lit(False)))


def difficulty(keywords: Column, n_entities: Column, lexicon: Lexicon) -> Column:
    hard = F.size(F.filter(keywords, lambda k: contains_any(k, lexicon.complexity)))
    return F.when((hard > 3) | (n_entities > 15), "advanced").when((hard > 1) | (n_entities > 8), "intermediate").otherwise("beginner")


def reading_time(length: Column) -> Column:
    """At 300 characters a minute: under one, whole minutes, or hours and minutes."""
    minutes = length / 300
    whole = F.floor(minutes).cast("string")
    hours = F.concat(F.floor(minutes / 60).cast("string"), F.lit("小时"), F.floor(minutes % 60).cast("string"), F.lit("分钟"))
    return F.when(minutes < 1, "< 1分钟").when(minutes < 60, F.concat(whole, F.lit("分钟"))).otherwise(hours)


def _edge(source: Column, target: Column, relationship: str, strength: float) -> Column:
    return F.struct(source.alias("source"), target.alias("target"), F.lit(relationship).alias("relationship"), F.lit(strength).alias("strength"))


def concept_edges(keywords: Column, cap: int = 10) -> Column:
    """Each of the first five keywords with those after it among the first six."""
    few = F.slice(keywords, 1, 6)
    made = F.flatten(F.transform(F.slice(few, 1, 5), lambda a, i: F.transform(F.filter(few, lambda b, j: j > i), lambda b: _edge(a, b, "related", 0.7))))
    return F.slice(made, 1, cap)


def entity_edges(entities: dict[str, Column], cap: int = 15) -> Column:
    """Each entity with the first two of every other type, in nested order."""
    def to(a: Column, others: Column) -> Column:
        return F.transform(F.slice(others, 1, 2), lambda b: _edge(a, b, "associated", 0.5))

    def of_type(name: str, own: Column) -> Column:
        return F.flatten(F.transform(own, lambda a: F.flatten(F.array(*[to(a, x) for other, x in entities.items() if other != name]))))

    return F.slice(F.flatten(F.array(*[of_type(name, own) for name, own in entities.items()])), 1, cap)


def functional_edges(methods: Column, applications: Column, cap: int = 10) -> Column:
    """Every method with every application."""
    return F.slice(F.flatten(F.transform(methods, lambda m: F.transform(applications, lambda a: _edge(m, a, "enables", 0.8)))), 1, cap)


def edge_table(docs: DataFrame, kind: str, edges: Column) -> DataFrame:
    """(doc_id, kind, ord, source, target, relationship, strength), a row per edge."""
    rows = docs.select("doc_id", F.posexplode(edges).alias("ord", "e"))
    return rows.select("doc_id", F.lit(kind).alias("kind"), F.col("ord"), "e.*")




def each_with(words: Column, n: int, patterns: list[str], cap: int) -> Column:
    """For each of the first n words one text per pattern, {} standing for the word."""
    made = F.flatten(F.transform(F.slice(words, 1, n), lambda k: F.array(*[F.concat(F.lit(p.split("{}")[0]), k, F.lit(p.split("{}")[1])) for p in patterns])))
    return F.slice(made, 1, cap)


def learning_path(keywords: Column, tools: Column, skills: Column) -> dict[str, Column]:
    """Uses, cases, methods, sequence, progression, milestones, next steps and advanced topics."""
    return {
        "practical_uses": each_with(keywords, 5, ["Use of {}", "Practice of {}"], 8),
        "use_cases": F.slice(F.concat(each_with(tools, 3, ["Work with {}"], 3), each_with(skills, 3, ["Apply {}"], 3)), 1, 6),
        "methods": each_with(keywords, 4, ["Plan for {}", "Review of {}"], 6),
        "sequence": kept(
            (F.size(keywords) > 0, F.concat(F.lit("Basics of "), F.get(keywords, F.lit(0)))),
            (F.size(keywords) > 1, F.concat(F.lit("Methods of "), F.get(keywords, F.lit(1)))),
            (F.size(keywords) > 2, F.concat(F.lit("Practice of "), F.get(keywords, F.lit(2)))),
            (F.lit(True), "Put together"),
        ),
        "beginner": F.slice(keywords, 1, 2),
        "intermediate": F.slice(keywords, 3, 2),
        "advanced": F.slice(keywords, 5, 2),
        "milestones": F.transform(F.slice(keywords, 1, 4), lambda k, i: F.concat(F.lit("Stage "), (i + 1).cast("string"), F.lit(": "), k)),
        "next_steps": each_with(keywords, 3, ["More on {}", "Try {}"], 6),
        "advanced_topics": each_with(keywords, 4, ["Theory of {}", "Limits of {}"], 6),
    }


#: Texts per domain; `general` serves all domains without an entry.
DOMAIN_DIMS = [
    ("technology", "computing basics", "speed and stability", "fast change", "manuals and code"),
    ("business", "market basics", "revenue and reach", "competition", "cases and reports"),
    ("education", "study habits", "retention and use", "motivation", "courses and books"),
    ("finance", "arithmetic", "return and risk", "uncertainty", "filings and data"),
    ("general", "curiosity", "understanding", "time", "libraries"),
]


def domain_dims(docs: DataFrame, domain_col: str = "domain") -> DataFrame:
    """docs with prerequisite, metric, challenge and resource of their domain; five rows are broadcast."""
    dims = docs.sparkSession.createDataFrame(DOMAIN_DIMS, "dim string, prerequisite string, metric string, challenge string, resource string")
    general = DOMAIN_DIMS[-1]
    out = docs.join(F.broadcast(dims), F.col(domain_col) == F.col("dim"), "left").drop("dim")
    return out.fillna(dict(zip(("prerequisite", "metric", "challenge", "resource"), general[1:], strict=True)))


def graph(title: Column, author: Column, domain: Column, score: Column, length: Column, keywords: Column, entities: dict[str, Column], groups: dict[str, Column], phrases: Column, theme_list: Column, summary: Column, lexicon: Lexicon) -> Column:
    """All parts as one struct."""
    n_entities = sum((F.size(x) for x in entities.values()), F.lit(0))
    structs = lambda cols: F.struct(*[c.alias(n) for n, c in cols.items()])
    prefixed = lambda n, x: F.transform(F.slice(x, 1, 2), lambda e: F.concat(F.lit(n + ": "), e))
    details = F.slice(F.flatten(F.array(*[prefixed(n, x) for n, x in entities.items()])), 1, 8)
    points = F.slice(F.concat(F.slice(theme_list, 1, 3), F.slice(phrases, 1, 3)), 1, 5)
    meta = F.struct(
        title.alias("title"), author.alias("author"), domain.alias("domain"), score.alias("domain_confidence"), F.slice(keywords, 1, 10).alias("tags"),
        difficulty(keywords, n_entities, lexicon).alias("difficulty"), reading_time(length).alias("reading_time"),
    )
    content = F.struct(
        summary.alias("summary"), theme_list.alias("themes"), phrases.alias("phrases"), structs(entities).alias("entities"), structs(groups).alias("groups"),
        points.alias("main_points"), details.alias("details"), F.slice(phrases, 4, 3).alias("examples"),
    )
    structure = F.struct(
        structs(tiers(keywords)).alias("concepts"), concept_tree(keywords).alias("tree"), structs({n: F.slice(x, 1, 3) for n, x in groups.items()}).alias("domains"),
        F.slice(F.concat(each_with(theme_list, 3, ["Understand {}"], 3), each_with(keywords, 3, ["Master {}"], 3)), 1, 5).alias("objectives"),
        each_with(keywords, 5, ["{} in depth", "{} in practice"], 8).alias("related"),
    )
    relations = F.struct(
        concept_edges(keywords).alias("concepts"), entity_edges(entities).alias("entities"), hierarchy(keywords).alias("hierarchy"),
        functional_edges(groups["method"], groups["application"]).alias("functions"), dependencies(keywords).alias("dependencies"),
    )
    resources = F.concat(entities["tool"], entities["organization"])
    path = structs(learning_path(keywords, entities["tool"], entities["skill"]) | {"resources": resources})
    return F.struct(meta.alias("metadata"), content.alias("content"), structure.alias("structure"), relations.alias("relations"), path.alias("path"))
