"""Markdown from analysed documents, templates by platform and type, tags and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import literals


def bullets(words: Column, mark: str = "- ") -> Column:
    return F.array_join(F.transform(words, lambda w: F.concat(F.lit(mark), w)), "\n")


def section(title: str, body: Column) -> Column:
    """A heading with its body; empty where the body is."""
    return F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.lit(f"## {title}\n\n"), body)).otherwise("")


def joined(*parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda x: x != ""), "\n\n")


def markdown(g: Column, as_of: Column) -> Column:
    """The document of a graph() struct; the time is an argument, so that runs can be repeated."""
    meta, content, structure, relations, path = g["metadata"], g["content"], g["structure"], g["relations"], g["path"]
    row = lambda name, c: F.concat(F.lit(f"| {name} | "), c.cast("string"), F.lit(" |"))
    table = F.concat_ws("\n", F.lit("| field | value |\n| --- | --- |"), row("title", meta["title"]), row("author", meta["author"]), row("domain", meta["domain"]), row("difficulty", meta["difficulty"]), row("reading time", meta["reading_time"]))
    tags = F.array_join(F.transform(meta["tags"], lambda t: F.concat(F.lit("#"), F.replace(t, F.lit(" "), F.lit("_")))), " ")
    arrows = F.array_join(F.transform(F.slice(relations["concepts"], 1, 8), lambda e: F.concat(F.lit("    "), F.replace(e["source"], F.lit(" "), F.lit("_")), F.lit(" --> "), F.replace(e["target"], F.lit(" "), F.lit("_")))), "\n")
    drawn = F.when(arrows != "", F.concat(F.lit("```mermaid\ngraph TD\n"), arrows, F.lit("\n```"))).otherwise("")
    return joined(
        F.concat(F.lit("# "), meta["title"], F.lit("\n\n> "), as_of.cast("string")),
        section("Metadata", F.concat_ws("\n\n", table, F.nullif(tags, F.lit("")))),
        section("Content", F.concat_ws("\n\n", content["summary"], F.nullif(bullets(F.slice(content["phrases"], 1, 5)), F.lit("")))),
        section("Main points", bullets(content["main_points"])),
        section("Structure", F.concat_ws("\n", *[F.concat(F.lit(f"- {n}: "), F.array_join(structure["concepts"][n], ", ")) for n in ("primary", "secondary", "tertiary")])),
        section("Relations", drawn),
        section("Applications", bullets(path["practical_uses"])),
        section("Development", bullets(path["next_steps"], "- [ ] ")),
    )


#: (part, what it is looked up by: type, platform or pair, key, text); the key "" serves all others.
Template = tuple[str, str, str, str]


def templated(rows: DataFrame, templates: list[Template], platform: str = "platform", content_type: str = "content_type") -> DataFrame:
    """rows with a column t_<part> for each part of templates: its text for the row's key, or the general one, or null.

    The few texts are looked up in literal maps, so no join is needed.
    """
    keys = {"type": F.col(content_type), "platform": F.col(platform), "pair": F.concat_ws("/", platform, content_type)}
    out = {}
    for part in dict.fromkeys(p for p, *_ in templates):
        own = [(kind, value, text) for p, kind, value, text in templates if p == part]
        named = [F.when(keys[kind] == value, text) for kind, value, text in own if value]
        out[f"t_{part}"] = F.coalesce(*named, *[F.lit(text) for _, value, text in own if not value], F.lit(None).cast("string"))
    return rows.withColumns(out)


def template_document(rows: DataFrame, templates: list[Template], title: str = "title") -> DataFrame:
    """rows with document: after a front matter the templated parts under headings, then a line that sums up."""
    out = templated(rows, templates)
    parts = list(dict.fromkeys(p for p, *_ in templates))
    front = F.concat(F.lit("---\ntitle: "), F.col(title), F.lit("\n---"))
    body = joined(front, *[section(p.capitalize(), F.coalesce(f"t_{p}", F.lit(""))) for p in parts], F.format_string("> %s on %s: %s", F.col("content_type"), F.col("platform"), F.col(title)))
    return out.withColumn("document", body).drop(*[f"t_{p}" for p in parts])


TAGS = ("knowledge", "analysis")
PLATFORM_TAGS = {"www": ("site", "web"), "blog": ("blog", "post"), "m": ("mobile",), "douyin": ("video", "short"), "zhihu": ("qa", "long")}
TYPE_TAGS = {"article": ("article", "reading"), "short_video": ("clip",), "qa_answer": ("answer",)}


def tags(platform: Column, content_type: Column, theme: Column, cap: int = 8) -> Column:
    """Base, platform, type and theme tags, in this order."""
    none = F.array().cast("array<string>")
    of = lambda c, table: F.coalesce(*[F.when(c == k, literals(v)) for k, v in table.items()], none)
    return F.slice(F.concat(literals(TAGS), of(platform, PLATFORM_TAGS), of(content_type, TYPE_TAGS), F.when(theme != "", F.array(theme)).otherwise(none)), 1, cap)


def yaml_tags(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: F.concat(F.lit("  - "), w)), "\n")


def prompt(title: Column, content: Column, ask: str = "Give core_topic, summary, tags and main_sections as JSON.") -> Column:
    return F.format_string("%s\n\nTitle: %s\n\n%s", F.lit(ask), title, content)


def knowledge_markdown(parsed: Column) -> Column:
    """Markdown of a parsed answer: topic, summary, tags, sections with key points, takeaways."""
    schema = "core_topic string, summary string, tags array<string>, main_sections array<struct<title:string,key_points:array<string>>>, key_takeaways array<string>, actionable_insights array<string>"
    k = F.from_json(parsed, schema)
    parts = F.array_join(F.transform(k["main_sections"], lambda s: F.concat(F.lit("## "), s["title"], F.lit("\n\n"), bullets(F.coalesce(s["key_points"], F.array().cast("array<string>"))))), "\n\n")
    text = lambda c: F.coalesce(c, F.lit(""))
    return joined(F.concat(F.lit("# "), text(k["core_topic"])), text(k["summary"]), text(F.array_join(F.transform(k["tags"], lambda t: F.concat(F.lit("#"), t)), " ")), text(parts), section("Takeaways", text(bullets(k["key_takeaways"]))), section("Actions", text(bullets(k["actionable_insights"]))))


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def content_text(title: Column, author: Column, description: Column, views: Column) -> Column:
    """Labelled lines; description and counts only where they are there."""
    return F.concat(
        F.lit("Title: "), title, F.lit("\nAuthor: "), author,
        F.when(F.coalesce(description, F.lit("")) != "", F.concat(F.lit("\n\nDescription:\n"), description)).otherwise(""),
        F.when(views > 0, F.concat(F.lit("\nViews: "), thousands(views))).otherwise(""),
    )


def ocr_text(images: Column, least: float = 0.6, cap: int = 5) -> Column:
    """images: array of arrays of struct(text, conf). One line for each of the first images with confident text."""
    texts = F.transform(F.slice(images, 1, cap), lambda lines, i: F.struct((i + 1).alias("no"), F.array_join(F.transform(F.filter(lines, lambda x: (x["conf"] > least) & (F.trim(x["text"]) != "")), lambda x: x["text"]), " ").alias("text")))
    return F.array_join(F.transform(F.filter(texts, lambda t: t["text"] != ""), lambda t: F.concat(F.lit("图片"), t["no"].cast("string"), F.lit(": "), t["text"])), "\n")
