"""The engine as one object: pages in, judged records, documents and reports out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import html, urls
from textloom.functions.lexicons import ZH, Lexicon
from textloom.functions.text import filled
from textloom.operators import analysis, graph, keywords, quality, records, render, segmenting, store, supervise
from textloom.sources.shared import written


def analysed(docs: DataFrame, lexicon: Lexicon = ZH, cut: Callable[[str], list[str]] = keywords.words_of) -> DataFrame:
    """(doc_id, title, text and more) with keywords, domain, phrases, theme_list and summary.

    cut gives the words of a text: runs of letters and digits, or those of segmenting.cutter() for text without spaces.
    """
    out = keywords.keyword_arrays(docs, lexicon, cut=cut)
    kw, text = F.col("keywords"), F.col("text")
    out = out.withColumn("dom", analysis.keyword_domain(kw, lexicon)).withColumn("domain", F.col("dom.domain")).withColumn("domain_score", F.col("dom.score")).drop("dom")
    out = out.withColumn("phrases", analysis.key_phrases(text, kw, lexicon)).withColumn("theme_list", analysis.themes(F.col("title"), kw, F.col("domain"), lexicon))
    return out.withColumn("summary", analysis.template_summary(F.col("title"), text, kw, lexicon))


def richly_analysed(docs: DataFrame, lexicon: Lexicon = ZH, least: int = 10, cut: Callable[[str], list[str]] = keywords.words_of) -> DataFrame:
    """(doc_id, title, description, content) rows to one struct analysis each, as a column.

    Keywords are those of the highest TF-IDF share, here by frequency within the text, then those of the best company; texts
    under least characters get the empty record of the domain unknown.
    """
    text = F.trim(F.concat_ws(" ", "title", "description", "content"))
    rule = keywords.keyword_rule(lexicon)
    out = docs.withColumn("_text", text).withColumn("_kw", keywords.united(F.col("_text"), rule, cut=cut))
    out = out.withColumn("_dom", analysis.weighted_domain(F.col("_text"), F.col("_kw"), lexicon))
    groups = keywords.overlapping(F.col("_kw"), lexicon, F.col("_dom.domain") != "general")
    out = out.withColumn("_themes", analysis.rich_themes(F.col("_text"), groups, lexicon))
    entities = F.struct(*[c.alias(n) for n, c in analysis.pattern_entities(F.col("_text"), F.col("_kw"), lexicon).items()])
    full = F.length("_text") >= least
    words = lambda c: F.when(full, c).otherwise(F.array().cast("array<string>"))
    made = F.struct(
        words(F.slice("_kw", 1, 20)).alias("keywords"), words(F.col("_themes")).alias("themes"), F.when(full, entities).alias("entities"),
        words(analysis.short_phrases(F.col("_text"), F.col("_kw"), lexicon)).alias("key_phrases"), F.when(full, F.col("_dom.domain")).otherwise("unknown").alias("domain"), F.when(full, F.col("_dom.score")).otherwise(0.0).alias("domain_score"),
        F.when(full, analysis.extractive_summary(F.col("title"), F.col("_text"), F.col("_kw"), F.col("_themes"), lexicon)).otherwise(lexicon.texts["too_short"]).alias("summary"),
        F.length("_text").alias("text_length"), F.when(full, keywords.density(F.col("_kw"), F.col("_text"))).otherwise(0.0).alias("keyword_density"),
    )
    return out.withColumn("analysis", made).drop("_text", "_kw", "_dom", "_themes")


def with_graph(docs: DataFrame, author: Column, lexicon: Lexicon = ZH) -> DataFrame:
    """analysed() rows with the whole graph as one struct."""
    kw = F.col("keywords")
    parts = (F.col("title"), author, F.col("domain"), F.col("domain_score"), F.length("text"), kw, analysis.keyword_entities(kw, lexicon), keywords.grouped(kw, lexicon))
    return docs.withColumn("graph", graph.graph(*parts, F.col("phrases"), F.col("theme_list"), F.col("summary"), lexicon))


@dataclass
class Engine:
    """Settings of a run; every table and threshold is an argument with a default."""

    spark: SparkSession
    lexicon: Lexicon = ZH
    platforms: tuple = urls.PLATFORM_PATTERNS
    gate: quality.Gate = field(default_factory=quality.Gate)
    standards: supervise.Standards = field(default_factory=supervise.Standards)
    #: Words for text without spaces, of segmenting.vocabulary(); None takes runs of letters and digits as words.
    vocabulary: segmenting.Vocabulary | None = None

    def _cut(self) -> Callable[[str], list[str]]:
        return keywords.words_of if self.vocabulary is None else segmenting.cutter(self.spark, self.vocabulary)

    def supported_platforms(self) -> DataFrame:
        rows = [(name, len(patterns)) for name, patterns in self.platforms]
        return self.spark.createDataFrame(rows, "platform string, patterns int")

    def supported_formats(self) -> DataFrame:
        return self.spark.createDataFrame([("markdown",)], "format string")

    def extract(self, pages: DataFrame) -> DataFrame:
        """(page_id, url, html) to records (doc_id, platform, url, status, message, title, author, description, content).

        Pages may have a column shared, the text that a link was shared with, and the columns info, tags and parts, the
        captured answers of a video site's interface. Each platform's record comes from the page state, then from the
        markup, then from the shared text; other pages give their metadata and their text. The records
        are written to the shared folder once, as later steps read their columns many times.
        """
        name = urls.platform(F.col("url"), self.platforms)
        rows = urls.routed(pages, name, [n for n, _ in self.platforms])
        given = lambda c: F.col(c) if c in pages.columns else F.lit(None).cast("string")
        page, shared = F.coalesce("html", F.lit("")), given("shared")
        kind = F.coalesce(urls.typed_id(F.col("url"))["type"], F.lit(""))
        body = F.trim(html.unescaped(F.regexp_replace(F.regexp_replace(page, "(?is)<(script|style)[^>]*>.*?</\\1>", " "), "(?s)<[^>]*>", " ")))
        rows = rows.withColumn("_kind", kind).withColumn("_state", records.state_of(page))
        state, of_kind = F.col("_state"), lambda name, c: F.when(F.col("platform") == name, c)
        entry = F.coalesce(of_kind("douyin", records.video_entry(state)), of_kind("xiaohongshu", records.note_entry(state)), of_kind("zhihu", records.qa_entry(state, F.col("_kind"))))
        rows = rows.withColumn("_entry", entry)
        of = {
            "douyin": (records.video_record(page, F.col("_entry"), F.coalesce(shared, F.lit(""))), "description", records.video_text, F.lit(True)),
            "xiaohongshu": (records.note_record(page, F.col("_entry")), "description", lambda r: records.note_text(r, F.lit("")), F.lit(True)),
            "zhihu": (records.qa_record(page, F.col("_entry"), F.col("_kind")), "excerpt", lambda r: records.qa_text(r, F.col("_kind")), F.lit(True)),
            "bilibili": (records.api_record(*map(given, ("info", "tags", "parts"))), "description", records.api_text, given("info").isNotNull()),
        }
        common = F.struct(html.title_cascade(page).alias("title"), filled(html.meta(page, "author"), "").alias("author"), filled(html.meta(page, "description"), "").alias("description"), F.lit("").alias("text"))
        made = [F.when((F.col("platform") == n) & there, F.struct(r["title"].alias("title"), r["author"].alias("author"), r[d].alias("description"), text(r).alias("text"))) for n, (r, d, text, there) in of.items()]
        rows = rows.withColumn("_record", F.coalesce(*made, common)).withColumn("_common", common)
        # Defaults say that nothing was found; the page's own metadata are better, and else the field is empty, for the gate.
        blank = {"title": [*records.DEFAULT_TITLES.values(), *records.QA_TITLES.values()], "author": [records.UNKNOWN_AUTHOR], "description": []}
        fields = {c: filled(F.coalesce(*[F.when(~F.col(f"{r}.{c}").isin("", *gone), F.col(f"{r}.{c}")) for r in ("_record", "_common")]), "") for c, gone in blank.items()}
        out = rows.select(
            F.col("page_id").alias("doc_id"), "platform", "url", "status", "message", *[c.alias(n) for n, c in fields.items()],
            F.concat_ws("\n", F.nullif(F.col("_record.text"), F.lit("")), body).alias("content"),
        )
        return written(out, "records")

    def validate(self, records: DataFrame) -> DataFrame:
        """records with issues; rows with any become errors, and stay."""
        found = quality.issues(*map(F.col, ("platform", "title", "author", "description", "content")), self.gate)
        out = records.withColumn("issues", F.when(F.col("status") == "success", found).otherwise(F.array().cast("array<string>")))
        bad = F.size("issues") > 0
        return out.withColumn("status", F.when(bad, "error").otherwise(F.col("status"))).withColumn("message", F.when(bad, F.array_join("issues", "; ")).otherwise(F.col("message")))

    def process(self, pages: DataFrame, as_of: Column) -> DataFrame:
        """Pages to documents: valid records are analysed and rendered; the others keep their status and message."""
        checked = self.validate(self.extract(pages))
        good = checked.where("status = 'success'").withColumn("text", F.concat_ws(" ", "title", "description", "content"))
        made = with_graph(analysed(good, self.lexicon, self._cut()), F.col("author"), self.lexicon).select(*checked.columns, render.markdown(F.col("graph"), as_of).alias("document"))
        return made.unionByName(checked.where("status <> 'success'").withColumn("document", F.lit(None).cast("string")))

    def batch(self, pages: DataFrame, cache: DataFrame | None, now: Column, ttl: str = "24 hours") -> DataFrame:
        """process() of the pages whose link is not in the cache (url_hash, cached_at)."""
        keyed = pages.withColumn("url_hash", urls.url_key(F.col("url")))
        if cache is not None:
            keyed = store.misses(keyed, store.valid(cache, now, ttl))
        return self.process(keyed.drop("url_hash"), now)

    def report(self, results: DataFrame) -> DataFrame:
        return supervise.batch_report(results, self.standards)
