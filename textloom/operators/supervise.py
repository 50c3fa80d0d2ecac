"""Supervision of whole batches: document scores, duplicates, reports, recommendations and alerts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions.text import contains_any, kept
from textloom.operators.keywords import unique_tokens


# Template terms and platform standards that the scores follow from.
@dataclass(frozen=True)
class Standards:
    template_terms: tuple[str, ...] = ("综合知识", "未知标题", "未知作者", "视频", "内容分析", "知识图谱", "核心概念", "实用技巧", "深度见解")
    template_titles: tuple[str, ...] = ("综合知识", "未知标题", "视频", "内容分析")
    platforms: tuple[tuple[str, int, int, tuple[str, ...]], ...] = (
        ("douyin", 5, 200, ("视频", "抖音视频", "未知标题")), ("xiaohongshu", 3, 150, ("小红书", "笔记", "未知标题")),
        ("zhihu", 8, 300, ("知乎", "回答", "未知标题")), ("bilibili", 5, 200, ("B站", "视频", "未知标题")),
    )
    min_title: int = 3
    min_content: int = 100
    default_authors: tuple[str, ...] = ("未知作者", "")


def template_ratio(title: Column, content: Column, std: Standards = Standards()) -> Column:
    """Share of the template terms in content or title. The terms are few, so the engine looks for each; no text goes to Python."""
    both = F.concat(F.lower(content), F.lit("\n"), F.lower(title))
    return sum((F.when(F.contains(both, F.lit(t.lower())), 1).otherwise(0) for t in std.template_terms), F.lit(0)) / len(std.template_terms)


def platform_issues(platform: Column, title: Column, content: Column, std: Standards = Standards()) -> Column:
    pick = lambda i, default: F.coalesce(*[F.when(platform == p[0], F.lit(p[i])) for p in std.platforms], F.lit(default))
    return kept((F.length(title) < pick(1, std.min_title), "title_short"), (F.length(content) < pick(2, std.min_content), "content_short"), (is_forbidden(platform, title, std), "title_forbidden"))


def is_forbidden(platform: Column, title: Column, std: Standards = Standards()) -> Column:
    return F.coalesce(*[F.when(platform == p[0], title.isin(*p[3])) for p in std.platforms], F.lit(False))


def is_template_title(title: Column, std: Standards = Standards()) -> Column:
    return title.isin(*std.template_titles) | contains_any(title, std.template_terms)


def duplicates(docs: DataFrame, content: str = "content", order: str = "doc_id") -> DataFrame:
    """docs with content_hash, copies and is_duplicate, true for all but the first in order of equal contents.

    Equal contents are counted before they are joined back, so a text with very many copies makes no large group.
    """
    hashed = docs.withColumn("content_hash", F.md5(F.col(content).cast("binary")))
    groups = hashed.groupBy("content_hash").agg(F.count("*").alias("copies"), F.min(order).alias("first_of"))
    joined = hashed.join(groups, "content_hash")
    return joined.withColumn("is_duplicate", F.col(order) > F.col("first_of")).drop("first_of")


def scored(docs: DataFrame, std: Standards = Standards()) -> DataFrame:
    """(doc_id, platform, title, author, content) with template, issues, duplicate marks and quality_score in 0 to 1."""
    out = duplicates(docs)
    out = out.withColumns({
        "template": template_ratio(F.col("title"), F.col("content"), std), "found": platform_issues(F.col("platform"), F.col("title"), F.col("content"), std),
        "unique_words": unique_tokens(F.col("content")), "forbidden": is_forbidden(F.col("platform"), F.col("title"), std), "no_author": F.col("author").isin(*std.default_authors),
    })
    less = (
        F.when(F.col("template") > 0.7, 0.4).otherwise(0.0) + F.size("found") * 0.1 + F.when(F.col("is_duplicate"), 0.3).otherwise(0.0)
        + F.when(F.col("unique_words") < 50, 0.2).otherwise(0.0) + F.when(F.col("forbidden"), 0.3).otherwise(0.0) + F.when(F.col("no_author"), 0.1).otherwise(0.0)
    )
    more = kept(
        (F.col("template") > 0.7, "template"), (F.col("is_duplicate"), "duplicate"), (F.col("unique_words") < 50, "few_words"),
        (F.col("forbidden"), "forbidden_title"), (F.col("no_author"), "default_author"),
    )
    return out.withColumn("issues", F.concat("found", more)).withColumn("quality_score", F.round(F.greatest(F.lit(0.0), 1.0 - less), 6))


def batch_report(results: DataFrame, std: Standards = Standards()) -> DataFrame:
    """(platform, total, success, quality_issues) of (platform, status, title): only successes enter, as do their template titles."""
    good = results.where("status = 'success'").withColumn("bad", is_template_title(F.col("title"), std).cast("int"))
    return good.groupBy("platform").agg(F.count("*").alias("total"), F.count("*").alias("success"), F.sum("bad").alias("quality_issues"))


def batch_totals(results: DataFrame, std: Standards = Standards()) -> DataFrame:
    """One row: all rows, successes, template titles among them, unique ones, and whether over half are templates."""
    bad = is_template_title(F.col("title"), std)
    good = F.col("status") == "success"
    row = results.agg(F.count("*").alias("total"), F.count_if(good).alias("success"), F.count_if(good & bad).alias("template_documents"))
    row = row.withColumn("unique_documents", F.col("total") - F.col("template_documents"))
    return row.withColumn("alert", F.coalesce(F.try_divide("template_documents", "total") > 0.5, F.lit(False)))


def observed(results: DataFrame, platforms: Sequence[str], std: Standards = Standards(), name: str = "supervision") -> tuple[DataFrame, Observation]:
    """results as they are, and what batch_report() says of them, taken while they are written; so it needs no second pass.

    Rows of other platforms count in the totals only. With a stream, the metrics of each batch come with its progress
    instead: observed_stream() adds them up.
    """
    seen = Observation(name)
    return results.observe(seen, *_metrics(platforms, std)), seen


def observed_stream(results: DataFrame, platforms: Sequence[str], std: Standards = Standards(), name: str = "supervision") -> DataFrame:
    """A stream of results whose progress carries the metrics of observed() under this name."""
    return results.observe(name, *_metrics(platforms, std))


def _metrics(platforms: Sequence[str], std: Standards) -> list[Column]:
    good, bad = F.col("status") == "success", F.coalesce(is_template_title(F.col("title"), std), F.lit(False))
    out = [F.count(F.lit(1)).alias("total"), F.count_if(good).alias("success"), F.count_if(good & bad).alias("template_documents")]
    for i, p in enumerate(platforms):
        own = good & (F.col("platform") == p)
        out += [F.count_if(own).alias(f"success_{i}"), F.count_if(own & bad).alias(f"issues_{i}")]
    return out


def report_of(spark: SparkSession, metrics: Iterable[dict], platforms: Sequence[str]) -> DataFrame:
    """(platform, total, success, quality_issues) of the metrics of one pass, or of several batches; as batch_report()."""
    sums = Counter()
    for m in metrics:
        sums.update(m)
    rows = [(p, sums[f"success_{i}"], sums[f"success_{i}"], sums[f"issues_{i}"]) for i, p in enumerate(platforms) if sums[f"success_{i}"]]
    return spark.createDataFrame(rows, "platform string, total long, success long, quality_issues long")


def recommendations(report: DataFrame) -> DataFrame:
    """(platform, advice): platforms with issues in over 0.3 of the successes, and general advice if there is any issue."""
    bad = report.where(F.col("quality_issues") > 0.3 * F.col("success")).select("platform", F.lit("check_extractor").alias("advice"))
    general = report.agg(F.sum("quality_issues").alias("n")).where("n > 0").select(F.lit("all").alias("platform"), F.explode(F.array(F.lit("check_templates"), F.lit("check_sources"))).alias("advice"))
    return bad.unionByName(general)


def summary(rows: DataFrame, good: float = 0.6) -> DataFrame:
    """One row per platform of scored(): documents, good ones, their rate and the mean score."""
    return rows.groupBy("platform").agg(
        F.count("*").alias("documents"), F.count_if(F.col("quality_score") >= good).alias("good"), F.round(F.count_if(F.col("quality_score") >= good) / F.count("*"), 6).alias("rate"),
        F.round(F.avg("quality_score"), 6).alias("mean_score"),
    )


def duplicate_groups(rows: DataFrame) -> DataFrame:
    """(groups, documents): contents that stand in more than one row, and their rows."""
    groups = rows.groupBy("content_hash").agg(F.count("*").alias("n")).where("n > 1")
    return groups.agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("documents"))


def top_issues(rows: DataFrame, k: int = 5) -> DataFrame:
    """(rank, issue, n): the most frequent issues; names order equal counts."""
    counts = rows.select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "issue").limit(k)
    return counts.select(F.row_number().over(W.orderBy(F.desc("n"), "issue")).alias("rank"), "issue", "n")
