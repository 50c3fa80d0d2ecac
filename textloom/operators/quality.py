"""Validation before generation and scores of generated documents, as column expressions with explicit issue codes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.matching import term_counts
from textloom.functions.text import contains_any, count_contained, kept, literals, strip
from textloom.sources.shared import written

# Section headings, weights and bounds that the scores follow from.
SECTIONS_ZH = {
    "core_concepts": "核心概念", "methodologies": "方法论", "practical_tips": "实用技巧", "insights": "深度见解",
    "frameworks": "分析工具", "actionable_advice": "实践指南", "case_studies": "案例分析",
}
WEIGHTS = {"core_concepts": 5, "methodologies": 4, "practical_tips": 3, "insights": 6, "frameworks": 4, "actionable_advice": 3, "case_studies": 4}
REQUIRED, OPTIONAL = ("core_concepts", "methodologies", "practical_tips", "insights"), ("frameworks", "actionable_advice", "case_studies")
MINIMA = {"core_concepts": (3, 2, 2), "methodologies": (2, 1, 2), "practical_tips": (3, 2, 3), "insights": (2, 1, 2)}  # base, floor, ideal above
TYPE_FACTORS = {"management": 1.1, "technology": 1.0, "finance": 1.1, "business": 1.0, "education": 1.2, "lifestyle": 0.8, "general": 0.9}
PASS_THRESHOLD, PASS_FLOOR = 70.0, 50.0
ACTIONABLE_ZH = ("具体", "步骤", "方法", "技巧", "建议", "策略", "实施", "执行", "操作")
PROFESSIONAL_ZH = ("理论", "框架", "模型", "机制", "原理", "体系", "策略", "方法论", "分析", "评估", "优化", "管理", "控制", "实施", "应用", "研究")
DEPTH_ZH = ("深入", "系统", "全面", "综合", "详细", "具体", "实际", "案例")


@dataclass(frozen=True)
class Gate:
    """What the validation of a record compares with."""

    default_platforms: tuple[str, ...] = ("unknown", "未知平台")
    default_titles: tuple[str, ...] = ("未知标题", "无标题", "默认标题")
    platform_titles: tuple[tuple[str, tuple[str, ...]], ...] = (
        ("douyin", ("抖音视频", "视频")), ("xiaohongshu", ("小红书笔记", "小红书内容", "笔记")), ("zhihu", ("知乎内容", "知乎视频")), ("bilibili", ("bilibili视频", "哔哩哔哩视频", "B站视频")),
    )
    auto_prefixes: tuple[str, ...] = ("抖音视频_", "小红书笔记_", "视频_")
    default_authors: tuple[str, ...] = ("未知作者", "无作者", "默认作者", "匿名")
    default_descriptions: tuple[str, ...] = ("无法获取视频描述", "无法获取内容描述", "无法获取笔记描述", "未知内容", "默认描述", "无描述", "暂无描述")
    default_indicators: tuple[str, ...] = ("标题: 抖音视频", "标题: 小红书", "标题: 视频", "作者: 未知作者", "描述:\n无法获取", "描述: 无法获取")
    topic_words: tuple[str, ...] = tuple("管理 团队 领导 策略 营销 销售 客户 市场 品牌 运营 技术 开发 编程 代码 算法 软件 系统 工具 ai python 投资 理财 股票 基金 金融 财务 资本 收益 风险 学习 教育 知识 技能 培训 课程 方法 经验 思维 健康 美食 旅行 时尚 生活 家居 购物 娱乐 成长 职业 规划 目标 习惯 能力 心理 情商".split())
    labels: str = "(标题:|作者:|描述:|平台:)"


def issues(platform: Column, title: Column, author: Column, description: Column, content: Column, gate: Gate = Gate()) -> Column:
    """Issue codes of a record in a fixed order; none means valid. A null field counts as missing, and only that is told."""
    t, a, d, c = strip(title), strip(author), strip(description), strip(content)
    defaults = F.coalesce(*[F.when(platform == p, literals(ts)) for p, ts in gate.platform_titles], F.array().cast("array<string>"))
    everything = F.lower(F.concat_ws(" ", title, description, content))
    info = strip(F.regexp_replace(F.regexp_replace(content, gate.labels, ""), r"(?U)\s+", " "))
    missing = kept((platform.isNull(), "missing_platform"), (title.isNull(), "missing_title"), (content.isNull(), "missing_content"))
    found = kept(
        ((platform == "") | platform.isin(*gate.default_platforms), "platform_default"),
        (t == "", "title_empty"),
        ((t != "") & (F.array_contains(defaults, t) | t.isin(*gate.default_titles)), "title_default"),
        ((t != "") & (F.length(t) < 3), "title_short"),
        ((t != "") & F.exists(literals(gate.auto_prefixes), lambda p: F.startswith(t, p)), "title_generated"),
        ((t != "") & (F.length(F.regexp_replace(t, r"(?U)[0-9\s\-_\.@#]+", "")) < 3), "title_meaningless"),
        (F.coalesce(a, F.lit("")) == "", "author_empty"),
        (a.isin(*gate.default_authors), "author_default"),
        (F.coalesce(d, F.lit("")) == "", "description_empty"),
        (d.isin(*gate.default_descriptions), "description_default"),
        ((d != "") & (F.length(d) < 10), "description_short"),
        (c == "", "content_empty"),
        ((c != "") & (F.length(c) < 50), "content_short"),
        (count_contained(c, gate.default_indicators) >= 2, "content_default"),
        ((F.length(content) < 200) & ~contains_any(everything, gate.topic_words), "content_irrelevant"),
        (F.length(info) < 30, "content_thin"),
    )
    return F.when(F.size(missing) > 0, missing).otherwise(found)


def sections(document: Column, names: dict[str, str] = SECTIONS_ZH) -> dict[str, Column]:
    """The text under each heading, up to the next heading of any level; empty where it is missing."""
    return {key: strip(F.regexp_extract(document, rf"(?is)##.*?{name}.*?\n(.*?)(?=##|\z)", 1)) for key, name in names.items()}


def items(section: Column, placeholders: tuple[str, ...] = ("*暂无", "待")) -> Column:
    """Lines over 20 characters with a colon, a bullet or bold type, placeholders left out."""
    lines = F.transform(F.split(section, "\n"), strip)
    good = lambda x: (F.length(x) > 20) & ~F.exists(literals(placeholders), lambda p: F.startswith(x, p)) & (F.contains(x, F.lit("：")) | F.contains(x, F.lit(":")) | F.startswith(x, F.lit("- ")) | F.startswith(x, F.lit("**")))
    return F.size(F.filter(lines, good))


def length_score(length: Column) -> Column:
    """0 to 60 below 1000 characters, to 100 at 3000, 100 up to 8000, then down to 80."""
    return (
        F.when(length < 1000, length / 1000 * 60)
        .when(length <= 3000, 60 + (length - 1000) / 2000 * 40)
        .when(length <= 8000, F.lit(100.0))
        .otherwise(F.greatest(100 - (length - 8000) / 8000 * 20, F.lit(80.0)))
    )


def adjusted_standards(content_type: Column, original_length: Column) -> dict[str, Column]:
    """Factor, pass threshold and minima for a type and an original length; the middle length branch is unreachable."""
    by_length = F.when(original_length < 500, 0.7).when(original_length < 200, 0.5).when(original_length > 2000, 1.2).otherwise(1.0)
    by_type = F.coalesce(*[F.when(content_type == t, F.lit(f)) for t, f in TYPE_FACTORS.items()], F.lit(1.0))
    factor = by_length * by_type
    out = {"factor": factor, "pass_threshold": F.greatest(PASS_THRESHOLD * factor, F.lit(PASS_FLOOR))}
    return out | {f"min_{name}": F.greatest((base * factor).cast("int"), F.lit(floor)) for name, (base, floor, _) in MINIMA.items()}


def density_score(counts: dict[str, Column], standards: dict[str, Column]) -> Column:
    """Weighted score of the item counts: 60 % at the minimum, 100 % at the ideal."""
    total = F.lit(0.0)
    for name, count in counts.items():
        least = standards[f"min_{name}"] if name in MINIMA else F.lit(1)
        ideal = least + (MINIMA[name][2] if name in MINIMA else 2)
        score = F.when(count >= ideal, 100.0).when(count >= least, 100 * (0.6 + 0.4 * (count - least) / (ideal - least))).otherwise(100 * count / least * 0.6)
        total = total + WEIGHTS[name] * score
    return F.least(total / (sum(WEIGHTS.values()) * 100) * 100, F.lit(100.0))


def structure_score(parts: dict[str, Column]) -> Column:
    """70 points over the required sections and 30 over the optional ones; a section counts over 50 characters."""
    points = F.lit(0.0)
    for names, whole in ((REQUIRED, 70), (OPTIONAL, 30)):
        for n in names:
            points = points + F.when(F.length(parts[n]) > 50, whole / len(names)).otherwise(0.0)
    return points


def practicality(parts: dict[str, Column], terms: tuple[str, ...] = ACTIONABLE_ZH) -> Column:
    names = ("practical_tips", "actionable_advice", "methodologies")
    counts = (F.get(term_counts(parts[n], [terms]), F.lit(0)) for n in names)
    return sum((F.least(n * 10, F.lit(100)) for n in counts), F.lit(0)) / 3


def professionalism(document: Column, terms: tuple[str, ...] = PROFESSIONAL_ZH, depth: tuple[str, ...] = DEPTH_ZH) -> Column:
    counts = term_counts(document, [terms, depth])
    return F.least(F.get(counts, F.lit(0)) * 8, F.lit(80)) + F.least(F.get(counts, F.lit(1)) * 5, F.lit(20))


def content_score(length: Column, structure: Column, practical: Column, professional: Column) -> Column:
    return F.least(length * 0.25 + structure * 0.30 + practical * 0.25 + professional * 0.20, F.lit(100.0))


def meaningful_ratio(document: Column, placeholders: tuple[str, ...] = ("*暂无", "待")) -> Column:
    """Lines over 10 characters that are no heading, rule or placeholder, over all lines."""
    lines = F.split(document, "\n")
    skip = ("#", "---", *placeholders)
    good = F.filter(F.transform(lines, strip), lambda x: (F.length(x) > 10) & ~F.exists(literals(skip), lambda p: F.startswith(x, p)))
    return F.size(good) / F.size(lines)


def overall(density: Column, content: Column, judged: Column, confidence: Column) -> Column:
    """With a confident outside judgement 30/30/40, else 60/40."""
    return F.when(confidence > 0.5, density * 0.3 + content * 0.3 + judged * 0.4).otherwise(density * 0.6 + content * 0.4)


def level(score: Column) -> Column:
    return F.when(score >= 90, "excellent").when(score >= 80, "good").when(score >= 70, "fair").when(score >= 60, "poor").otherwise("bad")


def suggestions(counts: dict[str, Column], content: Column, standards: dict[str, Column]) -> Column:
    """Codes of what to improve; a general one where no other applies and the counts are low in all."""
    short = [(counts[n] < standards[f"min_{n}"], f"more_{n}") for n in MINIMA]
    weak = [((content < 70) & (counts[n] < 2), f"add_{n}") for n in ("actionable_advice", "case_studies", "frameworks")]
    found = kept(*short, *weak)
    total = sum(counts.values(), F.lit(0))
    return F.when((F.size(found) == 0) & (total < 15), F.array(F.lit("raise_density"))).otherwise(found)


#: Least counts below which a section is to be improved, in order.
SPECIFIC = {"core_concepts": 3, "methodologies": 2, "practical_tips": 3, "insights": 2, "frameworks": 2, "actionable_advice": 3, "case_studies": 2}


def specific_improvements(counts: dict[str, Column], length: Column, structure: Column) -> Column:
    """Codes for each short section, a short whole, and a structure score under 0.8 (on its scale of 100)."""
    return kept(*[(counts[n] < least, f"expand_{n}") for n, least in SPECIFIC.items()], (length < 2000, "expand_whole"), (structure < 0.8, "complete_structure"))


#: Area, section, count below which it applies, target, urgency, impact (3 high, 2 medium, 1 low).
PRIORITIES = [("core_concepts", 3, 5, 3, 3), ("practical_tips", 3, 7, 3, 3), ("insights", 2, 5, 2, 3), ("methodologies", 2, 4, 2, 2)]


def priorities(counts: dict[str, Column], judged: dict[str, Column] | None = None, cap: int = 5) -> Column:
    """Areas by urgency and impact, ties in declared order; judged adds areas scored under 75 by an outside judge."""
    made = [F.when(counts[n] < least, F.struct(F.lit(-u).alias("u"), F.lit(-i).alias("i"), F.lit(k).alias("k"), F.lit(n).alias("area"))) for k, (n, least, _, u, i) in enumerate(PRIORITIES)]
    for k, (n, score) in enumerate((judged or {}).items(), len(made)):
        made.append(F.when(score < 75, F.struct(F.lit(-3).alias("u"), F.lit(-3).alias("i"), F.lit(k).alias("k"), F.lit(n).alias("area"))))
    ranked = F.array_sort(F.filter(F.array(*made), lambda x: x.isNotNull()))
    return F.slice(F.transform(ranked, lambda x: x["area"]), 1, cap)


def actions(counts: dict[str, Column], cap: int = 4) -> Column:
    return F.slice(kept((counts["core_concepts"] < 3, "expand_concepts"), (counts["practical_tips"] < 5, "add_tips"), (counts["insights"] < 3, "deepen_insights")), 1, cap)


#: Improvements by type; `general` for others.
TYPE_IMPROVEMENTS = {
    "technology": ("show the design", "name the tools", "measure it", "give code"), "education": ("name the theory", "add exercises", "add checks", "give lessons"),
    "business": ("model the market", "know the customer", "run it well", "give cases"), "general": ("explain more", "add steps", "add sources", "give examples"),
}


def type_improvements(content_type: Column, score: Column) -> Column:
    """All under 60, the first two under 80, else the first."""
    texts = F.coalesce(*[F.when(content_type == t, literals(x)) for t, x in TYPE_IMPROVEMENTS.items()], literals(TYPE_IMPROVEMENTS["general"]))
    return F.slice(texts, F.lit(1), F.when(score < 60, 4).when(score < 80, 2).otherwise(1))


def judged_improvements(judged: dict[str, Column], advice: Column, least: float = 75.0) -> Column:
    """Codes of the areas that an outside judge scores under least, then its own advice of over five characters."""
    own = kept(*[(score < least, f"raise_{name}") for name, score in judged.items()])
    return F.concat(own, F.filter(F.coalesce(advice, F.array().cast("array<string>")), lambda a: F.length(a) > 5))


def feedback(overall: Column, counts: dict[str, Column], content_type: Column, threshold: float = PASS_THRESHOLD) -> Column:
    """struct(passed, score, level, priorities, actions, advice)."""
    return F.struct(
        (overall >= threshold).alias("passed"), overall.alias("score"), level(overall).alias("level"), priorities(counts).alias("priorities"), actions(counts).alias("actions"),
        type_improvements(content_type, overall).alias("advice"),
    )


def until_passed(docs: DataFrame, assess: Callable[[DataFrame], DataFrame], regenerate: Callable[[DataFrame], DataFrame], rounds: int = 3, threshold: float = PASS_THRESHOLD) -> DataFrame:
    """docs assessed, those under the threshold regenerated and assessed again, at most so many times; with retries.

    assess adds `overall`; regenerate returns the columns that assess reads. Only what still fails is done again. Each
    round is a table in the shared folder, so a lost executor does not make regenerate, which may vary, run again.
    """
    done, left = None, written(assess(docs), "assessed")
    for n in range(rounds):
        passed = left.where(F.col("overall") >= threshold).withColumn("retries", F.lit(n))
        done = passed if done is None else done.unionByName(passed)
        failing = left.where(F.coalesce(F.col("overall"), F.lit(0.0)) < threshold)
        if failing.isEmpty():
            return done
        left = written(assess(regenerate(failing).select(docs.columns)), "assessed")
    rest = left.withColumn("retries", F.lit(rounds))
    return rest if done is None else done.unionByName(rest)


def improvement_prompt(found: Column) -> Column:
    return F.array_join(found, "; ")


def assessed(docs: DataFrame, document: Column, content_type: Column, original_length: Column, names: dict[str, str] = SECTIONS_ZH, actionable=ACTIONABLE_ZH, professional=PROFESSIONAL_ZH, depth=DEPTH_ZH) -> DataFrame:
    """docs with sections (sec_*), counts (n_*), standards and all scores; each is computed once per row."""
    out = docs.withColumns({f"sec_{k}": c for k, c in sections(document, names).items()})
    parts = {k: F.col(f"sec_{k}") for k in names}
    counts = {k: F.col(f"n_{k}") for k in names}
    std = adjusted_standards(content_type, original_length)
    out = out.withColumns({f"n_{k}": items(c) for k, c in parts.items()} | {f"std_{k}": c for k, c in std.items()})
    standards = {k: F.col(f"std_{k}") for k in std}
    out = out.withColumns({
        "density": density_score(counts, standards), "length_points": length_score(F.length(document)), "structure": structure_score(parts),
        "practicality": practicality(parts, actionable), "professionalism": professionalism(document, professional, depth), "document_length": F.length(document),
    })
    out = out.withColumn("content_quality", content_score(*map(F.col, ("length_points", "structure", "practicality", "professionalism"))))
    none = F.lit(0.0)
    return out.withColumn("overall", overall(F.col("density"), F.col("content_quality"), none, none)).withColumn("level", level(F.col("overall")))
