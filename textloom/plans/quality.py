"""Registered queries over validation, document scores, supervision and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import quality, supervise
from textloom.plans import sqltext as q
from textloom.sources.shared import shared_path
from textloom.streaming import jobs, ttl

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")


# Validation of documents as records: the first word as title, the language as author, the second line as description.
GATE = quality.Gate(
    default_platforms=("src7",), default_titles=("The", "La", "Der"), platform_titles=(("src0", ("Of", "De")), ("src1", ("Ing",))), auto_prefixes=("Th", "Ch"),
    default_authors=("fr",), default_descriptions=("The.", "La."), default_indicators=("tion", "keit", "que", "ción"), topic_words=("thing", "keit", "mente", "eux"), labels="(the|la|der)",
)
_R = "r AS (SELECT doc_id, source AS p, split_part(text, ' ', 1) AS title, lang AS a, split_part(text, chr(10), 2) AS descr, text AS content FROM documents)"
_T, _D, _C = q.strip("title"), q.strip("descr"), q.strip("content")
_INFO = q.strip(rf"regexp_replace(regexp_replace(content, '{GATE.labels}', '', 'g'), '[\t-\r\x20\x85\p{{Z}}]+', ' ', 'g')")
_DEF = "CASE p " + " ".join(f"WHEN {q.text(p)} THEN {q.array(ts)}" for p, ts in GATE.platform_titles) + " ELSE []::VARCHAR[] END"
_ISSUES = q.keep(
    ("p = '' OR p IN ('src7')", "'platform_default'"),
    (f"{_T} = ''", "'title_empty'"),
    (f"{_T} <> '' AND (list_contains({_DEF}, {_T}) OR {_T} IN ('The', 'La', 'Der'))", "'title_default'"),
    (f"{_T} <> '' AND length({_T}) < 3", "'title_short'"),
    (f"{_T} <> '' AND (starts_with({_T}, 'Th') OR starts_with({_T}, 'Ch'))", "'title_generated'"),
    (rf"{_T} <> '' AND length(regexp_replace({_T}, '[0-9\t-\r\x20\x85\p{{Z}}\-_\.@#]+', '', 'g')) < 3", "'title_meaningless'"),
    (f"coalesce({q.strip('a')}, '') = ''", "'author_empty'"),
    (f"{q.strip('a')} IN ('fr')", "'author_default'"),
    (f"{_D} = ''", "'description_empty'"),
    (f"{_D} IN ('The.', 'La.')", "'description_default'"),
    (f"{_D} <> '' AND length({_D}) < 10", "'description_short'"),
    (f"{_C} = ''", "'content_empty'"),
    (f"{_C} <> '' AND length({_C}) < 50", "'content_short'"),
    (f"len({q.found(_C, GATE.default_indicators)}) >= 2", "'content_default'"),
    (f"length(content) < 200 AND NOT {q.any_in(chr(39).join(['lower(title || ', ' ', ' || descr || ', ' ', ' || content)']), GATE.topic_words)}", "'content_irrelevant'"),
    (f"length({_INFO}) < 30", "'content_thin'"),
)


@query(f"WITH {_R}, i AS (SELECT doc_id, {_ISSUES} AS found FROM r) SELECT doc_id, {q.joined('found')} AS issues, len(found) = 0 AS valid FROM i")
def validate_gate(spark, sf_dir):
    line = F.coalesce(F.get(F.split("text", "\n"), F.lit(1)), F.lit(""))
    found = quality.issues(F.col("source"), F.substring_index("text", " ", 1), F.col("lang"), line, F.col("text"), GATE)
    return docs(spark, sf_dir).withColumn("found", found).select("doc_id", F.array_join("found", "|").alias("issues"), (F.size("found") == 0).alias("valid"))


# Documents composed into Markdown with headings, so that section operators have something to read.
NAMES = {
    "core_concepts": "Core ideas", "methodologies": "Methods", "practical_tips": "Tips", "insights": "Insights", "frameworks": "Tools", "actionable_advice": "Guide", "case_studies": "Cases",
}
ACTIONABLE = ("ing", "ung", "ment", "tion", "keit", "que")
PROFESSIONAL = ("tion", "keit", "ment", "ble", "ously", "lich", "eux", "mente", "ción", "zzz", "str", "ndw")
DEPTH = ("there", "schau", "quel", "ónde", "thing")
PLACEHOLDERS_SQL = "(starts_with(x, '*暂无') OR starts_with(x, '待'))"
#: Headings of the composed document with the shares of a text's characters, in twelfths, that stand under them, and how
#: sentences are marked there. The last share goes to the end, so every character of a text is in the document.
SHARES = (
    ("## Core ideas\n- ", 3, ". ", "\n- "), ("## Methods\n- ", 2, ". ", "\n- "), ("### Tips\n**", 2, ", ", "\n**"), ("## Insights\nx: ", 2, ". ", "\ny: "),
    ("## Tools\n- ", 1, "", ""), ("## Guide\n- ", 1, ". ", "\n- "), ("## Cases\n", 1, "", ""),
)


def _pieces():
    done = 0
    for heading, share, old, new in SHARES:
        yield heading, done, done + share, old, new
        done += share


_LIT = lambda x: " || chr(10) || ".join(q.text(part) for part in x.split("\n"))
_DOC = "'# ' || source || chr(10)"
for _heading, _from, _to, _old, _new in _pieces():
    _piece = f"substr(text, length(text) * {_from} // 12 + 1, length(text) * {_to} // 12 - length(text) * {_from} // 12)"
    _DOC += f" || {_LIT(_heading)} || " + (f"replace({_piece}, {q.text(_old)}, {_LIT(_new)})" if _old else _piece) + " || chr(10)"


def composed(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [F.lit("# "), F.col("source"), F.lit("\n")]
    at = lambda share: F.floor(F.length("text") * share / 12).cast("int")
    for heading, begin, end, old, new in _pieces():
        piece = F.substring("text", at(begin) + 1, at(end) - at(begin))
        parts += [F.lit(heading), F.replace(piece, F.lit(old), F.lit(new)) if old else piece, F.lit("\n")]
    kind = F.when(F.col("lang") == "en", "technology").when(F.col("lang") == "de", "education").otherwise("general")
    return docs(spark, sf_dir).select("doc_id", F.concat(*parts).alias("document"), kind.alias("kind"), F.length("text").alias("n"))


SEC = f"d AS (SELECT doc_id, {_DOC} AS document, CASE lang WHEN 'en' THEN 'technology' WHEN 'de' THEN 'education' ELSE 'general' END AS kind, length(text) AS n FROM documents), s AS (SELECT *, " + ", ".join(
    q.strip(rf"regexp_extract(document, '(?is)##.*?{name}.*?\n(.*?)(?:##|\z)', 1)") + f" AS sec_{k}" for k, name in NAMES.items()
) + " FROM d)"
_ITEM = f"length(x) > 20 AND NOT {PLACEHOLDERS_SQL} AND (contains(x, '：') OR contains(x, ':') OR starts_with(x, '- ') OR starts_with(x, '**'))"
CNT = "c AS (SELECT *, " + ", ".join(f"len(list_filter(list_transform(string_split(sec_{k}, chr(10)), lambda x: {q.strip('x')}), lambda x: {_ITEM}))::INTEGER AS n_{k}" for k in NAMES) + " FROM s)"


def assessed(spark, sf_dir):
    return quality.assessed(composed(spark, sf_dir), F.col("document"), F.col("kind"), F.col("n"), NAMES, ACTIONABLE, PROFESSIONAL, DEPTH)


@query(f"WITH {SEC} SELECT doc_id, " + ", ".join(f"sec_{k}" for k in NAMES) + " FROM s")
def section_extract(spark, sf_dir):
    rows = composed(spark, sf_dir)
    return rows.select("doc_id", *[c.alias(f"sec_{k}") for k, c in quality.sections(F.col("document"), NAMES).items()])


@query(f"WITH {SEC}, {CNT} SELECT doc_id, " + ", ".join(f"n_{k}" for k in NAMES) + " FROM c")
def section_items(spark, sf_dir):
    return assessed(spark, sf_dir).select("doc_id", *[f"n_{k}" for k in NAMES])


_LEN = "CASE WHEN {0} < 1000 THEN {0} / 1000::DOUBLE * 60 WHEN {0} <= 3000 THEN 60 + ({0} - 1000) / 2000::DOUBLE * 40 WHEN {0} <= 8000 THEN 100 ELSE greatest(100 - ({0} - 8000) / 8000::DOUBLE * 20, 80) END"


@query(f"SELECT doc_id, round(({_LEN.format('length(text)')})::DOUBLE, 6) AS points FROM documents")
def length_score(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.round(quality.length_score(F.length("text")), 6).alias("points"))


@query(f"""SELECT doc_id, round(len(list_filter(list_transform(string_split(text, chr(10)), lambda x: {q.strip('x')}), lambda x: length(x) > 10 AND NOT (starts_with(x, '#') OR starts_with(x, '---') OR {PLACEHOLDERS_SQL})))
/ len(string_split(text, chr(10)))::DOUBLE, 6) AS ratio FROM documents""")
def meaningful_ratio(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.round(quality.meaningful_ratio(F.col("text")), 6).alias("ratio"))


_BYLEN = "CASE WHEN n < 500 THEN 0.7::DOUBLE WHEN n > 2000 THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END"
_BYTYPE = "CASE kind " + " ".join(f"WHEN {q.text(t)} THEN {f}::DOUBLE" for t, f in quality.TYPE_FACTORS.items()) + " ELSE 1.0::DOUBLE END"
STD = "f AS (SELECT *, " + f"{_BYLEN} * {_BYTYPE} AS factor FROM c), std AS (SELECT *, greatest(70.0::DOUBLE * factor, 50.0::DOUBLE) AS pass_threshold, " + ", ".join(
    f"greatest(trunc({base}::DOUBLE * factor)::INTEGER, {floor}) AS min_{k}" for k, (base, floor, _) in quality.MINIMA.items()
) + " FROM f)"


@query(f"WITH {SEC}, {CNT}, {STD} SELECT doc_id, round(factor, 6) AS factor, round(pass_threshold, 6) AS pass_threshold, " + ", ".join(f"min_{k}" for k in quality.MINIMA) + " FROM std")
def adjusted_standards(spark, sf_dir):
    std = quality.adjusted_standards(F.col("kind"), F.col("n"))
    return composed(spark, sf_dir).select("doc_id", *[(F.round(c, 6) if k in ("factor", "pass_threshold") else c).alias(k) for k, c in std.items()])


def _points(k: str) -> str:
    least = f"min_{k}" if k in quality.MINIMA else "1"
    ideal = f"({least} + {quality.MINIMA[k][2] if k in quality.MINIMA else 2})"
    return f"{quality.WEIGHTS[k]} * CASE WHEN n_{k} >= {ideal} THEN 100 WHEN n_{k} >= {least} THEN 100 * (0.6 + 0.4::DOUBLE * (n_{k} - {least}) / ({ideal} - {least})) ELSE 100::DOUBLE * n_{k} / {least} * 0.6 END"


_DENS = f"least(({' + '.join(_points(k) for k in NAMES)}) / {sum(quality.WEIGHTS.values()) * 100}::DOUBLE * 100, 100)"
_STRUCT = " + ".join(f"CASE WHEN length(sec_{k}) > 50 THEN {70 / 4 if k in quality.REQUIRED else 30 / 3}::DOUBLE ELSE 0 END" for k in NAMES)
_PRAC = "(" + " + ".join(f"least(len({q.found(f'sec_{k}', ACTIONABLE)}) * 10, 100)" for k in ("practical_tips", "actionable_advice", "methodologies")) + ") / 3::DOUBLE"
_PROF = f"(least(len({q.found('document', PROFESSIONAL)}) * 8, 80) + least(len({q.found('document', DEPTH)}) * 5, 20))"
SCORES = f"""{SEC}, {CNT}, {STD}, p AS (SELECT *, {_DENS} AS density, ({_LEN.format('length(document)')})::DOUBLE AS lp, {_STRUCT} AS structure, {_PRAC} AS practicality, {_PROF} AS professionalism FROM std),
w AS (SELECT *, least(lp * 0.25 + structure * 0.30 + practicality * 0.25 + professionalism * 0.20, 100) AS content_quality FROM p), o AS (SELECT *, density * 0.6 + content_quality * 0.4 AS overall FROM w)"""


def _score(name: str, column: str, cast: str = "DOUBLE"):
    @query(f"WITH {SCORES} SELECT doc_id, round({column}::DOUBLE, 4) AS {column} FROM o")
    def score(spark, sf_dir):
        return assessed(spark, sf_dir).select("doc_id", F.round(F.col(column).cast("double"), 4).alias(column))

    Q[name], SQL[name] = Q.pop("score"), SQL.pop("score")


for _name, _column in (("density_score", "density"), ("structure_score", "structure"), ("practicality", "practicality"), ("professionalism", "professionalism"), ("overall_quality", "overall")):
    _score(_name, _column)


@query(f"""WITH {SCORES} SELECT doc_id, round(CASE WHEN doc_id % 10 > 5 THEN density * 0.3 + content_quality * 0.3 + (doc_id % 101) * 0.4 ELSE density * 0.6 + content_quality * 0.4 END::DOUBLE, 4) AS overall FROM o""")
def overall_judged(spark, sf_dir):
    """The overall score with an outside judgement, made of the id, that is confident for some documents."""
    judged, confidence = (F.col("doc_id") % 101).cast("double"), (F.col("doc_id") % 10) / 10
    rows = assessed(spark, sf_dir)
    return rows.select("doc_id", F.round(quality.overall(F.col("density"), F.col("content_quality"), judged, confidence), 4).alias("overall"))


@query(f"WITH {SCORES} SELECT doc_id, CASE WHEN overall >= 90 THEN 'excellent' WHEN overall >= 80 THEN 'good' WHEN overall >= 70 THEN 'fair' WHEN overall >= 60 THEN 'poor' ELSE 'bad' END AS level FROM o")
def quality_level(spark, sf_dir):
    return assessed(spark, sf_dir).select("doc_id", "level")


def counts():
    return {k: F.col(f"n_{k}") for k in NAMES}


_SUG = q.keep(*[(f"n_{k} < min_{k}", f"'more_{k}'") for k in quality.MINIMA], *[(f"content_quality < 70 AND n_{k} < 2", f"'add_{k}'") for k in ("actionable_advice", "case_studies", "frameworks")])
_TOTAL = " + ".join(f"n_{k}" for k in NAMES)


@query(f"WITH {SCORES}, g AS (SELECT *, {_SUG} AS found FROM o) SELECT doc_id, {q.joined(f'CASE WHEN len(found) = 0 AND {_TOTAL} < 15 THEN {q.array(["raise_density"])} ELSE found END')} AS suggestions FROM g")
def improvement_suggestions(spark, sf_dir):
    std = {k: F.col(f"std_{k}") for k in ("factor", *[f"min_{k}" for k in quality.MINIMA])}
    return assessed(spark, sf_dir).select("doc_id", F.array_join(quality.suggestions(counts(), F.col("content_quality"), std), "|").alias("suggestions"))


_SPEC = q.keep(*[(f"n_{k} < {n}", f"'expand_{k}'") for k, n in quality.SPECIFIC.items()], ("length(document) < 2000", "'expand_whole'"), ("structure < 0.8", "'complete_structure'"))


@query(f"WITH {SCORES} SELECT doc_id, {q.joined(_SPEC)} AS improvements FROM o")
def specific_improvements(spark, sf_dir):
    return assessed(spark, sf_dir).select("doc_id", F.array_join(quality.specific_improvements(counts(), F.col("document_length"), F.col("structure")), "|").alias("improvements"))


_PRI = q.keep(*[(f"n_{k} < {least}", f"'{k}'") for k, least, _, _, _ in quality.PRIORITIES])


@query(f"WITH {SCORES} SELECT doc_id, {q.joined(_PRI)} AS areas FROM o")
def improvement_priorities(spark, sf_dir):
    return assessed(spark, sf_dir).select("doc_id", F.array_join(quality.priorities(counts()), "|").alias("areas"))


@query(f"WITH {SCORES} SELECT doc_id, {q.joined(q.keep(('n_core_concepts < 3', chr(39) + 'expand_concepts' + chr(39)), ('n_practical_tips < 5', chr(39) + 'add_tips' + chr(39)), ('n_insights < 3', chr(39) + 'deepen_insights' + chr(39))))} AS actions FROM o")
def specific_actions(spark, sf_dir):
    return assessed(spark, sf_dir).select("doc_id", F.array_join(quality.actions(counts()), "|").alias("actions"))


_TYPES = "CASE kind " + " ".join(f"WHEN {q.text(t)} THEN {q.array(x)}" for t, x in quality.TYPE_IMPROVEMENTS.items()) + " END"


@query(f"WITH {SCORES} SELECT doc_id, {q.joined(f'list_slice({_TYPES}, 1, CASE WHEN overall < 60 THEN 4 WHEN overall < 80 THEN 2 ELSE 1 END)', '; ')} AS prompt FROM o")
def type_improvements(spark, sf_dir):
    return assessed(spark, sf_dir).select("doc_id", quality.improvement_prompt(quality.type_improvements(F.col("kind"), F.col("overall"))).alias("prompt"))


@query(f"""WITH {SCORES} SELECT doc_id, overall >= 70 AS passed, CASE WHEN overall >= 90 THEN 'excellent' WHEN overall >= 80 THEN 'good' WHEN overall >= 70 THEN 'fair' WHEN overall >= 60 THEN 'poor' ELSE 'bad' END AS level,
{q.joined(_PRI)} AS priorities FROM o""")
def feedback_report(spark, sf_dir):
    rows = assessed(spark, sf_dir).select("doc_id", quality.feedback(F.col("overall"), counts(), F.col("kind")).alias("f"))
    return rows.select("doc_id", "f.passed", "f.level", F.array_join("f.priorities", "|").alias("priorities"))


# Supervision: the source as platform, the first word as title, empty authors for one language.
STANDARDS = supervise.Standards(
    template_terms=("the", "tion", "keit", "ción", "que", "ing", "ung", "los", "ment"), template_titles=("The", "De"), min_title=2, min_content=100, default_authors=("es",),
    platforms=(("src0", 3, 200, ("The", "De")), ("src1", 5, 1000, ("Of",)), ("src2", 2, 300, ("Ing", "Er"))),
)


def supervised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.col("source").alias("platform"), F.substring_index("text", " ", 1).alias("title"), F.col("lang").alias("author"), F.col("text").alias("content"))


_S = "r AS (SELECT doc_id, source AS platform, split_part(text, ' ', 1) AS title, lang AS author, text AS content FROM documents)"
_RATIO = f"len({q.found('lower(content) || chr(10) || lower(title)', STANDARDS.template_terms)}) / 9::DOUBLE"
_PICK = lambda i, d: "CASE platform " + " ".join(f"WHEN {q.text(p[0])} THEN {p[i]}" for p in STANDARDS.platforms) + f" ELSE {d} END"
_FORBID = "CASE platform " + " ".join(f"WHEN {q.text(p[0])} THEN list_contains({q.array(p[3])}, title)" for p in STANDARDS.platforms) + " ELSE FALSE END"
_PI = q.keep((f"length(title) < {_PICK(1, 2)}", "'title_short'"), (f"length(content) < {_PICK(2, 100)}", "'content_short'"), (_FORBID, "'title_forbidden'"))
SUP = f"""{_S}, u AS (SELECT *, {_RATIO} AS template, {_PI} AS found, len(list_distinct({q.ws_tokens('content')})) AS uw, {_FORBID} AS forbidden,
doc_id > min(doc_id) OVER (PARTITION BY md5(content)) AS dup, count(*) OVER (PARTITION BY md5(content)) AS copies FROM r),
z AS (SELECT *, list_concat(found, {q.keep(("template > 0.7", "'template'"), ("dup", "'duplicate'"), ("uw < 50", "'few_words'"), ("forbidden", "'forbidden_title'"), ("author = 'es'", "'default_author'"))}) AS issues,
round(greatest(0, 1 - (CASE WHEN template > 0.7 THEN 0.4::DOUBLE ELSE 0 END + len(found) * 0.1::DOUBLE + CASE WHEN dup THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN uw < 50 THEN 0.2::DOUBLE ELSE 0 END
+ CASE WHEN forbidden THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN author = 'es' THEN 0.1::DOUBLE ELSE 0 END)), 6) AS quality_score FROM u)"""


@query(f"WITH {SUP} SELECT doc_id, quality_score, {q.joined('issues')} AS issues FROM z")
def supervisor_score(spark, sf_dir):
    return supervise.scored(supervised(spark, sf_dir), STANDARDS).select("doc_id", "quality_score", F.array_join("issues", "|").alias("issues"))


@query(f"WITH {_S} SELECT doc_id, round({_RATIO}, 6) AS ratio FROM r")
def template_ratio(spark, sf_dir):
    return supervised(spark, sf_dir).select("doc_id", F.round(supervise.template_ratio(F.col("title"), F.col("content"), STANDARDS), 6).alias("ratio"))


@query(f"WITH {_S} SELECT doc_id, {q.joined(_PI)} AS issues FROM r")
def platform_standards(spark, sf_dir):
    return supervised(spark, sf_dir).select("doc_id", F.array_join(supervise.platform_issues(F.col("platform"), F.col("title"), F.col("content"), STANDARDS), "|").alias("issues"))


@query(f"WITH {SUP} SELECT doc_id, md5(content) AS content_hash, copies, dup AS is_duplicate FROM z")
def exact_duplicates(spark, sf_dir):
    return supervise.duplicates(supervised(spark, sf_dir)).select("doc_id", "content_hash", "copies", "is_duplicate")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supervised(spark, sf_dir).select("platform", F.when(F.length("content") >= 300, "success").otherwise("error").alias("status"), "title")


_TT = f"(title IN ('The', 'De') OR {q.any_in('title', STANDARDS.template_terms)})"
REP = f"{_S}, b AS (SELECT platform, length(content) >= 300 AS ok, {_TT} AS bad FROM r), rep AS (SELECT platform, count(*) AS total, count(*) AS success, count(*) FILTER (bad) AS quality_issues FROM b WHERE ok GROUP BY platform)"


@query(f"WITH {REP} SELECT * FROM rep")
def batch_report(spark, sf_dir):
    return supervise.batch_report(results(spark, sf_dir), STANDARDS)


@query(f"WITH {REP} SELECT platform, 'check_extractor' AS advice FROM rep WHERE quality_issues > 0.3 * success UNION ALL SELECT 'all', unnest(['check_templates', 'check_sources']) FROM (SELECT sum(quality_issues) AS n FROM rep) WHERE n > 0")
def batch_recommendations(spark, sf_dir):
    return supervise.recommendations(supervise.batch_report(results(spark, sf_dir), STANDARDS))


@query(f"WITH {REP} SELECT count(*) AS total, count(*) FILTER (ok) AS success, count(*) FILTER (ok AND bad) AS template_documents, count(*) - count(*) FILTER (ok AND bad) AS unique_documents, count(*) FILTER (ok AND bad) / count(*)::DOUBLE > 0.5 AS alert FROM b")
def batch_alert(spark, sf_dir):
    return supervise.batch_totals(results(spark, sf_dir), STANDARDS)


@query(f"WITH {SUP} SELECT platform, count(*) AS documents, count(*) FILTER (quality_score >= 0.6) AS good, round(count(*) FILTER (quality_score >= 0.6) / count(*)::DOUBLE, 6) AS rate, round(avg(quality_score), 6) AS mean_score FROM z GROUP BY platform")
def quality_summary(spark, sf_dir):
    return supervise.summary(supervise.scored(supervised(spark, sf_dir), STANDARDS))


@query("WITH g AS (SELECT count(*) AS n FROM documents GROUP BY md5(text) HAVING count(*) > 1) SELECT count(*) AS groups, coalesce(sum(n), 0)::BIGINT AS documents FROM g")
def duplicate_groups(spark, sf_dir):
    return supervise.duplicate_groups(supervise.duplicates(supervised(spark, sf_dir)))


@query(f"WITH {SUP}, x AS (SELECT unnest(issues) AS issue FROM z), c AS (SELECT issue, count(*) AS n FROM x GROUP BY issue) SELECT row_number() OVER (ORDER BY n DESC, issue) AS rank, issue, n FROM c ORDER BY n DESC, issue LIMIT 5")
def top_issues(spark, sf_dir):
    return supervise.top_issues(supervise.scored(supervised(spark, sf_dir), STANDARDS))


@query(f"WITH {SUP} SELECT quality, toxic, count(*) AS n, round(avg(quality_score), 6) AS mean_score FROM z JOIN labels ON z.doc_id = labels.doc_id GROUP BY quality, toxic")
def quality_vs_labels(spark, sf_dir):
    rows = supervise.scored(supervised(spark, sf_dir), STANDARDS).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")
    return rows.groupBy("quality", "toxic").agg(F.count("*").alias("n"), F.round(F.avg("quality_score"), 6).alias("mean_score"))


# Streams: the same tables as arriving files, read to their end.
def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return jobs.arriving(spark, sf_dir, f"{name}.parquet")


@query(f"SELECT doc_id, trim(text) <> '' AS filled, round(({_LEN.format('length(text)')})::DOUBLE, 6) AS points FROM documents")
def stream_pipeline(spark, sf_dir):
    rows = _stream(spark, sf_dir, "documents").select("doc_id", (F.trim("text") != "").alias("filled"), F.round(quality.length_score(F.length("text")), 6).alias("points"))
    return jobs.drained(rows, shared_path(spark, "stream-pipeline"))


@query("SELECT DISTINCT md5(text) AS content_hash FROM documents")
def stream_dedup(spark, sf_dir):
    return jobs.drained(jobs.deduplicated(_stream(spark, sf_dir, "documents")).select("content_hash"), shared_path(spark, "stream-dedup"))


@query("""WITH e AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type FROM events), m AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM events)
SELECT start, event_type, count(*) AS n FROM e, m WHERE start + INTERVAL 1 DAY <= mark GROUP BY start, event_type""")
def stream_ttl(spark, sf_dir):
    rows = jobs.windowed_counts(_stream(spark, sf_dir, "events"))
    return jobs.drained(rows, shared_path(spark, "stream-ttl")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH l AS (SELECT md5(user_id::VARCHAR) AS url_hash, max_by(event_id, (ts, event_id)) AS event_id, max(ts) AS cached_at FROM events GROUP BY 1)
SELECT url_hash, event_id, cached_at FROM l WHERE epoch_ms(cached_at) + 240 * 3600000 <= (SELECT epoch_ms(max(ts)) - 3600000 FROM events)""")
def stream_cache_ttl(spark, sf_dir):
    rows = _stream(spark, sf_dir, "events").select(F.md5(F.col("user_id").cast("string").cast("binary")).alias("url_hash"), "event_id", F.col("ts").alias("cached_at"))
    return jobs.drained(ttl.expirations(rows, 240 * 3_600_000), shared_path(spark, "stream-cache-ttl"))


@query(f"WITH {REP} SELECT * FROM rep")
def stream_supervisor(spark, sf_dir):
    rows = _stream(spark, sf_dir, "documents").select(F.col("source").alias("platform"), F.when(F.length("text") >= 300, "success").otherwise("error").alias("status"), F.substring_index("text", " ", 1).alias("title"))
    parts = jobs.drained_batches(rows, shared_path(spark, "stream-supervisor"), lambda b, n: jobs.supervised(b, n, STANDARDS), "platform string, total long, success long, quality_issues long")
    return parts.groupBy("platform").agg(F.sum("total").alias("total"), F.sum("success").alias("success"), F.sum("quality_issues").alias("quality_issues"))
