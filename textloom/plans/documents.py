"""Registered queries over documents: keywords, analysis, graph and rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom import api
from textloom.functions import context, lexicons
from textloom.operators import analysis, graph, keywords, render
from textloom.plans import sqltext as q

LEX = lexicons.LATIN
KW = q.keywords()


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return rows.withColumn("title", F.substring(F.substring_index("text", "\n", 1), 1, 60))


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords.keyword_arrays(docs(spark, sf_dir), LEX)


def flat(c) -> Column:
    return F.array_join(c, "|")


Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {KW} SELECT doc_id, rank, word, n FROM top")
def keyword_top20(spark, sf_dir):
    return keywords.top_words(docs(spark, sf_dir), keywords.keyword_rule(LEX))


_STOP = ", ".join(map(q.text, LEX.stopwords))


@query(f"WITH {KW}, c AS (SELECT doc_id, word, count(*) AS n, min(pos) AS pos FROM tok WHERE length(word) >= 2 AND word NOT IN ({_STOP}) GROUP BY ALL) "
       "SELECT doc_id, rank, word, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, pos) AS rank FROM c) WHERE rank <= 20")
def keyword_tf_fallback(spark, sf_dir):
    return keywords.top_words(docs(spark, sf_dir), keywords.plain_rule(LEX))


@query(f"""WITH {KW}, df AS (SELECT word, count(*) AS df FROM cnt GROUP BY word), tot AS (SELECT doc_id, sum(n) AS total FROM cnt GROUP BY doc_id),
s AS (SELECT c.doc_id, c.word, pos, round(n / total::DOUBLE * ln((SELECT count(*) FROM documents)::DOUBLE / df), 9) AS score FROM cnt c JOIN df ON c.word = df.word JOIN tot ON c.doc_id = tot.doc_id)
SELECT doc_id, rank, word, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS rank FROM s) WHERE rank <= 30""")
def keyword_tfidf(spark, sf_dir):
    rows = docs(spark, sf_dir)
    return keywords.tfidf(rows, rows.count(), LEX).withColumn("score", F.round("score", 6))


@query()
def keyword_textrank(spark, sf_dir):
    return keywords.textrank(docs(spark, sf_dir), LEX)


@query(f"WITH {KW} SELECT doc_id, " + ", ".join(f"{q.joined(q.in_group(LEX.groups, n))} AS g_{n}" for n in ("core", "method", "tool", "application")) + " FROM kw")
def keyword_groups(spark, sf_dir):
    return ranked(spark, sf_dir).select("doc_id", *[flat(c).alias(f"g_{n}") for n, c in keywords.grouped(F.col("keywords"), LEX).items()])


_EVERY = [t for _, ts in LEX.overlapping_groups for t in ts]
_OVER = {n: f"CASE WHEN dom <> 'general' THEN list_filter(kw, lambda k: {q.any_in('k', ts)}) ELSE []::VARCHAR[] END" for n, ts in LEX.overlapping_groups}
_OVER[LEX.remainder] = f"CASE WHEN dom <> 'general' THEN list_filter(kw, lambda k: NOT {q.any_in('k', _EVERY)}) ELSE kw END"
DOM = f"dom AS (SELECT *, {q.domain_kg()[0]} AS dom, {q.domain_kg()[1]} AS dom_score FROM kw)"


def with_domain(spark, sf_dir):
    return ranked(spark, sf_dir).withColumn("dom", analysis.keyword_domain(F.col("keywords"), LEX))


@query(f"WITH {KW}, {DOM} SELECT doc_id, " + ", ".join(f"{q.joined(x)} AS g_{n}" for n, x in _OVER.items()) + " FROM dom")
def keyword_group_overlap(spark, sf_dir):
    groups = keywords.overlapping(F.col("keywords"), LEX, F.col("dom.domain") != "general")
    return with_domain(spark, sf_dir).select("doc_id", *[flat(c).alias(f"g_{n}") for n, c in groups.items()])


@query(f"WITH {KW} SELECT doc_id, round(len(kw) / greatest(len({q.ws_tokens('text')}), 1)::DOUBLE * 100, 6) AS density FROM kw")
def keyword_density(spark, sf_dir):
    return ranked(spark, sf_dir).select("doc_id", F.round(keywords.density(F.col("keywords"), F.col("text")), 6).alias("density"))


@query(f"SELECT doc_id, len(list_distinct({q.ws_tokens('text')}))::INTEGER AS n FROM documents")
def unique_tokens(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", keywords.unique_tokens(F.col("text")).alias("n"))


@query(f"WITH {KW}, {DOM} SELECT doc_id, dom AS domain, round(dom_score, 6) AS score FROM dom")
def domain_kg(spark, sf_dir):
    return with_domain(spark, sf_dir).select("doc_id", F.col("dom.domain").alias("domain"), F.round("dom.score", 6).alias("score"))


_W = [(n, f"({w}::DOUBLE * (len({q.found('ev', ts)}) + len(list_filter({q.array(ts)}, lambda t: contains(ev, t) AND contains(st, t)))))") for n, w, ts in LEX.weighted_domains]
_WN, _WS = q.best(_W)


@query(f"WITH {KW}, t AS (SELECT doc_id, lower(text || ' ' || array_to_string(kw, ' ')) AS ev, lower(left(text, 100)) AS st FROM kw) SELECT doc_id, {_WN} AS domain, round(greatest({_WS}, 0), 6) AS score FROM t")
def domain_weighted(spark, sf_dir):
    rows = ranked(spark, sf_dir).withColumn("dom", analysis.weighted_domain(F.col("text"), F.col("keywords"), LEX))
    return rows.select("doc_id", F.col("dom.domain").alias("domain"), F.round("dom.score", 6).alias("score"))


ENT = {n: q.in_group(LEX.entities, n) for n, _ in LEX.entities}


@query(f"WITH {KW} SELECT doc_id, '' AS e_person, " + ", ".join(f"{q.joined(x)} AS e_{n}" for n, x in ENT.items()) + " FROM kw")
def entities_kg(spark, sf_dir):
    return ranked(spark, sf_dir).select("doc_id", *[flat(c).alias(f"e_{n}") for n, c in analysis.keyword_entities(F.col("keywords"), LEX).items()])


def _ordered_distinct(x: str, cap: int) -> str:
    return f"list_slice(list_filter({x}, lambda v, i: list_position({x}, v) = i), 1, {cap})"


_PAT = {n: f"list_filter(kw, lambda k: len({q.either('k', ts)}) > 0)" for n, ts in LEX.entity_patterns}
_PAT["person"] = f"list_concat({_PAT['person']}, list_filter(regexp_extract_all(text, '{LEX.person_pattern}'), lambda x: length(x) > 1))"
_PAT["organization"] = f"list_concat({_PAT['organization']}, list_filter(regexp_extract_all(text, '{LEX.organization_pattern}'), lambda x: length(x) > 2))"


@query(f"WITH {KW}, p AS (SELECT doc_id, " + ", ".join(f"{x} AS {n}" for n, x in _PAT.items()) + " FROM kw) SELECT doc_id, " + ", ".join(f"{q.joined(_ordered_distinct(n, 10))} AS e_{n}" for n in _PAT) + " FROM p")
def entities_pattern(spark, sf_dir):
    found = analysis.pattern_entities(F.col("text"), F.col("keywords"), LEX)
    return ranked(spark, sf_dir).select("doc_id", *[flat(c).alias(f"e_{n}") for n, c in found.items()])


PHR = f"list_slice(list_filter({q.sentences(LEX.delimiters)}, lambda s: length(s) BETWEEN 10 AND 100 AND {q.hits('s')} >= 2), 1, 10)"


@query(f"WITH {KW} SELECT doc_id, {q.joined(PHR)} AS phrases FROM kw")
def key_phrases_kg(spark, sf_dir):
    return ranked(spark, sf_dir).select("doc_id", flat(analysis.key_phrases(F.col("text"), F.col("keywords"), LEX)).alias("phrases"))


@query(f"""WITH {KW}, s AS (SELECT doc_id, list_filter({q.sentences(LEX.delimiters_rich)}, lambda s: length(s) BETWEEN 10 AND 100 AND {q.hits('s')} >= 1) AS s FROM kw),
e AS (SELECT doc_id, x, min(i) AS i FROM (SELECT doc_id, unnest(s) AS x, unnest(range(len(s))) AS i FROM s) GROUP BY doc_id, x),
r AS (SELECT doc_id, string_agg(x, '|' ORDER BY rn) AS p FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(x), i) AS rn FROM e) WHERE rn <= 15 GROUP BY doc_id)
SELECT kw.doc_id, coalesce(p, '') AS phrases FROM kw LEFT JOIN r ON kw.doc_id = r.doc_id""")
def key_phrases_rich(spark, sf_dir):
    return ranked(spark, sf_dir).select("doc_id", flat(analysis.short_phrases(F.col("text"), F.col("keywords"), LEX)).alias("phrases"))


_T = LEX.texts
THEMES = (
    f"list_slice(list_concat(list_filter([CASE WHEN title <> '' AND title <> {q.text(LEX.default_title)} THEN title || {q.text(_T['title_theme'])} END, "
    + "CASE dom " + " ".join(f"WHEN {q.text(n)} THEN {q.text(t + _T['domain_theme'])}" for n, t in LEX.domain_themes) + " END], lambda v: v IS NOT NULL), "
    + f"list_transform(list_slice(kw, 1, 3), lambda k: k || {q.text(_T['keyword_theme'])})), 1, 5)"
)


@query(f"WITH {KW}, {DOM} SELECT doc_id, {q.joined(THEMES)} AS themes FROM dom")
def themes_kg(spark, sf_dir):
    return with_domain(spark, sf_dir).select("doc_id", flat(analysis.themes(F.col("title"), F.col("keywords"), F.col("dom.domain"), LEX)).alias("themes"))


_GT = q.keep(*[(f"len({x}) >= 2", f"{q.text(n + LEX.colon)} || array_to_string(list_slice({x}, 1, 5), ', ')") for n, x in _OVER.items()])
_RT = q.keep(*[(f"len({q.found('text', ts)}) > 0", f"{q.text(n.replace('_', '') + _T['relation_theme'])} || array_to_string(list_slice({q.found('text', ts)}, 1, 3), ', ')") for n, ts in LEX.relations])


@query(f"WITH {KW}, {DOM}, t AS (SELECT doc_id, {_GT} AS g, {_RT} AS r FROM dom) SELECT doc_id, {q.joined('list_slice(CASE WHEN len(g) < 3 THEN list_concat(g, r) ELSE g END, 1, 8)')} AS themes FROM t")
def themes_rich(spark, sf_dir):
    groups = keywords.overlapping(F.col("keywords"), LEX, F.col("dom.domain") != "general")
    return with_domain(spark, sf_dir).select("doc_id", flat(analysis.rich_themes(F.col("text"), groups, LEX)).alias("themes"))


def _fill(template: str, *values: str) -> str:
    parts = template.split("{}")
    return " || ".join([q.text(parts[0]), *[x for v, p in zip(values, parts[1:], strict=True) for x in (v, q.text(p))]])


_AROUND = _fill(_T["around"], "title", "array_to_string(list_slice(kw, 1, 5), ', ')")


@query(f"WITH {KW} SELECT doc_id, CASE WHEN length(text) < 50 THEN {_fill(_T['brief'], 'title')} WHEN len(kw) > 0 THEN {_AROUND} ELSE {_fill(_T['about'], 'title')} END AS summary FROM kw")
def summary_template(spark, sf_dir):
    return ranked(spark, sf_dir).select("doc_id", analysis.template_summary(F.col("title"), F.col("text"), F.col("keywords"), LEX).alias("summary"))


@query(rf"""WITH {KW}, {DOM}, t AS (SELECT *, {THEMES} AS th, list_slice(kw, 1, 10) AS k10, regexp_split_to_array(text, '[.!?;\n]') AS raw FROM dom),
w AS (SELECT *, flatten(list_transform(list_filter(th, lambda x: contains(x, ':')), lambda x: string_split(split_part(x, ':', 2), ','))) AS tw FROM t),
s AS (SELECT doc_id, unnest(raw) AS s, unnest(range(len(raw))) AS i, k10, tw FROM w),
p AS (SELECT doc_id, i, {q.strip('s')} AS s, {q.hits('s', 'k10')} + CASE WHEN length(s) BETWEEN 20 AND 100 THEN 1 ELSE 0 END + 0.5::DOUBLE * len(list_filter(tw, lambda x: contains(s, x))) AS points FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY points DESC, i) AS rn FROM p WHERE length(s) >= 10),
j AS (SELECT doc_id, string_agg(s, '.' ORDER BY rn) AS best FROM r WHERE rn <= 3 AND points > 0 GROUP BY doc_id)
SELECT t.doc_id, coalesce(CASE WHEN length(best) > 200 THEN left(best, 200) || '...' ELSE best END, {_AROUND}) AS summary FROM t LEFT JOIN j ON t.doc_id = j.doc_id""")
def summary_extractive(spark, sf_dir):
    rows = with_domain(spark, sf_dir).withColumn("th", analysis.themes(F.col("title"), F.col("keywords"), F.col("dom.domain"), LEX))
    return rows.select("doc_id", analysis.extractive_summary(F.col("title"), F.col("text"), F.col("keywords"), F.col("th"), LEX).alias("summary"))


@query(f"""WITH {KW}, p AS (SELECT a.doc_id, a.word AS source, b.word AS target, row_number() OVER (PARTITION BY a.doc_id ORDER BY a.rank, b.rank) - 1 AS ord
FROM top a JOIN top b ON a.doc_id = b.doc_id AND a.rank < b.rank AND a.rank <= 5 AND b.rank <= 6) SELECT doc_id, ord, source, target, 'related' AS relationship, 0.7::DOUBLE AS strength FROM p WHERE ord < 10""")
def concept_edges(spark, sf_dir):
    rows = ranked(spark, sf_dir).select("doc_id", F.posexplode(graph.concept_edges(F.col("keywords"))).alias("ord", "edge"))
    return rows.select("doc_id", "ord", "edge.*")


_ELIST = "flatten([" + ", ".join(f"list_transform({x}, lambda e, i: {{'t': {t}, 'i': i, 'e': e}})" for t, x in enumerate(ENT.values(), 1)) + "])"


@query(f"""WITH {KW}, u AS (SELECT doc_id, unnest({_ELIST}) AS x FROM kw), v AS (SELECT doc_id, x.t AS t, x.i AS i, x.e AS e FROM u),
p AS (SELECT a.doc_id, a.e AS source, b.e AS target, row_number() OVER (PARTITION BY a.doc_id ORDER BY a.t, a.i, b.t, b.i) - 1 AS ord FROM v a JOIN v b ON a.doc_id = b.doc_id AND a.t <> b.t AND b.i <= 2)
SELECT doc_id, 'entity' AS kind, ord, source, target, 'associated' AS relationship, 0.5::DOUBLE AS strength FROM p WHERE ord < 15""")
def entity_edges(spark, sf_dir):
    return graph.edge_table(ranked(spark, sf_dir), "entity", graph.entity_edges(analysis.keyword_entities(F.col("keywords"), LEX)))


@query(f"""WITH {KW}, m AS (SELECT doc_id, unnest(m) AS source, unnest(range(len(m))) AS i FROM (SELECT doc_id, {q.in_group(LEX.groups, 'method')} AS m FROM kw)),
a AS (SELECT doc_id, unnest(a) AS target, unnest(range(len(a))) AS j FROM (SELECT doc_id, {q.in_group(LEX.groups, 'application')} AS a FROM kw)),
p AS (SELECT m.doc_id, source, target, row_number() OVER (PARTITION BY m.doc_id ORDER BY i, j) - 1 AS ord FROM m JOIN a ON m.doc_id = a.doc_id)
SELECT doc_id, 'function' AS kind, ord, source, target, 'enables' AS relationship, 0.8::DOUBLE AS strength FROM p WHERE ord < 10""")
def functional_edges(spark, sf_dir):
    groups = keywords.grouped(F.col("keywords"), LEX)
    return graph.edge_table(ranked(spark, sf_dir), "function", graph.functional_edges(groups["method"], groups["application"]))


@query(f"WITH {KW} SELECT doc_id, kw[1] AS root, array_to_string(list_slice(kw, 2, 4), '|') AS branches FROM kw WHERE len(kw) > 0")
def hierarchy(spark, sf_dir):
    rows = ranked(spark, sf_dir).select("doc_id", F.explode(graph.hierarchy(F.col("keywords"))).alias("root", "branches"))
    return rows.select("doc_id", "root", flat("branches").alias("branches"))


@query(f"WITH {KW} SELECT doc_id, kw[2] AS node, kw[1] AS needs FROM kw WHERE len(kw) >= 3 UNION ALL SELECT doc_id, kw[3], kw[1] || '|' || kw[2] FROM kw WHERE len(kw) >= 3")
def dependency(spark, sf_dir):
    rows = ranked(spark, sf_dir).select("doc_id", F.explode(graph.dependencies(F.col("keywords"))).alias("d"))
    return rows.select("doc_id", "d.node", flat("d.needs").alias("needs"))


@query(f"WITH {KW} SELECT doc_id, " + ", ".join(f"{q.joined(f'list_slice(kw, {a}, {a + 4})')} AS {n}" for n, a in (("primary", 1), ("secondary", 6), ("tertiary", 11))).replace(" AS primary", ' AS "primary"') + " FROM kw")
def concept_tiers(spark, sf_dir):
    return ranked(spark, sf_dir).select("doc_id", *[flat(c).alias(n) for n, c in graph.tiers(F.col("keywords")).items()])


_NE = " + ".join(f"len({x})" for x in ENT.values())
_HARD = f"len(list_filter(kw, lambda k: {q.any_in('k', LEX.complexity)}))"


@query(f"WITH {KW} SELECT doc_id, CASE WHEN {_HARD} > 3 OR {_NE} > 15 THEN 'advanced' WHEN {_HARD} > 1 OR {_NE} > 8 THEN 'intermediate' ELSE 'beginner' END AS difficulty FROM kw")
def difficulty(spark, sf_dir):
    entities = analysis.keyword_entities(F.col("keywords"), LEX)
    n = sum((F.size(x) for x in entities.values()), F.lit(0))
    return ranked(spark, sf_dir).select("doc_id", graph.difficulty(F.col("keywords"), n, LEX).alias("difficulty"))


@query("""SELECT doc_id, CASE WHEN length(text) < 300 THEN '< 1分钟' WHEN length(text) < 18000 THEN (length(text) // 300)::VARCHAR || '分钟'
ELSE (length(text) // 18000)::VARCHAR || '小时' || ((length(text) % 18000) // 300)::VARCHAR || '分钟' END AS reading_time FROM documents""")
def reading_time(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", graph.reading_time(F.length("text")).alias("reading_time"))


_DIMS = ", ".join("(" + ", ".join(map(q.text, r)) + ")" for r in graph.DOMAIN_DIMS)


@query(f"""WITH {KW}, {DOM}, dims(dim, prerequisite, metric, challenge, resource) AS (VALUES {_DIMS})
SELECT doc_id, dom AS domain, prerequisite, metric, challenge, resource FROM dom JOIN dims ON dim = CASE WHEN dom IN (SELECT dim FROM dims) THEN dom ELSE 'general' END""")
def domain_dims(spark, sf_dir):
    rows = with_domain(spark, sf_dir).select("doc_id", F.col("dom.domain").alias("domain"))
    return graph.domain_dims(rows)


def _each(words: str, n: int, patterns: list[str], cap: int) -> str:
    made = ", ".join(_fill(p, "k") for p in patterns)
    return f"list_slice(flatten(list_transform(list_slice({words}, 1, {n}), lambda k: [{made}])), 1, {cap})"


_PATH = {
    "practical_uses": _each("kw", 5, ["Use of {}", "Practice of {}"], 8),
    "use_cases": f"list_slice(list_concat({_each(ENT['tool'], 3, ['Work with {}'], 3)}, {_each(ENT['skill'], 3, ['Apply {}'], 3)}), 1, 6)",
    "methods": _each("kw", 4, ["Plan for {}", "Review of {}"], 6),
    "sequence": q.keep(("len(kw) > 0", "'Basics of ' || kw[1]"), ("len(kw) > 1", "'Methods of ' || kw[2]"), ("len(kw) > 2", "'Practice of ' || kw[3]"), ("TRUE", "'Put together'")),
    "beginner": "list_slice(kw, 1, 2)", "intermediate": "list_slice(kw, 3, 4)", "advanced": "list_slice(kw, 5, 6)",
    "milestones": "list_transform(list_slice(kw, 1, 4), lambda k, i: 'Stage ' || i::VARCHAR || ': ' || k)",
    "next_steps": _each("kw", 3, ["More on {}", "Try {}"], 6), "advanced_topics": _each("kw", 4, ["Theory of {}", "Limits of {}"], 6),
}


@query(f"WITH {KW} SELECT doc_id, " + ", ".join(f"{q.joined(x)} AS p_{n}" for n, x in _PATH.items()) + " FROM kw")
def learning_path(spark, sf_dir):
    entities = analysis.keyword_entities(F.col("keywords"), LEX)
    path = graph.learning_path(F.col("keywords"), entities["tool"], entities["skill"])
    return ranked(spark, sf_dir).select("doc_id", *[flat(c).alias(f"p_{n}") for n, c in path.items()])


@query()
def rich_analysis(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", "title", F.lit("").alias("description"), F.col("text").alias("content"))
    return api.richly_analysed(rows, LEX).select("doc_id", F.to_json("analysis").alias("analysis"))


def _graphs(spark, sf_dir):
    return api.with_graph(api.analysed(docs(spark, sf_dir), LEX), F.col("source"), LEX)


@query()
def graph_struct(spark, sf_dir):
    return _graphs(spark, sf_dir).select("doc_id", F.to_json("graph").alias("graph"))


@query()
def render_markdown(spark, sf_dir):
    return _graphs(spark, sf_dir).select("doc_id", render.markdown(F.col("graph"), F.lit("2024-01-01 00:00:00")).alias("document"))


_CT = [rf"@([^#\n@]+)", r"#([^#\n@]+)#?", '"([^"]+)"', r"：(.+?)(?:\n|$)"]
_CH = [f"{q.strip(f'regexp_extract_all(text, {q.text(p)}, 1)[1]')}" for p in _CT]
_CA = [f"{q.strip(f'regexp_extract_all(text, {q.text(p)}, 1)[1]')}" for p in context.AUTHOR_PATTERNS]
CTX_TITLE = "coalesce(" + ", ".join(f"CASE WHEN length({h}) > 5 AND NOT {q.any_in(f'lower({h})', context.LINK_TERMS)} THEN {h} END" for h in _CH) + ")"
CTX_AUTHOR = "coalesce(" + ", ".join(f"CASE WHEN length({h}) > 2 THEN {h} END" for h in _CA) + ")"


@query(f"SELECT doc_id, {CTX_TITLE} AS title, {CTX_AUTHOR} AS author FROM documents")
def context_extract(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", context.context_title(F.col("text")).alias("title"), context.context_author(F.col("text")).alias("author"))


@query(r"""SELECT doc_id, kind, value FROM (SELECT doc_id, 'mention' AS kind, unnest(regexp_extract_all(text, '@([\p{L}\p{N}._]+)', 1)) AS value FROM documents
UNION ALL SELECT doc_id, 'hashtag', unnest(regexp_extract_all(text, '#([\p{L}\p{N}_]+)', 1)) FROM documents)""")
def mentions_hashtags(spark, sf_dir):
    rows = docs(spark, sf_dir)
    one = lambda kind, c: rows.select("doc_id", F.lit(kind).alias("kind"), F.explode(c).alias("value"))
    return one("mention", context.mentions(F.col("text"))).unionByName(one("hashtag", context.hashtags(F.col("text"))))


@query(f"""WITH t AS (SELECT doc_id, left(split_part(text, chr(10), 1), 60) AS title, text FROM documents)
SELECT doc_id, CASE WHEN {q.any_in('lower(title)', ('the ', 'keit'))} OR text = '' THEN coalesce({CTX_TITLE}, title) ELSE title END AS title FROM t""")
def overlay(spark, sf_dir):
    poor = context.low_quality(F.col("title"), F.col("text"), terms=("the ", "keit"))
    return docs(spark, sf_dir).select("doc_id", context.overlay(F.col("title"), context.context_title(F.col("text")), poor).alias("title"))

