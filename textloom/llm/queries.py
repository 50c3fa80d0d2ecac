"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import alignment, decontamination, exact_dedup, fill_middle, fingerprints, language_id, near_dup, segmentation, sharding, substring_dedup, token_counts, toxicity, url_filter
from textloom.llm.common import id_remainder, table

#: Folder of the public tokenizers' files on every node, where it is not that of the installed package.
TOKENIZERS_CONF = "textloom.tokenizers.dir"
RULES = [
    url_filter.Rule("allow", "com", "/"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
]


def tokenizer(spark: SparkSession, name: str) -> str:
    folder = spark.conf.get(TOKENIZERS_CONF, None)
    return f"{folder.rstrip('/')}/{name}" if folder else public_tokenizers.path(name)


def op1_gumbel_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmentation.sample_segmentations(table(spark, sf_dir, "documents"), tokenizer(spark, "piece_bpe_32k.model"), k=2)


def op2_prefix_sum_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.prefix_sum_shards(table(spark, sf_dir, "documents"), shards=8)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_toxicity_counterfactual(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit_toxicity(docs, labels.where(id_remainder(F.col("doc_id"), 5) != 0))
    rows = toxicity.score_toxicity(docs, model)
    held_out = (id_remainder(F.col("doc_id"), 5) == 0).alias("held_out")
    return rows.select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_language_bitmask(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    filters = language_id.fit_filters(docs.where(id_remainder(F.col("doc_id"), 3) != 1))
    rows = language_id.identify(docs, filters)
    return rows.select("doc_id", (id_remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


def op5_url_link_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op6_exact_dedup_lsm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op7_bpe_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer(spark, "word_bpe_49k.json"))


def op8_decontamination_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op9_setsketch_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80).drop("key")


def op10_substring_dedup_lsm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.lower(F.hex("kept_sha256")).alias("kept_sha256"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"), seed=7, rate=100, spm=50)
    rebuilt = fill_middle.restored(F.col("output"), F.col("form"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(rebuilt, 256).alias("restored_sha256"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = tokenizer(spark, "byte_bpe_50k.json"), tokenizer(spark, "piece_bpe_32k.model")
    rows = alignment.align(table(spark, sf_dir, "documents"), *paths)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    rows = alignment.with_link_counts(rows.select(*[c for c in rows.columns if c != "groups"], digest))
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_one_permutation_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprints.against_next(table(spark, sf_dir, "documents"))
    prints = [F.lower(F.hex(c)).alias(c) for c in ("fingerprint", "edited_fingerprint")]
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), *prints, "near_edited", "near_next")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


#: CRC-32 over the hexadecimal digits of a text, byte by byte, with the table of the reflected polynomial EDB88320.
CRC32_SQL = """
crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),
      lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c
    FROM (SELECT range::BIGINT AS i FROM range(256)))),
hexed AS (SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents),
sized AS (
  SELECT doc_id, strlen(text)::BIGINT + 1 AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(h, '..'), lambda p: ('0x' || p)::BIGINT)),
      lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1])), 4294967295) AS text_crc32
  FROM hexed, crc_table)"""

ORACLES = {
    "op2_prefix_sum_sharding": f"""
WITH {CRC32_SQL},
placed AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id, text_crc32, size ROWS UNBOUNDED PRECEDING) - size AS bytes_before, sum(size) OVER () AS total
  FROM sized),
cut AS (SELECT *, ((2 * bytes_before + size) * 8 // (2 * total))::INTEGER AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM cut""",
    "op6_exact_dedup_lsm": r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept,
  sha256(norm) AS text_sha256
FROM n WINDOW g AS (PARTITION BY norm)""",
}


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLES["op8_decontamination_index"] = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item_id, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
g AS (
  SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
m AS (SELECT doc_id, i, g.n, item_id FROM g JOIN win ON g.n = win.n AND g.g = win.g),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM m GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN items ON d.doc_id = items.doc_id"""


_CUT = "array_to_string(list_slice(u, {}, {}), '')"
ORACLES["op11_fill_in_middle"] = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
    sha256('7:' || doc_id::VARCHAR) AS h FROM documents),
r AS (SELECT *, len(u)::BIGINT AS n, {", ".join(f"('0x' || substr(h, {8 * k + 1}, 8))::BIGINT AS h{k + 1}" for k in range(4))} FROM d),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
      WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM r),
p AS (SELECT *, {_CUT.format(1, "a")} AS p, {_CUT.format("a + 1", "b")} AS m, {_CUT.format("b + 1", "n")} AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p"""


_SPACED = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
ORACLES["op10_substring_dedup_lsm"] = rf"""
WITH d AS (SELECT doc_id, {_SPACED} AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 49), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first FROM win) WHERE doc_id > first),
gone AS (SELECT doc_id, list(DISTINCT p) AS p FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM rep) GROUP BY doc_id),
kept AS (
  SELECT d.doc_id, w, p, coalesce(string_agg(word, ' ' ORDER BY k), '') AS kept FROM d LEFT JOIN gone ON d.doc_id = gone.doc_id
  LEFT JOIN (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d) x
    ON d.doc_id = x.doc_id AND NOT coalesce(list_contains(p, k), false)
  GROUP BY d.doc_id, w, p)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(p), 0)::BIGINT AS n_removed, sha256(kept) AS kept_sha256 FROM kept"""


ORACLES["op9_setsketch_near_dup"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(reach.b) AS component_id, min(reach.b) = d.doc_id AS kept
FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN reach ON reach.a = d.doc_id GROUP BY d.doc_id, n.n"""


def _pagerank_sql(name: str, edges: str, seeds: str, damping: float = 0.85) -> str:
    """What each step adds, until it adds nothing to speak of, and the sums over all steps."""
    return f"""{name}_steps(step, host, added) AS (
  SELECT 0, host, {1 - damping}::DOUBLE / (SELECT count(*) FROM {seeds}) FROM {seeds}
  UNION ALL SELECT step + 1, dst, sum(weight * added) * {damping}::DOUBLE FROM {name}_steps JOIN {edges} ON src = host GROUP BY step + 1, dst
  HAVING sum(weight * added) > 1e-30),
{name} AS (SELECT host, sum(added) AS score FROM {name}_steps GROUP BY host)"""


def _rule_sql() -> tuple[str, str]:
    fits = [(r, f"((host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}'))") for r in sorted(RULES, key=lambda r: -len(r.text))]
    return tuple("CASE " + " ".join(f"WHEN {c} THEN '{getattr(r, what)}'" for r, c in fits) + " END" for what in ("text", "verdict"))


_RULE, _VERDICT = _rule_sql()
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLES["op5_url_link_propagation"] = rf"""
WITH RECURSIVE p AS (
  SELECT page_id, html, {_LOWER.format(r"regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")} AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
j AS (SELECT *, {_RULE} AS rule, {_VERDICT} AS by_rule FROM p),
l AS (SELECT host AS src, unnest(regexp_extract_all(html, '(?i)href\s*=\s*["'']((?:https?:)?//[^"''>\s]+)', 1)) AS link FROM p WHERE host <> ''),
c AS (SELECT src, {_LOWER.format("regexp_extract(link, '//([^/?#]*)', 1)")} AS dst FROM l),
n AS (SELECT src, dst, count(*) AS n FROM c WHERE dst <> '' AND dst <> src GROUP BY ALL),
e AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS weight FROM n),
b AS (SELECT dst AS src, src AS dst, weight / sum(weight) OVER (PARTITION BY dst) AS weight FROM e),
good AS (SELECT DISTINCT host FROM j WHERE by_rule = 'allow' AND host <> ''),
bad AS (SELECT DISTINCT host FROM j WHERE by_rule = 'block' AND host <> ''),
{_pagerank_sql("t", "e", "good")},
{_pagerank_sql("d", "b", "bad")}
SELECT page_id, j.host, path, rule, coalesce(by_rule, CASE WHEN coalesce(d.score, 0) > coalesce(t.score, 0) * {1 + url_filter.MARGIN} THEN 'block' ELSE 'allow' END) AS verdict
FROM j LEFT JOIN t ON j.host = t.host LEFT JOIN d ON j.host = d.host"""


def oracles() -> dict[str, str]:
    return dict(ORACLES)
