"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns."""

import pytest
from public_tokenizers import path as tokenizer
from pyspark.sql import functions as F

from textloom.llm import decontamination, exact_dedup, language_id, near_dup, segmentation, sharding, substring_dedup, token_counts, toxicity, url_filter

LONG = "the quick brown fox " * 12_000
ROWS = [(1, "one two three"), (2, None), (3, ""), (None, "one two three"), (4, LONG), (5, "one two three"), (5, "one two three"), (6, "   \n\t "), (7, "żółć 日本語 👍🏽"), (8, LONG), (None, None)]
CLASHES = ["row", "key", "digest", "norm", "part", "shard", "size", "offset", "host", "segment", "doc_no", "n", "c", "label", "marks", "sha", "first", "members", "index", "place", "total", "score", "y", "lang_pred", "ids", "bucket", "a.b"]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("doc_id", "text", *[F.lit(7).alias(c) for c in CLASHES])


def ops(spark):
    grams = language_id.LanguageFilters.fit({"en": language_id.ngram_codes("the quick brown fox one two three"), "pl": language_id.ngram_codes("żółć")})
    bench = spark.createDataFrame([(1, "quick brown fox the quick brown fox the quick brown fox"), (2, None), (None, "one two"), (3, "")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1), (4, 0), (None, 1), (5, None)], "doc_id long, toxic int")

    def toxic(d):
        return toxicity.score_toxicity(d, toxicity.fit_toxicity(d, labels))

    return {
        "shards": sharding.prefix_sum_shards,
        "exact": exact_dedup.exact_dedup,
        "tokens": lambda d: token_counts.count_tokens(d, tokenizer("word_bpe_49k.json")),
        "decontamination": lambda d: decontamination.contamination(d, bench),
        "near": near_dup.near_duplicates,
        "repeats": substring_dedup.remove_repeats,
        "repeats with text": lambda d: substring_dedup.remove_repeats(d, with_text=True),
        "language": lambda d: language_id.identify(d, grams),
        "toxicity": toxic,
        "language fit": lambda d: language_id.identify(d, language_id.fit_filters(d.withColumn("lang", F.when(F.col("doc_id") < 5, "en")))),
    }


@pytest.mark.parametrize("name", ["shards", "exact", "tokens", "decontamination", "near", "repeats", "repeats with text", "language", "toxicity", "language fit"])
def test_one_row_for_each_row(spark, name):
    op = ops(spark)[name]
    got = op(frame(spark, ROWS)).select("doc_id").collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((i is None, i or 0) for i, _ in ROWS)
    assert op(frame(spark, [])).collect() == []


def test_exact_groups(spark):
    got = {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(frame(spark, ROWS)).collect()}
    assert (1, 1, 4) in got and (None, 1, 4) in got and (5, 1, 4) in got
    assert (2, 2, 3) in got and (3, 2, 3) in got  # null and empty are equal, and equal to the null id's null text
    assert (6, 6, 1) in got and (8, 4, 2) in got
    again = exact_dedup.exact_dedup(frame(spark, [(9, "x"), (9, "x")])).collect()
    assert sorted(r.kept for r in again) == [False, True]


def test_exact_verifies_bytes_when_digests_collide(spark):
    rows = [(i, t) for i, t in enumerate(["aa", "ab", "aa", "b", "ab", "c"])]
    weak = lambda norm: F.substring(norm, 1, 1).cast("binary")
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(frame(spark, rows), digest=weak).collect()}
    assert got == {0: (0, 2, True), 2: (0, 2, False), 1: (1, 2, True), 4: (1, 2, False), 3: (3, 1, True), 5: (5, 1, True)}


def test_near_groups(spark):
    got = {(r.doc_id, r.component_id, r.kept) for r in near_dup.near_duplicates(frame(spark, ROWS)).collect()}
    assert (1, 1, True) in got and (5, 1, False) in got and (8, 4, False) in got
    assert (2, 2, True) in got and (6, 6, True) in got and (None, None, True) in got


def test_repeats_of_long_texts(spark):
    got = [(r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(frame(spark, ROWS)).collect()]
    assert (4, 48000, 0) in got and (8, 48000, 48000) in got and (5, 3, 0) in got and (2, 0, 0) in got


def test_contamination_of_edges(spark):
    bench = spark.createDataFrame([(10, "one two"), (9, "three"), (None, "one"), (2, None)], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontamination.contamination(frame(spark, [r for r in ROWS if r[0]]), bench).collect()}
    assert got[1] == (3, 3, ["10", "9"]) and got[2] == (0, 0, []) and got[4] == (48000, 0, [])
    none = decontamination.contamination(frame(spark, ROWS), bench.where("false")).where("n_hit > 0")
    assert none.count() == 0


def test_segmentation_of_edges(spark):
    got = segmentation.sample_segmentations(frame(spark, ROWS), tokenizer("piece_bpe_32k.model"), k=3).collect()
    assert all(r.decoded for r in got)
    of = lambda i: [(r["rank"], r.n_pieces) for r in got if r.doc_id == i]
    assert of(2) == of(3) == [(1, 0)] and len(of(1)) == 3 and len(of(5)) == 6 and len(of(4)) == len(of(8)) == 3
    assert segmentation.sample_segmentations(frame(spark, []), tokenizer("piece_bpe_32k.model")).collect() == []


def test_urls_of_edges(spark):
    rules = [url_filter.Rule("allow", "com", "/"), url_filter.Rule("block", "bad.com", "/x")]
    rows = [(1, "http://A.Com/p", None), (2, None, "<a href='http://x.com'>"), (3, "nothing", ""), (4, "http://sub.bad.com/x?y#z", ""), (4, "http://sub.bad.com/x?y#z", ""), (5, "http://com", ""), (6, "http://notcom/", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("trust", F.lit(1))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, rules).collect()}
    assert got[1] == ("a.com", "/p", "com/", "allow") and got[2] == ("", "", None, "allow") and got[3] == ("", "", None, "allow")
    assert got[4] == ("sub.bad.com", "/x", "bad.com/x", "block") and got[5] == ("com", "", None, "allow") and got[6] == ("notcom", "/", None, "allow")
    assert url_filter.judge_urls(pages.where("false"), rules).collect() == []


def test_values_of_null_empty_and_repeated_rows(spark):
    all_of = lambda name, *cols: {(r.doc_id, *(r[c] for c in cols)) for r in ops(spark)[name](frame(spark, ROWS)).collect()}
    tokens = all_of("tokens", "n_bytes", "n_tokens", "over_limit")
    assert {(2, 0, 0, False), (3, 0, 0, False), (None, 0, 0, False), (5, 13, 3, False), (6, 6, 0, False)} <= tokens
    assert (4, 240_000, 48_000, True) in tokens and (8, 240_000, 48_000, True) in tokens
    languages = all_of("language", "lang_pred")
    assert {(2, "und"), (3, "und"), (6, "und"), (None, "und"), (1, "en"), (5, "en"), (4, "en")} <= languages
    scores = all_of("toxicity", "score")
    of = lambda i: {s for d, s in scores if d == i}
    assert len(of(5)) == 1 and of(2) == of(3) == of(6) and of(4) == of(8) and all(0 <= s <= 1 for _, s in scores)
    hits = {(r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in ops(spark)["decontamination"](frame(spark, ROWS)).collect()}
    assert {(2, 0, 0, ()), (3, 0, 0, ()), (None, 0, 0, ()), (5, 3, 2, ()), (1, 3, 2, ())} <= hits
    shards = ops(spark)["shards"](frame(spark, ROWS)).select("doc_id", "size", "text_crc32").collect()
    from zlib import crc32

    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in shards) == sorted((str(i), len((t or "").encode()) + 1, crc32((t or "").encode())) for i, t in ROWS)
