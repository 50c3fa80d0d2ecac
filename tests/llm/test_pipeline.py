"""The pipeline's stages against brute force on small documents."""

import random
from collections import Counter

import corpus_pipeline
from tests.llm.test_methods import brute_components  # noqa: F401  the same definition of near-duplicates
from textloom.llm import exact_dedup  # noqa: F401


def test_each_stage_takes_effect_and_keeps_clean_documents(spark, tmp_path):
    import pyarrow.parquet as pq

    table = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pydict()
    names = list(table)
    rows = [tuple(table[n][i] for n in names) for i in range(120)]
    bench = " ".join(f"bench{k}" for k in range(30))
    at = {n: i for i, n in enumerate(names)}

    def row(doc_id, text, lang="en"):
        return tuple({"doc_id": doc_id, "text": text, "lang": lang, "source": "s", "n_chars": len(text or "")}[n] for n in names)

    long_text = max((r[at["text"]] for r in rows), key=len)
    words = long_text.split()
    near = " ".join([*words[:-1], "changed"])
    rows += [row(1001, long_text), row(1002, near), row(1003, "12345 --"), row(1004, None), row(1005, "The thing " + bench + " and the rest of the thing"), row(None, rows[0][at["text"]]), row(1001, long_text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name.replace(" ", "_")))
        docs = spark.read.parquet(str(tmp_path / name.replace(" ", "_")))
        kept[name] = docs.collect()
    ids = {n: [r.doc_id for r in rs] for n, rs in kept.items()}
    assert 1003 not in ids["language ID"] and 1004 not in ids["language ID"] and 1005 in ids["language ID"]
    norm = lambda t: " ".join(t.split())
    texts = {norm(r.text) for r in kept["language ID"]}
    assert len(kept["exact dedup"]) == len({norm(r.text) for r in kept["exact dedup"]}) == len(texts)
    assert None not in ids["exact dedup"] and 1001 not in ids["exact dedup"] and 1002 in ids["exact dedup"]
    want, _ = brute_components([(r.doc_id, r.text) for r in kept["exact dedup"]], 5, 80)
    assert sorted(ids["MinHash near-dedup"]) == sorted(i for i, (_, label) in want.items() if label == i)
    assert 1002 not in ids["MinHash near-dedup"]
    assert set(ids["MinHash near-dedup"]) - set(ids["benchmark decontamination"]) == {1005}
    last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in last} == set(ids["benchmark decontamination"]) and all(r.decoded for r in last)


def shuffled_bytes(spark):
    """Bytes that the stages of this session have written to shuffles."""
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm
    none = jvm.java.util.ArrayList()
    stages = store.stageList(none, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), none)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_decontamination_shuffles_no_clean_text(spark, tmp_path):
    rng = random.Random(1)
    rows = [(k, f"clean {rng.randbytes(5000).hex()} {k}") for k in range(300)]
    bench = " ".join(f"bench{k}" for k in range(12))
    rows += [(None, rows[0][1]), (7, f"{bench} next to clean text"), (None, bench), (8, None), (7, rows[9][1]), (7, rows[9][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "docs.parquet"))
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    before = shuffled_bytes(spark)
    corpus_pipeline.drop_contaminated(spark, spark.read.parquet(str(tmp_path / "docs.parquet")), str(tmp_path)).write.parquet(str(tmp_path / "kept.parquet"))
    moved = shuffled_bytes(spark) - before
    kept = spark.read.parquet(str(tmp_path / "kept.parquet")).collect()
    assert Counter(map(tuple, kept)) == Counter(r for r in rows if "bench0" not in (r[1] or ""))
    assert 0 < moved < 500_000 < sum(len(t or "") for _, t in rows) / 5
