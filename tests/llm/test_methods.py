"""The operators against brute force, exact round trips and held-out accuracy."""

import collections
import itertools
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from public_tokenizers import path as tokenizer
from pyspark.sql import functions as F

from textloom.llm import decontamination, exact_dedup, language_id, near_dup, segmentation, sharding, substring_dedup, token_counts, toxicity, url_filter

DATA = "/root/testdata/sf0.001"


def texts():
    t = pq.read_table(f"{DATA}/documents.parquet").to_pydict()
    return list(zip(t["doc_id"], t["text"], strict=True))


# 1: segmentations
SMALL = segmentation.Pieces(["", "a", "b", "ab", "▁", "▁a", "ba", "aba", "bb"] + [""] * 256, list(np.log([1, 0.2, 0.1, 0.25, 0.05, 0.15, 0.1, 0.1, 0.05])) + [-9.0] * 256, list(range(9, 265)), -9.0)


def all_paths(lattice, chunks):
    def of(n, end):
        if n == end:
            return [((), 0.0)]
        return [((a, *p), lattice.log_p[a] + lp) for a in range(lattice.begin[n], lattice.begin[n + 1]) for p, lp in of(lattice.to[a], end)]

    each = [of(lattice.first[c], lattice.last[c]) for c in range(len(chunks))]
    return {sum((x[0] for x in c), ()): sum(x[1] for x in c) for c in itertools.product(*each)}


def test_samples_have_the_right_distribution_and_are_distinct():
    n, text = 12_000, "abab ba"
    lattice, found = segmentation.top_k(SMALL, [text] * n, list(range(n)), 3)
    paths = all_paths(lattice, SMALL.chunks(text))
    assert abs(sum(np.exp(list(paths.values()))) - 1) < 1e-9
    first = collections.Counter(tuple(s[0].arcs.tolist()) for s in found)
    assert max(abs(first[p] / n - np.exp(lp)) for p, lp in paths.items()) < 0.015
    pairs = collections.Counter((tuple(s[0].arcs.tolist()), tuple(s[1].arcs.tolist())) for s in found)
    assert max(abs(pairs[a, b] / n - np.exp(paths[a] + paths[b]) / (1 - np.exp(paths[a]))) for a in paths for b in paths if a != b) < 0.015
    assert all(len({tuple(s.arcs.tolist()) for s in samples}) == 3 for samples in found)
    # Inclusion scores make the sum over samples of p / inclusion estimate one without bias.
    assert abs(np.mean([sum(np.exp(s.log_prob) / s.inclusion for s in samples) for samples in found]) - 1) < 0.02


def test_all_segmentations_when_k_is_large():
    lattice, (found,) = segmentation.top_k(SMALL, ["ab b"], [5], 50)
    paths = all_paths(lattice, SMALL.chunks("ab b"))
    assert {tuple(s.arcs.tolist()) for s in found} == set(paths) and all(s.inclusion == 1 for s in found)


def test_round_trip_and_seed(spark):
    docs = spark.createDataFrame([(i, t) for i, t in texts()[:40]] + [(900, "é▁x  y\n 日本👍"), (901, " lead"), (902, "trail ")], "doc_id long, text string")
    model = tokenizer("piece_bpe_32k.model")
    rows = segmentation.sample_segmentations(docs, model, k=2)
    got = segmentation.decode_pieces(rows, model).join(docs, "doc_id").collect()
    assert got and all(r.decoded and r.decoded_text == r.text.replace("▁", " ") for r in got)
    again = {(r.doc_id, r["rank"]): r.ids_hash for r in segmentation.sample_segmentations(docs.repartition(3), model, k=2).collect()}
    assert again == {(r.doc_id, r["rank"]): r.ids_hash for r in got}
    other = {(r.doc_id, r["rank"]): r.ids_hash for r in segmentation.sample_segmentations(docs, model, k=2, seed=1).collect()}
    assert sum(other[k] != again[k] for k in again) > len(again) // 2


# 2: shards
def test_shards_are_contiguous_balanced_and_gapless(spark):
    rng = random.Random(3)
    rows = [(i, "x" * rng.choice([0, 1, 10, 500])) for i in range(997)]
    rng.shuffle(rows)
    got = sorted(map(tuple, sharding.prefix_sum_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), 5).select("doc_id", "size", "text_crc32", "shard", "slot").collect()))
    assert [g[3] for g in got] == sorted(g[3] for g in got)
    sizes = collections.Counter()
    for (i, size, crc, shard, slot), (j, text) in zip(got, sorted(rows), strict=True):
        assert i == j and size == len(text) + 1 and crc == zlib.crc32(text.encode())
        assert slot == sum(1 for g in got if g[3] == shard and g[0] < i)
        sizes[shard] += size
    assert max(sizes.values()) - min(sizes.values()) <= 2 * 501


def test_write_shards(spark, tmp_path):
    sharding.write_shards(spark.createDataFrame([(i, "t" * i) for i in range(50)], "doc_id long, text string"), str(tmp_path / "s"), 4)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 50 and back.select("shard").distinct().count() == 4


# 3 and 4: models
def test_counterfactual_penalty_takes_weight_off_mentions():
    rng = np.random.default_rng(1)
    n = 600
    y = (rng.random(n) < 0.5).astype(float)
    insult, mention = (rng.random(n) < np.where(y == 1, 0.9, 0.02)), (rng.random(n) < np.where(y == 1, 0.6, 0.2))
    x = np.stack([insult, mention, rng.random(n) < 0.5], 1).astype(np.float32)
    swapped = np.array([[0, 1, 0]] * int(mention.sum()), np.float32)  # the other mention of its kind is no feature
    free, _ = toxicity.fit_logistic(x, y, swapped, penalty=0.0)
    held, _ = toxicity.fit_logistic(x, y, swapped, penalty=5.0)
    assert free[1] > 0.5 and abs(held[1]) < 0.1 and held[0] > 2


def test_toxicity_held_out(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(600):
        bad = i % 4 == 0
        w = rng.choices(words, k=40) + (["moron" + rng.choice(["", "s", "ic"])] if bad else []) + (["women"] if bad or i % 3 == 0 else [])
        rng.shuffle(w)
        rows.append((i, " ".join(w), int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit_toxicity(docs.select("doc_id", "text"), docs.where("doc_id % 5 <> 0").select("doc_id", "toxic"))
    got = toxicity.score_toxicity(docs, model).join(docs, "doc_id").where("doc_id % 5 = 0").collect()
    assert np.mean([(r.score >= 0.5) == bool(r.toxic) for r in got]) > 0.95
    extra = spark.createDataFrame([(1, "women w1 w2"), (2, "")], "doc_id long, text string")
    assert all(r.score < 0.5 for r in toxicity.score_toxicity(extra, model).collect())


def test_bit_slices_equal_one_filter_for_each_language():
    rng = np.random.default_rng(2)
    grams = {f"l{i:02d}": rng.integers(0, 1 << 62, 500).astype(np.uint64) for i in range(70)}  # two planes
    together = language_id.LanguageFilters.fit(grams, bits=14)
    asked = np.concatenate([grams["l03"], grams["l69"], rng.integers(0, 1 << 62, 4000).astype(np.uint64)])
    alone = {name: language_id.LanguageFilters.fit({name: g}, bits=14) for name, g in grams.items()}
    assert together.hits(asked).tolist() == [int(alone[n].hits(asked)[0]) for n in together.languages]
    rates = together.false_positive_rates()
    noise = rng.integers(0, 1 << 62, 60_000).astype(np.uint64)
    assert np.abs(together.hits(noise) / len(noise) - rates).max() < 0.002
    share = together.shares(asked, rates)
    assert abs(share[3] - 500 / len(asked)) < 0.01 and share[5] < 0.01


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    filters = language_id.fit_filters(docs.where(F.col("doc_id") % 3 != 1))
    got = language_id.identify(docs.where(F.col("doc_id") % 3 == 1), filters).join(docs, "doc_id").collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.97
    odd = language_id.identify(spark.createDataFrame([(1, "123 !?"), (2, None)], "doc_id long, text string"), filters).collect()
    assert [(r.lang_pred, r.score) for r in odd] == [("und", 0.0)] * 2


# 5: links
def test_link_graph_against_plain_iteration(spark):
    a = lambda *hs: "".join(f'<a href="http://{h}/">' for h in hs)
    rows = [(1, "http://good.com/", a("one.org", "two.org")), (2, "http://one.org/", a("two.org")), (3, "http://far.org/", a("bad.net", "bad.net")), (4, "http://bad.net/", a("two.org")), (5, "http://two.org/", ""), (6, "http://lone.org/", '<a href="//far.org">'), (7, "http://rest.org/", "")]
    rules = [url_filter.Rule("allow", "com", "/"), url_filter.Rule("block", "net", "/")]
    got = {r.page_id: r for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), rules, iterations=6).collect()}
    edges = {("good.com", "one.org"): 0.5, ("good.com", "two.org"): 0.5, ("one.org", "two.org"): 1.0, ("far.org", "bad.net"): 1.0, ("bad.net", "two.org"): 1.0, ("lone.org", "far.org"): 1.0}

    def spread(edges, seeds):
        rank = {s: 0.15 for s in seeds}
        for _ in range(6):
            new = {s: 0.15 for s in seeds}
            for (x, y), w in edges.items():
                if x in rank:
                    new[y] = new.get(y, 0) + w * rank[x] * 0.85
            rank = new
        return rank

    into = collections.Counter()
    for (_, y), w in edges.items():
        into[y] += w
    trust, distrust = spread(edges, ["good.com"]), spread({(y, x): w / into[y] for (x, y), w in edges.items()}, ["bad.net"])
    for r in got.values():
        assert abs(r.trust - trust.get(r.host, 0)) < 1e-12 and abs(r.distrust - distrust.get(r.host, 0)) < 1e-12
    assert {i: r.verdict for i, r in got.items()} == {1: "allow", 2: "allow", 3: "block", 4: "block", 5: "allow", 6: "block", 7: "allow"}


# 6: the digest index
def test_digest_index_flush_compact_lookup(spark, tmp_path):
    index = exact_dedup.DigestIndex(spark, str(tmp_path / "i"), fan_in=3)
    made = lambda ids: spark.createDataFrame([(bytes([i % 4]), False, i, i) for i in ids], "digest binary, no_id boolean, doc_id long, row long")
    for ids in ([8, 9, 10], [4, 5], [6, 7, 3], [0]):
        index.flush(made(ids))
    assert len(index.runs) == 2
    got = {r.digest[0]: (r["first"].doc_id, r.members) for r in index.entries().collect()}
    assert got == {0: (0, 3), 1: (5, 2), 2: (6, 2), 3: (3, 2)}
    assert exact_dedup.DigestIndex(spark, index.path, runs=index.runs).lookup(made([1])).first()["first"].doc_id == 5


# 7: tokens
def test_counts_equal_the_library():
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), token_counts.PairRanks(path, remembered=500)
    odd = ["", "  ", "<|endoftext|> hi<|startoftext|>", "I'll don't WE'VE 12345 ½ ΣΑΣ ΟΔΟΣ", "é café \x1c a\x1db", "日本語 👍🏽  x\x85y\xa0z", "a" * 3000, "﻿x İstanbul ǅ ß", "x'S 'Sx ''s"]
    every = [t for _, t in texts()] + odd
    assert [own.count(t) for t in every] == [len(e.ids) for e in library.encode_batch(every, add_special_tokens=False)]


# 8: the positional index
def test_phrases_and_proximity_against_brute_force(spark):
    rng = random.Random(9)
    docs = [(i, " ".join(rng.choices("abcdef", k=rng.choice([0, 3, 9, 60])))) for i in range(60)]
    items = [(i, " ".join(rng.choices("abcdef", k=rng.choice([1, 2, 4, 6])))) for i in range(25)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    index = decontamination.build_index(d, segment_words=200)
    ids = {(r.segment, r.doc_no): r.doc_id for r in index.where("term is null").collect()}
    got = {(ids[r.segment, r.doc_no], r.item_id): {p for s in r.spans for p in range(s.start, s.end)} for r in decontamination.find_matches(index, b, window=3, block_windows=7).collect()}
    want = {}
    for i, t in docs:
        w = t.split()
        for j, phrase in items:
            p = phrase.split()
            for win in [p[k : k + 3] for k in range(max(1, len(p) - 2))]:
                for a in range(len(w) - len(win) + 1):
                    if w[a : a + len(win)] == win:
                        want.setdefault((i, str(j)), set()).update(range(a, a + len(win)))
    assert got == want
    near = {(ids[r.segment, r.doc_no], r.item_id) for r in decontamination.find_matches(index, b, window=3, slop=2).collect()}
    loose = set(want)
    for i, t in docs:
        w = t.split()
        for j, phrase in items:
            p = phrase.split()
            for win in [p[k : k + 3] for k in range(max(1, len(p) - 2))]:
                if any(set(win) <= set(w[a : a + len(win) + 2]) for a in range(len(w))):
                    loose.add((i, str(j)))
    assert near == loose


# 9: sketches
def test_sketches_merge_and_rarely_miss():
    rng = np.random.default_rng(4)
    a, b = (np.unique(rng.integers(0, 1 << 62, 800).astype(np.uint64)) for _ in range(2))
    union = near_dup.set_sketch(np.union1d(a, b))
    assert (near_dup.merged_sketch(near_dup.set_sketch(a), near_dup.set_sketch(b)) == union).all()
    kept = banded = 0
    for _ in range(150):
        common = rng.integers(0, 1 << 62, 800).astype(np.uint64)
        x, y = (np.unique(np.concatenate([common, rng.integers(0, 1 << 62, 100).astype(np.uint64)])) for _ in range(2))  # similarity 0.8
        s, t = near_dup.set_sketch(x), near_dup.set_sketch(y)
        kept += bool(near_dup.possible(np.array([(s > t).sum()]), np.array([(s < t).sum()]), np.array([900]), np.array([900]))[0])
        banded += bool((near_dup.band_keys(s) == near_dup.band_keys(t)).any())
    assert kept == banded == 150
    low = [near_dup.set_sketch(np.concatenate([common[:400], rng.integers(0, 1 << 62, 500).astype(np.uint64)])) for _ in range(2)]
    assert not near_dup.possible(np.array([(low[0] > low[1]).sum()]), np.array([(low[0] < low[1]).sum()]), np.array([900]), np.array([900]))[0]


def brute_components(rows, size, percent):
    sets = {i: set(near_dup.shingle_set(t, size).tolist()) for i, t in rows}
    label = {i: i for i in sets}
    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    return {i: (len(sets[i]), label[i]) for i in sets}, links


@pytest.mark.parametrize("block", [1000, 7])
def test_near_duplicates_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(near_dup, "BLOCK", block)
    rng = random.Random(12)
    vocabulary = [f"v{i}" for i in range(400)]
    rows = []
    for _ in range(6):  # groups whose members are near their base, but often not near each other, and share a passage
        base = rng.choices(vocabulary, k=120)
        rows.append(base)
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.choice([1, 2, 3, 5])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append(copy)
    passage = rng.choices(vocabulary, k=60)
    rows += [passage + rng.choices(vocabulary, k=30) for _ in range(25)]
    rng.shuffle(rows)
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)] + [(500, rows[0][0]), (501, ""), (502, "V1 v2"), (503, "v1 V2")]
    want, links = brute_components(rows, 4, 80)
    assert len(links) > 50
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4).collect()}
    assert got == want


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 200), (200, 150)], "a long, b long")
    got = {r.c: r.label for r in near_dup.components(links).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 150: 100, 200: 100}


# 10: repeats
def brute_repeats(rows, window):
    first, out = {}, {}
    for i, t in sorted(rows):
        w = t.split()
        for a in range(len(w) - window + 1):
            first.setdefault(tuple(w[a : a + window]), i)
    for i, t in rows:
        w = t.split()
        gone = {p for a in range(len(w) - window + 1) if first[tuple(w[a : a + window])] < i for p in range(a, a + window)}
        out[i] = (len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone))
    return out


def test_repeats_against_brute_force(spark):
    rng = random.Random(21)
    passages = [[rng.choice("abcdefgh") for _ in range(n)] for n in (9, 14, 25, 40)]
    rows = []
    for i in range(80):
        w = []
        for _ in range(rng.choice([0, 1, 2, 4])):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            w += p[a : a + rng.choice([5, 12, 40])] + [rng.choice("abcdefghij") for _ in range(rng.choice([0, 1, 6]))]
        rows.append((i, " ".join(w)))
    rows += [(90, rows[5][1]), (91, "a " * 60)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window=8, gram=3, batches=3, with_text=True).collect()}
    assert got == brute_repeats(rows, 8)


def test_window_index_compacts(spark, tmp_path):
    index = substring_dedup.WindowIndex(spark, str(tmp_path / "f"), fan_in=2, buckets=3)
    for rows in ([(5, 1, 1, 0), (6, 1, 1, 0)], [(5, 1, 2, 0), (5, 2, 2, 0)], [(7, 1, 3, 0), (7, 1, 3, 0), (5, 2, 0, 0)]):
        index.add(spark.createDataFrame(rows, "fingerprint long, stretch long, doc_id long, key long"))
    assert len(index.runs) == 1
    got = {(r.fingerprint, r.stretch): (r["first"].doc_id, r["last"]) for r in index.read(index.runs[0]).collect()}
    assert got == {(5, 1): (1, 2), (5, 2): (0, 2), (6, 1): (1, 1), (7, 1): (3, 3)}
