"""Aligned tokens against all pairs of byte ranges, and counts over all documents against a plain counter."""

import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers

from textloom.llm import alignment

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = "ab  \n\t é漢字▁<0x0A>'s12!👍ﬁ　"


@pytest.fixture(scope="module")
def pair():
    return alignment.Pair(*PATHS)


@pytest.fixture(scope="module")
def libraries():
    first = tokenizers.Tokenizer.from_file(PATHS[0])
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def texts(seed, n):
    draw = random.Random(seed)
    return ["".join(draw.choice(ALPHABET) for _ in range(draw.choice((0, 1, 5, 30, 400)))) for _ in range(n)]


def ranges(ids, size):
    out, at = [], 0
    for i in ids:
        out.append((at, at + size(i), i))
        at += size(i)
    return out


def plain(pair, libraries, text):
    """ids of a and b by the libraries; groups and links by comparing all ranges."""
    ids = libraries[0].encode(" " + text, add_special_tokens=False).ids, libraries[1].encode(text)
    whole = (" " + text).encode()
    if not text or any(b"".join(x.bytes[i] for i in own) != whole for x, own in zip((pair.first, pair.second), ids)):
        return [], [], "", []
    a, b = (ranges(own, lambda i, x=x: len(x.bytes[i])) for x, own in zip((pair.first, pair.second), ids))
    cuts = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
    groups = [",".join(str(i) for _, e, i in a if p < e <= q) + "|" + ",".join(str(i) for _, e, i in b if p < e <= q) for p, q in zip([0, *cuts], cuts)]
    return *ids, ";".join(groups), sorted((i, j) for s, e, i in a for t, f, j in b if max(s, t) < min(e, f))


def test_groups_and_links_of_blocks(pair, libraries):
    for seed in range(40):
        docs = texts(seed, 25)
        got = alignment.aligned(pair, pair.encode(docs))
        for k, text in enumerate(docs):
            a, b, groups, links = plain(pair, libraries, text)
            assert (got.n_a[k], got.n_b[k], got.groups[k].as_py()) == (len(a), len(b), groups)
            assert got.n_groups[k] == (groups.count(";") + 1 if groups else 0)
            assert sorted(divmod(x, 1 << 32) for x in got.link[got.link_doc == k].tolist()) == links


def test_special_strings_are_text_and_marks_are_none(pair, libraries):
    a, b = pair.encode(["x <|endoftext|> </s> <s>"])[0]
    assert a.tolist() == libraries[0].encode(" x <|endoftext|> </s> <s>", add_special_tokens=False).ids and 50256 not in a and not {1, 2} & set(b.tolist())
    assert [len(x[0]) for x in pair.encode(["a▁b", "", "a b"])] == [0, 0, 2]


def test_ends_of_both_at_any_shift():
    draw = np.random.default_rng(5)
    for n in (1, 2, 50, 700):
        for share in (0.02, 0.5, 0.98):
            last = 10 * n + 1
            common = np.append(np.flatnonzero(draw.random(last) < share / 4), last)
            extra = np.flatnonzero(draw.random((2, last)) < 0.1, ) % last
            a, b = np.union1d(common, extra[::2]), np.union1d(common, extra[1::2])
            a, b = a[a > 0], b[b > 0]
            both = np.intersect1d(a, b)
            starts = alignment.lanes(a, b, np.array([0]))
            for begun in (np.array([0]), starts):
                cut_a, cut_b = alignment.common_ends(a, b, begun.copy())
                assert (a[cut_a] == both).all() and (b[cut_b] == both).all()


def test_counts_over_all_documents(spark, pair, libraries):
    docs = list(enumerate(texts(99, 120))) + [(7, "the the the"), (None, "the cat"), (500, None), (501, "the cat " * 3000)]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).selectExpr("*", "1 AS block", "'x' AS groups")
    rows = alignment.with_link_counts(alignment.align(table, *PATHS, block_bytes=1500)).collect()
    known = [(i, plain(pair, libraries, t or "") if i != 501 else None) for i, t in docs]
    long = alignment.aligned(pair, pair.encode(["the cat " * 3000]))
    links = {k: x[3] if x else [divmod(y, 1 << 32) for y in long.link.tolist()] for k, (_, x) in enumerate(known)}
    n = Counter(p for own in links.values() for p in own)
    top = {}
    for (_, b), c in n.items():
        top[b] = max(top.get(b, 0), c)
    want = sorted((str(i), len(links[k]), sum(n[p] == top[p[1]] for p in links[k]), sum(n[p] for p in links[k])) for k, (i, _) in enumerate(known))
    assert sorted((str(r.doc_id), r.n_links, r.n_best, r.count_sum) for r in rows) == want
    assert len(rows) == len(docs) and {r.groups for r in rows if r.doc_id == 500} == {""}


def test_no_rows(spark):
    assert alignment.with_link_counts(alignment.align(spark.createDataFrame([], "doc_id long, text string"), *PATHS)).count() == 0
    nothing = spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string")
    assert [(r.n_links, r.n_best, r.count_sum) for r in alignment.with_link_counts(alignment.align(nothing, *PATHS)).collect()] == [(0, 0, 0)] * 2
