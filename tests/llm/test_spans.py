import random

import numpy as np
import pytest

from tallyweir.llm import spans
from tallyweir.llm import superkmers as sk

from ..conftest import rows


def brute(docs, span=sk.SPAN):
    owners = {}
    for i, t in docs:
        if i is not None and t:
            for at in range(len(t) - span + 1):
                owners.setdefault(t[at : at + span], set()).add(i)
    out = set()
    for i, t in docs:
        if i is None or not t:
            continue
        begin = end = None
        for at in range(len(t) - span + 1):
            if len(owners[t[at : at + span]]) > 1:
                if end is not None and at <= end:
                    end = at + span
                else:
                    if end is not None:
                        out.add((i, begin, end))
                    begin, end = at, at + span
        if end is not None:
            out.add((i, begin, end))
    return sorted(out, key=repr)


def _corpus(seed, n=120):
    rng = random.Random(seed)
    words = ["plateau", "héron", "город", "数", "𝒳y", "a", "the", "…", "1,5"]
    text = lambda k: " ".join(rng.choice(words) + str(rng.randrange(1000)) for _ in range(k))
    passages = [text(k) for k in (9, 12, 14, 16, 30, 60)] + ["ab" * 60, "=" * 90, " " * 85]
    docs = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(5)):
            p = rng.choice(passages)
            a, b = rng.randrange(len(p) // 3 + 1), len(p) - rng.randrange(len(p) // 3 + 1)
            parts.append(rng.choice([text(rng.randrange(12)), p, p[a:b], p[:b] + p[a:]]))
        docs.append((i, rng.choice(["", " "]).join(parts)))
    docs += [(1000 + i, "the same text in a third of all rows, long enough to be shared with the others, so " + "x" * (i == 0)) for i in range(n // 2)]
    docs += [(2000, None), (2001, ""), (2002, "q" * 79), (2003, "q" * 79), (2004, "r" * 80), (2005, "s" * 80 + "r" * 80), (2006, "z" * 400), (None, "y" * 100), (2007, "y" * 100)]
    return docs


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize(("hot_over", "chunk"), [(spans.HOT, spans.CHUNK), (2, spans.CHUNK), (10**9, 1500), (3, 1500)])
def test_against_brute_force(spark, seed, hot_over, chunk):
    docs = _corpus(seed)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 id", "2 a", "3 low").repartition(5)
    assert rows(spans.shared_spans(df, hot_over=hot_over, chunk=chunk)) == brute(docs)


def test_ids_repeat(spark):
    t = "t" * 50 + "u" * 50
    df = spark.createDataFrame([(1, t), (1, t), (2, "v" * 90 + "w" * 90)], "doc_id bigint, text string")
    assert spans.shared_spans(df).count() == 0  # rows of one id are one record
    assert spans.shared_spans(df.limit(0)).count() == 0


def test_shares(spark):
    t = "s" * 100
    df = spark.createDataFrame([(1, t), (2, t + "0" * 100), (3, ""), (4, None), (5, "x")], "doc_id bigint, text string")
    out = spans.shared_share(df, spans.shared_spans(df))
    assert rows(out) == [(1, 100, 100, 1.0), (2, 200, 100, 0.5), (3, 0, 0, 0.0), (4, 0, 0, 0.0), (5, 1, 0, 0.0)]


def test_touching_spans_unite(spark):
    df = spark.createDataFrame([(1, 0, 80), (1, 80, 160), (1, 161, 250), (2, 5, 100), (2, 7, 90)], "id bigint, a bigint, b bigint")
    assert rows(spans.united(df)) == [(1, 0, 160), (1, 161, 250), (2, 5, 100)]


def test_equal_windows_have_equal_minimisers():
    rng = random.Random(3)
    shared = "".join(rng.choice("abc é") for _ in range(200))
    texts = ["".join(rng.choice("abc é") for _ in range(k)) + shared for k in (0, 3, 57)]
    found = sk.super_kmers(sk.Text.of(texts))
    by_window = {}
    for m, t, b, n in zip(found.minimiser, found.text, found.begin, found.n_windows):
        for at in range(b, b + n):
            by_window.setdefault(texts[t][at : at + sk.SPAN], set()).add(m)
    assert len(by_window) == sum(len(t) - 79 for t in texts) - 2 * (200 - 79)
    assert all(len(m) == 1 for m in by_window.values())


def test_windows_of_one_hash_are_compared(monkeypatch):
    """Were all hashes equal, characters would still decide."""
    monkeypatch.setattr(sk, "hashes", lambda points, lengths, seed=0: [np.zeros(len(points), np.uint64) for _ in lengths])
    texts = ["a" * 80, "b" * 80, "a" * 80, "c" * 81]
    at, flags = sk.shared_windows(sk.Text.of(texts), np.array([1, 2, 3, 4]), np.array([1, 2, 3, 4]))
    assert flags.tolist() == [True, False, True, False, False]


def test_long_texts_are_cut_and_stay_whole(spark, monkeypatch):
    monkeypatch.setattr(sk, "STRETCH", 100)
    parts, owner, begin = sk.stretches(["x" * 1000, "y" * 50, ""])
    assert owner.count(0) == 10 and begin[:3] == [0, 100, 200] and parts[0] == "x" * 179 and parts[-1] == ""
    covered = {b + i for p, o, b in zip(parts, owner, begin) if o == 0 for i in range(len(p) - 79)}
    assert covered == set(range(1000 - 79))


def test_very_long_text(spark):
    rng = random.Random(8)
    whole = "".join(rng.choice("abcdefgh ") for _ in range(sk.STRETCH * 2 + 5000))
    cut = whole[sk.STRETCH - 300 : sk.STRETCH + 300]
    df = spark.createDataFrame([(1, whole), (2, cut), (3, "k" * (sk.LONGEST * 2 + 500)), (4, "k" * 100)], "doc_id bigint, text string")
    expected = [(1, sk.STRETCH - 300, sk.STRETCH + 300), (2, 0, 600), (3, 0, sk.LONGEST * 2 + 500), (4, 0, 100)]
    assert rows(spans.shared_spans(df)) == expected
