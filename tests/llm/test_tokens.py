import os
import random

import pytest
from pyspark.sql import functions as F

from tallyweir.llm import tokens, wordtrie
from tallyweir.llm.wordtrie import WordTrie, read_ranks

PATH = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.tiktoken")
tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return read_ranks(PATH)


@pytest.fixture(scope="module")
def plain(ranks):
    return tiktoken.Encoding("plain", pat_str=wordtrie.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def _random_text(rng, vocabulary):
    kind = rng.random()
    if kind < 0.3:
        return "".join(rng.choice("ab aA='s1-\n\t .") for _ in range(rng.randint(0, 60)))
    if kind < 0.6:
        return b"".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 8))).decode("utf8", "replace")
    if kind < 0.8:
        return "".join(chr(rng.choice([rng.randint(32, 0x500), rng.randint(0x4E00, 0x4EFF), rng.randint(0x1F300, 0x1F700), rng.randint(0, 0xD7FF)])) for _ in range(rng.randint(1, 30)))
    return rng.choice("a=-_ é") * rng.randint(1, 300)


@pytest.mark.parametrize("seed", range(3))
def test_random_texts(ranks, plain, seed):
    rng, vocabulary = random.Random(seed), list(ranks)
    texts = [_random_text(rng, vocabulary) for _ in range(4000)]
    trie = WordTrie(ranks)
    assert trie.encode(texts) == [plain(t) for t in texts]
    assert trie.count(texts) == [len(plain(t)) for t in texts]


def test_limits_change_nothing(ranks, plain, monkeypatch):
    monkeypatch.setattr(wordtrie, "MAX_NODES", 50)
    monkeypatch.setattr(wordtrie, "MAX_WORDS", 20)
    monkeypatch.setattr(wordtrie, "LONG", 8)
    trie, rng = WordTrie(ranks), random.Random(9)
    for _ in range(40):
        texts = [_random_text(rng, list(ranks)[:5000]) for _ in range(20)]
        assert trie.encode(texts) == [plain(t) for t in texts]


def test_shared_prefixes_are_nodes_once(ranks):
    trie = WordTrie(ranks)
    trie.encode(["plateau plateaus plateaued"])
    assert len(trie.last) == 1 + len("plateau") + len(" plateaued") + 1  # ' plateaus' adds its last letter


def test_every_token_encodes_to_itself(ranks):
    trie = WordTrie(ranks)
    for token, rank in list(ranks.items())[::97]:
        states = [-1]
        for depth in range(1, len(token) + 1):
            states.append(trie._last_token(token, depth, states))
        assert trie._ids(token, states) == (rank,)


def test_another_vocabulary():
    path = os.path.join(os.path.dirname(PATH), "byte_bpe_multi_50k.tiktoken")
    ranks = read_ranks(path)
    plain = tiktoken.Encoding("multi", pat_str=wordtrie.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    rng = random.Random(1)
    texts = [_random_text(rng, list(ranks)) for _ in range(1500)]
    assert WordTrie(ranks).encode(texts) == [plain(t) for t in texts]


def test_operator(spark, plain):
    long = "plateau " * 300_000
    texts = [None, "", " ", "Hello world", "<|endoftext|>", "  two  spaces ", long, "Hello world", "x" * 100_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("doc_id", "text", "'mine' ids", "1 extra")
    got = {r["doc_id"]: r["ids"] for r in tokens.with_ids(df, ["doc_id"]).collect()}
    assert got == {i: plain(t or "") for i, t in enumerate(texts)}
    assert got[0] == got[1] == []
    counts = {r["doc_id"]: r["n_tokens"] for r in tokens.with_counts(df, ["doc_id"], path=PATH).collect()}
    assert counts == {i: len(x) for i, x in got.items()}
    assert tokens.with_ids(df, ["doc_id", "ids"]).columns == ["doc_id", "ids_in", "ids"]
    assert tokens.with_ids(df.limit(0), ["doc_id"]).count() == 0


def test_nothing_is_shuffled(spark, sf):
    plan = tokens.with_ids(spark.read.parquet(f"{sf}/documents.parquet"), ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_ids_stand_for_the_bytes(spark):
    texts = ["", None, "Hello  wörld\n", "漢字" * 300, "\0\r\n\t x", "<|endoftext|>", "é\u0301 " * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("bytes", F.lit("mine"))
    back = tokens.with_bytes(tokens.with_ids(df, ["id", "bytes"]), ["id", "bytes"])
    assert back.columns == ["id", "bytes_in", "bytes"]
    assert [bytes(r["bytes"]).decode() for r in back.orderBy("id").collect()] == [t or "" for t in texts]
    assert tokens.with_bytes(spark.createDataFrame([(None,)], "ids array<int>"), []).first()["bytes"] is None
