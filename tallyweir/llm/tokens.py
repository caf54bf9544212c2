"""Encoding a text column with a public byte-level BPE vocabulary.

Texts are encoded where they are read: every task has its own trie of words (``wordtrie``), so nothing is shuffled and
no text waits for another. The vocabulary file is named by a parameter; each Python worker reads it once.

A null and an empty text give the empty list (and 0 tokens). Special tokens are not known: their strings are ordinary
text. Long texts are taken whole; texts are worked on in groups of about ``GROUP_CHARS`` characters.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallyweir.functions.columns import ref, without_clash
from tallyweir.llm.wordtrie import WordTrie, read_ranks

GROUP_CHARS = 1 << 20
_tries: dict[str, WordTrie] = {}
_pieces: dict[str, dict[int, bytes]] = {}


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> str:
    """The file of a public vocabulary on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def trie_of(path: str | None) -> WordTrie:
    """The worker's trie for a vocabulary file; None is the default vocabulary, wherever this worker has it."""
    path = path or vocabulary()
    if path not in _tries:
        _tries[path] = WordTrie(read_ranks(path))
    return _tries[path]


def _groups(texts: pa.Array) -> Iterator[list[str]]:
    sizes = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False))
    begin, n = 0, len(texts)
    while begin < n:
        done = sizes[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(sizes, done + GROUP_CHARS, side="right")))
        yield [t or "" for t in texts[begin:end].to_pylist()]
        begin = end


def _apply(df: DataFrame, keep: Sequence[str], text: str, out: str, kind: T.DataType, run_batch) -> DataFrame:
    kept = without_clash(df.select(*(ref(k) for k in keep)), [out]).columns
    slim = df.select(*(ref(k).alias(name) for k, name in zip(keep, kept)), ref(text).alias(out))
    schema = T.StructType([*slim.schema.fields[: len(kept)], T.StructField(out, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.columns
            yield pa.RecordBatch.from_arrays([*columns[:-1], run_batch(columns[-1])], names=schema.names)

    return slim.mapInArrow(run, schema)


def with_ids(df: DataFrame, keep: Sequence[str], text: str = "text", out: str = "ids", path: str | None = None) -> DataFrame:
    """The columns ``keep`` and ``out``: the list of token ids of each text."""

    def run_batch(texts: pa.Array) -> pa.Array:
        trie, sizes, flat = trie_of(path), [np.zeros(1, np.int32)], []
        for group in _groups(texts):
            ids = trie.encode(group)
            sizes.append(np.fromiter(map(len, ids), np.int32, len(ids)))
            flat.append(np.fromiter((i for x in ids for i in x), np.int32))
        values = np.concatenate(flat) if flat else np.zeros(0, np.int32)
        return pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(sizes), dtype=np.int32)), pa.array(values))

    return _apply(df, keep, text, out, T.ArrayType(T.IntegerType()), run_batch)


def with_counts(df: DataFrame, keep: Sequence[str], text: str = "text", out: str = "n_tokens", path: str | None = None) -> DataFrame:
    """The columns ``keep`` and ``out``: the number of tokens of each text."""

    def run_batch(texts: pa.Array) -> pa.Array:
        trie = trie_of(path)
        counts = [n for group in _groups(texts) for n in trie.count(group)]
        return pa.array(counts, pa.int64())

    return _apply(df, keep, text, out, T.LongType(), run_batch)


def with_bytes(df: DataFrame, keep: Sequence[str], ids: str = "ids", out: str = "bytes", path: str | None = None) -> DataFrame:
    """The columns ``keep`` and ``out``: the bytes that the ids of each list stand for. A null list gives null; an id that
    the vocabulary lacks is an error."""

    def run_batch(lists: pa.Array) -> pa.Array:
        if (file := path or vocabulary()) not in _pieces:
            ranks = read_ranks(file)
            _pieces[file] = dict(zip(ranks.values(), ranks.keys()))
        pieces = _pieces[file]
        return pa.array([None if x is None else b"".join(map(pieces.__getitem__, x)) for x in lists.to_pylist()], pa.binary())

    return _apply(df, keep, ids, out, T.BinaryType(), run_batch)
