"""Byte-level BPE over a trie of words: shared prefixes are encoded once.

Byte-level BPE with merges in the order of token ids has a useful property: the encoding of a prefix, followed by one
more token, is the encoding of the longer prefix exactly if the last token before and the new one are *compatible*,
that is, if the two tokens' bytes together encode to just these two. So all that a prefix needs to keep is its last
token: of the tokens that end the prefix one alone is compatible with the last token of what is before it.

Words are inserted in order into a trie, which walks it depth first; each new node gets its last token from the last
tokens of its ancestors. A word's ids are read off backwards, token by token. Nodes stay, so later words with the same
beginnings start there. The trie, the table of words and that of compatible pairs are emptied when they reach their
limits, which changes nothing but the work.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable

import regex

#: The words of the text, with the space before: fixed by the vocabulary's publisher.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MAX_NODES, MAX_WORDS, MAX_PAIRS = 400_000, 200_000, 500_000
#: Bytes of a word that take nodes. What a word has beyond shares its prefix with the words beside it in their order only.
LONG = 64
_NEVER = 1 << 40


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ids from a file of ``base64 id`` lines."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class WordTrie:
    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.reach: dict[bytes, int] = {}  # the longest token by its last two bytes
        for token in ranks:
            end = token[-2:]
            if len(token) > self.reach.get(end, 1):
                self.reach[end] = len(token)
        self.words_of = regex.compile(pattern).findall
        self.spines: tuple[dict[int, list], dict[int, list]] = ({}, {})
        self.parts: dict[bytes, tuple[bytes, bytes] | None] = {}
        self.compatible: dict[int, bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        self._empty_trie()

    def _empty_trie(self) -> None:
        self.edges: dict[int, int] = {}
        self.last: list[int] = [-1]

    def _split(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two parts that merge to the token; none for a byte."""
        if len(token) == 1:
            return None
        if token in self.parts:
            return self.parts[token]
        ranks, limit = self.ranks, self.ranks[token]
        pieces = [token[i : i + 1] for i in range(len(token))]
        while len(pieces) > 2:
            rank, at = min((ranks.get(pieces[i] + pieces[i + 1], _NEVER), i) for i in range(len(pieces) - 1))
            if rank >= limit:
                raise ValueError(f"token {limit} is not made of tokens before it")
            pieces[at : at + 2] = [pieces[at] + pieces[at + 1]]
        self.parts[token] = tuple(pieces)
        return self.parts[token]

    def _spine(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """The pieces at one end of the token while it is being merged, with the rank of the merge that ends each."""
        spine = self.spines[side].get(token)
        if spine is None:
            piece, until, spine = self.bytes_of[token], _NEVER, []
            while piece is not None:
                spine.append((piece, until))
                until, parts = self.ranks[piece], self._split(piece)
                piece = parts[side] if parts else None
            self.spines[side][token] = spine
        return spine

    def fits(self, left: int, right: int) -> bool:
        """Whether the bytes of both tokens together encode to these two.

        They do unless a piece at the end of the left one and a piece at the beginning of the right one merge before
        the first of them is used up; at equal ranks the merge further left comes first.
        """
        key = left << 20 | right
        known = self.compatible.get(key)
        if known is None:
            if len(self.compatible) > MAX_PAIRS:
                self.compatible.clear()
            rank_of, known = self.ranks.get, True
            heads = self._spine(right, 0)
            for tail, tail_until in self._spine(left, 1):
                for head, head_until in heads:
                    rank = rank_of(tail + head, _NEVER)
                    if rank < tail_until and rank <= head_until and rank < _NEVER:
                        known = False
            self.compatible[key] = known
        return known

    def _last_token(self, word: bytes, depth: int, before: list[int]) -> int:
        """The last token of word[:depth], from those of the shorter prefixes."""
        rank_of, fits = self.ranks.get, self.fits
        reach = self.reach.get(word[depth - 2 : depth], 1) if depth > 1 else 1
        for start in range(max(0, depth - reach), depth):
            token = rank_of(word[start:depth])
            if token is not None and (start == 0 or fits(before[start], token)):
                return token
        raise ValueError("a byte is not in the vocabulary")

    def _ids(self, word: bytes, last: list[int]) -> tuple[int, ...]:
        ids, depth, bytes_of = [], len(word), self.bytes_of
        while depth:
            ids.append(last[depth])
            depth -= len(bytes_of[last[depth]])
        return tuple(reversed(ids))

    def learn(self, words: Iterable[str]) -> None:
        """Inserts words, in order, and keeps their ids."""
        if len(self.last) > MAX_NODES:
            self._empty_trie()
        edges, nodes = self.edges, self.last
        path, on_path, before = b"", [0], [-1]  # the bytes, nodes and last tokens down to where the walk is
        for word, text in sorted((w.encode(), w) for w in words):
            shared = 0
            for a, b in zip(path, word):
                if a != b:
                    break
                shared += 1
            del on_path[min(shared, LONG) + 1 :], before[shared + 1 :]
            node = on_path[-1]
            for depth in range(shared + 1, len(word) + 1):
                if depth > LONG:
                    before.append(self._last_token(word, depth, before))
                    continue
                edge = node << 8 | word[depth - 1]
                node = edges.get(edge, 0)
                if node:
                    token = nodes[node]
                else:
                    token = self._last_token(word, depth, before)
                    node = edges[edge] = len(nodes)
                    nodes.append(token)
                on_path.append(node)
                before.append(token)
            path = word
            self.known[text] = self._ids(word, before)

    def words(self, texts: list[str]) -> list[list[str]]:
        """The words of each text; all of them are known afterwards."""
        split = [self.words_of(t) for t in texts]
        if len(self.known) > MAX_WORDS:
            self.known.clear()
        new = set().union(*split).difference(self.known)
        if new:
            self.learn(new)
        return split

    def encode(self, texts: list[str]) -> list[list[int]]:
        known = self.known
        return [[i for w in words for i in known[w]] for words in self.words(texts)]

    def count(self, texts: list[str]) -> list[int]:
        known = self.known
        return [sum([len(known[w]) for w in words]) for words in self.words(texts)]
