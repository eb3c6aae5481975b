"""Greedy word-piece token counts by a linear longest-match automaton.

The vocabulary is a trie over bytes. Every node has a failure link to the node that is reached once the longest pieces
have been cut from the front of its string, and the number of pieces that are cut on the way (Song et al., Fast
WordPiece Tokenization, 2021). A word is then read once, byte by byte; a missing transition adds the popped count and
follows the link; no piece is ever built. All words of a batch advance together in NumPy, one byte a step; a word over
LONG bytes, which would make steps for itself alone, is read by a loop over the same transitions in a dictionary, at
about a third of a microsecond a byte.

The vocabulary is the byte-level one of a public tokenizer: a word is read with its leading space mark, which is itself
a piece, and every byte is a piece, so each word can be cut.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from framewright.llm import textkit as tk

LONG = 256


def byte_symbols() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def byte_vocabulary(path: str) -> list[bytes]:
    """The pieces of a byte-level tokenizer file, as bytes, without its special tokens."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    table = byte_symbols()
    special = {t["content"] for t in found["added_tokens"]}
    return [bytes(table[c] for c in piece) for piece in found["model"]["vocab"] if piece not in special]


@dataclass
class Automaton:
    keys: np.ndarray  # open hash table of transitions: node * 256 + byte + 1, 0 where free
    values: np.ndarray
    fail: np.ndarray  # -1: no piece can be cut from the front
    popped: np.ndarray
    mask: int

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The next node, or -1, for each pair."""
        key = (node.astype(np.uint64) << tk.U64(8) | byte.astype(np.uint64)) + tk.U64(1)
        with np.errstate(over="ignore"):
            at = ((key * tk.ODD) >> tk.U64(30)).astype(np.int64) & self.mask
        out = np.full(len(node), -1, np.int32)
        left = np.arange(len(node))
        while len(left):
            found = self.keys[at]
            hit = found == key
            out[left[hit]] = self.values[at[hit]]
            more = ~hit & (found != 0)
            left, at, key = left[more], (at[more] + 1) & self.mask, key[more]
        return out

    @cached_property
    def plain(self) -> tuple[dict[int, int], list[int], list[int]]:
        """Transitions, failure links and popped counts as Python's own kinds, made when a worker meets its first long word."""
        used = self.keys != 0
        return dict(zip((self.keys[used] - tk.U64(1)).tolist(), self.values[used].tolist(), strict=True)), self.fail.tolist(), self.popped.tolist()

    def word(self, text: bytes) -> int:
        """The number of pieces of one word; -1 if it can't be cut."""
        go, fail, popped = self.plain
        node = count = 0
        for b in text:
            while (to := go.get(node << 8 | b, -1)) < 0:
                count += popped[node]
                node = fail[node]
                if node < 0:
                    return -1
            node = to
        while node:
            count += popped[node]
            node = fail[node]
            if node < 0:
                return -1
        return count

    def counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, prefix: bytes = b"") -> np.ndarray:
        """The number of pieces of each byte range, read after prefix; -1 where it can't be cut."""
        node, count, alive = np.zeros(len(starts), np.int32), np.zeros(len(starts), np.int64), np.ones(len(starts), bool)
        lengths = ends - starts

        def feed(idx: np.ndarray, byte: np.ndarray) -> None:
            while len(idx):
                to = self.step(node[idx], byte)
                ok = to >= 0
                node[idx[ok]] = to[ok]
                idx, byte = idx[~ok], byte[~ok]
                dead = self.fail[node[idx]] < 0
                alive[idx[dead]] = False
                idx, byte = idx[~dead], byte[~dead]
                count[idx] += self.popped[node[idx]]
                node[idx] = self.fail[node[idx]]

        for b in prefix:
            feed(np.arange(len(starts)), np.full(len(starts), b, np.uint8))
        short = np.flatnonzero(lengths <= LONG)
        short = short[np.argsort(-lengths[short], kind="stable")]
        sizes = lengths[short]
        for i in range(int(sizes[0]) if len(short) else 0):
            short = short[: np.searchsorted(-sizes, -i, side="left")]
            sizes = sizes[: len(short)]
            idx = short[alive[short]]
            feed(idx, data[starts[idx] + i])
        left = np.flatnonzero((lengths <= LONG) & alive & (node != 0))
        while len(left):
            dead = self.fail[node[left]] < 0
            alive[left[dead]] = False
            left = left[~dead]
            count[left] += self.popped[node[left]]
            node[left] = self.fail[node[left]]
            left = left[node[left] != 0]
        for i in np.flatnonzero(lengths > LONG).tolist():
            found = self.word(prefix + data[starts[i] : ends[i]].tobytes())
            alive[i], count[i] = found >= 0, found
        return np.where(alive, count, -1)

    def pieces(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """counts() of words that follow a space; each distinct word is read once."""
        _, first, which = np.unique(tk.hashes(data, starts, ends), return_index=True, return_inverse=True)
        return self.counts(data, starts[first], ends[first], b" ")[which]


def build(vocabulary: list[bytes]) -> Automaton:
    """The automaton of a vocabulary; empty pieces are ignored."""
    # the trie, level by level: the distinct prefixes of each length
    nodes: dict[bytes, int] = {b"": 0}
    order: list[tuple[int, int, bool]] = [(0, 0, False)]  # parent, byte, is a piece
    pieces = {v for v in vocabulary if v}
    prefixes = sorted({p[:i] for p in pieces for i in range(1, len(p) + 1)}, key=lambda p: (len(p), p))
    for p in prefixes:
        nodes[p] = len(order)
        order.append((nodes[p[:-1]], p[-1], p in pieces))
    n = len(order)
    size = 1 << int(np.ceil(np.log2(max(n * 2, 2))))
    keys, values = np.zeros(size, np.uint64), np.zeros(size, np.int32)
    go: dict[int, int] = {}
    for i, (parent, byte, _) in enumerate(order[1:], 1):
        key = (parent << 8 | byte) + 1
        go[key] = i
        at = (((key * 0x9E3779B97F4A7C15) & (2**64 - 1)) >> 30) & (size - 1)
        while keys[at]:
            at = (at + 1) & (size - 1)
        keys[at], values[at] = key, i
    fail, popped = [-1] * n, [0] * n
    for i, (parent, byte, piece) in enumerate(order[1:], 1):
        if piece:  # the whole string is one piece
            fail[i], popped[i] = 0, 1
            continue
        z, count = fail[parent], popped[parent]
        while z >= 0 and (z << 8 | byte) + 1 not in go:
            count += popped[z]
            z = fail[z]
        if z >= 0:
            fail[i], popped[i] = go[(z << 8 | byte) + 1], count
    return Automaton(keys, values, np.array(fail, np.int32), np.array(popped, np.int32), size - 1)


@lru_cache(2)
def automaton(path: str) -> Automaton:
    return build(byte_vocabulary(path))


def count(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: doc_id, n_words, n_tokens, n_unknown.

    docs has doc_id and text; words are what white space separates. n_tokens counts the pieces of all words, a word
    that can't be cut counting as one unknown piece (n_unknown). NULL and empty texts have none; texts and words of any
    length are read whole, in time linear in their bytes and some 50 bytes of memory for each byte of one text; a row
    whose doc_id is NULL is counted like others; repeated rows are counted one by one, and ties can't arise; an empty
    table gives an empty result; other columns are not read, whatever their names. path is a tokenizer file, read on
    the driver; the automaton is broadcast, its size being the vocabulary's.
    """
    shared = docs.sparkSession.sparkContext.broadcast(automaton(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        for batch in batches:
            for part in tk.pieces(batch, "text"):
                data, offsets = tk.raw(part.column("text"))
                starts, ends, rows = tk.runs(~tk.is_space(data), offsets)
                found = machine.pieces(data, starts, ends)
                n = part.num_rows
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": part.column("doc_id"),
                        "n_words": pa.array(np.bincount(rows, minlength=n), pa.int64()),
                        "n_tokens": pa.array(np.bincount(rows, weights=np.where(found < 0, 1, found), minlength=n).astype(np.int64)),
                        "n_unknown": pa.array(np.bincount(rows[found < 0], minlength=n), pa.int64()),
                    }
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")
