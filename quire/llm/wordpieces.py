"""Token counts by a longest-match automaton that never builds a piece."""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of which a task remembers the count; the store is emptied when full.
REMEMBERED = 200_000


class Automaton:
    """Counts the greedy longest-match pieces of a byte string in one pass.

    The vocabulary is a trie. From each node, ``fail`` leads to the node that
    stands for what is left of its string after the longest pieces at its
    beginning are taken off, and ``popped`` is how many pieces that takes; both
    are made once, breadth first. Reading a byte that the trie doesn't hold
    adds the popped count and follows the link, so that a string of n bytes
    takes no more than 2n steps whatever the pieces.

    Every byte that occurs alone in the vocabulary can be matched; a byte that
    no piece begins with counts as a piece of its own.
    """

    def __init__(self, vocabulary: list[bytes]):
        self.step: list[dict[int, int]] = [{}]
        whole = [False]
        depth = [0]
        for piece in {p for p in vocabulary if p} | {bytes([b]) for b in range(256)}:
            at = 0
            for b in piece:
                to = self.step[at].get(b)
                if to is None:
                    to = self.step[at][b] = len(self.step)
                    self.step.append({})
                    whole.append(False)
                    depth.append(depth[at] + 1)
                at = to
            whole[at] = True
        self.fail, self.popped = [0] * len(self.step), [0] * len(self.step)
        todo = deque([0])
        while todo:
            node = todo.popleft()
            for b, child in self.step[node].items():
                todo.append(child)
                if whole[child]:
                    # All of the string is a piece: it is popped, and nothing is left.
                    self.fail[child], self.popped[child] = 0, 1
                    continue
                # The string of the node is popped down until what is left takes the byte.
                at, n = self.fail[node], self.popped[node]
                while b not in self.step[at]:
                    n += self.popped[at]
                    at = self.fail[at]
                self.fail[child], self.popped[child] = self.step[at][b], n

    def count(self, text: bytes) -> int:
        step, fail, popped = self.step, self.fail, self.popped
        at = n = 0
        for b in text:
            to = step[at].get(b)
            while to is None:
                n += popped[at]
                at = fail[at]
                to = step[at].get(b)
            at = to
        while at:
            n += popped[at]
            at = fail[at]
        return n


def load_ranks(path: str) -> list[bytes]:
    """Pieces of a rank file: a base64 piece and a number on each line."""
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


def count_tokens(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """(doc_id, n_words, n_tokens) for every row of docs(doc_id, text).

    A word is ``[^\\x20\\x09-\\x0D]+``; with one space before it, it is cut
    greedily into the longest pieces of the vocabulary. n_tokens is how many
    there are. The vocabulary is broadcast: its size is that of a tokenizer's
    file, whatever the input.

    Null and empty texts count 0. Rows are independent, so repeats and null ids
    stay as they come. Extra columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(b"\n".join(map(base64.b64encode, vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton([base64.b64decode(x) for x in shared.value.split(b"\n")])
        known: dict[bytes, int] = {}
        for batch in batches:
            words, tokens = [], []
            for text in batch.column(1):
                split = (text.as_py() or "").encode().split()
                n = 0
                for w in split:
                    k = known.get(w)
                    if k is None:
                        k = automaton.count(b" " + w)
                        if len(w) < 64:
                            if len(known) >= REMEMBERED:
                                known.clear()
                            known[w] = k
                    n += k
                words.append(len(split))
                tokens.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(words, np.int64)), pa.array(np.array(tokens, np.int64))], ["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, n_words bigint, n_tokens bigint")
