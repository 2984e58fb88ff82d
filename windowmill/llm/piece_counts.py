"""Token counts by a linear longest-match automaton.

The vocabulary is a trie. Each node has a failure link, and the number of tokens
that are popped when it is followed, found once by a breadth-first walk. A word
is read byte by byte: where the trie ends, the popped tokens of the node are
added and its link followed. The result is the number of greedy longest-match
pieces, in time linear in the word, and no piece is ever built.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windowmill.llm import common

CACHE_WORDS = 400_000


class LongestMatch:
    """Counts of greedy pieces: the first from ``first``, the others from ``later``."""

    def __init__(self, first: list[bytes], later: list[bytes]):
        self.next: list[dict[int, int]] = [{}, {}]  # node 0: start of a word, node 1: after a token
        ends = {self._add(0, t) for t in first if t} | {self._add(1, t) for t in later if t}
        size = len(self.next)
        self.link, self.popped = [-1] * size, [0] * size
        queue = deque([0, 1])
        while queue:
            parent = queue.popleft()
            for byte, node in self.next[parent].items():
                queue.append(node)
                if node in ends:
                    self.link[node], self.popped[node] = 1, 1
                    continue
                count, z = self.popped[parent], self.link[parent]
                while z >= 0 and byte not in self.next[z]:
                    count += self.popped[z]
                    z = self.link[z]
                if z >= 0:
                    self.link[node], self.popped[node] = self.next[z][byte], count

    def _add(self, node: int, token: bytes) -> int:
        for byte in token:
            if byte not in self.next[node]:
                self.next[node][byte] = len(self.next)
                self.next.append({})
            node = self.next[node][byte]
        return node

    def count(self, word: bytes) -> int:
        """Pieces of a word; 1 if the vocabulary cannot spell it; 0 if it is empty."""
        node = total = 0
        step, link, popped = self.next, self.link, self.popped
        for byte in word:
            while (to := step[node].get(byte)) is None:
                total += popped[node]
                node = link[node]
                if node < 0:
                    return 1
            node = to
        while node > 1:
            total += popped[node]
            node = link[node]
            if node < 0:
                return 1
        return total


def byte_level(path: str) -> LongestMatch:
    """The automaton of a byte-level vocabulary, where a word starts with its space."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    byte = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
    tokens = [bytes(byte[c] for c in t) for t in vocab if all(c in byte for c in t)]
    return LongestMatch(tokens, [t for t in tokens if not t.startswith(b" ")])


_automata: dict[str, LongestMatch] = {}
_counts: dict[str, dict[bytes, int]] = {}


def piece_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row, without a shuffle: doc_id, n_words, n_tokens.

    Words stand between ASCII white space, and each is matched with a space before
    it. A null or empty text, or one of white space, has no words. Null and repeated
    ids stay as they are; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _automata:
            _automata[vocabulary], _counts[vocabulary] = byte_level(vocabulary), {}
        count, known = _automata[vocabulary].count, _counts[vocabulary]
        for batch in batches:
            n_words, n_tokens = [], []
            for text in batch["text"].to_pylist():
                words = (text or "").encode("utf-8", "surrogatepass").split()
                n_words.append(len(words))
                total = 0
                for a in range(0, len(words), 20_000):
                    part = words[a : a + 20_000]
                    if len(known) > CACHE_WORDS:
                        known.clear()
                    for w in set(part).difference(known):
                        known[w] = count(b" " + w)
                    total += sum(map(known.__getitem__, part))
                n_tokens.append(total)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, n_words long, n_tokens long")


def query(spark, sf_dir: str) -> DataFrame:
    """op9: greedy longest-match token counts of all documents."""
    import public_tokenizers

    return piece_counts(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
