"""Token counts by greedy longest match in linear time (operator 9).

The vocabulary is a trie. A node that is no piece has a failure link to the node that stands for what is left after
the pieces are popped that greedy matching would take, and the number of these pieces. So a word's count is found
in one pass, without going back and without making pieces.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumspark.llm.kept import kept

KEPT_WORDS = 1 << 18
#: Begins a word, as in the vocabulary.
MARK = "▁"


class Automaton:
    def __init__(self, pieces: Iterable[str]):
        self.next: list[dict[str, int]] = [{}]
        ends = set()
        for piece in pieces:
            node = 0
            for c in piece:
                to = self.next[node].get(c)
                if to is None:
                    to = self.next[node][c] = len(self.next)
                    self.next.append({})
                node = to
            if node:
                ends.add(node)
        self.fail, self.popped = [-1] * len(self.next), [0] * len(self.next)
        queue = deque([0])
        while queue:
            parent = queue.popleft()
            for c, node in self.next[parent].items():
                queue.append(node)
                if node in ends:
                    self.fail[node], self.popped[node] = 0, 1
                    continue
                at, n = self.fail[parent], self.popped[parent]
                while at >= 0 and c not in self.next[at]:
                    n += self.popped[at]
                    at = self.fail[at]
                if at >= 0:
                    self.fail[node], self.popped[node] = self.next[at][c], n

    def count(self, word: str) -> int:
        """Pieces of the word; -1 if greedy matching comes to where no piece fits."""
        node, n = 0, 0
        for c in word:
            while c not in self.next[node]:
                if self.fail[node] < 0:
                    return -1
                n += self.popped[node]
                node = self.fail[node]
            node = self.next[node][c]
        while node:
            if self.fail[node] < 0:
                return -1
            n += self.popped[node]
            node = self.fail[node]
        return n


class _Counts(dict):
    def __init__(self, pieces: Iterable[str]):
        self.count = Automaton(pieces).count

    def __missing__(self, word: str) -> int:
        n = self.count(MARK + word)
        if len(word) <= 64:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = n
        return n


def read_pieces(path: str) -> list[str]:
    """The ordinary pieces of a sentencepiece vocabulary file, without control, unknown and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]


def token_counts(df: DataFrame, pieces: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_words, n_tokens, n_unknown of every whole text.

    Words are what white space parts; each counts its greedy pieces, or one token (and one unknown) if there is a
    place where none fits. Null and empty texts count 0. Rows aren't joined or grouped, so repeated rows and null ids
    stay; only the two columns are read. ``pieces`` is broadcast; a vocabulary doesn't grow with the data.
    """
    key = "pieces " + hashlib.sha256("\n".join(pieces).encode()).hexdigest()
    shared = df.sparkSession.sparkContext.broadcast(pieces)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        count = kept(key, lambda: _Counts(shared.value)).__getitem__
        for batch in batches:
            words, tokens, unknown = [], [], []
            for text in batch.column(1):
                found = list(map(count, (text.as_py() or b"").decode("utf-8", "replace").split()))
                missed = found.count(-1)
                words.append(len(found))
                tokens.append(sum(found) + 2 * missed)
                unknown.append(missed)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (words, tokens, unknown))], ["id", "n_words", "n_tokens", "n_unknown"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_words long, n_tokens long, n_unknown long").withColumnRenamed("id", id_col)
