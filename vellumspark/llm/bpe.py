"""Byte-level BPE encoding and decoding (operator 3).

The merges are compiled into a finite-state transducer whose deterministic states are made when a text first
needs them. A state stands for what the bytes read so far still leave open inside one pre-token: the *live*
positions, at which a token may begin that ends after the bytes read so far (the text from there is a proper
prefix of some token), and the position after the last byte; for each of them, the token that ends there in the
only encoding of the bytes before it.

An encoding is the one that BPE makes if and only if each two neighbouring tokens, put together, are again
encoded as those two (and a lone token as itself); so reading a byte adds one position, whose last token is the
only one that begins at a live position and agrees with the token before it. The transducer notes that token for
each byte, and the encoding is read from these notes, from the last byte back: the token that ends there, then the
one that ends where it begins. What came before the tokens at live positions isn't part of a state, so that words
of different beginnings share states. Live positions reach back by the longest token at most.

Decoding runs an incremental UTF-8 state machine over token ids; its moves over whole tokens are kept too.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import sys
from array import array
from collections.abc import Callable, Iterable, Sequence
from itertools import accumulate, chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumspark.llm.kept import kept

#: Bounds of what a Python worker keeps: pre-tokens with their ids, moves of the transducer, pairs of tokens.
KEPT_WORDS, KEPT_MOVES, KEPT_PAIRS = 1 << 19, 1 << 19, 1 << 17
#: Rows of a batch of results, which holds their ids.
BATCH = 512


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file of a byte-level vocabulary: lines of base64 token and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}


class Transducer:
    """Encodes pre-tokens. ``ranks`` must hold the 256 single bytes."""

    def __init__(self, ranks: dict[bytes, int], kept_moves: int = KEPT_MOVES):
        self.kept_moves = kept_moves
        self.ranks = ranks  # a merge makes a token of higher rank than its parts have
        self.token = {i: token for token, i in ranks.items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.halves = {i: self._halves(token) for token, i in ranks.items()}
        self.length = {i: len(token) for token, i in ranks.items()}
        self._grow()
        self.ids, self.states, self.last, self.moves, self.turn = {}, [], [], {}, 0
        self._reset()

    @property
    def n_moves(self) -> int:
        return len(self.moves)

    def _grow(self) -> None:
        """The tree of all tokens' beginnings: from node << 8 | byte to a node, its token or None, and whether it goes on."""
        self.step, self.ending, self.inner = {}, [None], [True]
        for token, i in self.ranks.items():
            node = 0
            for byte in token:
                self.inner[node] = True
                to = self.step.setdefault(node << 8 | byte, len(self.ending))
                if to == len(self.ending):
                    self.ending.append(None)
                    self.inner.append(False)
                node = to
            self.ending[node] = i

    def _reset(self) -> None:
        """Forgets all moves, in the tables that are in use."""
        # A state: node of the text since then and last token, for each live position and the end; -1 at the start.
        start = (0, -1)
        self.turn += 1
        self.ids.clear()
        self.moves.clear()  # from state << 8 | byte
        self.ids[start], self.states[:], self.last[:] = 0, [start], [-1]

    def _halves(self, token: bytes) -> tuple[int, int]:
        """The two tokens that the last merge of a token puts together; (-1, -1) for a single byte."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                raise ValueError("the ranks aren't those of a byte-level BPE vocabulary")
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2 and max(self.ranks[parts[0]], self.ranks[parts[1]]) >= self.ranks[token]:
            raise ValueError("the ranks aren't those of a byte-level BPE vocabulary")
        return (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else (-1, -1)

    def agree(self, left: int, right: int) -> bool:
        """Whether BPE leaves the two tokens apart. Their merges are undone from the seam, the latest first; as
        long as a symbol on either side stands there, no merge across the seam may come before it is used up."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            token, halves, get = self.token, self.halves, self.ranks.get
            known, a, b, a_ends, b_ends = True, left, right, 1 << 60, 1 << 60
            while left >= 0:
                across = get(token[a] + token[b])
                if across is not None and across < a_ends and across <= b_ends:
                    known = False
                    break
                inner, outer = halves[a][1], halves[b][0]
                if inner >= 0 and (outer < 0 or a > b):
                    a_ends, a = a, inner
                elif outer >= 0:
                    b_ends, b = b, outer
                else:
                    break
            self.pairs[left, right] = known
        return known

    def _state(self, key: tuple) -> int:
        to = self.ids.get(key)
        if to is None:
            to = self.ids[key] = len(self.states)
            self.states.append(key)
            self.last.append(key[-1])
        return to

    def _move(self, state: int, byte: int) -> int:
        if len(self.moves) >= self.kept_moves:  # also inside a long pre-token: the state that is reached stays
            here = self.states[state]
            self._reset()
            state = self._state(here)
        step, ending, inner, found, still = self.step.get, self.ending, self.inner, [], []
        live = iter(self.states[state])
        for node, before in zip(live, live, strict=True):
            node = step(node << 8 | byte)
            if node is None:
                continue
            if ending[node] is not None:
                found.append((before, ending[node]))
            if inner[node]:
                still += node, before
        if len(found) > 1:  # else it is the only one that can end here
            found = [pair for pair in found if self.agree(*pair)]
        if len(found) != 1:
            raise ValueError("the ranks aren't those of a byte-level BPE vocabulary")
        to = self.moves[state << 8 | byte] = self._state((*still, 0, found[0][1]))
        return to

    def encode(self, piece: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        state, known, move, turn = 0, self.moves.get, self._move, self.turn
        path = [state := known(state << 8 | byte) or move(state, byte) for byte in piece]  # no move leads to the start
        if self.turn == turn:
            return self._back(path, self.last)
        state, ends = 0, []  # moves were forgotten on the way, and with them the numbers of states
        for byte in piece:
            state = known(state << 8 | byte) or move(state, byte)
            ends.append(self.last[state])
        return self._back(range(len(ends)), ends)

    def _back(self, path: Sequence[int], last: list[int]) -> tuple[int, ...]:
        """The tokens, from the last byte back."""
        out, at, length = [], len(path), self.length
        while at:
            token = last[path[at - 1]]
            out.append(token)
            at -= length[token]
        return tuple(out[::-1])


class Words(dict):
    """Pre-token -> ids; makes what is missing with the transducer. Of two generations, each half of what is kept, the
    older goes when the younger is full; words that are met again move to the younger, so frequent ones stay."""

    def __init__(self, transducer: Transducer, kept: int = KEPT_WORDS):
        self.encode, self.kept, self.older = transducer.encode, max(1, kept // 2), {}

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.older.get(word)
        if ids is None:
            ids = self.encode(word.encode())
        if len(word) <= 64:
            if len(self) >= self.kept:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


#: State of the UTF-8 machine: (bytes still to come, least and greatest next byte, bytes pending).
CLEAN = (0, 0x00, 0xFF, b"")


def utf8_move(state: tuple[int, int, int, bytes], byte: int) -> tuple[str, tuple[int, int, int, bytes]]:
    """One byte: the text that is complete now, and the next state. A malformed sequence gives U+FFFD once for
    its longest well-formed prefix, as decoders with replacement do."""
    left, low, high, pending = state
    if left:
        if low <= byte <= high:
            pending += bytes((byte,))
            return ("", (left - 1, 0x80, 0xBF, pending)) if left > 1 else (pending.decode(), CLEAN)
        text, after = utf8_move(CLEAN, byte)
        return "�" + text, after
    if byte < 0x80:
        return chr(byte), CLEAN
    for first, last, more, low, high in ((0xC2, 0xDF, 1, 0x80, 0xBF), (0xE0, 0xE0, 2, 0xA0, 0xBF), (0xE1, 0xEC, 2, 0x80, 0xBF), (0xED, 0xED, 2, 0x80, 0x9F), (0xEE, 0xEF, 2, 0x80, 0xBF), (0xF0, 0xF0, 3, 0x90, 0xBF), (0xF1, 0xF3, 3, 0x80, 0xBF), (0xF4, 0xF4, 3, 0x80, 0x8F)):
        if first <= byte <= last:
            return "", (more, low, high, bytes((byte,)))
    return "�", CLEAN


class Decoder:
    """Token ids to text, in any number of pieces; ``flush`` ends the stream."""

    def __init__(self, token: dict[int, bytes]):
        self.token = token
        self.rows: dict[tuple, dict] = {}
        self.clean = self.row = self._row(CLEAN)
        #: What a token gives that begins and ends between characters; None for others.
        self.whole = {i: text if row is self.clean else None for i in token for text, row in [self._move(self.clean, i)]}

    def _row(self, state: tuple) -> dict:
        # The row holds its own state under None, and for each token the text and the next row.
        return self.rows.setdefault(state, {None: state})

    def _move(self, row: dict, token: int) -> tuple[str, dict]:
        state, out = row[None], []
        for byte in self.token[token]:
            text, state = utf8_move(state, byte)
            out.append(text)
        row[token] = found = ("".join(out), self._row(state))
        return found

    def feed(self, ids: Iterable[int]) -> str:
        """The text that is complete with these ids."""
        ids = list(ids)
        texts = list(map(self.whole.__getitem__, ids))
        at, row = 0, self.row
        while True:
            while row is not self.clean and at < len(ids):
                texts[at], row = row.get(ids[at]) or self._move(row, ids[at])
                at += 1
            try:
                at = texts.index(None, at)
            except ValueError:
                self.row = row
                return "".join(texts)
            texts[at], row = self.clean[ids[at]]
            at += 1

    def flush(self) -> str:
        pending, self.row = self.row[None][0], self.clean
        return "\ufffd" if pending else ""

    def decode(self, ids: Iterable[int]) -> str:
        return self.feed(ids) + self.flush()


def made(key: str, ranks: dict[bytes, int], pattern: str, share: float) -> tuple[Words, Decoder, Callable[[str], list[str]]]:
    def make():
        transducer = Transducer(ranks, int(share * KEPT_MOVES))
        return Words(transducer, int(share * KEPT_WORDS)), Decoder(transducer.token), regex.compile(pattern).findall

    return kept(f"bpe {share} {key}", make)


def little_endian(ids: Iterable[int]) -> bytes:
    """The ids as unsigned 32-bit integers."""
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


def encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, share: float = 1.0) -> DataFrame:
    """Encodes and decodes again every whole text: ``id_col``, n_tokens, ids_sha256, decoded_sha256 and, unless
    with_ids is False, ids.

    A null text counts as empty: no tokens, the digests of no bytes. Rows aren't joined or grouped, so equal texts,
    equal ids and null ids each keep their row; an empty table gives none. Other columns are not read, whatever
    their names. No shuffle: each row is done where it is read; a worker holds one Arrow batch, one text's ids and
    tables of bounded size. ``ranks`` is broadcast; it is a vocabulary file and doesn't grow with the data. ``share`` scales the tables that a worker
    keeps, for executors with less memory; the result is the same.
    """
    shared = df.sparkSession.sparkContext.broadcast(ranks)
    key = hashlib.sha256(repr((sorted(ranks.items()), pattern)).encode()).hexdigest()
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        words, decoder, split = made(key, shared.value, pattern, share)
        gc.disable()  # the tables grow by many small tuples without cycles, which the collector would visit again and again
        try:
            for batch in batches:
                for k in range(0, batch.num_rows, BATCH):
                    yield one(batch.slice(k, BATCH), words, decoder, split)
        finally:
            gc.enable()

    def one(batch, words, decoder, split):
        counts, packed, back, kept = [], [], [], []
        for text in batch.column(1):
            raw = text.as_py() or b""
            ids = list(chain.from_iterable(map(words.__getitem__, split(raw.decode("utf-8", "replace")))))
            counts.append(len(ids))
            packed.append(hashlib.sha256(little_endian(ids)).hexdigest())
            back.append(hashlib.sha256(decoder.decode(ids).encode()).hexdigest())
            if with_ids:
                kept.append(pa.array(ids, pa.int32()))
        columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(packed, pa.string()), pa.array(back, pa.string())]
        if with_ids:
            offsets = pa.array([0, *accumulate(map(len, kept))], pa.int32())
            columns.append(pa.ListArray.from_arrays(offsets, pa.concat_arrays(kept) if kept else pa.array([], pa.int32())))
        return pa.RecordBatch.from_arrays(columns, ["id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)

