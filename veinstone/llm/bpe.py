"""Byte-level BPE by a lazily determinised finite-state transducer.

The merge ranks are read as a non-deterministic transducer.  A configuration is a partly read
token (a node of the trie of all tokens) plus the tokens emitted so far; when a node spells a
token, that token may be emitted if it may *follow* its predecessor.  ``t`` may follow ``s`` when
merging the bytes of ``s + t`` by rank gives back exactly ``[s, t]``; a token sequence is the BPE
encoding of its bytes precisely when every adjacent pair has this property, so after every byte
exactly one configuration ends on a token boundary.

Subset construction makes this deterministic.  A state holds its live configurations with the
output that they don't share yet; what they share is emitted at once.  A configuration reads at
most one token ahead, so the delay of the output is bounded by the longest token.  States and
transitions are made when text first needs them and kept up to a limit; reaching the limit only
drops the memory of states, never text.

Decoding maps ids to bytes and steps a UTF-8 automaton token by token; it holds back at most the
bytes of one unfinished character.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Broadcast vocabularies may have at most so many bytes; larger rank files are refused.
MAX_RANK_BYTES = 64 << 20
#: Pre-tokens and states that a worker remembers, by default.
MAX_PIECES, MAX_STATES = 300_000, 80_000


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Lines of base64 token and rank."""
    return {base64.b64decode(tok): int(rank) for tok, rank in map(bytes.split, data.splitlines()) if tok}


class Transducer:
    """``encode(piece)`` gives the ids of one pre-token as little-endian unsigned 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("a byte-level vocabulary has a token for each of the 256 bytes")
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.max_states = max_states
        self.trie: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]
        for token, i in ranks.items():
            at = 0
            for b in token:
                step = self.trie[at].get(b)
                if step is None:
                    step = self.trie[at][b] = len(self.trie)
                    self.trie.append({})
                    self.ends.append(-1)
                at = step
            self.ends[at] = i
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.follows: dict[tuple[int, int], bool] = {}
        self.codes = {i: i.to_bytes(4, "little") for i in self.tokens}
        self._forget()

    def _forget(self) -> None:
        # a state is (last id emitted, ((ids held back, trie node), ...)); node 0 is a boundary
        start = (-1, (((), 0),))
        self.states: list[tuple] = [start]
        self.known: dict[tuple, int] = {start: 0}
        self.moves: dict[int, tuple[int, bytes]] = {}  # by state * 256 + byte
        self.asked: set[int] = set()  # transitions that text has asked for once

    def _split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None for single bytes."""
        found = self.halves.get(token, 0)
        if found != 0:
            return found
        parts = [bytes([b]) for b in self.tokens[token]]
        while len(parts) > 2:
            ranked = [self.ranks.get(parts[i] + parts[i + 1], token) for i in range(len(parts) - 1)]
            best = min(ranked)
            if best >= token:
                raise ValueError(f"token {token} can't be made by merges of lower rank")
            at = ranked.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        pair = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        self.halves[token] = pair
        return pair

    def _may_follow(self, left: int, right: int) -> bool:
        """Whether no merge across the border comes before the merges that finished both sides.

        The border is undone backwards in time: the side that was finished later is opened, and a
        merge across the border that ranks before that side's own merge would have come first.
        """
        a, b, before = left, right, 1 << 62
        ok = True
        while True:
            across = self.ranks.get(self.tokens[a] + self.tokens[b], 1 << 62)
            if across < before:
                ok = False
                break
            opened_a, opened_b = self._split(a), self._split(b)
            if opened_a is None and opened_b is None:
                break
            # of equal ranks the left one is merged first, so the right one is undone first
            if opened_b is None or (opened_a is not None and a > b):
                before, a = a, opened_a[1]
            else:
                before, b = b + 1, opened_b[0]
        if len(self.follows) > 200_000:
            self.follows.clear()
        self.follows[left, right] = ok
        return ok

    def _advance(self, last: int, live: Iterable, byte: int) -> list:
        """The configurations after one more byte."""
        trie, ends, follows = self.trie, self.ends, self.follows
        after, on_boundary = [], False
        for config in live:
            held, node = config
            node = trie[node].get(byte)
            if node is None:
                continue
            if trie[node]:
                after.append((held, node))
            if on_boundary:  # there is one such configuration
                continue
            token = ends[node]
            if token >= 0:
                before = held[-1] if held else last
                on_boundary = before < 0 or follows.get((before, token))
                if on_boundary is None:
                    on_boundary = self._may_follow(before, token)
                if on_boundary:
                    after.append(((*held, token), 0))
        return after

    def _move(self, number: int, byte: int) -> tuple[int, bytes]:
        """Determinise one transition: emit what all configurations share, and keep the rest."""
        last, live = self.states[number]
        after = self._advance(last, live, byte)
        first, shared = after[0][0], 0
        if first:
            for token in first:
                if any(held[shared : shared + 1] != (token,) for held, _ in after):
                    break
                shared += 1
            if shared:
                after = [(held[shared:], node) for held, node in after]
                last = first[shared - 1]
        key = (last, tuple(after))
        to = self.known.get(key)
        if to is None:
            to = self.known[key] = len(self.states)
            self.states.append(key)
        move = self.moves[number << 8 | byte] = (to, b"".join(map(self.codes.__getitem__, first[:shared])))
        return move

    def encode(self, piece: bytes) -> bytes:
        if len(self.states) > self.max_states or len(self.asked) > 4 * self.max_states:
            self._forget()
        at, out, known, codes = 0, [], self.moves.get, self.codes.__getitem__
        for i, byte in enumerate(piece):
            move = known(at << 8 | byte)
            if move is None:
                if at << 8 | byte not in self.asked and len(piece) <= 64:
                    # a transition is determinised when text asks for it again; now its
                    # configurations are followed to the end of this piece
                    self.asked.add(at << 8 | byte)
                    last, live = self.states[at]
                    for byte in piece[i:]:
                        live = self._advance(last, live, byte)
                    break
                move = self._move(at, byte)
            at, emitted = move
            if emitted:
                out.append(emitted)
        else:
            live = self.states[at][1]
        for held, node in reversed(live):
            if node == 0:
                out.extend(map(codes, held))
                break
        return b"".join(out)


class Encoder(dict):
    """Memory from pre-token to ids, in two generations: when the younger is full it becomes the
    older one, and what was used meanwhile moves back.  A pre-token is remembered from its second
    use; of a first use only one byte of a hash table is kept.  What isn't remembered is made
    again by the transducer."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, max_pieces: int = MAX_PIECES, max_states: int = MAX_STATES):
        super().__init__()
        self.transducer = Transducer(ranks, max_states)
        self.pieces = regex.compile(pattern).findall
        self.max_pieces = max_pieces
        self.older: dict[str, bytes] = {}
        self.once = bytearray(1 << 22)

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.transducer.encode(piece.encode())
            at = hash(piece) & 0x3FFFFF
            if not self.once[at] or len(piece) > 48:
                self.once[at] = 1
                return ids
        if len(self) >= self.max_pieces:
            self.older = self.copy()
            self.clear()
            self.once = bytearray(1 << 22)
        self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.__getitem__, self.pieces(text)))


#: First byte -> how many continuation bytes follow, and the range of the first of these.
_LEADS = [(0x00, 0x7F, 0, 0x80, 0xBF), (0xC2, 0xDF, 1, 0x80, 0xBF), (0xE0, 0xE0, 2, 0xA0, 0xBF), (0xE1, 0xEC, 2, 0x80, 0xBF), (0xED, 0xED, 2, 0x80, 0x9F), (0xEE, 0xEF, 2, 0x80, 0xBF), (0xF0, 0xF0, 3, 0x90, 0xBF), (0xF1, 0xF3, 3, 0x80, 0xBF), (0xF4, 0xF4, 3, 0x80, 0x8F)]


class Utf8:
    """Incremental UTF-8: ``step(state, byte)`` gives the next state, -1 for an ill-formed byte.

    State 0 is between characters; other states say what may follow.
    """

    def __init__(self):
        self.rows: list[dict[int, int]] = [{}]
        keys: dict[tuple[int, int, int], int] = {}

        def state(left: int, low: int, high: int) -> int:
            if not left:
                return 0
            if (left, low, high) not in keys:
                keys[left, low, high] = number = len(self.rows)
                self.rows.append({})
                then = state(left - 1, 0x80, 0xBF)
                self.rows[number].update(dict.fromkeys(range(low, high + 1), then))
            return keys[left, low, high]

        for first, last, left, low, high in _LEADS:
            self.rows[0].update(dict.fromkeys(range(first, last + 1), state(left, low, high)))

    def step(self, state: int, byte: int) -> int:
        return self.rows[state].get(byte, -1)


class Decoder:
    """Ids to bytes and, block by block, to text."""

    def __init__(self, ranks: dict[bytes, int]):
        self.utf8 = Utf8()
        self.table: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.table[i] = token
        # tokens of whole characters leave the automaton where it was
        self.whole = np.array([self._run(0, t) == 0 for t in self.table])

    def _run(self, state: int, data: bytes) -> int:
        for b in data:
            state = self.utf8.step(state, b)
            if state < 0:
                break
        return state

    def bytes_of(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.table.__getitem__, ids.tolist()))

    def ends_clean(self, ids: np.ndarray) -> bool:
        """Whether the ids spell well-formed, finished UTF-8; only tokens that are not whole
        characters are stepped."""
        state, expected = 0, -1
        for at in np.flatnonzero(~self.whole[ids]).tolist():
            if state and at != expected:
                return False
            state, expected = self._run(state, self.table[ids[at]]), at + 1
            if state < 0:
                return False
        return state == 0

    def stream(self, blocks: Iterable[np.ndarray]) -> Iterator[str]:
        """Text of each block; an unfinished character waits for the next block, and ill-formed
        bytes become U+FFFD."""
        held, state = b"", 0
        for ids in blocks:
            data = held + self.bytes_of(ids)
            keep, state = len(data), 0
            for at in range(max(0, len(data) - 3), len(data)):  # a character has 4 bytes at most
                state = self._run(0, data[at:])
                if state > 0:
                    keep = at
                    break
            held = data[keep:]
            yield data[:keep].decode("utf-8", "replace")
        if held:
            yield held.decode("utf-8", "replace")


@lru_cache(maxsize=2)
def coders(ranks: bytes, pattern: str, max_pieces: int = MAX_PIECES, max_states: int = MAX_STATES) -> tuple[Encoder, Decoder]:
    """One pair for each Python worker; later tasks find its states and pieces."""
    vocabulary = parse_ranks(ranks)
    return Encoder(vocabulary, pattern, max_pieces, max_states), Decoder(vocabulary)


def encode_decode(docs: DataFrame, ranks: bytes, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, max_pieces: int = MAX_PIECES, max_states: int = MAX_STATES) -> DataFrame:
    """Encode each whole text, decode the ids again, and digest both.

    Returns ``id_col, n_tokens, ids_sha256, decoded_sha256, well_formed`` and, ``with_ids``,
    ``ids`` (binary, unsigned 32-bit little-endian).  ``max_pieces`` and ``max_states`` bound what a worker
    remembers, not what it gives.  A map over partitions: no shuffle, memory
    bounded by one record batch and the memory limits above.  Null and empty texts have no ids
    and the digests of the empty string; repeated rows and null ids stay as they are; other
    columns of ``docs``, whatever their names, are not read.
    """
    if len(ranks) > MAX_RANK_BYTES:
        raise ValueError(f"the rank file has {len(ranks)} bytes; at most {MAX_RANK_BYTES} are broadcast")
    sent = docs.sparkSession.sparkContext.broadcast(ranks)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, well_formed boolean" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = coders(sent.value, pattern, max_pieces, max_states)
        for batch in (b.slice(lo, 1000) for b in batches for lo in range(0, b.num_rows, 1000)):
            counts, id_hashes, byte_hashes, clean, kept = [], [], [], [], []
            for text in batch.column(1):
                raw = encoder.encode(text.as_py() or "")
                ids = np.frombuffer(raw, "<u4")
                counts.append(len(ids))
                id_hashes.append(hashlib.sha256(raw).hexdigest())
                byte_hashes.append(hashlib.sha256(decoder.bytes_of(ids)).hexdigest())
                clean.append(decoder.ends_clean(ids))
                if with_ids:
                    kept.append(raw)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(id_hashes, pa.string()), pa.array(byte_hashes, pa.string()), pa.array(clean, pa.bool_())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "well_formed"]
            if with_ids:
                columns, names = [*columns, pa.array(kept, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
