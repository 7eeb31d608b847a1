"""Byte-level BPE as a lazily determinised transducer, and streaming decoding.

The merges are given as ranks of byte strings. Compiled, they are a nondeterministic transducer over bytes: a thread
stands at a node of the vocabulary's trie, reading one token that began at some boundary, and knows the token before that
boundary. When the node is a token that may follow (no merge crosses their boundary), a new thread starts behind it. Of the threads ending at a byte exactly one may, so the encoding of every prefix is one chain.
Determinisation is lazy: sets of threads become states, and transitions are worked out when first met. Threads carry what
they have not yet agreed on; as soon as all that live share a first token it is written. A thread lives no longer
than the longest token, which bounds the lookahead. Both tables are dropped when they reach a fixed size.

Text is split by the tokenizer's pattern beforehand, and a piece that is itself in the vocabulary is that token. Results
equal those of the ``tiktoken`` library; special tokens are ordinary text. Null texts are empty and have no ids.

Scale: rows are encoded where they are, with no shuffle; the ranks (their size is checked) are shipped once per
executor; texts go through in bounded slices and pieces of a long text in bounded groups.

Defined results: every row is encoded on its own, so repeated rows, ties and null ids give as many results; an empty table gives
an empty result; other columns, whatever their names, are left alone.
"""

import base64
import struct
from collections.abc import Iterator
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadsift.llm.batches import bounded
from roadsift.llm.texts import utf8

#: States, pairs and pieces remembered per task before the tables start anew.
MOST_STATES = 150_000
MOST_PAIRS = 300_000
MOST_PIECES = 200_000
#: Pieces or ids of a text that are handled at a time.
GROUP = 65_536
#: A vocabulary is shipped to every executor; larger files are refused.
MOST_VOCABULARY_BYTES = 64 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file: base64 of a token's bytes and its rank per line."""
    with open(path, "rb") as lines:
        content = lines.read(MOST_VOCABULARY_BYTES + 1)
    if len(content) > MOST_VOCABULARY_BYTES:
        raise ValueError(f"{path} is too large for a vocabulary")
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines())}


class Transducer:
    """Encodes byte strings by ranks; states are determined as they are met."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.edges: dict[int, int] = {}  # (node, byte) to node; the root is 0
        self.token_at: dict[int, int] = {}
        self.inner: set[int] = set()  # nodes with an edge going on
        count = 0
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                self.inner.add(node)
                key = node << 8 | byte
                if key not in self.edges:
                    count += 1
                    self.edges[key] = count
                node = self.edges[key]
            self.token_at[node] = rank
        self.pairs: dict[int, bool] = {}  # (token before or -1, token)
        self.halves: dict[int, tuple] = {}
        self._restart()

    def _restart(self) -> None:
        self.states: list[tuple] = []
        self.numbers: dict[tuple, int] = {}
        self.table: dict[int, int] = {}  # (state, byte) to the next state, or to its complement if tokens are written
        self.outputs: dict[int, tuple] = {}
        self._number(((0, -1, ()),))

    def _number(self, threads: tuple) -> int:
        number = self.numbers.get(threads)
        if number is None:
            number = self.numbers[threads] = len(self.states)
            self.states.append(threads)
        return number

    def _merge(self, text: bytes, until: int) -> list[bytes]:
        """The parts of a byte string after merging the neighbours of lowest rank down to so many parts at least."""
        parts = [text[at : at + 1] for at in range(len(text))]
        while len(parts) > until:
            ranked = [self.ranks.get(a + b) for a, b in zip(parts, parts[1:])]
            best = min((rank for rank in ranked if rank is not None), default=None)
            if best is None:
                break
            at = ranked.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _halves(self, token: int) -> tuple[int, int] | tuple[()]:
        """The two tokens whose merge made this one; empty for a byte or a token that merging never makes."""
        found = self.halves.get(token)
        if found is None:
            text = self.bytes_of[token]
            parts = self._merge(text, 2) if len(text) > 1 else []
            made = len(parts) == 2 and parts[0] + parts[1] == text
            found = self.halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if made else ()
        return found

    def _made(self, token: int) -> bool:
        """Whether merging makes the token."""
        return len(self.bytes_of[token]) == 1 or self._halves(token) != ()

    def _meets(self, left: int, right: int) -> bool:
        """Whether two tokens stay apart when their bytes are merged together.

        Merges are undone from the last to the first. Whenever a half next to the boundary is laid bare, it and its
        neighbour must not have a merge across the boundary that would have come before the one just undone; equal
        ranks merge from the left.
        """
        ranks, bytes_of, before = self.ranks, self.bytes_of, len(self.ranks)
        halves, others = self._halves(left), self._halves(right)
        while True:
            if ranks.get(bytes_of[left] + bytes_of[right], before) < before:
                return False
            if halves and (not others or left > right):
                before, left = left, halves[1]
                halves = self._halves(left)
            elif others:
                before, right = right + 1, others[0]
                others = self._halves(right)
            else:
                return True

    def _follows(self, before: int, token: int) -> bool:
        """Whether the token may stand after the other one, or (-1) at the start."""
        known = self.pairs.get(before << 32 | token)
        if known is None:
            if len(self.pairs) >= MOST_PAIRS:
                self.pairs.clear()
            known = self.pairs[before << 32 | token] = self._made(token) and (before < 0 or self._meets(before, token))
        return known

    def _step(self, state: int, byte: int) -> int:
        """Works out a state's transition on a byte and remembers it."""
        edges, token_at, pairs, inner = self.edges, self.token_at, self.pairs, self.inner
        alive, born = [], None
        for node, before, held in self.states[state]:
            child = edges.get(node << 8 | byte)
            if child is None:
                continue
            if born is None:
                token = token_at.get(child)
                if token is not None:
                    follows = pairs.get(before << 32 | token)
                    if follows is None:
                        follows = self._follows(before, token)
                    if follows:
                        born = (0, token, (*held, token))
            if child in inner:
                alive.append((child, before, held))
        written = ()
        if alive and not alive[0][2]:  # the oldest thread has nothing to write yet
            alive.append(born)
        else:
            alive.append(born)
            shortest = min([held for _, _, held in alive], key=len)
            sure = 0
            while sure < len(shortest) and all(held[sure] == shortest[sure] for _, _, held in alive):
                sure += 1
            if sure:
                written = shortest[:sure]
                alive = [(node, before, held[sure:]) for node, before, held in alive]
        following = self._number(tuple(alive))
        if written:
            self.outputs[state << 8 | byte] = written
            following = ~following
        self.table[state << 8 | byte] = following
        return following

    def _last(self, state: int, byte: int) -> tuple:
        """What is still to be written when a piece ends with the byte; no state is made for it."""
        for node, before, held in self.states[state]:
            token = self.token_at.get(self.edges.get(node << 8 | byte))
            if token is not None and self._follows(before, token):
                return (*held, token)
        raise ValueError("the vocabulary lacks a byte")

    def encode(self, piece: bytes) -> list[int]:
        """The tokens of one piece."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.states) > MOST_STATES:
            self._restart()
        state, out, table = 0, [], self.table
        for byte in piece[:-1]:
            following = table.get(state << 8 | byte)
            if following is None:
                following = self._step(state, byte)
            if following < 0:
                out += self.outputs[state << 8 | byte]
                following = ~following
            state = following
        if piece:
            out += self._last(state, piece[-1])
        return out


class Encoder(dict):
    """Packed ids (little-endian, 32 bits) by piece; a missing piece goes through the transducer."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.transducer = Transducer(ranks)
        self.pattern = regex.compile(pattern)
        self.older: dict[str, bytes] = {}  # the generation before this one

    def __missing__(self, piece: str) -> bytes:
        packed = self.older.get(piece)
        if packed is None:
            ids = self.transducer.encode(piece.encode())
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= 64:  # long pieces seldom come back
            if len(self) >= MOST_PIECES:
                self.older = dict(self)
                self.clear()
            self[piece] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """The packed ids of a text."""
        if len(text) <= 4 * GROUP:
            return b"".join(map(self.__getitem__, self.pattern.findall(text)))
        found = (match.group() for match in self.pattern.finditer(text))
        return b"".join(iter(lambda: b"".join(map(self.__getitem__, islice(found, GROUP))), b""))


class Utf8Stream:
    """An incremental UTF-8 reader: text comes out as soon as its bytes are complete."""

    #: Fixed values of UTF-8: the bytes that a character has, by the upper five bits of its first; 0 inside one.
    LENGTHS = [1] * 16 + [0] * 8 + [2] * 4 + [3] * 2 + [4] + [1]

    def __init__(self):
        self.rest = b""

    def feed(self, chunk: bytes) -> str:
        """The complete characters; the start of an incomplete last one is kept. Broken bytes raise."""
        data = self.rest + chunk
        end = len(data)
        for back in range(1, min(4, len(data)) + 1):
            wanted = self.LENGTHS[data[-back] >> 3]
            if wanted:
                end -= back if wanted > back else 0
                break
        self.rest = data[end:]
        return data[:end].decode()

    def close(self) -> None:
        if self.rest:
            raise ValueError("the text ends inside a character")


def by_id(ranks: dict[bytes, int]) -> pa.Array:
    """The bytes of every id, null where there is none."""
    tokens: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return pa.array(tokens, pa.binary())


def decode_stream(ids: bytes, tokens: pa.Array) -> Iterator[str]:
    """The text of packed ids, bit by bit. Unknown ids raise."""
    stream = Utf8Stream()
    for start in range(0, len(ids), 4 * GROUP):
        some = tokens.take(pa.array(np.frombuffer(ids[start : start + 4 * GROUP], "<u4")))
        if some.null_count:
            raise KeyError("an id has no token")
        _, offsets, data = some.buffers()
        yield stream.feed(data.to_pybytes()[: np.frombuffer(offsets, np.int32)[len(some)]])
    stream.close()


_ENCODERS: dict[str, Encoder] = {}
_TOKENS: dict[str, pa.Array] = {}


def encoded(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with ``token_ids`` in place of the text: ids packed as little-endian 32-bit integers.

    A column named ``token_ids`` in the input is replaced.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(path))
    names = [name for name in docs.columns if name not in (text, "token_ids")]
    rows = docs.select(*(docs[f"`{name}`"] for name in names), utf8(docs[text]).alias("token_ids"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.get(path)
        if encoder is None or encoder.pattern.pattern != pattern:
            encoder = _ENCODERS[path] = Encoder(ranks.value, pattern)
        for batch in bounded(batches, "token_ids"):
            packed = [encoder.encode(value.as_py().decode()) for value in batch.column("token_ids")]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(packed, pa.binary())], names=batch.schema.names)

    return rows.mapInArrow(encode, rows.schema)


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """The rows with ``decoded``, the text of ``token_ids``, in place of them."""
    ranks = rows.sparkSession.sparkContext.broadcast(read_ranks(path))
    kept = [field for field in rows.schema if field.name not in ("token_ids", "decoded")]
    given = rows.select(*(rows[f"`{field.name}`"] for field in kept), rows["token_ids"].alias("token_ids"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _TOKENS:
            _TOKENS[path] = by_id(ranks.value)
        for batch in bounded(batches, "token_ids"):
            texts = ["".join(decode_stream(value.as_py() or b"", _TOKENS[path])) for value in batch.column("token_ids")]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*batch.schema.names[:-1], "decoded"])

    return given.mapInArrow(decode, T.StructType([*kept, T.StructField("decoded", T.StringType())]))


def digests(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, and decoded_sha256 of the round trip, per row of ``docs``."""
    ids = encoded(docs.select("doc_id", "text"), path, pattern)
    both = ids.select("doc_id", (F.length("token_ids") / 4).cast("long").alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"), "token_ids")
    return decoded(both, path).select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
