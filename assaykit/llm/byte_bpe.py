"""Byte-level BPE encoding and decoding by finite-state machines.

Merges are compiled into a transducer that reads a piece byte by byte. A reading of the bytes so far is the tokens it has
made and the begun bytes of the next one. Of the tokens that end at a byte only one can follow those before it: the one
whose boundary no merge of lower rank would have crossed (``Merges.compatible``), since a sequence of tokens is the merges'
result exactly if each two neighbours are. A state of the determinised machine is the set of open readings, with the
tokens in which they differ; states and transitions are made when a text first needs them. A token is emitted as soon as
all open readings share it; how far a reading stays open is bounded by the vocabulary, not by the text.

Decoding runs a UTF-8 machine over the tokens' bytes, so a character split between tokens comes out once it is whole.
"""

from __future__ import annotations

import base64
import gc
import re
import sys
from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from assaykit.llm.common import slices

#: Letters and numbers of Unicode versions after 16, first and last hexadecimal code point of each range.
#: The rank files' library knows version 16, so they are neither for it; the regex module may know them.
LATER_LETTERS = """558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959
10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DF1 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 187F8-187FF 18CD6-18CDA 18D09-18D20
18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE
1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"""
LATER_NUMBERS = "11DE0-11DE9 1246F 12475-1247F 12550-12686 16FF4-16FF6"



@lru_cache(maxsize=None)
def _char_class(name: str, end: int) -> str:
    """The code points below ``end`` of a class, as ranges for a character set."""
    later = {r"\p{L}": LATER_LETTERS, r"\p{N}": LATER_NUMBERS}.get(name, "")
    without = {c for part in later.split() for c in range(int(part.split("-")[0], 16), int(part.split("-")[-1], 16) + 1)}
    inside, found = regex.compile(name).match, []
    for c in range(end):
        if c not in without and inside(chr(c)):
            if found and found[-1][1] == c - 1:
                found[-1][1] = c
            else:
                found.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in found)


def _spelled_out(pattern: str, end: int) -> re.Pattern:
    """``pattern`` for the standard module, which has no classes by property: they are written as ranges."""

    def character_set(m: re.Match) -> str:
        return re.sub(r"\\[pP]\{\w+\}|\\[sS]", lambda c: _char_class(c[0], end), m[0])

    def alone(m: re.Match) -> str:
        return character_set(m) if m[0][0] == "[" else f"[{_char_class(m[0], end)}]" if m[0] != r"\S" else f"[^{_char_class(chr(92) + 's', end)}]"

    return re.compile(re.sub(r"\[(?:\\.|[^\]\\])*\]|\\[pP]\{\w+\}|\\[sS]", alone, pattern))


class Splitter:
    """The matches of a pattern in a text, in blocks, so that a long text never stands in memory as pieces."""

    def __init__(self, pattern: str, block: int = 1 << 16):
        self.pattern, self.block = pattern, block
        self.narrow = _spelled_out(pattern, 0x10000)
        self.wide: re.Pattern | None = None  # made if a text needs it: a longer set takes longer to search
        self.is_wide = re.compile("[\U00010000-\U0010ffff]").search

    def _find(self, text: str):
        if text.isascii() or not self.is_wide(text):
            return self.narrow.findall
        if self.wide is None:
            self.wide = _spelled_out(self.pattern, 0x110000)
        return self.wide.findall

    def blocks(self, text: str) -> Iterator[list[str]]:
        """Runs of matches, in order.

        The last three matches of a block that isn't the text's end are left to the next one: what follows may lengthen
        the last, and the choice between the pattern's alternatives looks ahead over no more than two others.
        """
        find, at, size = self._find(text), 0, self.block
        while at < len(text):
            found = find(text, at, min(len(text), at + size))
            if at + size < len(text):
                if len(found) < 4:
                    size *= 2
                    continue
                del found[-3:]
            yield found
            at, size = at + sum(map(len, found)), self.block
            if not found:
                return


class Merges:
    """A rank file: tokens by bytes, and which tokens can stand side by side; answers for ``MOST_PAIRS`` pairs are remembered."""

    MOST_PAIRS = 400_000

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.tokens = ranks, {i: token for token, i in ranks.items()}
        missing = [i for i in range(256) if bytes([i]) not in ranks]
        if missing or len(self.tokens) < len(ranks):
            raise ValueError("a byte-level vocabulary has a token for each byte, and a rank for each token alone")
        self._edges: dict[int, tuple[tuple[int, ...], tuple[int, ...]]] = {}
        self.beside: dict[int, bool] = {}

    @classmethod
    def read(cls, path: str) -> Merges:
        with open(path, "rb") as f:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)})

    def derivation(self, token: bytes) -> list[tuple[int, bytes, bytes]]:
        """The merges that make ``token`` from its bytes: rank, left and right part, in order."""
        parts, made = [token[i : i + 1] for i in range(len(token))], []
        while len(parts) > 1:
            ranked = [(self.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.ranks]
            if not ranked:
                raise ValueError(f"token {token!r} can't be made by merges")
            rank, i = min(ranked)
            made.append((rank, parts[i], parts[i + 1]))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return made

    def check(self) -> None:
        """Refuse a vocabulary in which a token isn't made by merges of rising rank: neighbours wouldn't tell the rest."""
        for token in self.ranks:
            made = [rank for rank, _, _ in self.derivation(token)]
            if made != sorted(made):
                raise ValueError(f"the merges of token {token!r} don't rise in rank")

    def edges(self, token: int) -> tuple[tuple[int, ...], tuple[int, ...]]:
        """The parts at the token's left and at its right edge, from a byte up to the whole token."""
        found = self._edges.get(token)
        if found is None:
            made = self.derivation(self.tokens[token])
            if made:
                _, left, right = made[-1]
                found = (*self.edges(self.ranks[left])[0], token), (*self.edges(self.ranks[right])[1], token)
            else:
                found = (token,), (token,)
            self._edges[token] = found
        return found

    def compatible(self, left: int, right: int) -> bool:
        """Whether the bytes of both together are merged into just these two tokens."""
        found = self.beside.get(left << 32 | right)
        if found is None:
            if len(self.beside) >= self.MOST_PAIRS:
                self.beside.clear()
            found = self.beside[left << 32 | right] = self._compatible(self.edges(left)[1], self.edges(right)[0])
        return found

    def _compatible(self, ends: tuple[int, ...], begins: tuple[int, ...]) -> bool:
        i = j = 0
        never = len(self.ranks) + max(ends[-1], begins[-1])
        while True:
            across = self.ranks.get(self.tokens[ends[i]] + self.tokens[begins[j]], never)
            left = ends[i + 1] if i + 1 < len(ends) else never
            right = begins[j + 1] if j + 1 < len(begins) else never
            if across < left and across <= right:  # of equal ranks the leftmost pair is merged first
                return False
            if left == right == never:
                return True
            if left <= right:
                i += 1
            else:
                j += 1


class State:
    """Open readings, each (node of the begun token, token before it, tokens not yet emitted); the last has begun none."""

    __slots__ = ("final", "following", "readings")

    def __init__(self, readings: tuple[tuple[int, int, tuple[int, ...]], ...]):
        self.readings = readings
        self.following: dict[int, tuple[tuple[int, ...], State]] = {}  # by byte: what is emitted, and the next state
        self.final = readings[-1][2]  # what remains if the piece ends here


class Transducer:
    """The lazily determinised machine. Of its states ``max_states`` are kept; when full it begins anew."""

    def __init__(self, merges: Merges, max_states: int = 150_000):
        self.merges, self.max_states = merges, max_states
        self.child: dict[int, int] = {}  # 256 * node + byte: the node of the beginning that is a byte longer
        self.token, self.longer = [-1], bytearray([0])  # by node: the token that ends there; does one go on
        for token, i in merges.ranks.items():
            node = 0
            for byte in token:
                self.longer[node] = 1
                node = self.child.setdefault(node << 8 | byte, len(self.token))
                if node == len(self.token):
                    self.token.append(-1)
                    self.longer.append(0)
            self.token[node] = i
        self.states: dict[tuple, State] = {}
        self._restart()

    def _restart(self) -> None:
        for state in self.states.values():  # states refer to each other: let go of them without a search for cycles
            state.following = {}
        self.start = State(((0, -1, ()),))
        self.states = {self.start.readings: self.start}

    def _step(self, state: State, byte: int) -> tuple[tuple[int, ...], State]:
        child, token_at, longer, known = self.child, self.token, self.longer, self.merges.beside
        readings, ended = [], None
        for node, before, rest in state.readings:
            node = child.get(node << 8 | byte)
            if node is None:
                continue
            if longer[node]:
                readings.append((node, before, rest))
            if ended is None and (token := token_at[node]) >= 0:
                fits = before < 0 or known.get(before << 32 | token)
                if fits or fits is None and self.merges.compatible(before, token):
                    ended = 0, token, (*rest, token)
        readings.append(ended)
        shared = readings[0][2]
        if shared:
            for _, _, rest in readings:
                while shared != rest[: len(shared)]:
                    shared = shared[:-1]
            if shared:
                readings = [(node, before, rest[len(shared) :]) for node, before, rest in readings]
        key = tuple(readings)
        following = self.states.get(key)
        if following is None:
            following = self.states[key] = State(key)
        found = state.following[byte] = shared, following
        return found

    def encode(self, piece: bytes) -> array:
        """Token ids of one piece."""
        if len(self.states) > self.max_states:
            self._restart()
        state, ids = self.start, array("I")
        for byte in piece:
            emitted, state = state.following.get(byte) or self._step(state, byte)
            if emitted:
                ids.extend(emitted)
        ids.extend(state.final)
        return ids


class PieceIds(dict):
    """Ids of a piece as little-endian unsigned 32-bit bytes. Short pieces are remembered, up to ``limit`` of them."""

    def __init__(self, transducer: Transducer, limit: int = 250_000):
        super().__init__()
        self.transducer, self.limit = transducer, limit

    def __missing__(self, piece: str) -> bytes:
        ids = self.transducer.encode(piece.encode())
        found = _little_endian(ids)
        if len(piece) <= 32:
            if len(self) >= self.limit:
                self.clear()
            self[piece] = found
        return found


def _little_endian(ids: array) -> bytes:
    if sys.byteorder == "big":
        ids = array("I", ids)
        ids.byteswap()
    return ids.tobytes()


REPLACEMENT = "\N{REPLACEMENT CHARACTER}"


def _utf8_step(held: bytes, byte: int) -> tuple[str, bytes]:
    """One step of the UTF-8 machine: ``held`` bytes begin a character; gives what is now certain and what is held."""
    if not held:
        if byte < 0x80:
            return chr(byte), b""
        return ("", bytes([byte])) if 0xC2 <= byte <= 0xF4 else (REPLACEMENT, b"")
    lead = held[0]
    low, high = 0x80, 0xBF
    if len(held) == 1:  # no overlong forms, surrogates or numbers past the last code point
        low = {0xE0: 0xA0, 0xF0: 0x90}.get(lead, low)
        high = {0xED: 0x9F, 0xF4: 0x8F}.get(lead, high)
    if not low <= byte <= high:
        said, held = _utf8_step(b"", byte)
        return REPLACEMENT + said, held
    held += bytes([byte])
    whole = len(held) == (2 if lead < 0xE0 else 3 if lead < 0xF0 else 4)
    return (held.decode(), b"") if whole else ("", held)


class Utf8Decoder:
    """Text from token ids, as they come. A broken sequence gives one replacement character for each longest beginning
    of a character; so does an id without a token. Whole tokens are transitions too, made when first needed."""

    RUN = 2048

    def __init__(self, merges: Merges):
        self.tokens = merges.tokens
        self.following: dict[bytes, dict[int, tuple[str, bytes]]] = {}
        self.whole: dict[int, str] = {}  # transitions from and to the state that holds nothing
        self.held = b""

    def _step(self, held: bytes, token: int) -> tuple[str, bytes]:
        said, now = [], held
        for byte in self.tokens.get(token, b"\xff"):
            text, now = _utf8_step(now, byte)
            said.append(text)
        found = self.following.setdefault(held, {})[token] = "".join(said), now
        if held == now == b"":
            self.whole[token] = found[0]
        return found

    def feed(self, ids: Sequence[int]) -> str:
        said = []
        for at in range(0, len(ids), self.RUN):
            some = ids[at : at + self.RUN]
            if not self.held:
                try:
                    said.append("".join(map(self.whole.__getitem__, some)))
                    continue
                except KeyError:  # a character is split, or a transition not known yet
                    pass
            said.extend(self._each(some))
        return "".join(said)

    def _each(self, ids: Sequence[int]) -> Iterator[str]:
        for token in ids:
            text, self.held = self.following.get(self.held, {}).get(token) or self._step(self.held, token)
            yield text

    def finish(self) -> str:
        said, self.held = REPLACEMENT if self.held else "", b""
        return said


@lru_cache(maxsize=2)
def _machine(path: str, pattern: str, limit: int) -> tuple[Splitter, PieceIds]:
    """Kept for the life of a Python worker. Its many objects form no cycles that aren't undone, so the search for such is put off."""
    gc.set_threshold(100_000, 20, 100)
    return Splitter(pattern), PieceIds(Transducer(Merges.read(path)), limit)


@lru_cache(maxsize=2)
def _decoder(path: str) -> Utf8Decoder:
    return Utf8Decoder(Merges.read(path))


def encode(docs: DataFrame, vocabulary: str, pattern: str, *, doc_id: str = "doc_id", text: str = "text", cache_pieces: int = 250_000) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens and ids (little-endian unsigned 32-bit integers, as binary).

    ``vocabulary`` is a rank file that every executor can read at that path, ``pattern`` what splits a text; each match
    is encoded alone. Null and empty texts have no ids; repeated and null doc_ids are rows like others; other columns of
    docs aren't read. An empty table gives an empty one. Work is by row, without a shuffle.
    """
    Merges.read(vocabulary).check()
    id_type = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, of_piece = _machine(vocabulary, pattern, cache_pieces)
        for batch in batches:
            for part in slices(batch, 1, 4 << 20):
                ids = [b"".join([b"".join(map(of_piece.__getitem__, run)) for run in splitter.blocks(t or "")]) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return docs.select(docs[doc_id], docs[text]).mapInArrow(run, f"doc_id {id_type}, n_tokens long, ids binary")


def decode(encoded: DataFrame, vocabulary: str, *, ids: str = "ids") -> DataFrame:
    """``encoded`` with the ``text`` of its ids (binary, as ``encode`` gives them) in place of them; null ids give null."""
    kept = [c for c in encoded.columns if c != ids]
    if "text" in kept:
        raise ValueError("the column 'text' is taken")
    schema = StructType([encoded.schema[c] for c in kept]).add("text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _decoder(vocabulary)

        def of(raw: bytes | None) -> str | None:
            if raw is None:
                return None
            view, said = memoryview(raw), []
            for at in range(0, len(raw), 1 << 18):
                got = array("I", bytes(view[at : at + (1 << 18)]))
                if sys.byteorder == "big":
                    got.byteswap()
                said.append(decoder.feed(got))
            return "".join([*said, decoder.finish()])

        for batch in batches:
            for part in slices(batch, batch.num_columns - 1, 4 << 20):
                texts = pa.array([of(x) for x in part.column(part.num_columns - 1).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], texts], [*kept, "text"])

    return encoded.select(*kept, ids).mapInArrow(run, schema)
