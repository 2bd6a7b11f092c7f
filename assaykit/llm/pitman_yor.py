"""Hierarchical Pitman-Yor language model: Chinese-restaurant seatings sampled by Gibbs sweeps, predictions averaged.

Two levels: a restaurant for each preceding word, told apart by 64-bit hash, all sharing one parent restaurant over
single words, whose base is uniform over the training words and one unknown word. Every training token is a customer.

Documents are read once into chunks: a chunk's own dictionary and a number per token, stored, and not moved again. A
chunk sends its types, the distinct (preceding word, word) pairs with their counts, to the bucket of the preceding word,
so that a context restaurant is whole in one place. Contexts of at least ``hot_share`` of the tokens (at most
1 / hot_share words) are dealt by the following word instead; their tables are added up on the driver. A bucket also
keeps the parent's dishes of its words.

The first sweep seats all customers; in each later one customers are taken out and reseated given the rest, first in
the context restaurants, one dish after the other, then in the parent. Between the two, buckets exchange one message a
pair of bucket and word: the tables that a bucket's contexts opened for a word, and back the word's parent weight, for
words of repeated types alone, as a type that occurs once has one table. Random numbers follow from the words, so the
seatings do not depend on the numbers of buckets and chunks. In the end each chunk is sent what its words and types came
to. Every message is as long as its sender's types or words; none is as long as the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import WordHashes, broadcast_within, bucketed, drop_stored, slices, stored

_HASHES = WordHashes()
_U = np.uint64
_MIX = _U(0x9E3779B97F4A7C15)  # fixed value: 2^64 divided by the golden ratio
END = 0x656E64  # the end of a text, as a word's hash
BEGIN = 0x626567696E  # what precedes the first word
EXACT = 600  # customers up to which the chance to sit alone is tabled
WAVES = 64
RARE = 65_535  # code of a word that has none

Rows = list[dict]


@dataclass(frozen=True)
class Settings:
    discount: float = 0.75
    strength: float = 20.0
    parent_discount: float = 0.6
    parent_strength: float = 10.0
    burn_in: int = 1
    samples: int = 3
    reseats: int = 4
    bucket_tokens: int = 2_500_000
    chunk_tokens: int = 2_000_000
    hot_share: float = 0.002
    coded_words: int = RARE
    seed: int = 11


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Draws:
    """Random numbers of 0 to 1 that follow from keys and the number of the draw, wherever a key is dealt."""

    def __init__(self, keys: np.ndarray, seed: int, turn: int):
        self.keys = _scrambled(keys + _U((seed * 1_000_003 + turn + 1) * int(_MIX) % (1 << 64)))

    def of(self, which: np.ndarray, number: int) -> np.ndarray:
        return ((_scrambled(self.keys[which] + _U(number * int(_MIX) % (1 << 64))) >> _U(11)).astype(np.float64) + 0.5) / (1 << 53)


def seat(customers: np.ndarray, prior: np.ndarray, others: np.ndarray, discount: float, strength: float, rng: np.random.Generator | Draws) -> np.ndarray:
    """Tables of each dish after its customers sat down one by one: the first opens one; a later one opens another with
    probability (strength + discount * tables) * prior against the seats taken. ``others``: the restaurant's other tables.

    Up to 16 customers one by one; further, the wait for the next table is drawn at once, from the quotient of gamma
    functions that no table for that long comes to.
    """
    draw = rng.of if isinstance(rng, Draws) else lambda live, _: rng.random(len(live))
    tables = np.minimum(customers, 1)
    live = np.flatnonzero(customers > 1)
    for i in range(1, 16):
        live = live[customers[live] > i]
        if not len(live):
            return tables
        new = (strength + discount * (others[live] + tables[live])) * prior[live]
        tables[live] += draw(live, i) * (new + i - discount * tables[live]) < new
    at, i = np.full(len(live), 16.0), 16
    while len(live):
        i += 1
        new = (strength + discount * (others[live] + tables[live])) * prior[live]
        shift = (new - 1) / 2 - discount * tables[live]
        at = (at + shift) * np.exp(np.minimum(-np.log(draw(live, i)) / new, 700)) - shift
        open_ = at < customers[live]
        live, at = live[open_], np.floor(at[open_]) + 1
        tables[live] += 1
        more = at < customers[live]
        live, at = live[more], at[more]
    return tables


@lru_cache(4)
def _alone_table(discount: float) -> np.ndarray:
    """[customers, tables]: the chance that one of a dish's customers sits alone, from generalised Stirling numbers S:
    S(c - 1, t - 1) / S(c, t), where S(c, t) = S(c - 1, t - 1) + (c - 1 - discount * t) S(c - 1, t)."""
    out = np.zeros((EXACT + 1, EXACT + 1))
    last = np.full(EXACT + 2, -np.inf)
    last[0] = 0
    for c in range(1, EXACT + 1):
        t = np.arange(1, c + 1)
        now = np.full(EXACT + 2, -np.inf)
        now[1 : c + 1] = np.logaddexp(last[:c], np.log(np.maximum(c - 1 - discount * t, 1e-300)) + last[1 : c + 1])
        out[c, 1 : c + 1] = np.exp(last[:c] - now[1 : c + 1])
        last = now
    return out


def alone(customers: np.ndarray, tables: np.ndarray, discount: float) -> np.ndarray:
    """The chance that a customer sits alone, given the dish's customers and tables. Of over ``EXACT`` customers: the
    last tabled row at the same share of tables, of which it is a function in the limit."""
    known = _alone_table(discount)
    out = known[np.minimum(customers, EXACT), np.minimum(tables, EXACT)]
    big = customers > EXACT
    if big.any():
        share = (tables[big] - 1) / (customers[big] - 1)
        out[big] = np.interp(share * (EXACT - 1) + 1, np.arange(1, EXACT + 1), known[EXACT, 1:])
    return out


def reseat(customers: np.ndarray, tables: np.ndarray, prior: np.ndarray, place: np.ndarray, totals: np.ndarray, fixed: np.ndarray, discount: float, strength: float, times: int, draws: Draws) -> None:
    """Gibbs: of each dish (min(times, customers) times) one customer is taken out and seated again given the rest.

    ``tables`` changes in place, and so does ``totals``, the tables of each restaurant, but for the ``fixed`` ones.
    ``place``: the dish's restaurant, ascending. The dishes of a restaurant take turns, in ``WAVES`` waves; those of a
    wave see the totals before it.
    """
    first = np.searchsorted(place, place)
    wave = (np.arange(len(place)) - first) % WAVES
    order = np.argsort(wave, kind="stable")
    edges = np.searchsorted(wave[order], np.arange(WAVES + 1))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        mine = order[a:b]
        for turn in range(times):
            mine = mine[customers[mine] > max(turn, 1)]
            if not len(mine):
                break
            c, t, at = customers[mine], tables[mine], place[mine]
            less = t - (draws.of(mine, 2 * turn) < alone(c, t, discount))
            everywhere = totals[at] - t + less
            new = (strength + discount * everywhere) * prior[mine]
            after = less + (draws.of(mine, 2 * turn + 1) * (new + c - 1 - discount * less) < new)
            after = np.maximum(after, 1)
            tables[mine] = after
            np.add.at(totals, at, np.where(fixed[at], 0, after - t))


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, text after text, and the number of words of each text (string, not null)."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words = lists.flatten().dictionary_encode()
    names = words.dictionary.cast(pa.binary()).to_pylist()
    hashes, at = np.fromiter(map(_HASHES.__getitem__, names), _U, len(names)), words.indices.to_numpy()
    real = np.array([x != b"" for x in names], bool)[at] if len(names) else np.zeros(0, bool)
    ends = np.concatenate([[0], np.cumsum(real)])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
    return hashes[at][real], np.diff(ends)


def _places(listed: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``listed`` (ascending) of the words that are there, and which ones are."""
    if not len(listed):
        return np.zeros(0, np.int64), np.zeros(len(words), bool)
    at = np.minimum(np.searchsorted(listed, words), len(listed) - 1)
    there = listed[at] == words
    return at[there], there


def _homes(words: np.ndarray, buckets: int) -> np.ndarray:
    return (((words >> _U(32)) * _U(buckets)) >> _U(32)).astype(np.int64)


def _coded(words: np.ndarray, coded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two bytes a word, and the hashes of those without a code, in order. Frequent words have codes, to save space."""
    codes = np.full(len(words), RARE, np.uint16)
    at, there = _places(coded, words)
    codes[there] = at
    return codes, words[~there]


def _decoded(codes: np.ndarray, rare: np.ndarray, coded: np.ndarray) -> np.ndarray:
    words, plain = np.empty(len(codes), _U), codes != RARE
    words[plain], words[~plain] = coded[codes[plain]], rare
    return words


def _read(blobs: list[bytes], *kinds: type) -> list[np.ndarray]:
    return [np.frombuffer(x, k) for x, k in zip(blobs, kinds, strict=True)]


def _blobs(*arrays: np.ndarray) -> list[bytes]:
    return [x.tobytes() for x in arrays]


@dataclass
class _Chunk:
    """A chunk's tokens and their types. Words and contexts are numbered by ascending hash."""

    words: np.ndarray
    tokens: np.ndarray
    doc: np.ndarray
    train: np.ndarray

    @staticmethod
    def of(row: dict) -> _Chunk:
        _HASHES.clear()
        words, tokens, sizes, train = _read([row[c] for c in ("words", "tokens", "sizes", "train")], _U, np.uint32, np.uint32, np.uint8)
        begin = len(words)
        order = np.argsort(np.append(words, _U(BEGIN)))
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        chunk = _Chunk(np.append(words, _U(BEGIN))[order], rank[tokens], np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), train)
        before = np.empty_like(chunk.tokens)
        before[1:] = chunk.tokens[:-1]
        before[(np.cumsum(sizes) - sizes)[sizes > 0]] = rank[begin]
        pair = before.astype(_U) << _U(32)
        pair |= chunk.tokens.astype(_U)
        pair, kinds = np.unique(pair, return_inverse=True)
        chunk.type = kinds.astype(np.int32)
        chunk.ctx, chunk.word = (pair >> _U(32)).astype(np.int64), (pair & _U(0xFFFFFFFF)).astype(np.int64)
        return chunk

    def dealt(self, hot: np.ndarray, buckets: int) -> Iterator[tuple[int, slice, np.ndarray]]:
        """For each bucket concerned its words (a slice) and its types (numbers, those of hot contexts last)."""
        home = _homes(self.words, buckets)
        is_hot = _places(hot, self.words)[1][self.ctx]
        to = np.where(is_hot, home[self.word], home[self.ctx])
        order = np.argsort(to * 2 + is_hot, kind="stable")
        for b in np.unique(np.concatenate([home, to])):
            i, j = np.searchsorted(to[order], [b, b + 1])
            k, n = np.searchsorted(home, [b, b + 1])
            yield int(b), slice(k, n), order[i:j]


PART = ("words", "counts", "per", "extra", "extra_per", "codes", "rare", "seen")
PART_KINDS = (_U, np.uint32, np.uint32, _U, np.uint32, np.uint16, _U, np.uint32)


def _parts_of(chunk: _Chunk, hot: np.ndarray, coded: np.ndarray, buckets: int) -> Iterator[tuple[int, list[bytes]]]:
    """What a chunk sends to each bucket: its words with training counts, and its types with theirs."""
    in_train = chunk.train[chunk.doc]
    counts = np.bincount(chunk.tokens, in_train, len(chunk.words)).astype(np.uint32)
    seen = np.bincount(chunk.type, in_train, len(chunk.ctx)).astype(np.uint32)
    hot_ctx = _places(hot, chunk.words)[1]
    for b, words, types in chunk.dealt(hot, buckets):
        ctx = chunk.ctx[types]
        own = ctx[~hot_ctx[ctx]]
        extra, extra_per = np.unique(ctx[hot_ctx[ctx]], return_counts=True)
        per = np.bincount(own - words.start, minlength=words.stop - words.start).astype(np.uint32)
        yield b, _blobs(chunk.words[words], counts[words], per, chunk.words[extra], extra_per.astype(np.uint32), *_coded(chunk.words[chunk.word[types]], coded), seen[types])


class _Home:
    """A bucket's words and types, from the parts that chunks sent."""

    def __init__(self, parts: Rows, coded: np.ndarray):
        _HASHES.clear()
        read = [_read([p[c] for c in PART], *PART_KINDS) for p in sorted(parts, key=lambda p: p["chunk"])]
        of = {c: [r[n] for r in read] for n, c in enumerate(PART)}
        self.words, self.at = np.unique(np.concatenate(of["words"]), return_inverse=True)
        self.edges = np.cumsum([0, *map(len, of["words"])])
        self.known = np.bincount(self.at, np.concatenate(of["counts"]), len(self.words)).astype(np.int64)
        named = np.concatenate([x for w, e in zip(of["words"], of["extra"], strict=True) for x in (w, e)])
        per = np.concatenate([x for w, e in zip(of["per"], of["extra_per"], strict=True) for x in (w, e)])
        self.contexts, ctx = np.unique(named[per > 0], return_inverse=True)
        followers = np.concatenate([_decoded(c, r, coded) for c, r in zip(of["codes"], of["rare"], strict=True)])
        self.followers, word = np.unique(followers, return_inverse=True)
        pair, self.type = np.unique(np.repeat(ctx, per[per > 0]).astype(_U) << _U(32) | word.astype(_U), return_inverse=True)
        self.type_edges = np.cumsum([0, *map(len, of["seen"])])
        self.ctx, self.word = (pair >> _U(32)).astype(np.int64), (pair & _U(0xFFFFFFFF)).astype(np.int64)
        self.count = np.bincount(self.type, np.concatenate(of["seen"]), len(pair)).astype(np.int64)


def _to_homes(bucket: int, kind: str, words: np.ndarray, tables: np.ndarray, coded: np.ndarray, buckets: int) -> Rows:
    """Messages with the tables opened for words (ascending), a row for each bucket that keeps some of them."""
    edges = np.searchsorted(_homes(words, buckets), np.arange(buckets + 1))
    rows = []
    for b in np.unique(_homes(words, buckets)):
        part = slice(edges[b], edges[b + 1])
        rows.append({"bucket": int(b), "kind": kind, "part": bucket, "blobs": _blobs(*_coded(words[part], coded), tables[part].astype(np.uint32))})
    return rows


MESSAGE = pa.schema([("bucket", pa.int32()), ("kind", pa.string()), ("part", pa.int32()), ("blobs", pa.list_(pa.binary())), ("sums", pa.list_(pa.float64()))])
MESSAGE_DDL = "bucket int, kind string, part int, blobs array<binary>, sums array<double>"


def _sums(state: DataFrame) -> np.ndarray:
    """A few sums over all buckets."""
    found = state.where("kind = 'sums'").select(F.posexplode("sums").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").toArrow()
    return found.column("v").to_numpy()


@dataclass(frozen=True)
class _Parent:
    """What all buckets share of the parent restaurant."""

    guests: float
    tables: float
    n_words: int

    def p(self, weight: np.ndarray, s: Settings) -> np.ndarray:
        """Probabilities of words, from their guests less the discount of their tables."""
        return (weight + (s.parent_strength + s.parent_discount * self.tables) / (self.n_words + 1)) / (s.parent_strength + self.guests)


def perplexity_scores(docs: DataFrame, train: Column, *, doc_id: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """One row per document: doc_id, in_training, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities of the text).

    Tokens are the runs of anything but ASCII white space, A-Z lower-cased, then one end. The model learns from the rows
    where ``train`` is true (null: not); known tokens occur in these. base_score is the add-0.1 unigram's. A document's
    perplexity is 10 ^ (-score / n_tokens). The parent's and each context's predictive probabilities are averaged over
    their sampled seatings. Null texts are empty: the end alone. Repeated rows and null ids are documents like others.
    Without training rows every token is unknown and has probability one. Only ``doc_id``, ``text`` and what ``train``
    names are read; an empty table gives an empty one. Words are compared by 64-bit hashes.
    """
    s = settings
    rows = docs.select(F.col(doc_id).alias("__id"), F.coalesce(train, F.lit(False)).alias("__train"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    id_type = rows.schema["__id"].dataType.simpleString()
    chunks = bucketed(_chunks(rows, s), "chunks", "chunk")
    hot_list, coded, total = _word_lists(chunks, s)
    hot = np.unique(np.array([*hot_list, BEGIN], _U))
    buckets = max(4, -(-total // s.bucket_tokens))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for b, blobs in _parts_of(_Chunk.of(row), hot, coded, buckets):
                    yield pa.RecordBatch.from_pylist([{"bucket": b, "chunk": row["chunk"]} | dict(zip(PART, blobs, strict=True))], sent_schema)

    sent_schema = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), *((c, pa.binary()) for c in PART)])
    sent = chunks.select("chunk", "words", "tokens", "sizes", "train").mapInArrow(send, "bucket int, chunk long, " + ", ".join(f"{c} binary" for c in PART))
    part_type = pa.struct(list(sent_schema)[1:])
    home_schema = pa.schema([*MESSAGE, ("parts", pa.list_(part_type))])

    def open_home(t: pa.Table) -> pa.Table:
        """A bucket's parts in one row, its repeated types in another, its words, and its first messages."""
        bucket, parts = t.column("bucket")[0].as_py(), t.drop_columns("bucket").to_pylist()
        h = _Home(parts, coded)
        once, again = h.count == 1, h.count > 1
        named, ctx = np.unique(h.ctx[again], return_inverse=True)
        asked, word = np.unique(h.word[again], return_inverse=True)
        ones = np.bincount(h.ctx[once], minlength=len(h.contexts))
        seats = _blobs(h.contexts[named], ones[named].astype(np.uint32), ctx.astype(np.uint32), word.astype(np.uint32), h.count[again].astype(np.uint32), h.followers[asked])
        single, tables = np.unique(h.word[once], return_counts=True)
        messages = _to_homes(bucket, "ones", h.followers[single], tables, coded, buckets)
        messages += _to_homes(bucket, "tables", h.followers[asked], np.bincount(word), coded, buckets)
        at, there = _places(hot, h.contexts)
        of_hot = np.zeros(len(hot))
        of_hot[at] = np.bincount(h.ctx, np.minimum(h.count, 1), len(h.contexts))[there]
        return pa.Table.from_pylist(
            [
                {"bucket": bucket, "kind": "home", "parts": parts},
                {"bucket": bucket, "kind": "seats", "blobs": seats},
                {"bucket": bucket, "kind": "words", "blobs": _blobs(h.words, h.known.astype(np.uint32))},
                *messages,
                {"bucket": bucket, "kind": "sums", "sums": [float(h.known.sum()), float((h.known > 0).sum()), *of_hot]},
            ],
            home_schema,
        )

    home_ddl = MESSAGE_DDL + ", parts array<struct<chunk:bigint," + ",".join(f"{c}:binary" for c in PART) + ">>"
    homes = bucketed(sent.groupBy("bucket").applyInArrow(open_home, home_ddl), "homes", "bucket")
    first = _sums(homes)
    n_train, n_words = (int(first[0]), int(first[1])) if len(first) else (0, 0)
    hot_tables = first[2:] if len(first) else np.zeros(len(hot))
    begins = rows.where("__train").count()

    def serve(turn: int, parent: _Parent) -> Callable[[pa.Table, pa.Table], pa.Table]:
        """Dishes of the parent take in their customers; the asking buckets get their words' weights."""

        def run(fixed: pa.Table, news: pa.Table) -> pa.Table:
            (own,), told = fixed.to_pylist(), news.to_pylist()
            words, _ = _read(own["blobs"], _U, np.uint32)
            asked = [(r["part"], np.searchsorted(words, _decoded(*_read(r["blobs"][:2], np.uint16, _U), coded)), np.frombuffer(r["blobs"][2], np.uint32), r["kind"]) for r in told if r["kind"] in ("ones", "tables")]
            before = next((_read(r["blobs"], *[np.uint32] * 3) for r in told if r["kind"] == "dishes"), None)
            ones = np.zeros(len(words), np.int64) if before is None else before[0].astype(np.int64)
            for _, at, tables, kind in asked:
                if kind == "ones":
                    ones[at] += tables
            guests = ones.copy()
            for _, at, tables, kind in asked:
                if kind == "tables":
                    guests[at] += tables
            uniform = np.full(len(words), 1 / (n_words + 1))
            draws = Draws(words, s.seed + 1, turn)
            if turn < 2:
                others = np.full(len(words), max(parent.tables, 0.0))
                tables = seat(guests, uniform, others, s.parent_discount, s.parent_strength, draws) if turn else np.minimum(guests, 1)
            else:
                tables = _taken_in(guests, before[1].astype(np.int64), before[2].astype(np.int64), uniform, parent, s, draws)
            weight = (guests - s.parent_discount * tables).astype(np.float32)
            out = [{"bucket": part, "kind": "weights", "part": own["bucket"], "blobs": _blobs(weight[at])} for part, at, _, kind in asked if kind == "tables"]
            out.append({"bucket": own["bucket"], "kind": "dishes", "blobs": _blobs(*(x.astype(np.uint32) for x in (ones, guests, tables)))})
            out.append({"bucket": own["bucket"], "kind": "sums", "sums": [float(guests.sum()), float(tables.sum())]})
            return pa.Table.from_pylist(out, MESSAGE)

        return run

    def sweep(turn: int, parent: _Parent, hot_tables: np.ndarray) -> Callable[[pa.Table, pa.Table], pa.Table]:
        """Context restaurants: all customers sit down in the first turn, later some are reseated given the rest."""

        def run(fixed: pa.Table, news: pa.Table) -> pa.Table:
            (own,), told = fixed.to_pylist(), news.to_pylist()
            names, ones, ctx, word, count, asked = _read(own["blobs"], _U, np.uint32, np.uint32, np.uint32, np.uint32, _U)
            ctx, count = ctx.astype(np.int64), count.astype(np.int64)
            weights = [np.frombuffer(r["blobs"][0], np.float32) for r in sorted((r for r in told if r["kind"] == "weights"), key=lambda r: r["part"])]
            prior = parent.p(np.concatenate([np.zeros(0, np.float32), *weights]).astype(np.float64), s)[word]
            before = next((np.frombuffer(r["blobs"][0], np.uint32).astype(np.int64) for r in told if r["kind"] == "seats"), np.ones(len(count), np.int64))
            totals = ones + np.bincount(ctx, before, len(names))
            at, is_hot = _places(hot, names)
            totals[is_hot] = hot_tables[at]
            draws = Draws(_scrambled(names[ctx] * _MIX + asked[word]), s.seed, turn)
            if turn:
                tables = before.copy()
                reseat(count, tables, prior, ctx, totals, is_hot, s.discount, s.strength, s.reseats, draws)
            else:
                tables = seat(count, prior, totals[ctx] - before, s.discount, s.strength, draws)
            of_hot = np.zeros(len(hot))
            of_hot[at] = np.bincount(ctx, tables - before, len(names))[is_hot]
            out = [{"bucket": own["bucket"], "kind": "seats", "blobs": _blobs(tables.astype(np.uint32))}]
            out += _to_homes(own["bucket"], "tables", asked, np.bincount(word, tables, len(asked)), coded, buckets)
            out.append({"bucket": own["bucket"], "kind": "sums", "sums": of_hot.tolist()})
            return pa.Table.from_pylist(out, MESSAGE)

        return run

    columns = ("bucket", "kind", "part", "blobs")
    fixed_words = homes.where("kind = 'words'").select("bucket", "blobs")
    fixed_seats = homes.where("kind = 'seats'").select("bucket", "blobs")

    def step(fixed: DataFrame, news: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], name: str) -> DataFrame:
        return stored(fixed.groupBy("bucket").cogroup(news.groupBy("bucket")).applyInArrow(run, MESSAGE_DDL), name)

    def only(state: DataFrame, *kinds: str) -> DataFrame:
        return state.where(F.col("kind").isin(*kinds)).select(*columns)

    parent = _Parent(0.0, 0.0, n_words)
    dishes = step(fixed_words, only(homes, "ones", "tables"), serve(0, parent), "dishes")
    seats, kept, hot_kept = None, [], []
    for turn in range(s.burn_in + s.samples):
        now = _sums(dishes)
        parent = _Parent(now[0], now[1], n_words) if len(now) else parent
        news = only(dishes, "weights") if seats is None else only(dishes, "weights").unionByName(only(seats, "seats"))
        new_seats = step(fixed_seats, news, sweep(turn, parent, hot_tables), "seats")
        moved = _sums(new_seats)
        hot_tables = hot_tables + moved if len(moved) else hot_tables
        new_dishes = step(fixed_words, only(dishes, "dishes").unionByName(only(new_seats, "tables")), serve(turn + 1, parent), "dishes")
        for old in (dishes, seats):
            if old is not None and all(old is not x for pair in kept for x in pair):
                drop_stored(old)
        seats, dishes = new_seats, new_dishes
        if turn >= s.burn_in:
            kept.append((seats, dishes))
            hot_kept.append(hot_tables)
    parents = [_Parent(*found, n_words) if len(found := _sums(d)) else parent for _, d in kept]
    hot_mean = np.mean(hot_kept, axis=0)

    def answer(fixed: pa.Table, news: pa.Table) -> pa.Table:
        """To each chunk, what the words and types that it sent came to."""
        own, told = fixed.to_pylist(), news.to_pylist()
        if not own:
            return pa.Table.from_pylist([], reply_schema)
        (home,) = (r for r in own if r["kind"] == "home")
        h = _Home(home["parts"], coded)
        taken = {r["kind"]: r["blobs"] for r in told}
        p = np.zeros(len(h.words))
        for n, parent in enumerate(parents):
            _, guests, tables = _read(taken[f"dishes {n}"], *[np.uint32] * 3)
            p += parent.p(guests - s.parent_discount * tables.astype(np.float64), s) / len(parents)
        mean = np.minimum(h.count, 1).astype(np.float64)
        if (h.count > 1).any():
            mean[h.count > 1] = np.mean([np.frombuffer(taken[f"seats {n}"][0], np.uint32) for n in range(len(parents))], axis=0)
        opened = np.zeros(len(h.words))
        at, there = _places(h.words, h.contexts)
        opened[at] = np.bincount(h.ctx, mean, len(h.contexts))[there]
        over = (h.count - s.discount * mean).astype(np.float32)[h.type]
        of_words = [x[h.at] for x in (p.astype(np.float32), h.known.astype(np.uint32), opened.astype(np.float32))]
        cut = lambda x, edges, n: x[edges[n] : edges[n + 1]].tobytes()
        rows = [
            {"chunk": part["chunk"], "bucket": home["bucket"], "blobs": [*(cut(x, h.edges, n) for x in of_words), cut(over, h.type_edges, n)]}
            for n, part in enumerate(sorted(home["parts"], key=lambda p: p["chunk"]))
        ]
        return pa.Table.from_pylist(rows, reply_schema)

    reply_schema = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("blobs", pa.list_(pa.binary()))])
    taken = None
    for n, pair in enumerate(kept):
        for state, kind in zip(pair, ("seats", "dishes"), strict=True):
            one = only(state, kind).withColumn("kind", F.lit(f"{kind} {n}"))
            taken = one if taken is None else taken.unionByName(one)
    replies = homes.where("kind = 'home'").select("bucket", "kind", "parts").groupBy("bucket").cogroup(taken.groupBy("bucket")).applyInArrow(answer, "chunk long, bucket int, blobs array<binary>")

    def finish(told: pa.Table, back: pa.Table) -> pa.Table:
        (row,), replies = told.select(["words", "tokens", "sizes", "train"]).to_pylist(), {r["bucket"]: r["blobs"] for r in back.to_pylist()}
        c = _Chunk.of(row)
        p, known, opened, over = (np.zeros(n) for n in (len(c.words), len(c.words), len(c.words), len(c.ctx)))
        for b, words, types in c.dealt(hot, buckets):
            p[words], known[words], opened[words], over[types] = _read(replies[b], np.float32, np.uint32, np.float32, np.float32)
        at, is_hot = _places(hot, c.words)
        opened[is_hot] = hot_mean[at]
        customers = np.where(c.words == _U(BEGIN), float(begins), known)
        score = np.log10((over + (s.strength + s.discount * opened[c.ctx]) * p[c.word]) / (s.strength + customers[c.ctx]))
        sizes = np.frombuffer(row["sizes"], np.uint32).astype(np.int64)
        by_doc = lambda x: np.bincount(c.doc, x, len(sizes))
        sums = by_doc(score[c.type]), by_doc(np.log10(known + 0.1)[c.tokens]), by_doc((known > 0)[c.tokens])
        return pa.table({"doc_id": told.column("ids").combine_chunks().flatten(), "in_training": c.train == 1, "n_tokens": sizes, "n_known": sums[2].astype(np.int64), "base": sums[1], "score": sums[0]})

    done = chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(finish, f"doc_id {id_type}, in_training boolean, n_tokens long, n_known long, base double, score double")
    scale = float(np.log10(n_train + 0.1 * (n_words + 1)))
    return done.select("doc_id", "in_training", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * scale).alias("base_score"), "score")


def _taken_in(guests: np.ndarray, before: np.ndarray, tables: np.ndarray, uniform: np.ndarray, parent: _Parent, s: Settings, draws: Draws) -> np.ndarray:
    """Tables of the parent's dishes after customers came or left since the last turn and some others were reseated.

    Those who come sit down by the chances before them, those who leave are any, and so leave empty tables behind.
    """
    tables, d = np.maximum(tables, np.minimum(guests, 1)), s.parent_discount
    everyone = np.arange(len(guests))
    new = (s.parent_strength + d * parent.tables) * uniform
    chance = np.where(guests > before, new / (new + np.maximum(before - d * tables, 1 - d)), alone(np.maximum(before, 1), np.minimum(tables, np.maximum(before, 1)), d))
    moved = _binomial(np.abs(guests - before), chance, draws.of(everyone, 1_000))
    tables = np.clip(np.where(guests > before, tables + moved, tables - moved), np.minimum(guests, 1), guests)
    totals = np.array([parent.tables])
    place = np.zeros(len(guests), np.int64)
    reseat(guests, tables, uniform, place, totals, np.array([True]), d, s.parent_strength, s.reseats, draws)
    return tables


def _binomial(n: np.ndarray, p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """A binomial number for each uniform one, by adding up to eight terms of its distribution, beyond by the logistic curve of equal mean and variance."""
    p = np.clip(p, 1e-12, 1 - 1e-12)
    term = np.exp(n * np.log1p(-p))
    out, below = np.zeros(len(n), np.int64), term.copy()
    for k in range(1, 9):
        out += u > below
        term = term * np.maximum(n - k + 1, 0) / k * p / (1 - p)
        below += term
    far = (u > below) & (n > 8) | (n * p > 4)
    spread = np.sqrt(n * p * (1 - p))
    out[far] = np.clip(np.rint(n * p + spread * (np.sqrt(3) / np.pi) * np.log(u / (1 - u))), 0, n)[far]
    return np.minimum(out, n)


def _chunks(rows: DataFrame, s: Settings) -> DataFrame:
    """chunk, ids, and as binary: train flags, sizes in tokens, words (hashes, the most frequent first), tokens (numbers of words)."""
    id_type = rows.schema["__id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, flags, lengths, held = [], [], [], []
        made = 0

        def flush() -> pa.RecordBatch:
            nonlocal made
            sizes = np.concatenate(lengths)
            w = np.empty(int(sizes.sum() + len(sizes)), _U)
            ends = np.cumsum(sizes + 1) - 1
            is_word = np.ones(len(w), bool)
            is_word[ends] = False
            w[ends], w[is_word] = END, np.concatenate(held)
            at, words = pd.factorize(w)
            order = np.argsort(-np.bincount(at, minlength=len(words)), kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            all_ids = pa.concat_arrays(ids)
            chunk = TaskContext.get().partitionId() << 32 | made
            made += 1
            blobs = [np.concatenate(flags).astype(np.uint8), (sizes + 1).astype(np.uint32), words[order], rank[at]]
            out = pa.RecordBatch.from_arrays(
                [pa.array([chunk]), pa.ListArray.from_arrays(pa.array([0, len(all_ids)], pa.int32()), all_ids), *[pa.array([x.tobytes()], pa.binary()) for x in blobs]],
                ["chunk", "ids", "train", "sizes", "words", "tokens"],
            )
            for x in (ids, flags, lengths, held):
                x.clear()
            return out

        tokens = 0
        for batch in batches:
            for part in slices(batch, 2, 6_000_000):
                w, sizes = _tokens(part.column(2))
                ids.append(part.column(0))
                flags.append(part.column(1).to_numpy(zero_copy_only=False))
                lengths.append(sizes)
                held.append(w)
                tokens += len(w) + len(sizes)
                if tokens >= s.chunk_tokens:
                    yield flush()
                    tokens = 0
        if ids:
            yield flush()

    return rows.mapInArrow(run, f"chunk long, ids array<{id_type.simpleString()}>, train binary, sizes binary, words binary, tokens binary")


def _word_lists(chunks: DataFrame, s: Settings) -> tuple[list[int], np.ndarray, int]:
    """The hot words; the frequent words that have codes; the number of tokens of all documents.

    Hot are words with at least ``hot_share`` of all documents' tokens; the end is always one. A word that is hot in all
    chunks together is so in one of them at least: the words that are hot in any chunk are summed over all chunks, and
    at most 1 / hot_share of them are left. Codes only save space: they go to at most ``coded_words`` words that occur
    four times in some chunk, and no result depends on which.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                w, tokens = _read([row["words"], row["tokens"]], _U, np.uint32)
                n = np.bincount(tokens, minlength=len(w))
                hot, often = w[n >= s.hot_share * n.sum() * (1 - 1e-9)], n >= 4
                lists = [pa.array([x.view(np.int64)], pa.list_(pa.int64())) for x in (w, n, hot, w[often], n[often])]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([n.sum()], pa.int64())], ["w", "n", "hot", "often", "times", "tokens"])

    parts = stored(chunks.select("words", "tokens").mapInArrow(run, "w array<long>, n array<long>, hot array<long>, often array<long>, times array<long>, tokens long"), "words")
    total = parts.agg(F.sum("tokens")).first()[0] or 0
    hot = broadcast_within(parts.select(F.explode("hot").alias("w")).distinct(), 1_000_000)
    counts = parts.select(F.inline(F.arrays_zip("w", "n"))).join(hot, "w").groupBy("w").agg(F.sum("n").alias("n"))
    found = {r.w % (1 << 64) for r in counts.where(F.col("n") >= s.hot_share * total).collect()}
    often = parts.select(F.inline(F.arrays_zip("often", "times"))).groupBy("often").agg(F.sum("times").alias("times"))
    coded = often.orderBy(F.desc("times"), "often").limit(s.coded_words).select("often").toArrow().column("often").to_numpy()
    drop_stored(parts)
    return sorted(found | {END}), np.unique(coded.astype(np.int64).view(_U)), int(total)


def _hot_words(rows: DataFrame, s: Settings) -> list[int]:
    """Hashes of the hot words of ``__text``, ascending."""
    return _word_lists(_chunks(rows.select(F.lit(0).alias("__id"), F.lit(False).alias("__train"), "__text"), s), s)[0]
