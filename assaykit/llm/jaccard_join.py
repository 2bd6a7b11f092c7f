"""Exact Jaccard self-join on word n-gram sets by partitioning the universe (pigeonhole), and its connected components.

Sets are grouped into size bands. For a band, H is the largest symmetric difference that two linked sets can have if
the smaller lies in it; the universe of n-grams is hashed into H + 1 segments, so linked sets agree on one segment at
least. Each set is indexed under the scheme of its band and, if a smaller partner may lie there, the band below.
Measured costs allocate the segments: one whose values many sets share may be given up (0) if a cheap one is widened
to its one-deletion neighbourhood (2, found within one difference), as long as the allocations sum to H + 1.
Many sets agree on an empty segment. A set of own size n allows fewer differences than H, so it agrees with a linked
set on that many segments more; if these outnumber its empty segments, it is not indexed under those, without loss.

Nodes are distinct sets, so exact copies are one node. What is shuffled is (signature, node), combined before the
shuffle to the smallest and largest node of a signature; only signatures of three or more rows are looked up again,
by a broadcast of counted size or else a join. Candidates are compared in rounds, so that a large group of near copies
is not expanded into all its pairs. First one node of each signature is its pivot, and each node is compared with its
nearest pivot alone; ``pivots`` times more with pivots by chance, in signatures whose nodes are not yet in one component;
and last, in those still open, all nodes of unlike components. Sizes and 256-bit parity sketches
(each differing n-gram flips one bit, so more odd bits than H refute a pair) are checked in the join's condition, sketches
as wide as the sets on the distinct pairs; every pair left is verified on the whole sets. No link between different components is lost.
``links`` and ``link_counts`` give every single link between different sets, at the price of comparing all of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import WordHashes, broadcast_within, drop_stored, row_keys, same_row, stored

_HASHES = WordHashes()
_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(text: bytes | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles, A-Z lower-cased; of fewer words, the whole sequence's."""
    runs = (text or b"").lower().split()
    if not runs:
        return np.zeros(0, _U)
    h = np.fromiter(map(_HASHES.__getitem__, runs), _U, len(runs))
    width = min(n, len(h))
    x = np.full(len(h) - width + 1, width, _U)
    for i in range(width):
        x = _mixed(x * _U(31) + h[i : len(h) - width + 1 + i])
    return np.unique(x)


@dataclass(frozen=True)
class Bands:
    """Size bands and their schemes for links of 100 * intersection >= ``percent`` * union."""

    percent: int
    ratio: float = 1.6
    edges: list[int] = field(default_factory=list)

    def edge(self, g: int) -> int:
        while len(self.edges) <= g + 1:
            # smaller sets can only link to equal ones, which are one node
            least = -(-self.percent // (100 - self.percent))
            self.edges.append(least if not self.edges else max(self.edges[-1] + 1, int(self.edges[-1] * self.ratio)))
        return self.edges[g]

    def band(self, size: int) -> int:
        """-1 below the first."""
        g = -1
        while self.edge(g + 1) <= size:
            g += 1
        return g

    def segments(self, g: int) -> int:
        small = self.edge(g + 1) - 1
        large = small * 100 // self.percent
        return (100 - self.percent) * (small + large) // (100 + self.percent) + 1

    def most_apart(self, size: int, g: int) -> int:
        """Largest symmetric difference of a set of ``size`` and a set linked to it through the scheme of band ``g``."""
        partner = size * 100 // self.percent if g == self.band(size) else self.edge(g + 1) - 1
        return (100 - self.percent) * (size + partner) // (100 + self.percent)

    def schemes(self, size: int) -> list[int]:
        g = self.band(size)
        if g < 0:
            return []
        below = g > 0 and -(-size * self.percent // 100) < self.edge(g)
        return [g, g - 1] if below else [g]

    def code(self, g: int) -> int:
        """Number of the band's first segment."""
        return sum(self.segments(x) for x in range(g))


CODES = 1 << 16  # a signature's low bits tell its scheme and segment; beyond so many segments some share a number


def signatures(u: np.ndarray, bands: Bands, widened: frozenset[int] = frozenset()) -> np.ndarray:
    """Signatures of a set: one per segment; or, if codes are given as ``widened``, the one-deletion neighbourhoods of these segments alone."""
    out = []
    inner = _mixed(u + _U(0x5851F42D4C957F2D))
    for g in bands.schemes(len(u)):
        m, first = bands.segments(g), bands.code(g)
        codes = ((first + np.arange(m)) % CODES).astype(_U)
        seg = ((u >> _U(20)) % _U(m)).astype(np.int64)
        order = np.argsort(seg, kind="stable")
        sums = np.concatenate([np.zeros(1, _U), np.cumsum(inner[order], dtype=_U)])
        ends = np.searchsorted(seg[order], np.arange(m + 1))
        total = sums[ends[1:]] - sums[ends[:-1]]
        sign = lambda values, c, extra: (_mixed(values + c * _U(0x9E3779B97F4A7C15) + _U(extra)) & ~_U(CODES - 1)) | c
        if not widened:
            empty = ends[1:] == ends[:-1]
            keep = ~empty if m - bands.most_apart(len(u), g) > empty.sum() else slice(None)
            out.append(sign(total[keep], codes[keep], g + 1))
            continue
        wide = np.flatnonzero([int(c) in widened for c in codes])
        for i in wide:
            own = inner[order[ends[i] : ends[i + 1]]]
            values = np.concatenate([total[i : i + 1], total[i] - own])
            out.append(sign(values, np.full(len(values), codes[i]), (g + 1) << 32))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, _U)


def sketch(u: np.ndarray) -> np.ndarray:
    """256 parity bits as four longs."""
    bits = np.bincount((_mixed(u ^ _U(0xA0761D6478BD642F)) >> _U(56)).astype(np.int64), minlength=256) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def wide_sketch(u: np.ndarray) -> np.ndarray:
    """Parity bits again, as many as the set is large (a power of two), so that they tell large sets apart too."""
    longs = max(4, 1 << max(0, (len(u) - 1).bit_length() - 6))
    bits = np.bincount((_mixed(u ^ _U(0xE7037ED1A0B428DB)) % _U(64 * longs)).astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _longs(xs: list[np.ndarray]) -> pa.Array:
    return pa.array([x.view(np.int64) for x in xs], pa.list_(pa.int64()))


def described(texts: DataFrame, n: int, bands: Bands, widened: frozenset[int] = frozenset()) -> DataFrame:
    """Per row of (__id, __text_hash, text): n_shingles, node (long: hash of the whole set; null: empty), sketch, wide, sigs."""
    id_type = texts.schema["__id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Bands(bands.percent, bands.ratio)
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                sets = [shingles(t, n) for t in part.column(2).cast(pa.binary()).to_pylist()]
                nodes = [int(_mixed(np.array([_mixed(u).sum(dtype=_U) + _U(len(u))]))[0].view(np.int64)) if len(u) else None for u in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([len(u) for u in sets], pa.int64()), pa.array(nodes, pa.int64()), _longs([sketch(u) for u in sets]), _longs([wide_sketch(u) for u in sets]), _longs([signatures(u, own, widened) for u in sets])],
                    ["__id", "__text_hash", "n_shingles", "node", "sketch", "wide", "sigs"],
                )

    return texts.mapInArrow(run, f"__id {id_type}, __text_hash long, n_shingles long, node long, sketch array<long>, wide array<long>, sigs array<long>")


def allocate(costs: dict[int, int], bands: Bands, sets_in: dict[int, int]) -> tuple[frozenset[int], frozenset[int]]:
    """(given up, widened) segment codes. ``costs``: pairs that the exact segments would bring; ``sets_in``: sets per band.

    In each band the dearest segment is traded for a widened cheap one while that saves: widening is taken to bring
    four times a segment's pairs, and one row per n-gram of the segment in each set.
    """
    given, wide = set(), set()
    for g, count in sets_in.items():
        m = bands.segments(g)
        codes = [(bands.code(g) + i) % CODES for i in range(m)]
        order = sorted(codes, key=lambda c: costs.get(c, 0))
        rows = count * (bands.edge(g) // m + 2)
        for cheap, dear in zip(order[: m // 2], reversed(order), strict=False):
            if costs.get(dear, 0) <= 4 * costs.get(cheap, 0) + rows:
                break
            given.add(dear)
            wide.add(cheap)
    return frozenset(given), frozenset(wide)


def _odd_bits(a: str, b: str) -> Column:
    """Bits in which two sketches differ: at most the sets' symmetric difference."""
    return sum((F.bit_count(F.get(f"{a}.sketch", i).bitwiseXOR(F.get(f"{b}.sketch", i))) for i in range(4)), F.lit(0))


def _wide_odd_bits(a: str, b: str) -> Column:
    """The same of two wide sketches: the longer one is folded, half on half, to the shorter one's length."""

    def folded(mine: str, other: str) -> Column:
        half = (F.size(mine) / 2).cast("int")
        halves = F.zip_with(F.slice(mine, F.lit(1), half), F.slice(mine, half + 1, half), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(mine) > F.size(other), halves).otherwise(F.col(mine))

    x, y = folded(f"{a}.wide", f"{b}.wide"), folded(f"{b}.wide", f"{a}.wide")
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda acc, n: acc + F.coalesce(n, F.lit(0)))


def _may_link(a: str, b: str, percent: int, odd: Column) -> Column:
    """Whether the sizes allow a link and the odd bits, a lower bound of the symmetric difference, do not refute it."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (odd * (100 + percent) <= (n + m) * (100 - percent))


def components(links: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) for every node of ``links`` (a, b).

    Smallest-label passing with pointer jumping; each pass is stored, so lineage stays short.
    """
    both = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), "labels")
    while True:
        seen = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
        lower = labels.join(seen, labels["node"] == seen["a"]).select("node", F.col("component").alias("old"), F.least("component", "near").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("component").alias("next"))
        new = stored(lower.join(jump, "to", "left").select("node", "old", F.least("to", F.coalesce("next", "to")).alias("component")), "labels")
        moved = new.where("old != component").limit(1).count()
        drop_stored(labels)
        labels = new.select("node", "component")
        labels.stored_path = new.stored_path
        if not moved:
            drop_stored(both)
            return labels


@dataclass(frozen=True)
class Indexed:
    """What a join works on: texts, rows with their node, nodes (distinct sets), and the nodes of every shared signature."""

    texts: DataFrame
    rows: DataFrame
    nodes: DataFrame
    members: DataFrame


def indexed(docs: DataFrame, doc_id: str, text: str, n: int, percent: int, broadcast_rows: int) -> Indexed:
    """The index: ``members`` is sig, node, low (the signature's smallest node)."""
    bands = Bands(percent)
    texts = docs.select(*[c.alias(k) for k, c in row_keys(doc_id, text).items()], F.col(text).alias("__text"))
    rows = stored(described(texts, n, bands), "sets")
    nodes = stored(
        rows.where("node is not null").groupBy("node").agg(F.min("__id").alias("least"), F.min(F.struct("__id", "__text_hash")).alias("one"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.first("wide").alias("wide")), "nodes"
    )
    flat = rows.where("node is not null").select("node", F.explode("sigs").alias("sig"))
    counted = lambda of: of.groupBy("sig").agg(F.count("*").alias("rows"), F.min("node").alias("low"), F.max("node").alias("high")).where("low != high")
    shared = stored(counted(flat), "signatures")

    code = F.col("sig").bitwiseAND(CODES - 1).cast("int")
    costs = {r[0]: r[1] for r in shared.groupBy(code.alias("code")).agg(F.sum(F.col("rows") * (F.col("rows") - 1) / 2).cast("long")).collect()}  # at most CODES rows
    sizes = {r[0]: r[1] for r in rows.groupBy(F.floor(F.log2(F.greatest("n_shingles", F.lit(1))) * 8)).agg(F.max("n_shingles"), F.count("*")).select("max(n_shingles)", "count(1)").collect()}  # eight per doubling
    sets_in: dict[int, int] = {}
    for size, count in sizes.items():
        for g in bands.schemes(size):
            sets_in[g] = sets_in.get(g, 0) + count
    given, wide = allocate(costs, bands, sets_in)
    if given:
        shared = shared.where(~code.isin(*given))

    def members(flat: DataFrame, shared: DataFrame) -> DataFrame:
        """sig, node, low of every shared signature; two-row ones need no second look at the rows."""
        many = broadcast_within(shared.where("rows > 2").select("sig", "low"), broadcast_rows)
        pairs = shared.where("rows = 2").select("sig", "low", F.explode(F.array("low", "high")).alias("node"))
        return flat.join(many, "sig").select("sig", "low", "node").distinct().unionByName(pairs)

    found = members(flat, shared)
    if wide:
        more = stored(described(texts, n, bands, wide).where("node is not null").select("node", F.explode("sigs").alias("sig")).distinct(), "neighbourhoods")
        found = found.unionByName(members(more, counted(more)))
    return Indexed(texts, rows, nodes, stored(found, "members"))


def near_duplicates(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80, pivots: int = 2, broadcast_rows: int = 1_000_000,
) -> DataFrame:
    """One row per row of ``docs``: __id, __text_hash (``row_keys``), n_shingles, component (smallest id reachable by links),
    group (the same as a number that is never null where the text has words, even if all ids are).

    Rows link when 100 * intersection >= ``percent`` * union of their n-word shingle sets. Null or empty texts and
    texts of white space have empty sets and link to nothing: their component is their own id. Equal sets always link,
    so repeated rows share a component. The smallest id leaves null ids out unless all are null. Only the two named
    columns are read; an empty table gives an empty one. Shingles and sets are compared by 64-bit hashes.
    """
    x = indexed(docs, doc_id, text, n, percent, broadcast_rows)
    texts, rows, nodes, found = x.texts, x.rows, x.nodes, x.members
    about = nodes.select("node", "n", "sketch")
    a, b = nodes.select(F.col("node").alias("a"), F.struct("n", "wide").alias("x")), nodes.select(F.col("node").alias("b"), F.struct("n", "wide").alias("y"))

    def nearest(pairs: DataFrame, tried: DataFrame | None) -> DataFrame:
        """For each node (b) the pivot (a) whose sketch is nearest, among those it may link to and was not compared with."""
        pairs = pairs.distinct()
        if tried is not None:
            pairs = pairs.join(tried.unionByName(tried.select(F.col("b").alias("a"), F.col("a").alias("b"))), ["a", "b"], "left_anti")
        near = pairs.join(a, "a").join(b, "b").withColumn("odd", _wide_odd_bits("x", "y")).where(_may_link("x", "y", percent, F.col("odd")))
        one = near.groupBy("b").agg(F.min(F.struct("odd", "a")).alias("p")).select(F.col("p.a").alias("a"), "b")
        return stored(one.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")

    tried = nearest(found.where("low != node").select(F.col("low").alias("a"), F.col("node").alias("b")), None)
    linked = verified(tried, nodes, texts, n, percent, broadcast_rows)
    for turn in range(pivots):
        placed, open_sigs = _still_open(found, components(linked), turn)
        pivoted = placed.join(open_sigs, "sig").where(F.col("component") != F.col("pivot.component"))
        more = nearest(pivoted.select(F.col("pivot.node").alias("a"), F.col("node").alias("b")), tried)
        tried = tried.unionByName(more)
        linked = linked.unionByName(verified(more, nodes, texts, n, percent, broadcast_rows))

    placed, open_sigs = _still_open(found, components(linked), 0)
    still = stored(placed.join(open_sigs, "sig").join(about, "node").select("sig", "node", "component", F.struct("n", "sketch").alias("x")), "open")
    left, right = still.alias("l"), still.select("sig", F.col("node").alias("b"), F.col("component").alias("other"), F.col("x").alias("y"))
    rest = left.join(right, (F.col("l.sig") == right["sig"]) & (F.col("l.component") < F.col("other")) & _may_link("x", "y", percent, _odd_bits("x", "y")))
    rest = rest.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    rest = stored(rest.join(a, "a").join(b, "b").where(_may_link("x", "y", percent, _wide_odd_bits("x", "y"))).select("a", "b"), "pairs")
    linked = linked.unionByName(verified(rest, nodes, texts, n, percent, broadcast_rows))
    whole = components(linked)

    named = nodes.select("node", "least").join(whole, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = named.groupBy("component").agg(F.min("least").alias("name"))
    of_node = named.join(names, "component").select("node", "name", F.col("component").alias("group"))
    return rows.select("__id", "__text_hash", "n_shingles", "node").join(of_node, "node", "left").select("__id", "__text_hash", "n_shingles", F.when(F.col("node").isNull(), F.col("__id")).otherwise(F.col("name")).alias("component"), "group")


def links(x: Indexed, *, n: int = 5, percent: int = 80, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Every link between different sets: a, b (nodes, a < b), common (n-grams in both), either (n-grams in any of them).

    Copies are one node; ``x.rows`` has each document's. Candidates are all pairs of nodes that share a signature and whose
    sizes and sketches allow a link, tested within the join; what is left is verified on the whole sets.
    """
    known = x.members.select("sig", "node").distinct().join(x.nodes.select("node", F.struct("n", "sketch").alias("about")), "node")
    left, right = known.select("sig", F.col("node").alias("a"), F.col("about").alias("x")), known.select(F.col("sig").alias("s"), F.col("node").alias("b"), F.col("about").alias("y"))
    near = left.join(right, (F.col("sig") == F.col("s")) & (F.col("a") < F.col("b")) & _may_link("x", "y", percent, _odd_bits("x", "y")))
    wide = lambda node, to: x.nodes.select(F.col("node").alias(node), F.struct("n", "wide").alias(to))
    pairs = near.select("a", "b").distinct().join(wide("a", "x"), "a").join(wide("b", "y"), "b").where(_may_link("x", "y", percent, _wide_odd_bits("x", "y")))
    return verified(stored(pairs.select("a", "b"), "pairs"), x.nodes, x.texts, n, percent, broadcast_rows)


def link_counts(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80, broadcast_rows: int = 1_000_000) -> DataFrame:
    """One row per row of ``docs``: __id, __text_hash, n_shingles, component (as ``near_duplicates`` gives it) and n_links:
    the number of other rows that it links with, copies among them, which are counted and not expanded. Empty sets have
    no links. Nulls, repeats and empty tables as there.

    Unlike ``near_duplicates``, this looks at every pair of unlike sets in a group, so its work grows with the links.
    """
    x = indexed(docs, doc_id, text, n, percent, broadcast_rows)
    found = links(x, n=n, percent=percent, broadcast_rows=broadcast_rows)
    held = stored(x.rows.where("node is not null").groupBy("node").agg(F.count("*").alias("copies"), F.min("__id").alias("least")), "held")
    both = found.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(found.select(F.col("b").alias("node"), F.col("a").alias("other")))
    beyond = both.join(held.select(F.col("node").alias("other"), F.col("copies").alias("more")), "other").groupBy("node").agg(F.sum("more").alias("beyond"))
    placed = held.join(components(found), "node", "left").join(beyond, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = placed.groupBy("component").agg(F.min("least").alias("name"))
    of_node = placed.join(names, "component").select("node", "name", (F.col("copies") - 1 + F.coalesce("beyond", F.lit(0))).alias("n_links"))
    rows = x.rows.select("__id", "__text_hash", "n_shingles", "node").join(of_node, "node", "left")
    return rows.select("__id", "__text_hash", "n_shingles", F.when(F.col("node").isNull(), F.col("__id")).otherwise(F.col("name")).alias("component"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _still_open(members: DataFrame, parts: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """Members with their component, and the signatures whose nodes are not all in one, each with a node by chance as pivot."""
    placed = members.join(parts, "node", "left").select("sig", "node", F.coalesce("component", "node").alias("component"))
    chance = F.xxhash64("node", "sig", F.lit(turn))
    seen = placed.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min(F.struct(chance.alias("by"), "node", "component")).alias("pivot"))
    return placed, seen.where("lo != hi").select("sig", "pivot")


def verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, n: int, percent: int, broadcast_rows: int) -> DataFrame:
    """The pairs of nodes (a, b) whose whole sets link, with common and either. Sets are made again, for the nodes concerned only."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes, "node").select("node", F.col("one.__id").alias("__id"), F.col("one.__text_hash").alias("__text_hash"))
    wanted = broadcast_within(stored(wanted, "wanted"), broadcast_rows)
    of = texts.join(wanted, same_row(texts, wanted)).select("node", "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), _longs([shingles(t, n) for t in part.column(1).cast(pa.binary()).to_pylist()])], ["node", "s"])

    sets = of.mapInArrow(run, "node long, s array<long>").dropDuplicates(["node"])  # dealt by node as both joins need it
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("s")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("t")), "b")
    common = F.size(F.array_intersect("s", "t"))
    return stored(both.select("a", "b", common.alias("i"), (F.size("s") + F.size("t")).alias("z")).where(F.col("i") * 100 >= percent * (F.col("z") - F.col("i"))).select("a", "b", F.col("i").alias("common"), (F.col("z") - F.col("i")).alias("either")), "verified")
