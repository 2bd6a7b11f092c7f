"""Best-fit packing: partitions pack locally, nearly full bins are final, the rest tree-merge as items of later rounds.

Tokenising happens once, per partition, and its result (a narrow row per piece, no token ids unless asked for) is
stored. Each round packs its partitions by best fit, longest first; a bin with at most ``slack`` tokens free is
emitted for good and any other becomes one item of the next round, which has an eighth of the partitions, down to
one. A task never holds more than ``task_items`` items: it packs that many, then goes on. If a round frees under
``least_gain`` of its bins (items that cannot share, such as all of just over half the size), its bins are final too, at
any size of the input, so the root never gathers the corpus.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import slices, stored

_ENCODERS: dict[str, WordIds] = {}


#: How a vocabulary must clean and part texts for its words to be encoded one by one.
WORDWISE_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORDWISE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORDWISE_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": WORDWISE_PATTERN}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
WORD_END = "</w>"
LATIN = "^[A-Za-zÀ-ÖØ-öø-į]+$"  # letters that each have one lower case and no other composed form


class WordIds:
    """Token ids of texts, as little-endian unsigned 32-bit bytes.

    A vocabulary that drops white space and parts letters from signs (checked when it is loaded) gives a text the ids of
    its runs of other bytes, one after the other, and Latin letters with signs behind them those of the letters, in
    lower case, and of the signs. Such letters go to the model as one string per batch, without the cleaning that
    they don't need, and are told apart by the word ends. Letters, and runs of any other kind, are kept for the life of the
    Python worker; emptied when full; those of over 64 bytes are not remembered. Texts of any other vocabulary are encoded whole.
    """

    SIGNS = ".,;:!?*%$#&|)]"
    BEFORE_SIGNS = r"(?s)^.*[^.,;:!?*%$#&|)\]]"

    def __init__(self, path: str, limit: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        self.wordwise = (
            described["normalizer"] == WORDWISE_NORMALIZER
            and described["pre_tokenizer"] == WORDWISE_PRE_TOKENIZER
            and described["model"].get("end_of_word_suffix") == WORD_END
            and not any(set(x["content"]).isdisjoint("<>|") for x in described["added_tokens"])
        )
        if self.wordwise:
            self.model = Tokenizer.from_file(path)
            self.model.normalizer = normalizers.Sequence([])
            self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            vocabulary = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        self.limit = limit
        self.parts: dict[bytes, bytes] = {}

    def _add(self, new: list[bytes], letters: list[bool]) -> None:
        words = [x for x, plain in zip(new, letters, strict=True) if plain]
        for at in range(0, len(words), 1000):
            some = words[at : at + 1000]
            ids = np.array(self.model.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, np.uint32)
            edges = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
            raw = ids.tobytes()
            self.parts.update(zip(some, [raw[i:j] for i, j in zip([0, *edges], edges)], strict=True))
        others = [x for x, plain in zip(new, letters, strict=True) if not plain]
        for part, got in zip(others, self.tokenizer.encode_batch_fast([x.decode() for x in others], add_special_tokens=False), strict=True):
            self.parts[part] = array("I", got.ids).tobytes()

    def _of_parts(self, parts: pa.StringArray) -> pa.Array:
        """Ids of distinct parts."""
        listed, known = parts.cast(pa.binary()).to_pylist(), self.parts
        at = [i for i, x in enumerate(listed) if x not in known]
        if len(known) + len(at) > self.limit:
            known.clear()
            at = range(len(listed))
        new = [listed[i] for i in at]
        self._add(new, pc.match_substring_regex(parts.take(pa.array(at, pa.int64())), LATIN).to_pylist())
        out = pa.array(list(map(known.__getitem__, listed)), pa.large_binary())
        for x in new:
            if len(x) > 64:
                del known[x]
        return out

    def _of_runs(self, runs: pa.StringArray) -> pa.Array:
        """Ids of distinct runs."""
        core = pc.utf8_rtrim(runs, self.SIGNS)
        plain = pc.match_substring_regex(core, LATIN)
        core = pc.if_else(plain, pc.utf8_lower(core), runs).dictionary_encode()
        signs = pc.if_else(plain, pc.replace_substring_regex(runs, self.BEFORE_SIGNS, ""), "").dictionary_encode()
        return pc.binary_join_element_wise(*[self._of_parts(x.dictionary).take(x.indices) for x in (core, signs)], pa.scalar(b"", pa.large_binary()))

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text (string, not null)."""
        if not self.wordwise:
            return [array("I", got.ids).tobytes() for got in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        lists = pc.ascii_split_whitespace(texts)
        runs = lists.flatten().dictionary_encode()
        ids = self._of_runs(runs.dictionary).take(runs.indices)
        raw, ends = ids.buffers()[2].to_pybytes() if len(ids) else b"", np.frombuffer(ids.buffers()[1], np.int64)[: len(ids) + 1]
        edges = ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()].tolist()
        return [raw[i:j] for i, j in zip(edges[:-1], edges[1:], strict=True)]


def pieces(docs: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", size: int = 4096, end_id: int = 1, keep_ids: bool = False, cache_runs: int = 1_000_000) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, ids (array<int>).

    A document is its token ids, then ``end_id``; only one of more than ``size`` ids is cut, every ``size`` ids. Null
    text is empty: ``end_id`` alone. Each row of docs is a document, repeated and null ids included; only the two
    named columns are read. ``cache_runs``: words that a Python worker remembers, some 200 bytes each.
    """
    id_type = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {id_type}, piece int, start long, length int, ids_crc32 long" + (", ids array<int>" if keep_ids else "")
    end, width = end_id.to_bytes(4, "little"), 4 * size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _ENCODERS:
            _ENCODERS[tokenizer] = WordIds(tokenizer, cache_runs)
        encoder = _ENCODERS[tokenizer]
        encoder.limit = cache_runs
        for batch in batches:
            for part in slices(batch, 1, 6_000_000):
                cols: dict[str, list] = {c: [] for c in ("row", "piece", "start", "length", "crc", "ids")}
                for row, ids in enumerate(encoder.encode(part.column(1).fill_null(""))):
                    ids += end
                    for n, start in enumerate(range(0, len(ids), width)):
                        cut = ids[start : start + width]
                        for c, v in (("row", row), ("piece", n), ("start", start // 4), ("length", len(cut) // 4), ("crc", zlib.crc32(cut))):
                            cols[c].append(v)
                        if keep_ids:
                            cols["ids"].append(memoryview(cut).cast("i").tolist())
                arrays = [part.column(0).take(pa.array(cols["row"], pa.int32())), pa.array(cols["piece"], pa.int32()), pa.array(cols["start"], pa.int64()), pa.array(cols["length"], pa.int32()), pa.array(cols["crc"], pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    arrays.append(pa.array(cols["ids"], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(run, schema)


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Bins as lists of item numbers: longest first, each into the open bin that it leaves fullest."""
    bins: list[list[int]] = []
    free: list[list[int]] = [[] for _ in range(size + 1)]  # bins by tokens free
    any_free = 0  # bit r: some bin has r tokens free
    for item in sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True):
        need = lengths[item]
        fits = any_free >> need
        if fits:
            room = need + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                any_free ^= 1 << room
        else:
            room, b = size, len(bins)
            bins.append([])
        bins[b].append(item)
        if room > need:
            free[room - need].append(b)
            any_free |= 1 << (room - need)
    return bins


def pack(cut: DataFrame, *, size: int = 4096, slack: int = 2, fan_in: int = 8, task_items: int = 200_000, least_gain: float = 0.02) -> DataFrame:
    """Places ``pieces`` (any rows with a ``length`` of 1 to ``size``) into sequences.

    The rows of ``cut`` plus sequence_id (long, any numbers) and offset (long), gapless from 0 in each sequence.
    Repeated rows are separate items; ties in length go by arrival, any outcome is valid. An empty table gives an
    empty one. Columns of ``cut`` named sequence_id or offset are replaced.
    """
    rows = cut.drop("sequence_id", "offset")
    fields = rows.columns
    member = rows.schema.simpleString()
    items = rows.select(F.col("length").cast("int").alias("fill"), F.array(F.struct(*fields)).alias("members"))
    schema = f"final boolean, sequence_id long, fill int, members array<{member}>"

    def round_of(number: int, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            made, part = 0, TaskContext.get().partitionId()

            def packed() -> Iterator[pa.RecordBatch]:
                nonlocal made
                t = pa.Table.from_batches(held).combine_chunks()
                held.clear()
                fills, lists = t.column("fill").to_pylist(), t.column("members").combine_chunks()
                bins = best_fit(fills, size)
                at = lists.offsets.to_numpy()
                values = lists.values
                for begin in range(0, len(bins), 5000):
                    some = bins[begin : begin + 5000]
                    order, ends = [], [0]
                    for b in some:
                        for i in b:
                            order.extend(range(at[i], at[i + 1]))
                        ends.append(len(order))
                    fill = [sum(fills[i] for i in b) for b in some]
                    ids = [number << 56 | part << 32 | made + n for n in range(len(some))]
                    made += len(some)
                    members = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values.take(pa.array(order, pa.int64())))
                    yield pa.RecordBatch.from_arrays([pa.array([last or size - f <= slack for f in fill]), pa.array(ids, pa.int64()), pa.array(fill, pa.int32()), members], ["final", "sequence_id", "fill", "members"])

            for batch in batches:
                held.append(batch)
                if sum(b.num_rows for b in held) >= task_items:
                    yield from packed()
            if held:
                yield from packed()

        return run

    done, number = [], 0
    while True:
        parts = items.rdd.getNumPartitions()
        out = stored(items.mapInArrow(round_of(number, last=number > 0 and parts == 1), schema), f"pack{number}")
        done.append(out)
        left, before = out.where(~F.col("final")).count(), items.count() if number else None
        if left == 0 or parts == 1 and number or before is not None and left > (1 - least_gain) * before:
            break
        number += 1
        want = max(-(-left // task_items), min(parts // fan_in, -(-left // 1000)), 1)
        items = out.where(~F.col("final")).select("fill", "members").repartition(want)
    # rows that a later round took over are not final; of the last round all are
    bins = None
    for n, out in enumerate(done):
        part = out if n == len(done) - 1 else out.where("final")
        bins = part if bins is None else bins.unionByName(part)
    placed = bins.select("sequence_id", F.posexplode("members").alias("__n", "m"), "members")
    before_it = F.aggregate(F.slice("members", F.lit(1), F.col("__n")), F.lit(0).cast("long"), lambda acc, m: acc + m["length"])
    return placed.select("m.*", "sequence_id", before_it.alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", size: int = 4096, end_id: int = 1, slack: int = 2, cache_runs: int = 1_000_000) -> DataFrame:
    """``pack`` of ``pieces``, the tokenised pieces stored first so that no round tokenises again."""
    return pack(stored(pieces(docs, tokenizer, doc_id=doc_id, text=text, size=size, end_id=end_id, cache_runs=cache_runs), "pieces"), size=size, slack=slack)


def sequences(docs: DataFrame, placed: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", size: int = 4096, end_id: int = 1) -> DataFrame:
    """The training sequences themselves: sequence_id, ids (array<int>), from the documents and their placement.

    Ids must be unique and not null here, since they join the pieces to their places.
    """
    cut = pieces(docs, tokenizer, doc_id=doc_id, text=text, size=size, end_id=end_id, keep_ids=True)
    both = cut.select("doc_id", "piece", "ids").join(placed.select("doc_id", "piece", "sequence_id", "offset"), ["doc_id", "piece"])
    return both.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
