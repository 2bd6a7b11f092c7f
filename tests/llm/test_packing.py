import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from assaykit.llm import packing
from assaykit.llm.queries import op2_packing

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", " \n\t ", "don't STOP now", "á é\x1c\x1dx", "<|endoftext|> x<|startoftext|>y", "it's 'll we'd   ́ 12 345 ¿qué? ÀÉ ß", "가 ᆨ à̕", "z" * 300, "Th,a. THAND!! thand*** ÉLAN, a%%% don't. x's| (it) [ok] I'LL! <|endoftext|>.", "word " * 9000]


def brute(texts, size=4096):
    tok = Tokenizer.from_file(PATH)
    out = []
    for n, t in enumerate(texts):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        for p, s in enumerate(range(0, len(ids), size)):
            cut = ids[s : s + size]
            out.append((n, p, s, len(cut), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in cut))))
    return sorted(out)


def placed_well(rows, size=4096):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= size
    return len(bins)


def test_pieces_equal_whole_text_encoding(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = packing.pieces(df, PATH).collect()
    assert sorted(tuple(r) for r in got) == brute(TEXTS)


def test_query_on_table(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op2_packing(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == brute([docs[i] for i in range(len(docs))])
    total = sum(r.length for r in rows)
    assert placed_well(rows) <= -(-total // 4096) + 2


@pytest.mark.parametrize("parts", [1, 9])
def test_rounds_merge_underfull_bins(spark, parts):
    lengths = [(n * 7919) % 97 + 1 for n in range(2000)]
    df = spark.createDataFrame([(n, x) for n, x in enumerate(lengths)], "k long, length int").repartition(parts)
    rows = packing.pack(df, size=100, task_items=150).collect()
    assert sorted((r.k, r.length) for r in rows) == list(enumerate(lengths))
    assert placed_well(rows, 100) <= -(-sum(lengths) // 100) * 1.04 + 2


def test_items_that_cannot_share_end(spark):
    df = spark.createDataFrame([(n, 60) for n in range(500)], "k long, length int").repartition(7)
    rows = packing.pack(df, size=100, task_items=40).collect()
    assert placed_well(rows, 100) == 500


def test_nulls_repeats_clashing_names_and_empty(spark):
    df = spark.createDataFrame([(None, "a b", 1, 2), (None, "a b", 1, 2), (3, None, 1, 2)], "doc_id long, text string, offset long, piece int")
    rows = packing.pack_documents(df, PATH).collect()
    assert len(rows) == 3 and placed_well(rows) == 1
    assert packing.pack_documents(df.limit(0), PATH).count() == 0


def test_sequences_hold_the_ids(spark):
    df = spark.createDataFrame([(n, f"hello world {n} " * 40) for n in range(30)], "doc_id long, text string")
    placed = packing.pack_documents(df, PATH, size=512)
    tok = Tokenizer.from_file(PATH)
    want = sorted(x for n in range(30) for x in [*tok.encode(f"hello world {n} " * 40, add_special_tokens=False).ids, 1])
    got = packing.sequences(df, placed, PATH, size=512).collect()
    assert sorted(x for r in got for x in r.ids) == want and all(len(r.ids) <= 512 for r in got)


def test_any_other_vocabulary_is_encoded_whole(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert not packing.WordIds(path, 10).wordwise and packing.WordIds(PATH, 10).wordwise
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    tok = Tokenizer.from_file(path)
    got = packing.pieces(df, path, size=100_000, keep_ids=True).collect()
    assert {r.doc_id: r.ids for r in got} == {n: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for n, t in enumerate(TEXTS)}
