"""Byte-level BPE against the library whose rank files it reads."""

import hashlib
import random
from array import array

import pytest
import regex

from assaykit.llm import byte_bpe
from assaykit.llm.queries import op11_byte_bpe

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def merges():
    return byte_bpe.Merges.read(PATH)


@pytest.fixture(scope="module")
def library(merges):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=merges.ranks, special_tokens={})


def encode(splitter, of_piece, text):
    return array("I", b"".join(of_piece[p] for run in splitter.blocks(text) for p in run)).tolist()


def test_query_equals_library(spark, sf_dir, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op11_byte_bpe(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_random_bytes_equal_library(merges, library):
    merges.check()
    machine, rnd = byte_bpe.Transducer(merges, max_states=2_000), random.Random(5)  # begins anew many times
    for _ in range(3_000):
        letters = rnd.choice([b"ab", b"a ", b"\xc3\xa9\xa7\xe4\xb8", bytes(range(256)), b"ethronaisETHRON-=_"])
        piece = bytes(rnd.choice(letters) for _ in range(rnd.randrange(1, 70)))
        assert machine.encode(piece).tolist() == library._encode_single_piece(piece)


@pytest.mark.parametrize("piece", [b"a" * 200_000, b" " * 200_001, "中文".encode() * 40_000, b"=-" * 99_999], ids=["a", "blank", "han", "signs"])
def test_long_pieces_in_bounded_lookahead(merges, library, piece):
    machine = byte_bpe.Transducer(merges)
    assert machine.encode(piece).tolist() == library._encode_single_piece(piece)
    assert len(machine.states) < 2_000
    assert max(len(rest) for state in machine.states.values() for _, _, rest in state.readings) < 64


def test_every_character_and_every_block_edge(merges, library):
    of_piece, splitter = byte_bpe.PieceIds(byte_bpe.Transducer(merges), 1_000), byte_bpe.Splitter(P.PATTERN)
    for first in range(0, 0x110000, 4096):
        for c in [*range(first, first + 24), *(range(first, first + 4096) if first in (0, 0x1000, 0x2000, 0xA000, 0x11000, 0x1E000) else ())]:
            if not 0xD800 <= c < 0xE000:
                text = f"a{chr(c)}1{chr(c)} {chr(c)}  {chr(c)}!{chr(c)}a§"
                assert encode(splitter, of_piece, text) == library.encode_ordinary(text), hex(c)
    short, rnd = byte_bpe.Splitter(P.PATTERN, block=7), random.Random(6)
    for _ in range(5_000):
        text = "".join(rnd.choice(["'", "'re", "'ll", "l", "e", "r", " ", "  ", "\n", "a1", "!", "é", "s", "\U00010400"]) for _ in range(rnd.randrange(40)))
        assert [p for run in short.blocks(text) for p in run] == regex.findall(P.PATTERN, text)


def test_streamed_utf8(merges):
    decoder, rnd = byte_bpe.Utf8Decoder(merges), random.Random(7)
    for _ in range(5_000):
        raw = bytes(rnd.choice(b"a\xc3\xa9\xe4\xb8\xad\xf0\x9f\x98\x80\xed\xa0\xf4\x90\xc0\xff") for _ in range(rnd.randrange(12)))
        ids = [merges.ranks[raw[i : i + 1]] for i in range(len(raw))]
        said = [decoder.feed([i]) for i in ids]  # token by token
        assert "".join(said) + decoder.finish() == raw.decode(errors="replace")
        assert decoder.feed(ids) + decoder.finish() == raw.decode(errors="replace")
    euro = [merges.ranks[bytes([b])] for b in "€".encode()]
    assert [decoder.feed([i]) for i in euro] == ["", "", "€"]
    assert decoder.feed([10**6]) == "�"


def test_odd_rows(spark, library):
    long = "word, " * 60_000
    rows = [(1, None, 7), (1, "", 7), (2, "a  b", 7), (2, "a  b", 7), (None, "é\n\n<|endoftext|>", 7), (3, long, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    done = byte_bpe.encode(df, PATH, P.PATTERN)
    assert done.columns == ["doc_id", "n_tokens", "ids"]
    got = sorted((r.doc_id or 0, r.n_tokens, array("I", bytes(r.ids)).tolist()) for r in done.collect())
    assert got == sorted((i or 0, len(library.encode_ordinary(t or "")), library.encode_ordinary(t or "")) for i, t, _ in rows)
    back = sorted((r.doc_id or 0, r.text) for r in byte_bpe.decode(done, PATH).collect())
    assert back == sorted((i or 0, t or "") for i, t, _ in rows)
    assert byte_bpe.encode(df.limit(0), PATH, P.PATTERN).count() == 0
    assert byte_bpe.decode(spark.createDataFrame([(None,)], "ids binary"), PATH).first().text is None
    with pytest.raises(ValueError, match="taken"):
        byte_bpe.decode(done.selectExpr("ids", "1 AS text"), PATH)


def test_improper_vocabularies_are_refused():
    single = {bytes([i]): i for i in range(256)}
    with pytest.raises(ValueError, match="each byte"):
        byte_bpe.Merges({b"a": 0})
    with pytest.raises(ValueError, match="can't be made"):
        byte_bpe.Merges(single | {b"abc": 256}).check()
    with pytest.raises(ValueError, match="rise"):
        byte_bpe.Merges(single | {b"xab": 256, b"ab": 257}).check()
