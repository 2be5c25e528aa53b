import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from haltwerk.llm import chunked, mixing_coder, scratch, separator_scan, token_files, viterbi

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "", " ", "plain text here", "  two  spaces  ", "tabs\tand\nlines \n \n\nmore\r\n x", "é é ́b ΑΣ ς İI",
    "<|endoftext|> in <|startoftext|>text", "<|ENDOFTEXT|>. A.B, c1. é. ́. ½! x²?? a&&&b &&& #", "it's DON'T 12 345", "x\x1cy\x85z\xa0w　v", "nul \x00 byte", "🙂 emoji 你好", "x" * 700,
    "▁ sign", "a b " * 400,
]


@pytest.mark.parametrize(("make", "path", "plain"), [(chunked.spaceless_encoder, WORDS, False), (chunked.spaced_encoder, BYTES, True)])
def test_chunks_give_the_ids_of_whole_texts(make, path, plain, spark):
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = plain
    texts = TEXTS + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for text, ids in zip(texts, make(path)(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_streaming_search_equals_the_full_table(spark):
    pieces, encode, decode = viterbi.loaded(PIECES), viterbi.encoder(PIECES), viterbi.decoder(PIECES)
    texts = TEXTS + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).collect()]
    for text, ids in zip(texts, encode(texts), strict=True):
        marked = viterbi.SPACE + text.replace(" ", viterbi.SPACE) if text else ""
        got = np.frombuffer(ids, "<u4").tolist()
        assert got == brute.viterbi(pieces, marked)
        whole = viterbi.Search(pieces)
        assert whole.feed(marked) + whole.end() == got
        assert decode(ids) == text.replace(viterbi.SPACE, " ")


def test_a_word_within_the_window_is_searched_once(monkeypatch):
    pieces, passes, real = viterbi.loaded(PIECES), [], viterbi.Search._advance
    monkeypatch.setattr(viterbi.Search, "_advance", lambda self, until: (passes.append(until), real(self, until))[1])
    for word in (viterbi.SPACE + "therbleti", "", "\u1234", "e" * pieces.longest):
        passes.clear()
        assert viterbi.search(pieces, word) == brute.viterbi(pieces, word) and passes == [len(word)]


def test_the_window_stays_small():
    run = viterbi.Search(viterbi.loaded(PIECES))
    ids = run.feed("thethere" * 20_000)
    assert len(ids) > 10_000 and run.widest < 5_000


def test_encoded_rows(odd, nothing):
    rows = {r.doc_id: r for r in viterbi.encoded(odd, PIECES).collect()}
    assert rows[4].ids == [] and rows[3].n_tokens == 0 and rows[6].same and not rows[10].same
    assert viterbi.encoded(nothing, PIECES).collect() == []


@pytest.mark.parametrize("n", [1, 2, 31, 32, 33, 100, 1000])
@pytest.mark.parametrize("kinds", [1, 3, 200, 65_536])
def test_coder_round_trip(n, kinds):
    ids = np.random.default_rng(n).integers(0, kinds, n)
    assert (mixing_coder.decode(mixing_coder.encode(ids, 65_536, block=32)) == ids).all()


def test_coder_learns_checks_and_resets():
    ids = np.tile(np.arange(50), 100)
    data = mixing_coder.encode(ids, 50_000, block=1000)
    assert len(data) < len(ids) / 2 and len(mixing_coder.decode(b"")) == 0
    size = mixing_coder.HEAD.unpack_from(data)[4] + mixing_coder.HEAD.size
    assert (mixing_coder.decode(data[size:]) == ids[1000:]).all()  # a block needs none before it
    with pytest.raises(ValueError):
        mixing_coder.decode(data[:-1])
    for at in (0, 4, 13, mixing_coder.HEAD.size + 5):
        broken = bytearray(data)
        broken[at] ^= 64
        with pytest.raises(ValueError):
            mixing_coder.decode(bytes(broken))
    with pytest.raises(ValueError):
        mixing_coder.encode(np.array([7]), 7)


def test_token_files_equal_the_library(spark, odd, odd_rows, nothing, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT_IDS", 5_000)
    monkeypatch.setattr(token_files, "SPAN", 2)
    library = Tokenizer.from_file(WORDS)
    path = f"{scratch.shared_folder(spark)}/test-{np.random.default_rng().integers(1 << 60)}"
    token_files.write(odd, path, WORDS, end_id=2, alphabet=49_408)
    rows = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, start = [], 0
    for r in rows:
        ids = np.array([*library.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((r[0], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    table = spark.read.parquet(path)
    got = sorted(map(tuple, token_files.digest(table).select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1])
    assert got == want
    assert table.count() > 1 and {len(r.ids) // 4 for r in token_files.read(table).collect()} == {w[2] for w in want}
    token_files.write(nothing, path + "0", WORDS, end_id=2, alphabet=49_408)
    assert token_files.digest(spark.read.parquet(path + "0")).collect() == []


@pytest.mark.parametrize("block", [7, 64, 1 << 17])
def test_scan_equals_a_loop(spark, odd, odd_rows, nothing, monkeypatch, block):
    monkeypatch.setattr(separator_scan, "GROUP", 3)
    library = Tokenizer.from_file(BYTES)
    library.encode_special_tokens = True
    few = odd.where("doc_id is null or doc_id not in (6, 7)") if block == 7 else odd
    streams = scratch.written(separator_scan.flat(few, BYTES, 50_256, block), "streams")
    got = separator_scan.named(separator_scan.scan(streams, 50_256), streams).collect()
    length = {r[0]: len(library.encode(r[1] or "", add_special_tokens=False).ids) for r in odd_rows}
    assert len(got) == few.count() and all(r.ended and r.n_tokens == length[r.doc_id] for r in got)
    by_file = {}
    for r in sorted(got, key=lambda r: (r.file, r.ordinal)):
        assert r.start == by_file.get(r.file, 0)
        by_file[r.file] = r.start + r.n_tokens + 1
    assert separator_scan.scan(separator_scan.flat(nothing, BYTES, 50_256), 50_256).collect() == []


def test_scan_of_binary_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(separator_scan, "GROUP", 2)
    np.array([5, 9, 1, 2, 3, 9, 9, 4], "<u2").tofile(tmp_path / "a.bin")
    np.array([9, 1, 9], "<u2").tofile(tmp_path / "b.bin")
    np.array([], "<u2").tofile(tmp_path / "c.bin")
    blocks = separator_scan.file_blocks(spark, str(tmp_path), block_ids=2)
    got = sorted((r.file[-5:], r.ordinal, r.start, r.n_tokens, r.ended) for r in separator_scan.scan(blocks, 9).collect())
    a = [(0, 0, 1, True), (1, 2, 3, True), (2, 6, 0, True), (3, 7, 1, False)]
    b = [(0, 0, 0, True), (1, 1, 1, True)]
    assert got == [("a.bin", *x) for x in a] + [("b.bin", *x) for x in b]
