import functools
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer
from xxhash import xxh64_intdigest

from tillroll.llm import packing, queries, token_files
from tillroll.llm.tokens import Encoder
from tests.conftest import SF_SMALL

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
ODD = ["", " ", "\n\n a", "a\tb", "a \u00a0 b", "x  y   z ", "it's I'LL don't", "<|endoftext|> a", "é\u0301 e\u0301 \u0301", "\x1c a",
       "12,345.67 ...!!", "日本語 テスト", "Σ ΣΑΣ σας", "a\r\nb", "\u200b a", "word," * 30, "naïve ﬁ ½", "3.5, x., a.. b,. é, (z), 1,000.", " ", " a", "\na", " \na b", "a\nb c", "\n", "a ", "a\n", "  a", "\n\na", "it's, I'll.", "\ufeffx", " lead", "trail ", "a*** b!? c:\nd...  e) f'. g.'s h_ i-j- k\n\n.", "x\x01. y.", "end.", "= \u0338 a=\u0338 a= b"]


@functools.cache
def whole(name):
    return Tokenizer.from_file(queries._tokenizer(name))


def ids_of(name, text):
    return np.array(whole(name).encode(text, add_special_tokens=False).ids, "<u4")


@pytest.mark.parametrize("name", FILES)
def test_chunked_encoding_is_the_library_s(small, name):
    enc = Encoder(queries._tokenizer(name))
    texts = [*ODD, *[t for (t,) in small("documents", "text")]]
    for text, ids in [*zip(texts, enc.encode(texts)), *[(t, enc.encode([t])[0]) for t in ODD]]:
        assert np.frombuffer(ids, "<u4").tolist() == whole(name).encode(text, add_special_tokens=False).ids, text[:80]
    assert enc.encode([]) == []


@pytest.mark.parametrize("name", FILES)
def test_words_of_letters_are_encoded_as_in_whole_texts(name):
    # \u1c89 and U+16D40 are letters only since Unicode 16, \u0e33 and \u0345 decompose or combine, \ufb01 is a ligature
    words = ["größe", "ñandú", "ÅÉÎ", "тест", "Σίσυφος", "日本語", "ไทยำ", "한글", "עברית", "\u1c89\u1c8a", "\U00016d40", "x\u0345y", "\ufb01n", "ªº", "ßß",
             "\u1100\u1161", "Ġa", "Ċb", "a_b", "1a", "aé9"]
    text = " ".join(words) + "\n" + "\n".join(words) + "\n" + ", ".join(words) + "."
    enc = Encoder(queries._tokenizer(name))
    for t in [text, text, *words, *(f"x {w}" for w in words), *(f"x\n{w} y" for w in words)]:
        assert np.frombuffer(enc.encode([t])[0], "<u4").tolist() == whole(name).encode(t, add_special_tokens=False).ids, t[:80]


def test_byte_level_words_need_no_pre_tokenizer_and_long_ones_no_memory(monkeypatch):
    enc = Encoder(queries._tokenizer(FILES[0]))
    sent = []
    monkeypatch.setattr(enc, "_ids", lambda texts, ids=enc._ids: sent.extend(texts) or ids(texts))
    text = "one " + " ".join("w" + "ä" * k + "x" * n for n in range(40) for k in range(30)) + "\nNext line 12 a-b"
    ids = np.frombuffer(enc.encode([text])[0], "<u4").tolist()
    assert ids == whole(FILES[0]).encode(text, add_special_tokens=False).ids
    assert sorted(sent) == [" 12", " a-b", "one"]
    assert 0 < max(map(len, enc.seen)) <= 13
    # what is kept stays bounded, whatever comes
    enc.keep = 100
    for n in range(20):
        words = [f"{chr(97 + n)}{chr(97 + a)}{chr(97 + b)}" for a in range(10) for b in range(10)]
        enc.encode(["x " + " ".join(words)])
        assert len(enc.seen) <= 200 and len(enc.older) <= 1200


def test_blocks_round_trip():
    rng = np.random.default_rng(3)
    for ids in ([5], [0, 2 ** 32 - 1], [7] * 256, rng.integers(0, 50_000, 256), np.r_[rng.integers(100, 110, 250), [2 ** 31] * 6]):
        data, exceptions = token_files.pack_block(np.array(ids, np.uint32))
        assert token_files.unpack_block(data, 0, exceptions).tolist() == list(ids)
    docs = [(None, b""), (-3, np.arange(1000, dtype="<u4").tobytes()), (9, b"")]
    back = list(token_files.read_file(token_files.write_file(docs)))
    assert [(i, x.astype("<u4").tobytes()) for i, x in back] == docs
    # the percentile width keeps a block with few outliers small
    assert len(token_files.pack_block(np.r_[rng.integers(0, 16, 250), [2 ** 31] * 6].astype(np.uint32))[0]) < 200


def expected_files(rows, name):
    start, out = 0, []
    signed = lambda h: h - 2 ** 64 if h >= 2 ** 63 else h
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, signed(xxh64_intdigest(r[1] or "", seed=42)))):
        ids = np.r_[ids_of(name, t or ""), [2]].astype("<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_files_over_whole_table(spark, small):
    got = sorted(map(tuple, queries.op7_token_files(spark, SF_SMALL).collect()))
    assert got == sorted(expected_files(small("documents", "doc_id, text"), FILES[0]))


def test_files_cases(spark, docs_of):
    rows = [(3, "b"), (3, "a a"), (None, "none"), (1, None), (2, ""), (-5, "x " * 3000), (3, "b")]
    files = token_files.write(docs_of(rows, True), queries._tokenizer(FILES[0]), 2, file_ids=100)
    got = sorted(map(tuple, token_files.read(files).collect()), key=lambda r: r[1])
    assert got == expected_files(rows, FILES[0])
    assert token_files.read(token_files.write(docs_of([]), queries._tokenizer(FILES[0]), 2)).count() == 0


def check_packing(rows, got, size):
    """Whole documents, gapless sequences within the size, and few of them."""
    want = sorted((i, k, k * size, len(ids[k * size:(k + 1) * size]), zlib.crc32(ids[k * size:(k + 1) * size].tobytes()))
                  for i, t in rows for ids in [np.r_[ids_of(FILES[1], t or ""), [1]].astype("<u4")]
                  for k in range(-(-len(ids) // size)))
    assert sorted(r[:5] for r in got) == want
    by = {}
    for *_, length, _, seq, offset in got:
        by.setdefault(seq, []).append((offset, length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return len(by), -(-sum(r[3] for r in got) // size)


def test_packing_over_whole_table(spark, small):
    got = [tuple(r) for r in queries.op9_packing(spark, SF_SMALL).collect()]
    bins, least = check_packing(small("documents", "doc_id, text"), got, 4096)
    assert bins <= least + 1


def test_packing_levels_and_cases(spark, docs_of):
    rows = [(i, "word " * (i % 37)) for i in range(400)] + [(7, "word " * 7), (9, None), (9, "")]
    out = packing.pack_documents(docs_of(rows, True), queries._tokenizer(FILES[1]), size=64, group_pieces=20)
    bins, least = check_packing(rows, [tuple(r) for r in out.collect()], 64)
    assert bins <= least * 1.02 + 1
    assert packing.pack_documents(docs_of([]), queries._tokenizer(FILES[1])).count() == 0


def test_pieces_that_share_no_sequence_stay_in_small_groups(spark):
    lengths = [40] * 400 + [10] * 30
    pieces = spark.createDataFrame([(i, 0, 0, n, 0, i) for i, n in enumerate(lengths)], packing.PIECES)
    got = packing.place(pieces, 64, group_pieces=20).collect()
    assert len(got) == len(lengths) and len({r["sequence_id"] for r in got}) == 400 == packing.least_bins(lengths, 64)
    groups = Counter(r["sequence_id"] >> 24 for r in got)
    assert max(groups.values()) < 60


def test_search_beats_best_fit_where_exchange_helps():
    rng = np.random.default_rng(5)
    won = 0
    for _ in range(60):
        lengths = rng.integers(20, 60, 30).tolist()
        bins = packing._Bins(lengths, 100)
        bins.best_fit_decreasing()
        before = sum(map(bool, bins.items))
        squares = sum(f * f for f in bins.fill)
        bins.search()
        assert sorted(i for b in bins.items for i in b) == list(range(30))
        assert all(sum(lengths[i] for i in b) == f <= 100 for b, f in zip(bins.items, bins.fill))
        after = sum(map(bool, bins.items))
        assert packing.least_bins(lengths, 100) <= after <= before and sum(f * f for f in bins.fill) >= squares
        won += after < before
    assert packing.least_bins([51] * 9, 100) == 9 and packing.least_bins([], 100) == 0
    assert len(packing.pack([6, 5, 5, 4, 4, 3, 3], 15)) == 2
