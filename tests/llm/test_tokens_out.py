"""Framed records (op4) and best-fit packing (op10) against direct encodings."""

import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from motorsight.llm import packing, queries, records
from motorsight.llm.common import new_folder
from motorsight.llm.tokens import WordEncoder

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"
ODD = "ab Zz\n\t\r\x0b\x1c\x1f é İΣσ's'LL.,!$%#<|>019_中\U0001f600  ́"
ENCODERS = {}


def encoder(mode):
    if mode not in ENCODERS:
        ENCODERS[mode] = WordEncoder({"word": WORD, "byte": BYTE}[mode], mode)
    return ENCODERS[mode]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.none() | st.text(alphabet=ODD, max_size=40) | st.text(max_size=30), max_size=5), st.sampled_from(["word", "byte"]))
def test_word_encoder_gives_the_librarys_ids(texts, mode):
    own = encoder(mode)
    expected = [e.ids for e in own.tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    got = own.encode(pa.array(texts, pa.string()))
    ends = np.cumsum(got.size)
    assert [got.flat[b - n: b].tolist() for b, n in zip(ends, got.size)] == expected


PARTS = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "\n", "\n\n", " ", "  ", "\t", "hello", "World.", "é", "'s", "7", "<|endof"]


@pytest.mark.parametrize("mode", ["word", "byte"])
def test_word_encoder_around_added_tokens(mode):
    """Texts of added tokens, white space and words: the library cuts at an added token first."""
    rnd, own = random.Random(9), encoder(mode)
    texts = ["hello world.\n\n<|endoftext|>\n\nnext text"]
    texts += ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(1, 9))) for _ in range(4000)]
    expected = [e.ids for e in own.tok.encode_batch(texts, add_special_tokens=False)]
    got = own.encode(pa.array(texts, pa.string()))
    ends = np.cumsum(got.size)
    assert [got.flat[b - n: b].tolist() for b, n in zip(ends, got.size)] == expected


def test_word_encoder_on_the_fixture_texts(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    for mode in ("word", "byte"):
        own = encoder(mode)
        got = own.encode(pa.array(texts, pa.string()))
        expected = [e.ids for e in own.tok.encode_batch(texts, add_special_tokens=False)]
        assert got.flat.tolist() == [x for ids in expected for x in ids]
        assert got.size.tolist() == [len(ids) for ids in expected]


def test_crc32c_known_values_and_lengths():
    assert records.crc32c([b"123456789"])[0] == 0xE3069283
    assert records.crc32c([bytes(32)])[0] == 0x8A9136AA

    def slow(data):
        c = 0xFFFFFFFF
        for b in data:
            c ^= b
            for _ in range(8):
                c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
        return c ^ 0xFFFFFFFF

    parts = [random.Random(n).randbytes(n) for n in (0, 1, 7, 511, 512, 513, 1024, 3000)]
    assert records.crc32c(parts).tolist() == [slow(p) for p in parts]


def expected_records(docs):
    tok, out, start = Tokenizer.from_file(WORD), [], 0
    for key, text in docs:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((key, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def test_op4_equals_direct_encoding(spark):
    docs = sorted(tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    assert sorted(tuple(r) for r in queries.op4_records(spark, SF).collect()) == expected_records(docs)


def test_records_edge_rows_and_broken_files(spark):
    rows = [(None, "x y"), (3, None), (3, "b"), (3, "b"), (1, ""), (-5, "w " * 5000)]
    df = spark.createDataFrame([(*r, "n") for r in rows], "doc_id long, text string, part string")
    folder = new_folder(spark, "t")
    index = records.write_records(df, folder, WORD, "word", 1)
    got = [(r.doc_id, r.n_tokens) for r in records.read_records(index, folder).orderBy("start").collect()]
    assert [k for k, _ in got] == [None, -5, 1, 3, 3, 3] and got[2][1] == 1
    some = records.read_records(index.filter("doc_id = 3").orderBy("length"), folder)
    assert some.count() == 3
    assert records.write_records(df.limit(0), new_folder(spark, "t"), WORD, "word", 1).count() == 0
    path = f"{folder}/data/" + index.filter("doc_id = -5").first().file
    blob = bytearray(open(path, "rb").read())
    blob[-200] ^= 1
    open(path, "wb").write(blob)
    with pytest.raises(Exception, match="checksum"):
        records.read_records(index, folder).collect()


def check_packing(rows, capacity):
    """Gapless sequences within the capacity; every document whole."""
    by, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id].append((r.piece, r.start, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return by, docs


def test_op10_places_every_piece_once(spark):
    tok = Tokenizer.from_file(BYTE)
    rows = queries.op10_packing(spark, SF).collect()
    by, docs = check_packing(rows, 2048)
    crc = {(r.doc_id, r.piece): r.ids_crc32 for r in rows}
    total = 0
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 0]
        parts, at = sorted(docs.pop(r.doc_id)), 0
        for i, (piece, start, length) in enumerate(parts):
            assert piece == i and start == at and (i == 0 or length == 2048)
            assert crc[r.doc_id, piece] == zlib.crc32(struct.pack(f"<{length}I", *ids[at: at + length]))
            at += length
        assert at == len(ids)
        total += at
    assert not docs and len(by) <= 1.05 * -(-total // 2048) + 1


def best_fit(lengths, capacity):
    """The same method, one piece at a time."""
    large = sorted((n for n in lengths if 3 * n > capacity), reverse=True)
    gaps = []
    while large:
        n = large.pop(0)
        partner = next((m for m in large if n + m <= capacity), 0)
        if partner:
            large.remove(partner)
        gaps.append(capacity - n - partner)
    for n in sorted((n for n in lengths if 3 * n <= capacity), reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            gaps.remove(min(fit))
        gaps.append((min(fit) if fit else capacity) - n)
    return sorted(gaps)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60))
def test_plan_on_counts_equals_the_method_piece_by_piece(lengths):
    counts = defaultdict(int)
    for n in lengths:
        counts[n] += 1
    seen, used = set(), defaultdict(int)
    for length, first, rows, per, sequence, offset in packing.plan(counts, 30):
        for i in range(rows):
            assert (length, first + i) not in seen
            seen.add((length, first + i))
            used[sequence + i // per] += length
            assert offset + (i % per + 1) * length <= 30
    assert seen == {(n, i) for n, c in counts.items() for i in range(c)}
    assert sorted(30 - u for u in used.values()) == best_fit(lengths, 30)


def test_packing_edge_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "CHUNK_ROWS", 2)
    rows = [(1, None), (1, None), (2, ""), (None, "a b c"), (3, "word " * 300)] + [(9, "same text here")] * 9
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, length int")
    pieces = packing.token_pieces(df, BYTE, "byte", 0, 64, with_ids=True)
    placed = packing.pack(pieces, 64)
    got = placed.collect()
    check_packing(got, 64)
    assert len(got) == pieces.count() and sum(r.length == 1 for r in got) == 3
    joined = packing.sequences(placed).collect()
    assert sum(len(r.ids) for r in joined) == 4 * sum(r.length for r in got)
    assert all(len(r.ids) == 4 * sum(p.length for p in r.pieces) for r in joined)
    assert packing.pack(packing.token_pieces(df.limit(0), BYTE, "byte", 0, 64), 64).count() == 0


def test_packing_of_a_large_capacity_and_taken_names(spark):
    """Lengths beyond 13 bits find their places; a column that the result would hide is refused."""
    rnd = random.Random(3)
    sizes = [rnd.randint(1, 40_000) for _ in range(300)] + [20_000] * 40
    df = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(sizes)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    placed = packing.pack(df, 40_000).collect()
    ends = defaultdict(list)
    for r in placed:
        ends[r.sequence_id].append((r.offset, r.length))
    for parts in ends.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 40_000
    assert sorted(r.length for r in placed) == sorted(sizes)
    with pytest.raises(ValueError):
        packing.pack(df.withColumnRenamed("piece", "Offset"), 40_000)
