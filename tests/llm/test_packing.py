import zlib

import numpy as np
import pytest

from barloom.llm import packing
from barloom.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def encode():
    return packing.Encoder(tokenizer_path())


@pytest.mark.parametrize("text", ["", "it's We'll don't!'s", "naïve Straße ÀÉ ×÷ 12345 a1b2", "x\ty\n\nz", "日本 text", "a b  ", "<|endoftext|> !!", "ＡＢＣ é", "İΣ", "\x00 control", "'" * 50])
def test_encoder_equals_the_tokenizer(encode, text):
    assert encode(text) == encode.whole(text)


def test_encoder_forgets_and_stays_right():
    small = packing.Encoder(tokenizer_path())
    small.REMEMBER = 3
    for k in range(50):
        text = f"word{k} other words {k} and the rest"
        assert small(text) == small.whole(text)


def check_windows(windows, sizes, window):
    lengths = [sum(map(len, held)) for held in windows]
    assert all(0 < n <= window for n in lengths)
    assert all(n == window or n & (n - 1) == 0 for n in lengths)
    seen = {}
    for held in windows:
        for piece in held:
            assert len(piece) > 0
            seen.setdefault(piece.doc, []).append((piece.start, piece.ids))
    for doc, size in sizes.items():
        joined = b"".join(ids for _, ids in sorted(seen[doc]))
        assert len(joined) == 4 * size and joined == np.full(size, doc, "<u4").tobytes()


@pytest.mark.parametrize("max_open", [2, 8, 2048])
def test_every_token_is_placed_once_without_padding(max_open):
    rnd = np.random.default_rng(1)
    sizes = {k: int(n) for k, n in enumerate(rnd.integers(1, 200, 400))} | {1000: 64 * 3, 1001: 64, 1002: 63, 1003: 1}
    packer = packing.Packer(window=64, max_open=max_open)
    for doc, size in sizes.items():
        packer.add(packing.Piece(doc, 0, np.full(size, doc, "<u4").tobytes(), size))
    packer.close()
    check_windows(packer.finished(), sizes, 64)


def test_placement_minimises_the_sum_of_squares():
    rnd = np.random.default_rng(2)
    packer = packing.Packer(window=32)
    for size in rnd.integers(1, 33, 300).tolist():
        counts = packer.open_at.copy()

        def after(level, counts=counts, size=size):
            c = counts.copy()
            if level:
                c[level] -= 1
            if level + size < 32:
                c[level + size] += 1
            return int((c[:32] ** 2).sum())

        choices = [0] + [h for h in range(1, 33 - size) if counts[h]]
        assert after(packer.level(size)) == min(map(after, choices))
        packer.add(packing.Piece(0, 0, b"\0" * (4 * size), size))


def test_pack_table(spark, encode):
    long = "lorem ipsum dolor " * 9000
    rows = [(1, None, 9), (2, "", 9), (3, "hello world", 9), (4, long, 9), (3, "hello world", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(2)
    found = packing.pack(docs, tokenizer_path(), with_ids=True).collect()
    end = np.array([2], "<u4").tobytes()
    for r in found:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["length"] == len(r["ids"])
    by_doc = {}
    for r in found:
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert [(r["length"], r["doc_tokens"]) for r in by_doc[1] + by_doc[2]] == [(1, 1), (1, 1)]
    whole = np.frombuffer(encode.whole(long) + end, "<u4").tolist()
    pieces = sorted(by_doc[4], key=lambda r: r["start"])
    assert sum((r["ids"] for r in pieces), []) == whole and {r["doc_tokens"] for r in pieces} == {len(whole)}
    sequences = {}
    for r in found:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at == 4096 or at & (at - 1) == 0
    assert packing.pack(docs.limit(0), tokenizer_path()).count() == 0


def test_a_worker_forgets_the_tokenizer_when_another_operator_begins():
    from barloom.llm import common

    first = packing.encoder(tokenizer_path())
    list(common.thrifty(iter, "packing")([]))
    assert packing.encoder(tokenizer_path()) is first
    list(common.thrifty(iter)([]))
    assert not common._KEPT and packing.encoder(tokenizer_path()) is not first
