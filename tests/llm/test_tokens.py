import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.conftest import SMALL
from tests.llm.cases import DOCS, docs_frame, values
from tideline.llm import packing, wavelet, word_bpe
from tideline.llm.byte_bpe import CachedEncoder
from tideline.llm.common import table
from tideline.session import scratch_dir

BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ODD = "abcdefgh éÉßΣσ\n\t'stremvd0123½²世界́  İ!?#-_.,<|endoftext|>\x1c\x85​  "


@pytest.fixture(scope="module")
def byte_tokenizer():
    return Tokenizer.from_file(BYTES)


@pytest.fixture(scope="module")
def word_tokenizer():
    return Tokenizer.from_file(WORDS)


def odd_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 60))) + rng.choice(["", "<|endoftext|> A", " ", "  \n b"]) for _ in range(n)]


def test_cached_ids_are_the_librarys(spark, byte_tokenizer):
    texts = odd_texts(4000, 1) + [t or "" for _, t in DOCS] + [r.text for r in table(spark, SMALL, "documents").collect()]
    encoder = CachedEncoder(BYTES, limit=500)
    for _ in range(2):
        for text, ids in zip(texts, encoder.encode(texts, together=20_000), strict=True):
            assert ids.tolist() == byte_tokenizer.encode(text, add_special_tokens=False).ids, repr(text[:80])


class Counting:
    """A tokenizer that counts the characters given to the whole of it."""

    def __init__(self, tokenizer):
        self.tokenizer, self.seen = tokenizer, 0

    def encode_batch_fast(self, texts, **options):
        self.seen += sum(map(len, texts))
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_plain_words_pass_by_the_pre_tokenizer(byte_tokenizer):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghinorstzABCéÉßñüǅ") for _ in range(rng.randint(1, 12)))
    texts = [" ".join(word() + rng.choice(["", "", ".", ",", "###", "12", ".\n" + word(), "!?\n7" + word()]) for _ in range(50)) for _ in range(200)]
    encoder = CachedEncoder(BYTES, limit=2000)
    encoder.tokenizer = Counting(byte_tokenizer)
    for text, ids in zip(texts, encoder.encode(texts, together=20_000), strict=True):
        assert ids.tolist() == byte_tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
    assert encoder.tokenizer.seen == sum(len(t.split(" ")[0]) for t in texts)


def test_pieces_at_the_edge_of_plain(byte_tokenizer):
    odd = ["it's", "'re", "<|endoftext|>", "a<|endoftext|>b", "<|", "|>", "a\n\nb", "a\n", "a\n'll", "½a", "a½", "ª", "a­b", "aªb", "÷×", "a_b", "\\]^-[", "a\tb", "é\r\nb", "x" * 300, "x" * 300 + ".\nb"]
    texts = [f"{a} {b} {a}{b} c" for a in odd for b in odd] + ["", " ", "a", " a", "a ", "\n", "\n a"]
    for plain in (True, False):
        encoder = CachedEncoder(BYTES, limit=50)
        encoder.plain = encoder.plain if plain else None
        for _ in range(2):
            for text, ids in zip(texts, encoder.encode(texts, together=500), strict=True):
                assert ids.tolist() == byte_tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
        assert all(len(p) <= encoder.longest for p in [*encoder.cache, *encoder.old])
    assert list(encoder.encode([])) == []


def test_backtracking_is_exact(spark, word_tokenizer):
    bpe = word_bpe.WordBpe(WORDS, limit=300)
    rng = random.Random(2)
    texts = odd_texts(4000, 3) + [t or "" for _, t in DOCS] + [r.text for r in table(spark, SMALL, "documents").collect()]
    texts += ["".join(rng.choice("aeionrstlh") for _ in range(rng.randint(1, 30))) for _ in range(4000)]
    texts += [x * n for x in ("a", "ha", "aab", "é", "世", "0") for n in range(1, 50)]
    for text in texts:
        want = word_tokenizer.encode(text, add_special_tokens=False).ids
        got = bpe.encode(text)
        assert got.tolist() == want, repr(text[:80])
        assert bpe.decode(got).decode() == word_tokenizer.decode(want, skip_special_tokens=False)


def test_word_bpe_rows(spark, word_tokenizer):
    got = values(word_bpe.encode_decode(docs_frame(spark), WORDS, keep=True), "doc_id", "n_tokens", "ids", "decoded")
    want = []
    for doc_id, text in DOCS:
        ids = word_tokenizer.encode(text or "", add_special_tokens=False).ids
        want.append((doc_id, len(ids), ids, word_tokenizer.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want, key=repr)
    assert word_bpe.encode_decode(docs_frame(spark, []), WORDS).count() == 0


def pieces_of(ids, size):
    first = len(ids) % size or size if len(ids) > size else len(ids)
    at = [0, *range(first, len(ids), size)]
    return [(a, ids[a:b]) for a, b in zip(at, [*at[1:], len(ids)])]


def check_packed(rows, size):
    by = {}
    for row in rows:
        by.setdefault(row["sequence_id"], []).append((row["offset"], row["length"]))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= size
    return len(by)


def test_packed_documents(spark, byte_tokenizer):
    rows = packing.pack_documents(docs_frame(spark), BYTES, size=64, keep_ids=True).collect()
    want = []
    for doc_id, text in DOCS:
        ids = byte_tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        want += [(doc_id, i, a, len(p), p) for i, (a, p) in enumerate(pieces_of(ids, 64))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids) for r in rows), key=repr) == sorted(want, key=repr)
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) for r in rows)
    check_packed(rows, 64)


@pytest.mark.parametrize("cell_rows", [1000, 3])
def test_packing_is_tight(spark, cell_rows):
    rng = random.Random(4)
    lengths = [rng.choice([7, rng.randint(1, 99), rng.randint(1, 100)]) for _ in range(3000)]
    frame = spark.createDataFrame([(i, n, "mine") for i, n in enumerate(lengths)], "own long, length long, offset string")
    rows = packing.pack(frame, 100, cell_rows).collect()
    assert sorted((r.own, r.length) for r in rows) == list(enumerate(lengths))
    assert check_packed(rows, 100) <= 1.01 * sum(lengths) / 100 + 1


def test_fullest_combination_matches_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(1, 5))}
        chosen = packing.fullest(counts, 30)
        assert all(counts[x] >= n for x, n in chosen.items()) and max(counts) in chosen
        sums = {max(counts)}
        for x, n in counts.items():
            for _ in range(n - (x == max(counts))):
                sums |= {s + x for s in sums}
        assert sum(x * n for x, n in chosen.items()) == max(s for s in sums if s <= 30)


def test_packing_edges(spark):
    frame = spark.createDataFrame([(None,), (64,), (64,), (1,)], "length long")
    rows = packing.pack(frame, 64).collect()
    assert sorted(r.length for r in rows) == [1, 64, 64] and check_packed(rows, 64) == 3
    assert packing.pack(frame.limit(0), 64).count() == 0
    assert packing.pack_documents(docs_frame(spark, []), BYTES).count() == 0
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(65,)], "length long"), 64)


@pytest.mark.parametrize("size", [64, 2048, 4096, 100_000])
def test_packing_has_no_holes_at_any_size(spark, size):
    rng = random.Random(size)
    lengths = [rng.choice([size // 3, size, rng.randint(1, size)]) for _ in range(400)]
    rows = packing.pack(spark.createDataFrame([(n,) for n in lengths], "length long"), size, 50).collect()
    assert sorted(r.length for r in rows) == sorted(lengths)
    check_packed(rows, size)


def test_ids_beyond_the_bits_are_refused():
    with pytest.raises(ValueError):
        wavelet.WaveletMatrix.of(np.array([1, 70_000], dtype=np.uint32), 16)
    assert wavelet.WaveletMatrix.of(np.array([1, 70_000], dtype=np.uint32), 17).ids().tolist() == [1, 70_000]


def test_select_reads_single_blocks():
    ids = np.random.default_rng(3).integers(0, 4, 100_000, dtype=np.uint32)
    matrix = wavelet.Shard.load(wavelet.Shard(wavelet.WaveletMatrix.of(ids, 17), [1], np.array([len(ids)]), 0).dump()).matrix
    assert not matrix.planes.opened
    for token in range(5):
        want = np.flatnonzero(ids == token)
        for nth in {0, 1, len(want) // 2, len(want) - 1} & set(range(len(want))):
            assert matrix.select(token, nth) == want[nth]
        assert matrix.find(token).tolist() == want.tolist()
        for nth in (-1, len(want)):
            with pytest.raises(IndexError):
                matrix.select(token, nth)


@pytest.mark.parametrize("n", [0, 1, 7, 512, 513, 5000])
def test_wavelet_matrix(n):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, 40, n, dtype=np.uint32) * 1003
    image = wavelet.Shard(wavelet.WaveletMatrix.of(ids, 16), [1, None], np.array([n, 0]), 5).dump()
    shard = wavelet.Shard.load(image)
    assert shard.doc_ids == [1, None] and shard.lengths.tolist() == [n, 0] and shard.start == 5
    matrix = shard.matrix
    assert matrix.ids().tolist() == ids.tolist()
    for at in {0, 1, n // 2, n - 1} & set(range(n)):
        assert matrix.access(at) == ids[at]
        assert matrix.rank(int(ids[at]), at) == (ids[:at] == ids[at]).sum()
        assert matrix.find(int(ids[at])).tolist() == np.flatnonzero(ids == ids[at]).tolist()
        assert matrix.select(int(ids[at]), matrix.rank(int(ids[at]), at)) == at
    assert matrix.rank(40_001, n) == 0 and len(matrix.find(1 << 20)) == 0
    with pytest.raises(IndexError):
        matrix.access(n)


def test_shards_read_back(spark, byte_tokenizer):
    path = scratch_dir(spark, "shards")
    wavelet.write_shards(docs_frame(spark), path, BYTES, shard_tokens=50)
    files = wavelet.read_shards(spark, path)
    rows = wavelet.documents_of(files, keep_ids=True).orderBy("start").collect()
    assert [(r.doc_id is not None, r.doc_id or 0) for r in rows] == sorted((d is not None, d or 0) for d, _ in DOCS)
    start, whole = 0, []
    for r in rows:
        assert (r.start, r.n_tokens) == (start, len(r.ids)) and r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
        start += len(r.ids)
        whole += r.ids
    want = [byte_tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for _, t in DOCS]
    assert sorted(r.ids for r in rows) == sorted(want)
    token = whole[3]
    assert sorted(r.place for r in wavelet.find_token(files, token).collect()) == [i for i, x in enumerate(whole) if x == token]
    assert wavelet.count_token(files, token).groupBy().sum("n").first()[0] == whole.count(token)


def test_no_shards(spark):
    path = scratch_dir(spark, "shards")
    wavelet.write_shards(docs_frame(spark, []), path, BYTES)
    assert wavelet.documents_of(wavelet.read_shards(spark, path)).count() == 0
