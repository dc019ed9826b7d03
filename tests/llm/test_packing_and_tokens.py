import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillspark.llm import idcoder, packing, tokenfile, tokens
from quillspark.llm.tokens import ChunkTokenizer

ODD = ["a  b\n\nc\t d   e", "  ", "\n", "I'm don't    q", "<|endoftext|> hi", "é́ Σας ΟΔΟΣ", "x\x1cy\x85z 　 w", "İ ﬀ Å", "", None, "a" * 5000]


@pytest.mark.parametrize(("name", "blanks"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_ids_are_those_of_the_whole_text(sample, name, blanks):
    path = public_tokenizers.path(name)
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    texts = ODD + [r["text"] for r in sample.limit(60).collect()]
    want = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    got = ChunkTokenizer(path, blanks).ids_of(texts)
    assert [g.tolist() for g in got] == want


@pytest.mark.parametrize(("name", "blanks"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_ids_of_random_texts_in_a_small_cache(name, blanks, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 300)
    monkeypatch.setattr(tokens, "JOINED", 7)
    r = random.Random(3)
    parts = [*"abTSsdlmrve'  \n\t.,-_<|>/0129éÈñßİΣς中÷ªº²×ÿ", "’", "\x1c", "\x85", "\xa0", "\u0301", "\u200d", "<|endoftext|>", "</w>", "'s", "'LL", " 's", "Ġ", " don't"]
    chunk = ChunkTokenizer(public_tokenizers.path(name), blanks)
    for _ in range(20):
        texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 50))) for _ in range(100)]
        want = [chunk.tokenizer.encode(x, add_special_tokens=False).ids for x in texts]
        assert [g.tolist() for g in chunk.ids_of(texts)] == want


@pytest.mark.parametrize("seed", range(5))
def test_evolution_keeps_every_piece(seed):
    r = random.Random(seed)
    sizes = sorted((r.randint(300, 1100) for _ in range(120)), reverse=True)
    start = packing.best_fit(sizes, list(range(120)), 2048)
    bound = packing.lower_bound(sizes, 2048)
    bins = packing.evolve(sizes, [start], 2048, bound, seed, 20, 6)
    assert sorted(i for b in bins for i in b) == list(range(120))
    assert all(sum(sizes[i] for i in b) <= 2048 for b in bins)
    assert bound <= len(bins) <= len(start)


def test_evolution_saves_sequences():
    """Pieces which fill sequences by threes: best fit leaves gaps which crossover closes."""
    saved = 0
    for seed in range(6):
        rng = random.Random(seed)
        sizes = []
        while len(sizes) < 180:
            a, b = rng.randrange(500, 850), rng.randrange(500, 850)
            sizes += [a, b, 2048 - a - b] if 2048 - a - b >= 500 else []
        order = sorted(range(180), key=lambda i: -sizes[i])
        first = packing.best_fit(sizes, order, 2048)
        made = packing.evolve(sizes, [first], 2048, 60, seed, 300, 12)
        assert sorted(i for b in made for i in b) == list(range(180)) and all(sum(sizes[i] for i in b) <= 2048 for b in made)
        assert 60 <= len(made) <= len(first)
        saved += len(first) - len(made)
    assert saved >= 12  # of 66 or so a set


def test_lower_bound_is_one():
    r = random.Random(1)
    for _ in range(200):
        bins = [[r.randint(1, 60) for _ in range(r.randint(1, 3))] for _ in range(r.randint(1, 6))]
        sizes = [s for b in bins for s in b]
        need = sum(1 for _ in packing.best_fit(sizes, sorted(range(len(sizes)), key=lambda i: -sizes[i]), 180))
        assert packing.lower_bound(sizes, 180) <= need


def test_packing_covers_every_document(sample, odd_docs, no_docs, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 50)
    for docs in (sample, odd_docs):
        rows = packing.pack_documents(docs, packing.word_vocabulary()).collect()
        held = {}
        for r in rows:
            held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for parts in held.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 2048
        assert len({r["doc_id"] for r in rows}) == docs.select("doc_id").distinct().count()
        total = sum(r["length"] for r in rows)
        assert len(held) <= -(-total // 2048) * 1.02 + 2
    assert packing.pack_documents(no_docs, packing.word_vocabulary()).count() == 0


@pytest.mark.parametrize("n", [0, 1, 4095, 4096, 4097, 13000, 70000])
def test_segments_round_trip(n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.4, n) % 65536).astype(np.uint16) if n < 70000 else rng.permutation(n).astype(np.uint16)
    data = tokenfile.write_segment([5, None], [n - n // 2, n // 2], ids, 3, True, False)
    docs, lengths, got, first, begun, goes_on = tokenfile.read_segment(data)
    assert docs == [5, None] and lengths.tolist() == [n - n // 2, n // 2] and (got == ids).all()
    assert (first, begun, goes_on) == (3, True, False)


def test_each_block_is_coded_by_itself():
    rng = np.random.default_rng(5)
    ids = (rng.zipf(1.3, 5 * idcoder.BLOCK) % 900).astype(np.uint16)
    packed, codes = idcoder.encode(ids)
    alphabet, _ = idcoder.Alphabet.from_bytes(packed, 0)
    for k, code in enumerate(codes):
        part = ids[k * idcoder.BLOCK : (k + 1) * idcoder.BLOCK]
        assert (idcoder.decode(alphabet, [code], len(part)) == part).all()


def test_repetition_compresses_and_damage_is_found():
    ids = np.tile(np.arange(50, dtype=np.uint16) * 997, 400)
    data = tokenfile.write_segment([1], [len(ids)], ids)
    assert len(data) < len(ids) / 8
    with pytest.raises(ValueError, match="damaged"):
        tokenfile.read_segment(data[:-40] + bytes([data[-40] ^ 255]) + data[-39:])
    with pytest.raises(ValueError, match="segment"):
        tokenfile.read_segment(b"other" + data)


def test_mixing_beats_order_0_and_zlib(sample):
    t = tokens.tokenizer(tokenfile.byte_vocabulary(), True)
    ids = np.concatenate(t.ids_of([r["text"] for r in sample.collect()]))[:245_760]
    n = np.bincount(ids)
    n = n[n > 0]
    order0 = -(n * np.log2(n / len(ids))).sum() / 8  # without any table
    size = len(tokenfile.write_segment([1], [len(ids)], ids))
    assert size < 0.95 * order0 and size < 0.95 * len(zlib.compress(ids.astype("<u2").tobytes(), 9))


@pytest.mark.parametrize("length", [0, 1, 7, 100, 70000])
def test_joined_checksums(length):
    r = random.Random(length)
    a, b = r.randbytes(33), r.randbytes(length)
    assert tokenfile.crc32_joined(zlib.crc32(a), zlib.crc32(b), length) == zlib.crc32(a + b)
    assert tokenfile.crc32_joined(0, zlib.crc32(b), length) == zlib.crc32(b)


@pytest.mark.parametrize(("name", "blanks"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_long_texts_in_parts_have_the_same_ids(name, blanks, sample, monkeypatch):
    monkeypatch.setattr(tokens, "PART", 60)
    path = public_tokenizers.path(name)
    t = Tokenizer.from_file(path)
    texts = [*ODD, "a b<|endoftext|>c d " * 40, "x" * 500, *(r["text"] for r in sample.limit(30).collect())]
    assert all("".join(tokens.parts(x or "", 60)) == (x or "") for x in texts)
    want = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    assert [g.tolist() for g in ChunkTokenizer(path, blanks, added=True).ids_of(texts)] == want


def test_documents_longer_than_segments(spark, sample, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfile, "LANES", 1)
    t = Tokenizer.from_file(tokenfile.byte_vocabulary())
    texts = ["one two", " ".join(r["text"] for r in sample.limit(40).collect()), None, "three", "four five " * 9000, ""]
    docs = spark.createDataFrame([(9, t) if i == 3 else (i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    tokenfile.write_tokens(docs, str(tmp_path / "a"), tokenfile.byte_vocabulary())
    assert spark.read.parquet(str(tmp_path / "a")).agg({"ids": "max"}).first()[0] == 4096
    got = sorted(map(tuple, tokenfile.read_tokens(spark, str(tmp_path / "a")).select("doc_id", "start", "n_tokens", "ids_crc32").collect()))
    at, want = 0, []
    for i, x in sorted((9 if i == 3 else i, x) for i, x in enumerate(texts)):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want


def test_token_files(spark, sample, odd_docs, no_docs, tmp_path):
    t = Tokenizer.from_file(tokenfile.byte_vocabulary())
    docs = sample.limit(40)
    tokenfile.write_tokens(docs, str(tmp_path / "a"), tokenfile.byte_vocabulary())
    got = sorted(tokenfile.read_tokens(spark, str(tmp_path / "a")).collect(), key=lambda r: r["doc_id"])
    at = 0
    for r, d in zip(got, sorted(docs.collect(), key=lambda r: r["doc_id"]), strict=True):
        ids = np.array([*t.encode(d["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (d["doc_id"], at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    tokenfile.write_tokens(odd_docs, str(tmp_path / "b"), tokenfile.byte_vocabulary())
    assert tokenfile.read_tokens(spark, str(tmp_path / "b")).count() == odd_docs.count()
    tokenfile.write_tokens(no_docs, str(tmp_path / "c"), tokenfile.byte_vocabulary())
    assert tokenfile.read_tokens(spark, str(tmp_path / "c")).count() == 0


@pytest.mark.parametrize(("name", "blanks"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_queries_encode_as_the_unmodified_library(name, blanks):
    path = public_tokenizers.path(name)
    t = Tokenizer.from_file(path)
    r = random.Random(8)
    parts = [*"abT \n.<|>1é\u0338", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|endoftext|", " don't"]
    texts = [*ODD, "<|endoftext|>", *("".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(300))]
    want = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    assert [g.tolist() for g in tokens.tokenizer(path, blanks).ids_of(texts)] == want


def test_order_0_has_a_part_for_every_id():
    rng = np.random.default_rng(4)
    for ids in (np.zeros(5, np.uint16), np.append(np.zeros(1 << 18, np.uint16), np.arange(1 << 16).astype(np.uint16)), (rng.zipf(1.2, 90_000) % 50_000).astype(np.uint16)):
        packed, codes = idcoder.encode(ids)
        alphabet, _ = idcoder.Alphabet.from_bytes(packed, 0)
        assert alphabet.share.min() >= 1 and alphabet.share.sum() <= 1 << idcoder.SHARES
        assert (idcoder.decode(alphabet, codes, len(ids)) == ids).all()


def test_pieces_of_a_byte_level_generation_are_encoded_once(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 300)
    chunk = ChunkTokenizer(public_tokenizers.path("byte_bpe_50k.json"), True)
    encoded = []
    encode = chunk._encode_joined
    monkeypatch.setattr(chunk, "_encode_joined", lambda group: encoded.extend(group) or encode(group))
    texts = ["".join(f" {chr(97 + a)}{chr(97 + b)}qz{chr(97 + c)}" for b in range(10) for c in range(10)) for a in range(6)]
    want = [chunk.ids_of([t])[0].tolist() for t in texts]
    assert [chunk.ids_of([t])[0].tolist() for t in texts] == want
    assert len(encoded) == len(set(encoded)) == 600


@pytest.mark.parametrize(("name", "blanks"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_plain_texts_are_cut_together_as_the_patterns_cut_them(name, blanks, monkeypatch):
    r = random.Random(8)
    signs = [*"abTSsdlmrve'  \n\t.,-<>/0129éÈñß×÷", "'s", "'ll", "'re ", " 's", "''", " don't", "\r\n", "'"]
    texts = ["".join(r.choice(signs) for _ in range(r.randint(1, 40))) for _ in range(3000)]
    texts = [t for t in texts if tokens._PLAIN(t)]
    chunk = ChunkTokenizer(public_tokenizers.path(name), blanks)
    asked = []
    look = chunk._ids_of_pieces
    monkeypatch.setattr(chunk, "_ids_of_pieces", lambda pieces: asked.append(pieces) or look(pieces))
    got = chunk.ids_of(texts)
    want = {p for t in texts for p in chunk.pieces(t)}
    assert len(asked) == 1 and set(asked[0]) == want  # each distinct piece is looked up, not each piece
    assert [g.tolist() for g in got] == [e.ids for e in chunk.tokenizer.encode_batch(texts, add_special_tokens=False)]
