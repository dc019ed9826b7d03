"""Every registered query over tables with nulls, empty and long texts, ties, repeats and clashing columns, and over empty ones."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from quillspark.llm import packing, tokenfile
from quillspark.llm.queries import QUERIES

COLUMNS = {
    "op1_bloom_ngram": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op2_random_forest": "doc_id first last is_secret",
    "op3_virtual_slots": "doc_id size text_crc32 law shard slot grown_shard",
    "op4_pigeonhole_simhash": "doc_id fingerprint component_id",
    "op5_context_mixing": "doc_id start n_tokens ids_crc32",
    "op6_nn_pu": "doc_id held_out score predicted",
    "op7_nearest_centroid": "doc_id held_out lang_pred score",
    "op8_prefix_join": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op9_island_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op10_mpeg_audio": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature samples seconds frame_offsets",
    "op11_superminhash": "doc_id n_shingles component_id kept",
    "op12_welford_whitening": "vec_id component n deviation whitened explained identity_error",
    "op13_bit_planes": "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
}


@pytest.fixture(scope="module")
def tables(spark, odd_docs, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    extra = spark.createDataFrame(
        [(20 + i, t, "en", "src0", 1, 0.5, 1, 2, 3) for i, t in enumerate(["x <|endoftext|> y", "token = 04dbebab91ab85687d33eeaaf9ac699e1188f962", "the item has ten words and it goes on here now", " abc \x1c def"])],
        odd_docs.schema,
    )
    docs = odd_docs.unionByName(extra)
    labels = [(1, 1, 1), (2, 0, 0), (5, None, None), (None, 1, 1), (7, 0, 0), (99, 1, 1), (8, 1, 1)]
    items = [("b1", "The item has ten words and it goes on here now"), ("b2", None), ("b3", ""), ("b4", "one two"), ("b1", "one")]
    vectors = [(1, [0.5, 1.0], 0), (1, [0.5, 1.0], 0), (2, None, 0), (3, [None, 1.0], 0), (None, [2.0, 7.0], 1), (4, [float("nan"), 0.0], None), (5, [9.0, -3.0], 1)]
    out = {}
    for name, n in (("odd", None), ("empty", 0)):
        d = str(root / name)
        cut = lambda df, n=n: df if n is None else df.limit(n)
        cut(docs).write.parquet(f"{d}/documents.parquet")
        cut(spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).write.parquet(f"{d}/labels.parquet")
        cut(spark.createDataFrame(items, "item_id string, text string")).write.parquet(f"{d}/benchmark.parquet")
        cut(spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int")).write.parquet(f"{d}/embeddings.parquet")
        out[name] = d
    return out


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, tables, name):
    df = QUERIES[name](spark, tables["empty"])
    assert df.columns[: len(COLUMNS[name].split())] == COLUMNS[name].split() or set(COLUMNS[name].split()) <= set(df.columns)
    assert df.count() == 0


def _crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_tables(spark, tables, name):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{tables['odd']}/documents.parquet").collect()]
    df = QUERIES[name](spark, tables["odd"])
    assert set(COLUMNS[name].split()) <= set(df.columns)
    rows = df.collect()
    if name == "op12_welford_whitening":
        assert Counter((r["vec_id"], r["component"]) for r in rows) == Counter((v, c) for v in (1, 1, None, 5) for c in (1, 2))
        return
    if name not in ("op2_random_forest", "op9_island_packing"):
        assert Counter(r["doc_id"] for r in rows) == Counter(d for d, _ in docs)
    split = {"op1_bloom_ngram": (5, 1), "op6_nn_pu": (4, 2), "op7_nearest_centroid": (5, 0)}.get(name)
    if split:
        assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % split[0] == split[1]) for r in rows)
    if name == "op2_random_forest":
        texts = dict(docs)
        assert [texts[r["doc_id"]][r["first"] : r["last"]] for r in rows if r["is_secret"]] == ["04dbebab91ab85687d33eeaaf9ac699e1188f962"]
    if name == "op3_virtual_slots":
        want = Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in docs)
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want and {r["law"] for r in rows} == {"bytes"}
        for k in range(40):
            assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(sum(r["shard"] == k for r in rows)))
    if name == "op5_context_mixing":
        t = Tokenizer.from_file(tokenfile.byte_vocabulary())
        want = Counter((d, len(ids) + 1, _crc([*ids, 0])) for d, ids in ((d, t.encode(x or "", add_special_tokens=False).ids) for d, x in docs))
        assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == want
        at = 0
        for r in sorted(rows, key=lambda r: r["start"]):
            assert r["start"] == at
            at += r["n_tokens"]
        ids = [r["doc_id"] for r in sorted(rows, key=lambda r: r["start"])]
        assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))
    if name == "op7_nearest_centroid":
        letterless = {3, 4, 5}
        assert all((r["lang_pred"] == "und") == (r["doc_id"] in letterless) for r in rows)
    if name == "op8_prefix_join":
        got = {r["doc_id"]: r for r in rows}
        assert got[22]["n_hit"] == 11 and got[22]["contaminated"] and got[3]["n_words"] == 0
        assert got[22]["items_sha256"] == hashlib.sha256(b"b1").hexdigest()
        assert got[6]["contaminated"] and got[6]["n_words"] == 1  # an item of one word
    if name == "op11_superminhash":
        got = {r["doc_id"]: r for r in rows}
        assert got[2]["component_id"] == 1 and not got[2]["kept"] and got[1]["kept"] and got[3]["n_shingles"] == 0 and got[3]["component_id"] == 3
        assert got[7]["n_shingles"] == 20 and got[7]["component_id"] == 1  # 18 of the 20 are document 1's
        assert got[None]["component_id"] is None and got[6]["n_shingles"] == 1
    if name == "op13_bit_planes":
        assert {r["doc_id"] for r in rows if r["n_runs"] > 0} >= {7} and all((r["start"] is None) == (r["n_runs"] == 0) for r in rows)
    if name == "op9_island_packing":
        t = Tokenizer.from_file(packing.word_vocabulary())
        want = Counter()
        for d, x in docs:
            ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
            want.update((d, k, at, len(ids[at : at + 2048]), _crc(ids[at : at + 2048])) for k, at in enumerate(range(0, len(ids), 2048)))
        assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    if name == "op10_mpeg_audio":
        for r, (_, x) in zip(sorted(rows, key=lambda r: (r["n_bytes"], r["payload_sha256"])), sorted(docs, key=lambda p: (len((p[1] or "").encode()), hashlib.sha256(_padded(p[1])).hexdigest())), strict=True):
            p = _padded(x)
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len((x or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
            assert r["samples"] == 1152 * len(r["frame_offsets"]) and r["seconds"] == r["samples"] / 44100


def _padded(text):
    raw = (text or "").encode()
    return raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
