import hashlib
import re

import pytest

from quillspark.llm import decontamination as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, size=10):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        x = words(t)
        for win in [x[i : i + size] for i in range(max(1, len(x) - size + 1))] if x else []:
            for i in range(len(w) - len(win) + 1):
                if w[i : i + len(win)] == win:
                    hit |= set(range(i, i + len(win)))
                    found.add(str(item))
    names = ",".join(sorted(found))
    return len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block", [dc.BLOCK_BYTES, 2000])
def test_equals_brute_force(spark, block):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("n_chars < 3000")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    rows = dc.contamination(docs, items, block_bytes=block).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    pairs = [(r["item_id"], r["text"]) for r in items.collect()]
    assert len(rows) == len(texts) and any(r["contaminated"] for r in rows)
    for r in rows:
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == brute(texts[r["doc_id"]], pairs)


def test_short_odd_and_equal_items(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "alpha BETA"), (2, "alpha beta"), (3, None), (4, "--"), (None, "one"), (5, "漢字 x")], "item_id int, text string")
    got = {}
    for r in dc.contamination(odd_docs, items).collect():
        got.setdefault(r["doc_id"], r)
    assert (got[1]["n_hit"], got[1]["item_ids"]) == (2, ["1", "2"])
    assert got[7]["n_hit"] == 6000 and got[3]["n_words"] == 0 and not got[6]["contaminated"]
    assert dc.contamination(no_docs, items).count() == 0
    assert dc.contamination(odd_docs, items.limit(0)).filter("contaminated").count() == 0
