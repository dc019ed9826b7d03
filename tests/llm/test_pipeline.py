"""Each stage against a plain version of what it must keep, on the smallest tables."""

import re

import corpus_pipeline
from quillspark.llm import common, language, packing, pipeline, simhash, tokens

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark, sample):
    docs = sample
    one = pipeline.keep_identified(spark, docs, SF)
    model = language.fit(docs)
    want = {r["doc_id"] for r in docs.collect() if not model.predict(r["text"])[3]}
    assert {r["doc_id"] for r in one.collect()} == want and one.columns == docs.columns

    two = pipeline.drop_near_copies(spark, one, SF)
    rows = {r["doc_id"]: simhash.copy_fingerprint(r["text"]) for r in one.collect()}
    label = {d: d for d in rows}
    find = lambda d: d if label[d] == d else find(label[d])
    bits = lambda x, y: sum((p ^ q).bit_count() for p, q in zip(x, y, strict=True))
    for a in rows:
        for b in rows:
            if a < b and (rows[a][0] ^ rows[b][0]).bit_count() <= simhash.WORD_DISTANCE and bits(rows[a][1], rows[b][1]) <= simhash.WIDE_DISTANCE:
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    assert {r["doc_id"] for r in two.collect()} == {find(d) for d in rows}

    three = pipeline.decontaminate(spark, two, SF)
    word = lambda t: " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = word(r["text"]).split(" ")
        windows |= {f" {' '.join(w[i : i + 10])} " for i in range(max(1, len(w) - 9))}
    clean = {r["doc_id"] for r in two.collect() if not any(x in f" {word(r['text'])} " for x in windows)}
    assert {r["doc_id"] for r in three.collect()} == clean

    four = pipeline.mask_secrets(spark, three, SF)
    texts = {r["doc_id"]: r for r in four.collect()}
    for r in three.collect():
        plain = re.sub(r'(?i)(token = ")[0-9a-f]{40}(")', r"\1[SECRET]\2", r["text"])
        assert texts[r["doc_id"]]["text"] == plain and texts[r["doc_id"]]["n_chars"] == len(plain)

    five = pipeline.pack(spark, four, SF)
    assert {r["doc_id"] for r in five.collect()} == set(texts)


def test_run_and_stage_names(spark):
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "language ID" and len(corpus_pipeline.STAGES) == 5
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_odd_rows(spark, odd_docs, no_docs):
    docs = odd_docs.select(pipeline.COLUMNS)
    kept = [r["doc_id"] for r in pipeline.drop_near_copies(spark, docs, SF).collect()]
    # the words once and three thousand times have the same distinct shingles but for those over the seam
    assert kept.count(3) == 1 and 4 not in kept and 5 not in kept and None in kept and kept.count(2) == 0
    for stage in (pipeline.drop_near_copies, pipeline.decontaminate, pipeline.mask_secrets, pipeline.pack):
        assert stage(spark, no_docs.select(pipeline.COLUMNS), SF).count() == 0


def test_contaminated_rows_without_an_id_go(spark):
    leak = spark.read.parquet(f"{SF}/benchmark.parquet").filter("text is not null").first()["text"]
    rows = [(None, leak), (None, "one two"), (1, f"before {leak} after"), (1, "three"), (None, None)]
    docs = spark.createDataFrame([(d, t, "en", "src0", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = pipeline.decontaminate(spark, docs, SF).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in got) == [(0, ""), (0, "one two"), (1, "three")]


def test_a_stage_drops_what_another_has_kept():
    """A worker goes from packing to the next run's language ID: pieces and vocabulary would stay beside that stage's own memory."""
    tokens.tokenizer(packing.word_vocabulary(), False).ids_of(["a few words"])
    assert list(common.lean(iter, "tokens")([])) == [] and tokens._open
    assert list(common.lean(iter)([])) == [] and not tokens._open
