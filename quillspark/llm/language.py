"""Language ID by nearest centroids of TF-IDF character n-grams.

A text becomes a vector of hashed character n-grams (letters, case folded, with
word ends), weighted by 1 + log(tf) and IDF and normalised. Each language has
several centroids, clustered by spherical k-means from labelled texts. A text
takes the language of the centroid with the highest cosine. Texts further from
their centroid than a distance which nearly all training texts keep are
rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import held_out, lean, read_table

#: Hashed n-gram dimensions, n-gram sizes, and code points hashed at once.
DIM = 1 << 13
SIZES = (1, 2, 3)
CHUNK = 1 << 18
#: At most so many labelled texts of each language are fitted, chosen by hash of the text.
FIT_PER_LANGUAGE = 2000
CENTROIDS = 3
#: A text is rejected if its cosine is below this quantile of its language's training cosines, less the margin.
REJECT_QUANTILE = 0.002
REJECT_MARGIN = 0.25

_letters: dict[int, int] = {}


def _folded(codes: np.ndarray) -> np.ndarray:
    """Code points: letters in lower case, all others 32."""
    out = np.empty_like(codes)
    small = codes < 0x3000
    out[small] = _TABLE[codes[small]]
    for i in np.flatnonzero(~small):
        c = int(codes[i])
        if c not in _letters:
            if len(_letters) > 100_000:
                _letters.clear()
            ch = chr(c)
            _letters[c] = ord(ch.lower()[0]) if ch.isalpha() else 32
        out[i] = _letters[c]
    return out


_TABLE = np.array([ord(chr(c).lower()[0]) if chr(c).isalpha() else 32 for c in range(0x3000)], np.uint32)


def counts_of(text: str | None) -> np.ndarray | None:
    """Counts of hashed n-grams over the whole text; None if it has no letter.

    Long texts are hashed chunk by chunk with the overlap an n-gram needs.
    """
    if not text:
        return None
    codes = _folded(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32))
    if not (codes != 32).any():
        return None
    # runs of non-letters count as one
    codes = codes[np.concatenate(([True], (codes[1:] != 32) | (codes[:-1] != 32)))]
    total = np.zeros(DIM, np.int64)
    reach = max(SIZES) - 1
    for start in range(0, len(codes), CHUNK):
        part = np.concatenate(([np.uint32(32)] * (start == 0), codes[start : start + CHUNK + reach])).astype(np.uint32)
        first = len(part) - reach if start + CHUNK + reach < len(codes) else len(part)
        h = np.zeros(len(part), np.uint32)
        for n in range(1, max(SIZES) + 1):
            h = (h[: len(part) - n + 1] * np.uint32(0x9E3779B1)) ^ (part[n - 1 :] + np.uint32(n))
            if n in SIZES:
                mixed = h * np.uint32(0x85EBCA6B)
                mixed ^= mixed >> np.uint32(15)
                total += np.bincount((mixed & np.uint32(DIM - 1))[:first], minlength=DIM)
    return total


@dataclass
class LanguageModel:
    """centroids: one row each, unit length. limits: by language, the least cosine which is not rejected."""

    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    limits: np.ndarray

    def vector(self, counts: np.ndarray) -> np.ndarray:
        v = np.zeros(DIM, np.float32)
        at = np.flatnonzero(counts)
        v[at] = (1 + np.log(counts[at])) * self.idf[at]
        norm = np.linalg.norm(v)
        return v / norm if norm else v

    def predict(self, text: str | None) -> tuple[str, float, float, bool]:
        """Language, score (share of its cosine against the runner-up, 0 to 1), cosine, rejected."""
        if (counts := counts_of(text)) is None or not len(self.centroids):
            return "und", 0.0, 0.0, True
        cos = self.centroids @ self.vector(counts)
        best = np.full(len(self.languages), -1.0)
        np.maximum.at(best, self.owner, cos)
        k = int(best.argmax())
        e = np.exp((best - best[k]) * 20)
        return self.languages[k], float(1 / e.sum()), float(best[k]), bool(best[k] < self.limits[k])


class _Rows:
    """Sparse unit vectors; a dense table of them would be the driver's largest object."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]):
        self.at = [a for a, _ in rows]
        norms = [max(float(np.linalg.norm(v)), 1e-9) for _, v in rows]
        self.values = [(v / n).astype(np.float32) for (_, v), n in zip(rows, norms, strict=True)]

    def dots(self, c: np.ndarray) -> np.ndarray:
        """Products with each row of ``c``."""
        return np.stack([c[:, at] @ v for at, v in zip(self.at, self.values, strict=True)])

    def mean(self, which: np.ndarray) -> np.ndarray:
        total = np.zeros(DIM, np.float32)
        for k in which:
            total[self.at[k]] += self.values[k]
        return total / len(which)

    def dense(self, k: int) -> np.ndarray:
        out = np.zeros(DIM, np.float32)
        out[self.at[k]] = self.values[k]
        return out


def _spherical_kmeans(x: _Rows, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids; starts from farthest points, so equal input gives equal output."""
    n = len(x.at)
    k = min(k, n)
    start = [int(x.dots(x.mean(np.arange(n))[None])[:, 0].argmax())]
    while len(start) < k:
        start.append(int(x.dots(np.stack([x.dense(s) for s in start])).max(1).argmin()))
    c = np.stack([x.dense(s) for s in start])
    for _ in range(rounds):
        near = x.dots(c).argmax(1)
        c = np.stack([x.mean(np.flatnonzero(near == j)) if (near == j).any() else c[j] for j in range(k)])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


def fit(
    labelled: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = FIT_PER_LANGUAGE,
    centroids: int = CENTROIDS,
) -> LanguageModel:
    """Fit on at most ``per_language`` labelled texts of each language.

    The sample is bounded and documented: texts in order of their hash, equal
    texts once, so it does not depend on the partitioning. Null languages and
    texts without letters teach nothing; with no labelled text the model
    answers ``und``. Only sparse counts of the sample reach the driver.
    """
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter("lang is not null and text is not null")
    from pyspark.sql import Window

    # a hash threshold from the counts first, so that the window sees few more rows than it keeps
    n = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    keep = F.lit(False)
    for lang, count in n.items():
        share = min(1.0, 3 * per_language / count)
        keep = keep | ((F.col("lang") == lang) & (F.pmod("h", F.lit(1 << 20)) < int(share * (1 << 20)) + 1))
    sample = (
        rows.withColumn("h", F.xxhash64("text"))
        .filter(keep)
        .groupBy("lang", "h")
        .agg(F.first("text").alias("text"))
        .withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
        .filter(F.col("k") <= per_language)
    )

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, at, tf, hs = [], [], [], []
            for lang, text, h in zip(b.column("lang").to_pylist(), b.column("text"), b.column("h").to_pylist(), strict=True):
                if (c := counts_of(text.as_py())) is not None:
                    i = np.flatnonzero(c)
                    langs.append(lang)
                    hs.append(h)
                    at.append(i.astype(np.uint16).tobytes())
                    tf.append(c[i].astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": pa.array(langs, pa.string()),
                    "h": pa.array(hs, pa.int64()),
                    "at": pa.array(at, pa.binary()),
                    "tf": pa.array(tf, pa.binary()),
                }
            )

    got = sample.select("lang", "text", "h").mapInArrow(lean(sparse), "lang string, h long, at binary, tf binary").collect()
    got.sort(key=lambda r: (r["lang"], r["h"]))
    return _fitted(got, centroids)


def _fitted(got: list, k: int) -> LanguageModel:
    df = np.zeros(DIM)
    pairs = [(np.frombuffer(r["at"], np.uint16), np.frombuffer(r["tf"], np.uint32)) for r in got]
    for at, _ in pairs:
        df[at] += 1
    idf = (np.log((1 + len(pairs)) / (1 + df)) + 1).astype(np.float32)
    languages = sorted({r["lang"] for r in got})
    model = LanguageModel(languages, idf, np.zeros((0, DIM), np.float32), np.zeros(0, np.int64), np.zeros(len(languages)))
    cents, owner = [], []
    for j, lang in enumerate(languages):
        x = _Rows([(at, (1 + np.log(tf)) * idf[at]) for r, (at, tf) in zip(got, pairs, strict=True) if r["lang"] == lang])
        c = _spherical_kmeans(x, k)
        model.limits[j] = float(np.quantile(x.dots(c).max(1), REJECT_QUANTILE)) - REJECT_MARGIN
        cents.append(c)
        owner += [j] * len(c)
    if cents:
        model.centroids, model.owner = np.concatenate(cents).astype(np.float32), np.array(owner)
    return model


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """doc_id, lang_pred, score, cosine and rejected for every row, or the columns ``keep`` in place of doc_id.

    A null, empty or letterless text is ``und`` with score 0 and rejected. A
    repeated row gives a row each. The model (a few MB, whatever the input) is
    broadcast; nothing is shuffled. Equal cosines go to the language first in
    alphabetical order.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*keep) if keep else docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"))
    source = text_col if keep else "__text"

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [known.value.predict(x.as_py()) for x in b.column(source)]
            cols = {f.name: b.column(f.name) for f in b.schema if f.name != "__text"}
            for i, (name, kind) in enumerate((("lang_pred", pa.string()), ("score", pa.float64()), ("cosine", pa.float64()), ("rejected", pa.bool_()))):
                cols[name] = pa.array([o[i] for o in out], kind)
            yield pa.RecordBatch.from_pydict(cols)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "__text")
    return kept.mapInArrow(lean(label), f"{fields}, lang_pred string, score double, cosine double, rejected boolean")


def op7_nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learnt from those which are not held out."""
    docs = read_table(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out("doc_id", 5, 0)))
    out = identify(docs, model)
    return out.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "lang_pred", "score", "cosine", "rejected")
