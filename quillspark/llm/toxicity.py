"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; texts of unknown class are the
unlabelled sample. A linear numpy classifier is trained by mini-batches on the
non-negative risk of Kiryo et al. (2017): with class prior p, the risk on
unlabelled texts as negatives, less p times that risk on positives, estimates
the negatives' risk; where a batch makes it negative, the step goes the other
way. The prior is the share of toxic texts among labelled training rows, or is
given.

Features: each word and its prefixes of 4 to 9 characters, hashed; squared
log(1 + count), over the norm of the whole text's features.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import held_out, read_table

DIM = 1 << 18
PREFIXES = range(4, 10)
#: The classifier is fitted on at most so many positive and unlabelled texts, in order of their hash.
FIT_POSITIVE, FIT_UNLABELLED = 2000, 4000
#: A feature is used if so many sampled texts, and so many positives, have it.
LEAST_TEXTS, LEAST_POSITIVES = 10, 5
THRESHOLD = 0.3
#: Words whose feature ids a worker remembers.
CACHE = 400_000

_TABLE = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
_known: dict[bytes, np.ndarray] = {}


def _ids(word: bytes) -> np.ndarray:
    if (got := _known.get(word)) is None:
        if len(_known) >= CACHE:
            _known.clear()
        marked = "<" + word.decode("utf-8", "replace") + ">"
        parts = [word, *(marked[:n].encode("utf-8", "replace") for n in PREFIXES if n < len(marked))]
        got = _known[word] = np.array([xxhash.xxh32_intdigest(x) % DIM for x in parts], np.int64)
    return got


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids and unit-norm values of the whole text; none for a text without letters."""
    counts = Counter((text or "").lower().encode("utf-8", "surrogatepass").translate(_TABLE).split())
    if not counts:
        return np.zeros(0, np.int64), np.zeros(0)
    each = [_ids(w) for w in counts]
    ids = np.concatenate(each)
    n = np.repeat(np.fromiter(counts.values(), np.float64, len(counts)), [len(e) for e in each])
    order = ids.argsort(kind="stable")
    ids = ids[order]
    first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
    v = np.log1p(np.add.reduceat(n[order], first)) ** 2
    return ids[first], v / np.linalg.norm(v)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class ToxicityModel:
    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        ids, v = features(text)
        return float(_sigmoid(self.weights[ids] @ v + self.bias))


class _Rows:
    """Texts as flat arrays, so that a batch is two gathers."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]):
        self.ends = np.concatenate(([0], np.cumsum([len(i) for i, _ in rows]))).astype(np.int64)
        self.ids = np.concatenate([i for i, _ in rows]) if rows else np.zeros(0, np.uint32)
        self.values = np.concatenate([v for _, v in rows]) if rows else np.zeros(0)

    def __len__(self) -> int:
        return len(self.ends) - 1

    def batch(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = self.ends[at + 1] - self.ends[at]
        row = np.repeat(np.arange(len(at)), size)
        flat = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.ends[at], size)
        return self.ids[flat], row, self.values[flat]


def train(
    positive: list[tuple[np.ndarray, np.ndarray]],
    unlabelled: list[tuple[np.ndarray, np.ndarray]],
    prior: float,
    epochs: int = 12,
    rate: float = 0.3,
    l2: float = 1e-5,
    seed: int = 7,
    least: tuple[int, int] = (LEAST_TEXTS, LEAST_POSITIVES),
) -> ToxicityModel:
    """Minimise the non-negative risk by AdaGrad; equal input gives an equal model.

    Without positives or unlabelled texts all scores are the prior.
    """
    prior = min(max(prior, 1e-3), 0.999)
    bias = float(np.log(prior / (1 - prior)))
    w = np.zeros(DIM)
    if not positive or not unlabelled:
        return ToxicityModel(w, bias)
    seen, seen_pos = np.zeros(DIM, int), np.zeros(DIM, int)
    for ids, _ in unlabelled:
        seen[ids] += 1
    for ids, _ in positive:
        seen_pos[ids] += 1
    used = (seen + seen_pos >= least[0]) & (seen_pos >= least[1])
    p, u = (_Rows([(i[k], v[k]) for i, v in rows for k in [used[i]]]) for rows in (positive, unlabelled))
    rng = np.random.default_rng(seed)
    g_w, g_b = np.full(DIM, 1e-8), 1e-8
    for _ in range(epochs):
        order = rng.permutation(len(u))
        for k in range(0, len(u), 256):
            iu, su, vu = u.batch(order[k : k + 256])
            ip, sp, vp = p.batch(rng.integers(0, len(p), 128))
            nu, n_p = len(order[k : k + 256]), 128
            zu = np.bincount(su, w[iu] * vu, nu) + bias
            zp = np.bincount(sp, w[ip] * vp, n_p) + bias
            negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            if negative >= 0:
                du, dp = _sigmoid(zu) / nu, -prior / n_p * np.ones(n_p)
            else:
                du, dp = -_sigmoid(zu) / nu, prior * _sigmoid(zp) / n_p
            grad = np.bincount(np.concatenate([iu, ip]), np.concatenate([du[su] * vu, dp[sp] * vp]), DIM) + l2 * w
            g_w += grad * grad
            w -= rate * grad / np.sqrt(g_w)
            db = du.sum() + dp.sum()
            g_b += db * db
            bias -= rate * db / np.sqrt(g_b)
    return ToxicityModel(w, float(bias))


def _sampled(texts: DataFrame, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Features of at most ``n`` distinct texts, the least by hash; the bound is documented and repeatable."""
    count = texts.count()
    if not count:
        return []
    share = min(1.0, 2 * n / count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [features(x.as_py()) for x in b.column("text")]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("h"),
                    pa.array([i.astype(np.uint32).tobytes() for i, _ in got], pa.binary()),
                    pa.array([v.astype(np.float32).tobytes() for _, v in got], pa.binary()),
                ],
                ["h", "ids", "v"],
            )

    rows = (
        texts.withColumn("h", F.xxhash64("text"))
        .filter(F.pmod("h", F.lit(1 << 20)) <= int(share * (1 << 20)))
        .groupBy("h")
        .agg(F.first("text").alias("text"))
        # where the texts are; the limit then gathers features only
        .mapInArrow(run, "h long, ids binary, v binary")
        .orderBy("h")
        .limit(n)
        .collect()
    )
    rows.sort(key=lambda r: r["h"])
    return [(np.frombuffer(r["ids"], np.uint32), np.frombuffer(r["v"], np.float32)) for r in rows]


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    prior: float | None = None,
    n_positive: int = FIT_POSITIVE,
    n_unlabelled: int = FIT_UNLABELLED,
) -> ToxicityModel:
    """Train from the rows of ``labels`` with label 1 and from all of ``docs`` as unlabelled texts.

    Null ids and labels teach nothing; a document with several labels is
    toxic if one says so. Null texts count as empty. Without ``prior`` it is
    the toxic share of the labelled rows (0.5 without any).
    """
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("y"))
    if prior is None:
        prior = known.agg(F.avg("y")).first()[0]
        prior = 0.5 if prior is None else float(prior)
    texts = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # ids of the sample's candidates, so at most that many are broadcast and no text is shuffled to find them
    toxic = known.filter("y = 1").select(F.col(id_col).alias("__id")).orderBy(F.xxhash64("__id")).limit(2 * n_positive)
    return train(
        _sampled(texts.join(F.broadcast(toxic), "__id", "left_semi").select("text"), n_positive),
        _sampled(texts.select("text"), n_unlabelled),
        prior,
    )


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row; null, empty and letterless texts have the model's base score.

    The weights (2 MB, whatever the input) are broadcast; nothing is shuffled.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [known.value.score(x.as_py()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def op6_nn_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learnt from labels which are not held out."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    seen = ~held_out("doc_id", 4, 2)
    model = fit(docs.filter(seen), labels.filter(seen))
    return score(docs, model).select(
        "doc_id",
        held_out("doc_id", 4, 2).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
