"""Secret scans: candidates by pattern, false positives removed by a random forest.

A candidate is a value that is assigned to something, also inside another
value, or a long run of key characters, dotted ones as a whole. The forest looks at its length, its character transitions (how
often the class changes, and how likely its letter pairs are in prose), how
much of it dictionary words cover, the path it comes from, and the words
beside it. It is trained here, in numpy, from labelled findings.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import lean, materialize, read_table

TREES, DEPTH, SEED = 32, 8, 11
#: At most so many labelled findings are fitted.
FIT_FINDINGS = 20_000
THRESHOLD = 0.5

_ASSIGNED = re.compile(r"""[:=]\s{0,4}["'`]?([^\s"'`,;<>(){}\[\]|]{8,})""")
#: What is assigned once more inside an assigned value, as in query strings; the name before a further = is none.
_INNER = re.compile(r"[?&=]([^?&=]{8,}+(?:=+(?=[?&]|$))?)(?!=)")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_=.@-])[A-Za-z0-9+/_=.-]{16,}")
#: The body of a key in armour, over its lines.
_ARMOUR = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----\s*([A-Za-z0-9+/=\s]{16,}?)\s*-----END ")
_SPACE = re.compile(r"\s+")
_DIGIT = re.compile("[0-9]")
_WORD = re.compile(r"[A-Za-z]{2,}")

# Fixed word lists: what is near or in the path of secrets and of their look-alikes, and common words.
NEAR_SECRET = ("token", "secret", "key", "password", "passwd", "pwd", "apikey", "auth", "bearer", "credential", "private", "access", "client", "login")
NEAR_OTHER = ("commit", "sha", "md", "checksum", "hash", "digest", "uuid", "id", "version", "revision", "build", "etag", "invoice", "card", "phone", "order", "url", "http", "https", "file", "path")
IN_VALUE = ("example", "your", "changeme", "placeholder", "dummy", "sample", "test", "xxxx", "todo", "here", "none", "null", "undefined", "env", "config")
IN_PATH = ("test", "tests", "example", "examples", "doc", "docs", "fixture", "fixtures", "mock", "sample")
WORDS = (
    "the and for that with this from have not are was but you all can had her his one our out day get has him how man new now old see two way who boy did its "
    "let put say she too use about after again before being between both data default each file first found group house into just know large last line long "
    "made make many more most much must name number only other over page part people place point right same service should show small some state still such "
    "system take than their them then there these they thing think time under user value very want water well were what when where which while will word work "
    "world would write year api app base build cache class client code config connection content count create date delete error event format function index "
    "input install item java library link list local main map message method model module node object option order output package param path port process "
    "project query read record release request response result return root run save schema script select server session set size source start status string "
    "table text title token type update upload url version view web window admin database password secret key id auth login example test sample placeholder "
    "change here your my private public access"
).split()


#: Words of a corpus which make a dictionary, most frequent first.
DICTIONARY_WORDS = 20_000


class Lexicon:
    """Dictionary words for coverage, and how likely letter pairs are in them."""

    def __init__(self, words: Iterable[str] = ()):
        self.words = frozenset(w.lower() for w in [*WORDS, *words] if len(w) >= 3)
        self.most = max(map(len, self.words))
        c = np.full((27, 27), 0.2)
        for w in sorted(self.words):
            for x, y in zip(f" {w}", f"{w} ", strict=True):
                c[_letter(x), _letter(y)] += 1
        self.pairs = np.log(c / c.sum(1, keepdims=True))

    def coverage(self, value: str) -> float:
        """The share of the value's characters which words cover, longest match first."""
        low, i, got = value.lower(), 0, 0
        while i < len(low):
            for n in range(min(self.most, len(low) - i), 2, -1):
                if low[i : i + n] in self.words:
                    got += n
                    i += n
                    break
            else:
                i += 1
        return got / max(1, len(value))


def _letter(ch: str) -> int:
    return ord(ch) - 96 if "a" <= ch <= "z" else 0


def corpus_words(docs: DataFrame, text_col: str = "text", size: int = DICTIONARY_WORDS) -> list[str]:
    """Up to ``size`` words that most texts have, of 3 to 20 letters, counted in all of them; no word of a single text.

    Each text counts a word once. Null and empty texts have none. Words are
    taken by steps of frequency, sixteen an octave, as long as a whole step
    fits. The driver sees the number of words of each step (hundreds) and the
    dictionary, whatever the input.
    """
    words = F.array_distinct(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^\p{L}]+"))
    each = docs.select(F.explode(F.filter(words, lambda w: (F.length(w) >= 3) & (F.length(w) <= 20))).alias("w"))
    counted = each.groupBy("w").agg(F.count("*").alias("n")).filter("n > 1").withColumn("step", F.floor(16 * F.log2("n")))
    counted = materialize(counted, "words")
    steps = {r["step"]: r["n"] for r in counted.groupBy("step").agg(F.count("*").alias("n")).collect()}
    least, total = None, 0
    for step in sorted(steps, reverse=True):
        total += steps[step]
        if total > size:
            break
        least = step
    if least is None:
        return []
    return sorted(r["w"] for r in counted.filter(F.col("step") >= least).select("w").collect())


def _class(ch: str) -> int:
    return 0 if "a" <= ch <= "z" else 1 if "A" <= ch <= "Z" else 2 if "0" <= ch <= "9" else 3


FEATURES = (
    "length", "digits", "upper", "other", "changes", "entropy", "pairs", "coverage", "hex", "distinct", "in_value",
    "near_secret", "near_other", "in_path", "assigned", "longest_letters", "dots",
)


def features(value: str, before: str, after: str, path: str | None, assigned: bool, lexicon: Lexicon) -> list[float]:
    n = len(value)
    kinds = [_class(c) for c in value]
    share = [kinds.count(k) / n for k in range(4)]
    counts = [value.count(c) for c in set(value)]
    entropy = -sum(c / n * math.log2(c / n) for c in counts)
    at = np.array([_letter(c) for c in value.lower()])
    pairs = float(lexicon.pairs[at[:-1], at[1:]].mean()) if n > 1 else 0.0
    low = value.lower()
    beside = {w.lower() for w in _WORD.findall(before)[-4:]} | {w.lower() for w in _WORD.findall(after)[:2]}
    runs = [len(r) for r in re.findall("[A-Za-z]+", value)]
    where = {w.lower() for w in _WORD.findall(path or "")}
    return [
        n, share[2], share[1], share[3], sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n, entropy, pairs,
        lexicon.coverage(value), float(all(c in "0123456789abcdef" for c in low)), len(counts) / n, float(any(w in low for w in IN_VALUE)),
        float(any(s in w for w in beside for s in NEAR_SECRET)), float(any(w in beside for w in NEAR_OTHER)),
        float(bool(where & set(IN_PATH))), float(assigned), max(runs, default=0) / n, value.count(".") / n,
    ]


@dataclass
class Forest:
    """Trees as arrays: feature (-1: leaf), threshold, the left child (the right one follows it), and the share of secrets."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    lexicon: Lexicon

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for feature, cut, left, share in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH + 1):
                f = feature[at]
                inner = f >= 0
                go = left[at] + (x[np.arange(len(x)), np.maximum(f, 0)] > cut[at])
                at = np.where(inner, go, at)
            out += share[at]
        return out / max(1, len(self.trees))


def _tree(x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
    feature, cut, left, share = [-1], [0.0], [0], [float(y.mean())]
    work = [(0, np.arange(len(y)), 0)]
    some = max(2, int(math.sqrt(x.shape[1])) + 1)
    while work:
        node, rows, depth = work.pop()
        p = y[rows].mean()
        if depth == DEPTH or len(rows) < 4 or p in (0, 1):
            continue
        best = (1e-9, -1, 0.0)
        for f in rng.choice(x.shape[1], some, replace=False):
            v = x[rows, f]
            for t in np.unique(np.quantile(v, (0.1, 0.25, 0.4, 0.5, 0.6, 0.75, 0.9))):
                right = v > t
                k = right.sum()
                if 0 < k < len(rows):
                    a, b = y[rows][~right].mean(), y[rows][right].mean()
                    gain = p * (1 - p) - (a * (1 - a) * (len(rows) - k) + b * (1 - b) * k) / len(rows)
                    if gain > best[0]:
                        best = (gain, int(f), float(t))
        if best[1] < 0:
            continue
        feature[node], cut[node], left[node] = best[1], best[2], len(feature)
        right = x[rows, best[1]] > best[2]
        for side in (rows[~right], rows[right]):
            feature.append(-1)
            cut.append(0.0)
            left.append(0)
            share.append(float(y[side].mean()))
            work.append((len(feature) - 1, side, depth + 1))
    return np.array(feature), np.array(cut), np.array(left), np.array(share)


def train(x: np.ndarray, y: np.ndarray, lexicon: Lexicon, trees: int = TREES, seed: int = SEED) -> Forest:
    """Trees on bootstrap samples, a few features tried at each split; equal input gives an equal forest."""
    rng = np.random.default_rng(seed)
    if not len(y):
        return Forest([], lexicon)
    return Forest([_tree(x[rows], y[rows], rng) for rows in (rng.integers(0, len(y), len(y)) for _ in range(trees))], lexicon)


_SCHEMA = "value string, before string, after string, path string, assigned boolean, label int"


def example_findings(n: int = 2400, seed: int = 5, words: list[str] = WORDS) -> list[tuple]:
    """Labelled findings made by rule, for where no reviewed ones are at hand: secrets and their look-alikes.

    Secrets and look-alikes both occur assigned and by themselves, so that
    neither is told by the pattern which found it.
    """
    r = random.Random(seed)
    hexa = lambda k: "".join(r.choices("0123456789abcdef", k=k))
    mixed = lambda k, more="": "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789" + more, k=k))
    word = lambda: r.choice(words)
    prose = lambda k: " ".join(word() for _ in range(k))
    path = lambda: r.choice(("src/app/main.py", "deploy/prod.yaml", "web/config.js", "src1", "src9", "notes.md", None))
    mute = lambda: r.choice(("tests/test_api.py", "docs/examples/setup.md", "fixtures/mock.json"))
    name = lambda: r.choice(("token", "secret", "api_key", "password", "access_key", "client_secret", "auth_token", "private_key", "TOKEN", "PASSWD", "login"))
    phrase = lambda: r.choice(("Authorization: Bearer", "the secret key is", "use token", "my password", "log in with the access key", "api key", "auth", "client secret"))

    def secret() -> str:
        k = r.randrange(8)
        if k == 0:
            return hexa(r.choice((32, 40, 48, 64, 128)))
        if k == 1:
            return mixed(r.randint(16, 60))
        if k == 2:
            return mixed(r.choice((40, 88, 400, 900)), "+/") + r.choice(("", "=", "=="))
        if k == 3:
            return r.choice(("AKIA", "ghp_", "sk_live_", "xoxb-")) + mixed(r.randint(16, 36))
        if k == 4:
            return ".".join(mixed(r.randint(20, 60), "_-") for _ in range(3))
        if k == 5:
            return mixed(r.randint(10, 16), "!#%*")
        if k == 6:
            return "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(20, 40)))
        return mixed(r.randint(20, 44)).upper()

    def other() -> tuple[str, str, str | None, bool]:
        k = r.randrange(14)
        if k == 0:
            return hexa(40), f"{prose(2)} {r.choice(('commit', 'revision', 'sha'))} ", path(), False
        if k == 1:
            return hexa(r.choice((32, 64))), f"{r.choice(('md5', 'checksum', 'digest', 'hash', 'sha256', 'etag'))}: ", path(), True
        if k == 2:
            return "-".join(hexa(x) for x in (8, 4, 4, 4, 12)), f"{prose(1)} {r.choice(('id', 'uuid', 'request id'))} = ", path(), True
        if k == 3:
            fake = r.choice(("your_api_key_here", "changeme_please", "x" * r.randint(8, 30), "example_token_value", "placeholder_secret", "<your-token>", "dummy_password1", "none_undefined"))
            return fake, f"{name()} = ", r.choice((mute(), path())), True
        if k == 4:
            return "".join(w.title() for w in (word(), word(), word(), word())), f"{r.choice((word(), name()))} = ", path(), True
        if k == 5:
            return r.choice("_-.").join((word(), word(), word())), f"{r.choice((word(), name()))}: ", path(), True
        if k == 6:
            return "".join(r.choices("0123456789", k=r.choice((10, 12, 16, 20)))), f"{prose(2)} {r.choice(('card', 'order', 'invoice', 'phone', word()))} ", path(), r.random() < 0.3
        if k == 7:
            return f"{word()}.{r.randint(1, 99)}@mail{r.randint(1, 9)}.example.com", f"{word()}: ", path(), True
        if k == 8:
            return f"//{word()}.{word()}.org/{word()}/{word()}{r.randint(1, 9)}", "https:", path(), True
        if k == 9:
            return r.choice((hexa(40), mixed(24))), f"{prose(1)} {name()} = ", mute(), True
        if k == 10:
            return f"{r.choice(('config', 'os.environ', 'env', 'settings'))}.{word()}_{r.choice(('key', 'token', 'secret'))}", f"{name()} = ", path(), True
        if k == 11:
            return f"{word()}/{word()}/{word()}{r.randint(1, 99)}/{word()}", f"{r.choice(('file', 'path', 'url', word()))} ", path(), False
        if k == 12:
            return f"{word()}-{word()}-{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}", f"{r.choice(('version', 'build', word()))} ", path(), r.random() < 0.5
        return mixed(r.randint(16, 40)), f"{prose(2)} {r.choice(('checksum', 'hash', 'etag', 'build', 'revision', 'digest'))} ", path(), r.random() < 0.5

    out = []
    for _ in range(n // 2):
        assigned = r.random() < 0.6
        value = secret()
        sure = value[:4] in ("AKIA", "ghp_", "sk_l", "xoxb")
        before = f"{prose(3)} {name()}{r.choice((' = ', ': ', '='))}{r.choice(('', chr(34), chr(39)))}" if assigned else f"{prose(3)} " if sure and r.random() < 0.5 else f"{prose(2)} {phrase()} "
        out.append((value, before, f" {prose(3)}", path(), assigned, 1))
        value, before, where, assigned = other()
        out.append((value, before, f" {prose(2)}", where, assigned, 0))
    return out


def fit(findings: DataFrame | list[tuple], lexicon: Lexicon | None = None) -> Forest:
    """The forest of labelled findings (value, before, after, path, assigned, label); at most ``FIT_FINDINGS``, by hash.

    label is 1 for a secret, 0 for a false positive; before and after are the
    text around the value, path the file it is in. Rows without a value or a
    label teach nothing; without any finding nothing is a secret.
    """
    lexicon = lexicon or Lexicon()
    if isinstance(findings, DataFrame):
        usable = findings.filter("value is not null and value != '' and label is not null")
        rows = usable.select(*[c.split()[0] for c in _SCHEMA.split(", ")]).orderBy(F.xxhash64("value", "before", "after"), "value").limit(FIT_FINDINGS)
        findings = [tuple(r) for r in rows.collect()]
    x = np.array([features(v, b or "", a or "", p, bool(s), lexicon) for v, b, a, p, s, _ in findings], float).reshape(-1, len(FEATURES))
    return train(x, np.array([y for *_, y in findings], float), lexicon)


def candidates(text: str | None) -> list[tuple[int, int, bool]]:
    """(first, past the last, assigned) of every candidate, in order.

    Values assigned inside an assigned value lie within it; each is a candidate
    of its own. Of a run, what assigned values leave is a candidate.
    """
    if not text:
        return []
    taken = [m.span(1) for m in _ASSIGNED.finditer(text)]
    found = [(a, b, True) for a, b in taken] + [(*m.span(1), True) for m in _ARMOUR.finditer(text)]
    for a, b in taken:
        found += [(a + m.start(1), a + m.end(1), True) for m in _INNER.finditer(text[a:b])]
    k = 0
    for m in _RUN.finditer(text):
        a, b = m.span()
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        i = k
        while a < b:
            end, then = taken[i] if i < len(taken) and taken[i][0] < b else (b, b)
            part = text[a:end] if a < end else ""
            first = a + len(part) - len(part.lstrip("."))
            last = first + len(part.strip("."))
            if last - first >= 16 and _DIGIT.search(text, first, last):
                found.append((first, last, False))
            a, i = then, i + 1
    return sorted(found)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans without overlaps, which cover the same characters."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_FOUND = "doc_id long, first int, last int, assigned boolean, probability double, is_secret boolean, value_sha256 string"


def judged_spans(text: str | None, path: str | None, forest: Forest) -> list[tuple[int, int, bool, float]]:
    found = candidates(text)
    if not found:
        return []
    x = np.array([features(_SPACE.sub("", text[a:b]), text[max(0, a - 48) : a], text[b : b + 24], path, s, forest.lexicon) for a, b, s in found])
    return [(a, b, s, float(p)) for (a, b, s), p in zip(found, forest.predict(x), strict=True)]


def scan(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each candidate of each row: doc_id, first, last (characters), assigned, probability, is_secret, value_sha256.

    Null and empty texts have none. A null path counts as no path. Repeated
    rows give repeated findings. The value itself is not returned, its digest
    is. The forest has a fixed size and is broadcast; nothing is shuffled.
    """
    known = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, text, path in zip(*(b.column(i) for i in range(3)), strict=True):
                text = text.as_py()
                for first, last, assigned, p in judged_spans(text, path.as_py(), known.value):
                    rows.append((doc.as_py(), first, last, assigned, p, p >= threshold, hashlib.sha256(text[first:last].encode("utf-8", "surrogatepass")).hexdigest()))
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.float64(), pa.bool_(), pa.string())
            cols = [pa.array(v, k) for v, k in zip(zip(*rows) if rows else [[]] * 7, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(cols, [f.split()[0] for f in _FOUND.split(", ")])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(path_col).cast("string").alias("path"))
    return rows.mapInArrow(lean(run), _FOUND)


MASK = "[SECRET]"


def masked(docs: DataFrame, forest: Forest, text_col: str = "text", path_col: str = "source", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with each secret in the text column replaced by ``MASK``; all other columns and rows as they are.

    Null and empty texts stay, a null path counts as no path, overlapping
    secrets are masked as one. An empty table stays empty.
    """
    known = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, path in zip(b.column(text_col), b.column(path_col), strict=True):
                text = text.as_py()
                secret = [(first, last) for first, last, _, p in judged_spans(text, path.as_py(), known.value) if p >= threshold]
                for first, last in reversed(_merged(secret)):
                    text = text[:first] + MASK + text[last:]
                out.append(text)
            yield b.set_column(b.schema.get_field_index(text_col), b.schema.field(text_col), pa.array(out, b.schema.field(text_col).type))

    return docs.mapInArrow(lean(run), docs.schema)


def trained_for(docs: DataFrame, text_col: str = "text") -> Forest:
    """A forest of :func:`example_findings` whose dictionary and letter pairs are those of ``docs``, in all their languages."""
    return fit(example_findings(), Lexicon(corpus_words(docs, text_col)))


def op2_random_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates in all documents with the forest's verdict; the dictionary is that of the documents."""
    docs = read_table(spark, sf_dir, "documents")
    return scan(docs, trained_for(docs))
