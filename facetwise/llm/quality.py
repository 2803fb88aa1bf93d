"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document. Expectation maximisation over the counts of
vote patterns (at most 3^n rows, counted over all documents) estimates each labeller's accuracy in both classes and the
posterior of every pattern. Posteriors are the training labels of a linear scorer on hashed features of the text
(byte-class trigrams and binned text statistics), fitted on a bounded sample, which then scores every document.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetwise.llm.common import Scratch, Shared, texts

#: About so many rows, chosen by a hash of doc_id (of the text where it is null), fit the linear scorer; twice as many at most.
TRAIN_ROWS = 12_000
#: Words are counted as distinct within stretches of so many, so that the share doesn't depend on the length of a text.
STRETCH = 200
WIDTH = 512
REJECT_BELOW = 0.5

#: Statistic, bad at or beyond, good at or within (None: this labeller never votes so). Low is bad if bad < good.
LABELLERS = (
    ("upper_share", 0.5, None),
    ("symbol_words", 0.2, None),
    ("bare_marks", 0.15, None),
    ("repeated_next", 0.25, None),
    ("distinct_share", -0.35, None),
    ("mean_word", 13.0, None),
    ("line_repeats", 0.3, None),
    ("packed_share", -0.2, None),
    ("plain_words", 0.6, 0.9),
    ("fresh_words", 0.7, 0.9),
)
#: Shares of few things say little: on texts of under SHORT words a labeller votes from so many words, letters or bytes on.
SHORT = 20
LEAST = {
    "upper_share": ("letters", 20), "bare_marks": ("words", 5), "repeated_next": ("words", 6), "distinct_share": ("words", 6), "mean_word": ("inner", 100),
    "line_repeats": ("words", 6), "plain_words": ("words", 4), "fresh_words": ("words", 6),
}

_CLASS = np.zeros(256, np.int64)
for _lo, _hi, _c in ((97, 122, 1), (128, 255, 1), (65, 90, 2), (48, 57, 3), (32, 32, 4), (10, 10, 5), (46, 46, 6), (44, 44, 7)):
    _CLASS[_lo : _hi + 1] = _c
for _k, _c in enumerate(b"!?|*&%$#@=<>{}[]()~^_/\\\"'-:;+"):
    _CLASS[_c] = 8 + _k % 12
_STRONG = np.isin(np.arange(256), list(b"*&%$#@=<>{}[]~^_|\\!"))
_TAIL = np.isin(np.arange(256), list(b".,;:?!"))
_SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_LETTER = _UPPER | ((np.arange(256) >= 97) & (np.arange(256) <= 122)) | (np.arange(256) >= 128)
_WORDY = _LETTER | ((np.arange(256) >= 48) & (np.arange(256) <= 57))
_KINDS = 20


def statistics(text: bytes) -> dict[str, float] | None:
    """What the labellers look at, and how much of it there is; None for texts without words."""
    w = text.split()
    n = len(w)
    if not n:
        return None
    c = np.frombuffer(text, np.uint8)
    inner = ~_SPACE[c]
    edge = np.flatnonzero(np.diff(inner, prepend=False, append=False))
    first, last = edge[::2], edge[1::2] - 1
    end, before = c[last], np.where(last > first, c[last - 1], 0)
    letters, upper = int(_LETTER[c].sum()), int(_UPPER[c].sum())
    lines = [x for x in text.split(b"\n") if x]
    repeated = sum(map(bytes.__eq__, w, w[1:])) / max(1, n - 1)
    return {
        "upper_share": upper / max(1, letters),
        "symbol_words": float((_STRONG[end] & _STRONG[before]).sum()) / n,
        "bare_marks": float((np.add.reduceat(_WORDY[c], first, dtype=np.int32) == 0).sum()) / n,
        "repeated_next": repeated,
        "distinct_share": sum(len(set(w[k : k + STRETCH])) for k in range(0, n, STRETCH)) / n,
        "mean_word": float(inner.sum()) / n,
        "line_repeats": 1 - len(set(lines)) / len(lines),
        "packed_share": len(zlib.compress(text, 1)) / len(text),
        "plain_words": float((_LETTER[end] | (_TAIL[end] & _LETTER[before])).sum()) / n,
        "fresh_words": 1 - repeated,
        "words": n,
        "letters": letters,
        "inner": int(inner.sum()),
    }


def votes(stats: dict[str, float] | None) -> str:
    """A letter for each labeller: g(ood), b(ad) or - (no vote)."""
    if stats is None:
        return "-" * len(LABELLERS)
    out = []
    for name, bad, good in LABELLERS:
        x = stats[name]
        of, least = LEAST.get(name, ("words", 1))
        if stats["words"] < SHORT and stats[of] < least:
            out.append("-")
        elif good is None:  # a negative limit: low is bad
            out.append("b" if (x >= bad if bad > 0 else x <= -bad) else "-")
        else:
            out.append("b" if x <= bad else "g" if x >= good else "-")
    return "".join(out)


def features(text: bytes, stats: dict[str, float] | None) -> np.ndarray:
    """WIDTH hashed features: shares of byte-class trigrams, and bins of the statistics."""
    x = np.zeros(WIDTH)
    if len(text) >= 3:
        c = _CLASS[np.frombuffer(text, np.uint8)]
        code = (c[:-2] * _KINDS + c[1:-1]) * _KINDS + c[2:]
        full = np.bincount(code, minlength=_KINDS**3)
        seen = np.flatnonzero(full)
        np.add.at(x, (seen * 2654435761 >> 7) % WIDTH, np.sqrt(full[seen] / len(code)))
    if stats is not None:
        for k, (name, _, _) in enumerate(LABELLERS):
            place = int(min(15, max(0, round(stats[name] * (1 if name == "mean_word" else 15)))))
            x[((k * 16 + place + 1) * 40503 >> 3) % WIDTH] += 1.0
    x[0] = 1.0
    return x


class LabelModel:
    """Accuracies of the labellers and the share of good documents, by expectation maximisation over pattern counts."""

    def __init__(self, patterns: dict[str, int], rounds: int = 200):
        kinds = sorted(p for p in patterns if p.strip("-"))
        self.prior, self.accuracy = 0.5, np.zeros((2, len(LABELLERS), 3))  # of votes g, b, - by class bad, good
        n = np.array([patterns[p] for p in kinds], float)
        vote = np.array([[[c == v for v in "gb-"] for c in p] for p in kinds], float).reshape(len(kinds), len(LABELLERS), 3)
        # Labellers look at different defects: at first, one bad vote makes a document bad.
        q = np.where(vote[:, :, 1].any(1), 0.001, 0.999) if len(kinds) else np.zeros(0)
        for _ in range(rounds if len(kinds) else 0):
            self.prior = float(np.clip((n * q).sum() / n.sum(), 0.001, 0.999))
            for y, weight in ((1, n * q), (0, n * (1 - q))):
                self.accuracy[y] = (np.einsum("p,plv->lv", weight, vote) + 0.1) / (weight.sum() + 0.3)
            odds = np.log(self.prior / (1 - self.prior)) + np.einsum("plv,lv->p", vote, np.log(self.accuracy[1] / self.accuracy[0]))
            q = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        self.posterior = dict(zip(kinds, q.tolist(), strict=True))


class Scorer:
    """Logistic weights over the hashed features; without training everything scores 1."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 300, ridge: float = 1e-4):
        self.w = None
        if not len(x):
            return
        parts = [slice(at, at + 1024) for at in range(0, len(x), 1024)]  # in double precision part by part
        size = sum(float(np.square(x[s], dtype=float).sum()) for s in parts)
        w, v, rate = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 4.0 * len(x) / max(1e-9, size)
        for _ in range(rounds):
            ahead, slope = w + 0.9 * v, np.zeros(x.shape[1])
            for s in parts:
                own = x[s].astype(float)
                slope += (1 / (1 + np.exp(-np.clip(own @ ahead, -50, 50))) - y[s]) @ own
            v = 0.9 * v - rate * (slope / len(x) + ridge * ahead)
            w = w + v
        self.w = w

    def score(self, text: bytes) -> float:
        stats = statistics(text)
        if self.w is None or stats is None:  # nothing to judge
            return 1.0
        return float(1 / (1 + np.exp(-np.clip(features(text, stats) @ self.w, -50, 50))))


def train(docs: DataFrame, spark: SparkSession, *, rows: int = TRAIN_ROWS, scratch: Scratch | None = None) -> tuple[LabelModel, Scorer]:
    """The label model of all documents and the scorer fitted on a sample with its posteriors as labels.

    Every text is looked at once: a task returns its counts of vote patterns, and votes and features of its part of the
    sample. Posteriors follow from the counts; the sample comes to the driver (1 kB a row in half precision, 2 * rows at
    most).
    """
    share = min(1.0, rows / max(1, docs.count()))
    text = F.col("text").cast("string")
    picked = F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64(text)).otherwise(F.xxhash64("doc_id")), F.lit(1 << 20)) < share * (1 << 20)

    def look(batches):
        seen: dict[str, int] = {}
        for b in batches:
            own, xs = [], []
            for t, sampled in zip(texts(b.column(0)), b.column(1).to_pylist(), strict=True):
                stats = statistics(t)
                v = votes(stats)
                seen[v] = seen.get(v, 0) + 1
                if sampled and v.strip("-"):
                    own.append(v)
                    xs.append(features(t, stats).astype(np.float16).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.nulls(len(own), pa.int64()), pa.array(xs, pa.binary())], ["votes", "n", "x"])
        counts = [pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64()), pa.nulls(len(seen), pa.binary())]
        yield pa.RecordBatch.from_arrays(counts, ["votes", "n", "x"])

    looked = (scratch or Scratch(spark)).cut(docs.select(text.alias("text"), picked.alias("picked")).mapInArrow(look, "votes string, n long, x binary"))
    model = LabelModel({r["votes"]: r["n"] for r in looked.where("x is null").groupBy("votes").agg(F.sum("n").alias("n")).collect()})
    got = looked.where("x is not null").limit(2 * rows).select("votes", "x").toArrow()
    x = np.empty((got.num_rows, WIDTH), np.float32)
    for k, row in enumerate(got.column("x")):
        x[k] = np.frombuffer(row.as_buffer(), np.float16)
    y = np.array([model.posterior[v] for v in got.column("votes").to_pylist()], float)
    del got
    pa.default_memory_pool().release_unused()
    return model, Scorer(x, y)


def scores(docs: DataFrame, scorer: Scorer, spark: SparkSession, *, below: float = REJECT_BELOW) -> DataFrame:
    """One row per row of docs: doc_id, score (0 to 1, higher is better), rejected (score < below).

    Null and empty texts and texts without words score 1: there is nothing to judge. Texts of any length are read whole
    and judged by the same rules. Repeated rows score alike; other columns are not read; an empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = Shared(spark, scorer)

    def run(batches):
        for b in batches:
            s = np.array([shared.value.score(t) for t in texts(b.column(1))], float)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array(s < below)], ["doc_id", "score", "rejected"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, score double, rejected boolean")


def keep(docs: DataFrame, scorer: Scorer, spark: SparkSession, *, below: float = REJECT_BELOW) -> DataFrame:
    """The rows of docs that are not rejected, with their columns; nothing is shuffled.

    Null and empty texts and texts without words stay. Repeated rows are judged alike; an empty table gives no rows.
    """
    shared = Shared(spark, scorer)
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            yield b.filter(pa.array([shared.value.score(t) >= below for t in texts(b.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
