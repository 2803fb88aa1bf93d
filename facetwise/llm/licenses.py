"""License scans as an exact set-similarity join between templates and text blocks.

For a template of w words a document's blocks are windows of 2 w words at every w-th word, so that any w words in a row
lie in a block. A template T matches a block B if |T and B| >= a = ceil(THRESHOLD |T|), tokens as sets. Tokens are put in one global order, rare ones first, by
the number of documents that have them (counted over all documents). A block that matches must hold one of the first
|T| - a + 1 tokens of T (prefix filter), must have a tokens (length filter), and at the first common token enough
tokens must be left on both sides (positional filter); what is left is verified by counting.

Phrases are templates whose words must stand consecutively; all their places are reported.
"""

from __future__ import annotations

import math
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetwise.llm.common import Shared, texts, words
from facetwise.llm.license_texts import TEMPLATES

THRESHOLD = 0.9
#: Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Templates are broadcast; this bounds their text.
TEMPLATE_BYTES = 16_000_000


class Matcher:
    """Templates in the global token order, and phrases."""

    def __init__(self, templates, phrases: dict[str, str], frequency: dict[bytes, int], threshold: float):
        split = [(words(t.encode()), label) for t, label in templates]
        self.phrases = [(words(p.encode()), label) for p, label in phrases.items()]
        names = {w for t, _ in [*split, *self.phrases] for w in t}
        order = sorted(names, key=lambda w: (frequency.get(w, 0), w))
        self.vocab = {w: k + 1 for k, w in enumerate(order)}  # 0: any other word; small codes are rare words
        self.phrase_codes = [[self.vocab[w] for w in p] for p, _ in self.phrases]
        split = [(t, label) for t, label in split if t]
        self.step = [len(t) for t, _ in split]
        self.sets, self.need, self.label = [], [], []
        self.by_prefix: dict[int, list[tuple[int, int]]] = {}
        for t, label in split:
            codes = sorted({self.vocab[w] for w in t})
            need = math.ceil(threshold * len(codes) - 1e-9)
            for at, c in enumerate(codes[: len(codes) - need + 1]):
                self.by_prefix.setdefault(c, []).append((len(self.sets), at))
            self.sets.append(codes)
            self.need.append(need)
            self.label.append(label)
        self.asks = np.zeros(len(self.vocab) + 1, bool)
        self.asks[list(self.by_prefix)] = True

    def blocks(self, code: np.ndarray) -> dict[int, float]:
        """Template to its best containment in a block, for those that some block meets."""
        found: dict[int, float] = {}
        sets: dict[tuple[int, int], list[int]] = {}
        done: set[tuple[int, int]] = set()
        for place in np.flatnonzero(self.asks[code]).tolist():
            token = int(code[place])
            for t, at in self.by_prefix[token]:
                step = self.step[t]
                for block in {max(0, place // step - 1), place // step}:
                    if (t, block) in done:
                        continue
                    own = sets.get((step, block))
                    if own is None:
                        own = np.unique(code[block * step : (block + 2) * step]).tolist()
                        own = sets[step, block] = own[own[0] == 0 :]
                    if len(own) < self.need[t]:
                        continue
                    # The first common token leaves so many on either side; a later one is tried at its own place.
                    if 1 + min(len(self.sets[t]) - at - 1, len(own) - bisect_left(own, token) - 1) < self.need[t]:
                        continue
                    done.add((t, block))
                    common = len(set(own).intersection(self.sets[t]))
                    if common >= self.need[t]:
                        found[t] = max(found.get(t, 0.0), common / len(self.sets[t]))
        return found

    def scan(self, text: bytes) -> tuple[int, int, int | None, int | None, list[str], list[str], float]:
        w = words(text)
        get = self.vocab.get
        code = np.fromiter((get(x, 0) for x in w), np.int32, len(w))
        starts, base = [], set()
        for codes, (_, label) in zip(self.phrase_codes, self.phrases, strict=True):
            n = len(code) - len(codes) + 1
            if n > 0:
                hit = code[:n] == codes[0]
                for k, c in enumerate(codes[1:], 1):
                    hit &= code[k : k + n] == c
                if hit.any():
                    base.add(label)
                    starts.append(np.flatnonzero(hit))
        found = self.blocks(code)
        places = np.sort(np.concatenate(starts)) if starts else np.zeros(0, np.int64)
        score = 1.0 if base else max(found.values(), default=0.0)
        first, last = (int(places[0]), int(places[-1])) if len(places) else (None, None)
        return len(w), len(places), first, last, sorted(base), sorted(base | {self.label[t] for t in found}), score


def frequencies(docs: DataFrame, names: set[bytes]) -> dict[bytes, int]:
    """Over all documents: how many have each of these words. As many rows as names come to the driver."""

    def run(batches):
        seen = dict.fromkeys(names, 0)
        for b in batches:
            for t in texts(b.column(0)):
                for w in names.intersection(words(t)):
                    seen[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in seen]), pa.array(list(seen.values()), pa.int64())], ["w", "n"])

    parts = docs.select(F.col("text").cast("string")).mapInArrow(run, "w string, n long")
    return {r["w"].encode(): r["n"] for r in parts.groupBy("w").agg(F.sum("n").alias("n")).collect()}


def scan(
    docs: DataFrame, spark: SparkSession, *, templates=TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD
) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts all places of phrases, first_word and last_word are their least and largest start (null without any).
    labels adds those of templates that a block meets; score is 1 with a phrase, else the best containment of a template
    that matched, else 0. Null and empty texts have no words and no labels (empty strings). Repeated rows are scanned
    alike; other columns are not read; an empty table gives no rows. Templates without words match nothing.
    """
    if sum(len(t) for t, _ in templates) > TEMPLATE_BYTES:
        raise ValueError(f"templates of over {TEMPLATE_BYTES} characters are too large to broadcast: scan with parts of them")
    names = {w for t, _ in templates for w in words(t.encode())} | {w for p in phrases for w in words(p.encode())}
    shared = Shared(spark, Matcher(templates, phrases, frequencies(docs, names), threshold))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows = [shared.value.scan(t) for t in texts(b.column(1))]
            n, base, first, last, own, labels, score = map(list, zip(*rows, strict=True)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array(n, pa.int64()),
                    pa.array(base, pa.int64()),
                    pa.array(first, pa.int64()),
                    pa.array(last, pa.int64()),
                    pa.array([",".join(x) for x in own], pa.string()),
                    pa.array([",".join(x) for x in labels], pa.string()),
                    pa.array(score, pa.float64()),
                ],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    schema = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, schema)
