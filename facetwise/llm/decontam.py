"""Benchmark decontamination with an FM-index per shard of training text.

A shard is a run of documents of one partition (about SHARD words). Its words are coded by the vocabulary of the test
phrases; every word outside that vocabulary and every end of a document is a separator, which no phrase contains. Over
that sequence an FM-index is built: suffix order, its Burrows-Wheeler transform in a wavelet matrix, and suffix
positions sampled at every SAMPLE-th place and behind every separator. All phrases are searched backwards at once;
occurrences are located by stepping to the next sampled place; overlapping spans are merged per document.

Documents are not shuffled. The phrases are broadcast in blocks of about PHRASE_WORDS benchmark words (a window of 13
words starts at each, of 52 bytes; with the vocabulary about 100 MB in a worker, 300 MB on the driver while it is made);
with more than one block, each block scans the documents, and spans are brought together by document.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetwise.llm.common import Shared, texts, words

WINDOW = 13
SAMPLE = 16
SHARD = 1 << 20
PHRASE_WORDS = 500_000
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class Phrases:
    """The distinct windows of a set of items, coded by their own vocabulary."""

    def __init__(self, items: list[tuple[object, bytes]], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], list[int]] = {}
        self.items = [str(i) for i, _ in items]
        for k, (_, text) in enumerate(items):
            w = [self.vocab.setdefault(x, len(self.vocab) + 1) for x in words(text)]
            for at in range(max(1, len(w) - window + 1) if w else 0):
                mine = owners.setdefault(tuple(w[at : at + window]), [])
                if not mine or mine[-1] != k:
                    mine.append(k)
        self.size = np.array([len(p) for p in owners], np.int64)
        self.code = np.zeros((len(owners), window), np.int32)  # reversed: the last word first
        for k, p in enumerate(owners):
            self.code[k, : len(p)] = p[::-1]
        self.at = np.concatenate([[0], np.cumsum([len(x) for x in owners.values()])]).astype(np.int64)
        self.owner = np.array([i for x in owners.values() for i in x], np.int32)


def suffix_array(sym: np.ndarray) -> np.ndarray:
    """Order of the suffixes of sym, where every 0 is a separator of its own, ordered by place. sym ends with 0."""
    n = len(sym)
    place, width = max(1, int(n).bit_length()), max(1, int(sym.max(initial=1)).bit_length())
    depth = min(n, max(1, (62 - place) // width))
    key = np.zeros(n, np.int64)
    open_ = np.ones(n, bool)  # no separator so far
    for d in range(depth):
        nxt = np.zeros(n, np.int64)
        nxt[: n - d] = sym[d:]
        nxt[~open_] = 0
        open_ &= nxt > 0
        key = (key << width) | nxt
    order = np.sort((key << place) | np.arange(n, dtype=np.int64))
    sa = order & ((1 << place) - 1)
    order >>= place
    first = np.ones(n, bool)
    first[1:] = order[1:] != order[:-1]
    first |= ~open_[sa]  # a separator within reach: already ordered, by place
    del order, key
    rank = np.empty(n, np.int64)
    slots = np.arange(n, dtype=np.int64)
    rank[sa] = np.maximum.accumulate(np.where(first, slots, 0))
    todo = np.flatnonzero(~(first & np.append(first[1:], True)))  # slots whose group has more than one member
    while len(todo):
        pos = sa[todo]
        group, after = rank[pos], rank[pos + depth]
        if 3 * place <= 62:
            packed = np.sort((group << (2 * place)) | (after << place) | pos)
            pos = packed & ((1 << place) - 1)
            packed >>= place
        else:
            packed = (group << place) | after
            by = np.argsort(packed, kind="stable")
            pos, packed = pos[by], packed[by]
        sa[todo] = pos
        head = np.ones(len(todo), bool)
        head[1:] = packed[1:] != packed[:-1]
        rank[pos] = np.maximum.accumulate(np.where(head, todo, 0))
        todo = todo[~(head & np.append(head[1:], True))]
        depth *= 2
    return sa


class FMIndex:
    """Counts and places of phrases in a sequence of codes with separators (0)."""

    def __init__(self, sym: np.ndarray, sample: int = SAMPLE):
        n = self.n = len(sym)
        sa = suffix_array(sym)
        self.levels = max(1, int(sym.max(initial=1)).bit_length())
        self.before = np.concatenate([[0], np.cumsum(np.bincount(sym, minlength=1 << self.levels))]).astype(np.int64)
        prev = sym[sa - 1]  # the last symbol is a separator
        keep = (sa % sample == 0) | (prev == 0)
        self.marked = np.concatenate([[0], np.cumsum(keep)]).astype(np.int32)
        self.places = sa[keep]
        self.ones, self.zeros = [], []
        for level in range(self.levels - 1, -1, -1):
            bit = ((prev >> level) & 1).astype(bool)
            ones = np.zeros(n + 1, np.int32)
            np.cumsum(bit, out=ones[1:], dtype=np.int32)
            self.ones.append(ones)
            self.zeros.append(n - int(ones[-1]))
            prev = np.concatenate([prev[~bit], prev[bit]])
        self.start = self._down(np.arange(1 << self.levels), np.zeros(1 << self.levels, np.int64))

    def _down(self, code: np.ndarray, row: np.ndarray) -> np.ndarray:
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            one = ones[row]
            row = np.where((code >> (self.levels - 1 - k)) & 1 == 1, zeros + one, row - one)
        return row

    def step(self, code: np.ndarray, row: np.ndarray) -> np.ndarray:
        """First row of the suffixes that begin with code before those that begin at row."""
        return self.before[code] + self._down(code, row) - self.start[code]

    def find(self, code: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of phrases; code has the last word of each first."""
        lo, hi = np.zeros(len(size), np.int64), np.full(len(size), self.n, np.int64)
        top = 1 << self.levels
        for d in range(code.shape[1]):
            live = np.flatnonzero((size > d) & (lo < hi))
            if not len(live):
                break
            c = code[live, d].astype(np.int64)
            there = c < top
            hi[live[~there]] = lo[live[~there]]
            live, c = live[there], c[there]
            lo[live], hi[live] = self.step(c, lo[live]), self.step(c, hi[live])
        return lo, hi

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Places of the suffixes at rows that lie inside a run of words."""
        out = np.zeros(len(row), np.int64)
        live, steps = np.arange(len(row)), 0
        row = row.copy()
        while len(live):
            at = self.marked[row]
            found = self.marked[row + 1] > at
            out[live[found]] = self.places[at[found]] + steps
            live, row = live[~found], row[~found]
            code, inner = np.zeros(len(row), np.int64), row
            for ones, zeros in zip(self.ones, self.zeros, strict=True):
                one = ones[inner]
                bit = ones[inner + 1] > one
                code = (code << 1) | bit
                inner = np.where(bit, zeros + one, inner - one)
            row = self.before[code] + inner - self.start[code]
            steps += 1
        return out


def _shards(docs: list[bytes], vocab: dict[bytes, int]):
    """(documents, word counts, codes) of runs of documents of about SHARD words."""
    sizes, codes, total = [], [], 0
    get = vocab.get
    for t in docs:
        w = words(t)
        codes.append(np.fromiter((get(x, 0) for x in w), np.int32, len(w)))
        sizes.append(len(w))
        total += len(w)
        if total >= SHARD:
            yield sizes, codes
            sizes, codes, total = [], [], 0
    if sizes:
        yield sizes, codes


def search(sizes: list[int], codes: list[np.ndarray], phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word, length, phrase) of every occurrence in a shard."""
    starts = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64) + 1)])
    flat = np.zeros(starts[-1], np.int64)
    for at, c in zip(starts, codes, strict=False):
        flat[at : at + len(c)] = c
    keep = flat > 0
    keep[1:] |= keep[:-1]  # one separator behind each run
    place = np.flatnonzero(keep)
    none = np.zeros(0, np.int64)
    if not len(place) or not len(phrases.size):
        return none, none, none, none
    sym = flat[place]
    index = FMIndex(sym)
    lo, hi = index.find(phrases.code, phrases.size)
    n = hi - lo
    which = np.repeat(np.arange(len(n)), n)
    rows = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + lo[which]
    at = place[index.locate(rows)]
    doc = np.searchsorted(starts, at, "right") - 1
    return doc, at - starts[doc], phrases.size[which], which


def _merged(doc: np.ndarray, first: np.ndarray, size: np.ndarray, n_docs: int) -> list[list[dict]]:
    """Spans [first, end) of words by document, merged where they overlap or touch."""
    out: list[list[dict]] = [[] for _ in range(n_docs)]
    for k in np.lexsort((first, doc)):
        spans, a, b = out[doc[k]], int(first[k]), int(first[k] + size[k])
        if spans and a <= spans[-1]["end"]:
            spans[-1]["end"] = max(spans[-1]["end"], b)
        else:
            spans.append({"first": a, "end": b})
    return out


HITS = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
SPANS = "spans array<struct<first:long,end:long>>"


def _digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def _scan(phrases: Phrases):
    """Batches of (id, text) to one row a document: id, n_words, spans, items."""

    def run(batches):
        for b in batches:
            n_words, spans, items, done = [], [], [], 0
            for sizes, codes in _shards(texts(b.column(1)), phrases.vocab):
                doc, first, size, which = search(sizes, codes, phrases)
                n_words += sizes
                spans += _merged(doc, first, size, len(sizes))
                mine: list[list[str]] = [[] for _ in sizes]
                pairs = np.unique(doc * len(phrases.size) + which) if len(doc) else doc
                d, p = np.divmod(pairs, max(1, len(phrases.size)))
                n = phrases.at[p + 1] - phrases.at[p]
                own = phrases.owner[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(phrases.at[p], n)]
                for k in np.unique(np.repeat(d, n) * len(phrases.items) + own) if len(own) else ():
                    mine[k // len(phrases.items)].append(phrases.items[k % len(phrases.items)])
                items += [sorted(set(x)) for x in mine]
                done += len(sizes)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array(n_words, pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))),
                    pa.array(items, pa.list_(pa.string())),
                ],
                ["id", "n_words", "spans", "items"],
            )

    return run


def _items(benchmark: DataFrame) -> tuple[DataFrame, int]:
    """Items (i, t) and the number of blocks for them: an item counts by its words, and as one at least."""
    bench = benchmark.select(F.col("item_id").cast("string").alias("i"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    words_ = bench.agg(F.sum(F.greatest(F.regexp_count(F.lower("t"), F.lit(_WORD)), F.lit(1)))).first()[0]
    return bench, max(1, math.ceil((words_ or 0) / PHRASE_WORDS))


def contamination(
    docs: DataFrame, benchmark: DataFrame, spark: SparkSession, *, key: str = "doc_id", window: int = WINDOW
) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans, items.

    spans are the merged runs of hit words (word numbers from 0, end exclusive), items the sorted ids of the benchmark
    items with a window in the document. Null or empty texts have no words and no hits; items without words have no
    windows; an empty benchmark hits nothing; rows with equal ids are judged row by row (with several benchmark blocks,
    rows that are equal in id and text are one row each, numbered); other columns are not read.
    """
    kind = docs.schema[key].dataType.simpleString()
    bench, blocks = _items(benchmark)
    source = docs.select(F.col(key).alias("id"), F.col("text").cast("string").alias("t"))
    schema = f"id {kind}, n_words long, {SPANS}, items array<string>"

    def block(k: int) -> DataFrame:
        own = bench if blocks == 1 else bench.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k)
        phrases = Phrases([(r["i"], r["t"].encode("utf-8", "surrogatepass")) for r in own.toLocalIterator()], window)
        shared = Shared(spark, phrases)

        def run(batches):
            yield from _scan(shared.value)(batches)

        return run

    if blocks == 1:
        found = source.mapInArrow(block(0), schema)
    else:
        found = _in_blocks(source, [block(k) for k in range(blocks)], kind)
    hit = "aggregate(spans, 0L, (s, x) -> s + x.end - x.first)"
    sha = "sha2(array_join(array_sort(items), ','), 256)"
    return found.selectExpr(
        f"id as {key}", "n_words", f"{hit} as n_hit", "cast(size(items) as long) as n_items", f"{sha} as items_sha256",
        f"({hit}) > 0 and 20 * ({hit}) >= n_words as contaminated", "spans", "items",
    )


def _in_blocks(source: DataFrame, runs: list, kind: str) -> DataFrame:
    """Each block of phrases scans all documents; spans and items of a document meet by its number."""
    numbered = source.select(F.struct(F.col("id"), F.xxhash64("t").alias("h"), F.length("t").alias("n")).alias("id"), "t")
    whole = f"id struct<id:{kind},h:long,n:int>, n_words long, {SPANS}, items array<string>"
    parts = None
    for run in runs:
        part = numbered.mapInArrow(run, whole)
        parts = part if parts is None else parts.unionAll(part)
    merged = parts.groupBy("id").agg(
        F.first("n_words").alias("n_words"),
        (F.count("*") / len(runs)).cast("int").alias("copies"),
        F.array_sort(F.flatten(F.collect_set("spans"))).alias("s"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    join = """aggregate(s, cast(array() as array<struct<first:long,end:long>>), (o, x) ->
        case when size(o) > 0 and x.first <= element_at(o, -1).end
             then concat(slice(o, 1, size(o) - 1), array(named_struct('first', element_at(o, -1).first,
                         'end', greatest(element_at(o, -1).end, x.end))))
             else concat(o, array(x)) end)"""
    return merged.selectExpr("id.id as id", "n_words", f"{join} as spans", "items", "explode(sequence(1, copies)) as copy").drop("copy")


def decontaminate(docs: DataFrame, benchmark: DataFrame, spark: SparkSession, *, window: int = WINDOW) -> DataFrame:
    """The rows of docs that the contamination rule doesn't reject, with their columns.

    Each row is judged by itself, whatever its id and however large the benchmark; null, empty and wordless texts stay. An
    empty benchmark rejects nothing, an empty table gives no rows. The scan passes whole rows through, so documents are
    neither joined nor shuffled; with several benchmark blocks, the rows to reject are told apart by id, text hash and
    length.
    """
    items, blocks = _items(benchmark)
    if blocks > 1:
        text = F.col("text").cast("string")
        own = (docs["doc_id"], F.xxhash64(text), F.length(text))
        row = F.struct(*(c.alias(k) for k, c in zip(("bad_id", "bad_hash", "bad_length"), own, strict=True)))
        bad = contamination(docs.select(row.alias("row"), "text"), benchmark, spark, key="row", window=window)
        bad = bad.where("contaminated").select("row.*").distinct()
        on = [c.eqNullSafe(bad[k]) for k, c in zip(("bad_id", "bad_hash", "bad_length"), own, strict=True)]
        return docs.join(bad, on, "left_anti")
    bench = [(r["i"], r["t"].encode("utf-8", "surrogatepass")) for r in items.toLocalIterator()]
    shared = Shared(spark, Phrases(bench, window))
    text_at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            keep, phrases = [], shared.value
            for sizes, codes in _shards(texts(b.column(text_at)), phrases.vocab):
                doc, first, size, _ = search(sizes, codes, phrases)
                for n, spans in zip(sizes, _merged(doc, first, size, len(sizes)), strict=True):
                    hit = sum(s["end"] - s["first"] for s in spans)
                    keep.append(not (hit > 0 and 20 * hit >= n))
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
