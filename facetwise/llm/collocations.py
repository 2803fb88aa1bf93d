"""Phrase collocations by hierarchical pair naming.

Texts are cut into shards of a bounded number of words, each a sequence of codes of its own dictionary. A level names
phrases of one word more: each shard counts its different pairs of adjacent frequent phrases of the level below (numpy,
inside the task), only these counts are shuffled, and a pair that is frequent over all shards gets one name. Names are
joined back to the shards that have the pair and replace it in the sequence. The name of a pair keeps its two parts, so
every prefix and suffix of a phrase, and every phrase that contains it, is found by pointers and never by its words.

A name is the number of the first entry (shard, code) that has the pair: it depends on nothing but the written shards, so
a task that runs again gives the same names. A key has one row a shard at most, whatever its frequency.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facetwise.llm.common import Scratch, texts

#: Words of a shard, and bytes of text that are cut into words at a time.
SHARD_WORDS, CHUNK = 2_000_000, 1 << 20
#: Bits of a name for the code inside a shard, and bits of a shard's number for its place in its partition.
CODE_BITS, PLACE_BITS = 24, 18
#: Salted groups of a language that are ranked before the language is.
SALTS = 64
#: A-Z become a-z, the ends of pieces become a byte that UTF-8 never has.
_END = 0xFF
_TABLE = bytes(c + 32 if 65 <= c <= 90 else _END if 10 <= c <= 13 or c in b".,;:!?" else c for c in range(256))
_GAP = re.compile(b"[ \t\xff]")
#: Rows of a shard: one with its sequence (codes), and one for each of its entries, the different words or pairs: what it is,
#: and its code and number in one (code << CODE_BITS | n), which keeps rows of the shuffle small. Flat, so that no reader
#: holds a whole shard of entries.
_WORDS = pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("codes", pa.binary()), ("ahead", pa.int32()), ("own", pa.int64()), ("word", pa.binary()), ("entry", pa.int64())])
_PAIRS = pa.schema([("shard", pa.int64()), ("codes", pa.binary()), ("ahead", pa.int32()), ("l", pa.int64()), ("r", pa.int64()), ("entry", pa.int64())])
#: Entries of pairs are shuffled by so many slices of their keys, one after the other, so that disk holds one slice's shuffle.
SLICES = 4
#: Rows of an Arrow batch.
ROWS = 65_536


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _entries(n: np.ndarray) -> np.ndarray:
    if len(n) >> CODE_BITS or int(n.max(initial=0)) >> CODE_BITS:
        raise ValueError("a shard has too many words")
    return np.arange(len(n), dtype=np.int64) << CODE_BITS | n.astype(np.int64)


def _flat(schema: pa.Schema, head: dict, entries: dict) -> pa.Table:
    """One row with the values of head, then one for each entry; columns that neither names are null."""
    n = len(entries["entry"])
    first = pa.Table.from_arrays([pa.array([head.get(f.name)], f.type) for f in schema], schema=schema)
    same = {c: pa.repeat(pa.scalar(head[c], schema.field(c).type), n) for c in ("shard", "lang") if c in head}
    columns = [same[f.name] if f.name in same else pa.array(entries[f.name], f.type) if f.name in entries else pa.nulls(n, f.type) for f in schema]
    return pa.concat_tables([first, pa.Table.from_arrays(columns, schema=schema)])


def _pack(codes: np.ndarray) -> bytes:
    return len(codes).to_bytes(8, "little") + pa.compress(codes.astype(np.int32), "zstd", asbytes=True)


def _unpack(packed: bytes) -> np.ndarray:
    n = int.from_bytes(packed[:8], "little")
    return np.frombuffer(pa.decompress(packed[8:], 4 * n, "zstd", asbytes=True), np.int32)


def _tokens(text: bytes):
    """Lists of words of a text and ends of pieces, for CHUNK bytes or up to the next gap at a time."""
    text, at = text.translate(_TABLE), 0
    while at < len(text):
        gap = _GAP.search(text, at + CHUNK)
        end = gap.end() if gap else len(text)
        # Tabs and blanks are all that split() can find: the other white space ended a piece.
        yield text[at:end].replace(b"\xff", b" \xff ").split()
        at = end


class _Buffer:
    """The shard of a language that is being filled; `ahead` words at its begin belong to the shard before."""

    def __init__(self, before: list[bytes], keep: int):
        self.keep = keep
        self.ids: dict[bytes, int] = {}
        self.parts: list[np.ndarray] = []
        self.size = 0
        self.ahead = len(before)
        self.last: list[bytes] = []
        if before:
            self.add(before)

    def add(self, words: list[bytes]) -> None:
        found = pa.array(words, pa.binary()).dictionary_encode()
        code = np.array([-1 if w == b"\xff" else self.ids.setdefault(w, len(self.ids)) for w in found.dictionary.to_pylist()], np.int32)
        self.parts.append(code[found.indices.to_numpy(zero_copy_only=False)])
        self.size += len(words)
        self.last = [*self.last, *words[-self.keep :]][-self.keep :] if self.keep else []

    def table(self, shard: int, lang) -> pa.Table:
        codes = np.concatenate(self.parts)
        own = codes[self.ahead :]
        own = own[own >= 0]
        head = {"shard": shard, "lang": lang, "codes": _pack(codes), "ahead": self.ahead, "own": len(own)}
        n = np.bincount(own, minlength=len(self.ids))
        return _flat(_WORDS, head, {"word": list(self.ids), "entry": _entries(n)})


def shards(docs: DataFrame, longest: int, size: int = SHARD_WORDS) -> DataFrame:
    """Sequences of word codes by partition and language, with their words and the number of each."""

    def run(batches):
        first, place, held = TaskContext.get().partitionId() << PLACE_BITS, 0, {}

        def full():
            nonlocal place
            for lang, buffer in held.items():
                if buffer.size == buffer.ahead:
                    continue
                if place >> PLACE_BITS:
                    raise ValueError("a partition has too many shards: read the texts in more partitions")
                yield from buffer.table(first + place, lang).to_batches(ROWS)
                place += 1
                held[lang] = _Buffer(buffer.last, longest - 1)

        for b in batches:
            by_lang: dict = {}
            for text, lang in zip(texts(b.column(0)), b.column(1).to_pylist(), strict=True):
                by_lang.setdefault(lang, []).append(text)
            for lang, own in by_lang.items():
                for words in _tokens(b"\n".join([*own, b""])):
                    if not words:
                        continue
                    held.setdefault(lang, _Buffer([], longest - 1)).add(words)
                    if sum(x.size for x in held.values()) >= size:
                        yield from full()
        yield from full()

    return docs.mapInArrow(run, _ddl(_WORDS))


def _renamed(level: int, last: bool):
    """Of one shard and the names of its frequent phrases of `level` words: the pairs of adjacent ones, counted, as codes."""

    def run(sequence: pa.Table, names: pa.Table) -> pa.Table:
        if not sequence.num_rows:
            return _PAIRS.empty_table()
        shard, packed, ahead = (sequence.column(c)[0].as_py() for c in ("shard", "codes", "ahead"))
        codes, code, name = _unpack(packed), names.column("code").to_numpy(), names.column("name").to_numpy()
        known = np.full(max(int(codes.max(initial=-1)), int(code.max(initial=-1))) + 2, -1, np.int64)  # the last is for -1
        known[code] = name
        left, right = codes[:-1].astype(np.int64), codes[1:].astype(np.int64)
        ok = (known[left] >= 0) & (known[right] >= 0)
        keys, inverse = np.unique(left[ok] << 32 | right[ok], return_inverse=True)
        # A phrase counts where it ends: its end is at its begin and `level` further, past the words of the shard before.
        n = np.bincount(inverse[np.flatnonzero(ok) + level >= ahead], minlength=len(keys))
        out = np.full(len(ok), -1, np.int32)
        out[ok] = inverse
        head = {"shard": shard, "codes": b"" if last else _pack(out), "ahead": ahead}
        return _flat(_PAIRS, head, {"l": known[keys >> 32], "r": known[keys & 0xFFFFFFFF], "entry": _entries(n)})

    return run


def _named(entries: DataFrame, key: list[str], least: int) -> DataFrame:
    """(shard, code, *key, f, name, is_first) of the entries(*key, entry, shard), one a shard and key, whose key reaches
    `least` over all shards."""
    code, n = F.shiftright("entry", CODE_BITS), F.col("entry").bitwiseAND(F.lit((1 << CODE_BITS) - 1))
    place = F.shiftleft("shard", CODE_BITS) + code
    of = Window.partitionBy(*key)
    named = entries.select(*key, "entry", "shard").withColumn("f", F.sum(n).over(of)).withColumn("name", F.min(place).over(of)).where(F.col("f") >= least)
    return named.select("shard", code.cast("int").alias("code"), *key, "f", "name", (F.col("name") == place).alias("is_first"))


def phrases(docs: DataFrame, spark: SparkSession, *, least: int = 30, longest: int = 4, shard_words: int = SHARD_WORDS) -> tuple[list[DataFrame], DataFrame]:
    """Tables of frequent phrases of 1 .. longest words, and (lang, n): all words of a language.

    A phrase has name, lang, phrase, last (its last word), f, l and r (names of its first and last words but one; null
    for words), firsts and lasts (the frequencies of its prefixes and suffixes of 1, 2, .. words). Null texts are empty;
    a null language is `und`; texts of any length are cut into shards that share their border words; repeated rows count
    each; no documents give empty tables; other columns are not read.
    """
    scratch = Scratch(spark)
    rows = docs.select(F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    cut = scratch.cut(shards(rows, longest, shard_words))
    total = scratch.cut(cut.groupBy("lang").agg(F.sum("own").alias("n")))
    named = scratch.cut(_named(cut.where("entry is not null"), ["lang", "word"], least))
    slices = [named]
    none = F.array().cast("array<long>")
    word = F.col("word").cast("string")
    tables = [scratch.cut(named.where("is_first").select("name", "lang", word.alias("phrase"), word.alias("last"), "f", F.lit(None).cast("long").alias("l"), F.lit(None).cast("long").alias("r"), none.alias("firsts"), none.alias("lasts")))]
    for level in range(1, longest):
        codes = scratch.cut(cut.where("codes is not null").select("shard", "codes", "ahead"))  # entries are counted: they can go
        scratch.drop(cut)
        sequences = codes.groupBy("shard").cogroup(named.select("shard", "code", "name").groupBy("shard"))
        after = scratch.cut(sequences.applyInArrow(_renamed(level, level + 1 == longest), _ddl(_PAIRS)))
        for table in (codes, *slices):
            scratch.drop(table)
        of = F.pmod(F.xxhash64("l", "r"), F.lit(SLICES))
        slices = [scratch.cut(_named(after.where(F.col("entry").isNotNull() & (of == k)), ["l", "r"], least)) for k in range(SLICES)]
        cut, named = after, reduce(DataFrame.unionAll, slices)
        below = tables[-1]
        left = below.select(F.col("name").alias("l"), "lang", F.col("phrase").alias("begin"), F.col("f").alias("lf"), "firsts")
        right = below.select(F.col("name").alias("r"), F.col("last"), F.col("f").alias("rf"), "lasts")
        out = named.where("is_first").select("name", "f", "l", "r").join(left, "l").join(right, "r")
        grown = F.concat("firsts", F.array("lf")).alias("firsts"), F.concat("lasts", F.array("rf")).alias("lasts")
        tables.append(scratch.cut(out.select("name", "lang", F.concat_ws(" ", "begin", "last").alias("phrase"), "last", "f", "l", "r", *grown)))
    for table in (cut, *slices):
        scratch.drop(table)
    return tables, total


def collocations(docs: DataFrame, spark: SparkSession, *, least: int = 30, longest: int = 4, share: int = 80, top: int = 2000, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `top` collocations of every language.

    Candidates are phrases of 2 .. longest words that occur `least` times (a) inside pieces. The cut with the least
    score floor(2000000 a / (l + r)) counts, of equal ones the earliest. A phrase goes if one with one word more that
    contains it has at least `share` percent of its frequency: longer ones have no more. Ranks are by score and a,
    descending, then by the bytes of the phrase; phrases are different, so no ranks tie. Odd rows: see phrases().
    """
    tables, total = phrases(docs, spark, least=least, longest=longest, shard_words=shard_words)
    parts = []
    for k, own in enumerate(tables[1:], 2):
        cuts = []
        for j in range(1, k):
            first, rest = F.element_at("firsts", j), F.element_at("lasts", k - j)
            score = F.expr(f"cast(f as decimal(20,0)) * cast(2000000 as decimal(7,0)) div (cast(element_at(firsts, {j}) as decimal(20,0)) + cast(element_at(lasts, {k - j}) as decimal(20,0)))")  # past 64 bits
            cuts.append(F.struct(score.alias("score"), F.lit(j).alias("j"), first.alias("l"), rest.alias("r")))
        best = F.array_min(F.array(*cuts))
        own = own.withColumn("best", best)
        if k < longest:
            for side in ("l", "r"):
                longer = tables[k].groupBy(side).agg(F.max("f").alias(f"in_{side}")).withColumnRenamed(side, "name")
                own = own.join(longer, "name", "left")
            held = F.greatest(F.coalesce("in_l", F.lit(0)), F.coalesce("in_r", F.lit(0)))
            own = own.where(F.lit(100).cast("decimal(3,0)") * held.cast("decimal(20,0)") < F.lit(share).cast("decimal(3,0)") * F.col("f").cast("decimal(20,0)"))
        parts.append(own.select("lang", "phrase", F.col("f").alias("a"), "best.l", "best.r", "best.score"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    order = F.desc("score"), F.desc("a"), F.asc("phrase")
    salted = out.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    kept = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
