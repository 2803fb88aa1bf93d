"""SimHash near-duplicates by multi-index hashing.

Fingerprints over word shingles are reduced to distinct values first, so any number of exact copies is one entry. Each
fingerprint is cut into segments. A small Hamming ball (one bit) is enumerated around each segment and looked up in
that segment's table: of two values that differ in one bit only the one with the bit clear asks, which halves the
questions. Candidates are verified on all bits. Two schemes:

  EXACT    64 bits of 4-word shingles, repeats included, linked at 4 or fewer bits. Three segments: two fingerprints at
           distance 4 agree in some segment up to one bit, so every link is found.
  SIMILAR  448 bits of the set of 5-word shingles, for a similarity (Jaccard) of 0.8 or more. Sets at 0.8 have a cosine
           of 8/9 at least, so each bit differs with a probability of 0.1515 at most: 67.9 bits of 448, with a deviation
           of 7.6. Links are at 80 or fewer bits. A segment of 20 bits agrees up to one bit with a probability of 0.171,
           one of 21 segments with 0.98; at a similarity of 0.9 it is over 0.999. The first 64 bits screen candidates
           before whole fingerprints are fetched (20 or fewer may differ: lost are 4 in 10,000 at a similarity of 0.8).
           Many pairs at 0.7 to 0.8 are as near, so what fingerprints join is only a candidate: documents are linked if
           the sets of hashes of their shingles have that similarity indeed.

Groups of near copies would give all their pairs. So SIMILAR first compares the residents of each key with the least of
them only, which is linear, and joins what links; pairs are then asked for only between what is not joined yet.

A table key with many more fingerprints than chance gives (over KEY_CAP and four times the mean) is not joined: those who
live there and those who ask are cut into blocks of about BLOCK, each pair of blocks is one group, and a group returns a
spanning set of links instead of pairs. Of two neighbouring keys, one of them such, the residents of the smaller one ask,
so a crowd is met where it lives and asks in no key of a few. Keys whose entries are all joined already are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from facetwise.llm.common import Scratch, texts
from facetwise.llm.components import components, to_own
from facetwise.llm.similarity import proved


@dataclass(frozen=True)
class Scheme:
    """How texts become fingerprints, and which fingerprints link."""

    words: int  # of 64 bits
    segments: tuple[tuple[int, int, int], ...]  # word, first bit, width
    radius: int
    screen: int  # bits of the first word in which candidates may differ
    shingle: int
    as_set: bool
    seed: int = 42
    similarity: tuple[int, int] | None = None  # what links must have, as a fraction; None: the radius decides


EXACT = Scheme(1, ((0, 0, 21), (0, 21, 21), (0, 42, 22)), 4, 4, 4, False)
SIMILAR = Scheme(7, tuple((w, 20 * k, 20) for w in range(7) for k in range(3)), 80, 20, 5, True, similarity=(4, 5))
KEY_CAP = 8
BLOCK = 2048
#: Hot keys are broadcast up to so many (16 bytes each); beyond, they are joined by shuffle.
HOT_BROADCAST = 500_000


def _spread(h: np.ndarray, words: int) -> np.ndarray:
    """h and words - 1 further hashes of it, by the mixing function of splitmix64."""
    out = np.empty((len(h), words), np.uint64)
    out[:, 0] = h
    for k in range(1, words):
        z = h + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[:, k] = z ^ (z >> np.uint64(31))
    return out


def _hashes(text: bytes, scheme: Scheme) -> np.ndarray:
    """The hashes of a text's shingles; the whole text where it has fewer words, nothing where it has none."""
    w, n = text.lower().split(), scheme.shingle
    grams = [b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or ([b" ".join(w)] if w else [])
    if scheme.as_set:
        grams = set(grams)
    return np.fromiter((xxhash.xxh64_intdigest(g, scheme.seed) for g in grams), np.uint64, len(grams))


def fingerprint(text: bytes, scheme: Scheme = EXACT) -> np.ndarray:
    """The SimHash of a text as 64-bit words: a bit is set if it is in over half of the shingles' hashes. No words: zeros."""
    h = _hashes(text, scheme)
    if not len(h):
        return np.zeros(scheme.words, np.uint64)
    ones = np.zeros(64 * scheme.words, np.int64)
    for at in range(0, len(h), 16384):
        bits = np.unpackbits(_spread(h[at : at + 16384], scheme.words).view(np.uint8).reshape(-1, 8 * scheme.words), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int32)
    return np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)


def _prints(column, scheme: Scheme) -> pa.Array:
    """Fingerprints of a text column as lists of signed longs."""
    rows = [fingerprint(t, scheme) for t in texts(column)]
    flat = np.concatenate(rows).view(np.int64) if rows else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * scheme.words, pa.array(flat))


def fingerprints(docs: DataFrame, scheme: Scheme = EXACT, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp), fp being the fingerprint as an array of signed longs; with h, a hash of the text, if links are to be proved."""
    more = ["h"] if scheme.similarity else []

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), _prints(b.column(1), scheme), *b.columns[2:]], ["id", "fp", *more])

    kind = docs.schema[key].dataType.simpleString()
    return _plain(docs, key, text).select("id", "t", *more).mapInArrow(run, f"id {kind}, fp array<long>" + "".join(f", {c} long" for c in more))


def _plain(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, t, h): a row's text and its hash."""
    return docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("t")).withColumn("h", F.xxhash64("t"))


def _proved(docs: DataFrame, found: DataFrame, n: int, scheme: Scheme, scratch: Scratch) -> DataFrame:
    """found(v, least, h, root) as (v, root), root being the same for what proved links join. One text a fingerprint is read."""
    sizes = found.groupBy("root").agg(F.count("*").alias("rows_of")).where("rows_of > 1")
    asked = to_own(found, sizes, "root", n, scratch).select("v", "root", "least", F.col("h").alias("own"))
    plain = _plain(docs)
    asked = plain.join(asked.hint("merge"), plain["id"].eqNullSafe(asked["least"]) & (plain["h"] == asked["own"]))

    def run(batches):
        for b in batches:
            sets = [np.unique(_hashes(t, scheme)) for t in texts(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["v", "root", "n", "s"])

    sets = asked.select("v", "root", "t").mapInArrow(run, "v long, root long, n long, s binary")
    links = proved(scratch.cut(sets.where("n > 0").dropDuplicates(["v"])), n, scheme.similarity, scratch).withColumnRenamed("root", "own")
    return scratch.cut(found.join(links.hint("merge"), found["v"] == links["node"], "left").select("v", F.coalesce("own", "v").alias("root")))


def _distances(f: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Bits in which rows of f differ from p (a row, or rows with an axis of their own)."""
    return sum(np.bitwise_count(f[..., w] ^ p[..., w]).astype(np.int16) for w in range(f.shape[-1]))


def _labels(f: np.ndarray, radius: int) -> np.ndarray:
    """For each row of f a row of its component, by links within radius. Rows near a pivot are one group at once, so that
    only rows of different groups are compared in full."""
    n = len(f)
    label = np.full(n, -1)
    for p in range(n):
        if label[p] < 0:
            label[(label < 0) & (_distances(f, f[p]) <= radius)] = p
    largest = np.bincount(label).argmax()
    rest = np.flatnonzero(label != largest)
    left, right = [], []
    for at in range(0, len(rest), 256):
        part = rest[at : at + 256]
        i, j = np.nonzero(_distances(f[part][:, None], f[None]) <= radius)
        i, j = label[part[i]], label[j]
        left.append(i[i != j])
        right.append(j[i != j])
    own = np.arange(n)
    i, j = (np.concatenate(x) if x else np.zeros(0, int) for x in (left, right))
    while True:
        new = own.copy()
        np.minimum.at(new, i, own[j])
        np.minimum.at(new, j, own[i])
        new = new[new]
        if (new == own).all():
            return own[label]
        own = new


def _keys(scheme: Scheme) -> str:
    """SQL for the table keys of a fingerprint's segments: segment number and value in one long."""
    parts = [f"(shiftrightunsigned(fp[{word}], {first}) & {(1 << width) - 1}L | {s << 40}L)" for s, (word, first, width) in enumerate(scheme.segments)]
    return f"array({', '.join(parts)})"


def _bits(scheme: Scheme) -> str:
    """SQL for the numbers of the bits of key k."""
    return f"sequence(0, array({', '.join(str(w) for _, _, w in scheme.segments)})[cast(shiftright(k, 40) as int)] - 1)"


def _ball(scheme: Scheme) -> str:
    """SQL for key k itself and every key with one of its clear bits set."""
    return f"concat(array(k), transform(filter({_bits(scheme)}, i -> (shiftright(k, i) & 1) = 0), i -> k | shiftleft(1L, i)))"


def _verified(pairs: DataFrame, entries: DataFrame, scheme: Scheme) -> DataFrame:
    """Of pairs(a, b) those within the radius."""
    for x in "ab":
        pairs = pairs.join(entries.select(F.col("v").alias(x), F.col("fp").alias("f" + x)).hint("merge"), x)
    far = sum((F.bit_count(F.col("fa")[w].bitwiseXOR(F.col("fb")[w])) for w in range(scheme.words)), F.lit(0))
    return pairs.where(far <= scheme.radius).drop("fa", "fb")


def _pivot_links(entries: DataFrame, scratch: Scratch, scheme: Scheme) -> DataFrame:
    """(a, b): links between the residents of every key and the least of them."""
    home = entries.select(F.explode(F.expr(_keys(scheme))).alias("k"), "v", F.col("fp")[0].alias("c"))
    least = home.groupBy("k").agg(F.min(F.struct("v", "c")).alias("p"), F.count("*").alias("rows_of")).where("rows_of > 1")
    met = to_own(home, least, "k", entries.count() * len(scheme.segments), scratch)
    screen = F.bit_count(F.col("c").bitwiseXOR(F.col("p.c"))) <= scheme.screen
    return _verified(met.where((F.col("v") != F.col("p.v")) & screen).select(F.col("v").alias("a"), F.col("p.v").alias("b")).distinct(), entries, scheme)


def links(entries: DataFrame, scratch: Scratch, scheme: Scheme = EXACT) -> DataFrame:
    """(a, b): links between entries(v, g, fp), which have different fingerprints, that join all that the scheme finds.

    v is a long of its own for each fingerprint; entries with one g are joined already. a and b are values of g.
    """
    home = entries.select(F.explode(F.expr(_keys(scheme))).alias("k"), "v", "g", F.col("fp")[0].alias("c"))
    counts = home.groupBy("k").agg(F.count("*").alias("n"), F.min("g").alias("h0"), F.max("g").alias("h1"))
    cap = max(KEY_CAP, 4 * entries.count() >> min(w for _, _, w in scheme.segments))
    full = scratch.cut(counts.where(F.col("n") > cap))
    few = full.count() <= HOT_BROADCAST
    sent = F.broadcast if few else lambda d: d.hint("merge")
    near = F.bit_count(F.col("c").bitwiseXOR(F.col("c2"))) <= scheme.screen
    home_cold = home.join(sent(full.select("k")), "k", "left_anti")
    lives = home_cold.select("k", *(F.col(x).alias(x + "2") for x in "vgc"))
    cold = home_cold.withColumn("k", F.explode(F.expr(_ball(scheme)))).join(lives.hint("merge"), "k").where((F.col("g") != F.col("g2")) & near)
    cold = cold.select(*(F.when(F.col("v") < F.col("v2"), F.struct(x, x + "2")).otherwise(F.struct(F.col(x + "2").alias(x), F.col(x).alias(x + "2"))).alias(x) for x in "vg"))
    cold = cold.select("v.v", "v.v2", "g.g", "g.g2")
    if scheme.words > 1:
        pairs = cold.select(F.col("v").alias("a"), F.col("v2").alias("b"), "g", "g2").distinct()
        cold = _verified(pairs, entries, scheme)
    cold = cold.select(F.col("g").alias("a"), F.col("g2").alias("b"))
    # Pairs of neighbouring keys, one of them full: the residents of the one with fewer ask in the other (the host).
    beside = full.select("k", F.col("n").alias("n1"), F.explode(F.expr(f"transform({_bits(scheme)}, i -> k ^ shiftleft(1L, i))")).alias("near")).join(counts.select(F.col("k").alias("near"), "n").hint("merge"), "near")
    first = F.expr("n < n1 or n = n1 and near < k")
    beside = beside.select(F.when(first, F.col("k")).otherwise(F.col("near")).alias("host"), F.when(first, F.col("near")).otherwise(F.col("k")).alias("k")).distinct()
    hosts = full.select(F.col("k").alias("host"), "n", "h0", "h1")
    ways = beside.unionAll(full.where("h0 <> h1").select(F.col("k").alias("host"), "k")).join(sent(hosts), "host")
    ways = scratch.cut(ways)
    ways = F.broadcast(ways) if ways.count() <= HOT_BROADCAST else ways.hint("merge")
    # Who is joined with all residents of a key has nothing to ask there; of two groups in one key the one that is not h0
    # asks; who lives where nobody asks is not met.
    own = "if(k = host, g <> h0, h0 <> h1 or g <> h0)"
    asks = home.select("k", "v", "g").join(ways, "k").where(own)
    asks = scratch.cut(asks.select(F.col("host").alias("k"), "v"))
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / F.lit(BLOCK))).cast("int")
    sizes = asks.groupBy("k").agg(blocks(F.count("*")).alias("na"))
    sizes = scratch.cut(sizes.join(full.hint("merge"), "k").select("k", "na", blocks(F.col("n")).alias("nh")))
    crowd = asks.join(sent(sizes), "k").withColumn("asks", F.lit(True)).unionByName(home.select("k", "v").join(sent(sizes), "k").withColumn("asks", F.lit(False)))
    part = "cast(pmod(xxhash64(v), {}) as int)"
    dealt = crowd.select("k", "v", F.expr(f"if(asks, sequence(0, nh - 1), array({part.format('nh')}))").alias("i"), F.expr(f"if(asks, array({part.format('na')}), sequence(0, na - 1))").alias("j"))
    dealt = dealt.join(entries.hint("merge"), "v").select("k", "v", "g", "fp", F.explode("i").alias("i"), "j").select("k", "v", "g", "fp", "i", F.explode("j").alias("j"))

    def span(v: np.ndarray, g: np.ndarray, f: np.ndarray) -> np.ndarray:
        """Spanning links of one group: two rows, a and b."""
        _, at = np.unique(v, return_index=True)
        a = g[at]
        if (a == a[0]).all():
            return np.zeros((2, 0), np.int64)
        b = a[_labels(f[at], scheme.radius)]
        return np.unique(np.stack([a[a != b], b[a != b]]), axis=1)

    def run(batches):
        """Rows sorted by group; a group may go over several batches."""
        held = None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in ("k", "i", "j")])
            rows = (key, batch.column(3).to_numpy(), batch.column(4).to_numpy(), batch.column(5).flatten().to_numpy().view(np.uint64).reshape(-1, scheme.words))
            held = rows if held is None else tuple(np.concatenate([x, y], axis=-1 if n == 0 else 0) for n, (x, y) in enumerate(zip(held, rows, strict=True)))
            cut = np.flatnonzero((held[0][:, 1:] != held[0][:, :-1]).any(0)) + 1
            if len(cut):
                yield from flush(held, np.concatenate([[0], cut]))
                held = tuple(x[..., cut[-1] :] if n == 0 else x[cut[-1] :] for n, x in enumerate(held))
        if held is not None and held[0].shape[1]:
            yield from flush(held, np.array([0, held[0].shape[1]]))

    def flush(held, cut):
        _, v, g, f = held
        found = [span(v[a:z], g[a:z], f[a:z]) for a, z in zip(cut[:-1], cut[1:], strict=True)]
        a, b = np.concatenate(found, axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    group = ["k", "i", "j"]
    dealt = dealt.select(*group, "v", "g", "fp").repartition(*group).sortWithinPartitions(*group)
    return cold.unionAll(dealt.mapInArrow(run, "a long, b long"))


def _joined(entries: DataFrame, scratch: Scratch, scheme: Scheme) -> DataFrame:
    """entries(v, fp) as (v, g, fp): g is the same for all that is joined by links to the least residents of keys."""
    if scheme.words == 1:
        return entries.select("v", F.col("v").alias("g"), "fp")
    first = components(_pivot_links(entries, scratch, scheme), scratch)
    return scratch.cut(entries.join(first.hint("merge"), entries["v"] == first["node"], "left").select("v", F.coalesce("root", "v").alias("g"), "fp"))


def near_duplicates(docs: DataFrame, spark: SparkSession, scheme: Scheme = EXACT, *, scratch: Scratch | None = None) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, fp (array of signed longs), component_id, root.

    component_id is the least doc_id reachable over links; root (a long) is the same for all rows of a component, also
    where doc_ids repeat or are null. Null or empty texts have a fingerprint of zeros and link like any other; rows with
    equal texts always share a component; repeated doc_ids are one vertex per fingerprint; a null doc_id takes part but
    is never a component_id unless nothing else is there. Texts of any length are read whole. An empty table gives no
    rows; further columns are not read.
    """
    scratch = scratch or Scratch(spark)
    prints = scratch.cut(fingerprints(docs, scheme))
    texts_of = [F.coalesce(F.min_by("h", "id"), F.min("h")).alias("h")] if scheme.similarity else []  # a text of the least id
    least = prints.groupBy("fp").agg(F.min("id").alias("least"), *texts_of)
    least = scratch.cut(least.withColumn("v", F.monotonically_increasing_id()))
    n = least.count()
    entries = _joined(least.select("v", "fp"), scratch, scheme)
    comp = components(links(entries, scratch, scheme), scratch)
    rooted = entries.join(comp.hint("merge"), entries["g"] == comp["node"], "left").select("v", F.coalesce("root", "g").alias("root"))
    if scheme.similarity:
        rooted = _proved(docs, scratch.cut(least.drop("fp").join(rooted.hint("merge"), "v")), n, scheme, scratch)
    rooted = scratch.cut(least.join(rooted.hint("merge"), "v").select("fp", "least", "root"))
    low = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("rows_of"))
    of = to_own(rooted, low, "root", n, scratch).select("fp", "component_id", "root")
    return prints.join(of.hint("merge"), "fp").select(F.col("id").alias("doc_id"), "fp", "component_id", "root")


def keep_one(docs: DataFrame, spark: SparkSession, scheme: Scheme = SIMILAR, *, scratch: Scratch | None = None) -> DataFrame:
    """One row of docs for each component, with its columns: the row with the least doc_id (null last).

    Of rows with that doc_id in one component the one with the least fingerprint stays, then the one with the least
    text, then the least digest of the row. All rows without words are one component. An empty table gives no rows.
    """
    scratch = scratch or Scratch(spark)
    found = near_duplicates(docs, spark, scheme, scratch=scratch).select("doc_id", "fp", "root")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")).alias("w")
    winner = found.groupBy("root").agg(best).select(F.col("w.doc_id").alias("win"), F.col("w.fp").alias("win_fp"))
    rows = found.groupBy(F.col("doc_id").alias("own")).agg(F.count("*").alias("n_rows"))
    winner = scratch.cut(winner.join(rows.hint("merge"), F.col("win").eqNullSafe(F.col("own"))).drop("own"))
    # The winners grow with the documents: the join is the same at every size, and never a broadcast.
    single = winner.where("n_rows = 1").select("win").hint("merge")
    one = docs.join(single, docs["doc_id"].eqNullSafe(single["win"]), "left_semi")
    # Ids of several rows are told apart by fingerprint and then by text.
    many = winner.where("n_rows > 1")
    ids = many.select("win").distinct()
    several = docs.join(ids, docs["doc_id"].eqNullSafe(ids["win"]), "left_semi")
    whole = several.select(F.struct(*(several[f"`{c}`"] for c in docs.columns)).alias("row"), several["doc_id"].alias("id"), several["text"].cast("string").alias("t"))
    schema = StructType([*whole.schema.fields, StructField("own_fp", ArrayType(LongType()))])

    def add(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, _prints(b.column(2), scheme)], [*b.schema.names, "own_fp"])

    whole = whole.mapInArrow(add, schema)
    mine = whole.join(many, F.col("id").eqNullSafe(F.col("win")) & (F.col("own_fp") == F.col("win_fp")))
    order = F.struct(F.coalesce("t", F.lit("")), F.md5(F.to_json("row")))
    mine = mine.groupBy("id", "own_fp").agg(F.min_by("row", order).alias("row"))
    return one.unionAll(mine.select("row.*"))
