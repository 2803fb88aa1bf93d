"""The training-data operators against brute force, round trips and held-out accuracy; odd rows of every kind."""

import datetime
import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from facetwise.llm import decontam, embeddings, langid, licenses, mixing, pii, quality, queries, simhash, similarity, tokens, toxicity
from facetwise.llm.common import Scratch, crc32_of, words
from facetwise.llm.components import components

SF = "/root/testdata/sf0.001"
LONG = "word " * 30_000 + "end"
#: Extra columns have names that operators use inside.
ODD = [
    (1, None, "en", "s1", 0, "x"), (2, "", "en", None, 0, "x"), (3, "  \n ", None, "s1", 4, None), (4, "one", "en", "s1", 3, "x"), (5, LONG, "de", "s2", len(LONG), "x"),
    (6, "the same text here twice", "en", "s2", 24, "x"), (6, "the same text here twice", "en", "s2", 24, "x"), (None, "no id but text", "fr", "s2", 14, "x"), (8, "ünï çødé 🙂 “quotes”", "fr", "s3", 20, "x"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, {} string"


def odd(spark, extra="fp"):
    return spark.createDataFrame(ODD, SCHEMA.format(extra))


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def reach(edges, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


# ---- parts ----


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 360)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()}
    want = reach(edges, {x for e in edges for x in e})
    assert got == {n: r for n, r in want.items() if any(n in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark)).count() == 0


def test_words():
    assert words("It's ÉCOLE-42\tЖ_x".encode()) == ["it".encode(), b"s", "École"[:0].encode() + "ÉCOLE".encode().replace(b"COLE", b"cole"), b"42", "Ж".encode(), b"x"]


# ---- 1 ----


def test_token_histogram(spark):
    docs = documents(spark).limit(60).unionByName(odd(spark).drop("fp"))
    encode = tokens.encoding(tokens.ranks(queries.VOCABULARY)).encode_ordinary
    n = sorted(len(encode(r["text"] or "")) for r in docs.collect())
    sums = tokens.suffix_sums(tokens.histogram(docs, spark, path=queries.VOCABULARY)).cache()
    assert {r["n_tokens"]: r["n_docs"] for r in sums.collect()} == Counter(n)
    for r in sums.collect():
        at = r["n_tokens"]
        assert (r["docs_ge"], r["tokens_ge"], r["total_at"]) == (sum(x >= at for x in n), sum(x for x in n if x >= at), sum(min(x, at) for x in n))
    for limit in (0, 1, 100, 777, 10**9):
        assert tokens.truncated_total(sums, limit) == sum(min(x, limit) for x in n)
    assert tokens.quantile(sums, 0.5) == n[math.ceil(len(n) / 2) - 1]
    assert sorted(r["n_tokens"] for r in tokens.lengths(docs, spark, path=queries.VOCABULARY).collect()) == n
    with pytest.raises(FileNotFoundError):
        tokens.ranks("/no/such/file")
    empty = tokens.suffix_sums(tokens.histogram(odd(spark).limit(0), spark, path=queries.VOCABULARY))
    assert empty.count() == 0 and tokens.truncated_total(empty, 5) == 0 and tokens.quantile(empty, 0.5) is None


# ---- 2 ----


def brute_hits(text, items, window=13):
    w, hit, own = words((text or "").encode()), set(), set()
    for i, t in items:
        p = words((t or "").encode())
        for at in range(max(1, len(p) - window + 1) if p else 0):
            q = p[at : at + window]
            for k in range(len(w) - len(q) + 1):
                if w[k : k + len(q)] == q:
                    hit.update(range(k, k + len(q)))
                    own.add(str(i))
    sha = hashlib.sha256(",".join(sorted(own)).encode()).hexdigest()
    return len(w), len(hit), len(own), sha, bool(hit) and 20 * len(hit) >= len(w)


BENCH = [(1, "a b c d e f g h i j k l m n o"), (2, "the same text"), (10, "ONE"), (3, None), (4, "..."), (5, "b c d e f g h i j k l m n"), (6, "word word word word word word word word word word word word word word")]
FIELDS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def test_contamination(spark, monkeypatch):
    rng = random.Random(1)
    made = [(100 + k, " ".join(rng.choices("abcdefghij", k=rng.randrange(40))) + " A,b c d-e f g h i j k l m n o. " * (k % 3 == 0) + " tail" * rng.randrange(300)) for k in range(40)]
    docs = odd(spark).select("doc_id", "text", "fp").unionByName(spark.createDataFrame([(i, t, "y") for i, t in made], "doc_id long, text string, fp string"))
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    want = sorted((str(r["doc_id"]), *brute_hits(r["text"], BENCH)) for r in docs.collect())
    got = lambda: sorted((str(r["doc_id"]), *(r[c] for c in FIELDS)) for r in decontam.contamination(docs, bench, spark).collect())
    assert got() == want
    monkeypatch.setattr(decontam, "PHRASE_WORDS", 8)  # several blocks of phrases
    assert got() == want
    monkeypatch.undo()
    monkeypatch.setattr(decontam, "SHARD", 7)
    assert got() == want
    kept = decontam.decontaminate(docs, bench, spark).collect()
    assert Counter(str(r["doc_id"]) for r in kept) == Counter(x[0] for x in want if not x[5]) and kept[0].asDict().keys() == {"doc_id", "text", "fp"}
    assert decontam.contamination(docs, bench.limit(0), spark).where("n_hit > 0").count() == 0
    assert decontam.contamination(docs.limit(0), bench, spark).count() == 0


def test_decontaminate_judges_rows(spark, monkeypatch):
    """A contaminated row takes no other row of its doc_id along, and null ids are no group, with several blocks too."""
    bad, clean = "see a b c d e f g h i j k l m n o", "nothing of that kind"
    rows = [(1, bad, "x"), (1, clean, "x"), (1, clean, "x"), (None, bad, "y"), (None, clean, "y"), (None, None, "z"), (2, clean, "z"), (3, bad, "z"), (3, bad, "z")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string, row string"), spark.createDataFrame(BENCH, "item_id long, text string")
    got = lambda: Counter(tuple(r) for r in decontam.decontaminate(docs, bench, spark).collect())
    assert got() == Counter(r for r in rows if r[1] != bad)
    monkeypatch.setattr(decontam, "PHRASE_WORDS", 8)
    assert got() == Counter(r for r in rows if r[1] != bad)


def test_fm_index_finds_every_place():
    rng = np.random.default_rng(5)
    for n, v in ((1, 1), (50, 2), (400, 3), (3000, 40)):
        sym = rng.integers(0, v + 1, n)
        sym[-1] = 0
        index = decontam.FMIndex(sym, sample=4)
        for _ in range(30):
            p = rng.integers(1, v + 1, rng.integers(1, 5))
            lo, hi = index.find(p[::-1][None], np.array([len(p)]))
            at = sorted(index.locate(np.arange(lo[0], hi[0])).tolist())
            assert at == [k for k in range(n - len(p) + 1) if (sym[k : k + len(p)] == p).all()]


# ---- 3 ----


def plain_fingerprint(text, shingle=4, words_=1, as_set=False):
    """The fingerprint as one integer, the first word lowest."""
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[k : k + shingle]) for k in range(len(w) - shingle + 1)] or ([b" ".join(w)] if w else [])
    grams = set(grams) if as_set else grams
    ones = [0] * (64 * words_)
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        for word in range(words_):
            z = h if word == 0 else (h + word * 0x9E3779B97F4A7C15) % 2**64
            if word:
                z = (z ^ (z >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
                z = (z ^ (z >> 27)) * 0x94D049BB133111EB % 2**64
                z ^= z >> 31
            for b in range(64):
                ones[64 * word + b] += z >> b & 1
    return sum(1 << b for b, n in enumerate(ones) if 2 * n > len(grams))


def plain_similar(text):
    return plain_fingerprint(text, 5, 7, True)


def similar_links(fps):
    """Pairs that share a segment up to one bit, have 20 or fewer different bits in the first word and 80 or fewer in all."""
    seg = lambda f, w, k: f >> (64 * w + 20 * k) & 0xFFFFF
    for a, b in itertools.combinations(fps, 2):
        x = a ^ b
        if x.bit_count() <= 80 and (x & (2**64 - 1)).bit_count() <= 20 and any(seg(x, w, k).bit_count() <= 1 for w in range(7) for k in range(3)):
            yield a, b


def plain_grams(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[k : k + 5]) for k in range(len(w) - 4)} or ({b" ".join(w)} - {b""})


def proved_groups(of):
    """For texts by fingerprint, a fingerprint of each one's group: similarities of 0.8 or more among what similar_links joins."""
    coarse, grams = reach(similar_links(set(of)), set(of)), {f: plain_grams(t) for f, t in of.items()}
    near = [(a, b) for a, b in itertools.combinations(of, 2) if coarse[a] == coarse[b] and 5 * len(grams[a] & grams[b]) >= 4 * len(grams[a] | grams[b])]
    return reach(near, set(of))


def unsigned(fp):
    return sum((x % 2**64) << (64 * k) for k, x in enumerate(fp))


def test_simhash(spark, monkeypatch):
    docs = odd(spark, "root").select("doc_id", "text", "root").unionByName(documents(spark).limit(80).select("doc_id", "text", F.lit("r").alias("root")))
    rows = docs.collect()
    fps = [plain_fingerprint(r["text"]) for r in rows]
    near = [(a, b) for a in set(fps) for b in set(fps) if a < b and (a ^ b).bit_count() <= 4]
    root = reach(near, set(fps))
    least = {}
    for r, f in zip(rows, fps, strict=True):
        if r["doc_id"] is not None:
            least[root[f]] = min(least.get(root[f], r["doc_id"]), r["doc_id"])
    want = sorted((str(r["doc_id"]), f"{f:016x}", str(least.get(root[f]))) for r, f in zip(rows, fps, strict=True))
    got = simhash.near_duplicates(docs, spark).collect()
    assert sorted((str(r["doc_id"]), f"{unsigned(r['fp']):016x}", str(r["component_id"])) for r in got) == want
    assert simhash.near_duplicates(docs.limit(0), spark).count() == 0


def test_simhash_similar(spark):
    """Near copies of one text, and others: fingerprints, components and the recall at a similarity of 0.8."""
    rng = random.Random(5)
    base = [rng.choices("abcdefghijklmnopqrstuvwxyz", k=200) for _ in range(6)]
    rows = []
    for k in range(120):
        w = list(base[k % 6])
        for at in rng.sample(range(200), rng.randrange(5) if k < 90 else rng.randrange(5, 12)):
            w[at] = f"x{k}"
        rows.append((k, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs, spark, simhash.SIMILAR).collect()}
    fps = {i: plain_similar(t) for i, t in rows}
    assert all(unsigned(got[i]["fp"]) == f for i, f in fps.items())
    root = proved_groups({fps[i]: t for i, t in rows})
    assert len(set(root.values())) > len(set(reach(similar_links(set(root)), set(root)).values()))  # some candidates are no links
    assert [got[i]["component_id"] for i in fps] == [min(j for j in fps if root[fps[j]] == root[fps[i]]) for i in fps]
    grams = {i: {tuple(t.split()[k : k + 5]) for k in range(196)} for i, t in rows}
    near = [(a, b) for a in fps for b in range(a) if len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b])]
    assert len(near) > 300 and sum(got[a]["root"] == got[b]["root"] for a, b in near) >= 0.98 * len(near)
    assert len({r["root"] for r in got.values()}) >= 6 and all(got[a]["root"] != got[b]["root"] for a in fps for b in fps if a % 6 != b % 6)


@pytest.mark.parametrize(("cap", "scheme"), [(64, simhash.EXACT), (2, simhash.EXACT), (64, simhash.SIMILAR), (1, simhash.SIMILAR)])
def test_simhash_links(spark, monkeypatch, cap, scheme):
    """All that the scheme finds by pairs is joined, with keys under and over the cap, with and without a broadcast of hot keys."""
    monkeypatch.setattr(simhash, "KEY_CAP", cap)
    monkeypatch.setattr(simhash, "BLOCK", 16)
    monkeypatch.setattr(simhash, "HOT_BROADCAST", 0 if cap < 64 else 100)
    rng, n = random.Random(7), 64 * scheme.words
    base = [rng.getrandbits(n) for _ in range(8)]
    fps = {b ^ sum(1 << k for k in rng.sample(range(n), rng.randrange(7 * scheme.words))) for b in base for _ in range(25)} | {0, 2**n - 1}
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    fps = sorted(fps)
    rows = [(k, [signed(f >> 64 * w & (2**64 - 1)) for w in range(scheme.words)]) for k, f in enumerate(fps)]
    entries = simhash._joined(spark.createDataFrame(rows, "v long, fp array<long>"), Scratch(spark), scheme)
    edges = [(fps[r["a"]], fps[r["b"]]) for r in simhash.links(entries, Scratch(spark), scheme).collect()]
    edges += [(fps[r["v"]], fps[r["g"]]) for r in entries.collect()]
    direct = [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= scheme.radius]
    want = reach(direct if scheme is simhash.EXACT else similar_links(fps), fps)
    whole, got = reach(direct, fps), reach(edges, fps)
    assert all(whole[a] == whole[b] for a, b in edges)
    if scheme is simhash.EXACT:
        assert got == want
    else:  # hot keys may join more than shared segments do, never less
        assert all(got[f] == got[want[f]] for f in fps)


@pytest.mark.parametrize(("rows_", "hashes"), [(2048, 1_000_000), (5, 1_000_000), (2048, 500), (3, 200)])
def test_proved_links(spark, monkeypatch, rows_, hashes):
    """Groups in one block and in many: near copies, a template whose copies are at 0.7 to 0.85, chains, and one of all kinds."""
    monkeypatch.setattr(similarity, "ROWS", rows_)
    monkeypatch.setattr(similarity, "HASHES", hashes)
    rng, rows = random.Random(11), []
    fresh = lambda n: [rng.getrandbits(63) for _ in range(n)]
    for root, least, most in ((1, 0, 3), (2, 4, 9), (3, 0, 9)):
        for base in [fresh(rng.randrange(20, 40)) for _ in range(1 + (root == 3))]:
            rows += [(root, set(base[: len(base) - (d := rng.randrange(least, most))] + fresh(d))) for _ in range(20)]
    chain = fresh(60)
    rows += [(4, set(chain[k : k + 30])) for k in range(0, 30, 3)] + [(5, set(fresh(1)))] * 2 + [(6, set(fresh(4))), (6, set(fresh(900)))]
    rng.shuffle(rows)
    near = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if rows[a][0] == rows[b][0] and 5 * len(rows[a][1] & rows[b][1]) >= 4 * len(rows[a][1] | rows[b][1])]
    want = reach(near, range(len(rows)))
    made = [(v, root, len(s), np.array(sorted(s), np.uint64).tobytes()) for v, (root, s) in enumerate(rows)]
    sets = spark.createDataFrame([(v, r, n, bytearray(s)) for v, r, n, s in made], "v long, root long, n long, s binary").cache()
    got = {r["node"]: r["root"] for r in similarity.proved(sets, len(rows), (4, 5), Scratch(spark)).collect()}
    assert {v: got.get(v, v) for v in range(len(rows))} == want and len({want[v] for v in want if rows[v][0] == 2}) > 3
    assert similarity.proved(sets.limit(0), 0, (4, 5), Scratch(spark)).count() == 0


def test_hubs(spark, monkeypatch):
    """A vertex with most of the links, joined by broadcast."""
    monkeypatch.setattr("facetwise.llm.components.HEAVY_LEAST", 3)
    monkeypatch.setattr("facetwise.llm.components.HEAVY", 50)
    edges = [(0, k) for k in range(1, 200)] + [(k, k + 1) for k in range(300, 310)] + [(500, k) for k in range(501, 540)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()}
    assert got == reach(edges, {x for e in edges for x in e})


@pytest.mark.parametrize("scheme", [simhash.EXACT, simhash.SIMILAR])
def test_keep_one(spark, scheme):
    rows = [(1, "a b c d e", "x"), (1, "a b c d e", "x"), (1, "q w e r t y", "x"), (2, "a b c d e", "x"), (None, "zz yy xx ww", "n"), (None, "zz yy xx ww", "n"), (7, None, "x"), (8, "", "y")]
    for own in ("own_fp", "win", "dedup_id", "fp", "k", "row", "root"):
        docs = spark.createDataFrame(rows, f"doc_id long, text string, {own} string")
        got = simhash.keep_one(docs, spark, scheme)
        assert got.columns == docs.columns
        assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, [(1, "a b c d e", "x"), (1, "q w e r t y", "x"), (None, "zz yy xx ww", "n"), (7, None, "x")]))
    assert simhash.keep_one(docs.limit(0), spark, scheme).count() == 0


# ---- 4 ----


def pseudonym(spark, *values):
    rows = pii.pseudonymize(spark.createDataFrame(list(enumerate(values)), "doc_id long, text string"), key="k").orderBy("doc_id").collect()
    return [r["text"] for r in rows]


def luhn(d):
    return sum((2 * int(x) - 9 * (int(x) > 4)) if k % 2 else int(x) for k, x in enumerate(reversed(d))) % 10 == 0


def test_pii_kinds(spark):
    values = ["+1 (499) 555-6503", "4111 1111 1111 1111", "4111111111111111", "1234567890123456", "10.20.30.40", "1999-02-28", "31.12.2001", "123-45-6789", "ana.perez@mail.example.com", 'token = "bc0d31ba76f17e56642e8751295a3fd50cd8e61f"']
    out = pseudonym(spark, *values)
    assert all(a != b for a, b in zip(values, out, strict=True))
    shape = lambda t: "".join("9" if c.isdigit() else c for c in t)
    assert [shape(t) for t in out[:4]] == [shape(t) for t in values[:4]] and shape(out[5]) == "9999-99-99" and shape(out[6]) == "99.99.9999" and shape(out[7]) == "999-99-9999"
    assert out[1].replace(" ", "") == out[2] and luhn(out[2]) and all(int(x) < 256 for x in out[4].split("."))
    assert out[8].endswith("@mail.example.com") and out[9].startswith('token = "') and len(out[9]) == len(values[9])
    same = ["300.1.1.1", "31/02/2001", "666-11-1111", "version 2.0, 42 items", "", "no data at all"]
    assert pseudonym(spark, *same) == same
    assert pseudonym(spark, f"call {values[0]}; or {values[0]}!") == [f"call {out[0]}; or {out[0]}!"]


def test_feistel_is_a_bijection(spark):
    """Over whole small domains: all four digits, all days, all serials of one area and group."""
    two = spark.range(10_000).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("d"))
    assert two.select(F.expr(pii._permuted_digits("d", "'k'")).alias("x")).where("length(x) = 4").distinct().count() == 10_000
    days = spark.range(146_097).select(F.expr("date_format(date_add(date'1800-01-01', cast(id as int)), 'yyyy-MM-dd')").alias("day"))
    images = days.select(F.expr(pii._date("day", "k")).alias("x")).distinct()
    assert images.count() == 146_097 and images.where("x < '1800-01-01' or x > '2199-12-31'").count() == 0
    ssn = spark.range(9_999).select(F.expr("concat('123-45-', lpad(cast(id + 1 as string), 4, '0'))").alias("d")).select(F.expr(pii._ssn("d", "k")).alias("x"))
    assert ssn.distinct().count() == 9_999 and ssn.where("x like '000%' or x like '666%' or x like '9%' or x like '%-00-%' or x like '%0000'").count() == 0


def feistel(a, b, left, right, key):
    f = lambda i, side, x: int(hashlib.sha256(f"{key}/{i}/{side}/{x}".encode()).hexdigest()[:15], 16)
    for i in range(1, 6):
        left = (left + f(i, "l", right)) % a
        right = (right + f(i, "r", left)) % b
    return left, right


def plain_digits(d, key):
    h = len(d) // 2
    x, y = feistel(10**h, 10 ** (len(d) - h), int(d[:h]), int(d[h:]), key)
    return f"{x:0{h}d}{y:0{len(d) - h}d}"


def plain_number(d):
    check = lambda q: next(c for c in "0123456789" if luhn(q + c))
    if len(d) > 19:
        n, out, was = -(-len(d) // 18), "", ""
        for i in range(n):
            was = plain_digits(d[i * len(d) // n : (i + 1) * len(d) // n], f"k/long/{n}/{i}/{was}")
            out += was
        return out
    if luhn(d):
        q = plain_digits(d[:-1], "k/card")
        return q + check(q)
    h, m = (len(d) - 1) // 2, len(d) - 1 - (len(d) - 1) // 2
    x, y = feistel(10**h, 9 * 10**m, int(d[:h]), int(d[h:-1]) * 9 + (int(d[-1]) - int(check(d[:-1]))) % 10 - 1, "k/number")
    q = f"{x:0{h}d}{y // 9:0{m}d}"
    return q + str((int(check(q)) + 1 + y % 9) % 10)


def plain_date(x):
    day0 = datetime.date(1800, 1, 1)
    days = [day0 + datetime.timedelta(k) for k in range(146_097)]
    late = [d for d in days if d.day > 12]
    a, b, c = map(int, re.split("[-/.]", x))
    sep = re.search("[-/.]", x).group()
    if a > 31:
        shape, t = "%Y-%m-%d", datetime.date(a, b, c)
    elif b <= 12:
        shape, t = "%d-%m-%Y", datetime.date(c, b, a)
    else:
        k = late.index(datetime.date(c, a, b))
        p = feistel(9, 9833, k // 9833, k % 9833, "k/month")
        return late[p[0] * 9833 + p[1]].strftime("%m-%d-%Y").replace("-", sep)
    k = (t - day0).days
    p = feistel(189, 773, k // 773, k % 773, "k/date")
    return days[p[0] * 773 + p[1]].strftime(shape).replace("-", sep)


def test_pii_against_plain_feistel(spark):
    """Every kind against an independent permutation."""
    rng = random.Random(11)
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    numbers = [digits(rng.randrange(13, 20)) for _ in range(60)] + [digits(n) for n in (20, 21, 36, 37, 55, 200)] + ["0" * 16, "4111111111111111"]
    dates = ["2020-03-04", "31/12/1999", "12/31/1999", "01.13.1800", "12-31-2199", "29.02.2000", "02/29/2000", "1800/01/01", "05-06-2007"]
    ssn, ip, phone = "123-45-6789", "10.0.255.1", "+1 (499) 555-6503"
    out = pseudonym(spark, *numbers, *dates, ssn, ip, phone, "ana.perez@mail.example.com")
    assert out[: len(numbers)] == [plain_number(d) for d in numbers]
    assert out[len(numbers) :][: len(dates)] == [plain_date(d) for d in dates]
    left, right = feistel(88902, 9999, 122 * 99 + 44, 6788, "k/ssn")
    area = left // 99 + (2 if left // 99 >= 665 else 1)
    assert out[-4] == f"{area:03d}-{left % 99 + 1:02d}-{right + 1:04d}"
    left, right = feistel(65536, 65536, 10 * 256, 255 * 256 + 1, "k/ip")
    assert out[-3] == f"{left // 256}.{left % 256}.{right // 256}.{right % 256}"
    assert re.sub("[^0-9]", "", out[-2]) == "1" + plain_digits("4995556503", "k/phone")
    assert out[-1] == "u" + hashlib.sha256(b"k/email/ana.perez@mail.example.com").hexdigest()[:15] + "@mail.example.com"


def test_pii_classes_are_disjoint(spark):
    """Numbers without check digit never meet a card, month-first dates never meet a day-first one; both are bijections."""
    tens = spark.range(20_000).select(F.format_string("%013d", F.col("id") * 7919 + 4_000_000_000_000).alias("d"))
    made = tens.select("d", F.expr(pii._number("d", "k")).alias("x")).collect()
    assert len({r["x"] for r in made}) == 20_000 and all(luhn(r["d"]) == luhn(r["x"]) for r in made)
    small = spark.range(100_000).select(F.lpad(F.col("id").cast("string"), 5, "0").alias("d"))
    small = small.where(F.expr(pii._luhn("d", 1)) % 10 != 0).select(F.expr(pii._invalid("d", "'k'")).alias("x")).collect()
    assert len({r["x"] for r in small}) == 90_000 and not any(luhn(r["x"]) for r in small)
    late = spark.range(146_097).select(F.expr("date_add(date'1800-01-01', cast(id as int))").alias("t")).where("day(t) > 12")
    images = {r["x"] for r in late.select(F.expr(pii._date("date_format(t, 'MM/dd/yyyy')", "k")).alias("x")).collect()}
    assert len(images) == 88_497 and all(12 < int(x[3:5]) <= 31 and int(x[:2]) <= 12 and "1800" <= x[6:] <= "2199" for x in images)


def test_pii_finds_values_in_place(spark):
    """Values before a time, of any length, and in long texts."""
    local = "a" * 500
    out = pseudonym(spark, "at 2020-03-04T10:00:00 sharp", f"to {local}@example.org now", "x" * 50_000 + " 4111111111111111 " + "y" * 50_000, "no 2020-03-04Tuesday")
    assert out[0].startswith("at ") and out[0].endswith("T10:00:00 sharp") and "2020-03-04" not in out[0]
    assert local not in out[1] and out[1].endswith("@example.org now") and "4111111111111111" not in out[2] and out[3] == "no 2020-03-04Tuesday"


def test_pii_odd_rows(spark):
    for own in ("pii", "found_values", "made_values", "__hits", "__made"):
        docs = odd(spark, own)
        out = pii.pseudonymize(docs, key="k").collect()
        assert Counter((r["doc_id"], r["text"]) for r in out) == Counter((r[0], r[1]) for r in ODD) and all(r["pii"] == [] for r in out)
        assert own == "pii" or sorted(map(str, (r[own] for r in out))) == sorted(map(str, (r[5] for r in ODD)))
    assert pii.pseudonymize(docs.limit(0), key="k").count() == 0
    plan = pii.pseudonymize(odd(spark), key="k")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_pii_long_secrets(spark):
    """No secret is too long: none of it stays in clear text, and its length stays."""
    rng = random.Random(4)
    jwt, code, key = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnop_-.", k=5000)), "".join(rng.choices("0123456789abcdef", k=200)), "".join(rng.choices("ghijklmnopqrstuv", k=90))
    values = [f'token = "{jwt}" end', f"x {code} end", f"x sk-{key} end"]
    out = pseudonym(spark, *values)
    assert [len(x) for x in out] == [len(x) for x in values] and out[0].startswith('token = "') and all(x.endswith(" end") or x.endswith('" end') for x in out)
    for clear, made in zip((jwt, code, key), out, strict=True):
        assert not any(clear[k : k + 12] in made for k in range(len(clear) - 11))


# ---- 5 ----


def test_licenses(spark):
    rows = [
        (1, "x. Released under the MIT License.\nThe MIT license, again."), (2, "Licensed under CC BY-NC 4.0."), (3, "a mit. license? mit-license"), (4, "apache licenses; general public license license"),
        (5, "Permission is hereby granted, free of charge, to any person obtaining a copy of this nice software and associated documentation files"), (6, "filler " * 5000 + "This work is licensed under the GNU General Public License, version 3."),
        (7, "released under the general terms of the license"),
    ]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, labels string")
    got = {r["doc_id"]: r for r in licenses.scan(docs, spark).collect()}
    assert [(got[k]["n_base"], got[k]["base_labels"], got[k]["labels"]) for k in range(1, 8)] == [(2, "mit", "mit"), (0, "", "cc-by-nc"), (2, "mit", "mit"), (1, "gpl", "gpl"), (0, "", "mit"), (1, "gpl", "gpl"), (0, "", "")]
    assert (got[1]["first_word"], got[1]["last_word"]) == (4, 7) and got[7]["first_word"] is None and got[6]["first_word"] == 5007
    assert {r["n_words"] for r in licenses.scan(odd(spark), spark).where("doc_id in (1, 2, 3)").collect()} == {0}


def test_license_join_is_exact():
    """The filters lose no block that meets the threshold."""
    rng = random.Random(9)
    v = [f"w{k}" for k in range(14)]
    for _ in range(60):
        templates = [(" ".join(rng.choices(v, k=rng.randint(1, 6))), f"l{k}") for k in range(4)]
        freq = {w.encode(): rng.randrange(50) for w in v}
        m = licenses.Matcher(templates, {}, freq, 0.7)
        w = rng.choices(v + ["other"] * 10, k=rng.randrange(40))
        want = {}
        for k, (t, _) in enumerate(templates):
            tokens_, step = set(t.split()), len(t.split())
            for at in range(0, max(1, len(w)), step):
                c = len(tokens_ & set(w[at : at + 2 * step]))
                if c >= math.ceil(0.7 * len(tokens_) - 1e-9):
                    want[k] = max(want.get(k, 0), c / len(tokens_))
        code = np.array([m.vocab.get(x.encode(), 0) for x in w], np.int32)
        assert m.blocks(code) == pytest.approx(want)


def test_license_query_on_odd_rows(spark):
    """Whole rows against SQL: full texts of licenses with a tenth of their words changed, scattered words, odd rows."""
    rng, made = random.Random(3), []
    for k, (t, _) in enumerate(licenses.TEMPLATES):
        w = t.split()
        for _ in range(3):
            x = [rng.choice(["filler", "The", y]) if rng.random() < 0.12 else y for y in w]
            made.append((100 + len(made), " ".join(["lead"] * rng.randrange(200) + x + ["end"] * rng.randrange(50))))
        made.append((100 + len(made), " ".join(y + " and so on and on" for y in w)))
    docs = odd(spark, "labels").drop("labels").unionByName(spark.createDataFrame(made, "doc_id long, text string").selectExpr("*", "'en' as lang", "'s' as source", "1L as n_chars"))
    con = duckdb.connect()
    documents_ = docs.toPandas()  # noqa: F841
    con.execute("create view documents as select * from documents_")
    res = con.execute(queries.ORACLES["op5_license_scan"])
    names = [c[0] for c in res.description]
    got = licenses.scan(docs, spark).select(*names).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((None if r[0] is None or r[0] != r[0] else int(r[0]), *r[1:])) for r in res.fetchall())
    assert sum(bool(r["labels"]) for r in got) > 20 and licenses.scan(docs.limit(0), spark).count() == 0
    with pytest.raises(ValueError):
        licenses.scan(docs, spark, templates=[("x " * 10_000_000, "x")])


# ---- 6 ----


def test_mixing(spark):
    docs = spark.createDataFrame([(k, f"t{k}", "big" if k % 3 else f"s{k % 2}", "z") for k in range(3000)], "doc_id long, text string, source string, mix_rate string").withColumn("n_chars", F.lit(1))
    docs = docs.unionByName(docs.limit(1).withColumn("source", F.lit(None).cast("string")))
    out = mixing.replicate(docs, {"big": 1.0, "s0": 2.0, "s1": 1.0}, size=2.0).cache()
    n = Counter(r["source"] for r in out.select("source").collect())
    assert None not in n and n["big"] == pytest.approx(1500, rel=0.1) and n["s0"] == pytest.approx(3000, rel=0.1)
    rate = {"big": 0.25 * 6002 / 2000, "s0": 0.5 * 6002 / 500, "s1": 0.25 * 6002 / 500}
    for doc_id, source in ((1, "big"), (6, "s0"), (9, "s1")):
        u = int(hashlib.md5(f"mix-1:{doc_id}".encode()).hexdigest()[:13], 16) / 2**52
        k, p, c = 0, math.exp(-rate[source]), math.exp(-rate[source])
        while c <= u:
            k += 1
            p *= rate[source] / k
            c += p
        assert out.where(F.col("doc_id") == doc_id).count() == k
    assert mixing.replicate(docs.limit(0)).count() == 0 and mixing.replicate(docs, {"none": 1.0}).count() == 0
    assert mixing.replicate(odd(spark, "mix_copy")).columns == ["doc_id", "text", "lang", "source", "n_chars", "mix_copy"]
    plan = mixing.replicate(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_mixing_keeps_columns_and_any_source(spark, monkeypatch):
    """User columns of any name stay; many sources meet their rates by shuffle, with the same draws."""
    names = ("mix_u", "mix_n", "mix_source", "mix_rate", "mix_order", "mix_cdf", "row", "place", "n", "u", "salt", "parts", "cdf", "block")
    docs = odd(spark, "x")
    for c in names:
        docs = docs.withColumn(c, F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = lambda df: Counter(map(repr, df.collect()))
    want = rows(mixing.replicate(docs, size=3.0))
    got = mixing.replicate(docs, size=3.0)
    assert got.columns == [*docs.columns, "mix_copy"] and all(r[c] == c + str(r["doc_id"] if r["doc_id"] is not None else "") for r in got.collect() for c in names)
    monkeypatch.setattr(mixing, "BROADCAST_DOUBLES", 0)
    assert want and rows(mixing.replicate(docs, size=3.0)) == want and rows(mixing.replicate(docs.limit(0))) == Counter()


def test_mixing_of_rare_sources(spark):
    """One row among many thousands: its rate is drawn in parts, which follow the inverted distribution."""
    rows = [(k, "t", "big") for k in range(30_000)] + [(100_000, "t", None)] + [(200_000 + k, "t", "few") for k in range(20)]
    out = mixing.replicate(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    n = {r["doc_id"]: (r["n"], r["low"], r["high"], r["kinds"]) for r in out.where("source is null or source = 'few'").groupBy("doc_id").agg(
        F.count("*").alias("n"), F.min("mix_copy").alias("low"), F.max("mix_copy").alias("high"), F.countDistinct("mix_copy").alias("kinds")).collect()}
    for doc_id, rate in ((100_000, len(rows) / 3), (200_003, len(rows) / 60)):
        parts, total = math.ceil(rate / 700), 0
        for j in range(1, parts + 1):
            u = int(hashlib.md5((f"mix-1/part:{j}:{doc_id}" if parts > 1 else f"mix-1:{doc_id}").encode()).hexdigest()[:13], 16) / 2**52
            p = c = math.exp(-rate / parts)
            k = 0
            while c <= u:
                k += 1
                p *= rate / parts / k
                c += p
            total += k
        assert n[doc_id] == (total, 1, total, total) and abs(total - rate) < 5 * math.sqrt(rate)
    few = [n[200_000 + k][0] for k in range(20)]
    assert abs(np.mean(few) - len(rows) / 60) < 5 * math.sqrt(len(rows) / 60 / 20)


# ---- 7 ----


def test_ppm_costs():
    """Costs against a direct reading of the trees' definition."""
    texts = [b"abracadabra", b"abba"]
    code, _ = langid._grams(texts)
    u, n = np.unique(code, return_counts=True)
    trees = langid.Trees(["x"], u, n[:, None].astype(float))
    padded = [langid.PAD + t for t in texts]
    after = [Counter() for _ in range(langid.ORDER + 1)]
    for t in padded:
        for at in range(langid.ORDER, len(t)):
            for k in range(langid.ORDER + 1):
                after[k][t[at - k : at], t[at]] += 1

    def p(context, byte):
        out = 1 / 256
        for k in range(langid.ORDER + 1):
            seen = {b: c for (x, b), c in after[k].items() if x == context[len(context) - k :]}
            total, kinds = sum(seen.values()), len(seen)
            out = seen[byte] / (total + kinds) if byte in seen else out * (kinds / (total + kinds) if total else 1)
        return out

    probe = b"abrazz"
    want = -sum(math.log2(p((langid.PAD + probe)[at : at + langid.ORDER], probe[at])) for at in range(len(probe)))
    assert trees.score([probe, b""])[:, 0] == pytest.approx([want, 0])
    assert sum(p(b"abr", b) for b in range(256)) <= 1 + 1e-9


def test_language_id(spark):
    docs = documents(spark)
    model = langid.train(docs, spark)
    rows = langid.predict(docs, model, spark).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (crc32_of(r["doc_id"]) % 5 == 0) for r in rows) and sum(r["lang"] == r["lang_pred"] for r in held) > 0.95 * len(held)
    got = {r["doc_id"]: r for r in langid.predict(odd(spark, "lang_pred"), model, spark).collect()}
    assert [got[k]["lang_pred"] for k in (1, 2, 3)] == ["und"] * 3 and got[4]["lang_pred"] in model.languages and len(got) == 8
    assert langid.train(docs.limit(0), spark) is None and langid.predict(odd(spark), None, spark).where("lang_pred <> 'und'").count() == 0


def test_language_query_by_brute_force(spark, monkeypatch):
    """Every row priced by plain loops over its bytes, under counts of all training rows; odd rows among them."""
    monkeypatch.setattr(langid, "HELD", 500)
    docs = documents(spark).limit(40).withColumn("text", F.substring("text", 1, 120)).unionByName(odd(spark).drop("fp").where("doc_id <> 5 or doc_id is null"))
    rows = docs.collect()
    after = {}
    for r in rows:
        if r["text"] is not None and r["lang"] is not None and crc32_of(r["doc_id"]) % 5:
            t = langid.PAD + r["text"].lower().encode()
            for at in range(3, len(t)):
                for k in range(4):
                    after.setdefault((r["lang"], t[at - k : at]), Counter())[t[at]] += 1
    languages = sorted({lang for lang, _ in after})

    def bits(lang, text):
        t, total = langid.PAD + text.lower().encode(), 0.0
        for at in range(3, len(t)):
            p = 1 / 256
            for k in range(4):
                seen = after.get((lang, t[at - k : at]))
                if seen:
                    whole = sum(seen.values()) + len(seen)
                    p = seen[t[at]] / whole if t[at] in seen else p * len(seen) / whole
            total -= math.log2(p)
        return total

    want = []
    for r in rows:
        pred, score = "und", 0.0
        if r["text"] is not None and any(map(str.isalpha, r["text"])):
            cost = {x: bits(x, r["text"]) for x in languages}
            pred = min(cost, key=lambda x: (round(cost[x], 9), x))
            score = 1 / sum(2.0 ** max(-1000, cost[pred] - c) for c in cost.values())
        want.append((str(r["doc_id"]), crc32_of(r["doc_id"]) % 5 == 0, pred, round(score, 6)))
    model = langid.train(docs, spark)
    got = [(str(r["doc_id"]), r["held_out"], r["lang_pred"], round(r["score"], 6)) for r in langid.predict(docs, model, spark).collect()]
    assert model.languages == languages and sorted(got) == sorted(want)
    assert langid.predict(docs.limit(0), model, spark).count() == 0
    few = langid.train(docs, spark, grams=50)
    assert sum(map(len, (few.known[3][0],))) <= 50


# ---- 8 ----


def test_quality(spark):
    docs = documents(spark)
    model, scorer = quality.train(docs, spark)
    rows = quality.scores(docs, scorer, spark).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    good, bad = [r for r in rows if r["quality"] == 1], [r for r in rows if r["quality"] == 0]
    assert sum(r["rejected"] for r in good) <= 0.02 * len(good) and sum(r["rejected"] for r in bad) >= 0.8 * len(bad)
    assert quality.scores(odd(spark, "score"), scorer, spark).where("doc_id in (1, 2, 3, 4) and rejected").count() == 0
    assert quality.keep(odd(spark, "score"), scorer, spark).where("doc_id in (1, 2, 3, 4, 8)").count() == 5
    _, none = quality.train(docs.limit(0), spark)
    assert quality.scores(odd(spark), none, spark).where("rejected").count() == 0


def test_quality_of_short_texts(spark):
    """Texts of few words are judged; only those without words score 1."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    _, scorer = quality.train(docs, spark)
    for text in ("Of Of erinly erinly this this and and thti, thti, onst onst", "Reon*** haeand$$$ and&&& ererti$$$ reorsh$$$", "heitieau | enenst. | Schkeittz |"):
        assert scorer.score(text.encode()) < 0.5, text
    for text in ("one", "Hello world.", "The thing and that."):
        assert 0.5 <= scorer.score(text.encode()) < 1, text
    assert scorer.score(b"") == scorer.score(b" \n ") == 1
    assert quality.votes(quality.statistics(b"ab" * 500_000))[5] == "b" and quality.votes(quality.statistics(b"one")).strip("-") == ""


def plain_statistics(text):
    """What the labellers look at, by loops over words and characters."""
    w, n = text.split(), len(text.split())
    letter = lambda c: 65 <= c <= 90 or 97 <= c <= 122 or c >= 128
    strong, tail = set(b"*&%$#@=<>{}[]~^_|\\!"), set(b".,;:?!")
    lines = [x for x in text.split(b"\n") if x]
    again = sum(w[k] == w[k - 1] for k in range(1, n)) / max(1, n - 1)
    return {
        "upper_share": sum(65 <= c <= 90 for c in text) / max(1, sum(map(letter, text))),
        "symbol_words": sum(len(x) > 1 and x[-1] in strong and x[-2] in strong for x in w) / n,
        "bare_marks": sum(not any(letter(c) or 48 <= c <= 57 for c in x) for x in w) / n,
        "repeated_next": again,
        "distinct_share": sum(len(set(w[k : k + 200])) for k in range(0, n, 200)) / n,
        "mean_word": sum(map(len, w)) / n,
        "line_repeats": 1 - len(set(lines)) / len(lines),
        "packed_share": len(zlib.compress(text, 1)) / len(text),
        "plain_words": sum(letter(x[-1]) or (x[-1] in tail and len(x) > 1 and letter(x[-2])) for x in w) / n,
        "fresh_words": 1 - again,
        "words": n,
        "letters": sum(map(letter, text)),
        "inner": sum(map(len, w)),
    }


def test_quality_by_brute_force(spark):
    """The whole query by plain loops: statistics, expectation maximisation row by row, features, gradient steps, scores."""
    rows = [r for r in documents(spark).collect()] + [r for r in odd(spark).drop("fp").where("doc_id <> 5 or doc_id is null").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    texts_ = [(r["text"] or "").encode() for r in rows]
    stats = [plain_statistics(t) if t.split() else None for t in texts_]
    for t, x in zip(texts_, stats, strict=True):
        got = quality.statistics(t)
        assert (got is None) == (x is None) and (x is None or got == pytest.approx(x))
    vote = [quality.votes(x) for x in stats]
    judged = [k for k, v in enumerate(vote) if v.strip("-")]
    prior, q = 0.5, {k: 0.001 if "b" in vote[k] else 0.999 for k in judged}
    for _ in range(200):
        prior = min(0.999, max(0.001, sum(q.values()) / len(q)))
        accuracy = {}
        for y in (0, 1):
            for at in range(len(quality.LABELLERS)):
                for v in "gb-":
                    mass = sum((q[k] if y else 1 - q[k]) for k in judged if vote[k][at] == v)
                    accuracy[y, at, v] = (mass + 0.1) / (sum(q[k] if y else 1 - q[k] for k in judged) + 0.3)
        for k in judged:
            odds = math.log(prior / (1 - prior)) + sum(math.log(accuracy[1, at, v] / accuracy[0, at, v]) for at, v in enumerate(vote[k]))
            q[k] = 1 / (1 + math.exp(-max(-50, min(50, odds))))
    model, scorer = quality.train(docs, spark)
    assert all(model.posterior[vote[k]] == pytest.approx(q[k], abs=1e-9) for k in judged)

    def plain_features(text, x):
        kinds = [int(quality._CLASS[c]) for c in text]
        out, grams = [0.0] * 512, Counter(kinds[k] * 400 + kinds[k + 1] * 20 + kinds[k + 2] for k in range(len(kinds) - 2))
        for g, n in grams.items():
            out[(g * 2654435761 >> 7) % 512] += math.sqrt(n / (len(kinds) - 2))
        for k, (name, _, _) in enumerate(quality.LABELLERS):
            place = int(min(15, max(0, round(x[name] * (1 if name == "mean_word" else 15)))))
            out[((k * 16 + place + 1) * 40503 >> 3) % 512] += 1.0
        out[0] = 1.0
        return out

    x, y = np.array([plain_features(texts_[k], stats[k]) for k in judged]).astype(np.float16).astype(float), np.array([q[k] for k in judged])
    w, v, rate = np.zeros(512), np.zeros(512), 4 / np.mean(np.sum(x**2, 1))
    for _ in range(300):
        near = w + 0.9 * v
        v = 0.9 * v - rate * (x.T @ (1 / (1 + np.exp(-x @ near)) - y) / len(y) + 1e-4 * near)
        w = w + v
    want = [1.0 if s is None else 1 / (1 + math.exp(-float(np.dot(plain_features(t, s), w)))) for t, s in zip(texts_, stats, strict=True)]
    got = quality.scores(docs, scorer, spark).collect()
    assert sorted((str(r["doc_id"]), round(r["score"], 3)) for r in got) == sorted((str(r["doc_id"]), round(s, 3)) for r, s in zip(rows, want, strict=True))


def test_quality_is_the_same_at_every_length():
    """Ten copies' worth of fresh words change no vote, and only the end of a long text can change its score."""
    rng = random.Random(8)
    words_ = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(3000)]
    short, long = (" ".join(rng.choices(words_, k=n)).encode() for n in (300, 30_000))
    assert quality.votes(quality.statistics(short)) == quality.votes(quality.statistics(long))
    junk = " ".join(rng.choices(words_, k=60)).encode() + b" the" * 20_000
    assert "b" in quality.votes(quality.statistics(junk))


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(1)
    y = rng.random(20_000) < 0.8
    n = len(quality.LABELLERS)
    votes = np.full((len(y), n), "-")
    for k in range(n):
        fires = np.where(y, rng.random(len(y)) < 0.02, rng.random(len(y)) < 0.6)
        votes[fires, k] = "b"
        votes[~fires & (k == n - 1), k] = "g"  # every document has a vote
    model = quality.LabelModel(Counter("".join(v) for v in votes))
    assert model.prior == pytest.approx(0.8, abs=0.03) and np.allclose(model.accuracy[0, :, 1], 0.6, atol=0.05) and np.allclose(model.accuracy[1, :, 1], 0.02, atol=0.02)


# ---- 9 ----


def test_toxicity(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels, spark)
    for told in ("st*pid", "1d10t", "i d i o t", "$cum", "cl0wn", "m.o.r.o.n", "stuuuupid", "tr@sh", "lo$er", "IDIOT"):
        assert model.score(f"the other {told} of that") >= 0.3, told
    for told in ("the thing of that", "", "call 1-800 now 4 u", "a b c d"):
        assert model.score(told) < 0.3, told
    rows = toxicity.scores(docs, model, spark).join(labels, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and (r["predicted"] == 1) == (r["score"] >= 0.3) for r in rows)
    assert sum(r["predicted"] for r in held if not r["toxic"]) <= 0.03 * len(held)
    assert toxicity.scores(odd(spark, "score"), model, spark).where("score is null or score < 0 or score > 1").count() == 0
    blank = toxicity.train(docs.limit(0), labels.limit(0), spark)
    assert toxicity.scores(odd(spark), blank, spark).where("score > 0").count() == 0


def test_toxicity_of_hidden_words(spark):
    """Look-alikes in words of letters, doubled letters, long stretches, spaced runs of several words, several masks."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels, spark)
    for told in ("iddiot", "\u0456d\u0456\u043et", "i" + "d" * 60 + "iot", "t h e i d i o t", "t h e t h i n g " * 10 + "i d i o t", "$tupid!", "st**id", "s**p*d", "i.d.i.o.t x", "s.t.u p-i_d", "http://one.two/three/four/five/six/1d10t/seven"):
        assert model.score(f"the other {told} of that") >= 0.3, told
    for told in ("455 100", "hello, well all full!", "* * * * *"):
        assert model.score(told) < 0.3, told
    rng = random.Random(2)
    for _ in range(300):
        token = "".join(rng.choices("abdeiostu013!@.-$*#\u0456", k=rng.randrange(3, 14)))
        assert model.channel._narrow(token) == model.channel._decode(token, False)


def test_restoring_is_the_best_path():
    """Against all paths of the lattice of short tokens, with masks dropped or filled."""
    rng = np.random.default_rng(4)
    channel = toxicity.Channel(rng.integers(0, 50, (28, 28, 28)).astype(float))

    def paths(token, filled):
        found = {}

        def go(at, a, b, cost, word):
            if at == len(token):
                cost += channel.cost[a, b, 0]
                found[word] = min(found.get(word, math.inf), cost)
                return
            c = token[at]
            reads = [(c, 0.0)] if c.isascii() and c.isalpha() else [(x, 2.0 if len(toxicity.STANDS_FOR[c]) < 5 else 4.0) for x in toxicity.STANDS_FOR.get(c, "")]
            if c in ".-_":
                go(at + 1, a, b, cost + 1.0, word)
            elif not (filled and c in "*#%"):
                if at and token[at - 1] == c and reads:
                    go(at + 1, a, b, cost + 0.5, word)
                elif not reads or c in "*#%!":
                    go(at + 1, a, b, cost + 4.0, word)
            for x, extra in reads:
                k = ord(x) - 96
                go(at + 1, b, k, cost + channel.cost[a, b, k] + extra, word + x)

        go(0, 0, 0, 0.0, "")
        return found

    draw = random.Random(6)
    for _ in range(120):
        token = "".join(draw.choices("aabdst0131!$@.-", k=draw.randrange(3, 8)))
        if draw.random() < 0.4:
            token = token[:3] + "*" + token[3:4]
        for filled in (False, True):
            found = paths(token, filled)
            assert found[channel.restore(token, filled)] == pytest.approx(min(found.values())), token
    long = "1d10t-" * 3000
    assert len(channel.restore(long)) > 10_000 and channel.restored(" ".join("idiot") + " " + long)


def test_watch_turns_down_no_sign():
    """What the watch turns down has no path to a sign, and what has one passes."""
    draw = random.Random(9)
    signs_ = {b"bad", b"stoo~", b"is", b"a?d"}
    watch = toxicity.Watch(signs_)
    channel = toxicity.Channel(np.ones((28, 28, 28)))
    seen = [0, 0]
    for _ in range(3000):
        token = "".join(draw.choices("abdsti01!*.5\u00e9", k=draw.randrange(1, 8)))
        reach_ = {""}
        for at in range(len(token)):
            reads = channel._readings(token[at])
            stay = channel._stay(token, at, reads, False) is not None
            reach_ = {w + (chr(96 + x) if x < 27 else "?") for w in reach_ for x, _ in reads} | (reach_ if stay else set())
        can = any(w.encode() in signs_ or w[:4].encode() + b"~" in signs_ for w in reach_)
        seen[can] += 1
        assert watch.may(token) or not can, token
    assert min(seen) > 20


def test_toxicity_by_brute_force(spark):
    """Strengths and scores by plain loops over the rows; odd rows and labels among them."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").unionByName(odd(spark).drop("fp"))
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "toxic")
    labels = labels.unionByName(labels.limit(5)).unionByName(spark.createDataFrame([(None, 1), (1, None), (10**9, 1)], "doc_id long, toxic int").select("doc_id", F.col("toxic").cast(labels.schema["toxic"].dataType)))
    model = toxicity.train(docs, labels, spark)
    known = {}
    for r in labels.collect():
        if r["doc_id"] is not None and r["toxic"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2:
            known[r["doc_id"]] = max(known.get(r["doc_id"], 0), r["toxic"])
    rows, seen, total = docs.collect(), {}, [0, 0]
    found = {r["text"]: toxicity.signs(r["text"] or "", model.channel) for r in rows}
    for r in rows:
        if (y := known.get(r["doc_id"])) is not None:
            total[y] += 1
            for w in found[r["text"]]:
                seen.setdefault(w, [0, 0])[y] += 1
    base, strength = total[1] / sum(total), {}
    for w, (n0, n1) in seen.items():
        n = n0 + n1
        if n >= 6 and (n1 - n * base) / math.sqrt(n * base * (1 - base)) >= 7 and n1 >= 4 * n0:
            strength[w] = (n1 + 0.1) / (n + 0.5)
    assert model.strength == pytest.approx(strength) and model.base == pytest.approx(min(0.05, base / 4)) and len(strength) > 5
    want = []
    for r in rows:
        rest = 1 - model.base
        for w in found[r["text"]]:
            rest *= 1 - strength.get(w, 0.0)
        want.append((str(r["doc_id"]), zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % 4 == 2, round(1 - rest, 6), int(1 - rest >= 0.3)))
    got = [(str(r["doc_id"]), r["held_out"], round(r["score"], 6), r["predicted"]) for r in toxicity.scores(docs, model, spark).collect()]
    assert sorted(got) == sorted(want)


# ---- 10 ----


@pytest.mark.parametrize(("dim", "n", "send"), [(64, 200, 1.0), (64, 200, 2000.0), (5, 120, 10.0), (1, 12, 10.0)])
def test_embeddings(spark, monkeypatch, dim, n, send):
    monkeypatch.setattr(embeddings, "SEND", send)
    monkeypatch.setattr(embeddings, "CELL_CAP", 40)
    rng = np.random.default_rng(dim + int(send))
    x = rng.standard_normal((n, dim)).astype(np.float32)
    for _ in range(n // 2):
        x[rng.integers(n)] = x[rng.integers(n)] + rng.standard_normal(dim) * rng.choice([0, 0.05, 0.3, 0.45, 0.5])
    rows = [r.tolist() for r in x]
    rows[:6] = [None, [0.0] * dim, [float("nan")] * dim, [], [1.0] * (dim + 1), [None] + [1.0] * (dim - 1)]
    ok = [r is not None and len(r) > 0 and all(v is not None and math.isfinite(v) for v in r) and any(r) for r in rows]
    unit = [np.array(r, float) / np.linalg.norm(np.array(r, float)) if o else None for r, o in zip(rows, ok, strict=True)]
    near = [(i, j) for i in range(n) for j in range(i) if ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.9]
    root, links = reach(near, range(n)), Counter(k for e in near for k in e)
    df = spark.createDataFrame([(i, r, "z") for i, r in enumerate(rows)], "vec_id long, embedding array<float>, cls string")
    got = sorted(tuple(r) for r in embeddings.near_duplicates(df, spark).collect())
    assert got == [(i, links[i], root[i], root[i] == i) for i in range(n)]


def test_embeddings_with_odd_ids(spark, monkeypatch):
    """Repeated and null ids, equal vectors, several dimensions; hot cells met by broadcast and by shuffle."""
    monkeypatch.setattr(embeddings, "CELL_CAP", 3)
    one, two, three = [1.0, 0.0, 0.0], [0.98, 0.1, 0.0], [0.0, 1.0, 0.0]
    rows = [(1, one), (1, one), (1, three), (None, two), (None, [0.5, 0.5]), (7, one), (8, [0.5, 0.5]), (9, None), (None, None), (2, [2.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, "z", 0) for i, v in rows], "vec_id long, embedding array<double>, n string, cls int")
    want = sorted([(1, 4, 1, True), (1, 4, 1, True), (1, 0, 1, True), (None, 4, 1, False), (None, 1, 8, False), (7, 4, 1, False), (8, 1, 8, True), (9, 0, 9, True), (None, 0, None, True), (2, 4, 1, False)], key=repr)
    for most in (100, 0):
        monkeypatch.setattr(embeddings, "HOT_BROADCAST", most)
        assert sorted(map(tuple, embeddings.near_duplicates(df, spark).collect()), key=repr) == want


def test_embeddings_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embeddings.near_duplicates(df, spark).count() == 0


# ---- queries ----


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows
    if name in queries.ORACLES:
        con = duckdb.connect()
        for t in ("documents", "benchmark", "embeddings", "pages"):
            con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
        res = con.execute(queries.ORACLES[name])
        names = [c[0] for c in res.description]
        order = sorted(names)
        key = lambda r, at: repr(tuple(r[k] for k in at))
        assert sorted(df.columns) == order
        assert sorted(key(r, order) for r in rows) == sorted(key(r, [names.index(c) for c in order]) for r in res.fetchall())


def test_pipeline_is_its_stages(spark):
    import corpus_pipeline

    docs, kept = documents(spark), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = Scratch(spark).cut(stage(spark, docs, SF))
        assert k == 4 or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append(docs.count())
    assert kept == sorted(kept[:4], reverse=True) + kept[4:] and kept[3] == kept[2] and kept[0] > 100
    want = Counter(tuple(r) for r in docs.collect())
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, SF).collect()) == want


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Every stage on nulls, empty, long and repeated texts, clashing columns and empty tables; then the whole pipeline."""
    import corpus_pipeline

    spark.createDataFrame([(1, None), (2, "..."), (3, "no id but text")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = odd(spark, "pii_found")
    for c in ("fp", "root", "win", "row", "bad_id", "t", "id", "n", "u"):
        docs = docs.withColumn(c, F.lit(c))
    texts_ = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())
    every = texts_(docs)
    wordless = {k for k in every if not (k[1] or "").strip()}
    want = {
        "quality classifier": lambda got: not got - every and all(got[k] == every[k] for k in wordless),
        "simhash near-dedup": lambda got: got == Counter({k: 1 for k in every if k not in wordless or k[0] == 1}),
        "benchmark decontamination": lambda got: got == every - Counter([(None, "no id but text")]),
        "pii pseudonyms": lambda got: got == every,
        "mixing to target weights": lambda got: not set(got) - set(every),
    }
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns + ["mix_copy"] * (name == "mixing to target weights"), name
        assert want[name](texts_(out)), name
        assert all(r[c] == c for r in out.collect() for c in ("fp", "root", "win", "row", "bad_id", "t", "id", "n", "u")), name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    nulls = spark.createDataFrame([(None,) * 6] * 3, SCHEMA.format("fp"))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nulls, str(tmp_path)).count() == (1 if name == "simhash near-dedup" else 3) or name == "mixing to target weights", name
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert not set(texts_(corpus_pipeline.run(spark, str(tmp_path)))) - set(every)


def test_pipeline_by_brute_force(spark):
    """Which documents come out, and how often, by plain loops over the rows."""
    import corpus_pipeline

    rows = [r.asDict() for r in documents(spark).collect()]
    scorer = quality.train(documents(spark), spark)[1]
    rows = [r for r in rows if scorer.score(r["text"].encode()) >= 0.5]
    fps = {r["doc_id"]: plain_similar(r["text"]) for r in rows}
    group = proved_groups({fps[r["doc_id"]]: r["text"] for r in rows})
    rows = [r for r in rows if r["doc_id"] == min(i for i, f in fps.items() if group[f] == group[fps[r["doc_id"]]])]
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r["text"].encode())
        windows |= {tuple(w[k : k + 13]) for k in range(max(1, len(w) - 12))} - {()}

    def hit(text):
        w, found = words(text.encode()), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    found.update(range(k, k + n))
        return found and 20 * len(found) >= len(w)

    rows = [r for r in rows if not hit(r["text"])]
    per, want = Counter(r["source"] for r in rows), Counter()
    for r in rows:
        rate = len(rows) * (1 / len(per)) / per[r["source"]]
        u = int(hashlib.md5(f"mix-1:{r['doc_id']}".encode()).hexdigest()[:13], 16) / 2**52
        p = c = math.exp(-rate)
        while c <= u:
            want[r["doc_id"]] += 1
            p *= rate / want[r["doc_id"]]
            c += p
    out = corpus_pipeline.run(spark, SF).collect()
    assert Counter(r["doc_id"] for r in out) == want and all(r["n_chars"] == len(r["text"]) for r in out)
    text = {r["doc_id"]: r["text"] for r in rows}
    digits = lambda t: "".join("9" if c.isdigit() else c for c in t)
    plain = [r for r in out if "@" not in text[r["doc_id"]] and "token" not in text[r["doc_id"]].lower() and "." not in digits(text[r["doc_id"]]).replace(". ", "")]
    assert all(digits(r["text"]) == digits(text[r["doc_id"]]) for r in plain)


def test_a_crowd_asks_in_no_key_of_a_few(spark):
    rng = np.random.default_rng(5)
    scheme = simhash.SIMILAR
    base = rng.integers(0, 2**63, 7, np.uint64)
    prints = []
    for k in range(120):  # one joined group: near copies, a bit of each segment or none
        f = base.copy()
        f[k % 7] ^= np.uint64(1) << np.uint64(k % 60)
        prints.append((k, 0, f))
    for k in range(120):  # strangers in keys beside those of the group, every tenth of them near it
        f = rng.integers(0, 2**63, 7, np.uint64) if k % 10 else base.copy()
        w = np.uint64(0xFFFFF)
        f[k % 7] = f[k % 7] & ~w | (base[k % 7] ^ (np.uint64(1) << np.uint64(k % 20))) & w
        prints.append((1000 + k, 1000 + k, f))
    entries = spark.createDataFrame([(v, g, f.view(np.int64).tolist()) for v, g, f in prints], "v long, g long, fp array<long>")
    rows = []

    class Counted(simhash.Scratch):
        def cut(self, df):
            out = super().cut(df)
            if {"k", "v"} <= set(out.columns):
                rows.append(out.count())
            return out

    got = {frozenset((r["a"], r["b"])) for r in simhash.links(entries, Counted(spark), scheme).collect() if r["a"] != r["b"]}
    assert {x for pair in got for x in pair} == {0} | {1000 + k for k in range(0, 120, 10)}
    assert sum(rows) < 21 * len(prints)


def test_collocations_keep_only_phrases_on_disk(spark, monkeypatch):
    """Entries, sequences and names go once they are used, and no shuffle file of a written table stays."""
    from facetwise.llm import collocations as module

    made = []
    monkeypatch.setattr(module, "Scratch", lambda s: made.append(Scratch(s)) or made[0])
    docs = spark.createDataFrame([("a b c d", "en")] * 40 + [("b c d e", "en")] * 40, "text string, lang string")
    tables, total = module.phrases(docs, spark, shard_words=50)
    assert sorted(made[0].paths.values()) == sorted(made[0].paths[t] for t in (*tables, total))
    assert [t.count() for t in tables] == [5, 4, 3, 2] and total.first()["n"] == 320
