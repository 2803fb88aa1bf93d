"""Collocations, source divergence, ranking and archives against brute force and round trips; odd rows of every kind."""

import base64
import gzip
import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from facetwise.llm import collocations, divergence, queries, ranking, warc
from facetwise.llm.common import Scratch

DOCS = "doc_id long, text string, lang string, source string, f string, name string, shard string"
LOWER = {c: c + 32 for c in range(65, 91)}


def odd_docs():
    rng = random.Random(11)
    words = ["a", "B", "b", "é", "É", "x-y", " ", "the", "The", "\x01", "ß"]
    rows = [(k, "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0b", ""]) for _ in range(rng.randrange(60))), rng.choice(["en", "de", None, "und"]), rng.choice(["s0", "s0", "s1", "s2", None, ""]), "x", None, "y") for k in range(150)]
    rows += [(200, None, "en", "s1", "x", None, "y"), (201, "", None, None, "x", None, "y"), (None, " . ! ", "en", "s3", "x", None, "y"), (202, "the end " * 3000, "en", "s1", "x", None, "y"), (203, "x" * 300_000, "de", "s2", "x", None, "y"), (204, "only here", "fr", "s9", "x", None, "y")]
    return rows + rows[:5]


# ---- 11 ----


def brute_collocations(rows, least, longest, share, top):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n["und" if lang is None else lang] += len(w)
            for k in range(1, longest + 1):
                f["und" if lang is None else lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        own = {g: a for g, a in counts.items() if 2 <= len(g) and a >= least}
        kept = []
        for g, a in own.items():
            if any(len(h) > len(g) and share * a <= 100 * b and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1)) for h, b in own.items()):
                continue
            score, k = min((2_000_000 * a // (counts[g[:k]] + counts[g[k:]]), k) for k in range(1, len(g)))
            kept.append((-score, -a, " ".join(g).encode(), counts[g[:k]], counts[g[k:]]))
        out += [(lang, r, p.decode(), -a, left, right, n[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize(("least", "longest", "share", "top", "size"), [(3, 4, 80, 2000, 2_000_000), (3, 4, 80, 7, 37), (2, 5, 60, 2000, 5), (4, 2, 80, 50, 100)])
def test_collocations_by_brute_force(spark, monkeypatch, least, longest, share, top, size):
    """Small shards cut texts anywhere; the phrases that cross a cut are counted once."""
    monkeypatch.setattr(collocations, "CHUNK", 16 if size < 50 else 1 << 20)
    rows = odd_docs()
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    got = collocations.collocations(df, spark, least=least, longest=longest, share=share, top=top, shard_words=size)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    mine = sorted(tuple(r) for r in got.collect())
    assert mine == brute_collocations(rows, least, longest, share, top) and len(mine) > 10


def test_collocations_of_nothing(spark):
    df = spark.createDataFrame([], DOCS)
    assert collocations.collocations(df, spark).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, None, None, None, "", "", "")], DOCS), spark, least=1).count() == 0


# ---- ranking ----


@pytest.mark.parametrize("k", [1, 3, 10])
def test_radix_select_with_ties(spark, k):
    rng = random.Random(k)
    rows = []
    for g in range(6):
        items = {"common prefix " * 40 + rng.choice("abcéÿ𝄞") * rng.randrange(6) + str(j) for j in range(rng.choice([0, 2, 30, 200]))} | {"", "a", "aa", "ab"}
        values = rng.choice([[5], [0, 2**59], [1, 2, 3], [rng.randrange(2**60) for _ in range(40)]])
        rows += [("l", None if g == 0 else f"s{g}", i, rng.choice(values)) for i in sorted(items)]
    rows = [(a, b or "", i, v) for a, b, i, v in rows]
    df = Scratch(spark).cut(spark.createDataFrame(rows, "lang string, source string, item string, value long").repartition(5))
    got = sorted((r["source"], r["rank"], r["item"], r["value"]) for r in ranking.top(df, ["lang", "source"], "value", "item", k, Scratch(spark)).collect())
    want = []
    for g in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == g), key=lambda r: (-r[3], r[2].encode()))[:k]
        want += [(g, n, r[2], r[3]) for n, r in enumerate(own, 1)]
    assert got == sorted(want)
    assert ranking.top(df.limit(0), ["lang", "source"], "value", "item", k, Scratch(spark)).count() == 0


# ---- 12 ----


def brute_divergence(rows, top):
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, *_ in rows:
        w = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        count[lang or "", source or ""].update(w)
        docs[lang or ""].update(set(w))
        groups.add((lang or "", source or ""))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, d in docs[lang].items() if d >= 3]
        sources = [s for x, s in groups if x == lang]
        p = {}
        for s in sources:
            total = sum(count[lang, s][t] for t in kept)
            p[s] = {t: 1 + 10**9 * (count[lang, s][t] + 1) // (total + len(kept)) for t in kept}
        whole = {t: sum(count[lang, s][t] for s in sources) for t in kept}
        q = {t: 1 + 10**9 * (n + 1) // (sum(whole.values()) + len(kept)) for t, n in whole.items()}
        far = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = sorted((-sum(far(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            terms = sorted((-far(p[s][t], q[t]), t.encode()) for t in kept if count[lang, s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, part, i.decode(), -v, r) for part, own in (("pair", pairs), ("term", terms)) for r, (v, i) in enumerate(own, 1)]
    return sorted(out)


@pytest.mark.parametrize("top", [200, 2])
def test_divergence_by_brute_force(spark, monkeypatch, top):
    monkeypatch.setattr(divergence, "HELD", 3)
    monkeypatch.setattr(divergence, "CHUNK", 10)
    rows = odd_docs()
    got = divergence.audit(spark.createDataFrame(rows, DOCS).repartition(3), spark, top=top)
    assert sorted(tuple(r) for r in got.select("lang", "source", "part", "item", "value", "rank").collect()) == brute_divergence(rows, top)


def test_divergence_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], DOCS), spark).count() == 0


def test_shares_are_exact_beyond_64_bits(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(10 ** rng.randrange(1, 13)), rng.randrange(10 ** rng.randrange(1, 13)), rng.randrange(1, 10 ** rng.randrange(1, 9))) for _ in range(300)]
    rows = [(n, max(n, total), kept) for n, total, kept in rows]
    df = spark.createDataFrame(rows, "n long, total long, kept long")
    got = df.select(divergence.share(F.col("n"), F.col("total"), F.col("kept")).alias("p")).collect()
    assert [r["p"] for r in got] == [1 + 10**9 * (n + 1) // (total + kept) for n, total, kept in rows]


# ---- 13 ----


def odd_pages(spark):
    big, hot = "<p>é</p>\r\n\r\nWARC/1.1\r\n" * 60, "h" * 1000
    rows = [(k, f"http://a.example/{k}", hot) for k in range(50)] + [(60, "http://b/\r\nx", big), (61, None, big), (62, "u", "short"), (63, "u", "short"), (64, "u", None), (65, "u", ""), (66, "é", "h" * 999), (None, "n", hot), (None, "n", "n" * 2000), (70, "u", "r" * 1500), (70, "v", "r" * 1500), (71, "u", "y" * 5_000_000)]
    return rows, spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, keeper string").repartition(4)


def archive(spark, df, **options):
    path = Scratch(spark).path()
    warc.register(spark)
    warc.records(df, spark).write.format("warc").options(**options).mode("append").save(path)
    return path


@pytest.mark.parametrize("options", [{}, {"compression": "none"}, {"file_bytes": "1", "level": "9"}])
def test_archives_round_trip(spark, options):
    rows, df = odd_pages(spark)
    path = archive(spark, df, **options)
    want = []
    for page, _, html in rows:
        own = (html or "").encode()
        top = max((r[0] for r in rows if (r[2] or "") == (html or "") and r[0] is not None), default=None)
        again = len(own) >= 1000 and page != top
        want.append((page, len(own), hashlib.sha1(own).hexdigest(), "revisit" if again else "response", top if again else None))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r) for r in warc.archived(spark, path).collect()), key=key) == sorted(want, key=key)
    got = spark.read.format("warc").load(path)
    urls = {r["record_id"]: (r["target_uri"], r["payload"]) for r in got.where("record_type = 'response'").collect()}
    assert bytes(urls["urn:page:61"][1]).decode() == "<p>é</p>\r\n\r\nWARC/1.1\r\n" * 60 and len(urls["urn:page:71"][1]) == 5_000_000
    assert got.where("record_id = 'urn:page:60'").first()["target_uri"] == "http://b/%0D%0Ax"
    assert got.where("record_type = 'warcinfo'").count() >= 1 and got.where("headers['content-length'] is null").count() == 0
    assert warc.archived(spark, archive(spark, df.limit(0))).count() == 0 if not options else True


def test_overwriting_replaces_the_files(spark):
    _, df = odd_pages(spark)
    path = archive(spark, df)
    warc.records(df.where("page_id = 62"), spark).write.format("warc").mode("overwrite").save(path)
    assert [r["page_id"] for r in warc.archived(spark, path).collect()] == [62]


def damaged(path, wanted: bytes):
    """Break the checksum of every gzip member of a record of some size that has not `wanted` in its headers."""
    raw, at, broken = bytearray(path.read_bytes()), 0, 0
    while at < len(raw):
        held = int.from_bytes(raw[at + 16 : at + 20], "little")
        whole = gzip.decompress(bytes(raw[at : at + held]))
        if len(whole) > 10_000 and wanted not in whole.partition(b"\r\n\r\n")[0]:
            raw[at + held - 8] ^= 0xFF
            broken += 1
        at += held
    path.write_bytes(bytes(raw))
    return broken


def test_unwanted_records_are_not_decoded(spark, tmp_path):
    """Predicates on headers are pushed down: the payloads of other records are damaged, and no reader notices."""
    rows = [("response", f"urn:r:{k}", f"http://x.example/{k}", chr(97 + k) * 20_000) for k in range(6)] + [("resource", "urn:r:9", None, "z" * 20_000)]
    df = spark.createDataFrame(rows, "record_type string, record_id string, target_uri string, payload string").coalesce(1)
    warc.register(spark)
    df.write.format("warc").mode("append").save(f"file://{tmp_path}/a")
    file = next((tmp_path / "a").glob("*.warc.gz"))
    assert damaged(file, b"http://x.example/3") == 6
    read = lambda schema: spark.read.format("warc").schema(schema).load(f"file://{tmp_path}/a")
    full = "record_type string, record_id string, target_uri string, payload binary"
    for test in ("target_uri = 'http://x.example/3'", "target_uri like '%/3' and record_type = 'response'", "record_id in ('urn:r:3', 'nothing') and target_uri is not null", "target_uri >= 'http://x.example/3' and target_uri < 'http://x.example/4'"):
        got = read(full).where(test).collect()
        assert [(r["record_id"], len(r["payload"])) for r in got] == [("urn:r:3", 20_000)]
    assert read("record_type string, block_length long").groupBy("record_type").agg(F.count("*").alias("n")).where("record_type = 'response'").first()["n"] == 6
    with pytest.raises(Exception, match="not a readable archive"):
        read(full).collect()


def test_foreign_archives(spark, tmp_path):
    digest = base64.b32encode(hashlib.sha1(b"body").digest())
    one = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nwarc-target-uri: http://x\r\n /folded\r\nWARC-Payload-Digest: sha1:" + digest + b"\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: 38\r\nX-Depth: 7\r\n\r\nHTTP/1.1 200 OK\r\nServer: x-y-z-0\r\n\r\nbod"[:-3] + b"body" + b"\r\n\r\n"
    length = len(one.partition(b"\r\n\r\n")[2]) - 4
    one = one.replace(b"Content-Length: 38", b"Content-Length: %d" % length)
    two = b"WARC/1.0\r\nWARC-Type: metadata\r\nContent-Length: 5\r\n\r\nk: v\n\r\n\r\n"
    (tmp_path / "plain.warc").write_bytes(one + two)
    (tmp_path / "whole.warc.gz").write_bytes(gzip.compress(two + one + two))
    (tmp_path / "members.warc.gz").write_bytes(gzip.compress(two) + gzip.compress(one))
    (tmp_path / "_part.warc").write_bytes(b"not read")
    warc.register(spark)
    read = lambda: spark.read.format("warc").schema("record_type string, record_id string, target_uri string, payload_digest string, payload binary, depth int, ip_address string").load(str(tmp_path))
    got = read()
    rows = got.where("record_type = 'response'").collect()
    assert len(rows) == 3 and all((r["record_id"], r["target_uri"], r["payload_digest"], bytes(r["payload"]), r["depth"], r["ip_address"]) == ("urn:uuid:1", "http://x /folded", hashlib.sha1(b"body").hexdigest(), b"body", 7, None) for r in rows)
    assert sorted(bytes(r["payload"]) for r in got.where("depth is null").collect()) == [b"k: v\n"] * 4
    (tmp_path / "short.warc.gz").write_bytes(gzip.compress(one)[:-20])
    with pytest.raises(Exception, match="short.warc.gz"):
        read().collect()


def test_new_queries_over_whole_tables(spark):
    """The registered queries hold each row of their tables."""
    sf = "/root/testdata/sf0.001"
    assert queries.QUERIES["op13_warc_pages"](spark, sf).count() == spark.read.parquet(f"{sf}/pages.parquet").count()
    groups = spark.read.parquet(f"{sf}/documents.parquet").select("lang", "source").distinct().count()
    assert queries.QUERIES["op12_source_divergence"](spark, sf).select("lang", "source").distinct().count() == groups
