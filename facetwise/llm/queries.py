"""The queries of the training-data operators over the driver's tables, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from facetwise.llm import collocations, decontam, divergence, embeddings, langid, licenses, mixing, pii, quality, simhash, tokens, toxicity, warc
from facetwise.llm.common import Scratch

QUERIES: dict = {}
ORACLES: dict = {}


#: The vocabulary that op1 counts with where spark.facetwise.vocabulary is not set.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The key of pseudonyms where spark.facetwise.pii.key is not set: for tests and demonstrations only.
DEMONSTRATION_KEY = "facetwise"


def pii_key(spark: SparkSession) -> str:
    return spark.conf.get("spark.facetwise.pii.key", DEMONSTRATION_KEY)


def _query(f):
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_table(spark, sf_dir, "documents"), spark)
    return out.selectExpr("doc_id", "lower(lpad(hex(fp[0]), 16, '0')) as fingerprint", "component_id")


@_query
def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), spark)
    return out.drop("spans", "items")


#: A-Z lower-cased, then the words of a text, as a DuckDB list.
_WORDS = """regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""

ORACLES["op2_benchmark_decontamination"] = f"""
with item as (
    select item_id, {_WORDS.format("coalesce(text, '')")} as w from benchmark),
phrase as (
    select distinct item_id, least(len(w), 13) as n,
        array_to_string(w[i : i + least(len(w), 13) - 1], ' ') as p
    from (select item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as i from item where len(w) > 0)),
doc as (select doc_id, {_WORDS.format("coalesce(text, '')")} as w from documents),
size as (select distinct n from phrase),
place as (
    select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as p
    from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from doc, size)),
hit as (
    select doc_id, item_id, i, n from place join phrase using (n, p)),
word as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + n)) as j from hit) group by 1),
own as (
    select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
    from (select distinct doc_id, cast(item_id as varchar) as item from hit) group by 1)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
    sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from doc left join word using (doc_id) left join own using (doc_id)
"""


@_query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = spark.conf.get("spark.facetwise.vocabulary", VOCABULARY)
    return tokens.suffix_sums(tokens.histogram(_table(spark, sf_dir, "documents"), spark, path=path))


@_query
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"), spark)


def _license_sql() -> str:
    """Words of templates and documents meet by word; a template's words are counted in each of its blocks."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    rows = lambda pairs: ", ".join(f"({k}, {quote(t)}, {quote(label)})" for k, (t, label) in enumerate(pairs))
    return f"""
with tpl as (select t, label, {_WORDS.format("text")} as w from (values {rows(licenses.TEMPLATES)}) v(t, text, label)),
tw as (
    select t, label, len(w) as step, len(list_distinct(w)) as size, cast(ceil({licenses.THRESHOLD} * len(list_distinct(w)) - 1e-9) as bigint) as need, unnest(list_distinct(w)) as word
    from tpl),
phr as (select label, {_WORDS.format("text")} as w from (values {rows(licenses.PHRASES.items())}) v(t, text, label)),
doc as (select row_number() over () as r, doc_id, {_WORDS.format("coalesce(text, '')")} as w from documents),
dw as (select r, unnest(w) as word, unnest(range(0, len(w))) as p from doc),
met as (
    select r, t, label, block, count(distinct word) / max(size) as share, count(distinct word) >= max(need) as ok
    from (select r, t, label, size, need, dw.word, unnest(list_distinct([greatest(p // step - 1, 0), p // step])) as block from dw join tw using (word))
    group by r, t, label, block),
own as (select r, list(distinct label) as labels, max(share) as share from met where ok group by r),
hit as (select d.r, p.label, d.p from dw d join phr p on d.word = p.w[1] join doc using (r) where doc.w[d.p + 1 : d.p + len(p.w)] = p.w),
base as (select r, count(*) as n, min(p) as lo, max(p) as hi, list(distinct label) as labels from hit group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n, 0) as n_base, lo as first_word, hi as last_word,
    coalesce(array_to_string(list_sort(base.labels), ','), '') as base_labels,
    coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(own.labels, [])))), ','), '') as labels,
    case when n is not null then 1.0::double else coalesce(share, 0.0::double) end as score
from doc left join base using (r) left join own using (r)
"""


ORACLES["op5_license_scan"] = _license_sql()


@_query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs, spark), spark)


@_query
def op4_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.pseudonymize(_table(spark, sf_dir, "documents"), key=pii_key(spark))
    return out.selectExpr("doc_id", "text", "cast(size(pii) as long) as n_found", "pii")


@_query
def op6_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.replicate(_table(spark, sf_dir, "documents"))


ORACLES["op6_poisson_mixing"] = """
with recursive
doc as (select *, coalesce(source, '') as s from documents),
rate as (
    select s, cast(1 as double) * (select count(*) from doc) * (cast(1 as double) / (select count(distinct s) from doc)) / count(*) as rate
    from doc group by s),
term as (
    select s, rate, 0 as i, exp(-rate) as p, exp(-rate) as c from rate
    union all
    select s, rate, i + 1, p * rate / (i + 1), p * rate / (i + 1) + c from term where i < ceil(rate + 12 * sqrt(rate) + 24)),
drawn as (
    select *, cast('0x' || substr(md5('mix-1:' || coalesce(cast(doc_id as varchar), '')), 1, 13) as bigint) / cast(4503599627370496 as double) as u
    from doc),
counted as (select d.*, (select count(*) from term t where t.s = d.s and t.c <= d.u) as n from drawn d)
select doc_id, text, lang, source, n_chars, cast(unnest(range(1, n + 1)) as integer) as mix_copy from counted
"""


@_query
def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"), spark)


ORACLES["op10_embedding_near_dedup"] = """
with recursive
v as (
    select vec_id, cast(embedding as double[]) as e from embeddings
    where embedding is not null and len(embedding) > 0
        and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))
        and list_bool_or(list_transform(embedding, lambda x: x <> 0))),
link as (
    select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
    where list_cosine_similarity(a.e, b.e) >= 0.9),
reach as (
    select vec_id as a, vec_id as b from embeddings
    union
    select r.a, l.b from reach r join link l on r.b = l.a),
low as (select a, min(b) as component_id from reach group by a),
n as (select a, count(*) as n_links from link group by a)
select vec_id, coalesce(n_links, 0) as n_links, component_id, component_id = vec_id as kept
from embeddings join low on vec_id = low.a left join n on vec_id = n.a
"""


@_query
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.scores(docs, quality.train(docs, spark)[1], spark)


@_query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.scores(docs, toxicity.train(docs, _table(spark, sf_dir, "labels"), spark), spark)


@_query
def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"), spark)


#: Every phrase by its words; the longer phrases that hold a phrase by all their parts.
ORACLES["op11_phrase_collocations"] = """
with piece as (
    select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
    from documents),
seq as (select lang, w from (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from piece) where len(w) > 0),
total as (select lang, cast(sum(len(w)) as bigint) as n from seq group by lang),
gram as (select lang, w[i : i + k - 1] as g from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from seq, (values (1), (2), (3), (4)) t(k))),
freq as (select lang, g, count(*) as f from gram group by lang, g having count(*) >= 30),
cand as (select * from freq where len(g) > 1),
cut as (select c.lang, c.g, c.f, k, x.f as l, y.f as r, (2000000::hugeint * c.f) // (x.f + y.f) as score
    from (select *, unnest(range(1, len(g))) as k from cand) c join freq x on x.lang = c.lang and x.g = c.g[1:k] join freq y on y.lang = c.lang and y.g = c.g[k + 1 :]),
best as (select * from cut qualify row_number() over (partition by lang, g order by score, k) = 1),
part as (
    select lang, g[i : i + k - 1] as g, max(f) as held
    from (select lang, g, f, k, unnest(range(1, len(g) - k + 2)) as i from cand, (values (2), (3)) t(k) where k < len(g)) group by all),
kept as (select b.*, array_to_string(b.g, ' ') as phrase from best b left join part using (lang, g) where held is null or 100 * held < 80 * b.f),
ranked as (select *, row_number() over (partition by lang order by score desc, f desc, phrase) as rank from kept)
select lang, rank, phrase, f as a, l, r, n, cast(score as bigint) as score from ranked join total using (lang) where rank <= 2000
"""


@_query
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"), spark)


#: Every share of every kept term, without a baseline.
ORACLES["op12_source_divergence"] = """
with doc as (
    select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w
    from documents),
occ as (select r, lang, source, unnest(w) as term from doc),
kept as (select lang, term, count(*) as ln from occ group by lang, term having count(distinct r) >= 3),
cell as (select lang, source, term, count(*) as n from occ semi join kept using (lang, term) group by all),
grp as (select distinct lang, source from doc),
size as (select lang, count(*) as v, sum(ln) as nl from kept group by lang),
own as (select lang, source, sum(n) as total from cell group by lang, source),
p as (
    select g.lang, g.source, k.term, coalesce(n, 0) as n,
        1 + (1000000000::hugeint * (coalesce(n, 0) + 1)) // (coalesce(total, 0) + v) as p, 1 + (1000000000::hugeint * (ln + 1)) // (nl + v) as q
    from grp g join kept k using (lang) join size using (lang) left join own using (lang, source) left join cell using (lang, source, term)),
pair as (
    select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value
    from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
part as (
    select a.lang, a.source, 'pair' as part, b.source as item, cast(coalesce(value, 0) as bigint) as value
    from grp a join grp b on a.lang = b.lang and a.source <> b.source left join pair x on x.lang = a.lang and x.source = a.source and x.item = b.source
    union all
    select lang, source, 'term', term, cast((p - q) * (p - q) // q as bigint) from p where n > 0 and p > q),
ranked as (select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as integer) as rank from part)
select * from ranked where part = 'pair' or rank <= 200
"""


@_query
def op13_warc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark).path()
    warc.register(spark)
    warc.records(_table(spark, sf_dir, "pages"), spark).write.format("warc").mode("append").save(path)
    return warc.archived(spark, path)


ORACLES["op13_warc_pages"] = """
with page as (select page_id, coalesce(html, '') as html, octet_length(encode(coalesce(html, ''))) as n from pages),
keeper as (select html, max(page_id) as keeper from page where n >= 1000 group by html)
select page_id, cast(n as bigint) as payload_bytes, sha1(html) as payload_digest, case when keeper is null or page_id = keeper then 'response' else 'revisit' end as record_type,
    case when page_id <> keeper then keeper end as refers_to
from page left join keeper using (html)
"""
