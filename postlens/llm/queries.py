"""The registered queries of these operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.llm import (
    decontaminate, divergence, interactions, language, licences, neardup, neighbours, packing, quality, setjoin, sharding, tokens,
    warc,
)
from postlens.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql
        return build

    return register


@query("op1_token_counts")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """Token counts of every document before and after three edits made from its own text: a passage of it comes again
    elsewhere, another one goes, a third is replaced."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    place = lambda k: F.pmod(F.xxhash64("doc_id", F.lit(k)), F.length("text") + 1)
    edit = lambda seq, start, length, insert: F.struct(
        F.lit(seq).alias("seq"), start.alias("start"), F.lit(length).alias("length"), insert.alias("insert")
    )
    edits = docs.where("text is not null").select("doc_id", F.explode(F.array(
        edit(1, place(1), 0, F.substring("text", (place(2) + 1).cast("int"), F.lit(24))),
        edit(2, place(3), 17, F.lit("")),
        edit(3, place(4), 9, F.lit(" as revised, ")),
    )).alias("e")).select("doc_id", "e.*")
    out = tokens.edited(tokens.counted(docs), edits)
    return out.select(
        "doc_id", "n_before", "n_tokens", "n_edits", "reencoded", F.length("text").alias("n_chars"),
        F.expr("size(chars) div 2").alias("n_leaves"),
    )


@query("op2_licence_scan")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """Licence families of every document, and the paragraphs they are in."""
    return licences.scanned(table(spark, folder, "documents"))


@query("op3_quality_classifier")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """A quality score of every document, learned from labels outside the held-out fold."""
    return quality.ranked(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op4_language_id")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document, learned outside the held-out fold."""
    return language.identified(table(spark, folder, "documents"))


@query("op5_ngram_jaccard_join", r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, array_to_string(w[k:k + 3], ' ') as g from (
  select doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) as k from w where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
o as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
link as (select a, b from o join n x on a = x.doc_id join n y on b = y.doc_id where 100 * c >= 85 * (x.n + y.n - c)),
sides as (select a, b from link union all select b, a from link),
reach as (select a, b from sides union select r.a, s.b from reach r join sides s on r.b = s.a)
select d.doc_id, coalesce(any_value(n.n), 0) as n_shingles, least(d.doc_id, min(r.b)) as component_id
from documents d left join n on d.doc_id = n.doc_id left join reach r on d.doc_id = r.a group by d.doc_id""")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents linked by 4-word shingles at a similarity of 0.85."""
    return setjoin.similar_groups(table(spark, folder, "documents"), width=4, percent=85)


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""


@query("op6_benchmark_decontamination", f"""
with d as (select doc_id, {_WORDS} as w from documents), b as (select item_id, {_WORDS} as w from benchmark),
win as (select distinct item_id, w[k:k + 12] as win from (
  select item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as k from b where len(w) > 0)),
hit as (select doc_id, k, n, item_id from (
  select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as k from d, (select distinct len(win) as n from win) where len(w) >= n)
  join win on win = w[k:k + n - 1]),
covered as (select doc_id, count(distinct p) as n_hit from (
  select doc_id, unnest(range(k, k + n)) as p from (select distinct doc_id, k, n from hit)) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as listed from (
  select distinct doc_id, cast(item_id as varchar) as item from hit) group by doc_id)
select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(listed, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join covered c on d.doc_id = c.doc_id left join items i on d.doc_id = i.doc_id""")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """How much of each document is windows of 13 words of the benchmark."""
    return decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("hits")


@query("op7_warc", """
with p as (select page_id, coalesce(html, '') as html, strlen(coalesce(html, '')) as payload_bytes from pages),
m as (select *, case when payload_bytes >= 1000 then max(page_id) over (partition by html) else page_id end as first from p)
select page_id, payload_bytes, sha1(html) as payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id <> first then first end as refers_to, cast(null as varchar) as error from m""")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """What comes back of every page that was written to archives."""
    return warc.round_trip(table(spark, folder, "pages")).drop("uri")


@query("op8_sharding")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """Documents placed on 64 shards by source; a source is spread over a thousand slots by id."""
    docs = table(spark, folder, "documents").select("doc_id", "source")
    shards = [f"shard-{i:02}" for i in range(64)]
    return sharding.placed(docs, shards, F.col("source"), spread=F.col("doc_id"))


@query("op9_packing")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """Batches of documents of similar length, in words of the whole texts."""
    return packing.packed(table(spark, folder, "documents"), packing.word_count(F.col("text")))


@query("op10_nearest_neighbours")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest vectors of every fiftieth vector."""
    return neighbours.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')"""


@query("op11_source_divergence", f"""
with d as (select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source, {_TERMS} as w from documents),
t as (select id, lang, source, unnest(w) as term from d),
kept as (select lang, term, count(*) as n from t group by lang, term having count(distinct id) >= 30),
langs as (select lang, count(term) as v, coalesce(sum(n), 0) as total from (select distinct lang from d) left join kept using (lang) group by lang),
own as (select lang, source, term, count(*) as n from t semi join kept using (lang, term) group by all),
grp as (select g.lang, g.source, v, l.total as lang_total, coalesce(sum(n), 0) as total from (select distinct lang, source from d) g
  join langs l using (lang) left join own o on g.lang = o.lang and g.source = o.source group by all),
p as (select g.lang, g.source, k.term, coalesce(o.n, 0) as n, 1 + 1000000000::hugeint * (coalesce(o.n, 0) + 5) // (g.total + 5 * v) as p,
  1 + 1000000000::hugeint * (k.n + 5) // (lang_total + 5 * v) as q
  from grp g join kept k on g.lang = k.lang left join own o on o.lang = g.lang and o.source = g.source and o.term = k.term),
found as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce((select sum(abs(x.p - y.p)) from p x join p y using (lang, term)
    where x.lang = a.lang and x.source = a.source and y.source = b.source), 0) as value
  from grp a join grp b on a.lang = b.lang and a.source <> b.source
  union all select lang, source, 'term', term, p - q from p where n > 0 and p > q),
ranks as (select *, row_number() over (partition by lang, source, part order by value desc, encode(item)) as rank from found)
select lang, source, part, item, value::bigint as value, rank::int as rank from ranks where part = 'pair' or rank <= 50""")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """How far the sources of each language are apart in their words, and what words each has more of."""
    return divergence.divergence(table(spark, folder, "documents"))


@query("op12_filter_interactions", r"""
with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w
  from documents),
m as (select doc_id, part, concat(case when len(w) < 200 then 'A' else '' end, case when 100 * len(list_distinct(w)) < 50 * len(w) then 'B' else '' end,
  case when 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t) then 'C' else '' end,
  case when regexp_matches(t, '[#$%&*|]') then 'D' else '' end,
  case when doc_id > min(doc_id) over (partition by t) then 'E' else '' end) as fails from d),
told as (select doc_id, max(quality = 1) as good, max(toxic = 1) as toxic from labels group by doc_id),
c as (select part, fails, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic
  from m left join told using (doc_id) group by part, fails),
f(x) as (values ('A'), ('B'), ('C'), ('D'), ('E')),
o as (select concat(a.x, b.x, c.x, d.x, e.x) as filter_order from f a, f b, f c, f d, f e where length(
  list_aggregate(list_distinct([a.x, b.x, c.x, d.x, e.x]), 'string_agg', '')) = 5),
s as (select filter_order, step, substr(filter_order, step, 1) as own, left(filter_order, step - 1) as before from o, range(1, 6) r(step)),
e as (select part, filter_order, step, own, n, good, toxic, fails, contains(fails, own) as failing,
  length(translate(fails, before, '')) = length(fails) as still from s, c),
a as (select part, filter_order, step::int as step, own, coalesce(sum(n) filter (still and not failing), 0)::bigint as kept,
  coalesce(sum(n) filter (still and failing), 0)::bigint as removed, coalesce(sum(n) filter (failing and not still), 0)::bigint as redundant,
  coalesce(sum(n) filter (fails = own), 0)::bigint as unique_fails, coalesce(sum(good) filter (still and failing), 0)::bigint as good_lost,
  coalesce(sum(toxic) filter (still and failing), 0)::bigint as toxic_lost from e group by part, filter_order, step, own)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) over (partition by part, own))::bigint as shapley from a""")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """What each of five filters removes, in every order of them."""
    return interactions.interactions(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op13_embedding_near_dedup", """
with recursive u as (select vec_id, label, embedding::double[] as v from embeddings where label is not null and embedding is not null
  and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
link as (select a.vec_id as a, b.vec_id as b from u a join u b on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v)
  where list_cosine_similarity(a.v, b.v) >= 0.98),
reach as (select a, b from link union select r.a, l.b from reach r join link l on r.b = l.a),
low as (select a, min(b) as b from reach group by a), n as (select a, count(*) as n from link group by a)
select vec_id, coalesce(n.n, 0) as n_links, least(vec_id, coalesce(low.b, vec_id)) as component_id, vec_id <= coalesce(low.b, vec_id) as kept
from embeddings left join low on vec_id = low.a left join n on vec_id = n.a""")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of vectors of one label with a cosine of 0.98 or more; the smallest id of each stays."""
    return neardup.near_duplicates(table(spark, folder, "embeddings"))
