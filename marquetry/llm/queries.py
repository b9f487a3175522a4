"""The registered queries of the operators in this package, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_automaton, decontaminate, lexical, line_dedup, mixing, prefix_trie, quality, simhash, substring_dedup
from . import token_counts, topk, toxicity, url_filters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def number(col: Column | str, salt: str, span: int) -> Column:
    """A number below ``span`` from the MD5 of a text."""
    digest = F.md5(F.concat(F.lit(salt), col).cast("binary"))
    return (F.conv(F.substring(digest, 1, 7), 16, 10).cast("int") % span).cast("int")


def dated(col: Column, salt: str, span: int) -> Column:
    return F.date_add(F.lit("2024-01-01").cast("date"), number(col, salt, span))


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as captures: the day of a fetch follows from the id."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return pages.withColumn("fetched", dated(F.col("page_id").cast("string"), "fetch", 366))


def list_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List entries made from the URLs of the pages.

    Every host is blocked from one day on and allowed again from a later one; the folder of each page is allowed from
    some day on, and blocked from another; each URL is blocked from some day in the next two years.
    """
    url = F.col("url")
    pages = table(spark, sf_dir, "pages").select(
        url_filters.host_of(url).alias("host"),
        F.concat(url_filters.host_of(url), F.regexp_extract(url_filters.path_of(url), "^(/[^/]*/)?", 1)).alias("folder"),
        url_filters.whole_of(url).alias("whole"),
    )
    kinds = (
        ("domain", "host", "block", "a", 366), ("domain", "host", "allow", "b", 500),
        ("prefix", "folder", "allow", "c", 700), ("prefix", "folder", "block", "d", 900), ("url", "whole", "block", "e", 730),
    )
    out = None
    for kind, col, action, salt, span in kinds:
        names = pages.select(F.col(col).alias("name")).where("name is not null and name <> ''").distinct()
        part = names.select(F.lit(kind).alias("kind"), "name", F.lit(action).alias("action"), dated(F.col("name"), salt, span).alias("since"))
        out = part if out is None else out.unionAll(part)
    return out


URLS_SQL = r"""
with p as (
  select page_id, url, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)),
      '\.+$', '') as host,
    regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1) as path0,
    regexp_extract(url, '^[^?#]*(\?[^#]*)', 1) as qs,
    cast(date '2024-01-01' + cast(('0x' || substr(md5('fetch' || page_id), 1, 7))::bigint % 366 as integer) as date) as fetched
  from pages),
c as (select *, case when path0 = '' then '/' else path0 end as path from p),
names as (
  select distinct 'domain' as kind, host as name, 'block' as action, 'a' as salt, 366 as span from c
  union select 'domain', host, 'allow', 'b', 500 from c
  union select 'prefix', host || regexp_extract(path, '^(/[^/]*/)?', 1), 'allow', 'c', 700 from c
  union select 'prefix', host || regexp_extract(path, '^(/[^/]*/)?', 1), 'block', 'd', 900 from c
  union select 'url', host || path || qs, 'block', 'e', 730 from c),
daily as (
  select kind, name, since, max(action) as action from (
    select *, date '2024-01-01' + cast(('0x' || substr(md5(salt || name), 1, 7))::bigint % span as integer) as since
    from names where name <> '') group by 1, 2, 3),
ival as (select *, lead(since) over (partition by kind, name order by since) as until from daily),
keys as (
  select page_id, fetched, 'domain' as kind, array_to_string(l[i:], '.') as name, 1 as level from (
    select *, string_split(host, '.') as l, unnest(range(1, len(string_split(host, '.')) + 1)) as i from c)
  union all
  select page_id, fetched, 'prefix', host || array_to_string(s[1:i], '/') || '/', 2 from (
    select *, string_split(path, '/') as s, unnest(range(1, len(string_split(path, '/')))) as i from c)
  union all
  select page_id, fetched, 'url', host || path || qs, 3 from c),
best as (
  select k.page_id, i.action, i.kind, i.name, row_number() over (
    partition by k.page_id order by level desc, length(k.name) desc, k.name desc) as r
  from keys k join ival i on i.kind = k.kind and i.name = k.name
  where i.since <= k.fetched and (i.until is null or k.fetched < i.until))
select p.page_id, p.fetched, coalesce(b.action, 'allow') as action, b.kind as rule_kind, b.name as rule
from p left join best b on b.page_id = p.page_id and b.r = 1
"""


@query("op1_url_filters", URLS_SQL)
def op1(spark, sf_dir):
    judged = url_filters.judge(captures(spark, sf_dir), list_entries(spark, sf_dir))
    return judged.select("page_id", "fetched", "action", "rule_kind", "rule")


LINES_SQL = r"""
with ls as (
  select doc_id, p, unnest(l) as line, unnest(range(len(l))) as pos from (
    select doc_id, 0 as p, string_split(coalesce(text, ''), chr(10)) as l from documents)),
ks as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from ls),
ds as (select k, min(doc_id) as first from ks where length(k) >= 10 group by k having count(distinct doc_id) >= 2),
fs as (select ks.*, ds.first is not null and ds.first <> doc_id as gone from ks left join ds on ks.k = ds.k)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from fs group by doc_id
"""


@query("op2_line_dedup", LINES_SQL)
def op2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OVERLAP_SQL = r"""
with bench as (
  select cast(item_id as varchar) as item_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where text is not null),
wins as (
  select distinct item_id, n, array_to_string(w[i : i + n - 1], ' ') as g from (
    select item_id, w, least(len(w), 13) as n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as i
    from bench where len(w) > 0)),
docs as (
  select doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
grams as (
  select doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') as g from (
    select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as p from docs, (select distinct n from wins))),
found as (select doc_id, item_id, p, grams.n from grams join wins on grams.g = wins.g and grams.n = wins.n),
hit as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + n)) as q from found) group by 1),
own as (
  select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids
  from (select distinct doc_id, item_id from found) group by 1)
select docs.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from docs left join hit on hit.doc_id = docs.doc_id left join own on own.doc_id = docs.doc_id
"""


@query("op3_token_counts")
def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = token_counts.read_pieces(str(public_tokenizers.path("piece_bpe_32k.model")))
    counted = token_counts.prefix_token_counts(docs, pieces)
    return counted.select("doc_id", "n_bytes", "n_tokens", token_counts.over_budget(4096).alias("over_limit"))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


@query("op4_toxicity")
def op4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out()).select("doc_id", "toxic")
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    predicted = (F.col("score") >= 0.7).cast("int").alias("predicted")
    return scored.select("doc_id", held_out().alias("held_out"), "score", predicted)


PASSAGES_SQL = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
wins as (
  select doc_id, s, array_to_string(w[s : s + 19], ' ') as g from (
    select doc_id, w, unnest(range(1, len(w) - 18)) as s from d)),
ranked as (select doc_id, s, row_number() over (partition by g order by doc_id, s) as k from wins),
gone as (select distinct doc_id, unnest(range(s, s + 20)) as p from ranked where k > 1),
words as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from d),
kept as (
  select words.doc_id, string_agg(word, ' ' order by words.p) filter (where gone.p is null) as t, count(gone.p) as n
  from words left join gone on gone.doc_id = words.doc_id and gone.p = words.p group by 1)
select d.doc_id, len(w) as n_words, coalesce(n, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256
from d left join kept on kept.doc_id = d.doc_id
"""


@query("op6_substring_dedup", PASSAGES_SQL)
def op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = substring_dedup.dedup_substrings(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


TOP_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.e, c.e) as bigint) as score
  from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id and len(q.e) = len(c.e)),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 5
"""


@query("op7_topk", TOP_SQL)
def op7(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return topk.top_k(rows.where(F.col("vec_id") % 50 == 0), rows)


@query("op8_quality")
def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.classify(docs).select("doc_id", "score", (F.col("score") >= 0.5).alias("kept"))


@query("op10_simhash")
def op10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = simhash.near_duplicates(docs)
    fingerprint = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return found.select("doc_id", fingerprint, F.col("component").alias("component_id"))


def word_spec() -> str:
    return Path(public_tokenizers.path("word_bpe_49k.json")).read_text(encoding="utf-8")


@query("op9_bpe")
def op9(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_automaton.encode_digests(docs, word_spec()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query("op5_decontaminate", OVERLAP_SQL)
def op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_overlap(docs, table(spark, sf_dir, "benchmark"), spans=False)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        F.coalesce(decontaminate.contaminated("n_hit", "n_words"), F.lit(False)).alias("contaminated"),
    )


RANKED_SQL = r"""
with bench as (select item_id, unnest(regexp_extract_all(translate(text,'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from (select distinct item_id, text from benchmark)),
items as (select item_id, term, count(*) as times from bench group by 1, 2),
words as (select doc_id, unnest(regexp_extract_all(translate(text,'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents),
tfs as (select doc_id, term, count(*) as tf from words group by 1, 2),
lens as (select doc_id, cast(sum(tf) as bigint) as n from tfs group by 1),
tot as (select count(*) as nn, cast(sum(n) as bigint) as l from lens),
dfs as (select term, count(*) as df from tfs group by 1),
ws as (select term, cast(floor(1000 * ln((2 * nn + 2)::double / (2 * df + 1)::double)) as bigint) as w from dfs, tot),
ms as (select doc_id, 100 - 75 + (75 * n * nn) // l as m from lens, tot),
scored as (
  select item_id, doc_id, cast(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) as bigint) as score
  from items join tfs using (term) join ws using (term) join ms using (doc_id) group by 1, 2),
ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored where score > 0)
select item_id, cast(rank as integer) as rank, doc_id, score from ranked where rank <= 10
"""


@query("op11_lexical", RANKED_SQL)
def op11(spark, sf_dir):
    return lexical.rank(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents").select("doc_id", "text"))


TRIE_SQL = r"""
with t as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first,
      md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as i,
    coalesce(role, '') as role, coalesce(text, '') as text
  from conversations where conv_id is not null),
convs as (
  select conv_id, conv_id - conv_id % 100 as base, (4294967295 - list_reduce(
    list_concat([4294967295::bigint], flatten(list_transform(string_split(conv_id::varchar, ''), lambda s:
      [ord(s)::bigint, 0::bigint, 0::bigint, 0::bigint, 0::bigint, 0::bigint, 0::bigint, 0::bigint]))),
    lambda a, b: xor(xor(a, b) >> 1, 3988292384::bigint * (xor(a, b) & 1)))) % 6 as h
  from (select distinct conv_id from t)),
r as (
  select c.conv_id, 0 as part, t.i, role, text from convs c join t on t.conv_id = c.base and t.i <= c.h
  union all select t.conv_id, 1, t.i, role, text from t join convs c on t.conv_id = c.conv_id and t.i > c.h),
k as (select *, row_number() over (partition by conv_id order by part, i) as d from r),
l as (select conv_id, list(md5(length(role) || ':' || role || text) order by d) as ds from k group by 1),
m as (
  select conv_id, d, md5(array_to_string(ds[1:d], ' ')) as node, d = len(ds) as is_end from (
    select *, unnest(range(1, len(ds) + 1)) as d from l)
  union all select c.conv_id, 0, '', l.ds is null from convs c left join l using (conv_id)),
n as (
  select node, min(conv_id) as conv_id, min(d) as depth, count(*) as n_convs,
    string_agg(conv_id::varchar, ',' order by conv_id) filter (where is_end) as ends
  from m group by node),
e as (
  select n.*, p.conv_id as parent_conv_id, p.node as parent, coalesce(length(k.text), 0) as chars
  from n left join m on m.conv_id = n.conv_id and m.d = n.depth - 1 left join n p on p.node = m.node
  left join k on k.conv_id = n.conv_id and k.d = n.depth),
kids as (select parent, count(*) as n_children from e where parent is not null group by 1),
sums as (
  select m.node, count(*) filter (where kids.parent is null) as n_leaves, sum((e.n_convs - 1) * e.chars) as saved
  from e join m on m.conv_id = e.conv_id and m.d <= e.depth left join kids on kids.parent = e.node group by 1)
select e.conv_id, e.depth, e.parent_conv_id, e.n_convs, coalesce(n_children, 0) as n_children, n_leaves,
  cast(saved as bigint) as saved_tokens, sha256(coalesce(ends, '')) as ends_sha256
from e join sums using (node) left join kids on kids.parent = e.node
"""


@query("op12_prefix_trie", TRIE_SQL)
def op12(spark, sf_dir):
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


MIX_SQL = r"""
with d as (
  select *, row_number() over (partition by doc_id, source, size) - 1 as copy from (
    select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size from documents)),
s as (
  select source, row_number() over (order by source nulls last) - 1 as rank, cast(sum(size) as bigint) as source_size
  from d group by source),
w as (
  select *, [5, 2, 1][rank % 3 + 1] as weight, 2 * source_size as most, (2 * source_size)::double / [5, 2, 1][rank % 3 + 1] as ratio
  from s),
r as (
  select *, (1.5::double * sum(source_size) over () - coalesce(sum(most) over before, 0)::double)
    / (sum(weight) over () - coalesce(sum(weight) over before, 0))::double as level
  from w window before as (order by ratio, rank rows between unbounded preceding and 1 preceding)),
t as (
  select *, least(most::double, coalesce((select arg_min(level, (ratio, rank)) from r where ratio > level) * weight, most::double)) as target
  from r),
goal as (
  select source, source_size, rank, target, cast(floor(target + 0.5) as bigint) as want,
    case when source_size = 0 then 0 else cast(floor(target + 0.5) as bigint) // source_size end as full from t),
b as (
  select doc_id, copy, size, rank, pass, f, rest, block, least(512, size - 512 * block) as words,
    ('0x' || substr(md5(concat_ws('-', '17', pass, coalesce(doc_id::varchar, ''), copy, block)), 1, 15))::bigint as key
  from (
    select *, unnest(range((size + 511) // 512)) as block from (
      select d.*, g.rank, g.full as f, g.want - g.full * g.source_size as rest,
        unnest(range(g.full + case when g.want > g.full * g.source_size then 1 else 0 end)) as pass
      from d join goal g on g.source is not distinct from d.source))),
c as (
  select *, coalesce(sum(words) over (partition by rank, pass order by key, doc_id, size, copy, block
    rows between unbounded preceding and 1 preceding), 0) as sofar from b),
took as (
  select doc_id, copy, size, rank, sum(case when pass < f then words else greatest(least(words, rest - sofar), 0) end) as taken
  from c group by 1, 2, 3, 4)
select d.doc_id, d.size, g.source_size, g.target, cast(coalesce(took.taken, 0) as bigint) as taken
from d join goal g on g.source is not distinct from d.source
left join took on took.doc_id is not distinct from d.doc_id and took.copy = d.copy and took.size = d.size and took.rank = g.rank
"""


@query("op13_mixing", MIX_SQL)
def op13(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = mixing.words_taken(*mixing.mix(docs))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")
