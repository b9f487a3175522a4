"""Profiling, mapping, coercion, merging, de-duplication, derivation and features."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquetry.functions import metrics as M
from marquetry.functions import parsing as P
from marquetry.operators import dedupe as E
from marquetry.operators import derive as D
from marquetry.operators import features as G
from marquetry.operators import fuzzy, mapping, merge
from marquetry.operators import reports as I
from marquetry.sources import profile, readers
from suite.items import YEARS, items, joined, over_items, query, r6, stored, table

# -- sources and profiling ----------------------------------------------------------


@query("a05_null_counts", over_items("select " + ", ".join(f"count(*) - count({c}) as {c}" for c in ("item_id", "price", "owners", "ratio", "total_reviews")) + " from items"))
def _(spark, sf):
    return readers.null_counts(items(spark, sf).select("item_id", "price", "owners", "ratio", "total_reviews"))


@query("a08_count_distinct", "select count(distinct l_partkey) as distinct_count from lineitem")
def _(spark, sf):
    return profile.count_distinct(table(spark, sf, "lineitem"), "l_partkey")


@query("a09_random_sample")
def _(spark, sf):
    return profile.sample_n(items(spark, sf), 100, seed=7, key="item_id").select("item_id", "price")


@query("a09_sample_facts", over_items("select least(count(*), 100) as rows, least(count(*), 100) as distinct_rows, true as members from items"))
def _(spark, sf):
    """A sample has the wanted size, no repeats, and only rows of the table."""
    drawn = profile.sample_n(items(spark, sf), 100, seed=7, key="item_id").select("item_id", "price")
    met = drawn.join(items(spark, sf).select(F.col("item_id").alias("i"), F.col("price").alias("p")), F.col("item_id") == F.col("i"), "left")
    return met.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("item_id").alias("distinct_rows"),
        F.every(F.col("i").isNotNull() & F.col("price").eqNullSafe(F.col("p"))).alias("members"),
    )


@query(
    "a10_flatten_records",
    """select c_custkey, c_nationkey as "home.nation", 'NestedDict[2 keys]' as "home.more",
  'List[' || len(string_split(c_name, '0')) || ']: ' || replace(cast(to_json(string_split(c_name, '0')[1:3]) as varchar), ' ', '') || '...' as parts from customer""",
)
def _(spark, sf):
    nested = table(spark, sf, "customer").select(
        "c_custkey",
        F.struct(F.col("c_nationkey").alias("nation"), F.struct("c_mktsegment", "c_acctbal").alias("more")).alias("home"),
        F.split("c_name", "0").alias("parts"),
    )
    return profile.flatten(nested, max_depth=1)


# -- mapping ------------------------------------------------------------------------


@query("b01_apply_mappings", "select p_partkey as appid, upper(p_name) as name, p_retailprice / 100.0 as price from part")
def _(spark, sf):
    rules = [("p_partkey", "appid", None), ("p_name", "name", F.upper), ("p_retailprice", "price", P.cents_to_units)]
    return mapping.apply_mappings(table(spark, sf, "part"), rules, keep_only=True)


@query("b02_drop_columns", "select c_custkey, c_acctbal from customer")
def _(spark, sf):
    return mapping.drop_columns(table(spark, sf, "customer"), ["c_name", "c_nationkey", "c_mktsegment"])


@query("b03_rename_columns", "select r_regionkey as region_id, r_name as region from region")
def _(spark, sf):
    return mapping.rename_columns(table(spark, sf, "region"), {"r_regionkey": "region_id", "r_name": "region"})


@query("b04_select_prefixed", "select s_suppkey as hltb_s_suppkey, s_acctbal as hltb_s_acctbal from supplier")
def _(spark, sf):
    return mapping.select_prefixed(table(spark, sf, "supplier"), ["s_suppkey", "s_acctbal"], "hltb_")


@query("b05_split_list", "select p_partkey, array_to_string(string_split(p_name, ' '), '|') as words from part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", joined(P.split_list("p_name", " "), "words"))


@query("b06_count_items", "select doc_id, cast(len(string_split(text, '.')) as integer) as sentences from documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", P.count_items("text", ".").alias("sentences"))


@query("b07_range_midpoint", "select l_orderkey, l_linenumber, case when l_linenumber = 2 then 0.0 else (l_partkey + l_suppkey) / 2.0 end as midpoint from lineitem")
def _(spark, sf):
    text = F.when(F.col("l_linenumber") == 2, "n/a - x").otherwise(F.format_string("%d - %d", "l_partkey", "l_suppkey"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", P.range_midpoint(text).alias("midpoint"))


@query("b08_normalize_range", "select o_orderkey, cast(o_orderkey * 1000 as varchar) || ' - ' || cast(o_custkey * 1000 as varchar) as owners from orders")
def _(spark, sf):
    text = F.concat(F.format_number(F.col("o_orderkey") * 1000, 0), F.lit(" .. "), F.format_number(F.col("o_custkey") * 1000, 0))
    return table(spark, sf, "orders").select("o_orderkey", P.normalize_range(text).alias("owners"))


@query("b09_membership_flags", over_items("select item_id, list_contains(tags, 'ring') as ring, list_contains(tags, 'bolt') as bolt from items"))
def _(spark, sf):
    return items(spark, sf).select("item_id", *P.flags_from("tags", {"ring": "ring", "bolt": "bolt"}, is_array=True))


@query("b10_cents_to_units", "select o_orderkey, case when o_orderkey % 3 = 0 then null else o_custkey / 100.0 end as price from orders")
def _(spark, sf):
    text = F.when(F.col("o_orderkey") % 3 == 0, "free").otherwise(F.col("o_custkey").cast("string"))
    return table(spark, sf, "orders").select("o_orderkey", P.cents_to_units(text).alias("price"))


@query("b11_null_if_out_of_range", "select l_orderkey, l_linenumber, case when l_quantity < 30 then l_quantity end as quantity from lineitem")
def _(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", P.null_if_out_of_range("l_quantity", 30).alias("quantity"))


@query("b12_null_if_sentinel", "select p_partkey, case when p_size % 2 = 0 then null else cast(p_size as double) end as score from part")
def _(spark, sf):
    text = F.when(F.col("p_size") % 2 == 0, "False").otherwise(F.col("p_size").cast("string"))
    return table(spark, sf, "part").select("p_partkey", P.null_if_sentinel(text).alias("score"))


@query("b13_map_key_list", "select event_id, array_to_string(json_keys(props), '|') as keys from events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", joined(P.map_key_list("props"), "keys"))


@query("b14_sort_columns", "select n_name, n_nationkey, n_regionkey from nation")
def _(spark, sf):
    return mapping.sort_columns(table(spark, sf, "nation"))


# -- coercion -----------------------------------------------------------------------

_TEXT = "case when o_orderkey % 5 = 0 then 'abc' when o_orderkey % 5 = 1 then '' when o_orderkey % 5 = 2 then cast(o_custkey as varchar) || '.5' else cast(o_custkey as varchar) end"


def _texts(spark, sf):
    k = F.col("o_orderkey") % 5
    number = F.col("o_custkey").cast("string")
    text = F.when(k == 0, "abc").when(k == 1, "").when(k == 2, F.concat(number, F.lit(".5"))).otherwise(number)
    return table(spark, sf, "orders").select("o_orderkey", text.alias("t"))


@query("c01_to_double", f"select o_orderkey, try_cast({_TEXT} as double) as v from orders")
def _(spark, sf):
    return _texts(spark, sf).select("o_orderkey", P.to_double("t").alias("v"))


@query("c02_to_long", f"select o_orderkey, cast(trunc(try_cast({_TEXT} as double)) as bigint) as v from orders")
def _(spark, sf):
    return _texts(spark, sf).select("o_orderkey", P.to_long("t").alias("v"))


@query("c03_to_bool", "select o_orderkey, case o_orderkey % 4 when 0 then true when 1 then false end as v from orders")
def _(spark, sf):
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, "True").when(k == 1, "false").when(k == 2, "1").otherwise("yes")
    return table(spark, sf, "orders").select("o_orderkey", P.to_bool(text).alias("v"))


@query("c04_to_text", "select p_partkey, case when p_size > 10 then p_name end as name from part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", P.to_text(F.when(F.col("p_size") > 10, F.col("p_name"))).alias("name"))


@query(
    "c05_parse_date",
    """select o_orderkey, case when o_orderkey % 8 < 4 then cast(o_orderdate as date) when o_orderkey % 8 < 6 then cast(date_trunc('month', o_orderdate) as date) end as d from orders""",
)
def _(spark, sf):
    k, d = F.col("o_orderkey") % 8, F.col("o_orderdate")
    patterns = ["yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "MMM d, yyyy", "MMMM d, yyyy", "MMMM yyyy", "MMM yyyy"]
    text = F.when(k == 6, "Coming soon")
    for i, p in enumerate(patterns):
        text = text.when(k == i, F.date_format(d, p))
    return table(spark, sf, "orders").select("o_orderkey", P.parse_date(text).alias("d"))


@query("c06_to_date", "select o_orderkey, case when o_orderkey % 2 = 0 then cast(o_orderdate as date) end as d from orders")
def _(spark, sf):
    text = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("soon")
    return table(spark, sf, "orders").select("o_orderkey", P.to_date(text).alias("d"))


@query("c07_normalize_list", "select p_partkey, array_to_string(list_sort(list_distinct(list_concat(string_split(p_name, ' '), ['it''s', lower(p_type)]))), '|') as words from part")
def _(spark, sf):
    words = F.array_join(F.transform(F.split("p_name", " "), lambda w: F.concat(F.lit("'"), F.upper(w), F.lit("'"))), ", ")
    text = F.concat(F.lit("["), words, F.lit(", \"It's\", '"), F.col("p_type"), F.lit("']"))
    return table(spark, sf, "part").select("p_partkey", joined(P.normalize_list(text), "words"))


_VOCAB = ("bolt", "gear", "olt", "ring", "widget", "blue")


@query(
    "c08_normalize_vocab",
    """with w as (select p_partkey, unnest(string_split(p_name, ' ')) || case when p_partkey % 2 = 0 then ' kit' else '' end as w from part),
v as (select unnest(['bolt', 'gear', 'olt', 'ring', 'widget', 'blue']) as v),
m as (select p_partkey, case when w in (select v from v) then w else (select min(v) from v where contains(w, v)) end as t from w)
select p_partkey, coalesce(array_to_string(list_sort(list_distinct(list(t) filter (t is not null))), '|'), '') as words from m group by 1""",
)
def _(spark, sf):
    suffix = F.when(F.col("p_partkey") % 2 == 0, " kit").otherwise("")
    words = F.transform(F.split("p_name", " "), lambda w: F.concat(w, suffix))
    return table(spark, sf, "part").select("p_partkey", joined(P.normalize_vocab(words, _VOCAB), "words"))


@query("c09_parse_list_or_empty", "select p_partkey, case when p_size % 2 = 0 then 2 else 0 end as n from part")
def _(spark, sf):
    text = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("['"), F.col("p_name"), F.lit("', 'x']"))).otherwise("no list [")
    return table(spark, sf, "part").select("p_partkey", F.size(P.parse_list_or_empty(text)).alias("n"))


@query("c10_row_mean", over_items("select item_id, round(case when price is null and owners is null and ratio is null then null else (coalesce(price, 0) + coalesce(owners, 0) + coalesce(ratio, 0)) / ((price is not null)::int + (owners is not null)::int + (ratio is not null)::int) end, 6) as mean from items"))
def _(spark, sf):
    return items(spark, sf).select("item_id", r6(P.row_mean("price", "owners", "ratio"), "mean"))


@query("c11_scale", "select l_orderkey, l_linenumber, l_quantity / 5.0 as score from lineitem")
def _(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", P.scale("l_quantity", 5).alias("score"))


@query("c12_replace_in_list", over_items("select item_id, replace(replace(array_to_string(tags, '|'), 'ring', 'circle'), 'cle', 'CLE') as tags from items"))
def _(spark, sf):
    return items(spark, sf).select("item_id", joined(P.replace_in_list("tags", {"ring": "circle", "cle": "CLE"}), "tags"))


@query("c13_enforce_schema", "select o_orderkey, try_cast(o_orderpriority as double) as o_orderpriority, cast(trunc(o_totalprice) as bigint) as o_totalprice from orders")
def _(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    out, _report = mapping.enforce_schema(rows, {"o_orderpriority": P.to_double, "o_totalprice": P.to_long})
    return out


@query("c14_recode", "select o_orderkey, case o_orderstatus when 'F' then '1. Done' when 'O' then '2. Open' else 'unknown' end as status from orders")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", P.recode("o_orderstatus", {"F": "1. Done", "O": "2. Open"}, "unknown").alias("status"))


# -- joins and merges ---------------------------------------------------------------


def _master(spark, sf):
    rows = items(spark, sf).where("factor <> '2-HIGH'")
    return rows.select(
        "item_id", F.when(F.col("item_id") % 4 != 0, F.col("price")).alias("price"), "pos",
        F.when(F.col("item_id") % 5 == 0, "").otherwise(F.col("factor")).alias("factor"), "tags", "model",
    )


def _incoming(spark, sf):
    rows = items(spark, sf).where("model <> 'F'")
    return rows.select(
        "item_id", (F.col("price") + 1).alias("price"), F.col("neg").alias("pos"), F.col("model").alias("factor"),
        F.array(F.lit("zeta"), F.lit("ring")).alias("tags"), F.col("release_year").alias("year"),
    )


_MERGE = {
    "m": "select item_id, case when item_id % 4 <> 0 then price end as price, pos, case when item_id % 5 = 0 then '' else factor end as factor, tags, model from items where factor <> '2-HIGH'",
    "s": "select item_id, price + 1 as price, neg as pos, model as factor, ['zeta', 'ring'] as tags, release_year as year from items where model <> 'F'",
}
_MERGED = """select coalesce(m.item_id, s.item_id) as item_id, round(case when m.price is null or m.price = 0 then s.price else m.price end, 6) as price,
  case when m.pos is null or m.pos = 0 then s.pos else m.pos end as pos, case when m.factor is null or m.factor = '' then s.factor else m.factor end as factor,
  array_to_string(list_sort(case when m.tags is not null and s.tags is not null then list_distinct(list_concat(m.tags, s.tags)) else m.tags end), '|') as tags,
  m.model, s.year from m full join s on m.item_id = s.item_id"""


def _shown(df):
    return df.select("item_id", r6("price"), "pos", "factor", joined(F.array_sort("tags"), "tags"), *[c for c in ("model", "year") if c in df.columns])


@query("d01_merge_sources", over_items(_MERGED, **_MERGE))
def _(spark, sf):
    return _shown(merge.merge_sources(_master(spark, sf), _incoming(spark, sf), "item_id", {"tags": merge.union_lists}))


@query(
    "d01_merge_repeated_keys",
    """with m as (select case when c_nationkey < 8 then 0 else c_nationkey end as k, c_custkey as id, c_acctbal as balance from customer),
s as (select case when s_nationkey < 8 then 0 else s_nationkey + 2 end as k, s_suppkey as sid, s_acctbal as balance from supplier)
select coalesce(m.k, s.k) as k, id, case when m.balance is null or m.balance = 0 then s.balance else m.balance end as balance, sid
from m full join s on m.k = s.k""",
)
def _(spark, sf):
    """A third of the rows of both sides share one key."""
    hot = lambda k, other: F.when(F.col(k) < 8, 0).otherwise(other).alias("k")
    m = table(spark, sf, "customer").select(hot("c_nationkey", F.col("c_nationkey")), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    s = table(spark, sf, "supplier").select(hot("s_nationkey", F.col("s_nationkey") + 2), F.col("s_suppkey").alias("sid"), F.col("s_acctbal").alias("balance"))
    return merge.merge_sources(m, s, "k", block=64)


@query("d02_is_empty", over_items("select item_id, price is null or price = 0 as no_price, len(tags) = 0 as no_tags, pos is null or pos = 0 as no_pos, not (model = 'F') as not_flagged from items"))
def _(spark, sf):
    rows = items(spark, sf).withColumn("flag", F.col("model") == "F")
    types = {f.name: f.dataType for f in rows.schema.fields}
    shown = {"no_price": "price", "no_tags": "tags", "no_pos": "pos", "not_flagged": "flag"}
    return rows.select("item_id", *[merge.is_empty(F.col(c), types[c]).alias(n) for n, c in shown.items()])


_THIRD = "select item_id, price * 2 as price, 'third' as factor, ['omega'] as tags from items where release_year >= 1998"
_MERGED3 = """select coalesce(a.item_id, t.item_id) as item_id, round(case when a.price is null or a.price = 0 then t.price else a.price end, 6) as price, a.pos,
  case when a.factor is null or a.factor = '' then t.factor else a.factor end as factor,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(a.tags, []), coalesce(t.tags, [])))), '|') as tags, a.model, a.year from a full join t on a.item_id = t.item_id"""
_FOLD = {
    **_MERGE,
    "a": _MERGED.replace("round(case when m.price is null or m.price = 0 then s.price else m.price end, 6)", "case when m.price is null or m.price = 0 then s.price else m.price end").replace(
        "array_to_string(list_sort(case when m.tags is not null and s.tags is not null then list_distinct(list_concat(m.tags, s.tags)) else m.tags end), '|')",
        "list_distinct(list_concat(coalesce(m.tags, []), coalesce(s.tags, [])))",
    ),
    "t": _THIRD,
}


def _sources(spark, sf):
    third = items(spark, sf).where("release_year >= 1998").select("item_id", (F.col("price") * 2).alias("price"), F.lit("third").alias("factor"), F.array(F.lit("omega")).alias("tags"))
    union = {"tags": merge.union_lists_or_either}
    return [(_master(spark, sf), {}), (_incoming(spark, sf), union), (third, union)]


@query("d05_merge_all_one_shuffle", over_items(_MERGED3, **_FOLD))
def _(spark, sf):
    return _shown(merge.merge_all(_sources(spark, sf), "item_id"))


@query("d05_merge_fold", over_items(_MERGED3, **_FOLD))
def _(spark, sf):
    return _shown(merge.merge_fold(_sources(spark, sf), "item_id"))


@query("d06_left_join_by_name", "select p.p_partkey, t.size from part p left join (select p_name, min(p_size) as size from part where p_size > 25 group by 1) t using (p_name)")
def _(spark, sf):
    parts = table(spark, sf, "part")
    times = parts.where("p_size > 25").select(F.col("p_name").alias("title"), F.col("p_size").alias("size"))
    return merge.left_join_by_name(parts, times, "p_name", "title").select("p_partkey", "size")


@query("d07_outer_counts", over_items("select release_date, coalesce(a.a, 0) as a, coalesce(b.b, 0) as b from (select release_date, count(*) a from items where model = 'P' group by 1) a full join (select release_date, count(*) b from items where price = 0 group by 1) b using (release_date)"))
def _(spark, sf):
    rows = items(spark, sf)
    return merge.outer_counts(
        I.count_by(rows.where("model = 'P'"), ["release_date"], "a"), I.count_by(rows.where("price = 0"), ["release_date"], "b"), "release_date"
    )


_BAND = over_items(
    "select center, count(*) as n, round(sum(price), 2) as total from items, g where price between center - half and center + half group by 1",
    g="select cast(range * 25 as double) as center, 5.0 + range as half from range(20)",
)


def _grid(spark):
    return spark.range(20).select((F.col("id") * 25).cast("double").alias("center"), (F.col("id") + 5.0).alias("half"))


@query("d08_band_join", _BAND)
def _(spark, sf):
    hits = merge.band_join(items(spark, sf).select("item_id", "price"), _grid(spark), "price", "center", "half")
    return hits.groupBy("center").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("price"), 2).alias("total"))


@query("d08_band_join_large_grid", _BAND)
def _(spark, sf):
    hits = merge.band_join(items(spark, sf).select("item_id", "price"), _grid(spark), "price", "center", "half", max_grid=None)
    return hits.groupBy("center").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("price"), 2).alias("total"))


@query("d08_band_join_mixed_widths", over_items(
    "select center, count(*) as n, round(sum(price), 2) as total from items, g where price between center - half and center + half group by 1",
    g="select cast(range * 5 as double) as center, case when range % 10 = 0 then 1000.0 else 0.25 + range % 3 end as half from range(100)",
))
def _(spark, sf):
    """Ten windows over the whole axis among ninety narrow ones."""
    half = F.when(F.col("id") % 10 == 0, 1000.0).otherwise(F.col("id") % 3 + 0.25)
    grid = spark.range(100).select((F.col("id") * 5).cast("double").alias("center"), half.alias("half"))
    hits = merge.band_join(items(spark, sf).select("item_id", "price"), grid, "price", "center", "half", max_grid=100)
    return hits.groupBy("center").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("price"), 2).alias("total"))


@query("d09_union_rows", "select c_custkey as id, c_acctbal as balance from customer union all select s_suppkey, s_acctbal from supplier")
def _(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    return merge.union_rows(a, table(spark, sf, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("id")))


@query("d10_join_columns", "select doc_id, n_chars, quality from documents join labels using (doc_id)")
def _(spark, sf):
    return merge.join_columns(table(spark, sf, "documents").select("doc_id", "n_chars"), table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")


@query(
    "d11_fuzzy_lookup",
    """with t as (select distinct p_name as text from part), v as (select distinct unnest(string_split(p_name, ' ')) as match from part),
s as (select text, match, 1 - levenshtein(text, match) / cast(greatest(len(text), len(match), 1) as double) as score from t, v)
select text, cast(k as integer) as rank, match, round(score, 6) as score from (select *, row_number() over (partition by text order by score desc, match) as k from s) where k <= 2""",
)
def _(spark, sf):
    parts = table(spark, sf, "part")
    words = parts.select(F.explode(F.split("p_name", " ")).alias("w")).distinct()
    return fuzzy.fuzzy_lookup(parts, "p_name", words, k=2).select("text", "rank", "match", r6("score"))


@query(
    "d11_fuzzy_misspelt",
    """with v as (select distinct c_name as match from customer),
t as (select distinct substr(c_name, 1, 4) || '0' || substr(c_name, 6, 3) || substr(c_name, 10) as text from customer),
s as (select text, match, 1 - levenshtein(text, match) / cast(greatest(len(text), len(match), 1) as double) as score from t, v)
select text, cast(k as integer) as rank, match, round(score, 6) as score from (select *, row_number() over (partition by text order by score desc, match) as k from s) where k <= 3""",
)
def _(spark, sf):
    names = table(spark, sf, "customer").select("c_name")
    text = F.concat(F.substring("c_name", 1, 4), F.lit("0"), F.substring("c_name", 6, 3), F.substring("c_name", 10, 100))
    return fuzzy.fuzzy_lookup(names.select(text.alias("text")), "text", names, k=3).select("text", "rank", "match", r6("score"))


# -- duplicates ---------------------------------------------------------------------


@query("e01_duplicate_keys", "select l_orderkey, count(*) as rows from lineitem group by 1 having count(*) > 1")
def _(spark, sf):
    return E.duplicate_keys(table(spark, sf, "lineitem"), "l_orderkey")


@query("e02_group_size", over_items("select item_id, case when price is null then 1 else count(*) over (partition by model, price) end as group_count from items"))
def _(spark, sf):
    return E.with_group_size(items(spark, sf), ["model", "price"]).select("item_id", "group_count")


@query("e03_minmax_in_group", over_items("select item_id, round(case when max(owners) over g = min(owners) over g then 1 else (owners - min(owners) over g) / (max(owners) over g - min(owners) over g) end, 6) as score from items window g as (partition by release_year, model)"))
def _(spark, sf):
    return E.minmax_in_group(items(spark, sf), "owners", ["release_year", "model"], "score", max_groups=YEARS * 3).select("item_id", r6("score"))


_KEYS = "partition by model, release_date"
_SCORE = f"""select *, 2 * coalesce(case when owners is null then null when max(owners) over g = min(owners) over g then 1 else (owners - min(owners) over g) / (max(owners) over g - min(owners) over g) end, 0)
  + coalesce(case when pos is null then null when max(pos) over g = min(pos) over g then 1 else (pos - min(pos) over g) / cast(max(pos) over g - min(pos) over g as double) end, 0)
  + case when max(len(tags)) over g = min(len(tags)) over g then 1 else (len(tags) - min(len(tags)) over g) / cast(max(len(tags)) over g - min(len(tags)) over g as double) end as score
from items window g as ({_KEYS})"""
_PARTS = {"owners": 2.0, "pos": 1.0, "tags": 1.0}


@query("e04_completeness_score", over_items("select item_id, round(score, 6) as score from c", c=_SCORE))
def _(spark, sf):
    return E.completeness_score(items(spark, sf), ["model", "release_date"], _PARTS, "score").select("item_id", r6("score"))


@query(
    "e05_collapse_duplicates",
    over_items(
        f"""select model, release_date, arg_max(item_id, r) as item_id, arg_max(price, r) filter (price is not null) as price, arg_max(owners, r) filter (owners is not null) as owners,
  coalesce(array_to_string(arg_max(tags, r) filter (len(tags) > 0), '|'), '') as tags from (select *, row_number() over ({_KEYS} order by score, item_id) as r from c) group by 1, 2""",
        c=_SCORE,
    ),
)
def _(spark, sf):
    out = E.collapse_duplicates(items(spark, sf), ["model", "release_date"], _PARTS, "item_id")
    return out.select("model", "release_date", "item_id", "price", "owners", joined("tags", "tags"))


# -- derived metrics ----------------------------------------------------------------


@query("f01_review_totals", over_items("select item_id, pos + neg as total, round(pos / cast(nullif(pos + neg, 0) as double), 6) as share from items"))
def _(spark, sf):
    return D.review_totals(items(spark, sf), "pos", "neg", "total", "share").select("item_id", "total", r6("share"))


@query("f02_is_released", "select o_orderkey, o_orderkey % 3 = 2 as released from orders")
def _(spark, sf):
    k = F.col("o_orderkey") % 3
    rows = table(spark, sf, "orders").withColumn("d", F.when(k == 0, "Not Released").when(k == 1, "coming soon").otherwise("2020-01-01"))
    return rows.select("o_orderkey", M.is_released("d").alias("released"))


@query("f03_backfill_max", over_items("select item_id, round(case when price is null or price = 0 then greatest(price, owners, ratio) else price end, 6) as price from items"))
def _(spark, sf):
    return D.backfill_max(items(spark, sf), "price", ["price", "owners", "ratio"]).select("item_id", r6("price"))


@query("f04_first_non_null", over_items("select item_id, coalesce(case when item_id % 2 = 0 then price end, owners, -1) as latest from items"))
def _(spark, sf):
    return items(spark, sf).select("item_id", P.first_non_null(F.when(F.col("item_id") % 2 == 0, F.col("price")), F.col("owners"), F.lit(-1.0)).alias("latest"))


@query("f05_cross_fill", over_items("select item_id, coalesce(price, owners) as price, coalesce(owners, price) as owners from items"))
def _(spark, sf):
    return items(spark, sf).select("item_id", *P.cross_fill("price", "owners"))


_FREE = """select item_id, price as original, case when item_id % 3 = 0 then 0.0 when item_id % 3 = 1 then price end as latest,
  case item_id % 4 when 0 then true when 1 then false end as is_free0, list_contains(tags, 'ring') as f0 from items"""
_FREE2 = "select *, case when not f0 and coalesce(original > 0 and latest > 0, false) then false else is_free0 end as is_free from f"
_FREE3 = "select *, f0 and not coalesce(is_free, false) as is_f2p from f2"


def _free(spark, sf):
    k3, k4 = F.col("item_id") % 3, F.col("item_id") % 4
    rows = items(spark, sf).select(
        "item_id", F.array().cast("array<string>").alias("genres"), "tags", F.col("price").alias("original"),
        F.when(k3 == 0, 0.0).when(k3 == 1, F.col("price")).alias("latest"), F.when(k4 == 0, True).when(k4 == 1, False).alias("is_free"),
    )
    return D.free_flags(rows, original="original", latest="latest", token="ring")


@query("f06_free_flags", over_items("select item_id, is_free, is_f2p, case when is_f2p then 0.0 else original end as original, case when is_f2p then 0.0 else latest end as latest from f3", f=_FREE, f2=_FREE2, f3=_FREE3))
def _(spark, sf):
    return _free(spark, sf).select("item_id", "is_free", "is_f2p", "original", "latest")


@query("f07_monetization_model", over_items("select item_id, case when is_f2p then 'f2p' when is_free then 'free' when original > 0 or latest > 0 then 'paid' end as model from f3", f=_FREE, f2=_FREE2, f3=_FREE3))
def _(spark, sf):
    model = M.monetization_model(F.col("is_f2p"), F.col("is_free"), F.col("original"), F.col("latest"))
    return _free(spark, sf).select("item_id", model.alias("model"))


@query("f08_date_parts", over_items("select item_id, year(release_date)::int as r_year, month(release_date)::int as r_month, day(release_date)::int as r_day_of_month from items"))
def _(spark, sf):
    return D.date_parts(items(spark, sf), "release_date", "r_").select("item_id", "r_year", "r_month", "r_day_of_month")


# money columns use the price in tens, years are shifted to the range the factors cover
_BASE = """select item_id, tags, release_date, release_year + 15 as y, price / 10 as p, neg * 9000 as neg, total_reviews * 9000 as t,
  case model when 'P' then 'free' when 'O' then 'f2p' else 'paid' end as model from items"""
_INFLATION = "case when y > 2020 then 31 when y {first} 2013 then 79 when y = 2014 then 72 when y = 2015 then 62 when y = 2016 then 52 when y = 2017 then 43 when y = 2018 then 38 when y = 2019 then 36 else 80 end / 80.0"
_OWNERS = "round_even(t * 80 * (case when t > 100000 then 0.75 else 1.0 end) * (" + _INFLATION + ") * (1 + 2 * exp(-0.2 * p)), 0)"
_DISLIKE = "power(neg / cast(nullif(t, 0) as double), 2)"
_AGE = "(date '2025-03-01' - release_date) / 365.25"
_DISCOUNT = f"(0.5 * exp(-{_DISLIKE} * {_AGE}) + 0.3)"
_TAG_SCORE = """select item_id, 1 + coalesce(sum(v * power(0.25, k - 1)) filter (v > 0), 0) + coalesce(sum(v * power(0.25, k - 1)) filter (v < 0), 0) as s from (
  select item_id, v, row_number() over (partition by item_id, sign(v) order by abs(v) desc) as k from (
    select item_id, case w when 'ring' then 3.0 when 'bolt' then 0.5 when 'red' then -0.5 when 'blue' then -0.25 end as v from (select item_id, unnest(tags) as w from items)) where v is not null) group by 1"""
_TAG_VALUES = {"ring": 3.0, "bolt": 0.5, "red": -0.5, "blue": -0.25}
AS_OF = date(2025, 3, 1)


def _money(spark, sf):
    return items(spark, sf).select(
        "item_id", "tags", "release_date", (F.col("release_year") + 15).alias("release_year"), (F.col("price") / 10).alias("price_original"),
        (F.col("neg") * 9000).alias("steam_negative_reviews"), (F.col("total_reviews") * 9000).alias("steam_total_reviews"),
        F.when(F.col("model") == "P", "free").when(F.col("model") == "O", "f2p").otherwise("paid").alias("monetization_model"),
    )


@query("f09_estimate_owners", over_items(f"select item_id, cast(case when t >= 1 then {_OWNERS.format(first='=')} end as bigint) as owners from b", b=_BASE))
def _(spark, sf):
    owners = M.estimate_owners(F.col("steam_total_reviews"), F.col("release_year"), F.col("price_original"))
    return _money(spark, sf).select("item_id", owners.alias("owners"))


@query("f10_estimate_owners_open_start", over_items(f"select item_id, cast({_OWNERS.format(first='<=')} as bigint) as owners from b", b=_BASE))
def _(spark, sf):
    owners = M.estimate_owners(F.col("steam_total_reviews"), F.col("release_year"), F.col("price_original"), open_start=True, min_reviews=0)
    return _money(spark, sf).select("item_id", owners.alias("owners"))


@query("f11_discount_factor", over_items(f"select item_id, round({_DISCOUNT}, 6) as discount from b", b=_BASE))
def _(spark, sf):
    dislike = M.dislike_squared(F.col("steam_negative_reviews"), F.col("steam_total_reviews"))
    return _money(spark, sf).select("item_id", r6(M.discount_factor(dislike, M.years_since("release_date", AS_OF)), "discount"))


_PER_USER = f"""select b.*, case model when 'paid' then round_even(p * {_DISCOUNT}, 0) when 'f2p' then (1.25 + (0.6 - 1.25) / (1 + power({_AGE} / 0.74, 2))) * coalesce(s, 1) when 'free' then 0.0 end as u
from b left join ts using (item_id)"""


@query("f12_revenue_per_user", over_items("select item_id, round(u, 6) as per_user from u", b=_BASE, ts=_TAG_SCORE, u=_PER_USER))
def _(spark, sf):
    out = D.estimate_revenue(_money(spark, sf), AS_OF, tag_values=_TAG_VALUES)
    return out.select("item_id", r6("estimated_ltarpu", "per_user"))


@query("f13_decayed_tag_score", over_items("select item_id, round(coalesce(s, 1), 6) as score from items left join ts using (item_id)", ts=_TAG_SCORE))
def _(spark, sf):
    return items(spark, sf).select("item_id", r6(M.decayed_score(F.col("tags"), _TAG_VALUES), "score"))


@query("f14_gross_revenue", over_items(f"select item_id, cast(round_even(case when t >= 1 then {_OWNERS.format(first='=')} end * u, 0) as bigint) as gross from u", b=_BASE, ts=_TAG_SCORE, u=_PER_USER))
def _(spark, sf):
    out = D.estimate_revenue(_money(spark, sf), AS_OF, tag_values=_TAG_VALUES)
    return out.select("item_id", F.col("estimated_gross_revenue_boxleiter").alias("gross"))


@query("f15_density_filter", over_items("select item_id from items where pos is not null and (price is not null or ratio > 0.5)"))
def _(spark, sf):
    rows = items(spark, sf).withColumn("good", F.when(F.col("ratio") > 0.5, True))
    return D.require(rows, ["pos"], [["price", "good"]]).select("item_id")


# -- features -----------------------------------------------------------------------


@query(
    "g01_fill_policy",
    over_items("select item_id, round(coalesce(price, (select median(price) from items)), 6) as price, round(coalesce(owners, (select median(owners) from items)), 6) as owners, coalesce(pos, 0) as pos, coalesce(neg, -1) as neg from items"),
)
def _(spark, sf):
    rows = items(spark, sf).select("item_id", "price", "owners", "pos", "neg")
    policy = {"item_id": G.KEEP, "price": G.MEDIAN, "owners": G.MEDIAN, "pos": ("value", 0), "neg": lambda c: F.coalesce(c, F.lit(-1))}
    return G.fill_policy(rows, policy).select("item_id", r6("price"), r6("owners"), "pos", "neg")


@query("g02_first_of_list", over_items("select item_id, coalesce(tags[1], 'none') as first from items"))
def _(spark, sf):
    return items(spark, sf).select("item_id", P.first_of_list("tags").alias("first"))


@query("g03_ordinal_codes", "select o_orderkey, case o_orderkey % 4 when 0 then 0 when 1 then 5 when 2 then 8 else -1 end as difficulty, cast(case o_orderkey % 4 when 0 then 1.0 when 1 then 0.5 when 2 then 0.0 else -1.0 end as double) as controller from orders")
def _(spark, sf):
    k = F.col("o_orderkey") % 4
    difficulty = F.when(k == 0, "Simple").when(k == 1, "Just Right-Tough").when(k == 2, "unforgiving")
    controller = F.when(k == 0, "full").when(k == 1, "partial").when(k == 2, "none").otherwise("other")
    return table(spark, sf, "orders").select("o_orderkey", G.difficulty_code(difficulty).alias("difficulty"), G.controller_code(controller).alias("controller"))


_LABEL = over_items(
    "select item_id, coalesce(c.code, -1) as factor from items left join c on c.f = items.factor and items.price is not null",
    c="select factor as f, cast(row_number() over (order by min(item_id)) - 1 as integer) as code from items where price is not null group by 1",
)


def _labelled(spark, sf):
    return items(spark, sf).withColumn("factor", F.when(F.col("price").isNotNull(), F.col("factor"))).select("item_id", "factor", "release_date", "price")


@query(
    "g04_controller_codes",
    over_items("select item_id, case item_id % 4 when 0 then 1.0::double when 1 then 0.5::double when 2 then 0.0::double else -1.0::double end as code from items"),
)
def _(spark, sf):
    text = F.get(F.array(F.lit("full"), F.lit("partial"), F.lit("none"), F.lit(None)), (F.col("item_id") % 4).cast("int"))
    return items(spark, sf).select("item_id", text.alias("controller_support")).select("item_id", G.controller_code("controller_support").alias("code"))


@query("g05_label_encode", _LABEL)
def _(spark, sf):
    return G.label_encode(_labelled(spark, sf), ["factor"], "item_id").select("item_id", "factor")


@query(
    "g05_label_encode_many_values",
    over_items("select item_id, cast(code as integer) as release_date from items join (select release_date, row_number() over (order by min(item_id)) - 1 as code from items group by 1) using (release_date)"),
)
def _(spark, sf):
    return G.label_encode(_labelled(spark, sf), ["release_date"], "item_id").select("item_id", "release_date")


@query(
    "g05_label_encode_prices",
    """select o_orderkey, cast(code as integer) as code from orders join (
  select o_totalprice, row_number() over (order by min(o_orderkey)) - 1 as code from orders group by 1) using (o_totalprice)""",
)
def _(spark, sf):
    """About as many values as rows."""
    rows = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("code"))
    return G.label_encode(rows, ["code"], "o_orderkey").select("o_orderkey", "code")


@query("g06_list_counts", over_items("select item_id, len(tags)::int as tags_count from items"))
def _(spark, sf):
    return G.list_counts(items(spark, sf).select("item_id", "tags"), ["tags"]).select("item_id", "tags_count")


@query("g07_drop_any_null", over_items("select item_id from items where price is not null and owners is not null and ratio is not null"))
def _(spark, sf):
    return G.drop_any_null(items(spark, sf).select("item_id", "price", "owners", "ratio")).select("item_id")


@query("g07_null_total", over_items("select 3 * count(*) - count(price) - count(owners) - count(ratio) as nulls from items"))
def _(spark, sf):
    return G.null_total(items(spark, sf).select("item_id", "price", "owners", "ratio"))


@query("g08_vocabulary", over_items("select distinct unnest(tags) as term from items"))
def _(spark, sf):
    return G.vocabulary(items(spark, sf), "tags")


@query("g09_multi_hot", over_items('select item_id, list_contains(tags, \'ring\')::int as "~tag_ring", list_contains(tags, \'bolt\')::int as "~tag_bolt", list_contains(tags, \'none\')::int as "~tag_none" from items'))
def _(spark, sf):
    return G.multi_hot(items(spark, sf).select("item_id", "tags"), "tags", "~tag_", ["ring", "bolt", "none"])


@query("g09_multi_hot_sparse", over_items("select len(tags) as active, count(*) as rows from items group by 1"))
def _(spark, sf):
    from pyspark.ml.functions import vector_to_array

    hot, _model = G.multi_hot_sparse(items(spark, sf).select("item_id", "tags"), "tags", "hot")
    active = F.aggregate(vector_to_array("hot"), F.lit(0.0), lambda a, v: a + v).cast("bigint")
    return hot.groupBy(active.alias("active")).agg(F.count(F.lit(1)).alias("rows"))


@query("g09_multi_hot_words", "select doc_id, cast(len(list_distinct(string_split(text, ' '))) as bigint) as active from documents")
def _(spark, sf):
    """Every word of every document is a term."""
    words = table(spark, sf, "documents").select("doc_id", F.split("text", " ").alias("words"))
    hot, _codes = G.multi_hot_places(words, "words", "hot")
    return hot.select("doc_id", F.array_size("hot").cast("bigint").alias("active"))


@query("g10_drop_leakage", "select o_orderkey, o_orderdate::date as o_orderdate from orders")
def _(spark, sf):
    rows = table(spark, sf, "orders").withColumn("o_orderdate", F.to_date("o_orderdate"))
    return G.drop_leakage(rows, ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "not_there"])


_BIN = "case when t <= 50 then 0 when t <= 100 then 1 when t <= 250 then 2 when t <= 500 then 3 when t <= 1000 then 4 when t <= 2500 then 5 when t <= 5000 then 6 when t > 5000 then 7 end"


@query("g11_review_bins", over_items(f"select item_id, {_BIN} as bin from (select item_id, total_reviews * 50 as t from items)"))
def _(spark, sf):
    return items(spark, sf).select("item_id", G.review_bin(F.col("total_reviews") * 50).alias("bin"))


@query("g12_bin_table", over_items(f"select {_BIN} as bin, count(*) as count, round(count(*) / sum(count(*)) over () * 100, 2) as percentage from (select total_reviews * 50 as t from items where total_reviews is not null) group by 1"))
def _(spark, sf):
    rows = items(spark, sf).dropna(subset=["total_reviews"])
    return G.bin_table(rows.withColumn("bin", G.review_bin(F.col("total_reviews") * 50)), "bin")


@query("g13_inference_set", over_items(f"select item_id, price, release_year, {_BIN} as steam_total_reviews_bin from (select *, total_reviews * 50 as t from items) where price is not null and t is not null"))
def _(spark, sf):
    rows = items(spark, sf).select("item_id", "price", "release_year", (F.col("total_reviews") * 50).alias("steam_total_reviews"), F.lit("x").alias("name"))
    return G.inference_set(rows)


_MODE = "(select {c} from items where {c} is not null group by {c} order by count(*) desc, {c} limit 1)"


@query("g14_baseline_row", over_items(f"select 0 as item_id, {_MODE.format(c='model')} as model, {_MODE.format(c='pos')} as pos, round((select median(price) from items), 6) as price, cast(round_even((select median(owners) from items), 0) as bigint) as owners, 2025 as release_year"))
def _(spark, sf):
    rows = items(spark, sf).select("item_id", "model", "pos", "price", "owners", "release_year")
    out = G.baseline_row(rows, modes=["model", "pos"], medians=["price"], rounded=["owners"], overrides={"release_year": 2025})
    return out.select("item_id", "model", "pos", r6("price"), "owners", "release_year")


_PROFILE = "select '{c}' as \"column\", count(distinct {c}) as distinct_count, cast(" + _MODE + " as double) as mode, round(avg({c}), 6) as mean, round(median({c}), 6) as median, cast(min({c}) as double) as min, cast(max({c}) as double) as max from items"


@query("g15_profile", over_items(" union all ".join(_PROFILE.format(c=c) for c in ("price", "owners", "pos", "ratio")).replace("avg(ratio)", "avg(ratio)").replace("cast(max(ratio)", "cast(max(ratio)")))
def _(spark, sf):
    out = G.profile(items(spark, sf), ["price", "owners", "pos", "ratio"])
    return out.select("column", "distinct_count", "mode", r6("mean"), r6("median"), "min", "max")


@query("g16_numeric_only", "select p_partkey, p_size, p_retailprice from part")
def _(spark, sf):
    return mapping.numeric_only(table(spark, sf, "part"))


# -- the whole cleaning step over a merged catalog ----------------------------------


def raw_catalog(spark, sf):
    """A merged catalog in its raw, text-heavy form, derived from the items."""
    k = F.col("item_id")
    quoted = F.concat(F.lit("["), F.array_join(F.transform("tags", lambda t: F.concat(F.lit("'"), F.initcap(t), F.lit("'"))), ", "), F.lit("]"))
    date_text = F.when(k % 3 == 0, F.date_format("release_date", "yyyy-MM-dd")).when(k % 3 == 1, F.date_format("release_date", "MMM d, yyyy")).otherwise("coming soon")
    return items(spark, sf).select(
        k.alias("appid"), F.concat(F.lit("title "), (k % 997).cast("string")).alias("name"), date_text.alias("release_date"),
        F.when(k % 7 == 0, "n/a").otherwise(F.col("price").cast("string")).alias("price_original"), (F.col("price") * 0.9).alias("price_2024_09"),
        F.when(k % 5 == 0, F.col("price") * 1.1).alias("price_2023_11"), quoted.alias("tags"), F.lit("['Indie']").alias("genres"),
        F.lit("['English', 'french (audio)']").alias("supported_languages"), (F.col("pos") * 100).alias("positive"), (F.col("neg") * 100).alias("negative"),
        F.when(k % 6 == 0, "True").when(k % 6 == 1, "False").alias("is_free"), F.col("owners").alias("metacritic_score"), F.lit("True").alias("windows"),
        F.when(k % 3 == 0, "False").alias("linux"), F.lit(None).cast("string").alias("mac"), F.lit(None).cast("string").alias("steam_deck"),
        (k % 4).cast("double").alias("igdb_single"), F.when(k % 2 == 0, F.col("owners")).alias("hltb_main_story"), (k % 50).alias("recommendations"),
    )


@query(
    "catalog_clean",
    over_items(
        """select item_id as appid, case item_id % 3 when 2 then null else release_date end as release_date, pos * 100 + neg * 100 as steam_total_reviews,
  round(po, 6) as price_original, case when f2p then 'f2p' when free then 'free' when po > 0 then 'paid' end as monetization_model,
  array_to_string(tags, '|') as tags, 'english|french' as languages_supported, round(owners / 100, 6) as average_non_steam_review_score,
  round(case when item_id % 2 = 0 and owners is not null then (item_id % 4 + owners) / 2.0 else item_id % 4 end, 6) as average_time_to_beat
from (select *, false as f2p, case when p0 > 0 and pl > 0 then false when item_id % 6 = 0 then true else false end as free, p0 as po from q)""",
        q="""select *, case when item_id % 7 = 0 or price is null or price = 0 then greatest(price * 0.9, case when item_id % 5 = 0 then price * 1.1 end, case when item_id % 7 = 0 then null else price end) else price end as p0,
  coalesce(price * 0.9, 0) as pl from items""",
    ),
)
def _(spark, sf):
    out, _report = D.preprocess(raw_catalog(spark, sf), AS_OF)
    return out.select(
        "appid", "release_date", "steam_total_reviews", r6("price_original"), "monetization_model", joined("tags", "tags"),
        joined("languages_supported", "languages_supported"), r6("average_non_steam_review_score"), r6("average_time_to_beat"),
    )


@query("catalog_collapse_and_dense")
def _(spark, sf):
    out = stored(spark, sf, "preprocessed", lambda: D.preprocess(raw_catalog(spark, sf), AS_OF)[0])
    unique = E.collapse_duplicates(out, ["name", "release_date"], E.CATALOG_SCORE, "appid")
    return D.dense(unique).select("appid", "name", "release_date", "steam_total_reviews", "price_original", "estimated_gross_revenue_boxleiter")
