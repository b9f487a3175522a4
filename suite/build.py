"""The offline build: exports written from the given tables, read back, mapped, merged, and turned into feature layers."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquetry.operators import catalog
from marquetry.operators import derive as D
from marquetry.operators import features as G
from marquetry.sources import readers, resume, writers
from suite.catalog import AS_OF, raw_catalog
from suite.items import items, over_items, query, stored

ROWS_PER_FILE = 5_000  # of the exports that are one JSON document
FILES_PER_TASK = 16
_FOLDERS: dict[tuple[str, str], str] = {}
_EXPORTS: set[str] = set()


def csv_rows(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("item_id")
    return items(spark, sf).select(
        k.alias("app_id"), F.concat(F.lit('The "'), k.cast("string"), F.lit('", a title')).alias("title"),
        F.date_format("release_date", "yyyy-MM-dd").alias("date_release"), (k % 2 == 0).alias("win"), F.lit(False).alias("mac"),
        F.lit(True).alias("linux"), F.col("price").alias("price_final"), F.lit(None).cast("double").alias("price_original"),
        (k % 3 == 0).alias("steam_deck"),
    )


def list_rows(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("item_id")
    return items(spark, sf).where("item_id % 5 <> 0").select(
        k.alias("appid"), F.lit("other name").alias("name"), F.lit("2001-01-01").alias("release_date"),
        F.lit("A;B").alias("developer"), F.lit("C").alias("publisher"), F.lit("Single").alias("categories"),
        F.array_join("tags", ";").alias("genres"), F.col("pos").alias("positive_ratings"), F.col("neg").alias("negative_ratings"),
        F.lit(1.5).alias("average_playtime"), F.lit(2.5).alias("median_playtime"),
        F.concat((k % 7).cast("string"), F.lit("-"), (k % 7 + 10).cast("string")).alias("owners"), F.col("price").alias("price"),
    )


def dict_rows(spark: SparkSession, sf: str) -> DataFrame:
    return items(spark, sf).where("item_id % 4 <> 0").select(
        F.col("item_id").alias("game_id"), F.lit("false").alias("early_access"), F.lit("t").alias("title"),
        F.array_join("tags", ",").alias("tag_list"), F.lit("True").alias("vr_only"), F.lit(None).cast("string").alias("vr_supported"),
    )


def _documents(rows: DataFrame, entry, opening: str, closing: str) -> DataFrame:
    """One JSON document per ``ROWS_PER_FILE`` rows or so; a task holds about ``FILES_PER_TASK`` of them."""
    files = max(1, -(-rows.count() // ROWS_PER_FILE))
    number = F.pmod(F.xxhash64(rows.columns[0]), F.lit(files))
    text = F.concat(F.lit(opening), F.array_join(F.collect_list("entry"), ","), F.lit(closing))
    lines = rows.select(number.alias("file"), entry.alias("entry")).repartition(-(-files // FILES_PER_TASK), "file")
    return lines.groupBy("file").agg(text.alias("value")).select("value")


def write_documents(rows: DataFrame, path: str, entry, opening: str, closing: str, packed: bool = True) -> None:
    """Every document in a file of its own."""
    files = _documents(rows, entry, opening, closing).write.mode("overwrite").option("maxRecordsPerFile", 1)
    files.option("compression", "gzip" if packed else "none").text(path)


def _write_set2(spark: SparkSession, sf: str, path: str, packed: bool) -> None:
    writers.write(csv_rows(spark, sf), path, fmt="csv", packed=packed)


def _write_set5(spark: SparkSession, sf: str, path: str, packed: bool) -> None:
    write_documents(list_rows(spark, sf), path, F.to_json(F.struct("*")), "[", "]", packed)


def _write_set8(spark: SparkSession, sf: str, path: str, packed: bool) -> None:
    member = F.concat(F.lit('"'), F.col("game_id").cast("string"), F.lit('":'), F.to_json(F.struct("*")))
    write_documents(dict_rows(spark, sf), path, member, "{", "}", packed)


_WRITERS = {"set2.csv": _write_set2, "set5.json": _write_set5, "set8.json": _write_set8}


def folder(spark: SparkSession, sf: str) -> str:
    """Folder below the shared one for the files of an application."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _FOLDERS:
        _FOLDERS[key] = f"{writers.shared_folder(spark)}/exports-{key[0]}-{len(_FOLDERS)}"
    return _FOLDERS[key]


def export(spark: SparkSession, sf: str, name: str, packed: bool = True) -> str:
    """Path of one of the three exports, written once per application when it is first read.

    It is compressed unless its files are to be split; who reads whole files takes either.
    """
    plain = f"{folder(spark, sf)}/{name}"
    path = f"{folder(spark, sf)}/packed-{name}" if packed and plain not in _EXPORTS else plain
    if path not in _EXPORTS:
        _WRITERS[name](spark, sf, path, packed)
        _EXPORTS.add(path)
    return path


def read_csv_export(spark, sf):
    schema = "app_id string, title string, date_release string, win string, mac string, linux string, price_final string, price_original string, steam_deck string"
    return readers.read_csv(spark, export(spark, sf, "set2.csv"), schema)


def read_list_export(spark, sf, split=False):
    schema = (
        "appid long, name string, release_date string, developer string, publisher string, categories string, genres string, "
        "positive_ratings long, negative_ratings long, average_playtime double, median_playtime double, owners string, price double"
    )
    return readers.read_json_list(spark, export(spark, sf, "set5.json", not split), schema, split)


def read_dict_export(spark, sf, split=False):
    schema = T.StructType.fromDDL("early_access string, title string, tag_list string, vr_only string, vr_supported string")
    return readers.read_json_dict(spark, export(spark, sf, "set8.json", not split), schema, key_col="game_id", split=split)


@query("a01_csv_export", over_items("""select cast(item_id as varchar) as app_id, 'The "' || item_id || '", a title' as title, strftime(release_date, '%Y-%m-%d') as date_release, price from items"""))
def _(spark, sf):
    return read_csv_export(spark, sf).select("app_id", "title", "date_release", F.col("price_final").cast("double").alias("price"))


@query("a06_written_csv", over_items("select item_id, 'a \"' || item_id || '\", b' as title, price, array_to_string(tags, '|') as tags, model from items"))
def _(spark, sf):
    """Lists and quotes through a CSV sink in folders by model, and back."""
    title = F.concat(F.lit('a "'), F.col("item_id").cast("string"), F.lit('", b'))
    path = f"{folder(spark, sf)}/written.csv"
    writers.write(items(spark, sf).select("item_id", title.alias("title"), "price", "tags", "model"), path, fmt="csv", partition_by=["model"])
    back = readers.read_csv(spark, path, "item_id long, title string, price double, tags string, model string")
    return back.withColumn("tags", F.array_join(F.from_json("tags", "array<string>"), "|"))


@query("a02_json_list_export", over_items("select item_id as appid, array_to_string(tags, ';') as genres, pos as positive_ratings, price from items where item_id % 5 <> 0"))
def _(spark, sf):
    return read_list_export(spark, sf).select("appid", "genres", "positive_ratings", "price")


@query("a03_json_dict_export", over_items("select cast(item_id as varchar) as game_id, array_to_string(tags, ',') as tag_list, 'True' as vr_only from items where item_id % 4 <> 0"))
def _(spark, sf):
    return read_dict_export(spark, sf).select("game_id", "tag_list", "vr_only")


@query("a02_json_list_split", over_items("select item_id as appid, array_to_string(tags, ';') as genres, pos as positive_ratings, price from items where item_id % 5 <> 0"))
def _(spark, sf):
    return read_list_export(spark, sf, split=True).select("appid", "genres", "positive_ratings", "price")


@query("a03_json_dict_split", over_items("select cast(item_id as varchar) as game_id, array_to_string(tags, ',') as tag_list, 'True' as vr_only from items where item_id % 4 <> 0"))
def _(spark, sf):
    return read_dict_export(spark, sf, split=True).select("game_id", "tag_list", "vr_only")


def merged(spark, sf) -> DataFrame:
    sources = {"set2": read_csv_export(spark, sf), "set5": read_list_export(spark, sf), "set8": read_dict_export(spark, sf)}
    return catalog.merge_catalog(sources)


@query("d05_merge_exports", over_items(
    """select item_id as appid, 'The "' || item_id || '", a title' as name, coalesce(strftime(release_date, '%Y-%m-%d'), case when l then '2001-01-01' end) as release_date,
  case when item_id % 2 = 0 then true else false end as windows, price as price_2024_08, case when l then pos end as positive,
  case when l then (item_id % 7 * 2 + 10) / 2.0 end as estimated_owners, case when l then 'A|B' end as developers,
  case when d then array_to_string(case when len(tags) = 0 then [''] else tags end, '|') end as tags, case when d then true end as vr_only
from (select *, item_id % 5 <> 0 as l, item_id % 4 <> 0 as d from items)"""))
def _(spark, sf):
    joined = lambda c: F.array_join(c, "|").alias(c)
    return merged(spark, sf).select(
        "appid", "name", "release_date", "windows", "price_2024_08", F.col("positive").cast("bigint").alias("positive"),
        "estimated_owners", joined("developers"), joined("tags"), "vr_only",
    )


def preprocessed(spark, sf) -> DataFrame:
    return stored(spark, sf, "preprocessed", lambda: D.preprocess(raw_catalog(spark, sf), AS_OF)[0])


def _priced(spark, inputs):
    return inputs["orders"].select("o_orderkey", "o_custkey", (F.col("o_totalprice") / 1000).alias("price")).where("price >= 50")


def _spent(spark, inputs):
    return inputs["priced"].groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("price"), 3).alias("spent"))


@query(
    "a07_resumed_build",
    """select o_custkey, n, spent, c_mktsegment from (
  select o_custkey, count(*) as n, round(sum(o_totalprice / 1000), 3) as spent from orders where o_totalprice / 1000 >= 50 group by 1)
join customer on c_custkey = o_custkey""",
)
def _(spark, sf):
    """Four layers, built and then resumed; the rows are those of the second build, which makes nothing."""
    steps = [
        resume.Step("orders", lambda s, _: s.read.parquet(f"{sf}/orders.parquet"), sources=[f"{sf}/orders.parquet"], version=sf),
        resume.Step("priced", _priced, after=["orders"]),
        resume.Step("spent", _spent, after=["priced"]),
        resume.Step(
            "named",
            lambda s, layers: layers["spent"].join(s.read.parquet(f"{sf}/customer.parquet"), F.col("o_custkey") == F.col("c_custkey")),
            sources=[f"{sf}/customer.parquet"], after=["spent"], version=sf,
        ),
    ]
    root = f"{writers.shared_folder(spark)}/resumed-{spark.sparkContext.applicationId}-{zlib.crc32(sf.encode())}"
    resume.build(spark, root, steps)
    again = resume.build(spark, root, steps)
    if again.made:
        raise AssertionError(f"made again: {again.made}")
    return again.layers["named"].select("o_custkey", "n", "spent", "c_mktsegment")


@query("a04_named_layer", over_items("select item_id as appid, pos * 100 + neg * 100 as steam_total_reviews from items"))
def _(spark, sf):
    """A layer is written under its name, loaded back, and its columns pruned at the scan."""
    root = f"{folder(spark, sf)}/layers"
    writers.write(preprocessed(spark, sf), f"{root}/preprocessed")
    return readers.load(spark, root, "preprocessed").select("appid", "steam_total_reviews")


def complete(spark, sf) -> DataFrame:
    """The cleaned catalog with all its columns; those that the sources did not bring are there without values."""
    rows = preprocessed(spark, sf)
    kinds = {G.EMPTY_LIST: "array<string>", G.MEDIAN: "double", G.KEEP: "string"}
    of_value = {bool: "boolean", int: "double", str: "string"}
    kind = lambda rule: of_value[type(rule[1])] if isinstance(rule, tuple) else kinds[rule]
    absent = {
        # a column without any value has no median to fill in
        c: F.lit(1.0 if rule == G.MEDIAN else None).cast(kind(rule))
        for c, rule in G.NO_NULL_POLICY.items()
        if c not in rows.columns
    }
    makers = {c: F.array(F.lit("someone")) for c in ("developers", "publishers")}
    calendar = ("release_month", "release_day_of_month")
    rows = rows.withColumns({c: v for c, v in {**absent, **makers}.items() if c not in calendar})
    return rows.drop("is_released")


def layers(spark, sf) -> tuple[DataFrame, DataFrame]:
    return G.feature_layers(stored(spark, sf, "complete", lambda: complete(spark, sf)))


@query("g09_layer_flags", over_items(
    """select item_id as appid, len(tags)::int as tags_count, list_contains(tags, 'ring')::int as "~tag_ring", list_contains(tags, 'bolt')::int as "~tag_bolt",
  1 as "~lang_english", cast(case when item_id % 3 < 2 then month(release_date) end as integer) as release_month from items"""))
def _(spark, sf):
    """Flag columns of the null-tolerant layer."""
    allow, _filled = layers(spark, sf)
    return allow.select("appid", "tags_count", "`~tag_ring`", "`~tag_bolt`", "`~lang_english`", "release_month")


@query("g13_inference_build", over_items("select count(*) as rows, 0 as lists, true as has_bin, true as has_flags from items where price is not null"))
def _(spark, sf):
    """The model-ready set: no list column is left, flags and the binned target are there, every row is complete."""
    _allow, filled = layers(spark, sf)
    ready = G.inference_set(filled)
    lists = sum(isinstance(f.dataType, T.ArrayType) for f in ready.schema.fields)
    return ready.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows", F.lit(lists).alias("lists"), F.lit("steam_total_reviews_bin" in ready.columns).alias("has_bin"),
        F.lit("~tag_ring" in ready.columns).alias("has_flags"),
    )
