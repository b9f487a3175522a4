import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquetry.functions import parsing as P
from marquetry.operators import mapping
from marquetry.sources import documents, profile, readers, writers
from suite import build, exports  # noqa: F401
from suite.items import QUERIES


def test_csv_with_quotes_and_line_breaks(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('appid,name,price\n1,"A ""quoted""\nname",9.99\n2,,x\n')
    out = readers.read_csv(spark, str(path), "appid long, name string, price string", multiline=True).orderBy("appid").collect()
    assert out[0]["name"] == 'A "quoted"\nname' and out[1]["name"] is None and out[1]["price"] == "x"


def test_json_list_and_dict(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps([{"sid": 1, "tags": ["a"]}, {"sid": 2, "tags": []}]))
    assert readers.read_json_list(spark, str(tmp_path / "l.json"), "sid long, tags array<string>").count() == 2
    (tmp_path / "d.json").write_text(json.dumps({"10": {"name": "x", "tags": {"a": 5}}, "20": {"name": "y", "tags": {}}}))
    schema = T.StructType.fromDDL("name string, tags map<string,bigint>")
    out = readers.read_json_dict(spark, str(tmp_path / "d.json"), schema).withColumn("keys", P.map_key_list("tags", from_text=False))
    assert {r["appid"]: (r["name"], r["keys"]) for r in out.collect()} == {"10": ("x", ["a"]), "20": ("y", [])}


TRICKY = ['}', '{', '"', '\\', '\\"}', '],{"sid": 9}', 'é}\n{', '\\\\', '', '}}]', 'plain text', '\U0001f600"}']


@pytest.mark.parametrize("indent", [None, 2])
def test_one_json_document_is_read_by_many_tasks(spark, tmp_path, indent):
    """Quotes, escapes and braces in strings, nested objects; splits of 3,000 bytes cut records anywhere."""
    rows = [
        {"sid": i, "name": TRICKY[i % len(TRICKY)] * (1 + i % 5), "tags": [TRICKY[(i + j) % len(TRICKY)] for j in range(i % 4)], "more": {"a": {"b}": i}}}
        for i in range(700)
    ]
    (tmp_path / "l.json").write_text(json.dumps(rows, indent=indent, ensure_ascii=False))
    members = {f'{r["sid"]}"}}': r for r in rows} | {"none": None} | {"last": None}
    (tmp_path / "d.json").write_text(json.dumps(members, indent=indent) + "\n")
    ddl = "sid long, name string, tags array<string>, more struct<a: map<string,long>>"
    schema, before = T.StructType.fromDDL(ddl), spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        assert spark.read.text(str(tmp_path / "l.json"), lineSep="}").rdd.getNumPartitions() >= 8
        some = readers.read_json_list(spark, str(tmp_path / "l.json"), ddl, split=True)
        pairs = readers.read_json_dict(spark, str(tmp_path / "d.json"), schema, split=True)
        got, got_pairs = (sorted(map(str, x.collect())) for x in (some, pairs))
        inferred = readers.read_json_list(spark, str(tmp_path / "l.json"), split=True)
        assert inferred.count() == 700 and {"sid", "name", "tags", "more"} == set(inferred.columns)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == sorted(map(str, readers.read_json_list(spark, str(tmp_path / "l.json"), ddl).collect()))
    assert got_pairs == sorted(map(str, readers.read_json_dict(spark, str(tmp_path / "d.json"), schema).collect()))
    assert len(got_pairs) == 702


def test_small_documents_and_broken_ones(spark, tmp_path):
    for k, text in enumerate(["[]", " [ ]\n", '[{"sid": 1}]', '\n[{"sid": 2},\n{}]\n']):
        (tmp_path / f"{k}.json").write_text(text)
    got = readers.read_json_list(spark, str(tmp_path), "sid long", split=True)
    assert sorted((r["sid"] for r in got.collect()), key=str) == [1, 2, None]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.json").write_text("{}")
    assert readers.read_json_dict(spark, str(tmp_path / "d"), T.StructType.fromDDL("a int"), split=True).collect() == []
    (tmp_path / "bad.json").write_text('[{"sid": 1}, {"sid": ')
    with pytest.raises(Exception, match="cut short"):
        readers.read_json_list(spark, str(tmp_path / "bad.json"), "sid long", split=True).collect()


def test_text_of_a_split_document_is_stored_once(spark, tmp_path, monkeypatch):
    """What is sorted and summed goes without it; records of one piece and of many come out alike."""
    stored = []
    monkeypatch.setattr(documents, "checkpoint", lambda df: stored.append(df.columns) or writers.checkpoint(df))
    rows = [{"sid": i, "n": {"a": [{"b": "}{"}]} if i % 3 == 0 else None} for i in range(200)]
    (tmp_path / "x.json").write_text(json.dumps(rows))
    got = readers.read_json_list(spark, str(tmp_path / "x.json"), "sid long, n struct<a:array<struct<b:string>>>", split=True).collect()
    assert sorted((r["sid"], r["n"] is not None) for r in got) == [(i, i % 3 == 0) for i in range(200)]
    assert sum("value" in columns for columns in stored) == 1


def test_a_query_writes_only_the_exports_it_reads(spark, tmp_path, monkeypatch):
    orders = spark.range(40).selectExpr("id as o_orderkey", "'F' as o_orderstatus", "100000.0D as o_totalprice", "timestamp'2001-02-03' as o_orderdate", "'1-URGENT' as o_orderpriority")
    lines = spark.range(80).selectExpr("id % 40 as l_orderkey", "id % 5 as l_partkey", "1.0D as l_quantity", "'A' as l_returnflag")
    parts = spark.range(5).selectExpr("id as p_partkey", "concat('hot ring ', id) as p_name")
    for name, df in (("orders", orders), ("lineitem", lines), ("part", parts)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    written = []
    monkeypatch.setattr(build, "_WRITERS", {n: lambda *a, n=n, f=f: written.append(n) or f(*a) for n, f in build._WRITERS.items()})
    assert QUERIES["a06_written_csv"](spark, str(tmp_path)).count() == 40 and written == []
    assert QUERIES["a02_json_list_split"](spark, str(tmp_path)).count() == 32 and written == ["set5.json"]
    assert QUERIES["a03_json_dict_split"](spark, str(tmp_path)).count() == 30 and written == ["set5.json", "set8.json"]
    assert QUERIES["a02_json_list_export"](spark, str(tmp_path)).count() == 32 and written == ["set5.json", "set8.json"]


def test_exports_are_compressed_unless_they_are_split(spark, tmp_path, monkeypatch):
    """Every packed file is one task, so it holds few rows; a table that is joined stays plain, as its size decides how."""
    items = spark.range(1, 41).selectExpr("id as o_orderkey", "'F' as o_orderstatus", "100000.0D as o_totalprice", "timestamp'2001-02-03' as o_orderdate", "'1-URGENT' as o_orderpriority")
    lines = spark.range(1, 81).selectExpr("id % 40 as l_orderkey", "id % 5 as l_partkey", "1.0D as l_quantity", "'A' as l_returnflag")
    for name, df in (("orders", items), ("lineitem", lines), ("part", spark.range(5).selectExpr("id as p_partkey", "concat('hot ring ', id) as p_name"))):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    monkeypatch.setattr(writers, "PACKED_ROWS", 7)
    out = QUERIES["d05_merge_catalog"](spark, str(tmp_path))
    assert out.count() == 45
    root = Path(build.folder(spark, str(tmp_path)))
    files = lambda name: [f.name for f in (root / name).glob("part-*")]
    for name in ("set1.csv", "set3.csv", "set6.csv", "set7.csv", "set9.json", "packed-set2.csv", "packed-set5.json", "packed-set8.json"):
        assert files(name) and all(f.endswith(".gz") for f in files(name))
    assert len(files("packed-set2.csv")) >= 6 and all(f.endswith(".csv") for f in files("set4.csv"))
    rows = lambda q: sorted(map(tuple, QUERIES[q](spark, str(tmp_path)).collect()))
    assert rows("a02_json_list_export") == rows("a02_json_list_split") and rows("a03_json_dict_export") == rows("a03_json_dict_split")
    assert not any(f.endswith(".gz") for f in files("set5.json") + files("set8.json"))


def test_layers_and_null_check(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "b")], "appid long, name string")
    writers.write(df, str(tmp_path / "preprocessed"))
    assert readers.load(spark, str(tmp_path), "preprocessed").count() == 2
    writers.write(df, str(tmp_path / "inference_dataset"))
    with pytest.raises(ValueError, match="nulls found: {'name': 1}"):
        readers.load(spark, str(tmp_path), "inference")
    assert readers.load(spark, str(tmp_path), "inference", check=False).count() == 2
    with pytest.raises(KeyError):
        readers.load(spark, str(tmp_path), "nothing")
    with pytest.raises(Exception):
        readers.load(spark, str(tmp_path), "merged").count()


def test_csv_sink_writes_lists_as_json(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", 'b"c'])], "id int, tags array<string>")
    writers.write(df, str(tmp_path / "csv"), fmt="csv")
    back = readers.read_csv(spark, str(tmp_path / "csv"), "id int, tags string").first()
    assert json.loads(back["tags"]) == ["a", 'b"c']
    with pytest.raises(ValueError):
        writers.write(df, str(tmp_path / "x"), fmt="xml")


def test_checkpoint_cuts_lineage_and_keeps_pushdown(spark):
    df = spark.range(100).select(F.col("id"), (F.col("id") % 3).alias("k")).repartition(4)
    kept = writers.checkpoint(df)
    plan = kept.where("k = 1").select("k")._jdf.queryExecution().executedPlan().toString()
    assert kept.count() == 100 and "Range" not in plan and "PushedFilters: [IsNotNull(k), EqualTo(k,1)]" in plan


def test_flatten_depths(spark):
    df = spark.createDataFrame([(1, {"a": {"b": 5}}, [{"x": 1}, {"x": 2}], ["p", "q", "r", "s"], {"m": 1})], "id int, s struct<a:struct<b:int>>, l array<struct<x:int>>, w array<string>, m map<string,int>")
    flat = profile.flatten(df, max_depth=0).first()
    assert flat["s"] == "NestedDict[1 keys]" and flat["l"] == 'List[2]: [{"x":1}]...' and flat["w"] == 'List[4]: ["p","q","r"]...' and flat["m"] == "NestedDict[1 keys]"
    assert profile.flatten(df, max_depth=1).columns == ["id", "s.a", "l", "w", "m"]
    assert profile.flatten(df, max_depth=2).columns == ["id", "s.a.b", "l", "w", "m"]


def test_sample_depends_on_the_key_only(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    a = {r[0] for r in profile.sample_n(df, 10, 1, "k").collect()}
    assert a == {r[0] for r in profile.sample_n(df.repartition(9), 10, 1, "k").collect()} and len(a) == 10


def test_distinct_count_needs_the_column(spark):
    with pytest.raises(KeyError):
        profile.count_distinct(spark.range(3), "nope")


def test_mappings(spark):
    df = spark.createDataFrame([(1, "a", "x")], "AppID int, Name string, Other string")
    rules = [("AppID", "appid", None), ("Name", "name", F.upper)]
    assert mapping.apply_mappings(df, rules).columns == ["appid", "name", "Other"]
    assert mapping.apply_mappings(df, rules, keep_only=True).first().asDict() == {"appid": 1, "name": "A"}
    with pytest.raises(ValueError, match="not found"):
        mapping.apply_mappings(df, [("Missing", "m", None)])


def test_contract_report(spark):
    df = spark.createDataFrame([("1", "x", "y")], "a string, b string, extra string")
    out, report = mapping.enforce_schema(df, {"a": P.to_long, "b": P.to_double, "gone": P.to_text})
    assert report == {"missing": ["gone"], "unmapped": ["extra"]} and tuple(out.first()) == (1, None, "y")
