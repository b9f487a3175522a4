"""All exports of the catalog and the completion times, written as files from the items, read back, and merged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquetry.operators import catalog
from marquetry.sources import readers, writers
from suite.build import folder, read_csv_export, read_dict_export, read_list_export, write_documents
from suite.items import items, over_items, query

_DATE, _SQL_DATE = "date_format(release_date, 'yyyy-MM-dd')", "strftime(release_date, '%Y-%m-%d')"

# --- the files: rows of the items that an export has, and per source column its type in the file and its value (Spark SQL) ---
FILES: dict[str, tuple[str, dict[str, tuple[str, str]]]] = {
    "set1": ("item_id % 3 = 0", {
        "AppID": ("string", "item_id"),
        "name": ("string", "concat('One ', item_id)"),
        "release_date": ("string", f"case when item_id % 2 = 1 then {_DATE} end"),
        "required_age": ("string", "item_id % 5"),
        "price": ("string", "price"),
        "dlc_count": ("string", "item_id % 4"),
        "windows": ("string", "case when item_id % 2 = 0 then 'True' else 'False' end"),
        "mac": ("string", "case when item_id % 7 = 0 then 'True' else 'False' end"),
        "linux": ("string", "'False'"),
        "achievements": ("string", "item_id % 11"),
        "recommendations": ("string", "pos"),
        "supported_languages": ("string", "\"['English', 'French']\""),
        "full_audio_languages": ("string", "'[]'"),
        "developers": ("string", "concat(\"['D1', 'd\", item_id % 3, \"x']\")"),
        "publishers": ("string", "case when item_id % 2 = 0 then \"['P1']\" end"),
        "categories": ("string", "\"['Single']\""),
        "genres": ("string", "\"['Action']\""),
        "tags": ("string", "concat('{', array_join(transform(tags, t -> concat('\"', t, '\": 5')), ', '), '}')"),
        "screenshots": ("string", "'a,b,c'"),
        "movies": ("string", "cast(null as string)"),
        "positive": ("string", "pos"),
        "negative": ("string", "neg"),
        "estimated_owners": ("string", "concat(item_id % 7, ' - ', item_id % 9)"),
        "average_playtime_forever": ("string", "item_id % 6"),
        "average_playtime_2weeks": ("string", "0"),
        "median_playtime_forever": ("string", "item_id % 8"),
        "median_playtime_2weeks": ("string", "'no number'"),
        "peak_ccu": ("string", "item_id % 17"),
        "metacritic_score": ("string", "0"),
    }),
    "set3": ("item_id % 4 <> 1", {
        "AppID": ("string", "item_id"),
        "Name": ("string", "concat('Three ', item_id)"),
        "Release date": ("string", _DATE),
        "Required age": ("string", "12"),
        "Price": ("string", "price / 2"),
        "DLC count": ("string", "item_id % 3"),
        "Windows": ("string", "'true'"),
        "Mac": ("string", "item_id % 5 = 0"),
        "Linux": ("string", "'true'"),
        "Achievements": ("string", "item_id % 13"),
        "Supported languages": ("string", "\"['English', 'German']\""),
        "Full audio languages": ("string", "\"['English']\""),
        "Recommendations": ("string", "neg"),
        "Average playtime forever": ("string", "item_id % 9"),
        "Average playtime two weeks": ("string", "item_id % 3"),
        "Median playtime forever": ("string", "7"),
        "Median playtime two weeks": ("string", "item_id % 2"),
        "Peak CCU": ("string", "19"),
        "Developers": ("string", "'D1,D3'"),
        "Publishers": ("string", "'P3'"),
        "Categories": ("string", "'Single,Multi'"),
        "Genres": ("string", "'Action,RPG'"),
        "Tags": ("string", "'ring,new'"),
        "Screenshots": ("string", "'x,y'"),
        "Movies": ("string", "case when item_id % 2 = 0 then 'm' end"),
        "Positive": ("string", "pos + 1"),
        "Negative": ("string", "cast(null as string)"),
        "Estimated owners": ("string", "'0 - 20000'"),
    }),
    "set6": ("item_id % 2 = 1", {
        "steam_appid": ("string", "item_id"),
        "name": ("string", "'Six'"),
        "release_date": ("string", "'2006-06-06'"),
        "developers": ("string", "\"['D6']\""),
        "publishers": ("string", "'P six'"),
        "categories": ("string", "'[]'"),
        "genres": ("string", "\"['Action', 'Indie']\""),
        "required_age": ("string", "18"),
        "n_achievements": ("string", "5"),
        "platforms": ("string", "case when item_id % 3 = 0 then 'windows;mac' else 'linux' end"),
        "total_positive": ("string", "7"),
        "total_negative": ("string", "9"),
        "metacritic": ("string", "item_id % 100"),
        "price_initial (USD)": ("string", "price"),
        "is_free": ("string", "price = 0"),
    }),
    "set7": ("item_id % 5 <> 2", {
        "sid": ("string", "item_id"),
        "published_store": ("string", "'2007-07-07'"),
        "name": ("string", "'Seven'"),
        "full_price": ("string", "item_id % 1000 + 1"),
        "current_price": ("string", "case when item_id % 3 = 0 then 'free' else '250' end"),
        "platforms": ("string", "case when item_id % 2 = 0 then 'WIN,LNX' else 'MAC' end"),
        "developers": ("string", "'D7'"),
        "publishers": ("string", "'P7'"),
        "languages": ("string", "'English,Italian'"),
        "voiceovers": ("string", "cast(null as string)"),
        "categories": ("string", "'Coop'"),
        "genres": ("string", "'RPG,Puzzle'"),
        "tags": ("string", "'seven'"),
        "gfq_difficulty": ("string", "'Easy'"),
        "gfq_rating": ("string", "3.5"),
        "gfq_length": ("string", "12.25"),
        "stsp_owners": ("string", "50000"),
        "hltb_single": ("string", "item_id % 20"),
        "hltb_complete": ("string", "item_id % 40"),
        "meta_uscore": ("string", "71"),
        "igdb_uscore": ("string", "80.5"),
        "igdb_single": ("string", "cast(null as string)"),
        "igdb_complete": ("string", "33"),
    }),
    "set9": ("item_id % 4 = 1", {
        "id": ("long", "case when item_id % 8 = 1 then item_id else item_id + 1000000000 end"),
        "name": ("string", "concat('Nine ', item_id)"),
        "developers": ("array<string>", "array('D9')"),
        "publishers": ("array<string>", "array('P9')"),
        "release_date": ("string", "cast(null as string)"),
        "initialprice": ("double", "cast(item_id % 200 as double)"),
        "drm": ("string", "case when item_id % 3 = 0 then 'true' else 'none' end"),
        "controller_support": ("string", "'full'"),
        "demos": ("boolean", "item_id % 3 = 1"),
        "vr_only": ("boolean", "item_id % 7 = 1"),
        "vr_supported": ("boolean", "true"),
        "supported_languages": ("string", "'English,Thai'"),
        "voice_languages": ("string", "'Thai'"),
        "metacritic": ("string", "case when item_id % 3 = 0 then 'FALSE' else '88' end"),
        "total_positive": ("long", "3"),
        "total_negative": ("long", "4"),
        "playtime_mean_forever": ("double", "1.25"),
        "playtime_median_forever": ("double", "2.25"),
        "playtime_mean_last2weeks": ("double", "3.25"),
        "playtime_median_last2weeks": ("double", "4.25"),
        "peak_players_17April2022": ("long", "55"),
        "owners": ("string", "'10,000 .. 20,000'"),
        "platforms": ("array<string>", "array('windows')"),
    }),
}

# --- the twin: per shared column its kind and, by export in merge order, its value (DuckDB SQL) where the export has the row ---
HAS = {
    "set1": "item_id % 3 = 0", "set2": "true", "set3": "item_id % 4 <> 1", "set5": "item_id % 5 <> 0", "set6": "item_id % 2 = 1",
    "set7": "item_id % 5 <> 2", "set8": "item_id % 4 <> 0", "set9": "item_id % 8 = 1",
}
_TEXT, _NUMBER, _FLAG, _LIST = "text", "number", "flag", "list"
SHARED: dict[str, tuple[str, dict[str, str]]] = {
    "name": (_TEXT, {"set1": "'One ' || item_id", "set2": "'The \"' || item_id || '\", a title'", "set3": "'Three'", "set5": "'other name'", "set6": "'Six'", "set7": "'Seven'", "set8": "'t'", "set9": "'Nine ' || item_id"}),
    "release_date": (_TEXT, {"set1": f"case when item_id % 2 = 1 then {_SQL_DATE} end", "set2": _SQL_DATE, "set3": _SQL_DATE, "set5": "'2001-01-01'", "set6": "'2006-06-06'", "set7": "'2007-07-07'", "set9": "null"}),
    "required_age": (_NUMBER, {"set1": "item_id % 5", "set3": "12", "set6": "18"}),
    "price_2024_05": (_NUMBER, {"set1": "price"}),
    "dlc_count": (_NUMBER, {"set1": "item_id % 4", "set3": "item_id % 3"}),
    "windows": (_FLAG, {"set1": "item_id % 2 = 0", "set2": "item_id % 2 = 0", "set3": "true", "set6": "item_id % 3 = 0", "set7": "item_id % 2 = 0"}),
    "mac": (_FLAG, {"set1": "item_id % 7 = 0", "set2": "false", "set3": "item_id % 5 = 0", "set6": "item_id % 3 = 0", "set7": "item_id % 2 <> 0"}),
    "linux": (_FLAG, {"set1": "false", "set2": "true", "set3": "true", "set6": "item_id % 3 <> 0", "set7": "item_id % 2 = 0"}),
    "achievements": (_NUMBER, {"set1": "item_id % 11", "set3": "item_id % 13", "set6": "5"}),
    "recommendations": (_NUMBER, {"set1": "pos", "set3": "neg"}),
    "supported_languages": (_LIST, {"set1": "['English', 'French']", "set3": "['English', 'German']", "set7": "['English', 'Italian']", "set9": "['English', 'Thai']"}),
    "full_audio_languages": (_LIST, {"set1": "[]", "set3": "['English']", "set7": "[]", "set9": "['Thai']"}),
    "developers": (_LIST, {"set1": "['D1', 'd' || (item_id % 3) || 'x']", "set3": "['D1', 'D3']", "set5": "['A', 'B']", "set6": "['D6']", "set7": "['D7']", "set9": "['D9']"}),
    "publishers": (_LIST, {"set1": "case when item_id % 2 = 0 then ['P1'] else [] end", "set3": "['P3']", "set5": "['C']", "set6": "['P six']", "set7": "['P7']", "set9": "['P9']"}),
    "categories": (_LIST, {"set1": "['Single']", "set3": "['Single', 'Multi']", "set5": "['Single']", "set6": "[]", "set7": "['Coop']"}),
    "genres": (_LIST, {"set1": "['Action']", "set3": "['Action', 'RPG']", "set5": "case when len(tags) = 0 then [''] else tags end", "set6": "['Action', 'Indie']", "set7": "['RPG', 'Puzzle']"}),
    "tags": (_LIST, {"set1": "tags", "set3": "['ring', 'new']", "set7": "['seven']", "set8": "case when len(tags) = 0 then [''] else tags end"}),
    "screenshots": (_NUMBER, {"set1": "3", "set3": "2"}),
    "movies": (_NUMBER, {"set1": "0", "set3": "1 - item_id % 2"}),
    "positive": (_NUMBER, {"set1": "pos", "set3": "pos + 1", "set5": "pos", "set6": "7", "set9": "3"}),
    "negative": (_NUMBER, {"set1": "neg", "set3": "null", "set5": "neg", "set6": "9", "set9": "4"}),
    "estimated_owners": (_NUMBER, {"set1": "(item_id % 7 + item_id % 9) / 2.0", "set3": "10000", "set5": "(item_id % 7 * 2 + 10) / 2.0", "set9": "15000"}),
    "average_playtime_forever": (_NUMBER, {"set1": "item_id % 6", "set3": "item_id % 9", "set5": "1.5", "set9": "1.25"}),
    "average_playtime_2weeks": (_NUMBER, {"set1": "0", "set3": "item_id % 3", "set9": "3.25"}),
    "median_playtime_forever": (_NUMBER, {"set1": "item_id % 8", "set3": "7", "set5": "2.5", "set9": "2.25"}),
    "median_playtime_2weeks": (_NUMBER, {"set1": "null", "set3": "item_id % 2", "set9": "4.25"}),
    "peak_ccu": (_NUMBER, {"set1": "item_id % 17", "set3": "19", "set9": "55"}),
    "metacritic_score": (_NUMBER, {"set1": "0", "set6": "item_id % 100", "set7": "71", "set9": "case when item_id % 3 <> 0 then 88 end"}),
    "price_2024_08": (_NUMBER, {"set2": "price"}),
    "price_original": (_NUMBER, {"set2": "null", "set6": "price", "set7": "(item_id % 1000 + 1) / 100.0", "set9": "case when item_id % 200 < 150 then item_id % 200 end"}),
    "steam_deck": (_FLAG, {"set2": "item_id % 3 = 0"}),
    "price_2024_09": (_NUMBER, {"set3": "price / 2"}),
    "price_2019_06": (_NUMBER, {"set5": "price"}),
    "is_free": (_FLAG, {"set6": "price = 0"}),
    "price_2023_11": (_NUMBER, {"set7": "case when item_id % 3 <> 0 then 2.5 end"}),
    "gamefaqs_difficulty_rating": (_TEXT, {"set7": "'Easy'"}),
    "gamefaqs_review_score": (_NUMBER, {"set7": "3.5"}),
    "gamefaqs_game_length": (_NUMBER, {"set7": "12.25"}),
    "steam_spy_estimated_owners": (_NUMBER, {"set7": "50000"}),
    "hltb_single": (_NUMBER, {"set7": "item_id % 20"}),
    "hltb_complete": (_NUMBER, {"set7": "item_id % 40"}),
    "igdb_review_score": (_NUMBER, {"set7": "80.5"}),
    "igdb_single": (_NUMBER, {"set7": "null"}),
    "igdb_complete": (_NUMBER, {"set7": "33"}),
    "early_access": (_FLAG, {"set8": "false"}),
    "vr_only": (_FLAG, {"set8": "true", "set9": "item_id % 7 = 1"}),
    "vr_supported": (_FLAG, {"set8": "null", "set9": "true"}),
    "has_drm": (_FLAG, {"set9": "case when item_id % 3 = 0 then true end"}),
    "controller_support": (_TEXT, {"set9": "'full'"}),
    "has_demos": (_FLAG, {"set9": "item_id % 3 = 1"}),
}
_EMPTY = {_TEXT: "''", _NUMBER: "0.0", _FLAG: "false"}
_KIND = {_TEXT: "varchar", _NUMBER: "double", _FLAG: "boolean", _LIST: "varchar[]"}


def _merged_sql(kind: str, values: dict[str, str], has: dict[str, str]) -> str:
    """The first value that is not empty, else the last export's; lists are united onto the first export's, if it has the row."""
    own = [f"cast(case when {has[s]} then {v} end as {_KIND[kind]})" for s, v in values.items()]
    if kind == _LIST:
        all_of = f"flatten([{', '.join(f'coalesce({v}, [])' for v in own)}])"
        return f"case when {own[0]} is not null then array_to_string(list_sort(list_distinct({all_of})), '|') end"
    return f"coalesce({', '.join([*(f'nullif({v}, {_EMPTY[kind]})' for v in own[:-1]), own[-1]])})"


def _catalog_sql() -> str:
    """Rows of the items, and those that only set 9 has."""
    beyond = {s: str(s == "set9").lower() for s in HAS}
    known = ", ".join(f'{_merged_sql(kind, v, HAS)} as "{c}"' for c, (kind, v) in SHARED.items())
    alone = ", ".join(f'{_merged_sql(kind, v, beyond)} as "{c}"' for c, (kind, v) in SHARED.items())
    merged = f"select item_id as appid, {known} from items union all select item_id + 1000000000, {alone} from items where item_id % 8 = 5"
    times = """cast(case when t = 1 then appid % 50 when t = 2 then 1 end as double) as hltb_main_story,
  cast(case when t = 1 then appid % 70 end as double) as hltb_main_plus_extras, cast(case when t = 1 then 9.5 when t = 2 then 2 end as double) as hltb_completionist"""
    timed = "case when name = 'One ' || appid and appid % 6 = 0 then 1 when name like 'The \"%' and appid % 5 = 1 then 2 end"
    columns = ", ".join(f'"{c}"' for c in SHARED)
    return over_items(f"select appid, {columns}, {times} from (select *, {timed} as t from merged)", merged=merged)


def completion_times(spark: SparkSession, sf: str) -> DataFrame:
    """Titles of two exports, some of them twice (the smallest row counts)."""
    rows = items(spark, sf)
    times = lambda title, *values: F.struct(F.expr(title).alias("title"), *[F.expr(f"cast({v} as double)").alias(c) for c, v in zip(catalog.COMPLETION_COLUMNS[1:], values)])
    one = rows.where("item_id % 6 = 0").select(times("concat('One ', item_id)", "item_id % 50", "item_id % 70", "9.5").alias("t"))
    again = rows.where("item_id % 12 = 0").select(times("concat('One ', item_id)", "item_id % 50 + 1", "0", "0").alias("t"))
    two = rows.where("item_id % 5 = 1").select(times("concat('The \"', item_id, '\", a title')", "1", "null", "2").alias("t"))
    return one.unionAll(again).unionAll(two).select("t.*")


_WRITTEN: set[str] = set()


def files(spark: SparkSession, sf: str) -> str:
    """Folder of the exports that ``suite.build`` does not write, in the formats they come in, compressed; written once per application."""
    root = folder(spark, sf)
    if root not in _WRITTEN:
        for name, (which, columns) in FILES.items():
            rows = items(spark, sf).where(which).select(*[F.expr(v).cast(t).alias(c) for c, (t, v) in columns.items()])
            if name == "set9":
                write_documents(rows, f"{root}/{name}.json", F.to_json(F.struct("*")), "[", "]")
            else:
                writers.write(rows, f"{root}/{name}.csv", fmt="csv", packed=True)
        writers.write(completion_times(spark, sf), f"{root}/set4.csv", fmt="csv")  # joined: its size must tell what it holds
        _WRITTEN.add(root)
    return root


def sources(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    root = files(spark, sf)
    schema = lambda name: ", ".join(f"`{c}` {t}" for c, (t, _) in FILES[name][1].items())
    own = {n: readers.read_csv(spark, f"{root}/{n}.csv", schema(n)) for n in FILES if n != "set9"}
    own["set9"] = readers.read_json_list(spark, f"{root}/set9.json", schema("set9"))
    return {**own, "set2": read_csv_export(spark, sf), "set5": read_list_export(spark, sf), "set8": read_dict_export(spark, sf)}


@query("d05_merge_catalog", _catalog_sql())
def _(spark, sf):
    """All nine exports from their files: eight by key in one shuffle, completion times by name; every column."""
    times = readers.read_csv(spark, f"{files(spark, sf)}/set4.csv", "title string, main_story double, main_plus_extras double, completionist double")
    merged = catalog.merge_catalog(sources(spark, sf), times)
    lists = {c: F.array_join(F.array_sort(F.array_distinct(c)), "|") for c in catalog.LISTS}
    return merged.withColumns(lists)
