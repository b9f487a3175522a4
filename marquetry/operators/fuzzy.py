"""Closest entries of a vocabulary for misspelt names, found through shared rare character grams.

An edit changes only the grams of length ``q`` that lie over it. So an entry within ``d`` edits of a text shares a gram with it
even if only as many of the rarest grams of both are compared as ``d`` edits cannot change. Texts are looked up in rounds of
growing distance: a round finds *every* entry whose distance is at most a given share of the longer length, so a text with
``k`` of them is settled for good. What no round settles is far from the whole vocabulary and is scored against all of it, block by block.

Texts whose edits lie in a common stem may be left with grams that crowds of entries share. Of the two halves of an entry within
``d`` edits one is within ``(d - 1) / 2`` or so, that is within one edit for ``d`` up to 3, and strings within one edit are equal
but for one sign left out of each. So these texts are looked up by their halves, less a sign, unless crowds share one of those too.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquetry.sources.writers import checkpoint

BLOCK = 1_000  # entries that a text is scored against at once
CARRIED = 64  # signs of a string that travels with its grams
HALVED = 3  # edits up to which a half lies within one edit
CROWD = 1_000  # entries that one gram or half of a text may meet before it is looked up in another way
SALTS = 16  # copies of each block, so that the texts of a block spread over tasks
# gram length and greatest distance in percent of the longer length; a shared gram is sure while q * percent < 100
ROUNDS = ((5, 12), (5, 19), (3, 30), (2, 45))


def _strings(df: DataFrame, col: str, number: str, name: str) -> DataFrame:
    """The distinct strings of a column, numbered and stored (the numbers hold for the stored rows only)."""
    rows = df.select(F.col(f"`{col}`").cast("string").alias(name)).where(F.col(name).isNotNull()).distinct()
    return checkpoint(rows.withColumn(number, F.monotonically_increasing_id()))


def _limits(percent: int) -> Column:
    """The distances that are asked for between a string and those of the other side (``lengths``) that may lie within ``percent``."""
    longer = lambda n: F.greatest(F.col("length"), n)
    near = F.filter("lengths", lambda n: F.abs(F.col("length") - n) * 100 <= longer(n) * percent)
    return F.array_distinct(F.transform(near, lambda n: F.floor(longer(n) * percent / 100).cast("int")))


def _grams(rows: DataFrame, number: str, name: str, q: int, lengths: Column, percent: int) -> DataFrame:
    """``number``, ``length``, ``gram``, ``at`` (its place), for strings that have a partner by length; ``limits`` as above."""
    padded = F.concat(F.lit("\x01" * (q - 1)), F.col(name), F.lit("\x02" * (q - 1)))
    cut = F.transform(
        F.sequence(F.lit(1), F.length("_padded") - (q - 1)),
        lambda i: F.struct(F.substring(F.col("_padded"), i, F.lit(q)).alias("gram"), i.alias("at")),
    )
    rows = rows.select(number, F.length(name).alias("length"), lengths.alias("lengths"), padded.alias("_padded"))
    rows = rows.withColumn("limits", _limits(percent)).where(F.size("limits") > 0)
    return rows.select(number, "length", "limits", F.explode(cut).alias("_g")).select(number, "length", "limits", "_g.*")


def _rarest(grams: DataFrame, frequency: DataFrame, number: str, q: int) -> DataFrame:
    """Per string and ``limit`` its rarest grams: as many as no ``limit`` edits can change all of, or else all. ``met`` counts
    the entries that hold them.

    An edit changes the grams that lie over it, so the edits needed are counted along the string; grams that only one side
    has come first: they cost edits and meet nothing.
    """
    known = grams.join(frequency, "gram")
    held = known.groupBy(number, "length", "limits").agg(F.array_sort(F.collect_list(F.struct("f", "gram", "at", "w"))).alias("_s"))
    held = held.withColumn("_along", F.array_sort(F.transform("_s", lambda x, i: F.struct(x["at"].alias("at"), i.alias("nth")))))
    held = held.select(number, "length", F.explode("limits").alias("limit"), "_s", "_along")

    def edits(last: Column) -> Column:
        """Edits that the grams up to number ``last`` take at least if none of them stays."""
        start = F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n"))
        met = lambda a, x: (x["nth"] <= last) & (x["at"] > a["upto"])
        step = lambda a, x: F.when(met(a, x), F.struct((x["at"] + (q - 1)).alias("upto"), (a["n"] + 1).alias("n"))).otherwise(a)
        return F.aggregate("_along", start, step)["n"]

    def halved(a: Column, _: Column) -> Column:
        middle = F.floor((a["low"] + a["high"]) / 2).cast("int")
        enough = edits(middle) > F.col("limit")
        low, high = F.when(enough, a["low"]).otherwise(F.least(middle + 1, a["high"])), F.when(enough, middle).otherwise(a["high"])
        return F.struct(low.alias("low"), high.alias("high"))

    whole = F.struct(F.lit(0).alias("low"), (F.size("_s") - 1).alias("high"))
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size("_s"))).cast("int"))
    held = held.withColumn("_last", F.get("_s", F.aggregate(rounds, whole, halved)["high"]))
    upto = lambda x: (x["f"] < F.col("_last.f")) | ((x["f"] == F.col("_last.f")) & (x["gram"] <= F.col("_last.gram")))
    shown = F.filter("_s", lambda x: (x["f"] > 0) & upto(x))
    # a generator, so that what is found here is not found again for every use of it
    held = held.select(number, "length", "limit", F.explode(F.array(shown)).alias("_s"))
    met = F.aggregate("_s", F.lit(0).cast("bigint"), lambda n, x: n + x["w"]).alias("met")
    return held.select(number, "length", "limit", met, F.explode("_s").alias("_g")).select(number, "length", "limit", "met", "_g.gram", "_g.at")


def _less_one(part: Column, edits: Column) -> Column:
    """A string, and if it may be edited all that is left of it without one sign."""
    cut = F.transform(F.sequence(F.lit(1), F.length(part)), lambda i: F.concat(F.substring(part, F.lit(1), i - 1), F.substring(part, i + 1, F.length(part))))
    return F.when((edits > 0) & (F.length(part) > 0), F.concat(F.array(part), cut)).otherwise(F.array(part))


def _halves(rows: DataFrame, name: str, lengths: Column) -> DataFrame:
    """``rows`` (with ``limit``) by ``half``: hashes of what a first or second half of an entry of one of ``lengths`` may be.

    An entry is cut in its middle, a text at every place where the halves may meet; hashes that clash add pairs to be measured.
    """
    text, left = F.col(name), F.floor(F.col("limit") / 2).cast("int")
    right = F.col("limit") - 1 - left

    def cuts(at: Callable[[Column], Column], edits: Column) -> Column:
        """Lengths of the part, for entries whose part is ``at(length)`` long."""
        near = F.flatten(F.transform(lengths, lambda n: F.sequence(at(n) - edits, at(n) + edits)))
        return F.array_distinct(F.filter(near, lambda n: (n >= 0) & (n <= F.length(text))))

    def hashed(side: int, part: Callable[[Column], Column], at: Callable[[Column], Column], edits: Column, own: bool) -> Column:
        sizes = F.transform(lengths, at) if own else cuts(at, edits)
        return F.transform(F.flatten(F.transform(sizes, lambda n: _less_one(part(n), edits))), lambda v: F.xxhash64(F.lit(side), v))

    middle = lambda n: F.floor(n / 2).cast("int")
    first = lambda n: F.substring(text, F.lit(1), n)
    last = lambda n: F.substring(text, F.length(text) - n + 1, n)
    own = name == "_word"
    firsts = hashed(1, first, middle, left, own)
    lasts = F.when(right >= 0, hashed(2, last, lambda n: (n - middle(n)).cast("int"), F.greatest(right, F.lit(0)), own)).otherwise(F.array().cast("array<bigint>"))
    return rows.withColumn("half", F.explode(F.array_distinct(F.concat(firsts, lasts))))


def _carried(grams: DataFrame, rows: DataFrame, number: str, name: str) -> DataFrame:
    """The strings beside their grams, so that a pair is measured where it is found; long ones (null here) are fetched later."""
    return grams.join(rows.select(number, F.when(F.length(name) <= CARRIED, F.col(name)).alias(f"_{name}")), number)


def _alike(percent: int) -> Callable[[Column], Column]:
    """Whether a string of some length may lie within ``percent`` of one of ``length``, and is asked for at ``limit``."""

    def met(n: Column) -> Column:
        longer = F.greatest(F.col("length"), n)
        return (F.abs(F.col("length") - n) * 100 <= longer * percent) & (F.floor(longer * percent / 100) == F.col("limit"))

    return met


def _by_halves(crowded: DataFrame, texts: DataFrame, words: DataFrame, lengths: dict[str, Column], percent: int, k: int | None) -> tuple[DataFrame, DataFrame]:
    """Of ``crowded`` (``text_no``, ``limit``) those that no crowd of entries shares a half with, and their pairs (the ``k`` best
    of those that one half makes)."""
    alike = _alike(percent)

    def asked(some: DataFrame) -> DataFrame:
        held = some.join(texts.select("text_no", F.col("text").alias("_text")), "text_no").withColumn("length", F.length("_text"))
        held = held.withColumn("lengths", lengths["word"]).withColumn("lengths", F.filter("lengths", alike))
        return _halves(held, "_text", F.col("lengths")).drop("lengths")

    shown = words.select("word_no", F.col("word").alias("_word"), F.length("word").alias("length"), lengths["text"].alias("lengths"))
    limits = F.filter(_limits(percent), lambda n: n <= HALVED)
    shown = shown.where(F.col("length") <= CARRIED).withColumn("limit", F.explode(limits)).drop("lengths")
    shown = _halves(shown, "_word", F.array("length"))
    by = ["limit", "half"]
    # at most a share of all halves that falls with CROWD; a crowd is never gathered
    crowds = checkpoint(shown.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > CROWD).select(*by))
    moved = checkpoint(crowded.join(asked(crowded).join(crowds, by, "left_semi").select("text_no", "limit").distinct(), ["text_no", "limit"], "left_anti"))
    entries = shown.join(crowds, by, "left_anti").groupBy(*by).agg(F.collect_list(F.struct("word_no", "_word")).alias("_entries"))
    met = asked(moved).join(entries, by)
    # -1 stands for more; an entry of another length may be met too, but scores behind those that are asked for
    score = "levenshtein(_text, x._word, limit) / greatest(length(_text), length(x._word), 1) - 1.0D"
    met = met.withColumn("_near", F.expr(f"transform(_entries, x -> struct({score} as minus, x._word as word, x.word_no as word_no))"))
    best = F.filter("_near", lambda x: x["minus"] >= -1.0)
    best = best if k is None else F.slice(F.array_sort(best), 1, k)
    return moved, met.select("text_no", F.explode(best).alias("_m")).select("text_no", "_m.word_no")


def candidate_pairs(texts: DataFrame, words: DataFrame, q: int, percent: int, k: int | None = None) -> DataFrame:
    """``text_no``, ``word_no`` of every pair (``text_no``, ``text``; ``word_no``, ``word``) that may lie within ``percent``.

    Pairs within it are never missed, but for those that cannot be among the ``k`` best of their text if ``k`` is given;
    ``q * percent`` must stay below 100. A gram that stays moves by no more places than there are edits. A text whose grams
    meet more than ``CROWD`` entries is looked up by its halves if that meets fewer.
    """
    if q * percent >= 100:
        raise ValueError("q * percent must be below 100")
    lengths = {n: rows.agg(F.collect_set(F.length(n)).alias("l")).select("l").scalar() for rows, n in ((texts, "text"), (words, "word"))}
    asked = _grams(texts, "text_no", "text", q, lengths["word"], percent)
    shown = _grams(words, "word_no", "word", q, lengths["text"], percent)
    # any one order serves both sides; the pairs that a gram makes are these
    seen = asked.select("gram", F.lit(1).alias("_t"), F.lit(0).alias("_w")).unionAll(shown.select("gram", F.lit(0).alias("_t"), F.lit(1).alias("_w")))
    frequency = seen.groupBy("gram").agg((F.sum("_t").cast("double") * F.sum("_w")).alias("f"), F.sum("_w").alias("w"))
    asked = checkpoint(_rarest(asked, frequency, "text_no", q))
    crowd = (F.col("met") > CROWD) & (F.col("limit") <= HALVED) & (F.col("length") <= CARRIED - HALVED)
    crowded = asked.where(crowd).select("text_no", "limit").distinct()
    halved = None
    if asked.where(crowd).head(1):
        moved, halved = _by_halves(crowded, texts, words, lengths, percent, k)
        asked = asked.join(moved, ["text_no", "limit"], "left_anti")
        if not asked.head(1):
            return halved.distinct()
    asked = _carried(asked.drop("met"), texts, "text_no", "text")
    shown = _carried(_rarest(shown, frequency, "word_no", q).drop("met"), words, "word_no", "word")
    shown = shown.withColumnsRenamed({"length": "word_length", "at": "word_at"})
    met = asked.join(shown, ["gram", "limit"]).where((F.abs(F.col("at") - F.col("word_at")) <= F.col("limit")) & _alike(percent)(F.col("word_length")))
    near = F.expr("levenshtein(_text, _word, limit)") >= 0
    pairs = met.where(F.coalesce(near, F.lit(True))).select("text_no", "word_no")
    return (pairs if halved is None else pairs.unionAll(halved)).distinct()


def _measured(distance: Column) -> Column:
    """Distance over the longer length, the order in which matches are ranked."""
    return distance / F.greatest(F.length("text"), F.length("word"), F.lit(1)) - 1.0


def _best(pairs: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("text_no").orderBy("minus", "word")
    return pairs.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def near_within(texts: DataFrame, words: DataFrame, q: int, percent: int, k: int | None = None) -> DataFrame:
    """All pairs within ``percent``: ``text_no``, ``text``, ``word``, ``minus`` (the score, less is better). With ``k`` some that are
    not among the ``k`` best of their text may be missing."""
    pairs = candidate_pairs(texts, words, q, percent, k).join(texts, "text_no").join(words, "word_no")
    limit = F.floor(F.greatest(F.length("text"), F.length("word")) * percent / 100).cast("int")
    # with a limit, -1 stands for more
    d = F.expr("levenshtein(text, word, _limit)")
    met = pairs.withColumn("_limit", limit).withColumn("_d", d).where("_d >= 0")
    return met.select("text_no", "text", "word", _measured(F.col("_d")).alias("minus"))


def vocabulary_blocks(words: DataFrame, block: int = BLOCK) -> tuple[DataFrame, int]:
    """The entries as arrays of about ``block`` each (columns ``block``, ``words``), and the number of blocks."""
    blocks = max(1, -(-words.count() // block))
    dealt = words.groupBy(F.pmod(F.xxhash64("word"), F.lit(blocks)).cast("int").alias("block"))
    return dealt.agg(F.collect_list("word").alias("words")), blocks


def scan(texts: DataFrame, words: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """``texts`` against all of ``words``: each text meets each block in an equi-join and keeps the ``k`` best of it in the row."""
    held, blocks = vocabulary_blocks(words, block)
    salt = F.pmod(F.xxhash64("text"), F.lit(SALTS)).cast("int")
    texts = texts.select("text_no", "text", salt.alias("salt"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    held = held.select("block", "words", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    longest = lambda w: F.greatest(F.length("text"), F.length(w), F.lit(1))
    scored = F.transform(
        "words",
        lambda w: F.struct((F.levenshtein(F.col("text"), w) / longest(w) - 1.0).alias("minus"), w.alias("word")),
    )
    near = texts.join(held, ["block", "salt"]).select("text_no", "text", F.explode(F.slice(F.array_sort(scored), 1, k)).alias("_m"))
    return near.select("text_no", "text", "_m.word", "_m.minus")


def fuzzy_lookup(
    df: DataFrame,
    col: str,
    vocab: DataFrame | Sequence[str],
    k: int = 1,
    block: int = BLOCK,
    rounds: Sequence[tuple[int, int]] = ROUNDS,
) -> DataFrame:
    """The ``k`` entries with the highest ``1 - levenshtein / longer length``, ties alphabetical.

    One row per distinct text and rank (``text``, ``rank``, ``match``, ``score``). Vocabulary and texts may have any size. Null
    texts and entries take no part, repeated ones count once; with fewer than ``k`` entries all are returned.
    Without ``rounds`` every text is scored against the whole vocabulary.
    """
    if isinstance(vocab, DataFrame):
        words = _strings(vocab, vocab.columns[0], "word_no", "word")
    else:
        words = _strings(df.sparkSession.createDataFrame([(w,) for w in vocab], "word string"), "word", "word_no", "word")
    open_ = _strings(df, col, "text_no", "text")
    found = []
    for q, percent in rounds:
        # a layer per round: what it settled is not asked again
        best = checkpoint(_best(near_within(open_, words, q, percent, k), k))
        settled = best.where(F.col("rank") == k).select("text_no")
        found.append(best.join(settled, "text_no", "left_semi"))
        open_ = checkpoint(open_.join(settled, "text_no", "left_anti"))
        if not open_.head(1):
            break
    else:
        found.append(_best(scan(open_, words, k, block), k))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out.select("text", "rank", F.col("word").alias("match"), (-F.col("minus")).alias("score"))
