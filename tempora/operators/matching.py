"""Choices by similarity or preference, and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tempora.functions.text import similarity

# Players, in order of preference.
PLAYERS = ("kodik", "cvh", "sibnet", "vk", "animedia", "aniboom", "anilibria", "sovetromantica")


def best_title(results: DataFrame, *, query: str = "query") -> DataFrame:
    """Of each query's results (query, no, title, original_title) the one most like it under either name; the first of equals.

    The result with the highest bound is compared first; of the others only those whose bound reaches what it scored.
    """
    q, names = F.lower(F.coalesce(F.col(query), F.lit(""))), ("title", "original_title")
    best = lambda f: F.greatest(*[f(F.lower(F.coalesce(F.col(n), F.lit(""))), q) for n in names])
    x = results.withColumn("bound", best(ratio_bound))
    seed = x.groupBy(query).agg(F.max_by(F.struct(*names), F.struct("bound", -F.col("no"))).alias("s")).select(query, "s.*").select(query, best(similarity).alias("reached"))
    # null queries have results too
    near = x.join(seed.withColumnRenamed(query, "__q"), F.col(query).eqNullSafe(F.col("__q"))).where(F.col("bound") >= F.col("reached") - 1e-12)
    scored = near.withColumn("score", best(similarity))
    return scored.groupBy(query).agg(F.max_by(F.struct("no", "title", "score"), F.struct("score", -F.col("no"))).alias("b")).select(query, "b.*")


def order_players(links: DataFrame, *, key: str, voice: str | None = None, player: str | None = None) -> DataFrame:
    """Links (key, no, label, player) with rank: by likeness of the label to ``voice``, then by player; unknown players last.

    Links without a player, and those of another player than the one asked for, go.
    """
    x = links.where(F.col("player").isNotNull())
    if player:
        x = x.where(F.col("player") == player.lower())
    x = x.withColumn("voice_score", similarity(F.col("label"), F.lit(voice)) if voice else F.lit(0.0))
    place = F.array_position(F.array(*map(F.lit, PLAYERS)), F.col("player"))
    w = Window.partitionBy(key).orderBy(F.col("voice_score").desc(), F.when(place > 0, place).otherwise(len(PLAYERS) + 1), "no")
    return x.withColumn("rank", F.row_number().over(w))


def pick_stream(streams: DataFrame, *, key: str, max_quality: int | None = None) -> DataFrame:
    """The best of each key's streams (key, quality, is_master, is_mp4).

    Under the limit and no master first, then a master under the limit, then without the limit in the same order;
    of those the highest quality, and mp4 among equals.
    """
    over = F.coalesce((F.col("quality") > max_quality).cast("int"), F.lit(0)) if max_quality else F.lit(0)
    w = Window.partitionBy(key).orderBy(over, F.col("is_master").cast("int"), F.col("quality").desc_nulls_last(), F.col("is_mp4").desc())
    return streams.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def batches(df: DataFrame, *, key: str, order: str, size: int) -> DataFrame:
    """``batch`` and ``place`` of each row: runs of ``size`` rows of a key, in order."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    return df.withColumn("batch", F.floor(n / size).cast("int")).withColumn("place", (n % size).cast("int"))


# ---------------------------------------------------------------- similarity with exact pruning


def _chars(c: Column) -> Column:
    """(char, count) of a text's distinct characters."""
    return F.transform(F.array_distinct(F.filter(F.split(c, ""), lambda x: x != "")), lambda x: F.struct(x.alias("char"), (F.length(c) - F.length(F.replace(c, x, F.lit("")))).cast("int").alias("n")))


def ratio_bound(a: Column, b: Column) -> Column:
    """At least the similarity of two lower-cased texts: twice the characters they share, as multisets, over their lengths."""
    shared = F.aggregate(_chars(a), F.lit(0), lambda s, x: s + F.least(x["n"], (F.length(b) - F.length(F.replace(b, x["char"], F.lit("")))).cast("int")))
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 1.0).otherwise(2.0 * shared / total)


def similar_texts(left: DataFrame, right: DataFrame, *, text: str = "text", least: float = 0.8) -> DataFrame:
    """(a, b, ratio): every pair of a distinct lower-cased text of ``left`` and one of ``right`` whose similarity is ``least`` or more.

    Matching blocks can't cover more characters than the texts share. So a pair at ``least`` shares a certain number of
    its marked characters (the third "e" is another one than the second), and at least one among the first few of each
    text, if marks are put in one order, rare ones first. An inverted index of those few, with bounds on the lengths, gives
    the candidates; the count of shared characters discards most of them, and what is left is compared. No pair is lost.

    Nulls are empty texts; two empty texts are alike. ``least`` is above 0. Copies are compared once: join by text for rows.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be above 0 and at most 1")
    c = candidates_within(left, right, text=text, least=least)
    return c.where(F.col("bound") >= least - 1e-12).withColumn("ratio", similarity("a", "b")).where(F.col("ratio") >= least).select("a", "b", "ratio")


def candidates_within(left: DataFrame, right: DataFrame, *, text: str = "text", least: float = 0.8) -> DataFrame:
    """(a, b, bound): the pairs that the index of ``similar_texts`` brings together, each once."""
    low = lambda df, name: df.select(F.lower(F.coalesce(F.col(text), F.lit(""))).alias(name)).distinct()
    a, b = low(left, "a"), low(right, "b")
    share = least / (2 - least)  # of a text's characters, what a partner must share

    marks = lambda df, name: df.select(F.col(name), F.length(name).alias("n"), F.explode(_chars(F.col(name))).alias("c")).select(name, "n", "c.char", F.col("c.n").alias("times"))
    x, y = marks(a, "a"), marks(b, "b")
    # as many rows as there are characters, 1,114,112 at most
    common = x.select("char", "times").unionByName(y.select("char", "times")).groupBy("char").agg(F.sum("times").alias("freq"))

    def index(m, name):
        some = m.join(F.broadcast(common), "char").select(name, "n", "char", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("nth"), "freq")
        order = F.struct((F.col("freq") / F.col("nth")).alias("rare"), F.concat("char", F.lit("#"), F.col("nth").cast("string")).alias("mark"))
        first = F.col("n") - F.ceil(share * F.col("n") - 1e-9).cast("int") + 1
        by = some.groupBy(name, "n").agg(F.array_sort(F.collect_list(order)).alias("all"))
        return by.select(name, F.col("n").alias(f"n_{name}"), F.explode(F.slice("all", F.lit(1), first)).alias("m")).select(name, f"n_{name}", F.col("m.mark").alias("mark"))

    pairs = index(x, "a").join(index(y, "b"), "mark").where((F.col("n_a") >= share * F.col("n_b") - 1e-9) & (F.col("n_b") >= share * F.col("n_a") - 1e-9)).select("a", "b").distinct()
    empty = a.where("a = ''").join(b.where("b = ''"), F.col("a") == F.col("b"))
    return pairs.unionByName(empty).withColumn("bound", ratio_bound(F.col("a"), F.col("b")))
