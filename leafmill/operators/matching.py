"""One-to-one matching in order, as rounds of joins.

The rule is sequential: the lines of a group choose one after the other, each the best unit that is still free. Lines
that prefer the same units in the same order form a class. In a round the j-th open line of a class is put to the j-th best free unit of the
class; that is what the sequence would do unless an earlier line of another class may take that unit. So in each class
all lines before the first such doubt are settled at once, and the earliest open line of a group is always among them.

Groups of at most ``GROUP_ROWS`` lines and units need no rounds: they are walked in the row that gathers them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.operators.joins import broadcast_if_small
from leafmill.sources.scratch import written

#: Lines, and units, of a group that one row gathers.
GROUP_ROWS = 64


def by_size(lines: DataFrame, units: DataFrame, group: str, most: int) -> tuple[tuple[DataFrame, DataFrame], tuple[DataFrame, DataFrame] | None]:
    """Lines and units of groups with at most ``most`` of either, and those of larger groups (or of none) if there are any."""
    out = (F.col("count") > most) | F.col(group).isNull()
    counts = [df.groupBy(group).count().where(out).select(F.col(group).alias("_group")) for df in (lines, units)]
    large = written(counts[0].unionByName(counts[1]).distinct(), "large")
    if large.isEmpty():
        return (lines, units), None
    large, same = broadcast_if_small(large), F.col(group).eqNullSafe(F.col("_group"))
    split = {how: (lines.join(large, same, how), units.join(large, same, how)) for how in ("left_anti", "left_semi")}
    return split["left_anti"], split["left_semi"]


def gathered(lines: DataFrame, units: DataFrame, group: str, line: Callable[[], Column], unit: Callable[[], Column]) -> DataFrame:
    """``(group, lines, units)``: sorted arrays of the ``line()`` and ``unit()`` structs of each group that has any.

    Both sides move in one shuffle and the structs are made after it; their first fields give the order. Columns of
    equal name share their type.
    """
    own, other = lines.withColumn("_line", F.lit(True)), units.withColumn("_line", F.lit(False))
    rows = own.unionByName(other, allowMissingColumns=True).repartition(group)
    rows = rows.select(group, F.when(F.col("_line"), line()).alias("_l"), F.when(~F.col("_line"), unit()).alias("_u"))
    return rows.groupBy(group).agg(*[F.array_sort(F.collect_list(c)).alias(n) for c, n in (("_l", "lines"), ("_u", "units"))])


def walked(lines: Column, units: Column, score: Callable[[Column, Column], Column], kind: str) -> Column:
    """One entry for each line in its order: ``(at, score, unit)`` of the unit that it takes, or null.

    A line takes the free unit of the highest score, the first among equal ones; units without a score are not taken.
    ``kind`` is the type of a unit.
    """
    entry = f"struct<score:double,at:int,unit:{kind}>"

    def step(taken: Column, x: Column) -> Column:
        tried = F.transform(units, lambda u, i: F.struct(score(x, u).alias("score"), (-i).alias("at"), u.alias("unit")))
        free = F.filter(tried, lambda c: c["score"].isNotNull() & ~F.exists(taken, lambda t: F.coalesce(t["at"] == c["at"], F.lit(False))))
        return F.concat(taken, F.array(F.array_max(free).cast(entry)))

    return F.aggregate(lines, F.array().cast(f"array<{entry}>"), step)


def assign_in_order(lines: DataFrame, units: DataFrame, choices: DataFrame) -> DataFrame:
    """``(group, seq, useq)`` of every line that gets a unit.

    ``lines(group, cls, seq)`` choose in the order of ``seq``; ``units(group, ucls, useq)`` are used once;
    ``choices(group, cls, ucls, score)`` says which unit classes a class of lines accepts. The highest score is the
    best choice, the smallest ``useq`` among equal ones. Equals choosing line by line; no group is gathered, and the
    number of rounds depends on how classes compete, not on the size of groups.
    """
    choices, live = _by_preference(choices, lines)
    free, done = units.select("group", "ucls", "useq"), None
    by_line = W.partitionBy("group", "cls").orderBy("seq")
    by_choice = W.partitionBy("group", "cls").orderBy(F.desc("score"), "useq")
    by_claim = W.partitionBy("group", "useq").orderBy("_first", "cls")
    while not live.isEmpty():
        first = live.groupBy("group", "cls").agg(F.min("seq").alias("_first"), F.count("*").alias("_open"))
        wanted = choices.join(first, ["group", "cls"]).join(free, ["group", "ucls"])
        claims = wanted.withColumn("_at", F.row_number().over(by_choice))
        two = claims.withColumn("_r", F.row_number().over(by_claim)).where("_r <= 2").groupBy("group", "useq").agg(
            F.min(F.struct("_first", "cls")).alias("_one"), F.max(F.struct("_first", "cls")).alias("_two"), F.count("*").alias("_n")
        )
        # A class with n open lines takes one of its n best free units for each, or an earlier line takes it first.
        mine = claims.where("_at <= _open").select("group", "cls", "_at", "ucls", "useq")
        put = live.withColumn("_at", F.row_number().over(by_line)).join(mine, ["group", "cls", "_at"])
        rival = F.when(F.col("_one.cls") != F.col("cls"), F.col("_one._first")).when(F.col("_n") > 1, F.col("_two._first"))
        doubt = F.min(F.when(rival < F.col("seq"), F.col("_at"))).over(W.partitionBy("group", "cls"))
        judged = written(
            put.join(two, ["group", "useq"]).select(
                "group", "cls", "seq", "ucls", "useq", (doubt.isNull() | (F.col("_at") < doubt)).alias("_settled")
            )
        )
        settled = judged.where("_settled").select("group", "cls", "seq", "ucls", "useq")
        done = settled if done is None else done.unionByName(settled)
        # Lines without a unit of their own in this round get none: what a class may take only becomes less.
        live = judged.where("not _settled").select("group", "cls", "seq")
        free = written(free.join(settled.select("group", "useq"), ["group", "useq"], "left_anti").select("group", "ucls", "useq"))
    if done is None:
        done = live.join(units, "group").select("group", "cls", "seq", "ucls", "useq")
    return done.select("group", "seq", "useq")


def _by_preference(choices: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Choices and open lines with classes of equal preference; scores become ranks, as only their order counts."""
    rank = F.dense_rank().over(W.partitionBy("group", "cls").orderBy(F.desc("score")))
    marks = [F.sum(F.xxhash64("ucls", "_rank", F.lit(i)).cast("decimal(20,0)")) for i in (1, 2)]
    ranked = choices.select("group", "cls", "ucls", rank.alias("_rank"))
    over = W.partitionBy("group", "cls")
    marked = [m.over(over).cast("string") for m in marks]
    few = written(ranked.select("group", "cls", "ucls", "_rank", F.concat_ws(":", F.count("*").over(over), *marked).alias("_same")))
    live = lines.join(few.select("group", "cls", "_same").distinct(), ["group", "cls"]).select("group", F.col("_same").alias("cls"), "seq")
    return few.select("group", F.col("_same").alias("cls"), "ucls", (-F.col("_rank")).alias("score")).distinct(), written(live)


def rare_first(bags: DataFrame, threshold: float) -> DataFrame:
    """``(bag, words, few)`` of distinct word sets ``(bag, words)``: hashed words, and the rarest of them.

    Sets that share ``threshold`` of the larger one's words have one of each other's ``few`` in common, since all sets
    put their words in one order. Rarity is counted over the distinct sets.
    """
    hashed = bags.where(F.size("words") > 0).select("bag", F.transform("words", lambda w: F.xxhash64(w)).alias("words"))
    spread = hashed.select("bag", F.explode("words").alias("word"))
    df = spread.groupBy("word").agg(F.count("*").alias("df"))
    ordered = spread.join(df, "word").groupBy("bag").agg(F.array_sort(F.collect_list(F.struct("df", "word"))).alias("_o"))
    words = F.transform("_o", lambda o: o["word"])
    n = F.size("_o")
    return ordered.select("bag", words.alias("words"), F.slice(words, 1, n - F.ceil(n * threshold - 1e-9).cast("int") + 1).alias("few"))


def similar_bags(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """``(group, cls, ucls, score)`` of word sets that share ``threshold`` of the larger one's words or more.

    ``left(group, cls, words, few)`` and ``right(group, ucls, words, few)`` have the columns of ``rare_first``. A pair
    meets on its rarest common word only, so it meets once and a word that is everywhere joins nothing.
    """
    a = left.select("group", "cls", F.col("words").alias("_a"), F.col("few").alias("_fa"), F.explode("few").alias("_word"))
    b = right.select("group", "ucls", F.col("words").alias("_b"), F.col("few").alias("_fb"), F.explode("few").alias("_word"))
    score = F.size(F.array_intersect("_a", "_b")) / F.greatest(F.size("_a"), F.size("_b"))
    met = a.join(b, ["group", "_word"]).where(F.get(F.array_intersect("_fa", "_fb"), F.lit(0)) == F.col("_word"))
    return met.withColumn("score", score).where(F.col("score") >= threshold).select("group", "cls", "ucls", "score")
