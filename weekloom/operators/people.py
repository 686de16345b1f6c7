"""People's names without a gazetteer: from how the corpus writes words.

A word that is capitalised inside sentences more often than it is written small is a name
word; a capital that only begins a sentence says nothing. Runs of name words are split into
names of one to three words so that neighbours that belong together stay together.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekloom.session import stored

PART = r"[\p{L}\p{M}\p{N}'’-]*"
SENTENCE_END = r"""[.!?\n\r]["'’”»)\] \t\n\r]*"""
RUN = rf"\p{{Lu}}{PART}(?:[ \t]+\p{{Lu}}{PART})*"
NAME_WORD = rf"[\p{{L}}\p{{N}}]{PART}"
# A run of capitalised words with what ends the sentence before it, or any other word.
UNIT = rf"(?:{SENTENCE_END})?{RUN}|{NAME_WORD}"
BEGINS = r"^[.!?\n\r]"
IS_RUN = rf"^(?:{SENTENCE_END})?\p{{Lu}}"


def _units(text: Column) -> Column:
    """Runs and other words of a text; the text itself begins a sentence."""
    whole = F.concat(F.lit("."), F.coalesce(text.cast("string"), F.lit("")))
    return F.regexp_extract_all(whole, F.lit(UNIT), F.lit(0))


def _links(known: DataFrame) -> DataFrame:
    """word, next and link: how much two neighbours belong together, in thousandths, if more
    than half of the rarer one's occurrences are next to the other."""
    alone = known.groupBy("word").agg(F.sum("n").alias("c"))
    both = known.where("next is not null").groupBy("word", "next").agg(F.sum("n").alias("both"))
    met = both.join(alone.withColumnRenamed("c", "ca"), "word").join(
        alone.select(F.col("word").alias("next"), F.col("c").alias("cb")), "next"
    )
    link = F.expr("1000 * both div least(ca, cb) - 500")
    return met.select("word", "next", link.alias("link")).where("link > 0")


def best_split(words: list[str], links: list[int]) -> list[str]:
    """Names of up to three words with the largest sum of links inside them.

    ``links[i]`` joins words i and i + 1; 0 keeps them apart. Of equal splits the one with the
    shorter last name is taken. Time is linear in the number of words.
    """
    best, size = [0], [0]
    for i in range(len(words)):
        options = [(best[i], -1)]
        if i >= 1 and links[i - 1]:
            options.append((best[i - 1] + links[i - 1], -2))
            if i >= 2 and links[i - 2]:
                options.append((best[i - 2] + links[i - 2] + links[i - 1], -3))
        total, words_in = max(options)
        best.append(total)
        size.append(-words_in)
    out, end = [], len(words)
    while end:
        out.append(" ".join(words[end - size[end] : end]))
        end -= size[end]
    return out[::-1]


def split_runs(units: DataFrame) -> DataFrame:
    """unit and names for every distinct run of ``units(unit, n)``, n its occurrences in the corpus."""
    words = units.select(
        "unit",
        "n",
        F.posexplode(F.transform(F.regexp_extract_all("unit", F.lit(NAME_WORD), F.lit(0)), F.lower)).alias("pos", "word"),
    )
    small = ~F.col("unit").rlike(IS_RUN)
    inside = ~small & ~(F.col("unit").rlike(BEGINS) & (F.col("pos") == 0))
    total = lambda which: F.coalesce(F.sum(F.when(which, F.col("n"))), F.lit(0))
    cases = words.groupBy("word").agg(total(inside).alias("capital"), total(small).alias("lower"))
    names = cases.where("capital > lower").select("word")
    after = F.lead(F.struct("pos", "word")).over(Window.partitionBy("unit").orderBy("pos"))
    known = words.where(~small).join(names, "word").withColumn("after", after)
    neighbour = F.when(F.col("after.pos") == F.col("pos") + 1, F.col("after.word"))
    known = stored(known.select("unit", "n", "pos", "word", neighbour.alias("next")), "name-words")

    @F.pandas_udf("array<string>")
    def split(runs: pd.Series) -> pd.Series:
        return pd.Series([best_split([w["word"] for w in run], [w["link"] for w in run]) for run in runs], dtype=object)

    linked = known.join(_links(known), ["word", "next"], "left")
    place = F.struct("pos", "word", F.coalesce("link", F.lit(0)).cast("long").alias("link"))
    return linked.groupBy("unit").agg(F.array_sort(F.collect_list(place)).alias("run")).select("unit", split("run").alias("names"))


def people_names(
    members: DataFrame,
    group_cols: list[str],
    *,
    text_col: str = "full_text",
    corpus: DataFrame | None = None,
) -> DataFrame:
    """Occurrences of names per cluster, lower-cased (``keyword``, ``cnt``).

    ``members`` has one row per (cluster, article). Case and neighbours are counted over
    ``corpus``, whose rows are texts in ``text_col``; it should hold the members' texts, and
    without it they are counted once per cluster. Null texts have no names. Texts become
    counts of distinct runs before anything is joined, so a frequent word is one row.
    """
    runs = members.select(*group_cols, F.explode(_units(F.col(text_col))).alias("unit"))
    if corpus is None:
        per_group = stored(runs.groupBy(*group_cols, "unit").agg(F.count(F.lit(1)).alias("n")), "name-units")
        units = per_group.groupBy("unit").agg(F.sum("n").alias("n"))
    else:
        per_group = runs.where(F.col("unit").rlike(IS_RUN)).groupBy(*group_cols, "unit").agg(F.count(F.lit(1)).alias("n"))
        every = corpus.select(F.explode(_units(F.col(text_col))).alias("unit"))
        units = every.groupBy("unit").agg(F.count(F.lit(1)).alias("n"))
    split = split_runs(stored(units, "units"))
    named = per_group.join(split, "unit").select(*group_cols, "n", F.explode("names").alias("keyword"))
    return named.groupBy(*group_cols, "keyword").agg(F.sum("n").alias("cnt"))
