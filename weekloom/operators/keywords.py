"""Keywords of a cluster: candidates, scores, top-k, clean-up, string form."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weekloom.functions.words import (
    WORD,
    drop_words,
    explode_ngrams,
    tokens,
    whole_word,
    wordy_tokens,
)
from weekloom.operators.entities import SPLITS, inline_lexicon
from weekloom.session import stored

# Different hashes of wanted phrases; as longs, a broadcast of at most some 100 MB.
MARKS = 1 << 22
# Share of the phrases left in from which leaving out the others is not worth its shuffles.
MOST_LEFT = 0.5
NAME_RUN = r"\p{Lu}[\p{L}\p{N}_]*(?: \p{Lu}[\p{L}\p{N}_]*){1,2}"


def phrase_counts(
    members: DataFrame,
    group_cols: list[str],
    *,
    text_col: str = "full_text",
    low: int = 1,
    high: int = 2,
    stop_words: list[str] = (),
    min_chars: int = 1,
    among: DataFrame | None = None,
) -> DataFrame:
    """Occurrences of every n-gram per cluster (``keyword``, ``cnt``).

    ``members`` has one row per (cluster, article). Digit-only tokens and stop words go
    before the n-grams are formed. The cluster's texts are never put together: counts are
    added up, on the map side first.

    If only the phrases ``among`` a table (column ``keyword``) are wanted, most others are
    left out before counts are shuffled: those whose hash no phrase of the table has. A few
    others may remain. There are at most ``MARKS`` such hashes, so they can be broadcast.
    """
    words = drop_words(wordy_tokens(F.col(text_col)), list(stop_words))
    if min_chars > 1:
        words = F.filter(words, lambda w: F.length(w) >= min_chars)
    phrases = explode_ngrams(
        members.select(*group_cols, words.alias("_words")), group_cols, "_words", low, high
    )
    if among is not None:
        mark = F.pmod(F.xxhash64("keyword"), F.lit(MARKS)).alias("_mark")
        marks = stored(among.select(mark).distinct(), "marks")
        phrases = phrases.withColumn("_mark", mark).join(F.broadcast(marks), "_mark", "left_semi")
    return phrases.groupBy(*group_cols, "keyword").agg(F.count(F.lit(1)).alias("cnt"))


def people_counts(
    members: DataFrame,
    group_cols: list[str],
    *,
    text_col: str = "full_text",
    gazetteer: DataFrame | None = None,
) -> DataFrame:
    """Occurrences of people's names per cluster, lower-cased (``keyword``, ``cnt``).

    Names are runs of two or three capitalised words. With a ``gazetteer`` (one column,
    ``name``) only its names of one to three words count, wherever they occur.
    """
    if gazetteer is None:
        runs = F.regexp_extract_all(F.col(text_col), F.lit(NAME_RUN), F.lit(0))
        found = F.transform(runs, F.lower)
        people = members.select(*group_cols, F.explode(found).alias("keyword"))
        return people.groupBy(*group_cols, "keyword").agg(F.count(F.lit(1)).alias("cnt"))
    names = stored(
        gazetteer.select(F.array_join(tokens(F.col(gazetteer.columns[0])), " ").alias("keyword")).distinct(),
        "gazetteer",
    )
    grams = phrase_counts(members, group_cols, text_col=text_col, low=1, high=3, among=names)
    return grams.join(names, "keyword", "left_semi")


def score_ctfidf(counts: DataFrame, group_cols: list[str]) -> DataFrame:
    """Class-based TF-IDF: share of the phrase in its cluster, times
    log(1 + mean phrases per cluster / occurrences of the phrase anywhere)."""
    sizes = counts.groupBy(*group_cols).agg(F.sum("cnt").alias("_size"))
    spread = counts.groupBy("keyword").agg(F.sum("cnt").alias("_everywhere"))
    mean = sizes.select(F.avg("_size").alias("m")).scalar()
    tf = F.col("cnt").cast("double") / F.col("_size")
    idf = F.log(F.lit(1.0) + mean / F.col("_everywhere"))
    return (
        counts.join(sizes, group_cols)
        .join(spread, "keyword")
        .select(*group_cols, "keyword", "cnt", (tf * idf).alias("score"))
    )


def top_ctfidf(counts: DataFrame, group_cols: list[str], k: int = 10) -> DataFrame:
    """``top_keywords`` of ``score_ctfidf``, without scoring the long tail.

    A phrase occurs in all clusters together at least as often as in its own, and at most
    as often as the commonest phrase. The first gives the highest score its count allows,
    the second a score that the ``k`` phrases of highest count are sure to reach. Phrases
    whose highest score lies below that are left out before counts meet their totals, a
    join that would shuffle every count otherwise. The result is the same. No phrase is
    commoner than the clusters' highest counts added up, so that sum stands for the commonest
    one, and only phrases that are left in are counted over all clusters.

    If most phrases are left in, as in clusters of few articles, none is left out and all
    counts are dealt by phrase once. The counts are written once and read from there, as
    several scans need them.
    """
    counts = stored(counts, "phrase-counts")
    # Few rows: the distinct counts of each cluster, and how many phrases have them.
    steps = stored(counts.groupBy(*group_cols, "cnt").agg(F.count(F.lit(1)).alias("_phrases")), "phrase-steps")
    falling = Window.partitionBy(*group_cols).orderBy(F.desc("cnt"))
    reached = steps.withColumn("_upto", F.sum("_phrases").over(falling))
    per_cluster = reached.groupBy(*group_cols).agg(
        F.sum(F.col("cnt") * F.col("_phrases")).alias("_size"),
        F.max("cnt").alias("_most"),
        # The k-th highest count; the lowest there is if the cluster has fewer phrases.
        F.greatest(
            F.min("cnt"), F.coalesce(F.max(F.when(F.col("_upto") >= k, F.col("cnt"))), F.lit(0))
        ).alias("_kth"),
    )
    per_cluster = stored(per_cluster, "phrase-totals")
    mean = per_cluster.select(F.avg("_size").alias("m")).scalar()
    most = per_cluster.select(F.sum("_most").alias("f")).scalar()

    def value(cnt: Column, everywhere: Column) -> Column:
        return cnt * F.log(F.lit(1.0) + mean / everywhere)

    able = value(F.col("cnt"), F.col("cnt"))
    sure = value(F.col("_kth"), most) * F.lit(1.0 - 1e-9)
    # The steps tell how many phrases are left in.
    share = steps.join(per_cluster, group_cols).agg(
        F.sum(F.when(able >= sure, F.col("_phrases")).otherwise(0)) / F.sum("_phrases")
    ).first()[0]
    if share is not None and share > MOST_LEFT:
        # One shuffle serves the totals and the join.
        dealt = counts.repartition("keyword")
        spread = dealt.groupBy("keyword").agg(F.sum("cnt").alias("_everywhere"))
        kept = dealt.join(per_cluster, group_cols)
    else:
        kept = stored(counts.join(per_cluster, group_cols).where(able >= sure), "phrases-left")
        left = stored(kept.select("keyword").distinct(), "phrases-wanted")
        spread = counts.join(left, "keyword", "left_semi").groupBy("keyword").agg(F.sum("cnt").alias("_everywhere"))
    tf = F.col("cnt").cast("double") / F.col("_size")
    idf = F.log(F.lit(1.0) + mean / F.col("_everywhere"))
    scored = kept.join(spread, "keyword").select(
        *group_cols, "keyword", "cnt", (tf * idf).alias("score")
    )
    return top_keywords(scored, group_cols, k)


def score_centroid(
    members: DataFrame,
    candidates: DataFrame,
    group_cols: list[str],
    *,
    text_col: str = "full_text",
    vector_col: str = "embedding",
    id_col: str = "article_id",
    low: int = 1,
    high: int = 2,
    stop_words: list[str] = (),
) -> DataFrame:
    """Cosine between the cluster's mean vector and the mean vector of the cluster's
    articles that hold the candidate.

    Phrases are formed as in ``phrase_counts``; use the same ``stop_words`` there and here.
    The candidates are written once, so that Spark knows their size and need not shuffle all
    phrases of all texts to meet a few.
    """
    wanted = stored(candidates.select(*group_cols, "keyword").distinct(), "candidates")
    vec = array_to_vector(F.col(vector_col).cast("array<double>"))
    grams = explode_ngrams(
        members.select(
            *group_cols,
            id_col,
            drop_words(wordy_tokens(F.col(text_col)), list(stop_words)).alias("_words"),
        ),
        [*group_cols, id_col],
        "_words",
        low,
        high,
    )
    held = (
        grams.join(wanted, [*group_cols, "keyword"], "left_semi")
        .distinct()
        .join(members.select(*group_cols, id_col, vec.alias("_v")), [*group_cols, id_col])
    )
    phrase = held.groupBy(*group_cols, "keyword").agg(
        vector_to_array(Summarizer.mean(F.col("_v"))).alias("_p")
    )
    centre = (
        members.select(*group_cols, vec.alias("_v"))
        .groupBy(*group_cols)
        .agg(vector_to_array(Summarizer.mean(F.col("_v"))).alias("_c"))
    )

    def dot(a: str, b: str) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    cosine = F.try_divide(dot("_p", "_c"), F.sqrt(dot("_p", "_p") * dot("_c", "_c")))
    return phrase.join(centre, group_cols).select(
        *group_cols, "keyword", F.coalesce(cosine, F.lit(0.0)).alias("score")
    )


def top_keywords(scored: DataFrame, group_cols: list[str], k: int = 10) -> DataFrame:
    """Best ``k`` per cluster; ties by keyword. Spark keeps only ``k`` rows per cluster
    and partition before the shuffle."""
    best = Window.partitionBy(*group_cols).orderBy(F.desc("score"), "keyword")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def drop_own_aliases(
    keywords: DataFrame, lexicon: DataFrame, entity_col: str = "entity_id"
) -> DataFrame:
    """Drop keywords that name the entity itself. For an unknown entity only an empty
    keyword goes.

    A small lexicon becomes part of the row expression. A larger one is joined by entity in
    ``SPLITS`` places, as one entity may have a large share of all keywords.
    """
    rows = inline_lexicon(lexicon)
    if rows is not None:
        own: dict[int, list[str]] = {}
        for r in rows:
            own.setdefault(r["entity_id"], []).append(r["pattern"])
        names = F.lit(False)
        for entity, patterns in own.items():
            names = names | ((F.col(entity_col) == entity) & F.col("keyword").rlike(whole_word("|".join(patterns))))
        known = F.coalesce(F.col(entity_col).isin(list(own)), F.lit(False)) if own else F.lit(False)
        return keywords.where(F.when(known, ~names).otherwise(F.col("keyword") != ""))
    every = F.concat_ws("|", F.array_sort(F.collect_set("pattern")))
    whole = F.concat(F.lit(f"(?iu)(?<!{WORD})(?:"), every, F.lit(f")(?!{WORD})"))
    own_names = lexicon.groupBy(F.col("entity_id").alias("_e")).agg(whole.alias("_p")).withColumn(
        "_s", F.explode(F.sequence(F.lit(0), F.lit(SPLITS - 1)))
    )
    split = F.pmod(F.xxhash64("keyword"), F.lit(SPLITS)).cast("int")
    return (
        keywords.join(own_names, (keywords[entity_col] == own_names["_e"]) & (split == own_names["_s"]), "left")
        .where(~F.expr("keyword rlike coalesce(_p, '^$')"))
        .drop("_e", "_p", "_s")
    )


def drop_contained(keywords: DataFrame, group_cols: list[str]) -> DataFrame:
    """Drop keywords contained, up to case, in another keyword of the cluster.

    Of keywords equal up to case the longest stays, then the best scored, then the first
    by name. Containment is found by an equi-join on the proper substrings of each
    keyword, so no pairs of keywords are formed.
    """
    low = F.lower("keyword")
    first = keywords.groupBy(*group_cols, "keyword").agg(F.max("score").alias("score"))
    # Written once: all that follows reads these few rows again.
    single = stored(
        first.groupBy(*group_cols, low.alias("_low"))
        .agg(
            F.min_by(
                F.struct("keyword", "score"),
                F.struct(-F.length("keyword"), -F.col("score"), F.col("keyword")),
            ).alias("_best")
        )
        .select(*group_cols, "_low", "_best.keyword", "_best.score"),
        "keywords",
    )
    # Only substrings as long as some keyword of the cluster can equal one.
    lengths = single.groupBy(*group_cols).agg(F.collect_set(F.length("_low")).alias("_lengths"))
    size = F.length("_low")
    cuts = F.flatten(
        F.transform(
            F.filter("_lengths", lambda n: (n > 0) & (n < size)),
            lambda n: F.transform(
                F.sequence(F.lit(1), size - n + 1), lambda i: F.substring("_low", i, n)
            ),
        )
    )
    inside = (
        single.join(lengths, group_cols)
        .select(*group_cols, F.explode(F.array_distinct(cuts)).alias("_low"))
    )
    kept = single.join(inside, [*group_cols, "_low"], "left_anti")
    # The empty keyword is part of any other.
    others = single.where(size > 0).select(*group_cols).distinct()
    empty = kept.where(size == 0).join(others, group_cols, "left_anti")
    return kept.where(size > 0).unionByName(empty).drop("_low")


def clean_keywords(
    keywords: DataFrame, group_cols: list[str], lexicon: DataFrame, entity_col: str = "entity_id"
) -> DataFrame:
    """Own names out, then contained phrases out."""
    return drop_contained(drop_own_aliases(keywords, lexicon, entity_col), group_cols)


def keyword_string(
    keywords: DataFrame, group_cols: list[str], *, digits: int = 6
) -> DataFrame:
    """``kw:score,kw2:score2`` per cluster, by falling absolute score (ties by name).

    One cluster's stored keywords are a top-k list, so the string is short.
    """
    item = F.concat("keyword", F.lit(":"), F.format_string(f"%.{digits}f", F.col("score")))
    ordered = F.array_sort(
        F.collect_list(
            F.struct(
                (-F.abs("score")).alias("neg"), F.col("keyword").alias("kw"), item.alias("item")
            )
        )
    )
    return keywords.groupBy(*group_cols).agg(
        F.array_join(F.transform(ordered, lambda e: e["item"]), ",").alias("keywords")
    )
