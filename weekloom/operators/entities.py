"""Which entities a text is about: alias matching, mention counts, assignment.

A lexicon is a table (entity_id, ord, name, pattern); ``pattern`` is an alternation of
aliases and ``ord`` breaks ties. A small lexicon becomes part of the row expression, so
texts are scanned where they lie; if its aliases are plain words that cannot overlap
between entities, all of them are found in one scan. A larger lexicon is a table of what a
text must hold: whole aliases where they are plain words, else a few letters that every
match contains. Texts meet it by an equi-join, and the patterns themselves decide. No
pattern passes through the driver. All ways give the same hits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from weekloom.functions.patterns import required_grams
from weekloom.functions.words import TOKEN, WORD, whole_word
from weekloom.session import stored

INLINE_ENTITIES = 64


def inline_lexicon(lexicon: DataFrame, limit: int = INLINE_ENTITIES) -> list[Row] | None:
    """The lexicon's rows in order if there are at most ``limit`` of them, else None."""
    rows = lexicon.select("entity_id", "ord", "name", "pattern").limit(limit + 1).collect()
    return sorted(rows, key=lambda r: r["ord"]) if len(rows) <= limit else None


def _pattern_col(pattern: Column) -> Column:
    return F.concat(F.lit(f"(?iu)(?<!{WORD})(?:"), pattern, F.lit(f")(?!{WORD})"))


def _fold(text: str) -> str:
    return text.upper().lower()


def _overlap(a: list[str], b: list[str]) -> bool:
    """Whether two word sequences can share words of a text."""
    return any(
        all(a[i] == b[i - at] for i in range(max(at, 0), min(len(a), at + len(b))))
        for at in range(1 - len(b), len(a))
    )


def one_scan(rows: list[Row]) -> bool:
    """Whether one pattern over all entities finds what one pattern per entity finds."""
    split = [[_fold(a).split(" ") for a in r["pattern"].split("|")] for r in rows]
    plain = all(w.isalnum() for aliases in split for alias in aliases for w in alias)
    return plain and not any(
        _overlap(a, b)
        for i, one in enumerate(split)
        for other in split[i + 1 :]
        for a in one
        for b in other
    )


def _found(text: Column, rows: list[Row]) -> Column:
    """All alias occurrences in a text, case-folded."""
    every = "|".join(r["pattern"] for r in rows)
    hits = F.regexp_extract_all(text, F.lit(whole_word(every)), F.lit(0))
    return F.transform(hits, lambda h: F.lower(F.upper(h)))


def _occurrences(found: Column, names: list[str]) -> Column:
    return F.size(F.filter(found, lambda h: h.isin(names)))


def _aliases(row: Row) -> list[str]:
    return [_fold(a) for a in row["pattern"].split("|")]


def mention_hits(
    docs: DataFrame,
    lexicon: DataFrame,
    *,
    text_col: str = "full_text",
    inline_limit: int = INLINE_ENTITIES,
) -> DataFrame:
    """Add ``hits``: array<struct<ord, entity_id, name, cnt>> of the entities mentioned,
    in lexicon order; an empty array if there are none."""
    rows = inline_lexicon(lexicon, inline_limit)
    if rows is None:
        return _indexed_hits(docs, lexicon, text_col)
    if not one_scan(rows):
        text = F.col(text_col)
        counts = [F.regexp_count(text, F.lit(whole_word(r["pattern"]))) for r in rows]
        return docs.withColumn("hits", _hits(rows, counts))

    def count_all(found: Column) -> Column:
        return _hits(rows, [_occurrences(found, _aliases(r)) for r in rows])

    return docs.withColumn("hits", _with_value(_found(F.col(text_col), rows), count_all))


def _with_value(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once per row. A plain column in between
    does not ensure that, since the optimizer may copy it into every place of use."""
    return F.element_at(F.transform(F.array(value), lambda v: use(v)), 1)


def _hits(rows: list[Row], counts: list[Column]) -> Column:
    found = [
        F.struct(
            F.lit(r["ord"]).alias("ord"),
            F.lit(r["entity_id"]).alias("entity_id"),
            F.lit(r["name"]).alias("name"),
            n.cast("long").alias("cnt"),
        )
        for r, n in zip(rows, counts)
    ]
    return F.filter(F.array(*found), lambda h: h["cnt"] > 0)


# Aliases made of ASCII words and single spaces.
PLAIN = r"^[A-Za-z0-9]+( [A-Za-z0-9]+)*(\|[A-Za-z0-9]+( [A-Za-z0-9]+)*)*$"
# A common word or group of letters is looked up in this many places.
SPLITS = 16
# Up to so many groups of letters are looked for in a text; more are met by all groups it has.
FEW_GRAMS = 64
_COLS = ["ord", "entity_id", "name", "pattern"]


def _folded(text: Column) -> Column:
    """Letters folded as the patterns fold them, as far as they fold to ASCII."""
    return F.lower(F.upper(F.translate(text, "İ", "i")))


def _folded_tokens(text: Column) -> Column:
    """Word tokens, each folded as the patterns fold letters."""
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), _folded)


def lexicon_index(lexicon: DataFrame) -> DataFrame:
    """(probe, size, lexicon columns): a text with a match of a pattern holds one of its probes.

    ``w:`` and a whole alias of ``size`` words, if the pattern is plain words; else one row
    per branch of the pattern with ``g:`` and up to three letters that the branch cannot do
    without, those that fewest branches of the lexicon share. A branch that can do without
    any letter has the probe ``g:``, which every text holds.
    """
    is_plain = F.col("pattern").rlike(PLAIN)
    alias = F.split(_folded(F.col("alias")), " ")
    plain = lexicon.where(is_plain).select(*_COLS, F.explode(F.split("pattern", r"\|")).alias("alias")).select(
        F.concat(F.lit("w:"), F.array_join(alias, " ")).alias("probe"), F.size(alias).alias("size"), *_COLS
    )
    branches = lexicon.where(~is_plain).select(*_COLS, F.posexplode(required_grams("pattern")).alias("branch", "grams"))
    options = branches.select(*_COLS, "branch", F.explode("grams").alias("gram"))
    shared = options.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    best = options.join(shared, "gram").groupBy(*_COLS, "branch").agg(
        F.min_by("gram", F.struct(-F.length("gram"), "n", "gram")).alias("gram")
    )
    odd = best.select(F.concat(F.lit("g:"), "gram").alias("probe"), F.length("gram").alias("size"), *_COLS)
    return plain.unionByName(odd).distinct()


def _probes(text: Column, sizes: list[tuple[str, int]], few: dict[int, list[str]]) -> Column:
    """All that the index could hold of a text, for the sizes that occur in it. Of groups of
    letters that are ``few``, only those that the text holds, looked for one by one."""
    words = _folded_tokens(text)

    def grams(n: int) -> Column:
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))

    def letters(n: int) -> Column:
        return F.regexp_extract_all(_folded(text), F.lit(f"(?s)(?=({'.' * n}))"), F.lit(1))

    def marked(kind: str, n: int) -> Column:
        if kind == "w":
            found = words if n == 1 else grams(n)
        elif n in few:
            return _with_value(_folded(text), lambda t: F.filter(F.array(*[F.lit(f"g:{g}") for g in few[n]]), lambda p: F.contains(t, F.substring(p, 3, n))))
        else:
            found = letters(n) if n else F.array(F.lit(""))
        found = F.coalesce(F.array_distinct(found), F.array().cast("array<string>"))
        return F.transform(found, lambda p: F.concat(F.lit(f"{kind}:"), p))

    parts = [marked(kind, n) for kind, n in sizes]
    return F.concat(*parts) if parts else F.array().cast("array<string>")


def _indexed_hits(docs: DataFrame, lexicon: DataFrame, text_col: str) -> DataFrame:
    """Hits of a lexicon of any size. A text is known by its digest, so repeated rows and
    rows without an id get their own hits."""
    # Written once: the patterns are looked into in this job, not in the one over the texts.
    index = stored(lexicon_index(lexicon), "lexicon")
    # A few numbers: the lengths of aliases in words, and of groups of letters.
    sizes = index.select(F.substring("probe", 1, 1).alias("kind"), "size").distinct().collect()
    letters = index.where("probe like 'g:_%'").select(F.expr("substring(probe, 3)").alias("gram"), "size").distinct()
    some = letters.limit(FEW_GRAMS + 1).collect()
    few: dict[int, list[str]] = {}
    for r in some if len(some) <= FEW_GRAMS else []:
        few.setdefault(r["size"], []).append(r["gram"])
    keyed = docs.withColumn("_digest", F.md5(text_col))
    held = keyed.select(
        "_digest",
        F.pmod(F.xxhash64("_digest"), F.lit(SPLITS)).cast("int").alias("_split"),
        F.explode(_probes(F.col(text_col), sorted((r["kind"], r["size"]) for r in sizes), few)).alias("probe"),
    )
    places = index.withColumn("_split", F.explode(F.sequence(F.lit(0), F.lit(SPLITS - 1))))
    candidates = (
        held.join(places, ["probe", "_split"])
        .groupBy("_digest")
        .agg(F.collect_set(F.struct(*_COLS)).alias("_candidates"))
    )

    def counted(c: Column) -> Column:
        n = F.regexp_count(F.col(text_col), _pattern_col(c["pattern"])).cast("long")
        return F.struct(c["ord"].alias("ord"), c["entity_id"].alias("entity_id"), c["name"].alias("name"), n.alias("cnt"))

    found = F.filter(F.transform("_candidates", counted), lambda h: h["cnt"] > 0)
    met = keyed.join(candidates, "_digest", "left").withColumn("hits", found)
    kind = met.schema["hits"].dataType
    every = F.coalesce("hits", F.array().cast(kind))
    return met.withColumn("hits", F.array_sort(every)).drop("_digest", "_candidates")


def explode_hits(hits: DataFrame, keep: list[str]) -> DataFrame:
    """One row per (text, entity mentioned) with its count.

    The outer form keeps Spark from testing the array's size first, which would scan the
    text twice.
    """
    return (
        hits.select(*keep, F.explode_outer("hits").alias("h"))
        .where(F.col("h").isNotNull())
        .select(*keep, "h.entity_id", "h.ord", "h.name", "h.cnt")
    )


def mentions_any(text: Column, lexicon: DataFrame, inline_limit: int = INLINE_ENTITIES) -> Column | None:
    """Cheap test for any alias in a text; None for a lexicon too large to inline."""
    rows = inline_lexicon(lexicon, inline_limit)
    if rows is None:
        return None
    return text.rlike(whole_word("|".join(r["pattern"] for r in rows)))


def match_entities(
    docs: DataFrame,
    lexicon: DataFrame,
    *,
    text: Column,
    out_col: str = "teams",
    inline_limit: int = INLINE_ENTITIES,
) -> DataFrame:
    """Add the names of the entities with any alias in ``text``, in lexicon order."""
    rows = inline_lexicon(lexicon, inline_limit)
    if rows is not None and one_scan(rows):


        def names(found: Column) -> Column:
            own = [F.array(*[F.lit(a) for a in _aliases(r)]) for r in rows]
            named = [
                F.when(F.arrays_overlap(found, a), F.lit(r["name"])) for a, r in zip(own, rows)
            ]
            return F.array_compact(F.array(*named))

        return docs.withColumn(out_col, _with_value(_found(text, rows), names))
    if rows is not None:
        named = [F.when(text.rlike(whole_word(r["pattern"])), F.lit(r["name"])) for r in rows]
        return docs.withColumn(out_col, F.array_compact(F.array(*named)))
    hits = _indexed_hits(docs.withColumn("_text", text), lexicon, "_text")
    return hits.withColumn(out_col, F.transform("hits", lambda h: h["name"])).drop("_text", "hits")


def assign_entities(
    hits: DataFrame,
    lexicon: DataFrame,
    *,
    min_count: int = 5,
    on_no_match: str = "first",
    known_ids_col: str | None = None,
) -> DataFrame:
    """Add ``assigned``: ids of the entity mentioned most (first in the lexicon on a tie)
    and of every other entity with at least ``min_count`` mentions.

    A text that mentions none gets, by ``on_no_match``: the lexicon's first entity
    ("first"), its only known entity ("fallback", needs ``known_ids_col``), or nothing
    ("drop").
    """
    nothing = F.array().cast("array<int>")
    if on_no_match == "first":
        missing = F.array(lexicon.select(F.min_by("entity_id", "ord").alias("id")).scalar())
    elif on_no_match == "fallback":
        known = F.col(known_ids_col)
        missing = F.when(F.size(known) == 1, known.cast("array<int>")).otherwise(nothing)
    elif on_no_match == "drop":
        missing = nothing
    else:
        raise ValueError(f"on_no_match: {on_no_match}")

    def choose(found: Column) -> Column:
        ranked = F.array_sort(
            F.transform(
                found,
                lambda h: F.struct(
                    (-h["cnt"]).alias("neg"), h["ord"].alias("ord"), h["entity_id"].alias("id")
                ),
            )
        )
        top = F.get(ranked, F.lit(0))["id"]
        others = F.filter(found, lambda h: (h["cnt"] >= min_count) & (h["entity_id"] != top))
        both = F.concat(F.array(top), F.transform(others, lambda h: h["entity_id"]))
        return F.when(F.size(found) > 0, both)

    return hits.withColumn("assigned", F.coalesce(_with_value(F.col("hits"), choose), missing))


def explode_assigned(given: DataFrame, keep: list[str]) -> DataFrame:
    """One row per (text, assigned entity)."""
    return given.select(*keep, F.explode_outer("assigned").alias("entity_id")).where(
        F.col("entity_id").isNotNull()
    )


def known_entities(article_entities: DataFrame) -> DataFrame:
    """Set of entity ids per article."""
    return (
        article_entities.dropna(subset=["article_id", "entity_id"])
        .groupBy("article_id")
        .agg(F.array_sort(F.collect_set("entity_id")).alias("known_ids"))
    )


def drop_frequent_term(docs: DataFrame, term: str, limit: int, text_col: str) -> DataFrame:
    """Drop texts that hold a whole-word term ``limit`` times or more."""
    return docs.where(F.regexp_count(text_col, F.lit(whole_word(term))) < limit)
