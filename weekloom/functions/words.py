"""Column functions over text: tokens, n-grams, feed dates, keyword strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A word character as most regex dialects with Unicode words see it. Spelled out because
# `\b` and `\w` change their meaning between JDK releases.
WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]+"
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"


# A token, and a token that is not digits only.
TOKEN = r"[\p{L}\p{N}_]++"
WORDY_TOKEN = rf"(?<!{WORD})(?!\p{{Nd}}++(?!{WORD})){TOKEN}"


def first_letters(alternatives: str) -> str:
    """Look-ahead for the first characters of alternatives made of letters, digits and
    inner spaces only; "" if any holds something else, since a pattern need not begin with
    its first character. It lets the matcher skip most positions of a text cheaply."""
    aliases = alternatives.split("|")
    if not all(word.isalnum() for alias in aliases for word in alias.split(" ")):
        return ""
    return f"(?=[{''.join(sorted({alias[0] for alias in aliases}))}])"


def whole_word(alternatives: str) -> str:
    """Case-insensitive pattern for any of ``a|b|c`` standing between word boundaries."""
    return f"(?iu){first_letters(alternatives)}(?<!{WORD})(?:{alternatives})(?!{WORD})"


def tokens(text: Column) -> Column:
    """Lower-case word tokens, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def wordy_tokens(text: Column) -> Column:
    """Lower-case word tokens without those that are digits only."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORDY_TOKEN), F.lit(0))


def drop_words(words: Column, stop_words: list[str]) -> Column:
    """Remove stop words; an empty list removes nothing."""
    if not stop_words:
        return words
    return F.filter(words, lambda t: ~t.isin(list(stop_words)))


def explode_ngrams(
    df: DataFrame, keep: list[str], words_col: str, low: int, high: int, out_col: str = "keyword"
) -> DataFrame:
    """One row per run of ``low`` to ``high`` neighbouring tokens, joined by a space.

    Every token is laid next to its followers first, so the joining runs on plain columns
    and not inside an array lambda.
    """
    words = F.col(words_col)
    shifted = [words] + [F.slice(words, n + 1, F.size(words)) for n in range(1, high)]
    laid = df.select(
        *keep, F.explode(F.arrays_zip(*[w.alias(f"w{i}") for i, w in enumerate(shifted)])).alias("_at")
    ).select(*keep, *[F.col(f"_at.w{i}").alias(f"_w{i}") for i in range(high)])
    grams = [
        F.when(F.col(f"_w{n - 1}").isNotNull(), F.concat_ws(" ", *[f"_w{i}" for i in range(n)]))
        if n > 1
        else F.col("_w0")
        for n in range(low, high + 1)
    ]
    if len(grams) == 1:
        found = laid.select(*keep, grams[0].alias(out_col))
    else:
        found = laid.select(*keep, F.explode(F.array(*grams)).alias(out_col))
    return found.where(F.col(out_col).isNotNull())


def join_text(*parts: Column) -> Column:
    """Texts joined by a space; a missing part is skipped."""
    return F.concat_ws(" ", *parts)


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def feed_time(published: Column) -> Column:
    """Wall-clock time of a feed date such as ``Sat, 09 Aug 2025 15:35:00 BST``.

    The last token, the zone, is dropped and not applied. Anything else that does not
    fit the format, or names a day that does not exist, gives NULL.
    """
    pattern = r"^[A-Za-z]{3}, (\d{1,2}) ([A-Za-z]{3}) (\d{4}) (\d{1,2}):(\d{1,2}):(\d{1,2}) [^ ]*$"

    def part(i: int, width: int = 2) -> Column:
        return F.lpad(F.regexp_extract(published, pattern, i), width, "0")

    at = F.instr(F.lit(MONTHS), F.lower(part(2, 3)))
    month = F.lpad(F.when(at % 3 == 1, F.floor((at + 2) / 3)).cast("string"), 2, "0")
    day = F.concat(part(3, 4), F.lit("-"), month, F.lit("-"), part(1))
    clock = F.concat_ws(":", part(4), part(5), part(6))
    return F.concat(day, F.lit(" "), clock).try_cast("timestamp_ntz")


def safe_int(value: Column) -> Column:
    """Whole number out of padded text; blank or malformed gives NULL."""
    return F.trim(value.cast("string")).try_cast("int")


def keyword_entries(text: Column) -> Column:
    """``kw:score,kw2:score2`` as ``array<struct<keyword, score>>``.

    The last colon separates the score, scores are made positive, and a missing or
    malformed score counts as 0.
    """
    items = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda s: F.trim(s)), lambda s: s != "")

    def entry(item: Column) -> Column:
        has_score = F.instr(item, ":") > 0
        name = F.when(has_score, F.regexp_extract(item, r"(?s)^(.*):[^:]*$", 1)).otherwise(item)
        score = F.regexp_extract(item, r"(?s)^.*:([^:]*)$", 1)
        return F.struct(
            F.trim(name).alias("keyword"),
            F.coalesce(F.abs(F.trim(score).try_cast("double")), F.lit(0.0)).alias("score"),
        )

    return F.transform(items, entry)


def keyword_names(text: Column) -> Column:
    """Names only of a keyword string; here the first colon ends the name."""
    items = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda s: F.trim(s)), lambda s: s != "")
    return F.transform(items, lambda s: F.trim(F.substring_index(s, ":", 1)))


def code_name(code: Column, names: dict, default: str | None = "Unknown") -> Column:
    """Name of a code out of a small fixed mapping."""
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[code], F.lit(default))


def name_code(name: Column, codes: dict) -> Column:
    """Code of a trimmed name, NULL if unknown."""
    pairs = [F.lit(x) for kv in codes.items() for x in kv]
    return F.create_map(*pairs)[F.trim(name)]
