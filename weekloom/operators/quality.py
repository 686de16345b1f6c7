"""Checks for the constraints the stored tables declare; each returns violating rows.

Spark tables do not enforce keys. Every check gives rows (check_name, key, n). Checks that
look at one row at a time are rules: all rules of a table are judged in one scan of it
(``row_violations``), or counted by the job that writes it (``observed``).
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from weekloom import vocab


def _report(name: str, rows: DataFrame, key: Column, n: Column) -> DataFrame:
    return rows.select(F.lit(name).alias("check_name"), key.alias("key"), n.alias("n"))


def _key(cols: list[str]) -> Column:
    return F.concat_ws("|", *[F.col(c).cast("string") for c in cols])


def unique_violations(name: str, table: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    repeated = table.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return _report(name, repeated.where("n > 1"), _key(keys), F.col("n"))


def orphan_violations(
    name: str, child: DataFrame, cols: list[str], parent: DataFrame, parent_cols: list[str]
) -> DataFrame:
    """Non-null child keys without a parent, with the number of child rows."""
    # Counted before the join, so a hot orphan key is one row by then.
    used = child.dropna(subset=cols).groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
    known = parent.select(*[F.col(p).alias(c) for p, c in zip(parent_cols, cols)])
    return _report(name, used.join(known, cols, "left_anti"), _key(cols), F.col("n"))


@dataclass(frozen=True)
class Rule:
    """A check on single rows. Of a rule that folds, the rows of a key are counted."""

    name: str
    bad: Column
    key: Column
    n: Column
    folds: bool = False


def null_rule(name: str, col: str, keys: list[str]) -> Rule:
    return Rule(name, F.col(col).isNull(), _key(keys), F.lit(1))


def length_rule(name: str, col: str, limit: int, keys: list[str]) -> Rule:
    """Texts of more than ``limit`` characters, with their length."""
    size = F.length(col)
    return Rule(name, F.coalesce(size > limit, F.lit(False)), _key(keys), size)


def member_rule(name: str, col: str, allowed: Iterable[str]) -> Rule:
    """Values outside a list, with the number of their rows."""
    inside = F.coalesce(F.col(col).isin(list(allowed)), F.lit(True))
    return Rule(name, ~inside, F.col(col).cast("string"), F.lit(1), folds=True)


def row_violations(table: DataFrame, rules: list[Rule]) -> DataFrame:
    """The violations of all rules, in one scan; only violations are shuffled, and those
    of a rule that folds are counted before that."""
    judged = [
        F.when(
            r.bad,
            F.struct(
                F.lit(r.name).alias("check_name"),
                r.key.alias("key"),
                r.n.cast("long").alias("n"),
                F.lit(r.folds).alias("folds"),
            ),
        )
        for r in rules
    ]
    found = table.select(F.explode(F.array_compact(F.array(*judged))).alias("v")).select("v.*")
    # Every row of a rule that does not fold is a group of its own.
    own = F.when(~F.col("folds"), F.monotonically_increasing_id())
    return (
        found.withColumn("_own", own).groupBy("check_name", "key", "_own").agg(F.sum("n").alias("n")).drop("_own")
    )


def observed(table: DataFrame, rules: list[Rule]) -> tuple[DataFrame, Observation]:
    """The table, and the number of violations per rule once a job has run through it."""
    seen = Observation()
    return table.observe(seen, *[F.count_if(r.bad).alias(r.name) for r in rules]), seen


def null_violations(name: str, table: DataFrame, col: str, keys: list[str]) -> DataFrame:
    return row_violations(table, [null_rule(name, col, keys)])


def length_violations(
    name: str, table: DataFrame, col: str, limit: int, keys: list[str]
) -> DataFrame:
    """Texts of more than ``limit`` characters, with their length."""
    return row_violations(table, [length_rule(name, col, limit, keys)])


def membership_violations(
    name: str, table: DataFrame, col: str, allowed: DataFrame | list[str]
) -> DataFrame:
    """Values outside an enumeration, given as a list or as a one-column table."""
    if isinstance(allowed, list):
        return row_violations(table, [member_rule(name, col, allowed)])
    used = table.dropna(subset=[col]).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    bad = used.join(allowed.select(F.col(allowed.columns[0]).alias(col)), col, "left_anti")
    return _report(name, bad, F.col(col).cast("string"), F.col("n"))


def audit(checks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


CLUSTER = ["team_id", "week_start", "week_end", "cluster_id"]
ROW = ["team_id", "week_start", "week_end", "article_id"]


def storyline_rules(
    outlets: Iterable[str] = vocab.OUTLET_IDS, teams: Iterable[str] = vocab.TEAM_IDS
) -> dict[str, list[Rule]]:
    """The rules on single rows that the storyline tables declare, by table."""
    rules = {
        "outlets": [member_rule("outlets.name", "name", outlets)],
        "authors": [null_rule("authors.name", "name", ["id"]), length_rule("authors.name", "name", 255, ["id"])],
        "teams": [member_rule("teams.name", "name", teams)],
        "articles": [null_rule("articles.link", "link", ["id"]), length_rule("articles.link", "link", 512, ["id"])],
        "weekly_topic": [],
        "weekly_clusters": [],
        "weekly_keywords": [
            null_rule("weekly_keywords.keyword", "keyword", CLUSTER),
            null_rule("weekly_keywords.score", "score", CLUSTER),
            length_rule("weekly_keywords.keyword", "keyword", 255, CLUSTER),
        ],
    }
    for name, keys in (("weekly_topic", ROW), ("weekly_clusters", CLUSTER), ("weekly_keywords", CLUSTER)):
        rules[name] += [null_rule(f"{name}.{c}", c, keys) for c in keys]
    return rules


def audit_storyline_tables(
    t: dict[str, DataFrame],
    outlets: Iterable[str] = vocab.OUTLET_IDS,
    teams: Iterable[str] = vocab.TEAM_IDS,
) -> DataFrame:
    """Every constraint the storyline tables declare (names as in ``schemas``)."""
    checks = [
        unique_violations("outlets.id", t["outlets"], ["id"]),
        unique_violations("outlets.name", t["outlets"], ["name"]),
        unique_violations("authors.id", t["authors"], ["id"]),
        unique_violations("authors.name", t["authors"], ["name"]),
        unique_violations("teams.id", t["teams"], ["id"]),
        unique_violations("teams.name", t["teams"], ["name"]),
        unique_violations("articles.id", t["articles"], ["id"]),
        unique_violations("articles.link", t["articles"], ["link"]),
        unique_violations("article_teams", t["article_teams"], ["article_id", "team_id"]),
        unique_violations("weekly_topic", t["weekly_topic"], ROW),
        unique_violations("weekly_clusters", t["weekly_clusters"], CLUSTER),
        unique_violations("weekly_keywords", t["weekly_keywords"], [*CLUSTER, "keyword"]),
        orphan_violations("articles.outlet", t["articles"], ["outlet_id"], t["outlets"], ["id"]),
        orphan_violations("articles.author", t["articles"], ["author_id"], t["authors"], ["id"]),
        orphan_violations(
            "article_teams.article", t["article_teams"], ["article_id"], t["articles"], ["id"]
        ),
        orphan_violations("article_teams.team", t["article_teams"], ["team_id"], t["teams"], ["id"]),
        orphan_violations(
            "weekly_topic.pair",
            t["weekly_topic"],
            ["team_id", "article_id"],
            t["article_teams"],
            ["team_id", "article_id"],
        ),
        orphan_violations(
            "weekly_clusters.team", t["weekly_clusters"], ["team_id"], t["teams"], ["id"]
        ),
        orphan_violations(
            "weekly_keywords.cluster", t["weekly_keywords"], CLUSTER, t["weekly_clusters"], CLUSTER
        ),
    ]
    checks += [row_violations(t[name], rules) for name, rules in storyline_rules(outlets, teams).items()]
    return audit(checks)
