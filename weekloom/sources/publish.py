"""All-or-nothing publishing of several tables.

Every version of the tables is written to its own folders; a one-row manifest that names
them is written last. Readers follow the newest manifest, so they see all new tables or
none, and a run that fails half way leaves the old version in place.

A weekly table can be published week by week: the manifest then names a folder per week,
and a merge reads and writes only the weeks its updates fall into.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekloom.operators.merge import merge
from weekloom.operators.quality import Rule, observed

_COLUMNS = "version long, tables map<string,string>, weeks map<string,map<string,string>>"
MANIFEST = f"{_COLUMNS}, written_at timestamp"
WEEK_COL = "week_start"


@dataclass
class Version:
    number: int = 0
    tables: dict[str, str] = field(default_factory=dict)
    weeks: dict[str, dict[str, str]] = field(default_factory=dict)


class ConstraintError(ValueError):
    """Tables that break their rules, with the number of violations per rule."""

    def __init__(self, found: dict[str, dict[str, int]]):
        super().__init__(str(found))
        self.found = found


def current_version(spark: SparkSession, base: str) -> Version:
    """The newest manifest; number 0 if nothing was published."""
    try:
        rows = spark.read.schema(MANIFEST).json(f"{base}/_manifests")
        row = rows.orderBy(F.desc("version")).first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return Version()
    if row is None:
        return Version()
    weeks = {name: dict(paths) for name, paths in (row["weeks"] or {}).items()}
    return Version(row["version"], dict(row["tables"] or {}), weeks)


def _announce(spark: SparkSession, base: str, new: Version) -> int:
    manifest = spark.createDataFrame([(new.number + 1, new.tables, new.weeks)], _COLUMNS)
    manifest = manifest.withColumn("written_at", F.current_timestamp())
    manifest.coalesce(1).write.mode("append").json(f"{base}/_manifests")
    return new.number + 1


def publish(
    spark: SparkSession,
    base: str,
    tables: dict[str, DataFrame],
    by: dict[str, list[str]] | None = None,
    rules: dict[str, list[Rule]] | None = None,
) -> int:
    """Write the tables and make them current; tables not named keep their version.

    ``by`` names partition columns per table. The writing jobs count the rows that break
    ``rules``; if there are any, nothing becomes current and ``ConstraintError`` tells
    which. One writer at a time.
    """
    version = current_version(spark, base)
    run = uuid.uuid4().hex
    broken: dict[str, dict[str, int]] = {}
    for name, df in tables.items():
        path = f"{base}/{name}/{run}"
        cols = (by or {}).get(name, [])
        seen = None
        if (rules or {}).get(name):
            df, seen = observed(df, rules[name])
        writer = df.write.mode("error")
        (writer.partitionBy(*cols) if cols else writer).parquet(path)
        bad = {rule: n for rule, n in (seen.get if seen else {}).items() if n}
        if bad:
            broken[name] = bad
        version.tables[name] = path
        version.weeks.pop(name, None)
    if broken:
        raise ConstraintError(broken)
    return _announce(spark, base, version)


def publish_weeks(
    spark: SparkSession, base: str, tables: dict[str, DataFrame], weeks: list | None = None
) -> int:
    """Write weekly tables and make them current in the given weeks, which lose what they
    held before; without ``weeks``, the tables are replaced as a whole."""
    version = current_version(spark, base)
    run = uuid.uuid4().hex
    for name, df in tables.items():
        path = f"{base}/{name}/{run}"
        # Rebalancing keeps files few and still splits a week that is far larger.
        df.hint("rebalance", F.col(WEEK_COL)).write.mode("error").partitionBy(WEEK_COL).parquet(path)
        written = spark.read.schema(df.schema).parquet(path).select(WEEK_COL).distinct()
        held = {} if weeks is None else version.weeks.get(name, {})
        touched = {str(w) for w in weeks or []}
        kept = {w: p for w, p in held.items() if w not in touched}
        # One row per week comes back to the driver.
        version.weeks[name] = kept | {str(r[0]): path for r in written.collect()}
        version.tables.pop(name, None)
    return _announce(spark, base, version)


def read_published(
    spark: SparkSession, base: str, name: str, weeks: list | None = None
) -> DataFrame:
    """The current rows of a table; of a table kept by weeks, only the given weeks."""
    version = current_version(spark, base)
    if name in version.tables:
        df = spark.read.parquet(version.tables[name])
        return df if weeks is None else df.where(F.col(WEEK_COL).isin(list(weeks)))
    held = version.weeks[name]
    wanted = held if weeks is None else {w: held[w] for w in map(str, weeks) if w in held}
    runs: dict[str, list[str]] = {}
    for week, path in wanted.items():
        runs.setdefault(path, []).append(f"{path}/{WEEK_COL}={week}")
    parts = [spark.read.option("basePath", path).parquet(*folders) for path, folders in runs.items()]
    if not parts:
        return spark.read.parquet(next(iter(held.values()))).limit(0)
    return reduce(DataFrame.unionByName, parts)


def merge_published(
    spark: SparkSession,
    base: str,
    name: str,
    updates: DataFrame,
    keys: list[str],
    update_cols: list[str],
    *,
    order_col: str | None = None,
) -> int:
    """Merge updates into a published table and publish the result.

    Of a table kept by weeks (``week_start`` being part of the key), only the weeks that
    occur in the updates are read and written.
    """
    version = current_version(spark, base)
    if name in version.weeks:
        weeks = [r[0] for r in updates.select(WEEK_COL).distinct().collect()]
        if not weeks:
            return version.number
        old = read_published(spark, base, name, weeks)
        merged = merge(old, updates, keys, update_cols, order_col=order_col)
        return publish_weeks(spark, base, {name: merged}, weeks)
    if name not in version.tables:
        raise ValueError(f"publish a first version of {name}")
    old = read_published(spark, base, name)
    return publish(spark, base, {name: merge(old, updates, keys, update_cols, order_col=order_col)})
