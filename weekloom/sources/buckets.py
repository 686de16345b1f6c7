"""Stored tables in hash buckets of their key, with a key index and versions.

A table is a set of runs, one per write. A run has three folders, each split by bucket:
the rows, their keys in order, and a Bloom filter over the keys. The manifest of a version
names the runs every bucket is made of. A merge therefore

* asks the filters which of its keys a bucket may hold, and opens the key files of only
  those buckets; stored keys are never shuffled for a batch that can be broadcast;
* rewrites the buckets that hold a key it changes, and gives the others a further run with
  their new rows, so nothing they hold is read or written.

Versions are files created exclusively, so of two writers that started from one version
the second finds its number taken, and works its batch into the newer version. Readers take
the newest complete manifest. ``expire`` removes what no kept version names.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekloom.operators.merge import fold_updates
from weekloom.session import stored

BUCKET, ROWS, KEYS, FILTERS = "_bucket", "rows", "keys", "filters"
# Bits a key sets in its one word of the filter.
PROBES = 4
# A bucket of more runs than this is rewritten as one by the next write that touches it.
MAX_RUNS = 8
PATIENCE = 10.0


class VersionTaken(RuntimeError):
    """Another writer published the version this one was about to publish."""


@dataclass(frozen=True)
class Layout:
    keys: list[str]
    schema: str
    buckets: int
    words: int


@dataclass(frozen=True)
class BucketVersion:
    number: int
    layout: Layout
    runs: dict[int, list[str]] = field(default_factory=dict)
    rewritten: list[int] = field(default_factory=list)
    opened: list[int] = field(default_factory=list)


# ---- versions ---------------------------------------------------------------------------


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _listed(spark: SparkSession, path: str) -> list:
    fs, p = _fs(spark, path)
    return list(fs.listStatus(p)) if fs.exists(p) else []


def _numbers(spark: SparkSession, base: str) -> list[int]:
    names = [s.getPath().getName() for s in _listed(spark, f"{base}/versions")]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))


def _manifest(spark: SparkSession, base: str, number: int) -> BucketVersion | None:
    """The version of that number, None while its file is being written."""
    fs, p = _fs(spark, f"{base}/versions/{number:012d}.json")
    stream = fs.open(p)
    try:
        text = bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()
    if not text.endswith("\n"):
        return None
    raw = json.loads(text)
    runs = {int(b): names for b, names in raw.pop("runs").items()}
    return BucketVersion(**raw | {"layout": Layout(**raw["layout"]), "runs": runs})


def current(spark: SparkSession, base: str) -> BucketVersion | None:
    """The newest complete version; None if there is none.

    A manifest that stays incomplete for ``PATIENCE`` seconds is that of a lost writer and
    is passed over.
    """
    numbers = _numbers(spark, base)
    until = time.monotonic() + PATIENCE
    while numbers:
        found = _manifest(spark, base, numbers[-1])
        if found is not None:
            return found
        if time.monotonic() > until:
            numbers.pop()
        else:
            time.sleep(0.1)
    return None


def _announce(spark: SparkSession, base: str, new: BucketVersion, after: int) -> BucketVersion:
    """Publish ``new`` as the successor of version ``after``, or raise ``VersionTaken``."""
    # Numbers of lost writers are skipped; a complete newer version is a conflict.
    newer = [n for n in _numbers(spark, base) if n > after]
    if any(_manifest(spark, base, n) is not None for n in newer):
        raise VersionTaken(f"{base} has a version after {after}")
    new = replace(new, number=(newer[-1] if newer else after) + 1)
    body = {
        "number": new.number,
        "layout": vars(new.layout),
        "runs": {str(b): names for b, names in new.runs.items()},
        "rewritten": new.rewritten,
        "opened": new.opened,
    }
    fs, p = _fs(spark, f"{base}/versions/{new.number:012d}.json")
    try:
        stream = fs.create(p, False)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in str(e.java_exception):
            raise VersionTaken(f"{base} has a version after {after}") from e
        raise
    stream.write(bytearray((json.dumps(body) + "\n").encode("utf-8")))
    stream.close()
    return new


# ---- buckets, keys and filters ----------------------------------------------------------


def _bucket_of(layout: Layout) -> Column:
    return F.pmod(F.xxhash64(*layout.keys), F.lit(layout.buckets)).cast("int")


def _with_place(rows: DataFrame, layout: Layout) -> DataFrame:
    """Add a key's word in its bucket's filter and the bits it sets there. The hash is a
    second one, as the first is the same for all bits that choose the bucket."""
    h = F.xxhash64(F.lit(1), *layout.keys)
    bit = lambda i: F.expr(f"shiftleft(1L, cast(pmod(shiftright(_h, {6 * i}), 64) as int))")
    mask = bit(0)
    for i in range(1, PROBES):
        mask = mask.bitwiseOR(bit(i))
    word = F.pmod(F.shiftright("_h", 6 * PROBES), F.lit(layout.words)).cast("int")
    return rows.withColumn("_h", h).withColumn("_word", word).withColumn("_mask", mask).drop("_h")


def _schema(layout: Layout, cols: list[str] | None = None) -> T.StructType:
    whole = T.StructType.fromJson(json.loads(layout.schema))
    return whole if cols is None else T.StructType([whole[c] for c in cols])


def _read(spark: SparkSession, base: str, v: BucketVersion, kind: str, schema: T.StructType, buckets) -> DataFrame:
    """One scan over the folders of the given buckets (None: all)."""
    wanted = v.runs if buckets is None else {b: v.runs[b] for b in buckets if b in v.runs}
    folders = [f"{base}/{kind}/{run}/{BUCKET}={b}" for b, runs in sorted(wanted.items()) for run in runs]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*folders)


def read_buckets(
    spark: SparkSession, base: str, *, buckets: list[int] | None = None, version: BucketVersion | None = None
) -> DataFrame:
    """The rows of the newest (or a given) version, of all or some buckets."""
    v = version or current(spark, base)
    if v is None:
        raise ValueError(f"{base} holds no version")
    return _read(spark, base, v, ROWS, _schema(v.layout), buckets)


def _write_run(spark: SparkSession, base: str, layout: Layout, rows: DataFrame) -> tuple[str, list[int]]:
    """Write rows, their keys and filters; the run's name and the buckets in it."""
    run = uuid.uuid4().hex
    placed = rows.withColumn(BUCKET, _bucket_of(layout))
    # Rebalancing keeps files few and still splits a bucket that is far larger.
    placed.hint("rebalance", F.col(BUCKET)).write.partitionBy(BUCKET).parquet(f"{base}/{ROWS}/{run}")
    fields = [*_schema(layout, layout.keys), T.StructField(BUCKET, T.IntegerType())]
    back = spark.read.schema(T.StructType(fields)).parquet(f"{base}/{ROWS}/{run}")
    (
        back.hint("rebalance", F.col(BUCKET)).sortWithinPartitions(BUCKET, *layout.keys)
        .write.partitionBy(BUCKET).parquet(f"{base}/{KEYS}/{run}")
    )
    # A word is or-ed up before the shuffle; a bucket has at most ``words`` of them.
    words = _with_place(back, layout).groupBy(BUCKET, "_word").agg(F.bit_or("_mask").alias("_bits"))
    (
        words.withColumn("_at", F.col(BUCKET)).hint("rebalance", F.col(BUCKET))
        .write.partitionBy(BUCKET).parquet(f"{base}/{FILTERS}/{run}")
    )
    prefix = f"{BUCKET}="
    names = [s.getPath().getName() for s in _listed(spark, f"{base}/{ROWS}/{run}")]
    return run, sorted(int(n.removeprefix(prefix)) for n in names if n.startswith(prefix))


def create_buckets(
    spark: SparkSession, base: str, rows: DataFrame, keys: list[str], *, buckets: int = 64, words: int = 16384
) -> BucketVersion:
    """Publish the first version. Keys must be unique; a NULL in a key matches nothing.

    A bucket's filter has up to ``words`` words of 64 bits, which keeps false answers at a
    few percent up to about four keys a word; beyond that more buckets are opened for
    nothing, with the same result. So choose ``buckets`` near the expected rows over 65,536.
    """
    if current(spark, base) is not None:
        raise ValueError(f"{base} is published already")
    layout = Layout(list(keys), rows.schema.json(), buckets, words)
    run, held = _write_run(spark, base, layout, rows)
    new = BucketVersion(0, layout, {b: [run] for b in held}, held, [])
    return _announce(spark, base, new, 0)


# ---- merges ------------------------------------------------------------------------------


def _small_ints(df: DataFrame, col: str) -> list[int]:
    """Distinct bucket numbers: at most as many as there are buckets."""
    return sorted(r[0] for r in df.select(col).distinct().collect())


def known_keys(spark: SparkSession, base: str, v: BucketVersion, batch: DataFrame) -> tuple[DataFrame, list[int]]:
    """(keys of ``batch`` that are stored, buckets whose keys were read for it).

    The filters of the batch's buckets rule out most new keys; keys files are read only of
    buckets that may hold one of the rest. The stored side is streamed: a small batch is
    broadcast against it.
    """
    layout = v.layout
    keys = batch.select(*layout.keys).withColumn(BUCKET, _bucket_of(layout))
    touched = [b for b in _small_ints(keys, BUCKET) if b in v.runs]
    # One scan of all runs; the folders' names are not read, so the bucket is a column too.
    fields = [("_word", T.IntegerType()), ("_bits", T.LongType()), ("_at", T.IntegerType())]
    words = _read(spark, base, v, FILTERS, T.StructType([T.StructField(*f) for f in fields]), touched)
    maybe = (
        words.withColumnRenamed("_at", BUCKET).join(_with_place(keys, layout), [BUCKET, "_word"])
        .where(F.col("_bits").bitwiseAND(F.col("_mask")) == F.col("_mask"))
        .select(BUCKET, *layout.keys).distinct()
    )
    maybe = stored(maybe, "maybe")
    opened = _small_ints(maybe, BUCKET)
    return stored(_known(spark, base, v, maybe, opened), "known"), opened


def _known(spark: SparkSession, base: str, v: BucketVersion, keys: DataFrame, opened: list[int] | None) -> DataFrame:
    held = _read(spark, base, v, KEYS, _schema(v.layout, v.layout.keys), opened)
    return held.join(keys.select(*v.layout.keys), v.layout.keys, "left_semi")


def _merged(
    spark: SparkSession, base: str, v: BucketVersion, batch: DataFrame, update_cols: list[str]
) -> BucketVersion:
    layout, schema = v.layout, _schema(v.layout)
    known, opened = known_keys(spark, base, v, batch)
    # Without columns to change, a known key needs no rewriting.
    hit = set(_small_ints(known.select(_bucket_of(layout).alias("b")), "b")) if update_cols else set()
    sent = set(_small_ints(batch.select(_bucket_of(layout).alias("b")), "b"))
    hit |= {b for b in sent if len(v.runs.get(b, [])) >= MAX_RUNS}

    def typed(name: str) -> Column:
        value = F.col(name) if name in batch.columns else F.lit(None)
        return value.cast(schema[name].dataType).alias(name)

    added = batch.join(known, layout.keys, "left_anti").select(*[typed(c) for c in schema.names])
    out = added
    if hit:
        old = _read(spark, base, v, ROWS, schema, sorted(hit))
        new = batch.select(*layout.keys, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in update_cols])
        kept = old.join(new, layout.keys, "left").select(
            *[
                (F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)) if c in update_cols else F.col(c))
                .cast(schema[c].dataType).alias(c)
                for c in schema.names
            ]
        )
        out = kept.unionByName(added)
    run, written = _write_run(spark, base, layout, out)
    runs = dict(v.runs)
    for b in written:
        runs[b] = [run] if b in hit else [*runs.get(b, []), run]
    return BucketVersion(v.number, layout, runs, sorted(hit & set(v.runs)), opened)


def merge_buckets(
    spark: SparkSession,
    base: str,
    updates: DataFrame,
    update_cols: list[str] = (),
    *,
    order_col: str | None = None,
    attempts: int = 10,
) -> BucketVersion:
    """Merge a batch, with the results of ``merge``: known keys get ``update_cols``, new
    keys are appended; without ``update_cols`` known keys are ignored.

    A key that occurs more than once needs ``order_col``; without it the batch is refused.
    If another writer publishes first, the batch is merged into that version instead.
    """
    v = current(spark, base)
    if v is None:
        raise ValueError(f"create a first version of {base}")
    batch = stored(fold_updates(updates, v.layout.keys, list(update_cols), order_col), "batch")
    if order_col is None:
        named = batch.dropna(subset=v.layout.keys)
        if named.groupBy(*v.layout.keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
            raise ValueError(f"keys {v.layout.keys} occur more than once; name an order_col")
    for _ in range(attempts):
        try:
            return _announce(spark, base, _merged(spark, base, v, batch, list(update_cols)), v.number)
        except VersionTaken:
            v = current(spark, base)
    raise VersionTaken(f"{base}: {attempts} attempts met newer versions")


# ---- expiry ------------------------------------------------------------------------------


def expire(spark: SparkSession, base: str, *, keep: int = 2, min_age: float = 86400.0) -> list[str]:
    """Delete versions before the last ``keep`` and runs that none of those names.

    Runs younger than ``min_age`` seconds stay: a writer may be about to announce them.
    """
    numbers = _numbers(spark, base)
    complete = [n for n in numbers if _manifest(spark, base, n) is not None]
    kept = complete[-max(keep, 1):]
    if not kept:
        return []
    used = {run for n in kept for runs in _manifest(spark, base, n).runs.values() for run in runs}
    before = (time.time() - min_age) * 1000
    gone = set()
    for kind in (ROWS, KEYS, FILTERS):
        for s in _listed(spark, f"{base}/{kind}"):
            run = s.getPath().getName()
            if run not in used and s.getModificationTime() <= before:
                _fs(spark, f"{base}/{kind}")[0].delete(s.getPath(), True)
                gone.add(run)
    for n in numbers:
        if n < kept[0]:
            fs, p = _fs(spark, f"{base}/versions/{n:012d}.json")
            fs.delete(p, False)
    return sorted(gone)
