"""Near-duplicate groups by SetSketch registers, banding, joint likelihood and an exact check.

A document is the set of its word shingles. Every shingle sends a Poisson process of points
to the registers; a register keeps its smallest point, as a truncated logarithm, so two
sets agree in a register with about the probability of their Jaccard similarity, whatever
their sizes, and the sketch of a union is the maximum of two sketches. Documents that agree
in all registers of a band are candidates; the likelihood of all registers, given both set
sizes, estimates their similarity; candidates that may reach the threshold are checked on
their full sets.

With 48 bands of 5 registers a pair at similarity 0.8 shares no band with probability below
1e-8, and the likelihood filter stands five standard deviations below the threshold.

Equal sets are one class, compared once. In a large bucket first all members meet the one
that shares most buckets; if that joins the whole bucket, as it does for copies of a text,
no other pair of it is formed. Only buckets that stay divided are compared exhaustively,
block by block, and only between components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.llm.common import Words, mix, shingles, table, written

BANDS = 48
WIDTH = 5
REGISTERS = BANDS * WIDTH
BASE = 1.02
SMALL_BUCKET = 16
BLOCK = 512
SLACK = 5  # standard deviations of the likelihood estimate
TEXT_BYTES = 2 << 20
# Sketches, and pairs of them, worked out at a time.
ROWS, PAIRS = 1024, 2048


def sketch(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Registers (rows) of each set of 64-bit hashes.

    The points of a hash ascend by exponential steps and fall on random registers; a hash
    is done once its points pass the largest register of its set.
    """
    sets = len(bounds) - 1
    least = np.full((sets, REGISTERS), np.inf)
    flat = least.reshape(-1)
    owner = np.repeat(np.arange(sets), np.diff(bounds))
    state, reached = values.copy(), np.zeros(len(values))
    while len(owner):
        steps = int(np.clip(100_000 // len(owner), 1, 64))
        for _ in range(steps):
            state = mix(state + np.uint64(0x9E3779B97F4A7C15))
            unit = ((state >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52
            reached = reached - np.log(unit) / REGISTERS
            place = mix(state ^ np.uint64(0xD1B54A32D192ED03)) % np.uint64(REGISTERS)
            np.minimum.at(flat, owner * REGISTERS + place.astype(np.int64), reached)
        live = np.unique(owner)
        limit = np.zeros(sets)
        limit[live] = least[live].max(axis=1)
        go = reached < limit[owner]
        owner, state, reached = owner[go], state[go], reached[go]
    with np.errstate(divide="ignore"):
        return np.clip(np.floor(1 - np.log(least) / np.log(BASE)) + 2000, 0, 32767).astype(np.int16)


def similarity(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of sketches, given the set sizes."""
    return np.concatenate([np.zeros(0), *(_estimate(left[c], right[c], n_left[c], n_right[c]) for c in _cuts(len(left)))])


def _cuts(pairs: int) -> Iterator[slice]:
    return (slice(at, at + PAIRS) for at in range(0, pairs, PAIRS))


def _estimate(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray) -> np.ndarray:
    more, less = (left > right).sum(1), (left < right).sum(1)
    equal = REGISTERS - more - less
    u = n_left / (n_left + n_right)
    grid = np.linspace(0, 1, 201)
    j = np.minimum(grid[None, :], (np.minimum(u, 1 - u) / np.maximum(u, 1 - u))[:, None])
    p = lambda x: -np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / np.log(BASE)
    above, below = p(u[:, None] - (1 - u)[:, None] * j), p((1 - u)[:, None] - u[:, None] * j)
    log = lambda x: np.log(np.maximum(x, 1e-12))
    value = more[:, None] * log(above) + less[:, None] * log(below) + equal[:, None] * log(1 - above - below)
    return j[np.arange(len(j)), np.argmax(value, axis=1)]


def _least(threshold: float) -> float:
    return threshold - SLACK * (threshold * (1 - threshold) / REGISTERS) ** 0.5


def text_portions(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about TEXT_BYTES of text and at most ROWS rows each."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at = np.searchsorted(np.cumsum(sizes), np.arange(1, int(sizes.sum()) // TEXT_BYTES + 1) * TEXT_BYTES) + 1
    edges = np.unique(np.clip(np.concatenate([np.arange(0, batch.num_rows, ROWS), at, [batch.num_rows]]), 0, batch.num_rows))
    for a, b in zip(edges, edges[1:]):
        yield batch.slice(a, b - a)


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, size of the set, 128 bits that name the set, and its registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in text_portions(b, 1)):
            values, bounds = shingles(Words(batch.column(1)), words)
            sums = [np.append(np.uint64(0), np.cumsum(mix(values ^ np.uint64(salt)))) for salt in (0x1234567, 0x89ABCDEF)]
            names = [(s[bounds[1:]] - s[bounds[:-1]]).view(np.int64) for s in sums]
            registers = pa.FixedSizeListArray.from_arrays(pa.array(sketch(values, bounds).reshape(-1)), REGISTERS)
            columns = [batch.column(0), pa.array(np.diff(bounds)), *map(pa.array, names), registers.cast(pa.list_(pa.int16()))]
            yield pa.record_batch(columns, names=["doc_id", "n", "name_a", "name_b", "sketch"])

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return text.mapInArrow(run, "doc_id long, n long, name_a long, name_b long, sketch array<smallint>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _likely(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose likelihood estimate may reach ``threshold``."""
    side = lambda x: classes.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    floor = _least(threshold)

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sizes = [b.column(i).to_numpy().astype(float) for i in (2, 4)]
                keep = similarity(_matrix(b.column(3)), _matrix(b.column(5)), *sizes) >= floor
                yield b.select(["a", "b"]).filter(pa.array(keep))

    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "s_a", "n_b", "s_b")
    return joined.mapInArrow(estimate, "a long, b long")


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id and text of the documents in ``ids``, which is written first: if it turns out
    small, Spark sends it to the texts instead of shuffling them."""
    needed = written(ids.select("id").distinct(), "near-ids")
    text = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return written(text.join(needed, "id", "left_semi").dropDuplicates(["id"]), "near-texts")


def _confirmed(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs whose full sets reach ``percent``: 100 * common >= percent * union."""
    texts = _texts(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")))

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for b in batches for half in text_portions(b, 2) for part in text_portions(half, 3)):
            (x, x_at), (y, y_at) = (shingles(Words(b.column(i)), words) for i in (2, 3))
            both = np.concatenate([x, y])
            owner = np.concatenate([np.repeat(np.arange(len(at) - 1), np.diff(at)) for at in (x_at, y_at)])
            order = np.lexsort((both, owner))
            both, owner = both[order], owner[order]
            same = (both[1:] == both[:-1]) & (owner[1:] == owner[:-1])
            common = np.bincount(owner[1:][same], minlength=b.num_rows)
            union = np.diff(x_at) + np.diff(y_at) - common
            yield b.select(["a", "b"]).filter(pa.array((100 * common >= percent * union) & (common > 0)))

    side = lambda x: texts.select(F.col("id").alias(x), F.col("text").alias(f"t_{x}"))
    joined = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "t_a", "t_b")
    return joined.mapInArrow(confirm, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """``id`` and ``component`` (the smallest id it is connected to) of every linked id.

    Each round takes the smallest component of the neighbours and then that component's own
    component, so the rounds grow with the logarithm of the longest chain.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = written(both, "links")
    now = written(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("least")).select("id", F.least("id", "least").alias("component")), "components")
    while True:
        near = both.join(now.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        step = now.join(near, "id").select("id", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        up = now.select(F.col("id").alias("component"), F.col("component").alias("above"))
        step = written(step.join(up, "component").select("id", "was", F.least("component", "above").alias("component")), "components")
        if step.filter("was <> component").isEmpty():
            return step.select("id", "component")
        now = step.select("id", "component")


def _buckets(classes: DataFrame) -> DataFrame:
    """bucket, size, band, id and n of all that share a band with another class."""
    band = lambda i: F.xxhash64(i, F.slice("sketch", i * WIDTH + 1, WIDTH))
    dealt = classes.select("id", "n", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), band)).alias("band", "bucket"))
    sizes = dealt.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    return dealt.join(sizes, "bucket")


def _comparable(percent: int):
    """Sets of such sizes can reach the similarity at all."""
    return F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent


def _first_pairs(buckets: DataFrame, percent: int) -> DataFrame:
    """All pairs of small buckets, and in a large one each member with the leader."""
    side = lambda df, x: df.select("bucket", F.col("id").alias(x), F.col("n").alias(f"n_{x}"))
    small, large = buckets.filter(F.col("size") <= SMALL_BUCKET), buckets.filter(F.col("size") > SMALL_BUCKET)
    pairs = side(small, "a").join(side(small, "b"), "bucket").filter("a < b")
    weight = large.groupBy("id").agg(F.sum("size").alias("weight"))
    leaders = large.join(weight.withColumnRenamed("id", "weighed"), F.col("id") == F.col("weighed")).groupBy("bucket").agg(F.max_by(F.struct("id", "n"), F.struct("weight", -F.col("id"))).alias("l"))
    stars = side(large, "b").join(leaders.select("bucket", F.col("l.id").alias("a"), F.col("l.n").alias("n_a")), "bucket").filter("a <> b")
    stars = stars.withColumns({"a": F.least("a", "b"), "b": F.greatest("a", "b")})
    return pairs.select("a", "b", "n_a", "n_b").unionByName(stars.select("a", "b", "n_a", "n_b")).filter(_comparable(percent)).select("a", "b").distinct()


def _divided_pairs(buckets: DataFrame, labels: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Likely pairs between components of large buckets that are still divided.

    A bucket is dealt into blocks, and a cell holds two blocks of it. Each pair counts in the
    first band that it shares. A cell's pairs are one row: cell, and the arrays a and b.
    """
    large = buckets.filter(F.col("size") > SMALL_BUCKET).join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    open_ = large.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("bucket")
    members = large.join(open_, "bucket").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    members = members.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    members = members.join(classes.select(F.col("id").alias("member"), "sketch"), F.col("id") == F.col("member"))
    cells = members.select("bucket", "band", "id", "n", "component", "sketch", "block", other)
    cells = cells.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other")
    floor = _least(percent / 100)

    def compare(cell: pa.Table) -> pa.Table:
        ids, n, part = cell["id"].to_numpy(), cell["n"].to_numpy().astype(float), cell["component"].to_numpy()
        block, i, j, band = (cell[c].to_numpy() for c in ("block", "i", "j", "band"))
        registers = _matrix(cell["sketch"].combine_chunks())
        banded = np.zeros((len(ids), BANDS), np.uint64)
        for c in range(WIDTH):
            banded = mix(banded + registers.reshape(-1, BANDS, WIDTH)[:, :, c].astype(np.uint64) + np.uint64(c + 1))
        earlier = np.ascontiguousarray(banded[:, : int(band[0])])
        lefts, rights = [np.zeros(0, int)], [np.zeros(0, int)]
        for k in range(len(ids)):
            right = np.flatnonzero((part != part[k]) & (ids > ids[k]) & (np.minimum(n, n[k]) * 100 >= np.maximum(n, n[k]) * percent) & ((i == j) | (block != block[k])))
            right = right[~(earlier[right] == earlier[k]).any(1)]
            right = right[(registers[right] == registers[k]).sum(1) >= floor * REGISTERS]
            lefts.append(np.full(len(right), k))
            rights.append(right)
        left, right = np.concatenate(lefts), np.concatenate(rights)
        tiles = [(left[c], right[c]) for c in _cuts(len(left))]
        near = [np.zeros(0), *(similarity(registers[x], registers[y], n[x], n[y]) for x, y in tiles)]
        keep = np.concatenate(near) >= floor
        left, right = ids[left[keep]], ids[right[keep]]
        name = f"{cell['bucket'][0]}:{i[0]}:{j[0]}"
        row = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x))
        return pa.table({"cell": pa.array([name]), "a": row(left), "b": row(right)}).slice(0, int(len(left) > 0))

    return cells.groupBy("bucket", "i", "j").applyInArrow(compare, "cell string, a array<long>, b array<long>")


def _forest(left: np.ndarray, right: np.ndarray) -> list[int]:
    """Places of links that join what all links join."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = up
        return x

    out = []
    for k, (a, b) in enumerate(zip(left.tolist(), right.tolist())):
        if (a := find(a)) != (b := find(b)):
            root[max(a, b)] = min(a, b)
            out.append(k)
    return out


def _confirmed_cells(cells: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The links among each cell's pairs, as far as they join anything; a cell gets each of its texts once."""
    ids = cells.select("cell", F.explode(F.array_distinct(F.concat("a", "b"))).alias("id"))
    texts = _texts(docs, ids).withColumnRenamed("id", "text_id")

    def confirm(pairs: pa.Table, held: pa.Table) -> pa.Table:
        if not pairs.num_rows or not held.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        order = np.argsort(held["id"].to_numpy())
        ids = held["id"].to_numpy()[order]
        values, at = shingles(Words(held["text"].combine_chunks().take(pa.array(order))), words)
        values = np.unique(values, return_inverse=True)[1]
        a, b = (pairs[c].combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in "ab")
        order = np.argsort(a, kind="stable")
        a, b = np.searchsorted(ids, a[order]), np.searchsorted(ids, b[order])
        mark, size, links = np.zeros(int(values.max(initial=0)) + 1, np.int32), np.diff(at), []
        for x in np.unique(a):
            mark[values[at[x] : at[x + 1]]] = 1
            for y in b[np.searchsorted(a, x) : np.searchsorted(a, x, "right")]:
                common = int(mark[values[at[y] : at[y + 1]]].sum())
                if 100 * common >= percent * (size[x] + size[y] - common):
                    links.append((ids[x], ids[y]))
            mark[values[at[x] : at[x + 1]]] = 0
        links = np.array(links, np.int64).reshape(-1, 2)
        links = links[_forest(links[:, 0], links[:, 1])]
        return pa.table({"a": pa.array(links[:, 0]), "b": pa.array(links[:, 1])})

    held = ids.join(texts, F.col("id") == F.col("text_id")).select(F.col("cell").alias("of_cell"), "id", "text")
    return cells.groupBy("cell").cogroup(held.groupBy("of_cell")).applyInArrow(confirm, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs(doc_id, text)``.

    Sets are the distinct ``words``-word shingles of the whole text (a shorter text has one,
    of all its words; a null or blank text none, and is linked with nothing). Documents are
    linked if 100 * common >= ``percent`` * union. ``component_id`` is the smallest doc_id
    reachable; ``kept`` marks that document. Repeated rows are links like all others and
    stay rows. A row without doc_id takes no part: its component is null and it is kept.
    Other columns are ignored; an empty table gives no rows.
    """
    sets = written(sketches(docs, words), "sketches")
    named = sets.filter("doc_id is not null and n > 0")
    key = ["n", "name_a", "name_b"]
    classes = written(named.groupBy(*key).agg(F.min("doc_id").alias("id"), F.any_value("sketch").alias("sketch")), "classes")
    buckets = written(_buckets(classes), "buckets")
    sharing = written(classes.select("id", "n", "sketch").join(written(buckets.select("id").distinct(), "sharing-ids"), "id", "left_semi"), "sharing")
    pairs = written(_likely(_first_pairs(buckets, percent), sharing, percent / 100), "pairs")
    links = written(_confirmed(pairs, docs, words, percent), "confirmed")
    labels = components(links)
    more = written(_divided_pairs(buckets, labels, sharing, percent), "divided-pairs")
    if not more.isEmpty():
        labels = components(links.unionByName(_confirmed_cells(more, docs, words, percent)))
    classed = classes.drop("sketch").join(labels, "id", "left").select(*key, F.coalesce("component", "id").alias("component_id"))
    rows = sets.drop("sketch").join(classed, key, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op2_near_dup(spark, sf_dir: str) -> DataFrame:
    """All documents, by two-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=2)
