"""Vector codes: k-means codebooks per part, with candidates memoised per grid cell.

Components become integers, vectors are cut into equal parts, and each part position has a
codebook. To find a part's nearest entry, its coarse grid cell is looked up: the cell holds
the entries that can be nearest to some point of its box (an entry is dominated if its least
distance to the box is above the largest distance of another one). Only those are evaluated.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.llm.common import kept, table, written

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256.0
CELLS_HELD = 1 << 15  # cells that a worker remembers of one codebook; it then starts afresh
ROWS = 4096
SALTS = 64


def integer_parts(df: DataFrame, parts: int = PARTS, scale: float = SCALE) -> DataFrame:
    """``vec_id``, ``label`` and ``vec``, floor(scale * x) of each component as long.

    Rows go whose vector is null, empty, or holds a null or non-finite component; a null
    vec_id or label stays. Shorter vectors are filled with zeros to the length of the longest,
    and that to a multiple of ``parts``. Integers saturate where a squared distance of whole
    vectors could leave 64 bits (beyond 2^27 for 64 components).
    """
    values = F.col("embedding")
    finite = F.forall(values, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    usable = df.filter(F.coalesce(finite & (F.size(values) > 0), F.lit(False)))
    longest = usable.agg(F.max(F.size(values))).first()[0] or parts
    size = -(-longest // parts) * parts
    most = float(math.isqrt((1 << 62) // size) // 2)

    def whole(x):
        return F.greatest(F.least(F.floor(x.cast("double") * scale).cast("double"), F.lit(most)), F.lit(-most)).cast("long")

    filled = F.concat(F.transform(values, whole), F.array_repeat(F.lit(0).cast("long"), F.lit(size) - F.size(values)))
    return usable.select(F.col("vec_id").cast("long").alias("vec_id"), "label", filled.alias("vec"))


# ---- grid cells --------------------------------------------------------------------------


def cell_widths(books: np.ndarray) -> np.ndarray:
    """Per part a power of two: about the usual distance, per component, of an entry to the
    next one. Narrower cells leave fewer candidates each but are met less often."""
    out = np.ones(len(books), np.int64)
    for p, book in enumerate(books):
        away = ((book[:, None, :] - book[None, :, :]).astype(np.float64) ** 2).sum(axis=2)
        away[away == 0] = np.inf
        near = away.min(axis=1, initial=np.inf)
        near = near[np.isfinite(near)]
        if len(near):
            out[p] = 1 << max(0, round(math.log2(max(1.0, math.sqrt(np.median(near) / book.shape[1])))))
    return out


def _cell_keys(cells: np.ndarray) -> np.ndarray:
    """One key per cell: all places in one integer if they fit, else the places side by side."""
    bits = 64 // cells.shape[1]
    if bits > 1 and -(1 << (bits - 1)) <= cells.min(initial=0) and cells.max(initial=0) < 1 << (bits - 1):
        shifts = np.arange(cells.shape[1], dtype=np.uint64) * np.uint64(bits)
        low = cells.astype(np.uint64) & np.uint64((1 << bits) - 1)
        return np.bitwise_or.reduce(low << shifts, axis=1)
    return cells.view([("", cells.dtype)] * cells.shape[1]).reshape(-1)


class Cells:
    """Candidates by cell for one part position, found when a cell is first met."""

    def __init__(self, book: np.ndarray, width: int):
        self.book, self.width = book, int(width)
        self.number: dict[int | tuple, int] = {}
        self.candidates = np.zeros((0, len(book)), bool)
        self.evaluated = self.points = 0

    def _not_dominated(self, cells: np.ndarray) -> np.ndarray:
        """For each cell the entries whose least squared distance to the box does not exceed
        the smallest of all entries' largest ones; exact, in integers."""
        low = (cells * self.width)[:, None, :]
        high = low + self.width - 1
        book = self.book[None, :, :]
        outside = np.maximum(np.maximum(low - book, book - high), 0)
        far = np.maximum(np.abs(book - low), np.abs(book - high))
        least, most = (outside * outside).sum(axis=2), (far * far).sum(axis=2)
        return least <= most.min(axis=1, keepdims=True)

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry (the lower of equals) and squared distance, per point."""
        cells = np.ascontiguousarray(points // self.width)
        met, first, back = np.unique(_cell_keys(cells), return_index=True, return_inverse=True)
        if len(self.number) + len(met) > CELLS_HELD:
            self.number.clear()
            self.candidates = self.candidates[:0]
        names = met.tolist()
        new = [i for i, k in enumerate(names) if k not in self.number]
        if new:
            self.number.update(zip((names[i] for i in new), range(len(self.candidates), len(self.candidates) + len(new))))
            found = [self._not_dominated(cells[first[new[i : i + 1024]]]) for i in range(0, len(new), 1024)]
            self.candidates = np.concatenate([self.candidates, *found])
        rows = np.array([self.number[k] for k in names])[back]
        point, entry = np.nonzero(self.candidates[rows])
        gap = points[point] - self.book[entry]
        distance = (gap * gap).sum(axis=1)
        starts = np.searchsorted(point, np.arange(len(points)))
        best = np.minimum.reduceat(distance, starts)
        hits = np.flatnonzero(distance == best[point])
        leading = hits[np.searchsorted(point[hits], np.arange(len(points)))]
        self.evaluated, self.points = self.evaluated + len(point), self.points + len(points)
        return entry[leading], best


def _worker_cells(books: np.ndarray) -> list[Cells]:
    """The cells of these codebooks in this worker, kept from task to task; one set at a time."""
    key, held = hashlib.sha256(books.tobytes()).digest(), kept("vector cells", dict)
    if key not in held:
        held.clear()
        held[key] = [Cells(b, w) for b, w in zip(books, cell_widths(books))]
    return held[key]


def _matrices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, np.ndarray]]:
    for at in range(0, batch.num_rows, ROWS):
        part = batch.slice(at, ROWS)[column]
        yield at, part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)


# ---- codebooks ---------------------------------------------------------------------------


def _sums(books: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Vectors to the sum and count of the parts nearest to each entry: one row per task and entry."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            for _, rows in _matrices(batch, "vec"):
                for p, cells in enumerate(_worker_cells(books)):
                    points = rows[:, p * books.shape[2] : (p + 1) * books.shape[2]]
                    entry, _ = cells.nearest(points)
                    np.add.at(total[p], entry, points)
                    count[p] += np.bincount(entry, minlength=books.shape[1])
        part, entry = np.nonzero(count)
        yield pa.record_batch(
            [
                pa.array(part, pa.int32()),
                pa.array(entry, pa.int32()),
                pa.array(list(total[part, entry]), pa.list_(pa.int64())),
                pa.array(count[part, entry], pa.int64()),
            ],
            names=["part", "entry", "total", "n"],
        )

    return sums


def first_codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """Parts of the vectors with the smallest vec_ids, ties by the vector; (part, entry, place)."""
    rows = vectors.filter("vec_id is not null").orderBy("vec_id", "vec").limit(entries).select("vec").collect()
    if not rows:
        return np.zeros((parts, 0, 1), np.int64)
    books = np.array([r["vec"] for r in rows], np.int64).reshape(len(rows), parts, -1)
    return np.ascontiguousarray(books.transpose(1, 0, 2))


def next_codebooks(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """Each entry moves to the floor of the mean of its parts; an unused one stays.

    Sums are added up in Spark; at most one row per entry reaches the driver.
    """
    length = books.shape[2]
    added = vectors.select("vec").mapInArrow(_sums(books), "part int, entry int, total array<long>, n long").groupBy("part", "entry")
    columns = [F.sum(F.get("total", F.lit(i))).alias(f"s{i}") for i in range(length)]
    out = books.copy()
    for row in added.agg(F.sum("n").alias("n"), *columns).collect():
        out[row["part"], row["entry"]] = [row[f"s{i}"] // row["n"] for i in range(length)]
    return out


def train_codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks over all ``vectors`` (as from ``integer_parts``)."""
    books = first_codebooks(vectors, parts, entries)
    for _ in range(rounds if books.shape[1] else 0):
        books = next_codebooks(vectors, books)
    return books


def codebooks_digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def encode_vectors(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (hex digits of the entry numbers, two for up to 256 entries) and error."""
    digits = 2 if books.shape[1] <= 256 else 2 * -(-(books.shape[1] - 1).bit_length() // 8)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = [], []
            for _, rows in _matrices(batch, "vec"):
                error, out = np.zeros(len(rows), np.int64), np.zeros((len(rows), len(books)), f">u{1 if digits == 2 else 4}")
                for p, cells in enumerate(_worker_cells(books)):
                    entry, distance = cells.nearest(rows[:, p * books.shape[2] : (p + 1) * books.shape[2]])
                    out[:, p], error = entry, error + distance
                if digits == 2:
                    codes += [r.tobytes().hex() for r in out]
                else:
                    codes += ["".join(f"{e:0{digits}x}" for e in r) for r in out.tolist()]
                errors.append(error)
            if batch.num_rows:
                columns = [batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(np.concatenate(errors))]
                yield pa.record_batch(columns, names=["vec_id", "label", "code", "error"])

    schema = f"vec_id long, label {vectors.schema['label'].dataType.simpleString()}, code string, error long"
    return vectors.select("vec_id", "label", "vec").mapInArrow(encode, schema)


def vector_codes(df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE) -> DataFrame:
    """Codes of ``df(vec_id, embedding, label)``: vec_id, code, error, label_error, codebooks_sha256.

    ``label_error`` sums ``error`` over equal labels, nulls together (null beyond 64 bits). Null vec_ids take part
    but never start a codebook; of repeated vec_ids each row counts. With fewer vectors than
    ``entries`` codebooks are shorter; without a vec_id, or for an empty table, the result is
    empty. Other columns are ignored. Codebooks are the only thing that is broadcast:
    parts * entries * length integers, whatever the number of vectors.
    """
    vectors = written(integer_parts(df, parts, scale), "vectors")
    books = train_codebooks(vectors, parts, entries, rounds)
    if not books.shape[1]:
        vectors, books = vectors.limit(0), np.zeros((parts, 1, 1), np.int64)
    salt = F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int")
    coded = written(encode_vectors(vectors, books).withColumn("salt", salt), "vector-codes")
    slices = coded.groupBy("label", "salt").agg(F.try_sum("error").alias("error"))
    labels = slices.groupBy("label").agg(F.try_sum("error").alias("label_error"), F.collect_list("salt").alias("salts"))
    spread = labels.select(F.col("label").alias("_label"), "label_error", F.explode("salts").alias("_salt"))
    same = coded["label"].eqNullSafe(spread["_label"]) & (coded["salt"] == spread["_salt"])
    return coded.join(spread, same).select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    """Codes of all embeddings."""
    return vector_codes(table(spark, sf_dir, "embeddings"))


def _nearest_sql(book: str) -> str:
    distance = " + ".join(f"(p.x[{i}] - c.x[{i}]) * (p.x[{i}] - c.x[{i}])" for i in range(1, 5))
    return f"""
    SELECT id, part, any_value(x) AS x, arg_min(entry, d * 64 + entry) AS entry, min(d) AS d
    FROM (SELECT p.id, p.part, p.x, c.entry, {distance} AS d FROM parts p JOIN {book} c USING (part))
    GROUP BY id, part"""


def _round_sql(book: str, found: str) -> str:
    return f"""
    SELECT b.part, b.entry,
           CASE WHEN count(f.id) = 0 THEN any_value(b.x)
                ELSE [{', '.join(f'floor(sum(f.x[{i}])::DOUBLE / count(f.id))::BIGINT' for i in range(1, 5))}] END AS x
    FROM {book} b LEFT JOIN {found} f USING (part, entry) GROUP BY b.part, b.entry"""


OP11_SQL = f"""
WITH usable AS (
    SELECT row_number() OVER (ORDER BY vec_id) AS id, vec_id, label,
           [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS vec
    FROM embeddings
    WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
parts AS (
    SELECT id, p.i AS part, vec[p.i * len(vec) // 16 + 1 : (p.i + 1) * len(vec) // 16] AS x
    FROM usable, range(16) AS p(i)),
book0 AS (SELECT part, id - 1 AS entry, x FROM parts WHERE id <= 64),
near0 AS ({_nearest_sql('book0')}),
book1 AS ({_round_sql('book0', 'near0')}),
near1 AS ({_nearest_sql('book1')}),
book2 AS ({_round_sql('book1', 'near1')}),
near2 AS ({_nearest_sql('book2')}),
codes AS (
    SELECT id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error
    FROM near2 GROUP BY id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM book2) AS codebooks_sha256
FROM usable JOIN codes USING (id)
"""
