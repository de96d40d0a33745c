"""Product codes of vectors in integer arithmetic, with entries found through a VA-file of each codebook.

Vectors are cut into parts; each part position has a codebook of a few entries, and a part's code is its nearest entry.
The entries are kept as a VA-file (Weber, Schek and Blott 1998): each coordinate is quantised to a few bits, the number of
the cell that holds it. For a part, a table for each coordinate has the least and the greatest squared distance to each
cell; summed over an entry's cells they bound its distance from below and from above. Only entries whose lower bound does
not exceed the least upper bound are refined by integer distances, so the nearest entry is never lost.

Codebooks are means of the parts that chose an entry, so each round sends one sum for each entry and task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, read_table, ship, spare

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Bits of a cell's number.
BITS = 4
#: Vectors that are coded at once.
CHUNK = 2048


class Cells:
    """The VA-file of one codebook: entries (n, m) of 64-bit integers, and the cell of each of their coordinates."""

    def __init__(self, entries: np.ndarray, bits: int = BITS):
        self.entries = entries
        low, high = entries.min(0), entries.max(0)
        width = (high - low + (1 << bits)) >> bits
        self.cell = (entries - low) // width
        edges = low[:, None] + width[:, None] * np.arange(1 << bits)
        #: The least and the greatest integer of each cell, by coordinate.
        self.low, self.high = edges, edges + width[:, None] - 1

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the squared distances from each row of x to each entry."""
        below = np.zeros((len(x), len(self.entries)), np.int64)
        above = below.copy()
        for j in range(x.shape[1]):
            to_low, to_high = self.low[j] - x[:, j, None], x[:, j, None] - self.high[j]
            near = np.maximum(np.maximum(to_low, to_high), 0)
            far = np.maximum(np.abs(to_low), np.abs(to_high))
            below += (near * near)[:, self.cell[:, j]]
            above += (far * far)[:, self.cell[:, j]]
        return below, above

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each row's nearest entry, ties to the lower one."""
        below, above = self.bounds(x)
        row, entry = np.nonzero(below <= above.min(1, keepdims=True))
        gap = x[row] - self.entries[entry]
        d = (gap * gap).sum(1)
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else row
        best = np.minimum.reduceat(d, first) if len(row) else d
        hit = np.flatnonzero(d == np.repeat(best, np.diff(np.r_[first, len(row)])))
        _, at = np.unique(row[hit], return_index=True)
        return entry[hit[at]], best


@dataclass(frozen=True)
class Codebooks:
    #: (parts, entries, components of a part)
    entries: np.ndarray
    scale: int

    @property
    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()

    def cells(self) -> list[Cells]:
        return [Cells(e) for e in self.entries]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The vectors that rows of codes stand for: the middles of their entries' integer steps."""
        return np.concatenate([self.entries[p][codes[:, p]] for p in range(len(self.entries))], 1) / self.scale + 0.5 / self.scale


def _read(ints: pa.Array, parts: int) -> np.ndarray:
    """(rows, parts, components)."""
    x = ints.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return x.reshape(len(ints), parts, -1)


def _sums(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """For each part and entry the sum and the number of the parts that chose it, once a task."""
    books = shared.value
    cells, (parts, entries, m) = books.cells(), books.entries.shape
    total, count = np.zeros((parts, entries, m), np.int64), np.zeros((parts, entries), np.int64)
    for batch in batches:
        x = _read(batch.column("ints"), parts)
        for a in range(0, len(x), CHUNK):
            for p in range(parts):
                own = x[a : a + CHUNK, p]
                near, _ = cells[p].nearest(own)
                np.add.at(total[p], near, own)
                count[p] += np.bincount(near, minlength=entries)
    part, entry = np.nonzero(count)
    yield pa.RecordBatch.from_arrays(
        [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry], pa.int64()), pa.array(list(total[part, entry]), pa.list_(pa.int64()))], ["part", "entry", "n", "total"]
    )


def _coded(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    books = shared.value
    cells, parts = books.cells(), len(books.entries)
    for batch in batches:
        x = _read(batch.column("ints"), parts)
        codes, error = np.zeros((len(x), parts), np.int32), np.zeros(len(x), np.int64)
        for a in range(0, len(x), CHUNK):
            for p in range(parts):
                near, d = cells[p].nearest(x[a : a + CHUNK, p])
                codes[a : a + CHUNK, p] = near
                error[a : a + CHUNK] += d
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(list(codes), pa.list_(pa.int32())), pa.array(error)], ["id", "label", "codes", "error"])


def integers(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", parts: int = PARTS, scale: int = SCALE) -> DataFrame | None:
    """(id, label, ints): floor(scale * x) of the vectors that take part, in a table; None if there are none.

    Vectors that are null, empty, or hold a null or non-finite component take no part, nor do those whose length isn't
    that of the vector of the smallest id whose length `parts` divides, nor those of components so large that their
    squared distances don't fit into 64 bits (in 64 dimensions, at a scale of 4096: from 46,340 on).
    """
    plain = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(label).alias("label"), F.col(embedding).cast("array<double>").alias("x"))
    fits = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) * scale < 2.0**62))
    plain = plain.where((F.size("x") > 0) & (F.size("x") % parts == 0) & fits)
    first = plain.select(F.min_by(F.size("x"), F.struct(F.col("id").isNull(), "id", F.size("x"))).alias("d")).first()["d"]
    if first is None:
        return None
    limit = 2.0**30.5 / first**0.5
    whole = F.transform("x", lambda v: F.floor(v * scale).cast("long"))
    near = plain.where((F.size("x") == first) & F.forall("x", lambda v: F.abs(v) * scale < limit))
    return cut(near.select("id", "label", whole.alias("ints")), "integers")


def fit(ints: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks | None:
    """Codebooks that start as the parts of the vectors of the smallest ids, at most `entries` of them; None without any.

    Rows without id, and rows that repeat one, come after the others there; ties go to the smaller vector. Each round
    replaces an entry by the floor of the mean of the parts that chose it; an entry that none chose stays. What the driver
    gets is one sum for each entry.
    """
    spark = ints.sparkSession
    start = ints.orderBy(F.col("id").asc_nulls_last(), "ints").limit(entries).toArrow()
    if not start.num_rows:
        return None
    books = Codebooks(np.ascontiguousarray(_read(start.column("ints").combine_chunks(), parts).transpose(1, 0, 2)), scale)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(books)
        sums = ints.select("ints").mapInArrow(lambda b: _sums(b, shared), "part int, entry int, n long, total array<long>")  # noqa: B023
        m = books.entries.shape[2]
        rows = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("total")[j]).alias(f"t{j}") for j in range(m))).collect()
        new = books.entries.copy()
        for r in rows:
            new[r["part"], r["entry"]] = [r[f"t{j}"] // r["n"] for j in range(m)]
        shared.unpersist()
        books = Codebooks(new, scale)
    return books


def encode(ints: DataFrame, books: Codebooks) -> DataFrame:
    """(id, label, codes, error): each vector's nearest entries and the sum of its squared distances."""
    shared = ints.sparkSession.sparkContext.broadcast(books)
    kind = ints.schema["label"].dataType.simpleString()
    return ints.mapInArrow(lambda b: _coded(b, shared), f"id long, label {kind}, codes array<int>, error long")


def compress(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, codes, code, error, label_error, codebooks_sha256 for each vector that takes part: see integers().

    `code` has two hex digits for each part; label_error sums the error over equal labels, nulls together. Repeated ids are
    rows of their own. Other columns aren't read. No vectors give an empty result.
    """
    spark = vectors.sparkSession
    ship(spark)
    ints = integers(vectors, vec_id, embedding, label, parts, scale)
    books = None if ints is None else fit(ints, parts, entries, rounds, scale)
    columns = ["codes", "code", "error", "label_error", "codebooks_sha256"]
    (name,) = spare(columns, vec_id)
    if books is None:
        return spark.createDataFrame([], f"`{name}` long, codes array<int>, code string, error long, label_error long, codebooks_sha256 string")
    coded = cut(encode(ints, books), "coded")
    sums = coded.groupBy(F.col("label").alias("own")).agg(F.sum("error").alias("label_error"))
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("own")))
    code = F.concat_ws("", F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))))
    return out.select(F.col("id").alias(name), "codes", code.alias("code"), "error", "label_error", F.lit(books.sha256).alias("codebooks_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(read_table(spark, sf_dir, "embeddings")).drop("codes")


def _sql() -> str:
    """One assignment and one update for each round, each a query of its own."""
    distance = "list_sum(list_transform(list_zip(p.w, b.w), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    parts = [f"""q AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * x) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))
), p AS MATERIALIZED (
  SELECT vec_id, label, part, v[CAST(part * len(v) // {PARTS} + 1 AS BIGINT) : CAST((part + 1) * len(v) // {PARTS} AS BIGINT)] AS w FROM q, range({PARTS}) t(part)
), b0 AS MATERIALIZED (
  SELECT part, e, w FROM (SELECT part, w, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e FROM p) WHERE e < {ENTRIES}
)"""]
    for r in range(ROUNDS + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT p.vec_id, any_value(p.label) AS label, p.part, any_value(p.w) AS w, arg_min(b.e, {distance} * {ENTRIES} + b.e) AS e, min({distance}) AS d FROM p JOIN b{r} b USING (part) GROUP BY p.vec_id, p.part)")
        if r < ROUNDS:
            parts.append(f"""m{r} AS (
  SELECT part, e, list(x ORDER BY i) AS w FROM (
    SELECT part, e, i, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS x FROM (SELECT part, e, unnest(w) AS x, unnest(range(len(w))) AS i FROM a{r}) GROUP BY part, e, i
  ) GROUP BY part, e
), b{r + 1} AS MATERIALIZED (SELECT b.part, b.e, coalesce(m.w, b.w) AS w FROM b{r} b LEFT JOIN m{r} m USING (part, e))""")
    return f"""WITH {", ".join(parts)}, c AS (
  SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', e), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(w, ','), ',' ORDER BY part, e)) FROM b{ROUNDS}) AS codebooks_sha256 FROM c"""


SQL = _sql()
