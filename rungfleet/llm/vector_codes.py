"""Codes for vectors: four parts, each named by the nearest of 256 codebook entries,
with exact integer arithmetic and adaptive distance bounds.

Every part of a vector keeps its ``b`` closest entries, a lower bound of its distance
to each, and one lower bound for all others. When entries move, bounds shrink by
how far they moved. Entries whose bound is above the distance to the current one
are settled; only the others are measured, as integers, so that ties go to the
lower index. Where the outer bound does not hold, all entries are measured and the
list is made anew. After each round ``b`` follows how much of the lists was needed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialize_counted, maybe_broadcast, smaller_batches
from .vectors import integer_vectors, matrix

#: Parts of a vector, entries of a codebook, rounds of moving them.
PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: List lengths that ``b`` may take, and the share of parts whose list should suffice.
LEAST_B, MOST_B, SUFFICE = 2, 64, 0.9
#: Relative slack of bounds in doubles, and of their stored form in floats.
SLACK, SHORT = 1e-12, 2e-7
#: Parts measured against all entries at a time.
CHUNK = 2048


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to rows of the same shape. Longs are enough
    unless components are huge; then Python integers are used."""
    top = max(_top(x), _top(c))
    if 4 * top * top * max(x.shape[-1], 1) < 1 << 62:
        d = x.astype(np.int64) - c.astype(np.int64)
        return (d * d).sum(-1)
    d = x.astype(object) - c.astype(object)
    return (d * d).sum(-1)


def all_squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of ``x`` to each of ``c``; by one matrix product
    in doubles where every sum stays below 2^53."""
    top = max(_top(x), _top(c))
    if 4 * top * top * max(x.shape[1], 1) < 1 << 53:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return squared(x[:, None, :], c[None, :, :])


def _top(x: np.ndarray) -> int:
    return max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0


def root(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64))


class Lists:
    """Closest entries of some parts: ``near`` (rows of entry numbers, -1 where a list
    is shorter), ``low`` (lower bounds, rising) and ``outer`` (one for all others)."""

    def __init__(self, near: np.ndarray, low: np.ndarray, outer: np.ndarray):
        self.near, self.low, self.outer = near, low, outer

    def resized(self, b: int) -> Lists:
        n, have = self.near.shape
        if b < have:
            return Lists(self.near[:, :b], self.low[:, :b], np.minimum(self.outer, self.low[:, b:].min(1)))
        pad = np.full((n, b - have), -1), np.full((n, b - have), np.inf)
        return Lists(np.hstack([self.near, pad[0]]), np.hstack([self.low, pad[1]]), self.outer)


def closest(x: np.ndarray, book: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray, Lists]:
    """Nearest entry, its squared distance, and new lists, from all distances."""
    k, code, dist = len(book), [], []
    near, low, outer = np.full((len(x), b), -1), np.full((len(x), b), np.inf), np.full(len(x), np.inf)
    for at in range(0, len(x), CHUNK):
        d = all_squared(x[at : at + CHUNK], book)
        take = min(b, k)
        order = np.argsort(d, axis=1, kind="stable")[:, : take + 1]
        sorted_d = np.take_along_axis(d, order, 1)
        code.append(order[:, 0])
        dist.append(sorted_d[:, 0])
        rows = slice(at, at + len(d))
        near[rows, :take] = order[:, :take]
        low[rows, :take] = root(sorted_d[:, :take]) * (1 - SLACK)
        if take < k:
            outer[rows] = root(sorted_d[:, take]) * (1 - SLACK)
    if not code:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), Lists(near, low, outer)
    return np.concatenate(code), np.concatenate(dist), Lists(near, low, outer)


def reassign(x: np.ndarray, book: np.ndarray, code: np.ndarray, lists: Lists, moved: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray, Lists, np.ndarray]:
    """Nearest entries after entries moved by at most ``moved``: code, squared distance,
    lists of length ``b``, and how long a prefix of the list was needed (its length
    plus one where the outer bound did not hold)."""
    have = lists.near.shape[1]
    filled = lists.near >= 0
    low = np.where(filled, np.maximum(lists.low - moved[lists.near], 0), np.inf)
    outer = np.maximum(lists.outer - (moved.max() if len(moved) else 0), 0)
    best = squared(x, book[code])
    up = root(best) * (1 + SLACK)
    # uncertain entries of the lists are measured; the current one is known
    own = lists.near == code[:, None]
    open_ = filled & ~own & (low <= up[:, None])
    needed = np.where((open_ | own).any(1), have - np.argmax((open_ | own)[:, ::-1], axis=1), 0)
    i, j = np.nonzero(open_)
    d = squared(x[i], book[lists.near[i, j]])
    low[i, j] = root(d) * (1 - SLACK)
    low[own] = (root(best) * (1 - SLACK))[own.any(1)] if own.any() else low[own]
    new_code, new_best = code.copy(), best.copy()
    if len(i):
        # the smallest (distance, entry) of each part that had something measured
        order = np.lexsort((lists.near[i, j], d, i)) if d.dtype != object else np.array(sorted(range(len(i)), key=lambda t: (i[t], d[t], lists.near[i[t], j[t]])))
        first = order[np.concatenate([[True], i[order][1:] != i[order][:-1]])]
        r, e, v = i[first], lists.near[i[first], j[first]], d[first]
        wins = (v < best[r]) | ((v == best[r]) & (e < code[r]))
        new_code[r[wins]], new_best[r[wins]] = e[wins], v[wins]
    fail = outer <= root(new_best) * (1 + SLACK)
    by = np.argsort(low, axis=1, kind="stable")
    kept = Lists(np.take_along_axis(lists.near, by, 1), np.take_along_axis(low, by, 1), outer).resized(b)
    if fail.any():
        new_code[fail], new_best[fail], anew = closest(x[fail], book, b)
        kept.near[fail], kept.low[fail], kept.outer[fail] = anew.near, anew.low, anew.outer
        needed[fail] = have + 1
    return new_code, new_best, kept, needed


def next_b(histogram: dict[int, int], b: int) -> int:
    """The list length after a round whose parts needed so long prefixes: the least
    that suffices for ``SUFFICE`` of the parts whose outer bound held, twice as long
    where it failed for more than the rest."""
    total = sum(histogram.values())
    if not total:
        return b
    if histogram.get(b + 1, 0) > (1 - SUFFICE) * total:
        return min(2 * b, MOST_B)
    inside, goal = 0, SUFFICE * sum(v for k, v in histogram.items() if k <= b)
    for k in range(b + 1):
        inside += histogram.get(k, 0)
        if inside >= goal:
            return min(max(k + 1, LEAST_B), MOST_B)
    return b


def cuts(dims: int) -> list[int]:
    """Where parts begin and end; where ``dims`` does not divide by four, the first
    parts have one component more."""
    size, more = divmod(dims, PARTS)
    return [size * p + min(p, more) for p in range(PARTS + 1)]


def encode(embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` for each vector that can be
    used.

    Rows go whose vector is null, empty, holds null, NaN or infinite components, or
    has another length than most vectors. The first codebook comes from the 256
    smallest ids, equal ids by their vectors, null ids last; with fewer rows it has
    fewer entries. Repeated rows are coded as often as they occur. Null labels are
    one label. Sums beyond a long are null. Other columns are not read.

    A round is one pass over the stored vectors and lists, which writes the next
    ones, and one aggregation of a row a part to one row an entry; codebooks are all
    that the driver holds. The tables of earlier rounds are deleted.
    """
    spark = embeddings.sparkSession
    kind, of = (embeddings.schema[c].dataType.simpleString() for c in (vec_id, label))
    out = f"vec_id {kind}, code string, error long, label_error decimal(38,0), codebooks_sha256 string"
    vectors, dims = integer_vectors(embeddings.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("v")), "v")
    if not dims:
        return spark.createDataFrame([], out).withColumn("label_error", F.col("label_error").cast("long"))
    at = cuts(dims)
    size = F.greatest(F.abs(F.array_max("y").cast("double")), F.abs(F.array_min("y").cast("double")))
    vectors, (largest, n) = materialize_counted(vectors.select("vec_id", "label", "y"), F.max(size), F.count(F.lit(1)))
    if largest < 2**30:  # half the bytes on disk and on the way to Python
        vectors = vectors.withColumn("y", F.col("y").cast("array<int>"))
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "y").limit(ENTRIES).select("y").collect()
    books = [np.array([r.y[a:b] for r in first], dtype=np.int64).reshape(len(first), b - a) for a, b in zip(at, at[1:])]

    state, old, b, moved = vectors, None, 16, None
    numbers = T.StructType([*[vectors.schema[c] for c in ("vec_id", "label", "y")]])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbers) + ", codes array<int>, error long, near binary, low binary, needed array<int>"
    for number in range(ROUNDS + 1):
        done = smaller_batches(state).mapInArrow(_pass(books, moved, at, dims, b), schema)
        done, _ = materialize_counted(done, F.count(F.lit(1)))
        if old is not None:
            discard(old)
        state = old = done
        if number == ROUNDS:
            break
        if number:
            seen = done.select(F.explode("needed").alias("k")).groupBy("k").count().collect()
            b_next = next_b({r["k"]: r["count"] for r in seen}, b)
        else:
            b_next = b
        new = _move(done, books, at, largest * n)
        moved = [root(squared(x, y)) * (1 + SLACK) for x, y in zip(books, new)]
        books, b = new, b_next
    text = ",".join(str(int(v)) for book in books for v in book.ravel())
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    coded = state.select("vec_id", "label", code.alias("code"), "error")
    sums = coded.groupBy(F.col("label").alias("l")).agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error"), F.count_if(F.col("error").isNull()).alias("unknown"))
    sums = sums.select("l", F.when(F.col("unknown") == 0, F.col("label_error")).alias("label_error"))
    sums, _ = materialize_counted(sums, F.count(F.lit(1)))
    texts = ["l"] if of == "string" else []
    return coded.join(maybe_broadcast(sums, 100_000, *texts), F.col("label").eqNullSafe(F.col("l")), "left").select("vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(text.encode()).hexdigest()).alias("codebooks_sha256"))


def _pass(books: list[np.ndarray], moved: list[np.ndarray] | None, at: list[int], dims: int, b: int):
    """The work of a round on batches: new codes, errors and lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            y = matrix(batch.column("y"), dims)
            codes, errors, near, low, need = [], [], [], [], []
            if moved is not None:
                # one row has four lists of equal length: entry numbers, bounds, and the outer bound last
                had_near = np.frombuffer(b"".join(batch.column("near").to_pylist()), np.int16).reshape(n, PARTS, -1)
                had_low = np.frombuffer(b"".join(batch.column("low").to_pylist()), np.float32).reshape(n, PARTS, -1)
                had_code = matrix(batch.column("codes"), PARTS)
            for p, book in enumerate(books):
                x = y[:, at[p] : at[p + 1]]
                if moved is None:
                    code, best, lists = closest(x, book, b)
                    needed = np.zeros(n, np.int64)
                else:
                    bounds = had_low[:, p].astype(np.float64)
                    code, best, lists, needed = reassign(x, book, had_code[:, p].astype(np.int64), Lists(had_near[:, p].astype(np.int64), bounds[:, :-1], bounds[:, -1]), moved[p], b)
                codes.append(code)
                errors.append(best)
                near.append(lists.near.astype(np.int16))
                low.append(np.column_stack([lists.low, lists.outer]))
                need.append(needed)
            error = sum(e.astype(object) for e in errors)
            lists4 = lambda cols: pa.FixedSizeListArray.from_arrays(pa.array(np.column_stack(cols).astype(np.int32).ravel()), PARTS).cast(pa.list_(pa.int32()))
            bound = (np.stack(low, 1) * (1 - SHORT)).astype(np.float32)
            blob = lambda a: pa.array([r.tobytes() for r in a], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), batch.column("y"), lists4(codes), pa.array([int(e) if e < 1 << 63 else None for e in error], pa.int64()), blob(np.stack(near, 1)), blob(bound), lists4(need)],
                ["vec_id", "label", "y", "codes", "error", "near", "low", "needed"],
            )

    return run


def _move(done: DataFrame, books: list[np.ndarray], at: list[int], bound: float) -> list[np.ndarray]:
    """Every entry replaced by the floor of its parts' mean; unused ones stay. Sums are
    longs where ``bound`` says that they fit."""
    number = "long" if bound < 2**61 else "decimal(38,0)"
    width = max(b - a for a, b in zip(at, at[1:]))
    parts = F.array(*[F.struct(F.lit(p).alias("part"), F.get("codes", F.lit(p)).alias("entry"), F.slice("y", at[p] + 1, max(at[p + 1] - at[p], 0)).alias("x")) for p in range(PARTS)])
    sums = done.select(F.explode(parts).alias("q")).groupBy("q.part", "q.entry").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.get("q.x", F.lit(i)).cast(number)).alias(f"s{i}") for i in range(width)])
    new = [b.copy() for b in books]
    for r in sums.collect():
        new[r.part][r.entry] = [int(r[f"s{i}"]) // r.n for i in range(new[r.part].shape[1])]
    return new
