"""k-means whose result does not depend on partitioning, task order or machine.

Coordinates are rounded to a grid of 2^-24, so they are whole numbers. As long as vectors are at most LONGEST long, every
product and partial sum in a distance stays below 2^53 in size and is exact in double precision, in whatever order a
matrix library adds; sums of coordinates are 64-bit integers. Equal data therefore give equal clusters to the last bit.

Starts are chosen as k-means|| does, in a few passes that each add a share of the centres, far points more likely than near
ones. Instead of drawing random numbers, each point runs a race: it needs the time -ln(u) / d^2, u being a hash of its
id, the start's seed and the pass, and d its distance from the centres so far. The first ones home are the next centres,
which draws them in proportion to d^2, without replacement, and alike on every run.

Scale: vectors are written down once, packed as integers, and all starts share each pass over them: the distances of a slice
from the centres of all starts are one matrix product, and so are their sums by cluster. A task sends one row per start and
cluster (its sums) or per start and drawn centre (ids only), so what is shuffled grows with the tasks and not with the
vectors. Centres of as many starts as fit in CENTERS_BYTES travel to the tasks together.
"""

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadsift.session import written

#: Steps of the grid in a unit; the greatest length of a vector for which all arithmetic is exact.
GRID = 1 << 24
LONGEST = 4.0
#: Passes that add centres after the first; up to so many clusters more each pass adds one.
PASSES = 8
#: Centres sent to every task at a time, and distances that a task computes at a time.
CENTERS_BYTES = 128 << 20
DISTANCES = 1 << 20
#: Vectors packed at a time.
ROWS = 1024
#: Squared distances are added in two parts, so that sums of very many stay within 64 bits.
LOW_BITS = 26

# The constants of the splitmix64 mixing function.
_STEP, _FIRST, _SECOND = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


@dataclass(frozen=True)
class Model:
    """Centres on the grid (a row each, whole numbers), the cost in squared grid steps, and the start it came from."""

    centers: np.ndarray
    cost: int
    seed: int


def mixed(values: np.ndarray) -> np.ndarray:
    """splitmix64 of 64-bit numbers."""
    z = values.astype(np.uint64) + np.uint64(_STEP)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(_FIRST)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(_SECOND)
    return z ^ (z >> np.uint64(31))


def salt(seed: int, number: int) -> int:
    """What tells the draws of a start's pass from all others."""
    return int(mixed(np.array([(seed << 32) + number], np.uint64))[0])


def drawn(ids: np.ndarray, seed: int, number: int) -> np.ndarray:
    """A number in (0, 1) per id."""
    bits = mixed(mixed(ids.astype(np.int64).view(np.uint64)) ^ np.uint64(salt(seed, number)))
    return ((bits >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def _coordinates(features: pa.Array) -> np.ndarray:
    """A row per vector, given as arrays of one size or as ML vectors, sparse or dense."""
    if not pa.types.is_struct(features.type):
        return features.flatten().to_numpy(zero_copy_only=False).reshape(len(features), -1).astype(np.float64)
    values, sparse = features.field("values"), features.field("type").to_numpy(zero_copy_only=False) == 0
    sizes = np.diff(values.offsets.to_numpy())
    row = np.repeat(np.arange(len(features)), sizes)
    column = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)  # of a dense vector
    column[sparse[row]] = features.field("indices").flatten().to_numpy(zero_copy_only=False)
    width = features.field("size")[int(sparse.argmax())].as_py() if sparse.any() else sizes[0]
    points = np.zeros((len(features), width))
    points[row, column] = values.flatten().to_numpy(zero_copy_only=False)
    return points


def _on_grid(points: np.ndarray) -> np.ndarray:
    return np.floor(points * GRID + 0.5)


PACKED = "id bigint, squared double, point binary"


def packed(vectors: DataFrame) -> DataFrame:
    """id, squared length and coordinates on the grid (32-bit integers, packed) per vector; packed vectors stay as they are.

    Of a vector that is too long only the length is of use.
    """
    if "point" in vectors.columns:
        return vectors

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                points = _coordinates(part.column(1))
                squared = (points * points).sum(axis=1)
                points[~(squared <= LONGEST**2)] = 0
                grid = _on_grid(points).astype("<i4")
                offsets = np.arange(len(grid) + 1, dtype=np.int32) * np.int32(4 * grid.shape[1])
                point = pa.Array.from_buffers(pa.binary(), len(grid), [None, pa.py_buffer(offsets), pa.py_buffer(grid.tobytes())])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(squared), point], names=["id", "squared", "point"])

    return vectors.select(F.col("id").cast("bigint").alias("id"), "features").mapInArrow(pack, PACKED)


def _grid(points: pa.Array) -> np.ndarray:
    """Packed points as a matrix."""
    _, offsets, data = points.buffers()
    bounds = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(points.type) else np.int32)
    first, last = bounds[points.offset], bounds[points.offset + len(points)]
    return np.frombuffer(data, "<i4", (last - first) // 4, first).reshape(len(points), -1)


def _sliced(batch: pa.RecordBatch, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, coordinates on the grid) in slices for which ``width`` distances each stay within DISTANCES."""
    if not batch.num_rows:
        return
    names, ids = batch.schema.names, batch.column("id").to_numpy()
    points = _grid(batch.column("point")) if "point" in names else None
    dimensions = len(batch.column("features")[0]) if points is None else points.shape[1]
    rows = max(1, DISTANCES // max(1, width, dimensions))
    for start in range(0, len(ids), rows):
        part = _on_grid(_coordinates(batch.column("features").slice(start, rows))) if points is None else points[start : start + rows]
        yield ids[start : start + rows], part.astype(np.float64)


def _points(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        yield from _sliced(batch, width)


def _squared(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances (points, centres); whole numbers, exact in double precision."""
    distances = points @ centers.T
    distances *= -2
    distances += np.einsum("ij,ij->i", points, points)[:, None] + np.einsum("ij,ij->i", centers, centers)[None, :]
    return distances


def _stacked(centers: dict[int, np.ndarray]) -> tuple[np.ndarray, dict[int, slice]]:
    """The centres of all starts as one matrix, and the rows of each start."""
    ends = np.cumsum([len(own) for own in centers.values()])
    return np.concatenate(list(centers.values())), {seed: slice(end - len(own), end) for (seed, own), end in zip(centers.items(), ends)}


def _first_home(vectors: DataFrame, centers: dict[int, np.ndarray], number: int, wanted: int) -> dict[int, np.ndarray]:
    """For each start the points on the grid that win the next places."""
    shared = vectors.sparkSession.sparkContext.broadcast(centers)

    def race(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {seed: (np.zeros(0), np.zeros(0, np.int64)) for seed in shared.value}
        stack, rows = _stacked(shared.value)
        for ids, points in _points(batches, len(stack)):
            squared = _squared(points, stack) if len(stack) else None
            for seed, own in rows.items():
                far = np.ones(len(ids)) if squared is None else squared[:, own].min(axis=1)
                runs = far > 0
                times = np.concatenate([best[seed][0], -np.log(drawn(ids[runs], seed, number)) / far[runs]])
                runners = np.concatenate([best[seed][1], ids[runs]])
                order = np.lexsort((runners, times))[:wanted]
                best[seed] = times[order], runners[order]
        for seed, (times, runners) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(times), seed)), pa.array(times), pa.array(runners)], names=["seed", "time", "id"])

    times = vectors.select("id", "point").mapInArrow(race, "seed bigint, time double, id bigint")
    place = F.row_number().over(Window.partitionBy("seed").orderBy("time", "id"))
    home = times.withColumn("place", place).filter(F.col("place") <= wanted).select("seed", "place", "id").collect()
    if not home:
        return {}
    winners = vectors.sparkSession.createDataFrame(sorted({(row["id"],) for row in home}), "id bigint")
    rows = vectors.join(F.broadcast(winners), "id").select("id", "point").collect()  # as many as centres are drawn
    at = {row["id"]: np.frombuffer(row["point"], "<i4").astype(np.float64) for row in rows}
    found: dict[int, list[np.ndarray]] = {}
    for row in sorted(home, key=lambda row: row["place"]):
        found.setdefault(row["seed"], []).append(at[row["id"]])
    return {seed: np.stack(points) for seed, points in found.items()}


def starting_centers(vectors: DataFrame, k: int, seeds: Sequence[int]) -> dict[int, np.ndarray]:
    """For each seed up to k distinct points on the grid; fewer only if there are not so many."""
    vectors = packed(vectors)
    centers = _first_home(vectors, {seed: np.zeros((0, 0)) for seed in seeds}, 0, 1)
    a_pass, number = -(-(k - 1) // PASSES), 0
    while centers and any(len(own) < k for own in centers.values()):
        number += 1
        left = k - max(len(own) for own in centers.values())
        added = _first_home(vectors, {seed: own for seed, own in centers.items() if len(own) < k}, number, max(1, min(a_pass, left)))
        if not added:
            break
        # Points that win together may be alike; one of them is enough.
        centers |= {seed: _distinct(np.concatenate([centers[seed], points])) for seed, points in added.items()}
    return centers


def _distinct(points: np.ndarray) -> np.ndarray:
    _, firsts = np.unique(points, axis=0, return_index=True)
    return points[np.sort(firsts)]


def _merged(rows: pa.Table) -> pa.Table:
    """The partial sums of one start and cluster, added."""
    sums = rows.column("sums").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1).sum(axis=0)
    numbers = [pa.array([int(np.sum(rows.column(name).to_numpy(), dtype=np.int64))]) for name in ("n", "high", "low")]
    return pa.Table.from_arrays([rows.column("seed").slice(0, 1), rows.column("cluster").slice(0, 1), *numbers, pa.array([sums.tolist()], pa.list_(pa.int64()))], names=["seed", "cluster", "n", "high", "low", "sums"])


SUMS = "seed bigint, cluster int, n bigint, high bigint, low bigint, sums array<bigint>"


def _step(vectors: DataFrame, centers: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, int]]:
    """For each start its centres after one Lloyd step, and the cost before it."""
    shared = vectors.sparkSession.sparkContext.broadcast(centers)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack, rows = _stacked(shared.value)
        total, numbers = np.zeros(stack.shape, np.int64), np.zeros((3, len(stack)), np.int64)
        for _, points in _points(batches, len(stack)):
            squared, each = _squared(points, stack), np.arange(len(points))
            member = np.zeros_like(squared)
            for own in rows.values():
                nearest = own.start + squared[:, own].argmin(axis=1)  # the first of equally near ones
                member[each, nearest] = 1
                costs = squared[each, nearest].astype(np.int64)
                for at, parts in enumerate((None, costs >> LOW_BITS, costs & ((1 << LOW_BITS) - 1))):
                    numbers[at] += np.bincount(nearest, parts, len(stack)).astype(np.int64)
            total += (member.T @ points).astype(np.int64)  # whole numbers below 2^53 in size
        for seed, own in rows.items():
            used = np.flatnonzero(numbers[0][own])
            columns = [pa.array(np.full(len(used), seed)), pa.array(used.astype(np.int32)), *(pa.array(row[own][used]) for row in numbers), pa.array(total[own][used].tolist(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["seed", "cluster", "n", "high", "low", "sums"])

    merged = vectors.select("id", "point").mapInArrow(assign, SUMS).groupBy("seed", "cluster").applyInArrow(_merged, SUMS).collect()  # a row per centre
    result = {seed: [own.copy(), 0] for seed, own in centers.items()}
    for row in merged:
        total, n = np.array(row["sums"], np.int64), row["n"]
        result[row["seed"]][0][row["cluster"]] = (2 * total + n) // (2 * n)  # the mean, rounded to the grid
        result[row["seed"]][1] += (row["high"] << LOW_BITS) + row["low"]
    return {seed: (moved, cost) for seed, (moved, cost) in result.items()}


def fit(vectors: DataFrame, k: int, seeds: Sequence[int], max_iter: int = 20) -> Model | None:
    """The cheapest of one run per seed over ``vectors`` (id bigint, features array<double>), the lower seed of equally cheap
    ones; None without vectors. Ids tell the vectors apart. A cluster that loses all its points keeps its centre. Vectors that
    are not ``packed`` yet are packed and written down."""
    vectors = vectors if "point" in vectors.columns else written(packed(vectors))
    longest = vectors.agg(F.max("squared")).first()[0]
    if longest is None:
        return None
    if not longest <= LONGEST**2:
        raise ValueError(f"vectors must be at most {LONGEST} long")
    dimensions = vectors.select(F.length("point")).first()[0] // 4
    together = max(1, CENTERS_BYTES // (8 * k * max(1, dimensions)))
    best: Model | None = None
    for first in range(0, len(seeds), together):
        centers = starting_centers(vectors, k, seeds[first : first + together])
        moving = dict(centers)
        for step in range(max_iter + 1):
            after = _step(vectors, moving)
            for seed, (moved, cost) in after.items():
                if step == max_iter or np.array_equal(moved, moving[seed]):
                    if best is None or (cost, seed) < (best.cost, best.seed):
                        best = Model(moving[seed].copy(), cost, seed)
                    del moving[seed]
                else:
                    moving[seed] = moved
            if not moving:
                break
    return best


def assigned(vectors: DataFrame, model: Model) -> DataFrame:
    """id, cluster (the nearest centre, the first of equally near ones) and, if there are any, features per vector."""
    shared = vectors.sparkSession.sparkContext.broadcast(model.centers)
    kept = [name for name in ("features",) if name in vectors.columns]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [_squared(points, shared.value).argmin(axis=1) for _, points in _sliced(batch, len(shared.value))]
            clusters = np.concatenate([*parts, np.zeros(0, np.int64)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(clusters), *map(batch.column, kept)], names=["id", "cluster", *kept])

    given = vectors.select("id", *(name for name in ("features", "point") if name in vectors.columns))
    return given.mapInArrow(assign, "id bigint, cluster int" + ", features array<double>" * len(kept))
