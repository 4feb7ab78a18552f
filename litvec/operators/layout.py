"""Points in the plane that keep neighbours together: a neighbour graph that pulls, and a grid that pushes.

The method is that of stochastic neighbour embedding with the far field summed up: every point is pulled by its
nearest neighbours, weighed by a width fitted per point, and pushed by the cells of a grid, each as one heavy
point. Neither all pairs nor all points meet anywhere. Rounds go on until the layout has settled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litvec.operators.blocks import BLOCK_BYTES, knn_joined
from litvec.operators.projection import project_2d
from litvec.runtime import BROADCAST_ROWS, drop, stage, staged

# Rounds end once settled; the bound is the one of the reference's solver.
NEIGHBOURS, ROUNDS = 15, 1000
# Settled: over so many rounds the cost falls by less than this share of it.
WINDOW, SETTLED = 25, 0.005
# Weights are exaggerated in the first rounds, so that groups find together before they spread.
EARLY, EARLY_ROUNDS, EXAGGERATED = 0.3, 30, 4.0
# Steps grow by an addend where they go on in one direction and shrink by a factor where they turn, down to the least.
LONGER, SHORTER, SHORTEST = 0.3, 0.8, 0.3
# A cell's points count as one place, so cells are at most half as wide as the push reaches, and a side has 32 of them
# at least. Only a side of more than GRID has wider ones: the driver holds the grid. It covers all points but a TAIL at
# either end, and as far again as half of that; cells beyond push one by one.
CELL, LEAST, GRID, TAIL = 0.5, 32, 1024, 0.01
_BISECTIONS = 40
# Points that meet all cells of the grid at a time, and cells that do so; the push of more is read off a field.
_PUSHED, _CELLS = 512, 1024


def neighbour_weights(distances: np.ndarray) -> np.ndarray:
    """Weights of one point's neighbours: a bell curve whose width gives them an effective number of a third of theirs.

    Weights sum to one. Equal distances, zeros too, give equal weights.
    """
    squares = np.asarray(distances, dtype=np.float64) ** 2
    n = len(squares)
    if n < 2:
        return np.ones(n)
    squares = squares - squares.min()
    scale = squares.mean()
    if scale <= 0:
        return np.full(n, 1 / n)
    squares, target = squares / scale, np.log(max(n / 3, 1.0 + 1e-9))
    low, high, beta = 0.0, np.inf, 1.0
    for _ in range(_BISECTIONS):
        w = np.exp(-beta * squares)
        share = w / w.sum()
        entropy = -(share * np.log(np.maximum(share, 1e-300))).sum()
        low, high = (beta, high) if entropy > target else (low, beta)
        beta = beta * 2 if np.isinf(high) else (low + high) / 2
    return share


def neighbour_graph(
    vectors: DataFrame,
    neighbours: int = NEIGHBOURS,
    id_col: str = "id",
    vector_col: str = "vector",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Edges ``a, b, weight`` of both directions between points and their nearest ones; all weights sum to one.

    ``weight`` is half of what either gives the other, divided by the number of points. Ids must be unique.
    """
    asked = vectors.select(F.col(id_col).cast("long").alias("query_id"), F.col(vector_col).alias("vector"))
    near = knn_joined(vectors, asked, neighbours + 1, "L2", id_col=id_col, vector_col=vector_col, block_bytes=block_bytes)
    others = near.where("id <> query_id").groupBy(F.col("query_id").alias("a"))
    lists = others.agg(F.slice(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))), 1, neighbours).alias("near"))

    @F.arrow_udf("array<double>")
    def weights(distances: pa.Array) -> pa.Array:
        return pa.array([neighbour_weights(np.array(d)) for d in distances.to_pylist()], pa.list_(pa.float64()))

    given = stage(lists.select("a", F.col("near.id").alias("b"), weights("near.score").alias("w")), "neighbours")
    points = given.count()
    one_way = given.select("a", F.inline(F.arrays_zip("b", "w"))).select("a", "b", (F.col("w") / (2 * max(points, 1))).alias("w"))
    return one_way.union(one_way.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).groupBy("a", "b").agg(F.sum("w").alias("weight"))


def _pulled(edges: DataFrame, at: DataFrame, side: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``at`` with the pull of a point's neighbours and its share of the cost, ``px, py, cost``. ``edges`` has every point."""
    own = at.drop("cost")
    other = at.select(F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
    met = edges.withColumnRenamed("a", "id").join(side(own), "id").join(side(other), "b")
    dx, dy = F.col("bx") - F.col("x"), F.col("by") - F.col("y")
    far = 1 + dx * dx + dy * dy
    q = F.col("weight") / far
    sums = F.sum(q * dx).alias("px"), F.sum(q * dy).alias("py"), F.sum(F.col("weight") * F.log(far)).alias("cost")
    return met.groupBy(*own.columns).agg(*sums)


def _width(extent: float, grid: int) -> float:
    """Width of the cells: a power of two, as plans are compiled anew for other numbers."""
    if extent > grid * CELL:
        return 2.0 ** np.ceil(np.log2(extent / grid))
    return 2.0 ** np.floor(np.log2(min(CELL, max(extent, 1e-12) / LEAST)))


def _middle(cells: np.ndarray) -> np.ndarray:
    """The corners of what all cells cover, without what lies far from nearly all points: two rows."""
    corners = []
    for places in cells[:, 1:].T:
        order = np.argsort(places)
        below = np.cumsum(cells[order, 0]) / cells[:, 0].sum()
        low, high = (places[order[np.searchsorted(below, share)]] for share in (TAIL, 1 - TAIL))
        reach = max((high - low) / 2, np.ptp(places) / GRID)
        corners.append((max(places.min(), low - reach), min(places.max(), high + reach)))
    return np.array(corners).T


def _cells(at: DataFrame, extent: float, grid: int) -> tuple[np.ndarray, float, float, float]:
    """Number and mean place of the points in every cell that has any, at most ``grid**2`` rows.

    Beyond the middle (``_middle``), there may be more, a row per point at most. Besides, the width of the cells, the
    larger side of the middle, and the sum of ``cost``. ``extent`` is what that side may be.
    """
    while True:
        width = float(_width(extent, grid))
        cells = at.groupBy(F.floor(F.col("x") / width).alias("cx"), F.floor(F.col("y") / width).alias("cy"))
        found = cells.agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"), F.sum("cost").alias("cost")).toArrow()
        rows = np.stack([found[c].to_numpy().astype(np.float64) for c in ("n", "x", "y")], 1)
        extent = float(np.ptp(_middle(rows), axis=0).max())
        if not extent > grid * width:
            return rows, width, extent, float(found["cost"].to_numpy().sum())


def _near(x: np.ndarray, y: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    dx, dy = x[:, None] - cells[:, 1], y[:, None] - cells[:, 2]
    return dx, dy, 1 / (1 + dx * dx + dy * dy)


def _push(x: np.ndarray, y: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The push of all cells on points, before it is divided by ``_all_pairs``."""
    ux, uy = np.empty(len(x)), np.empty(len(x))
    for a in range(0, len(x), _PUSHED):
        some = slice(a, a + _PUSHED)
        dx, dy, q = _near(x[some], y[some], cells)
        heavy = q * q * cells[:, 0]
        ux[some], uy[some] = (heavy * dx).sum(1), (heavy * dy).sum(1)
    return ux, uy


def _all_pairs(cells: np.ndarray) -> float:
    """The nearness of all pairs of points, the points of a cell taken as one place."""
    n = cells[:, 0]
    return max(float(n @ _near(cells[:, 1], cells[:, 2], cells)[2] @ n - n.sum()), 1e-12)


def _nodes(x: np.ndarray, y: np.ndarray, width: float, low: np.ndarray, shape: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The 16 nodes of the grid around each place, as numbers, with their shares in cubic interpolation."""

    def shares(at: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        node = np.floor(at / width)
        t = at / width - node
        return node.astype(np.int64), [t * (1 - t) * (t - 2) / 6, (t + 1) * (t - 1) * (t - 2) / 2, (t + 1) * t * (2 - t) / 2, (t + 1) * t * (t - 1) / 6]

    (cx, wx), (cy, wy) = shares(x), shares(y)
    for i in range(4):
        for j in range(4):
            yield (cx - low[0] + i - 1) * shape[1] + cy - low[1] + j - 1, wx[i] * wy[j]


def _field(cells: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """First node, shape and values of a grid that has the push of all cells, undivided, and the nearness of all pairs.

    What the cells weigh is dealt to the nodes around them; each sum over nodes is a convolution. Single precision, as
    the driver holds grids of four times the nodes.
    """
    n, x, y = cells.T
    first, last = (np.floor(f(cells[:, 1:], axis=0) / width).astype(np.int64) for f in (np.min, np.max))
    low, shape = first - 2, last - first + 6
    mass = np.zeros(shape.prod())
    for node, share in _nodes(x, y, width, low, shape):
        mass += np.bincount(node, share * n, len(mass))
    mass = mass.reshape(shape)
    sides = [-(-2 * int(s) // 64) * 64 for s in shape]
    dx, dy = (np.float32(width) * (np.fft.fftfreq(s) * s).astype(np.float32) for s in sides)
    q = 1 / (1 + dx[:, None] ** 2 + dy**2)
    waves = np.fft.rfft2(mass.astype(np.float32), sides)

    def summed(near: np.ndarray) -> np.ndarray:
        return np.fft.irfft2(waves * np.fft.rfft2(near), sides)[: shape[0], : shape[1]]

    pairs = max(float((summed(q) * mass).sum() - n.sum()), 1e-12)
    q *= q
    values = np.stack([summed(q * dx[:, None]), summed(q * dy)]).reshape(2, -1).astype(np.float32)
    return low, shape, values, pairs


def _felt(x: np.ndarray, y: np.ndarray, width: float, low: np.ndarray, shape: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The push that a field has at the points: two rows."""
    push = np.zeros((2, len(x)))
    for node, share in _nodes(x, y, width, low, shape):
        push += share * values[:, node]
    return push


def _coarse(cells: np.ndarray, width: float) -> np.ndarray:
    """Cells merged into ones of twice the width until ``_CELLS`` or fewer are left."""
    while len(cells) > _CELLS:
        width *= 2
        own = np.unique(np.floor(cells[:, 1:] / width), axis=0, return_inverse=True)[1].reshape(-1)
        n = np.bincount(own, cells[:, 0])
        cells = np.stack([n, *(np.bincount(own, cells[:, 0] * cells[:, i]) / n for i in (1, 2))], 1)
    return cells


def _pushing(cells: np.ndarray, width: float) -> tuple[tuple, float]:
    """What ``_pushed`` needs of all cells, and the nearness of all pairs of points."""
    if len(cells) <= _CELLS:
        return (cells,), _all_pairs(cells)
    node, (first, last) = np.floor(cells[:, 1:] / width), np.floor(_middle(cells) / width)
    inside = ((first <= node) & (node <= last)).all(1)
    low, shape, values, pairs = _field(cells[inside], width)
    near, beyond = _coarse(cells[inside], width), _coarse(cells[~inside], width)
    if len(beyond):
        pairs += 2 * float(near[:, 0] @ _near(near[:, 1], near[:, 2], beyond)[2] @ beyond[:, 0]) + _all_pairs(beyond)
    return (near, beyond, width, low, shape, values), pairs


def _pushed(x: np.ndarray, y: np.ndarray, cells: np.ndarray, *field) -> np.ndarray:
    """The push of all cells on points, two rows, before it is divided by the nearness of all pairs."""
    if not field:
        return np.stack(_push(x, y, cells))
    beyond, width, low, shape, values = field
    node = np.floor(np.stack([x, y], 1) / width) - low
    inside = ((node >= 2) & (node < shape - 3)).all(1)
    push = np.empty((2, len(x)))
    push[:, inside] = _felt(x[inside], y[inside], width, low, shape, values)
    push[:, ~inside] = _push(x[~inside], y[~inside], cells)
    return push + _push(x, y, beyond) if len(beyond) else push


def _settled(costs: list[float]) -> bool:
    """Whether the last ``WINDOW`` costs have hardly come below the least one before them."""
    if len(costs) <= WINDOW:
        return False
    before = min(costs[:-WINDOW])
    return before - min(costs[-WINDOW:]) <= SETTLED * abs(before)


def neighbour_layout(
    vectors: DataFrame,
    label: str = "label",
    neighbours: int = NEIGHBOURS,
    rounds: int = ROUNDS,
    grid: int = GRID,
    id_col: str = "id",
    vector_col: str = "vector",
) -> DataFrame:
    """``id, x, y, label, code`` like ``projection.project_2d``, placed so that neighbours stay neighbours.

    Starts from the principal components. Every round reads the staged places and edges and writes the places
    anew; the driver sees a row per cell of the grid. Rounds end once the cost, the divergence between weights and places,
    has settled; ``rounds`` and ``grid`` are bounds. Vectors that are null or no numbers have to be left out
    before. With two points or fewer the start is the result.
    """
    spark = vectors.sparkSession
    start = stage(project_2d(vectors, id_col, label, vector_col), "layout-start")
    of_axes = [f(c).alias(f"{name}{c}") for c in "xy" for name, f in (("mid", F.avg), ("min", F.min), ("max", F.max))]
    spread_of = start.agg(F.stddev_pop("x").alias("sx"), F.count("*").alias("n"), *of_axes).first()
    if spread_of["n"] <= 2:
        return start
    points = spread_of["n"]
    unit = 1e-2 / (spread_of["sx"] or 1.0)
    extent = unit * max(spread_of[f"max{c}"] - spread_of[f"min{c}"] for c in "xy")
    own = F.col(id_col).cast("long")
    itself = start.select(own.alias("a"), own.alias("b"), F.lit(0.0).alias("weight"))
    edges = stage(neighbour_graph(vectors, neighbours, id_col, vector_col).union(itself), "layout-edges")
    entropy = edges.where("weight > 0").agg(F.sum(F.col("weight") * F.log("weight"))).first()[0] or 0.0
    side = F.broadcast if points <= BROADCAST_ROWS else (lambda df: df)  # an id and up to six numbers a row
    placed = start.select(own.alias("id"), *(((F.col(c) - spread_of[f"mid{c}"]) * unit).alias(c) for c in "xy"))
    steps = {f"{name}{c}": F.lit(value) for name, value in (("v", 0.0), ("g", 1.0)) for c in "xy"}
    at, path = staged(placed.withColumns(steps | {"cost": F.lit(0.0)}), "places")
    columns = at.columns
    early, costs, pairs = min(EARLY * rounds, EARLY_ROUNDS), [], 1.0
    for turn in range(rounds):
        cells, width, extent, cost = _cells(at, extent, grid)
        if turn > early:  # the places have the cost of the round before
            costs.append(entropy + cost + np.log(pairs))
            if _settled(costs):
                break
        strength, inertia = (EXAGGERATED, 0.5) if turn < early else (1.0, 0.8)
        field, pairs = _pushing(cells, width)
        sent = spark.sparkContext.broadcast(field)

        def moved(batches: Iterator[pa.RecordBatch], sent=sent, pairs=pairs, strength=strength, inertia=inertia) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                of = {name: batch[name].to_numpy(zero_copy_only=False) for name in batch.schema.names}
                for axis, u in zip("xy", _pushed(of["x"], of["y"], *sent.value)):
                    # Steps in proportion to the number of points, as weights are shares of all.
                    force = strength * of[f"p{axis}"] + u / pairs
                    gain = np.where(force * of[f"v{axis}"] > 0, of[f"g{axis}"] + LONGER, of[f"g{axis}"] * SHORTER)
                    of[f"g{axis}"] = np.maximum(gain, SHORTEST)
                    of[f"v{axis}"] = inertia * of[f"v{axis}"] + points * of[f"g{axis}"] * force
                    of[axis] = of[axis] + of[f"v{axis}"]
                yield pa.RecordBatch.from_arrays([pa.array(of[name]) for name in columns], columns)

        before = path
        at, path = staged(_pulled(edges, at, side).mapInArrow(moved, at.schema), "places")
        sent.destroy()
        drop(spark, before)
    rest = [c for c in start.columns if c not in ("x", "y")]
    return at.select(F.col("id").alias(id_col), "x", "y").join(start.select(*rest), id_col)
