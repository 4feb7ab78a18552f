"""Neighbours kept in the plane, against a version that compares all pairs."""

import tracemalloc

import numpy as np
import pytest

from checks.queries import QUERIES
from litvec.operators import layout, projection


def clustered(n, groups, dim, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim)) * 3
    own = rng.integers(groups, size=n)
    return centres[own] + rng.normal(size=(n, dim)) * 0.8, own


def kept(vectors, places, k=10):
    """Share of the nearest neighbours that are nearest in the plane too."""

    def nearest(m):
        d = np.linalg.norm(m[:, None] - m[None], axis=2)
        np.fill_diagonal(d, np.inf)
        return np.argsort(d, axis=1)[:, :k]

    return np.mean([len(set(a) & set(b)) / k for a, b in zip(nearest(vectors), nearest(places))])


def dense(vectors, start, rounds, neighbours):
    n = len(vectors)
    d = np.linalg.norm(vectors[:, None] - vectors[None], axis=2)
    w = np.zeros((n, n))
    for i in range(n):
        near = [j for j in np.lexsort((np.arange(n), d[i])) if j != i][:neighbours]
        w[i, near] = layout.neighbour_weights(d[i, near])
    w = (w + w.T) / (2 * n)
    p = start / start[:, 0].std() * 1e-2
    v = np.zeros_like(p)
    for turn in range(rounds):
        strength, inertia = (4.0, 0.5) if turn < 0.3 * rounds else (1.0, 0.8)
        gap = p[:, None] - p[None]
        q = 1 / (1 + (gap**2).sum(2))
        np.fill_diagonal(q, 0)
        pull, push = -((w * q)[:, :, None] * gap).sum(1), ((q * q)[:, :, None] * gap).sum(1) / q.sum()
        v = inertia * v + n * (strength * pull + push)
        p = p + v
    return p


def test_neighbours_stay_together(spark):
    vectors, own = clustered(250, 8, 10)
    df = spark.createDataFrame([(i, v.tolist(), int(g)) for i, (v, g) in enumerate(zip(vectors, own))], "id long, vector array<double>, label int")
    rows = layout.neighbour_layout(df, neighbours=12, rounds=20).orderBy("id").collect()
    assert [r.id for r in rows] == list(range(250)) and [r.label for r in rows] == own.tolist()
    places = np.array([[r.x, r.y] for r in rows])
    flat = projection.project_2d(df, "id", "label").orderBy("id").collect()
    start = np.array([[r.x, r.y] for r in flat])
    assert [r.code for r in rows] == [r.code for r in flat]
    share, exact, linear = kept(vectors, places), kept(vectors, dense(vectors, start, 20, 12)), kept(vectors, start)
    assert share > linear + 0.1 and share > exact - 0.05, (share, exact, linear)


def test_graph_has_both_directions_and_weights_of_one(spark):
    vectors, _ = clustered(60, 3, 4)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, vector array<double>")
    edges = {(r.a, r.b): r.weight for r in layout.neighbour_graph(df, 5).collect()}
    assert sum(edges.values()) == pytest.approx(1) and all(edges[b, a] == pytest.approx(w) for (a, b), w in edges.items())
    d = np.linalg.norm(vectors[:, None] - vectors[None], axis=2)
    for a in range(60):
        assert {int(j) for j in np.argsort(d[a])[1:6]} <= {b for x, b in edges if x == a}


def test_widths_give_the_wanted_number_of_neighbours():
    w = layout.neighbour_weights(np.linspace(1, 3, 15))
    assert w.sum() == pytest.approx(1) and (np.diff(w) < 0).all()
    assert np.exp(-(w * np.log(w)).sum()) == pytest.approx(5, abs=0.01)
    assert layout.neighbour_weights([2.0, 2.0]).tolist() == [0.5, 0.5] and layout.neighbour_weights([0.0]).tolist() == [1.0]
    assert layout.neighbour_weights([]).tolist() == []


def test_few_points_and_equal_ones(spark):
    schema = "id long, vector array<double>, label int"
    two = spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [2.0, 1.0], 1)], schema)
    assert layout.neighbour_layout(two).count() == 2
    same = spark.createDataFrame([(i, [1.0, 2.0], 0) for i in range(6)], schema)
    rows = layout.neighbour_layout(same, rounds=2).collect()
    assert len(rows) == 6 and all(np.isfinite([r.x, r.y]).all() for r in rows)


def test_push_of_many_points_takes_bounded_memory():
    rng = np.random.default_rng(3)
    x, y, cells = rng.normal(size=8000), rng.normal(size=8000), rng.uniform(1, 2, size=(1024, 3))
    tracemalloc.start()
    ux, uy = layout._push(x, y, cells)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    dx, dy, q = layout._near(x[:700], y[:700], cells)
    assert ux[:700] == pytest.approx((q * q * cells[:, 0] * dx).sum(1)) and uy[:700] == pytest.approx((q * q * cells[:, 0] * dy).sum(1))
    assert peak < 64 << 20


def divergence(vectors, places, neighbours=layout.NEIGHBOURS):
    """The cost that all pairs give."""
    n = len(vectors)
    d = np.linalg.norm(vectors[:, None] - vectors[None], axis=2)
    w = np.zeros((n, n))
    for i in range(n):
        near = [j for j in np.lexsort((np.arange(n), d[i])) if j != i][:neighbours]
        w[i, near] = layout.neighbour_weights(d[i, near])
    w = (w + w.T) / (2 * n)
    q = 1 / (1 + ((places[:, None] - places[None]) ** 2).sum(2))
    np.fill_diagonal(q, 0)
    return (w[w > 0] * np.log(w[w > 0] * q.sum() / q[w > 0])).sum()


def test_the_query_goes_on_until_the_layout_has_settled(spark, tmp_path):
    vectors, own = clustered(80, 3, 10)
    rows = [(i, v.tolist(), int(g)) for i, (v, g) in enumerate(zip(vectors, own))]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = QUERIES["neighbour_layout"](spark, str(tmp_path)).orderBy("id").collect()
    start = np.array([[r.x, r.y] for r in projection.project_2d(spark.createDataFrame(rows, "id long, vector array<double>, label int"), "id", "label").orderBy("id").collect()])
    ours, few, many = (divergence(vectors, p) for p in (np.array([[r.x, r.y] for r in found]), *(dense(vectors, start, n, layout.NEIGHBOURS) for n in (12, 1000))))
    assert ours < 1.1 * many < few, (ours, many, few)


def test_settled_is_a_small_fall_over_the_whole_window():
    falling = [10 * 0.99**i for i in range(60)]
    assert not layout._settled(falling) and not layout._settled([1.0] * layout.WINDOW)
    assert layout._settled(falling + [falling[-1]] * layout.WINDOW) and layout._settled([0.0] * (layout.WINDOW + 1))


@pytest.mark.parametrize("spread", [0.05, 1, 30])
def test_push_of_a_wide_layout_is_that_of_all_pairs(spark, spread):
    x, y = np.random.default_rng(7).normal(size=(2, 1500)) * spread
    at = spark.createDataFrame([(i, float(a), float(b), 0.5) for i, (a, b) in enumerate(zip(x, y))], "id long, x double, y double, cost double")
    cells, width, extent, cost = layout._cells(at, max(np.ptp(x), np.ptp(y)), layout.GRID)
    assert cells[:, 0].sum() == 1500 and cost == 750 and extent / layout.LEAST >= 0.9 * width
    *field, pairs = layout._field(cells, width)
    dx, dy, q = layout._near(x, y, np.stack([np.ones(1500), x, y], 1))
    wanted = np.stack([(q * q * dx).sum(1), (q * q * dy).sum(1)])
    assert pairs == pytest.approx(q.sum() - 1500, rel=0.02)
    assert np.linalg.norm(layout._felt(x, y, width, *field) - wanted) < 0.1 * np.linalg.norm(wanted)


def test_a_side_has_a_bounded_number_of_cells(spark):
    at = spark.createDataFrame([(0, -700.0, 1.0, 0.0), (1, 900.0, 2.0, 0.0), (2, 901.0, 2.0, 0.0)], "id long, x double, y double, cost double")
    cells, width, extent, _ = layout._cells(at, 1.0, 256)
    assert width == 8 and extent <= 256 * width and cells[:, 0].sum() == 3
    for size in (1e-9, 0.7, 100.0, 1e5):
        assert size / layout._width(size, 256) <= max(256, 2 * layout.LEAST)


def test_places_far_out_do_not_widen_the_cells(spark):
    x, y = np.random.default_rng(7).normal(size=(2, 1500)) * 8
    x[:5], y[3:9] = (3000, -9000, 3000.3, 400, 500), -2500
    at = spark.createDataFrame([(i, float(a), float(b), 0.0) for i, (a, b) in enumerate(zip(x, y))], "id long, x double, y double, cost double")
    cells, width, *_ = layout._cells(at, 100.0, layout.GRID)
    assert width == layout.CELL and len(cells) > layout._CELLS
    field, pairs = layout._pushing(cells, width)
    assert 0 < len(field[1]) < 20
    dx, dy, q = layout._near(x, y, np.stack([np.ones(1500), x, y], 1))
    wanted = np.stack([(q * q * dx).sum(1), (q * q * dy).sum(1)])
    found = layout._pushed(x, y, *field)
    assert pairs == pytest.approx(q.sum() - 1500, rel=0.02)
    assert np.linalg.norm(found - wanted) < 0.1 * np.linalg.norm(wanted)
    assert found[:, 0] == pytest.approx(wanted[:, 0], rel=0.1)
