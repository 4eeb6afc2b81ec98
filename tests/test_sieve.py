"""Sieve and regions against a plain flood fill."""

import random

import numpy as np

from scoria.operators.sieve import label, regions, sieve_grid


def flood(grid):
    out, seen = np.full(grid.shape, -1), 0
    for start in np.ndindex(grid.shape):
        if out[start] >= 0:
            continue
        name, todo = start[0] * grid.shape[1] + start[1], [start]
        while todo:
            r, c = todo.pop()
            if 0 <= r < grid.shape[0] and 0 <= c < grid.shape[1] and out[r, c] < 0 and grid[r, c] == grid[start]:
                out[r, c], seen = name, seen + 1
                todo += [(r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)]
    return out


def test_labels_and_sieve():
    r = random.Random(1)
    for k in range(60):
        h, w = r.randint(1, 9), r.randint(1, 9)
        grid = np.array([[r.choice([41, 21, 71]) for _ in range(w)] for _ in range(h)])
        assert (label(grid) == flood(grid)).all()
        out = sieve_grid(grid, 4)
        counts = np.unique(label(out), return_counts=True)[1]
        assert counts.min() >= 4 or len(counts) == 1
    snake = np.array([[1, 0, 1, 1, 1], [1, 0, 1, 0, 1], [1, 1, 1, 0, 1]])
    assert (label(snake) == flood(snake)).all()


def test_regions(spark):
    rows = [(1, i // 3, i % 3, v) for i, v in enumerate([5, 5, 7, 5, 7, 7, 5, 5, 5])]
    got = sorted((r["region"], r["v"], r["pixels"], r["sides"]) for r in regions(spark.createDataFrame(rows, "id bigint, r int, c int, v int")).collect())
    assert got == [(0, 5, 6, 14), (2, 7, 3, 8)]
