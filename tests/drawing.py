"""Images for tests."""

import numpy as np

from spotlake.operators.geometry import disk


def beads(size, places, diameters=20, values=1000, dtype=np.uint16):
    out = np.zeros((size, size), dtype=dtype)
    n = len(places)
    diameters = diameters if isinstance(diameters, list) else [diameters] * n
    values = values if isinstance(values, list) else [values] * n
    for (y, x), d, v in zip(places, diameters, values):
        p = disk(d // 2) + [y, x]
        p = p[((p >= 0) & (p < size)).all(axis=1)]
        out[p[:, 0], p[:, 1]] = v
    return out


def chip(rows, cols, diameter=20, row_dist=100, col_dist=100, blanks=(), shift=0, dtype=np.uint16):
    out = np.zeros(((rows + 1) * row_dist, (cols + 1) * col_dist), dtype=dtype)
    for i in range(rows):
        for j in range(cols):
            if (i, j) not in blanks:
                p = disk(diameter // 2) + [(i + 1) * row_dist + shift, (j + 1) * col_dist + shift]
                out[p[:, 0], p[:, 1]] = 1000
    return out
