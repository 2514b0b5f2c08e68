"""Direct NumPy definitions used as references on small volumes."""

from __future__ import annotations

from collections import deque

import numpy as np

STEPS = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]


def slices_frame(spark, volumes, data="data"):
    """Slice rows from {case: array[z, y, x]}."""
    rows = []
    for case, v in volumes.items():
        nz, ny, nx = v.shape
        rows += [(case, z, nx, ny, nz, [float(a) for a in v[z].ravel()]) for z in range(nz)]
    return spark.createDataFrame(rows, f"case_id int, z int, nx int, ny int, nz int, {data} array<double>")


def voxel_frame(spark, volumes, value="hu"):
    from voxloom.sources.tables import to_voxels
    return to_voxels(slices_frame(spark, volumes), value)


def runs_frame(spark, masks):
    from voxloom.operators.runs import to_runs
    return to_runs(voxel_frame(spark, {k: m.astype(float) for k, m in masks.items()}).where("hu > 0"))


def as_masks(voxels, masks):
    """Voxel rows back to arrays shaped like ``masks``."""
    out = {k: np.zeros(m.shape, bool) for k, m in masks.items()}
    for r in voxels.select("case_id", "x", "y", "z").collect():
        assert not out[r.case_id][r.z, r.y, r.x], "voxel reported twice"
        out[r.case_id][r.z, r.y, r.x] = True
    return out


def flood(mask, starts, axes=3):
    seen = np.zeros(mask.shape, bool)
    todo = deque(s for s in starts if mask[s])
    for s in todo:
        seen[s] = True
    while todo:
        z, y, x = todo.popleft()
        for dx, dy, dz in STEPS[:2 * axes]:
            p = (z + dz, y + dy, x + dx)
            if all(0 <= a < n for a, n in zip(p, mask.shape)) and mask[p] and not seen[p]:
                seen[p] = True
                todo.append(p)
    return seen


def labels(mask):
    out = np.full(mask.shape, -1)
    for i, p in enumerate(np.ndindex(mask.shape)):
        if mask[p] and out[p] < 0:
            out[flood(mask, [p])] = i
    return out


def lateral(mask):
    edge = np.zeros(mask.shape, bool)
    edge[:, 0], edge[:, -1], edge[:, :, 0], edge[:, :, -1] = True, True, True, True
    return [tuple(p) for p in np.argwhere(mask & edge)]


def box(mask, m, outside=False):
    """Dilation by a box of half-width m."""
    p = np.pad(mask, m, constant_values=outside)
    out = np.zeros(mask.shape, bool)
    for dz, dy, dx in np.ndindex(2 * m + 1, 2 * m + 1, 2 * m + 1):
        out |= p[dz:dz + mask.shape[0], dy:dy + mask.shape[1], dx:dx + mask.shape[2]]
    return out


def axis_seeds(mask, frac=0.10):
    nz, ny, nx = mask.shape
    r = int(np.float32(frac) * min(nx, ny))
    out = []
    for z in range(nz):
        near = sorted(((x - nx // 2) ** 2 + (y - ny // 2) ** 2, y, x) for y, x in np.argwhere(mask[z]))
        if near and near[0][0] <= r * r:
            out.append((z, near[0][1], near[0][2]))
    return out


def wavefront(hu, vness, hard, roi, seeds, p):
    """Layered growth as sets: what a layer reaches, what of it may stay, what is shut out for good."""
    cells = {tuple(c) for c in np.argwhere(roi).tolist()}
    sure = {c for c in cells if hard[c]}

    def passes(cell, depth):
        return hu[cell] <= min(p.ceiling(depth), p.hu_abs_max) and vness[cell] >= p.vmin

    def around(cell):
        return {(cell[0] + dz, cell[1] + dy, cell[2] + dx) for dx, dy, dz in STEPS}

    layers = [{c for c in map(tuple, seeds) if c in cells and (c in sure or passes(c, 0))}]
    shut, soft, room = set(), 0, int(p.leak_ratio * len(sure)) + p.cap_base
    while layers[-1]:
        taken = set().union(*layers) | shut
        reach = (set().union(*map(around, layers[-1])) & cells) - taken
        layer = {c for c in reach if c in sure or (soft <= room and passes(c, len(layers)))}
        past = [len(x) for x in layers[1:]]
        usual = [*past[-1:], *past[1:5]] if len(past) > 5 else past
        mean = sum(usual) / len(usual) if usual else 0.0
        if len(layer) > p.leak_base and (mean == 0 or len(layer) > p.leak_factor * mean):
            shut |= layer - sure
            layer &= sure
        else:
            soft += len(layer - sure)
        layers.append(layer)
    level = {c: depth for depth, layer in enumerate(layers) for c in layer}
    mask = np.zeros(hu.shape, bool)
    for c in level:
        mask[c] = True
    return mask, level
