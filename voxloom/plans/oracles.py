"""SQL statements of the registered queries, over the driver tables only.

Each statement is self-contained: it embeds the stand-in volume (every embedding is one
8x8 slice) or the stand-in case table, and states the operator's definition directly -
neighbour joins, window frames, recursive floods - independent of how the engine
computes it.
"""

from __future__ import annotations

import math

from voxloom.plans import catalog as Q

S_CTE = """s AS (SELECT label AS case_id, embedding AS e,
  row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS z, count(*) OVER (PARTITION BY label) AS nz FROM embeddings)"""
VOX = S_CTE + """,
vox AS MATERIALIZED (SELECT case_id, CAST(p % 8 AS INT) AS x, CAST(p // 8 AS INT) AS y, CAST(z AS INT) AS z, CAST(nz AS INT) AS nz,
  CAST(floor(CAST(e[p + 1] AS DOUBLE) * 400.0) AS INT) - 500 AS hu,
  CAST((CAST(floor(CAST(e[p + 1] AS DOUBLE) * 400.0) AS INT) - 500 + 720) / 512.0 AS FLOAT) AS prob
  FROM (SELECT *, unnest(range(64)) AS p FROM s))"""
TRUTH = "(hu <= -540 AND x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6)"
STEP3 = "(VALUES (1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1)) AS o(dx,dy,dz)"
STEP2 = "(VALUES (1,0,0),(-1,0,0),(0,1,0),(0,-1,0)) AS o(dx,dy,dz)"

SQL: dict[str, str] = {}


def vox(name: str, select: str, *ctes: str, recursive: bool = False) -> None:
    SQL[name] = f"WITH {'RECURSIVE ' if recursive else ''}{VOX}{''.join(', ' + c for c in ctes)} {select}"


def above(thr: float) -> str:
    return f"prob > CAST({thr} AS FLOAT)"


# --- pointwise -------------------------------------------------------------------------------
vox("q_rescale_clamp", "SELECT case_id, x, y, z, least(greatest(hu * 2.0::DOUBLE + 24.0::DOUBLE, -1024.0::DOUBLE), 600.0::DOUBLE) AS v FROM vox")
vox("q_band_filter", "SELECT case_id, x, y, z, hu FROM vox WHERE hu BETWEEN -650 AND -550")
vox("q_hardset", f"SELECT case_id, x, y, z FROM vox WHERE {above(0.4)}")
vox("q_hybrid_candidate", f"SELECT case_id, x, y, z, hu FROM vox WHERE {above(0.5)} OR ({above(0.3)} AND hu BETWEEN -560 AND -520)")
vox("q_normalize", "SELECT case_id, x, y, z, round((hu + 1000.0::DOUBLE) / 1600.0::DOUBLE, 6) AS unit, "
    "CAST(round_even(((hu + 1000.0::DOUBLE) / 1600.0::DOUBLE) * 255.0::DOUBLE, 0) AS INT) AS byte FROM vox")
vox("q_softmax", "SELECT case_id, x, y, z, round(exp(b - greatest(a, b)) / (exp(a - greatest(a, b)) + exp(b - greatest(a, b))), 6) AS prob, "
    "CAST(b > a AS INT) AS class1 FROM (SELECT *, hu / 100.0::DOUBLE AS a, (-1000.0::DOUBLE - hu) / 100.0::DOUBLE AS b FROM vox)")
vox("q_roi_crop", "SELECT case_id, x, y, z, hu FROM vox WHERE x BETWEEN 2 AND 5 AND y BETWEEN 1 AND 6 AND z BETWEEN 3 AND 20")
vox("q_linear_index", "SELECT case_id, x, y, z, CAST(z AS BIGINT) * 64 + y * 8 + x AS idx FROM vox")


# --- masks -----------------------------------------------------------------------------------
def member(name: str, cond: str, dims: str = "nz") -> str:
    return f"{name} AS MATERIALIZED (SELECT case_id, x, y, z, {dims} FROM vox WHERE {cond})"


def grow_box(name: str, of: str, m: int) -> str:
    """Every voxel of the volume with a set voxel within m on all axes."""
    return (f"{name} AS MATERIALIZED (SELECT DISTINCT v.case_id, v.x, v.y, v.z FROM {of} c, range(-{m}, {m} + 1) a(dx), range(-{m}, {m} + 1) b(dy), "
            f"range(-{m}, {m} + 1) d(dz), vox v WHERE v.case_id = c.case_id AND v.x = c.x + a.dx AND v.y = c.y + b.dy AND v.z = c.z + d.dz)")


def shrink_box(name: str, of: str, m: int) -> str:
    """Voxels with no unset voxel of the volume within m on all axes."""
    return (f"{name}_bg AS MATERIALIZED (SELECT v.case_id, v.x, v.y, v.z FROM vox v ANTI JOIN {of} c USING (case_id, x, y, z)), "
            + grow_box(f"{name}_near", f"{name}_bg", m)
            + f", {name} AS MATERIALIZED (SELECT v.case_id, v.x, v.y, v.z FROM vox v ANTI JOIN {name}_near USING (case_id, x, y, z))")


vox("q_dilate", "SELECT * FROM g", member("m", "hu <= -600 AND x <> 3"), grow_box("g", "m", 1))
vox("q_close", "SELECT * FROM k", member("m", "hu <= -570 AND x <> 3"), grow_box("g", "m", 1), shrink_box("k", "g", 1))
vox("q_mask_and", "SELECT m.case_id, m.x, m.y, m.z FROM m SEMI JOIN g USING (case_id, x, y, z)",
    member("m", "hu <= -500"), member("c", "hu <= -620"), grow_box("g", "c", 1))
vox("q_relaxed_envelope", f"SELECT case_id, x, y, z FROM m UNION SELECT case_id, x, y, z FROM vox SEMI JOIN g USING (case_id, x, y, z) WHERE {above(0.45)}",
    member("m", above(0.6)), grow_box("g", "m", 1))
vox("q_upsample", "SELECT c.case_id, CAST(fx AS INT) AS x, CAST(fy AS INT) AS y, CAST(fz AS INT) AS z FROM m c, range(16) a(fx), range(17) b(fy), "
    "(SELECT DISTINCT case_id AS k, unnest(range(2 * nz + 1)) AS fz FROM vox) d "
    "WHERE k = case_id AND least(fx // 2, 7) = c.x AND least(fy // 2, 7) = c.y AND least(fz // 2, nz - 1) = c.z", member("m", "hu <= -600"))


def flood(name: str, start: str, among: str, steps: str = STEP3, extra: str = "") -> str:
    more = f", {extra}" if extra else ""
    pick = f", c.{extra}" if extra else ""
    same = f" AND c.{extra} = r.{extra}" if extra else ""
    return (f"{name}(case_id, x, y, z{more}) AS (SELECT case_id, x, y, z{more} FROM {start} UNION "
            f"SELECT c.case_id, c.x, c.y, c.z{pick} FROM {name} r, {steps}, {among} c "
            f"WHERE c.case_id = r.case_id AND c.x = r.x + o.dx AND c.y = r.y + o.dy AND c.z = r.z + o.dz{same})")


BBOX = ("bb AS MATERIALIZED (SELECT case_id, greatest(min(x) - 1, 0) AS bx0, greatest(min(y) - 1, 0) AS by0, greatest(min(z) - 1, 0) AS bz0, "
        "least(max(x) + 1, 7) AS bx1, least(max(y) + 1, 7) AS by1, least(max(z) + 1, any_value(nz) - 1) AS bz1 FROM vox WHERE hu > -400 GROUP BY case_id)")
WINDOW = ("bx AS MATERIALIZED (SELECT v.case_id, coalesce(bx0, 0) AS bx0, coalesce(by0, 0) AS by0, coalesce(bz0, 0) AS bz0, coalesce(bx1, 7) AS bx1, "
          "coalesce(by1, 7) AS by1, coalesce(bz1, v.nz - 1) AS bz1 FROM (SELECT DISTINCT case_id, nz FROM vox) v LEFT JOIN bb USING (case_id))")
vox("q_body_bbox", "SELECT * FROM bb", BBOX)
vox("q_exterior2d", "SELECT case_id, x, y, z FROM m ANTI JOIN f USING (case_id, x, y, z)", BBOX, WINDOW,
    "m AS MATERIALIZED (SELECT v.* FROM vox v JOIN bx USING (case_id) WHERE hu <= -500 AND x BETWEEN bx0 AND bx1 AND y BETWEEN by0 AND by1 AND z BETWEEN bz0 AND bz1)",
    "e AS MATERIALIZED (SELECT m.* FROM m JOIN bx USING (case_id) WHERE x IN (bx0, bx1) OR y IN (by0, by1))", flood("f", "e", "m", STEP2), recursive=True)
vox("q_exterior3d", "SELECT case_id, x, y, z FROM m ANTI JOIN f USING (case_id, x, y, z)", member("m", "hu <= -530"),
    "e AS MATERIALIZED (SELECT * FROM m WHERE x IN (0, 7) OR y IN (0, 7))", flood("f", "e", "m"), recursive=True)


def label(name: str, among: str, extra: str = "") -> str:
    """Smallest linear index reachable from each voxel, by flooding from every voxel."""
    more, pick, same = (f", {extra}", f", c.{extra}", f" AND c.{extra} = r.{extra}") if extra else ("", "", "")
    return (f"{name}_r(case_id, x, y, z{more}, origin) AS (SELECT case_id, x, y, z{more}, CAST(z AS BIGINT) * 64 + y * 8 + x FROM {among} UNION "
            f"SELECT c.case_id, c.x, c.y, c.z{pick}, r.origin FROM {name}_r r, {STEP3}, {among} c WHERE c.case_id = r.case_id "
            f"AND c.x = r.x + o.dx AND c.y = r.y + o.dy AND c.z = r.z + o.dz{same}), "
            f"{name} AS MATERIALIZED (SELECT case_id, x, y, z{more}, min(origin) AS label FROM {name}_r GROUP BY ALL)")


STATS = ("st AS (SELECT case_id{more}, label, count(*) AS size, sum(x) AS sum_x, sum(y) AS sum_y, sum(z) AS sum_z, min(x) AS min_x, max(x) AS max_x, "
         "min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM lab GROUP BY case_id{more}, label)")
for _name in ("q_components", "q_components_bricks"):
    vox(_name, "SELECT * FROM lab", member("m", "hu <= -550"), label("lab", "m"), recursive=True)
vox("q_component_stats", "SELECT case_id, label, size, CAST(sum_x AS BIGINT) AS sum_x, CAST(sum_y AS BIGINT) AS sum_y, CAST(sum_z AS BIGINT) AS sum_z, "
    "min_x, max_x, min_y, max_y, min_z, max_z FROM st", member("m", "hu <= -550"), label("lab", "m"), STATS.format(more=""), recursive=True)


def tube(window: str) -> str:
    """Scored tube-shaped components; ``window`` gives wx0.. columns per case."""
    p = Q.TUBE
    return (f"tb AS (SELECT *, aspect * sqrt(size::DOUBLE) / (1.0::DOUBLE + 0.05::DOUBLE * off) AS score FROM (SELECT *, (max_z - min_z + 1) AS lz, greatest(max_x - min_x + 1, max_y - min_y + 1) AS dxy, "
            "(max_z - min_z + 1) / greatest(max_x - min_x + 1, max_y - min_y + 1)::DOUBLE AS aspect, "
            "abs(sum_x / size::DOUBLE - wx0 - (wx1 - wx0 + 1) * 0.5::DOUBLE) + abs(sum_y / size::DOUBLE - wy0 - (wy1 - wy0 + 1) * 0.5::DOUBLE) AS off, "
            f"(wx1 - wx0 + 1)::BIGINT * (wy1 - wy0 + 1) * (wz1 - wz0 + 1) AS w FROM st JOIN {window} USING (case_id)) "
            f"WHERE size >= {p.min_size} AND size <= w // {p.size_share} AND lz >= {p.min_length} AND dxy <= {p.max_diameter} AND aspect >= {p.min_aspect})")


vox("q_component_rank", "SELECT case_id, label, size, round(score, 6) AS score FROM tb QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY score DESC, label) = 1",
    member("m", "hu <= -560"), label("lab", "m"), STATS.format(more=""),
    "win AS (SELECT DISTINCT case_id, 0 AS wx0, 7 AS wx1, 0 AS wy0, 7 AS wy1, 0 AS wz0, 1000 AS wz1 FROM vox)", tube("win"), recursive=True)
vox("q_region_grow", "SELECT * FROM f", member("m", "hu <= -500"),
    "e AS MATERIALIZED (SELECT * FROM m WHERE z = 0 AND x IN (3, 4) AND y IN (3, 4))", flood("f", "e", "m"), recursive=True)

# --- measures --------------------------------------------------------------------------------
DICE = "CASE WHEN sum(p) + sum(g) > 0 THEN 2.0::DOUBLE * sum(p * g) / (sum(p) + sum(g)) ELSE 1.0::DOUBLE END"


def overlap(pred: str) -> str:
    return (f"SELECT case_id, CAST(sum(p) AS BIGINT) AS pred, CAST(sum(g) AS BIGINT) AS gt, CAST(sum(p * g) AS BIGINT) AS inter, {DICE} AS dice "
            f"FROM (SELECT case_id, CAST({pred} AS BIGINT) AS p, CAST({TRUTH} AS BIGINT) AS g FROM vox) GROUP BY case_id")


vox("q_dice", overlap("(hu <= -550)"))
vox("q_dice_masks", overlap("(hu <= -560)"))
vox("q_batch_dice", f"SELECT round(avg(d), 9) AS val_dice FROM (SELECT {DICE} AS d FROM (SELECT case_id, z // 16 AS b, CAST(hu <= -550 AS BIGINT) AS p, "
    f"CAST({TRUTH} AS BIGINT) AS g FROM vox) GROUP BY case_id, b)")
GATE = ("gt AS MATERIALIZED (SELECT case_id, n_lo, n_hi, ratio, CASE WHEN ratio > {ratio} THEN {hi}::DOUBLE ELSE {lo}::DOUBLE END AS thr FROM (SELECT *, "
        "CASE WHEN n_hi > 0 THEN (n_lo - n_hi) / n_hi::DOUBLE ELSE 0.0::DOUBLE END AS ratio FROM (SELECT case_id, CAST(sum(CAST(prob > CAST({lo} AS FLOAT) AS INT)) AS BIGINT) AS n_lo, "
        "CAST(sum(CAST(prob > CAST({hi} AS FLOAT) AS INT)) AS BIGINT) AS n_hi FROM vox GROUP BY case_id)))")
vox("q_gate", "SELECT case_id, n_lo, n_hi, round(ratio, 9) AS ratio, thr FROM gt", GATE.format(lo=0.4, hi=0.5, ratio=0.5))
vox("q_gate_quiet", "SELECT case_id, n_lo, n_hi, round(ratio, 9) AS ratio, thr FROM gt", GATE.format(lo=0.20, hi=0.25, ratio=0.03))
vox("q_hybrid_abort", "SELECT case_id, n_hi AS n_core, n_lo AS n_gate, round(ratio, 9) AS ratio, ratio > 0.5 AS abort FROM gt", GATE.format(lo=0.38, hi=0.42, ratio=0.5))
vox("q_prob_stats", f"SELECT case_id, round(avg(CAST(prob AS DOUBLE)), 9) AS mean_prob, CAST(max(prob) AS DOUBLE) AS max_prob, "
    f"CAST(sum(CAST({above(0.5)} AS INT)) AS BIGINT) AS n_above FROM vox GROUP BY case_id")
PROFILE = ("pr AS MATERIALIZED (SELECT case_id, z, count(*) AS area, max(x) - min(x) + 1 AS width, max(y) - min(y) + 1 AS height FROM m GROUP BY case_id, z)")
TYPICAL = "md AS (SELECT case_id, area AS med FROM (SELECT case_id, area, row_number() OVER (PARTITION BY case_id ORDER BY area) AS r, count(*) OVER (PARTITION BY case_id) AS n FROM pr) WHERE r = n // 2 + 1)"
vox("q_slice_profile", "SELECT * FROM pr", member("m", "hu <= -550"), PROFILE)
vox("q_prune_slices", "SELECT m.case_id, m.x, m.y, m.z FROM m JOIN pr USING (case_id, z) JOIN md USING (case_id) "
    "WHERE NOT (area > 1 * med + 3 AND (width > 4 OR height > 4 OR area / (width * height)::DOUBLE < 0.5))", member("m", "hu <= -550"), PROFILE, TYPICAL)


# --- stencils --------------------------------------------------------------------------------
def line_pass(name: str, of: str, axis: str, taps: list[float], col: str = "v") -> str:
    """Edge-clamped weighted sum along one axis."""
    others = ", ".join(["case_id"] + [a for a in "xyz" if a != axis])
    order = f"PARTITION BY {others} ORDER BY {axis}"
    full = f"({order} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    r = len(taps) // 2
    terms = []
    for k in range(-r, r + 1):
        at = col if k == 0 else (f"coalesce(lag({col}, {-k}) OVER ({order}), first_value({col}) OVER {full})" if k < 0
                                 else f"coalesce(lead({col}, {k}) OVER ({order}), last_value({col}) OVER {full})")
        terms.append(f"{taps[k + r]!r}::DOUBLE * {at}")
    return f"{name} AS MATERIALIZED (SELECT case_id, x, y, z, nz, {' + '.join(terms)} AS v FROM {of})"


V0 = "v0 AS MATERIALIZED (SELECT case_id, x, y, z, nz, CAST(hu AS DOUBLE) AS v FROM vox)"


def bell(radius: int, sigma: float) -> list[float]:
    """Weights of a sampled bell, from its definition and not from the engine."""
    raw = [math.e ** (-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    return [w / sum(raw) for w in raw]


def smooth3(taps: list[float], start: str = "v0", tag: str = "g") -> list[str]:
    return [line_pass(f"{tag}x", start, "x", taps), line_pass(f"{tag}y", f"{tag}x", "y", taps), line_pass(f"{tag}z", f"{tag}y", "z", taps)]


vox("q_gauss_x", "SELECT case_id, x, y, z, v FROM gx", V0, line_pass("gx", "v0", "x", Q.DYADIC))
vox("q_gauss3d", "SELECT case_id, x, y, z, v FROM gz", V0, *smooth3(Q.DYADIC))
vox("q_gauss_threshold", "SELECT case_id, x, y, z FROM gz WHERE v BETWEEN -520 AND -505", V0, *smooth3(Q.DYADIC))
vox("q_validate_gauss", "SELECT case_id, x, y, z, round(v, 6) AS v FROM gz", V0, *smooth3(bell(2, 1.0)))

vox("q_gauss_check", "SELECT count(*) AS n, round(max(abs(v)), 6) AS max_abs, 0.0::DOUBLE AS relative, true AS ok FROM gz", V0, *smooth3(bell(1, 1.0)))


def cell(x: str, y: str, z: str) -> str:
    return f"((CAST(case_id AS BIGINT) * 100000 + {z}) * 64 + {y} * 8 + {x})"


def near(of: str, offsets: list[tuple[int, int, int]], top: int = 7) -> str:
    """FROM clause giving c and one edge-clamped neighbour per offset, met by cell number."""
    keys, joins = [], ""
    for dx, dy, dz in offsets:
        n = nb(dx, dy, dz)[:-2]
        at = cell(f"least(greatest(x + {dx}, 0), {top})", f"least(greatest(y + {dy}, 0), {top})", f"least(greatest(z + {dz}, 0), nz - 1)")
        keys.append(f"{at} AS k_{n}")
        joins += f" JOIN (SELECT {cell('x', 'y', 'z')} AS k, v FROM {of}) {n} ON {n}.k = c.k_{n}"
    return f"FROM (SELECT *, {', '.join(keys)} FROM {of}) c{joins}"


def nb(dx: int, dy: int, dz: int) -> str:
    return "n" + "".join("m" if v < 0 else "p" if v > 0 else "o" for v in (dx, dy, dz)) + ".v"


FACES = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
EDGES = [(1, 1, 0), (-1, 1, 0), (1, -1, 0), (-1, -1, 0), (1, 0, 1), (-1, 0, 1), (1, 0, -1), (-1, 0, -1),
         (0, 1, 1), (0, -1, 1), (0, 1, -1), (0, -1, -1)]


def grad_of(of: str, name: str = "gr", top: int = 7) -> str:
    g = [f"0.5::DOUBLE * ({nb(*FACES[2 * i])} - {nb(*FACES[2 * i + 1])})" for i in range(3)]
    return (f"{name} AS MATERIALIZED (SELECT case_id, x, y, z, v, sqrt(gx * gx + gy * gy + gz * gz) AS grad FROM "
            f"(SELECT c.case_id, c.x, c.y, c.z, c.v, {g[0]} AS gx, {g[1]} AS gy, {g[2]} AS gz {near(of, FACES, top)}))")


vox("q_gradient", "SELECT case_id, x, y, z, round(grad, 6) AS grad FROM gr", V0, grad_of("v0"))


def hess_of(of: str, name: str, s: float) -> str:
    def second(i: int) -> str:
        return f"({nb(*FACES[2 * i])} - 2.0::DOUBLE * c.v + {nb(*FACES[2 * i + 1])}) * {s!r}::DOUBLE"

    def mixed(i: int) -> str:
        a, b, c, d = (nb(*EDGES[4 * i + k]) for k in range(4))
        return f"0.25::DOUBLE * ({a} - {b} - {c} + {d}) * {s!r}::DOUBLE"

    return (f"{name} AS MATERIALIZED (SELECT c.case_id, c.x, c.y, c.z, {second(0)} AS hxx, {second(1)} AS hyy, {second(2)} AS hzz, "
            f"{mixed(0)} AS hxy, {mixed(1)} AS hxz, {mixed(2)} AS hyz {near(of, FACES + EDGES)})")


def eigen_of(of: str, name: str) -> str:
    return f"""{name}_1 AS (SELECT *, hxy*hxy + hxz*hxz + hyz*hyz AS off, (hxx + hyy + hzz) / 3.0::DOUBLE AS q FROM {of}),
{name}_2 AS (SELECT *, sqrt(((hxx-q)*(hxx-q) + (hyy-q)*(hyy-q) + (hzz-q)*(hzz-q) + 2.0::DOUBLE*off) / 6.0::DOUBLE) AS s FROM {name}_1),
{name}_3 AS (SELECT *, CASE WHEN s > 0 THEN 1.0::DOUBLE / s ELSE 0.0::DOUBLE END AS i FROM {name}_2),
{name}_4 AS (SELECT *, (hxx-q)*i AS a, (hyy-q)*i AS b, (hzz-q)*i AS c, hxy*i AS d, hxz*i AS e, hyz*i AS f FROM {name}_3),
{name}_5 AS (SELECT *, acos(least(1.0::DOUBLE, greatest(-1.0::DOUBLE, (a*(b*c - f*f) - d*(d*c - f*e) + e*(d*f - b*e)) * 0.5::DOUBLE))) / 3.0::DOUBLE AS phi FROM {name}_4),
{name}_6 AS (SELECT *, q + 2.0::DOUBLE*s*cos(phi) AS r1, q + 2.0::DOUBLE*s*cos(phi + 2.0943951023931953::DOUBLE) AS r3 FROM {name}_5),
{name}_7 AS (SELECT case_id, x, y, z, CASE WHEN off = 0 THEN hxx ELSE r1 END AS l1, CASE WHEN off = 0 THEN hyy ELSE 3.0::DOUBLE*q - r1 - r3 END AS l2,
  CASE WHEN off = 0 THEN hzz ELSE r3 END AS l3 FROM {name}_6),
{name} AS MATERIALIZED (SELECT case_id, x, y, z, l[1][3] AS e1, l[2][3] AS e2, l[3][3] AS e3 FROM (SELECT case_id, x, y, z,
  list_sort([[abs(l1), 1, l1], [abs(l2), 2, l2], [abs(l3), 3, l3]]) AS l FROM {name}_7))"""


vox("q_hessian", "SELECT * FROM h", V0, hess_of("v0", "h", 1.0))
vox("q_eigen3", "SELECT case_id, x, y, z, round(e1, 5) AS e1, round(e2, 5) AS e2, round(e3, 5) AS e3 FROM ev", V0, hess_of("v0", "h", 1.0), eigen_of("h", "ev"))


def vesselness(incremental: bool) -> None:
    sigmas = (1.0, 2.0, 3.0)
    parts, scores = [V0], []
    for i, sigma in enumerate(sigmas):
        # Direct, or on from the scale before by the width that is missing in squares.
        steps = [(s ** 2 - (sigmas[k - 1] ** 2 if k else 0)) ** 0.5 for k, s in enumerate(sigmas[:i + 1])] if incremental else [sigma]
        start = "v0"
        for j, taps in enumerate(bell(math.ceil(3 * step), step) for step in steps):
            parts += smooth3(taps, start, f"g{i}{j}")
            start = f"g{i}{j}z"
        parts += [hess_of(start, f"h{i}", sigma * sigma), eigen_of(f"h{i}", f"e{i}")]
        parts.append(f"""t{i} AS MATERIALIZED (SELECT case_id, x, y, z, CASE WHEN e2 > 0 AND e3 > 0 THEN
  (1.0::DOUBLE - exp(-((abs(e2)/abs(e3)) * (abs(e2)/abs(e3))) / 0.5::DOUBLE)) * exp(-((abs(e1)/sqrt(abs(e2*e3))) * (abs(e1)/sqrt(abs(e2*e3)))) / 0.5::DOUBLE) END AS shape,
  CASE WHEN e2 > 0 AND e3 > 0 THEN e1*e1 + e2*e2 + e3*e3 END AS str FROM e{i})""")
        scores.append(f"SELECT case_id, x, y, z, coalesce(shape * (1.0::DOUBLE - exp(-str / (0.5::DOUBLE * max(str) OVER (PARTITION BY case_id)))), 0.0::DOUBLE) AS v FROM t{i}")
    name = "q_vesselness_incremental" if incremental else "q_vesselness"
    vox(name, f"SELECT case_id, x, y, z, round(max(v), 5) AS vness FROM ({' UNION ALL '.join(scores)}) GROUP BY case_id, x, y, z", *parts)


vesselness(False)
vesselness(True)
vox("q_slice_triplet", f"SELECT c.case_id, c.x, c.y, c.z, {nb(0, 0, -1)} AS below, c.v AS here, {nb(0, 0, 1)} AS above {near('vi', [(0, 0, -1), (0, 0, 1)])}",
    "vi AS MATERIALIZED (SELECT case_id, x, y, z, nz, hu AS v FROM vox)")
POOL = ("dn AS MATERIALIZED (SELECT case_id, x // 2 AS x, y // 2 AS y, z // 2 AS z, any_value(nz) // 2 AS nz, sum(hu) / 8.0::DOUBLE AS v FROM vox WHERE z // 2 < nz // 2 GROUP BY case_id, x // 2, y // 2, z // 2)")
vox("q_downsample", "SELECT case_id, x, y, z, v FROM dn", POOL)


def trilinear() -> None:
    def size(n: str, sp: float, target: float) -> str:
        return f"greatest(16, CAST(ceil(round({n} * {sp}::DOUBLE / {target}::DOUBLE) / 8.0::DOUBLE) * 8 AS INT))"

    ax = []
    for a, n, sp, t in (("x", "8", 0.8, 0.5), ("y", "8", 0.8, 0.6), ("z", "nz", 1.25, 1.0)):
        ax.append(f"d{a} AS (SELECT *, CAST(floor(o * s) AS INT) AS i0, least(CAST(floor(o * s) AS INT) + 1, n - 1) AS i1, o * s - floor(o * s) AS t FROM (SELECT case_id, n, CAST(unnest(range(r)) AS INT) AS o, "
                  f"(n - 1)::DOUBLE / greatest(1, r - 1) AS s FROM (SELECT DISTINCT case_id, {n} AS n, {size(n, sp, t)} AS r FROM vox)))")
    corners = [(i, j, k) for i in (0, 1) for j in (0, 1) for k in (0, 1)]
    keys = ", ".join(f"{cell(f'dx.i{i}', f'dy.i{j}', f'dz.i{k}').replace('case_id', 'dx.case_id')} AS k{i}{j}{k}" for i, j, k in corners)
    grid = (f"gd AS MATERIALIZED (SELECT dx.case_id, dx.o AS x, dy.o AS y, dz.o AS z, dx.t AS tx, dy.t AS ty, dz.t AS tz, {keys} "
            "FROM dx JOIN dy USING (case_id) JOIN dz USING (case_id))")
    vk = f"vk AS MATERIALIZED (SELECT {cell('x', 'y', 'z')} AS k, hu FROM vox)"
    joins = "".join(f" JOIN vk v{i}{j}{k} ON v{i}{j}{k}.k = gd.k{i}{j}{k}" for i, j, k in corners)

    def lerp(a: str, b: str, t: str) -> str:
        return f"({a} * (1 - {t}) + {b} * {t})"

    def sheet(k: int) -> str:
        return lerp(lerp(f"v00{k}.hu", f"v10{k}.hu", "tx"), lerp(f"v01{k}.hu", f"v11{k}.hu", "tx"), "ty")

    vox("q_trilinear", f"SELECT case_id, x, y, z, round({lerp(sheet(0), sheet(1), 'tz')}, 6) AS v FROM gd{joins}", *ax, grid, vk)


trilinear()

# --- adaptive threshold ----------------------------------------------------------------------
A = Q.AIR
AIR = [
    POOL,
    "cb AS (SELECT case_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM dn WHERE v > " + str(A["body_thr"]) + " GROUP BY case_id)",
    "cw AS (SELECT d.case_id, coalesce(x0, 0) AS x0, coalesce(x1, 3) AS x1, coalesce(y0, 0) AS y0, coalesce(y1, 3) AS y1, coalesce(z0, 0) AS z0, coalesce(z1, d.nz - 1) AS z1, d.nz "
    "FROM (SELECT DISTINCT case_id, nz FROM dn) d LEFT JOIN cb USING (case_id))",
    f"cc AS (SELECT case_id, greatest(1, (x0 + x1) // 2 - hx) AS cx0, least(2, (x0 + x1) // 2 + hx) AS cx1, greatest(1, (y0 + y1) // 2 - hy) AS cy0, least(2, (y0 + y1) // 2 + hy) AS cy1, "
    f"greatest(1, z0) AS cz0, least(nz - 2, z1) AS cz1 FROM (SELECT *, CAST(floor({0.5 * A['core_frac']}::DOUBLE * (x1 - x0 + 1)) AS INT) + 1 AS hx, CAST(floor({0.5 * A['core_frac']}::DOUBLE * (y1 - y0 + 1)) AS INT) + 1 AS hy FROM cw))",
    grad_of("dn", "gd", 3),
    f"rk AS (SELECT g.case_id, v, row_number() OVER (PARTITION BY case_id ORDER BY v) - 1 AS r, count(*) OVER (PARTITION BY case_id) AS n FROM gd g JOIN cc USING (case_id) "
    f"WHERE x BETWEEN cx0 AND cx1 AND y BETWEEN cy0 AND cy1 AND z BETWEEN cz0 AND cz1 AND v < {A['air_ceiling']} AND grad <= {A['grad_max']})"]
THR = (f"SELECT k.case_id, coalesce(n, 0) AS n_air, CASE WHEN coalesce(n, 0) < {A['few']} THEN {A['fallback']}::DOUBLE "
       f"ELSE least(greatest(val + 30.0::DOUBLE * {A['k']}::DOUBLE, {A['limits'][0]}::DOUBLE), {A['limits'][1]}::DOUBLE) END AS thr "
       "FROM (SELECT DISTINCT case_id FROM vox) k LEFT JOIN (SELECT case_id, n, v AS val FROM rk WHERE r = floor(0.05::DOUBLE * n)) USING (case_id)")
vox("q_adaptive_thr", THR, *AIR)

# --- look-up tables --------------------------------------------------------------------------
L = Q.LUT


def bin_of(col: str, lo: float, hi: float, n: int) -> str:
    return f"least(greatest(CAST(trunc(({col} - {lo}::DOUBLE) / {hi - lo}::DOUBLE * {n}.0::DOUBLE) AS INT), 0), {n - 1})"


HIST = (f"hs AS MATERIALIZED (SELECT {bin_of('grad', 0.0, L.gmax, L.gbins)} AS gbin, {bin_of('v', L.imin, L.imax, L.ibins)} AS ibin, "
        f"CAST(sum(CAST({TRUTH.replace('hu', 'v')} AS INT)) AS BIGINT) AS airway, count(*) AS total FROM gr GROUP BY 1, 2)")
PROB = "pb AS MATERIALIZED (SELECT *, CASE WHEN total >= 20 THEN airway / total::DOUBLE ELSE 0.0::DOUBLE END AS prob FROM hs)"
vox("q_lut_hist", "SELECT * FROM hs", V0, grad_of("v0"), HIST)
vox("q_lut_merge", "SELECT * FROM hs", V0, grad_of("v0"), HIST)
vox("q_lut_prob", "SELECT gbin, ibin, airway, total, round(prob, 9) AS prob FROM pb", V0, grad_of("v0"), HIST, PROB)


def axis_of(col: str, lo: float, hi: float, n: int) -> str:
    return f"least(greatest(({col} - {lo}::DOUBLE) / {hi - lo}::DOUBLE * {n}.0::DOUBLE, 0.0::DOUBLE), {n}.0::DOUBLE)"


vox("q_lut_apply", "SELECT case_id, x, y, z, round((coalesce(a.prob, 0) * (1 - fi) + coalesce(b.prob, 0) * fi) * (1 - fg) + (coalesce(c.prob, 0) * (1 - fi) + coalesce(d.prob, 0) * fi) * fg, 6) AS p FROM rd "
    "LEFT JOIN pb a ON a.gbin = g0 AND a.ibin = i0 LEFT JOIN pb b ON b.gbin = g0 AND b.ibin = i1 "
    "LEFT JOIN pb c ON c.gbin = g1 AND c.ibin = i0 LEFT JOIN pb d ON d.gbin = g1 AND d.ibin = i1", V0, grad_of("v0"), HIST, PROB,
    f"rd AS (SELECT case_id, x, y, z, pi - floor(pi) AS fi, pg - floor(pg) AS fg, least(CAST(floor(pi) AS INT), {L.ibins - 1}) AS i0, least(least(CAST(floor(pi) AS INT), {L.ibins - 1}) + 1, {L.ibins - 1}) AS i1, "
    f"least(CAST(floor(pg) AS INT), {L.gbins - 1}) AS g0, least(least(CAST(floor(pg) AS INT), {L.gbins - 1}) + 1, {L.gbins - 1}) AS g1 FROM (SELECT *, {axis_of('v', L.imin, L.imax, L.ibins)} AS pi, "
    f"{axis_of('grad', 0.0, L.gmax, L.gbins)} AS pg FROM gr))")


# --- seeds and growth ------------------------------------------------------------------------
def seeds(name: str, of: str, frac: float) -> str:
    r = f"CAST(floor(CAST({frac} AS FLOAT) * 8) AS INT)"
    return (f"{name} AS MATERIALIZED (SELECT case_id, z, y, x FROM (SELECT m.*, (x - 4) * (x - 4) + (y - 4) * (y - 4) AS d2 FROM {of} m JOIN bx USING (case_id) "
            f"WHERE x BETWEEN bx0 AND bx1 AND y BETWEEN by0 AND by1 AND z BETWEEN bz0 AND bz1) WHERE d2 <= {r} * {r} "
            f"QUALIFY row_number() OVER (PARTITION BY case_id, z ORDER BY d2, y, x) = 1)")


def robust(name: str, of: str, frac: float = 0.10) -> str:
    fracs = [frac, frac * 1.5, frac * 2.5, 0.5]
    one = "".join(seeds(f"{name}{i}", of, f) + ", " for i, f in enumerate(fracs))
    counts = ", ".join(f"(SELECT count(*) FROM {name}{i} s WHERE s.case_id = bx.case_id) AS c{i}" for i in range(4))
    picks = " ".join(f"WHEN c{i} >= need THEN {i}" for i in range(4))
    rows = " UNION ALL ".join(f"SELECT s.case_id, z, y, x FROM {name}{i} s JOIN {name}p USING (case_id) WHERE pick = {i}" for i in range(4))
    return (one + f"{name}p AS MATERIALIZED (SELECT case_id, CASE {picks} WHEN c3 > 0 THEN 3 ELSE -1 END AS pick FROM (SELECT case_id, greatest(8, (bz1 - bz0 + 1) // 4) AS need, {counts} FROM bx)), "
            f"{name}f AS (SELECT m.case_id, z, y, x FROM {of} m JOIN bx USING (case_id) WHERE x BETWEEN bx0 AND bx1 AND y BETWEEN by0 AND by1 AND z BETWEEN bz0 AND bz1 "
            f"QUALIFY row_number() OVER (PARTITION BY m.case_id, z ORDER BY y, x) = 1), "
            f"{name} AS MATERIALIZED ({rows} UNION ALL SELECT s.case_id, z, y, x FROM {name}f s JOIN {name}p USING (case_id) WHERE pick = -1)")


vox("q_axis_seeds", "SELECT * FROM sd", BBOX, WINDOW, member("m", "hu <= -550"), seeds("sd", "m", 0.3))
vox("q_axis_seeds_robust", "SELECT * FROM sd", BBOX, WINDOW, member("m", "hu <= -600"), robust("sd", "m"))


def grown(mask: str) -> list[str]:
    """Flood ``cand`` from robust seeds of ``mask``; cases without seeds keep the mask."""
    return [robust("sd", mask), "e AS MATERIALIZED (SELECT c.case_id, c.x, c.y, c.z FROM cand c SEMI JOIN sd USING (case_id, x, y, z))", flood("f", "e", "cand")]


RESULT = "SELECT * FROM f UNION ALL SELECT case_id, x, y, z FROM {m} ANTI JOIN sd USING (case_id)"
vox("q_gate_cc", RESULT.format(m="cand"), BBOX, WINDOW, GATE.format(lo=0.4, hi=0.5, ratio=0.5),
    "cand AS MATERIALIZED (SELECT v.case_id, v.x, v.y, v.z FROM vox v JOIN gt USING (case_id) WHERE prob > CAST(thr AS FLOAT))", *grown("cand"), recursive=True)
vox("q_gate_cc_closed", RESULT.format(m="cand"), BBOX, WINDOW, GATE.format(lo=0.45, hi=0.55, ratio=0.5),
    "m0 AS MATERIALIZED (SELECT v.case_id, v.x, v.y, v.z FROM vox v JOIN gt USING (case_id) WHERE prob > CAST(thr AS FLOAT))", grow_box("env", "m0", 1),
    f"m1 AS MATERIALIZED (SELECT case_id, x, y, z FROM m0 UNION SELECT case_id, x, y, z FROM vox SEMI JOIN env USING (case_id, x, y, z) WHERE {above(0.4)})",
    grow_box("g1", "m1", 1), shrink_box("cand", "g1", 1), *grown("cand"), recursive=True)
vox("q_hybrid", RESULT.format(m="core"), BBOX, WINDOW, GATE.format(lo=0.4, hi=0.5, ratio=1.7), member("core", above(0.5)),
    f"cand AS MATERIALIZED (SELECT v.case_id, v.x, v.y, v.z FROM vox v JOIN gt USING (case_id) WHERE {above(0.5)} OR (ratio <= 1.7 AND {above(0.4)} AND hu BETWEEN -530 AND -490))",
    *grown("core"), recursive=True)

# --- sweeps ----------------------------------------------------------------------------------
T = Q.TUBE
RWIN = (f"win AS MATERIALIZED (SELECT case_id, greatest(0, (bx0 + bx1) // 2 - greatest({T.min_half_width}, CAST(floor(CAST({T.xy_share} AS FLOAT) * (bx1 - bx0 + 1)) AS INT))) AS wx0, "
        f"least(7, (bx0 + bx1) // 2 + greatest({T.min_half_width}, CAST(floor(CAST({T.xy_share} AS FLOAT) * (bx1 - bx0 + 1)) AS INT))) AS wx1, "
        f"greatest(0, (by0 + by1) // 2 - greatest({T.min_half_width}, CAST(floor(CAST({T.xy_share} AS FLOAT) * (by1 - by0 + 1)) AS INT))) AS wy0, "
        f"least(7, (by0 + by1) // 2 + greatest({T.min_half_width}, CAST(floor(CAST({T.xy_share} AS FLOAT) * (by1 - by0 + 1)) AS INT))) AS wy1, bz0 AS wz0, "
        f"least(bz1, bz0 + greatest({T.min_depth}, CAST(floor(CAST({T.z_share} AS FLOAT) * (bz1 - bz0 + 1)) AS INT)) - 1) AS wz1 FROM bx)")
vox("q_rescue", "SELECT case_id, z, y, x, thr, voxels FROM (SELECT lab.*, size AS voxels, (x - cx) * (x - cx) + (y - cy) * (y - cy) AS d2 FROM lab JOIN pick USING (case_id, thr, label)) "
    "QUALIFY row_number() OVER (PARTITION BY case_id, z ORDER BY d2, y, x) = 1", BBOX, WINDOW, RWIN,
    f"m AS MATERIALIZED (SELECT v.case_id, x, y, z, thr FROM vox v JOIN win USING (case_id), (SELECT unnest([{', '.join(f'{t}::DOUBLE' for t in T.thresholds)}]) AS thr) "
    "WHERE hu <= thr AND x BETWEEN wx0 AND wx1 AND y BETWEEN wy0 AND wy1 AND z BETWEEN wz0 AND wz1)",
    label("lab", "m", "thr"), STATS.format(more=", thr"), tube("win"),
    "pick AS MATERIALIZED (SELECT case_id, thr, label, size, sum_x / size::DOUBLE AS cx, sum_y / size::DOUBLE AS cy FROM tb QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY thr, score DESC, label) = 1)",
    recursive=True)


def trunk(p, thr: str) -> list[str]:
    """Growth at half resolution under every attempt; ``ch`` picks the loosest one under the cap, else the smallest."""
    return [
        f"cd AS MATERIALIZED (SELECT case_id, x, y, z, CAST(t AS INT) AS t FROM dn JOIN ({thr}) USING (case_id), range({p.tries}) k(t) WHERE v >= {p.coarse_low} AND v <= thr - {p.step} * t)",
        "ed AS MATERIALIZED (SELECT * FROM cd WHERE x IN (0, 3) OR y IN (0, 3))", flood("fx", "ed", "cd", STEP2, "t"),
        "it AS MATERIALIZED (SELECT cd.* FROM cd ANTI JOIN fx USING (case_id, x, y, z, t))",
        "ax AS MATERIALIZED (SELECT * FROM it WHERE x = 2 AND y = 2)", flood("tr", "ax", "it", STEP3, "t"),
        f"sz AS (SELECT c.case_id, CAST(k.t AS INT) AS t, (SELECT count(*) FROM tr WHERE tr.case_id = c.case_id AND tr.t = k.t) AS n FROM (SELECT DISTINCT case_id FROM dn) c, range({p.tries}) k(t))",
        f"""ch AS MATERIALIZED (SELECT case_id, CAST(cap AS BIGINT) AS cap, attempt, voxels FROM (SELECT c.case_id, cap, t AS attempt, n AS voxels, row_number() OVER (PARTITION BY c.case_id ORDER BY
 CASE WHEN n <= cap THEN 0 WHEN n > 0 THEN 1 ELSE 2 END, CASE WHEN n <= cap THEN t ELSE n END, t) AS r
 FROM (SELECT DISTINCT case_id, floor({p.cap_share}::DOUBLE * 16 * nz) AS cap FROM dn) c JOIN sz USING (case_id)) WHERE r = 1)"""]


vox("q_feedback", "SELECT * FROM ch", POOL, *trunk(Q.FEEDBACK, f"SELECT DISTINCT case_id, {Q.FEEDBACK.coarse_high}::DOUBLE AS thr FROM dn"), recursive=True)


def envelope(p) -> list[str]:
    """The trunk without slices that explode, then every voxel whose coarse cell has one of it near."""
    reach = (p.dilate + 1) // 2
    return [
        "pt AS MATERIALIZED (SELECT tr.case_id, tr.x, tr.y, tr.z FROM tr JOIN ch ON tr.case_id = ch.case_id AND tr.t = ch.attempt)", PROFILE.replace("FROM m ", "FROM pt "), TYPICAL,
        "pu AS MATERIALIZED (SELECT pt.* FROM pt JOIN pr USING (case_id, z) JOIN md USING (case_id) "
        "WHERE NOT (area > 8 * med + 50 AND (width > 2 OR height > 2 OR area / (width * height)::DOUBLE < 0.5)))",
        f"ev AS MATERIALIZED (SELECT v.* FROM vox v WHERE EXISTS (SELECT 1 FROM pu WHERE pu.case_id = v.case_id AND abs(pu.x - v.x // 2) <= {reach} "
        f"AND abs(pu.y - v.y // 2) <= {reach} AND abs(pu.z - least(v.z // 2, v.nz // 2 - 1)) <= {reach}))"]


vox("q_pyramid", "SELECT * FROM f", BBOX, WINDOW, *AIR, *trunk(Q.PYRAMID, THR), *envelope(Q.PYRAMID),
    "m AS MATERIALIZED (SELECT case_id, x, y, z FROM ev WHERE hu <= -500)", robust("sd", "m"),
    "e AS MATERIALIZED (SELECT m.* FROM m SEMI JOIN sd USING (case_id, x, y, z))", flood("f", "e", "m"), recursive=True)

# --- tiles -----------------------------------------------------------------------------------
STARTS = ("ts AS MATERIALIZED (SELECT DISTINCT n, s FROM (SELECT n, unnest(CASE WHEN n <= {p} THEN [0] ELSE list_concat(range(0, n - {p} + 1, {q}), [n - {p}]) END) AS s FROM "
          "(SELECT 8 AS n UNION SELECT DISTINCT nz FROM vox)))").format(p=Q.PATCH, q=Q.STRIDE)
vox("q_tile_starts", f"SELECT case_id, CAST(a.s AS INT) AS z_lo, CAST(b.s AS INT) AS y_lo, CAST(c.s AS INT) AS x_lo, CAST(least({Q.PATCH}, nz - a.s) AS INT) AS z_len, "
    f"CAST(least({Q.PATCH}, 8 - b.s) AS INT) AS y_len, CAST(least({Q.PATCH}, 8 - c.s) AS INT) AS x_len FROM (SELECT DISTINCT case_id, nz FROM vox) v JOIN ts a ON a.n = v.nz, ts b, ts c WHERE b.n = 8 AND c.n = 8", STARTS)
HELD = (f"FROM vox v JOIN ts a ON a.n = v.nz AND v.z BETWEEN a.s AND a.s + {Q.PATCH - 1} JOIN ts b ON b.n = 8 AND v.y BETWEEN b.s AND b.s + {Q.PATCH - 1} "
        f"JOIN ts c ON c.n = 8 AND v.x BETWEEN c.s AND c.s + {Q.PATCH - 1}")
vox("q_overlap_avg", f"SELECT case_id, x, y, z, CAST(count(*) AS INT) AS hits, round(avg(((x - c.s) + 2 * (y - b.s) + 4 * (z - a.s)) / 64.0::DOUBLE), 9) AS prob {HELD} GROUP BY case_id, x, y, z", STARTS)
vox("q_score_tiles", "SELECT case_id, x, y, z, CAST(CAST(avg(CAST(CAST(exp(l - greatest(l, 0)) / (exp(0 - greatest(l, 0)) + exp(l - greatest(l, 0))) AS FLOAT) AS DOUBLE)) AS FLOAT) AS DOUBLE) AS prob FROM (SELECT v.*, "
    f"(hu + 1024) / 1024.0::DOUBLE * 4 + ((x - c.s) + 2 * (y - b.s) + 4 * (z - a.s)) / 16.0::DOUBLE - 2 AS l {HELD}) GROUP BY case_id, x, y, z", STARTS)
vox("q_score_slices", "SELECT case_id, x, y, z, CAST(CAST(exp(l - greatest(l, 0)) / (exp(0 - greatest(l, 0)) + exp(l - greatest(l, 0))) AS FLOAT) AS DOUBLE) AS prob FROM ("
    f"SELECT c.case_id, c.x, c.y, c.z, ({nb(0, 0, -1)} + 2 * c.v - {nb(0, 0, 1)} + 2048) / 1024.0::DOUBLE AS l " + near("v0", [(0, 0, -1), (0, 0, 1)]) + ")", V0)

# --- layered growth --------------------------------------------------------------------------
F = Q.FRONT
CEILING = (f"CAST(CAST({F.thr_trunk} AS FLOAT) + least(CAST({{level}} AS FLOAT) * (CAST(1 AS FLOAT) / CAST({F.max_level} AS FLOAT)), CAST(1 AS FLOAT)) "
           f"* CAST({F.thr_periph - F.thr_trunk} AS FLOAT) AS DOUBLE)")
#: A row is a voxel at a layer, with the book of its case: each layer gives all voxels of the cases that still grow anew.
FRONT = (
    f"fc AS MATERIALIZED (SELECT *, CAST(floor({F.leak_ratio} * count(*) FILTER (hard) OVER (PARTITION BY case_id)) AS BIGINT) + {F.cap_base} AS cap FROM ("
    f"SELECT case_id, x, y, z, hu, hu <= {Q.FRONT_HARD} AS hard, (-hu - 480) / 100.0::DOUBLE >= {F.vmin} AND hu <= {F.hu_abs_max} AS soft FROM vox "
    f"WHERE hu <= {Q.FRONT_HARD} OR (hu <= least(greatest({F.thr_trunk}, {F.thr_periph}), {F.hu_abs_max}) AND (-hu - 480) / 100.0::DOUBLE >= {F.vmin})))",
    "st AS (SELECT fc.*, CASE WHEN z % 8 = 0 AND x IN (3, 4) AND y IN (3, 4) AND (hard OR (soft AND hu <= " + CEILING.format(level=0) + ")) THEN 0 END AS level, "
    "false AS shut, 0 AS depth, CAST(0 AS BIGINT) AS added, false AS closed, CAST([] AS DOUBLE[]) AS recent FROM fc "
    "UNION ALL SELECT case_id, x, y, z, hu, hard, soft, cap, CASE WHEN fresh AND (hard OR NOT burst) THEN depth + 1 ELSE level END, shut OR (fresh AND burst AND NOT hard), depth + 1, "
    "added + CASE WHEN burst THEN 0 ELSE n - h END, closed OR (NOT burst AND added + n - h > cap), "
    f"CASE WHEN len(recent) < 5 THEN list_append(recent, CAST(CASE WHEN burst THEN h ELSE n END AS DOUBLE)) "
    "ELSE list_prepend(CAST(CASE WHEN burst THEN h ELSE n END AS DOUBLE), recent[2:5]) END FROM ("
    f"SELECT *, n > {F.leak_base} AND (coalesce(list_avg(recent), 0) <= 0 OR n > {F.leak_factor} * list_avg(recent)) AS burst FROM ("
    "SELECT *, count(*) FILTER (fresh) OVER (PARTITION BY case_id) AS n, count(*) FILTER (fresh AND hard) OVER (PARTITION BY case_id) AS h FROM ("
    "SELECT s.*, r.case_id IS NOT NULL AND s.level IS NULL AND NOT s.shut AND (s.hard OR (s.soft AND NOT s.closed AND s.hu <= " + CEILING.format(level="s.depth + 1") + ")) AS fresh "
    f"FROM st s LEFT JOIN (SELECT DISTINCT f.case_id, f.x + o.dx AS x, f.y + o.dy AS y, f.z + o.dz AS z FROM st f, {STEP3} WHERE f.level = f.depth) r "
    "ON s.case_id = r.case_id AND s.x = r.x AND s.y = r.y AND s.z = r.z))) WHERE n > 0)")
for _name in ("q_wavefront", "q_wavefront_layers"):
    vox(_name, "SELECT case_id, x, y, z, level FROM st WHERE level = depth", *FRONT, recursive=True)

# --- case analytics --------------------------------------------------------------------------
METRICS = """m AS MATERIALIZED (SELECT case_id, series, n, round(1 - d / (100.0::DOUBLE * n), 4) AS dice, q / n::DOUBLE AS total_s FROM (
  SELECT CAST(o_custkey % 120 AS INT) AS case_id, l_returnflag AS series, count(*) AS n, CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS d,
  CAST(sum(CAST(round(l_quantity) AS BIGINT)) AS BIGINT) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2))"""


def cases(name: str, select: str, *ctes: str) -> None:
    SQL[name] = f"WITH {METRICS}{''.join(', ' + c for c in ctes)} {select}"


LOGS = ("lg AS (SELECT *, CAST(floor(total_s * 1000) AS BIGINT) AS t, CAST(round(dice * 10000) AS BIGINT) AS s FROM m)")
cases("q_log_extract", "SELECT case_id, series, case_id + 1 AS nz, s / 10000.0::DOUBLE AS dice, n AS pred_voxels, n + 7 AS gt_voxels, (t // 8) / 1000.0::DOUBLE AS load_s, "
      "(t // 2) / 1000.0::DOUBLE AS infer_s, t / 1000.0::DOUBLE AS total_s FROM lg", LOGS)
cases("q_ablation", "SELECT series, round(avg((t // 2) / 1000.0::DOUBLE), 8) AS mean_infer_s, round(avg(t / 1000.0::DOUBLE), 8) AS mean_total_s, round(avg(s / 10000.0::DOUBLE), 8) AS mean_dice FROM lg GROUP BY series", LOGS)
SQL["q_monitor_stats"] = ("SELECT round(avg(q::DOUBLE), 6) AS sm_mean, max(q::DOUBLE) AS sm_max, round(avg(2.0::DOUBLE * q), 6) AS mem_mean FROM (SELECT CAST(trunc(l_quantity) AS INT) AS q FROM lineitem) WHERE q <> 1 AND q % 7 <> 0")
cases("q_paired_cases", "SELECT case_id, max(dice) FILTER (series = 'A') AS \"dice_A\", max(dice) FILTER (series = 'N') AS \"dice_N\", max(dice) FILTER (series = 'R') AS \"dice_R\" FROM m GROUP BY case_id HAVING count(DISTINCT series) = 3")
cases("q_case_summary", "SELECT series, count(*) AS n, round(avg(dice), 8) AS mean_dice, round(median(dice), 6) AS median_dice, count(*) FILTER (dice < 0.95) AS n_below, count(*) FILTER (dice >= 0.95) AS n_ok FROM m GROUP BY series")
cases("q_timing_ci", "SELECT series, n, round(a, 6) AS mean_s, round(s, 6) AS std_s, round(lo, 6) AS min_s, round(hi, 6) AS max_s, round(a - 1.96 * s / sqrt(n), 6) AS lo_s, round(a + 1.96 * s / sqrt(n), 6) AS hi_s "
      "FROM (SELECT series, count(*) AS n, avg(total_s) AS a, stddev_pop(total_s) AS s, min(total_s) AS lo, max(total_s) AS hi FROM m GROUP BY series)")
cases("q_stage_breakdown", "SELECT series, stage, round(k * t, 6) AS mean_s, round(k * t / t, 6) AS share FROM (SELECT series, avg(total_s) AS t FROM m GROUP BY series), "
      "(VALUES ('load_s', 0.125::DOUBLE), ('infer_s', 0.5::DOUBLE), ('region_grow_s', 0.25::DOUBLE), ('other', 0.125::DOUBLE)) AS w(stage, k)")
cases("q_slope_origin", "SELECT series, round(sum(n * total_s) / sum(n::DOUBLE * n), 6) AS slope FROM m GROUP BY series")
cases("q_voxel_cost", "SELECT series, round(10.0::DOUBLE * sum(sz * total_s) / sum(sz * sz), 3) AS ns_per_voxel FROM m JOIN "
      "(SELECT label AS case_id, count(*) * 64 / 1e8::DOUBLE AS sz FROM embeddings GROUP BY label) USING (case_id) GROUP BY series")
cases("q_throughput", "SELECT series, count(*) AS n, round(sum(total_s), 6) AS wall_s, round(count(*) / sum(total_s), 9) AS per_s FROM m GROUP BY series")
cases("q_speedup", "SELECT series, case_id, round(total_s, 6) AS total_s, round(f / total_s, 6) AS speedup, round(100.0::DOUBLE * (total_s - f) / f, 6) AS change_pct "
      "FROM (SELECT *, first_value(total_s) OVER (PARTITION BY series ORDER BY case_id) AS f FROM m)")
PAIRS = "pr AS MATERIALIZED (SELECT a.series || ' vs ' || b.series AS pair, a.case_id, a.dice AS a, b.dice AS b FROM m a JOIN m b ON a.case_id = b.case_id AND a.series < b.series)"
cases("q_cliffs_delta", "SELECT pair, n, m, gt, lt, round(dl, 9) AS delta, CASE WHEN abs(dl) < 0.147 THEN 'negligible' WHEN abs(dl) < 0.33 THEN 'small' WHEN abs(dl) < 0.474 THEN 'medium' ELSE 'large' END AS magnitude FROM ("
      "SELECT *, (gt - lt) / (n * m)::DOUBLE AS dl FROM (SELECT p.pair, count(DISTINCT p.case_id) AS n, count(DISTINCT r.case_id) AS m, count(*) FILTER (p.a > r.b) AS gt, count(*) FILTER (p.a < r.b) AS lt FROM pr p JOIN pr r ON p.pair = r.pair GROUP BY p.pair))", PAIRS)
RANKS = ("rk AS MATERIALIZED (SELECT pair, d, rank() OVER (PARTITION BY pair ORDER BY abs(d)) + (count(*) OVER (PARTITION BY pair, abs(d)) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY pair, abs(d)) AS t "
         "FROM (SELECT pair, round(a - b, 4) AS d FROM pr) WHERE d <> 0), "
         "sm AS MATERIALIZED (SELECT pair, count(*) AS n, coalesce(sum(r) FILTER (d > 0), 0) AS w_pos, coalesce(sum(r) FILTER (d < 0), 0) AS w_neg, sum(t::DOUBLE * t - 1) AS ties FROM rk GROUP BY pair)")
cases("q_rank_biserial", "SELECT pair, n, w_pos, w_neg, round((w_pos - w_neg) / (w_pos + w_neg), 9) AS rank_biserial FROM sm", PAIRS, RANKS)
# erf by Simpson's rule on 1000 strips.
_ERF = ("2.0::DOUBLE / sqrt(pi()) * xx / 3000.0::DOUBLE * (SELECT sum((CASE WHEN i IN (0, 1000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) "
        "* exp(-(i * xx / 1000.0::DOUBLE) * (i * xx / 1000.0::DOUBLE))) FROM range(0, 1001) AS strips(i))")
cases("q_wilcoxon", f"SELECT pair, n, w, round(zz, 6) AS z, round(1.0::DOUBLE - {_ERF}, 5) + 0.0 AS p FROM (SELECT *, abs(zz) / sqrt(2.0::DOUBLE) AS xx FROM ("
      "SELECT pair, n, least(w_pos, w_neg) AS w, (least(w_pos, w_neg) - n::DOUBLE * (n + 1) / 4.0::DOUBLE) / sqrt(n::DOUBLE * (n + 1) * (2 * n + 1) / 24.0::DOUBLE - ties / 48.0::DOUBLE) AS zz FROM sm))", PAIRS, RANKS)
# All signs of up to 13 ranks, one row each.
SIGNS = ("sg(k, s) AS (SELECT 0, 0 UNION ALL SELECT k + 1, s + b * (k + 1) FROM sg, (VALUES (0), (1)) AS v(b) WHERE k < 13), "
         "wy AS MATERIALIZED (SELECT k, s, count(*) AS c FROM sg GROUP BY k, s), "
         "sz AS (SELECT pair, count(*) AS asked FROM pr GROUP BY pair)")
SQL["q_wilcoxon_exact"] = (
    f"WITH RECURSIVE {METRICS}, {PAIRS.replace('a.series || ' + chr(39) + ' vs ' + chr(39) + ' || b.series', 'a.series || ' + chr(39) + ' vs ' + chr(39) + ' || b.series || ' + chr(39) + ' #' + chr(39) + ' || (a.case_id % 10)')}, {RANKS}, {SIGNS} "
    f"SELECT pair, n, w, exact, CASE WHEN exact THEN round(least(1.0::DOUBLE, 2 * (SELECT sum(c) FROM wy WHERE k = n AND s <= w) / pow(2.0::DOUBLE, n)), 5) "
    f"ELSE round(1.0::DOUBLE - {_ERF}, 5) + 0.0 END AS p FROM (SELECT *, abs(zz) / sqrt(2.0::DOUBLE) AS xx FROM ("
    "SELECT pair, n, least(w_pos, w_neg) AS w, ties = 0 AND asked = n AND n <= 13 AS exact, (least(w_pos, w_neg) - n::DOUBLE * (n + 1) / 4.0::DOUBLE) "
    "/ sqrt(n::DOUBLE * (n + 1) * (2 * n + 1) / 24.0::DOUBLE - ties / 48.0::DOUBLE) AS zz FROM sm JOIN sz USING (pair)))")
cases("q_failed_sets", "SELECT a.series || ' vs ' || b.series AS pair, a.k AS n_a, b.k AS n_b, len(list_intersect(a.f, b.f)) AS n_shared, list_sort(a.f) = list_sort(b.f) AS equal, len(list_intersect(a.f, b.f)) = 0 AS disjoint FROM fs a JOIN fs b ON a.series < b.series",
      "fs AS MATERIALIZED (SELECT series, coalesce(list(case_id) FILTER (dice < 0.95), []) AS f, count(*) FILTER (dice < 0.95) AS k FROM m GROUP BY series)")
SQL["q_pair_semi"] = "SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)"
cases("q_training_best", "SELECT series, case_id, dice, coalesce(greatest(b, dice), dice) AS best, b IS NULL OR dice > b AS improved FROM (SELECT *, max(dice) OVER (PARTITION BY series ORDER BY case_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM m)")
SQL["q_early_stop"] = f"""WITH RECURSIVE {METRICS}, e AS MATERIALIZED (SELECT series, case_id, dice, row_number() OVER (PARTITION BY series ORDER BY case_id) AS i FROM m),
f AS (SELECT DISTINCT series, 0::BIGINT AS i, 0.0::DOUBLE AS best, 0::BIGINT AS pos FROM m UNION ALL
 SELECT f.series, e.i, CASE WHEN e.dice > f.best + 0.0001::DOUBLE THEN e.dice ELSE f.best END, CASE WHEN e.dice > f.best + 0.0001::DOUBLE THEN e.i ELSE f.pos END
 FROM f JOIN e ON e.series = f.series AND e.i = f.i + 1 WHERE f.i - f.pos < 12)
SELECT g.series, c.n AS epochs, g.best, b.case_id AS best_at, CASE WHEN g.i - g.pos >= 12 THEN a.case_id END AS stop_at
FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY series ORDER BY i DESC) = 1) g JOIN (SELECT series, count(*) AS n FROM m GROUP BY series) c USING (series)
LEFT JOIN e b ON b.series = g.series AND b.i = g.pos LEFT JOIN e a ON a.series = g.series AND a.i = g.i"""
cases("q_safety_rules", """SELECT * EXCLUDE (v, v2), CASE WHEN swapped THEN 'anchored' WHEN rescued THEN 'rescue' WHEN reverted THEN 'pyramid' ELSE 'wavefront' END AS source,
 CASE WHEN swapped THEN anchored ELSE v2 END AS final_voxels FROM (SELECT *, anchored >= 80 AND (v2 > floor(1.1::DOUBLE * anchored) OR (rescued AND v2 > floor(1.05::DOUBLE * anchored))) AS swapped FROM (
 SELECT *, CASE WHEN rescued THEN rescue ELSE v END AS v2 FROM (SELECT *, v < 100 AND rescue <= 300 AND rescue > v AS rescued FROM (SELECT *, CASE WHEN reverted THEN pyramid ELSE wavefront END AS v FROM (
 SELECT *, pyramid >= 200 AND (wavefront > floor(2.5::DOUBLE * pyramid) OR (wavefront > 60 AND wavefront > floor(0.4::DOUBLE * pyramid))) AS reverted FROM (
 SELECT case_id, CAST(sum(n) FILTER (series = 'A') AS BIGINT) AS wavefront, CAST(sum(n) FILTER (series = 'N') AS BIGINT) AS pyramid, CAST(sum(2 * n) FILTER (series = 'R') AS BIGINT) AS rescue,
 CAST(sum(n) FILTER (series = 'R') AS BIGINT) AS anchored FROM m GROUP BY case_id))))))""")
INDEX = ("ix AS MATERIALIZED (SELECT CAST(sum(1) OVER (ORDER BY case_id, z ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS BIGINT) AS row, case_id, z, has_airway, nz AS n_in_case FROM "
         f"(SELECT case_id, z, any_value(nz) AS nz, CAST(max(w) >= 3 AS INT) AS has_airway FROM (SELECT *, sum(CAST({TRUTH} AS INT)) OVER (PARTITION BY case_id, z, y ORDER BY x ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS w FROM vox) GROUP BY case_id, z))")
vox("q_slice_index", "SELECT * FROM ix", INDEX)
vox("q_bg_sample", "SELECT row, case_id, z, has_airway, n_in_case FROM (SELECT *, row_number() OVER (PARTITION BY case_id, has_airway ORDER BY (CAST(z AS BIGINT) * 2654435761 + case_id * 40503 + 5 * 7919) % 4294967296) AS r, "
    "sum(has_airway) OVER (PARTITION BY case_id) AS a FROM ix) WHERE has_airway = 1 OR r <= floor(a * 0.3::DOUBLE)", INDEX)
