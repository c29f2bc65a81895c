"""SQL, for an engine other than Spark, that gives the rows of the queries in ``plans.cloud``. It is written apart from the operators: nothing here is run by the library."""

from __future__ import annotations

from pointloom.sources.tables import POINTS_SQL

_PTS = f"pts as ({POINTS_SQL})"
_RANKED = "ranked as (select *, row_number() over (order by k1, k2, k3, k4, x, y, z) - 1 rn from pts)"
_CORNERS = ", ".join(f"max(case when rn % 4 = {i} then {v} end) {c}{v}" for i, c in enumerate("pqrs") for v in ("x", "y", "z")) + ", " + ", ".join(f"max(case when rn % 4 = {i} then src end) o{i + 1}" for i in range(4))
_CELLS = f"{_PTS}, {_RANKED}, cells as (select rn // 4 cell_id, {_CORNERS} from ranked group by rn // 4 having count(*) = 4)"
_U = {v: f"(q{v} - p{v})" for v in "xyz"}
_V = {v: f"(r{v} - p{v})" for v in "xyz"}
_W = {v: f"(s{v} - p{v})" for v in "xyz"}
_DET = f"({_U['x']} * ({_V['y']} * {_W['z']} - {_V['z']} * {_W['y']}) - {_U['y']} * ({_V['x']} * {_W['z']} - {_V['z']} * {_W['x']}) + {_U['z']} * ({_V['x']} * {_W['y']} - {_V['y']} * {_W['x']}))"


def _cross2(p: dict, q: dict) -> str:
    """The squared length of a cross product."""
    x, y, z = (f"({p[i]} * {q[j]} - {p[j]} * {q[i]})" for i, j in (("y", "z"), ("z", "x"), ("x", "y")))
    return f"({x} * {x} + {y} * {y} + {z} * {z})"


_SHARED = "shared as (select distinct cell_id, least(o1, o2, o3, o4) main_id, unnest([o1, o2, o3, o4]) as owner from cells)"
_EDGES = "edges as (select cast(a.n_nationkey as bigint) src, cast(b.n_nationkey as bigint) dst from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey)"


def _evidence(c: list[str], s: list[str], trust: str = "1e0") -> tuple[str, str]:
    """(empty, occupied) of a surface's point: distances along its axes and scales."""
    half = f"exp(-abs({c[2]}) / ({s[2]})) / 2"
    fade = f"exp(-pow(({c[0]}) / ({s[0]}), 2)) * exp(-pow(({c[1]}) / ({s[1]}), 2)) * exp(-pow(({c[2]}) / greatest({s[0]}, {s[1]}, {s[2]}), 2)) * {trust}"
    e = f"(case sign({c[2]}) when 1 then 1 - {half} when -1 then {half} else 5e-1 end) * {fade}"
    o = f"(case sign({c[2]}) when 1 then {half} when -1 then 1 - {half} else 5e-1 end) * {fade}"
    return e, o


def _scales(p: str) -> list[str]:
    return [f"10 + {p}z / 10", f"200 + {p}y / 10", f"1 + {p}x / 10"]


def _fold(name: str, source: str, key: str, steps: list[tuple[str, str]]) -> str:
    """CTEs that fold pairs of columns (empty, occupied) from nothing known; ``name`` has key, e, o, u."""
    ctes, before = [], f"(select *, 0e0 e, 0e0 o, 1e0 u from {source})"
    for i, (b, d) in enumerate(steps):
        # the evidence is regularised, then combined, then regularised again
        r = f"(select *, least(greatest({b}, 0e0), 1e0) rb, least(greatest({d}, 0e0), 1e0) rd from {before})"
        r = f"(select *, greatest(1 - rb - rd, 0e0) rw from {r})"
        r = f"(select *, rb / (rb + rd + rw) xe, rd / (rb + rd + rw) xo, rw / (rb + rd + rw) xu from {r})"
        r = f"(select *, 1 - (o * xe + e * xo) n from {r})"
        r = f"(select *, (e * xe + e * xu + u * xe) / n ce, (o * xo + o * xu + u * xo) / n co from {r})"
        r = f"(select *, least(greatest(ce, 0e0), 1e0) ge, least(greatest(co, 0e0), 1e0) go from {r})"
        r = f"(select *, greatest(1 - ge - go, 0e0) gu from {r})"
        drop = "e, o, u, rb, rd, rw, xe, xo, xu, n, ce, co, ge, go, gu"
        ctes.append(f"{name}_{i} as (select * exclude ({drop}), ge / (ge + go + gu) e, go / (ge + go + gu) o, gu / (ge + go + gu) u from {r})")
        before = f"{name}_{i}"
    return ", ".join(ctes) + f", {name} as (select {key}, e, o, u from {before})"


_CENTRE = "centred as (select *, (px + qx + rx + sx) / 4 gx, (py + qy + ry + sy) / 4 gy, (pz + qz + rz + sz) / 4 gz from cells)"
_MASS = f"{_CENTRE}, " + _fold("mass", "centred", "cell_id, o1, o2, o3, o4", [_evidence([f"gx - {c}x", f"gy - {c}y", f"gz - {c}z"], _scales(c)) for c in "pqrs"])
_ROUNDED = "round(e, 8) e, round(o, 8) o, round(u, 8) u"
_STATS = "stats as (select k1 % 97 tile_id, count(*) nv, cast(sum(k2) as bigint) nf, cast(sum(k3 % 5) as bigint) nc from pts group by k1 % 97)"

#: The voxels of the cloud's grid, whether they are full, and their six cells by the turns of the axes.
_GRID = (
    f"{_PTS}, box as (select {', '.join(f'min({a}) {a}0, max({a}) {a}1' for a in 'xyz')} from pts), "
    + "filled as (select " + " + ".join(f"cast(least(floor(({a} - {a}0) * 8 / case when {a}1 > {a}0 then {a}1 - {a}0 else 1 end), 7) as bigint) * {m}" for a, m in (("x", 64), ("y", 8), ("z", 1))) + " v, count(*) n from pts cross join box group by 1), "
    + "voxels as (select range v, range // 64 i, range // 8 % 8 j, range % 8 k, coalesce(n, 0) n, avg(coalesce(n, 0)) over () mean from range(512) left join filled on v = range), "
    + "turns(turn, a1, a2) as (values (0, 0, 1), (1, 0, 2), (2, 1, 0), (3, 1, 2), (4, 2, 0), (5, 2, 1)), "
    + "vc as (select v * 6 + turn cell_id, v, turn, i, j, k, n, mean, case when n > mean then 0 else 1 end label, i * 81 + j * 9 + k a, "
    + "case a1 when 0 then 81 when 1 then 9 else 1 end s1, case a2 when 0 then 81 when 1 then 9 else 1 end s2 from voxels cross join turns), "
    + "vcells as (select cell_id, v, turn, n, mean, label, a, a + s1 b, a + s1 + s2 c, a + 91 d from vc), "
    + "vfacets as (select cell_id, label, n, mean, unnest([{'u': b, 'v': c, 'w': d, 'o': a}, {'u': a, 'v': c, 'w': d, 'o': b}, {'u': a, 'v': b, 'w': d, 'o': c}, {'u': a, 'v': b, 'w': c, 'o': d}], recursive := true) from vcells)"
)
_WALLS = (
    "walls as (select u, v, w, min(cell_id) a, max(cell_id) b, min(label) l0, max(label) l1 from vfacets group by u, v, w having count(*) = 2), "
    # facets with both ends of a voxel's main diagonal go through its centre; the others are halves of a voxel's side
    "weighed as (select *, case when w - u = 91 then 2 * sqrt(2e0) / 2 + 5e-2 * 3 else 2 * 5e-1 * sqrt(2e0 / 3) + 5e-2 * 2 end weight from walls)"
)
_OCTANT = "(case when {0} // 81 >= 4 then 4 else 0 end + case when {0} // 9 % 9 >= 4 then 2 else 0 end + case when {0} % 9 >= 4 then 1 else 0 end)"
_OWNED = f"corner_rows as (select cell_id, unnest([a, b, c, d]) id from vcells), owned as (select cell_id, id, cast({_OCTANT.format('id')} as bigint) o from corner_rows)"
_AT = lambda n: (f"({n} // 81)", f"({n} // 9 % 9)", f"({n} % 9)")


def _facing() -> str:
    """The sign of the determinant of the full cell's opposite corner seen from a facet."""
    u, v, w, o = (_AT(n) for n in ("u", "v", "w", "o"))
    e, f, g = ([f"({p[i]} - {u[i]})" for i in range(3)] for p in (v, w, o))
    return f"(({e[1]} * {f[2]} - {e[2]} * {f[1]}) * {g[0]} + ({e[2]} * {f[0]} - {e[0]} * {f[2]}) * {g[1]} + ({e[0]} * {f[1]} - {e[1]} * {f[0]}) * {g[2]})"


_BUFFER = "select cast(floor(x / 100) as bigint) + a ti, cast(floor(y / 100) as bigint) + b tj, a = 0 and b = 0 own, x, y from pts cross join (select unnest([-1, 0, 1]) a) cross join (select unnest([-1, 0, 1]) b)"

SQL: dict[str, str] = {
    "tile_overflow": f"with {_PTS}, t as (select k4 tile_id, count(*) n from pts group by k4) select tile_id, n, case when n > 620 then 1 else 0 end overflows from t where n >= 50",
    "tile_totals": f"with {_PTS}, t as (select k4 tile_id, count(*) n from pts group by k4) select cast(sum(n) as bigint) total, max(n) largest, min(n) smallest, count(*) tiles from t",
    "ndtree_ids": "with ids as (select distinct cast(l_partkey % 4096 as bigint) id from lineitem), c as (select id, id // 256 i, id // 16 % 16 j, id % 16 k from ids) select id, i, j, k, i * 256 + j * 16 + k back, i // 2 * 64 + j // 2 * 8 + k // 2 parent from c",
    "id_prefix_sum": f"with {_PTS}, {_STATS} select a.tile_id, " + ", ".join(f"cast(coalesce(sum(b.{c}), 0) as bigint) {c}_offset" for c in ("nv", "nf", "nc")) + " from stats a left join stats b on b.tile_id < a.tile_id group by a.tile_id",
    "auto_depth": f"with {_PTS}, t as (select src, count(*) n from pts group by src) select src, n, cast(greatest(round(ln(n / 1e1) / ln(3e0)), 0) as bigint) depth from t",
    "percentile_scale": f"with {_PTS}, s as (select list(y order by y) l from pts) select share, l[least(cast(floor(len(l) * share) as bigint), len(l) - 1) + 1] \"scale\" from s cross join (select unnest([1e-1, 75e-2]) share)",
    "extreme_points": f"with {_PTS}, r as (select src, k1, k2, k3, k4, x, y, z, " + ", ".join(f"row_number() over (partition by src order by {a} {d}, k1, k2, k3, k4) {a}{d}" for a in "xyz" for d in ("asc", "desc")) + " from pts) select src, k1, k2, k3, k4, x, y, z from r where " + " or ".join(f"{a}{d} = 1" for a in "xyz" for d in ("asc", "desc")),
    "octree_lod_levels": f"with {_PTS}, b as (select min(x) x0, min(y) y0, min(z) z0, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) side from pts), l(lvl, w) as (values (0, 1), (1, 2), (2, 4), (3, 8)), k as (select lvl, " + ", ".join(f"cast(least(floor(({a} - {a}0) * w / side), w - 1) as bigint) i{a}" for a in "xyz") + ", x, y, z from pts cross join b cross join l) select lvl, ix, iy, iz, count(*) n, min(x) xmin, max(x) xmax, min(y) ymin, max(y) ymax, min(z) zmin, max(z) zmax from k group by lvl, ix, iy, iz",
    "mail_delivery": "select cast(o_orderkey as bigint) tile_id, (select count(*) from lineitem where l_orderkey = o_orderkey) n_mail, cast((select min(l_linenumber) from lineitem where l_orderkey = o_orderkey) as bigint) first_line, cast((select max(l_partkey) from lineitem where l_orderkey = o_orderkey) as bigint) last_part from orders",
    "mail_split_semi": "select cast(o_orderkey as bigint) tile_id from orders where o_orderkey in (select l_orderkey from lineitem)",
    "mail_split_anti": "select cast(o_orderkey as bigint) tile_id from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)",
    "deliver_or_retain": f"with {_EDGES} select 'deliver' how, dst tile_id, count(*) n from edges group by dst union all select 'retain', src, count(*) from edges group by src",
    "triplets": f"with {_EDGES} select src, dst, a.n_name src_name, b.n_name dst_name, cast(a.n_regionkey as bigint) attr from edges join nation a on src = a.n_nationkey join nation b on dst = b.n_nationkey",
    "canonical_edges": "with e as (select cast(o_custkey % 50 as bigint) s, cast(o_orderkey % 50 as bigint) d from orders) select distinct least(s, d) src, greatest(s, d) dst from e where s <> d",
    "collect_neighbors": f"with {_EDGES}, ways as (select src v, dst u from edges union select dst, src from edges) select v, string_agg(cast(u as varchar), ',' order by u) neighbours from ways group by v",
    "grouped_values": "select cast(l_orderkey as bigint) tile_id, string_agg(cast(l_linenumber as varchar), ',' order by l_linenumber) vals from lineitem group by l_orderkey",
    "clique_two_hop": f"with {_EDGES}, ways as (select src v, dst u from edges union all select dst, src from edges) select a.v, count(distinct e.src * 100 + e.dst) n_edges from ways a join edges e on (e.src = a.u or e.dst = a.u) and e.src <> a.v and e.dst <> a.v group by a.v",
    "update_vertices": f"with {_EDGES} select cast(n_nationkey as bigint) id, (select count(*) from edges where dst = n_nationkey) attr from nation",
    "bbox_intersections": f"with {_PTS}, b as (select k4 id, min(x) x0, max(x) x1, min(y) y0, max(y) y1 from pts group by k4) select p.id a, q.id b from b p join b q on p.id < q.id and p.x0 <= q.x1 and q.x0 <= p.x1 and p.y0 <= q.y1 and q.y0 <= p.y1",
    "sent_once": f"with {_PTS}, n as (select src, k4 % 5 dst, x, y, z from pts except select src, k4 % 5, x, y, z from pts where k2 = 1) select src, dst, count(*) n from n group by src, dst",
    "union_bag": f"with {_PTS} select src, cast(sum(case when x < 10 then 1 else 0 end + case when y < 100 then 1 else 0 end) as bigint) n from pts where x < 10 or y < 100 group by src",
    "distinct_leaves": f"with {_PTS} select count(distinct (src, x)) n from pts",
    "simplex_metrics": f"with {_CELLS} select cell_id, abs({_DET}) / 6 volume, (px + qx + rx + sx) / 4 gx, (py + qy + ry + sy) / 4 gy, (pz + qz + rz + sz) / 4 gz, sqrt({_cross2(_U, _V)}) / 2 area_pqr, cast(sign({_DET}) as int) orientation from cells",
    "squared_distances": f"with {_CELLS} select cell_id, " + ", ".join(f"pow({p}x - {q}x, 2) + pow({p}y - {q}y, 2) + pow({p}z - {q}z, 2) d_{p}{q}" for p, q in ("pq", "pr", "ps", "qr", "qs", "rs")) + " from cells",
    "axis_projection": f"with {_CELLS} select cell_id, round((({_W['x']}) * ({_U['x']}) + ({_W['y']}) * ({_U['y']}) + ({_W['z']}) * ({_U['z']})) / (({_U['x']}) * ({_U['x']}) + ({_U['y']}) * ({_U['y']}) + ({_U['z']}) * ({_U['z']})), 9) + 0e0 coef from cells where px <> qx or py <> qy or pz <> qz",
    # the centre solves three linear equations, here by Cramer's rule
    "circumsphere_filter": f"with {_CELLS}, e as (select *, {_DET} det, "
    + ", ".join(f"({u['x']} * {u['x']} + {u['y']} * {u['y']} + {u['z']} * {u['z']}) / 2 h{i}" for i, u in enumerate((_U, _V, _W)))
    + " from cells), k as (select *, "
    + f"(h0 * ({_V['y']} * {_W['z']} - {_V['z']} * {_W['y']}) - {_U['y']} * (h1 * {_W['z']} - {_V['z']} * h2) + {_U['z']} * (h1 * {_W['y']} - {_V['y']} * h2)) / det dx, "
    + f"({_U['x']} * (h1 * {_W['z']} - {_V['z']} * h2) - h0 * ({_V['x']} * {_W['z']} - {_V['z']} * {_W['x']}) + {_U['z']} * ({_V['x']} * h2 - h1 * {_W['x']})) / det dy, "
    + f"({_U['x']} * ({_V['y']} * h2 - h1 * {_W['y']}) - {_U['y']} * ({_V['x']} * h2 - h1 * {_W['x']}) + h0 * ({_V['x']} * {_W['y']} - {_V['y']} * {_W['x']})) / det dz from e where det <> 0), "
    + "s as (select *, px + dx cx, py + dy cy, pz + dz cz, sqrt(dx * dx + dy * dy + dz * dz) r from k) select cell_id, round(2 * ln(r), 7) log_r2, "
    + "cx - r >= 0 and cx + r <= 50 and cy - r >= 0 and cy + r <= 600 and cz - r >= 0 and cz + r <= 100 inside, "
    + "pow(cx - least(greatest(cx, 0), 50), 2) + pow(cy - least(greatest(cy, 0), 600), 2) + pow(cz - least(greatest(cz, 0), 100), 2) <= r * r touches, "
    + " and ".join(f"(({_U['y']} * {_V['z']} - {_U['z']} * {_V['y']}) * ({x} - px) + ({_U['z']} * {_V['x']} - {_U['x']} * {_V['z']}) * ({y} - py) + ({_U['x']} * {_V['y']} - {_U['y']} * {_V['x']}) * ({z} - pz)) > 0" for x in (0, 50) for y in (0, 600) for z in (0, 100))
    + " beyond from s",
    "angles": f"with {_CELLS}, d as (select cell_id, (px - qx) * (rx - qx) + (py - qy) * (ry - qy) + (pz - qz) * (rz - qz) uv, pow(px - qx, 2) + pow(py - qy, 2) + pow(pz - qz, 2) uu, pow(rx - qx, 2) + pow(ry - qy, 2) + pow(rz - qz, 2) vv from cells) select cell_id, round(acos(greatest(-1, least(1, uv / (sqrt(uu) * sqrt(vv))))), 8) angle from d where uu > 0 and vv > 0",
    "ownership_main": f"with {_CELLS} select cell_id, least(o1, o2, o3, o4) main_id, case when o1 = o2 and o2 = o3 and o3 = o4 then 'local' else 'mixed' end kind from cells",
    "simplex_counts": f"with {_CELLS}, {_SHARED} select owner tile_id, count(*) n_cells, cast(sum(case when owner = main_id then 1 else 0 end) as bigint) n_main from shared group by owner",
    "shared_cell_owners": f"with {_CELLS}, {_SHARED} select a.owner tile_k, b.owner tile_l, count(*) n_cells, min(a.cell_id) first_cell from shared a join shared b on a.cell_id = b.cell_id and a.owner <> b.owner group by a.owner, b.owner",
    "main_first_numbers": f"with {_CELLS}, {_SHARED} select owner tile_id, cell_id, row_number() over (partition by owner order by owner <> main_id, cell_id) - 1 lid from shared",
    "global_cell_ids": f"with {_CELLS}, m as (select cell_id, least(o1, o2, o3, o4) tile_id from cells) select cell_id, tile_id, row_number() over (order by tile_id, cell_id) - 1 gid from m",
    "local_id_map": f"with {_CELLS}, {_SHARED}, n as (select *, row_number() over (partition by owner order by owner <> main_id, cell_id) - 1 lid from shared) select a.owner tile_k, b.owner tile_l, count(*) n, cast(sum(a.lid) as bigint) sum_k, cast(sum(b.lid) as bigint) sum_l from n a join n b on a.cell_id = b.cell_id and a.owner <> b.owner group by a.owner, b.owner",
    "filled_labels": f"with {_CELLS}, {_SHARED}, n as (select *, row_number() over (partition by owner order by owner <> main_id, cell_id) - 1 lid from shared), g as (select cell_id, (row_number() over (order by least(o1, o2, o3, o4), cell_id) - 1) % 3 label from cells) select owner tile_id, label, count(*) n, cast(sum(lid) as bigint) lids from n join g on n.cell_id = g.cell_id group by owner, label",
    "label_disagreement": f"with {_CELLS}, {_SHARED}, lab as (select cell_id, owner, (cell_id + owner) % 2 label from shared) select a.owner tile_id, cast(sum(case when a.label <> b.label then 1 else 0 end) as bigint) differing, count(*) total from lab a join lab b on a.cell_id = b.cell_id and a.owner <> b.owner group by a.owner",
    "weighted_disagreement": f"with {_CELLS} select cast(sum(case when cell_id % 2 % 2 <> cell_id % 3 % 2 then 1 else 0 end) as bigint) differing, count(*) total, round(sum(case when cell_id % 2 % 2 <> cell_id % 3 % 2 then ln(1 + abs({_DET}) / 6) else 0 end), 4) weighted from cells",
    "lagrange_update": f"with {_CELLS}, {_SHARED}, v as (select cell_id, ln(1 + abs({_DET}) / 6) * 10 tau from cells), p as (select a.cell_id, a.owner k, b.owner l, tau, case when a.owner < b.owner then 1 else -1 end way from shared a join shared b on a.cell_id = b.cell_id and a.owner <> b.owner join v on v.cell_id = a.cell_id), "
    "f as (select *, way * ((cell_id + k) % 2 - (cell_id + l) % 2) d1, way * ((cell_id + 3 * k) // 3 % 2 - (cell_id + 3 * l) // 3 % 2) d2 from p), g as (select *, tau * d1 lag1, case when d1 <> 0 then tau / 2 else tau end tau1 from f) "
    "select cell_id, k tile_k, l tile_l, round(lag1 + tau1 * d2, 6) + 0e0 lagrange, round(case when d2 <> d1 then tau1 / 2 else tau1 end, 6) tau, cast(d2 as bigint) diff from g",
    "shared_costs": f"with {_CELLS}, {_SHARED}, {_MASS}, h as (select cell_id, count(*) holders from shared group by cell_id), s as (select owner, cell_id, holders, (select count(*) from shared t where t.cell_id = s.cell_id and t.owner < s.owner) - (select count(*) from shared t where t.cell_id = s.cell_id and t.owner > s.owner) net from shared s join h using (cell_id)), "
    "c as (select owner tile_id, m.cell_id, holders, net * (m.cell_id % 7 - 3) push, e + abs(1 - o) + u cost0, abs(1 - e) + o + u cost1 from s join mass m on m.cell_id = s.cell_id) select tile_id, cell_id, round(cost0 / holders + greatest(push, 0), 7) cost0, round(cost1 / holders + greatest(-push, 0), 7) cost1 from c",
    "cell_evidence": f"with {_CELLS}, {_MASS} select cell_id, {_ROUNDED} from mass",
    "evidence_exchange": f"with {_CELLS}, {_SHARED}, {_MASS} select owner tile_id, m.cell_id, {_ROUNDED} from shared s join mass m on m.cell_id = s.cell_id",
    "mass_regularize": f"with {_CELLS}, {_MASS}, c as (select cell_id, least(greatest(e * 3, 0), 1) e, least(greatest(o * 3 - 1e-1, 0), 1) o from mass), d as (select cell_id, e, o, greatest(1 - e - o, 0) u from c) select cell_id, round(e / (e + o + u), 8) e, round(o / (e + o + u), 8) o, round(u / (e + o + u), 8) u from d",
    "mass_surface": (lambda ev: f"with {_PTS}, m as (select k1, k2, k3, k4, {ev[0]} e, {ev[1]} o from pts), r as (select k1, k2, k3, k4, e, o, greatest(1 - e - o, 0) u from m) select k1, k2, k3, k4, round(e / (e + o + u), 8) e, round(o / (e + o + u), 8) o, round(u / (e + o + u), 8) u from r")(
        _evidence(["25 - x", "300 - y", "40 - z"], _scales(""), f"greatest(1e-6, least(1, 205 / greatest({', '.join(_scales(''))})))")
    ),
    "mass_beam": f"with {_PTS}, m as (select *, case when x > 10 then 1 - exp((10 - x) / (2 * (1 + z / 10))) else 0 end e from pts) select k1, k2, k3, k4, round(e, 8) e, 0e0 o, round(1 - e, 8) u from m",
    "ds_fusion": f"with {_CELLS}, {_MASS}, ranked_cells as (select cell_id % 500 grp, e me, o mo, row_number() over (partition by cell_id % 500 order by cell_id) turn from mass), wide as (select grp, "
    + ", ".join(f"coalesce(max(case when turn = {i} then me end), 0) e{i}, coalesce(max(case when turn = {i} then mo end), 0) o{i}" for i in range(1, 6))
    + " from ranked_cells group by grp), "
    + _fold("fused", "wide", "grp", [(f"e{i}", f"o{i}") for i in range(1, 6)])
    + f" select grp, {_ROUNDED} from fused",
    "robust_kernels": f"with {_PTS} select distinct x, round(exp(-pow(x / 20, 2)), 9) score_pdf, round(2 * (sqrt(1 + x) - 1), 9) m_estimator, round(1 / sqrt(1 + x), 9) dm_estimator, round(exp(1 - sqrt(1 + x)), 9) m_pdf from pts",
    "dimensionality": f"with {_PTS}, s as (select distinct greatest(x, y, z) + 3 s1, x + y + z - greatest(x, y, z) - least(x, y, z) + 2 s2, least(x, y, z) + 1 s3 from pts), d as (select *, (s1 - s2) / (s1 + s2 + s3) d1, (s2 - s3) / (s1 + s2 + s3) d2, s3 / (s1 + s2 + s3) d3 from s) select s1, s2, s3, round(d1, 9) d1, round(d2, 9) d2, round(d3, 9) d3, round(-(d1 * ln(d1) + d2 * ln(d2) + d3 * ln(d3)), 8) entropy from d",
    "unary_cost": f"with {_CELLS}, {_MASS} select cell_id, round(abs(1 - e) + o + u, 7) cost_empty, round(e + abs(1 - o) + u, 7) cost_full from mass",
    "surface_facets": f"with {_GRID}, rim as (select u, v, w, max(case when label = 0 then o end) o from vfacets group by u, v, w having sum(1 - label) = 1) select u v0, v v1, w v2, case when {_facing()} < 0 then 1 else -1 end turn from rim",
    "open_surface": f"with {_GRID}, rim as (select u from vfacets group by u, v, w having count(*) = 2 and sum(label) = 1) select cast({_OCTANT.format('u')} as bigint) tile_id, count(*) n from rim group by 1",
    "dual_facets": f"with {_GRID} select u, v, w, min(o) \"first\", max(o) \"second\" from vfacets group by u, v, w",
    "facet_weights": f"with {_GRID}, {_WALLS} select u, v, w, a, b, cast(len(list_distinct([{', '.join(_OCTANT.format(c) for c in 'uvw')}])) as int) holders, round(weight, 8) weight from weighed",
    "energy": f"with {_GRID}, {_WALLS}, c as (select sum(case when label = 1 then n / greatest(mean, 1) else 1 end) unary from vcells), p as (select sum(case when l0 <> l1 then weight else 0 end) pairwise from weighed) select round(unary, 6) unary, round(pairwise, 6) pairwise, round(unary + pairwise, 6) total from c cross join p",
    "flooded_cells": "with recursive " + f"{_GRID}, {_WALLS}, steps as (select a, b from walls where l0 = l1 union all select b, a from walls where l0 = l1), reached as (select min(cell_id) cell_id from vcells where label = 1 union select b from steps join reached on a = cell_id) select cell_id from reached",
    # six cells of a voxel are told apart by the order of a point's three fractions; the least of the cells that touch it
    "located_points": f"with {_PTS}, q as (select x / 8 x, (y % 64) / 8 y, (z % 64) / 8 z from pts), near as (select row_number() over () n, x, y, z from q), "
    "boxes as (select n, x - i fx, y - j fy, z - k fz, (i * 64 + j * 8 + k) v from near cross join (select unnest([0, 1]) a) cross join (select unnest([0, 1]) b) cross join (select unnest([0, 1]) c) cross join lateral (select cast(floor(x) - case when x = floor(x) then a else 0 end as bigint) i, cast(floor(y) - case when y = floor(y) then b else 0 end as bigint) j, cast(floor(z) - case when z = floor(z) then c else 0 end as bigint) k) where i between 0 and 7 and j between 0 and 7 and k between 0 and 7), "
    "hit as (select n, min(v * 6 + case when fx >= fy and fy >= fz then 0 when fx >= fz and fz >= fy then 1 when fy >= fx and fx >= fz then 2 when fy >= fz and fz >= fx then 3 when fz >= fx and fx >= fy then 4 else 5 end) cell_id from boxes group by n) select cell_id, count(*) n from hit group by cell_id",
    "neighbour_mail": f"with {_GRID}, {_OWNED}, m as (select distinct x.o src, y.o dst, x.id from owned x join owned y on x.cell_id = y.cell_id and x.o <> y.o) select src, dst, count(*) n, cast(sum(id) as bigint) ids from m group by src, dst",
    "tile_edges": f"with {_GRID}, {_OWNED}, t as (select distinct x.cell_id, x.o src, y.o dst from owned x join owned y on x.cell_id = y.cell_id and x.o < y.o) select src, dst, count(*) n from t group by src, dst",
    "cell_tile_boxes": f"with g as (select range id, range // 81 x, range // 9 % 9 y, range % 9 z from range(729)) select cast({_OCTANT.format('id')} as bigint) tile_id, count(*) n, " + ", ".join(f"cast(min({a}) as double) {a}min, cast(max({a}) as double) {a}max" for a in "xyz") + " from g group by 1",
    "cell_rings": f"with {_GRID}, {_OWNED}, r as (select distinct x.id, y.id other from owned x join owned y on x.cell_id = y.cell_id and x.id <> y.id) select id, count(*) n, cast(sum(other) as bigint) others from r group by id",
    "merge_graph": f"with {_GRID}, {_WALLS}, {_OWNED}, m as (select cell_id, min(o) m from owned group by cell_id) select concat(least(x.m, y.m), '-', greatest(x.m, y.m)) tiles, count(*) n from walls join m x on a = x.cell_id join m y on b = y.cell_id where x.m <> y.m group by 1",
    "cell_faults": "select unnest(['facet', 'repeated', 'corners', 'flat']) kind, cast(0 as bigint) n",
    # all cells of a voxel have its centre for their own
    "voronoi_lines": f"with {_GRID}, {_WALLS} select case when a // 6 = b // 6 then 0e0 else 1e0 end length, count(*) n, cast(sum(a) as bigint) firsts from walls group by 1",
    "cell_soup": f"with {_GRID}, {_OWNED} select false main_only, o tile_id, count(distinct cell_id) n from owned group by o union all select true, m, count(*) from (select cell_id, min(o) m from owned group by cell_id) group by m",
    "mesh_reindex": f"with {_PTS}, v as (select distinct x, y from pts) select x, y, dense_rank() over (order by x, y) - 1 vertex_id from v",
    "cell_triangles": f"with {_GRID}, t as (select min(cell_id) cell_id from vfacets group by u, v, w) select cell_id, count(*) n from t group by cell_id",
    "scanline_segments": "with e as (select cast(user_id % 16 as bigint) strip, user_id, ts, event_id, floor(value) v, floor(epoch_us(cast(ts as timestamp)) / 36e8) h from events), "
    "g as (select *, lag(user_id) over w lu, lag(v) over w lv, lag(h) over w lh, lag(v, 2) over w lv2 from e window w as (partition by strip order by user_id, ts, event_id)), "
    "f as (select *, case when lu is null or lu <> user_id or (v - lv) * (v - lv) + (h - lh) * (h - lh) > 90000 or coalesce((v - lv) * (lv - lv2) < 0 and abs(v - lv) > 300, false) then 1 else 0 end cut from g), "
    "s as (select *, cast(sum(cut) over (partition by strip order by user_id, ts, event_id rows between unbounded preceding and current row) as bigint) segment from f) select strip, segment, count(*) n, min(event_id) first_id, max(event_id) last_id from s group by strip, segment",
    "line_of_sight_fallback": f"with {_PTS}, s as (select k1, avg(x) mx, avg(y) my, max(z) + 2 * (max(x) - min(x)) mz from pts group by k1) select p.k1, k2, k3, k4, round(mx - x, 6) + 0e0 lx, round(my - y, 6) + 0e0 ly, round(mz - z, 6) + 0e0 lz from pts p join s on p.k1 = s.k1",
    "sensor_default": f"with {_PTS} select k1, k2, k3, k4, x x_origin, y y_origin, case when k2 = 1 then z * 2 else z + 30 end z_origin from pts",
    "local_origin": f"with {_PTS} select k1, k2, k3, k4, x - 1 x, y - 2 y, z - 3 z, x + 25e0 * k2 - 1 x_origin, y + 48 y_origin, z + 97 z_origin from pts",
    "flipped_normals": f"with {_PTS}, t as (select k1, k2, k3, k4, k2 - 3e0 nx, 1e0 ny, k3 % 5 - 2e0 nz, (25 - x) * (k2 - 3) + (300 - y) + (1000 - z) * (k3 % 5 - 2) d from pts) select k1, k2, k3, k4, " + ", ".join(f"case when d < 0 then -n{a} else n{a} end + 0e0 n{a}" for a in "xyz") + " from t",
    "nearest_center": f"with {_PTS}, d as (select list_transform([0, 1, 2, 3, 4], lambda i: pow(x - 10 * i - 5, 2) + pow(y - 190 * i - 95, 2)) l from pts) select cast(list_position(l, list_min(l)) - 1 as bigint) centre, count(*) n from d group by 1",
    "lloyd_step": f"with {_PTS}, c as (select i, 10 * i + 5 cx, 190 * i + 95 cy from (select unnest([0, 1, 2, 3, 4]) i)), d as (select p.*, i, (x - cx) * (x - cx) + (y - cy) * (y - cy) d2 from (select *, row_number() over () line from pts) p cross join c), n as (select *, row_number() over (partition by line order by d2, i) rn from d) select cast(i as bigint) vertex, count(*) n, round(sum(x) / count(*), 8) x, round(sum(y) / count(*), 8) y, round(sum(z) / count(*), 8) z from n where rn = 1 group by i",
    "pca_covariance": f"with {_PTS} select src, count(*) n, " + ", ".join(f"round(covar_pop({p}, {q}), 4) c{p}{q}" for p, q in ("xx", "xy", "yy", "xz", "yz", "zz")) + " from pts group by src",
    "bit_flags": f"with {_PTS} select k3 // 4 % 2 = 1 two, k3 % 2 = 1 and k3 // 4 % 2 = 1 \"both\", k3 % 2 = 1 or k3 // 4 % 2 = 1 any_of, count(*) n, cast(sum(k3 | 4) as bigint) sum_with, cast(sum(k3 - k3 // 4 % 2 * 4) as bigint) sum_without from pts group by 1, 2, 3",
    "random_cloud": "select range tile_id, range // 16 cx, range // 4 % 4 cy, range % 4 cz, cast(1562 as bigint) n from range(64)",
    "attr_count": "select cast(l_linenumber as bigint) attr, count(*) n from lineitem group by l_linenumber",
    "attr_replace": "select cast(l_linenumber as bigint) old_value, cast(case l_linenumber when 1 then 11 when 2 then 12 else l_linenumber end as bigint) new_value, count(*) n from lineitem group by l_linenumber",
    "buffer_tag": f"with {_PTS} select case when x between 10 and 40 and y between 100 and 600 then 1 else 0 end in_original, count(*) n, cast(sum(k2) as bigint) lines from pts where x between 5 and 45 and y between 50 and 650 group by 1",
    "buffered_tiles": f"with {_PTS}, b as ({_BUFFER}) select ti tile_i, tj tile_j, count(*) n, count(*) filter (where own) own from b where x >= ti * 100 - 20 and x <= ti * 100 + 120 and y >= tj * 100 - 20 and y <= tj * 100 + 120 group by ti, tj",
    "crop_bounds": f"with {_PTS} select k1, k2, k3, k4, x, y, z from pts where x between 10 and 20 and y between 100 and 200 and z between 0 and 50",
    "cloud_info": f"with {_PTS} select src, count(*) n, min(x) xmin, max(x) xmax, min(y) ymin, max(y) ymax, min(z) zmin, max(z) zmax, count(distinct k4) sources from pts group by src",
    "colour_to_bytes": "select distinct cast(floor(l_extendedprice) as bigint) % 65536 v16, cast(floor(l_extendedprice) as bigint) % 65536 // 256 v8 from lineitem",
    "raster_colours": f"with {_PTS}, p as (select cast(floor((1000 - y) / 10) as bigint) r, cast(floor(x / 10) as bigint) c from pts) select case when r between 0 and 39 and c between 0 and 4 then (r * 5 + c) * 7 % 256 end red, count(*) n from p group by 1",
    "iter_stats": f"with {_PTS}, s as (select k2 it, cast(sum(case when x > 25 then 1 else 0 end) as bigint) a, count(*) b from pts group by k2) select it, a, b, round(cast(a as double) / b, 9) rate from s",
    "timing_sums": "select event_type \"label\", cast(sum(cast(floor(value * 100) as bigint)) as bigint) total from events group by event_type",
    "path_clean": "select page_id, regexp_replace(url, '^[a-z]+:/+', '') cleaned, length(url) n, case when length(translate(url, '0123456789', '')) = length(url) then 0 else 1 end has_digit, regexp_extract(regexp_replace(url, '\\s+', '', 'g'), '[^/]*$') base from pages",
    "last_int_in_name": "select page_id, try_cast(list_extract(regexp_extract_all(regexp_extract(url, '[^/]*$'), '[0-9]+'), -1) as bigint) number from pages",
    "bbox_parse": "select cast(p_partkey as bigint) id, cast(p_partkey % 90 as double) xmin, cast(p_size + 100 as double) xmax, 0e0 ymin, cast(p_size + 100 as double) ymax, cast(p_partkey % 90 as double) zmin, 9995e-1 zmax from part",
    "param_expand": "with p(lam) as (values (1), (10)), q(mode) as (values ('a'), ('b'), ('c')) select cast(lam as bigint) lam, mode, cast(3 as bigint) depth, row_number() over (order by lam desc, mode) run from p cross join q",
    "tile_boxes": f"with {_PTS}, b as (select src, " + ", ".join(f"min({a}) {a}0, max({a}) {a}1" for a in "xyz") + " from pts group by src) select src, concat_ws(' ', " + ", ".join(f"cast({a}0 + {a}1 as bigint)" for a in "xyz") + ", cast(x1 - x0 as bigint), 0, 0, 0, cast(y1 - y0 as bigint), 0, 0, 0, cast(z1 - z0 as bigint)) box, "
    "(x0 between 1e-9 and 50.499 or x1 between 1e-9 and 50.499) and (y0 between 1e-9 and 899.99 or y1 between 1e-9 and 899.99) and (z0 between -0.99 and 199.99 or z1 between -0.99 and 199.99) touches, x0 > 0 and x1 < 50.5 and y0 > 0 and y1 < 900 and z0 > -1 and z1 < 200 inside from b",
}


def _two_state(rounds: int) -> str:
    """Belief propagation on two states over the same-region graph, from messages (1, 1); factor .7 for equal and .3 for different states."""
    ctes = [
        f"with {_EDGES}",
        "prior as (select cast(n_nationkey as bigint) id, (1 + n_nationkey % 7) * 1e-1 p0, 1 - (1 + n_nationkey % 7) * 1e-1 p1 from nation)",
        "m0 as (select src, dst, 1e0 a, 1e0 b from edges union all select dst, src, 1e0, 1e0 from edges)",
        "b0 as (select id, p0, p1 from prior)",
    ]
    for i in range(1, rounds + 1):
        # a message leaves out what came back along its edge
        ctes.append(f"r{i} as (select m.src, m.dst, 7e-1 * (v.p0 / w.a) + 3e-1 * (v.p1 / w.b) x, 3e-1 * (v.p0 / w.a) + 7e-1 * (v.p1 / w.b) y from m{i - 1} m join b{i - 1} v on v.id = m.src join m{i - 1} w on w.src = m.dst and w.dst = m.src)")
        ctes.append(f"m{i} as (select src, dst, x / (x + y) a, y / (x + y) b from r{i})")
        ctes.append(f"s{i} as (select p.id, ln(p.p0) + coalesce(sum(ln(m.a)), 0e0) l0, ln(p.p1) + coalesce(sum(ln(m.b)), 0e0) l1 from prior p left join m{i} m on m.dst = p.id group by p.id, p.p0, p.p1)")
        ctes.append(f"b{i} as (select id, exp(l0 - greatest(l0, l1)) p0, exp(l1 - greatest(l0, l1)) p1 from s{i})")
    return ", ".join(ctes) + f" select id, round(p0, 8) p0, round(p1, 8) p1 from b{rounds}"


SQL |= {"bp_two_state_iter1": _two_state(1), "bp_two_state_iter3": _two_state(3)}
