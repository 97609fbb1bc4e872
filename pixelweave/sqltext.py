"""Common table expressions for oracles: focal passes, thresholds, methods."""

from __future__ import annotations

from .operators.focal import gaussian_taps
from .scenes import CLEAR


def padded(source: str, out: str, columns: list[str], radius: int, mode: str = "reflect", by: str = "") -> str:
    """CTEs out_dim and out: source with its border mirrored or repeated; of each grid, if by tells several apart."""
    comma, group, dims = (f"{by}, ", f" GROUP BY {by}", f" JOIN {out}_dim USING ({by})") if by else ("", "", f", {out}_dim")
    rest = comma + ", ".join(columns)
    steps = range(1, radius + 1)
    if mode == "reflect":
        high = lambda at, n, other, src: f"SELECT -1 - {at} AS {at}, {other}, {rest} FROM {src} WHERE {at} < {radius} UNION ALL SELECT 2 * {n} - 1 - {at}, {other}, {rest} FROM {src}{dims} WHERE {at} >= {n} - {radius}"
    else:
        high = lambda at, n, other, src: " UNION ALL ".join(f"SELECT -{k} AS {at}, {other}, {rest} FROM {src} WHERE {at} = 0 UNION ALL SELECT {n} - 1 + {k}, {other}, {rest} FROM {src}{dims} WHERE {at} = {n} - 1" for k in steps)
    return f"""{out}_dim AS (SELECT {comma}max(r) + 1 AS h, max(c) + 1 AS w FROM {source}{group}),
{out}_rows AS (SELECT r, c, {rest} FROM {source} UNION ALL {high('r', 'h', 'c', source)}),
{out} AS (SELECT r, c, {rest} FROM {out}_rows UNION ALL SELECT r, c, {rest} FROM ({high('c', 'w', 'r', f'{out}_rows')}))"""


def passes(source: str, out: str, along: dict[str, str], by: str = "") -> str:
    """CTE out: the expressions over rows, then over columns; $x is the value, $w the window's partition and order."""
    comma, dims = (f"{by}, ", f"JOIN {source}_dim d USING ({by})") if by else ("", f", {source}_dim d")
    first = ", ".join(f"{e.replace('$x', k).replace('$w', f'PARTITION BY {comma}r ORDER BY c')} AS {k}" for k, e in along.items())
    second = ", ".join(f"{e.replace('$x', k).replace('$w', f'PARTITION BY {comma}c ORDER BY r')} AS {k}" for k, e in along.items())
    return f"""{out}_1 AS (SELECT {comma}r, c, {first} FROM {source}),
{out} AS (SELECT q.* FROM (SELECT {comma}r, c, {second} FROM {out}_1) q {dims} WHERE q.r BETWEEN 0 AND d.h - 1 AND q.c BETWEEN 0 AND d.w - 1)"""


def _gauss() -> str:
    taps = gaussian_taps()
    return " + ".join([f"$x * {taps[0]!r}", *(f"(lag($x, {k}) OVER ($w) + lead($x, {k}) OVER ($w)) * {w!r}" for k, w in enumerate(taps[1:], start=1))])


def blurred(source: str, out: str, column: str, by: str = "") -> str:
    """CTE out: (by,) r, c and the blurred column of dense source; NULL counts as 0 and stays NULL."""
    comma = f"{by}, " if by else ""
    return f"""{out}_in AS (SELECT {comma}r, c, coalesce(CAST({column} AS DOUBLE), 0.0) AS {column} FROM {source}),
{padded(f'{out}_in', f'{out}_pad', [column], 4, by=by)},
{passes(f'{out}_pad', f'{out}_out', {column: _gauss()}, by)},
{out} AS (SELECT {f'o.{comma}' if by else ''}o.r, o.c, CASE WHEN s.{column} IS NOT NULL THEN o.{column} END AS smoothed FROM {out}_out o JOIN {source} s USING ({comma}r, c))"""


def box(source: str, out: str, column: str, half: int = 2) -> str:
    frame = f"ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING"
    along = {"mean": f"avg($x) OVER ($w {frame})", "square": f"avg($x) OVER ($w {frame})", "low": f"min($x) OVER ($w {frame})", "high": f"max($x) OVER ($w {frame})"}
    return f"""{out}_in AS (SELECT r, c, {column} AS mean, {column} * {column} AS square, {column} AS low, {column} AS high FROM {source}),
{padded(f'{out}_in', f'{out}_pad', list(along), half)},
{passes(f'{out}_pad', f'{out}_out', along)},
{out} AS (SELECT r, c, 1 / (1 + greatest(square - mean * mean, 0)) AS homogeneity, high - low AS contrast FROM {out}_out)"""


def utm_to_degrees(x: str, y: str, zone: str) -> tuple[str, str]:
    """Longitude and latitude of UTM metres of the northern hemisphere as expressions: the same series as the native one."""
    f = 1 / 298.257223563
    n = f / (2 - f)
    radius = 6_378_137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 / 3 * n**2 + 37 / 96 * n**3, n**2 / 48 + n**3 / 15, 17 / 480 * n**3)
    delta = (2 * n - 2 / 3 * n**2 - 2 * n**3, 7 / 3 * n**2 - 8 / 5 * n**3, 56 / 15 * n**3)
    xi, eta = f"(({y}) / {0.9996 * radius!r})", f"((({x}) - 500000.0) / {0.9996 * radius!r})"
    sinh, cosh = (lambda v, s=s: f"((exp({v}) {s} exp(-({v}))) / 2)" for s in "-+")
    xi_ = f"({xi} " + " ".join(f"- {b!r} * sin({2 * j} * {xi}) * {cosh(f'{2 * j} * {eta}')}" for j, b in enumerate(beta, 1)) + ")"
    eta_ = f"({eta} " + " ".join(f"- {b!r} * cos({2 * j} * {xi}) * {sinh(f'{2 * j} * {eta}')}" for j, b in enumerate(beta, 1)) + ")"
    chi = f"asin(sin({xi_}) / {cosh(eta_)})"
    lat = f"({chi} " + " ".join(f"+ {d!r} * sin({2 * j} * {chi})" for j, d in enumerate(delta, 1)) + ")"
    return f"(({zone}) * 6.0 - 183.0 + degrees(atan2({sinh(eta_)}, cos({xi_}))))", f"degrees({lat})"


def majority(source: str, out: str, columns: list[str], classes: list[int], half: int = 2) -> str:
    frame = f"ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING"
    along = {f"{c}_{k}": f"sum($x) OVER ($w {frame})" for c in columns for k in classes}
    votes = ", ".join(f"CAST(coalesce({c} = {k}, false) AS INT) AS {c}_{k}" for c in columns for k in classes)
    pick = []
    for c in columns:
        most = f"greatest({', '.join(f'{c}_{k}' for k in classes)})"
        pick.append(f"CASE WHEN NOT coalesce(s.valid, false) OR {most} = 0 THEN 0 {' '.join(f'WHEN {c}_{k} = {most} THEN {k}' for k in classes)} END AS {c}")
    return f"""{out}_in AS (SELECT r, c, {votes} FROM {source}),
{padded(f'{out}_in', f'{out}_pad', list(along), half, 'nearest')},
{passes(f'{out}_pad', f'{out}_out', along)},
{out} AS (SELECT o.r, o.c, {', '.join(pick)} FROM {out}_out o JOIN {source} s USING (r, c))"""


def histogram(source: str, out: str, value: str, bins: int = 256, where: str | None = None, by: str = "") -> str:
    comma = f"{by}, " if by else ""
    return f"""{out}_x AS (SELECT {comma}CAST({value} AS DOUBLE) AS x FROM {source} WHERE {where or f'{value} > 0'}),
{out}_ends AS (SELECT {comma}min(x) AS low, max(x) AS high FROM {out}_x {f'GROUP BY {by}' if by else ''}),
{out} AS (SELECT {comma}bin, low + (bin + 0.5) * (high - low) / {bins} AS centre, count(*) AS n FROM (
  SELECT {f'x.{by}, ' if by else ''}low, high, CAST(coalesce(least(floor((x - low) / nullif(high - low, 0) * {bins}), {bins - 1}), 0) AS INT) AS bin FROM {out}_x x JOIN {out}_ends e ON {f'x.{by} = e.{by}' if by else 'true'}) GROUP BY ALL)"""


def otsu(source: str, out: str, value: str, by: str = "") -> str:
    """CTE out: (by,) threshold."""
    comma, part = (f"{by}, ", f"PARTITION BY {by}") if by else ("", "")
    return f"""{histogram(source, f'{out}_h', value, by=by)},
{out}_s AS (SELECT {comma}bin, centre, CAST(sum(n) OVER ({part} ORDER BY bin) AS DOUBLE) AS wb, sum(n * centre) OVER ({part} ORDER BY bin) AS sb, CAST(sum(n) OVER ({part}) AS DOUBLE) AS whole, sum(n * centre) OVER ({part}) AS total FROM {out}_h),
{out}_v AS (SELECT {comma}bin, centre, CASE WHEN whole - wb > 0 THEN wb * (whole - wb) * power(sb / wb - (total - sb) / (whole - wb), 2) END AS spread FROM {out}_s),
{out} AS (SELECT {comma}coalesce(arg_max(centre, (spread, -bin)) FILTER (WHERE spread > 0), 0.0) AS threshold FROM {out}_v {f'GROUP BY {by}' if by else ''})"""


FULL = f"""{CLEAR},
extent AS (SELECT max(r) AS h, max(c) AS w FROM pair),
cells AS (SELECT CAST(i AS INT) AS r, CAST(j AS INT) AS c FROM (SELECT unnest(range(h + 1)) AS i FROM extent), (SELECT unnest(range(w + 1)) AS j FROM extent))"""

BAND_DIFF = f"""{FULL},
bd_cells AS (SELECT r, c, b04_a - b04_b AS diff, abs(b04_a - b04_b) AS abs_diff FROM cells LEFT JOIN clear USING (r, c)),
{blurred('bd_cells', 'bd_s', 'abs_diff')},
{otsu('bd_s', 'bd_t', 'smoothed')},
bd AS (SELECT *, coalesce(smoothed > threshold, false) AS changed FROM bd_cells JOIN bd_s USING (r, c) CROSS JOIN bd_t)"""


def ndvi_method(base: str = FULL) -> str:
    return f"""{base},
nd_cells AS (SELECT r, c, ndvi_b, ndvi_a, ndvi_a - ndvi_b AS delta, abs(ndvi_a - ndvi_b) AS abs_delta FROM cells LEFT JOIN (SELECT r, c, (b08_b - b04_b) / nullif(b08_b + b04_b, 0) AS ndvi_b, (b08_a - b04_a) / nullif(b08_a + b04_a, 0) AS ndvi_a FROM clear) USING (r, c)),
{blurred('nd_cells', 'nd_s', 'abs_delta')},
{otsu('nd_s', 'nd_t', 'smoothed')},
nd AS (SELECT *, coalesce(smoothed > threshold, false) AS changed, coalesce(delta > threshold, false) AS gain, coalesce(-delta > threshold, false) AS loss FROM nd_cells JOIN nd_s USING (r, c) CROSS JOIN nd_t)"""


def cva_method(base: str = FULL) -> str:
    deltas = " + ".join(f"({b}_a - {b}_b) * ({b}_a - {b}_b)" for b in ("b02", "b03", "b04", "b08"))
    angle = "degrees(atan2(b08_a - b08_b, b04_a - b04_b))"
    return f"""{base},
cv_cells AS (SELECT r, c, magnitude, direction FROM cells LEFT JOIN (SELECT r, c, CASE WHEN valid THEN sqrt({deltas}) END AS magnitude, CASE WHEN valid THEN CASE WHEN {angle} < 0 THEN {angle} + 360 ELSE {angle} END END AS direction FROM clear) USING (r, c)),
{blurred('cv_cells', 'cv_s', 'magnitude')},
{otsu('cv_s', 'cv_t', 'smoothed')},
cv AS (SELECT *, coalesce(smoothed > threshold, false) AS changed, coalesce(CASE WHEN smoothed > threshold THEN CASE WHEN direction >= 180 AND direction < 270 THEN 1 WHEN direction >= 90 AND direction < 180 THEN 2 WHEN direction >= 0 AND direction < 90 THEN 3 WHEN direction >= 270 THEN 4 END END, 0) AS change_type
  FROM cv_cells JOIN cv_s USING (r, c) CROSS JOIN cv_t)"""


NDVI_DIFF, CVA = ndvi_method(), cva_method()
ALL_METHODS = cva_method(ndvi_method(BAND_DIFF))
