"""Builders of the SQL that answers each query with DuckDB: the same arithmetic, spelled a second time."""

from __future__ import annotations


def hex_slice(h: str, start: str | int, length: int) -> str:
    return f"CAST('0x' || substr({h}, {start}, {length}) AS BIGINT)"


def fast_col(row: str, cols: str | int) -> str:
    return f"({hex_slice('h', f'1 + 6 * {row}', 5)} % {cols})"


def fast_sign(row: str) -> str:
    return f"(CASE WHEN {hex_slice('h', f'6 + 6 * {row}', 1)} % 2 = 1 THEN 1 ELSE -1 END)"


def counts(source: str, key: str, weight: str = "1", by: str = "") -> str:
    g = f"{by}, " if by else ""
    return f"SELECT {g}{key} AS k, CAST(sum({weight}) AS BIGINT) AS w FROM {source} WHERE {key} IS NOT NULL GROUP BY {g}{key}"


def cells(given: str, rows: int, cols: int, *, fast: bool = True, salt: str = "", by: str = "", extra: str = "") -> str:
    """(by, k, w, row, col, sg) of a relation (by, k, w)."""
    g = f"{by}, " if by else ""
    if fast:
        h = f"md5('{salt}' || CAST(k AS VARCHAR))"
        return f"SELECT {g}{extra}k, w, row, {fast_col('row', cols)} AS col, {fast_sign('row')} AS sg FROM (SELECT *, {h} AS h FROM {given}), (SELECT unnest(range({rows})) AS row)"
    h = f"md5('{salt}' || row || ':' || CAST(k AS VARCHAR))"
    return f"SELECT {g}{extra}k, w, row, {hex_slice('h', 1, 8)} % {cols} AS col, CASE WHEN {hex_slice('h', 9, 1)} % 2 = 1 THEN 1 ELSE -1 END AS sg FROM (SELECT *, {h} AS h FROM {given}, (SELECT unnest(range({rows})) AS row))"


def same(a: str, b: str, columns: list[str]) -> str:
    """Condition that groups agree, null or not."""
    return " AND ".join(f"{a}.{c} IS NOT DISTINCT FROM {b}.{c}" for c in columns)


def matrix(source: str, key: str, rows: int, cols: int, *, weight: str = "1", by: str = "", signed: bool = False, fast: bool = True, salt: str = "") -> str:
    """WITH parts c (counts), x (cells) and s (the sketch)."""
    g = f"{by}, " if by else ""
    v = "sg * w" if signed else "w"
    return (
        f"c AS ({counts(source, key, weight, by)}), x AS ({cells('c', rows, cols, fast=fast, by=by, salt=salt)}), "
        f"s AS (SELECT {g}row, col, CAST(sum({v}) AS BIGINT) AS cnt FROM x GROUP BY {g}row, col HAVING sum({v}) <> 0)"
    )


def estimates(key: str, *, by: str = "", signed: bool = False, sketch: str = "s", est: str = "est") -> str:
    """A query of (by, key, est) over the parts above."""
    g = f"x.{by}, " if by else ""
    on = f"{same('x', 's', [by])} AND " if by else ""
    v = "median(sg * coalesce(cnt, 0))" if signed else "min(coalesce(cnt, 0))"
    return f"SELECT {g}k AS {key}, {v} AS {est} FROM x LEFT JOIN {sketch} s ON {on}x.row = s.row AND x.col = s.col GROUP BY {g}k"


def reg(p: int, h: str = "h") -> str:
    return f"CAST({hex_slice(h, 1, 12)} >> {48 - p} AS INTEGER)"


def rho(p: int, h: str = "h") -> str:
    rest = f"((({hex_slice(h, 1, 12)} & {(1 << 48 - p) - 1}) << 16) | {hex_slice(h, 13, 4)})"
    return f"CAST({65 - p} - CASE WHEN {rest} = 0 THEN 0 ELSE length(bin({rest})) END AS INTEGER)"


def hll(source: str, key: str, *, p: int = 14, by: str = "") -> str:
    """The relation (by, reg, rho)."""
    g = f"{by}, " if by else ""
    return f"SELECT {g}{reg(p)} AS reg, max({rho(p)}) AS rho FROM (SELECT {g}md5(CAST({key} AS VARCHAR)) AS h FROM {source} WHERE {key} IS NOT NULL) GROUP BY {g}reg"


def hll_classic(given: str, *, p: int = 14, by: str = "") -> str:
    m = 1 << p
    a = 0.7213 / (1 + 1.079 / m)
    g = f"{by}, " if by else ""
    grp = f" GROUP BY {by}" if by else ""
    return (
        f"SELECT {g}CAST(trunc(CASE WHEN raw <= 2.5 * {m} AND z > 0 THEN {m} * ln({m}.0 / z) ELSE raw END) AS BIGINT) AS est "
        f"FROM (SELECT {g}CAST({a * m * m!r} AS DOUBLE) / (sum(pow(2.0, -rho)) + ({m} - count(*))) AS raw, {m} - count(*) AS z FROM {given}{grp})"
    )


def hll_ertl(given: str, *, p: int = 14, by: str = "") -> str:
    """Sums of sixty terms for either series, which all engines round alike to a whole number."""
    m, q = 1 << p, 64 - p
    g = f"{by}, " if by else ""
    grp = f" GROUP BY {by}" if by else ""
    x, y = f"(1 - n / {float(m)})", f"(1 - f / {float(m)})"
    sigma = f"({x} + list_sum(list_transform(range(1, 61), lambda k: pow({x}, pow(2.0, k)) * pow(2.0, k - 1))))"
    tau = f"(1 - {y} - list_sum(list_transform(range(1, 61), lambda k: pow(1 - pow({y}, pow(2.0, -k)), 2) * pow(2.0, -k)))) / 3"
    z = f"s + CASE WHEN {y} > 0 AND {y} < 1 THEN {m} * {tau} * pow(2.0, -{q}) ELSE 0 END + {m} * {sigma}"
    return (
        f"SELECT {g}CAST(round(CASE WHEN n = 0 THEN 0 ELSE {m * m}.0 / (2 * ln(2.0)) / ({z}) END) AS BIGINT) AS est FROM "
        f"(SELECT {g}count(*) AS n, coalesce(sum(CASE WHEN rho <= {q} THEN pow(2.0, -rho) END), 0) AS s, sum(CASE WHEN rho <= {q} THEN 0 ELSE 1 END) AS f FROM {given}{grp})"
    )


def hip(source: str, key: str, time: str, by: str, *, p: int = 14) -> str:
    """(by, est) from the register changes in order of time."""
    m = float(1 << p)
    before = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return (
        f"WITH r AS (SELECT {by}, {reg(p)} AS reg, {rho(p)} AS rho, min(t) AS t FROM (SELECT {by}, {time} AS t, md5(CAST({key} AS VARCHAR)) AS h FROM {source} WHERE {key} IS NOT NULL) GROUP BY ALL), "
        f"o AS (SELECT *, coalesce(max(rho) OVER (PARTITION BY {by}, reg ORDER BY t, rho {before}), 0) AS old FROM r), "
        f"c AS (SELECT *, {m} + coalesce(sum(pow(2.0, -rho) - pow(2.0, -old)) OVER (PARTITION BY {by} ORDER BY t, reg, rho {before}), 0.0) AS s FROM o WHERE rho > old) "
        f"SELECT {by}, round(sum({m} / s), 6) AS est FROM c GROUP BY {by}"
    )


def bottom(key: str, layers: int) -> str:
    n = hex_slice(f"md5('layer:' || CAST({key} AS VARCHAR))", 1, 8)
    return f"least(32 - length(regexp_replace(lpad(bin({n}), 32, '0'), '^1*', '')), {layers - 1})"


def layered(source: str, key: str, layers: int, rows: int, cols: int, k: int, *, narrow: tuple[int, int] | None = None, by: list[str] | None = None, weight: str = "1", merged: bool = False) -> str:
    """WITH parts of a layered sketch: ts (by, layer, row, col, cnt), t (by, layer, b, k, est), the heavy keys, and n (by, n);
    ``merged``: sketches of the groups ``by``, made one."""
    by = by or []
    g = "".join(f"{c}, " for c in by)
    width = f"(CASE WHEN layer < {narrow[0]} THEN {cols} ELSE {narrow[1]} END)" if narrow else str(cols)

    def best(x: str, s: str, given: list[str]) -> str:
        q = "".join(f"{x}.{c}, " for c in given)
        on = f"{same(x, s, given)} AND " if given else ""
        part = "".join(f"{c}, " for c in given)
        return (
            f"SELECT *, row_number() OVER (PARTITION BY {part}layer ORDER BY est DESC, k) AS r FROM (SELECT {q}{x}.layer, {x}.b, {x}.k, CAST(trunc(median(sg * coalesce(cnt, 0))) AS BIGINT) AS est "
            f"FROM {x} LEFT JOIN {s} ON {on}{x}.layer = {s}.layer AND {x}.row = {s}.row AND {x}.col = {s}.col GROUP BY ALL)"
        )

    out = (
        f"uc AS (SELECT {g}k, w, {bottom('k', layers)} AS b, md5(k) AS h FROM (SELECT {g}CAST({key} AS VARCHAR) AS k, CAST(sum({weight}) AS BIGINT) AS w FROM {source} WHERE {key} IS NOT NULL GROUP BY {g}{key})), "
        f"ul AS (SELECT * FROM uc, (SELECT unnest(range({layers})) AS layer) WHERE layer <= b), "
        f"ux AS (SELECT *, {fast_col('row', width)} AS col, {fast_sign('row')} AS sg FROM ul, (SELECT unnest(range({rows})) AS row)), "
        f"us AS (SELECT {g}layer, row, col, CAST(sum(sg * w) AS BIGINT) AS cnt FROM ux GROUP BY ALL HAVING sum(sg * w) <> 0), ut AS (SELECT * FROM ({best('ux', 'us', by)}) WHERE r <= {k}), "
    )
    if not merged:
        ng = f" GROUP BY {', '.join(by)}" if by else ""
        return out + f"ts AS (SELECT * FROM us), t AS (SELECT * FROM ut), n AS (SELECT {g}CAST(sum(w) AS BIGINT) AS n FROM uc{ng})"
    return out + (
        f"ts AS (SELECT layer, row, col, CAST(sum(cnt) AS BIGINT) AS cnt FROM us GROUP BY ALL HAVING sum(cnt) <> 0), mx AS (SELECT DISTINCT layer, b, k, row, col, sg FROM ux JOIN (SELECT DISTINCT layer, k FROM ut) USING (layer, k)), "
        f"t AS (SELECT * FROM ({best('mx', 'ts', [])}) WHERE r <= {k}), n AS (SELECT CAST(sum(w) AS BIGINT) AS n FROM uc)"
    )


def layered_metrics(layers: int, *, by: list[str] | None = None) -> str:
    """(by, n, l1, l2, entropy, card) over the parts above."""
    by = by or []
    g = "".join(f"{c}, " for c in by)
    grp = f" GROUP BY {', '.join(by)}" if by else ""
    factor = f"pow(2.0, layer) * (CASE WHEN layer = {layers - 1} THEN 1 WHEN b > layer THEN -1 ELSE 1 END)"
    using = f"({g}layer)"
    join = f" JOIN n USING ({', '.join(by)})" if by else ", n"
    return (
        f"SELECT {g}n, l1, sqrt(greatest(l2s, 0.0)) AS l2, log2(CAST(n AS DOUBLE)) - xl / n AS entropy, card FROM "
        f"(SELECT {g}coalesce(sum({factor} * est) FILTER (est > 0), 0) AS l1, coalesce(sum({factor} * est * est) FILTER (est > 0), 0) AS l2s, coalesce(sum({factor} * est * log2(est)) FILTER (est > 0), 0) AS xl, coalesce(sum({factor}) FILTER (est > thr), 0) AS card "
        f"FROM t JOIN (SELECT {g}layer, floor(sqrt(median(q)) * 0.01) AS thr FROM (SELECT {g}layer, row, sum(cnt * cnt) AS q FROM ts GROUP BY ALL) GROUP BY {g}layer) USING {using}{grp}){join}"
    )


def part(name: str, value: str) -> str:
    safe = rf"regexp_replace(CAST({value} AS VARCHAR), '([\\;=])', '\\\1', 'g')"
    return f"'{name}=' || coalesce({safe}, '\\N')"


def subsets(source: str, dims: list[str], measures: str, keep: str = "") -> str:
    """(subset, keep, measures) over all non-empty subsets; ``measures`` are aggregates with names."""
    out = []
    for mask in range(1, 1 << len(dims)):
        on = [d for i, d in enumerate(dims) if mask >> i & 1]
        name = " || ';' || ".join(part(d, d) for d in on)
        k = f"{keep}, " if keep else ""
        out.append(f"SELECT {name} AS subset, {k}{measures} FROM {source} GROUP BY {k}{', '.join(on)}")
    return " UNION ALL ".join(out)


def grid(given: str, columns: str, rows: int = 3, cols: int = 32, salt: str = "hydra", fast: bool = False) -> str:
    """(hrow, hcol, columns) of a relation with a subset."""
    if fast:
        return f"SELECT hrow, {fast_col('hrow', cols)} AS hcol, {columns} FROM (SELECT *, md5('{salt}' || subset) AS h FROM {given}), (SELECT unnest(range({rows})) AS hrow)"
    h = f"md5('{salt}' || hrow || ':' || subset)"
    return f"SELECT hrow, {hex_slice(h, 1, 8)} % {cols} AS hcol, {columns} FROM {given}, (SELECT unnest(range({rows})) AS hrow)"
