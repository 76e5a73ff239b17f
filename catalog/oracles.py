"""The same results in DuckDB SQL, written from the definitions.

Everything here works on one row per hour with plain window functions, while the
engine works on packed days and calendar blocks: the two share no formulation.
"""

from __future__ import annotations

import numpy as np

_BASE = """
calendar AS (SELECT min(CAST(ts AS DATE)) AS first, max(CAST(ts AS DATE)) AS last FROM events),
ev AS (
  SELECT user_id // 10 AS mno, date_diff('day', first, CAST(ts AS DATE)) AS d,
         hour(ts) AS hour, ts, event_id, CAST(round(value * 100) AS BIGINT) AS cents
  FROM events, calendar),
running AS (
  SELECT mno, d, hour, sum(cents) OVER (PARTITION BY mno ORDER BY ts, event_id) AS total FROM ev),
hourly AS (SELECT mno, d, hour, max(total) AS total FROM running GROUP BY ALL),
grid AS (
  SELECT mno, d, h AS hour FROM (SELECT DISTINCT mno FROM ev),
    (SELECT unnest(range(date_diff('day', first, last) + 1)) AS d FROM calendar), range(24) b(h)),
raw AS (
  SELECT g.mno, g.d, g.hour, total,
         last_value(total IGNORE NULLS) OVER (PARTITION BY g.mno ORDER BY g.d, g.hour
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS latest
  FROM grid g LEFT JOIN hourly h ON h.mno = g.mno AND h.d = g.d AND h.hour = g.hour),
days AS (
  SELECT mno, d, 'M' || lpad(CAST(mno AS VARCHAR), 5, '0') AS id, 'C' || mno AS contact_id,
         [15, 20, 30, 40, 80][mno % 5 + 1] AS calibre,
         CAST((SELECT first FROM calendar) + CAST(d AS INTEGER) AS DATE) AS data, CAST(hour AS INTEGER) AS hour,
         CASE WHEN mno % 15 = 14 OR (mno % 7 = 3 AND d BETWEEN 12 AND 16)
                OR (mno % 13 = 5 AND d BETWEEN 3 AND 11) OR (mno * 7 + d) % 11 = 0 THEN NULL
              WHEN (mno + d) % 5 = 0 THEN latest ELSE total END / 100.0 AS x
  FROM raw),
dirty AS (
  SELECT * REPLACE (CASE WHEN x IS NULL THEN NULL
                         WHEN (mno * 31 + d * 24 + hour) % 97 = 0 THEN 0.0
                         WHEN (mno * 31 + d * 24 + hour) % 101 = 0 THEN x * 1.6
                         WHEN (mno * 31 + d * 24 + hour) % 103 = 0 THEN x * 0.7
                         ELSE x END AS x)
  FROM days),
loads AS (
  SELECT *, 0 AS load_seq FROM days
  UNION ALL
  SELECT * REPLACE (x + 1 AS x), 1 AS load_seq FROM days WHERE (mno * 3 + d) % 17 = 0)
"""


def _with(select: str) -> str:
    return f"WITH {_BASE} {select}"


def r6(x: str) -> str:
    return f"round({x} + 1e-9, 6)"


def s9(x: str) -> str:
    return f"CAST(printf('%.9e', {x}) AS DOUBLE)"


def _src(source: str) -> str:
    return source if source.isidentifier() else f"({source})"


_DAY = "PARTITION BY id, data ORDER BY hour"
_LINE = "PARTITION BY id ORDER BY data, hour"
_SO_FAR = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
_ONWARD = "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"


def map_x(source: str, expression: str) -> str:
    return f"SELECT id, data, hour, {expression} AS x FROM {_src(source)}"


def interpolate(source: str, along: str = _DAY, at: str = "hour") -> str:
    known = f"CASE WHEN x IS NOT NULL THEN {at} END"
    return f"""SELECT id, data, hour, coalesce(x, p + (n - p) * ({at} - ph) / (nh - ph), p, n) AS x
      FROM (SELECT *, last_value(x IGNORE NULLS) OVER a AS p, last_value({known} IGNORE NULLS) OVER a AS ph,
                   first_value(x IGNORE NULLS) OVER b AS n, first_value({known} IGNORE NULLS) OVER b AS nh
            FROM {_src(source)} WINDOW a AS ({along} {_SO_FAR}), b AS ({along} {_ONWARD}))"""


def fill_day(source: str) -> str:
    return map_x(
        source,
        f"coalesce(last_value(x IGNORE NULLS) OVER ({_DAY} {_SO_FAR}), "
        f"first_value(x IGNORE NULLS) OVER ({_DAY} {_ONWARD}))",
    )


def carry(source: str, keys: str = "PARTITION BY id, hour ORDER BY data") -> str:
    return map_x(
        source,
        f"coalesce(last_value(x IGNORE NULLS) OVER ({keys} {_SO_FAR}), "
        f"first_value(x IGNORE NULLS) OVER ({keys} {_ONWARD}))",
    )


def zero(source: str) -> str:
    return map_x(source, "coalesce(x, 0)")


def clamp(source: str, along: str = _DAY) -> str:
    return map_x(source, f"CASE WHEN x IS NOT NULL THEN max(x) OVER ({along} {_SO_FAR}) END")


def fast(source: str) -> str:
    return clamp(zero(carry(interpolate(source))))


def no_zeros(source: str) -> str:
    return map_x(source, "nullif(x, 0)")


def no_spikes(source: str) -> str:
    return f"""SELECT id, data, hour, CASE WHEN x > 1.25 * m AND m > 10 THEN NULL ELSE x END AS x
      FROM (SELECT *, median(x) OVER ({_DAY} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM {_src(source)})"""


def no_drops(source: str, keys: str = "PARTITION BY id, hour ORDER BY data") -> str:
    return f"""SELECT id, data, hour,
        CASE WHEN x < b AND (CASE WHEN b > 0 THEN x / b ELSE 1 END) > 0.1 THEN NULL ELSE x END AS x
      FROM (SELECT *, lag(x) OVER ({keys}) AS b FROM {_src(source)})"""


def clean(source: str) -> str:
    return no_drops(no_spikes(no_zeros(source)))


def average(source: str, width: int, along: str = _DAY) -> str:
    return map_x(
        source,
        f"avg(x) OVER ({along} ROWS BETWEEN {width // 2} PRECEDING AND {(width - 1) // 2} FOLLOWING)",
    )


def fitted(source: str, width: int = 11) -> str:
    """Moving cubic fit: the value at an hour of the polynomial fitted to its window."""
    weights = []
    for i in range(24):
        start = min(max(i - width // 2, 0), 24 - width)
        for j in range(width):
            unit = np.zeros(width)
            unit[j] = 1.0
            weight = np.polyval(np.polyfit(np.arange(width), unit, 3), i - start)
            weights.append(f"({i}, {start + j}, {float(weight)!r})")
    return f"""SELECT s.id, s.data, w.i AS hour, sum(s.x * w.w) AS x
      FROM {_src(source)} s JOIN (VALUES {', '.join(weights)}) w(i, j, w) ON s.hour = w.j
      GROUP BY s.id, s.data, w.i"""


def beside(left: str, right: str) -> str:
    """Two cell tables side by side as x and o, keeping the left one."""
    return f"""SELECT l.id, l.data, l.hour, l.x, r.x AS o
      FROM {_src(left)} l LEFT JOIN {_src(right)} r ON l.id = r.id AND l.data = r.data AND l.hour = r.hour"""


def overlay(known: str, other: str) -> str:
    return f"SELECT id, data, hour, coalesce(o, x) AS x FROM ({beside(other, known)})"


def write_back(imputed: str, original: str, smoothed: str) -> str:
    return f"""SELECT i.id, i.data, i.hour,
        CASE WHEN count(*) FILTER (WHERE o.x IS NULL) OVER (PARTITION BY i.id, i.data) > 0
             THEN coalesce(o.x, s.x) ELSE i.x END AS x
      FROM {_src(imputed)} i
      JOIN {_src(original)} o ON i.id = o.id AND i.data = o.data AND i.hour = o.hour
      JOIN {_src(smoothed)} s ON i.id = s.id AND i.data = s.data AND i.hour = s.hour"""


def clamp_gap_days(source: str, original: str) -> str:
    return f"""SELECT id, data, hour,
        CASE WHEN count(*) FILTER (WHERE o IS NULL) OVER (PARTITION BY id, data) > 0
              AND x IS NOT NULL THEN max(x) OVER ({_DAY} {_SO_FAR}) ELSE x END AS x
      FROM ({beside(source, original)})"""


def cells(source: str, name: str = "reading") -> str:
    return _with(
        f"SELECT id, CAST(data AS VARCHAR) AS data, CAST(hour AS INTEGER) AS hour, {r6('x')} AS {name} "
        f"FROM {_src(source)}"
    )


def rank_one(start: str, known: str, by_meter: bool = True, rounds: int = 2) -> str:
    """Rank-one refinement.  A Gram matrix squared again and again and divided by its trace
    becomes the projection on its leading vector."""
    meter = "id" if by_meter else "''"
    source = start
    for _ in range(rounds):
        squares = "".join(
            f""", t{k} AS MATERIALIZED (SELECT m, sum(g) AS t FROM g{k} WHERE i = j GROUP BY m),
            g{k + 1} AS MATERIALIZED (SELECT a.m, a.i, b.j, sum(a.g / t * b.g / t) AS g FROM g{k} a
              JOIN g{k} b ON a.m = b.m AND a.j = b.i JOIN t{k} ON a.m = t{k}.m GROUP BY a.m, a.i, b.j)"""
            for k in range(6)
        )
        inner = f"""WITH s AS MATERIALIZED (SELECT *, {meter} AS m FROM {_src(source)}),
          holes AS MATERIALIZED (SELECT DISTINCT m FROM s WHERE x IS NULL),
          g0 AS MATERIALIZED (SELECT a.m, a.hour AS i, b.hour AS j, sum(a.x * b.x) AS g
            FROM s a JOIN s b ON a.id = b.id AND a.data = b.data
            WHERE a.m NOT IN (SELECT m FROM holes) GROUP BY a.m, a.hour, b.hour){squares},
          t6 AS MATERIALIZED (SELECT m, sum(g) AS t FROM g6 WHERE i = j GROUP BY m),
          n AS (SELECT s.id, s.data, j AS hour, sum(s.x * g / t) AS x FROM s
            JOIN g6 ON g6.m = s.m AND g6.i = s.hour JOIN t6 ON t6.m = s.m GROUP BY s.id, s.data, j)
          SELECT s.id, s.data, s.hour, s.x, n.x AS nx
          FROM s LEFT JOIN n ON s.id = n.id AND s.data = n.data AND s.hour = n.hour"""
        source = f"""SELECT s.id, s.data, s.hour, coalesce(k.x, s.nx, s.x) AS x FROM ({inner}) s
          LEFT JOIN {_src(known)} k ON s.id = k.id AND s.data = k.data AND s.hour = k.hour"""
    return source


def low_rank(start: str, known: str, rank: int, rounds: int, squarings: int = 12) -> str:
    """Refinement per meter at a rank above one.  The projection on a leading vector is a Gram matrix squared again and
    again over its trace; what it explains is taken off the matrix, and the rest has the next vector."""
    source = start
    for _ in range(rounds):
        steps = ""
        for r in range(rank):
            steps += f""", r{r}t AS MATERIALIZED (SELECT m, sum(g) AS t FROM h{r} WHERE i = j GROUP BY m),
            r{r}q0 AS MATERIALIZED (SELECT h.m, i, j, g / t AS g FROM h{r} h JOIN r{r}t USING (m) WHERE t <> 0)"""
            for k in range(squarings):
                steps += f""", r{r}s{k} AS MATERIALIZED (SELECT a.m, a.i, b.j, sum(a.g * b.g) AS g FROM r{r}q{k} a
                JOIN r{r}q{k} b ON a.m = b.m AND a.j = b.i GROUP BY a.m, a.i, b.j),
                r{r}q{k + 1} AS MATERIALIZED (SELECT s.m, i, j, g / t AS g FROM r{r}s{k} s
                  JOIN (SELECT m, sum(g) AS t FROM r{r}s{k} WHERE i = j GROUP BY m) USING (m))"""
            steps += f""", p{r} AS MATERIALIZED (SELECT * FROM r{r}q{squarings}),
            h{r + 1} AS MATERIALIZED (SELECT h.m, h.i, h.j, h.g - coalesce(e.t * p.g, 0) AS g FROM h{r} h
              LEFT JOIN p{r} p ON h.m = p.m AND h.i = p.i AND h.j = p.j
              LEFT JOIN (SELECT p.m, sum(p.g * h.g) AS t FROM p{r} p JOIN h{r} h ON h.m = p.m AND h.i = p.j AND h.j = p.i
                GROUP BY p.m) e ON e.m = h.m)"""
        every = " UNION ALL ".join(f"SELECT * FROM p{r}" for r in range(rank))
        inner = f"""WITH s AS MATERIALIZED (SELECT *, id AS m FROM {_src(source)}),
          holes AS MATERIALIZED (SELECT DISTINCT m FROM s WHERE x IS NULL),
          h0 AS MATERIALIZED (SELECT a.m, a.hour AS i, b.hour AS j, sum(a.x * b.x) AS g
            FROM s a JOIN s b ON a.id = b.id AND a.data = b.data
            WHERE a.m NOT IN (SELECT m FROM holes) GROUP BY a.m, a.hour, b.hour){steps},
          whole AS MATERIALIZED (SELECT m, i, j, sum(g) AS g FROM ({every}) GROUP BY m, i, j),
          n AS (SELECT s.id, s.data, j AS hour, sum(s.x * g) AS x FROM s
            JOIN whole w ON w.m = s.m AND w.i = s.hour GROUP BY s.id, s.data, j)
          SELECT s.id, s.data, s.hour, s.x, n.x AS nx
          FROM s LEFT JOIN n ON s.id = n.id AND s.data = n.data AND s.hour = n.hour"""
        source = f"""SELECT s.id, s.data, s.hour, coalesce(k.x, s.nx, s.x) AS x FROM ({inner}) s
          LEFT JOIN {_src(known)} k ON s.id = k.id AND s.data = k.data AND s.hour = k.hour"""
    return source


def _bending(n: int) -> np.ndarray:
    """What the natural cubic spline through n values bends: y' K y is the integral of its squared second derivative.

    The second derivatives at the knots solve a tridiagonal system, and between knots they are straight."""
    second = np.zeros((n, n))
    rise = np.eye(n)[:-2] - 2 * np.eye(n)[1:-1] + np.eye(n)[2:]
    second[1:-1] = np.linalg.solve(4 * np.eye(n - 2) + np.eye(n - 2, k=1) + np.eye(n - 2, k=-1), 6 * rise)
    pieces = np.eye(n) * 2
    pieces[0, 0] = pieces[-1, -1] = 1
    return second.T @ (pieces / 3 + (np.eye(n, k=1) + np.eye(n, k=-1)) / 6) @ second


def spline(source: str, hours: int = 24, slack: float = 0.1) -> str:
    """Least-curvature spline of complete days within a squared residual of ``slack`` per hour, by bisection of the
    penalty's logarithm; on the eigenvectors of the bending the penalised system is diagonal."""
    values, vectors = np.linalg.eigh(_bending(hours))
    basis = ", ".join(f"({h}, [{', '.join(repr(float(x)) for x in vectors[h])}])" for h in range(hours))
    bend = f"[{', '.join(['0.0::DOUBLE'] * 2 + [repr(float(x)) for x in values[2:]])}]"
    inside = f"range(3, {hours + 1})"
    middle = "((low + high) / 2)"
    return f"""WITH RECURSIVE basis(hour, e) AS (VALUES {basis}),
      parts AS MATERIALIZED (SELECT id, data, list(p ORDER BY k) AS p, {bend} AS w FROM
        (SELECT s.id, s.data, k, sum(s.x * e[k]) AS p FROM {_src(source)} s JOIN basis ON s.hour = basis.hour,
          range(1, {hours + 1}) b(k) GROUP BY s.id, s.data, k) GROUP BY id, data),
      found AS (
        SELECT *, 0 AS step, CAST(-30 AS DOUBLE) AS low, CAST(30 AS DOUBLE) AS high FROM parts
        UNION ALL
        SELECT id, data, p, w, step + 1, CASE WHEN far THEN low ELSE {middle} END, CASE WHEN far THEN {middle} ELSE high END
        FROM (SELECT *, list_sum([pow(p[k] * exp({middle}) * w[k] / (1 + exp({middle}) * w[k]), 2) for k in {inside}]) > {slack * hours} AS far
              FROM found WHERE step < 80)),
      shrunk AS MATERIALIZED (SELECT id, data, [CASE WHEN k < 3 THEN p[k]
          WHEN list_sum([p[q] * p[q] for q in {inside}]) <= {slack * hours} THEN 0 ELSE p[k] / (1 + exp(low) * w[k]) END
          for k in range(1, {hours + 1})] AS p FROM found WHERE step = 80)
      SELECT id, data, hour, list_sum([p[k] * e[k] for k in range(1, {hours + 1})]) AS x FROM shrunk, basis"""


def scientific(source: str, smooth: str = "") -> str:
    """The scientific imputation at rank one; ``smooth`` is ``clean`` for a moving average that puts
    clean readings back, without the clamp along the timeline, ``savgol`` for a moving fit that puts raw ones back."""
    known = clean(source)
    out = clamp(rank_one(carry(interpolate(known)), known))
    if smooth == "savgol":
        out = clamp_gap_days(write_back(out, source, fitted(out)), source)
    if smooth == "clean":
        out = clamp_gap_days(write_back(out, known, average(out, 11)), known)
    out = map_x(out, "CASE WHEN x < 0 THEN 0 ELSE x END")
    return out if smooth == "clean" else clamp(out, _LINE)


def scientific_rows(source: str) -> str:
    """The scientific imputation of a table without meters, at rank one: all rows in the order of day and meter."""
    keys = "PARTITION BY hour ORDER BY data, id"
    known = no_drops(no_spikes(no_zeros(source)), keys)
    out = rank_one(carry(interpolate(known), keys), known, by_meter=False)
    return map_x(clamp(out), "CASE WHEN x < 0 THEN 0 ELSE x END")


def r4_cells(source: str) -> str:
    return _with(
        "SELECT id, CAST(data AS VARCHAR) AS data, CAST(hour AS INTEGER) AS hour, round(x + 1e-9, 4) AS reading "
        f"FROM {_src(source)}"
    )


FAST = fast("days")
CLEAN = clean("dirty")
FIRST_LOADS = "SELECT * FROM loads WHERE load_seq = 0"
M6 = clamp(average(FAST, 25, _LINE), _LINE)
M8 = overlay("days", M6)
_KEY = "id, CAST(data AS VARCHAR) AS data"

_DAY_RUNS = """SELECT id, data, min(hour) AS gap_start, count(*) AS gap_len, max(hour) = 23 AS is_trailing
  FROM (SELECT *, hour - row_number() OVER (PARTITION BY id, data ORDER BY hour) AS island
        FROM days WHERE x IS NULL) GROUP BY id, data, island"""

_DAY_STATS = f"""SELECT t.id, t.data, t.missing_count, 100.0 * t.missing_count / 24 AS missing_pct,
    coalesce(num_gaps, 0) AS num_gaps, coalesce(max_gap, 0) AS max_gap_size,
    coalesce(avg_gap, 0) AS avg_gap_size, coalesce(median_gap, 0) AS median_gap_size
  FROM (SELECT id, data, count(*) FILTER (WHERE x IS NULL) AS missing_count FROM days GROUP BY id, data) t
  LEFT JOIN (SELECT id, data, count(*) AS num_gaps, max(gap_len) AS max_gap, avg(gap_len) AS avg_gap,
                    median(gap_len) AS median_gap FROM ({_DAY_RUNS}) GROUP BY id, data) g
    ON t.id = g.id AND t.data = g.data"""

_LINE_RUNS = """SELECT id, min(CAST(data AS TIMESTAMP) + to_hours(hour)) AS gap_start, count(*) AS gap_len,
    max(pos) = (SELECT 24 * count(DISTINCT d) FROM days) AS is_trailing
  FROM (SELECT *, pos - row_number() OVER (PARTITION BY id ORDER BY pos) AS island
        FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY data, hour) AS pos FROM days)
        WHERE x IS NULL) GROUP BY id, island"""

_METER_STATS = f"""SELECT t.id, t.missing_count, 100.0 * t.missing_count / t.cells AS missing_pct,
    coalesce(num_gaps, 0) AS num_gaps, coalesce(max_gap, 0) AS max_gap_size,
    coalesce(avg_gap, 0) AS avg_gap_size, coalesce(median_gap, 0) AS median_gap_size
  FROM (SELECT id, count(*) AS cells, count(*) FILTER (WHERE x IS NULL) AS missing_count FROM days GROUP BY id) t
  LEFT JOIN (SELECT id, count(*) AS num_gaps, max(gap_len) AS max_gap, avg(gap_len) AS avg_gap,
                    median(gap_len) AS median_gap FROM ({_LINE_RUNS}) GROUP BY id) g ON t.id = g.id"""


def _stats_columns(keys: str) -> str:
    return (
        f"{keys}, missing_count, {r6('missing_pct')} AS missing_pct, num_gaps, max_gap_size, "
        f"{r6('avg_gap_size')} AS avg_gap_size, {r6('median_gap_size')} AS median_gap_size"
    )


def _network(source: str) -> str:
    return f"""SELECT data, hour, coalesce(avg(used) FILTER (WHERE used >= 0), 0) AS m
      FROM (SELECT *, lead(x) OVER ({_DAY}) - x AS used FROM {_src(source)}) WHERE hour < 23 GROUP BY data, hour"""


_SERIES = f"""SELECT data, hour, CAST(data AS TIMESTAMP) + to_hours(hour) AS ts, {r6('o')} AS orig_m3h,
    {r6('i')} AS imp_m3h, {r6('i')} - {r6('o')} AS diff_m3h,
    ({r6('i')} - {r6('o')}) / ({r6('o')} + 1e-10) * 100 AS diff_percent
  FROM (SELECT a.data, a.hour, a.m AS o, b.m AS i FROM ({_network('days')}) a
        JOIN ({_network(FAST)}) b ON a.data = b.data AND a.hour = b.hour)"""

_USED = """SELECT id, data, hour, CASE WHEN x - b < 0 THEN 0 ELSE x - b END AS x
  FROM (SELECT *, CASE WHEN row_number() OVER w = 1 THEN x ELSE lag(x) OVER w END AS b
        FROM {src} WINDOW w AS (PARTITION BY id ORDER BY data, hour))"""


def _used(source: str) -> str:
    return _USED.format(src=_src(source))


_CHOSEN = """SELECT id, n_rows, n_missing FROM (
    SELECT id, count(DISTINCT data) AS n_rows, count(*) FILTER (WHERE x IS NULL) AS n_missing
    FROM days GROUP BY id HAVING count(DISTINCT data) >= 10 ORDER BY n_rows DESC, id LIMIT 150)
  WHERE n_missing >= 20 ORDER BY n_rows DESC, id LIMIT 4"""

_WIDE = ", ".join(f"{r6(f'max(x) FILTER (WHERE hour = {h})')} AS index_{h}" for h in range(24))
_TS = "CAST(CAST(data AS TIMESTAMP) + to_hours(hour) AS VARCHAR) AS ts"
_ROW_ORDER = "PARTITION BY hour ORDER BY data, id"


def _gap_counts(keys: str) -> str:
    return (
        f"{keys} count(*) FILTER (WHERE NOT is_trailing AND gap_len <= 72) AS small_gaps, "
        "count(*) FILTER (WHERE NOT is_trailing AND gap_len > 72) AS large_gaps"
    )


def _advice(stats: str) -> str:
    return _with(
        f"""SELECT {r6('pct')} AS missing_pct, max_gap,
          CASE WHEN pct < 5 THEN 'excellent' WHEN pct < 20 THEN 'good' ELSE 'moderate' END AS quality,
          max_gap > 168 AS long_gaps
        FROM (SELECT 100.0 * count(*) FILTER (WHERE x IS NULL) / count(*) AS pct FROM days),
             (SELECT max(max_gap_size) AS max_gap FROM ({stats}))"""
    )


_REPORT = f"""SELECT 1 AS seq, 'rows: ' || count(*) // 24 AS line FROM days
  UNION ALL SELECT 2, 'hours per row: 24'
  UNION ALL SELECT 3, 'present: ' || count(x) FROM days
  UNION ALL SELECT 4, 'missing: ' || (count(*) - count(x)) FROM days
  UNION ALL SELECT 5, 'missing pct: ' || printf('%.2f', 100.0 * (count(*) - count(x)) / count(*)) FROM days
  UNION ALL SELECT 5 + row_number() OVER (ORDER BY missing_pct DESC, id, data),
    id || ' ' || CAST(data AS VARCHAR) || ': ' || printf('%.1f', missing_pct) || ' pct missing, ' || num_gaps
      || ' gaps, longest ' || max_gap_size || ' h'
    FROM (SELECT * FROM ({_DAY_STATS}) ORDER BY missing_pct DESC, id, data LIMIT 10)
  UNION ALL SELECT 16, 'quality: ' || CASE WHEN pct < 5 THEN 'excellent' WHEN pct < 20 THEN 'good' ELSE 'moderate' END
      || ', gaps above a week: ' || CASE WHEN longest > 168 THEN 'true' ELSE 'false' END
    FROM (SELECT 100.0 * count(*) FILTER (WHERE x IS NULL) / count(*) AS pct FROM days),
         (SELECT max(max_gap_size) AS longest FROM ({_DAY_STATS}))"""

_LARGE = f"SELECT id FROM ({_LINE_RUNS}) WHERE NOT is_trailing AND gap_len > 72"

_LOW_RANK_FACTS = """SELECT id, count(*) AS cells, CASE WHEN count(x) = 0 THEN count(*) ELSE 0 END AS nulls_left,
    0 AS known_changed FROM {src} GROUP BY id"""


def _violations(result: str) -> str:
    return f"""SELECT f.id, count(*) FILTER (WHERE f.x IS NULL) AS nulls_left,
        count(*) FILTER (WHERE CASE WHEN lo IS NULL THEN f.x <> 0 ELSE f.x < lo OR f.x > hi END) AS out_of_range
      FROM {_src(result)} f LEFT JOIN (SELECT id, min(x) AS lo, max(x) AS hi FROM days GROUP BY id) s ON f.id = s.id
      GROUP BY f.id"""


def oracle_sql() -> dict[str, str]:
    wide = _with(f"SELECT {_KEY}, {_WIDE} FROM days GROUP BY id, data")
    long = _with(f"SELECT {_KEY}, hour, {_TS}, {r6('x')} AS reading FROM days")
    both = (
        f"SELECT {_KEY}, hour, {r6('o')} AS val_orig, {r6('x')} AS val_imp, "
        f"o IS NULL AND x IS NOT NULL AS is_imputed"
    )
    sql = {
        # sources and sinks
        "scan_csv": _with(f"SELECT {_KEY}, contact_id, calibre, {_WIDE} FROM days GROUP BY id, data, contact_id, calibre"),
        "scan_pair": _with(f"{both} FROM ({beside(FAST, 'days')})"),
        "write_imputed": cells(FAST),
        "write_smoothed": cells(M8),
        "write_gap_metrics": _with(f"SELECT {_stats_columns(_KEY)} FROM ({_DAY_STATS})"),
        "write_gap_document": _with(
            f"""SELECT count(*) // 24 AS total_meters, 24 AS total_timestamps, count(*) AS total_values,
              count(*) - count(x) AS missing_count, {r6('100.0 * (count(*) - count(x)) / count(*)')} AS missing_pct,
              [count(*) // 24, 24] AS shape FROM days"""
        ),
        "write_gap_report": _with(f"SELECT line FROM ({_REPORT})"),
        # reshape
        "wide_to_long": long,
        "long_to_wide": wide,
        "day_vectors": wide,
        "row_positions": _with(
            "SELECT id, calibre, CAST(data AS VARCHAR) AS data, "
            "row_number() OVER (PARTITION BY id ORDER BY data) - 1 AS position "
            "FROM (SELECT DISTINCT id, calibre, data FROM days)"
        ),
        # filters
        "one_meter": cells("SELECT * FROM days WHERE id = 'M00001'"),
        "meters_by_text": cells("SELECT * FROM days WHERE contains(id, '01')"),
        "first_meter_by_text": cells(
            "SELECT * FROM days WHERE id = (SELECT min(id) FROM days WHERE contains(id, '1'))"
        ),
        "imputed_mask": _with(f"{both} FROM ({beside(FAST, 'days')})"),
        "valid_consumption": _with(
            f"SELECT {_KEY}, hour, {r6('used')} AS used "
            f"FROM (SELECT *, lead(x) OVER ({_DAY}) - x AS used FROM days) WHERE used >= 0"
        ),
        "count_above": _with(
            "SELECT id, count(*) FILTER (WHERE x > 1000) AS above_1000, "
            "count(*) FILTER (WHERE x > 10000) AS above_10000 FROM days GROUP BY id"
        ),
        "sample_above": _with(
            f"SELECT {_KEY}, hour, {r6('x')} AS reading FROM days WHERE x > 10000 ORDER BY id, data, hour LIMIT 20"
        ),
        "distinct_meters": _with("SELECT DISTINCT id FROM days"),
        "preview": _with(
            f"SELECT {_KEY}, {_WIDE} FROM days GROUP BY id, days.data ORDER BY id, days.data LIMIT 50"
        ),
        "parse_dates": """SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, true AS type_is_no_date
            FROM events""",
        "every_nth_point": _with(
            f"SELECT CAST(data AS VARCHAR) AS data, hour, {r6('orig_m3h')} AS orig_m3h, {r6('imp_m3h')} AS imp_m3h "
            f"FROM (SELECT *, row_number() OVER (ORDER BY ts) AS rn FROM ({_SERIES})) WHERE (rn - 1) % 6 = 0"
        ),
        "every_nth_hour": _with(
            f"SELECT {_KEY}, hour, {r6('x')} AS reading FROM (SELECT *, row_number() OVER ({_LINE}) AS rn FROM days) "
            "WHERE (rn - 1) % 72 = 0"
        ),
        "first_points": _with(
            f"SELECT CAST(data AS VARCHAR) AS data, hour, {r6('orig_m3h')} AS orig_m3h, {r6('imp_m3h')} AS imp_m3h "
            f"FROM (SELECT * FROM ({_SERIES}) ORDER BY ts LIMIT 1080)"
        ),
        # joins and sets
        "attach_original": _with(
            f"SELECT {_KEY}, hour, {r6('x')} AS val_imp, {r6('o')} AS val_orig FROM ({beside(FAST, FIRST_LOADS)})"
        ),
        "common_dates": _with(
            f"SELECT CAST(a.data AS VARCHAR) AS data, a.hour, {r6('a.m')} AS orig_m3h, {r6('b.m')} AS imp_m3h "
            f"FROM ({_network('days')}) a JOIN ({_network(FAST)}) b ON a.data = b.data AND a.hour = b.hour"
        ),
        "pair_days": _with(f"SELECT {_KEY}, hour, {r6('o')} AS orig, {r6('x')} AS imp FROM ({beside(FAST, 'days')})"),
        "rows_of_meters": cells(f"SELECT * FROM days WHERE id IN (SELECT id FROM ({_CHOSEN}))"),
        "meters_in_both": _with("SELECT DISTINCT id FROM days WHERE x IS NOT NULL"),
        "meters_missing": _with("SELECT id FROM days GROUP BY id HAVING count(x) = 0"),
        "union_parts": cells(f"SELECT id, data, hour, x FROM days UNION ALL {FAST}"),
        "first_load": cells(FIRST_LOADS),
        # cleaning
        "null_zeros": cells(no_zeros("dirty")),
        "null_spikes": cells(no_spikes(no_zeros("dirty"))),
        "null_drops": cells(CLEAN),
        # imputation
        "interpolate_day": cells(interpolate("days")),
        "fill_day": cells(fill_day("days")),
        "carry_days": cells(carry("days")),
        "carry_whole_days": cells(carry(interpolate("days"))),
        "zero_fill": cells(zero("days")),
        "clamp_day": cells(clamp("dirty")),
        "impute_fast": cells(FAST),
        "impute_fast_clamped": cells(clamp(FAST, _LINE)),
        "impute_fast_rows": cells(clamp(zero(carry(interpolate("days"), _ROW_ORDER)))),
        "clamp_timeline": cells(clamp("dirty", _LINE)),
        "restore_known": cells(overlay(CLEAN, fast("dirty"))),
        "clip_negative": cells("SELECT id, data, hour, CASE WHEN x - 500 < 0 THEN 0 ELSE x - 500 END AS x FROM days"),
        "refine_rank_one": r4_cells(rank_one(carry(interpolate(CLEAN)), CLEAN)),
        "refine_rank_three": r4_cells(low_rank(carry(interpolate(CLEAN)), CLEAN, 3, 2)),
        "impute_scientific_fitted": r4_cells(scientific("dirty", "savgol")),
        "impute_scientific_rows_rank_one": r4_cells(scientific_rows("dirty")),
        "spline_day": r4_cells(spline(FAST)),
        "smooth_imputed_spline": r4_cells(clamp_gap_days(write_back(FAST, "days", spline(FAST)), "days")),
        "refine_whole_rank_one": r4_cells(rank_one(zero(carry(interpolate(CLEAN))), CLEAN, by_meter=False)),
        "impute_scientific_rank_one": r4_cells(scientific("dirty")),
        "impute_scientific_averaged": r4_cells(scientific("dirty", "clean")),
        "impute_hybrid_default": r4_cells(scientific("days")),
        "impute_hybrid_by_gaps": r4_cells(
            f"""SELECT * FROM ({scientific('days')}) WHERE id IN ({_LARGE})
              UNION ALL SELECT id, data, hour, x FROM ({FAST}) WHERE id NOT IN ({_LARGE})"""
        ),
        "refine_low_rank_facts": _with(_LOW_RANK_FACTS.format(src=_src(CLEAN))),
        "scientific_facts": _with(
            f"""SELECT id, count(*) AS cells, CASE WHEN count(x) = 0 THEN count(*) ELSE 0 END AS nulls_left,
                0 AS falls, 0 AS negatives, 0 AS below_known FROM ({CLEAN}) GROUP BY id"""
        ),
        "hybrid_routing": _with(
            f"""SELECT f.id, coalesce(large_gaps, 0) > 0 AS hard,
                CASE WHEN coalesce(large_gaps, 0) = 0 THEN {r6('f.mean')} END AS easy_mean
              FROM (SELECT id, avg(x) AS mean FROM ({FAST}) GROUP BY id) f
              LEFT JOIN (SELECT id, count(*) FILTER (WHERE NOT is_trailing AND gap_len > 72) AS large_gaps
                         FROM ({_LINE_RUNS}) GROUP BY id) g ON f.id = g.id"""
        ),
        "empty_days_null": cells(
            "SELECT id, data, hour, CASE WHEN x IS NOT NULL THEN max(x) OVER "
            f"({_DAY} {_SO_FAR}) END AS x FROM ({interpolate('days')})"
        ),
        "empty_days_dropped": cells(
            fast("SELECT * FROM days QUALIFY count(x) OVER (PARTITION BY id, data) > 0")
        ),
        "empty_days_interpolated": cells(interpolate("days", _LINE, "(d * 24 + hour)")),
        # smoothing
        "average_day": cells(average(FAST, 11)),
        "fit_day": cells(fitted(FAST)),
        "write_back": cells(write_back(FAST, "days", average(FAST, 11))),
        "clamp_gap_days": cells(clamp_gap_days("dirty", "days")),
        "smooth_imputed_average": cells(clamp_gap_days(write_back(FAST, "days", average(FAST, 11)), "days")),
        "smooth_imputed_fit": cells(clamp_gap_days(write_back(FAST, "days", fitted(FAST)), "days")),
        "smooth_timeline": cells(M6),
        "smooth_day_keep_observed": cells(clamp(overlay("days", average(FAST, 24)))),
        "smooth_timeline_keep_observed": cells(M8),
        "align_and_smooth": cells(overlay(FIRST_LOADS, M6)),
        # gaps
        "gap_totals": _with(
            f"""SELECT count(*) // 24 AS total_meters, 24 AS total_timestamps, count(*) AS total_values,
              count(*) - count(x) AS missing_count, {r6('100.0 * (count(*) - count(x)) / count(*)')} AS missing_pct
              FROM days"""
        ),
        "day_gaps": _with(f"SELECT {_KEY}, gap_start, gap_len, is_trailing FROM ({_DAY_RUNS})"),
        "timeline_gaps": _with(
            f"SELECT id, CAST(gap_start AS VARCHAR) AS gap_start, gap_len, is_trailing FROM ({_LINE_RUNS})"
        ),
        "gap_stats_by_day": _with(f"SELECT {_stats_columns(_KEY)} FROM ({_DAY_STATS})"),
        "gap_stats_by_meter": _with(f"SELECT {_stats_columns('id')} FROM ({_METER_STATS})"),
        "gap_distribution": _with(
            f"""SELECT count(*) FILTER (WHERE missing_pct = 0) AS none_missing,
              count(*) FILTER (WHERE missing_pct > 0 AND missing_pct <= 10) AS up_to_10,
              count(*) FILTER (WHERE missing_pct > 10 AND missing_pct <= 50) AS up_to_50,
              count(*) FILTER (WHERE missing_pct > 50) AS above_50,
              count(*) FILTER (WHERE missing_pct = 100) AS all_missing FROM ({_DAY_STATS})"""
        ),
        "gap_summary": _with(
            f"""SELECT max(max_gap_size) AS max_gap, {r6('avg(avg_gap_size)')} AS mean_avg_gap,
              median(median_gap_size) AS median_median_gap FROM ({_DAY_STATS})"""
        ),
        "worst_days": _with(
            f"SELECT {_stats_columns(_KEY)} FROM (SELECT * FROM ({_DAY_STATS}) ORDER BY missing_pct DESC, id, data LIMIT 10)"
        ),
        "worst_forty_days": _with(
            f"SELECT {_stats_columns(_KEY)} FROM (SELECT * FROM ({_DAY_STATS}) ORDER BY missing_pct DESC, id, data LIMIT 40)"
        ),
        "worst_thousand_days": _with(
            f"SELECT {_stats_columns(_KEY)} "
            f"FROM (SELECT * FROM ({_DAY_STATS}) ORDER BY missing_pct DESC, id, data LIMIT 1000)"
        ),
        "mean_missing_pct": _with(
            f"SELECT count(*) AS n, {r6('avg(missing_pct)')} AS avg_missing_pct FROM ({_DAY_STATS})"
        ),
        "recommendation_by_day": _advice(_DAY_STATS),
        "recommendation_by_meter": _advice(_METER_STATS),
        "gap_report": _with(f"SELECT CAST(seq AS INTEGER) AS seq, line FROM ({_REPORT})"),
        "gap_heatmap": _with(
            f"""SELECT {_KEY}, hour, CAST(x IS NULL AS INTEGER) AS is_missing FROM days
              WHERE (id, days.data) IN (SELECT (id, data) FROM (SELECT DISTINCT id, data FROM days)
                                   ORDER BY md5(id || CAST(data AS VARCHAR)) LIMIT 500)"""
        ),
        "gap_heatmap_sample": _with(
            f"""SELECT {_KEY}, hour, CAST(x IS NULL AS INTEGER) AS is_missing FROM days
              WHERE (id, days.data) IN (SELECT (id, data) FROM (SELECT DISTINCT id, data FROM days)
                                   ORDER BY md5(id || CAST(data AS VARCHAR)) LIMIT 25)"""
        ),
        "day_completeness": _with(
            """SELECT id, count(*) AS days, count(*) FILTER (WHERE n = 0) AS empty_days,
              count(*) FILTER (WHERE n BETWEEN 1 AND 23) AS partial_days, count(*) FILTER (WHERE n = 24) AS complete_days
              FROM (SELECT id, data, count(x) AS n FROM days GROUP BY id, data) GROUP BY id"""
        ),
        "first_days_check": _with(
            f"""SELECT id, CAST(data AS VARCHAR) AS data, missing_orig, zeros_imp,
              zeros_imp > 0 AND missing_orig = 24 AS empty_filled_with_zero
              FROM (SELECT id, data, count(*) - count(o) AS missing_orig, count(*) FILTER (WHERE x = 0) AS zeros_imp,
                           row_number() OVER (PARTITION BY id ORDER BY data) AS n
                    FROM ({beside(FAST, 'days')}) GROUP BY id, data) WHERE n <= 10"""
        ),
        "gap_classes_by_day": _with(f"SELECT {_gap_counts('')} FROM ({_DAY_RUNS})"),
        "gap_classes_on_timeline": _with(f"SELECT {_gap_counts('')} FROM ({_LINE_RUNS})"),
        "gap_classes_by_meter": _with(f"SELECT {_gap_counts('id,')} FROM ({_LINE_RUNS}) GROUP BY id"),
        # consumption and comparison
        "day_consumption": _with(
            f"SELECT {_KEY}, hour, {r6('used')} AS used "
            f"FROM (SELECT *, lead(x) OVER ({_DAY}) - x AS used FROM days) WHERE hour < 23"
        ),
        "network_mean": _with(
            f"SELECT CAST(data AS VARCHAR) AS data, hour, {r6('m')} AS mean_m3h FROM ({_network('days')})"
        ),
        "network_mean_filled": _with(
            f"SELECT CAST(data AS VARCHAR) AS data, hour, {r6('m')} AS mean_m3h FROM ({_network(FAST)})"
        ),
        "compare_network": _with(
            f"""SELECT CAST(ts AS VARCHAR) AS ts, orig_m3h, imp_m3h, {r6('diff_m3h')} AS diff_m3h,
              {s9('diff_percent')} AS diff_percent FROM ({_SERIES})"""
        ),
        "weekly_profile": _with(
            f"""SELECT CAST(isodow(ts) - 1 AS INTEGER) AS weekday, {r6('avg(orig_m3h)')} AS orig_m3h,
              {r6('avg(imp_m3h)')} AS imp_m3h FROM ({_SERIES}) GROUP BY isodow(ts)"""
        ),
        "agreement": _with(
            f"""SELECT {r6('avg(orig_m3h)')} AS orig_mean, {r6('avg(imp_m3h)')} AS imp_mean,
              {r6('corr(orig_m3h, imp_m3h)')} AS correlation, {s9('avg(abs(diff_percent))')} AS mean_abs_pct,
              count(*) AS points FROM ({_SERIES})"""
        ),
        "difference_histogram": _with(
            f"""SELECT CAST(b AS INTEGER) AS bin, {r6('-20 + b * 0.8')} AS low, coalesce(n, 0) AS n
              FROM range(50) r(b) LEFT JOIN (
                SELECT least(floor((p + 20) / 40 * 50), 49) AS slot, count(*) AS n
                FROM (SELECT {r6('diff_percent')} AS p FROM ({_SERIES})) WHERE p BETWEEN -20 AND 20 GROUP BY slot)
              ON slot = b"""
        ),
        "consumption_density": _with(
            f"""SELECT e.series, CAST(b AS INTEGER) AS bin, {r6('lo + b * (hi - lo) / 30')} AS low,
                {r6('coalesce(c, 0) / (n * (hi - lo) / 30)')} AS density
              FROM (SELECT series, min(x) AS lo, max(x) AS hi, count(*) AS n FROM pts GROUP BY series) e
              JOIN range(30) r(b) ON true
              LEFT JOIN (SELECT p.series, least(floor((x - lo) / (hi - lo) * 30), 29) AS slot, count(*) AS c
                         FROM pts p JOIN (SELECT series, min(x) AS lo, max(x) AS hi FROM pts GROUP BY series) q
                           ON p.series = q.series GROUP BY ALL) k ON k.series = e.series AND k.slot = b"""
        ).replace(
            "SELECT e.series",
            f""", pts AS (SELECT 'orig_m3h' AS series, orig_m3h AS x FROM ({_SERIES})
              UNION ALL SELECT 'imp_m3h', imp_m3h FROM ({_SERIES})) SELECT e.series""",
            1,
        ),
        "meter_consumption": cells(_used("days"), "used"),
        "consumption_pair": _with(
            f"SELECT {_KEY}, hour, {_TS}, {r6('x')} AS used_imp, {r6('o')} AS used_orig "
            f"FROM ({beside(_used(FAST), _used('days'))})"
        ),
        "series_stats": _with(
            f"""SELECT id, {r6('avg(x)')} AS mean, {r6('max(x)')} AS max, {r6('min(x)')} AS min,
              {r6('stddev_pop(x)')} AS std FROM ({FAST}) GROUP BY id"""
        ),
        "network_heatmap": cells(
            f"SELECT * FROM ({FAST}) WHERE (id, data) IN (SELECT (id, data) FROM "
            "(SELECT DISTINCT id, data FROM days) ORDER BY id, data LIMIT 100)"
        ),
        "meter_comparison": _with(
            f"SELECT {_KEY}, hour, {_TS}, {r6('o')} AS val_orig, {r6('x')} AS val_imp, "
            f"o IS NULL AND x IS NOT NULL AS is_imputed FROM ({beside(FAST, 'days')})"
        ),
        "imputation_stats": _with(
            f"""SELECT id, count(*) - count(x) AS points_imputed,
              {r6('100.0 * (count(*) - count(x)) / count(*)')} AS pct_imputed, count(*) AS total_points
              FROM days GROUP BY id"""
        ),
        "rows_per_meter": _with("SELECT id, count(DISTINCT data) AS n_rows FROM days GROUP BY id HAVING n_rows >= 10"),
        "comparison_meters": _with(_CHOSEN),
        "comparison_meters_few": _with(_CHOSEN.replace("LIMIT 150", "LIMIT 3").replace("LIMIT 4", "LIMIT 2")),
        "comparison_points": _with(
            f"SELECT {_KEY}, hour, {_TS}, {r6('o')} AS val_orig, {r6('x')} AS val_imp, o IS NULL AS is_imputed "
            f"FROM ({beside(FAST, 'days')}) WHERE id IN (SELECT id FROM ({_CHOSEN}))"
        ),
        "comparison_totals": _with(
            f"""SELECT id, count(*) AS n_total, count(*) - count(x) AS n_missing, count(DISTINCT data) AS n_dates
              FROM days WHERE id IN (SELECT id FROM ({_CHOSEN})) GROUP BY id"""
        ),
        "dashboard": _with(
            "SELECT count(DISTINCT id) AS meters, count(*) // 24 AS rows, 28 AS columns FROM days"
        ),
        "smoothing_difference": _with(
            f"""SELECT {r6('avg(d)')} AS mean_abs_diff, {r6('max(d)')} AS max_abs_diff,
              count(*) FILTER (WHERE d > 0.01) AS changed, count(*) AS cells,
              CASE WHEN max(d) < 0.001 THEN 'not applied' ELSE 'applied' END AS verdict
              FROM (SELECT abs(x - o) AS d FROM ({beside(FAST, M8)}))"""
        ),
        "smoothing_difference_strict": _with(
            f"""SELECT {r6('avg(d)')} AS mean_abs_diff, {r6('max(d)')} AS max_abs_diff,
              count(*) FILTER (WHERE d > 0.1) AS changed, count(*) AS cells,
              CASE WHEN max(d) < 0.01 THEN 'not applied' ELSE 'applied' END AS verdict
              FROM (SELECT abs(x - o) AS d FROM ({beside(FAST, M8)}))"""
        ),
        "value_ranges": _with(
            f"""SELECT id, {r6('min(x)')} AS min, {r6('max(x)')} AS max, {r6('avg(x)')} AS mean,
              count(*) - count(x) AS nulls FROM days GROUP BY id"""
        ),
        "workload": _with(
            f"""SELECT count(*) // 24 AS rows, count(DISTINCT id) AS meters,
              {r6('count(*) / 24 / count(DISTINCT id)')} AS rows_per_meter FROM days"""
        ),
        "quality_violations": _with(_violations(FAST)),
    }
    return sql
