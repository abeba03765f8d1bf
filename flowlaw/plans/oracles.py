"""DuckDB SQL with the same results as the registered queries, over tables of the same names."""

from __future__ import annotations

from functools import reduce
from itertools import combinations_with_replacement

from ..functions.coupled import joint_terms, waves
from ..functions.laws import laws
from ..functions.terms import Term, dictionary

ITEMS = "SELECT l_orderkey, l_linenumber, l_returnflag, CAST(l_quantity AS DOUBLE) AS q, CAST(l_extendedprice AS DOUBLE) AS p, CAST(l_discount AS DOUBLE) AS d, CAST(l_tax AS DOUBLE) AS t FROM lineitem"
SCALED = "SELECT l_orderkey, l_linenumber, l_quantity / 50 AS q, l_extendedprice / 100000 AS p, l_discount * 10 AS d, l_tax * 10 AS t FROM lineitem"
HOUR = "CAST(floor(epoch(ts) / 3600) AS BIGINT)"
GRID = f"""
hours AS (SELECT event_type AS series, {HOUR} AS h, value / 100 AS v FROM events),
grid AS (SELECT series, h // 64 AS j, CAST(h % 64 AS INTEGER) AS i, sum(v) AS u FROM hours GROUP BY ALL),
field AS (
  SELECT s.series, s.j, CAST(r.i AS INTEGER) AS i, coalesce(g.u, 0) AS u
  FROM (SELECT DISTINCT series, j FROM grid) s CROSS JOIN range(64) r(i)
  LEFT JOIN grid g ON g.series = s.series AND g.j = s.j AND g.i = r.i)"""
WAVES = """
waves AS (
  SELECT series, j, CAST(k AS INTEGER) AS k, sum(u * cos(2 * pi() / 64 * k * i)) AS a, sum(u * sin(2 * pi() / 64 * k * i)) AS b
  FROM field CROSS JOIN range(33) w(k) GROUP BY ALL)"""
SHARE = "CASE WHEN k = 0 OR k = 32 THEN 1.0 / 64 ELSE 2.0 / 64 END"
DERIVED = f"""
d1 AS (SELECT series, j, CAST(i AS INTEGER) AS i, sum(CASE WHEN k = 32 THEN 0 ELSE 2.0 / 64 END * k * (b * cos(2 * pi() / 64 * k * i) - a * sin(2 * pi() / 64 * k * i))) AS d
  FROM waves CROSS JOIN range(64) r(i) GROUP BY ALL),
d2 AS (SELECT series, j, CAST(i AS INTEGER) AS i, sum({SHARE} * k * k * (-a * cos(2 * pi() / 64 * k * i) - b * sin(2 * pi() / 64 * k * i))) AS d
  FROM waves CROSS JOIN range(64) r(i) GROUP BY ALL)"""


def mark(seed: int, *ids: str) -> str:
    """A number in [0, 1) from a row's ids."""
    text = f"concat_ws(':', '{seed}', {', '.join(ids)})"
    return f"(CAST(('0x' || substr(md5({text}), 1, 12)) AS BIGINT) / 281474976710656.0)"


def gauss(seed: int, *ids: str) -> str:
    return f"(sqrt(-2 * ln(1 - {mark(2 * seed, *ids)})) * cos(2 * pi() * {mark(2 * seed + 1, *ids)}))"


def value(t: Term) -> str:
    """A term over u, d1 and so on."""
    factors = ["u"] * t.p + [f"d{t.r}"] * t.q
    return reduce(lambda a, b: f"{a} * {b}", factors) if factors else "1.0"


def _field_terms() -> str:
    """The means of the terms of a dictionary over u, d1 and d2."""
    parts = []
    for place, t in enumerate(dictionary(2, 2, True, 2)):
        mean = f"round(avg({value(t)}), 3)"
        parts.append(f"SELECT series, '{t.name}' AS term, printf('%4d  %s', {place}, '{t.name}') AS line, CASE WHEN {mean} = 0 THEN 0 ELSE {mean} END AS mean, count(*) AS n FROM g GROUP BY series")
    return f"WITH {GRID}, {WAVES}, {DERIVED}, g AS (SELECT f.series, f.u, d1.d AS d1, d2.d AS d2 FROM field f JOIN d1 USING (series, j, i) JOIN d2 USING (series, j, i)) " + " UNION ALL ".join(parts)


def search(rows: str, names: list[str], most: int, nothing: float = 1e-18, slack: float = 0.5) -> str:
    """CTEs that end in found (grp, k, a, b, c, ca, cb, cc, left): by group, the best choice of 1 to most (2 or 3) terms and its coefficients.

    rows: a SELECT of grp, x0, x1 and so on, and y. All is done with the products of unit columns, whose matrix of two or three rows is
    inverted in closed form; left is what a choice leaves of the unit target, squared. chosen has the fewest terms that leave at most
    (1 + slack) squared times what the best choice of most leaves, or nothing.
    """
    n = len(names)
    columns = [*(f"x{i}" for i in range(n)), "y"]
    sums = ", ".join(f"sum({columns[i]} * {columns[j]}) AS g_{i}_{j}" for i in range(n + 1) for j in range(i, n + 1))
    listed = ", ".join(f"{{'i': {i}, 'j': {j}, 'v': g_{i}_{j}}}" for i in range(n + 1) for j in range(i, n + 1))
    pair = f"FROM u ab JOIN u ay ON ay.grp = ab.grp AND ay.i = ab.i AND ay.j = {n} JOIN u b_y ON b_y.grp = ab.grp AND b_y.i = ab.j AND b_y.j = {n}"
    out = f"""
raw AS ({rows}),
sums AS (SELECT grp, {sums} FROM raw GROUP BY grp),
upper AS (SELECT grp, unnest([{listed}], recursive := true) FROM sums),
size AS (SELECT grp, i, sqrt(v) AS len FROM upper WHERE i = j),
whole AS (SELECT grp, i, j, v FROM upper UNION ALL SELECT grp, j, i, v FROM upper WHERE i < j),
u AS (SELECT w.grp, w.i, w.j, CASE WHEN p.len * q.len > 0 THEN w.v / (p.len * q.len) ELSE 0 END AS v FROM whole w JOIN size p ON p.grp = w.grp AND p.i = w.i JOIN size q ON q.grp = w.grp AND q.i = w.j),
one AS (SELECT grp, 1 AS k, i AS a, -1 AS b, -1 AS c, v AS ca, 0.0 AS cb, 0.0 AS cc, 1 - v * v AS left_ FROM u WHERE j = {n} AND i < {n}),
two_ AS (SELECT ab.grp, ab.i AS a, ab.j AS b, (ay.v - ab.v * b_y.v) / (1 - ab.v * ab.v) AS ca, (b_y.v - ab.v * ay.v) / (1 - ab.v * ab.v) AS cb, ay.v AS ay, b_y.v AS b_y, ab.v AS ab
  {pair} WHERE ab.i < ab.j AND ab.j < {n} AND 1 - ab.v * ab.v > 1e-12),
two AS (SELECT grp, 2 AS k, a, b, -1 AS c, ca, cb, 0.0 AS cc, 1 - ca * ay - cb * b_y AS left_ FROM two_)"""
    union = "SELECT * FROM one UNION ALL SELECT * FROM two"
    if most == 3:
        out += f""",
three_ AS (SELECT t.*, ac.j AS c, ac.v AS ac, bc.v AS bc, cy.v AS cy, 1 + 2 * t.ab * ac.v * bc.v - t.ab * t.ab - ac.v * ac.v - bc.v * bc.v AS det
  FROM two_ t JOIN u ac ON ac.grp = t.grp AND ac.i = t.a AND ac.j > t.b AND ac.j < {n} JOIN u bc ON bc.grp = t.grp AND bc.i = t.b AND bc.j = ac.j JOIN u cy ON cy.grp = t.grp AND cy.i = ac.j AND cy.j = {n}),
three AS (SELECT grp, 3 AS k, a, b, c, ((1 - bc * bc) * ay + (ac * bc - ab) * b_y + (ab * bc - ac) * cy) / det AS ca, ((ac * bc - ab) * ay + (1 - ac * ac) * b_y + (ab * ac - bc) * cy) / det AS cb,
  ((ab * bc - ac) * ay + (ab * ac - bc) * b_y + (1 - ab * ab) * cy) / det AS cc, ay, b_y, cy FROM three_ WHERE det > 1e-12),
three_left AS (SELECT grp, k, a, b, c, ca, cb, cc, 1 - ca * ay - cb * b_y - cc * cy AS left_ FROM three)"""
        union += " UNION ALL SELECT * FROM three_left"
    out += f""",
found AS (SELECT * FROM ({union}) QUALIFY row_number() OVER (PARTITION BY grp, k ORDER BY left_) = 1),
chosen AS (SELECT f.* FROM found f JOIN (SELECT grp, left_ AS least FROM found WHERE k = {most}) m ON m.grp = f.grp WHERE f.left_ <= greatest({(1 + slack) ** 2} * m.least, {nothing}) QUALIFY row_number() OVER (PARTITION BY f.grp ORDER BY f.k) = 1),
named AS (SELECT grp, i, name FROM (SELECT DISTINCT grp FROM raw), (VALUES {", ".join(f"({i}, '{x}')" for i, x in enumerate(names))}) v(i, name)),
coefficients AS (SELECT grp, unnest([{{'i': a, 'unit': ca}}, {{'i': b, 'unit': cb}}, {{'i': c, 'unit': cc}}], recursive := true) FROM chosen),
terms AS (SELECT c.grp, c.i, n.name, c.unit * y.len / s.len AS coefficient FROM coefficients c JOIN named n ON n.grp = c.grp AND n.i = c.i JOIN size s ON s.grp = c.grp AND s.i = c.i JOIN size y ON y.grp = c.grp AND y.i = {n})"""
    return out


def enumeration(rows: str, names: list[str], most: int) -> str:
    """CTEs that end in best (k, s, left_): of each number of terms up to most, the best choice and what it leaves of the unit target, squared.

    All choices are listed. The products of a choice's unit columns and the target are reduced by one pivot after the other, so that the target's own is what is left.
    """
    n = len(names)
    out = f"{search(rows, names, 2)}, c1 AS (SELECT [CAST(i AS INTEGER)] AS s FROM range({n}) t(i))"
    for k in range(2, most + 1):
        out += f", c{k} AS (SELECT list_append(s, CAST(i AS INTEGER)) AS s FROM c{k - 1}, range({n}) t(i) WHERE i > s[-1])"
    union = " UNION ALL ".join(f"SELECT s FROM c{k}" for k in range(1, most + 1))
    out += f", c AS (SELECT row_number() OVER () AS id, s, list_append(s, {n}) AS e FROM ({union})), cells AS (SELECT id, s, i, unnest(e) AS j FROM (SELECT id, s, e, unnest(e) AS i FROM c)), m0 AS (SELECT id, s, cells.i, cells.j, v FROM cells JOIN u ON u.i = cells.i AND u.j = cells.j)"
    for t in range(1, most + 1):
        last = f"m{t - 1}"
        out += f", m{t} AS (SELECT m.id, m.s, m.i, m.j, CASE WHEN len(m.s) < {t} THEN m.v ELSE m.v - a.v * b.v / c.v END AS v FROM {last} m LEFT JOIN {last} a ON a.id = m.id AND a.i = m.i AND a.j = m.s[{t}] LEFT JOIN {last} b ON b.id = m.id AND b.j = m.j AND b.i = m.s[{t}] LEFT JOIN {last} c ON c.id = m.id AND c.i = m.s[{t}] AND c.j = m.s[{t}])"
    return out + f", best AS (SELECT len(s) AS k, s, v AS left_ FROM m{most} WHERE i = {n} AND j = {n} QUALIFY row_number() OVER (PARTITION BY len(s) ORDER BY v) = 1)"


def _products() -> tuple[str, list[str]]:
    """The products of up to two scaled columns as x0, x1 and so on."""
    choices = [x for k in (1, 2) for x in combinations_with_replacement("qpdt", k)]
    return ", ".join(f"{v} AS x{i}" for i, v in enumerate(["1.0", *(" * ".join(x) for x in choices)])), ["1", *(" ".join(x) for x in choices)]


def _exact_search() -> str:
    columns, names = _products()
    rows = f"SELECT 0 AS grp, {columns}, q + 2 * q * p - 1.5 * d + 0.7 * t * t + 0.05 * {gauss(13, 'l_orderkey', 'l_linenumber')} AS y FROM ({SCALED})"
    return f"WITH {enumeration(rows, names, 5)} SELECT CAST(k AS INTEGER) AS k, array_to_string(list_transform(s, lambda i: {names!r}[i + 1]), ', ') AS terms, round(sqrt(greatest(left_, 0)) * y.len, 3) AS residual FROM best, (SELECT len FROM size WHERE i = {len(names)}) y"


def _capped_terms() -> str:
    """Six times the column that has most in common with what is left of the target; each is then taken out of all others."""
    columns, names = _products()
    n = len(names)
    rows = f"SELECT 0 AS grp, {columns}, q + 2 * q * p - 1.5 * d + 0.7 * t * t + 0.05 * {gauss(13, 'l_orderkey', 'l_linenumber')} AS y FROM ({SCALED})"
    out = f"WITH {search(rows, names, 2)}, m0 AS MATERIALIZED (SELECT i, j, v FROM u)"
    for t in range(6):
        taken = f"AND i NOT IN ({' UNION ALL '.join(f'SELECT i FROM p{k}' for k in range(t))})" if t else ""
        out += f", p{t} AS MATERIALIZED (SELECT i FROM m{t} WHERE j = {n} AND i < {n} {taken} ORDER BY abs(v) DESC LIMIT 1)"
        out += f", m{t + 1} AS MATERIALIZED (SELECT m.i, m.j, CASE WHEN m.i = p.i THEN m.v / c.v ELSE m.v - a.v * b.v / c.v END AS v FROM p{t} p, m{t} m JOIN m{t} a ON a.i = m.i AND a.j = p.i JOIN m{t} b ON b.i = p.i AND b.j = m.j JOIN m{t} c ON c.i = p.i AND c.j = p.i)"
    picks = " UNION ALL ".join(f"SELECT i FROM p{t}" for t in range(6))
    return f"{out} SELECT n.name AS term, round(m.v * y.len / s.len, 4) AS coefficient FROM ({picks}) p JOIN m6 m ON m.i = p.i AND m.j = {n} JOIN named n ON n.i = p.i JOIN size s ON s.i = p.i JOIN size y ON y.i = {n}"


def _absolute_law() -> str:
    """Least squares over the items whose charges are right."""
    rows = f"SELECT 0 AS grp, 1.0 AS x0, q AS x1, p AS x2, d AS x3, t AS x4, p * d AS x5, p - 0.1 * p * d AS y FROM ({SCALED}) WHERE {mark(17, 'l_orderkey', 'l_linenumber')} >= 0.1"
    return f"WITH {search(rows, ['1', 'q', 'p', 'd', 't', 'p d'], 2)} SELECT name AS term, round(coefficient, 3) AS coefficient FROM terms"


def _charge_terms() -> tuple[str, list[str]]:
    names = ["1"] + [" ".join(x) for k in (1, 2) for x in combinations_with_replacement("qpdt", k)]
    values = ["1.0"] + [" * ".join(x) for k in (1, 2) for x in combinations_with_replacement("qpdt", k)]
    return ", ".join(f"{v} AS x{i}" for i, v in enumerate(values)) + ", p * (1 - d) AS y", names


def _charge(grp: str = "0", head: str = "WITH") -> str:
    columns, names = _charge_terms()
    return f"{head} {search(f'SELECT {grp} AS grp, {columns} FROM ({ITEMS})', names, 2)}"


def _field_law() -> str:
    terms = dictionary(2, 2, True, 2)
    columns = ", ".join(f"{value(t)} AS x{i}" for i, t in enumerate(terms))
    points = "SELECT u, d1.d AS d1, d2.d AS d2 FROM field JOIN d1 USING (series, j, i) JOIN d2 USING (series, j, i)"
    rows = f"SELECT 0 AS grp, {columns}, 0.05 * d2 - u * d1 AS y FROM ({points})"
    return f"WITH {GRID}, {WAVES}, {DERIVED}, {search(rows, [t.name for t in terms], 2)} SELECT name AS term, round(coefficient, 6) AS coefficient FROM terms"


def _smooth_fields(orders: int = 4) -> str:
    """CTEs that end in smooth (series, j, i, u, d1 and so on): fields of few waves with mean 0 and unit spread, and their derivatives."""
    turned = {0: "a * cos(w) + b * sin(w)", 1: "b * cos(w) - a * sin(w)", 2: "-a * cos(w) - b * sin(w)", 3: "-b * cos(w) + a * sin(w)"}
    shares = ", ".join(f"sum({SHARE} * pow(k, {r}) * ({turned[r % 4]})) AS s{r}" for r in range(orders + 1))
    return f"""{GRID}, {WAVES},
low AS (SELECT series, j, CAST(i AS INTEGER) AS i, {shares} FROM (SELECT *, 2 * pi() / 64 * k * i AS w FROM waves CROSS JOIN range(64) r(i) WHERE k <= 4) GROUP BY ALL),
flat AS (SELECT series, j, avg(s0) AS mean, stddev_pop(s0) AS spread FROM low GROUP BY ALL),
smooth AS (SELECT series, j, i, CASE WHEN spread < 1e-14 THEN 0 ELSE (s0 - mean) / spread END AS u, {", ".join(f"CASE WHEN spread < 1e-14 THEN 0 ELSE s{r} / spread END AS d{r}" for r in range(1, orders + 1))} FROM low JOIN flat USING (series, j))"""


def _law_recovery() -> str:
    """Smooth fields, their derivatives from the waves, rates with noise, and the search over the dictionary."""
    known = {n: laws()[n] for n in ("kdv", "burgers", "allen_cahn", "ks", "fisher_kpp", "kdv_burgers", "fitzhugh_nagumo")}
    terms = dictionary(3, 4, True, 2)
    rates = " UNION ALL ".join(f"SELECT '{n}' AS law, series, j, i, u, d1, d2, d3, d4, {' + '.join(f'({c!r}) * {value(t)}' for t, c in law.items())} AS r FROM smooth" for n, law in known.items())
    columns = ", ".join(f"{value(t)} AS x{i}" for i, t in enumerate(terms))
    truth = ", ".join(f"('{n}', {[t.name for t in law]!r})" for n, law in known.items())
    return f"""WITH {_smooth_fields()},
rates AS ({rates}),
{search(f"SELECT law || '|' || series AS grp, {columns}, r * (1 + 0.01 * {gauss(11, 'law', 'series', 'j', 'i')}) AS y FROM rates", [t.name for t in terms], 3)},
lists AS (SELECT grp, list(name ORDER BY i) AS names FROM terms GROUP BY grp),
known AS (SELECT * FROM (VALUES {truth}) v(law, names))
SELECT k.law, split_part(l.grp, '|', 2) AS series, array_to_string(l.names, ', ') AS terms, round(sqrt(c.left_) * y.len, 3) AS residual,
  round(len(list_intersect(l.names, k.names)) / len(list_distinct(list_concat(l.names, k.names))), 4) AS score
FROM lists l JOIN known k ON k.law = split_part(l.grp, '|', 1) JOIN chosen c USING (grp) JOIN size y ON y.grp = l.grp AND y.i = {len(terms)}"""


def _wide_terms() -> str:
    terms = dictionary(6, 7, True, 7)
    sums = ", ".join(f"sum(({value(t)}) * ({value(t)})) AS s{i}" for i, t in enumerate(terms))
    listed = ", ".join(f"{{'term': '{t.name}', 'size': s{i}}}" for i, t in enumerate(terms))
    return f"WITH {_smooth_fields(7)}, sums AS (SELECT {sums} FROM smooth), one AS (SELECT unnest([{listed}], recursive := true) FROM sums) SELECT term, round(log10(sqrt(size)), 6) AS size FROM one"


def _coupled_laws() -> str:
    def value_of(t) -> str:
        factors = [*t.fields, *([f"d{t.order}_{t.derived}"] if t.order else [])]
        return " * ".join(factors) or "1.0"

    terms, law = joint_terms(("u", "v"), 3, 2), waves()
    columns = ", ".join(f"{value_of(t)} AS x{i}" for i, t in enumerate(terms))
    rates = " UNION ALL ".join(f"SELECT pair || '|{f}_t' AS grp, {columns}, ({' + '.join(f'({c!r}) * {value_of(t)}' for t, c in law[f].items())}) * (1 + 0.01 * {gauss(19, chr(39) + f + chr(39), 'pair', 'j', 'i')}) AS y FROM both_" for f in ("u", "v"))
    return f"""WITH {_smooth_fields()},
both_ AS (SELECT a.series || '-' || b.series AS pair, a.j, a.i, a.u, a.d1 AS d1_u, a.d2 AS d2_u, b.u AS v, b.d1 AS d1_v, b.d2 AS d2_v FROM smooth a JOIN smooth b ON a.j = b.j AND a.i = b.i AND a.series < b.series),
{search(rates, [t.name for t in terms], 3)},
lists AS (SELECT grp, list(name ORDER BY i) AS names FROM terms GROUP BY grp)
SELECT split_part(l.grp, '|', 1) AS pair, split_part(l.grp, '|', 2) AS rate, array_to_string(l.names, ', ') AS terms, round(sqrt(greatest(c.left_, 0)) * y.len, 3) AS residual
FROM lists l JOIN chosen c USING (grp) JOIN size y ON y.grp = l.grp AND y.i = {len(terms)}"""


def eliminated(n: int) -> str:
    """CTEs that reduce the augmented matrix m0 (i, j, v), whose right side is column n, to the solution in column n of the last."""
    steps = [f"m{t + 1} AS MATERIALIZED (SELECT m.i, m.j, CASE WHEN m.i = {t} THEN m.v / c.v ELSE m.v - a.v * b.v / c.v END AS v FROM m{t} m JOIN m{t} a ON a.i = m.i AND a.j = {t} JOIN m{t} b ON b.i = {t} AND b.j = m.j JOIN m{t} c ON c.i = {t} AND c.j = {t})" for t in range(n)]
    return ", ".join(steps)


def _sparse_spline() -> str:
    x = "(hour(ts) + minute(ts) / 60) / 24"
    return f"""WITH e AS (SELECT row, col, sum(val) AS val FROM ({_entries('events', x, 8, 1)}) GROUP BY ALL),
m0 AS MATERIALIZED (SELECT CAST(a.col AS INTEGER) AS i, CAST(b.col AS INTEGER) AS j, sum(a.val * b.val) AS v FROM e a JOIN e b USING (row) GROUP BY ALL UNION ALL SELECT e.col, 8, sum(val * value) FROM e JOIN events ON event_id = row GROUP BY ALL),
f0 AS (SELECT i, j FROM range(8) a(i), range(9) b(j)),
m0_ AS MATERIALIZED (SELECT CAST(f0.i AS INTEGER) AS i, CAST(f0.j AS INTEGER) AS j, coalesce(v, 0) AS v FROM f0 LEFT JOIN m0 USING (i, j)), {eliminated(8).replace('FROM m0 m JOIN m0 a', 'FROM m0_ m JOIN m0_ a').replace('JOIN m0 b', 'JOIN m0_ b').replace('JOIN m0 c', 'JOIN m0_ c')}
SELECT i AS col, round(v, 4) AS level FROM m8 WHERE j = 8"""


def _surface() -> str:
    """The normal equations' matrix is the product of those of both axes."""
    axis = lambda n, parts: f"SELECT row AS p, col, sum(val) AS val FROM ({_entries(f'(SELECT CAST(i AS INTEGER) AS event_id, i FROM range({n}) t(i))', f'i / {n}', parts, 1)}) GROUP BY ALL"
    return f"""WITH a AS ({axis(24, 4)}), b AS ({axis(12, 3)}),
core AS (SELECT hour(ts) AS p, least(floor(value / 25), 11) AS q, count(*) AS y FROM events GROUP BY ALL),
ga AS (SELECT x.col AS k, y.col AS l, sum(x.val * y.val) AS v FROM a x JOIN a y USING (p) GROUP BY ALL), gb AS (SELECT x.col AS k, y.col AS l, sum(x.val * y.val) AS v FROM b x JOIN b y USING (p) GROUP BY ALL),
fa AS (SELECT x AS k, y AS l, coalesce(v, 0) AS v FROM range(4) s(x), range(4) t(y) LEFT JOIN ga ON ga.k = x AND ga.l = y), fb AS (SELECT x AS k, y AS l, coalesce(v, 0) AS v FROM range(3) s(x), range(3) t(y) LEFT JOIN gb ON gb.k = x AND gb.l = y),
m0 AS MATERIALIZED (SELECT fa.k * 3 + fb.k AS i, fa.l * 3 + fb.l AS j, fa.v * fb.v AS v FROM fa, fb UNION ALL SELECT a.col * 3 + b.col, 12, sum(a.val * b.val * y) FROM core JOIN a ON a.p = core.p JOIN b ON b.p = core.q GROUP BY ALL), {eliminated(12)}
SELECT CAST(i // 3 AS INTEGER) AS k, CAST(i % 3 AS INTEGER) AS l, round(v, 4) AS level FROM m12 WHERE j = 12"""


def _long_derivative() -> str:
    return f"""WITH {GRID},
r AS (SELECT series, min(j) AS first, (max(j) - min(j) + 1) * 64 AS n FROM field GROUP BY 1),
p AS (SELECT f.series, f.j - r.first AS block, f.i, (f.j - r.first) * 64 + f.i AS x, n, u FROM field f JOIN r USING (series)),
w AS (SELECT series, n, k, sum(u * cos(2 * pi() / n * k * x)) AS a, sum(u * sin(2 * pi() / n * k * x)) AS b FROM p CROSS JOIN range(1, 100000) t(k) WHERE 2 * k < n GROUP BY ALL),
d AS (SELECT p.series, block, i, round(sum(2.0 / p.n * k * (b * cos(2 * pi() / p.n * k * x) - a * sin(2 * pi() / p.n * k * x))) / any_value(p.n), 4) AS slope FROM p JOIN w ON w.series = p.series GROUP BY ALL)
SELECT series, block, i, CASE WHEN slope = 0 THEN 0 ELSE slope END AS slope FROM d"""


FIVE = f"SELECT 1.0 AS x0, q AS x1, p AS x2, d AS x3, t AS x4 FROM ({SCALED})"


def _five(select: str, target: str = "x2") -> str:
    """With u (products of unit columns of one and the scaled columns) and size, and n, the number of rows."""
    return f"WITH {search(f'SELECT 0 AS grp, x0, x1, x2, x3, x4, {target} AS y FROM ({FIVE})', ['1', 'q', 'p', 'd', 't'], 2)} {select}"


VOTES = """SELECT name AS term, count(*) FILTER (w > greatest(0.001 * most, 1e-10)) AS votes FROM (
  SELECT i, abs(c * y.len) AS w, greatest(abs(ca), abs(cb)) * y.len AS most FROM (SELECT a AS i, ca AS c, ca, cb FROM two UNION ALL SELECT b, cb, ca, cb FROM two), (SELECT len FROM size WHERE i = 5) y
) JOIN named USING (i) GROUP BY name"""


def _smooth() -> str:
    """The splines' matrix is the same after every interval, so waves solve its normal equations."""
    points = "SELECT CAST(i AS INTEGER) AS event_id, CAST(i AS INTEGER) AS i FROM range(64) p(i)"
    entries = _entries(f"({points})", "i / 64", 16, 3)
    return f"""WITH {GRID},
e AS (SELECT row AS i, col, sum(val) AS val FROM ({entries}) GROUP BY ALL),
g AS (SELECT q.col AS m, sum(p.val * q.val) AS v FROM e p JOIN e q ON q.i = p.i WHERE p.col = 0 GROUP BY 1),
eigen AS (SELECT k, sum(v * cos(2 * pi() * k * m / 16)) AS v FROM g CROSS JOIN range(16) w(k) GROUP BY 1),
inverse AS (SELECT d, sum(cos(2 * pi() * k * d / 16) / v) / 16 AS v FROM eigen CROSS JOIN range(16) r(d) GROUP BY 1),
side AS (SELECT series, j, col, sum(val * u) AS v FROM field JOIN e USING (i) GROUP BY ALL),
c AS (SELECT series, j, r.d AS col, sum(s.v * n.v) AS v FROM side s CROSS JOIN range(16) r(d) JOIN inverse n ON n.d = (r.d - s.col + 16) % 16 GROUP BY ALL),
s AS (SELECT series, j, e.i, sum(e.val * c.v) AS s FROM e JOIN c ON c.col = e.col GROUP BY ALL)
SELECT series, j, i, round(u, 4) AS u, round(s, 4) AS s FROM field JOIN s USING (series, j, i)"""


def _signal_rows() -> str:
    """Of the six longest rows, three times the one that is longest beside those before."""
    names = ("q", "p", "d", "t")
    dot = lambda a, b: " + ".join(f"{a}.{n} * {b}.{n}" for n in names)
    less = ", ".join(f"a.{n} - ({dot('a', 'b')}) / b.len2 * b.{n} AS {n}" for n in names)
    out = f"WITH l0 AS (SELECT *, sqrt(q * q + p * p + d * d + t * t) AS size FROM (SELECT ((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey AS row_id, l_quantity / 50 AS q, l_extendedprice / 100000 AS p, l_discount * 10 AS d, l_tax * 10 AS t FROM lineitem) ORDER BY size DESC, row_id LIMIT 6)"
    for k in range(3):
        out += f", m{k} AS (SELECT *, {dot('a', 'a')} AS len2 FROM l{k} a), b{k} AS (SELECT * FROM m{k} ORDER BY len2 DESC, row_id LIMIT 1), l{k + 1} AS (SELECT a.row_id, {less}, a.size FROM m{k} a, b{k} b WHERE a.row_id <> b.row_id)"
    return out + " SELECT row_id, round(size, 6) AS size FROM (" + " UNION ALL ".join(f"SELECT row_id, size FROM b{k}" for k in range(3)) + ")"


def _uneven() -> str:
    """Hats over the hours 0, 6, 9, 18 and 24."""
    t, x = (0, 6, 9, 18, 24), "hour(ts) + minute(ts) / 60"
    parts = []
    for k in range(4):
        width, inside = t[k + 1] - t[k], f"FROM (SELECT {x} AS x FROM events) WHERE x >= {t[k]} AND x < {t[k + 1]}"
        parts += [f"SELECT {k} AS col, ({t[k + 1]} - x) / {width} AS v, -1.0 / {width} AS s {inside}", f"SELECT {k + 1} AS col, (x - {t[k]}) / {width} AS v, 1.0 / {width} AS s {inside}"]
    return f"SELECT col, round(sum(v), 4) AS total, round(sum(s), 4) AS slope FROM ({' UNION ALL '.join(parts)}) GROUP BY 1"


def _gram(select: str) -> str:
    names = ("q", "p", "d", "t")
    return " UNION ALL ".join(select.format(a=a, b=b) for i, a in enumerate(names) for b in names[i:])


def basis(phase: str, degree: int) -> list[str]:
    """Splines over one interval in closed form: blends of those of one degree less."""
    out = ["1.0"]
    for d in range(1, degree + 1):
        low = [None, *out, None]
        out = [" + ".join(x for x in (f"({low[k]}) * ({phase} + {d - k}) / {d}" if low[k] else "", f"({low[k + 1]}) * ({k + 1} - {phase}) / {d}" if low[k + 1] else "") if x) for k in range(d + 1)]
    return out


def _entries(source: str, x: str, intervals: int, degree: int, derivative: int = 0) -> str:
    """row, col, val of a design matrix."""
    values = basis("f", degree)
    if derivative:
        low = ["0.0", *basis("f", degree - 1), "0.0"]
        values = [f"(({low[k]}) - ({low[k + 1]})) * {intervals}" for k in range(degree + 1)]
    place = f"SELECT event_id, (({x}) - floor({x})) * {intervals} AS z FROM {source}"
    cells = f"SELECT event_id, least(floor(z), {intervals - 1}) AS c, z - least(floor(z), {intervals - 1}) AS f FROM ({place})"
    return " UNION ALL ".join(f"SELECT event_id AS row, CAST((c + {k}) % {intervals} AS INTEGER) AS col, {v} AS val FROM ({cells})" for k, v in enumerate(values))


def _spline(degree: int, derivative: int) -> str:
    x = "hour(ts) / 24 + minute(ts) / 1440"
    return f"SELECT col, round(sum(val), 4) AS total, round(sum(val * val), 4) AS squares FROM ({_entries('events', x, 8, degree, derivative)}) GROUP BY col"


def _runs() -> str:
    return """
    marked AS (SELECT user_id, event_id, CASE WHEN event_type <> 'click' THEN event_type END AS v,
        lag(CASE WHEN event_type <> 'click' THEN event_type END) OVER w AS was, row_number() OVER w AS n
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    numbered AS (SELECT *, sum(CASE WHEN n = 1 OR v IS DISTINCT FROM was THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM marked),
    runs AS (SELECT user_id, any_value(v) AS value, min(event_id) AS start, max(event_id) AS stop, count(*) AS length FROM numbered GROUP BY user_id, run)"""


CHARGE = _charge() + " SELECT name AS term, round(coefficient, 6) AS coefficient FROM terms"


def oracle_sql() -> dict[str, str]:
    return {
        "q_poly_terms": "SELECT event_id, 1.0::DOUBLE AS one, round(u, 6) AS u1, round(u * u, 6) AS u2, round(u * u * u, 6) AS u3, round(sin(u), 6) AS sin_u, round(cos(u), 6) AS cos_u FROM (SELECT event_id, value / 100 AS u FROM events)",
        "q_cross_terms": f"SELECT l_returnflag, round(sum(q * p) / 1e6, 4) AS q_p, round(sum(p * d) / 1e6, 4) AS p_d, round(sum(d * t), 4) AS d_t, round(sum(q * q) / 1e6, 4) AS q_2 FROM ({ITEMS}) GROUP BY 1",
        "q_field_terms": _field_terms(),
        "q_col_norms": f"SELECT round(sqrt(sum(q * q)), 6) AS q, round(sqrt(sum(p * p)), 6) AS p, round(sqrt(sum(d * d)), 6) AS d, round(sqrt(sum(t * t)), 6) AS t FROM ({SCALED})",
        "q_normalise": f"WITH n AS (SELECT sqrt(sum(q * q)) AS nq, sqrt(sum(p * p)) AS np, sqrt(count(*)) AS c FROM ({SCALED})) SELECT l_orderkey, l_linenumber, round(q / nq * c, 6) AS q, round(p / np * c, 6) AS p FROM ({SCALED}), n",
        "q_gram": _gram(f"SELECT '{{a}}' AS a, '{{b}}' AS b, round(sum({{a}} * {{b}}), 4) AS value FROM ({SCALED})"),
        "q_corr_abs": " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(abs(sum({a} * {b}) / (sqrt(sum({a} * {a})) * sqrt(sum({b} * {b})))), 6) AS likeness FROM ({SCALED})" for i, a in enumerate("qpdt") for b in "qpdt"[i + 1 :]),
        "q_ols_1": f"SELECT l_returnflag, round(regr_slope(p, q), 3) AS slope, round(regr_intercept(p, q), 2) AS intercept FROM ({ITEMS}) GROUP BY 1",
        "q_ols_2": CHARGE,
        "q_omp_first_pick": _five("SELECT n.name AS term, round(abs(u.v) * y.len, 4) AS gain FROM u JOIN named n USING (i) JOIN size y ON y.i = 5 WHERE u.j = 5 AND u.i < 5 ORDER BY abs(u.v) DESC LIMIT 1", "x2 * (1 - x3 / 10)"),
        "q_lasso_1d": "WITH g AS (SELECT l_returnflag, sum(l_quantity / 50 * l_extendedprice / 100000) / sqrt(sum(l_quantity / 50 * l_quantity / 50)) AS c, count(*) AS n FROM lineitem GROUP BY 1) SELECT l_returnflag, round(sign(c) * greatest(abs(c) - 0.005 * n, 0), 6) AS weight FROM g",
        "q_residual": f"SELECT round(sqrt(sum(r * r)), 6) AS l2, round(sum(abs(r)), 4) AS l1 FROM (SELECT p * (1 - d / 10) - 0.95 * p - 0.01 * q AS r FROM ({SCALED}))",
        "q_relative_error": "WITH s AS (SELECT l_orderkey AS o_orderkey, sum(l_extendedprice * (1 - l_discount)) AS s FROM lineitem GROUP BY 1) SELECT o_orderstatus, round(sqrt(sum((s - o_totalprice) * (s - o_totalprice))) / sqrt(sum(o_totalprice * o_totalprice)), 6) AS error, count(*) AS n FROM orders JOIN s USING (o_orderkey) GROUP BY 1",
        "q_add_noise": f"WITH s AS (SELECT stddev_pop(q) AS sq, stddev_pop(p) AS sp FROM ({SCALED})) SELECT l_orderkey, l_linenumber, round(q + 0.01 * sq * {gauss(3, 'l_orderkey', 'l_linenumber')}, 6) AS q, round(p + 0.01 * sp * {gauss(4, 'l_orderkey', 'l_linenumber')}, 6) AS p FROM ({SCALED}), s",
        "q_hourly_grid": f"WITH {GRID} SELECT series, j, i, round(u, 4) AS u FROM grid",
        "q_snapshots": f"WITH {GRID} SELECT series, j, count(*) AS n, round(sum(u), 4) AS total, round(max(u), 4) AS most, round(min(u), 4) AS least FROM field GROUP BY series, j",
        "q_dft": f"WITH {GRID}, {WAVES} SELECT series, j, k, round(a, 4) AS a, round(b, 4) AS b FROM waves WHERE k <= 4",
        "q_spectral_ux": f"WITH {GRID}, {WAVES}, {DERIVED} SELECT series, j, i, round(d, 3) AS d FROM d1",
        "q_spectral_uxx": f"WITH {GRID}, {WAVES}, {DERIVED} SELECT series, j, i, round(d, 3) AS d FROM d2",
        "q_low_pass": f"WITH {GRID}, {WAVES}, low AS (SELECT series, j, CAST(i AS INTEGER) AS i, round(sum({SHARE} * (a * cos(2 * pi() / 64 * k * i) + b * sin(2 * pi() / 64 * k * i))), 4) AS u FROM waves CROSS JOIN range(64) r(i) WHERE k <= 4 GROUP BY ALL) SELECT series, j, i, CASE WHEN u = 0 THEN 0 ELSE u END AS u FROM low",
        "q_minmax_rescale": f"WITH {GRID}, m AS (SELECT series, j, min(u) AS low, max(u) - min(u) AS span FROM field GROUP BY ALL) SELECT series, j, i, round(CASE WHEN span < 1e-14 THEN 0 ELSE (u - low) / span END, 6) AS u FROM field JOIN m USING (series, j)",
        "q_time_derivative": f"WITH {GRID} SELECT series, j, i, round(CASE WHEN lag(u) OVER w IS NULL THEN (lead(u) OVER w - u) / 0.5 WHEN lead(u) OVER w IS NULL THEN (u - lag(u) OVER w) / 0.5 ELSE lead(u) OVER w - lag(u) OVER w END, 4) AS u_t FROM field WINDOW w AS (PARTITION BY series, i ORDER BY j)",
        "q_diffuse": f"WITH {GRID}, one AS (SELECT c.series, c.j, c.i, c.u + 0.2 * (r.u - 2 * c.u + l.u) AS u FROM field c JOIN field r ON r.series = c.series AND r.j = c.j AND r.i = (c.i + 1) % 64 JOIN field l ON l.series = c.series AND l.j = c.j AND l.i = (c.i + 63) % 64) SELECT c.series, c.j, c.i, round(c.u + 0.2 * (r.u - 2 * c.u + l.u), 4) AS u FROM one c JOIN one r ON r.series = c.series AND r.j = c.j AND r.i = (c.i + 1) % 64 JOIN one l ON l.series = c.series AND l.j = c.j AND l.i = (c.i + 63) % 64",
        "q_topk_norm": f"SELECT l_orderkey, l_linenumber, round(s, 6) AS size FROM (SELECT *, sqrt(q * q + p * p + d * d + t * t) AS s FROM ({SCALED})) ORDER BY s DESC, l_orderkey, l_linenumber LIMIT 100",
        "q_head_rows": "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderkey < 1000 GROUP BY 1",
        "q_fraction_rows": f"SELECT l_linenumber AS line, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem WHERE {mark(5, 'l_orderkey', 'l_linenumber')} < 0.1 GROUP BY 1",
        "q_uniform_rows": f"SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY {mark(1, 'l_orderkey', 'l_linenumber')}, l_orderkey, l_linenumber LIMIT 500",
        "q_semi_rows": f"SELECT l_orderkey, l_linenumber, round(l_extendedprice, 2) AS p FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE {mark(2, 'o_orderkey')} < 0.05)",
        "q_jaccard": "WITH g AS (SELECT user_id, event_type, bool_or(hour(ts) % 2 = 0) AS a, bool_or(hour(ts) % 2 = 1) AS b FROM events GROUP BY 1, 2) SELECT user_id, round(count(*) FILTER (a AND b) / count(*), 6) AS score, count(*) FILTER (a AND NOT b) = 0 AS covered FROM g GROUP BY 1",
        "q_plateau_runs": f"WITH {_runs()} SELECT * FROM runs",
        "q_select_plateau": f"WITH {_runs()} SELECT user_id, value, start, stop, length FROM runs WHERE length >= 2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value IS NULL, start) = 1",
        "q_group_pairs": "WITH c AS (SELECT n_nationkey, n_regionkey, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2) SELECT a.n_nationkey AS first, b.n_nationkey AS second, a.n + b.n AS customers FROM c a JOIN c b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
        "q_experiment_grid": "WITH e AS (SELECT event_type, CAST(hour(ts) AS INTEGER) AS hour FROM events) SELECT t.event_type, h.hour, count(e.hour) AS n FROM (SELECT DISTINCT event_type FROM e) t CROSS JOIN (SELECT DISTINCT hour FROM e) h LEFT JOIN e ON e.event_type = t.event_type AND e.hour = h.hour GROUP BY 1, 2",
        "q_resume_anti": "SELECT c_custkey, priority FROM customer CROSS JOIN (SELECT DISTINCT o_orderpriority AS priority FROM orders) p WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c_custkey AND o.o_orderpriority = priority)",
        "q_votes": _five(VOTES),
        "q_survivors": _five(f"SELECT term, votes FROM ({VOTES}) WHERE votes >= (SELECT CASE WHEN min(votes) >= 2 THEN 4 ELSE 2 END FROM ({VOTES}))"),
        "q_laplacian": _five("SELECT name AS term, round(sum(abs(v)), 6) AS degree FROM u JOIN named USING (i) WHERE u.i < 5 AND j < 5 AND u.i <> j GROUP BY 1"),
        "q_success_pivot": "WITH r AS (SELECT user_id, event_type, hour(ts) // 12 AS half, avg(CASE WHEN value > 40 THEN 1.0 ELSE 0 END) AS score FROM events GROUP BY 1, 2, 3) SELECT event_type, count(*) FILTER (half = 0 AND score = 1) AS first_half, count(*) FILTER (half = 1 AND score = 1) AS second_half FROM r GROUP BY 1",
        "q_mean_time": "SELECT o_orderpriority, round(coalesce(avg(o_totalprice) FILTER (o_orderstatus = 'F'), 0), 2) AS price FROM orders GROUP BY 1",
        "q_threshold_support": CHARGE,
        "q_bspline_linear": _spline(1, 0),
        "q_bspline_cubic": _spline(3, 0),
        "q_bspline_slope": _spline(2, 1),
        "q_kron": f"SELECT a.col * 3 + b.col AS col, round(sum(a.val * b.val), 4) AS total FROM ({_entries('events', 'hour(ts) / 24', 4, 1)}) a JOIN ({_entries('events', 'value / 500', 3, 1)}) b ON a.row = b.row GROUP BY 1",
        "q_truth_flags": _charge() + " SELECT name AS term, name = 'p' AS right, printf('  %18s: %+.6f', name, coefficient) AS line, count(*) OVER () AS significant FROM terms",
        "q_window_slope": f"WITH g AS (SELECT {HOUR} // 6 * 6 AS hour, event_type, count(*) AS n, sum(x) AS sx, sum(value) AS sy, sum(x * x) AS sxx, sum(x * value) AS sxy FROM (SELECT *, CAST(minute(ts) AS DOUBLE) AS x FROM events) GROUP BY 1, 2) SELECT hour, event_type, n, round(CASE WHEN n * sxx - sx * sx > 0 THEN (n * sxy - sx * sy) / (n * sxx - sx * sx) END, 4) AS slope FROM g",
        "q_ccp": CHARGE,
        "q_omp": CHARGE,
        "q_lasso": CHARGE,
        "q_field_law": _field_law(),
        "q_best_subset": CHARGE,
        "q_law_recovery": _law_recovery(),
        "q_exact_search": _exact_search(),
        "q_coupled_laws": _coupled_laws(),
        "q_wide_terms": _wide_terms(),
        "q_sparse_spline": _sparse_spline(),
        "q_surface": _surface(),
        "q_long_derivative": _long_derivative(),
        "q_isolated_sweep": "SELECT c_nationkey, CASE WHEN count(*) >= 60 THEN round(avg(CAST(c_acctbal AS DOUBLE)), 2) END AS mean, CASE WHEN count(*) < 60 THEN 'ValueError: ' || count(*) || ' customers' END AS error FROM customer GROUP BY 1",
        "q_absolute_law": _absolute_law(),
        "q_capped_terms": _capped_terms(),
        "q_step_error": f"WITH {GRID}, d AS (SELECT series, lead(u) OVER w - lag(u) OVER w AS f, (lead(u, 2) OVER w - lag(u, 2) OVER w) / 2 AS c FROM field WINDOW w AS (PARTITION BY series, i ORDER BY j)) SELECT series, round(sqrt(sum((c - f) * (c - f))) / (sqrt(sum(f * f)) + 1e-10), 4) AS error, sqrt(sum((c - f) * (c - f))) / (sqrt(sum(f * f)) + 1e-10) < 0.5 AS settled FROM d WHERE f IS NOT NULL AND c IS NOT NULL GROUP BY 1",
        "q_group_laws": _charge("l_returnflag") + " SELECT grp AS l_returnflag, array_to_string(list_sort(list(name)), ',') AS terms, round(len(list_intersect(list(name), ['p', 'p d'])) / len(list_distinct(list_concat(list(name), ['p', 'p d']))), 4) AS score FROM terms GROUP BY grp",
        "q_smooth": _smooth(),
        "q_signal_rows": _signal_rows(),
        "q_identify": _charge() + ", s AS (SELECT name AS term, round(coefficient, 6) AS coefficient FROM terms) SELECT sampler, s.* FROM s, (VALUES ('random'), ('signal_qr'), ('qr'), ('full')) v(sampler)",
        "q_sensor_noise": f"WITH {GRID}, s AS (SELECT stddev_pop(u) AS s FROM field), f AS (SELECT series, min(j) AS first FROM field GROUP BY 1) SELECT series, j, i, round(CASE WHEN j = first THEN u ELSE u + 0.01 * s.s * {gauss(7, 'series', 'j', 'i')} END, 6) AS u FROM field JOIN f USING (series), s",
        "q_snapshot_store": f"WITH {GRID} SELECT series, j, count(*) AS n, round(sum(u), 4) AS total FROM field GROUP BY ALL",
        "q_bspline_uneven": _uneven(),
        "q_spline_fit": "SELECT CAST(k AS INTEGER) AS step, round(avg(value), 4) AS level FROM (SELECT value, CASE WHEN x < 6 THEN 0 WHEN x < 9 THEN 1 WHEN x < 18 THEN 2 ELSE 3 END AS k FROM (SELECT value, hour(ts) + minute(ts) / 60 AS x FROM events)) GROUP BY 1",
        "q_trajectories": f"WITH {GRID}, d AS (SELECT series, j, i, u, CASE WHEN lag(u) OVER w IS NULL THEN (lead(u) OVER w - u) / 0.5 WHEN lead(u) OVER w IS NULL THEN (u - lag(u) OVER w) / 0.5 ELSE lead(u) OVER w - lag(u) OVER w END AS v FROM field WINDOW w AS (PARTITION BY series, i ORDER BY j)) SELECT series, j, round(sqrt(sum(u * u)), 4) AS length, round(sqrt(sum(v * v)), 4) AS rate FROM d GROUP BY ALL",
    }
