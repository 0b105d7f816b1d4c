"""Registered queries of trained models and of sequential rules, with SQL by recursion or by what a made-up series must give."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import chains, disaggregate, eventbased, models, resample, sections, simulate
from gridloom.plans import registry
from gridloom.plans.registry import DAY, EV, STATES, query, r6
from gridloom.sources import store

# Two devices that repeat every four seconds, and the mains that hold both: training has to find them again exactly.
PATTERN = {2: (0, 200, 0, 200), 3: (0, 0, 1000, 1000)}
_FOUR = f"""SELECT t * 1000000 AS t, CAST(([{', '.join(map(str, PATTERN[2]))}])[t % 4 + 1] AS DOUBLE) AS d2, CAST(([{', '.join(map(str, PATTERN[3]))}])[t % 4 + 1] AS DOUBLE) AS d3 FROM range(4000) r(t)"""


def four(s) -> tuple[DataFrame, DataFrame]:
    """(readings of the devices, readings of the mains)"""
    t = s.range(4000).select((F.col("id") * sections.US).alias("t"), "id")
    value = lambda m: F.element_at(F.array(*(F.lit(float(x)) for x in m)), (F.col("id") % 4 + 1).cast("int"))
    each = [t.select(F.lit(m).cast("long").alias("meter"), "t", value(p).alias("value"), "id") for m, p in PATTERN.items()]
    both = value([a + b for a, b in zip(*PATTERN.values(), strict=True)])
    return each[0].unionByName(each[1]), t.select(F.lit(1).cast("long").alias("meter"), "t", both.alias("value"), "id")


@query(_FOUR)
def co_trained(s, d):
    model = models.CombinatorialOptimisation()
    devices, mains = four(s)
    model.train(devices)
    return model.disaggregate(mains).select("t", F.col("2").alias("d2"), F.col("3").alias("d3"))


@query(_FOUR)
def fhmm_trained(s, d):
    model = models.FactorialChains(longest=500)
    devices, mains = four(s)
    model.train(devices)
    return model.disaggregate(mains).select("t", F.col("2").alias("d2"), F.col("3").alias("d3"))


@query("SELECT t * 1000000 AS t, CASE WHEN (t - 1) // 20 % 2 = 1 AND t > 0 THEN 300.0::DOUBLE ELSE 0.0::DOUBLE END AS power FROM range(2000) r(t)")
def hart_trained(s, d):
    """A device of 300 W that goes on and off every 20 seconds; its power is filled in from the reading after each event."""
    mains = s.range(2000).select(F.lit(1).cast("long").alias("meter"), (F.col("id") * sections.US).alias("t"), F.when(F.expr("id div 20 % 2 = 1"), 300.0).otherwise(0.0).alias("value"), "id")
    return models.Hart().disaggregate(mains).select("t", F.col("device 1").alias("power"))


def _viterbi_sql(stay: float = 0.95, variance: float = 5.0) -> str:
    """The best path by a recursion that carries the scores of all combinations and their back pointers, then one back."""
    combos = list(itertools.product(*STATES.values()))
    n = len(combos)
    move = [[math.prod(stay if a == b else (1 - stay) / max(len(v) - 1, 1) for a, b, v in zip(x, y, STATES.values(), strict=True)) for y in combos] for x in combos]
    logs = "[" + ", ".join("[" + ", ".join(f"ln({move[i][j]!r}::DOUBLE)" for i in range(n)) + "]" for j in range(n)) + "]"
    totals = "[" + ", ".join(f"{sum(c)!r}::DOUBLE" for c in combos) + "]"
    fit = lambda v: f"list_transform(mt.total, lambda x: -(({v} - x) * ({v} - x)) / {2 * variance!r}::DOUBLE)"
    grown = f"list_transform(range(1, {n + 1}), lambda j: list_transform(range(1, {n + 1}), lambda i: w.best[i] + mt.logs[j][i]))"
    names = ", ".join(f"CAST(([{', '.join(repr(c[k]) for c in combos)}])[b.j] AS DOUBLE) AS {name}" for k, name in enumerate(STATES))
    return f"""WITH RECURSIVE {EV}, mt AS MATERIALIZED (SELECT {logs} AS logs, {totals} AS total),
o AS MATERIALIZED (SELECT meter, t, value, row_number() OVER (PARTITION BY meter ORDER BY t, id) AS k, count(*) OVER (PARTITION BY meter) AS n FROM ev WHERE value IS NOT NULL),
w(meter, k, best, back) AS (SELECT o.meter, o.k, list_transform({fit('o.value')}, lambda x: x - ln({n})), CAST([] AS BIGINT[]) FROM o, mt WHERE k = 1
UNION ALL SELECT z.meter, z.k, list_transform(range(1, {n + 1}), lambda j: list_max(z.g[j]) + z.f[j]), list_transform(range(1, {n + 1}), lambda j: list_position(z.g[j], list_max(z.g[j]))) FROM (SELECT o.meter, o.k, {grown} AS g, {fit('o.value')} AS f FROM w JOIN o ON o.meter = w.meter AND o.k = w.k + 1, mt) z),
p AS MATERIALIZED (SELECT * FROM w),
b(meter, k, j) AS (SELECT p.meter, p.k, list_position(p.best, list_max(p.best)) FROM p JOIN o ON o.meter = p.meter AND o.k = p.k WHERE p.k = o.n
UNION ALL SELECT b.meter, b.k - 1, p.back[b.j] FROM b JOIN p ON p.meter = b.meter AND p.k = b.k WHERE b.k > 1)
SELECT o.meter, o.t, {names} FROM b JOIN o ON o.meter = b.meter AND o.k = b.k"""


@query(_viterbi_sql())
def fhmm_decode(s, d):
    return disaggregate.fhmm_decode(store.events(s, d), STATES)


def _building_sql() -> str:
    """The same recursion, each building with the levels of its own devices: 0 and the rounded mean of the small and of the large readings."""
    sql = _viterbi_sql()
    move = [[math.prod(0.95 if a == b else 0.05 for a, b in zip(x, y, strict=True)) for y in itertools.product(range(2), repeat=2)] for x in itertools.product(range(2), repeat=2)]
    logs = "[" + ", ".join("[" + ", ".join(f"ln({move[i][j]!r}::DOUBLE)" for i in range(4)) + "]" for j in range(4)) + "]"
    start = sql.index("mt AS MATERIALIZED"), sql.index("o AS MATERIALIZED")
    sql = sql[: start[0]] + f"""lv AS MATERIALIZED (SELECT meter % 10 AS building, coalesce(round_even(avg(value) FILTER (value < 50), 0), 0.0) AS a, coalesce(round_even(avg(value) FILTER (value >= 50), 0), 0.0) AS b FROM ev GROUP BY 1),
mt AS MATERIALIZED (SELECT building, {logs} AS logs, [0.0, a, b, a + b] AS total FROM lv), """ + sql[start[1] :]
    n = len(list(itertools.product(*STATES.values())))
    sql = sql.replace(f"range(1, {n + 1})", "range(1, 5)").replace(f"ln({n})", "ln(4)").replace("mt WHERE k = 1", "mt WHERE k = 1 AND building = o.meter % 10").replace("o.k = w.k + 1, mt)", "o.k = w.k + 1 JOIN mt ON building = o.meter % 10)")
    head = sql[: sql.rindex("SELECT o.meter, o.t,")]
    return head + """, r AS (SELECT o.meter, o.t, o.k, j FROM b JOIN o ON o.meter = b.meter AND o.k = b.k)
SELECT meter % 10 AS building, meter, t, d.device, CASE WHEN d.device = 'small' THEN (j - 1) % 2 * lv.a ELSE (j - 1) // 2 * lv.b END AS power FROM r JOIN lv ON building = meter % 10, (VALUES ('large'), ('small')) d(device)"""


@query(_building_sql())
def chains_by_building(s, d):
    """The meters of ten buildings by the small and the large device of each, whose level is the mean of its building's readings."""
    ev = store.events(s, d).withColumn("building", F.col("meter") % 10)
    level = lambda on: F.coalesce(F.rint(F.avg(F.when(on, F.col("value")))), F.lit(0.0))
    wide = ev.groupBy("building").agg(level(F.col("value") < 50).alias("small"), level(F.col("value") >= 50).alias("large"))
    models_ = wide.unpivot(["building"], ["small", "large"], "device", "level").select("building", "device", F.array(F.lit(0.0), "level").alias("levels"), F.array(F.array(F.lit(0.95), F.lit(0.05)), F.array(F.lit(0.05), F.lit(0.95))).alias("moves"))
    return chains.decode_buildings(ev, models_, ["building"], longest=50).drop("id")


TR = "tq AS (SELECT meter, t, id, value - lag(value) OVER (PARTITION BY meter ORDER BY t, id) AS v FROM ev), ts AS MATERIALIZED (SELECT meter, t, v, row_number() OVER (PARTITION BY meter ORDER BY t, id) AS k FROM tq WHERE abs(v) > 40)"
# Falls from the last to the first; each takes the nearest free rise that the way back reaches.
_FALLS = f"""{TR}, sm AS (SELECT *, sum(v) OVER (PARTITION BY meter ORDER BY k) - v AS s FROM ts),
pr AS (SELECT f.meter, f.k AS j, r.k AS i, f.t AS off_t, f.v AS off, r.t AS on_t, r.v AS up, CASE WHEN abs(r.v - f.v) < 1000 THEN 100 ELSE 0.035 * greatest(abs(r.v), abs(f.v)) END AS near, -(f.s - r.s) AS undone FROM sm f JOIN sm r ON r.meter = f.meter AND r.k < f.k WHERE f.v < 0),
rc AS (SELECT *, coalesce(min(undone - off + near) OVER (PARTITION BY meter, j ORDER BY i DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 0 AS reached FROM pr),
cd AS (SELECT meter, j, list(i ORDER BY i DESC) AS rises FROM rc WHERE reached AND up > 0 AND abs(up + off) < near GROUP BY ALL),
fo AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY meter ORDER BY j DESC) AS n FROM cd),
tk(meter, n, j, i, used) AS (SELECT meter, n, j, rises[1], [rises[1]] FROM fo WHERE n = 1
UNION ALL SELECT z.meter, z.n, z.j, z.pick, CASE WHEN z.pick IS NULL THEN z.used ELSE list_append(z.used, z.pick) END FROM (SELECT fo.meter, fo.n, fo.j, list_filter(fo.rises, lambda x: NOT list_contains(tk.used, x))[1] AS pick, tk.used FROM tk JOIN fo ON fo.meter = tk.meter AND fo.n = tk.n + 1) z),
fp AS (SELECT tk.meter, a.t AS on_t, a.v AS up, b.t AS off_t, b.v AS down FROM tk JOIN ts a ON a.meter = tk.meter AND a.k = tk.i JOIN ts b ON b.meter = tk.meter AND b.k = tk.j)"""


@query(f"""WITH RECURSIVE {EV}, {_FALLS} SELECT meter, on_t, round(up, 6) AS "on", off_t, round(down, 6) AS off FROM fp""")
def pairs_from_falls(s, d):
    return r6(disaggregate.pair_from_falls(registry.transitions(s, d)), "on", "off")


def _normals() -> str:
    each = lambda name, x: f"round(avg({x}), 6) AS {name}_mean, round(stddev_pop({x}), 6) AS {name}_deviation"
    return ", ".join([each("on", "up"), each("off", "down"), each("span", "(off_t - on_t) / 1e6")])


@query(f"WITH RECURSIVE {EV}, {_FALLS} SELECT meter, {_normals()} FROM fp GROUP BY meter")
def switch_parameters(s, d):
    """What the likelihood pairing is trained to, from pairs that are found from the falls."""
    found = eventbased.switch_parameters(disaggregate.pair_from_falls(registry.transitions(s, d)), F.col("on_t"), F.col("off_t"))
    return r6(found, *(c for c in found.columns if c != "meter"))


# The ring buffer as a list: matched entries leave a full one, else the oldest; a fall takes the nearest rise of like size.
_CLOSE = "x.v > 0 AND NOT x.m AND abs(x.v + z.v) < CASE WHEN greatest(abs(x.v), abs(z.v)) < 1000 THEN 100 ELSE 0.035 * greatest(abs(x.v), abs(z.v)) END"
_NEW = "{'k': z.k, 'v': z.v, 'm': pick IS NOT NULL}"


@query(f"""WITH RECURSIVE {EV}, {registry.runs_sql()}, o AS (SELECT *, row_number() OVER (PARTITION BY meter ORDER BY run) AS k FROM rn),
e(meter, k, t, first, level, transition, before) AS (SELECT meter, k, t, first, value, CASE WHEN abs(value) > 70 THEN value ELSE 0 END, CASE WHEN abs(value) > 70 THEN value ELSE 0 END FROM o WHERE k = 1
UNION ALL SELECT o.meter, o.k, o.t, o.first, o.value, CASE WHEN abs(o.value - e.before) > 70 THEN o.value - e.before ELSE 0 END, CASE WHEN abs(o.value - e.before) > 70 THEN o.value ELSE e.before END FROM o JOIN e ON o.meter = e.meter AND o.k = e.k + 1),
f AS (SELECT *, row_number() OVER (PARTITION BY meter ORDER BY k) AS n FROM e WHERE transition <> 0),
ts AS MATERIALIZED (SELECT meter, t, transition AS v, row_number() OVER (PARTITION BY meter ORDER BY t) AS k FROM f WHERE NOT (n = 1 AND t = first AND level > 70)),
q(meter, k, buf, i) AS (SELECT meter, k, [{{'k': k, 'v': v, 'm': false}}], CAST(NULL AS BIGINT) FROM ts WHERE k = 1
UNION ALL SELECT meter, k, list_append(list_transform(buf, lambda x: {{'k': x.k, 'v': x.v, 'm': x.m OR x.k = coalesce(pick, -1)}}), {{'k': k, 'v': v, 'm': pick IS NOT NULL}}), pick FROM
(SELECT z.*, CASE WHEN z.v < 0 THEN list_max(list_transform(list_filter(z.buf, lambda x: {_CLOSE}), lambda x: x.k)) END AS pick FROM
(SELECT ts.meter, ts.k, ts.v, CASE WHEN len(q.buf) < 20 THEN q.buf WHEN len(list_filter(q.buf, lambda x: NOT x.m)) < 20 THEN list_filter(q.buf, lambda x: NOT x.m) ELSE q.buf[2:] END AS buf FROM q JOIN ts ON ts.meter = q.meter AND ts.k = q.k + 1) z) y)
SELECT q.meter, a.t AS on_t, round(a.v, 6) AS "on", b.t AS off_t, round(b.v, 6) AS off FROM q JOIN ts a ON a.meter = q.meter AND a.k = q.i JOIN ts b ON b.meter = q.meter AND b.k = q.k""")
def hart_pairs(s, d):
    return r6(disaggregate.pair_transitions(disaggregate.steady_states(store.events(s, d), emit_only=True)), "on", "off")


def _density(x: str, mean: float, deviation: float) -> str:
    return f"(exp(-((({x}) - {mean}) * (({x}) - {mean})) / {2.0 * deviation * deviation!r}::DOUBLE) / {deviation * math.sqrt(2 * math.pi)!r}::DOUBLE)"


@query(f"""WITH RECURSIVE {EV}, {TR}, lp AS (SELECT a.meter, a.t AS on_t, b.t AS off_t, {_density('a.v', 80, 40)} * {_density('b.v', -80, 40)} * {_density('(b.t - a.t) / 1e6', 20000, 20000)} AS p
FROM ts a JOIN ts b ON b.meter = a.meter AND a.v > 0 AND b.v < 0 AND b.t > a.t AND b.t < a.t + {DAY} AND abs(a.v + b.v) < 60),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY meter ORDER BY p DESC, on_t, off_t) AS k FROM lp),
g(meter, k, taken, ok) AS (SELECT meter, k, [{{'a': on_t, 'b': off_t}}], true FROM o WHERE k = 1
UNION ALL SELECT z.meter, z.k, CASE WHEN z.ok THEN list_append(z.taken, {{'a': z.on_t, 'b': z.off_t}}) ELSE z.taken END, z.ok FROM (SELECT o.meter, o.k, o.on_t, o.off_t, g.taken, len(list_filter(g.taken, lambda x: x.a < o.off_t AND x.b > o.on_t)) = 0 AS ok FROM g JOIN o ON o.meter = g.meter AND o.k = g.k + 1) z)
SELECT o.meter, o.on_t, o.off_t, round(1e9 * o.p, 6) AS likelihood FROM g JOIN o ON o.meter = g.meter AND o.k = g.k WHERE g.ok""")
def accepted_pairs(s, d):
    """Pairs by descending likelihood while their span is free."""
    found = disaggregate.likelihood_pairs(registry.transitions(s, d).withColumnRenamed("transition", "delta"), DAY, 60, (80, 40), (-80, 40), (20000, 20000))
    return disaggregate.accept_pairs(found).withColumn("likelihood", F.round(F.col("likelihood") * 1e9, 6))


@query(f"""WITH {EV}, h AS (SELECT DISTINCT meter, kind, t // 3600000000 AS h FROM ev) SELECT kind, count(*) AS n FROM h GROUP BY kind""")
def distinct_hours(s, d):
    """How many different hours each kind of event has over all meters."""
    ev = store.events(s, d).select("meter", "kind", resample.bin_start(3600).alias("h")).distinct()
    return ev.groupBy("kind").agg(F.count("*").alias("n"))


@query(f"""WITH {EV}, sw AS (SELECT meter % 3 AS phase, t // 3600000000 * 3600000000 AS t, value - lag(value) OVER (PARTITION BY meter ORDER BY t, id) AS tr FROM ev),
o AS (SELECT phase, t, sum(tr) AS tr FROM sw WHERE abs(tr) > 60 GROUP BY ALL)
SELECT t, round(sum(tr), 6) AS total, round(max(tr) FILTER (phase = 0), 6) AS first FROM o GROUP BY t HAVING count(*) = 3 AND (min(tr) > 0 OR max(tr) < 0)""")
def all_phase_events(s, d):
    sw = store.events(s, d).withColumn("transition", F.col("value") - F.lag("value").over(registry.resample_order())).where("abs(transition) > 60")
    rows = sw.select(F.lit(1).alias("building"), (F.col("meter") % 3).alias("phase"), F.expr("t div 3600000000 * 3600000000").alias("t"), "transition")
    return r6(eventbased.all_phase_events(rows).select("t", "total", F.col("transitions")[0].alias("first")), "total", "first")


@query("SELECT CAST(k AS INTEGER) AS meter, CASE k WHEN 2 THEN 'lamp' ELSE 'oven' END AS appliance, 1514764800000000 + i * 3600000000 AS t, CASE k WHEN 2 THEN (i % 3) * 40.0::DOUBLE ELSE (i // 5) * 1.5::DOUBLE END AS value FROM range(50) r(i), range(2, 4) m(k)")
def predefined_machines(s, d):
    table = s.range(50).select(F.col("id").alias("step"), (F.col("id") % 3 * 40).alias("lamp"), (F.expr("id div 5") * 1.5).alias("oven"))
    return simulate.predefined(table, 1514764800000000)


@query(f"""WITH RECURSIVE {EV}, h AS (SELECT meter, list(round(value) ORDER BY value) AS v, count(*) AS n FROM ev WHERE value > 10 GROUP BY meter),
p AS (SELECT *, 0.25::DOUBLE * (n - 1) AS x, 0.75::DOUBLE * (n - 1) AS y FROM h WHERE n >= 20),
k(meter, v, a, b, i, done) AS (SELECT meter, v, v[floor(x)::INT + 1] + (v[ceil(x)::INT + 1] - v[floor(x)::INT + 1]) * (x - floor(x)), v[floor(y)::INT + 1] + (v[ceil(y)::INT + 1] - v[floor(y)::INT + 1]) * (y - floor(y)), 0, false FROM p
UNION ALL SELECT meter, v, CASE WHEN near THEN a ELSE c END, CASE WHEN near THEN b ELSE e END, i + 1, near FROM (SELECT *, abs(c - a) <= 1e-8 + 1e-5 * abs(a) AND abs(e - b) <= 1e-8 + 1e-5 * abs(b) AS near FROM
(SELECT meter, v, a, b, i, coalesce(list_avg(list_filter(v, lambda x: abs(x - a) <= abs(x - b))), a) AS c, coalesce(list_avg(list_filter(v, lambda x: abs(x - a) > abs(x - b))), b) AS e FROM k WHERE NOT done AND i < 50) q) w),
l AS (SELECT meter, arg_max(a, i) AS a, arg_max(b, i) AS b FROM k GROUP BY meter)
SELECT h.meter, array_to_string(CASE WHEN h.n < 20 THEN [0] ELSE list_sort(list_distinct([0, round_even(a, 0)::INT, round_even(b, 0)::INT])) END, ',') AS states FROM h LEFT JOIN l USING (meter)""")
def kmeans_states(s, d):
    """Two centres a meter, by Lloyd's rounds from the quartiles."""
    return disaggregate.cluster_states(store.events(s, d)).withColumn("states", F.array_join(F.col("states").cast("array<string>"), ","))


# Segments by row number stand for those of the plateaus: what is made of them has SQL.
_CUT = f"{TR}, sg AS (SELECT *, (k - 1) // {{n}} AS segment, CAST((k - 1) % {{n}} AS INTEGER) AS place, count(*) OVER (PARTITION BY meter, (k - 1) // {{n}}) AS size FROM ts)"
_AT = ", ".join(f"max(v) FILTER (place = {k}) AS {x}, max(t) FILTER (place = {k}) AS t{k}" for k, x in enumerate("abcd"))
_WIDE = f"{_CUT.format(n=4)}, wd AS (SELECT meter, segment, {_AT} FROM sg WHERE size = 4 GROUP BY ALL)"


def cut_segments(s, d, n: int) -> DataFrame:
    sw = store.events(s, d).withColumn("transition", F.col("value") - F.lag("value").over(registry.resample_order())).where("abs(transition) > 40")
    k = F.row_number().over(registry.resample_order()) - 1
    rows = sw.select("meter", "t", "transition", k.alias("k")).select("meter", "t", "transition", F.expr(f"k div {n}").alias("segment"), (F.col("k") % n).cast("int").alias("place"))
    return rows.join(rows.groupBy("meter", "segment").agg(F.count("*").alias("size")), ["meter", "segment"])


@query(f"WITH {EV}, {_CUT.format(n=2)} SELECT meter, segment, round(sum(abs(v)) / 2, 6) AS transition_avg, round(sum(v), 6) AS transition_delta, round(max(v) FILTER (place = 0), 6) AS spike_up, round(max(v) FILTER (place = 1), 6) AS spike_down, round((max(t) FILTER (place = 1) - max(t) FILTER (place = 0)) / 1e6, 6) AS duration FROM sg WHERE size = 2 GROUP BY meter, segment")
def pair_features(s, d):
    return r6(eventbased.segment_features(cut_segments(s, d, 2), 2), "transition_avg", "transition_delta", "spike_up", "spike_down", "duration")


@query(f"WITH {EV}, {_WIDE} SELECT meter, segment, {', '.join(f'round({x}, 6) AS {n}, round({x}, 6) AS {n}_spike' for x, n in zip('abcd', eventbased.ORDINALS, strict=True))}, {', '.join(f'round((t{k + 1} - t{k}) / 1e6, 6) AS {n}_duration' for k, n in enumerate(eventbased.ORDINALS[:3]))} FROM wd")
def four_features(s, d):
    found = eventbased.segment_features(cut_segments(s, d, 4), 4)
    return r6(found, *(c for c in found.columns if c not in ("meter", "segment")))


@query(f"""WITH {EV}, {_WIDE}, p AS (SELECT meter, segment, CASE WHEN a > 0 AND b > 0 AND c < 0 AND d < 0 THEN CASE WHEN abs(a + c) + abs(b + d) <= abs(a + d) + abs(b + c) THEN '0101' ELSE '0110' END WHEN a + b < 15 THEN '0011' END AS p FROM wd)
SELECT sg.meter, sg.segment, sg.place, CAST(p.p[sg.place + 1] AS INTEGER) AS grp FROM sg JOIN p ON p.meter = sg.meter AND p.segment = sg.segment WHERE p.p IS NOT NULL""")
def four_splits(s, d):
    return eventbased.split_fours(cut_segments(s, d, 4)).select("meter", "segment", "place", "grp")


_STEPS = f"""st AS (SELECT meter, t, id, value, value - coalesce(lag(value) OVER w, 0) AS d, abs(value - coalesce(lag(value) OVER w, 0)) > 15 AS j FROM ev WHERE value IS NOT NULL WINDOW w AS (PARTITION BY meter ORDER BY t, id)),
rn AS (SELECT *, j AND NOT coalesce(lag(j) OVER w, false) AS b, lag(j) OVER w AS was, lag(value) OVER w AS pv, lag(d) OVER w AS pd FROM st WINDOW w AS (PARTITION BY meter ORDER BY t, id)),
ru AS (SELECT *, sum(CAST(b AS INTEGER)) OVER (PARTITION BY meter ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS run FROM rn),
sn AS (SELECT meter, run, min(t) AS t, max(pd) FILTER (b) AS pd, max(pv - pd) FILTER (b) AS base, list(d ORDER BY t, id) AS s, max(value) AS hi, min(value) AS lo FROM ru WHERE run > 0 AND (j OR was) GROUP BY ALL)"""


@query(f"""WITH {EV}, {_STEPS} SELECT meter, t, CAST(len(s) + CAST(pd IS NOT NULL AS INTEGER) AS BIGINT) AS steps, round(hi - coalesce(base, 0), 6) AS high, round(lo - coalesce(base, 0), 6) AS low,
round(coalesce(pd, s[1]), 6) AS first_step, round(s[-1], 6) AS last_step, round(coalesce(pd, 0) + list_sum(s), 6) + 0.0 AS whole FROM (SELECT meter, t, pd, base, s, greatest(hi, pd + coalesce(base, 0)) AS hi, least(lo, pd + coalesce(base, 0)) AS lo FROM sn)""")
def delta_signatures(s, d):
    """The steps of every change of the readings, as their number, extremes, ends and sum."""
    ev = store.events(s, d).where("value is not null")
    starts = disaggregate.runs(ev, 15).select("meter", "run", "t")
    found = disaggregate.signatures(ev, 15, 10_000).join(starts, ["meter", "run"])
    whole = F.aggregate("signature", F.lit(0.0), lambda a, b: a + b)
    out = found.select("meter", "t", "steps", "high", "low", F.col("signature")[0].alias("first_step"), F.element_at("signature", -1).alias("last_step"), whole.alias("whole"))
    return r6(out, "high", "low", "first_step", "last_step", "whole").withColumn("whole", F.col("whole") + 0.0)


@query(f"""WITH {EV}, {TR}, x AS (SELECT meter, k, v, [v * 1.25, -v * 0.5, v * 0.25] AS g FROM ts) SELECT meter, k, round(CASE WHEN v > 0 THEN greatest(g[1], g[1] + g[2], g[1] + g[2] + g[3]) - v ELSE least(g[1], g[1] + g[2], g[1] + g[2] + g[3]) - v END, 6) AS peak FROM x""")
def signature_peaks(s, d):
    sw = store.events(s, d).withColumn("v", F.col("value") - F.lag("value").over(registry.resample_order())).where("abs(v) > 40")
    v = F.col("v")
    rows = sw.withColumn("k", F.row_number().over(registry.resample_order()).cast("long"))
    return r6(rows.select("meter", "k", eventbased.signature_peak(F.array(v * 1.25, -v * 0.5, v * 0.25), v).alias("peak")), "peak")
