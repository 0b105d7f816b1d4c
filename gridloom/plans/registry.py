"""Registered queries over the supplied tables and, for each, the same query in SQL.

Events play the readings (a user is a meter), regions, nations, customers and suppliers the metadata.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import activations, cluster, disaggregate, energy, eventbased, forecast, information, intervals, metrics, models, resample, sections, simulate, wiring
from gridloom.sources import store

H = 3600
GAP = 6 * H
DAY = 86400 * sections.US
START, END = 1704240000000000, 1705536000000000  # 2024-01-03 and 2024-01-18
STATES = {"fridge": [0.0, 90.0], "heater": [0.0, 60.0, 200.0], "lamp": [0.0, 35.0]}
EDGES = [0, 21600, 43200, 86400, 172800, 604800]

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def _all() -> None:
    """The other query modules add theirs when they are imported."""
    import_module("gridloom.plans.metadata_queries")
    import_module("gridloom.plans.training_queries")
    import_module("gridloom.plans.converter_queries")
    import_module("gridloom.plans.sql_queries")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _all()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(_sql)


def r6(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def good(s: SparkSession, d: str, parity: int | None = None, gap: float = GAP) -> DataFrame:
    ev = store.events(s, d)
    return sections.good_sections(ev if parity is None else ev.where(F.col("id") % 2 == parity), gap)


# The pieces that the SQL texts share.
EV = "ev AS (SELECT user_id AS meter, epoch_us(ts) AS t, value, event_id AS id, event_type AS kind FROM events)"


def good_sql(name: str, where: str = "true", gap: int = GAP) -> str:
    return f"""{name}_g AS (SELECT meter, t, id, CASE WHEN t - lag(t) OVER w <= {gap * 1000000} THEN 0 ELSE 1 END AS new FROM ev WHERE {where} WINDOW w AS (PARTITION BY meter ORDER BY t, id)),
{name}_r AS (SELECT meter, t, sum(new) OVER (PARTITION BY meter ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS run FROM {name}_g),
{name} AS (SELECT meter, min(t) AS s, max(t) AS e FROM {name}_r GROUP BY meter, run HAVING max(t) > min(t))"""


def on_sql(name: str, on: str, where: str = "true") -> str:
    return f"""{name}_a AS (SELECT meter, t, id, {on} AS o, lead(t) OVER w AS nx, lag({on}) OVER w AS pv FROM ev WHERE {where} WINDOW w AS (PARTITION BY meter ORDER BY t, id)),
{name}_b AS (SELECT *, sum(CASE WHEN o = pv THEN 0 ELSE 1 END) OVER (PARTITION BY meter ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS run FROM {name}_a),
{name} AS (SELECT meter, min(t) AS s, max(coalesce(nx, t)) AS e FROM {name}_b WHERE o GROUP BY meter, run HAVING max(coalesce(nx, t)) > min(t))"""


def sweep_sql(name: str, sides: dict[str, int]) -> str:
    events = " UNION ALL ".join(f"SELECT meter, s AS t, {w} AS w FROM {n} UNION ALL SELECT meter, e, {-w} FROM {n}" for n, w in sides.items())
    return f"""{name}_e AS (SELECT meter, t, sum(w) AS w FROM ({events}) GROUP BY meter, t),
{name} AS (SELECT * FROM (SELECT meter, t AS s, lead(t) OVER (PARTITION BY meter ORDER BY t) AS e, CAST(sum(w) OVER (PARTITION BY meter ORDER BY t ROWS UNBOUNDED PRECEDING) AS BIGINT) AS level FROM {name}_e) WHERE e IS NOT NULL)"""


def merge_sql(name: str, source: str, gap: float = 0) -> str:
    return f"""{name}_m AS (SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY meter ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= {round(gap * 1000000)} THEN 0 ELSE 1 END AS new FROM {source}),
{name}_n AS (SELECT *, sum(new) OVER (PARTITION BY meter ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM {name}_m),
{name} AS (SELECT meter, min(s) AS s, max(e) AS e FROM {name}_n GROUP BY meter, run)"""


def out(name: str, extra: str = "") -> str:
    return f'SELECT meter, s AS "start", e AS "end"{extra} FROM {name}'


BOTH = f"WITH {EV}, {good_sql('a', 'id % 2 = 0')}, {good_sql('b', 'id % 2 = 1')}"
KWH = "kw AS (SELECT *, least((lead(t) OVER (PARTITION BY meter ORDER BY t, id) - t) / 1e6, 7200.0) * value / 3600000 AS kwh FROM ev), en AS (SELECT meter, coalesce(sum(kwh), 0.0) AS kwh FROM kw GROUP BY meter)"
GRID = f"ends AS (SELECT meter, min(t - t % 3600000000) AS a, max(t - t % 3600000000) AS b FROM ev GROUP BY meter), grid AS (SELECT meter, unnest(generate_series(a, b, 3600000000)) AS t FROM ends)"
MEAN = "mn AS (SELECT meter, t - t % 3600000000 AS t, avg(value) AS value FROM ev GROUP BY ALL)"


@query(f"WITH {EV}, {good_sql('g')} {out('g')}")
def good_sections(s, d):
    return good(s, d)


@query(f"WITH {EV}, {good_sql('g')} SELECT meter, count(*) AS sections, CAST(sum(e - s) AS BIGINT) AS uptime_us FROM g GROUP BY meter")
def uptime_per_meter(s, d):
    return sections.uptime(good(s, d))


@query(f"WITH {EV}, {good_sql('g', gap=2 * H)} {out('g')}")
def frequency_sections(s, d):
    return sections.frequency_sections(store.events(s, d), 1 / (2 * H))


@query(f"WITH {EV}, {on_sql('n0', 'value > 0')}, {merge_sql('n', 'n0', 2.3)}, {good_sql('g')}, {sweep_sql('x', {'n': 1, 'g': 1})} {out('x')} WHERE level = 2")
def nonzero_sections(s, d):
    ev = store.events(s, d)
    return intervals.intersect(sections.nonzero_sections(ev), sections.good_sections(ev, GAP))


@query(f"WITH {EV}, {on_sql('n', 'value > 15')} {out('n')}")
def overbase_sections(s, d):
    return sections.on_sections(store.events(s, d), F.col("value") > 15)


@query(f"WITH {EV}, {good_sql('g')}, {merge_sql('m', 'g', 12 * H)} {out('m')}")
def merge_gaps(s, d):
    return sections.merge_gaps(good(s, d), 12 * H)


@query(f"WITH {EV}, {good_sql('g')} {out('g')} WHERE e - s > {4 * H * 1000000}")
def drop_short(s, d):
    return sections.drop_short(good(s, d), 4 * H)


@query(f"""WITH {EV}, {good_sql('g')}, gp AS (SELECT (s - lag(e) OVER (PARTITION BY meter ORDER BY s, e)) / 1e6 AS gap FROM g),
bn AS (SELECT CASE {' '.join(f'WHEN gap > {a} AND gap <= {b} THEN {i}' for i, (a, b) in enumerate(zip(EDGES, EDGES[1:])))} END AS bin FROM gp) SELECT CAST(bin AS INTEGER) AS bin, count(*) AS gaps FROM bn WHERE bin IS NOT NULL GROUP BY bin""")
def gap_histogram(s, d):
    return sections.gap_histogram(good(s, d), EDGES)


@query(f"{BOTH}, {sweep_sql('x', {'a': 1, 'b': 1})}, p AS (SELECT * FROM x WHERE level > 0), {merge_sql('m', 'p')} {out('m')}")
def interval_union(s, d):
    return intervals.union(good(s, d, 0), good(s, d, 1))


@query(f"{BOTH}, {sweep_sql('x', {'a': 1, 'b': 1})} {out('x')} WHERE level = 2")
def interval_intersect(s, d):
    return intervals.intersect(good(s, d, 0), good(s, d, 1))


@query(f"{BOTH}, {sweep_sql('x', {'a': 1, 'b': 2})} {out('x')} WHERE level = 1")
def interval_diff(s, d):
    return intervals.difference(good(s, d, 0), good(s, d, 1))


@query(f"{BOTH}, {sweep_sql('x', {'a': 1, 'b': 1})}, p AS (SELECT * FROM x WHERE level IN (0, 2)), {merge_sql('m', 'p')} {out('m')}")
def interval_match(s, d):
    return intervals.matching(good(s, d, 0), good(s, d, 1))


_CONF = f"{BOTH}, {good_sql('c', gap=12 * H)}, {sweep_sql('x', {'a': 1, 'b': 2, 'c': 4})}, cf AS (SELECT meter, {', '.join(f'CAST(coalesce(sum(e - s) FILTER (level = {k}), 0) AS BIGINT) AS {n}' for n, k in (('tp', 7), ('tn', 4), ('fp', 5), ('fn', 6)))} FROM x WHERE level >= 4 GROUP BY meter)"


@query(f"{_CONF} SELECT * FROM cf")
def confusion_durations(s, d):
    return intervals.confusion(good(s, d, 0), good(s, d, 1), good(s, d, gap=12 * H))


@query(f"WITH {EV}, {good_sql('g')}, tr AS (SELECT meter, greatest(s, {START}) AS s, least(e, {END}) AS e FROM g) {out('tr')} WHERE s < e")
def truncate_sections(s, d):
    return intervals.truncate(good(s, d), START, END)


@query(f"""WITH {EV}, {good_sql('g')}, tr AS (SELECT * FROM (SELECT meter, greatest(s, {START}) AS s, least(e, {END}) AS e FROM g) WHERE s < e), {merge_sql('u', 'tr')}, fr AS (SELECT DISTINCT meter, {START}::BIGINT AS s, {END}::BIGINT AS e FROM tr),
{sweep_sql('x', {'fr': 1, 'u': 2})} {out('x')} WHERE level = 1""")
def interval_invert(s, d):
    return intervals.invert(good(s, d), START, END)


@query(f"WITH {EV}, {good_sql('g')}, sp AS (SELECT meter, e AS z, unnest(range(s, e, {4 * H * 1000000})) AS s FROM g) SELECT meter, s AS \"start\", least(s + {4 * H * 1000000}, z) AS \"end\" FROM sp")
def split_sections(s, d):
    return intervals.split(good(s, d), 4 * H)


@query(f"WITH {EV}, {good_sql('g')}, u AS (SELECT t, sum(w) AS w FROM (SELECT s AS t, 1 AS w FROM g UNION ALL SELECT e, -1 FROM g) GROUP BY t) SELECT t, CAST(sum(w) OVER (ORDER BY t) AS BIGINT) AS up FROM u")
def active_upcounts(s, d):
    return intervals.upcounts(good(s, d))


@query(f"WITH {EV}, {good_sql('g')} SELECT meter, min(s) AS \"start\", max(e) AS \"end\" FROM g GROUP BY meter")
def section_hull(s, d):
    return intervals.hull(good(s, d))


@query(f"""WITH {EV}, {good_sql('g')}, n AS (SELECT *, (e - s) // 600000000 AS n FROM g), c AS (SELECT *, CAST(sum(n) OVER (PARTITION BY meter ORDER BY s ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto, CAST(sum(n) OVER (PARTITION BY meter) AS BIGINT) * 0.5 AS target, count(*) OVER (PARTITION BY meter) AS k FROM n),
f AS (SELECT *, row_number() OVER (PARTITION BY meter ORDER BY s) AS r FROM c WHERE upto > target OR k = 1) SELECT meter, CAST(s + floor((target - (upto - n)) * 600) * 1000000 AS BIGINT) AS split FROM f WHERE r = 1""")
def train_test_split(s, d):
    return intervals.train_test_split(good(s, d), 600)


@query(f"WITH {EV}, {KWH} SELECT meter, round(kwh, 6) AS kwh FROM en")
def total_energy(s, d):
    return r6(energy.total_energy(store.events(s, d), 7200), "kwh")


_QUANTITY = "CASE WHEN user_id % 3 = 0 AND event_type IN ('click', 'view') THEN 'cumulative energy' WHEN user_id % 3 = 1 AND event_type = 'click' THEN 'energy' ELSE 'power' END"


@query(f"""WITH e AS (SELECT user_id AS meter, epoch_us(ts) AS t, value, event_id AS id, {_QUANTITY} AS q FROM events), k AS (SELECT *, least((lead(t) OVER (PARTITION BY meter, q ORDER BY t, id) - t) / 1e6, 7200.0) * value / 3600000 AS p FROM e),
f AS (SELECT meter, q, CASE q WHEN 'cumulative energy' THEN arg_max(value, (t, id)) - arg_min(value, (t, id)) WHEN 'energy' THEN sum(value) ELSE coalesce(sum(p), 0) END AS kwh, CASE q WHEN 'cumulative energy' THEN 0 WHEN 'energy' THEN 1 ELSE 2 END AS r FROM k GROUP BY meter, q)
SELECT meter, arg_min(q, r) AS quantity, round(arg_min(kwh, r), 6) AS kwh FROM f GROUP BY meter""")
def energy_by_preference(s, d):
    third = F.col("meter") % 3
    q = F.when((third == 0) & F.col("kind").isin("click", "view"), "cumulative energy").when((third == 1) & (F.col("kind") == "click"), "energy").otherwise("power")
    return r6(energy.energy_by_preference(store.events(s, d), q, 7200), "kwh")


@query(f"WITH {EV} SELECT meter, CASE WHEN count(*) >= 5 THEN round(greatest(0.0, 1 - count(*) / (round_even((max(t) - min(t)) / 1e6 / 3600, 0) + 1)), 6) END AS rate, count(*) AS n FROM ev GROUP BY meter")
def dropout_rate(s, d):
    return r6(energy.dropout_rate(store.events(s, d), H), "rate")


@query(f"WITH {EV} SELECT meter, min(value) AS vampire FROM ev GROUP BY meter")
def vampire_power(s, d):
    return energy.vampire_power(store.events(s, d))


@query(f"WITH {EV} SELECT CAST(least(floor((value - 10) / 24.5), 19) AS INTEGER) AS bin, count(*) AS n FROM ev WHERE value BETWEEN 10 AND 500 GROUP BY 1")
def power_histogram(s, d):
    return energy.histogram(store.events(s, d), 10, 500, 20)


@query(f"WITH {EV}, h AS (SELECT DISTINCT meter, t // 3600000000 AS h FROM ev WHERE value >= 10) SELECT meter, CAST(h % 24 AS INTEGER) AS hour, count(*) AS on_days FROM h GROUP BY ALL")
def activity_histogram(s, d):
    return energy.activity_histogram(store.events(s, d), 10)


@query(f"WITH {EV}, {KWH} SELECT meter, CASE WHEN max(t) > min(t) THEN round(sum(kwh) / ((max(t) - min(t)) / 1e6 / 86400), 6) END AS kwh_per_period FROM kw GROUP BY meter")
def energy_per_period(s, d):
    return r6(energy.energy_per_period(store.events(s, d), 7200), "kwh_per_period")


@query(f"WITH {EV}, {KWH} SELECT meter, round(kwh / (SELECT sum(kwh) FROM en), 6) AS fraction FROM en")
def fraction_per_meter(s, d):
    return r6(energy.fraction_per_meter(energy.total_energy(store.events(s, d), 7200)), "fraction")


@query(f"WITH {EV}, {KWH} SELECT meter, round(kwh, 6) AS kwh FROM en ORDER BY kwh DESC, meter LIMIT 5")
def top_k_meters(s, d):
    return r6(energy.top_k(energy.total_energy(store.events(s, d), 7200), 5), "kwh")


@query(f"""{BOTH}, ka AS (SELECT x.meter, x.id % 2 AS p, x.t, x.id, x.value FROM ev x JOIN b g ON x.meter = g.meter AND x.t >= g.s AND x.t < g.e), kb AS (SELECT *, least((lead(t) OVER (PARTITION BY meter, p ORDER BY t, id) - t) / 1e6, 7200.0) * value / 3600000 AS k FROM ka),
ke AS (SELECT meter, p, coalesce(sum(k), 0) AS k FROM kb GROUP BY ALL) SELECT o.meter, CASE WHEN o.k <> 0 THEN round(coalesce(w.k, 0.0) / o.k, 6) END AS proportion FROM ke o LEFT JOIN ke w ON o.meter = w.meter AND w.p = 0 WHERE o.p = 1""")
def proportion_of_energy(s, d):
    ev = store.events(s, d)
    return r6(energy.proportion_of_energy(ev.where("id % 2 = 0"), ev.where("id % 2 = 1"), good(s, d, 1), 7200), "proportion")


@query(f"WITH {EV}, g AS (SELECT kind, t - t % 3600000000 AS g, avg(value) AS value FROM ev GROUP BY ALL) SELECT a.kind AS a, b.kind AS b, round(corr(a.value, b.value), 6) AS r, count(*) AS n FROM g a JOIN g b ON a.g = b.g AND a.kind <= b.kind GROUP BY ALL")
def correlation_pairs(s, d):
    rows = store.events(s, d).groupBy("kind", resample.bin_start(H).alias("g")).agg(F.avg("value").alias("value"))
    return r6(energy.correlation_pairs(rows), "r")


@query(f"WITH {EV} SELECT meter, count(*) AS n, min(t) AS \"start\", max(t) AS \"end\", round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, max(value) AS peak FROM ev GROUP BY meter")
def describe_group(s, d):
    return r6(energy.describe(store.events(s, d)), "mean", "std")


@query(f"WITH {EV}, l AS (SELECT meter, value, lag(value, 1) OVER w AS l1, lag(value, 24) OVER w AS l24 FROM ev WINDOW w AS (PARTITION BY meter ORDER BY t, id)) SELECT meter, round(corr(value, l1), 6) AS r1, round(corr(value, l24), 6) AS r24 FROM l GROUP BY meter")
def autocorrelation(s, d):
    return r6(energy.autocorrelation(store.events(s, d), [1, 24]), "r1", "r24")


@query(f"WITH {EV} SELECT id, CASE WHEN kind = 'click' THEN greatest(20.0, least(100.0, value)) ELSE value END AS value FROM ev")
def clip_limits(s, d):
    lim = lambda x: F.when(F.col("kind") == "click", F.lit(x))
    return energy.clip(store.events(s, d), lim(20.0), lim(100.0)).select("id", "value")


@query(f"WITH {EV}, {GRID} SELECT g.meter, g.t, CASE WHEN g.t - e.t <= {6 * H * 1000000} THEN e.value END AS value FROM grid g ASOF LEFT JOIN (SELECT meter, t, value FROM ev) e ON g.meter = e.meter AND g.t >= e.t")
def resample_asof(s, d):
    return resample.asof(store.events(s, d), H, 6 * H)


@query(f"WITH {EV}, {MEAN} SELECT meter, t, round(value, 6) AS value FROM mn")
def resample_mean(s, d):
    return r6(resample.mean(store.events(s, d), H), "value")


@query(f"""WITH {EV}, {GRID}, p AS (SELECT g.meter, g.t, e.t AS pt, e.value AS pv FROM grid g ASOF LEFT JOIN (SELECT meter, t, value FROM ev) e ON g.meter = e.meter AND g.t >= e.t), n AS (SELECT p.*, e.t AS nt, e.value AS nv FROM p ASOF LEFT JOIN (SELECT meter, t, value FROM ev) e ON p.meter = e.meter AND p.t <= e.t)
SELECT meter, t, round(CASE WHEN pt IS NULL THEN nv WHEN nt IS NULL OR pt = t THEN pv ELSE pv + (t - pt) / (nt - pt) * (nv - pv) END, 6) AS value FROM n""")
def resample_linear(s, d):
    return r6(resample.linear(store.events(s, d), H), "value")


@query(f"""WITH {EV}, nx AS (SELECT meter, t, value, lead(t) OVER (PARTITION BY meter ORDER BY t, id) AS n FROM ev), b AS (SELECT *, unnest(generate_series(t - t % 3600000000, n - 1 - (n - 1) % 3600000000, 3600000000)) AS b FROM nx WHERE n > t)
SELECT meter, b AS t, round(sum(value * (least(n, b + 3600000000) - greatest(t, b))) / sum(least(n, b + 3600000000) - greatest(t, b)), 6) AS value FROM b GROUP BY meter, b""")
def time_weighted_mean(s, d):
    return r6(resample.time_weighted(store.events(s, d), H), "value")


@query(f"WITH {EV}, {MEAN} SELECT t, round(sum(value), 6) AS value, count(value) AS meters FROM mn GROUP BY t")
def group_load(s, d):
    return r6(resample.group_load(resample.mean(store.events(s, d), H)), "value")


@query(f"WITH {EV}, {MEAN} SELECT t, {', '.join(f'round(sum(value) FILTER (meter = {m}), 6) AS m{m}' for m in (1, 2, 3))} FROM mn WHERE meter IN (1, 2, 3) GROUP BY t")
def meters_pivot(s, d):
    rows = resample.meters_pivot(resample.mean(store.events(s, d), H), [1, 2, 3])
    return rows.select("t", *(F.round(str(m), 6).alias(f"m{m}") for m in (1, 2, 3)))


def pairs(s, d) -> DataFrame:
    ev = store.events(s, d)
    side = lambda p: resample.mean(ev.where(F.col("id") % 2 == p), 24 * H)
    return resample.align(side(1), side(0)).withColumnsRenamed({"master": "truth", "slave": "pred"})


_PAIRS = f"WITH {EV}, dm AS (SELECT meter, id % 2 AS p, t - t % 86400000000 AS t, avg(value) AS value FROM ev GROUP BY ALL), pr AS (SELECT a.meter, a.t, a.value AS truth, b.value AS pred FROM dm a JOIN dm b ON a.meter = b.meter AND a.t = b.t AND a.p = 1 AND b.p = 0)"


@query(f"{_PAIRS} SELECT meter, t, round(truth, 6) AS truth, round(pred, 6) AS pred FROM pr")
def align_pairs(s, d):
    return r6(pairs(s, d), "truth", "pred")


@query(f"WITH {EV}, l AS (SELECT meter, t, value - lag(value) OVER (PARTITION BY meter ORDER BY t, id) AS delta FROM ev) SELECT meter, t, round(delta, 6) AS delta FROM l WHERE abs(delta) > 40")
def switch_times(s, d):
    return r6(activations.switch_times(store.events(s, d)), "delta")


@query(f"WITH {EV}, l AS (SELECT meter, t, value - lag(value) OVER (PARTITION BY meter ORDER BY t, id) AS delta FROM ev), b AS (SELECT DISTINCT meter, t - t % 600000000 AS t FROM l WHERE abs(delta) > 40) SELECT t, count(*) AS meters FROM b GROUP BY t HAVING count(*) >= 2")
def simultaneous_switches(s, d):
    return activations.simultaneous_switches(store.events(s, d), bin_us=600 * sections.US)


_ACT = f"""WITH {EV}, o AS (SELECT meter, t, id, value >= 30 AS o, lag(value >= 30) OVER (PARTITION BY meter ORDER BY t, id) AS p FROM ev), k AS (SELECT *, lead(t) OVER (PARTITION BY meter ORDER BY t, id) AS e FROM o WHERE o <> p), q AS (SELECT meter, t AS s, e FROM k WHERE o AND e IS NOT NULL),
z AS (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY meter ORDER BY s) < {4 * H * 1000000} THEN 0 ELSE 1 END AS new FROM q), y AS (SELECT *, sum(new) OVER (PARTITION BY meter ORDER BY s ROWS UNBOUNDED PRECEDING) AS run FROM z), act AS (SELECT meter, min(s) AS s, max(e) AS e FROM y GROUP BY meter, run HAVING max(e) - min(s) >= 600000000)"""


def found_activations(s, d) -> DataFrame:
    return activations.activations(store.events(s, d), 30, 4 * H, 600)


@query(f"{_ACT} {out('act')}")
def activations_query(s, d):
    return found_activations(s, d)


@query(f"{_ACT} SELECT meter, s AS t, true AS is_start FROM act UNION ALL SELECT meter, e, false FROM act")
def activity_script(s, d):
    return activations.activity_script(found_activations(s, d))


@query(f"""{_ACT}, rn AS (SELECT *, row_number() OVER (PARTITION BY meter ORDER BY t, id) - 1 AS n FROM ev), sp AS (SELECT act.meter, act.s, a.n AS a, b.n AS b FROM act JOIN rn a ON a.meter = act.meter AND a.t = act.s JOIN rn b ON b.meter = act.meter AND b.t = act.e)
SELECT sp.meter, sp.s AS "start", rn.t, rn.value FROM sp JOIN rn ON rn.meter = sp.meter AND rn.n >= greatest(0, a - 2) AND rn.n < b + 1""")
def activation_rows(s, d):
    return activations.bordered(store.events(s, d), found_activations(s, d))


_EN2 = f"WITH {EV}, kw AS (SELECT *, least((lead(t) OVER (PARTITION BY meter, id % 2 ORDER BY t, id) - t) / 1e6, 7200.0) * value / 3600000 AS kwh FROM ev), e2 AS (SELECT meter, coalesce(sum(kwh) FILTER (id % 2 = 0), 0) AS pred, coalesce(sum(kwh) FILTER (id % 2 = 1), 0) AS truth FROM kw GROUP BY meter HAVING count(*) FILTER (id % 2 = 0) > 0 AND count(*) FILTER (id % 2 = 1) > 0)"


def two_energies(s, d) -> DataFrame:
    ev = store.events(s, d)
    return energy.total_energy(ev.where("id % 2 = 0"), 7200).withColumnRenamed("kwh", "pred").join(energy.total_energy(ev.where("id % 2 = 1"), 7200).withColumnRenamed("kwh", "truth"), "meter")


@query(f"{_EN2} SELECT meter, round(abs(pred - truth), 6) AS error, CASE WHEN truth <> 0 THEN round(pred / truth, 6) END AS assigned, CASE WHEN truth <> 0 THEN round(abs(pred - truth) / truth, 6) END AS deviation FROM e2")
def err_energy(s, d):
    return r6(metrics.energy_errors(two_energies(s, d)), "error", "assigned", "deviation")


@query(f"{_EN2} SELECT round(sum(least(pred / p, truth / q)), 6) AS fraction FROM e2, (SELECT sum(pred) AS p, sum(truth) AS q FROM e2)")
def fraction_assigned(s, d):
    return r6(metrics.fraction_assigned(two_energies(s, d)), "fraction")


@query(f"{_PAIRS} SELECT meter, round(sqrt(avg((pred - truth) ** 2)), 6) AS rmse, round(avg(abs(pred - truth)), 6) AS mae, round(sum(abs(pred - truth)) / sum(truth), 6) AS mne, round(sum((pred - truth) ** 2) / 2, 4) AS disagg_error, round(1 - sum(abs(pred - truth)) / (2 * sum(truth)), 6) AS teca FROM pr GROUP BY meter")
def pointwise_errors(s, d):
    return r6(metrics.pointwise(pairs(s, d)), "rmse", "mae", "mne", "teca").withColumn("disagg_error", F.round("disagg_error", 4))


@query(f"{_PAIRS} SELECT meter, round(avg(abs(pred - truth)), 4) AS mae, round(avg(abs(pred - truth) / abs(pred)), 4) AS mape, round(sqrt(avg((pred - truth) ** 2)), 4) AS rmse FROM pr GROUP BY meter")
def forecast_errors(s, d):
    return metrics.forecast_errors(pairs(s, d)).withColumns({c: F.round(c, 4) for c in ("mae", "mape", "rmse")})


@query(f"""{_CONF}, f AS (SELECT meter, tp / 1e6 AS tp, tn / 1e6 AS tn, fp / 1e6 AS fp, fn / 1e6 AS fn FROM cf) SELECT meter, CASE WHEN tp + fp <> 0 THEN round(tp / (tp + fp), 6) END AS precision, CASE WHEN tp + fn <> 0 THEN round(tp / (tp + fn), 6) END AS recall, CASE WHEN 2 * tp + fp + fn <> 0 THEN round(2 * tp / (2 * tp + fp + fn), 6) END AS f1,
CASE WHEN tp + tn + fp + fn <> 0 THEN round((tp + tn) / (tp + tn + fp + fn), 6) END AS accuracy, CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) <> 0 THEN round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) END AS mcc FROM f""")
def duration_scores(s, d):
    return r6(metrics.durations(confusion_durations(s, d)), "precision", "recall", "f1", "accuracy", "mcc")


_SCORED = f"""WITH {EV}, {on_sql('p', 'value > 50', 'value IS NOT NULL AND id % 2 = 1')}, {on_sql('q', 'value > 50', 'value IS NOT NULL AND id % 2 = 0')}, {good_sql('g', 'value IS NOT NULL AND id % 2 = 0', 12 * H)},
tr AS (SELECT q.meter, greatest(q.s, g.s) AS s, least(q.e, g.e) AS e FROM q JOIN g ON q.meter = g.meter AND q.s < g.e AND g.s < q.e),
a AS (SELECT p.meter AS pred, x.meter AS truth, sum(least(p.e, x.e) - greatest(p.s, x.s)) AS tp FROM p JOIN tr x ON p.meter % 10 = x.meter % 10 AND p.s < x.e AND x.s < p.e GROUP BY ALL),
b AS (SELECT p.meter AS pred, x.meter AS truth, sum(least(p.e, x.e) - greatest(p.s, x.s)) AS said FROM p JOIN g x ON p.meter % 10 = x.meter % 10 AND p.s < x.e AND x.s < p.e GROUP BY ALL),
c AS (SELECT meter AS truth, sum(e - s) AS known FROM g GROUP BY 1), d AS (SELECT meter AS truth, sum(e - s) AS yes FROM tr GROUP BY 1),
f AS (SELECT pred, truth, tp / 1e6 AS tp, (said - tp) / 1e6 AS fp, (yes - tp) / 1e6 AS fn, (known - said - yes + tp) / 1e6 AS tn FROM a JOIN b USING (pred, truth) JOIN c USING (truth) JOIN d USING (truth)),
m AS (SELECT truth % 10 AS place, pred, truth, CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) <> 0 THEN round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) END AS mcc FROM f)"""


def _scores(s: SparkSession, d: str) -> DataFrame:
    """A reading of an odd number is a prediction, of an even one the truth; a place has a tenth of the meters."""
    placed = lambda df: df.withColumn("place", F.col("meter") % 10)
    ev = store.events(s, d)
    odd, even = ev.where("id % 2 = 1"), ev.where("id % 2 = 0")
    on = F.col("value") > 50
    return r6(metrics.pair_scores(placed(sections.on_sections(odd, on)), placed(sections.on_sections(even, on)), placed(sections.good_sections(even, 12 * H))), "mcc")


@query(f"{_SCORED} SELECT * FROM m")
def scores_of_pairs(s, d):
    return _scores(s, d)


@query(f"{_SCORED} SELECT * FROM m WHERE mcc > 0 QUALIFY row_number() OVER (PARTITION BY place, pred ORDER BY mcc DESC, truth) = 1")
def prematched_by_score(s, d):
    return metrics.prematch(_scores(s, d))


def _combos() -> str:
    return ", ".join(f"({t}, {', '.join(map(str, c))})" for t, c in {t: c for t, c in reversed(disaggregate.combinations(STATES))}.items())


@query(f"""WITH {EV}, c(total, {', '.join(STATES)}) AS (VALUES {_combos()}) SELECT id, value, {', '.join(STATES)} FROM (SELECT id, ev.value, c.*, row_number() OVER (PARTITION BY id ORDER BY abs(total - ev.value), total DESC) AS n FROM ev CROSS JOIN c) WHERE n = 1""")
def co_predict(s, d):
    return disaggregate.co_predict(store.events(s, d).select("id", "value"), STATES)


def runs_sql(state: float = 15) -> str:
    """rn(meter, run, t, value, first): a run begins with a change by more than `state` after a calm row; its level is the mean from the change's last row on."""
    return f"""j1 AS (SELECT meter, t, id, value, abs(value - coalesce(lag(value) OVER w, 0)) > {state} AS j FROM ev WHERE value IS NOT NULL WINDOW w AS (PARTITION BY meter ORDER BY t, id)),
j2 AS (SELECT *, CASE WHEN j AND NOT coalesce(lag(j) OVER w, false) THEN 1 ELSE 0 END AS n, j AND coalesce(lead(j) OVER w, false) AS more FROM j1 WINDOW w AS (PARTITION BY meter ORDER BY t, id)),
j3 AS (SELECT *, sum(n) OVER (PARTITION BY meter ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS run FROM j2),
rn AS (SELECT meter, run, min(t) AS t, avg(value) FILTER (NOT more) AS value, coalesce(min(t) FILTER (NOT j), max(t)) AS ends, min(min(t)) OVER (PARTITION BY meter) AS first FROM j3 GROUP BY meter, run)"""


def states_sql(noise: float = 70, state: float = 15) -> str:
    """ss(meter, t, ends, transition, level)"""
    return f"""{runs_sql(state)}, tr AS (SELECT *, value - coalesce(lag(value) OVER (PARTITION BY meter ORDER BY run), 0) AS transition FROM rn),
ss AS (SELECT meter, t, ends, transition, value AS level FROM (SELECT *, row_number() OVER (PARTITION BY meter ORDER BY run) AS k FROM tr WHERE abs(transition) > {noise}) WHERE NOT (k = 1 AND t = first AND value > {noise}))"""


@query(f"WITH {EV}, {states_sql()} SELECT meter, t, round(transition, 6) AS transition, round(level, 6) AS level FROM ss")
def steady_states(s, d):
    return r6(disaggregate.steady_states(store.events(s, d)), "transition", "level")


@query(f"""WITH RECURSIVE {EV}, {runs_sql()}, o AS (SELECT *, row_number() OVER (PARTITION BY meter ORDER BY run) AS k FROM rn),
e(meter, k, t, ends, first, level, transition, before) AS (SELECT meter, k, t, ends, first, value, CASE WHEN abs(value) > 70 THEN value ELSE 0 END, CASE WHEN abs(value) > 70 THEN value ELSE 0 END FROM o WHERE k = 1
UNION ALL SELECT o.meter, o.k, o.t, o.ends, o.first, o.value, CASE WHEN abs(o.value - e.before) > 70 THEN o.value - e.before ELSE 0 END, CASE WHEN abs(o.value - e.before) > 70 THEN o.value ELSE e.before END FROM o JOIN e ON o.meter = e.meter AND o.k = e.k + 1),
f AS (SELECT *, row_number() OVER (PARTITION BY meter ORDER BY k) AS n FROM e WHERE transition <> 0)
SELECT meter, t, ends, round(transition, 6) AS transition, round(level, 6) AS level FROM f WHERE NOT (n = 1 AND t = first AND level > 70)""")
def emitted_states(s, d):
    """The variant whose reference level moves only with what is emitted; with the end of each change."""
    found = disaggregate.steady_states_of(store.events(s, d), emit_only=True)
    return r6(found.withColumnsRenamed({"transition_value": "transition", "level_value": "level"}), "transition", "level")


@query(f"""WITH {EV}, rp AS (SELECT meter, t, id, value, CASE kind WHEN 'view' THEN value * 0.5 ELSE 10.0 END AS q FROM ev WHERE value IS NOT NULL),
j1 AS (SELECT *, abs(value - coalesce(lag(value) OVER w, 0)) > 15 OR abs(q - coalesce(lag(q) OVER w, 0)) > 15 AS j FROM rp WINDOW w AS (PARTITION BY meter ORDER BY t, id)),
j2 AS (SELECT *, CASE WHEN j AND NOT coalesce(lag(j) OVER w, false) THEN 1 ELSE 0 END AS n, j AND coalesce(lead(j) OVER w, false) AS more FROM j1 WINDOW w AS (PARTITION BY meter ORDER BY t, id)),
j3 AS (SELECT *, sum(n) OVER (PARTITION BY meter ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS run FROM j2),
rn AS (SELECT meter, run, min(t) AS t, avg(value) FILTER (NOT more) AS p, avg(q) FILTER (NOT more) AS q, min(min(t)) OVER (PARTITION BY meter) AS first FROM j3 GROUP BY meter, run),
tr AS (SELECT *, p - coalesce(lag(p) OVER w, 0) AS dp, q - coalesce(lag(q) OVER w, 0) AS dq FROM rn WINDOW w AS (PARTITION BY meter ORDER BY run))
SELECT meter, t, round(dp, 6) AS active, round(dq, 6) AS reactive FROM (SELECT *, row_number() OVER (PARTITION BY meter ORDER BY run) AS k FROM tr WHERE abs(dp) > 70 OR abs(dq) > 70) WHERE NOT (k = 1 AND t = first AND (p > 70 OR q > 70))""")
def reactive_states(s, d):
    """Steady states of active and reactive power together; a made-up reactive power."""
    ev = store.events(s, d).withColumn("q", F.when(F.col("kind") == "view", F.col("value") * 0.5).otherwise(F.lit(10.0)))
    found = disaggregate.steady_states_of(ev, ("value", "q"))
    return r6(found.select("meter", "t", F.col("transition_value").alias("active"), F.col("transition_q").alias("reactive")), "active", "reactive")


@query(f"""WITH {EV}, l AS (SELECT meter, t, value - lag(value) OVER (PARTITION BY meter ORDER BY t, id) AS delta FROM ev), w AS (SELECT * FROM l WHERE abs(delta) > 40),
p AS (SELECT a.meter, a.t AS on_t, b.t AS off_t, a.delta AS x, b.delta AS y FROM w a JOIN w b ON a.meter = b.meter AND a.delta > 0 AND b.delta < 0 AND b.t > a.t AND b.t < a.t + 86400000000 AND abs(a.delta + b.delta) < 20)
SELECT meter, on_t, off_t, round(1e9 * (exp(-((x - 80) ** 2) / (2 * 50.0 ** 2)) / (50 * sqrt(2 * pi()))) * (exp(-((y + 80) ** 2) / (2 * 50.0 ** 2)) / (50 * sqrt(2 * pi()))) * (exp(-((((off_t - on_t) / 1e6) - 30000) ** 2) / (2 * 20000.0 ** 2)) / (20000 * sqrt(2 * pi()))), 6) AS likelihood FROM p""")
def mle_pairs(s, d):
    found = disaggregate.likelihood_pairs(activations.switch_times(store.events(s, d)), DAY, 20, (80.0, 50.0), (-80.0, 50.0), (30000.0, 20000.0))
    return found.withColumn("likelihood", F.round(F.col("likelihood") * 1e9, 6))


@query(f"WITH {EV}, {MEAN}, l AS (SELECT meter, t, round(value, 6) AS value, round(lag(value, 1) OVER w, 6) AS lag_1, round(lag(value, 3) OVER w, 6) AS lag_3 FROM mn WINDOW w AS (PARTITION BY meter ORDER BY t)) SELECT * FROM l WHERE lag_3 IS NOT NULL")
def lag_features(s, d):
    return r6(forecast.lag_features(resample.mean(store.events(s, d), H), [1, 3]), "value", "lag_1", "lag_3")


@query(f"""WITH {EV}, {MEAN}, x AS (SELECT meter, t, make_timestamp(t) AS ts FROM mn) SELECT meter, t, round((isodow(ts) - 1) / 7, 6) AS weekday, round((hour(ts) * 60 + minute(ts) - 720) / 1440, 6) AS time, CAST(dayofyear(ts) AS INTEGER) AS day,
CAST(isodow(ts) <= 5 AS INTEGER) AS workday, CAST(hour(ts) >= 6 AND hour(ts) < 9 AS INTEGER) AS morning FROM x""")
def time_features(s, d):
    return r6(forecast.time_features(resample.mean(store.events(s, d), H)), "weekday", "time")


@query(f"WITH {EV}, dm AS (SELECT meter, t - t % 86400000000 AS t, avg(value) AS value FROM ev GROUP BY ALL) SELECT a.meter, a.t, round(b.value, 6) AS pred, round(a.value, 6) AS truth FROM dm a JOIN dm b ON a.meter = b.meter AND a.t = b.t + 604800000000")
def forecast_last_week(s, d):
    return r6(forecast.seasonal(resample.mean(store.events(s, d), 24 * H), 7 * DAY), "pred", "truth")


@query(f"WITH {EV}, {MEAN} SELECT meter, round(coalesce(corr(value, CAST(isodow(make_timestamp(t)) <= 5 AS DOUBLE)), 0), 6) AS workday, round(coalesce(corr(value, CAST(hour(make_timestamp(t)) >= 18 AS DOUBLE)), 0), 6) AS evening FROM mn GROUP BY meter")
def corr_vectors(s, d):
    ts = F.timestamp_micros("t")
    return r6(forecast.correlation_vectors(resample.mean(store.events(s, d), H), {"workday": F.weekday(ts) <= 4, "evening": F.hour(ts) >= 18}), "workday", "evening")


# Metadata: nations are groups, suppliers meters, customers appliances.
@query("SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE') AND s_acctbal >= 0")
def select_meters(s, d):
    t = {n: s.read.parquet(f"{d}/{n}.parquet") for n in ("supplier", "nation", "region")}
    wanted = t["nation"].join(t["region"].where(F.col("r_name").isin("ASIA", "EUROPE")), F.col("n_regionkey") == F.col("r_regionkey"))
    return t["supplier"].where("s_acctbal >= 0").join(wanted, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name", "n_name")


@query("SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM customer WHERE c_nationkey = s_nationkey AND c_mktsegment = 'MACHINERY' AND c_acctbal > 5000)")
def select_by_appliance(s, d):
    have = s.read.parquet(f"{d}/customer.parquet").where("c_mktsegment = 'MACHINERY' and c_acctbal > 5000").select(F.col("c_nationkey").alias("s_nationkey"))
    return s.read.parquet(f"{d}/supplier.parquet").join(have, "s_nationkey", "left_semi").select("s_suppkey")


@query("SELECT c_mktsegment AS category, count(*) AS n, count(DISTINCT c_nationkey) AS nations FROM customer GROUP BY 1")
def groupby_category(s, d):
    return s.read.parquet(f"{d}/customer.parquet").groupBy(F.col("c_mktsegment").alias("category")).agg(F.count("*").alias("n"), F.countDistinct("c_nationkey").alias("nations"))


@query("SELECT r_name AS parent, n_name AS child, 1 AS depth FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT n_name, s_name, 2 FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def wiring_children(s, d):
    t = {n: s.read.parquet(f"{d}/{n}.parquet") for n in ("supplier", "nation", "region")}
    top = t["nation"].join(t["region"], F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("parent"), F.col("n_name").alias("child"), F.lit(1).alias("depth"))
    return top.unionByName(t["supplier"].join(t["nation"], F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("parent"), F.col("s_name").alias("child"), F.lit(2).alias("depth")))


@query(f"WITH {EV}, r AS (SELECT meter, kind, min(CASE kind WHEN 'purchase' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 3 END) AS r, count(*) AS n FROM ev GROUP BY ALL) SELECT meter, arg_min(kind, (r, kind)) AS best, CAST(arg_min(n, (r, kind)) AS BIGINT) AS n FROM r GROUP BY meter")
def best_ac_type(s, d):
    rank = F.when(F.col("kind") == "purchase", 0).when(F.col("kind") == "view", 1).when(F.col("kind") == "click", 2).otherwise(3)
    rows = store.events(s, d).groupBy("meter", "kind").agg(F.count("*").alias("n"))
    return rows.groupBy("meter").agg(F.min_by("kind", F.struct(rank, "kind")).alias("best"), F.min_by("n", F.struct(rank, "kind")).alias("n"))


# The wiring tree: a region feeds nations, a nation suppliers and customers.
_EDGES = """ed AS (SELECT 'r' || r_regionkey AS meter, CAST(NULL AS VARCHAR) AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer)"""


def edges(s, d) -> DataFrame:
    def some(table: str, mark: str, key: str, up: str | None, parent: str | None) -> DataFrame:
        above = F.concat(F.lit(up), F.col(parent).cast("string")) if parent else F.lit(None).cast("string")
        return s.read.parquet(f"{d}/{table}.parquet").select(F.concat(F.lit(mark), F.col(key).cast("string")).alias("meter"), above.alias("parent"))

    parts = [some("region", "r", "r_regionkey", None, None), some("nation", "n", "n_nationkey", "r", "n_regionkey"), some("supplier", "s", "s_suppkey", "n", "s_nationkey"), some("customer", "c", "c_custkey", "n", "c_nationkey")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(f"""WITH RECURSIVE {_EDGES}, tree AS (SELECT meter, meter AS root, 0 AS depth FROM ed WHERE parent IS NULL UNION ALL SELECT ed.meter, tree.root, tree.depth + 1 FROM ed JOIN tree ON ed.parent = tree.meter)
SELECT meter, root, CAST(depth AS INTEGER) AS depth FROM tree""")
def wiring_tree(s, d):
    return wiring.wiring_tree(edges(s, d))


_NATION_KWH = """en AS (SELECT 'n' || s_nationkey AS meter, sum(CAST(s_acctbal AS DOUBLE)) AS kwh FROM supplier GROUP BY 1 UNION ALL SELECT 'r' || n_regionkey, sum(CAST(s_acctbal AS DOUBLE)) FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)"""


def nation_energies(s, d) -> DataFrame:
    """Suppliers' balances play the energies of nations and regions."""
    sup = s.read.parquet(f"{d}/supplier.parquet").groupBy("s_nationkey").agg(F.sum(F.col("s_acctbal").cast("double")).alias("kwh"))
    up = sup.join(s.read.parquet(f"{d}/nation.parquet"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("meter")).agg(F.sum("kwh").alias("kwh"))
    return sup.select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("meter"), "kwh").unionByName(up)


@query(f"WITH {_EDGES}, {_NATION_KWH} SELECT ed.meter, ed.parent, CASE WHEN b.kwh <> 0 THEN round(a.kwh / b.kwh, 6) END AS proportion FROM ed JOIN en a ON ed.meter = a.meter JOIN en b ON ed.parent = b.meter")
def proportion_of_upstream(s, d):
    return r6(wiring.proportion_of_upstream(nation_energies(s, d), edges(s, d)), "proportion")


@query(f"""WITH {_EDGES}, {_NATION_KWH} SELECT ed.parent AS meter, round(sum(CASE WHEN b.kwh <> 0 THEN a.kwh / b.kwh END), 6) AS submetered FROM ed JOIN en a ON ed.meter = a.meter JOIN en b ON ed.parent = b.meter GROUP BY 1""")
def proportion_submetered(s, d):
    return r6(wiring.proportion_of_upstream(nation_energies(s, d), edges(s, d)).groupBy(F.col("parent").alias("meter")).agg(F.sum("proportion").alias("submetered")), "submetered")


@query(f"WITH {EV}, {KWH}, m AS (SELECT min(meter) AS m FROM en) SELECT CAST(meter AS VARCHAR) AS meter, round(kwh, 6) AS kwh FROM en, m WHERE meter <> m UNION ALL SELECT 'remainder', round(sum(CASE WHEN meter = m THEN kwh ELSE -kwh END), 6) FROM en, m")
def energy_with_remainder(s, d):
    """The meter of the smallest number plays the mains."""
    ev = store.events(s, d)
    first = ev.where("value is not null").agg(F.min("meter")).first()[0]
    return r6(wiring.with_remainder(energy.total_energy(ev, 7200), first), "kwh")


_RANK = "(SELECT meter, t, id, z, value FROM (SELECT *, value + 1e-10 * (CAST((id * 7919) % 1000003 AS DOUBLE) / 1000003) AS z FROM ev WHERE value IS NOT NULL AND NOT isnan(value)))"


def _near_sql(k: int) -> str:
    low = [f"lag(z, {j}) OVER w" if j else "z" for j in range(k + 1)]
    high = [f"lead(z, {k - j}) OVER w" if j < k else "z" for j in range(k + 1)]
    return "least(" + ", ".join(f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN greatest(z - {a}, {b} - z) END" for a, b in zip(low, high, strict=True)) + ")"


def _digamma_sql(n: str) -> str:
    return f"(ln({n} + 10) - 1 / (2 * ({n} + 10)) - 1 / (12 * ({n} + 10) ** 2) + 1 / (120 * ({n} + 10) ** 4) - (" + " + ".join(f"1 / ({n} + {i})" for i in range(10)) + "))"


@query(f"""WITH {EV}, nr AS (SELECT meter, {_near_sql(3)} AS near FROM {_RANK} WINDOW w AS (PARTITION BY meter ORDER BY z, id)),
g AS (SELECT meter, count(*) AS n, CAST(count(*) AS DOUBLE) AS c, avg(ln(greatest(near, 1e-15))) AS mean FROM nr GROUP BY meter)
SELECT meter, CASE WHEN n > 3 THEN round(({_digamma_sql('c')} - (1.5 - 0.5772156649015329) + ln(2) + mean) / ln(2), 6) END AS entropy, n FROM g""")
def entropy_per_meter(s, d):
    return r6(information.entropy_per_meter(store.events(s, d)), "entropy")


def _information_sql(points: str, keys: str) -> str:
    """All pairs of points compared; `points` is the text of pt(keys, id, x, y) without the shift."""
    both = " AND ".join(f"a.{c} = b.{c}" for c in keys.split(", "))
    return f"""sh AS MATERIALIZED (SELECT {keys}, row_number() OVER () AS id, x + 1e-10::DOUBLE * (((id * 7919) % 1000003) / 1000003::DOUBLE) AS x, y + 1e-10::DOUBLE * (((id * 7919) % 1000003) / 1000003::DOUBLE) AS y FROM ({points}) WHERE x IS NOT NULL AND y IS NOT NULL),
fr AS MATERIALIZED (SELECT {', '.join(f'a.{c}' for c in keys.split(', '))}, a.id, any_value(a.x) AS x, any_value(a.y) AS y, (min(greatest(abs(a.x - b.x), abs(a.y - b.y)), 4))[4] - 1e-15 AS r FROM sh a JOIN sh b ON {both} GROUP BY ALL),
ct AS (SELECT {', '.join(f'a.{c}' for c in keys.split(', '))}, a.id, CAST(count(*) FILTER (b.x BETWEEN a.x - a.r AND a.x + a.r) AS DOUBLE) AS nx, CAST(count(*) FILTER (b.y BETWEEN a.y - a.r AND a.y + a.r) AS DOUBLE) AS ny FROM fr a JOIN sh b ON {both} GROUP BY ALL)
SELECT {keys}, round((1.5 - 0.5772156649015329 + {_digamma_sql('CAST(count(*) AS DOUBLE)')} - avg({_digamma_sql('greatest(nx, 1)')}) - avg({_digamma_sql('greatest(ny, 1)')})) / ln(2), 6) AS mi, count(*) AS n FROM ct GROUP BY {keys}"""


@query(f"WITH {EV}, {_information_sql('SELECT kind AS meter, id, value AS x, lag(value) OVER (PARTITION BY meter ORDER BY t, id) AS y FROM ev', 'meter')}")
def mutual_information(s, d):
    """Of each reading and the one before it, a kind of event a group; the SQL compares all pairs."""
    before = F.lag("value").over(resample_order())
    rows = store.events(s, d).withColumn("y", before).select(F.col("kind").alias("meter"), "id", F.col("value").alias("x"), "y")
    return r6(information.mutual_information(rows), "mi")


@query(f"WITH {EV}, hr AS (SELECT kind, t - t % 3600000000 AS t, avg(value) AS value FROM ev WHERE value IS NOT NULL GROUP BY ALL), {_information_sql('SELECT a.kind AS meter_a, b.kind AS meter_b, a.t % 1000003 AS id, a.value AS x, b.value AS y FROM hr a JOIN hr b ON a.t = b.t AND a.kind < b.kind', 'meter_a, meter_b')}")
def pairwise_information(s, d):
    """Mutual information of the hourly means of every two kinds of events."""
    ev = store.events(s, d).withColumn("meter", F.col("kind"))
    return r6(information.pairwise_mutual_information(resample.mean(ev, H)), "mi")


def resample_order():
    from pyspark.sql import Window

    return Window.partitionBy("meter").orderBy("t", "id")


_MODE = f"WITH {EV}, c AS (SELECT meter, kind, count(*) AS n FROM ev GROUP BY ALL)"


@query(f"{_MODE} SELECT meter, arg_min(kind, (-n, kind)) AS mode FROM c GROUP BY meter")
def most_common_value(s, d):
    """Of equal counts the smallest."""
    counts = store.events(s, d).groupBy("meter", "kind").agg(F.count("*").alias("n"))
    return counts.groupBy("meter").agg(F.min_by("kind", F.struct(-F.col("n"), F.col("kind"))).alias("mode"))


@query(f"WITH {EV}, m AS (SELECT count(DISTINCT meter) AS m FROM ev) SELECT kind FROM ev GROUP BY kind HAVING count(DISTINCT meter) = (SELECT m FROM m)")
def common_ac_types(s, d):
    """The kinds that every meter has."""
    ev = store.events(s, d)
    each = ev.groupBy("kind").agg(F.countDistinct("meter").alias("n"))
    every = ev.agg(F.countDistinct("meter").alias("all"))  # one row
    return each.join(F.broadcast(every), F.col("n") == F.col("all")).select("kind")


@query("SELECT s_nationkey AS meter, min(CASE WHEN s_acctbal > 0 THEN CAST(s_acctbal AS DOUBLE) ELSE 10.0 END) AS threshold FROM supplier GROUP BY 1")
def on_thresholds(s, d):
    """A meter's threshold is the least of its appliances', which is 10 where the metadata give none."""
    power = F.coalesce(F.when(F.col("s_acctbal") > 0, F.col("s_acctbal").cast("double")), F.lit(10.0))
    return s.read.parquet(f"{d}/supplier.parquet").groupBy(F.col("s_nationkey").alias("meter")).agg(F.min(power).alias("threshold"))


# A made-up rule stands for the published profiles, which are a parameter.
PROFILES = {(x, y): [50.0 + 20 * i + 10 * j + (q * 7) % 96 for q in range(96)] for i, x in enumerate(forecast.SEASONS) for j, y in enumerate(forecast.DAY_TYPES)}
FACTORS = [0.8 + 0.001 * k for k in range(1, 367)]


def _profile_sql() -> str:
    kind = "CASE WHEN isodow(ts) <= 5 THEN 0 WHEN isodow(ts) = 6 THEN 1 ELSE 2 END"
    value = "(50 + 20 * {i} + 10 * kd + {q} * 7 % 96)"
    each = lambda i: f"((1 - sh) * {value.format(i=i, q='q')} + sh * {value.format(i=i, q='((q + 1) % 96)')})"
    share = "CASE WHEN d >= 21 AND d < 111 THEN {a} WHEN d >= 111 AND d < 202 THEN {b} WHEN d >= 202 AND d < 294 THEN {c} ELSE {e} END"
    late = "((CASE WHEN d < 21 THEN d + 366 ELSE d END) - 294) / 93.0"
    summer = share.format(a="0.0", b="(d - 111) / 91.0", c="1 - (d - 202) / 92.0", e="0.0")
    winter = share.format(a="1 - (d - 21) / 90.0", b="0.0", c="0.0", e=late)
    inter = share.format(a="(d - 21) / 90.0", b="1 - (d - 111) / 91.0", c="(d - 202) / 92.0", e=f"1 - {late}")
    return f"""WITH {EV}, gr AS (SELECT DISTINCT meter, t - t % 1200000000 AS t FROM ev), x AS (SELECT meter, t, make_timestamp(t) AS ts FROM gr),
y AS (SELECT meter, t, dayofyear(ts) AS d, {kind} AS kd, hour(ts) * 4 + minute(ts) // 15 AS q, minute(ts) / 60.0 AS sh FROM x)
SELECT meter, t, round(CAST(({each(0)} * ({summer}) + {each(1)} * ({winter}) + {each(2)} * ({inter})) * (0.8 + 0.001 * d) * 3.5 AS DOUBLE), 4) AS pred FROM y"""


@query(_profile_sql())
def slp_forecast(s, d):
    grid = resample.mean(store.events(s, d), 1200)
    return forecast.load_profile(grid, PROFILES, FACTORS, F.lit(3.5)).withColumn("pred", F.round("pred", 4))


@query(f"""WITH {EV}, x AS (SELECT meter, value, hour(make_timestamp(t)) AS h FROM ev WHERE value IS NOT NULL),
r AS (SELECT meter, rank() OVER (PARTITION BY meter ORDER BY value) + (count(*) OVER (PARTITION BY meter, value) - 1) / 2 AS a, rank() OVER (PARTITION BY meter ORDER BY h) + (count(*) OVER (PARTITION BY meter, h) - 1) / 2 AS b FROM x),
c AS (SELECT meter, CASE WHEN stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN corr(a, b) END AS rho FROM r GROUP BY meter) SELECT meter, round(rho, 6) AS rho FROM c""")
def rank_correlation(s, d):
    return r6(forecast.rank_correlation(store.events(s, d).withColumn("h", F.hour(F.timestamp_micros("t"))), "value", "h"), "rho")


@query()
def cluster_meters(s, d):
    """k-means of the meters' correlation vectors; an iterative fit, not in SQL."""
    return cluster.cluster_vectors(corr_vectors(s, d), ["workday", "evening"], 6)


@query()
def event_mixture(s, d):
    """Three Gaussians over the readings; an iterative fit, not in SQL."""
    return r6(cluster.gaussian_mixture(store.events(s, d).where("value is not null").select("meter", "id", "value"), ["value"], 3), "p")


@query()
def simulated_transients(s, d):
    """Ten days of the seven machines; random draws, not in SQL."""
    return r6(simulate.transients(s, 864_000, 7), "transition", "spike", "signature")


CENTROIDS = {"fridge": 60.0, "heater": 200.0}
_STATES = """sw AS (SELECT meter, t, id, value - lag(value) OVER (PARTITION BY meter ORDER BY t, id) AS tr FROM ev),
st AS (SELECT meter, t, CASE WHEN abs(abs(tr) - 60) <= abs(abs(tr) - 200) THEN 'fridge' ELSE 'heater' END AS device, CASE WHEN tr > 0 THEN 1 ELSE 0 END AS state FROM sw WHERE abs(tr) > 40)"""


def transitions(s, d) -> DataFrame:
    return store.events(s, d).withColumn("transition", F.col("value") - F.lag("value").over(resample_order())).where("abs(transition) > 40").select("meter", "t", "id", "transition")


@query(f"WITH {EV}, {_STATES} SELECT meter, t, device, CAST(state AS INTEGER) AS state FROM st")
def centroid_states(s, d):
    return disaggregate.centroid_states(transitions(s, d), CENTROIDS)


@query(f"""WITH {EV}, {_STATES}, one AS (SELECT meter, t, device, min(state) AS state FROM st GROUP BY ALL), dv(device, c) AS (VALUES ('fridge', 60.0::DOUBLE), ('heater', 200.0::DOUBLE)),
r AS (SELECT meter, t, id, device, c FROM ev CROSS JOIN dv WHERE value IS NOT NULL)
SELECT r.meter, r.t, r.id, r.device, coalesce(one.state, 0) * c AS power FROM r ASOF LEFT JOIN one ON r.meter = one.meter AND r.device = one.device AND r.t > one.t""")
def filled_power(s, d):
    return disaggregate.filled_power(store.events(s, d), disaggregate.centroid_states(transitions(s, d), CENTROIDS), CENTROIDS)


@query(f"""WITH {EV}, h AS (SELECT meter, value AS x, hour(make_timestamp(t)) AS y FROM ev WHERE value IS NOT NULL),
p AS (SELECT a.meter, sum(sign(a.x - b.x) * sign(a.y - b.y)) AS s, count(*) FILTER (a.x <> b.x) AS nx, count(*) FILTER (a.y <> b.y) AS ny FROM h a JOIN h b ON a.meter = b.meter GROUP BY a.meter)
SELECT meter, round(CASE WHEN nx > 0 AND ny > 0 THEN s / (sqrt(nx) * sqrt(ny)) END, 6) AS tau FROM p""")
def kendall_correlation(s, d):
    return r6(forecast.kendall_correlation(store.events(s, d).withColumn("h", F.hour(F.timestamp_micros("t"))), "value", "h"), "tau")


def segmented(s, d) -> DataFrame:
    return eventbased.segments(disaggregate.steady_states(store.events(s, d), 30, 10), 30)


@query()
def event_segments(s, d):
    """Segments of transients by plateaus; a sequential rule, not in SQL."""
    return r6(segmented(s, d), "transition", "level")


@query()
def segment_pairs(s, d):
    """Features of segments of two transients, whose segments are found sequentially."""
    return r6(eventbased.segment_features(segmented(s, d), 2), "transition_avg", "transition_delta", "spike_up", "spike_down", "duration")


@query()
def segment_fours(s, d):
    """Segments of four that may be two pairs."""
    return r6(eventbased.split_fours(segmented(s, d)), "transition", "level")


@query()
def pair_mixture(s, d):
    """Gaussians over the segments of two, by BIC, with the confidence check; an iterative fit."""
    found = eventbased.segment_features(segmented(s, d), 2)
    return r6(eventbased.mixture_by_bic(found, ["transition_avg", "transition_delta"], 4, ["transition_avg"]), "transition_avg", "transition_delta", "spike_up", "spike_down", "duration")


@query()
def weighted_mixture(s, d):
    """Four Gaussians over changes and the minutes since the change before, the change counting a hundredfold; an iterative fit."""
    order = resample_order()
    rows = store.events(s, d).where("value is not null").select("meter", "t", "id", (F.col("value") - F.lag("value").over(order)).alias("change"), ((F.col("t") - F.lag("t").over(order)) / 6e7).alias("minutes")).where("abs(change) > 40")
    found = eventbased.mixture_by_bic(rows, ["change", "minutes"], 4, ["change"], emphasis={"change": 100.0})
    return r6(found, "change", "minutes")


@query()
def long_segment_steps(s, d):
    """Decoding of the segments of five transients or more; a dynamic programme."""
    steps = {n: [([w], [[400.0]]), ([-w], [[400.0]])] for n, w in {"fridge": 60.0, "heater": 120.0}.items()}
    return eventbased.decode_segments(segmented(s, d), ["transition"], steps)


PHASE_EPS = 6 * H
_PHASES = f"""sw AS (SELECT meter % 3 AS phase, t // {H * 1000000} * {H * 1000000} AS t, value - lag(value) OVER (PARTITION BY meter ORDER BY t, id) AS tr FROM ev),
once AS (SELECT phase, t, sum(tr) AS tr FROM sw WHERE abs(tr) > 60 GROUP BY ALL),
j AS (SELECT a.phase AS phase_a, b.phase AS phase_b, a.t, a.tr AS transition_a, b.tr AS transition_b FROM once a JOIN once b ON a.t = b.t AND a.phase < b.phase AND a.tr * b.tr > 0),
e AS (SELECT * FROM j QUALIFY count(*) OVER (PARTITION BY phase_a, phase_b) >= 10),
c AS (SELECT *, count(*) OVER (PARTITION BY phase_a, phase_b ORDER BY t RANGE BETWEEN {PHASE_EPS * 1000000} PRECEDING AND {PHASE_EPS * 1000000} FOLLOWING) >= 5 AS core FROM e),
k AS (SELECT *, t - lag(t) OVER (PARTITION BY phase_a, phase_b ORDER BY t) AS gap FROM c WHERE core),
g AS (SELECT *, sum(CASE WHEN gap <= {PHASE_EPS * 1000000} THEN 0 ELSE 1 END) OVER (PARTITION BY phase_a, phase_b ORDER BY t) - 1 AS n FROM k)"""


@query(f"""WITH {EV}, {_PHASES}
SELECT 1 AS building, c.phase_a, c.phase_b, c.t, round(c.transition_a, 6) AS transition_a, round(c.transition_b, 6) AS transition_b, CAST(min(g.n) AS BIGINT) AS "group"
FROM c JOIN g ON c.phase_a = g.phase_a AND c.phase_b = g.phase_b AND abs(c.t - g.t) <= {PHASE_EPS * 1000000} WHERE NOT c.core OR c.t = g.t GROUP BY ALL""")
def phase_events(s, d):
    return r6(eventbased.phase_events(_phase_switches(s, d), PHASE_EPS), "transition_a", "transition_b")


def _phase_switches(s: SparkSession, d: str) -> DataFrame:
    hour = H * 1000000
    sw = store.events(s, d).withColumn("transition", F.col("value") - F.lag("value").over(resample_order())).where("abs(transition) > 60")
    return sw.select(F.lit(1).alias("building"), (F.col("meter") % 3).alias("phase"), F.expr(f"t div {hour} * {hour}").alias("t"), "transition")


_PARTED = _PHASES.replace("once AS (", "onces AS (").replace("j AS (SELECT a.phase", f"""al AS (SELECT t, sum(tr) AS total FROM onces GROUP BY t HAVING count(*) = 3 AND (min(tr) > 0 OR max(tr) < 0)),
once AS (SELECT * FROM onces ANTI JOIN al USING (t)),
j AS (SELECT a.phase""", 1)


@query(f"""WITH {EV}, {_PARTED},
pr AS (SELECT DISTINCT c.phase_a, c.phase_b, c.t, c.transition_a + c.transition_b AS total FROM c JOIN g ON c.phase_a = g.phase_a AND c.phase_b = g.phase_b AND abs(c.t - g.t) <= {PHASE_EPS * 1000000})
SELECT 1 AS building, '0+1+2' AS phases, t, round(total, 6) AS total FROM al UNION ALL SELECT 1, phase_a || '+' || phase_b, t, round(total, 6) FROM pr
UNION ALL SELECT 1, CAST(phase AS VARCHAR), t, round(tr, 6) FROM once o WHERE NOT EXISTS (SELECT 1 FROM pr WHERE pr.t = o.t AND o.phase IN (pr.phase_a, pr.phase_b))""")
def separated_phases(s, d):
    """Every switch of an hour with the phases that it happened on."""
    found = eventbased.separate_phases(_phase_switches(s, d), 3, PHASE_EPS)
    return r6(found.select("building", F.array_join("phases", "+").alias("phases"), "t", F.aggregate("transitions", F.lit(0.0), lambda a, x: a + x).alias("total")), "total")


@query()
def event_based_phases(s, d):
    """Hourly means of three meters each as the phases of a building, taken apart by shared and by single phases; mixtures by EM."""
    hour = H * 1000000
    phase = [F.floor(F.col("meter") / 3).alias("building"), (F.col("meter") % 3).cast("int").alias("phase"), F.expr(f"t div {hour} * {hour}").alias("t")]
    mains = store.events(s, d).where("value is not null").groupBy(*phase).agg(F.avg("value").alias("value")).withColumn("id", F.col("t"))
    found = models.EventBased(noise=30, state=10, threshold=30).disaggregate_phases(mains, 3, PHASE_EPS, 3, 3)
    return r6(found.withColumn("phases", F.array_join("phases", "+")), "power")


@query(f"""WITH {EV}, sw AS (SELECT meter, t, id, value - lag(value) OVER (PARTITION BY meter ORDER BY t, id) AS tr FROM ev),
r AS (SELECT meter, t, id, tr, (row_number() OVER (PARTITION BY meter ORDER BY t, id) - 1) // 4 AS run FROM sw WHERE abs(tr) > 40),
f AS (SELECT *, row_number() OVER w = 1 AS first, sum(tr) OVER (PARTITION BY meter, run) AS err FROM r WINDOW w AS (PARTITION BY meter, run ORDER BY t, tr)),
x AS (SELECT meter, t, sum(tr - CASE WHEN first THEN err ELSE 0 END) AS ch FROM f GROUP BY ALL)
SELECT meter, 'all' AS appliance, t, round(sum(ch) OVER (PARTITION BY meter ORDER BY t), 6) + 0.0 AS power FROM x""")
def appliance_power(s, d):
    sw = store.events(s, d).withColumn("transition", F.col("value") - F.lag("value").over(resample_order())).where("abs(transition) > 40")
    rows = sw.select("meter", F.lit("all").alias("appliance"), F.expr("(row_number() over (partition by meter order by t, id) - 1) div 4").alias("run"), "t", "transition")
    return eventbased.appliance_power(rows).withColumn("power", F.round("power", 6) + 0.0)


@query()
def pair_centroids(s, d):
    """Mean shift over the sizes of pairs; iterative."""
    return r6(eventbased.pair_centroids(disaggregate.pair_from_falls(transitions(s, d)), 20), "centroid")


@query(f"""WITH {EV}, p AS (SELECT meter, t, id, value, CASE WHEN value < 30 THEN 0 WHEN value < 130 THEN 1 ELSE 2 END AS state FROM ev WHERE value IS NOT NULL),
n AS (SELECT *, lead(state) OVER (PARTITION BY meter ORDER BY t, id) AS nx FROM p),
c AS (SELECT meter, state, count(*) AS n, avg(value) AS mean, count_if(nx = 0) AS a, count_if(nx = 1) AS b, count_if(nx = 2) AS c FROM n GROUP BY ALL),
e AS (SELECT DISTINCT meter, s.state, s.level FROM p CROSS JOIN (VALUES (0, 0.0), (1, 60.0), (2, 200.0)) s(state, level)),
f AS (SELECT meter, state, coalesce(mean, level) AS mean, coalesce(n, 0) AS n, coalesce(a, 0) AS a, coalesce(b, 0) AS b, coalesce(c, 0) AS c FROM e LEFT JOIN c USING (meter, state))
SELECT meter, CAST(state AS INTEGER) AS state, round(mean, 9) AS mean, CAST(n AS BIGINT) AS n, round(n / sum(n) OVER (PARTITION BY meter), 6) AS start,
round((a + 1.0::DOUBLE) / (a + b + c + 3), 6) AS to_0, round((b + 1.0::DOUBLE) / (a + b + c + 3), 6) AS to_1, round((c + 1.0::DOUBLE) / (a + b + c + 3), 6) AS to_2 FROM f""")
def fhmm_train(s, d):
    found = disaggregate.fhmm_train(store.events(s, d), [0, 60, 200])
    return r6(found.select("meter", "state", F.round("mean", 9).alias("mean"), "n", "start", *(F.col("move")[k].alias(f"to_{k}") for k in range(3))), "start", "to_0", "to_1", "to_2")


@query(f"""WITH {EV}, h AS (SELECT t // {H * 1000000} * {H * 1000000} AS t, sum(value) AS value, count(DISTINCT meter) AS n FROM ev WHERE value IS NOT NULL GROUP BY 1)
SELECT t, round(value / n * (SELECT count(DISTINCT meter) FROM ev), 6) AS value FROM h""")
def repaired_total(s, d):
    hour = H * 1000000
    ev = store.events(s, d).where("value is not null").withColumn("t", F.expr(f"t div {hour} * {hour}"))
    meters = store.events(s, d).select("meter").distinct().count()
    return r6(energy.repaired_total(ev.groupBy("t").agg(F.sum("value").alias("value")), ev.groupBy("t").agg(F.countDistinct("meter").alias("n")), meters), "value")
