"""Registered queries of the data-set readers: small files by a rule, read back; the SQL states the same rule."""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.plans.metadata_queries import scratch
from gridloom.plans.registry import query, r6
from gridloom.sources import converters

T0 = 1_700_000_000


def written(s, files: dict[str, str]) -> str:
    """A new folder with these files, named by their path in it."""
    at = scratch(s)
    where, base = fs.FileSystem.from_uri(at if "://" in at else "file://" + at.removeprefix("file:"))
    for name, text in files.items():
        where.create_dir(f"{base}/{name.rsplit('/', 1)[0]}" if "/" in name else base, recursive=True)
        with where.open_output_stream(f"{base}/{name}") as f:
            f.write(text.encode())
    return at


def shown(df: DataFrame) -> DataFrame:
    """Readings with the instant as seconds and no name of the data set."""
    return r6(df.select("building", "meter", F.unix_seconds("ts").alias("s"), "physical_quantity", "ac_type", "value"), "value")


_OUT = "SELECT CAST(b AS INTEGER) AS building, CAST(m AS INTEGER) AS meter"


@query(f"{_OUT}, {T0} + i AS s, 'power' AS physical_quantity, CASE WHEN m <= 2 THEN 'apparent' ELSE 'active' END AS ac_type, CAST(b * 100 + m * 10 + i % 7 AS DOUBLE) AS value FROM range(1, 3) b(b), range(1, 5) m(m), range(200) i(i)")
def read_redd(s, d):
    at = written(s, {f"house_{b}/channel_{m}.dat": "".join(f"{T0 + i} {b * 100 + m * 10 + i % 7}\n" for i in range(200)) for b in (1, 2) for m in range(1, 5)})
    return shown(converters.redd(s, at))


@query(f"{_OUT}, {T0} + i * 8 AS s, 'power' AS physical_quantity, 'active' AS ac_type, CAST(b + m * i AS DOUBLE) AS value FROM range(1, 4) b(b), range(1, 4) m(m), range(100) i(i)")
def read_refit(s, d):
    at = written(s, {f"CLEAN_House{b}.csv": "Time,Unix,Aggregate,Appliance1,Appliance2\n" + "".join(f"x,{T0 + 8 * i},{b + i},{b + 2 * i},{b + 3 * i}\n" for i in range(100)) for b in (1, 2, 3)})
    return shown(converters.wide_csv(s, at, "REFIT", "Unix", {"Aggregate": 1, "Appliance1": 2, "Appliance2": 3}))


@query(f"""SELECT 1 AS building, CAST(m AS INTEGER) AS meter, {T0} + i * 60 AS s, CASE k WHEN 0 THEN 'power' WHEN 1 THEN 'power' ELSE 'voltage' END AS physical_quantity, CASE k WHEN 0 THEN 'active' WHEN 1 THEN 'reactive' END AS ac_type,
CASE WHEN k = 1 AND i % 10 = 0 THEN NULL ELSE CAST(m * 10 + k * 100 + i AS DOUBLE) END AS value FROM range(1, 4) m(m), range(50) i(i), range(3) k(k)""")
def read_per_meter(s, d):
    """One file a meter, with nulls marked as in iAWE; each instant stands twice."""
    line = lambda m, i: f"{T0 + 60 * i},{m * 10 + i}," + ("\\N" if i % 10 == 0 else str(m * 10 + 100 + i)) + f",{m * 10 + 200 + i}\n"
    at = written(s, {f"1/{m}.csv": "timestamp,W,VAR,V\n" + "".join(line(m, i) * 2 for i in range(50)) for m in (1, 2, 3)})
    return shown(converters.per_meter_csv(s, f"{at}/*", "iAWE", {"W": ("power", "active"), "VAR": ("power", "reactive"), "V": ("voltage", None)}, "timestamp", "\\N"))


@query("""SELECT 2 AS building, CAST(m AS INTEGER) AS meter, epoch(TIMESTAMP '2012-06-01') + (m - 1) * 86400 + i AS s, CASE k WHEN 0 THEN 'power' ELSE 'phase angle' END AS physical_quantity, CASE k WHEN 0 THEN 'active' END AS ac_type, CAST(CASE k WHEN 0 THEN i % 50 + m ELSE i % 90 END AS DOUBLE) AS value
FROM range(1, 3) m(m), range(300) i(i), range(2) k(k) WHERE NOT (k = 0 AND i % 11 = 0)""")
def read_eco(s, d):
    """Lines without a time; power of -1 is missing."""
    line = lambda m, i: f"{-1 if i % 11 == 0 else i % 50 + m},{i % 90}\n"
    at = written(s, {f"02/0{m}/2012-06-0{m}.csv": "".join(line(m, i) for i in range(300)) for m in (1, 2)})
    found = shown(converters.positional_days(s, at, "ECO", {0: ("power", "active"), 1: ("phase angle", None)}))
    return found.withColumn("s", F.col("s").cast("double"))


@query("SELECT CAST(b AS INTEGER) AS building, CAST(c + 1 AS INTEGER) AS meter, CAST(epoch(TIMESTAMP '2011-03-01') + i * 120 AS BIGINT) AS s, 'energy' AS physical_quantity, 'active' AS ac_type, CAST((b + c + i) * 10 AS DOUBLE) AS value FROM range(1, 3) b(b), range(1, 4) c(c), range(100) i(i)")
def read_hes(s, d):
    """Appliance codes by a lookup; a code without a meter is left out."""
    rows = [f"{b},{c},2011-03-01,{i * 2 // 60:02d}:{i * 2 % 60:02d}:00,{b + c + i}\n" for b in (1, 2) for c in (1, 2, 3, 9) for i in range(100)]
    lookup = s.createDataFrame([(b, c, c + 1) for b in (1, 2) for c in (1, 2, 3)], "building int, code int, meter int")
    return shown(converters.coded_long(s, written(s, {"a.csv": "".join(rows)}), "HES", lookup))


@query(f"{_OUT}, {T0} + b * 1000 + i AS s, 'power' AS physical_quantity, 'active' AS ac_type, CAST(m * 5 + i AS DOUBLE) AS value FROM range(2) b(b), range(1, 3) m(m), range(40) i(i) WHERE NOT (i = 3 AND m = 1)")
def read_greend(s, d):
    """Two blocks with their columns in another order, a broken line, an unknown device."""
    def text(b):
        a = "".join(f"{T0 + b * 1000 + i},{'' if i == 3 else 5 + i},{10 + i},7\n" for i in range(20))
        return "timestamp,A,B,X\n" + a + "NULL,1,2,3\n1.7e" + "timestamp,B,A\n" + "".join(f"{T0 + b * 1000 + i},{10 + i},{5 + i}\n" for i in range(20, 40))

    return shown(converters.block_csv(s, written(s, {f"building{b}/d.csv": text(b) for b in (0, 1)}), "GREEND", {"A": 1, "B": 2}))


@query(f"""WITH g AS (SELECT k, i, {T0 // 60 * 60} + i * 60 AS s FROM range(2) k(k), range(59) i(i)), v AS (SELECT *, CASE WHEN i % 7 = 3 THEN NULL ELSE k * 100 + i + 0.5 END AS x FROM g)
SELECT 1 AS building, 1 AS meter, s, CASE k WHEN 0 THEN 'power' ELSE 'voltage' END AS physical_quantity, CASE k WHEN 0 THEN 'active' END AS ac_type, CAST(coalesce(x, CASE k WHEN 0 THEN 0 ELSE (SELECT median(x) FROM v w WHERE w.k = v.k) END) AS DOUBLE) AS value FROM v""")
def filled_minutes(s, d):
    """Two samples a minute, some minutes lost."""
    rows = s.range(120).select((F.col("id") % 60).alias("i"), F.expr("id div 60").alias("k")).where("i % 7 <> 3")
    each = rows.select("i", "k", F.explode(F.array(F.lit(0), F.lit(30))).alias("o"))
    out = each.select(F.lit("x").alias("dataset"), F.lit(1).alias("building"), F.lit(1).alias("meter"), F.timestamp_seconds(F.lit(T0 // 60 * 60) + F.col("i") * 60 + F.col("o")).alias("ts"), F.when(F.col("k") == 0, "power").otherwise("voltage").alias("physical_quantity"), F.when(F.col("k") == 0, "active").alias("ac_type"), (F.col("k") * 100 + F.col("i") + F.col("o") / 30).cast("double").alias("value"))
    return shown(converters.filled_minutes(out))


@query(f"""SELECT 1 AS building, CAST(m AS INTEGER) AS meter, {T0} + i * 6 AS s, 'power' AS physical_quantity, CASE m WHEN 1 THEN 'apparent' ELSE 'active' END AS ac_type, CAST(m * 10 + i % 5 AS DOUBLE) AS value FROM range(1, 4) m(m), range(80) i(i)
UNION ALL SELECT 1, 54, {T0} + i, CASE k WHEN 2 THEN 'voltage' ELSE 'power' END, CASE k WHEN 0 THEN 'active' WHEN 1 THEN 'apparent' END, CASE k WHEN 0 THEN 100.5 + i WHEN 1 THEN 110.5 + i ELSE 230.25 END FROM range(90) i(i), range(3) k(k)""")
def read_ukdale(s, d):
    files = {f"house_1/channel_{m}.dat": "".join(f"{T0 + 6 * i} {m * 10 + i % 5}\n" for i in range(80)) for m in (1, 2, 3)}
    files["house_1/mains.dat"] = "".join(f"{T0 + i} {100.5 + i} {110.5 + i} 230.25\n" for i in range(90))
    return shown(converters.ukdale(s, written(s, files), {(1, 1): "apparent"}))
