"""Readings of one file an attribute meet as an outer join of the files would have them."""

from gridloom.sources import converters

COLUMNS = {"Power": ("power", "active"), "Energy": ("energy", "active"), "Current": ("current", None)}


def test_per_attribute_csv(spark, tmp_path):
    files = {
        ("academic", 3, "Power"): "1400000000000,10.5\n1400000001000,11\n1400000001000,11\n,7\n1400000002000,\nx,1\n",
        ("academic", 3, "Current"): "1400000001000.0,0.5\n",
        ("academic", 3, "Voltage"): "1400000001000,230\n",
        ("lecture", 1, "Energy"): "1400000000250,99\n",
        ("unknown", 1, "Energy"): "1400000000250,99\n",
        ("lecture", 2, "Power"): "",
    }
    for (b, m, a), text in files.items():
        (tmp_path / b / str(m)).mkdir(parents=True, exist_ok=True)
        (tmp_path / b / str(m) / f"{a}.csv").write_text(text)
    found = converters.per_attribute_csv(spark, str(tmp_path), "COMBED", COLUMNS, {"academic": 1, "lecture": 2})
    got = sorted((r.building, r.meter, int(r.ms), r.physical_quantity, r.ac_type or "", r.value) for r in found.selectExpr("*", "unix_millis(ts) AS ms").collect())
    assert got == [
        (1, 3, 1400000000000, "power", "active", 10.5),
        (1, 3, 1400000001000, "current", "", 0.5),
        (1, 3, 1400000001000, "power", "active", 11.0),
        (2, 1, 1400000000250, "energy", "active", 99.0),
    ]
    assert found.columns == converters._OUT
