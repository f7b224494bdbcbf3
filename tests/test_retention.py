from bookstrata.functions.clock import NS_PER_HOUR, parse_hour_label, segment_hour
from bookstrata.operators.retention import prune_decisions

FILES = "dt string, hour string, path string, bytes bigint, sha256 string"


def test_hours_past_the_range_of_nanoseconds(spark):
    hours = [("2024-01-01", "05"), ("2024-01-01", "06"), ("2262-04-12", "00"), ("2280-09-04", "07"), ("2024-13-01", "00")]
    inventory = spark.createDataFrame([(d, h, f"{d}/{h}/s.zst", 7, "x") for d, h in hours], FILES)
    baked = spark.createDataFrame([(d, h, 1, 0) for d, h in hours], "dt string, hour string, bake_version int, failures int")
    none = spark.createDataFrame([], FILES)
    # A day after the end of the first hour, less than a day after that of the second.
    now = (19_723 * 24 + 5 + 1 + 24) * NS_PER_HOUR + 1
    out = prune_decisions(inventory.select("dt", "hour"), inventory, none, baked, inventory, none, none, now, 24, 1)
    kept = ["inside_retention_window"]
    got = {(r.dt, r.hour): (r.reasons, r.bytes_freed) for r in out.collect()}
    assert got == {hours[0]: ([], 7), **{h: (kept, 0) for h in hours[1:]}}


def test_labels_past_the_range_of_nanoseconds(spark):
    rows = spark.createDataFrame([("2262-04-11T23", "2280-09-04/07/a.zst"), ("2262-04-12T00", "2280-09-04/24/a.zst")], "label string, name string")
    got = rows.select(parse_hour_label("label"), segment_hour("name")).collect()
    assert [tuple(r) for r in got] == [(2_562_047 * NS_PER_HOUR, "2280-09-04T07"), (None, None)]
