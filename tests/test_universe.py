from pyspark.sql import functions as F

from bookstrata import schemas
from bookstrata.operators import universe as U
from bookstrata.operators.directory import lifecycle_state


def test_closed_markets_leave_and_nothing_takes_their_place(spark):
    rows = [(f"S-E-T{n}", "S", "S-E", 0, "active", 100 - n, 1_000 + n, False, None, None, None, None) for n in range(6)]
    listing = spark.createDataFrame(rows, schemas.LISTING)
    policy = U.Policy(0, 10, (U.Group("g", events=1, markets_per_event=4, series=("S",)),))
    first = U.select(listing, policy, now_ts=10)
    assert [r.ticker for r in first.admitted().orderBy("place").collect()] == [f"S-E-T{n}" for n in range(4)]
    events = [("S-E-T1", "determined", 1, 1, None), ("S-E-T2", "close_date_updated", 2, 2, 50)]
    state = lifecycle_state(spark.createDataFrame(events, "ticker string, event_type string, recv_wall_ns bigint, seq bigint, close_ts bigint"))
    after = U.remove_closed(first, listing, state, now_ts=60)
    assert [r.ticker for r in after.admitted().orderBy("place").collect()] == ["S-E-T0", "S-E-T3"]
    assert after.reason_counts().where(F.col("reason") == "closed").first().markets == 1
