"""Lookups on a small fixture."""

from fieldlab.plans import marts


def test_lookup_keys(spark):
    customers = spark.createDataFrame([(1, "Customer#000000001", 7), (5, "Customer#000000005", 40), (6, "Customer#000000006", 40)], "c_custkey long, c_name string, c_nationkey int")
    events = spark.createDataFrame([(11, 1), (5, 99), (12, 40), (13, 98), (20, 5), (14, None)], "event_id long, user_id long")
    got = {r.event_id: (r.priority, r.c_custkey) for r in marts.lookup_keys(events, customers).collect()}
    assert got == {11: (1, 1), 5: (2, 5), 12: (3, 5), 13: (None, None), 20: (1, 5), 14: (None, None)}
