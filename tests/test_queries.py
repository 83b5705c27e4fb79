"""Every core query against its SQL, the values the blueprint states, and order independence."""

import pytest

from oracle import assert_same, connect
from quillon.queries import DSL, ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, sf, name):
    df = QUERIES[name](spark, sf)
    if name in ORACLE:
        assert_same(df, connect(sf), ORACLE[name])
    else:
        assert df.count() >= 1


def test_known_values(spark):
    want = {
        "scan_sum": (451230286,), "filter_gt": (29205527,), "filter_lt": (30220755,), "filter_eq": (586371,),
        "filter_conj": (3408583,), "filter_empty": (None,), "join_two": (29205527, 22075854),
        "join_three_chain": (12088561, 24809), "join_star4": (30401842, 1153523, 351097),
        "self_join": (42500489, 2101203), "join_cycle": (1042794,), "join_empty": (None, None),
    }
    for name, values in want.items():
        assert tuple(QUERIES[name](spark, "/root/testdata/sf0.01").first()) == values, name


@pytest.mark.parametrize("name", ["sum_wrap_u64", "estimate_filter", "estimate_join", "radix_layout2", "value_index", "join_star4"])
def test_larger_keys(spark, name):
    """Where sizes of keys matter, the larger tables too."""
    assert_same(QUERIES[name](spark, "/root/testdata/sf0.1"), connect("/root/testdata/sf0.1"), ORACLE[name])


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLE.keys()


def test_filter_reaches_scan(spark, sf, capsys):
    QUERIES["join_two"](spark, sf).explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThan(l_suppkey,50)" in plan
    assert "l_extendedprice" not in plan
    assert DSL["join_two"]
