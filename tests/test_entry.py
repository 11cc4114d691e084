"""The driver's contract."""

import __spark_entry__ as entry


def test_every_rule_has_a_query():
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and len(names) > 90


def test_flagship(spark):
    got = {r.level: r for r in entry.entry(spark).collect()}
    assert set(got) == {"class", "fold", "superfamily", "family"}
    assert all(0 <= r.patk <= 1 and 0 <= r.mapk <= 1 and 0 <= r.ratk <= 1 for r in got.values())
