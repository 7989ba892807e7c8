import pytest

from logquarry.operators.assemble import entries_from_lines
from logquarry.plans import server
from logquarry.operators import facts
from logquarry.sources import prefix

TEXT = """
2025-01-01 10:00:00 UTC [11] bob@shop/psql 10.0.0.1 LOG:  duration: 1.0 ms  statement: SELECT 1
2025-01-01 10:00:01 UTC [12] eve@shop/app 10.0.0.2 ERROR:  boom
2025-01-01 10:00:02 UTC [9] LOG:  checkpoint starting: time
"""


def test_inferred_and_applied(lines):
    e = entries_from_lines(lines(TEXT))
    p = prefix.infer(prefix.sample(e))
    assert p.keys == ("pid", "user", "db", "app", "host")
    out = [r.message for r in prefix.apply_prefix(e, p).orderBy("seq").collect()]
    assert out[0] == "[11]: user=bob,db=shop,app=psql,host=10.0.0.1 LOG:  duration: 1.0 ms  statement: SELECT 1"
    assert out[2] == "[9] LOG:  checkpoint starting: time"
    counts = {r.user: r["count"] for r in server.entity_counts(facts.entities(prefix.apply_prefix(e, p)), "user").collect()}
    assert counts == {"bob": 1, "eve": 1}


def test_definitions():
    assert prefix.compile_prefix("%t [%p] %q%u@%d ").keys == ("pid", "user", "db")
    assert prefix.infer([]) is None and prefix.infer(["LOG:  x"]) is None
    with pytest.raises(ValueError):
        prefix.compile_prefix("%Z")
