"""The comparing queries take in the whole events table."""

from photonloom.plans.events import table
from photonloom.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_every_event_is_compared(spark):
    ids = {r.event_id for r in table(spark, SF, "events").select("event_id").collect()}
    assert {r.id for r in QUERIES["json_diff"](spark, SF).collect()} == ids | {k - 1 for k in ids}
    assert {int(r.experiment_id) for r in QUERIES["registry_upsert"](spark, SF).collect()} == ids | {k + 50 for k in ids}
    changed = {k for k in ids if k < 10 or k % 50 == 0}
    assert {r.event_id for r in QUERIES["replay_check"](spark, SF).collect()} == changed and max(changed) >= 400
