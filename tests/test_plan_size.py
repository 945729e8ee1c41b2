"""Plans of the prediction stay small enough to be written out by the driver."""

from trailmark import catalog


def test_prediction_plan_is_short(spark):
    plan = catalog._evaluation(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert len(plan) < 3_000_000
