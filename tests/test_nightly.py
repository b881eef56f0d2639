from pyspark.sql import functions as F

from riskloom.plans import fixtures as FX
from riskloom.plans.nightly import run_nightly
from tests.conftest import SMALL


def test_events_to_recommendation(spark):
    ev = FX.events(spark, SMALL)
    res = run_nightly(ev, FX.requests(spark, SMALL), FX.AS_OF, key=FX.EVENT_KEY, epochs=3, orders="all")
    n_countries = ev.select("country").dropna().distinct().count()
    assert res.forecast.count() == n_countries
    risk = res.risk.collect()
    assert len(risk) == n_countries and all(0.0 <= r["distance"] <= 1.0 for r in risk)
    assert res.codebook.count() == 25
    st = res.status.withColumnRenamed("status", "request_status")
    sel = res.selection.join(st, "request_id")
    assert sel.filter(F.col("request_status") != "ok").count() == 0
    assert res.selection.filter(F.col("status") != "optimal").count() == 0
    over = (res.selection.groupBy("request_id").agg(F.sum("distance").alias("r"))
            .join(st, "request_id").filter(F.col("r") > F.col("budget") + 1e-9))
    assert over.count() == 0
    ok = res.status.filter("status = 'ok'").count()
    assert res.recommendation.count() == ok
