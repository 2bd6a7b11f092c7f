from assaykit.engine import Engine
from assaykit.operators.compare import GateMetric, Policy


def test_engine(spark, sf_dir):
    e = Engine.from_tables(spark, sf_dir)
    assert e.query("pass_rate", "slice", slice_key="kind").count() == 6
    assert e.run_summary().count() == 2
    assert e.triage(severity="critical").where("severity <> 'critical'").count() == 0
    row = e.compare(resamples=100).first()
    assert row.lower <= row.delta <= row.upper
    loose = Policy((GateMetric("case_pass_rate", 1.0),), least_coverage=0.0, least_clusters=2, resamples=200)
    assert e.gate(loose).first().verdict == "ready"
    assert e.gate(loose, problems=["baseline run is cancelled"]).first().verdict == "inconclusive"
    assert e.quality("split").count() == 2
