"""End-to-end plans: log directory -> cleaned Parquet -> analysis tables."""

import tempfile

from test_loader import tree  # noqa: F401  (fixture)

from telespark.plans.analysis import analyse
from telespark.plans.preprocess import preprocess
from telespark.sources import sinks


def test_preprocess_and_analyse(spark, tree):  # noqa: F811
    out = tempfile.mkdtemp(prefix="telespark-plan-")
    prep = preprocess(spark, tree, out, label="testdata3/")
    rows = prep.collect()
    assert len(rows) == 8
    assert prep.columns[:2] == ["Timestamp", "Event"]
    s1 = sorted((r.Timestamp, r.PlayPeriod) for r in rows if r.Participant == 1.0 and r.Timestamp)
    assert [p for _, p in s1] == ["Game"] * 5                   # start .. finish
    late = [r.PlayPeriod for r in rows if r.Participant == 1.0 and r.Timestamp is None]
    assert late == ["PostGame"]                                 # no timestamp: sorted after the finish
    # the cleaned table is laid out by session: a session filter prunes row groups, and the index finds its files
    one = prep.filter("Participant = 2.0")
    assert "PushedFilters: [IsNotNull(Participant), EqualTo(Participant,2.0)]" in one._jdf.queryExecution().executedPlan().toString()
    own = sinks.read_clean(spark, f"{out}/clean", prep.schema, {"Participant": 2.0})
    assert sorted(map(str, own.collect())) == sorted(map(str, one.collect())) != []
    a = analyse(prep, unit="second")
    summ = a.summary.collect()
    assert len(summ) == 1 and summ[0].PlayTime == 7.5 and summ[0].MoleHitCount == 1
    assert a.playback.count() > 0 and a.axis.count() == 1
