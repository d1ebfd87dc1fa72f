import pytest
from pyspark.sql import functions as F

from averis.operators import pipeline as P


def cases(spark):
    rows = []
    for i in range(24):
        same = i % 2
        known = f"das ist der text von {'anna' if i % 3 else 'otto'} und er ist kurz. noch ein satz."
        unknown = known + " ja." if same else "völlig anders! zahlen 123 und worte ohne bezug."
        rows.append((i, "original", "diy", "train" if i < 12 else "test", f"p{i}", f"a{i}", f"a{i}" if same else f"b{i}", known, unknown, same))
    return spark.createDataFrame(rows, "case_id bigint, masking string, topic string, split string, pair string, known_author string, unknown_author string, known string, unknown string, y_true int")


def test_runs_and_failures(spark):
    def broken(c, r):
        raise RuntimeError("no weights")

    out, failed = P.run(cases(spark), [P.build("coav"), P.build("fevec", scorer=broken), P.build("lambdag", references=2, order=2)], runs=2)
    assert [f[:2] for f in failed] == [("fevec", 1), ("fevec", 2)] and "no weights" in failed[0][2]
    n = {(r.method, r.run): r["count"] for r in out.groupBy("method", "run").count().collect()}
    assert n == {("coav", 1): 24, ("lambdag", 1): 24, ("lambdag", 2): 24}
    acc = out.where("method = 'coav' AND split = 'test'").agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("int"))).first()[0]
    assert acc == 1.0


def test_registry():
    with pytest.raises(ValueError):
        P.build("nope")
    assert P.build("dv").decision == 0.5 and callable(P.build("dv").scorer)
    assert P.build("siambert").decision == "accuracy"
