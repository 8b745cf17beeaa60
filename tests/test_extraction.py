"""The claim pipeline: a run that ended early goes on, a repair changes what was rejected only, headings set the delivery flag."""

import pytest

from tallyweave.operators import claims as C
from tallyweave.operators import extraction as E
from tallyweave.sources.paths import Stages, work_path

SPAN = "doc_id string, page int, reading_order int, id string, text string, x0 int, y0 int, x1 int, y1 int"
CLAIM = "doc_id string, ord int, path string, value string, evidence_ids array<string>, ambiguity string"


@pytest.fixture(scope="module")
def inputs(spark):
    lines = [("Issued 2027-05-06", 20, 10), ("No. R-9", 20, 40), ("EUR", 20, 70), ("Bill to", 20, 120), ("Ship to", 640, 120), ("Hafenweg 9", 20, 150), ("Kai 2", 640, 150), ("24103 Kiel", 20, 180), ("20457 Hamburg", 640, 180), ("Germany", 20, 210), ("Germany", 640, 210), ("Notes", 20, 300)]
    rows = [("d", 1, n, f"s{n}", t, x, y, x + 150, y + 20) for n, (t, x, y) in enumerate(lines)]
    rows += [("e", 1, 0, "s0", "Issued 2027-05-06", 20, 10, 170, 30), ("e", 1, 1, "s1", "Delivery Address", 20, 40, 170, 60), ("e", 1, 2, "s2", "not shipped", 20, 70, 170, 90)]
    spans = spark.createDataFrame(rows, SPAN)
    cells = spark.createDataFrame([], "doc_id string, page int, row int, role string, text string, evidence_ids array<string>")
    answer = [(d, 0, "order_date", "2027-05-07", ["s0"], None) for d in "de"] + [("d", 1, "external_reference", "R-9", ["s1"], None), ("d", 2, "debtor.billing_address.city", "Berlin", ["s7"], None)]
    again = [(d, 0, "order_date", "2027-05-06", ["s0"], None) for d in "de"] + [("d", 1, "external_reference", "R-8", ["s1"], None)]
    headers = spark.createDataFrame([("d", 0, False), ("e", 0, True)], "doc_id string, item_count int, delivery boolean")
    return spark.createDataFrame(answer, CLAIM), spark.createDataFrame(again, CLAIM), headers, spans, cells


def values(frames):
    return {(r.doc_id, r.path): r.value for r in frames[0].collect() if r.value is not None}


EXPECTED = {
    ("d", "order_date"): "2027-05-06", ("e", "order_date"): "2027-05-06", ("d", "external_reference"): "R-9",
    **{("d", f"debtor.billing_address.{f}"): v for f, v in (("street", "Hafenweg 9"), ("zip", "24103"), ("city", "Kiel"), ("country", "Germany"))},
    **{("d", f"debtor.delivery_address.{f}"): v for f, v in (("street", "Kai 2"), ("zip", "20457"), ("city", "Hamburg"), ("country", "Germany"))},
}


def test_a_run_that_ended_early_goes_on(spark, inputs, monkeypatch):
    folder = work_path(spark, "run")

    def broken(*_):
        raise RuntimeError("the run ends here")

    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(C, "repair", broken)
        E.extract(*inputs, folder=folder)
    run = Stages(spark, folder)
    assert [run.committed(s) for s in ("trusted", "headers", "claims-1", "issues-1", "claims-2", "claims")] == [True] * 4 + [False] * 2
    before = run.table("claims-1", broken).inputFiles()
    with monkeypatch.context() as m:
        # what was committed is not made again
        m.setattr(E, "trusted", broken)
        m.setattr(C, "no_delivery", broken)
        found = E.extract(*inputs, folder=folder)
    assert values(found) == EXPECTED
    assert run.table("claims-1", broken).inputFiles() == before
    assert {r.doc_id: r.delivery for r in run.table("headers", broken).collect()} == {"d": True, "e": False}
    # a whole run's results are read
    with monkeypatch.context() as m:
        m.setattr(C, "sanitize", broken)
        m.setattr(C, "verify", broken)
        assert values(E.extract(*inputs, folder=folder)) == EXPECTED
    run.drop()
    assert not run.committed("claims")


def test_a_step_that_was_not_committed_is_made_anew(spark):
    run = Stages(spark)
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    spark.range(5).write.parquet(f"{run.folder}/numbers")
    system, mark = run._path("numbers")
    system.delete(mark, False)
    assert run.table("numbers", make).count() == run.table("numbers", make).count() == 3 and made == [1]
