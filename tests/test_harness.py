import json

import pytest
from karstline.errors import EngineError, InvalidInput, OwnershipViolation
from karstline.harness.adapters import DuckAdapter, SparkAdapter
from karstline.harness.admission import Admission, LocalRun, estimate
from karstline.harness.cases import CASES, INPUTS, slice_ids
from karstline.harness.outcomes import Failure, Rows, compare
from karstline.harness.reports import drift_report, markdown, summary, write
from karstline.plans.expr import Add, Column, Literal, int32
from karstline.plans.types import Field
from karstline.queries import matches


@pytest.mark.parametrize("slice_id", slice_ids())
def test_cases_have_their_outcomes(spark, slice_id):
    adapter = SparkAdapter(spark)
    for case in (c for c in CASES if c.slice_id == slice_id):
        found = adapter.execute(case)
        assert matches(case, found), (case.case_id, found)


@pytest.mark.parametrize("slice_id", ["first-expression-slice", "first-filter-is-not-null-slice"])
def test_exchange_parity(spark, slice_id):
    plain, handed = SparkAdapter(spark), SparkAdapter(spark, exchange=True)
    cases = [c for c in CASES if c.slice_id == slice_id]
    report = drift_report(slice_id, {c.case_id: plain.execute(c) for c in cases}, {c.case_id: handed.execute(c) for c in cases}, ("plain", "exchange"))
    assert summary(report)["match"] == len(cases)


def test_no_drift_from_duckdb(spark, tmp_path):
    plain, duck = SparkAdapter(spark), DuckAdapter()
    matched = 0
    for slice_id in slice_ids():
        cases = [c for c in CASES if c.slice_id == slice_id]
        results = {a.name: {c.case_id: a.execute(c) for c in cases} for a in (plain, duck)}
        report = drift_report(slice_id, results["spark"], results["duckdb"], ("spark", "duckdb"))
        assert summary(report)["drift"] == 0, report
        matched += summary(report)["match"]
        files = write(tmp_path, report, results)
    assert matched > 60
    assert json.loads(files[-1].read_text()) == report and "## Summary" in files[-2].read_text() and len(files) == 4


def test_inputs_are_all_used():
    assert {c.input_ref for c in CASES} <= set(INPUTS)
    assert len({(c.slice_id, c.case_id) for c in CASES}) == len(CASES)


def test_comparison_rules():
    rows = lambda *v, token="int32", nullable=False: Rows((Field("a", token, nullable),), tuple((x,) for x in v))
    names = ("x", "y")
    assert compare("c", rows(1), rows(1), names)["status"] == "match"
    assert compare("c", rows(1), rows(1, token="int64"), names)["comparison_dimensions"] == ["logical_type"]
    assert compare("c", rows(1), rows(2, nullable=True), names)["comparison_dimensions"] == ["field_nullability", "row_values"]
    assert compare("c", rows(1), Failure("engine_error"), names) | {"summary": ""} == {"case_id": "c", "status": "drift", "comparison_dimensions": ["error_class"], "summary": ""}
    assert compare("c", Failure("a"), Failure("a", "other text"), names)["status"] == "match"
    assert compare("c", Failure("a"), Failure("adapter_unavailable"), names)["status"] == "unsupported"
    mixed = compare("c", rows("NaN", "-0.0", "0.0"), rows("0.0", "NaN", "-0.0"), names, "float64-multiset-canonical")
    assert mixed["status"] == "match" and "`match`: 1" in markdown({"slice_id": "s", "engines": list(names), "cases": [mixed]})


def kinds(events):
    return [(e["event"], e.get("name"), e.get("bytes")) for e in events]


def test_mixed_claims_until_finished():
    run = LocalRun({"a": [1, 2, 3]}, [("a", Column(0)), ("a_plus_one", Add(Column(0), int32(1)))], claimed=("a",))
    found = run.run()
    assert kinds(found["admission_events"]) == [
        ("consumer_opened", "Source:a", None), ("reserve_admitted", "Source:a", 12), ("consumer_opened", "Projection:a_plus_one", None), ("reserve_admitted", "Projection:a_plus_one", 13),
        ("consumer_shrunk", "Projection:a_plus_one", 1), ("consumer_released", "Source:a", 12), ("consumer_released", "Projection:a_plus_one", 12),
    ]
    assert [(e["event"], e.get("claim_count")) for e in found["runtime_events"]] == [
        ("batch_emitted", 1), ("batch_handed_off", 1), ("batch_emitted", 2), ("batch_released", 1), ("batch_handed_off", 2), ("batch_released", 2), ("finished", None),
    ]
    assert run.result == {"a": [1, 2, 3], "a_plus_one": [2, 3, 4]}


def test_other_local_runs():
    columns = {"a": [1, None, 3]}
    plus_one = [("s", Add(Column(0), int32(1)))]
    nulls = LocalRun(columns, plus_one).run()
    assert [k[0] for k in kinds(nulls["admission_events"])] == ["consumer_opened", "reserve_admitted", "consumer_released"]
    assert nulls["admission_events"][-1]["bytes"] == estimate("int32", 3) == 13 and estimate("uint64", 9) == 74
    early = LocalRun(columns, plus_one, claimed=("a",)).run(None)
    assert early["runtime_events"][-1]["event"] == "batch_handed_off" and kinds(early["admission_events"])[-1] == ("consumer_released", "Source:a", 12)
    assert LocalRun(columns, plus_one).run("cancelled")["runtime_events"][-1] == {"event": "cancelled"}
    denied = LocalRun(columns, plus_one, limit=0).run()
    assert denied["admission_events"][-1] == {"event": "reserve_denied", "name": "Projection:s", "bytes": 13, "limit": 0}
    assert denied["runtime_events"][-1] == {"event": "error", "message": "Compute error: admission denied for Projection:s: requested 13 bytes with limit 0"}
    for outputs, values in (([("s", Column(4))], [1]), ([("s", Literal("uint64", 1))], [1]), (plus_one, [2**31 - 1])):
        assert LocalRun({"a": values}, outputs).run()["runtime_events"][-1]["event"] == "error"


def short(found):
    """Events as text: consumers ``name+bytes`` and so on, batches ``id:claims``."""
    sign = {"consumer_opened": "open", "reserve_admitted": "+", "reserve_denied": "no", "consumer_shrunk": "-", "consumer_released": "free"}
    a = [f"{e['name'].split(':')[1]} {sign[e['event']]}{e.get('bytes', '')}" for e in found["admission_events"]]
    r = [f"{e['event'].removeprefix('batch_')} {e['batch_id']}:{e['claim_count']}" if "batch_id" in e else e.get("message", e["event"]) for e in found["runtime_events"]]
    return a, r


PLUS, NULL, SEVEN = ("plus", Add(Column(0), int32(1))), ("null", int32(None)), ("seven", int32(7))
WHOLE, HOLED = [1, 2, 3], [1, None, 3]
START = ["emitted 1:0", "handed_off 1:0"]
CLAIMED = ["emitted 1:1", "handed_off 1:1"]
# Events of each documented checkpoint.
CHECKPOINTS = [
    (WHOLE, [PLUS], (), None, None, ["plus open", "plus +13", "plus -1"], [*START, "emitted 2:1", "handed_off 2:1"]),
    (WHOLE, [PLUS], (), None, "finished", ["plus open", "plus +13", "plus -1", "plus free12"], [*START, "emitted 2:1", "handed_off 2:1", "released 2:1", "finished"]),
    (WHOLE, [PLUS], (), 0, "finished", ["plus open", "plus no13"], [*START, "Compute error: admission denied for Projection:plus: requested 13 bytes with limit 0"]),
    (WHOLE, [("a", Column(0)), ("b", Column(0))], ("a",), None, None, ["a open", "a +12"], [*CLAIMED, "emitted 2:1", "released 1:1", "handed_off 2:1"]),
    (WHOLE, [("a", Column(0)), ("b", Column(0))], ("a",), None, "finished", ["a open", "a +12", "a free12"], [*CLAIMED, "emitted 2:1", "released 1:1", "handed_off 2:1", "released 2:1", "finished"]),
    (WHOLE, [("a", Column(1))], (), None, "finished", [], [*START, "Compute error: missing input column at index 1"]),
    (WHOLE, [("a", Column(0)), PLUS], ("a",), None, None, ["a open", "a +12", "plus open", "plus +13", "plus -1"], [*CLAIMED, "emitted 2:2", "released 1:1", "handed_off 2:2"]),
    (WHOLE, [("a", Column(0)), PLUS], ("a",), None, "cancelled", ["a open", "a +12", "plus open", "plus +13", "plus -1", "a free12", "plus free12"], [*CLAIMED, "emitted 2:2", "released 1:1", "handed_off 2:2", "released 2:2", "cancelled"]),
    (WHOLE, [("a", Column(0)), PLUS], ("a",), None, "finished", ["a open", "a +12", "plus open", "plus +13", "plus -1", "a free12", "plus free12"], [*CLAIMED, "emitted 2:2", "released 1:1", "handed_off 2:2", "released 2:2", "finished"]),
    (WHOLE, [PLUS, NULL], (), None, None, ["plus open", "plus +13", "plus -1", "null open", "null +13"], [*START, "emitted 2:2", "handed_off 2:2"]),
    (WHOLE, [PLUS, NULL], (), None, "finished", ["plus open", "plus +13", "plus -1", "null open", "null +13", "plus free12", "null free13"], [*START, "emitted 2:2", "handed_off 2:2", "released 2:2", "finished"]),
    (WHOLE, [SEVEN], (), None, None, ["seven open", "seven +13", "seven -1"], [*START, "emitted 2:1", "handed_off 2:1"]),
    (WHOLE, [SEVEN], (), None, "finished", ["seven open", "seven +13", "seven -1", "seven free12"], [*START, "emitted 2:1", "handed_off 2:1", "released 2:1", "finished"]),
    (WHOLE, [NULL], (), None, None, ["null open", "null +13"], [*START, "emitted 2:1", "handed_off 2:1"]),
    (WHOLE, [NULL], (), None, "finished", ["null open", "null +13", "null free13"], [*START, "emitted 2:1", "handed_off 2:1", "released 2:1", "finished"]),
    (HOLED, [PLUS], (), None, None, ["plus open", "plus +13"], [*START, "emitted 2:1", "handed_off 2:1"]),
    (HOLED, [PLUS], (), None, "finished", ["plus open", "plus +13", "plus free13"], [*START, "emitted 2:1", "handed_off 2:1", "released 2:1", "finished"]),
    ([2**31 - 1, 2, 3], [PLUS], (), None, "finished", ["plus open", "plus +13", "plus free13"], [*START, "Compute error: int32 overflow in Projection:plus at row 0"]),
    (WHOLE, [("a", Column(0))], ("a",), None, None, ["a open", "a +12"], [*CLAIMED, "emitted 2:1", "released 1:1", "handed_off 2:1"]),
    (WHOLE, [("a", Column(0))], ("a",), None, "finished", ["a open", "a +12", "a free12"], [*CLAIMED, "emitted 2:1", "released 1:1", "handed_off 2:1", "released 2:1", "finished"]),
    (WHOLE, [("a", Column(0))], ("a",), None, "release-violation", ["a open", "a +12", "a free12"], [*CLAIMED, "emitted 2:1", "released 1:1", "handed_off 2:1", "released 2:1", "ownership contract violation: attempted to release the consumer for live claim 1 while that claim still referenced it"]),
    (WHOLE, [("a", Column(0))], ("a",), None, "shrink-violation", ["a open", "a +12", "a free12"], [*CLAIMED, "emitted 2:1", "released 1:1", "handed_off 2:1", "released 2:1", "ownership contract violation: attempted to shrink 1 bytes from the consumer for live claim 1 while that claim still referenced it"]),
    ([True, False, True], [PLUS], (), None, "finished", [], [*START, "Compute error: unsupported data type: expected Int32 input for arithmetic at column 0, got Boolean"]),
]


@pytest.mark.parametrize("number", range(len(CHECKPOINTS)))
def test_checkpoints(number):
    values, outputs, claimed, limit, terminal, admission, runtime = CHECKPOINTS[number]
    found = LocalRun({"a": values}, outputs, claimed, limit).run(terminal)
    assert short(found) == (admission, runtime)
    assert all(e["origin"]["query"] == "local-query" for e in found["runtime_events"] if "origin" in e)


def test_admission_rules():
    a = Admission(10)
    x, y = a.open("x", "projection_output"), a.open("y", "filter_output")
    x.reserve(6)
    with pytest.raises(EngineError):
        y.reserve(5)
    assert y.held == 0
    x.shrink(2)
    y.reserve(5)
    with pytest.raises(OwnershipViolation):
        x.shrink(9)
    with pytest.raises(InvalidInput):
        a.open("z", "other")
