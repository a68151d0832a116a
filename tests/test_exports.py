"""Inference rows from public question files, and option candidates from them."""

import json

import pytest

from tessella.operators import exports
from tessella.sources import json as sources


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    data = [
        {"videos": ["20230707_1_CN1_T1_cam.mp4"], "event_phase": [{"labels": ["4"], "conversations": [{"id": "q1", "question": "What is the action taken by vehicle?", "a": "x", "b": "y"}, {"id": "q2", "question": "What is near?", "a": "x", "b": "y"}]}]},
        {"videos": ["20230707_2_normal_T2_cam.mp4"], "event_phase": [{"labels": ["Recognition"], "conversations": [{"id": "q3", "question": "Is the vehicle in the field of view?", "a": "x", "b": "y"}]}]},
        {"videos": [], "conversations": [{"id": "q4", "question": "What is the weather?", "a": "x", "b": "y"}]},
    ]
    path = tmp_path_factory.mktemp("q") / "q.json"
    path.write_text(json.dumps(data))
    return sources.items(sources.documents(spark, str(path)))


def test_scopes_and_scenarios(rows):
    strict = {r.id: (r.scope, r.scenario_id) for r in exports.scoped_items(rows).collect()}
    assert strict == {"q1": ("vehicle_view", "20230707_1_CN1_T1"), "q2": ("vehicle_view", "20230707_1_CN1_T1"), "q3": ("overhead_view", "20230707_2_normal_T2"), "q4": ("environment", "item_00002")}
    loose = {r.id: r.scope for r in exports.scoped_items(rows, strict=False).collect()}
    assert loose["q3"] == "vehicle_view"


def test_inference_rows_become_candidates(spark, rows):
    made = exports.inference_rows(exports.scoped_items(rows))
    by_id = {r.id: r for r in made.collect()}
    assert by_id["q3"].metadata["scenario_type"] == "normal_trimmed" and by_id["q3"].metadata["phase"] == "1" and "phase" not in by_id["q4"].metadata
    assert by_id["q1"].instruction.count("<video>") == 1 and by_id["q1"].output == "a"
    found = {r.id: r.options for r in exports.option_candidates(made, "direct").collect()}
    assert found == dict.fromkeys(("q1", "q2", "q3", "q4"), {"a": "x", "b": "y"})
    with pytest.raises(Exception, match="two rows for q"):
        exports.option_candidates(made.unionByName(made)).collect()
