"""Rows for realising, selecting, segmenting and rewriting."""

import pytest

from tessella.operators import training_rows as rows

SCHEMA = "scenario_id string, scenario_type string, view string, phase string, ord long, caption_pedestrian string, caption_vehicle string"


@pytest.fixture(scope="module")
def phases(spark):
    return spark.createDataFrame([("s", "main", "overhead_view", "1", 0, "A male stands. He waits. The weather is dry.", "It stopped."), ("t", "main", "overhead_view", "1", 1, "A girl runs.", "It turns.")], SCHEMA)


@pytest.fixture(scope="module")
def known(spark):
    return spark.createDataFrame([("s", None, "environment.weather", "dry"), ("s", "1", "vehicle.speed", "5 km/h")], "scenario_id string, phase string, key string, value string")


def test_selector_rows_hold_one_good_and_spoilt_ones(phases, known):
    made = rows.selector_rows(rows.spoilt(phases, 3, contradictions=True, other=True), known, "Judge.").where("scenario_id = 's'").collect()
    assert {r.source: r.output for r in made} == {"gold": "good", "shuffled": "bad", "front_trimmed": "bad", "context_trimmed": "bad", "contradicted": "bad", "wrong_scenario_same_phase": "bad"}
    wrong = next(r for r in made if r.source == "wrong_scenario_same_phase")
    assert "A girl runs." in wrong.instruction and "vehicle.speed: 5 km/h" in wrong.instruction
    assert "A female stands." in next(r for r in made if r.source == "contradicted").instruction


def test_realizer_rows_hold_all_candidates(phases, known):
    made = rows.realizer_rows(rows.spoilt(phases), known, "Write.", phases).where("scenario_id = 's'").collect()
    assert len(made) == 1 and made[0].instruction.count("caption_vehicle: ") == 4 and '"caption_vehicle":"It stopped."' in made[0].output


def test_a_bad_prediction_takes_the_fallback(spark, phases):
    long = " ".join(["word"] * 25) + "."
    guess = spark.createDataFrame([("s", "1", f'{{"caption_pedestrian": "{long}", "caption_vehicle": "{long}"}}'), ("t", "1", '{"caption_pedestrian": "short.", "caption_vehicle": "x"}')], "scenario_id string, phase string, text string")
    out = {r.scenario_id: r for r in rows.realised(guess, phases.select("scenario_id", "phase", "caption_pedestrian", "caption_vehicle")).collect()}
    assert out["s"].used and out["s"].caption_vehicle == long and not out["t"].used and out["t"].caption_vehicle == "It turns."


def test_segment_and_rewrite_rows(phases, known):
    made = rows.segment_rows(phases.where("scenario_id = 's'"), "Segment.").collect()
    assert {(r.role, r.segment): r.output for r in made}["pedestrian", "environment"] == "The weather is dry."
    assert rows.segment_rows(phases.where("scenario_id = 's'"), "Segment.", train=False).count() == 10
    notes = rows.rewrite_rows(phases.where("scenario_id = 's'"), known, "Rewrite.").first()
    assert "The weather is dry." in notes.instruction and "Locked fact context" in notes.instruction and notes.output.startswith('{"caption_pedestrian"')


def test_segments_make_captions_again(spark):
    parts = [("s", "1", "vehicle", "vehicle_view", "action", 0, "It turned."), ("s", "1", "vehicle", "overhead_view", "action", 1, "It stopped."), ("s", "1", "vehicle", "overhead_view", "environment", 2, "The weather was dry.")]
    df = spark.createDataFrame(parts, "scenario_id string, phase string, role string, view string, segment string, ord long, text string")
    assert rows.assembled_segments(df).first().caption == "The weather was dry. It stopped."
