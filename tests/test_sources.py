"""Sources keep order and read every container; sinks write what is read back."""

import json

import pytest

from tessella.sources import json as sources
from tessella.sources import sinks


def put(folder, name, value):
    path = folder / name
    path.write_text(value if isinstance(value, str) else json.dumps(value), encoding="utf-8")
    return str(path)


def test_lines_keep_their_order_and_skip_blanks(spark, tmp_path):
    path = put(tmp_path, "x.jsonl", '{"a": 1}\n\n  \n{"a": 2}\n{"a": 3}\n')
    rows = sources.json_lines(sources.documents(spark, path), "a long").orderBy("ord").collect()
    assert [(r.ord, r.a) for r in rows] == [(0, 1), (1, 2), (2, 3)]


def test_predictions_in_every_container(spark, tmp_path):
    listed = put(tmp_path, "a.json", ["x", {"prediction": "y"}, {"messages": [{"content": "m"}, {"content": "z"}]}])
    wrapped = put(tmp_path, "b.json", {"predictions": [{"text": "p", "predict": "q"}]})
    lines = put(tmp_path, "c.jsonl", '{"response": "r"}\n"s"\n{"other": 1}\n')

    def texts(path):
        return [r.text for r in sources.predictions(sources.documents(spark, path)).orderBy("ord").collect()]

    assert texts(listed) == ["x", "y", "z"]
    assert texts(wrapped) == ["q"]
    assert texts(lines) == ["r", "s", '{"other": 1}']


def test_the_last_answer_to_an_id_wins_and_an_id_is_needed(spark, tmp_path):
    good = put(tmp_path, "a.json", [{"id": "1", "correct": "a"}, {"id": "2", "correct": "B."}, {"id": "1", "correct": "c"}])
    rows = sources.answers(sources.documents(spark, good)).orderBy("ord").collect()
    assert [(r.id, r.letter) for r in rows] == [("1", "c"), ("2", "b")]
    bad = sources.documents(spark, put(tmp_path, "b.json", [{"id": " ", "correct": "a"}]))
    with pytest.raises(Exception, match="no id"):
        sources.answers(bad).collect()
    assert sources.answers(bad, strict=False).collect() == []


def test_items_with_and_without_phases(spark, tmp_path):
    data = [
        {"videos": ["20230707_1_CN1_T1_cam.mp4"], "event_phase": [{"labels": ["Judgment"], "conversations": [{"id": "q1", "question": "What?", "a": "x", "b": " ", "correct": "A"}]}]},
        {"videos": [], "conversations": [{"question": "Wet?", "a": "yes", "b": "no"}]},
    ]
    rows = sources.items(sources.documents(spark, put(tmp_path, "q.json", data))).orderBy("item_ord").collect()
    assert (rows[0].id, rows[0].phase, rows[0].options, rows[0].correct) == ("q1", "2", {"a": "x"}, "a")
    assert (rows[1].id, rows[1].phase, rows[1].options) == ("item_00001_phase_env_q_000", None, {"a": "yes", "b": "no"})


def test_captions_without_labels_take_their_index(spark, tmp_path):
    data = {"s1": [{"labels": ["3"], "caption_pedestrian": " P ", "caption_vehicle": "V"}, {"caption_pedestrian": "Q"}]}
    rows = sources.captions(sources.documents(spark, put(tmp_path, "c.json", data))).orderBy("row_idx").collect()
    assert [(r.phase, r.caption_pedestrian, r.caption_vehicle) for r in rows] == [("3", "P", "V"), ("1", "Q", "")]


def test_scores_replace_errors_and_may_not_repeat(spark, tmp_path):
    path = put(tmp_path, "s.jsonl", '{"vqa_id": "1", "error": "x"}\n{"vqa_id": "1", "scores": {"a": 1.5}}\n{"vqa_id": "2", "error": "y"}\n')
    rows = {r.id: r.scores for r in sources.score_rows(sources.documents(spark, path)).collect()}
    assert rows == {"1": {"a": 1.5}, "2": None}
    twice = put(tmp_path, "t.jsonl", '{"vqa_id": "1", "scores": {"a": 1}}\n{"vqa_id": "1", "scores": {"a": 2}}\n')
    with pytest.raises(Exception, match="two score rows"):
        sources.score_rows(sources.documents(spark, twice)).collect()


def test_index_of_a_folder_tree(spark):
    paths = ["/d/videos/train/s1/overhead_view/b.mp4", "/d/videos/train/s1/overhead_view/a.mp4", "/d/caption/train/s1/overhead_view/c.json", "/d/vqa/val/normal_trimmed/s2/vehicle_view/q.json"]
    rows = {r.scenario_id: r for r in sources.dataset_index(spark.createDataFrame([(p,) for p in paths], "path string"), "/d").collect()}
    assert rows["s1"].videos == {"overhead_view": [paths[1], paths[0]]} and rows["s1"].caption_files == {"overhead_view": paths[2]}
    assert rows["s2"].scenario_type == "normal_trimmed" and rows["s2"].vqa_files == {"vehicle_view": paths[3]}


def test_files_are_listed_without_content(spark, tmp_path):
    put(tmp_path, "a.mp4", "12345")
    put(tmp_path, "b.txt", "1")
    rows = sources.files(spark, str(tmp_path), ".mp4").collect()
    assert [(r.path.rsplit("/", 1)[1], r.length) for r in rows] == [("a.mp4", 5)]


def test_documents_registries_and_archives(spark, tmp_path):
    df = spark.createDataFrame([(1, "é"), (0, "a")], "ord long, x string")
    sinks.write_document(df, str(tmp_path / "out" / "d.json"))
    assert json.loads((tmp_path / "out" / "d.json").read_text("utf-8")) == [{"x": "a"}, {"x": "é"}]
    assert "é" in (tmp_path / "out" / "d.json").read_text("utf-8")
    sinks.merge_registry(str(tmp_path / "r.json"), {"a": {"x": 1}, "b": {}})
    assert sinks.merge_registry(str(tmp_path / "r.json"), {"a": {"x": 2}}) == {"a": {"x": 2}, "b": {}}
    sinks.write_submission(put(tmp_path, "c.json", "{}"), put(tmp_path, "v.json", "[]"), str(tmp_path / "z.zip"))
    import zipfile

    assert sorted(zipfile.ZipFile(tmp_path / "z.zip").namelist()) == ["caption_submission.json", "vqa_submission.json"]


def test_boxes_in_file_order(spark, tmp_path):
    data = {"annotations": [{"image_id": 9, "bbox": [1, 2, 3, 4], "phase_number": "Action"}, {"image_id": 4, "bbox": [3, 2, 3, 4.5], "phase_number": 3}, {"image_id": 5, "bbox": None, "phase_number": "3"}]}
    rows = sources.box_annotations(sources.documents(spark, put(tmp_path, "ped_1.json", data)))
    assert [(r.track, r.phase, r.image_id, r.h) for r in rows.orderBy("ord").collect()] == [("ped_1", "3", 9, 4.0), ("ped_1", "3", 4, 4.5)]
    one = sources.box_summaries(rows).first()
    assert (one["count"], one.first_image, one.last_image, one["mean"]) == (2, 9, 4, [2.0, 2.0, 3.0, 4.25])


def test_zip_members(spark, tmp_path):
    sinks.write_submission(put(tmp_path, "c.json", "{}"), put(tmp_path, "v.json", '[{"id": "1", "correct": "b"}]'), str(tmp_path / "z.zip"))
    rows = sources.answers(sources.zip_members(spark, str(tmp_path / "z.zip"), "vqa_submission.json")).collect()
    assert [(r.id, r.letter) for r in rows] == [("1", "b")]
    assert sources.zip_members(spark, str(tmp_path / "z.zip"), "other").collect() == []
