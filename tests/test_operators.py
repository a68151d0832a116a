"""Behaviour of the operators on small fixtures."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.functions import text
from tessella.functions.boxes import half_even
from tessella.functions.classify import fact_key, question_type
from tessella.operators import captions as cap
from tessella.operators import facts, joins, metrics, prompts, repair, scores, selection, tracks, validate, votes


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first().x


VOTES = [("1", "m1", "b"), ("1", "m2", "a"), ("2", "m1", "c"), ("2", "m2", "c"), ("3", "m1", "a"), ("3", "m2", "b")]


def test_vote_ties_go_to_the_fallback_then_the_smallest_letter(spark):
    v = table(spark, VOTES, "id string, source string, letter string")
    f = table(spark, [("1", "b"), ("2", "a"), ("3", "d")], "id string, letter string")
    assert got(votes.vote(v, f), "id", "letter") == [("1", "b"), ("2", "c"), ("3", "a")]


def test_vote_does_not_depend_on_partitions(spark):
    rows = [(str(i % 40), f"m{random.Random(i).randint(1, 5)}", random.Random(i + 1).choice("abcd")) for i in range(400)]
    f = table(spark, [(str(i), "a") for i in range(40)], "id string, letter string")
    v = table(spark, rows, "id string, source string, letter string")
    assert got(votes.vote(v.repartition(1), f), "id", "letter") == got(votes.vote(v.repartition(8), f), "id", "letter")


def test_strict_vote_names_a_missing_id(spark):
    v = table(spark, VOTES[:-1], "id string, source string, letter string")
    with pytest.raises(ValueError, match="m2 has no vote on id 3"):
        votes.strict_vote(v, table(spark, [("1", "a"), ("3", "a")], "id string, letter string"), ["m1", "m2"])


def test_routed_vote_takes_the_first_of_the_route_on_a_tie(spark):
    v = table(spark, [("1", "x", "b"), ("1", "y", "a"), ("2", "z", "e"), ("3", "x", "q")], "id string, source string, letter string")
    q = table(spark, [("1", "t"), ("2", "t"), ("3", "t")], "id string, question_type string")
    assert got(votes.routed_vote(v, {"t": ("y", "x")}, {"x": 100, "y": 100}, "z", q), "id", "letter") == [("1", "a"), ("2", "e"), ("3", None)]


def test_self_consistency_prefers_the_largest_letter_and_needs_a_lead(spark):
    v = table(spark, [("1", f"s{i}", x) for i, x in enumerate("ccccccccdd")] + [("2", f"s{i}", x) for i, x in enumerate("aaaabbbb")], "id string, source string, letter string")
    f = table(spark, [("1", "a"), ("2", "e")], "id string, letter string")
    assert got(votes.self_consistency(v, f), "id", "letter", "votes", "margin") == [("1", "c", 8, 6), ("2", "e", 4, 0)]


def _questions(spark, answers, question="What is the weather?", scope="environment"):
    n = len(answers)
    q = table(spark, [(str(i), i, "s", scope, None, question, {x: x for x in "abcd"}) for i in range(n)], "id string, ord long, scenario_id string, scope string, phase string, question string, options map<string,string>")
    return q, table(spark, [(str(i), a) for i, a in enumerate(answers)], "id string, letter string")


def test_stable_answers_follow_the_majority(spark):
    assert got(repair.consistent_answers(*_questions(spark, "bbbd")), "id", "old", "new") == [("3", "d", "b")]


def test_dynamic_questions_and_weak_majorities_are_left_alone(spark):
    assert got(repair.consistent_answers(*_questions(spark, "bbbd", "What is the pedestrian's speed?", "overhead_view")), "id") == []
    assert got(repair.consistent_answers(*_questions(spark, "bbd")), "id") == []


def test_a_change_budget_counts_in_order(spark):
    assert got(repair.consistent_answers(*_questions(spark, "bbbbbbdd"), max_changes=1), "id") == [("6",)]


def test_text_repair_finds_the_option_by_its_text(spark):
    options = [{"a": "Grey", "b": "red"}, {"a": "red", "b": "gray."}, {"a": "red", "b": "blue", "c": "GRAY"}, {"a": "gray", "b": "red"}]
    q = table(spark, [(str(i), i, "s", "environment", "What color is the clothing?", o) for i, o in enumerate(options)], "id string, ord long, scenario_id string, scope string, question string, options map<string,string>")
    a = table(spark, [("0", "a"), ("1", "b"), ("2", "c"), ("3", "b")], "id string, letter string")
    assert got(repair.consistent_texts(q, a), "id", "old", "new") == [("3", "b", "a")]


def test_hard_negatives_break_ties_by_letter_and_skip_broken_scores(spark):
    s = table(spark, [("1", "a", 1.0), ("1", "b", 2.0), ("1", "c", 2.0), ("2", "a", float("nan")), ("2", "b", 1.0), ("3", "a", 1.0), ("3", "b", 1.0)], "id string, letter string, score double")
    c = table(spark, [("1", "a"), ("2", "a"), ("3", "b"), ("4", "a")], "id string, correct string")
    assert got(scores.hard_negatives(s, c), "id", "rejected", "predicted", "gold_margin") == [("1", "b", "b", -1.0), ("3", "a", "a", 0.0)]
    assert got(scores.invalid_scores(s, c), "id", "reason") == [("2", "non-finite score"), ("4", "missing scores")]


def test_combined_scores_fall_back(spark):
    s = table(spark, [("1", "m", "a", 1.0), ("1", "m", "b", 3.0), ("2", "m", "a", 1.0)], "id string, source string, letter string, score double")
    options = table(spark, [(i, x) for i in "123" for x in "ab"], "id string, letter string")
    out = scores.combined(s, {"m": 1.0}, options, table(spark, [("2", "b")], "id string, letter string"))
    assert got(out, "id", "letter", "origin") == [("1", "b", "scores"), ("2", "b", "fallback"), ("3", "a", "default_first_option")]
    with pytest.raises(ValueError):
        scores.combined(s, {"m": 0.0}, options)


def _greedy(rows, total, outer, inner):
    out, by_outer, by_inner = [], {}, {}
    for r in rows:
        if len(out) >= total:
            break
        o, p = r[1], (r[1], r[2])
        if by_outer.get(o, 0) >= outer.get(o, 10**9) or by_inner.get(p, 0) >= inner.get(p, 10**9):
            continue
        out.append(r)
        by_outer[o] = by_outer.get(o, 0) + 1
        by_inner[p] = by_inner.get(p, 0) + 1
    return out


def test_nested_caps_equal_a_greedy_walk(spark):
    rng = random.Random(3)
    for _ in range(3):
        rows = [(i, rng.choice("xy"), rng.choice("123")) for i in range(60)]
        outer, inner = {"x": rng.randint(3, 15)}, {("x", "1"): rng.randint(0, 4), ("y", "2"): 2}
        total = rng.randint(5, 40)
        found = selection.nested_caps(table(spark, rows, "n long, role string, phase string"), ["n"], "role", "phase", total, outer, inner)
        assert got(found, "n", "role", "phase") == sorted(_greedy(rows, total, outer, inner), key=repr)


def test_round_robin_takes_turns(spark):
    rows = table(spark, [(1, "b"), (2, "a"), (3, "a"), (4, "a"), (5, "b")], "n long, g string")
    assert [r.n for r in selection.round_robin(rows, ["g"], ["n"], 2, 3).orderBy("turn", "g").collect()] == [2, 1, 3]


def test_letters_are_remapped_in_turn_over_many_partitions(spark):
    rows = spark.range(30).withColumnRenamed("id", "n")
    found = selection.balanced_letters(rows, ["n"], "abc").orderBy("n").collect()
    assert [(r.chosen, r.refused) for r in found[:7]] == [("a", "b"), ("a", "c"), ("b", "a"), ("b", "c"), ("c", "a"), ("c", "b"), ("a", "b")]


def test_fallback_margin(spark):
    rows = table(spark, [("k", "base", 1.0), ("k", "x", 2.9), ("l", "base", 1.0), ("l", "x", 3.0), ("l", "y", 3.0)], "k string, source string, score double")
    assert got(selection.best_over_fallback(rows, ["k"], "score", "source", "base", 2.0), "k", "source") == [("k", "base"), ("l", "x")]


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_numbers_are_gapless_and_in_order(spark, adaptive):
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.shuffle.partitions", "11")
        rows = spark.range(0, 200_000, 1, 9).select((F.col("id") * 7919 % 200_003).alias("n"), F.md5(F.col("id").cast("string").cast("binary")).alias("payload"))
        out = selection.numbered(rows, ["n"])
        told = out.withColumn("wanted", F.row_number().over(Window.orderBy("n"))).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("place").alias("places"), F.count_if(F.col("place") != F.col("wanted")).alias("wrong"), F.countDistinct("payload").alias("payloads")).first()
        assert tuple(told) == (200_000, 200_000, 0, 200_000)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_positional_join_checks_lengths(spark):
    left, right = table(spark, [(0, "a"), (1, "b")], "ord long, x string"), table(spark, [(0, "p")], "ord long, y string")
    with pytest.raises(ValueError, match="2 rows meet 1"):
        joins.zipped(left, right)
    with pytest.raises(ValueError, match="no partner"):
        joins.strict(left, right, ["ord"])


def test_first_other_value(spark):
    rows = table(spark, [("g", 0, "x"), ("g", 1, "x"), ("g", 2, "y"), ("h", 0, "z")], "g string, ord long, v string")
    assert got(joins.first_other(rows, ["g"], "ord", "v"), "g", "ord", "other") == [("g", 0, "y"), ("g", 1, "y"), ("g", 2, "x"), ("h", 0, None)]


def test_retrieval_looks_in_the_best_bucket_first(spark):
    q = table(spark, [("q", "1", "v", "s1")], "query_id string, q_phase string, q_view string, q_scenario_id string")
    bank = table(spark, [("a", "1", "v", "s1"), ("b", "1", "v", "s2"), ("c", "1", "w", "s3"), ("d", "2", "v", "s4"), ("e", "1", "w", "s5")], "style_id string, phase string, view string, scenario_id string")
    score = F.when(F.col("q_phase") == F.col("phase"), 100).otherwise(0) + F.when(F.col("q_view") == F.col("view"), 30).otherwise(0)
    out = joins.retrieve(q, bank, 2, score, (("phase", "view"), ("phase",), ()), "scenario_id")
    assert got(out, "rank", "style_id") == [(1, "b"), (2, "c")]


def test_letters_out_of_text(spark):
    for given, wanted in (("The answer is (C).", "c"), ("b) because", "b"), ("none", "a"), ("", "a"), (None, "a"), ("an eagle: d", "d")):
        assert one(spark, text.letter(F.lit(given).cast("string"))) == wanted


def test_salvage_of_captions(spark):
    def pair(given):
        p, v = text.caption_pair(F.lit(given))
        return tuple(spark.range(1).select(p, v).first())

    assert pair('x {"caption_pedestrian": "P.", "caption_vehicle": "V."} y') == ("P.", "V.")
    assert pair('"caption_pedestrian": "He walks.", "caption_vehicle": "It turns."}') == ("He walks.", "It turns.")
    assert pair("He walks. Vehicle: It turns.") == ("He walks.", "It turns.")
    assert pair("only this") == ("only this", "only this")


def test_endings(spark):
    for given, wanted in (("Done.", "Done."), ("He stood. He looked at the", "He stood."), ("He stood", "He stood."), ("with the", "with the."), ("", "")):
        assert one(spark, text.repaired_ending(F.lit(given))) == wanted


def test_rounding_is_half_to_even(spark):
    for given, wanted in ((2.5, 2), (3.5, 4), (0.5, 0), (1.4999, 1), (-0.5, 0), (-1.5, -2)):
        assert one(spark, half_even(F.lit(given))) == wanted


def test_questions_are_classified_in_order(spark):
    def kind(q, scope):
        return one(spark, question_type(F.lit(q), F.lit(scope)))

    assert kind("Is the person wearing a hat?", "environment") == "pedestrian_attribute"
    assert kind("What is that?", "environment") == "environment_other"
    assert kind("Is he in the vehicle's field of view?", "vehicle_view") == "vehicle_fov"
    assert one(spark, fact_key(F.lit("Who is there?"), F.lit("overhead_view"))) == "overhead_view.who_is_there"


def test_prompts_read_back(spark):
    options = F.create_map(F.lit("a"), F.lit("yes"), F.lit("b"), F.lit("no $1"))
    prompt = prompts.vqa_prompt(F.lit("environment"), F.lit("main"), F.lit(None).cast("string"), F.lit("Is it wet?"), options, F.lit(2))
    row = spark.range(1).select(prompt.alias("p")).select("p", prompts.parsed_question(F.col("p")).alias("q"), prompts.parsed_options(F.col("p")).alias("o")).first()
    assert row.q == "Is it wet?" and row.o == {"a": "yes", "b": "no $1"} and row.p.count("<video>") == 2 and "Scenario-level" in row.p
    with pytest.raises(Exception, match="differ in number"):
        one(spark, prompts.images_for_videos(F.lit("a <video> b"), F.lit(2)))


def test_facts_go_before_the_marker_once(spark):
    rows = table(spark, [("s", "1", "Look. Return JSON with exactly these keys: x. Return JSON with exactly these keys: y"), ("t", "1", "Look.")], "scenario_id string, phase string, instruction string")
    known = table(spark, [("s", None, "environment.weather", "sunny"), ("s", "1", "vehicle.speed", "5 km/h"), ("s", "2", "vehicle.speed", "9 km/h")], "scenario_id string, phase string, key string, value string")
    out = {r.scenario_id: r for r in facts.with_facts(rows, known).collect()}
    assert out["s"].instruction.count("vehicle.speed: 5 km/h") == 1 and "9 km/h" not in out["s"].instruction
    assert out["s"].instruction.index("sunny") < out["s"].instruction.index("Return JSON")
    assert out["s"].fact_conditioned and not out["t"].fact_conditioned and out["t"].instruction == "Look."


def test_a_caption_that_fits_the_facts_beats_the_fallback(spark):
    rows = [("base", "s", "1", "A pedestrian in his 60s.", "It moves."), ("good", "s", "1", "A pedestrian in his 20s.", "It moves at 5 km/h.")]
    c = table(spark, rows, "source string, scenario_id string, phase string, caption_pedestrian string, caption_vehicle string")
    f = table(spark, [("s", None, "pedestrian.age_group", "20s"), ("s", "1", "vehicle.speed", "5 km/h")], "scenario_id string, phase string, key string, value string")
    assert got(cap.fuse_captions(c, f, "base", 10, 2.0), "source") == [("good",)]


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
        row = new
    return row[-1]


def test_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 90))] for _ in range(2))
        assert metrics.lcs_length(a, b) == _lcs(a, b)


def test_metrics_of_equal_texts_are_one(spark):
    pairs = table(spark, [(1, "the cat sat on the mat", "the cat sat on the mat"), (2, "a dog ran far away today", "a dog ran far away today")], "pair long, candidate string, reference string")
    row = metrics.caption_metrics(pairs).first()
    assert all(abs(row[x] - 1) < 1e-9 for x in ("bleu", "meteor", "rouge", "cider"))
    none = metrics.caption_metrics(pairs.where("false")).first()
    assert none.bleu == none.rouge == none.cider == 0.0


def test_nearest_frame_equals_a_scan(spark):
    rng = random.Random(2)
    frames = [(t, rng.randint(0, 3000), i) for t in ("a", "b") for i in range(60)]
    asked = [(t, rng.randint(-50, 3200)) for t in ("a", "b", "c") for _ in range(30)]
    out = tracks.nearest_frame(table(spark, frames, "track string, image_id long, ord long"), table(spark, asked, "track string, frame long").distinct(), ["track"])
    for r in out.collect():
        best = min(((abs(i - r.frame), o, i) for t, i, o in frames if t == r.track), default=(0, 0, None))
        assert r.image_id == best[2]


def test_validation_lists_errors(spark):
    rows = table(spark, [(0, "1", "a"), (1, "1", "B"), (2, " ", "f"), (3, "2", None)], "ord long, id string, correct string")
    found = got(validate.answer_errors(rows), "ord", "error")
    assert found[:3] == [(1, "duplicate id"), (2, "correct must be one of a/b/c/d/e"), (2, "missing id")]


def test_sentences_go_into_slot_order_with_missing_facts(spark):
    from tessella.operators.slots import rewrite_slots

    rows = table(spark, [("s", "1", "The weather was sunny. He was walking. He noticed the vehicle.", "It stopped.")], "scenario_id string, phase string, caption_pedestrian string, caption_vehicle string")
    known = table(spark, [("s", "1", "pedestrian.distance_to_vehicle", "Near"), ("s", None, "environment.weather", "sunny")], "scenario_id string, phase string, key string, value string")
    ordered = rewrite_slots(rows, known, "reorder").first()
    assert ordered.caption_pedestrian == "He noticed the vehicle. He was walking. The weather was sunny."
    filled = rewrite_slots(rows, known, "balanced").first()
    assert filled.caption_pedestrian == "The pedestrian at a near distance from the vehicle. He noticed the vehicle. He was walking. The weather was sunny."
    assert filled.caption_vehicle == "It stopped. For the environment, The weather was sunny, and the brightness of the surroundings was unknown."
    made = rewrite_slots(rows, known, "template").first()
    assert made.caption_pedestrian.startswith("The pedestrian at a near distance")


def test_a_rewrite_with_little_in_common_stays_out(spark):
    from tessella.operators.slots import rerank_slots

    rows = [("base", "s", 0, "1", "He was walking near the road today.", "The vehicle stopped near him."), ("new", "s", 0, "1", "Entirely other words here now.", "Nothing alike at all.")]
    c = table(spark, rows, "source string, scenario_id string, row_idx int, phase string, caption_pedestrian string, caption_vehicle string")
    f = table(spark, [("s", None, "x", "alike")], "scenario_id string, phase string, key string, value string")
    assert rerank_slots(c, f, "base").collect() == []


def test_the_ranker_learns_which_source_is_better(spark):
    from tessella.operators import ranker

    rows = []
    for i in range(6):
        rows += [("base", f"s{i}", 0, "1", "A pedestrian walks and", "A vehicle"), ("good", f"s{i}", 0, "1", f"A pedestrian walks over road {i}.", "A vehicle waits.")]
    c = table(spark, rows, "source string, scenario_id string, row_idx int, phase string, caption_pedestrian string, caption_vehicle string")
    seen = ranker.features(c, "base", ("base", "good"))
    target = ranker.target_scores(c, c.where("source = 'good'"))
    weights = ranker.train_ranker(seen.join(target, ["source", "scenario_id", "row_idx"]))
    assert {r.source for r in ranker.apply_ranker(seen, weights, "base").collect()} == {"good"}


def test_media_policy_comes_after_the_clips(spark):
    from tessella.operators import exports

    manifest = table(spark, [("s", "overhead_view", "1", 1, "c2"), ("s", "overhead_view", "1", 0, "c1")], "scenario_id string, view string, phase string, ord long, clip_path string")
    videos = table(spark, [("s", "overhead_view", ["v"])], "scenario_id string, view string, videos array<string>")
    phases = table(spark, [("train", "s", "main", "overhead_view", p, "P", "V") for p in "12"], "split string, scenario_id string, scenario_type string, view string, phase string, caption_pedestrian string, caption_vehicle string")
    out = exports.caption_rows(phases, exports.clip_map(manifest), videos, "first")
    assert sorted(r.videos[0] for r in out.collect()) == ["c1", "v"] and all(r.instruction.count("<video>") == 1 for r in out.collect())


def test_prompt_variants_keep_question_options_and_videos(spark):
    options = F.create_map(F.lit("a"), F.lit("yes"), F.lit("b"), F.lit("no"))
    prompt = prompts.vqa_prompt(F.lit("overhead_view"), F.lit("main"), F.lit("1"), F.lit("Is it wet?"), options, F.lit(2))
    made = one(spark, prompts.prompt_variant(prompt, "evidence"))
    assert made.startswith("Choose the answer") and made.count("<video>") == 2 and "Scope: overhead_view" in made and "b. no" in made and "safety visual" not in made
    with pytest.raises(Exception, match="lost the question"):
        one(spark, prompts.prompt_variant(F.lit("no question"), "direct"))


def test_spoilt_captions(spark):
    given = F.lit("One is male. Two here. The weather is fine. Four.")
    assert one(spark, text.shuffled_sentences(given)) == "Two here. Four. One is male. The weather is fine."
    assert one(spark, text.first_sentences(given, 2)) == "One is male. Two here."
    assert one(spark, text.without_context(given)) == "One is male. Two here. Four."
    wrong = text.contradicted({"p": F.lit("A Male, a male."), "v": F.lit("Far off.")})
    assert (one(spark, wrong["p"]), one(spark, wrong["v"])) == ("A female, a male.", "Far off.")
    assert one(spark, text.contradicted({"p": F.lit("None.")})["p"]) == "None. The pedestrian was in his 70s."


def test_a_wrong_age_takes_the_fallback(spark):
    schema = "scenario_id string, row_idx int, phase string, caption_pedestrian string, caption_vehicle string"
    rows = table(spark, [("s", 0, "1", "A man in his 60s.", "V."), ("s", 1, "2", "A man in his 20s.", "V.")], schema)
    base = table(spark, [("s", 0, "1", "Base.", "B."), ("s", 1, "2", "Base.", "B.")], schema)
    known = table(spark, [("s", None, "pedestrian.age_group", "20s")], "scenario_id string, phase string, key string, value string")
    assert got(cap.repair_consistency(rows, base, known), "row_idx", "caption_pedestrian", "penalty") == [(0, "Base.", -2.5), (1, "A man in his 20s.", 0.0)]


def test_oracle_predictions_are_perfect_and_missing_ones_count(spark):
    from tessella.operators import evaluation

    schema = "scenario_id string, view string, phase string, caption_pedestrian string, caption_vehicle string"
    rows = [("s", "overhead_view", "1", "the man walks over the wide road", "the red car stops near the man"), ("s", "vehicle_view", "1", "other", "other"), ("t", "vehicle_view", "2", "a girl runs past the old shop", "a bus turns left at the light")]
    phases = table(spark, rows, schema)
    whole = evaluation.evaluate_captions(phases, evaluation.preferred_captions(phases)).first()
    assert abs(whole.bleu - 1) < 1e-9 and abs(whole.rouge - 1) < 1e-9 and whole.missing == 0
    part = evaluation.evaluate_captions(phases, phases.where("scenario_id = 's' and view = 'overhead_view'")).first()
    assert part.missing == 1 and abs(part.rouge - 0.5) < 1e-9
    q = table(spark, [("1", "a"), ("2", "b")], "id string, correct string")
    assert evaluation.evaluate_answers(q, evaluation.gold_answers(q)).first().accuracy == 1.0
    assert evaluation.evaluate_answers(q, evaluation.gold_answers(q).where("id = '1'")).first().accuracy == 0.5


def test_overlay_and_crop_filters(spark):
    rows = [("s", "vehicle", "v", i, i, 10.0 * i, 5.0, 20.0, 30.0) for i in range(4)] + [("s", "pedestrian", "p", 0, 9, 1.0, 1.0, 0.5, 9.0), ("s", "pedestrian", "q", 0, 10, 2.0, 2.0, 8.0, 8.0)]
    df = table(spark, rows, "scenario_id string, role string, track string, image_id long, ord long, x double, y double, w double, h double")
    made = tracks.overlay_filters(df, ["scenario_id"]).first().overlay.split(",")
    assert made[0] == "drawbox=x=2:y=2:w=8:h=8:color=yellow@0.95:t=3" and made[5] == "drawbox=x=20:y=5:w=20:h=30:color=dodgerblue@0.95:t=4"
    assert made[7] == "drawbox=x=0:y=5:w=50:h=30:color=white@0.35:t=2" and len(made) == 8
    assert one(spark, tracks.crop_filter(F.lit(96), F.lit(4), F.lit(2), 64)).startswith("crop=96:96:4:2,scale=64:64")
    assert one(spark, tracks.frame_time(F.lit(0.6), "one_sec")) == 0.3


def test_rules_name_sources_that_may_be_missing(spark):
    rules = {"default": ["b?", "c?"], "types": {"w": {"inputs": ["a", "x?"], "fallback": "b"}, "v": ["x"], "u": "a", "t": ["x?"]}}
    assert votes.resolved_rule(rules, "other", ["a", "b"], "a") == (["b"], "a")
    assert votes.resolved_rule(rules, "w", ["a", "b"], "a") == (["a"], "b")
    assert votes.resolved_rule(rules, "t", ["a", "b"], "a") == (["a"], "a")
    assert votes.resolved_rule({}, "t", ["a", "b"], "b") == (["b"], "b")
    for kind in "vu":
        with pytest.raises(ValueError):
            votes.resolved_rule(rules, kind, ["a", "b"], "a")
    cast = table(spark, [("1", "a", "c"), ("1", "b", "d"), ("2", "a", "a")], "id string, source string, letter string")
    asked = table(spark, [("1", "t"), ("2", "other"), ("3", "t")], "id string, question_type string")
    with pytest.raises(ValueError):
        votes.ruled_vote(cast, rules, ["a", "b"], asked)
    out = votes.ruled_vote(cast, rules, ["a", "b"], asked.where("id < '3'")).collect()
    assert sorted(map(tuple, out)) == [("1", "c", 1), ("2", "a", 0)]


def test_options_block_has_to_be_there(spark):
    row = spark.createDataFrame([("Question: q\nOptions:\na. $1\nb. x\n\nReturn only the letter.", {"a": "x\\1", "b": "$1"})], "p string, o map<string, string>")
    assert row.select(prompts.replaced_options(F.col("p"), F.col("o"))).first()[0] == "Question: q\nOptions:\na. x\\1\nb. $1\n\nReturn only the letter."
    with pytest.raises(Exception, match="no options block"):
        row.select(prompts.replaced_options(F.lit("Options: none"), F.col("o"))).collect()


def test_no_dispute_gives_the_first_questions(spark):
    cast = table(spark, [("1", "a", "c"), ("1", "b", ""), ("2", "a", "a")], "id string, source string, letter string")
    asked = table(spark, [("1", 5), ("2", 3), ("3", 9)], "id string, ord int")
    assert [r.id for r in votes.first_disputed(cast, asked, 2).orderBy("ord").collect()] == ["2", "1"]
    more = cast.unionByName(table(spark, [("1", "c", "d")], "id string, source string, letter string"))
    assert [r.id for r in votes.first_disputed(more, asked, 2).collect()] == ["1"]


def test_examples_are_scored_by_phase_view_type_and_boxes(spark):
    from tessella.functions.boxes import example_score

    box = "struct<cx: double, cy: double, area: double>"
    rows = spark.createDataFrame([("1", "v", "m", (0.0, 0.0, 0.0), None, "1", "x", "m", (450.0, 0.0, 0.0), (1.0, 1.0, 1.0))], f"p string, v string, t string, a {box}, b {box}, p2 string, v2 string, t2 string, a2 {box}, b2 {box}")
    names = ("phase", "view", "scenario_type", "pedestrian", "vehicle")
    left, right = (dict(zip(names, (F.col(c + end) for c in "pvtab"))) for end in ("", "2"))
    assert rows.select(example_score(left, right)).first()[0] == 100 + 12 + 5


def test_registry_backup_and_checked_submission(spark, tmp_path):
    from tessella.sources.sinks import merge_registry, write_submission

    path = tmp_path / "info.json"
    merge_registry(str(path), {"a": {"x": 1}}, backup="bak")
    merge_registry(str(path), {"b": {}}, backup="bak")
    kept = list(tmp_path.glob("info.json.bak_*"))
    assert len(kept) == 1 and '"b"' not in kept[0].read_text() and '"b"' in path.read_text()
    errors = spark.createDataFrame([(1, "missing id")], "ord int, error string")
    with pytest.raises(ValueError, match="missing id"):
        write_submission(str(path), str(path), str(tmp_path / "s.zip"), [errors])
    write_submission(str(path), str(path), str(tmp_path / "s.zip"), [errors.where("false")])
    assert (tmp_path / "s.zip").exists()
