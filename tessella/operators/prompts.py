"""Prompts: built from columns, and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.fixed import CAPTION_KEYS_TEXT, CAPTION_SYSTEM, LETTERS, PHASE_NUMBERS, PROMPT_VARIANTS, RETURN_JSON, VQA_SYSTEM
from tessella.functions.text import blank

_NAMES = {number: name for name, number in reversed(PHASE_NUMBERS.items())}


def tags(count: Column) -> Column:
    return F.array_join(F.array_repeat(F.lit("<video>"), count.cast("int")), "\n")


def option_lines(options: Column) -> Column:
    """"letter. text" lines in the order of letters."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(options)), lambda e: F.concat(e["key"], F.lit(". "), e["value"])), "\n")


def _blocks(*parts: Column) -> Column:
    return F.trim(F.concat_ws("\n\n", *parts))


def vqa_prompt(scope: Column, scenario_type: Column, phase: Column, question: Column, options: Column, media: Column, context: Column | None = None) -> Column:
    """The prompt of a multiple-choice question; a null phase is a scenario-level one."""
    head = F.concat(F.lit("Scenario type: "), scenario_type, F.lit("\nScope: "), scope, F.lit("\n"), F.coalesce(F.concat(F.lit("Phase label: "), phase), F.lit("Scenario-level environment question")))
    ask = F.concat(F.lit("Question: "), question, F.lit("\nOptions:\n"), option_lines(options))
    return _blocks(F.lit(VQA_SYSTEM), head, tags(media), F.lit(""), F.coalesce(context, F.lit("")) if context is not None else F.lit(""), ask, F.lit("Return only the correct option letter."))


def caption_prompt(view: Column, scenario_type: Column, phase: Column, media: Column, context: Column | None = None) -> Column:
    """The prompt for captions of a phase."""
    name = F.when(F.lit(False), phase)
    for number, known in _NAMES.items():
        name = name.when(phase == number, known)
    head = F.concat(F.lit("Scenario type: "), scenario_type, F.lit("\nView: "), view, F.lit("\nPhase label: "), phase, F.lit(" ("), name.otherwise(phase), F.lit(")"))
    return _blocks(F.lit(CAPTION_SYSTEM), head, tags(media), F.lit(""), F.coalesce(context, F.lit("")) if context is not None else F.lit(""), F.lit(f"{RETURN_JSON}\n{CAPTION_KEYS_TEXT}"))


def replaced_options(instruction: Column, options: Column) -> Column:
    """The instruction with the lines of its first options block replaced; one without a block is an error."""
    block = r"(?s)^(.*?)Options:\n.*?\n\nReturn only(.*)$"
    new = F.concat(F.regexp_extract(instruction, block, 1), F.lit("Options:\n"), option_lines(options), F.lit("\n\nReturn only"), F.regexp_extract(instruction, block, 2))
    return F.when(instruction.rlike(block), new).otherwise(F.raise_error(F.lit("no options block to replace")).cast("string"))


def remapped(options: Column, correct: Column, rejected: Column, chosen: Column, refused: Column) -> Column:
    """options under new letters: the correct one at ``chosen``, the rejected one at ``refused``, the others in their order at the rest."""
    letters = F.array_sort(F.map_keys(options))
    old = F.concat(F.array(correct, rejected), F.filter(letters, lambda x: (x != correct) & (x != rejected)))
    new = F.concat(F.array(chosen, refused), F.filter(letters, lambda x: (x != chosen) & (x != refused)))
    return F.map_from_arrays(new, F.transform(old, lambda x: F.element_at(options, x)))


def parsed_options(instruction: Column) -> Column:
    """Letter to text, from the lines between "Options:" and "Return only"."""
    block = F.regexp_extract(instruction, r"(?is)(?:^|\n)[ \t]*options:[ \t]*\n(.*?)(?:\n[ \t]*return only|$)", 1)
    letters = F.transform(F.regexp_extract_all(block, F.lit(r"(?m)^\s*([A-Ea-e])\.\s*(.+?)\s*$"), F.lit(1)), F.lower)
    texts = F.regexp_extract_all(block, F.lit(r"(?m)^\s*([A-Ea-e])\.\s*(.+?)\s*$"), F.lit(2))
    return F.map_from_arrays(letters, texts)


def parsed_question(instruction: Column) -> Column:
    """What follows the first "Question:" that opens a line; empty without one."""
    return F.trim(F.regexp_extract(instruction, r"(?im)^[ \t]*question:(.*)$", 1))


def answer_text(letter: Column, options: Column, mode: str = "letter") -> Column:
    """The letter, or "letter. text"."""
    return letter if mode == "letter" else F.trim(F.concat(letter, F.lit(". "), blank(F.try_element_at(options, letter))))


def media_for(videos: Column, policy: str) -> Column:
    """Videos under a policy: all, first or none."""
    if policy not in ("all", "first", "none"):
        raise ValueError(f"media policy {policy}")
    return videos if policy == "all" else F.slice(videos, 1, 1 if policy == "first" else 0)


def images_for_videos(instruction: Column, images: Column) -> Column:
    """The prompt with image tags for video tags; a count that differs from ``images`` is an error."""
    parts = F.split(instruction, "<video>")
    return F.when(F.size(parts) - 1 == images, F.array_join(parts, "<image>")).otherwise(F.raise_error(F.lit("video tags and images differ in number")))


def interleaved(instruction: Column, videos: Column) -> Column:
    """Text and video pieces in turn; a count of tags that differs from the videos is an error."""
    parts = F.split(instruction, "<video>")
    pairs = F.arrays_zip(parts.alias("text"), F.concat(videos, F.array(F.lit(None).cast("string"))).alias("video"))
    return F.when(F.size(parts) - 1 == F.size(videos), pairs).otherwise(F.raise_error(F.lit("video tags and videos differ in number")))


def preference_pairs(questions: DataFrame, policy: str = "all", limit: int = 0, seed: str = "13") -> DataFrame:
    """``id, chosen, rejected``: the correct letter against wrong ones.

    questions: ``id, options, correct``; those whose answer isn't an option
    give nothing.  policy: all, first or random; limit 0 is none.  Random order
    is that of a hash of seed, id and letter, the same in any partitioning.
    """
    rows = questions.where(F.map_contains_key("options", F.col("correct")))
    wrong = F.filter(F.array_sort(F.map_keys("options")), lambda k: k != F.col("correct"))
    if policy == "random":
        wrong = F.transform(F.array_sort(F.transform(wrong, lambda k: F.struct(F.md5(F.concat_ws("|", F.lit(seed), F.col("id"), k).cast("binary")).alias("h"), k.alias("k")))), lambda x: x["k"])
    count = 1 if policy == "first" else limit
    if policy == "random" and not count:
        count = 1
    wrong = F.slice(wrong, 1, count) if count else wrong
    return rows.select("id", F.col("correct").alias("chosen"), F.explode(wrong).alias("rejected"))


def shuffled_options(questions: DataFrame, copies: int, seed: str) -> DataFrame:
    """Each question with its options as they are (copy 0) and in ``copies`` seeded orders, the correct letter moved along."""
    rows = questions.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies))))
    entries = F.array_sort(F.map_entries("options"))
    keyed = F.transform(entries, lambda e: F.struct(F.when(F.col("copy") == 0, F.lit("")).otherwise(F.md5(F.concat_ws("|", F.lit(seed), F.col("id"), F.col("copy").cast("string"), e["key"]).cast("binary"))).alias("h"), e["key"].alias("old"), e["value"].alias("text")))
    order = F.array_sort(keyed)
    letters = F.array(*map(F.lit, LETTERS))
    rows = rows.withColumn("_o", order)
    new = F.map_from_arrays(F.slice(letters, F.lit(1), F.size("_o")), F.transform("_o", lambda x: x["text"]))
    place = F.array_position(F.transform("_o", lambda x: x["old"]), F.col("correct")).cast("int")
    return rows.withColumns({"options": new, "correct": F.get(letters, place - 1)}).drop("_o")


def prompt_variant(instruction: Column, variant: str) -> Column:
    """The prompt under another heading: its scenario lines, each once, then all from the first video or question line.

    A prompt that then lacks its question or options is an error.
    """
    if variant == "base":
        return instruction
    lines = F.split(instruction, "\n")
    opens = F.transform(lines, lambda x: F.contains(x, F.lit("<video>")) | F.startswith(F.trim(x), F.lit("Question:")))
    at = F.array_position(opens, F.lit(True)).cast("int")
    at = F.when(at == 0, F.size(lines) + 1).otherwise(at)
    head, tail = F.slice(lines, F.lit(1), at - 1), F.slice(lines, at, F.size(lines))

    def told(x: Column) -> Column:
        x = F.trim(x)
        return F.regexp_like(x, F.lit("^(Scenario type:|Scope:|Phase label:|View:|Scenario-level)")) | F.endswith(x, F.lit("question"))

    kept = F.array_distinct(F.filter(head, told))
    blank_line = F.array(F.lit(""))
    made = F.trim(F.array_join(F.concat(F.array(*map(F.lit, (*PROMPT_VARIANTS[variant], ""))), kept, F.when(F.size(kept) > 0, blank_line).otherwise(F.slice(blank_line, 1, 0)), tail), "\n"))
    return F.when(F.contains(made, F.lit("Question:")) & F.contains(made, F.lit("Options:")), made).otherwise(F.raise_error(F.lit(f"variant {variant} lost the question or the options")))
