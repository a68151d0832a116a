"""Text functions, Column to Column."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.fixed import BAD_TAILS, CONTEXT_SENTENCES, FAULT_PATTERNS, PHASE_NUMBERS, PROTECTED_PARTS, PROTECTED_PATTERNS, PROTECTED_TERMS, SWAPS


def blank(text: Column) -> Column:
    """The trimmed text; null is empty."""
    return F.coalesce(F.trim(text), F.lit(""))


def squash(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 in the lower-cased text."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def joined_tokens(text: Column) -> Column:
    """Letters and digits, with one hyphen or apostrophe inside, in the lower-cased text."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[A-Za-z0-9]+(?:[-'][A-Za-z0-9]+)?"), F.lit(0))


def word_count(text: Column) -> Column:
    """Words by Unicode word characters."""
    return F.coalesce(F.regexp_count(text, F.lit(r"(?U)\b\w+\b")), F.lit(0)).cast("long")


def ngrams(words: Column, n: int) -> Column:
    """Joined n-grams of an array of words; empty if it has fewer.

    Shifted copies are zipped, in time linear in the words: a slice for each
    place copies the whole array each time.
    """
    many = F.greatest(F.size(words) - (n - 1), F.lit(0))
    out = F.slice(words, F.lit(1), many)
    for k in range(2, n + 1):
        out = F.zip_with(out, F.slice(words, F.lit(k), many), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(F.size(words) >= n, out).otherwise(F.array().cast("array<string>"))



def up_to_ngrams(words: Column, n: int) -> Column:
    """Joined n-grams of lengths 1 to n."""
    return F.flatten(F.array(*(ngrams(words, k) for k in range(1, n + 1))))


def sentences_kept(text: Column) -> Column:
    """Sentences with their mark, as a scan finds them."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^.!?]+[.!?]?"), F.lit(0))
    # a lambda of one argument: a function that takes two, as F.trim does, is given the place too, as characters to trim
    return F.filter(F.transform(found, lambda s: F.trim(s)), lambda s: s != "")


def sentences_split(text: Column) -> Column:
    """Sentences by white space after a mark."""
    return F.filter(F.transform(F.split(blank(text), r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def sentences_bare(text: Column) -> Column:
    """Lower-cased sentences without their marks."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[.!?]+"), lambda s: F.lower(F.trim(s))), lambda s: s != "")


def repetitive(text: Column) -> Column:
    """Four sentences or more, one of them three times or more: in order, one equals the second after it."""
    parts = F.array_sort(sentences_bare(text))
    return (F.size(parts) >= 4) & F.exists(F.zip_with(parts, F.slice(parts, F.lit(3), F.size(parts)), lambda a, b: a == b), lambda same: F.coalesce(same, F.lit(False)))


def truncated(text: Column, limit: int) -> Column:
    """The text, or its start with an ellipsis if it is longer than limit."""
    return F.when(F.length(text) > limit, F.concat(F.rtrim(F.substring(text, 1, limit - 3)), F.lit("..."))).otherwise(text)


def slug(text: Column) -> Column:
    """Lower-case words joined by underscores, 80 characters at most; a dotted capital I is one letter, as in the SQL."""
    made = F.substring(F.regexp_replace(F.regexp_replace(F.lower(F.translate(text, "İ", "i")), "[^a-z0-9]+", "_"), "^_+|_+$", ""), 1, 80)
    return F.when(made == "", "unknown").otherwise(made)


def lower_first(text: Column) -> Column:
    return F.concat(F.lower(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 30))


def upper_first(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 30))


def holds_any(text: Column, terms: Sequence[str]) -> Column:
    found = F.lit(False)
    for term in terms:
        found = found | F.contains(text, F.lit(term))
    return found


def hits(text: Column, terms: Sequence[str]) -> Column:
    """How many of the terms the text holds."""
    return sum((F.contains(text, F.lit(t)).cast("int") for t in terms[1:]), F.contains(text, F.lit(terms[0])).cast("int"))


def told(named: Iterable[tuple[Column, str]]) -> Column:
    """The names whose conditions hold, in order.

    Compiled as a whole, so that what the conditions share is worked out once:
    with a function of lambdas, as array_compact is one, all below it is interpreted.
    """
    return F.array_remove(F.array(*(F.when(holds, name).otherwise("") for holds, name in named)), "")


def phase_number(label: Column) -> Column:
    """The number of a phase name; other labels pass in lower case."""
    low = F.lower(blank(label))
    number = F.when(F.lit(False), low)
    for name, value in PHASE_NUMBERS.items():
        number = number.when(low == name, value)
    return number.otherwise(low)


# option letters


def letter(text: Column) -> Column:
    """The first a to e that stands alone, else a leading one with a mark, else "a"."""
    low = F.lower(blank(text))
    alone = F.regexp_extract(low, r"(?U)\b([abcde])\b", 1)
    leading = F.regexp_extract(low, r"^\s*([abcde])[\).:\s-]", 1)
    return F.when(alone != "", alone).when(leading != "", leading).otherwise("a")


def letter_strict(text: Column) -> Column:
    """The first character if it is a to e, else empty."""
    first = F.substring(F.lower(blank(text)), 1, 1)
    return F.when(first.isin("a", "b", "c", "d", "e"), first).otherwise("")


def letter_or_empty(text: Column) -> Column:
    """The first a to e that stands alone, else a leading one, else empty."""
    low = F.lower(blank(text))
    alone = F.regexp_extract(low, r"(?U)\b([abcde])\b", 1)
    leading = F.regexp_extract(low, "^([abcde])", 1)
    return F.when(alone != "", alone).otherwise(leading)


# questions and answers


def question_key(question: Column) -> Column:
    """The lower-cased question with single blanks."""
    return F.lower(squash(question))


def answer_key(answer: Column) -> Column:
    """The lower-cased answer with single blanks, "gray" for "grey" and no final period."""
    return F.regexp_replace(F.regexp_replace(F.lower(squash(answer)), "grey", "gray"), r"\s*\.$", "")


# JSON in model output


def json_object(text: Column) -> Column:
    """The text if it is a JSON object, else its part from the first to the last brace if that is one, else null."""
    clean = blank(text)
    inner = F.regexp_extract(clean, r"(?s)\{.*\}", 0)
    whole = F.when(F.substring(clean, 1, 1) == "{", clean)
    return F.coalesce(F.when(F.try_parse_json(whole).isNotNull(), whole), F.when(F.try_parse_json(inner).isNotNull(), inner))


_LABEL = r"""(?i)^\s*[\{\[,]*\s*["']?\s*(?:caption_)?(?:pedestrian|vehicle|caption_pedestrian|caption_vehicle)\s*["']?\s*:\s*["']?"""


def without_label(text: Column) -> Column:
    """The text without a leading caption key and without trailing quotes and braces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), _LABEL, ""), r"""[\s"',}\]]+$""", ""))


def plain_captions(text: Column) -> tuple[Column, Column]:
    """Pedestrian and vehicle caption of a text that isn't JSON: by keys, by "vehicle:", else the text for both."""
    clean = blank(text)
    low = F.lower(clean)
    p, v, m = F.instr(low, "caption_pedestrian"), F.instr(low, "caption_vehicle"), F.instr(low, "vehicle:")
    keyed = (p > 0) & (v > p)
    pedestrian = F.when(keyed, without_label(clean.substr(p, v - p))).when(m > 1, F.trim(clean.substr(F.lit(1), m - 1))).otherwise(clean)
    vehicle = F.when(keyed, without_label(clean.substr(v, F.length(clean)))).when(m > 1, without_label(clean.substr(m, F.length(clean)))).otherwise(clean)
    return pedestrian, vehicle


def caption_pair(text: Column) -> tuple[Column, Column]:
    """Pedestrian and vehicle caption of a prediction, JSON or not."""
    found = json_object(text)
    p, v = blank(F.get_json_object(found, "$.caption_pedestrian")), blank(F.get_json_object(found, "$.caption_vehicle"))
    good = found.isNotNull() & ((p != "") | (v != ""))
    plain_p, plain_v = plain_captions(text)
    return F.when(good, p).otherwise(plain_p), F.when(good, v).otherwise(plain_v)


# completeness


def truncation_reason(text: Column) -> Column:
    """Why a caption isn't complete: empty, or no mark at its end; else empty.

    Open endings are looked for only after a final mark was seen, which none of
    them has, so that they are never the reason here.
    """
    clean = blank(text)
    return F.when(clean == "", "empty").when(~F.substring(clean, -1, 1).isin(".", "!", "?"), "missing_terminal_punctuation").otherwise("")


def repaired_ending(text: Column) -> Column:
    """The caption cut after its last mark if it ends openly, else closed with a period."""
    clean = blank(text)
    low = F.regexp_replace(F.lower(clean), "[ ,;:]+$", "")
    open_ = F.lit(False)
    for tail in BAD_TAILS:
        open_ = open_ | F.endswith(low, F.lit(tail))
    # cut after the last period, else the last "!", else the last "?"
    cut = F.coalesce(*(F.when(F.contains(clean, F.lit(mark)), F.trim(clean.substr(F.lit(1), F.length(clean) - F.instr(F.reverse(clean), mark) + 1))) for mark in (".", "!", "?")))
    closed = F.concat(F.regexp_replace(clean, "[ ,;:]+$", ""), F.lit("."))
    return F.when(truncation_reason(clean) != "missing_terminal_punctuation", clean).when(open_, F.coalesce(cut, closed)).otherwise(closed)


# what a rewrite must keep


def protected_items(text: Column) -> Column:
    """Protected terms and matches of protected patterns in a text, distinct."""
    low = F.lower(F.coalesce(text, F.lit("")))
    # runs of white space match as one blank does
    spaced = F.regexp_replace(low, r"\s+", " ")
    none = F.array().cast("array<string>")
    found = [F.when(F.contains(low, F.lit(part)), F.regexp_extract_all(spaced, F.lit(p), F.lit(0))).otherwise(none) for p, part in zip(PROTECTED_PATTERNS, PROTECTED_PARTS, strict=True)]
    return F.array_distinct(F.concat(told((F.contains(low, F.lit(t)), t) for t in PROTECTED_TERMS), *found))


def faults(text: Column) -> dict[str, Column]:
    """Whether a text has each of the faults that reject it."""
    return {name: F.regexp_like(text, F.lit(pattern)) for name, pattern in FAULT_PATTERNS}


# spoilt captions, as negatives


def shuffled_sentences(text: Column) -> Column:
    """The second, fourth, ... sentences, then the others; a text of two or fewer as it is."""
    parts = sentences_split(text)
    turned = F.concat(F.filter(parts, lambda s, i: i % 2 == 1), F.filter(parts, lambda s, i: i % 2 == 0))
    return F.when(F.size(parts) <= 2, text).otherwise(F.array_join(turned, " "))


def first_sentences(text: Column, count: int) -> Column:
    parts = sentences_split(text)
    return F.when(F.size(parts) > 0, F.array_join(F.slice(parts, 1, count), " ")).otherwise(text)


def without_context(text: Column) -> Column:
    """Sentences that don't speak of the surroundings; the first three if all do."""
    kept = F.filter(sentences_split(text), lambda s: ~holds_any(F.lower(s), CONTEXT_SENTENCES))
    return F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(first_sentences(text, 3))


def replaced_once(text: Column, word: str, new: str) -> Column:
    """The first place of a word, in any case, replaced."""
    at = F.regexp_instr(text, F.lit(rf"(?i)\b{word}\b"))
    return F.when(at > 0, F.concat(text.substr(F.lit(1), at - 1), F.lit(new), text.substr(at + len(word), F.length(text)))).otherwise(text)


def contradicted(texts: dict[str, Column]) -> dict[str, Column]:
    """Captions in which the first known attribute that any of them names is swapped once; else the first caption gets a wrong age."""
    both = F.concat_ws(" ", *texts.values())
    names = list(texts)
    out = {}
    for name, text in texts.items():
        swapped = F.when(F.lit(False), text)
        for word, new in SWAPS:
            swapped = swapped.when(F.regexp_like(both, F.lit(rf"(?i)\b{word}\b")), replaced_once(text, word, new))
        out[name] = swapped.otherwise(F.concat(text, F.lit(" The pedestrian was in his 70s.")) if name == names[0] else text)
    return out


def stable_id(fields: dict[str, Column], length: int = 16) -> Column:
    """The first characters of a SHA-1 over named values, whatever their order: ``name=<characters>:<value>`` by name, ``name=~`` for null."""
    told = [F.concat(F.lit(f"{name}="), F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("~"))) for name, c in sorted(fields.items())]
    return F.substring(F.sha1(F.concat_ws(";", *told).cast("binary")), 1, length)


def path_hash(path: Column, length: int = 16) -> Column:
    """The name under which what was made from a media file is kept."""
    return F.substring(F.sha1(path.cast("binary")), 1, length)


def box_means(text: Column, role: str) -> Column:
    """struct<cx, cy, area> of the mean of a role's ``- role ... mean=[x1, y1, x2, y2]`` lines; null without one of four numbers."""
    found = F.regexp_extract_all(text, F.lit(rf"(?i)-\s+{role}\b.*?mean=\[([0-9,\s]+)\]"), F.lit(1))
    boxes = F.transform(found, lambda x: F.transform(F.filter(F.split(x, ","), lambda v: F.trim(v) != ""), lambda v: F.trim(v).cast("int")))
    boxes = F.filter(boxes, lambda b: F.size(b) == 4)

    def mean(of) -> Column:
        return F.aggregate(boxes, F.lit(0.0), lambda total, b: total + of(b)) / F.size(boxes)

    zero = F.lit(0)
    area = mean(lambda b: (F.greatest(zero, b[2] - b[0]) * F.greatest(zero, b[3] - b[1])).cast("double"))
    return F.when(F.size(boxes) > 0, F.struct(mean(lambda b: (b[0] + b[2]) / 2.0).alias("cx"), mean(lambda b: (b[1] + b[3]) / 2.0).alias("cy"), area.alias("area")))
