"""Ordered rules that read a question's wording."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.fixed import DYNAMIC_PATTERNS, ENVIRONMENT_FACTS, ENVIRONMENT_TYPES, PHASE_FACTS, PHASE_TYPES, STABLE_PATTERNS
from tessella.functions.text import holds_any, question_key, slug


def question_type(question: Column, scope: Column) -> Column:
    """The type of a question, by the first rule of its scope that matches."""
    q = question_key(question)
    env = F.when(F.lit(False), "")
    for name, terms, words in ENVIRONMENT_TYPES:
        found = holds_any(q, terms)
        for word in words:
            found = found | F.regexp_like(q, F.lit(rf"\b{word}\b"))
        env = env.when(found, name)
    phase = F.when(F.lit(False), "")
    for name, terms in PHASE_TYPES:
        phase = phase.when(holds_any(q, terms), name)
    return F.when(scope == "environment", env.otherwise("environment_other")).otherwise(phase.otherwise("phase_other"))


def fact_key(question: Column, scope: Column) -> Column:
    """The dotted key of the fact that a question asks for; a slug under the scope if no rule matches."""
    q = F.trim(F.lower(F.coalesce(question, F.lit(""))))
    env = F.when(F.lit(False), "")
    for term, key in ENVIRONMENT_FACTS:
        env = env.when(F.contains(q, F.lit(term)), key)
    phase = F.when(F.lit(False), "")
    for terms, key in PHASE_FACTS:
        phase = phase.when(holds_any(q, terms), key)
    return F.when(scope == "environment", env.otherwise(F.concat(F.lit("environment."), slug(q)))).otherwise(phase.otherwise(F.concat(scope, F.lit("."), slug(q))))


def _vehicle_wording(q: Column, loose: bool) -> Column:
    view = F.contains(q, F.lit("field of view" if loose else "vehicle's field of view"))
    others = holds_any(q, ("action taken by vehicle", "position of the vehicle relative", "relative distance of vehicle"))
    return F.contains(q, F.lit("vehicle")) & (view | others) if loose else view | others


def vehicle_scope_loose(question: Column) -> Column:
    """Whether a question shows that its item is seen from the vehicle: any "vehicle" with "field of view" will do."""
    return _vehicle_wording(F.lower(F.coalesce(question, F.lit(""))), True)


def vehicle_scope_strict(question: Column) -> Column:
    """As the loose rule, but only "vehicle's field of view" counts."""
    return _vehicle_wording(F.lower(F.coalesce(question, F.lit(""))), False)


def stable_question(question: Column, type_: Column, stable_types: tuple[str, ...]) -> Column:
    """Whether an answer holds for a whole scenario: a stable type or wording, and no dynamic wording."""
    q = question_key(question)
    return (type_.isin(*stable_types) | holds_any(q, STABLE_PATTERNS)) & ~holds_any(q, DYNAMIC_PATTERNS)
