"""The catalogue's queries in SQL."""

from __future__ import annotations

from tessella.functions.fixed import (
    ARTIFACT_TERMS, BAD_TAILS, COLOURS, DYNAMIC_PATTERNS, ENVIRONMENT_FACTS, ENVIRONMENT_TYPES, FAULT_PATTERNS, GATE_POLICIES, PHASE_CUES, PHASE_FACTS, PHASE_TYPES, PRIOR_TYPES,
    PROTECTED_PATTERNS, PROTECTED_TERMS, QUALITY_TERMS, ROUTE_WEIGHTS, ROUTER_MODES, ROUTES, STABLE_PATTERNS, STABLE_TYPES, VQA_SYSTEM,
)
from tessella.plans.views import ANSWERS_SQL, CAPTIONS_SQL, CORRECT_SQL, FACTS_SQL, FALLBACK_SQL, PAIRS_SQL, QUESTIONS_SQL, SOURCES, TRACKS_SQL, VOTES_SQL, scores_sql

Q = lambda x: "'" + x.replace("'", "''") + "'"


def any_of(column: str, terms) -> str:
    return "(" + " OR ".join(f"contains({column}, {Q(t)})" for t in terms) + ")"


def hits(column: str, terms) -> str:
    return "(" + " + ".join(f"contains({column}, {Q(t)})::INT" for t in terms) + ")"


def names(values) -> str:
    return "(" + ", ".join(map(Q, values)) + ")"


QKEY = "lower(trim(regexp_replace(question, '\\s+', ' ', 'g')))"


def type_sql(q: str = QKEY) -> str:
    env = " ".join(f"WHEN {any_of(q, terms)}{''.join(f' OR regexp_matches({q}, {Q(chr(92) + 'b' + w + chr(92) + 'b')})' for w in words)} THEN {Q(name)}" for name, terms, words in ENVIRONMENT_TYPES)
    phase = " ".join(f"WHEN {any_of(q, terms)} THEN {Q(name)}" for name, terms in PHASE_TYPES)
    return f"CASE WHEN scope = 'environment' THEN CASE {env} ELSE 'environment_other' END ELSE CASE {phase} ELSE 'phase_other' END END"


def slug_sql(x: str) -> str:
    return f"(CASE WHEN substr(trim(regexp_replace(lower({x}), '[^a-z0-9]+', '_', 'g'), '_'), 1, 80) = '' THEN 'unknown' ELSE substr(trim(regexp_replace(lower({x}), '[^a-z0-9]+', '_', 'g'), '_'), 1, 80) END)"


def fact_key_sql() -> str:
    q = "trim(lower(question))"
    env = " ".join(f"WHEN contains({q}, {Q(t)}) THEN {Q(k)}" for t, k in ENVIRONMENT_FACTS)
    phase = " ".join(f"WHEN {any_of(q, t)} THEN {Q(k)}" for t, k in PHASE_FACTS)
    return f"CASE WHEN scope = 'environment' THEN CASE {env} ELSE 'environment.' || {slug_sql(q)} END ELSE CASE {phase} ELSE scope || '.' || {slug_sql(q)} END END"


TYPED = f"{QUESTIONS_SQL},\nty AS (SELECT *, {type_sql()} AS question_type, {QKEY} AS question_norm FROM q)"
TOKENS = "regexp_extract_all(lower(text), '[a-z0-9]+')"
LETTER = "CASE WHEN regexp_extract(lower(trim({0})), '\\b([abcde])\\b', 1) <> '' THEN regexp_extract(lower(trim({0})), '\\b([abcde])\\b', 1) WHEN regexp_extract(lower(trim({0})), '^\\s*([abcde])[\\).:\\s-]', 1) <> '' THEN regexp_extract(lower(trim({0})), '^\\s*([abcde])[\\).:\\s-]', 1) ELSE 'a' END"
REASON = "CASE WHEN coalesce(trim({0}), '') = '' THEN 'empty' WHEN right(trim({0}), 1) NOT IN ('.', '!', '?') THEN 'missing_terminal_punctuation' ELSE '' END"
BARE = "list_filter(list_transform(regexp_split_to_array({0}, '[.!?]+'), lambda s: lower(trim(s))), lambda s: s <> '')"
REPETITIVE = f"(len({BARE}) >= 4 AND list_max(list_transform(list_distinct({BARE}), lambda s: len(list_filter({BARE}, lambda u: u = s)))) >= 3)"
SENTENCES = "list_filter(list_transform(regexp_extract_all(text, '[^.!?]+[.!?]?'), lambda s: trim(s, ' ')), lambda s: s <> '')"
RANKED_VOTE = """
SELECT id, letter, score FROM (
  SELECT s.id, s.letter, s.score, row_number() OVER (PARTITION BY s.id ORDER BY score DESC, (s.letter = coalesce(f.letter, 'a')) DESC, s.letter) AS r
  FROM s LEFT JOIN f ON f.id = s.id) WHERE r = 1"""
WEIGHT = "CASE source " + " ".join(f"WHEN {Q(s)} THEN {ROUTE_WEIGHTS[s]}" for s in SOURCES) + " END"
ROUTE_VALUES = ", ".join(f"({Q(kind)}, {Q(s)}, {i}, {ROUTE_WEIGHTS[s]})" for kind, route in ROUTES.items() for i, s in enumerate(dict.fromkeys((*route, "best"))))
STABLE = f"((question_type IN {names(STABLE_TYPES)} OR {any_of('question_norm', STABLE_PATTERNS)}) AND NOT {any_of('question_norm', DYNAMIC_PATTERNS)})"
TEXT_KEY = "regexp_replace(regexp_replace(replace(lower(trim({0})), 'grey', 'gray'), '\\s+', ' ', 'g'), '^[.:-]+|[.:-]+$', '', 'g')"
HARD = f"""{scores_sql("s")}, {CORRECT_SQL},
g AS (SELECT s.id, c.correct, s.letter, s.score FROM s JOIN c USING (id)),
h AS (
  SELECT id, any_value(correct) AS correct, arg_min(letter, (-score, letter)) FILTER (letter <> correct) AS rejected, arg_min(letter, (-score, letter)) AS predicted,
         max(score) FILTER (letter = correct) AS gold_score, max(score) FILTER (letter <> correct) AS hard_negative_score
  FROM g GROUP BY id),
hn AS (SELECT id, correct, rejected, predicted, predicted <> correct AS is_model_error, gold_score, hard_negative_score, gold_score - hard_negative_score AS gold_margin FROM h)"""
SELECTED = f"{HARD},\nsel AS (SELECT * FROM hn WHERE is_model_error OR gold_margin <= 0.1)"


def grams(name: str, column: str, n: int) -> str:
    each = " UNION ALL ".join(f"SELECT pair, {k} AS n, unnest(list_transform(range(1, greatest(0, len(w) - {k} + 1) + 1), lambda i: array_to_string(w[i:i + {k - 1}], ' '))) AS gram FROM {name}_w" for k in range(1, n + 1))
    return f"{name}_w AS (SELECT pair, regexp_extract_all(lower({column}), '[a-z0-9]+') AS w FROM pr), {name} AS (SELECT pair, n, gram, count(*) AS c FROM ({each}) GROUP BY ALL)"


def overlap(n: int) -> str:
    return f"""{PAIRS_SQL}, {grams('ga', 'candidate', n)}, {grams('gb', 'reference', n)},
both_ AS (SELECT coalesce(ga.pair, gb.pair) AS pair, coalesce(ga.n, gb.n) AS n, coalesce(ga.gram, gb.gram) AS gram, coalesce(ga.c, 0) AS x, coalesce(gb.c, 0) AS y FROM ga FULL JOIN gb ON ga.pair = gb.pair AND ga.n = gb.n AND ga.gram = gb.gram),
ov AS (SELECT pair, n, sum(least(x, y))::DOUBLE AS shared, sum(x)::DOUBLE AS lt, sum(y)::DOUBLE AS rt FROM both_ GROUP BY pair, n)"""


def f1(n: int) -> str:
    return f"""WITH {overlap(n)}
SELECT pr.pair, round(coalesce(CASE WHEN shared > 0 THEN 2 * (shared / greatest(lt, 1)) * (shared / greatest(rt, 1)) / (shared / greatest(lt, 1) + shared / greatest(rt, 1)) END, 0.0), 6) AS f1
FROM pr LEFT JOIN (SELECT * FROM ov WHERE n = {n}) o ON o.pair = pr.pair"""


def half_even(x: str) -> str:
    return f"(CASE WHEN {x} - floor({x}) > 0.5 THEN floor({x}) + 1 WHEN {x} - floor({x}) < 0.5 THEN floor({x}) ELSE floor({x}) + (floor({x})::BIGINT % 2) END)"


def grid(x: str, size: int) -> str:
    return f"greatest(0, least(1000, {half_even(f'({x} / {size}.0 * 1000)')}))::BIGINT"


GRID = f"[{grid('x', 1920)}, {grid('y', 1080)}, {grid('(x + w)', 1920)}, {grid('(y + h)', 1080)}]"

DECADE, SPEED = "'\\b([1-9]0s)\\b'", "'\\b([0-9]+)\\s*km/h\\b'"


def others(pattern: str) -> str:
    return f"(len(regexp_extract_all(value, {pattern}, 1)) > 0 AND len(list_filter(regexp_extract_all(low, {pattern}, 1), lambda z: NOT list_contains(regexp_extract_all(value, {pattern}, 1), z))) > 0)"


COLOUR_LIST = "[" + ", ".join(map(Q, COLOURS)) + "]"
EXPECTED = f"list_filter({COLOUR_LIST}, lambda z: contains(value, z))"
PRESENT = f"list_filter({COLOUR_LIST}, lambda z: contains(' ' || regexp_replace(low, '[^a-z0-9_]', ' ', 'g') || ' ', ' ' || z || ' '))"
# the catalogue's facts are ages, speeds and colours
AGAINST = f"(CASE WHEN contains(key, 'age_group') THEN {others(DECADE)} WHEN contains(key, 'speed') THEN {others(SPEED)} WHEN contains(key, 'color') THEN len({EXPECTED}) > 0 AND len({PRESENT}) > 0 AND NOT list_has_any({PRESENT}, {EXPECTED}) ELSE false END)"
MET = f"""{CAPTIONS_SQL}, {FACTS_SQL},
txt AS (SELECT *, caption_pedestrian || ' ' || caption_vehicle AS body, lower(caption_pedestrian || ' ' || caption_vehicle) AS low FROM cap),
met0 AS (SELECT txt.source, txt.scenario_id, txt.phase, low, fact.phase AS fact_phase, lower(key) AS key, replace(lower(value), 'grey', 'gray') AS value FROM txt JOIN fact ON fact.scenario_id = txt.scenario_id AND (fact.phase IS NULL OR fact.phase = txt.phase)),
met AS (SELECT *, contains(low, value) OR (value LIKE '% km/h' AND contains(replace(low, ' ', ''), replace(value, ' ', ''))) AS is_match, {AGAINST} AS is_against FROM met0)"""
CUES = "CASE phase " + " ".join(f"WHEN '{p}' THEN {hits('low', terms)}" for p, terms in PHASE_CUES.items()) + " ELSE 0 END"
SCORED = f"""{MET},
sums AS (
  SELECT source, scenario_id, phase, sum(CASE WHEN is_match THEN 0.7 + CASE WHEN contains(key, 'age_group') THEN 1.0 WHEN contains(key, 'speed') THEN 0.8 WHEN contains(key, 'color') THEN 0.5 ELSE 0 END ELSE 0 END - CASE WHEN is_against THEN 2.5 ELSE 0 END)::DOUBLE AS fact_sum,
         count(*) FILTER (is_match) AS matches, count(*) FILTER (is_against) AS contradictions
  FROM met GROUP BY ALL),
cs AS (
  SELECT txt.*, matches, contradictions,
    3.0 + greatest(-3.0, 4.0 - abs(len(regexp_extract_all(body, '[\\p{{L}}\\p{{N}}_]+')) - 40) / 18.0) + {hits('low', ARTIFACT_TERMS)} * -4.0 + least(3.0, {CUES.replace('phase', 'txt.phase')} * 0.6)
    + CASE WHEN {REPETITIVE.format('body')} THEN -4.0 ELSE 0.0 END + fact_sum + (least(8.0, matches * 0.6) - contradictions * 3.0) * 2 + CASE WHEN source = 'base' THEN 0.05 ELSE 0 END AS score
  FROM txt JOIN sums USING (source, scenario_id, phase))"""

CLEAN = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
JOINED = "len(regexp_extract_all(lower({0}), '[A-Za-z0-9]+(?:[-''][A-Za-z0-9]+)?'))"
ITEMS = "list_distinct(list_concat(list_filter([" + ", ".join(map(Q, PROTECTED_TERMS)) + "], lambda z: contains(lower({0}), z)), " + ", ".join(f"list_transform(regexp_extract_all(lower({{0}}), {Q(p)}), lambda z: regexp_replace(z, '\\s+', ' ', 'g'))" for p in PROTECTED_PATTERNS) + "))"
FLAW = {name: "regexp_matches({0}, " + Q(p).replace("{", "{{").replace("}", "}}") + ")" for name, p in FAULT_PATTERNS}
QUALITY = f"({JOINED} * 0.015 + least(8, len({{0}}) - len(replace({{0}}, '.', ''))) * 0.15 + {hits('lower({0})', QUALITY_TERMS)} * 0.3 - CASE WHEN {FLAW['bad_ending']} OR {FLAW['fragment']} THEN 5.0 ELSE 0 END)"


def against_base(source: str) -> str:
    return f"""{CAPTIONS_SQL},
roles AS (SELECT source, scenario_id, row_idx, phase, 'pedestrian' AS role, caption_pedestrian AS text FROM cap UNION ALL SELECT source, scenario_id, row_idx, phase, 'vehicle', caption_vehicle FROM cap),
gt AS (SELECT o.scenario_id, o.phase, o.role, {CLEAN.format('o.text')} AS cand, {CLEAN.format('b.text')} AS base FROM roles o JOIN roles b ON b.source = 'base' AND o.source = '{source}' AND b.scenario_id = o.scenario_id AND b.row_idx = o.row_idx AND b.role = o.role)"""


LOW, HIGH, MARGIN = GATE_POLICIES["loose"]
RATIO = f"({JOINED.format('cand')} / greatest(1, {JOINED.format('base')}))"
OPEN = "(" + " OR ".join(f"ends_with(regexp_replace(lower(trim({{0}})), '[ ,;:]+$', ''), {Q(t)})" for t in BAD_TAILS) + ")"


def cut(mark: str) -> str:
    return f"WHEN contains({{0}}, '{mark}') THEN trim(left({{0}}, len({{0}}) - instr(reverse({{0}}), '{mark}') + 1))"


MENDED = f"CASE WHEN {REASON} <> 'missing_terminal_punctuation' THEN {{0}} WHEN {OPEN} THEN CASE {cut('.')} {cut('!')} {cut('?')} ELSE regexp_replace({{0}}, '[ ,;:]+$', '') || '.' END ELSE regexp_replace({{0}}, '[ ,;:]+$', '') || '.' END"


def mend(column: str) -> str:
    return f"CASE WHEN {REASON.format('o.' + column)} = '' THEN o.{column} WHEN {REASON.format('b.' + column)} = '' THEN b.{column} ELSE {MENDED.format('o.' + column)} END AS {column}"


PROMPT = f"""{Q(VQA_SYSTEM)} || chr(10) || chr(10) || 'Scenario type: main' || chr(10) || 'Scope: ' || scope || chr(10) || coalesce('Phase label: ' || phase, 'Scenario-level environment question') || chr(10) || chr(10)
 || array_to_string(list_transform(range(ord % 3), lambda i: '<video>'), chr(10)) || chr(10) || chr(10) || chr(10) || chr(10) || chr(10) || chr(10) || 'Question: ' || question || chr(10) || 'Options:' || chr(10)
 || 'a. ' || options[1] || chr(10) || 'b. ' || options[2] || chr(10) || 'c. ' || options[3] || chr(10) || 'd. ' || options[4] || chr(10) || chr(10) || 'Return only the correct option letter.'"""
BANK = """docs AS (SELECT doc_id AS doc, lang AS bank, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
gr AS (SELECT bank, doc, gram, count(*) AS c FROM (
  SELECT bank, doc, unnest(list_transform(range(1, greatest(0, len(w) - k + 1) + 1), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS gram FROM docs, (SELECT unnest(range(1, 5)) AS k)) GROUP BY ALL),
cn AS (SELECT bank, gram, sum(c) AS n, count(*) AS df FROM gr GROUP BY ALL),
bk AS (SELECT bank, gram, round(n * greatest(ln((docs_ + 1.0) / (df + 0.5)), 0.05), 6) AS weight FROM cn JOIN (SELECT bank, count(DISTINCT doc) AS docs_ FROM docs GROUP BY bank) USING (bank)),
top AS (SELECT * FROM bk QUALIFY row_number() OVER (PARTITION BY bank ORDER BY weight DESC, gram) <= 6000)"""
MODE = ROUTER_MODES["balanced"] | {"min_acc": 0.2, "margin": -0.05}
SOURCE_LIST = "[" + ", ".join(map(Q, SOURCES)) + "]"

SQL = {
    "token_counts": f"SELECT doc_id, len({TOKENS})::BIGINT AS tokens, len(list_distinct({TOKENS}))::BIGINT AS distinct_tokens FROM documents",
    "word_count_unicode": "SELECT doc_id, len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+'))::BIGINT AS words FROM documents",
    "letter_parse": f"SELECT doc_id, {LETTER.format('text')} AS letter, CASE WHEN substr(lower(trim(text)), 1, 1) IN ('a', 'b', 'c', 'd', 'e') THEN substr(lower(trim(text)), 1, 1) ELSE '' END AS strict FROM documents",
    "sentence_split": f"SELECT doc_id, len(s)::BIGINT AS sentences, s[1] AS first, {slug_sql('s[1]')} AS slug FROM (SELECT doc_id, {SENTENCES} AS s FROM documents)",
    "truncation_audit": f"SELECT {REASON.format('text')} AS reason, count(*)::BIGINT AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1",
    "repetition_flag": f"SELECT doc_id FROM documents WHERE {REPETITIVE.format('text')}",
    "json_salvage": "SELECT event_id, event_id % 4 IN (0, 3) AS found, CASE WHEN event_id % 4 IN (0, 3) THEN length(props)::BIGINT ELSE 0 END AS length FROM events",
    "question_type_summary": f"WITH {TYPED} SELECT question_type, scope, count(*)::BIGINT AS n, grouping(question_type, scope)::BIGINT AS level FROM ty GROUP BY GROUPING SETS ((), (question_type), (scope), (question_type, scope))",
    "first_example_per_type": f"WITH {TYPED} SELECT question_type, arg_min(question, ord) AS question FROM ty GROUP BY question_type",
    "scope_inference": f"""WITH {QUESTIONS_SQL}
SELECT ord // 3 AS item, CASE WHEN bool_or(contains(lower(question), 'vehicle') AND {any_of('lower(question)', ('field of view', 'action taken by vehicle', 'position of the vehicle relative', 'relative distance of vehicle'))}) THEN 'vehicle_view' ELSE 'overhead_view' END AS loose,
  CASE WHEN bool_or({any_of('lower(question)', ("vehicle's field of view", 'action taken by vehicle', 'position of the vehicle relative', 'relative distance of vehicle'))}) THEN 'vehicle_view' ELSE 'overhead_view' END AS strict
FROM q WHERE scope <> 'environment' GROUP BY 1""",
    "prompt_build": f"WITH {QUESTIONS_SQL} SELECT id, md5({PROMPT}) AS prompt_md5, length({PROMPT})::BIGINT AS length FROM q",
    "prompt_parse": f"WITH {QUESTIONS_SQL} SELECT id, question, 4::BIGINT AS options, options[2] AS option_b FROM q",
    "preference_pairs": f"WITH {QUESTIONS_SQL}, l AS (SELECT unnest(['a', 'b', 'c', 'd']) AS rejected) SELECT id, correct AS chosen, rejected FROM q, l WHERE rejected <> correct",
    "option_shuffle": f"""WITH {QUESTIONS_SQL},
e AS (SELECT id, copy, correct, unnest(['a', 'b', 'c', 'd']) AS old, unnest(options) AS txt FROM q, (SELECT unnest(range(3)) AS copy)),
r AS (SELECT *, row_number() OVER (PARTITION BY id, copy ORDER BY CASE WHEN copy = 0 THEN '' ELSE md5('7|' || id || '|' || copy || '|' || old) END, old) AS n FROM e)
SELECT id, copy::BIGINT AS copy, string_agg(txt, '|' ORDER BY n) AS texts, substr('abcd', max(CASE WHEN old = correct THEN n END)::INT, 1) AS correct FROM r GROUP BY id, copy""",
    "vote_plurality": f"WITH {VOTES_SQL}, {FALLBACK_SQL}, s AS (SELECT id, letter, count(*)::BIGINT AS score FROM v GROUP BY ALL) {RANKED_VOTE}",
    "vote_weighted_fallback": f"WITH {VOTES_SQL}, {FALLBACK_SQL}, s AS (SELECT id, letter, sum({WEIGHT})::BIGINT AS score FROM v GROUP BY ALL) {RANKED_VOTE}",
    "vote_missing_ids": f"WITH {VOTES_SQL}, {FALLBACK_SQL} SELECT source, count(*)::BIGINT AS missing, min(id) AS first_id FROM (SELECT f.id, s.source FROM f, (SELECT unnest({SOURCE_LIST}) AS source) s ANTI JOIN v ON v.id = f.id AND v.source = s.source) GROUP BY source",
    "vote_routed": f"""WITH {VOTES_SQL}, {FALLBACK_SQL}, {TYPED}, rt(question_type, source, place, weight) AS (VALUES {ROUTE_VALUES}),
w AS (SELECT id, source, letter FROM v UNION ALL SELECT id, 'best', letter FROM f),
s AS (SELECT ty.id, w.letter, sum(weight)::BIGINT AS score, min(place) AS place FROM ty JOIN w ON w.id = ty.id JOIN rt ON rt.question_type = ty.question_type AND rt.source = w.source GROUP BY ALL)
SELECT ty.id, coalesce(b.letter, f.letter) AS letter, coalesce(b.score, 0)::BIGINT AS score FROM ty
LEFT JOIN (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, place) = 1) b ON b.id = ty.id LEFT JOIN f ON f.id = ty.id""",
    "vote_self_consistency": f"""WITH {VOTES_SQL}, {FALLBACK_SQL}, s AS (SELECT id, letter, count(*)::BIGINT AS n FROM v GROUP BY ALL),
r AS (SELECT id, letter, n, lead(n) OVER w AS second, row_number() OVER w AS r FROM s WINDOW w AS (PARTITION BY id ORDER BY n DESC, letter DESC)),
o AS (SELECT f.id, f.letter AS fb, r.letter AS top, coalesce(n, 0) AS votes, coalesce(n - coalesce(second, 0), 0) AS margin FROM f LEFT JOIN r ON r.id = f.id AND r = 1)
SELECT id, CASE WHEN votes >= 3 AND margin >= 1 THEN top ELSE fb END AS letter, votes::BIGINT AS votes, margin::BIGINT AS margin, CASE WHEN votes >= 3 AND margin >= 1 THEN top ELSE fb END <> fb AS changed FROM o""",
    "disagreement_subset": f"""WITH {VOTES_SQL}, {FALLBACK_SQL}, x AS (SELECT v.id, f.ord, v.letter, count(*) AS n FROM v JOIN f ON f.id = v.id WHERE v.letter <> f.letter GROUP BY ALL)
SELECT id, ord, sum(n)::BIGINT AS disagree FROM x GROUP BY id, ord HAVING sum(n) >= 3 AND max(n) >= 2""",
    "pairwise_disagreement": f"""WITH {VOTES_SQL} SELECT a.source AS "left", b.source AS "right", count(*)::BIGINT AS shared, count(*) FILTER (a.letter <> b.letter)::BIGINT AS differ FROM v a JOIN v b ON a.id = b.id AND a.source < b.source GROUP BY 1, 2""",
    "majority_repair": f"""WITH {TYPED}, {ANSWERS_SQL},
g AS (SELECT ty.id, scenario_id, question_type, question_norm, ty.ord, letter FROM ty JOIN a ON a.id = ty.id WHERE {STABLE}),
n AS (SELECT scenario_id, question_type, question_norm, letter, count(*) AS n, min(ord) AS first FROM g GROUP BY ALL),
b AS (SELECT *, sum(n) OVER (PARTITION BY scenario_id, question_norm, question_type) AS size FROM n QUALIFY row_number() OVER (PARTITION BY scenario_id, question_norm, question_type ORDER BY n DESC, first) = 1)
SELECT g.id, g.letter AS old, b.letter AS new FROM g JOIN b USING (scenario_id, question_type, question_norm) WHERE size >= 2 AND n >= 2 AND n / size >= 0.75 AND g.letter <> b.letter""",
    "slot_text_repair": f"""WITH {TYPED}, {ANSWERS_SQL},
g AS (SELECT ty.id, scenario_id, question_type, question_norm, options, letter, {TEXT_KEY.format("options[instr('abcd', letter)]")} AS said FROM ty JOIN a ON a.id = ty.id
      WHERE (scope = 'environment' OR {any_of('question_norm', STABLE_PATTERNS)}) AND NOT {any_of('question_norm', DYNAMIC_PATTERNS)}),
n AS (SELECT scenario_id, question_type, question_norm, said, count(*) AS n FROM g GROUP BY ALL),
b AS (SELECT *, sum(n) OVER (PARTITION BY scenario_id, question_norm, question_type) AS size FROM n QUALIFY row_number() OVER (PARTITION BY scenario_id, question_norm, question_type ORDER BY n DESC, said) = 1),
t AS (SELECT g.id, g.letter AS old, substr('abcd', list_position(list_transform(options, lambda o: {TEXT_KEY.format('o')}), b.said)::INT, 1) AS new FROM g JOIN b USING (scenario_id, question_type, question_norm) WHERE size >= 2 AND n >= 2 AND n / size >= 0.75)
SELECT * FROM t WHERE new <> old""",
    "answer_priors_repair": f"""WITH {TYPED}, {ANSWERS_SQL},
al AS (SELECT *, list_transform(options, lambda o: CASE lower(o) WHEN 'none' THEN 'no' WHEN 'n/a' THEN 'no' WHEN 'normal' THEN 'usual' ELSE lower(o) END) AS norms, replace(replace(question_norm, 'wearning', 'wearing'), 'waling cane', 'walking cane') AS pq FROM ty),
tr AS (SELECT pq, norms[CASE WHEN ord % 16 = 2 THEN instr('abcd', correct) ELSE 1 END] AS answer, ord FROM al WHERE ord % 2 = 0),
n AS (SELECT pq, answer, count(*) AS n, min(ord) AS first FROM tr GROUP BY ALL),
b AS (SELECT *, sum(n) OVER (PARTITION BY pq) AS total FROM n QUALIFY row_number() OVER (PARTITION BY pq ORDER BY n DESC, first) = 1),
x AS (SELECT al.id, question_type, letter, total, n / total AS share, CASE WHEN b.answer IS NOT NULL AND list_position(norms, b.answer) > 0 THEN substr('abcd', list_position(norms, b.answer)::INT, 1) END AS new FROM al LEFT JOIN b ON b.pq = al.pq LEFT JOIN a ON a.id = al.id WHERE al.ord % 2 = 1)
SELECT id, question_type, CASE WHEN question_type NOT IN {names(PRIOR_TYPES)} THEN 'type_block' WHEN total IS NULL THEN 'unseen_question' WHEN total < 5 THEN 'low_count' WHEN share < 0.5 THEN 'low_share' WHEN new IS NULL THEN 'answer_not_option' WHEN letter = new THEN 'already_same' ELSE 'change' END AS decision, letter AS old, new FROM x""",
    "entropy_by_type": f"""WITH {TYPED}, n AS (SELECT question_type, correct, count(*) AS c FROM ty GROUP BY ALL), p AS (SELECT *, c / sum(c) OVER (PARTITION BY question_type) AS s FROM n)
SELECT question_type, sum(c)::BIGINT AS n, count(*)::BIGINT AS values, round(sum(-s * log2(s)), 4) AS entropy FROM p GROUP BY question_type""",
    "accuracy_by_group": f"WITH {TYPED}, {ANSWERS_SQL} SELECT question_type, count(*) FILTER (letter = correct)::BIGINT AS correct, count(*)::BIGINT AS total, round(count(*) FILTER (letter = correct) / count(*), 6) AS accuracy FROM ty LEFT JOIN a ON a.id = ty.id GROUP BY question_type",
    "calibrated_router": f"""WITH {TYPED}, {VOTES_SQL},
rt AS (SELECT question_type, source, count(*) AS n, round(count(*) FILTER (letter = correct) / count(*), 6) AS acc FROM ty JOIN v ON v.id = ty.id WHERE ord % 2 = 0 GROUP BY ALL HAVING count(*) >= {MODE['min_n']}),
bs AS (SELECT * FROM rt QUALIFY row_number() OVER (PARTITION BY question_type ORDER BY acc DESC, n DESC, list_position({SOURCE_LIST}, source)) = 1),
bl AS (SELECT question_type, max(acc) AS base FROM rt WHERE source IN ('env', 'joint') GROUP BY 1),
ch AS (SELECT bs.question_type, bs.source FROM bs LEFT JOIN bl USING (question_type) WHERE acc >= {MODE['min_acc']} AND acc - coalesce(base, 0) >= {MODE['margin']}),
sp AS (SELECT id, letter, count(*) AS support FROM v GROUP BY ALL),
o AS (SELECT ty.id, ty.ord, coalesce(fb.letter, '') AS fb, CASE WHEN m.letter IS NOT NULL AND sp.support >= {MODE['support']} THEN m.letter ELSE coalesce(fb.letter, '') END AS sel
  FROM ty LEFT JOIN v fb ON fb.id = ty.id AND fb.source = 'joint' LEFT JOIN ch ON ch.question_type = ty.question_type LEFT JOIN v m ON m.id = ty.id AND m.source = ch.source LEFT JOIN sp ON sp.id = m.id AND sp.letter = m.letter WHERE ty.ord % 2 = 1),
r AS (SELECT *, sum((sel <> fb)::INT) OVER (ORDER BY ord) AS nth, count(*) OVER () AS total FROM o)
SELECT id, CASE WHEN sel <> fb AND nth <= {half_even(f"(total * {MODE['change_cap']}::DOUBLE)")} THEN sel ELSE fb END AS letter, sel <> fb AND nth <= {half_even(f"(total * {MODE['change_cap']}::DOUBLE)")} AS changed FROM r""",
    "submission_validate": """WITH r AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem),
s AS (SELECT l_orderkey * 1000000000 + l_linenumber * 100000000 + l_partkey * 1000 + l_suppkey AS ord, CASE WHEN l_partkey % 97 = 0 THEN '' ELSE 'q' || l_orderkey END AS id, substr('abcdx', 1 + (l_suppkey % 5)::INT, 1) AS correct FROM r),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord) AS n FROM s),
e AS (SELECT ord, 'missing id' AS error FROM n WHERE id = '' UNION ALL SELECT ord, 'duplicate id' FROM n WHERE n > 1 UNION ALL SELECT ord, 'correct must be one of a/b/c/d/e' FROM n WHERE correct NOT IN ('a', 'b', 'c', 'd', 'e'))
SELECT error, count(*)::BIGINT AS n, min(ord) AS first_ord FROM e GROUP BY error""",
    "hard_negative": f"WITH {HARD} SELECT * FROM hn",
    "margin_summary": f"WITH {HARD} SELECT correct, count(*)::BIGINT AS n, round(min(gold_margin), 6) AS min, round(median(gold_margin), 6) AS median, round(avg(gold_margin), 6) AS mean, round(max(gold_margin), 6) AS max FROM hn GROUP BY correct",
    "balanced_round_robin": f"WITH {SELECTED}, r AS (SELECT id, correct, rejected, row_number() OVER (PARTITION BY correct, rejected ORDER BY round(gold_margin, 6), id)::BIGINT AS turn FROM sel) SELECT * FROM r WHERE turn <= 10 ORDER BY turn, correct, rejected LIMIT 60",
    "letter_remap": f"""WITH {SELECTED}, p AS (SELECT a || b AS pair, row_number() OVER (ORDER BY a, b) - 1 AS k FROM (SELECT unnest(['a', 'b', 'c', 'd']) AS a), (SELECT unnest(['a', 'b', 'c', 'd']) AS b) WHERE a <> b),
n AS (SELECT id, (row_number() OVER (ORDER BY round(gold_margin, 6), id) - 1) % 12 AS k FROM sel) SELECT id, substr(pair, 1, 1) AS chosen, substr(pair, 2, 1) AS refused FROM n JOIN p USING (k)""",
    "score_normalize": f"WITH {scores_sql('s')}, m AS (SELECT *, score - avg(score) OVER (PARTITION BY id) AS x, stddev_pop(score) OVER (PARTITION BY id) AS sd FROM s) SELECT id, letter, round(CASE WHEN sd <= 1e-12 THEN x ELSE x / sd END, 6) + 0.0 AS score FROM m",
    "option_score_ensemble": f"""WITH {scores_sql('s1')}, {scores_sql('s2', 4)}, u AS (SELECT id, letter, score, 1.0 AS w FROM s1 UNION ALL SELECT id, letter, score, 0.5 FROM s2 WHERE substr(id, 2)::BIGINT % 3 <> 0),
m AS (SELECT id, letter, w * (score - avg(score) OVER (PARTITION BY id, w)) AS x, w FROM u), t AS (SELECT id, letter, sum(x ORDER BY w DESC) AS total FROM m GROUP BY ALL)
SELECT id, letter, 'scores' AS origin FROM t QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(total, 9) DESC, letter) = 1""",
    "capped_greedy": """WITH p AS (SELECT p_partkey, p_brand, substr(p_type, 1, 5) AS kind, p_retailprice FROM part),
a AS (SELECT *, row_number() OVER (PARTITION BY p_brand, kind ORDER BY p_retailprice DESC, p_partkey) AS r FROM p), b AS (SELECT * EXCLUDE r FROM a WHERE NOT (p_brand = 'Brand#33' AND kind = 'PROMO' AND r > 1)),
c AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM b)
SELECT p_partkey, p_brand, kind FROM c WHERE NOT (p_brand = 'Brand#11' AND r > 2) AND NOT (p_brand = 'Brand#22' AND r > 3) ORDER BY p_retailprice DESC, p_partkey LIMIT 40""",
    "topk_variants": "WITH r AS (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey)::BIGINT AS rank FROM part) SELECT p_partkey, rank, k::BIGINT AS k FROM r, (SELECT unnest([5, 10, 20]) AS k) WHERE rank <= k",
    "fact_values": f"WITH {QUESTIONS_SQL}, {ANSWERS_SQL} SELECT scenario_id, phase, {fact_key_sql()} AS key, arg_max(options[instr('abcd', letter)], q.ord) AS value FROM q JOIN a ON a.id = q.id GROUP BY 1, 2, 3",
    "fact_pivot": f"""WITH {QUESTIONS_SQL}, fr AS (SELECT scenario_id, phase, {fact_key_sql()} AS key, arg_max(options[instr('abcd', correct)], ord) AS value FROM q GROUP BY 1, 2, 3)
SELECT scenario_id, phase, max(value) FILTER (key = 'environment.weather') AS environment__weather, max(value) FILTER (key = 'pedestrian.age_group') AS pedestrian__age_group, max(value) FILTER (key = 'vehicle.speed') AS vehicle__speed FROM fr GROUP BY scenario_id, phase""",
    "scene_graphs": f"""WITH {QUESTIONS_SQL}, fr AS (SELECT scenario_id, phase, {fact_key_sql()} AS key, arg_max(options[instr('abcd', correct)], ord) AS value FROM q GROUP BY 1, 2, 3),
r AS (SELECT scenario_id, phase, string_split(key, '.')[1] AS role, '{{' || string_agg('"' || regexp_replace(key, '^[^.]*[.]?', '') || '":"' || value || '"', ',' ORDER BY key) || '}}' AS j FROM fr GROUP BY 1, 2, 3)
SELECT scenario_id, phase, '{{' || string_agg('"' || role || '":' || j, ',' ORDER BY role) || '}}' AS graph FROM r GROUP BY 1, 2""",
    "fact_context": f"""WITH {QUESTIONS_SQL}, fr AS (SELECT scenario_id, phase, {fact_key_sql()} AS key, arg_max(options[instr('abcd', correct)], ord) AS value FROM q GROUP BY 1, 2, 3),
k AS (SELECT * FROM fr QUALIFY row_number() OVER (PARTITION BY scenario_id, phase ORDER BY key) <= CASE WHEN phase IS NULL THEN 5 ELSE 4 END)
SELECT scenario_id, phase, string_agg('- ' || key || ': ' || value, chr(10) ORDER BY key) AS context FROM k GROUP BY scenario_id, phase""",
    "caption_completeness": f"""WITH {CAPTIONS_SQL}, r AS (SELECT source, scenario_id, phase, 'pedestrian' AS role, {REASON.format('caption_pedestrian')} AS reason FROM cap UNION ALL SELECT source, scenario_id, phase, 'vehicle', {REASON.format('caption_vehicle')} FROM cap) SELECT * FROM r WHERE reason <> ''""",
    "caption_scores": f"WITH {SCORED} SELECT source, scenario_id, phase, round(score, 4) AS score, matches::BIGINT AS matches, contradictions::BIGINT AS contradictions FROM cs",
    "caption_fusion": f"""WITH {SCORED}, k AS (SELECT *, max(score) OVER p AS top, max(CASE WHEN source = 'base' THEN score END) OVER p AS own, row_number() OVER (PARTITION BY scenario_id, phase ORDER BY score DESC, source) AS r FROM cs WINDOW p AS (PARTITION BY scenario_id, phase))
SELECT scenario_id, phase, source, caption_pedestrian FROM k WHERE CASE WHEN top >= own + 2.0 THEN r = 1 ELSE source = 'base' END""",
    "fact_locked_gate": f"""WITH {against_base('fused')},
rs AS (SELECT *, list_filter([{', '.join(f"CASE WHEN {FLAW[n].format('cand')} THEN {Q(n)} END" for n, _ in FAULT_PATTERNS)}, CASE WHEN {RATIO} < {LOW} THEN 'too_short' END, CASE WHEN {RATIO} > {HIGH} THEN 'too_long' END,
  CASE WHEN len(list_filter({ITEMS.format('base')}, lambda y: NOT list_contains({ITEMS.format('cand')}, y))) > 0 THEN 'missing_protected' END], lambda z: z IS NOT NULL) AS r, {QUALITY.format('cand')} - {QUALITY.format('base')} AS delta FROM gt),
rr AS (SELECT *, CASE WHEN len(r) > 0 THEN r WHEN delta < {MARGIN} THEN ['quality_delta'] ELSE r END AS reasons FROM rs)
SELECT scenario_id, phase, role, len(reasons) = 0 AS accepted, array_to_string(reasons, ',') AS reasons FROM rr""",
    "protected_diff": f"WITH {against_base('slots')} SELECT scenario_id, phase, role, array_to_string(list_sort(list_filter({ITEMS.format('base')}, lambda y: NOT list_contains({ITEMS.format('cand')}, y))), ',') AS lost FROM gt",
    "consistency_repair": f"""WITH {MET}, pn AS (SELECT source, scenario_id, phase, CASE WHEN bool_or(is_against AND contains(key, 'age_group')) THEN -2.5::DOUBLE ELSE 0.0::DOUBLE END AS penalty FROM met GROUP BY ALL)
SELECT o.scenario_id, o.phase, penalty, penalty <= -2 AS replaced, CASE WHEN penalty <= -2 THEN b.caption_pedestrian ELSE o.caption_pedestrian END AS caption_pedestrian
FROM cap o JOIN pn USING (source, scenario_id, phase) JOIN cap b ON b.source = 'base' AND b.scenario_id = o.scenario_id AND b.row_idx = o.row_idx WHERE o.source = 'fused'""",
    "completeness_repair": f"WITH {CAPTIONS_SQL} SELECT o.scenario_id, o.phase, {mend('caption_pedestrian')}, {mend('caption_vehicle')} FROM cap o JOIN cap b ON b.source = 'base' AND o.source = 'fused' AND b.scenario_id = o.scenario_id AND b.row_idx = o.row_idx",
    "phrase_bank": f"WITH {BANK} SELECT bank, gram, weight FROM top",
    "phrase_overlap": f"WITH {BANK} SELECT docs.doc AS id, round(coalesce(sum(least(c, 3) * coalesce(weight, 0)) / greatest(sum(least(c, 3)), 1), 0), 4) AS overlap FROM docs LEFT JOIN gr ON gr.doc = docs.doc LEFT JOIN top ON top.bank = gr.bank AND top.gram = gr.gram GROUP BY docs.doc",
    "question_export": f"""WITH {TYPED} SELECT id, correct || '. ' || options[instr('abcd', correct)] AS output, CASE WHEN scope = 'vehicle_view' THEN 0 ELSE 1 END::BIGINT AS videos, question_type FROM ty""",
    "bleu": f"""WITH {overlap(4)}, t AS (SELECT n, sum(shared) AS s, sum(lt) AS t, sum(rt) AS r FROM ov GROUP BY n), g AS (SELECT sum(ln((s + 1) / (t + 1))) / 4 AS l, max(t) FILTER (n = 1) AS c, max(r) FILTER (n = 1) AS r FROM t)
SELECT round(CASE WHEN c > r THEN 1.0 ELSE exp(1 - r / greatest(c, 1)) END * exp(l), 6) AS bleu FROM g""",
    "meteor_like": f"WITH {overlap(1)} SELECT pr.pair, round(coalesce(CASE WHEN shared > 0 THEN 10 * (shared / lt) * (shared / rt) / (shared / rt + 9 * (shared / lt)) END, 0.0), 6) AS meteor FROM pr LEFT JOIN ov ON ov.pair = pr.pair",
    "cider_like": f"""WITH {overlap(4)}, df AS (SELECT n, gram, count(*) AS df FROM gb GROUP BY ALL), v AS (SELECT pair, b.n, x * ln(((SELECT count(*) FROM pr) + 1.0) / (coalesce(df, 0) + 1.0)) AS x, y * ln(((SELECT count(*) FROM pr) + 1.0) / (coalesce(df, 0) + 1.0)) AS y FROM both_ b LEFT JOIN df ON df.n = b.n AND df.gram = b.gram),
s AS (SELECT pair, n, sum(x * y) AS xy, sum(x * x) AS xx, sum(y * y) AS yy FROM v GROUP BY ALL), c AS (SELECT pair, sum(CASE WHEN xx > 0 AND yy > 0 THEN xy / (sqrt(xx) * sqrt(yy)) ELSE 0 END) / 4 AS cider FROM s GROUP BY pair)
SELECT pr.pair, round(coalesce(cider, 0.0), 6) AS cider FROM pr LEFT JOIN c ON c.pair = pr.pair""",
    "token_f1_pairs": f1(1),
    "fourgram_f1_pairs": f1(4),
    "bbox_normalize": f"WITH {TRACKS_SQL}, g AS (SELECT ord, {GRID} AS b FROM t) SELECT ord, b[1] AS x1, b[2] AS y1, b[3] AS x2, b[4] AS y2 FROM g",
    "track_summary": f"""WITH {TRACKS_SQL}, g AS (SELECT role, track, phase, image_id, ord, array_to_string({GRID}, ',') AS b FROM t), r AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY role, track, phase) AS n FROM g WINDOW w AS (PARTITION BY role, track, phase ORDER BY image_id, ord))
SELECT role, track, phase, max(n)::BIGINT AS frames, max(b) FILTER (i = 0) AS first, max(b) FILTER (i = n // 2) AS mid, max(b) FILTER (i = n - 1) AS last FROM r GROUP BY role, track, phase""",
    "crop_geometry": f"""WITH {TRACKS_SQL}, p AS (SELECT role, track, phase, greatest(0, least(1918, {half_even('x')}))::BIGINT AS x1, greatest(0, least(1078, {half_even('y')}))::BIGINT AS y1, x, y, w, h FROM t),
b AS (SELECT role, track, phase, x1, y1, greatest(x1 + 1, least(1920, {half_even('(x + w)')}))::BIGINT AS x2, greatest(y1 + 1, least(1080, {half_even('(y + h)')}))::BIGINT AS y2 FROM p),
u AS (SELECT role, track, phase, count(*)::BIGINT AS frames, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM b WHERE x2 > x1 + 1 AND y2 > y1 + 1 GROUP BY ALL),
s0 AS (SELECT *, greatest(x2 - x1, y2 - y1, 2) * 1.7::DOUBLE AS raw FROM u), s1 AS (SELECT *, least(greatest({half_even('raw')}, 96), 1920, 1080)::BIGINT AS s FROM s0),
l0 AS (SELECT *, (x1 + x2) / 2.0 - s / 2.0 AS lx, (y1 + y2) / 2.0 - s / 2.0 AS ty FROM s1), l1 AS (SELECT *, greatest(0, least(1920 - s, {half_even('lx')}::BIGINT)) AS l, greatest(0, least(1080 - s, {half_even('ty')}::BIGINT)) AS t FROM l0),
e AS (SELECT role, track, phase, frames, s - s % 2 AS side, l - l % 2 AS l, t - t % 2 AS t FROM l1)
SELECT role, track, phase, frames, side, CASE WHEN l + side > 1920 THEN greatest(0, 1920 - side) - greatest(0, 1920 - side) % 2 ELSE l END AS "left", CASE WHEN t + side > 1080 THEN greatest(0, 1080 - side) - greatest(0, 1080 - side) % 2 ELSE t END AS top FROM e""",
    "nearest_frame": f"""WITH {TRACKS_SQL}, w AS (SELECT DISTINCT role, track, ord * 3 % 4001 AS frame FROM t)
SELECT role, track, frame, image_id FROM (SELECT w.role, w.track, frame, image_id, row_number() OVER (PARTITION BY w.role, w.track, frame ORDER BY abs(image_id - frame), ord) AS r FROM w JOIN t ON t.role = w.role AND t.track = w.track) WHERE r = 1""",
    "clip_manifest": f"""WITH {TRACKS_SQL}, p AS (SELECT track, phase, min(image_id) / 10.0::DOUBLE AS a, max(image_id) / 10.0::DOUBLE AS b FROM t GROUP BY ALL)
SELECT 's' || track AS scenario_id, 's' || track || '_cam1' AS camera_id, phase, a AS start_time, greatest(b - a, 0.001) AS duration, '/clips/train/main/s' || track || '/overhead_view/s' || track || '_cam1_phase_' || phase || '.mp4' AS clip_path FROM p""",
    "zip_predictions": "WITH l AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS ord, doc_id, quality FROM labels) SELECT ord, doc_id, quality::BIGINT AS quality FROM l",
    "key_or_place_join": f"""WITH {CAPTIONS_SQL}, o AS (SELECT scenario_id, row_idx, CASE WHEN row_idx % 2 = 0 THEN phase ELSE 'x' END AS phase, caption_vehicle FROM cap WHERE source = 'fused' AND row_idx < 4)
SELECT b.scenario_id, b.row_idx::BIGINT AS row_idx, coalesce(k.caption_vehicle, p.caption_vehicle) AS other_caption_vehicle FROM cap b LEFT JOIN (SELECT scenario_id, phase, arg_min(caption_vehicle, row_idx) AS caption_vehicle FROM o GROUP BY ALL) k ON k.scenario_id = b.scenario_id AND k.phase = b.phase
LEFT JOIN o p ON p.scenario_id = b.scenario_id AND p.row_idx = b.row_idx WHERE b.source = 'base'""",
    "resume_antijoin": "SELECT doc_id, lang FROM documents ANTI JOIN (SELECT doc_id FROM labels WHERE quality = 1) USING (doc_id)",
    "stable_ids": f"""WITH {QUESTIONS_SQL}, o AS (SELECT *, 'a. ' || options[1] || chr(10) || 'b. ' || options[2] || chr(10) || 'c. ' || options[3] || chr(10) || 'd. ' || options[4] AS opts FROM q)
SELECT id, substr(sha1('options=' || length(opts) || ':' || opts || ';phase=' || coalesce(length(phase) || ':' || phase, '~') || ';question=' || length(question) || ':' || question || ';scenario_id=' || length(scenario_id) || ':' || scenario_id
  || ';scope=' || length(scope) || ':' || scope), 1, 16) AS stable_id, substr(sha1('/videos/' || scenario_id || '.mp4'), 1, 24) AS media FROM o""",
    "options_rewrite": f"""WITH {QUESTIONS_SQL}, k1 AS (SELECT *, instr('abcd', correct) AS spot FROM q),
k2 AS (SELECT * EXCLUDE (options), options AS old, list_filter([1, 2, 3, 4], lambda i: i <> spot AND i <> spot % 4 + 1) AS rest FROM k1),
r AS (SELECT * EXCLUDE (old), [old[rest[1]], old[spot], old[rest[2]], old[spot % 4 + 1]] AS options FROM k2)
SELECT id, md5({PROMPT}) AS prompt_md5 FROM r""",
    "rule_fusion": f"""WITH {VOTES_SQL}, {TYPED}, env AS (SELECT id, letter FROM v WHERE source = 'env'),
asked AS (SELECT ty.id, question_type, env.letter AS general FROM ty JOIN env USING (id)),
inp AS (
  SELECT id, question_type, general, CASE WHEN question_type = 'pedestrian_action' THEN 'visual' ELSE 'env' END AS own,
    unnest(CASE question_type WHEN 'weather' THEN ['env'] WHEN 'pedestrian_action' THEN ['ped_dynamic', 'visual', 'vehicle'] WHEN 'other' THEN ['env'] ELSE ['joint', 'qwen35', 'geometry'] END) AS source FROM asked),
s AS (SELECT inp.id, v.letter, count(*)::BIGINT AS score FROM inp JOIN v ON v.id = inp.id AND v.source = inp.source GROUP BY ALL),
o AS (SELECT DISTINCT inp.id, v.letter AS own FROM inp JOIN v ON v.id = inp.id AND v.source = inp.own),
b AS (SELECT s.id, s.letter, s.score, row_number() OVER (PARTITION BY s.id ORDER BY s.score DESC, (s.letter = coalesce(o.own, 'a')) DESC, s.letter) AS r FROM s LEFT JOIN o ON o.id = s.id)
SELECT a.id, coalesce(b.letter, a.general) AS letter, coalesce(b.score, 0)::BIGINT AS score FROM asked a LEFT JOIN b ON b.id = a.id AND b.r = 1""",
    "first_disputed": f"WITH {VOTES_SQL}, {FALLBACK_SQL}, d AS (SELECT id FROM v GROUP BY id HAVING count(DISTINCT letter) > 1) SELECT id, ord FROM f SEMI JOIN d USING (id) ORDER BY ord LIMIT 3",
    "box_text_features": f"""WITH {TRACKS_SQL}, b AS (SELECT track, role, image_id % 700 AS x1, image_id % 500 AS y1, ord % 900 AS x2, ord % 800 AS y2 FROM t)
SELECT track, role, round(avg((x1 + x2) / 2.0::DOUBLE), 4) AS cx, round(avg((y1 + y2) / 2.0::DOUBLE), 4) AS cy, round(avg((greatest(0, x2 - x1) * greatest(0, y2 - y1))::DOUBLE), 4) AS area FROM b GROUP BY ALL""",
    "clip_errors": """WITH e AS (SELECT event_id AS ord, '/clips/' || event_id || '.mp4' AS clip_path, event_id % 11 = 0 AS gone, event_id % 5 AS size, nullif(event_id % 7, 3) - 1.0 AS duration, event_id % 3 AS frames FROM events),
c AS (SELECT ord, clip_path, CASE WHEN gone THEN 'missing' WHEN size = 0 THEN 'zero_bytes' WHEN duration IS NULL THEN 'ffprobe_failed' WHEN duration <= 0 THEN 'non_positive_duration' WHEN frames <= 0 THEN 'zero_decodable_frames' END AS error FROM e)
SELECT * FROM c WHERE error IS NOT NULL""",
}
