"""Word lists, rule tables and patterns that results depend on."""

# Phase names and their numbers.
PHASE_NUMBERS = {
    "prerecognition": "0",
    "pre-recognition": "0",
    "recognition": "1",
    "judgement": "2",
    "judgment": "2",
    "action": "3",
    "avoidance": "4",
}
# The order in which phases are listed.
PHASE_ORDER = ("4", "3", "2", "1", "0")

LETTERS = ("a", "b", "c", "d", "e")

# Question types whose answer holds for a whole scenario.
STABLE_TYPES = ("weather_lighting", "road_surface", "obstacle", "pedestrian_attribute", "pedestrian_clothing", "road_context", "environment_other")
# Those among them for which answer priors are used.
PRIOR_TYPES = ("weather_lighting", "road_surface", "obstacle", "pedestrian_attribute", "pedestrian_clothing", "road_context")

# Wording of stable questions.
STABLE_PATTERNS = (
    "age group", "gender", "height of the pedestrian", "hat", "glasses", "walking cane", "waling cane", "wearing", "wearning", "clothing",
    "clothes", "color of the vehicle", "vehicle color", "type of vehicle", "vehicle type", "weather", "brightness", "road surface",
    "road inclination", "surface type", "traffic light", "sidewalk", "street lights", "lanes", "guardrail", "roadside strip",
    "formation of the road", "setting",
)
# Wording of questions whose answer changes between phases.
DYNAMIC_PATTERNS = ("orientation", "position", "relative distance", "line of sight", "visual status", "awareness", "direction of travel", "speed", "action", "field of view")

# Question wording to type in the environment scope; first match wins.
ENVIRONMENT_TYPES = (
    ("weather_lighting", ("weather", "brightness"), ()),
    ("road_surface", ("road surface", "road inclination", "surface type"), ()),
    ("obstacle", ("obstacle",), ()),
    ("pedestrian_attribute", ("age group", "height of the pedestrian", "walking cane", "waling cane"), ("hat", "glasses")),
    ("pedestrian_clothing", ("wearing", "wearning", "clothing"), ()),
    ("road_context", ("traffic", "type of the road", "lanes", "sidewalk", "street lights", "roadside strip", "guardrail", "formation of the road", "setting"), ()),
)
# Question wording to type in the other scopes; first match wins.
PHASE_TYPES = (
    ("vehicle_fov", ("vehicle's field of view",)),
    ("vehicle_action", ("action taken by vehicle",)),
    ("vehicle_position", ("position of the vehicle relative",)),
    ("vehicle_distance", ("relative distance of vehicle",)),
    ("pedestrian_orientation", ("orientation of the pedestrian",)),
    ("pedestrian_position", ("position of the pedestrian relative",)),
    ("pedestrian_distance", ("relative distance of pedestrian",)),
    ("pedestrian_line_of_sight", ("line of sight",)),
    ("pedestrian_attention", ("visual status", "awareness")),
    ("pedestrian_direction", ("direction of travel",)),
    ("pedestrian_speed", ("pedestrian's speed",)),
    ("pedestrian_action", ("pedestrian's action", "fine-grained action")),
)

# Question wording to fact key in the environment scope; first match wins.
ENVIRONMENT_FACTS = (
    ("age group", "pedestrian.age_group"),
    ("height of the pedestrian", "pedestrian.height"),
    ("wearing on upper body", "pedestrian.upper_body_type"),
    ("upper body clothing", "pedestrian.upper_body_color"),
    ("wearing on lower body", "pedestrian.lower_body_type"),
    ("lower body clothing", "pedestrian.lower_body_color"),
    ("weather", "environment.weather"),
    ("brightness", "environment.brightness"),
    ("road surface conditions", "road.surface_condition"),
    ("road inclination", "road.inclination"),
    ("surface type of the road", "road.surface_type"),
    ("volume of the traffic", "road.traffic_volume"),
    ("type of the road", "road.road_type"),
    ("how many lanes", "road.lane_count"),
    ("formation of the road", "road.formation"),
)
# Question wording to fact key in the other scopes; first match wins.
PHASE_FACTS = (
    (("position of the pedestrian relative",), "pedestrian.position_relative_to_vehicle"),
    (("orientation of the pedestrian",), "pedestrian.body_orientation"),
    (("relative distance of pedestrian",), "pedestrian.distance_to_vehicle"),
    (("pedestrian's line of sight",), "pedestrian.line_of_sight"),
    (("pedestrian's visual status",), "pedestrian.visual_status"),
    (("pedestrian's direction of travel",), "pedestrian.direction_of_travel"),
    (("pedestrian's awareness",), "pedestrian.awareness_of_vehicle"),
    (("fine-grained action taken by the pedestrian",), "pedestrian.fine_grained_action"),
    (("pedestrian's action",), "pedestrian.action"),
    (("pedestrian's speed", "pedestrian speed"), "pedestrian.speed"),
    (("position of the vehicle relative",), "vehicle.position_relative_to_pedestrian"),
    (("relative distance of vehicle",), "vehicle.distance_to_pedestrian"),
    (("vehicle's field of view",), "vehicle.field_of_view"),
    (("action taken by vehicle", "vehicle action"), "vehicle.action"),
    (("vehicle's speed", "speed of the vehicle", "vehicle speed"), "vehicle.speed"),
)

# Sources that vote on each question type, in order of trust.
ROUTES = {
    "weather_lighting": ("env", "joint", "qwen35", "best"),
    "road_surface": ("env", "joint", "qwen35", "best"),
    "obstacle": ("env", "geometry", "joint", "best"),
    "pedestrian_attribute": ("env", "joint", "qwen35", "best"),
    "pedestrian_clothing": ("env", "joint", "qwen35", "best"),
    "road_context": ("env", "joint", "qwen35", "best"),
    "environment_other": ("env", "joint", "qwen35", "best"),
    "vehicle_fov": ("vehicle", "visual", "joint", "best"),
    "vehicle_action": ("vehicle", "visual", "joint", "best"),
    "vehicle_position": ("geometry", "vehicle", "visual", "joint", "best"),
    "vehicle_distance": ("geometry", "vehicle", "visual", "joint", "best"),
    "pedestrian_orientation": ("geometry", "visual", "joint", "best"),
    "pedestrian_position": ("geometry", "visual", "joint", "best"),
    "pedestrian_distance": ("geometry", "visual", "joint", "best"),
    "pedestrian_line_of_sight": ("ped_dynamic", "visual", "joint", "best"),
    "pedestrian_attention": ("ped_dynamic", "visual", "joint", "best"),
    "pedestrian_direction": ("ped_dynamic", "visual", "joint", "best"),
    "pedestrian_speed": ("ped_dynamic", "visual", "joint", "best"),
    "pedestrian_action": ("ped_dynamic", "visual", "joint", "best"),
    "phase_other": ("joint", "visual", "best"),
}
# Weights of the sources, in hundredths.
ROUTE_WEIGHTS = {"best": 100, "joint": 115, "qwen35": 110, "visual": 105, "env": 130, "vehicle": 130, "ped_dynamic": 130, "geometry": 130}

# Presets of the calibrated router.
ROUTER_MODES = {
    "high_precision": {"min_n": 25, "min_acc": 0.72, "margin": 0.035, "support": 2, "change_cap": 0.035},
    "balanced": {"min_n": 20, "min_acc": 0.68, "margin": 0.015, "support": 1, "change_cap": 0.065},
    "aggressive": {"min_n": 12, "min_acc": 0.62, "margin": -0.005, "support": 1, "change_cap": 0.100},
}

# Text that leaks from prompts and overlays into captions.
ARTIFACT_TERMS = ("caption_pedestrian", "caption_vehicle", "retrieved synthetic", "retrieved annotation", "vqa fact context", "return json", "bbox context", "yellow", "orange", "cyan", "lime")
# Words that suit each phase.
PHASE_CUES = {
    "4": ("collid", "avoid", "brak", "emergency", "stationary", "stopped", "impact", "speed"),
    "3": ("action", "speed", "turn", "straight", "brak", "moving", "slowing"),
    "2": ("aware", "unaware", "notice", "judg", "closely watched", "line of sight"),
    "1": ("recogn", "notice", "line of sight", "visual", "attention"),
    "0": ("approach", "pre", "prior", "before", "position", "distance"),
}
# Colours.
COLOURS = ("black", "white", "red", "blue", "green", "yellow", "orange", "gray", "grey", "brown", "beige", "cyan", "purple", "pink")
# Endings that leave a sentence open.
BAD_TAILS = (
    "there is", "there are", "there was", "there were", "with", "and", "or", "of", "an", "a", "the", "to", "to the", "in", "in the", "on", "on the",
    "at", "at a", "at the", "from", "from the", "which", "that", "as", "for", "while", "during", "diagonally to the right", "diagonally to the left",
)

# Facts a rewrite must keep, as terms and as patterns.
PROTECTED_TERMS = (
    "obstacle", "sidewalk", "roadside strip", "street light", "street lights", "residential road", "asphalt", "dry", "wet", "level", "slope",
    "cloudy", "sunny", "rainy", "dim", "bright", "black", "white", "blue", "navy", "beige", "gray", "grey", "red", "green", "yellow",
)
PROTECTED_PATTERNS = (
    r"\b\d+\s*km/h\b",
    r"\b\d+\s*meters?\s+in\s+height\b",
    r"\b\d+\s*meters?\s+in\s+width\b",
    r"\b\d+\s*cm\b",
    r"\b(?:one|two)-way traffic\b",
    r"\b(?:light|usual|heavy)\s+traffic(?:\s+volume)?\b",
)
#: What every match of each pattern holds, found without a pattern.
PROTECTED_PARTS = ("km/h", "height", "width", "cm", "-way traffic", "traffic")
# Faults that reject a rewrite, by name.
FAULT_PATTERNS = (
    ("prompt_artifact", r"(?i)(caption_pedestrian|caption_vehicle|locked fact|segment notes|return json|target segment|complete description)"),
    ("bad_ending", r"(?i)(\b(and|or|with|of|in|on|to|from|as|which|that|while|because|where|clear and)\.?)$"),
    ("role_self", r"(?i)(pedestrian\s+(?:is|was)?\s*positioned[^.]{0,80}\bin front of the pedestrian|vehicle\s+(?:is|was)?\s*positioned[^.]{0,80}\bin front of the vehicle)"),
    ("driver_aware", r"(?i)\bdriver\b.{0,40}\b(aware|noticed|mindful|saw)\b"),
    ("zero_collision", r"(?i)(0\s*km/h.{0,80}collid|collid.{0,80}0\s*km/h)"),
    ("fragment", r"(?i)(measuring\s+\d+\s+meters\s+in\s+(?:height|width)\s+and\.|\bThere is\.|\bstood still on a clear and\.|\bbut not both sides\.|\bin front of the road\.|\bhas a cloudy field of view\b)"),
)
# Words that make a caption better.
QUALITY_TERMS = ("pedestrian", "vehicle", "weather", "road", "traffic", "speed", "line of sight")
# Least and greatest length ratio and least gain of each gate.
GATE_POLICIES = {"repair": (0.90, 1.20, -0.20), "strict": (0.96, 1.08, 0.20), "moderate": (0.90, 1.15, 0.08), "loose": (0.84, 1.22, -0.05)}

# Answers that mean the same.
ANSWER_ALIASES = {"none": "no", "n/a": "no", "normal": "usual"}
# Misspelt question wording and its right form.
QUESTION_TYPOS = (("wearning", "wearing"), ("waling cane", "walking cane"))

# Wording of context and attention, and of each phase, that a rewrite is credited for.
CONTEXT_TERMS = ("weather", "brightness", "road surface", "asphalt", "residential", "two-way", "traffic volume", "sidewalk", "street light", "dry", "cloudy", "dim", "level")
ATTENTION_TERMS = ("line of sight", "noticed", "aware", "unaware", "attention", "looking", "field of view", "visual", "closely watching")
PHASE_TERMS = {
    "0": ("unaware", "presence", "looking around", "approached", "prior"),
    "1": ("noticed", "aware", "line of sight", "recognized", "presence"),
    "2": ("planned", "continue", "straight", "judgment", "intended"),
    "3": ("action", "speed", "slowed", "braked", "stopped", "moving"),
    "4": ("avoidance", "avoid", "close", "near", "collision", "passed"),
}

# Opening text of prompts.
CAPTION_SYSTEM = "You are a traffic safety video-language model. Generate grounded, fine-grained captions only from the visual evidence. Preserve the traffic-safety checklist style: location, attention, behavior, and context."
VQA_SYSTEM = "You are a traffic safety visual question answering model. Answer the multiple-choice question from the visual evidence and return only the option letter."
# The marker before which context goes into a prompt.
RETURN_JSON = "Return JSON with exactly these keys:"
CAPTION_KEYS_TEXT = "- labels: list containing the phase label\n- caption_pedestrian: one detailed sentence group about the pedestrian\n- caption_vehicle: one detailed sentence group about the vehicle"
# Keys under which a prediction's text may stand, in order.
PREDICTION_KEYS = ("predict", "prediction", "response", "output", "generated_text", "text")

# The order of a caption's slots, and the wording that puts a sentence into one.
SLOTS = ("location", "attention", "behavior", "context", "other")
SLOT_CONTEXT = ("weather", "brightness", "road", "surface", "asphalt", "traffic", "sidewalk", "roadside", "street light", "environment", "lane")
SLOT_ATTENTION = ("line of sight", "watch", "aware", "notice", "visual", "look", "gaze", "attention")
SLOT_LOCATION = (
    "position", "distance", "near", "close", "far", "front", "left", "right", "diagonal", "perpendicular", "opposite", "height", "wearing",
    "t-shirt", "shirt", "slacks", "pants", "vehicle is visible", "field of view", "age group",
)
SLOT_STRONG_BEHAVIOR = ("speed", "collision", "collided", "brak", "turn", "stopped", "action", "behavior")
SLOT_BEHAVIOR = ("going", "travel", "walking", "moving", "cross", "standing")
# Words that don't show that a text supports a sentence.
UNSUPPORTING = ("pedestrian", "vehicle", "road", "environment", "context", "distance", "positioned", "surface", "with", "from", "that", "this", "were", "around")
# Colours that may clash in an added sentence.
CLASH_COLOURS = ("black", "white", "red", "blue", "green", "yellow", "orange", "gray", "grey", "brown", "beige", "navy", "purple", "pink", "cyan")
# Prompt text that marks a rewrite as unusable.
REWRITE_ARTIFACTS = ("caption_pedestrian", "caption_vehicle", "return json", "bbox context", "visual grounding note")
# Facts that templates speak of.
TEMPLATE_FACTS = (
    "pedestrian.age_group", "pedestrian.height", "pedestrian.upper_body_type", "pedestrian.upper_body_color", "pedestrian.lower_body_type", "pedestrian.lower_body_color",
    "pedestrian.body_orientation", "pedestrian.position_relative_to_vehicle", "pedestrian.distance_to_vehicle", "pedestrian.line_of_sight", "pedestrian.visual_status",
    "pedestrian.awareness_of_vehicle", "pedestrian.action", "pedestrian.fine_grained_action", "pedestrian.direction_of_travel", "pedestrian.speed",
    "vehicle.position_relative_to_pedestrian", "vehicle.distance_to_pedestrian", "vehicle.field_of_view", "vehicle.action", "vehicle.speed",
    "environment.weather", "environment.brightness", "road.surface_condition", "road.inclination", "road.surface_type", "road.road_type", "road.lane_count", "road.traffic_volume",
)
# Terms and patterns that the learned ranker counts as protected.
RANKER_TERMS = (
    "pedestrian", "vehicle", "obstacle", "sidewalk", "roadside strip", "street light", "residential road", "intersection", "signal", "asphalt", "two-way traffic", "one-way traffic",
    "0 km/h", "5 km/h", "10 km/h", "20s", "30s", "40s", "male", "female", "cloudy", "clear", "bright", "dim", "dry", "wet",
)
RANKER_PATTERN = r"\b\d+\s*(?:km/h|cm|meters?)\b"
RANKER_BAD_TAIL = r"(?i)\b(and|or|with|of|in|on|to|which|that|there is)\.?$"

# Wording of sentences about the surroundings.
CONTEXT_SENTENCES = ("weather", "brightness", "road surface", "traffic volume", "sidewalk", "asphalt")
# Attributes and what a spoilt caption says instead, in order.
SWAPS = (("male", "female"), ("female", "male"), ("20s", "70s"), ("30s", "60s"), ("clear", "cloudy"), ("cloudy", "clear"), ("bright", "dim"), ("dim", "bright"), ("close", "far"), ("far", "close"))
# Opening lines of prompt variants.
PROMPT_VARIANTS = {
    "direct": ("Answer the traffic-safety multiple-choice question from the videos.", "Return exactly one lowercase option letter."),
    "evidence": ("Choose the answer best supported by visible traffic-scene evidence.", "Compare every option against the video evidence before deciding.", "Return exactly one lowercase option letter."),
    "anti-prior": ("Answer only from visible evidence, not demographic or traffic priors.", "If options are visually similar, choose the option with strongest direct evidence.", "Return exactly one lowercase option letter."),
}
