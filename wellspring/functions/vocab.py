"""Word lists and thresholds the results depend on.

FIXED VALUES: the lists below must equal the reference's lists for equal
results; they are stated as plain text, in their natural order.
"""

# --- fixed values: text placeholders treated as missing -------------------
DELETED_VALUES = ["[deleted]", "[removed]", "[deleted by user]", "nan", ""]

# --- fixed values: keyword themes for corpus labelling (5 themes) ---------
KEYWORD_THEMES = {
    "burnout": [
        "stress", "exhausted", "overwhelmed", "burned out", "burnout",
        "drained", "breaking point", "mental health",
    ],
    "physical_demands": [
        "pain", "fatigue", "physically demanding", "injury", "hurt",
        "sore", "back pain", "repetitive strain", "carpal tunnel",
    ],
    "management_issues": [
        "micromanage", "poor leadership", "unfair", "favoritism",
        "toxic manager", "no support", "abusive", "retaliation",
    ],
    "workload": [
        "pressure", "quotas", "overtime", "understaffed", "overworked",
        "too much work", "mandatory overtime", "short staffed",
    ],
    "environment": [
        "toxic", "hostile", "negative culture", "hostile environment",
        "terrible culture", "unsafe", "dangerous",
    ],
}

# --- fixed values: complaint pre-filter constants (declared, no caller) ---
COMPLAINT_KEYWORDS = [
    "hate my job", "toxic", "unsafe", "injury", "injured",
    "overtime", "mandatory overtime", "overworked",
    "understaffed", "short staffed",
    "minimum wage", "no raise", "no benefits",
    "bully", "harassed", "abusive", "write up", "pip",
    "burnout", "burned out", "quit", "quitting",
]
COMPLAINT_FLAIRS = [
    "rant", "vent", "venting", "storytime", "story time",
    "bad boss", "wage theft", "quit", "i quit", "success (i quit)",
    "advice", "need advice", "question", "rant/vent", "discussion",
]
COMPOUND_PREFILTER_THRESHOLD = -0.05

# --- fixed values: check-in debrief domains (5 domains) --------------------
CHECKIN_BURNOUT_THEMES = {
    "exhaustion": [
        "exhausted", "drained", "wiped out", "no energy", "can't go on",
        "running on empty", "dead on my feet", "worn out", "burnt out",
        "nothing left", "empty", "depleted",
    ],
    "mental_distance": [
        "don't care", "checked out", "going through the motions",
        "numb", "disconnected", "not present", "zoned out", "autopilot",
        "couldn't care less", "just a job",
    ],
    "cognitive_impairment": [
        "can't think", "brain fog", "can't concentrate", "forgetful",
        "making mistakes", "slow", "confused", "can't focus",
        "keep forgetting", "head isn't in it",
    ],
    "emotional_impairment": [
        "frustrated", "irritable", "snapping", "short tempered",
        "angry", "upset", "overwhelmed", "on edge", "lost my patience",
    ],
    "disengagement": [
        "don't want to be here", "hate this job", "quit", "leaving",
        "not worth it", "given up", "counting down", "just a number",
        "don't care anymore", "looking for something else",
    ],
}

# --- fixed values: keyword theme -> scale domain (debrief analysis) -------
THEME_TO_DOMAIN = {
    "burnout": "exhaustion",
    "physical_demands": "exhaustion",
    "workload": "cognitive_impairment",
    "management_issues": "disengagement",
    "environment": "emotional_impairment",
}

# --- fixed values: warehouse vs corporate role terms ----------------------
WAREHOUSE_TERMS = [
    "warehouse", "fulfillment", "fc", "picker", "packer", "stower",
    "sorter", "loader", "unloader", "forklift", "dock", "conveyor",
    "delivery", "driver", "handler", "shipping", "receiving",
    "distribution center", "sort center", "logistics",
]
CORPORATE_TERMS = [
    "corporate", "office", "manager", "director", "engineer",
    "software", "hr ", "human resources", "analyst", "marketing",
    "finance", "legal", "executive", "vp ", "vice president",
]

# --- fixed values: terms of a warehouse role in a job title -----------------
TITLE_WAREHOUSE_TERMS = [
    "warehouse", "fulfillment", "picker", "packer", "stower",
    "sorter", "loader", "unloader", "forklift", "associate",
    "tier 1", "tier 3", "fc", "delivery", "driver", "handler",
    "operations", "logistics", "shipping", "receiving",
]

# --- fixed values: companies kept by the company-scoped review reader -------
TARGET_COMPANIES = [
    "amazon", "walmart", "target", "ups", "fedex", "usps",
    "xpo", "xpo logistics", "dhl", "home depot", "lowe",
    "costco", "kroger", "dollar general", "dollar tree",
    "sysco", "chewy", "wayfair", "chewy.com",
    "fulfillment", "warehouse", "distribution",
]

# --- fixed values: sub-forums and keywords of posts about work --------------
TARGET_CHANNELS = [
    "warehouseworkers", "warehousing", "amazonfc", "fulfillmentcenter",
    "walmart", "target", "upsdrivers", "fedex", "usps",
    "manufacturing", "antiwork", "workreform", "workplace", "jobs",
    "talesfromretail", "talesfromyourserver",
]
WORK_KEYWORDS = [
    "warehouse", "manager", "boss", "shift", "quota", "overtime",
    "pay", "wage", "hours", "fired", "quit", "burnout", "exhausted",
    "injury", "forklift", "amazon", "ups", "fedex", "usps", "walmart",
    "worker", "employee", "job", "work", "coworker", "schedule",
]

# --- fixed values: companies named in a text; a later one overrides ---------
# words and phrases, whole words only; "." stands for any one character
COMPANY_MENTIONS = [
    ("Amazon", ["amazon", "afc", "fulfillment center"]),
    ("Walmart", ["walmart", "sam.s club"]),
    ("UPS", ["ups", "united parcel"]),
    ("FedEx", ["fedex", "fed ex"]),
    ("USPS", ["usps", "post office", "mail carrier"]),
    ("Target", ["target"]),
]

# --- fixed values: sub-forum groups (sector categories) --------------------
SUBREDDIT_GROUPS = {
    "warehouse": ["Warehouseworkers", "Warehousing", "AmazonFC", "walmart", "Target"],
    "shipping": ["UPS", "FedEx", "USPS"],
    "manufacturing": ["manufacturing"],
    "general": [
        "antiwork", "WorkReform", "Workplace", "jobs",
        "TalesFromRetail", "TalesFromYourServer",
    ],
}

# --- fixed values: sentiment label thresholds -----------------------------
POLARITY_POSITIVE = 0.1
POLARITY_NEGATIVE = -0.1
COMPOUND_POSITIVE = 0.05
COMPOUND_NEGATIVE = -0.05

# --- fixed values: published VADER rules (Hutto & Gilbert, 2014) -------------
# A booster changes the strength of a word up to three places later, a negation
# turns it; the farther ones count less.
BOOSTER_STEP = 0.293
BOOSTER_FADE = [1.0, 0.95, 0.9]
NEGATION_FACTOR = -0.74
BOOSTERS_UP = [
    "absolutely", "amazingly", "awfully", "completely", "considerably", "decidedly",
    "deeply", "enormously", "entirely", "especially", "exceptionally", "extremely",
    "fully", "greatly", "highly", "hugely", "incredibly", "intensely", "majorly",
    "more", "most", "particularly", "purely", "quite", "really", "remarkably", "so",
    "substantially", "thoroughly", "totally", "tremendously", "unbelievably",
    "unusually", "utterly", "very",
]
BOOSTERS_DOWN = [
    "almost", "barely", "hardly", "kinda", "less", "little", "marginally",
    "occasionally", "partly", "scarcely", "slightly", "somewhat", "sorta",
]
NEGATIONS = [
    "aint", "arent", "cannot", "cant", "couldnt", "despite", "didnt", "doesnt", "dont",
    "hadnt", "hasnt", "havent", "isnt", "mightnt", "mustnt", "neither", "never", "none",
    "nope", "nor", "not", "nothing", "nowhere", "rarely", "seldom", "shouldnt", "uhuh",
    "wasnt", "werent", "without", "wont", "wouldnt",
]

# --- fixed values: debrief signal strengths ---------------------------------
THEME_STRENGTH = 0.5
STRENGTH_CAP = 1.0
NEGATIVE_FACTOR = 1.3

# --- fixed values: peak-season months by worker sector ---------------------
PEAK_SEASON_MONTHS = {
    "warehouse": [10, 11, 12, 1],
    "retail": [11, 12, 1],
    "general": [],
}
