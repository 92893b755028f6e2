"""Lists, tables, patterns and formats that decide results.

They are data, stated as they must be for results to agree. Every operator takes them as arguments, so a
caller can supply a table of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --- fixed values: stop words of the term builder (Turkish, then English) ---
STOP_WORDS = (
    "ve ile de da mi mı mu mü bir bu şu o çok cok gibi icin için ya ama fakat ancak ki ise neden niye "
    "nasıl nasil ne var yok olan olmak olması olmasi kadar hakkında hakkinda üzerine uzerine üzerinde "
    "uzerinde "
    "the a an and or of in on to for by is are with from about how what why when where who does should "
    "could"
).split()

# --- fixed values: letters kept by the tokeniser besides ASCII, and their ASCII forms ---
TURKISH_LETTERS = "çğışöüÇĞİÖŞÜ"
TURKISH_ASCII = "cgisouCGIOSU"
TOKEN_PUNCTUATION = "+#-/_."

# --- fixed values: suffixes a lookup key may lose ---
SUFFIXES = (
    "lari leri lar ler nin nın nun nün in ın un ün si sı su sü da de ta te dan den tan ten ya ye yla yle "
    "li lı lu lü"
).split()

# --- fixed values: synonyms, each line a word or phrase and its search variants ---
SYNONYMS = {
    "ilmi": ["physiognomy", "face reading", "face analysis"],
    "sima": ["physiognomy", "face reading"],
    "ilmi sima": ["physiognomy", "face reading", "face mapping"],
    "yüz okuma": ["face reading", "physiognomy"],
    "mobil": ["mobile", "mobile app", "mobile application"],
    "uygulama": ["app", "application", "mobile app"],
    "uygulama özellikler": ["app features", "feature set", "product requirements"],
    "özellikler": ["features", "feature set"],
    "kullanıcı": ["user", "users"],
    "deneyimi": ["experience", "user experience"],
    "kullanıcı deneyimi": ["user experience", "ux", "ux research", "ux design"],
    "tasarım": ["design", "app design", "ui design", "ux design"],
    "performans": ["performance", "app performance", "performance optimization"],
    "güvenlik": ["security", "app security", "mobile security", "data privacy"],
    "yenilikçilik": ["innovation", "innovative features", "innovation strategy"],
    "uygulama geliştirme": ["application development", "product development", "mobile development"],
    "geliştirme": ["development", "application development"],
    "yapay zeka": ["artificial intelligence", "ai"],
    "sesli komut": ["voice control", "voice commands", "speech recognition"],
    "haptik": ["haptic", "haptic technology", "haptic glove"],
    "haptic": ["haptic", "haptic technology", "haptic glove"],
    "haptik eldiven": ["haptic glove", "vr glove", "haptic wearable"],
    "haptic glove": ["haptic glove", "vr glove", "haptic wearable"],
    "eldiven": ["glove", "wearable glove", "smart glove"],
    "eldivenin": ["glove", "wearable glove", "smart glove"],
    "pazar": ["market", "market landscape"],
    "pazarı": ["market", "market landscape"],
    "market": ["market", "market positioning"],
    "markette": ["market", "market positioning"],
    "marketteki": ["market", "market positioning"],
    "yeri": ["positioning", "market position"],
}

# --- fixed values: communities offered when a search finds nothing, by word stem ---
FALLBACK_COMMUNITIES = {
    "physiognomy": ["r/physiognomy", "r/faceanalysis", "r/bodylanguage"],
    "face": ["r/physiognomy", "r/faceanalysis", "r/AskPsychology"],
    "mobile": ["r/MobileApps", "r/AppIdeas", "r/androiddev", "r/iOSProgramming"],
    "ux": ["r/userexperience", "r/UXResearch", "r/UXDesign", "r/userexperience_design"],
    "product": ["r/ProductManagement", "r/ProductDesign", "r/ProductMarketing"],
    "security": ["r/cybersecurity", "r/techsupport", "r/netsecstudents"],
    "innovation": ["r/Futurology", "r/startups", "r/Entrepreneur"],
    "haptic": ["r/virtualreality", "r/VRGaming", "r/HapticTech", "r/AR_MR_XR", "r/wearables"],
    "glove": ["r/virtualreality", "r/oculus", "r/HapticTech", "r/engineering"],
    "vr": ["r/virtualreality", "r/VRGaming", "r/SteamVR", "r/oculus"],
}

# --- fixed values: communities curated by prompt word ---
CURATED_COMMUNITIES = {
    "ai": ["r/MachineLearning", "r/artificial", "r/LocalLLaMA", "r/datascience"],
    "wellness": ["r/wellness", "r/selfimprovement", "r/productivity", "r/Meditation", "r/Anxiety"],
    "meditation": ["r/Meditation", "r/mindfulness", "r/selfimprovement"],
    "anxiety": ["r/Anxiety", "r/mentalhealth", "r/DecidingToBeBetter"],
    "productivity": ["r/productivity", "r/selfimprovement", "r/GetDisciplined", "r/lifehacks"],
}

# --- fixed values: blocklists of discovery, seeding and vetting ---
DISCOVERY_BLOCKLIST = ["r/all", "r/popular", "r/askreddit"]
SEED_BLOCKLIST = [
    "r/technology", "r/science", "r/worldnews", "r/news", "r/all", "r/popular", "r/askreddit",
]
VETTING_BLOCKLIST = [
    "r/Apps", "r/technology", "r/health", "r/fitness", "r/all", "r/popular", "r/AskReddit",
]

# --- fixed values: report types and the prompt words that select them, first hit wins ---
REPORT_TYPES = {
    "market": ["market", "pricing", "monetization"],
    "competitor": ["competitor", "vs", "alternative"],
    "trend": ["trend", "spike", "decline"],
    "sentiment": ["sentiment", "opinion", "review"],
    "ideation": ["idea", "ideation", "pg"],
}
DEFAULT_REPORT_TYPE = "faq"

# --- fixed values: search terms used when a prompt yields none ---
DEFAULT_TERMS = ["technology", "innovation", "product"]

# --- fixed values: complaint patterns, applied to lower-cased text in this order ---
COMPLAINT_PATTERNS = [
    r"i (?:tried|used) ([^.,;:]+?) but ([^.;]+)",
    r"i wish (?:there was|there were) ([^.;]+)",
    r"it doesn't work because ([^.;]+)",
    r"i can't ([^.;]+)",
]

# --- fixed values: notes on how well the evidence covers a prompt ---
COVERAGE_EMPTY = "No data points available after scraping."
COVERAGE_NONE = (
    "No posts mention the targeted keywords; insights must come from adjacent evidence or next steps."
)
COVERAGE_THIN = "Very limited evidence; treat findings as directional only."
COVERAGE_GOOD = "Sufficient evidence from matched posts to ground insights."
NO_SAMPLES = "- No directly matched posts. Consider broader data collection."

# --- fixed values: limits ---
SEARCH_TERM_CAP = 16
KEYWORD_CAP = 24
FOCUS_BASE_CAP = 48
FOCUS_CAP = 32
MIN_SUBSCRIBERS = 10_000
MIN_TEXT_LENGTH = 20
ENGLISH_SHARE = 0.7
SECONDS_PER_MONTH = 30 * 86_400

# --- fixed values: permalink format ---
PERMALINK_SITE = "https://www.reddit.com"

# --- fixed values: evidence context template, filled once per plan ---
EVIDENCE_TEMPLATE = """Context:
- User prompt: %s
- Report type: %s
- Subreddits: %s
- Params: months=%s, min_upvotes=%s, limit=%s
- Seed filters -> must: %s; should: %s; exclude: %s; languages: %s
- Keyword focus terms: %s
- Topic themes: %s
- Warnings: %s
- Matched posts: %s/%s
- Data coverage: %s
- Sample posts:
%s"""

# --- fixed values: planning context template, filled once per prompt ---
PLANNING_TEMPLATE = """Prompt: %s
Report type hint: %s
Max subreddits: %s
Defaults: months=%s, min_upvotes=%s, limit=%s
Candidate subreddits from search: %s"""

# --- fixed values: rules of the published rule-based sentiment model (Hutto & Gilbert 2014), from memory ---
BOOST = 0.293
BOOST_DECAY = (1.0, 0.95, 0.9)
NEGATION_FACTOR = -0.74
CAPITALS_BOOST = 0.733
EXCLAMATION_BOOST, EXCLAMATION_CAP = 0.292, 4
QUESTION_BOOST, QUESTION_CAP_SCORE = 0.18, 0.96
BEFORE_BUT, AFTER_BUT = 0.5, 1.5
NORMALISER = 15.0
AMPLIFIERS = (
    "absolutely amazingly awfully completely considerably decidedly deeply enormously entirely especially "
    "exceptionally extremely fabulously fully greatly highly hugely incredibly intensely majorly more most "
    "particularly purely quite really remarkably so substantially thoroughly totally tremendously "
    "unbelievably unusually utterly very"
).split()
DAMPENERS = (
    "almost barely hardly just enough kinda less little marginally occasionally partly scarcely slightly "
    "somewhat sorta"
).split()
NEGATIONS = (
    "aint arent cannot cant couldnt darent didnt doesnt ain't aren't can't couldn't daren't didn't doesn't "
    "dont hadnt hasnt havent isnt mightnt mustnt neither don't hadn't hasn't haven't isn't mightn't mustn't "
    "neednt needn't never none nope nor not nothing nowhere oughtnt shant shouldnt wasnt werent oughtn't "
    "shan't shouldn't wasn't weren't without wont wouldnt won't wouldn't rarely seldom despite"
).split()

#: A small seed lexicon of our own; real use supplies a full table.
SEED_LEXICON = {
    "trash": -2.0, "scum": -2.9, "idiot": -2.3, "worthless": -1.9, "pathetic": -2.7, "stupid": -2.4,
    "disgusting": -2.4, "broken": -2.1, "crashed": -1.7, "better": 1.9, "please": 1.3,
}


def _quoted(value) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(value, str) else repr(value)


def inline_table(spark: SparkSession, columns: str, rows) -> DataFrame:
    """A few fixed rows as an inline relation, whose exact size the optimizer knows."""
    body = ", ".join("(" + ", ".join(_quoted(v) for v in row) + ")" for row in rows)
    return spark.sql(f"select * from values {body} as fixed({columns})")


def synonym_table(spark: SparkSession, synonyms: dict[str, list[str]] = SYNONYMS) -> DataFrame:
    """``(key, pos, variant)``; keys are lookup keys, so spellings that fold together merge."""
    from postlens.functions.text import lookup_key

    rows = [(word, i, v) for word, variants in synonyms.items() for i, v in enumerate(variants)]
    table = inline_table(spark, "word, pos, variant", rows)
    return table.select(lookup_key(table.word).alias("key"), "pos", "variant")


def lexicon_table(spark: SparkSession, lexicon: dict[str, float] = SEED_LEXICON) -> DataFrame:
    rows = [(token, float(valence)) for token, valence in lexicon.items()]
    table = inline_table(spark, "token, valence", rows)
    return table.select("token", table.valence.cast("double").alias("valence"))


def community_table(spark: SparkSession, mapping: dict[str, list[str]]) -> DataFrame:
    """``(word_pos, word, pos, community)`` from a word → communities mapping, in its own order."""
    rows = [
        (w, word, i, name)
        for w, (word, names) in enumerate(mapping.items())
        for i, name in enumerate(names)
    ]
    return inline_table(spark, "word_pos, word, pos, community", rows)
