"""Parameter tables.  Every operator takes its own; these are the defaults."""

from __future__ import annotations

# --- fixed values: sectors offered, and the searches behind the specialised ones ---
SECTORS = [
    "Technology", "Finance", "Healthcare", "Energy", "Consumer Goods", "Industrial",
    "Utilities", "Real Estate", "Materials", "Communication Services", "Semiconductors",
    "Wearable Technology Sensors", "Supply Chain", "Intellectual Property Litigation",
]

SECTOR_QUERIES = {
    "Semiconductors": [
        "semiconductor industry", "chip manufacturing", "TSMC Intel AMD Nvidia",
        "semiconductor supply chain", "semiconductor technology",
    ],
    "Wearable Technology Sensors": [
        "wearable technology sensors", "health monitoring wearables",
        "fitness tracker sensors", "wearable medical devices", "smart clothing sensors",
    ],
    "Supply Chain": [
        "global supply chain", "logistics and supply chain", "supply chain management",
        "supply chain technology", "supply chain disruption",
    ],
    "Intellectual Property Litigation": [
        "patent litigation", "IP lawsuits", "intellectual property disputes",
        "trademark infringement", "copyright cases",
    ],
}

# --- fixed values: icon and blurb per sector, with the fallbacks ---
SECTOR_META = {
    "Semiconductors": (
        "🔌",
        "Latest developments in semiconductor technology, chip manufacturing, and industry trends",
    ),
    "Wearable Technology Sensors": (
        "⌚",
        "Innovations in wearable sensors, health monitoring, and smart device technology",
    ),
    "Supply Chain": ("📦", "Global supply chain updates, logistics, and industry analysis"),
    "Intellectual Property Litigation": (
        "⚖️",
        "Key patent cases, IP disputes, and legal developments in tech",
    ),
}
DEFAULT_ICON = "📰"
DEFAULT_BLURB_PREFIX = "Latest news and updates in "

# --- fixed values: insight categories and their terms, in rank order ---
TAXONOMY = {
    "merger": ["merger", "acquisition", "acquire", "takeover", "buyout"],
    "partnership": ["partnership", "collaboration", "alliance", "joint venture", "team up"],
    "funding": [
        "funding", "investment", "raise", "series a", "series b", "series c", "funding round",
    ],
    "product": ["launch", "release", "new product", "announce", "introduce"],
    "leadership": ["appoint", "hire", "join", "name", "promote", "resign", "step down"],
    "financial": [
        "revenue", "profit", "loss", "earnings", "financial results", "quarterly results",
    ],
    "regulation": [
        "regulation", "compliance", "lawsuit", "settlement", "fine", "investigation",
    ],
}

# --- fixed values: terms that lift a key phrase / a sentence ---
PHRASE_SIGNALS = [
    "announce", "launch", "develop", "new", "report", "study", "find", "show", "reveal",
]
SENTENCE_SIGNALS = [
    "announce", "launch", "develop", "introduce", "partner", "collaborate", "increase",
    "grow", "expand", "invest", "fund", "raise", "acquire", "merge", "release", "report",
    "according", "show", "reveal", "indicate",
]

# --- fixed values: sentences holding one of these are not shown on a card ---
BOILERPLATE = [
    "no content available", "click here", "read more", "subscribe", "copyright",
    "submitting email", "terms and conditions",
]

# --- fixed values: entity labels kept, those that also count as key phrases ---
ENTITY_LABELS = ["ORG", "PERSON", "GPE", "NORP", "FAC", "PRODUCT", "EVENT"]
PHRASE_ENTITY_LABELS = ["ORG", "PERSON", "GPE", "PRODUCT", "EVENT"]

# --- fixed values: news-specific stop words ---
NEWS_STOPWORDS = [
    "said", "say", "says", "also", "would", "could", "may", "might", "must", "shall",
    "should", "via", "according", "like", "one", "two", "three", "four", "five", "six",
    "seven", "eight", "nine", "ten", "first", "second", "third", "last", "new", "us", "u",
]

# English function words, by part of speech.  Pass ``stopwords=`` to use another list.
FUNCTION_WORDS = (
    # determiners and quantifiers
    "a an the this that these those each every either neither some any no all both few more "
    "most many much several such other another own same "
    # pronouns
    "i me my mine myself you your yours yourself he him his himself she her hers herself it its "
    "itself we our ours ourselves they them their theirs themselves who whom whose which what "
    # be, have, do and modals
    "am is are was were be been being have has had having do does did doing can will cannot "
    # prepositions
    "about above across after against along among around at before behind below beneath beside "
    "between beyond by down during except for from in inside into near of off on onto out "
    "outside over per since through throughout to toward towards under until up upon with "
    "within without "
    # conjunctions and adverbs of grammar
    "and but or nor so yet if because although though while whereas unless than as then "
    "when where why how again further once here there not only too very just even still "
    "ever never now always often"
).split()

STOPWORDS = sorted(set(FUNCTION_WORDS) | set(NEWS_STOPWORDS))

# --- fixed values: layout (inches) and chart limits ---
TWO_UP_SLOTS = [(0.5, 1.5, 6.0, 4.5), (7.0, 1.5, 6.0, 4.5)]
ONE_UP_SLOTS = [(0.5, 1.5, 12.0, 4.5)]
BAR_SPAN_INCHES = 6.0
MAX_BARS = 6
MAX_LEGEND = 5
BAR_COLOURS = ["primary", "secondary", "accent", "success", "warning"]

# --- fixed values: limits ---
MIN_CARD_SENTENCES = 3
MAX_CARD_SENTENCES = 15
DEFAULT_ARTICLES_PER_SECTOR = 5
MAX_ARTICLES_PER_SECTOR = 10
REPLACEMENTS_PER_PROVIDER = 5
LOOKBACK_DAYS = 14
CACHE_TTL_SECONDS = 86_400
ARCHIVE_VERSION = "1.0"

NO_SUMMARY_TEXT = "No sufficient content available for this article."
NO_CONTENT_TEXT = "No content available."
