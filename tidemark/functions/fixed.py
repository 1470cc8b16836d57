"""Names, lists and patterns that results depend on."""

# --- Fixed values: sources, units, factions -------------------------------------------
SOURCES = ("funpay", "g2g", "playerauctions")
# order in which the per-source offer sets are concatenated
SOURCE_ORDER = ("funpay", "g2g", "g2g_retail", "playerauctions")
PRICE_UNITS = ("per_unit", "per_lot", "per_1k")
FACTIONS = ("Horde", "Alliance")
ALL = "All"
DEFAULT_FACTION = "Horde"

# --- Fixed values: thresholds ----------------------------------------------------------
SUSPICIOUS_PER_1K = 500.0
EXPENSIVE_MULTIPLE = 3
POSITION_VALUE_CAP = 9999
MIN_LOT_PRICE = 0.001
MIN_PER_1K = 0.01
WRITE_THRESHOLD = 0.005
WRITE_TTL_SECONDS = 3600
PLATFORM_EXCLUSION = 2.0
PROFILE_MIN_SAMPLE = 3
PROFILE_STALE_SECONDS = 600
QUARANTINE_TAIL = 500
RATE_FRESH_SECONDS = 3600
OUTLIER_MULTIPLE = 3.0
LIQUID_VOLUME = 50_000
VWAP_VOLUME_CAP = 1_000_000
INDEX_TOP_N = 10
# hours covered by the 5-minute and the hourly tier
TIER_5M_HOURS = 168
TIER_1H_HOURS = 720

# --- Fixed values: versions ------------------------------------------------------------
VERSION_ALIASES = {
    "seasonal": "Season of Discovery",
    "season of discovery": "Season of Discovery",
    "sod": "Season of Discovery",
    "anniversary": "Anniversary",
    "classic anniversary": "Anniversary",
    "anniversary gold": "Anniversary",
    "hardcore": "Hardcore",
    "classic era": "Classic Era",
    "vanilla": "Classic",
    "era": "Classic",
    "classic": "Classic",
    "tbc classic": "TBC Classic",
    "tbc": "TBC Classic",
    "burning crusade": "TBC Classic",
    "mop classic": "MoP Classic",
    "mists of pandaria": "MoP Classic",
    "retail": "Retail",
    "midnight": "Retail",
    "the war within": "Retail",
    "tww": "Retail",
}
VERSION_RANKS = {
    "MoP Classic": 0,
    "Retail": 5,
    "Anniversary": 10,
    "Season of Discovery": 20,
    "Classic": 40,
    "Anniversary · Hardcore": 100,
    "Season of Discovery · Hardcore": 110,
    "Classic · Hardcore": 130,
}
UNKNOWN_VERSION_RANK = 99
HARDCORE_SUFFIX = " · Hardcore"
PER_1K_VERSIONS = ("Retail", "MoP Classic")
DEFAULT_GAME_VERSION = "Classic Era"
GAME_VERSION_ORDER = ("Retail", "MoP Classic", "Classic Era")

# --- Fixed values: realms and regions --------------------------------------------------
RU_RETAIL_REALMS = (
    "Ashenvale", "Azuregos", "Blackscar", "Booty Bay", "Borean Tundra",
    "Deathguard", "Deathweaver", "Deephome", "Eversong", "Fordragon",
    "Galakrond", "Goldrinn", "Gordunni", "Greymane", "Grom",
    "Howling Fjord", "Lich King", "Razuvious", "Soulflayer", "Thermaplugg",
)
CURRENCY_SYMBOLS = {"$": "USD", "€": "EUR", "£": "GBP"}
ONLINE_FLAGS = ("1", "true", "yes")
BLANK_SELLERS = ("", "-", "n/a")

# --- Fixed values: patterns (Java regex) -----------------------------------------------
BRACKET_TITLE = r"(?i)^(.+?)\s*\[([A-Za-z]{2,})\s*-\s*([^\]]+?)\]\s*(?:-\s*(Alliance|Horde))?$"
BRACKET_REGION_TITLE = r"(?i)^(.+?)\s*\[([A-Za-z]{2,})\]\s*(?:-\s*(?:Alliance|Horde))?$"
BRACKET_REGION = r"\[([A-Za-z]{2,})\]"
BRACKET_CODE = r"\[([A-Z]{2,}(?:/[A-Z]{2,})?)\]"
REGION_WORD = r"(?i)\b(EU|US|NA|OCE|KR|TW|SEA|RU)\b"
FACTION_END = r"(?i)-\s*(Alliance|Horde)\s*$"
REGION_LABEL = r"^\(([A-Za-z]{2,})\)\s*(.+)$"
GROUP_LABEL = r"^\([A-Z]{2,}\)\s+\S"
BILINGUAL_TITLE = r"(?i)^[^(]+\(([^)]+)\)\s*-\s*(Alliance|Horde)\s*$"
LISTING_ID = r"id=([\d\-]+)"
# registry-side version names, first match wins
VERSION_RULES = (
    (r"(?i)season\s+of\s+discovery|\bseasonal\b|\bsod\b", "Season of Discovery"),
    (r"(?i)anniversary", "Anniversary"),
    (r"(?i)classic\s+era", "Classic Era"),
    (r"(?i)\bclassic\b", "Classic"),
)
UTC_TEXT = "yyyy-MM-dd'T'HH:mm:ss'Z'"
