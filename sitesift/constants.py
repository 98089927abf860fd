"""Fixed values that must equal the reference's for right results.

They are stated here together, as given, and imported where used.
"""

# --- Fixed values (must equal the reference's) -----------------------------

# Missing-value marker written for an empty field.
NA = "N/A"
# Primary key of a partial record kept by soft validation.
PENDING = "N/A - Pending Review"
# Values that count as missing for a required key (after trim + upper case).
EMPTY_MARKERS = ("N/A", "NONE", "")

# Fields that lose a leading number, and the number pattern removed.
TITLE_FIELDS = ("title", "job_title")
TITLE_NUMBER = r"^[0-9]+(\.[0-9]+)?\s*"

# Stop words dropped from keyword counts.
STOP_WORDS = (
    "the", "and", "a", "of", "to", "in", "is", "for", "that", "on", "with", "na", "n",
    "this", "an", "your", "it", "from", "are", "by", "as", "at", "be", "or", "you", "i",
)
# Where the keywords come from: the first of these columns present.
TEXT_COLUMNS = ("tags", "requirements", "text", "job_title")
# The money column: price, else salary.
MONEY_COLUMNS = ("price", "salary")

# First-wins dedup keys of the interim checkpoint (those present).
FIRST_WINS_KEYS = ("title", "job_title", "company", "link", "source_url")
# Silver dedup fallback: source_url plus the first of these present.
TITLE_KEYS = ("title", "job_title", "text")
# Domain label for records without a schema.
GENERAL = "general"

# Crawl planning defaults.
URL_CAP = 160          # URLs per run
MAX_EMPTY = 5          # consecutive empty pages before a crawl halts
CACHE_TTL_HOURS = 4    # age under which a cached copy is fresh
