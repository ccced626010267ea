"""Values that must equal the boards' and the dashboards' own for results to agree.

Plain constants only.  Everything here is fixed: word lists, lookup tables,
patterns, limits.
"""

# --- salary ------------------------------------------------------------------
BASE_CURRENCY = "PLN"
FALLBACK_RATES = {"PLN": 1.0, "USD": 4.0, "EUR": 4.3, "GBP": 5.1, "CHF": 4.5}
HOURS_PER_MONTH = 160
DAYS_PER_MONTH = 20
HOURLY_LIMITS = {"PLN": 500, "USD": 120, "EUR": 120}
EXPLICIT_PERIODS = {
    "hourly": ["hourly", "hour", "h"],
    "daily": ["daily", "day", "d"],
    "monthly": ["monthly", "month", "m"],
    "yearly": ["yearly", "year", "annual"],
}
HOURLY_MARKS = ["/h", "per hour", "hourly", "/godz", "godzin"]
HOURLY_URL_MARK = "usd/h"
DAILY_MARKS = ["/day", "per day", "daily", "/dzie", "dzień"]
PERIOD_KEYS = ["timeUnit", "period", "salaryPeriod"]

# --- categories --------------------------------------------------------------
CATEGORY_NAMES = {
    "agile": "Agile",
    "ai/ml": "AI / ML",
    "architecture": "Architecture",
    "backend": "Backend",
    "businessanalysis": "Business Analysis",
    "businessintelligence": "Business Intelligence",
    "data": "Data",
    "devops": "DevOps",
    "embedded": "Embedded",
    "erp": "ERP",
    "frontend": "Frontend",
    "fullstack": "Fullstack",
    "gamedev": "Game Dev",
    "hr": "HR",
    "mobile": "Mobile",
    "other": "Other",
    "pm": "PM",
    "productmanagement": "Product Management",
    "projectmanager": "Project Manager",
    "security": "Security",
    "support": "Support",
    "testing": "Testing",
    "ux/ui": "UX / UI",
}
URL_CATEGORIES = {
    "ai": "AI",
    "analytics": "Analytics",
    "architecture": "Architecture",
    "backend": "Backend",
    "data": "Data",
    "devops": "DevOps",
    "embedded": "Embedded",
    "erp": "ERP",
    "frontend": "Frontend",
    "fullstack": "Fullstack",
    "game": "Game",
    "mobile": "Mobile",
    "pm": "PM",
    "security": "Security",
    "support": "Support",
    "testing": "Testing",
}
SUFFIX_CATEGORIES = {**URL_CATEGORIES, "other": "Other"}

# --- boards ------------------------------------------------------------------
BOARD_JJ = "justjoin.it"
BOARD_NF = "nofluffjobs.com"
JJ_OFFER_PREFIX = "https://justjoin.it/job-offer/"
NF_OFFER_PREFIX = "https://nofluffjobs.com/pl/job/"
OFFER_LINK = "job-offer/([a-z0-9][a-z0-9-]+)"
PAYLOAD_START = r'(?s)\{"slug":"[^"]+","title":"[^"]+","experienceLevel".*'
NICE_TILE_TYPES = ["nice_to_have", "optional", "niceToHave"]
MAX_SKILL_LENGTH = 50
REQUIRED_HEADINGS = ["required", "obowiązkowe", "must have", "wymagane"]
NICE_HEADINGS = ["nice to have", "mile widziane", "optional", "opcjonalne"]
NF_REQUIRED_HEADINGS = ["obowiązkowe", "required", "must have"]
NF_NICE_HEADINGS = ["mile widziane", "nice to have"]
NF_DESCRIPTION_HEADINGS = ["opis", "description", "zakres", "responsibilities", "wymagań"]
NOT_A_SKILL = ["Tech stack", "Office location", "Job description", "Apply", "Save"]
SENIORITY_ORDER_JJ = ["Senior", "Mid", "Junior", "Lead", "Expert", "C-level"]
SENIORITY_ORDER_NF = ["Junior", "Mid", "Senior", "Lead", "Expert"]
CITIES_JJ = [
    "Warszawa", "Wrocław", "Kraków", "Gdańsk", "Poznań", "Łódź", "Katowice", "Lublin",
    "Szczecin", "Bydgoszcz", "Białystok", "Gdynia", "Rzeszów", "Toruń", "Kielce",
]
CITIES_NF = [
    "Warszawa", "Kraków", "Wrocław", "Gdańsk", "Poznań", "Łódź", "Katowice", "Lublin",
    "Szczecin", "Bydgoszcz", "Białystok", "Gdynia", "Rzeszów", "Toruń", "Kielce", "Olsztyn",
    "Opole", "Gliwice", "Zielona Góra", "Radom", "Sosnowiec", "Bielsko-Biała",
]
SALARY_CURRENCIES = ["PLN", "USD", "EUR", "GBP", "CHF"]
SALARY_TEXT_FLOOR = 500
SALARY_CONTEXT_CHARS = 200

# --- listing and analytics ---------------------------------------------------
SENIORITY_BLACKLIST = ["C-level"]
STATUSES = ["new", "seen", "applied", "interview", "offer", "rejected"]
MAX_PAGE_SIZE = 200

# --- text --------------------------------------------------------------------
STOPWORDS_EN = """
a an and are as at be been but by can could did do does for from had has have he her him his i
in is it its may me might must my of on or our she should that the their them these they this
those to us was we were will with would you your
""".split()
STOPWORDS_PL = """
ale bez co czy dla do gdy gdzie i jak jest która które który na nad nie o od oraz po pod przed
przy sie się u w z za że
""".split()
STOPWORDS = sorted(set(STOPWORDS_EN) | set(STOPWORDS_PL))
TERM_DELIMITERS = r"[\s,;()\[\]/|.]"
INJECTION_PATTERNS = [
    r"ignore\s+(previous|all|above)\s+instructions",
    r"disregard\s+(previous|all|above)",
    r"you\s+are\s+now\s+",
    r"pretend\s+you\s+are",
    r"act\s+as\s+if\s+you",
    r"system\s*:\s*",
    r"<\|[a-z_]+\|>",
]

# --- retrieval ---------------------------------------------------------------
RRF_K = 60
RERANK_CANDIDATES = 30
MATCH_LIMIT = 100
RECALL_CUTOFFS = [5, 10, 20]
SEARCH_FIELD_BOOSTS = {"title": 2.0, "company": 1.0, "skills_combined": 1.5, "description": 1.0}
BGE_QUERY_PREFIX = "Represent this sentence for searching relevant passages: "
NOMIC_DOCUMENT_PREFIX = "search_document: "
NOMIC_QUERY_PREFIX = "search_query: "
CATEGORY_MIN_JOBS = 5
ADVICE_MIN_WEIGHT = 5
ADVICE_LIMIT = 40
