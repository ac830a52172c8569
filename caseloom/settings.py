"""Default settings of the case model. Every operator takes these as parameters."""

# Outcome labels ---------------------------------------------------
MONETARY_RESPONSE = "Closed with monetary relief"
RELIEF_RESPONSES = ("Closed with monetary relief", "Closed with non-monetary relief")

# Product label -> short name --------------------------------------
PRODUCT_LABELS = {
    "Credit reporting, credit repair services, or other personal consumer reports": "Credit reporting",
    "Debt collection": "Debt collection",
    "Credit card or prepaid card": "Credit card / prepaid",
    "Mortgage": "Mortgage",
    "Checking or savings account": "Checking / savings",
    "Student loan": "Student loan",
    "Vehicle loan or lease": "Vehicle loan / lease",
    "Money transfer, virtual currency, or money service": "Money transfer",
    "Payday loan, title loan, or personal loan": "Payday / personal loan",
}

# Patterns looked for in the lower-cased narrative -------------------
SIGNAL_PATTERNS = {
    "mentions_attorney": r"\b(?:attorney|lawyer|legal counsel|law firm)s?\b",
    "mentions_legal_action": r"\b(?:sue|suing|lawsuit|litigation|small claims|court)\b",
    "mentions_regulator": r"\b(?:cfpb|attorney general|ftc|federal trade commission|better business bureau|bbb)\b",
    "cites_law": r"(?:\bfcra\b|\bfdcpa\b|fair credit reporting act|fair debt collection|\b15 ?u\.?s\.?c|\b1681\w*|\b1692\w*)",
    "mentions_identity_theft": r"(?:identity theft|identity was stolen|stolen identity|not my account|fraudulent account)",
    "mentions_fees": r"\b(?:fee|fees|overdraft|interest charge)\b",
}

# Display labels -----------------------------------------------------
SIGNAL_LABELS = {
    "mentions_attorney": "Mentions an attorney or lawyer",
    "mentions_legal_action": "Mentions suing or court",
    "mentions_regulator": "Mentions a regulator (CFPB, AG, FTC, BBB)",
    "cites_law": "Cites a consumer law (FCRA, FDCPA)",
    "mentions_identity_theft": "Mentions identity theft",
    "mentions_fees": "Mentions fees or overdraft",
}
GEO_LABELS = ("Rest of U.S.", "Texas, outside Greater Houston", "Greater Houston")
TONE_LABELS = ("1 Most negative", "2", "3", "4", "5 Least negative")
TONE_EDGE_LABELS = ("Most negative tone (bottom 20%)", "Least negative tone (top 20%)")
OTHER_COMPANIES = "All other companies"
UNCLASSIFIED = "Too short to classify"

# Geography, dates, segments ------------------------------------------
REGION_STATE = "TX"
METRO_ZIP3 = ("770", "771", "772", "773", "774", "775")
COMPLETE_MONTHS = ("2019-01", "2019-10")
SEGMENT_TAGS = {"older_american": "Older American", "servicemember": "Servicemember"}
TREND_PRODUCT = "Credit reporting"

# Domain stop words, added to a general English list --------------------
DOMAIN_STOP_WORDS = [
    "dollaramount", "did", "does", "don", "just", "like", "told", "called", "said", "got", "asked",
    "im", "ive", "didnt", "dont", "wa", "would", "also", "could", "still", "get", "one", "will",
    "time", "received", "sent", "back", "even", "never", "day", "days",
    "wells", "fargo", "wf", "chase", "jpmorgan", "america", "boa", "capital", "citi", "citibank",
    "synchrony", "navient", "experian", "equifax", "transunion", "trans", "union", "amex",
    "american", "express", "discover", "paypal", "ocwen", "nationstar", "cooper", "santander",
    "ally", "pheaa", "fedloan", "sallie", "mae", "barclays", "comenity", "sun", "trust", "suntrust",
    "usaa", "td", "pnc", "regions", "huntington", "portfolio", "recovery", "midland", "encore",
    "convergent", "erc", "ic", "lvnv", "cavalry", "transworld", "coinbase", "venmo", "cash", "app",
    "square", "navy", "federal", "loancare", "caliber", "quicken", "rocket", "shellpoint",
    "carrington", "seterus", "ditech", "bayview", "selene", "penfed", "alliance",
]

# Words too vague to stand alone in the phrase table ----------------------
VAGUE_WORDS = (
    "systems", "corporation", "seriously", "annual", "decreased", "lowered", "protected",
    "equipment", "scores",
)

# Suffixes of the light stemmer, first that fits wins ------------------------
STEM_SUFFIXES = ("ing", "ed", "es", "s", "e")

# Topic seeds (theme, anchor terms), one per topic ----------------------------
TOPIC_SEEDS = [
    ("Customer service failures", ["customer service", "representative", "spoke", "email", "online"]),
    ("Requests to remove report items", ["removed credit", "remove", "items credit", "deleted"]),
    ("Credit-repair form letters", ["harming credit", "partial account", "incorrect reporting", "attached credit"]),
    ("Identity theft", ["identity theft", "victim identity", "theft report", "police report"]),
    ("Credit card charges & limits", ["credit card", "card company", "card account", "limit"]),
    ("Credit-repair form letters", ["reporting agency", "subsection", "reseller", "shall"]),
    ("Balances, fees & payoffs", ["account paid", "paid balance", "charged", "owed", "fee"]),
    ("Debt not owed / validation", ["collection agency", "debt collection", "collect debt", "owe"]),
    ("Unauthorized hard inquiries", ["hard inquiry", "hard inquiries", "inquiries credit"]),
    ("Credit-repair form letters", ["consumer contract", "verifiable proof", "accounts listed", "original signed"]),
    ("Bank deposits, funds & checks", ["checking account", "deposit", "deposited", "funds"]),
    ("Late payment reporting", ["late payment", "late payments", "reporting late"]),
    ("Collection calls & contact", ["phone calls", "calling", "phone number", "stop"]),
    ("Fraudulent accounts (not mine)", ["fraudulent accounts", "accounts belong", "following accounts"]),
    ("Loan repayment & forgiveness", ["student loan", "forgiveness", "repayment", "school"]),
    ("Dispute & verification process", ["certified", "requested", "documentation", "verified"]),
    ("Mortgage servicing & escrow", ["escrow", "modification", "foreclosure", "property"]),
    ("Inaccurate bureau reporting", ["credit bureaus", "inaccurate", "bankruptcy", "agencies"]),
]

# Model inputs --------------------------------------------------------------
MODEL_CATEGORIES = ("product", "sub_product", "issue", "sub_issue", "company_model", "state")
MODEL_FLAGS = ("older_american", "servicemember", *SIGNAL_PATTERNS)
