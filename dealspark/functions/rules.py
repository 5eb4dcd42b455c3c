"""Vocabularies of the library, as plain values that a caller may replace; rosters and domains are parameters."""

from __future__ import annotations

from dataclasses import dataclass, field

# Canonical sector and its variants.
SECTORS = {
    "AdTech": ["advertising", "marketing tech", "martech"],
    "B2B": ["b2b commerce", "b2b marketplace", "b2b services"],
    "Beauty & Personal Care": ["beauty", "personal care", "bpc"],
    "Climate": ["cleantech", "clean tech", "sustainability", "carbon markets", "climate tech"],
    "Consumer": ["consumer brands", "fmcg", "cpg"],
    "Consumer Tech": ["consumer internet", "consumer technology"],
    "Deep Tech": ["deeptech"],
    "Defence": ["defence tech", "defense", "defense tech"],
    "E-commerce": ["marketplace", "ecommerce", "e commerce"],
    "Fintech": ["financial services", "banking", "nbfc", "financial", "finance"],
    "Food": ["f&b", "food & beverage", "food and beverage", "beverages", "foodtech"],
    "Healthcare": ["health & wellness", "health and wellness", "hospitals", "health", "healthtech", "health tech"],
    "Logistics": ["supply chain", "logistics & mobility", "logistics and mobility"],
    "Manufacturing": ["industrial", "engineering services", "industrials"],
    "Media": ["entertainment", "media & entertainment"],
    "Real Estate": ["proptech", "prop tech", "real-estate"],
    "SaaS": ["software", "enterprise software", "enterprise tech", "enterprise technology"],
    "Services": ["it services", "professional services"],
    "Venture Capital": ["vc"],
    "Private Equity": ["pe"],
    "Venture Debt": ["venture debt", "private credit"],
    "Asset Management": ["asset management", "am"],
}
# Canonical stage and its variants.
STAGES = {
    "Seed": ["pre-seed", "preseed", "early stage", "early-stage", "early growth", "venture"],
    "Pre-Series A": ["pre series a", "pre-series-a"],
    "Series A": [], "Series B": [], "Series C": [],
    "Growth": ["stage-agnostic", "growth equity", "growth stage"],
    "Late Stage": ["pre-ipo", "post-ipo", "late-stage"],
    "Buyout": ["control", "control buyouts", "m&a", "minority stakes", "acquisition"],
    "Private Credit": ["debt", "structured credit", "special situations"],
}
# Deal vocabulary.
DEAL_TERMS = (
    "round", "raise", "raising", "fundraise", "valuation", "term sheet", "termsheet", "arr", "mrr", "ebitda", "revenue", "runway", "cap table",
    "pre-money", "post-money", "due diligence", "dd", "cim", "teaser", "one-pager", "pitch deck", "deck", "investor", "lp", "gp", "series a",
    "series b", "seed", "pre-seed", "bridge", "convertible", "safe", "equity", "stake", "exit", "acquisition", "mandate", "engagement",
    "crore", "cr", "lakh", "₹",
)
# Prior score of each source.
PRIORS = {"calendar": 0.6, "dashboard": 0.9, "pdf": 0.7, "drive_doc": 0.5, "gmail": 0.3, "whatsapp": 0.4}
# Words that mark a stand-in for a person.
PLACEHOLDER = r"(?i)\b(founder|co-?founder|ceo|cfo|cto|coo|cmo|cxo|chairman|investor|advisor|partner|principal|associate|analyst|team|deals?|mentions?|unknown|active|dormant|hr|hrops|operations|finance|sales|marketing|admin|accounts?|legal|promoters?)\b"
# Country codes and names.
COUNTRIES = {
    "IN": "India", "US": "United States", "GB": "United Kingdom", "SG": "Singapore", "AE": "United Arab Emirates", "CA": "Canada", "AU": "Australia",
    "DE": "Germany", "FR": "France", "NL": "Netherlands", "CH": "Switzerland", "JP": "Japan", "CN": "China", "HK": "Hong Kong", "ID": "Indonesia",
    "MY": "Malaysia", "PH": "Philippines", "TH": "Thailand", "VN": "Vietnam", "BD": "Bangladesh", "PK": "Pakistan", "LK": "Sri Lanka", "NP": "Nepal",
    "SA": "Saudi Arabia", "IL": "Israel", "IE": "Ireland", "SE": "Sweden", "ES": "Spain", "IT": "Italy", "BR": "Brazil", "ZA": "South Africa",
    "NZ": "New Zealand", "KR": "South Korea",
}
# Mail patterns.
CALL_NOTE = r"(?i)\b(call notes?|meeting notes?|mom|minutes of meeting|notes from|debrief|intro(duction)? (call|to)|recap)\b"
DEAL_SUBJECT = r"(?i)\b(pitch|deck|teaser|cim|one[- ]pager|opportunity|mandate|raising|fundrais|investment|term sheet|data ?room|due diligence)\b"
SECURITY = r"(?i)\b(otp|one[- ]time password|verification code|login code|2fa|password reset|reset your password|security code|authentication code)\b"
FINANCE = r"(?i)\b(payslip|pay slip|salary slip|salary credited|ctc|bank statement|account statement|e-statement|credit card statement|mini statement|upi|emi due|policy premium|itr|form 16)\b"
HR = r"(?i)\b(offer letter|appointment letter|relieving letter|appraisal|increment letter|performance review|leave (request|approval)|reimbursement)\b"
AUTOMATED = ("no-reply", "noreply", "no_reply", "donotreply", "do-not-reply", "notifications@", "notification@", "mailer@", "mailer-daemon", "bounce", "newsletter@", "updates@", "alerts@", "auto@")
BULK_LABELS = ("CATEGORY_PROMOTIONS", "CATEGORY_SOCIAL", "CATEGORY_FORUMS", "SPAM")
# Words that are roles, not names.
ROLE_WORDS = (
    "founder", "founders", "cofounder", "co-founder", "ceo", "cfo", "cto", "coo", "cmo", "cxo", "chairman", "chairperson", "promoter", "promoters", "director",
    "accounts", "account", "finance", "sales", "marketing", "admin", "hr", "hrops", "ops", "operations", "legal", "support", "deals", "deal", "mentions", "mention",
    "dormant", "active", "investor", "investors", "advisor", "advisors", "team", "unknown", "tbd", "na", "contact", "contacts", "info", "everyone",
    "entire", "group", "management", "founderceo",
)
# Names that are no investor, organisation or company.
NO_INVESTOR = (
    "angels", "angel", "angel investor", "angel investors", "angel network", "angel networks", "angel group", "angel groups", "hni", "hnis", "hnwi", "hnwis",
    "undisclosed", "various", "various investors", "other", "others", "na", "n/a", "tbd", "unknown", "none", "friends and family", "friends & family", "f&f",
    "existing investors", "existing investor", "promoters", "promoter", "public", "retail", "strategic investors", "institutional investors", "family offices",
    "family office", "syndicate", "angel syndicate",
)
GENERIC_INVESTOR = r"(?i)^\s*\d*\s*(hnwis?|hnis?|angels?|investors?|family offices?|angel investors?|angel networks?)\s*$"
NO_ORG = ("self-employed", "self employed", "freelance", "freelancer", "independent", "independent consultant", "various", "various companies", "other", "others", "n/a", "na", "none", "-", "—", "unknown", "tbd", "private", "confidential", "stealth", "stealth startup", "stealth mode")
NO_COMPANY = ("unknown", "n/a", "na", "tbd", "other", "others", "none", "-")
# Words dropped from company names.
CORE_SUFFIX = r"\b(advisors?|capital|ventures?|partners?|technolog(?:y|ies)|tech|limited|ltd|pvt|private|inc|llp|llc|fund|funds|group|company|co|solutions|labs|systems|india|global|holdings?|enterprises?|and|the)\b"
ALIAS_SUFFIX = ("ventures", "venture", "capital", "partners", "technologies", "technology", "limited", "ltd", "pvt", "private", "inc", "llp", "fund", "funds", "solutions", "labs", "systems", "global", "group", "company", "co", "india", "&")
# Prices per million tokens, in and out.
PRICES = {"flash": (0.30, 2.50), "pro": (1.25, 10.00)}
USD_M_TO_CRORE = 8.5


@dataclass
class Rules:
    """What a caller may change; the defaults name no real person or firm."""

    deal_terms: tuple[str, ...] = DEAL_TERMS
    priors: dict[str, float] = field(default_factory=lambda: dict(PRIORS))
    internal_domains: tuple[str, ...] = ()
    trusted_labels: tuple[str, ...] = ()
    generic_domains: tuple[str, ...] = ()
    threshold: float = 0.35

#: Words that name no investor, and no school, by themselves.
INVESTOR_EXTRA = r"\b(management|asia|advisory|advisors?|investments?|the)\b"
SCHOOL_EXTRA = r"\b(university|college|institute|institution|school|of|the|and|polytechnic)\b"
