"""Word lists and tables that results depend on."""

# Canonical places, their other names, and terms that mark a remote role.
PLACES = ("Beijing", "Dubai", "Shenzhen", "New York", "San Francisco", "Sydney")
ALIASES = {
    "beijing": "Beijing", "peking": "Beijing", "dubai": "Dubai", "shenzhen": "Shenzhen", "shenzen": "Shenzhen",
    "new york": "New York", "new york city": "New York", "nyc": "New York", "manhattan": "New York",
    "san francisco": "San Francisco", "sf": "San Francisco", "bay area": "San Francisco",
    "san francisco bay area": "San Francisco", "sydney": "Sydney", "sydney nsw": "Sydney", "sydney, nsw": "Sydney",
}
REMOTE_TERMS = ("remote", "hybrid", "distributed", "work from home", "wfh")

# Points of the deterministic score.
SIGNAL_TERMS = {
    "ai": 18, "artificial intelligence": 18, "machine learning": 16, "strategy": 14, "strategic": 14, "venture": 18,
    "investment": 16, "investor": 16, "policy": 14, "public policy": 16, "global": 12, "chief of staff": 18,
    "founder": 14, "startup": 12, "product": 10, "operations": 14, "operator": 10, "ops": 8, "growth": 12,
    "partnership": 12, "partnerships": 12, "business development": 12, "climate": 10, "fintech": 10, "crypto": 8,
    "frontier": 12, "leadership": 10,
}
BRAND_TERMS = {
    "openai": 24, "anthropic": 24, "google": 22, "deepmind": 22, "microsoft": 20, "meta": 20, "apple": 18,
    "stripe": 18, "airbnb": 16, "mckinsey": 20, "bain": 18, "bcg": 18, "blackstone": 18, "goldman": 16,
    "world bank": 18, "united nations": 18,
}
LOW_SIGNAL_TERMS = {
    "administrative": 35, "executive assistant": 35, "office manager": 30, "recruiter": 32, "recruiting": 32,
    "talent": 26, "human resources": 30, "hrbp": 30, "customer success": 28, "account manager": 26,
    "sales engineer": 24, "brand designer": 30, "designer": 24, "digital marketing": 24, "crm manager": 24,
    "member services": 24, "engineering manager": 34, "account executive": 30, "sales development": 30,
    "account associate": 26, "marketer": 24, "content editor": 24, "storytelling": 24, "contract": 20,
    "customer engineer": 24, "solutions engineer": 24,
}
SENIOR_TERMS = {
    "senior": 42, "staff engineer": 42, "staff ai engineer": 42, "staff ml engineer": 42,
    "staff machine learning engineer": 42, "principal": 42, "director": 42, "vice president": 42, "vp": 42,
    "head of": 42, "lead": 28,
}

# Groups of the digest, in order, and its themes.
GROUPS = {
    "strategy_operations": "Strategy / Operations", "legal_regulatory": "Legal / Regulatory",
    "policy_ai": "Policy / AI Governance", "investing_venture": "Investing / Venture",
    "product_growth_partnerships": "Product / Growth / Partnerships", "frontier_tech_startups": "Frontier Tech / Startups",
}
OTHER_GROUP = "Other Strong Matches"
THEMES = {
    "AI and frontier-tech": ("ai", "artificial intelligence", "machine learning", "agent", "automation", "frontier"),
    "fintech and financial infrastructure": ("fintech", "finance", "financial", "accounting", "payments", "banking"),
    "product and go-to-market": ("product", "growth", "gtm", "go-to-market", "partnership", "enablement"),
    "strategy and operations": ("strategy", "operations", "bizops", "business operations", "special projects"),
    "healthcare and life sciences": ("health", "healthcare", "clinical", "cancer", "therapeutics", "pediatric"),
    "climate and infrastructure": ("climate", "energy", "infrastructure", "construction", "robotics"),
}

# Statuses of recipients that get nothing, aliases of delivery providers, and spelled-out acronyms.
INACTIVE = ("0", "false", "inactive", "no", "off", "remove", "removed", "delete", "deleted", "unsubscribe", "unsubscribed")
PROVIDERS = {
    "email": "gmail_email", "gmail": "gmail_email", "gmail_email": "gmail_email", "gmail_smtp": "gmail_smtp",
    "smtp": "gmail_smtp", "smtp_email": "gmail_smtp", "google": "gmail_email", "google_email": "gmail_email",
    "graph_email": "microsoft_graph_email", "microsoft_graph": "microsoft_graph_email",
    "outlook": "microsoft_graph_email", "outlook_email": "microsoft_graph_email", "twilio": "twilio_whatsapp",
    "whatsapp": "twilio_whatsapp",
}
ACRONYMS = {"ai": "AI", "io": "IO", "usa": "USA", "uk": "UK"}

# Patterns of required years of experience; groups 1 and 2 of the first are a range.
YEARS_RANGE = r"(?<![\d$])(\d{1,2})\s*(?:-|to)\s*(\d{1,2})\s*(?:\+?\s*)?(?:years?|yrs?)\b(?:\s+of)?(?:\s+(?:relevant|professional|work|industry))?\s+experience"
YEARS_LEAST = (
    r"(?:minimum|min\.?|at least|requires?|requirement:)?\s*(?<![\d$])(\d{1,2})\s*\+?\s*(?:years?|yrs?)\b(?:\s+of)?(?:\s+(?:relevant|professional|work|industry))?\s+experience",
    r"(?<![\d$])(\d{1,2})\s*\+?\s*(?:years?|yrs?)\b(?=[^.;\n]{0,120}\bexperience\b)",
    r"\bexperience\b[^.;\n]{0,80}?(?<![\d$])(\d{1,2})\s*\+?\s*(?:years?|yrs?)\b",
    r"\b(?:requirements?|qualifications?|preferred qualifications?|who you are|you have|you bring|must have)\b[^.;\n]{0,140}?(?<![\d$])(\d{1,2})\s*\+?\s*(?:years?|yrs?)\b",
)
