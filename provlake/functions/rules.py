"""Rule tables as plain values. All of them are parameters of the operators that use them."""

# Stop words
STOP_WORDS = (
    "a an the and or but in on at to for of with by from is are was were be been being have has had do does did will would could should may might shall can "
    "it its this that these those i you he she we they my your his her our their me him us them what which who whom how when where why not no nor so if then than too very "
    "just about also more most some any each all both few other such only own up out off over under again further there here as into through during before after "
    "above below between same because furthermore moreover however often typically primarily largely"
).split()

# Tracking parameters of urls, by prefix and by name
TRACKING_PREFIXES = ["utm_", "ga_", "mc_", "_hs", "pk_"]
TRACKING_NAMES = "ref ref_src fbclid gclid msclkid twclid igshid spm from_source feature source share ncid ocid session_id client_id s_kwcid dclid zanpid yclid s campaign action context si _ga _gl".split()

# Networks and host names that are not external
BLOCKED_V4 = "0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 192.0.2.0/24 192.168.0.0/16 198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 224.0.0.0/4 240.0.0.0/4".split()
BLOCKED_V6 = ["::1/128", "fc00::/7", "fe80::/10"]
BLOCKED_HOSTS = ["localhost", "loopback", "internal", "local", "metadata.google.internal"]

# Domains never used as sources, by class
EXCLUDED_DOMAINS = {
    "hard_excluded_social_media": "tiktok.com facebook.com instagram.com twitter.com x.com threads.net snapchat.com pinterest.com tumblr.com youtube.com vimeo.com linkedin.com".split(),
    "hard_excluded_community_forum": "reddit.com quora.com stackoverflow.com stackexchange.com medium.com substack.com answers.yahoo.com pastebin.com hackernews.com news.ycombinator.com".split(),
    "hard_excluded_dictionary_reference": "merriam-webster.com dictionary.cambridge.org wiktionary.org britannica.com dictionary.com thesaurus.com collinsdictionary.com urbandictionary.com vocabulary.com".split(),
    "hard_excluded_utility": "calculator.net calculators.org calculator.com rapidtables.com easycalculation.com".split(),
}
EXCLUDED_PATHS = [
    (r"(?i)^https?://(?:www\.)?github\.com/[^/]+/[^/]+/(?:issues|pull|commit|blob|discussions|actions)", "hard_excluded_github_issue_or_pull"),
    (r"(?i)^https?://(?:www\.)?github\.com/[^/]+/?$", "hard_excluded_github_user_profile"),
    (r"(?i)^https?://(?:www\.)?investopedia\.com/terms/", "hard_excluded_dictionary_reference"),
]

# Audit labels of rejection reasons
AUDIT_LABELS = {
    "hard_excluded_social_media": "SOCIAL_MEDIA_DOMAIN",
    "hard_excluded_community_forum": "COMMUNITY_FORUM_DOMAIN",
    "hard_excluded_dictionary_reference": "DICTIONARY_REFERENCE_DOMAIN",
    "hard_excluded_utility": "GENERIC_UTILITY_DOMAIN",
    "hard_excluded_github_issue_or_pull": "GITHUB_ISSUE_PR",
    "hard_excluded_github_user_profile": "GITHUB_USER_PROFILE",
    "insufficient_relevance": "INSUFFICIENT_RELEVANCE",
    "empty_url": "INVALID_URL",
    "invalid_url": "INVALID_URL",
    "domain_diversity_cap": "DOMAIN_DIVERSITY_CAP",
    "RANK_BELOW_TOP_N": "RANK_BELOW_TOP_N",
}

# Fixed values: (source type, quality, domains, inner labels), first match wins
DOMAIN_RULES = [
    ("government", 0.95, "gov mil europa.eu".split(), ["gov"]),
    ("academic", 0.92, "edu ac.uk".split(), ["ac"]),
    ("research", 0.90, "sciencedirect.com nature.com ieee.org arxiv.org ncbi.nlm.nih.gov springer.com wiley.com jstor.org researchgate.net cell.com biorxiv.org medrxiv.org".split(), ["pubmed"]),
    ("financial_institution", 0.90, "federalreserve.gov bis.org imf.org worldbank.org sec.gov eba.europa.eu bankofengland.co.uk ecb.europa.eu jpmorgan.com goldmansachs.com morganstanley.com".split(), []),
    ("industry_report", 0.88, "mckinsey.com gartner.com forrester.com deloitte.com pwc.com accenture.com bcg.com bain.com capgemini.com idc.com statista.com grandviewresearch.com iea.org epri.com".split(), []),
    ("news", 0.85, "reuters.com bloomberg.com ft.com wsj.com apnews.com bbc.com nytimes.com economist.com cnbc.com theguardian.com washingtonpost.com forbes.com hbr.org technologyreview.com wired.com arstechnica.com techcrunch.com venturebeat.com".split(), []),
    ("enterprise", 0.82, "cloud.google.com aws.amazon.com azure.microsoft.com openai.com microsoft.com google.com ibm.com oracle.com salesforce.com nvidia.com anthropic.com deepmind.google meta.com".split(), []),
    ("reference_dictionary", 0.30, "merriam-webster.com dictionary.cambridge.org dictionary.com wiktionary.org britannica.com investopedia.com".split(), []),
    ("community_forum", 0.25, "stackoverflow.com stackexchange.com reddit.com quora.com medium.com substack.com dev.to hackernews.com".split(), []),
    ("social_media", 0.15, "facebook.com twitter.com x.com instagram.com linkedin.com tiktok.com youtube.com pinterest.com threads.net".split(), []),
    ("community_forum", 0.30, ["github.com"], []),
    ("reference_dictionary", 0.35, ["wikipedia.org"], []),
    ("academic", 0.92, ["scholar.google.com"], []),
]
GENERAL_WEB = ("general_web", 0.70)
LOW_GRADE_TYPES = ["community_forum", "social_media", "reference_dictionary", "reference"]

# What is not fetched as text
BINARY_SUFFIXES = ".pdf .zip .tar .gz .exe .bin .mp4 .mp3 .jpg .png .webp .xlsx .docx".split()
TEXT_TYPES = ["text/html", "text/plain", "application/xhtml", "application/xml"]
MAX_BODY_BYTES = 500_000

# Regions by alias, comparative pairs by keyword, and cue words
GEOGRAPHIES = [
    ("United States", ["united states", "u.s.", "us", "usa", "america"]),
    ("European Union", ["european union", "e.u.", "eu", "europe"]),
    ("China", ["china", "chinese", "prc"]),
    ("India", ["india", "indian"]),
    ("United Kingdom", ["united kingdom", "u.k.", "uk", "britain"]),
    ("Japan", ["japan", "japanese"]),
    ("Germany", ["germany", "german"]),
    ("Asia-Pacific", ["asia-pacific", "apac", "asia"]),
    ("Latin America", ["latin america", "latam"]),
    ("Middle East", ["middle east", "mena", "gulf"]),
]
COMPARATIVE_PAIRS = [
    ("pharma_vs_biotech", ["pharmaceutical companies", "biotechnology firms", "biotech", "pharma"], "Where do large pharmaceutical companies and smaller biotech firms differ in cost, ability to deliver and exposure to risk?"),
    ("tier1_vs_regional", ["large banks", "regional banks", "community banks", "fintechs"], "Where do large institutions and smaller regional ones differ in strategy, cost of rollout and appetite for risk?"),
]
GEOGRAPHY_QUESTION = "Which differences in uptake, results, rules and risks stand out across {regions}{time}?"
COMPARATIVE_TERMS = ["compare", "comparison", "differ", "differences between", "versus", " vs "]
PAIR_CUES = ["differ", "biotech", "pharma", "regional", "smaller"]
FORWARD_TERMS = ["trend", "forecast", "future", "expansion", "reshap", "projection", "demand", "grow"]
LISTED_YEARS = ["2025", "2026", "2027", "2028", "2029", "2030", "2035"]
RELATIVE_TIMES = [r"through\s+20\d\d", r"by\s+20\d\d", r"from\s+20\d\d\s+to\s+20\d\d", r"over\s+the\s+next\s+decade", r"through\s+the\s+decade"]
QUESTION_PREFIXES = [
    "what evidence exists that", "what quantifiable evidence", "what specific evidence", "what are the current", "what are the key", "what are the main", "what are the major", "what operational", "what specific",
    "what are the", "what is the", "how are large", "how is the", "how are", "how is", "in what ways", "to what extent", "and what evidence exists",
]

# Signs of an error or login page
ERROR_PAGE_PHRASES = [
    "access denied", "403 forbidden", "404 not found", "page not found", "sign in to continue", "log in to continue", "please log in", "please sign in", "create an account", "subscribe to continue",
    "you need to enable javascript", "enable cookies", "captcha", "are you a robot", "verify you are human",
]
DROPPED_ELEMENTS = ["script", "style", "nav", "footer", "header", "aside", "form", "noscript"]

# Beginnings of template statements
TEMPLATE_PHRASES = [
    "enterprise research insight regarding", "empirical evidence from http", "evidence from .+ indicates", "source document reference", "analysis report examining", "enterprise analysis report",
    "enterprise adoption analysis", "global industry report", "academic research paper", "research indicates that generative ai", "according to sources, there are multiple", "findings reveal important benefits and risks",
]
HEDGES = ["it is reported that", "research indicates that", "studies show that", "evidence shows that", "according to the report", "findings suggest that", "data shows that"]

# Suffixes taken off long words, in this order
STEM_SUFFIXES = ["ing", "tion", "tions", "ment", "ments", "ed", "es", "ies", "s"]
