"""Word lists, lookup tables, thresholds, patterns and texts that results must agree on, stated plainly.

Patterns are for text in which \\s and \\d mean what they mean in Unicode; functions.text.java spells them out.
"""

# The keys of a filing's sections, and those of the items of each form.
KEYS = ("business", "risk_factors", "cybersecurity", "legal_proceedings", "mdna", "market_risk", "financial_statements", "controls", "governance", "exhibits")
ITEM_KEYS = {
    "10-K": {
        "1": "business",
        "1A": "risk_factors",
        "1C": "cybersecurity",
        "3": "legal_proceedings",
        "7": "mdna",
        "7A": "market_risk",
        "8": "financial_statements",
        "9A": "controls",
        "10": "governance",
        "11": "governance",
        "12": "governance",
        "13": "governance",
        "14": "governance",
        "15": "exhibits",
    },
    "10-Q": {
        "I.1": "financial_statements",
        "I.2": "mdna",
        "I.3": "market_risk",
        "I.4": "controls",
        "II.1": "legal_proceedings",
        "II.1A": "risk_factors",
        "II.6": "exhibits",
    },
    "20-F": {
        "3.D": "risk_factors",
        "4": "business",
        "5": "mdna",
        "6": "governance",
        "8.A.7": "legal_proceedings",
        "11": "market_risk",
        "15": "controls",
        "16K": "cybersecurity",
        "17": "financial_statements",
        "18": "financial_statements",
        "19": "exhibits",
    },
}

# Headings of annual reports, and those that a longer heading may begin with.
PHRASES = {
    "strategic report": "business",
    "business overview": "business",
    "our business": "business",
    "principal risks and uncertainties": "risk_factors",
    "principal risks": "risk_factors",
    "risk factors": "risk_factors",
    "cybersecurity": "cybersecurity",
    "legal proceedings": "legal_proceedings",
    "litigation": "legal_proceedings",
    "operating and financial review": "mdna",
    "financial review": "mdna",
    "management s discussion": "mdna",
    "market risk": "market_risk",
    "financial risk management": "market_risk",
    "financial statements": "financial_statements",
    "consolidated financial statements": "financial_statements",
    "internal controls": "controls",
    "internal control": "controls",
    "controls and procedures": "controls",
    "directors report": "governance",
    "corporate governance": "governance",
    "remuneration report": "governance",
}
OPEN_PHRASES = ("management s discussion", "operating and financial review")

# Patterns of covers, item headings, Parts and sub-headings.
COVER_FORM = r"F\s?O\s?R\s?M\s+(10|20|8)-?([KQF])(?![A-Za-z])"
ITEM_NUMBERS = {
    "10-K": r"\d{1,2}(?:[A-K](?![A-Za-z])|\s[A-K](?=[.:]))?",
    "10-Q": r"\d{1,2}(?:[A-K](?![A-Za-z])|\s[A-K](?=[.:]))?",
    "20-F": r"\d{1,2}(?:\.[A-F](?:\.\d{1,2})?(?![A-Za-z])|[A-K](?![A-Za-z]))?",
    "8-K": r"\d\.\d{2}",
}
ITEM_WORD = r"^\s*I\s?T\s?E\s?M\s?S?\s*"
ITEM_BETWEEN = r"\s*(?:,|\band\b|&)\s*"
ITEM_AFTER = r"(?=\s*$|\s*[.:\-–—|]|\s+(?-iu:[A-Z]))"
PART = r"^\s*P\s?A\s?R\s?T\s+(IV|I{1,3}|V)\b"
RISKS_20F = r"^\s*D\.\s+Risk\s+Factors\b"

# What a heading loses before its phrase is looked up, in order, and what takes the place.
HEADING_CUTS = (
    (r"’", "'"),
    (r"[.…]{2,}[^\n]*(?:\n?\z)", ""),
    (r"\s+\d{1,4}\s*\z", ""),
    (r"^\s*(?:section\s+)?\d+(?:\.\d+)*[.)]?\s+", ""),
    (r"[^a-z]+", " "),
)

# Patterns of sections that only point elsewhere, and of where.
BY_REFERENCE = r"incorporated\s+(?:herein\s+)?by\s+reference|\bsee\b[^.]{0,120}\bexhibit\b|\bset\s+forth\s+in\b[^.]{0,120}\b(?:exhibit|annual\s+report)\b"
REFERRED = r"\bExhibit\s+\d+(?:\.\d+)*|\bAnnual\s+Report\s+to\s+(?:Share|Stock)holders|\bProxy\s+Statement"

# HTML elements that begin and end a line, and those whose text is not read.
BLOCKS = (
    "address", "article", "aside", "blockquote", "br", "dd", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre",
    "section", "table", "tr", "ul",
)
SKIPPED = ("script", "style", "noscript", "head", "template")

# OCR engines' names of languages by ISO 639-1 code, and the languages of the Latin model.
LANGUAGES = {
    "en": "eng", "de": "deu", "fr": "fra", "es": "spa", "it": "ita", "pt": "por", "nl": "nld", "pl": "pol", "sv": "swe",
    "da": "dan", "no": "nor", "fi": "fin", "cs": "ces", "tr": "tur", "ru": "rus", "uk": "ukr", "el": "ell", "ar": "ara",
    "he": "heb", "hi": "hin", "ja": "jpn", "ko": "kor", "zh": "chi_sim",
}
LATIN = ("en", "de", "fr", "es", "it", "pt", "nl", "pl", "sv", "da", "no", "fi", "cs", "tr")

# Sectors by ranges of SIC codes; the first range that holds a code gives its sector.
SECTORS = (
    (3021, 3021, "consumer-discretionary"),
    (1311, 1389, "energy"),
    (2900, 2999, "energy"),
    (1000, 1499, "materials"),
    (2400, 2509, "materials"),
    (2600, 2699, "materials"),
    (2800, 2829, "materials"),
    (2850, 2899, "materials"),
    (3140, 3140, "consumer-discretionary"),
    (3000, 3399, "materials"),
    (2830, 2836, "health-care"),
    (3840, 3851, "health-care"),
    (8000, 8099, "health-care"),
    (100, 999, "consumer-staples"),
    (2000, 2199, "consumer-staples"),
    (2840, 2844, "consumer-staples"),
    (5400, 5499, "consumer-staples"),
    (5912, 5912, "consumer-staples"),
    (3630, 3630, "consumer-discretionary"),
    (3570, 3579, "technology"),
    (3600, 3699, "technology"),
    (3800, 3899, "technology"),
    (7370, 7379, "technology"),
    (2700, 2799, "communication"),
    (4800, 4899, "communication"),
    (7800, 7899, "communication"),
    (4900, 4999, "utilities"),
    (6500, 6553, "real-estate"),
    (6798, 6798, "real-estate"),
    (6000, 6799, "financials"),
    (3711, 3711, "consumer-discretionary"),
    (3713, 3713, "consumer-discretionary"),
    (3714, 3714, "consumer-discretionary"),
    (3716, 3716, "consumer-discretionary"),
    (3751, 3751, "consumer-discretionary"),
    (2200, 2399, "consumer-discretionary"),
    (2510, 2599, "consumer-discretionary"),
    (3900, 3999, "consumer-discretionary"),
    (7000, 7099, "consumer-discretionary"),
    (5200, 5999, "consumer-discretionary"),
    (1500, 1799, "industrials"),
    (3400, 3799, "industrials"),
    (4000, 4799, "industrials"),
    (5000, 5199, "industrials"),
    (7200, 8999, "industrials"),
)

# Reasons of the OCR rule.
REASON_IMAGES = "few characters, images cover most of the page"
REASON_PATHS = "few characters, many vector paths"
REASON_EMPTY = "few characters, nothing to read"
REASON_BAD = "text layer has many bad characters"
REASON_NO_WORDS = "most words are not real words"
REASON_WORDS = "words look real"
REASON_GOOD = "text layer looks good"
