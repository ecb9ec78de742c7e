"""Patterns and word lists of the document model."""

from __future__ import annotations

# Document types and the patterns that tell them, in their order.
SEC_TYPES = {
    "10-K": [r"FORM\s+10-K", r"ANNUAL\s+REPORT\s+PURSUANT\s+TO\s+SECTION\s+13", r"ANNUAL\s+REPORT\s+ON\s+FORM\s+10-K", r"For\s+the\s+fiscal\s+year\s+ended"],
    "10-Q": [r"FORM\s+10-Q", r"QUARTERLY\s+REPORT\s+PURSUANT\s+TO\s+SECTION\s+13", r"QUARTERLY\s+REPORT\s+ON\s+FORM\s+10-Q", r"For\s+the\s+(?:fiscal\s+)?quarter(?:ly\s+period)?\s+ended"],
    "8-K": [r"FORM\s+8-K", r"CURRENT\s+REPORT\s+PURSUANT\s+TO\s+SECTION\s+13", r"CURRENT\s+REPORT\s+ON\s+FORM\s+8-K"],
    "DEF 14A": [r"DEF\s*14A", r"SCHEDULE\s+14A", r"PROXY\s+STATEMENT", r"NOTICE\s+OF\s+ANNUAL\s+MEETING"],
    "S-1": [r"FORM\s+S-1", r"REGISTRATION\s+STATEMENT", r"PROSPECTUS"],
    "20-F": [r"FORM\s+20-F", r"ANNUAL\s+REPORT\s+PURSUANT\s+TO\s+SECTION\s+12"],
    "6-K": [r"FORM\s+6-K", r"REPORT\s+OF\s+FOREIGN\s+PRIVATE\s+ISSUER"],
}
OTHER_TYPES = {
    "earnings_call": [
        r"earnings\s+(?:conference\s+)?call", r"(?:Q[1-4]|first|second|third|fourth)\s+(?:quarter\s+)?(?:\d{4}\s+)?(?:earnings|results)\s+call",
        r"operator(?:.*?)(?:good\s+(?:morning|afternoon|evening))", r"(?:ceo|cfo|chief\s+(?:executive|financial)\s+officer)\s+(?:will\s+)?(?:now\s+)?(?:begin|start|present)",
        r"(?:questions?\s+and\s+answers?|q\s*&\s*a)\s+session", r"thank\s+you\s+for\s+(?:joining|standing\s+by)", r"(?:i'd\s+like\s+to|let\s+me)\s+turn\s+(?:the\s+call|it)\s+over\s+to",
    ],
    "earnings_release": [
        r"(?:reports?|announces?)\s+(?:Q[1-4]|first|second|third|fourth)\s+quarter\s+(?:\d{4}\s+)?(?:results|earnings)", r"(?:quarterly|annual)\s+(?:earnings|results)\s+(?:report|release|announcement)",
        r"press\s+release.*(?:earnings|results|revenue)", r"(?:gaap|non-gaap)\s+(?:eps|earnings\s+per\s+share)",
    ],
    "research_report": [
        r"(?:buy|sell|hold|overweight|underweight|neutral)\s+rating", r"price\s+target\s*[:,]?\s*\$?\d+", r"(?:analyst|equity\s+research)\s+report",
        r"(?:initiating|maintaining|upgrading|downgrading)\s+coverage", r"(?:investment|analyst)\s+(?:thesis|summary|opinion)", r"(?:target|fair)\s+(?:price|value)\s*[:,]?\s*\$?\d+",
    ],
    "press_release": [r"for\s+immediate\s+release", r"press\s+release", r"news\s+release", r"(?:contact|media)\s*:\s*\S+@\S+", r"###\s*$"],
}
#: Matches that give full confidence.
FULL_AT = {**dict.fromkeys(SEC_TYPES, 2), "earnings_call": 3, "earnings_release": 2, "research_report": 3, "press_release": 2}
#: Parts of a file name that tell the type; all parts of an entry must be there.
NAME_RULES = [(("10-k",), "10-K"), (("10k",), "10-K"), (("10-q",), "10-Q"), (("10q",), "10-Q"), (("8-k",), "8-K"), (("8k",), "8-K"), (("def14a",), "DEF 14A"), (("proxy",), "DEF 14A"),
              (("s-1",), "S-1"), (("s1",), "S-1"), (("20-f",), "20-F"), (("20f",), "20-F"), (("6-k",), "6-K"), (("6k",), "6-K"), (("earnings", "call"), "earnings_call"), (("transcript",), "earnings_call")]

# Section headers (pattern, level); a type's own come first.
MARKDOWN = (r"^#{1,6}\s+", 1)
TYPE_HEADERS = {
    "10-K": [(r"^PART\s+([IVX]+)\s*$", 1), (r"^ITEM\s+(\d+[A-Z]?)\.?\s+", 2), (r"^NOTE\s+(\d+)\.?\s*", 3), MARKDOWN],
    "10-Q": [(r"^PART\s+([IVX]+)\s*$", 1), (r"^ITEM\s+(\d+[A-Z]?)\.?\s+", 2), (r"^NOTE\s+(\d+)\.?\s*", 3), MARKDOWN],
    "8-K": [(r"^ITEM\s+(\d+\.\d+)\s+", 1), (r"^SIGNATURE", 1), MARKDOWN],
    "DEF 14A": [(r"^PROPOSAL\s+(\d+)", 1), (r"^EXECUTIVE\s+COMPENSATION", 1), (r"^DIRECTOR\s+COMPENSATION", 1), (r"^SECURITY\s+OWNERSHIP", 1), MARKDOWN],
    "earnings_call": [(r"^(?:OPERATOR|Operator)\s*$", 1), (r"^(?:PRESENTATION|Presentation)\s*$", 1), (r"^(?:Q\s*&\s*A|QUESTION\s+AND\s+ANSWER)", 1), MARKDOWN],
    "research_report": [(r"^(?:INVESTMENT\s+)?THESIS", 1), (r"^(?:KEY\s+)?RISKS?", 1), (r"^VALUATION", 1), (r"^FINANCIAL\s+(?:SUMMARY|ANALYSIS)", 1), MARKDOWN],
}
DEFAULT_HEADERS = [
    (r"^PART\s+([IVX]+|\d+)\s*$", 1), (r"^PART\s+([IVX]+|\d+)\s*[-–—]\s*", 1), (r"^ITEM\s+(\d+[A-Z]?)\.?\s+", 2), (r"^NOTE\s+(\d+)\.?\s*[-–—:]?\s*", 2),
    (r"^EXHIBIT\s+(\d+(?:\.\d+)?)", 2), (r"^APPENDIX\s+([A-Z](?:\d+)?)", 2), (r"^(\d+)\.\s+[A-Z]", 2), (r"^(\d+\.\d+)\s+[A-Z]", 3),
    (r"^#{1}\s+", 1), (r"^#{2}\s+", 2), (r"^#{3}\s+", 3), (r"^#{4}\s+", 4),
]
#: What every header begins with: a cheap first test of a line.
MAYBE_HEADER = r"^(?:[#0-9]|part|item|note|exhibit|appendix|signature|proposal|executive|director|security|operator|presentation|q|investment|thesis|key|risk|valuation|financial)"

# Metadata fields.
FIELDS = {
    "cik": r"(?:CIK|Central Index Key)[:\s#]*(\d{10}|\d{7})",
    "ticker": r"(?:Trading Symbol|Ticker Symbol|Stock Symbol)[:\s]*([A-Z]{1,5})",
    "company_name": r"(?:Company Name|Registrant|REGISTRANT)[:\s]*([A-Z][A-Za-z0-9\s,\.&]+?)(?:\n|$|FORM)",
    "filing_date": r"(?:Filed|Filing Date|Date Filed)[:\s]*(\w+\s+\d{1,2},?\s+\d{4}|\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4})",
    "period_end": r"(?:For the (?:fiscal |)(?:year|quarter|period) ended?|Period of Report)[:\s]*(\w+\s+\d{1,2},?\s+\d{4}|\d{4}-\d{2}-\d{2})",
    "fiscal_year": r"(?:Fiscal Year|FY)\s*(?:End(?:ing|ed)?)?[:\s]*(\d{4})",
    "revenue": r"(?:Total\s+)?(?:Net\s+)?Revenue[s]?[:\s]*\$?\s*([\d,\.]+)\s*(?:million|billion|M|B)?",
    "net_income": r"Net\s+Income[:\s]*\$?\s*([\d,\.]+)\s*(?:million|billion|M|B)?",
    "eps": r"(?:Diluted\s+)?(?:EPS|Earnings\s+[Pp]er\s+[Ss]hare)[:\s]*\$?\s*([\d\.]+)",
    "total_assets": r"Total\s+Assets[:\s]*\$?\s*([\d,\.]+)\s*(?:million|billion|M|B)?",
    "total_liabilities": r"Total\s+Liabilities[:\s]*\$?\s*([\d,\.]+)\s*(?:million|billion|M|B)?",
    "shareholders_equity": r"(?:Total\s+)?(?:Shareholders?'?|Stockholders?'?)\s+Equity[:\s]*\$?\s*([\d,\.]+)\s*(?:million|billion|M|B)?",
}
NUMBERS = ("revenue", "net_income", "eps", "total_assets", "total_liabilities", "shareholders_equity")
META_DATES = ("MMMM d, yyyy", "MMMM d yyyy", "MMM d, yyyy", "MMM d yyyy", "yyyy-MM-dd", "M/d/yyyy", "M-d-yyyy", "d-MMM-yyyy", "d MMMM yyyy")
TEXT_DATES = ("yyyy-MM-dd", "MMMM d, yyyy", "MMMM d yyyy", "MMM d, yyyy", "MMM d yyyy", "M/d/yyyy", "d/M/yyyy", "M-d-yyyy", "d-MMM-yyyy", "d MMMM yyyy")

# References in texts (pattern, type), in their order.
REFERENCES = [
    (r"(?:see|refer(?:red)?\s+to|in|described\s+in|set\s+forth\s+in)\s+Appendix\s+([A-Z](?:\d+)?)", "appendix"),
    (r"(?:see|refer(?:red)?\s+to)\s+Note\s+(\d+(?:\.\d+)?)", "note"),
    (r"\(Note\s+(\d+(?:\.\d+)?)\)", "note"),
    (r"(?:see|refer(?:red)?\s+to|in|described\s+in)\s+Item\s+(\d+[A-Z]?)", "item"),
    (r"(?:see|in|shown\s+in|refer(?:red)?\s+to)\s+Table\s+(\d+(?:\.\d+)?)", "table"),
    (r"(?:see|in|shown\s+in)\s+Figure\s+(\d+(?:\.\d+)?)", "figure"),
    (r"(?:see|refer(?:red)?\s+to|in)\s+Section\s+(\d+(?:\.\d+)*)", "section"),
    (r"(?:see|refer(?:red)?\s+to)\s+Exhibit\s+(\d+(?:\.\d+)?)", "exhibit"),
    (r"(?:see|in)\s+Part\s+([IVX]+|\d+)", "part"),
    (r"(?:see\s+)?page\s+(\d+)", "page"),
]


def headers_of(doc_type: str) -> list[tuple[str, int]]:
    """Patterns of a type in the order they are tried: its own, then the defaults that it doesn't have."""
    own = TYPE_HEADERS.get(doc_type, [MARKDOWN])
    have = {p for p, _ in own}
    return own + [x for x in DEFAULT_HEADERS if x[0] not in have]
