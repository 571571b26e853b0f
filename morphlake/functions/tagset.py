"""Part-of-speech tags and the roles they play."""

# Tag names, tag sets and patterns that results depend on.
TAGS = (
    "NNG", "NNP", "NNB", "NNBC", "NR", "NP", "VV", "VA", "VAX", "VX", "VCP", "VCN", "MM", "MAG", "MAJ", "IC", "JKS", "JKC", "JKG", "JKO", "JKB", "JKV",
    "JKQ", "JC", "JX", "EP", "EF", "EC", "ETN", "ETM", "XPN", "XSN", "XSV", "XSA", "XR", "SF", "SE", "SSO", "SSC", "SC", "SY", "SH", "SL", "SN",
)
TERM_CATEGORIES = ("COUNTRY", "INDUSTRY", "NAME", "SECTOR", "ENTITY", "GENERIC", "GEO", "CURRENCY", "UNIT")
NOUN_TAGS = ("NNG", "NNP", "UNKNOWN")
BASE_NOUN_TAGS = ("NNG", "NNP", "XSN", "SL", "XR", "NNB", "NR")
TOPIC_TAGS = ("NNG",)
SENTIMENT_TAGS = ("MAG", "NNG", "XR", "VV", "VA", "VVX", "VAX", "VX", "VCN", "XSV", "VCP")
LEMMA_TAGS = ("VV", "VX", "XSV", "VCN", "VA", "MAG", "VAX")
AUXILIARY_TAGS = ("VX", "VCP", "VCN")
AUXILIARY_WORDS = ("못하/VX", "아니/VCN", "않/VX", "지만/VCP")
NGRAM_START_TAGS = ("NNG", "VA", "VAX", "MAG")
SKIPPED_TAGS = ("SC", "SN", "SY", "SSO", "SSC")
UNMERGED_PATTERNS = ("EC+NNG",)
SKIP_PATTERNS = (
    "MM+SC+NNG+SC+NR", "NNG+SC+NNG", "NNG+SN+NNG", "NNG+SN+NNBC", "NNG+SN+NNBC+NNG", "NNG+SY+NNBC+JX", "NNG+SY+NNG", "NNG+SY+NNG+XSN", "SL+SC+NNG",
    "SL+SY+NNG", "SL+SC+SL", "SL+SY+SL", "SN+NNBC+NNG", "SN+NNBC+VV", "SSO+NNG+SSC", "SSO+SL+SSC",
)
SYMBOL_TAGS = ("SF", "SP", "SS", "SE", "SO", "SW", "UN", "UV", "UE", "OL", "OH", "ON")
EPSILON = 1e-6
