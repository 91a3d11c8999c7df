"""Fixed values that must equal the reference's for identical results.

Kept together, as plain text, in their natural order.
"""

# --- Fixed values: SQL grammar word lists of the scored subset -------------
JOIN_KEYWORDS = ("join", "on", "as")
WHERE_OPS = ("not", "between", "=", ">", "<", ">=", "<=", "!=", "in", "like", "is", "exists")
AGG_OPS = ("none", "max", "min", "count", "sum", "avg")
COND_OPS = ("and", "or")
SQL_OPS = ("intersect", "union", "except")
ORDER_OPS = ("desc", "asc")
LEVELS = ("easy", "medium", "hard", "extra", "all")
PARTIAL_TYPES = ("select", "select(no AGG)", "where", "where(no OP)", "group(no Having)",
                 "group", "order", "and/or", "IUEN", "keywords")

# --- Fixed values: query tokenizer pattern (quotes unified to '"' first) ---
TOKEN_PATTERN = r'"[^"]*"|[A-Za-z_][A-Za-z0-9_.]*|[0-9]+(?:[.][0-9]+)?|!=|>=|<=|<>|[(),;*=<>+/-]'

# --- Fixed values: value-linking word lists --------------------------------
# English stop words (the common NLTK list, without "no").
STOPWORDS = (
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "you're", "you've", "you'll",
    "you'd", "your", "yours", "yourself", "yourselves", "he", "him", "his", "himself", "she", "she's",
    "her", "hers", "herself", "it", "it's", "its", "itself", "they", "them", "their", "theirs",
    "themselves", "what", "which", "who", "whom", "this", "that", "that'll", "these", "those", "am",
    "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "having", "do", "does",
    "did", "doing", "a", "an", "the", "and", "but", "if", "or", "because", "as", "until", "while",
    "of", "at", "by", "for", "with", "about", "against", "between", "into", "through", "during",
    "before", "after", "above", "below", "to", "from", "up", "down", "in", "out", "on", "off", "over",
    "under", "again", "further", "then", "once", "here", "there", "when", "where", "why", "how", "all",
    "any", "both", "each", "few", "more", "most", "other", "some", "such", "nor", "not", "only",
    "own", "same", "so", "than", "too", "very", "s", "t", "can", "will", "just", "don", "don't",
    "should", "should've", "now", "d", "ll", "m", "o", "re", "ve", "y", "ain", "aren", "aren't",
    "couldn", "couldn't", "didn", "didn't", "doesn", "doesn't", "hadn", "hadn't", "hasn", "hasn't",
    "haven", "haven't", "isn", "isn't", "ma", "mightn", "mightn't", "mustn", "mustn't", "needn",
    "needn't", "shan", "shan't", "shouldn", "shouldn't", "wasn", "wasn't", "weren", "weren't", "won",
    "won't", "wouldn", "wouldn't",
)
COMMON_WORDS = ("no", "yes", "many")
COMMON_DB_TERMS = ("id",)
SPAN_SEPARATORS = "'\"()`,.?! "
MATCH_THRESHOLD = 0.85
TOP_K_MATCHES = 2

# Spellings of a slot that make a content text malformed.
MALFORMED_SLOTS = ("[table]", "[Col", "[value]", "[col)")
MALFORMED_START = "[col "
