"""Fixed values of the product-data rules."""

# fixed values: host suffixes that are kept
HOST_SUFFIXES = [
    ".uk", ".com", ".net", ".org", ".au", ".ag", ".bs", ".bb", ".ca", ".do", ".gd", ".gy", ".ie", ".jm", ".nz", ".kn", ".lc",
    ".vc", ".tt", ".us",
]

# fixed values: host suffixes that are dropped
FOREIGN_SUFFIXES = [
    ".ru", ".rs", ".gr", ".pl", ".md", ".fr", ".ro", ".dk", ".ua", ".at", ".bg", ".tw", ".by", ".hk", ".it", ".jp", ".in",
    ".no", ".lt", ".hu", ".ch", ".ir", ".kz", ".mx", ".su", ".br", ".cz", ".ee", ".sk", ".si", ".be", ".de", ".nl", ".es",
]

# fixed values: predicates of the known fields
FIELDS = {
    "http://www.w3.org/1999/02/22-rdf-syntax-ns#type": "rdfs_type",
    "http://schema.org/product/name": "product_name",
    "http://schema.org/product/description": "product_description",
    "http://schema.org/product/brand": "product_brand",
    "http://schema.org/product/category": "product_category",
    "http://schema.org/offer/name": "offer_name",
    "http://schema.org/offer/description": "offer_description",
    "http://schema.org/offer/category": "offer_category",
    "http://schema.org/listitem/name": "listitem_name",
    "http://schema.org/listitem/description": "listitem_description",
    "http://data-vocabulary.org/breadcrumb/title": "breadcrumb_title",
    "http://data-vocabulary.org/breadcrumb/name": "breadcrumb_title",
}

# fixed values: names that say nothing, by kind of record
EMPTY_NAMES = {"product": ("product", "home", "null"), "description": ("product", "www")}

# fixed values: patterns of masks
LETTERNUMBER = r"(?=[A-Za-z,.]*\d+[A-Za-z,.]*)(?=[\d,.]*[A-Za-z]+[\d,.]*)[A-Za-z\d,.]{2,}(?<![,.])"
NUMBER = r"\b([0-9]+.[0-9]+)|([0-9]+)\b"

# fixed values: English stop words of the analyzer
STOP_WORDS = [
    "a", "about", "above", "after", "again", "against", "all", "am", "an", "and", "any", "are", "aren't", "as", "at", "be",
    "because", "been", "before", "being", "below", "between", "both", "but", "by", "can't", "cannot", "could", "couldn't",
    "did", "didn't", "do", "does", "doesn't", "doing", "don't", "down", "during", "each", "few", "for", "from", "further",
    "had", "hadn't", "has", "hasn't", "have", "haven't", "having", "he", "he'd", "he'll", "he's", "her", "here", "here's",
    "hers", "herself", "him", "himself", "his", "how", "how's", "i", "i'd", "i'll", "i'm", "i've", "if", "in", "into", "is",
    "isn't", "it", "it's", "its", "itself", "let's", "me", "more", "most", "mustn't", "my", "myself", "no", "nor", "not", "of",
    "off", "on", "once", "only", "or", "other", "ought", "our", "ours", "ourselves", "out", "over", "own", "same", "shan't",
    "she", "she'd", "she'll", "she's", "should", "shouldn't", "so", "some", "such", "than", "that", "that's", "the", "their",
    "theirs", "them", "themselves", "then", "there", "there's", "these", "they", "they'd", "they'll", "they're", "they've",
    "this", "those", "through", "to", "too", "under", "until", "up", "very", "was", "wasn't", "we", "we'd", "we'll", "we're",
    "we've", "were", "weren't", "what", "what's", "when", "when's", "where", "where's", "which", "while", "who", "who's",
    "whom", "why", "why's", "with", "won't", "would", "wouldn't", "you", "you'd", "you'll", "you're", "you've", "your", "yours",
    "yourself", "yourselves",
]

# fixed values: further stop words of the tokenizer
MORE_STOP_WORDS = [
    "http", "tweet", "retweet", "rt", "twitter", "https", "tweets", "home", "sale", "number", "#ff", "ff",
]

# fixed values: words that end a page's address
PAGE_WORDS = [
    "html", "htm", "aspx", "asp", "jsp", "cgi",
]

# fixed values: separators of breadcrumbs, in the order in which they are looked for, and the patterns that " > " replaces
BREADCRUMB_SEPARATORS = [
    ("//", r"\s*//\s*"),
    (" ?", r"\s*\?\s*"),
    ("::", r"\s*::\s*"),
    (":", r"\s*:\s*"),
    ("›", r"\s*›\s*"),
    ("»", r"\s*»\s*"),
    ("\\|", r"\s*[\\|]+\s*"),
    ("|", r"\s*\|\s*"),
    ("/ ", r"\s*/\s+"),
    ("  ", r" \s+"),
]

# fixed values: what marks an address or a comment, which is no category
NO_CATEGORY = ["http", "node", "<!--", "-->"]

# fixed values: signs that stand between elements of a category, and runs of such signs
CATEGORY_SIGNS = ["\t", " › ", "\\|"]
CATEGORY_PATH = r" [>/|]+[ >]*"

# fixed values: first elements that say nothing, and elements that are offers or prices
EMPTY_HEAD = "^(College|[A-Z]{3,6})$"
OFFER_OR_PRICE = r"Sale|Deals|[$£€]+\s*[0-9]+"

#: Columns of the newer gold-standard layout, its name and that of the older one, or a constant.
GOLD_LAYOUT = (
    ("URL", "url"), ("Name", "name"), ("Site specific category", "category"), ("Description", "description"),
    ("Lvl1", "lvl1"), ("Lvl2", "lvl2"), ("Lvl3", "lvl3"), ("Solr index", None), ("Record ID", None),
)
