"""Word lists and tables that decide results. All of them are fixed values, in natural order."""

AUDIO_PUBLISHERS = (
    "books on tape", "tantor media", "simon & schuster audio", "hachette audio", "penguin audio", "harperaudio",
    "random house audio", "macmillan audio", "recorded books", "blackstone audio", "audible",
)

LANGUAGES = (
    "french", "russian", "spanish", "german", "italian", "portuguese", "chinese", "japanese", "korean", "arabic", "hebrew",
    "polish", "dutch", "swedish", "norwegian", "danish", "finnish", "greek", "turkish", "hindi", "thai", "vietnamese",
    "indonesian", "malay", "tagalog", "romanian", "hungarian", "czech", "slovak", "croatian", "serbian", "bulgarian",
    "ukrainian", "persian", "urdu", "bengali", "tamil", "telugu", "marathi", "gujarati", "kannada", "malayalam",
    "punjabi", "nepali", "sinhala", "myanmar", "khmer", "lao", "mongolian", "georgian", "armenian", "azerbaijani",
    "kazakh", "uzbek", "turkmen", "kyrgyz", "tajik", "afrikaans", "swahili", "zulu", "xhosa", "amharic", "hausa",
    "yoruba", "igbo", "somali", "maltese", "icelandic", "basque", "catalan", "galician", "welsh", "irish", "scottish",
    "breton", "cornish", "manx",
)

#: Character ranges of scripts: CJK, kana, Cyrillic, Arabic, Hebrew.
SCRIPTS = (("4e00", "9fff"), ("3040", "309f"), ("30a0", "30ff"), ("0400", "04ff"), ("0600", "06ff"), ("0590", "05ff"))
HEBREW_LETTERS = ("05d0", "05ea")
HEBREW_WORDS = (r"\bsheloshah\b", r"\bshel\b", r"\bbe-", r"\bve-", r"\bshavu[\x{05b0}-\x{05ff}]ot\b")
SPANISH_WORDS = ("edici[oó]n", "colecci[oó]n", "estuche", "libro", "libros", "misterio", "pr[ií]ncipe")
HOUSE_NAMES = ("gryffindor", "hufflepuff", "slytherin", "ravenclaw")
ACCENTED_LOWER = "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿąćčđęěğłńňřśşšťůźżž"
ACCENTED_UPPER = "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞŸĄĆČĐĘĚĞŁŃŇŘŚŞŠŤŮŹŻŽ"
#: The review variant compares in any case and has the dotless i.
ACCENTED_REVIEW = "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿąćčđęěğıłńňřśşšťůźżž"
X_WORDS = ("xml", "xhtml", "xaml", "xpath", "xslt", "xquery")
MIXED_CASE_WORDS = ("html", "xml", "api", "url", "pdf", "csv", "json", "iphone", "ipad", "ebook", "epub", "dj", "cv", "abc", "uk", "hbr")
ARTICLES = ("le", "la", "les", "un", "une", "des", "du", "de", "el", "los", "las", "una", "uno", "der", "die", "das", "ein", "eine")
PARTICLES = ("van", "von", "de", "del", "da", "di", "du", "des")

NON_FICTION = (
    "biography", "autobiography", "memoir", "history", "historical", "science", "philosophy", "psychology", "sociology", "economics",
    "business", "self-help", "health", "medicine", "education", "reference", "travel", "cooking", "crafts", "hobbies",
    "religion", "spirituality", "politics", "government", "law", "true crime", "essays", "journalism", "nonfiction", "non-fiction",
)
#: A category list with one of these needs no further mark when it becomes non-fiction.
NON_FICTION_MARKS = ("nonfiction", "non-fiction", "biography", "history")

CHILDRENS_TITLE = (
    r"\bjunior\s+fiction\b", r"\bchildren'?s\s+(?:book|fiction|novel|story)", r"\bkids\s+(?:book|fiction)", r"\byoung\s+adult\b",
    r"\bya\s+(?:book|fiction|novel)", r"\bmiddle\s+grade\b", r"\btween\s+(?:book|fiction)",
)
CHILDRENS_SERIES = (r"\b(?:cul[-\s]?de[-\s]?sac\s+)?kids\b", r"\b(?:goosebumps|percy\s+jackson|diary\s+of\s+a\s+wimpy\s+kid)\b")
AGE_RANGES = (r"ages?\s+\d+\s*[-–—]?\s*\d+", r"for\s+ages?\s+\d+", r"\d+\s*[-–—]\s*\d+\s+years?\s+old", r"grade\s+\d+", r"grades?\s+\d+\s*[-–—]\s*\d+")
CHILDRENS_CATEGORIES = (
    "juvenile fiction", "juvenile literature", "children's fiction", "children's literature", "young adult fiction",
    "young adult literature", "middle grade", "picture book", "early reader", "chapter book",
)
CHILDRENS_DESCRIPTION = (
    "for children", "for kids", "for young readers", "suitable for ages", "recommended for ages", "target audience: children",
    "target audience: kids",
)
KNOWN_CHILDRENS_SERIES = (r"\bgoosebumps\b", r"\bharry potter\b", r"\bpercy jackson\b", r"\bdiary of a wimpy kid\b")
CHILDRENS_CONTEXT = ("children", "kids", "young", "juvenile")

COMPOSITE_SEPARATORS = (" / ", "/", " | ", "|")
COMPOSITE_RANGES = (
    r"books?\s+\d+\s*[-–—]\s*\d+", r"volumes?\s+\d+\s*[-–—]\s*\d+", r"parts?\s+\d+\s*[-–—]\s*\d+", r"\d+\s*[-–—]\s*\d+\s+books?",
    r"box\s+\d+\s*[-–—]\s*\d+", r"boxed\s+set", r"collection\s*:?\s*books?\s+\d+\s*[-–—]\s*\d+",
)

PUBLISHER_PATTERNS = (
    r"\.com$", r"\.org$", r"\.net$", r"\bstaff\b", r"\beditors?\b", r"\bcontributors?\b", r"\bpress\b", r"\bpublishing\b",
    r"\bpublications?\b", r"\binc\.?$", r"\bllc\.?$", r"\bcorp\.?$", r"\bcompany\b", r"\bgroup\b", r"^the\s+\w+\s+press$",
)
PUBLISHER_NAMES = (
    "guideposts", "instructables", "penguin", "harpercollins", "simon", "schuster", "random house", "macmillan", "hachette",
    "scholastic", "disney", "marvel", "dc comics", "time life", "national geographic", "oxford university press",
    "cambridge university press", "mit press", "harvard university press", "yale university press", "princeton university press",
    "stanford university press", "university of chicago press", "university press",
)
#: Labels of publishers by parts of the name, first that holds.
PUBLISHER_LABELS = (
    ("Website domains", (".com", ".org", ".net")),
    ("Staff/Editors", ("staff", "editors", "contributors")),
    ("Press/Publishing", ("press", "publishing", "publications")),
    ("Corporate entities", ("inc", "llc", "corp", "company")),
)

#: Patterns of title parts that don't tell works apart.
SERIES_PAREN = r"\s*\([^)]*(?:series|book\s*#?\s*\d+|#\s*\d+)[^)]*\)"
SERIES_PAREN_STRICT = r"\s*\([^)]*(?:series|book\s+\d+|#\d+)[^)]*\)"
EDITION_PAREN = r"\s*\([^)]*(?:edition|version|translation|ed\.)[^)]*\)"
EDITION_BRACKET = r"\s*\[[^\]]*(?:edition|version|translation|ed\.)[^\]]*\]"
EDITION_PAREN_PLAIN = r"\s*\([^)]*(?:edition|version|translation)[^)]*\)"
EDITION_BRACKET_PLAIN = r"\s*\[[^\]]*(?:edition|version|translation)[^\]]*\]"
EDITION_WORD = r"\b(?:edition|ed\.)\b"
VOLUME = (r"\b(?:volume|vol\.?)\s*(?:i{1,3}|iv|v{1,3}|vi{0,3}|[0-9]+)\b", r"\bvolume\s+\d+\b", r"\bvol\.?\s*\d+\b")
SPLIT_PART = r"\s*\[\d+/\d+\]\s*"
LEADING_ARTICLE = r"^(?:the|a|an)\s+"
APOSTROPHES = "['`]"
#: Inside the first parenthesis: the series' name, then its number.
SERIES_NUMBER = r"(.+?)(?:\s+Book)?\s*#?\s*(\d+)"
