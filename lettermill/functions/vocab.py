"""Word lists, patterns and formats that results depend on."""

# Patterns of phones, e-mail addresses and project numbers, the same in Java, Python and RE2.
PHONE = r"(?:(?:\+|00)\d[\d\s()/-]{5,}\d|\b0\d[\d\s()/-]{5,}\d\b|\b\d{6,}\b)"
PHONE_BOUNDED = r"(?:(?:\+|00)\d[\d\s()/-]{5,}\d|\b0\d[\d\s()/-]{5,}\d\b|\b\d{6,17}\b)"
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
PROJECT_NUMBER = r"^\s*(\d{2}[-\s]\d{3})"
PLACEHOLDER = r"\b(test\d*|demo|sample|dummy|example)\b"
LEAST_PHONE_DIGITS, MOST_PHONE_DIGITS = 6, 17

# Folding of German letters, in this order.
GERMAN = (("Ä", "Ae"), ("Ö", "Oe"), ("Ü", "Ue"), ("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"))

BUSINESS_HINTS = (
    "telefon", "telefax", "fax", "e-mail", "email", "web", "www", "gmbh", " ag ", " ug ", " kg ", "e.v", "strasse", "str.", "str",
    "gesellschaft", "sitz", "handelsregister", "betriebsnummer", "amtsgericht", "hrb", "ust",
)
GENERIC_MAILBOXES = (
    "info", "kontakt", "contact", "office", "mail", "hello", "team", "support", "service", "sales", "vertrieb", "einkauf", "jobs", "job",
    "bewerbung", "bewerbungen", "karriere", "career", "hr", "admin", "postmaster", "noreply", "no", "reply", "datenschutz", "privacy",
    "billing", "invoice", "buchhaltung", "accounting", "marketing", "presse", "press",
)
SIGN_OFFS = (
    "mit freundlichen gruessen", "mit freundlichem gruss", "mit freundlichem grusse", "freundliche gruesse", "beste gruesse",
    "viele gruesse", "best regards", "kind regards", "regards", "mfg",
)
SIGNATURE_RULES = ("--", "---", "__", "___")
CONTACT_HINT = r"(telefon|tel\.?|telefax|fax|mobil|handy|durchwahl|e-?mail|web|www\.|http|gmbh|\bag\b|\bug\b|\bkg\b|str\.|stra[sz]e|adresse|hrb|ust)"
LEGAL_NUMBER = r"(hrb|hraa|handelsregister|registergericht|amtsgericht|ust|ust-id|umsatzsteuer|steuernummer|tax|iban|bic)"
SIGNATURE_FOOTER = r"(vorsitzender|aufsichtsrat|geschaeftsfuehrer|geschaeftsfuehrerin|sitz der gesellschaft|amtsgericht|handelsregister|hrb|ust|www\.|http)"
ROLE_TITLE = r"(?:geschaeftsfuehrer(?:in)?|ceo|inhaber|vorstand|gf)"
CONTINUATION = r"^(telefon|tel\.?|mobil(?:telefon)?|handy|fax|telefax|durchwahl|e-?mail|de-?mail|web(?:site)?|www\.|http)"

HONORIFICS = ("herr", "frau", "hr", "fr", "prof", "professor", "dr", "doktor", "ing", "ingenieur", "ingenieurin", "ingeneur", "dipl", "diplom", "dipl-ing", "dipl.-ing", "dipl ing")
LEADING_TITLE = r"^(?:(?:herr|frau|hr|fr|prof(?:essor)?|dr|doktor|ing(?:enieur|eneur)(?:in)?|dipl(?:om)?(?:[.\-\s]*ing(?:enieur|eneur)(?:in)?)?)\.?\s+)+"
LEADING_PREFIX = r"^(?:(?:i\.?\s*a\.?|i\.?\s*v\.?|im\s+auftrag|ppa\.?|pp\.?)\s+)+"
TRAILING_DEGREE = r"(?:,\s*|\s+)(?:mba|m\.?sc|b\.?sc|m\.?a|b\.?a|m\.?eng|b\.?eng)\.?$"
NAME_TOKEN = r"[A-ZÄÖÜ][a-zäöüß]+(?:[-'][A-ZÄÖÜ]?[a-zäöüß]+)?"
NAME = rf"({NAME_TOKEN}(?:\s+{NAME_TOKEN}){{1,2}})"
NAME_CAPS = r"([A-ZÄÖÜ]{2,}(?:\s+[A-ZÄÖÜ]{2,}){1,2})"
CONTACT_LINE = (
    r"(?P<company>[^\n;]+?)\s*[-–—]\s*"
    r"(?P<full_name>[A-ZÄÖÜ][\w'.`\-]+(?:\s+[A-ZÄÖÜ][\w'.`\-]+){1,3})\s*;\s*"
    r"(?P<phone>(?:(?:\+|00)\d[\d\s()/-]{5,}\d|\b\d{6,}\b))"
    r"(?:\s*;\s*(?P<email>[A-Z0-9._%+\-]+@[A-Z0-9.\-]+\.[A-Z]{2,}))?"
)
NON_PERSON_COMPANY = ("gmbh", "ag", "ug", "kg", "llc", "inc", "ltd", "limited", "company", "co", "corp", "corporation", "group", "holding")
NON_PERSON_ORGANISATION = (
    "fachbereich", "abteilung", "projektleitung", "development", "netzbetrieb", "waerme", "fernwaerme", "betriebsingenieur", "referat",
    "dezernat", "sachgebiet", "sekretariat", "verwaltung", "stadtverwaltung", "amt", "behoerde", "stadt", "gemeinde", "landkreis",
    "ministerium", "department", "team", "service", "support", "office", "unit",
)
ADDRESS_PREFIXES = ("am", "an", "auf", "bei", "im", "in", "vom", "von", "zur", "zum")
GREETING_PHRASES = ("beste gruesse", "freundliche gruesse", "mit freundlichen gruessen", "viele gruesse", "best regards", "kind regards", "many thanks", "thanks and regards")
NON_PERSON_PHRASES = ("fuer fragen", "for questions", "unser team", "ihr team", "our team", "customer service", "service center", "service-center")
GREETING_TOKENS = ("hallo", "hi", "hey", "dear", "liebe", "lieber", "moin", "servus")
DOMAIN_PREFIXES = ("pb", "my", "mail", "team", "office", "info", "kontakt")

HEADER_KEYS = ("von", "from", "an", "to", "cc", "bcc", "kopie", "copy", "antwort an", "reply-to", "reply to", "betreff", "subject", "gesendet", "sent", "datum", "date")
HEADER_TEXT = r"^(gesendet\s+am|sent\s+on|am\s+.+\s+schrieb|on\s+.+\s+wrote)\b"
SUBJECT_PREFIX = r"^(wg|aw|fw|fwd)\s*:"
FORWARD_BANNER = r"^-+\s*(urspruengliche nachricht|original message|weitergeleitete nachricht|forwarded message)\s*-+$"
FORWARD_TEXT = r"^(anfang der weitergeleiteten nachricht|begin forwarded message|forwarded message)\b"
HISTORY_BANNER = r"^\s*(anfang der weitergeleiteten nachricht|begin forwarded message|-+\s*(urspruengliche nachricht|original message|weitergeleitete nachricht|forwarded message)\s*-+)\s*$"
REPLY_INTRO = r"^\s*(am\s+.+\s+schrieb|on\s+.+\s+wrote|gesendet\s+am|sent\s+on)\b"
QUOTE_PREFIX = r"^\s*>+(?:\s+|$)"
INLINE_CONTENT = r"\b(bitte|ich|wir|du|sie|kannst|koennen|koennten|anbei|wegen|bezueglich|please|we|i|you|can|could|attached|regarding)\b"
FUZZY_GREETINGS = ("hallo", "guten tag", "guten morgen", "guten abend", "sehr geehrte damen und herren", "hello", "dear sir or madam", "to whom it may concern")
FUZZY_LEAST = 85
HEADER_ARTIFACT = r"^[\s<>\"']+$"
#: Greetings, each followed by an optional comma; `.+` stands for a name.
GREETINGS = (
    "sehr geehrte damen und herren", "sehr geehrte frau .+", "sehr geehrter herr .+", "sehr geehrte[rn]? .+",
    "guten tag", "guten tag .+", "guten morgen", "guten abend",
    "hallo", "hallo .+", "liebe frau .+", "lieber herr .+", "liebe[rn]? .+",
    "hi", "hey", "hey .+", "servus", "moin", "moin moin", "grüß gott", "gruess gott",
    "liebes team", "liebes support[- ]team", "hallo zusammen", "guten tag zusammen",
    "dear sir or madam", "dear sir", "dear madam", "to whom it may concern",
    r"dear mr\.? .+", r"dear mrs\.? .+", r"dear ms\.? .+", r"dear dr\.? .+", r"dear prof\.? .+", "dear .+",
    "good morning", "good afternoon", "good evening", "hello", "hello .+", "hi .+", "yo",
    "dear team", "hello team", "hi team", "hello everyone", "hi everyone", "dear all",
)

BLOCK_TAGS = (
    "address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
)

SCHEMA_VERSION = "1.0"
DEFAULT_ACCOUNT = "bewerbung"
SCOPE_HEADERS = ("von:", "from:", "gesendet:", "sent:", "an:", "to:", "cc:", "bcc:")
OVERFLOW_SLOTS = ("CompanyMainPhone", "OtherTelephone", "PrimaryPhone", "AssistantPhone", "Callback", "CarPhone", "Pager", "RadioPhone", "Telex", "TtyTddPhone", "Isdn")
PAYLOAD_PHONE_TYPES = (
    ("fax", ("telefax", "fax")),
    ("mobile", ("mobil", "mobile", "handy", "cell")),
    ("home", ("home", "privat", "private")),
    ("business", ("business", "work", "office", "telefon", "phone", "tel", "zentrale", "durchwahl", "direct")),
)
DTO_PHONE_TYPES = (
    ("fax", ("fax",)),
    ("mobile", ("mobil", "mobile", "handy", "cell")),
    ("home", ("home", "privat", "private")),
    ("business", ("business", "office", "work", "telefon", "phone", "tel")),
)
TYPE_RANK = {"fax": 4, "mobile": 3, "home": 3, "business": 2, "other": 1}
STORE_STATES = ("Success", "DestinationNotFound", "ShareUnavailable", "CopyFailed", "SourceNotFound", "InvalidTargetFileName")
