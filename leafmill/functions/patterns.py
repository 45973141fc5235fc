"""Patterns and word lists that decide results."""

from __future__ import annotations

# Personal-data patterns (name, pattern, case-insensitive, replacement), in the
# order they are applied. Each one sees text the earlier ones already rewrote.
PII_GENERAL = (
    ("email", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Z|a-z]{2,}\b", False, "[EMAIL REDACTED]"),
    ("phone", r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b", False, "[PHONE REDACTED]"),
    ("ssn", r"\b\d{3}[-\s]?\d{2}[-\s]?\d{4}\b", False, "[SSN REDACTED]"),
    ("card", r"\b(?:\d{4}[\s\-]?){3}\d{4}\b", False, "[CARD REDACTED]"),
    ("iban", r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b", False, "[IBAN REDACTED]"),
    ("passport", r"\b[A-Z]{1,2}\d{6,9}[A-Z]?\b", False, "[PASSPORT REDACTED]"),
    ("license", r"\b(?:DL|Driver'?s?\s+License)[:\s]*[A-Z0-9]{7,15}\b", True, "[LICENSE REDACTED]"),
)
PII_MEDICAL = (
    (
        "mrn",
        r"\b(?:MRN|Medical\s+Record(?:\s+Number)?|Patient\s+ID)[:\s]*[A-Z0-9\-]{5,20}\b",
        True,
        "[MRN REDACTED]",
    ),
    ("npi", r"\b(?:NPI)[:\s]*\d{10}\b", True, "[NPI REDACTED]"),
    ("dob", r"\b(?:DOB|Date\s+of\s+Birth|born)[:\s]*\d{1,2}[\/\-]\d{1,2}[\/\-]\d{2,4}\b", True, "[DOB REDACTED]"),
    (
        "patient_name",
        r"\b(?:Patient|Name|Pt)[:\s]*([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)",
        True,
        "[PATIENT NAME REDACTED]",
    ),
)
PII_LEGAL = (
    ("contract_party", r"\b(?:Party\s+[A-Z]|Signatory|Contractor)[:\s]*([A-Z][a-z\s]+)", True, "[PARTY REDACTED]"),
    ("signature", r"\b(?:Signed|Signature)[:\s]*([A-Z][a-z\s]+)", True, "[SIGNATURE REDACTED]"),
)
PII_LOGISTICS = (
    ("account", r"\b(?:Account|Acct)?\s*#?[:\s]*\d{8,17}\b", True, "[ACCOUNT REDACTED]"),
    ("po", r"\b(?:PO|Purchase\s+Order|P\.?O\.?)\s*#?[:\s]*[A-Z0-9\-]{5,20}\b", True, "[PO REDACTED]"),
    ("vendor", r"\b(?:Vendor|Supplier|Provider)[:\s]*([A-Z][a-z\s]+)", True, "[VENDOR REDACTED]"),
)
PII_DOMAINS = {"medical": PII_MEDICAL, "legal": PII_LEGAL, "logistics": PII_LOGISTICS}

# Health-record redaction set, all case-insensitive, in order.
HEALTH_REDACTIONS = (
    ("SSN", r"\b\d{3}[-\s]?\d{2}[-\s]?\d{4}\b", "[SSN REDACTED]"),
    ("PHONE", r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b", "[PHONE REDACTED]"),
    ("EMAIL", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Z|a-z]{2,}\b", "[EMAIL REDACTED]"),
    ("DOB", r"\b(?:DOB|Date of Birth|born):?\s*\d{1,2}[\/\-]\d{1,2}[\/\-]\d{2,4}\b", "[DOB REDACTED]"),
    ("MRN", r"\b(?:MRN|Medical Record(?:\s+Number)?|Patient ID):?\s*[\w\-]{5,15}\b", "[MRN REDACTED]"),
    ("NPI", r"\b(?:NPI):?\s*\d{10}\b", "[NPI REDACTED]"),
    (
        "INSURANCE",
        r"\b(?:Policy|Member|Group)\s*(?:No|Number|#):?\s*[\w\-]{5,20}\b",
        "[INSURANCE ID REDACTED]",
    ),
    ("ZIP", r"\b\d{5}(?:-\d{4})?\b", "[ZIP REDACTED]"),
    ("PATIENT_NAME", r"\b(?:Patient|Name|Pt):\s*([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)", "[PATIENT NAME REDACTED]"),
)

# Language by script, first match wins (code, first and last code point).
LANGUAGE_SCRIPTS = (
    ("zh", 0x4E00, 0x9FFF),
    ("ar", 0x0600, 0x06FF),
    ("hi", 0x0900, 0x097F),
    ("ta", 0x0B80, 0x0BFF),
    ("te", 0x0C00, 0x0C7F),
    ("ml", 0x0D00, 0x0D7F),
    ("kn", 0x0C80, 0x0CFF),
    ("bn", 0x0980, 0x09FF),
)

# Indian scripts, ties go to the earlier one.
INDIAN_SCRIPTS = (
    ("tamil", 0x0B80, 0x0BFF),
    ("telugu", 0x0C00, 0x0C7F),
    ("kannada", 0x0C80, 0x0CFF),
    ("malayalam", 0x0D00, 0x0D7F),
    ("hindi", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF),
    ("gujarati", 0x0A80, 0x0AFF),
    ("punjabi", 0x0A00, 0x0A7F),
    ("odia", 0x0B00, 0x0B7F),
)

# Indian identifiers.
PAN = r"\b[A-Z]{5}[0-9]{4}[A-Z]{1}\b"
AADHAAR = r"\b[2-9]\d{3}[\s\-]?\d{4}[\s\-]?\d{4}\b"
GSTIN = r"\b[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z]{1}[A-Z0-9]{1}Z[A-Z0-9]{1}\b"
MOBILE = r"\b(?:\+91[\s\-]?)?[6-9]\d{9}\b"
PINCODE = r"\b[1-9][0-9]{5}\b"

# Number words, tried in this order.
NUMBER_WORDS = (
    ("lakh", 100_000),
    ("lakhs", 100_000),
    ("lac", 100_000),
    ("lacs", 100_000),
    ("crore", 10_000_000),
    ("crores", 10_000_000),
    ("cr", 10_000_000),
)

# Tamil-English query words.
TANGLISH = {
    "aadayam": "income",
    "selevu": "expense",
    "niraivu": "balance",
    "ozhukkam": "compliance",
    "ozhukkukaaran": "compliance officer",
    "ottam": "total",
    "thodakkam": "start date",
    "mudivu": "end date",
    "gnaabagam": "memory",
    "pudiya": "new",
    "payar": "name",
    "thedi": "search",
    "kattam": "table",
    "oozhiyar": "employee",
    "nidhi": "fund",
    "vanigam": "business",
    "seimurai": "procedure",
    "amaippu": "organization",
    "arasaangam": "government",
    "vilakku": "explanation",
    "kanam": "amount",
}

# File signatures in hex (prefix, format), tried in this order.
MAGIC = (
    ("25504446", "pdf"),
    ("504B0304", "docx"),
    ("89504E470D0A1A0A", "png"),
    ("FFD8FF", "jpeg"),
    ("49492A00", "tiff"),
    ("4D4D002A", "tiff"),
    ("424D", "bmp"),
    ("494433", "mp3"),
    ("FFFB", "mp3"),
    ("FFF3", "mp3"),
    ("52494646", "wav"),
    ("4F676753", "ogg"),
    ("1A45DFA3", "webm"),
)

# Format by file suffix.
EXTENSIONS = {
    ".pdf": "pdf",
    ".png": "png",
    ".jpg": "jpeg",
    ".jpeg": "jpeg",
    ".tiff": "tiff",
    ".tif": "tiff",
    ".bmp": "bmp",
    ".docx": "docx",
    ".xlsx": "xlsx",
    ".mp3": "mp3",
    ".mp4": "mp4",
    ".wav": "wav",
    ".m4a": "m4a",
    ".ogg": "ogg",
    ".webm": "webm",
    ".txt": "txt",
}

# Chunking-strategy hints.
CODE_EXTENSIONS = ("py", "js", "ts", "java", "go", "rs", "cpp", "c", "cs", "rb", "php")
TABLE_EXTENSIONS = ("csv", "xlsx", "xls")
TABLE_INDICATORS = r"(\|\s*[-:]+\s*\|)|(<table[\s>])|(^\s*\|)"
CODE_INDICATORS = r"(def |class |function |import |from |#include|public static|SELECT\s+\w)"

# Prefilter words.
OBLIGATION_WORDS = (
    "shall",
    "must",
    "required",
    "obligation",
    "responsible",
    "will",
    "agrees to",
    "undertakes",
)
CLINICAL_WORDS = (
    "diagnosis",
    "patient",
    "prescribed",
    "treatment",
    "mg",
    "symptoms",
    "history",
    "assessment",
    "plan",
)
FORM_WORDS = (
    "invoice",
    "application",
    "form",
    "receipt",
    "order",
    "contract",
    "name:",
    "date:",
    "amount:",
    "total:",
    "signature",
    "address",
    "phone:",
    "email:",
    "id:",
    "no:",
    "#",
    "reference",
    "bill to",
    "ship to",
    "terms:",
    "due:",
    "paid:",
    "balance:",
    "subtotal:",
    "tax:",
    "discount:",
)
GRAPH_WORDS = (
    "who",
    "relationship",
    "connected",
    "between",
    "involves",
    "signed",
    "related",
    "link",
    "path",
    "through",
    "via",
    "all contracts",
    "all documents",
    "which company",
    "what entities",
    "party",
    "parties",
    "counterparty",
    "signatory",
    "affiliates",
)

# Contract clause types and heading patterns.
CLAUSE_TYPES = (
    "liability_cap",
    "indemnification",
    "termination",
    "payment_terms",
    "intellectual_property",
    "confidentiality",
    "governing_law",
    "dispute_resolution",
    "force_majeure",
    "warranty",
    "limitation_of_remedies",
    "assignment",
    "amendment",
    "entire_agreement",
    "other",
)
STANDARD_CLAUSES = (
    "liability_cap",
    "indemnification",
    "termination",
    "payment_terms",
    "governing_law",
    "confidentiality",
)
CLAUSE_HEADINGS = (
    r"(?:Section|Article|Clause|§)\s*[\d\.]+[A-Za-z]?\s*[:\.]?\s*([A-Z][^\.]{5,80})",
    r"\b(?:WHEREAS|NOW,?\s+THEREFORE|IN\s+WITNESS)\b",
    r"\b(?:\d+\.\d+)\s+([A-Z][a-z][\w\s]{5,60})\b",
)

# Graph vocabulary.
ENTITY_TYPES = (
    "Person",
    "Organization",
    "Contract",
    "Clause",
    "Date",
    "Location",
    "Concept",
    "Amount",
    "Document",
    "__Entity__",
)
RELATION_TYPES = (
    "SIGNED_BY",
    "INVOLVES",
    "CONTAINS",
    "REFERENCES",
    "DATED",
    "LOCATED_IN",
    "RELATED_TO",
    "PART_OF",
    "MENTIONS",
    "AUTHORED_BY",
    "EXTRACTED_FROM",
)
