"""What results must agree with, stated as they are."""

# Ligatures and what replaces them.
LIGATURES = {
    "ﬁ": "fi",
    "ﬂ": "fl",
    "ﬃ": "ffi",
    "ﬄ": "ffl",
    "ﬅ": "st",
    "ﬆ": "st",
}

# Rare quotes and what replaces them; the standard curly quotes stay.
RARE_QUOTES = {
    "‚": ",",
    "‛": "'",
    "„": '"',
    "‟": '"',
    "′": "'",
    "″": '"',
    "‴": "'''",
    "‵": "'",
    "‶": '"',
    "«": '"',
    "»": '"',
    "‹": "'",
    "›": "'",
    "ʼ": "'",
    "ʻ": "'",
}

# Bullets that become "- ".
BULLETS = "•‣–◦▪·"

# Superscript digits.
SUPERSCRIPTS = "⁰¹²³⁴⁵⁶⁷⁸⁹"

# Words that open an editorial footer after a page number.
EDITORIAL = ("PART", "Chapter", "Section", "APPENDIX", "Volume", "Module", "Unit")

# Patterns whose number of hits tells the language of a code block.
LANGUAGES = {
    "rust": (r"\bfn\b", r"\blet\s+mut\b", r"\bimpl\b", r"->", r"::", r"\bpub\b", r"\bmatch\b", r"\benum\b", r"\bstruct\b"),
    "go": (r"\bfunc\b", r"\bpackage\b", r"\bimport\b", r":=", r"\bdefer\b", r"\bchan\b", r"\bgoroutine\b"),
    "python": (r"\bdef\b", r"\bfrom\b", r"\bclass\b", r"\bprint\(", r"\bself\b", r"if __name__", r"\belif\b", r"\bpass\b"),
    "javascript": (r"\bfunction\b", r"\bconst\b", r"\bvar\b", r"=>", r"\bconsole\.", r"\brequire\(", r"\bdocument\."),
    "typescript": (r"\binterface\b", r"\btype\b", r":\s*(string|number|boolean|void)\b", r"\bas\b", r"\benum\b"),
    "c": (r"#include", r"\bprintf\(", r"\bint\s+main\b", r"\bvoid\b", r"#define", r"\bNULL\b"),
    "cpp": (r"\bstd::", r"\bcout\b", r"\btemplate\b", r"\bnullptr\b", r"\bnamespace\b", r"->"),
    "java": (r"\bpublic\s+class\b", r"\bpublic\s+static\b", r"\bvoid\s+main\b", r"System\.out", r"\bnew\s+\w+\("),
    "bash": (r"^#!.*sh", r"\becho\b", r"\bif\s*\[", r"\bfi\b", r"\bdone\b", r"\$\{?"),
    "sql": (r"\bSELECT\b", r"\bFROM\b", r"\bWHERE\b", r"\bINSERT\s+INTO\b", r"\bUPDATE\b", r"\bCREATE\s+TABLE\b", r"\bJOIN\b"),
}

# Parts of names of fonts with fixed widths.
MONOSPACE = ("Courier", "Consolas", "Menlo", "Monaco", "RobotoMono", "Roboto Mono", "SourceCodePro", "Source Code Pro", "LiberationMono", "DejaVuSansMono", "Inconsolata", "Andale Mono", "PT Mono")

# Compounds that keep their hyphen where a line breaks at it.
COMPOUNDS = (
    "well-known",
    "well-defined",
    "well-formed",
    "well-being",
    "well-deserved",
    "well-documented",
    "well-structured",
    "well-designed",
    "well-tested",
    "well-written",
    "well-established",
    "well-aware",
    "well-intentioned",
    "well-meaning",
    "well-read",
    "well-spoken",
    "well-suited",
    "well-supported",
    "well-versed",
    "well-worth",
    "long-term",
    "long-lived",
    "long-standing",
    "long-running",
    "long-range",
    "long-lasting",
    "long-awaited",
    "long-distance",
    "long-time",
    "short-term",
    "short-lived",
    "short-range",
    "mid-term",
    "mid-range",
    "high-level",
    "low-level",
    "high-performance",
    "high-quality",
    "low-quality",
    "high-resolution",
    "high-speed",
    "high-energy",
    "low-energy",
    "low-cost",
    "low-latency",
    "high-latency",
    "high-throughput",
    "low-throughput",
    "high-end",
    "low-end",
    "high-priority",
    "high-order",
    "low-order",
    "self-contained",
    "self-driving",
    "self-aware",
    "self-taught",
    "self-signed",
    "self-hosted",
    "self-managed",
    "self-paced",
    "self-service",
    "self-sustaining",
    "self-sufficient",
    "self-discipline",
    "self-esteem",
    "self-evident",
    "self-explanatory",
    "self-regulating",
    "non-functional",
    "non-blocking",
    "non-trivial",
    "non-empty",
    "non-zero",
    "pre-existing",
    "pre-built",
    "pre-configured",
    "pre-installed",
    "pre-loaded",
    "pre-defined",
    "pre-determined",
    "pre-requisite",
    "pre-release",
    "post-processing",
    "post-mortem",
    "post-operative",
    "post-script",
    "re-engineered",
    "re-enter",
    "re-evaluate",
    "sub-process",
    "sub-agent",
    "sub-tree",
    "sub-class",
    "sub-array",
    "super-user",
    "super-admin",
    "over-engineered",
    "over-constrained",
    "under-represented",
    "part-time",
    "full-time",
    "real-time",
    "down-time",
    "up-time",
    "run-time",
    "compile-time",
    "design-time",
    "build-time",
    "load-time",
    "start-up",
    "cost-effective",
    "cost-efficient",
    "cost-of-living",
    "time-consuming",
    "time-dependent",
    "time-sensitive",
    "time-tested",
    "time-honored",
    "labor-intensive",
    "labor-saving",
    "state-of-the-art",
    "state-of-mind",
    "out-of-the-box",
    "mother-of-pearl",
    "man-of-war",
    "jack-of-all-trades",
    "lily-of-the-valley",
    "tip-of-the-iceberg",
    "in-line",
    "on-line",
    "off-line",
    "out-of-date",
    "out-of-bounds",
    "out-of-scope",
    "out-of-stock",
    "up-to-date",
    "up-to-the-minute",
    "step-by-step",
    "side-by-side",
    "face-to-face",
    "back-to-back",
    "front-end",
    "back-end",
    "open-source",
    "closed-form",
    "real-valued",
    "complex-valued",
)

# Lines that are page numbers; the last form takes one of EDITORIAL.
PAGE_NUMBER_LINES = (
    r"\d+",
    r"[—–-]\s*\d+\s*[—–-]",
    r"\d+\s*\|.+",
    r".+\|\s*\d+",
    r"\s*\d{1,4}\s{2,}(?:PART|Chapter|Section|APPENDIX|Volume|Module|Unit)\s+\S.*",
)

# Forms of headings.
CHAPTER_LINE = r"(?i)\A(?:chapter|cap[ií]tulo|cap\.?)\s+\d+"
NUMBERED_3_LINE = r"\A\d+\.\d+\.\d+\s+\S"
NUMBERED_2_LINE = r"\A\d+\.\d+\s+\S"
CAPITALS_LINE = r"\A[A-Z][A-Z\s]{2,80}\z"

# First lines of pages that begin a chapter.
CHAPTER_PAGE = r"(?i)\A(chapter|cap[ií]tulo)\s+\d+\b"
NUMBERED_PAGE = r"\A\d+\.\s+[A-Z]"

# What is cut from titles of chapters.
CHAPTER_PREFIX = r"(?i)\A\s*(?:chapter|cap[íi]tulo|cap\.?|secci[óo]n|section|part|parte)\s+\d+\s*[:.\-]\s*"

# Lines that paragraphs aren't joined with: headings, list items, quotes, fences.
SKIPPED_LINE = r"\A\s*(?:#{1,6}\s+\S|(?:[-*+]|\d+[.)])\s+\S|>|```|~~~)"

# Tables: lines with pipes, and rules.
PIPES = r"\s*\|.*\|.*\|?\s*$"
TABLE_RULE = r"\s*\|?\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)+\|?\s*$"
UNSTRUCTURED = "<!-- tabla no estructurada -->"

# Definitions of footnotes, and captions of figures.
NOTE = r"\s*(\d+)[.)]\s+(.*)$"
CAPTION = r"(?i)\A(figura|figure|fig\.?)\s+(\d+)\.(\d+)\s*([—\-:])\s*(.+?)\s*\z"
OMITTED_FIGURE = "<!-- figura omitida: Figura "

# Words broken at the end of a line.
BROKEN_WORD = r"([^\W\d_]+)-\n([^\W\d_]+)"

# Study: statuses, and sections that are added.
READING_STATUSES = ("unread", "in_progress", "read")
STUDY_SECTIONS = ("Resumen", "Conceptos clave", "Dudas")

# Fields of front matter, in their order.
FRONT_FIELDS = ("title", "book", "chapter", "pages", "source_file", "source_sha256", "converted_at", "engine_version", "reader_version", "cleaners_applied")
