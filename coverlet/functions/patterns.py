"""Patterns and word lists of the documents' conventions.

All are fixed values: results depend on them as they are. JAVA_* are for Spark's regular expressions, where (?d) makes
only line feeds end lines and (?iu) ignores case in all scripts; the others are for Python's.
"""

from __future__ import annotations

import re

STOPWORDS = (
    "a an the and or of to in on for with without within into onto from by at as is are was were "
    "be been being this that these those it its it's their his her they he she we you your our "
    "which who whom what when where why how not no nor but if then than so such can may might "
    "will would shall should must do does did have has had also etc using use used via each"
).split()

#: (suffix, what replaces it, letters that must be left)
STEM_RULES = (("ies", "y", 1), ("ing", "", 3), ("ed", "", 3), ("es", "", 2), ("s", "", 2))

#: Ligature code points and their letters; the control codes count only before a small letter.
CONTROL_LIGATURES = (("\x0b", "ff"), ("\x0c", "fi"), ("\x0d", "fl"), ("\x0e", "ffi"), ("\x0f", "ffl"))
LIGATURES = (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "ft"), ("ﬆ", "st"))

GENERIC_TITLES = ("", "untitled", "microsoft word", "document")
NOT_SURNAMES = (
    "applications application introduction properties fundamentals basics overview "
    "analysis design types definition definitions examples theory methods method "
    "concepts principles problems problem review summary notes"
).split()

COURSE_CODE = re.compile(r"\b(?!(?:CO|PO|PSO)\d)(\d{0,2}[A-Z]{2,4}\d{2,5}[A-Z]?|\d{4,6}[A-Z]\d{1,3})\b")
UNIT_HEADER = re.compile(r"^\s*UNIT\s*[-–:]?\s*([IVXLCDM]+|\d+)\s*[-–:]?\s*(.*)$", re.I | re.M)
NUMBERED_ENTRY = re.compile(r"^\s*(\d{1,2})[\.\)]?\s+(.*\S)\s*$", re.M)
TEXTBOOK_HEADER = re.compile(r"^\s*TEXT\s*BOOKS?\s*:?\s*$", re.I | re.M)
REFERENCE_HEADER = re.compile(r"^\s*REFERENCE(S)?(\s*BOOKS?)?\s*:?\s*$", re.I | re.M)
SECTION_END = re.compile(
    r"\b(ASSESSMENT|COs?[-\s]{0,3}POs?([-\s]{0,3}PSOs?)?|OUTCOMES?|"
    r"TOTAL\s*[:\-]?\s*(CONTACT\s+)?\d*\s*(PERIODS|HOURS)|COURSE\s+OBJECTIVES?|"
    r"COURSE\s+DESIGNERS?|RECOMMENDED\s+BY\s+BOARD|SPECIAL\s+POINTS\s+APPLICABLE|"
    r"SUGGESTED\s+ACTIVITIES|MODE\s+OF\s+EVALUATION|TEXT\s*BOOKS?|REFERENCE(S)?(\s*BOOKS?)?|"
    r"UNIT\s*[-–:]?\s*(?:[IVXLCDM]+|\d+)\b)\s*:?",
    re.I,
)
BARE_SYLLABUS = re.compile(r"S-\s*Strong;\s*M-\s*Medium;\s*L-\s*Low\s*\n[ \t]*SYLLABUS\s*:?\s*\n", re.I | re.M)
CAPS_HEADING = re.compile(r"^[A-Z0-9][A-Z0-9 &\-,/().:'ʼ]{1,98}[A-Z0-9).]$")

JAVA_OBJECTIVES = r"(?iud)OBJECTIVES?\s*:?|PREAMBLE\s*:?"
JAVA_SECTION_END = "(?iud)" + SECTION_END.pattern
JAVA_TOPIC_SPLIT = r"\s+[–—-]\s+"
JAVA_UNIT_TITLE_TAIL = r"(?s)\s+\d{1,3}(?![A-Za-z]).*$"
JAVA_LONE_NAME = r"^[A-Z][A-Za-z’'.]+$"
JAVA_EPONYM_HEAD = r"^[A-Z][A-Za-z’'.]+\b"
JAVA_EPONYM_THING = (
    r"(?iu)\b(theorem|method|rule|equation|equations|formula|series|law|laws|criterion|criteria|test|process|"
    r"algorithm|transformation|elimination|iteration|orthogonalization|orthogonalisation|identity|inequality|"
    r"polynomial|polynomials|expansion|approximation)\b"
)

JAVA_CONTENTS = r"(?iud)\bTABLE\s+OF\s+CONTENTS\b|\bCONTENTS\b"
JAVA_TOC_LINE = r"(?d)^.{3,90}?[\.\s]{2,}\d{1,4}\s*$|^.{3,90}\s\d{1,4}\s*$"
JAVA_TOC_NOISE = r"(?iud)^(CONTENTS?|TABLE OF CONTENTS|[ivxlcdm]+|\d{1,4})$"
JAVA_TOC_LEADER = r"(?d)^(.*?)[\.…\s]{3,}(\d{1,4})\s*$"
JAVA_TOC_TRAILING = r"(?d)^(.*\S)\s+(\d{1,4})\s*$"
JAVA_TOC_HEADER_LEAK = r"(?iud)^(?:[ivxlcdm]{1,6}\s+)?contents\s+(?:[ivxlcdm]{1,6}\s+)?"
JAVA_NUMERIC_LABEL = r"(?d)^(\d+(?:\.\d+)*)[\.\):]?\s+(.*)$"
JAVA_CHAPTER_LABEL = r"(?iud)^(Chapter|Unit|Part)\s+(\d+|[IVXLCDM]+)[\.\):]?\s*(.*)$"
TOC_PENDING_WORDS = 25
JAVA_ROMAN = r"^M{0,4}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$"
JAVA_UNIT_NUMBER = r"(?iu)UNIT\s*[-:]?\s*([IVXLCDM]+|\d+)"
JAVA_EDITION = r"(?iu)(\d+)(?:st|nd|rd|th)\s+Edition"
JAVA_YEAR = r"\b((?:19|20)\d{2})\b"

#: Rewrites of a syllabus, in order: (rule, pattern, replacement).
STANDARD_RULES = (
    ("book_parenthetical_plural", r"(?iu)\bBOOKS?\(s\)", "BOOKS"),
    ("whitespace_noise", "[\u00a0\u2007\u202f]|\\x0c", None),
    ("course_code_cohort_prefix", r"\bPT(?=[A-Z]{2,3}\d{3,4}\b)", ""),
    ("bullet_marker", r"(?md)^[ \t]*[•◦▪●‣∙·]\s*", " – "),
    ("unit_header_synonym", r"(?imud)^(\s*)(MODULE|CHAPTER|BLOCK)(?=\s*[-–:]?\s*(?:[IVXLCDM]+|\d+)\b)", "$1UNIT"),
    ("objectives_header_synonym", r"(?imud)^[ \t]*(?:COURSE\s+)?AIMS?\s*:?\s*$", "OBJECTIVES:"),
    ("textbook_header_synonym", r"(?imud)^[ \t]*(?:PRESCRIBED\s+(?:TEXT\s*)?BOOKS?|(?:TEXT\s*)?BOOKS?\s+PRESCRIBED|RECOMMENDED\s+TEXT\s*BOOKS?)\s*:?\s*$", "TEXT BOOKS:"),
    ("reference_header_synonym", r"(?imud)^[ \t]*(?:BIBLIOGRAPHY|(?:SUGGESTED|FURTHER|ADDITIONAL|RECOMMENDED)\s+(?:READINGS?|BOOKS?))\s*:?\s*$", "REFERENCE BOOKS:"),
)

#: Scope notes of citations, and titles in them.
BRACKET = re.compile(r"\[([^\[\]]*)\]")
UNITS_AND_SECTIONS = re.compile(r"Units?\s+(.+?)\s*[-–—:]\s*Sections?\s+(.+)$", re.I | re.S)
UNITS_ONLY = re.compile(r"Units?\s+(.+?)(?:\bSections?\b|$)", re.I | re.S)
SECTIONS_ONLY = re.compile(r"Sections?\s+(.+)$", re.I | re.S)
PARENTHESES = re.compile(r"\([^)]*\)")
SECTION_RANGE = re.compile(r"^(\d+(?:\.\d+)*)\s*(?:to|[-–—])\s*(\d+(?:\.\d+)*)$", re.I)
SECTION_LABEL = re.compile(r"\d+(\.\d+)*")
UNIT_TOKEN = re.compile(r"[IVXLCDM]+|\d+")
UNIT_RANGE_GAP = re.compile(r"^\s*(?:to|through|thru|[-–—])\s*$", re.I)
LONGEST_RANGE = 30
QUOTED_TITLE = re.compile(r"[\"“”‘’']([^\"“”‘’']{4,90})[\"“”‘’']")
TITLE_BY = re.compile(r"^(.*?)\s+By\s+", re.I)

#: Columns of the recommendation report and their headings.
REPORT_COLUMNS = (
    ("syllabus_name", "Syllabus"),
    ("subject_code", "Subject Code"),
    ("subject_name", "Subject Name"),
    ("module_number", "Unit"),
    ("module_title", "Unit Title"),
    ("topic", "Topic"),
    ("sub_topic", "Sub Topic"),
    ("status", "Status"),
    ("book_title", "Book Title"),
    ("author", "Author"),
    ("edition", "Edition"),
    ("publisher", "Publisher"),
    ("year", "Year"),
    ("book_type", "Book Type"),
    ("chapter", "Chapter"),
    ("page_start", "Book Page Start"),
    ("page_end", "Book Page End"),
    ("pdf_page_start", "PDF Page Start"),
    ("pdf_page_end", "PDF Page End"),
    ("coverage_percent", "Coverage %"),
    ("notes", "Notes"),
)
NOTE_NOTHING_RESOLVED = "No cited textbook/reference for this subject was found among the local books"
NOTE_NOTHING_COVERS = "Cited books available locally, but none covered this topic above the coverage threshold"
NOTE_UNREADABLE = (" (no extractable text in: ", " -- scanned PDF, needs OCR)")
