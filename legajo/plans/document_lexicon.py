"""Lexicon and detectors that occur in the driver's documents (fixed values)."""

from __future__ import annotations

from legajo.operators.classify import Rule

# fixed values: types, terms and gates of the document fixture
DOCUMENT_LEXICON = [
    Rule("t_license", ["license", "released under", "apache"], ["license"], ["mit", "version"], []),
    Rule("t_contact", ["@mail", "example.com"], ["@"], ["src1"], ["license"]),
    Rule("t_secret", ["token", "secret"], [], ["="], ["license"]),
    Rule("t_de", ["der ", "und ", "nicht"], [], ["ersch"], ["que "]),
    Rule("t_fr", ["pour ", "les ", "par "], [], ["outre"], ["und "]),
    Rule("t_es", ["para ", "los ", "que "], [], ["mente"], ["pour ", "und "]),
    Rule("t_en", ["the ", "and ", "with "], [], ["tion"], ["der ", "que "]),
]

# fixed values: terms of the counting and first-hit detectors on the fixture
DOCUMENT_DETECTOR = {
    "german": ["der ", "und ", "nicht", "die "],
    "french": ["pour ", "les ", "par ", "dans"],
    "spanish": ["para ", "los ", "que ", "con "],
    "english": ["the ", "and ", "with ", "for "],
}
DOCUMENT_NAME_DETECTOR = {
    "first_ten": ["src1_", "src2_", "src3_", "src4_"],
    "teens": ["src1"],
    "fives": ["5.pdf"],
}

# fixed values: recipient patterns of the fixture
DOCUMENT_RECIPIENT_PATTERNS = (
    r"(\S+@\S+)",
    r"token = \"?([0-9a-f]+)",
)
