"""Column builders over texts and tokens: splitting, buckets, and the ordered rules that give a token its category."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

WORDS = r"[\p{L}\p{N}_]+"
PIECES = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]|\n"

# Function words, code marks, and tokens that count as code.
FUNCTION_WORDS = (
    "the a an and or but in on at to for of with by from as is was are were be been have has had do does did will would could should may might "
    "shall not no nor it its this that these those he she they we i you him her them us my your our their his"
).split()
CODE_MARKS = ["_", "->", "=>", "==", "!=", "//", "/*", "*/", "()", "[]", "{}"]
CODE_SYMBOLS = [
    ";", "{", "}", "(", ")", "[", "]",
    "</", "/>", "==", "!=", "=>", "->", "&&", "||", "::",
    "++", "--", "+=", "-=", "*=", "/=",
]
CODE_KEYWORDS = [
    "def", "var", "let", "const", "import", "from", "class", "function",
    "return", "elif", "while", "switch",
    "true", "false", "null", "None", "True", "False",
]
CONTENT_BEARING = ["CONTENT", "PROPER_NOUNS"]


def words(text: Column, most: int | None = None) -> Column:
    """Lower-cased words of a text; the first `most` of them, if that is given."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORDS), F.lit(0))
    return F.slice(found, 1, most) if most else found


def _bare_letters() -> tuple[str, str]:
    """Letters up to U+1EFF whose compatibility form is one base letter with marks, and those base letters."""
    pairs = []
    for c in map(chr, range(0xA0, 0x1F00)):
        base = [b for b in unicodedata.normalize("NFKD", c) if not unicodedata.combining(b)]
        if len(base) == 1 and base[0] != c:
            pairs.append((c, base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def without_accents(text: Column) -> Column:
    """text with accents stripped from letters, composed or followed by combining marks."""
    return F.regexp_replace(F.translate(text, *_bare_letters()), r"[\u0300-\u036F]", "")


def pieces(text: Column) -> Column:
    """Words, single marks and line ends in their own case."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PIECES), F.lit(0))


def bucket(token: Column, buckets: int) -> Column:
    """A stable bucket of a token, the same in every engine with md5."""
    return (F.conv(F.substring(F.md5(token.cast("binary")), 1, 6), 16, 10).cast("long") % buckets).cast("int")


def digit_class() -> str:
    """A pattern of one digit in the wide sense: decimal digits, and superscript, subscript, circled and like ones."""
    spans: list[list[int]] = []
    for c in range(0x110000):
        if chr(c).isdigit() and not chr(c).isdecimal():
            if spans and spans[-1][1] == c - 1:
                spans[-1][1] = c
            else:
                spans.append([c, c])
    return r"[\p{Nd}" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in spans) + "]"


DIGIT = digit_class()


def category(token: Column) -> Column:
    """FORMATTING, SYNTACTIC, NUMERIC, FUNCTION_WORDS, PROPER_NOUNS, CODE or CONTENT: the first rule that holds."""
    t = F.regexp_replace(token, r"(?U)^\s+|\s+$", "")
    code = F.lit(False)
    for mark in CODE_MARKS:
        code = code | F.contains(t, F.lit(mark))
    return (
        F.when((t == "") | F.contains(token, F.lit("\n")), "FORMATTING")
        .when(t.rlike(r"^[!-/:-@\[-`{-~]+$"), "SYNTACTIC")
        .when(t.rlike(DIGIT), "NUMERIC")
        .when(F.lower(t).isin(FUNCTION_WORDS), "FUNCTION_WORDS")
        .when(t.rlike(r"^\p{Lu}") & (F.length(t) > 1), "PROPER_NOUNS")
        .when(code, "CODE")
        .otherwise("CONTENT")
    )


def is_code(token: Column) -> Column:
    return F.trim(token).isin(CODE_SYMBOLS + CODE_KEYWORDS)
