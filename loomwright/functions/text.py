"""Text functions as column expressions.

White space is Python's: Java's \\s knows ASCII only.  Every function takes and gives a column.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache, reduce
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's \\s and str.split() take as white space, inside a Java character class.
WS = r"\s\x{1c}-\x{1f}\x{85}\p{Z}"


def empty_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^[{WS}]+|[{WS}]+\z", "")


def collapse_ws(c: Column) -> Column:
    """Runs of white space become one space; both ends are trimmed; null is empty."""
    return F.trim(F.regexp_replace(empty_if_null(c), rf"[{WS}]+", " "))


@cache
def _foldings() -> tuple[str, str, dict[str, str]]:
    """What full case folding changes in lower-case text, from Unicode's own rule: characters that become one
    other, what they become, and those that become several."""
    own = {c: f for c in map(chr, chain(range(0xD800), range(0xE000, 0x20000))) if c.lower() == c and (f := c.casefold()) != c}
    one = {c: f for c, f in own.items() if len(f) == 1}
    return "".join(one), "".join(one.values()), {c: f for c, f in own.items() if len(f) > 1}


def casefold(c: Column) -> Column:
    """Full Unicode case folding.  Only texts that hold a character that lower-casing doesn't fold take the long way."""
    one, to, several = _foldings()
    low = F.lower(c)
    whole = reduce(lambda x, f: F.replace(x, F.lit(f[0]), F.lit(f[1])), several.items(), F.translate(low, one, to))
    return F.when(low.rlike(f"[{one}{''.join(several)}]"), whole).otherwise(low)


def dedup_key(c: Column) -> Column:
    return casefold(collapse_ws(c))


def question_key(c: Column) -> Column:
    """All white space deleted."""
    return F.regexp_replace(empty_if_null(c), rf"[{WS}]+", "")


def tokens(c: Column) -> Column:
    """The words between white space."""
    return F.filter(F.split(empty_if_null(c), rf"[{WS}]+"), lambda x: x != "")


def token_count(c: Column) -> Column:
    return F.size(tokens(c))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: inside a lambda, an expression is computed for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ngrams(words: Column, n: int) -> Column:
    """Each run of n words, joined by a space."""

    def runs(w: Column) -> Column:
        last = F.size(w) - n + 1
        return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return let(words, runs)


def hashed_ngrams(words: Column, n: int) -> Column:
    """A 64-bit hash of each run of n words: words are hashed once, runs are runs of hashes."""

    def runs(h: Column) -> Column:
        last = F.size(h) - n + 1
        return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.xxhash64(F.slice(h, i, n)))).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(words, lambda w: F.xxhash64(w)), runs)


def occurs(values: Column, times: int) -> Column:
    """Whether any element occurs that often: equal elements of the sorted array stand side by side."""

    def body(s: Column) -> Column:
        n = F.greatest(F.size(s) - (times - 1), F.lit(0))
        return F.exists(F.zip_with(F.slice(s, 1, n), F.slice(s, times, n), lambda a, b: a == b), lambda x: x)

    return let(F.sort_array(values), body)


def preview(c: Column, n: int = 60) -> Column:
    """Newlines as spaces, the first n characters."""
    return F.substring(F.replace(c, F.lit("\n"), F.lit(" ")), 1, n)


def export_line(c: Column) -> Column:
    """One line of a text corpus: carriage returns go, newlines become spaces, ends are trimmed."""
    return strip(F.replace(F.replace(empty_if_null(c), F.lit("\r"), F.lit("")), F.lit("\n"), F.lit(" ")))


def norm_category(c: Column) -> Column:
    return F.replace(F.lower(strip(empty_if_null(c))), F.lit(" "), F.lit("_"))


def letters_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def keep_script(c: Column, low: str = r"\x{0D80}", high: str = r"\x{0DFF}") -> Column:
    """Only the script between low and high, ASCII letters and digits, white space, common punctuation and
    the zero-width joiner stay; the ideographic space goes although it is white space."""
    kept = rf"{low}-{high}a-zA-Z0-9{WS}.,!?;:'\"()\[\]{{}}\-\x{{2013}}\x{{2014}}\x{{2026}}%@#&*+=/\x{{200D}}"
    return F.regexp_replace(F.replace(c, F.lit("　"), F.lit("")), rf"[^{kept}]", "")


#: Numerals that a translator wrote as words at the front of list items.
WORD_NUMERALS = {
    "පහයි": "5",
    "හයයි": "6",
    "අටයි": "8",
    "දහයයි": "10",
    "එකොළහයි": "11",
    "දොළහයි": "12",
    "විස්සයි": "20",
    "විසිපහයි": "25",
    "පනහයි": "50",
}
#: Words wedged between a list marker and its item.
INJECTED_WORDS = ["සෞඛ්‍යය", "මෘදු", "සීමාව", "සයිටම්", "මයික්", "මිනීමැරුම්"]
#: Patterns of picture captions and edit links.
CAPTION = r"\s*\[\s*(?:පිටුව\s*)?(?:\d+\s*වන|සංස්කරණය\s+කරන(?:\s+ලද)?)\s*පිටුවේ\s*පින්තූරය\s*\]\s*"
EDIT_LINK = r"\s*\[සංස්කරණය(?:\s+කරන්න|\s+කරන\s+ලද\s+පිටපත)?\]\s*"

Rule = tuple[str, str, str]  # name, Java pattern, replacement


#: Names and replacements are ours; the patterns, with those above, are fixed values.
def artifact_rules(numerals: dict[str, str] = WORD_NUMERALS, injected: list[str] = INJECTED_WORDS) -> list[Rule]:
    """The ordered rules, with Python's white space."""
    ws = rf"[{WS}]"
    rules = [(f"word_numeral_{d}", rf"(?m)^({ws}*){w}\.({ws})", rf"$1{d}.$2") for w, d in numerals.items()]
    rules.append(("injected_list_word", rf"(?<![^{WS}])(\d+\.{ws}+)(?:{'|'.join(injected)}){ws}+", "$1"))
    rules.append(("caption", CAPTION.replace(r"\s", ws), " "))
    rules.append(("edit_link", EDIT_LINK.replace(r"\s", ws), " "))
    return rules


#: Patterns and replacements of the tidy rules.
TIDY_RULES: list[Rule] = [
    ("tidy_spaces", r"[ \t]{2,}", " "),
    ("tidy_space_before_punct", r" +([,.!?;:])", "$1"),
    ("tidy_blank_lines", r"\n{3,}", "\n\n"),
    ("tidy_trailing_ws", r"(?m)[ \t]+$", ""),
]


def apply_rules(c: Column, rules: list[Rule]) -> Column:
    return reduce(lambda x, r: F.regexp_replace(x, r[1], r[2]), rules, c)


def clean_artifacts(c: Column, rules: list[Rule] | None = None, passes: int = 4) -> Column:
    """The rules in order, again until nothing changes (a fixed number of passes, as a pass over a stable
    text leaves it alone), then the tidy rules."""
    for _ in range(passes):
        c = apply_rules(c, artifact_rules() if rules is None else rules)
    return strip(apply_rules(c, TIDY_RULES))


def bracket_clean(c: Column) -> Column:
    """Bracketed remarks of how-to texts."""
    c = F.replace(strip(c), F.lit(" [title]"), F.lit(". "))
    return F.replace(F.regexp_replace(c, r"\[[^\n]*?\]", ""), F.lit("  "), F.lit(" "))


def capitalize(c: Column) -> Column:
    """The first letter upper, all others lower."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substr(c, F.lit(2))))


def context_query(activity: Column, a: Column, b: Column) -> Column:
    return bracket_clean(F.concat(activity, F.lit(": "), a, F.lit(" "), capitalize(b)))


#: Named ranges of code points, in the order in which they are tried.
UNICODE_BLOCKS = [
    (0x0000, 0x007F, "English / Basic Latin"),
    (0x0080, 0x00FF, "Latin Extended (Western European)"),
    (0x0100, 0x024F, "Latin Extended A/B (Central/Eastern European)"),
    (0x0370, 0x03FF, "Greek"),
    (0x0400, 0x04FF, "Cyrillic (Russian, Bulgarian, etc.)"),
    (0x0500, 0x052F, "Cyrillic Supplement"),
    (0x0530, 0x058F, "Armenian"),
    (0x0590, 0x05FF, "Hebrew"),
    (0x0600, 0x06FF, "Arabic"),
    (0x0700, 0x074F, "Syriac"),
    (0x0750, 0x077F, "Arabic Supplement"),
    (0x0900, 0x097F, "Devanagari (Hindi, Sanskrit, Marathi, Nepali)"),
    (0x0980, 0x09FF, "Bengali"),
    (0x0A00, 0x0A7F, "Gurmukhi (Punjabi)"),
    (0x0A80, 0x0AFF, "Gujarati"),
    (0x0B00, 0x0B7F, "Odia (Oriya)"),
    (0x0B80, 0x0BFF, "Tamil"),
    (0x0C00, 0x0C7F, "Telugu"),
    (0x0C80, 0x0CFF, "Kannada"),
    (0x0D00, 0x0D7F, "Malayalam"),
    (0x0D80, 0x0DFF, "Sinhala"),
    (0x0E00, 0x0E7F, "Thai"),
    (0x0E80, 0x0EFF, "Lao"),
    (0x0F00, 0x0FFF, "Tibetan"),
    (0x1000, 0x109F, "Myanmar (Burmese)"),
    (0x10A0, 0x10FF, "Georgian"),
    (0x1100, 0x11FF, "Hangul Jamo (Korean)"),
    (0x1C00, 0x1C4F, "Lepcha"),
    (0x1C50, 0x1C7F, "Ol Chiki (Santali)"),
    (0x1E00, 0x1EFF, "Latin Extended Additional"),
    (0x1F00, 0x1FFF, "Greek Extended"),
    (0x2000, 0x206F, "General Punctuation"),
    (0x2070, 0x209F, "Superscripts and Subscripts"),
    (0x20A0, 0x20CF, "Currency Symbols"),
    (0x2100, 0x214F, "Letterlike Symbols"),
    (0x2150, 0x218F, "Number Forms"),
    (0x2190, 0x21FF, "Arrows"),
    (0x2200, 0x22FF, "Mathematical Operators"),
    (0x2C00, 0x2C5F, "Glagolitic"),
    (0x2C60, 0x2C7F, "Latin Extended-C"),
    (0x2C80, 0x2CFF, "Coptic"),
    (0x2D00, 0x2D2F, "Georgian Supplement"),
    (0x3000, 0x303F, "CJK Symbols and Punctuation"),
    (0x3040, 0x309F, "Hiragana (Japanese)"),
    (0x30A0, 0x30FF, "Katakana (Japanese)"),
    (0x3100, 0x312F, "Bopomofo (Chinese)"),
    (0x3130, 0x318F, "Hangul Compatibility Jamo (Korean)"),
    (0x3190, 0x319F, "Kanbun (Japanese)"),
    (0x31F0, 0x31FF, "Katakana Phonetic Extensions"),
    (0x3400, 0x4DBF, "CJK Unified Ideographs Extension A (Chinese/Japanese/Korean)"),
    (0x4E00, 0x9FFF, "CJK Unified Ideographs (Chinese/Japanese/Korean)"),
    (0xA000, 0xA48F, "Yi Syllables"),
    (0xA490, 0xA4CF, "Yi Radicals"),
    (0xA960, 0xA97F, "Hangul Jamo Extended-A (Korean)"),
    (0xAC00, 0xD7AF, "Hangul Syllables (Korean)"),
    (0xF900, 0xFAFF, "CJK Compatibility Ideographs"),
    (0xFB00, 0xFB4F, "Alphabetic Presentation Forms (Hebrew/Latin)"),
    (0xFB50, 0xFDFF, "Arabic Presentation Forms-A"),
    (0xFE30, 0xFE4F, "CJK Compatibility Forms"),
    (0xFE70, 0xFEFF, "Arabic Presentation Forms-B"),
    (0xFF00, 0xFFEF, "Halfwidth and Fullwidth Forms (CJK)"),
    (0x10000, 0x1007F, "Linear B Syllabary"),
    (0x10300, 0x1032F, "Old Italic"),
    (0x10330, 0x1034F, "Gothic"),
    (0x10400, 0x1044F, "Deseret"),
    (0x10450, 0x1047F, "Shavian"),
    (0x10480, 0x104AF, "Osmanya"),
    (0x1D000, 0x1D0FF, "Byzantine Musical Symbols"),
    (0x1D400, 0x1D7FF, "Mathematical Alphanumeric Symbols"),
    (0x1F300, 0x1F5FF, "Miscellaneous Symbols and Pictographs (Emoji)"),
    (0x1F600, 0x1F64F, "Emoticons (Emoji)"),
    (0x1F650, 0x1F67F, "Ornamental Dingbats"),
    (0x1F680, 0x1F6FF, "Transport and Map Symbols (Emoji)"),
    (0x1F900, 0x1F9FF, "Supplemental Symbols and Pictographs (Emoji)"),
    (0x20000, 0x2A6DF, "CJK Unified Ideographs Extension B"),
]
#: Ranges that belong to no script.
IGNORED_BLOCKS = {
    "General Punctuation",
    "Currency Symbols",
    "Letterlike Symbols",
    "Number Forms",
    "Arrows",
    "Mathematical Operators",
    "Superscripts and Subscripts",
    "Mathematical Alphanumeric Symbols",
}


def script_of(code: Column) -> Column:
    """The script of a code point; null where it doesn't count (ASCII that is no letter, symbols, no block)."""
    ascii_other = (code < 0x41) | code.between(0x5B, 0x60) | code.between(0x7B, 0x7E)
    out = F.when(ascii_other, F.lit(None).cast("string"))
    for low, high, name in UNICODE_BLOCKS:
        out = out.when(code.between(low, high), F.lit(None if name in IGNORED_BLOCKS else name).cast("string"))
    return out


def token_script(c: Column, low: str = r"\x{0D80}", high: str = r"\x{0DFF}", name: str = "Sinhala") -> Column:
    return F.when(c.rlike(rf"[{low}-{high}]"), name).when(c.rlike("[A-Za-z]"), "Latin").when(c.rlike("[0-9]"), "Digit").otherwise("Other")


def token_category(c: Column) -> Column:
    """special, whitespace, sinhala, non_english_other, number, punctuation, english_word (a space leads),
    subword_fragment or other."""
    bare = strip(c)
    return (
        F.when(c.rlike(r"^<\|?.+\|?>\z"), "special")
        .when(bare == "", "whitespace")
        .when(c.rlike(r"[\x{0D80}-\x{0DFF}]"), "sinhala")
        .when(c.rlike(r"[^\x{00}-\x{7F}]"), "non_english_other")
        .when(bare.rlike(r"^[0-9]+\z"), "number")
        .when(bare.rlike(r"^[^A-Za-z0-9]+\z"), "punctuation")
        .when(bare.rlike(r"^[A-Za-z']+\z"), F.when(F.startswith(c, F.lit(" ")), "english_word").otherwise("subword_fragment"))
        .when(bare.rlike("[0-9]"), "number")
        .otherwise("other")
    )


#: Fixed values.
STOPWORDS = ["the", "a", "an", "of", "to", "in", "and", "is", "was", "that", "it", "for", "on", "with"]


def token_type(c: Column, special: Column | None = None) -> Column:
    bare = strip(c)
    return (
        F.when(F.lit(False) if special is None else special, "special")
        .when(bare == "", "whitespace")
        .when(bare.rlike(r"[\x{0D80}-\x{0DFF}]"), "sinhala")
        .when(bare.rlike(r"^[0-9]+\z"), "number")
        .when(bare.rlike(r"^[^\p{L}\p{N}]+\z"), "punctuation")
        .when(F.lower(bare).isin(STOPWORDS), "stopword")
        .otherwise("english")
    )


def first_label_char(c: Column, labels: str = "01234") -> Column:
    """The first character of the text that is a label; null if none is."""
    return F.nullif(F.regexp_extract(c, f"[{labels}]", 0), F.lit(""))


def label_by_prefix(c: Column, labels: list[str]) -> Column:
    """The first label that the text begins with, else the first that it contains; null if none."""
    t = F.upper(strip(c))
    out = F.when(F.startswith(t, F.lit(labels[0])), labels[0])
    for x in labels[1:]:
        out = out.when(F.startswith(t, F.lit(x)), x)
    for x in labels:
        out = out.when(F.contains(t, F.lit(x)), x)
    return out


def label_by_keyword(c: Column, labels: list[str], whole: set[str] = frozenset(), cue: str = "Answer:") -> Column:
    """The first label, in order, that the text behind the last cue contains; UNK if none."""
    t = F.upper(F.substring_index(c, cue, -1))
    out = None
    for x in labels:
        hit = t.rlike(rf"\b{x}\b") if x in whole else F.contains(t, F.lit(x))
        out = F.when(hit, x) if out is None else out.when(hit, x)
    return out.otherwise("UNK")


def digit_answer(c: Column, digits: str = "0-4", cue: str = "Answer:") -> Column:
    """The first lone digit behind the last cue; UNK if there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(F.substring_index(c, cue, -1), rf"\b([{digits}])\b", 1), F.lit("")), F.lit("UNK"))


def integer_label(c: Column) -> Column:
    """Labels written as 1, 1.0 or ' 1 ' as the same string; null for no number."""
    return F.trim(c).try_cast("double").cast("bigint").cast("string")
