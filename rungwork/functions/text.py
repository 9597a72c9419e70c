"""Text functions, as JVM expressions: markup, turns, headers, numbers, phrases and formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rungwork.functions.keys import squeeze

#: The five core entities.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def strip_markup(text: Column) -> Column:
    """Tags replaced by blanks, core entities resolved, white space squeezed."""
    out = F.regexp_replace(text, "<[^>]+>", " ")
    for name, char in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return squeeze(out)


def without_sentences(text: Column, sentences: Column) -> Column:
    """A text without the given sentences, taken off in their order."""
    return squeeze(F.aggregate(sentences, text, lambda t, s: F.replace(t, s, F.lit(" "))))


def canonical_text(html: Column) -> Column:
    """Text nodes of a page, each trimmed, one a line."""
    nodes = F.split(F.regexp_replace(html, "<[a-zA-Z/][^>]*>", "\n"), "\n")
    resolved = nodes
    return F.array_join(F.filter(F.transform(resolved, strip_markup_keep), lambda x: x != ""), "\n")


def strip_markup_keep(text: Column) -> Column:
    """Core entities resolved and white space squeezed."""
    out = text
    for name, char in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return squeeze(out)


def header_names(text: Column, role: str) -> Column:
    """Names of a header line ``Role: a, b (primary) and c`` as an array."""
    line = F.regexp_replace(F.regexp_extract(text, rf"(?m)^{role}s?:\s*(.+)$", 1), r"\((primary|secondary|tertiary)\)", "")
    return F.filter(F.transform(F.split(line, r"\s*,\s*|\s+and\s+"), lambda x: F.trim(x)), lambda x: x != "")


def initials(name: Column) -> Column:
    """Initials of the first three words of a name, in upper case."""
    words = F.filter(F.split(name, r"[\s.]+"), lambda w: F.length(w) > 0)
    return F.upper(F.array_join(F.transform(F.slice(words, 1, 3), lambda w: F.substring(w, 1, 1)), ""))


def turn_score(text: Column) -> Column:
    """Score of a turn as an interviewer's: questions and second person for it, first person and length against it."""
    low = F.lower(text)
    words = F.greatest(F.size(F.filter(F.split(low, r"\s+"), lambda w: w != "")), F.lit(1))
    # fixed values: pronouns of the second and of the first person
    second = F.regexp_count(low, F.lit(r"\b(you|your|yours|you're|you've|did you|were you|do you)\b"))
    first = F.regexp_count(low, F.lit(r"\b(i|me|my|mine|we|us|our|i'm|i've|i'd)\b"))
    ask = F.regexp_count(text, F.lit(r"\?")) > 0
    return 2 * ask.cast("int") + 3 * second / words - 3 * first / words + (words < 25).cast("int") - (words > 80).cast("int")


def turn_role(text: Column) -> Column:
    """``INTERVIEWER`` above a score of 1, else ``NARRATOR``."""
    return F.when(turn_score(text) > 1, "INTERVIEWER").otherwise("NARRATOR")


def quoted_numbers(text: Column) -> Column:
    """Decimals, and integers of at least 100, that a text quotes; years, dates and clock times are left out."""
    plain = F.regexp_replace(F.regexp_replace(text, r"\d{1,2}:\d{2}(:\d{2})?|\d{4}-\d{2}-\d{2}|\b(1[89]|20)\d{2}\b", " "), r"(\d),(\d{3})", "$1$2")
    found = F.regexp_extract_all(plain, F.lit(r"\d+\.\d+|\d{3,}"), F.lit(0))
    return F.transform(found, lambda x: x.cast("double"))


def paragraphs(text: Column, least: int = 80) -> Column:
    """Stretches between blank lines of more than ``least`` characters."""
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.trim(p)), lambda p: F.length(p) > least)


def phrase_counts(text: Column, phrases: list[str]) -> Column:
    """Counts of phrases as an array in the order of ``phrases``; the longest are taken first and then masked."""
    longest = sorted(range(len(phrases)), key=lambda i: -len(phrases[i]))
    left, counts = F.lower(text), {}
    for i in longest:
        p = phrases[i].lower()
        counts[i] = (F.length(left) - F.length(F.replace(left, F.lit(p), F.lit("")))) / len(p)
        left = F.replace(left, F.lit(p), F.lit("\x01"))
    return F.array(*[counts[i].cast("int") for i in range(len(phrases))])


def fixed(value: Column, digits: int) -> Column:
    """A number with so many decimals."""
    return F.format_string(f"%.{digits}f", value.cast("double"))


def tidy_author(name: Column) -> Column:
    """``Last, First`` as ``First Last``."""
    return F.when(F.instr(name, ",") > 0, squeeze(F.concat_ws(" ", F.element_at(F.split(name, ","), 2), F.element_at(F.split(name, ","), 1)))).otherwise(squeeze(name))


def clean_speech(text: Column) -> Column:
    """Spoken text without annotations in brackets, filled pauses and repeated words; ``<INAUD>`` where none understood."""
    # fixed values: what stands for an unintelligible stretch, and filled pauses
    t = F.regexp_replace(text, r"(?i)\[[^\]]*(inaudible|unintelligible)[^\]]*\]", " <INAUD> ")
    t = F.regexp_replace(F.regexp_replace(t, r"\[[^\]]*\]", " "), r"(?i)\b(uh+|um+|er+|ah+|mm+|hmm+)\b,?\s*", "")
    return squeeze(F.regexp_replace(t, r"(?i)\b(\w+)(\s+\1\b)+", "$1"))


def plain_of_latex(source: Column) -> Column:
    """Prose of a LaTeX source: comments, mathematics, citations and commands dropped, the text of commands kept."""
    t = F.regexp_replace(source, r"(?m)(?<!\\)%.*$", " ")
    t = F.regexp_replace(t, r"(?s)\\begin\{(equation|align|table|figure|tabular)\*?\}.*?\\end\{\1\*?\}|\$\$.*?\$\$|\$[^$]*\$", " ")
    t = F.regexp_replace(t, r"\\(cite[a-z]*|ref|label|eqref|includegraphics|bibliography[a-z]*)\*?(\[[^\]]*\])?\{[^}]*\}", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"\\[a-zA-Z]+\*?(\[[^\]]*\])?\{([^{}]*)\}", "$2"), r"\\[a-zA-Z]+\*?|[{}~]", " ")
    return squeeze(t)


def sections(source: Column) -> Column:
    """``title, body`` of the parts of a text with headings ``# ...`` or ``\\section{...}``, in order."""
    marked = F.regexp_replace(F.regexp_replace(source, r"(?m)^#+\s*(.+?)\s*$", "\x01$1\x02"), r"\\(?:sub)*section\*?\{([^}]*)\}", "\x01$1\x02")
    parts = F.slice(F.split(marked, "\x01"), 2, 1 << 30)
    bare = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    return F.transform(parts, lambda p: F.struct(bare(F.substring_index(p, "\x02", 1)).alias("title"), bare(F.substring_index(p, "\x02", -1)).alias("body")))


def scientific(value: Column, digits: int = 1) -> Column:
    """``m x 10^e`` with so many decimals; 0 and NULL as they are."""
    e = F.floor(F.log10(F.abs(value))).cast("int")
    m = F.round(value / F.pow(F.lit(10.0), e), digits)
    over = F.abs(m) >= 10
    m, e = F.when(over, m / 10).otherwise(m), F.when(over, e + 1).otherwise(e)
    return F.when(value == 0, "0").otherwise(F.concat(fixed(m, digits), F.lit(" x 10^"), e.cast("string")))


def percent(value: Column, digits: int = 1) -> Column:
    """A share as a percentage."""
    return F.concat(fixed(value * 100, digits), F.lit("%"))


def grouped(value: Column) -> Column:
    """An integer with commas between thousands."""
    return F.format_number(value, 0)


def yes_no(value: Column) -> Column:
    """``yes`` or ``no``; NULL stays."""
    return F.when(value.isNull(), F.lit(None)).when(value, "yes").otherwise("no")
