"""Text expressions: tokens, cleaning, guards, identity and sentence rules."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that say nothing about a question's subject.
STOP_WORDS = (
    "the a an of to in on at with and or is was were did do does after before that what who when where how why which whose whom are can could happen happened happens caused cause made make belong belongs "
    "tell about there their from this these those have has had get got"
).split()
# Function words that don't count as content of an answer.
FUNCTION_WORDS = (
    "the a an and or but of to in on at for with by from into after before during that this these those it its is was were are be been has have had will would can could he she they his her their as not "
    "there here which who what when where how"
).split()
# Watermarks of worthless files.
SPAM = ["mcephie", "moviesnipipay", "netnaija", "stagatv", "tagalog", "full4movies", "mkvcage", "kisscartoon"]
# Phrases of sentences that claim nothing.
HEDGES = [
    "unclear", "unverified", "insufficient", "fragmented", "unspecified", "unconfirmed", "unknown", "no evidence", "not enough", "cannot", "can't", "uncertain", "ambiguous", "conflicting", "not present",
    "doesn't specify", "does not specify", "not specify", "doesn't say", "does not say", "not stated", "not directly stated", "no explicit", "does not mention", "doesn't mention", "do not mention",
    "no information", "not shown", "no record", "cannot determine", "not directly", "not mention", "do not specify",
]
# Words by which an answer speaks of its sources.
META = ["evidence", "entries", "excerpts", "passages", "provided", "supplied", "retrieved", "sources", "records", "the show itself", "referenced", "mentioned in"]
# Verbs of such sentences.
REPORTING = [
    "discuss", "discusses", "mention", "mentions", "referenced", "references", "cited", "cites", "cite", "explicitly place", "explicitly places", "does not place", "does not state",
    "does not support", "does not establish", "does not identify", "does not name", "does not describe", "does not cover",
]


def _fold_table() -> dict[str, str]:
    """Letters that decompose into one letter and marks, in lower case, and that letter; marks by themselves go."""
    out = {chr(c): "" for c in range(0x300, 0x370)}
    for c in map(chr, range(0x80, 0x10000)):
        parts = unicodedata.normalize("NFD", c)
        if len(parts) > 1 and c == c.lower() and unicodedata.category(c)[0] == "L" and all(unicodedata.category(m) == "Mn" for m in parts[1:]):
            out[c] = parts[0]
    return out


FOLD = _fold_table()
_FOLDED = {ord(c): to or None for c, to in FOLD.items()}
#: What an index term is made of: letters, numbers and characters of private use.
TERM = r"[\p{L}\p{N}\p{Co}]+"
_LETTERS = sorted(FOLD, key=lambda c: not FOLD[c])  # those that go come last, as translate() wants them


def folded(text: Column) -> Column:
    """Lower case without accents. Texts of ASCII alone, which have none, are not looked through."""
    low = F.lower(text)
    return F.when(F.octet_length(low) == F.length(low), low).otherwise(F.translate(low, "".join(_LETTERS), "".join(FOLD[c] for c in _LETTERS)))


def terms(text: Column) -> Column:
    """Index terms: folded runs of letters and numbers of any script."""
    return F.regexp_extract_all(folded(text), F.lit(TERM), F.lit(0))


def terms_of(text: str) -> list[str]:
    """The index terms of a question's part."""
    low = text.lower().translate(_FOLDED)
    return "".join(c if (kind := unicodedata.category(c))[0] in "LN" or kind == "Co" else " " for c in low).split()


def spaced_terms(text: Column) -> Column:
    """The index terms as one string, each with a space of its own on either side."""
    spaced = F.trim(F.regexp_replace(folded(text), TERM.replace("[", "[^", 1), "  "))
    return F.when(spaced == "", "").otherwise(F.concat(F.lit(" "), spaced, F.lit(" ")))


def content_tokens(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9'-]+"), F.lit(0)), lambda t: (F.length(t) > 2) & ~t.isin(STOP_WORDS))


def sanitized(term: Column) -> Column:
    return F.trim(F.regexp_replace(term, r"(?U)[^\w\s'-]", ""))


def any_of(text: Column, phrases: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(text, p))


def is_noise(line: Column) -> Column:
    return line.rlike(r"(?U)^♪.*♪$|^#\w+$|^\[[^\]]{0,40}\]$|^\([^)]{0,40}\)$")


def clean_cue(text: Column) -> Column:
    """Markup, colour prefixes and noise lines removed; one line."""
    bare = F.regexp_replace(F.regexp_replace(text, r"<[^>]+>", ""), r"\{[^}]+\}", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?U)^#\w+#", ""), "-->", " ")
    lines = F.filter(F.transform(F.split(bare, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: (x != "") & ~is_noise(x))
    return F.trim(F.regexp_replace(F.array_join(lines, " "), r"(?U)\s+", " "))


def has_spam(text: Column) -> Column:
    return any_of(F.lower(text), SPAM)


def mostly_latin(text: Column) -> Column:
    """20 ASCII letters at least, under 15 % of other word characters, under 10 broken characters."""
    latin = F.length(F.regexp_replace(text, "[^A-Za-z]", ""))
    word = F.length(F.regexp_replace(text, r"(?U)[^\w]", ""))
    other = F.length(F.regexp_replace(text, r"(?U)[^\w]|[\x00-\x7F]", ""))
    broken = F.length(text) - F.length(F.replace(text, F.lit("�"), F.lit("")))
    return (word > 0) & (latin >= 20) & (other < 0.15 * word) & (broken < 10)


def looks_like_html(text: Column) -> Column:
    return F.contains(F.lower(F.left(text, F.lit(400))), F.lit("<html"))


def normal_name(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def canonical_id(kind: Column, name: Column) -> Column:
    """kind:words_of_the_name without articles; the bare name if no word is left."""
    words = F.filter(F.split(F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9 ]", "")), " +"), lambda w: (w != "") & ~w.isin("the", "a", "an", "of"))
    return F.when(F.size(words) > 0, F.concat(kind, F.lit(":"), F.array_join(words, "_"))).otherwise(F.concat(kind, F.lit(":"), F.trim(F.lower(name))))


def point_id(key: Column) -> Column:
    """First 15 hexadecimal digits of SHA-256, as a number."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 15), 16, 10).cast("long")


def sentences(answer: Column) -> Column:
    glued = F.regexp_replace(answer, r"([.!?])\s*(\[\d+\])", "$1$2")
    return F.filter(F.split(glued, r"(?<=[.!?])\s+(?=[A-Z])|(?<=\])\s+(?=[A-Z])"), lambda s: F.trim(s) != "")


def content_words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z]{4,}"), F.lit(0)), lambda w: ~w.isin(FUNCTION_WORDS)))


def citations(sentence: Column) -> Column:
    return F.transform(F.regexp_extract_all(sentence, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda n: F.try_to_number(n, F.lit("999999999")).cast("int"))


def is_hedge(sentence: Column, cited: Column) -> Column:
    s = F.lower(sentence)
    return any_of(s, HEDGES) | (any_of(s, META) & (~cited | any_of(s, REPORTING)))


def ngrams(words: Column, n: int) -> Column:
    """Array of runs of n words, joined by spaces. The words are computed once, outside the inner lambda."""
    def runs(w: Column) -> Column:
        return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))

    return F.element_at(F.transform(F.array(words), runs), 1)
