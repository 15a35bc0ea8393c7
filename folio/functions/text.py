"""Text functions of the lexical operators, as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: a token is ASCII letters and digits, with one inner apostrophe part; a final 's stays outside the group.
TOKEN = r"([a-z0-9]+(?:'(?!s(?![a-z0-9]))[a-z0-9]+)?)(?:'s(?![a-z0-9]))?"
#: Characters that case folding turns into ASCII letters where lower() doesn't, and what they become; a mark
#: that isn't ASCII splits words, so a blank stands for it.
FOLDS = {
    "ß": "ss", "ſ": "s", "ŉ": " n", "ǰ": "j ", "ẖ": "h ", "ẗ": "t ", "ẘ": "w ", "ẙ": "y ", "ẚ": "a ", "’": "'",
    "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st",
}
_TOKEN = re.compile(TOKEN)
#: Unicode white space, as (?U)\s has it in words(); and what else Arrow and Python split at.
SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
SEPARATORS = "[\x1c-\x1f]"
#: Words that evidence and spans skip.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "before", "by", "for", "from", "he", "her", "his", "in", "into", "is", "it", "of", "on", "she", "that", "the", "their", "them", "they", "to", "was", "were", "with",
)


def tokens(text: Column) -> Column:
    """Case-folded tokens in order, without a final 's; null gives none. Accented letters split words."""
    plain = F.lower(F.coalesce(text, F.lit("")))
    folded = plain
    for old, new in FOLDS.items():
        folded = F.replace(folded, F.lit(old), F.lit(new))
    # One look at the text says whether any of the replacements is needed.
    return F.regexp_extract_all(F.when(plain.rlike(f"[{''.join(FOLDS)}]"), folded).otherwise(plain), F.lit(TOKEN), 1)


def tokens_of(text: str) -> list[str]:
    """The same of a Python string."""
    plain = text.lower()
    if not plain.isascii():
        for old, new in FOLDS.items():
            plain = plain.replace(old, new)
    return _TOKEN.findall(plain)


def words(text: Column) -> Column:
    """Words between Unicode white space; an empty text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def excerpt(text: Column, limit: int = 300) -> Column:
    """text if it fits; else cut at limit, back to the last blank, without trailing ` ,;:`, and an ellipsis."""
    head = F.substring(text, 1, limit)
    cut = F.when(F.instr(head, " ") > 0, F.regexp_replace(head, r" [^ ]*$", "")).otherwise(head)
    return F.when(F.char_length(text) <= limit, text).otherwise(F.concat(F.regexp_replace(cut, r"[ ,;:]+$", ""), F.lit("…")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))
