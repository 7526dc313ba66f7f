"""Redaction and truncation of error text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.schemas import ERROR_TEXT_LENGTH, REDACTED, TRUNCATION_SUFFIX

# --- fixed values: the secrets that are recognised, applied in this order ---
SECRET_PATTERNS = [
    r"(authorization\s*[:=]\s*)(?:bearer\s+)?\S+",
    r"(bearer\s+)\S+",
    r"((?:api[_-]?key|password|secret|token)\s*[\"']?\s*[:=]\s*[\"']?)\S+",
]

# Words without which a pattern cannot match; looking for words is much cheaper
# than running the pattern.
_MARKERS = [
    ["authorization"],
    ["bearer"],
    ["apikey", "api_key", "api-key", "password", "secret", "token"],
]

# Letters outside ASCII that match s, k or i when case is ignored.
_ODD_LETTERS = {"s": "\u017f", "k": "\u212a", "i": "\u0131\u0130"}

# White space in the Unicode sense, together with the four separator controls.
_SPACE = r"[\s\x1c-\x1f]"
_NON_SPACE = r"[^\s\x1c-\x1f]"


def _ignore_case(pattern: str) -> str:
    """``pattern`` with a class for every letter and Unicode white space.

    Classes fail on the first character of nearly every position, which the
    regex engine's own case folding does not. Where a pattern starts with a choice
    of words, a look at the first letter spares most positions trying them all.
    """
    spelled, escaped = [], False
    for char in pattern:
        if escaped:
            spelled.append({"s": _SPACE, "S": _NON_SPACE}.get(char, char))
        elif char.isalpha():
            spelled.append(f"[{char}{char.upper()}{_ODD_LETTERS.get(char, '')}]")
        elif char != "\\":
            spelled.append(char)
        escaped = char == "\\"
    first = "(?=[aApPsS\u017ftT])" if pattern.startswith("((?:") else ""
    return "(?U)" + first + "".join(spelled)


def redact(text: Column) -> Column:
    """Replace what follows a recognised secret marker, keeping the marker."""

    def replace_all(lowered: Column) -> Column:
        odd = F.lit(False)
        for letter in "".join(_ODD_LETTERS.values()):
            odd = odd | text.contains(letter)
        result = text
        for pattern, words in zip(SECRET_PATTERNS, _MARKERS, strict=True):
            possible = odd
            for word in words:
                possible = lowered.contains(word) | possible
            replaced = F.regexp_replace(result, _ignore_case(pattern), "$1" + REDACTED)
            result = F.when(possible, replaced).otherwise(result)
        return result

    # The lambda binds the lowered text once per row.
    return F.get(F.transform(F.array(F.lower(text)), replace_all), F.lit(0))


def truncate(text: Column, length: int = ERROR_TEXT_LENGTH) -> Column:
    """Cut text longer than ``length`` characters and say so."""
    return F.when(
        F.length(text) > length,
        F.concat(F.left(text, F.lit(length)), F.lit(TRUNCATION_SUFFIX)),
    ).otherwise(text)


def sanitize(text: Column, length: int = ERROR_TEXT_LENGTH) -> Column:
    """Redact first, then truncate, so that a cut never hides a marker."""
    return truncate(redact(text), length)
