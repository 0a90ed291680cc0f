"""Words as the text operators see them: longest runs of letters and digits, lower-cased."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache


@lru_cache(maxsize=1)
def word_pattern() -> re.Pattern:
    """Runs of characters of Unicode's L and N. ``\\w`` without the underscore is the same but for a few
    characters that the two tables treat differently, which are added or taken out here."""
    plain = re.compile(r"[^\W_]")
    extra, less = [], []
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        wanted, got = unicodedata.category(c)[0] in "LN", bool(plain.match(c))
        if wanted and not got:
            extra.append(c)
        elif got and not wanted:
            less.append(c)
    if not extra and not less:
        return re.compile(r"[^\W_]+")
    out = "".join(map(re.escape, less))
    one = rf"(?![{out}])[^\W_]" if less else r"[^\W_]"
    return re.compile(rf"(?:{one}|[{''.join(map(re.escape, extra))}])+" if extra else rf"(?:{one})+")


def words(text: str) -> list[str]:
    if text.isascii():
        return word_pattern().findall(text.lower())
    return [w.lower() for w in word_pattern().findall(text)]
