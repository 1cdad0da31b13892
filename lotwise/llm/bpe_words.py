"""What the two byte-pair operators share: cutting texts into units and pre-tokens.

A unit is a stretch of text that starts at a space before a non-space. Pre-tokens never cross such a
place when the text has no two white-space characters in a row (texts with any but spaces and line
ends count as such), so pre-tokens of a unit do not depend
on the rest of the text, and each different unit needs cutting once. Texts with white-space runs are
cut as a whole.
"""

from __future__ import annotations

import re
import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_RUNS = ("  ", " \n", "\n ", "\n\n")
#: Any other character that the pattern or Python counts as white space.
_SPACES = "[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_RARE = re.compile(_SPACES)
#: Found in texts that are cut as a whole (for Arrow's regular expressions).
WHOLE = "|".join((*_RUNS, _SPACES))


def slices(texts: list[str], chars: int = 3_000_000):
    """``texts`` in lists of about ``chars`` characters, so that what a list needs stays small."""
    some, n = [], 0
    for t in texts:
        some.append(t)
        n += len(t)
        if n >= chars:
            yield some
            some, n = [], 0
    if some:
        yield some


def units(text: str) -> list[str]:
    """``text`` in pieces that can be cut into pre-tokens one by one; they concatenate to it."""
    if any(run in text for run in _RUNS) or _RARE.search(text):
        return [text]
    parts = text.split(" ")
    if len(parts) == 1:
        return parts
    out = [" " + p for p in parts]
    out[0] = parts[0]
    if out[-1] == " ":  # a space at the end is a pre-token of its own
        return out
    return out if out[0] else out[1:]
