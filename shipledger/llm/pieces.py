"""Cutting text where byte-level BPE pre-tokenizers always cut.

The pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``
has no alternative in which white space follows another character. So a match never runs
across a place where white space follows something else, the pattern looks no further back than
its own match, and what it sees ahead of such a place (``(?!\\S)``) only concerns white space
before it, of which there is none. A text may be cut there, its parts encoded alone, and the ids
joined.
"""

from __future__ import annotations

import re

#: Characters with the Unicode property White_Space (fixed values).
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CUT = re.compile(f"(?<=[^{SPACE}])(?=[{SPACE}])")


def byte_letters() -> dict[int, str]:
    """The letter that a byte-level vocabulary writes for each byte: itself if visible, else one from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {byte: chr(byte if byte in visible else next(others)) for byte in range(256)}
