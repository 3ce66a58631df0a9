"""Phonetic Bloom positions: no built-in expression has double codes, so a vectorized function does.

The codes are our own reduced double metaphone: consonant classes with a second reading for
letters that have two (c, g, j, w, x, z, and the groups ch, gh, th). Digits of the salt are dropped, as
they have no sound. A text without a sound falls back to its q-grams.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letter groups and their two readings.
GROUPS = {
    "sch": ("X", "SK"), "ch": ("X", "K"), "gh": ("K", ""), "kn": ("N", "N"), "ph": ("F", "F"), "sh": ("X", "X"), "th": ("0", "T"), "wh": ("A", "A"),
    "b": ("P", "P"), "c": ("K", "S"), "d": ("T", "T"), "f": ("F", "F"), "g": ("K", "J"), "h": ("", ""), "j": ("J", "A"), "k": ("K", "K"), "l": ("L", "L"), "m": ("M", "M"),
    "n": ("N", "N"), "p": ("P", "P"), "q": ("K", "K"), "r": ("R", "R"), "s": ("S", "S"), "t": ("T", "T"), "v": ("F", "F"), "w": ("", "F"), "x": ("KS", "S"), "z": ("S", "TS"),
}
_PART = re.compile("|".join(sorted(GROUPS, key=len, reverse=True)) + "|[aeiouy]+|.")


def codes(word: str) -> tuple[str, str]:
    """Two readings; the second is empty if it equals the first."""
    first, second = [], []
    for i, part in enumerate(_PART.findall(word.lower())):
        a, b = GROUPS.get(part, ("A", "A") if part[0] in "aeiouy" and not i else ("", ""))
        if a and (not first or first[-1] != a):
            first.append(a)
        if b and (not second or second[-1] != b):
            second.append(b)
    one, two = "".join(first), "".join(second)
    return one, "" if two == one else two


def positions(value: str, size: int, hashes: int, offset: int, q: int, salt: str) -> list[int]:
    out = set()
    for token in {t for t in re.split(r"[\W_]+", value.lower()) if t}:
        for i in range(hashes):
            salted = f"{salt}{i}{token}"
            found = [c for c in codes(re.sub(r"\d", "", salted)) if c]
            for code in found:
                digest = hashlib.sha256(code.lower().encode()).digest()
                out.add(int.from_bytes(digest, "little") % size + offset)
            if not found:
                text = salted.ljust(q, "_")
                for at in range(len(text) - q + 1):
                    d = hashlib.sha256((text[at : at + q] + salt).encode()).digest()
                    a, b = int.from_bytes(d[:16], "little"), int.from_bytes(d[16:], "little")
                    out.update((a + j * b) % size + offset for j in range(hashes))
    return sorted(out)


def phonetic_positions(value: Column, c) -> Column:
    size, hashes, offset, q, salt = c.size, c.hashes, c.offset, c.q, c.salt

    @F.pandas_udf("array<int>")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: positions(v or "", size, hashes, offset, q, salt))

    return run(value)
