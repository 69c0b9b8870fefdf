"""One visual form for texts that look alike but differ in their characters.

Arrow text is copied once per batch into a numpy array of code points; lookup
tables give the replacement of every code point (nothing, one or several), an
expansion pass lays the replacements out, and combining marks are ordered and
composed on the whole array. No string method runs per row.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Invisible characters.
INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180e\u180f\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\u206a\u206b\u206c\u206d\u206e\u206f\u3164\ufeff\uffa0"
# Blanks that print as an empty gap within a line.
BLANKS = "\t\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
# Letters of other scripts that print like a Latin letter, after the public list of confusable characters, and hyphens.
LOOKALIKES = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j", "Ϲ": "C", "Ϳ": "J", "α": "a", "ρ": "p", "ι": "i",
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ү": "y", "ӏ": "l",
    "Ս": "U", "Օ": "O", "Տ": "S", "օ": "o", "ս": "u", "հ": "h", "ո": "n", "ց": "g", "զ": "q", "յ": "j",
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮖ": "I", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
    "ɑ": "a", "ɡ": "g", "‐": "-", "‑": "-",
}
#: Ranges that only hold characters which stand for themselves: Han, private use and what isn't assigned.
PLAIN = ((0x3400, 0xA000), (0xD800, 0xF900), (0x20000, 0x2F800), (0x2FA20, 0xE0000), (0xE1000, 0x110000))
#: Hangul: first leading, vowel and trailing letter, how many vowels and trailing ones there are (with none), and the first syllable.
LEAD, VOWEL, TRAIL, VOWELS, TRAILS, SYLLABLE = 0x1100, 0x1161, 0x11A7, 21, 28, 0xAC00
LEADS = 19
FLAG, TAGS = 0x1F3F4, (0xE0020, 0xE0080)
ZWJ = 0x200D
EMOJI = 0x1F000
TOP = 0x110000
#: Code points handled at once; bounds memory whatever the batch holds.
BLOCK = 2_000_000


def _base(ch: str) -> str:
    """Canonical decomposition, with compatibility only for width, joined letters, half-width forms and letters styled for formulas."""
    cp = ord(ch)
    if 0xFF01 <= cp <= 0xFFEF or 0xFB00 <= cp <= 0xFB17 or cp in (0x132, 0x133) or 0x1C4 <= cp <= 0x1CC or 0x1F1 <= cp <= 0x1F3 or 0x1D400 <= cp <= 0x1D7CB:
        ch = unicodedata.normalize("NFKC", ch)
    return "".join(LOOKALIKES.get(c, c) for c in unicodedata.normalize("NFD", ch))


@cache
def tables() -> tuple[np.ndarray, ...]:
    """Length, start and flat replacements by code point; combining classes; composition keys and values.

    All of Unicode is covered; PLAIN ranges are passed over, as nothing in them
    is replaced.
    """
    length = np.ones(TOP, np.int8)
    start = np.full(TOP, -1, np.int32)
    klass = np.zeros(TOP, np.uint8)
    flat: list[int] = []
    pairs: dict[int, int] = {}
    edges = [0x9, *(e for span in PLAIN for e in span)]
    for cp in [0x9, *(c for lo, hi in zip([0xA0, *edges[2::2]], edges[1::2]) for c in range(lo, hi))]:
        ch = chr(cp)
        klass[cp] = unicodedata.combining(ch)
        if ch in INVISIBLE or 0xFE00 <= cp <= 0xFE0F or 0xE0000 <= cp <= 0xE0FFF:
            length[cp] = 0
            start[cp] = 0
            continue
        new = " " if ch in BLANKS else _base(ch)
        if new != ch:
            length[cp], start[cp] = len(new), len(flat)
            flat += map(ord, new)
        parts = unicodedata.decomposition(ch).split()
        if len(parts) == 2 and parts[0][0] != "<" and unicodedata.normalize("NFC", ch) == ch:
            base, mark = _base(chr(int(parts[0], 16))), int(parts[1], 16)
            if unicodedata.combining(chr(mark)):
                # The first part as it stands once its own marks are composed: a composite keeps its code point, a look-alike becomes Latin.
                first = ord(base) if len(base) == 1 else pairs.get(ord(base[0]) << 21 | ord(base[1]), int(parts[0], 16)) if len(base) == 2 else int(parts[0], 16)
                pairs.setdefault(first << 21 | mark, cp)
    # Composites whose first part was itself replaced keep the Latin composite, which comes first in code order.
    keys = np.array(sorted(pairs), np.int64)
    return length, start, np.array(flat, np.int32), klass, keys, np.array([pairs[k] for k in keys], np.int32)


def to_code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and n+1 offsets; a null counts as empty here."""
    texts = texts.cast(pa.large_string())
    n = len(texts)
    offs = np.frombuffer(texts.buffers()[1], np.int64, count=n + 1 + texts.offset)[texts.offset :]
    raw = texts.buffers()[2]
    body = np.frombuffer(raw, np.uint8)[offs[0] : offs[-1]] if raw is not None and n else np.empty(0, np.uint8)
    cps = np.frombuffer(body.tobytes().decode("utf-8").encode("utf-32-le"), np.int32)
    local = offs - offs[0]
    if len(cps) == len(body):
        return cps, local.copy()
    before = np.zeros(len(body) + 1, np.int64)
    np.cumsum((body & 0xC0) != 0x80, out=before[1:])
    return cps, before[local]


def from_code_points(cps: np.ndarray, offs: np.ndarray, mask: pa.Array | None = None) -> pa.Array:
    """The inverse of to_code_points; mask marks the nulls."""
    body = cps.astype("<i4", copy=False).tobytes().decode("utf-32-le").encode("utf-8")
    if len(body) == len(cps):
        at = offs
    else:
        width = np.ones(len(cps), np.int8)
        for edge in (0x80, 0x800, 0x10000):
            width += cps >= edge
        before = np.zeros(len(cps) + 1, np.int64)
        np.cumsum(width, out=before[1:])
        at = before[offs]
    out = pa.LargeStringArray.from_buffers(len(offs) - 1, pa.py_buffer(np.ascontiguousarray(at, np.int64).tobytes()), pa.py_buffer(body))
    out = out.cast(pa.string())
    if mask is not None:
        out = pc.if_else(mask, pa.scalar(None, pa.string()), out)
    return out


def _drop(cps: np.ndarray, offs: np.ndarray, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without the sorted positions gone."""
    return np.delete(cps, gone), offs - np.searchsorted(gone, offs)


def _syllables(cps: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """With Hangul letters joined to syllables: leading with vowel, then that with trailing."""
    for lead, unit, first, n in ((LEAD, 1, VOWEL, VOWELS), (SYLLABLE, TRAILS, TRAIL + 1, TRAILS - 1)):
        at = np.flatnonzero((cps >= first) & (cps < first + n))
        at = at[at > 0]
        before = cps[at - 1].astype(np.int64) - lead
        fits = (before >= 0) & (before < LEADS) if unit == 1 else (before >= 0) & (before < LEADS * VOWELS * TRAILS) & (before % TRAILS == 0)
        at = at[fits & ~np.isin(at, offs)]
        if len(at):
            cps = cps.copy()
            if unit == 1:
                cps[at - 1] = SYLLABLE + ((cps[at - 1] - LEAD) * VOWELS + cps[at] - VOWEL) * TRAILS
            else:
                cps[at - 1] += cps[at] - TRAIL
            cps, offs = _drop(cps, offs, at)
    return cps, offs


def unify(cps: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The visual form of the code points of several texts, with the new offsets."""
    length, start, flat, klass, keys, values = tables()
    odd = np.flatnonzero((cps > 0x7E) | (cps == 0x9))
    if not len(odd):
        return cps, offs
    jamo = bool(((cps[odd] >= LEAD) & (cps[odd] < 0x1200)).any())
    odd = odd[start[cps[odd]] >= 0]
    joiner = odd[cps[odd] == ZWJ]
    if len(joiner):  # between two pictures the joiner is seen
        inner = joiner[(joiner > 0) & (joiner < len(cps) - 1)]
        odd = np.setdiff1d(odd, inner[(cps[inner - 1] >= EMOJI) & (cps[inner + 1] >= EMOJI)], assume_unique=True)
    tag = odd[(cps[odd] >= TAGS[0]) & (cps[odd] < TAGS[1])]
    if len(tag):  # behind a black flag tags make another flag
        first = np.flatnonzero(np.append(True, np.diff(tag) > 1))
        lead = tag[first]
        flag = (lead > 0) & (cps[np.maximum(lead - 1, 0)] == FLAG) & ~np.isin(lead, offs)
        odd = np.setdiff1d(odd, tag[np.repeat(flag, np.diff(np.append(first, len(tag))))], assume_unique=True)
    if len(odd):
        size = np.ones(len(cps), np.int8)
        new = length[cps[odd]]
        size[odd] = new
        grown = np.zeros(len(odd) + 1, np.int64)
        np.cumsum(new.astype(np.int64) - 1, out=grown[1:])
        out = np.repeat(cps, size)
        at, take = odd + grown[:-1], start[cps[odd]]
        for k in range(int(new.max())):
            more = new > k
            out[at[more] + k] = flat[take[more] + k]
        cps, offs = out, offs + grown[np.searchsorted(odd, offs)]
        jamo |= bool(((out >= LEAD) & (out < 0x1200)).any())
    if jamo:
        cps, offs = _syllables(cps, offs)
    first = np.zeros(len(cps) + 1, bool)
    first[offs] = True
    marks = np.flatnonzero(klass[cps])
    if not len(marks):
        return cps, offs
    cps = cps.copy()
    while True:  # canonical order of neighbouring marks
        left = marks[(marks > 0)]
        left = left[~first[left] & (klass[cps[left - 1]] > klass[cps[left]])]
        if not len(left):
            break
        left = left[np.concatenate(([True], np.diff(left) > 1))]
        cps[left - 1], cps[left] = cps[left].copy(), cps[left - 1].copy()
    while len(marks):
        left = marks[marks > 0]
        left = left[~first[left] & (klass[cps[left - 1]] == 0)]
        key = cps[left - 1].astype(np.int64) << 21 | cps[left]
        found = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        hit = keys[found] == key
        if not hit.any():
            break
        gone = left[hit]
        cps[gone - 1] = values[found[hit]]
        cps, offs = _drop(cps, offs, gone)
        first = np.zeros(len(cps) + 1, bool)
        first[offs] = True
        marks = np.flatnonzero(klass[cps])
    return cps, offs


def blocks(texts: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, pa.Array]]:
    """Slices of about limit bytes, one text at least, each with its first row."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
    if not len(sizes):
        return
    group = np.cumsum(sizes.astype(np.int64)) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:]):
        yield a, texts.slice(a, b - a)


def visual_form(texts: pa.Array) -> pa.Array:
    """The visual form of each text; null stays null, and empty stays empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    done = [from_code_points(*unify(*to_code_points(part)), pc.is_null(part)) for _, part in blocks(texts)]
    return pa.concat_arrays(done) if done else pa.array([], pa.string())
