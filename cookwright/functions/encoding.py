"""Text that was decoded with the wrong code page: the possible chains and their inversion.

A chain is named ``written>read``: the bytes of the text in encoding ``written`` were decoded as ``read``.
Chains that start with utf-8 leave multi-byte sequences, which are verified byte by byte; chains between two
one-byte code pages need evidence from the surrounding letters before they may be inverted.
"""

from __future__ import annotations

import re
from functools import lru_cache

# Code pages that text is commonly read in by mistake.
READ_AS = ("cp1252", "latin-1", "iso8859-2", "cp1250", "iso8859-15", "cp1251", "cp1254", "cp437", "cp850", "mac_roman")
# Pairs of one-byte code pages, written and read.
ONE_BYTE = (("cp1252", "cp850"), ("cp1252", "cp437"), ("cp1252", "mac_roman"), ("mac_roman", "cp1252"), ("cp850", "cp1252"), ("cp1252", "cp1251"), ("cp1252", "iso8859-2"))

MULTI = tuple(f"utf-8>{x}" for x in READ_AS)
TWICE = ("utf-8>cp1252>utf-8>cp1252", "utf-8>latin-1>utf-8>latin-1")
SINGLE = tuple(f"{a}>{b}" for a, b in ONE_BYTE)
CHAINS = MULTI + TWICE + SINGLE
LOST = "�"
# What a restored character may be, besides letters of the Latin script.
_PLAUSIBLE = set("–—‘’“”„…•·°×÷½¼¾⅓⅔⅛⅜⅝⅞⁄¡¿«»‹›€£§©®™№ºª²³´`¨µ±†‡ ­")


@lru_cache(maxsize=None)
def _byte_of(page: str) -> dict[str, int]:
    """Character to byte of a code page. Bytes it leaves undefined stay control characters, as decoders do."""
    out = {}
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(page)] = b
        except UnicodeDecodeError:
            pass
        out.setdefault(chr(b), b) if b < 160 else None
    return out


@lru_cache(maxsize=None)
def _sequences(page: str) -> re.Pattern:
    """What a UTF-8 sequence of two to four bytes looks like after being read as ``page``."""
    by = {}
    for ch, b in _byte_of(page).items():
        by.setdefault(b, []).append(ch)
    group = lambda lo, hi: "[" + "".join(re.escape(c) for b in range(lo, hi) for c in by.get(b, ())) + "]"
    tail = group(0x80, 0xC0)
    return re.compile(f"{group(0xC2, 0xE0)}{tail}|{group(0xE0, 0xF0)}{tail}{{2}}|{group(0xF0, 0xF5)}{tail}{{3}}")


def plausible(ch: str) -> bool:
    """Whether a text of this kind may hold the character."""
    o = ord(ch)
    return 0x20 <= o < 0x7F or (0xC0 <= o < 0x180 and ch not in "×÷") or ch in _PLAUSIBLE


def _invert_once(text: str, page: str, final: bool = True) -> str:
    byte = _byte_of(page)

    def back(m: re.Match) -> str:
        try:
            out = bytes(byte[c] for c in m[0]).decode("utf-8")
        except UnicodeDecodeError:
            return m[0]
        return out if not final or all(map(plausible, out)) else m[0]

    return _sequences(page).sub(back, text)


def invert(text: str, chain: str) -> str | None:
    """The text before ``chain``, or None where it can't have come about so.

    Every inverted sequence is verified to decode strictly to plausible characters; parts of the text that
    the chain did not touch stay. For a chain of one-byte pages the whole text has to map back.
    """
    steps = chain.split(">")
    if steps[0] == "utf-8":
        out = text
        pages = steps[1::2]
        for k in reversed(range(len(pages))):  # what is left before the last step need not be plausible
            before, out = out, _invert_once(out, pages[k], k == 0)
            if out == before:
                return None
        return out
    written, read = steps
    try:
        out = text.encode(read).decode(written)
    except UnicodeError:
        return None
    return out if out != text and all(map(plausible, out)) else None


def garble(text: str, chain: str) -> str | None:
    """The text as ``chain`` damages it; None where a code page has no such character."""
    steps = chain.split(">")
    try:
        for written, read in zip(steps[::2], steps[1::2]):
            raw = text.encode(written)
            text = "".join(bytes([b]).decode(read, "strict") if b < 128 or not 128 <= b < 160 else _control(b, read) for b in raw)
    except UnicodeError:
        return None
    return text


@lru_cache(maxsize=None)
def _control(b: int, page: str) -> str:
    try:
        return bytes([b]).decode(page)
    except UnicodeDecodeError:
        return chr(b)


@lru_cache(maxsize=1)
def _suspect() -> re.Pattern:
    """Two characters such as begin a sequence under any of the pages: a cheap test before the exact ones."""
    lead, tail = ("".join(sorted({re.escape(c) for p in READ_AS for c, b in _byte_of(p).items() if lo <= b < hi})) for lo, hi in ((0xC2, 0xF5), (0x80, 0xC0)))
    return re.compile(f"[{lead}][{tail}]")


def repair(text: str) -> str:
    """The text with its multi-byte damage undone, as often as it was done.

    The pages are tried in the order of ``READ_AS``; the one that inverts most characters wins. Text without
    such damage comes back unchanged. Damage by one-byte pages needs a model and is left.
    """
    for _ in range(3):
        if text.isascii() or not _suspect().search(text):
            break
        found = [(x, p) for p in READ_AS if (x := _invert_once(text, p)) != text]
        if not found:
            break
        text = min(found, key=lambda x: len(x[0]))[0]
    return text
