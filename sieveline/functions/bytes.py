"""Bytes to text with a charset fallback."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from sieveline.functions.binding import let

# What windows-1252 assigns to the bytes 80..9F; five bytes are unassigned.
CP1252_HIGH = {
    0x80: "€", 0x82: "‚", 0x83: "ƒ", 0x84: "„", 0x85: "…", 0x86: "†",
    0x87: "‡", 0x88: "ˆ", 0x89: "‰", 0x8A: "Š", 0x8B: "‹", 0x8C: "Œ",
    0x8E: "Ž", 0x91: "‘", 0x92: "’", 0x93: "“", 0x94: "”", 0x95: "•",
    0x96: "–", 0x97: "—", 0x98: "˜", 0x99: "™", 0x9A: "š", 0x9B: "›",
    0x9C: "œ", 0x9E: "ž", 0x9F: "Ÿ",
}
CP1252_UNASSIGNED = "\x81\x8d\x8f\x90\x9d"


def _cp1252(latin: Column, tail_from: str = "", tail_to: str = "") -> Column:
    return F.translate(
        latin,
        "".join(map(chr, CP1252_HIGH)) + tail_from,
        "".join(CP1252_HIGH.values()) + tail_to,
    )


def decode_text(data: Column, encoding: str | None = None) -> Column:
    """UTF-8, then windows-1252, then Latin-1; a forced encoding marks bad bytes with U+FFFD."""
    data = F.coalesce(data, F.lit(b""))
    latin = F.decode(data, "ISO-8859-1")
    if encoding:
        name = encoding.lower().replace("_", "-")
        if name in ("utf-8", "utf8"):
            return F.make_valid_utf8(data.cast("string"))
        if name in ("cp1252", "windows-1252"):
            return _cp1252(latin, CP1252_UNASSIGNED, "�" * len(CP1252_UNASSIGNED))
        if name in ("latin-1", "latin1", "iso-8859-1"):
            return latin
        return F.decode(data, encoding)
    as_text = data.cast("string")
    return F.when(F.is_valid_utf8(as_text), as_text).otherwise(
        let(
            latin,
            lambda t: F.when(t.rlike(f"[{CP1252_UNASSIGNED}]"), t).otherwise(_cp1252(t)),
        )
    )
