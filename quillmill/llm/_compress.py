"""Raw-content zstandard dictionaries and the sizes of texts under them."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import zstandard
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes compressed at a time. Each piece sees the dictionary alone and not the pieces before it, so a long text is
#: judged by all its parts and never learns from itself.
PIECE = 2048
#: Levels from here on find the short matches that tell invented or rare words apart.
LEVEL = 6


def dictionary(texts: Iterable[str], size: int, piece: int = 512) -> bytes:
    """At most ``size`` bytes of raw content: pieces taken in turn from all texts, from all over each."""
    encoded = [t.encode() for t in texts if t]
    share = max(piece, size // max(1, len(encoded)))
    out, total = [], 0
    for data in encoded:
        taken = min(len(data), share)
        count = max(1, taken // piece)
        for at in np.linspace(0, max(0, len(data) - piece), count).astype(int):
            part = data[at : at + piece]
            out.append(part)
            total += len(part)
        if total >= size:
            break
    return b"".join(out)[:size]


def spread(text: Column, most: int, slices: int = 4) -> Column:
    """A text for the training sample: whole if it has at most ``most`` characters, else slices from all over it."""
    size, step = most // slices, F.length(text) / slices
    parts = [F.substring(text, (step * i).cast("int") + 1, F.lit(size)) for i in range(slices)]
    return F.when(F.length(text) <= most, text).otherwise(F.concat(*parts))


def chosen(key: Column, wanted: int, there: Column) -> Column:
    """Whether a row belongs to a sample of about ``wanted`` of ``there`` rows; the row's key decides."""
    return F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 40)) < F.lit(float(1 << 40)) * wanted / there


class Sizer:
    """Compressed sizes of texts under several dictionaries."""

    def __init__(self, contents: list[bytes]) -> None:
        self.compressors = []
        for content in contents:
            # a dictionary needs eight bytes at least
            d = zstandard.ZstdCompressionDict(content.ljust(8, b" "), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))

    def sizes(self, text: str) -> tuple[int, list[int]]:
        """The text's bytes, and its size under each dictionary."""
        data = text.encode()
        pieces = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
        return len(data), [sum(len(c.compress(p)) for p in pieces) for c in self.compressors]
