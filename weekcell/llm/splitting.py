"""Words of whole texts as bytes, read in pieces so that a very long text never is one list of words."""

from __future__ import annotations

import re
from collections.abc import Iterator

#: Bytes of a text that are split at once.
PIECE_BYTES = 1 << 20

_GAP = re.compile(rb"[\x20\x09-\x0D]")


def word_lists(text: str | None, size: int = PIECE_BYTES) -> Iterator[list[bytes]]:
    """The words (``[^\\x20\\x09-\\x0D]+``) of a text in order, in lists of about ``size`` bytes. A null text has none.

    ``bytes.split`` parts at exactly these six characters; a piece ends at one of them, so no word is cut.
    """
    if not text:
        return
    data = text.encode("utf-8", "surrogatepass")
    low = 0
    while low < len(data):
        high = len(data)
        if high - low > size:
            gap = _GAP.search(data, low + size)
            high = gap.start() if gap else high
        yield data[low:high].split()
        low = high
