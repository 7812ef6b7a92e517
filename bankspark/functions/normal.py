"""Unicode normalisation that knows where each character came from."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

from bankspark.model import NORMALISATIONS


@dataclass(frozen=True)
class Normalised:
    """A text, its normal form, and of each character of that form the span it comes from."""

    text: str
    form: str
    origins: tuple[tuple[int, int], ...]

    def span(self, start: int, end: int) -> tuple[int, int]:
        """The span of the text behind a span of the form."""
        if not 0 <= start <= end <= len(self.form):
            raise ValueError("the span is outside the text")
        if start == end:
            at = self.origins[start][0] if start < len(self.origins) else len(self.text)
            return at, at
        return self.origins[start][0], self.origins[end - 1][1]


def normalised(text: str, mode: str, casefold: bool = False) -> Normalised:
    """NFC or NFKC by clusters of a character and its combining marks."""
    if mode not in NORMALISATIONS:
        raise ValueError(f"unknown normalisation {mode!r}")
    starts = [i for i, c in enumerate(text) if i == 0 or not unicodedata.combining(c)] + [len(text)]
    out, origins = [], []
    for a, b in zip(starts, starts[1:]):
        piece = text[a:b] if mode == "none" else unicodedata.normalize(mode, text[a:b])
        piece = piece.casefold() if casefold else piece
        out.append(piece)
        origins += [(a, b)] * len(piece)
    return Normalised(text, "".join(out), tuple(origins))
