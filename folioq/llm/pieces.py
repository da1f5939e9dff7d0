"""What encoding and counting share: one loaded piece model per process, and token spans as arrays."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import sentencepiece as spm

#: Appended to a serialised model, this sets normalizer_spec.add_dummy_prefix to false (later fields of a message win).
_NO_PREFIX = b"\x1a\x02\x18\x00"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=4)
def model(path: str) -> spm.SentencePieceProcessor:
    return spm.SentencePieceProcessor(model_file=path)


class Spans:
    """The model without its begin mark, and the span in code points that each id covers."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.sp = spm.SentencePieceProcessor(model_proto=f.read() + _NO_PREFIX)
        n = self.sp.get_piece_size()
        self.pieces = [self.sp.id_to_piece(i) for i in range(n)]
        self.length = np.array([len(p) for p in self.pieces], dtype=np.int64)
        self.is_byte = np.array([self.sp.is_byte(i) for i in range(n)])
        for i in np.flatnonzero(self.is_byte):
            # of the bytes that stand for one character, the lead byte counts as the character
            self.length[i] = 0 if 0x80 <= int(self.pieces[i][3:5], 16) < 0xC0 else 1
        special = {i for i in range(n) if self.sp.is_control(i) or self.sp.is_unknown(i)}
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in special and not self.is_byte[i]}
        self.widest = max(map(len, self.ids))
        self.unknown = self.sp.unk_id()
        self.tails = {p[k:] for p in self.ids for k in range(len(p))}  # what some piece ends in
        self.known: dict[tuple[str, str], bool] = {}  # what fits() has found out

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and where each starts in the normalised text (spaces as marks, no begin mark)."""
        ids = np.array(self.sp.encode(text), dtype=np.int64)
        ends = np.cumsum(self.length[ids])
        if (int(ends[-1]) if len(ids) else 0) != len(text):
            raise ValueError("this model's normaliser changes the text's length; spans need one that keeps it")
        return ids, ends - self.length[ids]

    def fits(self, a: str, b: str) -> bool:
        """Whether a merge never crosses the border of these neighbouring symbols, so that both stand in an encoding.

        An encoding's neighbours all fit, and a sequence whose neighbours all fit is the encoding: merges happen by
        score, then from the left, and a merge over a border would happen in the encoding of the two alone as well.
        """
        if (known := self.known.get((a, b))) is None:
            if len(self.known) > 2_000_000:
                self.known.clear()
            i, j = self.ids.get(a), self.ids.get(b)
            known = self.known[a, b] = self._symbols(a + b) == [a, b] if i is None or j is None else self.sp.encode(a + b) == [i, j]
        return known

    def _symbols(self, text: str) -> list[str]:
        ids, starts = self.encode(text)
        cuts = [*sorted({int(s) for s, i in zip(starts, ids) if self.length[i]}), len(text)]
        return [text[i:j] for i, j in zip(cuts, cuts[1:])]


@lru_cache(maxsize=4)
def spans(path: str) -> Spans:
    return Spans(path)
