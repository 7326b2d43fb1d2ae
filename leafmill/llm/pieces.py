"""Piece vocabularies, and the distinct ones among spans of text."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: A public piece model; every operator that uses it takes another path as a parameter.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"


class Pieces(NamedTuple):
    """What the operators need of a model file; small, read on the driver and sent with the tasks."""

    pieces: dict  # piece -> id, ordinary ones
    scores: dict  # id -> score
    bytes_: list  # ids of the 256 byte pieces
    raw: list  # by id: the bytes that the piece decodes to
    unknown: int


def load(path: str = MODEL) -> Pieces:
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    n = m.get_piece_size()
    special = [m.is_byte(i) or m.is_control(i) or m.is_unknown(i) for i in range(n)]
    names = [m.id_to_piece(i) for i in range(n)]
    to_byte = {f"<0x{b:02X}>": b for b in range(256)}
    bytes_ = [-1] * 256
    for i in range(n):
        if m.is_byte(i):
            bytes_[to_byte[names[i]]] = i
    raw = [bytes([to_byte[names[i]]]) if m.is_byte(i) else b" \xe2\x81\x87 " if m.is_unknown(i) else b"" if special[i] else names[i].replace(SPACE, " ").encode() for i in range(n)]
    ordinary = {names[i]: i for i in range(n) if not special[i]}
    return Pieces(ordinary, {i: m.get_score(i) for i in ordinary.values()}, bytes_, raw, m.unk_id())


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Spans(NamedTuple):
    which: np.ndarray  # for each span its text, as a number
    cps: np.ndarray  # the code points of the distinct texts, end to end
    offs: np.ndarray  # where each distinct text begins, and the end of the last


def distinct(cps: np.ndarray, bounds: np.ndarray, step: int = 1) -> Spans:
    """Texts of the spans between neighbours of ``bounds``, every ``step``-th of them; told apart by their code points."""
    raw = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64) * 4), pa.py_buffer(cps)])
    coded = raw.dictionary_encode()
    _, offs, data = coded.dictionary.buffers()
    offs = np.frombuffer(offs, np.int64)[: len(coded.dictionary) + 1] // 4
    return Spans(coded.indices.to_numpy()[::step], np.frombuffer(data, np.uint32)[: offs[-1]], offs)
