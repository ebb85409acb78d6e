"""Token ids of whole texts by the ``tokenizers`` library, each distinct pre-token encoded once per task.

A byte-pair tokenizer cuts a text in pre-tokens and encodes each for itself. No
pre-token of the two tokenizers used here reaches over a blank, other than one
that leads it. So texts are cut at blanks, distinct chunks are cut in
pre-tokens, distinct pre-tokens go to the library's model, and the ids are put
together with numpy. Texts where that does not hold go to the library whole:
those with special tokens, with blanks between other white space, or with
characters whose class may differ between Unicode versions.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable

import numpy as np

from tracefield.llm.common import ragged

#: anything but these characters goes to the library whole
UNUSUAL = re.compile("[^\\t\\n\\r -~\u00a1-\u024f\u2010-\u2027]")
#: letters and numbers among the usual characters
LETTER = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
NUMBER = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
# fixed values: the pre-token patterns of the two tokenizers, for the usual characters
PATTERNS = {
    "byte": rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^\s{LETTER}{NUMBER}]+|\s+(?!\S)|\s+",
    "word": rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^\s{LETTER}{NUMBER}]+",
}
#: distinct chunks kept in a worker before it starts afresh
MAX_KEPT = 500_000


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Numbers(dict):
    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def encoder(path: str, kind: str) -> Callable[[list], tuple[np.ndarray, np.ndarray]]:
    """Function from texts to (ids, lengths); ``kind``: "byte" or "word". Null texts have no ids."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    model, cut, letters = library.model, re.compile(PATTERNS[kind]).findall, byte_letters()
    known: dict[str, list[int]] = {}
    numbers = _Numbers()
    store = [np.zeros(0, np.uint32), np.zeros(1, np.int64)]

    def piece_ids(piece: str) -> list[int]:
        ids = known.get(piece)
        if ids is None:
            if piece.isascii() and piece.isalnum():
                spelt = piece
            elif piece.isascii() and piece[0] == " " and piece[1:].isalnum():
                spelt = letters[32] + piece[1:]
            else:
                spelt = piece.encode().decode("latin-1").translate(letters)
            ids = known[piece] = [t.id for t in model.tokenize(spelt)]
        return ids

    def learn():
        new = list(numbers)[len(store[1]) - 1 :]
        if kind == "byte":  # a chunk stands after a blank; the first of a text is marked as standing alone
            new = [x[1:] if x[:1] == "\0" else " " + x for x in new]
        got = [piece_ids(c[0]) if len(c) == 1 else [i for piece in c for i in piece_ids(piece)] for c in map(cut, new)]
        lengths = np.fromiter(map(len, got), np.int64, len(got))
        ids = np.fromiter((x for g in got for x in g), np.uint32, int(lengths.sum()))
        store[0] = np.concatenate([store[0], ids])
        store[1] = np.concatenate([store[1], store[1][-1] + np.cumsum(lengths)])

    def chunks(text: str) -> list | None:
        if kind == "word":
            text = text.lower()  # some capitals have small letters beyond the usual ones
        if "<|" in text or UNUSUAL.search(text):
            return None
        if kind == "word":
            return text.split()
        if "  " in text or "\n \n" in text or "\t" in text or "\r" in text:
            return None
        out = text.split(" ")
        out[0] = "\0" + out[0]
        return out

    def encode(texts: list) -> tuple[np.ndarray, np.ndarray]:
        if len(numbers) > MAX_KEPT:
            numbers.clear()
            known.clear()
            store[:] = [np.zeros(0, np.uint32), np.zeros(1, np.int64)]
        parts, counts = [], []
        whole: dict[int, np.ndarray] = {}
        for i, text in enumerate(texts):
            text = text or ""
            pieces = chunks(text)
            if pieces is None:
                whole[i] = np.asarray(library.encode(text, add_special_tokens=False).ids, np.uint32)
                counts.append(0)
                continue
            parts.append(np.fromiter(map(numbers.__getitem__, pieces), np.int32, len(pieces)))
            counts.append(len(pieces))
        if len(numbers) >= len(store[1]):
            learn()
        at = np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)
        starts, per = store[1][at], store[1][at + 1] - store[1][at]
        ids = store[0][ragged(starts, per)]
        ends = np.concatenate([[0], np.cumsum(per)])
        lengths = np.diff(ends[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)])
        if whole:
            pieces = np.split(ids, np.cumsum(lengths)[:-1])
            for i, x in whole.items():
                pieces[i] = x
                lengths[i] = len(x)
            ids = np.concatenate(pieces)
        return ids, lengths

    return encode
