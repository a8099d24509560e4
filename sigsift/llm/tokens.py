"""Token ids of whole texts by a byte-level BPE file of the ``tokenizers`` library.

A text is cut before white space that follows other characters.  No token
reaches over such a place, so equal pieces have equal ids: a batch encodes each
distinct piece once and puts the ids together with array arithmetic.  Texts that
contain a special token's string go through ``tokenizers`` itself, and so does
every piece when the file is not a byte-level BPE whose ids are its ranks.
"""

from __future__ import annotations

import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# The pattern that byte-level BPE files of this family split by, and white space as it means it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WHITE = "\t-\r " + "".join(map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))

PIECE = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+\\Z")
#: A space after white space: such a text is cut by PIECE and not at every space.
DOUBLE = f"[{WHITE}] "
KEPT = 200_000
BATCH_BYTES = 4 << 20

_made: dict[int, Encoder] = {}


def _byte_of() -> dict[str, int]:
    """The character that stands for each byte: itself where it is visible, else the next from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + n): b for n, b in enumerate(hidden)}


class Encoder:
    """Encodes Arrow arrays of texts; one for each Python process."""

    def __init__(self, content: bytes) -> None:
        from tokenizers import Tokenizer

        spec = json.loads(content)
        self.whole = Tokenizer.from_str(content.decode())
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.known: dict[str, tuple[int, ...]] = {}
        self.plain = self._ranked(spec) or (lambda piece: self.whole.encode(piece, add_special_tokens=False).ids)

    def _ranked(self, spec: dict):
        """A faster encoder with the same ids, where the ids of merged tokens are in order of the merges."""
        model, before = spec.get("model", {}), spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or spec.get("normalizer"):
            return None
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ids = [model["vocab"].get("".join(m), -1) for m in merges]
        if any(a >= b for a, b in zip([-1, *ids], ids, strict=False)):
            return None
        import tiktoken

        byte_of, special = _byte_of(), set(self.special)
        ranks = {bytes(byte_of[c] for c in token): n for token, n in model["vocab"].items() if token not in special}
        return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def piece(self, text: str) -> tuple[int, ...]:
        ids = self.known.get(text)
        if ids is None:
            if len(self.known) >= KEPT:
                self.known.clear()
            ids = self.known[text] = tuple(self.plain(text)) if text else ()
        return ids

    def _slowly(self, text: str) -> list[int]:
        if any(s in text for s in self.special):
            return self.whole.encode(text, add_special_tokens=False).ids
        return list(chain.from_iterable(map(self.piece, PIECE.findall(text))))

    def batch(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of every text, as unsigned 32-bit numbers; none for null."""
        texts = pc.fill_null(texts, "")
        slow = pc.match_substring_regex(texts, DOUBLE)
        for s in self.special:
            slow = pc.or_(slow, pc.match_substring(texts, s))
        slow = slow.to_numpy(zero_copy_only=False)
        out: list[np.ndarray] = [None] * len(texts)  # type: ignore[list-item]
        for n in np.flatnonzero(slow):
            out[n] = np.array(self._slowly(texts[int(n)].as_py()), np.uint32)
        quick = np.flatnonzero(~slow)
        if len(quick):
            for n, ids in zip(quick, self._quickly(texts.take(pa.array(quick))), strict=True):
                out[n] = ids
        return out

    def _quickly(self, texts: pa.Array) -> list[np.ndarray]:
        pieces = pc.split_pattern(texts, " ")
        ends = np.asarray(pieces.offsets)
        coded = pieces.flatten().dictionary_encode()
        codes, distinct = np.asarray(coded.indices).astype(np.int64), coded.dictionary.to_pylist()
        # a text's first piece stands alone, each other one has its space before it
        lists = [self.piece(" " + p) for p in distinct]
        first = ends[:-1]
        opening, back = np.unique(codes[first], return_inverse=True)
        lists += [self.piece(distinct[n]) for n in opening]
        codes[first] = len(distinct) + back
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        ids = np.fromiter(chain.from_iterable(lists), np.uint32, int(sizes.sum()))
        starts, counts = np.cumsum(sizes) - sizes, sizes[codes]
        total = np.concatenate([[0], np.cumsum(counts)])
        joined = ids[np.repeat(starts[codes] - total[:-1], counts) + np.arange(total[-1])]
        return np.split(joined, total[ends[1:-1]])


def encoder(content: bytes) -> Encoder:
    """The process's encoder for a file's content."""
    key = hash(content)
    if key not in _made:
        _made[key] = Encoder(content)
    return _made[key]


def slices(texts: pa.Array, limit: int = BATCH_BYTES):
    """(start, length) of runs of texts of about ``limit`` bytes; a longer text is a run of its own."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    start, size = 0, 0
    for n, x in enumerate(sizes):
        if n > start and size + x > limit:
            yield start, n - start
            start, size = n, 0
        size += x
    if start < len(sizes):
        yield start, len(sizes) - start
