"""Exact, cached encoding with the tokenizers library, for use inside Python workers.

Encoding whole texts at about 1 MB a second and core would cost more than all else. The two
kinds of vocabulary here never merge across certain blanks, so a text's ids are those of its
chunks, one after the other; most chunks are words seen before. The cache is bounded in bytes,
and what was asked for lately stays in it; long texts are cut into chunks bit by bit.

* "bytes": byte-level BPE whose pre-tokenizer gives a word its one preceding blank, and a run
  of blanks all but its last; a run of letters and a run of marks are always parted (but for
  apostrophes, which may take letters along). The chunks below are that rule.
* "words": BPE whose normalizer drops blanks between words. Chunks are cut at ASCII blanks,
  across which neither its normalizer nor its pattern reaches, and between letters and marks.

A new chunk of only letters or only marks is one piece of its pre-tokenizer and goes straight
to the model, in the byte-level alphabet; other new chunks are encoded in full.

Any other tokenizer is "whole": texts are encoded as they are. Strings of special tokens in a
text are ordinary text.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Callable
from functools import lru_cache
from itertools import islice

import numpy as np

#: Unicode White_Space, as the byte-level pattern's blank class has it (Python's own has four more).
_BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters and marks that are so in every version of Unicode, in composed form also in lower
#: case. Apostrophes are neither.
_LETTER, _MARK = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u017f", "!-&(-/:-@\\[-`{-~"
_WORD = f"[{_LETTER}]+(?=['{_MARK}{_BLANK}]|$)|[{_MARK}]+(?=[{_LETTER}{_BLANK}]|$)|[^{_BLANK}]+"
_CHUNK = re.compile(f"[{_BLANK}]+(?![^{_BLANK}])| ?(?:{_WORD})|[{_BLANK}]")
_ASCII_BLANK = " \t-\r"
_PART = re.compile(f"[{_LETTER}]+(?=['{_MARK}{_ASCII_BLANK}]|$)|[{_MARK}]+(?=[{_LETTER}{_ASCII_BLANK}]|$)|[^{_ASCII_BLANK}]+")
#: Chunks that are one piece.
_PIECE = re.compile(f" ?(?:[{_LETTER}]+|[{_MARK}]+)")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes are themselves, the others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {**{b: chr(b) for b in shown}, **{b: chr(256 + i) for i, b in enumerate(hidden)}}


_BYTES = _byte_letters()

#: Bytes of a worker's cache, of which one half is what was asked for since the other was full.
CACHE_BYTES = 256 << 20
#: What a chunk takes in it besides its characters and ids.
_ENTRY = 120
#: Texts are cut into chunks so many characters at a time, or so many chunks of a longer one.
_CHARS, _CHUNKS = 500_000, 100_000


class ChunkEncoder:
    """Token ids of texts as uint32 arrays."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.kind = _kind(self.tokenizer)
        self.pattern = {"bytes": _CHUNK, "words": _PART}.get(self.kind)
        self.model = self.tokenizer.model
        # a vocabulary that behaves otherwise is encoded in full
        trial = ["word", "\xc4rger", "**", ".,", "ab" * 30, "Q", "\xe9"] + ([" word", " ,", " \xfc"] if self.kind == "bytes" else [])
        self.pieces = self.kind != "whole" and all(self._piece(t) == ids for t, ids in zip(trial, self._ids(trial), strict=True))
        self.cache = _Chunks(self._learn)
        self.older: dict[str, bytes] = {}
        self.most = cache_bytes // 2

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.kind == "whole":
            return [np.array(ids, dtype="<u4") for ids in self._ids(texts)]
        out: list[np.ndarray] = []
        for batch in _by_length(texts, _CHARS):
            if len(batch) == 1 and len(batch[0]) > _CHARS:
                found = (m.group() for m in self.pattern.finditer(batch[0]))
                parts = [self._encode_cut([part])[0] for part in iter(lambda: list(islice(found, _CHUNKS)), [])]
                out.append(np.concatenate(parts) if parts else np.zeros(0, "<u4"))
            else:
                out += self._encode_cut([self.pattern.findall(t) for t in batch])
        return out

    def _encode_cut(self, cut: list[list[str]]) -> list[np.ndarray]:
        if self.cache.taken > self.most:
            self.older, self.cache = self.cache, _Chunks(self._learn)
        return [np.frombuffer(b"".join(map(self.cache.__getitem__, chunks)), dtype="<u4") for chunks in cut]

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for at in range(0, len(texts), 4096) for e in self.tokenizer.encode_batch_fast(texts[at : at + 4096], add_special_tokens=False)]

    def _piece(self, chunk: str) -> list[int]:
        low = chunk.lower() if self.kind == "words" else chunk
        shown = low.replace(" ", _BYTES[32]) if low.isascii() else low.encode().decode("latin-1").translate(_BYTES)
        return [t.id for t in self.model.tokenize(shown)]

    def _learn(self, chunk: str) -> bytes:
        """The ids of a chunk that the cache lacks."""
        known = self.older.get(chunk)
        if known is not None:
            return known
        ids = self._piece(chunk) if self.pieces and _PIECE.fullmatch(chunk) else self._ids([chunk])[0]
        return struct.pack(f"<{len(ids)}I", *ids)


class _Chunks(dict):
    """Ids by chunk; what is not there yet is learned when it is asked for."""

    def __init__(self, learn: Callable[[str], bytes]):
        self.learn, self.taken = learn, 0

    def __missing__(self, chunk: str) -> bytes:
        ids = self[chunk] = self.learn(chunk)
        self.taken += _ENTRY + len(chunk) + len(ids)
        return ids


def _by_length(texts: list[str], chars: int):
    """Runs of texts of so many characters at most; a longer text is a run of its own."""
    batch: list[str] = []
    n = 0
    for t in texts:
        if batch and n + len(t) > chars:
            yield batch
            batch, n = [], 0
        batch.append(t)
        n += len(t)
    if batch:
        yield batch


def _kind(tokenizer) -> str:
    """Which chunk rule holds; anything not known for certain is 'whole'."""
    spec = json.loads(tokenizer.to_str())
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not norm:
        return "bytes"
    steps = [s.get("type") for s in norm.get("normalizers", [])]
    parts = pre.get("pretokenizers", [])
    if steps == ["NFC", "Replace", "Lowercase"] and [p.get("type") for p in parts] == ["Split", "ByteLevel"]:
        split, bytes_ = parts
        drops_blanks = split.get("invert") and split.get("behavior") == "Removed" and r"[^\s\p{L}\p{N}]+" in split["pattern"].get("Regex", "")
        if drops_blanks and not bytes_.get("add_prefix_space"):
            return "words"
    return "whole"


@lru_cache(maxsize=4)
def worker_encoder(path: str) -> ChunkEncoder:
    """One encoder per worker process and vocabulary."""
    return ChunkEncoder(path)
