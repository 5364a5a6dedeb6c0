"""Token ids of whole texts by the tokenizers library, one library call for each distinct word piece.

The tokenizer of ``word_bpe_49k.json`` drops white space, so a text's ids are those of its
white-space-separated chunks in order.  Chunks made of letters up to U+00FF and then ASCII
punctuation need no normaliser beyond lower-casing, and split into two pre-tokens; the library's
own BPE model encodes those.  Every other chunk goes through the library's full ``encode``.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import ragged_take

#: Letters whose lower case and composition are the same everywhere, then punctuation without the apostrophe.
SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:-@\[-`{-~]*)")
CACHE_ENTRIES = 300_000


def byte_alphabet() -> dict[int, str]:
    """The printable character that byte-level vocabularies use for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class WordEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        alphabet = byte_alphabet()
        self.spelled = {c: "".join(alphabet[b] for b in chr(c).encode()) for c in range(256)}
        self.known: dict[str, bytes] = {"": b""}

    def piece(self, piece: str) -> bytes:
        ids = array("I", [t.id for t in self.model.tokenize(piece.translate(self.spelled))]).tobytes()
        if len(self.known) >= CACHE_ENTRIES:
            self.known = {"": b""}
        self.known[piece] = ids
        return ids

    def chunks(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk as little-endian unsigned 32-bit integers."""
        out, odd, simple = [], [], SIMPLE.fullmatch
        for k, chunk in enumerate(chunks):
            if found := simple(chunk):
                word, marks = found[1].lower(), found[2]
                ids = self.known.get(word)
                if ids is None:
                    ids = self.piece(word)
                if marks:
                    more = self.known.get(marks)
                    ids += self.piece(marks) if more is None else more
                out.append(ids)
            else:
                odd.append(k)
                out.append(b"")
        encoded = self.tokenizer.encode_batch_fast([chunks[k] for k in odd], add_special_tokens=False)
        for k, e in zip(odd, encoded, strict=True):
            out[k] = np.array(e.ids, "<u4").tobytes()
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the offsets of each text's ids."""
        words = pc.ascii_split_whitespace(texts)
        offsets = words.offsets.to_numpy().astype(np.int64)
        coded = words.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        encoded = self.chunks(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded)) // 4
        flat = np.frombuffer(b"".join(encoded), "<u4")
        codes = coded.indices.to_numpy()
        lengths = sizes[codes]
        ids = ragged_take(flat, (np.cumsum(sizes) - sizes)[codes], lengths)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return ids, ends[offsets - offsets[0]]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process and file, so that its words stay known across tasks."""
    if path not in _ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
