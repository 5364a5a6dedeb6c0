"""Token ids of whole texts by a byte-level file of the tokenizers library, one call for each distinct unit.

A text is cut where a pre-token surely ends: before a space or line end that follows a character which is
no white space, after a single line end between such characters, and between ASCII letters, digits and
other printable characters (letters up to U+00FF count as letters), but not after an apostrophe, which may
begin a contraction.  No pre-token reaches across and none depends on what follows, so the ids of a text
are those of its units in order.  A text that holds a special string is cut at white space only; special
strings hold none, so a unit has them whole and the library treats them as it does by default.

Units are numbered and looked up as Arrow arrays.  Of the new ones, those of one pre-token go to the
library's own BPE model, the others through its full ``encode``.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import ragged_take, utf8_bytes
from .word_encoder import byte_alphabet

#: With an optional space before it: one class of characters is one pre-token.
SINGLE = r"^ ?([A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]+|[!-/:-@\[-`{-~]+)$"
LETTER, DIGIT, OTHER, BLANK = 1, 2, 3, 4
#: The class of each byte that is a whole character.  Control characters are no sure cut on either side; as some readings of white space have them, they count as blank.
CLASSES = np.zeros(256, np.uint8)
CLASSES[0x21:0x7F] = OTHER
CLASSES[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
CLASSES[0x30:0x3A] = DIGIT
CLASSES[[*range(0x21), 0x7F]] = BLANK
#: The same for code points of more bytes: letters to U+00FF, and all that some reading has as white space; the others have none.
KINDS = np.zeros(0x4000, np.uint8)
KINDS[[*range(0x80, 0xA1), 0x1680, 0x180E, *range(0x2000, 0x2010), *range(0x2028, 0x2030), *range(0x205F, 0x2070), 0x3000]] = BLANK
KINDS[[*range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]] = LETTER
#: The lead bytes of those.
LEADS = np.isin(np.arange(256), [0xC2, 0xC3, 0xE1, 0xE2, 0xE3])
CACHE_BYTES = 48 << 20


def byte_classes(flat: np.ndarray) -> np.ndarray:
    """The class of each byte's character, 0 for all that have none."""
    classes = CLASSES[flat]
    leads = np.flatnonzero(LEADS[flat])
    wide = flat[leads] >= 0xE0
    for at, size in ((leads[~wide], 2), (leads[wide], 3)):
        point = (flat[at] & (0x1F if size == 2 else 0x0F)).astype(np.uint16)
        for k in range(1, size):
            point = point << 6 | flat[at + k] & 0x3F
        for k in range(size):
            classes[at + k] = KINDS[point]
    return classes


class ByteEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        alphabet = byte_alphabet()
        self.spelled = {c: "".join(alphabet[b] for b in chr(c).encode()) for c in range(256)}
        added = list(self.tokenizer.get_added_tokens_decoder().values())
        self.specials = [t.content for t in added]
        spaced = [t.content for t in added if re.search(r"\s", t.content) or t.lstrip or t.rstrip or t.single_word]
        if spaced:
            raise ValueError(f"special strings that depend on white space: {spaced}")
        self.forget()

    def forget(self) -> None:
        """The known units, and the place and number of each one's ids in ``flat``."""
        self.known = pa.array([], pa.string())
        self.starts, self.sizes, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def learn(self, fresh: pa.Array) -> None:
        """Append units that are not yet known."""
        single = pc.match_substring_regex(fresh, SINGLE).to_numpy(zero_copy_only=False)
        units, ids = fresh.to_pylist(), [[]] * len(fresh)
        tokenize, spelled = self.model.tokenize, self.spelled
        for k in np.flatnonzero(single).tolist():
            ids[k] = [t.id for t in tokenize(units[k].translate(spelled))]
        rest = np.flatnonzero(~single).tolist()
        for k, e in zip(rest, self.tokenizer.encode_batch_fast([units[k] for k in rest], add_special_tokens=False), strict=True):
            ids[k] = e.ids
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, np.fromiter((i for each in ids for i in each), "<u4", int(sizes.sum()))])
        self.known = pa.concat_arrays([self.known, fresh])

    def shrink(self, codes: np.ndarray) -> None:
        """Beyond the bound, keep the units of ``codes``, or nothing if they take half of it."""
        if self.known.nbytes + self.flat.nbytes + 16 * len(self.known) <= CACHE_BYTES:
            return
        used = np.zeros(len(self.known), bool)
        used[codes] = True
        known, starts, sizes = self.known.filter(pa.array(used)), self.starts[used], self.sizes[used]
        if 2 * (known.nbytes + 4 * int(sizes.sum()) + 16 * len(known)) > CACHE_BYTES:
            return self.forget()
        self.known, self.flat = known, ragged_take(self.flat, starts, sizes)
        self.starts, self.sizes = np.cumsum(sizes) - sizes, sizes

    def cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """All units end to end, and the offsets of each text's."""
        flat, offsets = utf8_bytes(texts)
        cuts = np.zeros(len(flat) + 1, bool)
        if len(flat) > 1:
            classes = byte_classes(flat)
            left, right = classes[:-1], classes[1:]
            cuts[1:-1] = (left != right) & (left > 0) & (right > 0) & (left != BLANK) & (right != BLANK) & (flat[:-1] != ord("'"))
            whole = np.zeros(len(texts), bool)
            for special in self.specials:
                whole |= pc.match_substring(texts, special).to_numpy(zero_copy_only=False)
            for k in np.flatnonzero(whole).tolist():
                cuts[offsets[k] : offsets[k + 1]] = False
            line_ends = flat == ord("\n")
            cuts[1:-1] |= (left != BLANK) & (line_ends | (flat == ord(" ")))[1:]
            # a text's first and last line ends may pass here by their neighbours' characters
            after = np.flatnonzero(line_ends[1:-1] & (left[:-1] != BLANK) & (right[1:] != BLANK)) + 1
            first, last = np.isin(after, offsets), np.isin(after + 1, offsets)
            cuts[after[~first & ~last] + 1] = True
        cuts[offsets] = True
        at = np.flatnonzero(cuts)
        if not len(flat):
            return pa.array([], pa.string()), np.zeros(len(offsets), np.int64)
        units = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat)))
        return units, np.searchsorted(at, offsets)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the offsets of each text's ids."""
        units, offsets = self.cut(texts)
        if not len(units):
            return np.zeros(0, "<u4"), offsets
        coded = pa.chunked_array([self.known, units]).dictionary_encode()
        coded = coded.chunk(coded.num_chunks - 1)
        codes = coded.indices.to_numpy()
        if len(coded.dictionary) > len(self.known):
            self.learn(coded.dictionary.slice(len(self.known)))
        lengths = self.sizes[codes]
        ids = ragged_take(self.flat, self.starts[codes], lengths)
        self.shrink(codes)
        return ids, np.concatenate([[0], np.cumsum(lengths)])[offsets]


_ENCODERS: dict[str, ByteEncoder] = {}


def encoder(path: str) -> ByteEncoder:
    """One encoder for each worker process and file, so that its units stay known across tasks."""
    if path not in _ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[path] = ByteEncoder(path)
    return _ENCODERS[path]
