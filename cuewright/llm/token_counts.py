"""Operator 2: token counts of whole texts by rank-synchronous array merging.

Pre-tokens of a batch lie end to end in one array of symbols.  Each round looks up the rank of every
neighbouring pair, takes the lowest rank of each sequence by a segmented minimum, and merges all of
that pair's occurrences in all sequences at once; sequences without a mergeable pair leave.  The
count of a sequence is the number of symbols that survive.

Null texts count as empty, with 0 tokens.  Repeated rows each give a row, a null doc_id stays null,
and other columns are not read.  The string of an added special token inside a text counts as one
token, which is the library's default.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import sums_by_row, text_slices
from .word_encoder import byte_alphabet

NONE = np.int64(1) << 40
CACHE_ENTRIES = 900_000
#: NUL (the mark below), or two white space characters in a row: only then can a pre-token depend on more than one space-separated unit.
WIDE_SPACE = r"\x00|\s\s|^\s|\s$"


class ArrayBpe:
    """Merge tables of a byte-level BPE file, applied to many sequences at once."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        alphabet = byte_alphabet()
        self.of_byte = np.array([vocab[alphabet[b]] for b in range(256)], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        into = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.into = keys[order], order, into
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = re.compile("|".join(map(re.escape, self.specials)) or r"(?!)")
        self.pattern = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], NONE)

    def merge_counts(self, tokens: list[bytes]) -> np.ndarray:
        """Symbols left of each byte string after all merges."""
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        counts = lengths.copy()
        live = np.flatnonzero(lengths > 1)
        symbols = self.of_byte[np.frombuffer(b"".join([tokens[k] for k in live]), np.uint8)]
        lengths = lengths[live]
        while len(live):
            starts = np.cumsum(lengths) - lengths
            ranks = np.full(len(symbols), NONE)
            ranks[:-1] = self.rank(symbols[:-1], symbols[1:])
            ranks[starts[1:] - 1] = NONE
            lowest = np.minimum.reduceat(ranks, starts)
            going = lowest < NONE
            if not going.all():
                counts[live[~going]] = lengths[~going]
                stay = np.repeat(going, lengths)
                symbols, ranks, live, lengths, lowest = symbols[stay], ranks[stay], live[going], lengths[going], lowest[going]
                if not len(live):
                    break
                starts = np.cumsum(lengths) - lengths
            hit = np.flatnonzero((ranks == np.repeat(lowest, lengths)) & (ranks < NONE))
            # in a run of overlapping occurrences (x x x) every second one merges, from the left
            fresh = np.concatenate([[True], np.diff(hit) > 1])
            run_start = hit[np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))]
            hit = hit[(hit - run_start) % 2 == 0]
            symbols[hit] = self.into[ranks[hit]]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            gone = np.add.reduceat((~keep).astype(np.int64), starts)
            symbols, lengths = symbols[keep], lengths - gone
        return counts

    def count_strings(self, strings: list[str]) -> np.ndarray:
        """Tokens of each string, cut by the pre-token pattern and counted over its distinct pre-tokens."""
        cut = [self.pattern.findall(s) for s in strings]
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        coded = pa.array(list(chain.from_iterable(cut)), pa.string()).dictionary_encode()
        each = self.merge_counts([t.encode() for t in coded.dictionary.to_pylist()])
        return sums_by_row(each[coded.indices.to_numpy()] if len(each) else np.zeros(0, np.int64), np.concatenate([[0], np.cumsum(sizes)]))

    def count_units(self, units: pa.Array) -> np.ndarray:
        coded = units.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        fresh = [u for u in distinct if u not in self.known]
        if len(self.known) + len(fresh) > CACHE_ENTRIES:
            self.known, fresh = {}, distinct
        if fresh:
            self.known.update(zip(fresh, self.count_strings(fresh).tolist(), strict=True))
        return np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy()]

    def count(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text."""
        odd = pc.match_substring_regex(texts, WIDE_SPACE)
        for s in self.specials:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        odd = odd.to_numpy(zero_copy_only=False)
        out = np.zeros(len(texts), np.int64)
        if (~odd).any():
            # a unit starts at each space, which belongs to the pre-token that follows it
            marked = pc.replace_substring(texts.filter(pa.array(~odd)), " ", "\x00 ")
            units = pc.split_pattern(marked, "\x00")
            offsets = units.offsets.to_numpy().astype(np.int64)
            out[~odd] = sums_by_row(self.count_units(units.values.slice(offsets[0], offsets[-1] - offsets[0])), offsets - offsets[0])
        if odd.any():
            whole = texts.filter(pa.array(odd)).to_pylist()
            parts = [self.special.split(t) for t in whole]
            ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            plain = self.count_strings([s for p in parts for s in p])
            out[odd] = sums_by_row(plain, ends) + np.diff(ends) - 1
        return out


_COUNTERS: dict[tuple[str, str], ArrayBpe] = {}


def counter(path: str, pattern: str) -> ArrayBpe:
    if (path, pattern) not in _COUNTERS:
        _COUNTERS[path, pattern] = ArrayBpe(path, pattern)
    return _COUNTERS[path, pattern]


def token_counts(docs: DataFrame, tokenizer: str, pattern: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether n_tokens is over ``limit``, for every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = counter(tokenizer, pattern)
        for batch in text_slices(batches, "text"):
            n = bpe.count(batch["text"])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pc.binary_length(batch["text"]).cast(pa.int64()), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
