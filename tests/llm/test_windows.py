"""Window packing: the encoder against the library, placement against recomputed sums, and whole packings."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from cuewright.llm import byte_encoder, queries, windows
from cuewright.llm.byte_encoder import ByteEncoder

DATA = "/root/testdata/sf0.001"
PATH = P.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, start long, offset string, ids int, lang string"
BITS = [" ", "  ", "\n", "\r\n", "\t", "\x0b", "\x0c", "\x1c", "\x85", "\xa0", " ", "　", "\x00", "a", "b", "don't", "'s", "I'LL", "12", "²", "é", "á", "日本", "😀", "<|endoftext|>", "<|endof", "...", "!?", "_", " the", " of", "word"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("bits", [BITS, [b for b in BITS if b != "\x00"], [" ", "\n", "a", "b.", "'s", "<|endoftext|>", "é"]])
def test_encoder_as_the_library(library, bits):
    chance = random.Random(7)
    texts = ["".join(chance.choices(bits, k=chance.randint(0, 16))) for _ in range(4000)]
    coder = ByteEncoder(PATH)
    for _ in range(2):  # with nothing known, and with all
        ids, offsets = coder.encode(pa.array(texts, pa.string()))
        for k, e in enumerate(library.encode_batch(texts, add_special_tokens=False)):
            assert ids[offsets[k] : offsets[k + 1]].tolist() == e.ids, texts[k]


class Recorder:
    """A tokenizer or its model, which notes the units that it gets."""

    def __init__(self, inner, seen):
        self.inner, self.seen = inner, seen

    def encode_batch_fast(self, units, **options):
        self.seen += units
        return self.inner.encode_batch_fast(units, **options)

    def tokenize(self, unit):
        self.seen.append(unit)
        return self.inner.tokenize(unit)


def recorded():
    coder, seen = ByteEncoder(PATH), []
    coder.tokenizer, coder.model = Recorder(coder.tokenizer, seen), Recorder(coder.tokenizer.model, seen)
    return coder, seen


def as_the_library(coder, library, texts):
    ids, offsets = coder.encode(pa.array(texts, pa.string()))
    for k, e in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == e.ids, texts[k]


def test_words_with_marks_are_encoded_once(library):
    words, marks = [a + b for a in ("ver", "lich", "größe", "on") for b in ("ing", "keit", "été", "er")], ["(", ")", "***", "$$$", "...", "-", "1", "42", ")***", ","]
    coder, seen = recorded()
    for _ in range(2):
        as_the_library(coder, library, [" ".join(a + w + b for w in words) for a in marks for b in marks])
    assert len(seen) <= 2 * (len(words) + len(marks))  # with a space before them, and without


@pytest.mark.parametrize("bound", [1 << 14, 1 << 10])
def test_common_words_stay_known(library, monkeypatch, bound):
    monkeypatch.setattr(byte_encoder, "CACHE_BYTES", bound, raising=False)
    monkeypatch.setattr(byte_encoder, "CACHE_ENTRIES", bound // 64, raising=False)
    common = [f"{a}{b}" for a in ("the", "of", "and", "to") for b in ("ing", "ed", "er")]
    coder, seen = recorded()
    for k in range(40):
        rare = [chr(97 + k % 26) * n + chr(97 + k // 26) for n in range(2, 32)]
        as_the_library(coder, library, [" ".join(["", *common, *rare])])
        assert len(coder.known) <= bound // 16
    sent = sum(u.strip(" Ġ") in common for u in seen)
    assert sent == (len(common) if bound > 1 << 12 else 40 * len(common))  # a bound that no slice fits keeps nothing


def test_characters_at_the_cuts(library):
    chance, coder = random.Random(11), ByteEncoder(PATH)
    bits = ["a", "é", "ª", "µ", "×", "÷", "ÿ", "0", "²", "٣", "'", "'s", "'ve", "''", "-", "_", "’", "\x7f", "\x1f", "\x85", "\u180e", "\u2003", "\u2028", "\u200b", "\u3000", "\ufeff", "e\u0301", "ſ", "text|>", "<|endoftext|>", "\n", "\n\n", " ", "  "]
    for _ in range(30):
        some = chance.sample(bits, chance.randint(3, len(bits)))
        as_the_library(coder, library, ["".join(chance.choices(some, k=chance.randint(0, 12))) for _ in range(300)])
    shifted = pa.array(["é", "\n", "a\n", "\nb", "", " c", "d "], pa.string())
    ids, offsets = coder.encode(shifted.slice(1))
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [library.encode(t).ids for t in shifted.to_pylist()[1:]]


def test_least_sum_of_squares():
    chance, capacity = random.Random(3), 24
    packer = windows.Packer(capacity, 10_000)
    for doc in range(3000):
        size = chance.randint(1, capacity)
        before = {level: len(w) for level, w in enumerate(packer.open) if w}
        packer.add(doc, np.zeros(size, "<u4"))
        after = Counter({level: len(w) for level, w in enumerate(packer.open) if w})
        sums = []
        for level in [0, *before]:
            if level + size <= capacity:
                tried = Counter(before)
                tried[level] -= level > 0
                tried[level + size] += level + size < capacity
                sums.append(sum(n * n for n in tried.values()))
        assert sum(n * n for n in after.values()) == min(sums)
        assert packer.levels.count.tolist() == [after[k] for k in range(capacity + 1)]


def checked(pieces, texts, library, end_id=1, capacity=2048):
    """Every id of every document in one piece, windows gapless, and no padding; the number of windows."""
    of_doc, of_window = defaultdict(list), defaultdict(list)
    for p in pieces:
        of_doc[p.doc_id].append(p)
        of_window[p.sequence_id].append((p.offset, p.length))
    wanted = defaultdict(list)
    for doc_id, text in texts:
        wanted[doc_id].append([*library.encode(text or "", add_special_tokens=False).ids, end_id])
    assert of_doc.keys() == wanted.keys()
    for doc_id, lists in wanted.items():
        if len(lists) > 1:  # repeated rows: as many ids in all
            assert sum(p.length for p in of_doc[doc_id]) == sum(map(len, lists))
            continue
        at = 0
        for p in sorted(of_doc[doc_id], key=lambda p: p.start):
            own = np.array(lists[0][at : at + p.length], "<u4").tobytes()
            assert (p.start, p.doc_tokens, zlib.crc32(own)) == (at, len(lists[0]), p.ids_crc32)
            at += p.length
        assert at == len(lists[0])
    for parts in of_window.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity and (at == capacity or at & (at - 1) == 0)
    return len(of_window)


def test_whole_table(spark, library):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    found = queries.op12_window_packing(spark, DATA).collect()
    n, tokens = checked(found, rows, library), sum(p.length for p in found)
    assert n <= tokens / 2048 + 12
    # settling cuts one piece for each window that it fills, and the last window at powers of two
    least = sum(-(-p.doc_tokens // 2048) for p in found if p.start == 0)
    assert len(found) - least <= n + 12 and len(rows) == sum(p.start == 0 for p in found)


def test_edges(spark, library):
    rows = [(1, None), (2, ""), (3, "one two"), (3, "one two"), (None, "no id"), (4, "word " * 30_000), (5, "x" * 70_000), (6, "a\x00b"), (7, "<|endoftext|> <|endoftext|>")]
    docs = spark.createDataFrame([(i, t, 9, "x", 1, "en") for i, t in rows], SCHEMA)
    pack = lambda d, **o: windows.pack(d, PATH, **o).selectExpr("*", "crc32(ids) AS ids_crc32").collect()
    checked(pack(docs), rows, library)
    assert pack(docs.limit(0)) == []
    many = [(k, "one two three four " * (k % 9)) for k in range(400)]
    frame = spark.createDataFrame([(i, t, 9, "x", 1, "en") for i, t in many], SCHEMA).repartition(3)
    checked(pack(frame, capacity=64, most_open=4, end_id=9), many, library, 9, 64)
