"""Token ids of whole texts by a public BPE vocabulary with word ends, at the speed of array operations.

Texts of ASCII and the letters of U+00C0..U+00FF are cut into pre-tokens on bytes; each distinct pre-token is encoded
once by the tokenizer and then looked up by a 64-bit hash. Any other text goes to the tokenizer whole.
"""

from __future__ import annotations

import os
import re

import numpy as np

from corpusloom.llm.common import U64, Rolling, slices

SPACE, LETTER, DIGIT, OTHER = range(4)
CLASSES = np.array([SPACE if b in b" \t\n\r" else LETTER if 97 <= b <= 122 or b >= 128 else DIGIT if 48 <= b <= 57 else OTHER for b in range(256)], np.int8)
#: White space, printable ASCII, and the bytes of U+00C0..U+00FF.
USUAL = bytes([9, 10, 13, *range(0x20, 0x7F), *range(0x80, 0xC0), 0xC3])
#: Two signs that aren't letters, and the start of a special token's name.
ODD = (b"\xc3\x97", b"\xc3\xb7", b"<|")
#: What the tokenizer's pattern takes together with an apostrophe, longest last.
ENDINGS = [b"s", b"t", b"m", b"d", b"re", b"ve", b"ll"]
SLOT_BITS = 21
MAX_WORDS = 1_000_000
#: Parts have this size, or are one pre-token. Pre-tokens of one byte are few and others have two, so a part has about half as many
#: distinct words, fewer than there are slots beyond MAX_WORDS: a free one is always found.
PART_BYTES, STEP = 1 << 20, 4096
BETWEEN = re.compile(rb"[0-9A-Za-z][ \n][0-9A-Za-z]")


def unusual(doc: bytes) -> bool:
    return bool(doc.translate(None, USUAL)) or any(x in doc for x in ODD)


def last_end(part: bytes) -> int:
    """The last place in a part, but its start and end, where a pre-token surely ends: between two classes or digits, not after an apostrophe; 0 if there is none."""
    at = len(part)
    while at > 1:
        low = max(0, at - STEP)
        kind = CLASSES[np.frombuffer(part[low:at].lower(), np.uint8)]
        ends = np.flatnonzero((kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)) + 1
        ends = [e for e in ends[-3:].tolist() if part[low + e - 1] != 0x27]
        if ends:
            return low + ends[-1]
        at = low + 1
    return 0


def cut_up(doc: bytes) -> list[bytes]:
    """A text in parts of PART_BYTES at most, cut where a pre-token ends; one that is longer itself stays whole."""
    out, at = [], 0
    while len(doc) - at > PART_BYTES:
        size = PART_BYTES
        while not (cut := last_end(doc[at : at + size])) and at + size < len(doc):
            size *= 2
        if not cut:
            break
        out.append(doc[at : at + cut])
        at += cut
    return [*out, doc[at:]]


def cut_at_spaces(doc: bytes) -> list[bytes]:
    """A text of any letters in parts, cut before a blank or new line between ASCII letters or digits, where nothing depends on the other side."""
    out, at = [], 0
    while len(doc) - at > PART_BYTES:
        found = None
        for found in BETWEEN.finditer(doc, at + PART_BYTES // 2, at + PART_BYTES):  # noqa: B007
            pass
        found = found or BETWEEN.search(doc, at + PART_BYTES)
        if not found:
            break
        out.append(doc[at : found.start() + 1])
        at = found.start() + 1
    return [*out, doc[at:]]


def lowered(blob: bytes) -> np.ndarray:
    data = np.frombuffer(blob.lower(), np.uint8).copy()
    at = np.flatnonzero(data[:-1] == 0xC3) + 1
    data[at[(data[at] >= 0x80) & (data[at] <= 0x9E)]] += 0x20
    return data


def pre_tokens(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of contractions, letter runs, single digits and runs of other signs."""
    kind = np.concatenate((CLASSES[data], [SPACE])).astype(np.int8)
    edge = np.ones(len(kind), bool)
    edge[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    sign = np.flatnonzero((data[:-1] == 0x27) & edge[:-2] & (kind[1:-1] == LETTER)) if len(data) > 1 else np.zeros(0, int)
    for ending in ENDINGS:
        hit = sign[sign + len(ending) < len(data)]
        for k, b in enumerate(ending):
            hit = hit[data[hit + 1 + k] == b]
        edge[hit + 1] = False
        edge[hit + 1 + len(ending)] = True
    bounds = np.flatnonzero(edge)
    real = kind[bounds[:-1]] != SPACE
    return bounds[:-1][real], bounds[1:][real]


class Encoder:
    """Ids of texts; keeps the ids of words it has met, up to MAX_WORDS."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.forget()

    def forget(self) -> None:
        self.keys, self.where = np.zeros(1 << SLOT_BITS, U64), np.zeros(1 << SLOT_BITS, np.int32)
        self.starts, self.pool, self.used = np.zeros(1, np.int32), np.zeros(0, np.int32), 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the words met before, -1 for others, by linear probing."""
        out = np.full(len(hashes), -1, np.int64)
        left, slot = np.arange(len(hashes)), (hashes >> U64(64 - SLOT_BITS)).astype(np.int64)
        while len(left):
            there = self.keys[slot]
            hit = there == hashes[left]
            out[left[hit]] = self.where[slot[hit]]
            on = ~hit & (there != 0)
            left, slot = left[on], (slot[on] + 1) & ((1 << SLOT_BITS) - 1)
        return out

    def _put(self, hashes: np.ndarray) -> None:
        """Give distinct new words the next numbers."""
        left, slot = np.arange(len(hashes)), (hashes >> U64(64 - SLOT_BITS)).astype(np.int64)
        while len(left):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = hashes[left[free]]
            won = self.keys[slot] == hashes[left]
            self.where[slot[won]] = left[won] + self.used
            left, slot = left[~won], (slot[~won] + 1) & ((1 << SLOT_BITS) - 1)

    def whole(self, docs: list[bytes]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast([d.decode() for d in docs], add_special_tokens=False)]

    def _learn(self, words: list[bytes], hashes: np.ndarray) -> None:
        ids = [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast([b" ".join(words[i : i + 200]).decode() for i in range(0, len(words), 200)], add_special_tokens=False)]
        flat = np.concatenate(ids)
        cuts = np.flatnonzero(self.ends[flat]) + 1
        assert len(cuts) == len(words), "a pre-token has no word end"
        self._put(hashes)
        self.starts = np.concatenate((self.starts, (self.starts[-1] + cuts).astype(np.int32)))
        self.pool = np.concatenate((self.pool, flat))
        self.used += len(words)

    def encode(self, docs: list[bytes]) -> list[np.ndarray]:
        """Ids of each text, without special tokens."""
        odd = [i for i, d in enumerate(docs) if unusual(d)]
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(docs)
        if odd:
            for i in odd:
                out[i] = np.concatenate([ids for part in cut_at_spaces(docs[i]) for ids in self.whole([part])])
        skip = set(odd)
        parts = [(i, p) for i, d in enumerate(docs) if i not in skip for p in cut_up(d)]
        found: dict[int, list[np.ndarray]] = {}
        for a, b in slices([len(p) for _, p in parts], PART_BYTES):
            for (i, _), ids in zip(parts[a:b], self._encode([p for _, p in parts[a:b]]), strict=True):
                found.setdefault(i, []).append(ids)
        for i, ids in found.items():
            out[i] = np.concatenate(ids) if len(ids) > 1 else ids[0]
        return out

    def _encode(self, docs: list[bytes]) -> list[np.ndarray]:
        blob = b" ".join(docs) + b" "
        data = lowered(blob)
        starts, ends = pre_tokens(data)
        if not len(starts):
            return [np.zeros(0, np.int32)] * len(docs)
        hashes = Rolling(data).spans(starts, ends) | U64(1)
        if self.used > MAX_WORDS:
            self.forget()
        word = self.find(hashes)
        missing = np.flatnonzero(word < 0)
        if len(missing):
            new, first = np.unique(hashes[missing], return_index=True)
            first, raw = missing[first], data.tobytes()
            self._learn([raw[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)], new)
            word[missing] = self.find(hashes[missing])
        begin, count = self.starts[word], self.starts[word + 1] - self.starts[word]
        total = np.concatenate(([0], np.cumsum(count)))
        ids = self.pool[np.repeat(begin - total[:-1], count) + np.arange(total[-1])]
        cuts = total[np.searchsorted(starts, np.cumsum([0, *(len(d) + 1 for d in docs)]))]
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
