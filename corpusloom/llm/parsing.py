"""Prefix-free parsing: rolling-hash triggers cut phrases; suffix ranks of dictionary and parse combine into corpus order."""

from __future__ import annotations

import numpy as np

from corpusloom.llm.common import Rolling

TRIGGER, MODULUS = 16, 64


def _dense(keys: np.ndarray) -> np.ndarray:
    """Ranks from 1."""
    return np.unique(keys, return_inverse=True)[1].astype(np.int64) + 1


def _doubled(rank: np.ndarray, last: np.ndarray, known: int, depth: int) -> np.ndarray:
    """Ranks of the suffixes, each up to its own ``last`` position, by their first ``depth`` symbols; ranks of ``known`` symbols are given."""
    here = np.arange(len(rank))
    while known < depth and rank.max(initial=0) < len(rank):
        there = here + known
        after = np.where(there <= last, rank[np.minimum(there, len(rank) - 1)], 0)
        rank = _dense(rank * (len(rank) + 2) + after)
        known *= 2
    return rank


def corpus_order(blocks: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, order): the blocks, each closed by TRIGGER separators, and all its positions sorted by their next ``depth`` symbols.

    Symbols are bytes plus 2; the separator is 1.
    """
    parts = []
    for b in blocks:
        parts += [np.frombuffer(b, np.uint8).astype(np.int64) + 2, np.ones(TRIGGER, np.int64)]
    text = np.concatenate(parts)
    n = len(text)
    grams = Rolling((text & 255).astype(np.uint8)).grams(TRIGGER)
    is_trigger = grams % np.uint64(MODULUS) == 0
    ends = np.cumsum([len(b) + TRIGGER for b in blocks]) - TRIGGER
    for k in range(1, TRIGGER):  # a gram that runs into separators is none
        is_trigger[ends - k] = False
        is_trigger[(ends + k)[ends + k < len(is_trigger)]] = False
    is_trigger[ends] = True
    is_trigger[0] = True
    starts = np.flatnonzero(is_trigger)
    stops = np.append(starts[1:] + TRIGGER, n)

    def phrase_name(a: int, b: int) -> bytes:
        return raw[2 * a : 2 * b]

    raw = text.astype("<u2").tobytes()
    names: dict[bytes, int] = {}
    parse = np.array([names.setdefault(phrase_name(a, b), len(names)) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)])
    sizes = np.array([len(x) // 2 for x in names])
    dictionary = np.frombuffer(b"".join(names), "<u2").astype(np.int64)
    first = np.concatenate(([0], np.cumsum(sizes)))
    last = np.repeat(first[1:] - 1, sizes)
    here = np.arange(len(dictionary))
    packed = np.zeros(len(dictionary), np.int64)
    for k in range(6):
        packed = packed << 9 | np.where(here + k <= last, dictionary[np.minimum(here + k, len(dictionary) - 1)], 0)
    suffix = _doubled(_dense(packed), last, 6, min(depth, int(sizes.max())))
    ordered = suffix[first[parse]]
    following = _doubled(_dense(ordered), np.full(len(parse), len(parse) - 1), 1, depth)
    following = np.append(following, 0)
    of = np.searchsorted(starts, np.arange(n), "right") - 1
    key = suffix[first[parse[of]] + np.arange(n) - starts[of]] * (len(following) + 1) + following[of + 1]
    return text, np.argsort(key, kind="stable")
