"""Token counts under a unigram model: distinct pre-tokens share their prefixes in a trie, best forward scores are computed once a node.

The pieces are those of a public vocabulary, which has no unigram scores; these are estimated here, from how often the best
segmentations of all documents use each piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import U64, Rolling, batches, slices, texts, word_spans

IN_WORD = np.array([b != 32 for b in range(256)])
BLANKS = bytes(32 if b in b"\t\n\x0b\x0c\r" else b for b in range(256))
#: A byte that no piece covers counts as one token, with a score so far under the least of a piece.
UNKNOWN = 10.0
BLOCK = 2 << 20
#: Pre-tokens of more bytes are scored one by one along the pieces found in them; they would make a trie as deep as they are long.
LONG = 96
_models: dict[str, Pieces] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def pieces_of(path: str) -> list[bytes]:
    """Pieces in the order of the file, with a word's leading blank as b" "."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    known = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    known = [x.replace("▁", " ").encode() for x in known]
    return list(dict.fromkeys(x for x in known if x and b" " not in x[1:]))


def rank_scores(n: int) -> np.ndarray:
    """Where estimation starts: log probabilities of 1 / (rank + 1), normalised."""
    weights = 1 / (np.arange(n) + 1.0)
    return np.log(weights / weights.sum())


def estimated(counts: np.ndarray) -> np.ndarray:
    """Log probabilities from how often each piece is used, with one use added to each."""
    return np.log((counts + 1.0) / (counts.sum() + len(counts)))


class Pieces:
    """Numbers of byte strings by their hash, and their scores."""

    def __init__(self, pieces: list[bytes], scores: np.ndarray):
        blob = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum([len(x) for x in pieces])
        hashes = Rolling(blob).spans(ends - [len(x) for x in pieces], ends)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.longest = max(len(x) for x in pieces)
        self.first = np.searchsorted(self.hashes >> U64(44), np.arange((1 << 20) + 1, dtype=U64))
        self.bytes, self.finder = pieces, None
        self.score(scores)

    def score(self, scores: np.ndarray) -> None:
        self.scores, self.unknown = scores, float(scores.min()) - UNKNOWN

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each, or -1."""
        out = np.full(len(hashes), -1, np.int64)
        slot = (hashes >> U64(44)).astype(np.int64)
        at, stop = self.first[slot], self.first[slot + 1]
        while (live := np.flatnonzero(at < stop)).size:
            hit = live[self.hashes[at[live]] == hashes[live]]
            out[hit] = self.order[at[hit]]
            at[hit] = stop[hit]
            at[np.setdiff1d(live, hit, assume_unique=True)] += 1
        return out

    def within(self, word: bytes) -> Iterator[tuple[int, int]]:
        """(end, number) of each place of a piece in a word, by end."""
        if self.finder is None:
            import ahocorasick

            self.finder = ahocorasick.Automaton()
            for i, x in enumerate(self.bytes):
                self.finder.add_word(x.decode("latin-1"), i)
            self.finder.make_automaton()
        return self.finder.iter(word.decode("latin-1"))


def forward(rolling: Rolling, starts: np.ndarray, ends: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray, list[tuple]]:
    """(tokens, score, levels) of the best segmentations of distinct words; of equal scores the one with fewer tokens counts.

    Level d of the trie has one node for each distinct prefix of d bytes; a node's score comes from its ancestors, at the
    lengths of the pieces that end in it. levels: each node's last piece (-1: an unknown byte), that piece's length and
    the node before it; and the words that end there with their nodes.
    """
    size = ends - starts
    tokens, scores = np.zeros(len(starts), np.int64), np.zeros(len(starts))
    live = np.arange(len(starts))
    recent = [(np.zeros(len(starts), np.int64), np.zeros(1), np.zeros(1, np.int64))]
    levels, depth = [], 0
    while len(live):
        depth += 1
        _, word, node = np.unique(rolling.spans(starts[live], starts[live] + depth), return_index=True, return_inverse=True)
        word = live[word]
        best, count = np.full(len(word), -np.inf), np.zeros(len(word), np.int64)
        last, length, before = (np.zeros(len(word), np.int64) for _ in range(3))
        for k in range(1, min(depth, pieces.longest) + 1):
            of, s, c = recent[-k]
            end = starts[word] + depth
            piece = pieces.find(rolling.spans(end - k, end))
            worth = np.where(piece >= 0, pieces.scores[piece], pieces.unknown if k == 1 else -np.inf)
            parent = of[word]
            now, n = s[parent] + worth, c[parent] + 1
            better = (now > best) | ((now == best) & (n < count))
            for out, new in ((best, now), (count, n), (last, piece), (length, k), (before, parent)):
                np.copyto(out, new, where=better)
        of = np.zeros(len(starts), np.int64)
        of[live] = node
        recent = [*recent[-pieces.longest :], (of, best, count)]
        done = live[size[live] == depth]
        tokens[done], scores[done] = count[of[done]], best[of[done]]
        levels.append((last, length, before, done, of[done]))
        live = live[size[live] > depth]
    return tokens, scores, levels


def uses(levels: list[tuple], weights: np.ndarray, n: int) -> np.ndarray:
    """How often the best segmentations use each of n pieces; each word counts with its weight. Weights go up the trie once."""
    total = np.zeros(n)
    carried = [np.zeros(len(x[0])) for x in levels]
    for depth in range(len(levels), 0, -1):
        last, length, before, done, node = levels[depth - 1]
        own = carried[depth - 1]
        np.add.at(own, node, weights[done])
        known = last >= 0
        np.add.at(total, last[known], own[known])
        for k in np.unique(length):
            if k < depth:
                at = np.flatnonzero(length == k)
                np.add.at(carried[depth - 1 - k], before[at], own[at])
    return total


def along(word: bytes, pieces: Pieces) -> tuple[int, float, list[int]]:
    """(tokens, score, pieces) of the best segmentation of one long word, in time linear in its length."""
    scores, unknown, sizes = pieces.scores.tolist(), pieces.unknown, [len(x) for x in pieces.bytes]
    best, count, last = [0.0] * (len(word) + 1), [0] * (len(word) + 1), [-1] * (len(word) + 1)
    found, at = pieces.within(word), 0
    item = next(found, None)
    for end in range(1, len(word) + 1):
        top, n, piece = best[end - 1] + unknown, count[end - 1] + 1, -1
        while item is not None and item[0] == end - 1:
            k = item[1]
            at = end - sizes[k]
            now, m = best[at] + scores[k], count[at] + 1
            if sizes[k] == 1 and piece < 0 or now > top or now == top and m < n:
                top, n, piece = now, m, k
            item = next(found, None)
        best[end], count[end], last[end] = top, n, piece
    used, end = [], len(word)
    while end:
        if last[end] >= 0:
            used.append(last[end])
        end -= sizes[last[end]] if last[end] >= 0 else 1
    return count[-1], best[-1], used


def count_block(docs: list[bytes], pieces: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, tokens and log probability of each text, and the uses of each piece in all."""
    raw = b" " + b" ".join([*docs, b""]).translate(BLANKS)
    blob = np.frombuffer(raw, np.uint8)
    cuts = 1 + np.cumsum([0, *(len(d) + 1 for d in docs)])
    starts, ends = word_spans(blob, IN_WORD)
    starts = starts - 1
    doc = np.searchsorted(cuts, starts + 1, "right") - 1
    rolling = Rolling(blob)
    _, first, inverse, often = np.unique(rolling.spans(starts, ends), return_index=True, return_inverse=True, return_counts=True)
    size = ends[first] - starts[first]
    tokens, scores = np.zeros(len(first), np.int64), np.zeros(len(first))
    short = np.flatnonzero(size <= LONG)
    tokens[short], scores[short], levels = forward(rolling, starts[first[short]], ends[first[short]], pieces)
    used = uses(levels, often[short].astype(np.float64), len(pieces.scores))
    for k in np.flatnonzero(size > LONG).tolist():
        tokens[k], scores[k], own = along(raw[starts[first[k]] : ends[first[k]]], pieces)
        np.add.at(used, own, often[k])
    n = len(docs)
    return np.bincount(doc, minlength=n), np.bincount(doc, tokens[inverse], n).astype(np.int64), np.bincount(doc, scores[inverse], n), used


def _model(path: str, scores: np.ndarray | None) -> Pieces:
    """The pieces of a vocabulary, read once a worker, with the given scores or those to start with."""
    if path not in _models:
        known = pieces_of(path)
        _models[path] = Pieces(known, rank_scores(len(known)))
    _models[path].score(rank_scores(len(_models[path].bytes)) if scores is None else scores)
    return _models[path]


def _uses(path: str, scores: np.ndarray | None):
    schema = pa.schema([("piece", pa.int64()), ("n", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path, scores)
        total = np.zeros(len(model.scores))
        for batch in it:
            docs = texts(batch.column(0))
            for a, b in slices([len(x) for x in docs], BLOCK):
                total += count_block(docs[a:b], model)[3]
        at = np.flatnonzero(total)
        yield batches({"piece": at, "n": total[at].astype(np.int64)}, schema)

    return run, "piece long, n long"


def train_unigram(docs: DataFrame, vocabulary: str, rounds: int) -> np.ndarray | None:
    """Scores of a vocabulary's pieces, estimated in so many rounds over all documents; None without a round.

    A round sums the uses of each piece by the best segmentations so far: one row for each piece used reaches the driver,
    no more than the vocabulary has.
    """
    scores = None
    for _ in range(rounds):
        fn, kind = _uses(vocabulary, scores)
        found = docs.select("text").mapInArrow(fn, kind).groupBy("piece").agg(F.sum("n").alias("n")).collect()
        counts = np.zeros(len(pieces_of(vocabulary)))
        for r in found:
            counts[r.piece] = r.n
        scores = estimated(counts)
    return scores


def _counts(path: str, scores: np.ndarray | None):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64()), ("log_prob", pa.float64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path, scores)
        for batch in it:
            docs = texts(batch.column(1))
            for a, b in slices([len(x) for x in docs], BLOCK):
                words, tokens, score, _ = count_block(docs[a:b], model)
                yield batches({"doc_id": batch.column(0).slice(a, b - a).cast(pa.int64()), "n_words": words, "n_tokens": tokens, "log_prob": score}, schema)

    return run, "doc_id long, n_words long, n_tokens long, log_prob double"


def count_tokens(spark: SparkSession, docs: DataFrame, vocabulary: str | None = None, rounds: int = 1) -> DataFrame:
    """One row for each row: doc_id, n_words, n_tokens, log_prob of the best segmentation of all words of the whole text.

    A pre-token is a run of bytes that aren't ASCII white space, with a blank before it. A null or empty text has none.
    Repeated rows and null ids are counted like others. Other columns are ignored; an empty table gives no rows. Scores
    are estimated in ``rounds`` passes over all documents, from scores by rank.
    """
    path = vocabulary or default_vocabulary()
    fn, kind = _counts(path, train_unigram(docs, path, rounds))
    return docs.select("doc_id", "text").mapInArrow(fn, kind)
