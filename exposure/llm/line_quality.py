"""Line sequence labelling: a linear-chain CRF marks each line as content or boilerplate, and the share of content words decides.

A line is a \\n-split line with a word ([^\\x20\\x09-\\x0D]+). Its features are the bits of one small number (FEATURES). The field is trained on a
bounded sample of labelled documents: ``max_train_docs`` of them, those with the smallest hash of the id. Labels are of documents, so lines of bad
documents are first labelled by emissions alone (a line of a bad document may well be content) and the whole field is then trained on that labelling.

Defined cases: a null or empty text has no words, fails the base rules and is not kept; each row gives one row, repeated rows and null ids too; without
any labelled document all weights are 0 and every line is content; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exposure.llm.common import id_and_text, kind_of, one_row_each, slices, where_text

SPACE, SYMBOLS, CAPITALS = b" \t\n\x0b\x0c\r", b"#*$%&|<>", bytes(range(65, 91))
FEATURES = ("bias", "some symbols", "many symbols", "all capitals", "mostly capitals", "shouted", "earlier line", "repeated words", "short", "long", "no final mark", "long words")
BOILERPLATE, CONTENT = 0, 1


@dataclass(frozen=True)
class Field:
    """Weights of the features for the two labels, and of label pairs."""

    emit: np.ndarray  # [features, 2]
    move: np.ndarray  # [2, 2]


def text_counts(text: str) -> tuple[int, int, int, int, int, list[int], list[int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; for each line with a word its features and its number of words."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    word_chars = len(text) - (len(raw) - len(raw.translate(None, SPACE)))
    n_symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    covered = repeated(words)
    seen, codes, sizes, n_dup, at = set(), [], [], 0, 0
    total = np.concatenate(([0], np.cumsum(covered)))
    for line in lines:
        n = len(line.split())
        dup = line in seen
        seen.add(line)
        n_dup += dup
        symbols = len(line) - len(line.translate(None, SYMBOLS))
        capitals = len(line) - len(line.translate(None, CAPITALS))
        bits = (
            True, symbols * 10 > n, symbols * 3 > n, line.isupper(), capitals * 2 > len(line), line.count(b"!") * 5 > n and n > 2, dup,
            2 * int(total[at + n] - total[at]) > n, n < 3, n > 40, line.rstrip()[-1:] not in b".!?:", len(line) > 14 * n)
        codes.append(sum(1 << i for i, b in enumerate(bits) if b))
        sizes.append(n)
        at += n
    return len(words), word_chars, n_symbols, n_dup, int(covered.sum()), codes, sizes


def repeated(words: list[bytes]) -> np.ndarray:
    """Whether each word stands in a 3-word window that is found twice or more."""
    out = np.zeros(len(words), bool)
    if len(words) < 4:
        return out
    number: dict[bytes, int] = {}
    w = np.array([number.setdefault(x, len(number)) for x in words], np.int64)
    pair = w[:-1] * len(number) + w[1:]
    if len(number) > 2_000_000:  # the triple would not fit 64 bits
        pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    triple = pair[:-1] * len(number) + w[2:]
    _, which, count = np.unique(triple, return_inverse=True, return_counts=True)
    at = np.flatnonzero(count[which] > 1)
    for k in range(3):
        out[at + k] = True
    return out


def bits_of(codes: np.ndarray) -> np.ndarray:
    return (codes[..., None] >> np.arange(len(FEATURES)) & 1).astype(np.float64)


def viterbi(codes: list[int], emit: list[tuple[float, float]], move: list[list[float]]) -> list[int]:
    """The best labels of a sequence; ties are content. ``emit``: the two scores of each feature code."""
    if not codes:
        return []
    (m00, m01), (m10, m11) = move
    b, c = emit[codes[0]]
    back = []
    for code in codes[1:]:
        eb, ec = emit[code]
        bb, cb, bc, cc = b + m00, c + m10, b + m01, c + m11
        back.append((0 if bb > cb else 1, 0 if bc > cc else 1))
        b, c = (bb if bb > cb else cb) + eb, (bc if bc > cc else cc) + ec
    label = 0 if b > c else 1
    labels = [label]
    for step in reversed(back):
        label = step[label]
        labels.append(label)
    return labels[::-1]


def emissions(field: Field) -> list[tuple[float, float]]:
    """The two scores of every feature code there can be."""
    return [tuple(x) for x in (bits_of(np.arange(1 << len(FEATURES))) @ field.emit).tolist()]


def _segments(sequences: list[list[int]], labels: list[list[int]], size: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences cut into rows of ``size`` for training, with a mask."""
    rows = [(c[i : i + size], y[i : i + size]) for c, y in zip(sequences, labels) for i in range(0, len(c), size)]
    codes, ys, mask = (np.zeros((len(rows), size), t) for t in (np.int64, np.int64, bool))
    for i, (c, y) in enumerate(rows):
        codes[i, : len(c)], ys[i, : len(c)], mask[i, : len(c)] = c, y, True
    return codes, ys, mask


def train(sequences: list[list[int]], good: list[bool], rounds: int = 30, decay: float = 0.02) -> Field:
    """Maximum likelihood with a small penalty; the same result for the same rows."""
    n = len(FEATURES)
    field = Field(np.zeros((n, 2)), np.zeros((2, 2)))
    pairs = sorted((list(s), bool(g)) for s, g in zip(sequences, good) if s)
    if not pairs or len({g for _, g in pairs}) < 2:
        return field
    sequences = [s for s, _ in pairs]
    labels = [[CONTENT if g else BOILERPLATE] * len(s) for s, g in pairs]
    for chain in (False, True):
        codes, ys, mask = _segments(sequences, labels)
        onehot, bits = np.eye(2)[ys] * mask[..., None], bits_of(np.arange(1 << n))
        of_features = lambda p, at=codes.ravel(), bits=bits: bits.T @ np.stack([np.bincount(at, p[..., k].ravel(), len(bits)) for k in (0, 1)], 1)
        seen = of_features(onehot)
        both = mask[:, 1:, None, None] * (onehot[:, :-1, :, None] * onehot[:, 1:, None, :])
        seen_moves, lines = both.sum((0, 1)), mask.sum()
        emit, move, square_e, square_m = field.emit.copy(), field.move.copy(), np.full((n, 2), 1e-6), np.full((2, 2), 1e-6)
        for _ in range(rounds):
            p, pp = _expected((bits @ emit)[codes], move, mask)
            g_emit = (seen - of_features(p)) / lines - decay * emit / n
            g_move = ((seen_moves - pp) / lines - decay * move) if chain else np.zeros((2, 2))
            square_e, square_m = square_e + g_emit**2, square_m + g_move**2
            emit, move = emit + 0.5 * g_emit / np.sqrt(square_e), move + 0.5 * g_move / np.sqrt(square_m)
        field = Field(emit, move)
        table, moves = emissions(field), field.move.tolist()
        labels = [[CONTENT] * len(s) if g else viterbi(s, table, moves) for s, g in pairs]
    return field


def _expected(scores: np.ndarray, move: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over all rows at once: label probabilities, and the sum of pair probabilities."""
    rows, size, _ = scores.shape
    m, fore, aft = np.exp(move), np.zeros((rows, size, 2)), np.ones((rows, size, 2))
    e = np.where(mask[..., None], np.exp(scores - scores.max(2, keepdims=True)), 1.0)
    fore[:, 0] = e[:, 0]
    for t in range(1, size):  # a masked place keeps the state
        fore[:, t] = np.where(mask[:, t, None], fore[:, t - 1] @ m, fore[:, t - 1]) * e[:, t]
        fore[:, t] /= fore[:, t].sum(1, keepdims=True)
    for t in range(size - 2, -1, -1):
        after = e[:, t + 1] * aft[:, t + 1]
        aft[:, t] = np.where(mask[:, t + 1, None], after @ m.T, after)
        aft[:, t] /= aft[:, t].sum(1, keepdims=True)
    p = fore * aft
    p = p / p.sum(2, keepdims=True) * mask[..., None]
    after = e[:, 1:] * aft[:, 1:]
    total = ((fore[:, :-1] @ m) * after).sum(2)
    weight = np.where(mask[:, 1:] & (total > 0), 1 / np.where(total > 0, total, 1), 0)
    return p, m * np.einsum("rtj,rtk->jk", fore[:, :-1] * weight[..., None], after)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train_docs: int = 2_000) -> Field:
    """Train on at most ``max_train_docs`` labelled documents, with one text each; only their feature numbers reach the driver."""
    chosen = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("good")).dropna().groupBy("id").agg(F.max("good").alias("good")).orderBy(F.xxhash64("id"), "id").limit(max_train_docs)

    def run(batches):
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([text_counts(t)[5] for t in b.column(1).to_pylist()], pa.list_(pa.int32())), b.column(0)], ["codes", "good"])

    rows = one_row_each(docs, chosen, id_col, text_col).select("good", "text").mapInArrow(run, "codes array<int>, good int").collect()
    return train([r.codes for r in rows], [r.good == 1 for r in rows])


def verdict(text: str, table: list[tuple[float, float]], move: list[list[float]], min_content: float, min_words: int, max_repeat_percent: int) -> tuple:
    """The columns NAMES of one text."""
    n_words, word_chars, n_symbols, n_dup, n_repeat, codes, sizes = text_counts(text)
    labels = viterbi(codes, table, move)
    share = sum(n for n, y in zip(sizes, labels) if y == CONTENT) / n_words if n_words else 0.0
    failed = n_words < min_words or 100 * n_repeat > max_repeat_percent * n_words
    return n_words, word_chars, n_symbols, n_dup, n_repeat, failed, not failed and share >= min_content, share, "".join("bc"[y] for y in labels)


def good(docs: DataFrame, field: Field, text_col: str = "text", min_content: float = 0.5, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    table, move = emissions(field), field.move.tolist()
    return where_text(docs, text_col, lambda texts: [verdict(t, table, move, min_content, min_words, max_repeat_percent)[NAMES.index("kept")] for t in texts])


def judge(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", min_content: float = 0.5, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """Counts, ``base_failed``, ``content_share`` (of words), ``line_labels`` (one letter for each line with a word, c or b) and ``kept``."""
    table, move = emissions(field), field.move.tolist()

    def run(batches):
        for b in slices(batches):
            out = [verdict(t, table, move, min_content, min_words, max_repeat_percent) for t in b.column(1).to_pylist()]
            columns = [pa.array(c, t) for c, t in zip(zip(*out), TYPES)] if out else [pa.array([], t) for t in TYPES]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], [id_col, *NAMES])

    schema = f"`{id_col}` {kind_of(docs, id_col)}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, content_share double, line_labels string"
    return id_and_text(docs, id_col, text_col).mapInArrow(run, schema)


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share", "line_labels"]
TYPES = [pa.int64()] * 5 + [pa.bool_(), pa.bool_(), pa.float64(), pa.string()]
