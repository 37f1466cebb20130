"""Quality rules: a linear-chain conditional random field labels lines.

Every line gets features of its bytes and words; a chain over the lines of a
text with the labels boilerplate (0) and content (1) is decoded by Viterbi.  A
text is kept if content lines hold enough of its words.

The field is trained on a bounded sample of documents with a quality label:
their lines start with the document's label, a first field without transitions
then moves lines of poor documents that look like content to content, and the
chain is fitted to these labels by gradient ascent on its log-likelihood.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.text import int64, map_texts

# Byte classes.
_LOWER, _UPPER, _DIGIT, _SPACE, _SIGN, _BAR, _STOP, _BANG, _REST = range(9)
_CONT = 9  # continuation bytes of UTF-8: no character of their own


def _byte_classes() -> np.ndarray:
    table = np.full(256, _REST, dtype=np.int64)
    for cls, members in (
            (_LOWER, "abcdefghijklmnopqrstuvwxyz"), (_UPPER, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
            (_DIGIT, "0123456789"), (_SPACE, " \t\n\r\x0b\x0c"), (_SIGN, "#*$%&<>"),
            (_BAR, "|"), (_STOP, ".,;:?'\"-()"), (_BANG, "!")):
        table[[ord(c) for c in members]] = cls
    table[0x80:0xC0] = _CONT
    table[0xC0:] = _LOWER  # first byte of a multi-byte character: mostly letters
    return table


CLASS = _byte_classes()
FEATURES = ("bias", "log_words", "upper", "digit", "sign", "bar", "stop", "bang",
            "word_length", "ends_with_stop", "repeated_line", "repeated_words")


def _repeated(words: list[bytes]) -> np.ndarray:
    """Mask of the words inside a 3-word window that occurs twice or more."""
    n = len(words)
    mask = np.zeros(n + 3, dtype=bool)
    if n < 4:
        return mask[:n]
    ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
    x = np.fromiter(map(ids.__getitem__, words), dtype=np.int64, count=n)
    v = len(ids)
    pair = x[:-1] * v + x[1:]
    if v > 2_000_000:  # three ids would not fit into 64 bits
        pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    window = pair[:-1] * v + x[2:]
    order = np.argsort(window, kind="stable")
    same = window[order][1:] == window[order][:-1]
    hit = np.zeros(n - 2, dtype=bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    at = np.flatnonzero(hit)
    for k in range(3):
        mask[at + k] = True
    return mask[:n]


def line_table(text: str | None) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """Counts of the whole text, words of each line, features of each line."""
    raw = (text or "").encode()
    words = raw.split()
    lines = raw.split(b"\n")
    cls = CLASS[np.frombuffer(raw, dtype=np.uint8)]
    at_newline = np.frombuffer(raw, dtype=np.uint8) == 10
    line = np.cumsum(at_newline) - at_newline
    n = len(lines)
    count = np.bincount(line * 10 + cls, minlength=10 * n).reshape(n, 10)
    inked = cls != _SPACE
    begins = inked.copy()
    begins[1:] &= ~inked[:-1]
    per_line = np.bincount(line[begins], minlength=n)
    repeated = _repeated(words)
    word_line = line[begins]
    seen: set[bytes] = set()
    dup = np.zeros(n)
    ends = np.zeros(n)
    for i, (ln, k) in enumerate(zip(lines, per_line.tolist(), strict=True)):
        if k:
            dup[i] = ln in seen
            seen.add(ln)
            ends[i] = ln.rstrip()[-1:] in b".,;:?!"
    chars = count[:, :_CONT].sum(1) - count[:, _SPACE]
    ink = np.maximum(chars, 1)
    rep = np.bincount(word_line, weights=repeated, minlength=n) / np.maximum(per_line, 1)
    x = np.stack([np.ones(n), np.log1p(per_line) / 5,
                  *(np.minimum(1, scale * count[:, c] / ink) for c, scale in
                    ((_UPPER, 2), (_DIGIT, 4), (_SIGN, 4), (_BAR, 10), (_STOP, 5), (_BANG, 5))),
                  chars / np.maximum(per_line, 1) / 10, ends, dup, rep], axis=1)
    base = {"n_words": len(words), "word_chars": int(chars.sum()),
            "n_symbols": int(count[:, _SIGN].sum() + count[:, _BAR].sum()),
            "n_dup_lines": int(dup.sum()), "n_repeat_words": int(repeated.sum())}
    return base, per_line, x


@dataclass(frozen=True)
class LineField:
    """emission: score of content minus boilerplate by feature; transition[a, b]:
    score of label b on the line after one labelled a."""

    emission: np.ndarray
    transition: np.ndarray

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Viterbi: the most likely labels; ties go to content."""
        score = (x @ self.emission).tolist()
        (t00, t01), (t10, t11) = self.transition.tolist()
        a, b, back = 0.0, score[0], []
        for s in score[1:]:
            from0, from1 = a + t01 > b + t11, a + t00 > b + t10
            back.append((from1, from0))
            a, b = (a + t00 if from1 else b + t10), (a + t01 if from0 else b + t11) + s
        label = np.empty(len(score), dtype=np.int8)
        k = 1 if b >= a else 0
        label[-1] = k
        for i in range(len(back) - 1, -1, -1):
            k = 0 if back[i][k] else 1
            label[i] = k
        return label


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 500, l2: float = 1e-4) -> np.ndarray:
    w = np.zeros(x.shape[1])
    v = np.zeros_like(w)
    share = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (share * (y - p)) - l2 * w
        v = 0.9 * v + g
        w = w + 2 * v
    return w


def fit_line_field(texts: list[tuple[np.ndarray, int]], steps: int = 40,
                   l2: float = 1e-2) -> LineField | None:
    """The field for (features of the lines, quality label) of documents; None
    unless both labels occur."""
    if len({q for _, q in texts}) < 2:
        return None
    x = np.concatenate([f for f, _ in texts])
    y = np.concatenate([np.full(len(f), float(q)) for f, q in texts])
    first = _logistic(x, y)
    chains, at = [], 0
    for f, q in texts:
        chains.append((f, (x[at:at + len(f)] @ first > 0) if not q else np.ones(len(f), bool)))
        at += len(f)
    n, longest = len(chains), max(len(f) for f, _ in chains)
    feats = np.zeros((n, longest, x.shape[1]))
    gold = np.zeros((n, longest), dtype=np.int64)
    real = np.zeros((n, longest), dtype=bool)
    for i, (f, lab) in enumerate(chains):
        feats[i, :len(f)], gold[i, :len(f)], real[i, :len(f)] = f, lab, True
    both = real[:, 1:] & real[:, :-1]
    gold_pairs = np.zeros((2, 2))
    np.add.at(gold_pairs, (gold[:, :-1][both], gold[:, 1:][both]), 1)
    w, t = first.copy(), np.zeros((2, 2))
    mw = vw = np.zeros_like(w)
    mt = vt = np.zeros_like(t)
    for step in range(1, steps + 1):
        s = feats @ w
        emit = np.stack([np.zeros_like(s), s], axis=2)
        fwd, bwd = np.zeros_like(emit), np.zeros_like(emit)
        fwd[:, 0] = emit[:, 0]
        for i in range(1, longest):  # log-space forward and backward sums, all chains at once
            nxt = np.logaddexp(fwd[:, i - 1, 0, None] + t[0], fwd[:, i - 1, 1, None] + t[1])
            fwd[:, i] = np.where(real[:, i, None], nxt + emit[:, i], fwd[:, i - 1])
        for i in range(longest - 2, -1, -1):
            a = bwd[:, i + 1] + emit[:, i + 1]
            nxt = np.logaddexp(a[:, 0, None] + t[:, 0], a[:, 1, None] + t[:, 1])
            bwd[:, i] = np.where(real[:, i + 1, None], nxt, 0)
        z = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
        p1 = np.exp(fwd[:, :, 1] + bwd[:, :, 1] - z[:, None]) * real
        grad_w = np.einsum("nt,ntf->f", (gold - p1) * real, feats) / n - l2 * w
        pair = (fwd[:, :-1, :, None] + t[None, None] + (emit + bwd)[:, 1:, None, :]
                - z[:, None, None, None])
        grad_t = (gold_pairs - (np.exp(np.minimum(pair, 0)) * both[..., None, None]).sum((0, 1))
                  ) / n - l2 * t
        mw, vw = 0.9 * mw + 0.1 * grad_w, 0.99 * vw + 0.01 * grad_w**2
        mt, vt = 0.9 * mt + 0.1 * grad_t, 0.99 * vt + 0.01 * grad_t**2
        rate, fix = 0.1 / (1 - 0.9**step), 1 - 0.99**step
        w = w + rate * mw / (np.sqrt(vw / fix) + 1e-8)
        t = t + rate * mt / (np.sqrt(vt / fix) + 1e-8)
    return LineField(w, t)


def training_lines(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id",
                   text_col: str = "text", quality_col: str = "quality",
                   sample_docs: int = 1500, sample_lines: int = 128
                   ) -> list[tuple[np.ndarray, int]]:
    """Line features of a bounded sample: the first ``sample_lines`` lines of
    ``sample_docs`` labelled documents at most, in the order of a hash of the id.
    Only ids are sampled before the texts are read; the broadcast side has
    ``sample_docs`` rows at most.  Of rows with one id, however many, the one
    with the least features counts."""
    key = docs.select(F.col(id_col).alias("_id"))
    chosen = (labels.select(F.col(id_col).alias("_id"), F.col(quality_col).alias("_q"))
              .dropna().groupBy("_id").agg(F.max("_q").alias("_q"))
              .join(key, "_id", "left_semi")
              .orderBy(F.xxhash64("_id"), "_id").limit(sample_docs))
    width = len(FEATURES)

    def make():
        def f(texts):
            rows = [line_table(t)[2][:sample_lines].ravel() for t in texts]
            return [pa.array(rows, pa.list_(pa.float64()))]
        return f

    picked = (docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
              .join(F.broadcast(chosen), "_id"))
    tables = map_texts(picked, [F.col("_id"), F.col("_q")], F.col("_t"), make, "x array<double>")
    got = (tables.groupBy("_id", "_q").agg(F.min("x").alias("x")).toPandas()
           .sort_values("_id", kind="stable"))
    return [(np.asarray(x, dtype=float).reshape(-1, width), int(q > 0))
            for x, q in zip(got["x"], got["_q"], strict=True)]


def line_quality(docs: DataFrame, carry: list[Column], text: Column, field: LineField | None,
                 content_share: float = 0.5, min_words: int = 50,
                 max_repeat_percent: int = 50) -> DataFrame:
    """``carry`` columns; ``n_words``, ``word_chars``, ``n_symbols``,
    ``n_dup_lines``, ``n_repeat_words``; ``base_failed`` (too few words, or too
    many of them in repeated 3-word windows); ``kept``; ``n_lines``,
    ``content_lines`` and ``content_words`` of lines labelled content.

    ``kept``: not ``base_failed``, and content lines hold ``content_share`` of
    the words or more.  Without a field every line is content.  A null or empty
    text has one line without words: base_failed, not kept.  Very long texts are
    read whole.  Repeated rows give a row each; nothing is shuffled.
    """
    def make():
        def f(texts):
            cols: dict[str, list] = {k: [] for k in (
                "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                "base_failed", "kept", "n_lines", "content_lines", "content_words")}
            for t in texts:
                base, words, x = line_table(t)
                label = field.decode(x) if field else np.ones(len(x), dtype=np.int8)
                content = int(words[label == 1].sum())
                n = base["n_words"]
                failed = n < min_words or 100 * base["n_repeat_words"] > max_repeat_percent * n
                base |= {"base_failed": failed, "n_lines": len(x),
                         "kept": not failed and content >= content_share * n,
                         "content_lines": int(label.sum()), "content_words": content}
                for k, v in base.items():
                    cols[k].append(v)
            return [pa.array(v, pa.bool_()) if k in ("base_failed", "kept") else int64(v)
                    for k, v in cols.items()]
        return f

    return map_texts(docs, carry, F.coalesce(text, F.lit("")), make,
                     "n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                     "n_repeat_words long, base_failed boolean, kept boolean, n_lines long, "
                     "content_lines long, content_words long")
