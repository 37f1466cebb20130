"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts reach the tokenizer in slices of bounded bytes.  For a byte-level
vocabulary every text is cut at safe boundaries first: before a single space
between two characters that are no white space.  The pre-tokenizer starts a new
piece at exactly such a space whatever stands around it (a run of letters,
digits or signs takes at most one space, in front), and no added token holds
white space, so the counts of the pieces add up to the count of the text.
Pieces repeat, so a task keeps the counts of a bounded number of them.  Other
vocabularies get whole texts.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.text import int64, map_texts

SAFE_CUT = re.compile(r"(?<=\S)(?= \S)")
#: Pieces whose counts one worker remembers, and the longest of them in characters: longer
#: ones (texts without blanks) are forgotten after their slice.
REMEMBERED = 600_000
LONGEST = 64


def _cuts_are_safe(spec: dict) -> bool:
    pre = spec.get("pre_tokenizer") or {}
    plain = (pre.get("type") == "ByteLevel" and pre.get("use_regex")
             and not pre.get("add_prefix_space") and not spec.get("normalizer"))
    return bool(plain) and all(
        not (t["lstrip"] or t["rstrip"] or t["single_word"]) and not re.search(r"\s", t["content"])
        for t in spec.get("added_tokens", []))


class TextLengths:
    """Number of tokens of each of a list of texts, for one vocabulary file."""

    def __init__(self, path: str):
        self.known: dict[str, int | None] = {}
        if path.endswith(".model"):
            import sentencepiece
            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda xs: [len(e) for e in sp.encode(xs, num_threads=1)]
            self.cut = False
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has one task a core
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        self.encode = lambda xs: [
            len(e) for e in tok.encode_batch_fast(xs, add_special_tokens=False)]
        self.cut = _cuts_are_safe(spec)

    def _learn(self, pieces: set[str]) -> None:
        """Counts of the pieces not yet known, in one batch.  A piece that a cut
        next to it would damage (it is empty, or begins or ends with white
        space after its leading space) gets None."""
        new = list(pieces - self.known.keys())
        if len(self.known) + len(new) > REMEMBERED:
            self.known = {p: self.known[p] for p in pieces & self.known.keys()}
        bad = [p for p in new if len(p) < 2 or p[1].isspace() or p[-1].isspace()]
        self.known.update(dict.fromkeys(bad))
        good = [p for p in new if not (len(p) < 2 or p[1].isspace() or p[-1].isspace())]
        self.known.update(zip(good, self.encode(good), strict=True))

    def __call__(self, texts: list[str | None]) -> list[int]:
        if not self.cut:
            return self.encode([t or "" for t in texts])
        # In front of the first word stands no space: it goes into the plain list.
        split, first, pieces = [], [], set()
        for t in texts:
            parts = t.split(" ") if t else [""]
            first.append(parts[0])
            rest = [" " + p for p in parts[1:]]
            split.append(rest)
            pieces.update(rest)
        self._learn(pieces)
        heads = self.encode(first)
        out, known = [], self.known
        for t, head, n, rest in zip(texts, first, heads, split, strict=True):
            counts = [known[p] for p in rest]
            if None in counts or rest and (not head or head[-1].isspace()):
                n, counts = 0, self._at_cuts(t)
            out.append(n + sum(counts))
        for p in pieces:
            if len(p) > LONGEST:
                del known[p]
        return out

    def _at_cuts(self, text: str) -> list[int]:
        """The same for a text with runs of white space."""
        return self.encode(SAFE_CUT.split(text))


@lru_cache(maxsize=4)
def _lengths(path: str) -> TextLengths:
    return TextLengths(path)


def token_counts(docs: DataFrame, carry: list[Column], text: Column, vocabulary: str,
                 limit: int) -> DataFrame:
    """``carry`` columns, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit``
    (more than ``limit`` tokens) of every whole text.

    ``vocabulary`` is a file on every machine: tokenizers' ``.json`` or
    sentencepiece's ``.model``.  No special tokens are added; special strings in
    a text are handled as the library does by default.  Very long texts are read
    whole; what a worker remembers is bounded in pieces and in their length.  Null
    text counts as empty (0, 0, false); repeated rows give a row each; nothing is
    shuffled.
    """
    def make():
        lengths = _lengths(vocabulary)

        def count(texts: list[str | None]) -> list[pa.Array]:
            n = lengths(texts)
            return [int64([len(t.encode()) if t else 0 for t in texts]), int64(n),
                    pa.array([x > limit for x in n], pa.bool_())]

        return count

    return map_texts(docs, carry, F.coalesce(text, F.lit("")), make,
                     "n_bytes long, n_tokens long, over_limit boolean", limit=4 << 20)
