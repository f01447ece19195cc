"""Line-first quality rules: lines are judged one by one, failures are removed, and a document that
loses too much of its text is rejected.

A line with at least one word fails if it is

* symbolic or navigation: more than ``symbols`` of the characters ``#*$%&|<>`` for each word,
* shouted: more than half of its words (of two letters or more) are in capitals, for 3 words or more,
* stuttering: more than a third of its words equal the word before, for 6 words or more,
* emphatic: more than 3 of 10 words end in ``!!`` or ``??``,
* a label: fewer than 6 words that do not end in terminal punctuation (closing quotes and brackets may follow),
* boilerplate: it holds one of the phrases of ``BOILERPLATE``, or
* a repetition: equal to an earlier line of the document.

Lines without a word are kept and cost nothing. A document is rejected if the failed lines hold more
than ``loss`` of its words, or if it fails the base rules: fewer than 20 words, or more than 30 % of its
words inside 8-word windows found twice or more.

Null and empty texts have no words and are rejected; whole texts are judged, whatever their length.
Each row is judged by itself, so ties and repeated rows do not matter, and an empty table gives no rows.
:func:`cleaned` keeps every column of its input under its name and overwrites text and n_chars alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOLS, SPACE = "#*$%&|<>", " \t\n\x0b\x0c\r"
#: Fixed phrases, lower case.
BOILERPLATE = (
    "all rights reserved",
    "licensed under",
    "released under the",
    "terms of service",
    "terms of use",
    "privacy policy",
    "accept cookies",
    "we use cookies",
    "subscribe to our newsletter",
    "sign up for our newsletter",
    "click here",
    "powered by",
    "javascript is disabled",
    "enable javascript",
    "copyright ©",
    "lorem ipsum",
)
_BOILERPLATE = re.compile("|".join(map(re.escape, BOILERPLATE)))
_ENDS = re.compile(r"[.!?…。！？:;][\"'”’»)\]]*$")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_ODD = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) | 1 for k in range(8)], np.uint64)


def repeat_words(words: list, window: int = 8) -> int:
    """Words inside windows of ``window`` words that are found twice or more, the first included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    known: dict = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.uint64)
    mixed = (ids + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    sums = sum(mixed[k : k + n] * _ODD[k % 8] for k in range(window))
    ordered = np.sort(sums)
    if not (ordered[1:] == ordered[:-1]).any():  # equal windows have equal sums
        return 0
    rank = np.arange(n)
    order = np.argsort(sums, kind="stable")
    same = sums[order[1:]] == sums[order[:-1]]
    twice = np.zeros(n, bool)
    for group in np.split(order, np.flatnonzero(~same) + 1):  # windows of one sum, compared word by word
        if len(group) > 1:
            _, inverse, count = np.unique(ids[group[:, None] + np.arange(window)], axis=0, return_inverse=True, return_counts=True)
            twice[group] = count[inverse.ravel()] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, rank[twice], 1)
    np.add.at(edge, rank[twice] + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def line_fails(line: str, words: list[str], symbols: float = 0.1) -> bool:
    """Whether a line with words fails a rule of its own (repetition aside)."""
    n = len(words)
    if sum(map(line.count, SYMBOLS)) > symbols * n:
        return True
    if n < 6 and not _ENDS.search(line.rstrip(SPACE)):
        return True
    if n >= 3 and 2 * sum(len(w) > 1 and w.isupper() for w in words) > n:
        return True
    if n >= 6 and 3 * sum(map(eq, words, words[1:])) > n:
        return True
    if ("!!" in line or "??" in line) and 10 * sum("!!" in w[-3:] or "??" in w[-3:] for w in words) > 3 * n:
        return True
    return bool(_BOILERPLATE.search(line.lower()))


def judge(text: str | None, symbols: float = 0.1, loss: float = 0.3) -> tuple[dict, str]:
    """The figures and the verdict of one text, and the text without its failed lines."""
    text = text or ""
    seen: set[str] = set()
    words: list[str] = []
    kept, lost, dup = [], 0, 0
    for line in text.split("\n"):
        own = _WORD.findall(line)
        if own:
            words += own
            again = line in seen
            dup += again
            seen.add(line)
            if again or line_fails(line, own, symbols):
                lost += len(own)
                continue
        kept.append(line)
    n, repeats = len(words), repeat_words(words)
    failed = n < 20 or 100 * repeats > 30 * n
    figures = {
        "n_words": n,
        "word_chars": len(text) - sum(map(text.count, SPACE)),
        "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_dup_lines": dup,
        "n_repeat_words": repeats,
        "base_failed": failed,
        "kept": not failed and lost <= loss * n,
        "n_lost_words": lost,
    }
    return figures, "\n".join(kept)


FIGURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lost_words long"


def assessed(docs: DataFrame, symbols: float = 0.1, loss: float = 0.3) -> DataFrame:
    """doc_id and the figures and verdict of every row of ``docs`` (doc_id, text); no shuffle."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                own = [judge(t, symbols, loss)[0] for t in part.column(1).to_pylist()]
                columns = {k: [x[k] for x in own] for k in own[0]}
                kinds = {k: pa.bool_() if k in ("base_failed", "kept") else pa.int64() for k in columns}
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(v, kinds[k]) for k, v in columns.items())], ["doc_id", *columns])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, f"doc_id long, {FIGURES}")


def cleaned(docs: DataFrame, symbols: float = 0.1, loss: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that are kept, without their failed lines; all columns of ``docs``, no shuffle."""
    at = docs.columns.index("text")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                own = [judge(t, symbols, loss) for t in part.column(at).to_pylist()]
                keep = pa.array([x[0]["kept"] for x in own])
                new = part.set_column(at, part.schema.field(at), pa.array([x[1] for x in own], part.schema.field(at).type))
                yield new.filter(keep)

    out = docs.mapInArrow(texts, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
