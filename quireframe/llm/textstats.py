"""Document statistics from whole texts, shared by the quality operators.

Counts are exact: windows and lines are compared by 64-bit hashes of their bytes.  A null text counts as an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from quireframe.llm import bytesops as B

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "mean_word", "std_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "punct_share", "space_share",
            "line_words", "distinct_share", "stop_share", "entropy", "non_ascii_share", "long_word_share", "top_word_share", "adjacent_repeat_share", "same_end_share", "log_lines")
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
#: Frequent function words of the corpus languages (fixed values).
STOP_WORDS = ("the of and to in a is that for it as was with be by on not he his are this from or had an they which "
              "der die und das in den von zu mit sich des auf für ist im dem nicht ein eine als "
              "de la le et les des en un du une que est pour qui dans par plus pas au sur "
              "el los y se del las por con no su para es lo como").split()
WINDOW = 8


def _hash_of(word: bytes) -> int:
    b = np.frombuffer(word, np.uint8)
    s = B.prefix_hash(b, B.BYTE_HASH_LOWER)
    return int(B.span_hash(s, np.array([0]), np.array([b.size]))[0])


_stop = np.sort(np.array([_hash_of(w.encode()) for w in set(STOP_WORDS)], np.uint64))


def _repeats(key: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: does the same row hold it elsewhere; does the row hold it earlier."""
    again, earlier = np.zeros(key.size, bool), np.zeros(key.size, bool)
    if key.size > 1:
        k = B.mix(key ^ B.mix(row.astype(np.uint64) + np.uint64(77)))
        o = np.argsort(k, kind="stable")
        same = k[o[1:]] == k[o[:-1]]
        earlier[o[1:][same]] = True
        again[o[1:][same]] = True
        again[o[:-1][same]] = True
    return again, earlier


def measure(buf: np.ndarray, off: np.ndarray, features: bool = True) -> dict[str, np.ndarray]:
    """All of COUNTS and, if asked for, FEATURES for each row of one slice."""
    rows, w = off.size - 1, B.words(buf, off)
    n_words = np.diff(w.first)
    byte_first = off
    lead = (buf & 0xC0) != 0x80
    ink = ~B.WS[buf]
    word_chars = B.per_row(lead & ink, byte_first)
    n_symbols = B.per_row(SYMBOLS[buf], byte_first)
    s = B.prefix_hash(buf)
    h = B.span_hash(s, w.start, w.end)

    # lines: cut at \n, judged where they hold a word
    edge = np.zeros(buf.size + 1, bool)
    cut = np.flatnonzero(buf == 10)
    edge[off] = True
    edge[cut + 1] = True
    edge[buf.size] = True
    begin = np.flatnonzero(edge[:-1]) if buf.size else np.zeros(0, np.int64)
    stop = np.append(begin[1:], buf.size)
    if begin.size:
        last = buf[stop - 1] == 10
        stop = stop - last
    line_row = np.searchsorted(off, begin, "right") - 1
    held = np.searchsorted(w.start, stop) - np.searchsorted(w.start, begin)
    inked = held > 0
    lb, le, lr = begin[inked], stop[inked], line_row[inked]
    _, dup = _repeats(B.span_hash(s, lb, le), lr)
    n_dup_lines = np.bincount(lr[dup], minlength=rows)[:rows]

    # words inside 8-word windows found twice or more in the row
    n_repeat = np.zeros(rows, np.int64)
    if h.size >= WINDOW:
        full = w.row[WINDOW - 1 :] == w.row[: h.size - WINDOW + 1]
        at = np.flatnonzero(full)
        x = np.zeros(at.size, np.uint64)
        for i in range(WINDOW):
            x = x * np.uint64(0x9FB21C651E98DF25) + h[at + i]
        again, _ = _repeats(B.mix(x), w.row[at])
        step = np.zeros(h.size + 1, np.int64)
        np.add.at(step, at[again], 1)
        np.add.at(step, at[again] + WINDOW, -1)
        n_repeat = B.per_row(np.cumsum(step[:-1]) > 0, w.first)
    out = {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat}
    out = {k: v.astype(np.int64) for k, v in out.items()}
    if not features:
        return out

    chars = np.maximum(B.per_row(lead, byte_first), 1).astype(float)
    nw = np.maximum(n_words, 1).astype(float)
    length = (w.end - w.start).astype(float)
    total = np.bincount(w.row, weights=length, minlength=rows)[:rows]
    square = np.bincount(w.row, weights=length * length, minlength=rows)[:rows]
    mean = total / nw
    hl = B.span_hash(B.prefix_hash(buf, B.BYTE_HASH_LOWER), w.start, w.end)
    _, old = _repeats(hl, w.row)
    # the most frequent word of each row
    k = B.mix(hl ^ B.mix(w.row.astype(np.uint64)))
    o = np.argsort(k, kind="stable")
    top = np.zeros(rows)
    if o.size:
        runs = np.flatnonzero(np.append(True, k[o[1:]] != k[o[:-1]]))
        np.maximum.at(top, w.row[o[runs]], np.diff(np.append(runs, o.size)))
    stop_word = np.zeros(hl.size, bool)
    if hl.size:
        at = np.minimum(np.searchsorted(_stop, hl), _stop.size - 1)
        stop_word = _stop[at] == hl
    near = np.zeros(hl.size, bool)
    if hl.size > 1:
        near[1:] = (hl[1:] == hl[:-1]) & (w.row[1:] == w.row[:-1])
    row_of_byte = np.repeat(np.arange(rows), np.diff(off))
    low = B.LOWER[buf]
    hist = np.bincount(row_of_byte * 128 + (low & 127), minlength=rows * 128).reshape(rows, 128).astype(float)
    p = hist / np.maximum(hist.sum(1, keepdims=True), 1)
    entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(1)
    lines = np.bincount(lr, minlength=rows)[:rows]
    ends = np.zeros(rows, np.int64)
    if lb.size > 1:
        last_word = hl[np.searchsorted(w.start, le) - 1]
        same_end = (last_word[1:] == last_word[:-1]) & (lr[1:] == lr[:-1])
        ends = np.bincount(lr[1:][same_end], minlength=rows)[:rows]
    upper, digit = (buf >= 65) & (buf <= 90), (buf >= 48) & (buf <= 57)
    letter = upper | ((buf >= 97) & (buf <= 122)) | (buf >= 128)
    share = lambda mask: B.per_row(mask, byte_first) / chars
    out |= {
        "log_words": np.log1p(n_words), "mean_word": mean, "std_word": np.sqrt(np.maximum(square / nw - mean * mean, 0)), "symbol_share": n_symbols / chars,
        "dup_line_share": n_dup_lines / np.maximum(lines, 1), "repeat_share": n_repeat / nw, "upper_share": share(upper), "digit_share": share(digit),
        "punct_share": share(ink & ~letter & ~digit), "space_share": share(~ink), "line_words": np.log1p(nw / np.maximum(lines, 1)),
        "distinct_share": 1 - np.bincount(w.row[old], minlength=rows)[:rows] / nw, "stop_share": B.per_row(stop_word, w.first) / nw, "entropy": entropy,
        "non_ascii_share": share(lead & (buf >= 128)), "long_word_share": B.per_row(length > 20, w.first) / nw, "top_word_share": top / nw,
        "adjacent_repeat_share": B.per_row(near, w.first) / nw, "same_end_share": ends / np.maximum(lines, 1), "log_lines": np.log1p(lines),
    }
    return out


def stats_schema(keys: str, features: bool = True) -> str:
    return ", ".join([keys, *(f"{c} long" for c in COUNTS), *(f"{c} double" for c in FEATURES if features)])


def stats_batches(keys: list[str], features: bool = True):
    """A function for ``mapInArrow`` over (keys..., text): the keys with the statistics of each row."""
    names = [*COUNTS, *(FEATURES if features else ())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            for a, b in B.slices(text):
                got = measure(*B.buffers(text.slice(a, b - a)), features)
                cols = [batch.column(k).slice(a, b - a) for k in keys] + [pa.array(got[c], pa.int64() if c in COUNTS else pa.float64()) for c in names]
                yield pa.RecordBatch.from_arrays(cols, names=[*keys, *names])

    return run
