"""SentencePiece BPE encoding by a table of prefixes, and decoding.

Every prefix of a text has one BPE encoding, so its last token is unique.  The table stores that token for each prefix: an
automaton gives the tokens that end at a position; the right one is the one that can stand after the last token of the
prefix before it, which holds if merging the two tokens' text anew gives back the same two tokens (a pair-compatibility
test, kept in a table).  The ids are then read from the end backwards.  The work is linear in the text.

A text is first cut where no merge can reach: before each run of the space mark (no piece holds the mark after another
character) and around characters outside the vocabulary, which become their UTF-8 bytes.  Encodings of short segments are
kept per worker up to a fixed number.

Defined cases: a null or empty text has the end id only and decodes to the empty text; an empty table gives no rows; rows
are encoded one by one; a null ``doc_id`` is carried through; further columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireframe.llm import bytesops as B

MARK = "▁"
#: Segments up to this length are kept, so many of them and so many pair tests.
KEPT_LENGTH, KEPT_SEGMENTS, KEPT_PAIRS = 40, 300_000, 600_000
#: A character that no UTF-8 text holds: where segments are cut.
CUT = "\ud800"
SEGMENT = re.compile(f"{MARK}*[^{MARK}\\n]+|{MARK}+|\\n")


class Encoder(dict):
    """A mapping from segments to the bytes of their ids (int32), which fills itself."""

    def __init__(self, model: str) -> None:
        import ahocorasick
        import sentencepiece

        super().__init__()
        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        sp, n = self.library, self.library.vocab_size()
        self.size = n
        self.end = sp.eos_id()
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.piece = {i: sp.id_to_piece(i) for i in normal}
        self.id = {p: i for i, p in self.piece.items()}
        self.rank = {p: -sp.get_score(i) for p, i in self.id.items()}
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.chars = frozenset(p for p in self.id if len(p) == 1)
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id.items():
            self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        self.joined = frozenset(pair for p in self.id for pair in zip(p, p[1:]))
        self.fits: dict[int, bool] = {}
        self.parts: dict[str, list[int]] = {}

    def merged(self, text: str) -> list[str]:
        """BPE by its definition: the best-ranked, leftmost pair is merged until none is a piece.  For the short texts of pair tests."""
        s = list(text)
        while len(s) > 1:
            best = min((self.rank.get(a + b, np.inf), i) for i, (a, b) in enumerate(zip(s, s[1:])))
            if best[0] == np.inf:
                break
            s[best[1] : best[1] + 2] = [s[best[1]] + s[best[1] + 1]]
        return s

    def compatible(self, before: int, token: int) -> bool:
        """Can ``token`` stand right after ``before`` (or at the start: -1)?"""
        key = before * self.size + token
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) >= KEPT_PAIRS:
                self.fits.clear()
            want = [self.piece[token]] if before < 0 else [self.piece[before], self.piece[token]]
            known = self.fits[key] = self.merged("".join(want)) == want
        return known

    def known_ids(self, part: str) -> list[int]:
        """Ids of a part whose characters are all in the vocabulary."""
        n = len(part)
        last, begin = [-1] * (n + 1), [0] * (n + 1)
        compatible, known_fit, size = self.compatible, self.fits.get, self.size
        for stop, (length, token) in self.automaton.iter(part):
            stop += 1
            if last[stop] >= 0:
                continue
            start = stop - length
            before = last[start]
            if start and before < 0:
                continue
            known = known_fit(before * size + token)
            if compatible(before, token) if known is None else known:
                last[stop], begin[stop] = token, start
        out = []
        while n:
            if last[n] < 0:
                raise ValueError(f"no encoding of a prefix of {part!r}")
            out.append(last[n])
            n = begin[n]
        return out[::-1]

    def segment_ids(self, segment: str) -> list[int]:
        """Ids of any segment: cut between characters that no piece holds side by side, where no merge can reach."""
        cuts = [i for i, pair in enumerate(zip(segment, segment[1:]), 1) if pair not in self.joined]
        out: list[int] = []
        for a, b in zip([0, *cuts], [*cuts, len(segment)]):
            part = segment[a:b]
            got = self.parts.get(part)
            if got is None:
                got = self.known_ids(part) if part[0] in self.chars else [self.byte[x] for x in part.encode()]
                if b - a <= KEPT_LENGTH:
                    if len(self.parts) >= KEPT_SEGMENTS:
                        self.parts.clear()
                    self.parts[part] = got
            out += got
        return out

    def __missing__(self, segment: str) -> bytes:
        got = array("i", self.segment_ids(segment)).tobytes()
        if len(segment) <= KEPT_LENGTH:
            if len(self) >= KEPT_SEGMENTS:
                self.clear()
            self[segment] = got
        return got

    def ids(self, text: str) -> np.ndarray:
        """All ids of a text, with the end id."""
        if not text:
            return np.array([self.end], np.int32)
        if "  " in text or text[0] == " " or MARK in text:
            parts = SEGMENT.findall(MARK + text.replace(" ", MARK))
        else:
            parts = (MARK + text.replace("\n", f"{CUT}\n{CUT}").replace(" ", CUT + MARK)).split(CUT)
            if "" in parts:
                parts = [p for p in parts if p]
        return np.frombuffer(b"".join(map(self.__getitem__, parts)) + np.int32(self.end).tobytes(), np.int32)

    def text(self, ids: list[int]) -> str:
        return self.library.decode(ids)


_encoders: dict[str, Encoder] = {}


def encoder(model: str) -> Encoder:
    if model not in _encoders:
        _encoders[model] = Encoder(model)
    return _encoders[model]


def encode(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids, decoded) of every row: ids with the end id, and the text that the ids decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model)
        for batch in batches:
            text = batch.column("text")
            for a, b in B.slices(text):
                ids = [e.ids(t or "") for t in text.slice(a, b - a).to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([x.size for x in ids])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids))), pa.array([e.text(x.tolist()) for x in ids], pa.string())],
                                                 names=["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
