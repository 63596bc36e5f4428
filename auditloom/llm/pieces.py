"""SentencePiece encoding and decoding of merge-type (BPE) models with a prefix table.

For every prefix of a segment exactly one vocabulary piece can end its encoding. The table stores that piece: the
pieces that end at a position come from one automaton pass, and a piece is right if the pair of the last piece before it
and the piece itself would be left apart by the merge rules. The ids are then read off backwards from the end.

Segments are runs between word starts and line feeds, across which no piece reaches; each is encoded and decoded once
and remembered. Characters without a piece become their UTF-8 bytes' pieces.

Defined cases: a null text is empty and yields the end id alone; repeated rows give repeated results; literal word-start
marks in a text count as spaces, as in the library.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from auditloom.llm.common import Memo, byte_slices, texts

MARK = "▁"
SEGMENTS = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
PAIRS_KEPT = 1_000_000


class MergeCodec:
    """Encoder and decoder for a model whose pieces are merged in the order of their scores."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.end = model.eos_id()
        self.unknown = model.unk_id()
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(len(self.pieces)) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.silent = {i for i in range(len(self.pieces)) if model.is_control(i)}
        special = self.silent | set(self.byte_of) | {self.unknown}
        self.score = {p: model.get_score(i) for i, p in enumerate(self.pieces) if i not in special and not model.is_unused(i)}
        self.id_of = {p: i for i, p in enumerate(self.pieces) if p in self.score}
        self.unknown_text = " ⁇ "
        if model.normalize(" a\tb   ﬁ\n") != MARK + MARK + "a\tb" + MARK * 2 + " ﬁ\n":
            raise ValueError("the model normalises texts; only a leading mark and marks for spaces are handled")
        single = {c for p in self.id_of for c in p}
        if not single <= self.id_of.keys() or any(re.search(f"[^{MARK}]{MARK}|\n", p) for p in self.id_of):
            raise ValueError("pieces reach across word starts or line feeds, or lack a piece for a character")
        self.single = single
        self.plain = set(self.id_of.values())
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id_of.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.sound: dict[int, bool] = {}
        self.apart: dict[int, bool] = {}
        self.memo = Memo(lambda segments: [self._entry(s) for s in segments], limit=150_000)

    # -- merge rules --
    def _merged(self, text: str, border: int = -1) -> list[str] | None:
        """The merges of a short string; None as soon as one crosses ``border`` (a character position)."""
        parts, ends = list(text), list(range(1, len(text) + 1))
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                return parts
            if ends[at] == border:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            ends[at : at + 2] = [ends[at + 1]]

    def _is_sound(self, i: int) -> bool:
        """Whether the merge rules can produce piece ``i``."""
        known = self.sound.get(i)
        if known is None:
            known = self.sound[i] = len(self._merged(self.pieces[i])) == 1
        return known

    def _stay_apart(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self.apart.get(key)
        if known is None:
            if len(self.apart) >= PAIRS_KEPT:
                self.apart.clear()
            a = self.pieces[left]
            known = self.apart[key] = self._merged(a + self.pieces[right], len(a)) is not None
        return known

    # -- encoding --
    def _run(self, text: str) -> list[int]:
        """Ids of a string of known characters."""
        last, size = [-1] * len(text), [0] * len(text)
        for end, (i, n) in self.automaton.iter(text):
            start = end - n
            if last[end] < 0 and (start < 0 or (last[start] >= 0 and self._stay_apart(last[start], i))) and self._is_sound(i):
                last[end], size[end] = i, n
        out, at = [], len(text) - 1
        while at >= 0:
            out.append(last[at])
            at -= size[at]
        return out[::-1]

    def encode_segment(self, segment: str) -> list[int]:
        out: list[int] = []
        start = 0
        for k, c in enumerate(segment):
            if c not in self.single:
                out += self._run(segment[start:k]) if k > start else []
                out += [self.bytes[b] for b in c.encode()] if self.bytes else [self.unknown]
                start = k + 1
        return out + (self._run(segment[start:]) if start < len(segment) else [])

    def segments(self, text: str) -> list[str]:
        return SEGMENTS.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text, without begin or end."""
        return [i for s in self.segments(text) for i in self.encode_segment(s)]

    # -- decoding --
    def decode(self, ids: list[int]) -> str:
        """Text of ids: bytes that form no character become U+FFFD, one mark at the very start is dropped."""
        text = self._decode(ids)
        first = next((i for i in ids if i not in self.silent), None)
        return text[1:] if first in self.plain and self.pieces[first].startswith(MARK) else text

    def _decode(self, ids: list[int]) -> str:
        out, raw = [], bytearray()
        for i in [*ids, None]:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(_utf8(bytes(raw)))
                raw.clear()
            if i is not None and i not in self.silent:
                out.append(self.unknown_text if i == self.unknown else self.pieces[i].replace(MARK, " "))
        return "".join(out)

    def _entry(self, segment: str) -> tuple[int, bytes, bytes, bool]:
        ids = self.encode_segment(segment)
        return len(ids), b"".join(b"%d " % i for i in ids), self._decode(ids).encode(), ids[0] not in self.byte_of

    def digests(self, bodies: list[str]) -> Iterator[tuple[int, str, str]]:
        """(ids with the end id, digest of the ids, digest of the decoded text) of each text."""
        for found in self.memo.lookup([self.segments(t) for t in bodies]):
            n = sum(x[0] for x in found) + 1
            ids = b"".join([x[1] for x in found]) + b"%d" % self.end
            text = b"".join([x[2] for x in found])
            if found and found[0][3] and text.startswith(b" "):
                text = text[1:]
            yield n, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest()


def _utf8(raw: bytes) -> str:
    """Valid characters, and U+FFFD for every byte that belongs to none."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[at : at + n].decode())
                    at += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


@functools.lru_cache(maxsize=2)
def codec(path: str) -> MergeCodec:
    """The codec of a worker."""
    return MergeCodec(path)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Per row: ``doc_id``, ``n_tokens`` with the end id, ``ids_sha256`` and ``decoded_sha256``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = codec(path)
        for batch in batches:
            bodies, rows = batch.column(1).to_pylist(), []
            for lo, hi in byte_slices(bodies):
                rows += model.digests(bodies[lo:hi])
            n, ids, text = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """Per row: ``doc_id``, ``ids`` (with the end id) and ``decoded``, the text that these ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = codec(path)
        for batch in batches:
            ids = [[*model.encode(t), model.end] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([model.decode(x) for x in ids], pa.string())],
                ["doc_id", "ids", "decoded"],
            )

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded string")
