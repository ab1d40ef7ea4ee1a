"""SentencePiece encoding and decoding by a merge-type prefix table.

For merge-type models a token sequence is the encoding of its text exactly if every two neighbours
are compatible, that is if encoding their joined strings gives the two back. So each prefix of a
text has one unique last token: of the vocabulary's matches that end there (an automaton gives them,
longest first) the one that is compatible with the last token of the prefix before it. The ids are
read backwards from the last prefix. No piece holds a word mark after another character, so text is
cut before runs of word marks, and the parts' encodings are kept in a bounded table.
"""

from __future__ import annotations

import re
import struct
from array import array
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Entries that a worker keeps of each table before it starts afresh.
KEEP = 400_000
_CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def _fields(buf: bytes):
    """(field number, value) of one protobuf message; floats as raw bytes."""
    at = 0

    def varint(at):
        value = shift = 0
        while True:
            b = buf[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value, at
            shift += 7

    while at < len(buf):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            n, at = varint(at)
            value, at = buf[at : at + n], at + n
        else:
            n = 8 if kind == 1 else 4
            value, at = buf[at : at + n], at + n
        yield tag >> 3, value


class Pieces:
    """A merge-type model file: encode and decode as its library does, without begin or end ids."""

    def __init__(self, path: str):
        import ahocorasick

        with open(path, "rb") as f:
            top = list(_fields(f.read()))
        self.piece: list[str] = []
        self.score: list[float] = []
        self.kind: list[int] = []
        for field, value in top:
            if field == 1:
                own = dict(_fields(value))
                self.piece.append(own[1].decode())
                self.score.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                self.kind.append(own.get(3, 1))
        trainer = dict(_fields(next(v for k, v in top if k == 2)))
        norm = dict(_fields(next(v for k, v in top if k == 3)))
        if trainer.get(3, 1) != 2 or norm.get(2) or not norm.get(3, 1) or norm.get(4, 1) or trainer.get(24, 0):
            raise ValueError("only merge-type models with identity normalisation and a dummy prefix are supported")
        if any(k not in (1, 2, 3, 6) for k in self.kind):
            raise ValueError("user-defined and unused pieces are not supported")
        self.unk = self.kind.index(2)
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(self.piece) if self.kind[i] == 6}
        self.id = {p: i for i, p in enumerate(self.piece) if self.kind[i] == 1}
        self.byte_of = {i: bytes([b]) for b, i in self.byte.items()}
        self.by_word = all(MARK not in p.lstrip(MARK) for p in self.id)
        self.by_line = all("\n" not in p for p in self.id)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()

    def merged(self, text: str) -> list[str]:
        """The merge loop itself, for short strings: best score first, then leftmost."""
        s = list(text)
        while len(s) > 1:
            best, at = None, -1
            for k in range(len(s) - 1):
                i = self.id.get(s[k] + s[k + 1])
                if i is not None and (best is None or self.score[i] > best):
                    best, at = self.score[i], k
            if best is None:
                break
            s[at : at + 2] = [s[at] + s[at + 1]]
        return s

    def compatible(self, a: int, b: int) -> bool:
        """Do a and b stay apart side by side? a is -1 at a text's start or after a character of no piece."""
        ok = self.pairs.get((a, b))
        if ok is None:
            if len(self.pairs) >= 2 * KEEP:
                self.pairs.clear()
            apart = [self.piece[b]] if a < 0 else [self.piece[a], self.piece[b]]
            ok = self.pairs[a, b] = self.merged("".join(apart)) == apart
        return ok

    def part(self, text: str) -> list[int]:
        """Ids of a text whose spaces are word marks already."""
        n = len(text)
        last = [-1] * n  # the prefix's last token; -1: the character is in no piece
        size = [1] * n
        done = -1
        known, compatible = self.pairs.get, self.compatible
        for end, (i, length) in self.automaton.iter(text):
            if end != done:
                start = end - length
                before = last[start] if start >= 0 else -1
                ok = known((before, i))
                if compatible(before, i) if ok is None else ok:
                    last[end] = i
                    size[end] = length
                    done = end
        out: list[int] = []
        at = n - 1
        while at >= 0:
            i = last[at]
            if i >= 0:
                out.append(i)
            else:
                out.extend(self.byte.get(b, self.unk) for b in reversed(text[at].encode("utf-8", "surrogatepass")))
            at -= size[at]
        out.reverse()
        return out

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        text = MARK + text.replace(" ", MARK)
        return list(chain.from_iterable(map(self.part, _CHUNK.findall(text)))) if self.by_word else self.part(text)

    def decode(self, ids) -> str:
        return self._text(ids, True)

    def _text(self, ids, start: bool) -> str:
        out, run = [], []
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                run.append(b)
                continue
            if run:
                out.append(_utf8(b"".join(run)))
                run = []
            kind = self.kind[i]
            out.append(self.piece[i] if kind == 1 else " ⁇ " if kind == 2 else "")
        if run:
            out.append(_utf8(b"".join(run)))
        text = "".join(out)
        if start and text[:1] == MARK and ids and self.kind[ids[0]] == 1:
            text = text[1:]
        return text.replace(MARK, " ")


def _utf8(raw: bytes) -> str:
    """Each byte that starts no valid character becomes one replacement character."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[at : at + n].decode())
                    break
                except UnicodeDecodeError:
                    continue
            else:
                n = 1
                out.append("�")
            at += n
        return "".join(out)


class _Table(dict):
    """part -> (ids as bytes, decoded), computed when first asked for; forgets all when full."""

    def __init__(self, model: Pieces, before: str):
        super().__init__()
        self.model, self.before = model, before

    def __missing__(self, word: str):
        m = self.model
        ids = m.part(self.before + word) if word or self.before else []
        value = array("i", ids).tobytes(), m._text(ids, False)
        if len(word) <= 64:
            if len(self) >= KEEP:
                self.clear()
            self[word] = value
        return value


_open: dict[str, tuple[Pieces, _Table, _Table]] = {}


def _tables(path: str) -> tuple[Pieces, _Table, _Table]:
    """One model for each worker process."""
    if path not in _open:
        m = Pieces(path)
        _open[path] = m, _Table(m, MARK), _Table(m, "")
    return _open[path]


def round_trip(text: str, path: str) -> tuple[np.ndarray, str]:
    """(ids, decoded) of a whole text, through the tables of parts."""
    m, marked, bare = _tables(path)
    if not text:
        return np.zeros(0, np.int32), ""
    text = text.replace(MARK, " ")
    if m.by_word and m.by_line:
        parts = []
        feed = m.byte.get(10, m.unk)
        line_end = array("i", [feed]).tobytes()
        for k, line in enumerate(text.split("\n")):
            if k:
                parts.append((line_end, "\n" if feed != m.unk else " ⁇ "))
            if "  " in line or line[-1:] == " " or not k and line[:1] == " ":
                found = _CHUNK.findall((MARK if not k else "") + line.replace(" ", MARK))
                parts += [bare[c] for c in found]
            elif k:
                first, *rest = line.split(" ")
                parts.append(bare[first])
                parts += map(marked.__getitem__, rest)
            else:
                parts += map(marked.__getitem__, line.split(" "))
        ids = np.frombuffer(b"".join([p[0] for p in parts]), np.int32)
        out = "".join([p[1] for p in parts])
        return ids, out[1:] if out[:1] == " " else out
    ids = m.encode(text)
    return np.array(ids, np.int32), m.decode(ids)


def encode_decode(docs: DataFrame, path: str, rows: int = 256) -> DataFrame:
    """documents -> (doc_id, ids array<int>, decoded string), one row per document.

    Null or empty texts have no ids and an empty decoded text; texts are never cut; repeated rows stay;
    an empty table gives an empty result; extra columns are ignored."""

    def go(batches):
        import pyarrow as pa

        for b in batches:
            for lo in range(0, b.num_rows, rows):
                part = b.slice(lo, rows)
                got = [round_trip(t.as_py() or "", path) for t in part.column(1)]
                ends = np.concatenate([[0], np.cumsum([len(i) for i, _ in got])]).astype(np.int32)
                ids = np.concatenate([i for i, _ in got]) if got else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(ends, ids), pa.array([d for _, d in got], pa.string())],
                    ["doc_id", "ids", "decoded"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        go, "doc_id long, ids array<int>, decoded string"
    )
