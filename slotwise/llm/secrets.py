"""Secret scan with a recursive decoding worklist.

Every text is scanned by the base patterns. Then encoded stretches are
unwrapped: percent and Unicode escapes, base64 (also wrapped into lines, with a
path or other base64 characters before it, or of UTF-16), and compressed bytes
inside base64 or inside compressed bytes. Each decoded layer is put on a
worklist, scanned again and unwrapped again until nothing new appears; a layer
that has been seen at its place is not entered again, so cycles end. Each layer
keeps, for every character, the stretch of the original text that it came from,
and a finding is reported with the original stretch.

Escapes that decode to escapes are unwrapped to their fixpoint in one pass over
a stack of characters, in linear time; a base64 run is decoded once in each of
its four alignments, and every readable stretch of the bytes is a layer. The
patterns are of ASCII characters, so other bytes only part stretches.
"""

from __future__ import annotations

import base64
import bz2
import lzma
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from slotwise.llm.common import documents
from slotwise.llm.spans import Span, digest, joined

KINDS = ("assign", "access", "hex", "opaque")
ASSIGN, ACCESS, HEX, OPAQUE = range(4)

#: Fixed patterns.
ASSIGNED = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS_KEY = re.compile(r"AKIA[A-Z0-9]{16,}")  # whole runs: a shorter run holds no longer one
HEX_RUN = re.compile(r"[0-9a-f]{24,}")

ESCAPE = re.compile(r"[%\\]")
HEX_DIGITS = frozenset("0123456789abcdefABCDEF")
NESTED = re.compile(r"%(?:25)+(?=[0-9A-Fa-f]{2})")  # a percent sign, escaped many times over
PLAIN = re.compile(r"%([0-9A-Fa-f]{2})")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]{4,})*")  # the shortest finding has 12 characters
ONE_ALPHABET = bytes.maketrans(b"-_", b"+/")
READABLE = re.compile(rb"[\t\n\r\x20-\x7e]{12,}")
WIDE = re.compile(rb"(?:[\t\n\r\x20-\x7e]\x00){12,}")  # UTF-16, in either order of bytes
#: First bytes of compressed data, and how many of them tell it apart anywhere.
PACKED = re.compile(rb"\x1f\x8b\x08|BZh[1-9]1AY&SY|\xfd7zXZ\x00|x[\x01\x5e\x9c\xda]")
PIECE = 4 * 2**20  # bytes of expanded data that are scanned together
OVERLAP = 2**18  # bytes that a piece shares with the one before
MOST = 2**31  # bytes that the layers of one text may expand to; what is beyond is reported as opaque
BYTE = 0x10FF00  # a byte over 127 from an escape, until those beside it are known


def scan(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each base kind, the failing ones dropped."""
    found = []
    if ":" in text or "=" in text:
        found += [(ASSIGN, m.start(), m.end()) for m in ASSIGNED.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(ACCESS, m.start(), m.end()) for m in ACCESS_KEY.finditer(text)]
    found += [(HEX, m.start(), m.end()) for m in HEX_RUN.finditer(text)]
    return found


class Layer:
    """A decoded text; character i came from original[start[i]:end[i]], and
    ``new`` marks the characters that decoding made."""

    def __init__(self, text: str, start: np.ndarray, end: np.ndarray, new: np.ndarray):
        self.text, self.start, self.end, self.new = text, start, end, new

    def findings(self) -> list[Span]:
        """One that lies wholly in characters which decoding left alone belongs
        to the layer above."""
        return [(k, int(self.start[a:b].min()), int(self.end[a:b].max())) for k, a, b in scan(self.text) if self.new[a:b].any()]


def _escape(tail: list[str]) -> tuple[int, int] | None:
    """Length and code of the escape that ends a list of characters."""
    n = len(tail)
    last = tail[-1]
    if last == "}":
        for k in range(5, min(n, 10) + 1):  # \\u{1} to \\u{10FFFF}
            if tail[-k] == "\\":
                digits = tail[-k + 3 : -1]
                if tail[-k + 1] == "u" and tail[-k + 2] == "{" and 1 <= len(digits) <= 6 and HEX_DIGITS.issuperset(digits):
                    return k, int("".join(digits), 16)
                return None
        return None
    if last not in HEX_DIGITS:
        return None
    if n >= 3 and tail[-3] == "%" and tail[-2] in HEX_DIGITS:
        b = int(tail[-2] + last, 16)
        return 3, b if b < 128 else BYTE + b
    if n >= 4 and tail[-4] == "\\" and tail[-3] == "x" and tail[-2] in HEX_DIGITS:
        return 4, int(tail[-2] + last, 16)
    if n >= 6 and tail[-6] == "\\" and tail[-5] == "u" and HEX_DIGITS.issuperset(tail[-4:-1]):
        return 6, int("".join(tail[-4:]), 16)
    return None


def unescaped(layer: Layer) -> Layer | None:
    """The layer with its percent and Unicode escapes unwrapped until none is
    left; None if it has none."""
    text, out, start, end, new = layer.text, [], [], [], []
    at, n, near, any_new = 0, len(text), 0, False
    while at < n:
        if not near:  # nothing open: the stretch up to the next sign stays as it is
            m = ESCAPE.search(text, at)
            stop = m.start() if m else n
            out.extend(text[at:stop])
            start.extend(range(at, stop))
            end.extend(range(at, stop))
            new.extend(bytes(stop - at))
            at = stop
            if at == n:
                break
        c, here, made = text[at], at, 0
        if c == "%":
            if m := NESTED.match(text, at):
                at, made = m.end() - 1, 1
            elif m := PLAIN.match(text, at):
                b, at, made = int(m[1], 16), at + 2, 1
                c = chr(b if b < 128 else BYTE + b)
        out.append(c)
        start.append(here)
        end.append(at)
        new.append(made)
        any_new |= bool(made)
        at += 1
        near = 10 if made or c in "%\\" else near - 1
        while near and (out[-1] in HEX_DIGITS or out[-1] == "}") and (found := _escape(out[-10:])):
            k, code = found
            a, b = start[-k], end[-1]
            del out[-k:], start[-k:], end[-k:], new[-k:]
            out.append(chr(code) if code < 0x110000 else "\ufffd")
            start.append(a)
            end.append(b)
            new.append(1)
            any_new, near = True, 10
    if not any_new:
        return None
    first, last = layer.start[np.array(start)], layer.end[np.array(end)]
    made = np.array(new, bool) | layer.new[np.array(start)]
    return Layer("".join(c if ord(c) < BYTE and not 0xD800 <= ord(c) < 0xE000 else "\ufffd" for c in out), first, last, made)


class Worklist:
    """The layers behind one text."""

    def __init__(self, text: str):
        self.found: list[Span] = []
        self.seen: set = set()
        self.left = MOST
        n = len(text)
        self.work = [Layer(text, np.arange(n), np.arange(1, n + 1), np.zeros(n, bool))]

    def add(self, layer: Layer | None) -> None:
        """Scan a layer and put it on the list, unless it has been seen there."""
        if layer is not None and layer.text:
            key = (hash(layer.text), len(layer.text), int(layer.start[0]), int(layer.end[-1]))
            if key not in self.seen:
                self.seen.add(key)
                self.found += layer.findings()
                self.work.append(layer)

    def run(self) -> list[Span]:
        while self.work:
            layer = self.work.pop()
            self.add(unescaped(layer) if "%" in layer.text or "\\" in layer.text else None)
            for m in BASE64.finditer(layer.text):
                self.base64(layer, m.start(), m[0])
        return self.found

    def base64(self, layer: Layer, at: int, run: str) -> None:
        """The readable and the compressed stretches of a run in each alignment."""
        data, place = run.encode("ascii").translate(ONE_ALPHABET, b" \t\r\n"), None
        for shift in range(4):
            part = data[shift:]
            part = part[: len(part) - (len(part) % 4 == 1)]
            raw = base64.b64decode(part + b"=" * (-len(part) % 4))
            if not (READABLE.search(raw) or WIDE.search(raw) or PACKED.search(raw)):
                continue
            if place is None:
                place = np.flatnonzero(np.frombuffer(run.encode("ascii"), np.uint8) > 32) + at
            # byte i comes from the characters that carry its bits
            i = np.arange(len(raw))
            left, right = layer.start[place[shift + i * 4 // 3]], layer.end[place[shift + np.minimum((i * 8 + 7) // 6, len(part) - 1)]]
            self.stretches(raw, left, right)
            done = -1
            for m in PACKED.finditer(raw):
                # two bytes are no proof: they count where a payload can begin
                begins = shift == 0 and m.start() == 0 or m.start() * 4 % 3 == 0 and self._after_sign(data, shift + m.start() * 4 // 3)
                if m.start() >= done and (len(m[0]) > 2 or begins):
                    done = m.start() + self.expanded(raw[m.start() :], int(left[m.start()]), right[m.start() :])

    @staticmethod
    def _after_sign(data: bytes, at: int) -> bool:
        return at > 0 and data[at - 1] in (43, 47)

    def stretches(self, raw: bytes, left: np.ndarray, right: np.ndarray) -> None:
        """The readable stretches of bytes, and those of UTF-16, as layers."""
        for m in READABLE.finditer(raw):
            a, b = m.span()
            self.add(Layer(m[0].decode("ascii"), left[a:b], right[a:b], np.broadcast_to(True, b - a)))
        for m in WIDE.finditer(raw):
            a, b = m.span()
            self.add(Layer(m[0][::2].decode("ascii"), left[a:b:2], right[a + 1 : b : 2], np.broadcast_to(True, (b - a) // 2)))

    def expanded(self, raw: bytes, start: int, ends: np.ndarray) -> int:
        """Scan what compressed bytes at the start of ``raw`` expand to, piece
        by piece; the bytes used. Bytes that aren't compressed give nothing."""
        held, used = b"", 2
        for piece, size, whole in _pieces(raw):
            self.left -= len(piece)
            if self.left < 0:
                self.found.append((OPAQUE, start, int(ends[-1])))
                return len(raw)
            both = held + piece
            self.bytes(both, start, int(ends[min(size, len(ends)) - 1]), first=not held)
            held, used = both[-OVERLAP:], size if whole else 2
        return used

    def bytes(self, raw: bytes, start: int, end: int, first: bool) -> None:
        """Expanded bytes: all come from one stretch of the text."""
        key = ("bytes", hash(raw), len(raw), start, end)
        if key in self.seen:
            return
        self.seen.add(key)
        at = np.broadcast_to(np.int64(start), len(raw)), np.broadcast_to(np.int64(end), len(raw))
        self.stretches(raw, *at)
        done = -1
        for m in PACKED.finditer(raw):
            if m.start() >= done and (len(m[0]) > 2 or first and m.start() == 0):
                done = m.start() + self.expanded(raw[m.start() :], start, at[1][m.start() :])


def _decoder(raw: bytes):
    if raw.startswith(b"\x1f\x8b"):
        return zlib.decompressobj(31)
    if raw.startswith(b"BZh"):
        return bz2.BZ2Decompressor()
    if raw.startswith(b"\xfd7zXZ"):
        return lzma.LZMADecompressor()
    return zlib.decompressobj()


def _pieces(raw: bytes) -> Iterator[tuple[bytes, int, bool]]:
    """What compressed bytes expand to, in pieces of bounded size, with the
    number of bytes used and whether the data ended there; broken data give
    what comes before the break."""
    d, rest, out, size = _decoder(raw), raw, [], 0
    in_turn = isinstance(d, (bz2.BZ2Decompressor, lzma.LZMADecompressor))  # these keep what they have not used yet
    more = True
    while more:
        try:
            got = d.decompress(rest, 2**20)
            rest = b"" if in_turn else d.unconsumed_tail
            more = not d.eof and (not d.needs_input if in_turn else bool(rest) or len(got) == 2**20)
        except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError):
            got, more = b"", False
        out.append(got)
        size += len(got)
        if size >= PIECE or size and not more:
            yield b"".join(out), len(raw) - len(d.unused_data), d.eof
            out, size = [], 0


def hidden(text: str) -> list[Span]:
    """Findings in decoded layers, mapped to the text."""
    if not ("%" in text or "\\" in text or BASE64.search(text)):
        return []
    return Worklist(text).run()


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: one row per
    document. The counts and the digest are of the base spans in the text as it
    stands; ``spans`` also holds the findings of decoded layers, and compressed
    stretches that expand beyond ``MOST`` bytes as ``opaque``.

    A null or empty text has no spans; texts are read whole, whatever their
    length; repeated rows give repeated results and a null doc_id is kept;
    further columns, whatever their names, play no part. An empty table gives
    no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spans = [[] for _ in KINDS[:3]], [], []
            for text in batch.column("text"):
                text = text.as_py()
                base = scan(text)
                for k, c in enumerate(counts):
                    c.append(sum(s[0] == k for s in base))
                digests.append(digest(base, KINDS))
                spans.append(joined(base + hidden(text), KINDS))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return documents(docs).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
