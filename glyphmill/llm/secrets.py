"""Secret scans: a worklist of decoded layers, each rescanned, spans mapped back.

A document is the first layer. Every layer is scanned for secrets; then all
encodings found in it are unwrapped into new layers: URL escapes and Unicode
escapes give the whole layer with the escapes replaced, a base64 token gives a
layer of its own (decompressed first when it holds a gzip, zlib, bzip2, xz or
zstd stream). The worklist ends when no layer gives anything unseen; a digest
of each layer and its place stops cycles. Each layer knows how its characters map to its
parent, so a span found at any depth is reported in the document's own code
points: exactly for escapes, as the whole token for base64.

A compressed stream is read to its end, all its members and streams within it,
but never held whole: it is scanned in windows of ``window`` bytes, each with the
last ``OVERLAP`` characters of the one before, so what it grows to costs time and
no memory. A secret, or a token within the stream, that is longer than the
overlap may be seen in parts where a window ends.

Defined cases: null or empty text has no spans; an undecodable token is plain
text; a stream that breaks off is read up to there; equal windows of a
decompression bomb are scanned once; an escape that escapes itself over and
over (``%252525..``) is folded in one step. Repeated rows give repeated rows. Extra columns
stay, but for ``base_spans`` and ``spans``, which the results replace.
"""

from __future__ import annotations

import base64
import bz2
import codecs
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, shielded

#: The kinds in the order that breaks ties between equal starts.
KINDS = ("assign", "access", "hex")

#: What a secret of each kind looks like.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_ASSIGN, MIN_ACCESS = 6, 20

URL_RUN = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
#: An escape sign that is itself escaped four times or more.
FOLDED = re.compile(r"%(?:25){4,}(?=[0-9A-Fa-f]{2})|\\(?:u005[cC]){4,}(?=[uxU])|&(?:#(?:38|[xX]26);){4,}(?=#)")
UNICODE_RUN = re.compile(r"(?:\\u\{[0-9A-Fa-f]{1,6}\}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#x[0-9A-Fa-f]{1,6};|&#[0-9]{1,7};)+")
UNICODE_ONE = re.compile(r"\\u\{([0-9A-Fa-f]+)\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#x([0-9A-Fa-f]+);|&#([0-9]+);")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Signs of the base64 alphabets that also part a path or an identifier.
SIGN = re.compile(r"[/_-]")
#: Text within decoded bytes, and the first bytes of compressed streams.
PRINTABLE = re.compile(rb"[\t\n\r\x20-\x7e]{12,}")
PRINTABLE16 = re.compile(rb"(?:[\t\n\r\x20-\x7e]\x00){12,}|(?:\x00[\t\n\r\x20-\x7e]){12,}")
ZSTD = b"\x28\xb5\x2f\xfd"
_CONTROL = [chr(c) for c in range(32) if chr(c) not in "\t\n\r"]
MAGIC = re.compile(rb"\x1f\x8b\x08|BZh[1-9]1AY&SY|\xfd7zXZ\x00|\x28\xb5\x2f\xfd|\x78[\x01\x5e\x9c\xda]")
_URLSAFE = str.maketrans("-_", "+/")

#: Decompressed bytes that are scanned at once, and the characters that windows share.
WINDOW, OVERLAP = 4 << 20, 64 << 10
#: Streams within streams: one that holds itself would never end.
MAX_NESTED = 32
_PIECE = 1 << 18

Span = tuple[int, int, int]  # start, kind's index, end


def base_spans(text: str) -> list[Span]:
    """The plain matches of each kind, leftmost and non-overlapping per kind."""
    found: list[Span] = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


class _Layer:
    """A text and the place of each of its characters in its parent layer."""

    __slots__ = ("text", "parent", "starts", "sources", "whole", "place")

    def __init__(self, text, parent=None, starts=(), sources=(), whole=None) -> None:
        self.text, self.parent, self.starts, self.sources, self.whole = text, parent, starts, sources, whole
        #: Where the outermost token that holds this layer stands in the document.
        self.place = parent and (parent.place or whole and parent.to_document(*whole))

    def to_parent(self, start: int, end: int) -> tuple[int, int]:
        if self.whole:
            return self.whole
        return self._place(start)[0], self._place(end - 1)[1]

    def _place(self, at: int) -> tuple[int, int]:
        k = bisect_right(self.starts, at) - 1
        start, end, same = self.sources[k]
        return (start + at - self.starts[k], start + at - self.starts[k] + 1) if same else (start, end)

    def to_document(self, start: int, end: int) -> tuple[int, int]:
        layer = self
        while layer.parent is not None:
            start, end = layer.to_parent(start, end)
            layer = layer.parent
        return start, end


def _replaced(layer: _Layer, runs: re.Pattern, decode) -> Iterator[_Layer]:
    """The layer with every run of escapes decoded; nothing if nothing changes."""
    text, parts, starts, sources, at, length = layer.text, [], [], [], 0, 0

    def put(piece: str, start: int, end: int, same: bool) -> None:
        nonlocal length
        if piece:
            parts.append(piece)
            starts.append(length)
            sources.append((start, end, same))
            length += len(piece)

    for m in runs.finditer(text):
        for piece, start, end in decode(m[0]):
            if at < m.start() + start:
                put(text[at : m.start() + start], at, m.start() + start, True)
            put(piece, m.start() + start, m.start() + end, False)
            at = m.start() + end
    if not all(same for _, _, same in sources):
        put(text[at:], at, len(text), True)
        yield _Layer("".join(parts), layer, starts, sources)


def _url(run: str) -> Iterator[tuple[str, int, int]]:
    """Characters of a run of %XX with their places; bytes that are not UTF-8 stay escaped."""
    raw, k = bytes.fromhex(run.replace("%", "")), 0
    while k < len(raw):
        n = 1 if raw[k] < 0x80 else 2 if 0xC2 <= raw[k] < 0xE0 else 3 if 0xE0 <= raw[k] < 0xF0 else 4 if 0xF0 <= raw[k] < 0xF5 else 0
        try:
            if n:
                yield raw[k : k + n].decode(), 3 * k, 3 * (k + n)
        except UnicodeDecodeError:
            n = 1
        k += n or 1


def _unicode(run: str) -> Iterator[tuple[str, int, int]]:
    high: tuple[int, int] | None = None
    for m in UNICODE_ONE.finditer(run):
        number = next(g for g in m.groups() if g)
        code = int(number, 10 if m[6] else 16)
        if 0xD800 <= code < 0xDC00:
            high = (code, m.start())
            continue
        if 0xDC00 <= code < 0xE000:
            if high:
                yield chr(0x10000 + ((high[0] - 0xD800) << 10) + code - 0xDC00), high[1], m.end()
        elif code < 0x110000:
            yield chr(code), m.start(), m.end()
        high = None


def _fold(run: str) -> Iterator[tuple[str, int, int]]:
    yield run[0], 0, len(run)


def _decoder(raw: bytes):
    """A decompressor for a stream that starts so; None if it is none."""
    if raw[:2] == b"\x1f\x8b" or raw[:1] == b"\x78" and len(raw) > 2 and int.from_bytes(raw[:2], "big") % 31 == 0:
        return zlib.decompressobj(wbits=47)
    if raw[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if raw[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor(memlimit=256 << 20)
    return None


class _Pieces:
    """A file over pieces of bytes, for readers that ask for so many."""

    def __init__(self, pieces: Iterator[bytes]) -> None:
        self.pieces, self.left = pieces, b""

    def read(self, n: int = -1) -> bytes:
        while not self.left:
            if (piece := next(self.pieces, None)) is None:
                return b""
            self.left = piece
        out, self.left = (self.left, b"") if n < 0 else (self.left[:n], self.left[n:])
        return out


def _broken(error: Exception) -> bool:
    """Whether the error is a codec's, of a stream that is none or breaks off."""
    return isinstance(error, (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError)) or type(error).__name__ == "ZstdError"


def _expanded(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The content of a stream, all its members, in pieces; it ends where the stream breaks."""
    held = next(pieces, b"")
    try:
        if held[:4] == ZSTD:
            import zstandard

            reader = zstandard.ZstdDecompressor().stream_reader(_Pieces(chain([held], pieces)), read_across_frames=True)
            while out := reader.read(_PIECE):
                yield out
            return
        while (decoder := _decoder(held)) is not None:
            while True:
                out = decoder.decompress(held, _PIECE)
                if out:
                    yield out
                if decoder.eof:
                    break
                held = getattr(decoder, "unconsumed_tail", b"")
                if not held and len(out) < _PIECE:
                    if (more := next(pieces, None)) is None:
                        return
                    held = more
            held = decoder.unused_data.lstrip(b"\0")  # members may be padded
            while len(held) < 6 and (more := next(pieces, None)) is not None:
                held = (held + more).lstrip(b"\0")
    except Exception as error:  # what follows a break is left
        if not _broken(error):
            raise


def _compressed(head: bytes) -> bool:
    """Whether bytes that start so are a compressed stream."""
    try:
        if head[:4] == ZSTD:
            import zstandard

            zstandard.ZstdDecompressor().stream_reader(head, read_across_frames=True).read(64)
            return True
        if (decoder := _decoder(head)) is not None:
            decoder.decompress(head[:_PIECE], 64)
            return True
    except Exception as error:
        if not _broken(error):
            raise
    return False


def _stream(raw: bytes) -> Iterator[bytes] | None:
    """The content of a compressed stream, and of the streams within it, in pieces; None if it is none."""
    if not _compressed(raw):
        return None
    pieces: Iterator[bytes] = iter([raw])
    for _ in range(MAX_NESTED):
        pieces, head = _expanded(pieces), b""
        while len(head) < 1024 and (piece := next(pieces, None)) is not None:
            head += piece
        pieces = chain([head], pieces)
        if not _compressed(head):
            return pieces
    return None


def _encoding(raw: bytes) -> str | None:
    """How text starts so: UTF-8, or UTF-16 by its mark or its zeros; None if it is no text."""
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return "utf-16"
    if raw[:512].count(0) * 3 >= len(raw[:512]) > 1:
        return "utf-16-le" if raw[:512:2].count(0) < raw[1:512:2].count(0) else "utf-16-be"
    return "utf-8"


def _readable(raw: bytes, cut: bool = False) -> str | None:
    """The bytes as text; None if they are none. ``cut``: the last character may be cut off."""
    try:
        text = codecs.getincrementaldecoder(_encoding(raw))().decode(raw, not cut)
    except UnicodeDecodeError:
        return None
    odd = sum(map(text.count, _CONTROL))
    return text if text and odd * 20 <= len(text) else None


def _texts(token: str, window: int) -> Iterator[str]:
    """The text of a base64 token, decompressed, in overlapping windows; nothing if it is none."""
    yield from _contents(base64.b64decode(token + "=" * (-len(token) % 4)), window)


def _contents(raw: bytes, window: int) -> Iterator[str]:
    pieces = _stream(raw)
    if pieces is None:
        if (text := _readable(raw)) is not None:
            yield text
        return
    decoder, tail, held, size = None, "", [], 0
    while True:
        piece = next(pieces, None)
        if piece:
            held.append(piece)
            size += len(piece)
        if size >= window or piece is None and (held or decoder is None):
            block = b"".join(held)
            if decoder is None:
                if _readable(block, cut=True) is None:
                    return
                decoder = codecs.getincrementaldecoder(_encoding(block))("replace")
            text = tail + decoder.decode(block, piece is None)
            yield text
            tail, held, size = text[-OVERLAP:], [], 0
        if piece is None:
            return


def _base64_layers(layer: _Layer, window: int) -> Iterator[_Layer]:
    for m in BASE64.finditer(layer.text):
        token, start = m[0].rstrip("="), m.start()
        plain = token.translate(_URLSAFE)
        whole = False
        for text in _texts(plain, window) if len(token) % 4 != 1 else ():
            whole = True
            yield _Layer(text, layer, whole=(start, m.end()))
        if whole:
            continue
        # Something may stand before or behind the token: its parts, then each start behind a sign, then other alignments.
        signs = [k.end() for k in SIGN.finditer(token)]
        done = 0  # characters before it are read
        for a, b in zip([0, *signs], [*(k - 1 for k in signs), len(token)], strict=True):
            if a < done:
                continue
            for end in dict.fromkeys((len(token), b)):
                if end - a < 16 or (end - a) % 4 == 1 or (a, end) == (0, len(token)) or not _begins(plain[a : a + 24]):
                    continue
                for text in _texts(plain[a:end], window):
                    yield _Layer(text, layer, whole=(start + a, m.end() if end == len(token) else start + end))
                    done = end
                if done == end:
                    break
        for shift in range(4) if not done else ():
            part = plain[shift : len(plain) - (len(plain) - shift) % 4 if (len(plain) - shift) % 4 == 1 else len(plain)]
            raw = base64.b64decode(part + "=" * (-len(part) % 4))
            for run in PRINTABLE.finditer(raw):
                a, b = shift + run.start() * 4 // 3, min(len(token), shift - (-run.end() * 4 // 3))
                yield _Layer(run[0].decode(), layer, whole=(start + a, start + b))
            for run in PRINTABLE16.finditer(raw):
                a, b = shift + run.start() * 4 // 3, min(len(token), shift - (-run.end() * 4 // 3))
                yield _Layer(run[0][::2].decode() if run[0][1] == 0 else run[0][1::2].decode(), layer, whole=(start + a, start + b))
            for magic in MAGIC.finditer(raw):
                if _compressed(raw[magic.start() :]):
                    for text in _contents(raw[magic.start() :], window):
                        yield _Layer(text, layer, whole=(start + shift + magic.start() * 4 // 3, m.end()))


def _layers(layer: _Layer, window: int) -> Iterator[_Layer]:
    """All layers that one unwrapping of ``layer`` gives, one at a time."""
    yield from _base64_layers(layer, window)
    if "%" in layer.text:
        yield from _replaced(layer, URL_RUN, _url)
    if "\\" in layer.text or "&#" in layer.text:
        yield from _replaced(layer, UNICODE_RUN, _unicode)
    yield from _replaced(layer, FOLDED, _fold)


def _begins(head: str) -> bool:
    """Whether base64 that starts so may hold text or a compressed stream."""
    raw = base64.b64decode(head[: len(head) // 4 * 4])
    return MAGIC.match(raw) is not None or raw[:1] == b"\x78" or _encoding(raw) != "utf-8" or sum(c < 32 and c not in b"\t\n\r" for c in raw) <= 1


def scan(text: str | None, window: int = WINDOW) -> tuple[list[Span], list[Span]]:
    """(plain spans, all spans) of one document, each sorted by start, kind and end."""
    if not text:
        return [], []
    plain = base_spans(text)
    root = _Layer(text)
    # The worklist: what is still to be unwrapped of each layer, the innermost last, so that a long stream is read window by window.
    found, seen, work = set(plain), {_digest(root)}, [_layers(root, window)]
    while work:
        new = next(work[-1], None)
        if new is None:
            work.pop()
            continue
        digest = _digest(new)
        if digest not in seen:
            seen.add(digest)
            work.append(_layers(new, window))
            for start, kind, end in base_spans(new.text):
                a, b = new.to_document(start, end)
                found.add((a, kind, b))
    return plain, sorted(found)


def _digest(layer: _Layer) -> bytes:
    return hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass"), digest_size=16).digest() + repr(layer.place).encode()


def rendered(spans: list[Span]) -> str:
    """Spans as ``kind:start:end`` joined by commas."""
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def find_secrets(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """Add ``base_spans`` and ``spans`` (arrays of struct<kind,start,end>) to ``docs``.

    A map over rows without any exchange; memory is bounded by one Arrow batch
    and, of one document, its text, the layers that lie within each other, and their windows.
    """
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    both = pa.struct([("base_spans", span), ("spans", span)])

    def named(spans: list[Span]) -> list[dict]:
        return [{"kind": KINDS[kind], "start": start, "end": end} for start, kind, end in spans]

    @F.arrow_udf("struct<base_spans:array<struct<kind:string,start:bigint,end:bigint>>,spans:array<struct<kind:string,start:bigint,end:bigint>>>")
    def scanned(texts: pa.Array) -> pa.Array:
        release()
        rows = (scan(t.as_py(), window) for t in texts)
        return pa.array(({"base_spans": named(a), "spans": named(b)} for a, b in rows), both)

    inner, restore = shielded(docs, {"_text": text}, ["base_spans", "spans"])
    return restore(inner.withColumn("_secrets", scanned("_text")).select("*", "_secrets.base_spans", "_secrets.spans"))


def span_text(spans: str):
    """Column: an array of spans as ``kind:start:end`` joined by commas."""
    return F.array_join(F.transform(F.col(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
