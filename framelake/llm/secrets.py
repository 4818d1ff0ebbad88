"""Secret scans over nested encodings, by a worklist that decodes until nothing is new.

A layer is a text with a map of its places to the whole text. URL, Unicode and entity escapes are undone where they
stand, so a secret may be escaped in part; runs of base64 give layers of their own, and compressed data is read member
by member. Every layer is scanned like the text itself and goes on to be decoded, and what is found has
the span of the text that it was made of.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import heapq
import html
import itertools
import lzma
import re
import zlib
from bisect import bisect_right
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex")

# What a secret looks like.
_assign = re.compile(
    r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?(?P<value>[A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
_access = re.compile(r"AKIA[A-Z0-9]+")
_hex = re.compile(r"[0-9a-f]{24,}")

# What an encoded layer looks like. The shortest secret has 12 bytes, which are 16 characters of base64.
_percent = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_escape = re.compile(
    r"\\u(?P<high>[dD][89abAB][0-9A-Fa-f]{2})\\u(?P<low>[dD][c-fC-F][0-9A-Fa-f]{2})|\\u(?P<u>[0-9A-Fa-f]{4})|\\x(?P<x>[0-9A-Fa-f]{2})|\\U(?P<U>[0-9A-Fa-f]{8})"
    r"|&(?:#(?P<d>[0-9]{1,7})|#[xX](?P<h>[0-9A-Fa-f]{1,6})|(?P<name>[A-Za-z][A-Za-z0-9]{1,31}));"
)
_last = re.compile(r"(?:%[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|\\U[0-9A-Fa-f]{8}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};)\Z")
_base64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}")
_line = re.compile(r"\r?\n[ \t]*([A-Za-z0-9+/_-]+={0,2})")
_parts = re.compile(r"[A-Za-z0-9+]{16,}")
_packed = re.compile("\x1f\x8b\x08|BZh[1-9]1AY&SY|\xfd7zXZ\0|x[\x01\x5e\x9c\xda]")
_worth = re.compile(rb"passw|secret|token|api_?key|AKIA|[0-9a-f]{24}|[A-Za-z0-9+/_-]{16}|%[0-9a-f]{2}|\\[ux]|&[#a-z]", re.I)

#: A decompressed layer that would be larger is scanned in pieces of this size, which overlap.
MAX_LAYER, OVERLAP, STEP = 8 << 20, 1 << 20, 1 << 20
#: Escapes of escapes are undone and scanned one at a time so often; what is nested deeper, to its end at once.
ROUNDS = 12

#: From a span of a layer to the span of the whole text that it was made of.
Up = Callable[[int, int], tuple[int, int]]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, by start, then kind as listed."""
    spans = [("assign", m.start(), m.end()) for m in _assign.finditer(text) if m.end() - m.start("value") >= 6]
    if "AKIA" in text:
        spans += [("access", m.start(), m.end()) for m in _access.finditer(text) if m.end() - m.start() >= 20]
    spans += [("hex", m.start(), m.end()) for m in _hex.finditer(text)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def _opener(data: bytes):
    """A decompressor for what starts like a gzip, zlib, bzip2 or xz stream, else None."""
    if data[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if data[:1] == b"\x78" and len(data) > 2 and (data[0] * 256 + data[1]) % 31 == 0:
        return zlib.decompressobj()
    if data[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if data[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    return None


def _inflate(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The content of all members of a stream, in chunks of STEP at most; of a damaged or cut-off
    one, what comes before the damage."""
    rest = next(chunks, b"")
    make = _opener(rest)
    try:
        while make:
            out = make.decompress(rest, STEP)
            if out:
                yield out
            if make.eof:
                # padding between members is zero bytes
                rest = make.unused_data.lstrip(b"\0")
                while len(rest) < 6 and (more := next(chunks, b"")):
                    rest = (rest + more).lstrip(b"\0")
                make = _opener(rest)
            else:
                rest = getattr(make, "unconsumed_tail", b"")
                if not rest and len(out) < STEP and getattr(make, "needs_input", True) and not (rest := next(chunks, b"")):
                    return
    except (zlib.error, OSError, lzma.LZMAError, EOFError):
        return


def _unpacked(data: bytes) -> Iterator[str]:
    """The text of a compressed layer, however deep; a large one in pieces that overlap."""
    chunks, seen = iter([data]), set()
    while True:
        first = next(chunks, b"")
        key = hashlib.sha256(first).digest()
        if key in seen:
            return
        seen.add(key)  # compressed layers nest as well, and may hold themselves
        read, rest, probing = [first], chunks, True

        def fed(rest: Iterator[bytes] = rest, read: list[bytes] = read) -> Iterator[bytes]:
            yield read[0]
            for chunk in rest:
                if probing:
                    read.append(chunk)
                yield chunk

        inner = _inflate(fed()) if _opener(first) is not None else iter(())
        out = next(inner, None)
        probing = False
        if out is None:  # text may start like a stream
            chunks = itertools.chain(read, rest)
            break
        chunks = itertools.chain([out], inner)
    piece = b""
    for chunk in chunks:
        piece += chunk
        if len(piece) >= MAX_LAYER:
            yield piece.decode(errors="replace")
            piece = piece[-OVERLAP:]
    if piece:
        yield piece.decode(errors="replace")


def _texts(data: bytes) -> Iterator[tuple[str, Callable[[int], int]]]:
    """Bytes as text, and where each of its characters starts: as UTF-8, or else byte by byte, and as UTF-16 where a
    quarter of them are zero. Nothing, if neither a secret nor a further layer can be in it."""
    if _worth.search(data):
        try:
            text = data.decode()
            ends = None if text.isascii() else [0, *itertools.accumulate(len(c.encode()) for c in text)]
            yield text, (lambda i: i) if ends is None else ends.__getitem__
        except UnicodeDecodeError:
            yield data.decode("latin-1"), lambda i: i
    if len(data) >= 24 and data.count(0) * 4 >= len(data):
        for kind in ("utf-16-le", "utf-16-be"):
            text = data[: len(data) // 2 * 2].decode(kind, "replace")
            ends = [0, *itertools.accumulate(2 + 2 * (c > "\uffff") for c in text)]
            yield text, ends.__getitem__


def _encoded_texts(run: str, place: Callable[[int], int], up: Up) -> Iterator[tuple[str, Up]]:
    """The layers of a base64 run, whose i-th character stands at place(i): every byte is mapped to the characters it was in;
    what is compressed, to the whole run."""
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return
    try:
        data = base64.b64decode(body + "=" * (-len(body) % 4))
    except (binascii.Error, ValueError):
        return
    if _opener(data) is not None and next(_inflate(iter([data])), None) is not None:
        whole = up(place(0), place(len(run) - 1) + 1)
        for piece in _unpacked(data):
            yield piece, lambda s, e: whole
        return
    for text, start in _texts(data):
        yield text, lambda s, e, start=start: up(place(start(s) * 4 // 3), place(min(len(body), -(-start(e) * 4 // 3)) - 1) + 1)


def base64_layers(text: str, up: Up, seen: set) -> Iterator[tuple[str, Up]]:
    """The layers of all base64 runs: of each run, of its parts between signs that also stand in paths and names, and
    of runs that go on over lines of one length."""
    until = 0
    for m in _base64.finditer(text):
        runs = [(m[0], m.start())]
        body = m[0].rstrip("=")
        if any(c in body for c in "/-_"):
            runs += [(p[0], m.start() + p.start()) for p in _parts.finditer(body)]
        for run, at in runs:
            key = (up(at, at + len(run)), hashlib.sha256(run.encode()).digest())
            if key not in seen:
                seen.add(key)
                yield from _encoded_texts(run, lambda i, at=at: at + i, up)
        if m.start() >= until and len(m[0]) % 4 == 0 and m[0][-1] != "=":
            size, lines, starts, end = len(m[0]), [m[0]], [m.start()], m.end()
            while (n := _line.match(text, end)) and len(n[1]) <= size:
                lines.append(n[1])
                starts.append(n.start(1))
                end = n.end()
                if len(n[1]) < size or n[1][-1] == "=":
                    break
            until = end
            run = "".join(lines)
            key = (up(starts[0], end), hashlib.sha256(run.encode()).digest())
            if len(lines) > 1 and key not in seen:
                seen.add(key)
                yield from _encoded_texts(run, lambda i, size=size, starts=starts: starts[i // size] + i % size, up)


def packed_layers(text: str, up: Up) -> Iterator[tuple[str, Up]]:
    """The layers of compressed data whose bytes stand in a text as characters, as unescaping leaves them."""
    until = 0
    for m in _packed.finditer(text):
        first = text[m.start() : m.start() + 4096].encode("latin-1", "replace")
        if m.start() < until or _opener(first) is None or next(_inflate(iter([first])), None) is None:
            continue
        end = next((i.start() for i in re.finditer("[^\0-\xff]", text[m.start() :])), len(text) - m.start()) + m.start()
        whole, until = up(m.start(), end), end
        for piece in _unpacked(text[m.start() : end].encode("latin-1")):
            yield piece, lambda s, e, whole=whole: whole


def _character(m: re.Match) -> str:
    got = m.groupdict()
    if got["high"]:
        return chr(0x10000 + ((int(got["high"], 16) & 0x3FF) << 10) + (int(got["low"], 16) & 0x3FF))
    if got["name"]:
        return html.unescape(m[0])
    code = int(got["d"]) if got["d"] else int(got["u"] or got["x"] or got["U"] or got["h"], 16)
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd"


def unescaped(text: str, up: Up) -> tuple[str, Up] | None:
    """The text with its escapes undone where they stand; None if it has none.

    Percent signs stand for bytes of UTF-8; in a word in which that fails, for one character each.
    """
    runs, odd, word, before = [], set(), 0, 0
    if "%" in text:
        for m in _percent.finditer(text):
            word += any(c in text[before : m.start()] for c in " \t\r\n")
            before, data = m.end(), bytes.fromhex(m[0].replace("%", ""))
            try:
                data.decode()
            except UnicodeDecodeError:
                odd.add(word)
            runs.append((m.start(), m.end(), data, word))
    others = ((m.start(), m.end(), m, None) for m in _escape.finditer(text)) if "\\" in text or "&" in text else iter(())
    out: list[str] = []
    at: list[int] = []  # of each piece: where it starts here,
    begin: list[int] = []  # and there,
    end: list[int] = []  # where it ends there; a piece that is longer than one character stands there as it is here
    size, done = 0, 0

    def put(piece: str, s: int, e: int) -> None:
        nonlocal size
        if piece:
            out.append(piece)
            at.append(size)
            begin.append(s)
            end.append(e)
            size += len(piece)

    for s, e, what, word in heapq.merge(runs, others, key=lambda x: x[0]):
        if isinstance(what, re.Match):
            piece = _character(what)
            if piece == what[0]:
                continue
            put(text[done:s], done, s)
            for c in piece:
                put(c, s, e)
        else:
            put(text[done:s], done, s)
            for c in what.decode("latin-1" if word in odd else "utf-8"):
                n = 3 if word in odd else 3 * len(c.encode())
                put(c, s, s + n)
                s += n
        done = e
    if not out:
        return None
    put(text[done:], done, len(text))

    def above(s: int, e: int) -> tuple[int, int]:
        i, j = bisect_right(at, s) - 1, bisect_right(at, e - 1) - 1
        whole = lambda k: end[k] - begin[k] == (at[k + 1] if k + 1 < len(at) else size) - at[k]
        return up(begin[i] + (s - at[i] if whole(i) else 0), begin[j] + e - at[j] if whole(j) else end[j])

    return "".join(out), above


def wholly_unescaped(text: str, up: Up) -> tuple[str, Up]:
    """The text with its escapes undone until none is left, in one pass: each character that ends an escape
    makes it one character, which may end another."""
    out: list[str] = []
    begin: list[int] = []
    for i, c in enumerate(text):
        out.append(c)
        begin.append(i)
        while out[-1] in "0123456789abcdefABCDEF;" and (m := _last.search("".join(out[-12:]))):
            n = len(m[0])
            code = int(re.sub(r"[^0-9]", "", m[0])) if m[0][0] == "&" and m[0][2] not in "xX" else int(re.sub(r"^(?:%|\\.|&#.)|;", "", m[0]), 16)
            del out[-n:], begin[-n + 1 :]
            out.append(chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd")
    begin.append(len(text))
    return "".join(out), lambda s, e: up(begin[s], begin[e])


def find_secrets(text: str | None) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, depth) by start, then kind as listed; depth 0 is the text itself.

    Every layer goes on the worklist with the map of its places. A run that was seen before at the same place
    with the same content is not decoded again, and unescaping always shortens a text, so the list ends.
    A hit that a layer merely repeats (same kind and span) is given once. What was compressed has the span of
    its whole run, since its bytes have no place of their own. Time is in proportion to the text and what it unpacks to.
    """
    if not text:
        return []
    found: list[tuple[str, int, int, int]] = []
    got: set[tuple[str, int, int]] = set()
    seen: set = set()
    work: deque[tuple[str, Up, int, int]] = deque([(text, lambda s, e: (s, e), 0, 0)])
    while work:
        layer, up, depth, rounds = work.popleft()
        for kind, s, e in base_spans(layer):
            hit = (kind, *((s, e) if not depth else up(s, e)))
            if hit not in got:
                got.add(hit)
                found.append((*hit, depth))
        work.extend((t, u, depth + 1, 0) for t, u in base64_layers(layer, up, seen))
        if depth:
            work.extend((t, u, depth + 1, 0) for t, u in packed_layers(layer, up))
        if "%" in layer or "\\" in layer or "&" in layer:
            if (inner := unescaped(layer, up)) is not None:
                if rounds + 1 == ROUNDS:
                    inner = wholly_unescaped(*inner)
                work.append((*inner, depth + 1, rounds + 1))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id and ``spans`` (array of kind, start, end, depth).

    A null or empty text has none; texts of any length are read in whole. Repeated rows come back repeated;
    ids may be null; further columns are ignored; an empty table gives an empty table.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    struct = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("depth", pa.int32())]))

    def batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[dict(zip(("kind", "start", "end", "depth"), s)) for s in find_secrets(t.as_py())] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, struct)], names=[id_col, "spans"])

    schema = f"`{id_col}` {kind}, spans array<struct<kind:string,start:long,end:long,depth:int>>"
    return docs.select(F.col(id_col), F.col(text)).mapInArrow(batches, schema)


def _is(kind: str):
    return lambda s: s["kind"] == kind


def secrets_digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and hash of the base spans (depth 0), and all spans as text."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["depth"] == 0)
    counts = [F.size(F.filter(base, _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return scanned.select(id_col, *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
