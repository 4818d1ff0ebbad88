"""Personal data: anchors by Aho-Corasick, spans by local parsers.

An automaton of at-signs, schemes, identifier cues, plus signs and digits runs once over the text. At each
anchor a parser reads left and right from it, as far as the item can go, and validates
it; no parser scans the text. Numbers that need no cue (addresses, cards, account numbers with a checksum) start at the
first digit that no number of their kind has taken.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("url", "handle", "iban", "account")
KINDS = BASE_KINDS + ADDED_KINDS

# Cues that announce an item.
SCHEMES = ("http://", "https://", "ftp://", "ssh://", "mailto:", "tel:")
ACCOUNT_CUES = ("account", "acct", "iban", "ssn", "passport", "konto", "compte", "cuenta", "user id", "username", "login")
#: Cues that announce a name, which need not hold a digit.
NAME_CUES = ("username", "login")
IBAN_LENGTHS = {
    "AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27,
    "HU": 28, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24, "TR": 26,
    "AD": 24, "AE": 23, "AL": 28, "AZ": 28, "BA": 20, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CR": 22, "CY": 28, "DO": 28,
    "EE": 20, "EG": 29, "FO": 18, "GE": 22, "GI": 23, "GL": 18, "GT": 28, "HR": 21, "IL": 23, "IQ": 23, "IS": 26, "JO": 30,
    "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19,
    "MR": 27, "MT": 31, "MU": 30, "PK": 24, "PS": 29, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SD": 18, "SI": 19,
    "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}

_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_label = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_dotted = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_card = re.compile(r"[0-9](?:[ -]?[0-9])*+")
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_url = re.compile(r"[A-Za-z0-9._~%!$&'*+,;=:@\[\]-]+(?:[/?#][^\s<>\"'()]*)?")
_account = re.compile(r"(?:[ ]?(?:no|nr|number|num|id|name)\b\.?)?[ ]?[:#=][ ]?([A-Za-z0-9][A-Za-z0-9_.-]{3,63})", re.I | re.A)
_iban = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,32}")
_handle = re.compile(r"@[A-Za-z][A-Za-z0-9_]{2,29}(?![A-Za-z0-9_@.])")

_automaton: list = []


def automaton():
    """Cues by kind; built once in each worker. Letters match in lower case."""
    if not _automaton:
        found = ahocorasick.Automaton()
        found.add_word("@", ("at", 1))
        found.add_word("+", ("plus", 1))
        for digit in "0123456789":
            found.add_word(digit, ("digit", 1))
        for cue in SCHEMES:
            found.add_word(cue, ("scheme", len(cue)))
        for cue in ACCOUNT_CUES:
            found.add_word(cue, ("account", len(cue)))
        found.make_automaton()
        _automaton.append(found)
    return _automaton[0]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def valid_iban(code: str) -> bool:
    code = code.replace(" ", "")
    if IBAN_LENGTHS.get(code[:2]) != len(code):
        return False
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


_lower = {i: i + 32 for i in range(65, 91)}


def anchors(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of each cue, by end."""
    low = text.lower()  # letters only ever grow, so an equal length means equal places
    for last, (kind, size) in automaton().iter(low if len(low) == len(text) else text.translate(_lower)):
        yield kind, last + 1 - size, last + 1


def email_at(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """The address around the at-sign: the longest local part that starts at ``floor`` or
    later, and the longest run of labels with a dot."""
    start = at
    while start > floor and text[start - 1] in _local:
        start -= 1
    if start == at or not (m := _label.match(text, at + 1)):
        return None
    return start, m.end()


def addresses_in(text: str, start: int) -> tuple[list[tuple[int, int]], int]:
    """The numeric addresses of the dotted run of digits that starts here, and where the run ends: every four groups
    are one, and those with a group above 255 are dropped."""
    end = _dotted.match(text, start).end()
    groups = text[start:end].split(".") if end - start > 6 else []
    found, at = [], start
    for i in range(0, len(groups) - 3, 4):
        part = groups[i : i + 4]
        stop = at + sum(map(len, part)) + 3
        if all(len(p := g.lstrip("0")) <= 3 and int(p or 0) <= 255 for g in part):
            found.append((at, stop))
        at = stop + 1
    return found, end


def iban_at(text: str, start: int) -> tuple[int, int] | None:
    """The account number with two letters and two digits here, if its country's length and its checksum hold."""
    size = IBAN_LENGTHS.get(text[start : start + 2])
    if not size or (start and (text[start - 1].isalnum() and text[start - 1].isascii() or text[start - 1] == "_")) or not (run := _iban.match(text, start)):
        return None
    stop, n = start, 0
    while stop < run.end() and n < size:
        n += text[stop] != " "
        stop += 1
    if n == size and valid_iban(text[start:stop]) and not text[stop : stop + 1].isalnum():
        return start, stop
    return None


def find_pii(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, end exclusive, by kind as listed and start.

    The base kinds follow their patterns to the letter. The added kinds are links with
    their user part, handles, account numbers whose checksum holds, and account names or numbers
    that a cue and a separator announce. An added span that lies in a base span, or overlaps one
    added before it, is left out.
    """
    if not text:
        return []
    spans: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    floor = {"at": 0, "plus": 0, "dotted": 0, "card": 0}
    announced: list[tuple[int, int]] = []
    for kind, start, end in anchors(text):
        if kind == "digit":
            if start >= floor["dotted"]:
                found, floor["dotted"] = addresses_in(text, start)
                spans["ip"] += found
            if start >= floor["card"]:
                floor["card"] = stop = _card.match(text, start).end()
                if stop - start >= 16 and 16 <= len(d := text[start:stop].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                    spans["card"].append((start, stop))
            if start >= 2 and "A" <= text[start - 1] <= "Z" and (found := iban_at(text, start - 2)):
                spans["iban"].append(found)
        elif kind == "plus":
            if start >= floor["plus"] and (m := _phone.match(text, start)):
                floor["plus"] = m.end()
                if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    spans["phone"].append(m.span())
        elif kind == "at":
            if start >= floor["at"] and (found := email_at(text, start, floor["at"])):
                spans["email"].append(found)
                floor["at"] = found[1]
            if (start == 0 or text[start - 1].isspace()) and (m := _handle.match(text, start)):
                spans["handle"].append(m.span())
        elif kind == "scheme":
            if (start == 0 or not text[start - 1].isalnum()) and (m := _url.match(text, end)):
                stop = m.end()
                while stop > end and text[stop - 1] in ".,;:!?":
                    stop -= 1
                if stop > end:
                    spans["url"].append((start, stop))
        elif start == 0 or not text[start - 1].isalnum():
            if (m := _account.match(text, end)) and (text[start:end].lower() in NAME_CUES or any("0" <= c <= "9" for c in m[1])):
                announced.append(m.span(1))
    spans["account"] = announced  # what no valid account number took
    return [(k, *s) for k in BASE_KINDS for s in spans[k]] + _apart(spans)


def _apart(spans: dict[str, list[tuple[int, int]]]) -> list[tuple[str, int, int]]:
    """The added spans by kind and start, without those in a base span or across one before them."""
    base = sorted(s for k in BASE_KINDS for s in spans[k])
    reach, far = [], 0
    for _, end in base:
        far = max(far, end)
        reach.append(far)
    taken: list[tuple[int, int]] = []
    out = []
    for kind in ("url", "handle", "iban", "account"):
        for start, end in sorted(set(spans[kind])):
            i = bisect.bisect_right(base, (start, 1 << 62))
            if i and reach[i - 1] >= end:
                continue
            j = bisect.bisect(taken, (start, end))
            if (j and taken[j - 1][1] > start) or (j < len(taken) and taken[j][0] < end):
                continue
            taken.insert(j, (start, end))
            out.append((kind, start, end))
    return out


def scan_pii(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, ``spans`` (array of kind, start, end, value).

    A null or empty text has none; texts of any length are read in whole. Repeated rows come back repeated;
    ids may be null; further columns are ignored; an empty table gives an empty table.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    struct = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))

    def batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column(1):
                t = value.as_py()
                out.append([{"kind": k, "start": s, "end": e, "value": t[s:e]} for k, s, e in find_pii(t)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, struct)], names=[id_col, "spans"])

    schema = f"`{id_col}` {kind}, spans array<struct<kind:string,start:long,end:long,value:string>>"
    return docs.select(F.col(id_col), F.col(text)).mapInArrow(batches, schema)


def _is(kind: str):
    return lambda s: s["kind"] == kind


def pii_digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the hash of the base spans and all spans as text."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    counts = [F.size(F.filter("spans", _is(k))).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return scanned.select(id_col, *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
