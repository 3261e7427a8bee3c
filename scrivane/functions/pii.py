"""Rule scanners for personal and payment data, over UTF-8 bytes.

A hit is (kind, text, start, end) with byte offsets; scanners append in a fixed order that the final fold relies on. Windows
that would cut a character end before it. Letters are lower-cased only in ASCII when markers are searched, which keeps offsets
valid.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

Hit = tuple[str, str, int, int]

EMAIL, PHONE, SSN, PAN, CVV, EXPIRY = "EMAIL", "PHONE", "SSN", "PAN", "CVV", "EXPIRY"
ZIP, ADDRESS, NAME, ACCOUNT = "ZIP", "ADDRESS", "NAME", "ACCOUNT"

_AT = re.compile(rb"@")
_LOCAL = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(rb"[A-Za-z0-9.-]*")
_DASHED = re.compile(rb"(?=(\([2-9]\d\d..[2-9]\d\d-\d{4}|[2-9]\d\d-[2-9]\d\d-\d{4}))", re.S)
_DIGITS = re.compile(rb"\d+")
_PLAIN_PHONE = re.compile(rb"1?[2-9]\d\d[2-9]\d{6}")
_PLUS = re.compile(rb"\+")
_SSN = re.compile(rb"(?<!\d)(\d{3})-(\d\d)-(\d{4})(?!\d)")
_CARD = re.compile(rb"4|5[1-5]|3[4-8]|6011|644|65|30[0-5]")
_ALNUM = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
_NAME_MARKS = (b"name:", b"buyer:", b"customer:", b"contact:", b"ship to:")
_BILL_MARKS = (b"bill to:", b"bill to ", b"bill_to", b"buyer ")
_MONEY_MARKS = (*b"gstin gst account acct bank".split(), *b"routing swift iban bsb".split(), b"sort code", *(b"account " + x for x in (b"no", b"number")))
_ZEROS = bytes(48 if 48 <= c <= 57 else 46 for c in range(256))


def _cut(raw: bytes, end: int) -> int:
    """The last end of a character at or before `end`."""
    end = min(end, len(raw))
    while 0 < end < len(raw) and raw[end] & 0xC0 == 0x80:
        end -= 1
    return end


def _rise(raw: bytes, start: int) -> int:
    while start < len(raw) and raw[start] & 0xC0 == 0x80:
        start += 1
    return start


def _say(raw: bytes, a: int, b: int) -> str:
    return raw[a:b].decode("utf-8", "replace")


def emails(raw: bytes) -> Iterator[Hit]:
    for m in _AT.finditer(raw, 0, max(0, len(raw) - 5)):
        at = m.start()
        a = at
        while a and raw[a - 1] in _LOCAL:
            a -= 1
        b = _DOMAIN.match(raw, at + 1).end()
        domain = raw[at + 1 : b]
        if a < at and len(domain) >= 3 and b"." in domain and domain[-2:].isalpha():
            yield EMAIL, _say(raw, a, b), a, b


def phones(raw: bytes) -> Iterator[Hit]:
    if len(raw) >= 12:
        for m in _DASHED.finditer(raw):
            yield PHONE, _say(raw, *m.span(1)), *m.span(1)
    for m in _DIGITS.finditer(raw):
        run = m.group()
        if (len(run) == 10 or (len(run) == 11 and run[:1] == b"1")) and _PLAIN_PHONE.fullmatch(run if len(run) == 11 or run[:1] != b"1" else b"x"):
            yield PHONE, run.decode(), *m.span()
    for m in _PLUS.finditer(raw, 0, max(0, len(raw) - 6)):
        i = m.start()
        j, depth = i + 1, 0
        while j < len(raw):
            c = raw[j]
            if c == 40:
                depth += 1
            elif c == 41:
                depth -= 1
                if depth < 0:
                    break
            elif not (48 <= c <= 57 or c in b"- "):
                break
            j += 1
        span = raw[i:j]
        if len(span) >= 8 and 7 <= sum(48 <= c <= 57 for c in span) <= 15 and any(c in b"-( " for c in span):
            yield PHONE, span.decode(), i, j


def _issued(area: int, group: int, serial: int) -> bool:
    return 1 <= area <= 899 and area != 666 and group > 0 and serial > 0


def ssns(raw: bytes) -> Iterator[Hit]:
    for m in _SSN.finditer(raw):
        if _issued(*map(int, m.groups())):
            yield SSN, m.group().decode(), *m.span()
    for m in _DIGITS.finditer(raw):
        run = m.group()
        if len(run) == 9 and _issued(int(run[:3]), int(run[3:5]), int(run[5:])):
            yield SSN, run.decode(), *m.span()


def luhn(digits: bytes) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = c - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return bool(digits) and total % 10 == 0


def cards(raw: bytes) -> Iterator[Hit]:
    """Card numbers; after each, security codes and an expiry date within 80 bytes."""
    for m in _DIGITS.finditer(raw):
        run = m.group()
        if not (13 <= len(run) <= 19 and _CARD.match(run) and luhn(run)):
            continue
        yield PAN, run.decode(), *m.span()
        end = m.end()
        stop = _cut(raw, end + 80)
        for d in _DIGITS.finditer(raw, end, stop):
            a, b = d.span()
            if b - a in (3, 4) and not (a and 48 <= raw[a - 1] <= 57) and not (b < len(raw) and 48 <= raw[b] <= 57):
                yield CVV, d.group().decode(), a, b
        near = raw[end:stop]
        slash = near.find(b"/")
        if slash >= 2:
            digit = lambda k: k < len(near) and 48 <= near[k] <= 57
            years = b""
            if slash + 3 < len(near) and digit(slash + 1):
                years = near[slash + 1 : slash + 5] if slash + 5 < len(near) and digit(slash + 3) else near[slash + 1 : slash + 3]
            month = near[slash - 2 : slash]
            if years and month.isdigit() and years.isdigit() and 1 <= int(month) <= 12:
                a, b = end + slash - 2, end + slash + 1 + len(years)
                yield EXPIRY, _say(raw, a, b), a, b


def zips(raw: bytes) -> Iterator[Hit]:
    for m in _DIGITS.finditer(raw):
        a, b = m.span()
        if b - a == 5 and not (a and raw[a - 1] in _ALNUM) and not (b < len(raw) and raw[b] in _ALNUM):
            yield ZIP, m.group().decode(), a, b


def _first(raw: bytes, *marks: bytes) -> int:
    """Where the first of the marks that occurs at all begins, in the order given; -1 if none does."""
    return next((p for p in map(raw.find, marks) if p >= 0), -1)


def marked(raw: bytes) -> Iterator[Hit]:
    """Addresses, names and bill-to blocks after their markers."""
    low = raw.lower()
    at = low.find(b"address:")
    if at >= 0:
        end = _cut(raw, at + 100)
        yield ADDRESS, _say(raw, at, end), at, end
    for mark in _NAME_MARKS:
        at = low.find(mark)
        if at >= 0:
            a = at + len(mark)
            rest = raw[a:]
            stop = _first(rest, b"\n", b"|", b",")
            b = a + (stop if stop >= 0 else _cut(rest, 50))
            name = _say(raw, a, b).strip()
            if len(name.encode()) > 2:
                yield NAME, name, a, b
    mark = next((m for m in _BILL_MARKS if m in low), None)
    if mark:
        yield from _bill_to(raw, low.find(mark) + len(mark))


def _bill_to(raw: bytes, begin: int) -> Iterator[Hit]:
    after = raw[begin:].decode("utf-8", "replace").lstrip().encode()
    stop = _first(after, b"Tel ", b"Email ", b"Site ", b",")
    stop = stop if stop >= 0 else _cut(after, 100)
    words = after[:stop].decode("utf-8", "replace").split()
    n = 0
    while n < min(4, len(words)) and not re.search("[0-9]", words[n]) and not (len(words[n].encode()) <= 1 and n > 1):
        n += 1
    if not n:
        return
    name = " ".join(words[:n])
    a = raw.find(name.encode())
    if a < 0:
        return
    b = a + len(name.encode())
    yield NAME, name, a, b
    end = _cut(raw, begin + stop)
    rest = _say(raw, b, end).strip() if b < end else ""
    if len(rest.encode()) > 3:
        yield ADDRESS, rest, b, end


def accounts(raw: bytes, known: list[Hit]) -> Iterator[Hit]:
    """Digit runs near the first occurrence of a banking word that overlap no hit so far."""
    low, seen = raw.lower(), [(h[2], h[3]) for h in known]
    for mark in _MONEY_MARKS:
        at = low.find(mark)
        if at < 0:
            continue
        lo, hi = _rise(raw, max(0, at - 80)), _cut(raw, at + len(mark) + 80)
        for m in _DIGITS.finditer(raw, lo, hi):
            a, b = m.span()
            if 6 <= b - a <= 20 and not any(x < b and y > a for x, y in seen):
                seen.append((a, b))
                yield ACCOUNT, m.group().decode(), a, b


def fold(hits: list[Hit]) -> list[Hit]:
    """Order hits by start; of two overlapping ones of a kind the longer stays, and a card number displaces a social security number."""
    out: list[Hit] = []
    for hit in sorted(hits, key=lambda h: h[2]):
        if out and hit[2] < out[-1][3]:
            last = out[-1]
            if hit[0] == last[0]:
                if len(hit[1].encode()) > len(last[1].encode()):
                    out[-1] = hit
                continue
            if {hit[0], last[0]} == {PAN, SSN}:
                if hit[0] == PAN:
                    out[-1] = hit
                continue
        out.append(hit)
    return out


def _may_hit(raw: bytes) -> bool:
    """Whether a text has anything a scanner looks for: plain searches, which are much faster than one regular expression."""
    if b"@" in raw or b"+" in raw or b"000" in raw.translate(_ZEROS):
        return True
    low = raw.lower()
    return any(mark in low for mark in (b"address:", *_NAME_MARKS, *_BILL_MARKS))


def raw_hits(text: str | bytes | None) -> list[Hit]:
    """All scanners in their order, before the fold."""
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    if not _may_hit(raw):
        return []
    hits = [*emails(raw), *phones(raw), *ssns(raw), *cards(raw), *zips(raw), *marked(raw)]
    hits.extend(accounts(raw, hits))
    return hits


def scan(text: str | None, tagged: list[Hit] | tuple = ()) -> list[Hit]:
    """Hits of a text. tagged: those of a sequence labeller, whose addresses, names and accounts join in."""
    return fold(raw_hits(text) + [h for h in tagged if h[0] in (ADDRESS, NAME, ACCOUNT)])
