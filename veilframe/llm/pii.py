r"""Personal data: format-preserving Feistel pseudonyms.

What looks like a personal value is validated first, then permuted under a key within its own format:
a card number becomes another that passes Luhn's test, a date another date written alike, an address
another address. Equal values get equal pseudonyms in every document, and ``restore`` with the key
gives the originals back. One exception: where a pseudonym, with the digits around it, would make another
value that is read first, the next pseudonym that doesn't is taken there.

Kinds: email (letters and digits of the local part), card (13 to 19 digits that pass Luhn), iban (that
passes mod 97), ssn, phone (North American, or + and 8 to 15 digits; without the +, area and exchange
must start with 2 to 9), ipv4, date (year first, or year
last with ``.`` or ``/``; 1900 to 2099), secret (32 to 64 hexadecimal digits after token, key, secret or
password and ``=`` or ``:``). Values that fail validation stay as they are, and so does everything else.

Where formats overlap: a run of digit groups is tried as a card from each group to each later group's end, and
an iban to each group's end, its country's length first. What validates first is taken: usual groupings of cards
and the other kinds before unusual groupings of cards, then the leftmost, then by kind, then the longest.

Method: a number below N = a * b is a pair (x mod a, y mod b); rounds add a keyed digest of one half to
the other in turn, which is a permutation of 0..N-1. Where only some numbers of a format are valid, the
permutation is walked until it meets a valid one, which is a permutation of the valid ones.

Defined results: a null text stays null, with no spans; empty texts stay empty; whole texts of any
length are read; repeated rows are each treated; an empty table gives an empty result. Columns other
than the text pass through ``pseudonymise`` unread, whatever their names. ``spans`` counts code points of the input text.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable, Iterable
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe import runtime

ROUNDS = 10
#: For tests and examples; pass a secret key of your own in production.
EXAMPLE_KEY = b"veilframe example key"

_FIRST_DAY, _LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
_ALNUM = "0123456789abcdefghijklmnopqrstuvwxyz"

EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9])?)(?=@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)")
SECRET = re.compile(r"(?i)(?:token|key|secret|password)[\"']?\s*[=:]\s*[\"']?([0-9a-f]{32,64})(?![0-9A-Za-z])")
_START, _END = r"(?<![0-9A-Za-z])(?<!\d[.\-/])", r"(?![0-9A-Za-z]|[.\-/]\d)"
_CARD_START, _CARD_END = re.compile(r"(?<![0-9A-Za-z])(?<!\d[./])", re.ASCII), re.compile(r"(?![0-9A-Za-z]|[./]\d)", re.ASCII)
_PATTERNS = {
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?",
    "ipv4": r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}",
    "date": r"\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4}",
    "ssn": r"\d{3}-\d{2}-\d{4}",
    "phone+1": r"\+\d[ .-]?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}",
    "phone": r"(?:\d[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}|\+\d{1,3}(?:[ .-]?\(?\d{1,4}\)?){2,5}",
}
#: Where a personal number may start; ``_candidates`` then looks at every kind.
NUMBER = re.compile(
    "|".join(f"{_START}(?:{x}){_END}" for x in _PATTERNS.values()) + r"|(?<![0-9A-Za-z])(?<!\d[./])\d(?:[ -]?\d){12}", re.ASCII
)
_KINDS = {kind: re.compile(f"{_START}(?:{x}){_END}", re.ASCII) for kind, x in _PATTERNS.items()}
_WHOLE_IBAN = re.compile(_PATTERNS["iban"], re.ASCII)
_GROUP = re.compile(r"\d+", re.ASCII)
#: How cards are usually written, as the digits of each group; these are read before other groupings.
_CARD_SHAPES = {*((n,) for n in range(13, 20)), (4, 4, 4, 4), (4, 6, 5), (4, 6, 4)}
_IBAN_LENGTHS = {
    c: int(n)
    for n, countries in (line.split(":") for line in """15:NO 16:BE 18:DK,FI,FO,GL,NL 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,XK 21:CH,HR,LI,LV
22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA 23:AE,GI,IL,IQ,TL 24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:PT,ST 26:IS,TR 27:FR,GR,IT,MC,MR,SM
28:AL,AZ,BY,CY,DO,GT,HU,LB,PL,SV 29:BR,EG,PS,QA,UA 30:JO,KW,MU 31:MT,SC 32:LC""".split())
    for c in countries.split(",")
}


@lru_cache(maxsize=1 << 16)
def _digest(key: bytes, kind: str, size: int, turn: int, half: int) -> int:
    said = f"{kind}|{size}|{turn}|{half}".encode()
    return int.from_bytes(hashlib.blake2b(said, key=key[:64], digest_size=24).digest(), "big")


class Permutation:
    """Keyed permutations of numbers; ``sign`` -1 undoes them."""

    def __init__(self, key: bytes, sign: int = 1):
        self.key, self.sign = hashlib.sha512(key).digest(), sign

    def number(self, kind: str, value: int, a: int, b: int) -> int:
        """A permutation of 0 .. a * b - 1."""
        x, y = divmod(value, b)
        for turn in range(ROUNDS)[:: self.sign]:
            if turn % 2:
                y = (y + self.sign * _digest(self.key, kind, a * b, turn, x)) % b
            else:
                x = (x + self.sign * _digest(self.key, kind, a * b, turn, y)) % a
        return x * b + y

    def walk(self, kind: str, value: int, a: int, b: int, valid: Callable[[int], bool]) -> int:
        """A permutation of the valid numbers among them; ``value`` is one."""
        value = self.number(kind, value, a, b)
        while not valid(value):
            value = self.number(kind, value, a, b)
        return value

    def digits(self, kind: str, digits: str, valid: Callable[[str], bool] = lambda _: True) -> str:
        n = len(digits)
        a, b = 10 ** (n // 2), 10 ** (n - n // 2)
        return f"{self.walk(kind, int(digits), a, b, lambda v: valid(f'{v:0{n}d}')):0{n}d}"

    def characters(self, kind: str, text: str) -> str:
        """Digits stay digits and letters letters of their case; their order is the format."""
        radix = [10 if c.isdigit() else 26 for c in text]
        half = len(text) // 2
        a, b, value = 1, 1, 0
        for i, (c, r) in enumerate(zip(text, radix, strict=True)):
            a, b = (a * r, b) if i < half else (a, b * r)
            value = value * r + (int(c) if r == 10 else ord(c.lower()) - 97)
        value = self.number(kind + "".join("d" if r == 10 else "a" for r in radix), value, a, b)
        out = []
        for c, r in zip(reversed(text), reversed(radix), strict=True):
            value, d = divmod(value, r)
            out.append(str(d) if r == 10 else chr((65 if c.isupper() else 97) + d))
        return "".join(reversed(out))


def luhn(digits: str) -> bool:
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def mod97(iban: str) -> int:
    return int("".join(str(_ALNUM.index(c.lower())) for c in iban[4:] + iban[:4])) % 97


def _filled(pattern: str, characters: Iterable[str], of: Callable[[str], bool]) -> str:
    """``pattern`` with the characters that ``of`` accepts replaced in turn."""
    new = iter(characters)
    return "".join(next(new) if of(c) else c for c in pattern)


def _alnum(c: str) -> bool:
    return c.isascii() and c.isalnum()


def _email(found: str, p: Permutation) -> str:
    return _filled(found, p.characters("email", "".join(filter(_alnum, found))), _alnum)


def _card(found: str, p: Permutation) -> str | None:
    digits = "".join(filter(str.isdigit, found))
    if not luhn(digits) or len(set(digits)) == 1:
        return None

    def completed(body: str) -> str:
        return next(body + c for c in "0123456789" if luhn(body + c))

    return _filled(found, completed(p.digits("card", digits[:-1], lambda b: len(set(completed(b))) > 1)), str.isdigit)


def _iban(found: str, p: Permutation) -> str | None:
    plain = found.replace(" ", "")
    if not 15 <= len(plain) <= 34 or mod97(plain) != 1 or not 2 <= int(plain[2:4]) <= 98:
        return None
    body = p.characters("iban" + plain[:2], plain[4:])
    return _filled(found, f"{plain[:2]}{98 - mod97(f'{plain[:2]}00{body}'):02d}{body}", _alnum)


def _valid_ssn(d: str) -> bool:
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def _ssn(found: str, p: Permutation) -> str | None:
    digits = found.replace("-", "")
    return _filled(found, p.digits("ssn", digits, _valid_ssn), str.isdigit) if _valid_ssn(digits) else None


def _valid_american(d: str) -> bool:
    return d[0] > "1" and d[3] > "1"


def _phone(found: str, p: Permutation) -> str | None:
    digits = "".join(filter(str.isdigit, found))
    american = len(digits) == 10 or (len(digits) == 11 and digits[0] == "1")
    if american and found[0] == "+" and digits[0] == "1":
        return _filled(found, "1" + p.digits("phone+1", digits[1:]), str.isdigit)
    if american and found[0] != "+":
        head, body = digits[:-10], digits[-10:]
        return _filled(found, head + p.digits("phone", body, _valid_american), str.isdigit) if _valid_american(body) else None
    if found[0] != "+" or not 8 <= len(digits) <= 15:
        return None
    code = len(re.match(r"\+(\d{1,3})", found)[1])
    return _filled(found, digits[:code] + p.digits("phone" + digits[:code], digits[code:]), str.isdigit)


def _phone_one(found: str, p: Permutation) -> str | None:
    return _phone(found, p) if found[1] == "1" else None


def _ipv4(found: str, p: Permutation) -> str | None:
    octets = found.split(".")
    if any(int(o) > 255 or (len(o) > 1 and o[0] == "0") for o in octets):
        return None
    value = p.number("ipv4", int.from_bytes(bytes(map(int, octets)), "big"), 1 << 16, 1 << 16)
    return ".".join(map(str, value.to_bytes(4, "big")))


def _date(found: str, p: Permutation) -> str | None:
    sign = re.search(r"\D", found)[0]
    a, b, c = map(int, found.split(sign))
    if found[4] == sign:
        order = "ymd"
    elif sign == ".":
        order = "dmy"
    else:
        order = "mdy" if a <= 12 else "dmy"

    def written(day: int) -> str:
        d = datetime.date.fromordinal(day)
        return sign.join(f"{d.year:04d}" if o == "y" else f"{d.month if o == 'm' else d.day:02d}" for o in order)

    try:
        parts = dict(zip(order, (a, b, c), strict=True))
        day = datetime.date(parts["y"], parts["m"], parts["d"]).toordinal()
    except ValueError:
        return None
    # a date with month and day in doubt stays such a date, so that the pseudonym is read in the same order
    def fits(v: int) -> bool:
        new = _FIRST_DAY + v
        return new <= _LAST_DAY and (order != "dmy" or sign == "." or datetime.date.fromordinal(new).day > 12)

    if not _FIRST_DAY <= day <= _LAST_DAY or not fits(day - _FIRST_DAY):
        return None
    return written(_FIRST_DAY + p.walk("date" + (order if sign == "/" else ""), day - _FIRST_DAY, 271, 271, fits))


def _secret(found: str, p: Permutation) -> str:
    n, upper = len(found), found.isupper()
    value = p.number(f"secret{n}", int(found, 16), 16 ** (n // 2), 16 ** (n - n // 2))
    return f"{value:0{n}x}".upper() if upper else f"{value:0{n}x}"


_NUMBERS: dict[str, Callable[[str, Permutation], str | None]] = {
    "iban": _iban, "ipv4": _ipv4, "date": _date, "ssn": _ssn, "phone+1": _phone_one, "phone": _phone, "card": _card,
}


class _Candidate(NamedTuple):
    """A place that has a format; in this order, what validates and is still free is taken."""

    unusual: bool
    start: int
    order: int
    odd: bool
    shorter: int
    end: int
    kind: str


_ORDER = {kind: i for i, kind in enumerate(_NUMBERS)}


def _candidates(text: str) -> list[_Candidate]:
    """Every place of every format, overlapping or not. Permuted values don't change them: patterns ask for digits, never for a certain one."""
    out, at = [], 0
    while m := NUMBER.search(text, at):
        start = m.start()
        at = start + 1
        for kind, pattern in _KINDS.items():
            if not (k := pattern.match(text, start)):
                continue
            if kind != "iban":
                out.append(_Candidate(False, start, _ORDER[kind], False, -k.end(), k.end(), kind))
                continue
            ends = [e for e in range(start + 15, k.end()) if text[e] == " "] + [k.end()]
            for e in ends:
                length = e - start - text.count(" ", start, e)
                if length >= 15 and _WHOLE_IBAN.fullmatch(text, start, e):
                    out.append(_Candidate(False, start, _ORDER[kind], length != _IBAN_LENGTHS.get(text[start : start + 2]), -e, e, kind))
        if _CARD_START.match(text, start):
            shape, end = [], start
            while (g := _GROUP.match(text, end + (end > start))) and sum(shape) + len(g[0]) <= 19:
                shape.append(len(g[0]))
                end = g.end()
                if sum(shape) >= 13 and _CARD_END.match(text, end):
                    out.append(_Candidate(tuple(shape) not in _CARD_SHAPES, start, _ORDER["card"], False, -end, end, "card"))
                if text[end : end + 1] not in (" ", "-"):
                    break
    return sorted(out)


def replace(text: str, p: Permutation) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with its personal values permuted, and (kind, start, end) of each."""
    found: list[tuple[int, int, str, str]] = []
    if "@" in text:
        found += [(m.start(1), m.end(1), "email", _email(m[1], p)) for m in EMAIL.finditer(text)]
    if any(c in text for c in "=:"):
        found += [(m.start(1), m.end(1), "secret", _secret(m[1], p)) for m in SECRET.finditer(text)]
    found += _numbers(text, [(a, z) for a, z, *_ in found], p)
    if not found:
        return text, []
    out, last = [], 0
    for a, z, _, new in sorted(found):
        out += [text[last:a], new]
        last = z
    return "".join([*out, text[last:]]), [(kind, a, z) for a, z, kind, _ in sorted(found)]


def _numbers(text: str, taken: list[tuple[int, int]], p: Permutation) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym) of the numbers outside ``taken``.

    A candidate that overlaps a value and comes before it in order must not validate once the value is
    permuted, or ``restore`` would take it instead: such a rival makes the walk go on. A step so is a
    permutation of the texts in which the same places are taken, and ``restore`` undoes the steps backwards.
    """
    candidates = _candidates(text)
    if not candidates:
        return []
    owner = {i: -1 for a, z in taken for i in range(a, z)} if taken else {}
    chosen: list[_Candidate] = []
    rivals: list[_Candidate] = []
    for c in candidates:
        if any(i in owner for i in range(c.start, c.end)):
            continue
        if _NUMBERS[c.kind](text[c.start : c.end], p) is None:
            rivals.append(c)
            continue
        owner.update(dict.fromkeys(range(c.start, c.end), len(chosen)))
        chosen.append(c)
    against: dict[int, list[_Candidate]] = {}
    for r in rivals:
        for i in {owner[j] for j in range(r.start, r.end) if owner.get(j, -1) >= 0}:
            against.setdefault(i, []).append(r)
    now = list(text) if against else []
    out = []
    for i in range(len(chosen))[:: p.sign]:
        c = chosen[i]
        new = _NUMBERS[c.kind](text[c.start : c.end], p)
        if against:
            now[c.start : c.end] = _cells(new, c)
            while any(_NUMBERS[r.kind]("".join(now[r.start : r.end]), p) is not None for r in against.get(i, ())):
                new = _NUMBERS[c.kind](new, p)
                now[c.start : c.end] = _cells(new, c)
        out.append((c.start, c.end, "phone" if c.kind == "phone+1" else c.kind, new))
    return out


def _cells(new: str, c: _Candidate) -> list[str]:
    """``new`` over the places of ``c``; an address may be longer or shorter, and none cuts through it."""
    n = c.end - c.start
    return list(new) if len(new) == n else [new] + [""] * (n - 1)


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
_RESULT = pa.struct([("text", pa.string()), ("spans", pa.list_(_SPAN))])
RESULT = "struct<text:string,spans:array<struct<kind:string,start:int,end:int>>>"


def _replacer(key: bytes, sign: int):
    @F.arrow_udf(RESULT)
    def run(texts: pa.Array) -> pa.Array:
        p, out = Permutation(key, sign), []
        for t in texts:
            text = t.as_py()
            new, spans = (None, []) if text is None else replace(text, p)
            out.append({"text": new, "spans": [{"kind": k, "start": a, "end": z} for k, a, z in spans]})
        return pa.array(out, _RESULT)

    return run.asNondeterministic()  # runs once, whatever reads its fields


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text", spans: str = "spans") -> DataFrame:
    """``docs`` with the text replaced, and a last column of what was found where.

    It is called ``spans``, followed by underscores where the input has a column of that name.
    """
    return _applied(docs, key, 1, text, spans)


def restore(docs: DataFrame, key: bytes, text: str = "text", spans: str = "spans") -> DataFrame:
    """Undoes ``pseudonymise`` under the same key; its last column says what it found."""
    return _applied(docs, key, -1, text, spans)


def _applied(docs: DataFrame, key: bytes, sign: int, text: str, spans: str) -> DataFrame:
    both = runtime.free_name(docs, "pii_made")
    made = docs.withColumn(both, _replacer(key, sign)(F.col(f"`{text}`")))
    columns = [F.col(f"{both}.text").alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    return made.select(*columns, F.col(f"{both}.spans").alias(runtime.free_name(docs, spans)))
