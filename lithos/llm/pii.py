"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, schemes and the cue
words of identifiers. At each anchor a local parser looks left and right for the
boundaries of what may stand there and validates it (labels of a domain, parts of an address,
check digits, lengths). Parsers never look at the same bytes twice for one kind, so
a text costs time in proportion to its length, however long it or a run in it is.

Spans of a kind are the leftmost that don't overlap; a span that fails its validation is dropped and
what it covered isn't looked at again for that kind. Spans of different kinds may overlap.

Base kinds:

    email    local part, at-sign, two or more labels
    ip       four numbers with dots between, each at most 255
    card     digits, single spaces or hyphens between, 12 to 19 digits that pass Luhn
    phone    plus sign, digits and punctuation, 9 to 15 digits

Kinds that cues add:

    account   after a cue such as "iban" or "account no": an IBAN that passes mod 97, or 6 to 20 digits
    identity  after a cue such as "ssn" or "passport": 5 to 13 digits, letters before and after
    secret    after a cue such as "token =" or "password:": a value with letters and digits
    url       after a scheme: an address with credentials in it, or one of a person's page
    address   house number and street in the order of English, German, French or Spanish

Edge cases: a null or empty text has no spans; repeated rows are judged alike; an empty table gives no rows; other
columns take no part (``redact`` hands them on).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from lithos.llm.arrow import id_and_bytes

BASE_KINDS = ("email", "ip", "card", "phone")
#: All kinds, in the order in which spans of one start are listed.
KINDS = (*BASE_KINDS, "account", "identity", "secret", "url", "address")
SPANS = "array<struct<kind: string, start: long, end: long>>"

#: Characters and cues.
_LOCAL = "abcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DIGITS = "0123456789"
_CUES = {
    "account": ("iban", "account", "acct", "konto", "kontonummer", "compte", "cuenta"),
    "identity": ("ssn", "social security", "passport", "reisepass", "passeport", "pasaporte", "tax id", "dni", "nif"),
    "secret": ("token", "password", "passwd", "passwort", "secret", "api_key", "api-key", "apikey", "access_key", "private_key", "auth_key"),
    "url": ("http://", "https://", "ftp://", "sftp://", "ssh://"),
    "before": ("street", "avenue", "road", "boulevard", "lane"),
    "inside": ("straße", "strasse"),
    "after": ("rue", "avenue", "boulevard", "calle", "avenida", "plaza"),
}

# parsers work on lower-cased bytes read as Latin-1, so that an offset is a byte; all classes are ASCII
_DOMAIN = re.compile(r"[a-z0-9-]+(?:\.[a-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])*")
_PHONE = re.compile(r"[0-9][ ().0-9-]*")
_NUMBER_WORD = re.compile(r"(?: ?(?:number|numero|nummer|num|no|nr|n)\.?)?[ :#=]{1,3}")
_IBAN = re.compile(r"[a-z]{2}[0-9]{2}(?: ?[a-z0-9]){11,30}")
_ACCOUNT = re.compile(r"[0-9](?:[ -]?[0-9]){5,19}(?![0-9])")
_IDENTITY = re.compile(r"[a-z]{0,2}[0-9](?:[ -]?[0-9]){4,12}[a-z]?(?![a-z0-9])")
_SECRET = re.compile(r"[\"']? {0,2}[:=] {0,2}([\"'`]?)([a-z0-9+/_.~!@#$%^&*=-]{8,})")
_AUTHORITY = re.compile(r"(?:[a-z0-9._~%!$&*+,;=-]+(?::[^\s/@]*)?@)?[a-z0-9-]+(?:\.[a-z0-9-]+)+(?::[0-9]{1,5})?")
_PATH = re.compile(r"[/?#][^\s\"'<>\\^`{|}\x80-\xff]*")
_PERSONAL = re.compile(r"/(?:~|@|u/|user/|users/|in/|profile/|people/)[a-z0-9._-]+")
_BEFORE = re.compile(r"(?<![a-z0-9])[0-9]{1,5}[a-z]? (?:[a-z\x80-\xff.'-]{1,40} ){1,3}$")
_INSIDE_LEFT = re.compile(r"[a-z\x80-\xff-]{2,40}[ -]?$")
_INSIDE_RIGHT = re.compile(r" [0-9]{1,5}[a-z]?(?![a-z0-9])")
_AFTER_LEFT = re.compile(r"(?<![a-z0-9])[0-9]{1,5}(?: bis| ter)?,? $")
_AFTER_RIGHT = re.compile(r"(?: (?:de|du|des|del|la|las|le|les|los))*(?: [a-z\x80-\xff'-]{2,40}){1,2}")
_AFTER_NUMBER = re.compile(r"(?:,| n\.?)? [0-9]{1,5}(?![a-z0-9])")
#: Bytes that are looked at to the left of a street's cue.
_LEFT = 160
_CONTINUATION = bytes(range(0x80, 0xC0))


def luhn(digits: str) -> bool:
    """True if the last digit is the check digit of the others."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_sound(code: str) -> bool:
    """True if an IBAN without spaces passes mod 97."""
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


@lru_cache(maxsize=1)
def anchors() -> ahocorasick.Automaton:
    """The automaton; the value of a pattern is the parsers to call and its length."""
    calls: dict[str, list[str]] = {"@": ["email"], "+": ["phone"]} | {d: ["digit"] for d in _DIGITS}
    for call, cues in _CUES.items():
        for cue in cues:
            calls.setdefault(cue.encode().decode("latin-1"), []).append(call)
    out = ahocorasick.Automaton()
    for pattern, names in calls.items():
        out.add_word(pattern, (tuple(names), len(pattern)))
    out.make_automaton()
    return out


class Scanner:
    """The spans of one text: (start, rank of the kind, end), offsets in bytes.

    ``low`` is the text with ASCII letters in lower case, one character a byte. For each kind ``upto`` is the
    end of what has been looked at.
    """

    def __init__(self, low: str, text: str):
        self.low, self.text = low, text
        self.upto = dict.fromkeys(KINDS, 0)
        self.found: list[tuple[int, int, int]] = []

    def put(self, kind: str, start: int, end: int) -> None:
        self.found.append((start, KINDS.index(kind), end))
        self.upto[kind] = end

    def email(self, at: int, _: int) -> None:
        floor = max(self.upto["email"], self.low.rfind("@", 0, at) + 1)
        start = floor + len(self.low[floor:at].rstrip(_LOCAL))
        # of no length if an e-mail address ends here or nothing stands before the sign
        if start < at and (m := _DOMAIN.match(self.low, at + 1)):
            self.put("email", start, m.end())

    def digit(self, at: int, _: int) -> None:
        if at >= self.upto["ip"]:
            m = _DOTTED.match(self.low, at)
            parts, i = m.group().split("."), at
            for k in range(0, len(parts) - 3, 4):
                four = parts[k : k + 4]
                end = i + sum(map(len, four)) + 3
                if all(len(p) <= 3 and int(p) <= 255 for p in (p.lstrip("0") or "0" for p in four)):
                    self.put("ip", i, end)
                i = end + 1
            self.upto["ip"] = m.end()
        if at >= self.upto["card"]:
            m = _CHAIN.match(self.low, at)
            digits = m.group().replace(" ", "").replace("-", "") if m.end() - at < 40 else ""
            if 12 <= len(digits) <= 19 and luhn(digits):
                self.put("card", at, m.end())
            self.upto["card"] = m.end()

    def phone(self, at: int, _: int) -> None:
        m = _PHONE.match(self.low, at + 1)
        if m is None:
            return
        said = m.group().rstrip(" ().-")
        # a digit, one character of any kind at least, a digit
        if len(said) >= 3 and 9 <= sum(map(said.count, _DIGITS)) <= 15:
            self.put("phone", at, at + 1 + len(said))

    def _word(self, start: int, end: int) -> bool:
        """True if what stands in start..end isn't part of a longer word."""
        before, after = self.low[start - 1 : start], self.low[end : end + 1]
        return not (before.isalnum() or before >= "\x80") and not (after.isalnum() or after >= "\x80")

    def _value(self, start: int, end: int) -> int:
        """Where the value after an account's or identity's cue starts; -1 without one."""
        if not self._word(start, end):
            return -1
        m = _NUMBER_WORD.match(self.low, end)
        return m.end() if m else -1

    def account(self, start: int, end: int) -> None:
        at = self._value(start, end)
        if at < self.upto["account"]:
            return
        m = _IBAN.match(self.low, at)
        # words may follow: the longest code that ends with a word and has the right check digits
        ends = [e for e in range(m.end(), at + 14, -1) if not self.low[e : e + 1].isalnum() and self.low[e - 1] != " "] if m else []
        end = next((e for e in ends if iban_sound(self.low[at:e].replace(" ", ""))), None)
        if end is None and (m := _ACCOUNT.match(self.low, at)):
            end = m.end()
        if end:
            self.put("account", at, end)

    def identity(self, start: int, end: int) -> None:
        at = self._value(start, end)
        if at >= self.upto["identity"] and (m := _IDENTITY.match(self.low, at)):
            self.put("identity", at, m.end())

    def secret(self, start: int, end: int) -> None:
        before = self.low[start - 1 : start]
        if start < self.upto["secret"] or (before.isalnum() and before < "\x80"):
            return
        m = _SECRET.match(self.low, end)
        if m and any(c.isdigit() for c in m.group(2)) and any(c.isalpha() for c in m.group(2)):
            self.put("secret", m.start(2), m.end())

    def url(self, start: int, end: int) -> None:
        if start < self.upto["url"]:
            return
        m = _AUTHORITY.match(self.low, end)
        if m is None:
            return
        path = _PATH.match(self.low, m.end())
        stop = m.end() + len(path.group().rstrip(".,;:!?)]")) if path else m.end()
        if "@" in m.group() or (path and _PERSONAL.match(self.low, m.end())):
            self.put("url", start, stop)

    def _street(self, start: int, end: int, first: int, word: int) -> None:
        """An address whose name's first letter stands at ``word`` and is a capital."""
        if start >= self.upto["address"] and self.text[word : word + 1].isupper():
            self.put("address", first, end)

    def before(self, start: int, end: int) -> None:
        if self._word(start, end) and (m := _BEFORE.search(self.low[max(0, start - _LEFT) : start])):
            first = max(0, start - _LEFT) + m.start()
            self._street(first, end, first, first + m.group().index(" ") + 1)

    def inside(self, start: int, end: int) -> None:
        left = self.low[max(0, start - _LEFT) : start]
        m, number = _INSIDE_LEFT.search(left), _INSIDE_RIGHT.match(self.low, end)
        if m and number:
            first = max(0, start - _LEFT) + m.start()
            self._street(first, number.end(), first, first)

    def after(self, start: int, end: int) -> None:
        if not self._word(start, end):
            return
        left = max(0, start - _LEFT)
        m, name = _AFTER_LEFT.search(self.low[left:start]), _AFTER_RIGHT.match(self.low, end)
        if name is None:
            return
        number = None if m else _AFTER_NUMBER.match(self.low, name.end())
        if m or number:
            first = left + m.start() if m else start
            self._street(first, number.end() if number else name.end(), first, end + 1 + name.group().rfind(" "))


def spans(data: bytes | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of a text's UTF-8 bytes, in code points, by start and then kind."""
    if not data:
        return []
    scanner = Scanner(data.lower().decode("latin-1"), data.decode("latin-1"))
    for last, (names, n) in anchors().iter(scanner.low):
        start = last + 1 - n
        for name in names:
            getattr(scanner, name)(start, last + 1)
    if not scanner.found:
        return []
    places, chars, upto = {}, 0, 0
    for at in sorted({x for s in scanner.found for x in (s[0], s[2])}):
        chars += len(data[upto:at].translate(None, _CONTINUATION))
        places[at], upto = chars, at
    return [(KINDS[kind], places[start], places[end]) for start, kind, end in sorted(scanner.found)]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) for each row; spans are in code points, ends exclusive, by start and then kind."""
    id_type = docs.schema[id_col].dataType.simpleString()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in spans(x.as_py())] for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], names=["doc_id", "spans"])

    return id_and_bytes(docs, id_col, text_col).mapInArrow(run, f"doc_id {id_type}, spans {SPANS}")


def masked(text: str, found: list[tuple[str, int, int]]) -> str:
    """``text`` with each span as its kind in angle brackets; of spans that overlap, the first one's kind for all."""
    out, upto = [], 0
    for kind, start, end in found:
        if start >= upto:
            out += [text[upto:start], f"<{kind}>"]
        upto = max(upto, end)
    return "".join([*out, text[upto:]])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each span in its text as the kind's name; null texts stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            new = [None if s is None else masked(s, spans(s.encode())) for s in (x.as_py() for x in batch.column(at))]
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
