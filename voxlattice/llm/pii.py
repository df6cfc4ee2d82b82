"""Surrogates for personal data: keyed, consistent in type and format, distinct for distinct originals.

Kinds: e-mail addresses, telephone numbers, IPv4 addresses, payment cards (Luhn-valid), social security numbers, IBANs
(mod-97-valid), secrets (tokens, keys, passwords) and persons named after a form of address.

Numbers and identifiers go through a keyed permutation of all strings of their format (letters stay letters of the
same case and script, digits digits, punctuation stays, check digits are made anew): a Feistel network on the format's
index, without fixed points. A permutation is injective, so two different originals never share a surrogate. One number
written in several ways has one surrogate, written in the same ways.

Persons are handled by the words of their names: each word gets a word that fits gender and script, made from the key
and the word, so that a family name alone is tied to the full name. The gender is that of the mention's own form of
address; a bare mention takes it from the last one before it. A word found after a form of address is replaced wherever
it stands in that document. Particles (van, de) stay; initials get initials.

The collision check: the corpus's distinct originals are gathered exactly as they are replaced, and those whose
surrogate is shared, or is itself an original of the corpus, are re-keyed until none is (names grow by a syllable each
time). Formats of which the corpus uses more than a quarter keep their first permutation, which may give another
original. The same original always gets the same surrogate under one key and corpus.

Defined results: null text stays null with 0 entities; texts without entities stay as they are; repeated rows get
equal results; overlapping finds are resolved by the earlier start, then the longer; digits other than 0-9 are no numbers;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from itertools import pairwise

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlattice.llm.scratch import discard, staged

#: Forms of address by gender, and those of either.
MALE = "Mr Mister Sir Lord Herr Herrn Monsieur Señor Sr Signor Don MR HERR господин Господин г-н Г-н κύριος Κύριος κύριε Κύριε κος Κος".split()
FEMALE = "Mrs Ms Miss Lady Dame Madam Frau Fräulein Madame Mademoiselle Mme Mlle Señora Sra Señorita Srta Signora Doña MRS FRAU госпожа Госпожа г-жа Г-жа κυρία Κυρία κα Κα".split()
EITHER = "Dr Doctor Prof Professor Mx DR PROF доктор Доктор профессор Профессор δρ Δρ".split()
#: Words of names that say nothing about whose they are.
PARTICLES = "van von der den de du des del della di da dos la le zu zur ter ten bin ibn al el y e".split()
#: How surrogate names are built, by script: beginnings, middles, and endings by gender.
SYLLABLES = {
    "Latin": ("Al Ber Cor Dan El Fer Gal Har Ir Jor Kal Lor Mar Nor Or Pal Quin Ros Sal Tor Ul Val Wil Yor".split(), "a be co di e fi go la me ni ro sa ti ve".split(), ("dan ric mus bert ton vin".split(), "lia nna ssa rine tta belle".split())),
    "Cyrillic": ("Бор Вал Гор Дар Ев Зах Иг Кор Лев Мар Ник Ор Пав Ром Сав Тих".split(), "а ве и ко ла ми ни ро са ти".split(), ("слав мир дан тин лий".split(), "слава мира дана тина лия".split())),
    "Greek": ("Αλ Βασ Γερ Δαμ Ερ Ζαν Ηλ Θε Ιασ Καλ Λαμ Μαρ Νικ Ορ".split(), "α ε ι ο λα μι νο ρα".split(), ("νος ρης δης".split(), "να ρα δα".split())),
}
#: Alphabets inside which characters are exchanged; capitals follow their small letters.
ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω")
#: How telephone country codes of one and two digits begin; all others have three.
_SHORT_CODES = re.compile(r"[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]")
#: How well-known secrets begin.
_MARKED = r"AKIA|ASIA|gh[pousr]_|sk-|xox[abprs]-|AIza|eyJ"

_PLACE = {c: (radix, i) for radix, letters in enumerate(ALPHABETS) for i, c in enumerate(letters)}
_ADDRESS = "|".join(regex.escape(x) for x in sorted(MALE + FEMALE + EITHER, key=len, reverse=True))
_SP = r"[^\S\n\r]{1,2}"
_WORD = r"\p{Lu}(?:\p{M}|\p{L}|['’](?=\p{Lu}))++"
_INITIAL = r"\p{Lu}\."
_SMALL = rf"(?:(?:{'|'.join(PARTICLES)}){_SP}){{0,3}}"
_TOKEN = rf"(?!(?:{_ADDRESS})(?![\p{{L}}\p{{N}}]))(?:{_WORD}|{_INITIAL})"
_PERSON = regex.compile(rf"(?<![\p{{L}}\p{{N}}])(?P<address>(?:(?:{_ADDRESS})(?:\.\s{{0,3}}|\s{{1,3}})){{1,4}})(?P<name>{_SMALL}{_TOKEN}(?:(?:{_SP}|[-‐]|(?<=\.)){_SMALL}{_TOKEN})*+)")
_TOKENS = regex.compile(rf"(?<![\p{{L}}\p{{N}}])(?:{_WORD}|{_INITIAL})")
_BETWEEN = regex.compile(rf"(?:{_SP}|[-‐]){_SMALL}")
#: What a text must hold to be looked at.
TRIGGER = rf"@|[0-9][^\n]{{0,9}}[0-9]|(?i:token|secret|key|passw|pwd)|{_MARKED}|(?:{_ADDRESS.replace(chr(92) + '-', '-')})"

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_GAP = r"[^\w\n]{1,8}"
_EMAIL = re.compile(r"(?<![\w.%+-])\w[\w.%+-]{0,63}@[^\W_][\w-]{0,62}(?:\.[\w-]{1,63})*\.[^\W\d_][\w-]{1,62}")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_NUMBER = re.compile(
    rf"(?P<ip>(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?[0-9]))"
    rf"|(?P<phone>(?<![\w+])\+[0-9]{{1,3}}{_GAP}\(?[0-9]{{2,4}}\)?{_GAP}[0-9]{{3}}{_GAP}?[0-9]{{4}}(?![0-9])"
    r"|(?<![\w+])\+[0-9](?:[^\S\n]?[(]?[ ./)-]{0,2}[0-9]){7,14}(?![0-9])"
    r"|(?<![\w(])\([0-9]{3}\) ?[0-9]{3}[-. ][0-9]{4}(?![0-9])"
    r"|(?<![\w.+/-])[0-9]{3}([-. ])[0-9]{3}\3[0-9]{4}(?![\w-]|\.[0-9])"
    r"|(?<![\w.,+/-])(?=(?:[ /-]?[0-9]){9,12}(?![\w/-]|[ .,]?[0-9]))0[0-9]{1,4}[ /-][0-9]{2,4}(?:[ -]?[0-9]{2,4}){1,3}(?![\w/-]|[ .,]?[0-9]))"
    r"|(?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))"
    r"|(?P<card>(?<![\w.-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9]))"
)
_SECRET = re.compile(
    r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----(?P<block>[A-Za-z0-9+/=\s]+)-----END"
    rf"|(?<!\w)(?P<marked>(?:{_MARKED})[A-Za-z0-9_.-]{{10,}})"
    r"""|(?i:\b(?:token|secret|api[_ -]?key|access[_ -]?key|private[_ -]?key|password|passwd|pwd)\b)[^\w\n]{0,6}[=:][^\w\n]{0,8}(?P<value>(?<=")[^"\s]{8,}(?=")|(?<=')[^'\s]{8,}(?=')|[^\s"'<>,;|]{8,})"""
)
_SECRET_HINT = re.compile(rf"(?i:token|secret|key|passw|pwd)|{_MARKED}")
KINDS = ("email", "ip", "iban", "phone", "ssn", "card", "secret", "person")
_CHUNK = 48


@dataclass(frozen=True)
class Entity:
    """``parts``: what is replaced inside: (kind, canonical original, start, end). Only persons have several."""

    kind: str
    start: int
    end: int
    original: str
    parts: tuple[tuple[str, str, int, int], ...]


def luhn(digits: str) -> bool:
    return _luhn_sum(digits) % 10 == 0


def _luhn_sum(digits: str) -> int:
    twice = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
    return sum(twice[int(d)] if i % 2 else int(d) for i, d in enumerate(reversed(digits)))


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def canonical(kind: str, value: str) -> str:
    """One string for all ways to write an original."""
    if kind == "email":
        return value.lower()
    if kind in ("card", "ssn"):
        return re.sub(r"[^0-9]", "", value)
    if kind == "phone":
        digits = re.sub(r"[^0-9]", "", value)
        if not value.startswith("+"):
            return digits
        short = _SHORT_CODES.match(digits)
        code = len(short.group()) if short else 3
        return f"+{digits[:code]}|{digits[code:]}"
    return value.replace(" ", "") if kind == "iban" else value


def _shorter(value: str, good, least: int) -> int:
    """Length of the longest beginning of ``value``, cut between groups, whose bare characters are ``good``; or 0."""
    ends = [len(value), *(i for i in range(len(value) - 1, 0, -1) if value[i] in " -")]
    for end in ends:
        bare = value[:end].replace(" ", "").replace("-", "")
        if len(bare) < least:
            break
        if good(bare):
            return end
    return 0


def _card(digits: str) -> bool:
    return len(digits) <= 19 and luhn(digits) and not (len(digits) == 13 and digits.startswith(("978", "979"))) and len(set(digits)) > 1


def _formatted(text: str) -> list[Entity]:
    found = []

    def add(kind: str, start: int, end: int) -> None:
        value = text[start:end]
        found.append(Entity(kind, start, end, value, ((kind, canonical(kind, value), start, end),)))

    if "@" in text:
        for m in _EMAIL.finditer(text):
            add("email", *m.span())
    for m in _NUMBER.finditer(text):
        kind, (start, end) = next(k for k in ("ip", "phone", "ssn", "card") if m.group(k) is not None), m.span()
        if kind == "card":
            end = start + _shorter(m.group(), _card, 13)
        if end > start:
            add(kind, start, end)
    for m in _IBAN.finditer(text):
        if n := _shorter(m.group(), lambda v: len(v) <= 34 and _mod97(v) == 1, 15):
            add("iban", m.start(), m.start() + n)
    if _SECRET_HINT.search(text):
        for m in _SECRET.finditer(text):
            name = next(k for k in ("block", "marked", "value") if m.group(k) is not None)
            value = m.group(name)
            if any("0" <= c <= "9" for c in value) and any(c.isalpha() for c in value):
                add("secret", *m.span(name))
    return found


def _persons(text: str) -> list[Entity]:
    """Names after forms of address, and all other mentions of their words."""
    said: dict[str, list[tuple[int, str]]] = {}
    for m in _PERSON.finditer(text):
        words = regex.split(r"[\s.]+", m.group("address"))
        sex = next((s for w in words for s, group in (("m", MALE), ("f", FEMALE)) if w in group), "n")
        for t in _TOKENS.finditer(text, *m.span("name")):
            if not t.group().endswith("."):
                said.setdefault(t.group().casefold(), []).append((t.start(), sex))
    if not said:
        return [_person(text, [(t, "n")]) for m in _PERSON.finditer(text) for t in _TOKENS.finditer(text, *m.span("name"))]
    titled = [m.span("name") for m in _PERSON.finditer(text)]
    ends = [b for _, b in titled]

    def sex_at(word: str, at: int) -> str:
        mentions = said[word]
        known = [x for x in mentions if x[1] != "n"] or mentions
        own = mentions[max(0, bisect_right(mentions, (at, "~")) - 1)]
        if own[0] == at and own[1] != "n":
            return own[1]
        return known[max(0, bisect_right(known, (at, "~")) - 1)][1]

    tokens: list[tuple[regex.Match, str]] = []
    out: list[Entity] = []
    for t in _TOKENS.finditer(text):
        word, i = t.group().casefold(), bisect_right(ends, t.start())
        inside = i < len(titled) and titled[i][0] <= t.start()
        if t.group().endswith("."):
            if not inside:
                continue
            sex = "n"
        elif word in said:
            sex = sex_at(word, t.start())
        else:
            continue
        if tokens and (_BETWEEN.fullmatch(text, tokens[-1][0].end(), t.start()) or inside and titled[i][0] <= tokens[-1][0].start()):
            tokens.append((t, sex))
        else:
            if tokens:
                out.append(_person(text, tokens))
            tokens = [(t, sex)]
    if tokens:
        out.append(_person(text, tokens))
    return out


def _person(text: str, tokens: list) -> Entity:
    start, end = tokens[0][0].start(), tokens[-1][0].end()
    parts = tuple(("initial" if t.group().endswith(".") else "person", f"{sex}:{t.group().casefold()}", *t.span()) for t, sex in tokens)
    return Entity("person", start, end, text[start:end], parts)


def detect(text: str) -> list[Entity]:
    """Entities in order, without overlap: the earlier start wins, then the longer."""
    out: list[Entity] = []
    for e in sorted(_formatted(text), key=lambda e: (e.start, -e.end)):
        if not out or e.start >= out[-1].end:
            out.append(e)
    persons = _persons(text)
    if not persons:
        return out
    starts, ends = [e.start for e in out], [e.end for e in out]
    free = [p for p in persons if bisect_left(starts, p.end) == bisect_right(ends, p.start)]
    return sorted(out + free, key=lambda e: e.start)


def script(name: str) -> str:
    for known in ("Cyrillic", "Greek"):
        if regex.search(rf"\p{{{known}}}", name):
            return known
    return "Latin"


def _ip_number(value: str) -> int:
    return int.from_bytes(bytes(map(int, value.split("."))), "big")


def _ip_block(n: int) -> tuple[int, int] | None:
    """First address and bits of the private block that an address is in."""
    return next((b for b in ((0x0A000000, 24), (0x7F000000, 24), (0xC0A80000, 16), (0xAC100000, 20)) if n >> b[1] == b[0] >> b[1]), None)


class Surrogates:
    """The keyed mapping of originals to surrogates; ``attempt`` counts how often an original was re-keyed."""

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, tweak: bytes, i: int, half: int, bits: int) -> int:
        data = b"%d|%d|%d|" % (len(tweak), i, bits) + tweak + half.to_bytes((bits + 7) // 8, "big")
        return int.from_bytes(hashlib.shake_256(self.key + data).digest((bits + 7) // 8), "big") & ((1 << bits) - 1)

    def _permute(self, tweak: bytes, x: int, size: int, backwards: bool = False) -> int:
        """A keyed permutation of range(size): balanced Feistel on enough bits, walked back into the range.

        The index space is less than four times the range, so the walk is expected to end within four steps; it does end, as
        the permutation leads back to where it began.
        """
        bits = max(1, ((size - 1).bit_length() + 1) // 2)
        mask = (1 << bits) - 1
        while True:
            left, right = x >> bits, x & mask
            for i in reversed(range(8)) if backwards else range(8):
                if backwards:
                    left, right = right ^ self._round(tweak, i, left, bits), left
                else:
                    left, right = right, left ^ self._round(tweak, i, right, bits)
            x = left << bits | right
            if x < size:
                return x

    def _moved(self, kind: str, x: int, size: int) -> int:
        """A permutation without fixed points: one step along a keyed cycle through the whole range."""
        tweak = f"{kind}|{size}".encode()
        return self._permute(tweak, (self._permute(tweak, x, size) + 1) % size, size, backwards=True)

    def by_format(self, kind: str, value: str, fixed: int = 0) -> str:
        """Every letter and digit to one of its own alphabet and case; the rest and the first ``fixed`` characters stay.

        Long values go chunk by chunk, each permuted under what came before it, so the whole stays injective.
        """
        out, passed = [value[:fixed]], hashlib.blake2b(digest_size=16)
        for a in range(fixed, len(value), _CHUNK):
            chunk = value[a : a + _CHUNK]
            out.append(self._chunk(f"{kind}|{passed.hexdigest() if a > fixed else ''}", chunk))
            passed.update(chunk.encode("utf-8", "surrogatepass"))
        return "".join(out)

    def _chunk(self, kind: str, value: str) -> str:
        places = [_PLACE.get(c) or _PLACE.get(c.lower()) for c in value]
        shape = "".join(c if p is None else f"\0{p[0]}{c.lower() != c}" for c, p in zip(value, places, strict=True))
        size, x = 1, 0
        for p in places:
            if p:
                x = x * len(ALPHABETS[p[0]]) + p[1]
                size *= len(ALPHABETS[p[0]])
        if size == 1:
            return value
        x, out = self._moved(f"{kind}|{shape}", x, size), []
        for c, p in zip(reversed(value), reversed(places), strict=True):
            if p:
                letters = ALPHABETS[p[0]]
                x, d = divmod(x, len(letters))
                c = letters[d].upper() if c != c.lower() else letters[d]
            out.append(c)
        return "".join(reversed(out))

    def _hex(self, kind: str, value: str) -> str:
        letters = "0123456789abcdef" if value == value.lower() else "0123456789ABCDEF"
        n = self._moved(f"{kind}|hex|{len(value)}|{letters[-1]}", int(value, 16), 16 ** len(value))
        return "".join(letters[(n >> 4 * k) & 15] for k in reversed(range(len(value))))

    def name(self, value: str, attempt: int = 0) -> str:
        """``value``: gender, colon, one word of a name. Every attempt adds a syllable: there are names for any number of originals."""
        sex, _, word = value.partition(":")
        first, middle, last = SYLLABLES[script(word)]
        h = int.from_bytes(hashlib.shake_256(self.key + f"person|{value}|{attempt}".encode()).digest(32 + attempt), "big")
        h, a = divmod(h, len(first))
        out = first[a]
        for _ in range(2 + attempt):
            h, b = divmod(h, len(middle))
            out += middle[b]
        ends = {"m": last[0], "f": last[1]}.get(sex) or [*last[0], *last[1]]
        return out + ends[h % len(ends)]

    def _ip(self, kind: str, value: str) -> str:
        """Private addresses inside their own block, public ones among the public."""
        n = _ip_number(value)
        if own := _ip_block(n):
            m = own[0] + self._moved(f"{kind}|{own[0]}", n - own[0], 1 << own[1])
        else:
            m = self._moved(kind, n, 1 << 32)
            while _ip_block(m):  # less than one in a hundred
                m = self._moved(kind, m, 1 << 32)
        return ".".join(map(str, m.to_bytes(4, "big")))

    def of(self, kind: str, value: str, attempt: int = 0) -> str:
        """The canonical surrogate of a canonical original."""
        tweak = f"{kind}|{attempt}"
        if kind == "person":
            return self.name(value, attempt)
        if kind == "initial":
            return self.by_format(kind, value.partition(":")[2])
        if kind == "ip":
            return self._ip(tweak, value)
        if kind == "email":
            # The top-level label stays.
            local, _, host = value.partition("@")
            host, _, top = host.rpartition(".")
            return f"{self.by_format(tweak, local + '@' + host)}.{top}"
        if kind == "card":
            body = self.by_format(tweak, value[:-1])
            return body + str(-_luhn_sum(body + "0") % 10)
        if kind == "iban":
            body = self.by_format(tweak, value[4:])
            return f"{value[:2]}{98 - _mod97(value[:2] + '00' + body):02d}{body}"
        if kind == "phone":
            return self.by_format(tweak, value, value.find("|") + 1)
        if kind == "secret":
            if re.fullmatch(r"[0-9a-f]{8,128}|[0-9A-F]{8,128}", value):
                return self._hex(tweak, value)
            marked = re.match(_MARKED, value)
            out = self.by_format(tweak, value, marked.end() if marked else 0)
            for _ in range(64):  # what is not hexadecimal stays so; of 8 characters and more hardly one in a hundred is
                if not re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", out):
                    break
                out = self.by_format(tweak, out, marked.end() if marked else 0)
            return out
        return self.by_format(tweak, value)


def room(kind: str, value: str) -> tuple[str, float]:
    """(format, how many originals it has): what a permutation can choose from."""
    shape = "".join(c if (p := _PLACE.get(c) or _PLACE.get(c.lower())) is None else str(p[0]) + "+" * (c.lower() != c) for c in value[:_CHUNK])
    size = 1.0
    for c in value[:_CHUNK]:
        if p := _PLACE.get(c) or _PLACE.get(c.lower()):
            size *= len(ALPHABETS[p[0]])
    if kind == "phone" and "|" in value:
        code = value.partition("|")[0]
        return code + shape[len(code) :], size / 10.0 ** (len(code) - 1)
    if kind == "email":
        top = value.rpartition(".")[2]
        return f"{shape}|{top}", size / 26.0 ** len(top)
    if kind == "iban":
        return value[:2] + shape, size / 67600.0
    if kind == "ip":
        first, bits = _ip_block(_ip_number(value)) or (0, 32)
        return str(first), float(1 << bits)
    return shape, size / 10.0 if kind == "card" else size


def dress(kind: str, value: str, surrogate: str) -> str:
    """A canonical surrogate written as ``value`` is."""
    if kind == "person":
        return surrogate.upper() if value.isupper() else surrogate
    if kind == "initial":
        return surrogate.upper()
    if kind == "email":
        return "".join(s.upper() if c != c.lower() else s for c, s in zip(value, surrogate, strict=True))
    if kind in ("card", "ssn", "phone"):
        digits = iter(re.sub(r"[^0-9]", "", surrogate))
        return "".join(next(digits) if "0" <= c <= "9" else c for c in value)
    if kind == "iban":
        chars = iter(surrogate)
        return "".join(c if c == " " else next(chars) for c in value)
    return surrogate


def replace(text: str, surrogates: Surrogates, attempts: dict[str, int] | None = None) -> tuple[str, list[Entity]]:
    found, out, at = detect(text), [], 0
    for e in found:
        for kind, value, start, end in e.parts:
            new = surrogates.of(kind, value, (attempts or {}).get(f"{kind}|{value}", 0))
            out += [text[at:start], dress(kind, text[start:end], new)]
            at = end
    return "".join([*out, text[at:]]), found


def _due(texts: pa.Array) -> list[int]:
    """Places of the texts that need a look."""
    return pc.indices_nonzero(pc.fill_null(pc.match_substring_regex(texts, TRIGGER), False)).to_pylist()


def mentions(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(h, kind, original, format, room)``: what each text with entities names; ``h`` is the text's SHA-256."""

    def run(batches):
        for batch in batches:
            out = [[], [], [], [], []]
            texts = batch.column("text")
            for i in _due(texts):
                text = texts[i].as_py()
                parts = {(k, v) for e in detect(text) for k, v, _, _ in e.parts if k != "initial"}
                h = hashlib.sha256(text.encode()).hexdigest() if parts else ""
                for kind, value in sorted(parts):
                    fmt, size = ("", 0.0) if kind == "person" else room(kind, value)
                    for column, x in zip(out, (h, kind, value, fmt, size), strict=True):
                        column.append(x)
            types = [pa.string()] * 4 + [pa.float64()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["h", "kind", "original", "format", "room"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "h string, kind string, original string, format string, room double")


def rekeyed(found: DataFrame, key: bytes) -> DataFrame:
    """``(kind, original, attempt)`` of the originals in ``found(kind, original, format, room)`` that are re-keyed.

    Distinct originals -> surrogates -> those shared by several, or equal to an original. All but the least
    original of a shared surrogate are re-keyed, round by round, until nothing is left. Names grow with every round and
    other formats have at least three times as many free values as originals, so the rounds end.
    """

    def surrogate(batches):
        s = Surrogates(key)
        for b in batches:
            kinds, values, attempts = (b.column(i).to_pylist() for i in range(3))
            out = [s.of(k, v, a) for k, v, a in zip(kinds, values, attempts, strict=True)]
            out = [x.casefold() if k == "person" else x for k, x in zip(kinds, out, strict=True)]
            yield pa.record_batch([*b.columns[:3], pa.array(out, pa.string())], names=["kind", "original", "attempt", "surrogate"])

    originals = staged(found.groupBy("kind", "original").agg(F.first("format").alias("format"), F.first("room").alias("room")), "originals")
    crowded = originals.where("kind <> 'person'").groupBy("kind", "format").agg(F.count(F.lit(1)).alias("n"), F.first("room").alias("room")).where("n * 4 > room")
    open_ = originals.join(crowded.select("kind", "format"), ["kind", "format"], "left_anti")
    # A name's word without its gender, as surrogates are.
    bare = F.when(F.col("kind") == "person", F.substring("original", 3, 1 << 20)).otherwise(F.col("original"))
    taken = originals.select(F.col("kind").alias("k"), bare.alias("s")).distinct()
    current = staged(open_.select("kind", "original", F.lit(0).alias("attempt")), "attempts")
    while True:
        given = staged(current.mapInArrow(surrogate, "kind string, original string, attempt int, surrogate string"), "surrogates")
        shared = given.groupBy("kind", "surrogate").agg(F.min("original").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select("kind", "surrogate", "least")
        real = given.join(taken, F.expr("kind = k and surrogate = s"), "left_semi").select("kind", "surrogate").distinct().withColumn("real", F.lit(True))
        due = given.join(shared, ["kind", "surrogate"], "left").join(real, ["kind", "surrogate"], "left")
        due = due.withColumn("due", F.coalesce("real", F.lit(False)) | F.coalesce(F.col("least") != F.col("original"), F.lit(False)))
        due = staged(due.select("kind", "original", "attempt", "due"), "attempts")
        discard(given)
        if due.where("due").isEmpty():
            discard(originals)
            return due.where("attempt > 0").select("kind", "original", "attempt")
        current = due.select("kind", "original", (F.col("attempt") + F.col("due").cast("int")).alias("attempt"))


def surrogate_texts(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_entities, kinds, text``: every row, its text with surrogates in place of what was found.

    ``kinds`` maps each kind found to its number.
    """
    found = staged(mentions(docs, text_col), "mentions")
    again = rekeyed(found, key)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if again.isEmpty():
        rows = rows.withColumn("again", F.lit(None).cast("map<string,int>"))
    else:
        # Texts that mention something re-keyed get its attempt through a join, whatever their number.
        mine = found.select("h", "kind", "original").distinct().join(again, ["kind", "original"])
        mine = mine.groupBy("h").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "kind", "original").alias("k"), "attempt"))).alias("again"))
        rows = rows.join(staged(mine, "again"), F.sha2(F.col("text").cast("binary"), 256) == F.col("h"), "left").drop("h")
    discard(found)

    def run(batches):
        s = Surrogates(key)
        for batch in batches:
            texts, n, kinds = batch.column("text"), [0] * batch.num_rows, [[] for _ in range(batch.num_rows)]
            changed = {}
            for i in _due(texts):
                again = batch.column("again")[i].as_py()
                text, ents = replace(texts[i].as_py(), s, dict(again) if again else None)
                if ents:
                    changed[i], n[i] = text, len(ents)
                    kinds[i] = [(k, sum(e.kind == k for e in ents)) for k in KINDS if any(e.kind == k for e in ents)]
            if changed:
                at = [0, *(j for i in sorted(changed) for j in (i, i + 1)), batch.num_rows]
                parts = [pa.array([changed[a]], pa.string()) if a in changed else texts.slice(a, b - a) for a, b in pairwise(at) if a < b]
                texts = pa.concat_arrays([p.cast(pa.string()) for p in parts])
            yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int32()), pa.array(kinds, pa.map_(pa.string(), pa.int32())), texts], names=["doc_id", "n_entities", "kinds", "text"])

    return rows.mapInArrow(run, "doc_id long, n_entities int, kinds map<string,int>, text string")


def key_from(secret: str) -> bytes:
    return hashlib.sha256(secret.encode()).digest()
