"""Privacy: detected entities are replaced by keyed, type-consistent surrogates.

An entity's surrogate is a keyed permutation of all strings of its type and
format: digits stay digits, letters stay letters of their script and kind
(vowels and consonants in names, whose gender-marking end is kept), a valid
check digit stays valid, a public address stays public. The permutation is a
Feistel network on the mixed-radix number that the format's characters spell,
walked until the result is in the domain. It is conjugated with a shift by one,
which has no fixed point, so no entity is its own surrogate (a name without any
letter that has others of its kind in its block would be; no script is such).

So the same entity has the same surrogate in every document and spelling
(coreference: case of mail addresses, punctuation and prefix of phone numbers, spaces of
account numbers are rendered as they were), and different entities never share one
(distinctness): the map is injective without any table, so there is nothing to shuffle
and no state to lose. A surrogate can be what another entity was called; that one
has a surrogate of its own then, so they stay apart. ``collisions`` checks what was written
for a corpus: one surrogate an entity, one entity a surrogate.

Defined cases: null text stays null; empty text stays empty; a text without
entities is returned as it is; very long texts and entities are handled whole; of
overlapping entities the earlier type counts, then the longer, then the first; entities
never cross documents; repeated rows are rewritten alike; an empty table gives an empty
result; other columns are kept, whatever their names.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import re
import unicodedata
import warnings
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.storage import ship

KEY = b"lorekeep-demonstration-key"
ROUNDS = 8
TYPES = ("email", "secret", "iban", "ip", "birth", "address", "card", "ssn", "phone", "name")

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
HEX, HEX_UPPER = "0123456789abcdef", "0123456789ABCDEF"
#: Letters that names are rebuilt from, by script and kind; ``letters`` has the others.
KINDS = ("aeiou", "bcdfghjklmnpqrstvwxyz", "áéíóúàèìòùâêîôûäëïöü", "çñ", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ")

LOCAL_SIGNS = frozenset("._%+-")
EMAIL_DOMAIN = re.compile(r"(?:[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}")
#: Stretches of numbers; in them each format is matched by its own pattern.
NUMBER = re.compile(r"(?<!\w)(?<!\d\.)(?:\+?\d|\(\d)[\d ().\-]{5,}\d(?!\w)")
BEGIN = re.compile(r"(?<!\w)(?<!\d\.)(?:\+|\()?\d")
SSN = re.compile(r"\d{3}-\d{2}-\d{4}(?!\w|-\d)")
CARD = re.compile(r"\d{13,19}(?!\w)")
CARD_GROUPS = re.compile(r"\d{4}(?:(?: {1,2}|-)\d{2,6})+(?!\w)")
#: Two years or more in a row, which are neither a card nor a phone number.
YEARS = re.compile(r"(?:19|20)\d\d(?:[ \-](?:19|20)\d\d)+(?!\w|[ \-]{1,2}\d)")
FOURS = re.compile(r"\d{4}(?:(?: {1,2}|-)\d{4})+(?!\w)")
THREE_THREE_FOUR = re.compile(r"(?:\+?1(?: {1,2}|[.\-]))?(?:\(\d{3}\) {0,2}|\d{3}(?: {1,2}|-))\d{3}(?: {1,2}|-)\d{4}(?!\w|-\d)|(?:\+?1[.\- ])?\d{3}\.\d{3}\.\d{4}(?!\w|\.\d)")
INTERNATIONAL = re.compile(r"\+\d+(?:[ .\-]{0,2}\(\d{1,5}\)[ .\-]{0,2}\d*)?(?:(?: {1,2}|[.\-])\d+)*(?!\w)")
BRACKETED = re.compile(r"\(\d{1,5}\)[ .\-]{0,2}\d+(?:(?: {1,2}|[.\-])\d{2,})*(?!\w)")
DOTTED = re.compile(r"\d{1,4}(?:\.\d{2,5}){2,5}(?!\w|\.\d)")
THOUSANDS = re.compile(r"[1-9]\d{0,2}(?:\.\d{3})+")
TRUNK = re.compile(r"0\d{1,4}(?: {1,2}\d{2,5}){1,4}(?!\w)")
GROUPED = re.compile(r"\d{2,5}(?:[ .\-]\d{2,5}){1,4}(?!\w)")
PLAIN = re.compile(r"(?:0\d{8,10}|1?\d{10})(?!\w|\.\d)")
IP = re.compile(r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)")
SECRET = re.compile(r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,}|[0-9A-F]{32,}|AKIA[0-9A-Z]{16}|(?:sk|pk|ghp|xox[bp])[_\-][A-Za-z0-9_\-]{16,})(?![A-Za-z0-9])")
#: A value up to white space, a quote or a bracket; after the last two words it must hold a digit.
ASSIGNED = re.compile(r"(?i:\b(api[_\-]?key|passw(?:or)?d|pwd|secret|token)\b[\"']?\s*[:=]\s*[\"']?)([^\s\"'<>(){},;]{5,}[^\s\"'<>(){},;.])")
IP6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:.]\w|\w)")
BIRTH = re.compile(r"(?i:\b(?:born|date of birth|dob|geboren|geburtsdatum|née?|date de naissance|nacid[oa]|fecha de nacimiento)\b\W{1,3}(?:(?:on|am|le|el) )?)(\d{4}[-./]\d{1,2}[-./]\d{1,2}|\d{1,2}[-./]\d{1,2}[-./]\d{4})(?!\w)")
#: Words of streets in four languages.
ADDRESS = re.compile(
    r"(?<![\w.])\d{1,5}[a-z]? (?:[A-Z][a-z]+ ){1,3}(?:Street|Road|Avenue|Lane|Drive|Boulevard|Court|Square)\b"
    r"|\b[A-ZÄÖÜ][a-zäöüß]+(?:straße|strasse|weg|platz|allee|gasse) \d{1,4}[a-z]?\b"
    r"|(?<![\w.])\d{1,4},? (?:rue|avenue|boulevard|impasse) (?:de |du |des |la |le |les )*[A-ZÀ-Ý][a-zß-ÿ]+\b"
    r"|\b(?:Calle|Avenida|Plaza|Paseo) (?:de |del |la |las |los |el )*[A-ZÀ-Ý][a-zß-ÿ]+,? \d{1,4}\b"
)
STREET = re.compile(r"Street|Road|Avenue|Lane|Drive|Boulevard|Court|Square|straße|strasse|weg|platz|allee|gasse|Calle|Avenida|Plaza|Paseo")
IBAN = re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b")
DATE = re.compile(r"(?:\d{4}[-.]\d{1,2}[-.]\d{1,2}|\d{1,2}[-.]\d{1,2}[-.]\d{4})(?!\w|[-.]\d)")
#: Scripts that are written without spaces between words.
UNSPACED = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")
NAME = re.compile(r"\b(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Señor|Señora|Monsieur|Madame|Mme|Sr|Sra|(?i:my name is|mein Name ist|ich heiße|je m'appelle|me llamo|(?:full )?name:|signed,?|dear))\.? ([^\W\d_a-zß-öø-ÿ][^\W\d_]+(?: [^\W\d_a-zß-öø-ÿ][^\W\d_]+)?)")


def _round(key: bytes, tweak: bytes, r: int, half: int, bits: int) -> int:
    size = (bits + 7) // 8
    raw = hashlib.shake_256(b"%d|%b|%b|%d|%b" % (len(key), key, tweak, r, half.to_bytes(size, "big"))).digest(size)
    return int.from_bytes(raw, "big") & ((1 << bits) - 1)


def permute(x: int, size: int, key: bytes, tweak: bytes, back: bool = False) -> int:
    """A keyed permutation of 0..size-1, or its inverse."""
    bits = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << bits) - 1
    while True:
        a, b = x >> bits, x & mask
        for r in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
            if back:
                a, b = b ^ _round(key, tweak, r, a, bits), a
            else:
                a, b = b, a ^ _round(key, tweak, r, b, bits)
        x = a << bits | b
        if x < size:
            return x


def shifted(x: int, size: int, key: bytes, tweak: bytes) -> int:
    """A keyed permutation without fixed points (for more than one element)."""
    return permute((permute(x, size, key, tweak, True) + 1) % size, size, key, tweak)


def spell(chars: str, alphabets: list[str], key: bytes, tweak: str, accept=None) -> str:
    """The surrogate of a string given the alphabet of each place (one letter: kept)."""
    size, x = 1, 0
    for c, a in zip(chars, alphabets):
        x, size = x * len(a) + a.index(c), size * len(a)
    if size == 1:
        return chars
    t = f"{tweak}|{'|'.join(alphabets)}".encode()
    while True:
        x = y = shifted(x, size, key, t)
        out = []
        for a in reversed(alphabets):
            y, d = divmod(y, len(a))
            out.append(a[d])
        text = "".join(reversed(out))
        if accept is None or accept(text):
            return text


def _kinds(text: str) -> list[str]:
    return [next((a for a in (DIGITS, LOWER, UPPER) if c in a), letters(c)) for c in text]


def _lower(text: str) -> str:
    """Lower case of the letters that have one of a single character."""
    return "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def luhn(digits: str) -> bool:
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def _digits(text: str, fresh: str) -> str:
    """``text`` with its digits replaced in order."""
    it = iter(fresh)
    return "".join(next(it) if c.isdigit() else c for c in text)


def _check_digits(bare: str) -> int:
    """The valid check digits of an account number (ISO 7064, modulus 97)."""
    return 98 - int("".join(str(int(c, 36)) for c in f"{bare[4:]}{bare[:2]}00")) % 97


def _spaced(text: str, fresh: str) -> str:
    """``fresh`` with the spaces of ``text``."""
    it = iter(fresh)
    return "".join(c if c == " " else next(it) for c in text)


def _date(mention: str) -> tuple[int, list[int], datetime.date] | None:
    """(place of the year, places of month and day, date); the month is first where both readings are dates."""
    parts = list(map(int, re.split(r"[-./]", mention)))
    year = 0 if parts[0] > 31 else 2
    rest = [1, 2] if year == 0 else [0, 1]
    for month, day in (rest, rest[::-1]):
        try:
            return year, [month, day], datetime.date(parts[year], parts[month], parts[day])
        except ValueError:
            continue
    return None


def _birth(mention: str, key: bytes) -> str:
    """Another date of the same reading and widths, if the date exists, else other digits."""
    read = _date(mention)
    if not read:
        return _digits(mention, spell(re.sub(r"\D", "", mention), [DIGITS] * sum(c.isdigit() for c in mention), key, "birth"))
    form = re.sub(r"\d+", lambda m: str(len(m[0])), mention)
    first, last = datetime.date(1900, 1, 1), datetime.date(2099, 12, 31)
    size, x = (last - first).days + 1, (read[2] - first).days
    if not 0 <= x < size:
        return _digits(mention, spell(re.sub(r"\D", "", mention), [DIGITS] * sum(c.isdigit() for c in mention), key, "birth"))
    while True:
        x = shifted(x, size, key, f"birth|{form}".encode())
        day = first + datetime.timedelta(x)
        groups = [0, 0, 0]
        groups[read[0]], groups[read[1][0]], groups[read[1][1]] = day.year, day.month, day.day
        widths = [len(g) for g in re.split(r"[-./]", mention)]
        fresh = [f"{g:0{w}d}" for g, w in zip(groups, widths)]
        it = iter(fresh)
        text = re.sub(r"\d+", lambda m: next(it), mention)
        # The same widths, and the same reading when it is read again.
        if all(len(f) == w for f, w in zip(fresh, widths)) and (again := _date(text)) and again[1] == read[1]:
            return text


def _address(mention: str, key: bytes) -> str:
    """House number and names replaced, words of streets kept."""
    def part(m: re.Match) -> str:
        word = m[0]
        if word.isdigit():
            return spell(word, [DIGITS[1:], *[DIGITS] * (len(word) - 1)] if word[0] != "0" else [DIGITS] * len(word), key, "address")
        if end := STREET.search(word):
            return (_name_word(word[: end.start()], key) if end.start() > 1 else word[: end.start()]) + word[end.start() :]
        return _name_word(word, key) if word[0].isupper() else word

    return re.sub(r"\d+|[^\W\d_]+", part, mention)


def _ip_class(octets: str) -> int:
    a, b = int(octets[:3]), int(octets[3:6])
    if max(a, b, int(octets[6:9]), int(octets[9:])) > 255:
        return -1
    return 1 if a == 10 or a == 192 and b == 168 or a == 172 and 16 <= b < 32 else 2 if a in (0, 127) else 3 if a >= 224 else 0


def _shape(x: str) -> tuple:
    """In upper case and back: letters of one shape can render each other's case."""
    return unicodedata.category(x) == "Lm", x.lower() == x, len(x.upper()) == 1 and x.upper().lower() == x


@lru_cache(maxsize=1000)
def _block(first: int, last: int, shape: tuple) -> str:
    taken = "".join(KINDS)
    return "".join(x for x in map(chr, range(first, last + 1)) if x.isalpha() and x not in taken and _shape(x) == shape)


def letters(c: str) -> str:
    """The letters that may stand for a lower-case letter: its kind, or the
    letters of its block (CJK and Hangul: of the whole script) that no kind has."""
    if not c.isalpha():
        return c
    if kind := next((a for a in KINDS if c in a), None):
        return kind
    at = ord(c)
    first, last = next(((x, y) for x, y in ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0x20000, 0x2A6DF)) if x <= at <= y), (at // 128 * 128, at // 128 * 128 + 127))
    return _block(first, last, _shape(c))


def _name_word(word: str, key: bytes) -> str:
    low = word.lower()
    end = 1 if len(low) > 3 and low[-1] in KINDS[0] + KINDS[4] + KINDS[6] else 0
    alphabets = [letters(c) for c in low[: len(low) - end]] + list(low[len(low) - end :])
    fresh = spell(low, alphabets, key, "name")
    return "".join(x.upper() if c.isupper() else x for c, x in zip(word, fresh)) if len(fresh) == len(word) else fresh


def _mentions(text: str, names: list[tuple[int, int]]):
    """Where words of the names found in a text stand without a title, as
    written or in capitals; words that follow each other are one mention."""
    words = {w for a, b in names for w in text[a:b].split(" ")}
    words |= {w.upper() for w in words if len(w.upper()) == len(w)}
    alone = [re.escape(w) for w in words if UNSPACED.search(w) and len(w) > 1]
    spaced = [re.escape(w) for w in words if not UNSPACED.search(w)]
    # The longest first, so that no word hides a longer one.
    either = "|".join(sorted(alone, key=lambda w: (-len(w), w)) + [rf"(?<![^\W_])(?:{'|'.join(sorted(spaced))})(?![^\W_])"] * bool(spaced))
    for m in re.finditer(rf"(?:{either})(?: (?:{either}))*", text):
        yield m.start(), m.end()


def canonical(kind: str, mention: str) -> str:
    """What all mentions of one entity have in common."""
    if kind in ("phone", "card", "ssn"):
        d = re.sub(r"\D", "", mention)
        return d[-10:] if kind == "phone" else d
    if kind == "ip":
        return str(ipaddress.IPv6Address(mention)) if ":" in mention else ".".join(str(int(o)) for o in mention.split("."))
    return mention.lower() if kind in ("email", "name") else mention.replace(" ", "") if kind == "iban" else mention


@lru_cache(maxsize=50_000)
def surrogate(kind: str, mention: str, key: bytes = KEY) -> str:
    if kind == "email":
        local, _, domain = _lower(mention).rpartition("@")
        host, _, top = domain.rpartition(".")
        fresh = spell(local, _kinds(local), key, "local@" + domain) + "@" + spell(host, _kinds(host), key, "host." + top) + "." + top
        return "".join(x.upper() if c.isupper() else x for c, x in zip(mention, fresh))
    if kind in ("phone", "ssn"):
        d = re.sub(r"\D", "", mention)
        tail = d[-10:]
        return _digits(mention, d[: len(d) - len(tail)] + spell(tail, [DIGITS] * len(tail), key, "phone" if kind == "phone" else "ssn"))
    if kind == "card":
        d = re.sub(r"\D", "", mention)
        valid = luhn(d)
        return _digits(mention, spell(d, [DIGITS] * len(d), key, "card", lambda x: luhn(x) == valid))
    if kind == "birth":
        return _birth(mention, key)
    if kind == "address":
        return _address(mention, key)
    if kind == "ip" and ":" in mention:
        digits = ipaddress.IPv6Address(mention).exploded.replace(":", "")
        fresh = digits[:4] + spell(digits[4:], [HEX] * 28, key, "ip6" + digits[:4])
        short = ipaddress.IPv6Address(int(fresh, 16))
        return (short.compressed if "::" in mention else ":".join(f"{int(fresh[i : i + 4], 16):x}" for i in range(0, 32, 4))).upper() if mention.upper() == mention else short.compressed
    if kind == "ip":
        octets = "".join(f"{int(o):03d}" for o in mention.split("."))
        where = _ip_class(octets)
        fresh = spell(octets, ["012", DIGITS, DIGITS] * 4, key, "ip", lambda x: _ip_class(x) == where)
        return ".".join(str(int(fresh[i : i + 3])) for i in range(0, 12, 3))
    if kind == "iban":
        bare = mention.replace(" ", "")
        body = spell(bare[4:], _kinds(bare[4:]), key, "iban" + bare[:2])
        # As far from the valid check digits as the original's: valid stays valid.
        check = (int(bare[2:4]) - _check_digits(bare) + _check_digits(bare[:4] + body)) % 100
        return _spaced(mention, f"{bare[:2]}{check:02d}{body}")
    if kind == "name":
        return " ".join(_name_word(w, key) for w in mention.split(" "))
    if re.fullmatch(r"[0-9a-f]+", mention):
        return spell(mention, [HEX] * len(mention), key, "secret")
    if re.fullmatch(r"[0-9A-F]+", mention):
        return spell(mention, [HEX_UPPER] * len(mention), key, "secret")
    keep = re.match(r"(?:AKIA|(?:sk|pk|ghp|xox[bp])[_\-])?", mention).end()
    return mention[:keep] + spell(mention[keep:], _kinds(mention[keep:]), key, "secret" + mention[:keep])


def _ends(text: str, a: int, b: int, least: int, most: int) -> list[int]:
    """Ends of whole groups in text[a:b] that leave ``least`` to ``most`` digits, longest first."""
    out, n = [], 0
    for m in re.finditer(r"\d+", text[a:b]):
        n += len(m[0])
        if least <= n <= most:
            out.append(a + m.end())
    return out[::-1]


def _card(text: str, a: int) -> tuple[int, bool]:
    """(end of the card at ``a``, true), or (where to go on, false); (0, false): none.
    Of several readings one with a valid check digit counts first, then four fours."""
    if m := CARD.match(text, a):
        return m.end(), True
    m = CARD_GROUPS.match(text, a)
    ends = _ends(text, a, m.end(), 13, 19) if m else []
    if not ends:
        return 0, False
    digits = {e: re.sub(r"\D", "", text[a:e]) for e in ends}
    fours = [e for e in ends if len(digits[e]) == 16 and FOURS.fullmatch(text, a, e)]
    for e in fours + ends:
        if luhn(digits[e]):
            return e, True
    if fours:
        groups = [g.start() + a for g in re.finditer(r"\d+", FOURS.match(text, a)[0])]
        if len(groups) % 4:  # another number stands before a card
            for g in groups[1 : len(groups) - 3]:
                e = groups[groups.index(g) + 3] + 4
                if luhn(re.sub(r"\D", "", text[g:e])):
                    return g, False
        return fours[0], True
    whole = [e for e in ends if re.fullmatch(r"\d{4}([ \-])\d{2,6}(?:\1\d{2,6}){1,3}", text[a:e])]
    return (whole[0], True) if whole else (0, False)


def _phone(text: str, a: int) -> int:
    """The end of the phone number at ``a``, or 0."""
    if m := THREE_THREE_FOUR.match(text, a):
        return m.end()
    if text[a] in "+(":
        m = (INTERNATIONAL if text[a] == "+" else BRACKETED).match(text, a)
        ends = _ends(text, a, m.end(), 7, 15) if m else []
        # A digit that stands alone at the end is not part of the number.
        return next((e for e in ends if text[e - 2].isdigit()), 0)
    if (m := DOTTED.match(text, a)) and not THOUSANDS.fullmatch(m[0]) and 9 <= sum(c.isdigit() for c in m[0]) <= 15:
        return m.end()
    if m := PLAIN.match(text, a):
        return m.end()
    for m in filter(None, (GROUPED.match(text, a), TRUNK.match(text, a))):
        # A number of a fixed format that follows after a space is another one.
        stop = next((g.start() + a for g in re.finditer(r"(?<= )\d+", m[0]) if THREE_THREE_FOUR.match(text, g.start() + a)), m.end())
        for e in _ends(text, a, stop, 7, 15):
            if "." not in text[a : a + 3] and not re.search(r"\.\d*\.", text[a:e]):
                return e
    if a and text[a - 1] == "(" and (m := re.compile(r"\d{7,15}(?!\w)").match(text, a)):
        return m.end()
    return 0


def _numbers(text: str):
    addresses = {}
    for m in IP.finditer(text):
        addresses[m.start()] = m.end()
        if all(int(o) < 256 for o in m[0].split(".")):
            yield "ip", m.start(), m.end()
    for run in NUMBER.finditer(text):
        at = run.start()
        while m := BEGIN.search(text, at, run.end()):
            a = m.start()
            if years := YEARS.match(text, a):
                at = years.end()
            elif end := addresses.get(a, 0):
                at = end
            elif d := DATE.match(text, a):
                at = d.end()
            elif s := SSN.match(text, a):
                yield "ssn", a, s.end()
                at = s.end()
            else:
                at, card = _card(text, a)
                if card:
                    yield "card", a, at
                elif not at:
                    at = _phone(text, a)
                    if at:
                        yield "phone", a, at
                    else:  # go on at the next number
                        at = a + 1
                        while text[a] not in "+(" and at < run.end() and text[at].isdigit():
                            at += 1


def detect(text: str) -> list[tuple[str, int, int]]:
    """(type, start, end) of all entities, left to right, not overlapping; of
    two that overlap the one of the earlier type in ``TYPES`` counts, then the longer.
    A name is found after a title; its words then count in the whole text."""
    found: list[tuple[str, int, int]] = []
    at = text.find("@")
    while at >= 0:
        a, b = at, EMAIL_DOMAIN.match(text, at + 1)
        while b and a and (text[a - 1].isalnum() or text[a - 1] in LOCAL_SIGNS or unicodedata.category(text[a - 1])[0] == "M"):
            a -= 1
        while a < at and text[a] in LOCAL_SIGNS:
            a += 1
        if b and a < at:
            found.append(("email", a, b.end()))
        at = text.find("@", at + 1)
    found += [("secret", m.start(), m.end()) for m in SECRET.finditer(text)]
    if "=" in text or ":" in text:
        found += [("secret", *m.span(2)) for m in ASSIGNED.finditer(text) if m[1][0] not in "sStT" or len(m[2]) > 7 and any(c.isdigit() for c in m[2])]
    if "::" in text or text.count(":") > 6:
        found += [("ip", m.start(), m.end()) for m in IP6.finditer(text) if _is_ip6(m[0])]
    found += [("birth", *m.span(1)) for m in BIRTH.finditer(text)]
    found += [("address", m.start(), m.end()) for m in ADDRESS.finditer(text)]
    found += [("iban", m.start(), m.end()) for m in IBAN.finditer(text)]
    found += _numbers(text)
    if names := [m.span(1) for m in NAME.finditer(text)]:
        found += [("name", *x) for x in names]
        found += [("name", *x) for x in _mentions(text, names)]
    rank = {t: i for i, t in enumerate(TYPES)}
    kept: list[tuple[str, int, int]] = []
    taken = bytearray(len(text))
    for e in sorted(set(found), key=lambda e: (rank[e[0]], e[1] - e[2], e[1])):
        if e[1] < e[2] and taken.find(1, e[1], e[2]) < 0:
            taken[e[1] : e[2]] = b"\1" * (e[2] - e[1])
            kept.append(e)
    return sorted(kept, key=lambda e: e[1])


def _is_ip6(text: str) -> bool:
    """An address with a group of three digits or four groups; shorter ones could be code."""
    groups = [g for g in text.split(":") if g]
    try:
        return (len(groups) > 3 or any(len(g) > 2 for g in groups)) and bool(ipaddress.IPv6Address(text))
    except ValueError:
        return False


def replaced(text: str, key: bytes = KEY) -> tuple[str, list[tuple[str, int, int, int]]]:
    """(text with surrogates, (type, start, end, length of the surrogate) of each entity)."""
    out, entities, at = [], [], 0
    for kind, a, b in detect(text):
        fresh = surrogate(kind, text[a:b], key)
        out += (text[at:a], fresh)
        entities.append((kind, a, b, len(fresh)))
        at = b
    return "".join([*out, text[at:]]) if entities else text, entities


def rewrite(text: str, key: bytes = KEY) -> tuple[str, list[tuple[str, int, int]]]:
    """(text with surrogates, entities found)."""
    fresh, entities = replaced(text, key)
    return fresh, [e[:3] for e in entities]


def secret_key(spark) -> bytes:
    """The key that the session names in ``spark.lorekeep.privacy.key``. Without one the
    key in this file is used, which hides nothing from a reader of this file."""
    named = spark.conf.get("spark.lorekeep.privacy.key", None)
    if not named:
        warnings.warn("spark.lorekeep.privacy.key is not set: surrogates use the published demonstration key", stacklevel=3)
    return named.encode() if named else KEY


def _rewritten(key: bytes):
    kind = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("written", pa.int64())]))

    def run(batches):
        for b in batches:
            texts, found = [], []
            for t in b.column("__text").to_pylist():
                text, entities = replaced(t, key) if t else (t, [])
                texts.append(text)
                found.append([{"type": k, "start": s, "end": e, "written": n} for k, s, e, n in entities])
            cols = [pa.array(texts, pa.string()) if n == "__text" else b.column(n) for n in b.schema.names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(found, kind)], [*b.schema.names, "__entities"])

    return run


def surrogates(docs: DataFrame, text: str = "text", key: bytes | None = None, entities: str = "__entities") -> DataFrame:
    """``docs`` with entities replaced in ``text`` and the array ``entities`` of
    struct<type, start, end, written>: character positions in the original text, and the length of
    the surrogate that stands there now."""
    key = key or secret_key(docs.sparkSession)
    ship(docs.sparkSession)
    named = [f"__{i}" if c != text else "__text" for i, c in enumerate(docs.columns)]
    inner = docs.toDF(*named)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema) + ", `__entities` array<struct<type:string,start:bigint,end:bigint,written:bigint>>"
    return inner.mapInArrow(_rewritten(key), schema).toDF(*docs.columns, entities)


def _pairs(batches):
    """Entities and what was written for them, of (original text, new text, entities)."""
    for b in batches:
        rows = set()
        for old, new, entities in zip(*(b.column(i).to_pylist() for i in range(3))):
            moved = 0
            for e in entities:
                at = e["start"] + moved
                rows.add((e["type"], canonical(e["type"], old[e["start"] : e["end"]]), canonical(e["type"], new[at : at + e["written"]])))
                moved += e["written"] - (e["end"] - e["start"])
        cols = list(zip(*rows)) if rows else [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["type", "entity", "surrogate"])


def collisions(docs: DataFrame, text: str = "text", key: bytes | None = None) -> DataFrame:
    """(type, value, n): surrogates of several entities of one type and entities of several
    surrogates, judged by what ``surrogates`` writes for all of ``docs``. None, unless the
    maps of a type were not one to one."""
    both = docs.select(F.col(text).alias("old"), F.col(text).alias("new"))
    written = surrogates(both, "new", key, "entities").where(F.size("entities") > 0)
    pairs = written.mapInArrow(_pairs, "type string, entity string, surrogate string").distinct()
    shared = pairs.groupBy("type", "surrogate").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("type", F.col("surrogate").alias("value"), "n")
    split = pairs.groupBy("type", "entity").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("type", F.col("entity").alias("value"), "n")
    return shared.unionByName(split)
