"""PII: entities get keyed, type-consistent surrogates that keep gender, script and format, distinctness and coreference."""

from __future__ import annotations

import functools
import hashlib
import ipaddress
import re
import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, staged

#: Canonical forms whose first surrogates collide are broadcast if they are so many at most, and joined to the texts else.
EXCEPTIONS = 100_000

TITLES = {"m": ("Mr", "Herr", "Señor", "Sr", "Monsieur", "Signor", "г-н", "Κύριος"), "f": ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Signora", "г-жа", "Κυρία"), "": ("Dr", "Prof")}
GIVEN = {
    ("latin", "m"): ("Adam", "Boris", "Carlo", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leo", "Martin", "Noah", "Oscar", "Paul"),
    ("latin", "f"): ("Anna", "Bella", "Clara", "Diana", "Emma", "Flora", "Greta", "Helena", "Ida", "Julia", "Klara", "Laura", "Maria", "Nora", "Olga", "Paula"),
    ("latin", ""): ("Alex", "Robin", "Kim", "Sascha", "Jona", "Toni", "Noel", "Luca"),
    ("cyrillic", "m"): ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Олег"),
    ("cyrillic", "f"): ("Анна", "Вера", "Дарья", "Елена", "Инна", "Ольга", "Нина", "Юлия"),
    ("cyrillic", ""): ("Саша", "Женя", "Валя"),
    ("greek", "m"): ("Νίκος", "Πέτρος", "Γιώργος", "Άρης"),
    ("greek", "f"): ("Άννα", "Ελένη", "Μαρία", "Σοφία"),
    ("greek", ""): ("Χάρη", "Φώτη"),
}
#: Consonants, vowels and endings of the syllables that family names are made of.
SOUNDS = {
    "latin": ("b d f g h k l m n p r s t v w z".split(), "aeiou", ("", "l", "m", "n", "r", "s")),
    "cyrillic": ("б в г д з к л м н п р с т ф х ш".split(), "аеиоу", ("", "л", "м", "н", "р", "с")),
    "greek": ("β γ δ ζ θ κ λ μ ν ξ π ρ σ τ φ χ".split(), "αεηιου"[:5], ("", "λ", "μ", "ν", "ρ", "σ")),
}
#: First and last letters of scripts without tables of names: a name's letters become others of these (fixed).
LETTERS = {"han": "一龥", "hangul": "가힣", "hiragana": "あん", "katakana": "アン", "arabic": "اي", "hebrew": "את", "devanagari": "अह", "thai": "กฮ", "armenian": "աֆ", "georgian": "აჰ"}
ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", "àáâãäåæçèéêëìíîïñòóôõöøùúûüý", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ"]
HEX = "0123456789abcdef"
_CLASS = {c: a for a in ALPHABETS for c in a}


@functools.cache
def _alphabets() -> dict[tuple, str]:
    """All other letters, marks and figures by script (the first word of their names), general category, plane and case."""
    out: dict = {}
    for c in map(chr, range(128, 0x33480)):
        if c not in _CLASS and (kind := _kind(c)):
            out.setdefault(kind, []).append(c)
    return {k: "".join(v) for k, v in out.items()}


def _kind(c: str) -> tuple | None:
    """Script, category, plane, and whether the character has a partner of the other case."""
    kind = unicodedata.category(c)
    return (unicodedata.name(c, "other").split(" ")[0].split("-")[0], kind, ord(c) >> 16, c.upper() != c and c.upper().lower() == c) if kind[0] in "LM" or kind == "Nd" else None


def class_of(c: str) -> str:
    """The characters that may stand in a character's place; empty for signs and white space."""
    if c in _CLASS or c.isascii():
        return _CLASS.get(c, "")
    return _alphabets().get(_kind(c), "")


# --- keyed permutations ----------------------------------------------------------------------------------------------


def _round(key: bytes, tweak: str, i: int, x: int, size: int) -> int:
    """A keyed number, of so many bits that it is even modulo size."""
    said = f"{tweak}|{i}|{x:x}".encode()
    if size < 1 << 128:
        return int.from_bytes(hashlib.blake2b(said, key=key, digest_size=32).digest(), "big")
    return int.from_bytes(hashlib.shake_256(key.ljust(64, b"\0") + said).digest(size.bit_length() // 8 + 17), "big")


def permuted(key: bytes, tweak: str, value: int, size: int, inside: Callable[[int], bool] = lambda x: True) -> int:
    """A keyed permutation of 0..size-1, and of its members for which inside holds if it holds for value, that leaves none
    in its place (of two or more).

    An additive Feistel network on value = a + low * b deals the values of the smallest such rectangle a place in a row; a
    value's image is the next in the row, as long as that is within size and inside. So all values are one cycle. Being a
    permutation, it gives different values different images: nothing has to be remembered.
    """
    if size < 2:
        return value
    low = max(1, int(size**0.5)) if size < 2**52 else 1 << (size.bit_length() // 2)
    high = -(-size // low)
    b, a = divmod(value, low)
    for i in range(0, 8, 2):
        a = (a + _round(key, tweak, i, b, low)) % low
        b = (b + _round(key, tweak, i + 1, a, high)) % high
    place = b * low + a
    while True:
        place = (place + 1) % (low * high)
        b, a = divmod(place, low)
        for i in range(6, -2, -2):
            b = (b - _round(key, tweak, i + 1, a, high)) % high
            a = (a - _round(key, tweak, i, b, low)) % low
        value = b * low + a
        if value < size and inside(value):
            return value


def permuted_string(key: bytes, tweak: str, text: str, classes: list[str] | None = None) -> str:
    """Every character changes within its class (digits, letters of a case and script); all others stay."""
    classes = classes or [class_of(c) for c in text]
    value, size = 0, 1
    for c, a in zip(text, classes, strict=True):
        if a:
            value, size = value * len(a) + a.index(c), size * len(a)
    shape = "".join(a[:1] if a else c for c, a in zip(text, classes, strict=True))
    value, out = permuted(key, f"{tweak}|{shape}", value, size), []
    for c, a in zip(reversed(text), reversed(classes), strict=True):
        if a:
            value, i = divmod(value, len(a))
        out.append(a[i] if a else c)
    return "".join(reversed(out))


def poured(digits: str, form: str) -> str:
    """form with its digits replaced in turn."""
    it = iter(digits)
    return re.sub(r"[0-9]", lambda _: next(it), form)


def luhn(body: str) -> int:
    """The check digit that follows body."""
    total = sum(sum(divmod(int(c) * 2, 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(body)))
    return -total % 10


# --- kinds: pattern, canonical form (None: not one after all), surrogate of a canonical form, and its place in the text ---


def _digits(text: str) -> str:
    return re.sub(r"\D", "", text)


#: Beginnings of card numbers by issuer, and the lengths that go with them (fixed).
CARDS = re.compile(r"(?:4(?=(?:\d{12}|\d{15}|\d{18})$)|5[1-5](?=\d{14}$)|(?:222[1-9]|22[3-9]\d|2[3-6]\d\d|27[01]\d|2720)(?=\d{12}$)|3[47](?=\d{13}$)|35(?:2[89]|[3-8]\d)(?=\d{12}$)|(?:6011|64[4-9]\d|65\d\d)(?=\d{12}$))")


def _card(text: str) -> str | None:
    """Numbers of an issuer whose check digit is right; others are just numbers."""
    d = _digits(text)
    return d if CARDS.match(d) and luhn(d[:-1]) == int(d[-1]) else None


def _card_surrogate(key: bytes, d: str) -> str:
    start = CARDS.match(d)[0]
    body = start + permuted_string(key, "card" + start, d[len(start) : -1])
    return body + str(luhn(body))


def _phone_surrogate(key: bytes, canon: str) -> str:
    country, _, rest = canon.partition(" ")
    n = int("1" + "0" * (len(rest) - 1))
    good = lambda v: (v >= 2 * n) == (int(rest) >= 2 * n)  # noqa: E731  a first digit from 2 on stays such
    return country + str(permuted(key, f"phone|{country}|{len(rest)}", int(rest), 10 ** len(rest), good)).zfill(len(rest))


#: Country codes: of one digit, of two, and all others of three (fixed).
COUNTRY = re.compile(r"[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{1,3}")


def _phone(text: str) -> str | None:
    if re.fullmatch(r"\+\d+\.\d+", text):  # a number with decimals
        return None
    d = _digits(text)
    d = d[2:] if text.startswith("00") else d
    country = COUNTRY.match(d)[0] if text.startswith(("+", "00")) else ""
    return f"{country} {d[len(country) :]}" if 7 <= len(d) <= 15 and len(d) > len(country) + 3 else None


def _ip(text: str) -> str | None:
    try:
        return str(ipaddress.IPv4Address(text))
    except ValueError:
        return None


#: Ranges of addresses within which an address stays (fixed).
RANGES = [ipaddress.IPv4Network(n) for n in ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16", "100.64.0.0/10", "224.0.0.0/4", "192.0.2.0/24", "198.51.100.0/24", "203.0.113.0/24")]


def _ip_surrogate(key: bytes, canon: str) -> str:
    own = ipaddress.IPv4Address(canon)
    if net := next((n for n in RANGES if own in n), None):
        first = int(net.network_address)
        return str(ipaddress.IPv4Address(first + permuted(key, f"ip|{net}", int(own) - first, net.num_addresses)))
    kept = lambda a: a.is_global == own.is_global and not any(a in n for n in RANGES)
    return str(ipaddress.IPv4Address(permuted(key, "ip", int(own), 2**32, lambda v: kept(ipaddress.IPv4Address(v)))))


def _ip6(text: str) -> str | None:
    try:
        return str(ipaddress.IPv6Address(text)) if re.search("[0-9]", text) else None  # without figures it may be code
    except ValueError:
        return None


def _ip6_surrogate(key: bytes, canon: str) -> str:
    """Of the same kind: the first 16 bits stay, which tell global, local and reserved ones apart."""
    own = int(ipaddress.IPv6Address(canon))
    return str(ipaddress.IPv6Address((own >> 112 << 112) + permuted(key, f"ip6|{own >> 112}", own & ((1 << 112) - 1), 1 << 112)))


def _iban(text: str) -> str | None:
    t = re.sub(r"\s", "", text)
    return t if len(t) >= 15 and int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1 else None


def _iban_surrogate(key: bytes, canon: str) -> str:
    body = permuted_string(key, "iban" + canon[:2], canon[4:])
    return canon[:2] + f"{98 - int(''.join(str(int(c, 36)) for c in body + canon[:2] + '00')) % 97:02d}" + body


def _email_surrogate(key: bytes, canon: str) -> str:
    local, _, domain = canon.rpartition("@")
    host, _, top = domain.rpartition(".")
    if not any(map(class_of, local)):  # signs alone have no others of their kind
        local = hashlib.blake2b(canon.encode(), key=key, digest_size=6).hexdigest()
    return f"{permuted_string(key, 'local', local)}@{permuted_string(key, 'host', host)}.{top}"


def _secret_surrogate(key: bytes, canon: str) -> str:
    if head := _PREFIX.match(canon):
        return head[0] + permuted_string(key, head[0], canon[head.end() :])
    return permuted_string(key, "secret", canon, [HEX] * len(canon) if set(canon) <= set(HEX) else None)


def script(text: str) -> str:
    if re.search("[А-я]", text):
        return "cyrillic"
    if re.search("[Α-ω]", text):
        return "greek"
    return next((k for k, (a, b) in LETTERS.items() if any(a <= c <= b for c in text)), "latin")


def _name(text: str) -> str | None:
    """gender|parts in lower case, initials with a dot; the gender is the first that a title tells."""
    head = _TITLES.match(text)
    gender = next((g for t in re.findall(_TITLE, head[0]) for g, titles in TITLES.items() if g and (t in titles or t in [x.upper() for x in titles])), "") if head else ""
    parts = _parts(text, head.end() if head else 0)
    return f"{gender}|{' '.join(p for _, _, p in parts)}" if parts else None


def _parts(text: str, start: int = 0, end: int | None = None) -> list[tuple[int, int, str]]:
    """(start, end, part) of the words of a name; parts are in lower case, initials have a dot."""
    found = _PART.finditer(text, start, len(text) if end is None else end)
    return [(m.start(), m.end(), m[0].lower() if len(m[0].rstrip(".")) > 1 else m[0].rstrip(".").lower() + ".") for m in found]


def _initial(part: str) -> bool:
    return len(part) == 2 and part.endswith(".")


def _aligned(parts: list[str], whole: list[str], family: bool) -> list[int] | None:
    """Which parts of a whole name the parts are, in order, initials standing for words; None if they aren't. With family
    the last one has to be the family name."""
    if family and parts[-1] != whole[-1]:
        return None
    at, out = 0, []
    for p in parts[:-1] if family else parts:
        while at < len(whole) - family and whole[at] != p and not (_initial(p) and whole[at] not in PARTICLES and whole[at].startswith(p[0])):
            at += 1
        if at == len(whole) - family:
            return None
        out.append(at)
        at += 1
    return [*out, len(whole) - 1] if family else out


def _persons(forms: list[str]) -> dict[str, list[str]]:
    """The whole names that each form of a text's titled names may stand for, itself if none. Forms go from the fullest."""
    split = lambda f: (f.partition("|")[0], f.partition("|")[2].split())
    order = sorted(set(forms), key=lambda f: (-sum(not _initial(p) for p in split(f)[1]), -len(split(f)[1]), not split(f)[0], f))
    whole: list[str] = []
    stands: dict[str, list[str]] = {}
    for f in order:
        gender, parts = split(f)
        stands[f] = [w for w in whole if (not gender or not split(w)[0] or gender == split(w)[0]) and _aligned(parts, split(w)[1], True) is not None]
        if not stands[f]:
            whole.append(f)
            stands[f] = [f]
    for w in [w for w in whole if w.startswith("|")]:  # a gender that all other forms agree in is the person's
        told = {f[0] for f in order if f != w and not f.startswith("|") and w in stands[f]}
        if len(told) == 1:
            new = told.pop() + w
            stands = {f: list(dict.fromkeys(new if x == w else x for x in own)) for f, own in stands.items()}
        elif told:
            stands = {f: [x for x in own if x != w] or [f] if not f.startswith("|") else own for f, own in stands.items()}
    return stands


def _coreferent(text: str, named: list) -> list:
    """Titled names (start, end, kind, form) of a text with the person each stands for as the canonical form, and the
    bare mentions of these persons. Of several that fit, the last one named before counts, or else the first after."""
    stands = _persons([c for _, _, _, c in named])
    out, seen = [], []
    for a, b, kind, form in named:
        fit = stands[form]
        out.append((a, b, kind, next((p for p in reversed(seen) if p in fit), fit[0])))
        seen.append(out[-1][3])
    whole = {p: p.partition("|")[2].split() for p in seen}
    words: set = set()
    for a, b, _, _ in named:
        head = _TITLES.match(text, a)
        own = [text[x:y] for x, y, p in _parts(text, head.end() if head else a, b) if not _initial(p) and p not in PARTICLES]
        words.update(own, (w.upper() for w in own if len(w) > 2), (w.title() for w in own if len(w) > 2 and w.isupper()))
    longest = max(map(len, whole.values()))
    free, at = [], 0
    for a, b, _, _ in named:
        free += [text[at:a], "\0" * (b - a)]
        at = b
    rest = "".join([*free, text[at:]])
    titled = list(out)
    for m in _RUN.finditer(rest):
        found, i = _parts(rest, *m.span()), 0
        if not any(rest[a:b] in words for a, b, _ in found):
            continue
        near = list(dict.fromkeys([*(p for a, _, _, p in reversed(titled) if a < m.start()), *seen]))
        while i < len(found):
            j = i
            while j < min(len(found), i + longest) and (rest[slice(*found[j][:2])] in words or _initial(found[j][2]) or found[j][2] in PARTICLES):
                j += 1
            while j > i:
                parts = [p for _, _, p in found[i:j]]
                if parts[0] not in PARTICLES and any(rest[a:b] in words for a, b, _ in found[i:j]):
                    who = next((p for family in (True, False) for p in near if _aligned(parts, whole[p], family) is not None), None)
                    if who:
                        out.append((found[i][0], found[j - 1][1], "name", who))
                        break
                j -= 1
            i = max(j, i + 1)
    return out


def _name_surrogate(key: bytes, canon: str, attempt: int = 0) -> str:
    """Of another name of the gender, script and number of parts, the last part made up; the more attempts before, the
    longer, so that there is always one that no other name has. Initials become initials, particles stay."""
    gender, _, name = canon.partition("|")
    parts, kind = name.split(), script(name)
    h = int.from_bytes(hashlib.blake2b(canon.encode(), key=key, digest_size=64).digest(), "big")
    out = []
    if kind in LETTERS:
        first, last = map(ord, LETTERS[kind])
        for p in parts:
            word = ""
            for c in [*p, *("" if p is not parts[-1] else p[-1] * (attempt // 2))]:
                h, i = divmod(h, last - first + 1)
                word += chr(first + i) if first <= ord(c) <= last else c
            out.append(p if p in PARTICLES else word)
        return " ".join(out)
    given = [x for x in GIVEN[kind, gender] if x.lower() not in parts] or GIVEN[kind, gender]  # none of the name's own
    for p in parts[:-1]:
        h, i = divmod(h, len(given))
        out.append(p if p in PARTICLES else given[i][0] + "." if _initial(p) else given[i])
    family = ""
    for _ in range((6 if len(parts) == 1 else 5) + attempt // 2):  # a lone name carries all the distinctness
        for sounds in SOUNDS[kind]:
            h, i = divmod(h, len(sounds))
            family += sounds[i]
    return " ".join([*out, family[:1].upper() + family[1:]])


def _name_place(form: str, canon: str, new: str) -> str:
    """A mention of a person, with the surrogate's parts in place of those it has; titles and white space stay."""
    head = _TITLES.match(form)
    own, whole, made = _parts(form, head.end() if head else 0), canon.partition("|")[2].split(), new.split(" ")
    parts = [p for _, _, p in own]
    at = _aligned(parts, whole, True) or _aligned(parts, whole, False)
    out, last = [], 0
    for (a, b, p), i in zip(own, at, strict=True):
        word = made[i][0] + ("." if form[b - 1] == "." else "") if _initial(p) else made[i]
        out += [form[last:a], word.upper() if b - a > 2 and form[a:b].isupper() else word]
        last = b
    return "".join([*out, form[last:]])


def _same_case(form: str, new: str) -> str:
    return "".join(n.upper() if f.isupper() and len(n.upper()) == 1 else n for f, n in zip(form, new, strict=True)) if len(form) == len(new) else new


#: Words within names that are not names themselves; they stay (fixed).
PARTICLES = ("van", "von", "vom", "der", "den", "de", "del", "della", "di", "da", "dos", "das", "do", "du", "la", "le", "el", "al", "bin", "bint", "ibn", "ben", "af", "av", "zu", "zur", "zum", "ter", "ten", "фон", "де")
_TITLE = "|".join(sorted({x for group in TITLES.values() for t in group for x in (t, t.upper())}, key=lambda t: (-len(t), t)))
_PARTICLE = "|".join(sorted(PARTICLES, key=len, reverse=True))
#: White space within a name: a line may end in it, a paragraph not.
_WS = r"(?:[^\S\r\n]+(?:\r?\n[^\S\r\n]*)?|\r?\n[^\S\r\n]*)"
_UP = f"(?![{re.escape(''.join(c for c in map(chr, range(0x10000)) if c.islower()))}])[^\\W\\d_]"
_LETTER = r"(?:[^\W\d_]|[̀-ͯ])"
_INITIALS = rf"(?:{_UP}\.{_WS}?|{_UP}{_WS})"
_CAP = rf"(?!(?:{_TITLE})(?!\w)){_UP}(?:{_LETTER}+|(?=['’]))(?:['’]{_UP}{_LETTER}*|-{_LETTER}+)*"
_TITLES = re.compile(rf"(?:(?:{_TITLE})(?!\w)\.?{_WS})+")
_PART = re.compile(rf"{_UP}\.|{_LETTER}+(?:['’]{_UP}{_LETTER}*|-{_LETTER}+)*")
_NAME = rf"(?:{_INITIALS}|(?:{_PARTICLE}){_WS})*{_CAP}(?!\w)"
_RUN = re.compile(rf"(?<!\w){_NAME}(?:{_WS}{_NAME})*")
_CALLED = r"(?i:\b(?:token|password|passwd|secret|api[_-]?key))"
#: Tokens that their beginnings tell, which stay (fixed).
_PREFIXES = r"AKIA|ASIA|gh[pousr]_|github_pat_|sk-(?:[a-z]+-)?|xox[abprs]-|glpat-|AIza|eyJ"
_PREFIX = re.compile(_PREFIXES)
_TOKEN = r"(?:AKIA|ASIA)[0-9A-Z]{16}|(?:gh[pousr]_|github_pat_|sk-(?:[a-z]+-)?|xox[abprs]-|glpat-|AIza)[A-Za-z0-9_-]{20,}|eyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}"
#: Kinds in the order in which they claim text: pattern (group 1 is the entity), canonical form, surrogate, place.
KINDS: dict[str, tuple] = {
    "email": (re.compile(r"(?<![\w.%+-])([\w.%+-]+@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,})(?![\w@])"), str.lower, _email_surrogate, _same_case),
    "secret": (
        re.compile(
            r"-----BEGIN [A-Z ]*PRIVATE KEY-----\s*([A-Za-z0-9+/=\s]+?)\s*-----END [A-Z ]*PRIVATE KEY-----"
            rf"|(?<![A-Za-z0-9])({_TOKEN})(?![A-Za-z0-9])"
            rf"|{_CALLED}\b[\"']?\s*(?:=\s*[\"']?|:\s*[\"'])([A-Za-z0-9+/_-]{{8,}})(?![A-Za-z0-9+/_-])"
            rf"|{_CALLED}\b[\"']?\s*:\s*(?=[A-Za-z+/_-]*[0-9])([A-Za-z0-9+/_-]{{8,}})(?![A-Za-z0-9+/_-])"
        ),
        str,
        _secret_surrogate,
        lambda form, new: new,
    ),
    "iban": (re.compile(r"(?<![A-Za-z0-9])([A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])"), _iban, _iban_surrogate, lambda form, new: "".join(next(it) if c != " " else c for it in [iter(new)] for c in form)),
    "ip": (re.compile(r"(?<![\d.])(\d{1,3}(?:\.\d{1,3}){3})(?!\.?\d)"), _ip, _ip_surrogate, lambda form, new: new),
    "ip6": (re.compile(r"(?<![\w:.])((?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4})(?![\w:.]\w|:)"), _ip6, _ip6_surrogate, lambda form, new: new.upper() if form.isupper() else new),
    "phone": (re.compile(r"(?<![\w+])(\+1(?:[ \xa0./-]?\(?\d\)?){10}(?![\w-])|\+\d(?:[ \xa0./-]?\(?\d\)?){6,14}|\(\d{3}\) ?\d{3}[ .-]?\d{4}|\d{3}[.-]\d{3}[.-]\d{4}|\d{3} \d{3} \d{4}|00[1-9](?:[ \xa0./-]?\d){8,13}|\(?0\d{2,4}\)?[ /-]\d{3,4}[ -]\d{3,4})(?![\w-])"), _phone, _phone_surrogate, lambda form, new: poured(("00" if form.startswith("00") else "") + new, form)),
    "ssn": (re.compile(r"(?<![\w-])(\d{3}(?P<gap>[ -])\d{2}(?P=gap)\d{4})(?![\w-])"), _digits, lambda key, d: permuted_string(key, "ssn", d), lambda form, new: poured(new, form)),
    "card": (re.compile(r"(?<![\w.-])(\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?![\w-])"), _card, _card_surrogate, lambda form, new: poured(new, form)),
    "name": (re.compile(rf"(?<!\w)((?:(?:{_TITLE})\.?{_WS})+{_NAME}(?:{_WS}{_NAME})*)"), _name, _name_surrogate, _name_place),
}
#: What every entity of any kind has in it or just before it.
_TRIGGER = re.compile(rf"[0-9@]|PRIVATE KEY|{_PREFIXES}|{_CALLED}|(?<!\w)(?:{_TITLE})(?!\w)")


def entities(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical form) of each entity, in order, none within another. Null and empty texts have none."""
    if not text or not _TRIGGER.search(text):
        return []
    found: list = []
    for kind, (pattern, canon, _, _) in KINDS.items():
        parts, at, hidden = [], 0, text
        for m in pattern.finditer(text):
            a, b = m.span(next(i for i in range(1, len(m.groups()) + 1) if m[i] is not None))
            if (c := canon(text[a:b])) is not None:
                found.append((a, b, kind, c))
                parts += [text[at:a], "\0" * (b - a)]
                at = b
        if parts:  # what is claimed is hidden from the kinds that follow
            text = "".join([*parts, text[at:]])
    named = [x for x in found if x[2] == "name"]
    if named:
        named = sorted(named + _given_before(text, named))
    return sorted([x for x in found if x[2] != "name"] + _coreferent(hidden, named) if named else found)


def _given_before(text: str, named: list) -> list:
    """Untitled names of a family that a title names elsewhere in the text: given names right before it, within a sentence
    (its first word is capitalised anyway), or known as such. text: with the titled names hidden."""
    families = {c.rpartition("|")[2].split()[-1] for _, _, _, c in named}
    known = {g.lower() for group in GIVEN.values() for g in group}
    out = []
    for m in _RUN.finditer(text):
        found = _parts(text, *m.span())
        for i, (_, end, p) in enumerate(found):
            if p not in families or _initial(p) or not i:
                continue
            first = i
            while first and not _initial(p) and found[first - 1][2] not in families and i - first < 3:
                first -= 1
            starts = not re.search(r"[^\s.!?:;\0\"'(-]\s*$", text[max(0, found[first][0] - 40) : found[first][0]])
            if starts and found[first][2] not in known and not _initial(found[first][2]):
                first += 1
            if first < i and (not out or out[-1][1] <= found[first][0]):
                gender = next((g for (_, g), names in GIVEN.items() if g and found[first][2] in map(str.lower, names)), "")
                out.append((found[first][0], end, "name", f"{gender}|" + " ".join(x for _, _, x in found[first : i + 1])))
    return out


def surrogate(key: bytes, kind: str, canon: str, attempt: int = 0) -> str:
    own = hashlib.blake2b(f"{kind}|{attempt}".encode(), key=key, digest_size=32).digest()
    if kind == "name":
        while (new := _name_surrogate(own, canon, attempt)).lower() == canon.partition("|")[2]:
            attempt += 2
        return new
    return KINDS[kind][2](own, canon)


def replaced(text: str, found: list, key: bytes, exceptions: dict) -> str:
    out, at = [], 0
    for a, b, kind, canon in found:
        new = surrogate(key, kind, canon, exceptions.get((kind, canon), 0))
        out += [text[at:a], _name_place(text[a:b], canon, new) if kind == "name" else KINDS[kind][3](text[a:b], new)]
        at = b
    return "".join([*out, text[at:]])


def settled(known: DataFrame, key: bytes, make: Callable[..., str] = surrogate) -> DataFrame:
    """kind, canon, attempt of those canonical forms whose first surrogate another form of the kind has too.

    known: distinct (kind, canon) of all texts. In each round the forms that share a surrogate with one of fewer attempts,
    or with a smaller one, get their next; all forms are held against one another by a group, so nothing is left alike
    however many collide. Only names are hashed and can collide; the other kinds are permuted, and are checked all the
    same. Later surrogates are longer, so the rounds end.
    """

    @lean
    def give(batches):
        for batch in batches:
            kinds, canons, attempts = (c.to_pylist() for c in batch.columns)
            out = [make(key, k, c, n) for k, c, n in zip(kinds, canons, attempts, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=["kind", "canon", "attempt", "made"])

    given = lambda df: df.mapInArrow(give, "kind string, canon string, attempt int, made string")
    made = staged(given(known.select("kind", "canon", F.lit(0).alias("attempt"))), "surrogates")
    while True:
        shared = made.groupBy("kind", "made").agg(F.count("*").alias("n"), F.min(F.struct("attempt", "canon")).alias("first")).where("n > 1")
        shared = staged(shared.select("kind", "made", F.col("first.canon").alias("owner")), "shared")
        if shared.isEmpty():
            return made.where("attempt > 0").select("kind", "canon", "attempt")
        judged = made.join(shared, ["kind", "made"], "left").withColumn("loses", F.coalesce(F.col("canon") != F.col("owner"), F.lit(False)))
        again = judged.where("loses").select("kind", "canon", (F.col("attempt") + 1).cast("int").alias("attempt"))
        made = staged(judged.where("not loses").select(*made.columns).union(given(again)), "surrogates")


def _detected(docs: DataFrame) -> DataFrame:
    @lean
    def detect(batches):
        for batch in batches:
            seen = {(kind, canon) for text in batch.column(0) for _, _, kind, canon in entities(text.as_py())}
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in seen], pa.string()), pa.array([c for _, c in seen], pa.string())], names=["kind", "canon"])

    return docs.select("text").mapInArrow(detect, "kind string, canon string").distinct()


def _joined(docs: DataFrame, exceptions: DataFrame, column: str) -> DataFrame:
    """docs with a column of the exceptions (kind, canon, attempt) that occur in the text: the way for any number of them."""

    @lean
    def detect(batches):
        for batch in batches:
            found = [(sha, *x) for sha, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for x in {(k, c) for _, _, k, c in entities(text.as_py())}]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.string()) for i in range(3)], names=["sha", "kind", "canon"])

    sha = F.sha2(F.col("text").cast("binary"), 256)
    has = docs.select(sha.alias("sha"), "text").mapInArrow(detect, "sha string, kind string, canon string").join(exceptions, ["kind", "canon"])
    has = staged(has.groupBy("sha").agg(F.collect_set(F.struct("kind", "canon", "attempt")).alias(column)), "excepted")
    return docs.withColumn(f"{column}_sha", sha).join(has.withColumnRenamed("sha", f"{column}_sha"), f"{column}_sha", "left").select(*docs.columns, column)


def surrogates(docs: DataFrame, key: bytes, prefix: str = "") -> DataFrame:
    """docs with the text's entities replaced, and (prefix)n_entities and (prefix)kinds (of the entities, in order).

    Kinds: KINDS. One canonical form (an address in lower case, the digits of a number, a person's fullest titled name in
    the text) has one surrogate in all documents, and two of a kind have different ones: most are images under a keyed
    permutation of all values of the same format, and hashed ones (names) are checked against all others first, in
    Spark. Who has the key can undo the permutations, so it is the caller's to choose and keep. Texts without entities
    stay as they are, null ones too. Other columns stay.
    """
    if not key:
        raise ValueError("surrogates need a key")
    key = key if len(key) <= 64 else hashlib.blake2b(key).digest()
    columns, own = docs.columns, f"{prefix}_exceptions"
    exceptions = staged(settled(_detected(docs), key), "exceptions")
    few = exceptions.limit(EXCEPTIONS + 1).toArrow().to_pylist()
    joined = len(few) > EXCEPTIONS
    sent = docs.sparkSession.sparkContext.broadcast((key, {} if joined else {(r["kind"], r["canon"]): r["attempt"] for r in few}))
    docs = _joined(docs, exceptions, own) if joined else docs
    at = columns.index("text")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in columns) + f", {prefix}n_entities int, {prefix}kinds array<string>"

    @lean
    def run(batches):
        key, exceptions = sent.value
        for batch in batches:
            texts, kinds, changed = batch.column(at), [], False
            several = batch.column(len(columns)).to_pylist() if joined else None
            new = []
            for i, x in enumerate(texts):
                text = x.as_py()
                found = entities(text)
                kinds.append([k for _, _, k, _ in found])
                if found:
                    changed = True
                    text = replaced(text, found, key, {(r["kind"], r["canon"]): r["attempt"] for r in several[i] or ()} if joined else exceptions)
                new.append(text)
            arrays = list(batch.columns)[: len(columns)]
            if changed:
                arrays[at] = pa.array(new, texts.type)
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([len(k) for k in kinds], pa.int32()), pa.array(kinds, pa.list_(pa.string()))], names=[*columns, f"{prefix}n_entities", f"{prefix}kinds"])

    return docs.mapInArrow(run, ddl)
