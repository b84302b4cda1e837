"""Surrogates for personal data: keyed, type-consistent, distinct and coreferent (operator 7).

Each entity is cut into a form that stays (punctuation, letter case, script, country prefix, top
level domain, key names, titles) and a payload of characters from known classes. The payload is a
number in a mixed-radix domain, and a keyed permutation of that domain gives the surrogate's
payload. A permutation has no collisions, so distinct entities of one form stay distinct, equal
ones stay equal in all documents, and the conjugated successor has no fixed points, so no entity
keeps its value.

Names are open-ended, so their parts are hashed with the key and spelled in syllables of the
script, as many as the number of entities asks for, with an ending for the gender. A part's
surrogate depends on the part alone, never on the title before it, so 'Mr. John Smith',
'Dr. John Smith' and 'Smith' corefer, in all documents. Its gender is that of the name lists; a
name in none of them, or of either gender, gets a neutral form, which suits any title.

A distributed check over all entities of the corpus verifies that no two of a kind share a
surrogate; kinds that fail are keyed anew until none does. Kinds with large domains are also keyed
anew, twice at most, if a surrogate is itself an entity of the corpus. IPs, phone and social
security numbers have so small domains that a surrogate may be another entity's value; since that
one is replaced too, distinctness holds.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import discard, materialize, with_text

KINDS = ("secret", "email", "iban", "ip", "mac", "ssn", "card", "phone", "name")

_SECRET = re.compile(
    r"(?i)\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth[_-]?token|private[_-]?key)\b[\"']?[ \t]*[=:][ \t]*[\"']?"
    r"([A-Za-z0-9+/_.~!@#$%^&*-]{6,}={0,2})"
    r"|\b((?:AKIA|ASIA)[0-9A-Z]{16})\b|\b(gh[pousr]_[A-Za-z0-9]{20,})\b|\b(sk-[A-Za-z0-9_-]{20,})\b"
    r"|\b(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})"
)
_EMAIL = re.compile(r"([^\W_][\w.+%'-]{0,255})@((?:[^\W_](?:[\w-]{0,61}[^\W_])?\.)+[^\W\d_]{2,24})")
_SEP = r"[ .\-/\u00a0\u202f\u2011]"
_IP6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,8}(?:\d{1,3}(?:\.\d{1,3}){3}|[0-9A-Fa-f]{1,4})?(?![\w:])")
_DATE = re.compile(r"(?:\d{1,2}([./-])\d{1,2}\1(?:\d{4}|\d\d)|\d{4}([./-])\d\d\2\d\d)(?![./-]?\d)")
_NUMBER = re.compile(
    rf"(?<![\w.+])(?P<intl>(?:\+ ?|00 ?)[1-9]\d{{0,14}}(?:{_SEP}?\(\d{{1,5}}\){_SEP}?\d{{1,12}})?(?:{_SEP}\d{{1,8}}){{0,7}})(?!\w)"
    r"|\b(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?)\b"
    r"|\b(?P<mac>[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5})\b"
    r"|(?<![\d.])(?P<ip>(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3})(?![\d]|\.\d)"
    r"|(?<![\d-])(?P<ssn>\d{3}-\d{2}-\d{4})(?![\d-])"
    r"|(?<![\d])(?P<card>\d(?:[ -]?\d){12,18})(?![\d])"
    rf"|(?<![\w.,+/-])(?P<trunk>(?:\(0\d{{1,5}}\){_SEP}?\d{{1,12}}|0[1-9]\d{{0,12}})(?:{_SEP}\d{{1,8}}){{0,7}})(?!\w)"
    r"|(?<![\w.,+/-])(?P<bare>[2-9]\d{9}|[2-9]\d\d-\d{4})(?![\w-]|[.,]\d)"
    r"|(?<![\w.])(?P<phone>(?:\+\d{1,3}[ .-]?)?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]\d{2,4}){1,4})(?![\w])"
)
#: Titles by gender ('n': unknown).
TITLES = {
    "Mr": "m", "Mister": "m", "Sir": "m", "Herr": "m", "Herrn": "m", "Monsieur": "m", "M": "m", "Sr": "m", "Señor": "m", "Don": "m",
    "Mrs": "f", "Ms": "f", "Miss": "f", "Madam": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Mlle": "f", "Sra": "f", "Señora": "f", "Doña": "f",
    "Dr": "n", "Prof": "n", "Господин": "m", "Госпожа": "f", "Κύριος": "m", "Κυρία": "f",
}
# Given names by gender ('n': either); others count as 'n'.
GIVEN = {
    "m": (
        "Adam", "Adrian", "Alan", "Alejandro", "Andrew", "Anthony", "Antoine", "Antonio", "Arthur", "Benjamin", "Bernd", "Brian", "Bruno", "Carlos", "Charles",
        "Christian", "Daniel", "David", "Diego", "Edgar", "Edward", "Emil", "Eric", "Felix", "Fernando", "Frank", "François", "Fritz", "George", "Gustav", "Hans",
        "Heinz", "Henri", "Henry", "Hugo", "Ivan", "Jack", "Jacques", "Jakob", "James", "Javier", "Jean", "Johannes", "John", "Jonas", "José", "Joseph", "Juan",
        "Karl", "Kevin", "Klaus", "Leon", "Louis", "Lukas", "Luis", "Manuel", "Marc", "Mark", "Martin", "Matthew", "Max", "Michael", "Miguel", "Nils", "Oscar",
        "Otto", "Pablo", "Patrick", "Paul", "Pedro", "Peter", "Philippe", "Pierre", "Ralf", "Richard", "Robert", "Stefan", "Steven", "Thomas", "Walter", "William",
        "Андрей", "Борис", "Виктор", "Денис", "Иван", "Кирилл", "Ανδρέας", "Γιώργος", "Δημήτρης", "Κώστας",
    ),
    "f": (
        "Alice", "Amélie", "Ana", "Anna", "Barbara", "Berta", "Camille", "Carmen", "Carla", "Caroline", "Céline", "Chantal", "Charlotte", "Clara", "Cristina",
        "Diana", "Elena", "Elisabeth", "Elizabeth", "Emily", "Emma", "Eva", "Frida", "Greta", "Hannah", "Heidi", "Helena", "Inés", "Ingrid", "Irene", "Isabel",
        "Jane", "Jennifer", "Jessica", "Juana", "Julia", "Karen", "Karin", "Katharina", "Laura", "Lena", "Linda", "Lisa", "Lucía", "Manon", "Margaret", "Maria",
        "María", "Marie", "Martha", "Mary", "Monika", "Nancy", "Nathalie", "Nina", "Olga", "Olivia", "Patricia", "Paula", "Petra", "Pilar", "Rosa", "Sabine",
        "Sandra", "Sarah", "Sofía", "Sophie", "Susan", "Sylvie", "Teresa", "Ursula", "Анна", "Вера", "Дарья", "Елена", "Ирина", "Άννα", "Γεωργία", "Ελένη", "Ζωή",
    ),
}
#: Consonants, vowels and the endings of male, female, neutral given names and of family names, by script.
SPELLING = {
    "latin": ("bdfgklmnprstvz", "aeiou", {"m": "n", "f": "na", "n": "li", "family": "ser"}),
    "cyrillic": ("бвгдзклмнпрст", "аеиоу", {"m": "н", "f": "на", "n": "ли", "family": "рин"}),
    "greek": ("βγδζκλμνπρστφ", "αεηιο", {"m": "νος", "f": "να", "n": "λι", "family": "ρης"}),
}
#: Capitals of the Latin, Greek and Cyrillic blocks.
_UPPER = "".join(chr(c) for c in range(0x530) if chr(c).isupper())
_CAP = rf"[{_UPPER}](?:['’]?[^\W\d_]+)"
_PARTICLES = "de del della di da dos das do du des la las los le van von der den ter zu zur zum al bin ibn".split()
_PARTICLE = rf"(?:(?:{'|'.join(_PARTICLES)}) )"
#: Behind a given name, particles may be capitals: 'Jean de La Fontaine', 'Maria De Luca'.
_INNER = rf"(?:(?:{'|'.join(f'[{w[0].upper()}{w[0]}]{w[1:]}' for w in _PARTICLES)}) )"
_TITLED = re.compile(
    r"(?<!\w)(" + "|".join(sorted(TITLES, key=len, reverse=True)) + r")(\.? )"
    rf"((?:[{_UPPER}]\. ){{0,2}}{_PARTICLE}{{0,3}}{_CAP}(?:[ -]{_CAP}){{0,2}}(?: {_INNER}{{1,3}}{_CAP}(?:[ -]{_CAP}){{0,2}})?)"
)
_GENDER = {name.lower(): g for g, names in GIVEN.items() for name in names}
#: A listed given name and a family name behind it, without a title.
_KNOWN = re.compile(rf"(?<![\w@.-])((?:{'|'.join(n for names in GIVEN.values() for n in names)}) (?:[{_UPPER}]\. )?{_INNER}{{0,3}}({_CAP}(?:-{_CAP})?))(?![\w@])")
#: Capitalised words behind a given name that make a place, a heading or a new sentence of it, not a person.
NOT_FAMILY = frozenset(
    "Street Road Avenue Lane Square Boulevard Drive Court Bridge Park Island River Lake Mountain Airport Station Hospital School College University Church "
    "Cathedral Museum Day Week Award Prize Straße Strasse Platz Allee Weg Brücke Kirche Schule Airlines Inc Ltd GmbH Corp Company Foundation Institute "
    "Up Down In Out On Off At By For From With And Or The A An Is Was Are Were Has Had He She It They We You I This That Und Oder Der Die Das Ist War Hat Er Es Wir "
    "Et Ou Il Elle Est Y El Ella Los Las".split()
)
_GIVENS = frozenset(n for names in GIVEN.values() for n in names)
_TRIGGER = re.compile(r"[@\d]|(?i:passw|pwd|secret|token|key)|(?<!\w)(?:" + "|".join(TITLES) + r")\.? ")

DIGITS, LOWER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"
_GREEK, _CYRILLIC = "αβγδεζηθικλμνξοπρστυφχψω", "абвгдежзийклмнопрстуфхцчшщъыьэюя"
_ALPHABETS = (DIGITS, LOWER, _CYRILLIC, _GREEK, "àáâãäåæçèéêëìíîïñòóôõöøùúûüý")


def _int(key: bytes, *parts) -> int:
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), key=key, digest_size=32).digest(), "big")


def permute(key: bytes, tweak: str, value: int, a: int, b: int) -> int:
    """A keyed permutation of 0 .. a * b - 1 without fixed points (for a * b > 1).

    An unbalanced Feistel network E over Z_a x Z_b, used as E^-1(E(x) + 1).
    """
    size = a * b
    if size < 2:
        return value
    left, right = divmod(value, b)
    for i in range(0, 8, 2):
        left = (left + _int(key, tweak, i, right)) % a
        right = (right + _int(key, tweak, i + 1, left)) % b
    left, right = divmod((left * b + right + 1) % size, b)
    for i in range(6, -1, -2):
        right = (right - _int(key, tweak, i + 1, left)) % b
        left = (left - _int(key, tweak, i, right)) % a
    return left * b + right


def _permute_places(key: bytes, tweak: str, places: list[tuple[int, int]]) -> list[int]:
    """Permute the number whose digits are ``places``: (digit, radix)."""
    half, a, b, value = len(places) // 2, 1, 1, 0
    for k, (d, r) in enumerate(places):
        value = value * r + d
        if k < half:
            a *= r
        else:
            b *= r
    value, out = permute(key, tweak, value, a, b), []
    for _, r in reversed(places):
        value, d = divmod(value, r)
        out.append(d)
    return out[::-1]


def keep_form(key: bytes, kind: str, text: str, alphabets: tuple[str, ...] = _ALPHABETS, tweak: str = "") -> str:
    """Replace every character of a known class by one of the same class and case.

    A leading digit 1-9 stays in 1-9. Case is kept by place, so spellings that differ only by case
    get surrogates that differ only by case.
    """
    where, places, form = [], [], []
    low = text.lower() if len(text.lower()) == len(text) else text
    for i, c in enumerate(low):
        alphabet = next((x for x in alphabets if c in x), None)
        if alphabet is DIGITS and c != "0" and not any(x is DIGITS or x == "1-9" for x in form):
            where.append((i, "123456789"))
            places.append((int(c) - 1, 9))
            form.append("1-9")
        elif alphabet:
            where.append((i, alphabet))
            places.append((alphabet.index(c), len(alphabet)))
            form.append(alphabet)
        else:
            form.append(c)
    new = _permute_places(key, f"{kind}|{tweak}|{'|'.join(form)}", places)
    out = list(text)
    for (i, alphabet), d in zip(where, new, strict=True):
        c = alphabet[d]
        out[i] = c.upper() if text[i] != low[i] else c
    return "".join(out)


def _luhn(digits: str) -> int:
    """The check digit that completes ``digits``."""
    s = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 == 0 else 1)
        s += d - 9 if d > 9 else d
    return -s % 10


def _card(key: bytes, text: str) -> str:
    """First digit, grouping and validity of the check digit stay."""
    digits = [c for c in text if c.isdigit()]
    body, check = "".join(digits[1:-1]), int(digits[-1])
    off = (check - _luhn("".join(digits[:-1]))) % 10
    places = [(int(c), 10) for c in body]
    if off:
        places.append((off - 1, 9))
    new = _permute_places(key, f"card|{digits[0]}|{len(digits)}|{off > 0}", places)
    head = digits[0] + "".join(map(str, new[: len(body)]))
    off = new[-1] + 1 if off else 0
    it = iter(head + str((_luhn(head) + off) % 10))
    return "".join(next(it) if c.isdigit() else c for c in text)


def _iban(key: bytes, text: str) -> str:
    """Country and grouping stay; check digits are computed if they were right, else permuted."""
    flat = text.replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    valid = number(flat[4:] + flat[:4]) % 97 == 1
    body = keep_form(key, f"iban{flat[:2]}{valid}{'' if valid else flat[2:4]}", flat[4:], (DIGITS, LOWER))
    check = f"{98 - number(body + flat[:2] + '00') % 97:02d}" if valid else flat[2:4]
    if not valid and number(body + flat[:2] + check) % 97 == 1:  # it must not become a valid one
        body = keep_form(key, f"iban{flat[:2]}again", body, (DIGITS, LOWER))
    it = iter(flat[:2] + check + body)
    return "".join(next(it) if c != " " else c for c in text)


def _script(text: str) -> str:
    c = next((c for c in text.lower() if c.isalpha()), "a")
    return "cyrillic" if "Ѐ" <= c <= "ӿ" else "greek" if "Ͱ" <= c <= "Ͽ" else "latin"


def _name(key: bytes, text: str, syllables: int, role: str = "") -> str:
    """Names of the same script, gender, number of words and case.

    Each word is hashed by itself, so equal parts of two names get equal surrogates: the last word
    (double names with their hyphen) as a family name, the others as given names; ``role`` says
    which of them a lone word is. Initials and particles stay.
    """
    words = text.split(" ")
    return " ".join(
        w if _stays(w, k, len(words)) else _name_part(key, w, role or ("family" if k == len(words) - 1 else "given"), syllables)
        for k, w in enumerate(words)
    )


def _stays(word: str, place: int, size: int) -> bool:
    """Initials stay, and particles before the last word (with a capital only behind the first)."""
    if re.fullmatch(r".\.", word):
        return True
    return place < size - 1 and (word if place == 0 else word.lower()) in _PARTICLES


def _name_part(key: bytes, word: str, role: str, syllables: int) -> str:
    script, out = _script(word), []
    consonants, vowels, endings = SPELLING[script]
    size = len(consonants) * len(vowels)
    for part in word.split("-"):
        h, got = _int(key, "name", role, part.lower()), ""
        for _ in range(syllables):
            h, at = divmod(h, size)
            got += consonants[at // len(vowels)] + vowels[at % len(vowels)]
        out.append((got + endings["family" if role == "family" else _GENDER.get(part.lower(), "n")]).capitalize())
    got = "-".join(out)
    return got.upper() if word.isupper() and len(word) > 1 else got


def syllables_for(names: int) -> int:
    """So many syllables of 65 that ``names`` names collide with a chance under one in a thousand."""
    k = 2
    while 65.0**k < 500.0 * (names + 1) ** 2:
        k += 1
    return k


def surrogate(key: bytes, kind: str, text: str, role: str = "", syllables: int = 6) -> str:
    if kind == "email":
        local, _, domain = text.rpartition("@")
        head, dot, top = domain.rpartition(".")
        got = keep_form(key, "email", f"{local}@{head}", tweak=top.lower())
        return got + dot + top
    if kind == "ip" and ":" in text:  # the first group (the kind of network) stays
        first, *rest = [int(_address(text)) >> 16 * k & 0xFFFF for k in range(7, -1, -1)]
        groups = [first, *_permute_places(key, f"ip6|{first}", [(g, 65536) for g in rest])]
        got = str(ipaddress.IPv6Address(sum(g << 16 * (7 - k) for k, g in enumerate(groups))))
        return got.upper() if text.isupper() else got
    if kind == "ip":
        o = [(int(x), 256) for x in text.split(".")]
        return ".".join(map(str, _permute_places(key, "ip", o)))
    if kind == "mac":
        return keep_form(key, "mac", text, (HEX,))
    if kind == "card":
        return _card(key, text)
    if kind == "iban":
        return _iban(key, text)
    if kind == "phone":
        country = re.match(rf"\+ ?\d{{1,3}}(?={_SEP}|\()|00 ?[1-9]\d{{0,2}}(?={_SEP}|\()|\+ ?|00 ?|\(?0", text)
        head = country[0] if country else ""
        return head + keep_form(key, "phone", text[len(head) :], (DIGITS,), tweak=head)
    if kind == "name":
        return _name(key, text, syllables, role)
    if kind == "secret":
        head = re.match(r"AKIA|ASIA|gh[pousr]_|sk-|eyJ", text)
        head = head[0] if head else ""
        alphabets = (HEX,) if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text) else (DIGITS, LOWER)
        return head + keep_form(key, "secret", text[len(head) :], alphabets, tweak=head)
    return keep_form(key, kind, text, (DIGITS,))


def canonical(kind: str, text: str) -> str:
    """What makes two mentions the same entity."""
    if kind == "ip" and ":" in text:
        return f"{int(_address(text)):032x}"
    return text.lower()


def _address(text: str) -> ipaddress.IPv6Address | None:
    try:
        return ipaddress.IPv6Address(text)
    except ValueError:
        return None


def _phone_end(text: str) -> int:
    """Where the first number ends: a run of groups over 15 digits is cut, before a trunk 0 if there is one."""
    cuts, n, at = [], 0, 0
    for m in re.finditer(r"\d+", text):
        if 7 <= n <= 15:
            cuts.append((m[0][0] == "0" and len(m[0]) > 2, at))
        n, at = n + len(m[0]), m.end()
    if n <= 15 or not cuts:
        return len(text)
    return max(cuts)[1]


_NAME_WORD = re.compile(r"(?<![\w@.-])[^\W\d_](?:[\w'’-]*\w)?")
_NAME_CUT = re.compile(r"[-'’]")


def _longest(word: str, head: str, forms: dict[str, str]) -> str | None:
    """The longest form that is ``head`` and a beginning of ``word``, cut at its end, before a last s, a hyphen or an apostrophe."""
    cuts = [len(word), *(m.start() for m in _NAME_CUT.finditer(word))]
    for end in sorted((e for c in cuts for e in (c, c - (word[:c][-1:] == "s"))), reverse=True):
        if end > 0 and head + word[:end] in forms:
            return head + word[:end]
    return None


#: What makes a number in dots a version, a number an amount, and groups of three digits a part of a longer number.
_VERSION = re.compile(r"(?i)(?:\bversion|\brelease|\bbuild|\brev|\bsection|\bv|§)[.:]? ?$")
_AMOUNT = re.compile(r"(?i)(?:[$€£¥]|\b(?:usd|eur|gbp|chf|price|preis|prix|precio|total|sum)\b:?) ?(?:\d{1,3}[ .\u00a0\u202f])?$")
_MONEY = re.compile(r" ?(?:[$€£¥]|(?:USD|EUR|GBP|CHF)\b)")
_THOUSANDS = re.compile(r"(?<![\d+(])\d{1,3}[ .\u00a0\u202f]$")
_BOOK = re.compile(r"(?i)\b(?:isbn|ean|gtin|upc)(?:-1[03])?:? ?$")


def _is_card(text: str, before: str) -> bool:
    """A card number has a valid check digit, and is neither an article number nor one digit repeated."""
    digits = "".join(c for c in text if c.isdigit())
    book = len(digits) == 13 and digits[:3] in ("978", "979") or _BOOK.search(before)
    return not book and len(set(digits)) > 1 and int(digits[-1]) == _luhn(digits[:-1])


def _named(text: str, known: bool) -> list[tuple[int, int, str, str]]:
    """Names behind titles or with a listed given name, and all other mentions of them or of their parts in the text.

    The last field is the role of a lone word: 'family' or 'given' ('': a whole name). Mentions are
    looked up word by word, so the time grows with the text, not with the number of its names.
    """
    first = [m.span(3) for m in _TITLED.finditer(text)]
    if known:
        first += [m.span(1) for m in _KNOWN.finditer(text) if m[2] not in NOT_FAMILY and m[2] not in TITLES]
    if not first:
        return []
    forms: dict[str, str] = {}
    for a, b in first:
        parts = text[a:b].split(" ")
        words = [w for k, w in enumerate(parts) if not _stays(w, k, len(parts))]
        for name, role in ((text[a:b], ""), (words[-1], "family"), *((w, "given") for w in words[:-1])):
            for form in (name, name.upper()):
                if len(form) > 2 and forms.get(form) != "family":  # a word that is both counts as a family name
                    forms[form] = role if " " not in form else ""
    found = [(a, b, "name", "" if " " in text[a:b] else "family") for a, b in first]
    sizes: dict[str, set[int]] = {}  # numbers of words of the longer forms, by their first word
    for form in forms:
        if " " in form and (m := _NAME_WORD.match(form)):
            sizes.setdefault(m[0], set()).add(form.count(" ") + 1)
    reach, end = max(map(len, forms)) + 1, 0
    for m in _NAME_WORD.finditer(text):
        if m.start() < end:
            continue
        form, at = None, m.start()
        if m[0] in sizes:
            near = text[at : at + reach + 2]
            for n in sorted(sizes[m[0]], reverse=True):
                head = " ".join(near.split(" ", n - 1)[: n - 1]) + " "
                last = _NAME_WORD.match(text, at + len(head))
                if last and (form := _longest(last[0], head, forms)):
                    break
        form = form or _longest(m[0], "", forms)
        after = at + len(form) if form else 0
        if form and text[after : after + 1] != "@" and text[after : after + 2] != "s@":
            found.append((at, after, "name", forms[form]))
            end = after
    return found


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, role) of the entities of a text, in order, not overlapping; the longer of two that begin together."""
    known = not _GIVENS.isdisjoint(text.split())
    if not known and not _TRIGGER.search(text):
        return []
    found: list[tuple[int, int, str, str]] = []
    if re.search(r"(?i)passw|pwd|secret|token|key|akia|asia|gh[pousr]_|sk-|eyj", text):
        for m in _SECRET.finditer(text):
            found.append((*m.span(m.lastindex), "secret", ""))
    at = text.find("@")
    while at >= 0:  # look around each sign, so long words cost nothing
        lo = at
        while lo > 0 and at - lo < 256 and (text[lo - 1].isalnum() or text[lo - 1] in "._+%'-"):
            lo -= 1
        m = _EMAIL.search(text, lo, min(len(text), at + 256))
        if m and m.start() < at < m.end():
            found.append((*m.span(), "email", ""))
            at = text.find("@", m.end())
        else:
            at = text.find("@", at + 1)
    if re.search(r"\d", text):
        at = 0
        while m := _NUMBER.search(text, at):
            kind, last, (a, at) = m.lastgroup, at, m.span()
            if kind == "card" and not _is_card(m[0], text[max(0, a - 12) : a]) or kind == "ip" and _VERSION.search(text, max(0, a - 16), a):
                continue
            if kind in ("phone", "bare", "trunk") and (_AMOUNT.search(text, max(0, a - 12), a) or _MONEY.match(text, at)):
                continue
            if kind == "phone" and a - 1 != last and _THOUSANDS.search(text, max(0, a - 5), a):  # the end of a long number in groups
                continue
            if kind in ("intl", "trunk", "bare", "phone"):
                if kind in ("trunk", "phone") and (day := _DATE.match(text, a)):
                    at = day.end()
                    continue
                at = a + _phone_end(m[0])
                n = sum(c.isdigit() for c in text[a:at])
                least = {"intl": 7, "trunk": 8 if re.search(r"\D", m[0]) else 9, "bare": 7}.get(kind, 7 if m[0][0] in "+(" or "(" in m[0] else 9)
                if not least <= n <= 15:
                    continue
                kind = "phone"
            found.append((a, at, kind, ""))
    if text.count(":") > 1:
        for m in _IP6.finditer(text):
            if re.search(r"\d", m[0]) and _address(m[0]):
                found.append((*m.span(), "ip", ""))
    found += _named(text, known)
    found.sort(key=lambda e: (e[0], KINDS.index(e[2]), -e[1]))
    out, end = [], 0
    for e in found:
        if e[0] >= end:
            out.append(e)
            end = e[1]
    return out


#: Kinds whose domain is so large that no surrogate need be another entity of the corpus.
LARGE = ("secret", "email", "iban", "card", "name")


@dataclass(frozen=True)
class Settings:
    """What the entities of a corpus need: salts by kind and the syllables of a name."""

    salts: tuple[tuple[str, int], ...] = ()
    syllables: int = 6

    def keys(self, key: str) -> dict[str, bytes]:
        salts = dict(self.salts)
        return {k: hashlib.blake2b(f"{key}|{k}|{salts.get(k, 0)}".encode(), digest_size=32).digest() for k in KINDS}


def mentions(docs: DataFrame) -> DataFrame:
    """Distinct kind, text, role of the entities of all documents: one pass, combined in the tasks before the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = {(kind, t[a:b], role) for t in pdf["text"].tolist() for a, b, kind, role in entities(t)}
            yield pd.DataFrame(list(rows), columns=["kind", "text", "role"], dtype="object")

    return with_text(docs).select("text").mapInPandas(run, "kind string, text string, role string").distinct()


def entity_table(found: DataFrame, key: str, settings: Settings = Settings()) -> DataFrame:
    """Distinct kind, entity (canonical), surrogate (canonical) of :func:`mentions`.

    Names are given by their parts: what must stay distinct is each given and each family name.
    """
    keys, n = settings.keys(key), settings.syllables

    def parts(kind: str, text: str, role: str) -> list[tuple[str, str, str]]:
        if kind != "name":
            return [(kind, canonical(kind, text), canonical(kind, surrogate(keys[kind], kind, text)))]
        new = surrogate(keys[kind], kind, text, role, n)
        words = list(zip(text.split(" "), new.split(" "), strict=True))
        roles = [role or ("family" if k == len(words) - 1 else "given") for k in range(len(words))]
        return [(f"name:{r}", a.lower(), b.lower()) for (w, v), r in zip(words, roles, strict=True) if w != v for a, b in zip(w.split("-"), v.split("-"), strict=True)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = {x for k, t, r in zip(pdf["kind"], pdf["text"], pdf["role"], strict=True) for x in parts(k, t, r)}
            yield pd.DataFrame(list(rows), columns=["kind", "entity", "surrogate"], dtype="object")

    return found.mapInPandas(run, "kind string, entity string, surrogate string").distinct()


def settle(docs: DataFrame, key: str, rounds: int = 8) -> Settings:
    """Settings under which no two entities of the corpus share a surrogate.

    The documents are read once, for their distinct mentions; each round of keys works on those.
    Counts collisions over all entities in Spark; only counts and the names of kinds come back. Kinds
    with large domains are also keyed anew, twice at most, while some surrogate is itself an entity
    of the corpus; what is left after that (short e-mails of a huge corpus) is replaced too, so
    distinctness holds all the same.
    """
    found, settings = materialize(mentions(docs), "op7-mentions", waves=1), Settings()
    for attempt in range(rounds):
        table = materialize(entity_table(found, key, settings), "op7-entities", waves=1)
        names = table.where("kind like 'name:%'").count()
        if syllables_for(names) > settings.syllables:
            settings = replace(settings, syllables=syllables_for(names))
            continue
        twice = table.groupBy("kind", "surrogate").agg(F.count("*").alias("n")).where("n > 1").select("kind")
        large = table.where(F.substring_index("kind", ":", 1).isin(*LARGE))
        taken = large.select("kind", "surrogate").join(large.select("kind", F.col("entity").alias("surrogate")).hint("merge"), ["kind", "surrogate"], "left_semi").select("kind")
        bad = sorted({r.kind.partition(":")[0] for r in (twice.union(taken) if attempt < 2 else twice).distinct().collect()})
        discard(table)
        if not bad:
            discard(found)
            return settings
        salts = dict(settings.salts)
        settings = replace(settings, salts=tuple(sorted((salts | {k: salts.get(k, 0) + 1 for k in bad}).items())))
    raise RuntimeError(f"surrogates still collide after {rounds} keys")


def pseudonymize(docs: DataFrame, key: str, settings: Settings | None = None) -> DataFrame:
    """The documents with every entity replaced by its surrogate, plus nothing: columns as given, whatever their names.

    ``key`` is the secret without which surrogates can't be turned back; it has no default.
    Null texts stay null, empty ones empty; equal texts get equal results, repeated rows and ties
    included; an empty table stays empty. ``settings`` come from :func:`settle`, which runs if they
    aren't given. One pass, no shuffle, only the text goes to Python; a text is one row of one task, however long.
    """
    settings = settle(docs, key) if settings is None else settings
    keys, n = settings.keys(key), settings.syllables

    @F.arrow_udf(T.StringType())
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([None if t.as_py() is None else _rewrite(t.as_py(), keys, n)[0] for t in b], pa.string())

    new = run.asNondeterministic()(F.col("text"))  # so the optimizer never runs it twice
    return docs.select(*[new.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def _rewrite(text: str, keys: dict[str, bytes], syllables: int) -> tuple[str, list[str]]:
    out, end, kinds = [], 0, []
    for a, b, kind, role in entities(text):
        out += [text[end:a], surrogate(keys[kind], kind, text[a:b], role, syllables)]
        end = b
        kinds.append(kind)
    return ("".join(out) + text[end:], kinds) if out else (text, kinds)


def surrogate_report(docs: DataFrame, key: str) -> DataFrame:
    """One row a document: doc_id, text (rewritten; null: empty), n_entities and a count by kind.

    Edge cases as in :func:`pseudonymize`.
    """
    settings = settle(docs, key)
    keys, n = settings.keys(key), settings.syllables
    counts = [f"n_{k}" for k in KINDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [_rewrite(t.as_py(), keys, n) for t in b.column("text")]
            cols = [b.column("doc_id"), pa.array([t for t, _ in got], pa.string()), pa.array([len(k) for _, k in got], pa.int64())]
            cols += [pa.array([ks.count(k) for _, ks in got], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "text", "n_entities", *counts])

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
    for c in ("n_entities", *counts):
        schema = schema.add(c, T.LongType())
    return with_text(docs).mapInArrow(run, schema)
