"""Surrogates for personal data (op 6).

Detected entities get keyed replacements of their own type and format. Digits
and letters are permuted within their script by a keyed Feistel network over the
entity's own mixed-radix number space, so different entities of one format can't
meet, and the same entity is the same everywhere. Names are spelt from syllables
of their script with an ending of their gender. A name is known by a form of
address beside it (with initials, particles, in capitals, each part of a double
name); its document's other mentions then follow, and names that a document never
gives a form of address stay, as do addresses in streets. An initial becomes that
of a given name's surrogate where the document has one. A person's name is one in a document
whatever the title: the gender comes from any title of the name there, else from
one of the surname's, else from the rest of the corpus.

A check over all entities finds surrogates that meet each other or a real entity
and draws those again. The first ``OWN_SPACE`` draws stay within the format;
should its values be all taken, later draws widen it: one more letter, digit or
syllable each, another private network and then IPv6 for addresses. So every
input settles.
"""

from __future__ import annotations

import json
import re
import unicodedata
from bisect import bisect_left, insort
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from hashlib import blake2b
from math import prod

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tiermeter.llm.common import arrow_schema, tidied, written
from tiermeter.llm.graph import hot_join

#: The key of samples and tests; a run over real data sets its own, as an argument or in the session.
KEY, KEY_SETTING = b"surrogates of this corpus", "spark.tiermeter.pii.key"
ROUNDS, PIECE = 8, 256
#: Draws within an entity's own format; each one after them widens it.
OWN_SPACE = 8
#: Rows of mentions that one task joins with redrawn entities.
SALT_ROWS = 1 << 20

# Forms of address with the gender they tell, by language.
MALE = ("Mr", "Mister", "Herr", "Monsieur", "Señor", "господин", "السيد")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "госпожа", "السيدة", "الآنسة")
EITHER = ("Dr", "Prof")
# Forms of address after a name, and the surnames before them (Chinese, Korean).
AFTER = {"先生": "m", "女士": "f", "小姐": "f", "太太": "f", "さん": "u", "様": "u", "氏": "u", "씨": "u"}
HAN_SURNAMES = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林郑梁谢宋唐许韩冯邓曹彭"
HANGUL_SURNAMES = "김이박최정강조윤장임한오서신권황안송류홍"
# What stands before a Japanese form of address without being a name.
NO_NAMES = ("皆", "客", "奥", "神", "何")
# Domains that are reserved for examples.
RESERVED = ("example.com", "example.org", "example.net", "example", "test", "invalid", "localhost")

# Words within surnames that aren't names themselves, and names of months with the words that tell them from people.
PARTICLES = ("van", "von", "der", "den", "de", "del", "della", "di", "da", "do", "dos", "das", "du", "la", "le", "ter", "ten", "zu", "zur", "zum", "af", "av", "bin", "ibn", "bint", "al", "el", "y")
MONTHS = ("january", "march", "april", "may", "june", "july", "august")
BEFORE_MONTHS = ("in", "since", "until", "till", "by", "of", "last", "next", "this", "every", "each", "early", "late", "mid", "during", "from", "before", "after")

_GENDER = {w: "m" for w in MALE} | {w: "f" for w in FEMALE} | {w: "u" for w in EITHER}
_TITLES = {w.lower() for w in _GENDER}
#: In capitals, two letters that are other words too need their period.
_GENDER |= {w.upper(): g for w, g in _GENDER.items() if w.isascii()}
_WITH_PERIOD = ("MS", "DR")
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_LETTER = r"[^\W\d_]"
PATTERNS: tuple[tuple[str, re.Pattern], ...] = (
    ("email", re.compile(r"(?<![\w.+%-])[\w.+%-]*[\w+%-]@[\w-]+(?:\.[\w-]+)+")),
    ("secret", re.compile(r"(?i)\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\b[\"']?\s*[:=]\s*[\"']?(?P<it>[^\s\"',;]{8,})")),
    ("secret", re.compile(r"\b(?:(?=[0-9a-f]*\d)[0-9a-f]{32,}|AKIA[0-9A-Z]{16}|gh[pousr]_\w{36,})\b")),
    ("iban", re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z\d]{4}){2,7}(?: ?[A-Z\d]{1,3})?\b")),
    ("card", re.compile(r"(?<![\d.])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\2\d{5})(?!\d)")),
    ("ssn", re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])|(?i:\bssn|\bsocial security(?: number| no\.?)?)[ :#]{1,3}(?P<it>\d{9})(?!\d)")),
    ("ipv6", re.compile(r"(?<![\w:.])(?=[0-9A-Fa-f:]*\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){2,6}:(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?|[0-9A-Fa-f]{1,4}::[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){1,5})(?![\w:]|\.\d)")),
    ("ip", re.compile(rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d)")),
    ("phone", re.compile(r"(?<![\w+])\+\d{1,3}(?:[ .-]?\(\d{1,5}\))?(?:[ .-]?\d{2,5}){1,5}(?!\d)|(?<![\w+])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\w+.-])(?<!\d )\d{3}([ .-])\d{3}\1\d{4}(?![\d-])(?! \d)")),
)
_TITLE = "|".join(sorted(_GENDER, key=len, reverse=True))
_SPACE = re.compile(r"[ \t]+")
FORMS = re.compile(rf"\b((?:(?:{_TITLE})(?:\.|\b)[ \t]+)+)")
#: What may follow a form of address: initials before a letter, or a word.
INITIALS = re.compile(rf"(?:{_LETTER}(?:\.[ \t]*|[ \t]+))+(?={_LETTER})")
NAME_WORD = re.compile(rf"{_LETTER}[\w'’-]*")
MOST_NAMES, MOST_PARTICLES = 3, 3
NAMES_BEFORE = re.compile(rf"([{HAN_SURNAMES}][一-龥]{{1,2}}?)(先生|女士|小姐|太太)|(?<![一-龥])([一-龥]{{1,4}}?)(さん|様|氏)|(?<![ァ-ヶー])([ァ-ヶー]{{2,}})(さん|様|氏)|(?<![가-힣])([{HANGUL_SURNAMES}][가-힣]{{1,2}}?) ?(씨)")
_MAYBE = re.compile(r"[\d@]")
#: A word that may be a name, and its parts.
_BARE, _PART = re.compile(r"[^\W_]+(?:[_'’-]+[^\W_]+)*"), re.compile(r"[^\W_]+")
_POSSESSIVE = re.compile(r"['’][sS]$")
#: Case-folded; every secret that may be without digits has one of them.
_SECRET_WORDS = ("token", "secret", "passw", "key", "akia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_")


def luhn(digits: str) -> int:
    """The Luhn sum modulo 10; 0 for a valid number."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10


def _iban_ok(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _secret_word(folded: str) -> bool:
    return any(w in folded for w in _SECRET_WORDS)


#: An entity: start and end in the text, its kind and its canonical value.
Entity = tuple[int, int, str, str]


def _free(found: list[Entity], start: int, end: int) -> bool:
    """Does nothing in ``found`` (in order, without overlaps) share a character with start .. end?"""
    i = bisect_left(found, (end,))
    return not (i and found[i - 1][1] > start)


def detect(text: str) -> list[Entity]:
    """Entities in order, without overlaps; where two overlap, the first kind of ``PATTERNS`` wins."""
    found: list[Entity] = []
    if _MAYBE.search(text) or _secret_word(text.casefold()):
        for kind, pattern in PATTERNS:
            for m in pattern.finditer(text):
                start, end = m.span("it") if "it" in pattern.groupindex and m["it"] else m.span()
                raw = text[start:end]
                if not _free(found, start, end):
                    continue
                if kind == "card" and luhn(re.sub(r"\D", "", raw)):
                    continue
                if kind == "iban" and not _iban_ok(raw):
                    continue
                if kind == "phone" and not 7 <= sum(c.isdigit() for c in raw) <= 15:
                    continue
                insort(found, (start, end, kind, canonical(kind, raw)))
    people = _people(text)
    if people:
        kinds = _name_kinds(people)
        for _, words in people:
            for s, e, value in words:
                if _free(found, s, e):
                    insort(found, (s, e, kinds.get(value, "initial"), value))
        for entity in _bare_names(text, kinds):
            if _free(found, entity[0], entity[1]):
                insort(found, entity)
    return found


#: A mention with a form of address: the gender it tells, and start, end and value of each name, the surname last. Initials come first.
Person = tuple[str, list[tuple[int, int, str]]]
_INITIAL = re.compile(r"\S\.")


def _cased(c: str) -> bool:
    return c.lower() != c.upper()


def _people(text: str) -> list[Person]:
    out: list[Person] = []
    if any(w in text for w in _GENDER):
        for m in FORMS.finditer(text):
            forms = re.findall(rf"({_TITLE})(\.?)", m.group(1))
            if all(w in _WITH_PERIOD and not period for w, period in forms):
                continue
            names = _names_after(text, m.end(), MOST_NAMES - forms[-1][0].isupper())
            if names:
                out.append((next((_GENDER[w] for w, _ in forms if _GENDER[w] != "u"), "u"), names))
    if any(w in text for w in AFTER):
        for m in NAMES_BEFORE.finditer(text):
            k = next(i for i in (1, 3, 5, 7) if m.group(i))
            if not m.group(k).endswith(NO_NAMES):
                out.append((AFTER[m.group(k + 1)], [(*m.span(k), m.group(k))]))
    return out


def _names_after(text: str, at: int, most: int) -> list[tuple[int, int, str]]:
    """The names of the person whose form of address ends at ``at``: at most ``most``, with initials and particles among them."""
    names: list[tuple[int, int, str]] = []
    initials: list[tuple[int, int, str]] = []
    waiting: list[tuple[int, int, str]] = []  # initials and particles count if a name follows
    particles: list[tuple[int, int, str]] = []
    while len(names) < most and len(particles) <= MOST_PARTICLES:
        m = INITIALS.match(text, at)
        if m and all(c.isupper() for c in m.group() if c.isalpha()):
            waiting += [(i, i + 1, f"{text[i].lower()}.") for i in range(at, m.end()) if text[i].isalpha()]
            at = m.end()
        m = NAME_WORD.match(text, at)
        if m is None:
            break
        name = _POSSESSIVE.sub("", m.group().rstrip("'’-_"))
        space = _SPACE.match(text, m.end())
        if name.lower() in PARTICLES and space and name == m.group():
            particles.append((at, at + len(name), name.lower()))
        elif _cased(name[0]) and not name[0].isupper() or name.lower() in _TITLES:
            break
        else:
            names.append((at, at + len(name), name.lower()))
            initials, waiting, particles = initials + waiting, [], []
            # where a name of several words ends isn't seen in scripts without case
            if not _cased(name[0]) or name != m.group():
                break
        if not space:
            break
        at = space.end()
    if not names:  # a surname may look like a particle
        names = [p for p in particles if text[p[0]].isupper()][:1]
    return initials + names


def _name_kinds(people: list[Person]) -> dict[str, str]:
    """One kind for each name of a document: surname, or given with the gender that is known. Parts of double names are names too."""
    people = [(told, [w for w in words if not _INITIAL.fullmatch(w[2])]) for told, words in people]
    surname: dict[str, bool] = {}
    gender: dict[str, str] = {}
    of_surname: dict[str, str] = {}
    for told, words in sorted(people, key=lambda p: len(p[1]) == 1):  # full names tell the roles
        for i, (_, _, value) in enumerate(words):
            whole = _script(value[0]) in _FIRST
            surname.setdefault(value, i == len(words) - 1 and not whole)
            if whole and told != "u":
                gender.setdefault(value, told)
        if told != "u":
            of_surname.setdefault(words[-1][2], told)
            for _, _, value in words[:-1]:
                gender.setdefault(value, told)
    for _, words in people:
        for _, _, value in words[:-1]:
            if words[-1][2] in of_surname:
                gender.setdefault(value, of_surname[words[-1][2]])
    kinds = {v: "surname" if last else f"given-{gender.get(v, 'u')}" for v, last in surname.items()}
    for v, kind in list(kinds.items()):
        for part in _PART.findall(v):
            if len(part) > 1 and part not in PARTICLES:
                kinds.setdefault(part, kind)
    return kinds


def _bare_names(text: str, kinds: dict[str, str]) -> Iterator[Entity]:
    """Every mention of the names in ``kinds`` that is written as a name is."""
    kinds = {v: k for v, k in kinds.items() if len(v) > 1 and v not in _TITLES}
    for m in _BARE.finditer(text) if kinds else ():
        whole = _POSSESSIVE.sub("", m.group())
        spans = [(m.start(), whole)] if whole.lower() in kinds else [(m.start() + p.start(), p.group()) for p in _PART.finditer(m.group())]
        for s, w in spans:
            if w.lower() in kinds and (w[0].isupper() or not _cased(w[0])) and not (w.lower() in MONTHS and _is_month(text, s, s + len(w))):
                yield s, s + len(w), kinds[w.lower()], w.lower()
    unspaced = [v for v in kinds if _script(v[0]) in ("cjk", "katakana", "hangul")]
    if unspaced:  # no spaces tell where these begin
        for m in re.finditer("|".join(map(re.escape, sorted(unspaced, key=len, reverse=True))), text):
            yield m.start(), m.end(), kinds[m.group()], m.group()


def _is_month(text: str, start: int, end: int) -> bool:
    """Is the word at start .. end the month: after a word of time, or beside a number?"""
    before = text[max(0, start - 16) : start].split()[-1:]
    return bool(before) and (before[0].lower().strip("-,") in BEFORE_MONTHS or before[0].rstrip(".,")[-1:].isdigit()) or text[end : end + 2].strip().isdigit()


def canonical(kind: str, raw: str) -> str:
    """One spelling for all mentions of an entity."""
    if kind in ("card", "iban", "ssn"):
        return re.sub(r"[ -]", "", raw)
    if kind == "phone":
        return ("+" if raw[0] == "+" else "") + re.sub(r"\D", "", raw)
    return raw.lower() if kind in ("email", "ipv6") else raw


_PLAIN = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_CJK = "".join(map(chr, range(0x4E00, 0x9FA6)))
_HEX = "0123456789abcdef"
#: ASCII signs that may be in a secret.
_SIGNS = "!#$%&()*+-./:<=>?@[]^_`{|}~"


@lru_cache(1 << 14)
def _alphabet(c: str, signs: bool) -> str | None:
    """The characters that may stand for ``c``, itself among them; None where it stays.

    Beyond ASCII and ideographs these are the characters of its sort in its block
    of 128. Letters whose case can't be changed and changed back are a sort of
    their own.
    """
    for a in (*_PLAIN, *((_SIGNS,) if signs else ())):
        if c in a:
            return a
    if c.isascii():
        return None
    if "一" <= c <= "龥":
        return _CJK
    sort = lambda x: (unicodedata.category(x), x.upper().lower() == x, x.lower().upper() == x)
    if not signs and sort(c)[0][0] not in "LMN":
        return None
    first = ord(c) & ~0x7F
    same = "".join(x for x in map(chr, range(first, first + 128)) if sort(x) == sort(c))
    return same if len(same) > 1 else None


def _noise(key: bytes, *parts: object) -> int:
    return int.from_bytes(blake2b("|".join(map(str, parts)).encode(), key=key, digest_size=64).digest(), "big")


def _feistel(key: bytes, tweak: str, value: int, radices: list[int]) -> int:
    """A permutation of 0 .. prod(radices) - 1, chosen by key and tweak."""
    half = len(radices) // 2
    right, left = prod(radices[half:]), prod(radices[:half])
    a, b = divmod(value, right)
    for r in range(ROUNDS):
        if r % 2 == 0 and left > 1:
            a = (a + _noise(key, tweak, r, b)) % left
        else:
            b = (b + _noise(key, tweak, r, a)) % right
    return a * right + b


def permute(key: bytes, tweak: str, text: str, hexadecimal: bool = False, signs: bool = False) -> str:
    """``text`` with each letter and digit (with ``signs`` each character) changed within its alphabet, the rest kept.

    Long texts are permuted by pieces of ``PIECE`` characters.
    """
    if len(text) > PIECE:
        return "".join(permute(key, f"{tweak}|{k}", text[k : k + PIECE], hexadecimal, signs) for k in range(0, len(text), PIECE))
    alphabets = [_HEX if hexadecimal and c in _HEX else _alphabet(c, signs) for c in text]
    radices = [len(a) for a in alphabets if a]
    if not radices:
        return text
    value = 0
    for c, a in zip(text, alphabets, strict=True):
        if a:
            value = value * len(a) + a.index(c)
    form = "".join("x" if a else c for c, a in zip(text, alphabets, strict=True))
    value = _feistel(key, f"{tweak}|{form}|{radices}", value, radices)
    out = []
    for c, a in zip(reversed(text), reversed(alphabets), strict=True):
        if a:
            value, d = divmod(value, len(a))
            c = a[d]
        out.append(c)
    return "".join(reversed(out))


def _more(key: bytes, tweak: str, value: str, n: int, alphabet: str) -> str:
    """``n`` keyed characters that widen a format."""
    seed, out = _noise(key, tweak, value, "more"), ""
    for k in range(n):
        if k % 40 == 39:
            seed = _noise(key, tweak, value, k)
        seed, d = divmod(seed, len(alphabet))
        out += alphabet[d]
    return out


# Syllables and endings by script, for spelling names.
_SYLLABLES = {
    "latin": [a + b for a in "bdfglmnprstv" for b in "aeiou"],
    "cyrillic": [a + b for a in "бвгдлмнпрст" for b in "аеиоу"],
    "greek": [a + b for a in "βγδλμνπρστ" for b in "αεηιο"],
    "arabic": [a + b for a in "بتدرسفكلمن" for b in "اوي"],
    "cjk": list("文明建国志华永平安乐春秋清和天立大中新成"),
    "katakana": list("アイウエオカキクケコサシスセソタチツテトナニノマミメモラリルレロ"),
    "hangul": list("가나다라마바사아자하고노도로모보소오호기미지시리"),
}
_ENDINGS = {
    "latin": {"m": ("n", "r", "s", "ld"), "f": ("na", "lia", "ra", "nia"), "u": ("l", "n"), "surname": ("son", "mer", "ner", "ly")},
    "cyrillic": {"m": ("н", "р", "й"), "f": ("на", "ра", "ия"), "u": ("н", "л"), "surname": ("ко", "нук", "вич")},
    "greek": {"m": ("ς", "ος"), "f": ("να", "ια"), "u": ("ης",), "surname": ("ίδης", "άκης")},
    "arabic": {"m": ("د", "م"), "f": ("ة", "ى"), "u": ("ن",), "surname": ("ني", "دي")},
    "cjk": {"m": ("伟", "强", "军", "杰"), "f": ("芳", "娜", "静", "丽"), "u": ("宁", "林"), "surname": ("田", "川", "村")},
    "katakana": {"m": ("ロウ", "スケ"), "f": ("コ", "ミ"), "u": ("ン",), "surname": ("ダ", "ムラ")},
    "hangul": {"m": ("준", "호"), "f": ("희", "숙"), "u": ("진",), "surname": ("우", "원")},
}
#: First characters of whole names, in scripts where the surname is the first.
_FIRST = {"cjk": HAN_SURNAMES, "hangul": HANGUL_SURNAMES}


@lru_cache(1 << 12)
def _script(c: str) -> str:
    return unicodedata.name(c, "?").split()[0].split("-")[0].lower()


def _name(key: bytes, kind: str, value: str, draw: int) -> str:
    """Each part of the name spelt anew; in a script without syllables here, permuted within it."""
    return _PART.sub(lambda m: _spelt(key, kind, m.group(), draw), value)


def _spelt(key: bytes, kind: str, part: str, draw: int) -> str:
    script = _script(part[0])
    if script not in _SYLLABLES:
        tail = _more(key, kind, part, draw - OWN_SPACE + 1, _alphabet(part[-1], True) or _PLAIN[1]) if draw >= OWN_SPACE else ""
        return permute(key, f"{kind}|{draw}", part) + tail
    seed = _noise(key, kind, part, draw)
    first = _FIRST.get(script, "")
    out = ""
    if first:
        seed, k = divmod(seed, len(first))
        out = first[k]
    for k in range((0 if first else 2 if kind == "surname" else 1) + 1 + draw):
        if k % 40 == 39:
            seed = _noise(key, kind, part, draw, k)
        seed, d = divmod(seed, len(_SYLLABLES[script]))
        out += _SYLLABLES[script][d]
    endings = _ENDINGS[script]["surname" if kind == "surname" else kind[-1]]
    return out + endings[seed % len(endings)]


def is_name(kind: str) -> bool:
    return kind == "surname" or kind.startswith("given")


def surrogate(kind: str, value: str, draw: int = 0, key: bytes = KEY) -> str:
    """The replacement of a canonical value; another for each ``draw``."""
    tweak = f"{kind}|{draw}"
    wider = max(draw - OWN_SPACE + 1, 0)
    if is_name(kind):
        return _name(key, kind, value, draw)
    if kind == "ip":
        return _address(key, tweak, value, draw)
    if kind == "email":
        local, _, domain = value.rpartition("@")
        local = permute(key, f"{tweak}|{domain}", local) + _more(key, tweak, value, wider, _PLAIN[1])
        if not any(domain == r or domain.endswith(f".{r}") for r in RESERVED):
            host, _, top = domain.rpartition(".")
            domain = f"{permute(key, 'domain', host)}.{top}"
        return f"{local}@{domain}"
    if kind == "ipv6":
        return permute(key, tweak, value, hexadecimal=True) + _more(key, tweak, value, wider, _HEX)
    if kind == "secret":
        return _secret(key, tweak, value) + _more(key, tweak, value, wider, _HEX)
    digits = _more(key, tweak, value, wider, _PLAIN[0])
    if kind == "card":
        body = value[0] + permute(key, tweak, value[1:-1]) + digits
        return body + str((10 - luhn(body + "0")) % 10)
    if kind == "iban":
        body = permute(key, tweak, value[4:]) + digits
        rest = int("".join(str(int(c, 36)) for c in body + value[:2] + "00")) % 97
        return f"{value[:2]}{98 - rest:02d}{body}"
    if kind == "phone":
        keep = min(2, len(value) - 7) if value[0] == "+" else 0
        return value[:keep] + permute(key, tweak, value[keep:]) + digits
    return permute(key, tweak, value) + digits


def _secret(key: bytes, tweak: str, value: str) -> str:
    """Letters and digits are permuted, signs too where the others leave too few values; what has no alphabet gives hexadecimal digits."""
    if len(value) >= 16 and set(value) <= set(_HEX):
        return permute(key, tweak, value, hexadecimal=True)
    few = prod(len(_alphabet(c, False) or "x") for c in value[:16]) < 1 << 20
    if few and not any(_alphabet(c, True) for c in value):
        return _more(key, tweak, value, len(value), _HEX)
    return permute(key, tweak, value, signs=few)


def _address(key: bytes, tweak: str, value: str, draw: int) -> str:
    """Within the same private network, or from public to public addresses; see the module for full ones."""
    parts = [int(p) for p in value.split(".")]
    fixed = 1 if parts[0] in (10, 127) else 2 if parts[:2] == [192, 168] or parts[0] == 172 and 16 <= parts[1] < 32 else 0
    if draw >= OWN_SPACE:
        noise = _noise(key, tweak, value)
        if fixed and draw < 2 * OWN_SPACE:
            return ".".join(map(str, (10, *(noise & 0xFFFFFF).to_bytes(3, "big"))))
        number = f"{noise & (1 << 96) - 1:024x}"
        return ("fd00:0:" if fixed else "2001:db8:") + ":".join(number[k : k + 4] for k in range(0, 24, 4))
    number = int.from_bytes(bytes(parts[fixed:]), "big")
    while True:
        number = _feistel(key, f"{tweak}|{parts[:fixed]}", number, [256] * (4 - fixed))
        new = [*parts[:fixed], *number.to_bytes(4 - fixed, "big")]
        private = new[0] in (0, 10, 127) or new[0] > 223 or new[:2] == [192, 168] or new[0] == 172 and 16 <= new[1] < 32
        # A start outside the public range may come back to itself; it leaves the loop at once.
        if fixed or not private or parts[0] in (0,) or parts[0] > 223:
            return ".".join(map(str, new))


def shaped(kind: str, raw: str, new: str) -> str:
    """The surrogate in the format of the mention: its separators and its case."""
    if kind in ("card", "iban", "phone", "ssn"):
        signs = iter(new.lstrip("+"))
        return "".join(next(signs, "") if c.isalnum() else c for c in raw) + "".join(signs)
    if kind == "email":
        if raw.isupper():
            return new.upper()
        return new[0].upper() + new[1:] if raw[0].isupper() else new
    if is_name(kind):
        return new.upper() if raw.isupper() and len(raw) > 1 else _PART.sub(lambda m: m.group()[0].upper() + m.group()[1:], new)
    return new


#: For entities that differ from their first draw: the kind to draw as, and the draw.
Fixes = dict[tuple[str, str], tuple[str, int]]


def replaced(text: str, fixes: Fixes | None = None, key: bytes = KEY) -> tuple[str, list[str]]:
    """The text with its entities replaced, and their kinds in order."""
    found = detect(text)
    if not found:
        return text, []
    drawn = {}
    for _, _, kind, value in found:
        if kind != "initial" and (kind, value) not in drawn:
            as_kind, draw = (fixes or {}).get((kind, value), (kind, 0))
            drawn[kind, value] = surrogate(as_kind, value, draw, key)
    given = {v[0]: new[0] for (k, v), new in sorted(drawn.items(), reverse=True) if k.startswith("given")}
    out, at = [], 0
    for start, end, kind, value in found:
        if kind == "initial":
            new = (given.get(value[0]) or permute(key, kind, value[0])).upper()
        else:
            new = shaped(kind, text[start:end], drawn[kind, value])
        out += [text[at:start], new]
        at = end
    return "".join([*out, text[at:]]), [f[2] for f in found]


MENTION = "place long, kind string, value string"


def _place(docs: DataFrame) -> DataFrame:
    """With ``__place``: a hash of id and text. Rows that meet in it by chance only share their fixes, which are by value."""
    return docs.withColumn("__place", F.xxhash64("doc_id", "text"))


def mentions(docs: DataFrame) -> DataFrame:
    """Distinct ``place``, ``kind``, ``value`` of all documents, however often a row is repeated; initials have no draws."""
    target = arrow_schema(MENTION)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, k, v) for p, t in zip(batch.column("place").to_pylist(), batch.column("text").to_pylist(), strict=True) if t for k, v in dict.fromkeys(e[2:] for e in detect(t)) if k != "initial"]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), target, strict=True)], schema=target)

    return _place(docs).select(F.col("__place").alias("place"), "text").mapInArrow(tidied(run), MENTION).distinct()


def drawn_as(found: DataFrame) -> DataFrame:
    """``found`` with ``drawn``: the kind, with the one gender that the corpus knows for a given name of none.

    A common name is broadcast to its mentions, so none fills a task.
    """
    drawn = F.col("kind").alias("drawn")
    if found.where("kind = 'given-u'").isEmpty():
        return found.select("*", drawn)
    known = F.when(F.col("kind") != "given-u", F.col("kind"))
    names = found.where("kind like 'given-%'").groupBy("value").agg(F.min(known).alias("told"), F.max(known).alias("other"), F.count_if(F.col("kind") == "given-u").alias("rows"))
    names = written(names.where("rows > 0").select("value", F.when(F.col("told") == F.col("other"), F.col("told")).alias("told"), "rows"), "genders")
    total = names.agg(F.sum("rows")).first()[0]
    none = hot_join(found.where("kind = 'given-u'"), names, "value", "rows", total, "inner").select(*found.columns, F.coalesce("told", "kind").alias("drawn"))
    return written(found.where("kind <> 'given-u'").select("*", drawn).union(none), "mentions")


def settled(values: DataFrame, key: bytes = KEY) -> DataFrame:
    """(``kind``, ``value``, ``draw``, ``surrogate``) with all surrogates distinct and none a real value.

    Names of all kinds are one space. A surrogate that two values share stays
    with the lower one; the others, and those that are real values, are drawn
    again until none meets another. Draws widen the format after ``OWN_SPACE``
    of them, so there is always an end.
    """
    schema = "kind string, value string, draw int, surrogate string"
    target = arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = batch.to_pydict()
            new = [surrogate(k, v, d, key) for k, v, d in zip(c["kind"], c["value"], c["draw"], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c["kind"]), pa.array(c["value"]), pa.array(c["draw"], pa.int32()), pa.array(new, pa.string())], schema=target)

    space = F.when(F.col("kind").startswith("given") | (F.col("kind") == "surname"), "name").otherwise(F.col("kind"))
    real = written(values.select("kind", "value").distinct(), "entities")
    taken = real.select(space.alias("space"), F.col("value").alias("surrogate"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("value"), F.lit(-1).alias("draw")).distinct()
    now = written(real.withColumn("draw", F.lit(0)).mapInArrow(run, schema), "surrogates")
    while True:
        rows = now.select(space.alias("space"), "surrogate", "kind", "value", "draw").union(taken)
        by = Window.partitionBy("space", "surrogate")
        met = rows.withColumn("real", F.max(F.col("value").isNull()).over(by)).withColumn("nth", F.row_number().over(by.orderBy(F.col("value").asc_nulls_last(), "kind")))
        again = written(met.where("value is not null and (real or nth > 1)").select("kind", "value", (F.col("draw") + 1).alias("draw")), "again")
        if again.isEmpty():
            return now
        now = written(now.join(again.select("kind", "value"), ["kind", "value"], "left_anti").union(again.mapInArrow(run, schema)), "surrogates")


COUNTS = "__pii_kinds"


def key_of(spark: SparkSession, key: bytes | None = None) -> bytes:
    """``key``, else that of the session, else the samples' key."""
    named = spark.conf.get(KEY_SETTING, None)
    return key or (named.encode() if named else KEY)


def rewrite(docs: DataFrame, key: bytes | None = None, kinds: bool = False) -> DataFrame:
    """``docs`` with surrogates in ``text``; ``n_chars``, if there, follows the text.

    With ``kinds`` a column ``__pii_kinds`` lists the kinds replaced. A null
    text stays null. Rows with null or repeated ids are rewritten like others.
    ``key`` falls back to the session's ``spark.tiermeter.pii.key``.
    """
    key = key_of(docs.sparkSession, key)
    found = drawn_as(written(mentions(docs), "mentions"))
    odd = settled(found.select(F.col("drawn").alias("kind"), "value"), key).where("draw > 0").select(F.col("kind").alias("drawn"), "value", "draw")
    columns = [f for f in docs.schema.fields]
    if odd.isEmpty() and found.where("drawn <> kind").isEmpty():
        source = docs.withColumn("__fixes", F.lit(None).cast("string"))
    else:
        # A frequent entity is spread over tasks by the number of mentions.
        salts = found.count() // SALT_ROWS + 1
        spread = odd.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        fixed = found.withColumn("salt", F.pmod(F.xxhash64("place"), F.lit(salts)).cast("int")).join(spread, ["drawn", "value", "salt"], "left").where("draw is not null or drawn <> kind")
        of_doc = fixed.groupBy("place").agg(F.to_json(F.collect_list(F.struct("kind", "value", "drawn", F.coalesce("draw", F.lit(0)).alias("draw")))).alias("__fixes"))
        # Written, so that Catalyst knows its size and broadcasts it only if small.
        source = _place(docs).join(written(of_doc.withColumnRenamed("place", "__place"), "fixes"), "__place", "left")
    out_schema = docs.schema
    if kinds:
        out_schema = docs.withColumn(COUNTS, F.array().cast("array<string>")).schema
    source = source.select(*[F.col(f"`{f.name}`") for f in columns], "__fixes")
    return source.mapInArrow(tidied(_rewriter(key, kinds, [f.name for f in columns])), out_schema)


def _rewriter(key: bytes, kinds: bool, names: list[str]) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new, listed, sizes = [], [], []
            for text, fixes in zip(batch.column("text").to_pylist(), batch.column("__fixes").to_pylist(), strict=True):
                other = {(d["kind"], d["value"]): (d["drawn"], d["draw"]) for d in json.loads(fixes)} if fixes else None
                t, k = (None, []) if text is None else replaced(text, other, key)
                new.append(t)
                listed.append(k)
                sizes.append(None if t is None else len(t))
            arrays = {n: batch.column(n) for n in names}
            arrays["text"] = pa.array(new, batch.schema.field("text").type)
            if "n_chars" in arrays:
                old = arrays["n_chars"]
                arrays["n_chars"] = pa.array([s if k else o for s, k, o in zip(sizes, listed, old.to_pylist(), strict=True)], old.type)
            if kinds:
                arrays[COUNTS] = pa.array(listed, pa.list_(pa.string()))
            yield pa.RecordBatch.from_pydict(arrays)

    return run


def surrogates(docs: DataFrame, key: bytes | None = None) -> DataFrame:
    """``doc_id``, ``text`` with surrogates, ``n_replaced`` and ``kinds`` for every row.

    A null text stays null with nothing replaced; an empty table gives an empty
    result.
    """
    out = rewrite(docs.select("doc_id", "text"), key, kinds=True)
    return out.select("doc_id", "text", F.size(COUNTS).cast("long").alias("n_replaced"), F.array_join(COUNTS, ",").alias("kinds"))
