"""Personal data replaced by keyed surrogates.

Entities are mail addresses, telephone numbers, IP addresses, account, card-like and social security numbers, secrets and names of persons. A
surrogate depends on the key and the entity alone, so mentions of one stay mentions of one, in every document, however they are written: mail addresses
are known by their letters whatever their case, telephone numbers by their digits without country and trunk codes, the others without separators. It keeps
the type and the format: letters stay letters of their script and case, digits digits, separators where they are, Luhn numbers
Luhn numbers. A name is found after a title or by a known given name; from there on every mention of its family name or of one of its given names in the
document counts. It is replaced part by part, given names by given names of the same gender, family names by family names, in their script,
so that "Mr Adam Weber", "Mr Weber" and "Adam Weber" stay one person. A given name has one gender in all the corpus: that of its
mentions with a title or of the list; where these differ, or say nothing, the surrogate is of either. For one format the replacement is a
permutation (a Feistel network), so different entities cannot meet; a surrogate that is another entity of the corpus, or that of
another, is found by a join and drawn again until none is left.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import unicodedata
from bisect import bisect
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.shared import mapped, pieces, written

#: Entities drawn again that may be sent to all tasks; more are joined to the documents instead.
REDRAWN_TO_ALL = 100_000
HEX = "0123456789abcdef"
#: Draws that keep the format. A format with too few values for its entities is left by making the surrogate longer.
FORMAT_DRAWS = 8

#: Given names and family names by script and gender, and the titles that announce a name of a gender.
NAMES = {
    ("latin", "m"): "Adam Albert Andre Anton Bruno Carlos Daniel Edgar Emil Felix Georg Hugo Ivan Jonas Karl Leo Lukas Marco Martin Niklas Oscar Pablo Paul Peter Rafael Robert Samuel Simon Thomas Victor".split(),
    ("latin", "f"): "Alma Anna Berta Carla Clara Diana Elena Emma Eva Frida Greta Hanna Ida Julia Karin Laura Lena Lucia Maria Marta Nina Olga Paula Petra Rosa Sara Sofia Tina Vera Wanda".split(),
    ("latin", "last"): "Abel Acker Baker Bauer Bellini Blanc Brandt Castro Costa Diaz Dubois Engel Fischer Fontana Garnier Graf Hansen Herrera Jensen Keller Lambert Lang Lorenz Marin Martel Meyer Molina Moreau Novak Ortega Pereira Richter Rossi Schmidt Serrano Silva Turner Vega Weber Wolf".split(),
    ("cyrillic", "m"): "Алексей Антон Борис Виктор Глеб Денис Егор Иван Кирилл Максим Николай Олег Павел Роман Тимур".split(),
    ("cyrillic", "f"): "Алина Анна Вера Галина Дарья Елена Зоя Ирина Ксения Лидия Мария Нина Ольга Полина Яна".split(),
    ("cyrillic", "last"): "Белых Волошенко Гончаренко Долгих Жук Коваленко Крутых Мельник Мороз Назаренко Седых Ткаченко Черных Шевченко Юрченко".split(),
}
#: Family names beyond the lists are built: syllables of an onset and a vowel, then an ending that no gender changes.
SYLLABLES = {
    "latin": ([o + v for o in "b d f g h k l m n p r s t v w z br dr gr kl kr tr".split() for v in "aeiou"], "ck ld ler lt mer nd ner rt ser tz".split()),
    "cyrillic": ([o + v for o in "б в г д з к л м н п р с т х ч бр гр кр тр".split() for v in "аеиоу"], ["нко", "шко", "йко", "лко", "ченко", "щенко", "ренко", "менко", "ненко", "тенко"]),
}
#: Endings of built given names, by script and gender.
GIVEN_ENDINGS = {("latin", "m"): "o us an or ert".split(), ("latin", "f"): "a ia ina elle ette".split(), ("cyrillic", "m"): "ан ий ор ей ир".split(), ("cyrillic", "f"): "а ия ина ея ана".split()}
#: Attempts at the lists before names are built.
LISTED = 3
#: Titles by the gender that they tell (u: none).
TITLES = {"m": "Mr Herr Señor Monsieur Sir Господин Г-н".split(), "f": "Mrs Ms Miss Frau Señora Señorita Madame Mme Госпожа Г-жа".split(), "u": "Dr Prof Doktor Professor Professorin Docteur Доктор Профессор".split()}

_UPPER, _LOWER = "A-ZÀ-ÖØ-ÞА-ЯЁ", "a-zß-öø-ɏа-яё"
_CAP = rf"[{_UPPER}](?:['’][{_UPPER}])?[{_UPPER}{_LOWER}]+(?:[-'’][{_UPPER}][{_UPPER}{_LOWER}]+)*"
_FULL = rf"{_CAP}(?:(?: (?:van|von|der|den|de|da|di|del|la|le))* {_CAP}){{0,2}}"
_VALUE = r"[^\s\"'<>]*[^\s\"'<>.,;:)\]}]"
_WORDS_OF_SECRETS = r"(?i:api[_-]?key|access[_-]?key|secret[_-]?key|private[_-]?key|client[_-]?secret|token|secret|passw(?:or)?d|passphrase|pwd)"
#: (type, pattern, what every text with a match has: the name of a cheap test): the entity is the first group that took part, or the whole match.
_PATTERNS = [
    ("email", re.compile(r"(?<![\w.+%-])\w[\w.+%-]*@[^\W_](?:[\w-]*[^\W_])?(?:\.[^\W_](?:[\w-]*[^\W_])?)*\.[^\W\d_]{2,}"), "at"),
    ("secret", re.compile(rf"{_WORDS_OF_SECRETS}[\"']?\s?(?:=>|[=:])\s?(?:\"([^\"\n]{{4,}})\"|'([^'\n]{{4,}})')"), "word"),
    ("secret", re.compile(rf"{_WORDS_OF_SECRETS}[\"']?[=:]((?=[^\s\"'<>]*[^\W_]){_VALUE}(?<=\S{{4}}))"), "word"),
    ("secret", re.compile(rf"{_WORDS_OF_SECRETS}[\"']?\s?(?:=>|[=:])\s((?=[^\s\"'<>]*\d){_VALUE}(?<=\S{{6}}))"), "word"),
    ("secret", re.compile(r"\b[Bb]earer ([A-Za-z0-9._~+/-]{16,}=*)"), "bearer"),
    ("secret", re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----([A-Za-z0-9+/=\s]*+)-----END"), "pem"),
    ("secret", re.compile(rf"{_WORDS_OF_SECRETS} (?:is|was|ist|lautet|est|es):? [\"'“]?((?=[^\s\"'<>“”]*\d)[^\s\"'<>“”]*[^\s\"'<>“”.,;:)\]}}](?<=\S{{6}}))"), "word"),
    ("secret", re.compile(r"(?<![\w-])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+)\b"), "mark"),
    ("secret", re.compile(r"\b(?:(?=[0-9a-f]*[a-f])(?=[0-9a-f]*\d)[0-9a-f]{32,64}|(?=[0-9A-F]*[A-F])(?=[0-9A-F]*\d)[0-9A-F]{32,64})\b", re.A), "hex"),
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)", re.A), "account"),
    ("ip6", re.compile(r"(?<![\w:.])(?=[0-9A-Fa-f:]*\d)[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:])", re.A), "colons"),
    ("ip", re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d)", re.A), "dots"),
    ("card", re.compile(r"(?<![\d.])(?:\d{4}([ -]?)\d{4}\1\d{4}\1\d{1,7}|\d{13,19})(?!\d)", re.A), "long"),
    ("ssn", re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", re.A), "dashed"),
    ("phone", re.compile(r"(?<![\w.+])(?:\+\d{1,3}[ .-]?(?:\(0\) ?)?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,5}(?!\w)|(?<![\w.])\+\d{8,15}(?!\w)", re.A), "groups"),
    ("phone", re.compile(r"(?<![\w.+/-])(?:\+\d{1,3} ?\(0\) ?\d{2,4}|\+\d{1,3}[ /-]\d{2,4}|\(?0\d{2,4}\)?) ?[ /-] ?\d{6,8}(?![\w/-])", re.A), "groups"),
]
_RUNS = {
    "hex": re.compile(r"[0-9a-fA-F]{32}"), "dots": re.compile(r"[0-9]\.[0-9]{1,3}\.[0-9]"), "long": re.compile(r"[0-9]{4}[ -]?[0-9]{4}"),
    "dashed": re.compile(r"[0-9]-[0-9]{2}-[0-9]"), "groups": re.compile(r"[0-9]{2}\)? ?[ ./-] ?[0-9]{3}|\+[0-9]{8}|\(0\)"), "account": re.compile(r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}"), "colons": re.compile(r":[0-9A-Fa-f]{0,4}:"),
}
_DIGIT = re.compile("[0-9]")
_FOLDED, _MARKS = ("key", "token", "secret", "pass", "pwd"), ("AKIA", "gh", "sk-", "xox", "eyJ")


def _tests(text: str) -> set[str]:
    """The cheap tests that a text passes: each is necessary for the patterns that it stands for, so none hides an entity."""
    folded = text.casefold()
    out = {k for k, hit in (("at", "@" in text), ("bearer", "earer " in text), ("pem", "PRIVATE KEY" in text), ("word", any(x in folded for x in _FOLDED)), ("mark", any(x in text for x in _MARKS))) if hit}
    return out | {k for k, run in _RUNS.items() if run.search(text)} if _DIGIT.search(text) else out


_TITLE = "|".join(sorted((x for v in TITLES.values() for x in v), key=len, reverse=True))
_NAME = re.compile(rf"\b((?:{_TITLE})(?:\.? (?:{_TITLE})\b){{0,3}})\.? ({_FULL})")
#: Not within a word joined by hyphens, so that each part of it is read once.
_PERSON = re.compile(rf"(?<!\w)(?<!\w[-'’])({_CAP})(?= ({_CAP}))")
_KNOWN = {n: g for (_, g), names in NAMES.items() if g != "last" for n in names}
#: What every text with a name has: a title or a known given name.
_ANNOUNCED = re.compile("|".join(sorted({*_KNOWN, *(x for v in TITLES.values() for x in v)}, reverse=True)))
_GENDER = {t: g for g, ts in TITLES.items() for t in ts}
_TOKEN = re.compile(rf"[{_UPPER}{_LOWER}]{{2,}}")


def _tokens(kind: str, said: str) -> list[tuple[int, int, str]]:
    """(from, to, type) of the parts of a name: those before its last word are given names; particles and single letters are no parts."""
    found = [m.span() for m in _TOKEN.finditer(said) if said[m.start()].isupper()]
    last = said.rfind(" ") + 1
    return [(a, b, "family" if a >= last and kind.startswith("name_") else f"given_{_KNOWN.get(said[a:b].capitalize(), kind[-1])}") for a, b in found]


def _names(text: str) -> list[tuple[int, int, str]]:
    """(from, to, name_ or given_ and the gender). Names that are announced come first; then mentions of their parts."""
    if not _ANNOUNCED.search(text):
        return []
    found = [(*m.span(2), f"name_{next((g for t in re.split(r'[. ]+', m[1]) if (g := _GENDER[t]) != 'u'), 'u')}") for m in _NAME.finditer(text)]
    for m in _PERSON.finditer(text):
        if g := _KNOWN.get(m[1]):
            found.append((m.start(), m.end(2), f"name_{g}"))
    if not found:
        return found
    role: dict[str, str] = {}
    for a, b, kind in found:
        for x, y, part in _tokens(kind, text[a:b]):
            role.setdefault(text[a + x : a + y], part)
    known = {t.upper(): t for t in role} | {t: t for t in role}
    run: list[tuple[int, int, str]] = []
    for m in _TOKEN.finditer(text):
        if t := known.get(m[0]):
            if run and run[-1][2] != "family" and text[run[-1][1] : m.start()] == " ":
                run.append((*m.span(), role[t]))
                continue
            found += _said(run)
            run = [(*m.span(), role[t])]
    return found + _said(run)


def _said(run: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """A mention without a title: known given names, a known family name, or both in a row."""
    if not run:
        return []
    g = next((p[-1] for *_, p in run if p != "family"), "u")
    return [(run[0][0], run[-1][1], f"name_{g}" if run[-1][2] == "family" else f"given_{g}")]


def entities(text: str | None) -> list[tuple[int, int, str]]:
    """(from, to, type) of all entities, in order, none inside another; where two overlap the type that is listed first holds, then the earlier one."""
    found: list[tuple[int, int, int, str]] = []
    if not text:
        return []
    passed = _tests(text)
    for rank, (kind, pattern, need) in enumerate(_PATTERNS):
        if need in passed:
            for m in pattern.finditer(text):
                a, b = m.span((m.lastindex or 0) if kind == "secret" else 0)
                if need == "pem":  # without the line breaks around it
                    b -= len(m[1]) - len(m[1].rstrip())
                    a += len(m[1]) - len(m[1].lstrip()) if b > a else 0
                if b > a and (kind not in _CHECKS or _CHECKS[kind](text[a:b])):
                    found.append((rank, a, b, kind))
    found += [(len(_PATTERNS) + n, *x) for n, x in enumerate(_names(text))]
    taken: list[tuple[int, int, str]] = []
    for _, a, b, k in sorted(found):
        at = bisect(taken, (a, b, k))
        if (at == 0 or taken[at - 1][1] <= a) and (at == len(taken) or b <= taken[at][0]):
            taken.insert(at, (a, b, k))
    return taken


def _iban(said: str) -> bool:
    """Whether the check digits fit: letters count as 10 to 35."""
    own = said.replace(" ", "")
    return 15 <= len(own) <= 34 and int("".join(str(int(c, 36)) for c in own[4:] + own[:4])) % 97 == 1


def _ip6(said: str) -> bool:
    try:
        return ipaddress.IPv6Address(said) is not None and len([x for x in said.split(":") if x]) > 1
    except ValueError:
        return False


#: What a match must pass besides.
_CHECKS = {"iban": _iban, "ip6": _ip6}
#: A country code (known by what follows it), and the zero that stands for it or beside it.
_LEAD = re.compile(r"\+1(?=\d{10}$)|\+\d{1,3}(?=[ ./(-])")
_TRUNK = re.compile(r"[ ./-]?\(0\)|\(?0(?=[1-9])")


def _national(said: str) -> int:
    """Where a telephone number's own digits begin: after a country code and a trunk zero."""
    at = m.end() if (m := _LEAD.match(said)) else 0
    return m.end() if (m := _TRUNK.match(said, at)) else at


def _plain(kind: str, said: str) -> str:
    """What all ways of writing an entity have in common."""
    if kind == "email":
        return said.lower() if len(said.lower()) == len(said) else said
    if kind == "phone":
        return re.sub(r"\D", "", said[_national(said) :])
    if kind in ("card", "iban"):
        return re.sub(r"[ -]", "", said)
    return ipaddress.IPv6Address(said).exploded if kind == "ip6" else said


def _dressed(kind: str, said: str, new: str) -> str:
    """A surrogate of a plain entity, written as the mention is: in its case, with its separators; what is longer than the mention follows it."""
    if kind == "email":
        cased = [c.upper() if m.isupper() and len(c.upper()) == 1 else c for c, m in zip(new, said)]
        return "".join(cased) + new[len(cased) :]
    if kind in ("phone", "card", "iban"):
        at, it = _national(said) if kind == "phone" else 0, iter(new)
        return said[:at] + "".join(next(it) if c.isalnum() else c for c in said[at:]) + "".join(it)
    return new


def parts(kind: str, said: str) -> list[tuple[int, int, str, str]]:
    """(from, to, type, entity) of what an entity is replaced by: itself in its plain form, or the parts of a name, in lower case."""
    if kind[:5] not in ("name_", "given"):
        return [(0, len(said), kind, _plain(kind, said))]
    return [(a, b, part, said[a:b].lower()) for a, b, part in _tokens(kind, said)]


def _prf(key: bytes, *parts) -> int:
    return int.from_bytes(hmac.new(key, "\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass"), hashlib.sha256).digest(), "big")


def permuted(key: bytes, tweak: str, value: list[int], radix: list[int]) -> list[int]:
    """A permutation of all digit strings of these radices: each round adds to one half a keyed function of the other."""
    half, out = max(1, len(value) // 2), list(value)
    if len(value) == 1:
        return [(out[0] + _prf(key, tweak, "one") % radix[0]) % radix[0]]
    for r in range(8):
        own, other = (range(half), out[half:]) if r % 2 == 0 else (range(half, len(out)), out[:half])
        x = _prf(key, tweak, r, other)
        for i in own:
            out[i] = (out[i] + x % radix[i]) % radix[i]
            x //= radix[i]
            if x < 1 << 32:
                x = _prf(key, tweak, r, other, i)
    return out


#: Letters of scripts whose pages in Unicode hold many that are hardly used.
ALPHABETS = [x for y in ("абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω") for x in (y, y.upper())]


@lru_cache(4096)
def alphabet(c: str) -> str:
    """The characters that may stand for a letter or digit: of its script and case, near it in Unicode; empty for all others."""
    if c.isdecimal():
        zero = ord(c) - unicodedata.decimal(c)
        return "".join(chr(zero + i) for i in range(10))
    if not c.isalpha():
        return ""
    if own := next((x for x in ALPHABETS if c in x), ""):
        return own
    page = range(ord(c) & ~127, (ord(c) & ~127) + 128) if c.isascii() else range(ord(c) & ~255, (ord(c) & ~255) + 256)
    kind, script = unicodedata.category(c), unicodedata.name(c, "").split(" ")[0]
    return "".join(x for x in map(chr, page) if unicodedata.category(x) == kind and unicodedata.name(x, "").split(" ")[0] == script)


def _respelled(key: bytes, tweak: str, text: str, hexadecimal: bool = False) -> str:
    """A permutation of all texts of the same format. A text without a letter or digit becomes letters, as many."""
    if hexadecimal:
        digits = HEX if any(c in "abcdef" for c in text) else HEX.upper()
        kinds = [digits if c in digits else "" for c in text]
    else:
        kinds = [alphabet(c) for c in text]
    at = [i for i, k in enumerate(kinds) if len(k) > 1]
    if not at:
        return "".join(chr(97 + _prf(key, tweak, "letters", i, text) % 26) for i in range(len(text)))
    shape = "".join(k[0] if len(k) > 1 else c for c, k in zip(text, kinds))
    new = permuted(key, f"{tweak}|{shape}", [kinds[i].index(text[i]) for i in at], [len(kinds[i]) for i in at])
    out = list(text)
    for i, v in zip(at, new):
        out[i] = kinds[i][v]
    return "".join(out)


def _luhn(digits: str) -> bool:
    total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
    return total % 10 == 0


def _part_of_name(key: bytes, tweak: str, text: str, kind: str, attempt: int) -> str:
    """Of the same script and role, in lower case. Later attempts are built from more and more syllables: no number of names uses them up."""
    script = "cyrillic" if re.search("[а-яё]", text) else "latin"
    genders = ("m", "f") if kind == "given_u" else (kind[-1],)
    x = _prf(key, tweak, "name", text)
    if attempt < LISTED:
        names = NAMES[script, "last"] if kind == "family" else [n for g in genders for n in NAMES[script, g]]
        return names[x % len(names)].lower()
    syllables, endings = SYLLABLES[script]
    if kind != "family":
        endings = [e for g in genders for e in GIVEN_ENDINGS[script, g]]
    out, x = endings[x % len(endings)], _prf(key, tweak, "built", text)
    if kind != "family":
        onset = syllables[x % len(syllables)]
        out, x = onset[:-1] + out, x // len(syllables)  # an ending starts with its own vowel
    for i in range(attempt - LISTED + 1):
        out = syllables[x % len(syllables)] + out
        x = x // len(syllables) or _prf(key, tweak, "built", i, text)
    return out


@lru_cache(200_000)
def surrogate(key: bytes, kind: str, attempt: int, text: str) -> str:
    """Of one entity in its plain form (of one part of a name, in lower case)."""
    tweak = f"{kind}|{attempt}"
    if kind == "family" or kind.startswith("given_"):
        return _part_of_name(key, tweak, text, kind, attempt)
    if attempt >= FORMAT_DRAWS:  # too many entities for the format: a longer text, which no number of them uses up
        more = attempt - FORMAT_DRAWS + 1
        return surrogate(key, kind, 0, text) + "".join(str(_prf(key, tweak, "more", i, text) % 10) for i in range(4 * more))
    if kind == "email":
        local, _, host = text.partition("@")
        name, _, end = host.rpartition(".")
        new = _respelled(key, tweak, f"{local}@{name}")
        return f"{new}.{end}"
    if kind == "ip":
        return ".".join(map(str, permuted(key, tweak, [int(x) for x in text.split(".")], [256] * 4)))
    if kind == "ip6":
        return ":".join(re.findall("....", _respelled(key, tweak, text.replace(":", ""), hexadecimal=True)))
    if kind == "iban":  # its own part respelled, with check digits that fit
        own = text[:2] + _respelled(key, f"{tweak}|{text[:2]}", text[4:])
        return f"{own[:2]}{98 - int(''.join(str(int(c, 36)) for c in own[2:] + own[:2] + '00')) % 97:02d}{own[2:]}"
    if kind == "card":
        valid, new = _luhn(text), text
        while True:  # walks the permutation's cycle to the next number that is as valid as this one
            new = _respelled(key, tweak, new)
            if _luhn(new) == valid:
                return new
    return _respelled(key, tweak, text, kind == "secret" and re.fullmatch("[0-9a-f]+|[0-9A-F]+", text) is not None)


def replaced(key: bytes, kind: str, said: str, again: dict) -> str:
    """What stands for a mention; again: (type, attempt) by (type, entity) where the mention's own type and first draw would not do."""
    out, at = [], 0
    for a, b, part, entity in parts(kind, said):
        new = _dressed(kind, said, surrogate(key, *again.get((part, entity), (part, 0)), entity))
        if part == "family" or part.startswith("given_"):  # in the mention's case
            new = new.upper() if said[a:b].isupper() else new.capitalize()
        out += [said[at:a], new]
        at = b
    return "".join([*out, said[at:]])


def _found(batches):
    for batch in pieces(batches):
        seen = {(p, e) for t in batch.column("text").to_pylist() for a, b, k in entities(t) for *_, p, e in parts(k, t[a:b])}
        yield pa.RecordBatch.from_pydict({"kind": pa.array([k for k, _ in seen], pa.string()), "entity": pa.array([e for _, e in seen], pa.string())})


def _drawn(key: bytes):
    def run(batches):
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("kind", "entity", "attempt")))
            new = [surrogate(key, k, n, e) for k, e, n in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, pa.string())], ["kind", "entity", "attempt", "surrogate"])

    return run


def redrawn(docs: DataFrame, key: bytes) -> DataFrame:
    """kind, entity, own_kind, attempt of the entities whose first surrogate will not do: it is an entity of the corpus itself, or some other entity's; and of given names
    whose mentions differ in gender: own_kind is the one for all.

    Later draws have more values than earlier ones, without an end, so the rounds come to one even where a format has too few."""
    said = written(docs.select("text").mapInArrow(_found, "kind string, entity string").distinct(), "entities")
    told = lambda g: F.coalesce(F.max(F.col("kind") == f"given_{g}"), F.lit(False))
    given = said.filter(F.col("kind").startswith("given_")).groupBy("entity").agg(told("m").alias("m"), told("f").alias("f"))
    given = given.select("entity", F.when(F.col("m") & ~F.col("f"), "given_m").when(F.col("f") & ~F.col("m"), "given_f").otherwise("given_u").alias("own_kind"))
    mentions = said.filter(F.col("kind").startswith("given_")).join(given, "entity").select("kind", "entity", "own_kind")
    mentions = written(mentions.union(said.filter(~F.col("kind").startswith("given_")).select("kind", "entity", F.col("kind").alias("own_kind"))), "mentions")
    known = mentions.select(F.col("own_kind").alias("kind"), "entity").distinct()
    real = known.select(F.col("entity").alias("surrogate")).distinct().withColumn("real", F.lit(True))
    order = W.partitionBy("surrogate").orderBy("attempt", "kind", "entity")
    now = known.withColumn("attempt", F.lit(0))
    while True:
        drawn = now.select("kind", "entity", "attempt").mapInArrow(_drawn(key), "kind string, entity string, attempt int, surrogate string")
        checked = drawn.join(real, "surrogate", "left").withColumn("bad", F.coalesce("real", F.lit(False)) | (F.row_number().over(order) > 1))
        checked = written(checked.select("kind", "entity", (F.col("attempt") + F.col("bad").cast("int")).alias("attempt"), "bad"), "checked")
        now = checked.select("kind", "entity", "attempt")
        if not checked.filter("bad").take(1):
            settled = now.select(F.col("kind").alias("own_kind"), "entity", "attempt")
            return mentions.join(settled, ["own_kind", "entity"]).filter("attempt > 0 or own_kind <> kind").select("kind", "entity", "own_kind", "attempt")


FIELDS = [T.StructField("n_entities", T.LongType()), T.StructField("kinds", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))]


def _applied(key: bytes, names: list[str], to_all: dict | None):
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in pieces(batches):
            own = batch.column("_redrawn").to_pylist() if to_all is None else None
            texts, kinds, spans = [], [], []
            for i, t in enumerate(batch.column("text").to_pylist()):
                again = to_all if own is None else {(x["kind"], x["entity"]): (x["own_kind"], x["attempt"]) for x in own[i] or ()}
                out, at, size, ks, sp = [], 0, 0, [], []
                for a, b, k in entities(t):
                    new = replaced(key, k, t[a:b], again)
                    out += [t[at:a], new]
                    sp.append({"start": size + a - at, "end": size + a - at + len(new)})
                    size, at = sp[-1]["end"], b
                    ks.append(k)
                texts.append("".join([*out, t[at:]]) if ks else t)
                kinds.append(ks)
                spans.append(sp)
            arrays = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([len(k) for k in kinds], pa.int64()), pa.array(kinds, pa.list_(pa.string())), pa.array(spans, span)], [*names, *(f.name for f in FIELDS)])

    return run


def _mentions(batches):
    for batch in pieces(batches):
        rows = [(h, p, e) for h, t in zip(batch.column("h").to_pylist(), batch.column("text").to_pylist()) for a, b, k in entities(t) for *_, p, e in parts(k, t[a:b])]
        yield pa.RecordBatch.from_pydict({"h": pa.array([r[0] for r in rows], pa.int64()), "kind": pa.array([r[1] for r in rows], pa.string()), "entity": pa.array([r[2] for r in rows], pa.string())})


def pseudonymised(docs: DataFrame, key: bytes, to_all: int = REDRAWN_TO_ALL) -> DataFrame:
    """docs with text replaced, and n_entities, kinds (of each entity, in order) and spans (the surrogates' places in the new text).

    Null texts stay null, texts without entities as they are. Every entity gets a surrogate, also one without a letter or digit. Columns of docs named
    like the three (or _redrawn, _hash) are replaced. Repeated rows get the same text; no other column matters. Whoever
    has the key can undo the replacement: keep it secret.
    """
    if not key:
        raise ValueError("surrogates need a key")
    docs = docs.drop(*(f.name for f in FIELDS), "_redrawn", "_hash")
    names, schema = docs.columns, T.StructType([*docs.schema.fields, *FIELDS])
    again = written(redrawn(docs, key), "redrawn")
    if again.count() <= to_all:
        sent = {(r["kind"], r["entity"]): (r["own_kind"], r["attempt"]) for r in again.collect()}
        return mapped(docs, _applied(key, names, sent), schema)
    hashed = docs.withColumn("_hash", F.xxhash64("text"))
    told = hashed.select(F.col("_hash").alias("h"), "text").mapInArrow(_mentions, "h long, kind string, entity string").distinct().join(again, ["kind", "entity"])
    told = told.groupBy(F.col("h").alias("_hash")).agg(F.collect_list(F.struct("kind", "entity", "own_kind", "attempt")).alias("_redrawn"))
    return mapped(hashed.join(told, "_hash", "left").drop("_hash"), _applied(key, names, None), schema)


def report(docs: DataFrame, key: bytes) -> DataFrame:
    """The result of op6, one row per row of docs: doc_id, text with surrogates, n_entities, kinds and spans."""
    return pseudonymised(docs.select("doc_id", "text"), key)
