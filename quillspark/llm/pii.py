"""PII: detected entities get surrogates that keep type, script, gender and format.

Detection: e-mail addresses, IPv4 addresses, telephone numbers, payment card numbers, social security numbers, IBANs,
secrets (assignments such as token = "..." and known key forms) and names after a courtesy title or with a known given
name. Each detector first asks for a cheap sign (an @, a digit, a title), so clean texts cost one pass.

Surrogates: a key and the entity's type permute the space of the entity's own format: digits become digits, hex digits
hex digits, letters letters of their script and case, address parts others of as many digits, and marks stay where they
are. The permutation is one cycle through all values of the format (a step of one, seen through a keyed Feistel
permutation), so no value with another of its format maps to itself, and different originals have different surrogates:
coreference and distinctness hold over the corpus without a table, and a surrogate depends on nothing but the key and the
entity. Where not every value is allowed (a card number that fails its check digit, a name that is another known name's),
each candidate is checked and the cycle walked on to the next one allowed; on the allowed values this is a cycle too.
Card numbers and IBANs that pass their check get check digits of their own; those that fail it go on failing.

Family names are permuted with vowels for vowels and consonants for consonants, and a person named in full and by family
name alone stays one person. Known given names go to the next one in a keyed order of the names of their script and
gender; others are permuted but for their last letter, past the known ones.

collisions() counts over a whole result which surrogates stand for several originals.

Defined cases: null text stays null and has no entity; empty text likewise empty; the same entity has the same
surrogate in all rows; overlapping finds go to the one that starts first, then to the longer. A letter that has no other of
its script, case and block stays. Ids are whole
numbers; others are an error (a null where ANSI mode is off). Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Courtesy titles and the gender that they tell, n for none.
TITLES = {
    "Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Mx": "n", "Dr": "n", "Prof": "n", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mademoiselle": "f", "Mme": "f", "Mlle": "f",
    "Señor": "m", "Señora": "f", "Señorita": "f", "Sr": "m", "Sra": "f", "Srta": "f", "Dra": "f", "Господин": "m", "Госпожа": "f",
}
NAMES = {
    ("latin", "m"): "James John Robert Michael David Thomas Daniel Paul Mark Peter Lucas Martin Simon Oscar Hugo Felix Leon Victor Adrian Samuel".split(),
    ("latin", "f"): "Mary Anna Laura Emma Julia Sarah Alice Clara Helen Diana Nora Sofia Elena Marta Irene Lucia Paula Olivia Rosa Vera".split(),
    ("cyrillic", "m"): "Иван Пётр Алексей Николай Сергей Андрей Павел Юрий Олег Борис".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Вера Софья Дарья".split(),
}
_GENDER = {n: g for (_, g), names in NAMES.items() for n in names}
_BIG, _SMALL = "A-ZÀ-ÖØ-ÞĀ-ſΆ-ΏΑ-ΩА-ЯЁ", "a-zß-öø-ÿĀ-ſά-ώа-яё"
_WORD = rf"[{_BIG}][{_SMALL}]+(?:-[{_BIG}][{_SMALL}]+)?"
_PATTERNS = (
    ("email", "@", re.compile(r"(?<![\w.+-])[\w.+-]+@[\w-]+(?:\.[\w-]+)+")),
    ("secret", "=:", re.compile(r"(?i:\b(?:api[_-]?key|access[_-]?key|secret[_-]?key|secret|token|password|passwd|pwd)\b[\"']?\s{0,3}[=:]\s{0,3}[\"']?)([A-Za-z0-9+/_\-]{8,}={0,2})")),
    ("secret", "AKIA ghp_ gho_ sk- xox", re.compile(r"\b((?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,})")),
    ("hex_secret", "#", re.compile(r"(?<![0-9A-Za-z])(?=[0-9a-fA-F]*[0-9])(?=[0-9a-fA-F]*[a-fA-F])([0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z])")),
    ("iban", "#", re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b")),
    ("ip", "#", re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)")),
    ("phone", "#", re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?)(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\w)|(?<![\w+])(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?!\w)")),
    ("ssn", "#", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")),
    ("card", "#", re.compile(r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])")),
)
_DIGIT = re.compile(r"\d", re.A)
_NAME = re.compile(rf"\b({'|'.join(TITLES)})(\.?[ ])({_WORD})(?:( )({_WORD}))?")
_GIVEN = re.compile(rf"\b({'|'.join(sorted(_GENDER))}) ({_WORD})\b")
_ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿß", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ")
_OF = {c: a for a in _ALPHABETS for c in a}
#: Letters that stand for each other in names, by script, case and sound.
_SOUNDS = ("aeiouy", "bcdfghjklmnpqrstvwxz", "àáâãäåèéêëìíîïòóôõöøùúûü", "çñß", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ")
_SOUND_OF = {c: a for low in _SOUNDS for a in (low, low.replace("ß", "").upper()) for c in a}
_BLOCK = 128


@lru_cache(maxsize=1 << 16)
def alphabet(c: str) -> str:
    """The characters that may stand for c: one of the alphabets, or all of c's kind in its block of code points; none for marks."""
    if c in _OF:
        return _OF[c]
    kind = unicodedata.category(c)
    if kind[0] not in "LN":
        return ""
    first = ord(c) // _BLOCK * _BLOCK
    return "".join(x for x in map(chr, range(first, first + _BLOCK)) if unicodedata.category(x) == kind and x not in _OF)


def sound(c: str) -> str:
    return _SOUND_OF.get(c) or alphabet(c)


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, type) of the entities, in order and apart."""
    found = []
    digit = _DIGIT.search(text) is not None
    for kind, sign, pattern in _PATTERNS:
        if digit if sign == "#" else any(s in text for s in sign.split()) if " " in sign else any(c in text for c in sign):
            for m in pattern.finditer(text):
                g = 1 if pattern.groups else 0
                if kind == "card" and not 13 <= sum(c.isdigit() for c in m[0]) <= 19:
                    continue
                found.append((m.start(g), m.end(g), "secret" if kind == "hex_secret" else kind))
    if any(t in text for t in TITLES):
        for m in _NAME.finditer(text):
            found.append((m.start(3), m.end(5) if m[5] else m.end(3), f"name_{TITLES[m[1]]}"))
    for m in _GIVEN.finditer(text) if any(f"{n} " in text for n in _GENDER) else ():
        found.append((m.start(), m.end(), f"name_{_GENDER[m[1]]}"))
    out, end = [], 0
    for s, e, kind in sorted(found, key=lambda x: (x[0], -x[1])):
        if s >= end:
            out.append((s, e, kind))
            end = e
    return out


def _number(key: bytes, *parts: str, size: int = 32) -> int:
    return int.from_bytes(hashlib.shake_256(b"%d:%s" % (len(key), key) + "\x1f".join(parts).encode()).digest(size), "big")


def _feistel(key: bytes, shape: str, x: list[int], sizes: list[int], back: bool = False) -> list[int]:
    """A permutation of all lists x of numbers below sizes, or its inverse."""
    x, half = list(x), len(x) // 2
    parts = range(half), range(half, len(x))
    for r in reversed(range(8)) if back else range(8):
        fixed, moved = parts[r % 2], parts[1 - r % 2]
        bits = sum(sizes[k].bit_length() for k in moved)
        n = _number(key, shape, str(r), ",".join(str(x[k]) for k in fixed), size=bits // 8 + 16)
        for k in moved:
            n, d = divmod(n, sizes[k])
            x[k] = (x[k] - d if back else x[k] + d) % sizes[k]
    return x


def step(key: bytes, shape: str, x: list[int], sizes: list[int]) -> list[int]:
    """The next on a cycle through all lists x of numbers below sizes."""
    x = _feistel(key, shape, x, sizes)
    for k, size in enumerate(sizes):  # plus one, with carry
        x[k] = (x[k] + 1) % size
        if x[k]:
            break
    return _feistel(key, shape, x, sizes, back=True)


def permute(key: bytes, kind: str, value: str, of: Callable[[str], str] = alphabet, allowed: Callable[[str], bool] | None = None) -> str:
    """The next allowed value on the cycle of all values of value's format: each character stays in its alphabet, others stay as they are."""
    at = [k for k, c in enumerate(value) if of(c)]
    sets = [of(value[k]) for k in at]
    shape = kind + "\x1f" + "".join((of(c) or c)[0] for c in value)
    x, sizes = [s.index(value[k]) for s, k in zip(sets, at, strict=True)], [len(s) for s in sets]
    out = list(value)
    while True:
        x = step(key, shape, x, sizes)
        for s, k, v in zip(sets, at, x, strict=True):
            out[k] = s[v]
        made = "".join(out)
        if made == value or allowed is None or allowed(made):
            return made


def _luhn(digits: str) -> bool:
    return sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(reversed(digits))) % 10 == 0


def _digits(value: str) -> str:
    return "".join(c for c in value if c in _ALPHABETS[0])


def _card(key: bytes, value: str) -> str:
    """A card number whose check digit is right if the original's is, and wrong if that is."""
    if not _luhn(_digits(value)):
        return permute(key, "card", value, allowed=lambda v: not _luhn(_digits(v)))
    head = permute(key, "card", value[:-1])  # a card number ends with a digit
    return head + next(d for d in _ALPHABETS[0] if _luhn(_digits(head) + d))


def _remainder(iban: str) -> int:
    plain = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97


def _iban(key: bytes, value: str) -> str:
    """An IBAN of the same country; its check digits are right if the original's are, and wrong if those are."""
    country, rest = value[:2], value[2:]
    if _remainder(value) != 1:
        return country + permute(key, f"iban{country}", rest, allowed=lambda v: _remainder(country + v) != 1)
    account = permute(key, f"iban{country}", rest[2:])
    return f"{country}{98 - _remainder(f'{country}00{account}'):02d}{account}"


def _ip(key: bytes, value: str) -> str:
    """An address whose parts have as many digits each."""
    first = [(0, 10, 100)[len(p) - 1] for p in value.split(".")]
    sizes = [(10, 90, 156)[len(p) - 1] for p in value.split(".")]
    x = step(key, "ip\x1f" + ",".join(map(str, sizes)), [int(p) - f for p, f in zip(value.split("."), first, strict=True)], sizes)
    return ".".join(str(n + f) for n, f in zip(x, first, strict=True))


def _email(key: bytes, value: str) -> str:
    """An address; the top level, and names reserved for examples, are no one's and stay."""
    local, _, domain = value.rpartition("@")
    host, dot, top = domain.rpartition(".")
    host = host if host.lower().split(".")[-1] == "example" else permute(key, "domain", host)
    return f"{permute(key, 'email', local)}@{host}{dot}{top}"


def _secret(key: bytes, value: str) -> str:
    known = re.match(r"AKIA|ASIA|gh[pousr]_|sk-|xox[abprs]-", value)
    head = known[0] if known else ""
    hexes = next((a for a in ("0123456789abcdef", "0123456789ABCDEF") if not head and set(value) <= set(a)), "")
    return head + permute(key, "secret", value[len(head) :], (lambda c: hexes) if hexes else alphabet)


def _given(key: bytes, word: str) -> str:
    """A given name: a known one's gender is its own, another keeps its last letter."""
    listed = next(((kind, names) for kind, names in NAMES.items() if word in names), None)
    if listed:
        order = sorted(listed[1], key=lambda n: _number(key, "given", *listed[0], n))
        return order[(order.index(word) + 1) % len(order)]
    return permute(key, f"given\x1f{word[-1]}", word[:-1], sound, lambda v: v + word[-1] not in _GENDER) + word[-1]


@lru_cache(maxsize=1 << 16)
def surrogate(key: bytes, kind: str, value: str) -> str:
    """The surrogate of one entity: of the key, the type and the value alone."""
    if kind.startswith("name"):
        first, _, last = value.rpartition(" ")
        family = permute(key, "family", last, sound)
        return f"{_given(key, first)} {family}" if first else family
    own = {"email": _email, "secret": _secret, "iban": _iban, "card": _card, "ip": _ip}.get(kind)
    if own:
        return own(key, value)
    # a telephone number's country code stays
    n = len(re.match(r"(?:\+\d{1,3}[ .-])?", value)[0])
    return value[:n] + permute(key, f"{kind}{value[:n]}", value[n:])


def replace(text: str, key: bytes) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with surrogates, and (start, end, type) of the originals."""
    spans = find(text)
    parts, at = [], 0
    for s, e, kind in spans:
        parts += [text[at:s], surrogate(key, kind, text[s:e])]
        at = e
    return "".join([*parts, text[at:]]) if spans else text, spans


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("type", pa.string()), ("surrogate", pa.string()), ("original_hash", pa.int64())]))


def redact(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (with surrogates), n_entities and entities for each row of docs.

    entities: start, end (in the original), type, surrogate, and a keyed hash of the original, which tells entities apart
    without telling what they are. key: secret bytes; whoever has them can undo the surrogates.
    """
    if not key:
        raise ValueError("a key is needed")

    def entity(text: str, s: int, e: int, kind: str) -> dict:
        return {"start": s, "end": e, "type": kind, "surrogate": surrogate(key, kind, text[s:e]), "original_hash": _number(key, "original", text[s:e], size=8) >> 1}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            made = [None if t is None else replace(t, key) for t in texts]
            spans = [[] if m is None else [entity(t, *x) for x in m[1]] for t, m in zip(texts, made, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([m and m[0] for m in made], pa.string()), pa.array([len(s) for s in spans], pa.int64()), pa.array(spans, _SPANS)], names=["doc_id", "text", "n_entities", "entities"]
            )

    schema = "doc_id long, text string, n_entities long, entities array<struct<start:int,end:int,type:string,surrogate:string,original_hash:long>>"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def collisions(redacted: DataFrame) -> DataFrame:
    """type, surrogate, n_originals: the surrogates in a result of redact() that stand for several originals; there should be none."""
    e = redacted.select(F.explode("entities").alias("e")).select(F.regexp_replace("e.type", "^name_.$", "name").alias("type"), "e.surrogate", "e.original_hash")
    found = e.groupBy("type", "surrogate").agg(F.min("original_hash").alias("lo"), F.max("original_hash").alias("hi"), F.count_distinct("original_hash").alias("n_originals"))
    return found.filter("lo <> hi").select("type", "surrogate", "n_originals")
