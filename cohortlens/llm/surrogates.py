"""Personal data: detection and keyed surrogates of the same type and format.

Emails, phone numbers, IP addresses (4 and 6), card numbers, social security
numbers, account numbers (IBAN), secrets (access keys, passwords, tokens) and
names of persons are found in the whole text and replaced. A surrogate keeps the format:
digits stay digits, letters stay letters of their case and script, separators
stay; names keep their gender (given names move within a list of one gender and
script) and vowels stay vowels; card numbers keep first digit and check digit.

A surrogate is a keyed permutation of the values of one format, followed by one
step of a cycle through all of them. That has three consequences without any
table that would have to be kept or sent around:

* coreference: the same value has the same surrogate in every document, also when
  it is written in another case or with other separators (phones, cards, emails);
  names that a document introduces ("Anna Schmidt") are also replaced where they
  stand alone in it ("Later Schmidt left");
* distinctness: different values have different surrogates, formats included;
* nothing is its own surrogate, if the format has more than one value.

``surrogate_table`` gives the distinct values of a corpus and ``collisions``
checks it as a Spark job; ``replace`` runs that check before it replaces.

Not detected, and left in the text: undivided national phone numbers but French
ones; passwords under six characters or without a key word and "=" or ":" before
them; full names without a title whose given name is not in ``GIVEN``;
addresses, dates of birth, and identity and tax numbers other than SSN and IBAN.

Defined results: NULL and empty texts stay as they are, with no entities. All
other columns are carried along, ``n_chars`` follows the text. Repeated rows are
treated alike. Values of one possible form only (a one-digit domain of one) stay.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import sys
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import fresh, staged
from cohortlens.llm.tokens import text_buffer

# the functions below travel with the task, so executors need not have the package
register_pickle_by_value(sys.modules[__name__])

DEFAULT_KEY = "replace this key"
_ROUNDS = 6

# Common given names by gender and script, in alphabetical order.
GIVEN = {
    ("female", "latin"): "Alice Amélie Anna Barbara Camille Carmen Caroline Charlotte Clara Claire Cristina Elena Elisabeth Emily Emma Eva Hannah Isabel Jennifer Jessica Julia Karin Katharina Laura Lea Lucía Manon María Marie Martina Mary Monika Nathalie Olivia Patricia Pilar Rosa Sabine Sarah Sophie Susan Ursula",
    ("male", "latin"): "Alejandro Andreas Antoine Antonio Carlos Charles Christian Daniel David Diego Francisco François Georg Hans Henri Jacques James Javier John José Juan Julien Jürgen Klaus Louis Lucas Manuel Markus Martin Michael Miguel Nicolas Pablo Paul Peter Philippe Pierre Richard Robert Stefan Thomas William Wolfgang",
    ("female", "cyrillic"): "Анастасия Анна Валентина Вера Галина Дарья Екатерина Елена Ирина Ксения Людмила Мария Надежда Наталья Оксана Ольга Светлана Татьяна Юлия",
    ("male", "cyrillic"): "Александр Алексей Андрей Борис Виктор Владимир Дмитрий Иван Игорь Константин Максим Михаил Николай Олег Павел Роман Сергей Фёдор Юрий",
    ("female", "greek"): "Αικατερίνη Άννα Ελένη Ευαγγελία Ιωάννα Κωνσταντίνα Μαρία Σοφία",
    ("male", "greek"): "Αλέξανδρος Ανδρέας Βασίλης Γιώργος Δημήτρης Ιωάννης Κώστας Νίκος",
}
_PLACE_OF = {n: (g, s, i) for (g, s), names in GIVEN.items() for i, n in enumerate(names.split())}
# Forms of address before a name.
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Monsieur Madame Mme Mlle Señor Señora Sr Sra Don Doña".split()

_LOWER_VOWELS = "aeiou"
_CLASSES = {
    "text": ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ"),
    "email": ("0123456789", "abcdefghijklmnopqrstuvwxyz"),
    "digits": ("0123456789",),
    "phone": ("01", "23456789"),
    "name": (
        _LOWER_VOWELS, "bcdfghjklmnpqrstvwxyz", "áéíóúàèâêîôû", "äöü", "ñç",
        "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ", "άέήίόύώ",
    ),
}
_CLASS_OF = {kind: {c: group for group in groups for c in group} for kind, groups in _CLASSES.items()}


def _number(key: str, *parts: object) -> int:
    data = "\x1f".join(map(str, parts)).encode()
    return int.from_bytes(hashlib.blake2b(data, key=key.encode()[:64], digest_size=16).digest(), "big")


class Permutation:
    """A keyed permutation of 0 .. n-1: a Feistel network on a rectangle, walked until inside."""

    def __init__(self, key: str, tweak: str, n: int) -> None:
        self.key, self.tweak, self.n = key, tweak, n
        self.a = isqrt(n - 1) + 1 if n > 1 else 1
        self.b = -(-n // self.a)

    def _f(self, r: int, x: int) -> int:
        size = self.n.bit_length() // 96 + 1  # long formats need more bits
        return sum(_number(self.key, self.tweak, r, x, j) << (128 * j) for j in range(size))

    def _once(self, x: int, back: bool) -> int:
        left, right = divmod(x, self.b)
        for r in range(_ROUNDS - 1, -1, -1) if back else range(_ROUNDS):
            sign = -1 if back else 1
            if r % 2:
                right = (right + sign * self._f(r, left)) % self.b
            else:
                left = (left + sign * self._f(r, right)) % self.a
        return left * self.b + right

    def walk(self, x: int, back: bool = False) -> int:
        x = self._once(x, back)
        while x >= self.n:
            x = self._once(x, back)
        return x

    def follow(self, x: int) -> int:
        """The next value on a keyed cycle through all values; never x itself if n > 1."""
        return self.walk((self.walk(x) + 1) % self.n, back=True)


def _moved(key: str, kind: str, text: str, groups: list[str]) -> str:
    """``text`` replaced within the alphabets of its positions ("" keeps a character)."""
    n, x = 1, 0
    for c, g in zip(text, groups):
        if g:
            n, x = n * len(g), x * len(g) + g.index(c)
    if n < 2:
        return text
    shape = "".join(c if not g else f"<{g[0]}>" for c, g in zip(text, groups))
    y = Permutation(key, f"{kind}/{shape}", n).follow(x)
    out = []
    for c, g in zip(reversed(text), reversed(groups)):
        if g:
            y, i = divmod(y, len(g))
            out.append(g[i])
        else:
            out.append(c)
    return "".join(reversed(out))


def _by_class(key: str, kind: str, classes: str, text: str) -> str:
    return _moved(key, kind, text, [_CLASS_OF[classes].get(c, "") for c in text])


def _luhn(digits: str) -> int:
    """The check digit that goes after ``digits``."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _refill(pattern: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in pattern)


def _email(key: str, value: str) -> str:
    local, _, domain = value.lower().rpartition("@")
    name, dot, top = domain.rpartition(".")
    new_name = _by_class(key, "domain", "email", name)
    # the domain is a tweak of the local part: equal local parts of two domains become different ones
    new_local = _by_class(key, f"email@{domain}", "email", local)
    new = f"{new_local}@{new_name}{dot}{top}"
    return "".join(n.upper() if o.isupper() else n for o, n in zip(value, new))


#: Country codes have one, two or three digits; how they are set apart in the text does not matter
_CALLING_CODE = re.compile(r"\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})")


def _phone(key: str, value: str) -> str:
    m = _CALLING_CODE.match(value)
    head, tail = (value[: m.end()], value[m.end() :]) if m else ("", value)
    digits = "".join(c for c in tail if c.isdigit())
    groups = ["0123456789"] * len(digits)
    if digits[0] == "0":  # a trunk prefix stays
        groups[0], groups[1] = "", "" if digits[1] == "0" else "123456789"
    elif len(digits) == 10:
        groups[0], groups[3] = (_CLASS_OF["phone"][digits[i]] for i in (0, 3))
        groups[0] = "" if digits[0] == "1" else groups[0]
    else:
        groups[0] = "6789" if digits[0] in "6789" else "12345"
    return head + _refill(tail, _moved(key, "phone", digits, groups))


def _card(key: str, value: str) -> str:
    digits = "".join(c for c in value if c.isdigit())
    body, off = digits[:-1], (int(digits[-1]) - _luhn(digits[:-1])) % 10
    new = _moved(key, f"card+{off}", body, ["", *["0123456789"] * (len(body) - 1)])
    return _refill(value, new + str((_luhn(new) + off) % 10))


def _ip(key: str, value: str) -> str:
    x = 0
    for part in value.split("."):
        x = x * 256 + int(part)
    y = Permutation(key, "ip", 1 << 32).follow(x)
    return ".".join(str(y >> s & 255) for s in (24, 16, 8, 0))


def _ipv6(key: str, value: str) -> str:
    new = str(ipaddress.IPv6Address(Permutation(key, "ipv6", 1 << 128).follow(int(ipaddress.IPv6Address(value)))))
    return new.upper() if value.upper() == value else new


def _given_name(key: str, value: str) -> str:
    found = _PLACE_OF.get(value)
    if found:
        names = GIVEN[found[:2]].split()
        return names[Permutation(key, "given/" + "/".join(found[:2]), len(names)).follow(found[2])]
    out = _word_name(key, value)
    while out in _PLACE_OF:
        out = _word_name(key, out)
    return out


def _word_name(key: str, value: str) -> str:
    """A pronounceable word of the same pattern: vowels become vowels, consonants consonants."""
    new = _by_class(key, "name", "name", value.lower())
    return "".join(n.upper() if o.isupper() else n for o, n in zip(value, new)) if len(new) == len(value) else new


def surrogate(kind: str, value: str, key: str = DEFAULT_KEY) -> str:
    """The replacement of one detected value."""
    if kind == "email":
        return _email(key, value)
    if kind == "phone":
        return _phone(key, value)
    if kind == "card":
        return _card(key, value)
    if kind == "ip":
        return _ip(key, value)
    if kind == "ipv6":
        return _ipv6(key, value)
    if kind == "given":
        return _given_name(key, value)
    if kind == "surname":
        return _word_name(key, value)
    if kind == "ssn":
        return _refill(value, _by_class(key, kind, "digits", "".join(c for c in value if c.isdigit())))
    return _by_class(key, kind, "text", value)


def canonical(kind: str, value: str) -> str:
    """What makes two spellings the same value."""
    if kind == "email":
        return value.lower()
    if kind in ("phone", "card", "ssn"):
        return "".join(c for c in value if c.isdigit() or c == "+")
    if kind == "ip":
        return ".".join(str(int(x)) for x in value.split("."))
    if kind == "ipv6":
        return ipaddress.IPv6Address(value).exploded
    if kind == "surname":
        return value.lower()
    return value


#: Keys of secrets, also inside longer keys (db_password, AWS_SECRET_ACCESS_KEY) and quoted ones of JSON
_SECRET_KEY = (
    r"(?i:(?:api[_\-]?key|access[_\-]?key|private[_\-]?key|secret|token|password|passwd|passphrase|pwd)"
    r"(?:[_\-]?(?:access|key|id|token|value|hash))*[\"']?\s*[=:]\s*)"
)
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
#: Kinds with digits, @, : or =, in the order in which they claim text; group "v" is what is replaced.
_MARKED = re.compile(
    "|".join(
        (
            r"(?P<email>[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,})",
            r"(?<![A-Za-z0-9])(?:AKIA|ASIA)(?P<access>[A-Z0-9]{16})(?![A-Za-z0-9])",
            rf"{_SECRET_KEY}(?:\"(?P<secret_1>[^\"\n]{{6,}})\"|'(?P<secret_2>[^'\n]{{6,}})'"
            r"|[\"']?(?P<secret>[^\s\"']{5,}[^\s\"'.,;:!?)\]}>]=*))",
            r"(?<![A-Za-z0-9])(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
            rf"(?<![\d.])(?P<ip>{_OCTET}(?:\.{_OCTET}){{3}})(?![\d]|\.\d)",
            r"(?<![\w:.])(?P<ipv6>(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4})(?![\w:]|\.\d)",
            r"(?<![\d\-])(?P<ssn>\d{3}-\d{2}-\d{4})(?![\d\-])",
            r"(?<![\d+])(?P<card>\d{4}(?:[ \-]\d{4}){3}|\d{4}[ \-]\d{6}[ \-]\d{5}|\d{13,19})(?!\d)",
            r"(?<![\w+])(?P<phone>(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)[ .\-]?|\d{3}[ .\-])\d{3}[ .\-]?\d{4}"
            # international, undivided or in groups
            r"|\+\d{1,4}(?:[ .\-/]?\(?\d{1,12}\)?(?!\d)){1,7}|\+\d{7,15}"
            # French; German and British with trunk prefix; Spanish
            r"|0[1-9](?:[ .\-]?\d{2}){4}|\(?0\d{2,5}\)?[ \-/]\d{3,8}(?:[ \-]\d{2,5}){0,2}"
            r"|[6789]\d{2}(?:[ .\-]\d{2}){3}|[6789]\d{2}(?:[ .\-]\d{3}){2}|[6-9]\d[ .\-]\d{3}[ .\-]\d{2}[ .\-]\d{2})(?!\d)",
        )
    )
)


def _holds(kind: str, value: str) -> bool:
    """Whether a value is what its pattern takes it for."""
    if kind == "phone":
        return (8 if value[0] == "+" else 9) <= sum(c.isdigit() for c in value) <= 15
    if kind == "ipv6":
        groups = [g for g in value.split(":") if g]
        # "a::b" is more often code than an address
        if len(groups) < 3 and not any(len(g) > 2 and re.search(r"\d", g) for g in groups):
            return False
        try:
            ipaddress.IPv6Address(value)
        except ValueError:
            return False
    return True


_CAPITAL = r"[A-ZÀ-ÖØ-ÞΑ-ΩА-ЯЁ][^\W\d_]+(?:[-'’][^\W\d_]+)?"
_BARE = re.compile(rf"(?<!\w){_CAPITAL}(?!\w)")
_NAMED = re.compile(
    rf"\b(?P<title>{'|'.join(TITLES)})\b\.? +(?P<first>{_CAPITAL})(?: +(?P<second>{_CAPITAL}))?"
    rf"|\b(?P<given>{'|'.join(n for names in GIVEN.values() for n in names.split())}) +(?P<surname>{_CAPITAL})"
)


def _parts(a: int, b: int, text: str) -> list[tuple[int, int]]:
    """A capitalised word, and if it is joined by hyphen or apostrophe, its pieces."""
    cuts = [i for i in range(a, b) if text[i] in "-'’"]
    return [(a, b), *zip([a, *(i + 1 for i in cuts)], [*cuts, b])] if cuts else [(a, b)]


def entities(text: str, marked: bool = True) -> list[tuple[int, int, str]]:
    """Start, end and kind of all entities, left to right, not overlapping; ``marked``: the text has a digit, @, : or =."""
    found = []
    if marked:
        for m in _MARKED.finditer(text):
            kind = m.lastgroup.partition("_")[0]
            if _holds(kind, m[m.lastgroup]):
                found.append((*m.span(m.lastgroup), kind))
    named: dict[str, str] = {}

    def name(m: re.Match, group: str, kind: str) -> None:
        a, b = m.span(group)
        if text[b - 2 : b] in ("'s", "’s"):
            b -= 2
        found.append((a, b, kind))
        named.setdefault(text[a:b], kind)

    for m in _NAMED.finditer(text):
        if m["given"]:
            name(m, "given", "given")
            name(m, "surname", "surname")
        elif m["second"]:
            name(m, "first", "given")
            name(m, "second", "surname")
        else:
            name(m, "first", "given" if m["first"] in _PLACE_OF else "surname")
    if named:
        # the other mentions of these names; a word is looked up, so many names cost no more
        at = {(a, b) for a, b, _ in found}
        for m in _BARE.finditer(text):
            for a, b in _parts(*m.span(), text):
                if text[a:b] in named and (a, b) not in at:
                    found.append((a, b, named[text[a:b]]))
    out: list[tuple[int, int, str]] = []
    for x in sorted(found):
        if x[0] < x[1] and (not out or x[0] >= out[-1][1]):
            out.append(x)
    return out


def replaced(text: str, found: list[tuple[int, int, str]], key: str) -> str:
    out, at = [], 0
    for a, b, kind in found:
        out += [text[at:a], surrogate(kind, text[a:b], key)]
        at = b
    return "".join([*out, text[at:]])


_MARKS = np.zeros(256, dtype=bool)
_MARKS[[*range(48, 59), 61, 64]] = True


def _found(column: pa.Array) -> Iterator[tuple[int, str, list[tuple[int, int, str]]]]:
    """Row, text and entities of the rows that have any."""
    data, off = text_buffer(column)
    total = np.concatenate([[0], np.cumsum(_MARKS[data], dtype=np.int64)])
    marked = total[off[1:]] > total[off[:-1]]
    for i in range(len(column)):
        text = column[i].as_py()
        if text:
            got = entities(text, bool(marked[i]))
            if got:
                yield i, text, got


def surrogate_table(documents: DataFrame, key: str = DEFAULT_KEY) -> DataFrame:
    """The distinct values of the corpus: kind, value (canonical) and surrogate (canonical)."""
    schema = pa.schema([("kind", pa.string()), ("value", pa.string()), ("surrogate", pa.string())])

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in incoming:
            rows = set()
            for _, text, got in _found(batch.column(0)):
                for a, b, kind in got:
                    rows.add((kind, canonical(kind, text[a:b]), canonical(kind, surrogate(kind, text[a:b], key))))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in sorted(rows)], schema=schema)

    return documents.select("text").mapInArrow(run, "kind string, value string, surrogate string").distinct()


def collisions(table: DataFrame) -> DataFrame:
    """Surrogates that stand for several values, and values with several surrogates; there should be none."""
    twice = table.groupBy("kind", "surrogate").agg(F.min("value").alias("a"), F.max("value").alias("b")).where("a <> b")
    split = table.groupBy("kind", "value").agg(F.min("surrogate").alias("a"), F.max("surrogate").alias("b")).where("a <> b")
    return twice.select("kind", F.lit("shared").alias("what"), "a", "b").unionByName(
        split.select("kind", F.lit("split").alias("what"), "a", "b")
    )


def replace(documents: DataFrame, key: str = DEFAULT_KEY, counts: tuple[str, str] | None = None) -> DataFrame:
    """``documents`` with surrogates in ``text``; ``counts`` names two more columns, the number of entities and
    their kinds ("card:1,email:2")."""
    # both tests read the table: without staging each would scan the texts
    bad = collisions(staged(surrogate_table(documents, key), "surrogates")).limit(5).collect()
    if bad:
        raise ValueError(f"surrogates are not distinct: {bad}")
    names = documents.columns
    (size,) = fresh(documents, "n_chars") if "n_chars" not in names else ("n_chars",)
    extra = list(counts) if counts else []
    schema = documents.select("*", *(F.lit(0).cast(t).alias(c) for c, t in zip(extra, ("long", "string")))).schema

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in incoming:
            text = batch.column("text")
            new = {i: (replaced(t, got, key), got) for i, t, got in _found(text)}
            columns = []
            for f in batch.schema:
                column = batch.column(f.name)
                if new and f.name in ("text", size):
                    values = column.to_pylist()
                    for i, (t, _) in new.items():
                        values[i] = t if f.name == "text" else len(t)
                    column = pa.array(values, type=f.type)
                columns.append(column)
            if extra:
                kinds = [sorted(k for _, _, k in new[i][1]) if i in new else [] for i in range(batch.num_rows)]
                columns.append(pa.array([len(k) for k in kinds], pa.int64()))
                columns.append(pa.array([",".join(f"{x}:{k.count(x)}" for x in dict.fromkeys(k)) for k in kinds], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *extra])

    return documents.mapInArrow(run, schema)


def report(documents: DataFrame, key: str = DEFAULT_KEY) -> DataFrame:
    """One row per document: doc_id, the text with surrogates, n_entities and kinds."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return replace(docs, key, ("n_entities", "kinds"))
