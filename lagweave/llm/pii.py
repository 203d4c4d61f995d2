"""Keyed, type-consistent surrogates for personal data and secrets.

Entities are found by patterns and replaced by a keyed permutation of the same
kind of string: letters stay letters of their case, digits digits, separators
and fixed prefixes stay where they are. A permutation maps distinct entities to
distinct surrogates and equal ones to equal ones without any table, on every
executor alike, and leaves none as it is: it is the step of a keyed cycle through
all strings of the kind. What an entity is called is normalised first (case of
mail addresses, separators of numbers), so its spellings corefer. Check digits
of cards and IBANs are right where they were right.

Names are found by a title, a known first name or words such as "my name is" in
front; then every word of such a name is one wherever it stands alone in the
same text. Words are replaced one by one, so parts of a name corefer with it.
They keep gender and script: a known first name goes to another of its list,
other name letters to vowels or consonants of their script. Names that none of
this marks are not found.

check() tests the mapping over a whole corpus: no surrogate is shared by two
entities, and no entity has two.

Null texts stay null, with no entities; empty texts stay empty. Overlapping
matches go to the earliest, then the first kind in the list. Repeated rows are
treated alike. Other columns pass through replace() unchanged, whatever their
names: the column of entities gets underscores in front until its name is free.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Callable, Iterator
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagweave.llm.common import free_name, lent

# Titles and first names by gender and script.
TITLES = {"m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "г-н"], "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "г-жа"]}
FIRST = {
    ("m", "latin"): ["James", "John", "Robert", "Michael", "William", "David", "Richard", "Thomas", "Charles", "Daniel", "Paul", "Mark", "Hans", "Peter", "Klaus", "Jürgen", "Pierre", "Jean", "Luc", "José", "Carlos", "Miguel", "Pedro", "Juan"],
    ("f", "latin"): ["Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Barbara", "Susan", "Jessica", "Sarah", "Karen", "Anna", "Emma", "Ursula", "Monika", "Petra", "Sabine", "Marie", "Claire", "Sophie", "María", "Carmen", "Lucía", "Isabel", "Elena"],
    ("m", "cyrillic"): ["Иван", "Пётр", "Сергей", "Алексей", "Дмитрий", "Николай", "Михаил", "Андрей"],
    ("f", "cyrillic"): ["Анна", "Мария", "Елена", "Ольга", "Наталья", "Татьяна", "Ирина", "Светлана"],
}
CUES = ["my name is ", "name: ", "ich heiße ", "mein Name ist ", "je m'appelle ", "me llamo ", "mi nombre es ", "меня зовут "]
CLASSES = ["0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "аеиоуыэюяё", "бвгджзклмнпрстфхцчшщ", "АЕИОУЭЮЯ", "БВГДЖЗКЛМНПРСТФХЦЧШЩ", "áéíóúàèìòùâêîôûäëïöü", "ÁÉÍÓÚÀÈÌÒÙÂÊÎÔÛÄËÏÖÜ"]
LETTERS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
HEX = ["0123456789abcdef", "ABCDEF"]

_upper, _lower = "A-ZÀ-ÖØ-ÞА-ЯЁ", "a-zß-öø-ÿа-яё"
_word = rf"[{_upper}][{_lower}]+"
_titles = "|".join(t for group in TITLES.values() for t in group)
_octet = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "key": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "password": r"(?i:(?<=password=)|(?<=password: )|(?<=passwd=)|(?<=pwd=))[^\s\"',;]+",
    "token": r"(?<![0-9A-Za-z])(?=[0-9a-f]*\d)[0-9a-f]{32,64}(?![0-9A-Za-z])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![\d.-])[3-6]\d{3}([ -]?)\d{4}\1\d{4}\1\d{3,4}(?![\d-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\w+(])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]\d{4}(?!\d)",
    "ip": rf"(?<![\d.]){_octet}(?:\.{_octet}){{3}}(?!\d|\.\d)",
    "cued": rf"(?=[{_upper}])(?i:{'|'.join(f'(?<={c})' for c in CUES)}){_word}(?:[ -]{_word})*",
    "name": rf"(?<!\w)(?:(?:{_titles})\.? {_word}(?:[ -]{_word})*|{_word}(?: {_word}(?:-{_word})*)+)",
}
_find = re.compile("|".join(f"(?P<{k}>{v.replace(chr(92) + '1', '(?P=sep)').replace('([ -]?)', '(?P<sep>[ -]?)')})" for k, v in PATTERNS.items()))
_capitals = re.compile(rf"{_word} {_word}|(?<!\w)(?:{_titles})\.? [{_upper}]")
_marked = re.compile(r"[@\d]")
_marks = [x.casefold() for x in ("password", "passwd", "pwd", "AKIA", *CUES)]


def _possible(text: str) -> bool:
    """Whether a text may hold an entity: a quick test that lets every pattern through, by plain search where that will do."""
    low = text.casefold()
    return bool(_marked.search(text) or any(x in low for x in _marks) or _capitals.search(text))


_hint = SimpleNamespace(search=_possible)
_first = {name: k for k, names in FIRST.items() for name in names}
_gender = {t: g for g, titles in TITLES.items() for t in titles}


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def iban(text: str) -> bool:
    """Whether the check digits of an IBAN without spaces are right."""
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


class Surrogates:
    """A keyed permutation for each kind of entity."""

    def __init__(self, key: bytes):
        self.key = key

    def _prf(self, *parts: object) -> int:
        return int.from_bytes(hashlib.blake2b("\x1f".join(map(str, parts)).encode(), key=self.key[:64], digest_size=16).digest(), "big")

    def permute(self, kind: str, values: list[int], sizes: list[int], rounds: int = 8) -> list[int]:
        """The next list on a keyed cycle through all lists with these sizes, so never the list itself if there are two. A number is enciphered by an alternating Feistel network over mixed radices, raised by one, and deciphered; of a single place the values are put in a keyed order."""
        if len(values) == 1:
            order = sorted(range(sizes[0]), key=lambda v: self._prf(kind, sizes[0], v))
            return [order[(order.index(values[0]) + 1) % sizes[0]]]
        half = (len(values) + 1) // 2
        parts = [self._join(values[:half], sizes[:half]), self._join(values[half:], sizes[half:])]
        wide = [self._width(sizes[:half]), self._width(sizes[half:])]
        domain = "-".join(map(str, sizes))
        for r in range(rounds):
            a, b = r % 2, 1 - r % 2
            parts[a] = (parts[a] + self._prf(kind, domain, r, parts[b])) % wide[a]
        parts = list(divmod((parts[0] * wide[1] + parts[1] + 1) % (wide[0] * wide[1]), wide[1]))
        for r in reversed(range(rounds)):
            a, b = r % 2, 1 - r % 2
            parts[a] = (parts[a] - self._prf(kind, domain, r, parts[b])) % wide[a]
        return self._split(parts[0], sizes[:half]) + self._split(parts[1], sizes[half:])

    @staticmethod
    def _width(sizes: list[int]) -> int:
        n = 1
        for s in sizes:
            n *= s
        return n

    @staticmethod
    def _join(values: list[int], sizes: list[int]) -> int:
        n = 0
        for v, s in zip(values, sizes, strict=True):
            n = n * s + v
        return n

    @staticmethod
    def _split(n: int, sizes: list[int]) -> list[int]:
        out = []
        for s in reversed(sizes):
            n, v = divmod(n, s)
            out.append(v)
        return out[::-1]

    def spell(self, kind: str, text: str, classes: list[str], keep: int = 0, valid: Callable[[str], bool] | None = None) -> str:
        """`text` with each character after the first `keep` exchanged within its class; walks on along the cycle until `valid`, which keeps distinct valid texts distinct."""
        table = {ch: (k, i) for k, c in reversed(list(enumerate(classes))) for i, ch in enumerate(c)}
        at = [i for i, ch in enumerate(text) if i >= keep and ch in table]
        if not at:
            return text
        chars, frame = list(text), "".join("?" if i in set(at) else ch for i, ch in enumerate(text))
        sizes = [len(classes[table[text[i]][0]]) for i in at]
        values = [table[text[i]][1] for i in at]
        out = ""
        while out != text:  # back at the text only if no other one is valid
            values = self.permute(f"{kind}|{frame}", values, sizes)
            for i, v in zip(at, values, strict=True):
                chars[i] = classes[table[text[i]][0]][v]
            out = "".join(chars)
            if valid is None or valid(out):
                return out
        return text

    def digits(self, kind: str, text: str, keep: int = 0, valid: Callable[[str], bool] | None = None) -> str:
        """Exchange the digits and leave what stands between them."""
        plain = "".join(ch for ch in text if ch.isdigit())
        new = iter(self.spell(kind, plain, ["0123456789"], keep, valid))
        return "".join(next(new) if ch.isdigit() else ch for ch in text)

    def replace(self, kind: str, text: str) -> str:
        return getattr(self, f"_{kind}", lambda t: self.spell(kind, t, LETTERS))(text)

    def _email(self, text: str) -> str:
        head, dot, top = text.lower().rpartition(".")
        new = self.spell("email", head, LETTERS) + dot + top
        return "".join(b.upper() if a.isupper() else b for a, b in zip(text, new, strict=True))

    def _key(self, text: str) -> str:
        return text[:4] + self.spell("key", text[4:], ["0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"])

    def _token(self, text: str) -> str:
        return self.spell("token", text, HEX)

    def _iban(self, text: str) -> str:
        plain = text.replace(" ", "")
        country, kind = plain[:2], "iban" + plain[:2]
        if iban(plain):  # distinct in what follows the check digits, which depend on it
            body = self.spell(kind, plain[4:], LETTERS)
            new = next(x for k in range(2, 99) if iban(x := f"{country}{k:02d}{body}"))
        else:
            new = country + self.spell(kind, plain[2:], LETTERS, valid=lambda x: not iban(country + x))
        new = iter(new)
        return "".join(ch if ch == " " else next(new) for ch in text)

    def _card(self, text: str) -> str:
        right = luhn("".join(c for c in text if c.isdigit()))
        return self.digits("card", text, 1, lambda d: luhn(d) == right)

    def _phone(self, text: str) -> str:
        extra = max(0, sum(c.isdigit() for c in text) - 10)
        at = [i for i, c in enumerate(text) if c.isdigit()][extra]
        start = at
        while start and text[start - 1] in "(":
            start -= 1
        return text[:start] + self.digits("phone", text[start:])

    def _ssn(self, text: str) -> str:
        return self.digits("ssn", text)

    def _ip(self, text: str) -> str:
        kind = lambda o: "local" if o[0] in (0, 10, 127) or o[0] >= 224 or o[:2] == [192, 168] or (o[0] == 172 and 16 <= o[1] < 32) else "public"
        octets = [int(x) for x in text.split(".")]
        was, start = kind(octets), octets[:]
        if was == "local":  # the network stays what it was, hosts are exchanged
            return ".".join(map(str, octets[:2] + self.permute(f"ip{octets[:2]}", octets[2:], [256, 256])))
        for _ in range(1000):
            octets = self.permute("ip", octets, [256] * 4)
            if kind(octets) == was:
                return ".".join(map(str, octets))
        return ".".join(map(str, start))

    def _name(self, text: str) -> str:
        title = re.match(rf"(?:{_titles})\.? ", text)
        head, rest = (title[0], text[title.end() :]) if title else ("", text)
        return head + "".join(w if w in ("", " ", "-") else self._name_word(w) for w in re.split(r"([ -])", rest))

    def _name_word(self, word: str) -> str:
        if word in _first:
            group = FIRST[_first[word]]
            return group[self.permute("first" + "".join(_first[word]), [group.index(word)], [len(group)])[0]]
        return self.spell("last", word, CLASSES, valid=lambda w: w not in _first)


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of entities, left to right. A run of capitalised words is a name only from a title or a known first name on; its words of three letters or more are names wherever they stand."""
    out, at = [], 0
    if not _hint.search(text):
        return out
    while m := _find.search(text, at):
        kind, a, b = {"sep": "card", "cued": "name"}.get(m.lastgroup, m.lastgroup), m.start(), m.end()
        if m.lastgroup == "name":
            words = re.split(r"[ -]", m[0])
            if words[0].rstrip(".") not in _gender:
                k = next((i for i, w in enumerate(words[:-1]) if w in _first), None)
                if k is None:
                    at = b
                    continue
                a += sum(len(w) + 1 for w in words[:k])
        out.append((a, b, kind))
        at = b
    words = {w for a, b, kind in out if kind == "name" for w in re.split(r"[ -]", text[a:b]) if len(w) > 2 and w.rstrip(".") not in _gender}
    if words:
        starts = [a for a, _, _ in out]
        for m in re.finditer(rf"(?<!\w)(?:{'|'.join(sorted(map(re.escape, words)))})(?!\w)", text):
            k = bisect.bisect_right(starts, m.start()) - 1
            if (k < 0 or out[k][1] <= m.start()) and (k + 1 == len(starts) or m.end() <= starts[k + 1]):
                out.append((m.start(), m.end(), "name"))
        out.sort()
    return out


def canonical(kind: str, text: str) -> str:
    """What all spellings of an entity have in common."""
    if kind == "email":
        return text.lower()
    if kind in ("card", "ssn", "phone"):
        d = "".join(c for c in text if c.isdigit())
        return d[-10:] if kind == "phone" else d
    return text.replace(" ", "") if kind == "iban" else text


ENTITIES = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("original", T.StringType()), T.StructField("surrogate", T.StringType())]))


def rewrite(text: str, keyed: Surrogates) -> tuple[str, list[tuple[str, int, str, str]]]:
    """The text with surrogates, and (kind, start in it, original, surrogate) of each."""
    parts, found, at, size = [], [], 0, 0
    for a, b, kind in find(text):
        new = keyed.replace(kind, text[a:b])
        parts += [text[at:a], new]
        size += a - at
        found.append((kind, size, text[a:b], new))
        size += len(new)
        at = b
    return ("".join(parts) + text[at:], found) if found else (text, [])


def replace(docs: DataFrame, key: bytes) -> DataFrame:
    """`docs` with `text` rewritten and, last, a column `entities`; a narrow pass over whole texts."""
    keyed = Surrogates(key)
    name, inner = free_name(docs, "entities"), free_name(docs, "_r")

    @F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("entities", ENTITIES)]))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        keys = ("kind", "start", "original", "surrogate")
        for texts in lent(batches):
            done = [(None, []) if not isinstance(t, str) else rewrite(t, keyed) for t in texts]
            yield pd.DataFrame({"text": [t for t, _ in done], "entities": [[dict(zip(keys, e, strict=True)) for e in es] for _, es in done]})

    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select(*rest, run(F.col("text")).alias(inner)).select(*rest, F.col(f"{inner}.text").alias("text"), F.col(f"{inner}.entities").alias(name))


def collisions(replaced: DataFrame, entities: str = "entities") -> DataFrame:
    """kind, side, value and n: surrogates that n > 1 entities share, and entities that have n > 1 surrogates. Empty if distinctness and coreference hold."""

    @F.pandas_udf("string")
    def same(kind: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([canonical(k, t) for k, t in zip(kind, text, strict=True)])

    e = replaced.select(F.explode(entities).alias("e")).select("e.kind", "e.original", "e.surrogate").distinct()
    e = e.select("kind", same(F.col("kind"), F.col("original")).alias("original"), same(F.col("kind"), F.col("surrogate")).alias("surrogate")).distinct()
    sides = [e.groupBy("kind", F.lit(c).alias("side"), F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n")).where("n > 1") for c in ("original", "surrogate")]
    return sides[0].unionByName(sides[1])


def check(replaced: DataFrame, entities: str = "entities") -> None:
    """Raise if the mapping breaks distinctness or coreference anywhere in a corpus: a pass of its own over all texts, shuffling each entity once for each task that has it."""
    if bad := collisions(replaced, entities).head(5):
        raise ValueError(f"surrogates collide: {[(r.kind, r.side, r.n) for r in bad]}")
