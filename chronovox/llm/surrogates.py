"""PII: surrogate generation.

Detected entities are replaced by surrogates of the same type, shape, script and gender. A surrogate is the entity's
image under a keyed permutation of all strings of its shape (a Feistel network over mixed radices, one digit or letter
class a place), or of a list of names of one script and gender; so equal entities get equal surrogates in every document
(coreference) and different ones never the same (distinctness), without any table of what was seen. What identifies an
entity is permuted, not how it's written: the case of letters and the punctuation of numbers stay, so two spellings of
one number stay two spellings of one surrogate. Check digits stay right: cards by Luhn, IBANs by 97.

A name's gender is that of its list, or told by its ending, which a surrogate keeps. Titles stay in the text.

Spellings of one entity (the case of names and addresses, the punctuation of numbers, leading zeros of IP addresses, quotes
around secrets) have one canonical form; the canonical form of a surrogate is a one-to-one image of that of its entity, as
strings of different classes (listed names and others, hexadecimal secrets and others, numbers with right check digits and
others) are permuted apart. collisions() checks that over a whole table, and distinct() moves entities that share a surrogate
all the same on to their next images."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from math import prod

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronovox.operators.checkpoints import removed, stored_at

# Given names by script and gender, as surrogates and to tell a name's gender.
NAMES = {
    "latin f": """Agnes Alice Amelia Anna Astrid Barbara Beatrice Birgit Carla Carmen Caroline Charlotte Chiara Clara Diana Elena
        Elizabeth Emily Emma Eva Fatima Frances Giulia Grace Hannah Heike Helen Ingrid Irina Isabel Jane Julia Karen Laura
        Linda Lucy Margaret Maria Martha Mary Monika Natalie Nora Olga Olivia Patricia Paula Petra Rachel Rebecca Rosa Sabine
        Sarah Sophie Susan Tatiana Teresa Ursula Victoria Yvonne""".split(),
    "latin m": """Adam Ahmed Albert Alexander Andrew Anthony Antonio Benjamin Bruno Carlos Charles Daniel David Diego Edward Eric
        Fernando Frank Frederick George Hans Harold Henry Hugo Ivan Jack James Javier John Joseph Julian Karl Klaus Lewis Luke
        Mark Martin Matthew Michael Mohamed Nicholas Oliver Oscar Otto Patrick Paul Pedro Peter Philip Pierre Richard Robert
        Samuel Simon Stefan Stephen Thomas Victor William Wolfgang""".split(),
    "cyrillic f": "Анна Валентина Вера Дарья Екатерина Елена Ирина Ксения Любовь Мария Надежда Наталья Ольга Светлана Татьяна".split(),
    "cyrillic m": "Александр Андрей Борис Виктор Владимир Дмитрий Иван Кирилл Максим Михаил Николай Олег Павел Сергей Юрий".split(),
    "greek f": "Άννα Αικατερίνη Γεωργία Δήμητρα Ειρήνη Ελένη Ευαγγελία Κωνσταντίνα Μαρία Σοφία".split(),
    "greek m": "Αθανάσιος Αλέξανδρος Ανδρέας Γεώργιος Δημήτριος Ιωάννης Κωνσταντίνος Μιχαήλ Νικόλαος Παναγιώτης".split(),
}
# Endings that tell a name's gender; surrogates of names in no list keep them.
ENDINGS = tuple("""ovna evna ovich evich skaya skaia skiy sky ska ski ova eva ina ova yova dottir sdottir sson овна евна ович евич ская ский
    ова ева ина ов ев ин оглу ίδου ίδης άκης πούλου πουλος a o а я""".split())
# Titles.
TITLES = ("Mr", "Mrs", "Ms", "Miss", "Herr", "Frau", "Señor", "Señora", "Monsieur", "Madame", "Mme", "Dr", "Prof")
INTRODUCTIONS = ("my name is ", "My name is ", "je m'appelle ", "Je m'appelle ", "ich heiße ", "Ich heiße ", "me llamo ", "Me llamo ")
# Domains that are reserved for examples stay as they are.
RESERVED = ("example.com", "example.org", "example.net", "example.edu")

_VOWELS, _CONSONANTS = "aeiou", "bcdfghjklmnpqrstvwxyz"
_LATIN, _DIGITS, _HEX = "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"
_span = lambda a, b: "".join(map(chr, range(a, b + 1)))
#: Lower-case alphabets of other scripts; a letter's surrogate comes from its own one.
_SCRIPTS = [_span(0x3B1, 0x3C1) + _span(0x3C3, 0x3C9), _span(0x430, 0x44F), _span(0x5D0, 0x5EA), _span(0x627, 0x63A), _span(0x905, 0x939), _span(0x3041, 0x3096), _span(0x30A1, 0x30FA), _span(0xAC00, 0xD7A3), _span(0x4E00, 0x9FFF), "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿß"]

_TOKENS = re.compile(r"[\d@]")
_NAMED = r"(?:api[ _-]?key|access[ _-]?key|secret|token|password|passwd|pwd)"
_PATTERNS = [
    ("email", re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}")),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    ("secret", re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![0-9A-Za-z])|(?<![0-9A-Za-z])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36,}|sk-[0-9A-Za-z_-]{20,}|xox[abprs]-[0-9A-Za-z-]{10,}|AIza[0-9A-Za-z_-]{35})(?![0-9A-Za-z])")),
    ("secret", re.compile(r"(?i)(?<=[:=] )[\"'](?=[^\"']*\d)[0-9a-z_+/=.-]{16,}[\"']|(?<=[:=])[\"'](?=[^\"']*\d)[0-9a-z_+/=.-]{16,}[\"']")),
    ("secret", re.compile(r"(?i)(?<![0-9A-Za-z])" + _NAMED + r"(?: ?= ?|: ?)(?P<v>[^\s\"',;<>()]{8,})")),
    ("card", re.compile(r"(?<![\d.,+-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{5})(?!\d|[.,-]\d)")),
    ("ip", re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)")),
    ("ip", re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])")),
    ("ssn", re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")),
    ("phone", re.compile(r"(?<![\w.+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?)\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\w.+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)|(?<![\w.+-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])")),
    ("phone", re.compile(r"(?i)(?<![0-9A-Za-z])(?:tel|phone|mobile|fax)(?:\.:|[.:])? ?(?P<v>\d{2,4}(?: \d{2,4}){2,4})(?!\d)")),
]
_WORD = r"[^\W\d_a-zß-öø-ÿ](?:[^\W\d_]|['’-](?=[^\W\d_]))+"
_TITLED = re.compile(r"(?<!\w)(" + "|".join(TITLES) + r")(\.? )(" + _WORD + r"(?: (?:" + _WORD + r")){0,2})")
_INTRODUCED = re.compile("(?:" + "|".join(INTRODUCTIONS) + ")(" + _WORD + r"(?: (?:" + _WORD + r")){0,2})")


class Permutations:
    """Keyed bijections."""

    def __init__(self, key: bytes):
        self.key = key

    def _random(self, tweak: str, k: int, value: int, below: int) -> int:
        n = (below.bit_length() + 7) // 8 + 16
        data = hashlib.shake_256(self.key + f"|{tweak}|{k}|{value}".encode()).digest(n)
        return int.from_bytes(data) % below

    def number(self, x: int, left: int, right: int, tweak: str) -> int:
        """A bijection of range(left * right)."""
        a, b = divmod(x, right)
        for k in range(8):
            if k % 2:
                b = (b + self._random(tweak, k, a, right)) % right
            else:
                a = (a + self._random(tweak, k, b, left)) % left
        return a * right + b

    def places(self, digits: list[int], radices: list[int], tweak: str) -> list[int]:
        """A bijection of the digit strings of these radices."""
        if not digits:
            return []
        tweak = f"{tweak}|{','.join(map(str, radices))}"
        half = len(digits) // 2
        x = 0
        for d, r in zip(digits, radices, strict=True):
            x = x * r + d
        x = self.number(x, prod(radices[:half]), prod(radices[half:]), tweak)
        out = []
        for r in reversed(radices):
            x, d = divmod(x, r)
            out.append(d)
        return out[::-1]

    def string(self, text: str, alphabets: list[str], tweak: str, allowed=lambda s: True) -> str:
        """A bijection of the strings of the same shape: each character is replaced by one of the first alphabet that
        has it, in its own case; others stay and belong to the shape. Images that aren't allowed are mapped on, so the
        allowed strings, of which `text` must be one, are permuted among themselves."""
        lower = list(lowered(text))
        own = [next((a for a in alphabets if c in a), None) for c in lower]
        shape = "".join("*" if a else c for a, c in zip(own, lower, strict=True))
        now = lower
        while True:  # the cycle comes back to the text itself, so it ends
            images = iter(self.places([a.index(c) for a, c in zip(own, now, strict=True) if a], [len(a) for a in own if a], f"{tweak}|{shape}"))
            now = [a[next(images)] if a else c for a, c in zip(own, now, strict=True)]
            if allowed("".join(now)):
                break
        return "".join(c.upper() if was.isupper() and len(c.upper()) == 1 else c for c, was in zip(now, text, strict=True))

    def listed(self, item: str, items: list[str], tweak: str) -> str:
        """A bijection of a list without fixed items: the next item in a keyed order."""
        order = sorted(items, key=lambda x: hashlib.blake2b(f"{tweak}|{x}".encode(), key=self.key[:64]).digest())
        return order[(order.index(item) + 1) % len(order)]


def lowered(text: str) -> str:
    """Each character in lower case, if that is one character."""
    return "".join([c.lower() if len(c.lower()) == 1 else c for c in text])


def folded(name: str) -> str:
    """What listed names are looked up by; a final sigma is told from others by its place."""
    return name.upper().lower()


def plain_digits(text: str) -> str:
    return text if text.isascii() else re.sub(r"\d", lambda m: str(int(m[0])), text)


def hexadecimal(secret: str) -> bool:
    """Of hexadecimal digits in one case, letters and figures both among them."""
    low = secret.lower()
    return secret in (low, secret.upper()) and not low.strip(_HEX) and not low.isdigit() and not low.isalpha()


def canonical(kind: str, text: str) -> str:
    """What an entity's spellings have in common."""
    if kind == "name":
        return folded(text) if folded(text) in GENDER else lowered(text)
    text = plain_digits(text)
    if kind == "email":
        return text.lower()
    if kind == "secret":
        return text.strip("\"'")
    if kind == "ip":
        return ":".join(f"{int(x, 16):x}" for x in text.split(":")) if ":" in text else ".".join(str(int(x)) for x in text.split("."))
    return re.sub(r"[^0-9A-Z]", "", text)


#: Listed names, folded: the list that has them.
GENDER = {folded(n): g for g, names in NAMES.items() for n in names}


def luhn(digits: str) -> bool:
    return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(digits))) % 10 == 0


def checked(iban: str) -> bool:
    """Whether the check digits of an IBAN (without spaces) are right; those are 02 to 98."""
    return 2 <= int(iban[2:4]) <= 98 and int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def ending(name: str) -> str:
    """The longest of ENDINGS that a name has behind two letters at least; none if it has none."""
    return max((e for e in ENDINGS if name.endswith(e) and len(name) >= len(e) + 2), key=len, default="")


class Surrogates:
    """Finds entities in a text and makes their surrogates."""

    def __init__(self, key: bytes, moved: dict[str, int] | None = None):
        """moved: how many further images an entity (by its digest) is moved on."""
        if not key:
            raise ValueError("a key is needed")
        self.p = Permutations(key)
        self.moved = moved or {}
        self.surrogate = lru_cache(1 << 16)(self._surrogate)

    def _digits(self, text: str, new: str) -> str:
        it = iter(new)
        return "".join(next(it) if c.isdigit() else c for c in text)

    def _surrogate(self, kind: str, text: str) -> str:
        p = self.p
        if kind != "name":
            text = plain_digits(text)
        if kind == "email":
            local, _, domain = text.partition("@")
            tail = next((r for r in RESERVED if domain.lower().endswith(r)), domain[domain.rfind(".") + 1 :].lower())
            head = domain[: len(domain) - len(tail)]
            # The whole address is one string, so addresses of one domain don't show that they are.
            reserved = tail in RESERVED
            new = p.string(f"{local}@{head}", [_LATIN, _DIGITS], f"email|{tail}", lambda s: reserved or not (s + tail).endswith(RESERVED))
            return new + domain[len(head) :]
        if kind == "phone":
            digits = re.sub(r"\D", "", text)
            n = min(len(digits), 10)
            return self._digits(text, digits[:-n] + p.string(digits[-n:], [_DIGITS], "phone"))
        if kind == "card":
            digits = re.sub(r"\D", "", text)
            valid = luhn(digits)
            return self._digits(text, p.string(digits, [_DIGITS], "card", lambda s: luhn(s) == valid))
        if kind == "ip":
            if ":" in text:
                groups = text.split(":")
                new = ":".join(f"{x:0{4 if all(len(g) == 4 for g in groups) else 1}x}" for x in p.places([int(g, 16) for g in groups], [1 << 16] * 8, "ip6"))
                return new.upper() if text != text.lower() else new
            parts = list(map(int, text.split(".")))
            kept = 1 <= parts[0] <= 223
            while True:
                parts = p.places(parts, [256] * 4, "ip4")
                if (1 <= parts[0] <= 223) == kept:
                    return ".".join(map(str, parts))
        if kind == "ssn":
            return self._digits(text, p.string(text.replace("-", ""), [_DIGITS], "ssn"))
        if kind == "iban":
            return self._iban(text)
        if kind == "secret":
            bare = text.strip("\"'")
            at = text.index(bare)
            if hexadecimal(bare):
                new = p.string(bare.lower(), [_HEX], "secret|hex", hexadecimal)
                new = new.upper() if bare.isupper() else new
            else:  # letters stay letters, so those of mixed case stay mixed
                one_case = bare in (bare.lower(), bare.upper())
                new = p.string(bare, [_LATIN, _DIGITS], "secret", lambda s: not (one_case and hexadecimal(s)))
            return text[:at] + new + text[at + len(bare) :]
        if known := GENDER.get(folded(text)):
            new = p.listed(next(n for n in NAMES[known] if folded(n) == folded(text)), NAMES[known], "name")
            return new.upper() if text.isupper() else new
        name = lowered(text)
        # A name of no list gets letters of its own kinds before the ending that may tell its gender.
        tail = ending(name)
        stem = text[: len(text) - len(tail)]
        new = p.string(stem, [_VOWELS, _CONSONANTS, *_SCRIPTS], f"name|{tail}", lambda x: ending(x + tail) == tail and folded(x + tail) not in GENDER)
        return new + text[len(stem) :]

    def _iban(self, text: str) -> str:
        """Country and shape stay. Of an IBAN with right check digits, the rest is permuted and gets its own right ones;
        others are permuted among themselves."""
        bare = text.replace(" ", "")
        if checked(bare):
            rest = self.p.string(bare[4:], [_DIGITS, _LATIN], "iban").upper()
            new = f"{98 - int(''.join(str(int(c, 36)) for c in rest + bare[:2] + '00')) % 97:02d}{rest}"
        else:
            new = self.p.string(bare[2:], [_DIGITS, _LATIN], f"iban|{bare[:2]}", lambda x: not checked(bare[:2] + x.upper())).upper()
        it = iter(bare[:2] + new)
        return "".join(c if c == " " else next(it) for c in text)

    def find(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, type) of the entities, in order, without overlaps; of overlapping ones the earlier type wins."""
        found: list[tuple[int, int, str]] = []
        taken: list[tuple[int, int]] = []

        def add(a: int, b: int, kind: str) -> None:
            if all(b <= x or y <= a for x, y in taken):
                taken.append((a, b))
                found.append((a, b, kind))

        if _TOKENS.search(text):
            for kind, pattern in _PATTERNS:
                if kind == "email" and "@" not in text or kind == "ssn" and "-" not in text:
                    continue
                for m in pattern.finditer(text):
                    a, b = m.span("v" if "v" in pattern.groupindex else 0)
                    own = text[a:b]
                    if kind == "secret" and not (re.search(r"\d", own) and re.search(r"[A-Za-z]", own)):
                        continue
                    if kind == "card" and own.isdigit() and not luhn(own):
                        continue  # a long number that is no card's
                    add(a, b, kind)
        named: set[str] = set()
        for pattern, group in ((_TITLED, 3), (_INTRODUCED, 1)):
            if any(t in text for t in (TITLES if pattern is _TITLED else INTRODUCTIONS)):
                for m in pattern.finditer(text):
                    for w in re.finditer(r"\S+", m[group]):
                        add(m.start(group) + w.start(), m.start(group) + w.end(), "name")
                        named.add(w[0])
        if named:  # later mentions of the same names
            for m in re.finditer(r"(?<!\w)(?:" + "|".join(map(re.escape, sorted(named, key=len, reverse=True))) + r")(?!\w)", text):
                add(*m.span(), "name")
        return sorted(found)

    def entity(self, kind: str, text: str) -> str:
        """A keyed digest that tells entities apart without telling what they are; spellings of one have the same."""
        return hashlib.blake2b(f"{kind}|{canonical(kind, text)}".encode("utf-8", "surrogatepass"), key=self.p.key[:64], digest_size=8).hexdigest()

    def replace(self, text: str | None) -> tuple[str | None, list[dict]]:
        """The text with surrogates, and the entities' places in the original."""
        if not text:
            return text, []
        out, spans, last = [], [], 0
        for a, b, kind in self.find(text):
            own = self.entity(kind, text[a:b])
            new = self.surrogate(kind, text[a:b])
            for _ in range(self.moved.get(own, 0)):
                new = self.surrogate(kind, new)
            out += [text[last:a], new]
            spans.append({"start": a, "end": b, "kind": kind, "surrogate": new, "entity": own, "image": self.entity(kind, new)})
            last = b
        return "".join([*out, text[last:]]), spans


def collisions(found: DataFrame) -> DataFrame:
    """kind, image, n, entities: surrogates, by the digest of their canonical form, that n > 1 different entities share in the
    column `entities` of a whole table, of which there should be none. Equal entities are one row before the shuffle."""
    each = found.select(F.explode("entities").alias("e")).select("e.kind", "e.image", "e.entity").distinct()
    return each.groupBy("kind", "image").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("entity")).alias("entities")).where("n > 1")


_FIELDS = {"start": "int", "end": "int", "kind": "string", "surrogate": "string", "entity": "string", "image": "string"}


def replaced(docs: DataFrame, key: bytes, text_col: str = "text", moved: dict[str, int] | None = None) -> DataFrame:
    """All columns of docs, the text column with surrogates, and entities: array of (start, end, kind, surrogate, entity,
    image), start and end in code points of the original, entity and image keyed digests of the canonical forms of it and of
    its surrogate. An existing column named entities is overwritten.

    A null text stays null, and texts without entities stay as they are, to the byte. Entities inside very long texts
    are found like any other, in one task a text. Repeated rows come out repeated, with equal surrogates; no rows, no rows."""
    kind = f"array<struct<{','.join(f'{n}:{t}' for n, t in _FIELDS.items())}>>"
    schema = pa.struct([("text", pa.string()), ("entities", pa.list_(pa.struct([(n, pa.int32() if t == "int" else pa.string()) for n, t in _FIELDS.items()])))])

    @F.arrow_udf(f"struct<text:string,entities:{kind}>")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        maker = Surrogates(key, moved)
        for batch in texts:
            done = [maker.replace(t.as_py()) for t in batch]
            yield pa.StructArray.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], schema.field("entities").type)], fields=list(schema))

    rest = [c for c in docs.columns if c not in (text_col, "entities")]
    return (
        docs.select(*rest, F.col(text_col).alias("__text"))
        .withColumn("__new", run("__text"))
        .select(*[F.col("__new.text").alias(c) if c == text_col else F.col(c) for c in docs.columns if c != "entities"], F.col("__new.entities").alias("entities"))
    )


def distinct(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """replaced(), stored once, and checked: of entities that share a surrogate all but the one of least digest are moved
    on to their next image, everywhere, until none do. The driver holds the moved ones only; the permutations leave none
    but for the digests' own collisions."""
    moved: dict[str, int] = {}
    while True:
        at, found = stored_at(replaced(docs, key, text_col, moved))
        shared = [e for r in collisions(found).toLocalIterator() for e in r["entities"][1:]]
        if not shared:
            return found
        removed(docs.sparkSession, at)
        for e in shared:
            moved[e] = moved.get(e, 0) + 1
