"""PII surrogates: what is found is replaced by a keyed stand-in of the same type and form.

An entity is its type and canonical value (an address in lower case, a number's digits, a name). A keyed hash
of the entity draws the stand-in: digits for digits and letters for letters in the same layout, names of the same
gender and script. So the same entity reads the same in all documents without any exchange between tasks. What
a keyed hash can't promise is distinctness: two entities may draw the same stand-in, or a stand-in may be
someone's real value. One pass over the distinct entities finds those, they draw again until none is left, and only
these exceptions are told to the pass that rewrites the texts.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import add_columns, kept

# Forms of entities, honorifics by gender, and names by script and gender.
LOCAL = re.compile(r"[A-Za-z0-9À-ÖØ-öø-ÿ._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9À-ÖØ-öø-ÿ-]+(?:\.[A-Za-z0-9À-ÖØ-öø-ÿ-]+)+")
IPV4 = re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\w)", re.ASCII)
IBAN = re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", re.ASCII)
CARD = re.compile(r"(?<![\w.+-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\2\d{4,5})(?![\w-])", re.ASCII)
SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", re.ASCII)
PHONE = re.compile(r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?!\w|\.\d)|\+\d{8,15}(?!\w)", re.ASCII)
NUMERIC = (("ip", IPV4), ("iban", IBAN), ("card", CARD), ("ssn", SSN), ("phone", PHONE))
HONORIFICS = {
    "m": ("Mr", "Herr", "Monsieur", "Señor", "Don", "господин", "Господин", "κύριος"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Doña", "госпожа", "Госпожа", "κυρία"),
    "n": ("Dr", "Prof"),
}
GIVEN = {
    ("latin", "m"): ("James", "Peter", "Martin", "Oliver", "Victor", "Simon", "Hugo", "Felix", "Adrian", "Leo", "Marco", "Julian"),
    ("latin", "f"): ("Anna", "Clara", "Helena", "Julia", "Laura", "Martha", "Nora", "Sofia", "Vera", "Alice", "Irene", "Emma"),
    ("latin", "n"): ("Robin", "Kim", "Alex", "Sam", "Noa", "Charlie", "Jamie", "Sascha", "Dominique", "Andrea", "Toni", "Jo"),
    ("cyrillic", "m"): ("Иван", "Пётр", "Алексей", "Михаил", "Павел", "Сергей", "Олег", "Антон"),
    ("cyrillic", "f"): ("Анна", "Елена", "Мария", "Ольга", "Вера", "Ирина", "Нина", "Татьяна"),
    ("cyrillic", "n"): ("Саша", "Женя", "Валя", "Слава"),
    ("greek", "m"): ("Νίκος", "Γιώργος", "Πέτρος", "Ανδρέας", "Σπύρος", "Μάριος"),
    ("greek", "f"): ("Μαρία", "Ελένη", "Σοφία", "Άννα", "Ειρήνη", "Κατερίνα"),
    ("greek", "n"): ("Άρης", "Αλέξης", "Φώτης", "Χάρης"),
}
SYLLABLES = {
    "latin": ("ba", "del", "for", "gan", "hol", "jor", "kel", "lin", "mar", "nor", "pas", "ren", "sel", "tor", "vin", "wes"),
    "cyrillic": ("бар", "вол", "гор", "дан", "зор", "кал", "лом", "мир", "нов", "пет", "рос", "сав", "тар", "фом", "хол", "яр"),
    "greek": ("βα", "γορ", "δη", "θε", "κα", "λα", "μαν", "νικ", "παπ", "ρο", "σαρ", "τσι", "φω", "χα", "ψα", "ζε"),
}

#: A name has up to this many hyphens.
HYPHENS = 3
NAME = rf"[^\W\d_a-zа-яёα-ωά-ώß-öø-ÿ][^\W\d_]+(?:-[^\W\d_]+){{0,{HYPHENS}}}"
WORDS = re.compile(r"(?<!\w)[^\W\d_]+(?:-[^\W\d_]+)*(?!\w)")
_GENDER = {word: g for g, words in HONORIFICS.items() for word in words}
PERSON = re.compile(rf"\b({'|'.join(sorted(_GENDER, key=len, reverse=True))})\.?\x20+({NAME})(?:\x20+({NAME}))?")
_TITLES = tuple(_GENDER)
ENTITY = "struct<type:string,value:string>"
Found = tuple[int, int, str, str]  # start, end, type, canonical value


def script(word: str) -> str:
    c = word[0]
    return "cyrillic" if "Ѐ" <= c <= "ӿ" else "greek" if "Ͱ" <= c <= "Ͽ" else "latin"


def _names(text: str) -> list[Found]:
    """Names after an honorific, and the same names where they come up again in the text."""
    people: dict[str, str] = {}
    for m in PERSON.finditer(text):
        first, last = m.group(2), m.group(3)
        if last:
            people.setdefault(first, f"given:{_GENDER[m.group(1)]}")
            people[last] = "surname"
        else:
            people[first] = "surname"
    if not people:
        return []
    found = []
    for m in WORDS.finditer(text):
        at, parts, k = m.start(), m.group().split("-"), 0
        while k < len(parts):
            # the longest name that begins with this part
            n = next((n for n in range(min(HYPHENS + 1, len(parts) - k), 0, -1) if "-".join(parts[k : k + n]) in people), 0)
            name = "-".join(parts[k : k + max(n, 1)])
            if n:
                found.append((at, at + len(name), f"{people[name]}:{script(name)}", name))
            at, k = at + len(name) + 1, k + max(n, 1)
    return found


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses that don't overlap: from each @ back and on, never over what lies before the last @ or address, so that a long run of letters is read once."""
    low, at = 0, text.find("@")
    while at >= 0:
        before = LOCAL.match(text[low:at][::-1])
        domain = DOMAIN.match(text, at + 1) if before else None
        if domain:
            yield at - before.end(), domain.end()
        low = domain.end() if domain else at + 1
        at = text.find("@", low)


def find(text: str) -> list[Found]:
    """Entities by start. Kinds are sought one after the other, in what the kinds before have left."""
    found: list[Found] = []

    def take(kind: str, spans: Iterator[tuple[int, int]], left: str) -> str:
        own = []
        for start, end in spans:
            surface = left[start:end]
            value = surface.lower() if kind == "email" else surface if kind == "ip" else "".join(c for c in surface if c.isalnum())
            if kind == "phone":
                if len(value) < 7:
                    continue
                value = "+" * (surface[0] == "+") + value
            own.append((start, end, kind, value))
        found.extend(own)
        return _without(left, own)

    left = take("email", _emails(text), text) if "@" in text else text
    if re.search(r"\d", text):
        for kind, pattern in NUMERIC:
            left = take(kind, (m.span() for m in pattern.finditer(left)), left)
    if any(t in text for t in _TITLES):
        found += _names(left)
    return sorted(found)


def _without(text: str, found: list[Found]) -> str:
    """The text with what was found blanked out, as long as before."""
    if not found:
        return text
    out, at = [], 0
    for start, end, *_ in found:
        out += [text[at:start], "\n" * (end - start)]
        at = end
    return "".join([*out, text[at:]])


def _stream(key: bytes, label: str) -> Iterator[int]:
    """Bytes without an end."""
    n = 0
    while True:
        yield from hmac.new(key, f"{n}|{label}".encode(), hashlib.sha256).digest()
        n += 1


def _luhn(digits: list[int]) -> int:
    return sum(d if k % 2 == 0 else (2 * d) // 10 + (2 * d) % 10 for k, d in enumerate(reversed(digits))) % 10


def _like(value: str, draw: Iterator[int]) -> str:
    """Digits for digits and letters for letters of the same case; the first of a run of digits stays non-zero if it was."""
    out = []
    for c in value:
        x = next(draw) << 8 | next(draw)
        if c.isdigit():
            out.append(str(x % 10) if c == "0" or (out and out[-1].isdigit()) else str(1 + x % 9))
        elif c.isalpha():
            out.append(chr((97 if c.islower() else 65) + x % 26))
        else:
            out.append(c)
    return "".join(out)


#: Attempts that keep the length of an address or a number; each further one is longer by a character.
SAME_LENGTH = 8


def stand_in(key: bytes, kind: str, value: str, attempt: int) -> str:
    """The canonical stand-in of an entity. Later attempts draw afresh, names from longer ones, and addresses and telephone numbers become longer where short ones are all in use."""
    draw = _stream(key, f"{kind}|{value}|{attempt}")
    more = max(0, attempt - SAME_LENGTH)
    if kind == "email":
        local, _, domain = value.partition("@")
        host, _, top = domain.rpartition(".")
        return f"{_like(local + 'x' * more, draw)}@{_like(host, _stream(key, f'domain|{domain}|{attempt}'))}.{top}"
    if kind == "ip":
        first = int(value.split(".")[0])
        if first in (0, 10, 127):
            return f"{first}." + ".".join(str(next(draw)) for _ in range(3))
        head = [x for x in range(1, 224) if x not in (10, 127)]
        return f"{head[(next(draw) << 8 | next(draw)) % len(head)]}." + ".".join(str(next(draw)) for _ in range(3))
    if kind == "iban":
        return value[:2] + _like(value[2:], draw)
    if kind == "card":
        out = [int(c) for c in _like(value, draw)]
        if _luhn([int(c) for c in value]) == 0:
            out[-1] = 0
            out[-1] = -_luhn(out) % 10
        return "".join(map(str, out))
    if kind.startswith("given:"):
        _, gender, own = kind.split(":")
        names = GIVEN[own, gender]
        return "-".join(names[(next(draw) << 8 | next(draw)) % len(names)] for _ in range(1 + attempt))
    if kind.startswith("surname:"):
        parts = SYLLABLES[kind.split(":")[1]]
        return "".join(parts[next(draw) % 16] for _ in range(4 + attempt)).capitalize()
    if value.startswith("+"):  # the first digit of a country code stays
        return value[:2] + _like(value[2:] + "1" * more, draw)
    return _like(value + "1" * (more if kind == "phone" else 0), draw)


def _laid_out(surface: str, canonical: str, kind: str) -> str:
    """The canonical stand-in in the layout of what stood there: its separators, its capitals."""
    if kind.startswith(("given:", "surname:")):
        return canonical.upper() if surface.isupper() and len(surface) > 1 else canonical
    if kind == "email":
        if surface.islower() or len(surface) != len(canonical):
            return canonical
        return "".join(c.upper() if s.isupper() else c for s, c in zip(surface, canonical, strict=True))
    if kind == "ip":
        return canonical
    own = iter(canonical.removeprefix("+"))
    return "".join(next(own) if c.isalnum() else c for c in surface) + "".join(own)


class Rewriter:
    def __init__(self, key: bytes, again: dict[tuple[str, str], int]):
        self.again = again
        self.of: Callable[[str, str, int], str] = lru_cache(maxsize=100_000)(lambda kind, value, attempt: stand_in(key, kind, value, attempt))

    def __call__(self, text: str, again: dict[tuple[str, str], int] | None = None) -> tuple[str, list[dict]]:
        again = self.again if again is None else again
        out, entities, at = [], [], 0
        for start, end, kind, value in find(text):
            new = _laid_out(text[start:end], self.of(kind, value, again.get((kind, value), 0)), kind)
            out += [text[at:start], new]
            entities.append({"kind": kind.partition(":")[0], "start": start, "end": end, "surrogate": new})
            at = end
        return "".join([*out, text[at:]]), entities


def _entities(text: Column) -> Column:
    @F.arrow_udf(f"array<{ENTITY}>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("type", pa.string()), ("value", pa.string())]))
        for batch in batches:
            yield pa.array([[{"type": k, "value": v} for k, v in {f[2:] for f in find(t.as_py() or "")}] for t in batch], kind)

    return found(text)


def collisions(docs: DataFrame, key: bytes, text: str = "text", rounds: int = 64) -> DataFrame:
    """``type, value, attempt`` of the entities whose first stand-in another entity has, or is someone's real value.

    Of entities that draw the same, the one with the fewest attempts and least value keeps it. Each round is a
    shuffle of the distinct entities; the next draws again only for those that met.
    """

    @F.arrow_udf("string")
    def drawn(kinds: pa.Array, values: pa.Array, attempts: pa.Array) -> pa.Array:
        return pa.array([stand_in(key, *x) for x in zip(kinds.to_pylist(), values.to_pylist(), attempts.to_pylist(), strict=True)], pa.string())

    one = docs.select(F.explode(_entities(F.col(text))).alias("e")).groupBy(F.col("e.type").alias("type"), F.col("e.value").alias("value")).agg(F.lit(0).alias("attempt"))
    all_ = kept(one.withColumn("new", drawn("type", "value", "attempt")))
    space = F.split_part("type", F.lit(":"), F.lit(1))  # given names of all genders and scripts must differ
    real = all_.select(space.alias("space"), F.col("value").alias("new")).distinct()
    for _ in range(rounds):
        own = all_.withColumn("space", space)
        best = own.groupBy("space", "new").agg(F.min(F.struct("attempt", "type", "value")).alias("best"), F.count("*").alias("n"))
        taken = best.join(real.withColumn("is_real", F.lit(True)), ["space", "new"], "left").where("n > 1 or is_real")
        again = own.join(taken, ["space", "new"]).where("is_real or not (best.type = type and best.value = value)").select("type", "value", (F.col("attempt") + 1).alias("attempt"))
        again = kept(again.withColumn("new", drawn("type", "value", "attempt")))
        if again.isEmpty():
            break
        all_ = kept(all_.join(again.select("type", "value"), ["type", "value"], "left_anti").unionByName(again))
    else:
        raise RuntimeError("entities still share stand-ins; there are too many of one type")
    return all_.where("attempt > 0").select("type", "value", "attempt")


def pseudonymised(docs: DataFrame, key: bytes, text: str = "text", most_sent: int = 100_000) -> DataFrame:
    """``docs`` with the text rewritten in place, and ``entities``: kind, start and end in the old text, and surrogate.

    Null stays null and an empty text empty. Of exceptions, up to ``most_sent`` go to all tasks; more are joined
    to the texts that hold them. An input column ``entities`` is replaced. The same key gives the same stand-ins.
    """
    again = kept(collisions(docs, key, text))
    rows = docs.select(F.struct("*").alias("_row"))
    kind = pa.struct([("text", pa.string()), ("entities", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("surrogate", pa.string())])))])
    result = "struct<text:string,entities:array<struct<kind:string,start:int,end:int,surrogate:string>>>"

    def packed(texts: Iterator[str | None], own: Iterator[dict | None], write: Rewriter) -> pa.Array:
        out = []
        for t, a in zip(texts, own, strict=True):
            new, entities = write(t or "", a)
            out.append({"text": None if t is None else new, "entities": entities})
        return pa.array(out, kind)

    if again.count() <= most_sent:
        sent = docs.sparkSession.sparkContext.broadcast({(r.type, r.value): r.attempt for r in again.collect()})

        @F.arrow_udf(result)
        def rewritten(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            write = Rewriter(key, sent.value)
            for batch in batches:
                yield packed((t.as_py() for t in batch), (None for _ in batch), write)

        rows = rows.withColumn("_new", rewritten(F.col("_row")[text]))
    else:

        @F.arrow_udf(result)
        def rewritten_with(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            write = Rewriter(key, {})
            for texts, own in batches:
                yield packed((t.as_py() for t in texts), ({(e["type"], e["value"]): e["attempt"] for e in a.as_py() or ()} for a in own), write)

        rows = rows.withColumn("_sha", F.sha2(F.coalesce(F.col("_row")[text], F.lit("")), 256))
        held = rows.select("_sha", F.explode(_entities(F.col("_row")[text])).alias("e")).distinct()
        own = held.join(again, (F.col("e.type") == F.col("type")) & (F.col("e.value") == F.col("value"))).groupBy("_sha").agg(F.collect_set(F.struct("type", "value", "attempt")).alias("_again"))
        rows = rows.join(own, "_sha", "left").withColumn("_new", rewritten_with(F.col("_row")[text], F.col("_again")))
    return add_columns(rows, "_row", {text: F.col("_new.text"), "entities": F.col("_new.entities")})
