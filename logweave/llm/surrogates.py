"""PII surrogates: detected entities get keyed replacements of the same type, format, script and gender.

An entity is its type and canonical value (case and separators removed; of a person, the name without title), so all mentions of
one entity in the corpus get one surrogate (coreference).  Within a document, untitled and shorter mentions of a titled
name belong to it, and any of its titles tells its gender.  A surrogate is drawn from a keyed hash of the entity and a draw number.
Distinct entities must keep distinct surrogates, and no surrogate may be another real entity: entities that clash are
drawn again until none does, from a format that grows wider every few draws, so that this ends however full
a format is of real values.  Almost all stay with draw 0, which a task computes from the key alone; only the others are looked up.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .tables import stored
from .textops import slices

#: Draws after which a format grows by one character, digit or octet.
DRAWS_PER_WIDTH = 6
SALTS = 16

# Titles with their gender, and given names and family-name syllables by script.
TITLES = {"Mr": "m", "Mister": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "Mrs": "f", "Ms": "f", "Miss": "f",
          "Frau": "f", "Madame": "f", "Mme": "f", "Señora": "f", "Sra": "f", "Dr": "n", "Prof": "n",
          "господин": "m", "Господин": "m", "госпожа": "f", "Госпожа": "f", "Κύριος": "m", "Κυρία": "f"}
GIVEN = {("latin", "m"): ["Adam", "Boris", "Carl", "David", "Erik", "Felix", "George", "Hugo", "Ivan", "Jonas", "Karl", "Leon",
                          "Martin", "Nils", "Oscar", "Paul", "Robert", "Simon", "Thomas", "Victor"],
         ("latin", "f"): ["Alice", "Berta", "Clara", "Diana", "Emma", "Flora", "Greta", "Helen", "Irene", "Julia", "Karen", "Laura",
                          "Maria", "Nora", "Olivia", "Paula", "Rosa", "Sofia", "Teresa", "Vera"],
         ("cyrillic", "m"): ["Антон", "Борис", "Виктор", "Денис", "Иван", "Кирилл", "Максим", "Олег", "Павел", "Роман"],
         ("cyrillic", "f"): ["Анна", "Вера", "Дарья", "Елена", "Ирина", "Ксения", "Мария", "Нина", "Ольга", "Тамара"],
         ("greek", "m"): ["Αλέξης", "Γιώργος", "Δημήτρης", "Κώστας", "Νίκος", "Πέτρος", "Σταύρος", "Χρήστος"],
         ("greek", "f"): ["Άννα", "Βασιλική", "Γεωργία", "Ελένη", "Κατερίνα", "Μαρία", "Σοφία", "Χριστίνα"]}
SYLLABLES = {"latin": ["bar", "ben", "dal", "der", "fen", "gar", "hol", "kel", "lan", "mar", "nor", "per", "ros", "sten", "tor", "wal"],
             "cyrillic": ["бар", "вол", "гор", "дан", "зор", "кар", "лен", "мор", "нов", "пет", "рам", "сол", "тар", "фед"],
             "greek": ["βαρ", "γαλ", "δαμ", "ζαν", "καλ", "λαμ", "μαν", "νικ", "παπ", "ραλ", "σταμ", "τσαν"]}

#: Words in lower case that may stand within a name.
PARTICLES = ["van", "von", "der", "den", "de", "del", "della", "di", "da", "dos", "du", "la", "le", "zu", "bin", "ibn", "al", "el"]
_MARKS = "\u0300-\u036f\u0591-\u05bd\u064b-\u065f\u0670\u0900-\u0903\u093a-\u094f\u0951-\u0957"

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_TITLE = "|".join(sorted(map(re.escape, TITLES), key=len, reverse=True))
_LETTERS = rf"(?:[^\W\d_][{_MARKS}]*)+"
_NAME = rf"{_LETTERS}(?:['’-]{_LETTERS})*"
_PARTICLE = "|".join(PARTICLES)
PATTERNS = [
    ("email", re.compile(r"(?<![\w.+-])\w[\w.+-]*@[^\W_](?:[\w-]*\.)+[^\W\d_]{2,}", re.U)),
    ("ip", re.compile(rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d|\w)")),
    ("ip6", re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:])")),
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")),
    ("card", re.compile(r"(?<![\w.])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\2\d{4,5})(?!\w)")),
    ("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")),
    ("phone", re.compile(r"(?<![\w.+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,14}(?:[ .-]\d{1,4})*"
                         r"|(?:\(\d{2,4}\) ?|\d{2,4}[ .-])\d{3,4}[ .-]?\d{3,4}|0\d(?:([ .-])\d{2})(?:\1\d{2}){3})(?!\w)")),
    ("person", re.compile(rf"(?<!\w)({_TITLE})\.? ({_NAME})(?: ((?:(?:{_PARTICLE}) ){{0,3}}{_NAME}))?(?!\w)", re.U))]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def _iban_ok(text: str) -> bool:
    compact = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def canonical(kind: str, surface: str) -> str | None:
    """Canonical value of a mention, or None if it is no entity."""
    if kind == "email":
        return surface.lower()
    if kind == "ip":
        return surface
    if kind == "ip6":
        try:
            address = ipaddress.IPv6Address(surface)
        except ValueError:
            return None
        top = int(address) >> 112  # addresses in use: global, unique local, link local
        return address.exploded if 0x2000 <= top < 0x4000 or 0xFC00 <= top < 0xFE00 or 0xFE80 <= top < 0xFEC0 else None
    if kind == "iban":
        return surface.replace(" ", "") if _iban_ok(surface) else None
    if kind == "card":
        digits = _digits(surface)
        return digits if luhn(digits) or surface.isdigit() and len(digits) in (15, 16) and digits[0] in "3456" else None
    if kind == "phone":
        if not 7 <= len(_digits(surface)) <= 15 or surface[0] == "+" and len(_digits(surface)) < 8:
            return None
        country = re.match(r"\+\d{1,3}(?=\D)", surface)
        return f"{country[0] if country else ''}|{_digits(surface[country.end():] if country else surface)}"
    return _digits(surface)


def _named(word: str) -> bool:
    """Whether a word can be part of a name: a capital first, or a script without capitals."""
    return word[0].isupper() or word[0].lower() == word[0].upper()


def _phone(surface: str) -> str:
    """An international number without the groups beyond its length: 15 digits, 11 after +1."""
    most = 11 if surface.startswith("+1") else 15
    while surface[0] == "+" and len(_digits(surface)) > most and (cut := re.search(r"[ .-]\d+$", surface)):
        surface = surface[:cut.start()]
    return surface


class Mention(NamedTuple):
    """Where an entity stands.  ``part`` tells what of a name is written: all of it, or its given or family part."""
    start: int
    end: int
    kind: str
    value: str
    gender: str = ""
    part: str = ""


def _titled(text: str) -> list[tuple[int, int, str, list[str]]]:
    """(start of the name, end, gender of the title, words of the name) of the titled names; at most two words."""
    out = []
    for m in PATTERNS[-1][1].finditer(text):
        first, rest = m[2], m[3]
        if not _named(first):
            continue
        *between, last = rest.split(" ") if rest else [""]
        full = bool(rest) and _named(last) and (first[0].isupper() == last[0].isupper())
        out.append((m.start(2), m.end(3) if full else m.end(2), TITLES[m[1]], [first, " ".join([*between, last])] if full else [first]))
    return out


def _people(text: str) -> list[Mention]:
    """Titled names and, in the same text, their untitled and shorter mentions.

    A full name is an entity.  A family name alone belongs to the full name that fits its title's gender and was mentioned
    last before it (or else first after it), and is an entity of its own if there is none."""
    titled = _titled(text)
    if not titled:
        return []
    genders: dict[str, set[str]] = {}
    full: dict[str, list[tuple[int, str]]] = {}
    for at, _, gender, words_ in titled:
        if len(words_) == 2:
            value = " ".join(words_).casefold()
            genders.setdefault(value, set()).add(gender)
            full.setdefault(words_[1].casefold(), []).append((at, value))

    def own(family: str, at: int, gender: str) -> str:
        fits = [(p, v) for p, v in full.get(family, []) if gender == "n" or genders[v] <= {gender, "n"}]
        before = [v for p, v in fits if p <= at]
        return before[-1] if before else fits[0][1] if fits else family
    found: dict[int, tuple[int, str, str]] = {}
    for at, end, gender, words_ in titled:
        if len(words_) == 2:
            found[at] = end, " ".join(words_).casefold(), ""
        else:
            value = own(words_[0].casefold(), at, gender)
            genders.setdefault(value, set()).add(gender)
            found[at] = end, value, "family" if value in full.get(words_[0].casefold(), []) or " " in value else ""
    surfaces: dict[str, str] = {}
    for _, _, _, words_ in titled:
        for surface, part in [(" ".join(words_), ""), (words_[-1], "family")] + ([(words_[0], "given")] if len(words_) == 2 else []):
            if len(surface) > 2 or not surface.isascii():
                surfaces.setdefault(surface, part)
    taken = sorted((a, e[0]) for a, e in found.items())
    pattern = "|".join(map(re.escape, sorted(surfaces, key=len, reverse=True)))
    for m in re.finditer(rf"(?<![\w'’-])(?:{pattern})(?![\w-]|['’]\w\w)", text) if pattern else ():
        at, end = m.span()
        if any(a < end and at < b for a, b in taken[max(0, bisect_left(taken, (at, 0)) - 1):][:2]):
            continue
        part, word = surfaces[m[0]], m[0].casefold()
        if part == "":
            found[at] = end, word if word in genders or " " in word else own(word, at, "n"), ""
        elif part == "family":
            value = own(word, at, "n")
            found[at] = end, value, "family" if " " in value and value != word else ""
        else:
            owners = [(p, v) for own_ in full.values() for p, v in own_ if v.split(" ")[0] == word]
            before = [v for p, v in sorted(owners) if p <= at]
            found[at] = end, before[-1] if before else min(owners)[1], "given"
    out = []
    for at, (end, value, part) in sorted(found.items()):
        known = genders.get(value, set()) - {"n"}
        out.append(Mention(at, end, "person", value, known.pop() if len(known) == 1 else "n", part))
    return out


def find_entities(text: str) -> list[Mention]:
    """The mentions without overlaps, by position; earlier kinds take precedence."""
    found: list[Mention] = []
    numeric = re.search(r"\d{2}", text) is not None
    for kind, pattern in PATTERNS[:-1]:
        if kind == "email" and "@" not in text or kind == "ip6" and text.count(":") < 2 \
                or kind not in ("email", "ip6") and not numeric:
            continue
        free = text
        if kind == "phone":  # a number goes no further than the next entity
            ends = [0, *(a.end for a in found)]
            free = "".join(x for e, a in zip(ends, found) for x in (text[e:a.start], "\x00" * (a.end - a.start))) + text[ends[-1]:]
        for m in pattern.finditer(free):
            surface = _phone(m[0]) if kind == "phone" else m[0]
            value = canonical(kind, surface)
            if value is not None and not _overlaps(found, m.start(), m.start() + len(surface)):
                insort(found, Mention(m.start(), m.start() + len(surface), kind, value))
    for mention in _people(text):
        if not _overlaps(found, mention.start, mention.end):
            insort(found, mention)
    return found


def _overlaps(found: list[Mention], start: int, end: int) -> bool:
    k = bisect_left(found, (start,))
    return k < len(found) and found[k].start < end or k > 0 and found[k - 1].end > start


class Stream:
    """Numbers drawn from a keyed hash."""

    def __init__(self, key: bytes, *parts: str):
        self.key, self.parts, self.block, self.held = key, "\x1f".join(parts), 0, b""

    def below(self, n: int) -> int:
        if len(self.held) < 8:
            self.held += hashlib.blake2b(f"{self.parts}\x1f{self.block}".encode(), key=self.key).digest()
            self.block += 1
        value, self.held = int.from_bytes(self.held[:8], "big"), self.held[8:]
        return value % n

    def digit(self) -> str:
        return str(self.below(10))


def _script(text: str) -> str | None:
    """The name list for a text: Latin, Greek or Cyrillic; None for another script."""
    for c in text:
        if c.isalpha():
            return "greek" if "Ͱ" <= c <= "Ͽ" else "cyrillic" if "Ѐ" <= c <= "ӿ" else "latin" if c < "\u0250" or "Ḁ" <= c <= "ỿ" else None
    return "latin"


def _same_script(word: str, s: "Stream", more: int) -> str:
    """Letters of the word's own script, for scripts without a name list."""
    out = []
    for c in word + word[-1] * more if word else "":
        if not c.isalpha():
            out.append(c)
            continue
        near = [x for x in map(chr, range(ord(c) & ~31, (ord(c) | 31) + 1)) if x.isalpha() and x.lower() == x.upper()]
        out.append(near[s.below(len(near))] if near else c)
    return "".join(out)


def draw(kind: str, value: str, number: int, key: bytes, gender: str = "n") -> str:
    """Canonical surrogate of an entity; every few draws the format is a place wider."""
    s = Stream(key, kind, value, str(number))
    wider = number // DRAWS_PER_WIDTH
    more = "".join(s.digit() for _ in range(wider))
    if kind == "email":
        head, _, last = value.rpartition(".")
        letters = "".join(chr(97 + s.below(26)) for _ in range(wider))
        return letters + "".join(s.digit() if c.isdigit() else chr(97 + s.below(26)) if c.isalpha() else c for c in head) + "." + last
    if kind == "ip":
        octets = value.split(".")
        keep = 1 if octets[0] in ("10", "127") else 2 if octets[:2] == ["192", "168"] or octets[0] == "172" else 0
        fresh = octets[:max(0, keep - wider)] or [str(([*range(11, 127), *range(128, 172), *range(173, 192), *range(193, 224)])[s.below(210)])]
        return ".".join(fresh + [str(s.below(254) + 1) for _ in range(4 - len(fresh))])
    if kind == "ip6":
        first, *groups = value.split(":")
        filled = [k for k, g in enumerate(groups) if g == "0000"][-wider:] if wider else []
        return ":".join([first] + [f"{1 + s.below(65535):04x}" if g != "0000" or k in filled else g for k, g in enumerate(groups)])
    if kind == "iban":
        body = "".join(s.digit() if c.isdigit() else chr(65 + s.below(26)) for c in value[4:]) + more
        check = 98 - int("".join(str(int(c, 36)) for c in body + value[:2] + "00")) % 97
        return f"{value[:2]}{check:02d}{body}"
    if kind == "card":
        body = value[0] + "".join(s.digit() for _ in value[1:-1]) + more
        good = next(d for d in "0123456789" if luhn(body + d))
        return body + (good if luhn(value) else str((int(good) + 1 + s.below(9)) % 10))
    if kind == "phone":
        country, _, local = value.partition("|")
        return f"{country}|{1 + s.below(9)}" + "".join(s.digit() for _ in local[1:]) + more
    if kind == "ssn":
        return "".join(s.digit() for _ in value) + more
    first, _, rest = value.partition(" ")
    script = _script(value)
    if script is None:
        return " ".join(_same_script(w, s, wider) for w in ([first, rest] if rest else [first]))
    given = GIVEN[script, gender if gender != "n" else "mf"[s.below(2)]]
    syllables = SYLLABLES[script]
    family = "".join(syllables[s.below(len(syllables))] for _ in range(3 + wider))
    return f"{given[s.below(len(given))].casefold()} {family}" if rest else family


def _spread(surface: str, fresh: str, takes) -> str:
    """The characters of ``fresh`` in the places of ``surface`` that ``takes`` accepts; what is left follows the last of them."""
    out, k, last = [], 0, 0
    for c in surface:
        if takes(c):
            out.append(fresh[k:k + 1])
            k, last = k + 1, len(out)
        else:
            out.append(c)
    return "".join([*out[:last], fresh[k:], *out[last:]])


def render(mention: Mention, surface: str, surrogate: str) -> str:
    """The surrogate in the format of one mention: separators, case and the part of a name that is written."""
    kind = mention.kind
    if kind == "email":
        wider = len(surrogate) - len(surface)
        return "".join(n.upper() if o.isupper() else n for o, n in zip(surface[:1] * wider + surface, surrogate))
    if kind == "ip":
        return surrogate
    if kind == "ip6":
        address = ipaddress.IPv6Address(surrogate)
        text = address.compressed if "::" in surface else surrogate if len(surface) == 39 else \
            ":".join(f"{int(g, 16):x}" for g in surrogate.split(":"))
        return text.upper() if surface.upper() == surface and surface.lower() != surface else text
    if kind == "person":
        given, _, family = surrogate.partition(" ")
        name = surrogate if not mention.part or not family else given if mention.part == "given" else family
        return name.upper() if surface.isupper() else name.title()
    if kind == "iban":
        return _spread(surface, surrogate, str.isalnum)
    if kind == "phone":
        country, _, local = surrogate.partition("|")
        return country + _spread(surface[len(country):], local, str.isdigit)
    return _spread(surface, surrogate, str.isdigit)


ENTITY = "kind string, value string, gender string, number int, surrogate string"


def _extract(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = {(h, m.kind, m.value, m.gender) for h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                    for m in find_entities(t or "")}
            columns = list(zip(*sorted(rows))) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.string()) for c in columns[1:])],
                                             names=["text_hash", "kind", "value", "gender"])
    return run


def _draws(key: bytes):
    """Rows (kind, value, gender, number) with their surrogates."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, value, gender, number = (batch.column(k).to_pylist() for k in range(4))
            fresh = [draw(k, v, n, key, g) for k, v, g, n in zip(kind, value, gender, number)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(fresh, pa.string())],
                                             names=["kind", "value", "gender", "number", "surrogate"])
    return run


def resolve_clashes(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, gender, number, surrogate) of distinct entities (kind, value, gender), all surrogates different and none
    a real entity.

    Of several entities with one surrogate the one with the lowest draw number, then the smallest value,
    keeps it; a surrogate that is a real entity is kept by nobody.  The others are drawn again; as formats widen, every
    entity ends up with a surrogate of its own.
    """
    drawn = lambda rows: rows.select("kind", "value", "gender", "number").mapInArrow(_draws(key), ENTITY)
    real = entities.select("kind", F.col("value").alias("surrogate"), F.lit(True).alias("real"))
    now = stored(drawn(entities.withColumn("number", F.lit(0))))
    while True:
        best = now.groupBy("kind", "surrogate").agg(F.min(F.struct("number", "value")).alias("best"))
        judged = stored(now.join(best, ["kind", "surrogate"]).join(real, ["kind", "surrogate"], "left").select(
            "kind", "value", "gender", "number", "surrogate",
            (F.col("real").isNotNull() | (F.col("best") != F.struct("number", "value"))).alias("clash")))
        if judged.filter("clash").isEmpty():
            return judged.drop("clash")
        again = drawn(judged.filter("clash").withColumn("number", F.col("number") + 1))
        now = stored(judged.filter("NOT clash").drop("clash").unionByName(again))


def _replace(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts, counts = [], []
            moved = batch.column(2).to_pylist()
            for text, own in zip(batch.column(1).to_pylist(), moved):
                mentions = find_entities(text or "")
                special = {(m["kind"], m["value"]): m["surrogate"] for m in own or ()}
                out, at = [], 0
                for m in mentions:
                    fresh = special.get((m.kind, m.value)) or draw(m.kind, m.value, 0, key, m.gender)
                    out += [text[at:m.start], render(m, text[m.start:m.end], fresh)]
                    at = m.end
                texts.append("".join([*out, text[at:]]) if mentions else text)
                counts.append(len(mentions))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(texts, pa.string())],
                                             names=["id", "n_entities", "text"])
    return run


def replace_entities(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_entities, text with every entity replaced (null stays null).

    Kinds: e-mail addresses, IPv4 and IPv6 addresses, IBANs, card numbers, social security numbers, phone numbers and
    person names: titled ones, and in the same text their untitled and shorter mentions.  Names in scripts without capitals are
    found after a title, two words at most, and replaced by letters of their script; gender is matched where a name list exists.  The same
    key gives the same surrogates.  Ids may repeat or be null; equal texts get equal results.  Other columns are ignored.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    mentions = stored(rows.select(F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
        _extract(key), "text_hash long, kind string, value string, gender string"))
    # any title of a person tells the gender, in whatever text it stands; contradicting ones tell nothing
    told = F.array_sort(F.collect_set(F.when(F.col("gender").isin("m", "f"), F.col("gender"))))
    entities = stored(mentions.groupBy("kind", "value").agg(told.alias("told"))
                      .selectExpr("kind", "value", "CASE WHEN size(told) = 1 THEN told[0] ELSE 'n' END AS gender"))
    chosen = resolve_clashes(entities, key)
    # a text needs to be told what it cannot compute by itself: later draws, and genders learnt elsewhere
    special = stored(mentions.withColumnRenamed("gender", "local").join(chosen, ["kind", "value"])
                     .filter("number > 0 OR (kind = 'person' AND gender <> local)")
                     .groupBy("text_hash").agg(F.collect_set(F.struct("kind", "value", "surrogate")).alias("moved")))
    if special.isEmpty():
        ready = rows.withColumn("moved", F.lit(None).cast(special.schema["moved"].dataType))
    else:  # copies of one text are dealt to several tasks
        salted = special.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        ready = (rows.withColumn("text_hash", F.xxhash64("text")).withColumn("salt", F.expr(f"int(pmod(xxhash64(id), {SALTS}))"))
                 .join(salted, ["text_hash", "salt"], "left").select("id", "text", "moved"))
    return ready.mapInArrow(_replace(key), "id long, n_entities long, text string").withColumnRenamed("id", id_col)
