"""PII surrogates: detected entities get keyed replacements of their own type, gender, script and format.

An entity's canonical form (the digits of a number, an address in lower case,
a name part) is replaced by a keyed digest of it, so the same entity has the
same surrogate in every document, and each occurrence is written in the form
it was found in. A given name that is announced now as a man's, now as a
woman's has one gender in the whole corpus, that of most occurrences.
Surrogates of all entities of the corpus are checked against one another and
against all originals, names of every kind together; where two meet or a
surrogate is itself an original, one draws again, until none do. What drew
more than once or has another gender is told to the documents as a table of
(kind, entity, kind it counts as, number of the draw).

Names keep their script if it is listed in ``_SCRIPTS``; names of other
scripts are written in Latin letters.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.llm.common import fresh, parts, utf8, with_columns
from riskframe.session import materialise

KEY = b"change this key"
#: Rows of the table of repeated draws that are broadcast (about 100 bytes each); a larger one is joined by document.
REDRAWN = 200_000

# ---------------------------------------------------------------- detection
_EMAIL = re.compile(r"[\w.%+\-]+@[\w\-]+(?:\.[\w\-]+)+")
_SECRET = re.compile(r"(?i)\b(?:token|api[_-]?key|secret|password|passwd|access[_-]?key)\b\s*[:=]\s*[\"']?([\w\-+/=.]{8,})")
_KEY_ID = re.compile(r"\b(?:AKIA[0-9A-Z]{16}|ghp_\w{20,}|sk-[A-Za-z0-9]{20,})\b")
_IBAN = re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b")
_IP = re.compile(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d)")
_CARD = re.compile(r"(?<![\w+-])(?:\d{13,19}|(\d{4}([ -]))(?:\d{4}\2){2}\d{1,7}|\d{4}([ -])\d{6}\3\d{5})(?![\w])")
_SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")
_PHONE = re.compile(r"(?<![\w])(?:\+\d{1,3}[\s.-]?)?(?:\(\d{2,4}\)[\s.-]?|\d{2,4}[\s.-])\d{3,4}[\s.-]\d{3,4}(?![\w])|(?<![\w])\+\d{7,15}(?!\w)")
_DIGIT = re.compile(r"\d")

# Titles that announce a person, by gender.
_TITLES = {
    "m": "Mr Herr Monsieur M Señor Sr Signor Senhor господин г-н κύριος κ",
    "f": "Mrs Ms Miss Frau Madame Mme Mlle Señora Señorita Sra Srta Signora Senhora госпожа г-жа κυρία",
    "n": "Dr Prof",
}
_GENDER = {t: g for g, ts in _TITLES.items() for t in ts.split()}
_UPPER_WORD = r"[^\W\d_a-zà-öø-ÿа-яёα-ωά-ώ][\w'’-]*"
#: Titles that are words of other meaning unless a full stop follows, and what follows a title that announces no person.
_SHORT = ("M", "κ")
_ROLES = frozenset(
    "Developer Engineer Manager Director Analyst Architect Designer Scientist Consultant Associate Editor Officer Advisor Administrator "
    "Street Avenue Road Lane".split()
)
_NAME = re.compile(
    rf"(?<!\w)((?:{'|'.join(sorted((re.escape(t) for t in _GENDER if t not in _SHORT), key=len, reverse=True))})\.?|(?:{'|'.join(_SHORT)})\.)"
    rf"[  ]({_UPPER_WORD}(?: {_UPPER_WORD}){{0,2}})"
)
_HINT = re.compile("|".join(rf"\b{re.escape(t)}\b" for t in sorted(_GENDER, key=len, reverse=True)))


def luhn(digits: list[int]) -> bool:
    total = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(str(unicodedata.digit(c)) for c in text if c.isdigit() and unicodedata.digit(c, None) is not None)


def script(word: str) -> str:
    first = next((c for c in word if c.isalpha()), "a")
    name = unicodedata.name(first, "LATIN").split(" ")[0].lower()
    return name if name in _CONSONANTS or name in _SCRIPTS else "latin"


def _numbers(text: str) -> Iterator[tuple[int, int, str, str]]:
    for m in _IBAN.finditer(text):
        yield m.start(), m.end(), "iban", m.group().replace(" ", "")
    for m in _IP.finditer(text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            yield m.start(), m.end(), "ip", ".".join(str(int(x)) for x in m.group().split("."))
    for kind, pattern in (("card", _CARD), ("ssn", _SSN), ("phone", _PHONE)):
        for m in pattern.finditer(text):
            yield m.start(), m.end(), kind, digits_of(m.group())


def _names(text: str) -> Iterator[tuple[int, int, str, str]]:
    """Name parts after a title, and the same parts where they stand alone in the text."""
    known: dict[str, str] = {}
    for m in _NAME.finditer(text):
        gender, at = _GENDER[m.group(1).removesuffix(".")], m.start(2)
        parts = m.group(2).split(" ")
        stop = next((i for i, part in enumerate(parts) if part[0].islower() or part in _ROLES), len(parts))
        parts = parts[:stop]
        for i, part in enumerate(parts):
            if i + 1 == len(parts):
                kind = f"surname:{script(part)}"
            else:
                sex = gender if gender != "n" else "f" if part[-1:].lower() in "aаα" else "m"
                kind = f"given-{sex}:{script(part)}"
            yield at, at + len(part), kind, part.casefold()
            at += len(part) + 1
            if len(part) > 2:
                known.setdefault(part, kind)
    if known:
        for m in re.finditer(rf"(?<!\w)(?:{'|'.join(sorted(map(re.escape, known), key=len, reverse=True))})(?!\w)", text):
            yield m.start(), m.end(), known[m.group()], m.group().casefold()


def _filled(value: str) -> bool:
    """Whether a value says anything: the blank of a form has neither letter nor digit."""
    return any(c.isalnum() for c in value)


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical form) of the entities in a text, in order, none overlapping.

    Of overlapping finds the kind that comes first here stands: address,
    secret, account, IP address, card, social security number, phone, name.
    Secrets, and addresses up to their last label, have a letter or digit:
    blanks to be filled in are left alone.
    """
    found: list[tuple[int, int, str, str]] = []
    if "@" in text:
        found += [(m.start(), m.end(), "email", m.group().lower()) for m in _EMAIL.finditer(text) if _filled(m.group().rpartition(".")[0])]
    if "=" in text or ":" in text:
        found += [(m.start(1), m.end(1), "secret", m.group(1)) for m in _SECRET.finditer(text) if _filled(m.group(1))]
    if _DIGIT.search(text):
        found += [(m.start(), m.end(), "secret", m.group()) for m in _KEY_ID.finditer(text)]
        found += _numbers(text)
    if _HINT.search(text):
        found += _names(text)
    out: list[tuple[int, int, str, str]] = []
    taken: list[tuple[int, int]] = []
    for f in found:
        if f[1] > f[0] and all(f[1] <= a or f[0] >= b for a, b in taken):
            taken.append((f[0], f[1]))
            out.append(f)
    return sorted(out)


# ---------------------------------------------------------------- surrogates
_CONSONANTS = {"latin": "bdfgklmnprstvz", "cyrillic": "бвгдзклмнпрстф", "greek": "βγδζθκλμνπρστφ"}
_VOWELS = {"latin": "aeiou", "cyrillic": "аеиоу", "greek": "αεηιο"}
_ENDINGS = {
    ("f", "latin"): "a", ("f", "cyrillic"): "а", ("f", "greek"): "α",
    ("m", "latin"): "nrsd", ("m", "cyrillic"): "нрсд", ("m", "greek"): "ς",
}


#: Scripts without case whose names are written in letters of a range: first and last letter, letters of a name part.
_SCRIPTS = {
    "arabic": ("ب", "غ", 5), "hebrew": ("א", "ת", 5), "cjk": ("一", "龥", 2), "hangul": ("가", "힣", 2), "hiragana": ("か", "と", 4),
    "katakana": ("カ", "ト", 4), "devanagari": ("क", "ह", 4), "thai": ("ก", "ฮ", 5),
}


class Stream:
    """Numbers drawn from the keyed digest of (kind, entity, draw)."""

    def __init__(self, key: bytes, kind: str, entity: str, draw: int):
        self.seed = hmac.new(key, f"{kind}\x1f{entity}\x1f{draw}".encode("utf-8", "surrogatepass"), hashlib.sha256).digest()
        self.block, self.pool = 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool += hashlib.sha256(self.seed + self.block.to_bytes(8, "big")).digest()
            self.block += 1
        value, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return value % n

    def pick(self, letters: str) -> str:
        return letters[self.below(len(letters))]


_HEX = set("0123456789abcdef")
#: After so many draws a surrogate may differ in form (longer, another private range), so that no set of entities uses up its values.
WIDER = 8
#: After so many draws originals are no longer avoided.
LAST = 40


def _swap(s: Stream, text: str, hexes: bool = False) -> str:
    """Each letter and digit by another of its class; everything else stays."""
    out = []
    for c in text:
        if c.isdigit():
            out.append(str(s.below(10)))
        elif hexes and c.lower() in _HEX:
            out.append(s.pick("abcdef"))
        elif c.isalpha():
            out.append(s.pick("abcdefghijklmnopqrstuvwxyz"))
        elif c.isnumeric():
            out.append(str(s.below(10)))
        else:
            out.append(c)
    return "".join(x.upper() if c.isupper() else x for x, c in zip(out, text))


def surrogate(key: bytes, kind: str, entity: str, draw: int = 0) -> str:
    """The canonical surrogate of a canonical entity."""
    s = Stream(key, kind, entity, draw)
    wider = draw // WIDER
    if kind == "email":
        local, _, domain = entity.partition("@")
        labels = domain.split(".")
        # Labels of a domain are keyed by themselves, so addresses that share one still do, but for those that meet again and again.
        host = [_swap(Stream(key, "domain", x, wider), x) for x in labels[:-1]]
        name = _swap(s, local if _filled(local) else "x" * len(local))
        return f"{name}{_swap(s, 'x' * wider)}@{'.'.join([*host, labels[-1]])}"
    if kind == "ip":
        a, b, *_ = map(int, entity.split("."))
        fixed = [10] if a == 10 or (a, b) == (192, 168) and wider else [192, 168] if (a, b) == (192, 168) else [127] if a == 127 else []
        rest = [str(1 + s.below(223 if i == 0 and not fixed else 254)) for i in range(4 - len(fixed))]
        return ".".join([*map(str, fixed), *rest])
    if kind == "card":
        new = [int(entity[0]), *(s.below(10) for _ in entity[1:])]
        if luhn([int(c) for c in entity]):
            new[-1] = next(d for d in range(10) if luhn([*new[:-1], d]))
        return "".join(map(str, new))
    if kind == "phone":
        keep = 1 if len(entity) == 11 and entity[0] == "1" else 2 if len(entity) > 11 else 0
        return entity[:keep] + "".join(str(s.below(10)) for _ in entity[keep:])
    if kind == "ssn" and wider:  # beyond the areas that are never given out
        return f"{s.below(1000):03d}{s.below(100):02d}{s.below(10_000):04d}"
    if kind == "ssn":
        return f"{900 + s.below(100):03d}{1 + s.below(99):02d}{1 + s.below(9999):04d}"
    if kind == "iban":
        body = _swap(s, entity[4:])
        number = int("".join(str(int(c, 36)) for c in body + entity[:2] + "00"))
        return f"{entity[:2]}{98 - number % 97:02d}{body}"
    if kind == "secret":
        hexes = set(entity.lower()) <= _HEX
        return _swap(s, entity, hexes) + _swap(s, ("a" if hexes else "x") * wider, hexes)
    role, _, alphabet = kind.partition(":")
    if alphabet in _SCRIPTS:
        low, high, size = _SCRIPTS[alphabet]
        return "".join(chr(ord(low) + s.below(ord(high) - ord(low) + 1)) for _ in range(size + wider))
    word = "".join(s.pick(_CONSONANTS[alphabet]) + s.pick(_VOWELS[alphabet]) for _ in range(2 + s.below(2) + wider))
    sex = role.rpartition("-")[2]
    if sex == "m":
        return word + s.pick(_ENDINGS["m", alphabet])
    return word[:-1] + _ENDINGS["f", alphabet] if sex == "f" else word + s.pick(_CONSONANTS[alphabet].replace("ς", "ν"))


def written(new: str, kind: str, found: str) -> str:
    """A canonical surrogate in the form of an occurrence: its separators, digits, case."""
    if kind in ("card", "phone", "ssn"):
        values = iter(new)
        return "".join(chr(ord(c) - unicodedata.digit(c) + int(next(values))) if unicodedata.digit(c, None) is not None and c.isdigit() else c for c in found)
    if kind == "iban":
        values = iter(new)
        return "".join(c if c == " " else next(values) for c in found)
    if kind == "email":
        return new.upper() if found.isupper() else new
    if ":" in kind:
        return new.upper() if len(found) > 1 and found.isupper() else new[:1].upper() + new[1:]
    return new


def replace(text: str, key: bytes, draws: dict[tuple[str, str], tuple[str, int]]) -> tuple[str, list[str]]:
    """The text with surrogates, and the kinds replaced. ``draws``: the kind that an entity counts as, and its draw."""
    out, at, kinds = [], 0, []
    for start, end, kind, entity in detect(text):
        as_kind, draw = draws.get((kind, entity), (kind, 0))
        new = surrogate(key, as_kind, entity, draw)
        out += [text[at:start], written(new, kind, text[start:end])]
        at = end
        kinds.append(kind.partition(":")[0])
    return "".join([*out, text[at:]]), kinds


# ---------------------------------------------------------------- over the corpus
def entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """(kind, entity, n): the distinct entities of all texts and in how many they stand, added up in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            seen = Counter(e for raw in utf8(b.column(0)) if raw for e in {f[2:] for f in detect(raw.decode())})
            columns = [pa.array([k for k, _ in seen], pa.string()), pa.array([e for _, e in seen], pa.string()), pa.array(list(seen.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["kind", "entity", "n"])

    found = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "kind string, entity string, n long")
    return found.groupBy("kind", "entity").agg(F.sum("n").alias("n"))


def counted_as(found: DataFrame) -> DataFrame:
    """``found`` (kind, entity, n) with ``as_kind``: given names have the gender that most of their texts give them, a woman's among equals."""
    given = F.col("kind").startswith("given-")
    same = F.when(given, F.concat(F.lit("given:"), F.substring_index("kind", ":", -1))).otherwise(F.col("kind"))
    named = found.withColumn("same", same)
    chosen = named.groupBy("same", "entity").agg(F.min(F.struct((-F.col("n")).alias("less"), "kind")).alias("most"))
    return named.join(chosen, ["same", "entity"]).select("kind", "entity", F.col("most.kind").alias("as_kind"))


def settle(found: DataFrame, key: bytes = KEY) -> DataFrame:
    """(kind, entity, as_kind, draw) of the entities that count as another kind or may not keep their first surrogate.

    Of entities that drew the same surrogate the one with the fewest draws
    keeps it, then the smallest; the others and those whose surrogate is an
    original draw again, against all that stand, until all are distinct. Names
    are compared as words, whatever their kind. After ``LAST`` draws an
    original of the corpus may be a surrogate of another entity, so that a
    kind whose values are nearly all in use settles, too.
    """

    def drawn(*columns: pa.Array) -> list[pa.Array]:
        return [pa.array([surrogate(key, *row) for row in zip(*(c.to_pylist() for c in columns))], pa.string())]

    def with_surrogate(df: DataFrame) -> DataFrame:
        return with_columns(df, ["kind", "entity", "draw"], [T.StructField("new", T.StringType())], drawn)

    told = materialise(counted_as(materialise(found)))
    family = F.when(F.col("kind").contains(":"), "name").otherwise(F.col("kind"))
    now = told.select(F.col("as_kind").alias("kind"), "entity").distinct().withColumns({"family": family, "draw": F.lit(0)})
    now = materialise(with_surrogate(now))
    originals = now.select("family", F.col("entity").alias("new")).distinct()
    while True:
        first = now.groupBy("family", "new").agg(F.min(F.struct("draw", "entity", "kind")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
        met = now.join(first, ["family", "new"]).where("struct(draw, entity, kind) <> first").select("kind", "entity")
        real = now.where(F.col("draw") < LAST).join(originals, ["family", "new"], "left_semi").select("kind", "entity")
        again = materialise(met.union(real).distinct())
        if again.isEmpty():
            settled = now.select(F.col("kind").alias("as_kind"), "entity", "draw")
            return told.join(settled, ["as_kind", "entity"]).where("draw > 0 OR kind <> as_kind").select("kind", "entity", "as_kind", "draw")
        rest = now.join(again, ["kind", "entity"], "left_anti")
        more = now.join(again, ["kind", "entity"], "left_semi").withColumn("draw", F.col("draw") + 1).drop("new")
        now = materialise(rest.union(with_surrogate(more).select(*rest.columns)))


def pseudonymised(docs: DataFrame, text: str = "text", key: bytes = KEY, id_col: str = "doc_id", limit: int = REDRAWN) -> DataFrame:
    """``docs`` with its text replaced and ``pii_kinds``: the kinds replaced, in order.

    Null texts stay null with no kinds, empty ones empty; a table without
    entities comes back as it is. Text between entities is not touched.
    """
    redrawn = materialise(settle(entities(docs, text), key))
    new, kinds, told, row = fresh(docs, "new_text", "pii_kinds", "draws_", "row_")
    fields = [T.StructField(new, T.StringType()), T.StructField(kinds, T.ArrayType(T.StringType()))]
    if redrawn.count() <= limit:
        share = docs.sparkSession.sparkContext.broadcast({(r.kind, r.entity): (r.as_kind, r.draw) for r in redrawn.collect()})

        def run(column: pa.Array) -> list[pa.Array]:
            return _replaced(column, [share.value] * len(column), key)

        out = with_columns(docs, [text], fields, run)
    else:
        # By id and text: never null, and rows that meet by chance only learn of each other's draws.
        keyed = docs.withColumn(row, F.xxhash64(F.col(id_col), F.col(text).cast("string")))
        told_rows = _told(keyed, redrawn, text, row, told)

        def run_told(column: pa.Array, draws: pa.Array) -> list[pa.Array]:
            return _replaced(column, [{(d["kind"], d["entity"]): (d["as_kind"], d["draw"]) for d in ds or []} for ds in draws.to_pylist()], key)

        out = with_columns(keyed.join(told_rows, row, "left"), [text, told], fields, run_told)
    columns = [F.col(new).alias(c) if c == text else F.col(c) for c in docs.columns]
    return out.select(*columns, kinds)


def _told(docs: DataFrame, redrawn: DataFrame, text: str, row: str, name: str) -> DataFrame:
    """Per key ``row`` the draws of the entities of its texts."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            rows = [(i, k, e) for i, raw in enumerate(utf8(b.column(1))) if raw for k, e in {f[2:] for f in detect(raw.decode())}]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array([r[0] for r in rows], pa.int64())), *(pa.array([r[c] for r in rows], pa.string()) for c in (1, 2))],
                names=["id_", "kind", "entity"],
            )

    pairs = docs.select(F.col(row).alias("id_"), F.col(text).cast("string")).mapInArrow(own, "id_ long, kind string, entity string").distinct()
    return pairs.join(redrawn, ["kind", "entity"]).groupBy(F.col("id_").alias(row)).agg(F.collect_list(F.struct("kind", "entity", "as_kind", "draw")).alias(name))


def _replaced(column: pa.Array, draws: list[dict], key: bytes) -> list[pa.Array]:
    texts, kinds = [], []
    for raw, own in zip(utf8(column), draws):
        done = replace(raw.decode(), key, own) if raw is not None else (None, [])
        texts.append(done[0])
        kinds.append(done[1])
    return [pa.array(texts, pa.string()), pa.array(kinds, pa.list_(pa.string()))]
