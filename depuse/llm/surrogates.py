"""PII: detected entities receive keyed surrogates of their own kind.

Detected: e-mail addresses, IPv4 addresses, phone numbers, card and account
numbers (13 to 19 digits), quoted or assigned secrets (hex or token-like), and
person names.  A name begins at a title, at a known given name or beside a
known surname (the lists below), and runs over all capitalised words, initials,
particles and hyphens after it, parted by any white space without an empty line;
common words of sentence beginnings end it.  A whole name goes on over a line
break only at a known surname.  Its last word is the surname.  Names of which no
word is listed and that no title precedes are not found.  Every entity gets a surrogate drawn by HMAC-SHA256 from the secret key, its kind and
its canonical form, so one entity has one surrogate everywhere (coreference):

* numbers keep their grouping, length, leading country code and, where the
  original has it, a valid Luhn digit; IPv4 stays private or public;
* secrets keep length, alphabet and case; e-mails the shape of the local part
  and a reserved domain;
* names keep gender, script, case and parts (each word of the name is replaced;
  initials, particles and white space stay); a bare surname later in the same
  document follows its full name.

Collision check: all distinct entities of the corpus are drawn together.  Two
entities with one surrogate, or a surrogate that is itself an entity of the
corpus, are drawn again with the next attempt number (the smallest entity keeps
its draw) until all differ.  IPv4 addresses and phone numbers still open after
``MAX_ATTEMPTS`` draws get the first values left in a keyed order of their whole
space; where fewer are left than needed, values that other entities of the corpus
have are used too, each once.  Only the entities beyond their first draw
(usually none) have to be looked up; the others are drawn in place.

Defined results: null and empty texts stay; text outside entities stays byte
for byte.  Whole texts are searched; repeated rows are treated alike; an empty
table gives no rows.  Columns named like the result's (``n_entities``) are
replaced.  Overlapping candidates: the earliest, then the longest, counts.
"""

from __future__ import annotations

import hashlib
import hmac
import math
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from depuse.llm.longs import as_longs, as_text, fields
from depuse.llm.staging import small_batches, stage
from depuse.operators.topn import free_name

KEY = b"replace this key in production"
MAX_ATTEMPTS = 64
# Overrides up to this many texts are broadcast; more are joined by shuffle.
BROADCAST_TEXTS = 20_000

# Given names by gender and script, surnames and titles.  They
# serve detection and replacement; MORE_GIVEN and MORE_SURNAMES detection only.
GIVEN = {
    ("latin", "f"): "Alice Anna Carmen Claire Elena Emma Eva Greta Hannah Ingrid Isabel Julia Laura Lucia Maria Marie Nora Olivia Sarah Sophie".split(),
    ("latin", "m"): "Adam Anton Carlos David Diego Emil Felix Hans Henri James John Jorge Karl Louis Lukas Martin Michael Paul Peter Thomas".split(),
    ("cyrillic", "f"): "Анна Вера Дарья Елена Ирина Мария Наталья Ольга Светлана Татьяна".split(),
    ("cyrillic", "m"): "Алексей Антон Борис Виктор Дмитрий Иван Михаил Николай Павел Сергей".split(),
}
SURNAMES = {
    "latin": "Adler Becker Blanc Castro Dupont Fischer Garcia Harris Keller Lambert Lopez Martin Meyer Moreau Navarro Novak Parker Smith Torres Walker Weber Young".split(),
    ("cyrillic", "m"): "Антонов Белов Волков Громов Егоров Зайцев Иванов Козлов Лебедев Морозов Орлов Павлов Соколов Титов".split(),
    ("cyrillic", "f"): "Антонова Белова Волкова Громова Егорова Зайцева Иванова Козлова Лебедева Морозова Орлова Павлова Соколова Титова".split(),
}
MORE_GIVEN = {
    ("latin", "f"): "Abigail Agnes Aisha Alexandra Alicia Amanda Amelia Amy Ana Andrea Angela Anita Anne Annie Antonia Barbara Beatrice Beatriz Betty Brenda Camila Camille Carla Carol Caroline Catherine Cecilia Charlotte Chiara Christina Christine Clara Claudia Cynthia Daniela Deborah Denise Diana Donna Dorothy Eleanor Elisabeth Elizabeth Ellen Emily Esther Eva Fatima Fiona Francesca Gabriela Giulia Gloria Heather Heidi Helen Helena Inga Irene Isabella Jacqueline Jane Janet Jasmine Jennifer Jessica Joan Johanna Josephine Joyce Judith Judy Julie Karen Katarina Katherine Kathleen Katja Kimberly Kristin Laila Leila Lena Linda Lisa Louise Lucy Magdalena Margaret Margarita Maria Martha Mary Mei Melissa Mia Michelle Monica Nadia Nancy Natalia Natalie Nicole Nina Pamela Patricia Paula Petra Pilar Priya Rachel Rebecca Rosa Ruth Samantha Sandra Sara Sharon Silvia Simone Sofia Sonia Stephanie Susan Susanne Svetlana Teresa Theresa Ursula Valentina Valerie Vera Veronica Victoria Yuki Yvonne".split(),
    ("latin", "m"): "Aaron Abdul Abraham Ahmed Alan Albert Alejandro Alessandro Alexander Alfred Ali Andre Andreas Andrew Angelo Anthony Antonio Arthur Benjamin Bernard Bernd Brian Bruno Charles Christian Christopher Daniel Dennis Dieter Dmitri Donald Douglas Edward Edwin Enrique Eric Ernst Eugene Fabian Fernando Francesco Francis Francisco Frank Franz Fred Frederick Friedrich Gabriel Gary George Gerald Gerhard Giovanni Giuseppe Gregory Guillermo Gustav Hamid Harold Harry Hassan Heinrich Henry Herbert Hiroshi Howard Hugo Ibrahim Igor Ivan Jack Jacob Jan Jason Javier Jean Jeffrey Jerry Joachim Joe Johann Johannes Jonas Jonathan Jose José Joseph Joshua Juan Jürgen Kenneth Kevin Klaus Kurt Larry Lars Lawrence Leon Leonard Luca Luigi Luis Manuel Marc Marco Mario Mark Markus Matthew Matthias Max Miguel Mohammed Muhammad Nicholas Nicolas Olaf Oliver Omar Oscar Otto Pablo Patrick Pavel Pedro Philip Philippe Pierre Rafael Rahul Raj Ralph Ramon Raymond Ricardo Richard Robert Roberto Roger Roland Ronald Rudolf Ryan Samuel Scott Sebastian Sergei Sergio Simon Stefan Stephen Steven Sven Theodor Timothy Tobias Tom Tomas Umberto Viktor Vincent Vladimir Walter Werner William Wolfgang Xavier Yusuf".split(),
    ("cyrillic", "f"): "Александра Алина Алла Анастасия Валентина Виктория Галина Екатерина Евгения Зоя Ксения Лариса Лидия Любовь Людмила Маргарита Марина Надежда Нина Оксана Полина Раиса София Тамара Юлия".split(),
    ("cyrillic", "m"): "Александр Анатолий Андрей Аркадий Артём Валерий Василий Виталий Владимир Вячеслав Геннадий Георгий Григорий Денис Евгений Егор Игорь Илья Кирилл Константин Лев Леонид Максим Никита Олег Пётр Роман Степан Фёдор Юрий Яков".split(),
}
MORE_SURNAMES = "Adams Allen Alvarez Anderson Andersen Bauer Bennett Bernard Bianchi Campbell Carlson Chavez Chen Collins Cooper Davies Davis Diaz Edwards Evans Fernandez Ferrari Flores Foster Garcia Gomez Gonzalez Gupta Gutierrez Hansen Hernandez Hoffmann Hughes Ivanov Jackson Jansen Jensen Jimenez Johansson Johnson Jones Khan Kim Klein Kowalski Kumar Larsen Lee Lefebvre Lewis Li Liu Martinez McDonald Mendez Miller Mitchell Moore Morales Morgan Morris Müller Murphy Nakamura Nelson Nguyen Nielsen O'Brien O'Connor Olsen Ortiz Patel Perez Petersen Peterson Petrov Phillips Popov Ramirez Reyes Richardson Rivera Roberts Robinson Rodriguez Romero Rossi Ruiz Russo Sanchez Santos Sato Schmidt Schneider Schulz Schwarz Sharma Silva Simmons Singh Stewart Suzuki Tanaka Taylor Thompson Wagner Wang Watson Weiss Williams Wilson Wright Zhang Zimmermann Кузнецов Кузнецова Новиков Новикова Петров Петрова Попов Попова Сидоров Сидорова Смирнов Смирнова Фёдоров Фёдорова".split()
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Señor": "m", "Señora": "f"}
PARTICLES = "von van der den de del della di da das dos do du la le el al ter ten zu zum zur af av bin ibn".split()
# Capitalised words that are no part of a name
NO_NAMES = frozenset(
    "A After All Also Although An And Are As At Because Before But By Can Dear Did Do For From Had Has He Her Here His How However I If In Is It Its "
    "Let May My No Not Now Of On One Or Our She Since So That The Their Then There These They This Those Thus To Under Until Was We Were What When "
    "Where Which While Who Why Will With You Your Yes January February March April June July August September October November December Monday "
    "Tuesday Wednesday Thursday Friday Saturday Sunday Der Die Das Und Er Sie Es Ein Eine Le La Les Et Il Elle Un Une El Los Las Y В И На Он Она Они "
    "Это Но Не По С К У О А Я Мы Вы Что Как Когда".split()
)
SYLLABLES = "ba be bi bo da de di do fa fe ka ke ki ko la le li lo ma me mi mo na ne ni no ra re ri ro sa se si so ta te ti to va ve".split()

_GENDER = {name: kind for lists in (MORE_GIVEN, GIVEN) for kind, names in lists.items() for name in names}
_FAMILIES = {*MORE_SURNAMES, *(name for names in SURNAMES.values() for name in names)}
_CAPITAL = r"[A-ZÀ-ÖØ-ÞА-ЯЁ]"
_NAMED = rf"{_CAPITAL}[^\W\d_]+"
NUMBERS = re.compile(
    r"(?P<email>[\w.+-]*[\w+-]@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"
    r"|(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d))"
    r"|(?P<card>(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-]))"
    r"|(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?\d{3,4}|\d{3}[ .-]\d{3,4})[ .-]?\d{4}(?!\w)"
    r"|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\w))"
    r"|(?P<secret>(?<=[\"'=:])(?=[A-Za-z_-]*\d)[A-Za-z0-9_-]{20,}(?=[\"'\s]|$)|(?<!\w)(?=[a-fA-F]*\d)[0-9a-fA-F]{32,}(?!\w))"
)
_SPACE = r"(?:[^\S\n]+(?:\n[^\S\n]*)?|\n[^\S\n]*)"
_WORD = rf"(?:{_CAPITAL}['’])?{_NAMED}(?:[-‐'’]{_NAMED})*(?!\w)"
_TITLE = rf"(?:{'|'.join(TITLES)})(?!\w)"
_UNIT = rf"(?:(?:{_CAPITAL}\.)+|{_TITLE}\.?|{_WORD})"
# Neighbouring capitalised words, initials and titles, and their parts
NAMES = re.compile(rf"(?<!\w){_UNIT}(?:{_SPACE}(?:(?:{'|'.join(PARTICLES)}){_SPACE})*{_UNIT})*")
_PARTS = re.compile(rf"(?<!\w)(?:(?P<initial>(?:{_CAPITAL}\.)+)|(?P<title>{_TITLE})\.?|(?P<word>{_WORD}))")
# A text that these do not find has no e-mail or number, or no name: the full
# patterns are not tried on it.
_SOME_NUMBER = re.compile(r"[@0-9]")
_SOME_WORD = re.compile(rf"{_CAPITAL}[^\W\d_]+")
_KNOWN = frozenset(
    part for name in [*_GENDER, *_FAMILIES, *TITLES] for part in _SOME_WORD.findall(name) + _SOME_WORD.findall(name.upper())
)


def _spelt(word: str) -> str:
    return word.title() if word.isupper() else word


def _given(part: re.Match) -> tuple | None:
    """(script, gender) of a known given name; a double name goes by its first."""
    return _GENDER.get(_spelt(re.split("[-‐]", part.group())[0])) if part.lastgroup == "word" else None


def _family(part: re.Match) -> bool:
    return part.lastgroup == "word" and any(w in _FAMILIES for w in (_spelt(part.group()), *re.split("[-‐]", _spelt(part.group()))))


def name_parts(parts: Sequence[re.Match]) -> tuple | None:
    """(given names, surname, script, gender) of the parts of one name."""
    words = [p for p in parts if p.lastgroup == "word"]
    if not words:
        return None
    *given, last = words
    known = next((g for g in map(_given, given) if g), None)
    titles = [TITLES[p["title"]] for p in parts if p.lastgroup == "title"]
    if known:
        return given, last, *known
    script = "cyrillic" if re.match("[А-ЯЁ]", last.group()) else "latin"
    ending = (last if script == "cyrillic" else words[0]).group().lower()[-1]
    return given, last, script, titles[0] if titles else "f" if ending in "aая" else "m"


def _name_form(found: tuple) -> str:
    given, last, script, gender = found
    return f"{script}|{gender}|{' '.join(g.group() for g in given).lower()}|{last.group().lower()}"


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(begin, end, kind, canonical form) in text order, without overlaps."""
    out = _numbers(text) if _SOME_NUMBER.search(text) else []
    if not _KNOWN.isdisjoint(_SOME_WORD.findall(text)):
        out += _names(text)
    kept, last = [], 0
    for e in sorted(out, key=lambda e: (e[0], -e[1])):
        if e[0] >= last:
            kept.append(e)
            last = e[1]
    return kept


def _numbers(text: str) -> list[tuple[int, int, str, str]]:
    out = []
    for m in NUMBERS.finditer(text):
        kind, form = m.lastgroup, m.group()
        if kind in ("card", "phone"):
            form = re.sub(r"\D", "", form)
        elif kind == "email":
            form = form.lower()
        out.append((m.start(), m.end(), kind, form))
    return out


def _begin(parts: Sequence[re.Match]) -> int | None:
    """Where the name among neighbouring parts begins, if there is one."""
    words = [k for k, p in enumerate(parts) if p.lastgroup == "word"]
    for k, part in enumerate(parts):
        if part.lastgroup == "title" and words and k < words[-1]:
            return k
        if _given(part) and k < words[-1]:
            return k - 1 if k and _family(parts[k - 1]) else k
        if k and _family(part):
            return 0 if len(words) <= 3 else k - 1
    return None


def _segments(text: str, run: re.Match) -> Iterator[list[re.Match]]:
    """The parts of a run of capitalised words, parted where a name ends."""
    segment: list[re.Match] = []
    for part in _PARTS.finditer(text, run.start(), run.end()):
        if part.lastgroup == "word" and _spelt(part.group()) in NO_NAMES:
            yield segment
            segment = []
            continue
        broken = bool(segment) and "\n" in text[segment[-1].end():part.start()]
        whole = sum(p.lastgroup == "word" for p in segment) >= 2 and not _family(part)
        if part.lastgroup == "title" or broken and whole:
            yield segment
            segment = []
        segment.append(part)
    yield segment


def _names(text: str) -> list[tuple[int, int, str, str]]:
    out = []
    surnames: dict[str, str] = {}  # bare surnames follow the full name met before
    for run in NAMES.finditer(text):
        for parts in _segments(text, run):
            while parts and parts[-1].lastgroup != "word":
                parts.pop()
            begin = _begin(parts)
            bare, name = (parts, []) if begin is None else (parts[:begin], parts[begin:])
            for p in bare:
                if p.group() in surnames:
                    out.append((p.start(), p.end(), "surname", surnames[p.group()]))
            if not name:
                continue
            given, last, *_ = found = name_parts(name)
            if not given and last.group() in surnames:  # a title and a surname met before
                out.append((last.start(), last.end(), "surname", surnames[last.group()]))
                continue
            out.append((name[0].start(), name[-1].end(), "name", _name_form(found)))
            for p in [last, *(g for g in given[1:] if not _given(g))]:
                surnames.setdefault(p.group(), out[-1][3])
    return out


class _Draws:
    """Keyed, endless, repeatable choices for one entity and attempt."""

    def __init__(self, key: bytes, kind: str, form: str, attempt: int):
        seed = hmac.new(key, f"{kind}\x1f{form}\x1f{attempt}".encode(), hashlib.sha256).digest()
        self.number = int.from_bytes(hashlib.shake_256(seed).digest(96), "big")

    def below(self, n: int) -> int:
        self.number, rest = divmod(self.number, n)
        return rest

    def of(self, values: Sequence):
        return values[self.below(len(values))]


def luhn(digits: Sequence[int]) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _digits(form: str, draw: _Draws, keep: int) -> str:
    """As many digits; the first ``keep`` stay, no leading zero appears."""
    out = list(form[:keep])
    for c in form[keep:]:
        out.append(str(draw.below(10)) if len(out) > keep or c == "0" else str(1 + draw.below(9)))
    return "".join(out)


def _word(draw: _Draws, length: int) -> str:
    return "".join(draw.of(SYLLABLES) for _ in range(length // 2 + 1))[:max(length, 1)]


_FIRSTS = [n for n in range(1, 224) if n not in (10, 127, 172, 192)]


def space(kind: str, form: str) -> tuple[str, int]:
    """Name and size of the finite space of an entity's surrogates; ("", 0) for
    other kinds."""
    if kind == "ip":
        a, b, *_ = form.split(".")
        return ("10", 1 << 24) if a == "10" else ("192.168", 1 << 16) if (a, b) == ("192", "168") else ("", len(_FIRSTS) << 24)
    if kind == "phone":
        keep = 1 if len(form) > 10 else 0
        return f"{form[:keep]}/{len(form)}", 9 * 10 ** (len(form) - keep - 1)
    return "", 0


def placed(kind: str, form: str, place: int, key: bytes = KEY) -> str:
    """The value at ``place`` in the keyed order of the entity's space."""
    name, size = space(kind, form)
    draw = _Draws(key, f"space of {kind}", name, 0)
    start, step = draw.below(size), 1 + draw.below(size - 1)
    while math.gcd(step, size) != 1:
        step += 1
    at = (start + place * step) % size
    if kind == "phone":
        keep = 1 if len(form) > 10 else 0
        return form[:keep] + str(at + 10 ** (len(form) - keep - 1))
    low = f"{at >> 8 & 255}.{at & 255}"
    if name == "192.168":
        return f"192.168.{low}"
    return f"{10 if name == '10' else _FIRSTS[at >> 24]}.{at >> 16 & 255}.{low}"


def surrogate(kind: str, form: str, attempt: int = 0, key: bytes = KEY) -> str:
    """Canonical surrogate of a canonical entity; never the entity itself.
    Attempts below 0 are places -1 - attempt of its space."""
    if attempt < 0:
        return placed(kind, form, -1 - attempt, key)
    for again in range(1000):
        draw = _Draws(key, kind, form, attempt if not again else attempt + 1_000_003 * again)
        if kind == "card":
            new = _digits(form, draw, 0)
            if luhn([int(c) for c in form]):
                new = next(new[:-1] + c for c in "0123456789" if luhn([int(x) for x in new[:-1] + c]))
        elif kind == "phone":
            new = _digits(form, draw, 1 if len(form) > 10 else 0)
        elif kind == "ip":
            a, b, c, d = (int(x) for x in form.split("."))
            if a == 10:
                new = f"10.{draw.below(256)}.{draw.below(256)}.{draw.below(256)}"
            elif (a, b) == (192, 168):
                new = f"192.168.{draw.below(256)}.{draw.below(256)}"
            else:
                first = draw.of(_FIRSTS)
                new = f"{first}.{draw.below(256)}.{draw.below(256)}.{draw.below(256)}"
        elif kind == "email":
            local = form.rpartition("@")[0]
            shaped = re.sub(r"[^\W\d_]+", lambda m: _word(draw, max(len(m.group()), 6)), local)
            shaped = re.sub(r"\d", lambda _: str(draw.below(10)), shaped)
            new = f"{shaped}@{_word(draw, 6)}.example.{draw.of(('com', 'net', 'org'))}"
        elif kind == "secret":
            new = "".join(
                draw.of("0123456789") if c.isdigit() else draw.of("abcdef" if c.islower() else "ABCDEF") if c in "abcdefABCDEF"
                else draw.of("ghijklmnopqrstuvwxyz") if c.islower() else draw.of("GHIJKLMNOPQRSTUVWXYZ") if c.isupper() else c
                for c in form
            )
        else:
            script, gender, first, last = form.split("|")
            pool = SURNAMES.get((script, gender), SURNAMES["latin"])
            # past the first draws the lists are widened by made surnames
            family = draw.of(pool)
            if attempt or again:
                tail = _word(draw, 4 + 2 * ((attempt + again) // 8))
                family = family + tail if script == "latin" else family[:2] + "".join(draw.of("аеиолнрст") for _ in range(4 + 2 * ((attempt + again) // 8))) + ("ова" if gender == "f" else "ов")
            new = f"{script}|{gender}|{' '.join(draw.of(GIVEN[script, gender]).lower() for _ in first.split())}|{family.lower()}"
        if new.lower() != form.lower():
            return new
    raise RuntimeError("no surrogate differs from the entity")


def rendered(kind: str, original: str, new: str) -> str:
    """The canonical surrogate written the way ``original`` is written."""
    if kind in ("card", "phone"):
        digits = iter(new)
        return "".join(next(digits) if c.isdigit() else c for c in original)
    if kind in ("name", "surname"):
        _, _, first, last = new.split("|")
        spell = lambda word, like: word.upper() if like.isupper() and len(like) > 1 else word.capitalize()
        if kind == "surname":
            return spell(last, original)
        given, family, *_ = name_parts(list(_PARTS.finditer(original)))
        out, at = [], 0
        for part, word in zip([*given, family], [*first.split(), last]):
            out += [original[at:part.start()], spell(word, part.group())]
            at = part.end()
        return "".join(out)
    if kind == "email" and original.isupper():
        return new.upper()
    return new


def replaced(text: str, attempts: dict[tuple[str, str], int], key: bytes = KEY) -> tuple[str, int]:
    """``text`` with surrogates, and how many entities it had."""
    found = entities(text)
    if not found:
        return text, 0
    out, last = [], 0
    for begin, end, kind, form in found:
        base = "name" if kind == "surname" else kind
        out += [text[last:begin], rendered(kind, text[begin:end], surrogate(base, form, attempts.get((base, form), 0), key))]
        last = end
    return "".join([*out, text[last:]]), len(found)


def found_entities(docs: DataFrame) -> DataFrame:
    """(text_hash, kind, form) of every entity, once per text."""
    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = {
                (h, "name" if kind == "surname" else kind, form)
                for h, text in zip(batch["text_hash"], batch["text"]) for _, _, kind, form in entities(text)
            }
            yield pd.DataFrame(sorted(rows), columns=["text_hash", "kind", "form"])

    texts = docs.filter("text is not null").select(F.xxhash64("text").alias("text_hash"), "text")
    return texts.mapInPandas(find, "text_hash long, kind string, form string")


def attempts_of(forms: DataFrame, key: bytes = KEY, most: int = MAX_ATTEMPTS) -> DataFrame | None:
    """(kind, form, attempt) of the entities beyond their first draw; None if
    there are none.  ``forms`` holds distinct (kind, form)."""

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["drawn"] = [surrogate(k, f, a, key) for k, f, a in zip(batch["kind"], batch["form"], batch["attempt"])]
            yield batch

    open_ = forms.withColumn("attempt", F.lit(0).cast("long"))
    settled: DataFrame | None = None
    for attempt in range(most):
        drawn = stage(open_.mapInPandas(draw, "kind string, form string, attempt long, drawn string"))
        taken = forms.select("kind", F.col("form").alias("drawn"))
        if settled is not None:
            taken = taken.union(settled.select("kind", "drawn"))
        # the smallest entity of each drawn value keeps it; values in use go again
        least = drawn.groupBy("kind", "drawn").agg(F.min("form").alias("form"))
        winners = least.join(taken.distinct(), ["kind", "drawn"], "left_anti")
        losers = stage(drawn.join(winners, ["kind", "drawn", "form"], "left_anti"))
        if attempt == 0 and losers.isEmpty():
            return None
        good = stage(drawn.join(winners, ["kind", "drawn", "form"], "left_semi"))
        settled = good if settled is None else settled.union(good)
        if losers.isEmpty():
            return settled.filter("attempt > 0").select("kind", "form", "attempt")
        open_ = losers.select("kind", "form", (F.col("attempt") + 1).alias("attempt"))
    left = stage(_left_places(forms, settled, open_, key))
    if left.count() < open_.count():
        raise RuntimeError(f"{most} draws did not part all entities")
    return settled.filter("attempt > 0").select("kind", "form", "attempt").union(left)


def _left_places(forms: DataFrame, settled: DataFrame, open_: DataFrame, key: bytes) -> DataFrame:
    """(kind, form, attempt) of open entities at the places of their space that
    no draw has; values that are entities of the corpus come last."""

    def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [space(k, f) for k, f in zip(batch["kind"], batch["form"])]
            batch["space"], batch["size"] = [n for n, _ in found], [n for _, n in found]
            yield batch[batch["size"] > 0]

    def valued(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["value"] = [placed(k, f, p, key) for k, f, p in zip(batch["kind"], batch["form"], batch["place"])]
            yield batch

    schema = "kind string, form string, space string, size long"
    spaces = ["kind", "space"]
    # as many places as values are in use and wanted hold enough that are not
    drawn = settled.select("kind", F.col("drawn").alias("form"))
    used = forms.select("kind", "form").union(drawn).union(open_.select("kind", "form"))
    used = used.mapInPandas(named, schema).groupBy(*spaces).agg(F.count(F.lit(1)).alias("n"))
    wanted = stage(open_.select("kind", "form").mapInPandas(named, schema))
    ends = wanted.groupBy(*spaces).agg(F.min("form").alias("form"), F.min("size").alias("size")).join(used, spaces)
    places = ends.select(*spaces, "form", F.explode(F.expr("sequence(0L, least(size, n + 1L) - 1L)")).alias("place"))
    values = places.mapInPandas(valued, "kind string, space string, form string, place long, value string").drop("form")
    values = values.join(drawn.select("kind", F.col("form").alias("value")), ["kind", "value"], "left_anti")
    own = forms.select("kind", F.col("form").alias("value"), F.lit(True).alias("own"))
    values = values.join(own, ["kind", "value"], "left").withColumn("own", F.coalesce("own", F.lit(False)))
    # opposite orders of one key meet in one value at most, which goes to a neighbour
    rank = F.row_number().over(Window.partitionBy(*spaces).orderBy("own", F.when(F.col("own"), F.xxhash64("value")).otherwise(F.col("place")), "value"))
    most = wanted.groupBy(*spaces).agg(F.count(F.lit(1)).alias("wanted"))
    values = values.withColumn("rank", rank).join(most, spaces).filter("rank <= wanted")
    down = Window.partitionBy(*spaces).orderBy(F.xxhash64("form").desc(), F.col("form").desc())
    pairs = wanted.withColumn("rank", F.row_number().over(down)).join(values, [*spaces, "rank"])
    around = Window.partitionBy(*spaces)
    same = F.max(F.when(F.col("form") == F.col("value"), F.col("rank"))).over(around)
    pairs = pairs.withColumn("same", same).withColumn("other", F.when(F.col("same") > 1, F.col("same") - 1).when(F.col("same") == 1, F.lit(2)))
    at = {r: F.max(F.when(F.col("rank") == F.col(r), F.col("place"))).over(around) for r in ("same", "other")}
    place = F.when(F.col("rank") == F.col("same"), at["other"]).when(F.col("rank") == F.col("other"), at["same"]).otherwise(F.col("place"))
    return pairs.withColumn("place", place).filter("place is not null").select("kind", "form", (-1 - F.col("place")).alias("attempt"))


def pseudonymise(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """``docs`` with surrogates in ``text``, and ``n_entities``."""
    small_batches(docs)
    found = stage(found_entities(docs))
    again = attempts_of(found.select("kind", "form").distinct(), key)
    rows = docs.drop("n_entities")
    special_of, hash_of = (free_name(rows.columns, c) for c in ("_again", "_text_hash"))
    if again is None:
        rows = rows.withColumn(special_of, F.lit(None).cast("array<struct<kind:string,form:string,attempt:bigint>>"))
    else:
        texts = stage(
            found.join(again, ["kind", "form"]).groupBy("text_hash")
            .agg(F.collect_set(F.struct("kind", "form", "attempt")).alias(special_of))
        )
        few = texts.count() <= BROADCAST_TEXTS
        texts = texts.withColumnRenamed("text_hash", hash_of)
        rows = (
            rows.withColumn(hash_of, F.xxhash64("text"))
            .join(F.broadcast(texts) if few else texts, hash_of, "left").drop(hash_of)
        )
    names = [c for c in rows.columns if c != special_of]

    def swap(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, counts = [], []
            for text, special in zip(batch["text"], batch[special_of]):
                known = {(s["kind"], s["form"]): s["attempt"] for s in special} if special is not None else {}
                text, n = replaced(text, known, key) if isinstance(text, str) else (None, 0)
                texts.append(text)
                counts.append(n)
            out = batch[names].copy()
            out["text"], out["n_entities"] = texts, counts
            yield out

    rows, longs = as_text(rows, names)
    return as_longs(rows.mapInPandas(swap, f"{fields(rows, names)}, n_entities long"), longs)
