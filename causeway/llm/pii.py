"""PII surrogates: keyed, type-consistent replacements.

Detected entities are mapped by a keyed permutation of all strings of their own format (a Feistel
network over the mixed-radix number that the string is), so surrogates keep type, script, case and
punctuation, one entity has one surrogate everywhere, and two entities of one format can't share
one. Given names become names of their gender and script, family names are built from their script's
syllables and endings. A corpus-wide check finds what this can't rule out, above all surrogates that are themselves
entities of the corpus; those are drawn again, from longer formats if need be, until none is left.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm import _common as C

ROUNDS = 8
#: From this draw on, surrogates of kinds that have no fixed length are longer by one more character each draw.
WIDER = 6
#: Draws at most: only a kind of fixed length whose strings are nearly all in use comes so far, and that raises.
MAX_DRAWS = 40

#: Given names by script and gender, as many male as female in a script.
NAMES = {
    ("latin", "f"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Margaret Sandra Ashley Emily Anna Maria Laura Julia Sophie Camille Claire Isabelle Ingrid Helga Greta Carmen Lucía Elena Rosa Priya Ananya Aisha Fatima Leila Amina Mei Yuki Ngozi Thandi".split(),
    ("latin", "m"): "James Robert John Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Steven Paul Andrew Kevin Peter Klaus Jürgen Stefan Pierre Jean Luc Antoine Carlos Miguel Javier Pablo Ahmed Mohammed Omar Ali Rahul Arjun Wei Hiroshi Kwame Tunde".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Юлия".split(),
    ("cyrillic", "m"): "Иван Сергей Дмитрий Алексей Андрей Михаил Николай Владимир Павел Борис".split(),
    ("greek", "f"): "Μαρία Ελένη Κατερίνα Βασιλική Σοφία Αικατερίνη Γεωργία Δήμητρα".split(),
    ("greek", "m"): "Γιώργος Γιάννης Νίκος Κώστας Δημήτρης Παναγιώτης Βασίλης Χρήστος".split(),
    ("arabic", "f"): "فاطمة عائشة مريم ليلى زينب".split(),
    ("arabic", "m"): "محمد أحمد علي عمر يوسف".split(),
}
_GENDER = {n.casefold(): (k, i) for k, names in NAMES.items() for i, n in enumerate(names)}
#: Given names that are words, too; without a family name, title or introduction they are none.
WORDS_TOO = set("Mark Rosa Jean Luc Ali Mei Wei".split())
#: What stands before a name. A title goes with the family name, an introduction with the given name.
TITLES = "Mr. Mr Mrs. Mrs Ms. Ms Miss Dr. Dr Prof. Professor Herr Herrn Frau Monsieur Madame Mme Señor Señora Sr. Sra. Г-н Г-жа господин госпожа Κύριος Κυρία".split()
INTRODUCTIONS = ["my name is", "My name is", "name:", "Name:", "signed by", "Dear", "mein Name ist", "Mein Name ist", "ich heiße", "Ich heiße", "je m'appelle", "Je m'appelle", "me llamo", "Me llamo", "меня зовут", "Меня зовут", "με λένε", "Με λένε"]
#: What people do to people; two capitalized words beside it are a name.
VERBS = "called told met emailed phoned visited thanked married hired".split()
#: Capitalized words that are no name: function words, days, months, bodies and places.
NO_NAME = set(
    "the a an and or but if of in on at for with to from by is was are were be it this that these those he she they we you i your my his her our their its as not no all any each every when where who what how why then there here so "
    "der die das und oder ein eine mit von zu im am le la les et ou un une de du des avec el los las y o una con del en и в на с не это как что ο η το και "
    "monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december "
    "court bank university college school company inc ltd street road avenue city county state states union party church hospital museum institute department ministry council committee government president minister street north south east west new united".split()
) | {t.rstrip(".").casefold() for t in TITLES}
#: Syllables and endings that family names are made of, by script; endings by gender where names have one.
SYLLABLES = {
    "latin": [a + b for a in "b d f g h k l m n p r s t v w br dr gr kr tr st sch".split() for b in "a e i o u ei".split()],
    "cyrillic": [a + b for a in "б в г д з к л м н п р с т ф х".split() for b in "а е и о у".split()],
    "greek": [a + b for a in "β γ δ θ κ λ μ ν π ρ σ τ φ χ".split() for b in "α ε ι ο".split()],
}
ENDINGS = {
    ("latin", "m"): "ner son ler man ton ley ford rez din vik sen mann".split(),
    ("cyrillic", "m"): "ров нов лев шин кин".split(),
    ("cyrillic", "f"): "рова нова лева шина кина".split(),
    ("greek", "m"): "ίδης όπουλος άκης".split(),
    ("greek", "f"): "ίδου οπούλου άκη".split(),
}

_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
#: Kinds in the order in which overlapping finds win.
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9])?@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    "key": re.compile(r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[opsu]_[A-Za-z0-9]{30,}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}|xox[abprs]-[A-Za-z0-9-]{10,})(?![A-Za-z0-9])"),
    "secret": re.compile(r"(?i)\b(?:api[_-]?key|access[_-]?key|secret|token|password|passwd|pwd)\b\s*[=:]\s*[\"']?([A-Za-z0-9_\-/+]{8,})"),
    "hex": re.compile(r"(?<![A-Za-z0-9])(?=[A-Fa-f]*\d)(?=\d*[A-Fa-f])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![A-Za-z0-9])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "ip": re.compile(rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\d]|\.\d)"),
    "card": re.compile(r"(?<![\d.])(?:\d{13,19}|(?:\d{4} ){3}\d{1,7}|(?:\d{4}-){3}\d{1,7})(?!\d)"),
    "ssn": re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    "phone": re.compile(
        r"(?<![\w(])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3}[ .-]\d{4}(?!\d)|(?<!\w)\+\d{1,3}(?:[ .-]?\d{2,4}){3,4}(?!\d)"
        r"|(?<![\w.-])0\d{1,4}[ -]\d{3,4}[ -]\d{3,4}(?![\w-])|(?:(?i:tel|phone|fax|mobile|telefon|teléfono|téléphone|тел)\.?:? ?)(\d{3}[ -]\d{4})(?!\d)"
    ),
}
#: What a text must hold for a kind to occur in it at all; most texts hold neither.
_DIGIT = re.compile(r"[0-9@]")
_KEY = ("AKIA", "ASIA", "gh", "k_live_", "k_test_", "AIza", "xox")
_WORD_AFTER = re.compile(r"(?:, | |\n)([^\W\d_]+(?:[-'’][^\W\d_]+)*)")
_WORDS_BEFORE = re.compile(r"(?<![\w])([^\W\d_]+(?:[-'’][^\W\d_]+)*) ([^\W\d_]+(?:[-'’][^\W\d_]+)*) $")
_CAPITALIZED = re.compile(r"(?<![\w])[^\W\d_a-zà-ÿ][^\W\d_]+(?:[-'’][^\W\d_]+)*")


@lru_cache(maxsize=1)
def _signs() -> ahocorasick.Automaton:
    """Given names, titles, introductions and verbs, found in one pass."""
    found = ahocorasick.Automaton()
    for kind, words in (("given", [n for names in NAMES.values() for n in names]), ("title", TITLES), ("introduction", INTRODUCTIONS), ("verb", [f" {v} " for v in VERBS])):
        for w in words:
            found.add_word(w, (len(w), kind))
    found.make_automaton()
    return found


def _luhn(digits: str) -> int:
    """The check digit after these digits."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * 2 if i % 2 == 0 else int(c)
        total += d - 9 if d > 9 else d
    return -total % 10


def _is_card(value: str) -> bool:
    """Of an issuer's first digit, and with the right check digit; other long numbers are just numbers."""
    digits = re.sub(r"\D", "", value)
    return digits[0] in "23456" and _luhn(digits[:-1]) == int(digits[-1])


def _is_name(word: str) -> bool:
    return len(word) > 1 and word[0].isupper() and not word.isupper() and word.casefold() not in NO_NAME


def _names(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of persons' names: given names of the lists, name for other given names, family."""
    found, n = {}, len(text)

    def add(m: re.Match, group: int, kind: str) -> int:
        word = m[group]
        found[m.start(group)] = (m.end(group), "given" if kind != "family" and word.casefold() in _GENDER else kind)
        return m.end(group)

    def family_after(end: int) -> None:
        m = _WORD_AFTER.match(text, end)
        if m and text[end] == " " and _is_name(m[1]):
            add(m, 1, "family")

    def person_after(end: int, title: bool) -> None:
        m = _WORD_AFTER.match(text, end)
        if not m or not _is_name(m[1]):
            return
        after = _WORD_AFTER.match(text, m.end(1))
        two = bool(after) and text[m.end(1)] == " " and _is_name(after[1])
        add(m, 1, "family" if title and not two and m[1].casefold() not in _GENDER else "name")
        if two:
            add(after, 1, "family")

    for last, (length, kind) in _signs().iter(text):
        a, b = last - length + 1, last + 1
        if kind == "verb":
            m = _WORDS_BEFORE.search(text[max(0, a - 60) : a + 1])
            if m and _is_name(m[1]) and _is_name(m[2]):
                shift = max(0, a - 60)
                for g, k in ((1, "name"), (2, "family")):
                    found.setdefault(shift + m.start(g), (shift + m.end(g), "given" if g == 1 and m[g].casefold() in _GENDER else k))
            m = _WORD_AFTER.match(text, b - 1)
            after = m and _WORD_AFTER.match(text, m.end(1))
            if after and _is_name(m[1]) and _is_name(after[1]) and text[m.end(1)] == " ":
                person_after(b - 1, False)
            continue
        if (a and (text[a - 1].isalnum() or text[a - 1] in "-_")) or (b < n and (text[b].isalnum() or text[b] == "_")):
            continue
        if kind == "given":
            m = re.compile(r"-([^\W\d_]+)").match(text, b)
            if m and m[1].casefold() in _GENDER:
                b = m.end()
            before = len(found)
            family_after(b)
            if text[a:b] not in WORDS_TOO or len(found) > before or a in found:
                found[a] = (b, "given")
        else:
            person_after(b, kind == "title")
    if not found:
        return []
    # the names of a text's people, wherever else they stand in it
    known = {text[a:b].casefold(): k for a, (b, k) in found.items() if k != "given"}
    if known:
        for m in _CAPITALIZED.finditer(text):
            if m.start() not in found and (k := known.get(m[0].casefold())):
                found[m.start()] = (m.end(), k)
    return [(a, b, k) for a, (b, k) in found.items()]


def detect(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the entities of a text, from left to right, without overlaps."""
    found, digits = [], _DIGIT.search(text)
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        if kind == "secret":
            look = "=" in text or ":" in text
        elif kind == "key":
            look = any(k in text for k in _KEY)
        else:
            look = digits and (kind != "email" or "@" in text)
        if look:
            for m in pattern.finditer(text):
                group = m.lastindex or 0
                if kind != "card" or _is_card(m[0]):
                    found.append((m.start(group), rank, m.end(group), kind))
    found += [(a, 98 if k != "family" else 99, b, k) for a, b, k in _names(text)]
    out, end = [], 0
    for a, _, b, kind in sorted(found):
        if a >= end:
            out.append((a, b, kind))
            end = b
    return out


def canonical(kind: str, value: str) -> str:
    """What makes two mentions the same entity: the digits of a number; else the string without case."""
    if kind in ("card", "ssn", "phone"):
        return re.sub(r"\D", "", value)
    if kind == "iban":
        return value.replace(" ", "")
    return value if kind == "secret" and not value.isupper() else value.casefold() if kind in ("given", "name", "family") else value if kind == "key" else value.lower()


def _permute(number: int, size: int, key: bytes, tweak: bytes) -> int:
    """A keyed permutation of range(size): a balanced Feistel network, walked until it is back in range."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask, width = (1 << half) - 1, (half + 7) // 8
    while True:
        a, b = number >> half, number & mask
        for r in range(ROUNDS):
            seed = bytes([r]) + tweak + b"|" + b.to_bytes(width, "big")
            stream = b"".join(hashlib.blake2b(seed + bytes([j]), key=key, digest_size=64).digest() for j in range(-(-width // 64)))
            a, b = b, a ^ (int.from_bytes(stream[:width], "big") & mask)
        number = a << half | b
        if number < size:
            return number


_ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ", "αβγδεζηθικλμνξοπρσςτυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"]
_OF = {c: a for a in _ALPHABETS for c in a}


def keep_format(value: str, key: bytes, tweak: str, alphabets: dict[str, str] | None = None) -> str:
    """Another string of the same format: digits for digits, letters of the same script and case, all else as it is."""
    of = alphabets or _OF
    number, size = 0, 1
    for c in value:
        if (a := of.get(c)) is not None:
            number, size = number * len(a) + a.index(c), size * len(a)
    if size == 1:
        return value
    shape = "".join(str(_ALPHABETS.index(of[c])) if c in of and of[c] in _ALPHABETS else "h" if c in of else c for c in value)
    number = _permute(number, size, key, f"{tweak}|{shape}".encode())
    out = []
    for c in reversed(value):
        a = of.get(c)
        if a is None:
            out.append(c)
        else:
            number, d = divmod(number, len(a))
            out.append(a[d])
    return "".join(reversed(out))


_HEX = {c: "0123456789abcdef" for c in "0123456789abcdef"}


def _script(letter: str) -> str:
    return unicodedata.name(letter, "LATIN").split()[0].lower()


@lru_cache(maxsize=None)
def _letters(script: str) -> list[str]:
    """The small letters of a script, or all its letters if it has no case."""
    named = [(chr(i), unicodedata.name(chr(i), "")) for i in range(0x250, 0x3100) if chr(i).isalpha() and unicodedata.name(chr(i), "").lower().startswith(script + " ")]
    small = [c for c, name in named if "SMALL LETTER" in name and "WITH" not in name]
    return small or [c for c, _ in named] or list("abcdefghijklmnopqrstuvwxyz")


def _numbers(key: bytes, seed: str):
    """An endless keyed stream of numbers."""
    k = 0
    while True:
        block = hashlib.blake2b(f"{k}|{seed}".encode(), key=key, digest_size=64).digest()
        yield from (int.from_bytes(block[i : i + 4], "big") for i in range(0, 64, 4))
        k += 1


def gender(canon: str) -> str:
    """What a name's own ending tells; the same for every mention."""
    script = _script(canon[0])
    ends = {"cyrillic": ("а", "я"), "greek": ("α", "η", "ου", "ά", "ή")}.get(script, ("a", "ة"))
    return "f" if canon.endswith(ends) else "m"


def _family(canon: str, key: bytes, draw: int) -> str:
    """A family name of the same script, gender and about the same length; later draws are longer."""
    script, numbers = _script(canon[0]), _numbers(key, f"family|{draw}|{canon}")
    if script not in SYLLABLES:
        letters = _letters(script)
        return "".join(letters[next(numbers) % len(letters)] for _ in range(max(2, len(canon)) + draw // 2))
    endings = ENDINGS.get((script, gender(canon)), ENDINGS[script, "m"])
    syllables, n = SYLLABLES[script], max(1, round(len(canon) / 3) - 1) + draw // 2
    return "".join(syllables[next(numbers) % len(syllables)] for _ in range(n)) + endings[next(numbers) % len(endings)]


def _given(canon: str, key: bytes, draw: int) -> str:
    """Another given name of the gender and script; later draws give double names. A listed name has another's place in a
    keyed cycle of its list, so no two have the same and none its own."""
    group, i = _GENDER.get(canon.split("-")[0], ((_script(canon[0]), gender(canon)), None))
    group = group if group in NAMES else ("latin", group[1])
    names = NAMES[group]
    if i is not None and canon in _GENDER and not draw:
        cycle = sorted(range(len(names)), key=lambda j: hashlib.blake2b(f"{group}|{j}".encode(), key=key).digest())
        return names[cycle[(cycle.index(i) + 1) % len(cycle)]].casefold()
    numbers = _numbers(key, f"given|{draw}|{canon}")
    return "-".join(names[next(numbers) % len(names)] for _ in range(2 + draw // WIDER)).casefold()


def _ip_class(n: int) -> int:
    """Ranges whose addresses are alike: private ones, loopback, unicast, all others."""
    a, b = n >> 24, n >> 16 & 255
    return 1 if a == 10 else 2 if a == 172 and 16 <= b < 32 else 3 if a == 192 and b == 168 else 4 if a == 127 else 5 if 0 < a < 224 else 6


def surrogate(kind: str, canon: str, key: bytes, draw: int = 0) -> str:
    """The canonical surrogate of a canonical entity. For each draw a bijection within the entity's kind and format."""
    tweak = f"{kind}|{draw}"
    if kind in ("given", "name"):
        return _given(canon, key, draw)
    if kind == "family":
        return _family(canon, key, draw)
    if kind in ("email", "key", "secret", "hex") and draw >= WIDER:
        at = canon.index("@") if kind == "email" else len(canon)
        canon = canon[:at] + ("0" if canon[at - 1].isdigit() or kind == "hex" else "A" if canon[at - 1].isupper() else "a") * (draw - WIDER + 1) + canon[at:]
    if kind == "key":  # what tells whose key it is stays
        lead = re.match(r"AKIA|ASIA|gh[opsu]_|[sr]k_(?:live|test)_|AIza|xox[abprs]-", canon).end()
        return canon[:lead] + keep_format(canon[lead:], key, f"{tweak}|{canon[:lead]}")
    if kind == "email":
        local, _, domain = canon.rpartition("@")
        labels = domain.split(".")
        named = [keep_format(x, key, f"{tweak}|domain") for x in labels[:-1]]
        return f"{keep_format(local, key, tweak)}@{'.'.join([*named, labels[-1]])}"
    if kind == "ip":
        n = 0
        for part in canon.split("."):
            n = n << 8 | int(part)
        own = _ip_class(n)
        n = _permute(n, 1 << 32, key, tweak.encode())
        while _ip_class(n) != own:
            n = _permute(n, 1 << 32, key, tweak.encode())
        return ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))
    if kind == "card":  # the issuer's digit stays, and the check digit is right if it was
        body = canon[0] + keep_format(canon[1:-1], key, f"{tweak}|{canon[0]}|{canon[-1] if _luhn(canon[:-1]) != int(canon[-1]) else 'ok'}")
        shift = (int(canon[-1]) - _luhn(canon[:-1])) % 10
        return body + str((_luhn(body) + shift) % 10)
    if kind == "phone":  # the country code of a number with eleven digits or more stays
        lead = max(len(canon) - 10, 0)
        return canon[:lead] + keep_format(canon[lead:], key, f"{tweak}|{canon[:lead]}")
    if kind == "iban":
        return canon[:4] + keep_format(canon[4:], key, f"{tweak}|{canon[:4]}")
    if kind == "hex" or (kind == "secret" and re.fullmatch(r"[0-9a-f]{16,}", canon)):
        return keep_format(canon, key, f"{tweak}|hex", _HEX)
    return keep_format(canon, key, tweak)


def dressed(value: str, kind: str, canon: str) -> str:
    """A canonical surrogate in the spelling of the mention that it replaces: its case, spaces and signs."""
    if kind in ("card", "ssn", "phone", "iban"):
        letters = iter(canon)
        return "".join(next(letters) if c.isdigit() or (kind == "iban" and c.isalnum()) else c for c in value)
    if value.isupper():
        return canon.upper()
    if kind in ("given", "name", "family"):
        return "-".join(x[:1].upper() + x[1:] for x in canon.split("-"))
    if kind in ("email", "hex"):  # letter for letter, where case is mixed
        return "".join(s.upper() if v.isupper() else s for v, s in zip(value, canon)) if len(value) == len(canon) else canon
    return canon


def _found(texts: pd.Series) -> pd.Series:
    """Distinct entities of each text, as kind and canonical form on either side of a tab."""
    return pd.Series([sorted({f"{k}\t{canonical(k, t[a:b])}" for a, b, k in detect(t)}) if t else [] for t in texts])


def _replaced(texts: pd.Series, names: pd.Series, surrogates: pd.Series) -> pd.Series:
    out = []
    for text, keys, values in zip(texts, names, surrogates):
        new, parts, end = dict(zip(keys, values)), [], 0
        for a, b, kind in detect(text):
            parts += [text[end:a], dressed(text[a:b], kind, new[f"{kind}\t{canonical(kind, text[a:b])}"])]
            end = b
        out.append("".join([*parts, text[end:]]))
    return pd.Series(out)


def draws(entities: DataFrame, key: bytes) -> DataFrame:
    """entities: (entity), distinct. Returns (entity, surrogate): distinct surrogates, none of which is an entity
    of the corpus. Each draw is checked over the whole table: an entity whose surrogate is also another's, or is
    an entity itself, draws again; the last draw is checked like the others. Kinds of no fixed length draw from longer
    formats after some draws, so there is always a free string. Should nearly all strings of a kind of fixed length
    be entities of the corpus, this raises rather than return one of them."""
    make = F.pandas_udf(lambda e, n: pd.Series([f"{k}\t{surrogate(k, v, key, d)}" for (k, v), d in zip((x.split("\t", 1) for x in e), n)]), "string")
    made = lambda df: C.cut(df.withColumn("surrogate", make("entity", "draw")))
    # a listed and another given name may be spelled alike
    plain = lambda c: F.regexp_replace(c, "^name\t", "given\t")
    all_of = C.cut(entities.select("entity"))
    real = all_of.select(plain(F.col("entity")).alias("_real")).distinct()
    now = made(all_of.withColumn("draw", F.lit(0)))
    for draw in range(1, MAX_DRAWS + 1):
        now = now.withColumn("_s", plain(F.col("surrogate")))
        first = now.groupBy("_s").agg(F.min("entity").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
        seen = now.join(first, "_s", "left").join(real, F.col("_s") == F.col("_real"), "left")
        again = (F.col("_first").isNotNull() & (F.col("_first") != F.col("entity"))) | F.col("_real").isNotNull()
        seen = C.cut(seen.select("entity", "draw", "surrogate", again.alias("again")))
        if seen.where("again").isEmpty():
            return seen.select("entity", "surrogate")
        more = made(seen.where("again").select("entity", F.lit(draw).alias("draw"))).select("entity", "draw", "surrogate")
        now = C.cut(seen.where("not again").select("entity", "draw", "surrogate").union(more))
    kinds = sorted(r[0] for r in seen.where("again").select(F.substring_index("entity", "\t", 1)).distinct().collect())
    raise ValueError(f"the corpus holds nearly all strings of a format: {kinds}")


def with_surrogates(docs: DataFrame, key: bytes | str, text_col: str = "text", count: str | None = "n_entities") -> DataFrame:
    """docs with every detected entity of each whole text replaced by its surrogate, and the number of distinct
    entities of the text in column `count` (none if None; it replaces one of that name).

    Kinds: e-mail and IP addresses, phone, card (with the right check digit), social security and account numbers, secrets, access keys and long
    hexadecimal strings; given names that are listed, stand beside a title or an introduction, or are the first of two
    capitalized words beside a verb of dealing with people; the family names that go with them, and every other place in the same text where these stand.
    The same entity, in whatever case or grouping, has one surrogate in all texts; different ones have different
    surrogates, none of which is an entity of the corpus. Reruns with the same key agree. Null and empty texts and
    texts without an entity stay as they are; rows that repeat are rows of their own; every other column passes
    through, whatever its name. Only texts with an entity are shuffled.
    """
    secret = hashlib.blake2b(key.encode() if isinstance(key, str) else key, digest_size=32).digest()
    found = F.pandas_udf(_found, "array<string>")(F.col(text_col).cast("string"))
    columns = docs.columns
    mark, row, new = (C.free(n, columns) for n in ("_pii", "_pii_row", "_pii_new"))
    marked = docs.withColumn(mark, found)
    hit = C.cut(marked.where(F.size(mark) > 0).withColumn(row, F.monotonically_increasing_id()))
    mentions = hit.select(row, F.explode(mark).alias("entity"))
    chosen = draws(mentions.select("entity").distinct(), secret)
    pairs = mentions.join(chosen, "entity").groupBy(row).agg(F.collect_list(F.struct("entity", "surrogate")).alias(new))
    text = F.pandas_udf(_replaced, "string")(F.col(text_col).cast("string"), F.col(f"{new}.entity"), F.transform(f"{new}.surrogate", lambda s: F.substring_index(s, "\t", -1)))
    n = F.size(mark).cast("long")
    hit = hit.join(pairs, row).withColumn(text_col, text)
    rest = marked.where(F.size(mark) == 0)
    extra = [n.alias(count)] if count else []
    keep = [F.col(f"`{c}`") for c in columns if c != count]
    return rest.select(*keep, *extra).unionByName(hit.select(*keep, *extra))
