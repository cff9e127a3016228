"""Surrogates for personal data: keyed, type-consistent replacements.

*Detection.* Email addresses; phone numbers (with a country code, in the national layout of ten
digits, or with a leading zero); payment cards whose check digit holds; IBANs whose check digits hold; social security numbers
of the valid ranges; IPv4 and IPv6 addresses; secret tokens; and names: capitalized words
after an honorific, after a phrase that introduces one, or after a known given name (but no street or place). What a text names once is a name wherever that text
has it as a word of its own. Each entity has a canonical form (lower case, digits only), so spellings of
one entity share one surrogate, in all documents and after any honorific.

*Surrogates.* The canonical form goes through a keyed format-preserving permutation: a Feistel network
over the string read as a mixed-radix number, in which every character stays in its class (digit,
vowel or consonant of its script, hexadecimal digit, octet of as many digits). The parts of an
address, and given names and surname, are replaced on their own, so people at one domain or of one
family stay together. Cards and IBANs get the check digits of their new digits, social security numbers stay in
the valid ranges (cycle walking). Known given names go to the next one of their gender and script in a
keyed cycle; other given names keep their last two letters, which carry gender; honorifics stay. The surrogate
is written back into the format and case of each occurrence.

*Collisions.* A permutation gives distinct surrogates to distinct entities of one format, and the cycle
of known names has no fixed point. What can still go wrong is checked over the distinct entities of
the whole corpus: a surrogate that equals a real entity of its type, or one that two rules both give.
Those entities get the next candidate (another tweak), checked against all entities and all surrogates
given so far, until none is left. After ``TWEAKS`` candidates the format counts as full and grows
(an address by the digits of a group), by more each time, so few rounds settle what is left. Only cards, IBANs, phone and social
security numbers do not grow; that they have more entities than half of their forms is an error.
The few entities with such a later candidate reach their documents by a join.

Defined results: null texts stay null and empty texts empty; texts without entities are unchanged;
very long texts are searched whole; repeated rows get equal results; an empty table gives no rows;
extra columns are ignored; rows with a null doc_id are treated like others.
"""

from __future__ import annotations

import hmac
import ipaddress
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lanternq.llm.common import sent, written

#: The setting that holds the key. There is no other key: whoever knows it can undo surrogates.
KEY_SETTING = "spark.lanternq.pii.key"
TYPES = ("email", "phone", "card", "iban", "ssn", "ip", "secret", "name")
ROUNDS = 6
#: Candidates in an entity's own format; later ones are longer, where the type may be, by two characters more each time.
TWEAKS = 8
#: Rounds without a single entity settled after which a type of fixed length is taken to have no room left.
FULL_ROUNDS = 16

EMAIL = re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+")
#: Signs that may stand between the groups of one number.
_GAP = r"[^\w\n]{1,8}"
PHONE = re.compile(
    rf"(?<![\w+])(?P<country>\+\d{{1,3}}){_GAP}\d{{3}}{_GAP}\d{{3}}{_GAP}\d{{4}}(?!\d)"
    r"|(?<![\w+])\+(?P<whole>[1-9](?:[ .()/-]{0,3}\d){7,14})(?![\d])"
    r"|(?<![\w+])\(?\d{3}\)?[ .-]{1,2}\d{3}[ .-]\d{4}(?!\d)"
    r"|(?<![\w+])(?:\(0\d{1,4}\)|0\d{1,4})[ /-](?P<local>\d{3,8}(?:[ -]\d{2,4}){0,3})(?![\w-])"
)
CARD = re.compile(r"(?<![\w.])\d(?:[ -]?\d){12,18}(?![\w])")
IBAN = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])")
SSN = re.compile(r"(?<![\w-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w-])")
IP = re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\w)")
IP6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:|:)(?:[0-9A-Fa-f]{0,4}:){1,6}[0-9A-Fa-f]{0,4}(?![\w:]|\.\d)")
SECRET = re.compile(r"(?<![0-9A-Za-z])(?=[0-9A-Fa-f]*[A-Fa-f])(?=[A-Fa-f]*[0-9])[0-9A-Fa-f]{32,}(?![0-9A-Za-z])|(?i:\b(?:token|secret|password|api[_-]?key)\b[^\w\n]{1,12})(?P<value>[0-9A-Za-z_+/-]{12,})")
#: Country codes of one and two digits; all others have three (ITU-T E.164).
COUNTRY_1 = "1 7".split()
COUNTRY_2 = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
#: Honorifics.
HONORIFICS = (
    "Mr Mister Sir Herr Monsieur Señor Sr Don Господин Κύριος "
    "Mrs Ms Miss Madam Frau Madame Mme Señora Sra Doña Госпожа Κυρία Dr Prof Professor"
).split()
#: Given names by gender and script.
GIVEN = {
    ("m", "latin"): "james john robert michael david william richard thomas charles daniel paul mark george peter hans karl jean pierre luis carlos juan pedro".split(),
    ("f", "latin"): "mary linda susan karen nancy lisa anna emma sarah laura julia claire marie sophie elena carmen lucia maria ingrid petra monika heidi".split(),
    ("m", "cyrillic"): "иван пётр алексей сергей дмитрий николай андрей михаил владимир олег".split(),
    ("f", "cyrillic"): "анна мария елена ольга наталья ирина татьяна светлана юлия вера".split(),
    ("m", "greek"): "γιώργος νίκος δημήτρης κώστας γιάννης παύλος πέτρος ανδρέας".split(),
    ("f", "greek"): "μαρία ελένη κατερίνα άννα σοφία ιωάννα βασιλική γεωργία".split(),
}
KNOWN = {name: group for group, names in GIVEN.items() for name in names}
_CAPITALS = {name.capitalize(): name for name in KNOWN} | {name.upper(): name for name in KNOWN}
#: Words within surnames that stay as they are.
PARTICLES = "van von de der den di da del la le".split()
_WORD = r"[^\W\d_]+(?:[-'’](?!s\b)[^\W\d_]+)*"
TITLE = re.compile(rf"\b(?:{'|'.join(HONORIFICS)})\b\.?[ \u00a0](?=[^\W\d_])")
#: What a person's name follows, and words that make a street or place of one.
NAMED = re.compile(r"\b(?i:my name is|mein name ist|je m'appelle|me llamo|меня зовут)[ \u00a0](?=[^\W\d_])")
PLACES = "street road avenue lane square bridge park hall station hospital university school college church river lake island".split()
_SIGNS = frozenset(HONORIFICS) | frozenset(_CAPITALS)
_NAME_WORD = re.compile(_WORD)

#: Character classes that a surrogate keeps, each a string of its members.
CLASSES = (
    "0123456789", "aeiouy", "bcdfghjklmnpqrstvwxz", "àâäáèéêëìíîïòóôöùúûü", "çñß",
    "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ", "άέήίόύώ",
)
_CLASS = {c: (k, i) for k, members in enumerate(CLASSES) for i, c in enumerate(members)}
HEX = "0123456789abcdef"


def session_key(spark: SparkSession) -> bytes:
    """The key that the session is set up with; keep it secret and the same for all runs that are to agree."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        raise ValueError(f"{KEY_SETTING} has to hold a secret key")
    return key.encode()


def _draw(key: bytes, *parts: object) -> int:
    return int.from_bytes(hmac.digest(key, "\x1f".join(map(str, parts)).encode(), "sha256"), "big")


def permute_digits(digits: list[int], radix: list[int], key: bytes, label: str) -> list[int]:
    """A keyed permutation of all digit lists with these radixes."""
    half = len(digits) // 2
    sides = [(digits[:half], radix[:half]), (digits[half:], radix[half:])]
    value, size = [], []
    for own, bases in sides:
        v, s = 0, 1
        for d, b in zip(own, bases):
            v, s = v * b + d, s * b
        value.append(v)
        size.append(s)
    for i in range(ROUNDS):
        a, b = i % 2, 1 - i % 2
        value[a] = (value[a] + _draw(key, label, radix, i, value[b])) % size[a]
    out = []
    for v, (_, bases) in zip(value, sides):
        own = []
        for b in reversed(bases):
            v, d = divmod(v, b)
            own.append(d)
        out += own[::-1]
    return out


def permute_spans(numbers: list[int], spans: list[tuple[int, int]], key: bytes, label: str) -> list[int]:
    """``numbers`` permuted, each within its (least, how many)."""
    new = permute_digits([n - low for n, (low, _) in zip(numbers, spans)], [many for _, many in spans], key, label)
    return [low + d for d, (low, _) in zip(new, spans)]


def permute_text(text: str, key: bytes, label: str, kept_end: int = 0) -> str:
    """``text`` with every character of a known class replaced within its class, but for the last ``kept_end``."""
    at = [k for k in range(len(text) - kept_end) if text[k] in _CLASS]
    if not at:
        return text
    known = [_CLASS[text[k]] for k in at]
    new = permute_digits([i for _, i in known], [len(CLASSES[c]) for c, _ in known], key, f"{label}|{[c for c, _ in known]}|{text[len(text) - kept_end:]}")
    out = list(text)
    for k, (c, _), d in zip(at, known, new):
        out[k] = CLASSES[c][d]
    return "".join(out)


def luhn(digits: str) -> int:
    """The check digit that goes after ``digits``."""
    total = sum(d if k % 2 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(map(int, reversed(digits))))
    return -total % 10


def iban_check(country: str, body: str) -> str:
    """The two check digits between ``country`` and ``body``."""
    return f"{98 - int(''.join(str(int(c, 36)) for c in body + country + '00')) % 97:02d}"


def country_digits(digits: str) -> int:
    """How many digits the country code has that an international number begins with."""
    return 1 if digits[0] in COUNTRY_1 else 2 if digits[:2] in COUNTRY_2 else 3


@lru_cache(maxsize=64)
def _cycle(key: bytes, group: tuple[str, str]) -> dict[str, str]:
    """Each known name of ``group`` and the one after it in a keyed order."""
    order = sorted(GIVEN[group], key=lambda name: _draw(key, "cycle", *group, name))
    return dict(zip(order, order[1:] + order[:1]))


def surrogate(kind: str, canonical: str, key: bytes, tweak: int = 0) -> str:
    """The ``tweak``-th candidate for an entity, in canonical form and format."""
    label = f"{kind}|{tweak}"
    if kind == "given" and canonical in KNOWN:
        return _cycle(key, KNOWN[canonical])[canonical]
    if kind == "given":
        return permute_text(canonical, key, label, 2 if len(canonical) > 3 else 0)
    if kind == "phone":
        spans = [(1, 9) if k == 0 and d != "0" else (0, 10) for k, d in enumerate(canonical)]
        return "".join(map(str, permute_spans(list(map(int, canonical)), spans, key, label)))
    if kind == "card":
        body = canonical[0] + permute_text(canonical[1:-1], key, label + canonical[0])
        return body + str(luhn(body))
    if kind == "iban":
        body = permute_text(canonical[4:], key, label + canonical[:2])
        return canonical[:2] + iban_check(canonical[:2], body) + body
    if kind == "ssn":
        new = canonical
        while True:
            new = permute_text(new, key, label)
            if SSN.fullmatch(f"{new[:3]}-{new[3:5]}-{new[5:]}"):
                return new
    if kind == "ip" and ":" in canonical:
        groups = canonical.split(":")
        at = [k for k, g in enumerate(groups) if g != "0"]
        spans = [(16 ** (len(groups[k]) - 1), 15 * 16 ** (len(groups[k]) - 1)) for k in at]
        for k, n in zip(at, permute_spans([int(groups[k], 16) for k in at], spans, key, f"{label}|{at}")):
            groups[k] = f"{n:x}"
        return ":".join(groups)
    if kind == "ip":
        octets = list(map(int, canonical.split(".")))
        spans = [(0, 10) if o < 10 else (10, 90) if o < 100 else (100, 156) for o in octets]
        return ".".join(map(str, permute_spans(octets, spans, key, label)))
    if kind == "secret" and all(c in HEX for c in canonical):
        return "".join(HEX[d] for d in permute_digits([HEX.index(c) for c in canonical], [16] * len(canonical), key, label))
    if kind == "domain":
        rest, dot, top = canonical.rpartition(".")
        return permute_text(rest, key, label) + dot + top
    return permute_text(canonical, key, label)


def grown(kind: str, canonical: str, steps: int) -> str:
    """``canonical`` in a format with more room; numbers of the other types have room enough."""
    if not steps or kind in ("phone", "card", "iban", "ssn"):
        return canonical
    if kind == "ip" and ":" in canonical:
        return ":".join(f"{0x1000 + int(g, 16) % 0x1000:x}" if k < steps else g for k, g in enumerate(canonical.split(":")))
    if kind == "ip":
        return ".".join(str(100 + int(o) % 100) if k < steps else o for k, o in enumerate(canonical.split(".")))
    more = "a" if kind == "secret" else next((c for c in canonical if c in _CLASS), "a")
    return more * steps + canonical


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def _numbers(text: str) -> Iterator[tuple[int, int, str, list]]:
    """(start, end, type, parts) of the entities that have digits."""
    for m in SECRET.finditer(text):
        a, b = m.span("value") if m["value"] else m.span()
        if any(c.isdigit() for c in text[a:b]) or any(c in "=:" for c in text[m.start() : a]):  # words after "secret" alone are no secret
            yield a, b, "secret", [(a, b, "secret")]
    for m in IBAN.finditer(text):
        plain = m[0].replace(" ", "")
        if 15 <= len(plain) <= 34 and iban_check(plain[:2], plain[4:]) == plain[2:4]:
            yield *m.span(), "iban", [(*m.span(), "iban")]
    for m in IP.finditer(text):
        yield *m.span(), "ip", [(*m.span(), "ip")]
    if "::" in text or text.count(":") >= 7:
        for m in IP6.finditer(text):
            try:
                found = ipaddress.IPv6Address(m[0])
            except ValueError:
                continue
            if int(found):
                yield *m.span(), "ip", [(*m.span(), "ip")]
    for m in SSN.finditer(text):
        yield *m.span(), "ssn", [(*m.span(), "ssn")]
    for m in PHONE.finditer(text):
        a = m.start()
        if m["local"] and not 9 <= len(_digits(m[0])) <= 12:
            continue
        if m["country"]:
            a = m.end("country")
        elif m["whole"]:
            left = country_digits(_digits(m["whole"]))
            a = next(k for k in range(m.start("whole"), m.end()) if _digits(text[m.start("whole") : k + 1]) and len(_digits(text[m.start("whole") : k + 1])) == left) + 1
        yield *m.span(), "phone", [(a, m.end(), "phone")]
    for m in CARD.finditer(text):
        plain = _digits(m[0])
        if luhn(plain[:-1]) == int(plain[-1]) and plain.strip("0"):
            yield *m.span(), "card", [(*m.span(), "card")]


def _name_parts(text: str, start: int) -> list[tuple[int, int, str]]:
    """Given names and surname of the name that begins at ``start``: capitalized words with single spaces, and
    particles, between them; nothing if there is none."""
    words, at = [], start
    while m := _NAME_WORD.match(text, at):
        if m[0][0].isupper():
            words.append(m.span())
        elif not words or m[0] not in PARTICLES:
            break
        at = m.end() + 1
        if text[m.end() : at] not in (" ", "\u00a0"):
            break
    parts = [(a, b, "given") for a, b in words[:-1]]
    return parts + [(a, b, "given" if not parts and text[a:b].lower() in KNOWN else "surname") for a, b in words[-1:]]


def _name_signs(text: str) -> frozenset[str]:
    """The honorifics and capitalized known names among the words of ``text``."""
    return _SIGNS.intersection(_NAME_WORD.findall(" ".join([w for w in set(text.split()) if not w.islower()])))


def _names(text: str) -> Iterator[tuple[int, int, str, list]]:
    """(start, end, type, parts) of names, and of all mentions of what the text names."""
    found, known = [], _name_signs(text)
    if not known.isdisjoint(HONORIFICS):
        found += [_name_parts(text, m.end()) for m in TITLE.finditer(text)]
    found += [_name_parts(text, m.end()) for m in NAMED.finditer(text)]
    if known := known & _CAPITALS.keys():
        end = 0
        for m in re.finditer(rf"(?<![\w'’-])(?:{'|'.join(sorted(known))})(?=[ \u00a0])", text):
            parts = _name_parts(text, m.start()) if m.start() >= end else []
            if len(parts) > 1 and text[slice(*parts[-1][:2])].lower() not in PLACES:
                found.append(parts)
                end = parts[-1][1]
    kinds: dict[str, str] = {}
    for parts in found:
        for a, b, kind in parts:
            kinds[text[a:b].lower()] = "surname" if kinds.get(text[a:b].lower()) == "surname" else kind
    if not kinds:
        return
    mention = re.compile("(?<![^\\W\\d_])(?:" + "|".join(sorted(map(re.escape, kinds), key=lambda w: (-len(w), w))) + ")(?![^\\W\\d_])", re.IGNORECASE)
    run: list[tuple[int, int, str]] = []
    for m in mention.finditer(text):
        if not m[0][0].isupper():
            continue
        if run and not re.fullmatch(rf"[ \u00a0](?:(?:{'|'.join(PARTICLES)})[ \u00a0]){{0,2}}", text[run[-1][1] : m.start()]):
            yield run[0][0], run[-1][1], "name", run
            run = []
        run = [*run, (*m.span(), kinds.get(m[0].lower(), "surname"))]
    if run:
        yield run[0][0], run[-1][1], "name", run


def canonical_form(raw: str, kind: str) -> str:
    if kind in ("phone", "card", "ssn"):
        return _digits(raw)
    if kind == "iban":
        return raw.replace(" ", "").lower()
    if kind == "ip" and ":" in raw:
        return ":".join(g.lstrip("0") or "0" for g in ipaddress.IPv6Address(raw).exploded.split(":"))
    return raw.lower() if len(raw.lower()) == len(raw) else raw


def entities(text: str) -> list[tuple[int, int, str, str, str, bool]]:
    """(start, end, type, kind, canonical, first) of what is replaced in ``text``, in order and without overlap. A
    detected entity gives one or more of these (local part and domain, given names and surname); ``first`` marks
    its first."""
    found: list[tuple[int, int, str, list]] = []
    if "@" in text:
        for m in EMAIL.finditer(text):
            at = text.index("@", m.start())
            found.append((m.start(), m.end(), "email", [(m.start(), at, "local"), (at + 1, m.end(), "domain")]))
    if re.search(r"[\d=:]", text):
        found += _numbers(text)
    found += _names(text)
    found.sort(key=lambda f: (f[0], -f[1]))
    out, end = [], 0
    for a, b, kind, parts in found:
        if a < end:
            continue
        end = b
        out += [(s, e, kind, own, canonical_form(text[s:e], own), k == 0) for k, (s, e, own) in enumerate(parts)]
    return out


def written_back(original: str, new: str, kind: str) -> str:
    """``new`` in the format and case of ``original``."""
    if kind in ("phone", "card", "ssn"):
        digits = iter(new)
        return "".join(next(digits) if c.isdigit() else c for c in original)
    if kind == "iban":
        signs = iter(new.upper())
        return "".join(c if c == " " else next(signs) for c in original)
    if kind == "ip" and ":" in new:
        groups, head, tail = new.split(":"), original.partition("::")[0], original.partition("::")[2]
        before, after = [g for g in head.split(":") if g], [g for g in tail.split(":") if g]
        if any(g != "0" for g in groups[len(before) : 8 - len(after)]):
            return new
        case = str.upper if any(c.isupper() for c in original) else str
        shown = [case(g.rjust(len(o), "0")) for g, o in zip(groups[: len(before)] + groups[8 - len(after) :], before + after)]
        return ":".join(shown[: len(before)]) + ("::" if "::" in original else "") + ":".join(shown[len(before) :])
    if len(original) != len(new):
        upper = len(original) > 1 and original.isupper()
        return new.upper() if upper else new[:1].upper() + new[1:] if original[:1].isupper() else new
    return "".join(n.upper() if o.isupper() and len(n.upper()) == 1 else n for o, n in zip(original, new))


def replaced(text: str, key: bytes, later: dict[tuple[str, str], str] | None = None) -> tuple[str, Counter]:
    """``text`` with surrogates, and how many entities of each type it had. ``later`` holds surrogates of
    entities whose first candidate collided."""
    parts, at, counts = [], 0, Counter()
    for s, e, kind, own, canonical, first in entities(text):
        new = (later or {}).get((own, canonical)) or surrogate(own, canonical, key)
        parts += [text[at:s], written_back(text[s:e], new, own)]
        at = e
        counts[kind] += first
    return ("".join([*parts, text[at:]]) if parts else text), counts


def _candidates(rows: DataFrame, key: bytes, tweak: int, steps: int = 0) -> DataFrame:
    def made(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            kinds, forms = batch.column("kind").to_pylist(), batch.column("form").to_pylist()
            new = [surrogate(k, grown(k, f, steps), key, tweak) for k, f in zip(kinds, forms)]
            yield pa.RecordBatch.from_arrays([batch.column("kind"), batch.column("form"), pa.array(new, pa.string())], ["kind", "form", "new"])

    return rows.select("kind", "form").mapInArrow(made, "kind string, form string, new string")


def collided(found: DataFrame, key: bytes, tweaks: int = TWEAKS) -> DataFrame:
    """(kind, form, new) of the entities whose first candidate equals a real entity or another's surrogate.
    ``found``: distinct (kind, form). Known given names have no such entity: their cycle gives each a name of
    its own, and all of them count as real for the others."""
    known = (F.col("kind") == "given") & F.col("form").isin(*KNOWN)
    names = found.sparkSession.createDataFrame([("given", n) for n in KNOWN], "kind string, new string")
    real = found.where(~known).select("kind", F.col("form").alias("new")).unionByName(names)
    given, open_, later = None, found.where(~known), None
    tweak = failed = 0
    while True:
        tried = _candidates(open_, key, tweak, max(0, 2 * (tweak - tweaks) + 1))
        rank = F.row_number().over(W.partitionBy("kind", "new").orderBy("form"))
        tried = tried.withColumn("rank", rank).join(real.withColumn("hit", F.lit(True)), ["kind", "new"], "left")
        if given is not None:
            tried = tried.join(given.withColumn("used", F.lit(True)), ["kind", "new"], "left")
        else:
            tried = tried.withColumn("used", F.lit(None).cast("boolean"))
        clash = F.coalesce("hit", F.lit(False)) | F.coalesce("used", F.lit(False)) | (F.col("rank") > 1)
        tried = written(tried.select("kind", "form", "new", clash.alias("clash")), "pii-tried")
        good = tried.where("NOT clash")
        given = good.select("kind", "new") if given is None else given.unionByName(good.select("kind", "new"))
        if tweak:
            own = good.select("kind", "form", "new")
            later = own if later is None else later.unionByName(own)
        open_ = tried.where("clash").select("kind", "form")
        left = tried.groupBy("clash").count().collect()  # two rows
        if not any(r["clash"] for r in left):
            break
        failed = failed + 1 if all(r["clash"] for r in left) else 0
        if failed > FULL_ROUNDS:
            raise ValueError("a type of fixed length has as many entities as it has forms")
        tweak += 1
    return found.select("kind", "form", F.col("form").alias("new")).limit(0) if later is None else later


def pseudonymized(docs: DataFrame, key: bytes | None = None) -> DataFrame:
    """doc_id, text with surrogates, and the number of entities of each type, for every row of ``docs``."""
    key = session_key(docs.sparkSession) if key is None else key
    kind_of_id = dict(docs.dtypes)["doc_id"]

    def listed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            text, at, kinds, forms = batch.column("text"), [], [], []
            for i in range(len(text)):
                for kind, form in sorted({(e[3], e[4]) for e in entities(text[i].as_py() or "")}):
                    at.append(i)
                    kinds.append(kind)
                    forms.append(form)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), batch.column("th").take(take), pa.array(kinds, pa.string()), pa.array(forms, pa.string())], ["doc_id", "th", "kind", "form"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    met = written(rows.mapInArrow(listed, f"doc_id {kind_of_id}, th long, kind string, form string"), "pii-met")
    later = written(collided(written(met.select("kind", "form").distinct(), "pii-entities"), key), "pii-others")
    own = met.join(sent(later, later.count()), ["kind", "form"]).select("doc_id", "th", F.struct("kind", "form", "new").alias("e")).distinct()
    own = written(own.groupBy("doc_id", "th").agg(F.collect_list("e").alias("later")), "pii-later")
    own = own.select(F.col("doc_id").alias("own_id"), F.col("th").alias("own_th"), "later")
    full = rows.join(own, rows["doc_id"].eqNullSafe(own["own_id"]) & (rows["th"] == own["own_th"]), "left")

    def applied(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            text, later_, out, counts = batch.column("text"), batch.column("later"), [], []
            for i in range(len(text)):
                t, special = text[i].as_py(), later_[i].as_py()
                new, n = replaced(t or "", key, {(x["kind"], x["form"]): x["new"] for x in special} if special else None)
                out.append(None if t is None else new)
                counts.append(n)
            columns = [pa.array([c[k] for c in counts], pa.int64()) for k in TYPES]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string()), *columns], ["doc_id", "text", *[f"n_{k}" for k in TYPES]])

    return full.select("doc_id", "text", "later").mapInArrow(applied, f"doc_id {kind_of_id}, text string, " + ", ".join(f"n_{k} long" for k in TYPES))
