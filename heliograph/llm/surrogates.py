"""Personal data replaced by keyed surrogates, with DataFrame functions only.

Detected are e-mail addresses, phone numbers, payment cards, IBANs, IPv4 and
IPv6 addresses, social security numbers, access keys and passwords, and
personal names (after a title, a given name of the lexicon before a capitalised
surname, or a Chinese name before a form of address).

One pass of one pattern marks every hit with its kind; the text is then split
at the marks.  Every replacement is a *keyed permutation* of the values of the
same format: the parts of an entity that identify it go through a Feistel
network that adds digits to digits, small letters to small letters and so on
within one script.  So the same entity gets the same surrogate everywhere
without a lookup table (coreference), different entities get different
surrogates (distinctness), and type, length, script, case and separators stay.
Coreference ignores what does not identify: case in addresses and names,
separators in numbers.  Kept are the issuer digit of a card, the country of an
IBAN and the validity of both; the calling code of a phone number in ``+``
form; the top-level domain of an address; the class of an IPv4 address
(10.x stays 10.x) and the first group of an IPv6 address; a name's title.
Given names of the lexicon go to another one of the same gender and script,
other names are permuted vowel by vowel.

``replace_checked`` writes the result to the shared folder, looks for
collisions in it (``collisions``) and starts again under another key if it
finds any.  By construction there are none among values of up to ``LONG``
characters; longer parts are replaced by a keyed digest of their length, which
keeps neither letters nor separators and may collide as digests may.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.lineage import keep

#: Parts of an entity with more characters are digested instead of permuted.
LONG = 256

# Given names by gender and script (fixed values).
GIVEN = {
    "female, Latin": "Alice Amanda Andrea Barbara Camille Carmen Caroline Charlotte Christine Claudia Elizabeth Emily Gabriele Heike Isabelle Jennifer Karin Laura Linda Lucía Margaret Maria Mary Monika Nathalie Patricia Pilar Sabine Sarah Sophie Susan Ursula",
    "male, Latin": "Alejandro Andrew Antonio Benjamin Bernard Carlos Charles Christian Daniel David Dieter Edward Étienne François George Hans Helmut James Javier John Jürgen Laurent Michael Miguel Nicolas Patrick Paul Philippe Robert Stefan Thomas William",
    "female, Cyrillic": "Анна Екатерина Елена Ирина Мария Наталья Ольга Светлана Татьяна",
    "male, Cyrillic": "Александр Алексей Андрей Владимир Дмитрий Иван Михаил Николай Сергей",
    "female, Greek": "Αικατερίνη Ελένη Ιωάννα Μαρία Σοφία",
    "male, Greek": "Αλέξανδρος Γεώργιος Δημήτριος Ιωάννης Νικόλαος",
}
# The most common Chinese surnames (fixed values).
SURNAMES = "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧程曹袁邓许傅沈曾彭吕"


def _small_letters(first: int, last: int) -> list[str]:
    """The small letters of a range of code points that have one capital."""
    out = [chr(i) for i in range(first, last + 1)]
    return [c for c in out if c.islower() and len(c.upper()) == 1 and c.upper() != c and c.upper().lower() == c]


def _is_vowel(c: str) -> bool:
    return unicodedata.normalize("NFD", c)[0] in "aeiouæœøαεηιουωаеиоуыэюяєіѐё"


def _name_alphabets() -> tuple[str, ...]:
    blocks = [list("abcdefghijklmnopqrstuvwxyz"), _small_letters(0xDF, 0xFF), _small_letters(0x100, 0x17F), _small_letters(0x3AC, 0x3CE), _small_letters(0x430, 0x45F)]
    return tuple("".join(c for c in b if _is_vowel(c) == v) for b in blocks for v in (True, False))


def _common_characters() -> str:
    """The first level of the Chinese national standard, row by row."""
    return "".join(bytes([r, c]).decode("gb2312") for r in range(0xB0, 0xD8) for c in range(0xA1, 0xFF) if (r, c) < (0xD7, 0xFA))


def _blocks_of_han() -> str:
    """All other Chinese characters."""
    return "".join(sorted({chr(i) for i in range(0x4E00, 0xA000)} - set(_common_characters())))


_SMALL = "abcdefghijklmnopqrstuvwxyz"
#: Sets of alphabets; letters of one alphabet stand for one another, all others stay.
SETS: dict[str, tuple[str, ...]] = {
    "plain": ("0123456789", _SMALL, _SMALL.upper(), *("".join(f(c) for c in _small_letters(a, b)) for a, b in ((0xDF, 0xFF), (0x100, 0x17F), (0x3AC, 0x3CE), (0x430, 0x45F)) for f in (str, str.upper))),
    # hexadecimal values stay hexadecimal, others cannot become so
    "secret": ("0123456789", _SMALL[:6], _SMALL[6:], _SMALL[:6].upper(), _SMALL[6:].upper()),
    # a zero stays, so groups keep their length
    "hex": ("123456789abcdef",),
    "name": _name_alphabets(),
    "surname": (SURNAMES,),
    "han": (_common_characters(), _blocks_of_han()),
}

_TITLE = r"(?:Mrs?|Ms|Miss|Dr|Prof|Sir|Madam|Herrn?|Frau|Monsieur|Madame|Mademoiselle|Señora?|Señorita|Don|Doña|Госпожа|Господин|Κύριος|Κυρία|MRS?|MS|MISS|DR|PROF)\.?"
_NAMES = "|".join(name for names in GIVEN.values() for name in names.split())
_GAP = r"[ \t ]{1,3}"
_UPPER = r"\p{Lu}(?:['’]\p{Lu})?\p{L}++(?:['’-]\p{Lu}\p{L}++)*+"
# Forms of address after a Chinese name.
_ADDRESS_FORMS = "先生|女士|小姐|太太|教授|博士|医生|老师|经理|主任"
# Countries that have IBANs.
_IBAN_COUNTRIES = "AD|AE|AL|AT|AZ|BA|BE|BG|BH|BR|CH|CR|CY|CZ|DE|DK|DO|EE|ES|FI|FO|FR|GB|GE|GI|GL|GR|GT|HR|HU|IE|IL|IS|IT|JO|KW|KZ|LB|LI|LT|LU|LV|MC|MD|ME|MK|MR|MT|MU|NL|NO|PK|PL|PS|PT|QA|RO|RS|SA|SE|SI|SK|SM|TN|TR|UA|VG|XK"
# A blank inside a phone number, unless a number of another kind starts after it.
_NOT_NEXT = r" (?!\d{3}-\d\d-\d{4}(?!\d)|(?:\d{1,3}\.){3}\d|\d{12}|\d{4}(?:[ -]\d{4}){3}(?!\d))"
_H4 = "[0-9A-Fa-f]{1,4}"
#: Every repeat is bounded or possessive, so the time is linear in the text whatever it holds.  Where many words are
#: alternatives, a look ahead at the first letters spares the trial of each.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.){1,8}[A-Za-z]{2,63}+(?![A-Za-z0-9])",
    "key": r"AKIA[0-9A-Z]{16}\b",
    "password": r"(?=[AaPpSsTt])(?i:(?:password|passwd|pwd|secret|token|api[_-]?key)\b[\"']?\s?[=:]\s?[\"']?)[^\s\"',;]{6,}+",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\.?\d|\w)",
    "phone": r"(?:(?<![\w+])\+1[ .-]?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}|\+(?=(?:[ .()-]{0,2}\d){7})\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:(?:[.-]?|" + _NOT_NEXT + r")\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w|\.\d)",
    "card": r"(?<![\w.+-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}(?:[ -]\d{3}(?!\w|[.-]\d))?|\d{4}[ -]\d{6}[ -]\d{4,5})(?!\w)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "iban": rf"(?=[A-Z]{{2}}\d\d)(?:{_IBAN_COUNTRIES})\d\d(?: ?[0-9A-Z]{{4}}){{2,7}}(?: ?[0-9A-Z]{{1,3}})?(?!\w)",
    "ipv6": rf"(?={_H4}:|::)(?<![\w:.])(?=[0-9A-Fa-f:]{{0,39}}\d)(?:(?:{_H4}:){{7}}{_H4}|{_H4}(?::{_H4}){{0,5}}::(?:{_H4}(?::{_H4}){{0,5}})?)(?![\w:])",
    "name": rf"(?<!\p{{L}})(?=\p{{Lu}})(?:{_TITLE}{_GAP}{_UPPER}(?:{_GAP}{_UPPER})?|(?:{_NAMES}){_GAP}{_UPPER}|(?:{_NAMES.upper()}){_GAP}\p{{Lu}}{{2,}}+)(?!\p{{L}})|(?=[\x{{4E00}}-\x{{9FFF}}])[{SURNAMES}]\p{{IsHan}}{{1,2}}?(?={_ADDRESS_FORMS})",
}
KINDS = list(PATTERNS)
# Country calling codes: a number starts with one code only, so they are found without separators.
_CALLING = r"^(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
#: All kinds at once, each its own group; no hit starts inside a word.
_ANY = r"(?<!\w)(?:" + "|".join(f"({p})" for p in PATTERNS.values()) + ")"
# Marks around a hit and between its groups: two noncharacters; _ESC stands for any of the three that a text holds itself.
_HIT, _GROUP, _ESC = "\ufdd0", "\ufdd1", "\ufdd2"
_MARKED = _HIT + _GROUP.join(f"${i + 1}" for i in range(len(KINDS))) + _HIT


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once, inside an expression."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _letters(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


# ------------------------------------------------------------- the permutation


def alphabets(name: str) -> Column:
    """A set of alphabets as a literal: the alphabets, all letters, the letters after them, and how ASCII is split (0 not into ranges)."""
    own = SETS[name]
    quoted = lambda x: f"'{x}'"
    after, ranges = "".join(a[1:] + a[:1] for a in own), {"plain": 1, "secret": 2}.get(name, 0)
    return F.expr(f"named_struct('each', array({', '.join(map(quoted, own))}), 'all', {quoted(''.join(own))}, 'next', {quoted(after)}, 'ranges', {ranges})")


def _shift(c: Column, step: Column, letters: Column) -> Column:
    """A letter moved on within its alphabet; as it is if it has none."""

    def in_range(code: Column) -> Column:
        low = F.when(code >= 97, 97).otherwise(65)
        late = (letters["ranges"] == 2) & (code - low > 5)
        first = F.when(code.between(48, 57), 48).when(code.between(97, 122) | code.between(65, 90), low + F.when(late, 6).otherwise(0))
        size = F.when(code < 58, 10).when(letters["ranges"] == 1, 26).when(late, 20).otherwise(6)
        return let(first, lambda f: F.when(f.isNull(), c).otherwise(F.char(f + F.pmod(code - f + step, size))))

    own = F.get(F.filter(letters["each"], lambda a: F.instr(a, c) > 0), F.lit(0))
    listed = let(own, lambda a: F.coalesce(F.substring(a, F.pmod(F.instr(a, c) - 1 + step, F.length(a)) + 1, F.lit(1)), c))
    # the same for sets whose ASCII letters are ranges, without a search
    return F.when((letters["ranges"] > 0) & (F.octet_length(c) == 1), let(F.ascii(c), in_range)).otherwise(listed)


def _add(s: Column, stream: Column, letters: Column, sign: int) -> Column:
    """Each letter of ``s`` moved on (or back) by the key stream (512 bits in hex)."""
    step = lambda hexes, i: sign * F.conv(F.substring(hexes, i % 31 * 4 + 1, F.lit(4)), 16, 10).cast("int")
    return let(stream, lambda hexes: F.array_join(F.transform(_letters(s), lambda c, i: _shift(c, step(hexes, i), letters)), ""))


def permute(s: Column, key: str, use: Column, letters: Column, back: bool = False) -> Column:
    """A keyed permutation of the strings of the same format as ``s``, or its inverse."""

    def stream(r: Column, other: Column) -> Column:
        return F.sha2(F.concat(F.lit(f"{key}|"), use, F.lit("|"), r.cast("string"), F.lit("|"), other), 512)

    def on(acc: Column, r: Column) -> Column:
        # the right half takes from the left first, then they change places
        return let(_add(acc["b"], stream(r * 2, acc["a"]), letters, 1), lambda b: F.struct(_add(acc["a"], stream(r * 2 + 1, b), letters, 1).alias("a"), b.alias("b")))

    def off(acc: Column, r: Column) -> Column:
        return let(_add(acc["a"], stream(r * 2 + 1, acc["b"]), letters, -1), lambda a: F.struct(a.alias("a"), _add(acc["b"], stream(r * 2, a), letters, -1).alias("b")))

    half = F.floor(F.length(s) / 2).cast("int")
    start = F.struct(F.substring(s, F.lit(1), half).alias("a"), F.substring(s, half + 1, F.length(s)).alias("b"))
    turned = F.aggregate(F.array(*[F.lit(r) for r in ((2, 1) if back else (1, 2))]), start, off if back else on)
    return let(turned, lambda t: F.concat(t["a"], t["b"]))


def moved(s: Column, key: str, use: Column, letters: Column) -> Column:
    """A keyed permutation without fixed points: there by ``permute``, each
    letter one on, and back.

    Only strings without a letter of the alphabets stay as they are.  Strings of
    more than ``LONG`` characters are digested.
    """
    long = F.substring(F.repeat(F.sha2(F.concat(F.lit(f"{key}|"), use, F.lit("|"), s), 512), F.ceil(F.length(s) / 128).cast("int")), F.lit(1), F.length(s))
    there = F.call_function("translate", permute(s, key, use, letters), letters["all"], letters["next"])
    return F.when(F.length(s) > LONG, long).otherwise(let(there, lambda x: permute(x, key, use, letters, back=True)))


# ------------------------------------------------------ parts of an entity, by kind

# What is permuted: text, the use that its key belongs to, its alphabets, a surrogate that is fixed already, and whether it is a word of a name.
_PART = "struct<text:string,use:string,letters:struct<each:array<string>,all:string,next:string,ranges:int>,fixed:string,word:boolean>"


def _part(text: Column, use: str, letters: Column, fixed: Column | None = None, word: bool = False) -> Column:
    return F.struct(text.alias("text"), F.lit(use).alias("use"), letters.alias("letters"), (F.lit(None).cast("string") if fixed is None else fixed).alias("fixed"), F.lit(word).alias("word"))


def _like(letters: Column, form: Column, places: str = "0123456789") -> Column:
    """The letters put in the places of those of ``form``."""

    def fill(new: Column) -> Column:
        def put(acc: Column, c: Column) -> Column:
            here = F.instr(F.lit(places), c) > 0
            return F.struct(F.concat(acc["s"], F.when(here, F.substring(new, acc["n"] + 1, F.lit(1))).otherwise(c)).alias("s"), (acc["n"] + here.cast("int")).alias("n"))

        return F.aggregate(_letters(form), F.struct(F.lit("").alias("s"), F.lit(0).alias("n")), put, lambda acc: acc["s"])

    return let(letters, fill)


def _recased(new: Column, form: Column) -> Column:
    """Capitals where ``form`` of the same length has them."""
    return F.array_join(F.zip_with(_letters(new), _letters(form), lambda x, y: F.when(F.lower(y) != y, F.upper(x)).otherwise(x)), "")


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(body: Column) -> Column:
    """The check digit that follows a row of digits."""
    n = F.length(body)
    each = F.transform(_letters(body), lambda c, i: let(c.cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1), lambda d: F.when(d > 9, d - 9).otherwise(d)))
    return F.pmod(-F.aggregate(each, F.lit(0), lambda a, x: a + x), F.lit(10))


def _iban_check(country: Column, account: Column) -> Column:
    """The two check digits (98 minus the rest by 97) of an IBAN."""
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(_letters(F.concat(account, country, F.lit("00"))), F.lit(0), lambda acc, c: let(value(c), lambda v: (acc * F.when(v > 9, 100).otherwise(10) + v) % 97))
    return 98 - rest


# Each kind has a function from the entity to its parts, and one from entity and replaced parts to the surrogate.


def _email_parts(s: Column) -> Column:
    domain = F.substring_index(F.lower(s), "@", -1)
    host = F.substring(domain, F.lit(1), F.length(domain) - F.length(F.substring_index(domain, ".", -1)) - 1)
    return F.array(_part(F.substring_index(F.lower(s), "@", 1), "mailbox", alphabets("plain")), _part(host, "host", alphabets("plain")))


def _email(s: Column, new: Column) -> Column:
    return _recased(F.concat(new[0], F.lit("@"), new[1], F.lit("."), F.substring_index(F.lower(s), ".", -1)), s)


def _secret_head(s: Column) -> Column:
    return F.regexp_extract(s, r"^(?i:([a-z_-]+[\"']?\s?[=:]\s?[\"']?))", 1)


def _calling(s: Column) -> Column:
    return F.when(s.startswith("+"), F.regexp_extract(_digits(s), _CALLING, 0)).otherwise("")


def _card(s: Column, new: Column) -> Column:
    def build(d: Column) -> Column:
        n = F.length(d)
        off = F.pmod(F.substring(d, n, F.lit(1)).cast("int") - _luhn(F.substring(d, F.lit(1), n - 1)), F.lit(10))
        return let(F.concat(F.substring(d, 1, 1), new[0]), lambda x: F.concat(x, F.pmod(_luhn(x) + off, F.lit(10)).cast("string")))

    return _like(let(_digits(s), build), s)


def _iban(s: Column, new: Column) -> Column:
    def build(d: Column) -> Column:
        country = F.substring(d, 1, 2)
        # right check digits stay right, wrong ones as wrong as they were
        off = F.substring(d, 3, 2).cast("int") - _iban_check(country, F.substring(d, F.lit(5), F.length(d)))
        return F.concat(country, F.lpad(F.pmod(_iban_check(country, new[0]) + off, F.lit(100)).cast("string"), 2, "0"), new[0])

    return _like(let(F.replace(s, F.lit(" "), F.lit("")), build), s, "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _ipv6_parts(s: Column) -> Column:
    return F.transform(F.split(F.lower(s), ":"), lambda g: _part(F.regexp_replace(g, "^0+(?=.)", ""), "group", alphabets("hex")))


def _ipv6(s: Column, new: Column) -> Column:
    # the first group stays, and so do zeros in front of a group
    groups = F.transform(F.split(F.lower(s), ":"), lambda g, i: F.when(i == 0, g).otherwise(F.lpad(F.get(new, i), F.length(g), "0")))
    return _recased(F.array_join(groups, ":"), s)


def _name_pieces(s: Column) -> Column:
    """Words and the blanks between them, without the title; surname and given name of a Chinese name."""
    rest = F.substring(s, F.length(_title(s)) + 1, F.length(s))
    return F.when(s.rlike(r"^\p{IsHan}"), F.array(F.substring(s, 1, 1), F.substring(s, F.lit(2), F.length(s)))).otherwise(F.regexp_extract_all(rest, F.lit(r"[ \t ]+|[^ \t ]+"), F.lit(0)))


def _title(s: Column) -> Column:
    return F.regexp_extract(s, rf"^({_TITLE}(?={_GAP}))", 1)


def _lexicon(key: str) -> Column:
    """A map from each given name of the list to another of the same gender and script."""
    old, new = [], []
    for kind, text in GIVEN.items():
        names = text.lower().split()
        step = int(hashlib.sha256(f"{key}|{kind}".encode()).hexdigest()[:12], 16) % (len(names) - 1) + 1
        old += names
        new += names[step:] + names[:step]
    return F.map_from_arrays(F.split(F.lit(" ".join(old)), " "), F.split(F.lit(" ".join(new)), " "))


def _name_parts(s: Column, key: str) -> Column:
    han = F.transform(_name_pieces(s), lambda w, i: _part(w, "name", F.when(i == 0, alphabets("surname")).otherwise(alphabets("han"))))
    words = F.transform(_name_pieces(s), lambda w: let(F.lower(w), lambda x: _part(x, "name", alphabets("name"), F.try_element_at(_lexicon(key), x), word=True)))
    return F.when(s.rlike(r"^\p{IsHan}"), han.cast(f"array<{_PART}>")).otherwise(words.cast(f"array<{_PART}>"))


def _name(s: Column, new: Column) -> Column:
    def cased(x: Column, y: Column) -> Column:
        return F.when((F.upper(y) == y) & (F.length(y) > 1), F.upper(x)).when(F.length(x) == F.length(y), _recased(x, y)).otherwise(F.initcap(x))

    return F.concat(_title(s), F.array_join(F.zip_with(new, _name_pieces(s), cased), ""))


def _walk_steps() -> int:
    """More steps than there are listed names of one format, so a walk from another word always leaves the list."""
    sets = SETS["name"]
    form = lambda name: tuple(next((i for i, a in enumerate(sets) if c in a), c) for c in name)
    return max(Counter(form(n) for names in GIVEN.values() for n in names.lower().split()).values()) + 1


# Ranges of IPv4 addresses that belong together: public ones by their first number, and the special ones inside other blocks.
_PUBLIC = [i for i in range(1, 224) if i not in (10, 127, 169, 172, 192)]


def _public() -> Column:
    return F.expr(f"array({', '.join(map(str, _PUBLIC))})")


def _ip(s: Column, key: str) -> Column:
    """An address of the same class: what is not fixed by the class is two numbers, permuted in four rounds."""

    def noise(tag: Column, r: Column, x: Column) -> Column:
        return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{key}|ip|"), tag, F.lit("|"), r.cast("string"), F.lit("|"), x.cast("string")), 256), 1, 7), 16, 10).cast("int")

    def turn(x: Column, sign: int) -> Column:
        def once(acc: Column, r: Column) -> Column:
            on = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
            first = lambda b: F.pmod(acc["a"] + sign * noise(x["tag"], r * 2, b), x["na"])
            second = lambda a: F.pmod(acc["b"] + sign * noise(x["tag"], r * 2 + 1, a), x["nb"])
            return let(first(acc["b"]), lambda a: on(a, second(a))) if sign > 0 else let(second(acc["a"]), lambda b: on(first(b), b))

        return F.aggregate(F.array(*[F.lit(r) for r in ((1, 2) if sign > 0 else (2, 1))]), F.struct(x["a"].alias("a"), x["b"].alias("b")), once)

    def split(p: Column) -> Column:
        f, g = p[0], p[1]
        inner = F.when(((f == 192) & (g == 168)) | ((f == 169) & (g == 254)), "net").when((f == 172) & g.between(16, 31), "b172").when(f.isin(169, 172, 192), "rest").when(f.isin(0, 10, 127) | (f >= 224), "block").otherwise("public")
        low = p[2] * 256 + p[3]
        skip = F.when(f == 172, F.when(g > 31, 16).otherwise(0)).otherwise((g > F.when(f == 169, 254).otherwise(168)).cast("int"))

        def fields(c: Column) -> Column:
            a = F.when(c == "net", p[2]).when(c == "b172", g - 16).when(c == "rest", g - skip).when(c == "block", g).otherwise((F.array_position(_public(), f) - 1).cast("int"))
            na = F.when(c == "b172", 16).when(c == "rest", F.when(f == 172, 240).otherwise(255)).when(c == "public", len(_PUBLIC)).otherwise(256)
            b = F.when(c == "net", p[3]).when(c == "public", g * 65536 + low).otherwise(low)
            nb = F.when(c == "net", 256).when(c == "public", 1 << 24).otherwise(65536)
            return F.struct(c.alias("c"), f.alias("f"), g.alias("g"), a.alias("a"), na.alias("na"), b.alias("b"), nb.alias("nb"), F.concat(c, F.when(c != "public", f).otherwise(0).cast("string")).alias("tag"))

        return let(inner, fields)

    def join(x: Column, t: Column) -> Column:
        c, f = x["c"], x["f"]
        two = F.concat(F.floor(t["b"] / 256).cast("int").cast("string"), F.lit("."), (t["b"] % 256).cast("string"))
        again = F.when(f == 172, F.when(t["a"] > 15, 16).otherwise(0)).otherwise((t["a"] >= F.when(f == 169, 254).otherwise(168)).cast("int"))
        second = F.when(c == "b172", t["a"] + 16).when(c == "rest", t["a"] + again).otherwise(t["a"])
        public = F.concat_ws(".", F.get(_public(), t["a"]), F.floor(t["b"] / 65536).cast("int"), F.floor(t["b"] / 256).cast("int") % 256, t["b"] % 256)
        return F.when(c == "net", F.concat_ws(".", f, x["g"], t["a"], t["b"])).when(c == "public", public).otherwise(F.concat_ws(".", f, second, two))

    def whole(x: Column) -> Column:
        # there, one step on, and back: no fixed points
        step = lambda t: F.struct(x["c"].alias("c"), x["f"].alias("f"), x["g"].alias("g"), t["a"].alias("a"), x["na"].alias("na"), ((t["b"] + 1) % x["nb"]).alias("b"), x["nb"].alias("nb"), x["tag"].alias("tag"))
        return let(let(turn(x, 1), step), lambda y: let(turn(y, -1), lambda t: join(x, t)))

    return let(F.transform(F.split(s, r"\."), lambda x: x.cast("int")), lambda p: let(split(p), whole))


def _parts_of(s: Column, kind: Column, key: str) -> Column:
    plain = lambda text, use, name="plain": F.array(_part(text, use, alphabets(name)))
    made = {
        "email": _email_parts(s),
        "key": plain(F.substring(s, 5, 16), "key", "secret"),
        "password": plain(F.substring(s, F.length(_secret_head(s)) + 1, F.length(s)), "password", "secret"),
        "phone": plain(F.substring(_digits(s), F.length(_calling(s)) + 1, F.length(s)), "phone"),
        "card": plain(F.substring(_digits(s), F.lit(2), F.length(_digits(s)) - 2), "card"),
        "ssn": plain(_digits(s), "ssn"),
        "iban": plain(F.substring(F.replace(s, F.lit(" "), F.lit("")), F.lit(5), F.length(s)), "iban"),
        "ipv6": _ipv6_parts(s),
        "name": _name_parts(s, key),
    }
    out = F.array().cast(f"array<{_PART}>")
    for name, parts in made.items():
        out = F.when(kind == name, parts.cast(f"array<{_PART}>")).otherwise(out)
    return out


def surrogate(s: Column, kind: Column, key: str) -> Column:
    """The surrogate of an entity of a kind."""

    def replaced(p: Column) -> Column:
        # a word that is not of the list walks on until it is off the list again
        listed = lambda x: p["word"] & F.map_contains_key(_lexicon(key), x)
        walk = F.aggregate(F.sequence(F.lit(0), F.lit(_walk_steps())), p["text"], lambda x, r: F.when((r == 0) | listed(x), moved(x, key, p["use"], p["letters"])).otherwise(x))
        return F.coalesce(p["fixed"], walk)

    def build(new: Column) -> Column:
        made = {
            "email": _email(s, new),
            "key": F.concat(F.lit("AKIA"), new[0]),
            "password": F.concat(_secret_head(s), new[0]),
            "phone": _like(F.concat(_calling(s), new[0]), s),
            "card": _card(s, new),
            "ssn": _like(new[0], s),
            "iban": _iban(s, new),
            "ipv6": _ipv6(s, new),
            "name": _name(s, new),
        }
        out = _ip(s, key)
        for name, text in made.items():
            out = F.when(kind == name, text).otherwise(out)
        return out

    return let(F.transform(_parts_of(s, kind, key), replaced), build)


def _escaped(text: Column) -> Column:
    """Marks that a text holds itself, written as two letters."""
    out = text
    for i, mark in ((2, _ESC), (0, _HIT), (1, _GROUP)):
        out = F.replace(out, F.lit(mark), F.lit(f"{_ESC}{i}"))
    return F.when(text.rlike(f"[{_HIT}-{_ESC}]"), out).otherwise(text)


def _plain(text: Column) -> Column:
    out = text
    for i, mark in ((1, _GROUP), (0, _HIT), (2, _ESC)):
        out = F.replace(out, F.lit(f"{_ESC}{i}"), F.lit(mark))
    return F.when(F.contains(text, F.lit(_ESC)), out).otherwise(text)


def replace_pii(docs: DataFrame, key: str, text_col: str = "text", entities_col: str = "entities") -> DataFrame:
    """``docs`` with surrogates in the text, and an array of (type, original, surrogate).

    The array is in order of appearance, a row for each occurrence, empty when
    nothing is found (then the text is unchanged, null stays null with a null
    array).  Other columns pass through, whatever their names; a column with the
    array's name is replaced; repeated rows give equal results; an empty table
    gives an empty one.  No shuffle and no Python.
    """
    text = F.col(text_col)
    # text, hit, text, hit, ..., text; a hit is one filled group among the empty ones of the other kinds
    pieces = F.split(F.regexp_replace(_escaped(text), _ANY, _MARKED), _HIT, -1)

    def entity(piece: Column) -> Column:
        original = F.replace(piece, F.lit(_GROUP), F.lit(""))
        kind = F.element_at(F.array(*map(F.lit, KINDS)), F.instr(piece, F.substring(original, 1, 1)))
        return F.struct(kind.alias("type"), _plain(original).alias("original"))

    hits = lambda p: F.transform(F.filter(p, lambda x, i: i % 2 == 1), entity)
    made = lambda h: F.transform(h, lambda e: F.struct(e["type"].alias("type"), e["original"].alias("original"), surrogate(e["original"], e["type"], key).alias("surrogate")))
    joined = lambda p, m: F.array_join(F.transform(p, lambda x, i: F.when(i % 2 == 0, _plain(x)).otherwise(F.get(m, F.floor(i / 2).cast("int"))["surrogate"])), "")
    both = let(pieces, lambda p: let(made(hits(p)), lambda m: F.struct(F.when(F.size(p) > 1, joined(p, m)).otherwise(text).alias("text"), m.alias("entities"))))
    work = _free_name("pii", docs.columns)
    found = docs.withColumn(work, F.when(text.isNotNull(), both))
    rest = [F.col(f"{work}.text").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c != entities_col]
    return found.select(*rest, F.col(f"{work}.entities").alias(entities_col))


def _free_name(name: str, taken: list[str]) -> str:
    while name in taken:
        name = f"_{name}"
    return name


def replace_checked(docs: DataFrame, key: str, text_col: str = "text", entities_col: str = "entities", rounds: int = 4) -> DataFrame:
    """``replace_pii`` written to the shared folder and checked for collisions of all entities in it.

    If two entities share a surrogate, or one has several, everything is
    replaced anew under the next key derived from ``key``, so the result that is
    returned has none; after ``rounds`` failures it raises.  The check shuffles
    distinct entities only.
    """
    for i in range(rounds):
        done = keep(replace_pii(docs, f"{key}|{i}" if i else key, text_col, entities_col), "surrogates")
        if not collisions(done, entities_col).where("check <> 'same'").limit(1).count():
            return done
    raise RuntimeError("surrogates collide under every key")


def normal(s: Column, kind: Column) -> Column:
    """What identifies an entity, whatever its spelling."""
    return (
        F.when(kind.isin("email", "ipv6"), F.lower(s))
        .when(kind == "phone", F.regexp_replace(s, "[^0-9+]", ""))
        .when(kind.isin("card", "ssn"), _digits(s))
        .when(kind == "iban", F.replace(s, F.lit(" "), F.lit("")))
        .when(kind == "name", F.lower(F.regexp_replace(s, r"[ \t ]+", " ")))
        .otherwise(s)
    )


def collisions(replaced: DataFrame, entities_col: str = "entities") -> DataFrame:
    """``type, check, value, n`` of entities that break distinctness or coreference.

    Checks: ``shared`` (one surrogate of several entities), ``split`` (one entity
    with several surrogates), ``same`` (a surrogate equal to its original).
    Entities are made distinct before the shuffle, so a hot one is a row a task.
    """
    each = replaced.select(F.explode(entities_col).alias("e")).select("e.type", normal(F.col("e.original"), F.col("e.type")).alias("original"), normal(F.col("e.surrogate"), F.col("e.type")).alias("surrogate")).distinct()
    out = None
    for check, by, other in (("shared", "surrogate", "original"), ("split", "original", "surrogate")):
        part = each.groupBy("type", F.col(by).alias("value")).agg(F.count(other).alias("n")).where("n > 1").select("type", F.lit(check).alias("check"), "value", "n")
        out = part if out is None else out.unionByName(part)
    return out.unionByName(each.where("original = surrogate").select("type", F.lit("same").alias("check"), F.col("original").alias("value"), F.lit(1).cast("long").alias("n")))
