"""Column expressions over message ids, addresses, domains and header text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MSGID = r"<[^<>@\s]+@[^<>\s]+>"
_LABEL = r"(?!-)[^\s@.]{1,63}(?<!-)"
# Local parts that lists and their robots use.
LIST_EXACT = (
    "owners", "owner", "managers", "staff", "team", "crew", "admins", "admin", "moderators", "subscribe", "unsubscribe",
    "mailman", "majordomo", "listserv", "noreply", "no-reply", "donotreply", "do-not-reply", "bounces", "bounce",
)
LIST_PREFIXES = ("list-", "mailman-", "majordomo-", "no-reply-", "noreply-", "bounce-", "bounces-")
LIST_SUFFIXES = ("-owners", "-owner", "-managers", "-staff", "-team", "-subscribe", "-unsubscribe", "-request", "-bounces", "-bounce")


def first_msgid(value: Column) -> Column:
    """The first ``<local@domain>``, else the first word with an ``@``, else null."""
    angle = F.regexp_extract(value, f"(?U)({MSGID})", 1)
    bare = F.regexp_extract(value, r"(?U)(\S*@\S*)", 1)
    return F.when(angle != "", angle).when(bare != "", bare)


def msgid_is_loose(value: Column) -> Column:
    """Whether an id was accepted without angle brackets."""
    return (F.regexp_extract(value, f"(?U)({MSGID})", 1) == "") & value.contains("@")


def references(value: Column) -> Column:
    """All ``<local@domain>`` of a References header in order, each once; empty for null."""
    return F.coalesce(F.array_distinct(F.regexp_extract_all(value, F.lit(f"(?U){MSGID}"), F.lit(0))), F.array().cast("array<string>"))


def bare_references(value: Column) -> Column:
    """Words with an ``@`` outside of any id; they are reported and not followed."""
    rest = F.regexp_replace(value, f"(?U){MSGID}", " ")
    return F.coalesce(F.filter(F.split(rest, r"(?U)\s+"), lambda w: w.contains("@")), F.array().cast("array<string>"))


def domain_of(address: Column) -> Column:
    """The lower-cased domain after the last ``@`` if it has a dot; null otherwise."""
    domain = F.trim(F.substring_index(address, "@", -1))
    return F.when(address.contains("@") & domain.contains("."), F.lower(domain))


def normalize_address(raw: Column) -> Column:
    """``local@domain`` with the domain in lower case, or null where that would be a guess.

    Exactly one ``@``, no white space, at most 254 characters, no quoted local
    part, domain labels of 1 to 63 characters without hyphens at their ends.
    The local part keeps its case.
    """
    good = (F.length(raw) <= 254) & raw.rlike(rf'(?U)^[^\s@"][^\s@]*@{_LABEL}(?:\.{_LABEL})*$')
    return F.when(good, F.concat(F.substring_index(raw, "@", 1), F.lit("@"), F.lower(F.substring_index(raw, "@", -1))))


def malformed_reason(raw: Column) -> Column:
    """Why an address has no normal form; the first that applies."""
    count = F.length(raw) - F.length(F.replace(raw, F.lit("@"), F.lit("")))
    return (
        F.when(raw == "", "empty")
        .when(raw.rlike(r"(?U)\s"), "white_space")
        .when(count != 1, F.concat(F.lit("at_signs:"), count.cast("string")))
        .when(raw.startswith("@"), "no_local_part")
        .when(raw.endswith("@"), "no_domain")
        .when(raw.startswith('"'), "quoted_local_part")
        .otherwise("domain_label")
    )


def strip_text(c: Column) -> Column:
    """Removes white space of any script at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def has_list_address(keys: Column) -> Column:
    """Whether one of the normalised addresses looks like that of a list or a robot; each local part is made once."""
    return F.exists(F.transform(keys, lambda k: F.lower(F.substring_index(k, "@", 1))), is_list_local)


def is_list_local(local: Column) -> Column:
    """Whether a local part in small letters is one that lists and robots use."""
    out = local.isin(*LIST_EXACT)
    for p in LIST_PREFIXES:
        out = out | local.startswith(p)
    for s in LIST_SUFFIXES:
        out = out | local.endswith(s)
    return out


def filter_key(text: str) -> str:
    """The normal form of one address given as a filter; raises for none or several.

    A display name is dropped.  Unlike mails' own addresses, a filter's domain
    needs two labels.
    """
    import re

    found = re.findall(r"<([^<>]*)>", text)
    plain = found if found else [x for x in re.split(r"[\s,;]+", text.strip()) if x]
    if len(plain) != 1:
        raise ValueError("exactly one address is needed")
    raw = plain[0].strip()
    label = r"(?!-)[^\s@.]{1,63}(?<!-)"
    if len(raw) > 254 or not re.fullmatch(rf'[^\s@"][^\s@]*@{label}(?:\.{label})+', raw):
        raise ValueError("not an address")
    local, _, domain = raw.partition("@")
    return f"{local}@{domain.lower()}"


def is_forward(subject: Column) -> Column:
    """A subject that says forward, behind any number of reply prefixes."""
    stripped = F.regexp_replace(F.coalesce(subject, F.lit("")), r"(?iU)^(\s*(?:re|回复|答复)\s*[:：]\s*)+", "")
    return stripped.rlike(r"(?iU)^\s*(?:fwd?|fw|转发|转发：|自动转发)\s*[:：]")


def parse_dkim(raw: Column) -> Column:
    """(d, s, i, i_domain, h, covers_from) of a DKIM-Signature value; of a repeated tag the first counts; ``i`` may be a domain alone."""
    pairs = F.filter(F.transform(F.split(raw, ";"), lambda p: F.struct(F.lower(strip_text(F.substring_index(p, "=", 1))).alias("k"), strip_text(F.regexp_replace(p, r"^[^=]*=?", "")).alias("v"), p.contains("=").alias("ok"))), lambda p: p["ok"] & (p["k"] != ""))

    def tag(name: str) -> Column:
        return F.get(F.filter(pairs, lambda p: p["k"] == name), F.lit(0))["v"]

    blank = lambda c: F.when(c != "", c)
    names = F.filter(F.transform(F.split(tag("h"), ":"), lambda x: F.lower(strip_text(x))), lambda x: x != "")
    h = F.coalesce(names, F.array().cast("array<string>"))
    return F.struct(
        F.lower(tag("d")).alias("d"), tag("s").alias("s"), tag("i").alias("i"), F.lower(blank(F.substring_index(tag("i"), "@", -1))).alias("i_domain"), h.alias("h"), F.array_contains(h, "from").alias("covers_from")
    )


def same_or_below(domain: Column, parent: Column | str) -> Column:
    """Equal domains, or a sub-domain of the other."""
    parent = F.lit(parent) if isinstance(parent, str) else parent
    return (domain == parent) | domain.endswith(F.concat(F.lit("."), parent))
