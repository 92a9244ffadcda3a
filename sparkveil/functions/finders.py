"""Spans of the detection rules, found by equal expressions that skip what cannot begin a match."""

from __future__ import annotations

import re
from collections.abc import Callable

from .rules import PATTERNS

Finder = Callable[[str], list[tuple[int, int]]]

# Python's `re` looks for a first character from a set quickly, but tries an expression that begins with \b at every place.
# Behind a first word character, FIRST says what \b says before it.
FIRST = r"(?<!\w[\s\S])"
_STREET = r"Street|St|Avenue|Ave|Boulevard|Blvd|Road|Rd"
#: Expressions with the same matches as a rule's own.
EQUAL = {
    ("social_security_numbers", False): rf"\d{FIRST}(?:\d{{2}}-\d{{2}}-\d{{4}}|\d{{8}})\b",
    ("phone_numbers", False): rf"[+(\d](?:(?<=\w\+)1[-.\s]?\(?\d{{3}}|(?<=\w\()\d{{3}}|(?<=1){FIRST}[-.\s]?\(?\d{{3}}|(?<=\d){FIRST}\d{{2}})\)?[-.\s]?\d{{3}}[-.\s]?\d{{4}}\b",
    ("ip_addresses", False): rf"\d{FIRST}\d{{0,2}}\.(?:\d{{1,3}}\.){{2}}\d{{1,3}}\b",
    ("dates", False): rf"\d{FIRST}(?:\d?[/-]\d{{1,2}}[/-]\d{{2,4}}|\d?\s?[A-Za-z]{{3,9}}\s?\d{{2,4}})\b",
    ("health_plan_numbers", False): rf"[A-Z0-9]{FIRST}[A-Z0-9]{{4,14}}\b",
    ("certificate_license_numbers", True): rf"[LlMmRr]{FIRST}(?i:(?:(?<=l)(?:ic|icense|t)|(?<=r)n|(?<=m)d)[:#\s]*[A-Z0-9\-]{{3,16}}\b)",
    ("vehicle_identifiers", False): rf"[A-Z0-9\-](?:(?<=\w-)|{FIRST}(?<!-))[A-Z0-9\-]{{4,7}}\b",
    ("device_identifiers", False): rf"[Ss]{FIRST}(?:n[:#\s]*[0-9A-Za-z\-]{{4,20}}\b|(?<=S)erial\s?No[:#\s]*[0-9A-Za-z\-]{{4,20}}\b)",
    ("geographic_locations", False): rf"[\dA-Z]{FIRST}(?:(?<=\d)\d{{4}}(?:-\d{{4}})?\b|(?<=[A-Z])(?:[a-z]+\s(?:[A-Z][a-z]+\s)?(?:{_STREET})|(?<=S)(?:treet|t)|(?<=A)(?:venue|ve)|(?<=B)(?:oulevard|lvd)|(?<=R)(?:oad|d))\b)",
    ("other_unique_identifiers", True): rf"[Uu]{FIRST}(?i:id[:#\s]*[A-Z0-9\-]{{4,20}}\b)",
    ("names", False): rf"[A-Z]{FIRST}[a-z]+\s[A-Z][a-z]+\b",
}
#: Texts that any match holds; where a rule ignores case, in lower case.
HOLDS = {
    "urls": ("://", "www."), "medical_record_numbers": ("MRN", "mrn", "Medical", "Acct"), "account_numbers": ("Acc",),
    "biometric_identifiers": ("fingerprint", "retina", "iris", "voice"), "full_face_photos": ("photo", "full-face", "full face"), "fax_numbers": ("fax",),
}
#: Letters beyond ASCII that count as i, s and k where case is ignored.
ODD = "İıſK"
RULES = {r[0]: r for r in [*PATTERNS, ("names", r"\b([A-Z][a-z]+\s[A-Z][a-z]+)\b", False)]}
_DOMAIN = re.compile(r"[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+")


def emails(t: str) -> list[tuple[int, int]]:
    """Spans of addresses: from each @, backwards over what may stand before it and forwards over its domain."""
    out: list[tuple[int, int]] = []
    last, at = 0, t.find("@")
    while at >= 0:
        domain, begin = _DOMAIN.match(t, at + 1), at
        if domain:
            while begin > last and (t[begin - 1].isascii() and t[begin - 1].isalnum() or t[begin - 1] in "_.+-"):
                begin -= 1
            if begin < at:
                last = domain.end()
                out.append((begin, last))
        at = t.find("@", max(at + 1, last))
    return out


def finder(rule: tuple[str, str, bool]) -> Finder:
    """Spans of a rule's matches in a text, as finditer() gives them."""
    name, regex, ignore = rule
    if RULES.get(name) != rule:
        search = re.compile(regex, re.I if ignore else 0).finditer
        return lambda t: [m.span() for m in search(t)]
    if name == "email_addresses":
        return emails
    search = re.compile(EQUAL.get((name, ignore), regex), re.I if ignore and (name, ignore) not in EQUAL else 0).finditer
    holds = HOLDS.get(name)
    if holds is None:
        return lambda t: [m.span() for m in search(t)]

    def run(t: str) -> list[tuple[int, int]]:
        low = t.lower() if ignore else t
        if any(h in low for h in holds) or ignore and not t.isascii() and any(c in t for c in ODD):
            return [m.span() for m in search(t)]
        return []

    return run
