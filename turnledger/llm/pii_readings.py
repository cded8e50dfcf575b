"""Labelled readings for the personal-data trees: short texts with one marked span each, generated from a rule.

What is marked is what the strict rules cannot say: addresses spelled out, numbers grouped in unusual ways, national phone
numbers, each with look-alikes in contexts that contradict it. Their number is fixed by the lists below and does not
grow with the corpus."""

from __future__ import annotations

import zlib
from itertools import product

#: Values made of each form and context.
COPIES = 3

#: kind: (forms of data, contexts of data, forms of look-alikes, contexts of look-alikes). {} is the value; u a name, d a domain's name,
#: w a common word, # a digit, L a card number in groups of four that passes the checksum, X one that fails it.
_LISTS = {
    "email": (
        ("u at d dot com", "u [at] d [dot] org", "u(at)d.net", "u @ d.com", "u [at] d.de", "u {at} d {dot} com", "u at d.org", "u@d"),
        ("mail me: {}", "contact {} for help", "e-mail {} now", "Kontakt: {}", "my mail is {} as ever", "correo {}", "reach and mail {} soon", "courriel : {}"),
        ("w at d.com", "w at w.w", "# @ ##", "w @ w", "w at d dot net", "w@w"),
        ("we looked {} again", "they met {} later", "sold {} each", "prices fell, {} was slow", "and the {} of it", "more than {} said", "see {} there", "some {} then"),
    ),
    "ip": (
        ("10[.]#[.]1##[.]#", "172[.]16[.]#[.]2#", "10 . # . 1## . #", "192 dot 168 dot # dot 1##", "192(.)168(.)#(.)#", "10 .2#.3#.1#"),
        ("host {}", "the server {} failed", "ip {}", "ip address {} is down", "blocked host {} today", "server: {}", "addr {}", "ssh to host {} now"),
        ("1 . # . # . #", "3## . 4## . 5## . 6##", "# . 1# . 2# . 3#", "9##[.]8##[.]7##[.]3##", "1 dot # dot # dot #"),
        ("version {}", "section {} says", "chapter {}", "scores {} in all", "release {} is out", "build {}", "the list {} goes on", "rows {}"),
    ),
    "card": (
        ("L/.", "L//", "L/_", "L/  ", "L/ - "),
        ("card {}", "visa {} exp 09", "paid by card {}", "Karte: {}", "carte {} ok", "tarjeta {}", "number {} was used", "and then {} came"),
        ("X/.", "X//", "X/_", "X/  ", "X/ - "),
        ("order {}", "tracking {} today", "isbn {}", "serial {}", "invoice {} due", "number {} was used", "and then {} came", "ref {}"),
    ),
    "phone": (
        ("(0##) 555-01##", "0##/5550###", "0049 30 555####", "555-###-####", "01 ## ## ## ##", "0##-555 ## ##", "(###) ###-####", "00 33 1 ## ## ## ##"),
        ("call {}", "tel {}", "phone: {}", "fax {} too", "mobil {}", "please phone {} today", "tel. {} from nine", "call me: {} tonight"),
        ("2024-01-1# 10:##", "1#.02.2024 ####", "##########", "978-3-16-14841#-#", "####### ###", "1#/02/2023 11", "### ### ###", "0##-555 ## ##"),
        ("order {}", "invoice no {}", "total {} units", "version {}", "isbn {}", "page {}", "id {} is old", "amount {} EUR"),
    ),
}
_NAMES = ("joe", "ann.lee", "m_kurz", "ines.r", "info", "h-ono", "ravi", "office")
_DOMAINS = ("example", "acme-mail", "sample", "test-site", "mydomain", "northpole")
_WORDS = ("look", "price", "river", "meeting", "page", "stone", "market", "house")


def luhn_ok(digits: str) -> bool:
    total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))
    return total % 10 == 0


def _value(form: str, seed: str) -> str:
    drawn = [zlib.crc32(f"{seed}:{i}".encode()) for i in range(40)]
    if form[:2] in ("L/", "X/"):
        head = str(3 + drawn[0] % 4) + "".join(str(x % 10) for x in drawn[1:15])
        last = next(c for c in "0123456789" if luhn_ok(head + c))
        digits = head + (last if form[0] == "L" else str((int(last) + 1 + drawn[20] % 9) % 10))
        return form[2:].join(digits[i : i + 4] for i in range(0, 16, 4))
    pick = {"u": _NAMES, "d": _DOMAINS, "w": _WORDS}
    out, i = [], 0
    while i < len(form):
        alone = form[i] in pick and not form[i - 1 : i].isalpha() and not form[i + 1 : i + 2].isalpha()
        out.append(pick[form[i]][drawn[i] % len(pick[form[i]])] if alone else str(drawn[i] % 10) if form[i] == "#" else form[i])
        i += 1
    return "".join(out)


def readings() -> list[tuple[str, str, int, int, bool]]:
    """(kind, text, start, end, is it personal data). About 1,300 rows."""
    rows = []
    for kind, (good, good_contexts, bad, bad_contexts) in _LISTS.items():
        for forms, contexts, label in ((good, good_contexts, True), (bad, bad_contexts, False)):
            for form, context, copy in product(forms, contexts, range(COPIES)):
                value = _value(form, f"{kind}:{form}:{context}:{copy}")
                rows.append((kind, context.replace("{}", value), context.index("{}"), context.index("{}") + len(value), label))
    return rows
