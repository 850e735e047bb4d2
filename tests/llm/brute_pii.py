"""Pseudonyms in plain Python, value by value, by other means than the operator's: a scan per kind, whole numbers, datetime."""

from __future__ import annotations

import hashlib
import re
from datetime import date, timedelta

KEY, ROUNDS = "kelvora", 6
AL, HEX = "A-Za-z0-9", "[0-9A-Fa-f]{1,4}"


def _digest(*parts) -> int:
    return int(hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:13], 16)


def feistel(x: int, y: int, a: int, b: int, tweak: str) -> tuple[int, int]:
    for i in range(ROUNDS):
        if i % 2 == 0:
            x = (x + _digest(KEY, tweak, i, y)) % a
        else:
            y = (y + _digest(KEY, tweak, i, x)) % b
    return x, y


def number(digits: str, tweak: str) -> str:
    n = len(digits)
    left, right = n - n // 2, n // 2
    x, y = feistel(int(digits[:left]), int(digits[left:]), 10**left, 10**right, f"{tweak}{n}")
    return f"{x:0{left}d}{y:0{right}d}"


def put(shape: str, digits: str) -> str:
    own = iter(digits)
    return "".join(next(own) if c in "0123456789" else c for c in shape)


def only(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def luhn(d: str) -> int:
    return sum(int(c) if k % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for k, c in enumerate(reversed(d))) % 10


def letters(m: str, tweak: str, hexadecimal: bool = False) -> str:
    m = m.lower() if hexadecimal else m
    n, cut = len(m), len(m) // 2
    x, y = m[:cut], m[cut:]

    def moved(own: str, other: str, i: int) -> str:
        pad = hashlib.sha256("|".join([KEY, tweak, str(n), str(i), other]).encode()).hexdigest()
        out = []
        for j, c in enumerate(own):
            step = int(hashlib.sha256(f"{pad}|{j // 16}".encode()).hexdigest()[j % 16 * 4 :][:4], 16)
            kinds = ("0123456789abcdef",) if hexadecimal else ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789")
            own_kind = next((k for k in kinds if c in k), None)
            out.append(own_kind[(own_kind.index(c) + step) % len(own_kind)] if own_kind else c)
        return "".join(out)

    for i in range(ROUNDS):
        if i % 2 == 0:
            x = moved(x, y, i)
        else:
            y = moved(y, x, i)
    return x + y


def card(m: str) -> str:
    d = only(m)
    if luhn(d):
        return m
    body = number(d[:-1], "card")
    return put(m, body + next(c for c in "0123456789" if luhn(body + c) == 0))


def phone(m: str) -> str:
    d = only(m)
    return put(m, d[:-10] + number(d[-10:], "phone"))


def ssn(m: str) -> str:
    areas = [a for a in range(1, 900) if a != 666]
    a, g, s = map(int, m.split("-"))
    if a not in areas or not g or not s:
        return m
    x, y = feistel(areas.index(a) * 99 + g - 1, s - 1, 898 * 99, 9999, "ssn")
    return f"{areas[x // 99]:03d}-{x % 99 + 1:02d}-{y + 1:04d}"


def ip(m: str) -> str:
    o = list(map(int, m.split(".")))
    if max(o) > 255:
        return m
    x, y = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "ip")
    return ".".join(map(str, (x // 256, x % 256, y // 256, y % 256)))


def day(m: str) -> str:
    form = "%Y-%m-%d" if m[4] == "-" else "%Y/%m/%d" if m[4] == "/" else "%d.%m.%Y"
    y, mo, d = map(int, (m[:4], m[5:7], m[8:]) if m[4] in "-/" else (m[6:], m[3:5], m[:2]))
    try:
        n = (date(y, mo, d) - date(1900, 1, 1)).days
    except ValueError:
        return m
    x, z = feistel(n // 4297, n % 4297, 17, 4297, "date")
    return (date(1900, 1, 1) + timedelta(days=x * 4297 + z)).strftime(form)


def iban(m: str) -> str:
    value = lambda t: int("".join(str(int(c, 36)) for c in t)) % 97
    if value(m[4:] + m[:4]) != 1:
        return m
    rest = letters(m[4:], "iban")
    return f"{m[:2]}{98 - value(rest + m[:2] + '00'):02d}{rest}"


def ip6(m: str) -> str:
    groups = len([g for g in m.split(":") if g])
    return letters(m, "ip6", True) if ("::" in m and groups <= 7) or ("::" not in m and groups == 8) else m


def secret(m: str) -> str:
    head = re.match('AKIA|[A-Za-z_]+ ?[=:] ?"?', m)[0]
    return head + letters(m[len(head) :], "secret")


def email(m: str) -> str:
    local, domain = m.split("@")
    return f"{letters(local, 'email')}@{domain}"


#: Where two values begin at one place, the first of this list is taken.
FORMS = (
    (rf"(?<![{AL}])AKIA[A-Z0-9]{{16}}(?![{AL}])", secret),
    (rf"(?<![{AL}])(?i:password|passwd) ?[=:] ?\"?[^\s\"]{{7,}}[^\s\".,;:!?)]", secret),
    (rf"(?<![{AL}])(?i:token|secret|api_key) ?[=:] ?\"?[{AL}_\-]{{8,}}", secret),
    (rf"(?<![{AL}._%+\-])[{AL}._%+\-]+@[{AL}](?:[{AL}.\-]{{0,251}}[{AL}])?\.[A-Za-z]{{2,24}}", email),
    (r"\+[0-9]{1,3}[ \-.]?\(?[0-9]{3}\)?[ \-.]?[0-9]{3}[ \-.]?[0-9]{4}(?![0-9])", phone),
    (r"(?<![0-9])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])", phone),
    (rf"(?<![{AL}_\-.])(?:[0-9]{{3}}-[0-9]{{3}}-[0-9]{{4}}|[0-9]{{3}}\.[0-9]{{3}}\.[0-9]{{4}})(?![{AL}_\-]|\.[0-9])", phone),
    (r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])", ip),
    (rf"(?<![{AL}_:.])(?:{HEX}:){{7}}{HEX}(?![{AL}_:])", ip6),
    (rf"(?<![{AL}_:.])(?:{HEX}:){{1,6}}(?::{HEX}){{1,6}}(?![{AL}_:])", ip6),
    (r"(?<![0-9\-])(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}(?![0-9\-])", day),
    (r"(?<![0-9/])(?:19|20)[0-9]{2}/[0-9]{2}/[0-9]{2}(?![0-9/])", day),
    (r"(?<![0-9.])[0-9]{2}\.[0-9]{2}\.(?:19|20)[0-9]{2}(?![0-9]|\.[0-9])", day),
    (r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])", ssn),
    (rf"(?<![{AL}])[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}(?![{AL}])", iban),
    (rf"(?<![{AL}_\-])(?:[0-9]{{13,19}}|[0-9]{{4}} [0-9]{{4}} [0-9]{{4}} [0-9]{{1,7}}|[0-9]{{4}}-[0-9]{{4}}-[0-9]{{4}}-[0-9]{{1,7}}|[0-9]{{4}} [0-9]{{6}} [0-9]{{4,5}}|[0-9]{{4}}-[0-9]{{6}}-[0-9]{{4,5}})(?![{AL}_\-])", card),
)
_FORMS = [(re.compile(p), f) for p, f in FORMS]


def pseudonyms(text: str | None) -> str | None:
    if text is None:
        return None
    out, at = [], 0
    found = [m for m in ((p.search(text), f) for p, f in _FORMS)]
    while True:
        found = [(m if m is None or m.start() >= at else p.search(text, at), f) for (m, f), (p, _) in zip(found, _FORMS, strict=True)]
        live = [(m.start(), k, m, f) for k, (m, f) in enumerate(found) if m]
        if not live:
            return "".join([*out, text[at:]])
        begin, _, m, f = min(live, key=lambda x: x[:2])
        out += [text[at:begin], f(m[0])]
        at = m.end()
