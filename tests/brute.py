"""Plain Python answers for small inputs, written from the rules and not from the Spark expressions."""

import ipaddress
import re

TOKEN = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-.~+/=")
BREAKS = set(" \t\n\f\r{}[]:=")


def runs(text, inside):
    out, start = [], None
    for i, c in enumerate(text + "\0"):
        ok = i < len(text) and inside(c)
        if ok and start is None:
            start = i
        if not ok and start is not None:
            out.append((start, i))
            start = None
    return out


def after_keys(text, keys):
    found, low = [], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for key in keys:
        at = low.find(key)
        while at >= 0:
            start = at + len(key)
            while start < len(text) and text[start] in " \t\n\f\r:=":
                start += 1
            end = start
            while end < len(text) and text[end] in TOKEN:
                end += 1
            if end - start >= 8:
                found.append((start, end))
            at = low.find(key, max(end, at + len(key)))
    return sorted(found)


def emails(text):
    found = []
    for a, b in runs(text, lambda c: c not in BREAKS):
        raw = text[a:b]
        value = raw.strip("<>(),;\"'")
        lead = len(raw) - len(raw.lstrip("<>(),;\"'"))
        local, sign, domain = value.partition("@")
        if sign and local and "." in domain and domain[0] != "." and domain[-1] != "." and re.fullmatch(
                r"[A-Za-z0-9@._+-]+", value, re.A):
            found.append((a + lead, a + lead + len(value)))
    return found


def jwts(text):
    return [(a, b) for a, b in runs(text, lambda c: c not in BREAKS)
            if re.fullmatch(r"[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", text[a:b])]


def cards(text):
    found = []
    for a, b in runs(text, lambda c: c in "0123456789 -"):
        digits = [int(c) for c in text[a:b] if c.isdigit()]
        total = sum(sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(reversed(digits)))
        if 13 <= len(digits) <= 19 and total % 10 == 0:
            raw = text[a:b]
            found.append((a + len(raw) - len(raw.lstrip(" ")), a + len(raw.rstrip(" "))))
    return found


def ibans(text):
    found = []
    alnum = lambda c: c.isascii() and c.isalnum()
    for start in range(len(text)):
        if start and alnum(text[start - 1]) or not re.match(r"[A-Za-z]{2}[0-9]{2}", text[start:], re.A):
            continue
        compact, best = "", None
        for end in range(start, len(text)):
            c = text[end]
            if alnum(c):
                compact += c.upper()
                moved = compact[4:] + compact[:4]
                if len(compact) >= 15 and int("".join(str(int(x, 36)) for x in moved)) % 97 == 1:
                    best = end + 1
            elif c not in " -":
                break
            if len(compact) == 34:
                break
        if best:
            found.append((start, best))
    return found


def addresses(text):
    found = []
    for a, b in runs(text, lambda c: c in "0123456789abcdefABCDEF.:"):
        raw = text[a:b]
        value = raw.strip(".")
        try:
            ipaddress.ip_address(value)
        except ValueError:
            continue
        if any(len(p) > 1 and p[0] == "0" for p in value.split(".") if "." in value and ":" not in p):
            continue
        lead = len(raw) - len(raw.lstrip("."))
        found.append((a + lead, a + lead + len(value)))
    return found


def database_urls(text):
    found = []
    low = text.lower()
    for scheme in ("mysql://", "mariadb://", "postgres://", "postgresql://"):
        at = low.find(scheme)
        while at >= 0:
            start = at + len(scheme)
            stop = re.search(r"[/?# \n\r]", text[start:])
            end = start + stop.start() if stop else len(text)
            user, sign, _ = text[start:end].rpartition("@")
            name, colon, password = user.partition(":")
            if sign and colon and password:
                found.append((start + len(name) + 1, start + len(user)))
            at = low.find(scheme, end)
    return sorted(found)


def normalize(cwd, path):
    full = path if path.startswith("/") else cwd + "/" + path
    kept = []
    for part in full.split("/"):
        if part == "..":
            kept = kept[:-1]
        elif part not in ("", "."):
            kept.append(part)
    return "/" + "/".join(kept)


def merged(spans):
    """(start, end, rank) spans united by marking covered positions; touching spans unite too."""
    out = []
    for s, e, r in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e), max(out[-1][2], r))
        else:
            out.append((s, e, r))
    return out
