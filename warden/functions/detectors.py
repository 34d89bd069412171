"""Detectors (F1-F15). Each returns an array of spans over one text column.

Every detector first asks a cheap question that most texts answer with no; only
the remaining texts are searched with offsets.
"""

from __future__ import annotations

import re

from warden.functions import sql as F
from warden.functions.sql import Sql

from warden.functions.fields import SPACE, ScanConfig, field_class, raw_name_patterns, trim
from warden.functions.spans import (
    SPAN, before, empty_list, extended, fixed_span, hits, no_spans, span, spans_where, total, whole_list,
)
from warden.vocab import TOKEN_PREFIXES

# --- fixed values: character classes and patterns ---------------------------
TOKEN_CHARS = r"[A-Za-z0-9_\-.~+/=]"
BREAK_CHARS = r" \t\n\f\r{}\[\]:="
TRIM_CHARS = r"""<>(),;"'"""
ANSI = r"\x1b\[[^@-~]*+[@-~]?"
BLOCK_MARKERS = ("|", ">", "|-", ">-", "|+", ">+")
OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4 = rf"(?:{OCTET}\.){{3}}{OCTET}"

# Place of each detector; spans that start and end together keep this order.
ORDER = {
    name: place
    for place, name in enumerate(
        ("pem", "assignment", "table", "authorization", "database_url", "prefix", "configured_prefix",
         "jwt", "email", "context", "card", "iban", "ip")
    )
}


def strip_ansi(text: Sql) -> Sql:
    """the text without terminal colour sequences."""
    return F.when(F.contains(text, F.lit("\x1b")), F.regexp_replace(text, ANSI, "")).otherwise(text)


def unstrip(text: Sql, spans: Sql) -> Sql:
    """Spans of the stripped text, moved back onto the original one."""
    pieces = F.zip_with(
        F.split(text, ANSI, -1), F.regexp_extract_all(text, ANSI, 0),
        lambda gap, cut: F.struct(F.length(gap).alias("gap"), F.coalesce(F.length(cut), F.lit(0)).alias("cut")))

    def moved(position: Sql, cuts: Sql) -> Sql:
        return position + F.aggregate(
            cuts, F.struct(F.lit(0).alias("plain"), F.lit(0).alias("extra")),
            lambda acc, c: F.struct(
                (acc["plain"] + c["gap"]).alias("plain"),
                (acc["extra"] + F.when(acc["plain"] + c["gap"] <= position, c["cut"]).otherwise(0)).alias("extra")),
            lambda acc: acc["extra"])

    shifted = F.let_as(f"array<{SPAN}>", pieces, lambda cuts: F.transform(
        spans,
        lambda s: F.struct(
            moved(s["start"], cuts).alias("start"), (moved(s["end"] - 1, cuts) + 1).alias("end"), s["ord"].alias("ord"),
            s["rank"].alias("rank"), s["category"].alias("category"), s["detector"].alias("detector"),
            s["confidence"].alias("confidence"),
        ).cast(SPAN),
    ))
    return F.when(F.contains(text, "\x1b") & (F.size(spans) > 0), shifted).otherwise(spans)


# a key block up to its own footer, or to the end of the text.
_PEM = (
    r"(?s)-----BEGIN (?=[^\n]*PRIVATE KEY)"
    rf"(?:([^\n]*)-----{SPACE}*\n.*?-----END \1-----|.*)"
)
_PEM_CLOSED = rf"(?s)^-----BEGIN ([^\n]*)-----{SPACE}*\n.*-----END \1-----\z"


def pem_keys(text: Sql) -> Sql:
    return spans_where(
        text, F.contains(text, F.lit("-----BEGIN ")), _PEM,
        lambda h: fixed_span(h["at"], h["at"] + F.length(h["value"]), ORDER["pem"], "credential",
                             "secret.pem_private_key"),
    )


def _ends_name(config: ScanConfig, mark: str) -> str:
    """A ``mark`` character after a sensitive name, or after a long run of white space.

    The search starts at the mark itself, so texts are passed over quickly; names
    followed by a long run are settled later, on the name alone.
    """
    suffix, exact = raw_name_patterns(config)
    return rf"{mark}(?<=(?:(?i:{suffix}|{exact}){SPACE}{{0,8}}|{SPACE}{{9}}){mark})"


def continues(value: Sql) -> Sql:
    """The value of an assignment goes on after its line."""
    def goes_on(v: Sql) -> Sql:
        quote = F.substring(v, 1, 1)
        return (
            (v == "")
            | v.isin(*BLOCK_MARKERS)
            | v.endswith("\\")
            | (quote.isin('"', "'") & ((F.length(v) < 2) | (F.substring(v, -1, 1) != quote)))
        )

    return F.let_as("boolean", value, goes_on)


def _assignment_lines(text: Sql, config: ScanConfig) -> Sql:
    """array<struct(start, end, open, category, detector)> of sensitive ``key=value`` lines."""
    mark = _ends_name(config, "[=:]")
    line = rf"(?dm)^[^=:\n]*+{mark}[^\n]*+"

    def parsed(h: Sql) -> Sql:
        return F.let(
            F.struct(
                (h["at"] + F.length(F.regexp_extract(h["value"], "^[^=:]*", 0)) + 1).alias("at"),
                # No sensitive name is longer than this, and only the end of a longer key counts.
                field_class(
                    F.right(trim(F.regexp_extract(h["value"], "^[^=:]*", 0)), F.lit(160)), config
                ).alias("kind"),
                F.regexp_replace(h["value"], r"^[^=:]*.|\r+\z", "").alias("after"),
            ),
            lambda a: F.when(a["kind"].isNotNull(), F.let(
                continues(trim(F.regexp_extract(h["value"], r"(?s)^[^=:]*.(.*)", 1))),
                lambda is_open: F.struct(
                    F.when(is_open, a["at"])
                    .otherwise(a["at"] + F.length(F.regexp_extract(a["after"], rf"^{SPACE}*", 0)))
                    .alias("start"),
                    F.when(is_open, F.length(text)).otherwise(a["at"] + F.length(a["after"])).alias("end"),
                    is_open.alias("open"),
                    a["kind"]["category"].alias("category"),
                    a["kind"]["detector"].alias("detector"),
                ),
            )),
        )

    sensitive = lambda v: field_class(
        F.right(trim(F.regexp_extract(v, "^[^=:]*", 0)), F.lit(160)), config).isNotNull()
    lines = F.filter(F.transform(hits(text, line, sensitive), parsed), lambda a: a.isNotNull())
    return F.when(text.rlike(mark), lines)


def assignments(text: Sql, config: ScanConfig) -> Sql:
    """values of sensitive keys; an unfinished value hides the rest of the text."""

    def kept(lines: Sql) -> Sql:
        first_open = F.array_position(F.transform(lines, lambda a: a["open"]), F.lit(True)).cast("int")
        return F.when(first_open > 0, F.slice(lines, F.lit(1), first_open)).otherwise(lines)

    built = F.transform(
        F.let(_assignment_lines(text, config), kept),
        lambda a: span(a["start"], a["end"], ORDER["assignment"], a["category"], a["detector"]),
    )
    return F.coalesce(F.filter(built, lambda s: s["start"] < s["end"]), no_spans())


def open_context(text: Sql, config: ScanConfig = ScanConfig()) -> Sql:
    """a value or key block that starts here and does not end here."""
    plain = strip_ansi(text)
    lines = F.exists(_assignment_lines(plain, config), lambda a: a["open"])
    blocks = F.when(
        F.contains(plain, F.lit("-----BEGIN ")),
        F.exists(F.regexp_extract_all(plain, F.lit(_PEM), F.lit(0)), lambda b: ~b.rlike(_PEM_CLOSED)),
    )
    return ~text.rlike(r"""^\s*+[{\["]""") & (F.coalesce(lines, F.lit(False)) | F.coalesce(blocks, F.lit(False)))


# sensitive columns of delimited text tables.
SEPARATOR_LINE = r"^(?=.*[^\s])[\s|+\-=:]*\z"


def _cells(line: Sql, delimiter: Sql) -> Sql:
    return F.when(delimiter == "|", F.split(line, r"\|", -1)).otherwise(F.split(line, "\t", -1))


def tables(text: Sql, config: ScanConfig) -> Sql:
    likely = (F.contains(text, F.lit("|")) | F.contains(text, F.lit("\t"))) & text.rlike(
        _ends_name(config, r"[|\t\r\n]")
    )
    kinds_type = "array<struct<category:string,detector:string>>"
    start = F.struct(
        F.lit(0).alias("pos"), F.lit("").alias("delimiter"),
        F.expr(f"cast(array() as {kinds_type})").alias("kinds"), *empty_list(SPAN),
    )

    def state(pos: Sql, delimiter: Sql, kinds: Sql, acc: Sql, more: Sql | None = None) -> Sql:
        found = (acc["full"].alias("full"), acc["out"].alias("out")) if more is None else extended(acc, more)
        return F.struct(pos.alias("pos"), delimiter.alias("delimiter"), kinds.alias("kinds"), *found)

    def cell_spans(acc: Sql, row: Sql) -> Sql:
        """Spans of the cells below sensitive headers."""
        placed = F.aggregate(
            F.pairs(row.alias("cell"), acc["kinds"].alias("kind")),
            F.struct(acc["pos"].alias("pos"), no_spans().alias("out")),
            lambda a, c: F.struct(
                (a["pos"] + F.length(c["cell"]) + 1).alias("pos"),
                F.when(c["kind"].isNull(), a["out"]).otherwise(
                    F.array_append(
                        a["out"],
                        span(
                            a["pos"] + F.length(F.regexp_extract(c["cell"], rf"^{SPACE}*", 0)),
                            a["pos"] + F.length(F.regexp_replace(c["cell"], rf"{SPACE}+\z", "")),
                            ORDER["table"], c["kind"]["category"], c["kind"]["detector"],
                        ),
                    )
                ).alias("out"),
            ),
            lambda a: F.filter(a["out"], lambda s: s["start"] < s["end"]),
        )
        return placed

    def header(acc: Sql, line: Sql, pos: Sql) -> Sql:
        own = F.when(F.contains(line, F.lit("|")), F.lit("|")).otherwise(F.lit("\t"))
        kinds = F.transform(_cells(line, own), lambda c: field_class(trim(c), config)).cast(kinds_type)
        closed = state(pos, F.lit(""), F.expr(f"cast(array() as {kinds_type})"), acc)
        return F.when(
            F.contains(line, F.lit("|")) | F.contains(line, F.lit("\t")),
            F.let(kinds, lambda k: F.when(
                (F.size(k) >= 2) & F.exists(k, lambda x: x.isNotNull()), state(pos, own, k, acc)
            ).otherwise(closed)),
        ).otherwise(closed)

    def step(acc: Sql, raw: Sql) -> Sql:
        line = F.regexp_replace(raw, r"\r+\z", "")
        pos = acc["pos"] + F.length(raw) + 1
        active = acc["delimiter"] != ""
        row = _cells(line, acc["delimiter"])
        is_row = active & F.contains(line, acc["delimiter"]) & (F.size(row) == F.size(acc["kinds"]))
        return (
            F.when(active & line.rlike(SEPARATOR_LINE), state(pos, acc["delimiter"], acc["kinds"], acc))
            .when(is_row, state(pos, acc["delimiter"], acc["kinds"], acc, cell_spans(acc, row)))
            .otherwise(header(acc, line, pos))
        )

    folded = F.aggregate(F.split(text, "\n", -1), start, step, whole_list)
    return F.when(likely, folded).otherwise(no_spans())


def _after_key(text: Sql, likely: Sql, key: str, ord_: int, category: str, detector: str) -> Sql:
    """Token of eight or more characters that follows ``key``."""
    head = rf"(?i){key}[ \t\n\f\r:=]*+"
    return spans_where(
        text, likely, head + TOKEN_CHARS + "*+",
        lambda h: fixed_span(
            h["at"] + F.length(F.regexp_extract(h["value"], "^" + head, 0)),
            h["at"] + F.length(h["value"]), ord_, category, detector,
        ),
        lambda v: (F.length(v) - F.length(F.regexp_extract(v, "^" + head, 0))) >= 8,
    )


def authorization(text: Sql, low: Sql) -> Sql:
    """F3."""
    keys = ("authorization", "bearer")
    return F.concat(*[
        _after_key(text, F.contains(low, F.lit(key)), key, ORDER["authorization"], "authentication",
                   "secret.authorization")
        for key in keys
    ])


def context_values(text: Sql, low: Sql) -> Sql:
    """F9."""
    personal = [
        _after_key(text, F.contains(low, F.lit(key)), key, ORDER["context"], "personal_data",
                   "personal.context_value")
        for key in ("phone", "telephone", "date_of_birth", "birth_date")
    ]
    auth = [
        _after_key(text, F.contains(low, F.lit(key)), key, ORDER["context"], "authentication",
                   "authentication.structured_value")
        for key in ("cookie", "session")
    ]
    return F.concat(*personal, *auth)


def database_urls(text: Sql, low: Sql) -> Sql:
    """the password of ``scheme://user:password@host``."""
    parts = r"(?s)^([A-Za-z]+://[^:]*:)(.*)@"

    def build(h: Sql) -> Sql:
        before = F.length(F.regexp_extract(h["value"], parts, 1))
        return fixed_span(
            h["at"] + before, h["at"] + before + F.length(F.regexp_extract(h["value"], parts, 2)),
            ORDER["database_url"], "credential", "secret.database_url",
        )

    return F.concat(*[
        spans_where(text, F.contains(low, F.lit(scheme + "://")), rf"(?i){scheme}://[^/?# \n\r]*+", build,
                    lambda v: v.rlike(parts))
        for scheme in ("mysql", "mariadb", "postgres", "postgresql")
    ])


def _prefix_regex(prefixes: tuple[tuple[str, int], ...]) -> str:
    return "|".join(
        f"{re.escape(prefix)}{TOKEN_CHARS}{{{max(minimum - len(prefix), 0)},}}" for prefix, minimum in prefixes
    )


def provider_tokens(text: Sql) -> Sql:
    """F5."""

    def found(detector: str, prefixes: tuple[tuple[str, int], ...]) -> Sql:
        # Nearly all prefixes hold one of two rare characters; without it nothing is searched.
        words = [p for p, _ in prefixes]
        rare = next((c for c in "_-" if all(c in w for w in words)), None)
        gate = F.any_of(text, words) if rare is None else F.contains(text, F.lit(rare)) & F.any_of(text, words)
        return spans_where(
            text, gate, _prefix_regex(prefixes),
            lambda h: fixed_span(h["at"], h["at"] + F.length(h["value"]), ORDER["prefix"], "credential",
                                 detector),
        )

    return F.concat(*[found(name, prefixes) for name, prefixes in TOKEN_PREFIXES.items()])


def configured_tokens(text: Sql, config: ScanConfig) -> Sql:
    """F6."""
    if not config.prefixes:
        return no_spans()
    return F.concat(*[
        spans_where(
            text, F.contains(text, F.lit(prefix)), _prefix_regex(((prefix, len(prefix) + 8),)),
            lambda h: fixed_span(h["at"], h["at"] + F.length(h["value"]), ORDER["configured_prefix"],
                                 "credential", "configured.secret_prefix"),
        )
        for prefix in config.prefixes
    ])


def jwts(text: Sql) -> Sql:
    """a whole token of three dotted parts."""
    part = r"[A-Za-z0-9_\-]{8,}+"
    regex = rf"(?<![^{BREAK_CHARS}]){part}\.{part}\.{part}(?![^{BREAK_CHARS}])"
    return spans_where(
        text, text.rlike(r"\.[A-Za-z0-9_\-]{8,}+\."), regex,
        lambda h: fixed_span(h["at"], h["at"] + F.length(h["value"]), ORDER["jwt"], "authentication",
                             "secret.jwt"),
    )


def emails(text: Sql) -> Sql:
    """F8: a whole token that is an address once its punctuation is trimmed."""
    address = r"[A-Za-z0-9._\-+]++@[A-Za-z0-9@._\-+]++"
    regex = rf"(?<![^{BREAK_CHARS}])[{TRIM_CHARS}]*+{address}[{TRIM_CHARS}]*+(?![^{BREAK_CHARS}])"

    def dotted(value: Sql) -> Sql:
        domain = F.regexp_extract(value, r"^[^@]+@([A-Za-z0-9@._\-+]+)", 1)
        return F.contains(domain, F.lit(".")) & ~domain.startswith(".") & ~domain.endswith(".")

    def build(h: Sql) -> Sql:
        lead = F.length(F.regexp_extract(h["value"], rf"^[{TRIM_CHARS}]*", 0))
        size = F.length(F.regexp_extract(h["value"], address, 0))
        return fixed_span(h["at"] + lead, h["at"] + lead + size, ORDER["email"], "personal_data",
                          "personal.email", "medium")

    return spans_where(text, F.contains(text, F.lit("@")), regex, build, dotted)


CARD_DIGITS = r"(?:[0-9][ \-]*+){13}"


def payment_cards(text: Sql) -> Sql:
    """a maximal run of digits, spaces and hyphens that passes the Luhn test."""
    regex = r"(?<![0-9 \-])[ \-]*+(?:[0-9][ \-]*+){13,19}+(?![0-9 \-])"

    def build(h: Sql) -> Sql:
        lead = F.length(h["value"]) - F.length(F.ltrim(h["value"]))
        return fixed_span(h["at"] + lead, h["at"] + F.length(F.rtrim(h["value"])), ORDER["card"],
                          "financial_data", "financial.payment_card")

    return spans_where(text, text.rlike(CARD_DIGITS), regex, build,
                       lambda v: F.luhn_check(F.translate(v, " -", "")))


def _account_size(value: Sql) -> Sql:
    """Written length of the longest prefix that is an account number, NULL without one.

    The first four characters count at the end of the number; they are six digits
    once letters are read as 10..35, so the remainder of any prefix follows from a
    running remainder of the characters after them.
    """
    digits = lambda c: F.when(c.rlike("[0-9]"), c).otherwise((F.ascii(F.upper(c)) - 55).cast("string"))
    moved = F.concat(*[digits(F.substring(value, n, 1)) for n in (1, 2)], F.substring(value, 3, 2)).cast("int")

    def walk(six: Sql) -> Sql:
        def step(acc: Sql, c: Sql) -> Sql:
            counts = c["char"].rlike("[A-Za-z0-9]")
            rest = F.when(c["char"].rlike("[0-9]"), acc["rest"] * 10 + F.ascii(c["char"]) - 48).otherwise(
                acc["rest"] * 100 + F.ascii(F.upper(c["char"])) - 55) % 97
            return F.when(~counts, acc).otherwise(F.let(rest, lambda r: F.struct(
                r.cast("int").alias("rest"), (acc["n"] + 1).alias("n"),
                F.when((acc["n"] + 1 >= 15) & ((r * 1000000 + six) % 97 == 1), c["i"] + 5).otherwise(acc["size"])
                .cast("int").alias("size"))))

        chars = F.transform(F.split(value.substr(5, F.length(value)), "(?<=.)(?=.)"),
                            lambda c, i: F.struct(c.alias("char"), i.alias("i")))
        return F.aggregate(
            chars, F.struct(F.lit(0).alias("rest"), F.lit(4).alias("n"), F.expr("cast(null as int)").alias("size")),
            step, lambda acc: acc["size"])

    return F.let_as("int", moved, walk)


def ibans(text: Sql) -> Sql:
    """from every word start, the longest prefix that passes the mod-97 test.

    Starts may overlap, so they are found with a zero-width pattern; the text is
    given one extra leading character so that the first piece never is a match.
    """
    run = r"[A-Za-z]{2}[0-9]{2}(?:[ \-]*[A-Za-z0-9]){11,30}"
    zero = rf"(?<![A-Za-z0-9])(?={run})"
    shifted = F.concat(F.lit("\n"), text)
    found = F.regexp_extract_all(shifted, rf"(?<![A-Za-z0-9])(?=({run}))", 1)
    pairs = F.let(found, lambda f: F.zip_with(
        F.slice(F.split(shifted, zero, -1), 1, F.size(f)), f,
        lambda gap, value: F.struct(F.length(gap).alias("gap"), _account_size(value).alias("size"))))
    placed = F.let(pairs, lambda found: F.filter(F.zip_with(
        found, before(F.transform(found, lambda p: p["gap"]), 0, total),
        lambda p, at: F.when(p["size"].isNotNull(), fixed_span(
            at + p["gap"] - 1, at + p["gap"] - 1 + p["size"], ORDER["iban"], "financial_data", "financial.iban"))), lambda s: s.isNotNull()))
    likely = text.rlike(r"[0-9]{2}(?<=[A-Za-z]{2}[0-9]{2})(?:[ \-]*[A-Za-z0-9]){11}")
    return F.when(likely, placed).otherwise(no_spans())


def _ipv6() -> str:
    group = "[0-9A-Fa-f]{1,4}"
    last = f"(?:{group}:{group}|{IPV4})"
    forms = [f"(?:{group}:){{6}}{last}"]
    for head in range(0, 8):
        front = f"(?:(?:{group}:){{0,{head - 1}}}{group})?" if head else ""
        tail = 5 - head
        if tail >= 0:
            forms.append(f"{front}::(?:{group}:){{{tail}}}{last}")
        elif tail == -1:
            forms.append(f"{front}::{group}")
        else:
            forms.append(f"{front}::")
    return "|".join(forms)


def ip_addresses(text: Sql) -> Sql:
    """a maximal run of hex digits, dots and colons that is an address."""
    edge = "0-9A-Fa-f.:"

    def whole(address: str) -> str:
        return rf"(?<![{edge}])\.*+(?:{address})\.*+(?![{edge}])"

    def build(h: Sql) -> Sql:
        lead = F.length(F.regexp_extract(h["value"], r"^\.*", 0))
        size = F.length(F.regexp_replace(h["value"], r"^\.+|\.+\z", ""))
        return fixed_span(h["at"] + lead, h["at"] + lead + size, ORDER["ip"], "personal_data",
                          "personal.ip_address", "medium")

    return F.concat(
        spans_where(text, text.rlike(r"\.[0-9]{1,3}+\.[0-9]"), whole(IPV4), build),
        spans_where(text, text.rlike(r":[0-9A-Fa-f]{0,4}+:"), whole(_ipv6()), build),
    )


def detect(text: Sql, config: ScanConfig = ScanConfig()) -> Sql:
    """All spans of one text, unmerged, offsets on the text as given."""

    def search(plain: Sql, low: Sql) -> Sql:
        found = [
            pem_keys(plain), assignments(plain, config), tables(plain, config),
            authorization(plain, low), database_urls(plain, low), provider_tokens(plain),
            configured_tokens(plain, config), jwts(plain), emails(plain), context_values(plain, low),
            payment_cards(plain), ibans(plain),
        ]
        if config.ip_personal:
            found.append(ip_addresses(plain))
        return F.concat(*found)

    spans = F.let_as(f"array<{SPAN}>", strip_ansi(text), lambda plain: F.let_as(f"array<{SPAN}>", F.lower(plain), lambda low: search(plain, low)))
    return F.let_as(f"array<{SPAN}>", spans, lambda found: unstrip(text, found))
