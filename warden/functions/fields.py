"""Field-name sensitivity (P26) and the scan configuration it reads."""

from __future__ import annotations

from dataclasses import dataclass, field

from warden.functions import sql as F
from warden.functions.sql import Sql

from warden.vocab import FIELD_DETECTORS, FIELD_WORDS

# Unicode white space other than the line feed.
SPACE = r"[\p{IsWhite_Space}&&[^\n]]"
# Characters that count as one underscore inside a raw field name.
_JOINT = r"[^A-Za-z0-9=:\n\x80-\x{10FFFF}]"


@dataclass(frozen=True)
class ScanConfig:
    """What a policy adds to the detectors."""

    prefixes: tuple[str, ...] = ()
    fields: dict[str, str] = field(default_factory=dict)
    ip_personal: bool = False

    def normalized_fields(self) -> dict[str, str]:
        return {name.lower().replace("-", "_"): category for name, category in self.fields.items()}


def trim(text: Sql) -> Sql:
    return F.regexp_replace(text, rf"^(?:{SPACE}|\n)+|(?:{SPACE}|\n)+\z", "")


def normalize_name(name: Sql) -> Sql:
    """Lower case, every byte that is no letter or digit as one underscore."""
    ascii_only = F.regexp_replace(
        F.regexp_replace(name, r"[^\x00-\x{FFFF}]", "____"), r"[^\x00-\x{7FF}]", "___"
    )
    ascii_only = F.regexp_replace(ascii_only, r"[^\x00-\x7F]", "__")
    return F.lower(F.regexp_replace(ascii_only, "[^A-Za-z0-9]", "_"))


def field_class(name: Sql, config: ScanConfig = ScanConfig()) -> Sql:
    """struct(category, detector) of a field name, NULL when it is not sensitive."""
    return F.let(normalize_name(name), lambda normal: normalized_class(normal, config))


def normalized_class(normal: Sql, config: ScanConfig = ScanConfig()) -> Sql:
    ladder = None
    for category, suffixes, names in FIELD_WORDS:
        test = normal.rlike(rf"(?:^|_)(?:{'|'.join(suffixes)})\z")
        if names:
            test = test | normal.isin(*names)
        value = F.struct(
            F.lit(category).alias("category"), F.lit(FIELD_DETECTORS[category]).alias("detector")
        )
        ladder = F.when(test, value) if ladder is None else ladder.when(test, value)
    for name, category in config.normalized_fields().items():
        ladder = ladder.when(
            normal == name,
            F.struct(
                F.lit(category).alias("category"),
                F.lit("configured.sensitive_field").alias("detector"),
            ),
        )
    return ladder


def field_category(name: Sql, config: ScanConfig = ScanConfig()) -> Sql:
    return field_class(name, config)["category"]


def static_category(name: str, config: ScanConfig = ScanConfig()) -> str | None:
    """The same ladder for a column name known when the plan is built."""
    normal = "".join(
        chr(b).lower() if chr(b).isascii() and chr(b).isalnum() else "_" for b in name.encode()
    )
    for category, suffixes, names in FIELD_WORDS:
        if normal in names or any(normal == w or normal.endswith("_" + w) for w in suffixes):
            return category
    return config.normalized_fields().get(normal)


def raw_name_patterns(config: ScanConfig) -> tuple[str, str]:
    """Regexes for raw names: (words that may end a name, names matched whole)."""
    suffixes = [w for _, words, _ in FIELD_WORDS for w in words]
    exact = [n for _, _, names in FIELD_WORDS for n in names] + list(config.normalized_fields())
    return tuple(
        "|".join(_JOINT.join(word.split("_")) for word in group) for group in (suffixes, exact)
    )
