"""Scalar functions as column expressions: times, addresses, typed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Strptime directives and the JVM's letters for them.
STRPTIME = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "e": "d", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "p": "a", "b": "MMM",
    "h": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "j": "DDD", "z": "xx", ":z": "xxx", "Z": "z", "f": "SSSSSSSSS",
    "3f": "SSS", "6f": "SSSSSS", "9f": "SSSSSSSSS", ".f": "[.SSSSSSSSS][.SSSSSS][.SSS]", ".3f": ".SSS", ".6f": ".SSSSSS",
    "T": "HH:mm:ss", "F": "yyyy-MM-dd", "D": "MM/dd/yy", "R": "HH:mm", "%": "%",
}

_RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


def strptime_pattern(text: str) -> str:
    """A strptime format in the JVM's letters."""
    out, at, plain = [], 0, ""

    def flush() -> None:
        nonlocal plain
        if plain:
            out.append("'" + plain.replace("'", "''") + "'" if any(c.isalpha() for c in plain) else plain.replace("'", "''"))
            plain = ""

    while at < len(text):
        if text[at] != "%":
            plain += text[at]
            at += 1
            continue
        name = next((text[at + 1 : at + 1 + n] for n in (3, 2, 1) if text[at + 1 : at + 1 + n] in STRPTIME), None)
        if name is None:
            raise ValueError(f"unknown directive in {text!r}")
        flush()
        out.append(STRPTIME[name])
        at += 1 + len(name)
    flush()
    return "".join(out)


def parse_time(text: Column, kind: str) -> Column:
    """``iso8601`` (RFC 3339 with offset), ``epoch``, ``epoch_ms`` or a strptime format; null where it does not parse."""
    if kind == "iso8601":
        return F.when(text.rlike(_RFC3339), F.try_to_timestamp(text))
    if kind == "epoch":
        return F.timestamp_seconds(text.try_cast("bigint"))
    if kind == "epoch_ms":
        return F.timestamp_millis(text.try_cast("bigint"))
    return F.try_to_timestamp(text, F.lit(strptime_pattern(kind)))


def normalise_ip(x: Column) -> Column:
    """Dotted quads lose leading zeros; quads that are no address are null; anything else stays."""
    parts = F.split(x, "[.]")
    octets = F.transform(parts, lambda p: F.when(p.rlike("^[0-9]{1,9}$"), p.cast("int")))
    good = F.forall(octets, lambda o: o.isNotNull() & (o <= 255))
    return F.when(F.size(parts) != 4, x).when(good, F.array_join(F.transform(octets, lambda o: o.cast("string")), "."))


def normalise_mac(x: Column) -> Column:
    """Twelve hexadecimal digits, lower case, by colons; else null."""
    digits = F.lower(F.regexp_replace(x, "[^0-9A-Fa-f]", ""))
    pairs = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.substring(digits, i * 2 + 1, F.lit(2)))
    return F.when(F.length(digits) == 12, F.array_join(pairs, ":"))


def typed(x: Column, kind: str) -> Column:
    """A value by its attribute's type; null if it is none."""
    if kind == "ip":
        return normalise_ip(x)
    if kind == "mac":
        return normalise_mac(x)
    if kind == "int":
        return F.when(x.rlike("^[+-]?[0-9]+$"), x.try_cast("bigint"))
    if kind == "float":
        return F.when(~x.rlike(r"^\s|\s$|[dDfF]$"), x.try_cast("double"))
    return x


