"""URL expressions: validity, origin, resolution of relative references, host classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ramparts import rules
from ramparts.functions.text import WS, let

_WEB_SCHEME = r"(?i)^(?:https?|wss?|ftp):"
_WEB_URL = (r"(?i)^(?:https?|wss?|ftp):[/\\]{2}(?:[^/?#\\@]*@)?"
            r"(?:\[[0-9a-f:.]+\]|[^\x00-\x20\x7f/?#:@<>\[\]\\^|%]+)(?::\d{0,5})?(?:[/?#\\][\s\S]*)?$")
_OTHER_URL = r"(?i)^[a-z][a-z0-9+.\-]*:"
_PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*)://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)(?::(\d*))?"
_PRIVATE_NAME = r"(?i)^(localhost|[\s\S]*\.local|[\s\S]*\.internal)$"


def is_valid(url: Column) -> Column:
    text = F.regexp_replace(url, f"^{WS}+|{WS}+$", "")
    port = F.regexp_extract(text, r"(?i)^[a-z]+://(?:[^/?#@]*@)?(?:\[[^\]]*\]|[^/?#:]*):(\d+)", 1)
    return F.coalesce(
        F.when(text.rlike(_WEB_SCHEME), text.rlike(_WEB_URL) & ((port == "") | (port.cast("int") <= 65535)))
        .otherwise(text.rlike(_OTHER_URL)), F.lit(False))


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _PARTS, 1))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _PARTS, 2))


def is_https(url: Column) -> Column:
    return F.lower(F.left(url, F.lit(6))) == "https:"


def origin(url: Column) -> Column:
    """Scheme, host and non-default port, lower-cased."""
    port = F.regexp_extract(url, _PARTS, 3)
    default = ((scheme(url) == "https") & (port == "443")) | ((scheme(url) == "http") & (port == "80"))
    return F.concat(scheme(url), F.lit("://"), host(url),
                    F.when((port == "") | default, F.lit("")).otherwise(F.concat(F.lit(":"), port)))


def path_and_query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([\s\S]*)$", 1)


def fold_path(path: Column) -> Column:
    """Remove ``.`` and ``..`` segments of an absolute path."""
    segments = F.split(F.regexp_replace(path, "^/", ""), "/", -1)
    last = F.regexp_extract(path, "([^/]*)$", 1)
    kept = F.aggregate(
        segments, F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc).otherwise(F.concat(acc, F.array(s))))
    ends_open = F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.concat(F.lit("/"), F.array_join(ends_open, "/"))


def resolve(reference: Column, base: Column) -> Column:
    """A reference as seen from page ``base``; null if the result is no valid URL."""
    ref = F.regexp_replace(F.regexp_replace(reference, f"^{WS}+|{WS}+$", ""), r"[\t\n\r]", "")
    base_path = F.regexp_extract(path_and_query(base), r"^([^?#]*)", 1)

    def absolute_form(v: Column) -> Column:
        r = v["ref"]
        return (F.when(r.rlike(r"(?i)^https?://"), r)
                .when(r.startswith("//"), F.concat(v["scheme"], F.lit(":"), r))
                .when(r.rlike(r"(?i)^[a-z][a-z0-9+.\-]*:"), r)
                .when(r == "", F.concat(v["origin"], v["path"], v["query"]))
                .when(r.startswith("#"), F.concat(v["origin"], v["path"], v["query"], r))
                .when(r.startswith("?"), F.concat(v["origin"], v["path"], r))
                .when(r.startswith("/"), F.concat(v["origin"], r))
                .otherwise(F.concat(v["origin"], F.regexp_extract(v["path"], r"^([\s\S]*/)[^/]*$", 1), r)))

    def tidy(url: Column) -> Column:
        path = F.regexp_extract(path_and_query(url), r"^([^?#]*)", 1)
        rest = F.regexp_extract(path_and_query(url), r"^[^?#]*([\s\S]*)$", 1)
        web = F.concat(origin(url), let(path, fold_path), rest)
        return F.when(is_valid(url), F.when(url.rlike(r"(?i)^https?://"), web).otherwise(url))

    parts = F.struct(ref.alias("ref"), scheme(base).alias("scheme"), origin(base).alias("origin"),
                     F.when(base_path == "", F.lit("/")).otherwise(base_path).alias("path"),
                     F.regexp_extract(path_and_query(base), r"^[^?#]*(\?[^#]*)", 1).alias("query"))
    return let(let(parts, absolute_form), tidy)


def has_sensitive_parameter(url: Column) -> Column:
    return url.rlike(rules.SENSITIVE_QUERY)


def _number(part: Column) -> Column:
    """A part of a numeric host: decimal, octal with a leading 0, hexadecimal with 0x; null for anything else."""
    return (F.when(part.rlike(r"^0x[0-9a-f]{0,16}\z"), F.conv(F.concat(F.lit("0"), F.regexp_replace(part, "^0x", "")), 16, 10))
            .when(part.rlike(r"^0[0-7]{1,20}\z"), F.conv(part, 8, 10)).when(part.rlike(r"^(?:0|[1-9][0-9]{0,18})\z"), part)).try_cast("decimal(20,0)")


def _v4_value(name: Column) -> Column:
    """The number of a host of one to four numeric parts; the last part fills the bytes that are left. Null if it does not fit."""
    def whole(numbers: Column) -> Column:
        n = F.size(numbers)
        lead = F.slice(numbers, F.lit(1), F.greatest(n - 1, F.lit(0)))
        last = F.element_at(numbers, -1)
        room = F.get(F.array(*[F.lit(1 << 8 * k).cast("decimal(20,0)") for k in (4, 3, 2, 1)]), n - 1)
        fits = (n <= 4) & F.forall(numbers, lambda x: x.isNotNull()) & F.forall(lead, lambda x: x < 256) & (last < room)
        high = F.aggregate(F.transform(lead, lambda x, i: x.cast("bigint") * F.pow(F.lit(256), 3 - i).cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s + x)
        return F.when(fits, high + last.cast("bigint"))
    return let(F.transform(F.split(F.regexp_replace(name, r"\.\z", ""), r"\."), _number), whole)


def _v6_digits(name: Column) -> Column:
    """The 32 hexadecimal digits of an IPv6 address, with ``::`` filled up and a dotted tail turned into two groups; null if it is none."""
    tail = F.regexp_extract(name, r"([^:]*)\z", 1)
    dotted = tail.contains(".")

    def joined(v: Column) -> Column:
        low = F.lpad(F.lower(F.hex(v["v4"])), 8, "0")
        return F.when(dotted, F.when(v["strict"], F.concat(F.regexp_replace(name, r"[^:]*\z", ""), F.left(low, F.lit(4)), F.lit(":"), F.right(low, F.lit(4))))).otherwise(name)
    strict = tail.rlike(r"^(?:(?:0|[1-9][0-9]{0,2})(?:\.|\z)){4}\z") & ~tail.endswith(".")
    plain = let(F.struct(_v4_value(tail).alias("v4"), strict.alias("strict")), joined)

    def groups(text: Column) -> Column:
        return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ":", -1))

    def filled(v: Column) -> Column:
        left, right = v["left"], v["right"]
        missing = 8 - F.size(left) - F.size(right)
        right_number = F.when(v["short"], missing >= 1).otherwise(missing == 0)
        every = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), right)
        good = right_number & F.forall(every, lambda g: g.rlike(r"^[0-9a-f]{1,4}\z"))
        return F.when(good, F.array_join(F.transform(every, lambda g: F.lpad(g, 4, "0")), ""))

    def halves(text: Column) -> Column:
        short = text.contains("::")
        left = F.when(short, F.substring_index(text, "::", 1)).otherwise(text)
        right = F.when(short, F.regexp_replace(text, r"^[\s\S]*?::", "")).otherwise(F.lit(""))
        return let(F.struct(short.alias("short"), groups(left).alias("left"), groups(right).alias("right")), filled)
    return let(plain, halves)


def _v4_class(value: Column) -> Column:
    def within(*nets: tuple[str, int]) -> Column:
        hit = F.lit(False)
        for net, bits in nets:
            low = sum(int(o) << 8 * (3 - i) for i, o in enumerate(net.split(".")))
            hit = hit | value.between(low, low + (1 << 32 - bits) - 1)
        return hit
    return (F.when(within(("127.0.0.0", 8)), "loopback").when(within(("0.0.0.0", 8), ("10.0.0.0", 8), ("172.16.0.0", 12), ("192.168.0.0", 16)), "private")
            .when(within(("169.254.0.0", 16)), "link-local").when(within(("100.64.0.0", 10)), "carrier-nat").otherwise("public"))


def host_class(url: Column) -> Column:
    """``public`` or the reason why a literal host is not; names are not looked up.

    Hosts that end in a number are IPv4 in any of its spellings (``127.1``, ``0x7f.1``, ``2130706433``), hosts in
    brackets are IPv6 in any of its; numbers that are no address are ``invalid``.
    """
    def judged(v: Column) -> Column:
        digits, value, name = v["digits"], v["value"], v["name"]
        mapped = F.conv(F.right(digits, F.lit(8)), 16, 10).cast("bigint")
        six = (F.when(digits.isNull(), "invalid").when(digits.rlike("^0{20}ffff"), _v4_class(mapped))
               .when(digits.rlike(r"^0{31}[01]\z"), "loopback").when(digits.rlike("^f[cd]"), "private").when(digits.rlike("^fe[89ab]"), "link-local").otherwise("public"))
        return (F.when(name.startswith("["), six).when(v["numeric"], F.when(value.isNull(), "invalid").otherwise(_v4_class(value))).otherwise("public"))
    name = F.lower(host(url))
    numeric = name.rlike(r"(?:^|\.)(?:[0-9]+|0x[0-9a-f]*)\.?\z")
    inner = F.regexp_replace(name, r"^\[|\]\z", "")
    parts = F.struct(name.alias("name"), numeric.alias("numeric"), F.when(numeric, _v4_value(name)).alias("value"), F.when(name.startswith("["), _v6_digits(inner)).alias("digits"))
    return (F.when(~is_valid(url) | ~scheme(url).isin("http", "https"), "invalid")
            .when(F.regexp_replace(name, r"^\[|\]\z", "").rlike(_PRIVATE_NAME), "private-name").otherwise(let(parts, judged)))
