"""Column expressions: addresses, processes, masks, shapes and local time. All stay inside code generation."""

from __future__ import annotations

import ipaddress
import re
import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as V


def _case(pairs: list[tuple[Column, str]], other: str | None = None) -> Column:
    out = reduce(lambda c, p: c.when(p[0], F.lit(p[1])), pairs[1:], F.when(pairs[0][0], F.lit(pairs[0][1])))
    return out.otherwise(F.lit(other)) if other is not None else out


def ipv4_number(ip: Column) -> Column:
    """The address as a number; only for strict IPv4 texts."""
    part = [F.split_part(ip, F.lit("."), F.lit(i)).try_cast("bigint") for i in range(1, 5)]
    return part[0] * 16777216 + part[1] * 65536 + part[2] * 256 + part[3]


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _v6_groups(ip: Column) -> Column:
    """The eight groups of an IPv6 text as numbers (array of int), null where it is none.

    The double colon is filled with as many zeros as are missing; a trailing IPv4 part becomes two groups.
    """

    def plain(v: Column) -> Column:
        tail = F.regexp_extract(v, r":((?:\d{1,3}\.){3}\d{1,3})$", 1)
        number = let(tail, lambda t: ipv4_number(F.when(t.rlike(V.STRICT_IPV4), t)))
        as_groups = let(number, lambda n: F.concat(F.regexp_replace(v, r"[0-9.]+$", ""), F.hex(F.shiftright(n, 16)), F.lit(":"), F.hex(n.bitwiseAND(65535))))
        return F.when(v.rlike(r"\."), F.lower(as_groups)).otherwise(v)

    def parts(text: Column) -> Column:
        return F.filter(F.split(text, ":"), lambda x: x != "")

    def filled(sides: Column) -> Column:
        left, right = sides["left"], sides["right"]
        missing = 8 - F.size(left) - F.size(right)
        return F.when(sides["gap"] & (missing >= 1), F.concat(left, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), right)).when(~sides["gap"] & (F.size(left) == 8), left)

    def groups(v: Column) -> Column:
        halves = F.split(v, "::", 2)
        sides = let(halves, lambda h: F.struct(parts(F.get(h, F.lit(0))).alias("left"), F.coalesce(parts(F.get(h, F.lit(1))), F.array().cast("array<string>")).alias("right"), (F.size(h) == 2).alias("gap")))
        found = let(sides, filled)
        fine = v.rlike(r"^[0-9a-f:]+$") & ~v.rlike(r":::|::.*::|^:[^:]|[^:]:$")
        return F.when(fine, let(found, lambda g: F.when(F.forall(g, lambda x: F.length(x) <= 4), F.transform(g, lambda x: F.conv(x, 16, 10).cast("int")))))

    return let(let(F.regexp_replace(F.lower(F.trim(ip)), "%.*$", ""), plain), groups)


def _v6_in(g: Column, net: str) -> Column:
    """Whether the groups of an address lie in a network, group by group."""
    n = ipaddress.ip_network(net)
    base, left, tests = n.network_address.packed, n.prefixlen, []
    for i in range(8):
        bits = min(16, max(0, left - 16 * i))
        if bits:
            mask = 0xFFFF << (16 - bits) & 0xFFFF
            tests.append(F.get(g, F.lit(i)).bitwiseAND(mask) == int.from_bytes(base[2 * i : 2 * i + 2], "big"))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def _v6_scope(g: Column) -> Column:
    """Scope of an IPv6 address: first matching network, anything else is public; one that stands for an IPv4 address has its scope."""
    n = F.get(g, F.lit(6)).cast("long") * 65536 + F.get(g, F.lit(7))
    four = let(n, lambda x: F.when(_v4_scope(x) == "public", "public").when(_v4_scope(x) == "loopback", "loopback").otherwise("reserved"))
    return F.when(_v6_in(g, "::ffff:0:0/96"), four).otherwise(_plain_v6_scope(g))


def _plain_v6_scope(g: Column) -> Column:
    return _case([(reduce(lambda a, b: a | b, [_v6_in(g, n) for n in nets]), scope) for scope, nets in V.IPV6_RANGES], "public")


def _v4_scope(n: Column) -> Column:
    pairs = []
    for scope, nets in V.IPV4_RANGES:
        spans = [ipaddress.ip_network(x) for x in nets]
        pairs.append((reduce(lambda a, b: a | b, [n.between(int(s.network_address), int(s.broadcast_address)) for s in spans]), scope))
    return _case(pairs, "public")


def ip_scope(ip: Column) -> Column:
    """Scope of an address: first matching IPv4 range, IPv6 by its leading bits, else ``invalid``; null stays null."""
    v = F.trim(ip)
    six = let(_v6_groups(ip), lambda g: F.when(g.isNull(), "invalid").otherwise(_v6_scope(g)))
    return F.when(ip.isNull(), None).when(v.rlike(V.STRICT_IPV4), let(ipv4_number(v), _v4_scope)).when(F.contains(v, F.lit(":")), six).otherwise("invalid")


def ip_net(ip: Column) -> Column:
    """The /24 of a strict IPv4 text, the /64 of an IPv6 text with leading zeros left out, else null."""
    v = F.trim(ip)
    four = F.concat(F.substring_index(v, ".", 3), F.lit(".0/24"))

    def six(g: Column) -> Column:
        part = [F.lower(F.hex(F.get(g, F.lit(i)).cast("long"))) for i in range(4)]
        return F.when(g.isNotNull(), F.concat(F.regexp_replace(F.concat_ws(":", *part), "(^0|:0)(:0)*$", ""), F.lit("::/64")))

    return F.when(v.rlike(V.STRICT_IPV4), four).when(F.contains(v, F.lit(":")), let(_v6_groups(ip), six))


def is_allow(action: Column) -> Column:
    return F.lower(action.cast("string")).isin(V.ALLOW_WORDS)


def is_deny(action: Column) -> Column:
    return F.lower(action.cast("string")).isin(V.DENY_WORDS)


def basename(path: Column) -> Column:
    """Lower-cased text after the last slash of either kind, empty: null."""
    return F.nullif(F.lower(F.regexp_extract(path.cast("string"), r"[^\\/]+$", 0)), F.lit(""))


def command_flags(command: Column) -> Column:
    """Names of the flags that a command line shows, in fixed order, none: null."""
    return F.nullif(F.concat_ws(",", *[F.when(command.rlike(rx), F.lit(name)) for name, rx in V.COMMAND_FLAGS]), F.lit(""))


def agent_family(agent: Column) -> Column:
    return _case([(F.lower(agent).rlike(rx), name) for name, rx in V.AGENT_FAMILIES.items()])


def value_format(v: Column) -> Column:
    """First matching format of a value."""
    return _case([(v.rlike(rx), name) for name, rx in V.FORMATS.items()],
        "text",
    )


def mask_values(v: Column) -> Column:
    return F.regexp_replace(v, "=[^&#]*", "=*")


def mask_ids(v: Column) -> Column:
    """Two passes, because neighbouring segments share a slash."""
    once = F.regexp_replace(v, V.ID_SEGMENT, "/{id}$2")
    return F.regexp_replace(once, V.ID_SEGMENT, "/{id}$2")


def scrub(v: Column) -> Column:
    v = F.regexp_replace(v, V.EMAIL_MASK, "{email}")
    v = F.regexp_replace(v, V.IP_MASK, "{ip}")
    return F.regexp_replace(v, V.TOKEN_MASK, "{token}")


def mask_example(v: Column) -> Column:
    return F.concat(F.substring(v, 1, 2), F.repeat(F.lit("*"), F.lit(8)))


def shape(v: Column) -> Column:
    """Abstract shape of a value: letter runs as a, digit runs as 9, from 300 characters, cut to 80."""
    s = F.regexp_replace(F.substring(v, 1, 300), r"\p{L}+", "a")
    return F.substring(F.regexp_replace(s, r"\p{N}+", "9"), 1, 80)


def url_endpoint(u: Column) -> Column:
    return F.split_part(u, F.lit("?"), F.lit(1))


def url_query(u: Column) -> Column:
    at = F.instr(u, "?")
    return F.when(at > 0, F.substr(u, at + 1))


def request_method(line: Column) -> Column:
    return F.nullif(F.regexp_extract(line, "^([A-Z]+) ", 1), F.lit(""))


def request_uri(line: Column) -> Column:
    return F.nullif(F.regexp_extract(line, r"^[A-Z]+ (\S+)", 1), F.lit(""))


def derived(source: Column, pattern: str, kind: str = "string") -> Column:
    return F.nullif(F.regexp_extract(source, pattern, 1), F.lit("")).try_cast(kind)


def local_to_utc(naive: Column, zone: str) -> Column:
    """UTC of a local time; a repeated hour counts as its second occurrence, a missing one is shifted."""
    t = F.to_utc_timestamp(naive, zone)
    out = t
    for minutes in (30, 60, 120):
        later = t + F.expr(f"INTERVAL {minutes} MINUTES")
        out = F.when(F.from_utc_timestamp(later, zone) == naive, later).otherwise(out)
    return out


def millis(ts: Column) -> Column:
    """Milliseconds since the epoch, rounded half up."""
    return F.floor((F.unix_micros(ts.cast("timestamp")) + 500) / 1000).cast("long")


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def percent(a: Column, b: Column, digits: int) -> Column:
    return F.round(F.try_divide(F.lit(100.0) * a, b.cast("double")), digits)


def refang(text: Column) -> Column:
    """Indicators as they were before they were made unclickable."""
    return reduce(lambda t, rule: F.regexp_replace(t, *rule), V.REFANG, text)


def _folds() -> tuple[str, str, dict[str, str]]:
    """Letters with marks, the ASCII letter of each, and characters that become several, by Unicode's compatibility rule."""
    one, several = {}, {}
    for n in [*range(0x80, 0x250), *range(0x1E00, 0x1F00), *range(0x2000, 0x2070), *range(0xFB00, 0xFB07)]:
        flat = unicodedata.normalize("NFKD", chr(n)).encode("ascii", "ignore").decode()
        if len(flat) == 1:
            one[chr(n)] = flat
        elif len(flat) > 1:
            several[chr(n)] = flat
    return "".join(one), "".join(one.values()), several


_MARKED, _PLAIN, _SEVERAL = _folds()
_FOLDED = dict(zip(_MARKED, _PLAIN, strict=True)) | _SEVERAL
_NOT_ASCII = re.compile(r"[^\x00-\x7F]")


def folded(text: str) -> str:
    """``ascii_fold`` of one text, for functions in tasks."""
    return text if text.isascii() else _NOT_ASCII.sub(lambda m: _FOLDED.get(m[0], ""), text)


def ascii_fold(text: Column) -> Column:
    """Text without marks on letters; what has no ASCII form goes. Stays in the JVM: characters are translated by a table.

    Characters that become several letters are few; only texts that hold one are gone over for them, by a loop over a
    table, which keeps the code that Spark makes of this small.
    """
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in _SEVERAL.items()])
    wide = F.aggregate(pairs, text, lambda t, x: F.replace(t, x["k"], x["v"]))
    spread = F.when(text.rlike(f"[{''.join(_SEVERAL)}]"), wide).otherwise(text)
    plain = F.regexp_replace(F.translate(spread, _MARKED, _PLAIN), r"[^\x00-\x7F]+", "")
    return F.when(text.rlike(r"[^\x00-\x7F]"), plain).otherwise(text)
