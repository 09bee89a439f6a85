"""Web and mail addresses in canonical form: the one that opens.

An address is read in the steps of the public URL standard, each a column expression: what surrounds it goes, then scheme,
user, host, port, path, query and fragment are told apart and written anew.  Rare forms (dots in paths, numbers as hosts,
characters to be escaped) are worked on only where a pattern finds them.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quireframe.sources.layout import let

# What is escaped in each part of an address, and the ports that are not written.
CONTROL = r"\x{0}-\x{1F}\x{7F}-\x{10FFFF}"
FRAGMENT = CONTROL + r' "<>`'
QUERY = CONTROL + r' "#<>'
WEB_QUERY = QUERY + "'"
PATH = QUERY + r"?\^`{}"
USER = PATH + r"/:;=@\[\\\]|"
PORTS = {"http": "80", "https": "443"}
FORBIDDEN = r"[\x{0}-\x{20}#%/:<>?@\[\\\]\^|\x{7F}]"


def escaped(c: Column, kept_out: str) -> Column:
    """Each character of the set as %XX of its UTF-8 bytes."""
    one = lambda ch: F.when(ch.rlike(f"^[{kept_out}]$"), F.regexp_replace(F.hex(F.encode(ch, "UTF-8")), "(..)", "%$1")).otherwise(ch)
    return let(c, lambda v: F.when(v.rlike(f"[{kept_out}]"), F.array_join(F.transform(F.split(v, ""), one), "")).otherwise(v))


def _ipv4(host: Column) -> Column:
    """Dotted form of a host whose last label is a number (decimal, 0 octal, 0x hexadecimal); null if it is none."""

    def number(part: Column) -> Column:
        hexa, octal = F.regexp_extract(part, "^0[xX]([0-9a-fA-F]*)$", 1), F.regexp_extract(part, "^0([0-7]+)$", 1)
        bare = lambda digits: F.regexp_replace(digits, "^0+", "")
        read = lambda digits, base: F.when(F.length(bare(digits)) <= 11, F.conv(F.concat(F.lit("0"), digits), base, 10).cast("long"))
        return F.when(part.rlike("^0[xX]"), F.when(part.rlike("^0[xX][0-9a-fA-F]*$"), read(hexa, 16))).when(octal != "", read(octal, 8)).when(part.rlike("^(0|[1-9][0-9]*)$"), read(part, 10))

    def dotted(n: Column) -> Column:  # n: a number for each label
        count = F.size(n)
        last = F.element_at(n, -1)
        good = (count <= 4) & ~F.exists(n, lambda x: x.isNull()) & ~F.exists(F.slice(n, 1, count - 1), lambda x: x > 255) & (last < F.pow(F.lit(256), 5 - count))
        whole = F.aggregate(F.transform(F.slice(n, 1, count - 1), lambda x, i: x * F.pow(F.lit(256), 3 - i).cast("long")), last, lambda s, x: s + x)
        return F.when(good, let(whole, lambda w: F.concat_ws(".", *[F.shiftright(w, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)])))

    return let(F.transform(F.split(F.regexp_replace(host, r"\.$", ""), r"\."), number), dotted)


def _ipv6(host: Column) -> Column:
    """The shortest form of an address in brackets; null if it is none."""
    tail = F.regexp_extract(host, r"([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)$", 1)
    v4 = F.transform(F.split(tail, r"\."), lambda x: x.try_cast("int"))
    pair = F.concat(F.lower(F.hex(F.get(v4, F.lit(0)) * 256 + F.get(v4, F.lit(1)))), F.lit(":"), F.lower(F.hex(F.get(v4, F.lit(2)) * 256 + F.get(v4, F.lit(3)))))
    text = F.when(tail != "", F.when(~F.exists(v4, lambda x: x > 255), F.concat(F.substr(host, F.lit(1), F.length(host) - F.length(tail)), pair))).otherwise(host)
    words = lambda h: F.filter(F.split(h, ":", -1), lambda x: x != "")

    def filled(x: Column) -> Column:
        missing = 8 - F.size(x["left"]) - F.size(x["right"])
        fits = F.when(x["gaps"] == 1, missing >= 1).otherwise((x["gaps"] == 0) & (missing == 0)) & x["text"].rlike("^[0-9A-Fa-f:]+$") & ~x["text"].rlike("::.*::|:::|^:[^:]|[^:]:$")
        all_ = F.transform(F.concat(x["left"], F.array_repeat(F.lit("0"), missing), x["right"]), lambda g: F.lower(F.regexp_replace(g, "^0+(?=.)", "")))
        return F.when(fits, let(all_, lambda g: F.when(~F.exists(g, lambda y: F.length(y) > 4), let(F.array_join(g, ":"), short))))

    def halved(t: Column) -> Column:
        h = F.split(t, "::", -1)
        return let(F.struct(t.alias("text"), (F.size(h) - 1).alias("gaps"), words(F.get(h, F.lit(0))).alias("left"), F.coalesce(words(F.get(h, F.lit(1))), F.array().cast("array<string>")).alias("right")), filled)

    def short(full: Column) -> Column:
        out = F.when(F.lit(False), full)
        for k in range(8, 1, -1):
            run = "^(.*?)(?:^|:)0" + ":0" * (k - 1) + "(?::|$)(.*)$"
            out = out.when(full.rlike(run), F.regexp_replace(full, run, "$1::$2"))
        return out.otherwise(full)

    return let(text, halved)


def _path(path: Column) -> Column:
    """Slashes one way, dot segments resolved, escaped."""
    slashed = F.regexp_replace(path, r"\\", "/")
    dot, twice = r"(?i)^(\.|%2e)$", r"(?i)^(\.|%2e){2}$"

    def resolved(parts: Column) -> Column:
        marked = F.transform(parts, lambda s, i: F.struct(s.alias("s"), (i == F.size(parts) - 1).alias("last")))
        empty = F.array(F.lit(""))
        close = lambda s, x: F.when(x["last"], F.concat(s, empty)).otherwise(s)
        step = lambda s, x: F.when(x["s"].rlike(twice), close(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), x)).when(x["s"].rlike(dot), close(s, x)).otherwise(F.concat(s, F.array(x["s"])))
        return F.array_join(F.aggregate(marked, F.array().cast("array<string>"), step), "/")

    body = F.regexp_replace(slashed, "^/", "")
    plain = let(body, lambda b: F.when(b.rlike(r"(?i)(^|/)(\.|%2e){1,2}(/|$)"), let(F.split(b, "/", -1), resolved)).otherwise(b))
    return F.concat(F.lit("/"), escaped(plain, PATH))


def _host(host: Column, name: Column) -> Column:
    """The host as it is written, from what stands in the address and its ASCII form."""
    plain = let(name, lambda n: F.when(n.rlike(r"(^|\.)(0x[0-9a-f]*|[0-9]+)\.?$"), _ipv4(n)).when((n != "") & ~n.rlike(FORBIDDEN), n))
    inside = F.regexp_extract(host, r"^\[([0-9A-Fa-f:.]+)\]$", 1)
    return F.when(host.startswith("["), let(inside, lambda i: F.when(i != "", F.concat(F.lit("["), _ipv6(i), F.lit("]"))))).otherwise(plain)


def _web(x: Column) -> Column:
    """The address of (u, name), the bare text and its host in ASCII."""
    form = r"(?is)^(https?):[/\\]*([^/\\?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
    parts = F.struct(*[F.regexp_extract(x["u"], form, k).alias(n) for k, n in enumerate(("scheme", "place", "path", "query", "mark"), 1)], x["name"].alias("name"))

    def written(p: Column) -> Column:
        scheme, place = F.lower(p["scheme"]), F.regexp_replace(p["place"], "(?s)^.*@", "")
        port = F.regexp_replace(F.regexp_extract(place, r":([0-9]*)$", 1), "^0+(?=.)", "")
        default = F.element_at(F.create_map(*[F.lit(v) for kv in PORTS.items() for v in kv]), scheme)
        port = let(port, lambda n: F.when((n == "") | (n == default), "").when((F.length(n) <= 5) & (n.try_cast("int") <= 65535), F.concat(F.lit(":"), n)))
        login = F.regexp_extract(p["place"], "(?s)^(.*)@", 1)
        who = F.struct(escaped(F.regexp_extract(login, "(?s)^([^:]*)", 1), USER).alias("name"), escaped(F.regexp_extract(login, "(?s)^[^:]*:(.*)$", 1), USER).alias("word"))
        who = let(who, lambda w: F.when((w["name"] == "") & (w["word"] == ""), "").otherwise(F.concat(w["name"], F.when(w["word"] != "", F.concat(F.lit(":"), w["word"])).otherwise(""), F.lit("@"))))
        after = lambda c, sign, kept_out: F.when(c != "", F.concat(F.lit(sign), escaped(F.substr(c, F.lit(2)), kept_out))).otherwise("")
        host = let(F.regexp_replace(place, ":[0-9]*$", ""), lambda h: _host(h, p["name"]))
        return F.concat(scheme, F.lit("://"), who, host, port, _path(p["path"]), after(p["query"], "?", WEB_QUERY), after(p["mark"], "#", FRAGMENT))

    return let(parts, written)


def canonical_url(url: Column) -> Column:
    """The form of an http, https or mailto address that opens; null for any other text and for addresses that open nowhere."""
    from quireframe.functions.links import _punycode, bare_url

    u = bare_url(url)
    host = F.regexp_extract(u, r"(?is)^https?:[/\\]*(?:[^/\\?#]*@)?([^/\\?#@]*?)(?::[0-9]*)?(?:[/\\?#].*)?$", 1)
    decoded = let(host, lambda h: F.when(h.contains("%"), F.try_url_decode(F.regexp_replace(h, r"\+", "%2B"))).otherwise(h))
    # Python sees only hosts that are not ASCII
    name = F.lower(F.coalesce(_punycode(let(decoded, lambda d: F.when(d.rlike(r"[^\x{0}-\x{7F}]"), d))), decoded))
    mail = r"(?is)^mailto:([^?#]*)(\?[^#]*)?(#.*)?$"
    piece = lambda x, k, kept_out: escaped(F.regexp_extract(x, mail, k), kept_out)
    letter = lambda x: F.concat(F.lit("mailto:"), piece(x, 1, CONTROL), piece(x, 2, CONTROL + ' "<>'), piece(x, 3, FRAGMENT))
    return let(F.struct(u.alias("u"), name.alias("name")), lambda x: F.when(x["u"].rlike("(?i)^https?:"), _web(x)).when(x["u"].rlike("(?i)^mailto:"), letter(x["u"])))
