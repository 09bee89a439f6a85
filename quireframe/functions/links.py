"""Link safety: which addresses may be opened, and what to show for them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from quireframe.functions.addresses import canonical_url
from quireframe.sources.layout import let

# The schemes that may be opened, and the characters that hide or reorder text.
ALLOWED = "(?i)^(https?|mailto):"
HIDDEN = r"[\x{0}-\x{1F}\x{7F}-\x{9F}\x{200E}\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}]"
AUTHORITY = r"(?i)^https?:[/\\]*([^/\\?#]+)"


@F.pandas_udf(T.StringType())
def _punycode(host: pd.Series) -> pd.Series:
    def one(h):
        try:
            return None if h is None else h.encode("idna").decode("ascii")
        except UnicodeError:
            return h

    return host.map(one)


def has_hidden(c: Column) -> Column:
    return c.rlike(HIDDEN)


def escape_hidden_chars(c: Column) -> Column:
    r"""Each control or direction mark as ``\uXXXX``; untouched text skips the character walk."""
    one = lambda ch: F.when(ch.rlike(f"^{HIDDEN}$"), F.concat(F.lit("\\u"), F.lpad(F.hex(F.ascii(ch)), 4, "0"))).otherwise(ch)
    return let(c, lambda v: F.when(has_hidden(v), F.array_join(F.transform(F.split(v, ""), one), "")).otherwise(v))


def is_allowed_url(url: Column) -> Column:
    """An absolute address with an allowed scheme, and for the web schemes a host."""
    u = bare_url(url)
    place = F.regexp_replace(_authority(u), "^.*@", "")
    port = F.regexp_extract(place, r":([0-9]*)$", 1)
    good = place.rlike(r"^(\[[0-9A-Fa-f:.]+\]|[^:\[\]\s<>^|%]+)(:[0-9]*)?$") & ((port == "") | (F.regexp_replace(port, "^0+(?=.)", "").try_cast("int") <= 65535))
    return F.coalesce(u.rlike(ALLOWED) & (~u.rlike("(?i)^https?:") | F.coalesce(good, F.lit(False))), F.lit(False))


def bare_url(url: Column) -> Column:
    """As an address is read: no control characters or blanks around it, no tabs and line ends inside."""
    return F.translate(F.regexp_replace(url, r"^[\x{0}-\x{20}]+|[\x{0}-\x{20}]+$", ""), "\t\n\r", "")


def allowed_url(url: Column) -> Column:
    return F.when(is_allowed_url(url), url)


def _authority(u: Column) -> Column:
    return F.regexp_extract(u, AUTHORITY, 1)


def url_host(url: Column, punycode: bool = True) -> Column:
    host = F.lower(F.regexp_replace(F.regexp_replace(_authority(bare_url(url)), "^.*@", ""), ":[0-9]*$", ""))
    if not punycode:
        return host
    odd = host.rlike(r"[^\x{0}-\x{7F}]")
    return F.when(odd, _punycode(F.when(odd, host))).otherwise(host)


def mail_domains(url: Column) -> Column:
    """Domains of a mailto address; null if there is no address or one of them is not a plain domain."""
    path = F.regexp_replace(F.regexp_extract(bare_url(url), r"(?i)^mailto:([^?#]*)", 1), r"\+", "%2B")
    addresses = F.filter(F.transform(F.split(F.try_url_decode(path), ","), lambda a: F.trim(a)), lambda a: a != "")
    domains = F.transform(addresses, lambda a: F.lower(F.regexp_extract(a, r"@([^@]*)$", 1)))
    bad = F.exists(domains, lambda d: (d == "") | d.rlike(r"[\s/?#@:\\%]") | d.rlike(HIDDEN))
    return F.when((F.size(domains) > 0) & ~bad, F.array_distinct(domains))


def _judged(url: Column) -> tuple[Column, Column, Column, Column, Column]:
    """(bare address, is it mail, mail domains, why it is blocked, domain)."""
    u = bare_url(url)
    mail = u.rlike("(?i)^mailto:")
    creds = _authority(u).contains("@") & ~_authority(u).rlike("^:?@")
    domains = mail_domains(u)
    reason = F.when(~is_allowed_url(url), "scheme").when(~mail & creds, "credentials").when(mail & domains.isNull(), "address")
    return u, mail, domains, reason, F.when(reason.isNotNull(), "").when(mail, F.array_join(domains, ", ")).otherwise(url_host(url))


def link_domain(url: Column) -> Column:
    """The domain that a link decision names, as written; empty where the link is blocked."""
    return _judged(url)[4]


def link_decision(url: Column, skipped_domain: Column | None = None) -> Column:
    """struct<action, reason, domain, shown, hidden, url>: ``url`` is the canonical address, which opens and, for the web schemes, is shown.  ``skipped_domain``: the user asked not to be warned for it."""
    u, mail, domains, reason, domain = _judged(url)
    opens = canonical_url(url)
    letter = F.coalesce(F.try_url_decode(F.regexp_replace(u, r"\+", "%2B")), u)
    shown = F.when(mail, letter).otherwise(F.coalesce(opens, u))
    hidden = has_hidden(url) | (mail & has_hidden(letter))
    simple = ~mail | ((F.size(domains) == 1) & ~u.contains("?"))
    skip = F.coalesce(skipped_domain, F.lit(False)) if skipped_domain is not None else F.lit(False)
    action = F.when(reason.isNotNull(), "blocked").when(skip & simple & ~hidden & (domain != ""), "open").otherwise("confirm")
    return F.struct(
        action.alias("action"), reason.alias("reason"), escape_hidden_chars(domain).alias("domain"),
        escape_hidden_chars(F.when(reason.isin("scheme", "credentials"), url).otherwise(shown)).alias("shown"), hidden.alias("hidden"),
        F.when(reason.isNull(), opens).alias("url"),
    )


def link_dest_kind(action: Column, uri: Column, page: Column) -> Column:
    """page / uri / blocked / other for a stored link."""
    return (
        F.when(action.isin("goto", "dest") & (page >= 0), "page")
        .when((action == "uri") & is_allowed_url(uri), "uri")
        .when(action == "uri", "blocked")
        .otherwise("other")
    )
