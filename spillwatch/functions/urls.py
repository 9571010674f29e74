"""URL column expressions.

A URL is read as the standard generic syntax: fragment, scheme, authority, path, query. What does not
parse (bad escapes, control characters, a bad port or host, a colon in a relative first
segment) is flagged and takes the documented fallback of each function.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hosts that serve third-party libraries.
CDN_HOSTS = (
    "googleapis.com",
    "gstatic.com",
    "google-analytics.com",
    "googletagmanager.com",
    "doubleclick.net",
    "facebook.net",
    "connect.facebook.net",
    "cloudflare.com",
    "cdnjs.cloudflare.com",
    "ajax.cloudflare.com",
    "cdn.jsdelivr.net",
    "unpkg.com",
    "code.jquery.com",
    "ajax.googleapis.com",
    "maxcdn.bootstrapcdn.com",
    "stackpath.bootstrapcdn.com",
    "cdn.bootcss.com",
    "ajax.aspnetcdn.com",
    "microsoft.com/ajax",
)
# Name fragments of third-party libraries.
LIBRARY_NAMES = (
    "gtm.js",
    "gtag.js",
    "ga.js",
    "analytics.js",
    "google-analytics",
    "googletagmanager",
    "facebook-pixel",
    "fbevents.js",
    "pixel.js",
    "jquery.js",
    "jquery.min.js",
    "jquery-",
    "jquery.",
    "bootstrap.js",
    "bootstrap.min.js",
    "bootstrap.bundle",
    "modernizr",
    "polyfill",
    "shim.js",
    "html5shiv",
    "respond.min.js",
    "selectivizr",
    "fontawesome",
    "font-awesome",
    "twitter.com/widgets",
    "platform.twitter",
    "linkedin.com/embed",
    "instagram.com/embed",
    "doubleclick",
    "googlesyndication",
    "adservice",
    "ads.js",
    "sentry",
    "newrelic",
    "hotjar",
    "clarity.ms",
)
PACKAGE_FOLDER = "node_modules"
SCRIPT_SUFFIX = ".js"
MAX_FILENAME_BYTES, KEPT_FILENAME_BYTES = 200, 180

_SCHEME = "[A-Za-z][A-Za-z0-9+.-]*:"
_ESCAPE = "%[0-9A-Fa-f]{2}"
_CONTROL = r"\x00-\x1f\x7f"
_USER = r"[A-Za-z0-9\-._:~!$&'()*+,;=@]*@"
_HOST = r"""A-Za-z0-9\-._~!$&'()*+,;=\[\]<>"\x{80}-\x{10FFFF}"""
_HOST_AND_PORT = rf"(?:\[[{_HOST}:]*\](?::[0-9]*)?|[{_HOST}:]*:[0-9]*|[{_HOST}]*)"
_PATH_TEXT = rf"[^?#%{_CONTROL}]*"
_QUERY = rf"(?:\?[^#{_CONTROL}]*)?"
# One regex per question, so that an expression stays small wherever it is used. This one is for a URL
# whose valid escapes were taken for letters: a percent sign left over is a bad one.
_PARSABLE = (
    "^(?:"
    + "|".join(
        (
            rf"{_SCHEME}(?!/)[^#{_CONTROL}]*",  # opaque, as mailto:
            rf"(?:{_SCHEME}|(?!///))//(?:{_USER})?{_HOST_AND_PORT}(?:/{_PATH_TEXT})?{_QUERY}",
            rf"(?:{_SCHEME})?/(?!/){_PATH_TEXT}{_QUERY}",
            rf"(?=///){_PATH_TEXT}{_QUERY}",
            rf"[^:/?#%{_CONTROL}]*(?:/{_PATH_TEXT})?{_QUERY}",  # relative, no colon in the first segment
        )
    )
    + rf")(?:#[^%{_CONTROL}]*)?\z"
)
_PATH = rf"(?s)^(?:{_SCHEME}//[^/?#]*|{_SCHEME}(?=/)|{_SCHEME}[^?#]*|//(?!/)[^/?#]*)?([^?#]*)"
_HOST_OF = rf"(?s)^(?:{_SCHEME}|(?!///))//(?:[^/?#]*@)?([^/?#]*)"
# A host may escape only what is not ASCII, and the percent sign.
_BAD_HOST_ESCAPE = rf"(?s)^(?:{_SCHEME}|(?!///))//(?:[^/?#]*@)?[^/?#]*%(?!25)[0-7][0-9A-Fa-f]"


def is_parsable_url(url: Column) -> Column:
    plain = F.regexp_replace(url, _ESCAPE, "x")
    return plain.rlike(_PARSABLE) & ~url.rlike(_BAD_HOST_ESCAPE)


def _decoded(text: Column) -> Column:
    # The decoder reads "+" as a blank, which a path does not.
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def url_path(url: Column) -> Column:
    """Percent-decoded path."""
    return _decoded(F.regexp_extract(url, _PATH, 1))


def url_host(url: Column) -> Column:
    """Host with its port."""
    return _decoded(F.regexp_extract(url, _HOST_OF, 1))


def is_js_url(url: Column) -> Column:
    """The decoded path ends in ``.js`` in any case; an unparsable URL only has to contain ``.js``."""
    return F.when(is_parsable_url(url), F.endswith(F.lower(url_path(url)), F.lit(SCRIPT_SUFFIX))).otherwise(
        F.contains(url, F.lit(SCRIPT_SUFFIX))
    )


def _any_of(fragments) -> str:
    return "|".join(f.replace(".", r"\.") for f in fragments)


def is_third_party(url: Column) -> Column:
    """A package folder, a library host or a library name occurs in the URL, in any case."""
    return F.lower(url).rlike(_any_of((PACKAGE_FOLDER, *CDN_HOSTS, *LIBRARY_NAMES)))


def third_party_reason(url: Column) -> Column:
    """Which list made the URL third-party (they are tried in this order); null for first-party."""
    lowered = F.lower(url)
    return (
        F.when(F.contains(lowered, F.lit(PACKAGE_FOLDER)), "package folder")
        .when(lowered.rlike(_any_of(CDN_HOSTS)), "cdn host")
        .when(lowered.rlike(_any_of(LIBRARY_NAMES)), "library name")
    )


# Everything that counts as white space around a line.
WHITE_SPACE = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_SPACE))


def safe_domain(domain: Column) -> Column:
    """A domain or URL as a folder name."""
    bare = F.replace(F.replace(domain, F.lit("http://"), F.lit("")), F.lit("https://"), F.lit(""))
    return F.translate(bare, "/:", "__")


def sanitize_filename(name: Column) -> Column:
    cut = F.substring_index(name, "?", 1)
    safe = F.regexp_replace(cut, r'[<>:"/\\|*\x00-\x1f]', "_")
    return F.btrim(F.regexp_replace(safe, "_+", "_"), F.lit(". "))


def _first_bytes(text: Column, count: int) -> Column:
    """At most ``count`` bytes, as text; a character cut in the middle becomes a replacement sign."""
    return F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), 1, count).cast("string"))


def generate_filename(url: Column, index: Column) -> Column:
    """A safe ``.js`` file name for a URL."""
    base = F.regexp_extract(url_path(url), r"(?s)([^/]*)/*\z", 1)
    from_host = F.concat(F.replace(url_host(url), F.lit("."), F.lit("_")), F.lit("_"), index.cast("string"), F.lit(".js"))
    name = sanitize_filename(F.regexp_replace(base, r"(?i)(?<!\.js)\z", SCRIPT_SUFFIX))
    short = F.when(
        F.octet_length(name) > MAX_FILENAME_BYTES,
        F.concat(_first_bytes(name, KEPT_FILENAME_BYTES), F.lit("_"), F.left(F.md5(url), F.lit(12)), F.lit(".js")),
    ).otherwise(name)
    unparsable = F.concat(F.lit("file_"), index.cast("string"), F.lit("_"), F.left(F.md5(url), F.lit(16)), F.lit(".js"))
    # A path of one dot is its own base name and counts as none.
    return (
        F.when(~is_parsable_url(url), unparsable)
        .when(base.isin("", "."), from_host)
        .otherwise(short)
    )


def without_dot_segments(path: Column) -> Column:
    """A path with ``.`` and ``..`` worked off, segment by segment; what would climb above the root is dropped."""
    segments = F.split(path, "/", -1)
    last = F.element_at(segments, -1)

    def step(kept, segment):
        # The first segment, the empty one before the root, stays.
        return (
            F.when(segment == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(1))))
            .when(segment == ".", kept)
            .otherwise(F.array_append(kept, segment))
        )

    kept = F.aggregate(F.slice(segments, F.lit(2), F.size(segments)), F.slice(segments, 1, 1), step)
    closed = F.when(last.isin(".", ".."), F.array_append(kept, F.lit(""))).otherwise(kept)
    return F.when(path.startswith("/"), F.array_join(closed, "/")).otherwise(path)


def resolve_url(reference: Column, base_url: Column) -> Column:
    """A ``src`` or ``href`` value as an absolute URL, given the page it stands on or the base that the page names."""
    scheme = F.regexp_extract(base_url, f"^{_SCHEME}", 0)
    page = F.regexp_extract(base_url, "^[^?#]*", 0)
    origin = F.regexp_extract(page, rf"^{_SCHEME}//[^/]*", 0)
    path = F.substring(page, F.length(origin) + 1, F.length(page))
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_extract(path, "^.*/", 0))
    own, rest = F.regexp_extract(reference, "^[^?#]*", 0), F.regexp_extract(reference, r"(?s)[?#].*\z", 0)
    return (
        F.when(reference.rlike(f"^{_SCHEME}"), reference)
        .when(reference.startswith("//"), F.concat(scheme, reference))
        .when(reference == "", F.regexp_extract(base_url, "^[^#]*", 0))
        .when(reference.startswith("?"), F.concat(page, reference))
        .when(reference.startswith("#"), F.concat(F.regexp_extract(base_url, "^[^#]*", 0), reference))
        .when(reference.startswith("/"), F.concat(origin, without_dot_segments(own), rest))
        .otherwise(F.concat(origin, without_dot_segments(F.concat(folder, own)), rest))
    )


def display_url(url: Column) -> Column:
    """A long URL by its last 47 characters."""
    return F.when(F.length(url) > 50, F.concat(F.lit("..."), F.right(url, F.lit(47)))).otherwise(url)
