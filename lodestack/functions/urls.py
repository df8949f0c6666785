"""URL handling as Column expressions; nothing here leaves the JVM.

A normalised URL is ``scheme://host:port/path``. A null input gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File endings that are not followed (fixed values).
SKIPPED_ENDINGS = (".jpg", ".jpeg", ".gif", ".png", ".txt")
_HOST = r"^([^/]*//[^/]*)"
_ANCHOR = r"(?i)(<a[^>]+>.+?</a>)"


def host(url: Column) -> Column:
    """``scheme://authority``; empty where there is none."""
    return F.regexp_extract(url, _HOST, 1)


def path_of(url: Column) -> Column:
    """What follows the host, ``/`` where nothing does."""
    rest = F.substr(url, F.length(host(url)) + 1)
    return F.when(rest == "", "/").otherwise(rest)


def with_port(url: Column) -> Column:
    """The URL with its scheme's default port unless the host names one."""
    authority = host(url)
    port = F.when(url.startswith("https"), ":443").otherwise(":80")
    return F.concat(authority, F.when(authority.rlike(r":[0-9]+$"), "").otherwise(port), path_of(url))


def seed(url: Column) -> Column:
    """A start address: lower case, ``http://`` unless it has a scheme, ``/`` at the end, with port."""
    low = F.lower(url)
    full = F.when(low.startswith("http"), low).otherwise(F.concat(F.lit("http://"), low))
    return with_port(F.when(full.endswith("/"), full).otherwise(F.concat(full, F.lit("/"))))


def without_dots(path: Column) -> Column:
    """A path with ``..`` folded; null where it climbs above the root. A slash at the end is lost."""
    inner = F.regexp_replace(F.regexp_replace(path, "^/{1,2}", ""), "/+$", "")
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(True).alias("ok"))

    def step(acc: Column, part: Column) -> Column:
        up = part == ".."
        kept = F.when(up, F.slice(acc["kept"], 1, F.greatest(F.size(acc["kept"]) - 1, F.lit(0)))).otherwise(F.concat(acc["kept"], F.array(part)))
        return F.struct(kept.alias("kept"), (acc["ok"] & (~up | (F.size(acc["kept"]) > 0))).alias("ok"))

    done = F.aggregate(F.split(inner, "/"), start, step)
    return F.when(done["ok"], F.concat(F.lit("/"), F.array_join(done["kept"], "/")))


def resolve(base: Column, link: Column) -> Column:
    """The link as seen from the page ``base``.

    A fragment is cut from relative links and kept on absolute ones; a mere
    fragment is the page itself. Null where the link climbs above the root.
    """
    cut = F.regexp_replace(link, r"(?s)#.*$", "")
    folder = F.regexp_extract(base, r"(?s)^(.*/)", 1)
    relative = F.concat(folder, cut)
    climbed = F.concat(host(relative), without_dots(F.substr(relative, F.length(host(relative)) + 1)))
    target = F.when(cut.startswith("http"), link).when(cut.startswith("/"), F.concat(host(base), cut)).otherwise(climbed)
    return F.when((cut == "") & link.contains("#"), base).otherwise(with_port(target))


def anchors(html: Column) -> Column:
    """Array of the anchor elements of a page: text on one line, not empty."""
    return F.regexp_extract_all(html, F.lit(_ANCHOR), 1)


def href(anchor: Column) -> Column:
    """The first double-quoted value after ``href``; null without ``href``, empty without quotes."""
    return F.when(anchor.contains("href"), F.regexp_extract(anchor, r'(?s)href[^"]*"([^"]*)', 1))


def followed(url: Column) -> Column:
    """Whether a resolved link is to be fetched."""
    ending = F.lit(False)
    for e in SKIPPED_ENDINGS:
        ending = ending | url.endswith(e)
    return (url.startswith("http://") | url.startswith("https://")) & ~ending


def row_key(text: Column) -> Column:
    """SHA-1 in Base64 with ``@`` for ``/``: a key without path separators."""
    return F.translate(F.base64(F.unhex(F.sha1(text))), "/", "@")


def parts(url: Column) -> Column:
    """``struct(scheme, host, port, path)``; a text without ``//`` after a scheme is all path."""
    split = url.rlike(r"(?s)^[^/]+//|^[^/]+/[^/]*//") & (F.instr(url, "//") > 1)
    authority = F.regexp_extract(url, r"(?s)^.*?//([^/]*)", 1)
    colon = F.instr(authority, ":")
    path = F.regexp_extract(url, r"(?s)^.*?//[^/]*(/.*)$", 1)
    return F.struct(
        F.when(split, F.substr(url, F.lit(1), F.instr(url, "//") - 2)).alias("scheme"),
        F.when(split, F.when(colon > 1, F.substr(authority, F.lit(1), colon - 1)).otherwise(authority)).alias("host"),
        F.when(split & (colon > 1), F.substr(authority, colon + 1)).alias("port"),
        F.when(split, F.when(path == "", "/").otherwise(path)).otherwise(url).alias("path"),
    )
