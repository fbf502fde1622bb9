"""Column functions over text: tokens, edit distance, slugs, URLs. All of them run in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens are cut to this many characters; a query has at most so many terms and characters.
TOKEN_CHARS = 64
QUERY_TERMS = 32
QUERY_CHARS = 512


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def runs(text: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text; null gives none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))


def tokenize(text: Column) -> Column:
    """Search tokens: runs, each cut to TOKEN_CHARS."""
    return F.transform(runs(text), lambda t: F.substr(t, F.lit(1), F.lit(TOKEN_CHARS)))


def join_fields(fields: list[str], present: list[str]) -> Column:
    """The named fields that exist, without empty ones, joined by a blank."""
    return F.concat_ws(" ", *(F.when(F.col(f).cast("string") != "", F.col(f).cast("string")) for f in fields if f in present))


def or_else(*options: Column | str) -> Column:
    """The first option that is neither null nor empty."""
    *cols, last = options
    return F.coalesce(*(F.when(c != "", c) for c in cols), last if isinstance(last, Column) else F.lit(last))


# ---- edit distance ----------------------------------------------------------------------------------


def allowed_edits(term: Column, cap: int | Column = 2) -> Column:
    """0 up to two characters, 1 up to five, else 2; at most cap."""
    cap = cap if isinstance(cap, Column) else F.lit(max(0, min(2, cap)))
    return F.least(cap, F.when(F.length(term) <= 2, 0).when(F.length(term) <= 5, 1).otherwise(2))


def boost(distance: Column, edits: Column) -> Column:
    return F.lit(1.0) - distance / (edits + 1)


def osa(a: Column, b: Column) -> Column:
    """Optimal string alignment distance: insertions, deletions, substitutions, swaps of neighbours.

    A row of the table has no dependency along itself if it is written as
    row[j] = j + min over k <= j of (c[k] - k), where c[k] takes deletion, substitution and swap only.
    """
    x, y = (F.filter(F.split(s, ""), lambda c: c != "") for s in (a, b))

    def table(ab: Column) -> Column:
        x, y = ab["x"], ab["y"]
        n = F.size(y)
        first = F.sequence(F.lit(0), n)
        start = F.struct(first.alias("before"), first.alias("last"))

        def step(rows: Column, i: Column) -> Column:
            here, back = F.get(x, i - 1), F.get(x, i - 2)

            def cell(k: Column) -> Column:
                swap = F.when((i > 1) & (k > 1) & (here == F.get(y, k - 2)) & (back == F.get(y, k - 1)), F.get(rows["before"], k - 2) + 1)
                kept = F.get(rows["last"], k - 1) + F.when(here == F.get(y, k - 1), 0).otherwise(1)
                return F.when(k == 0, i).otherwise(F.least(F.get(rows["last"], k) + 1, kept, F.coalesce(swap, F.lit(1 << 20))))

            fill = lambda c: F.transform(c, lambda _, j: j + F.array_min(F.transform(F.slice(c, F.lit(1), j + 1), lambda v, k: v - k)))
            return F.struct(rows["last"].alias("before"), bind(F.transform(first, cell), fill).alias("last"))

        return F.when(F.size(x) == 0, n).when(n == 0, F.size(x)).otherwise(F.aggregate(F.sequence(F.lit(1), F.size(x)), start, step, lambda r: F.get(r["last"], n)))

    return bind(F.struct(x.alias("x"), y.alias("y")), table)


def may_match(query: Column, term: Column, edits: Column) -> Column:
    """Cheap and never wrong about a match: lengths, then Levenshtein, which is at most twice the distance."""
    return (F.abs(F.length(query) - F.length(term)) <= edits) & F.levenshtein(query, term, 4).between(0, 2 * edits)


def deletions(term: Column, most: int) -> Column:
    """The term and everything that up to `most` deletions leave of it."""
    cut = lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))), lambda i: F.concat(F.substr(t, F.lit(1), i - 1), F.substr(t, i + 1, F.length(t))))
    out = F.array(term)
    for _ in range(most):
        out = F.array_distinct(F.concat(out, F.flatten(F.transform(out, cut))))
    return out


# ---- hashing ----------------------------------------------------------------------------------------

#: Offset basis of FNV-1a with 64 bits, and its prime, which is 2**40 + 435.
FNV_OFFSET = 0xCBF29CE484222325
FNV_PRIME = 0x100000001B3


def fnv1a64(term: Column) -> Column:
    """FNV-1a of an ASCII term as BIGINT bits, in two 32-bit halves so that nothing overflows."""
    mask = F.lit(0xFFFFFFFF).cast("long")
    start = F.struct(F.lit(FNV_OFFSET >> 32).cast("long").alias("h"), F.lit(FNV_OFFSET & 0xFFFFFFFF).cast("long").alias("l"))

    def step(s: Column, c: Column) -> Column:
        low = s["l"].bitwiseXOR(F.ascii(c).cast("long"))
        product = low * 435
        high = (s["h"] * 435 + F.shiftright(product, 32) + F.shiftleft(low, 8)).bitwiseAND(mask)
        return F.struct(high.alias("h"), product.bitwiseAND(mask).alias("l"))

    join = lambda s: F.shiftleft(s["h"], 32).bitwiseOR(s["l"])
    return F.aggregate(F.filter(F.split(term, ""), lambda c: c != ""), start, step, join)


def fingerprint_hex(bits: Column) -> Column:
    return F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(bits)), 16, "0"))


# ---- names and addresses ----------------------------------------------------------------------------


def class_name(text: Column) -> Column:
    """Lower case, everything but 0-9 and a-z to one dash, one dash off either end; null gives an empty string."""
    dashed = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^0-9a-z]+", "-")
    return F.regexp_replace(dashed, "^-|-$", "")


def camel_case(text: Column) -> Column:
    """The class name with dash-letter pairs as capitals; a dash before a digit stays."""
    up = lambda w, i: F.when((i > 0) & w.rlike("^[a-z]"), F.initcap(w)).when(i > 0, F.concat(F.lit("-"), w)).otherwise(w)
    return F.array_join(F.transform(F.split(class_name(text), "-"), up), "")


def resolve_url(url: Column, base: str) -> Column:
    """Absolute, data and blob addresses stay; others get the base."""
    return F.when(url.rlike("(?i)^(https?:|data:|blob:)"), url).otherwise(F.concat(F.lit(base), url))


def strip_slashes(url: Column) -> Column:
    return F.regexp_replace(url, "/+$", "")


def widget_parts(href: Column) -> Column:
    """Path and name (without extension) of an address's path: struct<path, name>."""
    path = F.filter(F.split(F.regexp_replace(F.parse_url(href, F.lit("PATH")), "^/+|/+$", ""), "/"), lambda s: s != "")
    return bind(path, lambda p: F.struct(F.array_join(F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0))), "/").alias("path"), F.regexp_replace(F.coalesce(F.try_element_at(p, F.lit(-1)), F.lit("")), r"\.[^.]*$", "").alias("name")))


def widget_asset(prefix: str, parts: Column, extension: str) -> Column:
    return F.concat(F.lit(prefix), parts["path"], F.lit("/"), parts["name"], F.lit("." + extension))


def query_params(url: Column) -> Column:
    """Decoded query parameters as a map; none gives an empty map."""
    query = F.coalesce(F.parse_url(url, F.lit("QUERY")), F.lit(""))
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    entry = lambda p: F.struct(F.try_url_decode(F.substring_index(p, "=", 1)).alias("key"), F.when(p.contains("="), F.try_url_decode(F.substr(p, F.instr(p, "=") + 1))).otherwise("").alias("value"))
    last = lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["key"]), F.map_from_entries(F.array(e)))
    return F.aggregate(F.transform(pairs, entry), F.create_map().cast("map<string,string>"), last)


def media_base(html: Column, base: Column) -> Column:
    """./media_ references made to lie under a base path."""
    return F.regexp_replace(html, F.lit(r'(src|href)="\./media_'), F.concat(F.lit('$1="'), base, F.lit("/media_")))


def is_site_path(path: Column) -> Column:
    """An absolute path of this site: one leading slash."""
    return path.startswith("/") & ~path.startswith("//")


def truthy(text: Column) -> Column:
    """Anything but false, off and no."""
    return ~F.lower(F.trim(text)).isin("false", "off", "no")


#: Aliases of providers, sampling rates by name, availability by name.
PROVIDER_ALIASES = {
    "builtin": "builtin",
    "built-in": "builtin",
    "chrome": "builtin",
    "local": "local",
    "local-server": "local",
    "ollama": "local",
    "download": "download",
    "webllm": "download",
    "auto": "auto",
}
SAMPLING_RATES = {"on": 1, "off": 0, "high": 10, "low": 1000}
DEFAULT_RATE = 100
AVAILABILITY = {"readily": "available", "after-download": "downloadable", "no": "unavailable"}


def looked_up(key: Column, table: dict, default) -> Column:
    """The table's entry for a key, in lower case, or the default."""
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(key)), default if isinstance(default, Column) else F.lit(default))


def image_variants(src: Column, breakpoints: list[tuple[str, int]] = (("(min-width: 600px)", 2000), ("", 750))) -> Column:
    """For each breakpoint a webp and a fallback address: array<struct<media, type, url>>."""
    path = F.substring_index(src, "?", 1)
    extension = F.regexp_extract(path, r"\.([^./]+)$", 1)
    address = lambda width, kind: F.concat(path, F.lit(f"?width={width}&format="), kind, F.lit("&optimize=medium"))
    rows = []
    for kind in (F.lit("webply"), extension):
        for media, width in breakpoints:
            rows.append(F.struct(F.lit(media).alias("media"), kind.alias("type"), address(width, kind).alias("url")))
    return F.array(*rows)
