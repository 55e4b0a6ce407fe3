"""Scalar functions of the query engines as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
INTEGER_BOUND = (1 << 53) - 1


def ascii_fold(c: Column) -> Column:
    """Lower case of A-Z only."""
    return F.translate(c, _UPPER, _LOWER)


def prefix_match(c: Column, prefix: str) -> Column:
    """Case-sensitive prefix of at least two bytes."""
    if len(prefix.encode()) < 2:
        raise ValueError("a prefix has at least two bytes")
    return c.startswith(prefix)


def bounded_distance(a: Column, b: Column, k: int) -> Column:
    """Edit distance if it is at most k, else null; lengths are compared first."""
    if not 0 <= k <= 4:
        raise ValueError("the bound is 0 to 4")
    near = F.abs(F.length(a) - F.length(b)) <= k
    return F.when(near, F.nullif(F.levenshtein(a, b, k), F.lit(-1)))


def word_tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits in order."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def has_phrase(c: Column, phrase: str) -> Column:
    """The phrase's tokens stand next to each other; an empty phrase matches nothing."""
    import re

    wanted = [w for w in re.findall(r"[^\W_]+", phrase.lower())]
    if not wanted:
        return F.lit(False)
    # tokens hold no spaces, so the tokens in one line hold the phrase exactly if they hold it as neighbours
    line = F.concat(F.lit(" "), F.array_join(word_tokens(c), " "), F.lit(" "))
    return F.coalesce(F.contains(line, F.lit(f" {' '.join(wanted)} ")), F.lit(False))


def content_digest(*parts: Column, domain: str = "") -> Column:
    """SHA-256 of the parts, each preceded by its length so that no two lists of parts agree; null is its own value."""
    framed = [F.concat(F.coalesce(F.length(p.cast("string")).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(p.cast("string"), F.lit(""))) for p in parts]
    return F.sha2(F.concat(F.lit(domain), F.lit("|"), *framed), 256)


def canonical_json(**members: Column) -> Column:
    """A JSON object with sorted keys; null members are absent."""
    return F.to_json(F.struct(*[members[k].alias(k) for k in sorted(members)]))


def normal_path(c: Column) -> Column:
    """Forward slashes, no empty or `.` segments; null if a `..` would leave the root or the path is absolute."""
    parts = F.filter(F.split(F.regexp_replace(c, r"\\", "/"), "/"), lambda s: (s != "") & (s != "."))
    return F.when(~F.regexp_replace(c, r"\\", "/").startswith("/") & ~F.exists(parts, lambda s: s == "..") & (F.size(parts) > 0), F.array_join(parts, "/"))


def name_list(c: Column) -> Column:
    """Names separated by commas or white space."""
    return F.filter(F.split(c, r"[,\s]+"), lambda s: s != "")


def interface_matches(c: Column, wanted: int) -> Column:
    """Whether a list of positive integers holds ``wanted``; null if any member is malformed."""
    parts = name_list(c)
    fine = (F.size(parts) > 0) & F.forall(parts, lambda s: s.rlike("^[0-9]{1,9}$") & (s.try_cast("int") > 0))
    return F.when(fine, F.exists(parts, lambda s: s.try_cast("int") == wanted))


def is_atom(c: Column) -> Column:
    return c.rlike("^[a-z][a-z0-9_]*$")


def is_locale(c: Column) -> Column:
    return c.rlike("^[a-z]{2}[A-Z]{2}$")


def is_identifier(c: Column) -> Column:
    """Lower-case segments joined by dots, each starting with a letter."""
    return c.rlike(r"^[a-z][a-z0-9_-]*(\.[a-z][a-z0-9_-]*)*$")


def name_class(c: Column) -> Column:
    """dynamic ($, [ or ] inside), unsupported (not a plain name) or plain."""
    return F.when(c.rlike(r"[$\[\]]"), "dynamic").when(~c.rlike(r"^[A-Za-z_][A-Za-z0-9_.]*$"), "unsupported").otherwise("plain")


def saved_names(c: Column) -> Column:
    """Names of a saved-variable list with a state: valid, or malformed."""
    return F.transform(name_list(c), lambda s: F.struct(s.alias("name"), F.when(s.rlike("^[A-Za-z_][A-Za-z0-9_]*$"), "valid").otherwise("malformed").alias("state")))


def integer_of(c: Column) -> Column:
    """Integer value of a decimal or 0x lexeme within +-(2^53 - 1), else null."""
    hexadecimal = F.conv(F.substring(F.ltrim(c, F.lit("-")), 3, 16), 16, 10).cast("decimal(38,0)")
    value = F.when(c.rlike("^-?0[xX][0-9a-fA-F]{1,14}$"), F.when(c.startswith("-"), -hexadecimal).otherwise(hexadecimal)).when(c.rlike("^-?[0-9]{1,17}$"), c.try_cast("decimal(38,0)"))
    return F.when(F.abs(value) <= INTEGER_BOUND, value)


def exact_sum(a: Column, b: Column, subtract: bool = False) -> Column:
    """Sum or difference of two lexemes; null outside the exact range or for what isn't an integer."""
    total = integer_of(a) - integer_of(b) if subtract else integer_of(a) + integer_of(b)
    return F.when(F.abs(total) <= INTEGER_BOUND, total.cast("long"))


def union_members(c: Column) -> Column:
    """Members of an `A|B` type, distinct and sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(c, r"\|"), lambda s: F.trim(s)), lambda s: s != "")))


def version_parts(c: Column) -> Column:
    """major, minor, patch of a version; null unless all three are integers."""
    return F.when(c.rlike(r"^(0|[1-9][0-9]{0,8})\.(0|[1-9][0-9]{0,8})\.(0|[1-9][0-9]{0,8})$"), F.transform(F.split(c, r"\."), lambda s: s.cast("int")))


def unaccented(c: Column) -> Column:
    """Latin letters without their accents (U+00C0 to U+024F that decompose to one letter), everything else as it is."""
    import unicodedata

    pairs = [(chr(i), d[0]) for i in range(0xC0, 0x250) if len(d := unicodedata.normalize("NFD", chr(i))) > 1 and d[0].isascii()]
    return F.translate(c, "".join(a for a, _ in pairs), "".join(b for _, b in pairs))


def has_folded_phrase(c: Column, phrase: str) -> Column:
    """has_phrase() where accents of Latin letters don't count, on either side."""
    import unicodedata

    plain = "".join(ch for ch in unicodedata.normalize("NFD", phrase) if not unicodedata.combining(ch))
    return has_phrase(unaccented(c), plain)


def nested_json(members: dict[str, Column | dict]) -> Column:
    """A JSON object of columns and further objects, keys sorted at every depth; null members are absent, an object without members is not."""

    def build(level: dict) -> Column:
        return F.struct(*[(build(v) if isinstance(v, dict) else v).alias(k) for k, v in sorted(level.items())])

    return F.to_json(build(members))


def compare_versions(a: Column, b: Column) -> Column:
    """older, equal or newer of a against b by major, minor and patch as numbers; incomparable if either is no version."""
    x, y = version_parts(a), version_parts(b)
    return F.when(x.isNull() | y.isNull(), "incomparable").when(x < y, "older").when(x > y, "newer").otherwise("equal")
