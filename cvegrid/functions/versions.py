"""Versions and version ranges as comparable columns, in the order of their ecosystem.

A version becomes a text key: numbers padded to one width, and marks below the dot that continues a release, so that the
order of the texts is the order of the versions. Keys of one ecosystem are comparable with each other alone.
"""

from pyspark.sql import Column, functions as F

#: A range as stored: bounds are version keys; ``known`` is false where a bound
#: is no version of the ecosystem.
RANGE = "struct<lo:string,lo_in:boolean,hi:string,hi_in:boolean,known:boolean>"

_DIGITS = 18

#: Ecosystems, lower-case, by the rules their versions follow; dotted numbers in all others.
SCHEMES = {
    "pep440": ("pypi", "pip", "python"),
    "semver": ("npm", "go", "golang", "crates.io", "cargo", "rust", "nuget", "hex", "pub", "actions"),
    "maven": ("maven", "gradle"),
}
#: Qualifiers of the last scheme below a release, in order; all others come after it.
_MAVEN_BELOW = ("alpha", "beta", "milestone", "rc", "snapshot")


def scheme_of(ecosystem: Column) -> Column:
    """The rules of an ecosystem's versions; NULL for dotted numbers."""
    known = F.lower(ecosystem)
    out = F.lit(None).cast("string")
    for scheme, names in SCHEMES.items():
        out = F.when(known.isin(*names), scheme).otherwise(out)
    return out


def _number(digits: Column) -> Column:
    return F.lpad(F.regexp_replace(digits, "^0+", ""), _DIGITS, "0")


def _release(dotted: Column) -> Column:
    """Dotted numbers with equal width; trailing zeros go, so that 1.10 and 1.10.0 are one version."""
    return F.array_join(F.transform(F.split(F.regexp_replace(dotted, r"(\.0+)+$", ""), r"\."), _number), ".")


_NUMBERS = rf"\d{{1,{_DIGITS}}}(?:\.\d{{1,{_DIGITS}}})*"

# ``(`` marks a release that nothing follows; what comes before it has a lower mark, what comes after it a higher one, and
# all marks are lower than the dot

_PEP440 = (
    rf"^(?:(\d{{1,{_DIGITS}}})!)?({_NUMBERS})"
    rf"(?:[-_.]?(alpha|beta|preview|pre|rc|a|b|c)[-_.]?(\d{{0,{_DIGITS}}}))?"
    rf"(?:-(\d{{1,{_DIGITS}}})|[-_.]?(post|rev|r)[-_.]?(\d{{0,{_DIGITS}}}))?"
    rf"(?:[-_.]?(dev)[-_.]?(\d{{0,{_DIGITS}}}))?"
    r"(?:\+([a-z0-9]+(?:[-_.][a-z0-9]+)*))?$"
)


def _pep440_key(text: Column) -> Column:
    """Epoch, release, then: development alone, pre-release, none; post-release; development; local version."""
    part = lambda i: F.regexp_extract(text, _PEP440, i)
    pre, implied, post, dev, local = part(3), part(5), part(6), part(8), part(10)
    kind = F.when(pre.startswith("a"), "a").when(pre.startswith("b"), "b").otherwise("c")
    no_post = (implied == "") & (post == "")
    pre_mark = (
        F.when(pre != "", F.concat(F.lit("#"), kind, _number(part(4))))
        .when(no_post & (dev != ""), "!").otherwise("(")
    )
    post_mark = F.when(no_post, "!").otherwise(F.concat(F.lit("#"), _number(F.concat(implied, part(7)))))
    dev_mark = F.when(dev != "", F.concat(F.lit("!"), _number(part(9)))).otherwise("(")
    segments = F.transform(F.split(local, "[-_.]"), lambda x: F.when(
        x.rlike(r"^\d+$"), F.concat(F.lit("~"), _number(x))).otherwise(x))  # numbers come after words
    local_mark = F.when(local != "", F.concat(F.lit("+"), F.array_join(segments, "."))).otherwise("")
    key = F.concat(_number(part(1)), F.lit("/"), _release(part(2)), pre_mark, post_mark, dev_mark, local_mark)
    return F.when(text.rlike(_PEP440), key)


_SEMVER = rf"^({_NUMBERS})(?:-([0-9a-z-]+(?:\.[0-9a-z-]+)*))?(?:\+[0-9a-z.-]+)?$"


def _semver_key(text: Column) -> Column:
    """Release, then the identifiers of a pre-release: numbers before words, fewer before more. Builds do not count.

    Words keep their case: upper-case letters come first.
    """
    pattern = _SEMVER.replace("a-z", "a-zA-Z")
    pre = F.regexp_extract(text, pattern, 2)
    names = F.transform(F.split(pre, r"\."), lambda x: F.when(
        x.rlike(rf"^\d{{1,{_DIGITS}}}$"), F.concat(F.lit("!"), _number(x))).otherwise(F.concat(F.lit("#"), x)))
    mark = F.when(pre == "", "(").otherwise(F.concat(F.lit("!"), F.array_join(names, " ")))
    return F.when(text.rlike(pattern), F.concat(_release(F.regexp_extract(text, pattern, 1)), mark))


_MAVEN = rf"^({_NUMBERS})((?:[-.]?(?:[a-z]+|\d{{1,{_DIGITS}}}))*)$"


def _maven_key(text: Column) -> Column:
    """Release, then qualifiers: those below a release in their order, the release itself, a service pack, all others."""
    rest = F.regexp_replace(F.regexp_extract(text, _MAVEN, 2), r"([-.]0+)+$", "")
    for short, long in (("a", "alpha"), ("b", "beta"), ("m", "milestone")):
        rest = F.regexp_replace(rest, rf"(?<![a-z]){short}(?=\d)", long)
    tokens = F.regexp_extract_all(rest, F.lit(r"[-.]?(?:[a-z]+|\d+)"), F.lit(0))

    def mark(token: Column) -> Column:
        name = F.regexp_replace(token, "^[-.]", "")
        out = F.concat(F.lit("("), name)
        for i, below in enumerate(_MAVEN_BELOW):
            out = F.when(name.isin(*(["rc", "cr"] if below == "rc" else [below])), "!\"#$%"[i]).otherwise(out)
        out = F.when(name == "sp", "'").when(name.isin("final", "ga", "release"), "").otherwise(out)
        digits = F.concat(F.when(token.startswith("."), ".").otherwise(")"), _number(name))
        return F.when(name.rlike(r"^\d"), digits).otherwise(out)

    key = F.concat(_release(F.regexp_extract(text, _MAVEN, 1)), F.array_join(F.transform(tokens, mark), ""), F.lit("&"))
    wildcard = text.rlike(r"[-.]x($|[-.])")  # names many versions, not one
    return F.when(text.rlike(_MAVEN) & ~wildcard, key)


def version_key(text: Column, scheme: Column | None = None) -> Column:
    """A key whose text order is version order by ``scheme``; NULL for what is no version by it.

    Without a scheme only dotted numbers are versions: ``1.10.0`` -> ``…01.…10``.
    """
    plain = F.regexp_replace(F.trim(text), r"^[vV]", "")
    dotted = F.when(plain.rlike(rf"^{_NUMBERS}$"), _release(plain))
    if scheme is None:
        return dotted
    return (
        F.when(scheme == "pep440", _pep440_key(F.lower(plain)))
        .when(scheme == "semver", _semver_key(plain))
        .when(scheme == "maven", _maven_key(F.lower(plain)))
        .otherwise(dotted)
    )


def parse_ranges(text: Column, scheme: Column | None = None) -> Column:
    """Range text to an array of ranges; conditions of one range and the ranges
    themselves are both separated by commas.

    A lower bound, ``*`` or an exact version opens a range; an upper bound
    closes the open one, or stands alone as a range from the beginning.
    """
    tokens = F.filter(F.split(text, r"\s*,\s*"), lambda t: F.trim(t) != "")
    lowest = F.lit("")

    def bound(t: Column) -> Column:
        return version_key(F.regexp_replace(t, r"^[<>=\s]+", ""), scheme)

    def opened(t: Column) -> Column:
        key = bound(t)
        exact = ~F.trim(t).rlike(r"^[<>*]")
        everything = F.trim(t) == "*"
        return F.struct(
            F.when(everything, lowest).otherwise(key).alias("lo"),
            (exact | everything | F.trim(t).startswith(">=")).alias("lo_in"),
            F.when(exact, key).alias("hi"),
            exact.alias("hi_in"),
            (everything | key.isNotNull()).alias("known"),
        ).cast(RANGE)

    def closed(lo: Column, lo_in: Column, known: Column, t: Column) -> Column:
        key = bound(t)
        return F.struct(
            lo.alias("lo"), lo_in.alias("lo_in"), key.alias("hi"),
            F.trim(t).startswith("<=").alias("hi_in"), (known & key.isNotNull()).alias("known"),
        ).cast(RANGE)

    def step(acc: Column, t: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        upper = F.trim(t).startswith("<")
        joins = upper & (F.size(acc) > 0) & last["hi"].isNull()
        before = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        return (
            F.when(joins, F.concat(before, F.array(closed(last["lo"], last["lo_in"], last["known"], t))))
            .when(upper, F.concat(acc, F.array(closed(lowest, F.lit(True), F.lit(True), t))))
            .otherwise(F.concat(acc, F.array(opened(t))))
        )

    return F.aggregate(tokens, F.array().cast(f"array<{RANGE}>"), step)


def inside(version: Column, lo: Column, lo_in: Column, hi: Column, hi_in: Column) -> Column:
    """Whether a version key lies in a range; the upper bound may be missing."""
    above = F.when(lo_in, version >= lo).otherwise(version > lo)
    return above & (hi.isNull() | F.when(hi_in, version <= hi).otherwise(version < hi))


def match_level(version: Column, lo: Column, lo_in: Column, hi: Column, hi_in: Column, known: Column) -> Column:
    """2 = affected, 1 = cannot tell, 0 = not in this range."""
    unclear = version.isNull() | ~F.coalesce(known, F.lit(False))
    return F.when(unclear, 1).when(inside(version, lo, lo_in, hi, hi_in), 2).otherwise(0)
