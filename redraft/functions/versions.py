"""Column functions on package versions and version ranges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _let(x: Column, body: Callable[[Column], Column]) -> Column:
    """body(x) with x computed once, however often body uses it."""
    return F.get(F.transform(F.array(x), body), 0)


def _number(text: Column) -> Column:
    """A text of at most 18 digits as a long, else null."""
    return F.when(text.rlike("^[0-9]{1,18}$"), text).try_cast("long")


def major(version: Column) -> Column:
    """First number of a version or range after whatever signs stand before it; 0 if there is none."""
    return F.coalesce(_number(F.regexp_extract(version, r"^[\s^~<>=]*([0-9]+)(?:\.|$)", 1)), F.lit(0))


def parts(version: Column) -> Column:
    """(major, minor, patch) of a version up to its first hyphen as an array that sorts by precedence; null without a major number."""
    numbers = F.transform(F.split(F.substring_index(version, "-", 1), r"\."), lambda x, i: _number(x))
    zero = F.lit(0).cast("long")
    return _let(numbers, lambda n: F.when(F.get(n, 0).isNotNull(), F.array(F.get(n, 0), F.coalesce(F.get(n, 1), zero), F.coalesce(F.get(n, 2), zero))))


def is_release(version: Column) -> Column:
    """No sign of a version before its release."""
    return ~F.lower(version).rlike("alpha|prerelease|rc|beta")


# Ranges are unions of intervals of keys, lower end included, upper end not.  A key (major, minor, patch, tail) sorts as versions do: the tail of a release
# is "~", behind all tails of pre-releases; "" lies before them; and a tail with a blank behind it is next to it, with nothing between.
RELEASE, FIRST, NEXT = "~", "", " "
_FAR = 1 << 40
MARK = "\x01"


def key(a: Column, b: Column, c: Column, tail: Column | str) -> Column:
    return F.struct(a.alias("major"), b.alias("minor"), c.alias("patch"), (F.lit(tail) if isinstance(tail, str) else tail).alias("tail"))


def tail(pre: Column) -> Column:
    """Sort key of what stands behind a version's hyphen: its identifiers in turn, numbers before words and by their value; fewer come first if all else is equal."""
    number = lambda x: F.regexp_replace(x, "^0+(?=.)", "")
    one = lambda x: F.when(x.rlike("^[0-9]+$"), F.concat(F.lit("1"), F.lpad(F.length(number(x)).cast("string"), 3, "0"), number(x), F.lit("!"))).otherwise(F.concat(F.lit("2"), x, F.lit("!")))
    return F.when(pre == "", RELEASE).otherwise(F.array_join(F.transform(F.split(pre, r"\."), one), ""))


def range_bounds(spec: Column) -> Column:
    """(lower, upper) keys of one caret, tilde, comparison, wildcard or exact range; null if it is none of these.

    Caret keeps the first non-zero part, tilde the minor part, a missing part is a wildcard.  What stands behind a plus sign counts for nothing.
    """
    part = r"(?:[0-9]{1,9}|[xX*])"
    shape = rf"^\s*(\^|~>?|>=|<=|>|<|=)?\s*[v=]?({part}?(?:\.{part}){{0,2}})(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?\s*$(?s:.*)"
    # one match gives sign, numbers and pre-release; what does not match has no mark and stays in one piece
    read = F.split(F.when(~F.contains(spec, F.lit(MARK)), F.regexp_replace(spec, shape, f"$1{MARK}$2{MARK}$3")), MARK)
    numbers = lambda r: F.split(r[1], r"\.")
    number = lambda n, i: F.get(n, i).try_cast("long")
    fields = lambda r: _let(numbers(r), lambda n: F.struct(r[0].alias("op"), number(n, 0).alias("a"), number(n, 1).alias("b"), number(n, 2).alias("c"), tail(r[2]).alias("tail")))
    zero, far = F.lit(0).cast("long"), F.lit(_FAR)

    def ends(r: Column) -> Column:
        op, a, b, c = r["op"], r["a"], r["b"], r["c"]
        open_ = c.isNull() | b.isNull() | a.isNull()  # a wildcard has no pre-release
        least, most = key(zero, zero, zero, RELEASE), key(far, zero, zero, FIRST)
        next_major, next_minor = key(a + 1, zero, zero, FIRST), key(a, b + 1, zero, FIRST)
        # the least version behind all that the parts name
        behind = F.when(a.isNull(), most).when(b.isNull(), next_major).when(c.isNull(), next_minor).otherwise(F.when(r["tail"] == RELEASE, key(a, b, c + 1, FIRST)).otherwise(key(a, b, c, F.concat(r["tail"], F.lit(NEXT)))))
        next_patch = key(a, b, c + 1, FIRST)
        caret = F.when(a.isNull() | b.isNull() | c.isNull() & (a == 0), behind).when(a > 0, next_major).when(b > 0, next_minor).otherwise(next_patch)
        tilde = F.when(a.isNull() | b.isNull(), behind).otherwise(next_minor)
        low = key(F.coalesce(a, zero), F.coalesce(b, zero), F.coalesce(c, zero), F.when(open_, RELEASE).otherwise(r["tail"]))
        # below a version: up to its pre-releases, unless one of them is named
        below = key(F.coalesce(a, zero), F.coalesce(b, zero), F.coalesce(c, zero), F.when(open_ | (r["tail"] == RELEASE), FIRST).otherwise(r["tail"]))
        lower = F.when(op == ">", behind).when(op.isin("<", "<="), least).otherwise(low)
        upper = F.when(op.isin(">", ">="), most).when(op == "<", below).when(op == "^", caret).when(op.isin("~", "~>"), tilde).otherwise(behind)
        return F.struct(lower.alias("lower"), upper.alias("upper"))

    return _let(read, lambda r: F.when(F.size(r) == 3, _let(fields(r), ends)))


def range_sets(spec: Column) -> Column:
    """The alternatives of a range (between ||) as (lower, upper) keys: what all of an alternative's comparisons allow; `a - b` is from a to b; null for one that cannot be read or allows nothing."""

    def alternative(text: Column) -> Column:
        plain = lambda e: F.regexp_replace(F.when(F.size(e) == 2, F.concat(F.lit(">="), F.trim(e[0]), F.lit(" <="), F.trim(e[1]))).otherwise(text), r"([\^~<>=])\s+", "$1")
        words = lambda e: F.filter(F.split(plain(e), r"\s+"), lambda x: x != "")
        bounds = lambda ws: F.transform(F.when(F.size(ws) == 0, F.array(F.lit("*"))).otherwise(ws), range_bounds)

        def both(bs: Column) -> Column:
            least = F.struct(F.array_max(F.transform(bs, lambda b: b["lower"])).alias("lower"), F.array_min(F.transform(bs, lambda b: b["upper"])).alias("upper"))
            return F.when(~F.exists(bs, lambda b: b.isNull()), _let(least, lambda b: F.when(b["lower"] < b["upper"], b)))

        return _let(F.split(text, r"\s+-\s+"), lambda e: _let(words(e), lambda ws: _let(bounds(ws), both)))

    return F.transform(F.split(spec, r"\|\|"), alternative)


def merged(sets: Column) -> Column:
    """Intervals that overlap or have no release between them as one; each also takes the pre-releases of its first release."""
    key_type = "struct<major:bigint,minor:bigint,patch:bigint,tail:string>"
    wide = F.transform(sets, lambda r: F.struct(key(r["lower"]["major"], r["lower"]["minor"], r["lower"]["patch"], F.when(r["lower"]["tail"] == RELEASE, FIRST).otherwise(r["lower"]["tail"])).alias("lower"), r["upper"].alias("upper")))

    def step(found: Column, r: Column) -> Column:
        last = F.get(found, F.size(found) - 1)
        joined = F.concat(F.slice(found, 1, F.greatest(F.size(found) - 1, F.lit(0))), F.array(F.struct(last["lower"].alias("lower"), F.greatest(last["upper"], r["upper"]).alias("upper"))))
        return F.when((F.size(found) > 0) & (r["lower"] <= last["upper"]), joined).otherwise(F.concat(found, F.array(r)))

    return F.aggregate(F.array_sort(wide), F.array().cast(f"array<struct<lower:{key_type},upper:{key_type}>>"), step)


def range_allows(required: Column, consumer: Column) -> Column:
    """Whether the required range allows all that the consumer's range allows; false if either cannot be read or the consumer's allows nothing.

    Every release counts, so alternatives that follow one another without a release between them count as one: `^1 || ^2` allows all of `>=1.0.0 <3.0.0`.
    Of pre-releases those count from which the consumer's range starts by name, and they stand in order: `^6.0.0` allows `^6.30.3-pre`, `>=1.0.0-rc.1` allows
    `1.0.0-rc.2`, and no alternative of `^1 || ^2` allows `2.0.0-rc.1`.
    """
    within = lambda c, r: (r["lower"] <= c["lower"]) & (c["upper"] <= r["upper"])

    def allowed(both: Column) -> Column:
        rs, cs = both["required"], both["consumer"]
        named = lambda c: ~c["lower"]["tail"].isin(RELEASE, FIRST)
        starts = lambda c: F.exists(rs, lambda r: (r["lower"] <= c["lower"]) & (c["lower"] < r["upper"]))
        readable = ~F.exists(rs, lambda r: r.isNull()) & ~F.exists(cs, lambda c: c.isNull())
        inside = _let(merged(rs), lambda ms: F.forall(cs, lambda c: F.exists(ms, lambda m: within(c, m)) & (~named(c) | starts(c))))
        return F.when(readable, inside)

    return F.coalesce(_let(F.struct(range_sets(required).alias("required"), range_sets(consumer).alias("consumer")), allowed), F.lit(False))
