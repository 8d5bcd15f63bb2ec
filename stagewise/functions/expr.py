"""Column helpers shared by models and metrics."""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..domain import ADEQUATE, BANDS, INDICATIVE, Z


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once, however often it is named: Spark copies what a name stands for to each place that names it."""
    return F.transform(F.array(value), use)[0]


@cache
def needed(pattern: str) -> tuple[str, ...]:
    """Texts of which each match of a pattern holds one; none if that can't be told: the pattern ignores case, or is written in a way that Java alone knows."""
    parser = re._parser  # type: ignore[attr-defined]

    def of(items) -> tuple[str, ...]:
        found, run = [], ""
        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                run += chr(arg)
            elif name not in ("AT", "ASSERT", "ASSERT_NOT"):  # those take no character
                found, run = [*found, (run,)], ""
                if name == "SUBPATTERN":
                    found.append(() if arg[1] or arg[2] else of(arg[3]))
                elif name == "BRANCH":
                    parts = [of(x) for x in arg[1]]
                    found.append(tuple(dict.fromkeys(t for p in parts for t in p)) if all(parts) else ())
                elif name.endswith("_REPEAT") and arg[0] > 0:
                    found.append(of([*arg[2]] * arg[0] if len(arg[2]) == 1 and str(arg[2][0][0]) == "LITERAL" else arg[2]))
        return max((x for x in (*found, (run,)) if all(x)), key=lambda x: (min(map(len, x), default=0), -len(x)), default=())

    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")
            parsed = parser.parse(pattern)
    except (re.error, Warning, OverflowError):
        return ()
    return () if parsed.state.flags & (re.IGNORECASE | re.VERBOSE) or re.search(r"&&|\\Q|\[\[|\[[^]]*\[", pattern) else of(parsed)


def holds(text: Column, texts: tuple[str, ...]) -> Column:
    """Whether a text holds one of these; true if there are none."""
    return reduce(lambda a, b: a | b, (text.contains(x) for x in texts)) if texts else F.lit(True)


def needed_of(patterns: tuple[str, ...]) -> tuple[str, ...]:
    """Texts of which each match of one of the patterns holds one; none if that can't be told of each."""
    each = [needed(p) for p in patterns]
    return tuple(dict.fromkeys(t for x in each for t in x)) if all(each) else ()


def meets(text: Column, *patterns: str) -> Column:
    """Whether a text meets one of the patterns. Most texts hold none of the words that a match needs: those are looked for first, which takes a small part of the pattern's time."""
    whole = text.rlike("|".join(f"(?:{p})" for p in patterns) if len(patterns) > 1 else patterns[0])
    words = needed_of(patterns)
    return holds(text, words) & whole if words else whole


def count_where(condition: str | Column) -> Column:
    return F.count_if(F.coalesce(col(condition), F.lit(False)))


def pct(x: Column, n: Column, digits: int = 1) -> Column:
    """x of n in percent; null for no n."""
    return F.round(F.lit(100.0) * x / F.nullif(n, F.lit(0)), digits)


def wilson(x: Column, n: Column, upper: bool) -> Column:
    """A bound, in percent, of the 95 % Wilson score interval for x successes of n; null for no n."""
    size = F.nullif(n, F.lit(0)).cast("double")
    p = x.cast("double") / size
    z2 = Z * Z
    half = F.lit(Z) * F.sqrt(p * (1 - p) / size + F.lit(z2) / (F.lit(4.0) * size * size))
    centre = p + F.lit(z2) / (F.lit(2.0) * size)
    bound = ((centre + half) if upper else (centre - half)) / (1 + F.lit(z2) / size)
    return F.when(size.isNotNull(), F.round(F.lit(100.0) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), bound)), 1))


def band(rate: Column) -> Column:
    """The label of the highest band whose floor a percentage reaches."""
    out = F.when(rate.isNull(), "No data")
    for label, floor in BANDS[:-1]:
        out = out.when(rate >= floor, label)
    return out.otherwise(BANDS[-1][0])


def confidence(n: Column) -> Column:
    return F.when(n >= ADEQUATE, "Adequate").when(n >= INDICATIVE, "Indicative").otherwise("Too small")


def filled(c: str | Column, default: str | None = None) -> Column:
    """Trimmed text; an empty one becomes null, or the default."""
    x = F.nullif(F.trim(col(c)), F.lit(""))
    return x if default is None else F.coalesce(x, F.lit(default))


def safe_date(c: str | Column) -> Column:
    """The date in the first ten characters, year first, with dashes or slashes; else null."""
    x = F.substring(col(c), 1, 10)
    return F.when(x.rlike(r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}$"), F.translate(x, "/", "-").try_cast("date"))


def safe_int(c: str | Column) -> Column:
    """Whole numbers as they are, others rounded to the nearest one, halves to the even one; else null."""
    return F.rint(col(c).try_cast("double")).try_cast("int")


def safe_double(c: str | Column) -> Column:
    return col(c).try_cast("double")


def key_of(c: str | Column) -> Column:
    """A surrogate key that folds case."""
    return F.substring(F.md5(F.lower(col(c))), 1, 16)


def days(start: str | Column, end: str | Column) -> Column:
    return F.datediff(col(end), col(start)).cast("long")


def days_if_after(start: str | Column, end: str | Column) -> Column:
    return F.when(col(end) >= col(start), days(start, end))


def median(c: str | Column) -> Column:
    return F.median(col(c)).cast("double")
