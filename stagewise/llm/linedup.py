"""Line dedup by a segment-partition edit join. DataFrame functions only.

A line that holds a word is dropped if the same line, or one within max_edits (1 or 2) insertions, deletions and
substitutions of a character, stands earlier: in a smaller doc_id, or further up in the same document. Lines of
fewer than least_chars characters are compared for equality only; lines without a word always stay.

1. Equal lines are one, by their MD5, with the place where they first stand.
2. A line is cut into max_edits + 1 even segments. Two lines within max_edits share a segment, at almost the same
   place; so each line is entered under its segments and its length, and asks for the substrings of its own that
   such a segment can have become, for all lengths up to max_edits below its own (the multi-match-aware selection).
3. Lines that meet under a key with at most BUCKET entered lines are compared by length and by the parities of their
   letters' counts, of which an edit turns two at most, and of neighbouring letters' counts, of which it turns four. Those
   that are left are pairs, and are checked, without the ends that they have in common, by edit distance in a band of
   2 * max_edits + 1 diagonals, kept as bits of a number and moved on a character at a time.
4. Under a larger key lines are not compared. They must also share one of the GRAM * max_edits + 1 grams that come first
   in each, in an order in which grams that some leading lines of the key have come last: so lines that differ from
   those in different ways part from one another.
5. Where very many lines share such a gram too, they are not compared either. What differs lies in one or two stretches
   of the lines; these are cut into PARTS each, and the lines are entered anew, and ask, under all but the parts that hold
   the edits. A stretch gets PARTS times shorter in each round, so the keys fall apart, unless very many lines differ in
   the same characters.
   When no stretch is longer than a character, lines under a key are all within max_edits of those that ask there:
   the key's earliest line is all that is needed. So work grows with the lines, whatever stands under a key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, freed, stash, text_of

#: A line is frequent if it makes up more than one in so many of all lines; there are fewer of them than this.
FREQUENT = 2048
#: Entered lines under one key that a line is compared with, by three numbers of each.
BUCKET = 256
PARTS = 4
#: Characters of a gram, and lines whose grams count as common under a key.
GRAM = 3
LEADERS = 3
#: Places are compared as one number: the document's id, ten digits of its text's hash, nine of the line's number.
PLACE = "decimal(38,0)"
LINES, TEXTS = 10**9, 10**19


def whole(n: int) -> Column:
    return F.lit(str(n)).cast("decimal(20,0)")


def doc_key(doc_id: Column, text: Column) -> Column:
    """The place of a document's first line. Null ids come first; rows that repeat an id are ordered by their texts' hashes."""
    number = F.coalesce(doc_id.cast("decimal(19,0)"), F.lit(str(-(2**63) - 1)).cast("decimal(19,0)"))
    return (number * whole(TEXTS) + F.pmod(F.xxhash64(text), F.lit(TEXTS // LINES)).cast("decimal(10,0)") * whole(LINES)).cast(PLACE)


def line_at(place: Column) -> Column:
    return F.pmod(place, whole(LINES)).cast("int")


def doc_of(place: Column) -> Column:
    """doc_key of the document that a line's place is in."""
    return (place - line_at(place)).cast(PLACE)


def id_of(place: Column) -> Column:
    number = ((place - F.pmod(place, whole(TEXTS))) / whole(TEXTS)).cast("decimal(20,0)")
    return F.when(number >= F.lit(str(-(2**63))).cast("decimal(20,0)"), number).cast("long")


def split_lines(docs: DataFrame) -> DataFrame:
    """(at, line) of every line that holds a word, with its place."""
    text = text_of("text")
    lines = docs.select(doc_key(F.col("doc_id"), text).alias("doc"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    return lines.where(F.col("line").rlike(WORD)).select((F.col("doc") + F.col("line_no")).cast(PLACE).alias("at"), "line")


def cuts(length: Column, i: Column, parts: int) -> tuple[Column, Column]:
    """Where segment i of a line of this length begins, from 1, and its length: the longer segments come last."""
    longer = length % parts
    size = ((length - longer) / parts).cast("int")
    extra = F.greatest(i + longer - parts, F.lit(0))
    return size * i + extra + 1, size + F.when(i + longer >= parts, 1).otherwise(0)


def ways(max_edits: int) -> list[tuple[int, int, int]]:
    """(less, i, shift): in the first max_edits + 1 ways a line is entered, and asks for lines of its length; in the rest it only asks."""
    own = [(0, i, 0) for i in range(max_edits + 1)]
    asked = []
    for less in range(max_edits + 1):
        for i in range(max_edits + 1):
            after = max_edits - i
            asked += [(less, i, shift) for shift in range(max(-i, less - after), min(i, less + after) + 1)]
    return own + [w for w in asked if w not in own]


def structs(rows: list[tuple[int, ...]], names: str) -> Column:
    """These rows of numbers, as an array: ways are rows before they are keys, so one short expression makes all keys, which the JVM can compile."""
    return F.array(*[F.struct(*(F.lit(x).alias(c) for x, c in zip(r, names.split(), strict=True))) for r in rows])


def keyed(lines: DataFrame, max_edits: int) -> DataFrame:
    """(lid, less, i, shift, key) of each line in each way: the substring that begins `shift` after where segment i
    begins in a line that is `less` shorter, and is as long as that segment, under that line's length."""
    rows = lines.select("lid", "line", F.length("line").alias("n"), F.explode(structs(ways(max_edits), "less i shift")).alias("way"))
    rows = rows.select("lid", "line", "n", (F.col("n") - F.col("way.less")).alias("m"), "way.less", "way.i", "way.shift")
    start, size = cuts(F.col("m"), F.col("i"), max_edits + 1)
    rows = rows.select("*", (start + F.col("shift")).alias("from"), size.alias("size"))
    rows = rows.where((F.col("from") >= 1) & (F.col("from") + F.col("size") - 1 <= F.col("n")))
    small = [F.col(c).cast("tinyint").alias(c) for c in ("less", "i", "shift")]
    return rows.select("lid", *small, F.xxhash64("m", "i", F.substring("line", F.col("from"), F.col("size"))).alias("key"))


#: A way as one number, since it is sent with each key: max_edits is MOST at most, so `less` has LESS values and `shift` has SHIFTS.
MOST, LESS, SHIFTS = 2, 3, 5
#: Whether a way enters the line: `less` and `shift` are zero.
ENTERS = f"way % {LESS * SHIFTS} = {MOST}"


def packed(rows: DataFrame) -> DataFrame:
    """The rows with way instead of less, i and shift."""
    return rows.withColumn("way", F.expr(f"(i * {LESS} + less) * {SHIFTS} + shift + {MOST}").cast("tinyint")).drop("less", "i", "shift")


def unpacked(rows: DataFrame) -> DataFrame:
    """The rows with less, i and shift instead of way."""
    parts = {"less": f"way DIV {SHIFTS} % {LESS}", "i": f"way DIV {LESS * SHIFTS}", "shift": f"way % {SHIFTS} - {MOST}"}
    return rows.select("*", *(F.expr(e).cast("tinyint").alias(c) for c, e in parts.items())).drop("way")


def one_bit(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int"))


def parity(chars: Column) -> Column:
    """A bit for each of 64 classes of characters: whether the line holds an odd number of them."""
    return F.aggregate(chars, F.lit(0).cast("long"), lambda x, c: x.bitwiseXOR(one_bit(F.ascii(c) % 64)))


def pair_parity(chars: Column) -> Column:
    """The same for 64 classes of neighbouring characters, each with the one before it; an edit turns four at most."""
    start = F.struct(F.lit(0).alias("before"), F.lit(0).cast("long").alias("odd"))

    def step(x: Column, c: Column) -> Column:
        return F.struct(F.ascii(c).alias("before"), x["odd"].bitwiseXOR(one_bit((F.ascii(c) * 7 + x["before"] * 29) % 64)).alias("odd"))

    return F.aggregate(chars, start, step, lambda x: x["odd"])


def grams(chars: Column) -> Column:
    """The hashes of the distinct runs of GRAM characters."""
    starts = F.when(F.size(chars) >= GRAM, F.sequence(F.lit(0), F.size(chars) - GRAM)).otherwise(F.array().cast("array<int>"))
    return bound(chars, lambda c: F.array_distinct(F.transform(starts, lambda i: F.xxhash64(*(F.get(c, i + j) for j in range(GRAM))))))


def bound(x: Column, use) -> Column:
    """use(x), with x made once, as a lambda's argument, however often it is used."""
    return F.get(F.transform(F.array(x), use), 0)


def within_edits(a: Column, b: Column, max_edits: int) -> Column:
    """Whether two arrays of characters, whose lengths differ by max_edits at most, are within max_edits edits.

    Column j of the edit matrix is held as the differences of its rows j - max_edits to j + max_edits: bits of `up`
    where a row is one more than the row above, of `down` where it is one less. The distance is carried down
    the lowest diagonal of the band until that meets the last row, then along that row.
    """
    return bound(F.struct(a.alias("a"), b.alias("b")), lambda p: within_band(p["a"], p["b"], max_edits))


def within_band(a: Column, b: Column, max_edits: int) -> Column:
    k, m = max_edits, F.size(a)
    band = F.lit((1 << (2 * k + 1)) - 1).cast("long")

    def same(j: Column) -> Column:
        """The rows of the band whose character is b's in column j; the column's number above them."""
        c = F.get(b, j - 1)
        bits = [F.when(F.get(a, j - k - 1 + r) == c, 1 << r).otherwise(0) for r in range(2 * k + 1)]
        total = bits[0]
        for x in bits[1:]:
            total = total + x
        return j.cast("long") * (1 << (2 * k + 1)) + total

    def move(held: Column, x: Column) -> Column:
        eq, j = x.bitwiseAND(band), F.floor(x / (1 << (2 * k + 1)))
        up, down = held["up"], held["down"]
        equal = ((((eq.bitwiseAND(up)) + up).bitwiseXOR(up)).bitwiseOR(eq).bitwiseOR(down)).bitwiseAND(band)  # rows that equal their upper left neighbour

        def moved(level: Column, more: Column) -> Column:
            """more: the rows that are one more than their left neighbour."""
            less, below, row = level.bitwiseAND(up), F.shiftright(level, 1), one_bit(m - j + k)
            along = F.when(more.bitwiseAND(row) != 0, 1).when(less.bitwiseAND(row) != 0, -1).otherwise(0)
            diagonal = F.when(level.bitwiseAND(F.lit(1 << (2 * k))) == 0, 1).otherwise(0)
            return F.struct(
                less.bitwiseOR(band.bitwiseXOR(below.bitwiseOR(more))).alias("up"),
                below.bitwiseAND(more).alias("down"),
                (held["distance"] + F.when(j <= m - k, diagonal).otherwise(along)).cast("int").alias("distance"),
            )

        return bound(equal, lambda level: bound(down.bitwiseOR(band.bitwiseXOR(level.bitwiseOR(up))), lambda more: moved(level, more)))

    first = F.struct(
        F.lit(((1 << (k + 1)) - 1) << k).cast("long").alias("up"),
        F.lit(0).cast("long").alias("down"),
        F.least(F.lit(k), m).cast("int").alias("distance"),
    )
    steps = F.when(F.size(b) > 0, F.transform(F.sequence(F.lit(1), F.size(b)), same)).otherwise(F.array().cast("array<long>"))
    return F.aggregate(steps, first, move, lambda held: held["distance"]) <= max_edits


def distinct_lines(docs: DataFrame) -> DataFrame:
    """(h, lid, n, first) of every distinct line with a word: its MD5, a short hash, how often and where first it stands."""
    slim = split_lines(docs).select(F.unhex(F.md5("line")).alias("h"), F.xxhash64("line").alias("lid"), "at")
    return slim.groupBy("h", "lid").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))


def met(rows: DataFrame, own: Column) -> DataFrame:
    """The rows, once each, that stand under a key with a row of another line and one that is entered; n_own: lines entered there."""
    w = Window.partitionBy("key")
    seen = rows.withColumns({"lo": F.min("lid").over(w), "hi": F.max("lid").over(w), "entered": F.max(own).over(w)})
    return seen.where("lo < hi and entered").drop("lo", "hi", "entered").distinct().withColumn("n_own", F.sum(own.cast("int")).over(w))


def pairs_of(rows: DataFrame, own: Column, lines: DataFrame, max_edits: int) -> DataFrame:
    """(u, v) of lines that meet under keys with at most BUCKET entered ones and can be within max_edits by length and parity."""
    cold = rows.where(F.col("n_own") <= BUCKET).select("key", "lid", own.alias("own")).join(lines.select("lid", F.length("line").alias("n"), "odd", "odd_pairs"), "lid")
    x, y = (df.select("key", *(F.col(c).alias(f"{to}_{c}") for c in ("lid", "n", "odd", "odd_pairs"))) for to, df in (("x", cold.where("own")), ("y", cold)))
    close = F.abs(F.col("x_n") - F.col("y_n")) <= max_edits
    for c, most in (("odd", 2 * max_edits), ("odd_pairs", 4 * max_edits)):
        close &= F.bit_count(F.col(f"x_{c}").bitwiseXOR(F.col(f"y_{c}"))) <= most
    met = x.join(y, (x["key"] == y["key"]) & (F.col("x_lid") != F.col("y_lid")) & close)
    return met.select(F.least("x_lid", "y_lid").alias("u"), F.greatest("x_lid", "y_lid").alias("v"))


def lines_of(docs: DataFrame, known: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h, lid, first, line) of the distinct lines whose lid is wanted, read where they first stand."""
    places = known.join(wanted, "lid", "left_semi")
    at = F.struct("h", "lid", "first", line_at(F.col("first")).alias("line_no"))
    by_doc = places.groupBy(doc_of(F.col("first")).alias("number")).agg(F.collect_list(at).alias("firsts"))  # at most a document's own lines
    text = text_of("text")
    held = docs.select(doc_key(F.col("doc_id"), text).alias("doc"), text.alias("text")).join(by_doc, F.col("doc") == F.col("number"))
    held = held.select(F.split("text", "\n").alias("lines"), "firsts")
    found = held.select(F.explode(F.transform("firsts", lambda f: F.struct(f["h"].alias("h"), f["lid"].alias("lid"), f["first"].alias("first"), F.get("lines", f["line_no"]).alias("line")))).alias("f"))
    return found.select("f.*").where(F.unhex(F.md5("line")) == F.col("h")).dropDuplicates(["h"])


def parted(hot: DataFrame, lines: DataFrame, max_edits: int) -> DataFrame:
    """The rows, under a key for each gram of theirs that comes first, by the leaders of the key where they met.

    Of each line at most GRAM * max_edits distinct grams are not in a line near to it, and one at least is; so the first
    gram that both have is among the first GRAM * max_edits + 1 of both, in any order; here that of their hashes, after those that no leader has.
    """
    own = hot.where((F.col("less") == 0) & (F.col("shift") == 0))
    lead = own.groupBy("key").agg(*(F.min(F.struct(F.xxhash64("lid", F.lit(x)), "lid"))["lid"].alias(f"lead{x}") for x in range(LEADERS)))
    has = lines.join(hot.select("lid").distinct(), "lid", "left_semi").select("lid", grams(F.split("line", "")).alias("grams"))
    known = lead.select("key", F.explode(F.array_distinct(F.array(*[c for c in lead.columns if c != "key"]))).alias("lid")).join(has, "lid")
    known = known.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("grams"))).alias("known"))  # of LEADERS lines
    df = hot.select("key", "lid", "less", "i", "shift").join(known, "key").join(has, "lid")
    order = F.concat(F.array_sort(F.array_except("grams", "known")), F.array_sort(F.array_intersect("grams", "known")))
    df = df.select("key", "lid", "less", "i", "shift", F.explode(F.slice(order, 1, GRAM * max_edits + 1)).alias("gram"))
    return df.select("lid", "less", "i", "shift", F.xxhash64("key", "gram").alias("key"))


# A stretch that holds edits begins at a (b) of the shorter line, from 0, and is a_len (b_len) long there. What follows
# the first stretch has moved by s1 in the longer line, what follows the second by s2. Of `kind` 2 each of the stretches
# holds one edit at most; of kind 1 there is only the first, which holds two.
STATE = ["lid", "m", "kind", "s1", "s2", "a", "a_len", "b", "b_len"]


def first_stretches(hot: DataFrame, lines: DataFrame, max_edits: int) -> DataFrame:
    """The state of lines that met under a segment."""
    rows = hot.join(lines.select("lid", F.length("line").alias("n")), "lid")
    rows = rows.withColumn("m", F.col("n") - F.col("less"))
    start, size = cuts(F.col("m"), F.col("i"), max_edits + 1)
    start, end, m, i, less = start - 1, start - 1 + size, F.col("m"), F.col("i"), F.col("less")
    if max_edits == 1:
        a, a_len = F.when(i == 0, end).otherwise(F.lit(0)), F.when(i == 0, m - end).otherwise(start)
        kind, s1, b, b_len = F.lit(2), less, m, F.lit(0)
    else:
        a = F.when(i == 0, end).otherwise(F.lit(0))
        a_len = F.when(i == 0, m - end).otherwise(start)
        kind = F.when(i == 1, 2).otherwise(1)
        s1 = F.when(i == 1, F.col("shift")).otherwise(less)
        b, b_len = F.when(i == 1, end).otherwise(m), F.when(i == 1, m - end).otherwise(0)
    named = {"kind": kind, "s1": s1, "s2": less, "a": a, "a_len": a_len, "b": b, "b_len": b_len}
    return rows.select("lid", "m", *(x.cast("int").alias(c) for c, x in named.items())).distinct()


def outside(line: Column) -> Column:
    """The hash of all that lies outside a row's stretches, under the shorter line's length and their places."""
    m, a, b = F.col("m"), F.col("a"), F.col("b")
    end_a, end_b = a + F.col("a_len"), b + F.col("b_len")
    parts = [F.substring(line, F.lit(1), a), F.substring(line, end_a + F.col("s1") + 1, b - end_a), F.substring(line, end_b + F.col("s2") + 1, m - end_b)]
    return F.xxhash64("m", "kind", "a", "a_len", "b", "b_len", *parts)


def fits() -> Column:
    return (F.col("a_len") + F.col("s1") >= 0) & (F.col("b_len") + F.col("s2") - F.col("s1") >= 0)


def is_own() -> Column:
    return (F.col("s1") == 0) & (F.col("s2") == 0)


def part(start: Column, length: Column, i: Column) -> tuple[Column, Column]:
    low, high = ((length * x - (length * x) % PARTS) / PARTS for x in (i, i + 1))
    return (start + low).cast("int"), (high - low).cast("int")


def cut_stretches(states: DataFrame, lines: DataFrame) -> DataFrame:
    """The states with the parts of the stretches that may hold the edits, and their keys."""
    both = [(x, y, 0) for x in range(PARTS) for y in range(PARTS)]
    one = [(x, x, 0) for x in range(PARTS)] + [(x, y, d) for x in range(PARTS) for y in range(x + 1, PARTS) for d in (-1, 0, 1)]
    two = F.col("kind") == 2
    df = states.join(lines.select("lid", "line"), "lid")
    df = df.select(*STATE, "line", F.explode(F.when(two, structs(both, "x y d")).otherwise(structs(one, "x y d"))).alias("w")).select(*STATE, "line", "w.x", "w.y", "w.d")
    stays = F.col("x") == F.col("y")  # of kind 1: both edits in one part
    first, second = part(F.col("a"), F.col("a_len"), F.col("x")), part(F.col("a"), F.col("a_len"), F.col("y"))
    other = part(F.col("b"), F.col("b_len"), F.col("y"))
    made = {
        "kind": F.when(two | ~stays, 2).otherwise(1),
        "s1": F.when(two, F.col("s1")).when(stays, F.col("s2")).otherwise(F.col("d")),
        "a": first[0],
        "a_len": first[1],
        "b": F.when(two, other[0]).when(stays, F.col("m")).otherwise(second[0]),
        "b_len": F.when(two, other[1]).when(stays, F.lit(0)).otherwise(second[1]),
    }
    used = (first[1] > 0) | ((F.col("a_len") == 0) & (F.col("x") == 0))  # a stretch without characters is one place
    also = F.when(two, (other[1] > 0) | ((F.col("b_len") == 0) & (F.col("y") == 0))).when(stays, True).otherwise(second[1] > 0)
    df = df.where(used & also).select("lid", "m", "s2", "line", *(x.cast("int").alias(c) for c, x in made.items()))
    possible = (F.col("kind") == 1) | ((F.abs("s1") <= 1) & (F.abs(F.col("s2") - F.col("s1")) <= 1))
    return df.where(possible & fits()).select(*STATE, outside(F.col("line")).alias("key"))


CHAR, BEFORE, AFTER = range(3)


def single_edits(rows: DataFrame) -> DataFrame:
    """States whose stretches are a character at most, as the single places of their edits: a character, or a gap between two.

    A line that lost or changed a character asks at that character; one that gained one asks at a gap.
    """
    double = [(CHAR, -1), (BEFORE, -1), (AFTER, -1), (BEFORE, AFTER)]
    singles = [(x, y) for x in range(3) for y in range(3)]
    two = F.col("kind") == 2
    df = rows.select(*STATE, F.explode(F.when(two, structs(singles, "x y")).otherwise(structs(double, "x y"))).alias("w")).select(*STATE, "w.x", "w.y")

    def fits(unit: Column, length: Column, moved: Column) -> Column:
        asks = F.when(moved == 1, unit != CHAR).when(moved == -1, unit == CHAR).otherwise(F.when(length == 1, unit == CHAR).otherwise(unit == BEFORE))
        return ((unit == BEFORE) | (length == 1)) & (is_own() | asks)

    a_len, s1, s2 = F.col("a_len"), F.col("s1"), F.col("s2")
    one_place = F.col("y") < 0
    asks = F.when(one_place, F.when(F.col("x") == CHAR, s2 < 2).otherwise((s2 == 2) | (a_len == 0))).otherwise(s2 == 2)
    has = F.when((F.col("x") == BEFORE) & one_place, True).otherwise(a_len == 1)
    good = F.when(two, fits(F.col("x"), a_len, s1) & fits(F.col("y"), F.col("b_len"), s2 - s1)).otherwise(has & (is_own() | asks))

    def unit(start: Column, length: Column, x: Column) -> tuple[Column, Column]:
        return start + F.when(x == AFTER, length).otherwise(0), F.when(x == CHAR, 1).otherwise(0)

    first, other, gap = unit(F.col("a"), a_len, F.col("x")), unit(F.col("b"), F.col("b_len"), F.col("y")), unit(F.col("a"), a_len, F.lit(AFTER))
    pair = ~two & ~one_place  # two gaps around a character
    made = {
        "kind": F.when(two | pair, 2).otherwise(1),
        "s1": F.when(pair & ~is_own(), 1).otherwise(s1),
        "a": first[0],
        "a_len": first[1],
        "b": F.when(two, other[0]).when(pair, gap[0]).otherwise(F.col("m")),
        "b_len": F.when(two, other[1]).otherwise(0),
    }
    return df.where(good).select("lid", "m", "s2", *(x.cast("int").alias(c) for c, x in made.items())).select(*STATE).distinct()


def earliest_near(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """(h, near_first) of lines that stand under a key with an earlier one: where the earliest stands. All under a key are near."""
    df = single_edits(rows).where(fits()).join(lines.select("lid", "h", "first", "line"), "lid")
    df = df.select("lid", "h", "first", outside(F.col("line")).alias("key"), is_own().alias("own")).distinct()
    least = df.groupBy("key").agg(F.min(F.when(F.col("own"), F.col("first"))).alias("entered"), F.min("first").alias("any"))
    df = df.join(least, "key").withColumn("near_first", F.when(F.col("own"), F.col("any")).otherwise(F.col("entered")))
    return df.where("near_first < first").select("h", "near_first")


def near_lines(docs: DataFrame, known: DataFrame, max_edits: int, least_chars: int) -> DataFrame:
    """(h, near_first) of the distinct lines of least_chars or more that are within max_edits of an earlier one: where the earliest such stands."""
    if max_edits not in (1, 2):
        raise ValueError("max_edits is 1 or 2")
    if least_chars < GRAM * (max_edits + 1):
        raise ValueError("in shorter lines the edits can leave no gram")
    spark = docs.sparkSession
    total = known.agg(F.sum("n")).first()[0] or 0
    frequent = F.broadcast(known.where(F.col("n") * FREQUENT > total).select(F.col("lid").alias("hot"), "first"))  # fewer than FREQUENT rows
    lines = split_lines(docs).where(F.length("line") >= least_chars).select(F.xxhash64("line").alias("lid"), "at", "line")
    lines = lines.join(frequent, (F.col("lid") == F.col("hot")) & (F.col("at") != F.col("first")), "left_anti")
    own = (F.col("less") == 0) & (F.col("shift") == 0)
    rows = stash(unpacked(met(packed(keyed(lines, max_edits)), F.expr(ENTERS))), "lines-met")
    freed(spark)
    chars = F.split("line", "")
    lines = stash(lines_of(docs, known, rows.select("lid").distinct()).withColumns({"odd": parity(chars), "odd_pairs": pair_parity(chars)}), "lines-held")
    freed(spark)
    hot = rows.where(F.col("n_own") > BUCKET)
    pairs, found = [pairs_of(rows, own, lines, max_edits)], []
    rows = stash(met(parted(hot, lines, max_edits), own), "lines-met")
    pairs.append(pairs_of(rows, own, lines, max_edits))
    states = first_stretches(rows.where(F.col("n_own") > BUCKET), lines, max_edits)
    n = None
    while True:
        states = stash(states, "line-stretches", n)
        n = states.count()
        if not n:
            break
        small = (F.col("a_len") <= 1) & (F.col("b_len") <= 1)
        found.append(earliest_near(states.where(small), lines))
        rows = stash(met(cut_stretches(states.where(~small), lines), is_own()), "lines-met", n)
        pairs.append(pairs_of(rows, is_own(), lines, max_edits))
        states = rows.where(F.col("n_own") > BUCKET).select(*STATE)
    found.append(verified(reduce(DataFrame.unionByName, pairs).distinct(), lines, max_edits))
    return reduce(DataFrame.unionByName, found).groupBy("h").agg(F.min("near_first").alias("near_first"))


def common(a: Column, b: Column) -> Column:
    """How many characters two texts have in common at their beginning, in steps of halving length."""
    least = F.least(F.length(a), F.length(b))

    def longer(n: Column, step: Column) -> Column:
        return F.when((least >= step) & (least - step >= n) & (F.substring(a, n + 1, step) == F.substring(b, n + 1, step)), n + step).otherwise(n)

    return F.aggregate(F.array(*[F.lit(1 << k) for k in range(30, -1, -1)]), F.lit(0), longer)


def without_ends(a: Column, b: Column, use) -> Column:
    """use(a, b), both without the beginning and the end that they have in common, and backwards."""

    def cut(p: Column, n: Column) -> list[Column]:
        return [F.reverse(F.substring(p[c], n + 1, F.length(p[c]))).alias(c) for c in "ab"]

    def begun(p: Column) -> Column:
        return bound(common(p["a"], p["b"]), lambda n: bound(F.struct(*cut(p, n)), ended))

    def ended(p: Column) -> Column:
        return bound(common(p["a"], p["b"]), lambda n: use(*(F.substring(p[c], n + 1, F.length(p[c])) for c in "ab")))

    return bound(F.struct(a.alias("a"), b.alias("b")), begun)


def verified(pairs: DataFrame, lines: DataFrame, max_edits: int) -> DataFrame:
    """(h, near_first) of the later line of each pair (u, v) that is within max_edits."""
    left, right = (lines.select(*(F.col(c).alias(f"{x}_{c}") for c in ("h", "lid", "first", "line"))) for x in "uv")
    both = stash(pairs.join(left, F.col("u") == F.col("u_lid")).join(right, F.col("v") == F.col("v_lid")), "line-pairs")
    near = both.where(without_ends(F.col("u_line"), F.col("v_line"), lambda a, b: within_edits(F.split(a, ""), F.split(b, ""), max_edits)))
    return near.select(F.when(F.col("u_first") < F.col("v_first"), F.col("v_h")).otherwise(F.col("u_h")).alias("h"), F.least("u_first", "v_first").alias("near_first"))


def judged(docs: DataFrame, max_edits: int = 2, least_chars: int = 20) -> DataFrame:
    """(h, n, first, near_first) of every distinct line with a word: near_first is where the earliest line stands that
    is within max_edits of it and earlier, null if there is none."""
    known = stash(distinct_lines(docs), "lines")
    return known.join(near_lines(docs, known, max_edits, least_chars), "h", "left").select("h", "n", "first", "near_first")


def report(docs: DataFrame, max_edits: int = 2, least_chars: int = 20) -> DataFrame:
    """One row for each doc_id: n_lines with a word, those dropped as equal or near to earlier ones, those kept, and
    near_doc, the least id of a document that holds an earlier line near to a distinct line that first stands here.

    Rows that repeat an id are one document for the counts; rows that repeat id and text count once. A null text has no
    lines; rows without an id come first, and near_doc is null for lines near to theirs; further columns are not read;
    no rows give no rows.
    """
    lines = judged(docs, max_edits, least_chars)
    per_doc = lines.groupBy(doc_of(F.col("first")).alias("number")).agg(F.count(F.lit(1)).alias("firsts"), F.count("near_first").alias("near"), F.min("near_first").alias("near_first"))
    text = text_of("text")
    held = F.size(F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))).cast("long")
    counts = docs.groupBy("doc_id", doc_key(F.col("doc_id"), text).alias("doc")).agg(F.max(held).alias("n_lines"))
    df = counts.join(per_doc, F.col("doc") == F.col("number"), "left").groupBy("doc_id")
    df = df.agg(F.sum("n_lines").alias("n_lines"), *(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("firsts", "near")), F.min("near_first").alias("near_first"))
    return df.select("doc_id", "n_lines", (F.col("n_lines") - F.col("firsts")).alias("n_equal"), F.col("near").alias("n_near"), (F.col("firsts") - F.col("near")).alias("n_kept"), id_of(F.col("near_first")).alias("near_doc"))


def kept_of(lines: Column, kept: Column) -> Column:
    """The lines that hold no word or whose number is in the array kept. In time linear in the lines but for a sort.

    Every number stands in `order` once, doubled, and once more with one added if it is kept; so what follows tells.
    """
    numbers = F.when(F.size(lines) > 0, F.sequence(F.lit(0), F.size(lines) - 1)).otherwise(F.array().cast("array<int>"))
    order = F.array_sort(F.concat(F.transform(numbers, lambda i: i * 2), F.transform(kept, lambda i: i * 2 + 1)))
    marks = bound(order, lambda o: F.filter(F.transform(o, lambda x, j: F.when(x % 2 == 0, F.coalesce(F.get(o, j + 1) == x + 1, F.lit(False)))), lambda x: x.isNotNull()))
    return bound(marks, lambda stays: F.filter(lines, lambda x, i: ~x.rlike(WORD) | F.coalesce(F.get(stays, i), F.lit(False))))


def deduplicated(docs: DataFrame, max_edits: int = 2, least_chars: int = 20) -> DataFrame:
    """docs, all rows and columns, without the lines that are dropped; n_chars, if there, counts anew.

    A null text stays null. Rows that repeat id and text keep the same lines; columns of any name are left as they are.
    """
    lines = judged(docs, max_edits, least_chars).where("near_first is null")
    kept = lines.groupBy(doc_of(F.col("first")).alias("number")).agg(F.collect_list(line_at(F.col("first"))).alias("numbers")).select(F.struct("number", "numbers").alias("kept"))
    held = docs.select(F.struct(*docs.columns).alias("row"))
    df = held.join(kept, doc_key(F.col("row.doc_id"), text_of("row.text")) == F.col("kept.number"), "left")
    text = F.array_join(kept_of(F.split("row.text", "\n"), F.coalesce("kept.numbers", F.array().cast("array<int>"))), "\n")
    df = df.select("row", F.when(F.col("row.text").isNotNull(), text).alias("text"))
    made = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)
    return df.select(*(made[c].alias(c) if c in made else F.col("row")[c].alias(c) for c in docs.columns))
