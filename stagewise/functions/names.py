"""The employer that a message names, from several witnesses in the order in which they are trusted: Column functions.

1. a name in the text that the sender's domain spells, 2. the subject's phrase, 3. the sender's display name, 4. the body's phrase,
5. the domain itself. The first good one counts; a later one that is the same name with up to MORE words at its end takes its place.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import bound, col, holds, meets, needed

NAME = r"[A-Z][A-Za-z&.-]*(?: (?:[A-Z][A-Za-z&.-]*|&)){0,4}"
#: Words at the end of a company's name that its domain need not spell.
LEGAL = ("berhad", "bhd", "bhd.", "sdn", "sdn.", "ltd", "ltd.", "inc", "inc.", "plc", "group", "holdings")
#: Domains of platforms, which say nothing of the employer, and what is no employer.
PLATFORM_HOSTS = r"^(?:ats|board|assess|news)$"
NOT_NAMES = r"(?i)^(?:the|your|application|update|interview|offer|next step|role|team|hr|careers|unknown)\b"
#: Two capitalised words before an address are a person, unless it is an office's.
PERSON, OFFICE = r"^[A-Z][a-z]+ [A-Z][a-z]+ <[a-z]+@", r"<(?:hr|jobs|careers|info)@"
SUBJECT_PHRASES = (rf"\bapplying to ({NAME})", rf"\bapplication to ({NAME})", rf"\b(?:with|at) ({NAME})$", rf"^({NAME}):")
BODY_PHRASES = (rf"\b(?:at|from|reached) ({NAME})",)
WITNESSES = ("domain and text", "subject", "display name", "body", "domain")
MORE = 3


def domain_label(sender: str | Column) -> Column:
    """The name part of the sender's domain, in lower case; empty for platforms."""
    label = F.lower(F.regexp_extract(F.coalesce(col(sender), F.lit("")), r"@(?:[\w-]+\.)*([\w-]+)\.[A-Za-z]+", 1))
    return bound(label, lambda x: F.when(x.rlike(PLATFORM_HOSTS), "").otherwise(x))


def spells(label: Column, name: Column) -> Column:
    """Whether a domain's label is made of a name's words in their order: each word whole or by its first letter; legal forms may be missing.

    Places in the label that can be reached are carried from word to word, so all ways to cut the label are tried at once.
    """
    words = F.filter(F.split(F.regexp_replace(F.lower(name), "[^a-z0-9. ]", ""), " "), lambda w: w != "")

    def further(places: Column, word: Column) -> Column:
        def from_place(p: Column) -> Column:
            whole = F.when(F.substring(label, p + 1, F.length(word)) == word, p + F.length(word))
            initial = F.when(F.substring(label, p + 1, F.lit(1)) == F.substring(word, 1, 1), p + 1)
            return F.filter(F.array(whole, initial, F.when(word.isin(*LEGAL), p)), lambda x: x.isNotNull())

        return F.array_distinct(F.flatten(F.transform(places, from_place)))

    reached = F.aggregate(words, F.array(F.lit(0)), further)
    return (label != "") & (F.length(label) >= 3) & F.array_contains(reached, F.length(label))


def may_spell(label: Column, name: Column) -> Column:
    """What holds whenever a label is spelt by a name that begins with a letter: both begin alike, or the name with a legal form."""
    return (F.lower(F.substring(name, 1, 1)) == F.substring(label, 1, 1)) | F.lower(name).rlike(rf"^(?:{'|'.join(x for x in LEGAL if '.' not in x)})")


def first_phrase(text: Column, patterns: tuple[str, ...]) -> Column:
    """What the first of the patterns that is met takes out of the text; empty if none is met."""

    def taken(x: Column, p: str) -> Column:
        return F.when(holds(x, needed(p)), bound(F.regexp_extract(x, p, 1), lambda y: F.when(y != "", y)))

    return bound(text, lambda x: F.coalesce(*(taken(x, p) for p in patterns), F.lit("")))


def cleaned(name: Column) -> Column:
    """A name without marks at its end; empty if it is none."""
    bare = F.regexp_replace(F.trim(name), r"[ ,;:!?-]+$", "")
    return F.when(name == "", "").otherwise(bound(bare, lambda x: F.when((F.length(x) < 3) | x.rlike(NOT_NAMES), "").otherwise(x)))


def longest_spelt(label: Column, text: Column) -> Column:
    """The longest name in a text that a domain's label spells; null if none does. Texts are searched only where there is a label."""
    spelt = F.filter(F.regexp_extract_all(text, F.lit(f"({NAME})"), F.lit(1)), lambda n: may_spell(label, n) & spells(label, n))
    return F.when(F.length(label) >= 3, F.array_max(F.transform(spelt, lambda n: F.struct(F.length(n).alias("length"), n.alias("name"))))["name"])


def witnesses(sender: str, subject: str, body: str) -> Column:
    """What each witness says, in their order; empty where one says nothing."""
    text = F.concat_ws("\n", subject, body)
    display = F.when(meets(col(sender), PERSON) & ~meets(col(sender), OFFICE), "").otherwise(F.regexp_extract(col(sender), r"^(.+) <", 1))

    def said(label: Column) -> Column:
        each = (longest_spelt(label, text), first_phrase(F.coalesce(col(subject), F.lit("")), SUBJECT_PHRASES), display, first_phrase(F.coalesce(col(body), F.lit("")), BODY_PHRASES), F.initcap(label))
        return F.array(*(bound(F.coalesce(x, F.lit("")), cleaned) for x in each))

    return bound(domain_label(sender), said)


def resolved(said: Column) -> Column:
    """A struct of the employer and the witness that decided; both null if none says anything."""
    heard = F.filter(F.arrays_zip(said.alias("name"), F.array(*(F.lit(w) for w in WITNESSES)).alias("witness")), lambda x: x["name"] != "")

    def upgraded(now: Column, x: Column) -> Column:
        longer = F.lower(x["name"]).startswith(F.concat(F.lower(now["name"]), F.lit(" "))) & (F.size(F.split(x["name"], " ")) - F.size(F.split(now["name"], " ")) <= MORE)
        return F.when(longer, x).otherwise(now)

    return F.transform(F.array(heard), lambda h: F.when(F.size(h) > 0, F.aggregate(F.slice(h, 2, len(WITNESSES)), F.get(h, F.lit(0)), upgraded)))[0]


def normal(name: str | Column) -> Column:
    """A name for a lenient comparison: lower case, without legal forms and marks."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(col(name), F.lit(""))), "[^a-z0-9 ]", ""), " ")
    return F.array_join(F.filter(words, lambda w: ~w.isin("", *(x for x in LEGAL if "." not in x))), " ")
