"""Tokens, phrases and their overlaps."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitrine.functions.clean import collapse

# fixed values: English words that carry no search meaning
STOP_WORDS = sorted("a an and are as at be by for from has he in is it its of on or that the this to was were will with".split())

# fixed values: title tokens that make no query: units, packaging and function words
QUIET_WORDS = (
    "a an and by ct count fl for from in inch inches jar jars kit lb lbs ml new of on or ounce ounces oz pack pc pcs piece pieces set size sizes the to unit units with"
).split()


#: Letters that full case folding writes other than lower case does, found from Python's Unicode tables: sharp s, ligatures, final sigma.
FOLDS = {chr(i): chr(i).casefold() for i in range(0x80, 0x1E943) if chr(i).casefold() != chr(i).lower()}


def casefold(c: Column) -> Column:
    """Lower case in which sharp s, ligatures and the like are written out."""
    table = F.create_map(*[F.lit(x) for pair in FOLDS.items() for x in pair])
    written = F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(F.try_element_at(table, x), F.lower(x))), "")
    return F.when(c.rlike("[" + "".join(FOLDS) + "]"), written).otherwise(F.lower(c))


def tokens(c: Column) -> Column:
    """Case-folded runs of ASCII letters and digits; null gives the empty array."""
    return F.coalesce(F.regexp_extract_all(casefold(c), F.lit("[0-9a-z]+"), F.lit(0)), F.array().cast("array<string>"))


def phrase(c: Column) -> Column:
    return collapse(casefold(c))


def stem(token: Column) -> Column:
    """The three-rule s-stemmer (Harman 1991): -ies to -y, -es to -e, -s dropped, with its exceptions."""
    return (
        F.when(token.rlike("ies$") & ~token.rlike("(eies|aies)$"), F.regexp_replace(token, "ies$", "y"))
        .when(token.rlike("es$") & ~token.rlike("(aes|ees|oes)$"), F.regexp_replace(token, "es$", "e"))
        .when(token.rlike("s$") & ~token.rlike("(us|ss)$"), F.regexp_replace(token, "s$", ""))
        .otherwise(token)
    )


def terms(c: Column) -> Column:
    """Stemmed tokens without stop words, in order."""
    return F.transform(F.filter(tokens(c), lambda t: ~t.isin(STOP_WORDS)), stem)


def overlap_count(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(F.array_distinct(a), F.array_distinct(b)))


def overlap_ratio(query: Column, other: Column) -> Column:
    """Share of the distinct query tokens that occur in the other; 0 without query tokens."""
    return F.coalesce(overlap_count(query, other) / F.nullif(F.size(F.array_distinct(query)), F.lit(0)), F.lit(0.0))


def informative(title: Column) -> Column:
    """Distinct title tokens of two letters and more without digits and quiet words."""
    return F.array_distinct(F.filter(tokens(title), lambda t: (F.length(t) >= 2) & ~t.rlike("[0-9]") & ~t.isin(QUIET_WORDS)))


def title_query(title: Column) -> Column:
    """The last two informative tokens; null with fewer than two."""
    t = informative(title)
    return F.when(F.size(t) >= 2, F.concat_ws(" ", F.slice(t, -2, 2)))


def attribute_query(title: Column, brand: Column) -> Column:
    """The brand's first token and the last informative title token outside the brand; null without either or if it is the title query."""
    b = tokens(brand)
    rest = F.array_except(informative(title), b)
    q = F.concat_ws(" ", F.get(b, F.lit(0)), F.try_element_at(rest, F.lit(-1)))
    return F.when((F.size(b) > 0) & (F.size(rest) > 0) & ~q.eqNullSafe(title_query(title)), q)


def stable_id(*parts: Column) -> Column:
    """The first 16 hex digits of SHA-256 over the parts joined by line breaks."""
    return F.substring(F.sha2(F.concat_ws("\n", *[p.cast("string") for p in parts]), 256), 1, 16)


@dataclass
class WebQuery:
    """A parsed web-style query: any of ``groups`` must match with all its terms and phrases, none of ``without`` may occur."""

    groups: list[list[list[str]]] = field(default_factory=list)
    without: list[list[str]] = field(default_factory=list)


def parse_web_query(text: str | None) -> WebQuery:
    """Words are joined by AND, ``or`` starts an alternative, ``"..."`` is a phrase, a leading ``-`` excludes. Anything else is
    punctuation, so no input is an error."""
    import re

    out, group = WebQuery(), []
    for minus, quoted, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', text or ""):
        if not quoted and word.lower() == "or":
            if group:
                out.groups.append(group)
            group = []
            continue
        found = [w for w in re.findall(r"[0-9a-z]+", (quoted or word).lower()) if w not in STOP_WORDS]
        if not found:
            continue
        if minus:
            out.without.append(found)
        elif quoted:
            group.append(found)
        else:
            group += [[w] for w in found]
    if group:
        out.groups.append(group)
    return out
