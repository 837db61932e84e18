"""Text rules as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .words import CLASS_NAMES, OTHER_CLASS, VENUE_KEYWORDS


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def _squeeze(c: Column) -> Column:
    spaced = F.regexp_replace(c, r"[^\p{L}\p{N}_\s]", " ")
    return F.trim(F.regexp_replace(spaced, r"\s+", " "))


def normalise_a(c) -> Column:
    """Lower case, digits removed, punctuation to spaces, spaces squeezed; null to ''."""
    lowered = F.lower(F.coalesce(_col(c), F.lit("")))
    return _squeeze(F.regexp_replace(lowered, r"\p{Nd}+", ""))


def plain_b(c) -> Column:
    """As :func:`normalise_a`, but digits stay."""
    return _squeeze(F.lower(F.coalesce(_col(c), F.lit(""))))


def word_array(normalised: Column, stop: Sequence[str] = (), min_len: int = 1) -> Column:
    """Words of a normalised text in order, stop words and too short words left out."""
    def wanted(w):
        keep = F.length(w) >= max(min_len, 1)
        return keep & ~w.isin(list(stop)) if len(stop) else keep

    return F.filter(F.split(normalised, " "), wanted)


def normalise_b(c, stop: Sequence[str] = (), stem: bool = True) -> Column:
    """Digits kept, stop words out, optionally stemmed by the light rules, re-joined."""
    words = word_array(plain_b(c), stop)
    return F.array_join(F.transform(words, light_stem) if stem else words, " ")


def _shape(word: Column) -> Column:
    """Vowel/consonant pattern: 'v' and 'c' per letter, y counted by its left neighbour."""
    marked = F.regexp_replace(word, "[aeiou]", "V")
    marked = F.regexp_replace(marked, "(^|V)y", "$1C")
    marked = F.regexp_replace(marked, "y", "V")
    return F.regexp_replace(marked, "[^V]", "C")


def _without(word: Column, n: int) -> Column:
    return word.substr(F.lit(1), F.length(word) - n)


def light_stem(word: Column) -> Column:
    """Porter steps 1a to 1c (plurals, -ed, -ing, final y) as expressions.

    Steps 2 to 5 of the algorithm are not built: apply a supplied
    ``(form, stem)`` table with ``operators.tokens.apply_forms`` when the full
    stemmer is needed.
    """
    plural = (
        F.when(word.endswith("sses") | word.endswith("ies"), _without(word, 2))
        .when(word.endswith("ss"), word)
        .when(word.endswith("s"), _without(word, 1))
        .otherwise(word)
    )
    return _final_y(_past(plural))


def _past(word: Column) -> Column:
    cut = F.when(word.endswith("ed"), _without(word, 2)).otherwise(_without(word, 3))
    restored = (
        F.when(cut.rlike("(at|bl|iz)$"), F.concat(cut, F.lit("e")))
        .when(cut.rlike("(bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx)$"), _without(cut, 1))
        .when(_shape(cut).rlike("^C+VC$") & ~cut.rlike("[wxy]$"), F.concat(cut, F.lit("e")))
        .otherwise(cut)
    )
    return (
        F.when(
            word.endswith("eed"),
            F.when(_shape(_without(word, 3)).rlike("^C*V+C"), _without(word, 1)).otherwise(word),
        )
        .when((word.endswith("ed") | word.endswith("ing")) & _shape(cut).contains("V"), restored)
        .otherwise(word)
    )


def _final_y(word: Column) -> Column:
    body = _without(word, 1)
    return F.when(
        word.endswith("y") & _shape(body).contains("V"), F.concat(body, F.lit("i"))
    ).otherwise(word)


# What a list cell's automaton can be doing, and what it reads at a time: an escape, a run of plain characters or of space, a sign.
OPENING, WANTED, SINGLE, DOUBLE, DONE, CLOSED, BROKEN = range(7)
LEXEME = r"""(?s)\\.|[^'"\\,\[\]\s]+|\s+|."""
BARE_ITEM = r"^([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|True|False|None)$"


def parse_list(c) -> Column:
    r"""Items of a ``['a', "b", 3]`` cell as strings; what is no such list is an empty one.

    An automaton is folded over the cell.  Items are quoted either way, or bare
    numbers and True, False, None, which keep their spelling; they are parted
    by single commas, one may follow the last.  In quotes ``\'``, ``\"``,
    ``\\``, ``\n`` and ``\t`` are one character, any other backslash stays.
    Nested lists, bare words, adjacent or unclosed quotes and text around the
    brackets break the cell.  Null is an empty list.  Spark copies the state of
    a fold at every step, so that time grows with the square of the items: some
    thousands are quick, 20,000 take half a minute.
    """
    cell = F.trim(F.coalesce(_col(c), F.lit("")))

    def step(a: Column, x: Column) -> Column:
        state = a["state"]
        inside = state.isin(SINGLE, DOUBLE)
        ends = ((state == SINGLE) & (x == "'")) | ((state == DOUBLE) & (x == '"'))
        bare = (state == WANTED) & x.rlike(BARE_ITEM)
        space = F.trim(x, F.lit(" \t\n\r\f\v")) == ""
        follows = (
            F.when(inside, F.when(ends, DONE).otherwise(state))
            .when(state == WANTED, F.when(x == "'", SINGLE).when(x == '"', DOUBLE).when(x == "]", CLOSED).when(bare, DONE)
                  .when(space, WANTED).otherwise(BROKEN))
            .when(state == DONE, F.when(x == ",", WANTED).when(x == "]", CLOSED).when(space, DONE).otherwise(BROKEN))
            .when((state == OPENING) & (x == "["), WANTED)
            .otherwise(BROKEN))
        second = x.substr(2, 1)
        plain = F.when(~x.startswith("\\"), x).when(second.isin("'", '"', "\\"), second).when(second == "n", "\n").when(second == "t", "\t").otherwise(x)
        item = F.when(inside & ~ends, F.concat(a["item"], plain)).otherwise(F.lit(""))
        items = F.when(ends, F.array_append(a["items"], a["item"])).when(bare, F.array_append(a["items"], x)).otherwise(a["items"])
        return F.struct(follows.alias("state"), item.alias("item"), items.alias("items"))

    none = F.array().cast("array<string>")
    start = F.struct(F.lit(OPENING).alias("state"), F.lit("").alias("item"), none.alias("items"))
    read = F.regexp_extract_all(cell, F.lit(LEXEME), F.lit(0))
    return F.aggregate(read, start, step, lambda a: F.when(a["state"] == CLOSED, a["items"]).otherwise(none))


def combined_text(title, abstract, title_weight: int = 1) -> Column:
    """Title (repeated ``title_weight`` times) and abstract as one text."""
    head = F.coalesce(_col(title), F.lit(""))
    body = F.coalesce(_col(abstract), F.lit(""))
    return F.trim(F.concat_ws(" ", *([head] * title_weight), body))


def truncate(c, n: int) -> Column:
    """First ``n`` characters and '...', or the text itself when it is short enough."""
    text = _col(c)
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def venue_class(c) -> Column:
    """Class 1 to 8 of a venue name: the first class with a keyword in the name."""
    name = F.lower(F.coalesce(_col(c), F.lit("")))
    rule = None
    for class_id, keywords in VENUE_KEYWORDS.items():
        hit = F.lit(False)
        for keyword in keywords:
            hit = hit | name.contains(keyword)
        rule = F.when(hit, class_id) if rule is None else rule.when(hit, class_id)
    return rule.otherwise(OTHER_CLASS)


def class_name(c) -> Column:
    """Name of a class id; unknown ids read 'Class k'."""
    class_id = _col(c)
    rule = F.lit(None).cast("string")
    for known, name in CLASS_NAMES.items():
        rule = F.when(class_id == known, name).otherwise(rule)
    return F.coalesce(rule, F.concat(F.lit("Class "), class_id.cast("string")))
