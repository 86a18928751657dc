"""Text shapes as column expressions. A null text counts as empty unless stated otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def _c(text: Column | str) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def let(value: Column, body) -> Column:
    """body(value) with value worked out once a row: a lambda binds it. (A value that is named twice is worked out twice.)"""
    return F.transform(F.array(value), body)[0]


def plain_text(text: Column | str) -> Column:
    """Without light inline markup; comparison signs stay."""
    return F.regexp_replace(_c(text), fixed.LIGHT_TAGS, "")


def squeezed(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")


def collapsed(text: Column | str) -> Column:
    return squeezed(plain_text(text))


def joined_lines(lines: Column) -> Column:
    """Lines squeezed, blank ones dropped, joined by a space."""
    return F.array_join(F.filter(F.transform(lines, lambda x: squeezed(F.coalesce(x, F.lit("")))), lambda x: x != ""), " ")


def without_reasoning(text: Column | str) -> Column:
    """Closed reasoning blocks, and an unclosed one to the end, are dropped."""
    closed = F.regexp_replace(_c(text), r"(?s)<think>.*?</think>", "")
    return F.regexp_replace(F.regexp_replace(closed, r"(?s)<think>.*\z", ""), r"(?U)^\s+|\s+$", "")


def is_list_marker(text: Column | str) -> Column:
    marker = squeezed(_c(text))
    shape = (
        r"^(?:[•▪●◦⁃∙\-*·]+|\(?\d{1,3}[.)]\)?|\(?[A-Za-z][.)]\)?"
        r"|\(?[ivxlcdmIVXLCDM]{1,8}[.)]\)?|[一-鿿]{1,3}[、.)])$"
    )
    return F.length(marker).between(1, 12) & marker.rlike(shape)


def is_paragraph_lead(text: Column | str) -> Column:
    """Numbered or bulleted start of a paragraph; a year in parentheses is a citation, not a number."""
    plain = collapsed(text)
    atom = r"(?:\d+(?:\.\d+)*|[A-Za-z]|[ivxlcdmIVXLCDM]{1,8})"
    numbered = plain.rlike(rf"^(?:{atom}[.)]|\({atom}\))\s+\S") & ~plain.rlike(r"^\((?:18|19|20)\d{2}\)\s")
    return numbered | plain.rlike(r"^[•▪●◦⁃∙\-*·]+\s+\S")


def has_terminal_boundary(text: Column | str) -> Column:
    return collapsed(text).rlike("[.!?。！？][\"'’”）)\\]]*$")


def ends_sentence(text: Column | str) -> Column:
    """Any punctuation but a comma at the end; an empty text has nothing to continue."""
    end = F.regexp_replace(_c(text), r"(?U)\s+$", "")
    return (F.length(end) == 0) | (end.rlike(r"\p{P}$") & ~end.rlike("[,，、]$"))


def leading_tail(text: Column | str, most: int = 400) -> Column:
    """struct<tail, rest>: what a page's first text carries on of a sentence, up to its first full stop (with closing signs and a footnote
    mark) before a capital, a figure, a Chinese sign or the end; null where there is none within so many characters."""
    stops = "|".join(a.replace(".", r"\.") for a in fixed.ABBREVIATIONS)
    stop = r"[\p{Po}\p{Pe}\p{Pf}&&[^,，、]]"
    closers = "[" + fixed.SENTENCE_CLOSERS.replace("]", r"\]") + "]*"
    after = r"(?=$|\s+(?:$|[^\p{L}\p{N}]*[\p{Lu}\p{N}\u2e80-\u9fff]))"
    no_abbreviation = rf"(?<!(?i:\b(?:{stops}|et\s{{1,3}}al)\.)(?=\s{{1,9}}\S))(?<!(?:\b|\.)[A-Za-z]\.[A-Za-z]\.(?=\s{{1,9}}\S))"
    shape = rf"(?s)^(.*?{stop}{no_abbreviation}{closers}(?:{fixed.FOOTNOTE_MARK}(?=\s|$))?){after}(.*)$"

    def of(plain: Column) -> Column:
        parts = F.struct(F.regexp_extract(plain, shape, 1).alias("tail"), F.regexp_replace(F.regexp_extract(plain, shape, 2), r"(?U)^\s+", "").alias("rest"))
        return let(parts, lambda p: F.when((p["tail"] != "") & (F.length(p["tail"]) <= most), p))

    return let(collapsed(text), of)


def is_heading(text: Column | str) -> Column:
    """Short, and at least four in five letters are capitals."""
    t = F.regexp_replace(_c(text), r"(?U)^\s+|\s+$", "")
    letters, capitals = F.regexp_count(t, F.lit(r"\p{L}")), F.regexp_count(t, F.lit(r"\p{Lu}"))
    return F.length(t).between(1, 130) & (letters >= 4) & (5 * capitals >= 4 * letters)


def is_reference_lead(text: Column | str) -> Column:
    """First line of a bibliography entry: a capital, author punctuation, then a year among the first 180 characters."""
    plain = collapsed(text)
    year = r"(?<!\d)(?:18\d{2}|19\d{2}|20[0-2]\d)[a-z]?(?!\d)"
    head = F.substring(plain, 1, 180)
    before = F.split(head, year, 2)[0]
    return (F.length(plain) >= 18) & plain.rlike(r"^\p{Lu}") & head.rlike(year) & (before.rlike("[,(&]") | before.rlike(r"(?i)\b(?:and|et\s+al)\b"))


def is_skip_page(text: Column | str) -> Column:
    """At most ten lines, one of the first three a bibliography or index heading."""
    lines = F.filter(F.transform(F.split(_c(text), r"\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    heading = F.exists(F.slice(lines, 1, 3), lambda x: (F.length(x) <= 80) & F.regexp_replace(squeezed(x), "^[ \\t\\-–—:;]+|[ \\t\\-–—:;]+$", "").rlike(fixed.SKIP_HEADING))
    return (F.size(lines) <= 10) & heading


def is_disclaimer(text: Column | str) -> Column:
    def of(t: Column) -> Column:
        label = F.lower(F.regexp_replace(collapsed(t), "[ \\t\\r\\n:;,.!?]+$", "")) == "this report is intended for"
        lines = F.filter(F.transform(F.split(F.regexp_replace(t, "<[^>]+>", ""), "\n"), F.trim), lambda x: x != "")
        owned = F.filter(lines, lambda x: x.startswith("©") | F.contains(F.lower(x), F.lit("all rights reserved")))
        notice = F.contains(t, F.lit("©")) & t.rlike(r"(?m)^\s*©") & (2 * F.size(owned) >= F.size(lines))
        return (t.rlike(fixed.DISCLAIMER) | notice) & ~label & ~plain_text(t).rlike(fixed.REPORT_STRUCTURE)

    return let(_c(text), of)


#: URLs, mail addresses and DOIs.
IDENTIFIER = r"(?i)(?:https?://|www\.)[^\s<>\"']+|[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}|\b10\.\d{4,9}/[^\s<>\"']+"


def identifiers(text: Column | str) -> Column:
    """All of them, sorted: two texts that keep their identifiers have equal arrays."""
    return F.array_sort(F.regexp_extract_all(collapsed(text), F.lit(IDENTIFIER), F.lit(0)))


def is_identifier_only(text: Column | str) -> Column:
    """Identifiers and footnote marks, or one structured code."""
    return let(collapsed(text), _identifier_only)


def _identifier_only(plain: Column) -> Column:
    bare = F.regexp_replace(plain, "[.,;]+$", "")
    code = ~F.contains(plain, F.lit(" ")) & bare.rlike(r"(?i)^(?=[A-Z0-9/_\-]*\d)[A-Z0-9]+(?:[/_\-][A-Z0-9]+){2,}[/_\-]?$")
    whole = F.regexp_replace(plain, r"(?<=-)\s+(?=[A-Za-z0-9])", "")
    rest = F.regexp_replace(whole, IDENTIFIER, " ")
    hinted = F.contains(plain, F.lit("@")) | F.contains(plain, F.lit("/")) | F.contains(F.lower(plain), F.lit("www."))  # what every identifier has
    return (plain != "") & (code | (hinted & whole.rlike(IDENTIFIER) & rest.rlike(r"^[\s\d.,;:()\[\]{}<>#*†‡|/\\\-]*$")))


def is_structured_row(text: Column | str) -> Column:
    """A row of dates, codes and numbers: no lower case, two tokens or more, digits in at least half of them."""
    return let(collapsed(text), _structured_row)


def _structured_row(plain: Column) -> Column:
    tokens = F.filter(F.transform(F.split(plain, " "), lambda x: F.regexp_replace(x, r"^[.,;:()\[\]]+|[.,;:()\[\]]+$", "")), lambda x: x != "")
    fine = F.forall(tokens, lambda x: x.rlike(r"^[A-Z0-9][A-Z0-9./%$&+\-]*$") & ~F.lower(x).isin(fixed.ROW_LABEL_WORDS))
    with_letter = F.size(F.filter(tokens, lambda x: x.rlike(r"\p{L}")))
    with_digit = F.size(F.filter(tokens, lambda x: x.rlike(r"\d")))
    return F.length(plain).between(1, 80) & ~plain.rlike("[a-z]") & (F.size(tokens) >= 2) & fine & (with_letter > 0) & (2 * with_digit >= F.size(tokens))


def english_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[A-Za-z][A-Za-z0-9'/-]*"), F.lit(0))


def is_tiny_label(text: Column | str) -> Column:
    def of(plain: Column) -> Column:
        n = F.size(english_words(plain))
        return (F.length(plain) <= 18) & (n > 0) & (((n <= 1) & (F.length(plain) <= 12)) | (n <= 2))

    return let(collapsed(text), of)


def is_short_citation(text: Column | str) -> Column:
    """Authors and one year, up to 180 characters: ``29 Hasbrouck & Saar (2011).``"""
    return let(collapsed(text), _short_citation)


def _short_citation(plain: Column) -> Column:
    mark = r"^(?:\[\s*\d{1,4}\s*\]|\d{1,4}(?:[.)])?)\s+"
    year, connectors = r"(?i)\((?:18|19|20)\d{2}[a-z]?\)", "al and da de del der di dos du et jr la le st van von".split()
    body = F.regexp_replace(plain, mark, "")
    parts = F.split(body, year, -1)
    authors = F.regexp_replace(parts[0], "^[ ,]+|[ ,]+$", "")
    word = r"[^\W\d_]+(?:['’\-][^\W\d_]+)*\.?"
    words = F.transform(F.regexp_extract_all(authors, F.lit("(?U)" + word), F.lit(0)), lambda x: F.regexp_replace(x, r"\.+$", ""))
    own = F.filter(words, lambda x: ~F.lower(x).isin(connectors))
    tail = r"(?i)^\s*(?:(?:[,;:]?\s*)?(?:p{1,2}\.\s*)?\d+(?:\s*[-–—,]\s*\d+)*)?(?:\s*[,;:]?\s*op\.\s*cit\.)?\s*\.?\s*$"
    joined = authors.rlike(r"(?i)(?:&|\band\b|\bet\s+al\.?)")
    return (
        F.length(plain).between(1, 180)
        & F.contains(plain, F.lit("("))
        & (F.size(parts) == 2)
        & F.coalesce(F.get(parts, F.lit(1)).rlike(tail), F.lit(False))
        & F.regexp_replace(authors, "(?U)" + word, "").rlike(r"^[\s,&.'’\-]*$")
        & F.size(own).between(1, 8)
        & F.forall(own, lambda x: x.rlike(r"^\p{Lu}"))
        & (plain.rlike(mark) | (F.size(own) == 1) | joined)
    )


def toc_entries(text: Column | str) -> Column:
    """array<struct<label, page>> of rows with dotted leaders, in order."""
    plain = collapsed(text)
    leader = r"(?:[.…·]\s*){4,}\s*(\d+)\b"
    labels, pages = F.split(plain, leader, -1), F.regexp_extract_all(plain, F.lit(leader), F.lit(1))
    rows = F.transform(pages, lambda p, i: F.struct(F.trim(labels[i]).alias("label"), p.alias("page")))
    return F.filter(rows, lambda r: r["label"] != "")


def font_bucket(size: Column | str) -> Column:
    """To half points, ties to the even one."""
    return F.bround(2 * F.greatest(F.col(size) if isinstance(size, str) else size, F.lit(1.0))) / 2


def is_light_gray(color: Column | str) -> Column:
    c = F.col(color) if isinstance(color, str) else color
    rgb = [F.shiftright(c, s).bitwiseAND(F.lit(255)) for s in (16, 8, 0)]
    return (rgb[0] + rgb[1] + rgb[2] >= 3 * 125) & (F.greatest(*rgb) - F.least(*rgb) <= 28)


def is_math_text(text: Column | str) -> Column:
    """Whether a short text is mostly mathematics: shapes of LaTeX, or signs and variables that outweigh its words."""
    return let(F.regexp_replace(F.regexp_replace(_c(text), r"(?is)</?(?:b|sup)\b[^>]*>", ""), r"(?U)^\s+|\s+$", ""), _math_text)


def _math_text(t: Column) -> Column:
    symbols = rf"[\p{{Sm}}{fixed.MATH_SYMBOLS}]"

    def any_of(names: list[str]) -> str:
        return "|".join(names)

    variable = rf"(?i)^(?:{any_of(fixed.MATH_FUNCTIONS)}|[a-z]|[a-z]{{1,3}}\d+|(?!(?:{any_of(fixed.SHORT_PROSE_WORDS)})$)[a-z][a-z0-9'])$"
    names = lambda of: F.regexp_extract_all(of, F.lit("[A-Za-z][A-Za-z0-9']*"), F.lit(0))
    count = lambda shape: F.regexp_count(t, F.lit(shape))

    def weighed(own: Column) -> Column:
        prose = F.filter(own, lambda w: ~w.rlike(variable))
        n_letters = lambda words: F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w))
        n_symbols, n_broken, n_relations, n_operators, n_brackets = count(symbols), count("\ufffd"), count(f"[{fixed.MATH_RELATIONS}]"), count(r"[+−*/^_]"), count(r"[()\[\]{}|]")
        weight = 2 * n_symbols + 3 * n_broken + 2 * n_relations + n_operators + F.least(n_brackets, F.lit(4)) + F.least(count(r"\d"), F.lit(4)) + n_letters(own) - n_letters(prose)
        shaped = (n_symbols + n_broken + n_relations > 0) | (n_operators >= 2) | (n_brackets >= 4)
        call = (F.size(prose) == 0) & F.exists(own, lambda w: F.lower(w).isin(fixed.MATH_FUNCTIONS)) & (F.length(F.regexp_replace(t, r"(?U)\s+", "")) <= 16)
        right = F.regexp_extract(t, f"(?s)[{fixed.MATH_RELATIONS}](.*)$", 1)
        equation = (n_relations > 0) & (F.length(t) <= 90) & (F.size(prose) <= 4) & F.forall(names(right), lambda w: w.rlike(variable)) & ((n_symbols + n_broken > 0) | (F.size(own) > F.size(prose)))
        outweighs = shaped & (F.size(prose) <= 1) & (weight >= 10) & (weight >= 1.15 * n_letters(prose))
        dense = 10 * count(rf"[\p{{Sm}}{fixed.MATH_SYMBOLS}{{}}^_()\[\]|]") > 3 * F.length(t)
        return call | (shaped & (F.size(prose) == 0)) | equation | outweighs | dense

    latex = F.lit(False)
    for shape in fixed.LATEX_SHAPES:
        latex = latex | t.rlike(shape)
    marked = t.rlike(rf"[\p{{Sm}}{fixed.MATH_SYMBOLS}\ufffd{fixed.MATH_RELATIONS}+−*/^_()\[\]{{}}|\\$]")
    return F.length(t).between(1, 300) & (marked | (F.length(t) <= 40)) & ((marked & latex) | let(names(t), weighed))


def translatable_rule(text: Column | str) -> Column:
    """Why a text needs no translation, the first rule that holds; null if it needs one."""

    def of(plain: Column) -> Column:
        meaning = F.filter(english_words(plain), lambda w: F.length(w) > 1)
        only = F.get(meaning, F.lit(0))
        acronym = (F.length(plain) <= 12) & (F.size(meaning) == 1) & F.coalesce(only.rlike("^[A-Z0-9'/-]*$") & (F.length(only) <= 8), F.lit(False))
        return (
            F.when(plain == "", "empty")
            .when(is_disclaimer(plain), "disclaimer")
            .when(is_math_text(plain), "math")
            .when(_identifier_only(plain), "identifier")
            .when(_short_citation(plain), "citation")
            .when(~plain.rlike(r"\p{L}"), "no_letters")
            .when(~plain.rlike("[A-Za-z]"), "no_words")
            .when(~plain.rlike("[A-Za-z][A-Za-z0-9'/-]"), "single_letters")
            .when(acronym, "acronym")
            .when(_structured_row(plain), "structured_row")
        )

    return let(collapsed(text), of)
