"""Pieces of SQL that the queries' oracles share. Written apart from the expressions they check; patterns are fixed values of both."""

from __future__ import annotations

from ..functions import fixed


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def names(words: list[str] | tuple[str, ...]) -> str:
    return "(" + ", ".join(map(quoted, words)) + ")"


LIGHT = r"(?is)<\s*/?\s*(?:b|strong|i|em|sup|sub|span|a)\b[^>]*>"


def plain(x: str) -> str:
    return f"regexp_replace({x}, '{LIGHT}', '', 'g')"


def squeezed(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def collapsed(x: str) -> str:
    return squeezed(plain(x))


LINES = """
    lines as (
        select doc_id, source, i - 1 as line_no, parts[i] as line
        from (select doc_id, source, parts, unnest(range(1, len(parts) + 1)) as i from (select doc_id, source, string_split(text, chr(10)) as parts from documents))
        where trim(parts[i]) <> ''
    )
"""

IDENTIFIER = r"(?i)(?:https?://|www\.)[^\s<>\"''" + r"]+|[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}|\b10\.\d{4,9}/[^\s<>\"''" + r"]+"


def count(x: str, shape: str) -> str:
    return f"len(regexp_extract_all({x}, {quoted(shape)}))"


def ends_sentence(x: str) -> str:
    return rf"({x} = '' or (regexp_matches({x}, '\p{{P}}\s*$') and not regexp_matches({x}, '[,，、]\s*$')))"


def english_words(x: str) -> str:
    return f"regexp_extract_all({x}, '[A-Za-z][A-Za-z0-9''/-]*')"


def disclaimer(x: str) -> str:
    lines = f"list_filter(list_transform(string_split(regexp_replace({x}, '<[^>]+>', '', 'g'), chr(10)), lambda l: trim(l)), lambda l: l <> '')"
    owned = f"list_filter({lines}, lambda l: l like '©%' or lower(l) like '%all rights reserved%')"
    label = rf"lower(regexp_replace({collapsed(x)}, '[ \t\r\n:;,.!?]+$', '')) = 'this report is intended for'"
    return (
        f"(not {label} and not regexp_matches({plain(x)}, {quoted(fixed.REPORT_STRUCTURE)}) and (regexp_matches({x}, {quoted(fixed.DISCLAIMER)}) "
        rf"or (regexp_matches({x}, '(?m)^\s*©') and 2 * len({owned}) >= len({lines}))))"
    )


def identifier_only(p: str) -> str:
    """Of collapsed text."""
    bare = f"regexp_replace({p}, '[.,;]+$', '')"
    whole = rf"regexp_replace({p}, '-\s+([A-Za-z0-9])', '-\1', 'g')"
    return (
        rf"({p} <> '' and ((regexp_matches({bare}, '(?i)^[A-Z0-9]+(?:[/_\-][A-Z0-9]+){{2,}}[/_\-]?$') and regexp_matches({bare}, '\d')) "
        rf"or (regexp_matches({whole}, '{IDENTIFIER}') and regexp_matches(regexp_replace({whole}, '{IDENTIFIER}', ' ', 'g'), '^[\s\d.,;:()\[\]{{}}<>#*†‡|/\\\-]*$'))))"
    )


def structured_row(p: str) -> str:
    """Of collapsed text."""
    tokens = rf"list_filter(list_transform(string_split({p}, ' '), lambda t: regexp_replace(t, '^[.,;:()\[\]]+|[.,;:()\[\]]+$', '', 'g')), lambda t: t <> '')"
    fine = rf"len(list_filter({tokens}, lambda t: not (regexp_matches(t, '^[A-Z0-9][A-Z0-9./%$&+\-]*$') and lower(t) not in {names(fixed.ROW_LABEL_WORDS)}))) = 0"
    return rf"(length({p}) between 1 and 80 and not regexp_matches({p}, '[a-z]') and len({tokens}) >= 2 and {fine} and len(list_filter({tokens}, lambda t: regexp_matches(t, '\p{{L}}'))) > 0 and 2 * len(list_filter({tokens}, lambda t: regexp_matches(t, '\d'))) >= len({tokens}))"


def short_citation(p: str) -> str:
    """Of collapsed text."""
    mark, year = r"^(?:\[\s*\d{1,4}\s*\]|\d{1,4}(?:[.)])?)\s+", r"(?i)\((?:18|19|20)\d{2}[a-z]?\)"
    word = r"\p{L}+(?:[''’\-]\p{L}+)*\.?"
    parts = rf"string_split_regex(regexp_replace({p}, '{mark}', ''), '{year}')"
    authors = rf"regexp_replace({parts}[1], '^[ ,]+|[ ,]+$', '', 'g')"
    connectors = "al and da de del der di dos du et jr la le st van von".split()
    own = rf"list_filter(list_transform(regexp_extract_all({authors}, '{word}'), lambda w: regexp_replace(w, '\.+$', '')), lambda w: lower(w) not in {names(connectors)})"
    tail = r"(?i)^\s*(?:(?:[,;:]?\s*)?(?:p{1,2}\.\s*)?\d+(?:\s*[-–—,]\s*\d+)*)?(?:\s*[,;:]?\s*op\.\s*cit\.)?\s*\.?\s*$"
    return (
        rf"(length({p}) between 1 and 180 and contains({p}, '(') and len({parts}) = 2 and regexp_matches(coalesce({parts}[2], ''), '{tail}') "
        rf"and regexp_matches(regexp_replace({authors}, '{word}', '', 'g'), '^[\s,&.''’\-]*$') and len({own}) between 1 and 8 and len(list_filter({own}, lambda w: not regexp_matches(w, '^\p{{Lu}}'))) = 0 "
        rf"and (regexp_matches({p}, '{mark}') or len({own}) = 1 or regexp_matches({authors}, '(?i)(?:&|\band\b|\bet\s+al\.?)')))"
    )


def math_text(t: str) -> str:
    """Of text without bold and raised tags, trimmed."""
    symbols, relations = rf"[\p{{Sm}}{fixed.MATH_SYMBOLS}]", f"[{fixed.MATH_RELATIONS}]"
    own = f"regexp_extract_all({t}, '[A-Za-z][A-Za-z0-9'']*')"
    is_variable = rf"(lower(w) in {names(fixed.MATH_FUNCTIONS)} or length(w) = 1 or regexp_full_match(w, '[A-Za-z]{{1,3}}\d+') or (length(w) = 2 and lower(w) not in {names(fixed.SHORT_PROSE_WORDS)}))"
    prose = f"list_filter({own}, lambda w: not {is_variable})"
    letters = lambda ws: f"coalesce(list_sum(list_transform({ws}, lambda w: length(w))), 0)"
    s, b, r, o, g = (count(t, x) for x in (symbols, "�", relations, r"[+−*/^_]", r"[()\[\]{}|]"))
    weight = rf"(2 * {s} + 3 * {b} + 2 * {r} + {o} + least({g}, 4) + least({count(t, r'\d')}, 4) + {letters(own)} - {letters(prose)})"
    shaped = f"({s} + {b} + {r} > 0 or {o} >= 2 or {g} >= 4)"
    call = rf"(len({prose}) = 0 and len(list_filter({own}, lambda w: lower(w) in {names(fixed.MATH_FUNCTIONS)})) > 0 and length(regexp_replace({t}, '\s+', '', 'g')) <= 16)"
    right = f"regexp_extract_all(regexp_extract({t}, '(?s){relations}(.*)$', 1), '[A-Za-z][A-Za-z0-9'']*')"
    equation = f"({r} > 0 and length({t}) <= 90 and len({prose}) <= 4 and len(list_filter({right}, lambda w: not {is_variable})) = 0 and ({s} + {b} > 0 or len({own}) > len({prose})))"
    dense = rf"10 * {count(t, rf'[\p{{Sm}}{fixed.MATH_SYMBOLS}{{}}^_()\[\]|]')} > 3 * length({t})"
    latex = [fixed.LATEX_SHAPES[0], r"\$[^$\n]{0,159}[a-zA-Z\\^_{}=<>+*/-][^$\n]{0,159}\$", *fixed.LATEX_SHAPES[2:]]  # the second without its lookahead
    shapes = " or ".join(f"regexp_matches({t}, {quoted(x)})" for x in latex)
    return f"(length({t}) between 1 and 300 and ({shapes} or {call} or ({shaped} and len({prose}) = 0) or {equation} or ({shaped} and len({prose}) <= 1 and {weight} >= 10 and {weight} >= 1.15 * {letters(prose)}) or {dense}))"


def math_source(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '(?is)</?(?:b|sup)\b[^>]*>', '', 'g'), '^\s+|\s+$', '', 'g')"


#: A chain of steps over `base` (key columns, p: collapsed text): each flag is worked out once.
def rule(columns: str, base: str) -> str:
    """select columns, rule of rows (columns, p)."""
    return rf"""
        select {columns}, case when p = '' then 'empty' when {disclaimer('p')} then 'disclaimer' when {math_text('p')} then 'math' when {identifier_only('p')} then 'identifier'
            when {short_citation('p')} then 'citation' when not regexp_matches(p, '\p{{L}}') then 'no_letters' when not regexp_matches(p, '[A-Za-z]') then 'no_words'
            when not regexp_matches(p, '[A-Za-z][A-Za-z0-9''/-]') then 'single_letters'
            when length(p) <= 12 and len(list_filter({english_words('p')}, lambda w: length(w) > 1)) = 1
                and regexp_full_match(list_filter({english_words('p')}, lambda w: length(w) > 1)[1], '[A-Z0-9''/-]{{0,8}}') then 'acronym'
            when {structured_row('p')} then 'structured_row' end as rule
        from {base}
    """
