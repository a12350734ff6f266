"""DuckDB SQL for the queries: written apart from the Spark expressions, by components and lists rather than word tables."""

from __future__ import annotations

from kolot import lexicon as L
from kolot.operators import passes as P
from kolot.operators.rules import protect


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words(items: list[str]) -> str:
    return "[" + ", ".join(map(q, items)) + "]"


def case_of(expr: str, table: dict, default: str = "NULL") -> str:
    return f"CASE {expr} " + " ".join(f"WHEN {q(k) if isinstance(k, str) else k} THEN {q(v) if isinstance(v, str) else v}" for k, v in table.items()) + f" ELSE {default} END"


def glue(parts: str) -> str:
    """A list of components with nulls left out, the last of several with "and"."""
    return f"list_transform([list_filter({parts}, lambda x: x IS NOT NULL)], lambda p: CASE WHEN len(p) = 1 THEN p[1] ELSE array_to_string(p[1:len(p) - 1], ' ') || ' {L.AND}' || p[len(p)] END)[1]"


def below_thousand(n: str, g: str) -> str:
    return (
        f"[CASE WHEN {n} >= 100 THEN {words(L.HUNDREDS)}[({n} // 100)::INT] END, "
        f"CASE WHEN {n} % 100 BETWEEN 10 AND 19 THEN {words(L.TEENS[g])}[({n} % 100 - 9)::INT] WHEN {n} % 100 >= 20 THEN {words(L.TENS)}[({n} % 100 // 10 - 1)::INT] END, "
        f"CASE WHEN {n} % 10 > 0 AND {n} % 100 NOT BETWEEN 10 AND 19 THEN {words(L.ONES[g])}[({n} % 10 + 1)::INT] END]"
    )


def scaled(n: str, one: str, two: str, few: str | None) -> str:
    mid = f" WHEN {n} <= 10 THEN {case_of(n, L.BOUND['m'])} || ' {few}'" if few else ""
    return f"CASE WHEN {n} = 0 THEN NULL WHEN {n} = 1 THEN {q(one)} WHEN {n} = 2 THEN {q(two)}{mid} ELSE {glue(below_thousand(n, 'm'))} || ' {one}' END"


def cardinal(n: str, g: str = "f", bound: bool = False, most: int = 10**12) -> str:
    """Words of an integer below 10 ** 12 in size."""
    a = f"abs({n})"
    two = L.BOUND["m"][2]
    groups = [(10**9, L.MILLIARD, f"{two} {L.MILLIARD}", None), (10**6, L.MILLION, f"{two} {L.MILLION}", None), (1000, L.THOUSAND, L.TWO_THOUSAND, L.THOUSANDS)]
    parts = ", ".join(f"[{scaled(f'({a} // {size} % 1000)', one, dual, few)}]" for size, one, dual, few in groups if size <= most)
    below = below_thousand(f"({a} % 1000)", g)
    whole = glue(f"list_concat({parts}, {below})" if parts else below)
    special = f"WHEN {a} IN ({', '.join(map(str, L.BOUND[g]))}) THEN {case_of(a, L.BOUND[g])} " if bound else ""
    return f"CASE WHEN {n} < 0 THEN '{L.MINUS} ' ELSE '' END || CASE {special}WHEN {a} = 0 THEN {q(L.ONES[g][0])} ELSE {whole} END"


def digits(text: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({text}, '[0-9]'), lambda d: {words(L.ONES['f'])}[d::INT + 1]), ' ')"


def amount(n: str, one: str, many: str, g: str, most: int = 10**12) -> str:
    return f"CASE WHEN {n} = 1 THEN {one} || ' {L.ONES[g][1]}' WHEN {n} = 2 THEN '{L.BOUND[g][2]} ' || {many} ELSE {cardinal(n, g, most=most)} || ' ' || {many} END"


def ordinal(n: str, g: str, definite: bool) -> str:
    return f"{q(L.THE if definite else '')} || CASE WHEN {n} BETWEEN 1 AND 10 THEN {words(L.ORDINALS[g])}[({n})::INT] ELSE {cardinal(n, g, most=10**6)} END"


def day_month(day: str, month: str) -> str:
    return f"CASE WHEN {day} = 1 THEN '{L.THE}{L.ORDINALS['m'][0]}' ELSE {cardinal(day, 'm', most=31)} END || ' ב' || {words(L.MONTHS)}[({month})::INT]"


def date(day: str, month: str, year: str) -> str:
    return f"{day_month(day, month)} || ' ' || {cardinal(year, most=9999)}"


def gender(word: str) -> str:
    known = "MAP {" + ", ".join(f"{q(w)}: {q(g)}" for w, g in L.NOUNS.items()) + "}"
    ends = "MAP {" + ", ".join(f"{q(w)}: {q(g)}" for w, g in L.ENDINGS.items()) + "}"
    clitic = f"'^[{L.CLITICS}]..'"
    once = f"CASE WHEN regexp_matches({word}, {clitic}) THEN {word}[2:] END"
    twice = f"CASE WHEN regexp_matches({word}, {clitic}) AND regexp_matches({word}[2:], {clitic}) THEN {word}[3:] END"
    looks = ", ".join(f"{table}[{form}]" for table in (known, ends) for form in (word, f"({once})", f"({twice})"))
    return f"coalesce({looks}, CASE WHEN {word} LIKE '%ים' THEN 'm' WHEN {word} LIKE '%ה' OR {word} LIKE '%ת' THEN 'f' ELSE 'm' END)"


def count_phrase(n: str, noun: str) -> str:
    def said(g: str) -> str:
        return f"CASE WHEN length({noun}) > 2 AND {noun} LIKE 'ה%' AND {n} BETWEEN 3 AND 10 THEN {cardinal(n, g, bound=True, most=99)} || ' ' || {noun} ELSE {amount(n, noun, noun, g, 99)} END"

    return f"CASE WHEN {gender(noun)} = 'm' THEN {said('m')} ELSE {said('f')} END"


def minute(n: str) -> str:
    return f"CASE WHEN {n} < 10 THEN '{L.ONES['f'][0]} ' || {words(L.ONES['f'])}[({n} + 1)::INT] ELSE {cardinal(n, most=59)} END"


def on_face(h: str, m: str) -> str:
    """An hour and minute as a clock's face shows them, without the part of the day."""
    hour = lambda x: cardinal(f"(({x} + 11) % 12 + 1)", most=12)
    return f"CASE {m} WHEN 0 THEN {hour(h)} WHEN 15 THEN {hour(h)} || ' ורבע' WHEN 30 THEN {hour(h)} || ' וחצי' WHEN 45 THEN 'רבע ל' || {hour(f'({h} + 1)')} ELSE {hour(h)} || ' ו' || {cardinal(m, most=59)} END"


def time12(h: str, m: str) -> str:
    part = f"CASE WHEN {h} = 12 THEN '{L.NOON}' WHEN {h} BETWEEN 5 AND 11 THEN '{L.MORNING}' WHEN {h} BETWEEN 13 AND 16 THEN '{L.AFTERNOON}' WHEN {h} BETWEEN 17 AND 20 THEN '{L.EVENING}' ELSE '{L.NIGHT}' END"
    return f"CASE WHEN {h} = 0 AND {m} = 0 THEN '{L.MIDNIGHT}' ELSE {on_face(h, m)} || ' ' || {part} END"


def money(code: str) -> str:
    """Over columns cents (never negative) and negative."""
    _, one, many, g, cent, cents, cg, _ = next(c for c in L.CURRENCIES if c[0] == code)
    major, minor = amount("(cents // 100)", q(one), q(many), g, 10**9), amount("(cents % 100)", q(cent), q(cents), cg, 99)
    return f"CASE WHEN negative THEN '{L.MINUS} ' ELSE '' END || CASE WHEN cents % 100 = 0 THEN {major} WHEN cents // 100 = 0 THEN {minor} ELSE {major} || ' ו' || {minor} END"


def fraction() -> str:
    return "regexp_replace(lpad((cents % 100)::VARCHAR, 2, '0'), '0+$', '')"


def decimal(g: str = "f", most: int = 10**9) -> str:
    return f"{cardinal('(cents // 100)', g, most=most)} || ' נקודה ' || {digits(fraction())}"


def number(after: str = "", whole: str | None = None, g: str = "f", most: int = 10**9) -> str:
    said = whole or cardinal("(cents // 100)", g, most=most)
    return f"CASE WHEN negative THEN '{L.MINUS} ' ELSE '' END || CASE WHEN cents % 100 = 0 THEN {said} ELSE {decimal(g, most)}{f' || {q(after)}' if after else ''} END"


def in_cents(keys: str, column: str, table: str, factor: int = 1) -> str:
    """A CTE body with columns keys, cents and negative."""
    return f"SELECT {keys}, round(abs({column}) * {100 * factor})::BIGINT AS cents, round({column} * {100 * factor})::BIGINT < 0 AS negative FROM {table}"


ASCII_ADDRESS = r"(^|[^0-9])([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})($|[^0-9])"


def unescaped(text: str) -> str:
    return "".join(f"\\x{{{ord(c):04x}}}" if ord(c) > 126 else c for c in text)


def finalized(text: str) -> str:
    """finalize over texts without a letter of the Hebrew block, in which quotes keep their shape."""
    white = unescaped(P.WHITE)
    spaced = f"regexp_replace(regexp_replace(regexp_replace({text}, '[ \\t]{{2,}}', ' ', 'g'), '[{white}]+([,.;:!?])', '\\1', 'g'), '\\n{{3,}}', E'\\n\\n', 'g')"
    ends = f"'^[{white}]+|[{white}]+$'"
    lines = f"array_to_string(list_transform(string_split({spaced}, E'\\n'), lambda l: regexp_replace(l, {ends}, '', 'g')), E'\\n')"
    return f"regexp_replace({lines}, {ends}, '', 'g')"


def unmarked(text: str) -> str:
    """strip_markdown over texts whose only marks are table rows and stars, as the documents' are."""
    white = unescaped(P.WHITE)
    trim = lambda x: f"regexp_replace({x}, '^[{white}]+|[{white}]+$', '', 'g')"
    cells = f"array_to_string(list_filter(list_transform(string_split(r, '|'), lambda c: {trim('c')}), lambda c: c <> ''), ', ')"
    closed = f"list_transform([{cells}], lambda j: CASE WHEN j = '' OR regexp_matches(j, '[{unescaped(P.ENDS_PHRASE)}]$') THEN j ELSE j || '.' END)[1]"
    line = f"list_transform([{trim('l')}], lambda r: CASE WHEN r LIKE '|%' OR r LIKE '%|' THEN {closed} ELSE l END)[1]"
    lines = f"array_to_string(list_transform(string_split({text}, E'\\n'), lambda l: {line}), E'\\n')"
    bold = f"regexp_replace({lines}, '(?s)\\*\\*([^{white}](?:.*?[^{white}])??)\\*\\*', '\\1', 'g')"
    return f"regexp_replace({bold}, '\\*([^{white}*](?:[^*\\n]*?[^{white}*])??)\\*', '\\1', 'g')"


def protected(text: str) -> str:
    """Spans of the protect rule; RE2 has all that its pattern needs, but its word boundaries are those of ASCII."""
    return f"regexp_extract_all({text}, {q(protect.PATTERN)})"
