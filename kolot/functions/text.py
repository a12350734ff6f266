"""The whole-string passes over columns, in Spark's own functions. NFC is the one step that Spark lacks; see `kolot.operators.normalize`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kolot.config import Config
from kolot.operators import passes as P


#: Without one of these characters, or a line that begins like an item or a break, Markdown says nothing, in a text or in a line.
_LINE = r"[*_#>|]|^[ \t]*(?:[-+]|\d{1,9}[.)])"
LINE_MARK = rf"(?mU){_LINE}"
ANY_MARK = rf"(?mU)[\\`~\[<\u{P.PARKED:04x}-\u{P.PARKED_END:04x}]|{_LINE}"


def java(pattern: str) -> str:
    """A pattern of `passes` in Java's dialect: Unicode classes, and only a line feed ends a line."""
    return "(?dU)" + pattern.replace("(?P<", "(?<").replace("(?P=f)", r"\k<f>").replace("(?P=c)", r"\k<c>").replace(r"\Z", r"\z")


def replaced(text: Column, steps: list[tuple[str, str]]) -> Column:
    for pattern, by in steps:
        text = F.regexp_replace(text, java(pattern), by.replace("\\", "$"))
    return text


def trimmed(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, rf"^[{P.WHITE}]+|[{P.WHITE}]+\z", "")


def closed(text: Column) -> Column:
    text = trimmed(text)
    return F.when((text != "") & ~text.rlike(rf"[{P.ENDS_PHRASE}]\z"), F.concat(text, F.lit("."))).otherwise(text)


def bound(value: Column, use) -> Column:
    """use(value) with the value computed once: Spark finds no common subexpressions inside lambdas."""
    return F.transform(F.array(value), use)[0]


def line_without_marks(line: Column) -> Column:
    def left(x: Column) -> Column:
        row, unquoted = x["row"], x["unquoted"]
        cells = F.filter(F.transform(F.split(row, r"\|"), trimmed), lambda c: c != "")
        return (
            F.when(line.rlike(java(P.BREAK)), "")
            .when(line.rlike(java(P.HEADING)), trimmed(F.regexp_extract(line, java(P.HEADING), 1)))
            .when(row.startswith("|") | row.endswith("|"), F.when(row.rlike(java(P.DIVIDER)), "").otherwise(closed(F.array_join(cells, ", "))))
            .when(unquoted.rlike(java(P.ITEM)), closed(F.regexp_replace(unquoted, java(P.ITEM), "")))
            .otherwise(unquoted)
        )

    said = bound(F.struct(trimmed(line).alias("row"), F.regexp_replace(line, java(P.QUOTED), "").alias("unquoted")), left)
    return F.when(line.rlike(LINE_MARK), said).otherwise(line)


def strip_code(text: Column) -> Column:
    return replaced(text, P.CODE)


def strip_links(text: Column) -> Column:
    return replaced(text, P.LINKS)


def strip_emphasis(text: Column) -> Column:
    return replaced(text, P.EMPHASIS)


def strip_markdown(text: Column) -> Column:
    """Null stays null, and a text without any mark stays as it is. Escaped backslashes are parked first, so that a pass from left to right is kept."""
    back = sorted(P._unpark.items(), key=lambda kv: kv[1] == "")

    def stripped(text: Column) -> Column:
        parked = text
        for c in P.ESCAPABLE:
            parked = F.replace(parked, F.lit("\\" + c), F.lit(chr(P.PARKED + ord(c))))
        marked = strip_links(strip_code(F.when(text.contains("\\"), parked).otherwise(text)))
        marked = F.array_join(F.transform(F.split(marked, "\n"), line_without_marks), "\n")
        marked = F.translate(strip_emphasis(marked), "".join(chr(k) for k, _ in back), "".join(v for _, v in back))
        return F.when(text.rlike(ANY_MARK), marked).otherwise(text)

    return bound(text, stripped)


def quoted(text: Column) -> Column:
    """Quotes between and behind Hebrew letters as its own marks."""
    return bound(text, lambda t: F.when(t.rlike("[\"']"), replaced(t, P.QUOTES)).otherwise(t))


def clean(text: Column, cfg: Config = Config()) -> Column:
    """All of clean but NFC. Null stays null."""

    def seen(t: Column) -> Column:
        visible = F.regexp_replace(F.regexp_replace(t, f"[{P.INVISIBLE}]", ""), f"[{P.ODD_SPACE}]", " ")
        return F.when(t.rlike(f"[{P.INVISIBLE}{P.ODD_SPACE}]"), visible).otherwise(t)

    text = quoted(bound(text, seen))
    return strip_markdown(text) if cfg.strip_markdown else text


def finalize(text: Column, cfg: Config = Config()) -> Column:
    """Null stays null. Only texts that have something to tidy are split into lines."""
    if not cfg.clean_whitespace:
        return quoted(text)
    untidy = P.UNTIDY.replace(r"\Z", r"\z")

    def tidied(t: Column) -> Column:
        lines = F.transform(F.split(replaced(t, P.SPACING), "\n"), trimmed)
        return F.when(t.rlike(untidy), trimmed(F.array_join(lines, "\n"))).otherwise(t)

    return bound(quoted(text), tidied)
