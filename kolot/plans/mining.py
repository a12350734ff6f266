"""Mining sentences worth reading from corpora: tidy, accept, file by trigger, drop repeats, sample evenly."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kolot.functions.numerals import lookup

# Letters, marks and words of the trigger classes, in the order in which a sentence is filed.
LETTER = "\u0590-\u05ff"
MARKS = "״\""
HEBREW_MONTHS = "תשרי|חשוון|חשון|כסלו|טבת|שבט|אדר|אדר א|אדר ב|ניסן|אייר|סיוון|סיון|תמוז|אב|אלול"
MONTHS = "ינואר|פברואר|מרץ|מרס|אפריל|מאי|יוני|יולי|אוגוסט|ספטמבר|אוקטובר|נובמבר|דצמבר"
UNITS = (
    "מ״מ|ס״מ|ק״מ|מ״ג|ק״ג|מ״ל|מ״ר|ס״ר|ק״ר|מ״ק|ק״ב|מ״ב|ג״ב|ט״ב|קמ״ש"
    "|מילימטר|סנטימטר|קילומטר|מיליגרם|קילוגרם|מיליליטר|ליטר|גרם|טון|קילו|קוב|דונם"
    "|מעלות|מעלה|שניות|שנייה|דקות|דקה|שעות|שעה|ימים|יום|שבועות|שבוע|חודשים|חודש"
    "|שנים|שנה|מטרים|מטר|קילובייט|מגהבייט|גיגהבייט|טרהבייט"
)
ABBREVIATIONS = "ד״ר|פרופ׳|מס׳|עו״ד|רו״ח|ח״כ|ת״ד|רח׳|כת׳|וכו׳|וגו׳|בע״מ|צה״ל|ארה״ב|ע״י|ע״פ"
MONEY = "ש״ח|שקל|שקלים|אגורות|אגורה|דולר|דולרים|יורו|אירו|פאונד|סנט"
CATEGORIES = [
    ("permille", "‰"),
    ("degree", r"\d\s*°|°[CF]"),
    ("hebrew_date", rf"[{LETTER}]{{1,2}}[{MARKS}][{LETTER}]\s*ב?({HEBREW_MONTHS})\b"),
    ("phone", r"(?<!\d)0\d{1,2}[- ]?\d{7}(?!\d)|\*\d{3,4}(?!\d)"),
    ("time", r"(?<!\d)\d{1,2}:\d{2}(?!\d)"),
    ("date_numeric", r"(?<!\d)\d{1,2}[./-]\d{1,2}([./-]\d{2,4})?(?!\d)"),
    ("month_name", rf"\d[^\n]{{0,12}}\b({MONTHS})\b|\b({MONTHS})\b[^\n]{{0,12}}\d"),
    ("currency", rf"[₪$€£]|\d[\s\-]*({MONEY})|({MONEY})[\s\-]*\d"),
    ("percent", r"\d\s*%|%\s*\d"),
    ("unit", rf"\d\s*({UNITS})(?![{LETTER}])"),
    ("range", r"(?<!\d)\d+\s*[-–—]\s*\d+(?!\d)|\d+\s+עד\s+\d+"),
    ("large_number", r"\d{1,3}(,\d{3})+"),
    ("fraction", r"(?<!\d)\d{1,3}/\d{1,3}(?!\d)(?!\s*/)"),
    ("decimal", r"(?<!\d)\d+\.\d+(?!\d)"),
    ("signed", r"(?<=[\s(\[])[-−]\d"),
    ("abbrev", rf"(?<![{LETTER}])({ABBREVIATIONS})(?![{LETTER}])"),
    ("gershayim", rf"(?<![{LETTER}])[{LETTER}]{{1,3}}[{MARKS}][{LETTER}](?![{LETTER}])"),
    ("integer", r"\d"),
]
REJECT = r"[♪♫<>{}\[\]|]|https?://|www\.|@[A-Za-z]|\.(?:com|net|org|co\.il)\b"
CUT_SHORT = r"\s[בלמכשהו]\z"


@dataclass(frozen=True)
class Limits:
    """What is accepted. `letters` is the class of the language's own letters."""

    letters: str = LETTER
    least_chars: int = 14
    most_chars: int = 180
    least_letters: int = 6
    other_letters: str | None = "A-Za-z"
    categories: tuple[tuple[str, str], ...] = field(default_factory=lambda: tuple(CATEGORIES))


def tidy(line: Column) -> Column:
    """No-break spaces as blanks, control characters and line separators dropped, blanks collapsed, a leading dash taken off."""
    line = F.regexp_replace(F.regexp_replace(line, "\\u00a0", " "), r"[\p{Cc}\p{Zl}\p{Zp}]", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(line, r"(?U)\s+", " "), r"^ | \z", ""), r"^[-–—]\s*", "")


def acceptable(text: Column, limits: Limits = Limits()) -> Column:
    own = F.regexp_count(text, F.lit(f"[{limits.letters}]"))
    ok = F.length(text).between(limits.least_chars, limits.most_chars) & ~text.rlike(REJECT) & ~text.rlike(CUT_SHORT) & (own >= limits.least_letters)
    return ok & (F.regexp_count(text, F.lit(f"[{limits.other_letters}]")) <= own) if limits.other_letters else ok


def categorize(text: Column, limits: Limits = Limits()) -> Column:
    """The first class whose pattern occurs; null for none."""
    return F.coalesce(*(F.when(text.rlike("(?U)" + pattern), name) for name, pattern in limits.categories))


def skeleton(text: Column, limits: Limits = Limits()) -> Column:
    """What remains equal when numbers and punctuation change."""
    own = limits.letters + ("A-Za-z" if limits.other_letters else "")
    return F.lower(F.regexp_replace(F.regexp_replace(text, r"(?U)\d+", "#"), f"[^{own}#]+", ""))


def filed(lines: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Accepted lines with a category. A lambda binds the tidied text, which would else be computed again for each pattern, and the generator keeps filters behind it."""
    looked_at = F.transform(F.array(tidy(F.col("text"))), lambda t: F.struct(t.alias("text"), F.when(acceptable(t, limits), categorize(t, limits)).alias("category")))
    kept = F.explode(F.filter(looked_at, lambda x: x["category"].isNotNull()))
    return lines.where("text IS NOT NULL").select("corpus", "corpus_order", "line_no", kept.alias("x")).select("corpus", "corpus_order", "line_no", "x.text", "x.category")


def mine(lines: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """From (corpus, corpus_order, line_no, text) to (corpus, corpus_order, line_no, text, category, skeleton).

    Of lines with one skeleton the first stays, across all corpora in their order. A minimum
    that is aggregated before the shuffle carries it, so a line that repeats everywhere is no
    hot group, and the lines are read once. Null texts are left out.
    """
    rows = filed(lines, limits).withColumn("skeleton", skeleton(F.col("text"), limits))
    first = F.min(F.struct("corpus_order", "line_no", "corpus", "text", "category")).alias("first")
    return rows.groupBy("skeleton").agg(first).select("first.*", "skeleton").select("corpus", "corpus_order", "line_no", "text", "category", "skeleton")


def sample(mined: DataFrame, target: int | dict[str, int], seed: int = 0, by_code_point: bool = False) -> DataFrame:
    """For each corpus `target` texts, or its own of a dict (none without one), in turns over its categories: the first of each, then the second, and so on.

    The draw is by a hash of the seed and the text (by the text itself where `by_code_point`),
    so it is the same on any cluster. Places within a category are bounded by target before
    the corpus's turns are put in order.
    """
    most = max(target.values(), default=0) if isinstance(target, dict) else target
    wanted = F.coalesce(lookup(target, F.col("corpus")), F.lit(0)) if isinstance(target, dict) else F.lit(target)
    draw = F.col("text") if by_code_point else F.xxhash64(F.lit(seed), "text")
    turn = F.row_number().over(Window.partitionBy("corpus", "category").orderBy(draw, "text"))
    turns = mined.select("corpus", "category", "text").distinct().withColumn("turn", turn).where(F.col("turn") <= most)
    place = F.row_number().over(Window.partitionBy("corpus").orderBy("turn", "category"))
    return turns.withColumn("place", place).where(F.col("place") <= most).where(F.col("place") <= wanted).select("corpus", "category", "text")


def category_counts(mined: DataFrame) -> DataFrame:
    return mined.groupBy("corpus", "category").agg(F.count(F.lit(1)).alias("n"))
