"""Readings of single texts: fixed values, settings, and the scan with toy rules."""

import os
import re
import unicodedata
from dataclasses import replace
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kolot.config import Clock, Config, ConfigError
from kolot.operators import passes, spoken
from kolot.operators.normalize import normalize_text, ordered
from kolot.operators.scanner import HAS_DIGIT, Rule, scan, spans

# Texts, readings, settings.
READINGS = [
    ("3 הילדים", "שלושת הילדים", ""),
    ("1 ילד ו-2 ילדות", "ילד אחד ושתי ילדות", ""),
    ("1% ו-2% ו-3%", "אחוז אחד ושני אחוזים ושלושה אחוזים", ""),
    ("14:30", "ארבע עשרה שלושים", "clock=24"),
    ("14:45", "רבע לשלוש אחר הצהריים", "clock=12"),
    ("00:00", "חצות", ""),
    ("9:05", "תשע אפס חמש", "clock=24"),
    ("03/04/2026", "ארבעה במרץ אלפיים עשרים ושש", "date_order=mdy"),
    ("25/12/2026", "עשרים וחמישה בדצמבר אלפיים עשרים ושש", "date_order=mdy"),
    ("00/05/2026", "00/05/2026", ""),
    ("2026-03-01", "הראשון במרץ אלפיים עשרים ושש", ""),
    ("25.05 ₪", "עשרים וחמישה שקלים וחמש אגורות", ""),
    ("ו-25₪", "ועשרים וחמישה שקלים", ""),
    ("$2", "שני דולרים", ""),
    ("3 ק״מ", "שלוש ק״מ", "expand_units=false"),
    ("2.5 ק״מ", "שתיים נקודה חמש קילומטר", ""),
    ("38.5°", "שלושים ושמונה נקודה חמש מעלות", ""),
    ("3-5 ק״מ", "שלושה עד חמישה קילומטרים", ""),
    ("ט״ו בשבט", "טו בשבט", "hebrew_date_style=numbers"),
    ("כ״ז באלול", "עשרים ושבעה באלול", "hebrew_date_style=numbers"),
    ("ד״ר כהן", "דוקטור כהן", ""),
    ("ד״ר כהן", "ד״ר כהן", "expand_abbreviations=false"),
    ("צה״ל", "צהל", "expand_abbreviations=false"),
    ("050-1234567", "אפס חמש אפס אחת שתיים שלוש ארבע חמש שש שבע", ""),
    ("1,234", "אלף מאתיים שלושים וארבע", ""),
    ("ה-3", "השלישי", ""),
    ("GPT-4", "GPT-4", ""),
    ("בקרו ב-https://x.il/12/03/2026", "בקרו ב-https://x.il/12/03/2026", ""),
    ("**חשוב** `קוד`", "חשוב קוד", ""),
    ("", "", ""),
]


@pytest.mark.parametrize(("text", "want", "spec"), READINGS)
def test_readings(text, want, spec):
    cfg = Config.from_spec(spec)
    assert normalize_text(text, cfg) == want
    assert normalize_text(want, cfg) == want


@pytest.mark.skipif("GOLDEN_DIR" not in os.environ, reason="set GOLDEN_DIR to a folder of golden TSV files")
def test_golden_files():
    wrong = []
    for path in sorted(Path(os.environ["GOLDEN_DIR"]).glob("*.tsv")):
        rows = [line.rstrip("\r") for line in path.read_text("utf-8").split("\n") if line.strip() and not line.startswith("#")]
        for row in rows[1:]:
            text, want, spec, *_ = [*map(str.strip, row.split("\t")), "", ""]
            cfg = Config.from_spec(spec)
            if normalize_text(text, cfg) != want or normalize_text(want, cfg) != want:
                wrong.append((path.name, text))
    assert not wrong


def test_numbers_at_the_edges():
    assert spoken.cardinal(0) == "אפס"
    assert spoken.cardinal(-(2**63)).startswith("מינוס תשעה מיליארד")
    assert spoken.cardinal(2_000_000_000) == "שני מיליארד"
    assert spoken.whole("9223372036854775808") is None
    assert spoken.whole("٣") is None
    assert normalize_text("99999999999999999999") == "99999999999999999999"
    assert normalize_text("٣ ילדים") == "٣ ילדים"


def test_settings_are_strict():
    assert Config.from_json(" ") == Config()
    assert Config.from_json('{"clock": "24"}').clock == Clock.H24
    assert Config.from_json(Config.from_spec("gender_overrides=כיסא:f").to_json()).gender_overrides["כיסא"].value == "f"
    for bad in ('{"clokc": "24"}', '{"clock": "25"}', "[]", "{", '{"expand_units": "yes"}'):
        with pytest.raises(ConfigError):
            Config.from_json(bad)
    for bad in ("clock=25", "clock=12;clock=24", "what=1", "expand_units=perhaps", "clock"):
        with pytest.raises(ConfigError):
            Config.from_spec(bad)


def toy(name, priority, pattern, out="", needs_digit=False):
    return Rule(name, priority, re.compile(pattern), lambda m, cfg: (out(m) if callable(out) else out), needs_digit)


def test_scan_order():
    low, high = toy("low", 1, r"a+b", "L"), toy("high", 2, r"a", "H")
    assert scan("aab", [low, high], Config()) == scan("aab", [high, low], Config()) == "HHb"
    assert scan("ab", [toy("short", 1, "a", "S"), toy("long", 1, "ab", "B")], Config()) == "B"
    declines = toy("no", 2, r"\d+", lambda m: None)
    assert scan("25", [declines, toy("five", 1, "5", "V")], Config()) == "2V"
    offered = []
    list(spans("25", [declines], Config(), offered.append))
    assert [s.matched for s in offered] == ["25", "5"]
    assert scan("xaa", [toy("behind", 1, "(?<=x)a", "y")], Config()) == "xya"
    assert scan("a", [toy("twice", 1, "a", "aa")], Config()) == "aa"
    assert scan("ba", [toy("empty", 2, "(?=a)", "!"), toy("a", 1, "a", "A")], Config()) == "bA"
    assert scan("ab", [toy("gated", 1, "a", "X", needs_digit=True)], Config()) == "ab"
    assert scan("ab1", [toy("gated", 1, "a", "X", needs_digit=True)], Config()) == "Xb1"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="אבהוכ 0123456789.,:/-%₪״׳'\"\n*_`#|>[]()\\abc", max_size=60))
def test_readings_settle(text):
    """A second reading changes nothing, but for blank lines and Markdown that the first one made visible."""
    cfg = Config(strip_markdown=False)
    once = normalize_text(text, cfg)
    assert isinstance(once, str)
    assert passes.finalize(once, Config(clean_whitespace=False)) == once


def test_markdown():
    text = "# כותרת ##\n- פריט\n1. שני\n| א | ב |\n|---|---|\n> ציטוט\n***\n```py\nx\n```\n\\*לא\\*"
    assert passes.strip_markdown(text) == "כותרת\nפריט.\nשני.\nא, ב.\n\nציטוט\n\nלא"


def test_own_rule():
    rule = toy("shrug", 30, r":\)", "חיוך")
    assert normalize_text("טוב :)", extra_rules=[rule]) == "טוב חיוך"


PIECES = ["פי", "ה-", "וב-", "ב", "ילדים", "ינואר", "בערב", "אחוז", "פרומיל", "₪", "$", "שטרלינג", "מיליון", "%", "‰", "°", "c", "ק״מ", "m", "km/h", "צה״ל", "ג׳", "ט״ו", "בשבט", "GPT-4", "x@y.il", "#א", "www.a.b", "*", "+972", "ת״ז", "חייגו", "0", "1", "5", "07", "10", "2024", "123456789", "٣", ",", ".", ":", "/", "-", "–", "־", " ", "\t", " ", "\n", "'", '"']


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=12).map("".join))
def test_rules_that_are_left_out_have_no_match(text):
    """Characters and length tell which rules can match; trying all of them gives the same spans."""
    rules = ordered()
    live = rules.live(text)
    tried = [replace(r, needs=(), least=0) for r in rules]
    assert list(spans(text, rules, Config())) == list(spans(text, tried, Config()))
    assert not [r.name for r in rules if r not in live and HAS_DIGIT.search(text) and r.pattern.search(text)]


def test_rules_tried():
    """A bare number is searched for by the few rules that could read it."""
    assert {r.name for r in ordered().live("777")} == {"number"}
    texts = ["3 במאי", "3 בערב", "5 %", "5 פרומיל", "5 שטרלינג", "$5", "5 ק״מ", "5°", "3-5", "3-5 ימים", "1/2024", "1.1.24", "2024-01-01", "10:30", "+97221234567", "021234567", "1800123456", "*123", "1234-123456-12345", "1.1.1.1", "ת״ז 123456789", "חייגו 100", "צה״ל", "ט״ו בשבט", "ה-3", "ב-3", "3 ילדים", "7", "a.py"]
    names = {s.rule for t in texts for s in spans(t, ordered(), Config())}
    assert names == {r.name for r in ordered()}


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([*PIECES, "  ", " ,", "a", "# ", "> ", "- ", "1. ", "٣) ", "---", "- - -", "|", "`", "~~", "[a](b)", "\\*", "", " ", "​"]), max_size=10).map("".join))
def test_passes_that_are_left_out_change_nothing(text):
    cfg = Config()
    seen = passes.replaced(passes._odd.sub(" ", passes._invisible.sub("", unicodedata.normalize("NFC", text))), passes.QUOTES)
    assert passes.clean(text, cfg) == passes.strip_markdown(seen)
    quoted = passes.replaced(text, passes.QUOTES)
    assert passes.finalize(text, cfg) == passes.trimmed("\n".join(map(passes.trimmed, passes.replaced(quoted, passes.SPACING).split("\n"))))
