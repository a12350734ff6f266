"""Text that is addressed to nobody's ear: links, addresses, files, handles and names with digits stay as they are."""

from __future__ import annotations

import re
import string

from kolot.operators.scanner import PROTECT, Rule

# Patterns and file endings.
URL = r"(?:https?://|www\.)[^\s<>\"'׳״]*[^\s<>\"'׳״.,;:!?)\]]"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
EXTENSIONS = "py|js|ts|tsx|jsx|rs|go|java|rb|sh|c|cpp|h|json|toml|yaml|yml|xml|csv|tsv|md|txt|html?|css|pdf|docx?|xlsx?|pptx?|png|jpe?g|gif|svg|webp|mp3|mp4|wav|mov|zip|tar|gz"
FILE = rf"[A-Za-z0-9_\-.]+\.(?:{EXTENSIONS})\b"
HANDLE = "[#@][A-Za-z0-9_\u0590-\u05ff]+"
NAME = r"\b[A-Za-z]+-?\d+[A-Za-z0-9]*(?:-[A-Za-z0-9]+)*\b"
#: Any of these patterns has a Latin letter or one of the marks of a handle.
MARKS = string.ascii_letters + "#@"
PATTERN = "|".join(f"(?:{p})" for p in (URL, EMAIL, FILE, HANDLE, NAME))

RULES = [Rule("protect", PROTECT, re.compile(PATTERN), lambda m, cfg: m[0], needs_digit=False, needs=(MARKS,))]
