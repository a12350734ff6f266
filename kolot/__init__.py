"""Written Hebrew as it is spoken, over Spark columns.

functions: verbalisers and text passes as Column expressions; operators: the rule scanner
and its rules; plans: the mining pipeline and quality metrics; sources: readers and writers;
streaming: the same transforms on streams. `kolot.llm` stands alone.
"""

from kolot.config import Clock, Config, ConfigError, DateOrder, Gender, HebrewDateStyle, NormalizerError

__version__ = "0.2.0"
__all__ = ["Clock", "Config", "ConfigError", "DateOrder", "Gender", "HebrewDateStyle", "NormalizerError", "normalize", "version"]


def normalize(text: str, cfg: Config | None = None) -> str:
    """One text as it is said; `kolot.operators.normalize.normalize` does the same over columns."""
    from kolot.operators.normalize import normalize_text

    return normalize_text(text, cfg or Config())


def version() -> str:
    return __version__
