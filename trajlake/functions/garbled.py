"""Garbled-text detection as a Column: scripts, symbols, control and replacement characters by regular expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trajlake.functions.core import let

# Code point ranges of the scripts that are told apart.
SCRIPTS = {
    "Latin": r"\x{41}-\x{7A}\x{C0}-\x{2AF}\x{1E00}-\x{1EFF}",
    "CJK": r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}",
    "Hiragana": r"\x{3040}-\x{309F}",
    "Katakana": r"\x{30A0}-\x{30FF}\x{31F0}-\x{31FF}",
    "Hangul": r"\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}",
    "Cyrillic": r"\x{400}-\x{52F}\x{2DE0}-\x{2DFF}\x{A640}-\x{A69F}",
    "Arabic": r"\x{600}-\x{6FF}\x{750}-\x{77F}\x{8A0}-\x{8FF}",
    "Devanagari": r"\x{900}-\x{97F}",
    "Thai": r"\x{E00}-\x{E7F}",
    "Hebrew": r"\x{590}-\x{5FF}",
    "Greek": r"\x{370}-\x{3FF}",
}
# The detector's thresholds.
MIN_LEN, MIN_SCRIPT_CHARS, MIN_SCRIPT_SHARE, DIVERSITY = 10, 6, 0.01, 3
SYMBOLS, CONTROLS, REPLACEMENTS = 0.40, 0.02, 1
WEIRD = r"[{}\[\]()<>|\\/@`~^$*=+_]{3,}"


def garbled_facts(text: Column) -> Column:
    """struct<n, scripts, symbol_ratio, control_ratio, replacements, weird>: what the verdict rests on.

    Most texts have letters of one script and no control characters: one search for any other settles that, and only what it
    finds is counted script by script.
    """
    bare = F.regexp_replace(text, r"[\s\x{1C}-\x{1F}\x{85}\p{Z}]+", "")

    def facts(b: Column) -> Column:
        size = F.greatest(F.lit(1), F.length(b))
        count = lambda s, p: F.length(s) - F.length(F.regexp_replace(s, p, ""))
        if_any = lambda s, one, p: F.when(s.rlike(one), count(s, p)).otherwise(0)

        def by_script(letters: Column) -> Column:
            n = F.greatest(F.lit(1), F.length(letters))
            per = F.array(*[count(letters, f"[{r}]+") for r in SCRIPTS.values()])
            return F.size(F.filter(per, lambda c: (c >= MIN_SCRIPT_CHARS) & (c / n >= MIN_SCRIPT_SHARE)))

        only_latin = F.when(b.rlike(f"(?:[{SCRIPTS['Latin']}&&\\p{{L}}][^\\p{{L}}]*){{{MIN_SCRIPT_CHARS}}}"), 1).otherwise(0)
        other = b.rlike(f"[\\p{{L}}&&[^{SCRIPTS['Latin']}]]")
        return F.struct(
            F.length(text).alias("n"), F.when(other, let(F.regexp_replace(b, r"\P{L}+", ""), by_script)).otherwise(only_latin).alias("scripts"),
            (count(b, r"[\p{S}\p{P}]+") / size).alias("symbol_ratio"), (if_any(b, r"\p{C}", r"\p{C}+") / size).alias("control_ratio"),
            F.when(F.contains(text, F.lit("�")), count(text, "�")).otherwise(0).alias("replacements"), (if_any(text, WEIRD, WEIRD) / size).alias("weird"))

    return let(bare, facts)


def is_garbled(text: Column) -> Column:
    """A strong sign, and either a combination of weak ones or three scripts; texts under MIN_LEN characters never are."""

    def verdict(f: Column) -> Column:
        strong = (f["replacements"] >= REPLACEMENTS) | (f["control_ratio"] >= CONTROLS) | (f["scripts"] >= DIVERSITY) | (f["symbol_ratio"] >= SYMBOLS)
        weak = ((f["scripts"] >= 2) & ((f["symbol_ratio"] >= 0.22) | (f["weird"] >= 0.08))) | ((f["symbol_ratio"] >= 0.35) & (f["weird"] >= 0.10))
        return (f["n"] >= MIN_LEN) & strong & (weak | (f["scripts"] >= DIVERSITY))

    return let(garbled_facts(text), verdict)
