"""Quality rules, line first.

Every line is judged by punctuation, line-end, navigation and boilerplate rules, runs of
short lines as menus; failing lines are removed, and a document that loses too much of its text is
rejected. Documents also have to pass two base rules (enough words, not
mostly repeated three-word windows).

DataFrame functions only, one pass, no shuffle: what a document needs is
computed inside its row.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearth.llm.common import LOWER, SPACE, UPPER, WORD, Masked

#: The symbol characters that the contract counts.
SYMBOLS = "#*$%&|<>"
#: Characters that count against a line.
ODD = SYMBOLS + "~^=_\\{}[]"
BARS = "|»›•"
#: What a shouting line holds at least: over 8 letters A-Z, whatever stands between them.
NINE_CAPITALS = r"[A-Z](?:[^A-Z\n]*+[A-Z]){8}"
#: Phrases of licence, cookie and site-furniture lines in English, French, German and Spanish (lower case).
BOILERPLATE = [
    "all rights reserved", "licensed under", "released under the", "this work is licensed",
    "terms of service", "terms of use", "privacy policy", "cookie policy", "use cookies", "accept cookies",
    "enable javascript", "click here", "read more", "sign up for", "subscribe to our", "share this",
    "powered by", "skip to content", "back to top",
    "tous droits réservés", "mentions légales", "politique de confidentialité", "accepter les cookies", "cliquez ici", "lire la suite", "retour en haut",
    "alle rechte vorbehalten", "allgemeine geschäftsbedingungen", "datenschutzerklärung", "cookies akzeptieren", "hier klicken", "weiterlesen", "nach oben",
    "todos los derechos reservados", "aviso legal", "política de privacidad", "aceptar cookies", "haga clic aquí", "leer más", "volver arriba",
]
#: With what a line may end: sentence and clause marks, and what closes a quotation or bracket.
ENDS = ".!?:;\u2026\"'\u00bb\u201d)]"
#: White space characters (and one) behind its last mark from which on a line breaks off.
FULL_LINE = 8
#: Words of a short line at most, and short lines in a row that are a menu.
SHORT_WORDS, MENU = 3, 4
#: Up to so many repeated hashes, windows are looked up in their list; beyond, all windows are sorted.
FEW = 64
MIN_WORDS = 50
#: Percent of words inside repeated three-word windows above which a document fails.
MAX_REPEAT = 50
#: Percent of its words that a document may lose with its failing lines.
MAX_LOST = 30


def _count(text: Column, chars: str) -> Column:
    """Occurrences of any of ``chars``."""
    return F.size(F.split(text, f"[{re.escape(chars)}]", -1)) - 1


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE + "+"), "")


def has_word(line: Column) -> Column:
    return line.rlike(WORD)


def line_fails(line: Column) -> Column:
    """Whether one line is to be removed; lines without a word never are.

    * punctuation: symbol characters are over a tenth of its non-space characters, or it has two or
      more exclamation marks and as many as a quarter of its words;
    * shouting: over 8 letters A-Z, and more of them than of a-z;
    * navigation: two or more separators (``|`` and the like), at least one per four words;
    * boilerplate: it contains one of the phrases;
    * line end: what follows its last mark (``ENDS``) is long enough for a sentence (``FULL_LINE``), so it breaks off.

    Lines in a menu (``in_menu``) fail beside these."""
    solid = F.length(F.translate(line, " \t\n\x0b\x0c\r", ""))
    words = F.length(line) - solid + 1  # near enough for the ratios, and cheap
    odd, bangs, pipes = _count(line, ODD), _count(line, "!"), _count(line, BARS)
    upper, lower = _count(line, UPPER), _count(line, LOWER)
    # The first part of each rule is the cheap one and decides for most lines.
    return (((odd > 0) & (odd * 10 > solid))
            | ((bangs >= 2) & (bangs * 4 >= words))
            | (line.rlike(NINE_CAPITALS) & (upper > 8) & (upper > lower))
            | ((pipes >= 2) & (pipes * 4 >= words))
            | F.lower(line).rlike("|".join(BOILERPLATE))
            | ((words >= FULL_LINE) & ~_ended(line) & (_gaps(_after_marks(line)) + 1 >= FULL_LINE)))


def _gaps(line: Column) -> Column:
    return F.length(line) - F.length(F.translate(line, " \t\n\x0b\x0c\r", ""))


def _after_marks(line: Column) -> Column:
    """What stands behind the last mark of ``ENDS``."""
    return F.substring_index(F.translate(line, ENDS, ENDS[0] * len(ENDS)), ENDS[0], -1)


def _ended(line: Column) -> Column:
    return F.right(F.rtrim(line, F.lit(" \t\n\x0b\x0c\r")), F.lit(1)).isin(*ENDS)


def _short(line: Column) -> Column:
    """Few words and no mark at the end, as menus, breadcrumbs and lists of links have."""
    words = rf"\A{SPACE}*(?:{WORD}{SPACE}+){{0,{SHORT_WORDS - 1}}}{WORD}{SPACE}*\z"
    return line.rlike(words) & ~_ended(line)


def in_menu(short: Column, i: Column) -> Column:
    """Whether line ``i`` is one of ``MENU`` neighbouring lines that are all short (``short``: one flag per line)."""
    def whole(first: Column) -> Column:
        return reduce(Column.__and__, [F.coalesce(F.get(short, first + k), F.lit(False)) for k in range(MENU)])
    return F.get(short, i) & F.exists(F.sequence(i - (MENU - 1), i), whole)


def _may_fail(text: Column) -> Column:
    """False only if no line of the text can fail: a cheap look at the whole text first. A
    shouting line has nine capitals; the line-end and the menu rule need a line that ends without a mark."""
    lower = F.lower(text)
    said = F.lit(False)
    for phrase in BOILERPLATE:
        said = said | F.contains(lower, F.lit(phrase))
    unended = rf"[^{re.escape(ENDS)}\x20\x09-\x0D][\x20\x09\x0B-\x0D]*+(?:\n|\z)"
    return text.rlike(f"[{re.escape(ODD + BARS)}]|![^!]*!") | text.rlike(NINE_CAPITALS) | text.rlike(unended) | said


def judge(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS, max_repeat: int = MAX_REPEAT,
          max_lost: int = MAX_LOST) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines,
    n_removed_lines, lost_words, kept and clean_text.

    * n_dup_lines: lines with a word that equal an earlier line.
    * n_repeat_words: words inside three-word windows that the text holds twice or more.
    * kept: the base rules hold, and at most ``max_lost`` percent of the words stood in removed lines.
    * clean_text: the lines that passed; equal to the text if none failed.

    A null text counts as empty: no words, base_failed, not kept, clean_text null. Repeated rows are
    judged one by one; an empty table gives an empty table. Input columns called like an output
    column are replaced."""
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lines",
           "n_removed_lines", "lost_words", "kept", "clean_text"]
    own = Masked(docs.drop(*[c for c in new if c != text]))
    df = _judged(own.df, own.name[text], min_words, max_repeat, max_lost)
    return own.back(df, {n: F.col(n) for n in new})


def _judged(df: DataFrame, text: str, min_words: int, max_repeat: int, max_lost: int) -> DataFrame:
    columns = df.columns
    t = F.coalesce(F.col(text), F.lit(""))
    # Each step is read at least twice by the next, so Catalyst keeps the arrays as columns.
    df = df.withColumns({"_rules_w": _words(t), "_rules_a": F.split(t, "\n", -1), "_rules_may": _may_fail(t)})

    def word(i: Column) -> Column:
        return F.get(F.col("_rules_w"), i)

    hashes = F.transform(F.slice(F.col("_rules_w"), 1, F.greatest(F.size("_rules_w") - 2, F.lit(0))), lambda w, i: F.xxhash64(w, word(i + 1), word(i + 2)))
    df = df.withColumns({
        "n_words": F.size("_rules_w").cast("bigint"), "_rules_h": hashes, "_rules_l": F.filter("_rules_a", has_word),
        "_rules_short": F.when(F.col("_rules_may"), F.transform("_rules_a", _short)),
    })
    # Lines that fail, by place; null where none can.
    df = df.withColumn("_rules_f", F.when(F.col("_rules_may"), F.transform(
        "_rules_a", lambda x, i: has_word(x) & (line_fails(x) | in_menu(F.col("_rules_short"), i)))))
    bad = F.filter("_rules_a", lambda x, i: F.get("_rules_f", i))
    df = df.withColumn("_rules_bad", F.when(F.col("_rules_may"), bad).otherwise(F.expr("cast(array() as array<string>)")))
    # Equal windows have equal hashes: only texts with a repeated hash are looked at word by word.
    ordered = F.sort_array("_rules_h")
    equal = F.filter(F.zip_with(ordered, F.slice(ordered, 2, F.size("_rules_h")), lambda a, b: F.when(a == b, a)), lambda x: x.isNotNull())
    df = df.withColumn("_rules_r", F.when(F.size("_rules_h") > F.size(F.array_distinct("_rules_h")), F.array_distinct(equal)).otherwise(F.expr("cast(array() as array<bigint>)")))
    places = F.sequence(F.lit(0), F.size("_rules_h") - 1)
    few = F.filter(places, lambda i: F.array_contains(F.col("_rules_r"), F.get(F.col("_rules_h"), i)))
    windows = F.transform(F.when(F.size("_rules_r") <= FEW, few).otherwise(places),
                          lambda i: F.struct(F.concat_ws(" ", word(i), word(i + 1), word(i + 2)).alias("s"), i.alias("i")))
    df = df.withColumn("_rules_s", F.when(F.size("_rules_r") > 0, F.sort_array(windows)))
    # Neighbours in sorted order with equal windows give the starts of repeated windows.
    twins = F.filter(F.zip_with("_rules_s", F.slice(F.col("_rules_s"), 2, F.size("_rules_s")),
                                lambda a, b: F.when(a["s"] == b["s"], F.array(a["i"], b["i"]))), lambda x: x.isNotNull())
    covered = F.size(F.array_distinct(F.flatten(F.transform(F.flatten(twins), lambda i: F.array(i, i + 1, i + 2)))))
    counts = {
        "n_words": F.col("n_words"),
        "word_chars": F.length(F.array_join("_rules_w", "")),
        "n_symbols": _count(t, SYMBOLS),
        "n_dup_lines": F.size("_rules_l") - F.size(F.array_distinct("_rules_l")),
        # Row ids are not negative. Being beyond the optimiser, they keep a filter on this column above it:
        # pushed below, the arrays' expressions would be evaluated in the arrays' place, once per word.
        "n_repeat_words": F.when((F.size("_rules_r") > 0) & (F.monotonically_increasing_id() >= 0), covered).otherwise(0),
        "n_lines": F.size("_rules_l"),
        "n_removed_lines": F.size("_rules_bad"),
        "lost_words": F.size(_words(F.array_join("_rules_bad", "\n"))),
    }
    df = df.withColumns({n: c.cast("bigint") for n, c in counts.items()}).select(
        *columns, *counts, "_rules_a", "_rules_f")
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat)
    clean = F.when(F.col("n_removed_lines") == 0, F.col(text)).otherwise(
        F.array_join(F.filter("_rules_a", lambda x, i: ~F.get("_rules_f", i)), "\n"))
    return (df.withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & (F.col("lost_words") * 100 <= F.col("n_words") * max_lost))
            .withColumn("clean_text", clean))


def apply_rules(docs: DataFrame, text: str = "text", **limits) -> DataFrame:
    """The documents that are kept, with their cleaned texts and ``docs``' columns only (n_chars, where
    there is one, is counted anew)."""
    own = Masked(docs)
    out = judge(own.df, own.name[text], **limits).filter("kept")
    new = {text: F.col("clean_text")}
    if "n_chars" in docs.columns and text != "n_chars":
        new["n_chars"] = F.length("clean_text").cast(docs.schema["n_chars"].dataType)
    return own.back(out, new)
