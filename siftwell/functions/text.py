"""Text functions as column expressions: lines, words, identifiers, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A boundary inside an identifier: lower to upper case, letters to other characters
# and back, and before the last capital of a run that a lower-case letter follows.
CAMEL = r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{IsAlphabetic})(?=\P{IsAlphabetic})|(?<=\P{IsAlphabetic})(?=\p{IsAlphabetic})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})"
WORD_GAP = r"[^\p{IsAlphabetic}\p{N}_]+"
WORD_CHAR = r"[\p{IsAlphabetic}\p{N}_]"


def lines(text: Column) -> Column:
    """Array of lines; they end in LF or CRLF, and a last line end opens no line.
    Empty text has none, null stays null."""
    body = F.regexp_replace(text, r"\r?\n\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, r"\r?\n"))


def explode_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``text`` replaced by (line, content), line numbers from 1."""
    rest = [c for c in df.columns if c != text]
    return df.select(*rest, F.posexplode(lines(F.col(text))).alias("line", "content")).withColumn("line", F.col("line") + 1)


def trim(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def words(text: Column) -> Column:
    """Runs of letters, numerals and ``_``, in order."""
    return F.filter(F.split(text, WORD_GAP), lambda w: w != "")


def parts(word: Column) -> Column:
    """Parts of an identifier, cut at ``_`` and by :data:`CAMEL`; lower case,
    without parts of one character or of ASCII digits only."""
    cut = F.flatten(F.transform(F.split(word, "_"), lambda p: F.split(p, CAMEL)))
    return F.transform(F.filter(cut, lambda p: (F.char_length(p) >= 2) & ~p.rlike(r"^[0-9]+$")), F.lower)


def terms(text: Column, stop: list[str] | None = None) -> Column:
    """Index terms before stemming: the parts of each word, and the whole word
    in lower case after them where it has more than one. ``stop`` leaves out
    such parts. Repeats stay: they are term frequencies."""

    def of(word: Column) -> Column:
        p = parts(word)
        if stop:
            p = F.filter(p, lambda x: ~x.isin(*stop))
        return F.when(F.size(p) > 1, F.concat(p, F.array(F.lower(word)))).otherwise(p)

    return F.flatten(F.transform(words(text), of))


def plain_words(text: Column) -> Column:
    """Lower-case words of two characters or more, whole and unstemmed."""
    return F.filter(F.transform(words(text), F.lower), lambda w: F.char_length(w) >= 2)


def hyphenated(text: Column) -> Column:
    """Style-sheet names in a query: words with a ``-`` of letters, numerals,
    ``-``, ``_`` and ``$`` once leading ``.#%`` and trailing ``,:;{`` are off."""
    bare = F.transform(F.split(text, r"(?U)\s+"), lambda w: F.regexp_replace(w, r"^[.#%]+|[,:;{]+$", ""))
    return F.filter(bare, lambda w: w.contains("-") & w.rlike(r"^[\p{IsAlphabetic}\p{N}\-_$]+$"))


def identifier_words(text: Column) -> Column:
    """Words of a query that may name a declaration: of three characters or
    more, and the only such word, or with ``_``, or with a capital inside."""
    long = F.filter(words(text), lambda w: F.char_length(w) >= 3)
    named = F.filter(long, lambda w: (F.size(long) == 1) | w.contains("_") | w.rlike(r"^.\P{Lu}*\p{Lu}"))
    return F.concat(F.transform(named, F.lower), F.transform(hyphenated(text), F.lower))


def whole_word(content: Column, word: str) -> Column:
    """Whether ``word`` occurs with no letter, numeral or ``_`` beside it."""
    return content.rlike(rf"(?<!{WORD_CHAR})\Q{word}\E(?!{WORD_CHAR})")


def quoted(content: Column, text: str) -> Column:
    """Whether ``text`` occurs directly after or before a quote mark."""
    return content.rlike(rf"[\"'`]\Q{text}\E|\Q{text}\E[\"'`]")


def comment_line(content: Column) -> Column:
    """Whether a line is a comment of a common language; ``#[``, ``#!``,
    ``#include`` and ``#define`` open none."""
    return trim(content).rlike(r"^(?://|/\*|--|\*(?: |$)|#(?!\[|!|include|define))")


def clip(content: Column, n: int = 160) -> Column:
    """At most ``n`` characters, then an ellipsis."""
    return F.when(F.char_length(content) > n, F.concat(F.substring(content, 1, n), F.lit("…"))).otherwise(content)


def path_tail_terms(path: Column) -> Column:
    """Sorted distinct terms of the last two components of a path."""
    p = F.split(path, "/")
    tail = F.when(F.size(p) > 2, F.slice(p, -2, 2)).otherwise(p)
    return F.array_sort(F.array_distinct(terms(F.array_join(tail, "/"))))


def trigrams(name: Column) -> Column:
    """Trigrams of a name padded with a space on both sides."""
    padded = F.concat(F.lit(" "), name, F.lit(" "))
    return F.when(F.char_length(padded) >= 3, F.transform(F.sequence(F.lit(1), F.char_length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))
