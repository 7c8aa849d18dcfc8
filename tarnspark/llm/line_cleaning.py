"""Line-first cleaning: rules judge each line, failing lines go, then documents that lost too much text go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import WORD, WORD_GAP, table, unused

#: Phrases that mark a line as boilerplate.
BOILERPLATE = (
    "accept all cookies",
    "all rights reserved",
    "back to top",
    "click here",
    "cookie policy",
    "enable javascript",
    "lorem ipsum",
    "privacy policy",
    "read more",
    "share this",
    "sign up for our newsletter",
    "skip to content",
    "subscribe to our newsletter",
    "terms of service",
    "terms of use",
    "this site uses cookies",
    "we use cookies",
)

#: A line made of these words alone is navigation.
NAVIGATION = ("about", "blog", "cart", "contact", "faq", "help", "home", "login", "logout", "menu", "next", "news", "previous", "prev", "register", "search", "shop", "sitemap")

SYMBOLS = "#*$%&|<>"


def _of(value: Column, then) -> Column:
    """then(value) with value computed once for each row, even where then uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _without(text: Column, chars: str) -> Column:
    """Length of the text without these characters; chars is the inside of a regular expression's brackets."""
    return F.length(F.regexp_replace(text, f"[{chars}]+", ""))


def _cover(at: Column) -> Column:
    """How many positions the 5-word windows cover that start at the ascending positions `at`."""
    step = F.transform(at, lambda p, k: F.when(k + 1 < F.size(at), F.least(F.lit(5), F.get(at, k + 1) - p)).otherwise(5))
    return F.aggregate(step, F.lit(0).cast("bigint"), lambda a, x: a + x)


def _repeat_words(words: Column) -> Column:
    """Words in 5-word windows that a list of words holds twice or more. Windows are compared by a 64-bit hash."""

    def next_to(h: Column, other: Column, far: int) -> Column:
        """The hash of each h joined with that of the item of `other` that is `far` on, as far as `other` goes."""
        n = F.size(other) - far
        return F.zip_with(F.slice(h, F.lit(1), n), F.slice(other, F.lit(far + 1), n), lambda x, y: F.xxhash64(x, y))

    def found(h: Column) -> Column:
        windows = F.transform(h, lambda x, k: F.struct(x.alias("h"), k.alias("p")))
        twice = _of(F.sort_array(windows), lambda s: F.filter(s, lambda x, k: (x.h == F.get(s, k - 1).h) | (x.h == F.get(s, k + 1).h)))
        return _of(F.sort_array(F.transform(twice, lambda x: x.p)), _cover)

    def windows(m: Column) -> Column:
        return _of(_of(next_to(m, m, 1), lambda two: next_to(two, two, 2)), lambda four: next_to(four, m, 4))

    none = F.lit(0).cast("bigint")
    some = _of(_of(F.transform(words, lambda w: F.xxhash64(w)), windows), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), found(h)).otherwise(none))
    return F.when(F.size(words) > 5, some).otherwise(none)


def _is_menu(trimmed: Column) -> Column:
    """Whether the words are three items or more of one to three words, parted by words that are | or > or » alone.

    Goes word by word, as regular expressions can't repeat so long a group: four for each separator so far (two at most
    are counted), and one for each word of the item at hand; -1 once it fails.
    """

    def step(s: Column, w: Column) -> Column:
        place = s % 4
        then = F.when(w.isin("|", ">", "»"), F.least(s - place + 4, F.lit(8))).when((place == 3) | w.rlike("[|>»]"), -1).otherwise(s + 1)
        return F.when((s < 0) | (w == ""), -1).when(place == 0, s + 1).otherwise(then)

    return F.aggregate(F.split(F.regexp_replace(trimmed, r"\r\z", ""), f"{WORD_GAP}+"), F.lit(0), step) > 8


def _all_navigation(low: Column) -> Column:
    return F.forall(F.split(F.regexp_replace(low, rf"{WORD_GAP}+\z", ""), f"{WORD_GAP}+"), lambda w: w.isin(*NAVIGATION))


def _fails(line: Column, marked: Column, symbols: Column, phrases: Column, max_symbols: float, min_fragment: int) -> Column:
    """marked, symbols, phrases: whether the document holds any item mark, symbol or phrase at all; if not, that rule is not looked at."""
    trimmed = F.btrim(line)
    too_many = symbols & (F.length(line) - _without(line, SYMBOLS) > max_symbols * _without(line, WORD_GAP[1:-1]))
    fragment = ~line.rlike(r"[.!?;:,…。！？\"'”’)\]]") & ~trimmed.rlike(rf"(?:{WORD}{WORD_GAP}+){{{min_fragment - 1}}}{WORD}")
    items = marked & line.rlike("[|>»]") & _is_menu(trimmed)
    words = F.lower(trimmed).rlike(rf"^(?:{'|'.join(NAVIGATION)})(?:{WORD_GAP}|$)") & _all_navigation(F.lower(trimmed))
    boilerplate = phrases & F.lower(line).rlike("|".join(BOILERPLATE))
    return line.rlike(r"[^\x20\x09-\x0D]") & (fragment | words | too_many | items | boilerplate)


def line_fails(line: Column, max_symbols: float = 0.1, min_fragment: int = 4) -> Column:
    """Whether a line fails a rule; a line without words never does.

    Punctuation: over max_symbols of its characters are symbols, or it has fewer than min_fragment words and no
    sentence mark in it. Navigation: three items or more of at most three words parted by | or > or », or navigation words
    alone, however many.
    Boilerplate: it holds a phrase of BOILERPLATE.
    """
    yes = F.lit(True)
    return _fails(line, yes, yes, yes, max_symbols, min_fragment)


def _good_lines(text: Column, lines: Column, max_symbols: float, min_fragment: int = 4) -> Column:
    def judged(seen: Column) -> Column:
        return F.filter(lines, lambda x: ~_fails(x, seen.marked, seen.symbols, seen.phrases, max_symbols, min_fragment))

    phrases = _of(F.lower(text), lambda low: F.exists(F.array(*map(F.lit, BOILERPLATE)), lambda p: F.contains(low, p)))
    return _of(F.struct(text.rlike("[|>»]").alias("marked"), text.rlike(f"[{SYMBOLS}]").alias("symbols"), phrases.alias("phrases")), judged)


def _judge(docs: DataFrame, into: str, text: str, min_words: int, max_repeat_percent: int, max_lost: float, max_symbols: float) -> DataFrame:
    """docs with one more column, a struct called `into`, which docs has no column like."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.regexp_extract_all(t, F.lit(WORD), F.lit(0))
    lines = F.split(t, "\n")
    counts = _of(words, lambda w: F.struct(F.size(w).cast("bigint").alias("n"), F.length(F.array_join(w, "")).cast("bigint").alias("chars"), _repeat_words(w).alias("again")))
    judged = _of(
        lines,
        lambda x: F.struct(
            F.array_join(_good_lines(t, x, max_symbols), "\n").alias("text"),
            _of(F.filter(x, lambda y: y.rlike(r"[^\x20\x09-\x0D]")), lambda y: F.size(y) - F.size(F.array_distinct(y))).cast("bigint").alias("again"),
        ),
    )
    out = docs.withColumn(into, F.struct(counts.alias("words"), judged.alias("lines")))
    made, chars = (lambda field: F.col(f"{into}.{field}")), F.col(f"{into}.words.chars")
    left = F.when(F.length(made("lines.text")) == F.length(t), chars).otherwise(_without(made("lines.text"), WORD_GAP[1:-1]))
    fields = F.struct(
        made("lines.text").alias("clean_text"),
        made("words.n").alias("n_words"),
        chars.alias("word_chars"),
        (F.length(t) - _without(t, SYMBOLS)).cast("bigint").alias("n_symbols"),
        made("lines.again").alias("n_dup_lines"),
        made("words.again").alias("n_repeat_words"),
        ((made("words.n") < min_words) | (100 * made("words.again") > max_repeat_percent * made("words.n"))).alias("base_failed"),
        F.when(chars > 0, 1 - left / chars).otherwise(0.0).alias("lost"),
    )
    out = out.withColumn(into, fields)
    return out.withColumn(into, F.col(into).withField("kept", ~made("base_failed") & (made("lost") <= max_lost)))


FIELDS = ("clean_text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost", "base_failed", "kept")


def clean_lines(
    docs: DataFrame,
    *,
    text: str = "text",
    min_words: int = 10,
    max_repeat_percent: int = 20,
    max_lost: float = 0.5,
    max_symbols: float = 0.1,
) -> DataFrame:
    """docs with the columns clean_text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost, base_failed and kept.

    Each line that fails a rule (`line_fails`) leaves clean_text; other lines stay as they are, in order. A document is
    kept if it has min_words words, no more than max_repeat_percent of them in repeated 5-word windows, and lost at most
    max_lost of its non-space characters (`lost`) with its lines.

    Row by row, without a shuffle; Spark's own expressions only. A null text counts as empty: no words, not kept.
    Repeated rows each get the same verdict. Columns of docs with these names are replaced. No rows: no rows.
    """
    into = unused(docs, "verdict")
    out = _judge(docs, into, text, min_words, max_repeat_percent, max_lost, max_symbols)
    return out.withColumns({c: F.col(f"{into}.{c}") for c in FIELDS}).drop(into)


def op10_line_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = clean_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("lost", 6).alias("lost"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass, with the lines that passed for text and their length for n_chars.

    All other columns stay as they are, whatever they are called. A null or empty text has no words and goes; a very long
    one is judged whole; a null doc_id and repeated rows are rows like others. No rows: no rows.
    """
    into = unused(docs, "verdict")
    done = _judge(docs, into, "text", 10, 20, 0.5, 0.1).filter(f"{into}.kept")
    new = {"text": F.col(f"{into}.clean_text"), "n_chars": F.length(f"{into}.clean_text").cast("bigint")}
    return done.withColumns({c: new[c.lower()] for c in docs.columns if c.lower() in new}).drop(into)
