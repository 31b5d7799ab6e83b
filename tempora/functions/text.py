"""Text functions: native regular expressions; Arrow functions where Unicode normalisation or similarity is needed."""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempora.functions.columns import let

#: Inside text, a highlight is kept as two characters of the private use area while words are cleaned.
ON, OFF = "", ""
# Highlight tags, with stray slashes and spaces.
TAG_OPEN, TAG_CLOSE, OLD_OPEN, OLD_CLOSE = r"(?i)<\s*hl\s*>", r"(?i)<\s*[\\/]\s*hl\s*>", r"(?i)<\s*h1\s*>", r"(?i)<\s*/\s*h1\s*>"
PUNCTUATION = r"[.,!?:;\-—–()\[\]\"'«»…]+"
EMOJI = r"[\x{1F300}-\x{1F6FF}\x{1F900}-\x{1F9FF}\x{1FA70}-\x{1FAFF}\x{2702}-\x{27B0}\x{1F1E6}-\x{1F1FF}]"


def collapse(c: Column) -> Column:
    """Runs of white space to one space, trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def humanise(c: Column) -> Column:
    return collapse(F.replace(F.coalesce(c, F.lit("")), F.lit("_"), F.lit(" ")))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"[\p{L}\p{N}_]+"))


def one_tag_form(c: Column) -> Column:
    """Old and sloppy highlight tags to <hl> and </hl>."""
    c = F.regexp_replace(F.regexp_replace(c, OLD_OPEN, "<hl>"), OLD_CLOSE, "</hl>")
    return F.regexp_replace(F.regexp_replace(c, TAG_CLOSE, "</hl>"), TAG_OPEN, "<hl>")


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(one_tag_form(c), TAG_OPEN, ""), TAG_CLOSE, "")


def caps(c: Column) -> Column:
    """Upper case without punctuation; paired highlights stay as they are, an unpaired tag is text like any other."""
    paired = F.regexp_replace(c, r"(?is)<\s*hl\s*>(.*?)<\s*[\\/]\s*hl\s*>", f"{ON}$1{OFF}")
    bare = F.upper(F.regexp_replace(paired, PUNCTUATION, ""))
    return collapse(F.replace(F.replace(bare, F.lit(ON), F.lit("<hl>")), F.lit(OFF), F.lit("</hl>")))


def subtitle(c: Column) -> Column:
    """A subtitle as it is shown: one form of tags, no underscores, capitals, no punctuation. Null is empty."""
    return caps(collapse(F.replace(one_tag_form(F.coalesce(c, F.lit(""))), F.lit("_"), F.lit(" "))))


def sanitised(segments: Column) -> tuple[Column, Column]:
    """A transcript's segments (structs with text and words, structs with word) as subtitles are shown, and the text they make together.

    Words that nothing is left of go; a segment without words has null for them. Other fields stay.
    """

    def shown(segment):
        words = F.transform(segment["words"], lambda w: w.withField("word", F.replace(subtitle(w["word"]), F.lit(" "), F.lit(""))))
        kept = F.filter(words, lambda w: w["word"] != "")
        return segment.withField("text", subtitle(segment["text"])).withField("words", F.when(F.size(kept) > 0, kept))

    out = F.transform(segments, shown)
    lines = F.filter(F.transform(out, lambda s: F.trim(s["text"])), lambda t: t != "")
    return out, F.trim(F.array_join(lines, " "))


def tokens(c: Column) -> Column:
    """Words, with highlight tags as words of their own."""
    apart = F.regexp_replace(c, r"(?i)(<\s*[\\/]?\s*hl\s*>)", " $1 ")
    return F.regexp_extract_all(apart, F.lit(r"(?i)(<\s*[\\/]?\s*hl\s*>|\S+)"), F.lit(1))


def timed_tokens(words: Column, start: Column, end: Column) -> Column:
    """Words spread evenly over [start, end): array of (word, start, end)."""
    size = F.greatest(end - start, F.lit(0.01))

    def spread(ws):
        step = size / F.size(ws)
        return F.transform(ws, lambda w, i: F.struct(w.alias("word"), (start + i * step).alias("start"), F.least(end, start + i * step + step).alias("end")))

    return let(words, spread)


def is_tag(word: Column, pattern: str) -> Column:
    return word.rlike("^" + pattern.replace("(?i)", "(?i:") + ")")


def chunks(words: Column, size: int) -> Column:
    """Subtitle chunks of ``size`` words from timed words (word, start, end), highlights kept: array of (text, start, end).

    Tag words switch the highlight and are not counted; neighbours of one state share a pair of tags.
    """
    size = max(int(size), 1)
    item = "array<struct<word:string,on:boolean,start:double,end:double>>"
    begin = F.struct(F.lit(False).alias("on"), F.array().cast(item).alias("words"))
    row = lambda w, on: F.struct(F.trim(w["word"]).alias("word"), on.alias("on"), w["start"].cast("double").alias("start"), w["end"].cast("double").alias("end"))
    opens, closes = (lambda w: is_tag(F.trim(w["word"]), TAG_OPEN)), (lambda w: is_tag(F.trim(w["word"]), TAG_CLOSE))

    def read(acc, w):
        more = F.when(opens(w) | closes(w), acc["words"]).otherwise(F.concat(acc["words"], F.array(row(w, acc["on"]))))
        return F.struct(F.when(opens(w), True).when(closes(w), False).otherwise(acc["on"]).alias("on"), more.alias("words"))

    def joined(part):
        def join(acc, w):
            same = acc["on"] == w["on"]
            gap = F.when(acc["text"] == "", "").otherwise(" ")
            text = F.concat(acc["text"], F.when(acc["on"] & ~same, "</hl>").otherwise(""), gap, F.when(w["on"] & ~same, "<hl>").otherwise(""), w["word"])
            return F.struct(w["on"].alias("on"), text.alias("text"))

        marked = F.aggregate(part, F.struct(F.lit(False).alias("on"), F.lit("").alias("text")), join, lambda acc: F.concat(acc["text"], F.when(acc["on"], "</hl>").otherwise("")))
        return F.when(F.exists(part, lambda w: w["on"]), marked).otherwise(F.array_join(F.transform(part, lambda w: w["word"]), " "))

    def cut(plain):
        n = F.ceil(F.size(plain) / size).cast("int")
        parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(plain, i * size + 1, size))
        done = F.transform(parts, lambda p: F.struct(joined(p).alias("text"), F.element_at(p, 1)["start"].alias("start"), F.element_at(p, -1)["end"].alias("end")))
        return F.when(n > 0, done).otherwise(F.array().cast("array<struct<text:string,start:double,end:double>>"))

    def read_all(ws):
        # the fold over tags is needed, and paid for, only where there are tags
        tagged = F.aggregate(ws, begin, read, lambda acc: acc["words"])
        return let(F.when(F.exists(ws, lambda w: opens(w) | closes(w)), tagged).otherwise(F.transform(ws, lambda w: row(w, F.lit(False)))), cut)

    return let(F.filter(words, lambda w: F.coalesce(F.trim(w["word"]), F.lit("")) != ""), read_all)


def wrap_words(c: Column, per_line: int | None) -> Column:
    """Lines of at most ``per_line`` words."""
    if not per_line or per_line <= 0:
        return F.coalesce(c, F.lit(""))
    words = F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda w: w != "")
    n = F.ceil(F.size(words) / per_line).cast("int")
    lines = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(words, i * per_line + 1, per_line), " "))
    return F.when(n > 0, F.array_join(lines, "\n")).otherwise(F.coalesce(c, F.lit("")))


def title_of(c: Column, fallback: str | Column = "", words: int = 6, most: int = 45) -> Column:
    """A title from a sentence: no punctuation but hyphens, its first words in capitals; else the fallback."""
    fallback = fallback if isinstance(fallback, Column) else F.lit(fallback)
    bare = collapse(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)[^\w\s\-]", ""))
    title = F.trim(F.left(F.upper(F.array_join(F.slice(F.split(bare, " "), 1, words), " ")), F.lit(most)))
    return F.when(title != "", title).otherwise(fallback)


def show_name(c: Column, fallback: str) -> Column:
    """A readable name from a file stem: no quality suffix, no punctuation."""
    bare = F.regexp_replace(c, r"(?iU)(?:\s*[-_]?\s*)?(\d{3,4}p)(?![^\W_])", "")
    name = humanise(F.regexp_replace(bare, r"(?U)[^\w]+", " "))
    return F.when(name != "", name).otherwise(F.lit(fallback))


def clip_title(c: Column, fallback: Column) -> Column:
    """A caption from a title; placeholders such as ``moment_3`` and empty ones give way to the fallback."""
    title, other = humanise(c), humanise(fallback)
    return F.when((title == "") | title.rlike(r"(?i)^moment[\s_]*\d+$"), other).otherwise(title)


def html_escape(c: Column) -> Column:
    # The five entities.
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def message(titles: Column, name: Column, *, untitled: str = "Без названия", label: str = "<b>Название аниме:</b>") -> Column:
    """Escaped titles, a blank line apart, and the name below."""
    some = F.filter(F.coalesce(titles, F.array().cast("array<string>")), lambda t: F.coalesce(t, F.lit("")) != "")
    some = F.when(F.size(some) > 0, some).otherwise(F.array(F.lit(untitled)))
    return F.concat(F.array_join(F.transform(some, lambda t: html_escape(F.trim(t))), "\n\n"), F.lit(f"\n\n{label} "), html_escape(name))


def episode_range(c: Column) -> Column:
    """``1-3,7`` to sorted distinct numbers; a reversed range raises."""
    parts = F.filter(F.split(F.replace(c, F.lit(" "), F.lit("")), ","), lambda p: p != "")

    def numbers(p):
        a, b = F.split(p, "-", 2)[0].cast("int"), F.coalesce(F.get(F.split(p, "-", 2), 1), F.split(p, "-", 2)[0]).cast("int")
        return F.when(b < a, F.raise_error(F.lit("reversed range"))).otherwise(F.sequence(a, b))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, numbers))))


def quality(c: Column) -> Column:
    """``720p`` to 720; null for what is no number."""
    return F.rtrim(c.cast("string"), F.lit("pP")).try_cast("int")


def episode_file_name(title: Column, episode: Column, voice: Column, max_quality: Column) -> Column:
    """Name of a downloaded episode's file; without a quality it is ``auto``."""
    part = F.when(max_quality.isNotNull() & (max_quality != 0), F.concat(max_quality.cast("string"), F.lit("p"))).otherwise(F.lit("auto"))
    return F.concat(file_stem(F.concat_ws(" - ", title, F.concat(F.lit("Серия "), episode.cast("string")), voice, part)), F.lit(".mp4"))


@F.pandas_udf(T.StringType())
def safe_filename(names: pd.Series) -> pd.Series:
    """Decomposed, with forbidden characters and spaces as single underscores, at most 150 characters."""

    def one(n):
        n = re.sub(r'[<>:"/\\|?*«»\s_]+', "_", unicodedata.normalize("NFKD", n))
        return n.strip("._")[:150]

    return names.map(one, na_action="ignore")


@F.pandas_udf(T.StringType())
def file_stem(names: pd.Series) -> pd.Series:
    """Composed, letters and digits with spaces as underscores; path characters become hyphens; ``episode`` if nothing is left."""

    def one(n):
        kept = ("-" if c in '/\\:*?"<>|' else c for c in unicodedata.normalize("NFKC", n) if c.isalnum() or c in ' -_/\\:*?"<>|')
        return "_".join("".join(kept).split()) or "episode"

    return names.map(one, na_action="ignore")


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching blocks of two texts, without regard to case; a null counts as empty."""
    low = lambda x: "" if x is None else x.lower()
    return pd.Series([SequenceMatcher(None, low(x), low(y)).ratio() for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("highlighted", T.BooleanType())])))
def spans(texts: pd.Series) -> pd.Series:
    """Spans of a text in order, with whether they are highlighted; tags without a partner are dropped."""
    tag = re.compile(r"<\s*([\\/]?)\s*h[l1]\s*>", re.I)

    def one(text):
        plain, out, at = "", [], 0
        text = tag.sub(lambda m: "</hl>" if m.group(1) else "<hl>", text or "")
        while (a := text.find("<hl>", at)) >= 0 and (b := text.find("</hl>", a)) >= 0:
            plain = text[at:a].replace("</hl>", "")
            inside = text[a + 4 : b]
            out += [{"text": plain, "highlighted": False}] * bool(plain) + [{"text": inside, "highlighted": True}] * bool(inside)
            at = b + 5
        rest = text[at:].replace("<hl>", "").replace("</hl>", "")
        return out + [{"text": rest, "highlighted": False}] * bool(rest)

    return texts.map(one)


def span_tokens(s: Column) -> Column:
    """Words of spans, each with the white space after it."""
    words = lambda x: F.transform(F.regexp_extract_all(x["text"], F.lit(r"(?U)(\S+\s*)"), F.lit(1)), lambda w: F.struct(w.alias("text"), x["highlighted"].alias("highlighted")))
    return F.flatten(F.transform(s, words))


def has_emoji(c: Column) -> Column:
    return c.rlike(EMOJI)
