"""Lines of subtitles and sizes of titles from a table of glyph widths; no font is opened.

Both are bounded folds inside a row: greedy line breaking over the running width of tokens, and a search down a short
ladder of sizes. Nothing is shuffled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tempora.functions.columns import let
from tempora.functions.text import has_emoji, span_tokens

# The factor between sizes, and how often it is tried.
SHRINK, TRIES = 0.92, 20


@dataclass(frozen=True)
class Metrics:
    """Advances of glyphs in thousandths of the font size: by code point, and for all beyond that table."""

    advances: tuple[int, ...]
    other: int = 1000
    #: Height of a line, in thousandths of the size, and its stroke on either side in pixels.
    line: int = 1200
    stroke: int = 0

    def units(self, text: Column) -> Column:
        """Thousandths of the size that a text advances. The table holds the first code points; any other has one width."""
        table = F.lit(list(self.advances))
        one = lambda c: F.coalesce(F.get(table, F.ascii(c)), F.lit(self.other))
        return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), lambda s, c: s + one(c))

    def width(self, units: Column, size: Column | int) -> Column:
        """Whole pixels, with the stroke; nothing for no glyphs."""
        return F.when(units > 0, F.ceil(units * size / 1000).cast("int") + 2 * self.stroke).otherwise(0)


def lay_out(spans: Column, *, size: int, max_width: int, plain: Metrics, highlighted: Metrics, emoji_scale: float = 1.0) -> Column:
    """Array of lines (tokens: array of (text, highlighted), width) of a text's spans, broken greedily at ``max_width``.

    A token is a word with the white space after it, and is never broken, so one that is too wide has a line of its own. An
    emoji widens its token by ``emoji_scale``. No tokens give no lines.
    """

    def measured(t):
        w = F.when(t["highlighted"], highlighted.width(highlighted.units(t["text"]), size)).otherwise(plain.width(plain.units(t["text"]), size))
        return F.struct(t["text"].alias("text"), t["highlighted"].alias("highlighted"), F.when(has_emoji(t["text"]), F.ceil(w * emoji_scale).cast("int")).otherwise(w).alias("w"))

    kind = "struct<tokens:array<struct<text:string,highlighted:boolean>>,width:int>"
    empty = F.struct(F.array().cast(f"array<{kind}>").alias("lines"), F.lit(None).cast(kind).alias("now"))

    def put(acc, t):
        token, now = F.struct(t["text"].alias("text"), t["highlighted"].alias("highlighted")), acc["now"]
        fits = now.isNotNull() & (now["width"] + t["w"] <= max_width)
        longer = F.struct(F.concat(now["tokens"], F.array(token)).alias("tokens"), (now["width"] + t["w"]).alias("width"))
        fresh = F.struct(F.array(token).alias("tokens"), t["w"].alias("width"))
        closed = F.when(now.isNull() | fits, acc["lines"]).otherwise(F.concat(acc["lines"], F.array(now)))
        return F.struct(closed.alias("lines"), F.when(fits, longer).otherwise(fresh).alias("now"))

    done = lambda acc: F.when(acc["now"].isNull(), acc["lines"]).otherwise(F.concat(acc["lines"], F.array(acc["now"])))
    return F.aggregate(F.transform(span_tokens(spans), measured), empty, put, done)


def line_height(spans: Column, *, size: int, plain: Metrics, highlighted: Metrics, emoji_scale: float = 1.0) -> Column:
    """Pixels from one line to the next: the higher of both fonts, with room for emojis if there are any, and two more; 0 without a token."""
    tokens = span_tokens(spans)
    tall = max(math.ceil(m.line * size / 1000) + 2 * m.stroke for m in (plain, highlighted))
    grown = int(tall * max(1.0, emoji_scale))
    return F.when(F.size(tokens) == 0, 0).when(F.exists(tokens, lambda t: has_emoji(t["text"])), grown + 2).otherwise(tall + 2)


def ladder(size: int, least: int) -> list[int]:
    """The sizes that are tried, and the one that is left when none fits."""
    least, out = max(1, int(least)), [max(1, int(size))]
    if out[0] < least:
        return out
    for _ in range(TRIES):
        out.append(max(least, math.floor(out[-1] * SHRINK)))
    return out


def fit_title(lines: Column, *, size: int, least: int, max_width: int, max_height: int | None, metrics: Metrics) -> Column:
    """Struct (size, tries, fits) of a title of ``lines`` (array of texts): the first size of the ladder at which it fits its box.

    Widths grow with the size, so only the widest line is measured, once, in thousandths. If nothing fits, the last size is
    taken after all tries; a size below the least one is not tried at all.
    """
    sizes = ladder(size, least)
    tries = sizes[:-1] if len(sizes) > 1 else []
    steps = F.array(*[F.struct(F.lit(s).alias("size"), F.lit(i + 1).alias("tries")) for i, s in enumerate(tries)]) if tries else F.array().cast("array<struct<size:int,tries:int>>")
    lines = F.coalesce(lines, F.array().cast("array<string>"))
    box = F.struct(F.coalesce(F.array_max(F.transform(lines, metrics.units)), F.lit(0)).alias("units"), F.size(lines).alias("lines"))

    def search(b):
        high = lambda s: F.ceil(b["lines"] * metrics.line * s["size"] / 1000) + 2 * metrics.stroke
        fits = lambda s: (metrics.width(b["units"], s["size"]) <= max_width) & (F.lit(True) if max_height is None else high(s) <= max_height)
        first = F.get(F.filter(steps, fits), F.lit(0))
        return F.struct(F.coalesce(first["size"], F.lit(sizes[-1])).alias("size"), F.coalesce(first["tries"], F.lit(len(tries))).alias("tries"), first.isNotNull().alias("fits"))

    return let(box, search)
