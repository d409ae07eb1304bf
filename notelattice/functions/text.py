"""Text expressions: slugs, lines, windows, edits, quoting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LINE_CLIP = 1000


def slugify(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def split_lines(content: Column) -> Column:
    """Lines at '\\n' only, one trailing '\\r' off each, no line after a final newline."""
    lines = F.transform(F.split(content, "\n", -1), lambda x: F.regexp_replace(x, r"\r\z", ""))
    return F.when((F.length(content) == 0) | content.endswith("\n"), F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0)))).otherwise(lines)


def clip_line(line: Column, width: int = LINE_CLIP) -> Column:
    return F.left(line, F.lit(width))


def window_start(line: Column, column: Column, width: int = LINE_CLIP) -> Column:
    """1-based first column of a window of `width` code points around a match, inside the line."""
    return F.greatest(F.lit(1), F.least(column - F.lit(width // 2), F.length(line) - F.lit(width - 1)))


def window_line(line: Column, column: Column, width: int = LINE_CLIP) -> Column:
    return F.substr(line, window_start(line, column, width), F.lit(width))


def escape_literal(text: str) -> str:
    """A Java pattern for exactly this text."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def occurrences(content: Column, part: Column) -> Column:
    """Non-overlapping occurrences, left to right."""
    return F.when(F.length(part) > 0, (F.length(content) - F.length(F.replace(content, part, F.lit("")))) / F.length(part)).otherwise(F.lit(0)).cast("int")


def apply_edits(content: Column, edits: Column) -> Column:
    """Find and replace edits (old, new, all) in order, all or nothing: struct(text, error, at).

    An edit must match; without `all` exactly once; old and new must differ; replacements are
    literal. After the first failing edit nothing else runs, and text is null.
    """
    start = F.struct(content.alias("text"), F.lit(None).cast("string").alias("error"), F.lit(0).alias("at"))

    def step(acc: Column, e: Column) -> Column:
        n = occurrences(acc["text"], e["old"])
        error = (
            F.when(acc["error"].isNotNull(), acc["error"])
            .when(e["old"] == e["new"], "invalid_input")
            .when(n == 0, "patch_no_match")
            .when((n > 1) & ~e["all"], "patch_ambiguous")
        )
        return F.struct(
            F.when(error.isNull(), F.replace(acc["text"], e["old"], e["new"])).otherwise(acc["text"]).alias("text"),
            error.alias("error"),
            F.when(acc["error"].isNull() & error.isNull(), acc["at"] + 1).otherwise(acc["at"]).alias("at"),
        )

    return F.aggregate(edits, start, step, lambda acc: F.struct(F.when(acc["error"].isNull(), acc["text"]).alias("text"), acc["error"].alias("error"), acc["at"].alias("at")))


def note_with_frontmatter(fields: Column, content: Column) -> Column:
    """A note from a map of JSON-encoded values and its body."""
    lines = F.transform(F.map_entries(fields), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return F.concat(F.lit("---\n"), F.array_join(lines, "\n"), F.lit("\n---\n\n"), content)


def encode_link(text: Column, angle: bool = False) -> Column:
    """Percent-encodes what ends a Markdown link target, the percent sign first; between angle
    brackets spaces and parentheses end nothing."""
    for raw, code in (("%", "%25"), ("#", "%23"), ("\\", "%5C"), ("<", "%3C"), (">", "%3E"), *(() if angle else ((" ", "%20"), ("(", "%28"), (")", "%29")))):
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def decode_link(text: Column) -> Column:
    """Percent-decodes; a text with a bad escape stays as it is. A plus sign is a plus sign."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def unescape_markdown(text: Column) -> Column:
    """Backslashes before ASCII punctuation taken away; others stay."""
    return F.regexp_replace(text, r"\\([!-/:-@\[-`{-~])", "$1")


def iso_of_millis(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def strict_utf8(data: Column) -> Column:
    """The text of valid bytes, null otherwise."""
    return F.when(F.is_valid_utf8(data.cast("string")), data.cast("string"))


def lenient_utf8(data: Column) -> Column:
    return F.make_valid_utf8(data.cast("string"))
