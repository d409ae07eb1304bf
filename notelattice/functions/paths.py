"""Path expressions: ordering keys, safety, MIME types, link keys. All are Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Content types by extension.
MIME = {
    "md": "text/markdown", "markdown": "text/markdown", "mdx": "text/markdown", "txt": "text/plain", "csv": "text/csv",
    "html": "text/html", "htm": "text/html", "css": "text/css", "js": "text/javascript", "json": "application/json",
    "xml": "application/xml", "yaml": "application/yaml", "yml": "application/yaml", "pdf": "application/pdf",
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "svg": "image/svg+xml", "webp": "image/webp",
    "mp3": "audio/mpeg", "mp4": "video/mp4", "canvas": "application/json",
}
OCTETS = "application/octet-stream"
MAX_PATH_BYTES = 1024


def order_key(path: Column) -> Column:
    """Sorts paths by segment: an array compares element by element, a prefix first."""
    return F.split(path, "/")


def segments(path: Column) -> Column:
    return F.split(path, "/")


def folder_of(path: Column) -> Column:
    """All before the last slash; empty at the root."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def basename(path: Column) -> Column:
    return F.element_at(segments(path), -1)


def extension(path: Column) -> Column:
    """Lower-case extension of the last segment, null without one."""
    return F.nullif(F.lower(F.regexp_extract(basename(path), r"\.([^.]+)$", 1)), F.lit(""))


def mime(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.coalesce(extension(path), F.lit(""))), F.lit(OCTETS))


def is_markdown(path: Column) -> Column:
    return F.coalesce(extension(path).isin("md", "markdown", "mdx"), F.lit(False))


def has_hidden_segment(path: Column) -> Column:
    return F.exists(segments(path), lambda s: s.startswith("."))


def is_indexable(path: Column) -> Column:
    """The lexical half of the rule: safe, Markdown, no hidden or node_modules segment."""
    return path_problem(path).isNull() & is_markdown(path) & ~F.exists(segments(path), lambda s: s == "node_modules")


def canonical(path: Column) -> Column:
    """Without empty and '.' segments; a leading slash stays."""
    body = F.array_join(F.filter(segments(path), lambda s: ~s.isin("", ".")), "/")
    return F.concat(F.when(path.startswith("/"), F.lit("/")).otherwise(F.lit("")), body)


def path_problem(path: Column) -> Column:
    """Why a path is refused, or null."""
    parts = segments(path)
    return (
        F.when(F.length(path) == 0, "empty")
        .when(F.octet_length(path) > MAX_PATH_BYTES, "too_long")
        .when(F.instr(path, "\0") > 0, "nul")
        .when(path.rlike(r"^[/\\]"), "absolute")
        .when(path.rlike(r"^[A-Za-z]:"), "drive")
        .when(F.array_contains(parts, ".."), "parent")
        .when(has_hidden_segment(path), "hidden")
    )


def under(path: Column, prefix: Column | str) -> Column:
    """Whether path is prefix or lies in it; prefixes are literal, never patterns."""
    prefix = F.lit(prefix) if isinstance(prefix, str) else prefix
    return (path == prefix) | F.startswith(path, F.concat(prefix, F.lit("/")))


def suffix_keys(path: Column) -> Column:
    """Every '/'-suffix of a path, itself first."""
    parts = segments(path)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def join_normalized(folder: Column, rel: Column) -> Column:
    """folder/rel with '.', '..' and empty segments resolved; null where it climbs over the root."""
    start = F.when(F.length(folder) == 0, F.array().cast("array<string>")).otherwise(segments(folder))
    bad = F.array(F.lit("\0"))

    def step(acc: Column, s: Column) -> Column:
        return (
            F.when(acc == bad, acc)
            .when(s.isin("", "."), acc)
            .when(s == "..", F.when(F.size(acc) == 0, bad).otherwise(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))))
            .otherwise(F.array_append(acc, s))
        )

    done = F.aggregate(segments(rel), start, step)
    return F.when(done != bad, F.array_join(done, "/"))


def relative_form(folder: Column, target: Column) -> Column:
    """target as seen from folder, with '../' steps."""
    a = F.when(F.length(folder) == 0, F.array().cast("array<string>")).otherwise(segments(folder))
    b = segments(target)
    # the common head: of equal lengths of both, the longest equal one
    n = F.least(F.size(a), F.size(b) - 1)
    same = F.aggregate(
        F.sequence(F.lit(0), n), F.lit(0), lambda acc, i: F.when((acc == i - 1) & (F.slice(a, 1, F.greatest(i, F.lit(0))) == F.slice(b, 1, F.greatest(i, F.lit(0)))), i).otherwise(acc)
    )
    ups = F.repeat(F.lit("../"), F.size(a) - same)
    return F.concat(ups, F.array_join(F.slice(b, same + 1, F.size(b)), "/"))


def cursor_of(path: Column) -> Column:
    return F.base64(F.encode(path, "UTF-8"))
