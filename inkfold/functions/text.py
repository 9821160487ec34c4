"""Titles, escaping, templates, path data, page readiness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space that titles are trimmed of, a fixed set: tabs and line ends, and Unicode's spaces.
_BLANK = r"[\t-\r\p{Zs}]"
EMPTY_TITLE = "site title must not be empty"
CONTROL_TITLE = "site title must not contain control characters"


def trimmed(raw: Column) -> Column:
    return F.regexp_replace(raw, f"^{_BLANK}+|{_BLANK}+$", "")


def title_error(raw: Column) -> Column:
    title = trimmed(F.coalesce(raw, F.lit("")))
    return F.when(title == "", EMPTY_TITLE).when(title.rlike(r"\p{Cc}"), CONTROL_TITLE)


def escape_html(text: Column) -> Column:
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def render_template(template: Column, title: Column, title_mark: str = "{{SITE_TITLE}}", label_mark: str = "{{SITE_ARIA_LABEL}}", label_prefix: str = "Zoomable page: ") -> Column:
    """Fill marks by pieces, so that a title which is itself a mark is never expanded."""
    label = escape_html(F.concat(F.lit(label_prefix), title))
    pieces = F.split(template, _quoted(title_mark), -1)
    return _fill(pieces, label, escape_html(title), label_mark)


def _fill(pieces: Column, label: Column, title: Column, label_mark: str) -> Column:
    filled = F.transform(pieces, lambda p: F.replace(p, F.lit(label_mark), label))
    return F.aggregate(F.slice(filled, 2, F.size(filled)), F.element_at(filled, 1), lambda whole, p: F.concat(whole, title, p))


def _quoted(mark: str) -> str:
    return "\\Q" + mark + "\\E"


def decimal(value: Column) -> Column:
    """Rounded half to even to three places, without trailing zeros; never -0."""
    rounded = F.rint(value * 1000.0) / 1000.0
    text = F.regexp_replace(F.regexp_replace(F.format_string("%.3f", rounded), r"0+$", ""), r"\.$", "")
    return F.when(rounded == 0, "0").otherwise(text)


def path_data(commands: Column) -> Column:
    """Commands as SVG path text."""

    def at(p: Column) -> Column:
        return F.concat(decimal(p["x"]), F.lit(","), decimal(p["y"]))

    def text(c: Column) -> Column:
        return (
            F.when(c["kind"] == "move", F.concat(F.lit("M"), at(c["end"])))
            .when(c["kind"] == "line", F.concat(F.lit("L"), at(c["end"])))
            .when(c["kind"] == "curve", F.concat(F.lit("C"), at(c["first"]), F.lit(" "), at(c["second"]), F.lit(" "), at(c["end"])))
            .otherwise("Z")
        )

    return F.array_join(F.transform(commands, text), "")


def body_is_ready(html: Column) -> Column:
    """The first body tag carries the ready mark."""
    at = F.instr(html, "<body")
    tag = F.substring_index(F.substr(html, at), ">", 1)
    return F.coalesce((at > 0) & F.contains(tag, F.lit('data-ready="true"')), F.lit(False))
