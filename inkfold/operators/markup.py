"""Auditing SVG documents: elements by a streaming XML parser, rules as columns, the first violation by its order."""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfold.constants import PIXELS_PER_UNIT, SVG_NAMESPACE, XHTML_NAMESPACE, XLINK_NAMESPACE

ELEMENTS = "doc_id string, elem_seq int, local_name string, namespace string, attrs array<struct<name:string,ns:string,value:string>>, style_text string, pis array<string>, entity_ns boolean, doc_pis array<string>, error string"
#: Documents whose elements are one frame.
DOCUMENTS = 200
#: Bytes that entities may expand to, for each byte of a document.
EXPANSION = 100

# What the rules say. Fixed values.
BANNED = {"script": "SVG scripts are not supported", "a": "SVG hyperlinks are not supported", "foreignObject": "SVG foreignObject content is not supported"}
EVENT_HANDLER = "SVG event handler attributes are not supported"
XHTML = "SVG content in the XHTML namespace is not supported"
IMPORT = "SVG stylesheets must not import other stylesheets"
STYLESHEET = "external SVG stylesheets are not supported"
INTO_DATA = "SVG CSS references must not point into a data URI"
ENTITY_NS = "namespace declarations must not contain entity or character references"
NO_SVG = "the root element must be svg in the SVG namespace"
_SEP = "\x1f"


def _parse(doc_id: str, content: bytes) -> list[tuple]:
    parser = expat.ParserCreate(namespace_separator=_SEP)
    parser.buffer_text = True
    elements: list[dict] = []
    stack: list[int] = []
    doc_pis: list[str] = []
    state = {"expanded": 0, "entity_ns": False}

    def name(raw: str) -> tuple[str, str | None]:
        ns, _, local = raw.rpartition(_SEP)
        return local, ns or None

    def start(raw: str, attributes: dict) -> None:
        local, ns = name(raw)
        attrs = sorted(((*name(k), v) for k, v in attributes.items()), key=lambda x: (x[0], x[1] or ""))
        raw_tag = content[parser.CurrentByteIndex : content.find(b">", parser.CurrentByteIndex) + 1]
        entity = any(b"&" in part.split(b"=", 1)[-1] for part in raw_tag.split() if part.startswith(b"xmlns"))
        elements.append({"local": local, "ns": ns, "attrs": attrs, "text": [], "pis": [], "entity": entity})
        stack.append(len(elements) - 1)

    def text(data: str) -> None:
        state["expanded"] += len(data)
        if state["expanded"] > EXPANSION * len(content) + 10_000:
            raise ValueError("entities expand too far")
        if stack and elements[stack[-1]]["local"] == "style":
            elements[stack[-1]]["text"].append(data)

    def instruction(target: str, _: str) -> None:
        (elements[stack[-1]]["pis"] if stack else doc_pis).append(target)

    parser.StartElementHandler, parser.EndElementHandler = start, lambda _: stack.pop()
    parser.CharacterDataHandler, parser.ProcessingInstructionHandler = text, instruction
    try:
        parser.Parse(content, True)
    except (expat.ExpatError, ValueError) as e:
        return [(doc_id, 0, None, None, None, None, None, None, None, str(e))]
    return [(doc_id, i, e["local"], e["ns"], [{"name": n, "ns": s, "value": v} for n, s, v in e["attrs"]], "".join(e["text"]), e["pis"], e["entity"], doc_pis if not i else None, None) for i, e in enumerate(elements)]


def tokenize_markup(markup: DataFrame) -> DataFrame:
    """markup(doc_id, content BINARY) -> elements in document order; a document that isn't well-formed is one row with its error."""
    text, texts = pa.string(), pa.list_(pa.string())
    attrs = pa.list_(pa.struct([("name", text), ("ns", text), ("value", text)]))
    kinds = (text, pa.int32(), text, text, attrs, text, texts, pa.bool_(), texts, text)
    names = [c.split(" ")[0] for c in ELEMENTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), DOCUMENTS):
                part = batch.slice(at, DOCUMENTS)
                rows = [row for doc_id, content in zip(part.column("doc_id").to_pylist(), part.column("content").to_pylist(), strict=True) for row in _parse(doc_id, content or b"")]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return markup.select(F.col("doc_id").cast("string"), "content").mapInArrow(run, ELEMENTS)


def _attribute(name: str) -> Column:
    own = F.filter("attrs", lambda a: (a["name"] == name) & a["ns"].isNull())
    return F.try_element_at(own, F.lit(1))["value"]


_NUMBER = r"^([-+]?)(?:(\.\d+)|(\d+(?:\.\d+)?))([eE][-+]?\d+)?(.*)$"


def svg_number(text: Column) -> tuple[Column, Column]:
    """A leading number, whose digit before the point may be missing, and the rest; null if there's none."""
    part = [F.regexp_extract(text, "(?s)" + _NUMBER, i) for i in range(1, 6)]
    found = text.rlike("(?s)" + _NUMBER)
    digits = F.when(part[1] != "", F.concat(F.lit("0"), part[1])).otherwise(part[2])
    value = F.concat(F.when(part[0] == "-", "-").otherwise(""), digits, part[3]).try_cast("double")
    return F.when(found, value), F.when(found, part[4])


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def _length(name: str) -> tuple[Column, Column]:
    """(CSS pixels or null, error) of the root's width or height; a percentage counts as missing."""
    raw = _attribute(name)
    value, unit = svg_number(_stripped(raw))
    factor = F.element_at(F.create_map(*(F.lit(x) for kv in PIXELS_PER_UNIT.items() for x in kv)), F.lower(F.coalesce(unit, F.lit("?"))))
    bad = raw.isNotNull() & ~F.coalesce((unit == "%") & value.isNotNull(), F.lit(False)) & (value.isNull() | factor.isNull())
    return F.when(F.coalesce(unit != "%", F.lit(False)), value * factor), F.when(bad, F.concat(F.lit(f"{name} must be an absolute length or a percentage: "), raw))


def _sized(elements: DataFrame) -> DataFrame:
    """The elements with width, height and size_error, which only the roots of well-formed documents have."""
    root = (F.col("elem_seq") == 0) & F.col("error").isNull()
    (w, w_error), (h, h_error) = _length("width"), _length("height")
    raw = _attribute("viewBox")
    parts = F.filter(F.split(raw, r"[, \t\n\r]"), lambda p: p != "")
    numbers = F.transform(parts, lambda p: F.struct(svg_number(p)[0].alias("v"), svg_number(p)[1].alias("rest")))
    four = (F.size(parts) == 4) & F.coalesce(F.forall(numbers, lambda n: n["v"].isNotNull() & (n["rest"] == "")), F.lit(False))
    own = F.struct(w.alias("w"), h.alias("h"), F.coalesce(w_error, h_error).alias("e"), raw.alias("box"), F.when(four, numbers).alias("n"))
    rows = elements.withColumn("_s", F.when(root, own))
    s = F.col("_s")
    boxed = s["w"].isNull() & s["h"].isNull()
    error = (
        F.when(s["e"].isNotNull(), s["e"])
        .when(s["w"].isNull() != s["h"].isNull(), "width and height must both be absolute lengths, or neither")
        .when(boxed & s["box"].isNull(), "an SVG without an absolute width and height needs a viewBox")
        .when(boxed & s["n"].isNull(), F.concat(F.lit("viewBox must contain four numbers: "), s["box"]))
    )
    side = lambda name, place: F.when(boxed, F.try_element_at(s["n"], F.lit(place))["v"]).otherwise(s[name])
    rows = rows.withColumns({"_w": side("w", 3), "_h": side("h", 4), "_e": error})
    fine = (F.col("_w") > 0) & (F.col("_h") > 0) & (F.col("_w") < float("inf")) & (F.col("_h") < float("inf"))
    error = F.coalesce("_e", F.when(~F.coalesce(fine, F.lit(False)), "the board width and height must be finite and positive"))
    rows = rows.withColumn("size_error", F.when(s.isNotNull(), error))
    good = s.isNotNull() & F.col("size_error").isNull()
    return rows.withColumns({"width": F.when(good, F.col("_w")), "height": F.when(good, F.col("_h"))}).drop("_s", "_w", "_h", "_e")


def board_size(elements: DataFrame) -> DataFrame:
    """doc_id, width, height, error of each well-formed document, from its root."""
    roots = elements.where("elem_seq = 0 AND error IS NULL")
    return _sized(roots).select("doc_id", "width", "height", F.col("size_error").alias("error"))


def css_targets(css: Column) -> Column:
    """The targets of every url( in a text, without blanks and quotes before them."""
    found = F.regexp_extract_all(css, F.lit(r"(?i)url\([ \t\n\r\"']*([^)\"']*)"), F.lit(1))
    return F.coalesce(found, F.array().cast("array<string>"))


def _css_error(target: Column) -> Column:
    own = _stripped(target)
    data = F.lower(own).startswith("data:")
    return F.when(~own.startswith("#") & ~data, F.concat(F.lit("SVG references an external resource: "), own)).when(data & F.contains(own, F.lit("#")), INTO_DATA)


def _first_error(values: Column) -> Column:
    return F.try_element_at(F.filter(F.transform(values, _css_error), lambda e: e.isNotNull()), F.lit(1))


def _attribute_error(a: Column) -> Column:
    href = (a["name"] == "href") & (a["ns"].isNull() | (a["ns"] == XLINK_NAMESPACE))
    target = _stripped(a["value"])
    loads = F.col("local_name").isin("image", "feImage")
    return (
        F.when(a["ns"].isNull() & F.lower(a["name"]).startswith("on"), EVENT_HANDLER)
        .when(href & loads, F.when(~target.startswith("#") & ~F.lower(target).startswith("data:"), F.concat(F.lit("SVG references an external resource: "), target)))
        .when(href, F.when(~target.startswith("#"), F.concat(F.lit("SVG "), F.col("local_name"), F.lit(" elements must reference an element in the same file"))))
        .otherwise(_first_error(css_targets(a["value"])))
    )


def _marked(elements: DataFrame) -> DataFrame:
    """The sized elements, each with `found`: what it violates. One pass over the elements, however many rules there are."""
    rows = _sized(elements)
    ok = F.col("error").isNull()

    def violation(rank: int, step: int, kind: str, message: Column, place: Column = F.lit(0), seq: Column = F.col("elem_seq")) -> Column:  # noqa: B008
        return F.struct(F.lit(rank).alias("rank"), seq.alias("elem_seq"), F.lit(step).alias("step"), place.alias("place"), F.lit(kind).alias("kind"), message.alias("message"))

    def rule(condition: Column, rank: int, step: int, message: Column, kind: str = "unsupported_svg", **place: Column) -> Column:
        return F.when(condition, violation(rank, step, kind, message, **place))

    banned = F.element_at(F.create_map(*(F.lit(x) for kv in BANNED.items() for x in kv)), F.col("local_name"))
    style = ok & (F.col("local_name") == "style")
    target = F.when(style, _first_error(css_targets(F.col("style_text"))))
    single = [
        rule(~ok, 0, 0, F.col("error"), "invalid_svg"),
        rule(ok & F.col("entity_ns"), 1, 0, F.lit(ENTITY_NS), "invalid_svg", seq=F.lit(0)),
        rule(ok & (F.col("elem_seq") == 0) & ~((F.col("local_name") == "svg") & F.col("namespace").eqNullSafe(SVG_NAMESPACE)), 2, 0, F.lit(NO_SVG), "invalid_svg"),
        rule(F.col("size_error").isNotNull(), 3, 0, F.col("size_error"), "invalid_svg"),
        rule(ok & F.array_contains("doc_pis", "xml-stylesheet"), 4, 0, F.lit(STYLESHEET)),
        rule(ok & (F.col("namespace") == XHTML_NAMESPACE), 5, 0, F.lit(XHTML)),
        rule(ok & F.col("local_name").isin(*BANNED), 5, 1, banned),
        rule(style & F.contains(F.lower("style_text"), F.lit("@import")), 5, 3, F.lit(IMPORT)),
        rule(target.isNotNull(), 5, 4, target),
        rule(ok & F.array_contains("pis", "xml-stylesheet"), 5, 5, F.lit(STYLESHEET)),
    ]
    messages = F.transform(F.coalesce(F.when(ok, F.col("attrs")), F.array().cast("array<struct<name:string,ns:string,value:string>>")), _attribute_error)
    named = F.filter(F.transform(messages, lambda m, i: violation(5, 2, "unsupported_svg", m, place=i)), lambda v: v["message"].isNotNull())
    return rows.withColumn("found", F.concat(F.array_compact(F.array(*single)), named))


def violations(elements: DataFrame) -> DataFrame:
    """doc_id, rank, elem_seq, step, place, kind, message: every violation; the least (rank, elem_seq, step, place) is first."""
    # An inner explode would get filters of its own that repeat all the rules below it.
    return _marked(elements).select("doc_id", F.explode_outer("found").alias("v")).where("v IS NOT NULL").select("doc_id", "v.*")


def audit_markup(elements: DataFrame) -> DataFrame:
    """doc_id, status, error_kind, error_message, width, height, n_violations of each document.

    Rows that share a doc_id, null included, are one document. Elements are aggregated before the shuffle.
    """
    marked = _marked(elements).select("doc_id", "width", "height", F.array_min("found").alias("f"), F.size("found").alias("n"))
    docs = marked.groupBy("doc_id").agg(F.min("f").alias("f"), F.sum("n").alias("n"), F.max("width").alias("width"), F.max("height").alias("height"))
    ok = F.col("f").isNull()
    return docs.select("doc_id", F.when(ok, "ok").otherwise("error").alias("status"), F.col("f.kind").alias("error_kind"), F.col("f.message").alias("error_message"), F.when(ok, F.col("width")).alias("width"), F.when(ok, F.col("height")).alias("height"), F.col("n").alias("n_violations"))


def rule_counts(elements: DataFrame) -> DataFrame:
    return violations(elements).groupBy("kind", "message").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


def svg_nodes(markup: DataFrame, audited: DataFrame) -> DataFrame:
    """board_id, node_seq, kind, bounds, href: one node over the whole board for each document that passed."""
    from inkfold.sinks import svg_data_uri

    good = audited.where("status = 'ok'").select("doc_id", "width", "height")
    rows = markup.select(F.col("doc_id").cast("string"), "content").join(good, "doc_id")
    bounds = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), "width", "height")
    return rows.select(F.col("doc_id").alias("board_id"), F.lit(0).cast("long").alias("node_seq"), F.lit("svg-document").alias("kind"), bounds.alias("bounds"), svg_data_uri(F.col("content")).alias("href"))
