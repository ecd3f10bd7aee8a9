"""Annotated HTML to relations, and label tags rewritten in place."""

from __future__ import annotations

import json
import re
from collections import Counter, deque
from collections.abc import Callable, Iterator
from html import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import htmltree
from ..functions.labels import LABEL_TAG, attributes
from ..sources.staging import small_batches

#: The tokens of functions.tokens, in Python.
PIECES = re.compile(r"""(<[^>]*>)|(\s+)|([.,;:!?()\[\]{}"'`‑–—])|(\w+)|([^\w\s<>])""")
LABELS = ("manual_label", "auto_label")
SUBLABELS = ("title", "citation", "fragment", "authors")
MENTIONS = "doc_id string, mention_id long, name string, docid string, uri string, text string, html string, sublabels array<struct<name:string,text:string>>"
DOCUMENT_SPANS = "doc_id string, document long, plain string, spans array<struct<seq:long,labelname:string,text:string,attrs:map<string,string>,nth:int>>"
#: Characters of sources whose rows leave a worker together.
OUT = 1 << 20
OFFSETS = "doc_id string, seq long, key string, id string, docid string, label string, start long, end long, text string"


def squeeze(text: str) -> str:
    return " ".join(text.split())


def topmost(node: htmltree.Node, names: tuple[str, ...]) -> Iterator[tuple[str, str]]:
    """(label, text) of labels below node that no other of the names encloses."""
    for c in node.children:
        if c.tag is None:
            continue
        name = (c.get("labelname") or "").lower() if c.tag in LABELS else ""
        if name in names:
            if text := squeeze(c.all_text()):
                yield name, text
        else:
            yield from topmost(c, names)


def mentions(html: str) -> list[dict]:
    """Parent-level labels (parent="" and a docid) in document order."""
    out = []
    for e in htmltree.parse(html).elements():
        if e.tag in LABELS and e.get("parent") == "" and e.get("docid") is not None:
            subs = [{"name": n, "text": t} for n, t in topmost(e, SUBLABELS)]
            out.append({"name": e.get("labelname"), "docid": e.get("docid"), "uri": e.get("uri"), "text": squeeze(e.all_text()), "html": e.html(), "sublabels": subs})
    return out


def _body(root: htmltree.Node) -> htmltree.Node:
    return next((e for e in root.elements() if e.tag == "body"), root)


def labelled(html: str) -> tuple[list[dict], str]:
    """Labels with a name and text, manual ones first, then automatic ones, and the body's plain text."""
    body = _body(htmltree.parse(html))
    rows = []
    for kind in LABELS:
        for e in body.elements():
            if e.tag == kind and (name := (e.get("labelname") or "").strip().lower()) and (text := squeeze(e.all_text())):
                rows.append({"labelname": name, "text": text, "attrs": {k: v or "" for k, v in e.attrs if k != "labelname"}})
    return rows, squeeze(body.all_text())


def offsets(html: str) -> list[dict]:
    """Labels with id and docid and their extent in the squeezed text; equal extents are numbered."""
    body = _body(htmltree.parse(html))
    chars: list[str] = []
    spots: list[tuple[htmltree.Node, int, int]] = []

    def walk(n: htmltree.Node) -> None:
        start = len(chars)
        if n.tag is None:
            for c in n.all_text():
                if not c.isspace():
                    chars.append(c)
                elif chars and chars[-1] != " ":
                    chars.append(" ")
            return
        for c in n.children:
            walk(c)
        spots.append((n, start, len(chars)))

    walk(body)
    text = "".join(chars)
    order = {id(e): i for i, e in enumerate(body.elements())}
    seen: dict[str, int] = {}
    out = []
    for n, a, b in sorted((s for s in spots if s[0] is not body), key=lambda s: order[id(s[0])]):
        if n.tag not in LABELS or n.get("id") is None or n.get("docid") is None:
            continue
        while a < b and text[a] == " ":
            a += 1
        while b > a and text[b - 1] == " ":
            b -= 1
        label = (n.get("labelname") or "").strip().lower()
        key = f"{label}|{a}|{b}"
        seen[key] = seen.get(key, 0) + 1
        out.append({"key": key if seen[key] == 1 else f"{key}#{seen[key]}", "id": n.get("id"), "docid": n.get("docid"), "label": label, "start": a, "end": b, "text": text[a:b]})
    return out


def identified(html: str) -> list[dict]:
    """id and docid of every element that has both."""
    return [{"id": e.get("id"), "docid": e.get("docid")} for e in htmltree.parse(html).elements() if e.get("id") is not None and e.get("docid") is not None]


def linked(html: str) -> list[dict]:
    """Labels with their link, in document order."""
    rows = [e for e in htmltree.parse(html).elements() if e.tag in LABELS]
    return [{"labelname": (e.get("labelname") or "").strip().lower(), "docid": e.get("docid"), "uri": e.get("uri"), "text": squeeze(e.all_text())} for e in rows]


def patterns(html: str) -> list[dict]:
    """Of each parent-level label its name and the names of the labels in it, in order."""
    out = []
    for e in htmltree.parse(html).elements():
        if e.tag in LABELS and e.get("parent") == "":
            out.append({"name": (e.get("labelname") or "").strip().lower(), "parts": [(c.get("labelname") or "").strip().lower() for c in e.elements() if c.tag in LABELS]})
    return out


def sublabel_texts(html: str) -> list[dict]:
    """Text of every label within a parent-level one: parent's name, part and text, in order."""
    out = []
    for e in htmltree.parse(html).elements():
        if e.tag in LABELS and e.get("parent") == "":
            for c in e.elements():
                if c.tag in LABELS and (text := squeeze(c.all_text())):
                    out.append({"parent": (e.get("labelname") or "").strip().lower(), "part": (c.get("labelname") or "").strip().lower(), "text": text})
    return out


def contexts(html: str, most: int) -> list[dict]:
    """Of each parent-level label with a docid, at most so many tokens of the text before it; one pass."""
    out: list[dict] = []
    before: deque[str] = deque(maxlen=most)
    for m in PIECES.finditer(re.sub(r"(?s)<!--.*?-->", "", html)):
        t = m[0]
        if t.startswith("<") and t.endswith(">") and len(t) > 2:
            tag = LABEL_TAG.fullmatch(t)
            if tag and not tag[1] and (own := attributes(t)).get("parent") == "" and "docid" in own:
                out.append({"context": "".join(before)})
        elif before and not t.strip() and not before[-1].strip():
            before[-1] += t
        else:
            before.append(t)
    return out


def _relation(docs: DataFrame, schema: str, rows_of: Callable[[str], list[dict]]) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds = to_arrow_schema(StructType.fromDDL(schema))
    number = kinds.names[1]

    def batch(out: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([list(r[n].items()) if isinstance(r[n], dict) else r[n] for r in out], kinds.field(n).type) for n in kinds.names], names=kinds.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, size = [], 0
            for doc_id, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out += [{"doc_id": doc_id, number: i, **r} for i, r in enumerate(rows_of(html or ""))]
                size += len(html or "")
                if size > OUT or len(out) > 2_000:
                    yield batch(out)
                    out, size = [], 0
            yield batch(out)

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("string"), F.col("html").cast("string")).mapInArrow(run, schema)


def mention_rows(docs: DataFrame) -> DataFrame:
    return _relation(docs, MENTIONS, mentions)


def document_spans(docs: DataFrame) -> DataFrame:
    """doc_id, plain, spans array<struct<seq, labelname, text, attrs, nth>>: a row per document, the body's plain text
    once; nth is the number of a span among those of its label and text."""

    def rows(html: str) -> list[dict]:
        found, plain = labelled(html)
        seen: Counter = Counter()
        spans = []
        for seq, r in enumerate(found):
            key = r["labelname"], r["text"]
            seen[key] += 1
            spans.append({"seq": seq, **r, "attrs": list(r["attrs"].items()), "nth": seen[key]})
        return [{"plain": plain, "spans": spans}] if spans else []

    return _relation(docs, DOCUMENT_SPANS, rows).drop("document")


def span_rows(docs: DataFrame) -> DataFrame:
    """Spans with the body's plain text, and nth, their number among those of a document's label and text;
    operators.spans.located_spans adds place and context."""
    return document_spans(docs).select("doc_id", "plain", F.explode("spans").alias("s")).select("doc_id", "s.seq", "s.labelname", "s.text", "s.attrs", "plain", "s.nth")


def offset_rows(docs: DataFrame) -> DataFrame:
    return _relation(docs, OFFSETS, offsets)


def context_rows(docs: DataFrame, most: int) -> DataFrame:
    """doc_id, mention_id, context: at most so many tokens before each mention."""
    return _relation(docs, "doc_id string, mention_id long, context string", lambda html: contexts(html, most))


def docid_mapping(docs: DataFrame) -> DataFrame:
    """doc_id, id, docid of elements with both; of equal ids the last counts."""
    rows = _relation(docs, "doc_id string, seq long, id string, docid string", identified)
    return rows.groupBy("doc_id", "id").agg(F.max_by("docid", "seq").alias("docid"))


def uri_rows(docs: DataFrame) -> DataFrame:
    """doc_id, seq, labelname, docid, uri, text of labels that have a link attribute."""
    return _relation(docs, "doc_id string, seq long, labelname string, docid string, uri string, text string", linked).where("uri is not null")


def pattern_rows(docs: DataFrame) -> DataFrame:
    """doc_id, seq, name, parts of parent-level labels."""
    return _relation(docs, "doc_id string, seq long, name string, parts array<string>", patterns)


def sublabel_rows(docs: DataFrame) -> DataFrame:
    """doc_id, seq, parent, part, text of labels within parent-level ones."""
    return _relation(docs, "doc_id string, seq long, parent string, part string, text string", sublabel_texts)


def docids_applied(docs: DataFrame, mapping: DataFrame) -> DataFrame:
    """doc_id, html, missing: docs with the docids of mapping (doc_id, id, docid) in their labels, earlier docids
    and links gone, and the ids of mapping that no label has."""
    maps = mapping.groupBy("doc_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("id", "docid")))).alias("m"))
    rows = docs.select("doc_id", "html").join(maps, "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, missing = [], []
            for html, m in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                of = json.loads(m) if m else {}
                out.append(with_docids(html or "", of))
                have = {attributes(t[0]).get("id") for t in LABEL_TAG.finditer(html or "") if not t[1]}
                missing.append(sorted(set(of) - have))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string()), pa.array(missing, pa.list_(pa.string()))], ["doc_id", "html", "missing"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, html string, missing array<string>")


# -- rewriting


def rewritten(html: str, new: Callable[[dict[str, str]], dict[str, str]]) -> str:
    """Opening label tags with attributes changed by new."""

    def one(m: re.Match) -> str:
        if m[1]:
            return m[0]
        before = attributes(m[0])
        after = new(dict(before))
        return m[0] if after == before else f"<{m[2]}" + "".join(f' {k}="{escape(v, quote=True)}"' for k, v in after.items()) + ">"

    return LABEL_TAG.sub(one, html)


def with_ids(html: str) -> str:
    """ids 0, 1, 2, ... in document order."""
    n = iter(range(len(html)))
    return rewritten(html, lambda a: a | {"id": str(next(n))})


def with_docids(html: str, docid_of: dict[str, str]) -> str:
    """All docids and uris go; labels whose id is known get theirs."""
    return rewritten(html, lambda a: {k: v for k, v in a.items() if k not in ("docid", "uri")} | ({"docid": d} if (d := docid_of.get(a.get("id", ""))) else {}))


def with_uris(html: str, uri_of: dict[str, str]) -> str:
    """Labels whose docid is known get its uri as first attribute."""
    return rewritten(html, lambda a: {"uri": u} | {k: v for k, v in a.items() if k != "uri"} if (u := uri_of.get(a.get("docid", "").strip())) else a)


def without_uris(html: Column) -> tuple[Column, Column]:
    """html without uri attributes in label tags, and how many there were."""
    pattern = r"""(?i)(<(?:manual|auto)_label\b[^>]*?)\s+uri=(?:"[^"]*"|'[^']*')"""
    return F.regexp_replace(html, pattern, "$1"), F.regexp_count(html, F.lit(pattern))


def segments(rows: DataFrame) -> DataFrame:
    """rows (doc_id, tokens, mentions array<struct<start,end>> by start) -> doc_id, nth, process, tokens:
    the mentions' tokens and what lies between, in turn, nothing lost."""
    bound = F.transform("mentions", lambda m: F.struct(m["start"].alias("a"), m["end"].alias("b")))
    cuts = F.concat(F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"))), bound, F.array(F.struct(F.size("tokens").alias("a"), F.size("tokens").alias("b"))))
    pairs = F.transform(F.sequence(F.lit(1), F.size(cuts) - 1), lambda i: F.struct(F.get(cuts, i - 1)["b"].alias("gap"), F.get(cuts, i)["a"].alias("a"), F.get(cuts, i)["b"].alias("b")))
    rows = rows.select("doc_id", "tokens", F.posexplode(pairs).alias("i", "p"))
    parts = F.array(F.struct(F.lit(False).alias("process"), F.col("p.gap").alias("a"), F.col("p.a").alias("b")), F.struct(F.lit(True).alias("process"), F.col("p.a").alias("a"), F.col("p.b").alias("b")))
    out = rows.select("doc_id", "i", "tokens", F.posexplode(parts).alias("k", "s")).where("s.b > s.a")
    return out.select("doc_id", (F.col("i") * 2 + F.col("k")).alias("nth"), "s.process", F.slice("tokens", F.col("s.a") + 1, F.col("s.b") - F.col("s.a")).alias("tokens"))
