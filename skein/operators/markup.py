"""From tags to annotated markup, and back to plain text."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from xml.sax.saxutils import escape, quoteattr

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions import flat

#: A discontinued mention goes on under its id over this many other tokens.
GAP = 3
#: Tags of tokens outside of mentions.
PLAIN = ("O", "#")
#: A genus and a species.
SHORT = re.compile(r"(\w)\w+\.? (\w+)")
_TOKENS = pa.list_(pa.struct([("string", pa.string()), ("offset", pa.struct([("start", pa.int32()), ("end", pa.int32())])), ("prediction", pa.string()), ("gold_label", pa.string()), ("prob", pa.float64())]))


def _names(text: str, kind: str) -> list[str]:
    """What a mention may be called: as it stands, and bacteria by their short form too."""
    return [text, SHORT.sub(r"\1. \2", text)] if kind == "Bacteria" else [text]


def _entities(mentions: list[tuple[int, str, str]]) -> list[tuple[int, str]]:
    """(id, type) of a document's mentions (plain tokens between it and the mention before, first tag, text)."""
    out, number, before = [], 0, ""
    claimed: dict[tuple[str, str], int] = {}
    for gap, tag, text in mentions:
        kind = re.sub("[BI]-", "", tag)
        if tag.startswith("B-") or kind != before or gap > GAP:
            number, before = number + 1, kind
        names = [(name, kind) for name in _names(text, kind)]
        entity = next((claimed[name] for name in names if name in claimed), None)
        if entity is None:
            entity = number
            claimed.update(dict.fromkeys(names, number))
        out.append((entity, kind))
    return out


def _escaped(strings: pa.Array) -> pa.Array:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        strings = pc.replace_substring(strings, sign, name)
    return strings


def _serialised(column: pa.Array, namespace: str, uri: str) -> pa.Array:
    """`serialised` of each row. Mentions, which are few, are seen one by one; other tokens by Arrow alone."""
    bounds, values, null = flat.lists(column)
    n, strings, tags = len(values), values.field("string"), values.field("prediction")
    start, end = (values.field("offset").field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("start", "end"))
    heads = bounds[:-1][np.diff(bounds) > 0]
    before = np.concatenate([[0], end[:-1]])[:n]
    before[heads] = 0
    gaps = pc.binary_repeat(" ", pa.array(np.maximum(0, start - before)))
    mention = ~pc.is_in(tags, pa.array(PLAIN)).to_numpy(zero_copy_only=False)
    new = np.zeros(n, bool)
    new[heads] = True
    new[1:] |= mention[1:] != mention[:-1]
    new |= pc.starts_with(tags, "B-").to_numpy(zero_copy_only=False)
    first = np.flatnonzero(new & mention)
    stop = np.append(np.flatnonzero(new), n)
    stop = stop[np.searchsorted(stop, first, "right")]
    plain = np.concatenate([[0], np.cumsum(~mention)])
    opened, closed, held = [], [], {}
    names = strings.take(pa.array(first)).to_pylist()
    for i, (a, b) in enumerate(zip(first.tolist(), stop.tolist())):
        if b > a + 1:
            names[i] += "".join(" " * int(start[j] - end[j - 1]) + strings[j].as_py() for j in range(a + 1, b))
    kinds, owner = tags.take(pa.array(first)).to_pylist(), np.searchsorted(bounds, first, "right") - 1
    for i, doc in enumerate(owner.tolist()):
        since = stop[i - 1] if i and owner[i - 1] == doc else bounds[doc]
        held.setdefault(doc, []).append((int(plain[first[i]] - plain[since]), kinds[i], names[i]))
    for mentions in held.values():
        for entity, kind in _entities(mentions):
            opened.append(f'<span class="entity" resource="#T{entity}" typeof="{kind if kind == "OOS" else f"{namespace}:{kind}"}">')
            closed.append("</span>")
    empty = pa.repeat(pa.scalar("", pa.string()), n)

    def put(at: np.ndarray, texts: list[str]) -> pa.Array:
        mask = np.zeros(n, bool)
        mask[at] = True
        return pc.replace_with_mask(empty, pa.array(mask), pa.array(texts, pa.string()))

    parts = pc.binary_join_element_wise(gaps, put(first, opened), _escaped(strings), put(stop - 1, closed), "")
    whole = pc.binary_join(flat.list_array(bounds, parts, null), "")
    return pc.binary_join_element_wise(f"<div prefix={quoteattr(f'{namespace}: {uri}')}>", whole, "</div>", "")


def serialised(tokens: list[dict], namespace: str = "ex", uri: str = "https://example.org/schema/") -> str:
    """Merged tokens as a div whose entity spans carry ids; equal mentions of one type share an id.

    The text before the first token is spaces. A mention begins at B- or after a plain token, and takes in the tags that follow it.
    One without B- goes on under the id before it if type and gap allow; any other
    is numbered anew. Then a mention whose name, or else its short form, an earlier one of its type claimed takes that one's id,
    and one that finds none claims its names. Types compare without their B- or I-. Texts are escaped.
    """
    return _serialised(pa.array([tokens], _TOKENS), namespace, uri)[0].as_py()


def markup(tokens: Column, namespace: str = "ex", uri: str = "https://example.org/schema/") -> Column:
    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        return flat.by_chunks(column, lambda rows: _serialised(rows, namespace, uri))

    return run(tokens)


class _Tags(HTMLParser):
    def __init__(self, keep_hidden: bool = False):
        super().__init__(convert_charrefs=True)
        self.texts: list[str] = []
        self.marks: list[tuple[int, str]] = []  # place in the text, tag as written
        self.length, self.hidden, self.keep = 0, 0, keep_hidden

    def _mark(self, raw: str) -> None:
        self.marks.append((self.length, raw))

    def handle_starttag(self, tag, attrs):
        self._mark(self.get_starttag_text())
        self.hidden += tag in ("script", "style")

    def handle_startendtag(self, tag, attrs):
        self._mark(self.get_starttag_text())

    def handle_endtag(self, tag):
        self._mark(f"</{tag}>")
        self.hidden = max(0, self.hidden - (tag in ("script", "style")))

    def handle_comment(self, data):
        self._mark(f"<!--{data}-->")

    def handle_decl(self, decl):
        self._mark(f"<!{decl}>")

    def handle_data(self, data):
        if self.hidden and not self.keep:
            self._mark(data)
        else:
            self.texts.append(data)
            self.length += len(data)


def parsed(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """The text without markup, and the marks with their places in it. Scripts and styles are marks. Ill-formed markup passes."""
    parser = _Tags()
    parser.feed(text or "")
    parser.close()
    return "".join(parser.texts), parser.marks


def reinserted(annotated: str, original: str) -> str:
    """annotated markup with the original's own marks put back at their places in the text; stripping it gives the original's text."""
    _, marks = parsed(original)
    plain, own = parsed(annotated)
    out, at = [], 0
    both = sorted([(place, 0, i, raw) for i, (place, raw) in enumerate(own)] + [(place, 1, i, raw) for i, (place, raw) in enumerate(marks)])
    for place, _, _, raw in both:
        out += [escape(plain[at:place]), raw]
        at = place
    return "".join(out) + escape(plain[at:])


@F.pandas_udf(T.StringType())
def stripped(column: pd.Series) -> pd.Series:
    """Markup to text; null stays null."""
    return pd.Series([None if t is None else parsed(t)[0] for t in column], dtype=object)


@F.pandas_udf(T.StringType())
def put_back(annotated: pd.Series, original: pd.Series) -> pd.Series:
    return pd.Series([None if a is None else reinserted(a, o or "") for a, o in zip(annotated, original)], dtype=object)


def annotation(metadata: Column, body: Column) -> Column:
    return F.concat(F.lit("<annotation>"), F.coalesce(metadata, F.lit("")), F.coalesce(body, F.lit("")), F.lit("</annotation>"))
