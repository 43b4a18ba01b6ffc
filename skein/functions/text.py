"""Column builders for texts, tokens and names.

A token is struct<string, offset struct<start, end>, prediction, gold_label, prob>; see skein.schema.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from skein import schema
from skein.functions import flat
from skein.functions.flat import TOKEN_PATTERN as TOKEN_PATTERN



def joined_text(*parts: Column, sep: str = "\n") -> Column:
    """Parts with sep between them; a null part counts as empty, and its separator stays."""
    return F.concat_ws(sep, *[F.coalesce(p, F.lit("")) for p in parts])


def safe_concat(a: Column, b: Column) -> Column:
    """a and b together; null only if both are."""
    return F.coalesce(F.concat(a, b), a, b)


def joined_nonempty(a: Column, b: Column, sep: str) -> Column:
    """a, sep, b; without sep where either is empty. A null counts as empty."""
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    return F.concat(a, F.when((a != "") & (b != ""), F.lit(sep)).otherwise(F.lit("")), b)


def subword_mark(token: Column) -> Column:
    return F.when(F.startswith(token, F.lit("##")), F.lit("##")).otherwise(F.lit(""))


def without_marks(token: Column) -> Column:
    """All leading # removed."""
    return F.regexp_replace(token, "^#+", "")


def detokenised(tokens: Column) -> Column:
    """Tokens' strings with as many spaces between them as their offsets leave; empty for no tokens, none before the first."""

    before = F.concat(F.slice(tokens, 1, 1), F.slice(tokens, F.lit(1), F.greatest(F.lit(0), F.size(tokens) - 1)))
    # the first token stands beside itself, so has no gap; a lambda that named tokens would make them anew for each token
    spaced = F.zip_with(tokens, before, lambda t, b: F.concat(F.repeat(F.lit(" "), F.greatest(F.lit(0), t["offset"]["start"] - b["offset"]["end"])), t["string"]))
    return F.array_join(spaced, "")


def cased_tokens(text: Column, offsets: Column, pieces: Column, specials=("[CLS]", "[SEP]", "[PAD]")) -> Column:
    """Pieces with their letters as in the text: the substring at each offset, with the piece's mark; specials as they are."""

    def cased(offset: Column, piece: Column) -> Column:
        own = F.substring(text, offset["start"] + 1, offset["end"] - offset["start"])
        return F.when(piece.isin(*specials), piece).otherwise(F.concat(subword_mark(piece), own))

    return F.zip_with(offsets, pieces, cased)


def without_specials(tokens: Column, specials=("[CLS]", "[SEP]", "[PAD]")) -> Column:
    return F.filter(tokens, lambda t: ~t["string"].isin(*specials))


def padded_offsets(offsets: Column, length: int) -> Column:
    """offsets filled up to length with (0, 0)."""
    zero = F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))
    return F.concat(offsets, F.array_repeat(zero, F.greatest(F.lit(0), F.lit(length) - F.size(offsets))))


def aligned_labels(word_ids: Column, labels: Column) -> Column:
    """Each piece's word's label; # for pieces without a word."""
    return F.transform(word_ids, lambda i: F.when(i.isNull(), F.lit("#")).otherwise(F.get(labels, i)))


def abbreviated(name: Column) -> Column:
    """Genus cut to its first letter: `Escherichia coli` to `E. coli`. Words are Unicode words."""
    return F.regexp_replace(name, r"(?U)(\w)\w+\.? (\w+)", r"$1. $2")


def entity_type(prediction: Column, namespace: str) -> Column:
    """A tag without every B- and I-, in a namespace unless out of scope."""
    bare = F.regexp_replace(prediction, "[BI]-", "")
    return F.when(bare == "OOS", bare).otherwise(F.concat(F.lit(namespace + ":"), bare))


def entity_markup(text: Column, prediction: Column, entity_id: Column, namespace: str) -> Column:
    """A span element, its text escaped."""
    safe = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.format_string('<span class="entity" resource="#T%s" typeof="%s">%s</span>', entity_id.cast("string"), entity_type(prediction, namespace), safe)


def split_trimmed(text: Column, sep: str = ",") -> Column:
    return F.transform(F.split(text, sep), lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")))


def without_prefix(text: Column, prefix: str = "PMC") -> Column:
    """Every occurrence goes."""
    return F.replace(text, F.lit(prefix), F.lit(""))


def flat_fields(items: Column) -> Column:
    """map<name, text> of array<struct<name, text, items array<struct<name, text>>>>; nested items become the JSON of their own map, no text is ''."""
    text = lambda i: F.coalesce(i["text"], F.lit(""))
    inner = lambda i: F.to_json(F.map_from_entries(F.transform(i["items"], lambda j: F.struct(j["name"], text(j)))))
    return F.map_from_entries(F.transform(items, lambda i: F.struct(i["name"], F.when(F.size(i["items"]) > 0, inner(i)).otherwise(text(i)))))


def multi_hot(indexes: Column, size: int | Column) -> Column:
    """1 at each index below size, 0 elsewhere; nulls and others are ignored."""
    size = size if isinstance(size, Column) else F.lit(size)
    return F.when(size > 0, F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.coalesce(F.array_contains(indexes, i), F.lit(False)).cast("tinyint"))).otherwise(F.array().cast("array<tinyint>"))


def hot_positions(hot: Column) -> Column:
    """Indexes of the non-zero entries."""
    return F.filter(F.transform(hot, lambda x, i: F.when(x != 0, i)), lambda i: i.isNotNull())


def presence(*lists: Column) -> Column:
    """1.0 for each list that isn't empty."""
    return F.array(*[(F.coalesce(F.size(x), F.lit(0)) > 0).cast("float") for x in lists])


def _merged_off(column: pa.Array, specials: tuple[str, ...]) -> pa.Array:
    bounds, values, null = flat.lists(column)
    strings = values.field("string")
    kept = pc.and_(strings.is_valid(), pc.invert(pc.is_in(strings, pa.array(specials, pa.string()))))
    bounds = np.concatenate([[0], np.cumsum(kept.to_numpy(zero_copy_only=False))])[bounds]
    values = values.filter(kept)
    strings, offset = values.field("string"), values.field("offset")
    start, end = (offset.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("start", "end"))
    head = ~pc.starts_with(strings, "##").to_numpy(zero_copy_only=False)
    head[bounds[:-1][np.diff(bounds) > 0]] = True
    gaps = np.where(head, 0, np.maximum(0, start - np.concatenate([[0], end[:-1]])[: len(end)]))
    parts = pc.binary_join_element_wise(pc.binary_repeat(" ", pa.array(gaps)), pc.if_else(pa.array(head), strings, pc.utf8_ltrim(strings, "#")), "")
    first = np.flatnonzero(head)
    stop = np.append(first[1:], len(head))[: len(first)]
    whole = pc.binary_join(flat.list_array(np.append(first, len(head)), parts), "")
    hull = pa.StructArray.from_arrays([pa.array(start[first], pa.int32()), pa.array(end[stop - 1], pa.int32())], ["start", "end"])
    labels = [values.field(k).take(pa.array(first)) for k in ("prediction", "gold_label", "prob")]
    out = pa.StructArray.from_arrays([whole, hull, *labels], ["string", "offset", "prediction", "gold_label", "prob"])
    return flat.list_array(np.searchsorted(first, bounds), out, null)


def merged_off_tokens(tokens: Column, specials=("[SEP]", "[CLS]")) -> Column:
    """Tokens without specials, each piece marked ## merged into the token before it; a leading one starts a token of its own.

    A merged token has its pieces' strings joined over their gaps, later ones without leading #, the hull of the offsets and the first one's
    labels. Arrow in and out, one pass over all of a batch's pieces.
    """

    @F.arrow_udf(f"array<{schema.TOKEN}>")
    def merged(column: pa.Array) -> pa.Array:
        return flat.by_chunks(column, lambda rows: _merged_off(rows, tuple(specials)))

    return merged(tokens)
