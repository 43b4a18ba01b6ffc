"""Tokens, word pieces and overlapping segments."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import flat
from skein.functions.text import TOKEN_PATTERN

SPAN = "array<struct<string:string,offset:struct<start:int,end:int>>>"


def _spans(texts: pa.Array) -> pa.Array:
    raw, bytes_at = flat.utf8(texts)
    codes, bounds = flat.points(texts)
    kind = flat.classes()[codes]
    begins = np.zeros(len(codes) + 1, bool)
    begins[bounds] = True
    word = kind == flat.WORD
    after = np.concatenate([[False], word[:-1]]) if len(word) else word
    going = word & after & ~begins[:-1]
    starts = np.flatnonzero((kind != flat.SPACE) & ~going)
    gone = np.concatenate([[0], np.cumsum(going)])
    ends = starts + 1 + np.diff(gone[np.append(starts, len(codes))])
    lead = (raw & 0xC0) != 0x80
    place = np.append(np.flatnonzero(lead), len(raw))
    strings = flat.string_array(raw[(kind != flat.SPACE)[np.cumsum(lead) - 1]], place[ends] - place[starts])
    tokens = np.searchsorted(starts, bounds)
    own = np.repeat(bounds[:-1], np.diff(tokens))
    offset = pa.StructArray.from_arrays([pa.array(starts - own, pa.int32()), pa.array(ends - own, pa.int32())], ["start", "end"])
    return flat.list_array(tokens, pa.StructArray.from_arrays([strings, offset], ["string", "offset"]))


def token_spans(text: Column) -> Column:
    """Words and signs with their offsets in code points; no tokens for null. One pass over each text, Arrow in and out."""

    @F.arrow_udf(SPAN)
    def spans(texts: pa.Array) -> pa.Array:
        sizes = np.diff(flat.utf8(texts)[1])
        return pa.concat_arrays([_spans(texts.slice(a, b - a)) for a, b in flat.chunks(sizes)] or [_spans(texts)])

    return spans(text)


def token_strings(text: Column) -> Column:
    """The same tokens without offsets, by the JVM alone."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN_PATTERN), F.lit(0))


def vocabulary_pieces(text: Column, vocabulary: list[str], unknown: str = "[UNK]") -> Column:
    """Words cut greedily into the longest pieces of a vocabulary, later ones marked ##; a word that can't be is unknown."""
    known = set(vocabulary)

    @F.pandas_udf("array<string>")
    def pieces(texts: pd.Series) -> pd.Series:
        import regex

        pattern = regex.compile(TOKEN_PATTERN.replace(r"\s", r"\x09-\x0D\x20"))

        def cut(word: str) -> list[str]:
            out, at = [], 0
            while at < len(word):
                end = len(word)
                while end > at and ("##" if at else "") + word[at:end] not in known:
                    end -= 1
                if end == at:
                    return [unknown]
                out.append(("##" if at else "") + word[at:end])
                at = end
            return out

        return pd.Series([[p for m in pattern.finditer(t or "") for p in cut(m.group())] for t in texts])

    return pieces(text)


def merged_pieces(pieces: DataFrame, doc: str = "doc_id", specials=("[CLS]", "[PAD]")) -> DataFrame:
    """(doc, word, string, start, end, prediction) from rows (doc, pos, piece, start, end, prediction).

    Pieces from the first [SEP] on go, and so do specials; a piece that begins with ## belongs to the word before, its marks removed. A
    word has its first piece's label and the hull of the offsets. A leading ## starts a word of its own.
    """
    by = Window.partitionBy(doc).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = pieces.withColumn("__ended", F.max((F.col("piece") == "[SEP]").cast("int")).over(by)).where("__ended = 0").where(~F.col("piece").isin(*specials))
    rows = rows.withColumn("word", F.sum((~F.startswith("piece", F.lit("##"))).cast("int")).over(by))
    parts = F.array_sort(F.collect_list(F.struct("pos", F.regexp_replace("piece", "^##", "").alias("s"))))
    return rows.groupBy(doc, "word").agg(F.array_join(F.transform(parts, lambda p: p["s"]), "").alias("string"), F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("prediction", "pos").alias("prediction"))


def segment_starts(n: Column, max_length: int = 512, stride: int = 20) -> Column:
    """Starts of windows of max_length - 2 tokens over n tokens, each sharing `stride` tokens with the one before; one window at least."""
    size = max_length - 2
    step = size - stride
    last = F.ceil(F.greatest(F.lit(0), n - size) / F.lit(step)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: i * step)


def segments(tokens: Column, max_length: int = 512, stride: int = 20) -> Column:
    """Overlapping windows of an array, without special tokens."""
    return F.transform(segment_starts(F.size(tokens), max_length, stride), lambda s: F.slice(tokens, s + 1, F.lit(max_length - 2)))


def attention_mask(window: Column, max_length: int = 512) -> Column:
    """1 for the window's tokens and the two specials, 0 for padding."""
    n = F.size(window) + 2
    return F.transform(F.sequence(F.lit(1), F.lit(max_length)), lambda i: (i <= n).cast("tinyint"))


def merged_by_half_stride(windows: Column, stride: int = 20) -> Column:
    """One array again: the first half of an overlap from the window before, the second from the one after. stride 0: plain concatenation."""
    back, front = -(-stride // 2), stride // 2
    count = F.size(windows)

    def own(window: Column, i: Column) -> Column:
        begin = F.when(i == 0, F.lit(0)).otherwise(F.lit(front))
        end = F.when(i == count - 1, F.size(window)).otherwise(F.size(window) - back)
        return F.slice(window, begin + 1, F.greatest(F.lit(0), end - begin))

    return F.flatten(F.transform(windows, own))


def merged_by_suffix(windows: Column, stride: int) -> Column:
    """One array again: each later window without its first `stride` entries."""
    return F.flatten(F.transform(windows, lambda w, i: F.when(i == 0, w).otherwise(F.slice(w, F.lit(stride + 1), F.greatest(F.lit(0), F.size(w) - stride)))))


def merged_predictions(windows: Column, stride: int) -> Column:
    """merged_by_suffix for windows that still have a special at either end; a document of one window stays as it is, specials included."""
    bare = F.transform(windows, lambda w: F.slice(w, F.lit(2), F.greatest(F.lit(0), F.size(w) - 2)))
    return F.when(F.size(windows) == 1, windows[0]).otherwise(merged_by_suffix(bare, stride))
