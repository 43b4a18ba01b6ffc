"""Fuzzy joins against term lists, and the dictionary tagger."""

from __future__ import annotations

from itertools import combinations, pairwise, product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein import schema
from skein.functions import flat, fuzzy
from skein.operators import catalogue

CUTOFF = 93.0
LENGTHS = 2
PREFIX = 10
#: Rows of a table that may be broadcast; a larger one is joined by shuffles.
SMALL = 1_000_000
#: Edits up to which a text near a term is also known by groups of so many segments without an edit. Groups, and places that they may have, grow fast.
FINE = 4
GROUPS = (2, 3, 4)


def vocabulary(terms: DataFrame, label: str = "label", term: str = "term") -> DataFrame:
    """Distinct (label, term, term_len), stripped, empty ones gone."""
    return terms.select(F.col(label).alias("label"), F.trim(F.col(term)).alias("term")).where("term <> ''").distinct().withColumn("term_len", F.length("term"))


def fuzzy_join(queries: DataFrame, query: str, terms: DataFrame, cutoff: float = CUTOFF, lengths: int = LENGTHS) -> DataFrame:
    """(query, label, term, score) of each distinct query and term whose lengths differ by at most `lengths` and whose score reaches cutoff.

    Each term is repeated for the lengths it can meet, so this is an equi join on length, and the bound that lengths give comes before the score.
    """
    around = F.explode(F.sequence(F.col("term_len") - lengths, F.col("term_len") + lengths)).alias("__len")
    near = terms.select("label", "term", around)
    asked = queries.select(F.col(query).alias("query")).where(F.col("query").isNotNull()).distinct().withColumn("__len", F.length("query"))
    pairs = asked.join(near, "__len").where(fuzzy.may_reach(F.col("query"), F.col("term"), cutoff))
    return pairs.withColumn("score", fuzzy.ratio_column("query", "term")).where(F.col("score") >= cutoff).select("query", "label", "term", "score")


def best_match(matches: DataFrame) -> DataFrame:
    """(query, label, term, score) of the highest score of each query; the first term and label win ties."""
    best = F.min(F.struct((-F.col("score")).alias("less"), "term", "label", "score")).alias("m")
    return matches.groupBy("query").agg(best).select("query", "m.label", "m.term", "m.score")


def fuzzy_members(df: DataFrame, column: str, terms: DataFrame, above: float = 90.0) -> DataFrame:
    """df's rows whose column scores above `above` against any term, whatever the lengths."""
    asked = df.select(F.col(column).alias("__q")).where("__q is not null").distinct()
    # a score above the bound holds lengths within a factor: terms are met by bands of that factor
    band = lambda c: F.floor(F.log(F.length(c).cast("double")) / F.log(F.lit(200.0 / above - 1.0)))
    wide = terms.where("term <> ''").select("term", F.explode(F.sequence(band(F.col("term")) - 1, band(F.col("term")) + 1)).alias("__b"))
    pairs = asked.where("__q <> ''").withColumn("__b", band(F.col("__q"))).join(wide, "__b").where(fuzzy.may_reach(F.col("__q"), F.col("term"), above))
    hits = pairs.where(fuzzy.ratio_column("__q", "term") > above).select("__q").distinct()
    return df.join(hits, df[column] == hits["__q"], "left_semi")


def _edits(total: Column, cutoff: float) -> Column:
    """Insertions and deletions that the cutoff leaves two texts of so many characters in all."""
    return F.floor(F.lit(1 - cutoff / 100) * total + 1e-9).cast("int")


def _cut(length: Column, edits: Column) -> tuple[Column, Column]:
    """Start and size of segment __at of a text that is cut into one segment more than it may have edits."""
    start = F.floor(F.col("__at") * length / (edits + 1)).cast("int")
    return start, F.floor((F.col("__at") + 1) * length / (edits + 1)).cast("int") - start


def _segments(texts: DataFrame, cutoff: float, lengths: int) -> DataFrame:
    """texts (text and others) with (__n, __at, __piece) of each segment."""
    n = F.length("text")
    rows = texts.withColumn("__n", n).withColumn("__at", F.explode(F.sequence(F.lit(0), _edits(2 * n + lengths, cutoff))))
    start, size = _cut(F.col("__n"), _edits(2 * F.col("__n") + lengths, cutoff))
    return rows.withColumn("__piece", F.col("text").substr(start + 1, size))


def _pieces(terms: DataFrame, cutoff: float, lengths: int) -> DataFrame:
    """(__n, __at, __piece, term): what a text of length __n has in its segment __at if that one has no edit and the text is near enough to term.

    Edits have the parity of the difference of the lengths. No edit stands before the first segment, and all of them before the last one, which
    gives these their places in the term; those between move by the edits at most. Without any edit the first segment will do.
    """
    rows = terms.select("term").distinct().withColumn("__n", F.explode(F.sequence(F.length("term") - lengths, F.length("term") + lengths))).where("__n > 0")
    rows = rows.withColumn("__more", F.length("term") - F.col("__n")).withColumn("__most", _edits(F.length("term") + F.col("__n"), cutoff))
    rows = rows.where(F.abs("__more") <= F.col("__most")).withColumn("__most", F.col("__most") - (F.col("__most") - F.abs("__more")) % 2)
    rows = rows.withColumn("__edits", _edits(2 * F.col("__n") + lengths, cutoff))
    rows = rows.withColumn("__at", F.explode(F.sequence(F.lit(0), F.when(F.col("__most") == 0, 0).otherwise(F.col("__edits")))))
    low = F.when(F.col("__at") == 0, 0).when(F.col("__at") == F.col("__edits"), F.col("__more")).otherwise(-(F.col("__most") - F.col("__more")) / 2).cast("int")
    high = F.when(F.col("__at") == 0, 0).when(F.col("__at") == F.col("__edits"), F.col("__more")).otherwise((F.col("__most") + F.col("__more")) / 2).cast("int")
    start, size = _cut(F.col("__n"), F.col("__edits"))
    rows = rows.withColumn("__size", size).withColumn("__place", F.explode(F.transform(F.sequence(low, high), lambda move: start + move))).where("__place >= 0")
    piece = F.col("term").substr(F.col("__place") + 1, F.col("__size"))
    return rows.withColumn("__piece", piece).where(F.length("__piece") == F.col("__size")).select("__n", "__at", "__piece", "term").distinct()


def _small(df: DataFrame) -> DataFrame:
    """df, broadcast if it has up to SMALL rows."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def scored(texts: DataFrame, terms: DataFrame, cutoff: float = CUTOFF, lengths: int = LENGTHS) -> DataFrame:
    """texts (text and others) with label, term and score of each term (label, term) whose score reaches the cutoff, some more than once.

    An equi join on length and one segment; edit distance, then the score, are counted for pairs that meet there only. Terms whose length differs
    by more than `lengths` don't count.
    """
    pairs = _segments(texts, cutoff, lengths).join(_small(_pieces(terms, cutoff, lengths)), ["__n", "__at", "__piece"])
    pairs = pairs.where(F.levenshtein("text", "term") <= _edits(F.length("text") + F.length("term"), cutoff))
    pairs = pairs.withColumn("score", F.when(F.col("text") == F.col("term"), 100.0).otherwise(fuzzy.ratio_column("text", "term"))).where(F.col("score") >= cutoff)
    return pairs.join(_small(terms.select("label", "term").distinct()), "term").select(*texts.columns, "label", "term", "score")


def prefixes(df: DataFrame, tokens: str, longest: int, prefix: int = PREFIX) -> DataFrame:
    """For each token, the texts of the prefixes of its run of O tokens, as (first, n tokens, text) beside df's other columns: `prefix` tokens
    and `longest` characters at most. All prefixes of one token come first, then of two, each from those before."""
    plain = lambda t: F.when(t["prediction"] == "O", t["string"])
    gap = lambda t, i: F.repeat(F.lit(" "), t["offset"]["start"] - F.get(F.col(tokens), i - 1)["offset"]["end"])
    rest = [c for c in df.columns if c != tokens]
    rows = df.select(*rest, F.transform(tokens, plain).alias("__1"), F.transform(tokens, lambda t, i: F.concat(F.coalesce(gap(t, i), F.lit("")), plain(t))).alias("__next"))
    for n in range(2, prefix + 1):
        longer = lambda a, b: F.when(F.length(a) + F.length(b) <= longest, F.concat(a, b))
        rows = rows.withColumn(f"__{n}", F.zip_with(f"__{n - 1}", F.slice("__next", F.lit(n), F.greatest(F.lit(0), F.size("__next"))), longer))
    rows = rows.select(*rest, F.posexplode(F.array(*[f"__{n}" for n in range(1, prefix + 1)])).alias("n", "texts"))
    rows = rows.select(*rest, (F.col("n") + 1).alias("n"), F.posexplode("texts").alias("first", "text"))
    return rows.where(F.length("text").between(1, longest))


_HITS = T.ArrayType(T.StructType([T.StructField(n, k) for n, k in (("first", T.IntegerType()), ("n", T.IntegerType()), ("label", T.StringType()), ("after", T.IntegerType()))]))


def _kept(hits) -> list[dict]:
    """Of hits (first, n, label) in order, those that begin where no earlier one that is kept reaches, with the end of the one before."""
    kept, after = [], 0
    for hit in hits:
        if hit["first"] >= after:
            kept.append({**hit, "after": after})
            after = hit["first"] + hit["n"]
    return kept


@F.arrow_udf(_HITS)
def _left_to_right(column: pa.Array) -> pa.Array:
    return pa.array([_kept(hits) for hits in column.to_pylist()], pa.list_(pa.struct([("first", pa.int32()), ("n", pa.int32()), ("label", pa.string()), ("after", pa.int32())])))


def _merged(run: Column, label: Column) -> Column:
    """A run of tokens as one with the label; pieces lose their marks."""
    first, last = run[0], F.element_at(run, -1)
    start = F.struct(first["offset"]["end"].alias("end"), first["string"].alias("text"))
    step = lambda s, t: F.struct(t["offset"]["end"].alias("end"), F.concat(s["text"], F.repeat(F.lit(" "), t["offset"]["start"] - s["end"]), F.ltrim(t["string"], F.lit("#"))).alias("text"))
    text = F.aggregate(F.slice(run, F.lit(2), F.size(run)), start, step, lambda s: s["text"])
    offset = F.struct(first["offset"]["start"].alias("start"), last["offset"]["end"].alias("end"))
    return F.struct(text.alias("string"), offset.alias("offset"), label.alias("prediction"), first["gold_label"].alias("gold_label"), first["prob"].alias("prob"))


class _Runs:
    """The prefixes of runs of O tokens, as `prefixes` has them, as stretches of one string."""

    def __init__(self, column: pa.Array, longest: int, prefix: int):
        self.bounds, self.values, self.null = flat.lists(column)
        values, sizes = self.values, np.diff(self.bounds)
        codes, at = flat.points(values.field("string"))
        own = np.diff(at)
        offset = values.field("offset")
        self.start, self.end = (offset.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("start", "end"))
        gap = np.concatenate([[0], np.clip(self.start[1:] - self.end[:-1], 0, longest + 1)])[: len(own)]
        self.stop = np.cumsum(gap + own)
        self.begin = self.stop - own
        line = np.full(int(self.stop[-1]) if len(own) else 0, 32, np.uint32)
        line[np.arange(len(codes)) + np.repeat(self.begin - at[:-1], own)] = codes
        self.line, self.sums = line, flat.sums(line)
        plain = pc.fill_null(pc.equal(values.field("prediction"), "O"), False).to_numpy(zero_copy_only=False)
        broken = np.where(plain, len(plain), np.arange(len(plain)))
        reach = np.minimum(np.minimum.accumulate(broken[::-1])[::-1], np.repeat(self.bounds[1:], sizes))
        self.limit = np.minimum(reach, np.arange(len(reach)) + prefix).astype(np.int32)
        self.last = np.full(len(line) + longest + 1, np.iinfo(np.int32).max, np.int32)  # the first token that ends at a place
        some = np.flatnonzero(np.diff(self.stop, prepend=-1))
        self.last[self.stop[some]] = some
        self.rolls, self.text = {}, None

    def ends(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last tokens of the prefixes of so many characters; of those with the same text the shortest."""
        last = self.last[self.begin + length]
        first = np.flatnonzero(last < self.limit)
        return first, last[first]

    def rolled(self, begin: np.ndarray, size: int) -> np.ndarray:
        """flat.rolled of stretches of one size. Those of all places are kept: for sizes that are asked for often."""
        if size not in self.rolls:
            self.rolls[size] = flat.rolled(self.sums, size)
        return self.rolls[size][begin]

    def texts(self, begin: np.ndarray, length: int) -> list[str]:
        if self.text is None:
            self.text = self.line.tobytes().decode("utf-32-le")
        return [self.text[b : b + length] for b in begin.tolist()]


def _salts(n: np.ndarray, at: int | np.ndarray) -> np.ndarray:
    return np.asarray(n).astype(np.int64) * 1024 + at


def _filter(spark, slots: DataFrame) -> np.ndarray:
    """Bits of the slots (slot), put together by the executors."""
    words = slots.groupBy(F.expr("shiftright(slot, 6)").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")).toArrow()
    table = np.zeros(flat.FILTER // 64, np.int64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy()
    return table.view(np.uint8)


def _piece_slots(batches):
    for batch in batches:
        codes, at = flat.points(batch.column("__piece"))
        salts = _salts(batch.column("__n").to_numpy(zero_copy_only=False), batch.column("__at").to_numpy(zero_copy_only=False).astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(flat.slots(flat.rolls(flat.sums(codes), at[:-1], np.diff(at)), salts)))], ["slot"])


def _least_edits(n: np.ndarray, m: np.ndarray, cutoff: float) -> np.ndarray:
    """The most edits between texts of lengths n and m that the cutoff leaves, of the parity of n - m; -1 if the lengths differ by more."""
    most = np.floor((1 - cutoff / 100) * (n + m) + 1e-9).astype(np.int64)
    return np.where(np.abs(m - n) > most, -1, most - (most - np.abs(m - n)) % 2)


def _groups(edits: int, k: int) -> list[tuple[int, ...]]:
    """Of the segments of a text that is cut into k more than it has edits, any k."""
    return list(combinations(range(edits + k), k))


def _group_cuts(n, edits: int, k: int) -> list[tuple]:
    """Starts and sizes of the segments that groups of k are of, in texts of length n."""
    low = [at * n // (edits + k) for at in range(edits + k + 1)]
    return [(a, b - a) for a, b in pairwise(low)]


def _group_salt(n, edits: int, group: tuple[int, ...]):
    return ((n * 8 + len(group)) * 8 + edits) * 1024 + sum(1 << i for i in group)


def _moves(edits: int, more: int, group: tuple[int, ...]) -> list[tuple[int, ...]]:
    """How far the segments of a group may stand from their places in the text, in a term that is longer by `more`. No edit stands before the
    first segment or behind the last one; elsewhere there are as many edits at least as the places move by."""
    last, any_ = edits + len(group) - 1, range(-((edits - more) // 2), (edits + more) // 2 + 1)
    ways = product(*[(0,) if i == 0 else (more,) if i == last else any_ for i in group])
    return [way for way in ways if sum(abs(b - a) for a, b in pairwise((0, *way, more))) <= edits]


def _group_slots(terms: pa.Array, cutoff: float, lengths: int) -> np.ndarray:
    """Slots of what any text near enough to one of the terms, by up to FINE edits, holds in groups of segments without an edit."""
    codes, at = flat.points(terms)
    sums, m, out = flat.sums(codes), np.diff(at), [np.zeros(0, np.int64)]
    for more in range(-lengths, lengths + 1):
        edits = np.where(m > more, _least_edits(m - more, m, cutoff), -1)
        for e in range(FINE + 1):
            rows = np.flatnonzero(edits == e)
            n, size = m[rows] - more, m[rows]
            for k, group in ((k, g) for k in GROUPS for g in _groups(e, k) if len(rows)):
                cuts = _group_cuts(n, e, k)
                for way in _moves(e, more, group):
                    moved = [(cuts[i][0] + x, cuts[i][1]) for i, x in zip(group, way)]
                    there = np.flatnonzero(np.all([(low >= 0) & (low + width <= size) for low, width in moved], axis=0))
                    rolls = [flat.rolls(sums, at[rows][there] + low[there], width[there]) for low, width in moved]
                    out.append(flat.slots(flat.joined(rolls), _group_salt(n, e, group)[there]))
    return np.unique(np.concatenate(out))


class _Near:
    """Finds the stretches of runs that may be near a term, by filters of what the terms' segments hold: of single ones, then of groups."""

    def __init__(self, one: np.ndarray, more: np.ndarray, shortest: int, longest: int, cutoff: float, lengths: int):
        self.one, self.more, self.cuts = one, more, {}
        for n in range(max(1, shortest - lengths), longest + 1):
            edits = int(np.floor((1 - cutoff / 100) * (2 * n + lengths) + 1e-9))
            kinds = {int(_least_edits(np.int64(n), np.int64(n + d), cutoff)) for d in range(-lengths, lengths + 1) if n + d > 0} - {-1}
            groups = [[self._kind(n, e, k) for e in sorted(kinds)] for k in GROUPS]
            self.cuts[n] = _group_cuts(n, edits, 1), [] if max(kinds, default=0) > FINE else groups

    @staticmethod
    def _kind(n: int, edits: int, k: int) -> tuple:
        """Segments, groups of them, a row for each place in a group, and the groups' salts."""
        groups = _groups(edits, k)
        return _group_cuts(n, edits, k), np.array(groups).T, np.array([[_group_salt(n, edits, g)] for g in groups])

    def __call__(self, runs: _Runs, length: int) -> np.ndarray:
        """Where those of one length begin."""
        begin = runs.begin[runs.ends(length)[0]]
        single, steps = self.cuts[length]
        found = np.zeros(len(begin), bool)
        for at, (low, size) in enumerate(single):
            found |= flat.may_hold(self.one, flat.slots(runs.rolled(begin + low, size), _salts(np.int64(length), at)))
        for kinds in steps:
            begin = begin[found]
            found = np.zeros(len(begin), bool)
            for cuts, groups, salts in kinds if len(begin) else ():
                rolls = np.stack([runs.rolled(begin + low, size) for low, size in cuts])
                found |= flat.may_hold(self.more, flat.slots(flat.joined([rolls[row] for row in groups]), salts)).any(axis=0)
        return begin[found]


def candidates(df: DataFrame, tokens: str, terms: DataFrame, shortest: int, longest: int, cutoff: float = CUTOFF, prefix: int = PREFIX, lengths: int = LENGTHS) -> DataFrame:
    """(text): distinct prefixes, as of `prefixes`, with at least each one that `scored` finds; most others don't come.

    A prefix comes if one of its segments, and groups of those of finer cuts, may be among what the terms have there, by filters of fixed size.
    shortest: length of a term at least; longest: of a prefix at most.
    """
    spark = df.sparkSession

    def group_slots(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_group_slots(batch.column("term"), cutoff, lengths))], ["slot"])

    one = _filter(spark, _pieces(terms, cutoff, lengths).mapInArrow(_piece_slots, "slot long"))
    more = _filter(spark, terms.select("term").distinct().mapInArrow(group_slots, "slot long"))
    bits = spark.sparkContext.broadcast((one, more))

    @F.arrow_udf("array<string>")
    def texts(column: pa.Array) -> pa.Array:
        """A batch's texts, all in its first row."""
        out, near = set(), _Near(*bits.value, shortest, longest, cutoff, lengths)
        for a, b in flat.chunks(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)):
            runs = _Runs(column.slice(a, b - a), longest, prefix)
            for length in near.cuts:
                out.update(runs.texts(near(runs, length), length))
        return pa.array([list(out)] + [[]] * (len(column) - 1) if len(column) else [], pa.list_(pa.string()))

    # a column of its own, else the tokens would go to the JVM and back before it; not deterministic, as a row's texts are its batch's: Spark
    # would else infer a filter of rows with texts, run it before, and find fewer in the rows that are left
    return df.select(texts.asNondeterministic()(tokens).alias("texts")).select(F.explode("texts").alias("text")).distinct()


class _Best:
    """The best (less score, label) of each text that has one, in flat arrays: a worker holds many."""

    def __init__(self, rows: pa.Table):
        strings, rolls = rows["text"].combine_chunks(), [np.zeros(0, np.uint64)]
        sizes = pc.utf8_length(strings).to_numpy(zero_copy_only=False)
        for a, b in flat.chunks(sizes):
            codes, at = flat.points(strings.slice(a, b - a))
            rolls.append(flat.rolls(flat.sums(codes), at[:-1], np.diff(at)))
        rolls = np.concatenate(rolls)
        order = np.argsort(rolls)
        self.rolls, self.lengths, self.bits = rolls[order], np.unique(sizes).tolist(), np.zeros(flat.FILTER // 8, np.uint8)
        at, order = flat.slots(self.rolls), pa.array(order)
        np.bitwise_or.at(self.bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        self.strings, self.score = strings.take(order), rows["score"].combine_chunks().take(order)
        self.label = rows["label"].combine_chunks().dictionary_encode().take(order)

    def near(self, rolls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of some texts, by their 64 bits, are found, and the first place of each of these."""
        some = np.flatnonzero(flat.may_hold(self.bits, flat.slots(rolls)))
        at = np.searchsorted(self.rolls, rolls[some])
        there = (at < len(self.rolls)) & (np.append(self.rolls, np.uint64(0))[at] == rolls[some])
        return some[there], at[there]

    def get(self, texts: list[str], at: np.ndarray) -> list[tuple[float, str] | None]:
        """(less score, label) of texts with the places of `near`. Other texts may have the same 64 bits."""
        places = pa.array(at)
        out = list(zip(self.score.take(places).to_pylist(), self.label.take(places).to_pylist()))
        for i, (text, string) in enumerate(zip(texts, self.strings.take(places).to_pylist())):
            if text != string:
                end = int(np.searchsorted(self.rolls, self.rolls[at[i]], "right"))
                out[i] = next(((self.score[j].as_py(), self.label[j].as_py()) for j in range(at[i], end) if self.strings[j].as_py() == text), None)
        return out


def _retag(column: pa.Array, best: _Best, longest: int, prefix: int) -> pa.Array:
    """Tokens retagged by the best (less score, label) of each text that has one."""
    runs = _Runs(column, longest, prefix)
    hits: dict[int, tuple] = {}
    for length in best.lengths:
        first, last = runs.ends(length)
        begin = runs.begin[first]
        near, at = best.near(flat.rolls(runs.sums, begin, length))
        for i, j, found in zip(first[near].tolist(), last[near].tolist(), best.get(runs.texts(begin[near], length), at)):
            if found:
                hit = (*found, j - i + 1)
                hits[i] = min(hits.get(i, hit), hit)
    values, kept = runs.values, np.ones(len(runs.values), bool)
    strings, after, firsts, texts, labels = values.field("string"), 0, [], [], []
    end = runs.end.copy()
    for i in sorted(hits):  # in order of documents: no hit reaches over its document's end
        if i < after:
            continue
        _, label, n = hits[i]
        after = i + n
        kept[i + 1 : after] = False
        end[i] = runs.end[after - 1]
        text = strings[i].as_py()
        for j in range(i + 1, after):
            text += " " * int(runs.start[j] - runs.end[j - 1]) + strings[j].as_py().lstrip("#")
        firsts.append(i)
        texts.append(text)
        labels.append(label)
    mask = np.zeros(len(values), bool)
    mask[firsts] = True
    strings = pc.replace_with_mask(strings, pa.array(mask), pa.array(texts, pa.string()))
    predictions = pc.replace_with_mask(values.field("prediction"), pa.array(mask), pa.array(labels, pa.string()))
    offset = pa.StructArray.from_arrays([pa.array(runs.start, pa.int32()), pa.array(end, pa.int32())], ["start", "end"])
    out = pa.StructArray.from_arrays([strings, offset, predictions, values.field("gold_label"), values.field("prob")], ["string", "offset", "prediction", "gold_label", "prob"])
    return flat.list_array(np.concatenate([[0], np.cumsum(kept)])[runs.bounds], out.filter(pa.array(kept)), runs.null)


def tagged(df: DataFrame, tokens: str, terms: DataFrame, cutoff: float = CUTOFF, prefix: int = PREFIX) -> DataFrame:
    """df with its array of tokens retagged from terms (label, term).

    Left to right: at an O token, the best-scoring prefix of its run of O tokens becomes one token with the label; the shortest
    prefix and the first label by name win ties. Other tokens pass. Null and empty arrays stay as they are.

    The distinct prefixes that may be near a term are scored by joins, for vocabularies of any size. Up to SMALL texts with a score go to
    every executor, which retags row by row; more are joined with the prefixes, and the hits go back to their tokens by a hash of the array.
    """
    terms = terms.select("label", "term").where("term <> ''").distinct()
    shortest, longest = terms.agg(F.min(F.length("term")), F.max(F.length("term"))).first()
    if longest is None:
        return df
    longest += LENGTHS
    df = catalogue.batched(df)
    best = scored(candidates(df, tokens, terms, shortest, longest, cutoff, prefix), terms, cutoff).groupBy("text").agg(F.min(F.struct((-F.col("score")).alias("score"), "label")).alias("hit"))
    rows = best.select("text", "hit.score", "hit.label").limit(SMALL + 1).toArrow()
    if rows.num_rows > SMALL:
        return _tagged_by_joins(df, tokens, best, longest, prefix)
    found = df.sparkSession.sparkContext.broadcast(_Best(rows))

    @F.arrow_udf(f"array<{schema.TOKEN}>")
    def retag(column: pa.Array) -> pa.Array:
        return flat.by_chunks(column, lambda rows: _retag(rows, found.value, longest, prefix))

    return df.withColumn(tokens, retag(tokens))


def _tagged_by_joins(df: DataFrame, tokens: str, best: DataFrame, longest: int, prefix: int) -> DataFrame:
    key = [F.xxhash64(tokens).alias("__a"), F.xxhash64(F.lit(1), tokens).alias("__b")]
    texts = prefixes(df.select(*key, tokens), tokens, longest, prefix)
    hits = texts.join(best, "text").groupBy("__a", "__b", "first").agg(F.min(F.struct("hit.score", "hit.label", "n")).alias("hit"))
    hits = hits.groupBy("__a", "__b").agg(F.array_sort(F.collect_list(F.struct("first", F.col("hit.n").alias("n"), F.col("hit.label").alias("label")))).alias("__hits"))
    hits = hits.withColumn("__hits", _left_to_right("__hits"))
    column, found = F.col(tokens), F.col("__hits")
    between = F.transform(found, lambda h: F.concat(F.slice(column, h["after"] + 1, h["first"] - h["after"]), F.array(_merged(F.slice(column, h["first"] + 1, h["n"]), h["label"]))))
    end = F.element_at(found, -1)["first"] + F.element_at(found, -1)["n"]
    retagged = F.concat(F.flatten(between), F.slice(column, end + 1, F.size(column)))
    keyed = df.select("*", *key).join(hits, ["__a", "__b"], "left")
    return keyed.withColumn(tokens, F.when(found.isNotNull(), retagged).otherwise(column)).select(*df.columns)
