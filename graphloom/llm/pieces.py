"""Splitting oversized texts at natural boundaries, with overlap.

Everything is a Spark SQL expression: a regular expression with bounded quantifiers cuts the text, array
functions give the pieces their overlap. Cuts lose nothing: the bodies of a text's pieces, joined, are the
text, and every piece is a substring of it.

*fixed* overlap. A body takes, greedily and within the size less the overlap, as much as ends at the strongest
boundary that lies in its second half: paragraph, sentence, clause, word, else at the strongest in its first half,
else a character that no combining mark follows, else any character. Each piece but the first begins ``fixed_overlap`` code points before its
body, so consecutive pieces share exactly that much.

*sentence window* overlap. Whole sentences are packed greedily into pieces within the size; only a sentence
longer than the size is cut, in the same way, into parts of at most size / (overlap + 1), which then count as
sentences. Each piece but the first begins with the last ``sentence_window_overlap`` sentences of the one
before. Where these and the next sentence exceed the size, it begins with as many of them as fit; where not even
the last one fits, with the words at its end that do; and before a sentence that fills the size, with none.

Positions and lengths are code points. Defined cases: a null or empty text gives no piece; a text within the
size gives one; a null or unknown config_id means the default configuration; an overlap that is null or not
below the size is taken as size - 1 at most; repeated rows of a chunk are cut once per row; extra columns are
carried through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.arrays import running_sums
from graphloom.functions.let import let

# What ends a sentence and a clause, with closing marks that belong to it.
_END = r"[.!?…。！？।॥؟۔]"
_CLOSE = r"[\"'”’»」』）)\]]"
# Stops that belong to an abbreviation or an initial, in the languages of the chunks.
_NO_END = (
    r"(?<![^\p{L}]\p{L}\.\s{1,9})"
    r"(?<![^\p{L}](?:Mrs|Mr|Ms|Messrs|Dr|Prof|Capt|St|No|vol|ver|approx|etc|Esq|Co|Sra|Sr|Mme|डॉ)\.\s{1,9})"
)
_CLAUSE = r"[,;:—–、，；：،]"


def _ladder(most: str, least: str) -> str:
    """Alternatives by strength of boundary, each taking as much as it can between ``least`` and ``most``; then
    the same from the first character on; then any character."""

    def boundaries(room: str) -> list[str]:
        return [
            rf"{room}(?<=\n\s{{0,9}}\n)",
            rf"{room}(?<={_END}{_CLOSE}{{0,3}}\s{{1,9}}){_NO_END}",
            rf"{room}(?<=[。！？।]{_CLOSE}{{0,3}})(?!{_CLOSE})",
            rf"{room}(?<={_CLAUSE}\s{{1,9}}|[、，；：])",
            rf"{room}(?<=\s)(?!\s)",
        ]

    early = boundaries(f".{{1,{least}}}")
    return "|".join([*boundaries(f".{{{least},{most}}}"), *early, rf".{{1,{most}}}(?![\p{{M}}\x{{200d}}])", rf".{{1,{most}}}"])


# One body: what fits whole is taken whole; <a> is the limit at the start of the text, <b> that elsewhere,
# <a2> and <b2> the halves of them.
_BODY = (
    r"(?s)\A.{1,<a>}\z|\A(?:" + _ladder("<a>", "<a2>") + r")|(?!\A)(?:.{1,<b>}\z|" + _ladder("<b>", "<b2>") + ")"
)
# One unit: the shortest within the size <a> that ends as a sentence or paragraph does, else a cut within the limit <b>.
_UNIT = (
    rf"(?s).{{1,<a>}}?(?:(?<=\n\s{{0,9}}\n)(?!\s)|(?<={_END}{_CLOSE}{{0,3}}\s{{1,9}}){_NO_END}(?!\s)|(?<=[。！？।]{_CLOSE}{{0,3}})(?![\s\"'”’»」』）)]|\])|\z)|"
    + _ladder("<b>", "<b2>")
)


def _filled_in(pattern: str, **limits: Column) -> Column:
    out = F.lit(pattern)
    for name, limit in limits.items():
        out = F.replace(out, F.lit(f"<{name}>"), limit.cast("string"))
        half = F.greatest(F.lit(1), (limit / 2).cast("int")).cast("string")
        out = F.replace(out, F.lit(f"<{name}2>"), half)
    return out


def _exact_overlap(size: Column, overlap: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.coalesce(overlap, F.lit(0)), size - 1))


def with_config(chunks: DataFrame, configs: DataFrame) -> DataFrame:
    """Adds size, overlap and by_sentence. The default configuration, one row, is read by the driver and becomes a
    literal; the others are joined by their id. Without any usable configuration nothing can be cut: an error."""
    fields = ("strategy", "fixed_size", "fixed_overlap", "sentence_window_overlap")
    usable = configs.where(F.col("config_id").isNotNull() & (F.col("fixed_size") > 0))
    first = usable.orderBy(F.coalesce("is_default", F.lit(False)).desc(), "config_id").select(*fields).limit(1).collect()
    if not first:
        raise ValueError("there is no configuration with a size")
    kinds = {"strategy": "string"}
    default = F.struct(*[F.lit(first[0][f]).cast(kinds.get(f, "int")).alias(f) for f in fields])
    typed = F.struct(*[F.col(f).cast(kinds.get(f, "int")).alias(f) for f in fields])
    own = usable.groupBy(F.col("config_id").alias("_cid")).agg(F.max(typed).alias("_c"))
    out = chunks.join(own, F.col("config_id") == F.col("_cid"), "left").withColumn("_cfg", F.coalesce("_c", default))
    by_sentence = F.coalesce(F.col("_cfg.strategy") == "sentence_window", F.lit(False))
    size = F.col("_cfg.fixed_size")
    wanted = F.when(by_sentence, F.col("_cfg.sentence_window_overlap")).otherwise(F.col("_cfg.fixed_overlap"))
    out = out.withColumn("size", size).withColumn("by_sentence", by_sentence).withColumn("overlap", _exact_overlap(size, wanted))
    return out.drop("_cid", "_c", "_cfg")


_SPAN = "ARRAY<STRUCT<start:INT,length:INT>>"


def _spans(parts: Column) -> Column:
    """(start, length) of consecutive parts."""
    return let(
        running_sums(F.transform(parts, F.length)),
        lambda at: F.transform(parts, lambda p, i: F.struct(at[i].alias("start"), F.length(p).alias("length"))),
    )


def _lookback(spans: Column, overlap: Column) -> Column:
    """Each span but the first begins ``overlap`` earlier."""
    back = lambda s: F.least(overlap, s["start"])
    return F.transform(
        spans, lambda s: F.struct((s["start"] - back(s)).alias("start"), (s["length"] + back(s)).alias("length"))
    )


# What of a sentence's end, with the character before it, cannot begin a piece: the rest of a word, or of a character.
_TORN = r"(?s)\A(?:\S*\s+(?=\S)|.[\p{M}\x{200d}]*(?=.))"


def _tail(text: Column, low: Column, end: Column) -> Column:
    """Where the words of text[low:end] begin; ``low`` is not 0. Without a space, where its characters do."""
    return end - F.least(end - low, F.length(F.regexp_replace(F.substring(text, low, end - low + 1), _TORN, "")))


def _packed(units: Column, size: Column, overlap: Column, text: Column) -> Column:
    """Greedy windows of consecutive units within ``size``, sharing ``overlap`` units or what fits of them."""
    zero = F.struct(F.lit(0).alias("head"), F.lit(0).alias("room"), F.lit(0).alias("i"), F.expr(f"CAST(array() AS {_SPAN})").alias("spans"))

    def step(acc: Column, u: Column) -> Column:
        fits = acc["room"] + u["length"] <= size
        # Units before ``low`` would not leave room for this one; all of them lie behind the head.
        low = u["start"] + u["length"] - size
        count = F.least(overlap, acc["i"])
        last = F.slice(units, acc["i"] - count + 1, count)
        shared = F.array_min(F.transform(F.filter(last, lambda s: s["start"] >= low), lambda s: s["start"]))
        rest = F.when(count > 0, _tail(text, low, u["start"])).otherwise(u["start"])
        head = F.when(fits, acc["head"]).otherwise(F.coalesce(shared, rest))
        done = F.array_append(acc["spans"], F.struct(acc["head"].alias("start"), acc["room"].alias("length")))
        return let(
            head,
            lambda h: F.struct(
                h.alias("head"),
                (u["start"] + u["length"] - h).alias("room"),
                (acc["i"] + 1).alias("i"),
                F.when(fits, acc["spans"]).otherwise(done).alias("spans"),
            ),
        )

    def finish(acc: Column) -> Column:
        last = F.struct(acc["head"].alias("start"), acc["room"].alias("length"))
        return F.when(F.size(units) > 0, F.array_append(acc["spans"], last)).otherwise(acc["spans"])

    return F.aggregate(units, zero, step, finish)


def pieces(chunks: DataFrame, configs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``chunks``, one per piece, with piece_pos (from 0), char_start, char_end and piece."""
    rows = with_config(chunks, configs).where(F.length(text) > 0)
    size, overlap = F.col("size"), F.col("overlap")
    rest = F.when(F.col("by_sentence"), F.greatest((size / (overlap + 1)).cast("int"), F.lit(1))).otherwise(size - overlap)
    pattern = F.when(F.col("by_sentence"), _filled_in(_UNIT, a=size, b=rest)).otherwise(_filled_in(_BODY, a=size, b=rest))
    # What is within the size is one part as it is; no pattern has to be tried on it.
    parts = F.when(F.length(text) <= size, F.array(F.col(text))).otherwise(F.regexp_extract_all(F.col(text), pattern, F.lit(0)))
    rows = rows.withColumn("_parts", parts)
    rows = rows.withColumn("_spans", _spans(F.col("_parts"))).drop("_parts")
    cut = F.when(F.col("by_sentence"), let(F.col("_spans"), lambda units: _packed(units, size, overlap, F.col(text)))).otherwise(_lookback(F.col("_spans"), overlap))
    rows = rows.withColumn("_pieces", cut).drop("_spans")
    rows = rows.select("*", F.posexplode("_pieces").alias("piece_pos", "_s")).drop("_pieces")
    return (
        rows.withColumn("char_start", F.col("_s.start"))
        .withColumn("char_end", F.col("_s.start") + F.col("_s.length"))
        .withColumn("piece", F.substring(F.col(text), F.col("_s.start") + 1, F.col("_s.length")))
        .drop("_s", "by_sentence", "overlap", "size")
    )
