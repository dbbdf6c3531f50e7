"""Benchmark decontamination by template canonicalisation, with DataFrame functions alone.

Numbers, units after a number and names inside a sentence become typed placeholders; the other words are lower-cased
and freed of punctuation. A template window is WINDOW such words, a plain window WINDOW words without placeholders;
an item of fewer words is one window as a whole. All windows of the benchmark meet those that begin at any word of
the documents in a hash join, for which a bitmap of the benchmark's hashes picks the documents' windows: plain windows with plain ones, so that a verbatim copy counts whatever its case, white
space and share of placeholders, and template windows of LITERALS words or more with template windows. Windows of one
document and item that are displaced alike form an alignment; its slots are consistent if equal values of the item
stand for equal values in the document, and different ones for different ones. A consistent alignment that covers enough words is a leak, verbatim if the
values are the item's own, re-parameterised if they differ.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 8
LITERALS = 4  # words of a benchmark's template window that are no placeholders, at least; the others match by their values
COVERED = 12  # words that an alignment covers, at least; a window is enough for items of fewer than SHORT words
SHORT = 15
IN_ALL = 24  # words that all alignments of an item cover, at least, where none covers enough
MARKS = 1 << 22  # bits of the constant that tells the benchmark's windows from others
SMALL = 1 << 26  # bytes of benchmark windows, as estimated, that may be broadcast

# Placeholders: characters for private use, which count as words.
NAME, NUMBER, UNIT = "\ue000", "\ue001", "\ue002"
POINT = "\ue003"  # stands for a decimal separator inside a number

# Units, which are placeholders where they follow a number.
UNITS = (
    "km m cm mm mi ft in yd kg g mg lb lbs oz t l ml gal s sec min h hr hrs ms "
    "kilometers kilometres meters metres centimeters miles feet inches yards grams kilograms pounds ounces tons liters litres gallons "
    "seconds minutes hours days weeks months years percent dollars euros cents degrees mph kph usd eur gb mb kb"
).split()


def canonical(text: Column) -> tuple[Column, Column]:
    """(template words, the words themselves): arrays of equal length."""
    # a pattern begins with what it consumes and only then looks behind, so that few places are tried
    units = rf"(?i:{'|'.join(UNITS)})\b"
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), "[\ue000-\ue003\\s\\p{Z}]+", " ")
    plain = F.regexp_replace(plain, r",(?<=\d,)(?=\d{3}(?!\d))", "")
    plain = F.regexp_replace(plain, r"[.,](?<=\d.)(?=\d)", POINT)
    plain = F.regexp_replace(plain, rf"\d(?={units})", "$0 ")
    marked = F.regexp_replace(plain, r"\p{Lu}(?<=[\p{Ll},;] .)\p{Ll}+", NAME)
    marked = F.regexp_replace(marked, rf"\p{{Nd}}(?<![\p{{L}}\p{{N}}{POINT}].)\p{{Nd}}*+(?:{POINT}\p{{Nd}}++)*+(?![\p{{L}}\p{{N}}{POINT}])", NUMBER)
    marked = F.regexp_replace(marked, rf"{NUMBER} {units}", f"{NUMBER} {UNIT}")
    words = lambda c: F.split(F.trim(F.regexp_replace(c, "[^\\p{L}\\p{N}\ue000-\ue003]+", " ")), " ")
    template = words(F.lower(marked))
    return template, F.when(marked == plain, template).otherwise(words(F.lower(plain)))


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.transform(F.array(value), f)[0]


def hashes(words: Column, length: int) -> Column:
    """The hash of every run of so many words, by its first word."""
    if length < WINDOW:
        starts = F.when(F.size(words) >= length, F.sequence(F.lit(0), F.size(words) - length)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(F.slice(words, i + 1, length)))
    out, reach = F.transform(words, lambda w: F.xxhash64(w)), 1
    doubled = lambda k: lambda h: F.zip_with(h, F.slice(h, k + 1, F.size(h)), lambda a, b: F.xxhash64(a, b))
    while reach < WINDOW:  # a power of two
        out = once(out, doubled(reach))
        reach *= 2
    return F.slice(out, 1, F.greatest(F.size(words) - WINDOW + 1, F.lit(0)))


def bitmap(wanted: DataFrame) -> Callable[[Column], Column]:
    """Whether a hash may be one of `wanted`, by a constant of MARKS bits at most; its words are added up in the plan."""
    number = wanted.count()
    bits = 1 << min(MARKS.bit_length() - 1, max(16, (16 * number).bit_length()))
    place = F.col("h").bitwiseAND(F.lit(bits - 1))
    found = wanted.select(F.shiftright(place, 6).alias("k"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("b")).groupBy("k").agg(F.expr("bit_or(b)").alias("b")).collect()
    words = [0] * (bits >> 6)
    for r in found:
        words[r.k] = r.b
    constant = F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")
    return lambda h: F.getbit(F.get(constant, F.shiftright(h.bitwiseAND(F.lit(bits - 1)), 6).cast("int")), h.bitwiseAND(F.lit(63)).cast("int")) == 1


def windows(table: DataFrame, lengths: list[int], *keep: str, whole: bool = False, may: Callable[[Column], Column] | None = None) -> DataFrame:
    """keep, position, h (hash of the window), w (its words), c (the words that were hashed, with whole alone).

    Template windows, and plain windows where those differ; with `may`, only those whose hash it accepts, so that
    words are taken out and rows are made for few places.
    """

    def of(length: int) -> Column:
        def rows(of: Column, h: Column, fits: Callable[[Column], Column] | None) -> Column:
            places = F.when(F.size(h) > 0, F.sequence(F.lit(0), F.size(h) - 1)).otherwise(F.array().cast("array<int>"))
            if fits:
                places = F.filter(places, fits)
            return F.transform(places, lambda i: F.struct(i.alias("position"), h[i].alias("h"), F.slice(F.col("words"), i + 1, length).alias("w"), *([F.slice(of, i + 1, length).alias("c")] if whole else [])))

        def both(h: Column) -> Column:
            first = rows(F.col("template"), h, (lambda i: may(h[i])) if may else None)
            other = lambda p: rows(F.col("words"), p, lambda i: (p[i] != h[i]) & may(p[i]) if may else p[i] != h[i])
            return F.when(F.col("template") == F.col("words"), first).otherwise(F.concat(first, once(hashes(F.col("words"), length), other)))

        return once(hashes(F.col("template"), length), both)

    # a filter on the template's size, or a generator that drops empty arrays, would have Catalyst build the template
    # and the windows once more for a filter below; so short texts give an empty array, and an outer generator one null
    parts = [of(n) for n in lengths]
    return table.select(*keep, F.inline_outer(F.concat(*parts) if len(parts) > 1 else parts[0]))


LEAKS = "doc_id, item_id, kind, n_windows, covered_words, coverage"


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and benchmark item that it leaks: LEAKS.

    Null and empty texts share no window and leak nothing; an item of fewer than WINDOW words is leaked as a whole
    or not at all. Null keys are kept apart by their text and come out as null; repeated rows give one row; an empty
    table on either side gives an empty result; other columns are not looked at. Long texts are searched whole.
    """
    template, words = canonical(F.col("t"))
    items = benchmark.select(F.col(item).cast("long").alias("item_id"), F.col(item_text).alias("t")).select("item_id", template.alias("template"), words.alias("words"))
    items = items.withColumn("item_words", F.size("template")).filter(F.col("words")[0] != "")
    short = sorted(r.item_words for r in items.filter(F.col("item_words") < WINDOW).select("item_words").distinct().collect())
    parts = [windows(items.filter(F.col("item_words") == n) if n < WINDOW else items.filter(F.col("item_words") >= n), [n], "item_id", "item_words", whole=True) for n in (*short, WINDOW)]
    wanted = reduce(DataFrame.unionByName, parts).filter("h is not null")
    is_slot = lambda x: x.rlike(f"[{NAME}{NUMBER}{UNIT}]")
    literals = F.size(F.filter("c", lambda x: ~is_slot(x)))
    wanted = wanted.filter((literals >= LITERALS) | (literals == F.size("c")))
    wanted = wanted.select("item_id", "item_words", F.col("position").alias("item_position"), "h", F.col("c").alias("item_c"), F.col("w").alias("item_w"))
    may = bitmap(wanted)
    size = wanted.agg(F.sum(F.octet_length(F.concat_ws(" ", "item_c", "item_w")) + 64 * F.size("item_w") + 100)).first()[0] or 0
    if 0 < size <= SMALL:
        wanted = F.broadcast(wanted)
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("t")).filter("length(t) > 0")
    texts = texts.select("doc_id", "text_hash", template.alias("template"), words.alias("words"))
    found = windows(texts, [*short, WINDOW], "doc_id", "text_hash", may=may).join(wanted, "h")
    # not as a plain equality, from which Catalyst would infer the benchmark's filters for every window
    slot = F.transform(F.arrays_zip("item_c", "item_w", "w"), lambda s: F.struct(s["item_c"].alias("kind"), s["item_w"].alias("was"), s["w"].alias("now")))
    found = found.withColumn("slots", slot).filter(F.coalesce(F.forall("slots", lambda s: is_slot(s["kind"]) | (s["kind"] == s["now"])), F.lit(False)))
    found = found.withColumn("slots", F.filter("slots", lambda s: is_slot(s["kind"])))
    offset = F.col("position") - F.col("item_position")
    aligned = found.groupBy("doc_id", "text_hash", "item_id", "item_words", offset.alias("offset")).agg(F.collect_set("item_position").alias("at"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"))
    pairs = F.col("slots")
    values = lambda side: F.size(F.array_distinct(F.transform(pairs, lambda s: F.struct(s["kind"], s[side]))))
    changed = F.exists(pairs, lambda s: s["was"] != s["now"])
    covered = F.size(F.array_distinct(F.flatten(F.transform("at", lambda p: F.sequence(p, p + F.least(F.lit(WINDOW), F.col("item_words")) - 1)))))
    consistent = aligned.filter((values("was") == F.size(pairs)) & (values("now") == F.size(pairs))).withColumn("changed", changed).withColumn("n", F.size("at")).withColumn("covered", covered)
    enough = F.when(F.col("item_words") < SHORT, F.least(F.lit(WINDOW), F.col("item_words"))).otherwise(COVERED)
    per_item = consistent.groupBy("doc_id", "text_hash", "item_id", "item_words").agg(F.max("n").alias("best"), F.max("covered").alias("covered"), F.sum("covered").alias("total"), F.bool_or("changed").alias("changed"))
    hit = per_item.filter((F.col("covered") >= enough) | (F.col("total") >= IN_ALL))
    hit = hit.groupBy("doc_id", "text_hash", "item_id").agg(F.bool_and("changed").alias("changed"), F.max("best").alias("n_windows"), F.max("covered").alias("covered_words"), F.max("item_words").alias("item_words"))
    return hit.groupBy("doc_id", "item_id").agg(
        F.when(F.bool_and("changed"), F.lit("re-parameterised")).otherwise(F.lit("verbatim")).alias("kind"), F.max("n_windows").cast("long").alias("n_windows"), F.max("covered_words").cast("long").alias("covered_words"), F.round(F.max(F.col("covered_words") / F.col("item_words")), 4).alias("coverage")
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", **columns) -> DataFrame:
    """The rows of docs whose key leaks no benchmark item, with all their columns; rows without a key stay.

    Null and empty texts leak nothing and stay; texts of any length are searched whole; repeated rows stay or go
    together; an empty table on either side takes nothing away; other columns may have any name.
    """
    from lodeframe.llm.scratch import written

    found = written(leaks(docs, benchmark, key=key, **columns).select(F.col("doc_id").alias("leaked")).filter("leaked is not null").distinct(), "leaked")
    return docs.join(found, docs[key].cast("long") == found["leaked"], "left_anti")
