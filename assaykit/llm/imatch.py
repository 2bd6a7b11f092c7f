"""I-Match fingerprints: terms of a chosen inverse-document-frequency band, sorted, hashed over randomised lexicon subsets.

A term is in the lexicon if its document frequency lies between two shares of all documents. As a document has a
bounded mean number of distinct terms, at most mean / ``least_share`` terms can reach the lower share, whatever the
size of the corpus. The lexicon goes to the texts as an array of bits of that bounded size, 32 a term: of the terms
outside it some 3 % share a bit with one inside and count as well, the same ones in every text.

The subsets are random parts of the lexicon, the same for all texts: ``SUBSETS`` of each of ``RATES`` rates, each rate a
quarter of the one before. A subset's value is the hash of its sorted distinct terms in the text. Sparse subsets
survive large edits, and long texts; dense ones tell short texts apart. Only DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit.llm.common import alnum_words, let, row_keys, same_row, stored

SUBSETS, RATES, EMPTY = 32, 4, -32768
TOLD_APART = 28  # of a rate's subsets; with more of them in use, two texts of half the same terms agree in none


def terms(text: Column) -> Column:
    """64-bit hashes of the distinct words, A-Z lower-cased."""
    return F.transform(F.array_distinct(alnum_words(text)), lambda w: F.xxhash64(w))


def lexicon(docs: DataFrame, text: str, *, least_share: float, most_share: float) -> DataFrame:
    """``h``: the hash of each term whose document frequency is in the band; every document counts."""
    n = docs.count()
    seen = docs.select(F.explode(terms(F.col(text))).alias("h")).groupBy("h").agg(F.count("*").alias("df"))
    return stored(seen.where((F.col("df") >= max(2, least_share * n)) & (F.col("df") <= max(2, most_share * n))).select("h"), "lexicon")


def lexicon_bits(lex: DataFrame) -> tuple[Column, int]:
    """The lexicon as a constant array of longs, a bit for each value of a hash's leading bits, 32 bits a term at least;
    and the number of leading bits."""
    size = max(12, (32 * lex.count()).bit_length())
    slot = F.shiftrightunsigned("h", 64 - size)
    words = lex.groupBy(F.shiftright(slot, 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(63).cast("int"))).alias("bits"))
    every = lex.sparkSession.range(1 << (size - 6)).select(F.col("id").alias("w"))
    dense = every.join(words, "w", "left").agg(F.sort_array(F.collect_list(F.struct("w", F.coalesce("bits", F.lit(0)).alias("bits")))).alias("all"))
    listed = dense.select(F.array_join(F.transform("all", lambda x: x["bits"].cast("string")), ",")).first()[0]
    return F.split(F.lit(listed), ",").cast("array<bigint>"), size  # folded to a constant when the plan is optimized


def _in_lexicon(h: Column, bits: Column, size: int) -> Column:
    slot = F.shiftrightunsigned(h, 64 - size)
    word = F.get(bits, F.shiftright(slot, 6).cast("int"))
    return F.call_function("shiftright", word, slot.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1


def _firsts() -> Column:
    """The number that comes before all terms of each subset."""
    return F.array(*[F.lit(n << 58) for n in range(SUBSETS)])


def _values(listed: Column) -> Column:
    """Of the listed terms, each subset's value at one rate: array<smallint>, ``EMPTY`` where it has none.

    Sorted among the subsets' first numbers, the terms of a subset stand between its own and the next one's.
    """

    def between(x: Column, at: Column, n: Column) -> Column:
        start, end = F.get(at, n), F.coalesce(F.get(at, n + 1), F.size(x) + 1)
        mine = F.slice(x, (start + 1).cast("int"), (end - start - 1).cast("int"))
        return F.when(end - start == 1, EMPTY).otherwise(F.pmod(F.xxhash64(mine), F.lit(65535)) - 32767).cast("smallint")

    def cut(x: Column) -> Column:
        places = F.transform(_firsts(), lambda first: F.array_position(x, first))
        return let(places, lambda at: F.transform(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), lambda n: between(x, at, n)))

    return let(F.sort_array(F.concat(listed, _firsts())), cut)


def fingerprint(text: Column, bits: Column, size: int) -> Column:
    """array<smallint>: the values of all subsets, rate after rate. A term's lowest five bits tell its subset, the next
    ones the rates that it is in."""
    left = F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(58))
    known = F.filter(terms(text), lambda h: _in_lexicon(h, bits, size))
    placed = F.transform(known, lambda h: h.bitwiseAND(SUBSETS - 1) * left + F.shiftrightunsigned(h, 6))

    def rates(listed: Column, rate: int) -> Column:
        if rate == RATES - 1:
            return _values(listed)
        sparser = F.filter(listed, lambda h: F.shiftright(h, 2 * rate).bitwiseAND(3) == 0)
        return F.concat(_values(listed), let(sparser, lambda x: rates(x, rate + 1)))

    return let(placed, lambda x: rates(x, 0))


def likeness(a: Column, b: Column) -> Column:
    """Of two fingerprints the share of equal subset values among the subsets that either text has terms in, 0 to 1.

    Counted are the rates at which at most ``TOLD_APART`` subsets are in use, or else the sparsest one. Equal fingerprints: 1;
    but where neither text has a term of the lexicon, or one is null, nothing is known of the two: 0.
    """

    def counted(rate: int) -> Column:
        cut = lambda f: F.slice(f, rate * SUBSETS + 1, SUBSETS)
        marks = F.zip_with(cut(a), cut(b), lambda x, y: F.when((x == EMPTY) & (y == EMPTY), 0).when(x == y, 1001).otherwise(1))
        return F.aggregate(marks, F.lit(0), lambda acc, m: acc + m)  # a thousand for each equal pair, one for each in use

    def share(sums: Column) -> Column:
        last = F.get(sums, F.lit(RATES - 1))
        use = F.filter(sums, lambda x: x % 1000 <= TOLD_APART)
        used = F.when(F.exists(use, lambda x: x % 1000 > 0), use).otherwise(F.array(last))
        total = F.aggregate(used, F.lit(0), lambda acc, x: acc + x)
        return F.try_divide(F.floor(total / 1000).cast("double"), (total % 1000).cast("double"))

    nothing = F.forall(a, lambda x: x == EMPTY) & F.forall(b, lambda x: x == EMPTY)
    return F.when(nothing, 0.0).when(a == b, 1.0).otherwise(F.coalesce(let(F.array(*[counted(r) for r in range(RATES)]), share), F.lit(0.0)))


def as_text(f: Column) -> Column:
    """A fingerprint as hexadecimal digits."""
    return F.lower(F.array_join(F.transform(f, lambda x: F.lpad(F.hex(x.cast("int") + 32768), 4, "0")), ""))


def fingerprints(texts: DataFrame, text_cols: dict[str, str], lex: DataFrame) -> DataFrame:
    """One fingerprint column (array<smallint>) for each of ``text_cols`` (text column: new column), and the other columns.

    Rows are told apart by ``__id`` and ``__text_hash`` (``row_keys``); whole repeats of a row give one row, and ``copies``
    says how many they were; text columns are dropped. Null is an empty text; a text without terms of the lexicon has an
    empty fingerprint. An empty table gives an empty one.
    """
    bits, size = lexicon_bits(lex)
    rest = [c for c in texts.columns if c not in text_cols and c not in ("__id", "__text_hash", "__key")]
    keyed = texts if "__key" in texts.columns else texts.withColumn("__key", F.struct("__id", "__text_hash"))
    found = keyed.select("__key", *rest, *[fingerprint(F.col(t), bits, size).alias(to) for t, to in text_cols.items()])
    once = found.groupBy("__key").agg(*[F.first(c).alias(c) for c in (*rest, *text_cols.values())], F.count("*").alias("copies"))
    return once.select("__key.*", *rest, *text_cols.values(), "copies")


def next_rows(rows: DataFrame) -> DataFrame:
    """For each (``__id``, ``__text_hash``) the following one in that order, the first after the last, as __next_id, __next_hash.

    Range partitions are ordered each for itself; what lies across a border comes from the first row of each
    partition, one row per partition in all.
    """
    ordered = stored(rows.select("__id", "__text_hash").distinct().repartitionByRange("__id", "__text_hash").withColumn("__part", F.spark_partition_id()), "order")
    firsts = ordered.groupBy("__part").agg(F.min(F.struct("__id", "__text_hash")).alias("first"))
    whole = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # a row per partition
    beyond = firsts.select("__part", F.coalesce(F.lead("first").over(Window.orderBy("__part")), F.first("first").over(whole)).alias("beyond"))
    inside = F.lead(F.struct("__id", "__text_hash")).over(Window.partitionBy("__part").orderBy("__id", "__text_hash"))
    return ordered.withColumn("__next", inside).join(F.broadcast(beyond), "__part").select("__id", "__text_hash", F.coalesce("__next", "beyond").alias("n")).select("__id", "__text_hash", F.col("n.__id").alias("__next_id"), F.col("n.__text_hash").alias("__next_hash"))


def half_replaced(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Whole texts with an edited form beside them, to measure fingerprints by.

    __id, __text_hash, __key (both), __next_id, __next_hash, text, edited: the last floor(n/2) of n code points are replaced by the
    first as many (or all) of the next document, by ascending id and then text hash; null text is empty. Repeated
    rows stay (``fingerprints`` makes one row of them). The texts are shuffled once, by key, for both joins.
    """
    keys = row_keys(doc_id, text)
    base = docs.select(F.struct(*[c.alias(k) for k, c in keys.items()]).alias("__key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ids = docs.select(*[c.alias(k) for k, c in keys.items()])
    sized = docs.select(*[c.alias(k) for k, c in keys.items()], F.coalesce(F.floor(F.char_length(text) / 2), F.lit(0)).cast("int").alias("half")).distinct()
    after = next_rows(ids)
    want = stored(after.join(sized, same_row(after, sized)).select(after["*"], "half"), "next")
    # both joins and the fingerprints' grouping go by one column, so that the texts are shuffled once
    wanted = want.withColumn("__key", F.struct(F.col("__next_id").alias("__id"), F.col("__next_hash").alias("__text_hash"))).withColumnRenamed("__id", "of_id").withColumnRenamed("__text_hash", "of_hash")
    taken = base.join(wanted.hint("shuffle_hash"), "__key").select(F.struct(F.col("of_id").alias("__id"), F.col("of_hash").alias("__text_hash")).alias("__key"), "__next_id", "__next_hash", "half", F.substring(F.col("text"), F.lit(1), F.col("half")).alias("head"))
    both = base.join(taken.dropDuplicates(["__key"]), "__key").select("__key.*", "__key", "text", "__next_id", "__next_hash", "half", "head")
    kept = F.substring(F.col("text"), F.lit(1), F.char_length("text") - F.col("half"))
    return both.withColumn("edited", F.concat(kept, F.col("head"))).drop("half", "head")
