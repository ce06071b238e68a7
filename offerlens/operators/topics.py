"""Topic words of groups of records (a bank's campaigns), and whether what an answer shows is on the topic that was asked.

A record's words are the distinct topic words of its name.  Two words are of one stem if they agree in five letters, or if
one of them is the other's first four.  That relation is not transitive, so stems are not classes: a word of four letters
is related to every longer word it begins, which are not related to one another.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from offerlens.functions import text

# Endings of participles, marks of verb forms, endings of short qualifying participles, and lengths.
PARTICIPLES = ("an", "en", "digi", "dugu", "tigi", "tugu", "acak", "ecek", "mis", "mus")
VERB_MARKS = ("yor", "digi", "dugu", "tigi", "tugu")
QUALIFIERS, QUALIFIER_STEM, PARTICIPLE_LEAST = ("an", "en"), 3, 4
#: Folds of lower-case letters as `text.folded` has them; of ASCII texts two apostrophes alone.
FOLDS = (*zip("âîûışğüöç", "aiuisguoc", strict=True), *((c, "") for c in text.APOSTROPHES + "\u0307"))
ASCII_FOLDS = tuple((c, x) for c, x in FOLDS if c.isascii())
#: The characters that topic words are made of, each as a digit in base 37; 0 is any other.
LETTERS = b"0123456789abcdefghijklmnopqrstuvwxyz"
STEMS = 37**5
DIGITS = np.zeros(256, np.uint8)
DIGITS[list(LETTERS)] = range(1, 37)
SPELLED = np.frombuffer(b"\0" + LETTERS, np.uint8)
SPACED = bytes(c if c in LETTERS else 32 for c in range(256))
FOUR_DIGITS = re.compile(rb"[0-9]{4}").search
#: Names that are worked through at once: their letters stay in a processor's cache.
NAMES_AT_ONCE = 64
#: Sums that a task holds before it hands them on, about.
SUMS_HELD = 1 << 19


def participle(word: Column) -> Column:
    """Whether a search key's word qualifies the noun after it ("sunan banka"); two or three letters are no participle."""
    return (F.length(word) >= PARTICIPLE_LEAST) & word.rlike(rf"(?:{'|'.join(PARTICIPLES)})$")


def inflected(word: Column) -> Column:
    """Whether a word has a verb's mark after its first two letters, whatever endings follow ("yapiliyorsa")."""
    return word.rlike(rf"^.{{2,}}?(?:{'|'.join(VERB_MARKS)})")


def qualifier(word: Column) -> Column:
    """Whether a short stem and an ending of participles make up a word: "veren", but not "restoran"."""
    return word.rlike(rf"^.{{0,{QUALIFIER_STEM}}}(?:{'|'.join(QUALIFIERS)})$")


def words_of(name: Column) -> Column:
    """The distinct topic words of a name; none of a null."""
    return F.array_distinct(text.topic_words(F.coalesce(name, F.lit(""))))


def folded(name: str) -> bytes:
    """A name's letters as words have them, all that is in no word as other characters."""
    low = name.lower()
    for c, x in ASCII_FOLDS if low.isascii() else FOLDS:
        low = low.replace(c, x)
    return low.encode("ascii", "replace")


def words_in(name: str) -> set[str]:
    """`words_of` for a name at hand."""
    key = folded(name)
    words = {w for w in set(key.translate(SPACED).decode("ascii").split()) if len(w) > 3}
    return {w for w in words if not w.isdigit()} if FOUR_DIGITS(key) else words


def stems_in(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(place of the name, stem) of the distinct stems of many names' words, in order; a stem is a number in base 37, of five digits."""
    both = [np.zeros(0, np.int64), *(stems_at(i, names[i : i + NAMES_AT_ONCE]) for i in range(0, len(names), NAMES_AT_ONCE))]
    return tuple(np.divmod(np.concatenate(both), STEMS))


def stems_at(first: int, names: list[str]) -> np.ndarray:
    """Place * STEMS + stem of the distinct stems of names, the first of which has that place."""
    keys = [folded(n) for n in names]
    digits = DIGITS[np.frombuffer(b" ".join([*keys, b" " * 6]), np.uint8)]
    turns = np.flatnonzero(np.diff((digits > 0).view(np.int8), prepend=np.int8(0)))
    begin, end = turns[::2], turns[1::2]
    long = end - begin > 3
    begin, end = begin[long], end[long]
    letters = np.cumsum(digits > 10, dtype=np.int32)  # its last one of all is before the end, which is outside of the word
    spoken = letters[end] > letters[begin] - (digits[begin] > 10)
    begin = begin[spoken]
    stem = np.zeros(len(begin), np.int64)
    for i in range(5):
        stem = stem * 37 + digits[begin + i]  # what follows a word of four letters is no digit, and 0
    name = np.searchsorted(np.cumsum([len(k) + 1 for k in keys]), begin, "right")
    both = np.sort((first + name) * STEMS + stem)
    return both[np.diff(both, prepend=-1) > 0]


def spelled(stems: np.ndarray) -> pa.Array:
    """Stems as texts."""
    letters = SPELLED[np.stack([stems // 37**i % 37 for i in (4, 3, 2, 1, 0)], axis=1)].ravel()
    ends = np.concatenate([[0], np.cumsum(4 + (stems % 37 > 0))]).astype(np.int32)
    return pa.StringArray.from_buffers(len(stems), pa.py_buffer(ends), pa.py_buffer(letters[letters > 0]))


def word_counts(records: DataFrame) -> DataFrame:
    """(group, word, n): rows of a group whose name has the word, in parts to be summed; group is of a simple type.

    A task sums what it reads, and hands the sums on whenever there are many.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[object, Counter] = {}

        def handed(kind: pa.DataType) -> pa.RecordBatch:
            of = [pa.array([g for g, c in held.items() for _ in range(len(c))], kind), pa.array([w for c in held.values() for w in c], pa.string()), pa.array([n for c in held.values() for n in c.values()], pa.int64())]
            held.clear()
            return pa.RecordBatch.from_arrays(of, ["group", "word", "n"])

        for f in batches:
            for i, (group, name) in enumerate(zip(f.column(0).to_pylist(), f.column(1).to_pylist(), strict=True)):
                if name:
                    if group not in held:
                        held[group] = Counter()
                    held[group].update(words_in(name))
                if i % 64 == 63 and sum(map(len, held.values())) > SUMS_HELD:
                    yield handed(f.column(0).type)
        if held:
            yield handed(f.column(0).type)

    rows = records.select("group", "name")
    return rows.mapInArrow(run, f"group {rows.schema[0].dataType.simpleString()}, word string, n bigint")


def related_counts(records: DataFrame) -> DataFrame:
    """(stem, df): how many records have a word related to those of a stem, a word's first five letters.

    A longer stem's records are those with the stem itself and those with the word that its first four letters are.  The
    latter are counted once a word, and a record that has both counts there, so no pair of words is ever formed.  A word
    of four letters is related to all that begin with it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in batches:
            name, stem = stems_in([x for x in f.column(0).to_pylist() if x])
            four, first = stem // 37, np.ones(len(stem), bool)
            first[1:] = (four[1:] != four[:-1]) | (name[1:] != name[:-1])
            whole = stem % 37 == 0  # the word of four letters stands before the stems it begins
            alone = ~whole & ~whole[np.flatnonzero(first)][np.cumsum(first) - 1] if len(stem) else whole
            counts = [np.unique(keys, return_counts=True) for keys in (four[first] * 37, stem[whole], stem[alone], stem[~whole & ~alone])]
            keys = spelled(np.concatenate([k for k, _ in counts]))
            n = lambda tag: pa.array(np.concatenate([c if i == tag else np.zeros(len(c), np.int64) for i, (_, c) in enumerate(counts)]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([keys, n(0), n(1), n(2)], ["key", "begun", "whole", "alone"])

    parts = records.select("name").mapInArrow(run, "key string, begun bigint, whole bigint, alone bigint")
    # a key is a stem or four letters; what shares four letters comes together, 37 keys at most
    keys = parts.withColumn("four", F.left("key", F.lit(4))).repartition("four").groupBy("four", "key").agg(*[F.sum(c).alias(c) for c in ("begun", "whole", "alone")])
    fours = keys.groupBy("four").agg(F.max("whole").alias("whole"), F.collect_list(F.struct("key", "begun", "whole", "alone")).alias("keys"))
    key = F.inline("keys").alias("stem", "begun", "own", "alone")
    of = fours.select(F.col("whole").alias("shared"), key)
    short = F.length("stem") == 4
    return of.where(~short | (F.col("own") > 0)).select("stem", F.when(short, F.col("begun")).otherwise(F.col("alone") + F.col("shared")).alias("df"))


def topics(records: DataFrame, resolved: DataFrame, k: int = 3, ceiling: float = 0.03) -> DataFrame:
    """(group, rank, word, n, df): the k words that name most records of each group, no two of one stem.

    records has group and name; every row is a record.  A word that is related to words of more than the ceiling's share
    of all records (df; one record is always allowed) names none of them; nor do verb forms, and words related to one of
    `resolved` (column word) are for others to find.  n counts a group's records with the word itself; of equal n the
    first in order comes first.  A null group is a group, null and empty names have no words, an empty table has no
    rows, other columns are not read.

    The greedy choice needs no loop.  Of a longer stem only the first word can be taken.  Among the stems that share
    four letters, the word of just these bars the others if it comes first, and is barred by them otherwise.
    """
    total = records.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * ceiling)).alias("most"))
    # dealt by stem once: both a word's sum and the first word of each stem are found inside one part
    counted = word_counts(records).withColumn("stem", F.left("word", F.lit(5))).repartition("group", "stem").groupBy("group", "stem", "word").agg(F.sum("n").alias("n"))
    # a word's form is looked at once a group, after its places are summed: n keeps the condition from moving below the sum
    counted = counted.where(F.when(F.col("n") > 0, ~inflected(F.col("word")) & ~qualifier(F.col("word"))))
    order = lambda: F.struct((-F.col("n")).alias("a"), F.col("word").alias("b"))
    foremost = counted.groupBy("group", "stem").agg(F.min_by(F.struct("word", "n"), order()).alias("r")).select("group", "stem", "r.*")
    rare = related_counts(records).crossJoin(F.broadcast(total)).where("df <= most").drop("most")  # one row
    known = resolved.select(F.col("word").alias("_known")).where("_known IS NOT NULL").distinct().withColumn("four", F.left("_known", F.lit(4)))
    # spread and kinship to what is resolved are those of the stem, so they are asked of its first word alone
    asked = foremost.join(rare, "stem").withColumn("four", F.left("word", F.lit(4)))
    first = asked.join(known, (asked["four"] == known["four"]) & text.same_stem(F.col("word"), F.col("_known")), "left_anti").select("group", "four", "word", "n", "df")
    ahead = first.withColumn("_first", F.first("word").over(W.partitionBy("group", "four").orderBy(order())))  # 37 rows at most
    taken = ahead.where((F.col("word") == F.col("_first")) | ((F.length("_first") > 4) & (F.length("word") > 4)))
    rank = F.row_number().over(W.partitionBy("group").orderBy(F.col("n").desc(), "word"))
    return taken.select("group", rank.alias("rank"), "word", "n", "df").where(F.col("rank") <= k)


def stems_of(records: DataFrame) -> DataFrame:
    """(record, stems): the distinct first five letters of the words of each row's name, as an array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in batches:
            name, stem = stems_in([x or "" for x in f.column(1).to_pylist()])
            ends = np.searchsorted(name, np.arange(len(f) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([f.column(0), pa.ListArray.from_arrays(pa.array(ends), spelled(stem))], ["record", "stems"])

    rows = records.select("record", "name")
    return rows.mapInArrow(run, f"record {rows.schema[0].dataType.simpleString()}, stems array<string>")


def on_topic(answers: DataFrame, records: DataFrame) -> DataFrame:
    """(answer, on_topic): whether every record that an answer shows has a word related to the topic it was asked for.

    answers has answer, topic (a topic word) and record; records has record and name.  Records that the table has not
    are outside the check, and so is an answer that shows no others: it counts as on topic.  A record of null name has
    no words.  Rows that repeat a record count together.
    """
    shown = answers.where("record IS NOT NULL AND topic IS NOT NULL").select("record", "topic").distinct().withColumn("four", F.left("topic", F.lit(4)))
    known = records.select("record").where("record IS NOT NULL").distinct().withColumn("known", F.lit(True))
    # of a record's words only stems that a topic begins like travel, and a word's kinship is that of its stem
    begun = answers.where("record IS NOT NULL").select(F.left("topic", F.lit(4)).alias("four")).where("four IS NOT NULL").distinct()
    words = stems_of(records).select("record", F.explode("stems").alias("word")).withColumn("four", F.left("word", F.lit(4))).join(F.broadcast(begun), "four", "left_semi")  # 36 ** 4 rows at most
    met = shown.join(words, ["record", "four"]).where(text.same_stem(F.col("word"), F.col("topic"))).select("record", "topic").distinct().withColumn("met", F.lit(True))
    checked = answers.select("answer", "topic", "record").join(known, "record", "left").join(met, ["record", "topic"], "left")
    return checked.groupBy("answer").agg(F.every(F.col("known").isNull() | F.col("met").isNotNull()).alias("on_topic"))
