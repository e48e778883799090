"""Line dedup by an exact set-similarity join over the words of lines, in DataFrame operations only.

A line is the set of its words; only blank lines have none. Lines of one document or of
several match when the Jaccard similarity of their sets is ``threshold`` or more, and a
line with an earlier match goes.

1. Lines of the same set form a class with one representative, its first line, so a line that a third of the corpus shares is one row from here on.
2. The words of a representative are ordered by rarity (corpus counts, kept in a table
   of fixed size), and only the first ``n - ceil(t * n) + 1`` are indexed (prefix
   filter): two sets that match share one.
3. Candidates meet on a shared word if sizes allow a match (length filter), enough
   words follow the shared one in both sets (positional filter), and the parities
   of 64 groups of words differ in no more groups than the sets may differ in words.
   The pairs that are left meet on their whole prefixes, which bound what two sets
   can share: the same words up to the smaller end, and all that follows it.
4. Jaccard is verified on the whole sets of the candidates, split anew from their text.

Steps 3 and 4 move many rows, so they go over the words, and over the documents, in
``PARTS`` passes: each word and each document is in one of them, and the shuffle files of
a pass are dropped before the next begins.

Candidates are sought in two rounds. First every line is compared with two leaders
of each of its words, the earliest line and the one with most copies, so a group
of near copies costs its size, not its square. Then the lines that found no
match are compared with all earlier lines that pass the filters, which makes
the join complete.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorframe.llm.tables import drop_stored, free_name, stored
from sensorframe.operators.joins import fits_broadcast

THRESHOLD = 0.8
#: Entries of the table of word counts, one byte each.
BUCKETS = 1 << 20
LAST = (1 << 63) - 1
#: Passes over the indexed words and over the texts, and the classes below which one pass does.
PARTS = 4
CLASSES_AT_ONCE = 500_000
#: What is known of a line that shares a word.
LINE = ("id", "pos", "key", "size", "at", "parity")


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST)).alias("id"),
        F.xxhash64(F.col(id_col).cast("bigint"), text).alias("doc"),
        text.alias("text"),
    )


def _lines(documents: DataFrame) -> DataFrame:
    """``(id, doc, pos, line)``: every line."""
    return documents.select("id", "doc", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def _words(line: str) -> Column:
    """Words between ASCII white space; a split at single spaces is the fast one."""
    plain = F.when(F.col(line).rlike(r"[\x09-\x0D]"), F.translate(line, "\t\x0b\x0c\r", "    ")).otherwise(F.col(line))
    return F.array_remove(F.split(plain, " "), "")


def word_levels(documents: DataFrame) -> bytes:
    """For each hash bucket of words, how often they occur in all lines: the bits of the count, as a character from ``0`` on."""
    lines = documents.select(F.explode(F.split("text", "\n")).alias("line"))
    words = lines.select(F.explode(F.split("line", " ")).alias("word"))
    bucket = F.xxhash64("word").bitwiseAND(F.lit(BUCKETS - 1)).cast("int")
    counts = words.groupBy(bucket.alias("bucket")).agg(F.length(F.bin(F.count(F.lit(1)))).alias("level"))
    levels = bytearray(b"0" * BUCKETS)
    # As many rows as buckets at most, packed a thousand to a row.
    packed = counts.groupBy(F.shiftright("bucket", 10).alias("part")).agg(F.collect_list(F.col("bucket") * 64 + F.col("level")).alias("all"))
    for row in packed.collect():
        for value in row["all"]:
            levels[value >> 6] = 48 + (value & 63)
    return bytes(levels)


def coded_lines(lines: DataFrame, levels: bytes, threshold: float) -> DataFrame:
    """``(id, doc, pos, key, check, size, parity, prefix)``: every line with its indexed words.

    A word is a number: the upper bits tell how frequent it is, the lower ones are a
    hash. Numeric order is thus an order of rarity. Two hashes of the ordered set name
    the class of the line. Blank lines have size 0 (a filter here would split
    every line twice).
    """
    table = F.lit(levels)

    def code(word: Column) -> Column:
        hashed = F.xxhash64(word)
        place = hashed.bitwiseAND(F.lit(BUCKETS - 1)).cast("int") + 1
        level = F.ascii(F.substr(table, place, F.lit(1)).cast("string")).cast("bigint") - 48
        return F.shiftleft(level, 56).bitwiseOR(F.shiftrightunsigned(hashed, 8))

    own = ["id", "doc", "pos"]
    coded = lines.select(*own, F.sort_array(F.array_distinct(F.transform(_words("line"), code))).alias("codes"))
    size = F.size("codes")
    indexed = F.when(size > 0, size - F.ceil(size * threshold - 1e-9) + 1).otherwise(0).cast("int")
    one = F.lit(1).cast("bigint")
    parity = F.aggregate("codes", F.lit(0).cast("bigint"), lambda bits, c: bits.bitwiseXOR(F.call_function("shiftleft", one, c.bitwiseAND(F.lit(63)).cast("int"))))
    return coded.select(
        *own,
        F.xxhash64("codes").alias("key"),
        F.hash("codes").alias("check"),
        size.alias("size"),
        parity.alias("parity"),
        F.slice("codes", F.lit(1), indexed).alias("prefix"),
    )


def _classes(coded: DataFrame, *more: Column) -> DataFrame:
    first = F.min(F.struct("id", "doc", "pos")).alias("first")
    return coded.groupBy("key", "check").agg(first, F.count(F.lit(1)).alias("n"), *more)


def line_classes(coded: DataFrame) -> DataFrame:
    """``(id, doc, pos, key, size, parity, rank, prefix)``: the first line of every class; a low ``rank`` has many copies."""
    classes = _classes(coded, *[F.first(c).alias(c) for c in ("size", "parity", "prefix")])
    rank = (-F.floor(F.log2("n"))).cast("int").alias("rank")
    return classes.select("first.*", "key", "size", "parity", rank, "prefix")


def indexed_words(classes: DataFrame, part: int, parts: int) -> DataFrame:
    """``(code, rank)`` and ``LINE`` of the indexed words of one pass: those whose hash falls to ``part``."""
    words = classes.select(F.posexplode("prefix").alias("at", "code"), "rank", *[c for c in LINE if c != "at"])
    return words.filter(F.pmod("code", F.lit(parts)) == part).select("code", "rank", *LINE)


def _with_leaders(shared: DataFrame) -> DataFrame:
    """The lines of every word with the two that lead it: the earliest, and the one with most copies.

    Leaders are found before lines move, so no task holds the lines of a frequent word.
    """
    leaders = shared.groupBy("code").agg(
        F.min(F.struct(*LINE)).alias("earliest"), F.min(F.struct("rank", *LINE)).alias("largest")
    )
    return shared.join(leaders, "code")


def _may_match(threshold: float) -> Column:
    """Length, positional and parity filter of line ``x`` and line ``y`` that share a word."""
    nx, ny = F.col("x.size"), F.col("y.size")
    least = F.ceil((nx + ny) * (threshold / (1 + threshold)) - 1e-9)
    left = F.least(nx - F.col("x.at"), ny - F.col("y.at"))
    apart = F.bit_count(F.col("x.parity").bitwiseXOR(F.col("y.parity")))
    return (nx >= ny * threshold - 1e-9) & (ny >= nx * threshold - 1e-9) & (left >= least) & (apart <= nx + ny - 2 * least)


def _earlier() -> Column:
    return F.struct("y.id", "y.pos", "y.key") < F.struct("x.id", "x.pos", "x.key")


def _side(df: DataFrame) -> DataFrame:
    """A table as the small side of a join: broadcast where its measured size allows, else hashed after a shuffle."""
    return F.broadcast(df) if fits_broadcast(df) else df.hint("shuffle_hash")


def _union(tables: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.union, tables)


def _close(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """``pairs (x, y)`` whose prefixes allow a match, with the places of both lines.

    All words of a set up to the end of its prefix are in it. Up to the smaller end of two
    prefixes the shared words are thus known; of those behind it all may be shared.
    """
    for c in "xy":
        side = classes.select(F.col("key").alias(c), *[F.col(n).alias(f"{n}_{c}") for n in ("doc", "pos", "size", "prefix")])
        pairs = pairs.join(side, c)
    end = F.least(F.element_at("prefix_x", -1), F.element_at("prefix_y", -1))
    behind = [F.col(f"size_{c}") - F.size(F.filter(f"prefix_{c}", lambda w: w <= F.col("end"))) for c in "xy"]
    most = F.size(F.array_intersect("prefix_x", "prefix_y")) + F.least(*behind)
    least = F.ceil((F.col("size_x") + F.col("size_y")) * (threshold / (1 + threshold)) - 1e-9)
    pairs = pairs.withColumn("end", end).filter(most >= least)
    return pairs.select("x", "doc_x", "pos_x", "y", "doc_y", "pos_y")


def verified(pairs: DataFrame, documents: DataFrame, classes: DataFrame, threshold: float, parts: int) -> DataFrame:
    """The keys ``x`` of ``pairs (x, y)`` whose sets have the similarity asked for.

    Only the first lines of the candidate classes are looked up and split again. They
    move as text, which is shorter than its hashes. Whole sets are compared, their
    words as 64-bit hashes.
    """
    pairs = stored(_close(pairs, classes, threshold))
    ends = [F.struct(F.col(c).alias("key"), F.col(f"doc_{c}").alias("doc"), F.col(f"pos_{c}").alias("pos")) for c in "xy"]
    places = stored(pairs.select(F.explode(F.array(*ends)).alias("place")).select("place.*").distinct())
    few, found = fits_broadcast(places), []
    for part in range(1 if few else parts):
        mine = F.lit(True) if few else F.pmod("doc", F.lit(parts)) == part
        wanted = F.broadcast(places) if few else places.filter(mine).hint("shuffle_hash")
        lines = _lines(documents.filter(mine)).select("doc", "pos", "line").join(wanted, ["doc", "pos"])
        # Rows that repeat an id and its text give the same line again.
        found.append(stored(lines.select("key", "line")))
    texts = _union(found).groupBy("key").agg(F.first("line").alias("line"))
    both = pairs.select("x", "y").join(texts.select(F.col("key").alias("x"), F.col("line").alias("line_x")), "x")
    both = both.join(texts.select(F.col("key").alias("y"), F.col("line").alias("line_y")), "y")
    sets = [F.array_distinct(F.transform(_words(f"line_{c}"), lambda w: F.xxhash64(w))).alias(f"set_{c}") for c in "xy"]
    both = both.select("x", *sets)
    shared = F.size(F.array_intersect("set_x", "set_y"))
    union = F.size("set_x") + F.size("set_y") - shared
    out = stored(both.filter(shared >= union * threshold - 1e-9).select("x").distinct())
    drop_stored(pairs, places, *found)
    return out


def later_matches(documents: DataFrame, coded: DataFrame, threshold: float) -> DataFrame:
    """``(key,)`` of the classes that match an earlier line of another class."""
    classes = stored(line_classes(coded))
    parts = min(PARTS, -(-classes.count() // CLASSES_AT_ONCE)) or 1

    found = []
    for part in range(parts):
        led = _with_leaders(indexed_words(classes, part, parts)).select(
            F.struct(*LINE).alias("x"),
            F.explode(F.array("earliest", F.struct(*[f"largest.{c}" for c in LINE]))).alias("y"),
        )
        led = led.filter(_earlier() & _may_match(threshold)).select(F.col("x.key").alias("x"), F.col("y.key").alias("y"))
        found.append(stored(led.distinct()))
    led = stored(_union(found).distinct()) if parts > 1 else found[0]
    first = verified(led, documents, classes, threshold, parts)

    done = first.select(F.col("x").alias("key"), F.lit(True).alias("done"))
    marked = stored(classes.join(_side(done), "key", "left"))
    drop_stored(classes)
    found = []
    for part in range(parts):
        open_lines = indexed_words(marked.filter("done IS NULL"), part, parts).select("code", F.struct(*LINE).alias("x"))
        others = indexed_words(marked, part, parts).select("code", F.struct(*LINE).alias("y"))
        pairs = open_lines.join(others, "code").filter(_earlier() & _may_match(threshold))
        found.append(stored(pairs.select(F.col("x.key").alias("x"), F.col("y.key").alias("y")).distinct()))
    pairs = stored(_union(found).distinct().join(led, ["x", "y"], "left_anti"))
    rest = verified(pairs, documents, marked, threshold, parts)
    drop_stored(marked)
    return first.union(rest).select(F.col("x").alias("key")).distinct()


def line_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``docs`` without the lines that match an earlier line; adds ``n_lines`` and ``n_removed``.

    Lines are split at line feeds and ordered by integer id, then position; null ids
    come last. Lines match whose sets of words have a Jaccard similarity of
    ``threshold`` or more, equal lines among them, whether or not the earlier line
    stays. Words lie between ASCII white space, and upper and lower case differ. Blank
    lines always stay. A null text is empty: one line.
    Rows that repeat an id and its text count as one document and lose the same
    lines; a document may lose all its lines and is then an empty text. An empty
    table gives no rows. Columns named ``n_lines`` and ``n_removed`` are replaced, any
    other comes back as it is.
    """
    documents = _documents(docs, id_col, text_col)
    coded = stored(coded_lines(_lines(documents), word_levels(documents), threshold)).filter("size > 0")
    matched = stored(later_matches(documents, coded, threshold))
    # Classes of one line without a match lose nothing.
    found = _classes(coded).join(matched.withColumn("matched", F.lit(True)), "key", "left").filter("n > 1 or matched")
    gone = coded.select("id", "doc", "pos", "key", "check").join(found.drop("n"), ["key", "check"])
    gone = gone.filter(F.coalesce("matched", F.lit(False)) | (F.struct("id", "doc", "pos") != F.col("first")))
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    names: list[str] = []
    for name in ("id", "doc", "gone", "lines"):
        names.append(free_name([*columns, *names, "n_lines", "n_removed"], name))
    own_id, own_doc, own_gone, own_lines = names
    gone = gone.groupBy("id", "doc").agg(F.collect_set("pos").alias("all"))
    gone = gone.select(F.col("id").alias(own_id), F.col("doc").alias(own_doc), F.col("all").alias(own_gone))

    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = {
        own_id: F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST)),
        own_doc: F.xxhash64(F.col(id_col).cast("bigint"), text),
    }
    joined = docs.select(columns).withColumns(keys).join(_side(stored(gone)), [own_id, own_doc], "left")
    joined = joined.withColumn(own_lines, F.split(text, "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size(own_lines) - 1), F.col(own_gone))
    kept = F.array_join(F.transform(stay, lambda i: F.get(own_lines, i)), "\n")
    return joined.select(
        *[F.when(F.col(own_gone).isNull(), text).otherwise(kept).alias(c) if c == text_col else F.col(c) for c in columns],
        F.size(own_lines).cast("bigint").alias("n_lines"),
        F.coalesce(F.size(own_gone), F.lit(0)).cast("bigint").alias("n_removed"),
    )
