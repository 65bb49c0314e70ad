"""Spelling variants: words one edit apart meet in bands of their letters' parities, and each follows its most frequent near word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightlights.llm.tables import quoted
from nightlights.runtime import materialize

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_LENGTH, MIN_COUNT = 5, 3
#: A run whose hash this divides loses one code point, which makes variants to be found.
DAMAGED = 97
BANDS, BITS = 3, 31


def lower_ascii(run: Column) -> Column:
    """A-Z in lower case and nothing else; lower() is used only where there is nothing else that it could change."""
    return F.when(F.octet_length(run) == F.length(run), F.lower(run)).otherwise(F.translate(run, UPPER, LOWER))


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): the runs of letters of all texts, those that DAMAGED picks by id and run without one of their code points.

    Counted before the shuffle. A null text has no runs, a null id counts as 'null'; repeated rows count each time.
    """
    texts = docs.select(F.coalesce(F.col(quoted(id_col)).cast("string"), F.lit("null")).alias("id"), F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")).alias("text"))
    runs = texts.select("id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run")).select("id", lower_ascii(F.col("run")).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    kept = hashed.select(F.when(F.col("h") % DAMAGED == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= min_length)
    return kept.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def parity_band(word: Column, band: int) -> Column:
    """One band of the mask: a bit for each letter (of code c: band c mod 3), set if the letter occurs an odd number of times."""
    bit = lambda c: F.call_function("shiftleft", F.lit(1), (F.floor(F.ascii(c) / BANDS) % BITS).cast("int"))
    own = F.filter(F.split(word, ""), lambda c: (F.length(c) > 0) & (F.ascii(c) % BANDS == band))
    return F.aggregate(own, F.lit(0), lambda mask, c: mask.bitwiseXOR(bit(c)))


def _keyed(masked: DataFrame, longer: bool) -> DataFrame:
    """Each word under its six keys for each of two kinds of pairs: words of one length (grow 0), and words of lengths size and
    size + 1 (grow 1), where longer says which of the two the rows are. A key is a band's value with the lengths' filter and
    one half of the shorter word, from the left or the right: an edit leaves one of the halves alone."""
    size = F.length("word") - (F.col("grow") if longer else F.lit(0))
    half = F.when(F.col("side") == 0, F.substring(F.col("word"), F.lit(1), F.floor(F.col("size") / 2).cast("int"))).otherwise(F.expr("right(word, size - CAST(floor(size / 2) AS INT))"))
    roles = masked.withColumn("grow", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("size", size)
    sides = roles.withColumn("band", F.explode(F.array(*[F.lit(k) for k in range(BANDS)]))).withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
    return sides.select("word", "n", "masks", "band", "side", "grow", "size", half.alias("half"), F.col("masks")[F.col("band")].alias("mask"))


def near_pairs(found: DataFrame) -> DataFrame:
    """(a, b, a_n, b_n): each pair of words once that differ by one inserted, deleted or replaced code point.

    An edit flips two bits of the mask of parities at most, so of its three bands one stays. Words meet in equal bands with
    fitting lengths and an equal half; a pair counts at its first equal band and half only, and whole words decide.

    Joins here and below are merges by hint: Spark knows words by their compressed files and doesn't count what explode makes of
    them, so it would broadcast twelve keys for each word of a table of some MB.
    """
    masked = found.select("word", "n", F.array(*[parity_band(F.col("word"), k) for k in range(BANDS)]).alias("masks"))
    a, b = _keyed(masked, False).alias("a"), _keyed(masked, True).alias("b")
    keys = ["band", "mask", "grow", "size", "side", "half"]
    left = lambda t: F.substring(F.col(f"{t}.word"), F.lit(1), F.floor(F.col("a.size") / 2).cast("int"))
    first = F.lit(True)
    for k in range(BANDS - 1):
        first &= (F.col("a.band") <= k) | (F.col("a.masks")[k] != F.col("b.masks")[k])
    first &= (F.col("a.side") == 0) | (left("a") != left("b"))
    once = (F.col("a.grow") == 1) | (F.col("a.word") < F.col("b.word"))
    met = a.join(b.hint("merge"), [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]).where(once & first)
    return met.where(F.levenshtein("a.word", "b.word", 1) == 1).select(F.col("a.word").alias("a"), F.col("b.word").alias("b"), F.col("a.n").alias("a_n"), F.col("b.n").alias("b_n"))


def follow(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the last word reached. Counts at least double on the way, so it has an end, and each
    round doubles the steps taken."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("via"), F.col("root").alias("further"))
        stepped = materialize(now.join(ahead.hint("merge"), now["root"] == F.col("via"), "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if not stepped.where("moved").limit(1).count():
            return stepped.select("word", "root")
        now = stepped.select("word", "root")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of min_length code points and min_count occurrences.

    A word's form is its near word of largest n, the least in code-point order of equal ones, if that is twice the word's n
    or more; its root is where forms lead, the word itself without one. Null and empty texts have no words, an empty table
    gives an empty one; only id and text are read, whatever else there is. Texts are taken apart where they lie: what is
    shuffled is a row for each word of a task.
    """
    found = materialize(words(docs, id_col, text_col, min_length, min_count), "words")
    pairs = materialize(near_pairs(found), "near")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("m")).union(pairs.select("b", "a", "a_n"))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("other").alias("other"))).alias("best"))
    known = found.join(best.hint("merge"), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), *[F.when(-F.col("best.m") >= 2 * F.col("n"), x).alias(k) for k, x in (("form", F.col("best.other")), ("form_n", -F.col("best.m")))],
    )
    known = materialize(known, "forms")
    roots = follow(known.where("form IS NOT NULL"))
    return known.join(roots.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
