"""Secret scans with DataFrame functions only: patterns, and windows of candidate strings whose Shannon entropy is that of keys."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightlights.llm.tables import quoted

_KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
_EITHER_CASE = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in _KEYWORDS)
VALUE = "[A-Za-z0-9+/_.=-]+"
ASSIGN = rf"""({_EITHER_CASE})["']?\x20*[:=]\x20*["']?({VALUE})"""
#: A match under these lengths is dropped; as the runs are maximal, asking for the length in the pattern drops the same ones.
ACCESS, HEX = "AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}"
MIN_VALUE = 6
KINDS = ("assign", "access", "hex", "random_hex", "random_base32", "random_base64")

WINDOW = 24
CANDIDATE = f"[A-Za-z0-9+/_=-]{{{WINDOW},}}"
#: A candidate belongs to the first class that holds all of it: (kind, pattern, least bits a character in a window). Bits lie
#: below what WINDOW random characters of the class have by chance, and above words and paths.
CLASSES = ((3, "^([0-9a-f]+|[0-9A-F]+)$", 3.0), (4, "^[A-Z2-7]+=*$", 3.55), (5, ".", 3.95))
#: Strings in lower case that mark an example.
ALLOWED = ("example", "sample", "placeholder", "dummy", "changeme", "test_key", "xxxxxx", "0123456789", "abcdefghij")
#: Numbers, ids in the usual groups of hexadecimal digits, and words with nothing but signs between.
ALLOWED_PATTERNS = ("^[0-9+/_=-]+$", "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", "^[+/_=-]*[A-Z]?[a-z]+([+/_=-]+[A-Z]?[a-z]+)*[+/_=-]*$")
#: Millionths of count * log2(count): whole numbers, so that sums are exact in any order.
WEIGHTS = [round(1e6 * c * math.log2(c)) if c else 0 for c in range(WINDOW + 1)]
LIMITS = {kind: WEIGHTS[WINDOW] - round(1e6 * WINDOW * bits) for kind, _, bits in CLASSES}
#: Windows of a candidate, and lengths, that are taken together.
BLOCK = 256
_SPAN = "array<struct<start int, kind int, end int>>"


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, with x evaluated once."""
    return F.transform(F.array(x), f)[0]


def running(lengths: Column) -> Column:
    """Sums of an array up to each place. Sums of blocks first, then within them, so time doesn't grow with the square of a long array's size."""
    none = F.array().cast("array<int>")

    def sums(values: Column, first: Column) -> Column:
        put = lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"] + x)).alias("out"))
        return F.aggregate(values, F.struct(first.alias("at"), none.alias("out")), put)["out"]

    def whole(v: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int"))
        blocks = F.transform(starts, lambda b: F.slice(v, b * BLOCK + 1, BLOCK))
        totals = lambda bs: F.transform(bs, lambda b: F.aggregate(b, F.lit(0), lambda s, x: s + x))
        return _let(blocks, lambda bs: _let(sums(totals(bs), F.lit(0)), lambda ends: F.flatten(F.transform(bs, lambda b, k: sums(b, F.when(k == 0, 0).otherwise(F.get(ends, k - 1)))))))

    return _let(lengths, lambda v: F.when(F.size(v) > 0, whole(v)).otherwise(none))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, found>>, in code points: a text is cut at the matches, and lengths of what is between give their places."""
    cast = "array<struct<start int, end int, found string>>"

    def placed(found: Column) -> Column:
        between = F.split(text, pattern, -1)
        ends = _let(between, lambda p: running(F.transform(found, lambda m, k: F.length(F.get(p, k)) + F.length(m))))
        return _let(ends, lambda e: F.transform(found, lambda m, k: F.struct((F.get(e, k) - F.length(m)).alias("start"), F.get(e, k).alias("end"), m.alias("found"))))

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, placed(found)).otherwise(F.array())).cast(cast)


def _spans(found: Column, kind: int) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end"))).cast(_SPAN)


def _class_of(candidate: Column) -> Column:
    """The number of a candidate's class, null if the allow-list has it."""
    allowed = F.lit(False)
    for x in ALLOWED:
        allowed |= F.contains(F.lower(candidate), F.lit(x))
    for x in ALLOWED_PATTERNS:
        allowed |= F.rlike(candidate, F.lit(x))
    kind = F.when(allowed, F.lit(None).cast("int"))
    for k, pattern, _ in CLASSES:
        kind = kind.when(F.rlike(candidate, F.lit(pattern)), k)
    return kind


def _hot_windows(part: Column, limit: Column) -> Column:
    """array<struct<start, end>> in part: unions of the windows with enough entropy.

    Counts of the window's characters are a string with one place for each character code. A step takes one character out
    and puts one in, and changes the sum of count * log2(count) by what these two counts add; nothing is counted again.
    """
    gain = F.array(*[F.lit(b - a) for a, b in zip(WEIGHTS, WEIGHTS[1:], strict=False)])
    count = lambda s, e: F.ascii(F.substring(s["counts"], e["code"] + 1, F.lit(1))) - 48
    begun = F.struct(
        F.lit(0).alias("seen"), F.repeat(F.lit("0"), F.lit(128)).alias("counts"), F.lit(0).alias("sum"), F.lit(-1).alias("start"), F.lit(-1).alias("end"),
        F.array().cast("array<struct<start int, end int>>").alias("out"),
    )

    def moved(s: Column, e: Column) -> Column:
        c = count(s, e)
        now = F.struct(
            F.overlay(s["counts"], F.char(c + e["by"] + 48), e["code"] + 1, F.lit(1)).alias("counts"),
            (s["sum"] + F.when(e["by"] > 0, F.get(gain, c)).otherwise(-F.get(gain, c - 1))).alias("sum"), (s["seen"] + F.when(e["by"] > 0, 1).otherwise(0)).alias("seen"),
        )
        return _let(now, lambda n: judged(s, e, n))

    def judged(s: Column, e: Column, n: Column) -> Column:
        hit = (e["by"] > 0) & (n["seen"] >= WINDOW) & (n["sum"] <= limit)
        new = hit & ((s["start"] < 0) | (n["seen"] - WINDOW > s["end"]))
        return F.struct(
            n["seen"].alias("seen"), n["counts"].alias("counts"), n["sum"].alias("sum"), F.when(new, n["seen"] - WINDOW).otherwise(s["start"]).alias("start"), F.when(hit, n["seen"]).otherwise(s["end"]).alias("end"),
            F.when(new & (s["start"] >= 0), F.concat(s["out"], F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))).otherwise(s["out"]).alias("out"),
        )

    event = lambda code, by: F.struct(code.alias("code"), F.lit(by).alias("by"))
    steps = lambda codes: F.flatten(F.transform(codes, lambda c, k: F.when(k >= WINDOW, F.array(event(F.get(codes, k - WINDOW), -1), event(c, 1))).otherwise(F.array(event(c, 1)))))
    codes = F.transform(F.filter(F.split(part, ""), lambda c: F.length(c) > 0), lambda c: F.ascii(c))
    last = lambda s: F.concat(s["out"], F.when(s["start"] >= 0, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end")))).otherwise(F.array().cast("array<struct<start int, end int>>")))
    return _let(codes, lambda x: F.aggregate(steps(x), begun, moved, last))


def random_spans(candidates: Column) -> Column:
    """Spans of the windows of candidate strings that look random for their class of characters. A long candidate is taken in
    blocks of windows, and spans that meet at a block's border are one."""
    limit_of = F.create_map(*[x for k, v in LIMITS.items() for x in (F.lit(k), F.lit(v))])

    def spans(m: Column, kind: Column) -> Column:
        letters = m["found"].cast("binary")
        starts = F.sequence(F.lit(0), F.length(m["found"]) - WINDOW, F.lit(BLOCK))
        hot = lambda k: _hot_windows(F.substring(letters, k + 1, F.lit(BLOCK + WINDOW - 1)).cast("string"), F.element_at(limit_of, kind))
        found = F.flatten(F.transform(starts, lambda k: F.transform(hot(k), lambda s: F.struct((m["start"] + k + s["start"]).alias("start"), kind.alias("kind"), (m["start"] + k + s["end"]).alias("end")))))

        def joined(all_: Column) -> Column:
            first = F.filter(all_, lambda s, k: (k == 0) | (F.get(all_, k - 1)["end"] < s["start"]))
            last = F.filter(all_, lambda s, k: (k == F.size(all_) - 1) | (F.get(all_, k + 1)["start"] > s["end"]))
            return F.zip_with(first, last, lambda a, b: F.struct(a["start"].alias("start"), kind.alias("kind"), b["end"].alias("end")))

        return _let(found, joined)

    each = F.transform(candidates, lambda m: _let(_class_of(m["found"]), lambda kind: F.when(kind.isNotNull(), spans(m, kind)).otherwise(F.array().cast(_SPAN))))
    return F.flatten(each).cast(_SPAN)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, secrets array<struct<start, kind, end>>) for each row, in code points, by start, kind (a place in KINDS) and end.

    Patterns give assigned values, access keys and long hexadecimal runs; these stay whatever the allow-list says. Runs that
    could be keys are classed by their characters, and windows of enough entropy add spans of the random kinds. A null text is
    an empty one and has none; rows keep their id, null or repeated; further columns aren't read. No shuffle, no Python.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).cast("string").alias("text"))
    long_enough = F.filter(matches(text, ASSIGN), lambda m: F.length(F.regexp_extract(m["found"], ASSIGN, 2)) >= MIN_VALUE)
    parts = [_spans(long_enough, 0), _spans(matches(text, ACCESS), 1), _spans(matches(text, HEX), 2), random_spans(matches(text, CANDIDATE))]
    return rows.select(F.col("id").alias(id_col), F.array_sort(F.concat(*parts)).alias("secrets"))


def described(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
