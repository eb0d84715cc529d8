"""Secrets in texts: three fixed patterns, and a battery of randomness tests for other tokens.

Positions come from marking each match in the text and adding up the lengths between the marks,
one row per mark, so a text with any number of matches is handled in linear work.

A token of the method is a maximal run of 20 or more encoding characters. Its encoding is inferred
(decimal, hex, base32, base64), and it is tested two ways. Against ordinary text: fewer coincidences
of symbols, and more runs of character classes, than words have; both p-values are combined by
Fisher's rule. Against uniform symbols: chi-squared over the alphabet and lag-1 serial correlation
must not speak against randomness. The first p-values go through the Benjamini-Hochberg rule within
classes of token length over the whole corpus, so short tokens, which are many and weak, do not
borrow significance from long ones.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.llm.common import staged, table, whole_text

KINDS = ("assign", "access", "hex", "random")
# The look-ahead only speeds up the search.
ASSIGN = r"""(?=[PpSsTtAa])((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PATTERNS = {
    "assign": ASSIGN,
    # A shorter match would fail, and a run of these characters has no other start: same matches.
    "access": "AKIA[A-Z0-9]{12,}",
    # Runs from their beginning on: a shorter rest of a run cannot match either.
    "hex": "(?<![0-9a-f])[0-9a-f]{32,}",
    "random": "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}",
}
MIN_VALUE = 8
#: Share of false finds to allow, and the p-value under which a token is not uniform.
FALSE_DISCOVERY = 0.01
NOT_UNIFORM = 1e-4
#: p-values are rounded up to this many steps per power of ten.
STEPS = 20
#: Symbol coincidence and triple coincidence of ordinary words, and how often their class changes.
TEXT_PAIR, TEXT_TRIPLE, TEXT_CHANGE = 0.066, 0.0065, 0.1

_OPEN, _CLOSE, _OTHER = "\x01", "\x02", "\x03"
_DECIMAL = string.digits
_HEX = string.digits + "abcdef"
_BASE32 = string.ascii_uppercase + "234567"
_BASE64 = string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/"


def _parts(body: Column, kind: str) -> Column:
    """Array of (kind, i, token, rest): matches from i = 1 on, each with the length of what follows
    it up to the next one; i = 0 is what precedes the first."""
    # The marks occur in no match, so those of the text itself can be replaced in place.
    clean = F.translate(body, _OPEN + _CLOSE, _OTHER + _OTHER)
    marked = F.regexp_replace(clean, F.lit(PATTERNS[kind]), F.lit(f"{_OPEN}$0{_CLOSE}"))
    # Each array is made once: lambdas below see their own element only.
    return F.transform(
        F.split(marked, _OPEN),
        lambda part, i: F.struct(
            F.lit(KINDS.index(kind)).alias("kind"),
            i.alias("i"),
            F.when(i > 0, F.substring_index(part, _CLOSE, 1)).alias("token"),
            F.char_length(F.substring_index(part, _CLOSE, -1)).alias("rest"),
        ),
    )


def _upper_tail(z: Column) -> Column:
    """P(Z >= z) of a standard normal, by a logistic approximation good to about 1e-4."""
    bounded = F.greatest(F.lit(-8.0), F.least(F.lit(20.0), z))
    return 1 / (1 + F.exp(1.5976 * bounded + 0.070565 * bounded * bounded * bounded))


def with_battery(frame: DataFrame, token: str) -> DataFrame:
    """``frame`` with encoding, p_text (small: not ordinary text) and uniform (no test speaks
    against random symbols) of a token column; null for a null token.

    One step builds on the columns of the last, so that no array or count is made twice.
    """
    total = lambda array: F.aggregate(array, F.lit(0.0), lambda acc, v: acc + v)
    c = {name: F.col(f"_{name}") for name in ("plain", "symbols", "alphabet", "n", "size", "squares", "values", "centred", "runs")}
    frame = frame.withColumn("_plain", F.regexp_replace(F.translate(token, "-_", "+/"), "=+$", ""))
    frame = frame.withColumn(
        "encoding",
        F.when(c["plain"].isNull(), None)
        .when(c["plain"].rlike("^[0-9]+$"), "decimal")
        .when(c["plain"].rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex")
        .when(c["plain"].rlike("^[A-Z2-7]+$"), "base32")
        .otherwise("base64"),
    )
    alphabet = F.lit(_BASE64)
    for name, letters in (("decimal", _DECIMAL), ("hex", _HEX), ("base32", _BASE32)):
        alphabet = F.when(F.col("encoding") == name, letters).otherwise(alphabet)
    frame = frame.withColumns(
        {"_symbols": F.when(F.col("encoding") == "hex", F.lower(c["plain"])).otherwise(c["plain"]), "_alphabet": alphabet}
    )
    kinds = "U" * 26 + "L" * 26 + "D" * 10 + "SS"
    runs = F.length(F.regexp_replace(F.translate(c["plain"], _BASE64, kinds), r"(.)\1+", "$1"))
    frame = frame.withColumns(
        {
            "_n": F.length(c["symbols"]).cast("double"),
            "_size": F.length(c["alphabet"]).cast("double"),
            "_runs": runs.cast("double"),
            "_values": F.transform(F.split(c["symbols"], ""), lambda s: F.instr(c["alphabet"], s).cast("double")),
            "_squares": total(
                F.transform(
                    F.split(c["alphabet"], ""),
                    lambda s: F.pow((F.length(c["symbols"]) - F.length(F.replace(c["symbols"], s, F.lit("")))).cast("double"), F.lit(2.0)),
                )
            ),
        }
    )
    frame = frame.withColumn("_mean", total(c["values"]) / c["n"])
    frame = frame.withColumn("_centred", F.transform(c["values"], lambda v: v - F.col("_mean")))
    ahead = F.slice(c["centred"], F.lit(2), F.greatest(F.size(c["centred"]) - 1, F.lit(0)))
    frame = frame.withColumns(
        {
            "_product": total(F.zip_with(c["centred"], ahead, lambda a, b: F.coalesce(a * b, F.lit(0.0)))),
            "_total": total(F.transform(c["centred"], lambda v: v * v)),
        }
    )
    n, squares, free = c["n"], c["squares"], c["size"] - 1
    pairs = n * (n - 1)
    spread = 2 * TEXT_PAIR * (1 - TEXT_PAIR) * pairs + 4 * pairs * (n - 2) * (TEXT_TRIPLE - TEXT_PAIR**2)
    changes = TEXT_CHANGE * (n - 1)
    chi = c["size"] / n * squares - n
    serial = F.when(F.col("_total") > 0, F.col("_product") / F.col("_total")).otherwise(1.0)
    frame = frame.withColumns(
        {
            "_z_pairs": (squares - n - TEXT_PAIR * pairs) / F.sqrt(F.greatest(spread, F.lit(1.0))),
            "_z_runs": (c["runs"] - 1 - changes - 0.5) / F.sqrt(changes * (1 - TEXT_CHANGE)),
            "_z_chi": (F.pow(F.greatest(chi, F.lit(0.0)) / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free)),
            "_z_serial": F.abs(serial + 1 / n) * F.sqrt(n),
        }
    )
    fisher = -sum(F.log(F.greatest(p, F.lit(1e-300))) for p in (1 - _upper_tail(F.col("_z_pairs")), _upper_tail(F.col("_z_runs"))))
    frame = frame.withColumn("_fisher", fisher)
    uniform = (_upper_tail(F.col("_z_chi")) >= NOT_UNIFORM) & (2 * _upper_tail(F.col("_z_serial")) >= NOT_UNIFORM)
    frame = frame.withColumns({"p_text": F.exp(-F.col("_fisher")) * (1 + F.col("_fisher")), "uniform": uniform})
    return frame.drop(*(f for f in frame.columns if f.startswith("_")))


def spans(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows (row, key, kind, start, end, p_text, uniform), kind as index in KINDS; every row of
    ``docs`` has one row more with a null kind. Failing matches of the fixed patterns are gone; tokens of
    the method are all there, apart from those that overlap a span of a fixed pattern."""
    body = whole_text(text)
    found = F.concat(*(_parts(body, kind) for kind in KINDS))
    # The number is given below the explosion: one for each row of docs.
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), found.alias("found"))
    rows = rows.select("row", "key", F.explode("found").alias("m")).select("row", "key", "m.*")
    value = F.length(F.regexp_extract("token", PATTERNS["assign"], 2))
    random = F.col("kind") == KINDS.index("random")
    tested = random & F.col("token").isNotNull()
    size = F.coalesce(F.char_length("token"), F.lit(0))
    rows = rows.select(
        "row", "key", "kind", "i", size.alias("size"), (size + F.col("rest")).alias("step"),
        F.when(F.col("i") == 0, False).when(F.col("kind") == 0, value >= MIN_VALUE).otherwise(True).alias("holds"),
        F.when(tested, F.col("token")).alias("token"),
    )
    rows = with_battery(rows, "token").drop("token", "encoding")
    before = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.repartition("row").withColumn("start", F.coalesce(F.sum("step").over(before), F.lit(0)))
    placed = placed.withColumn("end", F.col("start") + F.col("size"))
    # One row without a span keeps the document.
    first = (F.col("kind") == 0) & (F.col("i") == 0)
    placed = placed.filter(F.col("holds") | first)
    placed = placed.withColumn("kind", F.when(F.col("i") > 0, F.col("kind")))
    random = F.coalesce(random, F.lit(False))
    base = F.col("kind") < KINDS.index("random")
    base_end = F.when(base, F.col("end"))
    base_start = F.when(base, F.col("start"))
    by_start = Window.partitionBy("row").orderBy("start", "kind")
    reached = F.max(base_end).over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    # Spans of the method do not overlap each other, so one order serves for both directions.
    ahead = F.min(base_start).over(by_start.rowsBetween(1, Window.unboundedFollowing))
    overlap = random & (F.coalesce(reached > F.col("start"), F.lit(False)) | F.coalesce(ahead < F.col("end"), F.lit(False)))
    placed = placed.withColumn("overlap", overlap)
    return placed.filter("NOT overlap").select("row", "key", "kind", "start", "end", "p_text", "uniform")


def discoveries(found: DataFrame) -> DataFrame:
    """The largest step of p_text that passes, for each class of token length: a bounded table."""
    tokens = found.filter(F.col("kind") == KINDS.index("random"))
    counts = tokens.groupBy(_length_class().alias("length_class"), _step().alias("step")).count()
    down = Window.partitionBy("length_class").orderBy(F.col("step").desc())
    ranked = counts.withColumn("rank", F.sum("count").over(down)).withColumn("m", F.sum("count").over(Window.partitionBy("length_class")))
    passing = F.pow(F.lit(10.0), -F.col("step") / STEPS) <= FALSE_DISCOVERY * F.col("rank") / F.col("m")
    return ranked.filter(passing).groupBy("length_class").agg(F.min("step").alias("least_step"))


def _length_class() -> Column:
    return F.floor(F.log2(F.col("end") - F.col("start"))).cast("int")


def _step() -> Column:
    return F.floor(-F.log10(F.greatest(F.col("p_text"), F.lit(1e-300))) * STEPS).cast("int")


def secrets(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: key and spans, an array of (start, kind, end) in order.

    Null text counts as empty and has no spans; positions are code points, ends exclusive; rows
    may repeat, and a null key is kept. Other columns are not read. No rows: no rows.
    """
    found = staged(spans(docs, text, key), "spans")
    # At most one row for each power of two of the token length.
    limits = F.broadcast(discoveries(found))
    marked = found.withColumn("length_class", _length_class()).join(limits, "length_class", "left")
    base = F.col("kind") < KINDS.index("random")
    passed = base | F.coalesce(F.col("uniform") & (_step() >= F.col("least_step")), F.lit(False))
    span = F.when(passed, F.struct("start", "kind", "end"))
    return marked.groupBy("row", "key").agg(F.array_sort(F.collect_list(span)).alias("spans")).select(F.col("key").alias(key), "spans")


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets(table(spark, sf_dir, "documents"))
    names = F.array(*map(F.lit, KINDS))
    joined = lambda part: F.array_join(
        F.transform(part, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ","
    )
    base = F.filter("spans", lambda s: s["kind"] < KINDS.index("random"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select(
        "doc_id",
        *(count(k) for k in range(3)),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
