"""Op 13, fill-in-middle: texts cut into prefix, middle and suffix at units, as relations.

A text is a row of units, the matches of a pattern from left to right. Units
come as rows (posexplode) of runs of so many units; window running sums of the
runs' units and lengths say which units a run holds and where it begins; cut
requests are joined to the run that holds their unit. The run that is left is
taken apart in the same way, into shorter runs and at last into single units,
so a text makes a row for each ``SIZES[0]`` of its units and some rows more for
each cut, not one row for each unit. The cuts' offsets are summed up for each
document and its parts are substrings.

Only runs and cuts are shuffled, and each text once, to meet its offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import fresh

#: A unit: one code point.
UNIT = "."
#: Units of a run, from the first step to the last.
SIZES = (128, 16, 1)
MARKS = {"prefix": "<P>", "suffix": "<S>", "middle": "<M>"}
ANY_MARK = "<[PSM]>"
#: Percents of the texts that are left plain, and of the others that get the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20
SEED = "1"


def runs(text: Column, unit: str, size: int) -> Column:
    """The text's units in runs of ``size``, the last of what is left; what the pattern doesn't match is a unit by code points."""
    one = "." if unit == "." else f"(?:{unit}|.)"
    return F.regexp_extract_all(text, F.lit(f"(?s)(?:{one}){{1,{size}}}+"), F.lit(0))


def n_units(text: Column, unit: str) -> Column:
    """How many units a text has."""
    return F.length(text).cast("long") if unit == "." else F.size(runs(text, unit, 1)).cast("long")


def drawn(doc_id: Column, i: int, seed: str = SEED) -> Column:
    """The ``i``-th number (from 1) that a document draws: 32 bits of a hash of its id; a null id counts as empty."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digits, 8 * i - 7, 8), 16, 10).cast("long")


def _lower_runs(rows: DataFrame, keys: list[str], unit: str, size: int) -> DataFrame:
    """``rows`` (keys, cut, want, begin, piece: a run) with the run of ``size`` units in it that holds the unit wanted."""
    each = rows.select(*keys, "cut", "want", "begin", F.posexplode(runs(F.col("piece"), unit, size)).alias("at", "run"))
    before = Window.partitionBy(*keys, "cut").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    units = F.lit(1) if size == 1 else n_units(F.col("run"), unit)
    sized = each.withColumns({"units": units.cast("long"), "chars": F.length("run").cast("long")})
    summed = sized.withColumns({"units_before": F.coalesce(F.sum("units").over(before), F.lit(0)), "chars_before": F.coalesce(F.sum("chars").over(before), F.lit(0))})
    held = summed.where("units_before < want AND want <= units_before + units")
    return held.select(*keys, "cut", (F.col("want") - F.col("units_before")).alias("want"), (F.col("begin") + F.col("chars_before")).alias("begin"), F.col("run").alias("piece"))


def cut_offsets(texts: DataFrame, keys: list[str], unit: str = UNIT) -> DataFrame:
    """keys and, as ``cuts``, a map from each cut to the code points before it.

    ``texts``: keys, text and ``wanted``, a map from cuts to numbers of units
    (from 1 on; others have no row) after which they lie. Rows of equal keys are
    equal and count once.
    """
    asked = texts.select(*keys, "text", F.map_filter("wanted", lambda _, u: u > 0).alias("wanted")).where(F.size("wanted") > 0)
    requests = asked.select(*keys, F.explode("wanted").alias("cut", "want")).distinct()
    numbers = F.transform(F.map_values("wanted"), lambda u: F.floor((u - 1) / SIZES[0]).cast("int"))
    split = asked.select(*keys, numbers.alias("numbers"), runs(F.col("text"), unit, SIZES[0]).alias("runs"))
    # Of a run its length, and its text only if a cut lies in it.
    told = F.transform("runs", lambda r, i: F.struct(n_units(r, unit).alias("units"), F.length(r).cast("long").alias("chars"), F.when(F.array_contains("numbers", i), r).alias("piece")))
    # Repeated rows give the same runs; one of each stays. Taken before the shuffle as well.
    once = split.select(*keys, told.alias("runs")).groupBy(*keys).agg(F.first("runs").alias("runs"))
    sized = once.select(*keys, F.posexplode("runs").alias("at", "r")).select(*keys, "at", "r.*")
    before = Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumns({"units_before": F.coalesce(F.sum("units").over(before), F.lit(0)), "begin": F.coalesce(F.sum("chars").over(before), F.lit(0))}).where("piece IS NOT NULL")
    a, b = placed.alias("a"), requests.alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    # By the keys alone as an equality, so that the rows stay where the window has them.
    met = a.join(b, [*same, F.col("units_before") < F.col("want"), F.col("want") <= F.col("units_before") + F.col("units")])
    rows = met.select(*[F.col(f"a.{k}").alias(k) for k in keys], "cut", (F.col("want") - F.col("units_before")).alias("want"), "begin", "piece")
    for size in SIZES[1:]:
        rows = _lower_runs(rows, keys, unit, size)
    ends = rows.select(*keys, F.struct("cut", (F.col("begin") + F.length("piece")).alias("end")).alias("x"))
    return ends.groupBy(*keys).agg(F.map_from_entries(F.collect_list("x")).alias("cuts"))


def transform(docs: DataFrame, unit: str = UNIT, seed: str = SEED, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """``docs`` (doc_id, text and more) with fim: n, form, prefix, middle, suffix, output.

    n counts units. Prefix and middle end after two numbers of units drawn by
    the id. The form is ``plain`` (the text as it is; the parts are null) for
    empty texts, texts that hold a mark, and ``plain`` percent of the others;
    of the rest ``suffix_first`` percent are ``spm``, the others ``psm``.

    A null text counts as empty, a null id as an empty one; repeated rows come
    out alike, rows of one id and other texts each for itself; texts of any
    length are cut whole; further columns stay, unless one is named ``fim``,
    which is replaced. An empty table gives an empty result.
    """
    k1, k2, body, num, form, fore, back, cuts = own = fresh(docs, "id_key", "row_key", "body", "n_units", "form_name", "first_cut", "last_cut", "cuts")
    text, doc_id = F.coalesce("text", F.lit("")), F.col("doc_id")
    # A row's key: its id, and a hash of id and text.
    keyed = docs.withColumns({body: text, k1: F.coalesce(doc_id.cast("long"), F.lit(-1)), k2: F.xxhash64(doc_id, doc_id.isNull(), text)})
    held = keyed.withColumn(num, n_units(F.col(body), unit))
    left_plain = (F.col(num) == 0) | F.col(body).rlike(ANY_MARK) | (drawn(doc_id, 3, seed) % 100 >= 100 - plain)
    one, two = (drawn(doc_id, i, seed) % (F.col(num) + 1) for i in (1, 2))
    named = held.withColumns({form: F.when(left_plain, "plain").when(drawn(doc_id, 4, seed) % 100 < suffix_first, "spm").otherwise("psm"), fore: F.least(one, two), back: F.greatest(one, two)})
    wanted = named.where(F.col(form) != "plain").select(k1, k2, F.col(body).alias("text"), F.create_map(F.lit("prefix"), F.col(fore), F.lit("middle"), F.col(back)).alias("wanted"))
    offsets = cut_offsets(wanted, [k1, k2], unit).withColumnRenamed("cuts", cuts)
    placed = named.join(offsets, [k1, k2], "left")
    end = lambda cut: F.coalesce(F.try_element_at(cuts, F.lit(cut)), F.lit(0)).cast("int")
    cut = lambda part: F.when(F.col(form) != "plain", part)
    prefix = cut(F.substring(body, F.lit(1), end("prefix")))
    middle = cut(F.substring(body, end("prefix") + 1, end("middle") - end("prefix")))
    suffix = cut(F.substring(body, end("middle") + 1, F.length(body)))
    p, s, m = (F.lit(MARKS[x]) for x in ("prefix", "suffix", "middle"))
    output = F.when(F.col(form) == "psm", F.concat(p, prefix, s, suffix, m, middle)).when(F.col(form) == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(F.col(body))
    fim = F.struct(F.col(num).alias("n"), F.col(form).alias("form"), prefix.alias("prefix"), middle.alias("middle"), suffix.alias("suffix"), output.alias("output"))
    return placed.withColumn("fim", fim).drop(*own)


def restored(output: Column, form: Column) -> Column:
    """The text of an output: its parts stand between marks, which no cut text holds."""
    parts = F.split(output, ANY_MARK, -1)
    part = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)
