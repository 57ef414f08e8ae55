"""Where values stand in lines: some runs of each value looked up, the rest compared in place.

A line is cut by a pattern into runs and what stands between them.  A value is
cut by the same pattern, so where it occurs between the pattern's boundaries it
is a number of whole runs with the text between them.  All runs of a value, or
of a longer one the WINDOW runs in a row that fewest other values have, are its
anchor, known by a hash; so the four numbers of an address are one anchor, not
numbers that thousands of addresses share.  A bitmap of the anchors, of a fixed
size, tells for each window of a line whether it can be one; only those become
rows, with as much of the line as the longest value needs, to be joined with the
values by equality and compared in the row.  A line without an anchor gives no
row.  Blanks, slashes, ranges and mailboxes inside a value need no rule.

Two cuts are used: RUN for replacing and WORD, which is finer, for the proof.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskline.sources.store import kept

_QUAD = r"(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\w)"
_COLONS = r"(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}"
#: Addresses, which a hyphen may join to others, then words with their dots and hyphens, and one dollar at the end of a word.
RUN = (
    rf"(?<![\w.]){_QUAD}"
    rf"|(?<![\w:.])(?=[0-9A-Fa-f:]*::|(?:[0-9A-Fa-f]{{1,4}}:){{5}}){_COLONS}(?![\w:])"
    rf"|(?:[\p{{L}}\p{{N}}_.]++|-(?!{_QUAD}|(?:[0-9A-Fa-f]{{1,4}}:){{2}}|[0-9A-Fa-f]{{1,4}}::))++(?:(?<=[\p{{L}}\p{{N}}_])\$(?![\p{{L}}\p{{N}}_$]|\.[\p{{L}}\p{{N}}_]))?+"
)
WORD = r"[\p{L}\p{N}_]++"
#: What ends a sentence after a run, or marks a machine, and may belong to the value or not.
TRAIL = ".-$"
#: The key of a JSON member, with its quotes.
JSON_KEY = r'"(?:[^"\\]|\\.)*+"(?=\s*:)'
#: Kinds of value that may be replaced where they are a whole JSON key.
KEY_KINDS = ["email", "ipv4", "ipv6", "mac"]
#: Runs of an anchor, at most.
WINDOW = 4
#: Bits of the anchors' map (2 MB, a subquery's result and no part of the plan's text); more anchors only make more rows.
BITS = 24


def is_json(raw: Column) -> Column:
    return raw.rlike(r"^\s*[{\[]") & F.try_parse_json(raw).isNotNull()


def cut(raw: Column, run: str, keys: bool) -> tuple[Column, Column]:
    """The runs of a line and the texts around them, one more; with ``keys``, JSON keys are runs of their own."""
    runs, between = F.regexp_extract_all(raw, F.lit(run), F.lit(0)), F.split(raw, run, -1)
    if keys:
        with_keys = f"{JSON_KEY}|{run}"
        runs = F.when(is_json(raw), F.regexp_extract_all(raw, F.lit(with_keys), F.lit(0))).otherwise(runs)
        between = F.when(is_json(raw), F.split(raw, with_keys, -1)).otherwise(between)
    return runs, between


def _short(r: Column) -> Column:
    """A run without the marks that may belong to the value or not; the first of them where it has nothing else."""
    bare = F.coalesce(F.nullif(F.rtrim(r, F.lit(TRAIL)), F.lit("")), F.left(r, F.lit(1)))
    return F.when(F.substring(r, -1, 1).isin(*TRAIL), bare).otherwise(r)


def _ends(runs: Column, run: str) -> Column:
    """Hashes of lower-case runs as the last ones of an anchor: without trailing marks."""
    return F.transform(runs, lambda r: F.xxhash64(_short(r) if run == RUN else r))


def _anchor(runs: Column, ends: Column, last: Column, size: int) -> Column:
    """The hash of so many runs, of which ``last`` numbers the last one; ``ends`` are the hashes of last runs."""
    return F.xxhash64(*[F.xxhash64(F.get(runs, last - k)) for k in range(size - 1, 0, -1)], F.get(ends, last))


def _windows(runs: Column, ends: Column, size: int) -> Column:
    """(anchor, i) of every window of that size over lower-case runs."""
    lasts = F.when(F.size(runs) >= size, F.sequence(F.lit(size - 1), F.size(runs) - 1))
    return F.transform(lasts, lambda k: F.struct(_anchor(runs, ends, k, size).alias("anchor"), (k - (size - 1)).alias("i")))


def sought(entries: DataFrame, run: str) -> DataFrame:
    """Enabled entries with ``low`` (their text from first to last run, lower case), ``n`` runs, ``lead`` and ``tail``, and their
    ``anchor``, the window of ``size`` runs at run number ``place``: all runs, or of more than WINDOW those which fewest values have;
    ``end`` is the hash of the anchor's last run."""
    runs, between = cut(F.col("original"), run, keys=False)
    rows = entries.where("enabled").withColumns({"n": F.size(runs), "lead": F.element_at(between, 1), "tail": F.element_at(between, -1), "runs": F.transform(runs, F.lower)})
    body = F.expr("substring(original, length(lead) + 1, length(original) - length(lead) - length(tail))")
    rows = rows.where("n > 0").withColumns({"low": F.lower(body), "size": F.least("n", F.lit(WINDOW))})
    rows, windows = rows.withColumn("ends", _ends(F.col("runs"), run)), F.lit(None)
    for n in range(1, WINDOW + 1):
        windows = F.when(F.col("size") == n, _windows(F.col("runs"), F.col("ends"), n)).otherwise(windows)
    each = rows.select("*", F.explode(windows).alias("w")).select(
        *rows.columns, F.col("w.anchor").alias("anchor"), F.col("w.i").alias("place"), F.get("ends", F.col("w.i") + F.col("size") - 1).alias("end")
    ).drop("runs", "ends")
    long = each.where(f"n > {WINDOW}")
    times = long.groupBy("anchor").agg(F.count("*").alias("times"))
    order = Window.partitionBy("original", "kind").orderBy("times", "place")
    best = long.join(times, "anchor").withColumn("r", F.row_number().over(order)).where("r = 1")
    return each.where(f"n <= {WINDOW}").unionByName(best.select(each.columns))


def _slot(anchor: Column) -> Column:
    return anchor.bitwiseAND(F.lit((1 << BITS) - 1))


def _bitmap(values: DataFrame, name: str) -> Column:
    """The slots of all hashes of that name: 2**BITS bits, whatever their number."""
    slot = _slot(F.col(name))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))
    words = values.select(F.shiftright(slot, 6).alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    every = values.sparkSession.range(1 << (BITS - 6)).withColumnRenamed("id", "w").join(words, "w", "left").select("w", F.coalesce("b", F.lit(0).cast("long")).alias("b"))
    return every.agg(F.sort_array(F.collect_list(F.struct("w", "b")))["b"]).scalar()


def _in(bitmap: Column, hash_: Column) -> Column:
    slot = _slot(hash_)
    return F.getbit(F.get(bitmap, F.shiftright(slot, 6).cast("int")), slot.bitwiseAND(F.lit(63)).cast("int")) == 1


def matches(lines: DataFrame, values: DataFrame, run: str, keys: bool = True) -> DataFrame:
    """Where the ``sought`` values stand but for case: their columns with (sample_id, line_no, at, n, hit, cut, key).

    ``at`` numbers the first run, ``hit`` is the text from first to last run,
    ``cut`` counts trailing dots, hyphens and dollars left out of the last run,
    ``key`` says that the hit is a whole JSON key.
    """
    runs, between = cut(F.col("raw"), run, keys)
    values = kept(values)
    reach = values.agg(F.collect_set("size").alias("sizes"), F.max("place").alias("before"), F.max(F.col("n") - F.col("place")).alias("after")).first()
    before, after = reach.before or 0, reach.after or 1

    def plain(r: Column) -> Column:
        return F.lower(F.when(r.startswith('"'), F.substring(r, F.lit(2), F.length(r) - 2)).otherwise(r) if keys else r)

    sizes = sorted(reach.sizes) or [1]
    rows = lines.select("sample_id", "line_no", runs.alias("runs"), between.alias("between"))
    each = rows.select("*", F.posexplode(_ends(F.transform("runs", plain), run)).alias("last", "e"))
    # Windows are made only where a run may be the last of an anchor, of the line only what the longest value may cover; ``skip`` runs are left out before it.
    each = each.where(_in(_bitmap(values, "end"), F.col("e"))).withColumn("skip", F.greatest(F.col("last") - (sizes[-1] - 1 + before), F.lit(0)))
    long = before + after + sizes[-1] - sizes[0]
    each = each.select("sample_id", "line_no", "skip", (F.col("last") - F.col("skip")).alias("last"), F.slice("runs", F.col("skip") + 1, F.lit(long)).alias("runs"), F.slice("between", F.col("skip") + 1, F.lit(long + 1)).alias("between"))
    each = each.withColumn("low", F.transform("runs", plain))
    each = each.withColumn("ends", _ends(F.col("low"), run))
    start = lambda n: F.col("last") - (n - 1)
    windows = F.array(*[F.when(start(n) >= 0, F.struct(_anchor(F.col("low"), F.col("ends"), F.col("last"), n).alias("anchor"), start(n).alias("i"))) for n in sizes])
    each = each.select("sample_id", "line_no", "skip", "runs", "between", F.inline(windows)).where(_in(_bitmap(values, "anchor"), F.col("anchor")))
    met = each.join(values, "anchor").withColumn("at", F.col("i") - F.col("place")).where("at >= 0 and at + n <= size(runs)")
    first = F.greatest("at", F.lit(0))  # slices may be made before the rows are tested
    inner = F.flatten(F.zip_with(F.slice("runs", first + 1, F.col("n") - 1), F.slice("between", first + 2, F.col("n") - 1), lambda a, b: F.array(a, b)))
    last = F.get("runs", F.col("at") + F.col("n") - 1)
    met = met.withColumn("last", last).withColumn("key", (F.col("n") == 1) & F.lit(keys) & F.col("last").startswith('"'))
    bare = F.when(F.col("key"), F.regexp_replace("last", '^"|"$', "")).otherwise(F.col("last"))
    met = met.withColumn("whole", F.when(F.col("n") == 1, bare).otherwise(F.concat(F.array_join(inner, ""), F.col("last"))))
    # As much of the span as the value is long; what is left must be trailing marks.
    met = met.withColumn("hit", F.expr("left(whole, length(low))")).withColumn("cut", F.expr("length(whole) - length(low)"))
    fits = (F.lower("hit") == F.col("low")) & (F.col("cut") >= 0)
    rest = F.expr("substring(whole, length(low) + 1)")
    fits &= (F.col("cut") == 0) | (rest.rlike(r"^[.\-$]+$") & ~F.col("key") & F.lit(run == RUN))
    around = F.get("between", F.col("at")).endswith(F.col("lead")) & F.get("between", F.col("at") + F.col("n")).startswith(F.col("tail"))
    around &= (F.length("tail") == 0) | (F.col("cut") == 0)
    found = met.where(fits & around).withColumn("at", F.col("at") + F.col("skip"))
    return found.drop("runs", "between", "anchor", "end", "i", "place", "size", "skip", "last", "whole", "low")
