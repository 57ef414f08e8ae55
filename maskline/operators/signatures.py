"""Sources recognised by the words of a name, by JSON keys and by the Windows channel.

The tables of hints and signatures are fixed and small; names meet them in
equi-joins on a token or on a beginning, never as a cross join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskline.functions import hints

SHORTEST_GLUED = 3


def name_tokens(name: Column) -> Column:
    """Lower-case words of a label: cut at separators, at capitals, and between letters and digits."""
    for pattern in (r"([a-z])([A-Z])", r"([A-Z]+)([A-Z][a-z])", r"([a-zA-Z])(\d)", r"(\d)([a-zA-Z])"):
        name = F.regexp_replace(name, pattern, "$1 $2")
    return F.filter(F.split(F.lower(F.regexp_replace(name, r"[\s:/\-_.]+", " ")), " "), lambda x: x != "")


def _hints(like: DataFrame) -> DataFrame:
    rows = [(i, *hint) for i, hint in enumerate(hints.HINTS)]
    return like.sparkSession.createDataFrame(rows, "rank int, hint array<string>, vendor string, product string, family string, glued boolean")


def vendor_hints(names: DataFrame) -> DataFrame:
    """(name, vendor, product, family) of the hint with most words, all of them in the name; then of glued beginnings."""
    known = _hints(names)
    rows = names.select("name").distinct().withColumn("tokens", name_tokens(F.col("name")))
    first = known.withColumn("token", F.col("hint")[0])
    found = rows.withColumn("token", F.explode(F.array_distinct("tokens"))).join(F.broadcast(first), "token")
    found = found.where(F.size(F.array_except("hint", "tokens")) == 0).withColumn("strength", F.size("hint"))

    lone = F.filter("tokens", lambda x: ~x.isin(hints.FORMAT_TOKENS))
    alone = rows.withColumn("lone", lone).where(F.size("lone") == 1).select("name", F.col("lone")[0].alias("lone"))
    ends = F.sequence(F.lit(SHORTEST_GLUED), F.greatest(F.length("lone") - 1, F.lit(SHORTEST_GLUED)))
    starts = F.transform(ends, lambda n: F.substring(F.col("lone"), F.lit(1), n))
    glued = known.where("glued").withColumn("start", F.col("hint")[0])
    tail = F.lit(True)
    for start, words in hints.GLUED_REST.items():
        tail &= (F.col("start") != start) | F.substring(F.col("lone"), F.lit(len(start) + 1), F.length("lone")).rlike("|".join(words))
    begun = alone.where(F.length("lone") > SHORTEST_GLUED).withColumn("start", F.explode(starts)).join(F.broadcast(glued), "start").where(tail)
    begun = begun.join(found.select("name").distinct(), "name", "left_anti").withColumn("strength", F.length("start"))

    columns = ["name", "strength", "rank", "vendor", "product", "family"]
    both = found.select(columns).unionByName(begun.select(columns))
    best = both.groupBy("name").agg(F.max_by(F.struct("vendor", "product", "family"), F.struct("strength", (-F.col("rank")).alias("r"))).alias("b"))
    return best.select("name", "b.*")


def json_signature(lines: DataFrame) -> DataFrame:
    """(sample_id, sourcetype): the signature with most keys, all of them top-level keys of the sample."""
    keys = F.json_object_keys("raw")
    held = lines.select("sample_id", F.explode(keys).alias("key")).groupBy("sample_id").agg(F.collect_set(F.lower("key")).alias("keys"))
    verdict = F.lit(None).cast("string")
    for name, needed in sorted(hints.JSON_SIGNATURES.items(), key=lambda x: len(x[1])):
        wanted = F.array(*[F.lit(x.lower()) for x in needed])
        verdict = F.when(F.size(F.array_except(wanted, "keys")) == 0, name).otherwise(verdict)
    return held.select("sample_id", verdict.alias("sourcetype")).where("sourcetype is not null")


def windows_channel(lines: DataFrame) -> DataFrame:
    """(sample_id, sourcetype, channel, share) where 60 % of a sample's lines are Windows events and one mapped channel has half of those."""
    event = F.col("raw").rlike(hints.WINDOWS_EVENT)
    channel = F.trim(F.regexp_extract("raw", "<Channel>([^<]*)</Channel>", 1))
    total = lines.groupBy("sample_id").agg(F.count("*").alias("n"), F.count_if(event).alias("events"))
    total = total.where(F.col("events") >= F.ceil(F.col("n") * 0.6)).where("events > 0")
    counted = lines.where(event).where(channel != "").groupBy("sample_id", channel.alias("channel")).agg(F.count("*").alias("lines"))
    place = F.rank().over(Window.partitionBy("sample_id").orderBy(F.desc("lines")))
    top = counted.withColumn("place", place).where("place = 1")
    single = top.groupBy("sample_id").agg(F.count("*").alias("ties"), F.first("channel").alias("channel"), F.first("lines").alias("lines")).where("ties = 1")
    named = F.create_map(*[F.lit(x) for pair in hints.WINDOWS_CHANNELS.items() for x in pair])[F.lower("channel")]
    rows = single.join(total, "sample_id").where(F.col("lines") * 2 >= F.col("events")).withColumn("sourcetype", named).where("sourcetype is not null")
    return rows.select("sample_id", "sourcetype", "channel", (F.col("lines") / F.col("events")).alias("share"))
