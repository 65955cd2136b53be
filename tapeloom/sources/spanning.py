"""CSV files whose records may hold line breaks, read in as many tasks as the files have splits.

A line break ends a record only outside quotes, and whether a line begins inside them depends on everything before it.  That
dependence is one of four maps of a two-valued state (outside, inside), so it is composed like a prefix sum: every line says
where it ends if it begins outside, and where if it begins inside; a line whose end does not depend on its beginning settles
the state, and between such lines only changes of state are counted.  The same composition runs over the lines of a split
and over the splits of a file.  A line that begins outside begins a record; records are numbered by a second prefix sum, and
lines with one number, from different splits too, are joined.

A window holds the lines of one split or the splits of one file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec, functions as F, types as T

from ..session import written

# ---- fixed values: how quotes open and close ----
_INSIDE = '[^"]*+(?:""[^"]*+)*+'
_FIELDS = f'(?:(?:"{_INSIDE}"[^,]*+|[^",][^,]*+)?+,)*+'
#: Lines that end inside a quoted field, if they begin outside, and if they begin inside.
OPENS = f'(?s)^{_FIELDS}"{_INSIDE}$'
STAYS = f'(?s)^{_INSIDE}(?:"[^,]*+,{_FIELDS}"{_INSIDE})?+$'
# ---- end of fixed values ----


def _ends_inside(line: Column) -> dict[str, Column]:
    """Whether a line ends inside quotes, having begun outside and having begun inside; most lines have no quote at all."""
    quoted = line.contains('"')
    return {"from_out": quoted & line.rlike(OPENS), "from_in": ~quoted | line.rlike(STAYS)}


def _settled(df: DataFrame, series: WindowSpec) -> DataFrame:
    """What the maps ``from_out, from_in`` up to a row come to: the last settled state, and the changes of state in all and up to it."""
    upto = series.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    change = F.col("from_out") & ~F.col("from_in")
    df = df.withColumn("changes", F.sum(change.cast("int")).over(upto))
    settles = F.when(F.col("from_out") == F.col("from_in"), F.struct(F.col("from_out").alias("inside"), F.col("changes")))
    return df.withColumn("settled", F.last(settles, ignorenulls=True).over(upto))


def _inside_after(entry: Column) -> Column:
    """The state after a row of :func:`_settled`, ``entry`` being the state before the first one."""
    odd = lambda n: n % 2 == 1
    since = F.col("settled.inside") != odd(F.col("changes") - F.col("settled.changes"))
    return F.when(F.col("settled").isNotNull(), since).otherwise(entry != odd(F.col("changes")))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, start, n, line`` with the state each line leaves: the lines of a path, ``start`` being the split and n their order in it."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n"), F.col("value").alias("line"),
    )
    lines = lines.select("*", *[c.alias(n) for n, c in _ends_inside(F.col("line")).items()])
    return _settled(lines, Window.partitionBy("file", "start").orderBy("n"))


def spanning_records(spark: SparkSession, path: str) -> DataFrame:
    """``file, record, text``: the records of all files of a path, numbered from 1 in each file.

    A record that a file's end leaves open ends there.  A field holds its line breaks as they are; a carriage return before
    the line break that ends a record goes.
    """
    lines = written(numbered_lines(spark, path), "lines")  # read twice below; line numbers are frozen here
    outside, inside = F.lit(False), F.lit(True)
    splits = lines.groupBy("file", "start").agg(
        F.max_by(_inside_after(outside), "n").alias("from_out"), F.max_by(_inside_after(inside), "n").alias("from_in")
    )
    of_file = Window.partitionBy("file").orderBy("start")
    splits = _settled(splits, of_file).withColumn("after", _inside_after(outside))
    entries = splits.select("file", "start", F.coalesce(F.lag("after").over(of_file), outside).alias("entry"))
    of_split = Window.partitionBy("file", "start").orderBy("n")
    known = lines.join(entries, ["file", "start"])
    begins = ~F.coalesce(F.lag(_inside_after(F.col("entry"))).over(of_split), F.col("entry"))
    known = known.withColumn("begins", begins).select("file", "start", "n", "line", "begins")
    known = known.withColumns({
        "record": F.sum(F.col("begins").cast("int")).over(of_split.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        "alone": F.col("begins") & F.lead("begins").over(of_split),
    })
    known = written(known, "records")
    begun = known.groupBy("file", "start").agg(F.max("record").alias("begun"))
    offsets = begun.select("file", "start", (F.sum("begun").over(of_file) - F.col("begun")).alias("offset"))
    placed = known.join(offsets, ["file", "start"]).withColumn("record", F.col("offset") + F.col("record"))
    whole = placed.filter("alone").select("file", "record", F.col("line").alias("text"))
    parts = placed.filter(~F.coalesce("alone", F.lit(False))).groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("start", "n", "line"))).alias("parts"))
    joined = parts.select("file", "record", F.array_join(F.transform("parts", lambda p: p["line"]), "\n").alias("text"))  # one record's lines
    return whole.unionByName(joined).withColumn("text", F.regexp_replace("text", "\r$", ""))


def read_spanning_csv(spark: SparkSession, path: str, schema: T.StructType, header: bool = True) -> DataFrame:
    """A CSV path whose quoted fields may hold line breaks, under a declared schema.

    With ``header`` the first record of every file is left out.  Empty records count for nothing; a record that does not fit
    the schema keeps what does and NULL otherwise.
    """
    records = spanning_records(spark, path).filter((F.col("text") != "") & ((F.col("record") > 1) | F.lit(not header)))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    parsed = F.from_csv("text", fields, {"quote": '"', "escape": '"', "mode": "PERMISSIVE"})
    return records.select(parsed.alias("r")).select("r.*")
