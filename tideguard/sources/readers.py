"""Readers. Files are split by line, so one large upload is read by many tasks; CSV records of
several lines are put together afterwards."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideguard.config import DEFAULT_WHITELIST, KeywordDictionary
from tideguard.functions.text import filled, stripped
from tideguard.operators.reuse import latest

# --- fixed values -------------------------------------------------------------------
CSV_HEADERS = ["text", "content", "内容"]
TRAINING_LABELS = {"safe": 0, "pass": 0, "normal": 0, "unsafe": 1, "block": 1}
# --- end of fixed values ------------------------------------------------------------

# Text in quotes up to its closing quote or the end of the line; cells with their commas.
_QUOTED = r'[^"]*+(?:""[^"]*+)*+'
_CELLS = rf'(?:(?:[^",][^,]*+|"{_QUOTED}"[^,]*+)?+,)*+'
# Lines after which a quote is open: when none was open before, and when one was.
_OPENS = rf'^{_CELLS}"{_QUOTED}\z'
_STAYS = rf'^{_QUOTED}(?:\z|"[^,]*+,{_CELLS}"{_QUOTED}\z)'

EVENT_SCHEMA = (
    "event_id string, timestamp double, timestamp_iso string, content_id string, text string, "
    "user_id string, source string, decision string, confidence double, reason string, "
    "tier string, source_label string"
)


def with_position(df: DataFrame, name: str = "position") -> DataFrame:
    """Adds the 0-based row number in scan order, without moving a row.

    Numbers within a partition come for free; the offsets are a running total over one
    count per partition, small enough to broadcast.
    """
    tagged = df.withColumn("_pid", F.spark_partition_id()).withColumn(
        "_mid", F.monotonically_increasing_id()
    )
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    in_partition = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        tagged.join(F.broadcast(offsets), "_pid")
        .withColumn(name, F.col("_off") + in_partition)
        .drop("_pid", "_mid", "_off")
    )


def read_batch_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(id, text) of a JSON-lines upload; blank and malformed lines are skipped.

    A missing id becomes b0, b1, ... by the position among the lines kept.
    """
    lines = spark.read.text(path).where(filled(F.col("value")))
    parsed = F.from_json(
        "value",
        "id string, text string, _bad string",
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"},
    )
    is_object = F.ltrim(F.col("value")).startswith("{")
    kept = lines.select(parsed.alias("_p"), is_object.alias("_o")).where(
        "_o and _p._bad is null"
    )
    return with_position(kept.select("_p.id", "_p.text")).select(
        F.coalesce("id", F.concat(F.lit("b"), F.col("position").cast("string"))).alias("id"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def _with_open_quotes(rows: DataFrame, group: list[str], order: str) -> DataFrame:
    """Adds before0, after0, before1 and after1: whether (1 or 0) a quote is open before and after
    a row, if none or one is open before the group.

    `opens` and `stays` say the same after the row alone. Where they are equal, nothing before
    matters; else the row keeps the state or turns it round.
    """
    here = Window.partitionBy(*group).orderBy(order)
    through = here.rowsBetween(Window.unboundedPreceding, 0)
    turned = F.sum(F.when(F.expr("opens and not stays"), 1).otherwise(0)).over(through)
    fixed = F.when(F.expr("opens = stays"), (F.col("opens").cast("int") + F.col("_turned")) % 2)
    rows = rows.withColumn("_turned", turned)
    rows = rows.withColumn("_fixed", F.last(fixed, ignorenulls=True).over(through))
    for state in (0, 1):
        after = (F.coalesce("_fixed", F.lit(state)) + F.col("_turned")) % 2
        rows = rows.withColumn(f"after{state}", after.cast("int"))
        rows = rows.withColumn(f"before{state}", F.lag(f"after{state}", 1, state).over(here))
    return rows.drop("_turned", "_fixed")


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(position, value): the records of CSV files, with the line breaks inside quotes.

    Quotes are read as by Python's csv: a cell that begins with one goes on to its closing
    quote, over line ends too; other quotes are text. Blank lines count as records. Files are
    in the order of their names and begin outside quotes.

    Each part of a file is looked at as if it began outside quotes and as if it began inside;
    one row per part then tells which holds.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    meta, value = lines.metadataColumn("_metadata"), F.col("value")
    has_quote = F.contains(value, F.lit('"'))
    tagged = lines.select(
        meta["file_path"].alias("file"), meta["file_block_start"].alias("part"),
        F.monotonically_increasing_id().alias("line"), "value",
        (has_quote & F.rlike(value, F.lit(_OPENS))).alias("opens"),
        (~has_quote | F.rlike(value, F.lit(_STAYS))).alias("stays"),
    )
    part = ["file", "part"]
    tagged = _with_open_quotes(tagged, part, "line").drop("opens", "stays")
    through = Window.partitionBy(*part).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    for state in (0, 1):
        begins = F.sum(1 - F.col(f"before{state}")).over(through)
        tagged = tagged.withColumn(f"begun{state}", begins)
    parts = tagged.groupBy(*part).agg(
        F.max_by(F.col("after0") == 1, "line").alias("opens"),
        F.max_by(F.col("after1") == 1, "line").alias("stays"),
        F.max("begun0").alias("n0"),
        F.max("begun1").alias("n1"),
    )
    # A file begins outside quotes.
    parts = _with_open_quotes(parts, ["file"], "part")
    n = F.when(F.col("before0") == 0, F.col("n0")).otherwise(F.col("n1"))
    earlier = Window.orderBy(*part).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        *part, F.col("before0").alias("state"), F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias("records")
    )

    def held(name: str) -> Column:
        return F.when(F.col("state") == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1"))

    placed = tagged.join(F.broadcast(parts), part).select(
        *part, "line", "value", (F.col("records") + held("begun") - 1).alias("position"),
        (held("before") == 0).alias("first"), (held("after") == 0).alias("last"),
    )

    def joined(rows: Column) -> Column:
        return F.array_join(F.transform(rows, lambda x: x["value"]), "\n")

    # The lines of a part are in one place already: only records over several parts move again.
    pieces = placed.groupBy(*part, "position").agg(
        F.array_sort(F.collect_list(F.struct("line", "value"))).alias("_lines"),
        (F.max("first") & F.max("last")).alias("whole"),
    ).select("part", "position", joined(F.col("_lines")).alias("value"), "whole")
    gathered = pieces.where("not whole").groupBy("position").agg(
        F.array_sort(F.collect_list(F.struct("part", "value"))).alias("_pieces")
    ).select("position", joined(F.col("_pieces")).alias("value"))
    records = pieces.where("whole").select("position", "value").unionByName(gathered)
    return records.withColumn("value", F.regexp_replace("value", r"\r\z", ""))


def read_batch_csv(spark: SparkSession, path: str) -> DataFrame:
    """(id, text) of a CSV upload: text first, optional id second.

    A header is recognised by its first cell; rows with blank text are skipped; a missing id
    becomes b followed by the number of the record. Texts in quotes may have line breaks.
    """
    # A line separator of its own keeps the parser from changing line breaks in quotes.
    options = {"mode": "PERMISSIVE", "escape": "\"", "lineSep": "\n"}
    row = F.from_csv("value", "text string, id string", options)
    cells = csv_records(spark, path).where(filled(F.col("value"))).select("position", row.alias("_r")).select(
        "position", "_r.text", "_r.id"
    )
    header = (F.col("position") == 0) & F.lower("text").isin(*CSV_HEADERS)
    return cells.where(~header & filled(F.col("text"))).select(
        F.coalesce(
            stripped(F.col("id")), F.concat(F.lit("b"), F.col("position").cast("string"))
        ).alias("id"),
        stripped(F.col("text")).alias("text"),
    )


def read_events(
    spark: SparkSession, path: str, schema: str = EVENT_SCHEMA, limit: int | None = None
) -> DataFrame:
    """The event log (JSON lines, malformed ones dropped), newest first when limited."""
    log = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return log if limit is None else recent(log, "timestamp", limit)


def recent(events: DataFrame, order: str, limit: int) -> DataFrame:
    """The `limit` newest events: every task keeps its own newest, nothing is sorted whole."""
    return events.orderBy(F.col(order).desc()).limit(limit)


def count_events(events: DataFrame) -> DataFrame:
    return events.agg(F.count(F.lit(1)).alias("n"))


def load_dictionary(
    spark: SparkSession, path: str | None, whitelist: tuple[str, ...] = tuple(DEFAULT_WHITELIST)
) -> KeywordDictionary:
    """The dictionary file (one JSON object); the default words when there is no file.

    A dictionary is configuration: it is read once on the driver and becomes a literal.
    """
    if path is None:
        return KeywordDictionary.default()
    text = spark.read.text(path, wholetext=True).first()["value"]
    return KeywordDictionary.from_json(json.loads(text), whitelist)


def dictionary_table(spark: SparkSession, path: str) -> DataFrame:
    """The dictionary file as rows (word, category); the last category of a word wins."""
    whole = spark.read.text(path, wholetext=True)
    as_map = F.from_json("value", "map<string,string>")
    entries = whole.select(F.posexplode(as_map).alias("ord", "category", "words")).where(
        F.col("category") != "combos"
    )
    words = entries.select(
        "ord",
        "category",
        F.explode(F.from_json("words", "array<string>")).alias("word"),
    )
    return latest(words.withColumn("word", F.lower("word")), ["word"], ["ord"]).select(
        "word", "category"
    )


def combos_table(spark: SparkSession, path: str) -> DataFrame:
    """The dictionary file's combinations as rows (ord, words, label, note)."""
    schema = "combos array<struct<words:array<string>,label:string,note:string>>"
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("_d"))
    return whole.select(F.posexplode("_d.combos").alias("ord", "_c")).select(
        "ord", F.transform("_c.words", F.lower).alias("words"), "_c.label", "_c.note"
    )


def read_eval_cases(spark: SparkSession, path: str) -> DataFrame:
    """(text, expected) of a JSON-lines case file with `label` or `expected`."""
    cases = spark.read.schema("text string, label string, expected string").json(path)
    return cases.select("text", F.coalesce("expected", "label").alias("expected")).where(
        F.col("text").isNotNull()
    )


def expected_from_toxicity(toxicity: Column) -> Column:
    return F.when(toxicity == 1, "unsafe").otherwise("safe")


def expected_from_class(class_number: Column) -> Column:
    """0 hate speech and 1 offensive language are unsafe, 2 neither is safe."""
    return F.when(class_number.isin(0, 1), "unsafe").otherwise("safe")


def expected_from_prompt_label(label: Column) -> Column:
    return F.lower(label)


def newest_run(spark: SparkSession, root: str) -> str:
    """The name of the last folder run=<time stamp> under `root`, from one listing of it.

    Neither the files of the runs are listed nor any of them read, however many runs there are.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in files.listStatus(folder) if s.isDirectory()]
    runs = [n.removeprefix("run=") for n in names if n.startswith("run=")]
    if not runs:
        raise FileNotFoundError(f"no run under {root}")
    return max(runs)


def latest_run(spark: SparkSession, root: str) -> DataFrame:
    """The data set of the newest run under `root` (folders run=<time stamp>), with its `run`."""
    run = newest_run(spark, root)
    # A run stamp is a name, not a number: keep it as text.
    return spark.read.parquet(f"{root}/run={run}").withColumn("run", F.lit(run))


def training_rows(samples: DataFrame) -> DataFrame:
    """(text, label 0/1) of a labelled set; blank texts dropped, unknown labels are 0."""
    pairs = [F.lit(x) for pair in TRAINING_LABELS.items() for x in pair]
    number = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("label")), F.lit(0))
    return samples.where(filled(F.col("text"))).withColumn("label", number.cast("int"))


def load_known_hashes(loads: DataFrame) -> DataFrame:
    """Known-hash table from successive loads (hash, load_ord, metadata): later loads win."""
    return latest(loads, ["hash"], ["load_ord"])


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Images decoded by Spark's image source; undecodable files are left out."""
    return (
        spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    )
