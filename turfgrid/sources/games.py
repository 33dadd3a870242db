"""Pass-event files: one CSV per game, one row per pass, player slots as wide columns."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turfgrid.functions.cells import to_id
from turfgrid.operators.slots import SLOT_FIELDS, SlotColumns, discover_slots, spread_slots
from turfgrid.session import broadcast_if_small, scratch_dir

# The scalar columns that are read from a file.
PASS_COLUMNS = (
    "pass_outcome_type",
    "player_id",
    "team_id",
    "ball_x_start",
    "ball_y_start",
    "ball_x_end",
    "ball_y_end",
)

_BALL = ("ball_x_start", "ball_y_start", "ball_x_end", "ball_y_end")
_SEAT = "struct<slot:bigint,orig_id:bigint,slot_team:bigint,x:double,y:double,vx:double,vy:double>"
_ROW = f"source_file string, row bigint, _file int, pass_outcome_type string, team_id double, player_id double, {' double, '.join(_BALL)} double, slots array<{_SEAT}>"

MOST_FILES = 50_000  # rows of a broadcast table of files; a row has about 1 KB

# Texts that a pandas reader takes for a missing value.
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
    "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def _read_lines(spark: SparkSession, directory: str | list[str], recursive: bool) -> DataFrame:
    """Non-empty lines of all CSV files of a directory, or of the files of a list, with their file and place: the split's start and the order within it."""
    reader = spark.read.option("pathGlobFilter", "*.csv")
    reader = reader.option("recursiveFileLookup", "true") if recursive else reader
    # splits keep their limits when cores come or go between two jobs
    if not spark.conf.get("spark.sql.files.minPartitionNum", None):
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    return (
        reader.text(directory)
        .select("value", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("split_start"))
        .where(F.trim("value") != "")
        .withColumn("order", F.monotonically_increasing_id())
    )


def _parsed(line: str, columns: int) -> Column:
    """A CSV line as a struct of texts, NULL where empty or absent."""
    names = ", ".join(f"c{i} string" for i in range(columns))
    trimmed = {"ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
    return F.from_csv(line, F.lit(names), trimmed)


def _with_fields(table: DataFrame, line: str, columns: int, name: str) -> DataFrame:
    """Add the fields of a CSV line as an array of texts, NULL where empty or absent; a line is parsed once."""
    parsed = table.withColumn("_parsed", _parsed(line, columns))
    return parsed.withColumn(name, F.array(*[F.col(f"_parsed.c{i}") for i in range(columns)])).drop("_parsed")


_DECIMAL = re.compile(r"[+-]?(NaN|Infinity|([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[fFdD]?)")
_HEX = re.compile(r"[+-]?0[xX]([0-9a-fA-F]+\.?|[0-9a-fA-F]*\.[0-9a-fA-F]+)[pP][+-]?[0-9]+[fFdD]?")
_NAMED = {"inf": np.inf, "+inf": np.inf, "infinity": np.inf, "+infinity": np.inf, "-inf": -np.inf, "-infinity": -np.inf, "nan": np.nan}
_SPACE = "".join(map(chr, range(33)))


def _double(text: str | None) -> float | None:
    """A text as `try_cast` to a double takes it."""
    if text is None:
        return None
    text = text.strip(_SPACE)
    if _DECIMAL.fullmatch(text):
        return float(text if text.endswith(("NaN", "Infinity")) else text.rstrip("fFdD"))
    if _HEX.fullmatch(text):
        try:
            return float.fromhex(text.rstrip("fFdD") if text[-1] in "fFdD" and "p" in text.lower() else text)
        except OverflowError:
            return -np.inf if text.startswith("-") else np.inf
    return _NAMED.get(text.lower())


def _doubles(texts: pa.Array) -> pa.Array:
    """Texts as `try_cast` to a double takes them; a column of plain numbers is read as a whole."""
    try:
        values = pc.cast(texts, pa.float64())
    except pa.ArrowInvalid:
        return pa.array([_double(t) for t in texts.to_pylist()], pa.float64())
    if pc.all(pc.is_finite(values)).as_py() is False:
        return pa.array([_double(t) for t in texts.to_pylist()], pa.float64())
    return values


def _longs(values: np.ndarray, lacking: np.ndarray) -> pa.Array:
    """Doubles as `try_cast` to a bigint takes them: cut to whole numbers, NULL where they do not fit."""
    whole = np.trunc(np.where(np.isnan(values), 2.0**64, values))
    last = whole >= 2.0**63
    longs = np.where(last | (whole < -(2.0**63)), 0.0, whole).astype(np.int64)
    longs[whole == 2.0**63] = np.iinfo(np.int64).max
    return pa.array(longs, mask=lacking | (whole > 2.0**63) | (whole < -(2.0**63)))


def _by_header(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[int]]]:
    """The rows of a batch by the places of their columns; lines of a file follow each other."""
    places = batch.column("_places")
    table = places.flatten().to_numpy().reshape(batch.num_rows, -1)
    limits = np.append(np.flatnonzero(np.append(True, (table[1:] != table[:-1]).any(axis=1))), batch.num_rows)
    alike: dict[bytes, list[tuple[int, int]]] = {}
    for start, end in zip(limits[:-1].tolist(), limits[1:].tolist(), strict=True):
        alike.setdefault(table[start].tobytes(), []).append((start, end))
    for stretches in alike.values():
        at = table[stretches[0][0]].tolist()
        if len(alike) == 1:
            yield batch, at
        else:
            yield batch.take(pa.array(np.concatenate([np.arange(*s) for s in stretches]))), at


def _pass_rows(at: dict[str, int], slots: list[SlotColumns]):
    """Passes from parsed lines, for a batch and one column of it at a time: expressions for each slot are too long a program to be compiled.

    `at` numbers the used columns; `_places` says where each of them stands in a line's file, 0 if it is not there.
    """
    missing = pa.array(MISSING_TEXTS)

    def rows(batch: pa.RecordBatch, places: list[int]) -> pa.RecordBatch:
        fields, n = batch.column("_parsed").flatten(), batch.num_rows

        def text(name: str) -> pa.Array:
            place = places[at[name]]
            if not place:
                return pa.nulls(n, pa.string())
            found = fields[place - 1]
            return pc.if_else(pc.is_in(found, value_set=missing), pa.scalar(None, pa.string()), found)

        def placed(s: SlotColumns) -> int:
            # the passer is sought in the order of the identity columns
            return places[at[s.columns.get("orig_id") or next(iter(s.columns.values()))]]

        seats = sorted((s for s in slots if placed(s)), key=placed)
        columns = [pa.array(np.tile(np.array([s.slot for s in seats], np.int64), n))]
        for field in SLOT_FIELDS[1:]:
            values, lacking = np.full((n, len(seats)), np.nan), np.ones((n, len(seats)), bool)
            for i, s in enumerate(seats):
                if field in s.columns:
                    numbers = _doubles(text(s.columns[field]))
                    values[:, i] = numbers.to_numpy(zero_copy_only=False)
                    lacking[:, i] = numbers.is_null().to_numpy(zero_copy_only=False)
            values, lacking = values.ravel(), lacking.ravel()
            columns.append(_longs(values, lacking) if field in ("orig_id", "slot_team") else pa.array(values, mask=lacking))
        ends = pa.array(np.arange(n + 1, dtype=np.int32) * len(seats))
        seated = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(columns, list(SLOT_FIELDS)))
        kept = [batch.column(c) for c in ("source_file", "row", "_file")]
        numbers = [_doubles(text(c)) for c in ("team_id", "player_id", *_BALL)]
        return pa.RecordBatch.from_arrays([*kept, text("pass_outcome_type"), *numbers, seated], names)

    names = ["source_file", "row", "_file", "pass_outcome_type", "team_id", "player_id", *_BALL, "slots"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for part, places in _by_header(batch):
                    yield rows(part, places)

    return run


def _headers(numbered: DataFrame) -> tuple[DataFrame, int]:
    """Each file's first line as a `header` array, and the width of the widest.

    A file without the columns of a pass is an error. Only that width and the faulty files come to the driver.
    """
    first = _kept(numbered.where("row = 0").select("source_file", F.col("value").alias("line")), "headers")
    columns = first.agg(F.max(F.size(F.split("line", ",")))).first()[0]
    if not columns:
        raise ValueError("no pass files")
    headers = _with_fields(first, "line", columns, "header").select("source_file", "header")
    lacking = F.array_except(F.array(*[F.lit(c) for c in PASS_COLUMNS]), "header")
    faulty = headers.where(F.size(lacking) > 0).select("source_file", lacking.alias("lacking")).limit(5).collect()
    if faulty:
        raise ValueError("; ".join(f"{r.source_file} lacks {', '.join(r.lacking)}" for r in faulty))
    return headers, columns


def _game_of(path) -> Column:
    """Game id: the number in the file name, or the game_id=... folder."""
    folder = F.regexp_extract(path, r"game_id=(\d+)/", 1)
    name = F.regexp_extract(path, r"(\d+)\.csv$", 1)
    return F.when(folder != "", folder).otherwise(name).try_cast("bigint")


def _numbered(lines: DataFrame) -> DataFrame:
    """Add `row`: the place of each line in its file, 0 for the header, however the file is split.

    A split lies in one task, whose lines that are not empty are numbered one after another. So the first number and the size
    of each split, a row per split, say how far its lines are to be moved; the lines stay where they are.
    """
    splits = lines.groupBy("source_file", "split_start").agg(F.min("order").alias("_first"), F.count("*").alias("_lines"))
    before = Window.partitionBy("source_file").orderBy("split_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = _kept(splits.withColumn("_before", F.coalesce(F.sum("_lines").over(before), F.lit(0))), "splits")
    inside = F.col("order") - F.col("_first")
    other = F.raise_error(F.concat(F.lit("split otherwise than when its lines were counted: "), "source_file")).cast("bigint")
    row = F.when((inside >= 0) & (inside < F.col("_lines")), F.col("_before") + inside).otherwise(other)
    return lines.join(offsets, ["source_file", "split_start"], "left").withColumn("row", row).drop("_first", "_lines", "_before")


def _kept(table: DataFrame, label: str) -> DataFrame:
    """A table with a row per file or split, written once; it goes to the tasks whole while it is small."""
    path = scratch_dir(table.sparkSession, label)
    table.write.parquet(path)
    stored = table.sparkSession.read.schema(table.schema).parquet(path)
    return broadcast_if_small(stored, MOST_FILES)


def scan_passes(spark: SparkSession, directory: str | list[str], recursive: bool = False) -> DataFrame:
    """Every CSV of a directory in the normal form: scalars and one `slots` array per pass; other files are ignored.

    Each line is paired with its file's header, and fields are found by name, so one plan serves any number
    of headers. Slots keep the order of their columns in the file. `pass_id` is made of the file's rank by
    path and the row in it: the same for given files, however they are read.
    """
    numbered = _numbered(_read_lines(spark, directory, recursive))
    headers, columns = _headers(numbered)
    names = [r[0] for r in headers.select(F.explode("header").alias("name")).where("name is not null").distinct().collect()]
    slots = sorted(discover_slots(names), key=lambda s: s.slot)
    used = [*PASS_COLUMNS, *[c for s in slots for c in s.columns.values()]]
    at = {name: i for i, name in enumerate(used)}
    # where each used column stands in a file, 0 if it is not there; a row per file
    number = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("source_file")) - 1
    places = F.transform(F.array(*[F.lit(c) for c in used]), lambda c: F.array_position("header", c).cast("int"))
    files = _kept(headers.select("source_file", number.alias("_file"), places.alias("_places")), "files")
    rows = numbered.where("row > 0").join(files, "source_file")
    parsed = rows.select("source_file", "row", "_file", "_places", _parsed("value", columns).alias("_parsed"))
    made = parsed.mapInArrow(_pass_rows(at, slots), _ROW)
    return made.select(
        (F.col("_file") * F.lit(1 << 36) + F.col("row") - 1).alias("pass_id"),
        _game_of(F.col("source_file")).alias("game_id"),
        *[to_id(F.col(c)).alias(c) for c in ("team_id", "player_id")],
        "pass_outcome_type",
        *_BALL,
        "slots",
        "source_file",
    )


def scan_game(spark: SparkSession, file: str) -> DataFrame:
    """One game file."""
    return scan_passes(spark, file)


def source_stats(spark: SparkSession, directory: str, recursive: bool = False) -> DataFrame:
    """Passes per file; the lines are counted and not parsed."""
    lines = _read_lines(spark, directory, recursive)
    counts = lines.groupBy("source_file").agg((F.count("*") - 1).alias("n"))
    return counts.select(_game_of(F.col("source_file")).alias("game_id"), "source_file", "n")


def write_games(passes: DataFrame, directory: str, slots: list[int], whole: bool = False) -> None:
    """Write passes as CSV files with wide slot columns, in one folder per game; with `whole` as one file each."""
    wide = spread_slots(passes, slots).drop("pass_id")
    wide = wide.repartition("game_id") if whole else wide
    wide.write.partitionBy("game_id").option("header", True).mode("append").csv(directory)
