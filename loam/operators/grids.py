"""Integer grids: geometry, text forms, connected shapes, prompts, parsed responses and their evaluation."""

import difflib
from collections.abc import Callable, Collection, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

SHAPES = "key string, shape int, color int, top int, left int, height int, width int, x int, y int, size int, cells array<struct<r:int,c:int>>, subgrid array<array<int>>"


def dimensions(grid: Column) -> tuple[Column, Column]:
    return F.size(grid), F.coalesce(F.size(F.try_element_at(grid, F.lit(1))), F.lit(0))


def anchor(row: Column, col: Column, height: Column) -> tuple[Column, Column]:
    """(x, y) of a cell, y counted from the bottom row."""
    return col, height - 1 - row


def subgrid(grid: Column, top: Column, left: Column, height: Column, width: Column) -> Column:
    return F.transform(F.slice(grid, top + 1, height), lambda r: F.slice(r, left + 1, width))


def cells(grids: DataFrame, keys: list[str], grid_col: str = "grid") -> DataFrame:
    """A row a cell: (keys, r, c, v)."""
    rows = grids.select(*keys, F.posexplode(grid_col).alias("r", "row"))
    return rows.select(*keys, "r", F.posexplode("row").alias("c", "v"))


def bounding_boxes(cell_rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, top, left, height, width) of cells."""
    box = cell_rows.groupBy(*keys).agg(F.min("r").alias("top"), F.min("c").alias("left"), F.max("r").alias("bottom"), F.max("c").alias("right"))
    return box.select(*keys, "top", "left", (F.col("bottom") - F.col("top") + 1).alias("height"), (F.col("right") - F.col("left") + 1).alias("width"))


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value taken once a row however often, and in whatever lambdas, it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def crop(grid: Column) -> Column:
    """The grid cut to its cells that are not zero; a grid of zeros stays."""
    full_rows = F.filter(F.transform(grid, lambda r, i: F.when(F.exists(r, lambda v: v != 0), i)), lambda i: i.isNotNull())
    full_cols = F.filter(F.flatten(F.transform(grid, lambda r: F.transform(r, lambda v, j: F.when(v != 0, j)))), lambda j: j.isNotNull())
    box = lambda full: F.struct(*(f(full[c]).alias(f"{n}_{c}") for c in ("rows", "cols") for n, f in (("least", F.array_min), ("most", F.array_max))))
    cut = lambda b: subgrid(grid, b["least_rows"], b["least_cols"], b["most_rows"] - b["least_rows"] + 1, b["most_cols"] - b["least_cols"] + 1)
    return once(F.struct(full_rows.alias("rows"), full_cols.alias("cols")), lambda full: F.when(F.size(full["rows"]) == 0, grid).otherwise(once(box(full), cut)))


def ascii_text(grid: Column, padded: bool = True) -> Column:
    """Cells joined by blanks (right-justified to two places), rows by line ends."""
    cell = (lambda v: F.when((v >= 0) & (v < 10), F.concat(F.lit(" "), v.cast("string"))).otherwise(v.cast("string"))) if padded else (lambda v: v.cast("string"))
    return F.array_join(F.transform(grid, lambda r: F.array_join(F.transform(r, cell), " ")), "\n")


def compact_text(grid: Column) -> Column:
    return F.array_join(F.transform(grid, lambda r: F.array_join(F.transform(r, lambda v: v.cast("string")), "")), "\n")


def parse_text(text: Column) -> Column:
    """Grid of lines of digits; blank lines and blanks around a line are ignored."""
    rows = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(rows, lambda x: F.transform(F.filter(F.split(x, ""), lambda c: c != ""), lambda c: c.cast("int")))


def labels(grids: np.ndarray, background: int = 0) -> np.ndarray:
    """Of each cell of equally large grids (n, height, width), the number of its 8-connected component's first cell; -1 for the background.

    Each round every cell takes the least number beside it and then the number of that cell, so that rounds grow with
    the logarithm of a component's extent.
    """
    n, height, width = grids.shape
    none = height * width
    label = np.where(grids == background, none, np.arange(none).reshape(height, width))
    while True:
        new = label.copy()
        for r, c in ((0, 1), (1, -1), (1, 0), (1, 1)):
            here = (slice(None), slice(0, height - r), slice(max(0, -c), width - max(0, c)))
            there = (slice(None), slice(r, height), slice(max(0, c), width + min(0, c)))
            low = np.where(grids[here] == grids[there], np.minimum(new[here], new[there]), none)
            np.minimum(new[here], low, out=new[here])
            np.minimum(new[there], low, out=new[there])
        flat = np.concatenate((new.reshape(n, -1), np.full((n, 1), none)), axis=1)
        new = np.take_along_axis(flat, flat, axis=1)[:, :none].reshape(label.shape)
        if np.array_equal(new, label):
            return np.where(label == none, -1, label)
        label = new


def steps(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[k], start[k] + 1, ... size[k] of them for each k."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


def shapes_of(grids: np.ndarray, background: int, least: int, columns: Collection[str]) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """(grid number, columns) of the shapes of equally large grids: by colour, then first cell."""
    n, height, width = grids.shape
    area = height * width
    label, value = labels(grids, background).reshape(-1), grids.reshape(-1)
    cell = np.flatnonzero(label >= 0)
    grid, root, color = cell // area, label[cell], value[cell]
    order = np.lexsort((cell, root, color, grid))
    cell, grid, root, color = cell[order], grid[order], root[order], color[order]
    first = np.flatnonzero(np.r_[True, (grid[1:] != grid[:-1]) | (root[1:] != root[:-1])]) if len(cell) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(cell)))
    row, col = cell % area // width, cell % width
    if len(first):
        top, left = row[first], np.minimum.reduceat(col, first)
        high, wide = np.maximum.reduceat(row, first) - top + 1, np.maximum.reduceat(col, first) - left + 1
    else:
        top = left = high = wide = first
    kept = np.flatnonzero(size >= least)
    first, size, top, left, high, wide = first[kept], size[kept], top[kept], left[kept], high[kept], wide[kept]
    grid_of = grid[first]
    begin = np.flatnonzero(np.r_[True, grid_of[1:] != grid_of[:-1]]) if len(first) else first
    number = np.arange(len(first)) - np.repeat(begin, np.diff(np.append(begin, len(first))))
    out = {k: pa.array(v, pa.int32()) for k, v in (("shape", number), ("color", color[first]), ("top", top), ("left", left), ("height", high), ("width", wide), ("x", left), ("y", height - 1 - top), ("size", size))}
    if "cells" in columns:
        at = steps(first, size)
        out["cells"] = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)], pa.int32()), pa.StructArray.from_arrays([pa.array(row[at], pa.int32()), pa.array(col[at], pa.int32())], names=["r", "c"]))
    if "subgrid" in columns:
        rows = np.repeat(np.arange(len(first)), high)
        begins = grid_of[rows] * area + steps(top, high) * width + left[rows]
        values = pa.array(value[steps(begins, wide[rows])], pa.int32())
        lines = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(wide[rows])], pa.int32()), values)
        out["subgrid"] = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(high)], pa.int32()), lines)
    return grid_of, out


def shapes(grids: DataFrame, background: int = 0, least: int = 1, columns: Iterable[str] = ("cells", "subgrid")) -> DataFrame:
    """Shapes of (key, grid): a row each, numbered from 0 within the grid; cells and sub-grids (whatever is in the box) where asked.

    Grids are small and whole in their rows, so a batch's grids of one size are labelled at once, where they are;
    nothing is shuffled. Grids are rectangular; the rows of one that is not are filled with background on the right. A
    null or empty grid has no shapes.
    """
    columns = set(columns)
    wanted = [x.strip() for x in SHAPES.split(", ")]
    wanted = [x for x in wanted if x.split()[0] not in {"cells", "subgrid"} - columns]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in wanted]
        for batch in batches:
            column = batch.column(1)
            lines = column.values
            outer, inner = np.asarray(column.offsets).astype(np.int64), np.asarray(lines.offsets).astype(np.int64)
            values = np.asarray(lines.values.fill_null(background)).astype(np.int32)
            high = np.diff(outer) * np.asarray(column.is_valid()).astype(np.int64)
            wide = np.diff(inner)
            widest = np.array([wide[a : a + h].max(initial=0) for a, h in zip(outer, high)], np.int64)
            for h, w in np.unique(np.stack((high, widest), axis=1), axis=0).tolist():
                if not h or not w:
                    continue
                own = np.flatnonzero((high == h) & (widest == w))
                row = steps(outer[own], np.full(len(own), h))
                made = np.full((len(row), w), background, np.int32)
                made[np.repeat(np.arange(len(row)), wide[row]), steps(np.zeros(len(row), np.int64), wide[row])] = values[steps(inner[row], wide[row])]
                grid, found = shapes_of(made.reshape(len(own), h, w), background, least, columns)
                found["key"] = batch.column(0).take(pa.array(own[grid]))
                yield pa.RecordBatch.from_arrays([found[c] for c in names], names=names)

    return grids.select(F.col("key").cast("string").alias("key"), "grid").mapInArrow(task, ", ".join(wanted))


@F.pandas_udf(DoubleType())
def similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    """Ratio of matching characters of two texts."""
    return pd.Series([difflib.SequenceMatcher(None, a or "", b or "").ratio() for a, b in zip(left, right)])


def evaluate_sides(rows: DataFrame, key: str = "key") -> DataFrame:
    """(key, n_predicted, n_actual, success, reason, match_rate) of shapes (key, told, x, y) of both sides, told where they are predicted: grouped once."""
    position, told = F.struct("x", "y"), F.col("told")
    both = rows.groupBy(key).agg(
        F.count_if(told).alias("n_predicted"), F.count_if(~told).alias("n_actual"),
        F.array_sort(F.collect_set(F.when(told, position))).alias("predicted"), F.array_sort(F.collect_set(F.when(~told, position))).alias("actual"),
    )
    p, a = F.col("predicted"), F.col("actual")
    reason = F.when(F.col("n_predicted") != F.col("n_actual"), "count").when(p != a, "position").when(F.size(a) != F.col("n_actual"), "duplicate").otherwise("")
    rate = F.when(reason.isin("count", "position"), 0.0).otherwise(F.round(F.size(a) / F.col("n_actual"), 9))
    return both.select(key, "n_predicted", "n_actual", (reason == "").alias("success"), reason.alias("reason"), rate.alias("match_rate"))


def evaluate(predicted: DataFrame, actual: DataFrame, key: str = "key") -> DataFrame:
    """(key, n_predicted, n_actual, success, reason, match_rate[, least, mean, most]) of shapes (key, x, y[, description]).

    Success: as many shapes, and the same positions; shapes of one position make it fail, as fewer positions match.
    Where both sides have descriptions, least, mean and most are the similarities of those of one position (of several
    there, the last by its text), 0 where numbers or positions differ.
    """
    side = lambda df, told: df.select(key, F.lit(told).alias("told"), "x", "y")
    out = evaluate_sides(side(predicted, True).unionByName(side(actual, False)), key)
    if "description" not in predicted.columns or "description" not in actual.columns:
        return out
    last = lambda df, name: df.groupBy(key, "x", "y").agg(F.max("description").alias(name))
    pairs = last(predicted, "told").join(last(actual, "description"), [key, "x", "y"])
    alike = pairs.select(key, similarity("description", "told").alias("s")).groupBy(key).agg(*(f(F.col("s")).alias(c) for f, c in ((F.min, "least"), (F.avg, "mean"), (F.max, "most"))))
    compared = F.col("reason").isin("", "duplicate")
    out = out.join(alike, key, "left")
    return out.select(key, "n_predicted", "n_actual", "success", "reason", "match_rate", *(F.when(compared, F.coalesce(F.round(c, 9), F.lit(0.0))).otherwise(0.0).alias(c) for c in ("least", "mean", "most")))


def evaluate_tasks(tasks: DataFrame, predictions: DataFrame) -> DataFrame:
    """Evaluation of predictions (task_id, pair, x, y, description) of the test outputs of tasks (task_id, split, pair, role, grid[, description]).

    (task_id, pair, n_predicted, n_actual, success, reason, match_rate): shapes of the test outputs are found and
    compared in one plan. A pair without a prediction is one that predicts nothing; one without a task is left out.
    """
    key = F.concat_ws("\x1f", "task_id", F.col("pair").cast("string")).alias("key")
    actual = shapes(tasks.where("split = 'test' AND role = 'output'").select(key, "grid"), columns=()).select("key", "x", "y")
    known = tasks.where("split = 'test' AND role = 'output'").select(key, "task_id", "pair")
    found = evaluate(predictions.select(key, "x", "y"), actual)
    return known.join(found, "key").drop("key")


def described(shape_rows: DataFrame, cache: DataFrame) -> DataFrame:
    """Shapes with the cached description of their cropped grid; a fixed text where there is none."""
    asked = shape_rows.withColumn("asked", compact_text(crop(F.col("subgrid"))))
    return asked.join(cache.select(F.col("grid_text").alias("asked"), "description"), "asked", "left").withColumn("description", F.coalesce("description", F.lit("Shape description unavailable"))).drop("asked")


def prompts(shape_rows: DataFrame, key: str = "key") -> DataFrame:
    """(key, prompt): shapes in order, each with number, position, grid and description."""
    block = F.concat(F.lit("SHAPE "), (F.col("shape") + 1).cast("string"), F.lit("\nPOS: "), F.col("x").cast("string"), F.lit(","), F.col("y").cast("string"), F.lit("\n"), ascii_text(crop(F.col("subgrid"))), F.lit("\nDESCRIPTION: "), F.coalesce("description", F.lit("")))
    listed = shape_rows.select(key, "shape", block.alias("block")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("shape", "block"))).alias("all"))
    return listed.select(key, F.concat(F.lit("INPUT SHAPES:\n"), F.array_join(F.transform("all", lambda x: x["block"]), "\n\n")).alias("prompt"))


def parse_responses(responses: DataFrame, strict: bool = True) -> DataFrame:
    """(key, shape, x, y, description) of model responses (key, text), cut at blank lines.

    A section that begins with SHAPE opens a shape; later sections give POS, Description or a grid of 0 and 1.
    Only shapes with a grid count. strict: POS within the SHAPE section is not read (0,0), as in the protocol;
    else it is.
    """
    parts = responses.select("key", F.posexplode(F.split("text", "\n\n")).alias("i", "part")).withColumn("part", F.trim("part"))
    opens = F.col("part").startswith("SHAPE ")
    shape = F.sum(F.when(opens, 1).otherwise(0)).over(Window.partitionBy("key").orderBy("i"))
    pos = F.regexp_extract("part", r"(?m)^POS:\s*(-?\d+\s*,\s*-?\d+)\s*$", 1)
    has_pos, has_text = F.col("part").rlike(r"(?m)^POS:"), F.col("part").rlike(r"(?m)^Description")
    told = parts.withColumn("shape", shape).where("shape > 0").select(
        "key", "shape", "i",
        F.when((~opens | F.lit(not strict)) & (pos != ""), pos).alias("pos"),
        F.when(~opens & ~has_pos & has_text, F.col("part")).alias("description"),
        (~opens & ~has_pos & ~has_text & F.col("part").rlike(r"^[01 \n]+$")).alias("grid"),
    )
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("i")))
    one = told.groupBy("key", "shape").agg(last("pos").alias("pos"), last("description").alias("description"), F.bool_or("grid").alias("grid")).where("grid")
    xy = F.split(F.coalesce("pos", F.lit("0,0")), ",")
    return one.select("key", "shape", F.trim(xy[0]).cast("int").alias("x"), F.trim(xy[1]).cast("int").alias("y"), F.coalesce("description", F.lit("No description")).alias("description"))
